"""Exports. Rows are written by the executors; the driver writes only documents of bounded size."""

from __future__ import annotations

import html
import json
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from siteloom.functions import text as T
from siteloom.operators import audit, gates, links
from siteloom.operators.grid import GridQuery, filtered
from siteloom.session import checkpointed

XLSX_ROWS = 1_048_575
SECTION_ROWS = 50
SITEMAP_URLS = 50_000


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(F.rlike(c, F.lit(r"^\s*[=+@-]|^[\t\r\n]")), F.concat(F.lit("'"), c)).otherwise(c)


def flat(df: DataFrame, guard: bool = False) -> DataFrame:
    """Every column as a CSV can hold it: nested values as JSON."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        elif guard and f.dataType.typeName() == "string":
            c = guarded(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, guard: bool = False, single: bool = False) -> None:
    """A folder of CSV parts with headers; `single` makes one part, for results known to be small."""
    out = flat(df, guard)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def published(path: str, write) -> None:
    """Writes a local file beside its place and moves it there, so that readers see all or nothing."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        write(part)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


# ---------------------------------------------------------------- XLSX


def _column(n: int) -> str:
    name = ""
    while True:
        n, r = divmod(n, 26)
        name = chr(65 + r) + name
        if n == 0:
            return name
        n -= 1


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v}</v></c>'
    text = "".join(c for c in str(v)[:32767] if c >= " " or c in "\t\n\r")
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(header: list[str], rows: Iterable) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    for i, row in enumerate([header], 1):
        yield f'<row r="{i}">' + "".join(_cell(f"{_column(j)}{i}", v) for j, v in enumerate(row)) + "</row>"
    for i, row in enumerate(rows, 2):
        yield f'<row r="{i}">' + "".join(_cell(f"{_column(j)}{i}", v) for j, v in enumerate(row)) + "</row>"
    yield "</sheetData></worksheet>"


def write_workbook(path: str, sheets: dict[str, DataFrame]) -> None:
    """An XLSX file with a sheet per DataFrame, whose rows are streamed to the file, not held. A sheet over the format's row
    limit is refused; the unfinished file is not published.
    """

    def within(name: str, rows):
        for n, row in enumerate(rows, 1):
            if n > XLSX_ROWS:
                raise ValueError(f"{name} has over {XLSX_ROWS} rows, which a sheet does not hold")
            yield row

    def write(part: str) -> None:
        main = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
            z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
            z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{main}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
            z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{main}"><sheets>{names}</sheets></workbook>')
            rels = "".join(f'<Relationship Id="r{i}" Type="{main}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
            z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">{rels}</Relationships>')
            for i, (name, df) in enumerate(sheets.items(), 1):
                out = flat(df)
                with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                    for piece in _sheet(out.columns, within(name, out.toLocalIterator())):
                        f.write(piece.encode("utf-8"))

    published(path, write)


#: Sheet: views whose records it lists, one row per record and view.
AUDIT_SHEETS = {
    "URLs": ["All"], "Broken Links": ["BrokenLinks"], "Redirects": ["Status3xx"],
    "Titles": ["TitleMissing", "TitleDuplicate", "TitleMultiple", "TitleTooShort", "TitleTooLong", "TitlePixelTooNarrow", "TitlePixelTooWide", "TitleSameAsH1"],
    "Descriptions": ["MetaMissing", "MetaDuplicate", "MetaMultiple", "MetaTooShort", "MetaTooLong", "MetaPixelTooNarrow", "MetaPixelTooWide"],
    "Canonicals": ["CanonicalMissing", "CanonicalMultiple", "PaginationCanonicalToLinkedPage"], "Content": ["ExactDuplicate"],
}


def audit_sheet(records: DataFrame, sheet: str, scope: list[str] = audit.SCOPE) -> DataFrame:
    """One sheet of the audit workbook: a row per record and view that holds it, from one scan."""
    p = audit.predicates()
    found = audit.hits(records, {v: p[v] for v in AUDIT_SHEETS[sheet]}, scope, ("url", "final_url", "status_code", "title", "canonical"))
    return found.withColumnRenamed("label", "issue").drop("value")


def audit_sheets(records: DataFrame, scope: list[str] = audit.SCOPE) -> dict[str, DataFrame]:
    """Summary and all sheets of the audit workbook."""
    return {"Summary": audit.summary(records, scope=scope)} | {n: audit_sheet(records, n, scope) for n in AUDIT_SHEETS}


def write_filtered_xlsx(path: str, records: DataFrame, query: GridQuery, scope: list[str] = audit.SCOPE) -> None:
    write_workbook(path, {"Rows": filtered(records, query, scope)})


# ---------------------------------------------------------------- sitemap


def sitemap_lines(records: DataFrame) -> DataFrame:
    """(final_url, value): an escaped sitemap entry of each eligible final address, once each."""
    urls = records.where(gates.sitemap_eligible()).select("final_url").distinct()
    text = F.col("final_url")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return urls.select("final_url", F.concat(F.lit("<url><loc>"), text, F.lit("</loc></url>")).alias("value"))


def write_sitemap(path: str, records: DataFrame) -> int:
    """A sitemap file of at most 50,000 addresses, the format's limit; more need `write_sitemaps`. Returns their number."""
    lines = [r["value"] for r in sitemap_lines(records).orderBy("final_url").limit(SITEMAP_URLS + 1).collect()]
    n = len(lines)
    if n > SITEMAP_URLS:
        raise ValueError(f"over {SITEMAP_URLS} addresses, which a sitemap does not hold")

    def write(part: str) -> None:
        with open(part, "w", encoding="utf-8") as f:
            f.write('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n' + "".join(f"{x}\n" for x in lines) + "</urlset>\n")

    published(path, write)
    return n


def write_sitemaps(folder: str, records: DataFrame) -> None:
    """Any number of addresses, as entry lines in parts of at most 50,000, written by the executors."""
    sitemap_lines(records).select("value").write.mode("overwrite").option("maxRecordsPerFile", SITEMAP_URLS).text(folder)


# ---------------------------------------------------------------- HTML summary

# The report's limits, its sections, and what it says of a record; braces as in the rules.
LARGE_PAGE_BYTES, SLOW_TTFB_MS, SLOW_RESPONSE_MS = 1_000_000, 800, 3_000
BROKEN_LINKS = "Broken Links"
SECTIONS = (
    "Broken URLs", "Titles And Meta Descriptions", "Headings And Canonicals", "Image Issues", "Performance Signals", "Security And Protocol", "Structured Data And Hreflang", "HTML Validation", "Rendered DOM Differences",
)
SECTION_ISSUES = [
    ("Broken URLs", "broken", "{status_label}"),
    ("Titles And Meta Descriptions", "TitleMultiple", "Multiple titles ({title_count} tags)"),
    ("Titles And Meta Descriptions", "MetaMultiple", "Multiple meta descriptions ({meta_description_count} tags)"),
    ("Titles And Meta Descriptions", "TitleMissing", "Missing title"),
    ("Titles And Meta Descriptions", "title under", "Title under {title_min_chars} chars"),
    ("Titles And Meta Descriptions", "title over", "Title over {title_max_chars} chars"),
    ("Titles And Meta Descriptions", "title twice", "Duplicate title"),
    ("Titles And Meta Descriptions", "MetaMissing", "Missing meta description"),
    ("Titles And Meta Descriptions", "meta under", "Meta description under {meta_min_chars} chars"),
    ("Titles And Meta Descriptions", "meta over", "Meta description over {meta_max_chars} chars"),
    ("Titles And Meta Descriptions", "meta twice", "Duplicate meta description"),
    ("Titles And Meta Descriptions", "title is h1", "Title same as H1"),
    ("Headings And Canonicals", "H1Missing", "Missing H1"),
    ("Headings And Canonicals", "several h1", "Multiple H1 tags"),
    ("Headings And Canonicals", "h1 over", "H1 over {h1_max_chars} chars"),
    ("Headings And Canonicals", "h1 twice", "Duplicate H1"),
    ("Headings And Canonicals", "CanonicalMissing", "Missing canonical"),
    ("Headings And Canonicals", "CanonicalMultiple", "Multiple canonical tags"),
    ("Headings And Canonicals", "canonical away", "Canonical points away from indexable URL"),
    ("Image Issues", "ImagesMissingAlt", "{images_missing_alt} images missing alt"),
    ("Image Issues", "ImagesAltTooLong", "{images_alt_too_long} image alt values too long"),
    ("Image Issues", "large image", "Image asset response over {large_image}"),
    ("Performance Signals", "large page", "Response over {large_page}"),
    ("Performance Signals", "slow first byte", "TTFB over {slow_ttfb}"),
    ("Performance Signals", "slow response", "Response over {slow_response}"),
    ("Security And Protocol", "plain http", "HTTP URL"),
    ("Security And Protocol", "SecurityMixedContent", "{mixed_content_count} mixed-content references"),
    ("Security And Protocol", "SecurityInsecureForms", "{insecure_form_count} insecure forms"),
    ("Security And Protocol", "SecurityMissingHsts", "Missing HSTS"),
    ("Security And Protocol", "SecurityMissingCsp", "Missing CSP"),
    ("Security And Protocol", "SecurityMissingXFrameOptions", "Missing X-Frame-Options"),
    ("Security And Protocol", "SecurityMissingContentTypeOptions", "Missing X-Content-Type-Options"),
    ("Security And Protocol", "MobileMissingViewport", "Missing viewport"),
    ("Structured Data And Hreflang", "invalid json", "{json_ld_invalid_count} invalid JSON-LD blocks"),
    ("Structured Data And Hreflang", "data errors", "{structured_data_error_count} structured data errors"),
    ("Structured Data And Hreflang", "StructuredDataWarning", "{structured_data_warning_count} structured data warnings"),
    ("Structured Data And Hreflang", "data issues", "{first_data_issues}"),
    ("Structured Data And Hreflang", "HreflangInvalid", "{hreflang_invalid_count} invalid hreflang tags"),
    ("Structured Data And Hreflang", "HreflangMissingSelfReference", "Missing hreflang self-reference"),
    ("HTML Validation", "HtmlDeprecatedTags", "{deprecated_html_tag_count} deprecated HTML tag instances"),
    ("HTML Validation", "HtmlDuplicateIds", "{duplicate_id_count} duplicate id instances"),
    ("Rendered DOM Differences", "RenderedDomChanged", "{rendered_word_count_delta} words, {rendered_link_count_delta} links"),
]


def _section_conditions(t: audit.Thresholds) -> dict[str, tuple[Column, str | None]]:
    """What the sections ask beside the views, by the names of SECTION_ISSUES."""
    ok, html, col, sure = gates.success(), gates.success_html(), F.col, gates.sure
    own = {
        "broken": gates.broken(), "title under": html & ~T.blank("title") & sure(col("title_len") < t.title_min_chars), "title over": html & ~T.blank("title") & sure(col("title_len") > t.title_max_chars),
        "meta under": html & ~T.blank("meta_description") & sure(col("meta_description_len") < t.meta_min_chars), "meta over": html & ~T.blank("meta_description") & sure(col("meta_description_len") > t.meta_max_chars),
        "title is h1": html & ~T.blank("title") & sure(T.ascii_text_key("h1") == T.ascii_text_key("title")), "several h1": html & ~T.blank("h1") & sure(col("h1_count") > 1), "h1 over": html & ~T.blank("h1") & sure(col("h1_len") > t.h1_max_chars),
        "canonical away": html & sure((col("indexability") == "Indexable") & (col("canonical") != col("final_url"))),
        "large image": ok & sure(F.startswith(F.lower("content_type"), F.lit("image/")) & (col("size_bytes") > t.large_image_bytes)), "large page": sure(col("size_bytes") > LARGE_PAGE_BYTES),
        "slow first byte": sure(col("ttfb_ms") > SLOW_TTFB_MS), "slow response": sure(col("response_time_ms") > SLOW_RESPONSE_MS), "plain http": sure(F.startswith("final_url", F.lit("http://"))),
        "invalid json": html & sure(col("json_ld_invalid_count") > 0), "data errors": html & sure(col("structured_data_error_count") > 0), "data issues": html & sure(F.size("structured_data_issues") > 0),
    }
    twice = {"title twice": "ascii_title", "meta twice": "ascii_meta_description", "h1 twice": "ascii_h1"}
    return {n: (c, None) for n, c in own.items()} | {n: (html, flag) for n, flag in twice.items()}


def report_rows(records: DataFrame, thresholds: audit.Thresholds = audit.Thresholds(), scope: list[str] = audit.SCOPE) -> DataFrame:
    """(scope, section, id, final_url, status_code, title, issues): a row per section and record it lists, with all that the
    section says of the record in the report's order, joined by "; ".
    """
    p, own = audit.predicates(thresholds), _section_conditions(thresholds)
    first = F.transform(F.slice("structured_data_issues", 1, 5), lambda i: F.concat(i["severity"], F.lit(": "), i["message"], F.lit(" ("), i["path"], F.lit(")")))
    limits = {"large_image": T.format_bytes(F.lit(thresholds.large_image_bytes)), "large_page": T.format_bytes(F.lit(LARGE_PAGE_BYTES)), "slow_ttfb": T.format_ms(F.lit(SLOW_TTFB_MS)), "slow_response": T.format_ms(F.lit(SLOW_RESPONSE_MS))}
    derived = limits | {"first_data_issues": F.array_join(first, "; "), "status_label": T.status_label("status_code", "status_text")}
    names = [f"{i:02d}" for i in range(len(SECTION_ISSUES))]
    wanted = {n: own.get(c) or p[c] for n, (_, c, _) in zip(names, SECTION_ISSUES)}
    found = audit.hits(records, wanted, scope, ("final_url", "status_code", "title"), {n: audit.message(m, derived, thresholds) for n, (_, _, m) in zip(names, SECTION_ISSUES)})
    section = F.create_map(*[F.lit(x) for n, (s, _, _) in zip(names, SECTION_ISSUES) for x in (n, s)])[F.col("label")]
    said = F.array_sort(F.collect_list(F.struct("label", "value")))  # as many as the report has things to say of a record
    return found.groupBy(*scope, section.alias("section"), "id", "final_url", "status_code", "title").agg(F.array_join(F.transform(said, lambda x: x["value"]), "; ").alias("issues"))


def report_sections(records: DataFrame, scope: list[str] = audit.SCOPE) -> DataFrame:
    """(section, records): exact counts of all sections from one pass; empty sections have 0."""
    rows = report_rows(records, scope=scope)
    counts = rows.agg(*[F.count_if(F.col("section") == n).alias(n) for n in SECTIONS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(f"`{n}`").alias("records")) for n in SECTIONS])).alias("x")).select("x.*")


def write_html_report(path: str, records: DataFrame, edges: DataFrame | None = None, title: str = "Audit report") -> None:
    """One HTML file: summary counters, and of each section the exact count and its first 50 records by id."""
    counters = audit.summary(records, scope=[]).first().asDict()
    found = checkpointed(report_rows(records, scope=[]))
    counts = {n: 0 for n in SECTIONS} | {r["section"]: r["n"] for r in found.groupBy("section").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [f"<h1>{html.escape(title)}</h1><table>", *[f"<tr><th>{html.escape(k)}</th><td>{v}</td></tr>" for k, v in counters.items()], "</table>"]
    rows = {n: found.where(F.col("section") == n).select("final_url", "issues", "title", "id").orderBy("id").limit(SECTION_ROWS).collect() for n in SECTIONS}
    if edges is not None:
        broken = checkpointed(links.edge_view(edges, "broken", records).select("id", F.col("target_url").alias("final_url"), F.coalesce(F.col("target_status_code").cast("string"), F.lit("Unknown or not crawled")).alias("issues"), F.col("anchor_text").alias("title")))
        counts[BROKEN_LINKS] = broken.count()
        rows[BROKEN_LINKS] = broken.orderBy("id").limit(SECTION_ROWS).collect()
    for name, found in rows.items():
        parts.append(f"<h2>{html.escape(name)} ({counts[name]})</h2><table>")
        parts += [f"<tr><td>{html.escape(r['final_url'] or '')}</td><td>{html.escape(r['issues'] or '')}</td><td>{html.escape(r['title'] or '')}</td></tr>" for r in found]
        parts.append("</table>")

    def write(part: str) -> None:
        with open(part, "w", encoding="utf-8") as f:
            f.write("<!doctype html><html><head><meta charset=\"utf-8\"></head><body>" + "\n".join(parts) + "</body></html>\n")

    published(path, write)


# ---------------------------------------------------------------- archive

COLLECTIONS = ("records", "linkEdges", "imageAssets", "pageReferences", "pageCaptures")
SCHEMA_VERSION = 1


def write_archive(folder: str, collections: dict[str, DataFrame]) -> None:
    """A folder with one JSON-lines part per collection and a manifest with the row counts; it appears whole or not at all."""
    unknown = set(collections) - set(COLLECTIONS)
    if unknown:
        raise ValueError(f"unknown collections {sorted(unknown)}")
    part = f"{folder}.{uuid.uuid4().hex}.part"
    try:
        counts = {}
        for name, df in collections.items():
            df.write.json(f"{part}/{name}")
            counts[name] = df.sparkSession.read.json(f"{part}/{name}", schema=df.schema).count()
        with open(f"{part}/manifest.json", "w", encoding="utf-8") as f:
            json.dump({"schemaVersion": SCHEMA_VERSION, "counts": counts, "schemas": {n: json.loads(d.schema.json()) for n, d in collections.items()}}, f)
        if os.path.exists(folder):
            shutil.rmtree(folder)
        os.replace(part, folder)
    finally:
        shutil.rmtree(part, ignore_errors=True)


def read_archive(spark, folder: str) -> dict[str, DataFrame]:
    """The collections of an archive; a wrong version, a missing part or another number of rows is refused."""
    with open(f"{folder}/manifest.json", encoding="utf-8") as f:
        manifest = json.load(f)
    if manifest.get("schemaVersion") != SCHEMA_VERSION:
        raise ValueError(f"archive version {manifest.get('schemaVersion')}")
    out = {}
    for name, n in manifest["counts"].items():
        df = spark.read.json(f"{folder}/{name}", schema=StructType.fromJson(manifest["schemas"][name]))
        if df.count() != n:
            raise ValueError(f"{name} has {df.count()} rows instead of {n}")
        out[name] = df
    return out
