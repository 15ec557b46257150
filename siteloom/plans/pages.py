"""Queries over captured markup, robots files, exports and streams, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import url as U
from siteloom.functions.html import DESCRIPTION_FONT, TITLE_FONT, WIDTHS

from siteloom.plans.audit import BLANK, BROKEN, CONDITIONS, HTML, OK, WHITE, R, crawl, dup, key, utrim
from siteloom.plans.reports import SITEMAP_SQL, edges, names, serial
from siteloom.operators import gates, graph
from siteloom.sinks import exports, files
from siteloom.sources import fetches, pages
from siteloom.sources.tables import once, table
from siteloom.streaming import ingest


def captures(spark, d, *more):
    """Captures once each; markup is the raw one, else the rendered one, else empty."""
    rows = once(table(spark, d, "page_captures", "capture_id", "source_url", "raw_html", "rendered_html", *more), "capture_id")
    return rows.withColumn("raw_html", F.coalesce("raw_html", "rendered_html", F.lit("")))


def signals(spark, d):
    return pages.page_signals(captures(spark, d), "capture_id", "source_url", "raw_html")


def _tested(spark, d):
    """Every robots text of the documents, a file of its own, tested with all addresses of the crawls."""
    docs = once(table(spark, d, "documents", "doc_id", "text", "doc_kind").where("doc_kind = 'robots_txt' and text is not null"), "doc_id")
    urls = crawl(spark, d).select(F.col("final_url").alias("url")).distinct()
    return pages.robots_batches(docs.select(F.col("doc_id").alias("id"), "text"), urls, "larkcrawler/2.1")


def _streamed(spark, name: str, rows, order: str, start):
    """The table that a stream of `rows` has left when it is through: four batches that arrive in the order of `order`."""
    base = ingest.working_folder(spark, name)
    bounds = rows.agg(F.percentile_approx(order, [0.25, 0.5, 0.75], 1000)).first()[0] or []
    batch = F.lit(0)
    for b in bounds:
        batch = batch + F.when(F.col(order) > F.lit(b), 1).otherwise(0)
    for i in range(len(bounds) + 1):
        rows.where(batch == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    start(ingest.read_stream(spark, f"{base}/in", rows), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return f"{base}/table"


def _upserts(spark, d):
    rows = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    folder = _streamed(spark, "upserts", rows, "event_id", lambda s, t, c: ingest.upsert_stream(s, t, c, "user_id", "event_id"))
    return ingest.Buckets(spark, folder, "user_id").read().select("user_id", "event_id", "event_type", "value")


def _stream_summary(spark, d):
    rows = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    flags = {"all": F.lit(True), "large": F.col("value") > 50, "purchases": F.col("event_type") == "purchase"}
    folder = _streamed(spark, "summary", rows, "event_id", lambda s, t, c: ingest.summary_stream(s, t, c, "user_id", "event_id", flags))
    return spark.createDataFrame(list(ingest.Buckets(spark, folder, "user_id").counts().items()), "counter string, value bigint")


def _stream_inlinks(spark, d):
    rows = table(spark, d, "link_edges", "id", "target_url")
    folder = _streamed(spark, "inlinks", rows, "id", lambda s, t, c: ingest.count_stream(s, t, c, "target_url", "id"))
    return ingest.Buckets(spark, folder, "target_url").read().select("target_url", "count")


def _stream_windows(spark, d):
    rows = table(spark, d, "events", "event_id", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _streamed(spark, "windows", rows, "ts", lambda s, t, c: ingest.window_stream(s, t, c))
    return ingest.Buckets(spark, folder, "window").read().select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "events")


def _stream_references(spark, d):
    rows = table(spark, d, "page_references", "id", "source_storage_key", "target_url", "kind")
    folder = _streamed(spark, "references", rows, "id", lambda s, t, c: ingest.replace_stream(s, t, c, "source_storage_key"))
    return ingest.Buckets(spark, folder, "source_storage_key").read().groupBy("kind").agg(F.count_distinct("source_storage_key").alias("sources"))


def _directed(spark, d):
    """Records with directives of every form beside those they have."""
    forms = F.array(*[F.lit(x) for x in ("", "max-image-preview: none", "googlebot: noindex, nofollow", "NONE", "index; noindex", "max-snippet: -1 , follow")])
    return crawl(spark, d).withColumn("x_robots_tag", F.concat(F.coalesce("x_robots_tag", F.lit("")), F.element_at(forms, (F.pmod("id", F.lit(6)) + 1).cast("int"))))


def _fetches(spark, d):
    """Fetches as captures and records tell of them: responses with their bodies, errors, and barred addresses."""
    head = {"headers": pages.headers(), "body": F.col("raw_html"), "error": F.lit(None).cast("string"), "blocked": F.lit(False), "depth": F.lit(0), "response_time_ms": F.lit(0), "status_code": F.lit(200), "root_url": F.col("source_url"), "url": F.col("source_url")}
    seen = once(table(spark, d, "page_captures"), "capture_id").select(F.lit("response").alias("kind"), "final_url", *[c.alias(n) for n, c in head.items()])
    none = F.lit(None).cast("map<string,string>")
    lost = crawl(spark, d).where("status_code is null").select("url", "final_url", "error").distinct().select(
        F.lit("none").alias("kind"), "final_url", none.alias("headers"), F.lit(None).cast("string").alias("body"), F.coalesce("error", F.lit("unknown")).alias("error"), (F.coalesce("error", F.lit("")) == gates.ROBOTS).alias("blocked"),
        F.lit(0).alias("depth"), F.lit(0).alias("response_time_ms"), F.lit(None).cast("int").alias("status_code"), F.col("url").alias("root_url"), "url",
    )
    return seen.unionByName(lost)


def pixel_width(c, font: float):
    """The estimated width of a text line from counts of its glyph groups, on the JVM; close to the exact one."""
    rest, total = F.coalesce(F.col(c), F.lit("")), F.lit(0.0)
    text = rest
    for chars, width in WIDTHS:
        without = F.translate(rest, chars, "")
        total = total + (F.char_length(rest) - F.char_length(without)) * F.lit(width * font)
        rest = without
    ascii_left = F.regexp_replace(rest, r"[^\x00-\x7F]", "")
    total = total + F.char_length(ascii_left) * F.lit(0.56 * font) + (F.char_length(rest) - F.char_length(ascii_left)) * F.lit(1.0 * font)
    return F.when(text.isNotNull(), F.floor(total + 0.5)).cast("bigint")


QUERIES = {
    "page_titles": lambda spark, d: signals(spark, d).select("capture_id", "title", "h1", "h1_count", "canonical", "html_doctype"),
    "page_signals_full": lambda spark, d: signals(spark, d).select("capture_id", "title_count", "h2_count", "h2", "meta_robots", "canonical_count", "meta_description_count", "viewport", "image_count", "json_ld_count", "hreflang_count", "open_graph_count", "insecure_form_count", "html_doctype"),
    "page_references_of_markup": lambda spark, d: pages.exploded(signals(spark, d), "capture_id", "references").groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "page_words": lambda spark, d: once(table(spark, d, "page_captures", "capture_id", "visible_text"), "capture_id").where("visible_text is not null").select("capture_id", F.size(F.filter(F.split("visible_text", r"(?U)\s+"), lambda w: w != "")).alias("words"), F.octet_length("visible_text").alias("bytes")),
    "page_headers": lambda spark, d: once(table(spark, d, "page_captures", "capture_id", "response_headers"), "capture_id").select("capture_id", pages.headers().alias("_h")).select("capture_id", F.col("_h")["content-type"].alias("content_type"), F.col("_h")["cache-control"].alias("cache_control"), F.col("_h")["server"].alias("server")),
    "custom_extract_css": lambda spark, d: pages.custom_values(captures(spark, d), "capture_id", "raw_html", [{"name": "headings", "kind": "css", "pattern": "h1, h2"}, {"name": "robots", "kind": "cssAttribute", "pattern": "meta[name=robots]", "attribute": "content"}]).select("capture_id", F.size(F.col("custom_extractions")[0]["values"]).alias("headings"), F.array_join(F.col("custom_extractions")[1]["values"], "|").alias("robots")),
    "custom_extract_regex": lambda spark, d: captures(spark, d).select("capture_id", F.explode(F.regexp_extract_all("raw_html", F.lit(r'"v":([0-9]+)'), F.lit(1))).alias("value")),
    "custom_search": lambda spark, d: pages.custom_searches(captures(spark, d), "capture_id", "raw_html", [{"name": "cookies", "pattern": "cookie"}]).select("capture_id", F.col("custom_searches")[0]["match_count"].alias("matches")),
    "robots_batch": lambda spark, d: _tested(spark, d).groupBy("verdict").agg(F.sum("n").alias("n")),
    "normalise_urls": lambda spark, d: table(spark, d, "link_edges", "target_url").where("target_url is not null").distinct().select("target_url", U.normalised_query("target_url", drop=["utm_.*"]).alias("normalised"), U.folder_depth("target_url").alias("folder_depth"), U.resource_class("target_url").alias("kind")),
    "url_aliases": lambda spark, d: U.with_aliases(table(spark, d, "link_edges", "target_url").where("target_url is not null").distinct(), ["target_url"]),
    "scope_filter": lambda spark, d: crawl(spark, d).select("final_url").distinct().where(U.in_scope("final_url", "https://www.istnequogate.example/", subdomains=True, exclude=["/tag/"])).select("final_url"),
    "text_keys": lambda spark, d: crawl(spark, d).select("crawl_id", "id", T.text_key("title").alias("title_key"), T.trimmed("h1").alias("h1_trimmed"), T.clamped("title", 20).alias("clamped"), T.transfer_rate("size_bytes", "response_time_ms").alias("rate"), T.status_label("status_code", "status_text").alias("label")).distinct(),
    "pixel_widths": lambda spark, d: crawl(spark, d).where("title is not null").select("id", pixel_width("title", TITLE_FONT).alias("title_pixels"), pixel_width("h1", DESCRIPTION_FONT).alias("h1_pixels")).distinct(),
    "sitemap_export": lambda spark, d: files.sitemap_lines(crawl(spark, d)),
    "report_sections": lambda spark, d: files.report_sections(crawl(spark, d)),
    "workbook_titles": lambda spark, d: files.audit_sheet(crawl(spark, d), "Titles").groupBy("crawl_id", "issue").agg(F.count(F.lit(1)).alias("n")),
    "csv_guard": lambda spark, d: edges(spark, d).select("id", files.guarded(F.col("anchor_text")).alias("anchor_text")).distinct(),
    "indexability": lambda spark, d: pages.with_indexability(_directed(spark, d)).select("crawl_id", "id", "indexability", "indexability_status").distinct(),
    "xpath_values": lambda spark, d: pages.custom_values(captures(spark, d), "capture_id", "raw_html", [{"name": "headings", "kind": "xpath", "pattern": "//h1 | //h2"}, {"name": "links", "kind": "xpath", "pattern": "//link[@rel='canonical']/@href"}]).select("capture_id", F.size(F.col("custom_extractions")[0]["values"]).alias("headings"), F.size(F.col("custom_extractions")[1]["values"]).alias("canonicals")),
    "fetch_records": lambda spark, d: fetches.fetch_records(_fetches(spark, d), ("kind",)).select("kind", "storage_key", "status_code", "status_text", "content_type", "indexability", "indexability_status", "size_bytes", "response_hash", "error"),
    "export_records": lambda spark, d: exports.record_rows(crawl(spark, d)).select("id", "classification", "status_code", "text_to_code_ratio", "title", "in_sitemap", "custom_extractions", "near_duplicate_cluster_id", "backlinks", "html_doctype"),
    "export_links": lambda spark, d: exports.link_rows(edges(spark, d)),
    "export_sitemap": lambda spark, d: exports.sitemap_rows(crawl(spark, d)),
    "export_nodes": lambda spark, d: exports.node_rows(graph.graph_nodes(crawl(spark, d), ["crawl_id"])).groupBy("classification", "status_code", "crawled").agg(F.count(F.lit(1)).alias("n")),
    "registrable_domains": lambda spark, d: crawl(spark, d).select("final_url").distinct().select("final_url", U.registrable_domain("final_url").alias("domain"), U.on_cdn("final_url", ["https://blog.istnequogate.example/guide"]).alias("cdn"), U.may_crawl("final_url", "https://www.istnequogate.example/", {"html": True, "other": False}, scope="domain").alias("may_crawl")),
    "stream_upserts": _upserts,
    "stream_summary": _stream_summary,
    "stream_inlinks": _stream_inlinks,
    "stream_windows": _stream_windows,
    "stream_references": _stream_references,
}

_CAPS = "(SELECT DISTINCT capture_id, source_url, coalesce(raw_html, rendered_html, '') AS raw_html FROM page_captures WHERE capture_id IS NOT NULL)"
_LAST = "(SELECT user_id, max(event_id) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY 1)"
_T = "target_url"
_QUERY = f"regexp_extract(regexp_replace({_T}, '#.*$', ''), '\\?(.*)$', 1)"
_PARTS = f"list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT regexp_full_match(split_part(p, '=', 1), 'utm_.*')))"
_BASE = f"regexp_extract(regexp_replace({_T}, '#.*$', ''), '^([^?]*)', 1)"
_FOLDERS = f"len(list_filter(string_split(regexp_extract({_T}, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))"
_PATH = f"regexp_extract({_T}, '^https?://[^/?#]*([^?#]*)', 1)"
_ENDING = f"lower(regexp_extract({_PATH}, '\\.([A-Za-z0-9]+)$', 1))"
_KINDS = " ".join(f"WHEN {_ENDING} IN ({', '.join(repr(e) for e in endings)}) THEN '{kind}'" for kind, endings in U.RESOURCE_CLASSES.items())
_TITLE_KEY, _H1_KEY = (f"translate(trim(regexp_replace(coalesce({c}, ''), '{WHITE}+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" for c in ("title", "h1"))
#: Descriptions, headers, viewports and images are no columns of the tables: their lack is a finding, their values give none.
_SECTION = {
    "Broken URLs": BROKEN, "Titles And Meta Descriptions": HTML,
    "Headings And Canonicals": f"{HTML} AND ({BLANK['h1']} OR h1_count > 1 OR h1_len > 70 OR {dup(_H1_KEY, f'{_H1_KEY} <> {repr(str())}')} OR {BLANK['canonical']} OR canonical_count > 1 OR coalesce(indexability = 'Indexable' AND canonical <> final_url, false))",
    "Image Issues": f"coalesce({OK} AND lower(content_type) LIKE 'image/%' AND size_bytes > 204800, false)", "Performance Signals": "coalesce(size_bytes > 1000000, false) OR coalesce(ttfb_ms > 800, false) OR coalesce(response_time_ms > 3000, false)",
    "Security And Protocol": f"starts_with(final_url, 'http://') OR coalesce({OK}, false)", "Structured Data And Hreflang": "false", "HTML Validation": "false", "Rendered DOM Differences": "false",
}
_XML = "replace(replace(replace(replace(replace(final_url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


def _title_issue(name: str, condition: str) -> str:
    return f"SELECT crawl_id, '{name}' AS issue, count(*) AS n FROM {R} WHERE {condition} GROUP BY 1"





def _pixels(c: str, font: float) -> str:
    """The estimated width in SQL, group by group as `pixel_width` counts it."""
    rest, parts = f"coalesce({c}, '')", []
    for chars, width in WIDTHS:
        quoted = chars.replace("'", "''")
        without = f"translate({rest}, '{quoted}', '')"
        parts.append(f"(length({rest}) - length({without})) * {width * font!r}::DOUBLE")
        rest = without
    kept = f"regexp_replace({rest}, '[^\\x00-\\x7F]', '', 'g')"
    parts += [f"length({kept}) * {0.56 * font!r}::DOUBLE", f"(length({rest}) - length({kept})) * {font!r}::DOUBLE"]
    return f"CAST(floor({' + '.join(parts)} + 0.5) AS BIGINT)"



def _unescaped(c: str) -> str:
    for a, b in (("&#x27;", "''''"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&amp;", "'&'")):
        c = f"replace({c}, '{a}', {b})"
    return c


_H2 = _unescaped("regexp_extract(raw_html, '<h2>([^<]*)', 1)")
_FORMS = "['', 'max-image-preview: none', 'googlebot: noindex, nofollow', 'NONE', 'index; noindex', 'max-snippet: -1 , follow']"
_BARS = "len(list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce({}, '')), ':\\s+', ':', 'g'), '[,;]', ' ', 'g'), ' '), lambda x: trim(x) IN ('noindex', 'none'))) > 0"
_STATUS = f"CASE WHEN {_BARS.format('x')} THEN 'X-Robots-Tag noindex' WHEN {_BARS.format('meta_robots')} THEN 'Meta robots noindex' WHEN canonical IS NOT NULL AND coalesce(regexp_replace({serial('canonical')}, '#.*$', ''), canonical) <> coalesce(regexp_replace({serial('final_url')}, '#.*$', ''), final_url) THEN 'Canonicalized' ELSE 'Indexable' END"
_INDEXABILITY = f"CASE WHEN ok THEN CASE WHEN s = 'Indexable' THEN s ELSE 'Non-indexable' END ELSE indexability END AS indexability, CASE WHEN ok THEN s ELSE indexability_status END AS indexability_status FROM (SELECT *, coalesce({OK}, false) AS ok, {_STATUS} AS s FROM (SELECT *, coalesce(x_robots_tag, '') || {_FORMS}[id % 6 + 1] AS x FROM {R}))"
SQL = {
    "pixel_widths": f"SELECT id, {_pixels('title', TITLE_FONT)} AS title_pixels, {_pixels('h1', DESCRIPTION_FONT)} AS h1_pixels FROM {R} WHERE title IS NOT NULL",
    "url_aliases": f"SELECT target_url, unnest({names('target_url')}) AS alias FROM (SELECT DISTINCT target_url FROM link_edges WHERE target_url IS NOT NULL)",
    "page_references_of_markup": f"SELECT 'canonical' AS kind, count(*) AS n FROM {_CAPS} WHERE regexp_matches(raw_html, '<link rel=\"canonical\" href=\"[^\"#]')",
    "page_titles": f"SELECT capture_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_extract(raw_html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title, nullif(trim(replace(replace(replace(replace(replace(regexp_extract(raw_html, '<h1>([^<]*)', 1), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')), '') AS h1, len(regexp_extract_all(raw_html, '<h1>')) AS h1_count, nullif(replace(regexp_extract(raw_html, '<link rel=\"canonical\" href=\"([^\"#]*)', 1), '&amp;', '&'), '') AS canonical, starts_with(lower(raw_html), '<!doctype html') AS html_doctype FROM {_CAPS}",
    "page_words": "SELECT capture_id, len(list_filter(regexp_split_to_array(visible_text, '[\\t\\n\\x0B\\f\\r \\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '')) AS words, strlen(visible_text) AS bytes FROM (SELECT DISTINCT capture_id, visible_text FROM page_captures WHERE capture_id IS NOT NULL AND visible_text IS NOT NULL)",
    "page_headers": "SELECT capture_id, " + ", ".join(f"nullif(regexp_extract(response_headers, '(?m)^{n}: ([^\\r\\n]*)', 1), '') AS {a}" for n, a in (("content-type", "content_type"), ("cache-control", "cache_control"), ("server", "server"))) + " FROM (SELECT DISTINCT capture_id, response_headers FROM page_captures WHERE capture_id IS NOT NULL)",
    "custom_extract_css": f"SELECT capture_id, len(list_filter(regexp_extract_all(raw_html, '<h[12]>([^<]*)', 1), lambda x: trim(x) <> '')) AS headings, array_to_string(regexp_extract_all(raw_html, '<meta name=\"robots\" content=\"([^\"]+)\"', 1), '|') AS robots FROM {_CAPS}",
    "page_signals_full": f"SELECT capture_id, len(regexp_extract_all(raw_html, '<title>')) AS title_count, len(regexp_extract_all(raw_html, '<h2>')) AS h2_count, nullif(trim({_H2}), '') AS h2, nullif(regexp_extract(raw_html, '<meta name=\"robots\" content=\"([^\"]*)', 1), '') AS meta_robots, len(regexp_extract_all(raw_html, '<link rel=\"canonical\"')) AS canonical_count, len(regexp_extract_all(raw_html, '<meta name=\"description\"')) AS meta_description_count, regexp_matches(raw_html, '<meta name=\"viewport\"') AS viewport, len(regexp_extract_all(raw_html, '<img')) AS image_count, len(regexp_extract_all(raw_html, 'application/ld.json')) AS json_ld_count, len(regexp_extract_all(raw_html, 'hreflang=')) AS hreflang_count, len(regexp_extract_all(raw_html, 'property=\"og:')) AS open_graph_count, len(regexp_extract_all(raw_html, '<form')) AS insecure_form_count, starts_with(lower(raw_html), '<!doctype html') AS html_doctype FROM {_CAPS}",
    "custom_extract_regex": f"SELECT capture_id, unnest(regexp_extract_all(raw_html, '\"v\":([0-9]+)', 1)) AS value FROM {_CAPS}",
    "custom_search": f"SELECT capture_id, len(regexp_extract_all(lower(raw_html), 'cookie')) AS matches FROM {_CAPS}",
    "normalise_urls": f"SELECT target_url, {_BASE} || CASE WHEN len({_PARTS}) > 0 THEN '?' || array_to_string({_PARTS}, '&') ELSE '' END AS normalised, CASE WHEN {_PATH} = '' OR {_PATH} LIKE '%/' THEN {_FOLDERS} ELSE greatest({_FOLDERS} - 1, 0) END AS folder_depth, CASE WHEN {_ENDING} = '' THEN 'html' {_KINDS} ELSE 'other' END AS kind FROM (SELECT DISTINCT target_url FROM link_edges WHERE target_url IS NOT NULL)",
    "scope_filter": "SELECT DISTINCT final_url FROM crawl_records WHERE id IS NOT NULL AND (regexp_extract(final_url, '^https?://([^/?#:]*)', 1) = 'istnequogate.example' OR regexp_extract(final_url, '^https?://([^/?#:]*)', 1) LIKE '%.istnequogate.example') AND NOT regexp_matches(final_url, '/tag/')",
    "text_keys": f"SELECT crawl_id, id, CASE WHEN title IS NOT NULL THEN {key('title')} END AS title_key, CASE WHEN h1 IS NOT NULL THEN {utrim('h1')} END AS h1_trimmed, CASE WHEN length(title) > 20 THEN left(title, 17) || '...' ELSE title END AS clamped, CAST(floor(size_bytes * 1000 / nullif(response_time_ms, 0)) AS BIGINT) AS rate, CASE WHEN status_code IS NULL THEN 'No response' ELSE trim(status_code || ' ' || {utrim('status_text')}) END AS label FROM {R}",
    "sitemap_export": f"SELECT DISTINCT final_url, '<url><loc>' || {_XML} || '</loc></url>' AS value FROM {R} WHERE {OK} AND indexability = 'Indexable' AND error IS NULL AND starts_with(final_url, 'http')",
    "report_sections": " UNION ALL ".join(f"SELECT '{n}' AS section, count(*) FILTER (WHERE {c}) AS records FROM {R}" for n, c in _SECTION.items()),
    "workbook_titles": " UNION ALL ".join(_title_issue(n, CONDITIONS[n]) for n in ("TitleMissing", "TitleDuplicate", "TitleTooShort", "TitleTooLong", "TitlePixelTooNarrow", "TitleSameAsH1")),
    "csv_guard": "SELECT id, CASE WHEN regexp_matches(anchor_text, '^\\s*[=+@-]|^[\\t\\r\\n]') THEN '''' || anchor_text ELSE anchor_text END AS anchor_text FROM (SELECT DISTINCT * FROM link_edges WHERE id IS NOT NULL)",
    "indexability": f"SELECT crawl_id, id, {_INDEXABILITY}",
    "xpath_values": f"SELECT capture_id, len(regexp_extract_all(raw_html, '<h[12]>')) AS headings, len(regexp_extract_all(raw_html, '<link rel=\"canonical\" href=\"[^\"]')) AS canonicals FROM {_CAPS}",
    "fetch_records": f"SELECT 'response' AS kind, final_url AS storage_key, 200 AS status_code, 'OK' AS status_text, nullif(trim(regexp_extract(response_headers, '(?m)^content-type: ([^\\r\\n]*)', 1)), '') AS content_type, 'Indexable' AS indexability, 'Indexable' AS indexability_status, CAST(coalesce(strlen(raw_html), 0) AS BIGINT) AS size_bytes, CASE WHEN strlen(raw_html) > 0 THEN sha256(raw_html) END AS response_hash, NULL AS error FROM (SELECT DISTINCT capture_id, final_url, response_headers, raw_html FROM page_captures WHERE capture_id IS NOT NULL) UNION ALL SELECT 'none', final_url, NULL, CASE WHEN error = 'Blocked by robots.txt' THEN error ELSE 'No response' END, NULL, 'Non-indexable', CASE WHEN error = 'Blocked by robots.txt' THEN error ELSE 'No response' END, 0, NULL, coalesce(error, 'unknown') FROM (SELECT DISTINCT url, final_url, error FROM crawl_records WHERE id IS NOT NULL AND status_code IS NULL)",
    "export_records": f"SELECT CAST(id AS VARCHAR) AS id, upper(classification[1]) || classification[2:] AS classification, coalesce(CAST(status_code AS VARCHAR), '') AS status_code, printf('%.4f', text_to_code_ratio) AS text_to_code_ratio, coalesce(title, '') AS title, CAST(in_sitemap AS VARCHAR) AS in_sitemap, '[]' AS custom_extractions, coalesce(CAST(near_duplicate_cluster_id AS VARCHAR), '') AS near_duplicate_cluster_id, '' AS backlinks, '' AS html_doctype FROM {R}",
    "export_links": "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in exports.LINK_COLUMNS) + " FROM (SELECT DISTINCT * FROM link_edges WHERE id IS NOT NULL)",
    "export_sitemap": "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in exports.SITEMAP_COLUMNS[:9]) + f", upper(severity[1]) || severity[2:] AS severity, issues FROM ({SITEMAP_SQL})",
    "export_nodes": f"SELECT upper(classification[1]) || classification[2:] AS classification, coalesce(CAST(status_code AS VARCHAR), '') AS status_code, 'true' AS crawled, count(*) AS n FROM (SELECT arg_max_null(classification, (coalesce(list_position, id), id)) AS classification, arg_max_null(status_code, (coalesce(list_position, id), id)) AS status_code FROM {R} GROUP BY crawl_id, final_url) GROUP BY 1, 2",
    "registrable_domains": f"SELECT final_url, domain, regexp_matches(final_url, '^https?://blog.istnequogate.example(:[0-9]+)?/guide') AS cdn, coalesce(domain = 'istnequogate.example', false) AND regexp_matches(regexp_extract(final_url, '^https?://[^/?#]*([^?#]*)', 1), '(^|/)[^./]*$|\\.(html|htm|php|asp|aspx|jsp|cfm)$') AS may_crawl FROM (SELECT DISTINCT final_url, regexp_extract(regexp_extract(lower(final_url), '^https?://([^/?#:]*)', 1), '([^.]+\\.[^.]+)$', 1) AS domain FROM crawl_records WHERE id IS NOT NULL)",
    "stream_upserts": f"SELECT e.user_id, e.event_id, e.event_type, e.value FROM events e JOIN {_LAST} l USING (user_id, event_id)",
    "stream_summary": f"SELECT unnest(['all', 'large', 'purchases']) AS counter, unnest([count(*), count(*) FILTER (WHERE value > 50), count(*) FILTER (WHERE event_type = 'purchase')]) AS value FROM events JOIN {_LAST} l USING (user_id, event_id)",
    "stream_inlinks": "SELECT target_url, count(*) AS count FROM (SELECT DISTINCT * FROM link_edges WHERE id IS NOT NULL) WHERE target_url IS NOT NULL GROUP BY 1",
    "stream_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
