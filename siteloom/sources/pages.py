"""From captured responses to records, links, images and references; robots.txt and sitemap documents."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import html as H
from siteloom.functions import url as U
from siteloom.session import checkpointed
from siteloom.sources.schema import RECORD

_LISTS = {
    "images": "array<struct<image_url:string,alt_text:string,alt_len:int,missing_alt:boolean,alt_too_long:boolean,width:int,height:int,source_position:int>>",
    "anchors": "array<struct<target_url:string,anchor_text:string,rel:string,rel_nofollow:boolean,source_position:int>>",
    "resources": "array<struct<target_url:string,link_type:string,source_position:int>>",
    "references": "array<struct<kind:string,target_url:string>>",
}
SIGNALS = [c for c in RECORD if c in H.signals("http://a/", "")]


def page_signals(pages: DataFrame, ident: str, url: str, markup: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(ident, url, signals, images, anchors, resources, references) of each page, one row per row.

    Null markup gives the signals of an empty document; rows without an absolute address are left out. The parser is the
    one step that leaves the JVM, in Arrow batches that carry only the address and the markup.
    """
    df = pages.select(F.col(ident), F.col(url).alias("_url"), F.col(markup).alias("_html")).where(F.col("_url").isNotNull())
    names = [*SIGNALS, *_LISTS]
    schema = f"`{ident}` {dict(pages.dtypes)[ident]}, url string, " + ", ".join(f"`{c}` {RECORD[c][0] if c in RECORD else _LISTS[c]}" for c in names)

    def run(batches):
        for batch in batches:
            out = []
            for i, u, h in zip(batch[ident], batch["_url"], batch["_html"]):
                if U.parse(u):
                    s = H.signals(u, h, include, exclude)
                    out.append((i, u, *[s[c] for c in names]))
            yield pd.DataFrame(out, columns=[ident, "url", *names])

    return df.mapInPandas(run, schema)


def exploded(signals: DataFrame, ident: str, what: str) -> DataFrame:
    """(ident, source_url, fields...) of one of the lists: images, anchors, resources or references."""
    return signals.select(F.col(ident), F.col("url").alias("source_url"), F.explode(what).alias("_x")).select(ident, "source_url", "_x.*")


def robots_directive(c, directive: str):
    """Whether a robots value holds a directive, as `functions.html.has_directive` has it."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.rlike(F.regexp_replace(c, H.PARAMETER, ":"), F.lit(H.directive_pattern(directive)))


def with_indexability(records: DataFrame) -> DataFrame:
    """indexability and indexability_status of successful pages: header noindex, then meta noindex, then a canonical that
    leads elsewhere. Other responses keep what they have.
    """
    noindex = lambda c: robots_directive(c, "noindex")
    ok = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    status = (
        F.when(noindex(F.col("x_robots_tag")), "X-Robots-Tag noindex").when(noindex(F.col("meta_robots")), "Meta robots noindex")
        .when(F.col("canonical").isNotNull() & (F.coalesce(U.plain_final_key("canonical"), F.col("canonical")) != F.coalesce(U.plain_final_key("final_url"), F.col("final_url"))), "Canonicalized").otherwise("Indexable")
    )
    return records.withColumn("_s", status).withColumns({"indexability": F.when(ok, F.when(F.col("_s") == "Indexable", "Indexable").otherwise("Non-indexable")).otherwise(F.col("indexability")), "indexability_status": F.when(ok, F.col("_s")).otherwise(F.col("indexability_status"))}).drop("_s")


def headers(c: str = "response_headers"):
    """Header lines as a map of lower-cased names; repeated names are joined by a comma and a space."""
    pairs = F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"\r?\n"), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"), F.contains(x, F.lit(":")).alias("ok"))), lambda p: p["ok"])
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), ", "))
    return F.map_from_arrays(names, values)


SENSITIVE = frozenset("authorization cookie proxy-authorization set-cookie x-api-key".split())


def redacted(c):
    """A header map with the values of sensitive names hidden."""
    return F.transform_values(c, lambda k, v: F.when(k.isin(*SENSITIVE), "[redacted]").otherwise(v))


def header_flags(c):
    """The security header columns of a header map."""
    names = {"hsts_header": "strict-transport-security", "content_security_policy_header": "content-security-policy", "x_frame_options_header": "x-frame-options", "x_content_type_options_header": "x-content-type-options"}
    return {k: F.map_contains_key(c, F.lit(v)) for k, v in names.items()}


def inferred_type(content_type: str, body: str):
    """The content type, or `text/html (inferred)` where none was sent and the body begins as HTML."""
    start = F.rlike(F.lower(F.substring(F.col(body), 1, 1024)), F.lit(r"^\s*(<!doctype html|<html)"))
    return F.when(F.col(content_type).isNull() & F.coalesce(start, F.lit(False)), "text/html (inferred)").otherwise(F.col(content_type))


def rendered_difference(raw: DataFrame, rendered: DataFrame, ident: str) -> DataFrame:
    """(ident, rendered_dom_changed, word and link deltas) of pages parsed before and after rendering."""
    fields = "title meta_description h1 h2 canonical meta_robots word_count image_count json_ld_count hreflang_count".split()
    r, d = raw.alias("r"), rendered.alias("d")
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f"r.{f}").eqNullSafe(F.col(f"d.{f}"))
    clamp = lambda c: F.least(F.greatest(c, F.lit(-(2**31))), F.lit(2**31 - 1)).cast("int")
    return r.join(d, F.col(f"r.{ident}") == F.col(f"d.{ident}")).select(F.col(f"r.{ident}"), changed.alias("rendered_dom_changed"), clamp(F.col("d.word_count") - F.col("r.word_count")).alias("rendered_word_count_delta"), clamp(F.size("d.anchors") - F.size("r.anchors")).alias("rendered_link_count_delta"))


# ---------------------------------------------------------------- robots.txt


class Robots:
    """The rules of a robots.txt for one product token: the longest matching pattern wins, allow before disallow."""

    def __init__(self, text: str, agent: str):
        token = re.split(r"[/ \t]", agent.strip())[0].lower()
        groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
        self.sitemaps: list[str] = []
        names: list[str] = []
        fresh = True
        for line in text.splitlines():
            key, colon, value = line.split("#")[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if not colon:
                continue
            if key == "user-agent":
                if not fresh:
                    names, fresh = [], True
                names.append(value.lower())
                if len(names) == 1:
                    groups.append((names, [], []))
            elif key == "sitemap":
                self.sitemaps.append(value)
            elif groups and key in ("allow", "disallow", "crawl-delay"):
                fresh = False
                if key == "crawl-delay":
                    try:
                        groups[-1][2].append(float(value))
                    except ValueError:
                        pass
                elif value:
                    groups[-1][1].append((key == "allow", value))
        mine = [g for g in groups if token in g[0]] or [g for g in groups if "*" in g[0]]
        self.rules = [r for g in mine for r in g[1]]
        delays = [d for g in mine for d in g[2] if 0 <= d < float("inf")]
        self.delay_ms = round(delays[0] * 1000) if delays else None

    def allowed(self, target: str) -> bool:
        best, verdict = -1, True
        for allow, pattern in self.rules:
            if re.match(self.regex(pattern), target) and (len(pattern) > best or (len(pattern) == best and allow)):
                best, verdict = len(pattern), allow
        return verdict

    @staticmethod
    def regex(pattern: str) -> str:
        body = pattern.removesuffix("$")
        return "".join(".*" if c == "*" else re.escape(c) for c in body) + ("$" if pattern.endswith("$") else "")


def robots_tests(files: DataFrame, tests: DataFrame, agent: str) -> DataFrame:
    """(host, url, verdict): allowed, blocked or invalid for each url of `tests` (host, url) by the robots text of its host in
    `files` (host, text); hosts without a file allow all. A host's file is parsed once per run of its rows in a batch.
    """

    def run(batches):
        known: dict[str, Robots] = {}
        for batch in batches:
            out = []
            for t, u in zip(batch["text"], batch["url"]):
                p = U.parse(u)
                if p is None:
                    out.append("invalid")
                    continue
                if len(known) > 1000:
                    known.clear()
                r = known.get(t or "") or known.setdefault(t or "", Robots(t or "", agent))
                out.append("allowed" if r.allowed(p[3] + ("" if p[4] is None else f"?{p[4]}")) else "blocked")
            yield pd.DataFrame({"host": batch["host"], "url": batch["url"], "verdict": out})

    return tests.join(files, "host", "left").select("host", "url", "text").mapInPandas(run, "host string, url string, verdict string")


def _blocks(df: DataFrame, kind: str, name: str, most: int) -> DataFrame:
    """One row for each run of at most `most` rows of the one column of `df`, as an array."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                values = batch.column(0).slice(at, most)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], names=[name])

    return checkpointed(df.mapInArrow(run, f"{name} array<{kind}>"))


def robots_batches(files: DataFrame, urls: DataFrame, agent: str) -> DataFrame:
    """(id, verdict, n): how many of all `urls` (url) each robots text of `files` (id long, text) allows, blocks or finds
    invalid; counts of nothing are left out.

    All pairs are tested. Texts and addresses meet in blocks, and a pattern that several texts of a block share is matched
    once against a block of addresses, so a pair costs something only where a rule matches.
    """
    counted = pa.schema([("id", pa.int64()), ("verdict", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for texts, addresses in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [p for p in map(U.parse, addresses) if p is not None]
                targets = [p[3] + ("" if p[4] is None else f"?{p[4]}") for p in parts]
                hits: dict[str, list[int]] = {}
                for f in texts:
                    best: dict[int, tuple[int, bool]] = {}
                    for allow, pattern in Robots(f["text"] or "", agent).rules:
                        if pattern not in hits:
                            matched = re.compile(Robots.regex(pattern)).match
                            hits[pattern] = [i for i, t in enumerate(targets) if matched(t)]
                        key = (len(pattern), allow)
                        for i in hits[pattern]:
                            if key > best.get(i, (-1, True)):
                                best[i] = key
                    blocked = sum(not allow for _, allow in best.values())
                    counts = {"allowed": len(targets) - blocked, "blocked": blocked, "invalid": len(addresses) - len(parts)}
                    out += [(f["id"], verdict, n) for verdict, n in counts.items() if n]
            yield pa.RecordBatch.from_pylist([dict(zip(counted.names, row)) for row in out], schema=counted)

    texts = _blocks(files.select(F.struct("id", "text").alias("_f")), "struct<id:bigint,text:string>", "texts", 500)
    pairs = texts.crossJoin(_blocks(urls.select("url"), "string", "urls", 5000))
    return pairs.mapInArrow(run, "id long, verdict string, n long").groupBy("id", "verdict").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- sitemaps


def parse_sitemap(xml: str, base: str) -> tuple[str, list[str]]:
    """(kind, locations) of a sitemap document: urlset or sitemapindex in any namespace, each location once.

    A wrong root or cut XML raises ValueError.
    """
    try:
        root = ElementTree.fromstring(xml.strip())
    except ElementTree.ParseError as e:
        raise ValueError(f"invalid sitemap: {e}") from None
    kind = root.tag.rpartition("}")[2]
    entry = {"urlset": "url", "sitemapindex": "sitemap"}.get(kind)
    if entry is None:
        raise ValueError(f"a sitemap has no root {kind}")
    found = []
    for e in root:
        if e.tag.rpartition("}")[2] == entry:
            for c in e:
                if c.tag.rpartition("}")[2] == "loc" and (u := U.resolve_href((c.text or "").strip(), base)):
                    found.append(u)
    return kind, list(dict.fromkeys(found))


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """(url, kind, location, error) of each document of `docs` (url, xml); a broken one gives one row with its error."""

    def run(batches):
        for batch in batches:
            out = []
            for u, x in zip(batch["url"], batch["xml"]):
                try:
                    kind, found = parse_sitemap(x or "", u)
                    out += [(u, kind, f, None) for f in found]
                except ValueError as e:
                    out.append((u, None, None, str(e)))
            yield pd.DataFrame(out, columns=["url", "kind", "location", "error"])

    return docs.select("url", "xml").mapInPandas(run, "url string, kind string, location string, error string")


def sitemap_tree(docs: DataFrame, roots: DataFrame, most_depth: int = 4) -> DataFrame:
    """(location, depth): page addresses reached from the sitemaps in `roots` (url), through indexes up to `most_depth`."""
    from siteloom.session import checkpointed

    entries = checkpointed(sitemap_entries(docs).where("error is null"))
    level = seen = roots.select("url").distinct()
    pages = None
    for depth in range(most_depth + 1):
        found = entries.join(level, "url", "left_semi")
        here = found.where("kind = 'urlset'").select("location", F.lit(depth).alias("depth"))
        pages = here if pages is None else pages.unionByName(here)
        level = checkpointed(found.where("kind = 'sitemapindex'").select(F.col("location").alias("url")).distinct().join(seen, "url", "left_anti"))
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    return pages.groupBy("location").agg(F.min("depth").alias("depth"))


# ---------------------------------------------------------------- custom extraction and search over pages


def custom_values(pages: DataFrame, ident: str, markup: str, extractors: list[dict]) -> DataFrame:
    """(ident, custom_extractions) of the extractors (name, kind css, cssAttribute, xpath or regex, pattern, attribute, all); a faulty
    one gives a single row named extractor_error.
    """
    kind_of = {"css": "css", "cssAttribute": "css-attribute", "xpath": "xpath", "regex": "regex"}

    def one(h: str) -> list[dict]:
        try:
            return [{"name": e["name"], "values": H.extract(h, kind_of[e["kind"]], e["pattern"], e.get("attribute"), e.get("all", True))} for e in extractors]
        except (ValueError, re.error, KeyError) as x:
            return [{"name": "extractor_error", "values": [str(x)]}]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({ident: batch[ident], "custom_extractions": [one(h or "") for h in batch["_html"]]})

    return pages.select(F.col(ident), F.col(markup).alias("_html")).mapInPandas(run, f"`{ident}` {dict(pages.dtypes)[ident]}, custom_extractions {RECORD['custom_extractions'][0]}")


def custom_searches(pages: DataFrame, ident: str, markup: str, searches: list[dict]) -> DataFrame:
    """(ident, custom_searches) of the searches (name, pattern, regex, case_sensitive): counts and first snippets."""

    def one(h: str) -> list[dict]:
        out = []
        for s in searches:
            n, found = H.search(h, s["pattern"], s.get("regex", False), s.get("case_sensitive", False))
            out.append({"name": s["name"], "source": "raw", "matched": n > 0, "match_count": n, "snippets": found})
        return out

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({ident: batch[ident], "custom_searches": [one(h or "") for h in batch["_html"]]})

    return pages.select(F.col(ident), F.col(markup).alias("_html")).mapInPandas(run, f"`{ident}` {dict(pages.dtypes)[ident]}, custom_searches {RECORD['custom_searches'][0]}")
