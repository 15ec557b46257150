"""Comparison of two crawls field by field, frozen audit reports, and the comparison of two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions import url as U
from siteloom.functions.text import bounded_bytes, contains_ci, trimmed
from siteloom.operators import audit, gates, links
from siteloom.operators.ranking import numbered
from siteloom.session import checkpointed
from siteloom.sources.schema import once

# The fields a comparison names.
FIELDS = ("finalUrl", "statusCode", "title", "metaDescription", "indexability", "headings", "canonical", "robotsDirectives", "content", "responseHash")
_COLUMNS = (
    "id storage_key url final_url list_position list_duplicate_index status_code title title_count meta_description meta_description_count indexability indexability_status h1 h1_count h2 h2_count canonical canonical_count "
    "meta_robots x_robots_tag content_hash content_hash_context response_hash"
).split()


def occurrences(records: DataFrame) -> DataFrame:
    """`records` narrowed to what a comparison reads, with request_url and occurrence.

    request_url is the url, else the http part of the storage key, else the final url, without fragment. The stored ordinals
    hold where all rows of a request have distinct positive ones; else rows are numbered by (position, storage_key, id), and
    those of a request with several are `ambiguous`: which of them is which in another crawl is a guess.
    """
    asked = F.coalesce(F.nullif(trimmed("url"), F.lit("")), F.nullif(F.regexp_extract("storage_key", r"(https?://.*)$", 1), F.lit("")), F.col("final_url"))
    df = once(records).select(*_COLUMNS).withColumn("request_url", U.without_fragment(asked))
    position = F.coalesce("list_position", U.list_position("storage_key")).cast("bigint")
    w = Window.partitionBy("request_url")
    ordered = w.orderBy(F.coalesce(position, F.col("id")), "storage_key", "id")
    known = (F.min("list_duplicate_index").over(w) > 0) & (F.size(F.collect_set("list_duplicate_index").over(w)) == F.count(F.lit(1)).over(w))
    df = df.withColumn("ambiguous", (F.count(F.lit(1)).over(w) > 1) & ~known)
    return df.withColumn("occurrence", F.when(known, F.col("list_duplicate_index")).otherwise(F.row_number().over(ordered)).cast("int"))


def _differs(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | ~F.col(f"b.{n}").eqNullSafe(F.col(f"a.{n}"))
    return out


def _differs_known(*names: str) -> Column:
    """Counts differ only where both are known."""
    out = F.lit(False)
    for n in names:
        out = out | (F.col(f"b.{n}").isNotNull() & F.col(f"a.{n}").isNotNull() & (F.col(f"b.{n}") != F.col(f"a.{n}")))
    return out


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(request_url, occurrence, change, fields, content, ...) of every occurrence of either crawl.

    change: added, removed, changed (any field but the response hash), responseOnly or unchanged; content: changed,
    unchanged, unavailable or notApplicable.
    """
    b, a = occurrences(before).alias("b"), occurrences(after).alias("a")
    both = b.join(a, (F.col("b.request_url") == F.col("a.request_url")) & (F.col("b.occurrence") == F.col("a.occurrence")), "full")
    matched = F.col("b.id").isNotNull() & F.col("a.id").isNotNull()
    comparable = F.col("b.content_hash").isNotNull() & F.col("a.content_hash").isNotNull() & F.col("b.content_hash_context").eqNullSafe(F.col("a.content_hash_context"))
    diffs = [
        ~U.without_fragment("b.final_url").eqNullSafe(U.without_fragment("a.final_url")), _differs("status_code"), _differs("title") | _differs_known("title_count"),
        _differs("meta_description") | _differs_known("meta_description_count"), _differs("indexability", "indexability_status"), _differs("h1", "h2", "h1_count", "h2_count"), _differs("canonical", "canonical_count"),
        _differs("meta_robots", "x_robots_tag"), comparable & (F.col("b.content_hash") != F.col("a.content_hash")), _differs_known("response_hash"),
    ]
    fields = F.array_compact(F.array(*[F.when(matched & gates.sure(d), F.lit(n)) for n, d in zip(FIELDS, diffs)]))
    content = F.when(~matched, "notApplicable").when(~comparable, "unavailable").when(F.col("b.content_hash") != F.col("a.content_hash"), "changed").otherwise("unchanged")
    got = both.select(
        F.coalesce("b.request_url", "a.request_url").alias("request_url"), F.coalesce("b.occurrence", "a.occurrence").alias("occurrence"), F.col("b.id").alias("before_id"), F.col("a.id").alias("after_id"),
        F.col("b.status_code").alias("before_status"), F.col("a.status_code").alias("after_status"), F.col("b.title").alias("before_title"), F.col("a.title").alias("after_title"), F.col("b.final_url").alias("before_final_url"), F.col("a.final_url").alias("after_final_url"),
        fields.alias("fields"), content.alias("content"),
    )
    other = F.size(F.array_remove("fields", "responseHash"))
    change = F.when(F.col("before_id").isNull(), "added").when(F.col("after_id").isNull(), "removed").when(other > 0, "changed").when(F.size("fields") > 0, "responseOnly").otherwise("unchanged")
    return got.withColumn("change", change)


def comparison_rows(rows: DataFrame, change: str | None = None, field: str | None = None, search: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Changed rows of `compared`, filtered; with a limit in order of address and occurrence."""
    rows = rows.where("change <> 'unchanged'")
    if change:
        rows = rows.where(F.col("change") == change)
    if field:
        rows = rows.where(F.array_contains("fields", field))
    if search.strip():
        hit = F.lit(False)
        for c in ("request_url", "before_title", "after_title", "before_final_url", "after_final_url", "before_status", "after_status", "change", "content"):
            hit = hit | contains_ci(c, search.strip())
        rows = rows.where(hit)
    return rows if limit is None else rows.orderBy("request_url", "occurrence").offset(offset).limit(limit)


def detail(before: DataFrame, after: DataFrame, request_url: str, occurrence: int) -> DataFrame:
    """The whole records of both crawls for one row of a comparison, with their side: two point lookups."""
    sides = []
    for name, df in (("previous", before), ("current", after)):
        named = occurrences(df.where(F.contains("url", F.lit(request_url)) | F.contains("storage_key", F.lit(request_url)) | F.contains("final_url", F.lit(request_url))))
        hit = named.where((F.col("request_url") == request_url) & (F.col("occurrence") == occurrence)).select("id")
        sides.append(once(df.join(hit, "id", "left_semi")).withColumn("side", F.lit(name)))
    return sides[0].unionByName(sides[1])


def keyed(rows: DataFrame) -> DataFrame:
    """Rows of a comparison with row_key, their place by address and occurrence from 1."""
    return numbered(rows, ["request_url", "occurrence"], "row_key")


class Workspace:
    """A comparison kept in a folder: its changed rows with their keys, and its counts; pages are read by key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def save(self, before: DataFrame, after: DataFrame) -> Workspace:
        rows = checkpointed(compared(before, after))
        keyed(rows.where("change <> 'unchanged'")).write.mode("overwrite").parquet(f"{self.folder}/rows")
        comparison_counts(rows).write.mode("overwrite").parquet(f"{self.folder}/counts")
        return self

    def counts(self) -> dict:
        return self.spark.read.parquet(f"{self.folder}/counts").first().asDict()

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def page(self, after: int = 0, limit: int = 1000, **filters) -> DataFrame:
        """The next rows after a row_key: keyset paging, no offset is read."""
        return comparison_rows(self.rows().where(F.col("row_key") > after), **filters).orderBy("row_key").limit(limit)


#: Fixed value: how many changed rows a comparison shows at once.
SHOWN = 1_000


def first_changes(rows: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first changed rows by address and occurrence: each task keeps its first `most`, and these are merged."""
    return rows.where("change <> 'unchanged'").orderBy("request_url", "occurrence").limit(most)


def comparison_counts(rows: DataFrame) -> DataFrame:
    """One row: rows by change, rows by changed field, and matched rows without comparable content."""
    return rows.agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "responseOnly", "unchanged")],
        *[F.count_if(F.array_contains("fields", f)).alias(f"{f}Changed") for f in FIELDS],
        F.count_if(F.col("content") == "unavailable").alias("contentUnavailable"),
    )


DELTAS = ("total", "success", "redirects", "client_errors", "server_errors", "no_response", "indexable", "non_indexable", "title_missing", "broken")


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, previous, current, delta) of ten summary counters of two crawls."""
    names = [c for c in DELTAS if c in audit.COUNTERS]
    sides = [audit.summary(df, names, scope=[]).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in DELTAS])).alias("x")).select("x.*") for df in (before, after)]
    p, c = sides[0].withColumnRenamed("n", "previous"), sides[1].withColumnRenamed("n", "current")
    return p.join(c, "metric").select("metric", "previous", "current", (F.col("current") - F.col("previous")).alias("delta"))


# ---------------------------------------------------------------- frozen reports

# Fixed values. Report rule: (severity, category, observed column, view, title). Severities differ from those of the issue rules.
_RULE_TABLE = {
    "title.missing": ("error", "Titles", "title", "TitleMissing", "Missing page title"),
    "title.duplicate": ("warning", "Titles", "title", "TitleDuplicate", "Duplicate page title"),
    "title.tooShort": ("warning", "Titles", "title", "TitleTooShort", "Short page title"),
    "title.tooLong": ("warning", "Titles", "title", "TitleTooLong", "Long page title"),
    "meta.missing": ("warning", "Descriptions", "meta_description", "MetaMissing", "Missing meta description"),
    "meta.duplicate": ("warning", "Descriptions", "meta_description", "MetaDuplicate", "Duplicate meta description"),
    "meta.tooShort": ("warning", "Descriptions", "meta_description", "MetaTooShort", "Short meta description"),
    "meta.tooLong": ("warning", "Descriptions", "meta_description", "MetaTooLong", "Long meta description"),
    "h1.missing": ("warning", "Headings", "h1", "H1Missing", "Missing H1 heading"),
    "canonical.missing": ("warning", "Canonicals", "canonical", "CanonicalMissing", "Missing canonical"),
    "canonical.toError": ("error", "Canonicals", "canonical", "CanonicalToError", "Canonical points to a failed target"),
    "canonical.toRedirect": ("warning", "Canonicals", "canonical", "CanonicalToRedirect", "Canonical points to a redirect"),
    "canonical.loop": ("error", "Canonicals", "canonical", "CanonicalLoop", "Canonical loop"),
    "response.clientError": ("error", "Response codes", "status_code", "Status4xx", "Client error response"),
    "response.serverError": ("error", "Response codes", "status_code", "Status5xx", "Server error response"),
    "response.noResponse": ("error", "Response codes", "error", "NoResponse", "No response"),
}
REPORT_RULES = {r: v[:3] for r, v in _RULE_TABLE.items()}
_REPORT_VIEWS = {r: v[3] for r, v in _RULE_TABLE.items()}
TITLES = {r: v[4] for r, v in _RULE_TABLE.items()} | {"links.broken": "Broken link destinations"}
EXPLANATION = "{title} was detected in the frozen crawl evidence. Counts describe captured observations within the saved report scope."
RECOMMENDATIONS = {
    "Titles": "Review the affected titles and provide a descriptive, distinct title within the saved thresholds.",
    "Descriptions": "Review the affected descriptions and provide a useful, distinct description within the saved thresholds.",
    "Headings": "Provide a descriptive primary heading for the affected page.",
    "Canonicals": "Check the canonical declaration and point it to the intended accessible, indexable destination.",
}
OTHERWISE = "Review the failed URL and its references; correct the destination or remove an obsolete reference."
VERIFICATION = "Recrawl the affected URLs with comparable scope and thresholds, then inspect the newly captured evidence."
TEAMS = {"Titles": "Content", "Descriptions": "Content", "Headings": "Content"}
UNATTRIBUTED = "Exact legacy link occurrence correspondence and capture completeness are unavailable."
VERSIONS_DIFFER, SCOPES_DIFFER, EXCLUSIONS_DIFFER = "Report schema or rule versions differ.", "Saved scope, filters, or audit thresholds differ.", "Recorded scope exclusions differ."
_DEFAULT_RULES = tuple(REPORT_RULES)
PREVIEW_BYTES = 64 * 1024


def report_evidence(records: DataFrame, edges: DataFrame | None = None, scoped: Column | None = None, thresholds: audit.Thresholds = audit.Thresholds(), scope: list[str] = audit.SCOPE) -> DataFrame:
    """(scope, evidence_id, rule, severity, category, record_id, request_url, source_url, target_url, observed) of a frozen report.

    Diagnostics look at the whole snapshot; `scoped` then narrows the records reported on. Broken links (rule links.broken)
    are added where `edges` are given: links from a scoped record to a failed address.
    """
    p = audit.predicates(thresholds)
    wanted = {r: p[v] for r, v in _REPORT_VIEWS.items()}
    columns = (F.col("id").alias("record_id"), "url", "final_url", *([] if scoped is None else [gates.sure(scoped).alias("_scoped")]))
    found = audit.hits(records, wanted, scope, columns, {r: bounded_bytes(F.col(o).cast("string"), PREVIEW_BYTES) for r, (_, _, o) in REPORT_RULES.items()})
    if scoped is not None:
        found = found.where("_scoped")
    of = lambda i: F.create_map(*[F.lit(x) for r, v in REPORT_RULES.items() for x in (r, v[i])])[F.col("label")]
    pages = found.select(
        *scope, F.concat("label", F.lit(":record:"), "record_id").alias("evidence_id"), F.col("label").alias("rule"), of(0).alias("severity"), of(1).alias("category"), "record_id",
        U.without_fragment("url").alias("request_url"), F.lit(None).cast("string").alias("source_url"), F.col("final_url").alias("target_url"), F.col("value").alias("observed"),
    )
    return pages if edges is None else pages.unionByName(broken_evidence(records, edges, scoped, scope))


def broken_evidence(records: DataFrame, edges: DataFrame, scoped: Column | None, scope: list[str]) -> DataFrame:
    """The evidence of rule links.broken: links from a reported record to a failed address."""
    sources = records if scoped is None else records.where(scoped)
    named = U.with_aliases(sources.select(*scope, "storage_key", "url", "final_url").distinct(), ["storage_key", "url", "final_url"], "source_url").select(*scope, "source_url").distinct()
    bad = links.edge_view(edges, "broken", records).select("id", "source_url", "target_url", "target_status_code")
    return bad.join(named, "source_url").select(
        *scope, F.concat(F.lit("links.broken:edge:"), "id").alias("evidence_id"), F.lit("links.broken").alias("rule"), F.lit("error").alias("severity"), F.lit("Links").alias("category"), F.lit(None).cast("bigint").alias("record_id"),
        U.without_fragment("source_url").alias("request_url"), "source_url", "target_url", F.col("target_status_code").cast("string").alias("observed"),
    )


def pruned(evidence: DataFrame) -> DataFrame:
    """Evidence with the columns that a report keeps; all others of its context are dropped."""
    return evidence.select(*[c for c in ("crawl_id", "evidence_id", "rule", "severity", "category", "record_id", "request_url", "source_url", "target_url", "observed") if c in evidence.columns])


MOST_PAGE, MOST_SEARCH = 1_000, 2_000


def report_query(evidence: DataFrame, rule: str, search: str = "", sort: str = "evidence_id", descending: bool = False, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of a finding's evidence. Unknown rules and columns, long search texts and pages beyond MOST_PAGE are refused."""
    if rule not in TITLES or sort not in evidence.columns or not 0 < limit <= MOST_PAGE or offset < 0 or len(search) > MOST_SEARCH:
        raise ValueError("invalid report query")
    rows = evidence.where(F.col("rule") == rule)
    if search.strip():
        hit = F.lit(False)
        for c in ("evidence_id", "request_url", "source_url", "target_url", "observed"):
            hit = hit | contains_ci(c, search.strip())
        rows = rows.where(hit)
    c = F.col(sort)
    return rows.orderBy(c.desc() if descending else c.asc(), "evidence_id").offset(offset).limit(limit)


def report_findings(evidence: DataFrame, scope: list[str] = audit.SCOPE) -> DataFrame:
    """(scope, rule, severity, category, occurrences, addresses, targets, title, explanation, recommendation, verification, team)
    per finding. Distinct values are counted from rows merged by value first, so that no finding meets one task whole.
    """
    keys = [*scope, "rule", "severity", "category"]
    by_request = evidence.groupBy(*keys, "request_url").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.count("request_url").alias("addresses"))
    by_target = evidence.groupBy(*keys, "target_url").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count("target_url").alias("targets"))
    got = by_request.join(by_target, keys)
    named = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])[F.col("rule")]
    return got.withColumns({
        "title": named, "explanation": F.replace(F.lit(EXPLANATION), F.lit("{title}"), named), "recommendation": F.coalesce(F.create_map(*[F.lit(x) for kv in RECOMMENDATIONS.items() for x in kv])[F.col("category")], F.lit(OTHERWISE)),
        "verification": F.lit(VERIFICATION), "team": F.when(F.col("category").isin(*TEAMS), "Content").otherwise("Engineering"),
    })


def report_coverage(records: DataFrame, scope: list[str] = audit.SCOPE) -> DataFrame:
    """(scope, records, eligible_html, blocked, failed, unavailable) of the reported records."""
    kinds = {
        "eligible_html": gates.success_html(), "blocked": gates.robots_blocked(), "failed": gates.broken(),
        "unavailable": F.col("status_code").isNull() & F.col("error").isNull() & ~gates.robots_blocked(),
    }
    rows = records.select(*scope, "id", *[c.alias(n) for n, c in kinds.items()]).distinct()
    return rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(n).alias(n) for n in kinds])


def report_page(evidence: DataFrame, rule: str, after: str = "", limit: int = 1000) -> DataFrame:
    """The next `limit` pieces of evidence of a rule after a cursor (evidence_id): keyset paging, no offset."""
    return evidence.where((F.col("rule") == rule) & (F.col("evidence_id") > after)).orderBy("evidence_id").limit(limit)


_GLOBAL = ("title.duplicate", "meta.duplicate", "canonical.toError", "canonical.toRedirect", "canonical.loop")


def incompatible(baseline: dict, current: dict) -> list[str]:
    """Why two reports cannot be compared, from their settings (schema, rules, scope, thresholds, exclusions); how a scope was
    paged or sorted does not count.
    """
    member = lambda r: {k: v for k, v in (r.get("scope") or {}).items() if k not in ("offset", "limit", "sort", "descending")}
    of = lambda r, *names: [r.get(n) for n in names]
    found = [
        (of(baseline, "schema", "rules") != of(current, "schema", "rules"), VERSIONS_DIFFER),
        (member(baseline) != member(current) or baseline.get("thresholds") != current.get("thresholds"), SCOPES_DIFFER),
        (baseline.get("exclusions") != current.get("exclusions"), EXCLUSIONS_DIFFER),
    ]
    return [text for differs, text in found if differs]


_PAIR = ("rule", "request_url", "occurrence", "state", "reason")


def _side(df: DataFrame, rules: tuple[str, ...], thresholds: audit.Thresholds) -> DataFrame:
    flags = audit.flagged(df, sorted({_REPORT_VIEWS[r] for r in rules}), thresholds, [])
    marks = F.array_compact(F.array(*[F.when(F.col(_REPORT_VIEWS[r]), F.lit(r)) for r in rules]))
    whole = F.coalesce(F.col("indexability_status") != gates.INCOMPLETE, F.lit(True))
    found = flags.select("id", marks.alias("rules"), gates.success_html().alias("html"), (F.col("status_code").isNotNull() | F.col("error").isNotNull()).alias("seen"), (F.col("status_code").isNotNull() & whole).alias("valid"), gates.sure(F.col("js_rendered")).alias("rendered"))
    return occurrences(df).select("id", "request_url", "occurrence", "ambiguous").join(found, "id").drop("id")


def compared_reports(before: DataFrame, after: DataFrame, rules: tuple[str, ...] = _DEFAULT_RULES, thresholds: audit.Thresholds = audit.Thresholds(), edges: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(rule, request_url, occurrence, state, reason): how each page's finding fared between two reports of one site.

    A finding in both is persisting. One only before is resolved if its page was seen again in a fit state, else not
    observed; one only after is added if its page was seen before in a fit state, else not observed. Rules that look at the
    whole site need every page of the baseline to be seen again, whole, of the same kind and beyond doubt; otherwise their
    changes are not observed either. Changes of a page whose occurrence is ambiguous are not observed. Broken links (with
    `edges`, those of either crawl) have no occurrence that could be followed: each side's are not observed.
    """
    b, a = _side(before, rules, thresholds).alias("b"), _side(after, rules, thresholds).alias("a")
    both = checkpointed(b.join(a, (F.col("b.request_url") == F.col("a.request_url")) & (F.col("b.occurrence") == F.col("a.occurrence")), "full").select(
        F.coalesce("b.request_url", "a.request_url").alias("request_url"), F.coalesce("b.occurrence", "a.occurrence").alias("occurrence"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("b", "a") for c in ("rules", "html", "seen", "valid", "rendered", "ambiguous")]
    ))
    kind = F.col("b_html") & (~gates.sure(F.col("a_html")) | (F.col("b_rendered") != F.col("a_rendered")))
    doubt = gates.sure(F.col("b_ambiguous")) | gates.sure(F.col("a_ambiguous"))
    lost = both.where(F.col("b_seen").isNotNull() & (~gates.sure(F.col("a_valid")) | doubt | gates.sure(kind))).limit(1).count()
    none = F.array().cast("array<string>")
    rows = both.withColumns({"had": F.coalesce("b_rules", none), "has": F.coalesce("a_rules", none)}).withColumn("rule", F.explode(F.array_union("had", "has")))
    had, has = F.array_contains("had", F.col("rule")), F.array_contains("has", F.col("rule"))
    response = F.startswith("rule", F.lit("response."))
    whole = F.col("rule").isin(*_GLOBAL) if lost else F.lit(False)
    fit = lambda s: F.when(response, gates.sure(F.col(f"{s}_seen"))).otherwise(gates.sure(F.col(f"{s}_html")))
    reason = (
        F.when(had & has & ~doubt, None)
        .when(doubt, "ambiguous occurrence")
        .when(had & F.col("a_seen").isNull(), "missing in the current report").when(~had & F.col("b_seen").isNull(), "missing in the baseline")
        .when(had & ~fit("a"), "current page not eligible").when(~had & ~fit("b"), "baseline page not eligible").when(whole, "incomplete context")
    )
    state = F.when(F.col("reason").isNotNull(), "notObserved").when(had & has, "persisting").when(had, "resolved").otherwise("added")
    out = rows.withColumn("reason", reason).withColumn("state", state).select(*_PAIR)
    for side, df, own in () if edges is None else (("baseline", before, edges[0]), ("current", after, edges[1])):
        out = out.unionByName(unattributed(df, own, side).select(*_PAIR))
    return out


def unattributed(records: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """The broken links of one report as rows of a comparison that could not be followed, with their identity."""
    return broken_evidence(records, edges, None, []).select(
        "rule", "request_url", F.lit(None).cast("int").alias("occurrence"), F.lit("notObserved").alias("state"), F.lit(UNATTRIBUTED).alias("reason"), F.concat(F.lit(f"{side}:"), "evidence_id").alias("identity"),
    )


def finding_statuses(states: DataFrame) -> DataFrame:
    """(rule, added, persisting, resolved, not_observed, status) per finding."""
    of = lambda s: F.count_if(F.col("state") == s)
    got = states.groupBy("rule").agg(of("added").alias("added"), of("persisting").alias("persisting"), of("resolved").alias("resolved"), of("notObserved").alias("not_observed"))
    a, p, r, n = (F.col(c) > 0 for c in ("added", "persisting", "resolved", "not_observed"))
    status = F.when(n & ~a & ~p & ~r, "notComparable").when(a & r, "mixedChanges").when(r & ~p & ~n, "resolved").when(r, "improved").when(a & ~p, "new").when(a, "worsened").otherwise("unchanged")
    return got.withColumn("status", status)


