"""Queries that compare crawls and reports, and merge metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import audit, compare, links
from siteloom.operators.ranking import numbered
from siteloom.plans.audit import BROKEN, CONDITIONS, HTML, NONE, ROBOTS, R, crawl
from siteloom.plans.reports import CANONICAL, CANONICAL_LOOP, E, FAILED, NAMED, edges, names
from siteloom.sources.tables import table

SCOPE = audit.SCOPE


def last_two(spark, d):
    """The records of the two latest crawls: the crawls before and after."""
    df = crawl(spark, d)
    ids = [r[0] for r in table(spark, d, "crawl_sessions", "crawl_id").orderBy(F.col("crawl_id").desc()).limit(2).collect()]
    return df.where(F.col("crawl_id") == ids[1]), df.where(F.col("crawl_id") == ids[0])


def _rows(spark, d):
    return compare.compared(*last_two(spark, d))


def metrics(spark, d):
    """Metric rows from all parts: a part speaks of the address whose place among all (by text) is its key modulo their number,
    so that an address has several rows if there are more parts than addresses; the last one (seq) holds.
    """
    urls = crawl(spark, d).select(F.col("final_url").alias("url")).where("url is not null").distinct()
    placed = numbered(urls, ["url"], "at", 0)
    n = placed.count()
    key = F.col("p_partkey").cast("long")
    parts = table(spark, d, "part").select(key.alias("seq"), F.pmod(key, F.lit(max(n, 1))).alias("at"))
    return placed.join(parts, "at").select("url", (F.col("seq") * 3).cast("double").alias("clicks"), (F.col("seq") * 10).cast("double").alias("impressions"), "seq")


def _second(spark, d):
    """Another source: impressions by the suppliers, over the same addresses."""
    urls = crawl(spark, d).select(F.col("final_url").alias("url")).where("url is not null").distinct()
    placed = numbered(urls, ["url"], "at", 0)
    n = placed.count()
    key = F.col("s_suppkey").cast("long")
    rows = table(spark, d, "supplier").select(key.alias("seq"), F.pmod(key * 7, F.lit(max(n, 1))).alias("at"))
    return placed.join(rows, "at").select("url", (F.col("seq") * 10).cast("double").alias("impressions"), "seq")


_ASKED = "regexp_replace(coalesce(nullif(trim(url), ''), nullif(regexp_extract(storage_key, '(https?://.*)$', 1), ''), final_url), '#.*$', '')"


def _occ(offset: int) -> str:
    crawl_of = f"(SELECT crawl_id FROM crawl_sessions ORDER BY crawl_id DESC LIMIT 1 OFFSET {offset})"
    pos = "coalesce(list_position, try_cast(nullif(regexp_extract(storage_key, '^list:(\\d+):', 1), '') AS INT), id)"
    return f"""(SELECT *, CASE WHEN min(list_duplicate_index) OVER w > 0 AND len(list_distinct(list(list_duplicate_index) OVER w)) = count(*) OVER w THEN list_duplicate_index
  ELSE row_number() OVER (PARTITION BY q ORDER BY {pos}, storage_key, id) END AS occ FROM (SELECT *, {_ASKED} AS q FROM {R} WHERE crawl_id = {crawl_of}) WINDOW w AS (PARTITION BY q))"""


_STRIP = "regexp_replace({}, '#.*$', '')"
_DIFFS = {
    "finalUrl": f"{_STRIP.format('b.final_url')} IS DISTINCT FROM {_STRIP.format('a.final_url')}", "statusCode": "b.status_code IS DISTINCT FROM a.status_code", "title": "b.title IS DISTINCT FROM a.title", "indexability": "b.indexability IS DISTINCT FROM a.indexability OR b.indexability_status IS DISTINCT FROM a.indexability_status",
    "headings": "b.h1 IS DISTINCT FROM a.h1 OR b.h1_count IS DISTINCT FROM a.h1_count", "canonical": "b.canonical IS DISTINCT FROM a.canonical OR b.canonical_count IS DISTINCT FROM a.canonical_count",
    "robotsDirectives": "b.meta_robots IS DISTINCT FROM a.meta_robots OR b.x_robots_tag IS DISTINCT FROM a.x_robots_tag", "responseHash": "b.response_hash <> a.response_hash",
}
_COMPARED = f"""(SELECT coalesce(b.q, a.q) AS request_url, CAST(coalesce(b.occ, a.occ) AS INT) AS occurrence, b.id AS before_id, a.id AS after_id,
  list_filter([{', '.join(f"CASE WHEN b.id IS NOT NULL AND a.id IS NOT NULL AND coalesce({c}, false) THEN '{n}' END" for n, c in _DIFFS.items())}], lambda x: x IS NOT NULL) AS fields
  FROM {_occ(1)} b FULL JOIN {_occ(0)} a ON a.q = b.q AND a.occ = b.occ)"""
_CHANGE = "CASE WHEN before_id IS NULL THEN 'added' WHEN after_id IS NULL THEN 'removed' WHEN len(list_filter(fields, lambda x: x <> 'responseHash')) > 0 THEN 'changed' WHEN len(fields) > 0 THEN 'responseOnly' ELSE 'unchanged' END"
_REPORT = [
    ("title.missing", "error", CONDITIONS["TitleMissing"]), ("title.duplicate", "warning", CONDITIONS["TitleDuplicate"]), ("title.tooShort", "warning", CONDITIONS["TitleTooShort"]), ("title.tooLong", "warning", CONDITIONS["TitleTooLong"]),
    ("meta.missing", "warning", HTML), ("h1.missing", "warning", CONDITIONS["H1Missing"]), ("canonical.missing", "warning", CONDITIONS["CanonicalMissing"]), ("response.clientError", "error", CONDITIONS["Status4xx"]),
    ("response.serverError", "error", CONDITIONS["Status5xx"]), ("response.noResponse", "error", NONE),
]
_FLAGGED = [("canonical.toError", "error", f"SELECT c.crawl_id, c.id FROM ({CANONICAL}) c WHERE c.canonical_to_error"), ("canonical.toRedirect", "warning", f"SELECT c.crawl_id, c.id FROM ({CANONICAL}) c WHERE c.canonical_to_redirect"), ("canonical.loop", "error", f"SELECT crawl_id, id FROM ({CANONICAL_LOOP})")]
_EVIDENCE = " UNION ALL ".join([f"SELECT crawl_id, '{r}' AS rule, '{s}' AS severity, id AS record_id FROM {R} WHERE {c}" for r, s, c in _REPORT] + [f"SELECT crawl_id, '{r}', '{s}', id FROM ({q})" for r, s, q in _FLAGGED])
_FULL = f"""SELECT e.crawl_id, e.rule, e.severity, CAST(e.record_id AS VARCHAR) AS k, regexp_replace(r.url, '#.*$', '') AS request_url, r.final_url AS target_url FROM ({_EVIDENCE}) e JOIN {R} r ON r.id = e.record_id
UNION ALL SELECT n.crawl_id, 'links.broken', 'error', CAST(e.id AS VARCHAR), regexp_replace(e.source_url, '#.*$', ''), e.target_url FROM (SELECT * FROM {E} WHERE coalesce(target_status_code >= 400, false) OR target_url IN (SELECT a FROM {FAILED})) e JOIN (SELECT DISTINCT crawl_id, alias FROM {NAMED}) n ON n.alias = e.source_url"""

QUERIES = {
    "compare_rows": lambda spark, d: _rows(spark, d).where("change <> 'unchanged'").select("request_url", "occurrence", "before_id", "after_id", F.array_join("fields", ",").alias("fields"), "change"),
    "compare_counts": lambda spark, d: compare.comparison_counts(_rows(spark, d)).select("added", "removed", "changed", "responseOnly", "unchanged", "titleChanged", "canonicalChanged", "responseHashChanged", "contentUnavailable"),
    "compare_response_only": lambda spark, d: compare.comparison_rows(_rows(spark, d), "responseOnly").select("request_url", "occurrence"),
    "compare_title_changes": lambda spark, d: compare.comparison_rows(_rows(spark, d), "changed", "title").select("request_url", "occurrence", "before_title", "after_title"),
    "metric_deltas": lambda spark, d: compare.metric_deltas(*last_two(spark, d)),
    "audit_evidence": lambda spark, d: compare.report_evidence(crawl(spark, d)).select("crawl_id", "evidence_id", "rule", "severity", "record_id"),
    "audit_findings": lambda spark, d: compare.report_findings(compare.report_evidence(crawl(spark, d))).select("crawl_id", "rule", "severity", "occurrences"),
    "audit_report_full": lambda spark, d: compare.report_findings(compare.report_evidence(crawl(spark, d), edges(spark, d))).select("crawl_id", "rule", "severity", "occurrences", "addresses", "targets"),
    "compare_row_keys": lambda spark, d: compare.keyed(_rows(spark, d).where("change <> 'unchanged'").select("request_url", "occurrence", "change")),
    "audit_coverage": lambda spark, d: compare.report_coverage(crawl(spark, d)),
    "report_compare_states": lambda spark, d: compare.compared_reports(*last_two(spark, d)),
    "report_compare_findings": lambda spark, d: compare.finding_statuses(compare.compared_reports(*last_two(spark, d))),
    "merge_search_console": lambda spark, d: links.metric_merge(crawl(spark, d), metrics(spark, d), ["clicks", "impressions"], SCOPE, "seq"),
    "merge_ga4": lambda spark, d: links.metric_merge(crawl(spark, d), metrics(spark, d), ["clicks"], SCOPE, "seq", scheme_free=True),
    "merge_sources": lambda spark, d: links.merged_sources({"a": (metrics(spark, d).select("url", "clicks", "seq"), ["clicks"]), "b": (_second(spark, d), ["impressions"])}, "seq"),
}

_PLACED = "(SELECT url, row_number() OVER (ORDER BY url) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT final_url AS url FROM crawl_records WHERE id IS NOT NULL AND final_url IS NOT NULL))"
_METRICS = f"(SELECT url, p_partkey * 3.0::DOUBLE AS clicks, p_partkey * 10.0::DOUBLE AS impressions, CAST(p_partkey AS BIGINT) AS seq FROM {_PLACED} JOIN part ON p_partkey % n = place)"
_SECOND = f"(SELECT url, s_suppkey * 10.0::DOUBLE AS impressions, CAST(s_suppkey AS BIGINT) AS seq FROM {_PLACED} JOIN supplier ON s_suppkey * 7 % n = place)"
_DELTA = {"total": "true", "success": CONDITIONS["Status2xx"], "redirects": CONDITIONS["Status3xx"], "client_errors": CONDITIONS["Status4xx"], "server_errors": CONDITIONS["Status5xx"], "no_response": NONE, "indexable": "indexability = 'Indexable'", "non_indexable": "indexability = 'Non-indexable'", "title_missing": CONDITIONS["TitleMissing"], "broken": BROKEN}
_SIDE = "(SELECT crawl_id FROM crawl_sessions ORDER BY crawl_id DESC LIMIT 1 OFFSET {})"
_MERGED = "WITH m AS (SELECT unnest({n}) AS a, clicks, impressions, seq FROM {m}), l AS (SELECT {s} AS a, max({{'o': seq, 'c': clicks, 'i': impressions}}) AS x FROM m GROUP BY 1), n AS (SELECT DISTINCT crawl_id, id, {t} AS a FROM {named}) SELECT crawl_id, id, max(x).c AS clicks{more} FROM n JOIN l USING (a) GROUP BY 1, 2"
_FREE = "regexp_replace({}, '^https?://', '//')"

def _reported(offset: int) -> str:
    """One side of a comparison of reports: each occurrence with its findings and its fitness."""
    group = "OVER (PARTITION BY q)"
    known = f"min(list_duplicate_index) {group} > 0 AND len(list_distinct(list(list_duplicate_index) {group})) = count(*) {group}"
    return f"""(SELECT o.q, o.occ, {HTML} AS html, (o.status_code IS NOT NULL OR o.error IS NOT NULL) AS seen, (o.status_code IS NOT NULL AND coalesce(o.indexability_status <> 'Response body incomplete', true)) AS valid, o.amb, coalesce(f.rules, []) AS rules
  FROM (SELECT *, count(*) {group} > 1 AND NOT ({known}) AS amb FROM {_occ(offset)}) o LEFT JOIN (SELECT record_id, list(rule) AS rules FROM ({_EVIDENCE}) GROUP BY 1) f ON f.record_id = o.id)"""


_GLOBAL = ", ".join(f"'{r}'" for r in ("title.duplicate", "meta.duplicate", "canonical.toError", "canonical.toRedirect", "canonical.loop"))
_FIT = "CASE WHEN starts_with(rule, 'response.') THEN coalesce({s}_seen, false) ELSE coalesce({s}_html, false) END"
_STATES = f"""
WITH j AS (SELECT coalesce(b.q, a.q) AS request_url, CAST(coalesce(b.occ, a.occ) AS INT) AS occurrence, coalesce(b.rules, []) AS had, coalesce(a.rules, []) AS has, b.seen AS b_seen, a.seen AS a_seen, b.html AS b_html, a.html AS a_html, a.valid AS a_valid,
    coalesce(b.amb, false) OR coalesce(a.amb, false) AS doubt FROM {_reported(1)} b FULL JOIN {_reported(0)} a ON a.q = b.q AND a.occ = b.occ),
l AS (SELECT count(*) > 0 AS lost FROM j WHERE b_seen IS NOT NULL AND (NOT coalesce(a_valid, false) OR doubt OR (b_html AND NOT coalesce(a_html, false)))),
r AS (SELECT j.*, l.lost, unnest(list_distinct(list_concat(had, has))) AS rule FROM j, l),
t AS (SELECT *, list_contains(had, rule) AS was, list_contains(has, rule) AS is_now FROM r),
u AS (SELECT *, CASE WHEN was AND is_now AND NOT doubt THEN NULL WHEN doubt THEN 'ambiguous occurrence' WHEN was AND a_seen IS NULL THEN 'missing in the current report' WHEN NOT was AND b_seen IS NULL THEN 'missing in the baseline'
    WHEN was AND NOT {_FIT.format(s='a')} THEN 'current page not eligible' WHEN NOT was AND NOT {_FIT.format(s='b')} THEN 'baseline page not eligible' WHEN lost AND rule IN ({_GLOBAL}) THEN 'incomplete context' END AS reason FROM t)
SELECT rule, request_url, occurrence, CASE WHEN reason IS NOT NULL THEN 'notObserved' WHEN was AND is_now THEN 'persisting' WHEN was THEN 'resolved' ELSE 'added' END AS state, reason FROM u
"""

SQL = {
    "report_compare_states": _STATES,
    "report_compare_findings": f"""SELECT rule, added, persisting, resolved, not_observed, CASE WHEN not_observed > 0 AND added + persisting + resolved = 0 THEN 'notComparable' WHEN added > 0 AND resolved > 0 THEN 'mixedChanges' WHEN resolved > 0 AND persisting + not_observed = 0 THEN 'resolved'
  WHEN resolved > 0 THEN 'improved' WHEN added > 0 AND persisting = 0 THEN 'new' WHEN added > 0 THEN 'worsened' ELSE 'unchanged' END AS status
  FROM (SELECT rule, count(*) FILTER (WHERE state = 'added') AS added, count(*) FILTER (WHERE state = 'persisting') AS persisting, count(*) FILTER (WHERE state = 'resolved') AS resolved, count(*) FILTER (WHERE state = 'notObserved') AS not_observed FROM ({_STATES}) GROUP BY 1)""",
    "compare_rows": f"SELECT request_url, occurrence, before_id, after_id, array_to_string(fields, ',') AS fields, {_CHANGE} AS change FROM {_COMPARED} WHERE {_CHANGE} <> 'unchanged'",
    "compare_counts": f"SELECT {', '.join(f'''count(*) FILTER (WHERE {_CHANGE} = '{c}') AS \"{c}\"''' for c in ('added', 'removed', 'changed', 'responseOnly', 'unchanged'))}, {', '.join(f'''count(*) FILTER (WHERE list_contains(fields, '{f}')) AS \"{f}Changed\"''' for f in ('title', 'canonical', 'responseHash'))}, count(*) FILTER (WHERE before_id IS NOT NULL AND after_id IS NOT NULL) AS \"contentUnavailable\" FROM {_COMPARED}",
    "compare_response_only": f"SELECT request_url, occurrence FROM {_COMPARED} WHERE {_CHANGE} = 'responseOnly'",
    "compare_title_changes": f"SELECT c.request_url, c.occurrence, b.title AS before_title, a.title AS after_title FROM {_COMPARED} c JOIN {R} b ON b.id = c.before_id JOIN {R} a ON a.id = c.after_id WHERE list_contains(fields, 'title')",
    "metric_deltas": f"WITH {', '.join(f'{n} AS (' + ' UNION ALL '.join(f'''SELECT '{m}' AS metric, count(*) FILTER (WHERE {c}) AS n FROM {R} WHERE crawl_id = {_SIDE.format(o)}''' for m, c in _DELTA.items()) + ')' for n, o in (('p', 1), ('c', 0)))} SELECT metric, p.n AS previous, c.n AS current, c.n - p.n AS delta FROM p JOIN c USING (metric)",
    "audit_evidence": f"SELECT crawl_id, rule || ':record:' || record_id AS evidence_id, rule, severity, record_id FROM ({_EVIDENCE})",
    "audit_findings": f"SELECT crawl_id, rule, severity, count(*) AS occurrences FROM ({_EVIDENCE}) GROUP BY 1, 2, 3",
    "audit_report_full": f"SELECT crawl_id, rule, severity, count(*) AS occurrences, count(DISTINCT request_url) AS addresses, count(DISTINCT target_url) AS targets FROM ({_FULL}) GROUP BY 1, 2, 3",
    "compare_row_keys": f"SELECT request_url, occurrence, {_CHANGE} AS change, row_number() OVER (ORDER BY request_url, occurrence) AS row_key FROM {_COMPARED} WHERE {_CHANGE} <> 'unchanged'",
    "audit_coverage": f"SELECT crawl_id, count(*) AS records, count(*) FILTER (WHERE {HTML}) AS eligible_html, count(*) FILTER (WHERE {ROBOTS}) AS blocked, count(*) FILTER (WHERE {BROKEN}) AS failed, count(*) FILTER (WHERE status_code IS NULL AND error IS NULL AND NOT {ROBOTS}) AS unavailable FROM {R} GROUP BY 1",
    "merge_search_console": _MERGED.format(n=names("url"), m=_METRICS, s="a", t="alias", named=NAMED, more=", max(x).i AS impressions"),
    "merge_ga4": _MERGED.format(n=names("url"), m=_METRICS, s=_FREE.format("a"), t=_FREE.format("alias"), named=NAMED, more=""),
    "merge_sources": f"SELECT url, a.clicks, b.impressions FROM (SELECT regexp_replace(trim(url), '#.*$', '') AS url, arg_max(clicks, seq) AS clicks FROM {_METRICS} GROUP BY 1) a FULL JOIN (SELECT regexp_replace(trim(url), '#.*$', '') AS url, arg_max(impressions, seq) AS impressions FROM {_SECOND} GROUP BY 1) b USING (url)",
}
