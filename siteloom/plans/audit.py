"""Queries of views, rules and summaries, with SQL built from the same list of conditions in another language."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siteloom.operators import audit
from siteloom.sources.schema import records
from siteloom.sources.tables import table

WHITE = r"[\t\n\x0B\f\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def utrim(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{WHITE}+|{WHITE}+$', '', 'g')"


def key(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), '{WHITE}+', ' ', 'g')))"


BLANK = {c: f"({utrim(c)} = '')" for c in ("title", "h1", "canonical")}
R = "(SELECT DISTINCT * FROM crawl_records WHERE id IS NOT NULL)"
OK = "(status_code BETWEEN 200 AND 299)"
ROBOTS = "(status_code IS NULL AND (status_text = 'Blocked by robots.txt' OR coalesce(error, '') = 'Blocked by robots.txt'))"
NONE = f"(status_code IS NULL AND error IS NOT NULL AND NOT {ROBOTS})"
BROKEN = f"({NONE} OR coalesce(status_code >= 400, false) OR (coalesce(status_code BETWEEN 300 AND 399, false) AND error IS NOT NULL))"
HTML = f"(coalesce({OK}, false) AND coalesce(lower(content_type) LIKE '%text/html%', false) AND coalesce(indexability_status, '') <> 'Response body incomplete')"


def dup(k: str, extra: str = "true") -> str:
    return f"{HTML} AND {extra} AND (crawl_id, {k}) IN (SELECT (crawl_id, {k}) FROM {R} WHERE {HTML} AND {extra} GROUP BY crawl_id, {k} HAVING count(*) > 1)"


FINAL = "regexp_replace(final_url, '#.*$', '')"
CONDITIONS = {
    "All": "true", "Internal": "classification = 'internal'", "External": "classification = 'external'", "Status2xx": OK, "Status3xx": "status_code BETWEEN 300 AND 399", "Status4xx": "status_code BETWEEN 400 AND 499", "Status5xx": "status_code >= 500",
    "NoResponse": NONE, "TitleMissing": f"{HTML} AND {BLANK['title']}", "TitleDuplicate": dup(key("title"), f"{key('title')} <> ''"), "TitleTooShort": f"{HTML} AND NOT {BLANK['title']} AND title_len < 30", "TitleTooLong": f"{HTML} AND title_len > 60",
    "TitlePixelTooNarrow": f"{HTML} AND NOT {BLANK['title']}", "H1Missing": f"{HTML} AND {BLANK['h1']}", "H1Duplicate": dup(key("h1"), f"{key('h1')} <> ''"), "H1TooLong": f"{HTML} AND h1_len > 70", "MetaMissing": HTML, "H2Missing": HTML,
    "TitleSameAsH1": f"{HTML} AND NOT {BLANK['title']} AND translate({utrim('title')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate({utrim('h1')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    "CanonicalMissing": f"{HTML} AND {BLANK['canonical']}", "CanonicalMultiple": f"{HTML} AND canonical_count > 1", "DirectivesNoindex": "lower(indexability_status) LIKE '%noindex%'",
    "SecurityMissingHsts": f"{OK} AND starts_with(final_url, 'https://')", "SecurityMissingCsp": HTML, "SecurityMissingXFrameOptions": HTML, "SecurityMissingContentTypeOptions": OK, "MobileMissingViewport": HTML,
    "NearDuplicate": dup("near_duplicate_cluster_id", "near_duplicate_cluster_id IS NOT NULL"),
    "ExactDuplicate": f"{HTML} AND response_hash IS NOT NULL AND (crawl_id, response_hash) IN (SELECT (crawl_id, response_hash) FROM {R} WHERE {HTML} AND response_hash IS NOT NULL GROUP BY crawl_id, response_hash HAVING count(DISTINCT {FINAL}) > 1)",
    "ThinContent": f"{HTML} AND word_count < 200", "LowTextRatio": f"{HTML} AND text_to_code_ratio * 100 < 10", "BrokenLinks": BROKEN, "SitemapOrphan": "in_sitemap AND inlink_count = 0 AND classification = 'internal'",
}


def message_sql(text: str, says: dict[str, str]) -> str:
    """A rule's message in SQL: braces hold a threshold, one of `says` or a column."""
    parts = []
    for i, piece in enumerate(text.replace("}", "{").split("{")):
        if i % 2 == 0:
            parts.append("'" + piece.replace("'", "''") + "'")
        elif hasattr(audit.Thresholds(), piece):
            parts.append(f"'{getattr(audit.Thresholds(), piece)}'")
        else:
            parts.append(says.get(piece) or f"coalesce(CAST({piece} AS VARCHAR), '')")
    return " || ".join(parts)


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def crawl(spark, d):
    return records(table(spark, d, "crawl_records"))


def _view(name):
    return lambda spark, d: audit.view(crawl(spark, d), name).select("crawl_id", "id", "final_url")


#: Views of columns that the captured tables lack run over the shop's records (plans.synthetic), those of relations over
#: the records with their page references (plans.reports).
QUERIES = {f"view_{_snake(n)}": _view(n) for n in audit.VIEWS if n in CONDITIONS or n.startswith("Canonical")}
SQL = {f"view_{_snake(n)}": f"SELECT crawl_id, id, final_url FROM {R} WHERE {c}" for n, c in CONDITIONS.items()}

#: Views of columns that the captured tables lack are asked of the shop's records instead.
_ABSENT = ("TitlePixelTooNarrow", "MetaMissing", "H2Missing", "SecurityMissingHsts", "SecurityMissingCsp", "SecurityMissingXFrameOptions", "SecurityMissingContentTypeOptions", "MobileMissingViewport")
for _n in _ABSENT:
    del QUERIES[f"view_{_snake(_n)}"], SQL[f"view_{_snake(_n)}"]

#: What the rules ask of the tables at hand where that is not the view's condition alone.
RULE_CONDITIONS = {
    "response.redirect_error": "status_code BETWEEN 300 AND 399 AND error IS NOT NULL", "title.too_long": f"{CONDITIONS['TitleTooLong']} AND NOT {BLANK['title']}", "h1.too_long": f"{CONDITIONS['H1TooLong']} AND NOT {BLANK['h1']}",
}
#: Counters of what the tables at hand can tell.
KNOWN = [c for c, v in audit.COUNTERS.items() if v in CONDITIONS and v not in _ABSENT]
_OWN = ["indexable", "non_indexable"]
_COUNTED = {c: f"count(*) FILTER (WHERE {CONDITIONS[audit.COUNTERS[c]]}) AS {c}" for c in KNOWN} | {"indexable": "count(*) FILTER (WHERE indexability = 'Indexable') AS indexable", "non_indexable": "count(*) FILTER (WHERE indexability = 'Non-indexable') AS non_indexable"}
_PROGRESS = [c for c in KNOWN if c != "exact_duplicates"]

QUERIES |= {
    "progress_summary": lambda spark, d: audit.progress_summary(crawl(spark, d)).select("crawl_id", *_PROGRESS, *_OWN),
    "reference_counts": lambda spark, d: audit.summary(crawl(spark, d), [c for c in audit.REFERENCE_COUNTERS if c.startswith("canonical_")]),
    "summary": lambda spark, d: audit.summary(crawl(spark, d)).select("crawl_id", *KNOWN, *_CANONICALS, *_OWN),
    "issues_long": lambda spark, d: audit.issues(crawl(spark, d)).select("crawl_id", "id", "url", "rule", "severity", "view", "message"),
    "issues_by_rule": lambda spark, d: audit.issues(crawl(spark, d)).groupBy("crawl_id", "rule", "severity").agg(F.count(F.lit(1)).alias("issues")),
}
_CANONICALS = [c for c in audit.REFERENCE_COUNTERS if c.startswith("canonical_")]
SQL |= {"progress_summary": f"SELECT crawl_id, {', '.join(_COUNTED[c] for c in (*_PROGRESS, *_OWN))} FROM {R} GROUP BY crawl_id"}
SUMMARY = ", ".join(_COUNTED.values())
