"""The grid query: view, segment, search, filter rules, sort and page over crawl records."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import contains_ci, extraction_value, matches, search_matches, text_key
from siteloom.operators import audit, links
from siteloom.sources.schema import once

MOST_ROWS = 1_000_000
MOST_RULES = 20
MOST_VALUE = 2_000

# Filter fields, operators and searched columns of the grid.
FIELDS = {
    "url": ("url", "text"), "finalUrl": ("final_url", "text"), "title": ("title", "text"), "metaDescription": ("meta_description", "text"), "canonical": ("canonical", "text"), "indexability": ("indexability", "text"),
    "statusCode": ("status_code", "number"), "depth": ("depth", "number"), "wordCount": ("word_count", "number"), "responseTimeMs": ("response_time_ms", "number"),
}
TEXT_OPERATORS = frozenset("contains notContains equals notEquals isEmpty isNotEmpty".split())
NUMBER_OPERATORS = frozenset("equals notEquals lessThan greaterThan isEmpty isNotEmpty".split())

#: Scalar columns that the global search reads.
SEARCHED = [
    "url", "final_url", "status_code", "status_text", "content_type", "indexability", "indexability_status", "title", "meta_description",
    "meta_keywords", "meta_robots", "x_robots_tag", "h1", "h2", "canonical", "amphtml", "rel_next", "rel_prev", "redirect_target", "redirect_type",
    "response_hash", "content_hash", "error", "classification", "depth", "word_count", "near_duplicate_cluster_id", "list_position",
    "deprecated_html_tag_count", "duplicate_id_count", "js_rendered", "rendered_dom_changed", "rendered_word_count_delta",
    "rendered_link_count_delta", "search_console_clicks", "search_console_impressions", "search_console_ctr", "search_console_average_position",
]
SEARCHED_ARRAYS = ("amphtml_targets", "rel_next_targets", "rel_prev_targets")
#: Searched too where the first inlinks are joined.
SEARCHED_INLINK = ("first_inlink_source_url", "first_inlink_anchor_text", "first_inlink_source_position")

# The sort keys of the grid; each sorts by the column of its name.
_SORTED = [
    "statusCode", "responseTimeMs", "dnsLookupTimeMs", "tcpConnectTimeMs", "tlsHandshakeTimeMs", "ttfbMs", "downloadTimeMs", "totalNetworkTimeMs",
    "transferRateBytesPerSec", "resolvedIpCount", "inSitemap", "listPosition", "listDuplicateIndex", "sizeBytes", "depth", "titleLen", "titleCount",
    "titlePixelWidth", "metaDescription", "metaDescriptionLen", "metaDescriptionCount", "metaDescriptionPixelWidth", "h1", "h1Len", "h1Count", "h2",
    "h2Len", "h2Count", "canonicalCount", "relNext", "relPrev", "amphtml", "metaKeywords", "wordCount", "textToCodeRatio", "imageCount",
    "imagesMissingAlt", "imagesAltTooLong", "mixedContentCount", "insecureFormCount", "hreflangCount", "hreflangInvalidCount", "jsonLdCount",
    "jsonLdInvalidCount", "structuredDataErrorCount", "structuredDataWarningCount", "openGraphCount", "twitterCardCount", "deprecatedHtmlTagCount",
    "duplicateIdCount", "jsRendered", "renderedDomChanged", "renderedWordCountDelta", "renderedLinkCountDelta", "searchConsoleClicks",
    "searchConsoleImpressions", "searchConsoleCtr", "searchConsoleAveragePosition", "analyticsSessions", "analyticsEngagedSessions",
    "analyticsConversions", "analyticsRevenue", "backlinkCount", "referringDomainCount", "backlinkAuthority", "nearDuplicateClusterId", "inlinkCount",
    "firstInlinkSourceUrl", "firstInlinkSourcePosition", "outlinkCount", "title", "url", "finalUrl",
]


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


SORT_KEYS = {k: snake(k) for k in _SORTED}


@dataclass(frozen=True)
class Rule:
    field: str
    operator: str
    value: str = ""


@dataclass(frozen=True)
class GridQuery:
    view: str = "All"
    search: str = ""
    segment: str = ""
    segment_regex: bool = False
    rules: tuple[Rule, ...] = ()
    match_any: bool = False
    sort: str | None = None
    descending: bool = False
    offset: int = 0
    limit: int = 200
    thresholds: audit.Thresholds = field(default_factory=audit.Thresholds)

    def __post_init__(self):
        if self.view not in audit.VIEWS:
            raise ValueError(f"no view {self.view}")
        if len(self.rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        for r in self.rules:
            if r.field not in FIELDS:
                raise ValueError(f"no field {r.field}")
            if len(r.value) > MOST_VALUE:
                raise ValueError(f"a value of more than {MOST_VALUE} characters")
            kind = FIELDS[r.field][1]
            if r.operator not in (TEXT_OPERATORS if kind == "text" else NUMBER_OPERATORS):
                raise ValueError(f"{r.operator} does not apply to {r.field}")
            if kind == "number" and r.operator not in ("isEmpty", "isNotEmpty") and not math.isfinite(float(r.value)):
                raise ValueError(f"{r.field} is compared with finite numbers")


def condition(rule: Rule) -> Column:
    """A filter rule. Texts compare by text key, null as empty; a null number only matches isEmpty."""
    column, kind = FIELDS[rule.field]
    if kind == "text":
        have, want = text_key(F.coalesce(F.col(column), F.lit(""))), text_key(F.lit(rule.value))
        return {
            "contains": lambda: F.contains(have, want), "notContains": lambda: ~F.contains(have, want), "equals": lambda: have == want,
            "notEquals": lambda: have != want, "isEmpty": lambda: have == "", "isNotEmpty": lambda: have != "",
        }[rule.operator]()
    c = F.col(column)
    if rule.operator == "isEmpty":
        return c.isNull()
    if rule.operator == "isNotEmpty":
        return c.isNotNull()
    number = float(rule.value)
    # Whole numbers compare as such: a double would round large ids. A fractional bound never equals a whole value.
    value = F.lit(int(number)).cast("bigint") if number.is_integer() and abs(number) < 2**63 else F.lit(number)
    got = {"equals": c == value, "notEquals": c != value, "lessThan": c < value, "greaterThan": c > value}[rule.operator]
    return F.coalesce(got, F.lit(False))


def rules(all_of: tuple[Rule, ...], match_any: bool = False) -> Column:
    """All (or any) of the rules; none filter nothing."""
    parts = [condition(r) for r in all_of]
    return reduce((lambda a, b: a | b) if match_any else (lambda a, b: a & b), parts) if parts else F.lit(True)


def segment(text: str, regex: bool = False) -> Column:
    """Part of the address or of the final one, literal without regard to case, or a pattern."""
    if not text:
        return F.lit(True)
    test = (lambda c: matches(c, text)) if regex else (lambda c: contains_ci(c, text))
    return test("url") | test("final_url")


def search(text: str, inlinks: bool = False) -> Column:
    """Literal substring of any searched column, without regard to case; blank text finds everything. `inlinks`: those of
    `links.first_inlinks` are joined and searched too.
    """
    text = text.strip().lower()
    if not text:
        return F.lit(True)
    hits = [contains_ci(c, text) for c in (*SEARCHED, *(SEARCHED_INLINK if inlinks else ()))]
    hits += [F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), F.lit(text))), F.lit(False)) for c in SEARCHED_ARRAYS]
    in_values = lambda e: F.contains(F.lower(e["name"]), F.lit(text)) | F.exists(e["values"], lambda v: F.contains(F.lower(v), F.lit(text)))
    hits.append(F.coalesce(F.exists("custom_extractions", in_values), F.lit(False)))
    hits.append(F.coalesce(F.exists("custom_searches", lambda e: F.contains(F.lower(e["name"]), F.lit(text)) | F.contains(e["match_count"].cast("string"), F.lit(text)) | F.exists(e["snippets"], lambda v: F.contains(F.lower(v), F.lit(text)))), F.lit(False)))
    issue = lambda e: reduce(lambda a, b: a | b, [contains_ci(e[k], text) for k in ("severity", "message", "path")])
    hits.append(F.coalesce(F.exists("structured_data_issues", issue), F.lit(False)))
    return reduce(lambda a, b: a | b, hits)


def order(query: GridQuery) -> list[Column]:
    """Sort columns: the key (nulls first upwards, last downwards), then id; without a key list position or id."""
    if query.sort is None:
        return [F.coalesce(F.col("list_position").cast("bigint"), F.col("id")), F.col("id")]
    kind, _, rest = query.sort.partition(":")
    if rest and kind in ("custom", "search"):
        name = rest.rpartition(":")[0] or rest
        c = extraction_value("custom_extractions", name) if kind == "custom" else search_matches("custom_searches", name)
    elif query.sort in SORT_KEYS:
        c = F.col(SORT_KEYS[query.sort])
    else:
        return [F.col("id")]
    return [c.desc() if query.descending else c.asc(), F.col("id")]


def filtered(records: DataFrame, query: GridQuery, scope: list[str] = audit.SCOPE, edges: DataFrame | None = None) -> DataFrame:
    """All rows that a grid query finds, once each, unsorted. `edges` is needed for a search text only, which their first
    inlinks may hold. Whether a row is among duplicates is asked of the whole view, before segment and rules narrow it.
    """
    rows = audit.held(records, query.view, query.thresholds, scope)
    rows = once(rows.where(segment(query.segment, query.segment_regex)).where(rules(query.rules, query.match_any)))
    if not query.search.strip():
        return rows
    if edges is None:
        raise ValueError("searching needs the link edges")
    linked = rows.join(links.first_inlinks(rows, edges, scope), [*scope, "id"], "left")
    return linked.where(search(query.search, inlinks=True)).drop(*SEARCHED_INLINK)


def page(records: DataFrame, query: GridQuery, edges: DataFrame | None = None, scope: list[str] = audit.SCOPE) -> DataFrame:
    """The page of rows. `edges` is needed to search and to sort by the first inlink only."""
    rows = filtered(records, query, scope, edges)
    if query.sort and query.sort.startswith("firstInlink"):
        if edges is None:
            raise ValueError("sorting by the first inlink needs the link edges")
        rows = rows.join(links.first_inlinks(records, edges, scope), [*scope, "id"], "left")
    return rows.orderBy(*order(query)).offset(query.offset).limit(min(query.limit, MOST_ROWS))


def response(records: DataFrame, query: GridQuery, edges: DataFrame | None = None, scope: list[str] = audit.SCOPE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page of rows, one-row total, summary per crawl)."""
    total = filtered(records, query, scope, edges).agg(F.count(F.lit(1)).alias("total"))
    return page(records, query, edges, scope), total, audit.summary(records, thresholds=query.thresholds, scope=scope)
