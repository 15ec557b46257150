"""Queries of grid, link, anchor, sitemap, graph and reference reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import audit, graph, grid, links, references
from siteloom.plans.audit import BROKEN, CONDITIONS, HTML, NONE, ROBOTS, RULE_CONDITIONS, SUMMARY, R, crawl, key, message_sql
from siteloom.sources.tables import table

SCOPE = audit.SCOPE


def edges(spark, d):
    return links.known_edges(table(spark, d, "link_edges"))


def related(spark, d):
    """Records with the relations that page_references holds of their storage key: language links, next pages, AMP pages.

    The lists are as long as one page's references.
    """
    refs = links.references(table(spark, d, "page_references"))
    per = refs.where("source_storage_key is not null").groupBy("source_storage_key").agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "hreflang", F.col("target_url")))).alias("_h"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "pagination", F.col("target_url")))).alias("_n"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "amp", F.col("target_url")))).alias("_a"),
    )
    df = crawl(spark, d).join(per, F.col("storage_key") == F.col("source_storage_key"), "left")
    links_of = F.coalesce(F.transform("_h", lambda u: F.struct(F.lit("x").alias("hreflang"), u.alias("url"), F.lit(True).alias("valid"))), F.array().cast("array<struct<hreflang:string,url:string,valid:boolean>>"))
    return df.withColumns({"hreflang_links": links_of, "rel_next_targets": F.col("_n"), "amphtml_targets": F.col("_a")}).drop("_h", "_n", "_a", "source_storage_key")


E = "(SELECT DISTINCT * FROM link_edges WHERE id IS NOT NULL)"


def host(c: str) -> str:
    return f"nullif(regexp_extract(lower({c}), '^https?://([^/?#:]*)', 1), '')"


INTERNAL = f"coalesce({host('source_url')} = {host('target_url')}, false)"


def serial(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '^https?://') THEN regexp_replace(trim({c}), '^(https?://[^/?#]+)($|[?#])', '\\1/\\2') END"


def names(c: str) -> str:
    """The aliases of a plain address."""
    s = serial(c)
    bare = f"regexp_replace({s}, '#.*$', '')"
    root = f"CASE WHEN regexp_matches({bare}, '^https?://[^/?#]+/(\\?.*)?$') THEN regexp_replace({bare}, '^(https?://[^/?#]+)/', '\\1') END"
    return f"list_filter(list_distinct([nullif(trim({c}), ''), {s}, {bare}, {root}]), lambda x: x IS NOT NULL)"


ALL = f"list_distinct(list_concat(list_concat({names('storage_key')}, {names('url')}), {names('final_url')}))"
NAMED = f"(SELECT crawl_id, id, unnest({ALL}) AS alias FROM {R})"
EDGE = "id, source_url, target_url, anchor_text, link_type, rel_nofollow, target_status_code"
FAILED = f"(SELECT DISTINCT unnest({ALL}) AS a FROM {R} WHERE {BROKEN})"
ANCHOR = key("anchor_text")
EDGE_COLUMNS = [c.strip() for c in EDGE.split(",")]


def _edges(view):
    return lambda spark, d: links.edge_view(edges(spark, d), view, crawl(spark, d) if view == "broken" else None).select(*EDGE_COLUMNS)


def _grid(q, ordered=False):
    found = lambda rows, linked: grid.page(rows, q, linked) if ordered else grid.filtered(rows, q, edges=linked)
    return lambda spark, d: found(crawl(spark, d), edges(spark, d) if q.search else None).select("crawl_id", "id", "final_url")


def _rule(*args):
    return grid.Rule(*args)


def _flags(make, *flags, source=crawl):
    return lambda spark, d: make(source(spark, d), SCOPE).where(" or ".join(flags)).select("crawl_id", "id", *flags)


GRIDS = {
    "grid_search": (grid.GridQuery(search="Museum"), None),
    "grid_segment_contains": (grid.GridQuery(segment="/Guide/"), "lower(url) LIKE '%/guide/%' OR lower(final_url) LIKE '%/guide/%'"),
    "grid_segment_regex": (grid.GridQuery(segment=r"/(guide|shop)/[a-z-]*[0-9]$", segment_regex=True), r"regexp_matches(url, '/(guide|shop)/[a-z-]*[0-9]$') OR regexp_matches(final_url, '/(guide|shop)/[a-z-]*[0-9]$')"),
    "grid_filter_all": (grid.GridQuery(rules=(_rule("statusCode", "equals", "200"), _rule("wordCount", "greaterThan", "300"), _rule("title", "contains", "Copper"))), f"status_code = 200 AND word_count > 300 AND {key('title')} LIKE '%copper%'"),
    "grid_filter_any": (grid.GridQuery(rules=(_rule("statusCode", "greaterThan", "399"), _rule("canonical", "isEmpty"), _rule("depth", "lessThan", "1")), match_any=True), f"coalesce(status_code > 399, false) OR {key('canonical')} = '' OR depth < 1"),
    "grid_text_not_equals": (grid.GridQuery(view="Internal", rules=(_rule("indexability", "notEquals", "indexable"), _rule("title", "notContains", "oak"))), f"classification = 'internal' AND {key('indexability')} <> 'indexable' AND {key('title')} NOT LIKE '%oak%'"),
    "grid_numeric_fractional": (grid.GridQuery(rules=(_rule("responseTimeMs", "greaterThan", "250.5"), _rule("statusCode", "notEquals", "200.5"))), "response_time_ms > 250.5 AND status_code IS NOT NULL"),
    "grid_view_and_filter": (grid.GridQuery(view="TitleDuplicate", rules=(_rule("depth", "greaterThan", "1"),)), f"{CONDITIONS['TitleDuplicate']} AND depth > 1"),
}
_LOW = "lower(coalesce({}, ''))"
_MUSEUM = " OR ".join(f"{_LOW.format(f'CAST({c} AS VARCHAR)')} LIKE '%museum%'" for c in "url final_url status_text content_type indexability indexability_status title meta_robots x_robots_tag h1 canonical redirect_target response_hash error classification".split())

_REFS = """
refs AS (SELECT DISTINCT id, source_storage_key, target_url, kind FROM page_references WHERE id IS NOT NULL),
"""
_ATTRS = f"""
attrs AS (SELECT *, {HTML} AS eligible, {NONE} OR coalesce(status_code BETWEEN 400 AND 599, false) OR (coalesce(status_code BETWEEN 300 AND 399, false) AND error IS NOT NULL) AS target_error,
  status_code IS NOT NULL OR {NONE} AS observed, status_code IS NOT NULL OR error IS NOT NULL OR {ROBOTS} AS fetched, coalesce(status_code BETWEEN 300 AND 399, false) AS is_3xx, {BROKEN} AS is_broken,
  {ROBOTS} OR (indexability = 'Non-indexable' AND NOT {BROKEN} AND NOT coalesce(status_code BETWEEN 300 AND 399, false)) AS non_index FROM {R}),
cand AS (SELECT crawl_id, unnest({names('url')}) AS alias, fetched, observed, 0 AS p, id, is_3xx AS redirect FROM attrs
  UNION ALL SELECT crawl_id, unnest({names('final_url')}), fetched, observed AND coalesce(error, '') <> 'Redirect limit exceeded', 2, id, is_3xx FROM attrs),
best AS (SELECT crawl_id, alias, min({{'u': NOT fetched, 'p': p, 'id': id, 'r': redirect}}) AS b, min({{'u': NOT fetched, 'p': p, 'id': id, 'r': redirect}}) FILTER (WHERE observed) AS o FROM cand GROUP BY 1, 2)
"""


def _target_errors(kind: str, flag: str) -> str:
    own = f"list_concat({names('a.url')}, {names('a.final_url')})"
    return f"""
WITH {_REFS} {_ATTRS},
t AS (SELECT a.crawl_id, a.id, r.target_url AS u, list_has_any({own}, {names('r.target_url')}) AS own FROM attrs a JOIN (SELECT DISTINCT source_storage_key, target_url FROM refs WHERE kind = '{kind}') r ON r.source_storage_key = a.storage_key WHERE a.eligible),
x AS (SELECT t.crawl_id, t.id, t.u, t.own, min(best.o) AS o FROM (SELECT *, unnest({names('u')}) AS alias FROM t) t LEFT JOIN best ON best.crawl_id = t.crawl_id AND best.alias = t.alias GROUP BY ALL)
SELECT DISTINCT x.crawl_id, x.id, true AS {flag} FROM x JOIN attrs g ON g.crawl_id = x.crawl_id AND g.id = CASE WHEN x.own THEN x.id ELSE x.o.id END WHERE g.target_error
"""


CANONICAL = f"""
WITH {_ATTRS},
s AS (SELECT *, {names('canonical')} AS n, list_has_any(list_concat({names('url')}, {names('final_url')}), {names('canonical')}) AS own FROM attrs WHERE eligible AND regexp_matches(trim(coalesce(canonical, '')), '(?i)^https?://')),
b AS (SELECT s.crawl_id, s.id, min(best.b) AS b FROM (SELECT crawl_id, id, unnest(n) AS alias FROM s) s LEFT JOIN best ON best.crawl_id = s.crawl_id AND best.alias = s.alias GROUP BY 1, 2),
t AS (SELECT s.*, CASE WHEN own THEN s.id ELSE b.b.id END AS target, CASE WHEN own THEN s.is_3xx ELSE b.b.r END AS redirect FROM s JOIN b ON b.crawl_id = s.crawl_id AND b.id = s.id),
g AS (SELECT t.crawl_id, t.id, t.own, t.classification, t.target, t.redirect, t.canonical, t.final_url, a.fetched AS tf, a.is_broken AS tb, a.non_index AS tn, a.eligible AS te, a.final_url AS tu,
  f.id IS NOT NULL AS far FROM t LEFT JOIN attrs a ON a.crawl_id = t.crawl_id AND a.id = t.target LEFT JOIN (SELECT crawl_id, id FROM t WHERE NOT own) f ON f.crawl_id = t.crawl_id AND f.id = t.target),
k AS (SELECT *, target IS NULL OR NOT coalesce(tf, false) AS unknown FROM g)
SELECT crawl_id, id, unknown AND classification = 'internal' AND coalesce({host('trim(canonical)')} = {host('final_url')}, false) AS canonical_uncrawled, NOT unknown AND coalesce(redirect, false) AS canonical_to_redirect,
  NOT unknown AND coalesce(tb, false) AS canonical_to_error, NOT unknown AND coalesce(tn, false) AS canonical_non_indexable,
  NOT unknown AND NOT own AND regexp_replace({serial('final_url')}, '#.*$', '') <> regexp_replace({serial('tu')}, '#.*$', '') AND coalesce(te, false) AND far AS canonical_chain FROM k
"""
_CANONICAL_FLAGS = references.FLAGS[:5]
#: A path of single targets with more steps than any chain without a loop is taken to have.
CANONICAL_LOOP = CANONICAL.replace("WITH ", "WITH RECURSIVE ", 1).rsplit("SELECT crawl_id, id, unknown", 1)[0].rstrip() + f""",
e AS (SELECT crawl_id, id, target FROM k WHERE NOT unknown AND NOT own AND coalesce(te, false) AND regexp_replace({serial('final_url')}, '#.*$', '') <> regexp_replace({serial('tu')}, '#.*$', '')),
w(crawl_id, id, a, steps) AS (SELECT crawl_id, id, target, 1 FROM e UNION ALL SELECT w.crawl_id, w.id, e.target, w.steps + 1 FROM w JOIN e ON e.crawl_id = w.crawl_id AND e.id = w.a WHERE w.steps < 40)
SELECT crawl_id, id, true AS canonical_loop FROM w WHERE steps = 40
"""

_HREFLANG = f"""
WITH {_REFS} named AS {NAMED}, prim AS (SELECT crawl_id, alias, min(id) AS target FROM named GROUP BY 1, 2),
l AS (SELECT a.crawl_id, a.id, {HTML} AS eligible, r.target_url AS u, {names('r.target_url')} AS n, {ALL} AS own FROM {R} a JOIN (SELECT DISTINCT source_storage_key, target_url FROM refs WHERE kind = 'hreflang') r ON r.source_storage_key = a.storage_key),
x AS (SELECT l.crawl_id, l.id, l.eligible, l.u, list_has_any(l.own, l.n) AS self, min(prim.target) AS target FROM (SELECT *, unnest(n) AS alias FROM l) l LEFT JOIN prim ON prim.crawl_id = l.crawl_id AND prim.alias = l.alias GROUP BY ALL)
"""

QUERIES = {
    **{f"link_edges_{v}": _edges(v) for v in ("all", "internal", "external", "nofollow", "broken")},
    "inlink_counts": lambda spark, d: links.inlink_counts(edges(spark, d)),
    "inlinks_of_records": lambda spark, d: links.inlinks(crawl(spark, d), edges(spark, d), SCOPE),
    "first_inlinks": lambda spark, d: links.first_inlinks(crawl(spark, d), edges(spark, d), SCOPE),
    "outlink_counts": lambda spark, d: links.outlink_counts(edges(spark, d)),
    "anchor_texts": lambda spark, d: links.anchor_texts(edges(spark, d)),
    "edge_endpoints": lambda spark, d: links.resolved_edges(edges(spark, d), crawl(spark, d)).select("id", "source_status_code", "source_depth", "target_status_code", "target_depth"),
    "page_reference_kinds": lambda spark, d: links.references(table(spark, d, "page_references")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_storage_key").alias("sources"), F.count_if("rel_nofollow").alias("nofollow")),
    "sitemap_validation": lambda spark, d: links.sitemap_report(crawl(spark, d), SCOPE).select("crawl_id", "id", "final_url", "issues", "issue_count", "severity"),
    "exact_duplicate_groups": lambda spark, d: links.exact_duplicate_groups(crawl(spark, d), SCOPE),
    **{n: _grid(q) for n, (q, _) in GRIDS.items()},
    "grid_sort_page": _grid(grid.GridQuery(view="Internal", sort="wordCount", descending=True, offset=20, limit=50), True),
    "canonical_flags": _flags(references.canonical_flags, *_CANONICAL_FLAGS),
    "canonical_loops": _flags(references.canonical_flags, "canonical_loop"),
    "hreflang_return": _flags(references.hreflang_flags, "hreflang_missing_return", source=related),
    "hreflang_canonical": _flags(references.hreflang_flags, "hreflang_non_canonical", source=related),
    "pagination_next_errors": _flags(references.relation_flags, "next_to_error", source=related),
    "amp_errors": _flags(references.relation_flags, "amp_to_error", source=related),
    "relation_flags": lambda spark, d: references.relation_flags(related(spark, d), SCOPE),
    "view_multiple_targets": lambda spark, d: audit.flagged(related(spark, d), ["PaginationMultipleTargets", "AmpMultipleTargets"], any_of=True).select("crawl_id", "id", "PaginationMultipleTargets", "AmpMultipleTargets"),
    "graph_nodes": lambda spark, d: graph.graph_nodes(crawl(spark, d), SCOPE).select("crawl_id", "url", "first_id", "status_code", "depth", "label", "section"),
    "graph_edges": lambda spark, d: graph.graph_edges(edges(spark, d), internal_only=True).select("id", "source_url", "target_url", "link_type"),
    "graph_sections": lambda spark, d: graph.sections(graph.graph_nodes(crawl(spark, d), SCOPE), SCOPE),
    "url_tree": lambda spark, d: graph.url_tree(crawl(spark, d), SCOPE),
    "frontier_bfs": lambda spark, d: graph.frontier_levels(edges(spark, d), edges(spark, d).where("source_depth = 0").select(F.col("source_url").alias("url")), max_depth=None),
    "near_duplicate_clusters": lambda spark, d: graph.near_duplicate_clusters(table(spark, d, "page_captures", "capture_id", "visible_text"), "capture_id", "visible_text"),
}

_TREE = f"""
WITH p AS (SELECT crawl_id, status_code, {NONE} AS none, {BROKEN} AS bad, regexp_extract(final_url, '^(https?://[^/?#]*)', 1) AS origin, list_filter(string_split(regexp_extract(final_url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
  regexp_extract(final_url, '^[^?#]*(\\?[^#]*)', 1) AS q FROM {R} WHERE regexp_matches(final_url, '^https?://')),
l AS (SELECT *, list_concat(list_concat([origin], CASE WHEN len(parts) > 0 THEN [origin || '/' || array_to_string(parts[1:i], '/') FOR i IN range(1, len(parts) + 1)] ELSE [origin || '/'] END),
  CASE WHEN q <> '' THEN [origin || '/' || array_to_string(parts, '/') || q] ELSE [] END) AS paths FROM p),
x AS (SELECT crawl_id, status_code, none, bad, unnest(paths) AS path, unnest(range(1, len(paths) + 1)) AS segments FROM l)
SELECT crawl_id, path, segments, count(*) AS total, count(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS success, count(*) FILTER (WHERE status_code BETWEEN 300 AND 399) AS redirects,
  count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (WHERE status_code >= 500) AS server_errors, count(*) FILTER (WHERE none) AS no_response, count(*) FILTER (WHERE bad) AS broken FROM x GROUP BY 1, 2, 3
"""
_LABEL = "CASE WHEN regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN regexp_extract(u, '^https?://([^/?#:]*)', 1) ELSE regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) || regexp_extract(u, '^[^?#]*(\\?[^#]*)', 1) END"
_SECTION = "regexp_extract(u, '^https?://([^/?#:]*)', 1) || '/' || coalesce(list_filter(string_split(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1], '')"
_NODES = f"""
SELECT crawl_id, u AS url, first_id, status_code, depth, {_LABEL} AS label, {_SECTION} AS section FROM (
  SELECT crawl_id, final_url AS u, arg_min(id, (coalesce(list_position, id), id)) AS first_id, arg_max_null(status_code, (coalesce(list_position, id), id)) AS status_code, arg_max_null(depth, (coalesce(list_position, id), id)) AS depth FROM {R} GROUP BY 1, 2)
"""
_ISSUES = [
    (ROBOTS, "Robots-blocked URL in sitemap", 1), (NONE, "No response URL in sitemap", 2), ("status_code BETWEEN 300 AND 399", "Redirecting URL in sitemap", 1), ("status_code BETWEEN 400 AND 499", "4xx URL in sitemap", 2), ("status_code BETWEEN 500 AND 599", "5xx URL in sitemap", 2),
    ("indexability <> 'Indexable' OR indexability_status <> 'Indexable'", "Non-indexable URL in sitemap", 1), ("trim(coalesce(canonical, '')) <> '' AND trim(canonical) <> final_url", "Canonical points to a different URL", 1), ("trim(coalesce(redirect_target, '')) <> ''", "Sitemap URL has a redirect target", 1),
    ("classification = 'external'", "External URL in sitemap", 1), ("inlink_count = 0 AND classification <> 'external'", "Orphan URL in sitemap", 1), (f"NOT {ROBOTS} AND trim(coalesce(error, '')) <> ''", "Fetch error for sitemap URL", 2),
]
_HITS = "list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{label}' END" for c, label, _ in _ISSUES) + "], lambda x: x IS NOT NULL)"
_RANK = "greatest(0, " + ", ".join(f"CASE WHEN coalesce({c}, false) THEN {r} ELSE 0 END" for c, _, r in _ISSUES) + ")"

_FIRST = f"SELECT crawl_id, id, source_url AS first_inlink_source_url, anchor_text AS first_inlink_anchor_text, source_position AS first_inlink_source_position FROM (SELECT n.crawl_id, n.id, e.source_url, e.anchor_text, e.source_position, row_number() OVER (PARTITION BY n.crawl_id, n.id ORDER BY e.discovery_order, e.source_position, e.source_url NULLS FIRST, e.id) AS k FROM {NAMED} n JOIN {E} e ON e.target_url = n.alias) WHERE k = 1"
_LINKED = " OR ".join(f"{_LOW.format(f'CAST({c} AS VARCHAR)')} LIKE '%museum%'" for c in grid.SEARCHED_INLINK)
_RULE_VIEWS = {f"canonical.{n}": f"canonical_{n}" for n in ("uncrawled", "to_redirect", "to_error", "non_indexable", "chain")}


def _rule_sql(rule: str) -> str:
    view, severity, text = audit.RULES[rule]
    shown = "BrokenLinks" if view.startswith(("Status", "_")) else view
    says = {"text_percent": "printf('%.1f', text_to_code_ratio * 100)"}
    source = f"(SELECT r.* FROM {R} r JOIN ({CANONICAL}) c USING (crawl_id, id) WHERE c.{_RULE_VIEWS[rule]})" if rule in _RULE_VIEWS else f"(SELECT r.* FROM {R} r JOIN ({CANONICAL_LOOP}) c USING (crawl_id, id))" if rule == "canonical.loop" else R
    return f"SELECT crawl_id, id, final_url AS url, '{rule}' AS rule, '{severity}' AS severity, '{shown}' AS view, {message_sql(text, says)} AS message FROM {source} WHERE {RULE_CONDITIONS.get(rule) or CONDITIONS.get(view, 'true')}"


#: Rules whose columns the tables at hand have, or whose absence is a finding of its own.
_LONG = " UNION ALL ".join(_rule_sql(r) for r, (v, _, _) in audit.RULES.items() if v in CONDITIONS or r in RULE_CONDITIONS or r in _RULE_VIEWS or r == "canonical.loop")

_REFERENCED = ", ".join(f"count(*) FILTER (WHERE {f'coalesce(c.{n}, false)' if n in _CANONICAL_FLAGS else 'l.id IS NOT NULL'}) AS {n}" for n in audit.REFERENCE_COUNTERS if n.startswith("canonical_"))

SITEMAP_SQL = f"SELECT *, CASE WHEN len(h) > 0 THEN array_to_string(h, '; ') ELSE 'OK' END AS issues, ['info', 'warning', 'error'][r + 1] AS severity FROM (SELECT *, {_HITS} AS h, {_RANK} AS r FROM {R} WHERE in_sitemap)"

SQL = {
    "issues_long": _LONG,
    "issues_by_rule": f"SELECT crawl_id, rule, severity, count(*) AS issues FROM ({_LONG}) GROUP BY 1, 2, 3",
    "link_edges_all": f"SELECT {EDGE} FROM {E}",
    "link_edges_internal": f"SELECT {EDGE} FROM {E} WHERE {INTERNAL}",
    "link_edges_external": f"SELECT {EDGE} FROM {E} WHERE NOT {INTERNAL}",
    "link_edges_nofollow": f"SELECT {EDGE} FROM {E} WHERE rel_nofollow",
    "link_edges_broken": f"SELECT {EDGE} FROM {E} WHERE coalesce(target_status_code >= 400, false) OR target_url IN (SELECT a FROM {FAILED})",
    "inlink_counts": f"SELECT target_url AS url, count(*) AS count FROM {E} WHERE target_url IS NOT NULL GROUP BY 1",
    "inlinks_of_records": f"WITH c AS (SELECT target_url, count(*) AS n FROM {E} WHERE target_url IS NOT NULL GROUP BY 1), s AS (SELECT n.crawl_id, n.id, sum(c.n) AS s FROM {NAMED} n JOIN c ON c.target_url = n.alias GROUP BY 1, 2) SELECT r.crawl_id, r.id, CAST(coalesce(s.s, 0) AS BIGINT) AS inlinks FROM {R} r LEFT JOIN s USING (crawl_id, id)",
    "first_inlinks": _FIRST,
    "outlink_counts": f"SELECT source_url, count(*) AS outlinks, count(*) FILTER (WHERE {INTERNAL}) AS internal_outlinks, count(*) FILTER (WHERE NOT {INTERNAL}) AS external_outlinks FROM {E} WHERE source_url IS NOT NULL GROUP BY 1",
    "anchor_texts": f"SELECT {ANCHOR} AS anchor_key, target_url, link_type, min(anchor_text) AS anchor_text, count(*) AS link_count, count(DISTINCT source_url) AS source_count, count(*) FILTER (WHERE rel_nofollow) AS nofollow_count, min(source_url) AS example_source_url, max(target_status_code) AS target_status_code FROM {E} GROUP BY ALL",
    "edge_endpoints": f"WITH n AS (SELECT alias, max(id) AS id FROM {NAMED} GROUP BY 1) SELECT e.id, CASE WHEN s.id IS NULL THEN e.source_status_code ELSE rs.status_code END AS source_status_code, CASE WHEN s.id IS NULL THEN e.source_depth ELSE rs.depth END AS source_depth, CASE WHEN t.id IS NULL THEN e.target_status_code ELSE rt.status_code END AS target_status_code, CASE WHEN t.id IS NULL THEN e.target_depth ELSE rt.depth END AS target_depth FROM {E} e LEFT JOIN n s ON s.alias = e.source_url LEFT JOIN {R} rs ON rs.id = s.id LEFT JOIN n t ON t.alias = e.target_url LEFT JOIN {R} rt ON rt.id = t.id",
    "page_reference_kinds": "SELECT kind, count(*) AS n, count(DISTINCT source_storage_key) AS sources, count(*) FILTER (WHERE rel_nofollow) AS nofollow FROM (SELECT DISTINCT * FROM page_references WHERE id IS NOT NULL) GROUP BY 1",
    "sitemap_validation": f"SELECT crawl_id, id, final_url, CASE WHEN len(h) > 0 THEN array_to_string(h, '; ') ELSE 'OK' END AS issues, greatest(len(h), 1) AS issue_count, ['info', 'warning', 'error'][r + 1] AS severity FROM (SELECT *, {_HITS} AS h, {_RANK} AS r FROM {R} WHERE in_sitemap)",
    "exact_duplicate_groups": f"SELECT crawl_id, response_hash, count(DISTINCT regexp_replace(final_url, '#.*$', '')) AS addresses, count(*) AS records FROM {R} WHERE {HTML} AND response_hash IS NOT NULL GROUP BY 1, 2 HAVING addresses > 1",
    **{n: f"SELECT crawl_id, id, final_url FROM {R} WHERE {c}" for n, (_, c) in GRIDS.items() if c},
    "grid_search": f"SELECT r.crawl_id, r.id, r.final_url FROM {R} r LEFT JOIN ({_FIRST}) f USING (crawl_id, id) WHERE {_MUSEUM} OR {_LINKED}",
    "grid_sort_page": f"SELECT crawl_id, id, final_url FROM {R} WHERE classification = 'internal' ORDER BY word_count DESC NULLS LAST, id OFFSET 20 LIMIT 50",
    "canonical_flags": f"SELECT * FROM ({CANONICAL}) WHERE {' OR '.join(_CANONICAL_FLAGS)}",
    "canonical_loops": CANONICAL_LOOP,
    "view_canonical_loop": f"SELECT l.crawl_id, l.id, r.final_url FROM ({CANONICAL_LOOP}) l JOIN {R} r USING (crawl_id, id)",
    **{f"view_{f}": f"SELECT c.crawl_id, c.id, r.final_url FROM ({CANONICAL}) c JOIN {R} r USING (crawl_id, id) WHERE c.{f}" for f in _CANONICAL_FLAGS},
    "reference_counts": "SELECT r.crawl_id, " + _REFERENCED + f", count(*) FILTER (WHERE indexability = 'Indexable') AS indexable, count(*) FILTER (WHERE indexability = 'Non-indexable') AS non_indexable FROM {R} r LEFT JOIN ({CANONICAL}) c USING (crawl_id, id) LEFT JOIN ({CANONICAL_LOOP}) l USING (crawl_id, id) GROUP BY 1",
    "summary": f"SELECT * FROM (SELECT crawl_id, {SUMMARY} FROM {R} GROUP BY 1) JOIN (SELECT r.crawl_id, {_REFERENCED} FROM {R} r LEFT JOIN ({CANONICAL}) c USING (crawl_id, id) LEFT JOIN ({CANONICAL_LOOP}) l USING (crawl_id, id) GROUP BY 1) USING (crawl_id)",
    "hreflang_return": f"{_HREFLANG} SELECT DISTINCT x.crawl_id, x.id, true AS hreflang_missing_return FROM x WHERE x.eligible AND NOT x.self AND x.target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l b JOIN l o ON o.crawl_id = x.crawl_id AND o.id = x.id WHERE b.crawl_id = x.crawl_id AND b.id = x.target AND list_has_any(b.n, o.own))",
    "hreflang_canonical": f"{_HREFLANG} SELECT DISTINCT x.crawl_id, x.id, true AS hreflang_non_canonical FROM x JOIN (SELECT crawl_id, id, canonical, {ALL} AS own FROM {R}) t ON t.crawl_id = x.crawl_id AND t.id = x.target WHERE x.eligible AND trim(coalesce(t.canonical, '')) <> '' AND NOT list_has_any({names('t.canonical')}, t.own)",
    "pagination_next_errors": _target_errors("pagination", "next_to_error"),
    "amp_errors": _target_errors("amp", "amp_to_error"),
    "view_multiple_targets": f"WITH {_REFS.rstrip().rstrip(',')}, c AS (SELECT source_storage_key AS k, count(DISTINCT target_url) FILTER (WHERE kind = 'pagination') AS n, count(DISTINCT target_url) FILTER (WHERE kind = 'amp') AS a FROM refs GROUP BY 1) SELECT crawl_id, id, n > 1 AS \"PaginationMultipleTargets\", a > 1 AS \"AmpMultipleTargets\" FROM {R} JOIN c ON k = storage_key WHERE {HTML} AND (n > 1 OR a > 1)",
    "graph_nodes": _NODES,
    "graph_edges": f"SELECT id, source_url, target_url, link_type FROM {E} WHERE source_url IS NOT NULL AND target_url IS NOT NULL AND {INTERNAL}",
    "graph_sections": f"SELECT crawl_id, section, count(*) AS nodes, count(*) FILTER (WHERE status_code >= 400) AS broken FROM ({_NODES}) GROUP BY 1, 2",
    "url_tree": _TREE,
    "frontier_bfs": f"""
WITH RECURSIVE e AS (SELECT DISTINCT regexp_replace(source_url, '#.*$', '') AS s, regexp_replace(target_url, '#.*$', '') AS t FROM {E} WHERE source_url IS NOT NULL AND target_url IS NOT NULL AND NOT coalesce(rel_nofollow, false)),
b(url, depth) AS (SELECT DISTINCT regexp_replace(source_url, '#.*$', ''), 0 FROM {E} WHERE source_depth = 0 AND source_url IS NOT NULL UNION SELECT e.t, b.depth + 1 FROM b JOIN e ON e.s = b.url WHERE b.depth < 12)
SELECT url, min(depth) AS depth FROM b GROUP BY 1
""",
}
