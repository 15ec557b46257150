"""Queries of the general corpus operators: hot keys and snapshot changes."""

from __future__ import annotations

from siteloom.operators import skew, snapshots
from siteloom.sources.tables import table

QUERIES = {
    "p3_found": lambda spark, d: skew.edge_records(table(spark, d, "link_edges")),
    "p3_address_totals": lambda spark, d: skew.address_totals(table(spark, d, "link_edges")),
    "p4_found": lambda spark, d: snapshots.crawl_changes(table(spark, d, "crawl_records")),
    "p4_change_counts": lambda spark, d: snapshots.crawl_change_counts(table(spark, d, "crawl_records")),
}

_STATES = """
WITH s AS (
  SELECT crawl_id, storage_key, canonical, h1, meta_robots, status_text FROM (
    SELECT *, row_number() OVER (PARTITION BY crawl_id, storage_key ORDER BY completed_at DESC NULLS LAST, id DESC) AS rn
    FROM crawl_records WHERE crawl_id IS NOT NULL AND storage_key IS NOT NULL) WHERE rn = 1),
c AS (SELECT crawl_id, lag(crawl_id) OVER (ORDER BY crawl_id) AS before FROM (SELECT DISTINCT crawl_id FROM s)),
n AS (SELECT s.* FROM s JOIN c USING (crawl_id) WHERE c.before IS NOT NULL),
o AS (SELECT c.crawl_id, s.storage_key, s.canonical, s.h1, s.meta_robots, s.status_text FROM s JOIN c ON s.crawl_id = c.before),
r AS (
  SELECT coalesce(n.crawl_id, o.crawl_id) AS crawl_id, coalesce(n.storage_key, o.storage_key) AS storage_key,
    CASE WHEN o.storage_key IS NULL THEN 'added' WHEN n.storage_key IS NULL THEN 'removed'
      WHEN n.canonical IS DISTINCT FROM o.canonical OR n.h1 IS DISTINCT FROM o.h1 OR n.meta_robots IS DISTINCT FROM o.meta_robots
        OR n.status_text IS DISTINCT FROM o.status_text THEN 'changed' END AS change
  FROM n FULL JOIN o ON n.crawl_id = o.crawl_id AND n.storage_key = o.storage_key)
"""

SQL = {
    "p3_found": """
WITH e AS (SELECT DISTINCT id, source_url, target_url, source_depth, target_depth, discovery_order FROM link_edges),
t AS (SELECT id, source_depth AS d, row_number() OVER w AS n, min(source_depth) OVER (PARTITION BY target_url ORDER BY discovery_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM e WHERE target_url IS NOT NULL WINDOW w AS (PARTITION BY target_url ORDER BY discovery_order)),
s AS (SELECT id, target_depth AS d, row_number() OVER w AS n, max(target_depth) OVER (PARTITION BY source_url ORDER BY discovery_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM e WHERE source_url IS NOT NULL AND target_depth IS NOT NULL WINDOW w AS (PARTITION BY source_url ORDER BY discovery_order))
SELECT 'target' AS side, id AS edge_id FROM t WHERE n = 1 OR d < best
UNION ALL SELECT 'source', id FROM s WHERE n = 1 OR d > best
""",
    "p3_address_totals": """
WITH e AS (SELECT DISTINCT id, source_url, target_url, rel_nofollow FROM link_edges),
u AS (SELECT 'target' AS side, target_url AS address, id, rel_nofollow FROM e UNION ALL SELECT 'source', source_url, id, rel_nofollow FROM e)
SELECT side, address, count(*) AS links, count(*) FILTER (WHERE rel_nofollow) AS nofollow_links, min(id) AS first_edge, max(id) AS last_edge
FROM u WHERE address IS NOT NULL GROUP BY side, address
""",
    "p4_found": _STATES + "SELECT * FROM r WHERE change IS NOT NULL",
    "p4_change_counts": _STATES + "SELECT crawl_id, change, count(*) AS pages FROM r WHERE change IS NOT NULL GROUP BY 1, 2",
}
