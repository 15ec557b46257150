"""Registered queries of the text operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from siteloom.llm import moderation, neardup, packing, residue, tokenizer
from siteloom.sources.tables import table



def _context(spark, d):
    return moderation.fitted_context(table(spark, d, "moderation_samples"))


QUERIES = {
    "p1_found": lambda spark, d: residue.residue(table(spark, d, "page_captures"), table(spark, d, "crawl_records")),
    "p2_found": lambda spark, d: residue.main_bodies(table(spark, d, "page_captures"), table(spark, d, "crawl_records")),
    "p5_found": lambda spark, d: neardup.near_duplicate_pairs(table(spark, d, "page_captures", "capture_id", "visible_text")),
    "p5_groups": lambda spark, d: neardup.near_duplicate_groups(table(spark, d, "page_captures", "capture_id", "visible_text")),
    "p6_ids": lambda spark, d: tokenizer.document_ids(table(spark, d, "documents", "doc_id", "text")),
    "p7_containers": lambda spark, d: packing.packed_documents(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "container_specs")),
    "p8_found": lambda spark, d: moderation.flagged_documents(table(spark, d, "documents", "doc_id", "text"), _context(spark, d)),
    "p8_scores": lambda spark, d: moderation.document_scores(table(spark, d, "documents", "doc_id", "text", "source"), _context(spark, d)),
    "p8_source_rates": lambda spark, d: moderation.source_rates(table(spark, d, "documents", "doc_id", "text", "source"), _context(spark, d)),
    "p7_fill": lambda spark, d: packing.fill_report(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "container_specs")),
}

#: All pairs by the shingles they share, for the small scale at which it is checked.
SQL = {
    "p5_found": r"""
WITH c AS (SELECT DISTINCT capture_id, visible_text FROM page_captures WHERE capture_id IS NOT NULL AND visible_text IS NOT NULL),
w AS (SELECT capture_id, list_filter(regexp_split_to_array(lower(visible_text), '[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS w FROM c),
s AS (SELECT DISTINCT capture_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT capture_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 120)),
n AS (SELECT capture_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.capture_id AS a, b.capture_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.capture_id < b.capture_id GROUP BY 1, 2)
SELECT p.a AS capture_id_a, p.b AS capture_id_b FROM p JOIN n x ON x.capture_id = p.a JOIN n y ON y.capture_id = p.b WHERE p.k >= 0.7 * (x.n + y.n - p.k) - 1e-9
""",
}
