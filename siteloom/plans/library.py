"""Queries of the frontier, sitemaps, images, lookups and packages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import url as U
from siteloom.operators import compare, frontier, library, links
from siteloom.plans import synthetic
from siteloom.plans.audit import HTML, R, crawl
from siteloom.plans.comparison import _EVIDENCE, last_two
from siteloom.plans.comparison import SQL as COMPARED
from siteloom.session import checkpointed
from siteloom.sinks import exports, packages
from siteloom.sources import pages
from siteloom.sources.tables import table
from siteloom.streaming import ingest

ROOT = "https://www.istnequogate.example/"
_K = synthetic._url
IMAGES = {
    "page_url": _K("l_suppkey"), "image_url": _K("l_orderkey"), "alt_text": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'line ' || CAST(l_linenumber AS STRING) END", "alt_len": "CAST(l_linenumber % 3 AS BIGINT)",
    "missing_alt": "l_linenumber % 3 = 0", "alt_too_long": "false", "source_position": "CAST(l_linenumber AS BIGINT)", "width": "CAST(NULL AS INT)", "height": "CAST(NULL AS INT)",
}


def images(spark, d):
    """Images on the shop's pages, one for each line of an order; those of orders that stand for images have a response."""
    return table(spark, d, "lineitem").select(*[F.expr(e).alias(c) for c, e in IMAGES.items()])


def _redirected(spark, d):
    """The shop's moved pages with two hops each, the second one of every third back to the first."""
    hop = lambda u: f"named_struct('url', {u}, 'status_code', 301, 'location', final_url, 'dns_lookup_time_ms', CAST(NULL AS BIGINT), 'tcp_connect_time_ms', CAST(NULL AS BIGINT), 'tls_handshake_time_ms', CAST(NULL AS BIGINT), 'ttfb_ms', id, 'elapsed_ms', 2 * id)"
    return synthetic.shop(spark, d).withColumn("redirect_chain", F.expr(f"CASE WHEN status_code = 301 THEN array({hop('url')}, {hop(chr(39) + 'https://shop.test/r/' + chr(39) + ' || CAST(id AS STRING)')}, {hop('CASE WHEN id % 3 = 0 THEN url ELSE final_url || ' + chr(39) + '/x' + chr(39) + ' END')}) ELSE redirect_chain END"))


def _sitemaps(spark, d):
    """Sitemap documents over the addresses of the crawls: files of a few hundred, indexes of a thousand files."""
    urls = crawl(spark, d).where("in_sitemap").select("crawl_id", "id", "final_url").distinct()
    text = F.col("final_url")
    for a, b in (("&", "&amp;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    files = urls.groupBy("crawl_id", F.floor(F.col("id") / 200).alias("part")).agg(F.collect_set(F.concat(F.lit("<url><loc>"), text, F.lit("</loc></url>"))).alias("_e"))
    name = F.concat(F.lit("https://maps.test/"), F.col("crawl_id").cast("string"), F.lit("/"), F.col("part").cast("string"), F.lit(".xml"))
    files = checkpointed(files.select("crawl_id", F.floor(F.col("part") / 1000).alias("of"), name.alias("url"), F.concat(F.lit("<urlset>"), F.array_join("_e", ""), F.lit("</urlset>")).alias("xml")))
    index = files.groupBy("crawl_id", "of").agg(F.collect_list(F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))).alias("_e"))
    index = index.select(F.concat(F.lit("https://maps.test/"), F.col("crawl_id").cast("string"), F.lit("-"), F.col("of").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), F.array_join("_e", ""), F.lit("</sitemapindex>")).alias("xml"))
    return files.select("url", "xml").unionByName(index), index.select("url")


def _tree(spark, d):
    docs, roots = _sitemaps(spark, d)
    return pages.sitemap_tree(docs, roots)


def _locations(spark, d):
    return crawl(spark, d).where("in_sitemap").select(F.col("final_url").alias("location")).distinct()


def _workspace(spark, d):
    kept = compare.Workspace(spark, ingest.working_folder(spark, "comparison")).save(*last_two(spark, d))
    return kept.rows().groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.max("row_key").alias("last_key"))


def _checkpoint(spark, d):
    """The seeds put into a checkpoint, the first hundred then finished and their targets added."""
    queue = checkpointed(frontier.seeds(ROOT, _locations(spark, d), U.is_internal("url", ROOT, "domain")))
    kept = frontier.Checkpoint(spark, ingest.working_folder(spark, "frontier"))
    kept.save(queue, queue.select("url"))
    done = queue.where("position < 100").select("storage_key")
    found = table(spark, d, "link_edges", "source_url", "target_url").join(done.withColumnRenamed("storage_key", "source_url"), "source_url", "left_semi").where("target_url is not null").select(U.without_fragment("target_url").alias("url")).distinct()
    added = found.select(F.lit(1 << 40).alias("position"), "url", F.lit(1).cast("long").alias("depth"), F.lit(False).alias("from_sitemap"), F.col("url").alias("storage_key"), F.lit(None).cast("int").alias("list_position"), F.lit(0).alias("list_duplicate_index"))
    kept.update(done, added)
    return kept.load().select("url", "depth")


def _longest(spark, d):
    """The records with the most words, looked up by id in that order."""
    rows = crawl(spark, d)
    ids = [r[0] for r in rows.select("id", "word_count").distinct().orderBy(F.col("word_count").desc(), "id").limit(200).collect()]
    return library.by_ids(rows, ids).select("id", "final_url")


QUERIES = {
    "image_report": lambda spark, d: links.sized_images(images(spark, d), synthetic.shop(spark, d)).select("page_url", "image_url", "source_position", "missing_alt", "size_bytes", "oversized"),
    "export_images": lambda spark, d: exports.image_rows(images(spark, d), synthetic.shop(spark, d)).where("oversized = 'true'").select("page_url", "image_url", "alt_text", "size_bytes", "width"),
    "export_redirects": lambda spark, d: exports.redirect_rows(_redirected(spark, d)),
    "redirect_loops": lambda spark, d: _redirected(spark, d).where(frontier.redirect_loops()).select("id"),
    "sitemap_tree": _tree,
    "sitemap_membership": lambda spark, d: frontier.in_sitemaps(crawl(spark, d).drop("in_sitemap"), _locations(spark, d).where("location like '%/shop/%'")).where("in_sitemap").select("crawl_id", "id").distinct(),
    "frontier_seeds": lambda spark, d: frontier.seeds(ROOT, _locations(spark, d), U.is_internal("url", ROOT, "domain")).select("position", "url", "from_sitemap"),
    "frontier_checkpoint": _checkpoint,
    "records_by_ids": _longest,
    "measurable_records": lambda spark, d: library.measurable(crawl(spark, d)).select("crawl_id", "id"),
    "incomplete_bodies": lambda spark, d: library.incomplete(crawl(spark, d), 60_000).where("indexability_status = 'Response body incomplete'").select("crawl_id", "id", "indexability").distinct(),
    "capture_faults": lambda spark, d: table(spark, d, "page_captures").where("capture_id is not null").select("capture_id", F.array_join(library.capture_faults(), ",").alias("faults")).distinct(),
    "comparison_workspace": _workspace,
    "report_pages": lambda spark, d: packages.evidence_pages(compare.report_evidence(crawl(spark, d)), ["crawl_id", "evidence_id"], ["evidence_id", "request_url", "observed"]).select("rule", "page", (F.size(F.split("html", "<tr><td>")) - 1).alias("rows")),
}

_IMAGES = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in IMAGES.items()) + " FROM lineitem)"
_SIZED = f"(SELECT i.*, s.size_bytes, coalesce(s.size_bytes > 204800, false) AS oversized FROM {_IMAGES} i LEFT JOIN (SELECT url, size_bytes FROM {synthetic.S} WHERE content_type LIKE 'image/%') s ON s.url = i.image_url)"
_HOPS = f"(SELECT id, url, final_url, unnest([1, 2, 3]) AS n FROM {synthetic.S} WHERE status_code = 301)"
_HOST = "regexp_extract(lower({}), '^https?://([^/?#:]*)', 1)"
_SEEDS = f"(SELECT '{ROOT}' AS url, false AS from_sitemap UNION ALL SELECT DISTINCT regexp_replace(final_url, '#.*$', ''), true FROM {R} WHERE in_sitemap AND regexp_matches({_HOST.format('final_url')}, '(^|[.])istnequogate[.]example$') AND regexp_replace(final_url, '#.*$', '') <> '{ROOT}')"
_NUMBERED = f"(SELECT row_number() OVER (ORDER BY from_sitemap, url) - 1 AS position, url, from_sitemap FROM {_SEEDS})"

SQL = {
    "image_report": f"SELECT page_url, image_url, source_position, missing_alt, size_bytes, oversized FROM {_SIZED}",
    "export_images": f"SELECT page_url, image_url, coalesce(alt_text, '') AS alt_text, CAST(size_bytes AS VARCHAR) AS size_bytes, '' AS width FROM {_SIZED} WHERE oversized",
    "export_redirects": f"SELECT CAST(id AS VARCHAR) AS record_id, url AS source_url, final_url, CAST(n AS VARCHAR) AS hop_index, CASE n WHEN 1 THEN url WHEN 2 THEN 'https://shop.test/r/' || id ELSE CASE WHEN id % 3 = 0 THEN url ELSE final_url || '/x' END END AS hop_url, '301' AS status_code, final_url AS location, '' AS dns_lookup_time_ms, '' AS tcp_connect_time_ms, '' AS tls_handshake_time_ms, CAST(id AS VARCHAR) AS ttfb_ms, CAST(2 * id AS VARCHAR) AS elapsed_ms FROM {_HOPS}",
    "redirect_loops": f"SELECT id FROM {synthetic.S} WHERE status_code = 301 AND id % 3 = 0",
    "sitemap_tree": f"SELECT DISTINCT regexp_replace(regexp_replace(final_url, '#.*$', ''), '^(https?://[^/?#]+)($|[?#])', '\\1/\\2') AS location, 1 AS depth FROM {R} WHERE in_sitemap AND regexp_matches(final_url, '^https?://')",
    "sitemap_membership": f"WITH l AS (SELECT DISTINCT final_url AS u FROM {R} WHERE in_sitemap AND final_url LIKE '%/shop/%') SELECT crawl_id, id FROM {R} WHERE url IN (SELECT u FROM l) OR final_url IN (SELECT u FROM l)",
    "frontier_seeds": f"SELECT * FROM {_NUMBERED}",
    "frontier_checkpoint": f"WITH q AS (SELECT * FROM {_NUMBERED}), a AS (SELECT DISTINCT regexp_replace(target_url, '#.*$', '') AS url FROM link_edges WHERE target_url IS NOT NULL AND source_url IN (SELECT url FROM q WHERE position < 100)) SELECT url, 0 AS depth FROM q WHERE position >= 100 UNION ALL SELECT url, 1 FROM a WHERE url NOT IN (SELECT url FROM q)",
    "records_by_ids": f"SELECT id, final_url FROM {R} ORDER BY word_count DESC, id LIMIT 200",
    "measurable_records": f"SELECT crawl_id, id FROM {R} WHERE {HTML} AND regexp_matches(final_url, '^https?://[^/@]+(/|\\?|#|$)')",
    "incomplete_bodies": f"SELECT crawl_id, id, CASE WHEN coalesce(size_bytes > 60000, false) AND coalesce(status_code BETWEEN 200 AND 299, false) THEN 'Non-indexable' ELSE indexability END AS indexability FROM {R} WHERE (size_bytes > 60000 AND status_code BETWEEN 200 AND 299) OR indexability_status = 'Response body incomplete'",
    "capture_faults": "SELECT DISTINCT capture_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(coalesce(source_url, ''), '^https?://[^/?#]+') THEN 'source_url' END, CASE WHEN NOT regexp_matches(coalesce(final_url, ''), '^https?://[^/?#]+') THEN 'final_url' END, CASE WHEN strlen(raw_html) > 8388608 THEN 'raw_html' END, CASE WHEN strlen(rendered_html) > 8388608 THEN 'rendered_html' END, CASE WHEN strlen(visible_text) > 4194304 THEN 'visible_text' END, CASE WHEN strlen(response_headers) > 262144 OR len(string_split(response_headers, chr(10))) > 256 THEN 'response_headers' END], lambda x: x IS NOT NULL), ',') AS faults FROM page_captures WHERE capture_id IS NOT NULL",
    "comparison_workspace": f"SELECT change, count(*) AS n, max(row_key) AS last_key FROM ({COMPARED['compare_row_keys']}) GROUP BY 1",
    "report_pages": f"WITH c AS (SELECT rule, count(*) AS n FROM ({_EVIDENCE}) GROUP BY 1) SELECT rule, page, least(1000, n - 1000 * (page - 1)) AS rows FROM (SELECT rule, n, unnest(range(1, CAST(ceil(n / 1000.0) AS BIGINT) + 1)) AS page FROM c)",
}
