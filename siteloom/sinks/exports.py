"""Exports with fixed columns: every cell is text, an unknown value is empty. The executors write the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import url as U
from siteloom.operators import compare, links
from siteloom.sinks.files import guarded, write_csv
from siteloom.sources.schema import once

# The columns of the exports, in order.
RECORD_COLUMNS = [
    "id",
    "url",
    "final_url",
    "classification",
    "status_code",
    "status_text",
    "content_type",
    "indexability",
    "indexability_status",
    "response_time_ms",
    "dns_lookup_time_ms",
    "ttfb_ms",
    "download_time_ms",
    "total_network_time_ms",
    "transfer_rate_bytes_per_sec",
    "resolved_ip_count",
    "size_bytes",
    "response_hash",
    "word_count",
    "text_to_code_ratio",
    "simhash",
    "near_duplicate_cluster_id",
    "depth",
    "redirect_target",
    "title",
    "title_len",
    "meta_description",
    "meta_description_len",
    "meta_robots",
    "x_robots_tag",
    "h1",
    "h1_len",
    "h1_count",
    "h2",
    "h2_len",
    "h2_count",
    "canonical",
    "canonical_count",
    "image_count",
    "images_missing_alt",
    "images_alt_too_long",
    "mixed_content_count",
    "insecure_form_count",
    "hsts_header",
    "content_security_policy_header",
    "x_frame_options_header",
    "x_content_type_options_header",
    "viewport",
    "amphtml",
    "rel_next",
    "rel_prev",
    "hreflang_count",
    "hreflang_invalid_count",
    "hreflang_missing_self_reference",
    "json_ld_count",
    "json_ld_invalid_count",
    "structured_data_error_count",
    "structured_data_warning_count",
    "structured_data_issues",
    "open_graph_count",
    "twitter_card_count",
    "deprecated_html_tag_count",
    "duplicate_id_count",
    "js_rendered",
    "rendered_dom_changed",
    "rendered_word_count_delta",
    "rendered_link_count_delta",
    "inlink_count",
    "outlink_count",
    "internal_outlink_count",
    "external_outlink_count",
    "custom_extractions",
    "custom_searches",
    "error",
    "in_sitemap",
    "storage_key",
    "list_position",
    "list_duplicate_index",
    "first_inlink_source_url",
    "first_inlink_anchor_text",
    "first_inlink_source_position",
    "tcp_connect_time_ms",
    "tls_handshake_time_ms",
    "title_pixel_width",
    "meta_description_pixel_width",
    "search_console_clicks",
    "search_console_impressions",
    "search_console_ctr",
    "search_console_average_position",
    "title_count",
    "meta_description_count",
    "meta_keywords",
    "page_speed_strategy",
    "page_speed_performance_score",
    "page_speed_accessibility_score",
    "page_speed_best_practices_score",
    "page_speed_seo_score",
    "page_speed_lcp_ms",
    "page_speed_cls",
    "page_speed_tbt_ms",
    "field_form_factor",
    "field_lcp_ms_p75",
    "field_inp_ms_p75",
    "field_cls_p75",
    "analytics_sessions",
    "analytics_engaged_sessions",
    "analytics_conversions",
    "analytics_revenue",
    "backlinks",
    "referring_domains",
    "backlink_authority",
    "rel_next_targets",
    "rel_prev_targets",
    "amphtml_targets",
    "field_has_data",
    "field_fcp_ms_p75",
    "field_ttfb_ms_p75",
    "field_requested_url",
    "field_completed_at_ms",
    "field_collection_period_start",
    "field_collection_period_end",
    "amp_document",
    "html_doctype",
]
LINK_COLUMNS = ["id", "source_url", "target_url", "anchor_text", "rel", "rel_nofollow", "link_type", "source_status_code", "target_status_code", "source_depth", "target_depth", "source_position", "discovery_order"]
NODE_COLUMNS = ["url", "label", "crawled", "classification", "status_code", "depth", "indexability", "inlink_count", "outlink_count"]
REDIRECT_COLUMNS = ["record_id", "source_url", "final_url", "hop_index", "hop_url", "status_code", "location", "dns_lookup_time_ms", "tcp_connect_time_ms", "tls_handshake_time_ms", "ttfb_ms", "elapsed_ms"]
SITEMAP_COLUMNS = ["url", "final_url", "status_code", "status_text", "indexability", "indexability_status", "inlink_count", "redirect_target", "canonical", "severity", "issues"]
IMAGE_COLUMNS = ["page_url", "image_url", "alt_text", "alt_len", "missing_alt", "alt_too_long", "source_position", "width", "height", "size_bytes", "oversized"]
QUEUE_COLUMNS = ["url", "depth", "from_sitemap", "storage_key", "list_position", "list_duplicate_index"]
COMPARISON_COLUMNS = [
    "URL", "Identity Key", "Occurrence", "Change", "Changed Fields", "Content Comparison", "Previous URL", "Current URL", "Previous Final URL", "Current Final URL", "Previous List Position", "Current List Position",
    "Previous Status Code", "Current Status Code", "Previous Title", "Current Title", "Previous Meta Description", "Current Meta Description", "Previous Indexability", "Current Indexability", "Previous Response Hash", "Current Response Hash",
]
#: Columns of a record export that have another name in the record, and those written with so many decimals.
_RENAMED = {"backlinks": "backlink_count", "referring_domains": "referring_domain_count"}
_DECIMALS = {"text_to_code_ratio": 4, "search_console_clicks": 4, "search_console_impressions": 4, "search_console_ctr": 6, "search_console_average_position": 4}


def cell(c: Column, kind: str = "string") -> Column:
    """A value as text: doubles in their shortest form without an exponent, nested values as JSON, null as empty."""
    if kind in ("double", "float"):
        c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.call_function("format_number", c, F.lit("0.##################")))
    elif kind.startswith(("array", "struct", "map")):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def _texts(df: DataFrame, columns: list[str], of: dict[str, Column] | None = None) -> DataFrame:
    of, kinds = of or {}, dict(df.dtypes)
    return df.select(*[(of[c] if c in of else cell(F.col(c), kinds[c]) if c in kinds else F.lit("")).alias(c) for c in columns])


def record_rows(records: DataFrame, edges: DataFrame | None = None, scope: list[str] = ()) -> DataFrame:
    """Records as the 123 text columns of their export. Laboratory and field measurements are empty where the table has no such
    columns; the first inlinks are joined where `edges` are given.
    """
    rows = once(records)
    if edges is not None:
        rows = rows.join(links.first_inlinks(rows, edges, list(scope)), [*scope, "id"], "left")
    kinds = dict(rows.dtypes)
    of = {c: F.coalesce(F.call_function("format_number", F.col(c), F.lit("0." + "0" * n)), F.lit("")) for c, n in _DECIMALS.items()}
    of |= {c: cell(F.col(name), kinds[name]) for c, name in _RENAMED.items()} | {"classification": F.initcap("classification")}
    return _texts(rows, RECORD_COLUMNS, of)


def link_rows(edges: DataFrame) -> DataFrame:
    return _texts(once(edges), LINK_COLUMNS)


def node_rows(nodes: DataFrame) -> DataFrame:
    """Nodes of a graph snapshot; placeholders are not crawled."""
    crawled = ~F.coalesce(F.col("placeholder"), F.lit(False)) if "placeholder" in nodes.columns else F.lit(True)
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("inlink_count", "outlink_count")}
    return _texts(nodes, NODE_COLUMNS, counts | {"crawled": crawled.cast("string"), "classification": F.coalesce(F.initcap("classification"), F.lit(""))})


def redirect_rows(records: DataFrame) -> DataFrame:
    """One row per hop of each redirect chain."""
    hops = once(records.where(F.size("redirect_chain") > 0)).select(F.col("id").alias("record_id"), F.col("url").alias("source_url"), "final_url", F.posexplode("redirect_chain").alias("_at", "_h"))
    hops = hops.select("record_id", "source_url", "final_url", (F.col("_at") + 1).alias("hop_index"), F.col("_h.url").alias("hop_url"), *[F.col(f"_h.{c}").alias(c) for c in REDIRECT_COLUMNS[5:]])
    return _texts(hops, REDIRECT_COLUMNS)


def sitemap_rows(records: DataFrame) -> DataFrame:
    """The sitemap report."""
    return _texts(links.sitemap_report(records, []), SITEMAP_COLUMNS, {"severity": F.initcap("severity")})


def image_rows(images: DataFrame, records: DataFrame) -> DataFrame:
    return _texts(links.sized_images(images, records), IMAGE_COLUMNS)


def queue_rows(queue: DataFrame) -> DataFrame:
    """Addresses that wait to be fetched."""
    return _texts(queue, QUEUE_COLUMNS)


def comparison_export(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of a comparison that changed, with 22 columns; text that a spreadsheet would run is guarded."""
    sides = []
    for side, df in (("previous", before), ("current", after)):
        rows = once(df).select("id", "url", "final_url", "list_position", "status_code", "title", "meta_description", "indexability", "response_hash")
        sides.append(rows.select(F.col("id").alias(f"{'before' if side == 'previous' else 'after'}_id"), *[F.col(c).alias(f"{side}_{c}") for c in rows.columns[1:]]))
    rows = compare.compared(before, after).where("change <> 'unchanged'").select("request_url", "occurrence", "change", "fields", "content", "before_id", "after_id")
    rows = rows.join(sides[0], "before_id", "left").join(sides[1], "after_id", "left")
    of = {
        "URL": F.coalesce("request_url", F.lit("")), "Identity Key": F.coalesce("request_url", F.lit("")), "Occurrence": F.col("occurrence").cast("string"), "Change": F.col("change"), "Changed Fields": F.array_join("fields", "; "), "Content Comparison": F.col("content"),
    }
    for c in COMPARISON_COLUMNS[6:]:
        of[c] = cell(F.col("_".join(c.lower().split())))
    return rows.select(*[guarded(of[c]).alias(c) for c in COMPARISON_COLUMNS])


#: Kind of export: its rows, from the tables by name.
KINDS = {
    "records": lambda t: record_rows(t["records"], t.get("edges")), "links": lambda t: link_rows(t["edges"]), "redirects": lambda t: redirect_rows(t["records"]),
    "sitemap": lambda t: sitemap_rows(t["records"]), "images": lambda t: image_rows(t["images"], t["records"]), "nodes": lambda t: node_rows(t["nodes"]), "queue": lambda t: queue_rows(t["queue"]),
}
#: Named sets of exports.
PRESETS = {"everything": list(KINDS), "crawl": ["records", "links", "redirects"], "sitemaps": ["sitemap"], "media": ["images"]}


def write_exports(folder: str, kinds: list[str] | str, tables: dict[str, DataFrame]) -> list[str]:
    """Writes the exports of a preset or a list of kinds, one CSV folder each; kinds whose tables are missing raise KeyError."""
    names = PRESETS[kinds] if isinstance(kinds, str) else kinds
    rows = {k: KINDS[k](tables) for k in names}
    for k, df in rows.items():
        write_csv(df, f"{folder}/{k}")
    return names


def comparison_key(request_url: Column | str, occurrence: Column | str) -> Column:
    """The identity of a row of a comparison: its address and occurrence."""
    return F.concat_ws("#", U.without_fragment(request_url), F.col(occurrence).cast("string") if isinstance(occurrence, str) else occurrence.cast("string"))
