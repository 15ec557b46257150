"""Columns of crawl records with the values a queued but unfetched record has, and typed access to partial tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.session import checkpointed

_HOP = "struct<url:string,status_code:int,location:string,dns_lookup_time_ms:bigint,tcp_connect_time_ms:bigint,tls_handshake_time_ms:bigint,ttfb_ms:bigint,elapsed_ms:bigint>"

#: name: (type, default). A null default means "never measured", which differs from a measured zero or false.
RECORD = {
    "id": ("bigint", None), "storage_key": ("string", ""), "url": ("string", ""), "final_url": ("string", ""), "list_position": ("int", None), "list_duplicate_index": ("int", 0),
    "classification": ("string", "internal"), "in_sitemap": ("boolean", False), "depth": ("bigint", 0), "status_code": ("int", None), "status_text": ("string", ""), "content_type": ("string", None),
    "indexability": ("string", "Unknown"), "indexability_status": ("string", ""), "response_time_ms": ("bigint", 0), "error": ("string", None),
    "dns_lookup_time_ms": ("bigint", None), "tcp_connect_time_ms": ("bigint", None), "tls_handshake_time_ms": ("bigint", None), "ttfb_ms": ("bigint", None), "download_time_ms": ("bigint", None),
    "total_network_time_ms": ("bigint", None), "transfer_rate_bytes_per_sec": ("bigint", None), "resolved_ip_count": ("bigint", 0), "size_bytes": ("bigint", 0),
    "response_hash": ("string", None), "content_hash": ("string", None), "content_hash_context": ("string", None), "simhash": ("bigint", None), "near_duplicate_cluster_id": ("bigint", None),
    "redirect_target": ("string", None), "redirect_type": ("string", None), "redirect_chain": (f"array<{_HOP}>", ()),
    "title": ("string", None), "title_count": ("bigint", None), "title_len": ("bigint", 0), "title_pixel_width": ("bigint", 0),
    "meta_description": ("string", None), "meta_description_count": ("bigint", None), "meta_description_len": ("bigint", 0), "meta_description_pixel_width": ("bigint", 0), "meta_keywords": ("string", None),
    "meta_robots": ("string", None), "x_robots_tag": ("string", None), "h1": ("string", None), "h1_len": ("bigint", 0), "h1_count": ("bigint", 0), "h2": ("string", None), "h2_len": ("bigint", 0), "h2_count": ("bigint", 0),
    "canonical": ("string", None), "canonical_count": ("bigint", 0), "amphtml": ("string", None), "amphtml_targets": ("array<string>", None), "amp_document": ("boolean", None), "html_doctype": ("boolean", None),
    "rel_next": ("string", None), "rel_prev": ("string", None), "rel_next_targets": ("array<string>", None), "rel_prev_targets": ("array<string>", None),
    "word_count": ("bigint", 0), "text_to_code_ratio": ("double", 0.0), "image_count": ("bigint", 0), "images_missing_alt": ("bigint", 0), "images_alt_too_long": ("bigint", 0), "mixed_content_count": ("bigint", 0),
    "insecure_form_count": ("bigint", 0), "open_graph_count": ("bigint", 0), "twitter_card_count": ("bigint", 0), "deprecated_html_tag_count": ("bigint", 0), "duplicate_id_count": ("bigint", 0), "viewport": ("boolean", False),
    "hsts_header": ("boolean", False), "content_security_policy_header": ("boolean", False), "x_frame_options_header": ("boolean", False), "x_content_type_options_header": ("boolean", False),
    "hreflang_count": ("bigint", 0), "hreflang_invalid_count": ("bigint", 0), "hreflang_missing_self_reference": ("boolean", False), "hreflang_links": ("array<struct<hreflang:string,url:string,valid:boolean>>", ()),
    "json_ld_count": ("bigint", 0), "json_ld_invalid_count": ("bigint", 0), "structured_data_error_count": ("bigint", 0), "structured_data_warning_count": ("bigint", 0), "structured_data_issues": ("array<struct<severity:string,message:string,path:string>>", ()),
    "js_rendered": ("boolean", False), "rendered_dom_changed": ("boolean", False), "rendered_word_count_delta": ("int", 0), "rendered_link_count_delta": ("int", 0),
    "inlink_count": ("bigint", 0), "outlink_count": ("bigint", 0), "internal_outlink_count": ("bigint", 0), "external_outlink_count": ("bigint", 0),
    "custom_extractions": ("array<struct<name:string,values:array<string>>>", ()), "custom_searches": ("array<struct<name:string,source:string,matched:boolean,match_count:bigint,snippets:array<string>>>", ()),
    "search_console_clicks": ("double", None), "search_console_impressions": ("double", None), "search_console_ctr": ("double", None), "search_console_average_position": ("double", None),
    "analytics_sessions": ("double", None), "analytics_engaged_sessions": ("double", None), "analytics_conversions": ("double", None), "analytics_revenue": ("double", None),
    "backlink_count": ("bigint", None), "referring_domain_count": ("bigint", None), "backlink_authority": ("double", None),
}


def default(name: str):
    """The pending value of a column as a typed literal."""
    kind, value = RECORD[name]
    return (F.array() if value == () else F.lit(value)).cast(kind)


def conformed(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every record column, missing ones at their pending value, and `keep` beside them; other columns are dropped.

    Columns that a query does not use cost nothing: they are pruned from the scan, and literals are folded.
    """
    have = set(df.columns)
    return df.select(*[c for c in keep if c in have and c not in RECORD], *[F.col(c) if c in have else default(c).alias(c) for c in RECORD])


def records(df: DataFrame, scope: tuple[str, ...] = ("crawl_id",)) -> DataFrame:
    """`conformed` records without rows that lack an id; `scope` columns name the crawl.

    Exact repeats (same id) stay in. A row's predicate holds for its repeats as well, so operators filter at the scan first
    and drop the repeats of what is left (`once`), or aggregate in a way that repeats do not change.
    """
    return conformed(df, scope).where(F.col("id").isNotNull())


def once(df: DataFrame) -> DataFrame:
    """Exact repeats (same id) once, of whole rows that a filter has left."""
    return df.dropDuplicates(["id"])


#: Ids that are handed to all executors at most.
MOST_IDS = 10_000


def unrepeated(rows: DataFrame, many=once) -> DataFrame:
    """`once` for rows that are many and wide: a job of its own finds the ids that come again, so that only ids are shuffled;
    whole rows are only where their id does come again. Are those more than can be handed round, `many` is applied.
    """
    again = checkpointed(rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id"))
    n = again.count()
    if n > MOST_IDS:
        return many(rows)
    if not n:
        return rows
    again = F.broadcast(again)
    return rows.join(again, "id", "left_anti").unionByName(once(rows.join(again, "id", "left_semi"))).select(*rows.columns)
