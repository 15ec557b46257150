"""Link edges, anchors, inlinks, images, references and sitemap reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import url as U
from siteloom.functions.text import blank, contains_ci, text_key, trimmed
from siteloom.operators import gates
from siteloom.sources.schema import once

# Searched columns, and the sort keys of the report interface by column.
EDGE_TEXTS = ["source_url", "target_url", "anchor_text", "rel", "link_type", "source_status_code", "target_status_code", "source_depth", "target_depth", "source_position", "id"]
EDGE_SORTS = dict(sourceUrl="source_url", targetUrl="target_url", anchorText="anchor_text", rel="rel", relNofollow="rel_nofollow", linkType="link_type", sourceStatusCode="source_status_code", targetStatusCode="target_status_code", sourceDepth="source_depth", targetDepth="target_depth", sourcePosition="source_position", discoveryOrder="discovery_order")
ANCHOR_SORTS = dict(anchorText="anchor_text", targetUrl="target_url", linkType="link_type", linkCount="link_count", sourceCount="source_count", nofollowCount="nofollow_count", exampleSource="example_source_url", targetStatusCode="target_status_code")
IMAGE_SORTS = dict(pageUrl="page_url", imageUrl="image_url", altText="alt_text", altLen="alt_len", missingAlt="missing_alt", altTooLong="alt_too_long", width="width", height="height", sizeBytes="size_bytes", oversized="oversized", sourcePosition="source_position")
SITEMAP_SORTS = dict(severity="severity_rank", issueCount="issue_count", finalUrl="final_url", url="url", statusCode="status_code", indexability="indexability", canonical="canonical", redirectTarget="redirect_target", inlinkCount="inlink_count", depth="depth", classification="classification", issues="issues")


# What a sitemap report says of a record, and its rank (1 warning, 2 error), in the order of the report.
SITEMAP_ISSUES = {
    "robots": ("Robots-blocked URL in sitemap", 1),
    "no response": ("No response URL in sitemap", 2),
    "3xx": ("Redirecting URL in sitemap", 1),
    "4xx": ("4xx URL in sitemap", 2),
    "5xx": ("5xx URL in sitemap", 2),
    "not indexable": ("Non-indexable URL in sitemap", 1),
    "canonical": ("Canonical points to a different URL", 1),
    "redirect target": ("Sitemap URL has a redirect target", 1),
    "external": ("External URL in sitemap", 1),
    "orphan": ("Orphan URL in sitemap", 1),
    "error": ("Fetch error for sitemap URL", 2),
}


def known_edges(df: DataFrame) -> DataFrame:
    """Link edges without rows that lack an id. Exact repeats (same id) stay in: each operator drops them after its own
    filter, or aggregates in a way that they do not change.
    """
    return df.where(F.col("id").isNotNull())


def _found(text: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [contains_ci(c, text.strip()) for c in columns]) if text.strip() else F.lit(True)


def failed_addresses(records: DataFrame) -> DataFrame:
    """(target_url): every alias of a record that failed, in any crawl, and of its redirect hops."""
    hops = F.transform("redirect_chain", lambda h: h["url"])
    bad = records.where(gates.broken()).select(F.explode(F.array_distinct(F.concat(F.array("storage_key", "url", "final_url"), F.coalesce(hops, F.array().cast("array<string>"))))).alias("_u"))
    return U.with_aliases(bad, ["_u"], "target_url").select("target_url").distinct()


def edge_view(edges: DataFrame, view: str = "all", records: DataFrame | None = None, internal_only: bool = False, source: str | None = None, target: str | None = None, search: str = "") -> DataFrame:
    """Edges of a view, once each: all, internal, external, nofollow or broken (status from 400, or an address of a failed
    record).

    The failed addresses are joined by equality after being made distinct, so a hot target meets one row.
    """
    df = edges
    if view == "broken":
        if records is None:
            raise ValueError("broken links need the records")
        failed = failed_addresses(records).withColumn("_failed", F.lit(True))
        df = df.join(failed, "target_url", "left").where(gates.sure(F.col("target_status_code") >= 400) | F.col("_failed").isNotNull()).drop("_failed")
    elif view == "nofollow":
        df = df.where("rel_nofollow")
    elif view == "internal":
        df = df.where(internal())
    elif view == "external":
        df = df.where(~internal())
    elif view != "all":
        raise ValueError(f"no view {view}")
    if internal_only:
        df = df.where(internal())
    for c, want in (("source_url", source), ("target_url", target)):
        if want is not None:
            df = df.where(F.col(c) == want)
    return once(df.where(_found(search, EDGE_TEXTS)))


def internal() -> Column:
    """Whether both ends of an edge lie on one host."""
    return gates.sure(U.host(F.lower("source_url")) == U.host(F.lower("target_url")))


def edge_page(edges: DataFrame, sort: str | None = None, descending: bool = False, offset: int = 0, limit: int = 1000, **view) -> DataFrame:
    c = F.col(EDGE_SORTS.get(sort, "id"))
    return edge_view(edges, **view).orderBy(c.desc() if descending else c.asc(), "id").offset(offset).limit(limit)


def resolved_edges(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges with status and depth of both ends from the records: per literal address those of the last upserted record
    (largest id) with that alias; ends that no record has keep what they had.
    """
    edges = once(edges)
    named = U.with_aliases(records.select("id", "storage_key", "url", "final_url", "status_code", "depth"), ["storage_key", "url", "final_url"])
    last = named.groupBy("alias").agg(F.max(F.struct("id", F.col("status_code").alias("s"), F.col("depth").alias("d"))).alias("_last"))
    for end in ("source", "target"):
        side = last.select(F.col("alias").alias(f"{end}_url"), F.col("_last").alias("_r"))
        edges = edges.join(side, f"{end}_url", "left").withColumns({
            f"{end}_status_code": F.when(F.col("_r").isNotNull(), F.col("_r.s")).otherwise(F.col(f"{end}_status_code")),
            f"{end}_depth": F.when(F.col("_r").isNotNull(), F.col("_r.d")).otherwise(F.col(f"{end}_depth")),
        }).drop("_r")
    return edges


def inlink_counts(edges: DataFrame) -> DataFrame:
    """(url, count) of links by literal target."""
    rows = edges.where(F.col("target_url").isNotNull()).select("id", "target_url").distinct()
    return rows.groupBy(F.col("target_url").alias("url")).agg(F.count(F.lit(1)).alias("count"))


def inlinks(records: DataFrame, edges: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id, inlinks): links to any alias of each record; 0 without any. Links are counted per literal target first,
    so the join with the aliases meets one row for each address.
    """
    named = U.with_aliases(records.select(*scope, "id", "storage_key", "url", "final_url").distinct(), ["storage_key", "url", "final_url"])
    got = named.join(inlink_counts(edges).withColumnRenamed("url", "alias"), "alias").groupBy(*scope, "id").agg(F.sum("count").alias("inlinks"))
    return records.select(*scope, "id").distinct().join(got, [*scope, "id"], "left").select(*scope, "id", F.coalesce("inlinks", F.lit(0)).alias("inlinks"))


def first_inlinks(records: DataFrame, edges: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id, first_inlink_source_url, _anchor_text, _source_position): the earliest link to any alias of a record, by
    discovery order, position, source address and id.
    """
    rank = F.struct("discovery_order", "source_position", "source_url", "id", "anchor_text")
    first = edges.where(F.col("target_url").isNotNull()).groupBy(F.col("target_url").alias("alias")).agg(F.min(rank).alias("_first"))
    named = U.with_aliases(records.select(*scope, "id", "storage_key", "url", "final_url"), ["storage_key", "url", "final_url"])
    got = named.join(first, "alias").groupBy(*scope, "id").agg(F.min("_first").alias("_first"))
    return got.select(*scope, "id", F.col("_first.source_url").alias("first_inlink_source_url"), F.col("_first.anchor_text").alias("first_inlink_anchor_text"), F.col("_first.source_position").alias("first_inlink_source_position"))


def outlink_counts(edges: DataFrame) -> DataFrame:
    """(source_url, outlinks, internal_outlinks, external_outlinks)."""
    rows = edges.where(F.col("source_url").isNotNull()).select("id", "source_url", internal().alias("_in")).distinct()
    return rows.groupBy("source_url").agg(F.count(F.lit(1)).alias("outlinks"), F.count_if("_in").alias("internal_outlinks"), F.count_if(~F.col("_in")).alias("external_outlinks"))


def anchor_texts(edges: DataFrame) -> DataFrame:
    """(anchor_key, target_url, link_type, anchor_text, link_count, source_count, nofollow_count, example_source_url,
    target_status_code) by text key of the anchor. The representative text is the least, the status the largest.

    Links are first merged by source, so the distinct sources are a plain count and no group meets one task whole.
    """
    key = text_key(F.coalesce("anchor_text", F.lit("")))
    rows = edges.select("id", "anchor_text", "target_url", "link_type", "source_url", "rel_nofollow", "target_status_code").distinct()
    by_source = rows.groupBy(key.alias("anchor_key"), "target_url", "link_type", "source_url").agg(
        F.min("anchor_text").alias("t"), F.count(F.lit(1)).alias("n"), F.count_if("rel_nofollow").alias("nf"), F.max("target_status_code").alias("s")
    )
    return by_source.groupBy("anchor_key", "target_url", "link_type").agg(
        F.min("t").alias("anchor_text"), F.sum("n").alias("link_count"), F.count("source_url").alias("source_count"), F.sum("nf").alias("nofollow_count"), F.min("source_url").alias("example_source_url"), F.max("s").alias("target_status_code")
    )


def anchor_page(edges: DataFrame, search: str = "", sort: str = "linkCount", descending: bool = True, offset: int = 0, limit: int = 1000) -> DataFrame:
    c = F.col(ANCHOR_SORTS.get(sort, "link_count"))
    rows = anchor_texts(edges).where(_found(search, ["anchor_text", "target_url", "link_type", "example_source_url"]))
    return rows.orderBy(c.desc() if descending else c.asc(), "anchor_text", "target_url").offset(offset).limit(limit)


def redirect_hops(records: DataFrame, scope: list[str]) -> DataFrame:
    """One row per hop of each redirect chain, hop_index from 1."""
    return records.select(*scope, "id", "url", "final_url", F.posexplode("redirect_chain").alias("_at", "_h")).distinct().select(*scope, "id", "url", "final_url", (F.col("_at") + 1).alias("hop_index"), F.col("_h.url").alias("hop_url"), F.col("_h.status_code").alias("hop_status_code"), F.col("_h.location").alias("location"))


def sized_images(images: DataFrame, records: DataFrame, large: int = gates.LARGE_IMAGE_BYTES) -> DataFrame:
    """Images with size_bytes and oversized from the image responses: the largest record id of any alias wins."""
    sizes = U.with_aliases(records.where(F.startswith(F.lower("content_type"), F.lit("image/"))).select("id", "size_bytes", "url", "final_url", "storage_key"), ["storage_key", "url", "final_url"])
    best = sizes.groupBy("alias").agg(F.max_by("size_bytes", "id").alias("size_bytes"))
    return images.join(best.withColumnRenamed("alias", "image_url"), "image_url", "left").withColumn("oversized", gates.sure(F.col("size_bytes") > large))


def image_page(images: DataFrame, records: DataFrame, page_url: str | None = None, missing_alt: bool = False, oversized: bool = False, search: str = "", sort: str = "pageUrl", descending: bool = False, offset: int = 0, limit: int = 1000) -> DataFrame:
    rows = sized_images(images, records)
    if page_url is not None:
        rows = rows.where(F.arrays_overlap(U.aliases("page_url"), U.aliases(F.lit(page_url))))
    if missing_alt:
        rows = rows.where("missing_alt")
    if oversized:
        rows = rows.where("oversized")
    c = F.col(IMAGE_SORTS.get(sort, "page_url"))
    return rows.where(_found(search, ["page_url", "image_url", "alt_text"])).orderBy(c.desc() if descending else c.asc(), "page_url", "source_position").offset(offset).limit(limit)


def references(refs: DataFrame, source_key: str | None = None, kind: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Page references in id order, repeats (same id) once."""
    rows = refs.where(F.col("id").isNotNull())
    if source_key is not None:
        rows = rows.where(F.col("source_storage_key") == source_key)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    rows = once(rows)
    return rows if limit is None else rows.orderBy("id").offset(offset).limit(limit)


def sitemap_report(records: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id, ..., issues, issue_count, severity_rank, severity) of the records in a sitemap; clean ones have the label OK."""
    status, external, blocked = F.col("status_code"), gates.sure(F.col("classification") == "external"), gates.robots_blocked()
    met = {
        "robots": blocked, "no response": gates.no_response(), "3xx": gates.redirect(), "4xx": status.between(400, 499), "5xx": status.between(500, 599),
        "not indexable": (F.col("indexability") != "Indexable") | (F.col("indexability_status") != "Indexable"), "canonical": ~blank("canonical") & (trimmed("canonical") != F.col("final_url")),
        "redirect target": ~blank("redirect_target"), "external": external, "orphan": (F.col("inlink_count") == 0) & ~external, "error": ~blocked & ~blank("error"),
    }
    found = [(met[k], label, rank) for k, (label, rank) in SITEMAP_ISSUES.items()]
    hits = F.array_compact(F.array(*[F.when(gates.sure(c), F.struct(F.lit(label).alias("label"), F.lit(rank).alias("rank"))) for c, label, rank in found]))
    rows = once(records.where("in_sitemap")).withColumn("_hits", hits)
    rank = F.coalesce(F.array_max(F.transform("_hits", lambda h: h["rank"])), F.lit(0))
    return rows.select(
        *scope, "id", "url", "final_url", "status_code", "status_text", "indexability", "indexability_status", "canonical", "redirect_target", "inlink_count", "depth", "classification",
        F.when(F.size("_hits") > 0, F.array_join(F.transform("_hits", lambda h: h["label"]), "; ")).otherwise("OK").alias("issues"), F.greatest(F.size("_hits"), F.lit(1)).alias("issue_count"),
        rank.alias("severity_rank"), F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("error")), rank + 1).alias("severity"),
    )


def sitemap_page(records: DataFrame, scope: list[str], search: str = "", sort: str | None = None, descending: bool = True, offset: int = 0, limit: int = 1000) -> DataFrame:
    rows = sitemap_report(records, scope).where(_found(search, "url final_url status_code indexability canonical redirect_target classification issues".split()))
    keys = [F.col("severity_rank").desc(), F.col("issue_count").desc(), F.col("final_url")] if sort is None else [F.col(SITEMAP_SORTS[sort]).desc() if descending else F.col(SITEMAP_SORTS[sort])]
    return rows.orderBy(*keys, "id").offset(offset).limit(limit)


def exact_duplicate_groups(records: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, response_hash, addresses, records) of hashes found at two or more final addresses."""
    rows = records.where(gates.success_html() & F.col("response_hash").isNotNull()).withColumn("_key", U.final_key("final_url")).where(F.col("_key").isNotNull())
    rows = rows.select(*scope, "id", "response_hash", "_key").distinct()
    per = rows.groupBy(*scope, "response_hash", "_key").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*scope, "response_hash").agg(F.count(F.lit(1)).alias("addresses"), F.sum("n").alias("records")).where("addresses > 1")


def metric_merge(records: DataFrame, metrics: DataFrame, columns: list[str], scope: list[str], order: str, scheme_free: bool = False) -> DataFrame:
    """(scope, id, columns): per record the metrics of the last row (largest `order`) whose address is one of its aliases.

    `scheme_free` compares without http or https, for sources that report hosts and paths.
    """
    strip = U.scheme_free if scheme_free else (lambda c: F.col(c))
    rows = U.with_aliases(metrics.select("url", *columns, order), ["url"]).withColumn("_name", strip("alias"))
    last = rows.groupBy("_name").agg(F.max(F.struct(F.col(order).alias("o"), *columns)).alias("_last"))
    named = U.with_aliases(records.select(*scope, "id", "storage_key", "url", "final_url"), ["storage_key", "url", "final_url"]).select(*scope, "id", strip("alias").alias("_name")).distinct()
    got = named.join(last, "_name").groupBy(*scope, "id").agg(F.max("_last").alias("_last"))
    return got.select(*scope, "id", *[F.col(f"_last.{c}").alias(c) for c in columns])


def merged_sources(sources: dict[str, tuple[DataFrame, list[str]]], order: str) -> DataFrame:
    """Full outer merge of metric sources by address without fragment: the latest non-null value of every column."""
    out = None
    for df, columns in sources.values():
        # The greatest (order, value) among non-null values is the latest; a struct of nulls is skipped.
        one = df.select(U.without_fragment(trimmed("url")).alias("url"), order, *columns).where(F.col("url") != "").groupBy("url").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in columns])
        out = one if out is None else out.join(one, "url", "full")
    return out
