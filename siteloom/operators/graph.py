"""The crawl graph: snapshot, shortest path, URL tree, frontier and near-duplicate clusters by fingerprint."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, count as count_from

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import url as U
from siteloom.operators import gates
from siteloom.session import checkpointed
from siteloom.sources.schema import once


def graph_nodes(records: DataFrame, scope: list[str], max_nodes: int | None = None) -> DataFrame:
    """(scope, url, id, status_code, depth, label, section, ...): one node per literal final address.

    An address is admitted by its first occurrence (list position or id) and described by its last. Per address this is a
    pair of aggregates, so an address fetched very often is reduced before the shuffle. With `max_nodes` the first
    admitted ones are kept by a distributed top-k.
    """
    place = F.struct(F.coalesce(F.col("list_position").cast("bigint"), F.col("id")).alias("p"), F.col("id").alias("i"))
    last = F.struct(place.alias("at"), F.col("status_code"), F.col("depth"), F.col("classification"), F.col("indexability"), F.col("title"), F.col("inlink_count"), F.col("outlink_count"))
    nodes = records.groupBy(*scope, F.col("final_url").alias("url")).agg(F.min(place).alias("_first"), F.max(last).alias("_last"))
    rows = nodes.select(*scope, "url", F.col("_first.i").alias("first_id"), F.col("_last.status_code").alias("status_code"), F.col("_last.depth").alias("depth"), F.col("_last.classification").alias("classification"), F.col("_last.indexability").alias("indexability"), F.col("_last.inlink_count").alias("inlink_count"), F.col("_last.outlink_count").alias("outlink_count"), U.graph_label("url").alias("label"), U.section("url").alias("section"), "_first")
    return (rows if max_nodes is None else rows.orderBy("_first").limit(max_nodes)).drop("_first")


def graph_edges(edges: DataFrame, internal_only: bool = False, max_edges: int | None = None) -> DataFrame:
    """(id, source_url, target_url, link_type, rel_nofollow) in id order up to `max_edges`; null ends are left out."""
    from siteloom.operators.links import internal

    rows = edges.where("source_url is not null and target_url is not null")
    if internal_only:
        rows = rows.where(internal())
    rows = rows.select("id", "source_url", "target_url", "link_type", "rel_nofollow").distinct()
    return rows if max_edges is None else rows.orderBy("id").limit(max_edges)


def graph_snapshot(records: DataFrame, edges: DataFrame, max_nodes: int = 2000, max_edges: int = 5000, internal_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one crawl within the caps of a drawing. Ends that no record has become placeholders in edge order,
    sources before targets, until the nodes are full; edges keep both ends.
    """
    nodes = graph_nodes(records, [], max_nodes).withColumn("placeholder", F.lit(False))
    kept = graph_edges(edges, internal_only, max_edges)
    ends = kept.select(F.explode(F.array(F.struct("id", F.lit(0).alias("end"), F.col("source_url").alias("url")), F.struct("id", F.lit(1).alias("end"), F.col("target_url").alias("url")))).alias("e")).groupBy("e.url").agg(F.min(F.struct("e.id", "e.end")).alias("_at"))
    free = max(0, max_nodes - nodes.count())
    missing = ends.join(nodes, "url", "left_anti").orderBy("_at").limit(free).select("url", U.graph_label("url").alias("label"), U.section("url").alias("section"), F.lit(True).alias("placeholder"))
    nodes = nodes.unionByName(missing, allowMissingColumns=True).orderBy(F.col("depth").asc_nulls_first(), "url")
    names = nodes.select("url")
    return nodes, kept.join(names.withColumnRenamed("url", "source_url"), "source_url", "left_semi").join(names.withColumnRenamed("url", "target_url"), "target_url", "left_semi")


def sections(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, section, nodes, broken) by host and first path segment."""
    return nodes.groupBy(*scope, "section").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("status_code") >= 400).alias("broken"))


def crawl_path(edges: DataFrame, target: str, max_edges: int | None = None, most_levels: int = 200) -> DataFrame:
    """(step, source_url, target_url, edge_id) of a shortest path of links to any alias of `target`; no rows if there is none
    or the target is a start itself.

    Starts are the sources of depth 0, else of the least depth. Each level joins the frontier with the links by equality
    and keeps per new address the first link (discovery order, position, target); visited addresses are anti-joined. Levels
    are cut through the shared checkpoint folder; only the path itself - as long as the levels - comes to the driver.
    """
    rows = edges.where("source_url is not null and target_url is not null")
    if max_edges is not None:
        rows = once(rows).orderBy("id").limit(max_edges)
    rows = checkpointed(rows.select("id", "source_url", "target_url", "discovery_order", "source_position", "source_depth").distinct())
    spark = edges.sparkSession
    wanted = [r[0] for r in U.with_aliases(spark.createDataFrame([(target,)], "u string"), ["u"]).select("alias").distinct().collect()]
    names = lambda c: F.array_distinct(F.concat(U.aliases(c), F.array(c)))
    empty = spark.createDataFrame([], "step int, source_url string, target_url string, edge_id bigint")
    least = rows.agg(F.min(F.when(F.col("source_depth") == 0, 0).otherwise(F.col("source_depth")))).first()[0]
    if least is None:
        return empty
    frontier = checkpointed(rows.where(F.col("source_depth") == least).select(F.explode(names("source_url")).alias("name")).distinct())
    if frontier.where(F.col("name").isin(wanted)).limit(1).count():
        return empty
    visited, levels = frontier, []
    for _ in range(most_levels):
        order = F.struct("discovery_order", "source_position", "target_url", "id", "source_url")
        step = rows.join(frontier.withColumnRenamed("name", "source_url"), "source_url").select(order.alias("o"), F.explode(names("target_url")).alias("name"))
        step = checkpointed(step.join(visited, "name", "left_anti").groupBy("name").agg(F.min("o").alias("o")))
        levels.append(step)
        hit = step.where(F.col("name").isin(wanted)).orderBy("o").first()
        if hit:
            path, at = [], hit["o"]
            for i in range(len(levels) - 1, -1, -1):
                path.append((i + 1, at["source_url"], at["target_url"], at["id"]))
                if i:
                    at = levels[i - 1].where(F.col("name") == at["source_url"]).first()["o"]
            return spark.createDataFrame(path[::-1], empty.schema)
        if not step.limit(1).count():
            return empty
        frontier = step.select("name")
        visited = checkpointed(visited.unionByName(frontier))
    raise RuntimeError(f"no end after {most_levels} levels")


def url_tree(records: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, path, segments, total, status classes, no_response, broken) of every prefix of the final addresses."""
    rows = records.select(*scope, "id", "final_url", "status_code", gates.no_response().alias("_n"), gates.broken().alias("_b")).distinct()
    rows = rows.select(*scope, F.posexplode(U.tree_paths("final_url")).alias("segments", "path"), "status_code", "_n", "_b")
    of = lambda lo, hi: F.count_if(F.col("status_code").between(lo, hi))
    return rows.groupBy(*scope, "path", (F.col("segments") + 1).alias("segments")).agg(F.count(F.lit(1)).alias("total"), of(200, 299).alias("success"), of(300, 399).alias("redirects"), of(400, 499).alias("client_errors"), F.count_if(F.col("status_code") >= 500).alias("server_errors"), F.count_if("_n").alias("no_response"), F.count_if("_b").alias("broken"))


#: Levels that a search holds apart before they are written together.
MOST_LEVELS = 64


def frontier_levels(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 20, in_scope=None, follow_nofollow: bool = False, max_urls: int | None = None) -> DataFrame:
    """(url, depth): a simulated crawl over captured links from `seeds` (url): breadth first, each address once.

    Links out of scope, and nofollow links unless allowed, are not followed; `max_urls` ends the crawl after the level that
    reaches it. A `max_depth` of None goes on until no address is new.
    """
    rows = edges.where("source_url is not null and target_url is not null")
    if not follow_nofollow:
        rows = rows.where(~F.coalesce(F.col("rel_nofollow"), F.lit(False)))
    if in_scope is not None:
        rows = rows.where(in_scope(F.col("target_url")))
    rows = checkpointed(rows.select(U.without_fragment("source_url").alias("source_url"), U.without_fragment("target_url").alias("target_url")).distinct())
    level = checkpointed(seeds.select(U.without_fragment("url").alias("url")).where("url is not null").distinct().withColumn("depth", F.lit(0)))
    levels, count = [level], level.count()
    for depth in count_from(1) if max_depth is None else range(1, max_depth + 1):
        if max_urls is not None and count >= max_urls:
            break
        found = rows.join(level.select(F.col("url").alias("source_url")), "source_url", "left_semi").select(F.col("target_url").alias("url")).distinct()
        level = checkpointed(found.join(reduce(DataFrame.unionByName, levels), "url", "left_anti").withColumn("depth", F.lit(depth)))
        new = level.count()
        if not new:
            break
        count += new
        levels.append(level)
        if len(levels) == MOST_LEVELS:  # keeps the plan short; each address is written a few times at most
            levels = [checkpointed(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def simhash(tokens):
    """The 64-bit feature hash of an array of tokens: per bit the sign of the votes of the tokens' hashes."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(tokens, F.lit(0), lambda a, t: a + F.when(F.call_function("shiftrightunsigned", F.xxhash64(t), b.cast("int")).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)))
    return F.aggregate(F.transform(bits, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def first_earlier_match(prints: DataFrame, order: str, fingerprint: str, distance: int = 6) -> DataFrame:
    """(order, parent): for each row the first earlier row whose fingerprint differs in at most `distance` bits.

    Equal fingerprints are one row (its first). The bits are cut into more blocks than may differ, so any match agrees in
    some choice of `blocks - distance` whole blocks (pigeonhole): candidates meet by equality on (choice, bits) and no match
    is lost. The more fingerprints there are, the more blocks are used, so that a key stays about as selective.
    """
    one = checkpointed(prints.groupBy(fingerprint).agg(F.min(order).alias("_first")))
    n, blocks = max(one.count(), 1), distance + 1
    while blocks < distance + 5 and 2 ** (64 * (blocks - distance) / blocks) < n:
        blocks += 1
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for i, choice in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum((1 << cuts[b + 1]) - (1 << cuts[b]) for b in choice)
        mask -= (mask >> 63) << 64  # as a signed number
        keys.append(F.struct(F.lit(i).alias("band"), F.col(fingerprint).bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")))
    banded = one.select(fingerprint, "_first", F.explode(F.array(*keys)).alias("_k")).select(fingerprint, "_first", "_k.band", "_k.bits")
    a, b = banded.alias("a"), banded.alias("b")
    near = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("b._first") < F.col("a._first"))).where(
        F.bit_count(F.col(f"a.{fingerprint}").bitwiseXOR(F.col(f"b.{fingerprint}"))) <= distance
    )
    parents = near.groupBy(F.col("a._first").alias("_first")).agg(F.min("b._first").alias("parent"))
    own = one.join(parents, "_first", "left").select(fingerprint, "_first", "parent")
    rows = prints.select(order, fingerprint).join(own, fingerprint)
    # A later row of an equal fingerprint matches that fingerprint's first row or an even earlier neighbour.
    return rows.select(order, F.when(F.col(order) == F.col("_first"), F.col("parent")).otherwise(F.least("_first", "parent")).alias("parent"))


def fingerprint_clusters(prints: DataFrame, order: str, fingerprint: str, distance: int = 6) -> DataFrame:
    """(order, root): each row inherits the cluster of its first earlier match, followed up to a row without one."""
    jump = checkpointed(first_earlier_match(prints, order, fingerprint, distance).select(F.col(order), F.coalesce("parent", order).alias("root")))
    for _ in range(64):
        up = jump.select(F.col(order).alias("root"), F.col("root").alias("_up"))
        nxt = checkpointed(jump.join(up, "root").select(order, F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")))
        moved = nxt.where("_moved").limit(1).count()
        jump = nxt.drop("_moved")
        if not moved:
            break
    return jump


def near_duplicate_clusters(pages: DataFrame, ident: str, text: str, distance: int = 6, least_words: int = 20) -> DataFrame:
    """(ident, cluster): arrival-order clusters of pages with at least `least_words` words; the cluster is the place of its
    root among the fingerprinted pages, from 1. Arrival is the order of `ident`.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"(?U)\s+"), lambda w: w != "")
    prints = checkpointed(pages.where(F.col(text).isNotNull() & F.col(ident).isNotNull()).dropDuplicates([ident]).select(ident, words.alias("_w")).where(F.size("_w") >= least_words).select(ident, simhash(F.col("_w")).alias("simhash")))
    roots = fingerprint_clusters(prints, ident, "simhash", distance)
    return roots.join(ranked(roots.select(F.col("root").alias("_r")).distinct(), prints, ident), F.col("root") == F.col("_r")).select(ident, F.col("rank").alias("cluster"))


def ranked(wanted: DataFrame, all_rows: DataFrame, order: str) -> DataFrame:
    """(_r, rank): the place of each wanted value among all rows of `all_rows` by `order`, counted without one global sort
    task: sizes of ranges first, then the place within the range.
    """
    parts = all_rows.select(order).repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    parts = checkpointed(parts)
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order))).join(before, "_p")
    return wanted.join(placed, F.col("_r") == F.col(order)).select("_r", (F.col("_before") + F.col("_i")).alias("rank"))
