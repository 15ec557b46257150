"""Per-key results without the imbalance of a few hot keys: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it holds at least this share of the rows, or this many rows, whichever is less: what a key that is not
#: hot brings to one task is bounded by the number of rows, however large the table.
HOT_SHARE = 1 / 200
HOT_ROWS = 2_000_000
#: Counters of a summary, eight for each possible hot key; with so many the list of hot keys is at most half a megabyte.
#: Only beyond HOT_ROWS * MOST_TRACKED / 8 rows (1.3e11) does the bound on a key's rows grow with the table.
MOST_TRACKED = 1 << 19
#: Into how many the tasks' summaries of frequent keys are merged first.
SUMMARIES = 32
SALTS = 64


def hot_keys(df: DataFrame, *keys: str, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> dict[str, list]:
    """The values of each key column that hold at least `share` of its rows or `rows` rows, found in one pass over all rows.

    A mergeable frequent-items summary with eight counters per possible hot key is kept per task, so nothing is
    shuffled but the summaries, and they are merged in two steps so that no task reads those of all others. The summary
    overestimates, so no hot key is missed; a key reported by mistake only takes the salted way, whose results are
    the same.
    """
    n = df.count()
    if not n:
        return {k: [] for k in keys}
    share = max(min(share, rows / n), 8 / MOST_TRACKED)
    most = int(1 / share)
    tracked = 8 * most
    part = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(SUMMARIES)).alias("_part")).agg(*[F.expr(f"approx_top_k_accumulate(`{k}`, {tracked})").alias(f"s_{i}") for i, k in enumerate(keys)])
    row = part.groupBy(F.col("_part").isNull()).agg(  # grouped, so that an empty table gives no row instead of an empty summary
        *[F.expr(f"approx_top_k_estimate(approx_top_k_combine(s_{i}, {tracked}), {most})").alias(f"top_{i}") for i, k in enumerate(keys)]
    ).first()
    if row is None:
        return {k: [] for k in keys}
    return {k: [x["item"] for x in row[f"top_{i}"] or [] if x["item"] is not None and x["count"] >= max(n * share, 2)] for i, k in enumerate(keys)}


def hot_tests(df: DataFrame, *keys: str, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> dict[str, list[int]]:
    """`hot_keys` by 64-bit hash, so that long addresses take no more room than short ones. A key that shares the hash of a
    hot one takes the salted way as well, with the same result.
    """
    hashed = df.select(*[F.when(F.col(k).isNotNull(), F.xxhash64(k)).alias(k) for k in keys])
    return hot_keys(hashed, *keys, share=share, rows=rows)


def salt(*cols: str, salts: int = SALTS) -> Column:
    """A salt that a rerun task draws again alike: a hash of the row's identity instead of rand()."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def record_edges(df: DataFrame, key: str, value: str, order: str, ident: str, *, smallest: bool, keep_null_first: bool, hot: list, salts: int = SALTS, hashed: bool = False) -> DataFrame:
    """(ident) of the rows that set a record within their key: the first row, and each that beats all earlier ones.

    Rows of one key are ordered by `order` (ties: smaller `ident` first). A record is strictly smaller
    (`smallest`) or strictly larger than all earlier values. Rows with a null key are left out. A null value never
    beats anything and is beaten by any value; it is a record only as the key's first row, and only where
    `keep_null_first`; otherwise rows with a null value are left out before. Repeated rows count once.

    Cold keys meet in one shuffle and one running aggregate. A hot key's rows are pre-aggregated per salt and value to
    the earliest of each value (a later row of an equal value sets no record), merged by the original key, and only
    these few survivors - one per distinct value - enter the running aggregate of that key. `hot` holds keys, or with
    `hashed` their 64-bit hashes.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.col(order).alias("_order"), F.col(ident).alias("_id"))
    if not keep_null_first:
        rows = rows.where(F.col("_value").isNotNull())
    is_hot = (F.xxhash64("_key") if hashed else F.col("_key")).isin(hot) if hot else F.lit(False)

    earliest = F.min(F.struct("_order", "_id"))
    if order == ident:  # plain longs stay in a hash aggregate, structs would be sorted
        first, again = F.min("_order").alias("_order"), F.min("_order").alias("_order")
    else:
        first, again = earliest.alias("_first"), F.min("_first").alias("_first")
    merged = (
        rows.where(is_hot)
        .withColumn("_salt", salt("_id", salts=salts))
        .groupBy("_key", "_value", "_salt")
        .agg(first)
        .groupBy("_key", "_value")
        .agg(again)
    )
    if order == ident:
        merged = merged.withColumn("_id", F.col("_order"))
    else:
        merged = merged.select("_key", "_value", F.col("_first._order").alias("_order"), F.col("_first._id").alias("_id"))

    def records(part: DataFrame) -> DataFrame:
        w = Window.partitionBy("_key").orderBy("_order", "_id")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        best = (F.min if smallest else F.max)("_value").over(before)
        beats = F.col("_value") < F.col("_best") if smallest else F.col("_value") > F.col("_best")
        return (
            part.withColumn("_n", F.row_number().over(w))
            .withColumn("_best", best)
            .where((F.col("_n") == 1) | F.coalesce(beats, F.lit(False)) | (F.col("_best").isNull() & F.col("_value").isNotNull()))
            .select(F.col("_id").alias(ident))
        )

    cold = records(rows.where(~is_hot).select("_key", "_value", "_order", "_id"))
    return cold.unionByName(records(merged.select("_key", "_value", "_order", "_id"))) if hot else cold


def edge_records(edges: DataFrame, salts: int = SALTS, share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(side, edge_id): links that first reach a target, or reach it from a smaller depth than all links before; and links
    that are a source's first with a known target depth, or lead deeper than all of its links before.

    Addresses are compared literally. An edge with a null address is left out on that side; on the source side so is
    one without target depth. Repeated rows count once; an empty table gives no rows; other columns are ignored.
    """
    df = edges.select("id", "source_url", "target_url", "source_depth", "target_depth", "discovery_order")
    hot = hot_tests(df, "target_url", "source_url", share=share, rows=hot_rows)
    order = "discovery_order"
    target = record_edges(df, "target_url", "source_depth", order, "id", smallest=True, keep_null_first=True, hot=hot["target_url"], salts=salts, hashed=True)
    source = record_edges(df, "source_url", "target_depth", order, "id", smallest=False, keep_null_first=False, hot=hot["source_url"], salts=salts, hashed=True)
    return target.select(F.lit("target").alias("side"), F.col("id").alias("edge_id")).unionByName(source.select(F.lit("source").alias("side"), F.col("id").alias("edge_id")))


def address_totals(edges: DataFrame, salts: int = SALTS, share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(side, address, links, nofollow_links, first_edge, last_edge) of every address on either side.

    Rows without id and null addresses (on their side) are left out. A row goes to the task of its address and salt; the salt
    is made of the id, so that a row's repeats meet there and are dropped by the first stage itself, without a shuffle of
    their own. The salts' partial results are merged by the original address.
    """
    df = edges.select("id", "source_url", "target_url", "rel_nofollow").where(F.col("id").isNotNull())
    hot = hot_tests(df, "target_url", "source_url", share=share, rows=hot_rows)
    parts = []
    for side in ("target", "source"):
        address = F.col(f"{side}_url")
        is_hot = F.xxhash64(address).isin(hot[f"{side}_url"]) if hot[f"{side}_url"] else F.lit(False)
        rows = df.where(address.isNotNull()).select(address.alias("address"), "id", "rel_nofollow", F.when(is_hot, salt("id", salts=salts)).otherwise(F.lit(0)).alias("_salt"))
        once = rows.repartition("address", "_salt").groupBy("address", "_salt", "id").agg(F.bool_or("rel_nofollow").alias("_nf"))
        first = once.groupBy("address", "_salt").agg(F.count(F.lit(1)).alias("n"), F.count_if("_nf").alias("nf"), F.min("id").alias("lo"), F.max("id").alias("hi"))
        got = first.groupBy("address").agg(F.sum("n").alias("links"), F.sum("nf").alias("nofollow_links"), F.min("lo").alias("first_edge"), F.max("hi").alias("last_edge"))
        parts.append(got.select(F.lit(side).alias("side"), "address", "links", "nofollow_links", "first_edge", "last_edge"))
    return parts[0].unionByName(parts[1])
