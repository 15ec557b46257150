"""What was added, removed or changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Up to so many snapshots their order is put into the plan; beyond it is joined.
SNAPSHOTS_INLINE = 1000


def latest(df: DataFrame, keys: list[str], values: list[str], at: str, ident: str) -> DataFrame:
    """Per `keys` the `values` of the row with the latest `at` (null: earliest of all; ties: the largest `ident`).

    Rows with a null in `keys` are left out. The pick is an aggregate, so a key fetched very often is reduced before
    the shuffle.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    last = F.max(F.struct(F.col(at).alias("_at"), F.col(ident).alias("_id"), *[F.col(v) for v in values])).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def snapshot_changes(df: DataFrame, snapshot: str, key: str, values: list[str], at: str, ident: str) -> DataFrame:
    """(snapshot, key, change) for each snapshot after the first, against the next smaller snapshot.

    change is `added`, `removed` or `changed`; `changed` means that any of `values` differs exactly, null being
    different from the empty text. Of several rows of one (snapshot, key) the latest holds (see `latest`). Rows with a
    null snapshot or key are left out; one snapshot or none gives no rows.

    Each state is counted +1 in its own snapshot and -1 in the next, and equal rows are summed: what is left over zero is
    `new EXCEPT ALL old`, what is left under zero `old EXCEPT ALL new`, both ways from one aggregate. The
    residues - only rows that differ - are full-joined by key to label them.
    """
    state = latest(df.select(snapshot, key, *values, at, ident), [snapshot, key], values, at, ident)
    ids = [r[0] for r in df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().orderBy(snapshot).limit(SNAPSHOTS_INLINE + 1).collect()]
    # One shuffle by key alone serves the aggregate over (key, snapshot, values) as well.
    state = state.repartition(key)
    if len(ids) <= SNAPSHOTS_INLINE:
        following = dict(zip(ids, ids[1:]))
        pairs = F.create_map(*[F.lit(x) for kv in following.items() for x in kv]) if following else F.lit(None).cast(f"map<{df.schema[snapshot].dataType.simpleString()},{df.schema[snapshot].dataType.simpleString()}>")
        state = state.withColumn("_next", pairs[F.col(snapshot)]).withColumn("_first", F.lit(ids[0]) if ids else F.lit(None))
    else:
        order = df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct()
        order = order.select(snapshot, F.lead(snapshot).over(Window.orderBy(snapshot)).alias("_next"))
        state = state.join(order, snapshot).withColumn("_first", F.lit(ids[0]))
    sides = F.array(
        F.struct(F.when(F.col(snapshot) != F.col("_first"), F.col(snapshot)).alias("at"), F.lit(1).alias("sign")),
        F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign")),
    )
    signed = state.select(key, *values, F.explode(sides).alias("_side")).select(F.col("_side.at").alias(snapshot), key, *values, F.col("_side.sign").alias("_sign")).where(F.col(snapshot).isNotNull())
    residue = signed.groupBy(key, snapshot, *values).agg(F.sum("_sign").alias("_sign")).where("_sign <> 0")
    new = residue.where("_sign > 0").select(F.col(snapshot), F.col(key), F.lit(True).alias("_new"))
    old = residue.where("_sign < 0").select(F.col(snapshot), F.col(key), F.lit(True).alias("_old"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return new.join(old, [snapshot, key], "full").select(snapshot, key, change.alias("change"))


TRACKED = ["canonical", "h1", "meta_robots", "status_text"]


def crawl_changes(records: DataFrame) -> DataFrame:
    """`snapshot_changes` of crawl_records: (crawl_id, storage_key, change)."""
    return snapshot_changes(records, "crawl_id", "storage_key", TRACKED, "completed_at", "id")


def crawl_change_counts(records: DataFrame) -> DataFrame:
    """(crawl_id, change, pages) of `crawl_changes`."""
    return crawl_changes(records).groupBy("crawl_id", "change").agg(F.count(F.lit(1)).alias("pages"))
