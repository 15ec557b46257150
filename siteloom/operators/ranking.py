"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.session import checkpointed


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with a long column `name`: the place of each row in the given order (which must tell all rows apart), from
    `start`; with `by` within each value of these columns.

    Rows are sorted by range; each range's rows are counted and numbered for itself and moved on by the rows of the ranges
    before it, so that neither the table nor a hot value of `by` is brought into one task.
    """
    parts = checkpointed(rows.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))  # one partitioning for both passes
    sizes = parts.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order)))
    placed = placed.alias("r").join(before.select(F.col("_p").alias("_bp"), *[F.col(c).alias(f"_b_{c}") for c in by], "_before"), (F.col("_p") == F.col("_bp")) & (F.lit(True) if not by else _all([F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by])))
    return placed.select(*rows.columns, (F.col("_before") + F.col("_i") - 1 + start).cast("long").alias(name))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
