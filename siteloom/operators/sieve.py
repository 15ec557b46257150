"""A sieve of fixed size: rows that surely have no partner are left out before they are shuffled for a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.sources.schema import MOST_IDS

#: Rows that are worth one.
WORTH = 100_000
#: Bits of a sieve (1 MB), whatever the data. Of more keys than a quarter of that it lets too much pass to be worth a pass.
BITS = 1 << 23
MOST_KEYS = BITS // 4


def _bit(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def sieved(rows: DataFrame, among: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` without most of those whose `keys` are not in `among`; all whose keys are in it stay."""
    bit = among.select(_bit(keys).alias("_b"))
    words = bit.select(F.shiftright("_b", 6).alias("_w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_b").bitwiseAND(F.lit(63)).cast("int")).alias("_bits"))
    none = rows.sparkSession.range(BITS // 64).select(F.col("id").alias("_w"), F.lit(0).cast("bigint").alias("_bits"))
    words = words.unionByName(none).groupBy("_w").agg(F.bit_or("_bits").alias("_bits"))
    table = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_bits"))), lambda x: x["_bits"]))
    at = _bit(keys)
    held = F.getbit(F.get(table.scalar(), F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.where(held)  # no join: a join with the partners would be moved below it


def within(rows: DataFrame, among: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose `keys` are in `among`, which is kept and counted: few are handed round, more sieve the rows before the join."""
    n = among.count()
    if n <= MOST_IDS:
        return rows.join(F.broadcast(among), keys, "left_semi")
    return (sieved(rows, among, keys) if n <= MOST_KEYS else rows).join(among, keys, "left_semi")
