"""Filling containers of fixed capacity: large-item matching and best fit, planned on the histogram of sizes.

Items of one size are interchangeable, so the plan is made for (size, count) instead of items: at most `capacity` rows
however many documents there are. Each plan line covers a run of containers, and the items of a size are handed out to
the lines by their rank, which the executors compute.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm import tokenizer
from siteloom.session import checkpointed

#: Into how many parts, by a hash of their id, the items of one size are ranked. The number is fixed, so that where an item goes
#: depends on the items alone and not on how many there must be before they are split.
SHARES = 64


class _Gaps:
    """Runs of open containers by the space left in them, the tightest first."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(self, gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if not self.runs[gap]:
                insort(self.sizes, gap)
            self.runs[gap].append((first, count))

    def tightest(self, size: int) -> int | None:
        """The least space that still takes an item of `size`."""
        i = bisect_left(self.sizes, size)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, gap: int) -> tuple[int, int]:
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.sizes.remove(gap)
        return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Lines (size, first rank, ranks, first container, items per container).

    Item r of a size (ranks from 0) goes to container `first container + (r - first rank) // items per container` of the
    line that holds its rank. Sizes are in 1..capacity.

    Items over a third of the capacity are at most two to a container: going down from the largest, each size is
    matched with the largest partner that still fits, whole runs at a time, and what finds none stands alone. Smaller
    items follow, largest first, each into the tightest gap that takes it, a run of equal gaps at once; only what fits
    nowhere opens a new container. Every step uses up a size or a run of gaps, so there are few more steps than sizes.
    """
    lines: list[tuple[int, int, int, int, int]] = []
    left = {s: n for s, n in histogram.items() if n > 0}
    given: dict[int, int] = defaultdict(int)
    gaps, containers = _Gaps(), 0

    def hand(size: int, count: int, first: int, each: int = 1) -> None:
        lines.append((size, given[size], count, first, each))
        given[size] += count
        left[size] -= count

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside a
        while i >= 0 and (not left[large[i]] or (large[i] == a and left[a] < 2)):
            if not left[large[i]]:
                large.pop(i)
            i -= 1
        if i < 0:
            n = left[a]
            hand(a, n, containers)
            gaps.put(capacity - a, containers, n)
        elif large[i] == a:
            n = left[a] // 2
            hand(a, 2 * n, containers, 2)
            gaps.put(capacity - 2 * a, containers, n)
        else:
            b = large[i]
            n = min(left[a], left[b])
            hand(a, n, containers)
            hand(b, n, containers)
            gaps.put(capacity - a - b, containers, n)
        containers += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = gaps.tightest(s)
            if gap is None:
                gap, n = capacity, -(-left[s] // (capacity // s))
                first, containers = containers, containers + n
            else:
                first, n = gaps.take(gap)
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                hand(s, full * each, first, each)
                gaps.put(gap - each * s, first, full)
            rest = left[s] if full < n else 0
            if rest:  # fewer than `each` are left: one container of the run takes them
                hand(s, rest, first + full, rest)
                gaps.put(gap - rest * s, first + full, 1)
                full += 1
            gaps.put(gap, first + full, n - full)
    return lines


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer containers: the total over the capacity, or the items over half of it if they are more."""
    return max(-(-sum(s * n for s, n in histogram.items()) // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))


def pack(items: DataFrame, ident: str, size: str, kinds: dict[str, int]) -> DataFrame:
    """(container_kind, container_id, `ident`, piece, size): every item of positive size once per kind of container.

    An item over the capacity is cut into full containers (pieces 0, 1, ...) and a remainder, which is packed like an
    item; all others are whole (piece 0). Items with a null id, or a null or non-positive size, are left out. Ids are
    unique (a repeated row would be packed twice). container_id counts from 0 within its kind.

    The sizes' histogram (at most `capacity` rows for each kind) goes to the driver, the plan comes back as a broadcast of
    the same order. Ranks within a size come from counts per (size, share) and a row number within each share, so a size
    that holds a third of all items is ranked by many tasks.
    """
    spark = items.sparkSession
    if not kinds:
        return items.limit(0).select(F.lit("").alias("container_kind"), F.lit(0).cast("long").alias("container_id"), ident, F.lit(0).alias("piece"), F.col(size).cast("long").alias("size"))
    one = items.where(F.col(ident).isNotNull() & (F.col(size) > 0)).select(F.col(ident), F.col(size).cast("long").alias("_size"))
    caps = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(int(c)).cast("long").alias("cap")) for k, c in kinds.items()])
    rest = one.select(ident, "_size", F.explode(caps).alias("_c")).select(
        F.col("_c.kind").alias("container_kind"), F.col("_c.cap").alias("_cap"), F.col(ident), "_size", F.floor((F.col("_size") - 1) / F.col("_c.cap")).alias("_full")
    ).withColumn("_rest", F.col("_size") - F.col("_full") * F.col("_cap"))
    total = rest.groupBy("container_kind", "_rest").agg(F.count(F.lit(1)).alias("n"), F.sum("_full").alias("full")).collect()
    histograms: dict[str, dict[int, int]] = defaultdict(dict)
    whole: dict[str, int] = defaultdict(int)
    for r in total:
        histograms[r["container_kind"]][r["_rest"]] = r["n"]
        whole[r["container_kind"]] += r["full"]
    tables, offset = {}, {}
    for k, c in kinds.items():
        by: dict[int, list] = defaultdict(list)
        lines = plan(histograms[k], int(c))
        for s, at, _, first, each in lines:
            by[s].append((at, first, each))
        tables[k] = {s: tuple(np.array(x, np.int64) for x in zip(*v)) for s, v in by.items()}
        offset[k] = max((first + (n - 1) // each for _, _, n, first, each in lines), default=-1) + 1
    sent = spark.sparkContext.broadcast(tables)

    # Rank from 0 of each item within its (kind, size); full pieces get containers of their own behind the planned ones.
    rest = rest.withColumn("_share", F.pmod(F.xxhash64(ident), F.lit(SHARES)))
    ranked = rest.withColumn("_rank", F.row_number().over(Window.partitionBy("container_kind", "_rest", "_share").orderBy(ident)) - 1)
    sums = rest.groupBy("container_kind", "_rest", "_share").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("container_kind", "_rest").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("container_kind", "_rest", "_share", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    ranked = ranked.join(sums, ["container_kind", "_rest", "_share"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    kind_of = dict(items.dtypes)[ident]

    def place(batches):
        lines = sent.value
        for batch in batches:
            kind, left, rank = batch.column(0).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            out = np.zeros(len(rank), np.int64)
            keys = defaultdict(list)
            for i, key in enumerate(zip(kind, left.tolist())):
                keys[key].append(i)
            for (k, s), rows in keys.items():
                at, first, each = lines[k][s]
                r = rank[rows]
                j = np.searchsorted(at, r, "right") - 1
                out[rows] = first[j] + (r - at[j]) // each[j]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), batch.column(1), batch.column(4), batch.column(2)], names=["container_kind", "container_id", ident, "piece", "size"])

    placed = ranked.select("container_kind", ident, "_rest", F.col("_rank").cast("long"), F.col("_full").cast("int").alias("piece")).mapInArrow(
        place, f"container_kind string, container_id long, `{ident}` {kind_of}, piece int, size long"
    )
    if not any(whole.values()):
        return placed
    # Full pieces: numbered by a running count over the few distinct numbers of pieces per share, then within the item.
    over = rest.where("_full > 0").withColumn("_share", F.pmod(F.xxhash64(ident), F.lit(SHARES)))
    before = Window.partitionBy("container_kind", "_share").orderBy(ident).rowsBetween(Window.unboundedPreceding, -1)
    sums = over.groupBy("container_kind", "_share").agg(F.sum("_full").alias("_n"))
    w = Window.partitionBy("container_kind").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("container_kind", "_share", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    base = F.create_map(*[F.lit(x) for k, v in offset.items() for x in (k, v)])
    full = (
        over.withColumn("_within", F.coalesce(F.sum("_full").over(before), F.lit(0)))
        .join(sums, ["container_kind", "_share"])
        .select("container_kind", (base[F.col("container_kind")] + F.col("_before") + F.col("_within")).alias("_first"), ident, "_cap", F.explode(F.sequence(F.lit(0), (F.col("_full") - 1).cast("int"))).alias("piece"))
        .select("container_kind", (F.col("_first") + F.col("piece")).cast("long").alias("container_id"), ident, "piece", F.col("_cap").alias("size"))
    )
    return placed.unionByName(full)


def kinds_of(specs: DataFrame) -> dict[str, int]:
    """Kinds and capacities of container_specs, a table of a few rows; null or non-positive capacities are left out."""
    return {r[0]: int(r[1]) for r in specs.select("container_kind", "capacity_tokens").where("container_kind is not null and capacity_tokens > 0").distinct().collect()}


def packed_documents(documents: DataFrame, specs: DataFrame, vocabulary: str = tokenizer.VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, size) of all non-empty documents, sizes in tokens of the vocabulary."""
    sizes = tokenizer.token_counts(documents, "text", ["doc_id"], vocabulary)
    return pack(_kept(sizes), "doc_id", "tokens", kinds_of(specs))


def fill_report(documents: DataFrame, specs: DataFrame, vocabulary: str = tokenizer.VOCABULARY) -> DataFrame:
    """(container_kind, containers, tokens, fill, largest): the share of the opened space that is used."""
    kinds = kinds_of(specs)
    packed = packed_documents(documents, specs, vocabulary)
    by = packed.groupBy("container_kind", "container_id").agg(F.sum("size").alias("used")).groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("largest"))
    capacity = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v)]) if kinds else F.lit(None).cast("map<string,int>")
    return by.select("container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * capacity[F.col("container_kind")])).alias("fill"), "largest")


def _kept(sizes: DataFrame) -> DataFrame:
    """(doc_id, tokens), written once so that the corpus is tokenised once, and a lost executor costs no second pass."""
    return checkpointed(sizes)
