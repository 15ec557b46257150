"""Near-duplicate texts by SetSketch registers: banded, estimated jointly by likelihood, then verified.

A text is the set of its runs of `WORDS` consecutive words. Register i of its sketch is
    K_i = clip(floor(1 - log_b(min over the set's elements of x_i)), 0, q + 1),   x_i ~ Exp(rate a),
a truncated, exponentially spaced minimum: merging two sketches is the element-wise maximum, and two registers agree
with a probability that grows with the Jaccard similarity (b near 1: it comes close to it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.session import checkpointed

REGISTERS = 200
#: Rows of a band, and the bands that a candidate pair must share. At similarity s (b near 1) a band agrees with probability
#: p = s^4, so of the 50 bands a pair shares three or more with probability 0.99985 at 0.7, 0.61 at 0.5, 0.14 at 0.4 and 0.001 at
#: 0.25: pages that have only their site's furniture in common are rarely paired.
BAND_ROWS = 4
SHARED_BANDS = 3
BASE = 1.002
RATE = 20.0
LIMIT = 16000  # q: b^q is over 7e13, more elements than any text has
WORDS = 3
SIMILARITY = 0.7
LEAST_WORDS = 120

_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n consecutive words, given the words' hashes in order."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        h = _mix(h) + words[i : len(words) - n + 1 + i]
    return np.unique(_mix(h))


def _seeds(registers: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, 2 * registers + 1, dtype=np.uint64)
    s = _mix(i * np.uint64(0x9E3779B97F4A7C15))
    return s[:registers] | np.uint64(1), s[registers:]


def registers_of(elements: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The registers (int16) of a non-empty set of 64-bit hashes.

    x = -ln(1-u)/a falls as the uniform u falls, so each register keeps the least u as an integer and is turned into
    its exponential level once, at the end.
    """
    odd, add = _seeds(registers)
    # Multiply-shift by a random odd factor: its upper 32 bits serve as u.
    low = np.full(registers, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(elements), 256):
        part = elements[at : at + 256]
        low = np.minimum(low, ((part[None, :] * odd[:, None] + add[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    u = (low.astype(np.float64) + 0.5) / 2.0**32
    level = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    return np.clip(level, 0, LIMIT + 1).astype(np.int16)


SKETCH = pa.schema([("_id", pa.int64()), ("_hi", pa.int64()), ("_lo", pa.int64()), ("_size", pa.int32()), ("_registers", pa.list_(pa.int16()))])
SETS = pa.schema([("_id", pa.int64()), ("_set", pa.list_(pa.int64()))])


def _sets(batch: pa.RecordBatch, known: dict[str, int], least_words: int, words_n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Ids and shingle sets of a batch of (id, text). `known` keeps the hashes of words already seen."""
    for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        words = (text or "").lower().split()
        if len(words) < max(least_words, 1):
            continue
        if len(known) > 500_000:
            known.clear()
        hashes = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            hashes[i] = h
        s = shingles(hashes, words_n)
        if len(s):
            yield ident, s


def _texts(df: DataFrame, ident: str, text: str) -> DataFrame:
    return df.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_text")).where(F.col("_id").isNotNull() & F.col("_text").isNotNull())


def sketches(df: DataFrame, ident: str, text: str, least_words: int = LEAST_WORDS, words_n: int = WORDS, registers: int = REGISTERS) -> DataFrame:
    """One row per id with at least `least_words` words (and one shingle): digest and size of its set, and its registers.

    Words are the pieces of the lower-cased text between runs of white space. Null ids and null, empty or shorter texts
    give none.
    """

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            out: dict[str, list] = {n: [] for n in SKETCH.names}
            for ident, s in _sets(batch, known, least_words, words_n):
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                out["_id"].append(ident)
                out["_hi"].append(np.uint64(digest >> 64).view(np.int64))
                out["_lo"].append(np.uint64(digest & _MASK).view(np.int64))
                out["_size"].append(len(s))
                out["_registers"].append(registers_of(s, registers))
            yield pa.RecordBatch.from_pydict(out, schema=SKETCH)

    return _texts(df, ident, text).mapInArrow(run, "_id long, _hi long, _lo long, _size int, _registers array<smallint>")


def shingle_sets(df: DataFrame, ident: str, text: str, ids: DataFrame, least_words: int = LEAST_WORDS, words_n: int = WORDS) -> DataFrame:
    """(_id, _set): the whole shingle sets of the texts in `ids` (_id), once each."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            got = list(_sets(batch, known, least_words, words_n))
            yield pa.RecordBatch.from_pydict({"_id": [i for i, _ in got], "_set": [s.view(np.int64) for _, s in got]}, schema=SETS)

    return _texts(df, ident, text).join(ids, "_id", "left_semi").mapInArrow(run, "_id long, _set array<long>").dropDuplicates(["_id"])


def estimated_similarity(a: Column, b: Column, size_a: Column, size_b: Column, registers: int = REGISTERS) -> Column:
    """The joint likelihood estimate of the Jaccard similarity from how many registers are over, under and equal.

    With u = n_a/(n_a+n_b), v = 1-u the registers of a and b differ upwards and downwards with probabilities p(u - vJ)
    and p(v - uJ), p(x) = -log_b(1 - x(b-1)/b). For b near 1, p(x) is close to x, and the likelihood of the counts
    (D+, D-, D0) peaks where D+/(u-vJ) v + D-/(v-uJ) u = D0 (with the derivative of the equal share, 1): a quadratic in
    J, solved in closed form on the JVM.
    """
    n = (size_a + size_b).cast("double")
    u, v = size_a / n, size_b / n
    step = lambda acc, x: F.struct((acc.p + F.when(x.a > x.b, 1.0).otherwise(0.0)).alias("p"), (acc.m + F.when(x.a < x.b, 1.0).otherwise(0.0)).alias("m"))
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    d = F.aggregate(pairs, F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("m")), step)
    plus, minus = d.p / registers, d.m / registers
    zero = 1 - plus - minus
    # Maximise plus ln(u-vJ) + minus ln(v-uJ) + zero ln J (equal share J(u+v) = J):
    #   -v plus (v-uJ) J - u minus (u-vJ) J + zero (u-vJ)(v-uJ) = 0
    qa = u * v * (plus + minus + zero)
    qb = -(v * v * plus + u * u * minus + zero * (u * u + v * v))
    qc = zero * u * v
    return (-qb - F.sqrt(F.greatest(qb * qb - 4 * qa * qc, F.lit(0.0)))) / (2 * qa)


def classes(sk: DataFrame) -> DataFrame:
    """(_id, _class): texts of equal shingle sets form one class, named by its least id."""
    one = sk.groupBy("_hi", "_lo").agg(F.min("_id").alias("_class"))
    return sk.select("_id", "_hi", "_lo").join(one, ["_hi", "_lo"]).select("_id", "_class").distinct()


def near_pairs(df: DataFrame, ident: str, text: str, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, words_n: int = WORDS, registers: int = REGISTERS, band_rows: int = BAND_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): verified pairs (_a, _b, similarity) of class representatives with a < b and a Jaccard similarity of
    at least `similarity`, and the membership (_id, _class) of every text.

    Equal texts are one class before anything is paired, so a text copied a million times meets its neighbours once. Only
    representatives that share SHARED_BANDS bands and whose sizes allow the similarity become candidates (one shuffle on the band
    key, skewed bands are split by AQE); candidates are told apart by ids alone, then by the registers' estimate with a
    margin of four standard errors, and what remains is verified on the whole sets, which are made again only for the
    texts that still have a candidate. No candidate is capped or sampled.
    """
    sk = checkpointed(sketches(df, ident, text, least_words, words_n, registers))
    members = classes(sk)
    first = sk.groupBy("_hi", "_lo").agg(F.min("_id").alias("_id"))
    reps = sk.join(first, ["_hi", "_lo", "_id"], "left_semi").dropDuplicates(["_id"]).select("_id", "_size", "_registers")
    key = F.transform(F.sequence(F.lit(0), F.lit(registers // band_rows - 1)), lambda i: F.xxhash64(i, F.slice("_registers", i * band_rows + 1, F.lit(band_rows))))
    band = reps.select("_id", "_size", F.explode(key).alias("_band"))
    x, y = band.alias("x"), band.alias("y")
    fits = F.least("x._size", "y._size") >= similarity * F.greatest("x._size", "y._size")
    pairs = (
        x.join(y, (F.col("x._band") == F.col("y._band")) & (F.col("x._id") < F.col("y._id")) & fits)
        .groupBy(F.col("x._id").alias("_a"), F.col("y._id").alias("_b"))
        .agg(F.count(F.lit(1)).alias("_bands"))
        .where(F.col("_bands") >= SHARED_BANDS)
        .select("_a", "_b")
    )
    side = lambda d, c: d.select(*[F.col(n).alias(f"_{c}" + n.replace("_id", "")) for n in d.columns])
    margin = 4 * (similarity * (1 - similarity) / registers) ** 0.5
    close = checkpointed(
        pairs.join(side(reps, "a"), "_a")
        .join(side(reps, "b"), "_b")
        .where(estimated_similarity(F.col("_a_registers"), F.col("_b_registers"), F.col("_a_size"), F.col("_b_size"), registers) >= similarity - margin)
        .select("_a", "_b")
    )
    ids = close.select(F.col("_a").alias("_id")).unionByName(close.select(F.col("_b").alias("_id"))).distinct()
    sets = shingle_sets(df, ident, text, ids, least_words, words_n)
    both = close.join(side(sets, "a"), "_a").join(side(sets, "b"), "_b")
    shared = F.size(F.array_intersect("_a_set", "_b_set")).cast("long")
    union = F.size("_a_set") + F.size("_b_set") - shared
    exact = both.select("_a", "_b", shared.alias("_shared"), union.alias("_union")).where(F.col("_shared") >= similarity * F.col("_union") - 1e-9)
    return exact.select("_a", "_b", (F.col("_shared") / F.col("_union")).alias("similarity")), members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(_a, _b), a < b, of all texts: the pairs of classes spread over their members, and the pairs within a class."""
    between = (
        pairs.join(members.select(F.col("_class").alias("_a"), F.col("_id").alias("_x")), "_a")
        .join(members.select(F.col("_class").alias("_b"), F.col("_id").alias("_y")), "_b")
        .select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b"))
    )
    within = (
        members.alias("x")
        .join(members.alias("y"), (F.col("x._class") == F.col("y._class")) & (F.col("x._id") < F.col("y._id")))
        .select(F.col("x._id").alias("_a"), F.col("y._id").alias("_b"))
    )
    return between.unionByName(within)


def components(pairs: DataFrame, nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(_class, _group): connected components of the classes, each named by its least class id.

    Alternating large-star and small-star steps: their number grows with the logarithm of the longest chain, links are
    kept in tables, and each round is cut through the shared checkpoint folder.
    """
    edges = checkpointed(pairs.select(F.col("_b").alias("u"), F.col("_a").alias("v")))
    count = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == count:
            break
        count = now
    else:
        raise RuntimeError(f"the components have not settled after {rounds} rounds")
    return nodes.join(edges.select(F.col("u").alias("_class"), F.col("v").alias("_root")), "_class", "left").select("_class", F.coalesce("_root", "_class").alias("_group"))


def near_duplicate_pairs(captures: DataFrame) -> DataFrame:
    """(capture_id_a, capture_id_b): all pairs of distinct captures, both with at least 120 words, of similarity 0.7 or more."""
    pairs, members = near_pairs(captures, "capture_id", "visible_text")
    return all_pairs(pairs, members).select(F.col("_a").alias("capture_id_a"), F.col("_b").alias("capture_id_b"))


def near_duplicate_groups(captures: DataFrame) -> DataFrame:
    """(capture_id, class_id, near_duplicate_cluster_id, members): one row per capture of at least 120 words.

    class_id names its exact copies' representative, near_duplicate_cluster_id the least capture of its group.
    """
    pairs, members = near_pairs(captures, "capture_id", "visible_text")
    groups = components(pairs, members.select("_class").distinct())
    got = members.join(groups, "_class")
    size = got.groupBy("_group").agg(F.count(F.lit(1)).alias("members"))
    return got.join(size, "_group").select(F.col("_id").alias("capture_id"), F.col("_class").alias("class_id"), F.col("_group").alias("near_duplicate_cluster_id"), "members")
