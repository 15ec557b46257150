"""Near duplicates against all pairs, estimates against exact similarity, components against union-find."""

import random

import numpy as np
from pyspark.sql import functions as F
from siteloom.llm import neardup as N


def texts(n=60, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(160)] for _ in range(n // 5)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            cut = r.randrange(len(w))
            w = w[cut:] + w[:cut]
        out.append((i + 1, " ".join(w).title() if r.random() < 0.2 else "\t".join(w)))
    return out


def sets(rows, least=120):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if i is not None and len(w) >= least:
            out[i] = set(zip(w, w[1:], w[2:]))
    return out


def brute(rows, least=120, similarity=0.7):
    s = sets(rows, least)
    ids = sorted(s)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(s[a] & s[b]) >= similarity * len(s[a] | s[b]) - 1e-9}


def test_pairs_equal_all_pairs(spark):
    rows = texts()
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (104, " "), (105, "short text"), (None, rows[0][1]), (106, "same " * 130), (107, "same " * 140)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "capture_id long, visible_text string, _size int, _a string").repartition(4)
    got = [tuple(r) for r in N.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_no_captures(spark):
    df = spark.createDataFrame([], "capture_id long, visible_text string")
    assert N.near_duplicate_pairs(df).count() == 0 and N.near_duplicate_groups(df).count() == 0


def test_groups_are_components(spark):
    rows = texts(40, 3) + [(200, texts(40, 3)[0][1])]
    parent = {i: i for i in sets(rows)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(rows):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["capture_id"]: r["near_duplicate_cluster_id"] for r in N.near_duplicate_groups(spark.createDataFrame(rows, "capture_id long, visible_text string")).collect()}
    assert got == {i: find(i) for i in parent}


def test_long_chain_has_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "_a long, _b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 62)], "_class long")
    got = {r["_class"]: r["_group"] for r in N.components(pairs, nodes).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 61: 61}


def test_registers_merge_like_unions():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(2))
    both = np.union1d(a, b)
    assert (np.maximum(N.registers_of(a), N.registers_of(b)) == N.registers_of(both)).all()


def test_estimates_come_near(spark):
    r = np.random.default_rng(2)
    rows, exact = [], []
    for share in (0.3, 0.5, 0.7, 0.9):
        for _ in range(10):
            x = r.integers(0, 2**63, 600, dtype=np.uint64)
            k = int(2 * 300 * share / (1 + share))
            a, b = np.unique(x[:300]), np.unique(x[300 - k : 600 - k])
            exact.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
            rows.append((len(rows), N.registers_of(a).tolist(), N.registers_of(b).tolist(), len(a), len(b)))
    df = spark.createDataFrame(rows, "i int, a array<smallint>, b array<smallint>, x int, y int")
    got = [r["e"] for r in df.select("i", N.estimated_similarity(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("e")).orderBy("i").collect()]
    error = np.array(got) - np.array(exact)
    assert abs(error.mean()) < 0.02 and abs(error).max() < 4 * 0.5 / N.REGISTERS**0.5
