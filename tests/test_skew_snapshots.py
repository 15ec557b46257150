"""Hot keys and snapshot changes against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import random
from collections import defaultdict

import pytest
from siteloom.operators import skew, snapshots

EDGE = "id long, source_url string, target_url string, source_depth long, target_depth long, discovery_order long, rel_nofollow boolean, _key string, _value long, _salt int"


def edges(n, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = None if r.random() < 0.05 else "hot" if r.random() < 0.4 else f"t{r.randint(0, n // 4)}"
        s = None if r.random() < 0.05 else "hub" if r.random() < 0.35 else f"s{r.randint(0, n // 4)}"
        rows.append((i, s, t, r.choice([None, 0, 1, 2, 3, 9]), r.choice([None, 0, 1, 5, 7]), i, r.random() < 0.2, "x", 1, 0))
    return rows + rows[: n // 10]  # repeats


def records(rows):
    out = set()
    for side, key, value, better in (("target", 2, 3, lambda a, b: a < b), ("source", 1, 4, lambda a, b: a > b)):
        best, seen = {}, set()
        for r in sorted(set(rows)):
            k, v = r[key], r[value]
            if k is None or (side == "source" and v is None):
                continue
            if k not in seen or (v is not None and (best.get(k) is None or better(v, best[k]))):
                out.add((side, r[0]))
            seen.add(k)
            if v is not None and (best.get(k) is None or better(v, best[k])):
                best[k] = v
    return out


@pytest.mark.parametrize("share", [1 / 3, 1 / 200])
def test_edge_records(spark, share):
    rows = edges(600)
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, EDGE).repartition(5)
    got = [tuple(r) for r in skew.edge_records(df, salts=4, share=share).collect()]
    assert len(got) == len(set(got)) and set(got) == records(rows)


def test_edge_records_without_an_order_column_of_its_own(spark):
    rows = [("a", 5, 1, 10), ("a", 5, 1, 9), ("a", 3, 2, 4), ("b", None, 1, 7), ("b", 2, 3, 8), (None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "k string, v int, o int, i int")
    for hot in ([], ["a"]):
        got = skew.record_edges(df, "k", "v", "o", "i", smallest=True, keep_null_first=True, hot=hot, salts=3)
        assert sorted(r[0] for r in got.collect()) == [4, 7, 8, 9]


def test_empty_edges(spark):
    df = spark.createDataFrame([], EDGE)
    assert skew.edge_records(df).collect() == []
    assert skew.address_totals(df).collect() == []


def test_address_totals(spark):
    rows = edges(400, 8)
    got = {(r["side"], r["address"]): tuple(r)[2:] for r in skew.address_totals(spark.createDataFrame(rows, EDGE), salts=4, share=0.1).collect()}
    want = defaultdict(list)
    for r in set(rows):
        for side, k in (("target", r[2]), ("source", r[1])):
            if k is not None:
                want[side, k].append(r)
    assert got == {k: (len(v), sum(x[6] for x in v), min(x[0] for x in v), max(x[0] for x in v)) for k, v in want.items()}


def test_hot_keys_finds_every_hot_key(spark):
    rows = [("a",)] * 300 + [("b",)] * 200 + [(f"k{i}",) for i in range(500)]
    assert {"a", "b"} <= set(skew.hot_keys(spark.createDataFrame(rows, "k string").repartition(6), "k", share=0.1)["k"])


def test_no_key_brings_more_rows_than_the_bound_to_one_task(spark):
    """Keys of 0.4 % of the rows are under the share, but over the bound on rows: they take the salted way."""
    rows = [(f"k{i % 250}",) for i in range(2500)]
    df = spark.createDataFrame(rows, "k string").repartition(6)
    assert skew.hot_keys(df, "k")["k"] == []
    assert set(skew.hot_keys(df, "k", rows=10)["k"]) == {r[0] for r in rows}


def test_bound_on_rows_changes_no_result(spark):
    rows = edges(500, 4)
    df = spark.createDataFrame(rows, EDGE).repartition(5)
    assert {tuple(r) for r in skew.edge_records(df, salts=4, hot_rows=2).collect()} == records(rows)
    few, many = (sorted(map(tuple, skew.address_totals(df, salts=4, hot_rows=n).collect())) for n in (2, 10**6))
    assert few == many


STATE = "crawl_id int, id long, storage_key string, canonical string, h1 string, meta_robots string, status_text string, completed_at long, change string, _sign int"


def changes(rows):
    states = defaultdict(dict)
    for r in rows:
        if r[0] is None or r[2] is None:
            continue
        at = (r[7] is not None, r[7] or 0, r[1])
        if r[2] not in states[r[0]] or at > states[r[0]][r[2]][0]:
            states[r[0]][r[2]] = (at, r[3:7])
    out, ids = set(), sorted(states)
    for old, new in zip(ids, ids[1:]):
        a, b = states[old], states[new]
        out |= {(new, k, "added") for k in b.keys() - a.keys()} | {(new, k, "removed") for k in a.keys() - b.keys()}
        out |= {(new, k, "changed") for k in a.keys() & b.keys() if a[k][1] != b[k][1]}
    return out


@pytest.mark.parametrize("inline", [1000, 1])
def test_snapshot_changes(spark, monkeypatch, inline):
    monkeypatch.setattr(snapshots, "SNAPSHOTS_INLINE", inline)
    r = random.Random(2)
    text = lambda: r.choice([None, "", "a", "A", "a ", "ä", "ä"])
    rows = [(r.choice([3, 8, 12, None]), i, r.choice([None, *"abcdefgh"]), text(), "h", text(), r.choice(["OK", ""]), r.choice([None, 1, 2, 2]), "clash", 1) for i in range(160)]
    df = spark.createDataFrame(rows + rows[:20], STATE).repartition(3)
    got = [tuple(x) for x in snapshots.crawl_changes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == changes(rows)


def test_snapshots_of_one_crawl_or_none(spark):
    one = spark.createDataFrame([(3, 1, "a", None, None, None, None, 1, "x", 1)], STATE)
    assert snapshots.crawl_changes(one).collect() == []
    assert snapshots.crawl_changes(one.limit(0)).collect() == []
