"""Plans of containers against their conditions, and packing of tables."""

from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from siteloom.llm import packing as P


@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
@settings(max_examples=400, deadline=None)
def test_plan_is_whole_and_within_capacity(capacity, histogram):
    histogram = {s: n for s, n in histogram.items() if s <= capacity}
    used, placed = defaultdict(int), Counter()
    for s, at, n, first, each in P.plan(histogram, capacity):
        for r in range(n):
            used[first + r // each] += s
            placed[s, at + r] += 1
    assert placed == Counter({(s, r): 1 for s, n in histogram.items() for r in range(n)})
    assert set(used) == set(range(len(used))) and max(used.values(), default=0) <= capacity
    assert len(used) <= 1.5 * P.lower_bound(histogram, capacity) + 1


def test_plan_is_short_for_huge_counts():
    lines = P.plan({s: 10**9 + s for s in range(1, 513)}, 512)
    assert len(lines) < 5000


def test_plan_pairs_large_items():
    containers = {first + r // each for _, _, n, first, each in P.plan({7: 3, 3: 3}, 10) for r in range(n)}
    assert len(containers) == 3


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARES", 7)  # few items a share
    rows = [(i, 3 if i % 3 else 5 + i % 11, "clash") for i in range(200)] + [(900, 0, "x"), (901, None, "x"), (None, 4, "x"), (902, 47, "x"), (903, 20, "x"), (904, 21, "x")]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, piece string").repartition(4)
    got = P.pack(df, "doc_id", "tokens", {"a": 20, "b": 64}).collect()
    for kind, cap in (("a", 20), ("b", 64)):
        mine = [r for r in got if r["container_kind"] == kind]
        used, pieces, sizes = Counter(), defaultdict(list), Counter()
        for r in mine:
            used[r["container_id"]] += r["size"]
            pieces[r["doc_id"]].append(r["piece"])
            sizes[r["doc_id"]] += r["size"]
        assert max(used.values()) <= cap and set(used) == set(range(len(used)))
        assert sizes == Counter({i: n for i, n, _ in rows if i is not None and n})
        assert all(sorted(p) == list(range(-(-sizes[i] // cap))) for i, p in pieces.items())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    assert P.pack(df, "doc_id", "tokens", {"a": 20}).count() == 0
    assert P.pack(df, "doc_id", "tokens", {}).count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "word " * 30)], "doc_id long, text string")
    specs = spark.createDataFrame([("k", 16), ("k", 16), (None, 3), ("z", 0)], "container_kind string, capacity_tokens int")
    got = P.packed_documents(docs, specs).collect()
    assert {r["doc_id"] for r in got} == {1, 4} and sum(r["size"] for r in got) == 2 + 31
    assert P.fill_report(docs, specs).first()["largest"] <= 16
