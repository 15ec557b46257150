"""Reference questions over many records: paths are followed within blocks of ids, and few partners sieve the rows."""

import pytest
from pyspark.sql import functions as F
from siteloom.operators import audit, references, sieve
from siteloom.sources.schema import conformed


@pytest.fixture
def kept(monkeypatch):
    calls, keep = [], references.checkpointed
    monkeypatch.setattr(references, "checkpointed", lambda df: calls.append(1) or keep(df))
    return calls


def series(spark, kind):
    """Pages 1 to 900 in a row; 901 to 930 in rings of ten; 931 names itself, 932 names 931; 933 leads into a ring."""
    to = {**{i: i + 1 for i in range(1, 900)}, **{i: i + 1 if i % 10 else i - 9 for i in range(901, 931)}, 931: 931, 932: 931, 933: 905, 900: None}
    u = lambda i: i and f"https://s.test/p/{i}"
    df = spark.createDataFrame([(1, i, 200, u(i), u(n)) for i, n in to.items()], f"crawl_id int, id long, status_code int, url string, rel_{kind} string")
    return conformed(df.selectExpr("*", "url final_url", "'text/html' content_type"), ("crawl_id",))


LOOPS = [*range(901, 932), 933]


@pytest.mark.parametrize("kind, view", [("next", "PaginationNextLoop"), ("prev", "PaginationPrevLoop")])
@pytest.mark.parametrize("block, together", [(14, 1 << 20), (4, 1 << 20), (2, 20), (1, 0)])
def test_loops_are_the_same_in_blocks_of_any_size(spark, monkeypatch, kept, kind, view, block, together):
    monkeypatch.setattr(references, "BLOCK", block)
    monkeypatch.setattr(references, "TOGETHER", together)
    assert sorted(r["id"] for r in audit.view(series(spark, kind), view).collect()) == LOOPS
    if block == 14:  # the edges are not kept, and a long row takes no rounds
        assert len(kept) == 1


def test_a_sieve_keeps_all_partners_and_little_else(spark):
    rows, among = spark.range(200_000), spark.range(0, 200_000, 10)
    left = sieve.sieved(rows, among, ["id"])
    assert left.join(among, "id").count() == 20_000
    assert left.count() < 22_000
    assert sorted(r["id"] for r in sieve.within(rows, among, ["id"]).where("id < 50").collect()) == [0, 10, 20, 30, 40]
    assert sieve.within(rows, among.where("id < 100"), ["id"]).agg(F.count(F.lit(1))).first()[0] == 10


def test_amp_pages_are_told_by_their_canonical_without_lists_of_names(spark, monkeypatch):
    made, names = [], references.U.with_names
    monkeypatch.setattr(references.U, "with_names", lambda df, **columns: made.append(1) or names(df, **columns))
    u = lambda i: i and f"https://s.test/p/{i}"
    rows = [(i, u(i + 10), u(i)) for i in range(1, 6)] + [(11, None, u(11)), (12, None, u(2)), (13, None, " "), (14, None, u(1)), (15, None, None)]
    df = spark.createDataFrame([(1, i, 200, u(i), amp, canonical) for i, amp, canonical in [*rows, *((i, None, u(i)) for i in range(100, 160))]], "crawl_id int, id long, status_code int, url string, amphtml string, canonical string")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    odd = F.when(F.col("id") == 14, F.concat(F.lit(u(4)), F.lit("#top"))).otherwise(F.col("canonical"))
    try:
        for least in (0, 100_000):  # with a sieve and without
            monkeypatch.setattr(sieve, "WORTH", least)
            shop = conformed(df.selectExpr("*", "url final_url", "'text/html' content_type"), ("crawl_id",))
            assert sorted(r["id"] for r in audit.view(shop, "AmpNonReciprocal").collect()) == [1, 3, 4, 5]
        assert not made
        assert sorted(r["id"] for r in audit.view(shop.withColumn("canonical", odd), "AmpNonReciprocal").collect()) == [1, 3, 5]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("kind, other, view", [("next", "prev", "PaginationNextNonReciprocal"), ("prev", "next", "PaginationPrevNonReciprocal")])
def test_one_join_tells_whether_a_target_leads_back(spark, monkeypatch, kind, other, view):
    made, index = [], references.alias_index
    monkeypatch.setattr(references, "alias_index", lambda *a: made.append(1) or index(*a))
    u = lambda i: i and f"https://s.test/p/{i}"
    forth, back = {1: 2, 3: 4, 6: 7, 8: 9, 10: 11, 12: 13, 14: 14, 15: 98}, {2: 1, 4: 5, 7: 99, 11: 11}
    rows = [(1, i, 404 if i == 13 else 200, u(i), u(forth.get(i)), u(back.get(i))) for i in range(1, 16)]
    at = lambda rows: conformed(spark.createDataFrame(rows, f"crawl_id int, id long, status_code int, url string, rel_{kind} string, rel_{other} string").selectExpr("*", "url final_url", "'text/html' content_type"), ("crawl_id",))
    assert sorted(r["id"] for r in audit.view(at([*rows, *rows[:2]]), view).collect()) == [3, 8, 10]
    assert not made
    # Another record of an address: the way back leads to the first.
    assert sorted(r["id"] for r in audit.view(at([*rows, (1, 20, 200, u(1), u(2), None)]), view).collect()) == [3, 8, 10, 20]
    assert made
