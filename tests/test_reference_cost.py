"""Reference questions resolve what they are asked for and no more, with as many rounds as paths need."""

import pytest
from siteloom.operators import audit, references
from siteloom.sources.schema import conformed, unrepeated

#: View: how many intermediate results it may keep.
KEPT = {
    "AmpToError": 1, "PaginationPrevToError": 1, "AmpTargetMissingMarker": 1, "AmpNonReciprocal": 2, "PaginationNextNonReciprocal": 1, "PaginationPrevNonReciprocal": 1,
    "PaginationCanonicalToLinkedPage": 1, "PaginationNextLoop": 5, "PaginationPrevLoop": 5,
}


@pytest.fixture
def kept(monkeypatch):
    calls, keep = [], references.checkpointed
    monkeypatch.setattr(references, "checkpointed", lambda df: calls.append(1) or keep(df))
    return calls


def pages(spark):
    """Four pages: 1 and 2 name each other, 3 leads to 1 without return, 4 has failed and is the AMP page of 1."""
    u = lambda i: f"https://s.test/{i}"
    rows = [(1, 200, u(2), u(2), u(4), u(2)), (2, 200, u(1), u(1), None, u(2)), (3, 200, u(1), u(4), u(2), u(1)), (4, 404, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, status_code int, rel_next string, rel_prev string, amphtml string, canonical string")
    return conformed(df.selectExpr("*", "concat('https://s.test/', id) url", "concat('https://s.test/', id) final_url", "'text/html' content_type", "false amp_document"))


WANT = {
    "AmpToError": [1], "PaginationPrevToError": [3], "AmpTargetMissingMarker": [3], "AmpNonReciprocal": [3], "PaginationNextNonReciprocal": [3], "PaginationPrevNonReciprocal": [],
    "PaginationCanonicalToLinkedPage": [1, 3], "PaginationNextLoop": [1, 2, 3], "PaginationPrevLoop": [1, 2],
}


@pytest.mark.parametrize("name", KEPT)
def test_a_view_keeps_only_what_it_asks_for(spark, kept, name):
    assert sorted(r["id"] for r in audit.view(pages(spark), name, scope=[]).collect()) == WANT[name]
    assert len(kept) <= KEPT[name]


def test_flags_of_a_record_are_one_number(spark):
    flags = ["next_loop", "amp_to_error"]
    assert {r["id"]: r["mask"] for r in audit.masks(pages(spark), flags, []).collect()} == {1: 3, 2: 1, 3: 1}


def test_cycles_end_with_the_longest_path(spark, kept):
    nxt = {**{i: i + 10_000 for i in range(10, 2000)}, 1: 2, 2: 1, 3: 1, 4: 5, 5: 6, 6: 7}
    df = spark.createDataFrame(list(nxt.items()), "id long, next long")
    assert {r["id"] for r in references.cycle_ids(df, []).collect()} == {1, 2, 3}
    assert len(kept) <= 5


def test_only_ids_that_come_again_are_looked_at(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "id long, text string")
    assert sorted(map(tuple, unrepeated(df).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert unrepeated(df.where("id <> 2")).count() == 2


#: View: how many lists of names it makes of simple records.
NAMED = {"AmpTargetMissingMarker": 0, "PaginationCanonicalToLinkedPage": 0, "PaginationPrevToError": 0, "AmpNonReciprocal": 1, "PaginationPrevLoop": 0, "PaginationNextNonReciprocal": 0, "PaginationNextLoop": 0, "PaginationPrevNonReciprocal": 0}


@pytest.mark.parametrize("name", NAMED)
def test_simple_records_are_neither_named_nor_searched_for_repeats(spark, monkeypatch, name):
    made, names = [], references.U.with_names
    monkeypatch.setattr(references.U, "with_names", lambda df, **columns: made.append(1) or names(df, **columns))
    monkeypatch.setattr(references, "unrepeated", lambda rows: made.append(9) or unrepeated(rows))
    twice = pages(spark).unionByName(pages(spark).where("id < 4"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        df = spark.createDataFrame(twice.collect(), twice.schema)
        assert sorted(r["id"] for r in audit.view(df, name, scope=[]).collect()) == WANT[name]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(made) <= NAMED[name]
