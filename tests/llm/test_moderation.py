"""Moderation: labelled examples, disguised spellings, other senses, and the defined results of odd tables."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from siteloom.llm import moderation as M


def distance(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.fixture(scope="module")
def context(spark):
    return M.fitted_context(spark.read.parquet("/root/testdata/sf0.001/moderation_samples.parquet"))


def wrong(rows, context):
    match = M.Matcher()
    return [r["text"] for r in rows if (M.judge(r["text"], match, context)[0] >= M.THRESHOLD) != (r["label"] != "none")]


def test_labelled_samples_that_the_fit_has_not_seen(spark):
    samples = spark.read.parquet("/root/testdata/sf0.001/moderation_samples.parquet")
    context = M.fitted_context(samples)
    assert set(context) == set(M.PRIOR) and context["aside"] < 0 < context["addressed"]
    unseen = [r for r in samples.collect() if r["sample_id"] % 2]
    bad = wrong(unseen, context)
    assert len(unseen) >= 250 and len(bad) <= 0.03 * len(unseen), bad[:5]


def test_fit_without_samples_is_the_prior():
    assert M.fit_context([]) == M.PRIOR and M.fit_context([(1, "Hello there", "none"), (2, None, "none")]) == M.PRIOR


@pytest.mark.parametrize("text", ["You are an idiot", "you are an 1d10t", "you are an iiiidiooot", "you are an i d i o t ,", "yоu аrе аn idiоt", "you are an id​iot", "YOU ARE AN IDIOT!!!", "you are an idoit", "you are an i***t"])
def test_spellings(text):
    assert M.judge(text, M.Matcher())[0] >= M.THRESHOLD


@pytest.mark.parametrize("text", ["Where is the whole shore?", "The novel calls him an idiot, the essay says.", "A bitch and her four puppies were adopted.", "Cocktail classes in Essexham assess the glass.", "The breast cancer screening unit offers sexual health advice.", "Damn, that soup was good.", "He was called an idiot by the moderators.", ""])
def test_other_senses(text):
    assert M.judge(text, M.Matcher())[0] < M.THRESHOLD


@pytest.mark.parametrize("text", ["You are a sashole and you know it.", "you psshole", "you notherfucker", "you xdiot", "you *sshole", "you fuxk", "fcuk you", "fukc you", "you shjt", "you kunt", "You are a wankxr."])
def test_disguises_of_any_letter_and_of_short_words(context, text):
    assert M.judge(text, M.Matcher(), context)[0] >= M.THRESHOLD


@pytest.mark.parametrize("text", ["Hang the Zorvani from the bridge, all of them", "we must cleanse the streets of zorvani before they breed any more.", "Zorvani sind von Natur aus dumm und kriminell.", "Those newcomers are animals, not humans."])
def test_groups_are_known_by_what_is_said_of_them(text):
    assert M.judge(text, M.Matcher())[1] == "hateful" and M.judge(text, M.Matcher())[0] >= M.THRESHOLD


@pytest.mark.parametrize("text", ["Pigeons are vermin.", "The Zorvani choir sang at the market, we loved every minute", "My Zorvani neighbour taught me to hang the wallpaper.", "You duck and you suit that shift.", "Mice are breeding in the barn."])
def test_what_only_resembles_hate_or_abuse(text):
    assert M.judge(text, M.Matcher())[0] < M.THRESHOLD


def test_flags_do_not_depend_on_copies_or_other_texts(spark):
    text, own = "You are an idoit", "You are where the whole regard and the price of bread are"
    for copies in (1, 2, 5):
        df = spark.createDataFrame([(i, text) for i in range(copies)] + [(100 + i, own) for i in range(copies)] + [(200, "You are an idoit, said he")], "doc_id long, text string")
        assert sorted(r["doc_id"] for r in M.flagged_documents(df).collect()) == [*range(copies), 200]


@pytest.mark.parametrize("text", ["You are an *diot", "you are an **iot", "you are an odiot", "you are an ediot", "you *itch", "You are an *idiot*", "you are a joron", "your are an imbecile, an **becile"])
def test_spellings_of_the_first_letter(text):
    assert M.judge(text, M.Matcher())[0] >= M.THRESHOLD


@given(st.text("abcd", min_size=1, max_size=7), st.lists(st.text("abcd", min_size=1, max_size=7), min_size=1, max_size=6, unique=True), st.integers(0, 2))
@settings(max_examples=300, deadline=None)
def test_whole_trie_walk_equals_edit_distance(token, words, most):
    got = dict(M.Trie({w: i for i, w in enumerate(words)}).near(token, most))
    assert got == {i: distance(token, w) for i, w in enumerate(words) if distance(token, w) <= most}


def test_long_tokens_are_not_shortened():
    assert M.Matcher()("x" * 1_000_000) is None and M.Matcher().find("ab" * 100_000) is None


def test_ordinary_words_are_no_entries_but_near_one():
    for w in M.ORDINARY:
        assert w not in M.PLACE and M.trie().near(w, M.edits(w)), w


def test_table(spark):
    long = "The bridge is long. " * 5000 + "You absolute moron, nobody likes you."
    rows = [(1, None, "s", 0), (2, "", "s", 0), (3, "  ", None, 0), (4, long, "s", 0), (4, long, "s", 0), (5, "A kettle.", None, 0), (None, "You moron", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    assert [r["doc_id"] for r in M.flagged_documents(df).collect()] == [4]
    assert M.document_scores(df).count() == len(rows)
    rates = {r["source"]: (r["documents"], r["flagged"]) for r in M.source_rates(df).collect()}
    assert rates == {"s": (5, 3), None: (2, 0)}
    assert M.flagged_documents(df.limit(0)).count() == 0 and M.source_rates(df.limit(0)).count() == 0
