"""Encoding against the public library, exact round trips, and the scan against a sequential automaton."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from siteloom.llm import tokenizer as T


@pytest.fixture(scope="module")
def bpe():
    with open(T.VOCABULARY, "rb") as f:
        return T.Bpe.read(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def check(bpe, library, texts):
    assert bpe.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=200, deadline=None)
def test_any_text(bpe, library, texts):
    check(bpe, library, [t.encode("utf-8", "ignore").decode() for t in texts])


@given(st.lists(st.text(st.sampled_from("'strevlmdX1२ \n\t\xa0　!é"), max_size=40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_contractions_and_white_space(bpe, library, texts):
    check(bpe, library, texts)


def test_odd_texts(bpe, library):
    check(bpe, library, ["", " ", "\n", "a" * 20000, " " * 3000, "=" * 9000 + "x", "<|endoftext|>", "it's we're I'LL 'tis 's's", "👩‍🌾☕️", "नमस्ते", "é", "﻿x"])


def test_scan_equals_stepping():
    r = random.Random(1)
    for n in (0, 1, 63, 64, 65, 1000):
        c = np.array([r.randrange(8) for _ in range(n)], np.uint8)
        state, want = 0, []
        for x in c:
            want.append(state)
            state = T.STEP[x, state]
        assert T._scan(c).tolist() == want if n else True


def test_documents_with_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in T.document_ids(df).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995]), (None, [64])], key=str)
    assert T.document_ids(df.limit(0)).count() == 0


def test_round_trip_and_offsets(spark, bpe):
    texts = ["Zwölf Boxkämpfer's  jagen\n\nViktor 🚲", "", "a  b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = T.encode(df, "text", ["doc_id"], offsets=True)
    back = {v: k for k, v in bpe.ranks.items()}
    for r in enc.collect():
        raw, at = texts[r["doc_id"]].encode(), r["offsets"]
        assert [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])] == [back[i] for i in r["ids"]]
    assert {r["doc_id"]: r["text"] for r in T.decode(enc, "ids", ["doc_id"]).collect()} == dict(enumerate(texts))


def test_counts(spark, bpe):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two three")], "doc_id long, text string")
    assert {r["doc_id"]: r["tokens"] for r in T.token_counts(df, "text", ["doc_id"]).collect()} == {1: 0, 2: 0, 3: 3}
