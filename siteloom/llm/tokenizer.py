"""Encoding with a public byte-level BPE vocabulary, pre-tokenised without regular expressions.

The pre-tokens are those of the vocabulary's public pattern:
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|white space not before text|white space
A batch of texts becomes one array of code points, an array of their classes, and a scan that composes the transition
functions of a small automaton (composition is associative, so blocks are scanned side by side). The slices between
the boundaries feed a cache of merged pairs.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("SITELOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Classes of code points. A2, A3: an apostrophe that can begin a contraction of two or three characters.
OTHER, LETTER, DIGIT, SPACE, WHITE, A2, A3, END, PAD = range(9)
# What the automaton is in after a character: nothing open; a run of letters, digits or others; 1 or 2 characters of a
# contraction still to come; a space that joins what follows.
FRESH, IN_LETTERS, IN_DIGITS, IN_OTHERS, ONE_LEFT, TWO_LEFT, AFTER_SPACE = range(7)
STATES = 7
BLOCK = 64
CHARS_AT_ONCE = 1 << 20


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[class, state]: the next state; starts[class, state]: whether a pre-token starts at the character."""
    step = np.zeros((9, STATES), np.uint8)
    starts = np.zeros((9, STATES), bool)
    runs = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHERS}
    for s in range(STATES):
        for c, run in runs.items():
            step[c, s], starts[c, s] = run, s not in (run, AFTER_SPACE)
        for c, left in ((A2, ONE_LEFT), (A3, TWO_LEFT)):
            joins = s in (IN_OTHERS, AFTER_SPACE)
            step[c, s], starts[c, s] = (IN_OTHERS, False) if joins else (left, True)
        step[SPACE, s], step[WHITE, s], step[END, s], step[PAD, s] = AFTER_SPACE, FRESH, FRESH, s
    for c in (LETTER, DIGIT, OTHER, A2, A3):  # inside a contraction its letters are taken as they come
        step[c, ONE_LEFT], step[c, TWO_LEFT] = FRESH, ONE_LEFT
        starts[c, ONE_LEFT] = starts[c, TWO_LEFT] = False
    return step, starts


STEP, STARTS = _automaton()


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, from its general category."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            table[i] = LETTER if kind == "L" else DIGIT
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = WHITE
    table[0x20] = SPACE
    return table


def _scan(c: np.ndarray) -> np.ndarray:
    """The automaton's state before each character."""
    n = len(c)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, PAD, np.uint8)
    padded[:n] = c
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    flat = STEP.ravel()
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for k in range(BLOCK):  # the function of each block, all blocks at once
        whole = flat[columns[k].astype(np.int32)[:, None] * STATES + whole]
    prefix, reach = whole.copy(), 1
    while reach < blocks:  # inclusive scan by doubling: later after earlier
        prefix[reach:] = np.take_along_axis(prefix[reach:], prefix[:-reach].astype(np.int64), axis=1)
        reach *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = prefix[:-1, FRESH]
    before = np.empty((BLOCK, blocks), np.uint8)
    for k in range(BLOCK):
        before[k] = state
        state = flat[columns[k].astype(np.int32) * STATES + state]
    return before.T.ravel()[:n]


def boundaries(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point. `ends` are the places of the separators between texts."""
    c = classes()[codes]
    c[ends] = END
    after = np.zeros(len(c) + 2, np.uint32)
    after[: len(c)] = codes
    after[ends] = 0
    a, b = after[1:-1], after[2:]
    quote = np.flatnonzero((codes == 0x27) & (c != END))
    x, y = a[quote], b[quote]
    one = np.isin(x, [ord(k) for k in "stmd"])
    two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
    c[quote[one]], c[quote[two]] = A2, A3
    start = STARTS[c, _scan(c)]
    white = (c == SPACE) | (c == WHITE)
    before = np.concatenate(([False], white[:-1]))
    then = np.concatenate((c[1:], [END]))
    text_follows = (then != SPACE) & (then != WHITE) & (then != END)
    start[white] = (~before | text_follows)[white]
    start[ends] = True
    return start


class Bpe:
    """Byte-pair merging by rank with a cache of whole pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], cached: int = 1_000_000):
        self.ranks, self.cached, self.cache = ranks, cached, {}
        self.bytes = [bytes([i]) for i in range(256)]

    @classmethod
    def read(cls, blob: bytes) -> Bpe:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a})

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the pair of least rank, leftmost first, is merged until none is left."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        part = [self.bytes[x] for x in piece]
        n = len(part)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None:
                continue
            j = nxt[i]
            if j >= n or len(part[i]) + len(part[j]) != len(both) or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := ranks.get(both + part[k])) is not None:
                    heapq.heappush(heap, (r, i, both + part[k]))
            h = prv[i]
            if h >= 0 and (r := ranks.get(part[h] + both)) is not None:
                heapq.heappush(heap, (r, h, part[h] + both))
        return [ranks[p] for p in part if p is not None]

    def slices(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of every pre-token of the texts in order, and how many pre-tokens each text has."""
        joined = "\n".join(texts) + "\n"
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.flatnonzero(boundaries(codes, ends))
        cuts = start.tolist()
        cuts.append(len(joined))
        separators = np.searchsorted(start, ends)
        count = np.diff(np.concatenate(([-1], separators))) - 1
        cache, skip, out = self.cache, set(separators.tolist()), []
        if len(cache) > self.cached:
            cache.clear()
        add = out.append
        for i in range(len(cuts) - 1):
            if i in skip:
                continue
            piece = joined[cuts[i] : cuts[i + 1]]
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    cache[piece] = ids
            add(ids)
        return out, count

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; an empty text has none."""
        pieces, count = self.slices(texts)
        result, at = [], 0
        for n in count.tolist():
            result.append(list(chain.from_iterable(pieces[at : at + n])))
            at += n
        return result

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        pieces, count = self.slices(texts)
        sizes = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))
        to = np.cumsum(count)
        return (sizes[to] - sizes[to - count]).tolist()


_LOADED: dict[int, Bpe] = {}


def _bpe(blob: bytes) -> Bpe:
    """One Bpe per worker process and vocabulary."""
    key = hash(blob)
    if key not in _LOADED:
        _LOADED[key] = Bpe.read(blob)
    return _LOADED[key]


def groups(texts: list, most: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together, a longer text alone."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file's bytes as a broadcast: under 1 MB, whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """`keep` and ids array<int>: the ids of `text` without special tokens, one row per row.

    A null text and an empty one have the empty list; the literal spelling of a special token is ordinary text. With
    `offsets` also offsets array<int>, the byte of the UTF-8 text at which each token starts, so that any range of ids
    can be traced back to its text.
    """
    blob = _vocabulary(df, vocabulary)
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)

    def run(batches):
        bpe = _bpe(blob.value)
        long = {v: len(k) for k, v in bpe.ranks.items()} if offsets else {}
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in groups(texts):
                ids = bpe.encode([t or "" for t in texts[a:b]])
                cols = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                if offsets:
                    cols.append(pa.array([np.concatenate(([0], np.cumsum([long[i] for i in x])[:-1])).astype(np.int32) if x else [] for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "ids", *["offsets"] * offsets])

    return df.select(*keep, F.col(text)).mapInArrow(run, f"{kinds}, ids array<int>" + ", offsets array<int>" * offsets)


def token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep` and tokens long: the number of ids of `text`; 0 for null and empty texts."""
    blob = _vocabulary(df, vocabulary)
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)

    def run(batches):
        bpe = _bpe(blob.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in groups(texts):
                n = pa.array(bpe.counts([t or "" for t in texts[a:b]]), pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(keep))], n], names=[*keep, "tokens"])

    return df.select(*keep, F.col(text)).mapInArrow(run, f"{kinds}, tokens long")


def decode(df: DataFrame, ids: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep` and text: the text of `ids`; the empty list gives the empty text, null gives null."""
    blob = _vocabulary(df, vocabulary)
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)

    def run(batches):
        back = {v: k for k, v in _bpe(blob.value).ranks.items()}
        for batch in batches:
            texts = [None if x is None else b"".join([back[i] for i in x]).decode("utf-8", "replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[*keep, "text"])

    return df.select(*keep, F.col(ids)).mapInArrow(run, f"{kinds}, text string")


def document_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode(documents, "text", ["doc_id"], vocabulary)
