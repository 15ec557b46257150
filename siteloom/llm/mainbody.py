"""The main body of a page: a linear-chain conditional random field over leaf blocks, decoded by Viterbi.

The chain runs over the non-blank lines of the visible text in reading order. A line that the markup shows carries the
features of its leaf block (tag, ancestors, kind of container); every line carries features of its text and place, which
alone decide where a page has no usable markup. Labels are kinds of blocks rather than body or not, so that the chain
learns which kinds follow each other.
"""

from __future__ import annotations

import math
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.blocks import CELLS, FURNITURE, HEADINGS, MAIN, TEXTUAL, Page, container_kinds
from siteloom.llm.notices import made_pages, seeds

LABELS = ("heading", "paragraph", "item", "row", "link", "button", "note", "block")
BODY = 4  # the first labels belong to the main body
BITS = 15
#: The labelled sample: the captures whose ids hash lowest, about so many, from the whole table.
SAMPLE = 1600
EPOCHS = 6
#: Features of the markup count more than each of the many features of the text.
MARKUP_WEIGHT = 3.0
#: Captures scored at once.
AT_ONCE = 128

_hashes: dict[str, int] = {}


def slot(feature: str) -> int:
    """The place of a feature among 2^BITS weights."""
    got = _hashes.get(feature)
    if got is None:
        if len(_hashes) > 2_000_000:
            _hashes.clear()
        got = _hashes[feature] = xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return got


_tokens: dict[str, tuple[str, int, bool]] = {}
_pairs: dict[tuple[str, str], int] = {}


def token(raw: str) -> tuple[str, int, bool]:
    """(word, its slot, whether it begins in upper case) of a token: lower case, without marks around it, numbers as 0."""
    got = _tokens.get(raw)
    if got is None:
        if len(_tokens) > 500_000:
            _tokens.clear()
        word = raw.casefold().strip(".,;:!?()…\"'")
        word = "0" if word.isdigit() else word
        got = _tokens[raw] = (word, slot(f"_{word}"), raw[0].isupper())
    return got


def pair_slots(words: list[str]) -> list[int]:
    """Slots of the pairs of consecutive words."""
    out = []
    for key in zip(words, words[1:]):
        got = _pairs.get(key)
        if got is None:
            if len(_pairs) > 300_000:
                _pairs.clear()
            got = _pairs[key] = xxhash.xxh32_intdigest(f"{key[0]} {key[1]}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        out.append(got)
    return out


def label_of(page: Page, kinds: dict[int, tuple[bool, bool]], i: int) -> int:
    """The kind of block that the markup makes of line i, or -1 without a leaf."""
    at = page.leaf[i]
    if at < 0:
        return -1
    leaf = page.leaves[at]
    text, controls = kinds[leaf.container]
    outside = not FURNITURE.isdisjoint(leaf.path) and MAIN.isdisjoint(leaf.path)
    if leaf.tag in HEADINGS:
        return 7 if outside else 0
    if leaf.tag in TEXTUAL:
        return 4 if outside else 2 if leaf.tag in ("li", "dd", "dt") else 1
    if leaf.tag in CELLS:
        return 3
    if leaf.tag in ("a", "label"):
        return 4
    if leaf.tag == "button":
        return 5
    if leaf.tag == "div":
        return 3 if text and not controls and not outside else 7
    return 6


def labels(page: Page) -> list[int] | None:
    """Labels of a page whose markup is unambiguous: every line has a leaf, and no container mixes text with controls."""
    if not page.lines or min(page.leaf) < 0:
        return None
    kinds = container_kinds(page)
    if any(a and b for a, b in kinds.values()):
        return None
    got = [label_of(page, kinds, i) for i in range(len(page.lines))]
    return got if any(x < BODY for x in got) else None


def _ending(text: str) -> str:
    if text.endswith(("…", "...")):
        return "cut"
    c = text[-1]
    return "stop" if c in ".。।" else "mark" if c in "!?:" else "digit" if c.isdigit() else "word" if c.isalpha() else "other"


_SEPARATORS = (" | ", " › ", " / ", " · ", " > ", "©", "@", "   ", " » ")


def features(page: Page, url: str | None, with_markup: bool = True) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(slots, values, number of features of each line)."""
    n = len(page.lines)
    host = (urlsplit(url).hostname or "") if url else ""
    site = host.removeprefix("www.").split(".")
    title = page.title.casefold()
    kinds = container_kinds(page) if with_markup else {}
    shape, tokens = [], []
    for i, line in enumerate(page.lines):
        words = [token(t) for t in line.split()]
        capital = sum(w[2] for w in words) / len(words)
        raw = page.raw[i]
        shape.append((f"{min(9, int(math.log2(len(line))))}{_ending(line)}", f"{min(12, len(words))}{int(4 * capital)}", len(raw) - len(raw.lstrip())))
        tokens.append(words)
    widest = max((len(x) for x in page.lines), default=0)
    slots: list[int] = []
    values: list[float] = []
    counts: list[int] = []
    for i, line in enumerate(page.lines):
        size, cap, indent = shape[i]
        f = [
            "bias", f"s{size}", f"c{cap}", f"i{min(indent, 3)}", f"b{page.blank_before[i]}", f"f{min(i, 12)}", f"e{min(n - 1 - i, 12)}", f"r{10 * i // n}",
            f"a{'A' if line[0].isupper() else 'z' if line[0].isalpha() else '0' if line[0].isdigit() else line[0]}",
            f"p{shape[i - 1][0] if i else '^'}", f"n{shape[i + 1][0] if i + 1 < n else '$'}", f"pc{shape[i - 1][1] if i else '^'}", f"nc{shape[i + 1][1] if i + 1 < n else '$'}",
            f"w{len(line) > 0.85 * widest}", f"s{size}c{cap}", f"s{size}p{shape[i - 1][0] if i else '^'}",
        ]
        f += [f"m{s}" for s in _SEPARATORS if s in (page.raw[i] if s == "   " else line)]
        low = line.casefold()
        if low in site or low.replace(" ", "") in site:
            f.append("site")
        if title and low == title:
            f.append("title")
        if url and len(low) > 8 and "-".join(w for w in low.replace(",", "").split()) in url:
            f.append("slug")
        kept = [t for t in tokens[i] if t[0]]
        words = [t[0] for t in kept]
        if words:
            f.append(f"l{words[-1]}")
            f.append(f"q{words[0]}")
        plain = len(f)
        if with_markup and page.leaf[i] >= 0:
            leaf = page.leaves[page.leaf[i]]
            text, controls = kinds[leaf.container]
            names = " ".join(c for c in leaf.attributes.replace('"', " ").split() if c.isalpha())
            f += [f"t{leaf.tag}", f"u{leaf.path[:1]}", f"v{leaf.tag}{leaf.path[:2]}", f"k{text}{controls}", f"tk{leaf.tag}{text}{controls}", f"x{names}"]
        else:
            f.append("t-")
        weight = 1 / math.sqrt(len(words) or 1)
        slots += map(slot, f)
        values += [1.0] * plain + [MARKUP_WEIGHT] * (len(f) - plain)
        more = [t[1] for t in kept]
        more += pair_slots(words)
        slots += more
        values += [weight] * len(more)
        counts.append(len(f) + len(more))
    return np.array(slots, np.int64), np.array(values, np.float32), counts


def _stacked(pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, number of features of each line) of all pages."""
    return np.concatenate([p[0] for p in pages]), np.concatenate([p[1] for p in pages]), np.concatenate([p[2] for p in pages])


class Crf:
    """Weights of the blocks' features and of the labels' transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.weights, self.moves, self.first = weights, moves, first

    def emissions(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of shape pages x longest x labels, lengths)."""
        idx, val, per = _stacked(pages)
        flat = np.add.reduceat(self.weights[idx] * val[:, None], np.concatenate(([0], np.cumsum(per)[:-1])), axis=0)
        lengths = np.fromiter((len(p[2]) for p in pages), np.int64, len(pages))
        out = np.zeros((len(pages), lengths.max(), len(LABELS)), np.float32)
        out[np.arange(lengths.max())[None, :] < lengths[:, None]] = flat
        return out, lengths

    def decode(self, pages: list[tuple]) -> list[np.ndarray]:
        """The likeliest labels of each page; pages of like length are decoded side by side."""
        result: list[np.ndarray] = [np.empty(0, np.int64)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i][2]), key=lambda i: len(pages[i][2]))
        for at in range(0, len(order), 32):
            part = order[at : at + 32]
            score, lengths = self.emissions([pages[i] for i in part])
            longest = score.shape[1]
            back = np.zeros((longest, len(part), len(LABELS)), np.int64)
            best = self.first + score[:, 0]
            for t in range(1, longest):
                step = best[:, :, None] + self.moves
                back[t] = step.argmax(axis=1)
                now = step.max(axis=1) + score[:, t]
                best = np.where((t < lengths)[:, None], now, best)
            for k, i in enumerate(part):
                y = int(best[k].argmax())
                path = np.empty(lengths[k], np.int64)
                for t in range(int(lengths[k]) - 1, -1, -1):
                    path[t] = y
                    y = int(back[t, k, y])
                result[i] = path
        return result


def _gradient(model: Crf, pages: list[tuple], gold: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood: what the gold labels have of each feature over what the model expects."""
    score, lengths = model.emissions(pages)
    count, longest, k = score.shape
    mask = np.arange(longest)[None, :] < lengths[:, None]
    alpha = np.zeros((count, longest, k))
    beta = np.zeros((count, longest, k))
    alpha[:, 0] = model.first + score[:, 0]
    for t in range(1, longest):
        step = alpha[:, t - 1][:, :, None] + model.moves
        top = step.max(axis=1)
        now = top + np.log(np.exp(step - top[:, None, :]).sum(axis=1)) + score[:, t]
        alpha[:, t] = np.where(mask[:, t][:, None], now, alpha[:, t - 1])
    z = alpha[:, -1]
    z = z.max(axis=1) + np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))
    moves = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        step = model.moves[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :]
        inner = mask[:, t + 1][:, None]
        pair = np.exp(alpha[:, t][:, :, None] + step - z[:, None, None]) * inner[:, :, None]
        moves -= pair.sum(axis=0)
        top = step.max(axis=2)
        beta[:, t] = np.where(inner, top + np.log(np.exp(step - top[:, :, None]).sum(axis=2)), 0)
    delta = -np.exp(alpha + beta - z[:, None, None])
    first = delta[:, 0].sum(axis=0)
    for i, y in enumerate(gold):
        delta[i, np.arange(len(y)), y] += 1
        first[y[0]] += 1
        np.add.at(moves, (y[:-1], y[1:]), 1)
    idx, val, per = _stacked(pages)
    rows = np.repeat(delta[mask], per, axis=0) * val[:, None]
    weights = np.stack([np.bincount(idx, rows[:, c], 1 << BITS) for c in range(k)], axis=1)
    return weights, moves, first


def fit(pages: list[tuple], gold: list[list[int]], epochs: int = EPOCHS, ridge: float = 1e-4, rate: float = 0.06) -> Crf:
    """Conditional likelihood with an L2 penalty, by Adam over batches of pages in a fixed order."""
    k = len(LABELS)
    params = [np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)]
    mean = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    step, rng = 0, np.random.default_rng(7)
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        for at in range(0, len(order), 48):
            part = order[at : at + 48]
            got = _gradient(Crf(params[0].astype(np.float32), params[1], params[2]), [pages[i] for i in part], [gold[i] for i in part])
            step += 1
            pace = rate * 0.5**epoch
            for p, m, s, g in zip(params, mean, square, got):
                g = g / len(part) - ridge * p
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p += pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Crf(params[0].astype(np.float32), params[1].astype(np.float32), params[2].astype(np.float32))


COLUMNS = ("capture_id", "source_url", "raw_html", "rendered_html", "visible_text")


def sampled(df: DataFrame, ident: str, size: int) -> Column:
    """Whether a row's id is among the lowest by hash, for about `size` rows of the whole table (all, if it is smaller)."""
    n = df.count()  # from the files' footers
    return F.pmod(F.xxhash64(F.col(ident)), F.lit(1 << 30)) < math.ceil(min(1.0, size / max(n, 1)) * (1 << 30))


#: Only pages of so many characters of visible text, lines and markup are drawn for training, so that what the driver holds is
#: bounded by SAMPLE whatever pages are like. All pages are decoded, however long.
MOST_TEXT, MOST_LINES, MOST_MARKUP = 20_000, 400, 4_000_000


def _packed(ident, pages: list[tuple]) -> list[tuple]:
    """Rows of (capture_id, at, slots, values, counts, gold) with the arrays as bytes."""
    return [(ident, at, x[0].astype(np.int32).tobytes(), x[1].astype(np.float32).tobytes(), np.array(x[2], np.int32).tobytes(), np.array(y, np.int8).tobytes()) for at, (x, y) in enumerate(pages)]


def _unpacked(row) -> tuple[tuple, list[int]]:
    slots, values, counts, gold = (np.frombuffer(bytes(row[i]), t) for i, t in ((2, np.int32), (3, np.float32), (4, np.int32), (5, np.int8)))
    return (slots.astype(np.int64), values, counts.tolist()), gold.tolist()


def training_captures(captures: DataFrame, size: int, most_text: int = MOST_TEXT) -> DataFrame:
    """COLUMNS of the captures whose ids hash lowest, about `size`, without those too long to train on."""
    rows = captures.select(*COLUMNS).where(sampled(captures, "capture_id", size)).where(F.length("visible_text").between(1, most_text))
    return rows.where(F.coalesce(F.length("raw_html"), F.lit(0)) + F.coalesce(F.length("rendered_html"), F.lit(0)) <= MOST_MARKUP)


def train(captures: DataFrame, size: int = SAMPLE) -> Crf:
    """The field fitted on the labelled pages of a bounded sample, each once with and once without its markup's features, and
    on made pages, so that there is a field whatever the sample holds.

    Markup is parsed and hashed by the executors; the driver gets the features of the sample only.
    """

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += _packed(r["capture_id"], training_pages(r["source_url"], r["raw_html"], r["rendered_html"], r["visible_text"], -1 if r["capture_id"] is None else r["capture_id"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["capture_id", "at", "slots", "vals", "counts", "gold"])

    got = training_captures(captures, size).mapInArrow(run, "capture_id long, at int, slots binary, vals binary, counts binary, gold binary").collect()
    rows = {(r["capture_id"] is None, r["capture_id"] or 0, r["at"]): r for r in got}
    return _fitted([_unpacked(rows[k]) for k in sorted(rows)])


def _fitted(pages: list[tuple[tuple, list[int]]]) -> Crf:
    pages = pages + [x for n, (url, markup, visible) in enumerate(made_pages()) for x in training_pages(url, markup, None, visible, n)]
    return fit([x for x, _ in pages], [y for _, y in pages])


def _hollowed(page: Page, y: list[int], notices: list[str]) -> tuple[Page, list[int]]:
    """The page with its first body paragraphs or items replaced by `notices`, the others of its body (headings aside) left out."""
    out, kinds, left = Page("", None, None), [], list(notices)
    out.title = page.title
    for i, label in enumerate(y):
        text = page.lines[i]
        if 0 < label < BODY:
            if not left:
                continue
            text, label = left.pop(0), 1
        out.lines.append(text)
        out.raw.append(text)
        out.blank_before.append(page.blank_before[i])
        out.leaf.append(-1)
        kinds.append(label)
    return out, kinds


_MADE = [t for t, y in seeds() if y]


def training_pages(url: str | None, raw: str | None, rendered: str | None, visible: str, n: int) -> list[tuple[tuple, list[int]]]:
    """(features, labels) of a page with unambiguous markup: with its markup and without.

    Bodies that are nothing but a notice are rare, so about every third page (by the hash of its number `n`) is also shown
    hollowed, with made notices in place of its body.
    """
    page = Page(visible, raw, rendered)
    y = labels(page) if len(page.lines) <= MOST_LINES else None
    if not y:
        return []
    out = [(features(page, url, with_markup), y) for with_markup in (True, False)]
    h = xxhash.xxh32_intdigest(str(n))
    if h % 3 == 0:
        at = h // 3 % len(_MADE)
        hollow, z = _hollowed(page, y, (_MADE + _MADE)[at : at + 1 + h // 7 % 4])
        if any(0 < k < BODY for k in z):
            out.append((features(hollow, url, False), z))
    return out


def fit_rows(rows: list[tuple]) -> Crf:
    """The field fitted on (url, raw_html, rendered_html, visible_text) and the made pages."""
    return _fitted([x for n, (url, raw, rendered, visible) in enumerate(rows) for x in training_pages(url, raw, rendered, visible, n)])


def body_labels(model: Crf, rows: list[tuple]) -> list[tuple[Page, np.ndarray]]:
    """The page and the lines' labels of each (url, raw_html, rendered_html, visible_text); null or blank text: no lines."""
    pages = [Page(visible or "", raw, rendered) for _, raw, rendered, visible in rows]
    return list(zip(pages, model.decode([features(p, r[0]) for p, r in zip(pages, rows)])))


def over_captures(captures: DataFrame, model: Crf, schema: str, emit) -> DataFrame:
    """Rows that `emit` (ids, [(page, labels)], rows) gives as columns, one batch of captures after the other.

    The model (a few MB whatever the table holds) goes out as a broadcast.
    """
    sent = captures.sparkSession.sparkContext.broadcast((model.weights, model.moves, model.first))

    def run(batches):
        field = Crf(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                cols = [c.to_pylist() for c in batch.slice(at, AT_ONCE).columns]
                rows = list(zip(*cols[1:]))
                out = emit(cols[0], body_labels(field, rows), rows)
                yield pa.RecordBatch.from_pydict(out)

    return captures.select(*COLUMNS).where(F.col("capture_id").isNotNull()).mapInArrow(run, schema)
