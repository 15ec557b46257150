"""Template residue, filler, error pages and script notices: a regularised linear classifier on hashed n-grams.

Phrases and response statuses only give weak labels to a bounded sample; the decision over the tables is the
classifier's. A capture is a case if every line of its main body (headings aside) is residue.
"""

from __future__ import annotations

import io
import re
import sys
from collections import Counter
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm import blocks, mainbody, notices
from siteloom.llm.blocks import Page
from siteloom.llm.notices import REPORTS, prose, seeds
from siteloom.session import shared_folder

BITS = 17
#: Captures and distinct status texts from which weakly labelled lines are drawn, by lowest hash.
SAMPLE = 9000
SHORT = 1600
STATUS_SAMPLE = 6000
THRESHOLD = 0.5

# Fixed patterns for weak labels: printed template values, filler, error messages, script notices (en, de, fr, es).
PHRASES = {
    "template": r"""\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|\$\{[^}]*\}|\#\{[^}]*\}|%%\w+%%|@@\w+@@|\[\[\w+\]\]|\?\?\?\S+\?\?\?|__[A-Z][A-Z_]*__|\bi18n:\w|translation\ missing
        |\{[\w.]+\|\w+\}|\{\d+\}|%[A-Z_]{4,}%|^%s$|\[insert\b[^\]]*\]|\[[\w ]+\ here\]|<[\w ]+\ goes\ here>|\bundefined\b|\bNaN\b|\[object\ \w+\]|^null(\ null)*$|\b[a-z]+\.[a-z]+\.missing\b""",
    "filler": r"""\blorem\b|\bipsum\b|placeholder\ text|dummy\ (text|copy)|your\ text\ goes|sample\ (status|text|paragraph)|blindtext|faux\ texte|texto\ de\ ejemplo|\basdf\b|\bx{3,}\ x{2,}
        |\bTBD(\ TBD)+|heading\ one\ two|write\ something\ catchy|add\ a\ short\ description|insert\ message|^TODO\b""",
    "error": r"""(page|site|link|address|document|resource|url|you\ were\ after)\b.{0,40}\b(not\ found|could\ not\ be|can't\ find|does\ not\ exist|leads\ nowhere|is\ gone|no\ longer|taken\ down|has\ moved)
        |(can't|cannot|couldn't|can't\ seem\ to)\ find\ (that|this|the|what)|something\ (went\ wrong|broke)|\b(server|application|backend|gateway)\ (gave\ up|ran\ out|did\ not\ respond|returned\ an\ invalid)
        |bad\ gateway</|^\d{3}\ (bad|internal|[–-])|upstream\ timed\ out|temporarily\ unavailable|is\ down\ for|access\ denied|was\ blocked|too\ many\ requests|session\ has\ expired|permission\ to\ view|account\ has\ been\ suspended
        |traceback|exception\b|failed\ to\ open|on\ line\ \d|connecting\ to\ the\ database|<error>|<title>.*</title>|fixing\ this|nicht\ (gefunden|erreichbar)|gerade\ gestört|existiert\ nicht|introuvable|ne\ trouvons\ pas
        |en\ panne|rencontré\ une\ panne|plus\ disponible|ne\ mène\ nulle|no\ encontrada|no\ está\ disponible|ha\ fallado|ya\ no\ está""",
    "script": r"""(enable|activate|allow|turn\ on|switch\ on|switched\ on|require[sd]?|without|disabled|blocked|need)\b.{0,30}\b(javascript|scripts?|scripting)|(javascript|scripts?|scripting)\b.{0,40}\b(enable|activate|allow|turn|switched|required|disabled|blocked)
        |(javascript|skripte)\b.{0,60}(aktivieren|einschalten|erlauben)|aktivieren\ sie\ javascript|skripte\ (erlauben|einschalten)|(activer|activez)\ (javascript|les\ scripts)|(habilitar|activar|active)\ (javascript|los\ scripts)
        |^loading(…|\.\.\.)?$|while\ we\ load|checking\ your\ browser|verify\ you\ are\ human|noscript\b|does\ not\ run\ scripts""",
}
SEEDS = re.compile("|".join(f"(?:{p})" for p in PHRASES.values()), re.I | re.X)
_SPACES = re.compile(r"\s+")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")
_WORD = re.compile(r"\w+|[^\w\s]+")

# Reason phrases registered for HTTP, and what clients report when there is no response: fixed values.
REASONS = frozenset(
    """continue;switching protocols;processing;early hints;ok;created;accepted;non-authoritative information;no content;reset content;partial content;multi-status;multiple choices;moved permanently;
    found;see other;not modified;use proxy;temporary redirect;permanent redirect;bad request;unauthorized;payment required;forbidden;not found;method not allowed;not acceptable;request timeout;conflict;gone;
    length required;precondition failed;content too large;uri too long;unsupported media type;range not satisfiable;expectation failed;misdirected request;unprocessable content;locked;failed dependency;too early;
    upgrade required;precondition required;too many requests;internal server error;not implemented;bad gateway;service unavailable;gateway timeout;loop detected;success;error;unknown""".replace("\n", "").replace("    ", "").split(";")
)


def features(text: str, field: str, title: str = "") -> np.ndarray:
    """Slots of the hashed n-grams of characters and words, of length, and of how the title relates to the text."""
    low = _HEX.sub("h", _SPACES.sub(" ", text).strip().casefold())
    low = re.sub(r"\d+", "0", low)
    words = _WORD.findall(low)
    f = [f"len{min(len(text), 400) // 12 if len(text) < 120 else 10 + min(len(text), 900) // 100}{field}", f"words{min(len(words), 40) // 2}", f"field{field}", f"end{low[-1:]}", f"start{low[:1]}"]
    if title:
        f.append(f"title{low == title}{bool(set(words) & set(_WORD.findall(title)))}")
    padded = f"^{low}$"
    grams = {padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)}
    grams.update(f"_{w}" for w in words)
    grams.update(f"_{a} {b}" for a, b in zip(words, words[1:]))
    f += grams
    return np.array([xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in f], np.int64) & ((1 << BITS) - 1)


class Linear:
    """A logistic model over the mean of the hashed features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[slots].sum() / np.sqrt(len(slots)), -30, 30))))


def fit(rows: list[np.ndarray], y: list[int], epochs: int = 12, ridge: float = 2e-6, rate: float = 0.03) -> Linear:
    """L2-regularised logistic regression by Adam; both classes weigh alike."""
    w, b = np.zeros(1 << BITS), 0.0
    m, s, mb, sb, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    gold = np.array(y, float)
    share = np.where(gold > 0, 0.5 / max(gold.sum(), 1), 0.5 / max((1 - gold).sum(), 1)) * len(gold)
    sizes = np.array([len(r) for r in rows])
    rng = np.random.default_rng(11)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            idx = np.concatenate([rows[i] for i in part])
            val = np.repeat(1 / np.sqrt(sizes[part]), sizes[part])
            ends = np.cumsum(sizes[part])
            z = b + np.add.reduceat(w[idx] * val, np.concatenate(([0], ends[:-1])))
            d = (1 / (1 + np.exp(-z)) - gold[part]) * share[part] / len(part)
            g = np.bincount(idx, np.repeat(d, sizes[part]) * val, 1 << BITS) + ridge * w
            step += 1
            pace = rate * 0.75**epoch
            m += 0.1 * (g - m)
            s += 0.002 * (g * g - s)
            w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.998**step)) + 1e-7)
            mb += 0.1 * (d.sum() - mb)
            sb += 0.002 * (d.sum() ** 2 - sb)
            b -= pace * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.998**step)) + 1e-7)
    return Linear(w.astype(np.float32), b)


def body_lines(page: Page, labels) -> list[str]:
    """The main body's blocks of text, headings aside unless there is nothing else.

    Wrapped lines are put together again: those of one leaf, and where the markup does not say, a paragraph's next line
    after one that ends within a sentence.
    """
    for wanted in (range(1, mainbody.BODY), (0,)):
        out: list[str] = []
        last = -2
        for i, (text, y) in enumerate(zip(page.lines, labels)):
            if y not in wanted:
                continue
            leaf = page.leaf[i]
            wrapped = last == i - 1 and leaf == page.leaf[last] and (leaf >= 0 or (y == labels[last] == 1 and not page.blank_before[i] and text[0].islower() and out[-1][-1] not in ".!?…:"))
            if wrapped:
                out[-1] += " " + text
            else:
                out.append(text)
            last = i
        if out:
            return out
    return []


def weak_label(lines: list[str]) -> int | None:
    """1: a short body of which phrases make up a good part; 0: one with enough text free of phrases; else none."""
    hit = [bool(SEEDS.search(t)) for t in lines]
    total = sum(map(len, lines))
    free = sum(len(t) for t, h in zip(lines, hit) if not h)
    if not lines:
        return None
    if free >= 200 or (not any(hit) and total >= 60):
        return 0
    words = [t for t, h in zip(lines, hit) if h]
    return 1 if any(hit) and free <= 0.75 * total and (max(map(len, words)) < 160 or any(re.search(r"lorem|ipsum", t, re.I) for t in words)) else None


# What clients report of a connection, in stems: fixed values.
TRANSPORT = re.compile(r"timed? ?out|refused|reset|resolv|handshake|certificate|incomplete|redirects|scheme|\b(dns|tls|ssl|eof|tcp)\b|connection|proxy|socket|broken pipe|unreachable|aborted|robots\.txt", re.I)
_SPOKEN = re.compile(r"<\w+>|\b(our|your|you|we|sorry|oops|please|nous|bitte|leider|vaya|disculpa|entschuldigung|this|the|that)\b|désolé|aïe|hmm|uh-oh|[.!…](<|$)", re.I)


def status_label(text: str, code: int | None, filler: frozenset[str] = frozenset()) -> int | None:
    """Weak label of a status text, from its phrase and the response status it came with.

    `filler`: words that the sampled captures have only in filler paragraphs.
    """
    low = text.strip().casefold()
    words = low.split()
    if not low or low in REASONS or re.fullmatch(r"(http/[\d.]+\s*)?\d{3}( [a-z]+)?", low):
        return 0
    if SEEDS.search(text) or _filled(low, filler):
        return 1
    if len(words) <= 7 and TRANSPORT.search(low) and not _SPOKEN.search(low):
        return 0
    if len(words) > 2 and _SPOKEN.search(low):
        return 1
    return 0 if code is None or len(words) <= 4 else None


def filler_words(lines: list[str]) -> frozenset[str]:
    """Words found at least three times, and mostly in lines with the best-known words of filler paragraphs."""
    inside: Counter = Counter()
    outside: Counter = Counter()
    for t in lines:
        (inside if re.search(r"\b(lorem|ipsum)\b", t, re.I) else outside).update(w.strip(".,") for w in t.casefold().split())
    return frozenset(w for w, n in inside.items() if n >= 3 and n >= outside[w])


def _filled(text: str, filler: frozenset[str]) -> bool:
    words = [w.strip(".,") for w in text.casefold().split()]
    return sum(w in filler for w in words) >= 0.8 * len(words)


def training_lines(captures: DataFrame, records: DataFrame, size: int = SAMPLE, statuses: int = STATUS_SAMPLE) -> tuple[list[tuple], list[tuple]]:
    """Weakly labelled (text, title, label, host) of captures' body lines, and (text, label) of status texts.

    Captures: of `size` ids of lowest hash those of a short visible text with unambiguous markup; the executors parse them,
    and the driver gets their body lines, at most SHORT characters each. Status texts: the `statuses` distinct values of
    lowest hash.
    """
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                page = Page(r["visible_text"], r["raw_html"], r["rendered_html"])
                labels = mainbody.labels(page)
                body = body_lines(page, labels) if labels else []
                y = weak_label(body)
                if y is not None:
                    out.append((r["capture_id"], list(dict.fromkeys(body)), page.title.casefold(), y, urlsplit(r["source_url"] or "").hostname or ""))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string()))], names=["capture_id", "lines", "title", "y", "host"])

    rows = mainbody.training_captures(captures, size, SHORT).mapInArrow(run, "capture_id long, lines array<string>, title string, y int, host string").collect()
    kept = {(r["capture_id"] is None, r["capture_id"] or 0): r for r in rows}  # repeats once
    lines = [(t, r["title"], r["y"], r["host"]) for k in sorted(kept) for r in (kept[k],) for t in r["lines"]]
    texts = (
        records.where(F.col("status_text").isNotNull())
        .groupBy("status_text")
        .agg(F.max("status_code").alias("code"))
        .orderBy(F.xxhash64("status_text"), "status_text")
        .limit(statuses)
        .collect()
    )
    filler = filler_words([t for t, _, _, _ in lines])
    lines = [(t, title, 1 if _filled(t, filler) else y, host) for t, title, y, host in lines]
    return lines, [(r["status_text"], y) for r in texts if (y := status_label(r["status_text"], r["code"], filler)) is not None]


def fit_lines(lines: list[tuple], texts: list[tuple], made: list[tuple] | None = None) -> dict[str, Linear]:
    """A classifier for status texts and one for lines.

    Residue is the same in both fields, so each learns the other's positive examples; what is no residue differs. The
    registered reason phrases and codes stand among the status texts, and made prose among the lines, whether the sample has
    them or not, so that there is a classifier of either kind whatever the sample holds.
    """
    plain = [t for r in sorted(REASONS) for t in (r, r.title(), r.upper())] + [str(c) for c in range(200, 600)]
    filled = [t.split() for t, _, y, _ in lines if y and re.search(r"\b(lorem|ipsum)\b", t, re.I)]
    spread = [" ".join(w[at : at + 2 + at % 6]).strip(".").lower() for w in filled for at in range(0, len(w) - 1, 5)]
    made = seeds() if made is None else made
    known = [t for t, y in texts if y] + [t for t, y in made if y]
    mentions = [t for t, y in made if not y]
    # A status that contains residue is residue as well.
    around = [form.format(t) for i, t in enumerate(dict.fromkeys(known)) if len(t) < 40 for form in (("OK {}", "HTTP {}", "Error: {}", "{} (cached)")[i % 4], "OK {}")]
    marked = [f"<{tag}>{t}</{tag}>" for i, t in enumerate(dict.fromkeys(known)) if len(t) > 30 for tag in (("p", "b", "title")[i % 3],)]
    status = [(t, y) for t, y in texts] * 8 + [(t, 0) for t in plain * 2 + REPORTS * 12] + [(t, y) for t, _, y, _ in lines if y and len(t) < 160] + [(t, 1) for t in known * 4 + spread + around + marked]
    rows = {
        "line": [(features(t, "line", title), y) for t, title, y, _ in lines] + [(features(t, "line"), 1) for t in known] + [(features(t, "line"), 0) for t in mentions + prose()],
        "status": [(features(t, "status"), y) for t, y in status],
    }
    return {f: fit([x for x, _ in r], [y for _, y in r], epochs=12 if f == "line" else 30) for f, r in rows.items()}


class Judge:
    """Applies the classifiers to lines and status texts."""

    def __init__(self, models: dict[str, tuple]):
        self.models, self.known = {f: Linear(*m) for f, m in models.items()}, {}

    def is_residue(self, text: str, field: str, title: str = "") -> bool:
        key = (text, field, title) if len(text) < 120 else None
        got = self.known.get(key) if key else None
        if got is None:
            got = self.models[field].score(features(text, field, title)) > THRESHOLD
            if key:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[key] = got
        return got

    def is_case(self, page: Page, labels) -> bool:
        """Whether the body is nothing but residue. The longest line is looked at first: most pages end there."""
        lines = sorted(set(body_lines(page, labels)), key=lambda t: (-len(t), t))
        title = page.title.casefold()
        return bool(lines) and all(self.is_residue(t, "line", title) for t in lines)


def train(captures: DataFrame, records: DataFrame) -> dict[str, tuple]:
    """The classifiers' weights by field, under 1 MB each."""
    return {f: (m.weights, m.bias) for f, m in fit_lines(*training_lines(captures, records)).items()}


@dataclass(frozen=True)
class Models:
    """The classifiers' weights by field and the field of the main body: a few MB whatever the tables hold."""

    lines: dict[str, tuple]
    field: mainbody.Crf


_fitted: dict[str, Models] = {}


def fitted(captures: DataFrame, records: DataFrame) -> Models:
    """The models for these tables: fitted once, kept in the session and stored in the shared folder under the names and times
    of the tables' files, so that other queries and sessions over the same files apply them. Tables without files are fitted
    each time.
    """
    spark = captures.sparkSession
    key = _key(spark, captures.inputFiles(), records.inputFiles())
    got = _fitted.get(key) if key else None
    if got is None and key:
        folder = f"{shared_folder(spark)}/residue-models/{key}"
        try:
            got = _from_bytes(bytes(spark.read.parquet(folder).first()["model"]))
        except AnalysisException:
            got = None  # not stored yet
    if got is None:
        got = Models(train(captures, records), mainbody.train(captures))
        if key:
            spark.createDataFrame([(bytearray(_to_bytes(got)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(folder)
    if key:
        _fitted[key] = got
    return got


#: Files at either end of the list whose size and time are looked at.
ASKED = 100


def _to_bytes(models: Models) -> bytes:
    out = io.BytesIO()
    arrays = {f"{part}_{f}": v for f, pair in models.lines.items() for part, v in zip(("weights", "bias"), pair)}
    np.savez_compressed(out, field_weights=models.field.weights, field_moves=models.field.moves, field_first=models.field.first, **arrays)
    return out.getvalue()


def _from_bytes(raw: bytes) -> Models:
    got = np.load(io.BytesIO(raw))
    lines = {f: (got[f"weights_{f}"], float(got[f"bias_{f}"])) for f in ("line", "status")}
    return Models(lines, mainbody.Crf(got["field_weights"], got["field_moves"], got["field_first"]))


def _key(spark, *tables: list[str]) -> str | None:
    """A hash of the modules that make the models, of the names of the files, and of the sizes and times of the first and last
    ASKED of them (a table may have a million, which writers name anew); None if a table has none.
    """
    if not all(tables):
        return None
    jvm = spark.sparkContext._jvm
    parts = [Path(m.__file__).read_text(encoding="utf-8") for m in (sys.modules[__name__], mainbody, notices, blocks)]
    names = sorted(f for t in tables for f in t)
    parts += names
    for name in dict.fromkeys(names[:ASKED] + names[-ASKED:]):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return xxhash.xxh64_hexdigest("\n".join(parts))


def residue_captures(captures: DataFrame, field: mainbody.Crf, models: dict[str, tuple]) -> DataFrame:
    """(capture_id) of the captures whose main body is nothing but residue, once each; null and blank texts are none."""
    state: dict = {}

    def emit(ids, bodies, rows):
        judge = state.setdefault("judge", Judge(models))
        return {"capture_id": pa.array([i for i, (p, y) in zip(ids, bodies) if judge.is_case(p, y)], pa.int64())}

    return mainbody.over_captures(captures, field, "capture_id long", emit).dropDuplicates(["capture_id"])


def residue_statuses(records: DataFrame, models: dict[str, tuple]) -> DataFrame:
    """(id) of the crawl records whose status_text is or contains residue, once each; null and blank texts are none."""
    sent = records.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        judge = Judge(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keep = [bool(t.strip()) and judge.is_residue(t, "status") for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0])

    texts = records.select("id", "status_text").where(F.col("id").isNotNull() & F.col("status_text").isNotNull() & (F.length(F.trim("status_text")) > 0))
    return texts.mapInArrow(run, "id long").dropDuplicates(["id"])


def residue(captures: DataFrame, records: DataFrame) -> DataFrame:
    """(field, record_id) of all captures and crawl records that hold residue in place of content or a status."""
    if captures.isEmpty() and records.isEmpty():
        return captures.sparkSession.createDataFrame([], "field string, record_id long")
    both = fitted(captures, records)
    models, field = both.lines, both.field
    found = residue_captures(captures, field, models).select(F.lit("visible_text").alias("field"), F.col("capture_id").alias("record_id"))
    return found.unionByName(residue_statuses(records, models).select(F.lit("status_text").alias("field"), F.col("id").alias("record_id")))


def held_out(captures: DataFrame, records: DataFrame, share: int = 4) -> dict[str, float]:
    """Precision and recall of the weak labels of lines on the hosts that training did not see (one in `share`)."""
    lines, texts = training_lines(captures, records)
    unseen = lambda h: xxhash.xxh32_intdigest(h) % share == 0
    model = fit_lines([x for x in lines if not unseen(x[3])], texts)["line"]
    test = [x for x in lines if unseen(x[3])]
    got = [(model.score(features(t, "line", title)) > THRESHOLD, y) for t, title, y, _ in test]
    hit = sum(1 for g, y in got if g and y)
    return {"lines": len(got), "precision": hit / max(1, sum(g for g, _ in got)), "recall": hit / max(1, sum(y for _, y in got))}


def held_out_phrases(captures: DataFrame, records: DataFrame, folds: int = 5) -> dict[str, float]:
    """Recall on residue worded like nothing in training, with the precision on real lines beside it.

    The wordings of residue in the sampled lines and status texts (digits, codes and case aside) are split into `folds` by hash;
    for each fold a model is fitted without its wordings - the made examples of the same wording and of the same first three
    words left out as well - and tried on them, and on the real lines of one host in five.
    """
    lines, texts = training_lines(captures, records)
    shape = lambda t: re.sub(r"\W+", " ", re.sub(r"\d+", "0", _HEX.sub("h", t.casefold()))).strip()
    start = lambda t: " ".join(shape(t).split()[:3])
    group = lambda t: xxhash.xxh32_intdigest(start(t)) % folds
    hit = total = wrong = plain = 0
    for k in range(folds):
        inside = lambda t, y: y and group(t) == k  # noqa: E731, B023
        models = fit_lines([x for x in lines if not inside(x[0], x[2]) and (x[2] or xxhash.xxh32_intdigest(x[3]) % folds != k)], [x for x in texts if not inside(*x)], made=[x for x in seeds() if not inside(*x)])
        tried = [("line", t) for t, _, y, _ in lines if inside(t, y)] + [("status", t) for t, y in texts if inside(t, y)]
        seen = {shape(t): (f, t) for f, t in tried}
        hit += sum(models[f].score(features(t, f)) > THRESHOLD for f, t in seen.values())
        total += len(seen)
        real = [(t, title) for t, title, y, host in lines if not y and xxhash.xxh32_intdigest(host) % folds == k]
        wrong += sum(models["line"].score(features(t, "line", title)) > THRESHOLD for t, title in real)
        plain += len(real)
    return {"wordings": total, "recall": hit / max(1, total), "real lines": plain, "taken for residue": wrong / max(1, plain)}


def main_bodies(captures: DataFrame, records: DataFrame) -> DataFrame:
    """(capture_id, line_no): the non-blank lines of visible_text that belong to the main body.

    line_no counts from 1 over visible_text split at newlines, blank lines included. Captures that are residue, and null
    or blank texts, have none; repeated rows count once.
    """
    both = fitted(captures, records)
    models, field = both.lines, both.field
    state: dict = {}

    def emit(ids, bodies, rows):
        judge = state.setdefault("judge", Judge(models))
        lines = [[] if judge.is_case(p, y) else [n for n, k in zip(p.numbers, y) if k < mainbody.BODY] for p, y in bodies]
        return {"capture_id": pa.array(ids, pa.int64()), "lines": pa.array(lines, pa.list_(pa.int32()))}

    got = mainbody.over_captures(captures, field, "capture_id long, lines array<int>", emit).dropDuplicates(["capture_id"])
    return got.select("capture_id", F.explode("lines").alias("line_no"))
