"""Toxicity scores after noisy-channel deobfuscation.

Tokens that look disguised (digits or signs among, before or after letters, a letter three times or
more, single letters set apart) become a character lattice: a sign may stand for
itself, for the letters it imitates or for nothing, a repeated letter for one, two or
all of its copies, a separator for itself or for nothing.  In stretches of over ``_LONG`` characters, which hold several words, wide gaps part words.  Tokens and stretches of any
length are decoded, in linear time; only those without letters are not.  Viterbi decoding over pairs
of characters, by a trigram language model of characters counted over all texts, picks
the reading; the document's words with these readings in place are what is scored.

The classifier is a logistic regression on the presence of words and of their
beginnings (``PREFIXES`` letters), the features chosen by the likelihood ratio between
the labels.  It learns from at most ``sample`` labelled rows (the smallest hashes of
their ids); the language model counts everything.

Scale: three Arrow passes (counts, sample, scores); each returns bounded vectors or
one row a document.  Driver memory is bounded by the trigram table (64**3), by ``hashes``
buckets and by ``sample`` rows of chosen features.

Defined cases: null text counts as empty and scores the base rate; with no labels at
all scores are 0; with one class they are its smoothed rate; a null id is the empty id
(remainder 0); labels that repeat an id count as toxic if any of them is; rows that
repeat are scored one by one.  Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import fresh
from quern.storage import materialize, spread

#: Character classes: 0 blank, 1-26 letters, 27-58 other letters, 59 digits, 60 the rest.
CLASSES = 64
PREFIXES = (4, 5, 6)
#: The hash of the mark that sets a beginning apart from a word.
_START = zlib.crc32(b"^")
_PIECE = 1 << 20
_CACHE = 1 << 16
#: Stretches beyond are read as several words, and not remembered.
_LONG = 80

# What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i",
}
SEPARATORS = ".-_*·'"
# Words of one letter that may stand before a word whose letters are set apart.
ONE_LETTER_WORDS = ("a ", "i ", "o ", "y ", "e ", "u ", "à ", "é ")

_SIGNS = re.escape("".join(LEET))
#: Signs that end a disguised word, one or two of them; others there are taken for punctuation, more for a number or a row of signs.
_TAIL = re.escape("0123456789@$€+")
_MIXED = re.compile(rf"[^\W\d_](?:[{_SIGNS}{re.escape(SEPARATORS)}]+[^\W\d_]|[{_TAIL}]{{1,2}}(?![{_TAIL}\w]))|(?:^|\s)[{_SIGNS}]+[^\W\d_]{{2}}|([^\W\d_])\1\1")
_TOKEN = re.compile(r"\S+")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ \t.\-_*]+[^\W_]){2,}(?!\S)")
_EDGES = " \t\r\n.,;:!?*\"'()[]{}|<>-_~#"


def _class(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if c.isspace():
        return 0
    if c.isdigit():
        return 59
    return 27 + ord(c) % 32 if c.isalpha() else 60


def _class_table() -> np.ndarray:
    return np.array([_class(chr(i)) if not 0xD800 <= i < 0xE000 else 60 for i in range(1 << 16)], np.uint8)


def count_trigrams(texts: Iterator[str]) -> np.ndarray:
    """Counts of the trigrams of classes, each text between blanks."""
    table, total = _class_table(), np.zeros(CLASSES**3, np.int64)

    def add(text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = table[np.minimum(points, (1 << 16) - 1)].astype(np.int32)
        np.add(total, np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total)), out=total)

    held, size = [], 0
    for text in texts:
        for at in range(0, max(1, len(text)), _PIECE):
            held.append(text[max(0, at - 2) : at + _PIECE].lower())
            size += len(held[-1])
            if size >= _PIECE:
                add("  " + "  ".join(held) + "  ")
                held, size = [], 0
    add("  " + "  ".join(held) + "  ")
    return total


def language_model(counts: np.ndarray, weight: float = 8.0) -> np.ndarray:
    """Natural log of p(c | a, b), each order smoothed by the one below it."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + weight * p1) / (two.sum(axis=1, keepdims=True) + weight)
    p3 = (three + weight * p2[None]) / (three.sum(axis=2, keepdims=True) + weight)
    return np.log(p3).astype(np.float32)


def _lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each stretch of the token its readings and their costs (negative log of the channel)."""
    narrow = min(map(len, re.findall(" +", token)), default=0)
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        run, c = m[0], m[1]
        if c.isalpha():
            readings = [(run, 0.0)]
            if len(run) > 1:
                readings += [(c, 3.0 if len(run) == 2 else 1.0)] + ([(c * 2, 1.5)] if len(run) > 2 else [])
        elif c in LEET:
            readings = [(run, 2.0)] + [(x * n, 1.0 + 0.5 * (n != len(run))) for x in LEET[c] for n in {1, min(2, len(run))}] + ([("", 2.0)] if not c.isdigit() else [])
        elif c == " ":
            if len(token) <= _LONG:
                readings = [(run, 4.0), ("", 0.5)]
            else:  # many words, and the wider gaps are theirs
                readings = [(" ", 0.2), ("", 1.6)] if len(run) > narrow else [(" ", 1.6), ("", 0.2)]
        else:
            readings = [(run, 1.0), ("", 1.0)]
        yield readings


def restore(token: str, lm: np.ndarray) -> str:
    """The likeliest reading of one token, of any length."""
    # Readings are held as (what comes before, last piece), so that long stretches take linear time.
    beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for readings in chain(_lattice(token.lower()), [[(" ", 0.0)]]):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, text) in beam.items():
            for reading, price in readings:
                x, y, total = a, b, cost + price
                for c in reading:
                    z = _class(c)
                    total -= lm[x, y, z]
                    x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (text, reading))
        beam = after
    at, pieces = min(beam.values(), key=lambda x: x[0])[1], []
    while at:
        at, piece = at
        pieces.append(piece)
    return "".join(reversed(pieces)).strip()


def disguised(text: str) -> list[str]:
    """The stretches of ``text`` that are decoded: mixed tokens, and single letters set apart."""
    found = [m[0] for m in _SPACED.finditer(text)]
    found += [m[2:] for m in found if m[:2] in ONE_LETTER_WORDS and len(m) > 6]
    at = 0
    while m := _MIXED.search(text, at):
        start = m.start() + text[m.start()].isspace()
        while start and not text[start - 1].isspace():
            start -= 1
        at = _TOKEN.match(text, start).end()
        core = text[start:at].strip(_EDGES)
        if len(core) >= 3 and _MIXED.search(core):  # so it holds letters: no mere number
            found.append(core)
    return found


class Reader:
    """Words of a text, restored, and their features; both remembered up to a bound."""

    def __init__(self, lm: np.ndarray, hashes: int, chosen: dict[int, int] | None = None):
        self.lm, self.mask, self.chosen = lm, hashes - 1, chosen
        self.words: dict[str, tuple[int, ...]] = {}
        self.readings: dict[str, str] = {}

    def features(self, word: str) -> tuple[int, ...]:
        got = self.words.get(word)
        if got is None:
            core = word.strip(_EDGES)
            hashes = [zlib.crc32(core.encode("utf-8", "surrogatepass"))] if len(core) > 2 else []
            h, at = _START, 0
            for k in PREFIXES:
                if len(core) < k:
                    break
                h, at = zlib.crc32(core[at:k].encode("utf-8", "surrogatepass"), h), k
                hashes.append(h)
            got = tuple([x & self.mask for x in hashes])
            if self.chosen is not None:
                got = tuple([self.chosen[x] for x in got if x in self.chosen])
            if len(self.words) >= _CACHE:
                self.words.clear()
            self.words[word] = got
        return got

    def read(self, text: str | None) -> set[int]:
        """The features present in the restored text."""
        low = (text or "").lower()
        words = set(low.split())
        for token in disguised(low):
            reading = self.readings.get(token)
            if reading is None:
                reading = restore(token, self.lm)
                if len(self.readings) >= _CACHE:
                    self.readings.clear()
                if len(token) <= _LONG:
                    self.readings[token] = reading
            words.discard(token)
            words.update(reading.split())
        found: set[int] = set()
        known = self.words.get
        for word in words:
            got = known(word)
            if got is None:
                got = self.features(word)
            if got:
                found.update(got)
        return found


def _choose(rows: list[tuple[int, int, int]], toxic: int, clean: int, most: int) -> list[int]:
    """The buckets that speak for toxicity, by the likelihood ratio of their presence."""
    if not rows:
        return []
    bucket, t, c = (np.array(x, float) for x in zip(*rows, strict=True))
    n = toxic + clean
    p, p1, p0 = (t + c) / n, np.clip(t / toxic, 1e-9, 1 - 1e-9), np.clip(c / max(clean, 1), 1e-9, 1 - 1e-9)
    log = lambda k, m, q: k * np.log(q) + (m - k) * np.log(1 - q)
    p = np.clip(p, 1e-9, 1 - 1e-9)
    g = 2 * (log(t, toxic, p1) + log(c, clean, p0) - log(t, toxic, p) - log(c, clean, p))
    good = np.flatnonzero((p1 > p0) & (g > 10.83))
    return bucket[good[np.argsort(-g[good], kind="stable")[:most]]].astype(int).tolist()


def _fit(rows: list[tuple[int, list[int]]], n_features: int, steps: int = 400, rate: float = 0.1, l2: float = 2e-4) -> np.ndarray:
    """Weights, the constant last."""
    y = np.array([r[0] for r in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    which = np.array([f for r in rows for f in r[1]], np.int64)
    w = np.zeros(n_features + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(doc, w[which], len(y))
        e = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(which, e[doc], n_features), e.sum()) / len(y)
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic",
    sample: int = 20_000, hashes: int = 1 << 22, most: int = 4096, support: int = 3,
) -> dict:
    """The model: the language model, the chosen features' numbers by bucket, and their weights."""
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = count_trigrams(t.as_py() or "" for b in batches for t in b.column(0))
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["gram", "n"])

    counts = np.zeros(CLASSES**3, np.int64)
    got = texts.select("text").mapInArrow(trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    lm = language_model(counts)

    chosen_ids = (
        labels.select(F.col(label_id).alias("_id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("_id").isNotNull())
        .filter(_remainder(F.col("_id")) != 0).groupBy("_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    labelled = materialize(texts.join(F.broadcast(chosen_ids), F.col("doc_id") == F.col("_id")).select("toxic", "text"), "labelled")
    size = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    model = {"lm": lm, "hashes": hashes, "chosen": {}, "weights": np.array([-np.inf if not toxic + clean else np.log((toxic + 0.5) / (clean + 0.5))])}
    if not toxic or not clean:
        return model

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = Reader(lm, hashes), np.zeros((2, hashes), np.int32)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[label, np.fromiter(reader.read(text), np.int64)] += 1
        found = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(n[k, found].astype(np.int64)) for k in (1, 0))], ["bucket", "t", "c"])

    buckets = labelled.mapInArrow(presence, "bucket long, t long, c long").groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter(F.col("t") >= support)
    got = buckets.toArrow().sort_by("bucket").to_pydict()
    features = _choose(list(zip(got["bucket"], got["t"], got["c"], strict=True)), toxic, clean, most)
    chosen = {b: i for i, b in enumerate(features)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm, hashes, chosen)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(reader.read(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["toxic", "found"])

    rows = sorted((r.toxic, list(r.found)) for r in labelled.mapInArrow(featured, "toxic int, found array<int>").collect())
    return model | {"chosen": chosen, "weights": _fit(rows, len(chosen))}


def score(docs: DataFrame, model: dict, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of the label; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = spread(docs.drop(into))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        reader, w = Reader(m["lm"], m["hashes"], m["chosen"]), m["weights"]
        for batch in batches:
            z = np.array([w[-1] + sum(w[i] for i in sorted(reader.read(t.as_py()))) for t in batch.column(at)], float)
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, into])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{into}` double")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), (_remainder(F.col(id_col)) == 0).alias("held_out"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without the rows scored ``threshold`` or more."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    (toxicity,) = fresh(docs, "toxicity")
    return score(docs, model, text_col=text_col, into=toxicity).filter(F.col(toxicity) < threshold).drop(toxicity)
