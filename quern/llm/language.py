"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  One binary classifier a bit tells the languages that
have it from those that have not, by hashed character n-grams of the lower-case letters (all other
characters are one blank): a linear classifier whose weights are the log ratio of a gram's mean share in the
languages of either side.  A text's margin in a bit is the sum over its grams, divided by the root of their
number.  Decoding is loss-weighted: a language's loss is the sum over bits of the logistic loss of the margin against its
codeword, each bit weighted by how often its classifier is right on that language's training texts.  The
language of least loss is predicted.  A text is flagged as ambiguous if the next language is near in loss, or if more bits
disagree with the chosen codeword than the code corrects.

Up to ``EXHAUSTIVE`` languages have all splits in two as bits; more have ``10 * log2`` random bits, of several
seeded draws the one whose codewords are farthest apart.

Scale: three Arrow passes without a text shuffle: gram counts by language, right bits by language, scores.  A
task sends one row for each language and bucket it saw.  Counts cover every training text; the driver
holds languages x ``buckets`` counts and the tasks bits x ``buckets`` weights, whatever the number of texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and teaches nothing, as do
null languages; an empty language name is a name; a null id is the empty id (held out); with nothing to learn from
all are ``und``; a single language has no bits and is predicted with score 1 wherever there are letters; equal
losses go to the first language by code point; a text of over ``PIECE`` characters is read whole, in parts that each
begin and end with a blank; rows that repeat are scored one by one.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.text import fold
from quern.storage import spread

UNKNOWN = "und"
#: Grams of 1 to this many characters.
LONGEST = 3
EXHAUSTIVE = 6
PIECE = 1 << 16
#: Letters lie below.
_POINTS = 0x34000
_FACTOR = np.uint32(0x9E3779B1)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(_POINTS - 1)] + [False])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """A row of 1 and -1 for each language; every bit divides the languages and no two bits are the same split."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (languages, math.ceil(10 * math.log2(languages))))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        code = np.unique(code * code[0], axis=1)
        nearest = distances(code).min()
        if nearest > apart:
            best, apart = code, nearest
    return best


def distances(code: np.ndarray) -> np.ndarray:
    """The numbers of differing bits of all pairs of codewords, once each."""
    n, bits = code.shape
    return ((bits - code @ code.T) / 2)[np.triu_indices(n, 1)]


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all grams of lower-case texts with a letter, and the number of each text's; text by text within an order."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 2 for t in texts])
    starts = np.cumsum(sizes) - sizes
    letter = _letters()[np.minimum(points, _POINTS - 1)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters the first
    keep[starts] = True
    keep[starts + 1] &= letter[starts + 1]
    held = np.where(letter, points, np.uint32(32))[keep]
    ends = np.cumsum(np.add.reduceat(keep.astype(np.int64), starts))
    first, shift = np.concatenate([[0], ends[:-1]]), np.uint32(33 - buckets.bit_length())
    owner = np.repeat(np.arange(len(texts)), ends - first)
    found, owners, key = [], [], np.zeros(len(held), np.uint32)
    for n in range(1, LONGEST + 1):
        key = key[: len(held) - n + 1] * _FACTOR + held[n - 1 :]
        whole = np.ones(len(key), bool)
        if n > 1:  # not across texts
            whole = owner[: len(key)] == owner[n - 1 :]
        mixed = key[whole] + np.uint32(n)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        found.append((mixed >> shift).astype(np.int64))
        owners.append(owner[: len(key)][whole])
    return np.concatenate(found), np.concatenate(owners)


def pieces(texts: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Lists of (number, lower-case text) of about PIECE characters; a longer text comes in parts, cut after a space where there is one."""
    held, size = [], 0
    for i, text in texts:
        text, at = text.lower(), 0
        while at < len(text):
            stop = at + PIECE
            if stop < len(text):
                stop = text.rfind(" ", at, stop) + 1 or stop
            part = text[at:stop]
            if has_letter(part):
                held.append((i, part))
                size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
            at = stop
    if held:
        yield held


@dataclass(frozen=True)
class Model:
    """``weights``: a row a bucket and a column a bit; ``trust``: a row a language and a column a bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    margin: float

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's margin in each bit, and whether it has a letter."""
        sums, n = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts), np.int64)
        for held in pieces((i, t) for i, t in enumerate(texts) if t):
            which, owners = grams([t for _, t in held], len(self.weights))
            numbers = np.array([i for i, _ in held])
            order = np.argsort(owners, kind="stable")
            owners, which = owners[order], which[order]
            at = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
            # np.add.at, as a long text may come in several parts of one piece
            np.add.at(sums, numbers[owners[at]], np.add.reduceat(self.weights[which], at, axis=0))
            np.add.at(n, numbers[owners[at]], np.diff(np.append(at, len(owners))))
        return sums / np.sqrt(np.maximum(n, 1))[:, None], n > 0

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text the nearest language, its score, the next language (or -1), and whether the choice is ambiguous."""
        loss = np.stack([(trust * np.logaddexp(0, -word * margins)).sum(axis=1) for word, trust in zip(self.code, self.trust, strict=True)], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        loss = np.take_along_axis(loss, order, axis=1)
        score = 1 / np.exp(loss[:, :1] - loss).sum(axis=1)
        if len(self.languages) < 2:
            return order[:, 0], score, np.full(len(loss), -1), np.zeros(len(loss), bool)
        wrong = (np.where(margins > 0, 1.0, -1.0) != self.code[order[:, 0]]).sum(axis=1)
        corrects = (distances(self.code).min() - 1) // 2
        return order[:, 0], score, order[:, 1], (loss[:, 1] - loss[:, 0] < self.margin) | (wrong > corrects)


def _count(rows: Iterator[tuple[str, str]], buckets: int) -> dict[str, np.ndarray]:
    """Gram counts by language."""
    total: dict[str, np.ndarray] = {}
    held: dict[str, tuple[list[str], int]] = {}

    def flush(language: str) -> None:
        texts, _ = held.pop(language)
        for part in pieces(enumerate(texts)):
            total[language] += np.bincount(grams([t for _, t in part], buckets)[0], minlength=buckets)

    for language, text in rows:
        if has_letter(text):
            total.setdefault(language, np.zeros(buckets, np.int64))
            texts, size = held.get(language, ([], 0))
            texts.append(text)
            held[language] = (texts, size + len(text))
            if size + len(text) >= PIECE:
                flush(language)
    for language in list(held):
        flush(language)
    return total


def train(labelled: DataFrame, *, buckets: int = 1 << 16, smooth: float = 0.5, margin: float = 1.0) -> Model:
    """The model of ``labelled(lang, text)``; every row with a language and a letter is learnt from."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for language, n in _count(each, buckets).items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = labelled.filter("lang is not null and text is not null").select("lang", "text")
    got = rows.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), buckets))
    counts[[number[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    code = codewords(len(languages))
    share = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * buckets)
    weights = np.stack([np.log(share[word > 0].mean(axis=0) / share[word < 0].mean(axis=0)) for word in code.T], axis=1) if code.size else np.zeros((buckets, 0))
    model = Model(languages, code, weights, np.ones(code.shape), margin)
    if not code.size:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model.__dict__)  # plain values: workers need no copy of the package

    def right_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, right, n = Model(**shared.value), np.zeros(code.shape, np.int64), np.zeros(len(languages), np.int64)
        for batch in batches:
            margins, sane = m.margins(batch.column(1).to_pylist())
            own = np.array([number[x] if ok else 0 for x, ok in zip(batch.column(0).to_pylist(), sane, strict=True)], np.int64)
            np.add.at(right, own[sane], np.where(margins[sane] > 0, 1, -1) == m.code[own[sane]])
            np.add.at(n, own[sane], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(right.size)), pa.array(right.ravel()), pa.array(np.repeat(n, right.shape[1]))], ["cell", "k", "n"])

    found = rows.mapInArrow(right_bits, "cell long, k long, n long").groupBy("cell").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).toArrow()
    trust = np.zeros(code.size)
    trust[found.column("cell").to_numpy()] = (found.column("k").to_numpy() + 1) / (found.column("n").to_numpy() + 2)
    trust = trust.reshape(code.shape)
    return Model(languages, code, weights, trust / trust.mean(axis=1, keepdims=True), margin)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, runner_up, ambiguous: one row a document."""
    shared = docs.sparkSession.sparkContext.broadcast(model.__dict__)
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        names = np.array([*m.languages, None], object)
        for batch in batches:
            margins, sane = m.margins(batch.column(2).to_pylist())
            if m.languages:
                first, score, second, ambiguous = m.decode(margins)
            else:
                sane = np.zeros(len(batch), bool)
                first = second = np.full(len(batch), -1)
                score, ambiguous = np.zeros(len(batch)), sane
            columns = [np.where(sane, names[first], UNKNOWN), np.where(sane, score, 0.0), np.where(sane, names[second], None), sane & ambiguous]
            columns = [pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.float64(), pa.string(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """:func:`predict` by a model of the rows of ``docs`` that are not held out."""
    labelled = docs.filter(fold(F.col(id_col)) != 0).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return predict(docs, train(spread(labelled), **options), id_col=id_col, text_col=text_col)
