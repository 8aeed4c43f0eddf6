"""Language-model scoring by prediction by partial matching over bytes.

The model is the trie of byte contexts of length 0 to ``order`` over all training
texts, as counts of (context, symbol).  A symbol that the longest seen context has
never shown is coded by an escape (method C: as likely as the context has distinct
symbols) to the next shorter context, from which the symbols already excluded are
left out, and at last by an even choice among the symbols never seen.  The 257
symbols are the bytes and the end of the text, so the probabilities of all texts sum
to one.  ``pretrained`` scores by these counts; ``adaptive`` codes a text by the
contexts of that text alone, learning as it goes.

Beside it stands a unigram word score with the same training texts as a base.

Scale: counting is one Arrow pass that merges counts in bounded arrays and then one
aggregate on (kind, key); it covers every training text, and the tables grow with the
corpus.  They are broadcast only behind a check of their counted rows (``small_grams``
rows take up to 300 MB in each Python worker, with all shorter orders).  Beyond, the model is cut into
shards by the last two bytes of the context, which all orders from two on share (the tables of orders 0 and 1 are small and go to all
shards).  Texts are taken in groups of about ``group_bytes``; a group's distinct grams go to their shards once, packed, and one
log a gram comes back to where the group's texts are then scored; no row is made for a text and a gram.  Texts are processed in pieces of ``PIECE`` bytes, whole, whatever
their length.

Defined cases: a null text is empty (one token, the end); a null id trains; rows that
repeat are counted and scored one by one; with no training texts the model is the even
choice.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.postings import from_bytes, to_bytes
from quern.storage import materialize, spread

SYMBOLS = 257
PIECE = 1 << 19
GRAM, WORD = 0, 1
#: Counts are merged in memory, so many new keys at a time and up to so many.
HELD = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
END_WORD = np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _pieces(texts: Iterator[bytes]) -> Iterator[list[tuple[int, bytes, bytes, bool]]]:
    """Lists of (text number, bytes before, bytes, whether the text ends here), of about PIECE bytes each.

    A longer text is cut after a blank, so that no word is split.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            stop = len(text)
            if stop - at > PIECE:
                cuts = [text.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t")]
                cut = max(cuts) if max(cuts) > at else min((c for c in (text.find(c, at + PIECE) for c in (b" ", b"\n", b"\t")) if c >= 0), default=stop - 1)
                stop = cut + 1
            held.append((i, text[max(0, at - 16) : at], text[at:stop], stop == len(text)))
            size += stop - at
            if size >= PIECE:
                yield held
                held, size = [], 0
            if stop == len(text):
                break
            at = stop
    if held:
        yield held


def _grams(piece, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of the (order + 1)-gram at each byte and end, and the number of keys of each part."""
    blank = bytes(order)
    parts, sizes = [], []
    for _, before, body, last in piece:
        context = np.frombuffer((before[-order:] if order else b""), np.uint8).astype(np.uint64) + 1
        parts += [np.zeros(order - len(context), np.uint64), context, np.frombuffer(body, np.uint8).astype(np.uint64) + 1]
        if last:
            parts.append(np.zeros(1, np.uint64))
        sizes.append(len(body) + last)
    symbols = np.concatenate(parts)
    n = len(symbols) - order
    key = symbols[:n].copy()
    for j in range(1, order + 1):
        key *= np.uint64(SYMBOLS)
        key += symbols[j : j + n]
    wanted = np.ones(n, bool)
    at = np.cumsum(np.array(sizes) + order)[:-1]
    for j in range(len(blank)):
        wanted[at - len(blank) + j] = False
    return key[wanted], np.array(sizes)


def _powers(size: int = 0) -> tuple[np.ndarray, np.ndarray]:
    inverse, size = pow(_BASE, -1, 1 << 64), size or 2 * PIECE
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, inverse))


def _words(piece, powers) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each token (lower-case words, then the end), and the number of tokens of each part."""
    data = np.frombuffer(b" ".join(body for _, _, body, _ in piece), np.uint8)
    up, down = powers
    if len(data) >= len(up):
        up, down = _powers(len(data))  # one giant word
    sizes = np.array([len(body) for _, _, body, _ in piece])
    word = np.concatenate([[False], ~_BLANK[data], [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_FOLD[data]] * up[: len(data)])])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    edges = np.cumsum(sizes + 1) - sizes - 1
    counts = np.diff(np.append(np.searchsorted(starts, edges), len(starts)))
    last = np.array([p[3] for p in piece])
    return np.insert(h, np.cumsum(counts)[last], END_WORD), counts + last


def _count(texts: Iterator[bytes], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, keys, counts), merged in memory; a kind's counts go out when they are more than HELD keys."""
    held = {GRAM: [], WORD: []}
    powers = _powers()

    def merged(kind):
        keys, n = (np.concatenate(x) for x in zip(*held[kind], strict=True))
        rank = np.argsort(keys)
        keys, n = keys[rank], n[rank]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    for piece in _pieces(texts):
        for kind, keys in ((GRAM, _grams(piece, order)[0]), (WORD, _words(piece, powers)[0])):
            held[kind].append(np.unique(keys, return_counts=True))
            if sum(len(x[0]) for x in held[kind][1:]) > HELD:
                held[kind] = [merged(kind)]
                if len(held[kind][0][0]) > HELD:
                    yield kind, *held[kind].pop()
    for kind in held:
        if held[kind]:
            yield kind, *merged(kind)


def counts(texts: DataFrame, order: int) -> DataFrame:
    """kind, key, n of all texts (column ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((t.as_py() or "").encode("utf-8", "surrogatepass") for b in batches for t in b.column(0))
        for kind, keys, n in _count(each, order):
            for i in range(0, len(keys), 1 << 18):
                k = keys[i : i + (1 << 18)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i : i + (1 << 18)])], ["kind", "key", "n"])

    # A task's counts are merged already, so they are dealt out before the aggregate and not merged once more in the executor's heap.
    return texts.select("text").mapInArrow(run, "kind int, key long, n long").repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The position of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _contexts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of sorted grams, and each gram's own among them."""
    short = keys // np.uint64(SYMBOLS)
    first = np.concatenate([np.ones(min(1, len(keys)), bool), short[1:] != short[:-1]])
    return short[first], (np.cumsum(first) - 1).astype(np.int32)


def _shorter(keys: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams of order ``k`` with their counts, of those one order longer, and where each of these went."""
    short = keys % np.uint64(SYMBOLS ** (k + 1))
    rank = np.argsort(short, kind="stable").astype(np.int32)
    short = short[rank]
    first = np.concatenate([np.ones(min(1, len(short)), bool), short[1:] != short[:-1]])
    where = np.empty(len(short), np.int32)
    where[rank] = (np.cumsum(first) - 1).astype(np.int32)
    below = np.add.reduceat(n[rank].astype(np.int64), np.flatnonzero(first)) if len(n) else np.zeros(0, np.int64)
    return short[first], below, where


class Model:
    """A trie of the contexts of order 0 to ``order``, ready for look-ups: log10 of each symbol's probability.

    Each order has its sorted grams with log10 of their count and of their share of the own
    context, and its sorted contexts with the logs that an escape costs: from the context itself
    (``escape``), and from it after a longer one has excluded the symbols that it has shown
    (``log_rest``, ``rest_escape``, kept with the longer one).  Two orders at most are held as
    counts while it is built, and look-ups are binary searches in sorted arrays, so a gram
    takes 16 bytes and a context 32.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None):
        """With ``low``, the sorted grams and counts of order 1 of the whole corpus, ``keys`` may be those of some contexts only."""
        self.order = order
        if np.any(keys[1:] < keys[:-1]):
            rank = np.argsort(keys)
            keys, n = keys[rank], n[rank]
        levels, upper = [], None
        for k in range(order, -1, -1):
            if upper is not None and low is not None and k == 1:
                where = np.searchsorted(low[0], keys % np.uint64(SYMBOLS**2))
                keys, n = low
            elif upper is not None:
                keys, n, where = _shorter(keys, n, k)
            contexts, of = _contexts(keys)
            total, distinct = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
            if upper is not None:
                own = np.searchsorted(contexts, levels[-1]["contexts"] % np.uint64(SYMBOLS**k))
                seen = np.bincount(upper["of"], n[where], len(upper["distinct"]))
                levels[-1] |= self._rest(total[own] - seen, distinct[own] - upper["distinct"])
            log_own = np.log10(total + distinct)
            log_n = np.log10(n).astype(np.float32)
            levels.append({"keys": keys, "contexts": contexts, "log_n": log_n, "hit": (log_n - log_own[of]).astype(np.float32), "escape": np.log10(distinct) - log_own})
            upper = {"of": of, "distinct": distinct}
        levels[-1] |= self._rest(np.zeros(len(upper["distinct"])), SYMBOLS - upper["distinct"])
        self.levels = levels[::-1]

    @staticmethod
    def _rest(total: np.ndarray, distinct: np.ndarray) -> dict[str, np.ndarray]:
        den = total + distinct
        with np.errstate(divide="ignore", invalid="ignore"):
            return {"log_rest": np.log10(den), "rest_escape": np.where(den > 0, np.log10(distinct / den), 0.0)}

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each (order + 1)-gram's last symbol in its context."""
        each, where = np.unique(keys, return_inverse=True)
        return self._score(each)[where]

    def _score(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        above = np.full(len(keys), -1, np.int64)  # the context one order up, if seen
        for k in range(self.order, -1, -1):
            level, upper = self.levels[k], self.levels[k + 1] if k < self.order else None
            short = keys if k == self.order else keys % np.uint64(SYMBOLS ** (k + 1))
            gram = _find(level["keys"], short)
            hit = gram >= 0
            fresh = above < 0
            out[left[hit & fresh]] += level["hit"][gram[hit & fresh]]
            if upper is not None:
                old = hit & ~fresh
                out[left[old]] += level["log_n"][gram[old]] - upper["log_rest"][above[old]]
            left, keys, above, fresh, short = left[~hit], keys[~hit], above[~hit], fresh[~hit], short[~hit]
            if not len(left):
                return out
            context = _find(level["contexts"], short // np.uint64(SYMBOLS))
            new, old = fresh & (context >= 0), ~fresh
            out[left[new]] += level["escape"][context[new]]
            if upper is not None:
                out[left[old]] += upper["rest_escape"][above[old]]
            above = context
        bottom = self.levels[0]["log_rest"]
        out[left] -= np.where(above >= 0, bottom[above], math.log10(SYMBOLS)) if len(bottom) else math.log10(SYMBOLS)
        return out


def _score_pieces(texts: Iterator[bytes], order: int, gram_logs: Callable[[np.ndarray], np.ndarray], word_logs: Callable[[np.ndarray], np.ndarray], den: float) -> list[tuple[int, int, float, float]]:
    """(n_tokens, n_known, base_score, score) of each text; ``word_logs`` gives log10(c + 0.5) of distinct words, ``den`` is the log of the base's denominator."""
    powers = _powers()
    rows: list[list] = []
    for piece in _pieces(texts):
        keys, sizes = _grams(piece, order)
        tokens, numbers = _words(piece, powers)
        found, where = np.unique(tokens, return_inverse=True)
        c = word_logs(found)[where]
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (c > 0, c - den)]
        logs = gram_logs(keys)
        to, token_to = np.cumsum(sizes), np.cumsum(numbers)
        for j, (i, *_) in enumerate(piece):
            if i == len(rows):
                rows.append([0, 0, 0.0, 0.0])
            a, b = token_to[j] - numbers[j], token_to[j]
            rows[i][0] += int(numbers[j])
            rows[i][1] += int(sums[0][b] - sums[0][a])
            rows[i][2] += float(sums[1][b] - sums[1][a])
            rows[i][3] += float(logs[to[j] - sizes[j] : to[j]].sum())
    return rows


def _word_logs(found: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10(c + 0.5) of each word's count c; above 0 if the word is known."""
    vocabulary, n = words
    at = _find(vocabulary, found)
    return np.log10(np.where(at >= 0, n[at], 0) + 0.5) if len(n) else np.full(len(found), math.log10(0.5))


def score_texts(texts: Iterator[bytes], model: Model, words: tuple[np.ndarray, np.ndarray], total: int) -> list[tuple[int, int, float, float]]:
    """(n_tokens, n_known, base_score, score) of each text."""
    return _score_pieces(texts, model.order, model.score, lambda found: _word_logs(found, words), math.log10(total + 0.5 * (len(words[1]) + 1)))


def adaptive_score(text: str | None, order: int = 4) -> float:
    """log10 of the text's probability by a model that starts empty and learns each symbol after coding it."""
    seen: list[dict] = [{} for _ in range(order + 1)]
    symbols = [*(text or "").encode("utf-8", "surrogatepass"), 256]
    out = 0.0
    for i, s in enumerate(symbols):
        excluded: set[int] = set()
        for k in range(min(order, i), -1, -1):
            table = seen[k].get(tuple(symbols[i - k : i]))
            if table is None:
                continue
            free = {t: c for t, c in table.items() if t not in excluded}
            den = sum(free.values()) + len(free)
            if s in free:
                out += math.log10(free[s] / den)
                break
            if free:
                out += math.log10(len(free) / den)
            excluded |= table.keys()
        else:
            out -= math.log10(SYMBOLS - len(excluded))
        for k in range(min(order, i) + 1):
            table = seen[k].setdefault(tuple(symbols[i - k : i]), {})
            table[s] = table.get(s, 0) + 1
    return out


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _grouped(rows: DataFrame, group_bytes: int) -> DataFrame:
    """``rows`` with ``group``: texts that follow each other in a task, of about that many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = seen + np.cumsum([len(x) if x is not None else 0 for x in batch.column(2).cast(pa.binary()).to_pylist()])
            seen = int(size[-1]) if len(size) else seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + size // group_bytes, pa.int64())], ["doc_id", "held_out", "text", "group"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, text string, group long")


def _shards(kind: int, keys: np.ndarray, shards: tuple[int, int]) -> np.ndarray:
    if kind == WORD:
        return np.mod(keys.view(np.int64), shards[WORD])
    return (keys.view(np.int64) // SYMBOLS % SYMBOLS**2 * 40503) % shards[GRAM]


def _shard_column(shards: tuple[int, int]):
    """The same of a table's columns kind and key."""
    gram = (F.expr(f"key div {SYMBOLS}") % SYMBOLS**2 * 40503) % shards[GRAM]
    return F.when(F.col("kind") == WORD, F.pmod("key", F.lit(shards[WORD]))).otherwise(gram).cast("int")


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences; the differences of hashes take all their bits, so they stay as they are."""
    return to_bytes(np.diff(keys.view(np.int64), prepend=np.int64(0)))[0].tobytes()


def _unpack(kind: int, body: bytes) -> np.ndarray:
    if kind == WORD:
        return np.frombuffer(body, np.uint64)
    return np.cumsum(from_bytes(np.frombuffer(body, np.uint8))[0]).view(np.uint64)


def _requests(grouped: DataFrame, order: int, shards: tuple[int, int]) -> DataFrame:
    """kind, shard, group, keys: the distinct grams and words of each group's texts, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, group = _powers(), {GRAM: [], WORD: []}, None

        def out() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    keys = np.unique(np.concatenate(parts))
                    of = _shards(kind, keys, shards)
                    rank = np.argsort(of, kind="stable")
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(of[rank])) + 1, [len(rank)]])
                    split = [keys[rank[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    bodies = [x.tobytes() if kind == WORD else _pack(x) for x in split]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(split), kind, np.int32)), pa.array(of[rank[edges[:-1]]].astype(np.int32)), pa.array(np.full(len(split), group, np.int64)), pa.array(bodies, pa.binary()),
                    ], ["kind", "shard", "group", "keys"])
                held[kind] = []

        for batch in batches:
            groups = batch.column(1).to_numpy()
            for a, b in _stretches(groups):
                if groups[a] != group:
                    yield from out()
                    group = int(groups[a])
                for piece in _pieces((t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(0).slice(a, b - a)):
                    held[GRAM].append(np.unique(_grams(piece, order)[0]))
                    held[WORD].append(np.unique(_words(piece, powers)[0]))
                    if sum(map(len, held[GRAM])) > 4 * HELD:
                        held[GRAM] = [np.unique(np.concatenate(held[GRAM]))]
                        if len(held[GRAM][0]) > 2 * HELD:
                            yield from out()
        yield from out()

    return grouped.select("text", "group").mapInArrow(run, "kind int, shard int, group long, keys binary")


def _stretches(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where all columns stay the same."""
    n = len(columns[0])
    changes = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        changes |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _answers(table: DataFrame, requests: DataFrame, order: int, low: tuple[np.ndarray, np.ndarray], shards: tuple[int, int]) -> DataFrame:
    """kind, group, keys, logs: each request with log10 of its grams' probabilities, or of its words' counts and a half."""
    held = table.sparkSession.sparkContext.broadcast(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, look = None, [], [], None
        for batch in batches:
            kinds, of, ask = (batch.column(i).to_numpy() for i in range(3))
            for a, b in _stretches(kinds, of, ask):
                kind = int(kinds[a])
                if (kind, of[a]) != now:
                    now, keys, counts, look = (kind, of[a]), [], [], None
                if not ask[a]:
                    keys.append(batch.column(3).slice(a, b - a).to_numpy().view(np.uint64))
                    counts.append(batch.column(4).slice(a, b - a).to_numpy())
                    continue
                if look is None:
                    k, n = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (counts, np.int64)))
                    rank = np.argsort(k)
                    k, n = k[rank], n[rank]
                    look = (lambda x, k=k, n=n: _word_logs(x, (k, n))) if kind == WORD else Model(k, n, order, held.value)._score
                for i in range(a, b):
                    body = batch.column(6)[i].as_py()
                    logs = look(_unpack(kind, body)).astype(np.float64 if kind == WORD else np.float32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(5).slice(i, 1), pa.array([body], pa.binary()), pa.array([logs.tobytes()], pa.binary())], ["kind", "group", "keys", "logs"])

    none = lambda kind: F.lit(None).cast(kind)
    known = table.select("kind", _shard_column(shards).alias("shard"), F.lit(0).alias("ask"), "key", "n", none("long").alias("group"), none("binary").alias("keys"))
    asked = requests.select("kind", "shard", F.lit(1).alias("ask"), none("long").alias("key"), none("long").alias("n"), "group", "keys")
    both = known.unionByName(asked).repartition("kind", "shard").sortWithinPartitions("kind", "shard", "ask")
    return both.mapInArrow(run, "kind int, group long, keys binary, logs binary")


def _score_by_shards(rows: DataFrame, table: DataFrame, order: int, total: int, sizes: tuple[int, int], per_shard: int, group_bytes: int) -> DataFrame:
    """The result of :func:`score_corpus` with no more of the model in a task than ``per_shard`` grams or so and what a group of texts asks for."""
    shards = tuple(max(1, -(-n // per_shard)) for n in sizes)
    got = table.filter(F.col("kind") == GRAM).groupBy((F.col("key") % SYMBOLS**2).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    low = (got.column("key").to_numpy().astype(np.uint64), got.column("n").to_numpy())
    grouped = materialize(_grouped(rows, group_bytes), "rows")
    answers = _answers(table, _requests(grouped, order, shards), order, low, shards)
    kind, den = rows.schema["doc_id"].dataType.simpleString(), math.log10(total + 0.5 * (sizes[WORD] + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, look = None, {GRAM: [], WORD: []}, {}

        def table_of(kind: int) -> Callable[[np.ndarray], np.ndarray]:
            parts = held[kind]
            keys = np.concatenate([p[0] for p in parts])
            keys, first = np.unique(keys, return_index=True)  # a group may have asked in several tasks
            logs = np.concatenate([p[1] for p in parts])[first]
            return lambda x: logs[np.searchsorted(keys, x)]

        for batch in batches:
            groups, ask = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in _stretches(groups, ask):
                if groups[a] != group:
                    group, held, look = groups[a], {GRAM: [], WORD: []}, {}
                if not ask[a]:
                    for i in range(a, b):
                        k = batch.column(2)[i].as_py()
                        held[k].append((_unpack(k, batch.column(3)[i].as_py()), np.frombuffer(batch.column(4)[i].as_py(), np.float64 if k == WORD else np.float32)))
                    continue
                look = look or {k: table_of(k) for k in held}
                held = {GRAM: [], WORD: []}
                part = batch.slice(a, b - a)
                got = _score_pieces(((t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(7)), order, lambda x, look=look: look[GRAM](x).astype(np.float64), look[WORD], den)
                yield _result(part.column(5), part.column(6), got, total)

    none = lambda kind: F.lit(None).cast(kind)
    logs = answers.select("group", F.lit(0).alias("ask"), "kind", "keys", "logs", none(kind).alias("doc_id"), none("boolean").alias("held_out"), none("string").alias("text"))
    texts = grouped.select("group", F.lit(1).alias("ask"), none("int").alias("kind"), none("binary").alias("keys"), none("binary").alias("logs"), "doc_id", "held_out", "text")
    both = logs.unionByName(texts).repartition("group").sortWithinPartitions("group", "ask")
    return both.mapInArrow(run, f"doc_id {kind}, held_out boolean, {SCORES}")


def _result(ids: pa.Array, held_out: pa.Array, got: list[tuple[int, int, float, float]], total: int) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
    return pa.RecordBatch.from_arrays([ids, held_out, *columns[:2], pa.array(np.full(len(got), total, np.int64)), *columns[2:]], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_corpus(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None, order: int = 5, small_grams: int = 4_000_000, small_words: int = 4_000_000,
    per_shard: int = 1_000_000, group_bytes: int = 1 << 25,
) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is the condition of the rows that are scored but not learnt from;
    by default crc32 of the id as text, modulo 5, is 1.
    """
    spark = docs.sparkSession
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 1
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")))
    table = materialize(counts(rows.filter("not held_out"), order), "counts")
    size = {r.kind: (r.rows, r.n) for r in table.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    (n_grams, _), (n_words, total) = size.get(GRAM, (0, 0)), size.get(WORD, (0, 0))
    kind = rows.schema["doc_id"].dataType.simpleString()
    grams, words = (table.filter(F.col("kind") == k).select("key", "n") for k in (GRAM, WORD))
    if order > 1 and (n_grams > small_grams or n_words > small_words):
        return _score_by_shards(rows, table, order, total, (n_grams, n_words), per_shard, group_bytes)

    def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.toArrow()
        keys, n = (got.column(c).combine_chunks().to_numpy() for c in ("key", "n"))
        rank = np.argsort(keys.view(np.uint64))
        return keys.view(np.uint64)[rank], n[rank].astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.int64)

    held = spark.sparkContext.broadcast({"grams": arrays(grams), "words": arrays(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = held.value
        if "model" not in data:  # one model a worker process; the counts go once it stands
            data["model"] = Model(*data["grams"], order)
            data["grams"] = None
        for batch in batches:
            got = score_texts(((t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(2)), data["model"], data["words"], total)
            yield _result(batch.column(0), batch.column(1), got, total)

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, {SCORES}")
