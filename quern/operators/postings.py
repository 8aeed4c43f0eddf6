"""A stored full-text index: compressed postings by range of documents, searched with block-max pruning.

The documents of a batch are cut into ranges of up to ``docs`` rows.  A range has one block for each term it holds: the
documents' numbers within the range as differences and the term's counts in them, as variable-length
bytes, and the block's best pairs (count, document length), those that no other pair of the block beats in both, from which
the greatest BM25 part of the block follows for any parameters and any mean length.  The blocks of a range are packed by a
hash of their terms into ``PARTS`` rows, and files hold one analyser's rows of one part, so that a search reads the parts of its terms
only; a further row has the range's document ids and lengths.  Several analysers can share one index and one reading of the texts.

``vocabulary`` holds document frequencies by the hash of the term, for their mean.  A batch counts once it is in ``batches``,
which is written last: an append that fails leaves nothing that is read.

A search takes the blocks of its terms out and brings them together by range.  A query's floor is the greatest over its terms of the k-th best
block of the term (k different documents score as much by that term alone), raised by what its task has found; a
range whose blocks' best parts add up to less is passed over undecoded.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import retrieval
from quern.operators.retrieval import Best
from quern.storage import arrow_rows, materialize, spread

PARTS = 16
HEAD = PARTS
ENTRY = "range long, terms array<string>, n array<int>, sizes array<int>, body binary, tops array<int>, top_tf array<int>, top_dl array<int>, ids array<long>, dls array<int>"
BATCH = "field string, n long, total long, batch string"
#: Rows of a range's terms handed to a worker at a time.
WIDE = 32
#: Pairs of document and query scored at a time.
PAIRS = 1 << 20


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first, the eighth where more follow; and the number of bytes of each value."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= 1 << bits
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for i in range(int(sizes.max(initial=0))):
        more = sizes > i
        out[at[more] + i] = (values[more] >> 7 * i & 127) | np.where(sizes[more] > i + 1, 128, 0)
    return out, sizes


def from_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values, and the place after each."""
    stops = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], stops[:-1]])
    out = np.zeros(len(stops), np.int64)
    for i in range(int((stops - starts).max(initial=0))):
        more = stops - starts > i
        out[more] |= (data[starts[more] + i].astype(np.int64) & 127) << 7 * i
    return out, stops


def _first(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def part_of(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % PARTS


def encode_range(words: pa.ListArray) -> tuple[list[dict], np.ndarray]:
    """A range's rows, one a part that has terms, and the documents' lengths."""
    dls = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    names = coded.dictionary.to_pylist()
    parts = np.array([part_of(t) for t in names], np.int64)
    order = np.argsort(parts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs = max(1, len(dls))
    key, tf = np.unique(place[coded.indices.to_numpy()] * docs + np.repeat(np.arange(len(dls)), dls), return_counts=True)
    term, doc = key // docs, key % docs
    first = _first(term)
    n = np.diff(np.append(first, len(term)))
    step = np.diff(doc, prepend=0)
    step[first] = doc[first]
    data, sizes = to_bytes(np.stack([step, tf], axis=1).ravel())
    lengths = np.add.reduceat(sizes, 2 * first) if len(first) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    # Of a block's pairs by falling count, those shorter than all before; a later block lies below all earlier ones.
    by = np.lexsort((dls[doc], -tf, term))
    low = dls[doc][by] - term[by] * (int(dls.max(initial=0)) + 1)
    best = low < np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(low)[:-1]]) if len(low) else np.zeros(0, bool)
    pairs = by[best]
    tops = np.bincount(term[pairs], minlength=len(first))
    edges, top_edges = np.searchsorted(parts[order], np.arange(PARTS + 1)), np.concatenate([[0], np.cumsum(tops)])
    rows = []
    for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            top = pairs[top_edges[a] : top_edges[b]]
            rows.append({
                "part": p, "terms": [names[i] for i in order[a:b]], "n": n[a:b], "sizes": lengths[a:b], "body": data[offsets[a] : offsets[b]].tobytes(),
                "tops": tops[a:b], "top_tf": tf[top], "top_dl": dls[doc[top]],
            })
    return rows, dls


def decode(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """block, document in the range, count of all postings of the blocks."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    values, stops = from_bytes(data)
    step, tf = values[::2], values[1::2]
    n = np.diff(np.searchsorted(stops, np.concatenate([[0], np.cumsum([len(b) for b in bodies])]), side="right")) // 2
    block = np.repeat(np.arange(len(bodies)), n)
    total = np.cumsum(step)
    start = np.cumsum(n) - n
    return block, total - np.repeat(total[start] - step[start], n), tf


_KINDS = {
    "field": pa.string(), "part": pa.int32(), "range": pa.int64(), "terms": pa.list_(pa.string()), "n": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32()), "body": pa.binary(),
    "tops": pa.list_(pa.int32()), "top_tf": pa.list_(pa.int32()), "top_dl": pa.list_(pa.int32()), "ids": pa.list_(pa.int64()), "dls": pa.list_(pa.int32()),
}


def _entries(words: DataFrame, fields: list[str], docs: int, base: int) -> DataFrame:
    """All rows of the index, with field and part, of ``words(doc_id, *fields)``; ranges are numbered from ``base``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = base + (TaskContext.get().partitionId() << 24)
        for whole in batches:
            for at in range(0, len(whole), docs):
                batch = whole.slice(at, docs)
                number += 1
                for i, field in enumerate(fields):
                    rows, dls = encode_range(batch.column(1 + i))
                    rows.append({"part": HEAD, "ids": batch.column(0).to_numpy(), "dls": dls})
                    same = {"field": field, "range": number}
                    yield pa.RecordBatch.from_arrays([pa.array([(r | same).get(c) for r in rows], kind) for c, kind in _KINDS.items()], list(_KINDS))

    return words.mapInArrow(run, f"field string, part int, {ENTRY}")


def _matching(rows: DataFrame, terms: list[str], avgdl: float, k1: float, b: float) -> DataFrame:
    """range, number, n, body, top of the blocks of ``terms``; ``top`` is the greatest part of the block."""
    held = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(held.value, pa.string())
        for batch in batches:
            for i in range(len(batch)):
                number, names, n, sizes, body, tops, tf, dl = (batch.column(c)[i] for c in range(8))
                where = pc.index_in(names.values, wanted).to_numpy(zero_copy_only=False)
                found = np.flatnonzero(~np.isnan(where.astype(float)))
                if not len(found):
                    continue
                n, sizes, tops, tf, dl = (x.values.to_numpy() for x in (n, sizes, tops, tf, dl))
                most = np.maximum.reduceat(tf / (tf + k1 * (1 - b + b * dl / avgdl)), np.cumsum(tops) - tops)
                stops, body = np.cumsum(sizes.astype(np.int64)), body.as_py()
                bodies = [body[stops[j] - sizes[j] : stops[j]] for j in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), number.as_py())), pa.array(where[found].astype(np.int32)), pa.array(n[found]), pa.array(bodies, pa.binary()), pa.array(most[found])],
                    ["range", "number", "n", "body", "top"])

    return rows.select("range", "terms", "n", "sizes", "body", "tops", "top_tf", "top_dl").mapInArrow(run, "range long, number int, n int, body binary, top double")


@dataclass(frozen=True)
class TextIndex:
    """The index under ``path``; ``analysers`` name the expressions that make a text's tokens, ``vocabularies`` those whose mean idf is asked for."""

    spark: SparkSession
    path: str
    analysers: dict[str, Callable[[Column], Column]]
    vocabularies: tuple[str, ...] = ("space",)

    @staticmethod
    def create(spark: SparkSession, path: str, analysers: dict[str, Callable[[Column], Column]] | None = None) -> TextIndex:
        """A new index without documents, by default for both searches."""
        spark.createDataFrame([], BATCH).write.parquet(f"{path}/batches")
        return TextIndex(spark, path, analysers or retrieval.ANALYSERS)

    def append(self, docs: DataFrame, *, docs_per_range: int = 2048) -> TextIndex:
        """Add ``docs(doc_id, content)``, one batch after the other; rows without an id are left out."""
        batch, base = uuid.uuid4().hex, len(self._batches()) << 44
        rows = spread(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "content"))
        words = rows.select("doc_id", *[tokens(F.col("content")).alias(f"_{name}") for name, tokens in self.analysers.items()])
        with arrow_rows(self.spark, docs_per_range):
            _entries(words, list(self.analysers), docs_per_range, base).hint("rebalance", "field", "part").write.partitionBy("field", "part").parquet(f"{self.path}/entries/batch={batch}")
        entries = self._entries([batch], None)
        for field in self.vocabularies:
            each = entries.filter((F.col("field") == field) & (F.col("part") < HEAD)).select(F.explode(F.arrays_zip("terms", "n")).alias("t")).select(F.xxhash64("t.terms").alias("term"), F.col("t.n").alias("n"))
            each.groupBy("term").agg(F.sum("n").cast("long").alias("df")).write.parquet(f"{self.path}/vocabulary/{field}/batch={batch}")
        sizes = entries.filter(F.col("part") == HEAD).groupBy("field").agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"))
        sizes.select("field", F.col("n").cast("long").alias("n"), "total", F.lit(batch).alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return self

    def _entries(self, batches: list[str], field: str | None) -> DataFrame:
        paths, schema = [f"{self.path}/entries/batch={b}" for b in batches], f"{ENTRY}, batch string, field string, part int"
        found = self.spark.read.option("basePath", f"{self.path}/entries").schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return found if field is None else found.filter(F.col("field") == field)

    def _batches(self) -> list[str]:
        return sorted({r.batch for r in self.spark.read.schema(BATCH).parquet(f"{self.path}/batches").select("batch").collect()})

    def size(self, field: str) -> tuple[int, float]:
        """The number of documents and their mean length."""
        r = self.spark.read.schema(BATCH).parquet(f"{self.path}/batches").filter(F.col("field") == field).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        return r.n or 0, (r.total or 0) / max(r.n or 0, 1) or 1.0

    def mean_idf(self, field: str, n: int) -> float:
        """The mean of ln((n - df + 0.5) / (df + 0.5)) over all terms."""
        paths = [f"{self.path}/vocabulary/{field}/batch={b}" for b in self._batches()]
        if not paths:
            return 0.0
        terms = self.spark.read.schema("term long, df long").parquet(*paths)
        if len(paths) > 1:  # a batch has each term once
            terms = terms.groupBy("term").agg(F.sum("df").alias("df"))
        return terms.agg(F.avg(F.ln((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0] or 0.0

    def best(
        self, field: str, queries: DataFrame, k: int, *, asks: Callable[[Column], Column] | None = None, k1: float = 1.5, b: float = 0.75,
        epsilon: float | None = 0.25, idf_floor: float = 1e-6, larger_ids: bool = False, limit: int = retrieval.SMALL, floors_from: int = 100_000, skipped: list | None = None,
    ) -> DataFrame:
        """qid, doc_id, score: as :func:`retrieval.bm25_best` gives them, from the index.

        Queries of up to ``limit`` (query, term) pairs are sent to where the blocks are; more are joined by shuffles.
        Floors that hold for all tasks are looked up from ``floors_from`` documents on.
        ``skipped`` receives an accumulator of the pairs of query and range that were passed over.
        """
        n, avgdl = self.size(field)
        mean = None if epsilon is None else epsilon * self.mean_idf(field, n)
        asked = queries.select(F.col("qid").cast("long").alias("qid"), F.explode((asks or self.analysers[field])(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
        few = asked.limit(limit + 1).toArrow()
        entries = self._entries(self._batches(), field)
        if few.num_rows > limit:
            return self._joined(entries, materialize(asked, "terms"), n, avgdl, mean, k1, b, idf_floor)
        own = sorted(set(few.column("term").to_pylist()))
        with arrow_rows(self.spark, WIDE):
            found = materialize(_matching(entries.filter(F.col("part").isin({part_of(t) for t in own}) & (F.col("part") < HEAD)), own, avgdl, k1, b), "blocks")
        df = np.zeros(len(own))
        for r in found.groupBy("number").agg(F.sum("n").alias("df")).collect():
            df[r.number] = r.df
        raw = np.log((n - df + 0.5) / (df + 0.5))
        idf = np.where(raw <= 0, idf_floor, raw) if mean is None else np.where(raw < 0, mean, raw)
        number = {t: i for i, t in enumerate(own)}
        term = np.array([number[t] for t in few.column("term").to_pylist()], np.int64)
        held = df[term] > 0
        qid, weight, term = few.column("qid").to_numpy()[held], (idf[term] * few.column("qtf").to_numpy() * (k1 + 1))[held], term[held]
        kth = np.zeros(len(own))
        if n >= floors_from:
            order = Window.partitionBy("number").orderBy(F.desc("top"))
            for r in found.select("number", "top").withColumn("k", F.row_number().over(order)).filter(F.col("k") == k).collect():
                kth[r.number] = r.top
        heads = entries.filter(F.col("part") == HEAD).select("range", F.lit(-1).alias("number"), F.lit(None).cast("binary").alias("body"), F.lit(0.0).alias("top"), "ids", "dls")
        rows = heads.unionByName(found.select("range", "number", "body", "top", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("dls")))
        counter = self.spark.sparkContext.accumulator(0) if skipped is not None else None
        if skipped is not None:
            skipped.append(counter)
        return _search(rows.repartition("range").sortWithinPartitions("range", "number"), Asked.of(qid, term, weight, kth), k, larger_ids, avgdl, k1, b, counter)

    def _joined(self, entries: DataFrame, asked: DataFrame, n: int, avgdl: float, mean: float | None, k1: float, b: float, idf_floor: float) -> DataFrame:
        """More query terms than a task can hold: decoded postings meet them by shuffles."""
        heads = entries.filter(F.col("part") == HEAD).select("range", "ids", "dls")

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    number, names, sizes, body = (batch.column(c)[i] for c in range(4))
                    sizes, body = sizes.values.to_numpy(), body.as_py()
                    stops = np.cumsum(sizes.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), number.as_py())), names.values, pa.array([body[e - s : e] for s, e in zip(sizes, stops, strict=True)], pa.binary())], ["range", "term", "body"])

        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, doc, tf = decode(batch.column(2).to_pylist()) if len(batch) else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(block)), batch.column(1).take(pa.array(block)), pa.array(doc), pa.array(tf)], ["range", "term", "doc", "tf"])

        blocks = entries.filter(F.col("part") < HEAD).select("range", "terms", "sizes", "body").mapInArrow(taken, "range long, term string, body binary")
        postings = materialize(blocks.join(asked.select("term").distinct(), "term", "left_semi").select("range", "term", "body").mapInArrow(decoded, "range long, term string, doc long, tf long"), "postings")
        frequencies = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        raw = F.ln((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        idf = F.when(raw <= 0, F.lit(idf_floor)).otherwise(raw) if mean is None else F.when(raw < 0, F.lit(mean)).otherwise(raw)
        weighed = materialize(asked.join(frequencies.select("term", idf.alias("idf")), "term"), "weights")
        documents = heads.select("range", F.posexplode(F.arrays_zip("ids", "dls")).alias("doc", "d")).select("range", F.col("doc").cast("long").alias("doc"), F.col("d.ids").alias("doc_id"), F.col("d.dls").alias("dl"))
        tf = F.col("tf")
        part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
        scored = postings.join(documents, ["range", "doc"]).join(weighed, "term").groupBy("qid", "range", "doc", "doc_id").agg(F.sum(part).alias("score"))
        return scored.select("qid", "doc_id", retrieval.T.quantised(F.col("score")).alias("score"))


@dataclass(frozen=True)
class Asked:
    """Queries by number and their weights by term: those of term ``t`` are at ``starts[t]:starts[t + 1]`` of ``query`` and ``weight``."""

    qids: np.ndarray
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    floor: np.ndarray

    @staticmethod
    def of(qid: np.ndarray, term: np.ndarray, weight: np.ndarray, kth: np.ndarray) -> Asked:
        """Of rows (query, term, weight); ``kth``: of each term the k-th best part of a block, 0 where there are fewer blocks."""
        qids, number = np.unique(qid, return_inverse=True)
        order = np.argsort(term, kind="stable")
        floor = np.full(len(qids), -np.inf)
        np.maximum.at(floor, number, np.where(kth[term] > 0, weight * kth[term], -np.inf))
        floor[number[weight < 0]] = -np.inf  # a term that takes away makes the others no lower bound
        return Asked(qids, np.searchsorted(term[order], np.arange(len(kth) + 1)), number[order], weight[order], floor)

    def pairs(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``terms`` with its queries: the place in ``terms``, and the place in ``query``."""
        n = self.starts[terms + 1] - self.starts[terms]
        return np.repeat(np.arange(len(terms)), n), np.repeat(self.starts[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _search(rows: DataFrame, asked: Asked, k: int, larger_ids: bool, avgdl: float, k1: float, b: float, counter) -> DataFrame:
    """qid, doc_id, score of ``rows(range, number, body, top, ids, dls)``, a range's head before its blocks."""
    held = rows.sparkSession.sparkContext.broadcast(asked.__dict__)  # plain arrays: workers need no copy of the package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Asked(**held.value)
        best = Best(len(a.qids), k, larger_ids)
        best.floor = a.floor.copy() - 2e-6  # scores are rounded
        head, terms, bodies, tops = None, [], [], []

        def score() -> None:
            if head is None or not terms:
                return
            number, top = np.array(terms), np.array(tops)
            at, where = a.pairs(number)
            most = np.bincount(a.query[where], np.maximum(a.weight[where] * top[at], 0), len(a.qids))
            asks = np.bincount(a.query[where], minlength=len(a.qids)) > 0
            alive = asks & (most >= best.floor - 2e-6)
            if counter is not None:
                counter.add(int((asks & ~alive).sum()))
            wanted = np.flatnonzero(np.bincount(at, alive[a.query[where]], len(number)))
            if not len(wanted):
                return
            ids, dls = head
            block, doc, tf = decode([bodies[i] for i in wanted])
            part = tf / (tf + k1 * (1 - b + b * dls[doc] / avgdl))
            term, order = number[wanted][block], np.argsort(doc, kind="stable")
            doc, term, part = doc[order], term[order], part[order]
            # Whole documents, some at a time, so that the pairs with queries stay bounded.
            sizes = np.cumsum(a.starts[term + 1] - a.starts[term])
            edges = np.append(_first(doc), len(doc))
            start = 0
            while start < len(doc):
                reach = np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PAIRS, side="right")
                stop = edges[max(np.searchsorted(edges, reach, side="right") - 1, np.searchsorted(edges, start, side="right"))]
                here, where = a.pairs(term[start:stop])
                good = alive[a.query[where]]
                here, where = here[good] + start, where[good]
                pair, slot = np.unique(doc[here] * len(a.qids) + a.query[where], return_inverse=True)
                total = np.bincount(slot, part[here] * a.weight[where], len(pair))
                best.add(pair % len(a.qids), ids[pair // len(a.qids)], np.floor(total * 1e6 + 0.5) / 1e6)
                start = stop

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (1, 2, 3)]
            for i, (number, body, top) in enumerate(zip(*columns, strict=True)):
                if number < 0:
                    score()
                    head = tuple(batch.column(c)[i].values.to_numpy() for c in (4, 5))
                    terms, bodies, tops = [], [], []
                else:
                    terms.append(number)
                    bodies.append(body)
                    tops.append(top)
        score()
        query, doc, total = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(a.qids[query]), pa.array(doc.astype(np.int64)), pa.array(total.astype(float))], ["qid", "doc_id", "score"])

    return rows.select("range", "number", "body", "top", "ids", "dls").mapInArrow(run, "qid long, doc_id long, score double")
