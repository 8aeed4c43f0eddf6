"""An inverted file of cells with product-quantised residuals, and exact re-ranking of a short list.

Vectors are of unit length.  The number of cells grows with the square root of the number of vectors; each vector
is entered in its ``copies`` nearest cells, as a code of one byte for each of up to 16 pieces of what is left after the cell's
centre has been taken off.  A query looks into its ``probes`` nearest cells, where a table of its products with all
code words gives approximate scores without the vectors; the ``short`` best are scored exactly.

The index is a table of blocks, (cell, ids, codes), beside small arrays of centres and code words; it can be written and
read.  Rows are brought together by cell in partitions that adaptive execution splits where a cell is crowded, as a cell may be
many blocks anywhere; queries that ask a cell are packed likewise: what meets in the join on the cell are blocks, not rows.

Centres and code words are fitted on at most ``sample`` vectors (the smallest hashes of their ids); every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.retrieval import small
from quern.operators.vectors import merge_ranked, unit_rows
from quern.storage import materialize, spread

PIECES = 16
WORDS = 256
#: Rows of a matrix product at a time.
ROWS = 1024


@dataclass(frozen=True)
class Index:
    """``centres``: cells x dimensions; ``words``: pieces x words x dimensions of a piece; ``blocks(cell, ids, codes)``."""

    centres: np.ndarray
    words: np.ndarray
    blocks: DataFrame

    def write(self, path: str) -> None:
        spark = self.blocks.sparkSession
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        rows = [(kind, list(x.shape), x.astype(np.float64).ravel().tolist()) for kind, x in (("centres", self.centres), ("words", self.words))]
        spark.createDataFrame(rows, "kind string, shape array<int>, numbers array<double>").write.mode("overwrite").parquet(f"{path}/arrays")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        arrays = {r.kind: np.array(r.numbers).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/arrays").collect()}
        return Index(arrays["centres"], arrays["words"], spark.read.parquet(f"{path}/blocks"))


def nearest(rows: np.ndarray, centres: np.ndarray, n: int = 1, squared: bool = False) -> np.ndarray:
    """The numbers of the ``n`` centres of greatest product with each row, or of least distance."""
    away = (centres * centres).sum(axis=1) / 2 if squared else 0.0

    def first(far: np.ndarray) -> np.ndarray:
        # A whole row is sorted only where all of it is asked for.
        if n == 1:
            return np.argmin(far, axis=1)[:, None]
        if n >= far.shape[1]:
            return np.argsort(far, axis=1, kind="stable")
        some = np.sort(np.argpartition(far, n - 1, axis=1)[:, :n], axis=1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)

    return np.concatenate([first(away - rows[i : i + ROWS] @ centres.T) for i in range(0, len(rows), ROWS)] or [np.zeros((0, n), np.int64)])


def k_means(rows: np.ndarray, k: int, *, spherical: bool, steps: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of the rows; an empty one stays where it was."""
    centres = rows[np.random.default_rng(seed).choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(steps):
        own = nearest(rows, centres, squared=not spherical)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, rows)
        size = np.sqrt((sums * sums).sum(axis=1)) if spherical else n
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


def _split(rows: np.ndarray, pieces: int) -> np.ndarray:
    """rows x pieces x dimensions of a piece, zeros added at the end."""
    width = -(-rows.shape[1] // pieces)
    return np.pad(rows, ((0, 0), (0, pieces * width - rows.shape[1]))).reshape(len(rows), pieces, width)


def encode(rows: np.ndarray, cells: np.ndarray, centres: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One byte a piece for each row's residual to its cell."""
    rest = _split(rows - centres[cells], len(words))
    return np.stack([nearest(rest[:, j], words[j], squared=True)[:, 0] for j in range(len(words))], axis=1).astype(np.uint8)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """cell, ids, bodies: up to ``size`` rows (cell, id, body) of a cell as one; bodies have equal lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, bodies = None, [], []

        def out() -> pa.RecordBatch:
            columns = [pa.array([cell], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(bodies)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["cell", "ids", "bodies"])

        for batch in batches:
            for c, i, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if ids and (c != cell or len(ids) >= size):
                    yield out()
                    ids, bodies = [], []
                cell = c
                ids.append(i)
                bodies.append(body)
        if ids:
            yield out()

    return rows.hint("rebalance", "cell").sortWithinPartitions("cell", "id").mapInArrow(run, "cell int, ids array<long>, bodies binary")


def _in_cells(rows: DataFrame, centres: np.ndarray, n: int, body: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """cell, id, body: each row (id, embedding) in its ``n`` nearest cells, with ``body(unit rows, cells)`` as bytes."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                unit = unit_rows(part.column(1))
                cells = nearest(unit, held.value, n)
                which = np.repeat(np.arange(len(part)), cells.shape[1])
                bytes_ = [x.tobytes() for x in body(unit[which], cells.ravel())]
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), part.column(0).take(pa.array(which)), pa.array(bytes_, pa.binary())], ["cell", "id", "body"])

    return rows.mapInArrow(run, "cell int, id long, body binary")


def build(vectors: DataFrame, *, cells: int | None = None, copies: int = 6, sample: int = 1 << 17, block: int = 4096) -> Index | None:
    """The index of ``vectors(vec_id, embedding)``, all of one length; rows with a null are left out, and of no rows there is none."""
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), "embedding")
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow().combine_chunks()
    if not fitted.num_rows:
        return None
    unit = unit_rows(fitted.column(0).combine_chunks())
    cells = cells or min(round(4 * math.sqrt(rows.count())), max(1, len(unit) // 8))
    centres = k_means(unit, cells, spherical=True)
    rest = _split(unit - centres[nearest(unit, centres)[:, 0]], min(PIECES, unit.shape[1]))
    words = np.stack([k_means(rest[:, j], WORDS, spherical=False) for j in range(rest.shape[1])])
    held = rows.sparkSession.sparkContext.broadcast((centres, words))
    entries = _in_cells(spread(rows), centres, min(copies, len(centres)), lambda unit, cells: encode(unit, cells, *held.value))
    return Index(centres, words, materialize(_packed(entries, block).withColumnRenamed("bodies", "codes"), "cells"))


def _cut(query: np.ndarray, vec: np.ndarray, score: np.ndarray, short: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``short`` best candidates of each query, each candidate once, by query."""
    order = np.lexsort((-score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.concatenate([np.ones(min(1, len(query)), bool), (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])])
    query, vec, score = query[first], vec[first], score[first]
    if short:
        order = np.lexsort((vec, -score, query))
        order = order[np.arange(len(order)) - np.searchsorted(query, query[order]) < short]
        query, vec, score = query[order], vec[order], score[order]
    return query, vec, score


def _lists(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """qid, vec_ids, near: one row a query, of rows by query."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(query)), bool), query[1:] != query[:-1]]))
    edges = pa.array(np.append(first, len(query)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(query[first]), pa.ListArray.from_arrays(edges, pa.array(vec)), pa.ListArray.from_arrays(edges, pa.array(score))], ["qid", "vec_ids", "near"])


class _Shortest:
    """The ``short`` best candidates of each query among those seen, each candidate once."""

    def __init__(self, short: int | None, hold: int = 1 << 20):
        self.short, self.hold, self.rows, self.size = short, hold, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append(columns)
        self.size += len(columns[0])
        if self.size > self.hold:
            self.rows = [self._best()]
            self.size = len(self.rows[0][0])
            if self.size > self.hold // 2:  # too many queries to wait for better ones
                yield self.out()

    def _best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _cut(*(np.concatenate(x) for x in zip(*self.rows, strict=True)), self.short) if self.rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def out(self) -> pa.RecordBatch:
        best, self.rows, self.size = self._best(), [], 0
        return _lists(*best)


def _merged(parts: DataFrame, short: int | None) -> DataFrame:
    """qid, vec_ids, near: the best of all tasks' lists of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            new = (np.repeat(batch.column(0).to_numpy(), sizes), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy())
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            done = int(np.searchsorted(held[0] == held[0][-1], True)) if len(held[0]) else 0  # the last query may go on
            if done:
                yield _lists(*_cut(*(x[:done] for x in held), short))
                held = [x[done:] for x in held]
            held = list(_cut(*held, short))
        yield _lists(*_cut(*held, short))

    return parts.repartition("qid").sortWithinPartitions("qid").mapInArrow(run, "qid long, vec_ids array<long>, near array<double>")


def candidates(index: Index, queries: DataFrame, probes: int, short: int | None, group: int = 256) -> DataFrame:
    """qid, vec_id: the ``short`` best by code of the cells each query looks into, or all that are in them."""
    asked = queries.filter("qid is not null and embedding is not null").select(F.col("qid").cast("long").alias("id"), "embedding")
    groups = _packed(_in_cells(spread(asked), index.centres, min(probes, len(index.centres)), lambda unit, cells: unit), group)
    # Blocks meet by shuffle: as a broadcast they would go through the driver.
    met = index.blocks.join(groups.select("cell", F.col("ids").alias("qids"), "bodies").hint("merge"), "cell")
    held = queries.sparkSession.sparkContext.broadcast((index.centres, index.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, words = held.value
        best = _Shortest(short)
        for batch in batches:
            for i in range(len(batch)):
                cell, ids, codes, qids, bodies = (batch.column(c).slice(i, 1) for c in range(5))
                ids, qids = (x.flatten().to_numpy() for x in (ids, qids))
                q = np.frombuffer(bodies[0].as_py()).reshape(len(qids), -1)
                codes = np.frombuffer(codes[0].as_py(), np.uint8).reshape(len(ids), len(words))
                table = np.einsum("qjd,jwd->jqw", _split(q, len(words)), words)
                score = np.repeat((q @ centres[cell[0].as_py()])[:, None], len(ids), axis=1)
                for j in range(len(words)):
                    score += table[j][:, codes[:, j]]
                kept = np.argpartition(-score, short - 1, axis=1)[:, :short] if short and short < len(ids) else np.broadcast_to(np.arange(len(ids)), score.shape)
                yield from best.add(np.repeat(qids, kept.shape[1]), ids[kept].ravel(), np.take_along_axis(score, kept, axis=1).ravel())
        yield best.out()

    parts = met.select("cell", "ids", "codes", "qids", "bodies").mapInArrow(run, "qid long, vec_ids array<long>, near array<double>")
    return _merged(parts, short).select("qid", F.explode("vec_ids").alias("vec_id"))


def _in_asked_cells(index: Index, queries: DataFrame, probes: int, group: int = 256) -> DataFrame:
    """vec_id, qids: every vector in the cells that queries look into, once, with these queries."""
    asked = queries.filter("qid is not null and embedding is not null").select(F.col("qid").cast("long").alias("id"), "embedding")
    groups = _packed(_in_cells(spread(asked), index.centres, min(probes, len(index.centres)), lambda unit, cells: unit[:, :0]), group)
    met = index.blocks.select("cell", "ids").join(groups.select("cell", F.col("ids").alias("qids")).hint("merge"), "cell")
    return met.select(F.explode("ids").alias("vec_id"), "qids").groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("qids"))).alias("qids"))


def search(index: Index | None, vectors: DataFrame, queries: DataFrame, k: int = 10, *, probes: int | None = None, short: int | None = 200) -> DataFrame:
    """qid, rank, vec_id, score: the ``k`` best of ``vectors`` for ``queries(qid, embedding)`` by exact cosine among the candidates.

    By default a query looks into a tenth of the cells.  ``short=None`` scores all vectors of these cells exactly.
    """
    if index is None:
        return merge_ranked(queries.select(F.col("qid").cast("long").alias("qid"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).filter("false"), k)
    probes, held = probes or max(1, len(index.centres) // 10), vectors.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    # A repeated id is a vector of its own each time.
    if short is None:  # nothing is to be ranked by code, and no query's candidates come together
        rows = held.join(_in_asked_cells(index, queries, probes), "vec_id").select("vec_id", "embedding", F.explode("qids").alias("qid"))
    else:
        rows = held.join(materialize(candidates(index, queries, probes, short), "candidates").hint("merge"), "vec_id")
    both = rows.join(small(queries.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").alias("q")), 4096), "qid")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                score = (unit_rows(batch.column(2)) * unit_rows(batch.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.floor(score * 1e6 + 0.5) / 1e6)], ["qid", "vec_id", "score"])

    return merge_ranked(both.select("qid", "vec_id", "embedding", "q").mapInArrow(exact, "qid long, vec_id long, score double"), k)
