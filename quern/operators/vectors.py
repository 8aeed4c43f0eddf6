"""Exact cosine search over vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import materialize


def unit_rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of unit length; zeros stay."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms > 0, norms, 1)


def merge_ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties to the smaller id, with their rank from 0."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("qid", (F.col("n") - 1).alias("rank"), "vec_id", "score")


def _best(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """The top k of each query of a block, ties to the smaller id; scores quantised to six decimals."""
    scores = np.floor(scores * 1e6 + 0.5) / 1e6
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(qids, order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(scores, order, axis=1).ravel())], ["qid", "vec_id", "score"])


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """ids, unit (flat, of unit length): up to ``size`` rows of (id, embedding) as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in ((part.column(0).to_numpy(), pa.int64()), (unit_rows(part.column(1)).ravel(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(lists, ["ids", "unit"])

    return rows.mapInArrow(run, "ids array<long>, unit array<double>")


def _unpacked(batch: pa.RecordBatch, at: int, columns: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    ids, flat = (batch.column(c).slice(at, 1).flatten().to_numpy(zero_copy_only=False) for c in columns)
    return ids, flat.reshape(len(ids), -1)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, chunk: int = 4096, block: int = 1024) -> DataFrame:
    """qid, rank, vec_id, score of ``vectors(vec_id, embedding)`` for ``queries(qid, embedding)``.

    Up to ``chunk`` queries are sent to where the vectors are, and each task returns k rows a
    query.  More are packed ``chunk`` to a row and the vectors ``block`` to a row, and a shuffle
    brings every block of vectors to every block of queries, in one plan.
    """
    held = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    asked = queries.filter("qid is not null and embedding is not null").select("qid", "embedding")
    schema = "qid long, vec_id long, score double"
    if asked.count() <= chunk:
        rows = asked.toArrow().combine_chunks()
        few = (rows.column(0).to_numpy(), unit_rows(rows.column(1).combine_chunks()) if rows.num_rows else np.zeros((0, 0)))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch) and len(few[0]):
                    yield _best(few[0], batch.column(0).to_numpy(), few[1] @ unit_rows(batch.column(1)).T, k)

        return merge_ranked(held.mapInArrow(near, schema), k)
    groups = materialize(_packed(asked.repartition(max(1, -(-asked.count() // chunk)), "qid"), chunk).withColumn("group", F.monotonically_increasing_id()), "groups")
    pairs = materialize(_packed(held, block), "blocks").join(groups.select("group", F.col("ids").alias("qids"), F.col("unit").alias("q")).hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                (ids, v), (qids, q) = _unpacked(batch, at, (0, 1)), _unpacked(batch, at, (2, 3))
                yield _best(qids, ids, q @ v.T, k)

    return merge_ranked(pairs.select("ids", "unit", "qids", "q").mapInArrow(run, schema), k)
