"""Exact top-k inner products over norm-sorted vectors.

Vectors are quantised to integers and range-partitioned by descending length.  The
Gram matrix of all vectors gives, by its eigenvectors, the rotation that puts most of
a product into the first few coordinates.  Every partition is walked in blocks, each
mostly from its longest vector down.  A query skips a block if its length times the block's
greatest length is below the query's k-th best score so far (Cauchy-Schwarz); for the
others the product of the first rotated coordinates plus the product of the residual
lengths bounds each score, and only vectors whose bound reaches the k-th best are
scored, exactly, on the integers.  Thresholds start from the globally longest vectors.

Scale: queries and vectors are packed into blocks of bounded size, one row each.  Vectors are many and queries few, so vectors move
once, into lanes of about ``lane_blocks`` blocks, and query blocks are sent to them: a small table of the lanes' greatest lengths
tells which lanes a query block can matter to at all.  All is one plan whatever the number of queries.  A lane
gives at most k rows a query, which are shuffled again.  The Gram
matrix is dimension squared for each partition.

Defined cases: vectors that are null or hold null or non-finite components take
no part; a shorter vector counts as padded with zeros, so one without components has product 0 with all; ties go to the smaller id;
candidates of the query's own id are left out; rows with a null id take no part; rows
that repeat an id are each a candidate; exact repeats of a query count once, and
different queries of one id are ranked together.  Components and scores must fit a long;
scores are exact, also beyond what a double holds.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import materialize

#: Bounds are floating-point: half a unit and this share of the lengths' product are slack enough.
_SLACK, _SHARE = 0.5, 1e-12
#: Products of lengths below are exact in floating-point.
_EXACT = 2.0**52


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """List column as rows of integers, zero-padded to d."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), d), np.int64)
    if len(flat):
        rows = np.repeat(np.arange(len(column)), sizes)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[rows, np.arange(len(flat)) - starts] = flat
    return out


def quantise(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, comps (integers), norm2, of the vectors that take part."""
    x = F.col("v")
    sane = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(sane)
        .select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("comps"))
        .withColumn("norm2", F.aggregate("comps", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    )


def _rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthogonal d x d; its first columns carry the most of the vectors' energy."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch.column(0), d).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    parts = vectors.select("comps").mapInArrow(gram, "g array<double>")
    summed = parts.select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    total = np.zeros(d * d)
    for r in summed:
        total[r.pos] = r.s
    return np.linalg.eigh(total.reshape(d, d))[1][:, ::-1].copy()


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    best = np.lexsort((ids, -scores))[:k]
    return scores[best], ids[best]


def _blocks(rows: DataFrame, size: int, d: int) -> DataFrame:
    """ids, comps (flat): every ``size`` rows of a partition, in their order, as one row; long vectors in fewer."""
    size = max(1, min(size, (1 << 21) // d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(n: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            part, rest = table.slice(0, n), table.slice(n)
            held[:] = [b for b in rest.to_batches() if len(b)]
            comps = _matrix(part.column(1).combine_chunks(), d).ravel()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (part.column(0).to_numpy(), comps)]
            return pa.RecordBatch.from_arrays(lists, ["ids", "comps"])

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= size:
                yield packed(size)
        if sum(map(len, held)):
            yield packed(sum(map(len, held)))

    return rows.select("vec_id", "comps").mapInArrow(run, "ids array<long>, comps array<long>")


def _lengths(comps: np.ndarray) -> np.ndarray:
    return np.sqrt((comps.astype(float) ** 2).sum(axis=1))


def _starts(ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seed: np.ndarray, k: int) -> np.ndarray:
    """For each query a lower bound of its k-th best score, from the seeds."""
    start = np.full(len(ids), -np.inf)
    products, q_len, most = q.astype(float) @ seed.astype(float).T, _lengths(q), max(_lengths(seed), default=0.0)
    for i in range(len(ids)):
        scores = products[i][seed_ids != ids[i]]
        if len(scores) >= k:
            start[i] = np.partition(scores, -k)[-k] - _SHARE * q_len[i] * most
    return start


class _Search:
    """The k best of each query of a block, over one block of vectors after the other."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, start: np.ndarray, rotation: np.ndarray, k: int, lead: int):
        self.ids, self.q, self.k, self.lead, self.rotation = ids, q, k, lead, rotation
        turned = q @ rotation
        self.head, self.length, self.rest = turned[:, :lead], _lengths(q), np.sqrt((turned[:, lead:] ** 2).sum(axis=1))
        self.floor = start.copy()
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def look(self, ids: np.ndarray, v: np.ndarray) -> None:
        length = _lengths(v)
        slack = _SLACK + _SHARE * self.length * length.max()
        open_ = np.flatnonzero(self.length * length.max() >= self.floor - slack)
        if not len(open_):
            return
        w = v @ self.rotation
        rest = np.sqrt((w[:, self.lead :] ** 2).sum(axis=1))
        bound = self.head[open_] @ w[:, : self.lead].T + np.outer(self.rest[open_], rest)
        real = v.astype(float) if self.length.max() * length.max() < _EXACT else v
        for i, row in zip(open_, bound >= (self.floor - slack)[open_, None], strict=True):
            hit = np.flatnonzero(row & (ids != self.ids[i]))
            if len(hit):
                scores = (real[hit] @ self.q[i]).astype(np.int64)
                self.best[i] = _top(np.concatenate([self.best[i][0], scores]), np.concatenate([self.best[i][1], ids[hit]]), self.k)
                if len(self.best[i][0]) == self.k:
                    self.floor[i] = max(self.floor[i], float(self.best[i][0][-1]))


def _ints(array: pa.Array) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False)


def top_k(
    vectors: DataFrame, queries: DataFrame | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 50, k: int = 5,
    scale: int = 256, lead: int = 16, chunk: int = 1024, seeds: int = 2048, block: int = 1024, lane_blocks: int = 16, small: int = 1_000_000,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    ``queries`` are rows like ``vectors``; by default those whose id is divisible by ``query_every``.
    They are packed ``chunk`` and the vectors ``block`` to a row.  The table of query blocks'
    thresholds (two numbers each) is broadcast if it has at most ``small`` rows.
    """
    spark = vectors.sparkSession
    read = lambda x: quantise(x, id_col=id_col, vector_col=vector_col, scale=scale)
    ranked = materialize(read(vectors).repartitionByRange(F.desc("norm2"), F.col("vec_id")).sortWithinPartitions(F.desc("norm2"), "vec_id"), "vectors")
    asked = materialize((ranked.filter(F.col("vec_id") % query_every == 0).drop("norm2") if queries is None else read(queries).drop("norm2")).distinct(), "queries")
    facts = ranked.unionByName(asked.withColumn("norm2", F.lit(0.0))).agg(F.max(F.size("comps"))).first()[0]
    if facts is None or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = max(1, int(facts))
    lead = min(lead, d)
    longest = ranked.orderBy(F.desc("norm2"), "vec_id").limit(seeds).select("vec_id", "comps").toArrow().combine_chunks()
    held = spark.sparkContext.broadcast((_rotation(ranked, d), longest.column(0).to_numpy(), _matrix(longest.column(1).combine_chunks(), d)))

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, seed_ids, seed = held.value
        for batch in batches:
            for n in range(len(batch)):
                part = batch.slice(n, 1)
                ids, q = _ints(part.column(0)), _ints(part.column(1)).reshape(-1, d)
                start = _starts(ids, q, seed_ids, seed, k)
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.ListArray.from_arrays(pa.array([0, len(start)], pa.int32()), pa.array(start, pa.float64())),
                    pa.array([float(_lengths(q).max())]), pa.array([float(start.min())]),
                ], ["ids", "comps", "start", "longest", "least"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                part = batch.slice(n, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([float(_lengths(_ints(part.column(1)).reshape(-1, d)).max())])], ["ids", "comps", "reach"])

    # Queries of like length share a block, so that the short ones are done with early.
    near = asked.withColumn("norm2", F.aggregate("comps", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    near = near.repartitionByRange(F.desc("norm2"), F.col("vec_id")).sortWithinPartitions(F.desc("norm2"), "vec_id")
    groups = _blocks(near, chunk, d).mapInArrow(started, "ids array<long>, comps array<long>, start array<double>, longest double, least double")
    groups = materialize(groups.withColumn("group", F.monotonically_increasing_id()), "groups")
    dealt = materialize(_blocks(ranked, block, d).mapInArrow(measured, "ids array<long>, comps array<long>, reach double"), "blocks")

    n_blocks = dealt.count()
    lanes = max(1 + n_blocks // lane_blocks, min(n_blocks, spark.sparkContext.defaultParallelism))
    dealt = dealt.withColumn("lane", F.pmod(F.hash("ids"), F.lit(lanes)))
    # Which lanes a query block can matter to: by Cauchy-Schwarz, from the longest vector and query.
    limits = dealt.groupBy("lane").agg(F.max("reach").alias("most"))
    limits = F.broadcast(limits) if lanes <= small else limits
    sent = groups.join(limits, F.col("longest") * F.col("most") * (1 + _SHARE) + _SLACK >= F.col("least")).select("lane", F.lit(None).cast("double").alias("reach"), F.lit(1).alias("side"), "ids", "comps", "start")
    both = dealt.select("lane", "reach", F.lit(0).alias("side"), "ids", "comps", F.lit(None).cast("array<double>").alias("start")).unionByName(sent)
    # A lane's vectors come first, from the longest down, then the queries.
    both = both.repartition("lane").sortWithinPartitions("lane", "side", F.desc("reach"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, lane, vectors = held.value[0], None, []
        for batch in batches:
            for n in range(len(batch)):
                part = batch.slice(n, 1)
                if part.column(0)[0].as_py() != lane:
                    lane, vectors = part.column(0)[0].as_py(), []
                ids, comps = _ints(part.column(3)), _ints(part.column(4)).reshape(-1, d)
                if part.column(2)[0].as_py() == 0:
                    vectors.append((ids, comps))
                    continue
                search = _Search(ids, comps, _ints(part.column(5)), rotation, k, lead)
                for block in vectors:
                    search.look(*block)
                own = np.repeat(search.ids, [len(b[0]) for b in search.best])
                scores, hits = (np.concatenate([b[j] for b in search.best]) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(hits), pa.array(scores)], ["query_id", "vec_id", "score"])

    hits = both.select("lane", "reach", "side", "ids", "comps", "start").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
