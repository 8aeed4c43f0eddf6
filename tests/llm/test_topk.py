import math
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import topk


def brute(rows, k=5):
    sane = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in sane:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in sane if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(want)


@pytest.mark.parametrize("options", [{}, {"chunk": 3, "seeds": 4, "block": 7, "lead": 2}, {"chunk": 2, "small": 0}])
def test_equals_brute_force(spark, sf, options):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, **options).collect())
    assert got == brute([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_ties_odd_and_empty(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (250, [1.0, None]), (300, [float("nan"), 1.0]), (350, [float("inf")]), (400, []), (None, [1.0]), (450, [1.0, 1.0]), (500, [0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as comps", "'x' as norm2", "2 as v")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors).collect())
    assert got == brute(rows)
    assert topk.top_k(vectors.filter("false")).count() == 0
    short = [(50, [-1.0, 2.0]), (1, []), (2, [1.0, -8.0]), (100, [])]
    for some in (short, short[1::2]):
        mixed = spark.createDataFrame(some, "vec_id long, embedding array<float>")
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(mixed).collect()) == brute(some)
    assert topk.top_k(vectors.filter("vec_id = 0")).count() == 0
    assert sorted((r.vec_id, r["rank"]) for r in topk.top_k(vectors.filter("vec_id in (0, 1, 2)")).collect() if r.query_id == 0) != []


def test_task_of_several_sorted_files(spark, monkeypatch):
    """A task that reads shorter vectors' file before a longer ones' scores both."""
    rng = random.Random(4)
    rows = [(i, [2.0 ** (i % 40 / 4) * rng.gauss(0, 1) for _ in range(8)]) for i in range(1, 1201)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def in_one_task(df, name="table", write=topk.materialize):
        held = write(df, name)
        return write(held.repartitionByRange(8, "norm2").sortWithinPartitions(F.desc("norm2")).coalesce(1), name) if name == "vectors" else held

    monkeypatch.setattr(topk, "materialize", in_one_task)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, seeds=200, block=16).collect())
    assert got == brute(rows)


def test_scores_beyond_doubles_are_exact(spark):
    """Large components whose scores differ in their last digits only."""
    rng = random.Random(9)
    rows = [(i, [1_000_003.0 + rng.randint(-3, 3) / 256 for _ in range(64)]) for i in range(1, 400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, block=32).collect())
    assert got == brute(rows) and got[0][3] > 2**61
