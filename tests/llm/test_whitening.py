import math
import random

import numpy as np
import pytest

from quern.llm import queries, whitening


def brute(rows, k=16):
    """vec_id, x, and over the distinct x: n, S, eigenvalues, vectors and trace, by a dense covariance."""
    sane = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in sane), default=0)
    xs = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in sane if len(v) == d]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return xs, n, sums, e[::-1][:k], u[:, ::-1][:, :k], e.sum()


def check(got, rows, tolerance=1e-8):
    xs, n, sums, e, u, trace = brute(rows)
    kept = int((e > e[0] * 1e-12).sum())
    assert len(got) == len(xs) * kept
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, x in xs:
        off = [n * c - s for c, s in zip(x, sums, strict=True)]
        mine = by_row[i, sum(c * c for c in off)]
        assert sorted(mine) == list(range(1, kept + 1))
        want = np.array(off) / n @ u / np.sqrt(e)
        for c, found in mine.items():
            r = found[0]
            assert (r.n, r.explained) == (n, pytest.approx(e[c - 1] / trace, rel=1e-9)) and r.identity_error < 1e-8
            if abs(want[c - 1]) > 1e-3:
                signs.setdefault(c, set()).add(round(r.whitened / want[c - 1], 5))
            assert abs(r.whitened) == pytest.approx(abs(want[c - 1]), abs=tolerance)
    assert all(s in ({1.0}, {-1.0}) for s in signs.values())


def test_query_equals_dense_covariance(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(queries.op12_whitening(spark, sf).collect(), [(r.vec_id, r.embedding) for r in vectors.collect()])


def made(n=600, d=40, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, d)) * 0.9 ** np.arange(d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return [(i, [float(c) for c in v]) for i, v in enumerate(m)]


def test_narrow_blocks_iterate_until_certified(spark):
    rows = made()
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = whitening.fit(vectors, k=4, extra=16, patience=40)
    assert len(model.blocks) > 2 and set(model.blocks) == {20}
    assert model.residuals.max() <= 1e-12 * model.eigenvalues[0] and model.identity_error < 1e-9
    _, _, _, e, u, trace = brute(rows, 4)
    assert model.eigenvalues == pytest.approx(e, rel=1e-10) and model.trace == pytest.approx(trace)
    assert np.abs(np.abs((u * model.components).sum(axis=0)) - 1).max() < 1e-10


def test_stuck_blocks_widen(spark):
    rows = made(200, 24, 8)
    model = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=6, extra=0, patience=2)
    assert model.blocks == [6, 6, 12, 12, 24]
    assert model.eigenvalues == pytest.approx(brute(rows, 6)[3], rel=1e-10)


def test_odd_copies_and_empty(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.25, 2.0]) for _ in range(5)]) for i in range(60)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0])] + [(700, [0.5] * 5)] * 300 + [(900 + i, [9.0, 0.0, 0.0, 0.0, 0.0]) for i in range(3)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, []), (105, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "'a' as v", "2 as n", "3 as cell", "4 as whitened", "5 as deviation")
    check(whitening.components(vectors).collect(), rows)
    assert whitening.components(vectors.filter("false")).count() == 0
    assert whitening.components(vectors.filter("vec_id in (700, 100)")).count() == 0
    flat = whitening.components(vectors.filter("vec_id >= 900 or vec_id = 700")).collect()  # two distinct vectors: one component
    assert {(r.component, r.n) for r in flat} == {(1, 2)} and sorted({round(abs(r.whitened), 9) for r in flat}) == [1.0]


def test_deviations_beyond_longs(spark):
    rows = [(1, [2.0**30, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0**20, 3.0])]
    got = {r.vec_id: r.deviation for r in whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    xs, n, sums, *_ = brute(rows)
    for i, x in xs:
        exact = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        assert got[i] == (exact if exact < 1 << 63 else None)
    assert None in got.values()
