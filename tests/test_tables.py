"""Inserts in batches, walks over the graph, and terms in labels."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import graph
from quern.sources import sinks


def test_any_split_is_one_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice("ab"), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, kind string, at int")
    want = sorted({(k, kind): at for k, kind, at in reversed(rows)}.items(), key=str)
    for n, cuts in enumerate(([], [50, 51], [10, 290])):
        table = sinks.FirstWins(spark, str(tmp_path / f"t{n}"), ("k", "kind"), 8)
        assert table.read() is None
        edges = [0, *cuts, 300]
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            assert table.insert(df.filter((F.col("at") >= a) & (F.col("at") < b)), f"batch {i}", "at")
        assert not table.insert(df, "batch 0", "at")
        assert sorted((((r.k, r.kind), r["at"]) for r in table.read().collect()), key=str) == want


def test_a_crash_before_the_ledger_leaves_the_table(spark, tmp_path):
    table = sinks.FirstWins(spark, str(tmp_path / "t"), ("k",), 4)
    rows = lambda *x: spark.createDataFrame([(i, v) for i, v in x], "k int, v string")
    table.insert(rows((1, "a"), (2, "b")), "one", "v")
    table.write(rows((3, "lost"), (1, "no")), "stray", "v")  # the data are there, the ledger has no line
    assert {tuple(r) for r in table.read().collect()} == {(1, "a"), (2, "b")}
    table.insert(rows((3, "c"), (1, "no")), "two", "v")
    assert {tuple(r) for r in table.read().collect()} == {(1, "a"), (2, "b"), (3, "c")}
    table.insert(rows().limit(0), "none", "v")
    assert table.read().count() == 3 and table.ledger().count() == 3


def walk(seeds, edges, hops, relations, degree, both):
    links = set()
    for s, d, r, o in edges:
        links |= {(s, d, r, o)} | ({(d, s, r, o)} if both else set())
    best = {}
    for s, d, r, o in links:
        best[s, d, r] = min(o, best.get((s, d, r), o))
    place = lambda r: relations.index(r) if r in relations else len(relations)
    out = {}
    for (s, d, r), o in best.items():
        out.setdefault(s, []).append((place(r), o, d, r))
    found = {}
    for q, s in seeds:
        found[q, s] = (0, None, None)
    for hop in range(1, hops + 1):
        fresh = {}
        for (q, n), (h, *_) in found.items():
            if h == hop - 1:
                for p, _, d, r in sorted(out.get(n, []))[:degree]:
                    if (q, d) not in found:
                        fresh[q, d] = min(fresh.get((q, d), (p, n, r)), (p, n, r))
        found |= {k: (hop, n, r) for k, (_, n, r) in fresh.items()}
    return {(*k, *v) for k, v in found.items()}


@pytest.mark.parametrize("hops, relations, degree, both", [(2, (), None, False), (4, ("x", "z"), None, True), (3, ("z",), 2, False)])
def test_paths(spark, hops, relations, degree, both):
    rng = random.Random(hops)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice("xyz"), i) for i in range(60)]
    seeds = [(1, "n0"), (1, "n3"), (2, "n7"), (3, "lonely")]
    got = graph.paths(spark.createDataFrame(seeds, "qid long, node_id string"), spark.createDataFrame(edges, "src string, dst string, rel string, ord long"), hops, relations=relations, degree=degree, both_ways=both)
    assert {tuple(r) for r in got.collect()} == walk(seeds, edges, hops, relations, degree, both) and got.columns == ["qid", "node_id", "hops", "parent", "rel"]


@pytest.mark.parametrize("chunk", [2, 1000])
def test_terms_in_labels(spark, chunk):
    rng = random.Random(1)
    labels = ["".join(rng.choice("abc é") for _ in range(rng.randrange(30))) for _ in range(200)] + [None]
    terms = ["".join(rng.choice("abc é") for _ in range(rng.randrange(1, 4))) for _ in range(12)] + ["", None]
    got = graph.terms_in(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in terms], "term string"), chunk)
    assert sorted(map(tuple, got.collect())) == sorted((x, t) for x in set(labels) if x for t in set(terms) if t and t in x)
