import pytest
from pyspark.sql import functions as F

from quern.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Share, stop at the limit, share the rest again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(stopped.values())
        target = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | stopped
        stopped |= {s: most * sizes[s] for s in over}


def test_targets_and_takes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").when(F.col("doc_id") % 50 == 1, F.lit(None)).otherwise(F.col("source")))
    rows = mixing.mix(docs).documents.collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    expected = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 0.5 + 1e-6
    again = mixing.mix(docs.repartition(7)).documents
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_schedule_ranks_and_mixed_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = mixing.mix(docs, slot_run=100, bucket_rows=3)
    slots = m.schedule.orderBy("slot").collect()
    sources = {r.source: r for r in m.sources.collect()}
    assert len({s.slot for s in slots}) == len(slots) == sum(r.needed for r in sources.values())
    by_source = {}
    for s in slots:
        by_source.setdefault(s.source, []).append(s["rank"])
        assert s.epoch == s["rank"] * 256 // sources[s.source].source_size
    assert {k: sorted(v) for k, v in by_source.items()} == {k: list(range(r.needed)) for k, r in sources.items() if r.needed}
    # Any stretch of the schedule holds each source by its share, to a few slots.
    for k, r in sources.items():
        for n in (len(slots) // 3, len(slots) // 2):
            assert abs(sum(s.source == k for s in slots[:n]) - n * r.needed / len(slots)) <= 4
    mixed = m.mixed.collect()
    per_slot, per_doc = {}, {}
    for r in mixed:
        per_slot[r.slot] = per_slot.get(r.slot, 0) + r.n_words
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.n_words
    last = {r.source: r.needed - 1 for r in sources.values()}
    assert all(per_slot[s.slot] == 256 for s in slots if s["rank"] < last[s.source])
    assert {r.doc_id: r.taken for r in m.documents.collect() if r.taken} == per_doc


def test_sources_of_very_different_size(spark):
    rows = [(i, "w " * (1 + i % 700), "big") for i in range(3000)] + [(10_000, "one two three", "tiny"), (10_001, "", "none"), (10_002, "a b c d e", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.mix(docs)
    taken = {r.source: (r.taken, r.target) for r in m.documents.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert taken["tiny"] == (9, 9.0) and taken["small"] == (15, 15.0) and taken["none"] == (0, 0.0)
    assert abs(taken["big"][0] - taken["big"][1]) <= 0.5


def test_odd_and_empty(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).documents.collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: r.taken for r in rows if r["size"] == 0} == {2: 0, 3: 0, 4: 0}
    assert mixing.mix(no_docs).documents.count() == 0
