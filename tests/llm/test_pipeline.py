import corpus_pipeline
from quern.llm import decontaminate, toxicity
from tests.llm.test_decontaminate import shingles
from tests.llm.test_simhash import brute_fingerprint, components


def word_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a) and len(a & b) >= 0.8 * len(a | b)


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "decontaminate", "mix"]
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    held = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held[-1], sf).cache()
        assert out.columns == docs.columns
        held.append(out)
    ids = [{r.doc_id for r in d.collect()} for d in held]
    bad = {r.doc_id for r in toxicity.classify(docs, labels).filter("predicted = 1").collect()}
    assert ids[1] == ids[0] - bad
    fps = {r.doc_id: brute_fingerprint(r.text) for r in held[2].collect()}
    sets = {r.doc_id: word_shingles(r.text) for r in held[2].collect()}
    by_bits = set(components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4).values())
    by_both = set(components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4 or similar(sets[a], sets[b])).values())
    assert by_both <= ids[3] <= by_bits
    tests = [shingles(r.text) for r in items.collect()]
    leaky = {r.doc_id for r in held[3].collect() if any(s and len(s & shingles(r.text)) >= 0.8 * len(s) for s in tests)}
    assert ids[4] == ids[3] - leaky
    mixed = corpus_pipeline.STAGES[-1][1](spark, held[-1], sf)
    assert {r.doc_id for r in mixed.collect()} == ids[4]
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, ran.collect())) == sorted(map(str, mixed.collect()))
    assert decontaminate.contaminated_pairs(held[4], items).count() == 0


def test_near_copies_are_found(spark):
    """Recall of texts of a Jaccard similarity of 0.8 or more against brute force, over all documents of sf0.01 and of edited copies."""
    import random

    from quern.llm import simhash

    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    for i, text in list(rows)[::3]:
        words = (text or "").split()
        if 40 <= len(words) <= 2000:
            for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
                words[at] = f"edit{rng.randrange(10**6)}"
            rows.append((100_000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.k: r.text for r in docs.selectExpr("xxhash64(coalesce(text, '')) as k", "text").distinct().collect()}
    sets = {k: word_shingles(t) for k, t in keys.items() if len((t or "").split()) >= 5}
    holders: dict = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    met = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    want = {(a, b) for a, b in met if similar(sets[a], sets[b])}
    got = {tuple(sorted((r.a, r.b))) for r in simhash.similar_texts(docs).collect()}
    print("near copies", len(want), "found", len(want & got))
    assert len(want) > 150 and got <= want and len(want & got) >= 0.95 * len(want)


def test_empty_documents(spark, sf, tmp_path):
    import os

    for t in ("labels", "benchmark"):
        os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
