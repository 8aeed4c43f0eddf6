import re

from quern.llm import decontaminate


def shingles(text, width=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    if not w:
        return set()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_equals_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    edited = items.selectExpr("item_id + 1000 as item_id", "regexp_replace(text, ' the ', ' zz ') as text")
    every = items.unionByName(edited)
    got = {(r.item_id, r.doc_id): (r.n_shingles, r.n_shared) for r in decontaminate.contaminated_pairs(docs, every).collect()}
    want = {}
    d = {r.doc_id: shingles(r.text) for r in docs.collect()}
    for i in every.collect():
        s = shingles(i.text)
        for doc, t in d.items():
            if s and len(s & t) >= 0.8 * len(s):
                want[i.item_id, doc] = (len(s), len(s & t))
    assert got == want and want
    shuffled = {(r.item_id, r.doc_id) for r in decontaminate.contaminated_pairs(docs, every, small_rows=0, small_chars=0).collect()}
    assert shuffled == set(want)
    kept = decontaminate.decontaminate(docs, every)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(d) - {doc for _, doc in want}


def test_odd_and_empty(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta"), (None, "One"), (3, None), (4, ""), (1, "beta gamma delta epsilon zeta eta")], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in decontaminate.contaminated_pairs(odd_docs, items).collect()}
    assert got == {(1, 1), (1, 5), (None, 9)}
    assert decontaminate.decontaminate(odd_docs, items).count() == odd_docs.count() - 4
    assert decontaminate.contaminated_pairs(no_docs, items).count() == 0
    assert decontaminate.contaminated_pairs(odd_docs, items.filter("false")).count() == 0
