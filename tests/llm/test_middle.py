import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import middle, queries


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, mid, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return len(tokens), "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def check(docs):
    found = middle.transform(docs).withColumn("restored", middle.restore(F.col("output"), F.col("form"))).collect()
    rows = docs.select("doc_id", "text").collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(r)[:6] for r in found), key=key) == sorted(((r.doc_id, *brute(r.doc_id, r.text)) for r in rows), key=key)
    assert sorted(r.restored for r in found) == sorted(r.text or "" for r in rows)
    return found


def test_equals_brute_force(spark, sf):
    found = check(spark.read.parquet(f"{sf}/documents.parquet"))
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_odd_and_empty(odd_docs, no_docs):
    check(odd_docs)
    assert middle.transform(no_docs).count() == 0


def test_marks_and_borders(spark):
    texts = ["a<P>b", "<S>", "x <M", "<<P", "P>S>", "<", ">", "é<S", "漢字 abcé\U0001f600def", "aZ[`{@", "\n\r\x00\t", "a" * 200, " " * 129, "ab " * 100]
    check(spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "doc_id long, text string"))


def test_long_text_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(middle, "PIECE", 50)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab é漢 \n.") for _ in range(rng.randrange(120)))) for i in range(300)]
    check(spark.createDataFrame([*rows, (1000, "wörd " * 400_000)], "doc_id long, text string"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=1500))
def test_rank_and_select(bits):
    marks = middle.Marks(np.array(bits, bool))
    where = np.flatnonzero(bits)
    assert marks.total == len(where)
    assert marks.select(np.arange(len(where))).tolist() == where.tolist()
    assert marks.rank(np.arange(len(bits) + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()


def test_query_digests(spark, sf):
    rows = {r.doc_id: r for r in queries.op13_fill_in_middle(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = brute(r.doc_id, r.text)
        assert rows[r.doc_id].output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
        assert rows[r.doc_id].restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
