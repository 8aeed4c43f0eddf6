import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import postings, retrieval


@given(st.lists(st.integers(0, 2**40), max_size=200))
@settings(max_examples=60, deadline=None)
def test_bytes_round_trip(values):
    data, sizes = postings.to_bytes(np.array(values, np.int64))
    back, stops = postings.from_bytes(data)
    assert back.tolist() == values and stops.tolist() == np.cumsum(sizes).tolist()


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d", "漢"]), max_size=12), max_size=30))
@settings(max_examples=60, deadline=None)
def test_range_round_trip(docs):
    """Blocks decode to the counts, and their best pairs bound every part and are reached."""
    parts, dls = postings.encode_range(pa.array(docs, pa.list_(pa.string())))
    assert dls.tolist() == [len(d) for d in docs]
    want = {(t, i): c for i, d in enumerate(docs) for t, c in Counter(d).items()}
    part = lambda c, dl, avg: c / (c + 1.5 * (0.25 + 0.75 * dl / avg))
    got = {}
    for row in parts:
        assert {postings.part_of(t) for t in row["terms"]} == {row["part"]}
        stops = np.cumsum(row["sizes"])
        block, doc, tf = postings.decode([row["body"][e - s : e] for s, e in zip(row["sizes"], stops, strict=True)])
        got |= {(row["terms"][x], i): c for x, i, c in zip(block, doc, tf, strict=True)}
        assert np.bincount(block).tolist() == row["n"].tolist()
        ends = np.cumsum(row["tops"])
        for t, a, b in zip(row["terms"], ends - row["tops"], ends, strict=True):
            for avg in (1.0, 5.0, 80.0):
                assert max(part(c, x, avg) for c, x in zip(row["top_tf"][a:b], row["top_dl"][a:b], strict=True)) == max(part(c, len(docs[i]), avg) for (u, i), c in want.items() if u == t)
    assert got == want


def corpus(spark, n, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    rows = [(i * 3, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(1, 40)))) for i in range(n)]
    rows += [(9000, None), (9001, ""), (None, "word1 word2"), (9002, "rare gem word1"), (9003, "rare word50 word1"), (3, "word1 twice the id")]
    return spark.createDataFrame(rows, "doc_id long, content string")


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "word0 word7 word7 unknown"), (2, "rare gem word1"), (3, ""), (4, None), (5, "nothing here"), (6, " ".join(f"word{i}" for i in range(60))), (7, "word59 word58")]
    return spark.createDataFrame(rows, "qid long, text string")


def rows(found):
    return sorted(map(tuple, found.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark, 400).repartition(3).cache()


def index_of(spark, path, batches, **options):
    index = postings.TextIndex.create(spark, str(path))
    for batch in batches:
        index.append(batch, **options)
    return index


@pytest.mark.parametrize("options", [{}, {"docs_per_range": 7}])
def test_same_rows_as_the_texts(spark, tmp_path, docs, asked, options):
    index = index_of(spark, tmp_path / "i", [docs], **options)
    whole = rows(retrieval.bm25_topk(docs, asked, 10))
    assert rows(retrieval.bm25_topk(docs, asked, 10, index=index)) == rows(retrieval.bm25_topk(docs, asked, 10, index=index, limit=0)) == whole
    assert rows(retrieval.search_topk(docs, asked, 2, index=index)) == rows(retrieval.search_topk(docs, asked, 2))


def test_batches_add_up_and_unfinished_ones_do_not_count(spark, tmp_path, docs, asked):
    parts = [docs.filter("doc_id <= 200 or doc_id is null"), docs.filter("doc_id > 200 and doc_id < 800"), docs.filter("doc_id >= 800"), docs.filter("false")]
    index = index_of(spark, tmp_path / "i", parts, docs_per_range=16)
    whole = rows(retrieval.bm25_topk(docs, asked, 5))
    assert rows(retrieval.bm25_topk(docs, asked, 5, index=index)) == whole
    entries = spark.read.parquet(f"{index.path}/entries/batch={index._batches()[0]}")
    entries.write.parquet(f"{index.path}/entries/batch=stray")  # an append that failed before its batch was entered
    assert rows(retrieval.bm25_topk(docs, asked, 5, index=postings.TextIndex(spark, index.path, retrieval.ANALYSERS))) == whole


@pytest.mark.parametrize("floors_from", [0, 10**6])
def test_skipped_ranges_lose_nothing(spark, tmp_path, floors_from):
    """Most ranges hold only weak matches and are passed over; the rows are the same."""
    texts = [(i, "gold gold gold gold short" if i % 40 == 0 else "plain words and more of them " * 6 + "gold silver" * (i % 5 == 1)) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, content string").coalesce(1)
    asked = spark.createDataFrame([(1, "gold"), (2, "gold silver"), (3, "plain"), (4, "gold gold short")], "qid long, text string")
    index = index_of(spark, tmp_path / "i", [docs], docs_per_range=10)
    skipped = []
    got = rows(retrieval.top(index.best("space", asked, 3, floors_from=floors_from, skipped=skipped), 3, F.asc("doc_id")))
    assert got == rows(retrieval.top(retrieval.bm25_best(docs, asked, 3), 3, F.asc("doc_id")))
    assert floors_from or skipped[0].value > 50


def test_empty_index_and_no_queries(spark, tmp_path, docs, asked):
    index = index_of(spark, tmp_path / "i", [])
    assert retrieval.search_topk(docs, asked, 3, index=index).count() == 0
    index.append(docs.filter("false"))
    assert retrieval.search_topk(docs, asked, 3, index=index).count() == 0
    index.append(docs)
    assert retrieval.search_topk(docs, asked.filter("false"), 3, index=index).count() == 0
    assert retrieval.search_topk(docs, asked, 3, index=index).count() > 0
