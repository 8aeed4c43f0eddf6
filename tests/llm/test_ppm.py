import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import ppm


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_base_counts_and_both_ways(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in ppm.score_corpus(docs, order=3).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r, words = rows[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words), rel=1e-9)
        assert r.score < 0
    joined = {r.doc_id: r for r in ppm.score_corpus(docs, order=3, small_grams=0, per_shard=2000, group_bytes=50_000).collect()}
    for i in texts:
        assert joined[i].score == pytest.approx(rows[i].score, rel=1e-6)
        assert joined[i].base_score == pytest.approx(rows[i].base_score, rel=1e-9)
        assert (joined[i].n_tokens, joined[i].n_known) == (rows[i].n_tokens, rows[i].n_known)


def brute_log(trained, text, order):
    """PPM by sets: longest context first, escapes by method C, exclusion of what longer contexts have shown."""
    seen = {}
    for t in trained:
        s = [0] * order + [b + 1 for b in t] + [0]
        for i in range(order, len(s)):
            for k in range(order + 1):
                table = seen.setdefault(tuple(s[i - k : i]), Counter())
                table[s[i]] += 1
    out, s = 0.0, [0] * order + [b + 1 for b in text] + [0]
    for i in range(order, len(s)):
        excluded = set()
        for k in range(order, -1, -1):
            table = seen.get(tuple(s[i - k : i]))
            if table is None:
                continue
            free = {c: n for c, n in table.items() if c not in excluded}
            den = sum(free.values()) + len(free)
            if s[i] in free:
                out += math.log10(free[s[i]] / den)
                break
            if free:
                out += math.log10(len(free) / den)
            excluded |= set(table)
        else:
            out -= math.log10(ppm.SYMBOLS - len(excluded))
    return out


@pytest.mark.parametrize("order", [0, 1, 3])
def test_score_equals_brute_force_and_sums_to_one(order):
    trained = [b"abracadabra", b"abc abd", b"", "né à".encode()]
    parts = list(ppm._count(iter(trained), order))
    keys, n = next((k, c) for kind, k, c in parts if kind == ppm.GRAM)
    model = ppm.Model(keys, n, order)
    for text in (b"abra", b"zzz", b"", b"cadab abd", bytes(range(200, 256))):
        grams, _ = ppm._grams([(0, b"", text, True)], order)
        assert model.score(grams).sum() == pytest.approx(brute_log(trained, text, order), abs=1e-4)
    for context in np.unique(grams // np.uint64(257)):
        every = context * np.uint64(257) + np.arange(257, dtype=np.uint64)
        assert (10 ** model.score(every)).sum() == pytest.approx(1, abs=1e-5)


def test_long_texts_in_pieces(monkeypatch):
    text = ("some words of a long text\n" * 40 + "x" * 300 + " end").encode()
    whole = list(ppm._pieces(iter([text])))
    grams, tokens_ = ppm._grams(whole[0], 3)[0], ppm._words(whole[0], ppm._powers())[0]
    monkeypatch.setattr(ppm, "PIECE", 64)
    parts = list(ppm._pieces(iter([text])))
    assert len(parts) > 5
    assert np.array_equal(np.concatenate([ppm._grams(p, 3)[0] for p in parts]), grams)
    assert np.array_equal(np.concatenate([ppm._words(p, ppm._powers())[0] for p in parts]), tokens_)


def test_adaptive_learns():
    once, twice = ppm.adaptive_score("abcdefgh " * 5), ppm.adaptive_score("abcdefgh " * 10)
    assert twice > 2 * once and ppm.adaptive_score(None) == pytest.approx(-math.log10(257))


def test_odd_and_empty(odd_docs, no_docs):
    rows = ppm.score_corpus(odd_docs, order=2).collect()
    assert len(rows) == odd_docs.count()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert ppm.score_corpus(no_docs).count() == 0
    from pyspark.sql import functions as F

    held = ppm.score_corpus(odd_docs, held_out=F.lit(True)).collect()
    empty = next(r for r in held if r.doc_id == 3)
    assert empty.train_tokens == 0 and empty.score == pytest.approx(-math.log10(257))
