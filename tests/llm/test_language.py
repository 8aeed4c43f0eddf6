import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language, queries


def plain_grams(text):
    """Grams of 1 to 3 characters of the lower-case letters between single blanks, counted."""
    kept = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    kept = f" {kept} "
    return Counter(kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1))


def bucket_of(gram, buckets):
    key = 0
    for c in gram:
        key = (key * 0x9E3779B1 + ord(c)) % (1 << 32)
    key = (key + len(gram)) % (1 << 32)
    key ^= key >> 15
    return (key * 0x85EBCA6B) % (1 << 32) >> (33 - buckets.bit_length())


def brute(rows, buckets, smooth=0.5, margin=1.0):
    """doc_id -> (language, score, runner-up, ambiguous), by dictionaries."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    hashed = lambda t: Counter({b: 0 for b in ()}) + sum((Counter({bucket_of(g, buckets): n}) for g, n in plain_grams(t).items()), Counter())
    sane = lambda t: bool(t) and any(c.isalpha() for c in t)
    learnt = [(lang, hashed(t)) for i, t, lang in rows if fold(i) and lang is not None and sane(t)]
    languages = sorted({x for x, _ in learnt})
    code = [[1 if (split >> k) & 1 else -1 for split in range(1, 1 << (len(languages) - 1))] for k in range(len(languages))]
    total = {x: sum((c for y, c in learnt if x == y), Counter()) for x in languages}
    share = {x: lambda b, x=x: (total[x][b] + smooth) / (sum(total[x].values()) + smooth * buckets) for x in languages}

    def margins(counts):
        out = []
        for bit in range(len(code[0])):
            sides = [[x for x, word in zip(languages, code, strict=True) if word[bit] == s] for s in (1, -1)]
            weigh = lambda b, sides=sides: math.log((sum(share[x](b) for x in sides[0]) / len(sides[0])) / (sum(share[x](b) for x in sides[1]) / len(sides[1])))
            out.append(sum(n * weigh(b) for b, n in counts.items()) / math.sqrt(sum(counts.values())))
        return out

    trust = []
    for x, word in zip(languages, code, strict=True):
        own = [margins(c) for y, c in learnt if x == y]
        right = [(sum((1 if m[b] > 0 else -1) == word[b] for m in own) + 1) / (len(own) + 2) for b in range(len(word))]
        trust.append([r * len(right) / sum(right) for r in right])
    found = []
    for i, t, _ in rows:
        if not sane(t):
            found.append((i, "und", 0.0, None, False))
            continue
        m = margins(hashed(t))
        loss = sorted((sum(w * math.log1p(math.exp(-c * z)) for w, c, z in zip(ws, word, m, strict=True)), k) for k, (ws, word) in enumerate(zip(trust, code, strict=True)))
        wrong = sum((1 if z > 0 else -1) != c for z, c in zip(m, code[loss[0][1]], strict=True))
        nearest = min(sum(a != b for a, b in zip(code[x], code[y], strict=True)) for x in range(len(code)) for y in range(x))
        ambiguous = loss[1][0] - loss[0][0] < margin or wrong > (nearest - 1) // 2
        found.append((i, languages[loss[0][1]], 1 / sum(math.exp(loss[0][0] - x) for x, _ in loss), languages[loss[1][1]], ambiguous))
    return found


TEXTS = {
    "en": "the cat sat on the mat and then it ran to the other house", "de": "der hund lief über die straße und schlief dann im großen haus",
    "es": "el niño corrió por la calle y después durmió en la casa", "fr": "le garçon a couru dans la rue et il a dormi à la maison",
}


def small_rows():
    rows = []
    for k, (lang, text) in enumerate(TEXTS.items()):
        words = text.split()
        rows += [(100 * k + i, " ".join(words[i % 5 :: 2] + words[: i % 4 + 2]) + "!? 12", lang) for i in range(12)]
    return rows + [(900, "the und la", None), (901, None, "en"), (902, "123 \n!", "de"), (903, "漢字", None), (904, "A", "en"), (None, "die straße", "de")]


def test_equals_brute_force(spark):
    rows = small_rows()
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=1 << 10).collect()
    want = {r[0]: r[1:] for r in brute(rows, 1 << 10)}
    assert len(got) == len(rows)
    for r in got:
        lang, score, second, ambiguous = want[r.doc_id]
        assert (r.lang_pred, r.runner_up, r.ambiguous) == (lang, second, ambiguous), r
        assert r.score == pytest.approx(score, rel=1e-9)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)


def test_grams_equal_plain_ones():
    texts = ["hello, world", " x ", "a  b--c", "é漢\U0001f600z", "\tmixed 12 up\n"]
    which, owners = language.grams(texts, 1 << 12)
    for i, t in enumerate(texts):
        assert Counter(which[owners == i].tolist()) == sum((Counter({bucket_of(g, 1 << 12): n}) for g, n in plain_grams(t).items()), Counter())


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op11_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_long_texts_are_read_whole(spark):
    model = language.train(spark.createDataFrame([(t, x) for x, t in TEXTS.items()], "text string, lang string").select("lang", "text"))
    text = TEXTS["en"] + " " + " ".join([TEXTS["fr"]] * 6000)  # several parts; the language is in what follows the first words
    margins, sane = model.margins([text, TEXTS["en"], None, "1"])
    first, _, _, _ = model.decode(margins)
    assert [model.languages[i] for i in first[:2]] == ["fr", "en"] and sane.tolist() == [True, True, False, False]
    assert np.all(margins[2:] == 0)


def test_odd_and_empty(spark, odd_docs, no_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (2, 3, 4))
    assert language.identify(no_docs).count() == 0
    unlabelled = language.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    single = language.identify(spark.createDataFrame([(1, "abc", "en"), (2, "xyz", "en"), (3, "", "en"), (4, "hä", None)], "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in single) == [(1, "en", 1.0), (2, "en", 1.0), (3, "und", 0.0), (4, "en", 1.0)]


def test_ambiguity(spark):
    model = language.train(spark.createDataFrame([(t, x) for x, t in TEXTS.items()], "text string, lang string").select("lang", "text"))
    margins, _ = model.margins([TEXTS["de"], "qxq"])
    assert model.decode(margins)[3].tolist() == [False, True]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6, 7, 40])
def test_codewords(n):
    code = language.codewords(n)
    assert len(code) == n
    if n > 1:
        assert language.distances(code).min() >= 1 and np.all(np.abs(code.sum(axis=0)) < n)
    if n > 6:
        assert language.distances(code).min() >= 5
