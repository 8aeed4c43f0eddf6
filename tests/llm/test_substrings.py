import random

import numpy as np
import pytest

from quern.llm import substrings


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    shared = passage(rng, 55)
    rows = []
    for i in range(40):
        body = passage(rng, rng.randint(80, 200))
        if i % 4 == 0:
            cut = rng.randint(0, len(body))
            body = body[:cut] + " " + shared + " " + body[cut:]
        rows.append((i, body))
    return spark.createDataFrame(rows, "doc_id long, text string"), shared


def test_planted_passages_are_found_and_clean_texts_left(planted):
    docs, shared = planted
    spans = substrings.repeated_spans(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in spans} == set(range(4, 40, 4))
    assert {r.first_doc_id for r in spans} == {0}
    for r in spans:
        assert texts[r.doc_id].encode()[r.start : r.stop].decode() in " " + shared + " "
    out = {r.doc_id: r.text for r in substrings.dedup_substrings(docs).collect()}
    assert all(out[i] == texts[i] for i in texts if i % 4 or i == 0)
    assert all(len(out[i]) < len(texts[i]) - 100 for i in range(4, 40, 4))


def test_boundaries_do_not_shift():
    rng = random.Random(1)
    text = passage(rng, 400).encode()
    data = np.frombuffer(text, np.uint8)
    moved = np.frombuffer(b"inserted words in front " + text, np.uint8)
    a, b = substrings.boundaries(data, 20), substrings.boundaries(moved, 20) - (len(moved) - len(data))
    assert len(set(a) - set(b)) <= 2
    assert a[-1] == len(data) and (np.diff(a) > 20)[:-1].all()


def test_gear_is_the_sum_of_shifted_words():
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog", np.uint8)
    h = substrings.gear(data)
    for i in range(len(data)):
        want = 0
        for back in range(min(substrings.WINDOW, i + 1)):
            want += int(substrings._GEAR[data[i - back]]) << (2 * back)
        assert int(h[i]) == want % (1 << 32)


def plain_chunks(raw, radius):
    """(start, stop) of the chunks by the definition: a chunk ends after a strict minimum of the hash among ``radius`` bytes to either side."""
    h = [sum(int(substrings._GEAR[raw[i - back]]) << (2 * back) for back in range(min(substrings.WINDOW, i + 1))) % (1 << 32) for i in range(len(raw))]
    around = lambda i: h[i - radius : i] + h[i + 1 : i + radius + 1]
    cuts = [i + 1 for i in range(radius, len(raw) - radius) if all(h[i] < x for x in around(i))]
    return list(zip([0, *cuts], [*cuts, len(raw)], strict=True)) if raw else []


def test_equals_brute_force(spark):
    """Documents of shared and own passages: the runs by the bytes of the chunks themselves, compared one by one."""
    rng = random.Random(12)
    shared = [passage(rng, n) for n in (4, 9, 15, 30, 55, 80)]
    texts = {}
    for i in range(60):
        parts = [passage(rng, rng.randint(1, 30)) for _ in range(4)] + [rng.choice(shared) for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        texts[i] = " ".join(parts)
    texts[60], texts[61], texts[62] = texts[7], "", None
    cut = {i: [(a, b, (t or "").encode()[a:b]) for a, b in plain_chunks((t or "").encode(), 20)] for i, t in texts.items()}
    owner = {}
    for i in sorted(cut):
        for k, (_, _, body) in enumerate(cut[i]):
            owner.setdefault(body, (i, k))
    want = set()
    for i, found in cut.items():
        run = []
        for k, (a, b, body) in [*enumerate(found), (None, (0, 0, None))]:
            if body is not None and owner[body] != (i, k):
                run.append((a, b, owner[body][0]))
            elif run:
                by = {}
                for x, y, o in run:
                    n, start = by.get(o, (0, x))
                    by[o] = (n + y - x, start)
                first = min(by, key=lambda o: (-by[o][0], by[o][1], o))
                if by[first][0] >= 100:
                    want.add((i, run[0][0], run[-1][1], len(run), first))
                run = []
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.start, r.stop, r.n_chunks, r.first_doc_id) for r in substrings.repeated_spans(docs).collect()}
    assert got == want and len(want) > 20


def test_odd_and_empty(odd_docs, no_docs):
    out = substrings.dedup_substrings(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    spans = substrings.repeated_spans(odd_docs).collect()
    assert {r.doc_id for r in spans} >= {7}
    kept = {(r.doc_id, r.lang): r.text for r in out.collect()}
    assert kept[2, None] is None and kept[3, "en"] == "" and kept[8, "xx"] == "ß ñ 漢字 \U0001f600 é"
    assert substrings.repeated_spans(no_docs).count() == 0 and substrings.dedup_substrings(no_docs).count() == 0
