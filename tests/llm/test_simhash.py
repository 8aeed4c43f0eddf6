import random
import re

import pytest
import xxhash

from quern.llm import simhash
from quern.llm.components import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, near):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    groups = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", groups[i]) for i in fps}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(groups.values())


@pytest.mark.parametrize("few, hold", [(1024, 1 << 20), (3, 1 << 20), (3, 5)])
def test_links_of_dense_groups(spark, few, hold):
    """Random fingerprints around a few centres; small limits send crowded variants through whole balls."""
    rng = random.Random(3)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(30):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    got = {r.node: r.label for r in simhash.groups(fps.selectExpr("0 as seed", "fp", "fp as node"), few=few, hold=hold).collect()}
    want = components(sorted(map(signed, values)), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {v: got.get(v, v) for v in want} == want


def test_every_pair_has_one_first_key():
    """A pair within 4 bits is linked at exactly one of the keys where it meets, as counted alone or among others."""
    import numpy as np

    rng = random.Random(11)
    for flips in (0, 1, 2, 3, 4, 5):
        for _ in range(60):
            a = rng.choice([0, 1, rng.getrandbits(64), (1 << 64) - 1])
            b = a
            for bit in rng.sample(range(64), flips):
                b ^= 1 << bit
            balls = [{(h, (x >> 32 * h & 0xFFFFFFFF) ^ f) for h in (0, 1) for f in (0, *(1 << k for k in range(32)))} for x in (a, b)]
            met = sorted(balls[0] & balls[1])
            pair = np.array([a, b], np.uint64)
            names = np.array([1, 2])
            alone = [k for k in met if simhash._verified(pair, names, k[0] << 32 | k[1])] if a != b else []
            among = [k for k in met if simhash._met_here(pair, *k)[0, 1]]
            assert alone == among or a == b
            assert len(among) == (flips <= 4) and (flips > 4 or simhash._first_key(a, b) == among[0])


def test_links_across_rounds(spark):
    """Chains in which fingerprints with and without a half in common alternate, under two seeds and with links known before."""
    flip = lambda x, *bits: x ^ sum(1 << b for b in bits)
    chain = [0x0123456789ABCDEF]
    for step in ((1, 2, 3, 4), (5, 6, 40, 41), (50, 51, 52, 53), (7, 45, 46, 47), (8, 9, 10, 33), (34, 35)):
        chain.append(flip(chain[-1], *step))
    far = [flip(chain[0], *range(20, 44, 2)), 0]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(0, signed(x), i) for i, x in enumerate(chain + far)] + [(1, signed(x), i) for i, x in zip((7, 30, 31), (5, 4, 0xFFFFFFFFFF), strict=True)]
    fps = spark.createDataFrame(rows, "seed int, fp long, node long")
    got = {r.node: r.label for r in simhash.groups(fps, alike=spark.createDataFrame([(31, 40)], "x long, y long")).collect()}
    assert got == dict.fromkeys(range(7), 0) | {7: 7, 30: 7, 31: 31, 40: 31}


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 150)], "a long, b long")
    got = {r.node: r.label for r in connected_components(links, "a", "b").collect()}
    assert got == dict.fromkeys(range(41), 0) | {150: 150, 200: 150}


def test_odd_and_empty(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (2, 3, 4)} == {("0" * 16, 2)}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert simhash.keep_one(no_docs, similarity=0.8).count() == 0
    kept = simhash.keep_one(odd_docs, similarity=0.8)
    assert kept.columns == odd_docs.columns
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect())
    assert ids.count(5) <= 1 and {-1, 1, 2, 8, 9} <= set(ids) and not {3, 4} & set(ids)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_similar_texts_are_verified(spark):
    """Lightly edited texts meet; every pair returned has the similarity, and texts below it stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows = []
    for group in range(30):
        base = [word() for _ in range(200)]
        rows.append((group * 10, " ".join(base)))
        for copy, edits in enumerate((1, 2, 12)):
            text = list(base)
            for at in rng.sample(range(200), edits):
                text[at] = word()
            rows.append((group * 10 + 1 + copy, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.k: r.doc_id for r in docs.selectExpr("xxhash64(text) as k", "doc_id").collect()}
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(196)}
    texts = {i: shingles(t) for i, t in rows}
    alike = lambda a, b: len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])
    want = {(a, b) for a in texts for b in texts if a < b and a // 10 == b // 10 and alike(a, b)}
    got = {tuple(sorted((keys[r.a], keys[r.b]))) for r in simhash.similar_texts(docs).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    kept = {r.doc_id for r in simhash.keep_one(docs, similarity=0.8).collect()}
    assert {g * 10 for g in range(30)} <= kept and {g * 10 + 3 for g in range(30)} <= kept and len(kept) <= 63


@pytest.mark.parametrize("copies, options", [(300, {}), (300, {"block": 40, "hubs": 4}), (300, {"block": 40, "hubs": 0, "few": 8}), (2500, {})])
def test_crowded_groups_are_verified_whole(spark, copies, options):
    """Copies of one text, each alike to it but mostly not to one another: what the true pairs connect is connected."""
    import numpy as np

    rng = random.Random(copies)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    base = [word() for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(copies):
        text = list(base)
        for at in rng.sample(range(200), 4 if copies > 1000 else 3):
            text[at] = word()
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r.k: r.doc_id for r in docs.selectExpr("xxhash64(text) as k", "doc_id").collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    number: dict = {}
    held = np.zeros((len(texts), 196 + 20 * copies), np.float32)
    for i, s in enumerate(sets):
        held[i, [number.setdefault(x, len(number)) for x in s]] = 1
    both = held @ held.T
    size = held.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size[None, :] - both)
    pairs = {tuple(sorted((keys[r.a], keys[r.b]))) for r in simhash.similar_texts(docs, **options).collect()}
    assert all(near[a, b] for a, b in pairs)
    parent = list(range(len(texts)))

    def find(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for a, b in pairs:
        parent[find(a)] = find(b)
    alike = int(near[0].sum())
    together = sum(find(i) == find(0) for i in np.flatnonzero(near[0]))
    print("recall", copies, options, alike, together)
    assert together >= 0.99 * alike
