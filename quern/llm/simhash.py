"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in at most ``2 * r`` bits have a value between them that
differs from each in at most ``r`` bits, so if every fingerprint emits all variants
within ``r`` bits, linked fingerprints collide on one.

A whole 64-bit ball of radius 2 has 2,081 variants, which is 16 kB of shuffle for
every distinct fingerprint.  So the balls are drawn in each 32-bit half: of 4 differing
bits one half has at most 2, hence a ball of radius 1 (33 variants) in each half finds
every link with 66 variants.  It goes in two rounds.  First fingerprints meet that have a
half in common (the centres of the half balls), and what is within 4 bits is one group.
Then all variants are dealt out by one shuffle, with the groups; where fingerprints of
several groups meet they are verified in place (of the variants at which a pair meets, the
first stands for it), and a spanning forest of the links goes out.  So a large group of
near copies, most of which have a half in common with some others, costs links in the
first round only, a few for each member.  Where a variant gathers more than ``few``
fingerprints, of several groups, no pairs are formed: all of them emit their whole ball of
2,081, and as any two that collide there are within 4 bits, each variant links its groups
to the smallest, a star.  No link is lost.

Copies never meet: all of it runs on distinct fingerprints.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle of all words; repeated rows
and repeated ids keep their rows; a null id is never a component's smallest unless
all are null.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.decontaminate import shingle_hashes
from quern.llm.text import WORD, fresh
from quern.storage import materialize, spread

#: Shingles counted at a time, so that a huge text needs no huge array.
_PIECE = 1 << 16
_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACES = bytes.maketrans(bytes(range(9, 14)), b" " * 5)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).translate(_SPACES)
    words = [w for w in data.split(b" ") if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    stops = ends[width - 1 :].tolist()
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _PIECE):
        part = zip(starts[i : i + _PIECE], stops[i : i + _PIECE], strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in part], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def _half_balls(fps: DataFrame, radius: int) -> DataFrame:
    """key, fp, label: for each (seed, fp) and each half, the seed, the half's number and each of its variants within ``radius`` (0 or 1) bits."""
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("bits")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("bits")),
    )
    flips = F.array(*[F.lit(x).cast("long") for x in (0, *(1 << k for k in range(32 * radius)))])
    side = (F.col("seed") * 2 + F.col("h.half")).cast("long")
    return (
        fps.select("seed", "fp", "label", F.explode(halves).alias("h")).select("seed", "fp", "label", "h", F.explode(flips).alias("flip"))
        .select(F.shiftleft(side, 32).bitwiseOR(F.col("h.bits").bitwiseXOR(F.col("flip"))).alias("key"), "fp", "label")
    )


def _whole_balls(fps: DataFrame) -> DataFrame:
    """seed, key, label: each variant of the fingerprint within two bits."""
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    first, second = np.triu_indices(64, 1)
    flips = np.concatenate([np.zeros(1, np.uint64), bit, bit[first] ^ bit[second]]).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                seed, fp, label = (np.repeat(part.column(i).to_numpy(), len(flips)) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(fp ^ np.tile(flips, len(part))), pa.array(label)], ["seed", "key", "label"])

    return fps.select("seed", "fp", "label").mapInArrow(run, "seed int, key long, label long")


def _forest(near: np.ndarray, all_pairs: int = 0) -> Iterator[tuple[int, int]]:
    """Pairs of ``near`` that connect whatever its pairs connect; of up to ``all_pairs`` members, all of them."""
    if len(near) <= all_pairs:
        yield from zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True)
        return
    fresh = np.ones(len(near), bool)
    for i in range(len(near)):
        if fresh[i]:
            fresh[i] = False
            stack = [i]
            while stack:
                at = stack.pop()
                for to in np.flatnonzero(near[at] & fresh).tolist():
                    fresh[to] = False
                    stack.append(to)
                    yield at, to


def _first_key(a: int, b: int) -> tuple[int, int]:
    """The half and the variant that stand for a pair within 4 bits: of those where it meets, the first half, the smallest variant."""
    half = int(((a ^ b) & 0xFFFFFFFF).bit_count() > 2)
    x, y = (a >> 32 * half) & 0xFFFFFFFF, (b >> 32 * half) & 0xFFFFFFFF
    d = x ^ y
    if not d:
        return half, x ^ (1 << x.bit_length() >> 1)
    low = d & -d
    return half, min(x, y) if low == d else min(x ^ low, y ^ low)


def _met_here(fps: np.ndarray, half: int, variant: int) -> np.ndarray:
    """Which pairs of a key's fingerprints are within 4 bits and have this key as :func:`_first_key`."""
    d = fps[:, None] ^ fps[None, :]
    low_bits = np.bitwise_count(d & np.uint64(0xFFFFFFFF))
    near = (np.bitwise_count(d) <= 4) & ((low_bits > 2) == bool(half))
    x = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
    d = x[:, None] ^ x[None, :]
    low = d & (~d + np.uint64(1))
    # Without a differing bit: the highest one bit off; with one: the smaller side; with two: either flipped.
    top = (np.uint64(1) << np.frexp(x.astype(np.float64))[1].astype(np.uint64)) >> np.uint64(1)
    least = np.where(low == d, np.minimum(x[:, None], x[None, :]), np.minimum(x[:, None] ^ low, x[None, :] ^ low))
    least = np.where(d == 0, (x ^ top)[:, None], least)
    return near & (least == np.uint64(variant))


def _verified(fps: np.ndarray, labels: np.ndarray, key: int | None) -> set[tuple[int, int]]:
    """Pairs of labels whose fingerprints are within 4 bits, such as connect what all of them connect; with ``key`` only of pairs whose first key it is."""
    if labels.min() == labels.max():
        return set()
    half, variant = (key >> 32 & 1, key & 0xFFFFFFFF) if key is not None else (0, 0)
    if len(fps) == 2:
        a, b = fps.tolist()
        pairs = [(0, 1)] if (a ^ b).bit_count() <= 4 and (key is None or _first_key(a, b) == (half, variant)) else []
    else:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4 if key is None else _met_here(fps, half, variant)
        pairs = _forest(near & (labels[:, None] != labels[None, :]))
    return {(min(x), max(x)) for i, j in pairs for x in [(int(labels[i]), int(labels[j]))]}


def _meet(batches: Iterator[pa.RecordBatch], few: int, hold: int, fine: bool) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int, int]]]]:
    """From (key, fp, label) sorted by key: links of labels, and the (seed, fp, label) of keys with more than ``few`` fingerprints of several labels.

    Unless ``fine``, such a key's fingerprints are verified in stretches of ``few``, and none is given.
    """
    kept = [np.empty(0, np.int64)] * 3
    over = None  # a key of which some rows went out as crowded already
    for batch in _with_end(batches):
        if batch is not None:
            kept = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(kept)]
        keys, fps, labels = kept[0], kept[1].view(np.uint64), kept[2]
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, stops = np.concatenate([[0], edges]).astype(np.int64), np.append(edges, len(keys)).astype(np.int64)
        open_ = len(starts) - 1 if batch is not None else len(starts)  # the last key may go on in the next batch
        pairs: set[tuple[int, int]] = set()
        crowded: list[tuple[int, int, int]] = []

        def crowd(a: int, b: int, seed: int) -> None:
            crowded.extend(zip([seed] * (b - a), kept[1][a:b].tolist(), kept[2][a:b].tolist(), strict=True))  # noqa: B023

        for i in np.flatnonzero(stops[:open_] - starts[:open_] > 1):
            a, b, key = int(starts[i]), int(stops[i]), int(keys[starts[i]])
            if b - a <= few and key != over:
                pairs |= _verified(fps[a:b], labels[a:b], key if fine else None)
            elif not fine:
                for at in range(a, b, few):
                    pairs |= _verified(fps[at : min(b, at + few)], labels[at : min(b, at + few)], None)
            elif key == over or labels[a:b].min() < labels[a:b].max():
                crowd(a, b, key >> 33)
        if batch is not None:
            a, b, key = int(starts[-1]), len(keys), int(keys[-1]) if len(keys) else 0
            if not fine and b - a > 2 * few:
                while b - a > few:
                    pairs |= _verified(fps[a : a + few], labels[a : a + few], None)
                    a += few - 1
            elif fine and (key == over or b - a > hold):
                crowd(a, b, key >> 33)
                over, a = key, max(a, b - 1)
            kept = [x[a:] for x in kept]
        yield sorted(pairs), crowded


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _round(fps: DataFrame, few: int, hold: int, fine: bool) -> DataFrame:
    """seed, fp, a, b: links of the labels a and b (seed -1), or crowded fingerprints of label a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs, crowded in _meet(batches, few, hold, fine):
            rows = [(-1, 0, a, b) for a, b in pairs] + [(seed, fp, label, label) for seed, fp, label in crowded]
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["seed", "fp", "a", "b"])

    balls = _half_balls(fps, int(fine)).repartition("key").sortWithinPartitions("key", "fp")
    return materialize(balls.mapInArrow(run, "seed int, fp long, a long, b long").distinct(), "met")


def groups(fps: DataFrame, *, alike: DataFrame | None = None, few: int = 1024, hold: int = 1 << 20) -> DataFrame:
    """node, label: what links within 4 bits, and ``alike``, connect, named by its smallest node; nodes without a link are left out.

    ``fps`` is distinct (seed, fp, node): fingerprints of one seed are compared, and one that
    is linked links its node.  ``alike`` (x, y) are links of nodes known already.
    """
    named = fps.select("seed", "fp", F.col("node").alias("label"))
    near = _round(named, few, hold, False).select(F.col("a").alias("x"), F.col("b").alias("y"))
    first = connected_components(near if alike is None else near.union(alike.select("x", "y")), "x", "y")
    labelled = fps.join(first, "node", "left").select("seed", "fp", F.coalesce("label", "node").alias("label"))
    met = _round(labelled, few, hold, True)
    found = met.filter("seed = -1").select("a", "b")
    crowded = met.filter("seed >= 0").select("seed", "fp", F.col("a").alias("label"))
    if not crowded.isEmpty():
        whole = _whole_balls(crowded)
        centres = whole.groupBy("seed", "key").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a < z").drop("z")
        stars = whole.join(materialize(centres, "centres"), ["seed", "key"]).select("a", F.col("label").alias("b")).filter("a <> b").distinct()
        found = found.union(stars)
    second = connected_components(found, "a", "b").select(F.col("node").alias("was"), F.col("label").alias("now"))
    # Labels of the first round are nodes too; those that only the second round links are added.
    names = first.union(second.select("was", F.col("was").alias("label"))).distinct()
    return materialize(names.join(second, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label")).groupBy("node").agg(F.min("label").alias("label")), "components")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


_MINIMA = np.random.default_rng(577).integers(0, 1 << 64, (16, 64), np.uint64) | np.uint64(1)


def set_fingerprints(text: str | None, seeds: int, least: int = 5) -> tuple[int, list[int]]:
    """The number of words and ``seeds`` independent 64-bit fingerprints of the set of words; none for fewer than ``least`` words.

    A SimHash bit is the majority over all features, which makes bits of two sets differ with
    about the square root of what the sets don't share.  Here each bit is the vote of one feature,
    the word with the smallest of that bit's hashes, so that bits differ with half the share of
    words that are not common: near copies lie much nearer, unlike texts as far as before.
    """
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).translate(_SPACES)
    words = [w for w in data.split(b" ") if w]
    if len(words) < least:
        return len(words), []
    h = np.array([xxhash.xxh64_intdigest(w) for w in set(words)], np.uint64)
    out = []
    for seed in range(seeds):
        smallest = np.full(64, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(h), 1 << 12):
            x = h[at : at + (1 << 12), None] * _MINIMA[seed][None, :]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            smallest = np.minimum(smallest, x.min(axis=0))
        out.append(int(np.packbits((smallest >> np.uint64(17)).astype(np.uint8) & 1, bitorder="little").view("<u8")[0]))
    return len(words), out


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """The number of values that each two of the sets share."""
    rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, which = rows[n[which] > 1], which[n[which] > 1]
    order = np.argsort(which, kind="stable")
    rows, which = rows[order], np.cumsum(np.diff(which[order], prepend=which[order][:1]) > 0)
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(which[-1]) + 1 if len(which) else 0, 4096):
        a, b = np.searchsorted(which, (at, at + 4096))
        part = np.zeros((len(sets), int(which[b - 1]) + 1 - at), np.float32)
        part[rows[a:b], which[a:b] - at] = 1
        out += part @ part.T
    return out.astype(np.float64)


def _compare(cells: DataFrame, threshold: float, all_pairs: int, hubs: int) -> DataFrame:
    """parts, grp, a, b, central: of each cell's texts (cell, grp, parts, text_key, s) all pairs are verified, and links that connect all verified pairs go out (all, of at most ``all_pairs`` texts).

    For a group of several parts the ``hubs`` texts of a cell that share most with the others are given too, with ``a`` and ``b`` alike.
    """

    def judge(held: list[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, float]]:
        parts, grp = held[0].column(2)[0].as_py(), held[0].column(1)[0].as_py()
        keys, sets = [], []
        for batch in held:
            flat, ends = batch.column(4).flatten().to_numpy(), batch.column(4).offsets.to_numpy()
            keys += batch.column(3).to_pylist()
            sets += np.split(flat, ends[1:-1] - ends[0])
        once = {k: x for k, x in zip(keys, sets, strict=True)}
        keys, sets = list(once), list(once.values())
        shared, size = _shared(sets), np.array(list(map(len, sets)), float)
        near = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
        for i, j in _forest(near, all_pairs):
            yield parts, grp, min(keys[i], keys[j]), max(keys[i], keys[j]), 0.0
        if parts > 1 and hubs:
            central = (shared / np.maximum(size[:, None] + size[None, :] - shared, 1)).mean(axis=1)
            for i in np.argsort(-central, kind="stable")[:hubs].tolist():
                yield parts, grp, keys[i], keys[i], float(central[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["parts", "grp", "a", "b", "central"], [pa.int32(), *[pa.int64()] * 3, pa.float64()]
        held: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            out: list[tuple[int, int, int, int, float]] = []
            cells = batch.column(0).to_numpy() if batch is not None else np.zeros(0, np.int64)
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and (a == b or held[0].column(0)[0].as_py() != int(cells[a])):
                    out += judge(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = cells.select("cell", "grp", "parts", "text_key", "s").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(run, "parts int, grp long, a long, b long, central double")


def similar_texts(
    docs: DataFrame, *, text_col: str = "text", seeds: int = 2, threshold: float = 0.8, width: int = 5, few: int = 1024, all_pairs: int = 24, small: int = 1_000_000,
    block: int = 1024, block_words: int = 1_000_000, hubs: int = 32,
) -> DataFrame:
    """a, b: hashes of different texts whose sets of ``width``-word shingles have a Jaccard similarity of ``threshold`` or more.

    Candidates are texts whose fingerprints of the set of words (:func:`set_fingerprints`), under
    any of ``seeds`` seeds, are within 4 bits by ball hashing.  A few edited words change many
    shingles but few words, so these meet where the shingles' own SimHashes do not.  Whatever
    candidates connect is a group, and in a group every text is compared with every other, on the
    shingles.  A group of at most ``block`` texts and ``block_words`` words is compared at once; a
    larger one in blocks, then its ``hubs`` most central texts with all blocks, and at last all
    texts not yet linked to the largest part with all blocks.  Of a group of more than
    ``all_pairs`` texts, not all pairs go out but such that connect the same texts.
    """
    texts = spread(docs.select(_text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets = zip(*(set_fingerprints(t.as_py(), seeds, width) for t in batch.column(1)), strict=True) if len(batch) else ((), ())
            found = [np.array(x, np.uint64).view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["text_key", "words", "sets"])

    marked = materialize(texts.mapInArrow(run, "text_key long, words long, sets array<long>").filter(F.size("sets") > 0), "sets")
    marked = materialize(marked.groupBy("text_key").agg(F.first("words").alias("words"), F.first("sets").alias("sets")), "sets")
    side = marked.select("text_key", F.posexplode("sets").alias("seed", "fp"))
    first = materialize(side.groupBy("seed", "fp").agg(F.min("text_key").alias("first")), "first")
    again = side.join(first, ["seed", "fp"]).filter("text_key <> first").select(F.col("first").alias("x"), F.col("text_key").alias("y"))
    found = groups(first.select("seed", "fp", F.col("first").alias("node")), alike=again, few=few)
    sized = found.join(marked.select(F.col("text_key").alias("node"), "words"), "node")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("words") / block_words)).cast("int")
    large = materialize(sized.groupBy("label").agg(parts.alias("parts")).filter("parts > 1").select(F.col("label").alias("grp"), "parts"), "large")
    crowds = large.count()
    members = found.join(F.broadcast(large) if crowds <= small else large, F.col("label") == F.col("grp"), "left")
    members = materialize(members.select(F.col("node").alias("k"), F.col("label").alias("grp"), F.coalesce("parts", F.lit(1)).alias("parts")), "members")
    blank = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(blank, F.lit(WORD), F.lit(0))
    wanted = texts.join(F.broadcast(members) if members.count() <= small else members, F.col("text_key") == F.col("k")).dropDuplicates(["text_key"])
    shingled = wanted.select("text_key", "grp", "parts", F.pmod(F.xxhash64("text_key"), F.col("parts")).alias("block"), words.alias("words"))
    shingled = materialize(shingled.select("text_key", "grp", "parts", "block", F.array_distinct(shingle_hashes(F.col("words"), width)).alias("s")), "shingles")

    compare = lambda x, *by, central=0: materialize(_compare(x.withColumn("cell", F.xxhash64("grp", *by)), threshold, all_pairs, central), "alike")
    found = compare(shingled, "block", central=hubs)
    if not crowds:
        return found.select("a", "b")
    crowd = shingled.filter("parts > 1")
    over = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("block")
    most = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("central"), "a"))
    central = found.filter("a = b").withColumn("n", most).filter(F.col("n") <= hubs).select(F.col("a").alias("k"))
    columns = ["text_key", "grp", "parts", "block", "s"]
    everywhere = crowd.join(central, F.col("text_key") == F.col("k"), "left_semi").select("text_key", "grp", "parts", over, "s")
    found = found.filter("a <> b").union(compare(crowd.select(*columns).union(everywhere), "block"))

    labels = connected_components(found.filter("parts > 1"), "a", "b")
    placed = crowd.select("text_key", "grp").join(labels, F.col("text_key") == F.col("node"), "left").select("text_key", "grp", F.coalesce("label", "text_key").alias("label"))
    placed = materialize(placed, "placed")
    main = placed.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
    left = materialize(placed.join(main.select("grp", "main"), "grp").filter("label <> main").select(F.col("text_key").alias("k"), F.col("grp").alias("g")), "left")
    chunks = materialize(left.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks")), "left")
    if chunks.isEmpty():
        return found.select("a", "b")
    crowd = crowd.join(F.broadcast(chunks) if crowds <= small else chunks, F.col("grp") == F.col("g"))
    alone = crowd.join(left.select("k"), F.col("text_key") == F.col("k"), "left_semi").select("text_key", "grp", "parts", over, "s", F.pmod(F.xxhash64(F.lit(1), "text_key"), F.col("chunks")).alias("chunk"))
    whole = crowd.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"))
    return found.union(compare(whole.union(alone), "block", "chunk")).select("a", "b")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, few: int, similar: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, fp of every row; member, label of every fingerprint.

    ``similar`` (a, b: text keys) are links beside those of the fingerprints.
    """
    marked = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    fps = materialize(marked.select("fp").distinct(), "fps")
    alike = None
    if similar is not None:
        texts = materialize(marked.groupBy("text_key").agg(F.min("fp").alias("fp")), "texts")
        ends = [texts.select(F.col("text_key").alias(k), F.col("fp").alias(n)) for k, n in (("a", "x"), ("b", "y"))]
        alike = similar.join(ends[0], "a").join(ends[1], "b").select("x", "y").filter("x <> y")
    labels = groups(fps.select(F.lit(0).alias("seed"), "fp", F.col("fp").alias("node")), alike=alike, few=few)
    owners = fps.join(labels, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("member"), F.coalesce("label", "fp").alias("label"))
    return marked, materialize(owners, "owners")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, few: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row a document."""
    marked, owners = _grouped(docs, id_col, text_col, width, few)
    lowest = marked.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    lowest = materialize(lowest.join(owners, F.col("fp") == F.col("member")).select("member", "label", "lowest"), "lowest")
    least = materialize(lowest.groupBy("label").agg(F.min("lowest").alias("component_id")), "least")
    named = materialize(lowest.join(least, "label").select("member", "component_id"), "named")
    return (
        marked.join(named, F.col("fp") == F.col("member"))
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, few: int = 1024, small: int = 1_000_000, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id (then text hash); of exact repeats, one.

    With ``similarity`` texts of that Jaccard similarity (:func:`similar_texts`) are linked too.
    The keys of the rows that go are broadcast if there are at most ``small``.
    """
    similar = None if similarity is None else materialize(similar_texts(docs, text_col=text_col, threshold=similarity, few=few, small=small), "similar")
    marked, owners = _grouped(docs, id_col, text_col, width, few, similar)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    grouped = materialize(marked.join(owners, F.col("fp") == F.col("member")).select("label", "doc_id", "text_key").groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "grouped")
    keepers = materialize(grouped.groupBy("label").agg(F.min(place).alias("keeper")), "keepers")
    judged = grouped.join(keepers, "label").withColumn("stays", place.eqNullSafe(F.col("keeper")))
    same_id, same_key, nth = fresh(docs, "same_id", "same_key", "nth")
    names = [F.col("doc_id").alias(same_id), F.col("text_key").alias(same_key)]
    gone = materialize(judged.filter("not stays").select(*names), "gone")
    again = materialize(judged.filter("stays and n > 1").select(*names), "again")
    same = docs[id_col].eqNullSafe(F.col(same_id)) & (_text_key(docs[text_col]) == F.col(same_key))
    kept = docs.join(F.broadcast(gone) if gone.count() <= small else gone, same, "left_anti")
    if again.isEmpty():
        return kept
    columns = docs.columns
    order = Window.partitionBy(id_col, same_key).orderBy(*[F.col(c) for c in columns if c != id_col])
    once = docs.join(again, same, "left_semi").withColumn(same_key, _text_key(F.col(text_col))).withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).select(*columns)
    return kept.join(again, same, "left_anti").unionByName(once)
