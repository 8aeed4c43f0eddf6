"""Line dedup by content-defined chunks of lines.

Lines are hashed, and a rolling hash is taken over every two lines that follow each other, blank lines aside.  At each of
``LEVELS`` levels the rolling hash chooses the lines that begin a chunk and those that end one (those of a hash below
``SHARE`` of its range, by a mixing of the level's own); a chunk reaches from a beginning to the next end.  Both choices look at lines of the chunk alone, so they
come out alike wherever a passage stands, and inserted lines shift nothing elsewhere.  A text's first and last lines are
borders too, and so are two equal lines.

Chunks, of two lines or more, are compared over the whole corpus by a digest of 128 bits; of those that repeat, the first occurrence by
document id and place stays.  What a document shares with the same owner in one piece is put together, extended line by
line in both directions while the lines before and after are equal (``REACH`` lines; beyond them there are further chunks), and
removed if the SHA-256 of both sides' bytes is equal and the passage is large enough: ``LEAST`` lines that are
not blank and ``LEAST_BYTES`` bytes, or ``TWO_BYTES`` bytes in two lines.  Short ends that unrelated texts share stay.

Scale: one Arrow pass gives each document its chunks; digests are counted by a partial aggregate and chunks are shuffled by
digest, as plain shuffles on both sides that adaptive execution splits where a digest is
hot.  A second pass looks at the borders of shared passages only, in the documents that have any.  What goes from a document is joined into ranges; these lists are broadcast behind a
check of their counted entries.

Defined cases: lines end at a line feed; null and empty texts have no chunks and stay
as they are; rows that repeat both id and text are one document and are cut alike; rows
that repeat an id with other texts are told apart; a null id comes first.  Of a passage that a document repeats itself the
first stays, and is not extended.  A document
whose every line is removed is a copy of kept text and is dropped.  Extra columns are
kept by ``dedup_lines`` and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import fresh
from quern.storage import materialize, spread

LEVELS = 3
SHARE = 0.65
REACH = 4
LEAST, LEAST_BYTES, TWO_BYTES = 3, 30, 160
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _chosen(rolled: np.ndarray, salt: int) -> np.ndarray:
    """Whether each hash, mixed with the salt, lies in the lowest ``SHARE`` of its range."""
    h = (rolled + np.uint64(salt * int(_FACTOR) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB) < np.uint64(int(SHARE * 2**64))


def _split(text: str) -> tuple[bytes, np.ndarray]:
    """The text's bytes, and where its lines begin, with one more place behind the last."""
    data = text.encode("utf-8", "surrogatepass")
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return data, np.concatenate([[0], breaks, [len(data) + 1]])


def chunk_lines(text: str | None) -> list[tuple[int, int, int, int]]:
    """(digest, check, first line, line after the last) of the text's chunks, by place; digest and check are the halves of the bytes' hash."""
    import xxhash

    if not text or "\n" not in text:
        return []
    data, at = _split(text)
    lines = [data[a : b - 1] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    held = np.flatnonzero([bool(x.strip()) for x in lines])
    if len(held) < 2:
        return []
    h = np.array([xxhash.xxh3_64_intdigest(lines[i]) for i in held], np.uint64)
    rolled = h[:-1] * _FACTOR + h[1:]
    rolled ^= rolled >> np.uint64(31)
    same, spans = h[:-1] == h[1:], set()
    for level in range(LEVELS):
        starts, ends = _chosen(rolled, 2 * level + 1) | same, _chosen(rolled, 2 * level + 2) | same
        starts[0] = ends[-1] = True
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        spans.update(zip(held[first].tolist(), (held[last[np.searchsorted(last, first)] + 1] + 1).tolist(), strict=True))
    out = []
    for a, b in sorted(spans):
        full = xxhash.xxh3_128_digest(data[at[a] : at[b] - 1])
        out.append((int.from_bytes(full[:8], "little", signed=True), int.from_bytes(full[8:], "little", signed=True), a, b))
    return out


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def chunk_table(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, found (array of digest, check, start, stop): one row a document that has chunks."""
    fields = pa.struct([("digest", pa.int64()), ("check", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[{"digest": d, "check": c, "start": a, "stop": b} for d, c, a, b in chunk_lines(t.as_py())] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(fields))], ["doc_id", "text_key", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.filter(F.contains(F.col(text_col), F.lit("\n"))).select(F.col(id_col).alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, found array<struct<digest:long,check:long,start:int,stop:int>>").filter(F.size("found") > 0)


def _small(lists: DataFrame, column: str, most: int) -> DataFrame:
    """``lists`` with a broadcast hint if its arrays hold at most ``most`` entries in all."""
    return F.broadcast(lists) if (lists.agg(F.sum(F.size(column))).first()[0] or 0) <= most else lists


def _runs(found: DataFrame, kind: str) -> DataFrame:
    """doc_id, text_key, first_id, first_key, start, stop, first_start (null within one document): the chunks of one owner at one distance, joined where they meet."""
    rows = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first_id", "first_key", "start", "stop", "first_start")).alias("chunks"))

    def join(chunks: list[dict]) -> Iterator[dict]:
        place = lambda x: (x["first_id"] is not None, x["first_id"] or 0, x["first_key"], x["first_start"] is not None, x["start"] - (x["first_start"] or 0) if x["first_start"] is not None else 0)
        at, run = None, None
        for x in sorted(chunks, key=lambda x: (place(x), x["start"])):
            if run and place(x) == at and x["start"] <= run["stop"]:
                run["stop"] = max(run["stop"], x["stop"])
                continue
            if run:
                yield run
            at, run = place(x), x
        if run:
            yield run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [list(join(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, batch.column(2).type)], ["doc_id", "text_key", "runs"])

    schema = f"doc_id {kind}, text_key long, runs array<struct<first_id:{kind},first_key:long,start:int,stop:int,first_start:int>>"
    return rows.mapInArrow(work, schema).select("doc_id", "text_key", F.explode("runs").alias("r")).select("doc_id", "text_key", "r.*")


_AROUND = "array<struct<line:binary,size:int>>"


def _borders(docs: DataFrame, ranges: DataFrame, kind: str, small: int) -> DataFrame:
    """id, key, start, stop, sha, n_lines, n_bytes, before, after: of each range of lines its bytes' SHA-256 and size, and the lines next to it, nearest first (size 0: blank)."""
    import xxhash

    lists = materialize(ranges.distinct().groupBy("id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "ranges")
    texts = docs.join(_small(lists, "ranges", small), docs["doc_id"].eqNullSafe(F.col("id")) & (docs["text_key"] == F.col("key"))).select("id", "key", "text", "ranges")
    around = pa.list_(pa.struct([("line", pa.binary()), ("size", pa.int32())]))

    def look(text: str, asked: list[dict]) -> Iterator[dict]:
        data, at = _split(text)
        at = at.tolist()
        line = lambda i: data[at[i] : at[i + 1] - 1]
        shown = lambda i: {"line": xxhash.xxh3_128_digest(line(i)), "size": at[i + 1] - at[i] if line(i).strip() else 0}
        for r in asked:
            a, b = r["start"], r["stop"]
            yield r | {
                "sha": hashlib.sha256(data[at[a] : at[b] - 1]).digest(), "n_lines": sum(bool(line(i).strip()) for i in range(a, b)), "n_bytes": at[b] - at[a],
                "before": [shown(i) for i in range(a - 1, max(a - 1 - REACH, -1), -1)], "after": [shown(i) for i in range(b, min(b + REACH, len(at) - 1))],
            }

    fields = {"start": pa.int32(), "stop": pa.int32(), "sha": pa.binary(), "n_lines": pa.int32(), "n_bytes": pa.int32(), "before": around, "after": around}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows = list(look(batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
                repeat = pa.array([i] * len(rows), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(repeat), batch.column(1).take(repeat), *(pa.array([r[c] for r in rows], t) for c, t in fields.items())], ["id", "key", *fields])

    found = texts.mapInArrow(run, f"id {kind}, key long, start int, stop int, sha binary, n_lines int, n_bytes int, before {_AROUND}, after {_AROUND}")
    return materialize(found, "borders").dropDuplicates(["id", "key", "start", "stop"])


def _equal(a: Column, b: Column) -> Column:
    """The number of equal lines at the head of both lists."""
    differs = F.transform(F.zip_with(a, b, lambda x, y: F.coalesce(x["line"] == y["line"], F.lit(False))), lambda same: ~same)
    first = F.array_position(differs, F.lit(True)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(differs))


def repeated_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", small: int = 400_000) -> DataFrame:
    """doc_id, text_key, start, stop, first_doc_id: the lines [start, stop) of each passage that goes."""
    table = materialize(chunk_table(docs, id_col=id_col, text_col=text_col), "chunks")
    kind = docs.schema[id_col].dataType.simpleString()
    each = table.select("doc_id", "text_key", F.explode("found").alias("c")).select("doc_id", "text_key", "c.*").distinct()
    place = F.struct("doc_id", "text_key", "start", "stop", "check")
    repeated = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("owner")).filter("n > 1").drop("n")
    repeated = materialize(repeated, "repeated")
    own = F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("text_key") == F.col("owner.text_key"))
    found = (
        each.join(repeated.hint("merge"), "digest").filter((F.col("check") == F.col("owner.check")) & (~own | (F.col("start") >= F.col("owner.stop"))))
        .select("doc_id", "text_key", "start", "stop", F.col("owner.doc_id").alias("first_id"), F.col("owner.text_key").alias("first_key"), F.when(~own, F.col("owner.start")).alias("first_start"))
    )
    runs = materialize(_runs(found, kind), "runs")
    texts = docs.filter(F.contains(F.col(text_col), F.lit("\n"))).select(F.col(id_col).alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    other_stop = (F.col("first_start") + F.col("stop") - F.col("start")).alias("stop")
    ranges = runs.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "start", "stop").unionByName(
        runs.filter("first_start is not null").select(F.col("first_id").alias("id"), F.col("first_key").alias("key"), F.col("first_start").alias("start"), other_stop))
    borders = _borders(texts, ranges, kind, small)
    mine = borders.select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "start", "stop", F.struct("sha", "n_lines", "n_bytes", "before", "after").alias("mine"))
    theirs = borders.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.struct("sha", "before", "after").alias("theirs"))
    r = runs.alias("r").join(mine.alias("m"), F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.text_key") == F.col("m.text_key")) & (F.col("r.start") == F.col("m.start")) & (F.col("r.stop") == F.col("m.stop"))).select("r.*", "mine")
    r = r.join(theirs, r["first_id"].eqNullSafe(F.col("_id")) & (r["first_key"] == F.col("_key")) & (r["first_start"] == F.col("_start")) & (r["first_start"] + r["stop"] - r["start"] == F.col("_stop")), "left")
    known = F.col("theirs").isNotNull()
    r = r.filter(F.col("first_start").isNull() | (F.col("mine.sha") == F.col("theirs.sha")))
    r = r.withColumn("up", F.when(known, _equal(F.col("mine.before"), F.col("theirs.before"))).otherwise(0)).withColumn("down", F.when(known, _equal(F.col("mine.after"), F.col("theirs.after"))).otherwise(0))
    added = F.concat(F.slice("mine.before", F.lit(1), F.col("up")), F.slice("mine.after", F.lit(1), F.col("down")))
    r = r.withColumn("n_lines", F.col("mine.n_lines") + F.size(F.filter(added, lambda x: x["size"] > 0))).withColumn("n_bytes", F.col("mine.n_bytes") + F.aggregate(added, F.lit(0), lambda s, x: s + x["size"]))
    large = ((F.col("n_lines") >= LEAST) & (F.col("n_bytes") >= LEAST_BYTES)) | (F.col("n_bytes") >= TWO_BYTES)
    return r.filter(large).select("doc_id", "text_key", (F.col("start") - F.col("up")).alias("start"), (F.col("stop") + F.col("down")).alias("stop"), F.col("first_id").alias("first_doc_id")).distinct()


def _merged(lists: DataFrame) -> DataFrame:
    """``lists`` (doc_id, text_key, gone) with the ranges of ``gone`` in order and joined where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ranges in batch.column(2).to_pylist():
                joined: list[dict] = []
                for x in sorted(ranges, key=lambda r: r["start"]):
                    if joined and x["start"] <= joined[-1]["stop"]:
                        joined[-1]["stop"] = max(joined[-1]["stop"], x["stop"])
                    else:
                        joined.append(x)
                out.append(joined)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["doc_id", "text_key", "gone"])

    kind = lists.schema["doc_id"].dataType.simpleString()
    return lists.select("doc_id", "text_key", "gone").mapInArrow(run, f"doc_id {kind}, text_key long, gone array<struct<start:int,stop:int>>")


def _between(lines: Column, gone: Column) -> Column:
    """The lines outside the ordered ranges ``gone``, stretch by stretch, so that work grows with lines and ranges, not with their product."""

    def stretch(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1)["stop"])
        end = F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i)["start"])
        return F.slice(lines, begin + 1, end - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), stretch))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", small: int = 400_000) -> DataFrame:
    """``docs`` without the lines of repeated chunks, and without documents of which nothing is left."""
    found = materialize(repeated_chunks(docs, id_col=id_col, text_col=text_col), "gone")
    lists = materialize(_merged(found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))), "gone")
    gone_id, gone_key, gone, lines, kept = fresh(docs, "gone_id", "gone_key", "gone", "lines", "kept")
    lists = _small(lists.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key), F.col("gone").alias(gone)), gone, small)
    touched = F.col(gone).isNotNull()
    # Ranges that meet are one, so a document of which nothing is left has a single range.  This filter stands first and
    # needs no lines taken out: one on ``kept`` would be pushed below ``lines``, and the text be split again for every range.
    whole = (F.size(F.col(gone)) == 1) & (F.get(F.col(gone), F.lit(0))["start"] == 0) & (F.get(F.col(gone), F.lit(0))["stop"] == F.size(F.split(F.col(text_col), "\n")))
    return (
        docs.join(lists, docs[id_col].eqNullSafe(F.col(gone_id)) & (_text_key(docs[text_col]) == F.col(gone_key)), "left")
        .filter(~touched | ~whole)
        .withColumn(lines, F.when(touched, F.split(F.col(text_col), "\n")))
        .withColumn(kept, F.when(touched, _between(F.col(lines), F.col(gone))))
        .withColumn(text_col, F.when(touched, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
        .select(*docs.columns)
    )
