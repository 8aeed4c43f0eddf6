"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of the last ``WINDOW`` bytes (shift, add a random word for each byte)
is taken at every byte; a chunk ends where the hash is the strict minimum of the
``radius`` positions on either side.  So a boundary depends on the bytes around it
alone: an insertion moves the chunks behind it but does not change them, no two
boundaries are nearer than ``radius``, and a passage long enough is cut alike wherever
it stands.  Chunks are deduplicated by a digest of 128 bits: the first occurrence, by
document id, stays; later ones go where an unbroken run of them holds at least ``min_bytes``
bytes that one document held first (shorter repeats are common phrases, not copies).

Scale: one Arrow pass gives each document its chunks as arrays; digests are counted by
a partial aggregate, and only repeated ones, a plain shuffle join, are looked at
further.  Where the owner of a digest is joined back both sides are plain shuffles,
so a digest that a third of all documents hold is split by adaptive execution.
Texts are hashed in pieces with an overlap, whole, whatever their length.

Defined cases: null and empty texts have no chunks and stay as they are; rows that
repeat both id and text are one document and are cut alike; rows that repeat an id with
other texts are told apart; a null id comes first; offsets are UTF-8 bytes, end
exclusive.  Extra columns are kept by ``dedup_substrings`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import fresh
from quern.storage import materialize, spread

WINDOW = 16
PIECE = 1 << 20
_GEAR = np.random.default_rng(1729).integers(0, 1 << 32, 256, np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the WINDOW bytes that end there (two bits of shift a byte)."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        add = h.copy()
        add[step:] += h[:-step] << np.uint32(2 * step) if len(h) > step else np.uint32(0)
        h = add
        step *= 2
    return h


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    low, have = h, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def boundaries(data: np.ndarray, radius: int) -> np.ndarray:
    """Ends of the chunks (exclusive), the last one being the end of the data."""
    cuts = []
    around = WINDOW + radius
    for at in range(0, len(data), PIECE):
        a, b = max(0, at - around), min(len(data), at + PIECE + around)
        h = gear(data[a:b])
        if len(h) > 2 * radius:
            left, right = _lowest(h, radius)[: -radius - 1], _lowest(h, radius)[radius + 1 :]
            inner = h[radius : len(h) - radius]
            found = np.flatnonzero((inner < left) & (inner < right)) + radius + a
            cuts.append(found[(found >= at) & (found < at + PIECE)] + 1)
    ends = np.concatenate([*cuts, [len(data)]]).astype(np.int64)
    return ends[ends <= len(data)] if len(ends) < 2 or ends[-2] < len(data) else ends[:-1]


def chunks(text: str | None, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of one text's chunks, in two halves, and their ends."""
    import xxhash

    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    ends = boundaries(np.frombuffer(raw, np.uint8), radius)
    digest, at, out = xxhash.xxh3_128_digest, 0, []
    for end in ends.tolist():
        out.append(digest(raw[at:end]))
        at = end
    halves = np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy(), ends


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def chunk_table(docs: DataFrame, *, id_col: str, text_col: str, radius: int) -> DataFrame:
    """doc_id, text_key, digests, checks, ends: one row a document with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                got = [chunks(t.as_py(), radius) for t in part.column(2)]
                offsets = pa.array(np.cumsum([0, *(len(g[0]) for g in got)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([g[i] for g in got]), pa.int64())) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *lists], ["doc_id", "text_key", "digests", "checks", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.filter(F.length(F.col(text_col)) > 0).select(F.col(id_col).alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, digests array<long>, checks array<long>, ends array<long>")


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 20, min_bytes: int = 100) -> DataFrame:
    """doc_id, text_key, start, stop, n_chunks, first_doc_id: each repeated run, and the document that holds most of it first.

    A run goes if one document holds chunks of ``min_bytes`` bytes of it first: phrases from
    here and there are no copy, though they may stand side by side.
    """
    table = materialize(chunk_table(docs, id_col=id_col, text_col=text_col, radius=radius), "chunks")
    repeated = materialize(
        table.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "repeated",
    )
    zipped = F.arrays_zip("digests", "checks", "ends", F.concat(F.array(F.lit(0).cast("long")), "ends").alias("starts"))
    each = table.select("doc_id", "text_key", F.posexplode(zipped).alias("at", "c")).select(
        "doc_id", "text_key", "at", F.col("c.digests").alias("digest"), F.col("c.checks").alias("check"), F.col("c.starts").alias("start"), F.col("c.ends").alias("stop"),
    )
    # Both sides always meet by shuffle: the digests grow with the corpus, so broadcasting them is no plan.
    held = materialize(each.filter(F.col("digest").isNotNull()).join(repeated.hint("merge"), "digest").distinct(), "held")
    place = F.struct("doc_id", "text_key", "at")
    owners = materialize(held.groupBy("digest", "check").agg(F.min(place).alias("owner")), "owners")
    later = held.join(owners, ["digest", "check"]).filter(~place.eqNullSafe(F.col("owner")))
    order = Window.partitionBy("doc_id", "text_key").orderBy("at")
    runs = later.withColumn("run", F.col("at") - F.row_number().over(order))
    return (
        runs.groupBy("doc_id", "text_key", "run", F.col("owner.doc_id").alias("first_doc_id"), F.col("owner.text_key").alias("first_key"))
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("n_bytes"))
        .groupBy("doc_id", "text_key", "run")
        .agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n_chunks"), F.max("n_bytes").alias("most"),
            F.min(F.struct((-F.col("n_bytes")).alias("less"), "start", "first_doc_id", "first_key")).alias("first"),
        )
        .filter(F.col("most") >= min_bytes)
        .select("doc_id", "text_key", "start", "stop", "n_chunks", F.col("first.first_doc_id").alias("first_doc_id"))
    )


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated spans cut from the texts; rows and columns stay."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, **options)
    spans_id, spans_key, found = fresh(docs, "spans_id", "spans_key", "spans")
    lists = spans.groupBy(F.col("doc_id").alias(spans_id), F.col("text_key").alias(spans_key)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(found))
    names, at = docs.columns, docs.columns.index(text_col)
    joined = docs.join(lists, docs[id_col].eqNullSafe(F.col(spans_id)) & (_text_key(docs[text_col]) == F.col(spans_key)), "left").select(*[docs[c] for c in names], found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.column(len(names)), strict=True):
                text, spans = text.as_py(), spans.as_py()
                if spans:
                    raw, kept, end = text.encode("utf-8", "surrogatepass"), [], 0
                    for s in spans:
                        kept.append(raw[end : s["start"]])
                        end = s["stop"]
                    # A cut inside a character leaves a part of it, which is dropped.
                    text = b"".join([*kept, raw[end:]]).decode("utf-8", "ignore")
                texts.append(text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, fields)
