"""Articles from archives of XML that may break off: every complete article before the break is read.

A file is inflated piece by piece and cut at the ends of its articles, so neither the inflated file nor all of its
articles are ever held; where the data end or are damaged the file ends.  Spark reads the compressed files (2 GB each at most), from any store it knows.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
#: Characters of articles in a batch.
BATCH = 1 << 22

SCHEMA = (
    "MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string>>>>,"
    " MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string>>>>>"
)


def inflated(content: bytes | memoryview) -> Iterator[bytes]:
    """The pieces of a gzip file of any number of members, up to its end, its break or its first damage; other files as they are."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), PIECE):
            yield bytes(content[at : at + PIECE])
        return
    reader, at, rest = zlib.decompressobj(31), 0, b""
    while rest or at < len(content):
        if not rest:
            rest, at = bytes(content[at : at + PIECE]), at + PIECE
        before = reader.copy()
        try:
            yield reader.decompress(rest, 8 * PIECE)
        except zlib.error:  # what comes before the damage, byte by byte
            with contextlib.suppress(zlib.error):
                for i in range(len(rest)):
                    yield before.decompress(rest[i : i + 1])
            return
        rest = reader.unconsumed_tail
        if reader.eof:
            rest, reader = reader.unused_data, zlib.decompressobj(31)
    yield reader.flush()


def elements(pieces: Iterator[bytes], tag: str) -> Iterator[str]:
    """The complete elements ``<tag ...>...</tag>`` of a stream, which do not nest; text that is not UTF-8 is marked."""
    begin, end, held, at = f"<{tag}".encode(), f"</{tag}>".encode(), b"", 0
    for piece in pieces:
        held += piece
        while True:
            start = held.find(begin, at)
            while start >= 0 and held[start + len(begin) : start + len(begin) + 1] not in (b"", b" ", b">", b"\t", b"\r", b"\n", b"/"):
                start = held.find(begin, start + 1)  # a longer name
            stop = held.find(end, max(start, 0)) if start >= 0 else -1
            if stop < 0:
                break
            yield held[start : stop + len(end)].decode("utf-8", "replace")
            at = stop + len(end)
        held, at = held[max(start, 0) if start >= 0 else max(at, len(held) - len(begin)) :], 0


def raw_articles(spark: SparkSession, path: str, tag: str = "PubmedArticle") -> DataFrame:
    """file, article: the text of each complete article of the files at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                out, size = [], 0

                def made(rows: list[str], file: str = file.as_py()) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(rows, pa.string())], ["file", "article"])

                for article in elements(inflated(memoryview(content.as_buffer())), tag):
                    out.append(article)
                    size += len(article)
                    if size >= BATCH:
                        yield made(out)
                        out, size = [], 0
                yield made(out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, article string")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract (sections as ``Label: text``), mesh of the articles that have an abstract."""
    m = F.from_xml("article", SCHEMA, {"mode": "PERMISSIVE"})["MedlineCitation"]
    raw = raw_articles(spark, path).select(m.alias("m"))
    m = F.col("m")
    section = lambda a: F.when(F.coalesce(a["_Label"], F.lit("")) != "", F.concat(a["_Label"], F.lit(": "), a["_VALUE"])).otherwise(a["_VALUE"])
    abstract = F.array_join(F.transform(m["Article"]["Abstract"]["AbstractText"], section), " ")
    mesh = F.transform(m["MeshHeadingList"]["MeshHeading"], lambda h: h["DescriptorName"]["_VALUE"])
    found = raw.select(m["PMID"]["_VALUE"].alias("pmid"), m["Article"]["ArticleTitle"].alias("title"), abstract.alias("abstract"), F.coalesce(mesh, F.array().cast("array<string>")).alias("mesh"))
    return found.filter(F.coalesce("abstract", F.lit("")) != "")
