"""Records of a REST service by id, as a Python data source behind a cache.

``spark.read.format("rest_records")`` asks for a list of ids in requests of ``SIZE``, one partition a request, and tries a request
that fails again after growing pauses.  A service is a *transport*: an object whose ``fetch(ids)`` returns records (id, title, abstract)
and raises :class:`Unavailable` where another try may help.  There is no network here; :class:`Folder` answers
from a folder of JSON files and counts its requests in it, as a service's log would.

:func:`lookup` answers from a cache table keyed by the MD5 of the request, asks the service for the rest only and adds its
answers to the table.  Ids without a record are remembered as such.  Up to ``most`` ids become a list for the data source; more are
asked where they are, in requests of the same size.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quern.sources.search import request_key
from quern.storage import materialize

SIZE = 50
SCHEMA = "id string, title string, abstract string"
CACHE = f"cache_key string, {SCHEMA}"


class Unavailable(Exception):
    """The service did not answer; it may later."""


class Transport(Protocol):
    def fetch(self, ids: list[str]) -> list[dict]: ...


@dataclass(frozen=True)
class Folder:
    """A stand-in service: ``shard=NNN/*.json`` below ``root`` hold the records of the ids with that crc32 modulo ``shards``.

    ``root`` must be a folder that Python can open on every worker.  Each request leaves a file in ``root/log``; the first
    ``failures`` tries of a request fail.
    """

    root: str
    shards: int = 64
    failures: int = 0

    @staticmethod
    def fill(records: DataFrame, root: str, shards: int = 64) -> None:
        """Lay out records (id, title, abstract)."""
        rows = records.withColumn("shard", F.crc32(F.col("id").cast("binary")) % shards)
        rows.repartition("shard").write.mode("overwrite").partitionBy("shard").json(root)

    def _path(self, *parts: str) -> str:
        return os.path.join(self.root.removeprefix("file:").replace("///", "/"), *parts)

    def _log(self, what: str) -> None:
        os.makedirs(self._path("log"), exist_ok=True)
        with open(self._path("log", f"{what}-{uuid.uuid4().hex}"), "w"):
            pass

    def _logged(self, what: str) -> int:
        return sum(x.startswith(what) for x in os.listdir(self._path("log"))) if os.path.isdir(self._path("log")) else 0

    def requests(self) -> int:
        """The number of answered requests so far."""
        return self._logged("answer")

    def fetch(self, ids: list[str]) -> list[dict]:
        import zlib

        name = f"{zlib.crc32(json.dumps(ids).encode()):08x}"
        if self._logged(f"failure-{name}") < self.failures:
            self._log(f"failure-{name}")
            raise Unavailable(name)
        self._log(f"answer-{name}")
        found, wanted = [], set(ids)
        for shard in sorted({zlib.crc32(i.encode()) % self.shards for i in ids}):
            folder = self._path(f"shard={shard}")
            for file in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
                if file.endswith(".json"):
                    with open(os.path.join(folder, file), encoding="utf-8") as lines:
                        found += [r for r in map(json.loads, lines) if r["id"] in wanted]
        return found


def ask(transport: Transport, ids: list[str], tries: int, pause: float) -> list[tuple]:
    """(id, title, abstract) of one request, tried up to ``tries`` times; ids without a record have nulls."""
    for n in range(tries):
        try:
            found = {r["id"]: r for r in transport.fetch(ids)}
            return [(i, found.get(i, {}).get("title"), found.get(i, {}).get("abstract")) for i in ids]
        except Unavailable:
            if n + 1 == tries:
                raise
            time.sleep(pause * 2**n)
    return []


@dataclass
class Request(InputPartition):
    ids: list[str]

    def __init__(self, ids: list[str]):
        self.ids = ids


class Records(DataSource):
    """Options: ``ids`` (a JSON list), ``root`` and ``shards`` of the folder service, ``size``, ``tries``, ``pause`` (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "rest_records"

    def schema(self) -> str:
        return SCHEMA

    def transport(self) -> Transport:
        return Folder(self.options["root"], int(self.options.get("shards", 64)), int(self.options.get("failures", 0)))

    def reader(self, schema: StructType) -> DataSourceReader:
        options = self.options
        return RecordsReader(self.transport(), json.loads(options.get("ids", "[]")), int(options.get("size", SIZE)), int(options.get("tries", 4)), float(options.get("pause", 0.5)))


class RecordsReader(DataSourceReader):
    def __init__(self, transport: Transport, ids: list[str], size: int, tries: int, pause: float):
        self.transport, self.ids, self.size, self.tries, self.pause = transport, ids, size, tries, pause

    def partitions(self) -> list[InputPartition]:
        return [Request(self.ids[i : i + self.size]) for i in range(0, len(self.ids), self.size)] or [Request([])]

    def read(self, partition: Request) -> Iterator[tuple]:
        yield from ask(self.transport, partition.ids, self.tries, self.pause) if partition.ids else []


def _asked_in_place(ids: DataFrame, transport: Transport, tries: int, pause: float) -> DataFrame:
    """The same requests, of ids that stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SIZE):
                rows = ask(transport, batch.column(0).slice(at, SIZE).to_pylist(), tries, pause)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["id", "title", "abstract"])

    return ids.mapInArrow(run, SCHEMA)


def _cached(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except Exception as e:  # the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def lookup(ids: DataFrame, service: Folder, cache: str, *, db: str = "pubmed", most: int = 100_000, tries: int = 4, pause: float = 0.5) -> DataFrame:
    """cache_key, id, title, abstract of every distinct id of ``ids(id)``: from the table at ``cache``, else from the service."""
    spark = ids.sparkSession
    key = request_key("fetch", db, F.col("id"), 1)
    wanted = materialize(ids.filter("id is not null").select(F.col("id").cast("string").alias("id")).distinct().withColumn("cache_key", key), "wanted")
    missing = materialize(wanted.join(_cached(spark, cache).select("cache_key"), "cache_key", "left_anti").select("id"), "missing")
    n = missing.count()
    if 0 < n <= most:
        spark.dataSource.register(Records)
        options = {k: str(v) for k, v in asdict(service).items()} | {"ids": json.dumps(sorted(r.id for r in missing.collect())), "tries": str(tries), "pause": str(pause)}
        found = spark.read.format("rest_records").options(**options).load()
    elif n:
        found = _asked_in_place(missing, service, tries, pause)
    if n:
        found.withColumn("cache_key", key).select("cache_key", "id", "title", "abstract").write.mode("append").parquet(cache)
    return _cached(spark, cache).join(wanted.select("cache_key"), "cache_key", "left_semi")
