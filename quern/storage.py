"""Intermediate tables that outlive an executor.

Lineage is cut by writing Parquet into the folder that the cluster shares
(``spark.checkpoint.dir``).  Reading it back starts a new lineage from files
every executor sees, so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_KEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; where none is set, a temporary one if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _OWN[app]


def reserve(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with the intermediate tables."""
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def held(path: str) -> bool:
    """Whether a reserved path has not been released yet."""
    return any(path == p for _, p in _WRITTEN)


def materialize(df: DataFrame, name: str = "table", *, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it; with ``keep`` it outlives the :func:`scope` it is written in."""
    spark = df.sparkSession
    path = reserve(spark, name)
    if keep:
        _KEPT.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside go at the end, but for those to keep; other results are to be written or collected before."""
    before = {path for _, path in _WRITTEN}
    try:
        yield
    finally:
        _delete([x for x in _WRITTEN if x[0] is spark and x[1] not in before | _KEPT])


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands Python at most ``rows`` rows at a time: for wide rows, of which a usual batch fills a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has fewer partitions than there are cores; else as it is.

    A small table in a single file is otherwise worked off by one core.  Plans with a
    shuffle are left alone: counting their partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` by ``columns`` over all shuffle partitions: groups and windows by these stay there, and few rows that become many are not put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for owner, path in tables:
        with contextlib.suppress(Exception):
            jvm = owner.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN[:] = [x for x in _WRITTEN if x not in tables]


def release(spark: SparkSession | None = None) -> None:
    """Delete what :func:`materialize` has written (all of it at exit)."""
    _delete([x for x in _WRITTEN if spark is None or x[0] is spark])


atexit.register(release)
