"""Sinks: corpora, vector shards, run records and their envelopes, tables as text."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.storage import materialize

LEDGER = "name string, batch string, at timestamp"


def write_first_wins(df: DataFrame, path: str, keys: list[str], *order: str) -> None:
    """A table without repeated keys: the first row by ``order`` stays, as an insert that ignores conflicts keeps it."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    df.withColumn("_k", nth).filter("_k = 1").drop("_k").write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class FirstWins:
    """A table that batches are inserted into, one after the other, and in which the first row of a key stays.

    Rows lie in ``buckets`` by the hash of their key, and a batch is compared with the buckets it touches only.  A batch's rows are
    written first and its line in the ledger last: what the ledger does not name is never read, so an insert that fails leaves
    the table as it was and can be done again; a batch whose name is in the ledger is not inserted twice.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def ledger(self) -> DataFrame:
        """name, batch, at (time of the insert) of all inserted batches."""
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER)

    def _data(self) -> DataFrame | None:
        batches = sorted(r.batch for r in self.ledger().select("batch").collect())
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/batch={b}" for b in batches]) if batches else None

    def read(self) -> DataFrame | None:
        """The table, or None before the first insert."""
        data = self._data()
        return None if data is None else data.drop("batch", "bucket")

    def write(self, df: DataFrame, batch: str, *order: str) -> None:
        """The rows of the batch whose keys are new, without an entry in the ledger."""
        nth = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = materialize(df.withColumn("_k", nth).filter("_k = 1").drop("_k").withColumn("bucket", bucket), "batch")
        held = self._data()
        if held is not None:
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
            known = held.filter(F.col("bucket").isin(touched)).select(*[F.col(k).alias(f"_{k}") for k in self.keys])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
            rows = rows.join(known, reduce(lambda a, b: a & b, same), "left_anti")
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")

    def insert(self, df: DataFrame, name: str, *order: str) -> bool:
        """Insert the batch ``name``; of its rows of one key the first by ``order`` counts.  False if it was inserted before."""
        if not self.ledger().filter(F.col("name") == name).isEmpty():
            return False
        batch = uuid.uuid4().hex
        self.write(df, batch, *order)
        self.spark.range(1).select(F.lit(name).alias("name"), F.lit(batch).alias("batch"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return True


def write_corpus(df: DataFrame, path: str, per_file: int = 1000) -> None:
    """JSON lines, ``per_file`` documents to a file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", per_file).json(path)


def write_vectors(df: DataFrame, path: str, per_shard: int = 50_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", per_shard).parquet(path)


def merge_vectors(shards: DataFrame, index: str, metadata: str, per_file: int = 50_000) -> None:
    """Shards(vec_id, embedding, ...) as one index (pos, vec_id, embedding) in the order of their ids, and metadata as JSON (pos, vec_id, ...).

    Positions come from the counts of sorted partitions, so no task numbers the whole table.
    """
    spark = shards.sparkSession
    held = materialize(shards.filter("vec_id is not null").repartitionByRange("vec_id").sortWithinPartitions("vec_id").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "shards")
    sizes = sorted((r["_part"], r.n, r.low) for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low")).collect())
    offsets, total = [], 0
    for part, n, low in sizes:
        offsets.append((part, total - low))
        total += n
    placed = held.join(F.broadcast(spark.createDataFrame(offsets, "_part int, _offset long")), "_part").withColumn("pos", F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")
    placed.select("pos", "vec_id", "embedding").write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(index)
    placed.select("pos", *[c for c in shards.columns if c != "embedding"]).write.mode("overwrite").json(metadata)


def append_records(df: DataFrame, path: str, run_id: str) -> None:
    """Result records of one run, appended below its own partition."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def envelope(records: DataFrame, n_questions: int) -> DataFrame:
    """run_id, progress, complete, accuracy (over all questions), one row a run."""
    counts = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("correct"), 1)).alias("k"))
    return counts.select("run_id", F.concat_ws("/", F.col("n").cast("string"), F.lit(str(n_questions))).alias("progress"), (F.col("n") >= n_questions).alias("complete"), (F.col("k") / F.lit(max(n_questions, 1))).alias("accuracy"))


def export_contexts(records: DataFrame, path: str, kind: str = "other") -> None:
    """Records whose context is of one kind, as JSON."""
    from quern.operators.metrics import context_class

    records.filter(context_class(F.col("retrieved_context")) == kind).write.mode("overwrite").json(path)


def text_table(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table with padded columns (at most ``limit`` rows: it is for reading)."""
    got = [[("" if v is None else str(v)) for v in r] for r in rows.limit(limit).collect()]
    widths = [max(len(c), *(len(r[i]) for r in got)) if got else len(c) for i, c in enumerate(rows.columns)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    return "\n".join([line(rows.columns), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, got)])
