"""Incremental runs: what is done is skipped, in batches or as a stream.

A batch run anti-joins the finished ids.  A stream reads new files as they come; its
checkpoint remembers what was read, and each micro-batch is written under its own
number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery


def pending(questions: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Questions without a finished record."""
    return questions.join(done.select(key).distinct(), key, "left_anti")


LEDGER = "name string, status string, n long, at timestamp"


def record(ledger: str, entries: DataFrame) -> None:
    """Append entries(name, status, n, at) of files or shards to the ledger, a Parquet folder."""
    entries.select("name", "status", F.col("n").cast("long").alias("n"), F.col("at").cast("timestamp").alias("at")).write.mode("append").parquet(ledger)


def state(spark: SparkSession, ledger: str) -> DataFrame:
    """name, status, n, at: each name's last entry; of entries of one time the greater status."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    last = F.max(F.struct("at", "status", "n")).alias("last")
    return spark.read.schema(LEDGER).parquet(ledger).groupBy("name").agg(last).select("name", "last.status", "last.n", "last.at")


def open_files(files: DataFrame, ledger_state: DataFrame, finished: str = "done") -> DataFrame:
    """The files(name, ...) that the ledger does not know as finished: new, failed or broken off."""
    return files.join(ledger_state.filter(F.col("status") == finished).select("name"), "name", "left_anti")


def run_stream(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Apply ``work`` to new Parquet files under ``source``, exactly once, and stop when all are done."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_records(rows: DataFrame, key: str, expire: str | None = None) -> DataFrame:
    """The first row of each ``key`` of a stream; rows that come again, in the same batch, a later one or a replayed file, are left out.

    What has been seen is keyed state of the stream's checkpoint, over partitions by key; with ``expire`` (as "7 days") a key is
    forgotten that long after its row, and may come again.  On rows that are no stream the first is any one of a key.
    """
    if not rows.isStreaming:
        return rows.dropDuplicates([key])
    ttl = None if expire is None else int(pd.Timedelta(expire).total_seconds() * 1000)

    class First(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", "n long", ttl)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            for batch in rows:
                if len(batch) and not self.seen.exists():
                    self.seen.update((1,))
                    yield batch.iloc[:1]

        def close(self) -> None:
            pass

    mode = "None" if ttl is None else "ProcessingTime"
    return rows.groupBy(key).transformWithStateInPandas(First(), outputStructType=rows.schema, outputMode="Append", timeMode=mode)


def answer_once(requests: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame], memo: str, checkpoint: str) -> StreamingQuery:
    """Answers of a stream of requests, each ``key`` asked for once however often it comes, kept by batch below ``memo``."""

    def batch(df: DataFrame, number: int) -> None:
        answer(df).write.mode("overwrite").parquet(f"{memo}/batch={number}")

    return first_records(requests, key).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of ``events(ts, event_type, value)`` in tumbling windows; late rows up to ``late`` count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
