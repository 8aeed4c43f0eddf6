"""Models loaded once a worker, bounded top-k plans, and state that outlives a stream's run."""

import os

from pyspark.sql import functions as F

from quern import hooks
from quern.operators import retrieval, vectors
from quern.streaming import resume


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import uuid

        with open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w"):
            pass
        return lambda texts: [float(len(t or "")) + 1000 * (len(texts) > 7) for t in texts]

    model = hooks.batched(load, "double", rows=7)
    for _ in range(3):
        rows = spark.range(0, 400, 1, 16).select("id", model(F.repeat(F.lit("x"), F.col("id").cast("int") % 5)).alias("n")).collect()
        assert all(r.n == r.id % 5 for r in rows)
    loads = [x.split("-")[0] for x in os.listdir(folder)]
    assert len(loads) == len(set(loads)) and 1 <= len(loads) <= 16


def test_stand_ins(spark):
    df = spark.createDataFrame([("a Bee e", "bee x"), (None, None)], "t string, c string")
    got = df.select(hooks.batched(hooks.letter_encoder, "array<double>")(F.col("t")).alias("v"), hooks.batched(hooks.shared_words, "double")(F.col("t"), F.col("c")).alias("s")).collect()
    assert got[0].v[:5] == [1.0, 1.0, 0.0, 0.0, 3.0] and [r.s for r in got] == [0.5, 0.0] and got[1].v == [0.0] * 26


def test_first_rows_are_cut_before_the_shuffle(spark, capsys):
    rows = spark.range(100).select((F.col("id") % 3).alias("qid"), F.col("id").alias("vec_id"), F.rand(1).alias("score"))
    for plan in (retrieval.top(rows, 5, F.asc("vec_id")), vectors.merge_ranked(rows, 5)):
        plan.explain()
        assert "WindowGroupLimit" in capsys.readouterr().out


def test_one_record_an_id(spark, tmp_path):
    """Files that repeat ids, or come again, over several runs of the stream: every id once."""
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    asked = []

    def answer(df):
        asked.extend(r.id for r in df.collect())
        return df.withColumn("answer", F.upper("text"))

    put = lambda ids, name: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").coalesce(1).write.parquet(f"{source}/{name}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for ids, name in (([1, 2, 2, 3], "a"), ([3, 4, 1], "b"), ([1, 2, 2, 3], "again"), ([5], "c")):
            put(ids, name)
            stream = spark.readStream.schema("id long, text string").parquet(f"{source}/*")
            resume.answer_once(stream, "id", answer, sink, state).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(asked) == [1, 2, 3, 4, 5]
    assert sorted((r.id, r.answer) for r in spark.read.parquet(sink).collect()) == [(i, f"T{i}") for i in range(1, 6)]
    assert resume.first_records(spark.createDataFrame([(1,), (1,), (2,)], "id long"), "id").count() == 2
