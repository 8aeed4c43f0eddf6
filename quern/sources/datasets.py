"""Benchmark loaders: question records (id, question, options, answer, label) from each format.

Each ``from_*`` function takes the raw rows as a DataFrame, so that it works on any
reader; ``read_*`` opens the files.  Malformed rows are dropped by the readers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = ("A", "B", "C", "D", "E")
SUPPORT_OPTIONS = ("Supported", "Refuted", "Not enough information")


def _options(*pairs: tuple[str, Column]) -> Column:
    """A map of the options that are not empty."""
    filled = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in pairs]))
    return F.map_from_entries(filled)


def _fixed(*texts: str) -> Column:
    return F.create_map(*[x for k, t in zip(LETTERS, texts, strict=False) for x in (F.lit(k), F.lit(t))])


def from_medqa(rows: DataFrame) -> DataFrame:
    """rows: id, question, A..E, answer_idx.  An answer that is no option becomes the first option's key, else A."""
    options = _options(*[(k, F.col(k)) for k in LETTERS])
    key = F.upper(F.trim(F.coalesce("answer_idx", F.lit(""))))
    first = F.get(F.array_sort(F.map_keys("options")), F.lit(0))
    return rows.withColumn("options", options).select("id", "question", "options", F.when(F.array_contains(F.map_keys("options"), key), key).otherwise(F.coalesce(first, F.lit("A"))).alias("answer"))


def from_medmcqa(rows: DataFrame) -> DataFrame:
    """rows: id, question, opa..opd, cop (0 to 3).  Other numbers are A."""
    letter = F.coalesce(F.when(F.col("cop").between(0, 3), F.char(65 + F.col("cop"))), F.lit("A"))
    return rows.select("id", "question", _options(*[(k, F.col(f"op{k.lower()}")) for k in "ABCD"]).alias("options"), letter.alias("answer"))


def from_pubmedqa(rows: DataFrame) -> DataFrame:
    """rows: id, question, final_decision.  yes is A, no is B, all else C."""
    low = F.lower(F.trim(F.coalesce("final_decision", F.lit(""))))
    return rows.select("id", "question", _fixed("yes", "no", "maybe").alias("options"), F.when(low == "yes", "A").when(low == "no", "B").otherwise("C").alias("answer"))


def from_mmlu(rows: DataFrame) -> DataFrame:
    """rows: id, question, choices (array), answer (place from 0)."""
    entries = F.transform("choices", lambda c, i: F.struct(F.char(65 + i).alias("key"), c.alias("value")))
    return rows.select("id", "question", F.map_from_entries(entries).alias("options"), F.char(65 + F.col("answer")).alias("answer"))


def from_bioasq(rows: DataFrame) -> DataFrame:
    """rows: id, body, type, exact_answer (string or the first of a list).  Yes-no questions with a clear answer only."""
    exact = F.lower(F.trim(F.col("exact_answer")))
    kept = rows.filter((F.col("type") == "yesno") & exact.isin("yes", "no"))
    return kept.select("id", F.col("body").alias("question"), _fixed("Yes", "No").alias("options"), F.when(exact == "yes", "A").otherwise("B").alias("answer"), exact.alias("label"))


def from_medchangeqa(rows: DataFrame) -> DataFrame:
    """rows: ord, question, newest_label.  Three labels only; ids number the kept rows from 0."""
    names = {"SUPPORTED": "A", "REFUTED": "B", "NOT ENOUGH INFORMATION": "C"}
    up = F.upper(F.trim(F.col("newest_label")))
    kept = rows.filter(F.col("question").isNotNull() & up.isin(*names))
    letter = F.coalesce(*[F.when(up == n, F.lit(k)) for n, k in names.items()])
    numbered = kept.select("*", (F.row_number().over(Window.orderBy("ord")) - 1).alias("_i"))
    return numbered.select(F.concat(F.lit("q_"), F.col("_i").cast("string")).alias("id"), "question", _fixed(*SUPPORT_OPTIONS).alias("options"), letter.alias("answer"), up.alias("label"))


def from_scifact(rows: DataFrame) -> DataFrame:
    """rows: ord, id, claim, evidence_label.  Of rows that repeat an id the first labelled one, else the first."""
    labelled = F.coalesce("evidence_label", F.lit("")) != ""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.when(labelled, 0).otherwise(1), "ord"))).filter("_k = 1")
    up = F.upper(F.trim(F.coalesce("evidence_label", F.lit(""))))
    return first.select("id", F.col("claim").alias("question"), _fixed(*SUPPORT_OPTIONS).alias("options"), F.when(up == "SUPPORT", "A").when(up == "CONTRADICT", "B").otherwise("C").alias("answer"))


def from_healthfc(rows: DataFrame) -> DataFrame:
    """rows: id, en_claim, label as text or number; what is neither true nor false is C."""
    low = F.lower(F.trim(F.col("label").cast("string")))
    letter = F.when(low.isin("true", "supported", "support", "correct", "0"), "A").when(low.isin("false", "refuted", "refute", "incorrect", "2"), "B").otherwise("C")
    return rows.select("id", F.col("en_claim").alias("question"), _fixed("True", "False", "Mixture").alias("options"), letter.alias("answer"))


def from_medqa_nested(rows: DataFrame) -> DataFrame:
    """rows: id, question, options (map), answer_idx, answer.  The key as given, else the answer's text."""
    return rows.select("id", "question", "options", F.coalesce("answer_idx", "answer", F.lit("")).alias("answer"))


def from_bioasq_any(rows: DataFrame) -> DataFrame:
    """rows: id, body, type, exact_answer, ideal_answer.  All questions: yes-no ones with options, others with the ideal answer and none."""
    yesno = F.coalesce("type", F.lit("yesno")) == "yesno"
    no_options = F.lit(None).cast("map<string,string>")
    answer = F.when(yesno, F.when(F.coalesce("exact_answer", F.lit("yes")) == "yes", "A").otherwise("B")).otherwise(F.coalesce("ideal_answer", F.lit("")))
    return rows.select("id", F.coalesce("body", F.lit("")).alias("question"), F.when(yesno, _fixed("yes", "no")).otherwise(no_options).alias("options"), answer.alias("answer"), F.coalesce("type", F.lit("yesno")).alias("type"))


# --- Files ---------------------------------------------------------------------------------------

#: The subjects of the medical part of MMLU.
MMLU_SUBJECTS = ("anatomy", "clinical_knowledge", "college_biology", "college_medicine", "medical_genetics", "professional_medicine")


def _lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The file's lines as records of ``fields``, with ``ord``, the line's number from 0; lines that are no such object are left out.

    Benchmark files have some thousand lines, so that one task numbers them.
    """
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    lines = spark.read.text(path).select("value", *[c.alias(f"_{i}") for i, c in enumerate(place)])
    numbered = lines.select("value", (F.row_number().over(Window.orderBy("_0", "_1", "_2")) - 1).alias("ord"))
    return numbered.select("ord", F.from_json("value", fields).alias("r")).select("ord", "r.*")


def _limited(rows: DataFrame, most: int | None) -> DataFrame:
    """The records of the first ``most`` lines."""
    return rows if most is None else rows.filter(F.col("ord") < most)


def _id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.coalesce(F.col("id"), F.col("ord").cast("string")))


def read_medqa(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """MedQA from JSON lines, options under their letters or nested under ``options``; an id that is missing is the line's number."""
    rows = _id(_lines(spark, path, "id string, question string, A string, B string, C string, D string, E string, answer_idx string, answer string, options map<string, string>")).filter("question is not null")
    rows = _limited(rows, count)
    return from_medqa(rows.filter("options is null")).unionByName(from_medqa_nested(rows.filter("options is not null")))


def read_medmcqa(spark: SparkSession, path: str, most: int | None = 4183) -> DataFrame:
    return from_medmcqa(_limited(_id(_lines(spark, path, "id string, question string, opa string, opb string, opc string, opd string, cop int")), most).filter("question is not null"))


def read_pubmedqa(spark: SparkSession, path: str, most: int | None = 500) -> DataFrame:
    return from_pubmedqa(_limited(_id(_lines(spark, path, "id string, question string, final_decision string")), most).filter("question is not null"))


def read_mmlu(spark: SparkSession, path: str, subjects: tuple[str, ...] = MMLU_SUBJECTS) -> DataFrame:
    """The medical subjects of MMLU from JSON lines (``_sub`` names the subject; lines without one are kept)."""
    rows = _id(_lines(spark, path, "id string, question string, choices array<string>, answer int, _sub string")).filter("question is not null")
    return from_mmlu(rows.filter(F.col("_sub").isNull() | F.col("_sub").isin(*subjects)))


def _first(column: str) -> Column:
    """A field that is a string or a list of strings: the string, or the list's first."""
    return F.coalesce(F.get(F.from_json(column, "array<string>"), F.lit(0)), F.col(column))


def read_bioasq(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """Yes-no questions of a BioASQ file, one object with ``questions``."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "questions array<struct<id: string, body: string, type: string, exact_answer: string>>").alias("r"))
    rows = whole.select(F.posexplode("r.questions").alias("ord", "q")).select("ord", "q.*")
    kept = from_bioasq(_id(rows).withColumn("exact_answer", _first("exact_answer")))
    if count is None:
        return kept
    order = rows.select(F.coalesce("id", F.col("ord").cast("string")).alias("id"), "ord")
    return kept.join(order, "id").orderBy("ord").limit(count).drop("ord")


def read_bioasq_lines(spark: SparkSession, path: str, most: int | None = 500) -> DataFrame:
    """All question types of BioASQ from JSON lines."""
    rows = _limited(_id(_lines(spark, path, "id string, body string, type string, exact_answer string, ideal_answer string")), most).filter("body is not null")
    return from_bioasq_any(rows.withColumn("exact_answer", _first("exact_answer")).withColumn("ideal_answer", _first("ideal_answer")))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED").csv(path).withColumn("ord", F.monotonically_increasing_id())


def read_medchangeqa(spark: SparkSession, path: str) -> DataFrame:
    """From a table with the columns Question and Newest Label."""
    return from_medchangeqa(_csv(spark, path).select("ord", F.col("Question").alias("question"), F.col("`Newest Label`").alias("newest_label")))


def read_scifact(spark: SparkSession, path: str) -> DataFrame:
    return from_scifact(_csv(spark, path).select("ord", "id", "claim", "evidence_label"))


def read_healthfc(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """Rows with claim and label; ids number them from 0."""
    rows = _csv(spark, path).filter("en_claim is not null and label is not null")
    numbered = rows.withColumn("id", F.concat(F.lit(f"hfc_{split}_"), (F.row_number().over(Window.orderBy("ord")) - 1).cast("string")))
    return from_healthfc(numbered)


def first_percent(rows: DataFrame, percent: float, *order: str) -> DataFrame:
    """The first ceil(n * percent / 100) rows by ``order``."""
    return rows.orderBy(*order).limit(math.ceil(rows.count() * percent / 100))


def hash_split(rows: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """``rows`` with ``part`` (train or test): exactly floor(share * n) rows train, chosen by the md5 of the key.

    The threshold comes from counts of 4,096 hash buckets, and only the bucket it falls
    into is ranked, so no window holds the whole table.
    """
    hashed = rows.withColumn("_h", F.md5(F.col(key).cast("string")))
    bucket = F.substring("_h", 1, 3)
    wanted = int(rows.count() * share)
    before, edge = 0, None
    for r in hashed.groupBy(bucket.alias("b")).count().orderBy("b").collect():
        if before + r["count"] > wanted:
            edge = r.b
            break
        before += r["count"]
    if edge is None:
        return hashed.withColumn("part", F.lit("train")).drop("_h")
    inside = hashed.filter(bucket == edge).withColumn("_k", F.row_number().over(Window.orderBy("_h", key))).withColumn("part", F.when(F.col("_k") <= wanted - before, "train").otherwise("test")).drop("_k")
    rest = hashed.filter(bucket != edge).withColumn("part", F.when(bucket < edge, "train").otherwise("test"))
    return rest.unionByName(inside).drop("_h")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Corpus chunks from JSON lines: title, content, pmid (of any spelling), source, file_name; lines that are no object are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.from_json("value", "map<string, string>").alias("m"))
    field = lambda name: F.try_element_at("m", F.lit(name))
    some_id = F.coalesce(field("PMID"), field("pmid"), field("id"), F.lit(""))
    return lines.filter(F.size("m") > 0).select(field("title").alias("title"), field("content").alias("content"), some_id.alias("pmid"), field("source").alias("source"), "file_name")


RECORD = (
    "id string, question string, gt_answer string, gt_label string, pred_answer string, pred_label string, correct boolean, time_seconds double, atomic_propositions string,"
    " retrieved_context string, vote_distribution map<string, bigint>, reasoning_traces array<struct<model: string, vote_idx: int, step_by_step_thinking: string, choice: string>>"
)


def read_runs(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Result records of all run files: run, dataset (from the file name) and the record's columns; broken files are skipped."""
    from quern.functions.labels import dataset_of

    raw = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(_run_schema()).json(path)
    named = raw.select(F.col("_metadata.file_name").alias("run"), "results")
    if tag:
        named = named.filter(F.contains("run", F.lit(tag)))
    return named.select("run", dataset_of(F.col("run")).alias("dataset"), F.explode("results").alias("r")).select("run", "dataset", "r.*")


def _run_schema():
    return T.StructType([T.StructField("results", T.ArrayType(T.StructType.fromDDL(RECORD)))])


def broken_gzip(spark: SparkSession, path: str) -> DataFrame:
    """path, error of the gzip files that do not decompress; files are reported and never deleted."""
    import zlib
    from collections.abc import Iterator

    import pyarrow as pa

    def error(content: bytes) -> str | None:
        try:
            reader = zlib.decompressobj(31)
            for at in range(0, len(content), 1 << 20):
                reader.decompress(content[at : at + (1 << 20)])
            return None if reader.eof else "truncated"
        except zlib.error as e:
            return str(e)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([error(x.as_py()) for x in batch.column(1)], pa.string())], ["path", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(probe, "path string, error string").filter("error is not null")
