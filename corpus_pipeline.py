"""The document pipeline: five operators in a row, from raw documents to a mix.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet
and read again as the next stage's documents.  All but the last return the columns of
``documents``, whatever further columns there are and whatever their names.

Defined cases: a null text counts as empty everywhere: it scores the base rate of
toxicity, has no lines to lose, has fingerprint zero (so one document of those without
words stays), holds no test item and takes part in the mix with size 0.  A null id is an id
of its own that comes first among lines and last among near copies.  Rows that repeat
both id and text are one document to line dedup and near-dedup, and one of them stays; rows
that repeat an id with other texts are judged one by one.  Of near copies the smallest id
stays, of equal ids the smaller hash of the text.  An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, lines, mixing, simhash, toxicity
from quern.storage import materialize, scope
from quern.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that occur before go; a document of nothing else goes too."""
    return lines.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts within 4 bits, or of a similarity of 0.8 in five-word shingles."""
    return simhash.keep_one(docs, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixing.mix(docs).documents


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's intermediate tables go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
