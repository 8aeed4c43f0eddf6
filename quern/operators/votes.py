"""Votes of several models on one question, and the verdict.

Votes are rows of (id, vote_idx, model, choice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import materialize


def tally(votes: DataFrame) -> DataFrame:
    """id, choice, n, first: one row for each choice of a question."""
    return votes.groupBy("id", "choice").agg(F.count(F.lit(1)).alias("n"), F.min("vote_idx").alias("first"))


def majority(votes: DataFrame) -> DataFrame:
    """id, choice, n_votes, n_winner, n_choices, vote_distribution: the most frequent choice, of equals the one cast first."""
    order = F.struct(F.col("n").alias("n"), (-F.col("first")).alias("early"))
    return tally(votes).groupBy("id").agg(
        F.max_by("choice", order).alias("choice"), F.sum("n").alias("n_votes"), F.max("n").alias("n_winner"), F.count(F.lit(1)).alias("n_choices"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("choice", "n")))).alias("vote_distribution"),
    )


def ensemble(votes: DataFrame, *, undecided: str = "C", options: int = 3) -> DataFrame:
    """As :func:`majority`, but a vote split three ways among three options is ``undecided``."""
    split = (F.col("n_choices") == options) & (F.col("n_votes") == options)
    return majority(votes).withColumn("choice", F.when(split, F.lit(undecided)).otherwise(F.col("choice")))


def below_threshold(verdicts: DataFrame, share: float = 0.67, instead: str = "C") -> DataFrame:
    """Verdicts whose winner has less than ``share`` of the votes become ``instead``."""
    return verdicts.withColumn("choice", F.when(F.col("n_winner") / F.col("n_votes") < share, F.lit(instead)).otherwise(F.col("choice")))


def assign_models(questions: DataFrame, models: list[str], n_votes: int = 3) -> DataFrame:
    """id, vote_idx, model: votes dealt to the models in turn."""
    names = F.array(*[F.lit(m) for m in models])
    return questions.select("id", F.explode(F.sequence(F.lit(0), F.lit(n_votes - 1))).alias("vote_idx")).withColumn("model", F.get(names, F.col("vote_idx") % len(models)))


def rerun_until_match(verdicts: DataFrame, rerun, tries: int = 3) -> DataFrame:
    """``verdicts(id, choice, ...)`` with ``trace`` and ``runs``: a run whose choice is the verdict's gives the trace.

    ``rerun(rows, turn)`` takes the rows without a match so far and returns (id, trace, choice);
    after ``tries`` runs without a match one more run is taken as it is.
    """
    left, done = verdicts, None
    for turn in range(tries + 1):
        got = rerun(left, turn).select(F.col("id").alias("_id"), F.col("trace"), F.col("choice").alias("_choice"))
        ran = materialize(left.join(got, F.col("id") == F.col("_id")).withColumn("runs", F.lit(turn + 1)), "runs")
        match = F.col("choice").eqNullSafe(F.col("_choice")) | F.lit(turn == tries)
        hit = ran.filter(match).drop("_id", "_choice")
        done = hit if done is None else done.unionByName(hit)
        left = ran.filter(~match).select(*verdicts.columns)
        if turn < tries and left.isEmpty():
            break
    return done


# The judge's measures and what each is without an answer.
JUDGED = ("M5_ADeQ_score", "M7_Context_Utilization", "M8_Hallucination", "M9_Context_Relevancy")


def judged(records: DataFrame, judge, tries: int = 3) -> DataFrame:
    """``records(id, prompt, ...)`` with the judge's measures; an empty answer is asked for again, up to ``tries`` times.

    The measures are read from the text between the first and the last brace; what cannot be read is 0.
    """
    left, done = records, None
    for turn in range(tries):
        asked = materialize(left.withColumn("answer", judge(F.col("prompt"))), "judged")
        empty = (F.coalesce(F.col("answer"), F.lit("")) == "") & F.lit(turn < tries - 1)
        hit = asked.filter(~empty)
        done = hit if done is None else done.unionByName(hit)
        left = asked.filter(empty).drop("answer")
        if left.isEmpty():
            break
    block = F.regexp_extract(F.coalesce("answer", F.lit("")), r"(?s)\{.*\}", 0)
    return done.select(*records.columns, *[F.coalesce(F.get_json_object(block, f"$.{m}").try_cast("double"), F.lit(0.0)).alias(m) for m in JUDGED])
