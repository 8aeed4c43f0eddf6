"""Citations: which documents an answer cites, and how well they carry it.

The entailment score is a hook ``(premise, hypothesis) -> Column`` from 0 to 1; its
stand-in is the share of the hypothesis' distinct words that the premise holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.text import quantised

Entails = Callable[[Column, Column], Column]


def word_share(premise: Column, hypothesis: Column) -> Column:
    asked = F.array_distinct(T.ws_tokens(hypothesis))
    return F.size(F.array_intersect(asked, T.ws_tokens(premise))) / F.greatest(F.size(asked), F.lit(1))


def citable(docs: DataFrame) -> DataFrame:
    """qid, number (from 1), pmid, title, content (300 characters): documents with a numeric id, each id once, in order."""
    numeric = docs.withColumn("pmid", F.trim("pmid")).filter(F.rlike("pmid", F.lit("^[0-9]+$")))
    first = numeric.withColumn("_k", F.row_number().over(Window.partitionBy("qid", "pmid").orderBy("rank"))).filter("_k = 1")
    return first.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("number"), "pmid", "title", F.substring("content", 1, 300).alias("content"))


def references(cited: DataFrame) -> DataFrame:
    """qid, block: the numbered list of references."""
    line = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")), F.lit(". PMID: "), "pmid", F.lit(" — https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"])
    return cited.groupBy("qid").agg(F.concat(F.lit("\n\nReferences:\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("block"))


def statements(answers: DataFrame) -> DataFrame:
    """qid, at, statement, number: each statement of ten characters or more with each number it cites (null if none)."""
    each = answers.select("qid", F.posexplode(F.split(T.strip(F.col("answer")), r"(?<=[.!?])\s+")).alias("at", "s"))
    marked = each.select("qid", "at", T.without_marks(F.col("s")).alias("statement"), T.citation_marks(F.col("s")).alias("marks")).filter(F.length("statement") >= 10)
    return marked.select("qid", "at", "statement", F.explode_outer("marks").alias("number"))


def citation_scores(answers: DataFrame, cited: DataFrame, entails: Entails = word_share, threshold: float = 0.5) -> DataFrame:
    """qid, n_statements, n_citations, recall, precision.

    Recall: statements that their cited documents together entail.  Precision:
    citations whose document alone entails the statement.
    """
    pairs = statements(answers).join(cited.select("qid", "number", "content"), ["qid", "number"], "left")
    alone = F.when(F.col("content").isNotNull() & (entails(F.col("content"), F.col("statement")) > threshold), 1).otherwise(0)
    each = pairs.groupBy("qid", "at", "statement").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "content"))), lambda x: F.coalesce(x["content"], F.lit(""))), " ").alias("together"),
        F.count("content").alias("n_cited"), F.sum(alone).alias("n_right"))
    carried = F.when((F.col("n_cited") > 0) & (entails(F.col("together"), F.col("statement")) > threshold), 1.0).otherwise(0.0)
    return each.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_statements"), F.sum("n_cited").alias("n_citations"), quantised(F.avg(carried)).alias("recall"),
        quantised(F.coalesce(F.try_divide(F.sum("n_right"), F.sum("n_cited")), F.lit(0.0))).alias("precision"))


def graded_scores(answers: DataFrame, docs: DataFrame, entails: Entails = word_share, most_sentences: int = 8, most_docs: int = 5) -> DataFrame:
    """qid, recall, precision, f1 of answers against their first documents (400 characters each).

    Recall of a sentence: 1 above 0.6, a half above 0.3.  Precision: documents that give any sentence more than 0.3.
    """
    sentences = answers.select("qid", F.posexplode(F.slice(T.sentences(F.col("answer")), 1, most_sentences)).alias("at", "sentence"))
    first = docs.filter(F.col("rank") < most_docs).select("qid", "rank", F.substring("content", 1, 400).alias("doc"))
    scored = sentences.join(first, "qid").withColumn("e", entails(F.col("doc"), F.col("sentence")))
    per_sentence = scored.groupBy("qid", "at").agg(F.max("e").alias("e")).groupBy("qid").agg(F.avg(F.when(F.col("e") > 0.6, 1.0).when(F.col("e") > 0.3, 0.5).otherwise(0.0)).alias("recall"))
    per_doc = scored.groupBy("qid", "rank").agg(F.max("e").alias("e")).groupBy("qid").agg(F.avg(F.when(F.col("e") > 0.3, 1.0).otherwise(0.0)).alias("precision"))
    both = per_sentence.join(per_doc, "qid")
    f1 = F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision"))
    return both.select("qid", quantised(F.col("recall")).alias("recall"), quantised(F.col("precision")).alias("precision"), quantised(f1).alias("f1"))


def reasoning_scores(records: DataFrame, entails: Entails = word_share) -> DataFrame:
    """``records(context, reasoning, label, ...)`` with faithfulness and grounding.

    Faithfulness: the reasoning (512 characters) entails that the label is the answer.
    Grounding: the context (512) entails the reasoning (256).  Without a text both are null.
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    answer = F.concat(F.lit("The answer to this medical question is: "), text("label"), F.lit("."))
    said = text("reasoning")
    faithful = F.when(said.isNotNull() & answer.isNotNull(), entails(F.substring(said, 1, 512), answer))
    grounded = F.when(said.isNotNull() & text("context").isNotNull(), entails(F.substring(text("context"), 1, 512), F.substring(said, 1, 256)))
    return records.withColumn("faithfulness", quantised(faithful)).withColumn("grounding", quantised(grounded))
