"""Evidence compression: sentences picked by maximal marginal relevance, and contexts.

Input pools are rows of (qid, rank, title, content); a query's sentences are a bounded
group (k documents), so the greedy picks run in one grouped Arrow function a query.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.stem import stem
from quern.hooks import Hooks
from quern.operators.retrieval import cosine_to, tfidf
from quern.storage import materialize


def pool_sentences(pool: DataFrame) -> DataFrame:
    """qid, rank, at, sentence of ``title. content``; ``at`` numbers a document's sentences from 0."""
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit(". "), "content")).otherwise(F.col("content"))
    return pool.select("qid", "rank", F.posexplode(T.sentences(titled)).alias("at", "sentence"))


def _numbered(pool: DataFrame) -> DataFrame:
    return pool_sentences(pool).withColumn("uid", F.col("rank").cast("long") * 1_000_000 + F.col("at"))


def _weighed(pool: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A pool's numbered sentences, and the TF-IDF weights of them and of the queries."""
    rows = materialize(_numbered(pool), "sentences")
    texts = rows.select(F.col("qid").alias("gid"), "uid", F.col("sentence").alias("text")).unionByName(queries.select(F.col("qid").alias("gid"), F.lit(-1).cast("long").alias("uid"), "text"))
    return rows, materialize(tfidf(texts), "weights")


def _relevant(rows: DataFrame, weights: DataFrame) -> DataFrame:
    scores = cosine_to(weights).withColumnRenamed("gid", "qid")
    return rows.join(scores, ["qid", "uid"], "left").withColumn("relevance", F.coalesce("cosine", F.lit(0.0))).drop("cosine")


def relevance(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, uid, rank, at, sentence, relevance: cosine of TF-IDF vectors to the query; 0 without a shared term."""
    return _relevant(*_weighed(pool, queries))


def budget(context_length: int = 32768, ratio: float = 0.4, least: int = 5) -> int:
    """How many sentences a context takes."""
    return max(least, int(context_length * ratio / 200))


def _picks(relevance: np.ndarray, rows: list[tuple[list[int], list[float]]], n_terms: int, weight: float, most: int) -> list[int]:
    """Greedy picks among rows of (term numbers, weights); ties go to the earlier row."""
    at = np.repeat(np.arange(len(rows)), [len(terms) for terms, _ in rows])
    terms, values = (np.array([x for row in rows for x in row[i]], kind) for i, kind in ((0, np.int64), (1, float)))
    left = np.ones(len(relevance), bool)
    nearest = np.full(len(relevance), -np.inf)
    picked: list[int] = []
    while left.any() and len(picked) < most:
        gain = relevance if not picked else weight * relevance - (1 - weight) * nearest
        best = int(np.argmax(np.where(left, gain, -np.inf)))
        picked.append(best)
        left[best] = False
        chosen = np.zeros(n_terms + 1)
        chosen[rows[best][0]] = rows[best][1]
        nearest = np.maximum(nearest, np.bincount(at, values * chosen[terms], len(relevance)))
    return picked


def mmr(pool: DataFrame, queries: DataFrame, *, weight: float = 0.7, context_length: int = 32768, ratio: float = 0.4, least: int = 5) -> DataFrame:
    """qid, pick (from 0), rank, at, sentence: the sentences picked, each with its turn."""
    rows, weights = _weighed(pool, queries)
    rows = _relevant(rows, weights)
    weights = weights.groupBy("gid", "uid").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    full = rows.join(weights.withColumnRenamed("gid", "qid"), ["qid", "uid"], "left")
    most = budget(context_length, ratio, least)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid").reset_index(drop=True)
        names: dict[str, int] = {}
        lists = [([names.setdefault(t, len(names)) for t in terms], list(values)) if terms is not None else ([], []) for terms, values in zip(group["terms"], group["weights"], strict=True)]
        chosen = _picks(group["relevance"].to_numpy(), lists, len(names), weight, most)
        return group.loc[chosen, ["qid", "rank", "at", "sentence"]].assign(pick=np.arange(len(chosen), dtype=np.int32))

    kind = rows.schema["qid"].dataType.simpleString()
    return full.groupBy("qid").applyInPandas(pick, f"qid {kind}, rank int, at int, sentence string, pick int").select("qid", "pick", "rank", "at", "sentence")


def compressed_context(picked: DataFrame, pool: DataFrame) -> DataFrame:
    """qid, context: the picked sentences in document order, documents numbered anew."""
    titles = pool.select("qid", "rank", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Unknown")).alias("title"))
    docs = picked.groupBy("qid", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"]), " ").alias("body")).join(titles, ["qid", "rank"])
    listed = docs.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "body"))).alias("docs"))
    part = lambda d, i: F.concat(F.lit("\nDocument ["), (i + 1).cast("string"), F.lit("] (Title: "), d["title"], F.lit(")  "), d["body"])
    return listed.select("qid", F.array_join(F.transform("docs", part), " ").alias("context"))


def raw_context(pool: DataFrame) -> DataFrame:
    """qid, context: all documents in order, one a line."""
    listed = pool.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "content"))).alias("docs"))
    part = lambda d, i: F.concat(F.lit("Document ["), (i + 1).cast("string"), F.lit("] (Title: "), d["title"], F.lit(") "), d["content"])
    return listed.select("qid", F.array_join(F.transform("docs", part), "\n").alias("context"))


def rouge_l(pairs: DataFrame, a: str = "answer", b: str = "reference", stemmed: bool = True) -> DataFrame:
    """``pairs`` with rouge_l: F1 of the longest common subsequence of words.

    Words are runs of a-z and 0-9 of the lower-case text; with ``stemmed`` those of more than
    three letters are stemmed, without it words are what blanks separate.
    """

    def words(text: str | None) -> list[str]:
        low = (text or "").lower()
        return [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", low)] if stemmed else low.split()

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> float:
            p, q = words(x), words(y)
            if not p or not q:
                return 0.0
            names = {w: i for i, w in enumerate(dict.fromkeys(q))}
            codes = np.array([names[w] for w in q])
            row = np.zeros(len(q) + 1, np.int32)
            for w in p:
                # One row of the recurrence at a time: the best of the diagonal plus one and all to the left.
                grown = np.where(codes == names.get(w, -1), row[:-1] + 1, row[1:])
                row[1:] = np.maximum.accumulate(grown)
            common = int(row[-1])
            return 2 * common / (len(p) + len(q))

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)])

    return pairs.withColumn("rouge_l", score(F.col(a), F.col(b)))


def model_similarity(pairs: DataFrame, hooks: Hooks, a: str = "answer", b: str = "reference") -> DataFrame:
    """``pairs`` with similarity, as the hook ``similarity`` scores answer and reference; null where either is missing."""
    if hooks.similarity is None:
        raise ValueError("a measure of similarity by a model needs the similarity hook")
    there = F.col(a).isNotNull() & F.col(b).isNotNull()
    return pairs.withColumn("similarity", F.when(there, hooks.similarity(F.col(a), F.col(b))).cast("double"))
