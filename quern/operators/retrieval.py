"""Ranked retrieval for whole tables of queries: BM25, recency, full-text search, TF-IDF, re-ranking.

Inputs are ``docs(doc_id, content)`` and ``queries(qid, text)``; results are rows of
(qid, rank from 0, doc_id, score) with explicit ties.  A document is scored where it
stands: document frequencies and sizes take one pass with a partial aggregate, and a
second pass joins each document's tokens with the broadcast terms of all queries and keeps
the best k of each query and task, so what is shuffled is k rows a query and task, and
neither (document, term) nor (query, document) pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.storage import materialize, spread

#: Rows of query terms up to which they are broadcast.
SMALL = 1_000_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def top(scored: DataFrame, k: int, *ties: Column, by: str = "qid") -> DataFrame:
    """The first k rows of each query by score, then ``ties``; adds rank from 0."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), *ties)
    # The number itself is compared, so that a task keeps k rows of a query before they are shuffled.
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """n, avgdl and n_terms of ``tokens(doc_id, w)``, one row."""
    terms = document_frequencies(tokens).agg(F.count(F.lit(1)).alias("n_terms"))
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl")).join(F.broadcast(terms))


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """term, df."""
    return tokens.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _weights(
    words: DataFrame, queries: DataFrame, asks: Callable[[Column], Column], epsilon: float | None, idf_floor: float,
) -> tuple[DataFrame, float]:
    """qid, term, qtf, idf of every query's terms that the corpus holds, and the mean length of ``words(w)``."""
    asked = materialize(queries.select("qid", F.explode(asks(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")), "terms")
    # A row without a term for each document counts the documents and their tokens in the same pass.
    none = F.lit(None).cast("string")
    each = words.select(F.size("w").alias("dl"), F.explode(F.concat(F.array(none), F.array_distinct("w"))).alias("term"))
    if epsilon is None:
        wanted = asked.select("term").distinct().union(asked.sparkSession.range(1).select(none.alias("term")))
        each = each.join(small(wanted.withColumnRenamed("term", "wanted")), F.col("term").eqNullSafe(F.col("wanted")), "left_semi")
    counted = materialize(each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total")), "frequencies")
    size = counted.filter("term is null").select(F.col("df").alias("n"), "total").first() or {"n": 0, "total": 0}
    frequencies = counted.filter("term is not null")
    raw = F.ln((F.lit(float(size["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(idf_floor)).otherwise(raw)
    if epsilon is not None:
        mean = frequencies.agg(F.avg(raw)).first()[0] or 0.0
        idf = F.when(raw < 0, F.lit(epsilon * mean)).otherwise(raw)
    return asked.join(frequencies.select("term", idf.alias("idf")), "term"), (size["total"] or 0) / max(size["n"] or 0, 1) or 1.0


class Best:
    """The k best documents of each query, by score and then id; rows come in any order and are cut back now and then."""

    def __init__(self, queries: int, k: int, larger_ids: bool, hold: int = 1 << 18):
        self.k, self.sign, self.hold = k, -1 if larger_ids else 1, max(hold, 2 * queries * k)
        self.floor = np.full(queries, -np.inf)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.floor[query]
        self.rows.append((query[good], doc[good], score[good]))
        self.size += int(good.sum())
        if self.size > self.hold:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, doc, score = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((self.sign * doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        query, doc, score, place = query[kept], doc[kept], score[kept], place[kept]
        full = place == self.k - 1
        self.floor[query[full]] = score[full]
        self.rows, self.size = [(query, doc, score)], len(query)
        return query, doc, score


def _in_place(hits: DataFrame, weights: pa.Table, terms: dict, k: int, larger_ids: bool, avgdl: float, k1: float, b: float) -> DataFrame:
    """qid, doc_id, score: of each task the k best documents of each query; ``hits(doc, doc_id, dl, term, factor)`` have a document's rows together."""
    qids, number = np.unique(weights.column("qid").to_numpy(), return_inverse=True)
    of_term = np.array([terms[t] for t in weights.column("term").to_pylist()], np.int64)
    order = np.argsort(of_term, kind="stable")
    weight = weights.column("qtf").to_numpy() * weights.column("idf").to_numpy() * (k1 + 1)
    starts = np.searchsorted(of_term[order], np.arange(len(terms) + 1))
    held = hits.sparkSession.sparkContext.broadcast((qids, starts, number[order], weight[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, starts, query_of, weight_of = held.value
        best = Best(len(qids), k, larger_ids)
        kept = None

        def score(doc: np.ndarray, doc_id: np.ndarray, dl: np.ndarray, term: np.ndarray, factor: np.ndarray) -> None:
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            at = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
            pair, tf = np.unique(at * len(starts) + term, return_counts=True)
            at, term = pair // len(starts), pair % len(starts)
            part = tf / (tf + k1 * (1 - b + b * dl[first][at] / avgdl))
            n = starts[term + 1] - starts[term]
            where = np.repeat(starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pair, slot = np.unique(np.repeat(at, n) * len(qids) + query_of[where], return_inverse=True)
            total = np.bincount(slot, np.repeat(part, n) * weight_of[where], len(pair))
            at = pair // len(qids)
            best.add(pair % len(qids), doc_id[first][at], np.floor(total * factor[first][at] * 1e6 + 0.5) / 1e6)

        for batch in _ended(batches):
            columns = [] if batch is None else [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)] if columns else kept
            if not columns or not len(columns[0]):
                continue
            cut = len(columns[0]) if batch is None else int(np.searchsorted(columns[0] == columns[0][-1], True))  # the last document may go on
            if cut:
                score(*[c[:cut] for c in columns])
            kept = [c[cut:] for c in columns]
        query, doc, total = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(qids[query]), pa.array(doc.astype(np.int64)), pa.array(total.astype(float))], ["qid", "doc_id", "score"])

    return hits.select("doc", "doc_id", "dl", "term", "factor").mapInArrow(run, "qid long, doc_id long, score double")


def _ended(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def bm25_best(
    docs: DataFrame, queries: DataFrame, k: int, *, tokens: Callable[[Column], Column] = T.ws_tokens, query_tokens: Callable[[Column], Column] | None = None,
    k1: float = 1.5, b: float = 0.75, epsilon: float | None = 0.25, idf_floor: float = 1e-6, factor: Column | None = None, larger_ids: bool = False, limit: int = SMALL,
) -> DataFrame:
    """qid, doc_id, score (quantised): among others the k best documents of each query that share a term with it, ties to the smaller id or the larger.

    Repeated query terms count each time.  With ``epsilon`` a negative idf becomes epsilon times
    the mean idf of the vocabulary, without it any idf of zero or less becomes ``idf_floor``.
    ``factor`` multiplies a document's scores.  Ids are integers; rows without one are left out.
    Documents are scored where they stand if the queries have at most ``limit`` (query, term)
    pairs, which are broadcast; beyond, terms and pairs are joined by shuffle.
    """
    factor = F.lit(1.0) if factor is None else factor
    words = spread(docs.filter("doc_id is not null").select("doc_id", "content", factor.cast("double").alias("factor"))).select("doc_id", "factor", tokens(F.col("content")).alias("w"))
    weighed, avgdl = _weights(words, queries, query_tokens or tokens, epsilon, idf_floor)
    weighed = materialize(weighed, "weights")
    held = words.withColumn("doc", F.monotonically_increasing_id()).select("doc", F.col("doc_id").cast("long").alias("doc_id"), F.size("w").alias("dl"), "factor", F.explode("w").alias("term"))
    if weighed.count() <= limit:
        got = weighed.select(F.col("qid").cast("long").alias("qid"), "term", "qtf", "idf").toArrow()
        names = {t: i for i, t in enumerate(sorted(set(got.column("term").to_pylist())))}
        table = docs.sparkSession.createDataFrame(pa.table({"term": pa.array(list(names), pa.string()), "number": pa.array(range(len(names)), pa.int32())}), "term string, number int")
        hits = held.join(F.broadcast(table), "term").drop("term").withColumnRenamed("number", "term")
        return _in_place(hits, got, names, k, larger_ids, avgdl, k1, b)
    hits = held.join(weighed.select("term").distinct(), "term").groupBy("doc", "doc_id", "dl", "factor", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    scored = hits.join(weighed, "term").groupBy("qid", "doc", "doc_id", "factor").agg(F.sum(part).alias("score"))
    return scored.select("qid", "doc_id", T.quantised(F.col("score") * F.col("factor")).alias("score"))


def _search_words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(T.empty_if_null(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: The tokens of a document in an index that serves both searches.
ANALYSERS: dict[str, Callable[[Column], Column]] = {"space": T.ws_tokens, "words": _search_words}


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, year: Column | None = None, alpha: float = 0.3, index=None, **options) -> DataFrame:
    """Top k by quantised score, ties to the greater doc_id; documents without a shared term fill up with score 0.

    With ``year``, an expression over ``docs``, scores are raised by up to ``alpha`` for recency; no year, no change.
    With an ``index`` of ``docs`` (:class:`postings.TextIndex`), and without years, it is searched and texts are not read.
    """
    factor = None
    if year is not None:
        span = docs.agg(F.min(year), F.max(year)).first()
        low, width = span[0] or 0, max((span[1] or 0) - (span[0] or 0), 1)
        factor = 1 + F.coalesce(alpha * (year - low) / width, F.lit(0.0))
    if index is not None and factor is None:
        scored = index.best("space", queries, k, larger_ids=True, **options)
    else:
        scored = bm25_best(docs, queries, k, factor=factor, larger_ids=True, **options)
    # 2k documents of the greatest ids hold k that a query with fewer than k hits has not hit.
    last = docs.select("doc_id").orderBy(F.desc("doc_id")).limit(2 * k)
    filler = queries.select("qid", F.explode(F.array(*[F.lit(r.doc_id) for r in last.collect()])).alias("doc_id")).withColumn("score", F.lit(0.0))
    pool = scored.unionByName(filler).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    return top(pool, k, F.desc("doc_id")).select("qid", "rank", "doc_id", "score")


def search_topk(docs: DataFrame, queries: DataFrame, k: int = 10, index=None, **options) -> DataFrame:
    """Full-text OR search: words of more than three letters or digits, BM25 with k1 1.2; only documents that match; from the ``index`` of ``docs`` if there is one."""
    asked = lambda x: F.filter(F.split(F.lower(T.fts_query(x)), " or "), lambda w: w != "")
    if index is not None:
        scored = index.best("words", queries, k, asks=asked, k1=1.2, epsilon=None, **options)
    else:
        scored = bm25_best(docs, queries, k, tokens=_search_words, query_tokens=asked, k1=1.2, epsilon=None, **options)
    return top(scored, k, F.asc("doc_id")).select("qid", "rank", "doc_id", "score")


def tfidf(texts: DataFrame, *, max_n: int = 2, max_features: int = 10_000) -> DataFrame:
    """gid, uid, term, weight of ``texts(gid, uid, text)``: each gid is a corpus of its own.

    Terms are words of two characters or more and runs of up to ``max_n`` of them; the
    ``max_features`` most frequent of a corpus stay (ties by term).  Weights are
    tf * (ln((1 + n) / (1 + df)) + 1), of unit length.
    """
    words = materialize(texts.select("gid", "uid", T.unicode_tokens(F.col("text")).alias("w")), "words")
    grams = F.flatten(F.array(*[T.ngrams(F.col("w"), n) for n in range(1, max_n + 1)]))
    tf = words.select("gid", "uid", F.explode(grams).alias("term")).groupBy("gid", "uid", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = materialize(tf, "tf")
    per_term = tf.groupBy("gid", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    kept = per_term.withColumn("k", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("cf"), "term"))).filter(F.col("k") <= max_features)
    sizes = words.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    raw = tf.join(kept.select("gid", "term", "df"), ["gid", "term"]).join(sizes, "gid").withColumn("raw", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    raw = materialize(raw.select("gid", "uid", "term", "raw"), "raw")
    norms = raw.groupBy("gid", "uid").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, ["gid", "uid"]).select("gid", "uid", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def cosine_to(weights: DataFrame, query_uid: int = -1) -> DataFrame:
    """gid, uid, cosine to the corpus' text ``query_uid``; texts that share no term have no row."""
    asked = weights.filter(F.col("uid") == query_uid).select("gid", "term", F.col("weight").alias("q"))
    return weights.filter(F.col("uid") != query_uid).join(asked, ["gid", "term"]).groupBy("gid", "uid").agg(T.quantised(F.sum(F.col("weight") * F.col("q"))).alias("cosine"))


def relevance_gate(pool: DataFrame, queries: DataFrame, *, min_score: float = 0.15, pinned: str = "Atomic Propositions") -> DataFrame:
    """``pool(qid, rank, doc_id, title, content)`` without documents below ``min_score``; pinned titles stay and come first."""
    texts = (
        pool.filter(F.col("title") != pinned).select(F.col("qid").alias("gid"), F.col("doc_id").cast("long").alias("uid"), F.col("content").alias("text"))
        .unionByName(queries.select(F.col("qid").alias("gid"), F.lit(-1).cast("long").alias("uid"), "text"))
    )
    scores = cosine_to(tfidf(texts)).filter(F.col("cosine") >= min_score).select(F.col("gid").alias("qid"), F.col("uid").alias("doc_id"), "cosine")
    kept = pool.filter(F.col("title") != pinned).join(scores, ["qid", "doc_id"])
    first = pool.filter(F.col("title") == pinned).withColumn("cosine", F.lit(None).cast("double"))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("title") == pinned, 0).otherwise(1), "rank", "doc_id")
    return kept.unionByName(first).withColumn("rank", F.row_number().over(order) - 1)


def overlap_rerank(pool: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column] | None = None, cut: int = 512) -> DataFrame:
    """``pool(qid, rank, doc_id, content)`` in the order of ``score(query, content[:cut])``; scores become k..1.

    The default score is the number of distinct shared tokens, the stand-in for a cross-encoder.
    """
    score = score or (lambda q, d: F.size(F.array_intersect(T.ws_tokens(q), T.ws_tokens(d))).cast("double"))
    joined = pool.join(queries, "qid").withColumn("model", score(F.col("text"), F.substring("content", 1, cut)))
    order = Window.partitionBy("qid").orderBy(F.desc("model"), "rank", "doc_id")
    size = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    return joined.withColumn("place", F.row_number().over(order)).select("qid", (F.col("place") - 1).alias("rank"), "doc_id", (size - F.col("place") + 1).cast("double").alias("score"))


# Edition years of the text books of the static corpus, by the start of the title.
EDITION_YEARS = {
    "InternalMed_Harrison": 2022, "Surgery_Schwartz": 2019, "Neurology_Adams": 2019, "Obstentrics_Williams": 2018, "Gynecology_Novak": 2019,
    "Pharmacology_Katzung": 2018, "Cell_Biology_Alberts": 2015, "Pathology_Robbins": 2020, "Immunology_Janeway": 2017, "Histology_Ross": 2020,
    "Physiology_Levy": 2017, "Pediatrics_Nelson": 2020, "Psichiatry_DSM-5": 2013, "Anatomy_Gray": 2016, "Biochemistry_Lippinco": 2017,
    "First_Aid_Step2": 2019, "First_Aid_Step1": 2019, "Pathoma_Husain": 2015,
}


def publication_year(year: Column, published: Column, title: Column, content: Column) -> Column:
    """The first of: a year field in 1900..2100, a year in the date, the title's edition, a year in title and first 200 characters."""
    field = F.substring(year.cast("string"), 1, 4).try_cast("int")
    dated = F.regexp_extract(T.empty_if_null(published), r"((?:19|20)\d{2})", 1).try_cast("int")
    edition = F.coalesce(*[F.when(F.startswith(F.lower(title), F.lit(p.lower())), F.lit(y)) for p, y in EDITION_YEARS.items()])
    seen = F.regexp_extract(F.concat(T.empty_if_null(title), F.lit(" "), F.substring(T.empty_if_null(content), 1, 200)), r"(?:^|[^0-9A-Za-z_])(19[89]\d|20[0-2]\d)(?:$|[^0-9A-Za-z_])", 1).try_cast("int")
    return F.coalesce(F.when(field.between(1900, 2100), field), dated, edition, seen)
