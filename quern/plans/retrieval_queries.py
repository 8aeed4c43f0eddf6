"""Queries over retrieval, fusion and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import fusion, ivfpq, postings, retrieval, vectors
from quern.plans.catalog import register
from quern.storage import held, materialize, reserve
from quern.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content (title and text; the source stands for the title), title, pmid, id, url."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("content"), F.col("source").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("").alias("pmid"), F.lit("").alias("id"), F.lit("").alias("url"), "text",
    )


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


_INDEXES: dict[tuple, postings.TextIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> postings.TextIndex:
    """The stored index of the documents, built by the session's first search and kept with its intermediate tables."""
    docs = _docs(spark, sf_dir).select("doc_id", "content")
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _INDEXES or not held(_INDEXES[key].path):
        _INDEXES[key] = postings.TextIndex.create(spark, reserve(spark, "index")).append(docs)
    return _INDEXES[key]


def _year() -> Column:
    return F.when(F.col("doc_id") % 7 != 0, (1990 + F.col("doc_id") % 30).cast("int"))


_Q = "q AS (SELECT item_id AS qid, text FROM benchmark)"
_D = "d AS (SELECT doc_id, coalesce(source, '') || ' ' || coalesce(text, '') AS content, source AS title, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS pmid FROM documents)"
_WS = r"list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> '')"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_ASKED = r"list_filter(string_split(lower(array_to_string(list_filter(string_split_regex(regexp_replace({}, '[^a-zA-Z0-9 ]', '', 'g'), ' +'), lambda x: length(x) > 3), ' OR ')), ' or '), lambda x: x <> '')"


def _bm25(p: str, doc_tokens: str, query_tokens: str, k1: float, floor: str, queries: str = "q", qid: str = "qid") -> str:
    """CTEs that end in {p}s(qid, doc_id, score), quantised."""
    return f"""
{p}w AS (SELECT doc_id, {doc_tokens.format('content')} AS w FROM d),
{p}t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM {p}w),
{p}f AS (SELECT doc_id, dl, term, count(*) AS tf FROM {p}t GROUP BY ALL),
{p}n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {p}w),
{p}df AS (SELECT term, count(*) AS df FROM {p}f GROUP BY term),
{p}r AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM {p}df, {p}n),
{p}i AS (SELECT term, {floor.format(r=p + 'r')} AS idf FROM {p}r),
{p}q AS (SELECT {qid}, term, count(*) AS qtf FROM (SELECT {qid}, unnest({query_tokens.format('text')}) AS term FROM {queries}) GROUP BY {qid}, term),
{p}s AS (SELECT {qid}, doc_id, floor(sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))) * 1e6 + 0.5) / 1e6 AS score
  FROM {p}q JOIN {p}i USING (term) JOIN {p}f USING (term), {p}n GROUP BY {qid}, doc_id)"""


_OKAPI = "CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM {r}) ELSE idf END"
_FLOOR = "CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END"
_B = _bm25("b", _WS, _WS, 1.5, _OKAPI)
_F = _bm25("f", _WORDS, _ASKED, 1.2, _FLOOR)


def _filled(scores: str, k: int, name: str) -> str:
    return f"""
{name}p AS (SELECT qid, doc_id, max(score) AS score FROM (SELECT * FROM {scores} UNION ALL SELECT qid, doc_id, 0.0 FROM q, (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT {2 * k})) GROUP BY qid, doc_id),
{name} AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) - 1 AS rank, doc_id, score FROM {name}p) WHERE rank < {k})"""


def _searched(scores: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank, doc_id, score FROM {scores}) WHERE rank < {k})"


_RANKED = "SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM {}"


@register("scan_corpus", "SELECT doc_id, source AS title, length(text) AS n_chars, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS pmid FROM documents")
def scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "title", F.length("text").cast("long").alias("n_chars"), "pmid")


@register("corpus_stats", f"WITH {_D}, w AS (SELECT doc_id, {_WS.format('content')} AS w FROM d) SELECT count(*) AS n, avg(len(w)) AS avgdl, (SELECT count(DISTINCT t) FROM (SELECT unnest(w) AS t FROM w)) AS n_terms FROM w")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.corpus_stats(_docs(spark, sf_dir).select("doc_id", T.ws_tokens(F.col("content")).alias("w")))


@register("bm25_topk", f"WITH {_Q}, {_D}, {_B}, {_filled('bs', 10, 'b10')} {_RANKED.format('b10')}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(_docs(spark, sf_dir), _queries(spark, sf_dir), 10, index=_index(spark, sf_dir))


@register("bm25_recency_topk", f"""WITH {_Q}, {_D}, {_bm25('c', _WS, _WS, 1.5, _OKAPI).replace('floor(sum(', '(sum(').replace(' * 1e6 + 0.5) / 1e6 AS score', ') AS score')},
y AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 1990 + doc_id % 30 END AS year FROM documents),
m AS (SELECT min(year) AS low, greatest(max(year) - min(year), 1) AS width FROM y),
cy AS (SELECT qid, doc_id, floor(score * (1 + coalesce(0.3 * (year - low) / width, 0.0)) * 1e6 + 0.5) / 1e6 AS score FROM cs JOIN y USING (doc_id), m),
{_filled('cy', 10, 'c10')} {_RANKED.format('c10')}""")
def bm25_recency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(_docs(spark, sf_dir), _queries(spark, sf_dir), 10, year=_year())


@register("fts_bm25_topk", f"WITH {_Q}, {_D}, {_F}, {_searched('fs', 10, 'f10')} {_RANKED.format('f10')}")
def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_topk(_docs(spark, sf_dir), _queries(spark, sf_dir), 10, index=_index(spark, sf_dir))


_GRAMS = r"list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_TFIDF = rf"""
tw AS (SELECT gid, uid, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM tx),
tf AS (SELECT gid, uid, term, count(*) AS tf FROM (SELECT gid, uid, unnest({_GRAMS}) AS term FROM tw) GROUP BY gid, uid, term),
td AS (SELECT gid, term, count(*) AS df, row_number() OVER (PARTITION BY gid ORDER BY sum(tf) DESC, term) AS k FROM tf GROUP BY gid, term),
tn AS (SELECT gid, count(*) AS n FROM tx GROUP BY gid),
tr AS (SELECT gid, uid, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN td USING (gid, term) JOIN tn USING (gid) WHERE k <= 10000),
tz AS (SELECT gid, uid, sqrt(sum(raw * raw)) AS norm FROM tr GROUP BY gid, uid),
ti AS (SELECT gid, uid, term, raw / norm AS weight FROM tr JOIN tz USING (gid, uid))"""
_POOLED = "tx AS (SELECT qid AS gid, -1 AS uid, text FROM q UNION ALL SELECT qid, doc_id, content FROM b10 JOIN d USING (doc_id))"
_COSINE = "tc AS (SELECT a.gid AS qid, a.uid AS doc_id, floor(sum(a.weight * b.weight) * 1e6 + 0.5) / 1e6 AS cosine FROM ti a JOIN ti b ON a.gid = b.gid AND a.term = b.term AND b.uid = -1 AND a.uid <> -1 GROUP BY ALL)"


def _pool(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The BM25 pool with the documents' columns."""
    docs = _docs(spark, sf_dir)
    return materialize(retrieval.bm25_topk(docs, _queries(spark, sf_dir), k, index=_index(spark, sf_dir)), "pool").join(docs, "doc_id")


def _search_pool(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return materialize(retrieval.search_topk(docs, _queries(spark, sf_dir), k, index=_index(spark, sf_dir)), "pool").join(docs, "doc_id")


@register("tfidf_weights", f"WITH tx AS (SELECT 0 AS gid, item_id AS uid, text FROM benchmark), {_TFIDF} SELECT uid AS item_id, term, floor(weight * 1e6 + 0.5) / 1e6 AS weight FROM ti")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("gid"), F.col("item_id").alias("uid"), "text")
    return retrieval.tfidf(texts).select(F.col("uid").alias("item_id"), "term", T.quantised(F.col("weight")).alias("weight"))


@register("tfidf_cosine", f"WITH {_Q}, {_D}, {_B}, {_filled('bs', 10, 'b10')}, {_POOLED}, {_TFIDF}, {_COSINE} SELECT * FROM tc")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _pool(spark, sf_dir, 10).select(F.col("qid").alias("gid"), F.col("doc_id").alias("uid"), F.col("content").alias("text"))
    asked = _queries(spark, sf_dir).select(F.col("qid").alias("gid"), F.lit(-1).cast("long").alias("uid"), "text")
    return retrieval.cosine_to(retrieval.tfidf(texts.unionByName(asked))).select(F.col("gid").alias("qid"), F.col("uid").alias("doc_id"), "cosine")


@register("relevance_gate", f"""WITH {_Q}, {_D}, {_B}, {_filled('bs', 10, 'b10')}, {_POOLED}, {_TFIDF}, {_COSINE}
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank, doc_id) - 1 AS INTEGER) AS rank, doc_id, cosine FROM tc JOIN b10 USING (qid, doc_id) WHERE cosine >= 0.15""")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir, 10).select("qid", "rank", "doc_id", "title", "content")
    return retrieval.relevance_gate(pool, _queries(spark, sf_dir)).select("qid", "rank", "doc_id", "cosine")


@register("rerank_stub", rf"""WITH {_Q}, {_D}, {_B}, {_filled('bs', 10, 'b10')},
m AS (SELECT b10.qid, rank, doc_id, len(list_intersect(list_distinct({_WS.format('q.text')}), list_distinct({_WS.format('substring(content, 1, 512)')}))) AS m
  FROM b10 JOIN d USING (doc_id) JOIN q ON q.qid = b10.qid),
o AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY m DESC, rank, doc_id) AS place, count(*) OVER (PARTITION BY qid) AS n FROM m)
SELECT qid, CAST(place - 1 AS INTEGER) AS rank, doc_id, CAST(n - place + 1 AS DOUBLE) AS score FROM o""")
def rerank_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.overlap_rerank(_pool(spark, sf_dir, 10).select("qid", "rank", "doc_id", "content"), _queries(spark, sf_dir))


@register("union_pools", f"WITH {_Q}, {_D}, {_B}, {_F}, {_filled('bs', 50, 'b50')}, {_searched('fs', 50, 'f50')} SELECT qid, doc_id, count(*) AS pools, CAST(min(rank) AS INTEGER) AS best FROM (SELECT * FROM b50 UNION ALL SELECT * FROM f50) GROUP BY qid, doc_id")
def union_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked, index = _docs(spark, sf_dir), _queries(spark, sf_dir), _index(spark, sf_dir)
    both = retrieval.bm25_topk(docs, asked, 50, index=index).unionByName(retrieval.search_topk(docs, asked, 50, index=index), allowMissingColumns=True)
    return both.groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("pools"), F.min("rank").alias("best"))


def _rrf(pools: list[tuple[str, float, str]], key: str, k: int, name: str) -> str:
    """CTEs that end in {name}(qid, rank, doc_id, key, score); pools are (relation, weight, its name)."""
    union = " UNION ALL ".join(f"SELECT qid, {i} AS place, rank, doc_id, {w} AS weight FROM {r}" for i, (r, w, _) in enumerate(pools))
    return f"""
{name}u AS (SELECT u.*, {key} AS key FROM ({union}) u JOIN d USING (doc_id)),
{name}g AS (SELECT qid, key, floor(sum(weight / (rank + 61)) * 1e3 * 1e6 + 0.5) / 1e6 AS score, min(place * 1000000 + rank) AS first FROM {name}u GROUP BY qid, key),
{name}f AS (SELECT g.qid, g.key, g.score, g.first, min(u.doc_id) AS doc_id FROM {name}g g JOIN {name}u u ON u.qid = g.qid AND u.key = g.key AND u.place * 1000000 + u.rank = g.first GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, doc_id) - 1 AS rank, doc_id, key, score FROM {name}f) WHERE rank < {k})"""


_ROUTED = "coalesce(nullif(pmid, ''), substring(title, 1, 40))"
_EVALUATED = "coalesce(nullif(pmid, ''), substring(title, 1, 50))"
_PUBMED = "coalesce(nullif(pmid, ''), title)"
_POOLS = f"WITH {_Q}, {_D}, {_B}, {_F}, {_filled('bs', 50, 'b50')}, {_searched('fs', 50, 'f50')}"
_FUSED = "SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, key, score FROM {}"


def _two_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir, 50).withColumn("pool", F.lit("bm25")).unionByName(_search_pool(spark, sf_dir, 50).withColumn("pool", F.lit("search")))


@register("rrf_merge", f"{_POOLS}, {_rrf([('b50', 1.2, 'bm25'), ('f50', 1.0, 'search')], _PUBMED, 20, 'r')} {_FUSED.format('r')}")
def rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_two_pools(spark, sf_dir), {"bm25": 1.2, "search": 1.0}, 20, fusion.pubmed_key())


@register("rrf_title_key", f"{_POOLS}, {_rrf([('b50', 0.4, 'bm25'), ('f50', 0.6, 'search')], 'substring(title, 1, 50)', 20, 'r')} {_FUSED.format('r')}")
def rrf_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without ids, documents of one title collapse and add up."""
    return fusion.rrf(_two_pools(spark, sf_dir).withColumn("pmid", F.lit("")), {"bm25": 0.4, "search": 0.6}, 20, fusion.evaluated_key())


@register("rrf_weighted_pools", f"{_POOLS}, {_rrf([('b50', 0.45, 'graph'), ('f50', 0.55, 'pubmed')], _ROUTED, 20, 'r')} {_FUSED.format('r')}")
def rrf_weighted_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_two_pools(spark, sf_dir), {"bm25": fusion.GRAPH_WEIGHT["general"], "search": 1 - fusion.GRAPH_WEIGHT["general"]}, 20, fusion.routed_key())


_SUB = r"""q AS (SELECT item_id AS qid, text FROM benchmark),
sl AS (SELECT qid, list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM q),
se AS (SELECT qid, s[i] AS text, min(i) AS i FROM sl, unnest(range(1, len(s) + 1)) AS r(i) GROUP BY ALL),
sq AS (SELECT qid, text, qid * 8 + row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS sid, row_number() OVER (PARTITION BY qid ORDER BY i) AS n FROM se QUALIFY n <= 8)"""


@register("multi_query_rrf", f"""WITH {_SUB}, {_D}, {_bm25('f', _WORDS, _ASKED, 1.2, _FLOOR, 'sq', 'sid')},
fx AS (SELECT * FROM (SELECT sid // 8 AS qid, sid, row_number() OVER (PARTITION BY sid ORDER BY score DESC, doc_id) - 1 AS r, doc_id FROM fs) WHERE r < 20),
fc AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY sid, r) - 1 AS rank, doc_id FROM fx),
{_B}, {_filled('bs', 50, 'b50')},
{_rrf([('fc', 1.2, 'search'), ('b50', 1.0, 'bm25')], _PUBMED, 20, 'r')} {_FUSED.format('r')}""")
def multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight sub-queries of an item, hits one after the other, fused with the BM25 pool."""
    docs = _docs(spark, sf_dir)
    subs = _queries(spark, sf_dir).select("qid", F.posexplode(T.unique_queries(F.split("text", r"\."), 8)).alias("sub", "text")).select((F.col("qid") * 8 + F.col("sub")).alias("qid"), "text")
    hits = materialize(retrieval.search_topk(docs, subs, 20, index=_index(spark, sf_dir)), "hits").select(F.expr("qid div 8").alias("qid"), F.col("qid").alias("sub"), "rank", "doc_id")
    pool = fusion.concatenated(hits).drop("sub").join(docs, "doc_id").withColumn("pool", F.lit("search"))
    both = pool.unionByName(_pool(spark, sf_dir, 50).drop("score").withColumn("pool", F.lit("bm25")))
    return fusion.rrf(both, {"search": 1.2, "bm25": 1.0}, 20, fusion.pubmed_key())


@register("hierarchical_retrieve", f"""{_POOLS}, {_rrf([('b50', 0.45, 'graph'), ('f50', 0.55, 'pubmed')], _ROUTED, 50, 'm')},
{_rrf([('b50', 0.4, 'bm25'), ('m', 0.6, 'moe')], _EVALUATED, 20, 'r')} {_FUSED.format('r')}""")
def hierarchical_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 pool fused with the routed pool, itself a fusion."""
    docs = _docs(spark, sf_dir)
    pools = materialize(_two_pools(spark, sf_dir).select("qid", "rank", "doc_id", "pool"), "pools")
    named = pools.join(docs, "doc_id")
    routed = fusion.rrf(named, {"bm25": 0.45, "search": 0.55}, 50, fusion.routed_key()).select("qid", "rank", "doc_id").join(docs, "doc_id").withColumn("pool", F.lit("moe"))
    return fusion.rrf(named.filter("pool = 'bm25'").unionByName(routed), {"bm25": 0.4, "moe": 0.6}, 20, fusion.evaluated_key())


_HITS = {d: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words) for d, words in fusion.DOMAIN_WORDS.items()}
_CLASSIFIED = f"""h AS (SELECT item_id AS qid, {', '.join(f'{e} AS {d}' for d, e in _HITS.items())} FROM benchmark),
c AS (SELECT *, CASE WHEN greatest(pharmacology, anatomy, clinical) = 0 THEN 'general' WHEN pharmacology = greatest(pharmacology, anatomy, clinical) THEN 'pharmacology'
  WHEN anatomy = greatest(pharmacology, anatomy, clinical) THEN 'anatomy' ELSE 'clinical' END AS domain FROM h)"""


@register("classify_domain", f"WITH {_CLASSIFIED} SELECT * FROM c")
def classify_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select("qid", *[fusion.domain_hits(F.col("text"), d).alias(d) for d in fusion.DOMAIN_WORDS], fusion.classify_domain(F.col("text")).alias("domain"))


def _case(values: dict) -> str:
    return "CASE domain " + " ".join(f"WHEN '{d}' THEN {v!r}" for d, v in values.items()) + " END"


@register("moe_route", f"""WITH {_CLASSIFIED} SELECT qid, domain, {_case(fusion.DOMAIN_HOPS)} AS hops, {_case({d: ','.join(r) for d, r in fusion.DOMAIN_RELATIONS.items()})} AS relations,
  CAST({_case(fusion.GRAPH_WEIGHT)} AS DOUBLE) AS graph_weight, floor((1 - CAST({_case(fusion.GRAPH_WEIGHT)} AS DOUBLE)) * 1e6 + 0.5) / 1e6 AS pubmed_weight, CAST(0.2 AS DOUBLE) AS live_weight FROM c""")
def moe_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.route(_queries(spark, sf_dir))


_EDITION = " ".join(f"WHEN starts_with(lower(title), '{p.lower()}') THEN {y}" for p, y in retrieval.EDITION_YEARS.items())
_DATED = """x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CAST(1890 + doc_id % 230 AS VARCHAR) || '-01' END AS year, CASE WHEN doc_id % 5 = 1 THEN 'published in ' || (1990 + doc_id % 30) ELSE '' END AS published,
  CASE WHEN doc_id % 5 = 2 THEN 'Anatomy_Gray, part' ELSE source END AS title, CASE WHEN doc_id % 5 = 3 THEN 'In ' || (1985 + doc_id % 50) || ' ' ELSE '' END || coalesce(text, '') AS content FROM documents)"""


@register("extract_year", rf"""WITH {_DATED}
SELECT doc_id, CAST(coalesce(CASE WHEN TRY_CAST(substring(year, 1, 4) AS INTEGER) BETWEEN 1900 AND 2100 THEN TRY_CAST(substring(year, 1, 4) AS INTEGER) END,
  TRY_CAST(regexp_extract(published, '((?:19|20)\d{{2}})', 1) AS INTEGER), CASE {_EDITION} END,
  TRY_CAST(regexp_extract(title || ' ' || substring(content, 1, 200), '(?:^|[^0-9A-Za-z_])(19[89]\d|20[0-2]\d)(?:$|[^0-9A-Za-z_])', 1) AS INTEGER)) AS INTEGER) AS year FROM x""")
def extract_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 5 == 0, F.concat((1890 + i % 230).cast("string"), F.lit("-01"))).alias("year"),
        F.when(i % 5 == 1, F.concat(F.lit("published in "), (1990 + i % 30).cast("string"))).otherwise("").alias("published"),
        F.when(i % 5 == 2, "Anatomy_Gray, part").otherwise(F.col("source")).alias("title"),
        F.concat(F.when(i % 5 == 3, F.concat(F.lit("In "), (1985 + i % 50).cast("string"), F.lit(" "))).otherwise(""), F.coalesce("text", F.lit(""))).alias("content"),
    )
    return rows.select("doc_id", retrieval.publication_year(*[F.col(c) for c in ("year", "published", "title", "content")]).alias("year"))


@register("pmid_recency", f"""WITH {_Q}, {_D}, {_B}, {_filled('bs', 30, 'b30')}, y AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 1990 + doc_id % 30 END AS year FROM documents),
m AS (SELECT min(year) AS low, greatest(max(year) - min(year), 1) AS width FROM y),
t AS (SELECT qid, doc_id, floor((score / (max(score) OVER (PARTITION BY qid)) + 0.3 * coalesce((year - low) / width, 0.0)) * 1e6 + 0.5) / 1e6 AS score FROM b30 JOIN y USING (doc_id), m WHERE score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM t) SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank < 10""")
def pmid_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-rank three times k candidates by relative score plus alpha times recency."""
    from pyspark.sql import Window

    docs = _docs(spark, sf_dir)
    years = docs.select("doc_id", _year().alias("year"))
    span = years.agg(F.min("year"), F.max("year")).first()
    width = max((span[1] or 0) - (span[0] or 0), 1)
    pool = retrieval.bm25_topk(docs, _queries(spark, sf_dir), 30, index=_index(spark, sf_dir)).filter("score > 0").join(years, "doc_id")
    fresh = F.coalesce((F.col("year") - (span[0] or 0)) / width, F.lit(0.0))
    scored = pool.withColumn("score", T.quantised(F.col("score") / F.max("score").over(Window.partitionBy("qid")) + 0.3 * fresh)).drop("rank")
    return retrieval.top(scored, 10, F.asc("doc_id")).select("qid", "rank", "doc_id", "score")


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector a label: its first by id."""
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


@register("dense_topk", """WITH q AS (SELECT CAST(label AS BIGINT) AS qid, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label),
s AS (SELECT qid, vec_id, floor(list_inner_product(embedding::DOUBLE[], e) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product(e, e)) * 1e6 + 0.5) / 1e6 AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) - 1 AS rank FROM s)
SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank < 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cosine_topk(table(spark, sf_dir, "embeddings"), _asked_vectors(spark, sf_dir), 10)


@register("ann_topk")
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks the index, in a tenth of its cells."""
    held = table(spark, sf_dir, "embeddings")
    return ivfpq.search(ivfpq.build(held), held, held.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 10)


# --- The pipeline's modes ------------------------------------------------------------------------


def _mode(spark: SparkSession, sf_dir: str, mode: str, hooks=None, **more) -> DataFrame:
    from quern.plans.pipeline import Pipeline, Settings

    docs = _docs(spark, sf_dir).select("doc_id", "title", F.coalesce("text", F.lit("")).alias("content"), "pmid", "id", "url")
    index = _index(spark, sf_dir) if mode in ("bm25", "search", "fused", "moe_flat", "moe_graph") else None
    return Pipeline(docs, Settings(mode=mode), hooks, index=index, **more).retrieve(_queries(spark, sf_dir)).select("qid", "rank", "doc_id")


_FIRST = "SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id FROM {} WHERE rank < {}"


@register("mode_bm25", f"WITH {_Q}, {_D}, {_B}, {_filled('bs', 50, 'b50')} {_FIRST.format('b50', 20)}")
def mode_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(spark, sf_dir, "bm25")


@register("mode_search", f"WITH {_Q}, {_D}, {_F}, {_searched('fs', 50, 'f50')} {_FIRST.format('f50', 20)}")
def mode_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(spark, sf_dir, "search")


@register("mode_moe_flat", f"WITH {_Q}, {_D}, {_F}, {_searched('fs', 50, 'f50')} {_FIRST.format('f50', 20)}")
def mode_moe_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without graph, vectors and live search the routed pool is the full-text pool."""
    return _mode(spark, sf_dir, "moe_flat")


@register("mode_fused", f"{_POOLS}, {_rrf([('b50', 0.4, 'bm25'), ('f50', 0.6, 'search')], _EVALUATED, 20, 'r')} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id FROM r")
def mode_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(spark, sf_dir, "fused")


@register("mode_dense", """WITH q AS (SELECT item_id AS qid, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
s AS (SELECT qid, vec_id AS doc_id, floor(list_inner_product(embedding::DOUBLE[], e) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product(e, e)) * 1e6 + 0.5) / 1e6 AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM s)
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id FROM r JOIN documents USING (doc_id) WHERE rank < 20""")
def mode_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in for an encoder looks an item's vector up by its id."""
    from quern.hooks import Hooks

    held = table(spark, sf_dir, "embeddings")
    encode = lambda q: q.join(held.select(F.col("vec_id").alias("qid"), "embedding"), "qid").select("qid", "embedding")
    return _mode(spark, sf_dir, "dense", Hooks(encode=encode), vectors=held.select(F.col("vec_id").alias("doc_id"), "embedding"))


@register("mode_moe_graph")
def mode_moe_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph pool of the parts and nations named in a question, weighed with the full-text pool by the question's domain."""
    from quern.plans.graph_queries import _graph

    nodes, edges = _graph(spark, sf_dir)
    return _mode(spark, sf_dir, "moe_graph", nodes=nodes, edges=edges)


@register("ann_topk_all_cells", """WITH q AS (SELECT CAST(label AS BIGINT) AS qid, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label),
s AS (SELECT qid, vec_id, floor(list_inner_product(embedding::DOUBLE[], e) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product(e, e)) * 1e6 + 0.5) / 1e6 AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) - 1 AS rank FROM s)
SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank < 10""")
def ann_topk_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index asked in all its cells, with all found there scored exactly, gives the exact answer."""
    held = table(spark, sf_dir, "embeddings")
    index = ivfpq.build(held, copies=1)
    return ivfpq.search(index, held, _asked_vectors(spark, sf_dir), 10, probes=len(index.centres) if index else 1, short=None)
