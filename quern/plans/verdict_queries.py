"""Queries over compression, contexts and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import hooks
from quern.operators import cite, compress
from quern.plans.catalog import register
from quern.plans.retrieval_queries import _B, _D, _Q, _TFIDF, _WS, _filled, _pool, _queries
from quern.storage import materialize
from quern.tables import table

_TOP = f"WITH {_Q}, {_D}, {_B}, {_filled('bs', 5, 'b5')}"


def _five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(_pool(spark, sf_dir, 5).select("qid", "rank", "doc_id", "title", F.col("text").alias("content"), "pmid"), "five")


_SENT = r"""sx AS (SELECT qid, rank, list_filter(list_transform(string_split(regexp_replace(regexp_replace(title || '. ' || coalesce(b.text, ''), '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20) AS s FROM b5 JOIN d USING (doc_id) JOIN documents b USING (doc_id)),
se AS (SELECT qid, rank, i - 1 AS "at", s[i] AS sentence FROM sx, unnest(range(1, len(s) + 1)) AS r(i)),
tx AS (SELECT qid AS gid, -1 AS uid, text FROM q UNION ALL SELECT qid, rank * 1000000 + "at", sentence FROM se)"""


@register("mmr_first_pick", f"""{_TOP}, {_SENT}, {_TFIDF},
c AS (SELECT a.gid AS qid, a.uid, floor(sum(a.weight * b.weight) * 1e6 + 0.5) / 1e6 AS cosine FROM ti a JOIN ti b ON a.gid = b.gid AND a.term = b.term AND b.uid = -1 AND a.uid <> -1 GROUP BY ALL),
o AS (SELECT se.qid, se.rank, se."at", sentence, coalesce(cosine, 0.0) AS relevance, row_number() OVER (PARTITION BY se.qid ORDER BY coalesce(cosine, 0.0) DESC, se.rank, se."at") AS k FROM se LEFT JOIN c ON c.qid = se.qid AND c.uid = se.rank * 1000000 + se."at")
SELECT qid, CAST(rank AS INTEGER) AS rank, CAST("at" AS INTEGER) AS "at", sentence, relevance FROM o WHERE k = 1""")
def mmr_first_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = compress.relevance(_five(spark, sf_dir), _queries(spark, sf_dir))
    order = Window.partitionBy("qid").orderBy(F.desc("relevance"), "rank", "at")
    return rows.withColumn("k", F.row_number().over(order)).filter("k = 1").select("qid", "rank", "at", "sentence", "relevance")


@register("mmr_select")
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.mmr(_five(spark, sf_dir), _queries(spark, sf_dir))


@register("context_raw", f"""{_TOP} SELECT qid, string_agg('Document [' || (rank + 1) || '] (Title: ' || title || ') ' || x.text, chr(10) ORDER BY rank) AS context FROM b5 JOIN d USING (doc_id) JOIN documents x USING (doc_id) GROUP BY qid""")
def context_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.raw_context(_five(spark, sf_dir))


@register("context_compressed")
def context_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = _five(spark, sf_dir)
    return compress.compressed_context(compress.mmr(five, _queries(spark, sf_dir)), five)


@register("citation_attach", f"""{_TOP}, c AS (SELECT qid, pmid, title, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM b5 JOIN d USING (doc_id) WHERE regexp_full_match(pmid, '[0-9]+'))
SELECT qid, chr(10) || chr(10) || 'References:' || chr(10) || string_agg('[' || n || '] ' || title || '. PMID: ' || pmid || ' — https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/', chr(10) ORDER BY n) || chr(10) AS block FROM c GROUP BY qid""")
def citation_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cite.references(cite.citable(_five(spark, sf_dir)))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's text as an answer that cites its own first and a far document."""
    return _queries(spark, sf_dir).select("qid", F.concat(F.regexp_replace("text", r"[.!?]\s*$", ""), F.lit(" [1]. And more of it is said there [2][9].")).alias("answer"))


@register("citation_pr", rf"""{_TOP}, c AS (SELECT qid, substring(x.text, 1, 300) AS content, row_number() OVER (PARTITION BY qid ORDER BY rank) AS number FROM b5 JOIN d USING (doc_id) JOIN documents x USING (doc_id) WHERE regexp_full_match(pmid, '[0-9]+')),
a AS (SELECT qid, string_split(regexp_replace(regexp_replace(regexp_replace(text, '[.!?]\s*$', '') || ' [1]. And more of it is said there [2][9].', '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM q),
e AS (SELECT qid, i AS "at", s[i] AS s FROM a, unnest(range(1, len(s) + 1)) AS r(i)),
st AS (SELECT qid, "at", trim(regexp_replace(s, '\[\d+\]', '', 'g'), ' ') AS statement, list_distinct(list_transform(regexp_extract_all(s, '\[(\d+)\]', 1), lambda m: CAST(m AS INTEGER))) AS marks FROM e),
sm AS (SELECT qid, "at", statement, CASE WHEN len(marks) = 0 THEN [NULL] ELSE marks END AS marks FROM st WHERE length(statement) >= 10),
p AS (SELECT sm.qid, "at", statement, m AS number FROM sm, unnest(marks) AS u(m)),
j AS (SELECT p.qid, "at", statement, p.number, content, list_distinct({_WS.format('statement')}) AS asked FROM p LEFT JOIN c ON c.qid = p.qid AND c.number = p.number),
g AS (SELECT qid, "at", any_value(asked) AS asked, string_agg(coalesce(content, ''), ' ' ORDER BY number) AS together, count(content) AS n_cited,
  count(*) FILTER (WHERE content IS NOT NULL AND len(list_intersect(asked, {_WS.format("coalesce(content, '')")})) / greatest(len(asked), 1) > 0.5) AS n_right FROM j GROUP BY qid, "at")
SELECT qid, count(*) AS n_statements, CAST(sum(n_cited) AS BIGINT) AS n_citations, floor(avg(CASE WHEN n_cited > 0 AND len(list_intersect(asked, {_WS.format('together')})) / greatest(len(asked), 1) > 0.5 THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5) / 1e6 AS recall,
  floor(coalesce(sum(n_right) / nullif(sum(n_cited), 0), 0.0) * 1e6 + 0.5) / 1e6 AS precision FROM g GROUP BY qid""")
def citation_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cite.citation_scores(_answers(spark, sf_dir), cite.citable(_five(spark, sf_dir)))


@register("citation_pr_graded", rf"""{_TOP}, a AS (SELECT qid, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20)[1:8] AS s FROM q),
e AS (SELECT qid, i AS "at", list_distinct({_WS.format('s[i]')}) AS asked FROM a, unnest(range(1, len(s) + 1)) AS r(i)),
f AS (SELECT qid, rank, {_WS.format('substring(x.text, 1, 400)')} AS w FROM b5 JOIN documents x USING (doc_id)),
g AS (SELECT e.qid, "at", rank, len(list_intersect(asked, w)) / greatest(len(asked), 1) AS e FROM e JOIN f ON e.qid = f.qid),
r AS (SELECT qid, avg(CASE WHEN m > 0.6 THEN 1.0 WHEN m > 0.3 THEN 0.5 ELSE 0.0 END) AS r FROM (SELECT qid, "at", max(e) AS m FROM g GROUP BY qid, "at") GROUP BY qid),
p AS (SELECT qid, avg(CASE WHEN m > 0.3 THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT qid, rank, max(e) AS m FROM g GROUP BY qid, rank) GROUP BY qid)
SELECT r.qid, floor(r * 1e6 + 0.5) / 1e6 AS recall, floor(p * 1e6 + 0.5) / 1e6 AS precision, floor(2 * r * p / nullif(r + p, 0) * 1e6 + 0.5) / 1e6 AS f1 FROM r JOIN p ON r.qid = p.qid""")
def citation_pr_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cite.graded_scores(_queries(spark, sf_dir).withColumnRenamed("text", "answer"), _five(spark, sf_dir))


@register("rouge_l")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns against the turn before."""
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return compress.rouge_l(c.select("conv_id", "turn", F.col("text").alias("answer")).join(before, ["conv_id", "turn"])).select("conv_id", "turn", "rouge_l")


@register("reasoning_scores", rf"""WITH t AS (SELECT a.conv_id, a.turn, a.text AS reasoning, b.text AS context FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
x AS (SELECT conv_id, turn, reasoning, context, ['the', 'answer', 'to', 'this', 'medical', 'question', 'is:', 'supported.'] AS h, list_distinct({_WS.format('substring(reasoning, 1, 256)')}) AS asked FROM t)
SELECT conv_id, turn, CASE WHEN reasoning <> '' THEN floor(len(list_intersect(h, {_WS.format('substring(reasoning, 1, 512)')})) / 8 * 1e6 + 0.5) / 1e6 END AS faithfulness,
  CASE WHEN reasoning <> '' AND context <> '' THEN floor(len(list_intersect(asked, {_WS.format("substring(context, 1, 512)")})) / greatest(len(asked), 1) * 1e6 + 0.5) / 1e6 END AS grounding FROM x""")
def reasoning_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as reasoning, the turn before as its context."""
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    rows = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reasoning"), F.lit("supported").alias("label")).join(before, ["conv_id", "turn"], "left")
    return cite.reasoning_scores(rows).select("conv_id", "turn", "faithfulness", "grounding")


_WORDS_OF = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda w: w <> ''))"


@register("model_hooks", f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS text, coalesce(source, '') || ' ' || coalesce(lang, '') AS claim FROM documents),
c AS (SELECT doc_id, text, {_WORDS_OF.format('text')} AS a, {_WORDS_OF.format('claim')} AS b FROM t)
SELECT doc_id, CAST(length(regexp_replace(text, '[^a-z]', '', 'g')) AS DOUBLE) AS letters, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e,
  CASE WHEN len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(len(b) AS DOUBLE) END AS support FROM c""")
def model_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the stand-ins of an encoder and of an entailment model, each loaded once a worker and asked in batches."""
    encode, entails = hooks.batched(hooks.letter_encoder, "array<double>"), hooks.batched(hooks.shared_words, "double")
    docs = table(spark, sf_dir, "documents")
    claim = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    made = docs.select("doc_id", encode(F.col("text")).alias("vector"), entails(F.col("text"), claim).alias("support"))
    return made.select("doc_id", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("letters"), F.get("vector", F.lit(4)).alias("e"), "support")
