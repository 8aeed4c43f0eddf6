"""The operators applied to the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, decontaminate, language, lines, middle, mixing, ppm, secrets, simhash, substrings, topk, toxicity, whitening
from quern.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).documents


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substrings.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "first_doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_bytes"), "n_chunks")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = lines.repeated_chunks(table(spark, sf_dir, "documents"))
    return gone.select("doc_id", "first_doc_id", F.col("start").alias("first_line"), F.col("stop").alias("end_line"), (F.col("stop") - F.col("start")).alias("n_lines"))


def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_corpus(table(spark, sf_dir, "documents"))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations")).withColumn("text_md5", F.md5("text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP3_SQL = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, row_number() OVER (), regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') FROM benchmark
), shingled AS (
  SELECT kind, id, r, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    ELSE [array_to_string(w, ' ')] END) AS s
  FROM words WHERE len(w) > 0
), kept AS (
  SELECT DISTINCT kind, id, r, s FROM shingled
), items AS (
  SELECT id AS item_id, r AS item_r, s, count(*) OVER (PARTITION BY id, r) AS n FROM kept WHERE kind = 1
), shared AS (
  SELECT item_id, item_r, d.id AS doc_id, d.r, n, count(*) AS m
  FROM items JOIN kept d ON d.kind = 0 AND d.s = items.s
  GROUP BY ALL
), best AS (
  SELECT item_id, doc_id, n, m, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY m / n DESC, n DESC) AS k
  FROM shared WHERE m >= 0.8 * n - 1e-9
)
SELECT item_id, doc_id, CAST(n AS BIGINT) AS n_shingles, CAST(m AS BIGINT) AS n_shared, CAST(m AS DOUBLE) / CAST(n AS DOUBLE) AS containment
FROM best WHERE k = 1
"""

OP6_SQL = r"""
WITH clean AS (
  SELECT DISTINCT conv_id, turn, replace(coalesce(nullif(trim(role, ' '), ''), 'unknown'), '<|', '< |') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM clean WHERE role <> 'system'
), shown AS (
  SELECT c.conv_id, dense_rank() OVER (PARTITION BY c.conv_id, speaker ORDER BY floor(turn / 1024) NULLS FIRST) - 1 AS part,
    speaker, turn, role, said, md5(role || chr(10) || said) AS tie, role = speaker AS own,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head,
    said || '<|im_end|>' AS body
  FROM clean c JOIN speakers s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM shown
), rendered AS (
  SELECT conv_id, part, speaker, CAST(min(begins) AS BIGINT) AS "start", CAST(count(*) AS BIGINT) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_own,
    string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, tie) AS text,
    coalesce(string_agg(CASE WHEN own THEN CAST(begins + length(head) AS BIGINT) || ':' || CAST(begins + length(head) + length(body) AS BIGINT) END, ',' ORDER BY turn NULLS FIRST, tie), '') AS mask
  FROM placed GROUP BY conv_id, part, speaker
)
SELECT *, md5(text) AS text_md5 FROM rendered
"""


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.c), len(v.c)) + 1), lambda i: q.c[i] * v.c[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
    text = '' OR regexp_matches(text, '<[PSM]>') OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 90 AS plain, CAST('0x' || d[25:32] AS BIGINT) % 100 < 20 AS spm
  FROM drawn
), cuts AS (
  SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM units
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cuts
)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_line_dedup": op4_line_dedup,
        "op5_ppm_score": op5_ppm_score,
        "op6_chat_perspectives": op6_chat_perspectives,
        "op7_toxicity": op7_toxicity,
        "op8_simhash": op8_simhash,
        "op9_topk": op9_topk,
        "op10_secrets": op10_secrets,
        "op11_language": op11_language,
        "op12_whitening": op12_whitening,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracles() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op6_chat_perspectives": OP6_SQL, "op9_topk": OP9_SQL, "op13_fill_in_middle": OP13_SQL}
