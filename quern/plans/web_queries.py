"""Queries over web hits: the pages stand for the hits of each benchmark item that shares a term with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import web
from quern.plans.catalog import register
from quern.plans.text_queries import _DOMAIN
from quern.tables import table

_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g'), ' ')"
_BODY = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), ' ')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), r"\s+", " "))
    body = T.strip_tags(F.regexp_extract("html", r"(?is)<p\b[^>]*>(.*?)</p>", 1), "")
    return table(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"), body.alias("snippet"), (F.col("page_id") % 10).alias("rank"), (F.col("page_id") % 3).alias("query_idx"))


_P = f"p AS (SELECT page_id, url, {_DOMAIN} AS domain, {_TITLE} AS title, {_BODY} AS snippet, page_id % 10 AS rank, page_id % 3 AS query_idx FROM pages)"
_KNOWN = " ".join(f"WHEN domain = '{d}' OR ends_with(domain, '.{d}') THEN {w}" for d, w in web.DOMAIN_WEIGHTS.items())
_PRIORITY = f"""CAST(CASE {_KNOWN} WHEN regexp_matches(domain, '{'|'.join(m.replace('.', chr(92) + '.') for m in web.LESSER_DOMAINS)}') THEN -1.2 WHEN regexp_matches(domain, 'blog|forum') THEN -0.8
  WHEN ends_with(domain, '.gov') OR contains(domain, '.gov.') OR ends_with(domain, '.int') THEN 0.8 WHEN ends_with(domain, '.edu') OR contains(domain, '.ac.in') THEN 0.5 ELSE 0.0 END AS DOUBLE)"""


@register("domain_priority", f"WITH {_P} SELECT page_id, domain, {_PRIORITY} AS priority FROM p")
def domain_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = T.url_domain(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", domain.alias("domain"), web.domain_priority(domain).alias("priority"))


_TERMS = r"list_distinct(regexp_extract_all(lower({}), '[a-z0-9][a-z0-9\-]{{2,}}'))"
_H = f"""{_P}, pt AS (SELECT *, {_TERMS.format("title || ' ' || snippet")} AS pt FROM p), it AS (SELECT item_id, {_TERMS.format('text')} AS it FROM benchmark),
h AS (SELECT item_id AS qid, page_id, url, domain, CAST(rank AS BIGINT) AS rank, floor((1.0 + len(list_intersect(it, pt)) / greatest(len(it), 1) + {_PRIORITY} - rank * CAST(0.05 AS DOUBLE) - query_idx * CAST(0.02 AS DOUBLE)
  - CASE WHEN length(snippet) < 40 THEN CAST(0.1 AS DOUBLE) ELSE 0 END - CASE WHEN regexp_matches(lower(url), '{'|'.join(web.LESSER_PATHS)}') THEN CAST(0.6 AS DOUBLE) ELSE 0 END) * 1e6 + 0.5) / 1e6 AS score
  FROM pt, it WHERE len(list_intersect(it, pt)) > 0)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, page_id, url, domain, rank, score of the pages whose title or snippet shares a term with the item."""
    pages = _pages(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("claim"))
    terms = pages.select("page_id", F.explode(T.web_terms(F.concat_ws(" ", "title", "snippet"))).alias("term"))
    pairs = terms.join(items.select("qid", F.explode(T.web_terms(F.col("claim"))).alias("term")), "term").select("qid", "page_id").distinct()
    score = web.live_score(*[F.col(c) for c in ("claim", "title", "snippet", "url", "rank", "query_idx")])
    return pairs.join(pages, "page_id").join(items, "qid").select("qid", "page_id", "url", T.url_domain(F.col("url")).alias("domain"), "rank", T.quantised(score).alias("score"))


@register("live_score", f"WITH {_H} SELECT qid, page_id, score FROM h")
def live_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("qid", "page_id", "score")


@register("url_best", f"WITH {_H}, x AS (SELECT *, 'https://' || domain AS site FROM h) SELECT qid, site AS url, max(score) AS score, CAST(min(rank) AS BIGINT) AS first, count(*) AS hits FROM x GROUP BY qid, site")
def url_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each domain taken as one address, so that addresses repeat."""
    sites = _hits(spark, sf_dir).withColumn("url", F.concat(F.lit("https://"), "domain"))
    best = web.best_per_url(sites.select("qid", "url", "rank", "score")).select("qid", "url", "score", "first")
    return best.join(sites.groupBy("qid", "url").agg(F.count(F.lit(1)).alias("hits")), ["qid", "url"])


@register("domain_diversify", f"""WITH {_H}, d AS (SELECT *, row_number() OVER (PARTITION BY qid, domain ORDER BY score DESC, page_id) AS k FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY k > 1, score DESC, page_id) - 1 AS place FROM d) SELECT qid, CAST(place AS INTEGER) AS place, page_id, domain, score FROM o WHERE place < 5""")
def domain_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).withColumn("rank", F.col("page_id"))
    return web.diversify(hits).select("qid", "place", "page_id", "domain", "score")
