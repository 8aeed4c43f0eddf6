"""Web hits: score, best per URL, spread over domains.

Hits are rows of (qid, rank, query_idx, url, title, snippet).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

# The weight of a domain and its subdomains, in the order in which they are looked up.
DOMAIN_WEIGHTS = {
    "pubmed.ncbi.nlm.nih.gov": 3.0, "ncbi.nlm.nih.gov": 2.8, "nih.gov": 2.3, "who.int": 2.2, "cdc.gov": 2.2, "mohfw.gov.in": 2.5,
    "icmr.gov.in": 2.5, "nhp.gov.in": 2.0, "pib.gov.in": 1.8, "ncdc.mohfw.gov.in": 2.4, "nhm.gov.in": 1.8, "ayush.gov.in": 1.2,
}
# Marks of domains and addresses that count less.
LESSER_DOMAINS = (
    "reddit.com", "quora.com", "facebook.com", "instagram.com", "x.com", "twitter.com", "youtube.com", "tiktok.com", "blogspot.", "wordpress.",
    "medium.com", "pinterest.com",
)
LESSER_PATHS = ("/shop", "/product", "/products", "/buy", "/forum", "/forums")


def domain_priority(domain: Column) -> Column:
    """The domain's weight by the first rule that fits."""
    has = lambda *marks: F.rlike(domain, F.lit("|".join(m.replace(".", r"\.") for m in marks)))
    known = F.coalesce(*[F.when(T.domain_matches(domain, d), F.lit(w)) for d, w in DOMAIN_WEIGHTS.items()])
    rest = (
        F.when(has(*LESSER_DOMAINS), -1.2).when(has("blog", "forum"), -0.8)
        .when(F.endswith(domain, F.lit(".gov")) | F.contains(domain, F.lit(".gov.")) | F.endswith(domain, F.lit(".int")), 0.8)
        .when(F.endswith(domain, F.lit(".edu")) | F.contains(domain, F.lit(".ac.in")), 0.5).otherwise(0.0)
    )
    return F.coalesce(known, rest)


def live_score(claim: Column, title: Column, snippet: Column, url: Column, rank: Column, query_idx: Column) -> Column:
    """1, plus the share of the claim's terms in title and snippet, plus the domain's weight, less for late ranks, short snippets and shops."""
    terms = T.web_terms(claim)
    shared = F.size(F.array_intersect(terms, T.web_terms(F.concat_ws(" ", title, snippet)))) / F.greatest(F.size(terms), F.lit(1))
    shop = F.rlike(F.lower(url), F.lit("|".join(LESSER_PATHS)))
    return (
        1.0 + shared + domain_priority(T.url_domain(url)) - rank * 0.05 - query_idx * 0.02
        - F.when(F.length(snippet) < 40, 0.1).otherwise(0.0) - F.when(shop, 0.6).otherwise(0.0)
    )


def best_per_url(hits: DataFrame) -> DataFrame:
    """One row for each (qid, url): the highest score, of equals the first; ``first`` is the url's first place."""
    order = F.struct(F.col("score").alias("score"), (-F.col("rank")).alias("early"))
    rest = [c for c in hits.columns if c not in ("qid", "url")]
    best = hits.groupBy("qid", "url").agg(F.max_by(F.struct(*rest), order).alias("best"), F.min("rank").alias("first"))
    return best.select("qid", "url", "best.*", "first")


def diversify(hits: DataFrame, k: int = 5) -> DataFrame:
    """The k best hits of each query, one a domain as long as there are new domains, then by score; adds ``place`` from 0."""
    in_domain = F.row_number().over(Window.partitionBy("qid", "domain").orderBy(F.desc("score"), "rank"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("_d") > 1, F.desc("score"), "rank")) - 1
    return hits.withColumn("_d", in_domain).withColumn("place", place).filter(F.col("place") < k).drop("_d")


def render(title: Column, url: Column, retrieved_at: Column, published: Column, full_text: Column, snippet: Column) -> Column:
    """The hit as a document: its metadata, then the page's text if there is enough of it, else the snippet."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        "\n", F.concat(F.lit("URL: "), url), F.concat(F.lit("Domain: "), T.url_domain(url)), F.concat(F.lit("Retrieved at: "), retrieved_at), F.concat(F.lit("Published: "), some(published)),
        F.coalesce(F.when(F.length(full_text) > 100, F.concat(F.lit("Content:\n"), full_text)), F.concat(F.lit("Snippet: "), some(snippet))),
        F.lit("Runtime note: This live web snippet/article is weak secondary evidence and requires human verification."),
    )
