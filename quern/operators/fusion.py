"""Reciprocal-rank fusion of ranked pools, and the routing that weighs the pools.

A pool is rows of (qid, pool, rank from 0, doc_id, title, pmid, url).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import quantised

RRF_K = 60


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def routed_key() -> Column:
    """url, else pmid, else id, else the first 40 characters of the title."""
    return F.coalesce(_filled(F.col("url"), F.col("pmid")), F.nullif(F.col("id"), F.lit("")), F.substring("title", 1, 40))


def evaluated_key() -> Column:
    """pmid, else id, else the first 50 characters of the title."""
    return F.coalesce(_filled(F.col("pmid"), F.col("id")), F.substring("title", 1, 50))


def pubmed_key() -> Column:
    """pmid, else title, else the rank."""
    return F.coalesce(_filled(F.col("pmid"), F.col("title")), F.col("rank").cast("string"))


def rrf(pools: DataFrame, weights: dict[str, float | Column], k: int, key: Column, offset: int = RRF_K) -> DataFrame:
    """qid, rank, doc_id, key, score: the sum of weight / (offset + rank + 1) over each key's places.

    Documents of one key collapse and add up; the first by (pool, rank) stands for
    them, and ties go to it.  Pools are taken in the order of ``weights``, which may be
    expressions over the pools' columns.
    """
    names = list(weights)
    weight = F.coalesce(*[F.when(F.col("pool") == n, w if isinstance(w, Column) else F.lit(float(w))) for n, w in weights.items()])
    place = F.coalesce(*[F.when(F.col("pool") == n, F.lit(i)) for i, n in enumerate(names)])
    fused = (
        pools.filter(F.col("pool").isin(names)).withColumn("_key", key)
        .groupBy("qid", "_key").agg(
            quantised(F.sum(weight / (F.col("rank") + offset + 1)) * 1e3).alias("score"),
            F.min(F.struct(place.alias("place"), F.col("rank").alias("at"), F.col("doc_id").alias("doc_id"))).alias("first"),
        )
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1).select("qid", "rank", F.col("first.doc_id").alias("doc_id"), F.col("_key").alias("key"), "score")


def concatenated(hits: DataFrame, order: str = "sub") -> DataFrame:
    """Hits of a query's sub-queries one after the other: the rank goes on across sub-queries."""
    window = Window.partitionBy("qid").orderBy(order, "rank")
    return hits.withColumn("rank", F.row_number().over(window) - 1)


# The words (as substrings) that speak for each domain, in the order in which ties are decided.
DOMAIN_WORDS = {
    "pharmacology": [
        "drug", "medication", "dose", "dosage", "mg", "pill", "tablet", "capsule", "antibiotic", "receptor", "toxicity", "overdose", "contraindicated",
        "side effect", "adverse", "brand", "generic", "ingredient", "inhibitor", "agonist", "antagonist", "bioavailability", "half-life", "pharmacokinetic",
    ],
    "anatomy": [
        "nerve", "artery", "vein", "muscle", "bone", "organ", "tissue", "cell", "anatomical", "structure", "location", "region", "innervation",
        "blood supply", "lymph", "ligament", "tendon", "histology", "morphology", "cortex", "nucleus",
    ],
    "clinical": [
        "patient", "treatment", "therapy", "diagnosis", "symptom", "sign", "prognosis", "prevalence", "incidence", "risk factor", "comorbidity",
        "management", "guideline", "surgery", "outcome", "mortality", "trial", "study", "cohort",
    ],
}
# Each domain's preferred relations, hops and share of the graph pool.
DOMAIN_RELATIONS = {
    "pharmacology": [
        "may_treat", "may_prevent", "mechanism_of_action", "has_mechanism_of_action", "has_physiologic_effect", "has_active_ingredient",
        "has_ingredient", "has_target", "contraindicated_with", "has_tradename", "tradename_of",
    ],
    "anatomy": ["finding_site", "part_of", "has_part", "component_of", "associated_with", "occurs_in", "classified_as"],
    "clinical": [
        "causes", "associated_with", "disease_may_have_finding", "disease_may_have_associated_disease", "has_manifestation", "due_to",
        "may_be_treated_by", "may_treat", "causative_agent",
    ],
    "general": [],
}
DOMAIN_HOPS = {"pharmacology": 4, "anatomy": 3, "clinical": 4, "general": 3}
GRAPH_WEIGHT = {"pharmacology": 0.6, "anatomy": 0.6, "clinical": 0.45, "general": 0.45}


def domain_hits(text: Column, domain: str) -> Column:
    """How many of the domain's words the text holds, as substrings."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in DOMAIN_WORDS[domain][1:]), F.contains(low, F.lit(DOMAIN_WORDS[domain][0])).cast("int"))


def classify_domain(text: Column) -> Column:
    """The domain with the most hits, the first of equals; ``general`` without hits."""
    hits = {d: domain_hits(text, d) for d in DOMAIN_WORDS}
    best = F.greatest(*hits.values())
    return F.when(best == 0, "general").otherwise(F.coalesce(*[F.when(h == best, d) for d, h in hits.items()]))


def route(queries: DataFrame) -> DataFrame:
    """qid, domain, hops, relations (comma-joined), graph_weight, pubmed_weight, live_weight."""
    mapped = lambda values: F.element_at(F.create_map(*[x for d, v in values.items() for x in (F.lit(d), F.lit(v))]), F.col("domain"))
    return queries.select("qid", classify_domain(F.col("text")).alias("domain")).select(
        "qid", "domain", mapped(DOMAIN_HOPS).alias("hops"), mapped({d: ",".join(r) for d, r in DOMAIN_RELATIONS.items()}).alias("relations"),
        mapped(GRAPH_WEIGHT).alias("graph_weight"), quantised(1 - mapped(GRAPH_WEIGHT)).alias("pubmed_weight"), F.lit(0.2).alias("live_weight"),
    )
