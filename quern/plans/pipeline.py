"""The verification pipeline over a whole table of questions at once.

decompose, retrieve and fuse, compress, vote, decide, cite: one DataFrame a stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.labels import normalize_answer
from quern.functions.text import quantised, render_options, url_domain
from quern.hooks import Hooks
from quern.operators import cite, compress, fusion, graph, retrieval, vectors, votes, web
from quern.operators.postings import TextIndex
from quern.storage import materialize
from quern.streaming.resume import pending

MODES = ("bm25", "search", "fused", "dense", "graph", "moe_flat", "moe_graph")
#: A graph's and a search's documents have no id in the corpus: theirs are negative, from these down.
GRAPH_IDS, LIVE_IDS = -1, -1_000_000_000
COLUMNS = ("qid", "rank", "doc_id", "title", "content", "pmid", "id", "url")


@dataclass(frozen=True)
class Settings:
    """mode: which pools; k: documents a question; alpha: weight of recency (needs years); votes, models: the ensemble.

    ``bm25``, ``search`` (full text), ``dense`` (vectors and an encoder) and ``graph`` are single
    pools; ``fused`` joins the first two; ``moe_flat`` and ``moe_graph`` weigh the corpus pool (dense
    if there are vectors, else search), the graph pool and, with ``live``, a live search by
    the question's domain.
    """

    mode: str = "fused"
    k: int = 20
    pool: int = 50
    alpha: float = 0.0
    n_votes: int = 3
    models: list[str] = field(default_factory=lambda: ["model"])
    compress: bool = True
    context_length: int = 32768
    ratio: float = 0.4
    nei_share: float | None = None
    live: bool = False
    live_k: int = 5


class Pipeline:
    """docs(doc_id, title, content, pmid, id, url[, year]) as the corpus; ``verify`` takes questions(id, question, options).

    ``vectors(doc_id, embedding)`` and the graph's ``nodes`` and ``edges`` are for the modes that need them; an ``index`` of
    the documents' titles and contents is searched in place of the texts.
    """

    def __init__(
        self, docs: DataFrame, settings: Settings | None = None, hooks: Hooks | None = None, *,
        vectors: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, index: TextIndex | None = None,
    ):
        self.docs, self.settings, self.hooks = docs, settings or Settings(), hooks or Hooks()
        self.vectors, self.nodes, self.edges, self.index = vectors, nodes, edges, index
        mode = self.settings.mode
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if mode == "dense" and vectors is None or vectors is not None and self.hooks.encode is None:
            raise ValueError("dense retrieval needs vectors and the encode hook")
        if mode in ("graph", "moe_graph") and (nodes is None or edges is None):
            raise ValueError("graph retrieval needs nodes and edges")
        if self.settings.live and self.hooks.search is None:
            raise ValueError("live retrieval needs the search hook")

    def _corpus_pool(self, name: str, queries: DataFrame, k: int) -> DataFrame:
        """qid, rank, doc_id of one way to search the corpus."""
        s = self.settings
        if name == "dense":
            found = vectors.cosine_topk(self.vectors.select(F.col("doc_id").alias("vec_id"), "embedding"), self.hooks.encode(queries), k)
            return found.select("qid", "rank", F.col("vec_id").alias("doc_id"))
        dated = bool(s.alpha) and "year" in self.docs.columns
        corpus = self.docs.select("doc_id", F.concat_ws(" ", "title", "content").alias("content"), *["year"] * dated)
        if name == "bm25":
            return retrieval.bm25_topk(corpus, queries, k, year=F.col("year") if dated else None, alpha=s.alpha, index=self.index).select("qid", "rank", "doc_id")
        return retrieval.search_topk(corpus, queries, k, index=self.index).select("qid", "rank", "doc_id")

    def _named(self, ranked: DataFrame) -> DataFrame:
        # What was found goes to the documents, whose texts stay where they are.
        found = retrieval.small(materialize(ranked.select("qid", "rank", "doc_id"), "found"))
        return self.docs.select("doc_id", "title", "content", "pmid", "id", "url").join(found, "doc_id").select(*COLUMNS)

    def _graph_pool(self, queries: DataFrame, options: DataFrame | None) -> DataFrame:
        entities = queries.select("qid", F.posexplode(self.hooks.decompose(F.col("text"))).alias("at", "text"))
        options = entities.filter("false") if options is None else options
        claims = queries.select("qid", self.hooks.propose(F.col("text")).alias("propositions"))
        seeded = materialize(graph.seeds(queries, entities, options, self.nodes), "seeds")
        found = graph.retrieve(queries, seeded, self.nodes, self.edges, claims, self.settings.k)
        none = F.lit("")
        return found.select("qid", "rank", (GRAPH_IDS - F.col("rank")).cast("long").alias("doc_id"), "title", "content", none.alias("pmid"), none.alias("id"), none.alias("url"))

    def _live_pool(self, queries: DataFrame) -> DataFrame:
        """The live search's hits, the best of an address and then of a domain first."""
        hits = self.hooks.search(queries).join(queries.withColumnRenamed("text", "claim"), "qid")
        score = quantised(web.live_score(*[F.col(c) for c in ("claim", "title", "snippet", "url", "rank", "query_idx")]))
        best = web.best_per_url(hits.select("qid", "url", "rank", "title", "snippet", score.alias("score"))).drop("rank").withColumnRenamed("first", "rank")
        placed = web.diversify(best.withColumn("domain", url_domain(F.col("url"))), self.settings.live_k)
        none = F.lit("")
        text = web.render(F.col("title"), F.col("url"), none, none, none, F.col("snippet"))
        return placed.select("qid", F.col("place").alias("rank"), (LIVE_IDS - F.col("place")).cast("long").alias("doc_id"), "title", text.alias("content"), none.alias("pmid"), none.alias("id"), "url")

    def retrieve(self, queries: DataFrame, options: DataFrame | None = None) -> DataFrame:
        """qid, rank, doc_id and the documents' columns, for queries(qid, text) and options(qid, at, text)."""
        s = self.settings
        if s.mode in ("bm25", "search", "dense"):
            return materialize(self._named(self._corpus_pool(s.mode, queries, max(s.k, s.pool)).filter(F.col("rank") < s.k)), "ranked")
        if s.mode == "graph":
            return materialize(self._graph_pool(queries, options), "ranked")
        weights: dict[str, float | Column]
        if s.mode == "fused":
            pools = {n: self._named(self._corpus_pool(n, queries, s.pool)) for n in ("bm25", "search")}
            weights, key = {"bm25": 0.4, "search": 0.6}, fusion.evaluated_key()
        else:
            pools, weights, key = {}, {}, fusion.routed_key()
            if s.mode == "moe_graph":
                pools["graph"], weights["graph"] = self._graph_pool(queries, options), F.col("graph_weight")
            name = "dense" if self.vectors is not None else "search"
            pools[name], weights[name] = self._named(self._corpus_pool(name, queries, min(s.k, 25))), F.col("pubmed_weight") if pools else 1.0
            if s.live:
                pools["live"], weights["live"] = self._live_pool(queries), F.col("live_weight")
        union = None
        for name, pool in pools.items():
            rows = pool.withColumn("pool", F.lit(name))
            union = rows if union is None else union.unionByName(rows)
        union = materialize(union, "pools")
        if len(pools) == 1:
            return union.filter(F.col("rank") < s.k).drop("pool")
        weighed = union.join(fusion.route(queries).select("qid", "graph_weight", "pubmed_weight", "live_weight"), "qid")
        ranked = fusion.rrf(weighed, weights, s.k, key).select("qid", "rank", "doc_id")
        return materialize(ranked.join(union.drop("pool", "rank").dropDuplicates(["qid", "doc_id"]), ["qid", "doc_id"]).select(*COLUMNS), "ranked")

    def verify(self, questions: DataFrame) -> DataFrame:
        """id, choice, n_votes, n_winner, n_choices, vote_distribution, propositions, retrieved_context, reference_block of every question; with the hook ``entails`` also support."""
        s, hooks = self.settings, self.hooks
        asked = questions.select(F.col("id").alias("qid"), F.col("question").alias("text"))
        entries = questions.select(F.col("id").alias("qid"), F.posexplode(F.array_sort(F.map_entries("options"))).alias("at", "entry"))
        pool = self.retrieve(asked, entries.select("qid", "at", F.col("entry.value").alias("text")))
        if hooks.rerank:
            ranked = retrieval.overlap_rerank(pool.select("qid", "rank", "doc_id", "content"), asked, hooks.rerank).select("qid", "rank", "doc_id")
            pool = materialize(ranked.join(pool.drop("rank"), ["qid", "doc_id"]).select(*COLUMNS), "reranked")
        if hooks.compress:
            contexts = hooks.compress(pool, asked)
        elif s.compress:
            picked = compress.mmr(pool, asked, context_length=s.context_length, ratio=s.ratio)
            contexts = compress.compressed_context(picked, pool)
        else:
            contexts = compress.raw_context(pool)
        claims = questions.select(F.col("id").alias("qid"), hooks.propose(F.col("question")).alias("propositions"))
        prompts = questions.join(contexts, F.col("id") == F.col("qid"), "left").select("id", F.concat_ws("\n\n", F.col("context"), F.col("question"), render_options(F.col("options"))).alias("prompt"), F.coalesce("context", F.lit("")).alias("retrieved_context"))
        prompts = materialize(prompts, "prompts")
        cast = votes.assign_models(prompts, s.models, s.n_votes).join(prompts.select("id", "prompt"), "id")
        cast = cast.withColumn("choice", normalize_answer(hooks.generate(F.col("prompt"), F.col("vote_idx"))))
        verdicts = votes.ensemble(cast)
        if s.nei_share is not None:
            verdicts = votes.below_threshold(verdicts, s.nei_share)
        if hooks.entails:
            held = prompts.select("id", "retrieved_context").join(claims, F.col("id") == F.col("qid"))
            each = held.select("qid", "retrieved_context", F.posexplode("propositions").alias("at", "claim")).withColumn("share", hooks.entails(F.col("retrieved_context"), F.col("claim")))
            support = each.groupBy(F.col("qid").alias("_qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "share"))), lambda x: x["share"]).alias("support"))
            claims = claims.join(support, F.col("qid") == F.col("_qid"), "left").drop("_qid")
        blocks = cite.references(cite.citable(pool)).withColumnRenamed("block", "reference_block")
        return (
            verdicts.join(prompts.select("id", "retrieved_context"), "id").join(claims, F.col("id") == F.col("qid"), "left").drop("qid")
            .join(blocks, F.col("id") == F.col("qid"), "left").drop("qid")
        )

    def batch_verify(self, questions: DataFrame, done: DataFrame | None = None) -> DataFrame:
        """``verify`` of the questions that are not in ``done`` yet."""
        return self.verify(questions if done is None else pending(questions, done))
