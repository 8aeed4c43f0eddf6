"""Queries over loaders, splits, resumption and experiments, with rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.labels import dataset_of
from quern.plans import experiments
from quern.plans.catalog import register
from quern.sources import articles, rest, sinks
from quern.sources import datasets as D
from quern.storage import reserve
from quern.streaming import resume
from quern.tables import table


@register("load_medqa", """SELECT item_id AS id, text AS question, CASE item_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'C' ELSE 'A' END AS answer, CAST(CASE WHEN item_id % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n_options FROM benchmark""")
def load_medqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(
        i.alias("id"), F.col("text").alias("question"), F.lit("one").alias("A"), F.lit("two").alias("B"), F.when(i % 2 == 0, "three").otherwise("").alias("C"), F.lit(None).cast("string").alias("D"), F.lit("").alias("E"),
        F.when(i % 4 == 0, " b").when(i % 4 == 1, "C").when(i % 4 == 2, "c").otherwise(None).alias("answer_idx"))
    return D.from_medqa(rows).select("id", "question", "answer", F.size("options").alias("n_options"))


@register("load_medmcqa", "SELECT p_partkey AS id, CASE WHEN p_size % 6 <= 3 THEN chr(65 + p_size % 6) ELSE 'A' END AS answer FROM part")
def load_medmcqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), *[F.lit(x).alias(f"op{x}") for x in "abcd"], (F.col("p_size") % 6).alias("cop"))
    return D.from_medmcqa(rows).select("id", "answer")


@register("load_pubmedqa", "SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'B' ELSE 'C' END AS answer FROM events")
def load_pubmedqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "Yes").when(F.col("event_type") == "error", " no").otherwise(F.col("event_type"))
    return D.from_pubmedqa(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("").alias("question"), kind.alias("final_decision"))).select("id", "answer")


@register("load_bioasq", "SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'A' ELSE 'B' END AS answer, CASE WHEN event_type = 'click' THEN 'yes' ELSE 'no' END AS label FROM events WHERE event_type IN ('click', 'error') AND event_id % 3 <> 0")
def load_bioasq(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "Yes ").when(F.col("event_type") == "error", "no").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("?").alias("body"), F.when(F.col("event_id") % 3 == 0, "list").otherwise("yesno").alias("type"), kind.alias("exact_answer"))
    return D.from_bioasq(rows).select("id", "answer", "label")


@register("load_mmlu", "SELECT item_id AS id, chr(CAST(65 + item_id % 4 AS INTEGER)) AS answer, CAST(4 AS INTEGER) AS n_options FROM benchmark")
def load_mmlu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.array(*[F.lit(x) for x in ("one", "two", "three", "four")]).alias("choices"), (F.col("item_id") % 4).cast("int").alias("answer"))
    return D.from_mmlu(rows).select("id", "answer", F.size("options").alias("n_options"))


@register("load_medqa_nested", "SELECT item_id AS id, CASE item_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'two' ELSE '' END AS answer, CAST(2 AS INTEGER) AS n_options FROM benchmark")
def load_medqa_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(i.alias("id"), F.col("text").alias("question"), F.create_map(F.lit("A"), F.lit("one"), F.lit("B"), F.lit("two")).alias("options"), F.when(i % 3 == 0, "B").alias("answer_idx"), F.when(i % 3 == 1, "two").alias("answer"))
    return D.from_medqa_nested(rows).select("id", "answer", F.size("options").alias("n_options"))


@register("load_bioasq_any", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_type = 'click' THEN 'A' ELSE 'B' END AS answer, event_id % 3 = 0 AS open FROM events")
def load_bioasq_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "yes").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(i.alias("id"), F.lit("?").alias("body"), F.when(i % 3 == 0, "summary").when(i % 3 == 1, "yesno").alias("type"), kind.alias("exact_answer"), F.col("event_type").alias("ideal_answer"))
    return D.from_bioasq_any(rows).select("id", "answer", F.col("options").isNull().alias("open"))


@register("load_medchangeqa", """WITH x AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' WHEN 2 THEN 'NOT ENOUGH INFORMATION' END AS l FROM benchmark)
SELECT 'q_' || (row_number() OVER (ORDER BY item_id) - 1) AS id, CASE l WHEN 'SUPPORTED' THEN 'A' WHEN 'REFUTED' THEN 'B' ELSE 'C' END AS answer, l AS label FROM x WHERE l IS NOT NULL""")
def load_medchangeqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    label = F.when(i % 4 == 0, "Supported").when(i % 4 == 1, "REFUTED").when(i % 4 == 2, "Not enough information").otherwise("OTHER")
    return D.from_medchangeqa(table(spark, sf_dir, "benchmark").select(i.alias("ord"), F.col("text").alias("question"), label.alias("newest_label"))).select("id", "answer", "label")


@register("load_scifact", """WITH x AS (SELECT p_name AS id, p_partkey AS o, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'SUPPORT' ELSE 'CONTRADICT' END AS l FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN l <> '' THEN 0 ELSE 1 END, o) AS k FROM x) SELECT id, CASE l WHEN 'SUPPORT' THEN 'A' WHEN 'CONTRADICT' THEN 'B' ELSE 'C' END AS answer FROM k WHERE k = 1""")
def load_scifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 3
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_partkey").alias("ord"), F.lit("").alias("claim"), F.when(s == 0, "").when(s == 1, "SUPPORT").otherwise("CONTRADICT").alias("evidence_label"))
    return D.from_scifact(rows).select("id", "answer")


@register("load_healthfc", "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'B' WHEN 3 THEN 'A' ELSE 'C' END AS answer FROM part")
def load_healthfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 5
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("en_claim"), F.when(s <= 2, s.cast("string")).when(s == 3, "Supported").otherwise("unclear").alias("label"))
    return D.from_healthfc(rows).select("id", "answer")


@register("hash_split_80_20", "WITH x AS (SELECT item_id, row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) AS k, count(*) OVER () AS n FROM benchmark) SELECT item_id, CASE WHEN k <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM x")
def hash_split_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hash_split(table(spark, sf_dir, "benchmark").select("item_id"), "item_id")


@register("percent_subset", "SELECT event_id FROM events ORDER BY event_id LIMIT (SELECT CAST(ceil(count(*) * 7 / 100.0) AS BIGINT) FROM events)")
def percent_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 7 per cent: a feature of the loaders."""
    return D.first_percent(table(spark, sf_dir, "events").select("event_id"), 7, "event_id")


@register("resume_anti", "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return resume.pending(questions, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@register("ablation_grid", """WITH s AS (SELECT DISTINCT p_brand AS tag FROM part), d AS (SELECT unnest(['bioasq', 'scifact', 'other']) AS dataset) SELECT tag, dataset FROM s, d WHERE dataset <> 'other' AND (dataset = 'bioasq' OR ends_with(tag, '1'))""")
def ablation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.endswith("p_brand", F.lit("1")), F.array(F.lit("bioasq"), F.lit("scifact"))).otherwise(F.array(F.lit("bioasq"), F.lit("missing")))
    specs = table(spark, sf_dir, "part").select("p_brand").distinct().select(F.col("p_brand").alias("tag"), named.alias("datasets"))
    known = spark.createDataFrame([("bioasq",), ("scifact",), ("other",)], "dataset string")
    return experiments.grid(specs, known).select("tag", "dataset")


@register("dataset_from_name", """WITH x AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'x_BioASQ_scifact.json' WHEN 1 THEN 'MedChangeQA' WHEN 2 THEN 'healthfc_medqa' WHEN 3 THEN url ELSE 'SCIFACT' END AS f FROM pages)
SELECT page_id, CASE WHEN contains(lower(f), 'bioasq') THEN 'bioasq' WHEN contains(lower(f), 'medchangeqa') THEN 'medchangeqa' WHEN contains(lower(f), 'healthfc') THEN 'healthfc' WHEN contains(lower(f), 'scifact') THEN 'scifact' WHEN contains(lower(f), 'medqa') THEN 'medqa' ELSE 'unknown' END AS dataset FROM x""")
def dataset_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id") % 5
    name = F.when(i == 0, "x_BioASQ_scifact.json").when(i == 1, "MedChangeQA").when(i == 2, "healthfc_medqa").when(i == 3, F.col("url")).otherwise("SCIFACT")
    return table(spark, sf_dir, "pages").select("page_id", dataset_of(name).alias("dataset"))


@register("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, floor(sum(value) * 1e3 + 0.5) / 1e3 AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resume.event_windows(table(spark, sf_dir, "events"))
    return rows.withColumn("total", F.floor(F.col("total") * 1e3 + 0.5) / 1e3)


@register("verify_pipeline")
def verify_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole verification pipeline over all items, with stand-in models."""
    from quern.plans.pipeline import Pipeline
    from quern.plans.retrieval_queries import _docs

    docs = _docs(spark, sf_dir).select("doc_id", "title", F.coalesce("text", F.lit("")).alias("content"), "pmid", "id", "url")
    options = F.create_map(*[F.lit(x) for x in ("A", "Supported", "B", "Refuted", "C", "Not enough information")])
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), options.alias("options"))
    verdicts = Pipeline(docs).verify(questions)
    return verdicts.select("id", "choice", "n_votes", "n_winner", "n_choices", F.size("propositions").alias("n_propositions"), F.length("retrieved_context").alias("n_context"), "reference_block")


@register("rest_fetch", """SELECT CAST(item_id AS VARCHAR) AS id, 'Item ' || item_id AS title, CASE WHEN item_id % 7 = 3 THEN NULL ELSE text END AS abstract, md5('fetch:pubmed:' || item_id || ':1') AS cache_key FROM benchmark WHERE item_id % 5 <> 4
UNION ALL SELECT CAST(item_id AS VARCHAR), NULL, NULL, md5('fetch:pubmed:' || item_id || ':1') FROM benchmark WHERE item_id % 5 = 4""")
def rest_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' records by id, from a service that has four in five of them and fails each request once; twice, the second time from the cache."""
    items, root = table(spark, sf_dir, "benchmark"), reserve(spark, "service")
    i = F.col("item_id")
    rest.Folder.fill(items.filter(i % 5 != 4).select(i.cast("string").alias("id"), F.concat(F.lit("Item "), i.cast("string")).alias("title"), F.when(i % 7 != 3, F.col("text")).alias("abstract")), root)
    service, ids, cache = rest.Folder(root, failures=1), items.select(i.cast("string").alias("id")), reserve(spark, "answers")
    rest.lookup(ids, service, cache, pause=0.01)
    return rest.lookup(ids, service, cache, pause=0.01)


@register("read_xml_gz", r"""SELECT CAST(page_id AS VARCHAR) AS pmid, url AS title, 'URL: ' || url || ' Page ' || page_id AS abstract, CAST(1 AS INTEGER) AS n_mesh FROM pages WHERE trim(url) <> ''""")
def read_xml_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses as articles in compressed XML, read back."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    text = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version='1'>"), F.col("page_id").cast("string"), F.lit("</PMID><Article><ArticleTitle>"), escaped,
        F.lit("</ArticleTitle><Abstract><AbstractText Label='URL'>"), escaped, F.lit("</AbstractText><AbstractText>Page "), F.col("page_id").cast("string"),
        F.lit("</AbstractText></Abstract></Article><MeshHeadingList><MeshHeading><DescriptorName>Web</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>"))
    path = reserve(spark, "archive")
    table(spark, sf_dir, "pages").filter(F.trim("url") != "").select(text.alias("value")).write.option("compression", "gzip").text(path)
    return articles.read_articles(spark, path).select("pmid", "title", "abstract", F.size("mesh").alias("n_mesh"))


@register("first_wins_batches", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def first_wins_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order, from three batches of orders inserted one after the other, the second of them twice."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    low, high = orders.approxQuantile("o_orderkey", [0.3, 0.6], 0.05) if not orders.isEmpty() else (0, 0)
    first = sinks.FirstWins(spark, reserve(spark, "customers"), ("o_custkey",))
    key = F.col("o_orderkey")
    for name, batch in (("a", key <= low), ("b", (key > low) & (key <= high)), ("b", key <= high), ("c", key > high)):
        first.insert(orders.filter(batch), name, "o_orderkey")
    return first.read()
