import gzip
import json

import pytest
from pyspark.sql import functions as F

from quern.plans.pipeline import Pipeline, Settings
from quern.sources import articles, datasets, ontology, search, sinks
from quern.streaming import resume


def test_ontology_files(spark, tmp_path):
    (tmp_path / "MRSTY.RRF").write_text("C1|T047|A|Disease|x|\nshort|row\nC2|T121|B|Drug|y|\n")
    rows = ontology.read_rrf(spark, str(tmp_path / "MRSTY.RRF"), {"cui": 0, "tui": 1, "sty": 3}, 4).collect()
    assert [(r.cui, r.sty) for r in rows] == [("C1", "Disease"), ("C2", "Drug")]
    deep = tmp_path / "deep" / "er"
    deep.mkdir(parents=True)
    (deep / "Concept_Snapshot_1.txt").write_text("id\teffectiveTime\tactive\n7\t2020\t1\n8\t2020\n")
    (deep / "Other.txt").write_text("9\t2020\t1\n")
    snap = ontology.read_snapshot(spark, str(tmp_path), "Concept_Snapshot", {"id": 0, "active": 2}, 3).collect()
    assert [(r.id, r.active) for r in snap] == [("7", "1")]


def test_articles_chunks_and_broken_files(spark, tmp_path):
    xml = """<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><ArticleTitle>One</ArticleTitle><Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText>Seen.</AbstractText></Abstract></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1">Heart</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><ArticleTitle>None</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
    with gzip.open(tmp_path / "a.xml.gz", "wt") as f:
        f.write(xml)
    got = articles.read_articles(spark, str(tmp_path / "a.xml.gz")).collect()
    assert [(r.pmid, r.title, r.abstract, list(r.mesh)) for r in got] == [("11", "One", "AIM: To see. Seen.", ["Heart"])]
    (tmp_path / "bad.gz").write_bytes(gzip.compress(b"x" * 5000)[:-12])
    assert [r.path.rsplit("/", 1)[-1] for r in datasets.broken_gzip(spark, str(tmp_path)).collect()] == ["bad.gz"]
    lines = tmp_path / "chunks"
    lines.mkdir()
    (lines / "a.jsonl").write_text('{"title": "t", "content": "c", "PMID": 5, "source": "s"}\n\nnot json\n')
    assert [(r.title, r.pmid) for r in datasets.read_chunks(spark, str(lines)).collect()] == [("t", "5")]


def test_run_files(spark, tmp_path):
    record = {"id": "1", "gt_answer": "A", "pred_answer": "B", "correct": False, "vote_distribution": {"B": 2, "A": 1}, "reasoning_traces": [{"model": "m", "vote_idx": 0, "choice": "B"}]}
    (tmp_path / "E1_SciFact.json").write_text(json.dumps({"config": {}, "complete": True, "results": [record, record | {"id": "2"}]}))
    (tmp_path / "broken_bioasq.json").write_text("{")
    rows = datasets.read_runs(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.dataset, r.id, r.vote_distribution["B"], r.reasoning_traces[0].choice) for r in rows] == [("scifact", "1", 2, "B"), ("scifact", "2", 2, "B")]
    assert datasets.read_runs(spark, str(tmp_path), tag="nothing").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "k int, v string, o int")
    sinks.write_first_wins(df, str(tmp_path / "first"), ["k"], "o")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "first")).collect()} == {(1, "a"), (2, "c")}
    sinks.write_corpus(spark.range(2500).coalesce(1), str(tmp_path / "corpus"), 1000)
    assert len(list((tmp_path / "corpus").glob("part-*"))) == 3
    records = spark.createDataFrame([("1", True), ("2", False)], "id string, correct boolean")
    sinks.append_records(records, str(tmp_path / "runs"), "r1")
    sinks.append_records(records.limit(1), str(tmp_path / "runs"), "r2")
    got = {r.run_id: (r.progress, r.complete) for r in sinks.envelope(spark.read.parquet(str(tmp_path / "runs")), 2).collect()}
    assert got == {"r1": ("2/2", True), "r2": ("1/2", False)}
    assert sinks.text_table(df.orderBy("o")).splitlines()[0] == "| k | v | o |"


def test_cache_and_batches(spark):
    keyed = lambda rows: spark.createDataFrame(rows, "q string, n int").withColumn("cache_key", search.request_key("search", "pubmed", F.col("q"), 10))
    cache = keyed([("a", 1), ("z", 9)])
    asked = []
    got = search.through_cache(keyed([("a", 0), ("b", 0)]), cache, lambda df: asked.append(df.count()) or df.withColumn("n", F.lit(7)))
    assert {(r.q, r.n) for r in got.collect()} == {("a", 1), ("b", 7)} and asked == [1]


def test_splits(spark):
    rows = spark.range(1003).withColumnRenamed("id", "k")
    split = datasets.hash_split(rows, "k")
    assert {r.part: r["count"] for r in split.groupBy("part").count().collect()} == {"train": 802, "test": 201}
    assert datasets.first_percent(rows, 1.5, "k").count() == 16


def test_resume_equals_full_run(spark):
    questions = spark.range(10).selectExpr("id", "id * 2 as x")
    done = questions.filter("id < 4")
    rest = resume.pending(questions, done)
    assert sorted(map(tuple, done.union(rest.select("id", "x")).collect())) == sorted(map(tuple, questions.collect()))


def test_stream_reads_each_file_once(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    work = lambda df: df.selectExpr("id", "id * 10 as y")
    spark.range(5).write.parquet(source)
    schema = spark.read.parquet(source).schema
    resume.run_stream(spark, source, schema, work, sink, check).awaitTermination()
    spark.range(5, 8).write.mode("append").parquet(source)
    resume.run_stream(spark, source, schema, work, sink, check).awaitTermination()
    assert sorted(r.y for r in spark.read.parquet(sink).collect()) == [i * 10 for i in range(8)]


def test_event_windows_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = str(tmp_path / "events")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = resume.event_windows(stream, late="400 days").writeStream.outputMode("update").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.sql("select start, event_type, max(n) as n from windows group by start, event_type")
    want = resume.event_windows(events).select("start", "event_type", "n")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_pipeline_batches(spark):
    docs = spark.createDataFrame([(1, "Heart", "The heart is a muscle that pumps blood through the body.", "11"), (2, "Lung", "The lung takes in air and gives oxygen to the blood.", ""), (3, "Bone", "A bone carries the weight of the body every day.", "13")], "doc_id long, title string, content string, pmid string")
    docs = docs.withColumn("id", F.lit("")).withColumn("url", F.lit("")).withColumn("year", F.lit(2000))
    questions = spark.createDataFrame([(1, "Does the heart pump blood through the body?"), (2, "Does the lung take in air?")], "id long, question string").withColumn("options", F.create_map(F.lit("A"), F.lit("yes"), F.lit("B"), F.lit("no")))
    for settings in (Settings(k=2, pool=3), Settings(mode="bm25", k=2, pool=3, alpha=0.3, compress=False, nei_share=0.67), Settings(mode="search", k=2, pool=3)):
        full = {r.id: r for r in Pipeline(docs, settings).verify(questions).collect()}
        assert set(full) == {1, 2} and "heart" in full[1].retrieved_context and full[1].n_votes == 3
    rest = Pipeline(docs, settings).batch_verify(questions, questions.filter("id = 1").select("id")).collect()
    assert [(r.id, r.choice) for r in rest] == [(2, full[2].choice)]


def test_benchmark_files(spark, tmp_path):
    """Each reader opens its file: order, missing ids, broken lines, limits and lists."""
    import json

    from quern.sources import datasets as D

    def lines(name, rows):
        path = tmp_path / name
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
        return str(path)

    got = lambda df, *columns: [tuple(r[c] for c in columns) for r in df.collect()]
    path = lines("medqa.jsonl", [{"question": "q0", "A": "x", "B": "y", "answer_idx": "b"}, "not json", {"id": 7, "question": "q2", "A": "x", "answer_idx": "Z"}, {"question": "q3", "options": {"A": "x"}, "answer": "x"}])
    assert sorted(got(D.read_medqa(spark, path), "id", "question", "answer")) == [("0", "q0", "B"), ("3", "q3", "x"), ("7", "q2", "A")]
    assert len(got(D.read_medqa(spark, path, 1), "id")) == 1
    path = lines("medmcqa.jsonl", [{"question": f"q{i}", "opa": "1", "opb": "2", "opc": "", "opd": "4", "cop": i} for i in range(5)])
    assert sorted(got(D.read_medmcqa(spark, path), "id", "answer")) == [("0", "A"), ("1", "B"), ("2", "C"), ("3", "D"), ("4", "A")]
    assert len(got(D.read_medmcqa(spark, path, 2), "id")) == 2
    path = lines("pubmedqa.jsonl", [{"question": "q", "final_decision": d} for d in ("yes", "no", "maybe")])
    assert sorted(got(D.read_pubmedqa(spark, path), "id", "answer")) == [("0", "A"), ("1", "B"), ("2", "C")]
    path = lines("mmlu.jsonl", [{"question": "q", "choices": ["a", "b"], "answer": 1, "_sub": "anatomy"}, {"question": "q", "choices": ["a"], "answer": 0, "_sub": "astronomy"}, {"question": "q", "choices": ["a"], "answer": 0}])
    assert sorted(got(D.read_mmlu(spark, path), "id", "answer")) == [("0", "B"), ("2", "A")]
    questions = [{"id": "a", "body": "b0", "type": "yesno", "exact_answer": "Yes"}, {"id": "b", "body": "b1", "type": "yesno", "exact_answer": ["no"]}, {"id": "c", "body": "b2", "type": "list", "exact_answer": [["x"]]}]
    (tmp_path / "bioasq.json").write_text(json.dumps({"questions": questions}, indent=1))
    assert sorted(got(D.read_bioasq(spark, str(tmp_path / "bioasq.json")), "id", "answer")) == [("a", "A"), ("b", "B")]
    assert got(D.read_bioasq(spark, str(tmp_path / "bioasq.json"), 1), "id") == [("a",)]
    path = lines("bioasq.jsonl", [{"body": "b0", "type": "yesno", "exact_answer": "no"}, {"body": "b1", "type": "summary", "ideal_answer": ["long answer"]}, {"body": "b2"}])
    assert sorted(got(D.read_bioasq_lines(spark, path), "id", "answer", "options")) == [("0", "B", {"A": "yes", "B": "no"}), ("1", "long answer", None), ("2", "A", {"A": "yes", "B": "no"})]
    (tmp_path / "change.csv").write_text('Question,Newest Label\n"one, two\nlines",SUPPORTED\nq,OTHER\nr,REFUTED\n')
    assert sorted(got(D.read_medchangeqa(spark, str(tmp_path / "change.csv")), "id", "answer")) == [("q_0", "A"), ("q_1", "B")]
    (tmp_path / "scifact.csv").write_text("id,claim,evidence_label\n1,c,\n1,c,SUPPORT\n2,d,\n")
    assert sorted(got(D.read_scifact(spark, str(tmp_path / "scifact.csv")), "id", "answer")) == [("1", "A"), ("2", "C")]
    (tmp_path / "health.csv").write_text("en_claim,label\nx,2\n,1\ny,true\n")
    assert sorted(got(D.read_healthfc(spark, str(tmp_path / "health.csv")), "id", "answer")) == [("hfc_test_0", "B"), ("hfc_test_1", "A")]


def _small_corpus(spark):
    docs = spark.createDataFrame([(1, "Heart", "The heart is a muscle that pumps blood through the body.", "11"), (2, "Lung", "The lung takes in air and gives oxygen to the blood.", ""), (3, "Bone", "A bone carries the weight of the body every day.", "13")], "doc_id long, title string, content string, pmid string")
    docs = docs.withColumn("id", F.lit("")).withColumn("url", F.lit(""))
    questions = spark.createDataFrame([(1, "Does the heart muscle treat the patient with Aspirin?"), (2, "Does the lung take in air?")], "id long, question string").withColumn("options", F.create_map(F.lit("A"), F.lit("yes"), F.lit("B"), F.lit("no")))
    nodes = spark.createDataFrame([("n1", "Aspirin", "rxnorm", "Drug", "A drug against pain and fever that thins blood.", 0), ("n2", "Heart Attack", "umls", "Disease", "The heart muscle gets too little blood.", 1)], "node_id string, label string, node_type string, sty string, definition string, ord long")
    edges = spark.createDataFrame([("n1", "may_treat", "n2", "u", 0)], "src string, rel string, dst string, source string, ord long")
    return docs, questions, nodes, edges


def test_routed_pools_and_hooks(spark):
    """Graph, corpus and live pools meet by the domain's weights; each hook takes part."""
    from quern.hooks import Hooks
    from quern.operators import cite

    docs, questions, nodes, edges = _small_corpus(spark)
    asked = questions.select(F.col("id").alias("qid"), F.col("question").alias("text"))
    search = lambda q: q.select("qid", F.lit(0).alias("query_idx"), F.lit(0).alias("rank"), F.lit("Heart facts").alias("title"), F.lit("https://www.nih.gov/heart").alias("url"), F.lit("The heart muscle pumps blood, and air goes to the lung.").alias("snippet"))
    made = Pipeline(docs, Settings(mode="moe_graph", live=True), Hooks(search=search), nodes=nodes, edges=edges)
    pool = made.retrieve(asked)
    rows = {(r.qid, r["rank"]): r for r in pool.collect()}
    first = [rows[1, i] for i in range(sum(q == 1 for q, _ in rows))]
    assert {r.title for r in first} >= {"KG: Aspirin", "Heart", "Heart facts"} and len({r.doc_id for r in first}) == len(first)
    # One drug word, no more of other domains: the graph weighs 0.6, so its first document leads; the live one (0.2) is behind the corpus' first.
    order = [r.title for r in first]
    assert order.index("Heart") < order.index("Heart facts")
    live = next(r for r in first if r.title == "Heart facts")
    assert live.url == "https://www.nih.gov/heart" and "Snippet: The heart muscle" in live.content
    encode = lambda q: q.select("qid", F.when(F.col("qid") == 1, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    held = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [0.5, 0.4])], "doc_id long, embedding array<float>")
    dense = Pipeline(docs, Settings(mode="dense", k=2), Hooks(encode=encode), vectors=held).retrieve(asked)
    assert sorted((r.qid, r["rank"], r.doc_id) for r in dense.collect()) == [(1, 0, 1), (1, 1, 3), (2, 0, 2), (2, 1, 3)]
    graphed = Pipeline(docs, Settings(mode="graph"), nodes=nodes, edges=edges).retrieve(asked).collect()
    assert {r.title for r in graphed if r.qid == 1} >= {"Atomic Propositions"}
    hooks = Hooks(entails=cite.word_share, compress=lambda pool, q: pool.groupBy("qid").agg(F.concat_ws("; ", F.array_sort(F.collect_list("title"))).alias("context")), rerank=lambda q, d: F.length(d).cast("double"))
    full = {r.id: r for r in Pipeline(docs, Settings(mode="bm25", k=2), hooks).verify(questions).collect()}
    assert full[2].retrieved_context.count(";") == 1 and all(0 <= x <= 1 for x in full[1].support) and len(full[1].support) == len(full[1].propositions)
    for bad in (dict(mode="dense"), dict(mode="graph"), dict(mode="moe_flat", live=True), dict(mode="other")):
        with pytest.raises(ValueError):
            Pipeline(docs, Settings(**bad))


def test_judge_and_rerun(spark):
    from quern.operators import votes

    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, prompt string")
    asked = []

    def judge(prompt):
        asked.append(1)
        again = F.lit(len(asked) > 1)
        return F.when(prompt == "a", F.lit('so: {"M5_ADeQ_score": 7, "M8_Hallucination": 1} end')).when((prompt == "b") & again, F.lit('{"M5_ADeQ_score": 3}')).when(prompt == "c", "no object").otherwise("")

    got = {r.id: (r.M5_ADeQ_score, r.M7_Context_Utilization, r.M8_Hallucination, r.M9_Context_Relevancy) for r in votes.judged(records, judge).collect()}
    assert got == {1: (7.0, 0.0, 1.0, 0.0), 2: (3.0, 0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0, 0.0)} and len(asked) == 2
    verdicts = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, choice string")
    rerun = lambda rows, turn: rows.select("id", F.concat(F.lit("t"), F.lit(turn).cast("string")).alias("trace"), F.when(F.col("id") <= turn + 1, F.col("choice")).otherwise("X").alias("choice"))
    assert sorted((r.id, r.choice, r.trace, r.runs) for r in votes.rerun_until_match(verdicts, rerun, 1).collect()) == [(1, "A", "t0", 1), (2, "B", "t1", 2), (3, "C", "t1", 2)]


def test_configuration(tmp_path, monkeypatch):
    import json

    from quern import config

    monkeypatch.setenv("QUERN_TEST", "here")
    path = tmp_path / "run.json"
    path.write_text(json.dumps({"corpus": {"dir": "data/corpus", "url_path": "s3://b/x", "note": "$QUERN_TEST/x"}, "kg": [{"graph_path": "$QUERN_TEST/g"}], "retrieval": {"mode": "medcpt", "k1": 7}, "model": {"name": "m", "votes": 5}, "compression": {"enabled": False}}))
    got = config.load(str(path))
    assert got["corpus"] == {"dir": str(tmp_path / "data/corpus"), "url_path": "s3://b/x", "note": "here/x"} and got["kg"][0]["graph_path"] == str(tmp_path / "here/g")
    s = config.settings(got, k=None, alpha=0.5)
    assert (s.mode, s.k, s.models, s.n_votes, s.compress, s.alpha) == ("dense", 7, ["m"], 5, False, 0.5)
    assert config.settings({}, mode="bm25").mode == "bm25"


def test_command_line_verifies_what_is_open(spark, tmp_path):
    from quern import __main__ as cli

    docs, questions, _, _ = _small_corpus(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    questions.write.parquet(str(tmp_path / "questions"))
    args = ["verify", "--docs", str(tmp_path / "docs"), "--questions", str(tmp_path / "questions"), "--out", str(tmp_path / "out"), "--mode", "bm25", "--k", "2"]
    cli.verify(spark, cli.parser().parse_args([*args, "--percent", "50", "--run-id", "a"]))
    cli.verify(spark, cli.parser().parse_args([*args, "--run-id", "b"]))
    assert sorted((r.id, r.run_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b")]


def test_ledger_of_files(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert resume.state(spark, ledger).count() == 0 and resume.open_files(files, resume.state(spark, ledger)).count() == 3
    entry = lambda *rows: spark.createDataFrame(list(rows), "name string, status string, n int, at string")
    resume.record(ledger, entry(("a", "done", 5, "2024-01-01"), ("b", "failed", 0, "2024-01-01")))
    resume.record(ledger, entry(("b", "done", 7, "2024-01-02"), ("c", "started", 0, "2024-01-02")))
    now = resume.state(spark, ledger)
    assert {r.name: (r.status, r.n) for r in now.collect()} == {"a": ("done", 5), "b": ("done", 7), "c": ("started", 0)}
    assert [r.name for r in resume.open_files(files, now).collect()] == ["c"]


def test_shards_merge_into_one_index(spark, tmp_path):
    shards = spark.createDataFrame([(i * 7 % 101, [float(i)], f"t{i * 7 % 101}") for i in range(101)], "vec_id long, embedding array<float>, title string").repartition(9)
    sinks.merge_vectors(shards, str(tmp_path / "index"), str(tmp_path / "meta"), per_file=10)
    index = {r.pos: r.vec_id for r in spark.read.parquet(str(tmp_path / "index")).collect()}
    assert index == {i: i for i in range(101)}
    assert {r.pos: (r.vec_id, r.title) for r in spark.read.json(str(tmp_path / "meta")).collect()} == {i: (i, f"t{i}") for i in range(101)}
