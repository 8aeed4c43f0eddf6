"""Rules that are easy to get wrong, on a few rows each."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import labels as L
from quern.functions import text as T
from quern.operators import cite, compress, fusion, graph, metrics, retrieval, vectors, votes, web


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long' if isinstance(v, int) else 'array<string>'}" for k, v in values.items()))
    return frame.select(column).first()[0]


@pytest.mark.parametrize("raw, want", [("NOT ENOUGH INFORMATION", "B"), ("yes", "A"), ("the answer is (c)", "C"), ("a", "A"), ("", ""), (None, ""), ("maybe", "M"), ("It was a success", "A"), ("E.", "E")])
def test_normalize_answer(spark, raw, want):
    assert one(spark, L.normalize_answer(F.col("x")), x=raw) == want


@pytest.mark.parametrize("label, dataset, scheme, want", [("1", "healthfc", "eval", "Mixture"), ("1", "healthfc", "additional", "False"), ("c", "scifact", "eval", "NEI"), ("NOT ENOUGH INFORMATION", "medchangeqa", "eval", "NOT ENOUGH INFORMATION"), ("d", "medqa", "eval", "D")])
def test_label_schemes(spark, label, dataset, scheme, want):
    assert one(spark, L.normalize_label(F.col("x"), F.col("d"), scheme), x=label, d=dataset) == want


@pytest.mark.parametrize("n, chunks", [(0, []), (10, []), (11, [11]), (150, [150, 30]), (151, [150, 31]), (130, [130])])
def test_chunk_boundaries(spark, n, chunks):
    """A tail of ten words or fewer is dropped; windows are 120 words apart."""
    words = [f"w{i}" for i in range(n)]
    got = one(spark, F.transform(T.word_chunks(F.col("x")), F.size), x=words)
    assert list(got) == chunks


@pytest.mark.parametrize("x, want", [('{"a": 1}', '{"a": 1}'), ('noise {"a": {"b": 2}} tail', '{"a": {"b": 2}}'), ("no json", "{}"), ("{broken", "{}"), ("", "{}")])
def test_json_salvage(spark, x, want):
    assert one(spark, T.salvage_json(F.col("x")), x=x) == want


def test_html_and_urls(spark):
    page = "<html><head><style>p{}</style></head><nav>menu</nav><p>Hello <b>big</b>\n world</p><script>x<y</script></html>"
    assert one(spark, T.html_text(F.col("x")), x=page) == "Hello big world"
    assert one(spark, T.url_domain(F.col("x")), x="https://WWW.Example.org:8080/a?b") == "example.org:8080"
    assert one(spark, T.url_domain(F.col("x")), x="nothing") == ""
    for domain, want in (("www.ncbi.nlm.nih.gov", 2.8), ("a.who.int", 2.2), ("reddit.com", -1.2), ("myblog.net", -0.8), ("x.gov.uk", 0.8), ("u.edu", 0.5), ("plain.org", 0.0)):
        assert one(spark, web.domain_priority(F.col("x")), x=domain) == want


def test_sentences_and_marks(spark):
    text = "  A first sentence that is long. Short. Is this one long enough to stay? Yes!  "
    assert list(one(spark, T.sentences(F.col("x")), x=text)) == ["A first sentence that is long.", "Is this one long enough to stay?"]
    assert list(one(spark, T.citation_marks(F.col("x")), x="a [2][1] b [2]")) == [2, 1]


def test_vote_ties(spark):
    rows = [(1, 0, "B"), (1, 1, "A"), (1, 2, "A"), (2, 0, "C"), (2, 1, "A"), (2, 2, "B"), (3, 0, "B"), (3, 1, "A")]
    cast = spark.createDataFrame([(i, v, "m", c) for i, v, c in rows], "id long, vote_idx int, model string, choice string")
    assert {r.id: r.choice for r in votes.majority(cast).collect()} == {1: "A", 2: "C", 3: "B"}
    assert {r.id: r.choice for r in votes.ensemble(cast, undecided="X").collect()} == {1: "A", 2: "X", 3: "B"}
    assert {r.id: r.choice for r in votes.below_threshold(votes.majority(cast), instead="N").collect()} == {1: "N", 2: "N", 3: "N"}
    dealt = votes.assign_models(spark.createDataFrame([(1,)], "id long"), ["a", "b"], 3)
    assert [r.model for r in dealt.orderBy("vote_idx").collect()] == ["a", "b", "a"]


def _pool(spark, rows):
    return spark.createDataFrame(rows, "qid long, pool string, rank int, doc_id long, title string, pmid string, id string, url string")


def test_rrf_collapses_titles_and_breaks_ties_by_first_place(spark):
    rows = [(1, "a", 0, 10, "Long title one", "", "", ""), (1, "a", 1, 11, "Long title one", "", "", ""), (1, "a", 2, 12, "Other", "7", "", ""), (1, "b", 0, 13, "Other", "8", "", "")]
    got = fusion.rrf(_pool(spark, rows), {"a": 1.0, "b": 1.0}, 10, fusion.evaluated_key()).orderBy("rank").collect()
    assert [(r.key, r.doc_id) for r in got] == [("Long title one", 10), ("8", 13), ("7", 12)]
    assert got[0].score == pytest.approx(1000 * (1 / 61 + 1 / 62), abs=1e-5)
    alone = fusion.rrf(_pool(spark, rows[:3]), {"a": 0.45}, 1, fusion.routed_key()).collect()
    assert len(alone) == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(list(range(12))))
def test_rrf_does_not_depend_on_row_order(spark, order):
    rows = [(1, "ab"[i % 2], i // 2, 100 + i % 7, f"t{i % 7}", "", "", "") for i in range(12)]
    fuse = lambda r: [tuple(x) for x in fusion.rrf(_pool(spark, r), {"a": 1.0, "b": 0.5}, 20, fusion.pubmed_key()).orderBy("rank").collect()]
    assert fuse(rows) == fuse([rows[i] for i in order])


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, "e f"), (4, "")], "doc_id long, content string")
    queries = spark.createDataFrame([(7, "a a e")], "qid long, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25_topk(docs, queries, 4).collect()}
    n, avgdl = 4, 2.0
    idf = {t: np.log((n - df + 0.5) / (df + 0.5)) for t, df in {"a": 2, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}.items()}
    score = lambda t, tf, dl, q: q * idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got == pytest.approx({1: score("a", 1, 3, 2), 2: score("a", 2, 3, 2), 3: score("e", 1, 2, 1), 4: 0.0}, abs=1e-6)
    top2 = retrieval.bm25_topk(docs, queries, 2).collect()
    assert {r.doc_id for r in top2} <= set(got) and len(top2) == 2


@pytest.mark.parametrize("larger", [True, False])
def test_bm25_in_place_and_by_joins(spark, larger, monkeypatch):
    """Both ways give the same best documents, with ties, documents longer than a batch, and lists cut back often."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(300)] + [(1000 + i, rows_) for i, rows_ in enumerate(["w1 w2"] * 30)] + [(2000, " ".join(rng.choice(words, 20_000))), (None, "w1"), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, content string").repartition(5)
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(30)] + [(50, "none"), (51, ""), (52, None)], "qid long, text string")
    monkeypatch.setattr(retrieval.Best, "__init__", lambda self, n, k, larger, hold=0, make=retrieval.Best.__init__: make(self, n, k, larger, 50))
    tie = F.desc("doc_id") if larger else F.asc("doc_id")
    best = lambda limit: {(r.qid, r["rank"]): (r.doc_id, r.score) for r in retrieval.top(retrieval.bm25_best(docs, queries, 7, larger_ids=larger, limit=limit), 7, tie).collect()}
    there, joined = best(1_000_000), best(0)
    assert {k: v[0] for k, v in there.items()} == {k: v[0] for k, v in joined.items()} and len(there) == 210
    assert all(there[k][1] == pytest.approx(joined[k][1], abs=2e-6) for k in there)
    assert retrieval.bm25_topk(docs.filter("false"), queries, 3).count() == 0


def test_per_class_domains(spark):
    rows = [("A", "A")] * 3 + [("A", "B"), ("B", "C"), ("B", "B")]
    records = spark.createDataFrame(rows, "gt string, pred string")
    union = {r.label: r for r in metrics.per_class(records).collect()}
    assert set(union) == {"A", "B", "C"} and (union["C"].fp, union["C"].support, union["C"].f1) == (1, 0, 0.0)
    assert {r.label for r in metrics.per_class(records, domain="gt").collect()} == {"A", "B"}
    fixed = {r.label: r for r in metrics.per_class(records, domain="fixed", labels=("A", "B")).collect()}
    assert fixed["B"].support == 1
    assert metrics.confusion(records).agg(F.sum("n")).first()[0] == len(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.booleans()), min_size=1, max_size=20))
def test_calibration_error_is_a_share(spark, rows):
    records = spark.createDataFrame([({"A": a, "B": b}, c) for a, b, c in rows], "vote_distribution map<string, long>, correct boolean")
    got = metrics.expected_calibration_error(records).first()
    assert got.n == len(rows) and 0 <= got.ece <= 1


def test_graph_last_wins_and_links(spark):
    nodes = spark.createDataFrame([("n1", "Heart Failure", "umls", "disease", "d", "u", 1), ("n2", "carvedilol", "rxnorm", "drug", "", "r", 2), ("n3", "Heart", "umls", "organ", "", "u", 3), ("n4", "Dose form x", "umls", "", "", "u", 4)],
        "node_id string, label string, node_type string, sty string, definition string, source string, ord long")
    edges = spark.createDataFrame([("n2", "n1", "isa", "u", 1), ("n2", "n1", "may_treat", "r", 5), ("n1", "zz", "causes", "u", 2), ("n2", "n4", "causes", "u", 3)], "src string, dst string, rel string, source string, ord long")
    kept, linked = graph.build(nodes, edges)
    assert {(r.src, r.dst, r.rel) for r in linked.collect()} == {("n2", "n1", "may_treat"), ("n2", "n4", "causes")}
    queries = spark.createDataFrame([(1, "Does carvedilol treat heart failure in the heart?")], "qid long, text string")
    assert [r.node_id for r in graph.link_exact(queries, kept).orderBy("rank").collect()] == ["n1", "n2", "n3"]
    fuzzy = graph.link_fuzzy(spark.createDataFrame([(1, " HEART "), (2, "he")], "qid long, text string"), kept)
    assert [(r.qid, r.node_id) for r in fuzzy.orderBy("qid", "rank").collect()] == [(1, "n1"), (1, "n3")]
    seeded = spark.createDataFrame([(1, 0, "n2"), (1, 1, "n1"), (1, 2, "n4")], "qid long, rank int, node_id string")
    docs = {r.node_id: r.content for r in graph.contexts(seeded, kept, linked).collect()}
    assert docs == {"n2": "Entity: carvedilol\nType: drug\n- May Treat: Heart Failure", "n1": "Entity: Heart Failure\nType: disease\nDefinition: d\n- [Inverse] May Treat: carvedilol"}


def brute_context(seeds, nodes, edges):
    """Entity contexts by plain loops over adjacency in order of first appearance."""
    label = {n["node_id"]: n for n in nodes}
    junk = lambda x: any(m.strip("^") in x for m in graph.JUNK_LABELS)
    show = lambda r: " ".join(w.capitalize() for w in r.split("_"))
    docs, seen = {}, set()
    for s in seeds:
        me = label[s]
        if junk(me["label"]):
            continue
        lines = ([f"Type: {me['sty']}"] if me["sty"] else []) + ([f"Definition: {me['definition'][:400]}"] if me["definition"] else [])
        out, back = {}, {}
        for e in edges:
            if e["src"] == s and not junk(label[e["dst"]]["label"]):
                if e["rel"] in graph.HIGH_OUT or (e["rel"] in graph.MEDIUM and len(out.get(e["rel"], [])) < 5):
                    out.setdefault(e["rel"], []).append(e["dst"])
            if e["dst"] == s and e["rel"] in graph.HIGH_IN + graph.MEDIUM and not junk(label[e["src"]]["label"]) and len(back.get(e["rel"], [])) < 5:
                back.setdefault(e["rel"], []).append(e["src"])
        for rels, prefix in ((out, "- "), (back, "- [Inverse] ")):
            for r in sorted(rels):
                names = list(dict.fromkeys(label[n]["label"] for n in rels[r]))[:5]
                lines.append(f"{prefix}{show(r)}: {', '.join(names)}")
        details = []
        for r, near in out.items():
            for n in near[:3] if r in graph.HIGH_OUT else []:
                if n in seen:
                    continue
                d = label[n]["definition"].strip()
                if len(d) > 30:
                    details.append(f"  [{label[n]['label']}]: {d[:200]}")
                for o in seeds:
                    hit = [e["rel"] for e in edges if e["src"] == n and e["dst"] == o and e["rel"] in graph.HIGH_OUT]
                    if o != s and hit:
                        details.append(f"  [{label[n]['label']}] --{hit[0]}--> [{label[o]['label']}]")
        lines += ["Related details:", *details[:8]] if details else []
        if lines:
            docs[s] = f"Entity: {me['label']}\n" + "\n".join(lines)
            seen.add(s)
    return docs


def test_contexts_equal_loops(spark):
    rng = np.random.default_rng(4)
    nodes = [{"node_id": f"n{i}", "label": f"Label {i}" if i % 9 else f"Date {i}", "node_type": "umls", "sty": "t" if i % 3 else "", "definition": f"definition number {i} of some considerable length" if i % 2 else "", "source": "u", "ord": i} for i in range(30)]
    rels = ("may_treat", "causes", "isa", "has_class", "part_of", "associated_with", "RO")
    pairs = {(int(a), int(b)): rels[int(r)] for a, b, r in zip(rng.integers(0, 30, 260), rng.integers(0, 30, 260), rng.integers(0, 7, 260), strict=True) if a != b}
    edges = [{"src": f"n{a}", "dst": f"n{b}", "rel": r, "source": "u", "ord": i} for i, ((a, b), r) in enumerate(pairs.items())]
    seeds = [f"n{i}" for i in rng.permutation(30)[:14]]
    seeded = spark.createDataFrame([(1, i, s) for i, s in enumerate(seeds)], "qid long, rank int, node_id string")
    n = spark.createDataFrame([tuple(x.values()) for x in nodes], "node_id string, label string, node_type string, sty string, definition string, source string, ord long")
    e = spark.createDataFrame([tuple(x.values()) for x in edges], "src string, dst string, rel string, source string, ord long")
    got = {r.node_id: r.content for r in graph.contexts(seeded, n, e).collect()}
    assert got == brute_context(seeds, nodes, edges)


def test_picks_are_greedy():
    rng = np.random.default_rng(0)
    v = rng.random((20, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rel = rng.random(20)
    rows = [(list(range(6)), x.tolist()) for x in v]
    assert compress._picks(rel, rows, 6, 1.0, 5) == np.argsort(-rel)[:5].tolist()
    picked = [int(np.argmax(rel))]
    while len(picked) < 6:
        gain = [-9 if i in picked else 0.7 * rel[i] - 0.3 * max(v[i] @ v[p] for p in picked) for i in range(20)]
        picked.append(int(np.argmax(gain)))
    assert compress._picks(rel, rows, 6, 0.7, 6) == picked
    assert compress.budget() == 65 and compress.budget(25000) == 50 and compress.budget(100) == 5


@pytest.mark.parametrize("a, b, want", [("the cat sat", "the cat sat", 1.0), ("a b c d", "a c e d", 0.75), ("", "a", 0.0), ("x", "y", 0.0), ("a a b", "a b b", 2 / 3)])
def test_rouge_l(spark, a, b, want):
    assert compress.rouge_l(spark.createDataFrame([(a, b)], "answer string, reference string")).first().rouge_l == pytest.approx(want)


def test_references(spark):
    docs = spark.createDataFrame([(1, 0, "12", "T", "c"), (1, 1, "x1", "U", "c"), (1, 2, "12", "V", "c"), (1, 3, "9", "", "c")], "qid long, rank int, pmid string, title string, content string")
    block = cite.references(cite.citable(docs)).first().block
    assert block == "\n\nReferences:\n[1] T. PMID: 12 — https://pubmed.ncbi.nlm.nih.gov/12/\n[2] Untitled. PMID: 9 — https://pubmed.ncbi.nlm.nih.gov/9/\n"


def test_cosine_of_few_is_part_of_more(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.groupBy(F.col("label").cast("long").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    exact = {(r.qid, r.vec_id) for r in vectors.cosine_topk(v, q, 10, chunk=3).collect()}
    few = {(r.qid, r.vec_id) for r in vectors.cosine_topk(v, q, 5).collect()}
    assert few <= exact


STEMS = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky skies sky enjoy enjoy relational relat conditional condit rational ration
valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll dying die analogies analog by by""".split()


@pytest.mark.parametrize("word, want", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, want):
    from quern.functions.stem import stem

    assert stem(word) == want


def test_rouge_l_stems_and_punctuation(spark):
    pair = spark.createDataFrame([("The patients, treated!", "patient is treating the")], "answer string, reference string")
    assert compress.rouge_l(pair).first().rouge_l == pytest.approx(2 * 2 / 7)
    assert compress.rouge_l(pair, stemmed=False).first().rouge_l == pytest.approx(2 * 1 / 7)


def test_cosine_topk_of_many_queries(spark):
    """Queries packed in blocks give the same as queries sent out."""
    rng = np.random.default_rng(3)
    held = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "vec_id long, embedding array<double>").repartition(3)
    asked = held.filter("vec_id < 50").selectExpr("vec_id as qid", "embedding")
    rows = lambda **o: sorted(map(tuple, vectors.cosine_topk(held, asked, 4, **o).collect()))
    assert rows() == rows(chunk=7, block=32) and len(rows()) == 200
    assert vectors.cosine_topk(held, asked.filter("false"), 4).count() == 0


def test_model_similarity_is_the_hooks(spark):
    from quern.hooks import Hooks

    pairs = spark.createDataFrame([("a b", "b c"), (None, "x")], "answer string, reference string")
    scored = compress.model_similarity(pairs, Hooks(similarity=cite.word_share)).collect()
    assert [r.similarity for r in scored] == [0.5, None]
    with pytest.raises(ValueError):
        compress.model_similarity(pairs, Hooks())
