"""Queries over votes, verdicts and metrics.

Votes are three for each labelled document, by integer arithmetic on its columns; the
truth is C for toxic, A for good quality, else B; the prediction is the majority's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import labels as L
from quern.functions.text import quantised
from quern.operators import metrics, votes
from quern.plans.catalog import register
from quern.tables import table


def _votes(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id")
    v, i = F.col("vote_idx"), F.col("id")
    code = (i * 7 + v * ((F.col("n_chars") + shift) % 5) + v * v * ((i + shift) % 4)) % 3
    return (
        labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), "n_chars", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("vote_idx"))
        .select("id", "vote_idx", F.concat(F.lit("m"), v.cast("string")).alias("model"), F.char(65 + code).alias("choice"))
    )


def _records(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    truth = F.when(F.col("toxic") == 1, "C").when(F.col("quality") == 1, "A").otherwise("B")
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), truth.alias("gt"))
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "n_chars")
    context = F.expr("substring(text, 1, cast(id % 400 as int))")
    return (
        votes.majority(_votes(spark, sf_dir, shift)).join(gold, "id").join(text, "id")
        .select("id", "gt", F.col("choice").alias("pred"), (F.col("gt") == F.col("choice")).alias("correct"), "vote_distribution", "n_votes", "n_winner", "n_choices", "lang", "n_chars", context.alias("retrieved_context"))
    )


def _sql(shift: int = 0, p: str = "") -> str:
    return f"""{p}v AS (SELECT id, vote_idx, 'm' || vote_idx AS model, chr(65 + CAST((id * 7 + vote_idx * ((n_chars + {shift}) % 5) + vote_idx * vote_idx * ((id + {shift}) % 4)) % 3 AS INTEGER)) AS choice
  FROM (SELECT l.doc_id AS id, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id), unnest([0, 1, 2]) AS t(vote_idx)),
{p}c AS (SELECT id, choice, count(*) AS n, min(vote_idx) AS f FROM {p}v GROUP BY id, choice),
{p}w AS (SELECT id, arg_max(choice, n * 10 - f) AS pred, sum(n) AS n_votes, max(n) AS n_winner, count(*) AS n_choices FROM {p}c GROUP BY id),
{p}r AS (SELECT w.id, CASE WHEN toxic = 1 THEN 'C' WHEN quality = 1 THEN 'A' ELSE 'B' END AS gt, pred, (CASE WHEN toxic = 1 THEN 'C' WHEN quality = 1 THEN 'A' ELSE 'B' END) = pred AS correct,
  n_votes, n_winner, n_choices, lang, n_chars, substring(text, 1, CAST(w.id % 400 AS INTEGER)) AS ctx FROM {p}w w JOIN labels l ON l.doc_id = w.id JOIN documents d ON d.doc_id = w.id)"""


_R = f"WITH {_sql()}"
_Z = "coalesce({} / nullif({}, 0), 0.0)"
_Q = "floor(({}) * 1e6 + 0.5) / 1e6"


@register("majority_vote", f"{_R} SELECT id, pred AS choice, CAST(n_votes AS BIGINT) AS n_votes, n_winner, n_choices FROM w")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.majority(_votes(spark, sf_dir)).drop("vote_distribution")


@register("ensemble_vote", f"{_R} SELECT id, CASE WHEN n_choices = 3 AND n_votes = 3 THEN 'C' ELSE pred END AS choice FROM w")
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.ensemble(_votes(spark, sf_dir)).select("id", "choice")


@register("nei_threshold", f"{_R} SELECT id, CASE WHEN n_winner / n_votes < 0.67 THEN 'C' ELSE pred END AS choice FROM w")
def nei_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.below_threshold(votes.majority(_votes(spark, sf_dir))).select("id", "choice")


_ANSWERS = "a AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'answer: b' WHEN 1 THEN ' Yes, it is' WHEN 2 THEN 'No' WHEN 3 THEN 'NOT ENOUGH INFORMATION' WHEN 4 THEN '(C)' WHEN 5 THEN '' WHEN 6 THEN 'maybe' WHEN 7 THEN 'd' ELSE NULL END AS raw FROM documents)"


def _raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["answer: b", " Yes, it is", "No", "NOT ENOUGH INFORMATION", "(C)", "", "maybe", "d", None]
    return table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % 9).cast("int")).alias("raw"))


@register("normalize_answer", rf"""WITH {_ANSWERS}, u AS (SELECT doc_id, upper(trim(coalesce(raw, ''), ' ')) AS u FROM a), x AS (SELECT doc_id, u, regexp_extract(u, '(?:^|[^A-Z0-9_])([ABCDE])(?:$|[^A-Z0-9_])', 1) AS l FROM u)
SELECT doc_id, CASE WHEN l <> '' THEN l WHEN contains(u, 'YES') THEN 'A' WHEN contains(u, 'NO') THEN 'B' ELSE substring(u, 1, 1) END AS answer FROM x""")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_answers(spark, sf_dir).select("doc_id", L.normalize_answer(F.col("raw")).alias("answer"))


_DS = "CASE doc_id % 5 WHEN 0 THEN 'bioasq' WHEN 1 THEN 'medchangeqa' WHEN 2 THEN 'healthfc' WHEN 3 THEN 'scifact' ELSE 'medqa' END"
_RAW = "CASE doc_id % 6 WHEN 0 THEN ' a' WHEN 1 THEN 'B' WHEN 2 THEN 'c' WHEN 3 THEN CAST(doc_id % 4 AS VARCHAR) WHEN 4 THEN 'NOT ENOUGH INFORMATION' ELSE 'd' END"


def _named_sql() -> str:
    named = " ".join(f"WHEN ds = '{d}' AND key = '{k}' THEN '{v}'" for d, names in L.LETTER_NAMES.items() for k, v in names.items())
    spelled = " ".join(f"WHEN ds = '{d}' AND low IN ({', '.join(repr(s) for s in spellings)}) THEN '{name}'" for d, ss in L.SPELLINGS.items() for name, spellings in ss.items())
    return f"""WITH x AS (SELECT doc_id, {_DS} AS ds, {_RAW} AS raw FROM documents),
k AS (SELECT doc_id, ds, upper(trim(raw, ' ')) AS up, lower(trim(raw, ' ')) AS low FROM x),
n AS (SELECT *, CASE WHEN ds = 'healthfc' AND up = '0' THEN 'A' WHEN ds = 'healthfc' AND up = '1' THEN 'C' WHEN ds = 'healthfc' AND up = '2' THEN 'B' ELSE up END AS key FROM k)
SELECT doc_id, CASE {named} ELSE key END AS name, CASE {spelled} ELSE low END AS spelling FROM n"""


@register("normalize_label", _named_sql())
def normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ds = F.get(F.array(*[F.lit(d) for d in ("bioasq", "medchangeqa", "healthfc", "scifact", "medqa")]), (i % 5).cast("int"))
    raw = F.when(i % 6 == 0, " a").when(i % 6 == 1, "B").when(i % 6 == 2, "c").when(i % 6 == 3, (i % 4).cast("string")).when(i % 6 == 4, "NOT ENOUGH INFORMATION").otherwise("d")
    return table(spark, sf_dir, "documents").select("doc_id", L.normalize_label(raw, ds).alias("name"), L.parse_label(raw, ds).alias("spelling"))


@register("label_lookup", f"{_R} SELECT id, pred, CASE pred WHEN 'A' THEN 'Supported' WHEN 'B' THEN 'Refuted' ELSE pred END AS label FROM r")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit("A"), F.lit("Supported"), F.lit("B"), F.lit("Refuted"))
    return _records(spark, sf_dir).select("id", "pred", F.coalesce(F.try_element_at(names, F.col("pred")), "pred").alias("label"))


@register("accuracy", f"{_R} SELECT lang, count(*) AS total, count(*) FILTER (WHERE correct) AS n_correct, CAST(0 AS BIGINT) AS skipped, {_Z.format('count(*) FILTER (WHERE correct)', 'count(*)')} AS accuracy FROM r GROUP BY lang")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_records(spark, sf_dir), "lang")


def _classes(source: str, keys: str, where: str) -> str:
    """CTEs that end in k({keys}label, tp, fp, fn, support, precision, recall, f1)."""
    on = "" if not keys else keys
    return f"""e AS (SELECT {on}gt AS label, CAST(gt = pred AS INTEGER) AS tp, 0 AS fp, CAST(gt <> pred AS INTEGER) AS fn, 1 AS t FROM {source} UNION ALL SELECT {on}pred, 0, CAST(gt <> pred AS INTEGER), 0, 0 FROM {source}),
g AS (SELECT {on}label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, max(t) AS t FROM e GROUP BY {on}label),
h AS (SELECT *, {_Z.format('tp', '(tp + fp)')} AS precision, {_Z.format('tp', '(tp + fn)')} AS recall FROM g WHERE {where}),
k AS (SELECT {on}label, tp, fp, fn, tp + fn AS support, precision, recall, {_Q.format(_Z.format('2 * precision * recall', '(precision + recall)'))} AS f1 FROM h)"""


@register("prf_union_labels", f"{_R}, {_classes('r', '', 'true')} SELECT * FROM k")
def prf_union_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_class(_records(spark, sf_dir))


@register("prf_gt_labels", f"{_R}, x AS (SELECT CASE WHEN gt = 'B' THEN 'A' ELSE gt END AS gt, pred FROM r), {_classes('x', '', 't = 1')} SELECT * FROM k")
def prf_gt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With B folded into A in the truth, so that B is predicted only and is no class."""
    return metrics.per_class(_records(spark, sf_dir).withColumn("gt", F.when(F.col("gt") == "B", "A").otherwise(F.col("gt"))), domain="gt")


@register("prf_fixed_labels", f"{_R}, x AS (SELECT gt, pred FROM r WHERE gt IN ('A', 'B') AND pred IN ('A', 'B')), {_classes('x', '', 'true')} SELECT * FROM k")
def prf_fixed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_class(_records(spark, sf_dir), domain="fixed", labels=("A", "B"))


@register("macro_metrics", f"{_R}, {_classes('r', 'lang, ', 'true')} SELECT lang, {_Q.format('avg(precision)')} AS macro_precision, {_Q.format('avg(recall)')} AS macro_recall, {_Q.format('avg(f1)')} AS macro_f1, count(*) AS n_classes FROM k GROUP BY lang")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(metrics.per_class(_records(spark, sf_dir), "lang"), "lang")


@register("per_model_metrics", f"{_R}, x AS (SELECT model, gt, choice AS pred FROM v JOIN r USING (id)), {_classes('x', 'model, ', 'true')} SELECT * FROM k")
def per_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _votes(spark, sf_dir).join(_records(spark, sf_dir).select("id", "gt"), "id").select("model", "gt", F.col("choice").alias("pred"))
    return metrics.per_class(each, "model")


@register("confusion_matrix", f"{_R}, l AS (SELECT DISTINCT x FROM (SELECT gt AS x FROM r UNION ALL SELECT pred FROM r)) SELECT a.x AS gt, b.x AS pred, (SELECT count(*) FROM r WHERE r.gt = a.x AND r.pred = b.x) AS n FROM l a, l b")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_records(spark, sf_dir))


@register("class_error_rate", f"""{_R}, x AS (SELECT gt, pred, count(*) AS n FROM r GROUP BY gt, pred)
SELECT gt, CAST(sum(n) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (WHERE gt <> pred), 0) AS BIGINT) AS errors, {_Z.format('coalesce(sum(n) FILTER (WHERE gt <> pred), 0)', 'sum(n)')} AS error_rate,
  coalesce(string_agg(pred || ':' || n, ',' ORDER BY n DESC, pred) FILTER (WHERE gt <> pred), '') AS misread FROM x GROUP BY gt""")
def class_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_errors(_records(spark, sf_dir))


@register("unanimity", f"{_R} SELECT count(*) AS n_voted, count(*) FILTER (WHERE n_winner = n_votes) AS n_unanimous, {_Z.format('count(*) FILTER (WHERE n_winner = n_votes)', 'count(*)')} AS rate FROM r")
def unanimity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.unanimity(_records(spark, sf_dir))


@register("vote_confidence", f"{_R} SELECT count(*) AS n, {_Z.format('count(*) FILTER (WHERE n_winner = 3)', 'count(*)')} AS unanimous_rate, {_Q.format(_Z.format('sum(n_winner)', '(count(*) * 3)'))} AS avg_winner_frac FROM r")
def vote_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vote_confidence(_records(spark, sf_dir))


@register("ece", f"{_R}, b AS (SELECT n_winner, n_votes, count(*) AS n, count(*) FILTER (WHERE correct) AS k FROM r GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS n, {_Q.format('sum(abs(k / n - n_winner / n_votes) * n) / sum(n)')} AS ece FROM b")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expected_calibration_error(_records(spark, sf_dir))


@register("selective_accuracy", f"{_R} SELECT count(*) AS n, {_Z.format('count(*) FILTER (WHERE n_winner = n_votes AND correct)', 'count(*) FILTER (WHERE n_winner = n_votes)')} AS selective_accuracy, {_Z.format('count(*) FILTER (WHERE n_winner = n_votes)', 'count(*)')} AS coverage FROM r")
def selective_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.selective(_records(spark, sf_dir))


@register("nei_pr", f"""{_R}, c AS (SELECT count(*) FILTER (WHERE pred = 'C' AND gt = 'C') AS tp, count(*) FILTER (WHERE pred = 'C' AND gt <> 'C') AS fp, count(*) FILTER (WHERE pred <> 'C' AND gt = 'C') AS fn FROM r)
SELECT tp, fp, fn, {_Z.format('tp', '(tp + fp)')} AS precision, {_Z.format('tp', '(tp + fn)')} AS recall FROM c""".replace("c AS (SELECT count", "cc AS (SELECT count").replace("FROM c\n", "FROM cc\n") .replace(" AS recall FROM c", " AS recall FROM cc"))
def nei_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.one_class(_records(spark, sf_dir), "C")


@register("prediction_bias", f"""{_R}, p AS (SELECT pred, count(*) AS pred_n FROM r GROUP BY pred), g AS (SELECT gt, count(*) AS gt_n FROM r GROUP BY gt)
SELECT pred, pred_n, coalesce(gt_n, 0) AS gt_n, {_Q.format('(pred_n - coalesce(gt_n, 0)) / (SELECT count(*) FROM r) * 100')} AS bias, abs({_Q.format('(pred_n - coalesce(gt_n, 0)) / (SELECT count(*) FROM r) * 100')}) > 10 AS biased FROM p LEFT JOIN g ON p.pred = g.gt""")
def prediction_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.prediction_bias(_records(spark, sf_dir))


@register("error_taxonomy", f"""{_R} SELECT CASE WHEN length(trim(ctx, ' ')) < 50 THEN 'retrieval_empty' WHEN length(ctx) < 200 THEN 'retrieval_short' WHEN n_winner = n_votes THEN 'unanimous_wrong' ELSE 'split_vote_wrong' END AS category, count(*) AS n
FROM r WHERE NOT correct GROUP BY 1""")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_taxonomy(_records(spark, sf_dir))


@register("type_histogram", "SELECT * FROM (SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type) WHERE place <= 30")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "p_type")).cast("long")).filter("place <= 30")


_CTX = "x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'KG: ' || text WHEN 1 THEN 'PMID 1 ' || text WHEN 2 THEN 'Entity: a. Abstract: ' || text WHEN 3 THEN 'see http://a.b ' || substring(text, 1, 20) WHEN 4 THEN 'Document [1] (Title: x) MeSH 2001;12 pmid ' || text ELSE text END AS t FROM documents WHERE text IS NOT NULL)"


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("doc_id") % 6, F.col("text")
    made = F.when(i == 0, F.concat(F.lit("KG: "), t)).when(i == 1, F.concat(F.lit("PMID 1 "), t)).when(i == 2, F.concat(F.lit("Entity: a. Abstract: "), t)).when(i == 3, F.concat(F.lit("see http://a.b "), F.substring(t, 1, 20))).when(
        i == 4, F.concat(F.lit("Document [1] (Title: x) MeSH 2001;12 pmid "), t)).otherwise(t)
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", made.alias("t"))


@register("context_source_class", f"""WITH {_CTX}, k AS (SELECT CASE WHEN length(trim(t, ' ')) < 80 THEN 'empty' WHEN regexp_matches(t, 'KG:|Atomic Propositions|Entity:') AND regexp_matches(t, 'PMID|Abstract|PubMed') THEN 'kg+pubmed'
  WHEN regexp_matches(t, 'KG:|Atomic Propositions|Entity:') THEN 'kg_only' WHEN regexp_matches(t, 'PMID|Abstract|PubMed') THEN 'pubmed_only' ELSE 'other' END AS kind, length(t) AS n FROM x)
SELECT kind, count(*) AS docs, CAST(min(n) AS BIGINT) AS shortest, CAST(sum(n) // count(*) AS BIGINT) AS mean, CAST(max(n) AS BIGINT) AS longest FROM k GROUP BY kind""")
def context_source_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contexts(spark, sf_dir).select(metrics.context_class(F.col("t")).alias("kind"), F.length("t").cast("long").alias("n"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("docs"), F.min("n").alias("shortest"), F.expr("sum(n) div count(*)").alias("mean"), F.max("n").alias("longest"))


_HINTS = {
    "has_doc_headers": "contains(l, 'document [')", "has_title_field": "contains(l, 'title:')", "has_pmid": "regexp_matches(l, '(^|[^a-z0-9_])pmid($|[^a-z0-9_])')", "has_abstract": "contains(l, 'abstract')",
    "has_pubmed_mention": "contains(l, 'pubmed')", "has_url": "contains(l, 'http')", "has_citation_format": r"regexp_matches(l, '\d{4};\d+')", "has_mesh": "contains(l, 'mesh')",
}


@register("context_hints", f"""WITH {_CTX}, y AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _HINTS.items())}], lambda h: h IS NOT NULL) AS h FROM (SELECT doc_id, lower(t) AS l FROM x))
SELECT doc_id, CASE WHEN len(h) = 0 THEN 'unknown_format' ELSE array_to_string(h, ',') END AS hints FROM y""")
def context_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("doc_id", F.array_join(metrics.context_hints(F.col("t")), ",").alias("hints"))


@register("avg_context_tokens", f"{_R} SELECT {_Q.format('avg(length(ctx) / 4)')} AS tokens, {_Z.format('count(*) FILTER (WHERE correct)', 'count(*)')} AS accuracy FROM r")
def avg_context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).agg(quantised(F.avg(F.length("retrieved_context") / 4)).alias("tokens"), metrics.ratio(F.count(F.when(F.col("correct"), 1)), F.count(F.lit(1))).alias("accuracy"))


_RUNS = f"WITH {_sql(0, 'a')}, {_sql(1, 'b')}, {_sql(2, 'c')}, {_sql(3, 'd')}, u AS (" + " UNION ALL ".join(f"SELECT 'run{k}' AS run, lang AS dataset, count(*) AS n, {_Z.format('count(*) FILTER (WHERE correct)', 'count(*)')} AS accuracy FROM {p}r GROUP BY lang" for k, p in enumerate("abcd")) + ")"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [metrics.accuracy(_records(spark, sf_dir, k), "lang").select(F.lit(f"run{k}").alias("run"), F.col("lang").alias("dataset"), F.col("total").alias("n"), "accuracy") for k in range(4)]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@register("best_per_dataset", f"{_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, run) AS k FROM u WHERE n >= 50) SELECT run, dataset, n, accuracy FROM k WHERE k = 1")
def best_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_runs(_runs(spark, sf_dir))


@register("ab_delta", f"{_RUNS} SELECT a.dataset, a.accuracy AS a, b.accuracy AS b, {_Q.format('b.accuracy - a.accuracy')} AS delta FROM u a JOIN u b ON a.dataset = b.dataset AND a.run = 'run0' AND b.run = 'run2'")
def ab_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.deltas(_runs(spark, sf_dir), "run0", "run2")


@register("summary_cube", f"{_R} SELECT coalesce(lang, '*') AS lang, coalesce(gt, '*') AS gt, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct FROM r GROUP BY CUBE (lang, gt)")
def summary_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _records(spark, sf_dir).cube("lang", "gt").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("correct"), 1)).alias("n_correct"))
    return cube.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("gt", F.lit("*")).alias("gt"), "n", "n_correct")


@register("conditional_means", f"{_R}, x AS (SELECT correct, CASE WHEN id % 7 <> 0 THEN n_chars / 100 END AS v FROM r) SELECT count(v) AS n, {_Q.format('avg(v)')} AS mean, {_Q.format('avg(v) FILTER (WHERE correct)')} AS mean_correct, {_Q.format('avg(v) FILTER (WHERE NOT correct)')} AS mean_wrong FROM x")
def conditional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.conditional_means(_records(spark, sf_dir).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("n_chars") / 100)), "v")


@register("rotating_reference", "WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) SELECT id, item_id AS ref_id FROM a JOIN b ON a.i % (SELECT count(*) FROM benchmark) = b.i")
def rotating_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rotating_reference(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")))


@register("best_trace", """WITH t AS (SELECT conv_id AS id, turn AS vote_idx, chr(65 + CAST((conv_id + turn) % 3 AS INTEGER)) AS choice, text FROM conversations WHERE role = 'assistant'),
x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN choice = chr(65 + CAST(id % 3 AS INTEGER)) AND length(text) > 30 THEN 0 ELSE 1 END, vote_idx) AS k FROM t) SELECT id, vote_idx, text FROM x WHERE k = 1""")
def best_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    traces = c.filter("role = 'assistant'").select(F.col("conv_id").alias("id"), F.col("turn").alias("vote_idx"), F.char(65 + (F.col("conv_id") + F.col("turn")) % 3).alias("choice"), "text")
    verdicts = c.groupBy(F.col("conv_id").alias("id")).agg(F.char(65 + F.first("conv_id") % 3).alias("pred"))
    return metrics.best_trace(traces, verdicts)


@register("judge_avg", f"SELECT count(*) AS n, {_Q.format('avg(coalesce(CASE WHEN doc_id % 4 <> 0 THEN n_chars % 11 END, 0))')} AS adequacy, {_Q.format('avg(coalesce(CASE WHEN doc_id % 3 <> 0 THEN n_chars % 2 END, 0))')} AS utilization FROM documents")
def judge_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    return metrics.judge_means(table(spark, sf_dir, "documents").select(F.when(i % 4 != 0, n % 11).alias("adequacy"), F.when(i % 3 != 0, n % 2).alias("utilization")), "adequacy", "utilization")


@register("label_union", f"{_R} SELECT gt AS label FROM r UNION SELECT pred FROM r")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return r.select(F.col("gt").alias("label")).union(r.select("pred")).distinct()
