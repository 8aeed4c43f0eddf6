"""Quality metrics over result records.

Records are rows of (id, gt, pred, correct, vote_distribution, retrieved_context, ...).
Shares are doubles from exact counts; a share of nothing is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import quantised


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(records: DataFrame, *groups: str) -> DataFrame:
    """total, n_correct, skipped, accuracy: records without an answer on either side are skipped."""
    full = (F.col("gt") != "") & (F.col("pred") != "") & F.col("gt").isNotNull() & F.col("pred").isNotNull()
    counts = records.groupBy(*groups).agg(F.count(F.when(full, 1)).alias("total"), F.count(F.when(full & (F.col("gt") == F.col("pred")), 1)).alias("n_correct"), F.count(F.when(~full | full.isNull(), 1)).alias("skipped"))
    return counts.withColumn("accuracy", ratio(F.col("n_correct"), F.col("total")))


def per_class(records: DataFrame, *groups: str, domain: str = "union", labels: tuple[str, ...] = ()) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 of each class.

    Classes are those of truth and prediction (``union``), of the truth (``gt``), or
    ``labels`` (``fixed``; pairs outside of them are left out).
    """
    pairs = records.groupBy(*groups, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    if domain == "fixed":
        pairs = pairs.filter(F.col("gt").isin(*labels) & F.col("pred").isin(*labels))
    hit = F.col("gt") == F.col("pred")
    side = F.array(
        F.struct(F.col("gt").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn"), F.lit(True).alias("true_side")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn"), F.lit(False).alias("true_side")),
    )
    counts = pairs.select(*groups, F.explode(side).alias("s")).groupBy(*groups, F.col("s.label").alias("label")).agg(
        *[F.sum(f"s.{c}").cast("long").alias(c) for c in ("tp", "fp", "fn")], F.max("s.true_side").alias("in_truth"))
    if domain == "gt":
        counts = counts.filter("in_truth")
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (
        counts.withColumn("support", F.col("tp") + F.col("fn")).withColumn("precision", precision).withColumn("recall", recall)
        .withColumn("f1", quantised(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).drop("in_truth")
    )


def macro(classes: DataFrame, *groups: str) -> DataFrame:
    return classes.groupBy(*groups).agg(*[quantised(F.avg(c)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.count(F.lit(1)).alias("n_classes"))


def confusion(records: DataFrame) -> DataFrame:
    """gt, pred, n over the square of all labels, zeros included."""
    labels = records.select(F.explode(F.array("gt", "pred")).alias("label")).groupBy().agg(F.array_sort(F.collect_set("label")).alias("all"))
    cells = labels.select(F.explode("all").alias("gt"), "all").select("gt", F.explode("all").alias("pred"))
    counts = records.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["gt", "pred"], "left").na.fill(0, ["n"])


def class_errors(records: DataFrame) -> DataFrame:
    """gt, support, errors, error_rate, misread (``label:count`` by count)."""
    counts = records.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    wrong = F.col("gt") != F.col("pred")
    misread = F.array_sort(F.collect_list(F.when(wrong, F.struct((-F.col("n")).alias("n"), "pred"))))
    return counts.groupBy("gt").agg(F.sum("n").alias("support"), F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("errors"), misread.alias("m")).select(
        "gt", "support", "errors", ratio(F.col("errors"), F.col("support")).alias("error_rate"),
        F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["pred"], (-x["n"]).cast("string"))), ",").alias("misread"))


def _votes(record_map: str = "vote_distribution") -> tuple[Column, Column]:
    values = F.map_values(F.col(record_map))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v), F.array_max(values)


def unanimity(records: DataFrame) -> DataFrame:
    """n_voted, n_unanimous, rate: all votes for one choice; records without votes are left out."""
    total, most = _votes()
    counts = records.agg(F.count(F.when(total > 0, 1)).alias("n_voted"), F.count(F.when((total > 0) & (most == total), 1)).alias("n_unanimous"))
    return counts.withColumn("rate", ratio(F.col("n_unanimous"), F.col("n_voted")))


def vote_confidence(records: DataFrame, n_votes: int = 3) -> DataFrame:
    """unanimous_rate and avg_winner_frac of ``n_votes`` votes."""
    total, most = _votes()
    counts = records.filter(total > 0).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(most == n_votes, 1)).alias("k"), F.sum(most).alias("won"))
    return counts.select("n", ratio(F.col("k"), F.col("n")).alias("unanimous_rate"), quantised(ratio(F.col("won"), F.col("n") * n_votes)).alias("avg_winner_frac"))


def calibration(records: DataFrame) -> DataFrame:
    """won, total, n, n_correct of each confidence (winner's votes / votes)."""
    total, most = _votes()
    return records.filter(total > 0).groupBy(most.alias("won"), total.alias("total")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("correct"), 1)).alias("n_correct"))


def expected_calibration_error(records: DataFrame) -> DataFrame:
    """n, ece: the gaps between accuracy and confidence, weighted by bin size over all records."""
    gap = F.abs(F.col("n_correct") / F.col("n") - F.col("won") / F.col("total")) * F.col("n")
    size = records.agg(F.count(F.lit(1)).alias("n"))
    gaps = calibration(records).agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("gaps"))
    return size.join(F.broadcast(gaps)).select("n", quantised(ratio(F.col("gaps"), F.col("n"))).alias("ece"))


def selective(records: DataFrame) -> DataFrame:
    """selective_accuracy among unanimous records, and their coverage of all."""
    total, most = _votes()
    sure = (total > 0) & (most == total)
    counts = records.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(sure, 1)).alias("k"), F.count(F.when(sure & F.col("correct"), 1)).alias("c"))
    return counts.select("n", ratio(F.col("c"), F.col("k")).alias("selective_accuracy"), ratio(F.col("k"), F.col("n")).alias("coverage"))


def one_class(records: DataFrame, label: str) -> DataFrame:
    """precision and recall of one class."""
    p, g = F.col("pred") == label, F.col("gt") == label
    counts = records.agg(F.count(F.when(p & g, 1)).alias("tp"), F.count(F.when(p & ~g, 1)).alias("fp"), F.count(F.when(~p & g, 1)).alias("fn"))
    return counts.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def prediction_bias(records: DataFrame) -> DataFrame:
    """pred, pred_n, gt_n, bias (points of per cent), biased (over 10): predicted classes only."""
    predicted = records.groupBy("pred").agg(F.count(F.lit(1)).alias("pred_n"))
    truth = records.groupBy("gt").agg(F.count(F.lit(1)).alias("gt_n"))
    total = records.agg(F.count(F.lit(1)).alias("n"))
    joined = predicted.join(truth, predicted.pred == truth.gt, "left").na.fill(0, ["gt_n"]).join(F.broadcast(total))
    return joined.withColumn("bias", quantised((F.col("pred_n") - F.col("gt_n")) / F.col("n") * 100)).select("pred", "pred_n", "gt_n", "bias", (F.abs("bias") > 10).alias("biased"))


def error_class(context: Column) -> Column:
    """What a wrong answer is put down to; for records with ``vote_distribution``."""
    total, most = _votes()
    bare = F.length(F.trim(F.coalesce(context, F.lit(""))))
    return F.when(bare < 50, "retrieval_empty").when(F.length(context) < 200, "retrieval_short").when((total > 0) & (most == total), "unanimous_wrong").otherwise("split_vote_wrong")


def error_taxonomy(records: DataFrame) -> DataFrame:
    return records.filter(~F.col("correct")).groupBy(error_class(F.col("retrieved_context")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def context_class(context: Column) -> Column:
    """Where a context comes from, by the marks in it."""
    has = lambda *marks: F.rlike(context, F.lit("|".join(marks)))
    graph, pubmed = has("KG:", "Atomic Propositions", "Entity:"), has("PMID", "Abstract", "PubMed")
    return F.when(F.length(F.trim(context)) < 80, "empty").when(graph & pubmed, "kg+pubmed").when(graph, "kg_only").when(pubmed, "pubmed_only").otherwise("other")


def context_hints(context: Column) -> Column:
    """What a context seems to hold."""
    low = F.lower(context)
    word = lambda p: F.rlike(low, F.lit(p))
    hints = {
        "has_doc_headers": F.contains(low, F.lit("document [")), "has_title_field": F.contains(low, F.lit("title:")), "has_pmid": word(r"(^|[^a-z0-9_])pmid($|[^a-z0-9_])"),
        "has_abstract": F.contains(low, F.lit("abstract")), "has_pubmed_mention": F.contains(low, F.lit("pubmed")), "has_url": F.contains(low, F.lit("http")),
        "has_citation_format": word(r"\d{4};\d+"), "has_mesh": F.contains(low, F.lit("mesh")),
    }
    found = F.array_compact(F.array(*[F.when(c, n) for n, c in hints.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown_format")))


def best_runs(runs: DataFrame, min_n: int = 50) -> DataFrame:
    """The most accurate run of each data set (dataset, run, n, accuracy), of equals the first by name."""
    order = Window.partitionBy("dataset").orderBy(F.desc("accuracy"), F.asc("run"))
    return runs.filter(F.col("n") >= min_n).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def deltas(runs: DataFrame, a: str, b: str) -> DataFrame:
    """dataset, a, b, delta of two runs' accuracies."""
    side = lambda r, n: runs.filter(F.col("run") == r).select("dataset", F.col("accuracy").alias(n))
    return side(a, "a").join(side(b, "b"), "dataset").withColumn("delta", quantised(F.col("b") - F.col("a")))


def conditional_means(records: DataFrame, value: str) -> DataFrame:
    """n, mean, mean_correct, mean_wrong; missing values are left out."""
    mean = lambda c: quantised(F.avg(c))
    v, ok = F.col(value), F.col("correct")
    return records.agg(F.count(value).alias("n"), mean(v).alias("mean"), mean(F.when(ok, v)).alias("mean_correct"), mean(F.when(~ok, v)).alias("mean_wrong"))


def rotating_reference(records: DataFrame, pool: DataFrame) -> DataFrame:
    """id, ref_id: the i-th record by id takes the (i mod size)-th reference.

    Places come from counts of smaller ids per bucket of 1,024, so no window holds more than one bucket's records.
    """
    def placed(rows: DataFrame, name: str) -> DataFrame:
        bucket = F.floor(F.col("id") / 1024)
        counts = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        ahead = counts.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
        within = F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1
        return rows.withColumn("b", bucket).withColumn("w", within).join(ahead, "b").select(F.col("id").alias(name), (F.col("ahead") + F.col("w")).alias("at"))

    size = pool.count()
    refs = placed(pool, "ref_id")
    return placed(records, "id").withColumn("at", F.col("at") % max(size, 1)).join(refs, "at").select("id", "ref_id")


def best_trace(traces: DataFrame, verdicts: DataFrame, min_chars: int = 30) -> DataFrame:
    """id, vote_idx, text: the first trace that argues for the verdict at some length, else the first trace."""
    fits = (F.col("choice") == F.col("pred")) & (F.length("text") > min_chars)
    order = Window.partitionBy("id").orderBy(F.when(fits, 0).otherwise(1), "vote_idx")
    return traces.join(verdicts, "id").withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("id", "vote_idx", "text")


def judge_means(records: DataFrame, *scores: str) -> DataFrame:
    """Means of the judge's scores, missing ones as 0."""
    return records.agg(F.count(F.lit(1)).alias("n"), *[quantised(F.avg(F.coalesce(F.col(s).cast("double"), F.lit(0.0)))).alias(s) for s in scores])
