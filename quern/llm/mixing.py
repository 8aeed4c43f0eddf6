"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are laid out in a shuffled order as one stream of words, which
goes round and round and is cut into blocks of equal size, the same for all sources.  Slot
``i`` of the schedule is the golden-ratio point ``frac(i / phi)``; the source whose stretch of
the cumulative weights holds the point owns the slot, and its ``k``-th slot takes the ``k``-th
block of its stream.  A source's last block ends at its target, so that its share is met to
the word.  All of it is DataFrame arithmetic: no Python on rows.

Scale: the words of a source are numbered by prefix sums in three levels (within a bucket of
some thousand documents, over the buckets of a group, over groups), and slots likewise, so no
window ever holds more than a bucket's rows or ``GROUP`` sums of a source, which is enough for
some 10**10 documents a source.  The per-source table has one row a source.

Defined cases: a null or blank text has size 0 and is returned with ``taken`` 0; a
null source is a source of its own, last in order; sources without words have
target 0; repeated rows are separate documents; an empty table gives no rows;
columns other than the three named are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import word_count
from quern.storage import materialize, spread

#: Points are integers below 2**32; the step is floor(2**32 / golden ratio).
POINTS = 1 << 32
STEP = 2654435769
#: Log2 of the points in one cell of the lookup grid.
CELL_BITS = 20
#: Log2 of the places whose sums one window of the second level holds.
GROUP_BITS = 12
GROUP = 1 << GROUP_BITS


@dataclass(frozen=True)
class Mix:
    """``documents``: one row a document; ``schedule``: one row a slot; ``mixed``: the words each slot takes."""

    documents: DataFrame
    schedule: DataFrame
    mixed: DataFrame
    sources: DataFrame


def source_targets(sized: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """One row a source: sid, source, source_size, weight, target.

    Targets share the whole size by weight; those above ``max_epochs`` times their
    source stop there and the rest is shared again.  In the order of limit / weight
    the stopped sources come first, so one pass of running sums finds the end state.
    """
    limit = F.col("source_size") * max_epochs
    order = Window.orderBy(limit / F.col("weight"), "sid")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    before = F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    stops = (total - before) / onward * F.col("weight") > limit
    rest = F.sum(F.when(F.col("stops"), -limit).otherwise(0)).over(everything) + total
    shares = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything)
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
        .withColumn("weight", F.get(cycle, (F.col("sid") % len(weights)).cast("int")))
        .withColumn("stops", stops)
        .withColumn("target", F.when(F.col("stops"), limit.cast("double")).otherwise(rest / F.nullif(shares, F.lit(0.0)) * F.col("weight")))
        .select("sid", "source", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))
    )


def _plan(targets: DataFrame, block_words: int, max_epochs: int) -> DataFrame:
    """Adds the words and slots a source needs, and its stretch [low, high) of the points."""
    by_sid = Window.orderBy("sid")
    all_rows = by_sid.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.floor(F.col("upto") / F.nullif(F.col("all_slots"), F.lit(0)) * POINTS).cast("long")
    return (
        targets.withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs))
        .withColumn("needed", F.expr(f"(words + {block_words - 1}) div {block_words}"))
        .withColumn("upto", F.sum("needed").over(by_sid.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("all_slots", F.max("upto").over(all_rows))
        .withColumn("high", F.coalesce(edge, F.lit(0).cast("long")))
        .withColumn("low", F.coalesce(F.lag("high").over(by_sid), F.lit(0).cast("long")))
    )


def _ahead(counts: DataFrame, place: str) -> DataFrame:
    """sid, ``place``, ahead: the sum of ``n`` over the source's smaller places, in two levels of ``GROUP`` places each."""
    group = F.shiftright(place, GROUP_BITS).alias("group")
    upto = lambda *keys: Window.partitionBy("sid", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    high = counts.groupBy("sid", group).agg(F.sum("n").alias("n")).select("sid", "group", F.coalesce(F.sum("n").over(upto("group")), F.lit(0)).alias("high"))
    low = counts.withColumn("group", group).withColumn("low", F.coalesce(F.sum("n").over(upto("group", place)), F.lit(0)))
    return low.join(high, ["sid", "group"]).select("sid", place, (F.col("low") + F.col("high")).alias("ahead"))


def _schedule(plan: DataFrame, n_slots: int, run: int, few: bool) -> DataFrame:
    """slot, sid, rank: the owner of every slot, and which of the owner's slots it is.

    Golden-ratio points fall into each stretch as often as its length says but for a few;
    slots beyond a source's need are left out, and what sources still lack comes last.
    """
    spark = plan.sparkSession
    high, low = F.expr("(slot % 4294967296) div 65536"), F.col("slot") % 65536
    point = (high * STEP % POINTS * 65536 + low * STEP) % POINTS
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.shiftright("point", CELL_BITS))
    owners = plan.filter("high > low").select(
        "sid", "low", "high", "needed", F.explode(F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS))).alias("cell")
    )
    owned = (
        slots.join(F.broadcast(owners) if few else owners, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
        .select("slot", "sid", "needed", F.floor(F.col("slot") / run).alias("run"))
    )
    counts = materialize(owned.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n")), "slots")
    within = F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1
    scheduled = (
        owned.withColumn("within", within).join(_ahead(counts, "run"), ["sid", "run"])
        .withColumn("rank", (F.col("ahead") + F.col("within")).cast("long")).filter("rank < needed").select("slot", "sid", "rank")
    )
    lacking = (
        plan.join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).filter("n < needed")
        .withColumn("later", F.coalesce(F.sum(F.col("needed") - F.col("n")).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("sid", "n", "later", F.explode(F.sequence(F.col("n"), F.col("needed") - 1)).alias("rank"))
        .select((F.lit(n_slots) + F.col("later") + F.col("rank") - F.col("n")).cast("long").alias("slot"), "sid", "rank")
    )
    return scheduled.unionByName(lacking)


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3),
    max_epochs: int = 3, block_words: int = 256, bucket_rows: int = 4096, slot_run: int = 65536, small_sources: int = 100_000,
) -> Mix:
    """Mix ``docs`` so that each source takes part by its weight.

    Every block has ``block_words`` words, but for a source's last, which ends at its target.
    The per-source table is broadcast if it has at most ``small_sources`` rows.
    """
    sized = materialize(
        spread(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")))
        .select("doc_id", "source", word_count(F.col("text")).alias("size"))
        .withColumn("place", F.xxhash64(F.lit("shuffle"), "doc_id", "size")), "sized",
    )
    plan = materialize(_plan(source_targets(sized, weights, max_epochs), block_words, max_epochs), "plan")
    facts = plan.agg(F.max("all_slots").alias("slots"), F.count(F.lit(1)).alias("sources")).first()
    few = facts.sources <= small_sources
    by_source = F.broadcast(plan) if few else plan
    bits = max(0, (sized.count() // bucket_rows).bit_length())
    bucket = F.shiftrightunsigned("place", 64 - bits) if bits else F.lit(0).cast("long")

    placed = (
        sized.join(by_source.select(F.col("source").alias("own"), "sid", "source_size", "target", "words"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
        .withColumn("bucket", bucket)
    )
    counts = materialize(placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")), "buckets")
    running = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    laid = placed.withColumn("running", running).join(_ahead(counts, "bucket"), ["sid", "bucket"]).withColumn("at", F.col("ahead") + F.col("running") - F.col("size"))

    # A source's stream goes round and round: in round ``epoch`` a document begins at word epoch * source_size + at.
    asked = (F.col("size") > 0) & (F.col("at") < F.col("words"))
    edge = F.col("block") * block_words
    pieces = (
        laid.filter(asked).withColumn("epoch", F.explode(F.expr("sequence(0L, (words - 1 - at) div source_size)")))
        .withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("at")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words")))
        .withColumn("block", F.explode(F.expr(f"sequence(begin div {block_words}, (end - 1) div {block_words})")))
        .withColumn("from_word", F.greatest(F.col("begin"), edge) - F.col("begin"))
        .withColumn("n_words", F.least(F.col("end"), edge + block_words) - F.col("begin") - F.col("from_word"))
    )
    schedule = _schedule(plan, int(facts.slots or 0), slot_run, few)
    taking = pieces.join(schedule.withColumnRenamed("rank", "block"), ["sid", "block"])
    kept = ["sid", "at", "doc_id", "size", "source_size", "target"]
    taken = taking.groupBy(*kept).agg(F.sum("n_words").alias("taken"))
    result = taken.unionByName(laid.filter(~asked).select(*kept, F.lit(0).cast("long").alias("taken")))
    names = by_source.select("sid", "source")
    rounds = by_source.select("sid", "source", "source_size")
    return Mix(
        documents=result.join(names, "sid").select("doc_id", "size", "source_size", "target", "taken", "source"),
        schedule=schedule.join(rounds, "sid").select("slot", "source", "rank", F.expr(f"(rank * {block_words}) div source_size").alias("epoch")),
        mixed=taking.drop("source").join(names, "sid").select("slot", "source", "epoch", "doc_id", "from_word", "n_words"),
        sources=plan.select("source", "source_size", "weight", "target", "needed"),
    )
