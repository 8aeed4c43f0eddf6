"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue, the dialogue is rendered with that participant
as the assistant and all others as named users; the mask marks the code points that
the assistant has to produce (its content and the end mark).  All of it is
DataFrame functions.

Scale: a dialogue is one row a participant up to ``part_turns`` turn numbers; a longer one
comes in parts, and a part that holds a turn number of over ``crowd`` turns in parts of a turn
number, or of a range of the turns' MD5, so that no row grows without bound.  Parts in order
make the whole: ``start`` is where a part begins in it, and masks count from the beginning of
the dialogue.  A part's beginning comes from sums of lengths by speaker, not from the texts.
Participants come from a distinct aggregate, not from a list of turns.

Defined cases: turns are ordered by number, then by the MD5 of speaker and text; exact
repeats of a turn count once; a null turn number comes first, in a part of its own; a null
text is empty; a null or blank role speaks as ``unknown``; system turns are shown as such and
are no participant, so a dialogue of system turns alone gives no row.  Text that imitates a
mark is defused by a space.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _head(speaker: Column, me: Column, systems: tuple[str, ...]) -> Column:
    role = F.when(speaker.isin(*systems), F.lit("system")).when(speaker == me, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def _parts(clean: DataFrame, part_turns: int, crowd: int) -> DataFrame:
    """``clean`` with ``piece``, the (first turn, beginning of the MD5) of the part a turn is in."""
    part = F.floor(F.col("turn") / part_turns)
    # As many digits of the MD5 as leave about ``crowd`` turns of one number together.
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n") / crowd))).cast("int")
    turns = clean.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("conv_id", part.alias("part"), "turn", digits.alias("digits"))
    crowded = turns.groupBy("conv_id", "part").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("turn", F.lit(-1).cast("long")).alias("turn"), "digits"))).alias("digits"))
    crowded = crowded.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("digits"))
    split = F.col("digits").isNotNull()
    own = F.coalesce(F.try_element_at("digits", F.coalesce("turn", F.lit(-1).cast("long"))), F.lit(0))
    return (
        clean.withColumn("part", part)
        .join(crowded, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("part").eqNullSafe(F.col("_part")), "left")
        .withColumn("piece", F.struct(
            F.when(split, F.col("turn")).otherwise(F.col("part") * part_turns).alias("first"), F.when(split, F.substring("tie", F.lit(1), own)).otherwise("").alias("prefix"),
        ))
        .select("conv_id", "piece", "turn", "tie", "role", "said")
    )


def rotate_perspectives(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    systems: tuple[str, ...] = ("system",), part_turns: int = 1024, crowd: int = 1024,
) -> DataFrame:
    """conv_id, part (from 0), speaker, start, n_turns, n_own, text, mask (``start:end`` code points of the whole dialogue, comma-joined)."""
    said = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |"))
    name = F.replace(F.coalesce(F.nullif(F.trim(F.col(role_col)), F.lit("")), F.lit("unknown")), F.lit("<|"), F.lit("< |"))
    clean = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), name.alias("role"), said.alias("said")).distinct()
    clean = _parts(clean.withColumn("tie", F.md5(F.concat_ws("\n", "role", "said"))), part_turns, crowd)
    lines = clean.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "tie", "role", "said"))).alias("lines"))
    me = F.col("speaker")

    # How long each part is to each participant, from sums by speaker.
    sums = clean.groupBy("conv_id", "piece", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("said").cast("long")).alias("chars"))
    speakers = sums.filter(~F.col("role").isin(*systems)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    shown = F.length(_head(F.col("role"), me, systems)) + len(CLOSE) + 1
    long = (
        sums.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).groupBy("conv_id", "piece", "speaker")
        .agg(F.sum(F.col("n") * shown + F.col("chars")).alias("length"))
    )
    order = Window.partitionBy("conv_id", "speaker").orderBy("piece")
    places = long.select(
        F.col("conv_id").alias("_conv"), F.col("piece").alias("_piece"), "speaker", (F.row_number().over(order) - 1).cast("long").alias("part"),
        F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("start"),
    )

    def rendered(x: Column) -> Column:
        head, body = _head(x["role"], me, systems), F.concat(x["said"], F.lit(CLOSE))
        return F.struct(F.concat(head, body, F.lit("\n")).alias("shown"), F.length(head).alias("skip"), F.length(body).alias("body"), (x["role"] == me).alias("own"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["skip"]
        span = F.concat_ws(":", begin, begin + x["body"])
        return F.struct(
            (begin + x["body"] + 1).alias("at"),
            F.when(x["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    begin = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"))
    return (
        lines.join(places, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece")))
        .withColumn("shown", F.transform("lines", rendered))
        .select(
            "conv_id", "part", "speaker", "start", F.size("lines").cast("long").alias("n_turns"),
            F.size(F.filter("shown", lambda x: x["own"])).cast("long").alias("n_own"),
            F.array_join(F.transform("shown", lambda x: x["shown"]), "").alias("text"),
            F.array_join(F.aggregate("shown", begin, step, lambda acc: acc["spans"]), ",").alias("mask"),
        )
    )
