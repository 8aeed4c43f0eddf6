"""Expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; null gives no words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, each with as many underscores before it as set it apart from the columns of ``docs``, case aside."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return tuple(found)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text (null: empty), modulo 5; decides what a model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
