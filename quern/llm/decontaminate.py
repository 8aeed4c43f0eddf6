"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document is long, so their Jaccard similarity says
nothing; what counts is containment, the share of the item's distinct word shingles
that the document holds.  Items are partitioned by the power of two of their number
of shingles.  In a partition whose largest size is ``u``, an item's sketch is its
``u - ceil(threshold * u) + 1`` smallest shingle hashes (bottom-k MinHash): a
document that holds ``threshold`` of the shingles misses too few of them to miss the
whole sketch, so the search loses no pair.  Pairs that share a sketch value are
verified on the shingles themselves, as strings.

Scale: only the sketches and the items are ever on the small side of a join.  They
are broadcast behind a check of their counted rows and characters, and joined by
shuffle beyond it.  Documents' shingles are hashed in place and never aggregated.

Defined cases: words are lower-case runs of letters, marks and digits.  A text of
fewer words than a shingle has one shingle, all its words, so a short item matches
only documents that consist of just those words; texts without words match nothing.
Null texts count as empty.  Rows that repeat an id are judged one by one and the
pair is returned once, with its highest count.  A null id is an id.  Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import fresh, plain_words
from quern.storage import materialize, spread


def _shingled(words: Column, width: int, make) -> Column:
    """``make`` of each run of ``width`` words, or of all words where there are fewer; none for no words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: make(*[F.get(words, i + k) for k in range(width)]))
    return F.when(n >= width, runs).when(n > 0, F.array(make(F.array_join(words, " "))))


def shingle_hashes(words: Column, width: int) -> Column:
    return _shingled(words, width, F.xxhash64)


def shingle_strings(words: Column, width: int) -> Column:
    return _shingled(words, width, lambda *w: F.concat_ws(" ", *w))


def sketches(items: DataFrame, threshold: float, width: int) -> DataFrame:
    """item_id, n_shingles, partition, sketch (array of hashes)."""
    largest = F.lit(2) * F.col("low") - 1
    return (
        items.withColumn("hashes", F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), width))))
        .withColumn("n", F.size("hashes")).filter("n > 0")
        .withColumn("partition", F.floor(F.log2("n")).cast("int"))
        .withColumn("low", F.expr("cast(power(2, partition) as int)"))
        .withColumn("sketch", F.slice("hashes", 1, (largest - F.ceil(largest * threshold - 1e-9) + 1).cast("int")))
        .select("item_id", F.col("n").alias("n_shingles"), "partition", "sketch")
    )


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _verified(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text_col: str, threshold: float, width: int, small_rows: int, small_chars: int) -> DataFrame:
    """item_id, doc_id, text_key, n_shingles, n_shared of the rows that hold an item."""
    items = materialize(items.select(F.col(item_id).alias("item_id"), plain_words(F.col(text_col)).alias("words")).distinct(), "items")
    index = materialize(sketches(items, threshold, width).select("item_id", F.explode("sketch").alias("hash")).distinct(), "sketches")
    chars = items.agg(F.coalesce(F.sum(F.length(F.array_join("words", " "))), F.lit(0))).first()[0]
    if index.count() <= small_rows:
        index = F.broadcast(index)
    if chars <= small_chars:
        items = F.broadcast(items)

    texts = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")))
    hashed = texts.select("doc_id", plain_words(F.col("text")).alias("words")).select("doc_id", F.explode(shingle_hashes(F.col("words"), width)).alias("hash"))
    candidates = materialize(hashed.join(index, "hash").select("doc_id", "item_id").distinct(), "candidates")

    pairs = candidates.withColumnRenamed("doc_id", "_doc")
    own, other = F.array_distinct(shingle_strings(F.col("item_words"), width)), shingle_strings(F.col("words"), width)
    return (
        texts.join(candidates.select(F.col("doc_id").alias("_doc")).distinct(), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
        .select("doc_id", _text_key(F.col("text")).alias("text_key"), plain_words(F.col("text")).alias("words"))
        .withColumn("strings", F.array_distinct(other)).drop("words")
        .join(pairs, F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc")
        .join(items.select(F.col("item_id").alias("_item"), F.col("words").alias("item_words")), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
        .withColumn("own", own)
        .select("item_id", "doc_id", "text_key", F.size("own").cast("long").alias("n_shingles"), F.size(F.array_intersect("own", "strings")).cast("long").alias("n_shared"))
        .filter(F.col("n_shared") >= F.col("n_shingles") * threshold - 1e-9)
    )


def contaminated_pairs(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text",
    threshold: float = 0.8, width: int = 5, small_rows: int = 1_000_000, small_chars: int = 8_000_000,
) -> DataFrame:
    """item_id, doc_id, n_shingles, n_shared, containment of every pair at ``threshold`` or above."""
    share = (F.col("n_shared") / F.col("n_shingles")).alias("share")
    return (
        _verified(docs, items, doc_id, item_id, text_col, threshold, width, small_rows, small_chars)
        .groupBy("item_id", "doc_id").agg(F.max(F.struct(share, "n_shingles", "n_shared")).alias("best"))
        .select("item_id", "doc_id", "best.n_shingles", "best.n_shared", F.col("best.share").alias("containment"))
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text",
    threshold: float = 0.8, width: int = 5, small_rows: int = 1_000_000, small_chars: int = 8_000_000, small_found: int = 1_000_000,
) -> DataFrame:
    """``docs`` without the rows that hold a test item; a clean row that shares its id with one that does stays.

    The keys of the rows that go are broadcast if there are at most ``small_found``.
    """
    found = _verified(docs, items, doc_id, item_id, text_col, threshold, width, small_rows, small_chars)
    found_id, found_key = fresh(docs, "found_id", "found_key")
    found = materialize(found.select(F.col("doc_id").alias(found_id), F.col("text_key").alias(found_key)).distinct(), "found")
    same = docs[doc_id].eqNullSafe(F.col(found_id)) & (_text_key(docs[text_col]) == F.col(found_key))
    return docs.join(F.broadcast(found) if found.count() <= small_found else found, same, "left_anti")
