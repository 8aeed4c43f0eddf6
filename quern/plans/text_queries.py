"""Queries over the text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.retrieval import small
from quern.plans.catalog import register
from quern.storage import materialize
from quern.tables import table


def _counted(name: str, tokens, sql_tokens: str) -> None:
    """A query of a tokeniser: tokens and distinct tokens of each document."""

    @register(name, f"""
WITH t AS (SELECT doc_id, {sql_tokens} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(list_distinct(w)) AS INTEGER) AS n_terms, md5(array_to_string(w, ' ')) AS tokens_md5 FROM t""")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = tokens(F.col("text"))
        return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select(
            "doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_terms"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


_counted("tokenize_ws", T.ws_tokens, r"list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')")
_counted("tokenize_ascii", T.ascii_tokens, r"regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9\-]+')")
_counted("unicode_tokens", T.unicode_tokens, r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')")


@register("web_terms", r"""
SELECT page_id, CAST(len(list_distinct(regexp_extract_all(lower(html), '[a-z0-9][a-z0-9\-]{2,}'))) AS INTEGER) AS n_terms,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower(url), '[a-z0-9][a-z0-9\-]{2,}'))), ' ') AS url_terms FROM pages""")
def web_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(T.web_terms(F.col("html"))).alias("n_terms"), F.array_join(F.array_sort(T.web_terms(F.col("url"))), " ").alias("url_terms"))


@register("sentence_split", r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20) AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


@register("ngrams_1_5", r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-zA-Z0-9\-]+') AS w FROM benchmark),
g AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS ngram FROM w, unnest([1, 2, 3, 4, 5]) AS a(n), unnest(range(1, len(w) - n + 2)) AS b(i))
SELECT item_id, CAST(n AS INTEGER) AS n, ngram, count(*) AS times FROM g GROUP BY item_id, n, ngram""")
def ngrams_1_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", T.ascii_tokens(F.col("text")).alias("w"))
    each = F.array(*[F.struct(F.lit(n).alias("n"), T.ngrams(F.col("w"), n).alias("g")) for n in range(1, 6)])
    return words.select("item_id", F.explode(each).alias("e")).select("item_id", "e.n", F.explode("e.g").alias("ngram")).groupBy("item_id", "n", "ngram").agg(F.count(F.lit(1)).alias("times"))


@register("bigram_counts", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
g AS (SELECT w[i] || ' ' || w[i + 1] AS bigram, doc_id FROM w, unnest(range(1, len(w))) AS b(i))
SELECT bigram, count(*) AS times, count(DISTINCT doc_id) AS docs FROM g GROUP BY bigram HAVING count(DISTINCT doc_id) > 1""")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """bigram, times, docs of ``docs(doc_id, text)``, for bigrams of more than one document.

    A document's pairs are in its row, so that a row tells which of them are its first, and all are added up before they are shuffled.
    Only ids that several rows share are brought together with their pairs.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 and doc_id is not null").select("doc_id")
    shared = materialize(ids, "shared")
    some = not shared.isEmpty()
    pairs = lambda rows: rows.select("doc_id", T.unicode_tokens(F.col("text")).alias("w")).select("doc_id", F.array_sort(T.ngrams(F.col("w"), 2)).alias("g"))
    once = pairs(docs.join(small(shared), "doc_id", "left_anti") if some else docs)
    # Equal pairs stand together; a row without an id is no document.
    marked = F.transform("g", lambda x, i: F.struct(x.alias("bigram"), ((i == 0) | (x != F.get("g", i - 1))).alias("first")))
    each = once.select("doc_id", F.explode(marked).alias("e"))
    counted = each.select("e.bigram", (F.col("e.first") & F.col("doc_id").isNotNull()).cast("long").alias("docs"), F.lit(1).cast("long").alias("times"))
    if some:
        several = pairs(docs.join(small(shared), "doc_id", "left_semi")).select("doc_id", F.explode("g").alias("bigram"))
        counted = counted.unionByName(several.groupBy("doc_id", "bigram").agg(F.count(F.lit(1)).alias("times")).select("bigram", F.lit(1).cast("long").alias("docs"), "times"))
    return counted.groupBy("bigram").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")).filter("docs > 1")


@register("chunk_words", r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, i, w[i:i + 149] AS c FROM w, unnest(range(1, len(w) + 1, 120)) AS r(i)),
k AS (SELECT * FROM c WHERE len(c) > 10)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk, CAST(len(c) AS INTEGER) AS n_words, md5(array_to_string(c, ' ')) AS chunk_md5 FROM k""")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(T.empty_if_null(F.col("text")), r"\s+"), lambda t: t != "").alias("w"))
    return words.select("doc_id", F.posexplode(T.word_chunks(F.col("w"))).alias("chunk", "c")).select("doc_id", "chunk", F.size("c").alias("n_words"), F.md5(F.array_join("c", " ")).alias("chunk_md5"))


@register("strip_tags", r"""
SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5
FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS t FROM pages)""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


_SUBTREES = "html"
for _tag in ("script", "style", "nav", "footer", "header"):
    _SUBTREES = rf"regexp_replace({_SUBTREES}, '(?is)<{_tag}\b.*?</{_tag}\s*>', ' ', 'g')"


@register("html_to_text", rf"""
SELECT page_id, substring(trim(regexp_replace(regexp_replace({_SUBTREES}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' '), 1, 3500) AS text FROM pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@register("html_paragraphs", r"""
WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1),
  lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), ' ')), lambda x: length(x) > 30) AS p FROM pages)
SELECT page_id, CAST(len(p) AS INTEGER) AS n_paragraphs, array_to_string(p, ' ') AS content FROM p""")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.paragraphs(F.col("html")).alias("p")).select("page_id", F.size("p").alias("n_paragraphs"), F.array_join("p", " ").alias("content"))


_DOMAIN = r"regexp_replace(trim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), ' '), '^www\.', '')"


@register("url_domain", f"SELECT {_DOMAIN} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(T.url_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@register("truncate_project", "SELECT doc_id, substring(text, 1, 300) AS cited, substring(text, 1, 400) AS defined, substring(text, 1, 512) AS reranked FROM documents")
def truncate_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[F.substring("text", 1, n).alias(a) for a, n in (("cited", 300), ("defined", 400), ("reranked", 512))])


@register("fts_query_build", r"""
SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g'), ' +'), lambda x: length(x) > 3), ' OR ') AS match_query FROM benchmark""")
def fts_query_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.fts_query(F.col("text")).alias("match_query"))


@register("fallback_query", r"""
SELECT item_id, array_to_string(list_filter(string_split_regex(replace(replace(text, '?', ''), ',', ''), '\s+'), lambda x: length(x) > 3)[1:12], ' ') AS query FROM benchmark""")
def fallback_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.fallback_query(F.col("text")).alias("query"))


@register("query_dedupe", r"""
WITH s AS (SELECT item_id, list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM benchmark),
e AS (SELECT item_id, i, s[i] AS q FROM s, unnest(range(1, len(s) + 1)) AS r(i)),
f AS (SELECT item_id, q, min(i) AS i FROM e GROUP BY item_id, q),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM f)
SELECT item_id, string_agg(q, '|' ORDER BY n) AS queries FROM k WHERE n <= 8 GROUP BY item_id""")
def query_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.unique_queries(F.split("text", r"\."), 8), "|").alias("queries"))


@register("cache_key", "SELECT item_id, md5('search:pubmed:' || text || ':10') AS cache_key FROM benchmark")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.concat_ws(":", F.lit("search"), F.lit("pubmed"), "text", F.lit("10"))).alias("cache_key"))


@register("batch_ids_50", """
WITH b AS (SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS batch, source FROM documents)
SELECT source, CAST(batch AS INTEGER) AS batch, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM b GROUP BY source, batch""")
def batch_ids_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources.search import batched_ids

    return batched_ids(table(spark, sf_dir, "documents"), "doc_id", "source").select(
        "source", "batch", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@register("json_salvage", r"""
SELECT event_id, CAST(props ->> '$.k' AS VARCHAR) AS k FROM events""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("noise "), F.col("props"), F.lit(" tail"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(T.salvage_json(noisy), "$.k").alias("k"))


@register("options_render", """
SELECT item_id, 'A. ' || substring(text, 1, 10) || chr(10) || 'B. ' || substring(text, 11, 10) || chr(10) || 'C. ' || substring(text, 21, 10) AS options FROM benchmark""")
def options_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.create_map(*[x for k, at in (("C", 21), ("A", 1), ("B", 11)) for x in (F.lit(k), F.substring("text", at, 10))])
    return table(spark, sf_dir, "benchmark").select("item_id", T.render_options(options).alias("options"))


_CITED = "'[' || (doc_id % 3 + 1) || '] ' || substring(text, 1, 60) || ' [' || (doc_id % 5 + 1) || '][' || (doc_id % 3 + 1) || ']'"


@register("citation_markers", rf"""
WITH c AS (SELECT doc_id, {_CITED} AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = doc_id % 5 THEN CAST(doc_id % 3 + 1 AS VARCHAR) ELSE CAST(doc_id % 3 + 1 AS VARCHAR) || ',' || CAST(doc_id % 5 + 1 AS VARCHAR) END AS marks,
  trim(regexp_replace(t, '\[\d+\]', '', 'g'), ' ') AS statement FROM c WHERE length(trim(regexp_replace(t, '\[\d+\]', '', 'g'), ' ')) >= 10""")
def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda m: (F.col("doc_id") % m + 1).cast("string")
    cited = F.concat(F.lit("["), n(3), F.lit("] "), F.substring("text", 1, 60), F.lit(" ["), n(5), F.lit("]["), n(3), F.lit("]"))
    return (
        table(spark, sf_dir, "documents").select("doc_id", cited.alias("t"))
        .select("doc_id", F.array_join(T.citation_marks(F.col("t")).cast("array<string>"), ",").alias("marks"), T.without_marks(F.col("t")).alias("statement"))
        .filter(F.length("statement") >= 10)
    )


@register("decompose_fallback", r"""
WITH t AS (SELECT item_id, list_transform(list_filter(regexp_extract_all(text, '\b[A-Z][a-z]+(?:\s+[a-z]+)*\b'), lambda x: length(x) > 3), lambda x: lower(x)) AS t FROM benchmark WHERE regexp_full_match(text, '[\x00-\x7F]*'))
SELECT item_id, array_to_string(list_sort(list_distinct(t)), '|') AS entities FROM t""")
def decompose_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    # \b is read differently beside letters outside ASCII, so the two engines are compared on ASCII items.
    rows = table(spark, sf_dir, "benchmark").filter(F.rlike("text", F.lit(r"\A[\x00-\x7F]*\z")))
    return rows.select("item_id", F.array_join(F.array_sort(T.capitalised_terms(F.col("text"))), "|").alias("entities"))


@register("xml_extract", r"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g'), ' ') AS title,
  CAST(len(regexp_extract_all(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)) AS INTEGER) AS n_headings FROM pages""")
def xml_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), r"\s+", " ")).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1>"), F.lit(1))).alias("n_headings"))


@register("term_intersect", r"""
WITH i AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]{2,}')) AS t FROM benchmark),
u AS (SELECT page_id, list_distinct(regexp_extract_all(lower(html), '[a-z0-9][a-z0-9\-]{2,}')) AS t FROM pages),
a AS (SELECT item_id, unnest(t) AS term FROM i), b AS (SELECT page_id, unnest(t) AS term FROM u)
SELECT item_id, page_id, count(*) AS shared FROM a JOIN b USING (term) GROUP BY item_id, page_id""")
def term_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.web_terms(F.col("text"))).alias("term"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(T.web_terms(F.col("html"))).alias("term"))
    return pages.join(items, "term").groupBy("item_id", "page_id").agg(F.count(F.lit(1)).alias("shared"))


@register("option_except", """
SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')), lambda x: NOT list_contains(['selective','inhibition','blockade','activation','receptor','yes','no','true','false'], x))), ' ') AS words
FROM part WHERE len(list_filter(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')), lambda x: NOT list_contains(['selective','inhibition','blockade','activation','receptor','yes','no','true','false'], x))) >= 2""")
def option_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.graph import option_words

    return table(spark, sf_dir, "part").select("p_partkey", option_words(F.col("p_name")).alias("w")).filter(F.size("w") >= 2).select("p_partkey", F.array_join(F.array_sort("w"), " ").alias("words"))
