"""Text expressions: tokenisers, sentences, n-grams, chunks, markup, URLs, JSON salvage.

All are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def ws_tokens(x: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(empty_if_null(x)), r"\s+"), lambda t: t != "")


def ascii_tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and hyphens."""
    return F.regexp_extract_all(F.lower(empty_if_null(x)), F.lit(r"[a-zA-Z0-9\-]+"), F.lit(0))


def web_terms(x: Column) -> Column:
    """The distinct terms of three characters or more that start with a letter or digit."""
    return F.array_distinct(F.regexp_extract_all(F.lower(empty_if_null(x)), F.lit(r"[a-z0-9][a-z0-9\-]{2,}"), F.lit(0)))


def unicode_tokens(x: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores of any script."""
    return F.regexp_extract_all(F.lower(empty_if_null(x)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def sentences(x: Column, min_chars: int = 20) -> Column:
    """Split after . ! or ? and white space; stripped pieces longer than ``min_chars``."""
    pieces = F.transform(F.split(strip(empty_if_null(x)), r"(?<=[.!?])\s+"), strip)
    return F.filter(pieces, lambda s: F.length(s) > min_chars)


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by a space."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def word_chunks(words: Column, size: int = 150, overlap: int = 30, min_words: int = 10) -> Column:
    """Windows of ``size`` words, ``size - overlap`` apart, of more than ``min_words``, as arrays."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.slice(words, i, size)), lambda c: F.size(c) > min_words)


def strip_tags(x: Column, by: str = " ") -> Column:
    """Markup replaced by ``by``, runs of white space by one space, ends stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(empty_if_null(x), r"<[^>]+>", by), r"\s+", " "))


def html_text(x: Column, limit: int = 3500) -> Column:
    """Visible text: without script, style, nav, footer and header subtrees, tags as spaces, ``limit`` characters at most."""
    bare = F.regexp_replace(empty_if_null(x), r"(?is)<(script|style|nav|footer|header)\b.*?</\1\s*>", " ")
    return F.substring(strip_tags(bare), 1, limit)


def paragraphs(x: Column, min_chars: int = 30) -> Column:
    """The contents of <p> elements, without tags, longer than ``min_chars``."""
    inner = F.regexp_extract_all(empty_if_null(x), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(inner, lambda p: strip_tags(p, "")), lambda p: F.length(p) > min_chars)


def url_domain(url: Column) -> Column:
    """The network location in lower case without a leading ``www.``; empty where there is none."""
    netloc = F.regexp_extract(empty_if_null(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.trim(F.lower(netloc)), r"^www\.", "")


def domain_matches(domain: Column, target: str) -> Column:
    return (domain == target) | F.endswith(domain, F.lit("." + target))


def fts_query(x: Column) -> Column:
    """Words of more than three ASCII letters or digits, joined by OR."""
    clean = F.regexp_replace(empty_if_null(x), r"[^a-zA-Z0-9 ]", "")
    return F.array_join(F.filter(F.split(clean, " +"), lambda w: F.length(w) > 3), " OR ")


def fallback_query(x: Column, words: int = 12) -> Column:
    """The first ``words`` words of more than three characters, without ? and commas."""
    clean = F.translate(empty_if_null(x), "?,", "")
    return F.array_join(F.slice(F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) > 3), 1, words), " ")


def unique_queries(queries: Column, most: int) -> Column:
    """Stripped, not blank, in order of first appearance, ``most`` at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(queries, strip), lambda q: q != "")), 1, most)


def salvage_json(x: Column) -> Column:
    """The text if it is a JSON object, else the stretch from its first to its last brace if that is, else {}."""
    whole = F.when(F.try_parse_json(x).isNotNull() & F.startswith(F.ltrim(x), F.lit("{")), F.trim(x))
    inner = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner), F.lit("{}"))


def citation_marks(x: Column) -> Column:
    """The distinct numbers in square brackets, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(empty_if_null(x), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int")))


def without_marks(x: Column) -> Column:
    return F.trim(F.regexp_replace(empty_if_null(x), r"\[\d+\]", ""))


def render_options(options: Column) -> Column:
    """A map of options as lines ``key. text``, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def capitalised_terms(x: Column) -> Column:
    """Lower-cased phrases that start with a capital and go on in small letters, longer than three characters."""
    found = F.regexp_extract_all(empty_if_null(x), F.lit(r"\b[A-Z][a-z]+(?:\s+[a-z]+)*\b"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) > 3), F.lower))


def quantised(x: Column) -> Column:
    """Rounded half up to six decimals in plain floating-point steps, alike in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6
