import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, blank and repeated texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta\nsecond line of the text here\nthird line of it all", "en", "a"),
        (2, None, None, None), (3, "", "en", "a"), (4, " \t\n ", "en", "b"), (None, "no id at all but words", "en", "b"),
        (5, "alpha beta gamma delta epsilon zeta eta theta\nsecond line of the text here\nthird line of it all", "en", "b"),
        (5, "alpha beta gamma delta epsilon zeta eta theta\nsecond line of the text here\nthird line of it all", "en", "b"),
        (5, "another text of the same id", "en", "c"), (6, long, "en", "c"), (7, long + " tail", "fr", "a"), (8, "ß ñ 漢字 \U0001f600 é", "xx", "é"), (9, "one", "en", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("size", "fp", "text_key", "score", "digest", "hash", "rank", "sid", "block", "node", "n", "start", "row", "owner", "found", "toxic", "vec_id", "key", "words",
        "same_id", "same_key", "nth", "gone", "kept", "spans", "member", "label", "toxicity", "found_key", "_id", "_key", "_gone", "_kept", "_text", "_spans", "_found", "_toxicity", "_hash", "_nth", "_s", "bucket", "part", "speaker", "lines"):
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
