"""The REST source behind its cache, and archives that break off."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from quern.sources import articles, rest


@pytest.fixture()
def service(spark, tmp_path):
    records = spark.createDataFrame([(str(i), f"T{i}", None if i % 9 == 0 else f"text {i}") for i in range(130)], "id string, title string, abstract string")
    root = str(tmp_path / "service")
    rest.Folder.fill(records, root, 8)
    return rest.Folder(root, 8, failures=1)


def test_second_run_asks_nothing(spark, tmp_path, service):
    ids = spark.createDataFrame([(str(i),) for i in [*range(120), 5, 500, 501]] + [(None,)], "id string")
    cache = str(tmp_path / "cache")
    first = sorted(rest.lookup(ids, service, cache, pause=0.01).collect())
    assert service.requests() == 3  # 122 ids, 50 a request
    assert len(first) == 122 and {r.id for r in first if r.title is None} == {"500", "501"}
    assert {r.id: r.abstract for r in first}["10"] == "text 10" and {r.id: r.abstract for r in first}["9"] is None
    assert sorted(rest.lookup(ids, service, cache, pause=0.01).collect()) == first and service.requests() == 3
    more = rest.lookup(ids.union(spark.createDataFrame([("125",)], "id string")), service, cache, pause=0.01)
    assert more.count() == 123 and service.requests() == 4


def test_many_ids_are_asked_in_place(spark, tmp_path, service):
    ids = spark.range(130).select(F.col("id").cast("string").alias("id"))
    few = sorted(rest.lookup(ids, service, str(tmp_path / "a"), pause=0.01).collect())
    assert sorted(rest.lookup(ids, service, str(tmp_path / "b"), most=10, pause=0.01).collect()) == few
    assert rest.lookup(ids.filter("false"), service, str(tmp_path / "c")).count() == 0


def test_a_service_that_stays_away_is_an_error(spark, tmp_path, service):
    away = rest.Folder(service.root, 8, failures=9)
    with pytest.raises(Exception, match="Unavailable|failed"):
        rest.lookup(spark.createDataFrame([("1",)], "id string"), away, str(tmp_path / "c"), tries=2, pause=0.01)


def article(i, pad=0):
    return f'<PubmedArticle Owner="x"><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>T{i} &amp; é</ArticleTitle><Abstract><AbstractText Label="AIM">a{i}</AbstractText><AbstractText>{"z" * pad}.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>'


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_articles_before_the_break(spark, tmp_path, monkeypatch, piece):
    """Half a file gives all articles that are complete in it."""
    monkeypatch.setattr(articles, "PIECE", piece)
    rng = random.Random(1)
    texts = [article(i, rng.randrange(60)) + f"<!-- {rng.random()} -->\n" for i in range(300)]
    whole = gzip.compress(("<?xml version='1.0'?><PubmedArticleSet>" + "".join(texts) + "</PubmedArticleSet>").encode())
    content = whole[: len(whole) // 2]
    found = list(articles.elements(articles.inflated(memoryview(content)), "PubmedArticle"))
    import zlib

    reader = zlib.decompressobj(31)
    plain = reader.decompress(content).decode("utf-8", "ignore")
    assert len(found) == plain.count("</PubmedArticle>") > 50 and found == [t.split("<!--")[0] for t in texts[: len(found)]]
    (tmp_path / "half.xml.gz").write_bytes(content)
    got = articles.read_articles(spark, str(tmp_path / "half.xml.gz")).collect()
    assert sorted(int(r.pmid) for r in got) == list(range(len(found))) and got[3].title == f"T{got[3].pmid} & é" and got[3].abstract.startswith(f"AIM: a{got[3].pmid} ")


def test_damage_members_plain_and_empty(spark, tmp_path):
    two = gzip.compress(article(1).encode()) + gzip.compress(article(2).encode()) + b"\0" * 20
    (tmp_path / "two.xml.gz").write_bytes(two)
    damaged = bytearray(gzip.compress("".join(article(i, i) for i in range(10, 400)).encode(), 1))
    damaged[len(damaged) // 2] ^= 0xFF
    (tmp_path / "damaged.xml.gz").write_bytes(bytes(damaged))
    (tmp_path / "plain.xml").write_text("<PubmedArticleSet>" + article(3) + article(4)[:60])
    (tmp_path / "empty.xml.gz").write_bytes(b"")
    found = {int(r.pmid) for r in articles.read_articles(spark, str(tmp_path)).collect()}
    assert {1, 2, 3, 10} <= found and 4 not in found
