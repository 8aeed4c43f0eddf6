import pytest
from pyspark.sql import functions as F

from quern.llm import toxicity


@pytest.fixture(scope="module")
def data(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def model(data):
    return toxicity.train(*data)


@pytest.mark.parametrize("seen, meant", [("m0r0n", "moron"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("p@thetic", "pathetic"), ("tr@$h", "trash"), ("scummmm", "scum"), ("the", "the"), ("llevar", "llevar")])
def test_restores_disguised_words(model, seen, meant):
    assert toxicity.restore(seen, model["lm"]) == meant


def test_spaced_letters(model):
    assert toxicity.disguised("you are a l o s e r , really") == ["a l o s e r", "l o s e r"]
    assert toxicity.restore("l o s e r", model["lm"]) == "loser"


@pytest.mark.parametrize("seen, meant", [("1d10t", "idiot"), ("l053r", "loser"), ("5tup1d", "stupid"), ("m0r0n", "moron"), ("st" + "u" * 60 + "pid", "stupid"), ("l" + "." * 50 + "o.s.e.r", "loser")])
def test_long_and_digit_rich_tokens_are_read(model, seen, meant):
    assert toxicity.disguised(f"you are {seen} , really")[-1] == seen
    assert toxicity.restore(seen, model["lm"]) == meant


def test_long_spaced_stretches_are_read_whole(model):
    """An insult beyond the first 80 characters of letters set apart."""
    plain = "you are nothing but a loser and you should know that you are an idiot"
    reader = toxicity.Reader(model["lm"], model["hashes"])
    for seen in ("   ".join(" ".join(w) for w in plain.split()), " ".join(plain.replace(" ", ""))):
        assert len(seen) > 80 and toxicity.disguised(seen)[0] == seen
        assert {*reader.features("loser")[1:3], *reader.features("idiot")[1:3]} <= reader.read(seen)
    many = "x y z w " * 50_000 + "l o s e r"
    assert len(toxicity.restore(many, model["lm"])) > 50_000


def test_numbers_are_left_alone():
    assert toxicity.disguised("in 1990 , 3.14 1,000,000 12-10-2024 +44 20 7946 0018") == []


def test_viterbi_equals_brute_force(model):
    """The reading has the least cost of all readings of the lattice, tried one by one."""
    import random
    from itertools import product

    lm, rng = model["lm"], random.Random(7)

    def cost(pieces, prices):
        a, b, total = 0, 0, sum(prices)
        for c in "".join(pieces) + " ":
            z = toxicity._class(c)
            total -= lm[a, b, z]
            a, b = b, z
        return total

    tokens = ["m0r0n", "tr@$h", "l.o-s", "5tup1d", "a b c", "1d!0t", "ssco$$"] + ["".join(rng.choice("ae0143@$.!lst ") for _ in range(rng.randint(3, 8))).strip() or "x1y" for _ in range(60)]
    for token in tokens:
        every = [list(zip(*path, strict=True)) for path in product(*toxicity._lattice(token))]
        best = min(cost(*x) for x in every)
        likeliest = {"".join(pieces).strip() for pieces, prices in every if cost(pieces, prices) <= best + 1e-3}
        assert toxicity.restore(token, lm) in likeliest


def test_disguise_does_not_help(data, model):
    docs, labels = data
    rows = toxicity.score(docs, model).join(labels, "doc_id")
    english = F.rlike(F.lower("text"), F.lit("idiot|moron|trash|loser|clown"))
    plain = rows.filter(english & (F.col("toxic") == 1))
    before = plain.filter("score >= 0.5").count()
    hidden = plain.select("doc_id", "toxic", F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "(?i)idiot", "1d!0t"), "(?i)moron", "m0r0n"), "(?i)trash", "tr@shhh"), "(?i)loser", "l.o.s.e.r").alias("text"))
    after = toxicity.score(hidden, model).filter("score >= 0.5").count()
    assert before >= 20 and after >= 0.9 * before


def test_held_out_accuracy(data):
    docs, labels = data
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    clean = [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in clean) == 0
    toxic = [r for r in held if r.toxic == 1]
    mean = lambda x: sum(r.score for r in x) / len(x)
    assert mean(toxic) > 5 * mean(clean)


def test_held_out_recall(spark):
    """Of the toxic documents whose labels are held out most are caught, and hardly a clean one; some labelled toxic hold no insult."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.classify(docs, labels).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("share"), F.count(F.lit(1)).alias("n")).collect()
    share = {r.toxic: (r.share, r.n) for r in held}
    print("held out: share predicted toxic", share)
    assert share[1][0] >= 0.85 and share[0][0] <= 0.01


def test_learning_ignores_held_out_labels(data):
    docs, labels = data
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_and_empty(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (6, None), (None, 1), (7, 0), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.classify(odd_docs, labels, support=1).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.score for r in toxicity.classify(odd_docs, labels.filter("false")).collect()} == {0.0}
    assert toxicity.classify(no_docs, labels).count() == 0
    kept = toxicity.reject(odd_docs, labels.filter("false"))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_disguise_at_either_end_and_inside(spark):
    """Signs before, inside and behind the letters are read; punctuation and numbers are left alone."""
    lm = toxicity.language_model(toxicity.count_trigrams(["the idiot and the worthless idiots were stupid idiot worthless " * 200]))
    for plain, forms in {"idiot": ("1diot", "id1ot", "idio7", "idi0t"), "worthless": ("worthles5", "w0rthless"), "stupid": ("5tupid", "stup1d")}.items():
        for form in forms:
            assert toxicity.disguised(f"so {form}, they say") == [form] and toxicity.restore(form, lm) == plain
    assert toxicity.disguised("a word! a wide (gap) 12 1999 3.5, end? yes page$$$ user1234") == []
    assert toxicity.disguised("a$$ and a55.") == ["a$$", "a55"]
