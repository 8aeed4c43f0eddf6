import random
from collections import defaultdict

import pytest

from quern.llm import lines


def size_ok(text):
    held = [x for x in text if x.strip()]
    size = sum(len(x.encode()) + 1 for x in held)
    return len(held) >= lines.LEAST and size >= lines.LEAST_BYTES or size >= lines.TWO_BYTES


def brute(texts):
    """The ranges that go, by plain loops: (id, start, stop, first id)."""
    split = {i: (t or "").split("\n") for i, t in texts.items()}
    found = defaultdict(list)
    for i in sorted(texts):
        for _, _, a, b in lines.chunk_lines(texts[i]):
            found["\n".join(split[i][a:b])].append((i, a, b))
    runs = defaultdict(set)
    for owners in found.values():
        o, oa, ob = min(owners)
        for i, a, b in owners:
            if i != o:
                runs[i, o, a - oa] |= {(a, b)}
            elif a >= ob:
                runs[i, o, None] |= {(a, b)}
    gone = set()
    for (i, o, distance), spans in runs.items():
        joined = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        for a, b in joined:
            if distance is not None:
                up = down = 0
                while up < lines.REACH and min(a, a - distance) > 0 and split[i][a - 1] == split[o][a - distance - 1]:
                    a, up = a - 1, up + 1
                while down < lines.REACH and b < len(split[i]) and b - distance < len(split[o]) and split[i][b] == split[o][b - distance]:
                    b, down = b + 1, down + 1
            if size_ok(split[i][a:b]):
                gone.add((i, a, b, o))
    return gone


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute(texts)
    got = {(r.doc_id, r.start, r.stop, r.first_doc_id) for r in lines.repeated_chunks(docs).collect()}
    assert got == want and want
    gone = defaultdict(set)
    for i, a, b, _ in want:
        gone[i] |= set(range(a, b))
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items() if len(gone[i]) < len(t.split("\n"))}
    for small in (200_000, 0):
        assert {r.doc_id: r.text for r in lines.dedup_lines(docs, small=small).collect()} == left


def test_chunks_decide(spark, monkeypatch):
    """Without borders but a text's ends nothing inside different texts is found; with them it is."""
    shared = [f"shared line number {i} of a passage" for i in range(6)]
    docs = spark.createDataFrame([(k, "\n".join([f"own {k} {i}" for i in range(5)] + shared + [f"rest {k} {i}" for i in range(5)])) for k in range(3)], "doc_id long, text string")
    assert {(r.doc_id, r.start, r.stop) for r in lines.repeated_chunks(docs).collect()} == {(1, 5, 11), (2, 5, 11)}
    monkeypatch.setattr(lines, "SHARE", 0.0)
    assert lines.repeated_chunks(docs).count() == 0


def test_short_ends_stay(spark):
    """Two unrelated texts that share an ending of two short lines, or of three very short ones, keep it."""
    docs = spark.createDataFrame([(1, "int f\nint x\nalpha beta\n    return 0;\n}"), (2, "void g\nint y\ngamma delta\n    return 0;\n}"), (3, "a b c\nd\n}\n}\n}"), (4, "e f g\nh\n}\n}\n}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_inserted_lines_do_not_shift_chunks():
    text = [f"line number {i * i} of the text" for i in range(60)]
    plain = {d for d, *_ in lines.chunk_lines("\n".join(text))}
    moved = {d for d, *_ in lines.chunk_lines("\n".join(["new first line", *text]))}
    assert len(plain - moved) <= lines.LEVELS
    found = lines.chunk_lines("\n".join(text))
    assert all(b - a >= 2 for *_, a, b in found) and max(b - a for *_, a, b in found) > 3


def test_equal_digests_with_other_bytes_stay(spark, monkeypatch):
    """Texts whose chunks have one digest but other bytes are not touched, whether the second half of the hash tells them apart or the SHA-256."""
    text = lambda x: f"{x * 100}\n{x * 90}"
    docs = spark.createDataFrame([(1, text("a")), (2, text("c")), (3, text("a"))], "doc_id long, text string")
    for check in (lambda t: ord(t[0]), lambda t: 5):
        monkeypatch.setattr(lines, "chunk_lines", lambda t, check=check: [(7, check(t), 0, 2)] if t else [])
        assert [(r.doc_id, r.first_doc_id) for r in lines.repeated_chunks(docs).collect()] == [(3, 1)]


def test_odd_and_empty(odd_docs, no_docs):
    got = {(r.doc_id, r.first_doc_id) for r in lines.repeated_chunks(odd_docs).collect()}
    assert got == {(5, 1)}
    out = lines.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == odd_docs.count() - 2
    assert lines.dedup_lines(no_docs).count() == 0


def test_planted_passages_are_found_whole(spark):
    """Passages of 3 to 10 lines in documents that are otherwise different: the first stays, the second goes line for line; of two long lines likewise."""
    rng = random.Random(6)
    line = lambda n=6: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(n))
    rows, want, sizes = [], {}, {}
    for i in range(0, 540, 2):
        size = 2 + i // 2 % 9
        passage = [line(6 if size > 2 else 30) for _ in range(size)]
        if size > 3:
            passage[size // 2] = " "
        for k in (i, i + 1):
            before, after = [line() for _ in range(rng.randint(0, 12))], [line() for _ in range(rng.randint(1, 12))]
            rows.append((k, "\n".join(before + passage + after)))
            want[k] = "\n".join(before + after) if k % 2 else rows[-1][1]
            sizes[k] = size
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert all(got[k] == want[k] for k in range(0, 540, 2))
    for size in range(2, 11):
        of = [k for k in sizes if k % 2 and sizes[k] == size]
        whole = sum(got[k] == want[k] for k in of)
        print("passages removed whole, of", size, "lines:", whole, "of", len(of))
        assert whole >= (0.9 if size > 2 else 0.6) * len(of)


def test_many_lines_and_many_ranges(spark):
    """A document of many lines, every other passage of which goes, takes seconds."""
    import time

    text = [f"line {i} of the first" for i in range(60_000)]
    mixed = [x for i in range(0, 60_000, 8) for x in (*text[i : i + 7], f"own {i}")]
    docs = spark.createDataFrame([(1, "\n".join(text)), (2, "\n".join(mixed))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    left = got[2].split("\n")
    assert got[1] == "\n".join(text) and len(left) < 1.02 * 7500 and {f"own {i}" for i in range(0, 60_000, 8)} <= set(left) and time.time() - began < 120


def test_repeated_line_keeps_one_pair(spark):
    x, z = "x" * 40, "z" * 40
    rows = [(1, "\n".join([x] * 6 + ["y"])), (2, "\n".join(["a", x, x, x, "b"])), (3, "\n".join([z] * 3 + ["v"])), (4, "\n".join(["w", z, z, z]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()) == [(1, f"{x}\n{x}\ny"), (2, "a\nb"), (3, rows[2][1]), (4, "w")]
