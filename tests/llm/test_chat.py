import random
import re

from quern.llm import chat


def test_every_speaker_gets_the_dialogue(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    source = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        source.setdefault(r.conv_id, []).append((r.role, r.text))
    rows = chat.rotate_perspectives(turns).collect()
    assert {(r.conv_id, r.speaker) for r in rows} == {(c, role) for c, t in source.items() for role, _ in t if role != "system"}
    for r in rows:
        heads = re.findall(r"<\|im_start\|>(.*)\n", r.text)
        assert heads == ["system" if role == "system" else "assistant" if role == r.speaker else f"user name={role}" for role, _ in source[r.conv_id]]
        spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",")] if r["mask"] else []
        assert [r.text[a:b] for a, b in spans] == [t + "<|im_end|>" for role, t in source[r.conv_id] if role == r.speaker]
        assert (r.n_turns, r.n_own) == (len(source[r.conv_id]), len(spans))


def whole(rows):
    """Each (dialogue, speaker)'s text and mask, its parts put together."""
    out = {}
    for r in sorted(rows, key=lambda r: r.part):
        text, mask = out.get((r.conv_id, r.speaker), ("", []))
        assert len(text) == r.start
        out[r.conv_id, r.speaker] = (text + r.text, mask + [tuple(map(int, s.split(":"))) for s in r["mask"].split(",") if s])
    return out


def test_parts_make_the_whole(spark):
    """Long dialogues, and turn numbers that many turns share, in small parts and in large ones."""
    rng = random.Random(6)
    rows = [(c, rng.choice([None, -3, *range(90), *[7] * 60]), rng.choice(["ann", "bob", "system", "cy"]), "é" * rng.randint(0, 5) + str(i)) for c in (1, 2) for i in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    large = chat.rotate_perspectives(turns).collect()
    small = chat.rotate_perspectives(turns, part_turns=10, crowd=16).collect()
    assert max(r.n_turns for r in small) < 60 and max(r.part for r in small) > 15
    assert whole(small) == whole(large)
    for (conv, speaker), (text, mask) in whole(small).items():
        mine = sorted(t + "<|im_end|>" for c, _, role, t in set(rows) if c == conv and role == speaker)
        assert sorted(text[a:b] for a, b in mask) == mine
        assert text.count("<|im_start|>") == sum(c == conv for c, *_ in set(rows))


def test_odd_and_empty(spark):
    rows = [(1, 0, "ann", "hi"), (1, 0, "ann", "hi"), (1, 1, "bob", None), (1, None, " ", "<|im_start|>x"), (2, 0, "system", "only"), (None, 0, "ann", "no id"), (1, 2000, "cy", "late")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as part", "'y' as speaker", "1 as lines", "2 as piece", "3 as tie", "4 as start")
    found = chat.rotate_perspectives(turns).collect()
    got = {(r.conv_id, r.part, r.speaker): r for r in found}
    assert set(got) == {(1, p, s) for p in (0, 1, 2) for s in ("ann", "bob", "unknown", "cy")} | {(None, 0, "ann")}
    assert whole(found)[1, "unknown"][0].startswith("<|im_start|>assistant\n< |im_start|>x<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n")
    assert got[1, 2, "ann"]["mask"] == "" and got[1, 2, "cy"].n_own == 1
    assert chat.rotate_perspectives(turns.filter("false")).count() == 0
