import random
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat


def best_path(seen):
    """By trying every path."""
    score = lambda path: chat.MOVE[chat.START, path[0]] + sum(chat.MOVE[a, b] for a, b in zip(path, path[1:])) + sum(chat.SHOWN[c, s] for c, s in zip(seen, path))
    return max(product(range(chat.STATES), repeat=len(seen)), key=score)


def test_viterbi_is_the_best_path():
    rng = random.Random(1)
    for _ in range(25):
        seen = [rng.randrange(40) for _ in range(rng.randint(1, 5))]
        assert chat.viterbi(seen) == list(best_path(seen))


def test_segments_decode_like_the_whole():
    rng = random.Random(2)
    for _ in range(40):
        parts = [[rng.randrange(40) for _ in range(rng.choice([0, 1, 3, 8]))] for _ in range(6)]
        ends = chat.chain([chat.span_scores(p) if p else None for p in parts])
        pieced = [s for p, (before, last) in zip(parts, ends) for s in chat.viterbi(p, before, last)]
        assert pieced == chat.viterbi([c for p in parts for c in p])


@pytest.mark.parametrize(
    ("line", "role"),
    [("User: hi", 1), ("### Human: hi", 1), ("<|assistant|> ok", 2), ("**Bot**: ok", 2), ("[system] be kind", 0), ("Q: why?", 1), ("A - so", 2), ("human nature is odd", 3), ("Anna: hello", 4), ("a cat sat", 3)],
)
def test_markers(line, role):
    assert chat.marker(line)[0] == role


def test_roles_of_a_transcript():
    text = "System: Be brief.\nUser: What is it?\nAssistant: A boat.\nIt is red: a fine one.\n\nand old\n\nIs it far?\n\nAssistant: No."
    got = [(r[2], r[4]) for r in chat.stretches([text])]
    assert got == [("system", "Be brief."), ("user", "What is it?"), ("assistant", "A boat.\nIt is red: a fine one.\n\nand old"), ("user", "Is it far?"), ("assistant", "No.")]


def turns_of(rows):
    """(role, text) of each turn of the canonical transcripts that the rows' rendered columns make."""
    whole = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn, r.part)):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.rendered
    squeezed = lambda t: "\n".join(x for x in t.split("\n") if x)
    parsed = {c: re.findall(r"<\|(system|user|assistant)\|>\n(.*?)(?:\n<\|end\|>\n|\Z)", t, re.S) for c, t in whole.items()}
    return {c: [(role, squeezed(text)) for role, text in turns] for c, turns in parsed.items()}


def test_query_recovers_turns_and_roles(spark):
    from lodestone.llm import queries

    sf = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    texts = queries.transcripts(given).collect()
    assert max(sum(x.startswith(("User: ", "### ", "<|", "Q: ", "A: ", "Assistant: ", "System: ")) for x in r.text.split("\n")) for r in texts) == 3
    rows = queries.op2_chat(spark, sf).collect()
    found = turns_of(rows)
    right = alone = unmarked = total = 0
    for r in queries.marked_turns(given).collect():
        want = (r.role, "\n".join(x for x in r.said.split("\n") if x))
        hit = want in found[r.conv_id]
        total, right = total + 1, right + hit
        if r.line.lstrip("\n") == r.said:
            alone, unmarked = alone + 1, unmarked + hit
    assert right > 0.93 * total and alone > 20 and unmarked > 0.6 * alone
    assert any(r.part > 1 for r in rows) and any(not r.begins for r in rows)


def test_the_fitted_model_reads_held_out_transcripts():
    good = total = 0
    for turns in chat.labelled_transcripts(300, seed=12):
        got = [chat.ROLES.index(r[2]) for r in chat.stretches(["\n".join(text for _, text in turns)]) if r[3]]
        good += got == [role for role, _ in turns]
        total += 1
    assert good > 0.75 * total


def test_segments_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_BYTES", 3000)
    rows = [(1, 0, f"User: number {i}") for i in range(500)] + [(1, None, f"A: {i} " + "x" * 200) for i in range(100)] + [(2, i, "Q: " + "y" * 900) for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    sizes = chat._segments(df.select(F.col("conv_id").alias("__id"), F.col("turn").alias("__pos"), F.xxhash64("text").alias("__order"), F.octet_length("text").cast("long").alias("size")), 64)
    held = sizes.groupBy("__id", "seg").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    assert max(r.n for r in held) < 2 * 64 and max(r.b for r in held) < 3000 * 3 and len(held) > 25
    key = lambda r: (r.conv_id, -1 if r.turn is None else r.turn, r.part, r.text, r.rendered)
    assert sorted(chat.format_turns(df, segment=64).collect(), key=key) == sorted(chat.format_turns(df, segment=10**6).collect(), key=key)


def test_long_transcript_in_segments_and_edges(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["User: a?", "Assistant: b\nand more", "", None, "User: x\n\nlower\nA: z"])) for i in range(200)]
    rows += [(None, 0, "User: one"), (2, None, "User: first"), (2, 5, "A: second"), (2, 5, "A: second"), (3, 0, None), (4, -3, "hello " * 50000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, text string, role string")
    key = lambda r: (str(r.conv_id), -1 if r.turn is None else r.turn, r.part, r.text, r.rendered)
    whole = sorted(chat.format_turns(df).collect(), key=key)
    assert whole == sorted(chat.format_turns(df, segment=7).collect(), key=key)
    plain = chat.stretches([r[2] for r in rows[:200]])
    assert [(r.role, r.begins, r.text) for r in whole if r.conv_id == 1] == [p[2:] for p in plain]
    assert chat.format_turns(df.limit(0)).count() == 0
