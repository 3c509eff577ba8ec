import hashlib
import random
import zlib

import pytest

from lodestone.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows: (conv, turn, role, text). Every prefix of every rebuilt conversation, by looking at all of them."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    rebuilt = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt[conv] = tuple(x[2:] for x in sorted(turns.get(conv - conv % 5, []))[:h] + sorted(own)[h:])
    members = {}
    for conv, said in rebuilt.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(conv)
    children = {}
    for said in members:
        if said:
            children.setdefault(said[:-1], []).append(said)
    leaves, saved = {}, {}
    for said in sorted(members, key=len, reverse=True):
        below = children.get(said, [])
        leaves[said] = sum(leaves[x] for x in below) if below else 1
        saved[said] = sum(saved[x] for x in below) + ((len(members[said]) - 1) * len(said[-1][1].encode()) if said else 0)
    out = []
    for said, convs in members.items():
        ends = sorted(c for c in convs if rebuilt[c] == said)
        out.append((
            min(convs), len(said), min(members[said[:-1]]) if said else None, len(convs), len(children.get(said, [])), leaves[said], saved[said],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    shared = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long text"])) for _ in range(most)] for _ in range(4)]
    rows = []
    for conv in rng.sample(range(3 * convs), convs):
        said, n = list(rng.choice(shared)), rng.randint(1, most)
        for k in range(n):
            if rng.random() < 0.05:
                said[k] = ("user", rng.choice("xyz"))
            rows.append((conv, rng.choice([None, 0, k, k, k, k, k]) if rng.random() < 0.3 else k, *said[k]))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limits", [{}, {"rows": 0, "block": 4}, {"rows": 20, "block": 4}, {"size": 40, "block": 3}])
def test_random_conversations(spark, limits):
    """Held families, families in blocks, and both, meet in the same trie."""
    rows = random_rows(1, 60, 14)
    assert got(trie.build(spark.createDataFrame(rows, SCHEMA), **limits)) == brute(rows)


def test_paths_that_hang_on_paths(spark):
    """Each conversation leaves the one before it a turn later, so paths are nested as deep as they are long."""
    rows = [(5 * c, k, "user", "s" if k < c else f"{c}") for c in range(25) for k in range(26)]
    assert got(trie.build(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_copies_hot_first_turn_and_many_ids(spark):
    rows = [(c, k, "user", "same" if k == 0 or c % 3 else f"{c}") for c in range(0, 2500, 1) for k in range(1 + c % 3)]
    assert got(trie.build(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_edges(spark):
    rows = [
        (None, 0, "user", "no id"), (7, None, None, None), (7, None, None, None), (7, 0, "user", "x" * 300_000), (7, 0, "user", "x" * 300_000), (-3, 1, "a", "b"),
        (5, 0, "user", "base"), (10**15, 2, "user", "é"), (3, 0, "us", "erx"), (4, 0, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "clash", b"") for r in rows], SCHEMA + ", base string, digest binary")
    rows = [(c if c is None or c >= 0 else c, *r) for c, *r in rows]
    want = brute([r for r in rows if r[0] is None or r[0] >= 0])
    assert got(trie.build(df.where("conv_id is null or conv_id >= 0"))) == want
    assert trie.build(df.limit(0)).count() == 0
    assert trie.build(df.where("conv_id is null")).count() == 0
    assert sum(r.n_convs for r in trie.build(df).where("depth = 0").collect()) == 6


def test_query(spark):
    from lodestone.llm.queries import op13_prefix_trie

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op13_prefix_trie(spark, sf)) == brute(rows)
