import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash, wide

MASK = 2**64 - 1


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([" ".join(words)] if words else [])
    return sorted({xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs})


def plain_bits(hashes):
    def mixed(x):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
        x = (x ^ x >> 29) * 0x9FB21C651E98DF25 & MASK
        return x ^ x >> 32

    lanes = np.array([[mixed((h + k * 0xA24BAED4963EE407) & MASK) for k in range(1, wide.LANES + 1)] for h in hashes], np.uint64).reshape(len(hashes), wide.LANES)
    bits = (lanes[:, :, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(axis=0)
    return (2 * bits > len(hashes)).ravel()


def plain_components(ids, texts):
    """The smallest id that links reach: all pairs, by the Jaccard similarity of their sets of shingles."""
    sets = [set(plain_set(t)) for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) >= 0.8 * both - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprints():
    for text in ["", "A b", "a b c d e f g", "q w e r t y u i o p " * 700, " ".join(map(str, range(9000)))]:
        hashes = plain_set(text)
        assert wide.shingle_hashes(text, 5).tolist() == hashes
        got = np.frombuffer(wide.majority(np.array(hashes, np.uint64)), "<u8")
        assert [int(x) >> b & 1 for x in got for b in range(64)] == plain_bits(hashes).astype(int).tolist()


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.random()}"
    return out


def test_links_follow_the_similarity(spark):
    """Ten words in 300 changed leave at least 0.7; two leave 0.93 or more."""
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(40):
        words = [f"w{g}-{rng.randrange(900)}" for _ in range(300)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(edited(rng, words, 2))), (10 * g + 2, " ".join(edited(rng, words, 25)))]
        want |= {10 * g: 10 * g, 10 * g + 1: 10 * g, 10 * g + 2: 10 * g + 2}
    found = wide.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["__id"]: r["first"]["id"] for r in found} == want


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rng = random.Random(1)
    rows += [(10_000 + i, " ".join(edited(rng, t.split(), max(1, len(t.split()) // 40)))) for i, t in rows[:60] if t and t.split()]
    want = plain_components([i for i, _ in rows], [t for _, t in rows])
    for block in (wide.BLOCK, 3):
        got = {r["__id"]: r["first"]["id"] for r in wide.groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
        assert [got[i] for i, _ in rows] == want
    assert len(set(want)) < len(want) - 20


def test_rows_that_share_an_id_are_told_apart(spark):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(1, base), (5, base + " more"), (5, "something else altogether that nobody copied")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[0], rows[2]])


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(3000))
    rows = [(4, None, 1), (3, "", 2), (None, "a b c d", 3), (9, "a b  C d", 4), (9, "a b  C d", 4), (None, "only one", 5), (7, base, 6), (2, base + " z", 7), (8, "ab " * 200_000, 8)]
    for names in (["doc_id", "text", "x"], ["th", "fp", "n"], ["node", "key", "first"], ["__id", "__text", "__root"]):
        df = spark.createDataFrame(rows, f"`{names[0]}` long, `{names[1]}` string, `{names[2]}` int")
        kept = simhash.drop_near_duplicates(df, names[0], names[1])
        assert kept.dtypes == df.dtypes
        assert sorted(r[2] for r in kept.collect()) == [2, 4, 4, 5, 7, 8]
        assert simhash.drop_near_duplicates(df.limit(0), names[0], names[1]).count() == 0


def test_pairs_around_the_bar_are_decided_exactly(spark):
    """Pairs of 0.74 to 0.86, of which the estimate alone decides many wrongly."""
    rng = random.Random(9)
    rows, want = [], {}
    for g in range(150):
        words = [f"w{g}-{k}" for k in range(400)]
        near = edited(rng, words, rng.randint(6, 12))
        a, b = set(plain_set(" ".join(words))), set(plain_set(" ".join(near)))
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(near))]
        want |= {10 * g: 10 * g, 10 * g + 1: 10 * g if len(a & b) >= 0.8 * len(a | b) else 10 * g + 1}
    found = {r["__id"]: r["first"]["id"] for r in wide.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [k for k in want if found[k] != want[k]]
    assert all(found[k] == k for k in wrong) and len(wrong) <= 1  # that two of 0.8 never meet has a chance of 2 in 1000
    assert 20 < sum(want[k] == k for k in want if k % 10) < 130


def test_all_pairs_of_a_table_by_true_similarity(spark):
    """Recall over whole sf0.01 documents: every pair at 0.8 or more, by an index of rare shingles that misses none."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: set(plain_set(r.text)) for r in rows}
    order = {h: k for k, (_, h) in enumerate(sorted((n, h) for h, n in __import__("collections").Counter(h for s in sets.values() for h in s).items()))}
    held, pairs = {}, set()
    for d, s in sets.items():
        rare = sorted(s, key=order.__getitem__)[: len(s) - -(-len(s) * 4 // 5) + 1]  # of two sets at 0.8 these prefixes meet
        for h in rare:
            for e in held.setdefault(h, []):
                if (d, e) not in pairs and len(s & sets[e]) >= 0.8 * len(s | sets[e]) - 1e-9:
                    pairs.add((d, e))
            held[h].append(d)
    found = {r["__id"]: r["first"]["id"] for r in wide.groups(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")).collect()}
    assert len(pairs) > 50 and sum(found[d] == found[e] for d, e in pairs) >= 0.98 * len(pairs)


def test_a_large_bucket_is_read_in_blocks():
    """40,000 members of one key, all alike: one link each, and no more than a block of them is compared at a time."""
    import pyarrow as pa

    hashes = np.arange(50, dtype=np.uint64)
    fp, own = wide.majority(hashes), wide.short_set(hashes).tobytes()
    for block, size in ((5000, wide.BYTES), (wide.BLOCK, 5000 * len(own))):
        batches = (
            pa.RecordBatch.from_arrays([pa.array([7] * 1000), pa.array(range(1000 * k, 1000 * k + 1000)), pa.array([fp] * 1000), pa.array([own] * 1000)], ["key", "node", "fp", "shingles"])
            for k in range(40)
        )
        seen = [b for b in wide._links(0.8, block, size)(batches)]
        assert max(b.num_rows for b in seen) <= 5000
        a, b = (np.concatenate([x.column(k).to_numpy() for x in seen]) for k in range(2))
        assert set(a.tolist()) == {0} and sorted(b.tolist()) == list(range(1, 40_000))


@pytest.mark.parametrize("bucket", [100, 16_384])
def test_an_oversize_bucket_is_named_and_not_held(bucket):
    """200,000 members of one bucket between two small ones."""
    import tracemalloc

    import pyarrow as pa

    def batch(key, fps):
        table = np.ascontiguousarray(simhash.pivot_table(np.array(fps, np.uint64))).view(np.int64)
        one = lambda x, t: pa.array(np.full(len(fps), x), t)
        return pa.RecordBatch.from_arrays([one(0, pa.int32()), one(0, pa.int32()), one(key, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(table[:, 0]), pa.array(table[:, 1])], ["c", "s", "key", "fp", "p0", "p1"])

    def stream():
        yield batch(1, [8, 9])
        for k in range(200):
            yield batch(2, range(1000 * k, 1000 * k + 1000))
        yield batch(3, [64, 65])

    tracemalloc.start()
    rows = [r for b in simhash._links(bucket)(stream()) for r in b.to_pylist()]
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
    assert [r["a"] for r in rows if r["c"] >= 0] == [2]
    assert sorted(sorted((r["a"], r["b"])) for r in rows if r["c"] < 0) == [[8, 9], [64, 65]]
