import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints():
    for text in ["", "A", "a b", "É b C d e f", "x y z", " \x0b\x1c a b c d", "q w e r t y " * 3000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text[:20]


def clustered(n, seed):
    rng = random.Random(seed)
    fps = []
    for _ in range(n // 10):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 25])):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
            if rng.random() < 0.3:
                centre = x
    return fps


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 9])
def test_links_connect_what_is_linked(spark, bucket):
    from lodestone.llm.components import components

    fps = sorted(set(clustered(600, 5)) | {0, 1, 7, 2**64 - 1})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    stars = {r.a: r.b for r in components(simhash.links(df, bucket)).collect()}
    got = [stars.get(simhash._signed(x), simhash._signed(x)) for x in fps]
    want = plain_components(range(len(fps)), fps)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_dense_bucket_gives_a_forest():
    fps = np.array(sorted({1 << i | 1 << j for i in range(40) for j in range(40)}), dtype=np.uint64)
    a, b = simhash.bucket_links(fps, simhash.pivot_table(fps))
    assert len(a) == len(fps) - 1
    assert (np.bitwise_count(fps[a] ^ fps[b]) <= 3).all()


def test_query_matches_brute_force(spark):
    from lodestone.llm.queries import op4_simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = op4_simhash(spark, sf).toPandas().set_index("doc_id")
    fps = [plain_fingerprint(t) for t in docs.text]
    want = plain_components(docs.doc_id.tolist(), fps)
    for d, f, c in zip(docs.doc_id, fps, want):
        assert (got.fingerprint[d], got.component_id[d]) == (f"{f:016x}", c)


def test_edges(spark):
    rows = [(4, None, 1), (3, "", 1), (None, "a b c d", 1), (9, "a b c d", 1), (9, "a b c d", 1), (None, "only one", 1), (1, "W" * 300000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.group(df).collect()), key=str)
    assert got == sorted([(4, 3), (3, 3), (None, 9), (9, 9), (9, 9), (None, None), (1, 1)], key=str)
    assert simhash.group(df.limit(0)).count() == 0


def test_pivot_columns_are_the_table(spark):
    fps = [0, 1, 2**63, 2**64 - 1, 0x123456789ABCDEF0]
    rows = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long").select("fp", *simhash.pivot_columns()).collect()
    got = np.array([[r.p0, r.p1] for r in rows]).view(np.int8)
    assert (got == simhash.pivot_table(np.array(fps, np.uint64))).all()
