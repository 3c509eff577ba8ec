import zlib
from collections import Counter

from lodestone.llm import sharding


def test_query_is_balanced_and_gapless(spark):
    from lodestone.llm.queries import op6_sharding

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")["text"]
    got = op6_sharding(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs.index)
    for r in got.itertuples():
        raw = docs[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    assert got.law.eq("bytes").all() and got.grown_shard.isna().all()
    sizes = got.groupby("shard")["size"].sum()
    assert sorted(sizes.index) == list(range(16)) and sizes.max() - sizes.min() <= 0.02 * sizes.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "é" * 50000, 3), (3, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard(df, 4).collect()
    assert len(got) == 5 and Counter(r.size for r in got) == {1: 4, 100001: 1}
    assert sharding.shard(df.limit(0), 4).count() == 0


def test_map_versions(spark, tmp_path):
    sums = {i: (1000 + 37 * i % 400, 1) for i in range(sharding.SLOTS)}
    old = sharding.first_map(sums, 16)
    grown = sharding.rebalanced(old, sums, 17)
    moved = {s for s in old if old[s] != grown[s]}
    assert moved and all(grown[s] == 16 for s in moved)
    load = Counter()
    for s, shard in grown.items():
        load[shard] += sums[s][0]
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 17
    shrunk = sharding.rebalanced(grown, sums, 16)
    assert set(shrunk.values()) == set(range(16))
    assert all(shrunk[s] == grown[s] for s in grown if grown[s] < 16)
    sharding.write_map(spark, str(tmp_path), 1, old, sums)
    sharding.write_map(spark, str(tmp_path), 2, grown, sums)
    assert {r.vslot: r.shard for r in sharding.read_map(spark, str(tmp_path), 1).collect()} == old
    assert {r.vslot: r.shard for r in sharding.read_map(spark, str(tmp_path), 2).collect()} == grown


def test_a_stored_map_is_edited_and_read_again(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = docs.where("doc_id < 300").selectExpr("doc_id + 100000 AS doc_id", "text")
    path = str(tmp_path)
    first = {r.doc_id: r for r in sharding.shard(docs, 16, path=path).collect()}
    assert sharding.newest(spark, path) == 1
    again = {r.doc_id: r.shard for r in sharding.shard(docs.union(more), 16, path=path).collect()}
    assert sharding.newest(spark, path) == 1 and all(again[d] == r.shard for d, r in first.items())
    grown = {r.doc_id: r for r in sharding.rebalance(docs.union(more), path, 17).collect()}
    assert sharding.newest(spark, path) == 2
    before, after = ({r.vslot: r.shard for r in sharding.read_map(spark, path, v).collect()} for v in (1, 2))
    moved = {s for s in before if before[s] != after[s]}
    assert moved and len(moved) < sharding.SLOTS / 2
    for d, r in grown.items():
        assert r.shard == after[r.vslot] and (r.vslot in moved) == (r.shard != again[d])
    sizes = Counter()
    for r in grown.values():
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 17
    for shard in range(17):
        slots = sorted(r.slot for r in grown.values() if r.shard == shard)
        assert slots == list(range(len(slots)))
    old = {r.doc_id: r.shard for r in sharding.shard(docs, path=path, version=1).collect()}
    assert old == {d: r.shard for d, r in first.items()}


def test_one_slot_that_holds_most_rows(spark):
    df = spark.range(0, 3000).selectExpr("if(id % 3 = 0, id, 7) AS doc_id", "if(id % 3 = 0, string(id), 'same') AS text")
    got = sharding.shard(df, 4).collect()
    assert len(got) == 3000
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
