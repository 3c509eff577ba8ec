"""What only larger or odder tables show."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import ivf
from lodestone.operators.fulltext import FullText


def test_more_queries_in_a_batch_than_a_slice_holds(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(600, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    index = ivf.build(vectors, f"{tmp_path}/ivf", 4)
    live = ivf.LiveIndex(spark, f"file://{tmp_path}/live")
    live.create(vectors, 4)
    queries = vectors.select(F.col("vec_id").alias("query"), "embedding")
    for found in (ivf.topk(spark, index, queries, 1, probes=1), live.topk(queries, 1, probes=1)):
        assert sorted((r.query, r.vec_id) for r in found.collect()) == [(i, i) for i in range(600)]


def against_sql(spark, path, name, **tables):
    """The query and its SQL over tables written under path: what one has and the other hasn't."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    found = catalog.QUERIES[name](spark, str(path))
    got = sorted(map(repr, (tuple(r) for r in found.collect())))
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES[name]})").fetchall()))
    return [x for x in got if x not in want], [x for x in want if x not in got]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_titles_of_texts_without_ascii_letters(spark, tmp_path):
    texts = ["", "é à è.", "123", "Éà b", "été", "  ", "Subject: é", "é"]
    rows = [(i, t, "fr", "src1", len(t)) for i, t in enumerate(texts)]
    assert against_sql(spark, tmp_path, "intake_titles", documents=spark.createDataFrame(rows, DOCUMENTS)) == ([], [])


def test_a_term_has_a_row_for_a_range_through_merges(spark, tmp_path):
    index = FullText(spark, f"file://{tmp_path}/index", width=8)
    frame = lambda first, n: spark.createDataFrame([(f"p{k:03}", 0, "the of " + "w " * (k % 7)) for k in range(first, first + n)], "path string, chunk int, text string").coalesce(1)
    index.append(frame(0, 40))
    index.append(frame(40, 40))
    index.delete(frame(0, 8).select("path"))
    index.merge()
    index.append(frame(100, 24))
    index.merge()
    rows = spark.read.parquet(f"{index.home}/segments/{index.current().segments[0]}/postings")
    assert {r["term"]: (r["rows"], r["n"]) for r in rows.groupBy("term").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()} == {"the": (12, 96), "of": (12, 96), "w": (12, 83)}
    fresh = FullText(spark, f"file://{tmp_path}/fresh", width=8)
    fresh.append(frame(8, 72).unionByName(frame(100, 24)))
    assert index.best("the w", 30).collect() == fresh.best("the w", 30).collect()


def test_postings_are_written_where_their_chunks_are_read_and_merged_exactly(spark, tmp_path):
    index = FullText(spark, f"file://{tmp_path}/index", width=4)
    text = lambda k: "" if k == 5 else "the " * (1 + k % 5) + f"w{k % 3} " * (k % 7)
    frame = lambda keys: spark.createDataFrame([(f"p{k:03}", 0, text(k)) for k in keys], "path string, chunk int, text string").coalesce(1)
    index.append(frame(range(20)))
    index.append(frame(range(20, 50)))
    index.append(frame([5]))  # no words
    assert not (tmp_path / "index" / "drafts").exists()  # what's read is written once
    gone = {0, 1, 2, 3, 9, 21, 26}  # a whole range, and parts
    index.delete(spark.createDataFrame([(f"p{k:03}",) for k in gone], "path string"))
    index.merge()
    rows = spark.read.parquet(f"{index.home}/segments/{index.current().segments[0]}/postings").collect()
    want = {}
    for k in range(50):
        for word in {} if k in gone else set(text(k).split()):
            want.setdefault((word, k // 4), []).append((k % 4, text(k).split().count(word), len(text(k).split())))
    got = {(r.term, r.range): sorted(map(tuple, np.frombuffer(r.held, "<i4").reshape(-1, 3).tolist())) for r in rows}
    assert got == {key: sorted(held) for key, held in want.items()}
    for r in rows:
        held = want[r.term, r.range]
        assert (r.n, r.max_tf, r.min_size) == (len(held), max(h[1] for h in held), min(h[2] for h in held))


def test_files_of_a_few_roots_are_not_dealt_by_root(spark):
    """Four roots would bring all texts to four tasks."""
    plan = catalog.QUERIES["docs_meta"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "hashpartitioning(root" not in plan


def test_words_of_ids_that_repeat(spark, tmp_path):
    rows = [(1, "a a b", "en", "s", 5), (1, "a c", "en", "s", 3), (2, "a b b", "en", "s", 5), (None, "a", "en", "s", 1), (3, None, "en", "s", 0), (4, "...", "en", "s", 3), (5, "x " * 5000, "en", "s", 10000)]
    for k, some in (("all", rows), ("null", rows[1:]), ("single", rows[1:3] + rows[4:])):
        assert against_sql(spark, tmp_path / k, "postings", documents=spark.createDataFrame(some, DOCUMENTS)) == ([], [])
    plan = catalog.QUERIES["postings"](spark, f"{tmp_path}/single")._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" not in "".join(line for line in plan.splitlines() if "Exchange" in line)  # words are counted in their document


def test_parts_of_a_stream_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from lodestone.plans import intake_queries

    monkeypatch.setattr(intake_queries, "FILE_ROWS", 500)
    events = spark.range(9000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 601).cast("timestamp_ntz").alias("ts"), (F.col("id") * 7 % 130).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
        F.lit("{}").alias("props"),
    )
    homes, asked = [], intake_queries._in_parts
    monkeypatch.setattr(intake_queries, "_in_parts", lambda *a: homes.append(a[3]) or asked(*a))
    assert against_sql(spark, tmp_path, "stream_ready", events=events) == ([], [])
    files = [r[0] for r in spark.read.option("recursiveFileLookup", "true").parquet(homes[0]).select(F.input_file_name()).distinct().collect()]
    assert sorted(f.split("/")[-2] for f in files) == [f"part-{k}" for k in range(4) for _ in range(4)]


def test_partial_fingerprints_are_simhashes_of_the_least_hashes():
    from lodestone.llm import wide

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40, 500):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        want = []
        for band in range(wide.BANDS):
            some = [h for h in hashes.tolist() if h >> 60 == band][: wide.LEAST]
            mixed = wide._mixed(np.array(some, np.uint64)).tolist()
            if some:
                want.append(band << 59 | sum((2 * sum(m >> bit & 1 for m in mixed) > len(some)) << bit for bit in range(64)) >> 5)
        assert wide.partial_keys(hashes) == want
    assert wide.partial_keys(np.empty(0, np.uint64)) == [0]


def test_chains_of_repeats_take_a_round_for_each_block(spark, monkeypatch):
    from lodestone.operators import repeats
    from tests.test_intake_tables import folded, repeated

    tables, write = [], repeats.materialised
    monkeypatch.setattr(repeats, "materialised", lambda df, label: tables.append(label) or write(df, label))
    chain = [("c", f"{k:04}", f"s{k // 2}", f"m{(k + 1) // 2}", None) for k in range(400)]
    got = repeated(spark, chain, rounds=10**6)
    assert got == folded(chain) and [r[2] for r in got] == [k % 2 == 0 for k in range(400)]
    assert tables.count("judged") <= 3  # rows come from three tasks of one partition each; 200 rounds when each settled two files
    rng = np.random.default_rng(7)
    pick = lambda kind, n: None if rng.random() < 0.3 else f"{kind}{rng.integers(n)}"
    rows = [(f"b{rng.integers(2)}", f"{k:04}", pick("s", 90), pick("m", 90), pick("f", 60)) for k in range(200)] + [("b0", f"{k:04}x", "hot", None, "hot") for k in range(0, 200, 3)]
    monkeypatch.setattr(repeats, "BLOCK", 7)
    assert repeated(spark, rows, rounds=10**6) == folded(rows)
