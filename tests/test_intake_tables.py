"""Repeats in order, isolated rows, fates of files, stored versions and keyed stream state."""

import json
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import fate, isolate, repeats
from lodestone.sources import versions
from lodestone.streaming import open_entries as S

FILES = "batch string, name string, sha string, mid string, fp string"


def folded(rows):
    """In order of name, one after the other."""
    out, held = [], {}
    for batch, name, sha, mid, fp in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", *[(x is not None, x or "") for x in r[1:]])):
        mid, fp, sha = mid or None, fp or None, sha or None
        kept = held.setdefault(batch, [])
        hits = [[k for k in kept if mid and k[2] == mid], [k for k in kept if sha and k[1] == sha], [k for k in kept if fp and k[3] == fp and not (mid and k[2])]]
        hit = next((h[0] for h in hits if h), None)
        out.append((batch, name, hit is None, hit and hit[0]))
        if hit is None:
            kept.append((name, sha, mid, fp))
    return sorted(out, key=repr)


def repeated(spark, rows, **limits):
    got = repeats.batch_duplicates(spark.createDataFrame(rows, FILES).repartition(3), **limits).collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("limits", [{}, {"rounds": 1, "rest": 1000}, {"rounds": 0, "rest": 1000}, {"rounds": 2, "rest": 0}])
def test_repeats_are_the_fold(spark, limits):
    rng = random.Random(4)
    pick = lambda kind, n: rng.choice([None, "", *[f"{kind}{k}" for k in range(n)]])
    rows = [(rng.choice([None, "a", "b"]), f"n{k:03}", f"s{rng.randint(0, 60)}", pick("m", 30), pick("f", 20)) for k in range(150)]
    assert repeated(spark, rows, **limits) == folded(rows)


def test_chains_ties_and_hot_keys(spark):
    chain = [("c", f"{k:03}", f"s{k // 2}", f"m{(k + 1) // 2}", None) for k in range(40)]
    hot = [("h", f"{k:03}", "same" if k % 3 == 0 else f"s{k}", None if k % 5 == 0 else f"m{k}", "same") for k in range(60)]
    ties = [("t", "x", "s1", None, None)] * 3 + [("t", "x", "s0", "m", None), ("t", None, "s1", None, None)]
    got = repeated(spark, chain + hot + ties, rounds=3)
    assert got == folded(chain + hot + ties)
    assert [r[2] for r in got if r[0] == "c"] == [k % 2 == 0 for k in range(40)]
    assert repeats.batch_duplicates(spark.createDataFrame([], FILES)).count() == 0


def test_a_fingerprint_counts_only_without_a_message_id(spark):
    rows = [("a", "1", "s1", "m1", "f"), ("a", "2", "s2", "m2", "f"), ("a", "3", "s3", None, "f"), ("b", "1", "s1", None, "f"), ("b", "2", "s2", "m2", "f")]
    assert [(r[0], r[1], r[3]) for r in repeated(spark, rows)] == [("a", "1", None), ("a", "2", None), ("a", "3", "1"), ("b", "1", None), ("b", "2", "1")]


# ---------------------------------------------------------------- isolation


def test_bisection_tries_few_slices():
    calls = []

    def work(batch):
        calls.append(batch.num_rows)
        return pa.RecordBatch.from_arrays([pa.array([1 // x.as_py() for x in batch.column(0)])], ["y"])

    rows = pa.RecordBatch.from_arrays([pa.array([1] * 500 + [0] + [1] * 523)], ["x"])
    found = list(isolate.bisected(rows, work))
    assert sum(r.num_rows for r, *_ in found) == 1024 and [e for *_, e, _ in found if e] == ["ZeroDivisionError: integer division or modulo by zero"]
    assert len(calls) == 21  # the whole, then both halves of ten that fail


def test_bad_rows_are_set_aside_and_good_ones_come_through(spark):
    def work(batch):
        return pa.RecordBatch.from_arrays([pa.array([json.loads(x)["v"] for x in batch.column("s").to_pylist()], pa.string()), pa.array([len(x) for x in batch.column("s").to_pylist()], pa.int32())], ["v", "size"])

    rows = [(k, None if k == 7 else "" if k == 8 else "{}" if k == 9 else json.dumps({"v": None if k == 10 else f"é{k}"})) for k in range(60)] + [(7, None)]
    done = isolate.isolated(spark.createDataFrame(rows, "error long, s string").repartition(2), work, "v string, size int", width=16)
    good = {r.row.error: (r.v, r["size"]) for r in done.good.collect()}
    assert good == {k: (None if k == 10 else f"é{k}", len(rows[k][1])) for k in range(60) if k not in (7, 8, 9)}
    assert sorted((r.row.error, r.error.split(":")[0], r.calls <= 5) for r in done.dead.collect()) == [(7, "TypeError", True), (7, "TypeError", True), (8, "JSONDecodeError", True), (9, "KeyError", True)]
    none = isolate.isolated(spark.createDataFrame([], "error long, s string"), work, "v string, size int")
    assert none.good.count() == none.dead.count() == 0


def test_work_that_loses_rows_is_a_failure(spark):
    done = isolate.isolated(spark.range(5), lambda batch: batch.slice(1), "id long")
    assert done.good.count() == 0 and {r.error for r in done.dead.collect()} == {"ValueError: 0 results for 1 rows"}


# ---------------------------------------------------------------- fates


def verdicts(spark):
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    rows = [
        ("a.txt", "accept", sha("a"), "text", None, None), ("b.txt", "accept", sha("not b"), "text", None, None), ("c.txt", "review", sha("c"), "text", None, None), ("gone.txt", "accept", sha("x"), "text", None, None),
        ("d.txt", "duplicate", sha("a"), "text", None, None), ("e.txt", "duplicate", sha("lost"), "text", None, None), ("f", "skip", sha(""), "other", None, "trace"), ("g", "skip", sha("g"), "other", None, "service"),
        ("k.zip", "archive", "", "archive", None, None), ("k.zip/1", "accept", sha("1"), "text", "k.zip", None), ("l.zip", "archive", "", "archive", None, None), ("l.zip/i.zip", "archive", "", "archive", "l.zip", None),
        ("l.zip/i.zip/2", "skip", sha("2"), "other", "l.zip/i.zip", None), ("m.zip", "archive", "", "archive", None, None), ("m.zip/3", "accept", sha("not 3"), "text", "m.zip", None), ("q.zip", "quarantine", sha("q"), "archive", None, None),
    ]
    v = spark.createDataFrame(rows, "name string, decision string, sha string, family string, archive string, skipped_as string")
    contents = spark.createDataFrame([(n, t.encode()) for n, t in (("a.txt", "a"), ("b.txt", "b"), ("c.txt", "c"), ("k.zip/1", "1"), ("m.zip/3", "3"), ("q.zip", "q"))], "name string, content binary")
    return v, contents, spark.createDataFrame([], "sha string")


FATES = {
    "a.txt": "removed", "b.txt": "kept", "c.txt": "removed", "gone.txt": "kept", "d.txt": "removed", "e.txt": "returned", "f": "removed", "g": "returned", "k.zip": "removed", "k.zip/1": None, "l.zip": "returned",
    "l.zip/i.zip": None, "l.zip/i.zip/2": None, "m.zip": "kept", "m.zip/3": None, "q.zip": "removed",
}


@pytest.mark.parametrize("stop", [None, *fate.STEPS])
def test_a_batch_that_is_killed_after_any_step_ends_the_same(spark, tmp_path, stop):
    v, contents, known = verdicts(spark)
    home = f"file://{tmp_path}/fate"
    if stop:
        with pytest.raises(fate.Stopped):
            fate.settle(spark, home, "b1", v, contents, known, stop_after=stop)
        shown = stop == "commit"
        assert (fate.corpus(spark, home).count() > 0) == shown and (fate.left_in_inbox(spark, home, v.select("name")).count() < v.count()) == shown
    assert {r.name: r.fate for r in fate.settle(spark, home, "b1", v, contents, known).collect()} == FATES
    placed = {r.place: bytes(r.content) for r in fate.corpus(spark, home).collect()}
    assert placed == {"corpus/b1/a.txt": b"a", "queue/b1/c.txt": b"c", "corpus/b1/k.zip/1": b"1", "quarantine/b1/q.zip": b"q"}
    assert {r.name for r in fate.left_in_inbox(spark, home, v.where("archive is null").select("name")).collect()} == {n for n, f in FATES.items() if f == "kept"}
    again = fate.settle(spark, home, "b1", v.limit(1), contents, known)  # a committed batch stays as it is
    assert again.count() == len(FATES) and fate.committed(spark, home) == ["b1"]


# ---------------------------------------------------------------- versions


def test_versions(spark, tmp_path):
    home = f"file://{tmp_path}/table"
    rows = spark.range(100).select("id", F.lit("x").alias("s"))
    assert versions.create(rows.repartition(4), home) == 1
    with pytest.raises(versions.Conflict):
        versions.create(rows, home)
    for k in range(3):
        versions.append(spark.range(100 + 10 * k, 110 + 10 * k).select(F.lit("y").alias("s"), "id").repartition(3), home)
    assert versions.rewrite(spark, home, lambda df: df.withColumn("s", F.when(F.col("id") % 2 == 0, F.col("s")))) == 5
    with pytest.raises(versions.NotTheSame):
        versions.rewrite(spark, home, lambda df: df.where("id > 3"))
    before = sorted(map(tuple, versions.read(spark, home).collect()), key=repr)
    assert versions.compact(spark, home, target=2000) == 6
    assert sorted(map(tuple, versions.read(spark, home).collect()), key=repr) == before and len(before) == 130
    stats = {r.version: r for r in versions.statistics(spark, home, target=2000).collect()}
    assert [stats[v].rows for v in range(1, 7)] == [100, 110, 120, 130, 130, 130] and stats[6].fragments < stats[5].fragments
    assert versions.read(spark, home, 1).count() == 100 and versions.read(spark, home, 4).where("s is null").count() == 0
    assert versions.compact(spark, home, target=1) == 6  # nothing is small
    with pytest.raises(KeyError):
        versions.files(spark, home, 9)


def test_of_two_writers_from_one_version_the_later_fails(spark, tmp_path):
    home = f"file://{tmp_path}/table"
    versions.create(spark.range(5), home)
    with pytest.raises(versions.Conflict):
        versions.rewrite(spark, home, lambda df: (versions.append(spark.range(5, 7), home), df)[1])
    assert versions.versions(spark, home) == [1, 2] and versions.read(spark, home).count() == 7


def test_footers_are_all_that_statistics_read(spark, tmp_path):
    home = f"file://{tmp_path}/table"
    versions.create(spark.range(1000).select("id", F.repeat(F.lit("w"), 500).alias("s")), home)
    path = versions.files(spark, home).first()["path"].rpartition("/")[0]
    plan = versions.footers(spark, versions.schema_of(spark, home), path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan
    empty = f"file://{tmp_path}/none"
    versions.create(spark.range(0), empty)
    assert versions.read(spark, empty).count() == 0 and versions.statistics(spark, empty).first()["rows"] == 0 and versions.compact(spark, empty) == 1


# ---------------------------------------------------------------- streams

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def fed(spark, home, schema, parts):
    """A stream of files in order; parts that come later can be added by writing on."""
    for k, rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{home}/part-{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(home)


CHANGES = "entry long, seen timestamp, size long, mtime long"
PARTS = [
    (0, [(1, at(0), 10, 1), (2, at(0), 20, 1), (3, at(5), 5, 1), (None, at(1), 1, 1), (9, None, 1, 1)]), (1, [(1, at(20), 11, 1), (2, at(20), 20, 1), (3, at(25), None, None)]),
    (2, [(1, at(40), 12, 1), (2, at(45), 20, 1), (4, at(41), 1, 1), (4, at(80), 2, 1)]), (3, [(5, at(120), 1, 1)]),
]
READY = [(1, at(40), 3, at(70)), (2, at(0), 1, at(30)), (2, at(45), 1, at(75)), (4, at(41), 1, at(71)), (4, at(80), 1, at(110))]


def test_quiet_entries_by_timers_over_a_restart(spark, tmp_path):
    home = f"file://{tmp_path}"
    stream = fed(spark, f"{home}/a", CHANGES, PARTS)
    got = S.collected(S.ready_entries(stream), f"{home}/one", S.READY)
    assert sorted(map(tuple, got.collect())) == READY
    for k in (2, 4):  # stopped after two files, and started again
        stream = fed(spark, f"{home}/b", CHANGES, PARTS[k - 2 : k])
        got = S.collected(S.ready_entries(stream), f"{home}/two", S.READY)
    assert sorted(map(tuple, got.collect())) == READY
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{home}/two/progress")
    assert [r.key.entry for r in state.select("key").collect()] == [5]  # only what is still open


EVENTS = "debt string, at timestamp, event string"


def test_debts_are_offered_until_they_are_paid(spark, tmp_path):
    home = f"file://{tmp_path}"
    parts = [(0, [("a", at(0), "owed"), ("b", at(0), "owed"), ("a", at(1), "owed")]), (1, [("c", at(15), "owed"), ("b", at(16), "paid")]), (2, [("a", at(24), "gone"), ("d", at(50), "owed")]), (3, [("e", at(100), "paid")])]
    want = [
        ("a", 1, at(0), "offered"), ("a", 2, at(10), "offered"), ("a", 3, at(20), "offered"), ("a", 3, at(24), "gone"), ("b", 1, at(0), "offered"), ("b", 2, at(10), "offered"), ("b", 2, at(16), "paid"),
        ("c", 1, at(15), "offered"), ("c", 2, at(25), "offered"), ("c", 3, at(35), "offered"), ("d", 1, at(50), "offered"), ("d", 2, at(60), "offered"), ("d", 3, at(70), "offered"),
    ]
    got = S.collected(S.offered_debts(fed(spark, f"{home}/a", EVENTS, parts), 10, most=3), f"{home}/one", S.OFFER)
    assert sorted(map(tuple, got.collect())) == want
    for k in (2, 4):
        got = S.collected(S.offered_debts(fed(spark, f"{home}/b", EVENTS, parts[k - 2 : k]), 10, most=3), f"{home}/two", S.OFFER)
    assert sorted(map(tuple, got.collect())) == want
    state = spark.read.format("statestore").option("stateVarName", "offers").load(f"{home}/two/progress")
    assert {r.key.debt for r in state.select("key").collect()} == {"c", "d"}
