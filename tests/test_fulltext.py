"""The full-text index against scores over whole texts, through appends, deletions and merges."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fulltext
from lodestone.operators.fulltext import Conflict, FullText, build


def scores(rows, query, n=120):
    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    cut = [(p, c, re.findall(r"[^\W_]+", t.lower())) for p, c, t in rows]
    mean = sum(len(t) for *_, t in cut) / max(1, len(cut))
    df = {w: sum(w in t for *_, t in cut) for w in words}
    out = []
    for p, c, t in cut:
        s = sum(math.log(1 + (len(cut) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in words if w in t)
        if s:
            out.append((p, c, round(s, 6)))
    return sorted(out, key=lambda r: (-r[2], r[0], r[1]))[:n]


def same(df, want):
    got = [(r.path, r.chunk, r.bm25) for r in df.collect()]
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def made(seed, n, first=0):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and"], [f"w{k}" for k in range(60)]
    return [(f"p{first + k:04}", k % 3, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.choice([3, 10, 40, 200])))) for k in range(n)]


SCHEMA = "path string, chunk int, text string"
QUERIES = ["w1 the w7 THE nothing", "w3"]


def test_append_delete_merge_are_a_fresh_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BUCKETS", 2)
    index = FullText(spark, f"file://{tmp_path}/index", width=8)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows = made(1, 150)
    index.append(frame(rows).repartition(3))
    check = lambda: [same(index.best(q, 20), scores(rows, q, 20)) for q in QUERIES]
    check()
    more = made(2, 80, 500) + [("empty", 0, ""), ("marks", 0, "... !")]
    index.append(frame(more))
    rows += more
    check()
    gone = {p for k, (p, *_) in enumerate(rows) if k % 3 == 0}
    index.delete(frame([(p, 0, "") for p in gone]).select("path"))
    rows = [r for r in rows if r[0] not in gone]
    check()
    index.delete(frame([(rows[0][0], 0, ""), ("unknown", 0, "")]).select("path"))
    again = made(3, 10, 900) + [(p, 7, "the w3 again") for p in sorted(gone)[:2]]
    index.append(frame(again))
    rows = rows[1:] + again
    check()
    assert index.merge() == 6 and len(index.current().segments) == 1 and index.current().deleted == []
    check()
    index.append(frame(made(4, 5, 2000)))
    rows += made(4, 5, 2000)
    check()


def test_ranges_that_can_not_reach_the_best_stay_unread(spark, tmp_path):
    rows = [(f"p{k:05}", 0, "the " * (40 if k < 30 else 1) + "filler " * (60 if k < 30 else 99)) for k in range(4000)]
    index = FullText(spark, build(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}/index"))
    found, count = index.explained("the", 10)
    same(found, scores(rows, "the", 10))
    assert count["postings"] == 4000 and count["read"] <= 64
    plan = spark.read.parquet(f"{index.home}/segments/{index.current().segments[0]}/postings").where(F.col("bucket").isin([3]) & F.col("term").isin(["the"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan or "EqualTo(term" in plan


def test_of_two_writers_one_fails(spark, tmp_path):
    index = FullText(spark, f"file://{tmp_path}/index")
    before = index.current()
    index.append(spark.createDataFrame([("a", 0, "x")], SCHEMA))
    with pytest.raises(Conflict):
        index._commit(before, [], [])
    with pytest.raises(Conflict):
        build(spark.createDataFrame([("a", 0, "x")], SCHEMA), index.home)
    assert FullText(spark, f"file://{tmp_path}/none").best("x").count() == index.best("").count() == index.best("absent").count() == 0
