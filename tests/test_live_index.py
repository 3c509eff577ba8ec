"""An inverted file that is kept up: recall with fewer cells probed than exist, before and after a third of the rows change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ivf


def recall(index, rows, probes, n=120):
    """Over all ids divisible by 50, against brute force; and whether only live ids are found."""
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    asked = [i for i in ids.tolist() if i % 50 == 0]
    near = {q: set(ids[np.argsort(1 - x @ rows[q], kind="stable")[:n]].tolist()) for q in asked}
    queries = index.spark.createDataFrame([(q, rows[q].tolist()) for q in asked], "query long, embedding array<double>")
    found = {q: set() for q in asked}
    for r in index.topk(queries, n, probes).collect():
        found[r.query].add(r.vec_id)
    assert all(f <= set(rows) for f in found.values())
    return sum(len(found[q] & near[q]) for q in asked) / (n * len(asked))


def test_recall_before_and_after_a_third_of_the_rows_change(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in vectors.collect()}
    index = ivf.LiveIndex(spark, f"file://{tmp_path}/live")
    index.create(vectors, 64)
    assert recall(index, rows, 48) >= 0.9
    index.delete(vectors.where("vec_id % 10 in (1, 4, 7)").select("vec_id"))
    rows = {k: v for k, v in rows.items() if k % 10 not in (1, 4, 7)}
    new = vectors.where("vec_id % 10 in (1, 4, 7)").select((F.col("vec_id") + 100_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i < 8, x * 3).otherwise(x)).alias("embedding"))
    index.append(new)
    rows |= {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in new.collect()}
    assert recall(index, rows, 48) >= 0.9
    before = index.state()["version"]
    assert index.split(1.3) == before + 1
    state = index.state()
    assert len(index.index(state).centres) > 64 and index.rows(state).count() == len(rows)
    sizes = [r["count"] for r in index.rows(state).groupBy("cell").count().collect()]
    assert max(sizes) <= 3 * len(rows) / 64
    assert recall(index, rows, len(index.index(state).centres) * 3 // 4) >= 0.9
    assert recall(index, rows, 4096) == 1.0


def test_versions_and_ids_that_come_back(spark, tmp_path):
    index = ivf.LiveIndex(spark, f"file://{tmp_path}/live")
    frame = lambda ids: spark.createDataFrame([(i, [1.0, float(i)]) for i in ids] + [(99, None), (98, [0.0, 0.0])], "vec_id long, embedding array<double>")
    index.create(frame(range(6)), 2)
    with pytest.raises(ivf.Conflict):
        index.create(frame([1]), 2)
    index.delete(frame([2, 3]).select("vec_id"))
    index.append(frame([3, 7]))
    assert sorted(r.vec_id for r in index.rows(index.state()).collect()) == [0, 1, 3, 4, 5, 7]
    assert index.split(100.0) == 3
    with pytest.raises(ivf.Conflict):
        index._commit(index.state() | {"version": 1})
    got = index.topk(spark.createDataFrame([(1, [1.0, 3.0])], "query long, embedding array<double>"), 2).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.place)] == [3, 4]
