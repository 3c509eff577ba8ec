"""Ranked search queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.operators import fulltext
from lodestone.operators import ivf as I
from lodestone.operators import search as S
from lodestone.plans.registry import query, values
from lodestone.session import scratch_path, table
from lodestone.sources.docs import DOCS_SQL, docs, documents

TODAY = 20260831
WORDS = "the of and"

VEC_SQL = """
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
vec_all AS (
  SELECT d.*, round(1 - list_dot_product(e.embedding::DOUBLE[], q.q) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.q, q.q))), 6) AS dist
  FROM {docs} d JOIN embeddings e ON e.vec_id = d.doc_id, q WHERE d.chunk = 0
),
vec AS (SELECT *, row_number() OVER (ORDER BY dist, path, chunk) - 1 AS rank FROM vec_all ORDER BY dist, path, chunk LIMIT 120)"""
BM25_SQL = """
tok AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {docs}),
cnt AS (SELECT * EXCLUDE (t), CAST(len(t) AS DOUBLE) AS n, CAST(len(list_filter(t, lambda x: x = 'the')) AS DOUBLE) AS a,
   CAST(len(list_filter(t, lambda x: x = 'of')) AS DOUBLE) AS b, CAST(len(list_filter(t, lambda x: x = 'and')) AS DOUBLE) AS c FROM tok),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS nn, avg(n) AS av, CAST(count_if(a > 0) AS DOUBLE) AS da, CAST(count_if(b > 0) AS DOUBLE) AS db, CAST(count_if(c > 0) AS DOUBLE) AS dc FROM cnt),
bm AS (SELECT cnt.* EXCLUDE (n, a, b, c), round(
   ln(1 + (nn - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / av))
 + ln(1 + (nn - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / av))
 + ln(1 + (nn - dc + 0.5) / (dc + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / av)), 6) AS bm25
 FROM cnt, tot WHERE a + b + c > 0),
fts AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, path, chunk) - 1 AS rank FROM bm ORDER BY bm25 DESC, path, chunk LIMIT 120)"""
RANK_SQL = """
fused AS (
  SELECT coalesce(v.path, f.path) AS path, coalesce(v.chunk, f.chunk) AS chunk, coalesce(v.title, f.title) AS title, coalesce(v.updated, f.updated) AS updated,
         coalesce(v.text, f.text) AS text, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(0.8::DOUBLE / (60 + f.rank), 0) AS rrf
  FROM vec v FULL JOIN fts f ON v.path = f.path AND v.chunk = f.chunk
),
scored AS (
  SELECT *, rrf * (0.55 + 0.45 * pow(0.5::DOUBLE, CAST(CASE WHEN regexp_matches(updated, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN greatest(0, (2026 - CAST(substr(updated, 1, 4) AS INTEGER)) * 365
    + (8 - CAST(substr(updated, 6, 2) AS INTEGER)) * 30 + 31 - CAST(substr(updated, 9, 2) AS INTEGER)) ELSE 3650 END AS DOUBLE) / 540.0)) AS score FROM fused
),
nth AS (SELECT *, row_number() OVER (PARTITION BY substr(trim(text), 1, 400) ORDER BY score DESC, path DESC, chunk DESC) AS n FROM scored),
hits AS (SELECT path, chunk, title, updated, text, score FROM nth WHERE n = 1 OR trim(text) = '' ORDER BY score DESC, path DESC, chunk DESC LIMIT {k})"""


def full(docs_name: str = "docs", k: int = 10, extra: str = "") -> str:
    return f"WITH {DOCS_SQL}{extra}, {VEC_SQL}, {BM25_SQL}, {RANK_SQL}".replace("{docs}", docs_name).replace("{k}", str(k)).replace("{{", "{").replace("}}", "}")


def _query(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 7").select(F.col("embedding").alias("q"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


@query(full() + " SELECT path, chunk, dist FROM vec")
def vector_topk(spark, sf):
    return S.vector_list(docs(spark, sf), _vectors(spark, sf), _query(spark, sf)).select("path", "chunk", "dist")


@query(full() + " SELECT path, chunk, bm25 FROM fts")
def bm25_topk(spark, sf):
    return S.bm25_list(docs(spark, sf), WORDS).select("path", "chunk", "bm25")


@query(full() + " SELECT path, chunk, bm25 FROM fts")
def fulltext_index(spark, sf):
    home = fulltext.build(docs(spark, sf), scratch_path(spark, "fulltext"))
    return fulltext.best(spark, home, WORDS)


@query(full("kept", 10, ", kept AS (SELECT * FROM docs WHERE doc_id % 5 <> 2)") + " SELECT path, chunk, bm25 FROM fts")
def fulltext_upkeep(spark, sf):
    """The index after two appends, a deletion, a merge and another deletion: as a fresh one of what's left."""
    d, paths = docs(spark, sf), documents(spark, sf).select("doc_id", "path")  # no text is cut for its path
    index = fulltext.FullText(spark, scratch_path(spark, "fulltext"))
    index.append(d.where("doc_id % 3 = 0"))
    index.append(d.where("doc_id % 3 > 0"))
    index.delete(paths.where("doc_id % 10 = 2"))
    index.merge()
    index.delete(paths.where("doc_id % 10 = 7"))
    return index.best(WORDS)


@query(full() + " SELECT path, chunk, title, updated, round(score, 9) AS score FROM hits")
def hybrid_search(spark, sf):
    found = S.search(docs(spark, sf), _vectors(spark, sf), _query(spark, sf), WORDS, TODAY)
    return found.select("path", "chunk", "title", "updated", F.round("score", 9).alias("score"))


@query(full("kept", 5, ", kept AS (SELECT * FROM docs WHERE updated >= '2025-01' AND source IN ('src1', 'src2', 'src3') AND space = 'en')") + " SELECT path, chunk, title, updated, round(score, 9) AS score FROM hits")
def search_filtered(spark, sf):
    found = S.search(docs(spark, sf), _vectors(spark, sf), _query(spark, sf), WORDS, TODAY, 5, "2025-01", "src1,src2,src3", "en")
    return found.select("path", "chunk", "title", "updated", F.round("score", 9).alias("score"))


@query(full("docs", 20) + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, path DESC, chunk DESC) AS rank, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 420) AS s FROM hits),
fold AS (SELECT * FROM (WITH RECURSIVE f(rank, spent, shown) AS (
   SELECT 0::BIGINT, 0::BIGINT, '' UNION ALL
   SELECT r.rank, CASE WHEN f.spent + length(r.s) <= 2000 THEN f.spent + length(r.s) ELSE f.spent END, CASE WHEN f.spent + length(r.s) <= 2000 THEN r.s ELSE '' END FROM f JOIN r ON r.rank = f.rank + 1)
 SELECT rank, shown FROM f WHERE rank > 0))
SELECT r.rank, r.path, r.title, round(r.score, 5) AS score, fold.shown AS text FROM r JOIN fold USING (rank)""")
def api_projection(spark, sf):
    found = S.search(docs(spark, sf), _vectors(spark, sf), _query(spark, sf), WORDS, TODAY, 20)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("path"), F.desc("chunk"))).cast("long"))
    return S.budgeted(ranked.select("rank", "path", "title", F.round("score", 5).alias("score"), "text"), 2000)


@query("""WITH v AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents WHERE doc_id % 3 = 0), f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS rank FROM documents WHERE doc_id % 5 = 0)
SELECT CAST(coalesce(v.doc_id, f.doc_id) AS VARCHAR) AS path, 0 AS chunk, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(0.8::DOUBLE / (60 + f.rank), 0), 9) AS rrf FROM v FULL JOIN f USING (doc_id)""")
def rrf_fuse(spark, sf):
    part = lambda k, order: table(spark, sf, "documents").where(f"doc_id % {k} = 0").select(
        F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("chunk"), F.lit("2026-08-01").alias("updated"), (F.row_number().over(Window.orderBy(order)) - 1).alias("rank")
    )
    return S.fuse(part(3, F.asc("doc_id")), part(5, F.desc("doc_id"))).select("path", "chunk", F.round("rrf", 9).alias("rrf"))


@query("""SELECT label, count(*) AS n, round(avg(1 - list_dot_product(e.embedding::DOUBLE[], q.q) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.q, q.q)))), 6) AS mean_dist
FROM embeddings e, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) q GROUP BY label""")
def distance_by_label(spark, sf):
    e = table(spark, sf, "embeddings").crossJoin(F.broadcast(_query(spark, sf).limit(1)))  # the query row
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.cosine_distance(F.col("embedding"), F.col("q"))), 6).alias("mean_dist"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS len FROM e),
d AS (SELECT q.vec_id AS query, n.vec_id, round(1 - list_dot_product(q.v, n.v) / (q.len * n.len), 6) + 0.0 AS dist FROM n q, n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS place FROM d) SELECT query, CAST(place AS INTEGER) AS place, dist FROM r WHERE place <= 120""")
def ivf_search(spark, sf):
    """Every vector whose id is divisible by 50 against all, the 120 nearest each (distances: ids of equal ones may differ in the last digit)."""
    vectors = _vectors(spark, sf)
    index = I.build(vectors, scratch_path(spark, "ivf"), I.cell_count(vectors.count()))
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return I.topk(spark, index, queries, S.CANDIDATES).select("query", "place", "dist")


@query("""WITH k AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 <> 3), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS len FROM k),
d AS (SELECT q.vec_id AS query, n.vec_id, round(1 - list_dot_product(q.v, n.v) / (q.len * n.len), 6) + 0.0 AS dist FROM n q, n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS place FROM d) SELECT query, CAST(place AS INTEGER) AS place, dist FROM r WHERE place <= 120""")
def ivf_upkeep(spark, sf):
    """The same search after an append, a deletion and splits of crowded cells, over what's left."""
    vectors = _vectors(spark, sf)
    index = I.LiveIndex(spark, scratch_path(spark, "live-ivf"))
    index.create(vectors.where("vec_id % 3 > 0"), 64)
    index.append(vectors.where("vec_id % 3 = 0"))
    index.delete(vectors.where("vec_id % 10 = 3").select("vec_id"))
    index.split(1.5)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return index.topk(queries, S.CANDIDATES).select("query", "place", "dist")


@query(full() + """, c AS (SELECT DISTINCT source FROM docs) SELECT base, place FROM (
 SELECT 'src3' AS base, 0::BIGINT AS place UNION ALL SELECT source, row_number() OVER (ORDER BY source) FROM c WHERE source <> 'src3' UNION ALL SELECT 'intake', (SELECT count(*) FROM c))""")
def base_list(spark, sf):
    found = docs(spark, sf).select("source").distinct().where("source <> 'src3'")
    rest = found.select(F.col("source").alias("base"), F.row_number().over(Window.orderBy("source")).cast("long").alias("place"))
    last = found.agg((F.count("*") + 1).alias("place")).select(F.lit("intake").alias("base"), "place")
    return values(spark, "('src3', CAST(0 AS BIGINT))", "base, place").unionByName(rest).unionByName(last)
