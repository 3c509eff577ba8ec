"""Hybrid ranked search: filters before both retrievals, rank fusion, freshness, collapse of repeats, then the limit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import dates as D
from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.session import materialised

RRF, LEXICAL_SHARE, CANDIDATES = 60, 0.8, 120
FRESH_BASE, FRESH_SHARE = 0.55, 0.45
K1, B = 1.2, 0.75


class BadQuery(ValueError):
    """An argument that a search can't take; raised before any table is opened."""


def clean_since(since: str | None) -> str:
    """A year, a month or a day in ASCII digits: months 01 to 12, days 01 to 31, whatever the month."""
    value = (since or "").strip()
    parts = value.split("-")
    widths = [len(p) for p in parts] == [4, 2, 2][: len(parts)] and all(p.isascii() and p.isdigit() for p in parts)
    if value and not (widths and all(1 <= int(p) <= most for p, most in zip(parts[1:], (12, 31)))):
        raise BadQuery("since must be YYYY, YYYY-MM or YYYY-MM-DD")
    return value


def clean_list(value: str | None) -> list[str]:
    return [p for p in (x.strip().replace("'", "") for x in (value or "").split(",")) if p]


def clamp_k(value: object, most: int, default: int) -> int:
    try:
        return max(1, min(most, int(value)))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def filtered(docs: DataFrame, since: str | None = None, source: str | None = None, space: str | None = None) -> DataFrame:
    """Date as text, then source, then space; all reach the scan."""
    since = clean_since(since)
    if since:
        docs = docs.where(F.col("updated") >= since)
    for column, value in (("source", source), ("space", space)):
        values = clean_list(value)
        if values:
            docs = docs.where(F.col(column).isin(values))
    return docs


def with_rows(docs: DataFrame, best: DataFrame, value: str, n: int) -> DataFrame:
    """The docs rows of a top list (path, chunk, value): its paths, n at most, become a filter that reaches the scan."""
    rows = best.collect()  # n rows
    listed = docs.sparkSession.createDataFrame([(r["path"], r["chunk"], r[value]) for r in rows], f"path string, chunk int, {value} double")
    found = docs.where(F.col("path").isin(sorted({r["path"] for r in rows}))).join(F.broadcast(listed), ["path", "chunk"])
    return found.select(*docs.columns, value).orderBy(F.desc(value) if value == "bm25" else value, "path", "chunk").limit(n)


def vector_list(docs: DataFrame, vectors: DataFrame, query: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The n nearest chunks of a one-row query by cosine distance, exactly.

    Distances are made on keys and vectors alone, as a top-n of every task; the n rows' other columns are fetched after that.
    The query row is the only broadcast.
    """
    target = query.limit(1).select("q", F.sqrt(V.dot(F.col("q"), F.col("q"))).alias("q_norm"))
    far = vectors.crossJoin(F.broadcast(target)).select("vec_id", F.round(1 - V.dot(F.col("embedding"), F.col("q")) / (F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))) * F.col("q_norm")), 6).alias("dist"))
    keys = docs.where("chunk = 0").select("path", "chunk", "doc_id")
    best = keys.join(far, keys.doc_id == far.vec_id).select("path", "chunk", "dist").orderBy("dist", "path", "chunk").limit(n)
    return with_rows(docs, best, "dist", n)


def word_counts(docs: DataFrame, words: list[str]) -> DataFrame:
    """path, chunk, size (its tokens) and tf (of each word asked for), written once: a chunk's text is read and cut a single time."""
    tokens = T.tokens(F.col("text"))
    held = lambda t, word: F.size(F.filter(t, lambda x: x == word)).cast("double")
    counts = T.bound(tokens, lambda t: F.struct(F.size(t).cast("double").alias("size"), F.array(*[held(t, w) for w in words]).alias("tf")))
    return materialised(docs.select("path", "chunk", counts.alias("c")).select("path", "chunk", "c.size", "c.tf"), "word-counts")


def bm25_list(docs: DataFrame, query: str, n: int = CANDIDATES) -> DataFrame:
    """The n best chunks for the query's words."""
    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not words:
        return docs.withColumn("bm25", F.lit(0.0)).limit(0)
    counted = word_counts(docs, words)
    tf = lambda i: F.get("tf", F.lit(i))
    totals = counted.agg(
        F.count("*").cast("double").alias("docs"), F.avg("size").alias("mean"), F.array(*[F.count_if(tf(i) > 0).cast("double") for i in range(len(words))]).alias("df")
    )
    scored = counted.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(totals))  # one row of totals
    score = F.lit(0.0)
    for i in range(len(words)):
        df = F.get("df", F.lit(i))
        score = score + F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5)) * tf(i) * (K1 + 1) / (tf(i) + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    best = scored.select("path", "chunk", F.round(score, 6).alias("bm25")).orderBy(F.desc("bm25"), "path", "chunk").limit(n)
    return with_rows(docs, best, "bm25", n)


def fuse(vec: DataFrame, fts: DataFrame) -> DataFrame:
    """Two candidate lists with 0-based `rank` -> one row per (path, chunk) with rrf; columns as in vec.

    Each list holds CANDIDATES rows at most, so the windows that rank them are small by construction.
    """
    columns = [c for c in vec.columns if c != "rank"]
    part = lambda df, share, order: df.select(*columns, (F.lit(share) / (RRF + F.col("rank"))).alias("part"), F.lit(order).alias("list"))
    both = part(vec, 1.0, 0).unionByName(part(fts, LEXICAL_SHARE, 1))
    rest = [c for c in columns if c not in ("path", "chunk")]
    return both.groupBy("path", "chunk").agg(
        *[F.min_by(c, "list").alias(c) for c in rest],
        (F.coalesce(F.max(F.when(F.col("list") == 0, F.col("part"))), F.lit(0.0)) + F.coalesce(F.max(F.when(F.col("list") == 1, F.col("part"))), F.lit(0.0))).alias("rrf"),
    )


def fresh(fused: DataFrame, today: int) -> DataFrame:
    return fused.withColumn("score", F.col("rrf") * (FRESH_BASE + FRESH_SHARE * D.recency(F.col("updated"), today)))


def collapsed(scored: DataFrame, k: int) -> DataFrame:
    """The best row of each text (its first 400 characters; blank texts each stand alone), then the k best."""
    order = [F.desc("score"), F.desc("path"), F.desc("chunk")]
    key = F.substring(T.strip(F.coalesce("text", F.lit(""))), 1, 400)
    same = Window.partitionBy("__key").orderBy(*order)
    ranked = scored.withColumn("__key", key).withColumn("__nth", F.row_number().over(same))
    return ranked.where("__key = '' or __nth = 1").drop("__key", "__nth").orderBy(*order).limit(max(1, k))


def search(docs: DataFrame, vectors: DataFrame, query: DataFrame, words: str, today: int, k: int = 10, since: str | None = None, source: str | None = None, space: str | None = None) -> DataFrame:
    """Ranked hits: path, chunk, title, source, space, updated, text, score."""
    kept = filtered(docs, since, source, space)
    columns = ["path", "chunk", "title", "source", "space", "updated", "text"]
    rank = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order, "path", "chunk")) - 1).select(*columns, "rank")
    vec = rank(vector_list(kept, vectors, query), "dist")
    fts = rank(bm25_list(kept, words), F.desc("bm25"))
    return collapsed(fresh(fuse(vec, fts), today), k).select(*columns, "score")


def budgeted(hits: DataFrame, budget: int, width: int = 420) -> DataFrame:
    """Snippets of ranked hits (rank, text, ...), blanked when they'd pass the budget; a later shorter one may still fit.

    A fold over the hits in order: they're a page (100 at most), not a table.
    """
    page = hits.withColumn("text", T.snippet(F.col("text"), width))
    packed = page.agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in page.columns if c != "rank"]))).alias("rows"))
    start = F.struct(F.lit(0).alias("spent"), F.array().cast("array<int>").alias("shown"))

    def step(acc, row):
        size = F.char_length(row["text"])
        fits = acc["spent"] + size <= budget
        return F.struct((acc["spent"] + F.when(fits, size).otherwise(0)).alias("spent"), F.concat(acc["shown"], F.array(F.when(fits, 1).otherwise(0))).alias("shown"))

    shown = F.aggregate("rows", start, step, lambda acc: acc["shown"])
    out = packed.select(F.explode(F.arrays_zip(F.col("rows"), shown.alias("shown"))).alias("x"))
    rows = out.select("x.rows.*", F.col("x.shown").alias("__shown"))
    return rows.withColumn("text", F.when(F.col("__shown") == 1, F.col("text")).otherwise("")).drop("__shown")
