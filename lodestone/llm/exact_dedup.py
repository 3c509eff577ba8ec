"""Exact deduplication with a heavy-hitter split. Only DataFrame functions are used.

Texts are equal when they are identical after every run of ASCII white space (0x20, 0x09-0x0D) is replaced by one
space; a null text counts as empty. The SHA-256 of that form is the digest.

1. A Misra-Gries summary (the mergeable frequent-items sketch behind ``approx_top_k``) is built on 64-bit hashes of
   the digests, in two levels so that no task merges more than a few dozen summaries.
2. Its candidates are verified by an exact count; those that hold at least one row in ``SHARE`` are the winners.
   There are never more than ``CANDIDATES`` of them (the summary returns no more), so they are broadcast and their
   rows are settled map-side: a group that holds a third of all rows never meets in one task.
3. All other digests go through an ordinary shuffle, where a group holds less than one row in ``SHARE``.

Defined results: null ids sort after all others; of repeated rows (same id, same text) exactly one stays; an empty
table gives an empty result; further columns are passed over (assign) or kept untouched (drop_duplicates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialised

#: Counters of one Misra-Gries summary, candidates taken from it, and the share (1 in N) that makes a winner.
COUNTERS = 4096
CANDIDATES = 1024
SHARE = 2048
#: Groups of partitions whose summaries are merged first.
FIRST_LEVEL = 64


def digest(text: Column) -> Column:
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(squeezed.cast("binary"), 256)


def winners(digests: DataFrame, id_col: str = "__id", digest_col: str = "__digest") -> DataFrame:
    """Verified frequent digests: digest, the row that stays, group size. At most CANDIDATES rows."""
    keyed = digests.select(digest_col, id_col, "__row", F.xxhash64(digest_col).alias("__key"))
    level = keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(FIRST_LEVEL)).alias("__part")).agg(
        F.expr(f"approx_top_k_accumulate(__key, {COUNTERS})").alias("__sketch")
    )
    # Grouped by a constant: over no rows at all there is no summary to ask.
    top = level.groupBy(F.expr("__part * 0").alias("__all")).agg(F.expr(f"approx_top_k_combine(__sketch, {COUNTERS})").alias("__sketch")).select(
        F.explode(F.expr(f"approx_top_k_estimate(__sketch, {CANDIDATES})")).alias("__top")
    )
    candidates = top.select(F.col("__top.item").alias("__key")).where("__key is not null").distinct()
    total = digests.count()
    counted = (
        keyed.join(F.broadcast(candidates), "__key", "left_semi")
        .groupBy(digest_col)
        .agg(
            F.count("*").alias("__n"),
            F.min(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("__row").alias("row"))).alias("__first"),
        )
    )
    return counted.where((F.col("__n") >= 2) & (F.col("__n") * SHARE >= total)).select(F.col(digest_col), F.col("__n"), F.col("__first.id").alias("__keep"), F.col("__first.row").alias("__keep_row"))


def digest_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per input row, written once: the text is read and hashed a single time."""
    narrow = df.select(F.col(f"`{id_col}`").alias("__id"), digest(F.col(f"`{text_col}`")).alias("__digest"))
    return materialised(narrow.withColumn("__row", F.monotonically_increasing_id()), "digests")


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = digest_table(df, id_col, text_col)
    heavy = materialised(winners(rows), "winners")
    joined = rows.join(F.broadcast(heavy), "__digest", "left")
    settled = joined.where("__n is not null").select(
        "__id", F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"),
        (F.col("__row") == F.col("__keep_row")).alias("kept"), "__digest",
    )
    group = Window.partitionBy("__digest")
    order = group.orderBy(F.col("__id").asc_nulls_last(), "__row")
    rest = joined.where("__n is null").select("__id", "__digest", "__row").select(
        "__id", F.first("__id").over(order).alias("keep_id"), F.count("*").over(group).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"), "__digest",
    )
    return settled.unionByName(rest).withColumnsRenamed({"__id": id_col, "__digest": "text_sha256"})


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names: a row goes through as one struct.

    Copies of the broadcast winners are removed before the shuffle. Where a winner's rows repeat one id as well, each
    partition still passes on a single one (the limit on the row number is applied before the shuffle, too).
    """
    heavy = materialised(winners(digest_table(df, id_col, text_col)), "winners").select("__digest", "__n", "__keep")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.select(F.col(f"`{id_col}`").alias("__id"), digest(F.col(f"`{text_col}`")).alias("__digest"), row.alias("__whole"))
    left = keyed.join(F.broadcast(heavy), "__digest", "left").where(F.col("__n").isNull() | F.col("__id").eqNullSafe(F.col("__keep")))
    order = Window.partitionBy("__digest").orderBy(F.col("__id").asc_nulls_last())
    first = left.select("__id", "__digest", "__whole", F.row_number().over(order).alias("__place")).where("__place = 1")
    return first.select(*[F.col("__whole").getField(c).alias(c) for c in df.columns])
