"""The identity base: who is already there, what changed, and keeping it up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(probes: DataFrame, known: DataFrame) -> DataFrame:
    """probes (id, sha, mid, fp) with the first match by message id, then hash, then fingerprint; of several paths the least.

    A fingerprint counts for a probe with a message id only against rows without one.
    """
    least = lambda key, rows=known: rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("path").alias(f"by_{key}"))
    anonymous = known.where("mid is null and fp is not null").groupBy("fp").agg(F.min("path").alias("by_fp_bare"))
    joined = probes.join(least("mid"), "mid", "left").join(least("sha"), "sha", "left").join(least("fp"), "fp", "left").join(anonymous, "fp", "left")
    by_fp = F.when(F.col("mid").isNull(), F.col("by_fp")).otherwise(F.col("by_fp_bare"))
    how = F.when(F.col("by_mid").isNotNull(), "mid").when(F.col("by_sha").isNotNull(), "sha").when(by_fp.isNotNull(), "fp")
    return joined.select("id", F.coalesce("by_mid", "by_sha", by_fp).alias("found"), how.alias("how"))


def refresh(known: DataFrame, seen: DataFrame) -> DataFrame:
    """path, change: added, changed (size or time differ), same or removed."""
    a = known.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    both = a.join(seen.select("path", "size", "mtime"), "path", "full")
    change = (
        F.when(F.col("size").isNull(), "removed").when(F.col("old_size").isNull(), "added")
        .when((F.col("size") != F.col("old_size")) | (F.col("mtime") != F.col("old_mtime")), "changed").otherwise("same")
    )
    return both.select("path", change.alias("change"))


def upsert(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows by path, fresh ones in place of old ones."""
    both = fresh.withColumn("__age", F.lit(0)).unionByName(known.withColumn("__age", F.lit(1)))
    first = Window.partitionBy("path").orderBy("__age")
    return both.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__age", "__nth")
