"""Batch intake: what is skipped, what repeats, what happens to archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Files that systems leave behind.
TRACES = [".ds_store", "thumbs.db", "desktop.ini"]


def trace(name: Column, size: Column) -> Column:
    """Why a file is a system trace, or null."""
    low = F.lower(name)
    return (
        F.when(size == 0, "empty").when(low.rlike("(?:^|/)__macosx/"), "macosx").when(T.file_name(low).isin(TRACES), "system")
        .when(T.file_name(name).startswith("._") & low.rlike("(?:^|/)__macosx(?:/|$)"), "appledouble")
    )


def glob_regex(pattern: str) -> str:
    import re

    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def service(name: Column, anywhere: list[str], root_only: list[str]) -> Column:
    base = T.file_name(name)
    hit = lambda patterns: F.coalesce(*[F.when(base.rlike(glob_regex(p)), True) for p in patterns], F.lit(False))
    return F.when(hit(anywhere), "service").when(hit(root_only) & ~F.contains(name, F.lit("/")), "service at root")


def described_mail(files: DataFrame) -> DataFrame:
    """x.json files beside an x.eml or x.msg."""
    stem = F.regexp_replace("name", r"\.[^./]+$", "")
    letters = files.where(T.extension(F.col("name")).isin(".eml", ".msg")).select(stem.alias("stem")).distinct()
    return files.where(T.extension(F.col("name")) == ".json").withColumn("stem", stem).join(letters, "stem", "left_semi").select("name")


def same_bytes(files: DataFrame) -> DataFrame:
    """files (batch, name, sha) with duplicate_of: the first name of the same bytes in the batch, for all but that one."""
    first = F.min("name").over(Window.partitionBy("batch", "sha"))
    return files.withColumn("first", first).select("batch", "name", F.when(F.col("first") != F.col("name"), F.col("first")).alias("duplicate_of"))


def ancestors(name: Column) -> Column:
    """All enclosing paths of a nested member."""
    parts = F.split(name, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def tainted_archives(files: DataFrame, notes: int = 20) -> DataFrame:
    """Archives that enclose an executable, with the first of them by name: archive, name, nth (a report of `notes` lines)."""
    bad = files.where("family = 'executable'").select("name", F.explode(ancestors(F.col("name"))).alias("archive")).where("archive <> name")
    archives = files.where("family = 'archive'").select(F.col("name").alias("archive"))
    nth = F.row_number().over(Window.partitionBy("archive").orderBy("name"))
    return bad.join(archives, "archive").withColumn("nth", nth).where(F.col("nth") <= notes)


def archive_fate(archives: DataFrame, members: DataFrame) -> DataFrame:
    """Broken ones stay, ones that lost a member are returned whole, all else is removed. archives: name, broken; members: name, lost."""
    inside = members.select(F.explode(ancestors(F.col("name"))).alias("name"), "lost").groupBy("name").agg(F.bool_or("lost").alias("lost"), F.count("*").alias("members"))
    joined = archives.join(inside, "name", "left")
    fate = F.when(F.col("broken"), "keep").when(F.coalesce("lost", F.lit(False)), "return").otherwise("remove")
    return joined.select("name", fate.alias("fate"), F.coalesce("members", F.lit(0)).alias("members"))


def unpack_limit(files: Column, size: Column, packed: Column, depth: Column) -> Column:
    return (
        F.when(files > 10_000, "files").when(size > 5_000_000_000, "bytes").when((size > 100_000_000) & (size / packed > 100), "ratio").when(depth > 3, "depth")
    )


def all_seen(pages: Column, skipped: Column, total: Column, most: int = 20) -> Column:
    """Whether pages read and pages skipped cover 1 to the total, or to `most` of it."""
    return F.size(F.array_except(F.sequence(F.lit(1), F.least(total, F.lit(most))), F.concat(pages, skipped))) == 0
