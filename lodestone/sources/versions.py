"""Stored tables in versions: files are written once, a version lists its files, and its commit makes it the current one.

    home/data/<id>/part-*.parquet    rows, never changed
    home/versions/<n>/               path, size, rows of the version's files
    home/commits/<n>                 made only if it isn't there yet: of two writers that start from one version the later fails

A reader takes the newest commit, so a writer that dies at any point leaves the old version as it was, and files that no
version lists. Statistics come from file footers; rows aren't read for them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.session import write_bytes

#: Size that compaction makes files of, and files (about) whose sizes one task adds up.
TARGET = 128 << 20
FILES_A_TASK = 10_000
FILES = "path string, size long, rows long"


class Conflict(Exception):
    """Another writer has committed since the version that a change started from."""


class NotTheSame(Exception):
    """A rewrite didn't keep the number of rows; the old version stays the current one."""


def _paths(spark: SparkSession, home: str) -> list[str]:
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(f"{home}/commits/*")
    found = place.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(place)
    return [x.getPath().getName() for x in found or []]


def versions(spark: SparkSession, home: str) -> list[int]:
    """Numbers of the committed versions, oldest first."""
    return sorted(int(name) for name in _paths(spark, home) if name.isdigit())


def _version(spark: SparkSession, home: str, version: int | None) -> int:
    known = versions(spark, home)
    if version is None and known:
        return known[-1]
    if version not in known:
        raise KeyError(f"no version {version} in {home}")
    return version


def files(spark: SparkSession, home: str, version: int | None = None) -> DataFrame:
    """path, size, rows of a version's files (the newest version's)."""
    return spark.read.schema(FILES).parquet(f"{home}/versions/{_version(spark, home, version):06d}")


def schema_of(spark: SparkSession, home: str, version: int | None = None) -> StructType:
    path = f"{home}/versions/{_version(spark, home, version):06d}-schema"
    return StructType.fromJson(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def read(spark: SparkSession, home: str, version: int | None = None) -> DataFrame:
    version = _version(spark, home, version)
    schema, paths = schema_of(spark, home, version), [r["path"] for r in files(spark, home, version).select("path").collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def footers(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """path, size, rows of all files under a folder; no column is read, so only their footers are."""
    found = spark.read.schema(schema).parquet(path)
    return found.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"))


def _commit(spark: SparkSession, home: str, version: int, listed: DataFrame, schema: StructType) -> int:
    """Write a version's list and make it the current one, if none of its number is there."""
    draft = f"{home}/drafts/{uuid.uuid4().hex}"
    listed.coalesce(1).write.parquet(draft)  # a row for each file
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    store = path(draft).getFileSystem(sc._jsc.hadoopConfiguration())
    place = path(f"{home}/versions/{version:06d}")
    store.mkdirs(place.getParent())
    if version in versions(spark, home):
        raise Conflict(f"version {version} of {home} is there already")
    store.delete(place, True)  # left by a writer that died before its commit
    store.delete(path(f"{home}/versions/{version:06d}-schema"), True)
    if not store.rename(path(draft), place):
        raise Conflict(f"version {version} of {home} is being written")
    write_bytes(spark, f"{home}/versions/{version:06d}-schema", schema.json().encode())
    try:
        write_bytes(spark, f"{home}/commits/{version:06d}", b"")
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"version {version} of {home} is there already") from None
        raise
    return version


def _written(df: DataFrame, home: str) -> tuple[str, DataFrame]:
    path = f"{home}/data/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, footers(df.sparkSession, df.schema, path)


def create(df: DataFrame, home: str) -> int:
    """The first version; a table that's there isn't replaced."""
    if versions(df.sparkSession, home):
        raise Conflict(f"{home} has versions already")
    return _commit(df.sparkSession, home, 1, _written(df, home)[1], df.schema)


def append(df: DataFrame, home: str) -> int:
    """A version with more rows; none of the old files is touched."""
    spark = df.sparkSession
    old = _version(spark, home, None)
    schema = schema_of(spark, home, old)
    return _commit(spark, home, old + 1, files(spark, home, old).unionByName(_written(df.select(*schema.names), home)[1]), schema)


def rewrite(spark: SparkSession, home: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """A version of all rows changed, as many as before; the old one stays readable by its number."""
    old = _version(spark, home, None)
    before = read(spark, home, old)
    schema = before.schema
    listed = _written(change(before).select(*schema.names), home)[1]
    had, has = (x.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] for x in (files(spark, home, old), listed))
    if had != has:
        raise NotTheSame(f"{has} rows where there were {had}")
    return _commit(spark, home, old + 1, listed, schema)


def statistics(spark: SparkSession, home: str, target: int = TARGET) -> DataFrame:
    """A row for each version: rows, bytes, fragments (files), small (files of less than half the target)."""
    rows = [
        files(spark, home, v).agg(
            F.lit(v).alias("version"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("fragments"),
            F.count_if(F.col("size") < target // 2).alias("small"),
        )
        for v in versions(spark, home)
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def bins(small: DataFrame, target: int, files_a_task: int = FILES_A_TASK) -> DataFrame:
    """path, bin: files put together until the target is reached; bins are numbered without gaps."""
    salts = max(1, small.count() // files_a_task)
    salted = small.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("salt").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = salted.withColumn("part", F.floor(before / target))
    starts = cut.groupBy("salt").agg((F.max("part") + 1).alias("n"))
    first = starts.select("salt", F.coalesce(F.sum("n").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row for so many files
    return cut.join(first, "salt").select("path", (F.col("first") + F.col("part")).cast("int").alias("bin"))


def compact(spark: SparkSession, home: str, target: int = TARGET) -> int:
    """A version in which files of less than half the target are put together; larger ones are kept as they are."""
    old = _version(spark, home, None)
    schema, listed = schema_of(spark, home, old), files(spark, home, old)
    small = listed.where(F.col("size") < target // 2)
    placed = bins(small, target)
    paths = [r["path"] for r in small.select("path").collect()]
    if len(paths) < 2:
        return old
    n = placed.agg(F.max("bin")).first()[0] + 1
    rows = spark.read.schema(schema).parquet(*paths).withColumn("__path", F.col("_metadata.file_path"))
    dealt = rows.join(placed.withColumnsRenamed({"path": "__path", "bin": "__bin"}), "__path")
    dealt = dealt.repartitionById(n, F.col("__bin")) if hasattr(dealt, "repartitionById") else dealt.repartition(n, "__bin")
    path, fresh = _written(dealt.select(*schema.names), home)
    had, has = (x.agg(F.sum("rows")).first()[0] for x in (small, fresh))
    if had != has:
        raise NotTheSame(f"{has} rows where there were {had}")
    return _commit(spark, home, old + 1, listed.join(small.select("path"), "path", "left_anti").unionByName(fresh), schema)
