"""Session helpers: shared scratch tables and the settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lodestone", cores: str = "8", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent a temporary folder takes its place, but only in a session on one machine, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not _local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a table that lives as long as the application: its folder is deleted when the driver's JVM ends."""
    sc = spark.sparkContext
    home = f"{shared_dir(spark)}/lodestone/{sc.applicationId}"
    if home not in _HOMES:
        path = sc._jvm.org.apache.hadoop.fs.Path(home)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)  # of a folder that exists
        _HOMES.add(home)
    return f"{home}/{label}-{uuid.uuid4().hex}"


_HOMES: set[str] = set()


def materialised(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: later jobs read finished files, so a lost executor costs only the tasks it was
    running, and ids handed out while writing stay what they are.
    """
    return stored(df, label)[0]


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """materialised() with the table's path."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table (or a part of one) that no later step reads."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def moved(spark: SparkSession, path: str, to: str) -> None:
    """A folder gets another place, which is empty if it wasn't there."""
    sc = spark.sparkContext
    place, there = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    files = place.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(place):
        files.mkdirs(there)
    elif not files.rename(place, there):
        raise OSError(f"{path} could not be moved to {to}")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has run: the tables that it wrote take their place."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A new file in any store that Spark writes to."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def finished(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a pattern and whose job has committed, sorted."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(x.getPath().getParent()) for x in found or [])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most. Texts are a few kilobytes each: Spark's own 10,000 rows are tens of megabytes, held on both
#: sides of every task's pipe.
ARROW_ROWS = 2_000


def ship_package(spark: SparkSession) -> None:
    """Ready for functions that run in Python on executors: Arrow batches of a bounded size, and this package sent once per
    application."""
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    if _local(spark) or getattr(sc, "_lodestone_shipped", False):
        return
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-pkg-"), "lodestone_pkg.zip")
    with zipfile.ZipFile(path, "w") as out:
        for base, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._lodestone_shipped = True
