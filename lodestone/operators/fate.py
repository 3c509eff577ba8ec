"""What becomes of a batch's files: copies that are verified, then a commit, then the fate of the sources.

    home/intent/<batch>/    what's to be kept where: name, sha, decision, place
    home/copies/<batch>/    place, content
    home/checked/<batch>/   place, verified: the stored copy, read back, has the intended hash
    home/receipts/<batch>/  a row for each file with its decision, place and its source's fate
    home/commits/<batch>    the batch counts from here on

A step whose table is complete isn't done again, and nothing of a batch shows, in the corpus or in the inbox, before its
commit. So a run that's killed between any two steps, or within one, is run again with the same batch id and ends in the same
state; a batch that's committed stays as it is.

Fates: a source is removed if its bytes are kept (verified here, or the same bytes lie in the archive or were placed by this
batch), or if it's no content (a system's trace); it's kept if its copy failed; everything else is returned. An archive is
judged by its members: kept if one failed, returned if one would be lost, else removed; members have no fate of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.intake import ancestors
from lodestone.session import finished, write_bytes

# Where decisions put a file.
PLACES = {"accept": "corpus", "review": "queue", "quarantine": "quarantine"}
STEPS = ["intent", "copies", "checked", "receipts", "commit"]


class Stopped(Exception):
    """The run was told to stop after a step."""


def committed(spark: SparkSession, home: str) -> list[str]:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{home}/commits/*")
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().getName() for x in found or [])


def _intent(verdicts: DataFrame, batch: str) -> DataFrame:
    folder = F.coalesce(*[F.when(F.col("decision") == d, p) for d, p in PLACES.items()])
    return verdicts.where(folder.isNotNull()).select("name", "sha", "decision", F.concat_ws("/", folder, F.lit(batch), F.col("name")).alias("place"))


def _receipts(verdicts: DataFrame, intent: DataFrame, checked: DataFrame, known: DataFrame) -> DataFrame:
    placed = intent.join(checked, "place", "left").select("name", "place", F.coalesce("verified", F.lit(False)).alias("verified"))
    held = intent.join(checked.where("verified"), "place").select("sha").unionByName(known.select("sha")).distinct().withColumn("held", F.lit(True))
    rows = verdicts.join(placed, "name", "left").join(held, "sha", "left")
    rows = rows.withColumn("failed", F.col("verified").isNotNull() & ~F.col("verified"))
    kept = F.coalesce("verified", F.lit(False)) | (F.col("decision") == "duplicate") & F.coalesce("held", F.lit(False))
    spare = (F.col("decision") == "skip") & F.coalesce(F.col("skipped_as") == "trace", F.lit(False))
    rows = rows.withColumn("safe", kept | spare)
    inside = rows.where("archive is not null").select("failed", (~F.col("safe") & ~F.col("failed") & (F.col("family") != "archive")).alias("lost"), F.explode(ancestors(F.col("name"))).alias("of"))
    members = inside.groupBy(F.col("of").alias("name")).agg(F.bool_or("failed").alias("broken"), F.bool_or("lost").alias("lost"))
    archive = F.when(F.coalesce("broken", F.lit(False)) | F.col("failed") | (F.col("decision") == "quarantine") & ~F.coalesce("verified", F.lit(False)), "kept").when(F.coalesce("lost", F.lit(False)), "returned").otherwise("removed")
    single = F.when(F.col("failed"), "kept").when(F.col("safe"), "removed").otherwise("returned")
    fate = F.when(F.col("archive").isNull(), F.when(F.col("family") == "archive", archive).otherwise(single))
    return rows.join(members, "name", "left").select("name", "decision", "verified", F.when(F.col("verified"), F.col("place")).alias("path"), fate.alias("fate"))


def settle(spark: SparkSession, home: str, batch: str, verdicts: DataFrame, contents: DataFrame, known: DataFrame, stop_after: str | None = None) -> DataFrame:
    """The batch's receipts: name, decision, verified, path, fate (null for members of archives).

    verdicts: name (unique), decision, sha, family, archive (the one it lies in, or null), skipped_as; contents: name, content
    (binary), a missing one fails; known: sha of what the archive has. stop_after: for tests, a step after which to give up.
    """
    table = lambda step: f"{home}/{step}/{batch}"

    def step(name: str, made) -> DataFrame:
        if batch not in committed(spark, home) and not finished(spark, table(name)):
            made().write.mode("overwrite").parquet(table(name))
            if stop_after == name:
                raise Stopped(name)
        return spark.read.parquet(table(name))

    intent = step("intent", lambda: _intent(verdicts, batch))
    copies = step("copies", lambda: intent.select("name", "place").join(contents, "name").select("place", "content"))
    checked = step("checked", lambda: copies.join(intent, "place").select("place", (F.sha2("content", 256) == F.col("sha")).alias("verified")))
    receipts = step("receipts", lambda: _receipts(verdicts, intent, checked, known))
    if batch not in committed(spark, home):
        write_bytes(spark, f"{home}/commits/{batch}", b"")
        if stop_after == "commit":
            raise Stopped("commit")
    return receipts


def corpus(spark: SparkSession, home: str) -> DataFrame:
    """batch, place, content of all verified copies of committed batches."""
    batches = committed(spark, home)
    if not batches:
        return spark.createDataFrame([], "batch string, place string, content binary")
    parts = []
    for batch in batches:
        good = spark.read.parquet(f"{home}/checked/{batch}").where("verified").select("place")
        parts.append(spark.read.parquet(f"{home}/copies/{batch}").join(good, "place", "left_semi").select(F.lit(batch).alias("batch"), "place", "content"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def left_in_inbox(spark: SparkSession, home: str, names: DataFrame) -> DataFrame:
    """names (name) without those that a committed batch removed or returned."""
    batches = committed(spark, home)
    if not batches:
        return names
    gone = spark.read.parquet(*[f"{home}/receipts/{b}" for b in batches]).where(F.col("fate").isin("removed", "returned")).select("name")
    return names.join(gone, "name", "left_anti")
