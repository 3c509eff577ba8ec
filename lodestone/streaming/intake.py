"""The intake stream: micro-batches with state in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import finished, scratch_path, table

QUIET_SECONDS = 30


def quiet_entries(changes: DataFrame, seconds: int = QUIET_SECONDS) -> DataFrame:
    """Entries whose last change is at least `seconds` before the newest one: the batch form of the quiet time."""
    last = changes.groupBy("user_id").agg(F.max("ts").alias("last"))
    now = changes.agg(F.max("ts").alias("now"))
    return last.crossJoin(F.broadcast(now)).select("user_id", (F.col("last") <= F.col("now") - F.expr(f"INTERVAL {seconds} SECONDS")).alias("ready"))  # one row


def run_once(stream: DataFrame, batch_function, checkpoint: str) -> None:
    """All that's there, in micro-batches; what a failed run has finished isn't done again."""
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch_function).start()
    q.awaitTermination()


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least event of each user over a stream of events, kept in a state table per batch (each version written once)."""
    home = scratch_path(spark, "first-seen")
    schema = table(spark, sf_dir, "events").schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
        if batch_id:
            new = new.unionByName(batch.sparkSession.read.parquet(f"{home}/v{batch_id - 1}")).groupBy("user_id").agg(F.min("event_id").alias("event_id"))
        new.write.mode("overwrite").parquet(f"{home}/v{batch_id}")
        last["id"] = batch_id

    last: dict[str, int] = {}  # stays empty where the stream holds nothing
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    run_once(stream, merge, f"{home}/progress-{uuid.uuid4().hex}")
    return spark.read.parquet(f"{home}/v{last['id']}") if last else spark.createDataFrame([], "user_id long, event_id long")


def quiet_step(state: DataFrame, snapshot: DataFrame, now, seconds: int = QUIET_SECONDS) -> DataFrame:
    """One look at the inbox: entry, size, mtime, since, ready. state: the last result; snapshot: entry, size, mtime as they are.

    An entry that has changed, or is new, counts from now; one that's gone is forgotten; it's ready after `seconds` unchanged.
    """
    old = state.select("entry", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), F.col("since").alias("__since"))
    same = (F.col("size") == F.col("__size")) & (F.col("mtime") == F.col("__mtime"))
    since = F.when(same, F.col("__since")).otherwise(now)
    return snapshot.join(old, "entry", "left").select("entry", "size", "mtime", since.alias("since"), (now - since >= seconds).alias("ready"))


STATE = "entry long, size long, mtime long, since long, ready boolean"


def watched(spark: SparkSession, looks: DataFrame, home: str, seconds: int = QUIET_SECONDS) -> DataFrame:
    """The inbox after a stream of looks at it: entry, size, mtime, since, ready.

    looks: a streaming frame of seen (the second of the look), entry, size, mtime; a micro-batch holds whole looks. The state
    after each look is a table of its own, written once under home, so a batch that's run again after a failure writes the
    same state from the same one before it.
    """
    def look(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        times = [r["seen"] for r in batch.select("seen").distinct().orderBy("seen").collect()]  # looks of one micro-batch
        for k, seen in enumerate(times):
            name = f"look-{batch_id:06d}-{k:04d}"
            before = [p for p in finished(own, f"{home}/look-*") if p.rpartition("/")[2] < name]
            state = own.read.schema(STATE).parquet(before[-1]) if before else own.createDataFrame([], STATE)
            quiet_step(state, batch.where(F.col("seen") == seen).select("entry", "size", "mtime"), F.lit(seen).cast("long"), seconds).write.mode("overwrite").parquet(f"{home}/{name}")

    run_once(looks, look, f"{home}/progress")
    states = finished(spark, f"{home}/look-*")
    return spark.read.schema(STATE).parquet(states[-1]) if states else spark.createDataFrame([], STATE)
