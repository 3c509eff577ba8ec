"""Repeats within a batch, taken in order of name: a file is accepted unless it repeats one accepted before it.

Two files conflict if they have the same bytes, the same message id, or the same fingerprint where one of the two has no
message id. A file that repeats an accepted one registers nothing, so what it shares with later files doesn't count: the
accepted ones are the lexicographically first independent set of the conflicts. It's found in rounds over all batches
together. Open files are dealt in blocks that follow each other in order of name, each of which is folded in order: a file
that conflicts with an accepted one of its block is a repeat, one that conflicts with an earlier open file of another block
(or with a file of its own block that's left open) stays open, all others are accepted. Open files in conflict with an
accepted one of another block are its repeats. Conflicts are never listed in pairs: between blocks a round looks at the first
open file of each key that stands in several blocks, so a key that a third of all files share costs an aggregate and a join
that Spark can split.

A chain of conflicts takes a round for each block that it leaves, and not for each of its files. When ``ROUNDS`` are done and
no more than ``REST`` files are open, one task folds these in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialised, scratch_path, ship_package

ROUNDS = 6
REST = 20_000
#: Numbers of a block: as many files at most.
BLOCK = 16_384
#: The order in which keys are asked which accepted file one repeats.
KINDS = ("mid", "sha", "fp")
#: What a block knows of a key: files that have it are accepted, or open; bare ones have no message id.
ACCEPTED, BARE_ACCEPTED, OPEN, BARE_OPEN = 1, 2, 4, 8


def _keys(files: DataFrame) -> DataFrame:
    """A row for each key of a file: at, bare (no message id), batch, kind (its place in KINDS), value."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(name).alias("value")) for k, name in enumerate(KINDS)])
    return files.select("batch", "at", F.col("mid").isNull().alias("bare"), F.explode(F.filter(each, lambda x: x["value"].isNotNull())).alias("key")).select("batch", "at", "bare", "key.kind", "key.value")


def _in_conflict(first: Column, first_bare: Column) -> Column:
    """The first of a key's files that a file conflicts with, given the first at all and the first without a message id."""
    return F.when((F.col("kind") < 2) | F.col("bare"), first).otherwise(first_bare)


def _firsts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("batch", "kind", "value").agg(F.min("at").alias("first"), F.min(F.when(F.col("bare"), F.col("at"))).alias("first_bare"))


def _fold(block: int | None):
    """Blocks of files (batch, at, sha, mid, fp, ahead) in order, each in one piece, with the verdict on each: accepted, a repeat,
    or open (null). A row without a batch comes before its file, and says that an earlier one of another block is in conflict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # by batch: what's known of each sha, message id and fingerprint
        now = ahead = None
        for batch in batches:
            rows, out = [], []
            for k, (name, at, sha, mid, fp, mark) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if mark:
                    ahead = at
                    continue
                if block and at // block != now:
                    now, held = at // block, {}
                if name not in held:
                    held[name] = {}, {}, {}
                shas, mids, fps = held[name]
                same, bare = fps.get(fp, 0), mid is None
                found = shas.get(sha, 0) | mids.get(mid, 0) | (same if bare else same & (BARE_ACCEPTED | BARE_OPEN))
                rows.append(k)
                if found & (ACCEPTED | BARE_ACCEPTED):
                    out.append(False)
                    continue
                if found or at == ahead:
                    out.append(None)
                    mark = BARE_OPEN if bare else OPEN
                else:
                    out.append(True)
                    mark = BARE_ACCEPTED if bare else ACCEPTED
                for known, value in ((shas, sha), (mids, mid), (fps, fp)):
                    if value is not None:
                        known[value] = known.get(value, 0) | mark
            done = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*done.columns[:-1], pa.array(out, pa.bool_())], [*done.schema.names[:-1], "accepted"])

    return run


def settled(files: DataFrame, rounds: int = ROUNDS, rest: int = REST) -> DataFrame:
    """at, accepted for every file (batch, at, sha, mid, fp; at: a number in order, each once)."""
    spark = files.sparkSession
    ship_package(spark)
    home, block = scratch_path(spark, "settled"), F.lit(BLOCK)
    verdict, key = "at long, accepted boolean", ["batch", "kind", "value"]
    columns = "batch string, at long, sha string, mid string, fp string"
    names = [c.split()[0] for c in columns.split(", ")]
    of = lambda at: F.floor(F.col(at) / block)
    done, open_ = 0, files.select(names)
    while n := open_.count():
        if done >= rounds and n <= rest:
            last = open_.withColumn("ahead", F.lit(False)).coalesce(1).sortWithinPartitions("at").mapInArrow(_fold(None), f"{columns}, accepted boolean")
            last.select("at", "accepted").write.parquet(f"{home}/round-{done}")
            break
        keys = _keys(open_)
        # Few keys stand in several blocks where repeats are near each other; their table's size is known when it's joined.
        firsts = keys.groupBy(key).agg(F.min("at").alias("first"), F.min(F.when(F.col("bare"), F.col("at"))).alias("first_bare"), F.max("at").alias("last"))
        shared = materialised(firsts.where(of("first") < of("last")).drop("last"), "shared")
        earlier = keys.join(shared, key).withColumn("to", _in_conflict(F.col("first"), F.col("first_bare"))).where(of("to") < of("at"))
        marks = earlier.select(*[F.lit(None).cast("string").alias(c) if c != "at" else F.col(c) for c in names], F.lit(True).alias("ahead"))
        blocks = open_.withColumn("ahead", F.lit(False)).unionByName(marks).repartition(of("at")).sortWithinPartitions("at", F.desc("ahead"))
        judged = materialised(blocks.mapInArrow(_fold(BLOCK), f"{columns}, accepted boolean"), "judged")
        taken = _firsts(_keys(judged.where("accepted")).join(shared.select(key), key, "left_semi"))
        waiting = judged.where("accepted is null").drop("accepted")
        hit = materialised(_keys(waiting).join(taken, key).where(_in_conflict(F.col("first"), F.col("first_bare")).isNotNull()).select("at").distinct(), "hit")
        judged.where("accepted is not null").select("at", "accepted").unionByName(hit.select("at", F.lit(False).alias("accepted"))).write.parquet(f"{home}/round-{done}")
        open_, done = materialised(waiting.join(hit, "at", "left_anti").select(names), "open"), done + 1
    return spark.read.schema(verdict).parquet(f"{home}/round-*") if done or n else spark.createDataFrame([], verdict)


def batch_duplicates(files: DataFrame, rounds: int = ROUNDS, rest: int = REST) -> DataFrame:
    """batch, name, accepted, duplicate_of: the accepted file that a file repeats, by message id, else bytes, else fingerprint.

    files: batch, name, sha, mid, fp; an empty key counts as none. Files of one name come in order of their keys; equal rows
    are files of their own, of which the first counts. Nulls: no key; a null batch is a batch, a null name comes first.
    """
    none = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    order = ["batch", "name", "sha", "mid", "fp"]
    ordered = files.select(F.coalesce("batch", F.lit("")).alias("batch"), F.col("batch").isNull().alias("no_batch"), "name", *map(none, KINDS)).orderBy(*order)
    ordered = materialised(ordered.withColumn("batch", F.when(F.col("no_batch"), "\0").otherwise(F.col("batch"))).withColumn("at", F.monotonically_increasing_id()), "in-order")
    verdict = settled(ordered.select("batch", "at", *KINDS), rounds, rest)
    judged = materialised(ordered.join(verdict, "at"), "verdicts")
    taken = _firsts(_keys(judged.where("accepted")))
    hits = _keys(judged.where("not accepted")).join(taken, ["batch", "kind", "value"]).withColumn("to", _in_conflict(F.col("first"), F.col("first_bare"))).where("to < at")
    best = hits.groupBy("at").agg(F.min(F.struct("kind", "to")).alias("hit")).select("at", F.col("hit.to").alias("to"))
    named = best.join(judged.select(F.col("at").alias("to"), F.col("name").alias("duplicate_of")), "to").drop("to")
    return judged.join(named, "at", "left").select(F.when(~F.col("no_batch"), F.col("batch")).alias("batch"), "name", "accepted", "duplicate_of")
