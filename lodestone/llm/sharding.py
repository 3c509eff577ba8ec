"""Sharding through fixed virtual slots and a versioned slot-to-shard map. Only DataFrame functions are used.

Every record hashes into one of ``SLOTS`` virtual slots. Sizes are summed per slot (SLOTS rows, whatever the input),
and a map from slots to shards is stored as a numbered version. Rebalancing never rehashes a record: it writes the next
version of the map, in which only the slots that have to move change their shard.

``shard`` places by the newest version of a stored map and writes version 1 where there is none; ``rebalance`` reads the newest
version, edits it by the present bytes of the slots and for the number of shards asked for, stores it as the next one and
places by that. Readers may ask for any older version.

A slot map is made on the driver from the SLOTS slot sums; it's the only thing collected, and its size is fixed. Places are
counted per slot and salt, and a slot that holds many rows (one text repeated under one id) has as many salts as it needs.

Defined results: a null text has no bytes (size 1, CRC 0); null ids hash like any value; repeated rows are separate
records; an empty table gives an empty result and an all-round-robin map; further columns are passed over.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import materialised, scratch_path

#: Virtual slots; fixed for the life of a data set.
SLOTS = 8192
#: Part of all rows that one slot and salt holds at most (about).
SHARES = 256
MAP = "version int, vslot int, shard int, bytes long, rows long"


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, size (UTF-8 bytes plus 1), text_crc32, vslot, __row; written once, so that the text is read a single time."""
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    base = df.select(
        F.col(f"`{id_col}`").alias("__id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32")
    )
    slot = F.pmod(F.xxhash64("__id", "text_crc32", "size"), F.lit(SLOTS)).cast("int")
    return materialised(base.withColumns({"vslot": slot, "__row": F.monotonically_increasing_id()}), "shard-records")


def slot_sums(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any: at most SLOTS entries."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["vslot"]: (r["b"], r["n"]) for r in found}


def first_map(sums: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """Heaviest slot first, each to the shard with the fewest bytes so far; empty slots in turn."""
    loads = [(0, s) for s in range(shards)]
    heapq.heapify(loads)
    out: dict[int, int] = {}
    for slot in sorted(sums, key=lambda k: (-sums[k][0], k)):
        load, shard = heapq.heappop(loads)
        out[slot] = shard
        heapq.heappush(loads, (load + sums[slot][0], shard))
    for slot in range(SLOTS):
        out.setdefault(slot, slot % shards)
    return out


def rebalanced(old: dict[int, int], sums: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version of a map: slots leave only shards above their fair share, for shards below theirs.

    A slot moves when its move brings giver and taker nearer to the mean; removed shards give everything.
    """
    out = dict(old)
    load = dict.fromkeys(range(shards), 0)
    held: dict[int, list[int]] = {}
    for slot, shard in old.items():
        load[shard] = load.get(shard, 0) + sums.get(slot, (0, 0))[0]
        held.setdefault(shard, []).append(slot)
    mean = sum(load.values()) / shards
    takers = [(load[s], s) for s in range(shards)]
    heapq.heapify(takers)
    givers = sorted(held, key=lambda s: (s < shards, -load[s], s))
    for giver in givers:
        for slot in sorted(held[giver], key=lambda k: (-sums.get(k, (0, 0))[0], k)):
            size = sums.get(slot, (0, 0))[0]
            while takers and takers[0][0] != load[takers[0][1]]:
                heapq.heappop(takers)
            if not takers:
                break
            low, taker = takers[0]
            if taker == giver:
                break
            if giver < shards and not (load[giver] - size >= mean - size / 2 and low + size <= mean + size / 2 and size):
                continue
            out[slot] = taker
            load[giver] -= size
            load[taker] = low + size
            heapq.heapreplace(takers, (load[taker], taker))
            if giver < shards:
                heapq.heappush(takers, (load[giver], giver))
    return out


def write_map(spark: SparkSession, path: str, version: int, mapping: dict[int, int], sums: dict[int, tuple[int, int]]) -> None:
    """Version folders are written once and never changed."""
    rows = [(version, slot, shard, *map(int, sums.get(slot, (0, 0)))) for slot, shard in sorted(mapping.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/version={version:06d}-map")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version:06d}-map")


def newest(spark: SparkSession, path: str) -> int:
    """The number of the newest version stored under path, 0 if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MAP).parquet(f"{path}/version=*-map").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    except AnalysisException:  # no such folder
        return 0


def place(rows: DataFrame, mapping: DataFrame, sums: dict[int, tuple[int, int]]) -> DataFrame:
    """records() with their shard and gapless place there.

    Places are counted per virtual slot and salt and offset by those before in the shard, so no task sees a whole shard.
    """
    spark = rows.sparkSession
    least = max(1, sum(n for _, n in sums.values()) // SHARES)
    salted = {slot: -(-n // least) for slot, (_, n) in sums.items() if n > least}
    salts = spark.createDataFrame([(k, v) for k, v in sorted(salted.items())], "vslot int, __salts int")
    rows = rows.join(F.broadcast(salts), "vslot", "left")  # SHARES rows at most
    rows = materialised(rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.coalesce("__salts", F.lit(1)))).drop("__salts"), "shard-salts")
    counts = rows.groupBy("vslot", "__salt").agg(F.count("*").alias("__n"))  # SLOTS and twice SHARES rows at most
    order = Window.partitionBy("shard").orderBy("vslot", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = mapping.select("vslot", "shard").join(F.broadcast(counts), "vslot").withColumn("__start", F.coalesce(F.sum("__n").over(order), F.lit(0)))
    within = Window.partitionBy("vslot", "__salt").orderBy("__row")
    return (
        rows.withColumn("__at", F.row_number().over(within) - 1)
        .join(F.broadcast(starts.select("vslot", "__salt", "shard", "__start")), ["vslot", "__salt"])
        .withColumn("slot", (F.col("__start") + F.col("__at")).cast("long"))
        .select("__id", "size", "text_crc32", "vslot", "shard", "slot")
    )


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, version: int | None = None) -> DataFrame:
    """id, size, text_crc32, vslot, shard, slot by a stored map: the version asked for, else the newest, else a new first one."""
    spark = df.sparkSession
    rows = records(df, id_col, text_col)
    path = path or scratch_path(spark, "shard-map")
    sums = slot_sums(rows)
    version = version or newest(spark, path)
    if not version:
        version = 1
        write_map(spark, path, version, first_map(sums, shards), sums)
    return place(rows, read_map(spark, path, version), sums).withColumnRenamed("__id", id_col)


def rebalance(df: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As shard(), by the next version of the map under path: edited for the present records and this number of shards."""
    spark = df.sparkSession
    rows = records(df, id_col, text_col)
    sums = slot_sums(rows)
    version = newest(spark, path)
    if not version:
        raise ValueError(f"no map under {path}")
    old = {r["vslot"]: r["shard"] for r in read_map(spark, path, version).collect()}  # SLOTS rows
    write_map(spark, path, version + 1, rebalanced(old, sums, shards), sums)
    return place(rows, read_map(spark, path, version + 1), sums).withColumnRenamed("__id", id_col)
