"""A stored full-text index that is kept up: segments that never change, deletions beside them, merges, and exact search that
reads only where the best rows can be.

    home/segments/<id>/postings   term, range, n, max_tf, min_size, held: the chunks of a range that hold a term (slot, frequency and
                                  size of each, as 32-bit integers), and what these can score at most; in folders by a hash of
                                  the term, sorted by term and range
    home/segments/<id>/chunks     range, slot, path, chunk, size; a slot is a chunk's place in its range
    home/deleted/<id>/            segment, range, slot, path, chunk, size of deleted chunks
    home/commits/<n>              the segments and deletions of version n, made only if it isn't there yet

``append`` adds a segment, ``delete`` names the chunks of paths, ``merge`` writes one segment without them. What's appended is
written in one pass, where it's read, so that each folder has a file for each task; a merge shuffles them together. Readers take the
newest commit, so a writer that dies leaves nothing that anyone sees, and two writers from one version can't both succeed.

``best`` is the same as over a fresh index of what's there. Document frequencies, the number of chunks and their mean size are
those of the live chunks: deleted ones are counted off, in the ranges that hold them. A range of ``RANGE`` chunks can't score
higher than its largest frequency at its smallest size, for each word; the ranges of the highest bounds are scored first, and
after that only those whose bound reaches the n-th score found. All other postings of the words stay unread.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.search import CANDIDATES, K1, B
from lodestone.session import materialised, moved, ship_package, write_bytes

#: Folders of a segment's postings, and chunks of a range.
BUCKETS = 64
RANGE = 64
#: The folder of rows that are no postings, while a segment is written.
NO_TERM = -1
CHUNKS = "range long, slot int, path string, chunk int, size double"
POSTINGS = "term string, range long, n long, max_tf double, min_size double, held binary"
KEY = f"segment string, {CHUNKS}"


class Conflict(Exception):
    """Another writer has committed since the version that a change started from."""


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _foldered(rows: DataFrame, path: str) -> None:
    rows.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(path)


def words_of(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def _bytes(ends: np.ndarray, entries: np.ndarray) -> pa.Array:
    """Rows of three 32-bit integers as binary values, which end at the given numbers of rows (the first: 0)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 12).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(entries, np.dtype("<i4")))])


def _entries(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of entries of each value, and all entries."""
    n = pc.binary_length(held).to_numpy(zero_copy_only=False).astype(np.int64) // 12
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    return n, np.frombuffer(held.buffers()[2], np.dtype("<i4"), (ends[-1] - ends[0]) // 4, ends[0]).reshape(-1, 3)


def _listed(width: int):
    """id, path, chunk, tokens -> a row for each term of a range, and a row without a term for each chunk."""
    names = ["term", "range", "n", "max_tf", "min_size", "held", "slot", "path", "chunk", "size"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.float64()]

    def rows(count: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(count, t) if given.get(c) is None else pa.array(given[c], t) if isinstance(given[c], np.ndarray) else given[c].cast(t) for c, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            ranges, slots = ids // width, (ids % width).astype(np.int32)
            size = pc.list_value_length(batch.column(3)).to_numpy().astype(np.int32)
            yield rows(len(ids), range=ranges, slot=slots, path=batch.column(1), chunk=batch.column(2), size=size.astype(np.float64))
            held = batch.column(3).flatten().dictionary_encode()
            if not len(held):
                continue
            pairs, tf = np.unique(held.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), size), return_counts=True)
            code, row = pairs // len(ids), pairs % len(ids)
            start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (ranges[row[1:]] != ranges[row[:-1]])])
            ends = np.r_[start, len(pairs)]
            yield rows(
                len(start), term=held.dictionary.take(pa.array(code[start])), range=ranges[row[start]], n=np.diff(ends), max_tf=np.maximum.reduceat(tf, start).astype(np.float64),
                min_size=np.minimum.reduceat(size[row], start).astype(np.float64), held=_bytes(ends, np.column_stack([slots[row], tf, size[row]])),
            )

    return run


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings and the deleted slots of their ranges (gone, or null) -> what's left of them."""
    names = ["term", "range", "n", "max_tf", "min_size", "held"]
    for batch in batches:
        if not batch.num_rows:
            continue
        n, entries = _entries(batch.column("held"))
        row, gone = np.repeat(np.arange(len(n)), n), batch.column("gone")
        off = np.repeat(np.arange(len(n)), pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))
        slots = gone.flatten().to_numpy(zero_copy_only=False)
        dead = np.zeros((len(n), 1 + max(entries[:, 0].max(initial=0), slots.max(initial=0))), bool)
        dead[off, slots] = True
        keep = ~dead[row, entries[:, 0]]
        row, entries = row[keep], entries[keep]
        if not len(row):
            continue
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        ends, some = np.r_[start, len(row)], pa.array(row[start])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("term").take(some), batch.column("range").take(some), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(entries[:, 1], start).astype(np.float64)),
                pa.array(np.minimum.reduceat(entries[:, 2], start).astype(np.float64)), _bytes(ends, entries),
            ],
            names,
        )


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """segment, range, term, held -> a row for each entry."""
    for batch in batches:
        n, entries = _entries(batch.column("held")) if batch.num_rows else (np.empty(0, np.int64), np.empty((0, 3), np.int32))
        row = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in ("segment", "range", "term")], *[pa.array(np.ascontiguousarray(entries[:, k])) for k in range(3)]], ["segment", "range", "term", "slot", "tf", "size"])


@dataclass
class Version:
    number: int
    segments: list[str]
    deleted: list[str]


class FullText:
    """An index under a folder; a missing one is empty."""

    def __init__(self, spark: SparkSession, home: str, width: int = RANGE) -> None:
        self.spark, self.home, self.width = spark, home, width

    # ------------------------------------------------------------ versions

    def current(self) -> Version:
        sc = self.spark.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(f"{self.home}/commits/*")
        found = place.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(place)
        names = sorted(x.getPath().getName() for x in found or [] if x.getPath().getName().isdigit())
        if not names:
            return Version(0, [], [])
        held = json.loads(self.spark.read.text(f"{self.home}/commits/{names[-1]}", wholetext=True).first()[0])
        return Version(int(names[-1]), held["segments"], held["deleted"])

    def _commit(self, before: Version, segments: list[str], deleted: list[str]) -> int:
        number = before.number + 1
        try:
            write_bytes(self.spark, f"{self.home}/commits/{number:08d}", json.dumps({"segments": segments, "deleted": deleted}).encode())
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {number} of {self.home} is there already") from None
            raise
        return number

    # ------------------------------------------------------------ writing

    def append(self, docs: DataFrame) -> int:
        """Index chunks (path, chunk, text); chunks of a path that's indexed already come beside the old ones."""
        before = self.current()
        ship_package(self.spark)
        tokens = F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>"))
        cut = docs.select(F.monotonically_increasing_id().alias("id"), "path", F.col("chunk").cast("int").alias("chunk"), tokens.alias("t"))
        # What a term has in a range is put together, sorted and written where its chunks are read; ranges are handed out once.
        listed = cut.mapInArrow(_listed(self.width), f"{POSTINGS}, slot int, path string, chunk int, size double")
        name = uuid.uuid4().hex
        place = f"{self.home}/segments/{name}"
        _foldered(listed.withColumn("bucket", F.when(F.col("term").isNull(), NO_TERM).otherwise(_bucket(F.col("term")))), f"{place}/postings")
        moved(self.spark, f"{place}/postings/bucket={NO_TERM}", f"{place}/chunks")
        return self._commit(before, [*before.segments, name], before.deleted)

    def delete(self, paths: DataFrame) -> int:
        """Take the chunks of paths (path) out of what searches find."""
        before = self.current()
        name = uuid.uuid4().hex
        gone = self._live_chunks(before).join(paths.select("path").distinct(), "path", "left_semi")
        gone.select("segment", "range", "slot", "path", "chunk", "size").write.parquet(f"{self.home}/deleted/{name}")
        return self._commit(before, before.segments, [*before.deleted, name])

    def merge(self) -> int:
        """One segment of all live chunks, in place of all segments and deletions."""
        before = self.current()
        ship_package(self.spark)
        # Ranges of several segments are laid behind each other.
        found = self._read(before, "chunks", CHUNKS).groupBy("segment").agg((F.max("range") + 1).alias("end")).collect()  # a row for each segment
        ends, first, at = {r["segment"]: r["end"] for r in found}, {}, 0
        for segment in before.segments:
            first[segment], at = at, at + ends.get(segment, 0)
        lists, chunks = self._read(before, "postings", POSTINGS, first=first).drop("segment"), self._read(before, "chunks", CHUNKS, first=first).drop("segment")
        if before.deleted:
            starts = self.spark.createDataFrame(list(first.items()), "segment string, first long")
            gone = self._deleted(before).join(F.broadcast(starts), "segment").select((F.col("range") + F.col("first")).alias("range"), "slot")  # a row for each segment
            chunks = chunks.join(gone, ["range", "slot"], "left_anti")
            # A table whose size is known: a small one is broadcast, and the postings aren't shuffled for it.
            slots = materialised(gone.groupBy("range").agg(F.collect_set("slot").alias("gone")), "gone")  # a range's slots at most
            lists = lists.join(slots, "range", "left")
            lists = lists.select(*[c.split()[0] for c in POSTINGS.split(", ")], "gone").mapInArrow(_left, POSTINGS)
        name = uuid.uuid4().hex
        place = f"{self.home}/segments/{name}"
        chunks.write.parquet(f"{place}/chunks")
        # A term's postings are dealt by range, so that a word that stands everywhere is in no single task.
        dealt = lists.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("range"), F.lit(16)))
        _foldered(dealt, f"{place}/postings")
        return self._commit(before, [name], [])

    # ------------------------------------------------------------ reading

    def _read(self, version: Version, part: str, schema: str, buckets: list[int] | None = None, first: dict[str, int] | None = None) -> DataFrame:
        """A part of all segments, with the segment; its ranges begin with its first one, if these are given."""
        out = None
        for name in version.segments:
            rows = self.spark.read.schema(f"{schema}, bucket int" if part != "chunks" else schema).parquet(f"{self.home}/segments/{name}/{part}")
            if buckets is not None:
                rows = rows.where(F.col("bucket").isin(buckets))
            rows = rows.drop("bucket").withColumn("segment", F.lit(name))
            if first is not None:
                rows = rows.withColumn("range", F.col("range") + F.lit(first[name]))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], f"{schema}, segment string")

    def _deleted(self, version: Version) -> DataFrame:
        paths = [f"{self.home}/deleted/{d}" for d in version.deleted]
        return self.spark.read.schema(KEY).parquet(*paths) if paths else self.spark.createDataFrame([], KEY)

    def _live_chunks(self, version: Version) -> DataFrame:
        rows = self._read(version, "chunks", CHUNKS)
        return rows.join(self._deleted(version).select("segment", "range", "slot"), ["segment", "range", "slot"], "left_anti") if version.deleted else rows

    def _postings(self, version: Version, words: list[str], buckets: list[int]) -> DataFrame:
        return self._read(version, "postings", POSTINGS, buckets).where(F.col("term").isin(words))

    def best(self, query: str, n: int = CANDIDATES) -> DataFrame:
        """path, chunk, bm25 of the n best live chunks for the query's words."""
        return self.explained(query, n)[0]

    def explained(self, query: str, n: int = CANDIDATES) -> tuple[DataFrame, dict[str, int]]:
        """best(), and how many postings the words have, and how many of them stand in the ranges that were scored."""
        version, words, spark = self.current(), words_of(query), self.spark
        none = spark.createDataFrame([], "path string, chunk int, bm25 double"), {"postings": 0, "read": 0}
        if not words or not version.segments:
            return none
        ship_package(spark)
        asked = spark.createDataFrame([(w,) for w in words], "term string")
        buckets = [r["b"] for r in asked.select(_bucket(F.col("term")).alias("b")).distinct().collect()]  # a word has one
        postings = self._postings(version, words, buckets)
        single = lambda df: df.select("segment", "range", "term", "held").mapInArrow(_single, "segment string, range long, term string, slot int, tf int, size int")
        # A range that was read in two batches has two rows for a term.
        bounds = postings.groupBy("segment", "term", "range").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_size").alias("min_size"))
        totals = self._read(version, "chunks", CHUNKS).agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("size")).first()
        df = {r["term"]: r["n"] for r in bounds.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each word
        docs, size = totals["docs"], totals["size"]
        if version.deleted:
            gone = self._deleted(version)
            off = gone.agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("size")).first()
            docs, size = docs - off["docs"], size - off["size"]
            ranges = gone.select("segment", "range").distinct()
            taken = single(postings.join(ranges, ["segment", "range"], "left_semi")).join(gone.select("segment", "range", "slot"), ["segment", "range", "slot"], "left_semi")
            for r in taken.groupBy("term").agg(F.count("*").alias("n")).collect():
                df[r["term"]] -= r["n"]
        words = [w for w in words if df.get(w)]
        if not docs or not words:
            return none
        mean = size / docs
        idf = F.create_map(*[x for w in words for x in (F.lit(w), F.log(F.lit(1 + (docs - df[w] + 0.5) / (df[w] + 0.5))))])
        part = lambda tf, length: F.element_at(idf, F.col("term")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        bounds = bounds.where(F.col("term").isin(words))
        ranged = bounds.groupBy("segment", "range").agg(F.sum(part(F.col("max_tf"), F.col("min_size"))).alias("most"), F.sum("n").alias("n"))
        postings, live = postings.where(F.col("term").isin(words)), self._live_chunks(version)

        def scored(ranges: DataFrame) -> DataFrame:
            inside = single(postings.join(ranges.select("segment", "range"), ["segment", "range"], "left_semi"))
            scores = inside.groupBy("segment", "range", "slot").agg(F.round(F.sum(part(F.col("tf"), F.col("size"))), 6).alias("bm25"))
            return scores.join(live.drop("size"), ["segment", "range", "slot"]).select("path", "chunk", "bm25").orderBy(F.desc("bm25"), "path", "chunk").limit(n)

        first = ranged.orderBy(F.desc("most"), "segment", "range").limit(max(1, 4 * n // self.width))
        found = scored(first).agg(F.min("bm25").alias("least"), F.count("*").alias("k")).first()
        bar = found["least"] - 1e-5 if found["k"] == n else 0.0  # scores are rounded
        reached = ranged.where(F.col("most") >= bar)
        read = reached.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return scored(reached), {"postings": sum(df[w] for w in words), "read": read}


def build(docs: DataFrame, home: str) -> str:
    """docs (path, chunk, text) indexed under home as one segment; an index that's there is an error."""
    index = FullText(docs.sparkSession, home)
    if index.current().number:
        raise Conflict(f"{home} has an index already")
    index.append(docs)
    return home


def best(spark: SparkSession, home: str, query: str, n: int = CANDIDATES) -> DataFrame:
    """path, chunk, bm25 of the n best chunks for the query's words."""
    return FullText(spark, home).best(query, n)
