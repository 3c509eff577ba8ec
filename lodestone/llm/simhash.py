"""SimHash near-duplicates through pivot distance tables.

A fingerprint is the bitwise majority over the XXH64 (seed 42) of a text's word shingles. Fingerprints link at
``MAX_BITS`` (3) or fewer differing bits, and documents are grouped by the components of those links.

Finding links without comparing all pairs, and without losing one:

1. A pivot table is written once: of every distinct fingerprint the Hamming distances to ``PIVOTS`` references. By the
   triangle inequality a pair whose distances to any reference differ by more than 3 can't link.
2. Fingerprints are cut into 6 blocks. Three changed bits touch at most 3 blocks, so two linked fingerprints agree on
   some 3 whole blocks: each row of the table is dealt to C(6, 3) = 20 buckets by block choice and the bits of those
   blocks. Within a bucket pairs are discarded by the maximum difference of their table rows, and only the survivors are
   verified on the fingerprints.
3. Small buckets give all their links, larger ones a spanning forest of them, found by a search from member to member
   that drops a member once it's reached: a dense group costs about its size, and never gives all its pairs.
4. A bucket above ``BUCKET`` members is named and read past, without being held, and dealt again: its free bits are cut
   into 9 parts of at most 4 bits, of which 6 agree, so that at most 12 bits stay free and no bucket can hold more than
   4096 fingerprints.

Components come from star contraction over the links in tables; nothing about documents goes to the driver.
``drop_near_duplicates`` takes wider links (five words, similarity 0.8): see wide.py.

Defined results: null counts as empty; a text of fewer words than a shingle gives one shingle, a text of none the
fingerprint zero, which links like any other; rows with equal texts have equal fingerprints; a null id is never the
smallest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.llm.components import components
from lodestone.session import materialised, ship_package

MAX_BITS = 3
SHINGLE = 3
PIVOTS = 16
#: Members of a bucket that one task compares; larger buckets are dealt again.
BUCKET = 16_384
#: Up to so many members a bucket gives all its links.
SMALL = 8

_WIDTHS = (11, 11, 11, 11, 10, 10)


def _mask(start: int, width: int) -> int:
    return ((1 << width) - 1) << start


_BLOCKS = [_mask(sum(_WIDTHS[:i]), w) for i, w in enumerate(_WIDTHS)]
#: Of each of the 20 choices: the bits that agree, and the blocks that stay free.
CHOICES = [(sum(_BLOCKS[i] for i in held), [i for i in range(6) if i not in held]) for held in combinations(range(6), 3)]


def second_masks(choice: int) -> list[int]:
    """For a bucket dealt again: the masks, within its free blocks, of the bits that agree in each of 84 choices."""
    parts = []
    for block in CHOICES[choice][1]:
        start, width = sum(_WIDTHS[:block]), _WIDTHS[block]
        for at in range(0, width, 4):
            parts.append(_mask(start + at, min(4, width - at)))
    return [sum(parts[i] for i in range(len(parts)) if i not in free) for free in combinations(range(len(parts)), MAX_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Reference fingerprints, by rule.
REFERENCES = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=7) for i in range(PIVOTS)], dtype=np.uint64)


def fingerprint(text: str, words_per_shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=42)
    digest = xxhash.xxh64_intdigest
    runs = zip(*[words[i:] for i in range(words_per_shingle)])
    hashes = np.fromiter([digest(b" ".join(run), 42) for run in runs], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):  # bounds the unpacked bits of a very long text
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "__text"):
            values = pa.array([_signed(fingerprint(t, words_per_shingle)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), values], ["__id", "fp"])

    return run


def pivot_columns() -> list[Column]:
    """p0, p1: the distances of fp to the references, eight to a long, a byte each."""
    def packed(refs: np.ndarray) -> Column:
        one = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(r))))).cast("long"), 8 * k) for k, r in enumerate(refs)]
        return reduce(lambda x, y: x.bitwiseOR(y), one)

    return [packed(REFERENCES[8 * k : 8 * k + 8]).alias(f"p{k}") for k in range(PIVOTS // 8)]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """The same distances as a matrix: a row per fingerprint, a column per reference."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def _near(table: np.ndarray, fps: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) link: maximum coordinate difference first, survivors on the fingerprints."""
    left = np.abs(table[j] - table[i]).max(axis=1) <= MAX_BITS
    left[left] = np.bitwise_count(fps[j[left]] ^ (fps[i] if isinstance(i, int) else fps[i[left]])) <= MAX_BITS
    return left


def bucket_links(fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints with their pivot distances, as index pairs."""
    open_, a, b = np.arange(len(fps)), [], []
    while len(open_):
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            hit = _near(table, fps, i, open_)
            if hit.any():
                found = open_[hit]
                a.append(np.full(len(found), i))
                b.append(found)
                queue += found.tolist()
                open_ = open_[~hit]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _small_links(fps: np.ndarray, table: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within buckets of one size, starts giving their first rows; vectorised over the buckets."""
    i, j = np.triu_indices(size, 1)
    first, second = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
    near = _near(table, fps, first, second)
    return first[near], second[near]


def link_buckets(keys: np.ndarray, fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole buckets, rows of a bucket side by side -> links, as values."""
    edges = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1), True])
    starts, sizes = edges[:-1], np.diff(edges)
    a, b = [], []
    for size in range(2, SMALL + 1):
        some = starts[sizes == size]
        for at in range(0, len(some), 4096):
            x, y = _small_links(fps, table, some[at : at + 4096], size)
            a.append(fps[x])
            b.append(fps[y])
    for k in np.flatnonzero(sizes > SMALL):
        own = slice(starts[k], starts[k] + sizes[k])
        x, y = bucket_links(fps[own], table[own])
        a.append(fps[own][x])
        b.append(fps[own][y])
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _links(bucket: int):
    """Rows c, s, key, fp, p0, p1 sorted by bucket -> c, s, a, b: links (c = -1), or buckets to be dealt again (a = key).

    Of a bucket no more than `bucket` members are held: one that has more is named once, and its rows are read past.
    """

    def out(c, s, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(s, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["c", "s", "a", "b"]
        )

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(rows[:, 4:]).view(np.int8)
        a, b = link_buckets(rows[:, :3], np.ascontiguousarray(rows[:, 3]).view(np.uint64), table)
        if len(a):
            yield out(np.full(len(a), -1), np.full(len(a), -1), a.view(np.int64), b.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the bucket that may go on in the next batch
        size, passed = 0, None  # how many; and the bucket that is read past
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if passed is not None:
                rows = rows[np.any(rows[:, :3] != passed, axis=1)]
                if not len(rows):
                    continue
                passed = None
            last = np.any(rows[:, :3] != rows[-1, :3], axis=1)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # where the last bucket of the batch begins
            if cut or (held and np.any(held[-1][-1, :3] != rows[-1, :3])):
                whole = np.concatenate([*held, rows[:cut]])
                many = np.any(whole[:, :3] != whole[0, :3], axis=1)
                first = int(many.argmax()) if many.any() else len(whole)  # the bucket that began before this batch
                sizes = np.diff(np.flatnonzero(np.r_[True, np.any(whole[1:, :3] != whole[:-1, :3], axis=1), True]))
                if first > bucket or (sizes > bucket).any():
                    over = np.repeat(sizes > bucket, sizes)
                    again = whole[np.flatnonzero(np.r_[True, np.any(whole[1:, :3] != whole[:-1, :3], axis=1)])[sizes > bucket]]
                    yield out(again[:, 0], again[:, 1], again[:, 2], np.zeros(len(again), np.int64))
                    whole = whole[~over]
                if len(whole):
                    yield from done(whole)
                held, size = [], 0
            held.append(rows[cut:])
            size += len(rows) - cut
            if size > bucket:
                passed = rows[-1, :3]
                yield out(passed[:1], passed[1:2], passed[2:3], np.zeros(1, np.int64))
                held, size = [], 0
        if held:
            yield from done(np.concatenate(held))

    return run


def _find(dealt: DataFrame, bucket: int) -> DataFrame:
    placed = dealt.select("c", "s", "key", "fp", "p0", "p1").repartition("c", "s", "key").sortWithinPartitions("c", "s", "key")
    return materialised(placed.mapInArrow(_links(bucket), "c int, s int, a long, b long"), "bucket-links")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """distinct: fp (each once), perhaps with its pivot table's columns -> a, b: enough links to connect all that are linked."""
    table = distinct if "p0" in distinct.columns else distinct.select("fp", *pivot_columns())
    choices = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for c, (m, _) in enumerate(CHOICES)])
    dealt = table.select("*", F.explode(choices).alias("x")).select("x.c", F.lit(0).alias("s"), "x.key", "fp", "p0", "p1")
    found = _find(dealt, bucket)
    first = found.where("c = -1").select("a", "b")
    again = found.where("c >= 0").select("c", F.col("a").alias("key"))
    if again.isEmpty():
        return first
    finer = F.when(F.lit(False), F.array().cast("array<struct<s:int,m:bigint>>"))
    for c in range(len(CHOICES)):
        masks = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(_signed(m)).cast("long").alias("m")) for s, m in enumerate(second_masks(c))])
        finer = finer.when(F.col("c") == c, masks)
    parts = dealt.join(again, ["c", "key"], "left_semi").select("c", "key", "fp", "p0", "p1", F.explode(finer).alias("x"))
    parts = parts.select("c", "x.s", F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("x.m"))).alias("key"), "fp", "p0", "p1")
    return first.union(_find(parts, max(bucket, 4096)).where("c = -1").select("a", "b"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long) of each row, written once."""
    ship_package(df.sparkSession)
    narrow = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    kind = narrow.schema["__id"].dataType.simpleString()
    return materialised(narrow.mapInArrow(_fingerprints(words), f"__id {kind}, fp long"), "fingerprints")


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id that links reach."""
    rows = fingerprints(df, id_col, text_col, words)
    least = materialised(rows.groupBy("fp").agg(F.min("__id").alias("__min")).select("*", *pivot_columns()), "pivot-table")
    stars = components(links(least.select("fp", "p0", "p1"), bucket)).select(F.col("a").alias("fp"), F.col("b").alias("__root"))
    rooted = least.select("fp", "__min").join(stars, "fp", "left").withColumn("__root", F.coalesce("__root", "fp"))
    whole = rooted.groupBy("__root").agg(F.min("__min").alias("component_id"))
    named = rooted.select("fp", "__root").join(whole, "__root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without the rows whose group has an earlier document. Groups are those of wide.groups()."""
    from lodestone.llm import wide

    return wide.drop_near_duplicates(df, id_col, text_col, words, similarity)
