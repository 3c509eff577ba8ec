"""An inverted-file index: trained cells, stored by cell, probed by partition pruning, distances exact within the probed cells.

``build`` fits the cells' centres on a bounded sample (spherical k-means on the driver) and writes every vector into its
cell's folder. ``topk`` answers many queries at once: each goes to its nearest cells, cells and queries meet in blocks of
bounded size, and only a block's n best of each query leave their task.

Vectors are stored whole. Beside each stands a code, a byte for each of its parts: the nearest of 256 trained ones. Where a
block holds more vectors than ``refine`` times n, products are first taken from the codes, and only the best so many are made
exact. With as many probes as cells, and blocks that aren't refined, the answer is exact.

Null vectors and those of length zero have no cell and aren't indexed; equal distances are ordered by id.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import materialised, ship_package, write_bytes

# Cells that a search probes, and how many times n candidates it makes exact, if it isn't told otherwise; the
# widths that a vector's parts may have, in the order they're tried.
PROBES = 400
REFINE = 30
WIDTHS = (16, 8, 4, 2)
#: Vectors that the centres are fitted on at most, and rounds over them.
SAMPLE, ROUNDS = 65_536, 8
#: Vectors, and queries, that meet in one task.
BLOCK, QUERIES = 20_000, 2_000


def cell_count(rows: int) -> int:
    """Cells by the square root of the rows, 64 to 4096."""
    return max(64, min(4096, int(rows**0.5)))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def spherical(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centres of unit vectors by k-means on the sphere; the first rows begin."""
    centres = x[:cells].copy()
    for _ in range(rounds if len(x) else 0):
        own = np.concatenate([(x[k : k + 8192] @ centres.T).argmax(axis=1) for k in range(0, len(x), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres[filled] = unit(sums[filled])
    return centres


def plain(x: np.ndarray, many: int, rounds: int) -> np.ndarray:
    """Centres by k-means; the first rows begin."""
    centres = x[:many].copy()
    for _ in range(rounds):
        own = nearest_rows(x, centres)
        sums, held = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[k : k + 8192] @ centres.T - half).argmax(axis=1) for k in range(0, len(x), 8192)] or [np.empty(0, np.int64)])


@dataclass(frozen=True)
class Index:
    """Where the vectors lie, the cells' centres, and for each part of a vector its code book (parts x 256 x width)."""

    path: str
    centres: np.ndarray
    books: np.ndarray


def trained(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centres and code books from at most `sample` vectors, chosen by a hash of their id."""
    rows = vectors.where("embedding is not null and exists(embedding, x -> x <> 0)").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    x = unit(np.array([r["embedding"] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))
    width = next((w for w in WIDTHS if x.shape[1] % w == 0), 1)
    parts = x.reshape(len(x), -1, width)
    books = np.stack([plain(np.ascontiguousarray(parts[:, k]), 256, rounds) for k in range(parts.shape[1])]) if len(x) else np.zeros((1, 1, 1))
    return spherical(x, cells, rounds), books


def _matrix(column: pa.Array) -> np.ndarray:
    """The column's vectors as unit rows; of a slice its own ones alone, which .values doesn't heed."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """A byte for each part of each vector."""
    parts = x.reshape(len(x), len(books), -1)
    return np.stack([nearest_rows(np.ascontiguousarray(parts[:, k]), books[k]) for k in range(len(books))], axis=1).astype(np.uint8)


ROW = "vec_id long, embedding array<double>, code binary, cell int"


def placed(vectors: DataFrame, index: Index, among: list[int] | None = None) -> DataFrame:
    """vectors with their codes, each in the cell of the nearest centre (of some centres, if they're given)."""
    centres = index.centres if among is None else index.centres[among]
    number = np.arange(len(index.centres)) if among is None else np.array(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                code = pa.array([row.tobytes() for row in codes(x, index.books)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(number[(x @ centres.T).argmax(axis=1)], pa.int32())], ["vec_id", "embedding", "code", "cell"])

    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and exists(embedding, x -> x <> 0)")
    return whole.mapInArrow(run, ROW)


def build(vectors: DataFrame, path: str, cells: int) -> Index:
    """vectors (vec_id, embedding) stored by cell under path, with their codes."""
    ship_package(vectors.sparkSession)
    index = Index(path, *trained(vectors, cells))
    placed(vectors, index).write.partitionBy("cell").parquet(path)
    return index


class Conflict(Exception):
    """Another writer has committed since the version that a change started from."""


class LiveIndex:
    """An inverted file that takes appends and deletions, and splits the cells that they crowd.

        home/parts/<id>/cell=<c>/   vectors with their codes, never changed
        home/deleted/<id>/          ids, of the parts that stood when they were deleted
        home/centres/<id>           centres and code books
        home/commits/<n>            the parts (each maybe without some cells), deletions and centres of version n

    New vectors go to the cells of the present centres. A cell that holds more than ``crowd`` times the mean is split: its rows are
    read alone, get centres of their own, and are written as a part of new cells; the old rows aren't read any more. Readers
    take the newest commit; of two writers from one version the later fails.
    """

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home
        ship_package(spark)

    def _names(self) -> list[str]:
        sc = self.spark.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(f"{self.home}/commits/*")
        found = place.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(place)
        return sorted(x.getPath().getName() for x in found or [] if x.getPath().getName().isdigit())

    def state(self) -> dict:
        names = self._names()
        if not names:
            return {"version": 0, "parts": {}, "deleted": {}, "centres": None}
        return json.loads(self.spark.read.text(f"{self.home}/commits/{names[-1]}", wholetext=True).first()[0])

    def _commit(self, state: dict, **changes) -> int:
        new = state | changes | {"version": state["version"] + 1}
        try:
            write_bytes(self.spark, f"{self.home}/commits/{new['version']:08d}", json.dumps(new).encode())
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {new['version']} of {self.home} is there already") from None
            raise
        return new["version"]

    def _kept(self, centres: np.ndarray, books: np.ndarray) -> str:
        name, out = uuid.uuid4().hex, io.BytesIO()
        np.savez(out, centres=centres, books=books)
        write_bytes(self.spark, f"{self.home}/centres/{name}", out.getvalue())
        return name

    def index(self, state: dict) -> Index:
        raw = self.spark.read.format("binaryFile").load(f"{self.home}/centres/{state['centres']}").select("content").first()[0]
        held = np.load(io.BytesIO(bytes(raw)))
        return Index(f"{self.home}/parts", held["centres"], held["books"])

    def _part(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.partitionBy("cell").parquet(f"{self.home}/parts/{name}")
        return name

    def rows(self, state: dict) -> DataFrame:
        """vec_id, embedding, code, cell of what's live."""
        out = self.spark.createDataFrame([], ROW)
        for name, without in state["parts"].items():
            part = self.spark.read.schema(ROW).parquet(f"{self.home}/parts/{name}")
            part = part.where(~F.col("cell").isin(without)) if without else part
            gone = [d for d, parts in state["deleted"].items() if name in parts]
            if gone:
                part = part.join(self.spark.read.schema("vec_id long").parquet(*[f"{self.home}/deleted/{d}" for d in gone]), "vec_id", "left_anti")
            out = out.unionByName(part)
        return out

    def create(self, vectors: DataFrame, cells: int) -> int:
        state = self.state()
        if state["version"]:
            raise Conflict(f"{self.home} has an index already")
        index = Index("", *trained(vectors, cells))
        return self._commit(state, centres=self._kept(index.centres, index.books), parts={self._part(placed(vectors, index)): []})

    def append(self, vectors: DataFrame) -> int:
        state = self.state()
        return self._commit(state, parts=state["parts"] | {self._part(placed(vectors, self.index(state))): []})

    def delete(self, ids: DataFrame) -> int:
        """Take ids (vec_id) out; the same ids appended later are found again."""
        state, name = self.state(), uuid.uuid4().hex
        ids.select(F.col("vec_id").cast("long")).distinct().write.parquet(f"{self.home}/deleted/{name}")
        return self._commit(state, deleted=state["deleted"] | {name: list(state["parts"])})

    def split(self, crowd: float = 3.0) -> int:
        """Split the cells that hold more than so many times the mean; the version stays where there's none."""
        state = self.state()
        index, live = self.index(state), self.rows(state)
        sizes = {r["cell"]: r["n"] for r in live.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # cells, 4096 or a few more
        mean = sum(sizes.values()) / max(1, len(index.centres))
        crowded = sorted(c for c, n in sizes.items() if n > max(1, crowd * mean))
        if not crowded:
            return state["version"]
        centres, fresh = index.centres, None
        for cell in crowded:
            own = live.where(F.col("cell") == cell)
            some = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
            more = spherical(unit(np.array([r["embedding"] for r in some], dtype=np.float64)), min(len(some), -(-sizes[cell] // max(1, int(mean)))), ROUNDS)
            among = list(range(len(centres), len(centres) + len(more)))
            centres = np.concatenate([centres, more])
            dealt = placed(own.select("vec_id", "embedding"), Index("", centres, index.books), among)
            fresh = dealt if fresh is None else fresh.unionByName(dealt)
        centres = centres.copy()
        centres[crowded] = 0.0  # the old ones stay in the list, so that cells keep their numbers, and draw nothing near
        parts = {name: sorted({*without, *crowded}) for name, without in state["parts"].items()} | {self._part(fresh): []}
        return self._commit(state, parts=parts, centres=self._kept(centres, index.books))

    def topk(self, queries: DataFrame, n: int, probes: int = PROBES, refine: int = REFINE) -> DataFrame:
        state = self.state()
        return topk(self.spark, self.index(state), queries, n, probes, refine, self.rows(state))


def topk(spark: SparkSession, index: Index, queries: DataFrame, n: int, probes: int = PROBES, refine: int = REFINE, stored: DataFrame | None = None) -> DataFrame:
    """query, vec_id, dist, place: the n nearest in the probed cells for each row of queries (query, embedding).

    stored: the rows that are searched, where they aren't all that's under the index's path."""
    centres, books = index.centres, index.books
    asked = max(1, min(probes, len(centres)))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                near = np.argsort(-(_matrix(part.column(1)) @ centres.T), axis=1, kind="stable")[:, :asked]
                rows = pa.array(np.repeat(np.arange(part.num_rows), asked))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(near.ravel(), pa.int32())], ["query", "cell"])

    q = materialised(queries.select("query", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null"), "ivf-queries")
    stored = spark.read.parquet(index.path) if stored is None else stored
    meets = materialised(q.mapInArrow(probed, "query long, cell int"), "ivf-probes")
    if asked < len(centres):
        wanted = [r["cell"] for r in meets.select("cell").distinct().collect()]  # cells, 4096 at most
        stored = stored.where(F.col("cell").isin(wanted))  # prunes folders
    size = stored.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    many = meets.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    shape = F.broadcast(size.join(many, "cell"))  # a row per cell, 4096 at most
    left = meets.join(shape, "cell").join(q, "query").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query"), F.col("groups")).alias("group"), F.col("query").alias("id"),
        "embedding", F.lit(None).cast("binary").alias("code"),
    )
    right = stored.join(shape, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups").cast("long") - 1)).alias("group"), F.col("vec_id").alias("id"),
        "embedding", "code",
    )

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["code"].isna().to_numpy()
        if not asks.any() or asks.all():
            return pd.DataFrame({"query": [], "vec_id": [], "dist": []})
        x = unit(np.stack(rows["embedding"].to_numpy()))
        ids, given = rows["id"].to_numpy(), x[~asks]
        own = ids[~asks]
        some = refine * n
        code = np.frombuffer(b"".join(rows["code"][~asks]), np.uint8).reshape(len(own), -1) if len(own) > some else None
        out = []
        for query, q in zip(ids[asks], x[asks], strict=True):
            rough = np.arange(len(own))
            if code is not None:  # what the codes say of the product with each part
                table = np.einsum("kcw,kw->kc", books, q.reshape(len(books), -1))
                rough = np.argpartition(-table[np.arange(len(books)), code].sum(axis=1), some)[:some]
            dist = np.round(1 - given[rough] @ q, 6) + 0.0  # no negative zeros
            best = np.lexsort((own[rough], dist))[:n]
            out.append(pd.DataFrame({"query": query, "vec_id": own[rough][best], "dist": dist[best]}))
        return pd.concat(out)

    found = left.unionByName(right).groupBy("cell", "block", "group").applyInPandas(nearest, "query long, vec_id long, dist double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("dist", "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= n)
