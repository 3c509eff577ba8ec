"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, and learned filters of ``4 * TAPS`` bytes slide over them in steps of 4. Chunks of
``CHUNK`` steps, each overlapping the one before by a quarter, cover the whole text; a filter's response in a chunk is
its maximum there. Over the chunks of a text the responses' maximum, mean and minimum, with the number of steps in a
chunk, go through one hidden layer to one probability.

The network is fitted on the driver on at most ``SAMPLE`` labelled texts of each label (chosen by a hash of their id, among
those no longer than ``LONGEST`` bytes, and as many as ``SAMPLE_BYTES`` hold, each used whole); scoring reads every text whole. Only the text is an input.

Defined results: null and empty texts are scored as the empty text; equal texts have equal scores; where the sample
lacks one of the labels every score is 0.5; rows with a null id are scored, and never learned from; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.session import materialised, ship_package

STRIDE = 4
TAPS = 3
WIDTH = 4  # numbers an embedded byte has
FILTERS = 64
HIDDEN = 24
CHUNK = 128
STEP = 96
#: Labelled texts of each label to learn from, the longest of them in bytes, and rounds over them.
SAMPLE = 1600
LONGEST = 100_000
#: Bytes of all texts of one label that the driver holds.
SAMPLE_BYTES = 48_000_000
EPOCHS = 10
SEED = 11
BAR = 0.3
#: Bytes that are convolved at once.
BLOCK = 131_072


def steps(n: int) -> int:
    return max(1, -(-n // STRIDE))


def chunk_count(n_steps: int) -> int:
    return 1 if n_steps <= CHUNK else 1 + -(-(n_steps - CHUNK) // STEP)


class Network:
    """Weights, with scoring and fitting."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.fitted = False
        f32 = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.w = {
            "embed": f32(256, WIDTH, scale=0.5),
            "conv": f32(STRIDE * WIDTH, TAPS * FILTERS, scale=(TAPS * STRIDE * WIDTH) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32),
            "in": f32(3 * FILTERS + 1, HIDDEN, scale=(3 * FILTERS) ** -0.5),
            "in_bias": np.zeros(HIDDEN, np.float32),
            "out": f32(HIDDEN, scale=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }
        self.w["embed"][0] = 0

    def convolve(self, raw: np.ndarray) -> np.ndarray:
        """Responses before the bias of bytes whose number is a multiple of STRIDE: a row per step, TAPS - 1 fewer."""
        parts = self.w["embed"][raw].reshape(-1, STRIDE * WIDTH) @ self.w["conv"]
        n = len(parts) - TAPS + 1
        out = parts[:n, :FILTERS].copy()
        for t in range(1, TAPS):
            out += parts[t : t + n, t * FILTERS : (t + 1) * FILTERS]
        return out

    def pooled(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all chunks of all texts, and how many chunks each text has."""
        counts = np.array([chunk_count(steps(len(r))) for r in raws])
        out = np.empty((int(counts.sum()), FILTERS), np.float32)
        at, held, buffer, starts, ends = 0, 0, [], [], []

        def flush() -> None:
            nonlocal at, held, buffer, starts, ends
            if buffer:
                found = self.convolve(np.frombuffer(b"".join(buffer) + bytes(STRIDE * TAPS), np.uint8))
                edges = np.stack([starts, ends], axis=1).ravel()
                out[at : at + len(starts)] = np.maximum.reduceat(found, edges, axis=0)[::2]
                at += len(starts)
            held, buffer, starts, ends = 0, [], [], []

        for raw in raws:
            n = steps(len(raw))
            for first in range(0, chunk_count(n), BLOCK // (STRIDE * STEP)):  # a long text goes in parts, by whole chunks
                last = min(first + BLOCK // (STRIDE * STEP), chunk_count(n))
                a, b = first * STEP, min(n, (last - 1) * STEP + CHUNK)
                part = raw[a * STRIDE : (b + TAPS - 1) * STRIDE]
                part += bytes((b - a + TAPS - 1) * STRIDE - len(part))
                base = held // STRIDE
                for k in range(first, last):
                    starts.append(base + k * STEP - a)
                    ends.append(base + min(n, k * STEP + CHUNK) - a)
                buffer.append(part)
                held += len(part)
                if held >= BLOCK:
                    flush()
        flush()
        return np.maximum(out + self.w["bias"], 0), counts

    @staticmethod
    def combined(chunks: np.ndarray, counts: np.ndarray, n_steps: np.ndarray) -> np.ndarray:
        starts = np.cumsum(counts) - counts
        size = np.log1p(np.minimum(n_steps, CHUNK)).astype(np.float32)[:, None] / 5
        mean = np.add.reduceat(chunks, starts, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([np.maximum.reduceat(chunks, starts, axis=0), mean, np.minimum.reduceat(chunks, starts, axis=0), size], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if not texts:
            return np.empty(0)
        if not self.fitted:
            return np.full(len(texts), 0.5)
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        x = self.combined(*self.pooled(raws), np.array([steps(len(r)) for r in raws]))
        h = np.maximum(x @ self.w["in"] + self.w["in_bias"], 0)
        return 1 / (1 + np.exp(-(h @ self.w["out"] + self.w["out_bias"][0]).astype(np.float64)))

    # ------------------------------------------------------------ fitting

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> "Network":
        """Adam on the cross-entropy, each label weighing half."""
        y = np.array(labels, np.float32)
        if not len(y) or y.min() == y.max():
            return self
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        share = y.mean()
        weigh = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        done = 0
        for epoch in range(epochs):
            rate = 4e-3 * (1 - epoch / epochs) + 2e-4
            batch: list[int] = []
            held = 0
            order = rng.permutation(len(y)).tolist()
            for k in [*order, -1]:
                if batch and (k < 0 or len(batch) >= 48 or held + len(raws[k]) > BLOCK):
                    grads = self.gradients([raws[i] for i in batch], y[batch], weigh[batch])
                    done += 1
                    for name, g in grads.items():
                        first[name] += 0.1 * (g - first[name])
                        second[name] += 0.01 * (g * g - second[name])
                        up = first[name] / (1 - 0.9**done)
                        self.w[name] -= rate * up / (np.sqrt(second[name] / (1 - 0.99**done)) + 1e-8)
                    self.w["embed"][0] = 0
                    batch, held = [], 0
                if k >= 0:
                    batch.append(k)
                    held += len(raws[k])
        self.fitted = True
        return self

    def gradients(self, raws: list[bytes], y: np.ndarray, weigh: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        n_steps = np.array([steps(len(r)) for r in raws])
        counts = np.array([chunk_count(int(n)) for n in n_steps])
        padded = [r + bytes((int(n) + TAPS - 1) * STRIDE - len(r)) for r, n in zip(raws, n_steps)]
        base = np.cumsum([0, *[len(p) // STRIDE for p in padded]])
        raw = np.frombuffer(b"".join(padded) + bytes(STRIDE * TAPS), np.uint8)
        found = self.convolve(raw)
        starts = np.concatenate([base[i] + np.arange(c) * STEP for i, c in enumerate(counts)])
        owner = np.repeat(np.arange(len(raws)), counts)
        ends = np.minimum(starts + CHUNK, base[owner] + n_steps[owner])
        where = np.stack([a + found[a:b].argmax(axis=0) for a, b in zip(starts, ends)])  # step of each chunk's maxima
        top = found[where, np.arange(FILTERS)] + w["bias"]
        chunks = np.maximum(top, 0)
        x = self.combined(chunks, counts, n_steps)
        z = x @ w["in"] + w["in_bias"]
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-(h @ w["out"] + w["out_bias"][0])))
        d = ((p - y) * weigh / len(y)).astype(np.float32)
        g = {"out": h.T @ d, "out_bias": np.array([d.sum()], np.float32)}
        dz = np.outer(d, w["out"]) * (z > 0)
        g["in"], g["in_bias"] = x.T @ dz, dz.sum(axis=0)
        dx = dz @ w["in"].T
        dmax, dmean, dmin = dx[:, :FILTERS], dx[:, FILTERS : 2 * FILTERS], dx[:, 2 * FILTERS : 3 * FILTERS]
        dc = (dmean / counts[:, None].astype(np.float32))[owner]
        first = np.cumsum(counts) - counts
        for part, value in ((dmax, x[:, :FILTERS]), (dmin, x[:, 2 * FILTERS : 3 * FILTERS])):
            hit = chunks == value[owner]
            dc = dc + hit / np.add.reduceat(hit, first, axis=0, dtype=np.float32)[owner] * part[owner]
        dc = dc * (top > 0)
        g["bias"] = dc.sum(axis=0)
        embedded = w["embed"][raw].reshape(-1, STRIDE * WIDTH)
        g["conv"] = np.empty_like(w["conv"])
        de = np.zeros_like(embedded)
        for t in range(TAPS):
            columns = slice(t * FILTERS, (t + 1) * FILTERS)
            windows = embedded[where + t]  # chunks x filters x taps
            g["conv"][:, columns] = np.einsum("cf,cfk->kf", dc, windows)
            np.add.at(de, (where + t).ravel(), (dc[:, :, None] * w["conv"].T[None, columns]).reshape(-1, STRIDE * WIDTH))
        g["embed"] = np.zeros_like(w["embed"])
        flat = de.reshape(-1, WIDTH)
        for k in range(WIDTH):
            g["embed"][:, k] = np.bincount(raw, flat[:, k], 256)
        return g


def held_out(id_col: str):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network fitted to labels.quality on at most `sample` texts of each label; ids with crc32 % 5 = 0 are kept out."""
    known = labels.select(F.col(id_col).alias("__id"), F.col("quality").cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    known = known.where(F.crc32(F.col("__id").cast("string").cast("binary")) % 5 != 0)
    texts = documents.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    texts = texts.withColumn("__th", F.xxhash64("__text")).where(F.octet_length("__text") <= longest)
    sized = materialised(texts.select("__id", "__th", F.octet_length("__text").alias("__size")).join(known, "__id"), "labelled-sizes")
    chosen: list[tuple] = []
    for label in (0, 1):
        left = SAMPLE_BYTES
        for r in sized.where(F.col("__y") == label).orderBy(F.xxhash64("__id"), "__id", "__th").limit(sample).collect():
            left -= r["__size"]
            if left >= 0:
                chosen.append((r["__id"], r["__th"], label))
    if not chosen:
        return Network()
    kind = texts.schema["__id"].dataType.simpleString()
    wanted = documents.sparkSession.createDataFrame(chosen, f"__id {kind}, __th long, __y int").distinct()
    rows = (
        texts.join(F.broadcast(wanted), ["__id", "__th"])  # 2 * sample rows at most
        .dropDuplicates(["__id", "__th", "__y"]).orderBy(F.xxhash64("__id"), "__id", "__y", "__th").collect()
    )
    return Network().fit([r["__text"] for r in rows], [r["__y"] for r in rows])


def score(df: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row."""
    ship_package(df.sparkSession)
    narrow = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    kind = narrow.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(network.score(texts))], ["__id", "score"])

    return narrow.mapInArrow(run, f"__id {kind}, score double").withColumnRenamed("__id", id_col)


def keep_good(df: DataFrame, network: Network, text_col: str = "text", bar: float = BAR) -> DataFrame:
    """The rows of df that score at least bar, unchanged."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text_col):
            yield part.filter(pa.array(network.score(texts) >= bar))

    return df.mapInArrow(run, df.schema)
