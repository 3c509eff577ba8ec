"""Best-fit packing of token sequences through a configuration linear program.

Documents are cut into pieces of at most ``CAPACITY`` tokens; packing sees only the histogram of piece lengths (at most
CAPACITY numbers, whatever the input), which is collected to the driver.

1. A configuration is a multiset of lengths that fits a sequence. The linear program asks for amounts of configurations
   that cover the histogram, one constraint for each length, with the fewest sequences.
2. It's solved by multiplicative weights on both sides. Every length has a weight, which grows by exp(``ETA`` times the share of
   its demand that the present amounts leave open, or shrinks by what they serve too often), and its price is its weight
   over its demand; amounts of configurations grow with the price of what they hold. Steps look one step ahead, and weights and
   amounts are averaged over the rounds between two pricings.
3. Every ``STEPS`` rounds the averaged prices are given to a knapsack dynamic program over the capacity. The best value is
   the dual bound on the number of sequences; for each length, the best configuration that holds it joins the others if its
   value is within ``NEAR`` of the best. The program starts with the configurations of a best-fit packing (or of
   one whose sequences are nearly full, where that's better), and ends when its
   amounts, with a sequence for what they leave open, are within ``GAP`` of the bound, or after ``PRICED`` lengths priced.
4. Amounts are rounded down to whole sequences, the largest first, and what is left is packed by best fit into the room of
   configurations and new ones. Of this packing and the one by best fit alone the better is taken (``pack`` says which).
5. Pieces get a rank within their length (counted over salts, so a length that holds a third of all pieces is never in
   one task), and a table from length and rank to sequence and offset places each.

Defined results: null text counts as empty, giving the end id alone; equal rows are packed as separate documents; no
rows give no sequences; lengths equal to the capacity are sequences of their own.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import UnitCache, slices
from lodestone.session import materialised, ship_package

CAPACITY = 4096
END_ID = 1
#: For packings of whole amounts: share of the least remaining demand that one configuration takes, and of the open tokens that
#: one pricing serves; neighbourhoods of lengths, how fast their weights shrink, and what part of the capacity may stay empty.
STEP = 0.5
SHARE = 0.05
BANDS = 64
TURN = 40.0
SPARE = 1 / 1024
#: How fast weights and amounts move in a round, and rounds between two pricings.
ETA = 0.3
STEPS = 40
#: Values of configurations that join, as a part of the best one's, and the gap between amounts and bound that ends the program.
NEAR = 0.99
GAP = 0.0005
#: Pricings at most, and lengths priced in all: a dynamic program takes time for each.
PRICINGS = 200
PRICED = 60_000
#: Capacities that the dynamic program fills in one step.
BLOCK = 32
#: One length and salt, which one task ranks, holds so many rows, or this part of all rows, at most (about).
SALT_ROWS = 1_000_000
SHARES = 256


# ---------------------------------------------------------------- tokens


def _class(ranges: str, major: str) -> str:
    """The characters of a range list whose Unicode category is of a major class."""
    among = re.compile(f"[{ranges}]")
    return "".join(c for c in map(chr, range(0x2100)) if among.match(c) and unicodedata.category(c)[0] == major)


class WordIds:
    """Ids by the tokenizers library, remembered per white-space-free chunk of plain text.

    The vocabulary's pre-tokenizer never joins across white space and its normaliser works letter by letter on the
    characters below, so the chunks' ids put together are the text's. A new chunk is cut by the pre-tokenizer's pattern and
    its parts go to the library's merge model. Any other text goes to the library whole.
    """

    #: Characters for which Python's split() and lower() agree with the vocabulary's normaliser.
    PLAIN = "\t-\r -~¡-įı-ɏ–-„…"
    OTHER = re.compile(f"[^{PLAIN}]")
    #: The pre-tokenizer's pattern, with its classes written out for these characters.
    LETTERS = _class(PLAIN, "L")
    NUMBERS = _class(PLAIN, "N")
    #: How byte-level vocabularies write bytes: those that print stand for themselves, the others come after U+0100 in order.
    BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
    PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.chunks = UnitCache(self._chunk, limit=300_000)

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for part in self.PARTS.findall(chunk):
            ids += [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.BYTES))]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.OTHER.search(text):
            return self._ids(text)
        return b"".join(self.chunks.all(text.lower().split()))


    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of every text; the chunks of all plain ones are told apart in Arrow, and each distinct one is looked up once."""
        odd = [self.OTHER.search(t) is not None for t in texts]
        chunks = pc.utf8_split_whitespace(pa.array(["" if o else t for o, t in zip(odd, texts, strict=True)], pa.string()))
        coded = chunks.flatten().dictionary_encode()
        found = [self.chunks[c.lower()] if c else b"" for c in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        joined = pc.binary_join(pa.ListArray.from_arrays(chunks.offsets, pa.array(found, pa.binary()).take(coded.indices)), b"").to_pylist()
        return [self._ids(t) if o else ids for o, t, ids in zip(odd, texts, joined, strict=True)]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _pieces(path: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for part, texts in slices(batches, "__text"):
            at, piece, start, length, crc = [], [], [], [], []
            for row, encoded in enumerate(words.encode_all(texts)):
                ids = memoryview(encoded + end)
                for k in range(0, len(ids), 4 * capacity):
                    own = ids[k : k + 4 * capacity]
                    at.append(row)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["__id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """__id, piece, start, length, ids_crc32: one row per piece, written once, with a number of its own."""
    ship_package(df.sparkSession)
    narrow = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    kind = narrow.schema["__id"].dataType.simpleString()
    cut = narrow.mapInArrow(_pieces(path, capacity, end_id), f"__id {kind}, piece int, start long, length long, ids_crc32 long")
    return materialised(cut.withColumn("__row", F.monotonically_increasing_id()), "pieces")


# ---------------------------------------------------------------- configurations


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every capacity the highest total value of a multiset of lengths (ascending), and its last length or -1 for a gap.

    Capacities are filled in blocks: lengths of a block or more only look back before it, so a block is one array step.
    """
    few = int(np.searchsorted(lengths, BLOCK))
    short, short_values, long_, long_values = lengths[:few], values[:few], lengths[few:], values[few:]
    best = np.zeros(capacity + 1 + BLOCK)
    last = np.full(capacity + 1 + BLOCK, -1, dtype=np.int64)
    for start in range(0, capacity + 1, BLOCK):
        stop = start + BLOCK
        n = int(np.searchsorted(long_, stop - 1, side="right"))
        if n:
            back = np.arange(start, stop)[:, None] - long_[None, :n]
            total = np.where(back >= 0, best[back] + long_values[:n], -1.0)
            k = total.argmax(axis=1)
            best[start:stop], last[start:stop] = total[np.arange(BLOCK), k], k + few
        for c in range(max(start, 1), stop):
            m = int(np.searchsorted(short, c, side="right")) if few else 0
            if m:
                total = best[c - short[:m]] + short_values[:m]
                k = int(total.argmax())
                if total[k] > best[c]:
                    best[c], last[c] = total[k], k
            if best[c - 1] >= best[c]:
                best[c], last[c] = best[c - 1], -1
    return best, last


def traced(lengths: np.ndarray, last: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset that the table holds for a capacity."""
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        k = int(last[c])
        if k < 0:
            c -= 1
        else:
            out[k] = out.get(k, 0) + 1
            c -= int(lengths[k])
    return out


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths (ascending) within the capacity of the highest total value, by unbounded knapsack."""
    return traced(lengths, knapsack(lengths, values, capacity)[1], capacity)


def holding(lengths: np.ndarray, last: np.ndarray, firsts: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """For each of some lengths the best configuration that holds it: pairs of a length's place and how often it's held."""
    back = np.maximum.accumulate(np.where(last[: capacity + 1] >= 0, np.arange(capacity + 1), 0))  # the nearest capacity that ends with a length
    rows, room = np.arange(len(firsts)), capacity - lengths[firsts]
    where, held = [rows], [firsts]
    while len(rows):
        room = back[room]
        k = last[room]
        live = room > 0
        rows, k, room = rows[live], k[live], room[live] - lengths[k[live]]
        where.append(rows)
        held.append(k)
    key, n = np.unique(np.concatenate(where) * len(lengths) + np.concatenate(held), return_counts=True)
    out: list[list] = [[] for _ in firsts]
    for x, m in zip(key.tolist(), n.tolist(), strict=True):
        out[x // len(lengths)].append((x % len(lengths), m))
    return [tuple(x) for x in out]


def within(lengths: np.ndarray, values: np.ndarray, best: np.ndarray, last: np.ndarray, stock: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """The multiset that holds a length and follows the table from there; a length out of stock gives way to the best that isn't."""
    out = {first: 1}
    c = capacity - int(lengths[first])
    while c > 0:
        k = int(last[c])
        if k < 0:
            c -= 1
            continue
        if out.get(k, 0) >= stock[k]:
            free = stock > 0
            free[[x for x, n in out.items() if n >= stock[x]]] = False
            free &= lengths <= c
            if not free.any():
                break
            k = int(np.where(free, values + best[np.maximum(c - lengths, 0)], -1.0).argmax())
        out[k] = out.get(k, 0) + 1
        c -= int(lengths[k])
    return out


def filled(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """A packing whose sequences are nearly full: whole amounts of configurations, priced over what's left again and again.

    A length's price is its tokens times one plus a weight that shrinks while its neighbourhood is served ahead of the rest;
    what no nearly full configuration takes is packed by best fit. It's where the program starts if best fit isn't near enough.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    band = lengths * BANDS // (capacity + 1)
    tokens = lengths * demand
    in_band, total = np.bincount(band, tokens, BANDS), float(tokens.sum())
    left = demand.copy()
    out: list[tuple[dict[int, int], float]] = []
    spare, room, least = max(1, int(capacity * SPARE)), 0, 0
    while len(open_ := np.flatnonzero(left)):
        own, stock = lengths[open_], left[open_]
        unserved = np.bincount(band, lengths * left, BANDS)
        ahead = (1 - unserved / np.maximum(in_band, 1)) - (1 - unserved.sum() / total)
        weight = np.exp(np.clip(-TURN * ahead, -20, 20))[band[open_]]
        values = own / capacity * (1 + weight / weight.max())
        best, last = knapsack(own, values, capacity)
        quota, before = SHARE * float((own * stock).sum()), len(out)
        for first in range(len(own) - 1, -1, -1):
            if quota <= 0:
                break
            if not stock[first]:
                continue
            chosen = within(own, values, best, last, stock, first, capacity)
            size = sum(int(own[k]) * n for k, n in chosen.items())
            if size < capacity - least - room:
                continue
            amount = min(min(int(stock[k]) // n, max(1, int(left[open_[k]] * STEP) // n)) for k, n in chosen.items())
            for k, n in chosen.items():
                stock[k] -= n * amount
                left[open_[k]] -= n * amount
            out.append(({int(own[k]): n for k, n in chosen.items()}, float(amount)))
            quota -= size * amount
        if len(out) > before:
            continue
        if room < spare:
            room = min(spare, max(1, 2 * room))
            continue
        # Perhaps no multiset of these lengths fills a sequence: full is then what one can fill.
        fills = knapsack(own, own.astype(np.float64), capacity)[0][capacity]
        if capacity - int(fills) <= least:
            break
        least, room = capacity - int(fills), 0
    whole = [([x for x, n in chosen.items() for _ in range(n)], int(amount)) for chosen, amount in out]
    rest = {int(x): int(n) for x, n in zip(lengths, left) if n}
    return whole + best_fit(rest, whole, capacity)


@dataclass
class Program:
    """Amounts of configurations (length -> how often), the number of sequences that they and the rest take, and the dual bound."""

    amounts: list[tuple[dict[int, int], float]]
    sequences: float
    bound: float


class _Pool:
    """Configurations, as places of lengths and how often each holds them."""

    def __init__(self) -> None:
        self.all: dict[tuple, int] = {}
        self.row, self.item, self.times = [], [], []

    def add(self, found: list[tuple]) -> list[int]:
        new = []
        for chosen in found:
            if chosen not in self.all:
                new.append(self.all.setdefault(chosen, len(self.all)))
                for k, n in chosen:
                    self.row.append(new[-1])
                    self.item.append(k)
                    self.times.append(n)
        return new


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Program:
    """The configuration program by multiplicative weights."""
    if not histogram:
        return Program([], 0.0, 0.0)
    lengths = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    place = {int(x): k for k, x in enumerate(lengths)}
    tokens = float((lengths * demand).sum())
    fitted = best_fit(dict(histogram), [], capacity)
    if sum(n for _, n in fitted) > (1 + GAP) * tokens / capacity:
        fitted = min(fitted, filled(histogram, capacity), key=lambda packed: sum(n for _, n in packed))
    pool, start = _Pool(), {}
    for held, n in fitted:
        key = tuple(sorted((place[x], m) for x, m in Counter(held).items()))
        pool.add([key])
        start[key] = start.get(key, 0) + n
    x = np.array([start[key] for key in pool.all], dtype=np.float64)
    best = Program([({int(lengths[k]): m for k, m in key}, float(n)) for key, n in start.items()], float(x.sum()), tokens / capacity)
    x /= x.sum()
    w = lengths * demand / tokens
    average = w
    for _ in range(max(2, min(PRICINGS, PRICED // len(lengths)))):
        price_ = average / demand
        value, last = knapsack(lengths, price_, capacity)
        top = float(value[capacity])
        best.bound = max(best.bound, 1 / top)
        if best.sequences <= (1 + GAP) * best.bound:
            break
        whole = price_ + value[capacity - lengths]
        new = pool.add(holding(lengths, last, np.flatnonzero(whole >= NEAR * top), capacity))
        if new:
            x = np.r_[x * 0.9, np.full(len(new), 0.1 / len(new))]
        row, item, times = np.array(pool.row), np.array(pool.item), np.array(pool.times, np.float64)
        n, sums, weights = best.bound, np.zeros(len(x)), np.zeros(len(w))
        served_before = worth_before = None
        for _ in range(STEPS):
            served = np.bincount(item, times * x[row], len(w)) * n / demand
            worth = np.bincount(row, times * (w / demand)[item], len(x)) * n
            ahead = served if served_before is None else 2 * served - served_before
            rising = worth if worth_before is None else 2 * worth - worth_before
            served_before, worth_before = served, worth
            w = w * np.exp(np.clip(ETA * (1 - ahead), -1, 1))
            x = x * np.exp(np.clip(4 * ETA * (rising - 1), -2, 2))
            w, x = w / w.sum(), x / x.sum()
            sums, weights = sums + x, weights + w
        average, amount = weights / weights.sum(), n * sums / sums.sum()
        open_ = np.maximum(0.0, demand - np.bincount(item, times * amount[row], len(w)))
        sequences = n + float((open_ / (capacity // lengths)).sum())
        if sequences < best.sequences:
            best.amounts = [({int(lengths[k]): m for k, m in key}, float(amount[c])) for key, c in pool.all.items() if amount[c] > 1e-6]
            best.sequences = sequences
    return best


def round_down(amounts: list[tuple[dict[int, int], float]], histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Whole configurations, as lists of lengths with the number of sequences of each, that hold exactly the histogram."""
    left = dict(histogram)
    whole: list[tuple[list[int], int]] = []
    for chosen, amount in sorted(amounts, key=lambda x: -x[1]):
        key = sorted(chosen.items(), reverse=True)
        n = min([math.floor(amount + 1e-9), *(left[length] // k for length, k in key)])
        if n > 0:
            whole.append(([length for length, k in key for _ in range(k)], n))
            for length, k in key:
                left[length] -= k * n
    return whole + best_fit(left, whole, capacity)


def best_fit(left: dict[int, int], whole: list[tuple[list[int], int]], capacity: int) -> list[tuple[list[int], int]]:
    """Longest first, into the fullest open sequence that still takes the piece; equal sequences are kept as counts.

    Open to begin with are the configurations of `whole` that aren't full: sequences that take a piece are split off.
    """
    spare: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for i, (held, n) in enumerate(whole):
        room = capacity - sum(held)
        if room:
            spare[room][tuple(held)] = spare[room].get(tuple(held), 0) + n
            whole[i] = (held, 0)
    rooms = np.array([bool(s) for s in spare])
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            fit = np.flatnonzero(rooms[length:])
            if len(fit):
                room = length + int(fit[0])
                held, have = spare[room].popitem()
                rooms[room] = bool(spare[room])
                take = min(n, have)  # one piece each; what remains of the piece's length comes by again
                if have > take:
                    spare[room][held] = have - take
                    rooms[room] = True
            else:
                room, held = capacity, ()
                each = capacity // length
                take = max(1, n // each) if each > 1 else n
            put, rest = (*held, length), room - length
            spare[rest][put] = spare[rest].get(put, 0) + take
            rooms[rest] = rest > 0
            n -= take
    whole[:] = [x for x in whole if x[1]]
    return [(list(held), n) for s in spare for held, n in s.items()]


def pack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Configurations and their numbers of sequences for a whole histogram."""
    return packed_by(histogram, capacity)[0]


def packed_by(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], str]:
    """pack(), and what gave it: the program, or best fit alone where that takes fewer sequences."""
    part = {x: n for x, n in histogram.items() if x < capacity and n}
    full = [([capacity], histogram[capacity])] if histogram.get(capacity) else []
    rounded, fitted = round_down(solve(part, capacity).amounts, part, capacity), best_fit(dict(part), [], capacity)
    count = lambda packed: sum(n for _, n in packed)
    return (full + rounded, "program") if count(rounded) <= count(fitted) else (full + fitted, "best fit")


def placement(packed: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each slot of each configuration: length, first rank, sequences, first sequence, offset; by length and rank."""
    rows, base, taken = [], 0, {}
    for held, n in packed:
        offset = 0
        for length in held:
            rows.append((length, taken.get(length, 0), n, base, offset))
            taken[length] = taken.get(length, 0) + n
            offset += length
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "first", "n", "base", "offset"))}


# ---------------------------------------------------------------- places


def _place(spots: dict[str, np.ndarray]):
    shift = 1 << 48
    keys = spots["length"] * shift + spots["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            sequence = spots["base"][at] + rank - spots["first"][at]
            columns = [batch.column(n) for n in ("__id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence, pa.int64()), pa.array(spots["offset"][at], pa.int64())],
                ["__id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def place(rows: DataFrame, histogram: dict[int, int], capacity: int = CAPACITY) -> DataFrame:
    """rows of pieces() with sequence_id and offset.

    The table of spots has a row per slot of a configuration: its size follows the number of lengths, not of rows.
    """
    most = max(histogram.values(), default=0)
    salts = max(1, -(-most // SALT_ROWS), -(-SHARES * most // max(1, sum(histogram.values()))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")).select(
        "length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy("length", "__salt").orderBy("__row")
    ranked = salted.withColumn("__in", F.row_number().over(within) - 1)
    ranked = ranked.join(starts, ["length", "__salt"]) if salts > 1 else ranked.withColumn("__before", F.lit(0))
    ranked = ranked.select("__id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__in")).cast("long").alias("__rank"))
    kind = ranked.schema["__id"].dataType.simpleString()
    return ranked.mapInArrow(
        _place(placement(pack(histogram, capacity))),
        f"__id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    rows = pieces(df, path, id_col, text_col, capacity, end_id)
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(rows, histogram, capacity).withColumnRenamed("__id", id_col)
