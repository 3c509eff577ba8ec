"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent pairs.

A text becomes symbols (one per character, spaces as U+2581, one such in front); the agenda holds every adjacent pair
that is a piece, best score first and leftmost first among equals; the top pair is merged while both its symbols are
still there, and its new neighbours join the agenda. Symbols that are no piece become bytes. Short units that are new to
a slice of an Arrow batch have their agendas worked off side by side, the top pair of each in a round.

No piece holds U+2581 after another character, and characters that occur in no longer piece never merge, so a text is
cut there into units that can't affect each other, and a unit's ids are remembered (bounded, speed only). Whether a
vocabulary allows these cuts is read from it; one that doesn't is encoded in one piece.

What is returned is the agenda's: its ids, and its own decoding of them. Check: the sentencepiece library encodes every text
whole as well, and decodes the ids of every text; ``agrees`` is false where it has anything else.

Defined results: null counts as empty (begin and end ids only); equal rows give equal results; a very long text is one
text like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import UnitCache, slices
from lodestone.session import ship_package

SPACE = "▁"
#: Words whose ids are remembered (or one slice's), and how many new ones, of which length at most, are merged side by side;
#: speed only.
WORDS = 1_000_000
AT_ONCE = 4_096
#: Bytes of text that are worked on at a time (a longer text by itself): more have fewer distinct words each.
SLICE = 12_000_000
WIDE = 32
#: Order of two symbols that form no piece, and the first symbol that stands for a character which is no piece.
NO_PAIR = 1 << 40
UNKNOWN = 1 << 24


class PieceModel:
    """A vocabulary with its own encoder and decoder."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.raw = [b""] * n
        self.ids: dict[str, int] = {}
        self.byte_ids = [self.unk] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.raw[i] = bytes([value])
            elif i not in special:
                self.ids[piece] = i
                self.raw[i] = piece.replace(SPACE, " ").encode()
        self.raw[self.unk] = " ⁇ ".encode()
        self.rank = {p: (-sp.get_score(i), i) for p, i in self.ids.items()}
        longer = [p for p in self.ids if len(p) > 1]
        joined = set("".join(longer))
        self.cuts = not any(SPACE in p[1:] and p.strip(SPACE) for p in longer)
        alone = "" if "\n" in joined else "\n"
        self.unit = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "") if self.cuts else r"(?s).+")
        self.line_feed = bool(alone)
        self.units = UnitCache(self._unit)
        self.known = pa.array([], pa.string()), pa.array([], pa.binary())
        self._pairs()

    def merge(self, unit: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece."""
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        agenda = []
        for i in range(n - 1):
            found = rank.get(unit[i : i + 2])
            if found:
                agenda.append((found[0], i, 2))
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != size:
                continue
            symbols[i] = left = left + symbols[j]
            symbols[j] = None
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                found = rank.get(left + symbols[j])
                if found:
                    heappush(agenda, (found[0], i, len(left) + len(symbols[j])))
            j = before[i]
            if j >= 0:
                found = rank.get(symbols[j] + left)
                if found:
                    heappush(agenda, (found[0], j, len(symbols[j]) + len(left)))
        return [s for s in symbols if s is not None]

    def _unit(self, unit: str) -> bytes:
        out = []
        for symbol in self.merge(unit):
            i = self.ids.get(symbol)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")]
        return b"".join(i.to_bytes(4, "little") for i in out)

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        body = SPACE + text.replace(" ", SPACE) if text else ""
        ids = b"".join(self.units.all(self.unit.findall(body)))
        return self.bos.to_bytes(4, "little") + ids + self.eos.to_bytes(4, "little")

    def _word(self, word: str) -> bytes:
        """Ids of what stands between two spaces, with the space before it; a line feed stands for itself."""
        return b"".join(map(self._unit, self.unit.findall(word if word[:1] == "\n" else SPACE + word)))

    def merge_all(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units, put together, and how many each has: a round takes the top pair of every unit's agenda.

        symbols has a unit a row; its agenda is a row of a matrix with the order of each adjacent pair, and a unit without a
        pair is done.
        """
        done = np.full(symbols.shape, -1, np.int64)
        rows = np.arange(len(symbols))
        agenda = self._order(symbols[:, :-1], symbols[:, 1:])[0]
        while symbols.shape[1] > 1 and len(rows):
            at = agenda.argmin(axis=1)  # the leftmost of equals
            live = agenda[np.arange(len(rows)), at] < NO_PAIR
            if not live.all():
                done[rows[~live], : symbols.shape[1]] = symbols[~live]
                rows, symbols, agenda, at = rows[live], symbols[live], agenda[live], at[live]
            k = np.arange(len(rows))
            merged = self._order(symbols[k, at], symbols[k, at + 1])[1]
            on = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, on + (on > at[:, None]), 1)
            symbols[k, at] = merged
            agenda = np.take_along_axis(agenda, on[:-1] + (on[:-1] >= at[:, None]), 1)
            for side in (at - 1, at):
                near = np.flatnonzero((side >= 0) & (side < agenda.shape[1]))
                i = side[near]
                agenda[near, i] = self._order(symbols[near, i], symbols[near, i + 1])[0]
        done[rows, : symbols.shape[1]] = symbols
        kept = done >= 0
        flat, counts = done[kept], kept.sum(axis=1)
        strange = np.flatnonzero(flat >= UNKNOWN)
        if len(strange):
            owner = np.repeat(np.arange(len(counts)), counts)
            raw = [[self.byte_ids[b] for b in chr(x - UNKNOWN).encode("utf-8", "surrogatepass")] for x in flat[strange].tolist()]
            width = np.ones(len(flat), np.int64)
            width[strange] = [len(x) for x in raw]
            start = np.cumsum(width) - width
            wide = np.repeat(flat, width)
            for at, ids in zip(start[strange].tolist(), raw, strict=True):
                wide[at : at + len(ids)] = ids
            flat, counts = wide, np.bincount(owner, width, len(counts)).astype(np.int64)
        return flat, counts

    def _order(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of adjacent symbols: the order of the piece they form (NO_PAIR if none), and the piece."""
        key = left * (2 * UNKNOWN) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_order[at], NO_PAIR), self.pair_piece[at]

    def _pairs(self) -> None:
        """All two pieces that form a piece, and each character's symbol (UNKNOWN and its code for those that are no piece)."""
        self.alphabet = np.arange(0x110000) + UNKNOWN
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.alphabet[ord(piece)] = i
        symbol = lambda part: self.ids.get(part, UNKNOWN + ord(part) if len(part) == 1 else None)
        scores = {score: k for k, score in enumerate(sorted({score for score, _ in self.rank.values()}))}
        rows = []
        for piece, (score, i) in self.rank.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    rows.append((left * (2 * UNKNOWN) + right, scores[score], i))
        table = np.array(sorted(rows) or [(-1, NO_PAIR, 0)], dtype=np.int64)
        self.pairs, self.pair_order, self.pair_piece = (np.ascontiguousarray(table[:, k]) for k in range(3))

    def new_words(self, words: pa.Array) -> pa.Array:
        """_word() of each word, short ones side by side."""
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        order = np.argsort(sizes, kind="stable")
        short = int((sizes < WIDE).sum())
        out = []
        for at in range(0, short, AT_ONCE):
            some = words.take(pa.array(order[at : min(at + AT_ONCE, short)]))
            n = sizes[order[at : at + len(some)]]
            codes = np.frombuffer("".join(some.to_numpy(zero_copy_only=False).tolist()).encode("utf-32-le"), np.uint32)
            led = ~pc.starts_with(some, "\n").to_numpy(zero_copy_only=False)  # has a space in front
            symbols = np.full((len(some), int(n.max()) + 1), -1, np.int64)
            symbols[led, 0] = self.alphabet[ord(SPACE)]
            column = np.arange(symbols.shape[1])
            symbols[(column >= led[:, None]) & (column < (n + led)[:, None])] = self.alphabet[codes]
            flat, counts = self.merge_all(symbols)
            ends = np.r_[0, 4 * np.cumsum(counts)].astype(np.int32)
            out.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())]))
        out.append(pa.array([self._word(w) for w in words.take(pa.array(order[short:])).to_pylist()], pa.binary()))
        return pa.concat_arrays(out).take(pa.array(np.argsort(order, kind="stable")))

    def look_up(self, words: pa.Array) -> pa.Array:
        """_word() of distinct words: those remembered, then all new ones."""
        at = pc.index_in(words, value_set=self.known[0])
        new = words.filter(pc.is_null(at))
        values = pa.concat_arrays([self.known[1], self.new_words(new)])
        where = at.to_numpy(zero_copy_only=False) if not len(new) else pc.fill_null(at, -1).to_numpy().copy()
        if len(new):
            where[where < 0] = len(self.known[0]) + np.arange(len(new))
        found = values.take(pa.array(where.astype(np.int64)))
        if len(values) <= WORDS:
            self.known = pa.concat_arrays([self.known[0], new]), values
        else:
            self.known = words, found
        return found

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode() of every text.

        Where spaces stand alone the words of all texts are told apart in Arrow, and each distinct one is looked up once.
        """
        if not self.cuts or not self.line_feed:
            return [self.encode(t) for t in texts.to_pylist()]
        spread = pc.replace_substring(texts, "\n", " \n")
        odd = pc.match_substring_regex(spread, f"^$|^ |  | $|{SPACE}").to_pylist()
        words = pc.split_pattern(spread, " ")
        coded = words.flatten().dictionary_encode()
        found = self.look_up(coded.dictionary)  # empty words are only in texts that are encoded by themselves
        joined = pc.binary_join(pa.ListArray.from_arrays(words.offsets, found.take(coded.indices)), b"").to_pylist()
        first, end = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        return [self.encode(texts[k].as_py()) if odd[k] else first + ids + end for k, ids in enumerate(joined)]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"


def _round_trip(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for part, texts in slices(batches, "__text", SLICE):
            blobs = m.encode_all(pa.array(texts, pa.string()))
            lists = m.library.encode_as_numpy(texts, add_bos=True, add_eos=True, num_threads=1)
            same = [a == b.astype("<u4").tobytes() for a, b in zip(blobs, lists, strict=True)]
            mine = [np.frombuffer(b, "<u4").tolist() for b in blobs]
            own = [m.decode(ids) for ids in mine]
            theirs = m.library.decode(lists, num_threads=1)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [
                part.column(0),
                pa.array([len(x) for x in mine], pa.int64()),
                pa.array([sha(b) for b in blobs]),
                pa.array([sha(t.encode("utf-8", "replace")) for t in own]),
                pa.array([k and a == b for k, a, b in zip(same, own, theirs, strict=True)]),
            ]
            names = ["__id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
            if keep_ids:
                columns += [pa.array(mine, pa.list_(pa.int32())), pa.array(own)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, agrees per row; keep_ids adds ids and decoded."""
    ship_package(df.sparkSession)
    narrow = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    kind = narrow.schema["__id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if keep_ids else ""
    return narrow.mapInArrow(_round_trip(path, keep_ids), f"__id {kind}, {SCHEMA}{more}").withColumnRenamed("__id", id_col)
