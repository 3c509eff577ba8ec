"""Alignment of two tokenizers (byte-level BPE and SentencePiece) over a corpus, each distinct segment tokenised and aligned once.

1. A text is cut before runs of white space, where neither vocabulary can merge across: ``safe_spaces`` reads from both that
   no entry holds such a character after one that isn't white space (of SentencePiece's, after its space mark either), so no
   merge can reach over the cut, and the byte-level pattern never matches over the start of such a run. A slice of texts is
   stored as numbers of its segments, commonest first, and as a list of its distinct segments.
2. Segments of all slices are sorted together; each distinct one is tokenised by both libraries, its tokens are cut into
   groups at the byte offsets where both end, and the last two tokens of a group are linked. What it has is one row with the
   places that it goes to, ``ALIGNED`` at most (a segment of more places has more rows).
3. Pairs of linked ids are counted over the corpus, as often as their segments occur, and each segment gets the sums over
   its links.
4. Slices are composed: a segment's alignment goes to every slice that has it, once, and documents are put together there.

Bounds: a slice has ``SLICE`` bytes of text or is one document; a segment that stands everywhere is one row a slice; the
highest counts that are broadcast have a row for each id of the second vocabulary.

Defined results: null, empty and unalignable texts (those whose tokens don't give back a space and the text) have no
tokens: zeros and an empty groups_sha256; equal rows give equal results and count as often as they occur; an empty table
gives an empty result; ids of any type and other columns' names don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.llm.packing import WordIds
from lodestone.session import materialised, removed, scratch_path, ship_package, stored

SPACE = "▁"
#: Bytes of text of a slice; segments that are sent on or aligned together.
SLICE = 16_000_000
SENT = 20_000
ALIGNED = 30_000
#: Bytes of documents' numbers (a document by itself, if it has more) that are put together at a time.
COMPOSED = 1_000_000
SPACES = " \t\n\v\f\r"
#: White space besides the space and the line feed, for Arrow's patterns; and what else the quick way of cutting doesn't see.
OTHER_SPACES = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NOT_QUICK = rf"^[ \n]|[ \n]$|  | \n|\n |[{OTHER_SPACES}]"


def safe_spaces(first: Iterable[bytes], second: Iterable[str]) -> str:
    """Of the ASCII white space the characters before which a text can be cut, given both vocabularies' entries."""
    bad = set()
    for entry in first:
        text = entry.decode("utf-8", "replace")
        bad |= {b for a, b in zip(text, text[1:]) if b in SPACES and not a.isspace()}
    for piece in second:
        text = piece.replace(SPACE, " ")
        bad |= {b for a, b in zip(text, text[1:]) if b in SPACES and (not a.isspace() or a == " " != b)}
    return "".join(c for c in SPACES if c not in bad)


class Aligner:
    """Both vocabularies with the bytes of their tokens."""

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(first, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"not a byte-level vocabulary that keeps texts as they are: {first}")
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        byte = {chr(WordIds.BYTES.get(b, b)): b for b in range(256)}
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in entry)
        n = self.b.get_piece_size()
        pieces = {i: self.b.id_to_piece(i) for i in range(n) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))}
        self.b_bytes = [b""] * n
        for i in range(n):
            self.b_bytes[i] = bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else pieces.get(i, "").replace(SPACE, " ").encode()
        if sum(self.b.is_byte(i) for i in range(n)) != 256:
            raise ValueError(f"a vocabulary without bytes loses characters: {second}")
        self.space = self.b.piece_to_id(SPACE)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.safe = safe_spaces(self.a_bytes, pieces.values())
        unsafe = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in self.safe)
        self.segment = re.compile(rf"\s*\S+(?:[{re.escape(unsafe)}]\s*\S*)*|\s+")

    def usable(self, text: str) -> bool:
        """Whether the tokens of both give back a space and the text."""
        return bool(text) and SPACE not in text and self.b.normalize(text) == SPACE + text.replace(" ", SPACE)

    def cut(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """Distinct segments of a space and each text, the number of each segment in order, and how many each text has."""
        given = pa.array(texts, pa.string())
        slow = pc.match_substring_regex(given, NOT_QUICK).to_numpy(zero_copy_only=False) if {" ", "\n"} <= set(self.safe) else np.ones(len(texts), bool)
        slow |= pc.equal(given, "").to_numpy(zero_copy_only=False)
        quick = pc.split_pattern(pc.replace_substring_regex(given.filter(pa.array(~slow)), r"(\n+)", r" \1"), " ")
        coded = quick.flatten().dictionary_encode()
        words = coded.dictionary
        words = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise("", words, " "))
        odd = [self.segment.findall(f" {texts[k]}") if texts[k] else [] for k in np.flatnonzero(slow)]
        own = pa.array([s for found in odd for s in found], pa.string()).dictionary_encode()
        both = pa.concat_arrays([words, own.dictionary]).dictionary_encode()
        number = both.indices.to_numpy()
        sizes = np.zeros(len(texts), np.int64)
        sizes[~slow], sizes[slow] = np.diff(quick.offsets.to_numpy()), list(map(len, odd))
        out = np.zeros(int(sizes.sum()), np.int64)
        owner = np.repeat(slow, sizes)
        out[~owner] = number[: len(words)][coded.indices.to_numpy()]
        out[owner] = number[len(words) :][own.indices.to_numpy()]
        return both.dictionary, out, sizes

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        first = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        second = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s == " ":
                second[k] = [self.space]
            elif s[0] != " ":  # the library's own space in front
                if second[k][0] != self.space:
                    raise ValueError(f"a merge over a cut: {s!r}")
                second[k] = second[k][1:]
        return first, second

    def align(self, segments: list[str]) -> dict[str, pa.Array]:
        """tokens (see packed()), links_a and links_b of each segment."""
        first, second = self.tokens(segments)
        a, b = (np.array([i for ids in x for i in ids], np.int64) for x in (first, second))
        n_a = np.array(list(map(len, first)), np.int64)
        raw = "".join(segments).encode()
        if raw != b"".join(map(self.a_bytes.__getitem__, a.tolist())) or raw != b"".join(map(self.b_bytes.__getitem__, b.tolist())):
            raise ValueError("tokens that don't give their segments back")
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        size_a = np.bincount(np.searchsorted(common, ends_a), minlength=len(common))
        size_b = np.bincount(np.searchsorted(common, ends_b), minlength=len(common))
        n_groups = np.diff(np.r_[0, np.searchsorted(common, ends_a[np.cumsum(n_a) - 1], side="right")])
        last = [ids[np.cumsum(sizes) - 1].astype(np.int32) for ids, sizes in ((a, size_a), (b, size_b))]
        return {"tokens": packed(a, b, size_a, size_b, n_groups), "links_a": _lists(pa.array(last[0]), n_groups), "links_b": _lists(pa.array(last[1]), n_groups)}


def _lists(items: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), items)


def _binaries(data: bytes, sizes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32).tobytes()), pa.py_buffer(data)])


def _bytes_of(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values, put together, and where each starts (with the end)."""
    starts = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    return np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the same for the next."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def packed(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, n_groups: np.ndarray) -> pa.Array:
    """Groups of segments as 32-bit or 16-bit words (one byte says which): number of groups, tokens of each on both sides, ids."""
    of = np.repeat(np.arange(len(n_groups)), n_groups)
    t_a, t_b = (np.bincount(of, x, len(n_groups)).astype(np.int64) for x in (size_a, size_b))
    words = 1 + 2 * n_groups + t_a + t_b
    starts = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), np.uint32)
    out[starts] = n_groups
    at = starts + 1
    for values, sizes in ((size_a, n_groups), (size_b, n_groups), (a, t_a), (b, t_b)):
        out[_ranges(at, sizes)] = values
        at = at + sizes
    if len(out) and out.max() >= 1 << 16:
        blobs = [b"\4" + out[s : s + n].astype("<u4").tobytes() for s, n in zip(starts, words)]
        return pa.array([b"\2" + out[s : s + n].astype("<u2").tobytes() if out[s : s + n].max() < 1 << 16 else x for x, s, n in zip(blobs, starts, words)], pa.binary())
    raw = np.zeros(2 * len(out) + len(words), np.uint8)
    lead = 2 * starts + np.arange(len(words))
    raw[lead] = 2
    rest = np.ones(len(raw), bool)
    rest[lead] = False
    raw[rest] = out.astype("<u2").view(np.uint8)
    return _binaries(raw.tobytes(), 2 * words + 1)


def unpacked(tokens: pa.Array) -> tuple[np.ndarray, ...]:
    """a, b, size_a, size_b, n_groups as packed() got them."""
    data, starts = _bytes_of(tokens)
    wide = data[starts[:-1]] == 4
    rest = np.ones(len(data), bool)
    rest[starts[:-1]] = False
    if wide.any():
        each = [np.frombuffer(x.as_py()[1:], "<u4" if w else "<u2").astype(np.int64) for x, w in zip(tokens, wide)]
        flat, words = np.concatenate(each), np.array(list(map(len, each)), np.int64)
    else:
        flat, words = data[rest].view("<u2").astype(np.int64), (np.diff(starts) - 1) // 2
    at = np.cumsum(words) - words
    n_groups = flat[at]
    size_a, size_b = flat[_ranges(at + 1, n_groups)], flat[_ranges(at + 1 + n_groups, n_groups)]
    of = np.repeat(np.arange(len(n_groups)), n_groups)
    t_a, t_b = (np.bincount(of, x, len(n_groups)).astype(np.int64) for x in (size_a, size_b))
    at = at + 1 + 2 * n_groups
    return flat[_ranges(at, t_a)], flat[_ranges(at + t_a, t_b)], size_a, size_b, n_groups


def written(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The groups as text, and the numbers of tokens on both sides and of groups, of each segment."""
    a, b, size_a, size_b, n_groups = unpacked(tokens)
    most = int(max(a.max(initial=0), b.max(initial=0)))
    decimals = pa.array([str(i) for i in range(most + 1)])
    sides = [pc.binary_join(_lists(decimals.take(pa.array(ids)), sizes), ",") for ids, sizes in ((a, size_a), (b, size_b))]
    text = pc.binary_join(_lists(pc.binary_join_element_wise(*sides, "|"), n_groups), ";")
    of = np.repeat(np.arange(len(n_groups)), n_groups)
    return text, *(np.bincount(of, x, len(n_groups)).astype(np.int64) for x in (size_a, size_b)), n_groups


def varints(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of numbers as bytes of seven bits each, low ones first, the highest bit set on all but a number's last."""
    width = 1 + sum((values >= 1 << (7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        some = width > k
        out[ends[some] - width[some] + k] = (values[some] >> (7 * k)) & 127 | np.where(width[some] > k + 1, 128, 0)
    whole = np.r_[0, ends][np.cumsum(sizes)] if len(sizes) else np.zeros(0, np.int64)
    return _binaries(out.tobytes(), np.diff(np.r_[0, whole]))


def from_varints(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, put together, and how many each has."""
    data, starts = _bytes_of(blobs)
    last = data < 128
    number = np.r_[0, np.cumsum(last)]
    first = np.r_[0, np.flatnonzero(last) + 1][: int(number[-1])]
    shift = 7 * (np.arange(len(data)) - np.repeat(first, np.diff(np.r_[first, len(data)]))) if len(data) else np.zeros(0, np.int64)
    values = np.add.reduceat((data & 127).astype(np.int64) << shift, first) if len(first) else np.zeros(0, np.int64)
    return values, number[starts[1:]] - number[starts[:-1]]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    return _ALIGNERS[first, second]


# ---------------------------------------------------------------- jobs


class _Slice:
    """Texts of one slice so far: ids, and segments with numbers of each part."""

    def __init__(self) -> None:
        self.ids, self.words, self.codes, self.sizes, self.bytes = [], [], [], [], 0

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        both = pa.concat_arrays(self.words).dictionary_encode()
        starts = np.r_[0, np.cumsum(list(map(len, self.words)))]
        of = both.indices.to_numpy()
        parts = [of[start:] for start in starts[:-1]]
        n = np.zeros(len(both.dictionary), np.int64)
        for part, codes in zip(parts, self.codes, strict=True):
            n += np.bincount(part[codes], minlength=len(n))
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        for ids, part, codes, sizes in zip(self.ids, parts, self.codes, self.sizes, strict=True):
            yield self._batch(len(ids), number, 0, ids=ids, codes=varints(place[part[codes]], sizes))
        words, n = both.dictionary.take(pa.array(order)), n[order]
        for at in range(0, len(order), SENT):
            some = words.slice(at, SENT)
            yield self._batch(len(some), number, 1, code=pa.array(np.arange(at, at + len(some), dtype=np.int32)), segment=some, n=pa.array(n[at : at + SENT]))

    def _batch(self, size: int, number: int, kind: int, ids=None, codes=None, code=None, segment=None, n=None) -> pa.RecordBatch:
        none = lambda column, kind: pa.nulls(size, kind) if column is None else column
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, number, np.int64)), none(ids, self.ids[0].type), none(codes, pa.binary()),
                none(code, pa.int32()), none(segment, pa.string()), none(n, pa.int64()), pa.array(np.full(size, kind, np.int32)),
            ],
            ["slice", "__id", "codes", "code", "segment", "n", "kind"],
        )


def _cutting(first: str, second: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held, number = aligner(first, second), _Slice(), TaskContext.get().partitionId() << 32
        for part, texts in slices(batches, "__text"):
            size = sum(map(len, texts))
            if held.ids and held.bytes + size > most:
                yield from held.rows(number)
                held, number = _Slice(), number + 1
                pa.default_memory_pool().release_unused()
            words, codes, sizes = both.cut([t if both.usable(t) else "" for t in texts])
            held.ids.append(part.column(0))
            held.words.append(words)
            held.codes.append(codes.astype(np.int32))
            held.sizes.append(sizes)
            held.bytes += size
        if held.ids:
            yield from held.rows(number)

    return run


def _aligning(first: str, second: str):
    def aligned(both: Aligner, rows: pa.Table, start: int) -> tuple[pa.RecordBatch, int]:
        runs = rows.column("segment").combine_chunks().dictionary_encode()
        run = runs.indices.to_numpy()
        size = len(runs.dictionary)
        places = np.bincount(run, minlength=size)
        n = np.bincount(run, rows.column("n").to_numpy(), size).astype(np.int64)
        columns = {"entry": pa.array(np.arange(start, start + size)), "slices": _lists(rows.column("slice").combine_chunks(), places), "codes": _lists(rows.column("code").combine_chunks(), places), "n": pa.array(n)}
        columns |= both.align(runs.dictionary.to_pylist())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns)), start + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, start, held = aligner(first, second), TaskContext.get().partitionId() << 40, []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ALIGNED:
                out, start = aligned(both, pa.Table.from_batches(held), start)
                held = []
                yield out
        if held and any(b.num_rows for b in held):
            yield aligned(both, pa.Table.from_batches(held), start)[0]

    return run


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _compose(docs: pa.Table, entries: pa.Table) -> pa.Table:
    entries = entries.sort_by("code")  # codes are 0, 1, ... without gaps
    tokens = entries.column("tokens").combine_chunks()
    parts = [written(tokens.slice(at, ALIGNED)) for at in range(0, len(tokens), ALIGNED)]
    groups, *sizes = pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    numbers = dict(zip(("n_a", "n_b", "n_groups"), sizes)) | {c: entries.column(c).to_numpy() for c in ("n_best", "count_sum")}
    docs = docs.combine_chunks()
    hashes, total, at = [], {c: [] for c in numbers}, 0
    ends = np.cumsum(pc.binary_length(docs.column("codes")).to_numpy())
    while at < len(docs):  # a number has a byte at least
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPOSED, side="right")))
        codes, lengths = from_varints(docs.column("codes").slice(at, to - at).combine_chunks())
        stops = np.cumsum(lengths)
        for c, values in numbers.items():
            sums = np.r_[0, np.cumsum(values[codes])]
            total[c].append(sums[stops] - sums[stops - lengths])
        hashes += [hashlib.sha256(x.encode()).hexdigest() for x in pc.binary_join(_lists(groups.take(pa.array(codes)), lengths), ";").to_pylist()]
        at = to
    total["n_links"] = total["n_groups"]  # a group's last tokens, and no others, end together
    pa.default_memory_pool().release_unused()
    return pa.table([docs.column("__id"), *(pa.array(np.concatenate(total[c]), pa.int64()) for c in COUNTS), pa.array(hashes, pa.string())], ["__id", *COUNTS, "groups_sha256"])


def counted_pairs(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, count, best: how often the corpus has each pair linked, and whether no other pair of its b has more; and the
    entries' links."""
    links = entries.select("entry", "n", F.explode(F.arrays_zip("links_a", "links_b")).alias("x")).select("entry", "n", F.col("x.links_a").alias("a"), F.col("x.links_b").alias("b"))
    counts = materialised(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    highest = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best")), links


def alignments(df: DataFrame, first: str, second: str, id_col: str, text_col: str, most: int = SLICE) -> tuple[DataFrame, DataFrame, str]:
    """Documents as numbers of their slice's segments; distinct segments with their alignments and places, and that table's path."""
    spark = df.sparkSession
    ship_package(spark)
    narrow = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    kind = narrow.schema["__id"].dataType.simpleString()
    cut = narrow.mapInArrow(_cutting(first, second, most), f"slice long, __id {kind}, codes binary, code int, segment string, n long, kind int")
    path = scratch_path(spark, "segments")
    cut.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    segments = spark.read.schema(cut.schema).parquet(path).where("kind = 1").select("slice", "code", "segment", "n")
    schema = "entry long, slices array<long>, codes array<int>, n long, tokens binary, links_a array<int>, links_b array<int>"
    entries = segments.repartition("segment").sortWithinPartitions("segment").mapInArrow(_aligning(first, second), schema)
    entries, where = stored(entries, "alignments")
    removed(spark, f"{path}/kind=1")  # the alignments have taken their place
    return spark.read.schema(cut.schema).parquet(path).where("kind = 0").select("slice", "__id", "codes"), entries, where


def align(df: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", most: int = SLICE) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row."""
    docs, entries, where = alignments(df, first, second, id_col, text_col, most)
    counts, links = counted_pairs(entries)
    sums = links.drop("n").join(counts, ["a", "b"]).groupBy("entry").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    summed = materialised(entries.select("entry", "slices", "codes", "tokens").join(sums, "entry").drop("entry"), "summed")
    removed(df.sparkSession, where)
    whole = summed.select("tokens", "n_best", "count_sum", F.explode(F.arrays_zip("slices", "codes")).alias("at")).select(F.col("at.slices").alias("slice"), F.col("at.codes").alias("code"), "tokens", "n_best", "count_sum")
    kind = docs.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string"
    some = docs.where(F.octet_length("codes") > 0).groupBy("slice").cogroup(whole.groupBy("slice")).applyInArrow(_compose, schema)
    none = docs.where(F.octet_length("codes") == 0).select("__id", *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit("").alias("groups_sha256"))
    return some.unionByName(none).withColumnRenamed("__id", id_col)
