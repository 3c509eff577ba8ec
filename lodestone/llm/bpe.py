"""Byte-pair encoding and decoding with word ends, by a lexicon of frequent words and exact merges for all others.

1. Words (parts of the pre-tokenizer's pattern) are counted over all texts. Those seen at least a power of two times, the
   least one that leaves no more than ``WORDS``, are merged on the driver and compiled into a minimal acyclic transducer with
   their ids as outputs (lexicon.py), a file in the session's shared folder that Spark gives to every executor once.
2. Executors map the file. Of a slice of texts each distinct word walks the automaton, all words side by side; a word that it
   doesn't hold is merged exactly, by the ranks of its pairs. What the lexicon holds changes the speed and no result.
3. Decoding puts the vocabulary's entries together as a vocabulary without a decoder does, a space between two.

Texts of characters for which Python and the vocabulary's normaliser agree are cut in Arrow; any other text goes through
the vocabulary's own normaliser and its chunks through its own pre-tokenizer, then through the same lexicon and merges.
Strings of special tokens inside a text become their ids, as the library has it unless told otherwise (``special=False``:
plain text).

Defined results: null counts as empty, which gives no ids and an empty text; equal rows give equal results; a very long
text is one text like any other, a very long word is merged with a heap; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.batches import UnitCache, slices
from lodestone.llm.lexicon import LONGEST, Lexicon, compile_words
from lodestone.llm.packing import WordIds
from lodestone.session import materialised, scratch_path, ship_package, write_bytes

#: Words of the lexicon at most.
WORDS = 1 << 18
#: Words that a task counts before it passes the counts on.
COUNTED = 500_000
#: Bytes of text that are worked on at a time (a longer text by itself).
SLICE = 12_000_000
#: Symbols above which merges take a heap.
FEW = 24
NEVER = 1 << 40


class BpeModel:
    """A vocabulary file of the tokenizers library with word ends and no decoder; its own encoder and decoder."""

    def __init__(self, path: str, lexicon: Lexicon | None = None, special: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        odd = [k for k in ("continuing_subword_prefix", "dropout", "unk_token") if model.get(k)] + [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"not a plain BPE vocabulary without a decoder: {path} {odd}")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be found as they are")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {f" {content}": i for content, i in added.items()} if special else {}  # no chunk has a space in it
        self.marks = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if self.special else None
        self.pieces = [""] * (1 + max([*vocab.values(), *added.values()]))
        for piece, i in [*vocab.items(), *added.items()]:
            self.pieces[i] = piece
        end = model["end_of_word_suffix"] or ""
        letter = [chr(WordIds.BYTES.get(b, b)) for b in range(256)]
        self.byte_of = {c: b for b, c in enumerate(letter)}
        self.inner, self.last = [vocab[c] for c in letter], [vocab[c + end] for c in letter]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.lexicon = lexicon or Lexicon(compile_words({}))
        self.unseen = UnitCache(self.merge)
        self.decimals, self.entries = pa.array([str(i) for i in range(len(self.pieces))], pa.binary()), pa.array(self.pieces, pa.string()).cast(pa.binary())

    # ---------------------------------------------------------------- words

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the adjacent pair of the least rank, leftmost among equals, becomes one symbol until none is known."""
        symbols = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(symbols) > FEW:
            return self._merge_many(symbols)
        known, none = self.pairs.get, (NEVER, -1)
        found = [known(p, none) for p in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best[0] == NEVER:
                break
            at = found.index(best)
            symbols[at : at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = known((symbols[at - 1], best[1]), none)
            if at < len(found):
                found[at] = known((best[1], symbols[at + 1]), none)
        return symbols

    def _merge_many(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(*self.pairs[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.pairs]
        agenda = [(rank, i, new, p) for rank, new, i, p in agenda]
        heapify(agenda)
        while agenda:
            _, i, new, (left, right) = heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := self.pairs.get((symbols[a], symbols[b]))):
                    heappush(agenda, (found[0], a, found[1], (symbols[a], symbols[b])))
        return [s for s in symbols if s >= 0]

    def words(self, chunk: str) -> list[str]:
        """The pre-tokenizer's parts of a chunk without white space."""
        if not WordIds.OTHER.search(chunk):
            return WordIds.PARTS.findall(chunk.lower())
        return [bytes(map(self.byte_of.__getitem__, part)).decode() for part, _ in self.pre_tokenizer.pre_tokenize_str(chunk)]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text that Python's own rules might cut otherwise; a special token is a chunk that starts with a space."""
        if not self.marks:
            return self.normalizer.normalize_str(text).split(" ")
        out, start = [], 0
        for mark in [*self.marks.finditer(text), None]:
            out += self.normalizer.normalize_str(text[start : mark.start() if mark else None]).split(" ")
            if mark:
                out.append(f" {mark[0]}")
                start = mark.end()
        return out

    def cut(self, texts: list[str]) -> pa.ListArray:
        """The chunks of every text, empty ones between them."""
        odd = [bool(WordIds.OTHER.search(t) or self.marks and self.marks.search(t)) for t in texts]
        plain = pc.utf8_split_whitespace(pa.array(["" if o else t for o, t in zip(odd, texts, strict=True)], pa.string()))
        if not any(odd):
            return plain
        own = pa.array([self.chunks(t) for o, t in zip(odd, texts, strict=True) if o], pa.list_(pa.string()))
        where = np.arange(len(texts))
        where[odd] = len(texts) + np.arange(len(own))
        return pa.concat_arrays([plain, own]).take(pa.array(where))

    def parts(self, chunks: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of distinct chunks, put together, and how many each has (a special token is a word that starts with a space)."""
        lists = [[c] if c in self.special else self.words(c) if c else [] for c in chunks.to_pylist()]
        return pa.array([w for words in lists for w in words], pa.string()).dictionary_encode(), np.array(list(map(len, lists)), np.int64)

    def ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, put together, and how many each has: by the lexicon, or by merges."""
        starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        rank = self.lexicon.ranks(data, starts)
        known, unknown = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        flat, sizes = self.lexicon.lists(rank[known])
        new = words.take(pa.array(unknown)).to_pylist()
        lists = [[self.special[w]] if w in self.special else self.unseen[w.encode()] for w in new]
        counts = np.zeros(len(words), np.int64)
        counts[known], counts[unknown] = sizes, list(map(len, lists))
        out = np.zeros(int(counts.sum()), np.int64)
        owner = np.repeat(rank >= 0, counts)
        out[owner] = flat
        out[~owner] = [i for ids in lists for i in ids]
        return out, counts

    # ---------------------------------------------------------------- texts

    def encode_all(self, texts: list[str]) -> Encoded:
        lists = self.cut(texts)
        coded = lists.flatten().dictionary_encode()
        chunk, of_text = coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy())
        words, of_chunk = self.parts(coded.dictionary)
        ids, of_word = self.ids(words.dictionary)
        return Encoded(self, of_text, chunk, of_chunk, words.indices.to_numpy(), of_word, ids)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text]).lists()[0]

    def decode(self, ids: list[int]) -> str:
        """The entries of the ids, a space between two; ids that the vocabulary hasn't got give nothing."""
        return " ".join(self.pieces[i] for i in ids if 0 <= i < len(self.pieces))


def _summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of values put together by their sizes."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _joined(items: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), items), b" ")


class Encoded:
    """Texts as chunks, distinct chunks as words, distinct words as ids: what is asked is put together from there."""

    def __init__(self, model: BpeModel, of_text, chunk, of_chunk, word, of_word, ids) -> None:
        self.model, self.of_chunk, self.word, self.of_word, self.ids = model, of_chunk, word, of_word, ids
        full = of_chunk[chunk] > 0  # without the empty chunks, which would give a space
        self.chunk, self.of_text = chunk[full], _summed(full.astype(np.int64), of_text)

    def counts(self) -> np.ndarray:
        return _summed(_summed(self.of_word[self.word], self.of_chunk)[self.chunk], self.of_text)

    def written(self, table: pa.Array) -> pa.Array:
        """Every text's ids as the table writes them, a space between two."""
        words = _joined(table.take(pa.array(self.ids)), self.of_word)
        chunks = _joined(words.take(pa.array(self.word)), self.of_chunk)
        return _joined(chunks.take(pa.array(self.chunk)), self.of_text)

    def lists(self) -> list[list[int]]:
        return [list(map(int, x.split())) for x in self.written(self.model.decimals).to_pylist()]

    def decoded(self) -> pa.Array:
        return self.written(self.model.entries)


# ---------------------------------------------------------------- jobs


def _counting(path: str, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = BpeModel(path, special=special), {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for _, texts in slices(batches, "__text", SLICE):
            lists = model.cut(texts)
            coded = lists.flatten().dictionary_encode()
            seen = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            words, sizes = model.parts(coded.dictionary)
            n = np.bincount(words.indices.to_numpy(), np.repeat(seen, sizes), len(words.dictionary)).astype(np.int64)
            for word, k in zip(words.dictionary.to_pylist(), n.tolist(), strict=True):
                held[word] = held.get(word, 0) + k
            if len(held) > COUNTED:
                yield told()
        yield told()

    return run


def word_counts(df: DataFrame, path: str, text_col: str = "text", special: bool = True) -> DataFrame:
    """word, n: how often each word stands in all texts."""
    ship_package(df.sparkSession)
    texts = df.select(F.col(f"`{text_col}`").alias("__text"))
    return texts.mapInArrow(_counting(path, special), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = WORDS) -> list[str]:
    """The words seen at least 2^k times, for the least k that leaves no more than so many; the driver gets no others."""
    usable = materialised(counts.where((F.octet_length("word") <= LONGEST) & ~F.startswith("word", F.lit(" "))), "words")
    by_power = {r["k"]: r["c"] for r in usable.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("c")).collect()}
    least, held = 64, 0
    for k in sorted(by_power, reverse=True):
        if held + by_power[k] > most:
            break
        least, held = k, held + by_power[k]
    return [r["word"] for r in usable.where(F.floor(F.log2("n")) >= least).select("word").collect()]


def build_lexicon(spark: SparkSession, words: list[str], path: str) -> str:
    """Compile words with their ids; gives the name by which executors find the file."""
    model = BpeModel(path, special=False)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = f"{scratch_path(spark, 'lexicon')}/{name}"
    write_bytes(spark, place, compile_words({w.encode(): model.merge(w.encode()) for w in words}))
    spark.sparkContext.addFile(place)
    return name


_MODELS: dict[tuple, BpeModel] = {}


def _model(path: str, name: str, special: bool) -> BpeModel:
    key = path, name, special
    if key not in _MODELS:
        _MODELS.clear()  # a worker that goes on to another corpus lets the last one's lexicon go
        _MODELS[key] = BpeModel(path, Lexicon.mapped(SparkFiles.get(name)), special)
    return _MODELS[key]


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _round_trip(path: str, name: str, special: bool, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, name, special)
        sha = lambda texts: pa.array([hashlib.sha256(x).hexdigest() for x in texts.to_pylist()], pa.string())
        for part, texts in slices(batches, "__text", SLICE):
            found = model.encode_all(texts)
            columns = [part.column(0), pa.array(found.counts(), pa.int64()), sha(found.written(model.decimals)), sha(found.decoded())]
            names = ["__id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(found.lists(), pa.list_(pa.int32())), found.decoded().cast(pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def round_trip(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, special: bool = True, keep_ids: bool = False
) -> DataFrame:
    """id, n_tokens, ids_sha256 (of decimal ids, a space between two), decoded_sha256 per row; keep_ids adds ids and decoded."""
    spark = df.sparkSession
    ship_package(spark)
    name = build_lexicon(spark, frequent_words(word_counts(df, path, text_col, special), words), path)
    narrow = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    kind = narrow.schema["__id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if keep_ids else ""
    return narrow.mapInArrow(_round_trip(path, name, special, keep_ids), f"__id {kind}, {SCHEMA}{more}").withColumnRenamed("__id", id_col)
