import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from lodestone.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Whole:
    """Alignment of whole texts by both libraries, without segments."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.byte = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}

    def groups(self, text):
        if not text:
            return []
        first = self.a.encode(" " + text, add_special_tokens=False).ids
        second = self.b.encode(text)
        raw_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in first]
        raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in second for p in [self.b.id_to_piece(i)]]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return []
        ends = []
        for raw in (raw_a, raw_b):
            at, own = 0, []
            for x in raw:
                at += len(x)
                own.append(at)
            ends.append(own)
        out, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            out.append((first[i:k], second[j:m]))
            i, j = k, m
        return out

    def table(self, rows):
        found = [(i, self.groups(t)) for i, t in rows]
        count = Counter((a[-1], b[-1]) for _, g in found for a, b in g)
        most = Counter()
        for (_, b), n in count.items():
            most[b] = max(most[b], n)
        out = []
        for i, g in found:
            own = [(a[-1], b[-1]) for a, b in g]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((
                i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            ))
        return sorted(out, key=repr)


@pytest.fixture(scope="module")
def whole():
    return Whole()


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
EDGES = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a \n b", "a\n\nb c\n", "\ta\tb\t \r\nc;\r\nd", "a b c", "x▁y", "▁", "<s> </s> <|endoftext|><0x41>", "it's 'll  they're\n'm", "日本語 한국어 😀 \n😀",
    "é\x00x \x1c y\x1cz", "    def f():\n        return {\n\r\n}", "a" * 3000, " " * 70 + "x" + "\n" * 9,
]


def texts(n, seed=5):
    rng = random.Random(seed)
    words = ["the", "The end", "naïve", "won't", "x1", "12", "--", "日", "😀", "{", ");", "ing", "tion", "\xa0", "　"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "", "\n", "\n\n", "  ", "\t", "\r\n", " \n ", "\x85"]) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def got(df):
    assert df.columns[:8] == COLUMNS
    return sorted((tuple(r[:8]) for r in df.collect()), key=repr)


def test_space_is_verified():
    assert align.Aligner(A, B).safe.startswith(" ") and "\r" not in align.Aligner(A, B).safe  # ";\r" is a piece
    assert align.safe_spaces([b"a", b" b"], ["▁a"]) == align.SPACES
    assert " " not in align.safe_spaces([b"a b"], []) and " " not in align.safe_spaces([], ["a▁b"])
    assert "\n" not in align.safe_spaces([], ["▁\n"]) and "\n" in align.safe_spaces([b" \n"], ["\n\n"])


def test_segments_are_the_text_and_their_tokens_the_whole_texts():
    both, whole = align.Aligner(A, B), Whole()
    some = [t for t in EDGES + texts(400) if t and both.usable(t)]
    words, codes, sizes = both.cut(some)
    at = 0
    for text, n in zip(some, sizes, strict=True):
        own = words.take(codes[at : at + n]).to_pylist()
        at += n
        assert "".join(own) == " " + text
        first, second = both.tokens(own)
        assert [i for x in first for i in x] == whole.a.encode(" " + text, add_special_tokens=False).ids, text
        assert [i for x in second for i in x] == whole.b.encode(text), text


def test_packed_groups_and_numbers():
    import numpy as np

    rng = np.random.default_rng(3)
    for high in (50, 70_000):  # with and without ids above 16 bits
        n_groups = rng.integers(1, 5, 40)
        size_a, size_b = (rng.integers(1, 4, n_groups.sum()) for _ in range(2))
        a, b = (rng.integers(0, high, s.sum()) for s in (size_a, size_b))
        for x, y in zip(align.unpacked(align.packed(a, b, size_a, size_b, n_groups)), (a, b, size_a, size_b, n_groups), strict=True):
            assert x.tolist() == y.tolist()
    sizes = rng.integers(0, 6, 30)
    values = rng.choice([0, 1, 127, 128, 16383, 16384, 2**21, 2**31 - 1], sizes.sum())
    got, counts = align.from_varints(align.varints(values, sizes))
    assert got.tolist() == values.tolist() and counts.tolist() == sizes.tolist()
    none = align.from_varints(align.varints(np.zeros(0, np.int64), np.zeros(3, np.int64)))
    assert [x.tolist() for x in none] == [[], [0, 0, 0]]


@pytest.mark.parametrize("most", [align.SLICE, 50])
def test_against_whole_texts(spark, whole, most, monkeypatch):
    rows = list(enumerate(EDGES + texts(300))) + [(None, "the end"), (4, "the end"), (4, "the end")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, segment string, slice int")
    monkeypatch.setattr(align, "COMPOSED", 40)
    assert got(align.align(df.repartition(3), A, B, most=most)) == whole.table(rows)


def test_names_and_empty_tables(spark, whole):
    df = spark.createDataFrame([("x", "a b"), ("y", None)], "`the id` string, `my.text` string")
    found = align.align(df, A, B, "the id", "my.text")
    assert sorted(tuple(r) for r in found.collect()) == whole.table([("x", "a b"), ("y", None)])
    assert align.align(df.limit(0), A, B, "the id", "my.text").count() == 0
    assert align.align(df.where("`the id` = 'y'"), A, B, "the id", "my.text").count() == 1


def test_query(spark, whole):
    from lodestone.llm.queries import op11_align

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op11_align(spark, sf)) == whole.table(rows)
