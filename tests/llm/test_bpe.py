import hashlib
import random

import public_tokenizers
import pytest

from lodestone.llm import bpe
from lodestone.llm.lexicon import Lexicon, compile_words

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGES = [
    None, "", " ", "  a  b ", "\n\n a\r\n b", "é\x00x", "éa ̈x", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|>a<|startoftext|><|startoftext|",
    "a" * 5000, "日本語 한국어 😀", "İSTANBUL ΣΑΣ", "it's 'so '''s we'LL 12ab34", "a\x1cb\x85c d", "don’t", "x" * 30 + "'s", "ẞ ǅ ﬁ", "٣٤ Ⅷ ½ ²",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def random_texts(n):
    rng = random.Random(3)
    words = ["the", "The", "of", "it's", "they'll", "1234", "a-b", "(c)", "naïve", "Straße", "<|endoftext|>", "日本", "́", " ", "!!", "''s"]
    signs = "abcdeéÉIİıſ  \n\t'sdlmt12-_.,!日😀́ͅΣσK<|>endoftext \x1f\x85힣가"
    for k in range(n):
        if k % 2:
            yield "".join(rng.choices(signs + chr(rng.randint(0x20, 0x2FFF)) + chr(rng.randint(0xE000, 0x1FFFF)), k=rng.randint(0, 50)))
        else:
            yield rng.choice([" ", "", "  ", "\n"]).join(rng.choices(words, k=rng.randint(0, 20)))


@pytest.mark.parametrize("share", [0, 1, 2])
def test_ids_and_decoded_texts_are_the_librarys(library, share):
    """Without a lexicon, with every other word in it, and with all."""
    texts = [t or "" for t in EDGES] + list(random_texts(1500))
    model = bpe.BpeModel(PATH)
    words = sorted({w for t in texts for c in model.chunks(t) if not c.startswith(" ") for w in model.words(c)})
    chosen = {0: [], 1: words[::2], 2: words}[share]
    model = bpe.BpeModel(PATH, Lexicon(compile_words({w.encode(): model.merge(w.encode()) for w in chosen if len(w.encode()) <= 48})))
    found = model.encode_all(texts)
    for text, ids, decoded, n in zip(texts, found.lists(), found.decoded().to_pylist(), found.counts(), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert (ids, n) == (want, len(want)), text
        assert decoded.decode() == library.decode(want, skip_special_tokens=False) == model.decode(want), text


def test_special_tokens_as_plain_text(library):
    model = bpe.BpeModel(PATH, special=False)
    library.encode_special_tokens = True
    try:
        for text in ["<|endoftext|>", "a<|startoftext|>b", "x"]:
            assert model.encode(text) == library.encode(text, add_special_tokens=False).ids
    finally:
        library.encode_special_tokens = False


def test_automaton_is_minimal_and_exact(tmp_path):
    rng = random.Random(1)
    words = {bytes(rng.choices(b"abc\xff", k=rng.randint(1, 9))) for _ in range(3000)}
    entries = {w: [len(w), *w] for w in words}
    path = tmp_path / "x.bin"
    path.write_bytes(compile_words(entries))
    lexicon = Lexicon.mapped(str(path))
    asked = sorted(words | {bytes(rng.choices(b"abcd\xff", k=rng.randint(0, 60))) for _ in range(3000)})
    import numpy as np

    starts = np.cumsum([0, *map(len, asked)])
    ranks = lexicon.ranks(np.frombuffer(b"".join(asked), np.uint8), starts)
    assert [r >= 0 for r in ranks] == [w in words for w in asked]
    assert [sorted(words)[r] for r in ranks if r >= 0] == [w for w in asked if w in words]
    flat, counts = lexicon.lists(ranks[ranks >= 0])
    assert flat.tolist() == [i for w in asked if w in words for i in entries[w]] and counts.tolist() == [len(w) + 1 for w in asked if w in words]
    rights = set()  # a minimal automaton has a state for each different set of continuations
    for w in words:
        for k in range(len(w) + 1):
            rights.add(frozenset(x[k:] for x in words if x.startswith(w[:k])))
    assert lexicon.states == len(rights)
    assert Lexicon(compile_words({})).ranks(np.frombuffer(b"a", np.uint8), np.array([0, 1])).tolist() == [-1]


def test_only_words_above_a_power_of_two_and_no_more_than_asked(spark):
    df = spark.createDataFrame([("a " * 9 + "b " * 8 + "c c c d",), (None,)], "text string")
    counts = bpe.word_counts(df, PATH)
    assert {(r.word, r.n) for r in counts.collect()} == {("a", 9), ("b", 8), ("c", 3), ("d", 1)}
    for most, want in ((4, "abcd"), (3, "abc"), (2, "ab"), (1, ""), (0, "")):
        assert "".join(sorted(bpe.frequent_words(counts, most))) == want


def test_edges(spark, library):
    rows = [(i, t, "x", 0) for i, t in enumerate(EDGES)] + [(None, "twice", None, 1), (3, "twice", "y", 1), (3, "twice", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n_tokens int")
    got = bpe.round_trip(df, PATH, words=5, keep_ids=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=repr) == sorted(((i, *expected(library, t)) for i, t, *_ in rows), key=repr)
    assert all(len(r.ids) == r.n_tokens and sha(r.decoded) == r.decoded_sha256 for r in got)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_query(spark, library):
    from lodestone.llm.queries import op12_lexicon

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_lexicon(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id])
