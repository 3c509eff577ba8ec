import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())


EDGES = [None, "", " ", "  a  b ", "\n", "\n\n a\r\n b", "é\x00x", "▁", "▁▁a ▁", "<s> </s> <unk> <0x41>", "a" * 5000, " " * 40 + "x", "日本語 한국어 😀"]


def test_random_texts(library):
    model = pieces.PieceModel(PATH)
    rng = random.Random(1)
    for text in [t or "" for t in EDGES] + ["".join(rng.choices("ab  \n▁éеñ12日😀.,-_", k=rng.randint(0, 60))) for _ in range(1500)]:
        ids = np.frombuffer(model.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True), text
        assert model.decode(ids) == library.decode(ids), text


def test_texts_of_a_batch_side_by_side(library):
    import pyarrow as pa

    model = pieces.PieceModel(PATH)
    rng = random.Random(2)
    texts = [t or "" for t in EDGES] + [" ".join("".join(rng.choices("abethinrsо日😀é\n.,-", k=rng.randint(1, 40))) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for _ in range(2):  # new words, then remembered ones
        for text, blob in zip(texts, model.encode_all(pa.array(texts)), strict=True):
            assert np.frombuffer(blob, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True), text


def test_the_ids_are_the_agendas_and_wrong_ones_are_marked_in_every_slice(library, monkeypatch):
    import pyarrow as pa

    model = pieces.PieceModel(PATH)
    model.rank.pop("▁the")
    model._pairs()
    monkeypatch.setitem(pieces._MODELS, PATH, model)
    texts = ["the end", "no such word", "by the sea", ""]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t])], ["__id", "__text"]) for k, t in enumerate(texts)]
    got = [row for b in pieces._round_trip(PATH, True)(iter(batches)) for row in b.to_pylist()]
    assert [row["agrees"] for row in got] == [False, True, False, True]
    for row, text in zip(got, texts, strict=True):
        right = library.encode(text, add_bos=True, add_eos=True)
        assert (row["ids"] == right) == row["agrees"] and row["n_tokens"] == len(row["ids"])
        assert row["ids_sha256"] == hashlib.sha256(np.array(row["ids"], "<u4").tobytes()).hexdigest()
        assert row["decoded"] == library.decode(right)  # other pieces of the same text


def test_query(spark, library):
    from lodestone.llm.queries import op9_pieces

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_pieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.agrees and (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id])


def test_edges(spark, library):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(EDGES)], "doc_id long, text string, n_tokens int")
    for r in pieces.round_trip(df, PATH, keep_ids=True).collect():
        assert r.agrees and (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, EDGES[r.doc_id])
        assert len(r.ids) == r.n_tokens
    assert pieces.round_trip(df.limit(0), PATH).count() == 0
