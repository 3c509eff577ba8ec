import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from lodestone.llm import packing, quality

from . import brute, test_wide

SF = "/root/testdata/sf0.001"


def redacted(text):
    """Base kinds only: the fixture holds no account or social security numbers."""
    out, pos = [], 0
    for span in brute.base_spans(text):
        kind, s, e = span.split(":")
        if int(s) >= pos:
            out += [text[pos : int(s)], f"[{kind.upper()}]"]
            pos = int(e)
        else:
            pos = max(pos, int(e))
    return "".join(out) + text[pos:]


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = [r for r, s in zip(rows, network.score([t for _, t in rows])) if s >= quality.BAR]
    seen = {}
    for doc_id, text in rows:
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), (doc_id, text))
    rows = list(seen.values())
    least = test_wide.plain_components([d for d, _ in rows], [t for _, t in rows])
    rows = [r for r, c in zip(rows, least) if r[0] == c]
    words = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for doc_id, text in rows:
        n = len(np.frombuffer(words.encode(redacted(text)), "<u4")) + 1
        want |= {(doc_id, k): min(4096, n - 4096 * k) for k in range(-(-n // 4096))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): r.length for r in got} == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, None, 0)], docs.schema)
    for frame in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).collect()
