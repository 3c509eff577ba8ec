import zlib

import numpy as np
import pytest

from lodestone.llm import quality


def reference_score(net, text):
    """The network's definition, step by step."""
    raw = text.encode()
    n = quality.steps(len(raw))
    raw = raw + bytes((n + quality.TAPS - 1) * 4 - len(raw))
    kernel = np.concatenate([net.w["conv"][:, t * quality.FILTERS : (t + 1) * quality.FILTERS] for t in range(quality.TAPS)])
    resp = np.stack([net.w["embed"][list(raw[4 * i : 4 * (i + quality.TAPS)])].ravel() @ kernel for i in range(n)])
    chunks, start = [], 0
    while True:
        chunks.append(np.maximum(resp[start : start + quality.CHUNK].max(axis=0) + net.w["bias"], 0))
        if start + quality.CHUNK >= n:
            break
        start += quality.STEP
    c = np.array(chunks)
    x = np.r_[c.max(axis=0), c.mean(axis=0), c.min(axis=0), np.log1p(min(n, quality.CHUNK)) / 5]
    h = np.maximum(x @ net.w["in"] + net.w["in_bias"], 0)
    return 1 / (1 + np.exp(-(h @ net.w["out"] + net.w["out_bias"][0])))


def random_network():
    net = quality.Network(3)
    net.fitted = True
    return net


def test_scores_by_definition(monkeypatch):
    net = random_network()
    rng = np.random.default_rng(1)
    texts = ["", "a", "é" * 7] + ["".join(map(chr, rng.integers(32, 300, n))) for n in (3, 12, 511, 512, 513, 700, 1300, 5000, 30000)]
    want = [reference_score(net, t) for t in texts]
    assert np.allclose(net.score(texts), want, atol=1e-4)
    monkeypatch.setattr(quality, "BLOCK", 2048)  # long texts in parts
    assert np.allclose(net.score(texts[::-1])[::-1], want, atol=1e-4)


def test_gradients():
    net = quality.Network(5)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    raws = [b"hello world " * 60, b"abc", b"The quick brown fox. " * 30, b"x" * 900]
    y, weigh = np.array([0, 1, 1, 0], np.float32), np.ones(4, np.float32)

    def loss():
        x = net.combined(*net.pooled(raws), np.array([quality.steps(len(r)) for r in raws]))
        p = 1 / (1 + np.exp(-(np.maximum(x @ net.w["in"] + net.w["in_bias"], 0) @ net.w["out"] + net.w["out_bias"][0])))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    got = net.gradients(raws, y, weigh)
    for name, at in [("conv", (3, 5)), ("conv", (10, 100)), ("bias", (4,)), ("in", (20, 3)), ("out", (2,))]:
        old = net.w[name][at]
        net.w[name][at] = old + 1e-3
        up = loss()
        net.w[name][at] = old - 1e-3
        down = loss()
        net.w[name][at] = old
        assert got[name][at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-4)


def test_held_out_accuracy(spark):
    from lodestone.llm.queries import op10_quality

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    got = op10_quality(spark, sf).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    known = got[got.held_out & got.doc_id.isin(labels.index)]
    assert (known.predicted.to_numpy() == labels[known.doc_id].to_numpy()).mean() > 0.96


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "", 0), (3, "word " * 60000, 0), (3, "word " * 60000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels)
    assert not net.fitted and [r.score for r in quality.score(docs, net).collect()] == [0.5] * 4
    assert quality.keep_good(docs, net).columns == docs.columns
    scores = [r.score for r in quality.score(docs, random_network()).collect()]
    assert scores[0] == scores[1] and scores[2] == scores[3]
    assert quality.score(docs.limit(0), net).count() == 0
