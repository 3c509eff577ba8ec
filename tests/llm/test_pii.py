from pyspark.sql import functions as F

from lodestone.llm import pii

from . import brute

TEXTS = [
    None, "", "no data", "a@b.co", "a@b.co_x@y.com@z.org", "..@-.-", "x@y", "w" * 5000 + "@" + "d.e" * 10,
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 0000255.0.0.1", "1.2.3", "99999999999999999999999.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "3782 822463 10005", "1" * 30000, "4 " * 9000,
    "call +1 (743) 555-3824 or +1((((2", "+12345678901234567", "+33 1 23 45 67 89.", "é\U0001f600 +1 (743) 555-3824 é a@b.co",
    "+14111111111111111.1.1.1@b.co", "IBAN DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013001", "ssn 123-45-6789", "part 123-45-6789",
    "a@b.co " * 300,
]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, __s string")


def test_base_spans_match_brute_force(spark):
    got = {r[0]: r[1] for r in pii.find(rows(spark)).select("doc_id", pii.spans_text(F.filter("pii", lambda x: x["ord"] < 4))).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == ",".join(brute.base_spans(text)), (i, (text or "")[:80])


def test_query_matches_brute_force(spark):
    from lodestone.llm.queries import op8_pii

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")["text"]
    got = op8_pii(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for doc_id, text in docs.items():
        spans = brute.base_spans(text)
        assert got.base_sha256[doc_id] == brute.sha(",".join(spans))
        for k in brute.KINDS:
            assert got[f"n_{k}"][doc_id] == sum(s.startswith(k) for s in spans)
        assert set(spans) <= set(got.spans[doc_id].split(","))
    assert got.n_card.sum() and got.n_ip.sum() and got.n_email.sum() and got.n_phone.sum()


def test_added_kinds_and_redaction(spark):
    out = {r.doc_id: r.text for r in pii.redact(rows(spark)).collect()}
    assert out[20] == "IBAN [IBAN] ok" and out[21] == TEXTS[21]
    assert out[22] == "ssn [SSN]" and out[23] == TEXTS[23]
    assert out[0] is None and out[1] == "" and out[3] == "[EMAIL]"
    assert out[18] == "é😀 [PHONE] é [EMAIL]"
    assert pii.redact(rows(spark)).columns == ["doc_id", "text", "__s"]
    assert pii.redact(rows(spark, [])).count() == 0


def test_time_follows_the_length(spark):
    """Ten times as many numbers take about ten times as long, valid or not."""
    import time

    took = {}
    for text, sizes, valid in (("12  ab 345 ", (20_000, 200_000), 0), ("10.1.2.3 x ", (10_000, 100_000), 1)):
        for n in sizes:
            df = spark.createDataFrame([(1, text * n)], "doc_id long, text string")
            start = time.time()
            row = pii.redact(pii.find(df)).select(F.size("pii").alias("n"), F.length("text").alias("size")).first()
            took[valid, n] = time.time() - start
            assert (row.n, row.size) == (n * valid, n * (7 if valid else 11))
        assert took[valid, sizes[1]] < 20 * took[valid, sizes[0]] + 5, took


def test_columns_of_any_name_stay(spark):
    names = ["__t", "__digits", "__email", "__pii", "cuts", "found", "x", "__s"]
    df = spark.createDataFrame([(1, "a@b.co", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert pii.find(df).columns == [*df.columns, "pii"]
    row = pii.redact(df).first()
    assert row.asDict() == {"doc_id": 1, "text": "[EMAIL]"} | {n: n for n in names}


def test_long_texts_with_spans_across_blocks(spark):
    text = "é call +1 (743) 555-3824 or a@b.co; card 4111 1111 1111 1111. " * 1500 + "x" * 9000 + " c@d.org"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.find(df).select(pii.spans_text(F.filter("pii", lambda x: x["ord"] < 4)).alias("s")).first().s
    assert got == ",".join(brute.base_spans(text))
    clean = pii.redact(df).first().text
    assert clean == "é call [PHONE] or [EMAIL]; card [CARD]. " * 1500 + "x" * 9000 + " [EMAIL]"
