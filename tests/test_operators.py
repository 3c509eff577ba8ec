import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import fulltext, gate, intake, ivf, maintain, names, search
from lodestone.sources import extract, logs, mail, settings
from lodestone.streaming import intake as stream


def test_arguments():
    assert search.clean_since(" 2025-01 ") == "2025-01" and search.clean_since(None) == ""
    for bad in ("25", "2025-1", "2025-01-01x", "٢٠٢٥", "2025-13", "2025-00", "2025-01-32", "2025-01-00"):
        with pytest.raises(search.BadQuery):
            search.clean_since(bad)
    assert search.clean_list(" , ' ") == [] and search.clean_list("a, 'b'") == ["a", "b"]
    assert [search.clamp_k(x, 20, 10) for x in ("5", 99, 0, None, "x")] == [5, 20, 1, 10, 10]


def hits(spark, rows):
    return spark.createDataFrame([(p, c, t, u, float(s)) for p, c, t, u, s in rows], "path string, chunk int, text string, updated string, score double")


def test_collapse(spark):
    same = "x" * 400
    rows = [("a", 0, same + "1", "", 3), ("b", 0, same + "2", "", 2), ("c", 0, " ", "", 1), ("d", 0, "", "", 1), ("e", 0, "y", "", 1), ("f", 0, " y\x1c", "", 1)]
    assert [r.path for r in search.collapsed(hits(spark, rows), 10).collect()] == ["a", "f", "d", "c"]
    assert search.collapsed(hits(spark, rows), 0).count() == 1


def test_freshness_lets_old_text_fall(spark):
    rows = [("u", 0, "t0", "", 0)] + [(f"p{i:02}", i, f"t{i + 1}", "2026-08-31", 0) for i in range(50)]
    df = hits(spark, rows).withColumn("rrf", 1.0 / (60 + F.when(F.col("path") == "u", 0).otherwise(F.col("chunk") + 1)))
    order = [r.path for r in search.fresh(df.drop("score"), 20260831).orderBy(F.desc("score")).collect()]
    assert order.index("u") == 48


def test_budget_is_greedy(spark):
    rows = [(1, "a" * 50), (2, "b" * 60), (3, "c" * 40), (4, "d" * 20)]
    got = search.budgeted(spark.createDataFrame(rows, "rank long, text string"), 100).orderBy("rank").collect()
    assert [len(r.text) for r in got] == [50, 0, 40, 0]


def test_chunks(spark):
    sizes = [0, 1, 4000, 4001, 7800, 7801, 9000]
    df = spark.createDataFrame([(n, "é" * n) for n in sizes], "n int, text string")
    assert {r.n: r.k for r in df.select("n", F.size(T.chunks(F.col("text"))).alias("k")).collect()} == {0: 0, 1: 1, 4000: 1, 4001: 2, 7800: 2, 7801: 3, 9000: 3}
    parts = spark.createDataFrame([("head\n" + "w" * 5000,)], "text string").select(T.part_chunks(F.col("text")).alias("c")).first().c
    assert len(parts) == 2 and parts[1].startswith("head\nw")


def test_inverted_file(spark, tmp_path):
    """Recall over all ids divisible by 50 against brute force; exact when all cells are probed."""
    import numpy as np

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nearest = {int(ids[q]): set(ids[np.lexsort((ids, np.round(1 - x @ x[q], 6)))[:120]].tolist()) for q in np.flatnonzero(ids % 50 == 0)}
    index = ivf.build(vectors, f"{tmp_path}/ivf", 64)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    for probes, refine, least in ((ivf.PROBES, ivf.REFINE, 1.0), (48, ivf.REFINE, 0.9)):
        found = {}
        for r in ivf.topk(spark, index, queries, 120, probes, refine).collect():
            found.setdefault(r.query, set()).add(r.vec_id)
        assert found.keys() == nearest.keys() and all(len(v) == 120 for v in found.values())
        assert sum(len(found[q] & nearest[q]) for q in nearest) >= least * 120 * len(nearest)
    plan = spark.read.parquet(index.path).where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_codes_find_what_refining_makes_exact(spark, tmp_path):
    """One block of 2000 vectors, of which the codes pass on some to be made exact."""
    import numpy as np

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    x = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in vectors.collect()}
    index = ivf.build(vectors, f"{tmp_path}/ivf", 1)
    assert index.books.shape == (4, 256, 16)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    ids, whole = np.array(list(x)), np.stack(list(x.values()))
    recall = {}
    for refine in (1, 30):
        got = ivf.topk(spark, index, queries, 10, refine=refine).collect()
        hits = sum(r.vec_id in set(ids[np.argsort(-(whole @ x[r.query]))[:10]].tolist()) for r in got)
        recall[refine] = hits / len(got)
    assert 0.3 < recall[1] < recall[30] and recall[30] >= 0.9


def test_inverted_file_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 3)
    monkeypatch.setattr(ivf, "QUERIES", 2)
    rows = [(i, [1.0, i / 100]) for i in range(20)] + [(20, None), (21, [0.0, 0.0]), (22, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = ivf.build(vectors, f"{tmp_path}/a", 4)
    found = ivf.topk(spark, index, vectors.where("vec_id < 6").select(F.col("vec_id").alias("query"), "embedding"), 3).collect()
    assert sorted((r.query, r.place) for r in found) == [(q, p) for q in range(6) for p in (1, 2, 3)]
    assert {(r.query, r.vec_id) for r in found if r.place == 1} == {(q, q) for q in range(6)}


def test_second_dedupe_plan_is_empty(spark):
    from lodestone.plans import log_queries

    sf = "/root/testdata/sf0.001"
    rest = log_queries.dedupe_apply(spark, sf)
    from lodestone.sources.docs import known_files

    again = maintain.dedupe_plan(rest, known_files(spark, sf), log_queries.MAIL, log_queries.RANKS)
    assert again.where("place > 1").count() == 0


def test_swap_checks_rows(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/a")
    assert maintain.swap_in(spark.range(5), f"{tmp_path}/a", f"{tmp_path}/b") == f"{tmp_path}/b"
    with pytest.raises(ValueError):
        maintain.swap_in(spark.range(4), f"{tmp_path}/a", f"{tmp_path}/c")


def tarred(parts):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in parts.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    return out.getvalue()


def test_unpacking():
    data = tarred({"a.txt": b"x", "../b.txt": b"y", "/c.txt": b"z"})
    assert [(n, p) for n, _, p in extract.members(data, "t.tar")] == [("a.txt", None), ("../b.txt", "traversal"), ("/c.txt", "traversal"), ("l", "link")]
    deep = b"core"
    for _ in range(5):
        deep = gzip.compress(deep)
    assert [p for *_, p in extract.walk(deep, "d.gz")][-1] == "depth"
    assert [p for _, _, p in extract.members(b"PK\x03\x04broken", "x.zip")] == ["broken: BadZipFile"]


def test_sniffing():
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", "<w:p/>")
        z.writestr("word/vbaProject.bin", "x")
    assert extract.sniff(made.getvalue(), "a.txt") == ("document", "docx", True)
    assert extract.sniff(b"MZ" + b"\0" * 9, "a.pdf")[0] == "executable" and extract.sniff(b"MZ plain text", "a")[0] == "text"
    assert extract.sniff(b"a\0b", "x")[0] == "other"
    assert extract.split_visible('<p>a<span style="display: none">b</span><br>c</p>') == ("a c", "b")
    assert extract.looks_garbled("".join(chr(0x6161) for _ in range(60))) and not extract.looks_garbled("語" * 60)


def test_member_names_and_budgets():
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("a.txt", b"x" * 40)
        z.writestr("A.TXT", b"y" * 40)
        z.writestr("d/.hidden", b"z")
    assert [p for p, *_ in extract.walk(made.getvalue(), "q.zip")] == ["q.zip/a.txt", "q.zip/A (2).TXT", "q.zip/d/.hidden"]
    assert [(s, p) for _, s, _, p in extract.walk(made.getvalue(), "q.zip", budget=[10, 60])] == [(40, None), (0, "bytes"), (1, None)]
    assert [p for *_, p in extract.walk(made.getvalue(), "q.zip", budget=[1, 600])] == [None, "budget"]
    bomb = gzip.compress(b"0" * 5_000_000)
    assert [(c, p) for _, c, p in extract.members(bomb, "b.gz", 1000)] == [(None, "bytes")]
    for name, code in (("Привет мир.txt", "cp866"), ("Отчёт.doc", "cp1251"), ("résumé été.txt", "utf-8"), ("plain.txt", "ascii")):
        info = zipfile.ZipInfo(name.encode(code).decode("cp437"))
        assert extract.zip_name(info) == name


def test_rtf_and_old_office():
    data = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Hello \b world\b0 \'cf\'f0\par next\u8364? {\*\generator x}\{ok\}}"
    assert extract.rtf_text(data) == ("Hello worldПр\nnext€ {ok}", False)
    assert extract.rtf_text(rb"{\rtf1{\object\objdata 0105}a}")[1]
    blob = b"\x00\x01" + "Secret plan".encode("utf-16-le") + b"\x00\x00\x02" + "обычный текст".encode("cp1251") + b"\x01abc\x00"
    assert extract.office_strings(blob) == "Secret plan\nобычный текст"


def test_text_that_is_not_shown():
    cases = {
        '<p style="font-size:0">a</p>b': ("b", "a"), '<p style="FONT-SIZE: 0.5em">a</p>': ("a", ""), '<i style="opacity:0.0">a</i>b': ("b", "a"), '<b style="color: WHITE !important">a</b>': ("", "a"),
        '<b style="background-color:#fff">a</b>': ("a", ""), "<div hidden>a<p>b<br>c</div>d": ("d", "a b c"), "<script>if (a<b) x()</script>y<style>p{}": ("y", ""), "a &lt; b <!-- c --> d": ("a < b d", ""),
        "<p hidden>a</div>b</p>c": ("c", "a b"),
    }
    for page, want in cases.items():
        assert extract.split_visible(page) == want, page


def test_index_is_never_created_by_readers_and_batches_are_whole(spark, tmp_path):
    home = f"{tmp_path}/index"
    with pytest.raises(logs.NoTable):
        logs.open_index(spark, home)
    schema = "path string, chunk int, text string"
    assert logs.create_index(spark, home, schema) and not logs.create_index(spark, home, schema)
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], schema)
    logs.append_documents(rows, home, "one")
    broken = rows.withColumn("text", F.raise_error(F.lit("reader fell over")).cast("string"))
    with pytest.raises(Exception, match="fell over"):
        logs.append_documents(broken, home, "two")
    assert logs.open_index(spark, home).count() == 2
    with pytest.raises(Exception, match="exist"):
        logs.append_documents(rows, home, "one")


def test_lines_that_are_no_records(spark):
    lines = ['{"batch": "b", "name": "n"}', '{"batch": "b", "na', "[1]", '"x"', "", "null", '{"name": 5}', " {} "]
    got = logs.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), logs.RECEIPT).collect()
    assert [(r.batch, r.name) for r in got] == [("b", "n"), (None, "5"), (None, None)]


def test_walk_of_a_tree(spark, tmp_path):
    for name in ("a/b.txt", "a/_quarantine/c.txt", "d.exe", "e/._f.md", "g.MD"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = names.walk_files(spark, str(tmp_path))
    none = F.lit(None).cast("string")
    kept = files.where(names.walked(F.col("path"), F.lit("files"), none, none))
    assert sorted(r.path for r in kept.collect()) == ["a/b.txt", "g.MD"]


def test_an_empty_stream_has_no_users(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "sf").mkdir()
    events.limit(0).coalesce(1).write.parquet(f"{tmp_path}/sf/events.parquet")
    assert stream.first_seen(spark, f"{tmp_path}/sf").count() == 0


def test_quotes_and_spans(spark):
    rows = [(1, "password: hunter22 and abc123def"), (2, "plain words 12"), (3, "token=ab")]
    got = spark.createDataFrame(rows, "id int, q string").select("id", gate.quote_masked(F.col("q")).alias("q")).collect()
    assert [r.q for r in got] == ["password: hu*** and ab***", "plain words 12", "token=ab***"]
    spans = spark.createDataFrame([([(5, 9), (1, 3), (1, 6), (9, 12), (20, 21)],)], "s array<struct<start:int,end:int>>")
    assert [tuple(x) for x in spans.select(gate.merged_spans(F.col("s")).alias("m")).first().m] == [(1, 9), (9, 12), (20, 21)]


def test_settings_in_layers():
    env = {"X_SEARCH_PROBES": " 80 ", "X_DESCRIBE_PICTURES": "yes", "X_NOBODY": "1", "Y": "2", "X_MAIL_ROOTS": "a: b"}
    values, origin = settings.layered(settings.SETTINGS, b'{"search_probes": 90, "accept_score": 15}', env, "X_")
    assert (values["search_probes"], origin["search_probes"]) == (80, "env") and (values["accept_score"], origin["accept_score"]) == (15.0, "file")
    assert values["search_half_life_days"] == 540 and values["describe_pictures"] is True and values["mail_roots"] == ["a", "b"]
    assert settings.unused_names(settings.SETTINGS, env, "X_") == ["X_NOBODY"]
    for bad in (b'{"search_probes": 0}', b'{"search_probes": "9"}', b'{"search_probes": true}', b'{"odd": 1}', b'{"cache_days": 1, "cache_days": 2}', b"[1]", b"{", b"\xff"):
        with pytest.raises(settings.BadSettings):
            settings.layered(settings.SETTINGS, bad, {}, "X_")
    with pytest.raises(settings.BadSettings):
        settings.layered(settings.SETTINGS, None, {"X_SEARCH_PROBES": "many"}, "X_")


def test_table_of_roots(spark):
    raw = b"""{"roots": {"box": {"kind": "mail", "source": "mail", "rules": [{"contains": ["invoice"], "source": "accounts"}]}, "wiki": {"kind": "pages", "source": "wiki", "attachments": "wiki files"},
      "share": {"kind": "files", "source": "mail", "include": "/plans/"}}, "labels": {"mail": "Mail"}, "aliases": {"oldbox": "box"}}"""
    found = settings.parse_roots(raw)
    assert found.bases() == ["mail", "accounts", "wiki", "wiki files", "intake"] and settings.parse_roots(None).bases() == ["intake"]
    assert [(r.root, r.attachments, r.include, r.rank) for r in found.frame(spark).orderBy("rank").collect()] == [("box", "mail", None, 0), ("wiki", "wiki files", None, 1), ("share", "mail", "/plans/", 2)]
    for bad in (b'{"root": {}}', b'{"roots": []}', b'{"roots": {"a/b": {"kind": "mail", "source": "x"}}}', b'{"roots": {"a": {"kind": "odd", "source": "x"}}}', b'{"roots": {"a": {"kind": "mail"}}}',
                b'{"roots": {"a": {"kind": "mail", "source": "x", "rules": [{"source": "y"}]}}}', b'{"aliases": {"a": "b"}}', b'{"roots": {"a": {"kind": "mail", "source": "x", "q": 1}}}'):
        with pytest.raises(settings.BadSettings):
            settings.parse_roots(bad)


def letter(sender="Ann <ann@x.org>", date="Wed, 01 May 2024 23:30:00 -0500", subject="Re:  Plan", text="Hello, World_1!", extra=""):
    return f"{extra}From: {sender}\r\nDate: {date}\r\nSubject: {subject}\r\n\r\n{text}\r\n".encode()


def test_letter_keys():
    mid, fp, day = mail.keys(letter(extra="Message-ID: < ABC@X >\r\n"), 2026)
    assert (mid, day) == ("abc@x", "2024-05-01") and len(fp) == 32
    same = [letter(sender="A. Nobody <ANN@x.org>"), letter(date="Thu, 02 May 2024 04:30:59 +0000"), letter(subject="re: plan"), letter(text="hello world 1"), letter(extra="Received: from q; Thu, 2 May 2024 10:00:00 +0000\r\n"), letter().replace(b"\r\n", b"\n")]
    assert {mail.keys(x, 2026)[1] for x in same} == {fp}
    other = [letter(sender="bob@x.org"), letter(date="Wed, 01 May 2024 23:31:00 -0500"), letter(subject="Plan"), letter(text="Hello you")]
    assert fp not in {mail.keys(x, 2026)[1] for x in other}
    assert mail.keys(b"To: a@b\r\n\r\nx", 2026) == (None, None, None)
    assert mail.keys(letter(date="garbage", extra="Received: from q; Thu, 2 May 2024 10:00:00 +0000\r\n"), 2026)[2] == "2024-05-02"


def test_attachments_and_calendars():
    inner = b"From: c@d\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Disposition: attachment; filename=deep.pdf.exe\r\n\r\nzz\r\n--q--\r\n"
    outer = b"From: a@b\r\nContent-Type: multipart/mixed; boundary=w\r\n\r\n--w\r\nContent-Type: text/plain\r\n\r\nhi\r\n--w\r\nContent-Type: message/rfc822\r\n\r\n" + inner + b"\r\n--w--\r\n"
    assert [n for n, _ in mail.parts(outer)] == ["letter.eml", "deep.pdf.exe"] and mail.parts(outer)[1][1] == b"zz"
    text = "BEGIN:VEVENT\r\nDTSTART;TZID=\"A:B\":20240501T100000\r\nSUMMARY:Plan\\, long\r\n  er\r\nLOCATION:here\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:cut"
    assert mail.events(text) == [{"start": "20240501T100000", "summary": "Plan, long er", "place": "here"}]


def test_vectors_in_batches_with_bad_chunks(spark):
    def embed(texts):
        if "bad" in texts:
            raise OSError("the service fell over")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("p", i, "bad" if i == 7 else "x" * i) for i in range(100)], "path string, chunk int, text string")
    got = {r.chunk: r.vector for r in logs.embedded(rows, embed).collect()}
    assert got == {i: [float(i)] for i in range(100) if i != 7}


def test_journal_and_reasons(spark, tmp_path):
    calls = spark.createDataFrame([("2", {"q": "ba_abcd-_gh1", "token": "x"}), ("1", {"q": "z" * 300})], "ts string, params map<string,string>")
    lines = [r.value for r in spark.read.text(logs.journal_lines(calls, f"{tmp_path}/j")).collect()]
    assert sorted(lines) == sorted(['{"ts":"2","params":{"q":"ba_***"}}', '{"ts":"1","params":{"q":"' + "z" * 200 + '…"}}'])
    rows = spark.createDataFrame([("text", "txt", 0, False), ("other", "iwork", 5, False), ("text", "txt", 5, True), ("other", "unknown", 5, False), ("archive", "zip", 5, False), ("text", "txt", 5, False)], "family string, kind string, size int, link boolean")
    assert [r[0] for r in rows.select(gate.left_out(F.col("family"), F.col("kind"), F.col("size"), F.col("link"))).collect()] == ["empty", "no reader", "not a file", "not a document", "unpacked", None]


def test_full_text_index_reads_the_asked_terms(spark, tmp_path):
    rows = [("a", 0, "the cat and the dog"), ("b", 0, "a cat"), ("c", 0, "dogs only"), ("d", 1, "")]
    home = fulltext.build(spark.createDataFrame(rows, "path string, chunk int, text string"), f"{tmp_path}/f")
    got = fulltext.best(spark, home, "CAT dog cat")
    assert [r.path for r in got.collect()] == ["a", "b"]
    assert fulltext.best(spark, home, "...").count() == 0 and fulltext.best(spark, home, "absent").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan


def test_looks_go_on_after_a_restart(spark, tmp_path):
    schema = "seen long, entry long, size long, mtime long"
    for seen, rows in ((0, [(1, 5), (2, 5)]), (30, [(1, 5), (2, 6), (3, 1)])):
        spark.createDataFrame([(seen, e, s, 1) for e, s in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/looks/{seen}")
        looks = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/looks")
        state = {r.entry: (r.since, r.ready) for r in stream.watched(spark, looks, f"{tmp_path}/states").collect()}
    assert state == {1: (0, True), 2: (30, False), 3: (30, False)}
