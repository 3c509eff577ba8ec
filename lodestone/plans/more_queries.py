"""Logs, sinks, names, files, dates and review: rows derived from stored tables, each with SQL that computes its answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import dates as D
from lodestone.functions import text as T
from lodestone.operators import gate as G
from lodestone.operators import maintain as M
from lodestone.operators import names as N
from lodestone.operators import ops as O
from lodestone.plans.registry import query
from lodestone.session import scratch_path, table
from lodestone.sources import logs as L
from lodestone.sources.docs import DOCS_SQL, KNOWN_SQL, RECEIPTS_SQL, docs, documents, known_files, receipts

D_ = f"WITH {DOCS_SQL}"
R_ = f"WITH {RECEIPTS_SQL}"


# ---------------------------------------------------------------- logs and sinks


@query(f"""{R_} SELECT batch, name, decision, time FROM receipts WHERE line % 11 <> 0 AND line % 13 <> 0""")
def receipts_scan(spark, sf):
    r = receipts(spark, sf)
    line = F.to_json(F.struct("batch", "name", "decision", "time"))
    torn = F.when(F.col("line") % 11 == 0, F.substring(line, 1, 25)).when(F.col("line") % 26 == 0, F.lit('["a"]')).when(F.col("line") % 13 == 0, F.lit('"text"')).otherwise(line)
    path = scratch_path(spark, "receipt-lines")
    r.select(torn.alias("value")).write.text(path)
    return L.read_lines(spark, path).select("batch", "name", "decision", "time")


@query(f'{R_} SELECT batch, name, decision, time, "by" FROM receipts')
def receipts_write(spark, sf):
    rows = receipts(spark, sf).select("batch", "name", "decision", "time", "by")
    return L.read_lines(spark, L.write_lines(rows, scratch_path(spark, "receipts"), "name", "time"))


@query(f"{D_} SELECT path, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM docs GROUP BY path")
def index_append(spark, sf):
    home = scratch_path(spark, "index")
    rows = docs(spark, sf).select("path", "chunk", "text")
    L.create_index(spark, home, "path string, chunk int, text string")
    for k in range(2):
        L.append_documents(rows.where(F.pmod(F.xxhash64("path"), F.lit(2)) == k), home, f"pass-{k}")
    return L.open_index(spark, home).groupBy("path").agg(F.count("*").alias("chunks"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))


@query(f"""{D_}, i AS (SELECT path FROM docs_whole UNION ALL SELECT replace(path, '/', chr(92)) FROM docs_whole WHERE doc_id % 3 = 0 UNION ALL
 SELECT 'old' || substr(path, 5) FROM docs_whole WHERE source = 'src2')
SELECT path FROM i WHERE replace(CASE WHEN starts_with(path, 'old') THEN 'src2' || substr(path, 4) ELSE path END, chr(92), '/') NOT IN (SELECT path FROM docs_whole WHERE doc_id % 4 = 0)""")
def delete_forms(spark, sf):
    d = documents(spark, sf)
    index = d.select("path").unionByName(d.where("doc_id % 3 = 0").select(F.translate("path", "/", "\\").alias("path")))
    index = index.unionByName(d.where("source = 'src2'").select(F.concat(F.lit("old"), F.expr("substring(path, 5)")).alias("path")))
    return N.without_document(index, d.where("doc_id % 4 = 0").select("path"), {"old": "src2"})


@query(f"WITH {DOCS_SQL}, {KNOWN_SQL} SELECT path, sha FROM known WHERE path NOT IN (SELECT path FROM docs_whole WHERE doc_id % 6 = 1)")
def known_remove(spark, sf):
    return M.without_paths(known_files(spark, sf), documents(spark, sf).where("doc_id % 6 = 1")).select("path", "sha")


DEBTS_SQL = f"""{D_}, old AS (SELECT path AS rel, 'old' AS why, path FROM docs_whole WHERE doc_id % 3 = 0), new AS (SELECT path AS rel, 'new' AS why, path FROM docs_whole WHERE doc_id % 5 = 0),
debts AS (SELECT * FROM old UNION ALL SELECT * FROM new WHERE rel NOT IN (SELECT rel FROM old))"""


def _debts(spark, sf):
    d = documents(spark, sf)
    old, new = (d.where(f"doc_id % {k} = 0").select(F.col("path").alias("rel"), F.lit(w).alias("why"), "path") for k, w in ((3, "old"), (5, "new")))
    return L.add_debts(old, new)


@query(f"{DEBTS_SQL} SELECT rel, why FROM debts WHERE rel NOT IN (SELECT path FROM docs_whole WHERE doc_id % 10 = 0)")
def debts_kept(spark, sf):
    return L.drop_debts(_debts(spark, sf), documents(spark, sf).where("doc_id % 10 = 0").select(F.col("path").alias("rel"))).select("rel", "why")


@query(f"{DEBTS_SQL} SELECT rel, path IN (SELECT path FROM docs_whole WHERE doc_id % 7 <> 0) AS there FROM debts")
def debts_files(spark, sf):
    open_, gone = L.open_debts(_debts(spark, sf), documents(spark, sf).where("doc_id % 7 <> 0"))
    return open_.select("rel", F.lit(True).alias("there")).unionByName(gone.select("rel", F.lit(False).alias("there")))


NOTES_SQL = """notes AS (SELECT batch, CASE WHEN line % 2 = 0 THEN name ELSE 'no-' || name END AS name, 'accept' AS decision, time FROM receipts WHERE line % 17 = 0)"""


@query(f"""{R_}, {NOTES_SQL} SELECT batch, name, decision, time, "by" FROM receipts UNION ALL
SELECT batch, name, decision, time, 'owner' FROM notes n WHERE EXISTS (SELECT 1 FROM receipts r WHERE r."by" IS NULL AND r.batch = n.batch AND r.name = n.name)""")
def owner_notes(spark, sf):
    r = receipts(spark, sf)
    name = F.when(F.col("line") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("no-"), "name"))
    notes = r.where("line % 17 = 0").select("batch", name.alias("name"), F.lit("accept").alias("decision"), "time")
    return L.noted(r.select("batch", "name", "decision", "time", "by"), notes)


@query("""WITH s AS (SELECT event_id AS id, to_timestamp(floor(epoch(ts) / 600) * 600) AS start FROM events)
SELECT id, strftime(start AT TIME ZONE 'UTC', '%Y%m%d-%H%M%S') || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS batch FROM s WINDOW w AS (PARTITION BY start ORDER BY id)""")
def batch_numbers(spark, sf):
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 600) * 600)
    return L.numbered_batches(table(spark, sf, "events").select(F.col("event_id").alias("id"), start.alias("start")))


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id, epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) >= 7200 AS gone FROM events, n""")
def ttl_sweep(spark, sf):
    e = table(spark, sf, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", L.expired(F.col("ts"), F.col("now"), 7200).alias("gone"))  # one row


@query("SELECT DISTINCT upper(event_type) || '_' || (event_id % 40) AS name FROM events WHERE event_id % 40 NOT IN (SELECT n_nationkey FROM nation)")
def unused_env(spark, sf):
    given = table(spark, sf, "events").select(F.concat(F.upper("event_type"), F.lit("_"), (F.col("event_id") % 40).cast("string")).alias("name")).distinct()
    schema = table(spark, sf, "events").select(F.upper("event_type").alias("t")).distinct().crossJoin(F.broadcast(table(spark, sf, "nation").select("n_nationkey")))  # 25 nations
    return given.join(schema.select(F.concat("t", F.lit("_"), F.col("n_nationkey").cast("string")).alias("name")), "name", "left_anti")


@query("""WITH a AS (SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS has, user_id % 4 AS need FROM events)
SELECT event_id, coalesce(need > 0 AND has >= need, false) AS allowed FROM a""")
def access_levels(spark, sf):
    level = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "full").when(F.col("event_type") == "purchase", "local").otherwise("guest")
    need = F.get(F.array(*map(F.lit, ["nobody", *N.LEVELS])), (F.col("user_id") % 4).cast("int"))
    return table(spark, sf, "events").select("event_id", N.allows(level, need).alias("allowed"))


# ---------------------------------------------------------------- names and paths


PLACES_SQL = f"""{D_}, p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'mail' WHEN 1 THEN 'pages' ELSE 'files' END AS kind,
 source || CASE WHEN doc_id % 19 = 0 THEN '/_quarantine/' ELSE '/' END || space || CASE WHEN doc_id % 23 = 0 THEN '/._' ELSE '/' END || doc_id ||
 CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' WHEN 2 THEN '.json' WHEN 3 THEN '.exe' WHEN 4 THEN '.md' WHEN 5 THEN '.png' ELSE '' END AS path FROM docs_whole)"""


def _places(spark, sf):
    d, i = documents(spark, sf), F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ["mail", "pages", "files"])), (i % 3).cast("int"))
    extension = F.get(F.array(*map(F.lit, [".pdf", ".TXT", ".json", ".exe", ".md", ".png", ""])), (i % 7).cast("int"))
    path = F.concat("source", F.when(i % 19 == 0, "/_quarantine/").otherwise("/"), "space", F.when(i % 23 == 0, "/._").otherwise("/"), i.cast("string"), extension)
    return d.select("doc_id", kind.alias("kind"), path.alias("path"))


@query(f"""{PLACES_SQL} SELECT path FROM p WHERE doc_id % 19 <> 0 AND doc_id % 23 <> 0 AND doc_id % 7 IN (0, 1, 2, 4) AND NOT (kind = 'mail' AND doc_id % 7 = 2)
 AND (kind <> 'pages' OR contains(path, '/en/')) AND (kind <> 'files' OR NOT contains(path, 'src1'))""")
def corpus_walk(spark, sf):
    p = _places(spark, sf)
    include, exclude = F.when(F.col("kind") == "pages", "/en/"), F.when(F.col("kind") == "files", "src1")
    return p.where(N.walked(F.col("path"), F.col("kind"), include, exclude)).select("path")


@query(f"{PLACES_SQL} SELECT path, CASE WHEN doc_id % 11 = 0 THEN doc_id % 2 = 0 ELSE doc_id % 7 IN (0, 5) END AS wanted FROM p")
def describable_files(spark, sf):
    found = F.when(F.col("doc_id") % 22 == 0, "png").when(F.col("doc_id") % 11 == 0, "docx")
    return _places(spark, sf).select("path", N.describable(found, F.col("path")).alias("wanted"))


@query(f"{D_} SELECT doc_id FROM docs_whole WHERE NOT (doc_id % 5 = 0 OR doc_id % 8 = 3)")
def inbox_entries(spark, sf):
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("."), "title")).when(F.col("doc_id") % 8 == 3, "Thumbs.DB").otherwise(F.col("title"))
    return documents(spark, sf).where(~N.ignored(name, ["thumbs.db"])).select("doc_id")


@query(f"""{D_} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'src9/' || path WHEN 1 THEN path WHEN 4 THEN 'x/' || title END AS inside FROM docs_whole""")
def sandbox_paths(spark, sf):
    i, path = F.col("doc_id") % 5, F.col("path")
    asked = F.when(i == 0, F.concat(F.lit("/old/"), path)).when(i == 1, F.translate(path, "/", "\\")).when(i == 2, F.concat(F.lit("a/../../"), path)).when(i == 3, F.concat(F.lit("C:/"), path))
    return documents(spark, sf).select("doc_id", N.sandboxed(asked.otherwise(F.concat(F.lit("./x//"), F.col("title"))), {"old": "src9"}).alias("inside"))


@query(r"""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'a/b' || doc_id || '?/c.txt' WHEN 1 THEN 'd/' || doc_id || '. .' WHEN 4 THEN 'e/' || doc_id WHEN 5 THEN 'f/' || repeat('é', 109) || '_' || substr(sha256(repeat('é', 150) || doc_id || '.txt'), 1, 8) || '.txt'
 WHEN 7 THEN 'g...h/' || doc_id END AS safe FROM documents""")
def safe_member_paths(spark, sf):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 8
    at = lambda *parts: F.concat(*[i if p is None else F.lit(p) for p in parts])
    name = (
        F.when(k == 0, at("a\\b", None, "?/./c.txt")).when(k == 1, at("d//", None, ". .")).when(k == 2, at("/", None)).when(k == 3, at("a/ .\x01./", None))
        .when(k == 4, at("e/ . /", None, "\x07 ")).when(k == 5, at("f/" + "é" * 150, None, ".txt")).when(k == 6, at("C:", None)).otherwise(at("g...h/", None))
    )
    return table(spark, sf, "documents").select("doc_id", T.safe_parts(name).alias("safe"))


# ---------------------------------------------------------------- texts


@query(r"""WITH m AS (SELECT doc_id, '<g id="' || source || '" NAME="no" label="x" id="' || source || '" xid="no"><name="' || replace(substr(text, 1, 8 * (doc_id % 20)), '"', '') || '">' || text AS t FROM documents),
f AS (SELECT *, list_filter(regexp_extract_all(t, '\b(?:name|id|label|documentation)="([^"]*)"', 1), lambda x: length(x) BETWEEN 2 AND 120) AS l FROM m)
SELECT doc_id, sha256(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)) || chr(10) || regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM f""")
def markup_labels(spark, sf):
    d = table(spark, sf, "documents")
    cut = F.replace(F.expr("substring(text, 1, cast(8 * (doc_id % 20) as int))"), F.lit('"'), F.lit(""))
    t = F.concat(F.lit('<g id="'), "source", F.lit('" NAME="no" label="x" id="'), "source", F.lit('" xid="no"><name="'), cut, F.lit('">'), "text")
    return d.select("doc_id", F.sha2(T.markup_text(t), 256).alias("text"))


@query(f"""{D_}, s AS (SELECT path, trim(regexp_replace(substr(text, 1, 400), '\\s+', ' ', 'g')) AS t FROM docs WHERE chunk = 0),
e AS (SELECT path, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM s)
SELECT path, regexp_replace(t, '(?i)(garden|the|and)', '<mark>\\1</mark>', 'g') AS shown FROM e""")
def highlighted(spark, sf):
    d = docs(spark, sf).where("chunk = 0")
    return d.select("path", T.highlighted(F.substring("text", 1, 400), F.lit("The garden of an and THE")).alias("shown"))


@query(f"""{D_} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Given ' || doc_id WHEN 1 THEN 'On ' || substr(regexp_extract(text, '([a-zA-Z]+)', 1), 1, 100) ELSE doc_id || '.txt' END AS title FROM docs_whole""")
def intake_titles(spark, sf):
    d, i = documents(spark, sf), F.col("doc_id") % 3
    given = F.when(i == 0, F.concat(F.lit(" Given "), F.col("doc_id").cast("string"), F.lit(" "))).otherwise(" ")
    letter = F.when(i == 1, F.concat(F.lit("From: x\nSubject: On "), F.substring(F.regexp_extract("text", "([a-zA-Z]+)", 1), 1, 100), F.lit("\nSubject: no"))).otherwise(F.regexp_replace("text", "Subject:", ""))
    return d.select("doc_id", T.intake_title(given, letter, F.col("path")).alias("title"))


@query("""SELECT doc_id, '"' || replace(replace(replace(substr(text, 1, 60), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"' AS quoted FROM documents""")
def diagram_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.diagram_name(F.substring("text", 1, 60)).alias("quoted"))


LETTERS_SQL = r"""l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ann' || doc_id || '@x.org' WHEN 1 THEN 'ann@x.org' ELSE '' END AS address,
 CASE WHEN doc_id % 3 = 0 THEN '' ELSE '202405011000' END AS minute, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lower(trim(regexp_replace(substr(text, 1, 30), '\s+', ' ', 'g'))) END AS subject,
 substr(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', '', 'g'), 1, 200) AS body FROM documents)"""


@query(f"WITH {LETTERS_SQL} SELECT doc_id, CASE WHEN address || minute || subject <> '' OR (doc_id % 5 <> 0) THEN substr(sha256(address || '|' || minute || '|' || subject || '|' || body), 1, 32) END AS fp FROM l")
def letter_prints(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    sender = F.when(i % 4 == 0, F.concat(F.lit("Ann (x) <Ann"), i.cast("string"), F.lit("@X.org>"))).when(i % 4 == 1, "ann@x.org (Ann)").when(i % 4 == 2, "")
    minute, subject = F.when(i % 3 != 0, "202405011000"), F.when(i % 5 != 0, F.substring("text", 1, 30))
    return d.select("doc_id", T.letter_fingerprint(sender, minute, subject, F.col("text")).alias("fp"))


# ---------------------------------------------------------------- dates


@query(f"""{D_}, n AS (SELECT doc_id, updated AS u, strftime(DATE '2024-01-01' + CAST(doc_id * 37 % 900 AS INTEGER), '%Y-%m-%d') AS day, doc_id % 5 AS k, doc_id % 7 AS m FROM docs_whole)
SELECT doc_id, CASE WHEN m = 1 AND day <= '2025-12-31' THEN 'metadata' WHEN k IN (0, 1, 4) AND day <= '2025-12-31' THEN 'name' WHEN doc_id % 2 = 0 THEN 'file' ELSE 'accepted' END AS origin,
 CASE WHEN (m = 1 OR k IN (0, 1, 4)) AND day <= '2025-12-31' THEN day WHEN doc_id % 2 = 0 THEN '2022-02-02' ELSE '2025-12-31' END AS day FROM n""")
def document_dates(spark, sf):
    i = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((i * 37) % 900).cast("int")), "yyyy-MM-dd")
    dotted = F.concat(F.substring(day, 9, 2), F.lit("."), F.substring(day, 6, 2), F.lit("."), F.substring(day, 1, 4))
    name = (
        F.when(i % 5 == 0, F.concat(F.lit("act "), dotted, F.lit(" v2024-13-01.pdf"))).when(i % 5 == 1, F.concat(F.lit("scan-"), day, F.lit("-1.pdf"))).when(i % 5 == 2, "plain 12-2024.pdf")
        .when(i % 5 == 3, F.concat(F.lit("n1"), day)).otherwise(F.concat(F.lit("x 2024-02-30 "), day))
    )
    meta, modified = F.when(i % 7 == 0, "2024-02-30").when(i % 7 == 1, day), F.when(i % 2 == 0, "2022-02-02").otherwise("2030-01-01")
    return table(spark, sf, "documents").select("doc_id", D.document_date(meta, name, modified, F.lit("2025-12-31")).alias("x")).select("doc_id", "x.day", "x.origin")


@query(f"""{D_}, n AS (SELECT doc_id, strftime(DATE '2024-01-01' + CAST(doc_id * 37 % 900 AS INTEGER), '%Y-%m-%d') AS day FROM docs_whole)
SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1, 3) AND day <= '2025-12-31' THEN day WHEN doc_id % 4 = 1 THEN '2020-05-06' END AS day FROM n""")
def metadata_dates(spark, sf):
    i = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((i * 37) % 900).cast("int")), "yyyy-MM-dd")
    run = F.regexp_replace(day, "-", "")
    raw = (
        F.when(i % 4 == 0, F.concat(F.lit("%PDF /CreationDate (D:"), run, F.lit("120000)"))).when(i % 4 == 1, F.concat(F.lit("/CreationDate(D:20200506) x /ModDate (D:"), run, F.lit("Z)")))
        .when(i % 4 == 2, "nothing").otherwise(F.concat(F.lit('<dcterms:modified xsi:type="w">'), day, F.lit("T1</dcterms:modified>")))
    )
    return table(spark, sf, "documents").select("doc_id", D.metadata_date(raw, F.lit("2025-12-31")).alias("day"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def letter_days(spark, sf):
    e = table(spark, sf, "events").where("true")
    stamp = F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss")
    header = F.when(F.col("event_id") % 5 < 2, F.concat(stamp, F.lit(" -1130"))).when(F.col("event_id") % 5 == 2, F.lit("31 Feb 2024 10:00:00"))
    received = F.when(F.col("event_id") % 5 == 4, F.array(F.lit("from x; Mon, 1 Jan 1980 10:00:00 +0000"))).otherwise(
        F.array(F.lit("from a by b; Tue, 2 Jan 2029 10:00:00 +0000"), F.concat(F.lit("from c; id 7; "), stamp, F.lit(" +0000")))
    )
    return e.select("event_id", D.letter_day(header, received, F.lit("2026-08-31").cast("date")).alias("day"))


BOXES_SQL = """g AS (SELECT doc_id, doc_id // 4 AS g, doc_id % 4 AS r, 'root' || (doc_id // 4 % 9) AS root, 'b' || (doc_id // 4 % 5) AS box, substr(sha256(CAST(doc_id // 4 AS VARCHAR)), 1, 8) AS code,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(doc_id * 37 % 900 AS INTEGER), '%Y-%m-%d') END AS updated FROM documents),
i AS (SELECT *, root || '/' || box || '/' || CASE r WHEN 0 THEN 'L_' || code || '.eml' WHEN 1 THEN '_attachments/' || CASE WHEN g % 9 < 6 THEN 'x_' || code ELSE CAST(g AS VARCHAR) END || '/a.pdf'
  WHEN 2 THEN '_attachments/' || CASE WHEN g % 2 = 0 THEN '2021-05-06_zz' ELSE 'nodate_zz' END || '/' || g || '.pdf' ELSE g || '__page.html' END AS path FROM g),
k AS (SELECT path, CASE WHEN g % 3 = 0 THEN NULL ELSE '2023-0' || (1 + g % 9) || '-01' END AS date, g, r, root FROM i WHERE r = 0 AND g % 9 < 6),
n AS (SELECT i.path, i.updated AS old, i.r, i.g, CASE WHEN i.g % 9 < 6 THEN CASE i.r WHEN 0 THEN k.date WHEN 1 THEN k.date WHEN 2 THEN CASE WHEN i.g % 2 = 0 THEN '2021-05-06' END END
   ELSE CASE WHEN i.r = 1 THEN (SELECT nullif(p.updated, '') FROM i p WHERE p.g = i.g AND p.r = 3) END END AS new,
   (i.g % 9 < 6 AND i.r IN (0, 1, 2)) OR (i.g % 9 >= 6 AND i.r IN (1, 2)) AS concerned FROM i LEFT JOIN k ON k.g = i.g)"""


@query(f"""WITH {BOXES_SQL}, x AS (SELECT *, CASE WHEN NOT concerned THEN 'other' WHEN new IS NULL THEN 'unknown' WHEN new = old THEN 'same' WHEN g % 9 < 6 AND r = 0 THEN 'letter'
 WHEN r = 1 THEN 'parent' ELSE 'name' END AS reason FROM n) SELECT path, old, CASE WHEN reason IN ('letter', 'parent', 'name') THEN new ELSE old END AS new, reason FROM x""")
def date_repair(spark, sf):
    i = F.col("doc_id")
    g, r = F.floor(i / 4).cast("long"), i % 4
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((i * 37) % 900).cast("int")), "yyyy-MM-dd")
    code = F.substring(F.sha2(g.cast("string"), 256), 1, 8)
    folder = F.when(g % 9 < 6, F.concat(F.lit("x_"), code)).otherwise(g.cast("string"))
    name = (
        F.when(r == 0, F.concat(F.lit("L_"), code, F.lit(".eml"))).when(r == 1, F.concat(F.lit("_attachments/"), folder, F.lit("/a.pdf")))
        .when(r == 2, F.concat(F.lit("_attachments/"), F.when(g % 2 == 0, "2021-05-06_zz").otherwise("nodate_zz"), F.lit("/"), g.cast("string"), F.lit(".pdf")))
        .otherwise(F.concat(g.cast("string"), F.lit("__page.html")))
    )
    rows = table(spark, sf, "documents").select(
        F.concat(F.lit("root"), (g % 9).cast("string"), F.lit("/b"), (g % 5).cast("string"), F.lit("/"), name).alias("path"), F.when(i % 17 == 0, "").otherwise(day).alias("updated"), g.alias("g"), r.alias("r")
    )
    known = rows.where("r = 0 and g % 9 < 6").select("path", F.when(F.col("g") % 3 != 0, F.concat(F.lit("2023-0"), (1 + F.col("g") % 9).cast("string"), F.lit("-01"))).alias("date"), F.lit(True).alias("letter"))
    return M.date_plan(rows.select("path", "updated"), known, [f"root{k}" for k in range(6)], [f"root{k}" for k in range(6, 9)])


@query(f"""WITH {BOXES_SQL}, x AS (SELECT CASE WHEN NOT concerned THEN 'other' WHEN new IS NULL THEN 'unknown' WHEN new = old THEN 'same' WHEN g % 9 < 6 AND r = 0 THEN 'letter'
 WHEN r = 1 THEN 'parent' ELSE 'name' END AS reason FROM n)
SELECT count(*) FILTER (reason IN ('letter', 'parent', 'name')) AS changed, count(*) FILTER (reason = 'letter') AS letters, count(*) FILTER (reason = 'parent') AS by_parent, count(*) FILTER (reason = 'name') AS by_name,
 count(*) FILTER (reason = 'same') AS same, count(*) FILTER (reason = 'unknown') AS unknown FROM x""")
def date_counters(spark, sf):
    return M.date_counters(date_repair(spark, sf))


# ---------------------------------------------------------------- gate


KINDS = ["pdf", "docx", "txt", "png", "eml", "zip", "pe", "html"]
FAMILIES = ["document", "document", "text", "image", "mail", "archive", "executable", "document"]
SUFFIXES = ["pdf", "txt", "", "PNG", "doc"]


@query("""WITH f AS (SELECT doc_id, doc_id % 8 AS k, doc_id % 5 AS s, doc_id % 3 = 0 AS macros, doc_id % 7 = 0 AS broken, doc_id % 11 = 0 AS blank FROM documents),
g AS (SELECT *, CASE k WHEN 0 THEN s <> 0 AND s <> 2 WHEN 1 THEN s <> 2 WHEN 2 THEN s IN (0, 3, 4) WHEN 3 THEN s <> 3 AND s <> 2 WHEN 4 THEN s <> 2 WHEN 7 THEN s <> 2 ELSE false END AS odd FROM f)
SELECT doc_id, CASE WHEN k = 6 THEN 'executable' WHEN k = 5 THEN '' ELSE array_to_string(list_filter([CASE WHEN odd THEN 'mismatch' ELSE '' END, CASE WHEN macros THEN 'macros' ELSE '' END,
 CASE WHEN k <> 3 AND broken THEN 'unreadable' ELSE '' END, CASE WHEN k = 3 OR (k = 0 AND blank AND NOT broken) THEN 'needs_vision' ELSE '' END], lambda x: x <> ''), ',') END AS rules FROM g""")
def gate_files(spark, sf):
    i = F.col("doc_id")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (i % n).cast("int"))
    found = G.file_findings(
        pick(FAMILIES, 8), pick(KINDS, 8), F.lower(pick(SUFFIXES, 5)), i % 3 == 0, F.when(i % 11 == 0, " ").otherwise(F.col("text")), F.when(i % 7 == 0, "unreadable: broken")
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(found, lambda f: f["rule"]), ",").alias("rules"))


@query("SELECT page_id, page_id % 4 IN (0, 2) AS active, CASE page_id % 3 WHEN 0 THEN 'active_content:HIGH,encrypted:HIGH' WHEN 1 THEN 'active_content:MEDIUM' ELSE '' END AS pdf FROM pages")
def gate_active(spark, sf):
    i = F.col("page_id")
    svg = F.when(i % 4 == 0, '<svg><script>x()</script></svg>').when(i % 4 == 1, "<svg><text>javascript is a language</text></svg>").when(
        i % 4 == 2, '\ufeff <html xmlns="http://www.w3.org/1999/xhtml"><p ONCLICK = "x">'
    ).otherwise(F.concat(F.lit("see <svg><script>"), "url"))
    pdf = F.when(i % 3 == 0, F.concat(F.lit("%PDF /JavaScript 1 0 R /Encrypt 5 0 R "), "url")).when(i % 3 == 1, "%PDF /EmbeddedFile /JavaScripts").otherwise(F.concat(F.lit("%PDF "), "url"))
    names = F.array_join(F.transform(G.pdf_findings(pdf), lambda f: F.concat_ws(":", f["rule"], f["level"])), ",")
    return table(spark, sf, "pages").select("page_id", G.active_markup(svg).alias("active"), names.alias("pdf"))


@query("SELECT user_id, bool_or(event_id % 40 = 7) AS bad FROM events GROUP BY user_id")
def gate_attachments(spark, sf):
    name = F.concat("event_type", F.when(F.col("event_id") % 40 == 7, ".pdf.EXE").otherwise(".exe.pdf"))
    letters = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(name).alias("names"))  # two names of each type at most
    return letters.select("user_id", (F.size(G.attachment_findings(F.col("names"))) > 0).alias("bad"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'llm_unchecked' WHEN doc_id % 5 < doc_id % 7 THEN 'llm_partial' ELSE '' END AS rule FROM documents")
def model_checked(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.get(G.model_state(i % 3 != 0, i % 7, i % 5), F.lit(0))["rule"], F.lit("")).alias("rule"))


@query("""WITH s AS (SELECT user_id, event_id % 997 AS a, event_id % 997 + 3 + user_id % 9 AS b FROM events), o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR a >= p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b DESC ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, CAST(min(a) AS INTEGER) AS "start", CAST(max(b) AS INTEGER) AS "end" FROM g GROUP BY user_id, island""")
def span_merge(spark, sf):
    a = (F.col("event_id") % 997).cast("int")
    span = F.struct(a.alias("start"), (a + 3 + F.col("user_id") % 9).cast("int").alias("end"))
    texts = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(span).alias("spans"))  # 997 starts at most
    return texts.select("user_id", F.explode(G.merged_spans(F.col("spans"))).alias("x")).select("user_id", "x.start", "x.end")


# ---------------------------------------------------------------- reports and review


@query(f"""{R_}, r AS (SELECT decision, line, name, row_number() OVER (PARTITION BY decision ORDER BY line) AS place, count(*) OVER (PARTITION BY decision) AS total FROM receipts)
SELECT decision, line, CAST(place AS INTEGER) AS place, CASE WHEN place = 20 THEN total - 20 ELSE 0 END AS more FROM r WHERE place <= 20""")
def first_lists(spark, sf):
    return O.first_of_each(receipts(spark, sf).select("decision", "line"), "decision", "line", 20)


@query(f"""WITH {DOCS_SQL}, {KNOWN_SQL} SELECT count(*) AS files, count_if(mid IS NOT NULL OR fp IS NOT NULL) AS mail, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT split_part(path, '/', 1)) AS folders,
 count_if(CAST(split_part(split_part(path, '/', 3), '.', 1) AS BIGINT) % 9 = 0) AS removed FROM known""")
def build_stats(spark, sf):
    known = known_files(spark, sf)
    kept = documents(spark, sf).where("doc_id % 9 <> 0").select("path").withColumn("seen", F.lit(True))
    joined = known.join(kept, "path", "left")
    return joined.agg(
        F.count("*").alias("files"), F.count_if(F.col("mid").isNotNull() | F.col("fp").isNotNull()).alias("mail"), F.sum("size").alias("bytes"),
        F.count_distinct(T.first_component(F.col("path"))).alias("folders"), F.count_if(F.col("seen").isNull()).alias("removed"),
    )


@query("""WITH d AS (SELECT doc_id AS id, CAST(least(greatest(doc_id % 31, 1), 20) AS BIGINT) AS pages FROM documents WHERE doc_id % 5 < 3),
s AS (SELECT id, pages, CAST(coalesce(sum(pages) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent FROM d) SELECT * FROM s WHERE spent + pages <= 60""")
def vision_pass(spark, sf):
    return O.budgeted_pages(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 31).alias("pages"), (F.col("doc_id") % 5).alias("tried")))


@query("""SELECT 'f' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'delete' ELSE 'return' END AS action,
 CASE WHEN doc_id % 10 = 9 THEN 'missing' WHEN doc_id % 4 = 2 THEN CASE WHEN doc_id % 3 = 2 THEN 'gone' ELSE 'deleted' END WHEN doc_id % 3 = 2 THEN 'not waiting'
  WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'corpus' END ELSE 'returned' END AS outcome FROM documents""")
def review_actions(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    sha = F.sha2("text", 256)
    queue = d.where("doc_id % 10 <> 9").select(
        F.concat(F.lit("f"), i.cast("string")).alias("path"), sha.alias("sha"), F.when(i % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(sha).alias("now"),
        F.get(F.array(F.lit("queue"), F.lit("quarantine"), F.lit("returned")), (i % 3).cast("int")).alias("location"),
    )
    action = F.get(F.array(*map(F.lit, ["accept", "reject", "delete", "return"])), (i % 4).cast("int"))
    asked = d.select((i * 2).alias("nth"), F.concat(F.lit("f"), i.cast("string")).alias("path"), action.alias("action"))
    return O.reviewed(queue, asked.unionByName(asked.select((F.col("nth") + 1).alias("nth"), "path", F.lit("delete").alias("action"))))


@query(f"""{D_} SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'described' WHEN doc_id % 6 = 1 THEN 'failed' WHEN doc_id % 6 = 2 THEN 'waiting' ELSE 'none' END AS state FROM docs_whole""")
def description_state(spark, sf):
    d = documents(spark, sf).select("doc_id", F.sha2(F.concat("text", F.col("doc_id").cast("string")), 256).alias("sha"), F.col("path").alias("rel"))
    records = d.where("doc_id % 6 < 2").select("sha", (F.col("doc_id") % 6 == 0).alias("complete"))
    debts = d.where("doc_id % 6 = 2").select("rel", F.lit(True).alias("owed"))
    joined = d.join(records, "sha", "left").join(debts, "rel", "left")
    return joined.select("doc_id", F.when(F.col("complete"), "described").when(~F.col("complete"), "failed").when(F.col("owed"), "waiting").otherwise("none").alias("state"))


@query("""WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d') END AS letter FROM events),
l AS (SELECT user_id, min(letter) AS day FROM f GROUP BY user_id)
SELECT event_id, CASE WHEN event_type = 'view' THEN letter ELSE coalesce(day, CASE WHEN event_id % 2 = 0 THEN '2021-05-06' END, '2026-08-31') END AS day FROM f LEFT JOIN l USING (user_id)""")
def attachment_days(spark, sf):
    day = F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd"))
    folder = F.concat(F.lit("m/"), F.when(F.col("event_id") % 2 == 0, "2021-05-06_x").otherwise("x"))
    f = table(spark, sf, "events").select("user_id", "event_id", day.alias("letter"), folder.alias("folder"))
    letters = f.groupBy("user_id").agg(F.min("letter").alias("by_letter"))
    named = F.nullif(F.regexp_extract("folder", r"/([0-9]{4}-[0-9]{2}-[0-9]{2})[^/]*$", 1), F.lit(""))
    return f.join(letters, "user_id").select("event_id", F.coalesce("letter", "by_letter", named, F.lit("2026-08-31")).alias("day"))


@query("""WITH o AS (SELECT user_id AS entry, max(event_id) AS size, 100 + user_id % 50 AS since FROM events WHERE event_id % 3 <> 0 GROUP BY user_id),
n AS (SELECT user_id AS entry, max(event_id) AS size FROM events WHERE user_id % 5 <> 0 GROUP BY user_id)
SELECT n.entry, CASE WHEN o.size = n.size THEN o.since ELSE 140 END AS since, o.size IS NOT NULL AND o.size = n.size AND 140 - o.since >= 30 AS ready FROM n LEFT JOIN o USING (entry)""")
def inbox_quiet(spark, sf):
    from lodestone.streaming import intake

    e = table(spark, sf, "events").select(F.col("user_id").alias("entry"), "event_id")
    look = lambda rows: rows.groupBy("entry").agg(F.max("event_id").alias("size")).withColumn("mtime", F.lit(1))
    state = look(e.where("event_id % 3 <> 0")).withColumn("since", 100 + F.col("entry") % 50)
    return intake.quiet_step(state, look(e.where("entry % 5 <> 0")), F.lit(140).cast("long")).select("entry", "since", "ready")


@query(f"""WITH l AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE doc_id % 8 = 5)
SELECT doc_id || '.eml' AS name, NULL AS mid, substr(sha256('a@x.org|202405011000|hi|' || substr(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'), 1, 200)), 1, 32) AS fp, '2024-05-01' AS date FROM l""")
def letter_files(spark, sf):
    from lodestone.sources import extract, mail

    return mail.letter_keys(extract.files(table(spark, sf, "documents").where("doc_id % 8 = 5")).select("name", "content"), 2026)


@query(f"""{R_}, c AS (SELECT batch, decision, count(*) AS n FROM receipts WHERE "by" IS NULL GROUP BY ALL) SELECT batch, string_agg(decision || ':' || n, ',' ORDER BY decision) AS counts FROM c GROUP BY batch""")
def decision_maps(spark, sf):
    made = O.decision_counts(receipts(spark, sf))
    return made.select("batch", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query(f"""{R_}, l AS (SELECT name, max_by(decision, line) AS decision, max(line) AS line FROM receipts WHERE "by" IS NULL GROUP BY name), o AS (SELECT name, max(line) AS owner_line FROM receipts WHERE "by" IS NOT NULL GROUP BY name),
n AS (SELECT l.* FROM l LEFT JOIN o USING (name) WHERE owner_line IS NULL OR owner_line < l.line)
SELECT (SELECT count(DISTINCT user_id) FROM events) AS waiting, (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 3 = 0) AS ready, count_if(decision = 'review') AS queue,
 count_if(decision = 'quarantine') AS quarantine, count_if(decision = 'duplicate') AS pending, count_if(decision IN ('review', 'quarantine')) > 0 AS attention FROM n""")
def archive_state(spark, sf):
    entries = table(spark, sf, "events").select("user_id").distinct().select((F.col("user_id") % 3 == 0).alias("ready"))
    return O.state_of(entries, receipts(spark, sf))


@query(f"""{R_}, c AS (SELECT decision, CASE line % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'model' ELSE 'not checked' END AS checker FROM receipts WHERE "by" IS NULL) SELECT decision, checker, count(*) AS files FROM c GROUP BY ALL""")
def report_counts(spark, sf):
    checker = F.when(F.col("line") % 3 == 0, "rules").when(F.col("line") % 3 == 1, "model")
    r = receipts(spark, sf).where("by is null").withColumn("checker", checker)
    return r.groupBy("decision", F.coalesce("checker", F.lit("not checked")).alias("checker")).agg(F.count("*").alias("files"))


@query("""SELECT doc_id, doc_id % 4 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + 1 AS kept, 'a' || (CASE WHEN doc_id % 3 = 0 THEN 'ba' ELSE 'a' END) AS order_ FROM documents""")
def findings_once(spark, sf):
    i = F.col("doc_id")
    long = F.substring(F.rpad(F.lit("q"), 90, "q"), 1, 90)
    one = lambda rule, quote: F.struct(F.lit(rule).alias("rule"), F.lit("LOW").alias("level"), quote.alias("quote"))
    first = F.array(one("a", F.concat(long, F.lit("1"))))
    second = F.when(i % 3 == 0, F.array(one("b", long))).otherwise(F.array(one("a", F.concat(long, F.lit("2")))))
    third = F.transform(F.slice(F.sequence(F.lit(1), F.lit(4)), F.lit(1), (i % 4).cast("int")), lambda k: F.struct(F.lit("a").alias("rule"), F.lit("LOW").alias("level"), F.concat(F.lit("other "), k.cast("string")).alias("quote")))
    found = G.told_once(F.concat(first, second, F.array(one("a", F.concat(long, F.lit("3")))), third))
    order = F.concat(F.lit("a"), F.when(i % 3 == 0, F.concat(found[1]["rule"], F.lit("a"))).otherwise("a"))
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("kept"), order.alias("order_"))


@query(f"""{D_}, p AS (SELECT path, 'Head of ' || title || chr(10) || text AS t FROM docs_whole), n AS (SELECT *, CASE WHEN length(t) <= 4000 THEN 1 ELSE 1 + CAST(ceil((length(t) - 4000) / 3800.0) AS INTEGER) END AS n FROM p),
c AS (SELECT path, unnest(generate_series(0, n - 1)) AS i, t FROM n)
SELECT path, i AS chunk, sha256(CASE WHEN i > 0 THEN split_part(t, chr(10), 1) || chr(10) ELSE '' END || substr(t, CAST(i * 3800 + 1 AS BIGINT), 4000)) AS digest FROM c WHERE regexp_matches(substr(t, CAST(i * 3800 + 1 AS BIGINT), 4000), '[^\\s]')""")
def part_headed_chunks(spark, sf):
    part = F.concat(F.lit("Head of "), "title", F.lit("\n"), "text")
    return documents(spark, sf).select("path", F.posexplode(T.part_chunks(part)).alias("chunk", "c")).select("path", F.col("chunk").cast("long").alias("chunk"), F.sha2("c", 256).alias("digest"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'see https://a.example/x?y' WHEN 1 THEN 'https://a.example' WHEN 2 THEN 'http://localhost.example/' WHEN 3 THEN '(https://a.example/z)' ELSE 'ftp://127.0.0.1/' END AS text FROM documents")
def public_addresses(spark, sf):
    said = F.get(F.array(*map(F.lit, ["see http://127.0.0.1:8080/x?y", "HTTP://[::1]:9", "http://localhost.example/", "(https://LocalHost/z)", "ftp://127.0.0.1/"])), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select("doc_id", T.public_links(said, "https://a.example").alias("text"))


@query("SELECT doc_id, 'a' || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE chr(9) END || 'b' || doc_id || 'é😀' AS text FROM documents")
def model_text(spark, sf):
    mark = F.get(F.array(*map(F.lit, ["\u0007", "\u200e", "\ue000", "\r", "\U000e0041"])), (F.col("doc_id") % 5).cast("int"))
    said = F.concat(F.lit("a"), mark, F.when(F.col("doc_id") % 2 == 0, "\n").otherwise("\t"), F.lit("b"), F.col("doc_id").cast("string"), mark, F.lit("é😀"))
    return table(spark, sf, "documents").select("doc_id", T.without_controls(said).alias("text"))


@query("""SELECT doc_id || '.txt' AS name, CASE doc_id % 4 WHEN 2 THEN md5('Привет, мир ' || doc_id) ELSE md5(text) END AS digest FROM documents""")
def decoded_texts(spark, sf):
    from lodestone.sources import extract

    i = F.col("doc_id")
    # "Привет, мир" in the Windows code, byte by byte.
    windows = F.concat(F.unhex(F.lit("CFF0E8E2E5F22C20ECE8F020")), i.cast("string").cast("binary"))
    content = F.when(i % 4 == 0, F.encode(F.concat(F.lit("\ufeff"), "text"), "UTF-16LE")).when(i % 4 == 1, F.encode(F.concat(F.lit("\ufeff"), "text"), "UTF-8")).when(i % 4 == 2, windows).otherwise(F.encode("text", "UTF-8"))
    files = table(spark, sf, "documents").select(F.concat(i.cast("string"), F.lit(".txt")).alias("name"), content.alias("content"))
    return extract.decoded(files).select("name", F.md5("text").alias("digest"))


@query(f"{PLACES_SQL} SELECT path FROM p WHERE doc_id % 7 IN (0, 5) AND doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 9 <> 0")
def description_backlog(spark, sf):
    """Files a picture reader could describe, without those described already and those owed."""
    p = _places(spark, sf).where(N.describable(F.lit(None).cast("string"), F.col("path")))
    owed = p.where("doc_id % 9 = 0").select("path")
    return p.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").join(owed, "path", "left_anti").select("path")


@query(f"{D_}, done AS (SELECT path FROM docs_whole WHERE doc_id % 3 = 0 UNION SELECT path FROM docs_whole WHERE doc_id % 4 = 1) SELECT path FROM docs_whole WHERE path NOT IN (SELECT path FROM done)")
def resumed_walk(spark, sf):
    """What a walk still has to do, by a list of done paths that each pass adds a batch of lines to."""
    home = scratch_path(spark, "done")
    d = documents(spark, sf)
    for k, part in enumerate(("doc_id % 3 = 0", "doc_id % 4 = 1")):
        d.where(part).select(F.col("path").alias("value")).write.text(f"{home}/pass-{k}")
    done = spark.read.text(f"{home}/pass-*").select(F.col("value").alias("path"))
    return M.without_paths(d.select("path"), done)


@query("""WITH s AS (SELECT k, user_id AS entry, max(event_id) AS size FROM events, (SELECT unnest([0, 1, 2]) AS k) WHERE event_id % 3 <= k AND user_id % 5 <> k GROUP BY ALL),
a AS (SELECT s2.entry, CASE WHEN s1.size = s2.size THEN CASE WHEN s0.size = s1.size THEN 0 ELSE 20 END ELSE 40 END AS since FROM (SELECT * FROM s WHERE k = 2) s2
 LEFT JOIN (SELECT * FROM s WHERE k = 1) s1 USING (entry) LEFT JOIN (SELECT * FROM s WHERE k = 0) s0 USING (entry))
SELECT entry, CAST(since AS BIGINT) AS since, 40 - since >= 30 AS ready FROM a""")
def stream_quiet(spark, sf):
    """Three looks at an inbox, 20 seconds apart, as a stream of files in their order."""
    from lodestone.streaming import intake

    home = scratch_path(spark, "inbox")
    e = table(spark, sf, "events").select(F.col("user_id").alias("entry"), "event_id")
    for k in range(3):
        held = e.where((F.col("event_id") % 3 <= k) & (F.col("entry") % 5 != k)).groupBy("entry").agg(F.max("event_id").alias("size"))
        held.select(F.lit(20 * k).cast("long").alias("seen"), "entry", "size", F.lit(1).cast("long").alias("mtime")).write.parquet(f"{home}/looks/{k}")
    looks = spark.readStream.schema("seen long, entry long, size long, mtime long").option("recursiveFileLookup", "true").parquet(f"{home}/looks")
    return intake.watched(spark, looks, f"{home}/states").select("entry", "since", "ready")
