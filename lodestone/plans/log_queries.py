"""Batches, journal, identity, maintenance and date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import identity as I
from lodestone.operators import maintain as M
from lodestone.operators import ops as O
from lodestone.plans.registry import query, values
from lodestone.session import table
from lodestone.sources.docs import DOCS_SQL, KNOWN_SQL, RECEIPTS_SQL, documents, known_files, receipts

R_ = f"WITH {RECEIPTS_SQL}"
K_ = f"WITH {DOCS_SQL}, {KNOWN_SQL}"


@query(f'{R_} SELECT batch, decision, count(*) AS files FROM receipts WHERE "by" IS NULL GROUP BY ALL')
def batch_summary(spark, sf):
    return O.summary(receipts(spark, sf))


@query(f"""{R_}, l AS (SELECT batch, name, max_by(decision, line) AS decision FROM receipts WHERE "by" IS NULL GROUP BY ALL),
o AS (SELECT batch, name, max_by(decision, line) AS owner, max_by(time, line) AS owner_time FROM receipts WHERE "by" IS NOT NULL GROUP BY ALL)
SELECT l.batch, l.name, decision, owner, owner_time, CASE WHEN owner = 'reject' THEN 'returned' WHEN decision = 'accept' THEN 'corpus' WHEN decision = 'review' THEN 'queue'
 WHEN decision = 'quarantine' THEN 'quarantine' END AS location FROM l LEFT JOIN o ON l.batch = o.batch AND l.name = o.name""")
def batch_detail(spark, sf):
    return O.detail(receipts(spark, sf))


@query(f"{R_}, b AS (SELECT DISTINCT batch FROM receipts WHERE batch < '20240120-000000') SELECT batch, (SELECT count(*) FROM b) > 7 AS more FROM b ORDER BY batch DESC LIMIT 7")
def batch_page(spark, sf):
    return O.page(receipts(spark, sf), "20240120-000000", 7)


IDS_SQL = """b AS (SELECT DISTINCT strftime(ts, '%Y%m%d-%H0000') AS stamp, event_id % 5 AS k FROM events WHERE event_id % 5 < 3)"""


@query(f"""WITH {IDS_SQL} SELECT stamp || CASE k WHEN 0 THEN '' WHEN 1 THEN '-2' ELSE '-10' END AS batch, row_number() OVER (ORDER BY stamp DESC, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END DESC) AS place FROM b""")
def batch_order(spark, sf):
    from pyspark.sql import Window

    ending = F.get(F.array(*map(F.lit, ["", "-2", "-10", "-1", "x"])), (F.col("event_id") % 5).cast("int"))
    b = table(spark, sf, "events").select(F.concat(F.date_format("ts", "yyyyMMdd-HH0000"), ending).alias("batch")).distinct().where(O.is_batch(F.col("batch")))
    return b.withColumn("place", F.row_number().over(Window.orderBy(F.desc(O.batch_key(F.col("batch"))))).cast("long"))


@query(f"""{R_} SELECT name, count(*) AS files, count_if(decision IN ('review', 'quarantine')) AS attention, max(time) AS last FROM receipts WHERE "by" IS NULL GROUP BY name""")
def status_rollup(spark, sf):
    r = receipts(spark, sf).where("by is null")
    return r.groupBy("name").agg(F.count("*").alias("files"), F.count_if(F.col("decision").isin("review", "quarantine")).alias("attention"), F.max("time").alias("last"))


@query(f"""{R_} SELECT batch, name, decision, time FROM (SELECT *, row_number() OVER (PARTITION BY batch, name ORDER BY line DESC) AS n FROM receipts WHERE "by" IS NULL)
WHERE n = 1 AND decision IN ('review', 'quarantine')""")
def review_join(spark, sf):
    r = receipts(spark, sf).where("by is null")
    last = r.groupBy("batch", "name").agg(F.max_by(F.struct("decision", "time"), "line").alias("x")).select("batch", "name", "x.decision", "x.time")
    return last.where(F.col("decision").isin("review", "quarantine"))


def _journal(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("line"), F.concat(F.lit("client"), (F.col("user_id") % 7).cast("string")).alias("client"), F.col("event_type").alias("tool"),
        (F.col("value") * 10).cast("long").alias("ms"), F.get_json_object("props", "$.k").cast("int").alias("k"), "props",
    )


@query("SELECT event_id AS line, 'client' || (user_id % 7) AS client, event_type AS tool FROM events WHERE user_id % 7 = 3 ORDER BY event_id DESC LIMIT 50")
def journal_tail(spark, sf):
    return O.journal_tail(_journal(spark, sf), 50, "client3").select("line", "client", "tool")


@query("SELECT event_type AS tool, count(*) AS calls, CAST(sum(CAST(props->>'$.k' AS INTEGER)) AS BIGINT) AS k, count(DISTINCT user_id % 7) AS clients FROM events GROUP BY event_type")
def journal_by_tool(spark, sf):
    return _journal(spark, sf).groupBy("tool").agg(F.count("*").alias("calls"), F.sum("k").alias("k"), F.count_distinct("client").alias("clients"))


@query("""SELECT event_id, '{"q":"see ba_***' || CASE WHEN event_id % 3 = 0 THEN repeat('z', 190) || '…' ELSE '! ' || event_type END || '"' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ',"k":"' || event_type || '"' END || '}' AS params FROM events""")
def journal_scrub(spark, sf):
    said = F.concat(F.lit("see ba_ab-def_2"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, " " * 0).otherwise("! "))
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("see ba_***"), F.lit("z" * 300))).otherwise(F.concat(said, "event_type"))
    kind = F.when(F.col("event_id") % 2 == 1, F.col("event_type"))
    params = F.map_from_arrays(F.array(F.lit("q"), F.lit("token"), F.lit("k"), F.lit("Cookie")), F.array(said, F.col("event_type"), kind, F.lit("x")))
    return table(spark, sf, "events").select("event_id", F.to_json(O.scrub(params)).alias("params"))


@query("""WITH f AS (SELECT doc_id AS name, n_chars AS size, doc_id * 9973 % 800000 AS used FROM documents), y AS (SELECT * FROM f WHERE used >= 800000 - 7 * 86400),
r AS (SELECT name, CAST(sum(size) OVER (ORDER BY used DESC, name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM y) SELECT name, total FROM r WHERE total <= 90000""")
def cache_kept(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.col("n_chars").alias("size"), (F.col("doc_id") * 9973 % 800000).alias("used"))
    return O.kept_in_cache(files, 800_000, 7, 90_000).select("name", F.col("total").cast("long").alias("total"))


@query(f"""{K_}, p AS (SELECT 'p' || path AS id, CASE WHEN length(text) % 4 = 0 THEN sha256(text) ELSE sha256(text || 'x') END AS sha, CASE WHEN doc_id % 5 = 0 THEN 'm' || (doc_id % 80) END AS mid,
  substr(sha256(substr(lower(text), 1, 200)), 1, 32) AS fp FROM docs_whole),
m AS (SELECT mid, min(path) AS path FROM known WHERE mid IS NOT NULL GROUP BY mid), s AS (SELECT sha, min(path) AS path FROM known GROUP BY sha),
f AS (SELECT fp, min(path) AS path FROM known GROUP BY fp), g AS (SELECT fp, min(path) AS path FROM known WHERE mid IS NULL GROUP BY fp)
SELECT id, coalesce(m.path, s.path, CASE WHEN p.mid IS NULL THEN f.path ELSE g.path END) AS found,
 CASE WHEN m.path IS NOT NULL THEN 'mid' WHEN s.path IS NOT NULL THEN 'sha' WHEN CASE WHEN p.mid IS NULL THEN f.path ELSE g.path END IS NOT NULL THEN 'fp' END AS how
FROM p LEFT JOIN m ON p.mid = m.mid LEFT JOIN s ON p.sha = s.sha LEFT JOIN f ON p.fp = f.fp LEFT JOIN g ON p.fp = g.fp""")
def known_lookup(spark, sf):
    d = documents(spark, sf)
    sha = F.when(F.char_length("text") % 4 == 0, F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit("x")), 256))
    probes = d.select(
        F.concat(F.lit("p"), "path").alias("id"), sha.alias("sha"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("m"), (F.col("doc_id") % 80).cast("string"))).alias("mid"),
        F.substring(F.sha2(F.substring(F.lower("text"), 1, 200), 256), 1, 32).alias("fp"),
    )
    return I.lookup(probes, known_files(spark, sf))


def _seen(spark, sf):
    k = known_files(spark, sf)
    day = F.coalesce("date", F.lit(""))
    moved = k.where(day != "2024-01-01").withColumn("size", F.when(F.col("size") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return moved.withColumn("path", F.when(F.col("mtime") % 11000 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.col("path")))


SEEN_SQL = """seen AS (SELECT CASE WHEN mtime % 11000 = 0 THEN 'new/' || path ELSE path END AS path, CASE WHEN size % 7 = 0 THEN size + 1 ELSE size END AS size, mtime, sha, mid, fp, date
 FROM known WHERE coalesce(date, '') <> '2024-01-01')"""


@query(f"""{K_}, {SEEN_SQL} SELECT coalesce(k.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'removed' WHEN k.path IS NULL THEN 'added' WHEN k.size <> s.size OR k.mtime <> s.mtime THEN 'changed' ELSE 'same' END AS change
FROM known k FULL JOIN seen s ON k.path = s.path""")
def known_refresh(spark, sf):
    return I.refresh(known_files(spark, sf), _seen(spark, sf))


@query(f"{K_}, {SEEN_SQL} SELECT path, size, mtime FROM seen UNION ALL SELECT path, size, mtime FROM known WHERE path NOT IN (SELECT path FROM seen)")
def known_upsert(spark, sf):
    return I.upsert(known_files(spark, sf), _seen(spark, sf)).select("path", "size", "mtime")


@query(f"{K_} SELECT count(*) AS files, count_if(mid IS NOT NULL OR fp IS NOT NULL) AS mail FROM known")
def known_info(spark, sf):
    return known_files(spark, sf).agg(F.count("*").alias("files"), F.count_if(F.col("mid").isNotNull() | F.col("fp").isNotNull()).alias("mail"))


MAIL = [f"src{i}" for i in range(12)]
RANKS = {"src3": 0, "src1": 1}
PLAN_SQL = f"""
idx AS (SELECT path, updated FROM docs_whole UNION ALL SELECT replace(path, '/', chr(92)), updated FROM docs_whole WHERE source = 'src2' UNION ALL SELECT 'src5/lost/' || doc_id, '' FROM docs_whole WHERE doc_id < 3),
n AS (SELECT *, replace(path, chr(92), '/') AS norm, split_part(replace(path, chr(92), '/'), '/', 1) AS root FROM idx),
kd AS (SELECT n.*, k.sha, k.mid, k.size, CASE WHEN root NOT IN ({', '.join(repr(m) for m in MAIL)}) THEN 'outside' WHEN k.sha IS NULL THEN 'unknown' ELSE 'grouped' END AS kind FROM n LEFT JOIN known k ON k.path = n.norm),
plan AS (SELECT path, norm, kind, CASE WHEN kind = 'grouped' THEN coalesce('mid:' || mid, 'sha:' || sha) END AS grp,
  CASE WHEN kind = 'grouped' THEN CAST(row_number() OVER (PARTITION BY kind, coalesce('mid:' || mid, 'sha:' || sha) ORDER BY coalesce(nullif(updated, ''), '9999'),
    CASE root WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, split_part(norm, '/', 2), size DESC, norm, path) AS INTEGER) END AS place FROM kd)"""


def _index(spark, sf):
    d = documents(spark, sf)
    odd = d.where("source = 'src2'").select(F.translate("path", "/", "\\").alias("path"), "updated")
    lost = d.where("doc_id < 3").select(F.concat(F.lit("src5/lost/"), F.col("doc_id").cast("string")).alias("path"), F.lit("").alias("updated"))
    return d.select("path", "updated").unionByName(odd).unionByName(lost)


def _plan(spark, sf):
    return M.dedupe_plan(_index(spark, sf), known_files(spark, sf), MAIL, RANKS)


@query(f"{K_}, {PLAN_SQL} SELECT * FROM plan")
def dedupe_plan(spark, sf):
    return _plan(spark, sf)


@query(f"""{K_}, {PLAN_SQL}, g AS (SELECT grp, count(*) AS n, count(DISTINCT norm) AS norms FROM plan WHERE grp IS NOT NULL GROUP BY grp)
SELECT count_if(kind = 'grouped') AS letters, count(*) AS files, count_if(place > 1) AS dropped, count_if(kind = 'outside') AS outside, count_if(kind = 'unknown') AS unknown,
 (SELECT count_if(n > 1) FROM g) AS groups, (SELECT CAST(coalesce(sum(n - norms), 0) AS BIGINT) FROM g) AS same_file FROM plan""")
def dedupe_counters(spark, sf):
    return M.dedupe_counters(_plan(spark, sf))


@query(f"{K_}, {PLAN_SQL} SELECT path, updated FROM idx WHERE path NOT IN (SELECT path FROM plan WHERE place > 1)")
def dedupe_apply(spark, sf):
    return M.without_paths(_index(spark, sf), _plan(spark, sf).where("place > 1")).select("path", "updated")


@query(f"{K_} SELECT path, CASE WHEN mid IS NULL THEN updated ELSE '2000-01-01' END AS updated FROM docs_whole JOIN known USING (path)")
def date_rewrite_all(spark, sf):
    known = known_files(spark, sf)
    plan = documents(spark, sf).select("path", F.col("updated").alias("old")).join(known.where("mid is not null").select("path"), "path", "left_semi").withColumn("new", F.lit("2000-01-01"))
    return M.rewritten(documents(spark, sf).select("path", "updated"), plan)


@query("SELECT event_id, CAST(greatest(0, round((event_id % 7) * 0.9 - 2.3)) AS BIGINT) AS seconds FROM events")
def batch_seconds(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.lit(100.25).alias("a"), (F.lit(97.95) + (F.col("event_id") % 7) * 0.9).alias("b"))
    return e.select("event_id", O.took(F.col("a"), F.col("b")).alias("seconds"))
