"""Queries of the intake: repeats in order, isolated rows, fates of files, stored versions, keyed stream state."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.session import scratch_path, table
from lodestone.sources.docs import DOCS_SQL, KNOWN_SQL, documents, known_files

FOLD = """, o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY name) AS i FROM b),
fold AS (
  SELECT batch, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(name VARCHAR, sha VARCHAR, mid VARCHAR, fp VARCHAR)[]) AS held, '' AS name, false AS accepted, CAST(NULL AS VARCHAR) AS duplicate_of
  FROM (SELECT DISTINCT batch FROM b)
  UNION ALL
  SELECT batch, i, CASE WHEN hit IS NULL THEN list_append(held, {'name': name, 'sha': sha, 'mid': mid, 'fp': fp}) ELSE held END, name, hit IS NULL, hit
  FROM (SELECT o.batch, o.i, o.name, o.sha, o.mid, o.fp, f.held, coalesce(list_filter(f.held, lambda x: x.mid = o.mid)[1].name, list_filter(f.held, lambda x: x.sha = o.sha)[1].name,
          list_filter(f.held, lambda x: x.fp = o.fp AND (o.mid IS NULL OR x.mid IS NULL))[1].name) AS hit
        FROM fold f JOIN o ON o.batch = f.batch AND o.i = f.i + 1)
)
SELECT batch, name, accepted, duplicate_of FROM fold WHERE i > 0"""


@query(f"WITH RECURSIVE {DOCS_SQL}, {KNOWN_SQL}, b AS (SELECT substr(path, 1, 5) AS batch, path AS name, sha, mid, fp FROM known){FOLD}")
def batch_dups(spark, sf):
    from lodestone.operators import repeats

    return repeats.batch_duplicates(known_files(spark, sf).select(F.substring("path", 1, 5).alias("batch"), F.col("path").alias("name"), "sha", "mid", "fp"))


@query(f"""WITH RECURSIVE b AS (SELECT 'b' || (event_id // 14 % 40) AS batch, printf('%09d', event_id) AS name, 's' || CASE WHEN event_id % 97 < 30 THEN 'hot' ELSE CAST(event_id // 2 AS VARCHAR) END AS sha,
 CASE WHEN event_id % 11 > 0 THEN 'm' || ((event_id + 1) // 2) END AS mid, CASE WHEN event_id % 3 = 0 THEN 'f' || (event_id // 7) END AS fp FROM events){FOLD}""")
def batch_chains(spark, sf):
    """Files that repeat each other in chains, where what's accepted alternates, and one content that a third of them share."""
    from lodestone.operators import repeats

    i = F.col("event_id")
    half = lambda x: F.floor(x / 2).cast("string")
    files = table(spark, sf, "events").select(
        F.concat(F.lit("b"), (F.floor(i / 14) % 40).cast("string")).alias("batch"), F.lpad(i.cast("string"), 9, "0").alias("name"),
        F.concat(F.lit("s"), F.when(i % 97 < 30, "hot").otherwise(half(i))).alias("sha"), F.when(i % 11 > 0, F.concat(F.lit("m"), half(i + 1))).alias("mid"),
        F.when(i % 3 == 0, F.concat(F.lit("f"), F.floor(i / 7).cast("string"))).alias("fp"),
    )
    return repeats.batch_duplicates(files)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """k of each line; a line that isn't JSON, and none at all, make it fail."""
    return pa.RecordBatch.from_arrays([pa.array([json.loads(line)["k"] for line in batch.column("line").to_pylist()], pa.int64())], ["k"])


@query("""SELECT event_id, CASE WHEN event_id % 97 = 13 OR event_id % 89 = 5 OR event_id % 101 = 7 THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END AS k,
 CASE WHEN event_id % 97 = 13 THEN 'JSONDecodeError' WHEN event_id % 89 = 5 THEN 'TypeError' WHEN event_id % 101 = 7 THEN 'KeyError' END AS error, event_id % 97 = 13 OR event_id % 89 = 5 OR event_id % 101 = 7 AS dead FROM events""")
def poison_rows(spark, sf):
    """Lines of which some crash their reader: the good ones come through, the bad ones stand among the dead letters."""
    from lodestone.operators import isolate

    i = F.col("event_id")
    line = F.when(i % 97 == 13, F.concat("props", F.lit("}"))).when(i % 89 == 5, None).when(i % 101 == 7, '{"other": 1}').otherwise(F.col("props"))
    done = isolate.isolated(table(spark, sf, "events").select("event_id", line.alias("line")), _counted, "k long")
    good = done.good.select("row.event_id", "k", F.lit(None).cast("string").alias("error"), F.lit(False).alias("dead"))
    return good.unionByName(done.dead.select("row.event_id", F.lit(None).cast("long").alias("k"), F.split_part("error", F.lit(":"), F.lit(1)).alias("error"), F.lit(True).alias("dead")))


FATE_SQL = """v AS (SELECT doc_id, doc_id // 8 AS g, CASE WHEN doc_id % 8 < 4 THEN (doc_id // 8) || '.zip/' || doc_id || '.txt' ELSE doc_id || '.txt' END AS name, doc_id % 8 < 4 AS inside, sha256(text) AS real,
  CASE WHEN doc_id % 29 = 0 THEN sha256('other' || doc_id) ELSE sha256(text) END AS sha, ['accept', 'accept', 'accept', 'review', 'quarantine', 'duplicate', 'skip'][doc_id % 7 + 1] AS decision,
  doc_id % 4 = 0 AS trace FROM documents),
known AS (SELECT sha FROM v WHERE doc_id % 7 = 5 AND doc_id % 2 = 0),
p AS (SELECT *, decision IN ('accept', 'review', 'quarantine') AS placed, decision IN ('accept', 'review', 'quarantine') AND sha = real AS good FROM v),
k AS (SELECT *, placed AND NOT good AS failed, good OR (decision = 'duplicate' AND (sha IN (SELECT sha FROM known) OR sha IN (SELECT sha FROM p WHERE good))) OR (decision = 'skip' AND trace) AS safe FROM p),
z AS (SELECT g, bool_or(failed) AS broken, bool_or(NOT safe AND NOT failed) AS lost FROM k WHERE inside GROUP BY g)"""


def _settled(spark, sf, home):
    """A batch of documents as files, half of them members of archives, settled by a run that is killed after every step."""
    from lodestone.operators import fate

    i = F.col("doc_id")
    d = table(spark, sf, "documents")
    zip_name = F.concat(F.floor(i / 8).cast("string"), F.lit(".zip"))
    inside = i % 8 < 4
    name = F.concat(F.when(inside, F.concat(zip_name, F.lit("/"))).otherwise(""), i.cast("string"), F.lit(".txt"))
    decision = F.get(F.array(*map(F.lit, ["accept", "accept", "accept", "review", "quarantine", "duplicate", "skip"])), (i % 7).cast("int"))
    sha = F.when(i % 29 == 0, F.sha2(F.concat(F.lit("other"), i.cast("string")), 256)).otherwise(F.sha2("text", 256))
    files = d.select(
        name.alias("name"), decision.alias("decision"), sha.alias("sha"), F.lit("text").alias("family"), F.when(inside, zip_name).alias("archive"), F.when(i % 4 == 0, "trace").alias("skipped_as")
    )
    none = F.lit(None).cast("string")
    archives = d.where(inside).select(zip_name.alias("name")).distinct().select("name", F.lit("archive").alias("decision"), F.sha2("name", 256).alias("sha"), F.lit("archive").alias("family"), none.alias("archive"), none.alias("skipped_as"))
    contents = d.select(name.alias("name"), F.encode("text", "UTF-8").alias("content"))
    known = d.where((i % 7 == 5) & (i % 2 == 0)).select(sha.alias("sha"))
    verdicts = files.unionByName(archives)
    for step in fate.STEPS:
        try:
            fate.settle(spark, home, "20240101-000000", verdicts, contents, known, stop_after=step)
        except fate.Stopped:
            pass
    return fate.settle(spark, home, "20240101-000000", verdicts, contents, known), verdicts


@query(f"""WITH {FATE_SQL} SELECT name, decision, CASE WHEN placed THEN good END AS verified, CASE WHEN good THEN CASE decision WHEN 'accept' THEN 'corpus' WHEN 'review' THEN 'queue' ELSE 'quarantine' END || '/20240101-000000/' || name END AS path,
 CASE WHEN NOT inside THEN CASE WHEN failed THEN 'kept' WHEN safe THEN 'removed' ELSE 'returned' END END AS fate FROM k
UNION ALL SELECT g || '.zip', 'archive', NULL, NULL, CASE WHEN broken THEN 'kept' WHEN lost THEN 'returned' ELSE 'removed' END FROM z""")
def file_fate(spark, sf):
    return _settled(spark, sf, scratch_path(spark, "fate"))[0]


@query(f"""WITH {FATE_SQL} SELECT 'corpus' AS place, CASE decision WHEN 'accept' THEN 'corpus' WHEN 'review' THEN 'queue' ELSE 'quarantine' END || '/20240101-000000/' || name AS name, real AS sha FROM k WHERE good
UNION ALL SELECT 'inbox', name, NULL FROM k WHERE NOT inside AND failed UNION ALL SELECT 'inbox', g || '.zip', NULL FROM z WHERE broken""")
def file_places(spark, sf):
    """Where the files of the same batch are after it: verified copies by their stored bytes, and what's left in the inbox."""
    from lodestone.operators import fate

    home = scratch_path(spark, "fate")
    _, verdicts = _settled(spark, sf, home)
    kept = fate.corpus(spark, home).select(F.lit("corpus").alias("place"), F.col("place").alias("name"), F.sha2("content", 256).alias("sha"))
    left = fate.left_in_inbox(spark, home, verdicts.where("archive is null").select("name"))
    return kept.unionByName(left.select(F.lit("inbox").alias("place"), "name", F.lit(None).cast("string").alias("sha")))


def _versioned(spark, sf, home):
    """Documents created, appended to in small parts, rewritten with other dates, and compacted."""
    from lodestone.sources import versions

    d = documents(spark, sf).select("path", "updated", "text", "doc_id")
    versions.create(d.where("doc_id % 4 = 0").repartition(2), home)
    for k in (1, 2, 3):
        versions.append(d.where(F.col("doc_id") % 4 == k).repartition(5), home)
    dates = d.where("doc_id % 3 = 0").select("path", F.lit("2020-02-02").alias("new"))
    versions.rewrite(spark, home, lambda rows: rows.join(dates, "path", "left").withColumn("updated", F.coalesce("new", "updated")))
    versions.append(d.where("doc_id < 0"), home)  # no rows
    versions.compact(spark, home)


@query("""WITH n AS (SELECT count(*) FILTER (doc_id % 4 = 0) AS a, count(*) FILTER (doc_id % 4 <= 1) AS b, count(*) FILTER (doc_id % 4 <= 2) AS c, count(*) AS d FROM documents)
SELECT v AS version, CASE v WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN c ELSE d END AS rows, v = 7 AS fewest_files, true AS sized FROM n, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS v)""")
def table_statistics(spark, sf):
    """Rows of each version by its files' footers, and whether it has fewer files than all before it since the table was whole."""
    from lodestone.sources import versions

    home = scratch_path(spark, "versions")
    _versioned(spark, sf, home)
    s = versions.statistics(spark, home)
    least = s.where("version between 4 and 6").agg(F.min("fragments").alias("least"))
    return s.crossJoin(least).select("version", "rows", ((F.col("version") == 7) & (F.col("fragments") < F.col("least"))).alias("fewest_files"), (F.col("bytes") > 0).alias("sized"))  # one row


@query(f"WITH {DOCS_SQL} SELECT path, CASE WHEN doc_id % 3 = 0 THEN '2020-02-02' ELSE updated END AS updated, sha256(text) AS sha FROM docs_whole")
def table_rewritten(spark, sf):
    from lodestone.sources import versions

    home = scratch_path(spark, "versions")
    _versioned(spark, sf, home)
    return versions.read(spark, home).select("path", "updated", F.sha2("text", 256).alias("sha"))


#: Rows of a micro-batch for which it has another file, and files that it has at most.
FILE_ROWS, MOST_FILES = 100_000, 64


def _in_parts(spark, sf, df, home, parts=4):
    """df as files in order of time, equally many for each micro-batch; ends of parts are quarters of the time."""
    span = table(spark, sf, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (span["b"] - span["a"]) / parts
    inside = [(F.col("ts") >= F.lit(span["a"] + k * step)) & ((F.col("ts") < F.lit(span["a"] + (k + 1) * step)) if k < parts - 1 else F.lit(True)) for k in range(parts)]
    sizes = df.agg(*[F.count_if(part).alias(f"n{k}") for k, part in enumerate(inside)]).first()
    files = max(1, min(MOST_FILES, min(sizes) // FILE_ROWS))  # dealt in turn, so many rows leave none of them empty
    for k, part in enumerate(inside):
        rows = df.where(part).drop("ts")
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.parquet(f"{home}/part-{k}")
    return spark.readStream.schema(df.drop("ts").schema).option("maxFilesPerTrigger", str(files)).option("recursiveFileLookup", "true").parquet(home)


QUIET = 6 * 3600


@query(f"""WITH e AS (SELECT user_id AS entry, ts, lead(ts) OVER w AS next, max(ts) OVER () AS last, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL {QUIET} SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY entry ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT entry, max(ts) AS since, count(*) AS changes, max(ts) + INTERVAL {QUIET} SECOND AS ready FROM s GROUP BY entry, run HAVING bool_or(next - ts >= INTERVAL {QUIET} SECOND) OR max(ts) + INTERVAL {QUIET} SECOND < max(last)""")
def stream_ready(spark, sf):
    """Entries that stay unchanged for six hours, over a stream of changes, by timers on the state of each open entry."""
    from lodestone.streaming import open_entries as S

    home = scratch_path(spark, "changes")
    e = table(spark, sf, "events").select("ts", F.col("user_id").alias("entry"), F.col("ts").cast("timestamp").alias("seen"), F.col("event_id").alias("size"), F.lit(1).cast("long").alias("mtime"))
    return S.collected(S.ready_entries(_in_parts(spark, sf, e, f"{home}/in"), QUIET), f"{home}/out", S.READY)


@query("""SELECT event_id, [NULL, 'repeated key', 'not JSON', 'not an object', 'unknown extra', 'no k', 'k isn''t whole', NULL, 'name isn''t text', 'repeated key', 'not JSON'][event_id % 11 + 1] AS reason FROM events""")
def strict_lines(spark, sf):
    """Lines made from events, of which most have a fault: refused with the reason, at any number of them."""
    from lodestone.sources import strict

    i = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    whole = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    name = F.concat(F.lit('"name": "'), "event_type", F.lit('"'))
    line = (
        F.when(i % 11 == 0, whole("{", name, ', "k": ', k, ', "inner": ', F.col("props"), "}")).when(i % 11 == 1, whole("{", name, ', "k": 1, "k": ', k, "}")).when(i % 11 == 2, whole("{", name, ', "k": ', k))
        .when(i % 11 == 3, whole("[", F.col("props"), "]")).when(i % 11 == 4, whole("{", name, ', "k": 1, "extra": ', k, "}")).when(i % 11 == 5, whole("{", name, "}")).when(i % 11 == 6, whole("{", name, ', "k": "', k, '"}'))
        .when(i % 11 == 7, whole("{", '"k": ', k, "}")).when(i % 11 == 8, whole('{"name": ', k, ', "k": 2}')).when(i % 11 == 9, whole("{", name, ', "k": 1, "inner": {"a": 1, "a": ', k, "}}")).otherwise(F.lit(None).cast("string"))
    )
    return table(spark, sf, "events").select("event_id", strict.reason(line, {"name": "text", "k": "whole", "inner": "object"}, ("k",)).alias("reason"))


def _written_tree(spark, sf, root):
    """Documents as files in folders of their source; some are links, and some lie in a folder that isn't ready."""
    import os

    i = F.col("doc_id")
    files = table(spark, sf, "documents").select(F.concat(F.when(i % 9 == 0, "waiting").otherwise(F.col("source")), F.lit("/"), "lang").alias("folder"), i.cast("string").alias("name"), "text", (i % 20 == 0).alias("link"))

    def write(rows):
        for r in rows:
            os.makedirs(f"{root}/{r.folder}", exist_ok=True)
            if r.link:
                os.symlink(f"../{r.name}", f"{root}/{r.folder}/{r.name}")
            else:
                with open(f"{root}/{r.folder}/{r.name}", "w", encoding="utf-8", newline="") as file:
                    file.write(r.text or "")

    files.foreachPartition(write)


@query("""SELECT source || '/' || lang || '/' || doc_id AS path, source AS entry, CASE WHEN doc_id % 20 = 0 THEN 'link' ELSE 'file' END AS kind, CASE WHEN doc_id % 20 > 0 THEN CAST(octet_length(encode(text)) AS BIGINT) END AS size,
 CASE WHEN doc_id % 20 = 0 THEN '../' || doc_id END AS target FROM documents WHERE doc_id % 9 > 0""")
def tree_walk(spark, sf):
    """A tree of files walked by its ready folders, in a folder that all machines mount."""
    from lodestone.session import ship_package
    from lodestone.sources.tree import TreeSource

    root = scratch_path(spark, "tree")
    if "://" in root and not root.startswith("file://"):
        raise ValueError("a tree of files needs a mounted folder")
    root = root.removeprefix("file://").removeprefix("file:")
    ship_package(spark)
    _written_tree(spark, sf, root)
    spark.dataSource.register(TreeSource)
    ready = [r["source"] for r in table(spark, sf, "documents").select("source").distinct().collect()]  # folders of the top level
    return spark.read.format("tree").option("ready", ",".join(ready)).load(root).select("path", "entry", "kind", "size", "target")


@query(f"WITH {DOCS_SQL} SELECT path, chunk, CAST(length(text) AS INTEGER) AS size, CAST(length(text) - length(replace(text, 'e', '')) AS INTEGER) AS es FROM docs WHERE length(text) % 7 <> 3")
def embedded_chunks(spark, sf):
    """Chunks with vectors from a service that fails on some: these are left out, and those sent with them aren't."""
    from lodestone.sources import logs
    from lodestone.sources.docs import docs

    def embed(texts):
        if any(len(t) % 7 == 3 for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t)), float(t.count("e"))] for t in texts]

    made = logs.embedded(docs(spark, sf).select("path", "chunk", "text"), embed)
    return made.select("path", "chunk", F.get("vector", F.lit(0)).cast("int").alias("size"), F.get("vector", F.lit(1)).cast("int").alias("es"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Password: hu*** ' || lang WHEN 1 THEN source || ' says' WHEN 2 THEN 'code A1*** ' || lang WHEN 3 THEN 'Токен = ab***' ELSE 'парольная фраза: ' || lang END AS shown FROM documents""")
def quotes_masked(spark, sf):
    from lodestone.operators import gate as G

    i, text = F.col("doc_id"), F.col("doc_id").cast("string")
    said = (
        F.when(i % 5 == 0, F.concat(F.lit("Password: hunter"), text, F.lit(" "), "lang")).when(i % 5 == 1, F.concat("source", F.lit(" says"))).when(i % 5 == 2, F.concat(F.lit("code A1b2c3d4"), text, F.lit(" "), "lang"))
        .when(i % 5 == 3, F.concat(F.lit("Токен = abc"), text)).otherwise(F.concat(F.lit("парольная фраза: "), "lang"))
    )
    return table(spark, sf, "documents").select("doc_id", G.quote_masked(said).alias("shown"))


@query("""WITH f AS (SELECT event_id, ['document', 'other', 'archive', 'other', 'other', 'other', 'text'][event_id % 7 + 1] AS family, ['pdf', 'broken-zip', 'zip', 'macos-sidecar', 'iwork', 'binary', 'txt'][event_id % 7 + 1] AS kind, event_id % 5 AS size, event_id % 11 = 0 AS link FROM events)
SELECT event_id, CASE WHEN link THEN 'not a file' WHEN size = 0 THEN 'empty' WHEN kind = 'broken-zip' THEN 'broken' WHEN kind = 'macos-sidecar' THEN 'sidecar' WHEN kind = 'iwork' THEN 'no reader' WHEN family = 'archive' THEN 'unpacked' WHEN family = 'other' THEN 'not a document' END AS reason FROM f""")
def files_left_out(spark, sf):
    from lodestone.operators import gate as G

    i = F.col("event_id")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (i % 7).cast("int"))
    why = G.left_out(pick(["document", "other", "archive", "other", "other", "other", "text"]), pick(["pdf", "broken-zip", "zip", "macos-sidecar", "iwork", "binary", "txt"]), i % 5, i % 11 == 0)
    return table(spark, sf, "events").select("event_id", why.alias("reason"))
