"""Queries over the chunk table and its metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import dates as D
from lodestone.functions import text as T
from lodestone.operators import search as S
from lodestone.plans.registry import query
from lodestone.session import table
from lodestone.sources.docs import DOCS_SQL, docs, documents

D_ = f"WITH {DOCS_SQL}"


@query(f"{D_} SELECT path, chunk, length(text) AS n_chars, sha256(text) AS digest FROM docs")
def docs_chunks(spark, sf):
    return docs(spark, sf).select("path", "chunk", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"))


@query(f"{D_} SELECT path, source, space, title, updated FROM docs_whole")
def docs_scan(spark, sf):
    return documents(spark, sf).select("path", "source", "space", "title", "updated")


@query(f"{D_} SELECT source, count(*) AS chunks FROM docs GROUP BY source")
def base_counts(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count("*").alias("chunks"))


@query(f"{D_}, c AS (SELECT source, count(*) AS chunks FROM docs GROUP BY source) SELECT source, chunks, row_number() OVER (ORDER BY chunks DESC, source) AS place FROM c")
def base_ranking(spark, sf):
    from pyspark.sql import Window

    return base_counts(spark, sf).withColumn("place", F.row_number().over(Window.orderBy(F.desc("chunks"), "source")).cast("long"))


@query(f"{D_} SELECT path, count(*) AS chunks, min_by(updated, chunk) AS updated FROM docs GROUP BY path")
def path_counts_dates(spark, sf):
    return docs(spark, sf).groupBy("path").agg(F.count("*").alias("chunks"), F.coalesce(F.min_by("updated", "chunk"), F.lit("")).alias("updated"))


@query(f"{D_} SELECT path, chunk FROM docs WHERE updated >= '2025'")
def since_filter(spark, sf):
    return S.filtered(docs(spark, sf), since=" 2025 ").select("path", "chunk")


@query(f"{D_} SELECT path, chunk FROM docs WHERE updated >= '2024-06' AND source IN ('src1', 'src2') AND space = 'en'")
def multi_base_filter(spark, sf):
    return S.filtered(docs(spark, sf), "2024-06", " src1, 'src2' ,", "en").select("path", "chunk")


@query(f"{D_} SELECT path, chunk FROM docs WHERE contains(path, '/en/') AND NOT contains(path, 'src1')")
def path_needles(spark, sf):
    return docs(spark, sf).where(F.col("path").contains("/en/") & ~F.col("path").contains("src1")).select("path", "chunk")


@query(f"{D_} SELECT DISTINCT path FROM docs")
def distinct_paths(spark, sf):
    return docs(spark, sf).select("path").distinct()


@query(f"{D_} SELECT path FROM docs_whole WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def walk_not_done(spark, sf):
    return documents(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("path")


@query(f"{D_} SELECT path, chunk, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 420) AS snippet FROM docs")
def snippets(spark, sf):
    return docs(spark, sf).select("path", "chunk", T.snippet(F.col("text")).alias("snippet"))


#: Roots and rules of the corpus that the documents below are files of: 3000 words for mail, of which the first that fits counts.
ROOTS_SQL = r"""roots AS (SELECT * FROM (VALUES ('mail', 'mail', 'mail', 'mail', ''), ('wiki', 'pages', 'wiki', 'wiki files', ''), ('share', 'files', 'files', 'files', 'folder')) AS t(root, kind, source, attached, title)),
rules AS (SELECT 'mail' AS root, k AS rank, 'k' || (k * 7919 % 3000) AS word, 'box' || (k % 9) AS source, false AS start FROM (SELECT unnest(generate_series(0, 2999)) AS k)
 UNION ALL SELECT 'share', k, ['en', 'd', 'fr'][k + 1], 'plan' || k, true FROM (SELECT unnest([0, 1, 2]) AS k)),
files AS (SELECT doc_id, ['mail', 'wiki', 'share', 'none'][doc_id % 4 + 1] AS root, lang || '/' || CASE WHEN doc_id % 3 = 0 THEN '_attachments/' ELSE 'K' || doc_id || '/' END
 || CASE WHEN doc_id % 5 = 0 THEN '2024-02-' || (10 + doc_id % 19) || '_' ELSE '' END || source || '.' || doc_id || '.txt' AS rel,
 CASE WHEN doc_id % 8 = 0 THEN 'x' || chr(10) || 'Subject: ' || substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 300) ELSE text END AS text FROM documents)"""


@query(rf"""WITH {ROOTS_SQL}, n AS (SELECT f.*, split_part(rel, '/', 1) AS space, regexp_extract(rel, '([^/]*)$', 1) AS name,
 (SELECT min(rank) FROM rules r WHERE r.root = f.root AND CASE WHEN r.start THEN starts_with(split_part(f.rel, '/', 1), r.word) ELSE contains(lower(f.rel), r.word) END) AS rule FROM files f)
SELECT doc_id, n.space, CASE WHEN o.kind = 'pages' THEN CASE WHEN contains(rel, '_attachments/') THEN attached ELSE o.source END ELSE coalesce(r.source, o.source) END AS base,
 substr(CASE WHEN o.kind = 'mail' THEN coalesce(nullif(regexp_extract(text, '(?m)^Subject:[ \t]*(.+)$', 1), ''), regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '^\d{{4}}-\d{{2}}-\d{{2}}_', ''))
  WHEN o.title = 'folder' THEN n.space || ' · ' || name ELSE name END, 1, 200) AS title,
 regexp_extract(name, '\d{{4}}-\d{{2}}-\d{{2}}', 0) AS updated FROM n LEFT JOIN roots o ON o.root = n.root LEFT JOIN rules r ON r.root = n.root AND r.rank = n.rule""")
def docs_meta(spark, sf):
    from lodestone.operators import metadata

    i, k = F.col("doc_id"), F.col("id")
    roots = spark.createDataFrame([("mail", "mail", "mail", "mail", ""), ("wiki", "pages", "wiki", "wiki files", ""), ("share", "files", "files", "files", "folder")], "root string, kind string, source string, attachments string, title string")
    none = F.lit(None).cast("string")
    words = spark.range(3000).select(F.lit("mail").alias("root"), k.alias("rank"), F.array(F.concat(F.lit("k"), (k * 7919 % 3000).cast("string"))).alias("contains"), none.alias("prefix"), F.concat(F.lit("box"), (k % 9).cast("string")).alias("source"))
    starts = spark.range(3).select(
        F.lit("share").alias("root"), k.alias("rank"), F.array().cast("array<string>").alias("contains"), F.get(F.array(*map(F.lit, ["en", "d", "fr"])), k.cast("int")).alias("prefix"), F.concat(F.lit("plan"), k.cast("string")).alias("source")
    )
    text = F.when(i % 8 == 0, F.concat(F.lit("x\nSubject: "), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 300))).otherwise(F.col("text"))
    rel = F.concat(
        "lang", F.lit("/"), F.when(i % 3 == 0, "_attachments/").otherwise(F.concat(F.lit("K"), i.cast("string"), F.lit("/"))),
        F.when(i % 5 == 0, F.concat(F.lit("2024-02-"), (10 + i % 19).cast("string"), F.lit("_"))).otherwise(""), "source", F.lit("."), i.cast("string"), F.lit(".txt"),
    )
    files = table(spark, sf, "documents").select("doc_id", F.get(F.array(*map(F.lit, ["mail", "wiki", "share", "none"])), (i % 4).cast("int")).alias("root"), rel.alias("rel"), text.alias("text"))
    return metadata.described(files, roots, words.unionByName(starts)).select("doc_id", "space", "base", "title", "updated")


@query(r"""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '\' || source || '\a.' || lang WHEN 1 THEN '/old/' || source || '.TXT' WHEN 2 THEN source || '/c/d.Gz' ELSE 'old' END AS path FROM documents),
n AS (SELECT doc_id, regexp_replace(replace(path, '\', '/'), '^/+', '') AS n FROM p)
SELECT doc_id, CASE split_part(n, '/', 1) WHEN 'old' THEN 'new' || substr(n, 4) ELSE n END AS norm, lower(regexp_extract(n, '(\.[^./]+)$', 1)) AS ext FROM n""")
def path_aliases(spark, sf):
    i = F.col("doc_id") % 4
    path = F.when(i == 0, F.concat(F.lit("\\"), "source", F.lit("\\a."), "lang")).when(i == 1, F.concat(F.lit("/old/"), "source", F.lit(".TXT"))).when(i == 2, F.concat("source", F.lit("/c/d.Gz"))).otherwise("old")
    p = table(spark, sf, "documents").select("doc_id", T.slashes(path).alias("n"))
    alias = spark.createDataFrame([("old", "new")], "first string, now string")
    joined = p.withColumn("first", T.first_component(F.col("n"))).join(F.broadcast(alias), "first", "left")  # the configured aliases
    norm = F.when(F.col("now").isNotNull(), F.concat("now", F.expr("substring(n, length(first) + 1)"))).otherwise(F.col("n"))
    return joined.select("doc_id", norm.alias("norm"), T.extension(F.col("n")).alias("ext"))


@query("""SELECT page_id, chr(10) || regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') AS text FROM pages""")
def markup_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.markup_text(F.col("html")).alias("text"))


@query(f"{D_} SELECT path, CASE WHEN length(text) > 1000 THEN substr(text, 1, 800) || chr(10) || '[...]' || chr(10) || right(text, 200) ELSE text END AS excerpt FROM docs_whole")
def model_excerpt(spark, sf):
    return documents(spark, sf).select("path", T.excerpt(F.col("text"), 1000).alias("excerpt"))


@query(f"""{D_}, t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS token FROM docs)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY token""")
def postings(spark, sf):
    whole = documents(spark, sf)
    # A document's words are counted in it, so that only words are shuffled; ids that stand in several rows are few and are
    # told apart by a shuffle of them.
    several = whole.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").select("doc_id")
    if not several.isEmpty():
        tokens = docs(spark, sf).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
        return tokens.groupBy("token", "doc_id").agg(F.count("*").alias("tf")).groupBy("token").agg(F.sum("tf").alias("n"), F.count("doc_id").alias("n_docs"))
    own = whole.select(F.flatten(F.transform(T.chunks(F.col("text")), T.tokens)).alias("all"))
    both = own.select(F.inline(F.array(F.struct(F.lit(False).alias("once"), F.col("all").alias("words")), F.struct(F.lit(True).alias("once"), F.array_distinct("all").alias("words")))))
    words = both.select("once", F.explode("words").alias("token"))
    return words.groupBy("token").agg(F.count_if(~F.col("once")).alias("n"), F.count_if("once").alias("n_docs"))


@query("""WITH v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || source || ' , ''' || lang || ''' ,, c' WHEN 1 THEN ' '' , '' ' WHEN 2 THEN substr(text, 1, 80) ELSE '' END AS v FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(v, ','), lambda x: trim(replace(x, '''', ''))), lambda x: x <> ''), '|') AS parts FROM v""")
def list_arguments(spark, sf):
    i = F.col("doc_id") % 4
    v = F.when(i == 0, F.concat(F.lit(" "), "source", F.lit(" , '"), "lang", F.lit("' ,, c"))).when(i == 1, " ' , ' ").when(i == 2, F.substring("text", 1, 80)).otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.list_argument(v), "|").alias("parts"))


@query(r"""WITH v AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  "' || substr(text, 1, 60) || '"  ' || source WHEN 1 THEN '" "' ELSE substr(text, 1 + doc_id % 50, 40) END AS v FROM documents)
SELECT doc_id, nullif(trim(regexp_replace(replace(v, '"', ' '), '\s+', ' ', 'g')), '') AS words FROM v""")
def query_words(spark, sf):
    i = F.col("doc_id")
    v = F.when(i % 3 == 0, F.concat(F.lit('  "'), F.substring("text", 1, 60), F.lit('"  '), "source")).when(i % 3 == 1, '" "').otherwise(F.expr("substring(text, cast(1 + doc_id % 50 as int), 40)"))
    return table(spark, sf, "documents").select("doc_id", T.search_words(v).alias("words"))


@query("SELECT doc_id, substr(regexp_replace(substr(text, 1, 70), '[^A-Za-z0-9._-]', '_', 'g'), 1, 40) AS label, sha256(text) AS digest, replace(text, 'the', 'THE') = text AS same FROM documents")
def labels_and_digests(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.client_label(F.substring("text", 1, 70)).alias("label"), F.sha2("text", 256).alias("digest"), (F.replace("text", F.lit("the"), F.lit("THE")) == F.col("text")).alias("same"))


@query("""WITH r AS (SELECT event_id, event_id % 13 AS total, event_id % 7 + 1 AS a, event_id % 11 + 1 AS b, event_id % 4 AS k FROM events),
p AS (SELECT event_id, unnest(generate_series(1, 40)) AS p, total, a, b, k FROM r)
SELECT r.event_id, coalesce((SELECT string_agg(p.p - 1, ',' ORDER BY p.p) FROM p WHERE p.event_id = r.event_id AND p.p <= p.total AND (p.k = 0 OR (p.k = 1 AND p.p BETWEEN p.a AND p.b) OR (p.k = 2 AND (p.p = p.b OR p.p BETWEEN p.a AND p.a + 2)))), '') AS pages FROM r""")
def page_ranges(spark, sf):
    text = lambda c: c.cast("string")
    i = F.col("event_id")
    a, b = i % 7 + 1, i % 11 + 1
    spec = F.when(i % 4 == 0, " ").when(i % 4 == 1, F.concat(text(a), F.lit(" - "), text(b))).when(i % 4 == 2, F.concat(text(b), F.lit(","), text(a), F.lit("-"), text(a + 2), F.lit(","), text(b))).otherwise("x")
    e = table(spark, sf, "events").select("event_id", spec.alias("spec"), (i % 13).cast("int").alias("total"))
    return e.select("event_id", F.array_join(T.page_list(F.col("spec"), F.col("total")).cast("array<string>"), ",").alias("pages"))


@query(r"""WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' <' || upper(substr(sha256(text), 1, 9)) || '@' || source || '> ' WHEN 1 THEN '' WHEN 2 THEN '<<' || substr(text, 1, 20) || '>' ELSE ' ' END AS mid FROM documents)
SELECT doc_id, nullif(lower(regexp_replace(regexp_replace(mid, '\s+', '', 'g'), '^<+|>+$', '', 'g')), '') AS mid FROM m""")
def letter_keys(spark, sf):
    i = F.col("doc_id") % 4
    mid = F.when(i == 0, F.concat(F.lit(" <"), F.upper(F.substring(F.sha2("text", 256), 1, 9)), F.lit("@"), "source", F.lit("> "))).when(i == 1, "").when(i == 2, F.concat(F.lit("<<"), F.substring("text", 1, 20), F.lit(">"))).otherwise(" ")
    return table(spark, sf, "documents").select("doc_id", T.message_id(mid).alias("mid"))


@query(f"""{D_}, u AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN updated || 'T10:00' WHEN 2 THEN substr(updated, 1, 7) ELSE updated END AS u FROM docs_whole),
a AS (SELECT doc_id, CASE WHEN regexp_matches(u, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN greatest(0, (2026 - CAST(substr(u, 1, 4) AS INTEGER)) * 365
 + (8 - CAST(substr(u, 6, 2) AS INTEGER)) * 30 + 31 - CAST(substr(u, 9, 2) AS INTEGER)) ELSE 3650 END AS age FROM u)
SELECT doc_id, CAST(age AS BIGINT) AS age, round(pow(0.5, age / 540.0), 6) AS recency FROM a""")
def recency_table(spark, sf):
    i = F.col("doc_id") % 5
    u = F.when(i == 1, F.concat("updated", F.lit("T10:00"))).when(i == 2, F.substring("updated", 1, 7)).when(i > 2, F.col("updated"))
    return documents(spark, sf).select("doc_id", u.alias("u")).select("doc_id", D.rough_age(F.col("u"), 20260831).cast("long").alias("age"), F.round(D.recency(F.col("u"), 20260831), 6).alias("recency"))


@query("""WITH s AS (SELECT user_id, sum(event_id) AS n, 1 + count(*) % 70 AS dim FROM events GROUP BY user_id)
SELECT user_id, CAST(least(greatest(floor(sqrt(n)), 64), 4096) AS BIGINT) AS cells, CAST(CASE WHEN dim % 16 = 0 THEN dim // 16 WHEN dim % 8 = 0 THEN dim // 8 WHEN dim % 4 = 0 THEN dim // 4 WHEN dim % 2 = 0 THEN dim // 2 ELSE dim END AS BIGINT) AS parts FROM s""")
def index_params(spark, sf):
    """Cells and parts of an index for each of many tables: here every user's rows count as one."""
    from lodestone.operators import maintain as M

    sizes = table(spark, sf, "events").groupBy("user_id").agg(F.sum("event_id").alias("n"), (1 + F.count("*") % 70).alias("dim"))
    return sizes.select("user_id", M.index_cells(F.col("n")).alias("cells"), M.sub_vectors(F.col("dim")).alias("parts"))
