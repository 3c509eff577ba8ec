"""Index maintenance: duplicate plans, date repair, rewriting, parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def dedupe_plan(index: DataFrame, known: DataFrame, mail_sources: list[str], ranks: dict[str, int]) -> DataFrame:
    """Every index path of a mail root with its group and place: place 1 stays. index: path, updated.

    Groups are by message id, else by content hash; the best row has the earliest date (none last), then the better root,
    then the second path part, the larger size, the normal path, the path. A path that the identity base lacks is unknown.
    """
    worst = max(ranks.values(), default=0) + 1
    rank = F.coalesce(*[F.when(F.col("root") == r, n) for r, n in ranks.items()], F.lit(worst)) if ranks else F.lit(worst)
    base = index.withColumn("norm", T.slashes(F.col("path"))).withColumn("root", T.first_component(F.col("norm")))
    base = base.withColumn("inside", F.col("root").isin(mail_sources))
    keyed = base.join(known.select(F.col("path").alias("norm"), "sha", "mid", "size"), "norm", "left")
    keyed = keyed.withColumn("kind", F.when(~F.col("inside"), "outside").when(F.col("sha").isNull(), "unknown").otherwise("grouped"))
    deep = F.size(F.split("norm", "/")) > 2
    order = [
        F.coalesce(F.nullif(F.substring("updated", 1, 10), F.lit("")), F.lit("9999")), rank, F.when(deep, F.split_part("norm", F.lit("/"), F.lit(2))).otherwise(""),
        F.desc("size"), "norm", "path",
    ]
    mid = F.nullif("mid", F.lit(""))
    group = F.when(F.col("kind") == "grouped", F.coalesce(F.concat(F.lit("mid:"), mid), F.concat(F.lit("sha:"), F.col("sha"))))
    grouped = keyed.withColumn("grp", group).where("kind = 'grouped'")
    placed = grouped.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*order)))
    rest = keyed.where("kind <> 'grouped'").withColumns({"grp": F.lit(None).cast("string"), "place": F.lit(None).cast("int")})
    return placed.unionByName(rest).select("path", "norm", "kind", "grp", "place")


def dedupe_counters(plan: DataFrame) -> DataFrame:
    group = plan.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("norm").alias("norms")).where("grp is not null")
    more = group.agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - F.col("norms")), F.lit(0)).cast("long").alias("same_file"))
    flat = plan.agg(
        F.count_if(F.col("kind") == "grouped").alias("letters"), F.count("*").alias("files"), F.count_if(F.col("place") > 1).alias("dropped"),
        F.count_if(F.col("kind") == "outside").alias("outside"), F.count_if(F.col("kind") == "unknown").alias("unknown"),
    )
    return flat.crossJoin(F.broadcast(more))  # one row of counters beside another


def without_paths(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("path").distinct(), "path", "left_anti")


#: The folder that holds attachments beside letters or pages.
ATTACHED = "/_attachments/"


def date_plan(index: DataFrame, known: DataFrame, mail_roots: list[str], page_roots: list[str]) -> DataFrame:
    """New dates of index paths: path, old, new, reason. index: path, updated; known: path, date, letter (boolean).

    In mail roots a letter has its header's date, or is unknown without one. Its attachments lie in
    ``_attachments/<anything>_<code>/`` and have the date of the letter whose name ends in ``_<code>.eml`` or ``.msg`` (8 hex
    digits, same folder), else the day that their folder's name begins with. In page roots attachments lie in
    ``_attachments/<id>/`` and have the day of the indexed page ``<id>__...`` beside. All else stays; an equal day is ``same``.
    """
    rows = index.withColumn("norm", T.slashes(F.col("path"))).withColumn("root", T.first_component(F.col("norm")))
    base = F.when(F.contains("norm", F.lit(ATTACHED)), F.split_part("norm", F.lit(ATTACHED), F.lit(1)))
    rows = rows.withColumn("base", base).withColumn("folder", F.split_part(F.split_part("norm", F.lit(ATTACHED), F.lit(2)), F.lit("/"), F.lit(1)))
    rows = rows.withColumn("code", F.regexp_extract("folder", "(?:^|_)([0-9a-f]{8})$", 1))
    own = known.select(F.col("path").alias("norm"), F.col("date").alias("own"), "letter")
    place = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    coded = known.where("date is not null").select(place.alias("base"), F.regexp_extract("path", r"_([0-9a-f]{8})\.(?:eml|msg)$", 1).alias("code"), F.col("date").alias("by_letter"))
    coded = coded.where("code <> ''").groupBy("base", "code").agg(F.max("by_letter").alias("by_letter"))
    pages = rows.where(F.col("root").isin(page_roots) & F.col("base").isNull() & (F.coalesce("updated", F.lit("")) != "") & F.contains(T.file_name(F.col("norm")), F.lit("__")))
    pages = pages.select(
        F.regexp_extract("norm", "^(.*)/[^/]*$", 1).alias("base"), F.split_part(T.file_name(F.col("norm")), F.lit("__"), F.lit(1)).alias("folder"), F.substring("updated", 1, 10).alias("by_page")
    ).groupBy("base", "folder").agg(F.max("by_page").alias("by_page"))
    joined = rows.join(own, "norm", "left").join(coded, ["base", "code"], "left").join(pages, ["base", "folder"], "left")
    mail, letter, inside = F.col("root").isin(mail_roots), F.coalesce("letter", F.lit(False)), F.col("base").isNotNull()
    by_name = F.nullif(F.regexp_extract("folder", r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    paged = F.col("root").isin(page_roots) & inside
    new = F.when(mail & letter, F.col("own")).when(mail & inside, F.coalesce("by_letter", by_name)).when(paged, F.col("by_page"))
    concerned = mail & (letter | inside) | paged
    reason = (
        F.when(~concerned, "other").when(new.isNull(), "unknown").when(new == F.substring(F.coalesce("updated", F.lit("")), 1, 10), "same")
        .when(mail & letter, "letter").when(paged | F.col("by_letter").isNotNull(), "parent").otherwise("name")
    )
    return joined.select("path", F.col("updated").alias("old"), F.when(reason.isin("letter", "parent", "name"), new).otherwise(F.col("updated")).alias("new"), reason.alias("reason"))


def date_counters(plan: DataFrame) -> DataFrame:
    """One row: dates that change, those of letters, by parent and by name, days that are right already, and those not known."""
    some = lambda reason: F.count_if(F.col("reason") == reason)
    return plan.agg(
        F.count_if(F.col("reason").isin("letter", "parent", "name")).alias("changed"), some("letter").alias("letters"), some("parent").alias("by_parent"), some("name").alias("by_name"),
        some("same").alias("same"), some("unknown").alias("unknown"),
    )


def rewritten(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """All rows with planned dates in place."""
    changes = plan.where("new <> old").select("path", "new")
    return docs.join(changes, "path", "left").withColumn("updated", F.coalesce("new", "updated")).drop("new")


def swap_in(df: DataFrame, live: str, aside: str) -> str:
    """Write df beside the live table and check its row count; the caller then points readers to the path returned."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(aside)
    before, after = spark.read.parquet(live).count(), spark.read.parquet(aside).count()
    if before != after:
        raise ValueError(f"{after} rows written, {before} expected")
    return aside


def index_cells(rows: Column) -> Column:
    return F.least(F.greatest(F.floor(F.sqrt(rows)), F.lit(64)), F.lit(4096)).cast("long")


def sub_vectors(dim: Column) -> Column:
    out = F.when(dim % 16 == 0, (dim / 16).cast("long"))
    for w in (8, 4, 2):
        out = out.when(dim % w == 0, (dim / w).cast("long"))
    return out.otherwise(dim.cast("long"))
