"""Batches, owner decisions, the access journal, and where files are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parameters that the journal never shows, and what a token of the archive looks like.
UNTOLD = ["authorization", "token", "cookie", "s", "c"]
TOKEN = "ba_[A-Za-z0-9_-]{8,}"


def batch_key(batch: Column) -> Column:
    """Sort key of an id: its 14 digits and its number, 1 if it has none."""
    number = F.coalesce(F.nullif(F.regexp_extract(batch, r"^\d{8}-\d{6}-(\d+)$", 1), F.lit("")).cast("long"), F.lit(1))
    return F.struct(F.substring(batch, 1, 15).alias("stamp"), number.alias("number"))


def is_batch(batch: Column) -> Column:
    return batch.rlike(r"^\d{8}-\d{6}(?:-(?:[2-9]|[1-9]\d+))?$")


def summary(receipts: DataFrame) -> DataFrame:
    """Files per batch and decision, owner lines left out."""
    return receipts.where("by is null").groupBy("batch", "decision").agg(F.count("*").alias("files"))


def page(batches: DataFrame, before: str | None, limit: int) -> DataFrame:
    """batch, more: newest first; more says whether there are others after these. limit is a page size (200 at most)."""
    limit = max(1, min(200, limit))
    rows = batches.select("batch").distinct().withColumn("key", batch_key(F.col("batch")))
    if before:
        rows = rows.where(F.col("key") < batch_key(F.lit(before)))
    top = rows.orderBy(F.desc("key")).limit(limit + 1)
    nth = F.row_number().over(Window.orderBy(F.desc("key")))
    return top.withColumn("nth", nth).withColumn("more", F.max("nth").over(Window.partitionBy()) > limit).where(F.col("nth") <= limit).select("batch", "more")


def detail(receipts: DataFrame) -> DataFrame:
    """Each file's last receipt in a batch with the owner's last word on it."""
    latest = receipts.where("by is null").groupBy("batch", "name").agg(F.max_by("decision", "line").alias("decision"), F.max("line").alias("line"))
    owner = receipts.where("by is not null").groupBy("batch", "name").agg(F.max_by("decision", "line").alias("owner"), F.max_by("time", "line").alias("owner_time"))
    return latest.join(owner, ["batch", "name"], "left").select("batch", "name", "decision", "owner", "owner_time", location(F.col("decision"), F.col("owner")).alias("location"))


def location(decision: Column, owner: Column) -> Column:
    return (
        F.when(owner == "reject", "returned").when(owner == "delete", "deleted").when(owner == "accept", "corpus")
        .when(decision == "accept", "corpus").when(decision == "review", "queue").when(decision == "quarantine", "quarantine")
    )


def journal_tail(journal: DataFrame, n: int, client: str | None = None) -> DataFrame:
    """The last n records (a report's page), maybe of one client."""
    rows = journal if client is None else journal.where(F.col("client") == client)
    return rows.orderBy(F.desc("line")).limit(n)


def scrub(params: Column) -> Column:
    """Map of parameters without nulls and untold keys; tokens masked, values cut to 200 characters."""
    kept = F.map_filter(params, lambda k, v: v.isNotNull() & ~F.lower(k).isin(UNTOLD))
    hidden = lambda v: F.regexp_replace(v, TOKEN, "ba_***")
    return F.transform_values(kept, lambda k, v: F.when(F.char_length(hidden(v)) > 200, F.concat(F.substring(hidden(v), 1, 200), F.lit("…"))).otherwise(hidden(v)))


def took(started: Column, finished: Column) -> Column:
    """Whole seconds between two moments, none if the clock went back."""
    return F.greatest(F.lit(0), F.round(finished - started)).cast("long")


def kept_in_cache(files: DataFrame, now: int, days: int, cap: int) -> DataFrame:
    """Files young enough whose sizes, newest first, still fit the cap. files: name, size, used (seconds).

    Hours are added up first: there are 24 a day, so the running sum over them is small, and each hour's files are ordered
    by themselves.
    """
    young = files.where(F.col("used") >= now - days * 86400).withColumn("hour", F.floor(F.greatest(F.lit(0), now - F.col("used")) / 3600))
    hours = young.groupBy("hour").agg(F.sum("size").alias("held"))
    before = hours.select("hour", F.coalesce(F.sum("held").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("hour").orderBy(F.desc("used"), "name").rowsBetween(Window.unboundedPreceding, 0)
    fits = young.join(F.broadcast(before.where(F.col("before") <= cap)), "hour")  # 24 rows a day
    return fits.withColumn("total", F.col("before") + F.sum("size").over(inside)).where(F.col("total") <= cap).drop("hour", "before")


def first_of_each(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """A report's lists: the first `most` of each group by name, with how many more there are on the last line of each."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    total = rows.groupBy(group).agg(F.count("*").alias("total"))
    shown = rows.withColumn("place", place).where(F.col("place") <= most).join(total, group)
    return shown.withColumn("more", F.when(F.col("place") == most, F.col("total") - most).otherwise(0)).drop("total")


def budgeted_pages(documents: DataFrame, per_pass: int = 60, per_document: int = 20, tries: int = 3, slots: int = 4096) -> DataFrame:
    """Documents whose pages a pass still reads, oldest debt first: id, pages (per_document at most), spent before.

    documents: id, pages, tried. A document counts a page at least, so a pass never looks at more than per_pass of them; only
    the per_pass + 1 oldest take part in the running sum.
    """
    due = documents.where(F.col("tried") < tries).select("id", F.least(F.greatest("pages", F.lit(1)), F.lit(per_document)).cast("long").alias("pages"))
    first = due.orderBy("id").limit(min(per_pass + 1, slots))
    before = F.coalesce(F.sum("pages").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("spent", before).where(F.col("spent") + F.col("pages") <= per_pass)


def reviewed(queue: DataFrame, asked: DataFrame) -> DataFrame:
    """Owner's actions on queue files: path, action, outcome. queue: path, sha (of its receipt), now (its bytes' sha), location.

    accept takes a file whose bytes are still those of its receipt; reject and return need one in the queue or in quarantine;
    delete any that isn't gone. Of several actions on one path the first by number counts. asked: nth, path, action.
    """
    one = asked.groupBy("path").agg(F.min_by("action", "nth").alias("action"))
    joined = one.join(queue, "path", "left")
    held = F.col("location").isin("queue", "quarantine")
    outcome = (
        F.when(F.col("location").isNull(), "missing").when(F.col("action") == "delete", F.when(F.col("location").isin("returned", "deleted"), "gone").otherwise("deleted"))
        .when(~held, "not waiting").when(F.col("action") == "accept", F.when(F.col("sha") == F.col("now"), "corpus").otherwise("changed"))
        .when(F.col("action").isin("reject", "return"), "returned").otherwise("unknown action")
    )
    return joined.select("path", "action", outcome.alias("outcome"))


def state_of(entries: DataFrame, receipts: DataFrame) -> DataFrame:
    """One row: entries waiting and quiet in the inbox, files in the queue and in quarantine (their last receipt says so),
    those that wait for their index, and whether anything needs the owner."""
    last = receipts.where("by is null").groupBy("name").agg(F.max_by("decision", "line").alias("decision"), F.max("line").alias("line"))
    owned = receipts.where("by is not null").groupBy("name").agg(F.max("line").alias("owner_line"))
    now = last.join(owned, "name", "left").where(F.col("owner_line").isNull() | (F.col("owner_line") < F.col("line")))
    held = now.agg(
        F.count_if(F.col("decision") == "review").alias("queue"), F.count_if(F.col("decision") == "quarantine").alias("quarantine"), F.count_if(F.col("decision") == "duplicate").alias("pending")
    )
    waiting = entries.agg(F.count("*").alias("waiting"), F.count_if(F.col("ready")).alias("ready"))
    both = waiting.crossJoin(F.broadcast(held))  # one row beside one row
    return both.withColumn("attention", F.col("queue") + F.col("quarantine") > 0)


def decision_counts(receipts: DataFrame) -> DataFrame:
    """batch and a map from decision to its number of files."""
    counts = receipts.where("by is null").groupBy("batch", "decision").agg(F.count("*").alias("n"))
    return counts.groupBy("batch").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("decision", "n")))).alias("counts"))  # a handful of decisions
