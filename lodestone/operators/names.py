"""Rules on names and paths: what is walked, read, described or refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Extensions that have a reader, that are plain text, and types that a picture reader describes.
READABLE = "pdf docx xlsx xlsm pptx msg eml bpmn svg xml html htm drawio".split()
PLAIN = "txt csv tsv md log sql json yaml yml properties conf ini".split()
DESCRIBABLE = "png jpg jpeg gif tif tiff bmp webp heic pdf".split()
QUARANTINE = "_quarantine"
LEVELS = ["read", "full", "local"]


def bare_extension(path: Column) -> Column:
    return F.regexp_replace(T.extension(path), r"^\.", "")


def walked(path: Column, kind: Column, include: Column, exclude: Column) -> Column:
    """Whether the corpus walk takes a file: its root's needles, no quarantine folder, no sidecar name, a known extension, and
    no description beside letters. Needles are null where a root has none."""
    name = T.file_name(path)
    quarantined = F.array_contains(F.split(path, "/"), QUARANTINE)
    known = bare_extension(path).isin(READABLE + PLAIN)
    needles = F.coalesce(F.contains(path, include), F.lit(True)) & ~F.coalesce(F.contains(path, exclude), F.lit(False))
    return needles & ~quarantined & ~name.startswith("._") & known & ~((kind == "mail") & (bare_extension(path) == "json"))


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """path (under root), size, modified of all files of a tree; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    rel = F.regexp_replace(F.element_at(F.split("path", F.lit(root.rstrip("/") + "/"), 2), -1), "^/+", "")
    return files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def ignored(name: Column, names: list[str]) -> Column:
    """Inbox entries that are hidden or named so."""
    return name.startswith(".") | F.lower(name).isin([n.lower() for n in names])


def describable(kind: Column, path: Column) -> Column:
    """By the detected type, else by the extension."""
    return F.coalesce(kind, bare_extension(path)).isin(DESCRIBABLE)


def sandboxed(path: Column, aliases: dict[str, str]) -> Column:
    """An index path inside the corpus, its first part's alias resolved; null if it would leave the corpus."""
    parts = F.filter(F.split(T.slashes(path), "/"), lambda p: ~p.isin("", "."))
    first = F.element_at(parts, 1)
    now = F.coalesce(*[F.when(first == old, new) for old, new in aliases.items()], first)
    inside = ~F.exists(parts, lambda p: p == "..") & (F.size(parts) > 0) & ~F.contains(path, F.lit("\0")) & ~path.rlike("^[A-Za-z]:")
    return F.when(inside, F.array_join(F.concat(F.array(now), F.slice(parts, F.lit(2), F.size(parts))), "/"))


def allows(level: Column, need: Column) -> Column:
    rank = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), c)
    return (rank(level) >= rank(need)) & (rank(need) > 0)


def path_forms(path: Column, aliases: dict[str, str]) -> Column:
    """All spellings of a document's path: with slashes and with backslashes, under its root's old and new names."""
    norm = T.slashes(path)
    first, rest = T.first_component(norm), F.regexp_extract(norm, "^[^/]*(.*)$", 1)
    pairs = list(aliases.items())
    roots = F.array_distinct(F.filter(F.array(first, *[F.when(first == a, b) for a, b in pairs], *[F.when(first == b, a) for a, b in pairs]), lambda r: r.isNotNull()))
    slashed = F.transform(roots, lambda r: F.concat(r, rest))
    return F.array_distinct(F.concat(slashed, F.transform(slashed, lambda p: F.translate(p, "/", "\\"))))


def without_document(index: DataFrame, gone: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """The index without any form of the paths in `gone` (path)."""
    forms = gone.select(F.explode(path_forms(F.col("path"), aliases)).alias("path")).distinct()
    return index.join(forms, "path", "left_anti")
