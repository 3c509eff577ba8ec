"""What an indexer writes about a file of the corpus: base, space, title and date, by its root and the root's rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dates as D
from lodestone.functions import text as T
from lodestone.session import ship_package

#: Rules that are sent to every task at most; a table of rules is configuration, and more are refused.
MOST_RULES = 100_000
#: Length of a title.
TITLE = 200


def _matching(needles: dict[tuple[str, bool], list[tuple[str, int]]]):
    """The least rule number of each (root, path, start of path), in one pass over the path whatever the number of rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automata = {}
        for key, words in needles.items():
            automaton = ahocorasick.Automaton()
            for word, rank in sorted(words, key=lambda x: -x[1]):  # of equal words the least rank is put in last
                automaton.add_word(word, (rank, len(word)))
            automaton.make_automaton()
            automata[key] = automaton

        def least(root: str | None, path: str | None, start: bool) -> int | None:
            automaton = automata.get((root, start))
            if automaton is None or not path:
                return None
            return min((rank for end, (rank, size) in automaton.iter(path) if not start or end + 1 == size), default=None)

        for batch in batches:
            roots, low, space = (batch.column(c).to_pylist() for c in ("__root", "__low", "__space"))
            found = []
            for root, path, first in zip(roots, low, space, strict=True):
                hits = [x for x in (least(root, path, False), least(root, first, True)) if x is not None]
                found.append(min(hits, default=None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "rule"])

    return run


def first_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (root, rel, ...) with rule: the least rank among its root's rules that fit, or null.

    rules: root, rank, contains (array of words, one of which stands in the lower-case path) or prefix (of the space, as it's
    written). An empty word or prefix fits everything. Nulls: a file without a root or path has no rule.
    """
    ship_package(files.sparkSession)
    rows = rules.select("root", "rank", F.coalesce("contains", F.array().cast("array<string>")).alias("contains"), "prefix").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    needles: dict = {}
    always: dict[str, int] = {}
    for r in rows:
        for word in [*r["contains"], *([] if r["prefix"] is None else [r["prefix"]])]:
            if word:
                needles.setdefault((r["root"], r["prefix"] is not None), []).append((word, r["rank"]))
            else:
                always[r["root"]] = min(always.get(r["root"], r["rank"]), r["rank"])
    given = files.select(F.struct("*").alias("__row"), F.col("root").alias("__root"), F.lower("rel").alias("__low"), T.first_component(F.col("rel")).alias("__space"))
    schema = f"__row {given.schema['__row'].dataType.simpleString()}, __root string, __low string, __space string, rule long"
    found = given.mapInArrow(_matching(needles), schema)
    any_path = F.coalesce(*[F.when((F.col("__root") == root) & F.col("__low").isNotNull(), rank) for root, rank in always.items()], F.lit(None).cast("long"))
    return found.select("__row.*", F.least("rule", any_path).alias("rule"))


def subject(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?m)^Subject:[ \t]*(.+)$", 1), F.lit(""))


def described(files: DataFrame, roots: DataFrame, rules: DataFrame, attachments: str = "_attachments") -> DataFrame:
    """files (root, rel, text) with base, space, title, updated.

    roots: root, kind (mail, pages, files), source, attachments (base of attachments), title ('folder' puts the space in front);
    rules: as for first_rules(), with source. Letters are called by their subject, else by their name without ending and day; a
    root that the table hasn't got gives no base.
    """
    # Roots and rules (MOST_RULES at most) are configuration; files dealt by root would be a task for each root.
    named = first_rules(files, rules).join(F.broadcast(roots.select("root", "kind", F.col("source").alias("__source"), F.col("attachments").alias("__attached"), F.col("title").alias("__title"))), "root", "left")
    named = named.join(F.broadcast(rules.select("root", F.col("rank").alias("rule"), F.col("source").alias("__by_rule"))), ["root", "rule"], "left")
    name, space = T.file_name(F.col("rel")), T.first_component(F.col("rel"))
    folder = F.regexp_extract("rel", "^(.*)/[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"^\d{4}-\d{2}-\d{2}_", "")
    base = F.when((F.col("kind") == "pages") & F.contains(folder, F.lit(attachments)), F.col("__attached")).when(F.col("kind") == "pages", F.col("__source")).otherwise(F.coalesce("__by_rule", "__source"))
    title = F.when(F.col("kind") == "mail", F.coalesce(subject(F.col("text")), stem)).when(F.col("__title") == "folder", F.concat(space, F.lit(" · "), name)).otherwise(name)
    return named.select(*files.columns, base.alias("base"), space.alias("space"), F.substring(title, 1, TITLE).alias("title"), D.corpus_date(name, F.lit(None).cast("string")).alias("updated"))
