"""Dates kept as text. Ages are rough on purpose: 365 days a year, 30 a month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import bound

UNDATED_DAYS = 3650
HALF_LIFE = 540
#: Days before this one aren't believed.
FIRST_DAY = "1990-01-01"


def rough_age(updated: Column, today: int) -> Column:
    """Days from a date's first ten characters to today (YYYYMMDD); undated or malformed: UNDATED_DAYS; future: 0."""
    part = lambda k: F.regexp_extract(updated, r"^(\d{4})-(\d{2})-(\d{2})", k).cast("int")
    days = (today // 10000 - part(1)) * 365 + (today // 100 % 100 - part(2)) * 30 + (today % 100 - part(3))
    return F.when(updated.rlike(r"^\d{4}-\d{2}-\d{2}"), F.greatest(days, F.lit(0))).otherwise(F.lit(UNDATED_DAYS))


def recency(updated: Column, today: int) -> Column:
    return F.pow(F.lit(0.5), rough_age(updated, today).cast("double") / F.lit(float(HALF_LIFE)))


def believed(day: Column, latest: Column) -> Column:
    """A day written YYYY-MM-DD if the calendar has it and it lies between FIRST_DAY and latest; else null."""
    exists = F.try_to_date(day, "yyyy-MM-dd")
    return F.when(F.date_format(exists, "yyyy-MM-dd").eqNullSafe(day) & day.between(F.lit(FIRST_DAY), latest), day)


def named_date(name: Column, latest: Column) -> Column:
    """The first believed date in a file name; those that begin with the year come before those that begin with the day.

    A name is read as runs of digits and what stands between them: year-month-day is 4, 2 and 2 digits joined by hyphens,
    day.month.year 2, 2 and 4 joined by dots.
    """

    def read(v: Column) -> Column:
        runs, gaps = v["runs"], v["gaps"]

        def triple(i: Column, joint: str, sizes: tuple[int, int, int], order: tuple[int, int, int]) -> Column:
            fits = (F.get(gaps, i + 1) == joint) & (F.get(gaps, i + 2) == joint)
            for k, size in enumerate(sizes):
                fits = fits & (F.char_length(F.get(runs, i + k)) == size)
            return F.when(fits, believed(F.concat_ws("-", *[F.get(runs, i + k) for k in order]), latest))

        at = F.sequence(F.lit(0), F.size(runs) - 3)
        found = F.concat(F.transform(at, lambda i: triple(i, "-", (4, 2, 2), (0, 1, 2))), F.transform(at, lambda i: triple(i, ".", (2, 2, 4), (2, 1, 0))))
        return F.when(F.size(runs) >= 3, F.try_element_at(F.filter(found, lambda d: d.isNotNull()), F.lit(1)))

    return bound(F.struct(F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0)).alias("runs"), F.split(name, "[0-9]+", -1).alias("gaps")), read)


def metadata_date(raw: Column, latest: Column) -> Column:
    """The believed date in a document's own properties (their text): changed before created, of PDF and of office files."""
    pdf = lambda key: F.regexp_replace(F.regexp_extract(raw, rf"/{key}\s*\(D:([0-9]{{8}})", 1), "^(.{4})(..)(..)$", "$1-$2-$3")
    office = lambda key: F.regexp_extract(raw, rf"<dcterms:{key}[^>]*>\s*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})", 1)
    return F.coalesce(*[believed(d, latest) for d in (pdf("ModDate"), pdf("CreationDate"), office("modified"), office("created"))])


MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def header_day(value: Column, today: Column) -> Column:
    """The day of a mail header's date by the sender's clock; years from 1990 to the one after today's."""
    part = lambda k: F.regexp_extract(value, r"(?i)^\s*(?:[a-z]{3},)?\s*([0-9]{1,2})\s+([a-z]{3})[a-z]*\s+([0-9]{4})\b", k)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(F.lower(part(2))))
    day = F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))
    year = part(3).try_cast("int")
    return F.when(F.date_format(F.try_to_date(day, "yyyy-MM-dd"), "yyyy-MM-dd").eqNullSafe(day) & year.between(1990, F.year(today) + 1), day)


def letter_day(date: Column, received: Column, today: Column) -> Column:
    """A letter's day: its date header, else the earliest server's stamp (the last of `received`, after its semicolon)."""
    stamps = F.transform(F.reverse(received), lambda r: header_day(F.trim(F.substring_index(r, ";", -1)), today))
    return F.coalesce(header_day(date, today), F.try_element_at(F.filter(stamps, lambda d: d.isNotNull()), F.lit(1)))


def document_date(metadata: Column, name: Column, modified: Column, accepted: Column) -> Column:
    """struct<day, origin>: metadata, name, file time, then the day of acceptance."""
    choice = lambda day, origin: F.when(day.isNotNull(), F.struct(day.alias("day"), F.lit(origin).alias("origin")))
    return F.coalesce(
        choice(believed(metadata, accepted), "metadata"), choice(named_date(name, accepted), "name"),
        choice(believed(modified, accepted), "file"), choice(accepted, "accepted"),
    )


def corpus_date(name: Column, modified: Column) -> Column:
    """First ISO-like run in the name, taken as it is; else the file day; else empty."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}", 0), F.lit("")), modified, F.lit(""))
