"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score. DataFrame functions only.

Kinds email, ip, card and phone are fixed patterns with fixed checks; whatever passes is kept, whatever fails is
dropped without a second try. Two kinds are added: iban (mod-97) and ssn (needs a word nearby that names it).

Positions: matches are extracted; what fails its check is dropped first, and only a text with any left is split at the same
pattern. The code-point offset of a match that passes is the length of the blocks of ``BLOCK`` matches before its own and of the
pieces before it in its block, and its context is put together from the pieces around it. So the work follows the length of
the text, however many numbers it holds. The patterns are possessive, and start only where a run of their characters starts,
so a long run is read once; they find what the plain forms find.

Scores: 0.5 for a plain match, 0.7 with a checksum or range check, 0.3 for ssn; a context word within 40 characters
before or 20 after adds 0.25. Spans of the fixed kinds start at 0.5 at least and the bar is 0.5, so they always stay.

Defined results: a null text counts as empty; spans are ordered by start, then kind as listed; equal rows give equal
results; an empty table gives an empty result; columns of any name are kept (find replaces the one it's asked to give).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order, with their patterns.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
CONTEXT = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|address|server|host",
    "card": r"card|visa|master|credit|payment",
    "phone": r"phone|tel|call|mobile|fax",
    "iban": r"iban|bank|account|konto|cuenta|compte",
    "ssn": r"ssn|social security|taxpayer|insurance number",
}
BASE_SCORE = {"email": 0.5, "ip": 0.7, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.3}
BONUS = 0.25
BAR = 0.5
BEFORE, AFTER = 40, 20
#: Matches whose lengths are added up together, and code points of the strips that a text is put together from; speed only.
BLOCK = 256
STRIP = 2048


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once although a lambda in the body may ask for it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(n: Column) -> Column:
    """Numbers of the blocks that n > 0 elements make."""
    return F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))


def totals(lengths: Column) -> Column:
    """array<int>: the sum of all lengths before each block."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        own = F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda x, y: x + y)
        return F.struct((acc["pos"] + own).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out"))

    return F.aggregate(blocks(F.size(lengths)), start, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    """True if the digits' Luhn sum is a multiple of ten."""
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(compact: Column) -> Column:
    """True if the account number's ISO 7064 remainder is 1."""
    turned = F.concat(F.substring(compact, F.lit(5), F.char_length(compact)), F.substring(compact, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.when(F.char_length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        compact = F.translate(m, " ", "")
        return F.when(F.char_length(compact).between(15, 34), mod97(compact)).otherwise(F.lit(False))
    return F.lit(True)


def _possible(kind: str, text: Column, digits: Column) -> Column:
    """A cheap test that holds wherever the pattern can match."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "iban":
        return digits & text.rlike("[A-Z]{2}[0-9]{2}")
    if kind == "ssn":
        return digits & F.contains(text, F.lit("-"))
    return digits


def _spans(kind: str, text: Column, digits: Column) -> Column:
    order = KINDS.index(kind)
    pattern = globals()[kind.upper()]
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,score:double>>")

    def placed(good: Column, cuts: Column, found: Column) -> Column:
        """The spans of the matches with the numbers `good`."""
        pairs = F.zip_with(F.slice(cuts, F.lit(1), F.size(found)), found, lambda gap, m: F.array(gap, m))
        pieces = F.concat(F.flatten(pairs), F.slice(cuts, -1, 1))  # gap, match, gap, ..., gap
        lengths = F.zip_with(F.slice(cuts, F.lit(1), F.size(found)), found, lambda gap, m: F.char_length(gap) + F.char_length(m))

        def span(i: Column, at: Column) -> Column:
            first = F.floor(i / BLOCK).cast("int")
            inside = F.aggregate(F.slice(at["lengths"], first * BLOCK + 1, i - first * BLOCK), F.lit(0), lambda x, y: x + y)
            size = F.char_length(F.get(found, i))
            end = F.get(at["totals"], first) + inside + F.get(at["lengths"], i)
            # A match has two characters at least, so that so many pieces hold the context.
            low = F.greatest(2 * i + 1 - BEFORE, F.lit(0))
            before = F.array_join(F.slice(at["pieces"], low + 1, 2 * i + 1 - low), "")
            after = F.array_join(F.slice(at["pieces"], 2 * i + 3, F.lit(AFTER + 1)), "")
            near = F.lower(F.concat(F.right(before, F.lit(BEFORE)), F.lit(" "), F.left(after, F.lit(AFTER))))
            score = F.lit(BASE_SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(BONUS)).otherwise(F.lit(0.0))
            return F.struct((end - size).alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

        where = F.struct(pieces.alias("pieces"), lengths.alias("lengths"), bound(lengths, totals).alias("totals"))
        return F.filter(bound(where, lambda at: F.transform(good, lambda i: span(i, at))), lambda x: x["score"] >= BAR)

    def found_in(found: Column) -> Column:
        numbers = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: _valid(kind, F.get(found, i)))
        # Only a text with matches that pass is split: most have none.
        cut = lambda good: bound(F.split(text, pattern, -1), lambda cuts: placed(good, cuts, found))
        return F.when(F.size(found) > 0, bound(numbers, lambda good: F.when(F.size(good) > 0, cut(good)).otherwise(empty))).otherwise(empty)

    return F.when(_possible(kind, text, digits), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found_in)).otherwise(empty)


def spans(text: Column) -> Column:
    """array<struct<start, ord, end, kind, score>>, ordered, of a text column."""
    both = F.struct(F.coalesce(text, F.lit("")).alias("t"), F.coalesce(text.rlike("[0-9]"), F.lit(False)).alias("digits"))
    return bound(both, lambda v: F.array_sort(F.concat(*[_spans(k, v["t"], v["digits"]) for k in KINDS])))


def find(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """df with out: array<struct<start, ord, end, kind, score>>, ordered."""
    return df.withColumn(out, spans(F.col(f"`{text_col}`")))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [KIND]; spans that overlap become one, named by the first."""
    part = "struct<low:int,high:int,kind:string>"

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("low"), x["start"].alias("high"), x["kind"].alias("kind"))))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(x["start"] >= acc["pos"], fresh).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        own = F.aggregate(F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["pos"].alias("pos"), F.array().cast(f"array<{part}>").alias("out")), step)
        return bound(own, lambda o: F.struct(o["pos"].alias("pos"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

    def cut(strips: Column, low: Column, high: Column) -> Column:
        """Code points low to high of the text, from its strips."""
        first = F.floor(low / STRIP).cast("int")
        some = F.array_join(F.slice(strips, first + 1, F.floor((high - 1) / STRIP).cast("int") - first + 1), "")
        return F.when(high > low, F.substring(some, low - first * STRIP + 1, high - low)).otherwise(F.lit(""))

    def put_together(v: Column) -> Column:
        kept = F.transform(F.flatten(v["merged"]["out"]), lambda x: F.concat(cut(v["strips"], x["low"], x["high"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(kept, ""), cut(v["strips"], v["merged"]["pos"], F.char_length(text)))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{part}>>").alias("out"))
    merged = F.aggregate(blocks(F.size(spans)), start, block)
    strips = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRIP}}}"), F.lit(0))
    return bound(F.struct(merged.alias("merged"), strips.alias("strips")), put_together)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of the text column replaced by [KIND]."""
    text = F.col(f"`{text_col}`")
    return df.withColumn(text_col, bound(spans(text), lambda found: F.when(F.size(found) > 0, redacted(text, found)).otherwise(text)))
