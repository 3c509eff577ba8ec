"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

A transcript is its rows in order of an integer position, which also forms the segments. Each line shows a code (its speaker marker, whether a blank line stands
before it, a closing question mark, a small first letter). Hidden states say which role speaks and whether the line
begins a turn or continues one; Viterbi finds the most likely states, so that lines whose marker is missing, odd or
merely quoted are read in context. A marker is taken off a line that begins a turn of the role that it names.

A transcript of any length is decoded exactly without being gathered: it's cut into segments of about ``SEGMENT`` positions,
and one that holds more rows than that, or more than ``SEGMENT_BYTES``, is cut again by position and by the hash that orders
rows of equal positions. Each segment gives the best score between any state before and any state at its end (a max-plus
product, 6 x 6 numbers); these are chained per transcript, which fixes each segment's first and last state, and each segment
is then decoded by itself. Of exactly equally likely labelings the one with lower states at the end is taken; a cut may tip
such a tie the other way. Only rows that repeat position and text can still meet in numbers, or a single long text.

The model's numbers are counted, with one added to each, on transcripts made by rule whose turns are known
(``labelled_transcripts``): who begins, who follows whom, how long turns are, and what their first and later lines show.

Rendering: a turn is ``<|role|>`` with a line feed, its lines, a line feed and ``<|end|>`` with a line feed. There's one
result row per stretch of a turn within an input row, so that turns which span rows aren't gathered either: their
``rendered`` columns, put together in order, are the canonical transcript.

Defined results: null text is an empty line; rows with equal positions are ordered by a hash of their text; a null id is a
transcript of its own; null positions come first; a transcript of blank lines gives one stretch a row; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.session import materialised, ship_package

ROLES = ["system", "user", "assistant"]
#: Positions, and rows, of a transcript that are decoded together, and their text's bytes (a longer text by itself).
SEGMENT = 4096
SEGMENT_BYTES = 8_000_000

# Names that markers use.
NAMES = {
    "system": "system|instructions?|context|setup",
    "user": "user|human|customer|client|question|q|me|you|person|student|visitor",
    "assistant": "assistant|ai|bot|model|agent|answer|a|teacher|gpt|support|helper",
}
_ANY = "|".join(f"(?P<{k}>{v})" for k, v in NAMES.items())
MARKER = re.compile(
    rf"\s{{0,3}}(?:(?:<\|?|\[|\(|\*\*|\#{{1,4}}\s+)\s*(?:{_ANY})\s*(?:\|?>|\]|\)|:?\*\*:?|:|$)|(?:{_ANY.replace('(?P<', '(?P<plain_')})\s*(?:[:：>]|\s[-–—]\s))\s*:?[ \t]*",
    re.I,
)
OTHER = re.compile(r"\s{0,3}[A-Z][\w.'-]{0,20}(?: [A-Z][\w.'-]{0,20})?:\s")

# States: 2 * role + (0 begins, 1 continues).
STATES = 6
NONE, OTHER_NAME = 3, 4


def labelled_transcripts(n: int, seed: int = 1) -> list[list[tuple[int, str]]]:
    """Transcripts as lists of turns, (role, text as it stands in the transcript): four marker styles, some markers left out or
    odd, quoted markers, blank lines inside of turns."""
    import random

    r = random.Random(seed)
    words = "and the of a ship garden why market we river green note under said Anna plain door old is it far".split()
    styles = [("System: ", "User: ", "Assistant: "), ("### System: ", "### Human: ", "### Assistant: "), ("<|system|> ", "<|user|> ", "<|assistant|> "), ("System: ", "Q: ", "A: ")]
    out = []
    for _ in range(n):
        style, turns, role = r.choice(styles), [], 1
        if r.random() < 0.25:
            role = 0
        for k in range(r.randint(1, 9)):
            lines = []
            for j in range(r.choice((1, 1, 1, 2, 2, 3, 5, 8))):
                line = " ".join(r.choices(words, k=r.randint(1, 12)))
                line = line if r.random() < (0.05 if j == 0 else 0.3) else line[:1].upper() + line[1:]
                line += "?" if r.random() < (0.4 if role == 1 and j == 0 else 0.08) else "."
                if j and r.random() < 0.04:
                    line = r.choice(("> ", "    ")) + r.choice(style) + line
                elif j and r.random() < 0.03:
                    line = r.choice(("Note: ", "Anna: ")) + line
                lines += [""] * (j > 0 and r.random() < 0.1) + [line]
            mark = style[role] if k == 0 or r.random() < 0.89 else "" if r.random() < 0.9 else "Anna: "
            gap = "\n" if k and (not mark or r.random() < 0.7) else ""
            turns.append((role, gap + mark + "\n".join(lines)))
            role = (1 if r.random() < 0.97 else 2) if role == 0 else 3 - role if r.random() < 0.95 else role
        out.append(turns)
    return out


def _logs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log chances of the first state, of moves and of what a state shows, by counting."""
    first, move, seen = np.ones(STATES), np.ones((STATES, STATES)), np.ones((STATES, 5, 2, 2, 2))
    first[1::2] = 1e-6  # a transcript can't open with a line that continues
    for turns in labelled_transcripts(3000):
        before = None
        told = codes("\n".join(text for _, text in turns))
        owners = [(role, k) for role, text in turns for k in range(len([x for x in text.split("\n") if x.strip()]))]
        for code, (role, k) in zip([c for c in told if c >= 0], owners, strict=True):
            state = 2 * role + (k > 0)
            if before is None:
                first[state] += 1
            else:
                move[before, state] += 1
            rest = code // 5
            seen[state, code % 5, rest & 1, rest >> 1 & 1, rest >> 2 & 1] += 1
            before = state
    for role in range(3):  # a line never continues another role's turn
        for other in range(3):
            if other != role:
                move[2 * other : 2 * other + 2, 2 * role + 1] = 1e-9
    # Lines that open a turn are read after a blank one or not, whatever the rest of them shows.
    shown = np.zeros((40, STATES))
    parts = [seen.sum(axis=tuple(k for k in range(1, 5) if k != keep)) for keep in range(1, 5)]
    parts = [x / x.sum(axis=1, keepdims=True) for x in parts]
    for marker_, blank, question, small in np.ndindex(5, 2, 2, 2):
        shown[marker_ + 5 * (blank + 2 * question + 4 * small)] = parts[0][:, marker_] * parts[1][:, blank] * parts[2][:, question] * parts[3][:, small]
    return np.log(first / first.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(shown)


def marker(line: str) -> tuple[int, int]:
    """(what it names: a role, NONE or OTHER_NAME; characters it takes)."""
    m = MARKER.match(line)
    if m:
        name = next(k for k, v in m.groupdict().items() if v)
        return ROLES.index(name.removeprefix("plain_")), m.end()
    return (OTHER_NAME if OTHER.match(line) else NONE), 0


def codes(text: str | None) -> list[int]:
    """Codes of a row's lines; blank lines have none (-1). Rows are cut anywhere: nothing stands before a row's first line."""
    out, blank = [], False
    for line in (text or "").split("\n"):
        bare = line.strip()
        if not bare:
            blank = True
            out.append(-1)
            continue
        out.append(marker(line)[0] + 5 * (blank + 2 * bare.endswith("?") + 4 * bare[0].islower()))
        blank = False
    return out


#: The last row of MOVE is the start of a transcript, a state that only ever comes first.
START = STATES
_FIRST, _MOVE, SHOWN = _logs()
MOVE = np.vstack([_MOVE, np.log(np.maximum(np.exp(_FIRST), 1e-12))])


def span_scores(seen: list[int]) -> np.ndarray:
    """Best score from each state before the lines (START included) to each state of the last one."""
    out = MOVE + SHOWN[seen[0]]
    for code in seen[1:]:
        out = (out[:, :, None] + MOVE[None, :STATES]).max(axis=1) + SHOWN[code]
    return out


def viterbi(seen: list[int], before: int = START, last: int | None = None) -> list[int]:
    """The best states of the lines between the state before and the state of the last line (None: any)."""
    if not seen:
        return []
    total = MOVE[before] + SHOWN[seen[0]]
    back = []
    for code in seen[1:]:
        ways = total[:, None] + MOVE[:STATES]
        back.append(ways.argmax(axis=0))
        total = ways.max(axis=0) + SHOWN[code]
    state = int(total.argmax()) if last is None else last
    out = [state]
    for ways in reversed(back):
        state = int(ways[state])
        out.append(state)
    return out[::-1]


# ---------------------------------------------------------------- segments


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[pa.DataType], list[tuple]]]:
    """The columns' types with lists of rows whose first columns are equal: the rows of a segment, or the segments of a transcript."""
    held: list[tuple] = []
    kinds: list[pa.DataType] = []
    for batch in batches:
        kinds = batch.schema.types
        for at in range(0, batch.num_rows, 64):  # so that few of the next segment's texts are held beside this one's
            for row in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns], strict=True):
                if held and held[-1][:keys] != row[:keys]:
                    yield kinds, held
                    held = []
                held.append(row)
    if held:
        yield kinds, held


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, pos, order, text -> id, pos, order, size of the text, codes"""
    for part, texts in slices(batches, "__text"):
        yield pa.RecordBatch.from_arrays(
            [*part.columns[:3], pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([[c for c in codes(t) if c >= 0] for t in texts], pa.list_(pa.int32()))],
            ["__id", "__pos", "__order", "size", "codes"],
        )


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, seg, codes -> id, seg, scores (flat; empty for blank lines only)"""
    for kinds, rows in _runs(batches, 2):
        seen = [c for row in rows for c in row[2]]
        flat = span_scores(seen).ravel().tolist() if seen else []
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], kinds[0]), pa.array([rows[0][1]], kinds[1]), pa.array([flat], pa.list_(pa.float64()))], ["__id", "seg", "scores"])


def chain(tables: list[np.ndarray | None]) -> list[tuple[int, int | None]]:
    """(state before, last state) of each segment of a transcript; None stands for a segment of blank lines."""
    total = np.full(STATES + 1, -np.inf)
    total[START] = 0
    ways: list[np.ndarray | None] = []
    for table in tables:
        if table is None:
            ways.append(None)
            continue
        step = total[:, None] + table
        ways.append(step.argmax(axis=0))
        total = np.r_[step.max(axis=0), -np.inf]
    state, out = int(total.argmax()), []
    for way in reversed(ways):
        if way is None:
            out.append((state, None))
        else:
            out.append((int(way[state]), state))
            state = int(way[state])
    return out[::-1]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, seg, scores of whole transcripts -> id, seg, before, last"""
    for kinds, rows in _runs(batches, 1):
        found = chain([np.array(r[2]).reshape(STATES + 1, STATES) if r[2] else None for r in rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], kinds[0]), pa.array([r[1] for r in rows], kinds[1]), pa.array([x for x, _ in found], pa.int32()), pa.array([y for _, y in found], pa.int32())],
            ["__id", "seg", "before", "last"],
        )


def stretches(texts: list[str | None], before: int = START, last: int | None = None) -> list[tuple[int, int, str, bool, str]]:
    """(row, part, role, begins, text) of consecutive rows, given the states around them."""
    seen = [codes(text) for text in texts]
    states = iter(viterbi([c for row in seen for c in row if c >= 0], before, last))
    out, now = [], before if before != START else 2
    for k, (text, row) in enumerate(zip(texts, seen, strict=True)):
        part, begins, lines = 0, False, []
        for line, code in zip((text or "").split("\n"), row, strict=True):
            if code < 0:
                lines.append("")
                continue
            state = next(states)
            if state % 2 == 0:
                if begins or any(lines):
                    out.append((k, part, ROLES[now // 2], begins, "\n".join(lines).strip("\n")))
                    part += 1
                begins, lines = True, []
                named, taken = marker(line)
                if named == state // 2:
                    line = line[taken:]
            now = state
            lines.append(line)
        out.append((k, part, ROLES[now // 2], begins, "\n".join(lines).strip("\n")))
    return out


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, seg, pos, text, before, last; first of a segment the row that only has before and last."""
    for types, rows in _runs(batches, 2):
        before, last, rows = rows[0][4], rows[0][5], rows[1:]
        opened = before != START
        out = []
        for k, part, role, begins, text in stretches([r[3] for r in rows], before, last):
            head = ("\n<|end|>\n" if opened and begins else "") + (f"<|{role}|>\n" if begins else "\n" if opened else "")
            opened = opened or begins
            out.append((rows[k][0], rows[k][2], part, role, begins, text, head + text))
        kinds = [types[0], types[2], pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["__id", "__pos", "part", "role", "begins", "text", "rendered"])


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """rows (id, pos, order, size) -> each with its segment: a struct that sorts like id's rows do.

    Blocks of positions are counted first; only those that hold too much are cut by position and the top bits of the order.
    """
    block = F.coalesce(F.floor(F.col("__pos") / segment), F.lit(-(1 << 40))).cast("long")
    rows = rows.withColumn("block", block)
    held = rows.groupBy("__id", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    over = F.greatest(F.col("n") / segment, F.col("bytes") / SEGMENT_BYTES)
    much = held.where(over > 1).select(F.col("__id").alias("i"), F.col("block").alias("b"), F.least(F.ceil(F.log2(over)), F.lit(40)).cast("int").alias("bits"))
    joined = rows.join(much, F.col("__id").eqNullSafe(F.col("i")) & (F.col("block") == F.col("b")), "left")
    # The order is signed: shifting keeps it.
    cut = F.struct(
        "block", F.when(F.col("bits").isNotNull(), F.coalesce(F.col("__pos").cast("long"), F.lit(-(1 << 62)))).otherwise(0).alias("pos"),
        F.coalesce(F.call_function("shiftright", F.col("__order"), 64 - F.col("bits")), F.lit(0)).cast("long").alias("part"),
    )
    return joined.withColumn("seg", cut).drop("i", "b", "bits", "block")


SEG = "struct<block:bigint,pos:bigint,part:bigint>"


def format_turns(df: DataFrame, id_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """id, pos, part, role, begins, text, rendered: the turns of the transcripts in df's rows (integer positions)."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{pos_col}`").alias("__pos"), F.col(f"`{text_col}`").alias("__text"))
    rows = rows.select("__id", "__pos", F.xxhash64("__text").alias("__order"), "__text")
    id_type, pos_type = (rows.schema[c].dataType.simpleString() for c in ("__id", "__pos"))
    order = [F.col("__pos").asc_nulls_first(), "__order"]
    coded = rows.mapInArrow(_coded, f"__id {id_type}, __pos {pos_type}, __order long, size long, codes array<int>")
    dealt = materialised(_segments(coded, segment), "chat-codes")
    spans = materialised(
        dealt.repartition("__id", "seg").sortWithinPartitions("__id", "seg", *order).select("__id", "seg", "codes")
        .mapInArrow(_scores, f"__id {id_type}, seg {SEG}, scores array<double>"),
        "chat-spans",
    )
    ends = spans.repartition("__id").sortWithinPartitions("__id", "seg").mapInArrow(_chained, f"__id {id_type}, seg {SEG}, before int, last int")
    texts = _segments(rows.withColumn("size", F.octet_length(F.coalesce("__text", F.lit(""))).cast("long")), segment)
    both = ends.select("__id", "seg", F.lit(None).cast(pos_type).alias("__pos"), F.lit(None).cast("string").alias("__text"), "before", "last", F.lit(0).cast("long").alias("__order")).unionByName(
        texts.select("__id", "seg", "__pos", "__text", F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("last"), "__order")
    )
    placed = both.repartition("__id", "seg").sortWithinPartitions("__id", "seg", F.col("before").isNull(), *order)
    return placed.select("__id", "seg", "__pos", "__text", "before", "last").mapInArrow(
        _decoded, f"__id {id_type}, __pos {pos_type}, part int, role string, begins boolean, text string, rendered string"
    ).withColumnsRenamed({"__id": id_col, "__pos": pos_col})
