"""A minimal acyclic transducer from words to lists of ids, in one file that is memory-mapped.

The automaton is built from sorted words, one after the other: when a word leaves the path of the one before, the states
behind it are final and are replaced by an equal state, if there's one, so that words share their suffixes as well as
their prefixes. Every arc has a number; the numbers on a word's path add up to the word's rank among all words, and the
rank finds its ids. Since an arc's number depends only on what can follow, numbers don't keep states from being shared.

Defined results: no words give an automaton that knows none; the empty word isn't looked up (rank -1); repeated words count
once.
"""

from __future__ import annotations

import json
import mmap
from collections.abc import Iterable

import numpy as np

MAGIC = b"ACYCLIC1"
#: Bytes that a word of the automaton has at most; longer ones aren't compiled.
LONGEST = 48


def _states(words: Iterable[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """The states of the smallest automaton for ascending words, targets before sources, and the first state."""
    known: dict[tuple, int] = {}
    path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
    last = b""

    def settle() -> None:
        (ends,), arcs = path.pop()
        state = known.setdefault((ends, tuple(arcs)), len(known))
        path[-1][1].append((last[len(path) - 1], state))

    for word in words:
        same = 0
        for a, b in zip(word, last):
            if a != b:
                break
            same += 1
        while len(path) > same + 1:
            settle()
        path.extend(([False], []) for _ in word[same:])
        path[-1][0][0] = True
        last = word
    while len(path) > 1:
        settle()
    first = known.setdefault((path[0][0][0], tuple(path[0][1])), len(known))
    return list(known), first


def compile_words(entries: dict[bytes, list[int]]) -> bytes:
    """The file of an automaton for words (1 to LONGEST bytes) and their ids."""
    words = sorted(entries)
    states, first = _states(words)
    below = np.zeros(len(states), np.int64)
    source, target, number = [], [], []
    for state, (ends, arcs) in enumerate(states):
        seen = int(ends)
        for byte, to in arcs:
            source.append(state * 256 + byte)
            target.append(to)
            number.append(seen)
            seen += int(below[to])
        below[state] = seen
    lists = [entries[w] for w in words]
    arrays = {
        "arcs": np.array(source, np.int64),
        "targets": np.array(target, np.int32),
        "numbers": np.array(number, np.int32),
        "ends": np.array([ends for ends, _ in states], np.bool_),
        "starts": np.cumsum([0, *map(len, lists)]).astype(np.int64),
        "ids": np.array([i for ids in lists for i in ids], np.uint32),
    }
    at, parts, places = 0, [], {}
    for name, values in arrays.items():
        raw = values.tobytes()
        places[name] = (at, len(values), values.dtype.str)
        parts.append(raw + b"\0" * (-len(raw) % 64))
        at += len(parts[-1])
    head = json.dumps({"first": first, "words": len(words), "states": len(states), "arrays": places}).encode()
    start = len(MAGIC) + 4 + len(head)
    return MAGIC + len(head).to_bytes(4, "little") + head + b"\0" * (-start % 64) + b"".join(parts)


class Lexicon:
    """A compiled automaton; its arrays are views of the mapped file, shared by the processes of a machine."""

    def __init__(self, data: bytes | mmap.mmap) -> None:
        view = memoryview(data)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a compiled lexicon")
        size = int.from_bytes(view[len(MAGIC) : len(MAGIC) + 4], "little")
        start = len(MAGIC) + 4 + size
        head = json.loads(bytes(view[len(MAGIC) + 4 : start]))
        start += -start % 64
        self.first, self.words, self.states = head["first"], head["words"], head["states"]
        load = lambda name: np.frombuffer(view, np.dtype(head["arrays"][name][2]), head["arrays"][name][1], start + head["arrays"][name][0])
        self.arcs, self.targets, self.numbers, self.ends, self.starts, self.ids = map(load, head["arrays"])

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Ranks of the words data[starts[k]:starts[k + 1]], -1 for those it doesn't hold; all words take a step together."""
        size = np.diff(starts)
        out = np.full(len(size), -1, np.int64)
        rows = np.flatnonzero((size > 0) & (size <= LONGEST)) if len(self.arcs) else np.zeros(0, np.int64)
        state, rank = np.full(len(rows), self.first, np.int64), np.zeros(len(rows), np.int64)
        step = 0
        while len(rows):
            key = state * 256 + data[starts[rows] + step]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            live = self.arcs[at] == key
            rows, at, rank = rows[live], at[live], rank[live]
            state, rank, step = self.targets[at].astype(np.int64), rank + self.numbers[at], step + 1
            over = size[rows] == step
            done = over & self.ends[state]
            out[rows[done]] = rank[done]
            rows, state, rank = rows[~over], state[~over], rank[~over]
        return out

    def lists(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by rank, put together, and how many each has."""
        counts = self.starts[ranks + 1] - self.starts[ranks]
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ranks] - (ends - counts), counts)
        return self.ids[at], counts
