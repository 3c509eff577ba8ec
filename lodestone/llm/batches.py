"""Helpers for functions that run over Arrow batches in Python."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc

#: Text held as Python objects at a time, in bytes; a longer text is a slice of its own.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with their texts; null texts are empty ones. What is held at a time is bounded."""
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(at).to_pylist()]
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, [t or "" for t in part.column(at).to_pylist()]


class UnitCache(dict):
    """unit -> value with a bounded number of entries: two generations, the older one dropped when the newer fills.

    Only speed depends on what it holds, never a result.
    """

    def __init__(self, make, limit: int = 220_000, longest: int = 48) -> None:
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def all(self, units: list) -> tuple:
        """The values of all units, in one call."""
        return itemgetter(*units)(self) if len(units) > 1 else tuple(self[u] for u in units)

    def __missing__(self, unit):
        value = self.old.get(unit)
        if value is None:
            value = self.make(unit)
        if len(unit) <= self.longest:
            self.put(unit, value)
        return value

    def put(self, unit, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[unit] = value
