"""Keyed stream state: entries that wait to be quiet, and debts that are offered again until they're paid.

Both keep their state per key in the stream's state store, with timers, so what is held grows with the open entries and
debts only: an entry that's ready and a debt that's paid leave nothing behind. A stopped stream goes on from its checkpoint.
Time is the rows' own (event time), which makes a rerun give the same rows; a live inbox can use processing time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUIET_SECONDS = 30
RETRY_SECONDS = 600
READY = "entry long, since timestamp, changes long, ready timestamp"
EPOCH = datetime(1970, 1, 1)
OFFER = "debt string, attempt int, at timestamp, state string"


def _us(moment: datetime) -> int:
    """Microseconds, in which state is kept; timers go by milliseconds."""
    return (moment.replace(tzinfo=None) - EPOCH) // timedelta(microseconds=1)


def _moment(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


def _timer(us: int) -> int:
    return -(-us // 1000)


class Quiet(StatefulProcessor):
    """One row for each time that an entry stayed unchanged for so long.

    State of an open entry: its last size and mtime, since when, and how many changes there were. A row that says the
    same as the last one isn't a change; one without a size says that the entry is gone, which forgets it.
    """

    def __init__(self, seconds: int) -> None:
        self.quiet = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "size long, mtime long, since long, changes long")

    def _due(self, held: tuple) -> int:
        """An open entry's only timer, which needn't be asked for: every call of the store is a message to the JVM."""
        return _timer(held[2] + self.quiet)

    def _ready(self, entry: int, held: tuple) -> Row:
        return Row(entry=entry, since=_moment(held[2]), changes=held[3], ready=_moment(held[2] + self.quiet))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        found = self.open.get()
        before = held = None if found is None else tuple(found)
        for row in sorted(rows, key=lambda r: (r.seen, r.size is not None, r.size or 0, r.mtime or 0)):
            seen = _us(row.seen)
            if held and seen - held[2] >= self.quiet:
                yield self._ready(key[0], held)
                held = None
            if row.size is None:
                held = None
            elif not held or (row.size, row.mtime) != held[:2]:
                held = (row.size, row.mtime, seen, held[3] + 1 if held else 1)
        if held == before:
            return
        if before and (held is None or self._due(held) != self._due(before)):
            self.handle.deleteTimer(self._due(before))
        if held is None:
            self.open.clear()
            return
        self.open.update(held)
        if not before or self._due(held) != self._due(before):
            self.handle.registerTimer(self._due(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        found = self.open.get()
        if found is not None:
            held = tuple(found)
            if held[2] + self.quiet <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
                yield self._ready(key[0], held)
                self.open.clear()

    def close(self) -> None:
        pass


class Debts(StatefulProcessor):
    """Offers a debt as it comes, and again after each wait, until it's paid or its file is gone.

    State of an open debt: a list of the moments at which it was offered. A debt that's owed twice is one debt; those that come
    in while others are worked on are offered by their own timers, so none waits for the next pass.
    """

    def __init__(self, seconds: int, most: int) -> None:
        self.wait, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.offers = handle.getListState("offers", "at long")

    def _close(self) -> None:
        self.offers.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        made = [x[0] for x in self.offers.get()] if self.offers.exists() else []
        there = bool(made)
        for row in sorted(rows, key=lambda r: (r.at, r.event)):
            now = _us(row.at)
            while made and len(made) < self.most and made[-1] + self.wait < now:  # timers that this batch has overtaken
                made.append(made[-1] + self.wait)
                yield Row(debt=key[0], attempt=len(made), at=_moment(made[-1]), state="offered")
            if row.event == "owed" and not made:
                made = [now]
                yield Row(debt=key[0], attempt=1, at=row.at, state="offered")
            elif row.event in ("paid", "gone") and made:
                yield Row(debt=key[0], attempt=len(made), at=row.at, state=row.event)
                made = []
        if made:
            self.offers.put([(x,) for x in made])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if len(made) < self.most:
                self.handle.registerTimer(_timer(made[-1] + self.wait))
        elif there:
            self._close()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        made = [x[0] for x in self.offers.get()] if self.offers.exists() else []
        now = 1000 * max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)  # what's due by now
        due = len(made)
        while made and len(made) < self.most and made[-1] + self.wait <= now:
            made.append(made[-1] + self.wait)
            yield Row(debt=key[0], attempt=len(made), at=_moment(made[-1]), state="offered")
        if len(made) > due:
            self.offers.put([(x,) for x in made])
            if len(made) < self.most:
                self.handle.registerTimer(_timer(made[-1] + self.wait))

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    from pyspark.sql.types import StructType

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(key).transformWithState(processor, StructType.fromDDL(schema), "Append", mode)


def ready_entries(changes: DataFrame, seconds: int = QUIET_SECONDS, late: str = "0 seconds", mode: str = "EventTime") -> DataFrame:
    """A streaming frame of entries that became quiet: entry, since, changes, ready.

    changes: a streaming frame of entry, seen (timestamp), size, mtime (both null: gone). Rows that are later than `late` behind
    the newest row of a finished micro-batch are left out, as Spark does with late rows; a row without an entry or a moment too.
    """
    given = changes.where("entry is not null and seen is not null").withWatermark("seen", late)
    return _stateful(given, "entry", Quiet(seconds), READY, mode)


def offered_debts(events: DataFrame, seconds: int = RETRY_SECONDS, most: int = 10, late: str = "0 seconds", mode: str = "EventTime") -> DataFrame:
    """A streaming frame of offers: debt, attempt, at, state (offered, or how the debt ended: paid, gone).

    events: a streaming frame of debt, at (timestamp), event (owed, paid, gone); `most` is the number of offers after which a
    debt waits for an owner.
    """
    given = events.where("debt is not null and at is not null").withWatermark("at", late)
    return _stateful(given, "debt", Debts(seconds, most), OFFER, mode)


def collected(stream: DataFrame, home: str, schema: str) -> DataFrame:
    """Run a stream over all that's there, its rows appended to a table under home, and read the table."""
    query = stream.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{home}/rows")
