"""Stateful processors for events that arrive out of order: typed state of a key, and timers of event time.

Rows wait in a map by their time until the watermark has passed them; then they are folded in order. A timer of the
key stands at the first moment at which a row that waits is settled, or at which the key has been silent for `keep`.
These need the RocksDB state store (see use_rocksdb).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_START = datetime(1970, 1, 1, tzinfo=timezone.utc)


def use_rocksdb(spark: SparkSession) -> None:
    """Let this session's stream queries that start from now on keep their state in RocksDB."""
    spark.conf.set(PROVIDER, ROCKSDB)


def needs_rocksdb(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}; use_rocksdb(spark) does so")


def _micros(at: datetime) -> int:
    passed = (at if at.tzinfo else at.astimezone(timezone.utc)) - _START
    return (passed.days * 86_400 + passed.seconds) * 1_000_000 + passed.microseconds


def _moment(micros: int) -> datetime:
    return datetime.fromtimestamp(micros / 1e6)


class InOrder(StatefulProcessor):
    """Folds the rows of a key in order of time and id. Subclasses say what waits, what is kept, and what goes out."""

    #: Columns of a waiting row beside its time and id, and the state that fold takes forward.
    WAITING, SETTLED = "", ""

    def __init__(self, time: str, number: str, keep: int):
        self.time, self.number, self.keep = time, number, keep * 1000  # in microseconds from here on
        self.columns = [c.split()[0] for c in self.WAITING.split(", ")]

    def start(self) -> tuple:
        raise NotImplementedError

    def fold(self, key: tuple, settled: tuple, row: tuple) -> tuple[tuple, list[Row]]:
        """The state after a row (time, id and the columns that wait), and rows that go out for good."""
        raise NotImplementedError

    def now(self, key: tuple, settled: tuple, waiting: list[tuple]) -> list[Row]:
        """Rows that go out after each batch, with what still waits."""
        return []

    def over(self, key: tuple, settled: tuple) -> list[Row]:
        """Rows that go out when a key is given up."""
        return []

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id long", self.WAITING)
        self.settled = handle.getValueState("settled", self.SETTLED)
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = self.last.get()[0] if self.last.exists() else 0
        for row in rows:
            at = _micros(row[self.time])
            newest = max(newest, at)
            self.waiting.updateValue((at, row[self.number]), tuple(row[c] for c in self.columns))
        self.last.update((newest,))
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self._settle(key, mark, timed=True)

    def _settle(self, key: tuple, mark: int, timed: bool = False) -> Iterator[Row]:
        settled = self.settled.get() if self.settled.exists() else self.start()
        rows = sorted((tuple(k) + tuple(v) for k, v in self.waiting.iterator()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] < mark]
        for row in ready:
            settled, out = self.fold(key, tuple(settled), row)
            yield from out
            self.waiting.removeKey(row[:2])
        rest, last = rows[len(ready) :], self.last.get()[0]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if timed and not rest and mark >= last + self.keep:
            yield from self.over(key, tuple(settled))
            for state in (self.waiting, self.settled, self.last):
                state.clear()
            return
        self.settled.update(tuple(settled))
        due = rest[0][0] if rest else last + self.keep
        self.handle.registerTimer(max(due, mark) // 1000 + 1)
        if not timed:
            yield from self.now(key, tuple(settled), rest)


class StepStatus(InOrder):
    """The last step of a session's command, and how many pending ones later starts interrupted."""

    WAITING, SETTLED = "status string", "step_id long, status string, interrupted long"
    OUT = "session_id long, command string, step_id long, status string, interrupted long"

    def start(self) -> tuple:
        return None, None, 0

    def fold(self, key: tuple, settled: tuple, row: tuple) -> tuple[tuple, list[Row]]:
        return (row[1], row[2], settled[2] + (settled[1] == "pending")), []

    def now(self, key: tuple, settled: tuple, waiting: list[tuple]) -> list[Row]:
        for row in waiting:
            settled = self.fold(key, settled, row)[0]
        return [Row(session_id=key[0], command=key[1], step_id=settled[0], status=settled[1], interrupted=settled[2])]


class Lifecycle(InOrder):
    """The invocations of a session: each goes out when it has ended, or when another follows it."""

    WAITING, SETTLED = "kind string, exit_code int", "run long, started_at long, closed boolean"
    OUT = "session_id long, run long, started_at timestamp, outcome string, seconds double"

    def start(self) -> tuple:
        return 0, None, True

    def _ended(self, key: tuple, settled: tuple, outcome: str, at: int | None) -> Row:
        return Row(session_id=key[0], run=settled[0], started_at=_moment(settled[1]), outcome=outcome, seconds=None if at is None else (at - settled[1]) / 1e6)

    def fold(self, key: tuple, settled: tuple, row: tuple) -> tuple[tuple, list[Row]]:
        at, _, kind, code = row
        number, started, closed = settled
        if kind == "invoked":
            return (number + 1, at, False), [] if closed else [self._ended(key, settled, "open", None)]
        if kind in ("completed", "failed") and not closed:
            outcome = "ok" if kind == "completed" else "interrupted" if code == 130 else "error"
            return (number, started, True), [self._ended(key, settled, outcome, at)]
        return settled, []

    def over(self, key: tuple, settled: tuple) -> list[Row]:
        return [] if settled[2] else [self._ended(key, settled, "open", None)]


def processed(rows: DataFrame, keys: list[str], processor: InOrder, mode: str) -> DataFrame:
    """What a processor makes of rows with a watermark."""
    needs_rocksdb(rows.sparkSession)
    return rows.groupBy(*keys).transformWithState(processor, processor.OUT, mode, "EventTime")
