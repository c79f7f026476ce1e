"""Status streams that begin where a batch table ends.

They run on ``transformWithState``: state is in RocksDB, so it need not fit the memory of an
executor, every file has timers of its own, and the first micro-batch takes over the state
that a batch computes from the history. A stream over all rows and a stream over the newer
rows that begins with a snapshot of the older ones give the same rows.

All take log rows (id, drive_file_id, status, timestamp); history is a batch DataFrame or
None. The rows of one file in one micro-batch are sorted in a task, so a micro-batch bounds
what a task holds (see ``feeds.read_events``). Start the streams within ``rocks_db``.

Defined results: rows that repeat are taken one by one; rows without a status are never being
processed; an empty history is as none; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; later ones as before."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def _newest(logs: DataFrame) -> DataFrame:
    """One row for each file: the last by time and id; a row without a time counts as newest."""
    order = F.struct(F.col("timestamp").isNull().alias("none"), F.coalesce(F.unix_micros("timestamp"), F.lit(0)).alias("at"), "id", "status")
    return logs.groupBy("drive_file_id").agg(F.max(order).alias("x")).select("drive_file_id", "x.*")


class _Timed(StatefulProcessor):
    """One state value and at most one timer for each file."""

    def __init__(self, name: str, fields: str):
        self.name, self.fields = name, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(self.name, self.fields)

    def known(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def keep(self, value: tuple | None, due: int | None) -> None:
        """Replace state and timer; ``due`` is the millisecond that the watermark has to pass."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if value is None:
            self.state.clear()
            return
        self.state.update(value)
        if due is not None:
            self.handle.registerTimer(due + 1)

    def close(self) -> None:
        pass


class _Stuck(_Timed):
    def __init__(self, limit: int):
        super().__init__("since", "at bigint")
        self.limit = limit

    def _watch(self, since: int | None) -> None:
        self.keep(None if since is None else (since,), None if since is None else (since + self.limit) // 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._watch(initialState["at"] if initialState["status"] == "processing" else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = old = (self.known() or (None,))[0]
        for at, _, status in sorted(((r["at"], r["id"], r["status"]) for r in rows), key=lambda x: x[:2]):
            if last is not None and at < last:
                continue
            if last is not None and at > last + self.limit:
                yield Row(drive_file_id=key[0], since=last)
            last = at if status == "processing" else None
        if last != old:
            self._watch(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        since = self.known()
        self.state.clear()
        if since is not None:
            yield Row(drive_file_id=key[0], since=since[0])


class _Latest(_Timed):
    def __init__(self):
        super().__init__("newest", "none boolean, at bigint, id bigint, status string")

    def _hold(self, best: tuple) -> None:
        # once the watermark has passed the newest row, what may still come is newer
        self.keep(best, None if best[0] else best[1] // 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._hold(tuple(initialState[c] for c in ("none", "at", "id", "status")))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.known()
        new = max(((r["none"], r["at"], r["id"], r["status"]) for r in rows), key=lambda x: x[:3])
        if old is None or new[:3] > old[:3]:
            self._hold(new)
            yield Row(drive_file_id=key[0], id=new[2], status=new[3], at=None if new[0] else new[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        yield from ()


def _begin(rows: DataFrame, processor: StatefulProcessor, fields: str, mode: str, history: DataFrame | None) -> DataFrame:
    first = None if history is None else _newest(history).groupBy("drive_file_id")
    return rows.groupBy("drive_file_id").transformWithState(processor, fields, mode, "eventTime", initialState=first)


def stuck(logs: DataFrame, history: DataFrame | None = None, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """A row for each time a file was being processed for the limit without another update.

    With a history, only what ends or runs out in the stream is given; ``stuck_before`` gives
    the rest. Rows without a time are passed over. Use append mode.
    """
    rows = logs.filter("timestamp is not null").withWatermark("timestamp", late)
    rows = rows.select("drive_file_id", "timestamp", "id", "status", F.unix_micros("timestamp").alias("at"))
    past = None if history is None else history.filter("timestamp is not null")
    found = _begin(rows, _Stuck(minutes * 60_000_000), "drive_file_id string, since bigint", "append", past)
    return found.select("drive_file_id", F.timestamp_micros("since").alias("since"))


def stuck_before(history: DataFrame, minutes: int = 15) -> DataFrame:
    """The same rows of a history alone: those that a later row of it ended; the open ones are left to the stream."""
    w = Window.partitionBy("drive_file_id").orderBy("timestamp", "id")
    timed = history.filter("timestamp is not null").select("drive_file_id", "timestamp", "status", F.lead("timestamp").over(w).alias("later"))
    ended = (F.col("status") == "processing") & (F.col("later") > F.col("timestamp") + F.make_dt_interval(mins=F.lit(minutes)))
    return timed.filter(ended).select("drive_file_id", F.col("timestamp").alias("since"))


def latest_status(logs: DataFrame, history: DataFrame | None = None, late: str = "30 days") -> DataFrame:
    """Status of the newest log row of every file that the stream changes; use update mode.

    A row without a time counts as newest and ties go to the larger id. A file that has been
    silent for as long as the watermark is late leaves the state; one whose newest row has no time stays.
    """
    rows = logs.withWatermark("timestamp", late).select(
        "drive_file_id", "timestamp", "id", "status", F.col("timestamp").isNull().alias("none"),
        F.coalesce(F.unix_micros("timestamp"), F.lit(0)).alias("at"),
    )
    found = _begin(rows, _Latest(), "drive_file_id string, id bigint, status string, at bigint", "update", history)
    return found.select("drive_file_id", "id", "status", F.timestamp_micros("at").alias("timestamp"))
