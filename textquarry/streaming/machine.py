"""The ledger's state machine as a stream: state by application, illegal transitions rejected, failed attempts retried by timers.

Events arrive in files; state lives in the stream's state store, so what has been
decided is never read again, and a query that is stopped goes on from its
checkpoint. A failed application goes back to pending when `retry_after` has passed
in event time, as long as it has attempts left: at its next event, or by a timer
when the watermark gets there. Both give the same row, so the output doesn't depend
on how events are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textquarry.operators.corpus import DOWNLOAD_FAILED, DOWNLOADED, MOST_ATTEMPTS, PENDING, SCAN_FAILED, SCANNED

RESET, RETRY = "reset", "retry"
#: Which events each state takes.
LEGAL = {PENDING: (DOWNLOADED, DOWNLOAD_FAILED), DOWNLOADED: (SCANNED, SCAN_FAILED), DOWNLOAD_FAILED: (RESET,), SCAN_FAILED: (RESET,), SCANNED: ()}
FAILED = (DOWNLOAD_FAILED, SCAN_FAILED)
#: One row an event or retry: the state before and after it, failures so far, and whether it was legal. A rejected event changes nothing.
TRANSITION = "sha256 string, at timestamp, seq bigint, event string, before string, state string, attempts bigint, accepted boolean"
_GIVEN = TRANSITION.replace("at timestamp", "us bigint")  # whatever the session's time zone
_MADE = Row(*[x.split()[0] for x in _GIVEN.split(", ")])


class Machine:
    """One application's state; times are microseconds."""

    def __init__(self, state: str = PENDING, attempts: int = 0, failed_at: int = -1, retry_after: int = 0, most: int = MOST_ATTEMPTS):
        self.state, self.attempts, self.failed_at, self.retry_after, self.most = state, attempts, failed_at, retry_after, most

    def due(self) -> int | None:
        """When the application goes back to pending, if it does."""
        return self.failed_at + self.retry_after if self.state in FAILED and self.attempts < self.most else None

    def retry(self) -> tuple:
        before, at, self.state = self.state, self.due(), PENDING
        return at, None, RETRY, before, PENDING, self.attempts, True

    def take(self, at: int, seq: int, event: str) -> tuple:
        before, legal = self.state, event in LEGAL[self.state]
        if legal:
            self.state = PENDING if event == RESET else event
            self.attempts = 0 if event == RESET else self.attempts + (event in FAILED)
            self.failed_at = at if event in FAILED else -1
        return at, seq, event, before, self.state, self.attempts, legal


class Processor(StatefulProcessor):
    """Takes and gives rows: a data frame for each application and trigger costs more than all else."""

    def __init__(self, retry_after: int, most: int):
        self.retry_after, self.most = retry_after, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("machine", "state string, attempts bigint, failed_at bigint")

    def _machine(self) -> Machine:
        return Machine(*(self.kept.get() or (PENDING, 0, -1)), self.retry_after, self.most)

    def _keep(self, machine: Machine, due: int | None) -> None:
        """Store the state; `due` is when the timer that was set before fires."""
        self.kept.update((machine.state, machine.attempts, machine.failed_at))
        if due != machine.due():
            if due is not None:
                self.handle.deleteTimer(-(-due // 1000))
            if machine.due() is not None:
                self.handle.registerTimer(-(-machine.due() // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        machine = self._machine()
        set_before = machine.due()
        for at, seq, event in sorted((r["us"], r["seq"], r["event"]) for r in rows):  # what one trigger takes of one application
            if machine.due() is not None and at >= machine.due():
                yield _MADE(key[0], *machine.retry())
            yield _MADE(key[0], *machine.take(at, seq, event))
        self._keep(machine, set_before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        machine = self._machine()
        if machine.due() is not None and -(-machine.due() // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            row = machine.retry()
            self.kept.update((machine.state, machine.attempts, machine.failed_at))
            yield _MADE(key[0], *row)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, retry_after: str = "6 hours", late: str = "1 hour", most: int = MOST_ATTEMPTS) -> DataFrame:
    """Transitions (TRANSITION) of a stream of events (sha256, at, seq, event). The session's state store must be RocksDB's (`stores`)."""
    micros = int(pd.Timedelta(retry_after).total_seconds() * 1_000_000)
    rows = events.select("sha256", F.col("at").cast("timestamp").alias("at"), "seq", "event").withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    out = rows.groupBy("sha256").transformWithState(Processor(micros, most), outputStructType=_GIVEN, outputMode="Append", timeMode="EventTime")
    return out.withColumn("at", F.timestamp_micros("us")).select(*[x.split()[0] for x in TRANSITION.split(", ")])


def stores(spark) -> None:
    """Keep state in RocksDB, which timers and typed state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write(events: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Take what has arrived, write its transitions below `path` and stop; the next call goes on from the checkpoint."""
    stores(events.sparkSession)
    transitions(events, **options).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(done: DataFrame) -> DataFrame:
    """The state that written transitions leave each application in."""
    order = F.struct("at", F.col("seq").isNotNull(), "seq")
    return done.groupBy("sha256").agg(F.max_by("state", order).alias("state"), F.max_by("attempts", order).alias("attempts"), F.count_if(~F.col("accepted")).alias("rejected"))
