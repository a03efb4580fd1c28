"""The ledger as a table that is kept up: a snapshot bucketed by key, and what came since.

A snapshot keeps each key's folded log, bucketed by key. New events are folded and
merged into it bucket by bucket: the snapshot's side of the merge is read as it
lies, without a shuffle, only the events since are dealt to the buckets. Each merge
writes a new version beside the old one; a version is there once its table is
complete, so a merge that dies leaves the last one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import corpus
from textquarry.sources.staging import new_folder

#: What must be known of a key to go on folding: its last event, its last reset, and failures since then.
FOLDED = "sha256 string, at timestamp, seq bigint, event string, reset_at timestamp, reset_seq bigint, attempts bigint"


def folded(events: DataFrame) -> DataFrame:
    """FOLDED of events (sha256, at, seq, event) alone; attempts are failures after the last reset among them."""
    at = F.struct("at", "seq")
    failed = F.col("event").isin(corpus.DOWNLOAD_FAILED, corpus.SCAN_FAILED)
    reset = events.filter("event = 'reset'").groupBy("sha256").agg(F.max(at).alias("_reset"))
    rows = events.join(reset, "sha256", "left")
    one = rows.groupBy("sha256").agg(F.max_by(F.struct("at", "seq", "event"), at).alias("_last"), F.max("_reset").alias("_reset"), F.count_if(failed & (F.col("_reset").isNull() | (at > F.col("_reset")))).alias("attempts"))
    return one.select("sha256", "_last.at", "_last.seq", "_last.event", F.col("_reset.at").alias("reset_at"), F.col("_reset.seq").alias("reset_seq"), "attempts")


class Ledger:
    """A ledger in versions of a bucketed table `name`_v<n>, whose files are below `folder`.

    Events must come in order: none of a delta is older than the key's in the snapshot.
    """

    def __init__(self, spark: SparkSession, name: str = "", folder: str = "", buckets: int = 8):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"ledger_{uuid.uuid4().hex}"
        self.folder = folder or new_folder(spark, "ledger")

    def versions(self) -> list[int]:
        found = (re.fullmatch(rf"{re.escape(self.name)}_v(\d+)", t.name) for t in self.spark.catalog.listTables())
        return sorted(int(m.group(1)) for m in found if m)

    def snapshot(self) -> DataFrame | None:
        versions = self.versions()
        return self.spark.table(f"{self.name}_v{versions[-1]}") if versions else None

    def merged(self, events: DataFrame) -> DataFrame:
        """The snapshot with the events since; the full outer join moves the events alone."""
        new, old = folded(events), self.snapshot()
        if old is None:
            return new
        a, b = old.alias("a"), new.repartition(self.buckets, "sha256").alias("b")
        kept = F.col("b.reset_at").isNull()  # a reset among the new events leaves nothing of older failures
        attempts = F.when(kept, F.coalesce("a.attempts", F.lit(0)) + F.coalesce("b.attempts", F.lit(0))).otherwise(F.col("b.attempts"))
        last = [F.when(F.col("b.event").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("at", "seq", "event")]
        reset = [F.when(kept, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("reset_at", "reset_seq")]
        # the events are dealt to the buckets, however many partitions other shuffles have, and no side is broadcast, so the result lies as the buckets do
        return a.hint("merge").join(b, F.col("a.sha256") == F.col("b.sha256"), "full_outer").select(F.coalesce("a.sha256", "b.sha256").alias("sha256"), *last, *reset, attempts.alias("attempts"))

    def append(self, events: DataFrame) -> None:
        """Merge events into a new version; the last one before it stays for readers that have it open, older ones go."""
        versions = self.versions()
        number = versions[-1] + 1 if versions else 1
        self.merged(events).write.bucketBy(self.buckets, "sha256").sortBy("sha256").format("parquet").option("path", f"{self.folder}/v{number}").mode("overwrite").saveAsTable(f"{self.name}_v{number}")
        for old in versions[:-1]:
            self._drop(old)

    def _drop(self, number: int) -> None:
        self.spark.sql(f"DROP TABLE {self.name}_v{number}")
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{number}")
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def drop(self) -> None:
        for number in self.versions():
            self._drop(number)

    def state(self) -> DataFrame:
        """Current states (sha256, state, attempts), as `corpus.fold` gives them for the whole log."""
        rows = self.snapshot()
        rows = self.spark.createDataFrame([], FOLDED) if rows is None else rows
        return rows.select("sha256", F.when(F.col("event").isin("reset", "enroll"), corpus.PENDING).otherwise(F.col("event")).alias("state"), "attempts")


def export_rows(state: DataFrame, details: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Every row of the ledger with columns of its applications, ordered by hash, for files and analysis."""
    rows = state if details is None else state.join(details.select("sha256", *columns), "sha256", "left")
    return rows.orderBy("sha256")
