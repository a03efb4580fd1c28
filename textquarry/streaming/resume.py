"""Runs that can be stopped and repeated: batches of applications, findings keyed by (application, run), events as commit marks.

A batch writes its findings first and its ledger events last, each to a folder
named by run and batch, which a repetition replaces. So a batch that died has no
events: its applications are still pending, and what it wrote of their findings
counts for nothing until it is repeated, in that run or a later one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import corpus

EVENTS = "sha256 string, at timestamp, seq bigint, event string, error string, run bigint, batch bigint"
#: Reads one application's payload; what it raises is that application's error.
Reader = Callable[[bytes], str]


def guarded(packages: DataFrame, read: Reader, columns: tuple[str, ...] = ("app_id", "source_idx", "source_file")) -> DataFrame:
    """content and error of each row's payload: a reader that raises fails its own row alone; the task and the other rows go on."""
    names = [*columns, "payload"]
    schema = packages.select(*columns).schema.add("content", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, error = [], []
            for payload in batch.column("payload").to_pylist():
                try:
                    content.append(read(payload))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  a poisoned package may raise anything
                    content.append(None)
                    error.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(content, pa.string()), pa.array(error, pa.string())], [*columns, "content", "error"])

    return packages.select(*names).mapInArrow(run, schema)


def inflate(payload: bytes) -> str:
    """The reader of zlib streams of UTF-8 text."""
    return zlib.decompress(payload).decode()


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """What runs have written below path, with the folders' run and batch; no rows if there is nothing."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, f"{folder}/events", EVENTS)


def findings(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The findings of committed batches: of each application those of the last run whose events have it as scanned."""
    done = events(spark, folder).filter(F.col("event") == corpus.SCANNED).groupBy(F.col("sha256").alias("app_id")).agg(F.max("run").alias("run"))
    return _table(spark, f"{folder}/findings", f"{schema}, run bigint, batch bigint").join(done, ["app_id", "run"], "left_semi")


def run(ledger: DataFrame, packages: DataFrame, folder: str, number: int, scan: Callable[[DataFrame], DataFrame], read: Reader, batches: int = 4, only: tuple[int, ...] | None = None, bucket: Column | None = None, most_attempts: int = corpus.MOST_ATTEMPTS) -> None:
    """Scan a ledger's pending applications (sha256, state, attempts) in batches by hash (or a `bucket` of app_id), all or `only` some of them.

    packages(app_id, source_idx, source_file, payload). Whatever stops a batch
    leaves the batches before it committed; running it again replaces its rows.
    """
    wanted = ledger.filter((F.col("state") != corpus.SCANNED) & (F.col("attempts") < most_attempts)).select(F.col("sha256").alias("app_id"))
    bucket = F.pmod(F.xxhash64("app_id"), F.lit(batches)) if bucket is None else bucket
    for k in range(batches) if only is None else only:
        mine = wanted.filter(bucket == k)
        came = guarded(packages.filter(bucket == k).join(mine, "app_id", "left_semi"), read)
        outcome = came.groupBy("app_id").agg(F.max("error").alias("error"))
        good = came.join(outcome.filter("error is null"), "app_id", "left_semi").drop("error")
        place = f"run={number}/batch={k}"
        scan(good).write.mode("overwrite").parquet(f"{folder}/findings/{place}")
        event = F.when(F.col("_came").isNull(), corpus.DOWNLOAD_FAILED).when(F.col("error").isNotNull(), corpus.SCAN_FAILED).otherwise(corpus.SCANNED)
        rows = mine.join(outcome.withColumn("_came", F.lit(True)), "app_id", "left").select(F.col("app_id").alias("sha256"), F.current_timestamp().alias("at"), F.lit(number).cast("bigint").alias("seq"), event.alias("event"), "error")
        rows.write.mode("overwrite").parquet(f"{folder}/events/{place}")


def state(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The ledger after all committed batches: applications of a manifest (sha256) with state and attempts, pending if no event is theirs."""
    folded = corpus.fold(events(spark, folder).select("sha256", "at", "seq", "event"))
    return manifest.select("sha256").join(folded, "sha256", "left").select("sha256", F.coalesce("state", F.lit(corpus.PENDING)).alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"))
