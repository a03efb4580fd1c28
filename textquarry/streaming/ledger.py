"""Bounded scanning of arriving packages as a stream, with an idempotent ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import corpus, detectors


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Arriving Parquet files of sources; the number taken at a time is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scan_stream(stream: DataFrame, ledger_path: str, findings_path: str, checkpoint: str, scan: Callable[[DataFrame], DataFrame] | None = None):
    """Scan what arrives, once per application: a batch leaves out applications that the ledger has as scanned.

    A batch's findings and ledger events are written to folders named by the
    batch's number, so a batch that runs again after a failure replaces its own.
    """
    scan = scan or (lambda sources: detectors.scan(sources)[0])

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = _ledger(spark, ledger_path).filter(F.col("_batch") != number).filter("event = 'scanned'").select(F.col("sha256").alias("app_id"))
        new = rows.join(done, "app_id", "left_anti")
        scan(new).write.mode("overwrite").parquet(f"{findings_path}/_batch={number}")
        events = new.select(F.col("app_id").alias("sha256")).distinct().select("sha256", F.current_timestamp().alias("at"), F.lit(number).cast("bigint").alias("seq"), F.lit(corpus.SCANNED).alias("event"))
        events.write.mode("overwrite").parquet(f"{ledger_path}/_batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = "sha256 string, at timestamp, seq bigint, event string, _batch bigint"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def event_counts(stream: DataFrame, key: str, at: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key with a watermark (an extension: the behaviour to match has no event time)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))
