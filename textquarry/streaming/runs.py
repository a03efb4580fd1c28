"""Bounded runs over a manifest: one outcome for each application, run log, totals and retention.

A run takes what the ledger has as pending, scans the sources that arrived and
gives each application exactly one terminal event. An archive that can't be read
is a failed scan of that application alone, one without sources a failed
download; a lost executor is no outcome, as Spark runs its tasks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import corpus, detectors


@dataclass
class Run:
    """findings of the scanned applications; outcomes(sha256, event, error, bytes, n_findings, llm_integrated, providers) of all that were wanted."""

    findings: DataFrame
    outcomes: DataFrame


def scan_applications(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return detectors.scan(sources)


def bounded_run(ledger: DataFrame, manifest: DataFrame, sources: DataFrame, limit: int | None = None, scan: Callable = scan_applications, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Run:
    """Scan the pending applications of a manifest (sha256, apk_size), at most `limit` of them by hash.

    sources(app_id, source_idx, source_file, content, error) is what arrived; an
    application with an error in any row has failed. keep() stages tables that are
    used more than once.
    """
    wanted = keep(manifest.select("sha256", F.col("apk_size").alias("bytes")).join(corpus.pending(ledger, limit).select("sha256"), "sha256", "left_semi"))
    came = keep(sources.groupBy(F.col("app_id").alias("sha256")).agg(F.max("error").alias("error")).join(wanted.select("sha256"), "sha256", "left_semi"))
    good = sources.join(came.filter("error is null").select(F.col("sha256").alias("app_id")), "app_id", "left_semi").drop("error")
    found, providers, integration = scan(good)
    found = keep(found)
    n = found.groupBy(F.col("app_id").alias("sha256")).agg(F.count("*").alias("n_findings"))
    flags = integration.select(F.col("app_id").alias("sha256"), F.col("confirmed").alias("llm_integrated"))
    names = providers.select(F.col("app_id").alias("sha256"), F.col("detected_providers").alias("providers"))
    event = F.when(F.col("_came").isNull(), corpus.DOWNLOAD_FAILED).when(F.col("error").isNotNull(), corpus.SCAN_FAILED).otherwise(corpus.SCANNED)
    all_ = wanted.join(came.withColumn("_came", F.lit(True)), "sha256", "left").withColumn("event", event).join(n, "sha256", "left").join(flags, "sha256", "left").join(names, "sha256", "left")
    done = F.col("event") == corpus.SCANNED
    outcomes = all_.select(
        "sha256", "event", "error", F.when(F.col("event") != corpus.DOWNLOAD_FAILED, F.col("bytes")).otherwise(0).alias("bytes"), F.when(done, F.coalesce("n_findings", F.lit(0))).alias("n_findings"),
        F.when(done, F.coalesce("llm_integrated", F.lit(False))).alias("llm_integrated"), F.coalesce("providers", F.array().cast("array<string>")).alias("providers"),
    )
    return Run(found, keep(outcomes))


def events(outcomes: DataFrame, at, run: int) -> DataFrame:
    """The ledger's rows of a run (sha256, at, seq, event)."""
    return outcomes.select("sha256", at.alias("at"), F.lit(run).cast("bigint").alias("seq"), "event")


def totals() -> list:
    """Aggregates over outcomes that make the report of a run."""
    done = F.col("event") == corpus.SCANNED
    return [
        F.count_if(done).alias("scanned"), F.count_if(F.col("llm_integrated")).alias("llm_integrated"), F.count_if(F.col("event") == corpus.DOWNLOAD_FAILED).alias("download_failed"),
        F.count_if(F.col("event") == corpus.SCAN_FAILED).alias("scan_failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_downloaded"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"),
    ]


def observed(outcomes: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """outcomes with their totals observed while something else writes them."""
    seen = Observation(name)
    return outcomes.observe(seen, *totals()), seen


def run_log(spark: SparkSession, rows: list[tuple[int, str, str | None, str]]) -> DataFrame:
    """Starts and ends of runs as an append-only log (id, started_at, finished_at, note)."""
    return spark.createDataFrame(rows, "id bigint, started_at string, finished_at string, note string")


def runs(log: DataFrame) -> DataFrame:
    """One row a run from its log: the start, the end if there is one, the first note."""
    return log.groupBy("id").agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.min_by("note", "started_at").alias("note"))


KEPT = "sha256 string, bytes bigint, kept boolean, reason string"


def retention(outcomes: DataFrame, keep_all: bool = False, keep_with_findings: bool = True, keep_negatives: int = 0, budget: int = 0, used: int = 0) -> DataFrame:
    """Which packages stay, in order of their hash: rows (sha256, bytes, kept, reason).

    Scanned applications with findings or integrated ones stay while the budget
    has room (0: no bound; `used` bytes are taken already); one that doesn't fit is
    passed over, and a later smaller one may fit. Others stay as negatives, up to
    keep_negatives of them, from the same budget. Failed ones don't, unless all do.
    Each decision depends on all before, so the rows (a few bytes each) stream
    through one task in order; nothing is held but the sums.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, negatives = used, 0
        for batch in batches:
            sha, size, kept, why = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for b, done, n, llm in zip(size, *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                positive = keep_with_findings and done and (n > 0 or llm)
                negative = not positive and done and n == 0 and negatives < keep_negatives
                fits = not budget or total + (b or 0) <= budget
                stays = keep_all or (positive or negative) and fits
                if (positive or negative) and fits:
                    total += b or 0
                    negatives += negative
                kept.append(bool(stays))
                why.append("all" if keep_all else "budget" if (positive or negative) and not fits else "finding" if positive else "negative" if negative else "none")
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.string()), pa.array(size, pa.int64()), pa.array(kept, pa.bool_()), pa.array(why, pa.string())], ["sha256", "bytes", "kept", "reason"])

    rows = outcomes.select("sha256", F.col("bytes").cast("bigint").alias("bytes"), (F.col("event") == corpus.SCANNED).alias("done"), F.coalesce("n_findings", F.lit(0)).alias("n"), F.coalesce("llm_integrated", F.lit(False)).alias("llm"))
    return rows.repartition(1).sortWithinPartitions("sha256").mapInArrow(fold, KEPT)
