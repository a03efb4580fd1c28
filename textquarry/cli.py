"""Commands: python -m textquarry COMMAND. Paths may be in any store that Spark reads and writes.

Nothing is fetched from a network and no credential is tested: packages must be in
place (`corpus download` says which are not), and dispositions of credentials come
from a file.
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import scalars as S
from textquarry.operators import corpus as C
from textquarry.operators import detectors as D
from textquarry.sources import archives, renderers, staging, tables
from textquarry.streaming import runs

# Defaults of the commands.
SAMPLE_TOTAL, SAMPLE_SEED, VALIDATION_SEED, PER_STRATUM, YEARS = 10_000, 20260714, 20260811, 100, "2020-2026"
TARGET_RECALL, BUDGET_GB = 0.85, 20.0


def years(text: str) -> list[int]:
    """Years from '2020-2026' or '2019,2020'."""
    if "-" in text:
        a, b = map(int, text.split("-"))
        return list(range(a, b + 1))
    return [int(x) for x in text.split(",")]


def _results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Applications (with package, file, integration and providers) and findings of all packages below a path; unreadable ones are left out with a word."""
    sources = staging.staged(archives.read_packages(spark, path))
    for r in sources.filter("error is not null").select("app_id", "error").toLocalIterator():
        print(f"skip {r['app_id']}: {r['error']}", file=sys.stderr)
    good = sources.filter("error is null").drop("error")
    found, providers, integration = D.scan(good, keep=staging.staged)
    apps = archives.files(spark, path).join(good.select("app_id").distinct(), "app_id").join(integration.select("app_id", F.col("confirmed")), "app_id", "left").join(providers, "app_id", "left")
    blank = [F.lit(None).cast("string").alias(c) for c in ("package", "version", "version_code", "min_sdk", "target_sdk")]
    out = apps.select("app_id", *blank, "file", F.coalesce("confirmed", F.lit(False)).alias("is_llm_integrated"), F.coalesce("detected_providers", F.array().cast("array<string>")).alias("providers"))
    return staging.staged(out), staging.staged(found)


def _documents(apps: DataFrame, found: DataFrame) -> DataFrame:
    """Each application's result as one document."""
    listed = found.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("detector_idx", "source_idx", "rule_idx", "hit_idx", "kind", "severity", "title", "description", "file_path", "offset", "evidence", "confidence", "provider"))).alias("findings"))
    counts = D.severity_histogram(found)
    return apps.join(listed, "app_id", "left").join(counts, "app_id", "left")


def _show(rows: DataFrame) -> None:
    for r in rows.toLocalIterator():  # a partition at a time, whatever there is
        print("\t".join("" if x is None else str(x) for x in r))


def scan(spark: SparkSession, a: argparse.Namespace) -> None:
    apps, found = _results(spark, a.path)
    if a.format == "json":
        out = _documents(apps, found).select(F.lit("r").alias("slug"), tables.json_report(F.struct("*")).alias("report"))
    elif a.format == "html":
        out = tables.html_report(found).select(F.lit("r").alias("slug"), "report")
    else:
        out = tables.scan_report(apps, found)
    if a.output:
        tables.write_outputs(out, a.output)
    else:
        _show(out.select("report"))


def filter_(spark: SparkSession, a: argparse.Namespace) -> None:
    apps, _ = _results(spark, a.path)
    _show(apps.filter("is_llm_integrated").select("app_id", F.array_join("providers", ","), "file").orderBy("file"))
    n = apps.agg(F.count_if("is_llm_integrated"), F.count("*")).first()
    print(f"{n[0]}/{n[1]} flagged as LLM-integrated")


def pipeline(spark: SparkSession, a: argparse.Namespace) -> None:
    apps, found = _results(spark, a.path)
    apps = apps.filter("is_llm_integrated")
    found = found.join(apps.select("app_id"), "app_id", "left_semi")
    every = _documents(apps, found)
    json = every.select(tables.slug(F.col("package"), F.col("file")).alias("slug"), tables.json_report(F.struct("*")).alias("json"))
    tables.write_outputs(tables.scan_report(apps, found).join(json, "slug"), a.output_dir, every)


def aggregate(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = spark.read.json(f"{a.results_dir.rstrip('/')}/_aggregate")
    rows = docs.select("is_llm_integrated", "providers", F.explode_outer("findings").alias("f"), "app_id").select("app_id", "is_llm_integrated", "f.severity", "f.kind", "f.provider")
    names = {"severity": "severity", "finding_kind": "kind", "provider_secrets": "provider"}
    n = docs.count()
    for label, column in names.items():
        hit = rows.filter("kind = 'secret'") if label == "provider_secrets" else rows
        counts = hit.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count_distinct("app_id").alias("successes")).withColumn("n", F.lit(n))
        tables.write_aggregate(C.with_interval(counts), label, f"{a.output_dir.rstrip('/')}/{label}")


def _frame(spark: SparkSession, path: str, one_a_package: bool = True) -> DataFrame:
    rows = C.ai_candidates(tables.read_index(spark, path))
    rows = C.dedup_by_package(rows) if one_a_package else rows
    dates = F.col("dex_date"), F.col("vt_scan_date"), F.col("added")
    return rows.withColumns({"year": S.year_of(*dates), "date_source": S.date_source(*dates), "store": S.store_stratum(F.col("markets"))})


def corpus_frame(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_frame(_frame(spark, a.index, not a.per_apk), a.output)


def corpus_sample(spark: SparkSession, a: argparse.Namespace) -> None:
    frame = _frame(spark, a.metadata).filter(F.col("year").isin(years(a.years)))
    drawn = C.stratified_sample(staging.staged(frame), a.total, ["year", "store"], "sha256", str(a.seed))
    tables.write_manifest(drawn, a.output)
    _show(tables.read_manifest(spark, a.output).groupBy("year", "store").count().orderBy("year", "store"))


def corpus_download(spark: SparkSession, a: argparse.Namespace) -> None:
    """Which packages of a manifest are not below a folder yet."""
    wanted = tables.read_manifest(spark, a.manifest).select(F.upper("sha256").alias("sha256")).orderBy("sha256")
    wanted = wanted.limit(a.limit) if a.limit else wanted
    there = archives.files(spark, a.output_dir).select(F.upper("app_id").alias("sha256"))
    missing = wanted.join(there, "sha256", "left_anti")
    _show(missing)
    print(f"{missing.count()} of {wanted.count()} are missing; fetch them by your own means", file=sys.stderr)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sha256 string, at timestamp, seq bigint, event string").parquet(path)


def corpus_run(spark: SparkSession, a: argparse.Namespace) -> None:
    manifest = tables.read_manifest(spark, a.manifest).withColumn("sha256", F.lower("sha256"))
    now, number = F.current_timestamp(), int(datetime.now(UTC).timestamp())
    known = _ledger(spark, a.ledger) if tables.exists(spark, a.ledger) else spark.createDataFrame([], "sha256 string, at timestamp, seq bigint, event string")
    new = C.enroll(known, manifest).select("sha256", now.alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit("enroll").alias("event"))
    new.write.mode("append").parquet(a.ledger)
    started = datetime.now(UTC).isoformat(timespec="seconds")
    sources = staging.staged(archives.read_packages(spark, a.staging_dir))
    run = runs.bounded_run(C.fold(_ledger(spark, a.ledger)), manifest, sources, a.limit, keep=staging.staged)
    outcomes, seen = runs.observed(run.outcomes)
    runs.events(outcomes, now, number).write.mode("append").parquet(a.ledger)
    tables.append_findings(run.outcomes.filter("event = 'scanned'"), a.findings)
    run.findings.write.mode("append").json(a.detail_dir)
    if a.keep_apks or a.keep_with_findings or a.keep_negatives:
        runs.retention(run.outcomes, a.keep_apks, a.keep_with_findings, a.keep_negatives, int(a.keep_budget_gb * 1e9)).write.mode("append").json(f"{a.detail_dir.rstrip('/')}-kept")
    runs.run_log(spark, [(number, started, datetime.now(UTC).isoformat(timespec="seconds"), a.note)]).write.mode("append").json(f"{a.ledger.rstrip('/')}-runs")
    print(", ".join(f"{k}={v}" for k, v in seen.get.items()))


def corpus_retry(spark: SparkSession, a: argparse.Namespace) -> None:
    states = (C.DOWNLOAD_FAILED, C.SCAN_FAILED, *([C.SCANNED] if a.rescan else []))
    events = staging.staged(C.reset_events(C.fold(_ledger(spark, a.ledger)), F.current_timestamp(), states))
    if a.yes:
        events.write.mode("append").parquet(a.ledger)
    print(f"{events.count()} applications {'are' if a.yes else 'would be'} pending again")


def corpus_status(spark: SparkSession, a: argparse.Namespace) -> None:
    _show(C.fold(_ledger(spark, a.ledger)).groupBy("state").count().orderBy(F.desc("count"), "state"))


def validate_sample(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = C.latest(tables.read_findings(spark, a.findings), "sha256", ["n_findings"])
    drawn = staging.staged(C.validation_sample(rows, "llm_integrated", "sha256", a.per_stratum, str(a.seed)))
    out = a.output_dir.rstrip("/")
    tables.worksheet(C.blind_order(drawn, "sha256", str(a.seed))).write.mode("overwrite").csv(f"{out}/sample_labels", header=True)
    tables.answer_key(drawn).write.mode("overwrite").csv(f"{out}/sample_key", header=True)
    _show(drawn.groupBy("llm_integrated", "is_short").count())


def validate_credentials(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = tables.read_credentials(spark, a.staging)
    known = spark.read.schema("provider string, fingerprint string, valid boolean, note string").json(a.dispositions) if a.dispositions else spark.createDataFrame([], "provider string, fingerprint string, valid boolean, note string")
    out = staging.staged(C.attach_dispositions(rows, known))
    _show(renderers.credential_text(out, C.credential_summary(out)))


def validate_score(spark: SparkSession, a: argparse.Namespace) -> None:
    labels = C.latest(tables.read_labels(spark, a.labels), "apk_sha256", ["labelled_at"]).select(F.upper("apk_sha256").alias("sha256"), F.col("is_llm_integrated").alias("truth"))
    key = spark.read.csv(a.key, header=True).select(F.upper("sha256").alias("sha256"), tables.truthy(F.col("llm_integrated")).alias("flag"))
    counts = staging.staged(C.confusion(key.join(labels, "sha256"), "flag", "truth"))
    _show(renderers.confusion_text(counts))
    recall = counts.first()["recall"]
    print(f"recall {'meets' if recall >= TARGET_RECALL else 'is below'} {TARGET_RECALL:.0%}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("textquarry", description=__doc__)
    top.add_argument("--master", help="Spark master, if none is set")
    groups = top.add_subparsers(required=True)

    def command(where, name: str, run, **options) -> argparse.ArgumentParser:
        c = where.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        c.set_defaults(run=run)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is True or default is False:
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, default=None if default is None or isinstance(default, type) else default, required=default is str, type=type(default) if isinstance(default, (int, float)) else int if default is int else str)
        return c

    c = command(groups, "scan", scan, output=None)
    c.add_argument("path")
    c.add_argument("--format", choices=["json", "md", "html"], default="md")
    command(groups, "filter", filter_).add_argument("path")
    command(groups, "pipeline", pipeline, output_dir=str).add_argument("path")
    command(groups, "aggregate", aggregate, output_dir=str).add_argument("results_dir")
    own = groups.add_parser("corpus").add_subparsers(required=True)
    command(own, "frame", corpus_frame, index=str, output="corpus/frame", per_apk=False)
    command(own, "sample", corpus_sample, metadata=str, total=SAMPLE_TOTAL, seed=SAMPLE_SEED, years=YEARS, output="corpus/manifest")
    command(own, "download", corpus_download, manifest="corpus/manifest", output_dir="corpus/apks", limit=int)
    command(own, "run", corpus_run, manifest=str, ledger="corpus/ledger", limit=int, keep_apks=False, keep_with_findings=False, keep_negatives=0, keep_budget_gb=BUDGET_GB, findings="results/findings", detail_dir="results/detail", staging_dir="corpus/staging", note="")
    command(own, "retry", corpus_retry, ledger="corpus/ledger", rescan=False, yes=False)
    command(own, "status", corpus_status, ledger="corpus/ledger")
    own = groups.add_parser("validate").add_subparsers(required=True)
    command(own, "sample", validate_sample, findings="results/findings", per_stratum=PER_STRATUM, seed=VALIDATION_SEED, output_dir="validation")
    command(own, "credentials", validate_credentials, staging=str, dispositions=None)
    command(own, "score", validate_score, labels=str, key=str)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("textquarry").config("spark.sql.session.timeZone", "UTC")
        spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    a.run(spark, a)
    return 0
