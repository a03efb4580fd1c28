"""Readers and writers of indexes, frames, manifests, findings, labels and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry import rules
from textquarry.functions import scalars as S
from textquarry.operators import corpus

INDEX = "sha256 string, sha1 string, md5 string, dex_date string, apk_size string, pkg_name string, vercode string, vt_detection string, vt_scan_date string, dex_size string, markets string, added string"
FRAME = ["sha256", "pkg_name", "year", "date_source", "store", "vercode", "markets", "apk_size", "signals"]
MANIFEST = ["sha256", "pkg_name", "year", "store", "vercode", "markets", "apk_size"]
FINDINGS = "sha256 string, pkg_name string, version string, year int, store string, apk_size bigint, llm_integrated boolean, providers array<string>, n_findings bigint, by_severity map<string,bigint>, scan_seconds double"
LABELS = "apk_sha256 string, apk_path string, is_llm_integrated boolean, notes string, labelled_at string, labeller string"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _size(c: str = "apk_size") -> Column:
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c)).try_cast("bigint")


def _or_null(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index in CSV (gzip too, which is one split: filter first, then repartition). Rows without a hash go; blank fields are null but for names and markets."""
    raw = spark.read.csv(path, header=True, schema=INDEX, encoding="UTF-8", enforceSchema=False)
    out = raw.select(F.trim("sha256").alias("sha256"), F.coalesce(F.trim("pkg_name"), F.lit("")).alias("pkg_name"), F.coalesce(F.trim("markets"), F.lit("")).alias("markets"), *[_or_null(c).alias(c) for c in ("dex_date", "vt_scan_date", "added", "vercode")], _size().alias("apk_size"))
    return out.filter(F.col("sha256").isNotNull() & (F.col("sha256") != ""))


def index_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an index with signals in their names. A gzipped file is one split, so the few rows that stay are dealt out again."""
    rows = corpus.ai_candidates(read_index(spark, path))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sha256")


def write_frame(frame: DataFrame, path: str) -> None:
    """Frame rows with signals joined by |; nulls are empty."""
    out = frame.withColumn("signals", F.array_join("signals", "|"))
    out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FRAME]).write.mode("overwrite").csv(path, header=True, emptyValue="")


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    """A frame as written; the stored date source is kept."""
    raw = spark.read.csv(path, header=True)
    return raw.withColumns({"year": F.col("year").try_cast("int"), "apk_size": _size(), "signals": F.when(F.coalesce("signals", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("signals", r"\|"))})


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MANIFEST]).write.mode("overwrite").csv(path, header=True, emptyValue="")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.withColumns({"year": F.col("year").try_cast("int"), "apk_size": _size(), "store": S.store_stratum(F.coalesce("markets", F.lit("")))})


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=FINDINGS).filter("sha256 is not null")


def append_findings(rows: DataFrame, path: str, detail: DataFrame | None = None, detail_path: str | None = None) -> None:
    """One JSON line per application; details only of integrated ones or those with findings."""
    rows.write.mode("append").json(path)
    if detail is not None and detail_path:
        detail.filter(F.col("llm_integrated") | (F.col("n_findings") > 0)).write.mode("append").option("compression", "gzip").json(detail_path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels, none if the file is missing."""
    return spark.read.json(path, schema=LABELS) if exists(spark, path) else spark.createDataFrame([], LABELS)


def append_labels(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result documents, one a file; names that begin with _ are skipped."""
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return spark.read.option("multiLine", True).schema(schema).json(path).withColumn("_name", name).filter(~F.col("_name").startswith("_")).drop("_name")


def read_details(spark: SparkSession, path: str, ids: DataFrame, schema: str) -> DataFrame:
    """Details of the applications in ids (app_id), by the names of their files, or of their folders if they were written by application."""
    at = F.col("_metadata.file_path")
    name = F.lower(F.coalesce(F.nullif(F.regexp_extract(at, r"/app_id=([^/]+)/[^/]+$", 1), F.lit("")), F.regexp_extract(at, r"([^/]+)\.json\.gz$", 1)))
    return spark.read.schema(schema).json(path).withColumn("app_id", name).join(ids.select(F.lower("app_id").alias("app_id")), "app_id", "left_semi")


def write_details(rows: DataFrame, path: str) -> None:
    """Gzipped details by application (app_id and more)."""
    rows.write.mode("overwrite").partitionBy("app_id").option("compression", "gzip").json(path)


def read_credentials(spark: SparkSession, path: str) -> DataFrame:
    """Credentials staged as CSV (provider, key, sha256, package); those of unknown providers go, and a key is a fingerprint from here on."""
    known = spark.createDataFrame([(p,) for p in rules.PROVIDERS], "provider string")
    rows = spark.read.csv(path, header=True).join(F.broadcast(known), "provider")
    return rows.select("provider", S.fingerprint(F.col("key")).alias("fingerprint"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("sha256", "package")])


def truthy(c: Column) -> Column:
    return F.lower(c).isin("true", "1", "yes")


def worksheet(sample: DataFrame) -> DataFrame:
    """The coder's view: no prediction in it."""
    return sample.select("sha256", "pkg_name", "version", "apk_size")


def answer_key(sample: DataFrame) -> DataFrame:
    return sample.select("sha256", "pkg_name", "llm_integrated", F.array_join("providers", "|").alias("providers"), "n_findings")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (file, split, row, value) of text files that are appended to, in whatever way Spark cuts and orders them.

    file orders files by time and name, split is where a part of a file begins, row
    counts up within a part; together they are the order of the lines.
    """
    at = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path"))
    return spark.read.text(path).select(at.alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")


def last_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last JSON line of each key over all files of a log; lines that can't be parsed and those without a key are none."""
    parsed = lines(spark, path).withColumn("_r", F.from_json("value", schema)).filter(F.col(f"_r.{key}").isNotNull())
    return parsed.groupBy(F.col(f"_r.{key}").alias("_key")).agg(F.max_by("_r", F.struct("file", "split", "row")).alias("_last")).select("_last.*")


#: A verdict's line: package, findings, flag, verdict. Whatever holds the mark opens a block.
AUDIT_LINE, AUDIT_MARK = r"^(\S+)\s+\[scanner: (\d+) findings, llm=([01])\]\s+(.*)$", "[scanner:"


def audit_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of an audit transcript: a row (block, package, n_findings, llm, verdict, n_details) for each line that opens one, with the number of lines below it.

    A block's number is the running count of openings: counted within parts of a
    file, and added up over the parts before. Openings that can't be read have no package.
    """
    rows = lines(spark, path).withColumn("opens", F.col("value").contains(AUDIT_MARK).cast("bigint"))
    sums = rows.groupBy("file", "split").agg(F.sum("opens").alias("_own"))  # one row a part
    before = sums.select("file", "split", (F.sum("_own").over(W.orderBy("file", "split")) - F.col("_own")).alias("_before"))
    within = F.sum("opens").over(W.partitionBy("file", "split").orderBy("row"))
    numbered = rows.withColumn("_within", within).join(F.broadcast(before), ["file", "split"]).withColumn("block", F.col("_before") + F.col("_within")).filter("block > 0")
    part = lambda k: F.regexp_extract("opening", AUDIT_LINE, k)
    blocks = numbered.groupBy("block").agg(F.max(F.when(F.col("opens") == 1, F.col("value"))).alias("opening"), F.count_if((F.col("opens") == 0) & (F.trim("value") != "")).alias("n_details"))
    return blocks.select("block", F.nullif(part(1), F.lit("")).alias("package"), part(2).try_cast("int").alias("n_findings"), (part(3) == "1").alias("llm"), part(4).alias("verdict"), "n_details")


def audit_tally(blocks: DataFrame) -> DataFrame:
    """Verdicts counted, one row. They must add up to the blocks, or the plan fails: an opening without a readable verdict is in none of them."""
    read, verdict = F.col("package").isNotNull(), F.col("verdict")
    empty, agree = verdict.contains("SCANNER SAID EMPTY"), verdict.contains("AGREE")
    one = blocks.agg(F.count("*").alias("audited"), F.count_if("llm").alias("llm_audited"), F.count_if(read & empty).alias("empty_but_signal"), F.count_if(read & ~empty & agree).alias("agree"), F.count_if(read & ~empty & ~agree).alias("weak"))
    whole = F.col("empty_but_signal") + F.col("agree") + F.col("weak")
    return one.withColumn("audited", F.when(whole == F.col("audited"), F.col("audited")).otherwise(F.raise_error(F.format_string("verdicts %d of %d audited", whole, "audited")).cast("bigint")))


# --- reports ----------------------------------------------------------------------------------------------------------------------


def json_report(result: Column) -> Column:
    return F.to_json(result, {"pretty": "true"})


def markdown_report(findings: DataFrame) -> DataFrame:
    """One Markdown text per application, findings by severity from critical to info, evidence redacted."""
    order = F.array_position(F.array(*map(F.lit, ["critical", "high", "medium", "low", "info"])), F.col("severity"))
    line = F.format_string("- **%s** %s (%s, confidence %.2f): `%s`", "severity", "title", F.coalesce("provider", F.lit("-")), "confidence", S.redact(F.col("evidence"), 80))
    lines = findings.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "title", line.alias("line")))).alias("l"), F.count("*").alias("n"))
    return lines.select("app_id", F.concat(F.format_string("# %s\n\n%d findings\n\n", "app_id", "n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("report"))


def html_report(findings: DataFrame) -> DataFrame:
    """One self-contained page per application; everything is escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), S.html_escape(c), F.lit("</td>"))
    bar = F.concat(F.lit('<td><div style="width:'), F.floor(F.col("confidence") * 100).cast("string"), F.lit('%;background:#888">&nbsp;</div></td>'))
    row = F.concat(F.lit("<tr>"), cell(F.col("severity")), cell(F.col("title")), cell(F.coalesce("provider", F.lit(""))), cell(S.redact(F.col("evidence"), 120)), bar, F.lit("</tr>"))
    rows = findings.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("severity", "title", row.alias("row")))).alias("r"))
    page = F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), S.html_escape(F.col("app_id")), F.lit("</title><table>"), F.array_join(F.transform("r", lambda x: x["row"]), ""), F.lit("</table>"))
    return rows.select("app_id", page.alias("report"))


def aggregate_lines(stats: DataFrame, kind: str) -> DataFrame:
    """Statistics in long form with four decimals, as for CSV."""
    four = lambda c: F.format_string("%.4f", F.col(c))
    return stats.select(F.lit(kind).alias("category_kind"), "category", "successes", "n", four("proportion").alias("proportion"), four("ci_lower").alias("ci_lower"), four("ci_upper").alias("ci_upper"))


def write_aggregate(stats: DataFrame, kind: str, path: str) -> None:
    """Statistics in long form as CSV and as JSON lines, below path."""
    rows = aggregate_lines(stats, kind)
    rows.write.mode("overwrite").csv(f"{path}/csv", header=True)
    rows.write.mode("overwrite").json(f"{path}/json")


def slug(package: Column, file: Column) -> Column:
    """A report's name: the package, or else the file's name without its suffix."""
    return F.coalesce(F.nullif(package, F.lit("")), F.regexp_replace(S.basename(file), r"\.[^.]*$", ""))


# The layout of a scan report.
BADGES = {"critical": "[CRITICAL]", "high": "[HIGH]", "medium": "[MEDIUM]", "low": "[LOW]", "info": "[INFO]"}
NO_FINDINGS = "_No findings._"


def scan_report(apps: DataFrame, findings: DataFrame) -> DataFrame:
    """The full report of each application in Markdown (slug, report).

    apps(app_id, package, version, version_code, min_sdk, target_sdk, file, is_llm_integrated, providers); findings as the detectors give them. Sections
    are in a fixed order, severities from critical to info, evidence redacted.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(
        F.lit(". "), F.element_at(F.create_map(*[F.lit(x) for kv in BADGES.items() for x in kv]), F.col("severity")), F.lit(" "), F.col("title"), F.lit("\n\n- Kind: `"), F.col("kind"), F.lit("`\n"),
        F.when(F.col("provider").isNotNull(), F.concat(F.lit("- Provider: `"), F.col("provider"), F.lit("`\n"))).otherwise(""), F.format_string("- Confidence: %.2f\n", "confidence"),
        F.lit("- Location: `"), F.coalesce("file_path", F.lit("")), F.lit("`"), F.when(F.col("offset").isNotNull(), F.format_string(" @ offset %d", "offset")).otherwise(""),
        F.lit("\n\n"), F.coalesce("description", F.lit("")), F.lit("\n\n```\n"), S.redact(F.col("evidence"), 80), F.lit("\n```\n"),
    )
    order = F.struct("detector_idx", "source_idx", "rule_idx", "hit_idx", "evidence")
    own = findings.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))).alias("l"), *[F.count_if(F.col("severity") == x).alias(f"_{x}") for x in BADGES])
    head = F.concat(
        F.lit("# Scan report: "), text("package"), F.lit("\n\n## Application\n\n- Package: `"), text("package"), F.lit("`\n- Version: "), text("version"), F.lit(" (code "), text("version_code"), F.lit(")\n- min/target SDK: "), text("min_sdk"),
        F.lit(" / "), text("target_sdk"), F.lit("\n- SHA256: `"), F.col("app_id"), F.lit("`\n- File: `"), text("file"), F.lit("`\n\n## LLM integration\n\n- Confirmed LLM-integrated: **"), F.when(F.col("is_llm_integrated"), "yes").otherwise("no"), F.lit("**\n"),
        F.when(F.size("providers") > 0, F.concat(F.lit("- Detected providers: "), F.array_join("providers", ", "), F.lit("\n"))).otherwise(""), F.lit("\n## Findings summary\n\n| Severity | Count |\n|----------|-------|\n"),
        *[F.format_string(f"| {x} | %d |\n", F.coalesce(f"_{x}", F.lit(0))) for x in BADGES], F.lit("\n"),
    )
    numbered = F.array_join(F.transform("l", lambda x, i: F.concat(F.lit("### "), (i + 1).cast("string"), x["line"])), "\n")
    body = F.when(F.col("l").isNull(), F.lit(NO_FINDINGS)).otherwise(F.concat(F.lit("## Findings\n\n"), numbered))
    return apps.join(own, "app_id", "left").select(slug(F.col("package"), F.col("file")).alias("slug"), F.concat(head, body).alias("report"))


def write_outputs(reports: DataFrame, path: str, aggregate: DataFrame | None = None) -> None:
    """Reports (slug, report, and json if there is one) in a folder for each slug, and the aggregate beside them as JSON lines."""
    reports.select("slug", "report").write.mode("overwrite").partitionBy("slug").text(f"{path}/md")
    if "json" in reports.columns:
        reports.select("slug", "json").write.mode("overwrite").partitionBy("slug").text(f"{path}/json")
    if aggregate is not None:
        aggregate.write.mode("overwrite").json(f"{path}/_aggregate")
