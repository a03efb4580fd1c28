"""Text renderers, and publication without identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import scalars as S

# The layout of worksheets and reports.
RULE = "=" * 78
HOSTS = "-- Network hosts referenced (%d) " + "-" * 30
PATHS = "-- SDK-like paths (%d) " + "-" * 38
STRINGS = "-- AI-vocabulary strings in context (%d) " + "-" * 16
NONE = "   (none found)"
SHOWN_PATHS, SHOWN_STRINGS = 15, 20


def _section(title: str, items: Column, line, most: int | None = None) -> Column:
    shown = F.slice(items, 1, most) if most else items
    return F.concat(F.array(F.lit(""), F.format_string(title, F.size(items))), F.when(F.size(items) > 0, F.transform(shown, line)).otherwise(F.array(F.lit(NONE))))


def evidence_text(package: Column, version: Column, sha: Column, error: Column, hosts: Column, paths: Column, strings: Column) -> Column:
    """A coder's worksheet entry. hosts: array of (host, n); paths: array of strings; strings: array of (source, snippet)."""
    unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(unknown)"))
    head = F.array(F.lit(RULE), F.concat(F.lit("PACKAGE : "), unknown(package)), F.concat(F.lit("VERSION : "), unknown(version)), F.concat(F.lit("SHA-256 : "), F.left(sha, F.lit(32)), F.lit("…")))
    body = F.concat(
        _section(HOSTS, hosts, lambda x: F.format_string("   %5dx  %s", x["n"], x["host"])), _section(PATHS, paths, lambda x: F.concat(F.lit("   "), F.left(x, F.lit(88))), SHOWN_PATHS),
        _section(STRINGS, strings, lambda x: F.concat(F.lit("   ["), F.left(x["source"], F.lit(22)), F.lit("] "), F.left(x["snippet"], F.lit(100))), SHOWN_STRINGS),
    )
    failed = F.array(F.concat(F.lit("ERROR   : "), error))
    return F.array_join(F.concat(head, F.when(F.coalesce(error, F.lit("")) != "", failed).otherwise(body)), "\n")


def evidence_worksheets(apps: DataFrame, hosts: DataFrame, paths: DataFrame, strings: DataFrame) -> DataFrame:
    """One worksheet text per application: apps(app_id, package, version, error), hosts(app_id, host, n, rank), paths(app_id, line, rank), strings(app_id, source_file, snippet, rank); the parts are bounded by their ranks."""
    h = hosts.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("rank", "host", "n"))).alias("h"))
    p = paths.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("p"))
    s = strings.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("source_file").alias("source"), "snippet"))).alias("s"))
    every = apps.join(h, "app_id", "left").join(p, "app_id", "left").join(s, "app_id", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    lines = empty(F.transform("p", lambda x: x["line"]), "string")
    text = evidence_text(F.col("package"), F.col("version"), F.col("app_id"), F.col("error"), empty(F.col("h"), "struct<rank:int,host:string,n:bigint>"), lines, empty(F.col("s"), "struct<rank:int,source:string,snippet:string>"))
    return every.select("app_id", text.alias("worksheet"))


def confusion_text(counts: DataFrame, label: str = "filter") -> DataFrame:
    """The confusion matrix with intervals, from a row (tp, fp, fn, tn, precision, recall, f1)."""
    p, r = S.wilson(F.col("tp"), F.col("tp") + F.col("fp")), S.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    line = F.format_string
    lines = F.array(
        F.lit(f"## Confusion matrix — {label}"), F.lit(""), F.lit("| | predicted positive | predicted negative |"), F.lit("|---|---|---|"),
        line("| **actual positive** | TP = %d | FN = %d |", "tp", "fn"), line("| **actual negative** | FP = %d | TN = %d |", "fp", "tn"), F.lit(""),
        line("- Precision: %.4f (95%% CI %.4f–%.4f)", "precision", p["lower"], p["upper"]), line("- Recall:    %.4f (95%% CI %.4f–%.4f)", "recall", r["lower"], r["upper"]), line("- F1:        %.4f", "f1"),
    )
    return counts.select(F.array_join(lines, "\n").alias("report"))


def credential_text(outcomes: DataFrame, summary: DataFrame) -> DataFrame:
    """The disclosure log: counts, the rate of live ones, and a line for each outcome (state, provider, fingerprint, package, note). No key is in it.

    The lines of one report are gathered in one row, as a text is.
    """
    lines = outcomes.select(F.format_string("  [%-7s] %-14s %s %-34s %s", "state", "provider", "fingerprint", F.left(F.coalesce("package", F.lit("")), F.lit(34)), F.left(F.coalesce("note", F.lit("")), F.lit(48))).alias("line"), "provider", "state", "fingerprint", "package")
    body = lines.agg(F.array_sort(F.collect_list(F.struct("provider", "state", "fingerprint", "package", "line"))).alias("l"))
    head = F.array(F.lit("credential validation report"), F.format_string("  checked : %d", "found"), F.format_string("  live    : %d", "live"), F.format_string("  revoked : %d", "revoked"), F.format_string("  unknown : %d (abstained or unreachable)", "unknown"))
    rate = F.when(F.col("live") + F.col("revoked") > 0, F.array(F.format_string("  live rate: %.0f%% of those checked", F.bround(100 * F.col("live_rate"))))).otherwise(F.array().cast("array<string>"))
    return summary.crossJoin(body).select(F.array_join(F.concat(head, rate, F.array(F.lit("")), F.transform("l", lambda x: x["line"])), "\n").alias("report"))  # one row each


def by_content(rows: DataFrame) -> DataFrame:
    """Rows in the order of their content, so that nothing of the old order can be read from it."""
    return rows.orderBy(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))


def publish_credentials(outcomes: DataFrame) -> DataFrame:
    """Outcomes without package; times are cut to days."""
    kept = [c for c in outcomes.columns if c not in ("package", "sha256")]
    out = outcomes.select(*kept)
    out = out.withColumn("checked_at", F.left(F.col("checked_at").cast("string"), F.lit(10))) if "checked_at" in kept else out
    return out.orderBy("provider", "state", "fingerprint")


def publish_strings(strings: DataFrame, identifiers: tuple[str, ...] = ("app_id", "sha256", "pkg_name", "package", "version", "source_idx", "source_file", "offset")) -> DataFrame:
    """Found strings without what identifies an application; their file is coarsened to its kind of container."""
    rest = [c for c in strings.columns if c not in identifiers]
    coarse = [S.container_class(F.col("source_file")).alias("container")] if "source_file" in strings.columns else []
    return by_content(strings.select(*coarse, *rest))
