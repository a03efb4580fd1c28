"""Appended files, the ledger's snapshot, seeded draws and exact rounding as queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import scalars as S
from textquarry.operators import corpus as C
from textquarry.operators import snapshots
from textquarry.plans.corpus import FOLD, LOG, log
from textquarry.plans.overlay import read
from textquarry.sources import tables as T
from textquarry.sources.staging import new_folder, staged

DELTAS = 4


def _ledger(spark, d) -> snapshots.Ledger:
    """The log taken in parts by time, each merged into the snapshot of those before."""
    ledger, rows = snapshots.Ledger(spark), log(spark, d)
    us = F.unix_micros(F.col("at").cast("timestamp"))
    least, most = rows.agg(F.min(us), F.max(us)).first()
    part = F.floor((us - F.lit(least or 0)) * DELTAS / F.lit((most or 0) - (least or 0) + 1))
    for k in range(DELTAS):
        ledger.append(rows.withColumn("at", F.col("at").cast("timestamp")).filter(part == k))
    return ledger


def a15_ledger_snapshot(spark, d):
    """States after all deltas, as a fold of the whole log gives them."""
    return _ledger(spark, d).state()


def a15_export_rows(spark, d):
    """Every row of the ledger with its application's columns."""
    people = read(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("sha256"), F.col("c_name").alias("pkg_name"))
    return snapshots.export_rows(_ledger(spark, d).state(), people, ["pkg_name"])


_VERDICTS = "CASE c_custkey % 4 WHEN 0 THEN 'AGREE' WHEN 1 THEN 'SCANNER SAID EMPTY: ' || c_mktsegment WHEN 2 THEN 'WEAK' ELSE 'AGREE, ' || c_name END AS verdict", "c_nationkey % 5 AS n_details", "c_custkey % 9 AS n_findings", "c_nationkey % 2 AS llm"


def _transcript(spark, d):
    """Blocks of an opening line and some lines of detail, written as text."""
    rows = read(spark, d, "customer").selectExpr("concat('com.', c_custkey) AS package", *_VERDICTS)
    opening = F.format_string("%s  [scanner: %d findings, llm=%d]  %s", "package", "n_findings", "llm", "verdict")
    below = F.transform(F.sequence(F.lit(0), F.col("n_details").cast("int")), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("    signal "), k.cast("string"))))
    folder = new_folder(spark, "audit")
    rows.select(F.explode(F.concat(F.array(opening), below)).alias("value")).write.text(folder)
    return T.audit_blocks(spark, folder)


def a18_audit_blocks(spark, d):
    return _transcript(spark, d).select("package", "n_findings", "llm", "verdict", "n_details")


def a18_d25_audit_tally(spark, d):
    """Verdicts counted, with the assertion that they add up."""
    return T.audit_tally(_transcript(spark, d))


def e3_e4_append_order(spark, d):
    """The last line of each key, by the order of lines in a log that was appended to twice; no column tells the order."""
    folder, rows = new_folder(spark, "appended"), read(spark, d, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("sha256"), F.col("event_type").alias("label"))
    half = rows.agg(F.floor(F.avg("event_id"))).first()[0] or 0
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        own = rows.filter(part).repartition("sha256").sortWithinPartitions("sha256", "event_id")
        own.select(F.to_json(F.struct("sha256", "label", (F.col("event_id") * 7 % 1000).alias("note"))).alias("value")).write.mode("append").text(folder)
    return T.last_lines(spark, folder, "sha256 string, label string, note bigint", "sha256")


def l1_seeded_sample(spark, d):
    """The draw of a seeded generator over strata in order."""
    rows = read(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("store"), F.format_string("%012d", "o_orderkey").alias("sha256"))
    return C.seeded_sample(rows, 100, ["year", "store"], "sha256", 20260801)


def l2_seeded_validation(spark, d):
    rows = read(spark, d, "documents").select(F.format_string("%09d", "doc_id").alias("sha256"), (F.length("text") > 2000).alias("flagged"))
    return C.seeded_validation_sample(rows, "flagged", "sha256", 25, 20260811)


_DOUBLES = ("l_orderkey % 65536 / 32768e0", "l_extendedprice / (l_partkey + 0.1e0) / 1000e0", "l_discount * 0.7e0 - 0.05e0", "(l_suppkey * 2 + 1) / 20000e0", "-(l_linenumber + l_orderkey % 4096 / 4096e0)")


def h32_rounding(spark, d):
    """Doubles rounded by their exact values: sums by number, over ties of both kinds."""
    rows = read(spark, d, "lineitem").select(F.explode(F.expr(f"array({', '.join(_DOUBLES)})")).alias("x"))
    # numbers are grouped before they are written out; neither groups nor comparisons tell zeros apart by sign
    below = F.when(F.col("x") == 0, F.col("x").cast("string").startswith("-")).otherwise(F.col("x") < 0)
    groups = rows.groupBy(S.round_exact(F.col("x")).alias("value"), below.alias("below")).agg(F.count("*").alias("n"))
    value = F.when(F.col("below") & (F.col("value") == 0), F.lit(-0.0)).otherwise(F.col("value"))
    return groups.select(F.when(F.col("value").isNotNull(), F.format_string("%.4f", value)).alias("rounded"), "n").groupBy("rounded").agg(F.sum("n").alias("n"))


def h21_utf16_strings(spark, d):
    """Wide strings in texts encoded in 16-bit units, of which every third is shifted by a byte; chunks are short, so that runs meet their edges."""
    wide = F.encode("text", "UTF-16LE")
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("09")), wide)).otherwise(wide).alias("content"))
    found = S.utf16_strings(F.col("content"), 4, 4096)
    return rows.select("doc_id", F.size(found).cast("bigint").alias("n"), F.md5(F.array_join(found, "|")).alias("digest"))


QUERIES = {f.__name__: f for f in (a15_ledger_snapshot, a15_export_rows, a18_audit_blocks, a18_d25_audit_tally, e3_e4_append_order, l1_seeded_sample, l2_seeded_validation, h21_utf16_strings, h32_rounding)}
_AUDIT = f"audit AS (SELECT concat('com.', c_custkey) AS package, {', '.join(_VERDICTS)} FROM customer)"
ORACLE_SQL = {
    "a15_ledger_snapshot": f"WITH {LOG}, {FOLD} SELECT sha256, state, attempts FROM fold",
    "a15_export_rows": f"WITH {LOG}, {FOLD} SELECT sha256, state, attempts, c_name AS pkg_name FROM fold LEFT JOIN customer ON sha256 = 'u' || c_custkey",
    "a18_audit_blocks": f"WITH {_AUDIT} SELECT package, n_findings::INT AS n_findings, llm = 1 AS llm, verdict, n_details::BIGINT AS n_details FROM audit",
    "a18_d25_audit_tally": f"WITH {_AUDIT} SELECT count(*) AS audited, count(*) FILTER (llm = 1) AS llm_audited, count(*) FILTER (verdict LIKE 'SCANNER%') AS empty_but_signal, count(*) FILTER (verdict LIKE 'AGREE%') AS agree, count(*) FILTER (verdict = 'WEAK') AS weak FROM audit",
    "e3_e4_append_order": "SELECT 'u' || user_id AS sha256, arg_max(event_type, event_id) AS label, max(event_id) * 7 % 1000 AS note FROM events GROUP BY 1",
    "h21_utf16_strings": """WITH parts AS (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 2047) // 2048))) AS k FROM documents),
 found AS (SELECT doc_id, k, CASE WHEN doc_id % 3 = 0 THEN [] ELSE regexp_extract_all(substr(text, (k * 2048 + 1)::BIGINT, 2048), '[\\x20-\\x7e\\t]{4,}') END AS f FROM parts)
 SELECT doc_id, coalesce(len(flatten(list(f ORDER BY k))), 0) AS n, md5(array_to_string(flatten(list(f ORDER BY k)), '|')) AS digest FROM found GROUP BY 1""",
    "h32_rounding": f"SELECT printf('%.4f', x) AS rounded, count(*) AS n FROM (SELECT unnest([{', '.join(_DOUBLES)}]) AS x FROM lineitem) GROUP BY 1",
}
