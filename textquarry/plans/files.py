"""Readers, writers, renderers, publication and runs as queries: written from the supplied tables, read back and compared."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry import rules
from textquarry.operators import corpus as C
from textquarry.operators import detectors as D
from textquarry.plans.corpus import INDEX, OUTCOMES, SIGNALS, STORE, _interval, _outcomes, index
from textquarry.plans.detection import _HOSTS
from textquarry.plans.overlay import read
from textquarry.sources import renderers as R
from textquarry.sources import tables as T
from textquarry.sources.report_files import write_reports
from textquarry.sources.staging import new_folder, staged
from textquarry.streaming import runs as J




def _written(spark, d):
    """The index as CSV, with sizes and a row without a hash among the rest."""
    rows = index(spark, d).selectExpr("sha256", "'' AS sha1", "'' AS md5", "dex_date", "CASE WHEN length(sha256) % 4 = 0 THEN 'big' ELSE cast(length(pkg_name) * 1000 AS string) END AS apk_size", "pkg_name", "vercode", "'' AS vt_detection", "vt_scan_date", "'' AS dex_size", "markets", "added")
    lost = rows.limit(1).withColumn("sha256", F.lit(" "))
    return rows.unionByName(lost)


_READ = f"{INDEX}, file AS (SELECT sha256, pkg_name, markets, nullif(trim(dex_date), '') AS dex_date, nullif(trim(vt_scan_date), '') AS vt_scan_date, nullif(trim(added), '') AS added, nullif(trim(vercode), '') AS vercode, CASE WHEN length(sha256) % 4 <> 0 THEN length(pkg_name) * 1000 END::BIGINT AS apk_size FROM idx)"


def a7_index_read(spark, d):
    path = new_folder(spark, "index")
    _written(spark, d).write.csv(path, header=True)
    return T.read_index(spark, path)


def a8_index_gzip(spark, d):
    """A gzipped index is one split; candidates are kept before the rest is dealt out."""
    path = new_folder(spark, "index-gz")
    _written(spark, d).coalesce(1).write.option("compression", "gzip").csv(path, header=True)
    return T.index_candidates(spark, path).select("sha256", F.array_join("signals", "|").alias("signals"), "apk_size")


def _frame(spark, d):
    return index(spark, d).selectExpr("sha256", "pkg_name", "CASE WHEN length(sha256) % 3 > 0 THEN 2000 + length(pkg_name) END AS year", "'dex_date' AS date_source", "'other' AS store", "vercode", "markets", "cast(length(pkg_name) * 10 AS bigint) AS apk_size", "CASE WHEN length(pkg_name) % 2 = 0 THEN array('ai', 'llm') ELSE cast(array() AS array<string>) END AS signals")


def a9_frame_round_trip(spark, d):
    path = new_folder(spark, "frame")
    T.write_frame(_frame(spark, d), path)
    return T.read_frame(spark, path).select("sha256", "pkg_name", "year", "date_source", "apk_size", F.array_join("signals", "|").alias("signals"))


def a10_manifest_round_trip(spark, d):
    path = new_folder(spark, "manifest")
    T.write_manifest(_frame(spark, d), path)
    return T.read_manifest(spark, path).select("sha256", "pkg_name", "year", "store", "apk_size")


def _results(spark, d):
    """One scan summary a customer."""
    return read(spark, d, "customer").selectExpr(
        "concat('U', c_custkey) AS sha256", "c_name AS pkg_name", "'1' AS version", "cast(2020 + c_nationkey % 5 AS int) AS year", "c_mktsegment AS store", "cast(c_custkey * 10 AS bigint) AS apk_size",
        "c_nationkey % 2 = 0 AS llm_integrated", "CASE WHEN c_nationkey % 2 = 0 THEN array('openai', 'cohere') ELSE array('openai') END AS providers", "cast(c_nationkey % 3 AS bigint) AS n_findings", "map('info', cast(c_nationkey % 3 AS bigint)) AS by_severity", "1.5D AS scan_seconds",
    )


def a11_findings_log(spark, d):
    """Appended twice; the last line of each application counts."""
    path, rows = new_folder(spark, "log"), _results(spark, d)
    T.append_findings(rows, path)
    T.append_findings(rows.filter("llm_integrated").withColumn("n_findings", F.col("n_findings") + 10), path)
    return C.latest(T.read_findings(spark, path), "sha256", ["n_findings"]).select("sha256", "pkg_name", "year", "llm_integrated", F.array_join("providers", "|").alias("providers"), "n_findings", F.element_at("by_severity", F.lit("info")).alias("info"))


def a12_labels(spark, d):
    """Labels appended in two sessions, the later one wins; a missing file gives none."""
    path = new_folder(spark, "labels")
    rows = read(spark, d, "labels").selectExpr("concat('S', doc_id) AS apk_sha256", "'' AS apk_path", "quality = 1 AS is_llm_integrated", "'' AS notes", "'2026-01-01' AS labelled_at", "'a' AS labeller").distinct()
    none = T.read_labels(spark, path)
    T.append_labels(rows, path)
    T.append_labels(rows.filter("is_llm_integrated").withColumns({"is_llm_integrated": F.lit(False), "labelled_at": F.lit("2026-02-01")}), path)
    return C.latest(T.read_labels(spark, path).unionByName(none), "apk_sha256", ["labelled_at", "is_llm_integrated"]).select("apk_sha256", "is_llm_integrated", "labelled_at")


def a14_detail_semi(spark, d):
    """Details by file name, lower-cased, of the applications in an id set."""
    path = new_folder(spark, "detail")
    T.write_details(read(spark, d, "nation").selectExpr("concat('N', n_nationkey) AS app_id", "n_name"), path)
    ids = read(spark, d, "nation").filter("n_regionkey < 2").selectExpr("concat('n', n_nationkey) AS app_id")
    return T.read_details(spark, path, ids, "n_name string").select("app_id", "n_name")


def a16_a24_a29_worksheets(spark, d):
    """The coder's view and the answer key of a sample, written and read back."""
    view, key = new_folder(spark, "view"), new_folder(spark, "key")
    rows = _results(spark, d)
    T.worksheet(rows).write.csv(view, header=True)
    T.answer_key(rows).write.csv(key, header=True)
    a, b = spark.read.csv(view, header=True), spark.read.csv(key, header=True)
    return a.join(b.withColumnRenamed("pkg_name", "_p"), "sha256").select("sha256", "pkg_name", "version", F.col("apk_size").cast("long").alias("apk_size"), T.truthy(F.col("llm_integrated")).alias("llm_integrated"), "providers", F.col("n_findings").cast("long").alias("n_findings"))


def a17_credentials(spark, d):
    """Credentials in CSV; those of unknown providers go, and keys become fingerprints at once."""
    path = new_folder(spark, "credentials")
    names = [*rules.PROVIDERS[:3], "nobody"]
    who = F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % 4 + 1).cast("int"))
    read(spark, d, "customer").select(who.alias("provider"), F.concat(F.lit("k-"), F.col("c_name")).alias("key"), F.concat(F.lit("s"), "c_custkey").alias("sha256"), F.col("c_mktsegment").alias("package")).write.csv(path, header=True)
    return T.read_credentials(spark, path)


def a22_markdown_report(spark, d):
    return T.markdown_report(_supplier_findings(spark, d)).select("app_id", F.md5("report").alias("digest"))


def _supplier_findings(spark, d):
    return read(spark, d, "supplier").selectExpr("concat('n', s_nationkey) AS app_id", "CASE s_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity", "s_name AS title", "CASE WHEN s_suppkey % 2 = 0 THEN 'openai' END AS provider", "concat('<', s_name, '>') AS evidence", "0.5D AS confidence")


def a26_aggregate_lines(spark, d):
    """Statistics in long form, written as CSV and JSON; both read back alike."""
    stats = C.with_interval(read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count_if(F.col("c_acctbal") > 0).alias("successes"), F.count("*").alias("n")))
    path = new_folder(spark, "aggregate")
    T.write_aggregate(stats, "severity", path)
    a = spark.read.csv(f"{path}/csv", header=True)
    b = spark.read.json(f"{path}/json").select(*[F.col(c).cast("string").alias(c) for c in a.columns])
    return a.intersect(b)


def a30_outputs(spark, d):
    """A report for each application under its slug, and the aggregate beside them."""
    path = new_folder(spark, "outputs")
    T.write_outputs(T.markdown_report(_supplier_findings(spark, d)).select(T.slug(F.col("app_id"), F.lit("x.apk")).alias("slug"), "report"), path)
    return spark.read.text(f"{path}/md", wholetext=True).select("slug", F.md5("value").alias("digest"))


def a30_report_files(spark, d):
    """A file for each application's report in a few folders, read back by name."""
    path = new_folder(spark, "reports")
    write_reports(T.markdown_report(_supplier_findings(spark, d)).select(F.col("app_id").alias("name"), F.col("report").alias("content")), path, folders=4)
    rows = spark.read.text(f"{path}/*/*.md", wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.select(F.regexp_replace("file", r"\.md$", "").alias("app_id"), F.md5("value").alias("digest"))


def a31_publication(spark, d):
    """Outcomes without package and with days alone, in the order of their content."""
    rows = _outcomes(spark, d).withColumn("checked_at", F.lit("2026-08-01T10:11:12"))
    return R.publish_credentials(rows).select("fingerprint", "provider", "valid", "state", "checked_at")


def a31_strings(spark, d):
    rows = read(spark, d, "pages").selectExpr("concat('s', page_id) AS sha256", "CASE WHEN page_id % 2 = 0 THEN 'assets/a.txt' ELSE 'classes.dex' END AS source_file", "md5(html) AS digest")
    return R.publish_strings(rows)


def a32_confusion_text(spark, d):
    rows = read(spark, d, "documents").select("doc_id", (F.length("text") > 1500).alias("flag")).join(read(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id")
    return R.confusion_text(C.confusion(rows, "flag", "truth"))


def a32_credential_text(spark, d):
    out = _outcomes(spark, d).withColumn("note", F.lit(None).cast("string"))
    return R.credential_text(out, C.credential_summary(out))


def a32_evidence_text(spark, d):
    """Worksheets over the pages' hosts."""
    pages = read(spark, d, "pages").selectExpr("concat('site', page_id % 7) AS app_id", "url || ' ' || html AS content")
    hosts = D.top_hosts(pages)
    apps = pages.select("app_id").distinct().select("app_id", F.lit("p").alias("package"), F.lit(None).cast("string").alias("version"), F.when(F.col("app_id") == "site3", "unreadable").alias("error"))
    none = hosts.limit(0)
    return R.evidence_worksheets(apps, hosts, none.select("app_id", F.lit("").alias("line"), "rank"), none.select("app_id", F.lit("").alias("source_file"), F.lit("").alias("snippet"), "rank"))


# --- runs ---------------------------------------------------------------------------------------------------------------------------

_LEDGER = "CASE WHEN c_nationkey % 6 = 0 THEN 'scanned' WHEN c_nationkey % 6 = 1 THEN 'scan_failed' ELSE 'pending' END AS state", "CASE WHEN c_nationkey % 6 = 1 THEN c_nationkey % 5 ELSE 0 END AS attempts"
_CAME = "CASE c_custkey % 4 WHEN 0 THEN c_name || ' https://api.openai.com/v1' WHEN 1 THEN c_name || ' com/anthropic/x' ELSE c_name END AS content", "CASE WHEN c_nationkey % 7 = 2 THEN 'BadZipFile: broken' END AS error"


def _enrolled(spark, d):
    return read(spark, d, "customer").selectExpr("concat('u', c_custkey) AS sha256", *_LEDGER)


def _run(spark, d, limit=None, ledger=None):
    people = read(spark, d, "customer").withColumn("sha256", F.concat(F.lit("u"), "c_custkey"))
    ledger = _enrolled(spark, d) if ledger is None else ledger
    manifest = people.selectExpr("sha256", "cast(c_custkey % 97 * 1000 AS bigint) AS apk_size")
    came = people.filter("c_nationkey % 5 <> 4").selectExpr("sha256 AS app_id", "0 AS source_idx", "'classes.dex' AS source_file", *_CAME)
    light = lambda s: D.scan(s, scanners=(), keep=staged)
    return J.bounded_run(ledger, manifest, came, limit, light, staged)


def j1_bounded_run(spark, d):
    return _run(spark, d).outcomes.select("sha256", "event", "bytes", "n_findings", "llm_integrated", F.array_join("providers", "|").alias("providers"))


def j8_poison_isolation(spark, d):
    """Applications that can't be read fail alone; the others' findings are complete."""
    run = _run(spark, d)
    return run.outcomes.groupBy("event", "error").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"))


def j7_resume(spark, d):
    """The events of a run of 50 applications and of one that its ledger feeds: what was scanned isn't pending, what failed is tried again."""
    first = _run(spark, d, 50).outcomes
    failed = F.col("event").isin(C.DOWNLOAD_FAILED, C.SCAN_FAILED).cast("int")
    after = _enrolled(spark, d).join(first.select("sha256", "event"), "sha256", "left").select("sha256", F.coalesce("event", "state").alias("state"), (F.col("attempts") + F.coalesce(failed, F.lit(0))).alias("attempts"))
    second = _run(spark, d, ledger=after).outcomes
    both = J.events(first, F.lit(1), 1).unionByName(J.events(second, F.lit(2), 2))
    twice = F.count_if(F.col("event") == C.SCANNED).over(W.partitionBy("sha256"))
    return both.withColumn("_scans", twice).filter("_scans <= 1").groupBy("event").agg(F.count_distinct("sha256").alias("n"))


def d26_run_totals(spark, d):
    """Totals seen while the outcomes are written."""
    rows, seen = J.observed(_run(spark, d).outcomes)
    rows.write.parquet(new_folder(spark, "outcomes"))
    got = seen.get
    names = ["scanned", "llm_integrated", "download_failed", "scan_failed", "bytes_downloaded", "findings"]
    return spark.createDataFrame([tuple(int(got[k]) for k in names)], ", ".join(f"{k} bigint" for k in names))


def j6_run_log(spark, d):
    log = J.run_log(spark, [(1, "2026-01-01T00:00", None, "first"), (2, "2026-01-02T00:00", None, "second"), (1, None, "2026-01-01T05:00", None), (3, "2026-01-03T00:00", None, "stopped"), (2, None, "2026-01-02T01:00", None)])
    return J.runs(log)


def j9_retention(spark, d):
    return J.retention(_run(spark, d).outcomes, keep_negatives=5, budget=3_000_000, used=100_000)


def e10_retention_budget(spark, d):
    """The budget alone: all have findings."""
    rows = read(spark, d, "supplier").selectExpr("concat('p', s_suppkey) AS sha256", "cast(s_suppkey * 7919 % 1000 AS bigint) AS bytes", "'scanned' AS event", "1L AS n_findings", "true AS llm_integrated")
    return J.retention(rows, budget=20_000).select("sha256", "bytes", "kept")


_RUN_SQL = f"""people AS (SELECT *, 'u' || c_custkey AS sha256 FROM customer), ledger AS (SELECT sha256, {', '.join(_LEDGER)} FROM people),
wanted AS (SELECT p.*, (c_custkey % 97 * 1000)::BIGINT AS size FROM people p JOIN ledger USING (sha256) WHERE state <> 'scanned' AND attempts < 3),
came AS (SELECT sha256, c_nationkey % 5 <> 4 AS arrived, {', '.join(_CAME)} FROM wanted),
outcome AS (SELECT sha256, CASE WHEN NOT arrived THEN 'download_failed' WHEN error IS NOT NULL THEN 'scan_failed' ELSE 'scanned' END AS event, CASE WHEN arrived THEN error END AS error, CASE WHEN arrived THEN size ELSE 0 END AS bytes,
  CASE WHEN arrived AND error IS NULL THEN contains(content, 'api.openai') OR contains(content, 'com/anthropic') END AS hit, contains(content, 'api.openai') AS open FROM came JOIN (SELECT sha256, size FROM wanted) USING (sha256)),
outcomes AS (SELECT sha256, event, error, bytes, hit::INT::BIGINT AS n_findings, CASE WHEN hit IS NOT NULL THEN hit AND open END AS llm_integrated, CASE WHEN hit AND open THEN 'openai' WHEN hit THEN 'anthropic' ELSE '' END AS providers FROM outcome)"""
_GREEDY = """walk(i, total, negatives, sha256, bytes, kept, reason) AS (SELECT 0::BIGINT, {used}::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BOOLEAN, NULL::VARCHAR UNION ALL
 SELECT i + 1, total + CASE WHEN w AND total + b <= {budget} THEN b ELSE 0 END, negatives + (neg AND total + b <= {budget})::INT, s, b, w AND total + b <= {budget}, CASE WHEN w AND total + b > {budget} THEN 'budget' WHEN pos THEN 'finding' WHEN neg THEN 'negative' ELSE 'none' END
 FROM (SELECT x.i, x.total, x.negatives, r.sha256 AS s, r.bytes AS b, r.pos, NOT r.pos AND r.done AND x.negatives < {negatives} AS neg, r.pos OR (r.done AND x.negatives < {negatives}) AS w FROM walk x JOIN ranked r ON r.i = x.i + 1))"""


QUERIES = {f.__name__: f for f in (
    a7_index_read, a8_index_gzip, a9_frame_round_trip, a10_manifest_round_trip, a11_findings_log, a12_labels, a14_detail_semi, a16_a24_a29_worksheets, a17_credentials, a22_markdown_report, a26_aggregate_lines, a30_outputs, a30_report_files, a31_publication, a31_strings,
    a32_confusion_text, a32_credential_text, a32_evidence_text, j1_bounded_run, j8_poison_isolation, j7_resume, d26_run_totals, j6_run_log, j9_retention, e10_retention_budget,
)}

_WHO = "[" + ", ".join(f"'{x}'" for x in rules.PROVIDERS[:3]) + "]"
_SUPPLIED = "f AS (SELECT concat('n', s_nationkey) AS app_id, CASE s_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity, [1, 2, 3, 4, 5][s_suppkey % 5 + 1] AS o, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'openai' ELSE '-' END AS provider FROM supplier)"
_REPORTS = f"{_SUPPLIED}, l AS (SELECT *, '- **' || severity || '** ' || title || ' (' || provider || ', confidence 0.50): `<' || title || '>`' AS line FROM f), reports AS (SELECT app_id, '# ' || app_id || chr(10) || chr(10) || count(*) || ' findings' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY o, title, line) || chr(10) AS report FROM l GROUP BY 1)"
_FOUR = ", ".join(f"printf('%.4f', {c}) AS {c}" for c in ("proportion", "ci_lower", "ci_upper"))
_ROWS = "string_agg('  [' || rpad(state, 7, ' ') || '] ' || rpad(provider, 14, ' ') || ' ' || fingerprint || ' ' || rpad(left(package, 34), 34, ' ') || ' ', chr(10) ORDER BY provider, state, fingerprint, package)"
_NL = " || chr(10) || "

ORACLE_SQL = {
    "a7_index_read": f"WITH {_READ} SELECT * FROM file",
    "a8_index_gzip": f"WITH {SIGNALS} SELECT sha256, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), '|') AS signals, CASE WHEN length(sha256) % 4 <> 0 THEN length(pkg_name) * 1000 END::BIGINT AS apk_size FROM sig WHERE len(s) > 0",
    "a9_frame_round_trip": f"WITH {INDEX} SELECT sha256, pkg_name, CASE WHEN length(sha256) % 3 > 0 THEN 2000 + length(pkg_name) END::INT AS year, 'dex_date' AS date_source, (length(pkg_name) * 10)::BIGINT AS apk_size, CASE WHEN length(pkg_name) % 2 = 0 THEN 'ai|llm' ELSE '' END AS signals FROM idx",
    "a10_manifest_round_trip": f"WITH {INDEX} SELECT sha256, pkg_name, CASE WHEN length(sha256) % 3 > 0 THEN 2000 + length(pkg_name) END::INT AS year, {STORE} AS store, (length(pkg_name) * 10)::BIGINT AS apk_size FROM idx",
    "a11_findings_log": "SELECT 'U' || c_custkey AS sha256, c_name AS pkg_name, (2020 + c_nationkey % 5)::INT AS year, c_nationkey % 2 = 0 AS llm_integrated, CASE WHEN c_nationkey % 2 = 0 THEN 'openai|cohere' ELSE 'openai' END AS providers, (c_nationkey % 3 + CASE WHEN c_nationkey % 2 = 0 THEN 10 ELSE 0 END)::BIGINT AS n_findings, (c_nationkey % 3)::BIGINT AS info FROM customer",
    "a12_labels": "SELECT DISTINCT 'S' || doc_id AS apk_sha256, false AS is_llm_integrated, CASE WHEN quality = 1 THEN '2026-02-01' ELSE '2026-01-01' END AS labelled_at FROM labels",
    "a14_detail_semi": "SELECT 'n' || n_nationkey AS app_id, n_name FROM nation WHERE n_regionkey < 2",
    "a16_a24_a29_worksheets": "SELECT 'U' || c_custkey AS sha256, c_name AS pkg_name, '1' AS version, (c_custkey * 10)::BIGINT AS apk_size, c_nationkey % 2 = 0 AS llm_integrated, CASE WHEN c_nationkey % 2 = 0 THEN 'openai|cohere' ELSE 'openai' END AS providers, (c_nationkey % 3)::BIGINT AS n_findings FROM customer",
    "a17_credentials": f"SELECT {_WHO}[c_custkey % 4 + 1] AS provider, left(sha256('k-' || c_name), 16) AS fingerprint, 's' || c_custkey AS sha256, c_mktsegment AS package FROM customer WHERE c_custkey % 4 < 3",
    "a22_markdown_report": f"WITH {_REPORTS} SELECT app_id, md5(report) AS digest FROM reports",
    "a26_aggregate_lines": f"WITH c AS (SELECT c_mktsegment AS category, count(*) FILTER (c_acctbal > 0) AS successes, count(*) AS n FROM customer GROUP BY 1), i AS (SELECT *, {_interval()} FROM c) SELECT 'severity' AS category_kind, category, successes::VARCHAR AS successes, n::VARCHAR AS n, {_FOUR} FROM i",
    "a30_outputs": f"WITH {_REPORTS} SELECT app_id AS slug, md5(report || chr(10)) AS digest FROM reports",
    "a30_report_files": f"WITH {_REPORTS} SELECT app_id, md5(report) AS digest FROM reports",
    "a31_publication": f"WITH {OUTCOMES} SELECT fingerprint, provider, valid, state, '2026-08-01' AS checked_at FROM outcomes",
    "a31_strings": "SELECT CASE WHEN page_id % 2 = 0 THEN 'asset' ELSE 'dex' END AS container, md5(html) AS digest FROM pages",
    "a32_confusion_text": f"""WITH m AS (SELECT count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (NOT f AND t) AS fn, count(*) FILTER (NOT f AND NOT t) AS tn FROM (SELECT length(text) > 1500 AS f, quality = 1 AS t FROM documents JOIN labels USING (doc_id)) WHERE t IS NOT NULL),
p AS (SELECT *, {_interval()} FROM (SELECT tp AS successes, tp + fp AS n FROM m)), r AS (SELECT *, {_interval()} FROM (SELECT tp AS successes, tp + fn AS n FROM m))
SELECT '## Confusion matrix — filter'{_NL}''{_NL}'| | predicted positive | predicted negative |'{_NL}'|---|---|---|'{_NL}'| **actual positive** | TP = ' || tp || ' | FN = ' || fn || ' |'{_NL}'| **actual negative** | FP = ' || fp || ' | TN = ' || tn || ' |'{_NL}''{_NL}
 printf('- Precision: %.4f (95%% CI %.4f–%.4f)', p.proportion, p.ci_lower, p.ci_upper){_NL}printf('- Recall:    %.4f (95%% CI %.4f–%.4f)', r.proportion, r.ci_lower, r.ci_upper){_NL}printf('- F1:        %.4f', 2 * p.proportion * r.proportion / (p.proportion + r.proportion)) AS report FROM m, p, r""",
    "a32_credential_text": f"""WITH {OUTCOMES}, s AS (SELECT count(*) AS found, count(*) FILTER (state = 'live') AS live, count(*) FILTER (state = 'revoked') AS revoked, count(*) FILTER (state = 'unknown') AS unknown, {_ROWS} AS lines FROM outcomes)
SELECT 'credential validation report'{_NL}'  checked : ' || found{_NL}'  live    : ' || live{_NL}'  revoked : ' || revoked{_NL}'  unknown : ' || unknown || ' (abstained or unreachable)'{_NL}'  live rate: ' || round_even(100.0 * live / (live + revoked), 0)::INT || '% of those checked'{_NL}''{_NL}lines AS report FROM s""",
    "a32_evidence_text": f"""WITH {_HOSTS}, ranked AS (SELECT app_id, host, n, row_number() OVER (PARTITION BY app_id ORDER BY n DESC, host) AS rank FROM (SELECT app_id, host, count(*) AS n FROM judged WHERE interesting GROUP BY ALL)),
h AS (SELECT app_id, count(*) AS n, string_agg('   ' || lpad(n::VARCHAR, 5, ' ') || 'x  ' || host, chr(10) ORDER BY rank) AS lines FROM ranked WHERE rank <= 40 GROUP BY 1)
SELECT app_id, repeat('=', 78){_NL}'PACKAGE : p'{_NL}'VERSION : (unknown)'{_NL}'SHA-256 : ' || app_id || '…'{_NL}CASE WHEN app_id = 'site3' THEN 'ERROR   : unreadable' ELSE ''{_NL}'-- Network hosts referenced (' || coalesce(n, 0) || ') ' || repeat('-', 30){_NL}coalesce(lines, '   (none found)'){_NL}''{_NL}'-- SDK-like paths (0) ' || repeat('-', 38){_NL}'   (none found)'{_NL}''{_NL}'-- AI-vocabulary strings in context (0) ' || repeat('-', 16){_NL}'   (none found)' END AS worksheet
FROM (SELECT DISTINCT concat('site', page_id % 7) AS app_id FROM pages) LEFT JOIN h USING (app_id)""",
    "j1_bounded_run": f"WITH {_RUN_SQL} SELECT sha256, event, bytes, n_findings, llm_integrated, providers FROM outcomes",
    "j8_poison_isolation": f"WITH {_RUN_SQL} SELECT event, error, count(*) AS n, coalesce(sum(n_findings), 0)::BIGINT AS findings FROM outcomes GROUP BY ALL",
    "j7_resume": f"WITH {_RUN_SQL} SELECT event, count(*) AS n FROM outcomes GROUP BY 1",
    "d26_run_totals": f"WITH {_RUN_SQL} SELECT count(*) FILTER (event = 'scanned') AS scanned, count(*) FILTER (llm_integrated) AS llm_integrated, count(*) FILTER (event = 'download_failed') AS download_failed, count(*) FILTER (event = 'scan_failed') AS scan_failed, sum(bytes)::BIGINT AS bytes_downloaded, sum(n_findings)::BIGINT AS findings FROM outcomes",
    "j6_run_log": "SELECT * FROM (VALUES (1::BIGINT, '2026-01-01T00:00', '2026-01-01T05:00', 'first'), (2, '2026-01-02T00:00', '2026-01-02T01:00', 'second'), (3, '2026-01-03T00:00', NULL, 'stopped')) t(id, started_at, finished_at, note)",
    "j9_retention": f"WITH RECURSIVE {_RUN_SQL}, ranked AS (SELECT row_number() OVER (ORDER BY sha256) AS i, sha256, bytes, event = 'scanned' AS done, event = 'scanned' AND (n_findings > 0 OR llm_integrated) AS pos FROM outcomes), {_GREEDY.format(used=100_000, budget=3_000_000, negatives=5)} SELECT sha256, bytes, kept, reason FROM walk WHERE i > 0",
    "e10_retention_budget": f"WITH RECURSIVE ranked AS (SELECT row_number() OVER (ORDER BY 'p' || s_suppkey) AS i, 'p' || s_suppkey AS sha256, (s_suppkey * 7919 % 1000)::BIGINT AS bytes, true AS done, true AS pos FROM supplier), {_GREEDY.format(used=0, budget=20_000, negatives=0)} SELECT sha256, bytes, kept FROM walk WHERE i > 0",
}
