"""Reports, result documents, details and strings of binaries as queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry import rules
from textquarry.functions import scalars as S
from textquarry.operators import detectors as D
from textquarry.plans.detection import _RAG_SQL, EVERY, INTEGRATION, LEX, PROMPTS, PROVIDERS
from textquarry.plans.overlay import SOURCES, read, sources
from textquarry.sources import tables as T
from textquarry.sources.report_files import write_reports
from textquarry.sources.staging import new_folder


def h11_match_offsets(spark, d):
    """Places of client names in texts, in code points."""
    return D.rag_content_matches(sources(spark, d)).select("app_id", "source_idx", "rule_idx", "hit_idx", "offset", "matched")


def h20_ascii_strings(spark, d):
    found = S.ascii_strings(F.col("content"))
    rows = read(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return rows.select("doc_id", F.size(found).cast("bigint").alias("n"), F.md5(F.array_join(found, "|")).alias("digest"))


def a13_a21_result_documents(spark, d):
    """Results as indented JSON, one a file, read back; files whose names begin with _ are no results."""
    path = new_folder(spark, "results")
    rows = read(spark, d, "customer").groupBy((F.col("c_custkey") % 40).alias("k")).agg(F.count("*").alias("n_findings"), F.max("c_name").alias("pkg_name"), F.min("c_acctbal").alias("least"))
    rows = rows.withColumn("app_id", F.concat(F.lit("Ä"), F.col("k").cast("string")))
    name = F.concat(F.when(F.col("k") % 8 == 3, "_").otherwise("r"), F.col("k").cast("string"))
    write_reports(rows.select(name.alias("name"), T.json_report(F.struct("app_id", "pkg_name", "n_findings", "least")).alias("content")), path, folders=4, suffix=".json")
    return T.read_results(spark, f"{path}/*", "app_id string, pkg_name string, n_findings bigint, least double")


def _light(spark, d):
    src = sources(spark, d)
    found, providers, integ = D.scan(src, scanners=())
    return found, integ.join(providers, "app_id", "left")


def a22_scan_report(spark, d):
    """The full report of each application with the fixed sections."""
    found, apps = _light(spark, d)
    blank = [F.lit(None).cast("string").alias(c) for c in ("version", "version_code", "min_sdk", "target_sdk")]
    listed = apps.select("app_id", F.when(F.col("app_id") != "src3", F.col("app_id")).alias("package"), *blank, F.concat("app_id", F.lit(".apk")).alias("file"), F.col("confirmed").alias("is_llm_integrated"), F.col("detected_providers").alias("providers"))
    return T.scan_report(listed, found).select("slug", F.md5("report").alias("digest"))


def a23_html_report(spark, d):
    """A page for each application; quotes and tags of what was found are escaped."""
    found, _ = _light(spark, d)
    marked = found.withColumn("evidence", F.concat(F.lit("<b>'\"&"), "evidence"))
    return T.html_report(marked).select("app_id", F.md5("report").alias("digest"))


def a27_findings_details(spark, d):
    """Details are kept of integrated applications and of those with findings."""
    path = new_folder(spark, "findings")
    rows = read(spark, d, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("sha256"), F.col("c_name").alias("pkg_name"), (F.col("c_nationkey") % 5 == 0).alias("llm_integrated"), (F.col("c_custkey") % 3).alias("n_findings"))
    T.append_findings(rows, f"{path}/log", rows, f"{path}/detail")
    kept = spark.read.schema(rows.schema).json(f"{path}/detail").select("sha256", F.lit(True).alias("detail"))
    return T.read_findings(spark, f"{path}/log").join(kept, "sha256", "left").select("sha256", "pkg_name", "llm_integrated", "n_findings", F.coalesce("detail", F.lit(False)).alias("detail"))


_FOUND = f"""{LEX}, {PROVIDERS}, {INTEGRATION},
 findings AS (SELECT app_id, CASE WHEN is_endpoint THEN 'llm_endpoint' ELSE 'llm_sdk_reference' END AS kind, CASE WHEN is_endpoint THEN 'LLM endpoint' ELSE 'LLM SDK reference' END AS title, provider, matched AS evidence, CASE WHEN is_endpoint THEN '0.90' ELSE '0.70' END AS confidence,
  min((source_idx, rule_idx, hit_idx)) AS o, arg_min(source_file, (source_idx, rule_idx, hit_idx)) AS file_path FROM lex GROUP BY ALL)"""
_NL = " || chr(10) || "
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_REDACTED = "CASE WHEN length({0}) <= {1} THEN {0} ELSE left({0}, {1} // 2) || '…' || right({0}, {1} // 4) END"

#: tools(app_id, source_idx, rule_idx, evidence): objects here lie in one line, so a line's rest from the nearest brace on is the object
_TOOLS = f"""tools AS (SELECT app_id, source_idx, 0 AS rule_idx, regexp_extract(content, '\\{{[^\\n{{]*"type"\\s*:\\s*"function"\\s*,\\s*"function"[^\\n]*') AS evidence FROM sources WHERE regexp_matches(content, '{rules.TOOL_FULL}')
 UNION ALL SELECT app_id, source_idx, 1, regexp_extract(content, '\\{{[^\\n{{]*"input_schema"[^\\n]*') FROM sources WHERE regexp_matches(content, '{rules.TOOL_INPUT}')
 UNION ALL SELECT app_id, source_idx, 2, substr(content, length(regexp_extract(content, '(?s)^(.*?){rules.TOOL_SHORT}', 1)) + 1, 80) FROM sources WHERE regexp_matches(content, '{rules.TOOL_SHORT}') AND NOT regexp_matches(content, '{rules.TOOL_FULL}'))"""

QUERIES = {f.__name__: f for f in (h11_match_offsets, h20_ascii_strings, a13_a21_result_documents, a22_scan_report, a23_html_report, a27_findings_details)}
ORACLE_SQL = {
    "h11_match_offsets": f"""WITH {_RAG_SQL}, parts AS (SELECT app_id, source_idx, rule_idx, regexp_extract_all(content, re) AS found, regexp_split_to_array(content, re) AS rest FROM sources, contents),
 each AS (SELECT *, unnest(range(1, len(found) + 1)) AS h FROM parts)
 SELECT app_id, source_idx, rule_idx, (h - 1)::INT AS hit_idx, (list_sum(list_transform(rest[1:h], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:h - 1], lambda x: length(x))), 0))::INT AS "offset", found[h] AS matched FROM each""",
    "i7_tool_schemas": f"""WITH {SOURCES}, {_TOOLS} SELECT app_id, source_idx, rule_idx, CASE WHEN rule_idx = 2 THEN 0.4 WHEN NOT json_valid(evidence) THEN 0.5 WHEN json_extract_string(evidence, '$.type') = 'function' AND json_extract_string(evidence, '$.function.name') IS NOT NULL AND json_exists(evidence, '$.function.parameters')
  OR json_extract_string(evidence, '$.name') IS NOT NULL AND json_extract_string(evidence, '$.input_schema.type') = 'object' THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN rule_idx < 2 THEN json_valid(evidence) END AS parsed_ok,
  CASE WHEN rule_idx < 2 THEN CASE WHEN json_extract_string(evidence, '$.type') = 'function' THEN json_extract_string(evidence, '$.function.name') ELSE json_extract_string(evidence, '$.name') END END AS tool_name FROM tools""",
    "i10_scan_app": f"""WITH {EVERY}, {PROVIDERS}, {INTEGRATION}, {PROMPTS}, {_TOOLS}, once AS (SELECT DISTINCT app_id, kind, provider, evidence FROM every UNION ALL SELECT DISTINCT app_id, 'system_prompt', NULL, left(run, 200) FROM prompts WHERE score >= {rules.PROMPT_THRESHOLD} UNION ALL SELECT DISTINCT app_id, 'tool_schema', NULL, left(evidence, 300) FROM tools),
 by_kind AS (SELECT app_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in rules.KINDS)} FROM once GROUP BY 1) SELECT c.*, confirmed, providers FROM by_kind c LEFT JOIN integ USING (app_id) LEFT JOIN prov USING (app_id)""",
    "h20_ascii_strings": "SELECT doc_id, len(f) AS n, md5(array_to_string(f, '|')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '[\\x20-\\x7e\\t]{4,}') AS f FROM documents)",
    "a13_a21_result_documents": "SELECT 'Ä' || k AS app_id, max(c_name) AS pkg_name, count(*) AS n_findings, min(c_acctbal) AS least FROM (SELECT *, c_custkey % 40 AS k FROM customer) WHERE k % 8 <> 3 GROUP BY k",
    "a22_scan_report": f"""WITH {_FOUND}, lined AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY o, evidence) AS i FROM findings),
 own AS (SELECT app_id, count(*) AS n, string_agg('### ' || i || '. [INFO] ' || title{_NL}''{_NL}'- Kind: `' || kind || '`'{_NL}'- Provider: `' || provider || '`'{_NL}'- Confidence: ' || confidence{_NL}'- Location: `' || file_path || '`'{_NL}''{_NL}''{_NL}''{_NL}'```'{_NL}{_REDACTED.format('evidence', 80)}{_NL}'```'{_NL}'', chr(10) ORDER BY i) AS lines FROM lined GROUP BY 1)
 SELECT app_id AS slug, md5('# Scan report: ' || package{_NL}''{_NL}'## Application'{_NL}''{_NL}'- Package: `' || package || '`'{_NL}'- Version: None (code None)'{_NL}'- min/target SDK: None / None'{_NL}'- SHA256: `' || app_id || '`'{_NL}'- File: `' || app_id || '.apk`'{_NL}''{_NL}'## LLM integration'{_NL}''{_NL}
  '- Confirmed LLM-integrated: **' || CASE WHEN confirmed THEN 'yes' ELSE 'no' END || '**'{_NL}'- Detected providers: ' || replace(providers, '|', ', '){_NL}''{_NL}'## Findings summary'{_NL}''{_NL}'| Severity | Count |'{_NL}'|----------|-------|'{_NL}'| critical | 0 |'{_NL}'| high | 0 |'{_NL}'| medium | 0 |'{_NL}'| low | 0 |'{_NL}'| info | ' || n || ' |'{_NL}''{_NL}'## Findings'{_NL}''{_NL}lines) AS digest
 FROM (SELECT *, CASE WHEN app_id = 'src3' THEN 'None' ELSE app_id END AS package FROM own JOIN integ USING (app_id) JOIN prov USING (app_id))""",
    "a23_html_report": f"""WITH {_FOUND}, cells AS (SELECT app_id, title, '<tr><td>info</td><td>' || title || '</td><td>' || provider || '</td><td>' || {_ESCAPED.format(_REDACTED.format('e', 120))} || '</td><td><div style="width:' || CASE WHEN confidence = '0.90' THEN 90 ELSE 70 END || '%;background:#888">&nbsp;</div></td></tr>' AS cell FROM (SELECT *, '<b>''"&' || evidence AS e FROM findings))
 SELECT app_id, md5('<!doctype html><meta charset=utf-8><title>' || app_id || '</title><table>' || string_agg(cell, '' ORDER BY title, cell) || '</table>') AS digest FROM cells GROUP BY 1""",
    "a27_findings_details": "SELECT 's' || c_custkey AS sha256, c_name AS pkg_name, c_nationkey % 5 = 0 AS llm_integrated, c_custkey % 3 AS n_findings, c_nationkey % 5 = 0 OR c_custkey % 3 > 0 AS detail FROM customer",
}
