"""Detector queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry import rules
from textquarry.functions import scalars as S
from textquarry.operators import detectors as D
from textquarry.plans.overlay import SOURCES, read, sources, values
from textquarry.sources.staging import staged

_LEXICAL = [(i, who, p, ("(?i)" if ic else "") + p, True) for i, (who, p, ic) in enumerate(rules.ENDPOINTS)]
_LEXICAL += [(len(rules.ENDPOINTS) + i, who, x, x.replace(".", "\\.") + r"(?:[^\p{L}\p{N}_]|$)", False) for i, (who, x) in enumerate(rules.SDK_NAMESPACES)]
#: lex(app_id, source_idx, source_file, rule_idx, provider, pattern, is_endpoint, hit_idx, matched)
LEX = f"""{SOURCES},
rules(rule_idx, provider, pattern, re, is_endpoint) AS {values(_LEXICAL)},
lex AS (SELECT app_id, source_idx, source_file, rule_idx, provider, pattern, is_endpoint, h - 1 AS hit_idx, CASE WHEN is_endpoint THEN found[h] ELSE pattern END AS matched
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS h FROM (SELECT *, regexp_extract_all(content, re) AS found FROM sources, rules)))"""
PROVIDERS = """firsts AS (SELECT app_id, provider, min((source_idx, rule_idx, hit_idx)) AS f FROM lex GROUP BY ALL),
prov AS (SELECT app_id, string_agg(provider, '|' ORDER BY f) AS providers FROM firsts GROUP BY 1)"""
_TESTS = [(i, "invocation", who, p) for i, (who, p) in enumerate(rules.INVOCATIONS)] + [(len(rules.INVOCATIONS) + i, "json_body", None, p) for i, p in enumerate(rules.JSON_BODIES)]
STRUCT = f"""tests(pattern_idx, kind, provider, detail) AS {values(_TESTS)},
struct AS (SELECT app_id, source_idx, source_file, pattern_idx, kind, t.provider, detail FROM sources, tests t WHERE regexp_matches(content, detail)
  AND (kind = 'json_body' OR EXISTS (SELECT 1 FROM lex l WHERE l.app_id = sources.app_id AND l.provider = t.provider)))"""
INTEGRATION = f"""{STRUCT},
integ AS (SELECT app_id, bool_or(is_endpoint) AS has_endpoint, count(*) AS n_lexical, count(DISTINCT CASE WHEN NOT is_endpoint THEN matched END) AS n_sdk,
  coalesce(any_value(n), 0) AS n_structural, bool_or(is_endpoint) OR coalesce(any_value(n), 0) > 0 AS confirmed,
  bool_or(is_endpoint) OR count(DISTINCT CASE WHEN NOT is_endpoint THEN matched END) >= 2 AS quorum
  FROM lex LEFT JOIN (SELECT app_id, count(*) AS n FROM struct GROUP BY 1) USING (app_id) GROUP BY 1)"""
LEXICAL_FINDINGS = """found AS (SELECT app_id, CASE WHEN is_endpoint THEN 'llm_endpoint' ELSE 'llm_sdk_reference' END AS kind, provider, matched AS evidence,
  CASE WHEN is_endpoint THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, 'info' AS severity, source_file AS file_path, source_idx, rule_idx, hit_idx FROM lex)"""

_RAG = [(i, n, p, s, c) for i, (n, p, s, c) in enumerate(rules.RAG_PATHS)]
_CONTENT = [(i, n, p, s, c) for i, (n, p, s, c) in enumerate(rules.RAG_CONTENT)]


def _lex(spark, d):
    return D.lexical_matches(sources(spark, d))


def i1_lexical_endpoints(spark, d):
    return _lex(spark, d).filter("is_endpoint").select("app_id", "source_idx", "source_file", "rule_idx", "provider", "hit_idx", "matched")


def i2_lexical_sdk(spark, d):
    return _lex(spark, d).filter("not is_endpoint").select("app_id", "source_idx", "source_file", "rule_idx", "provider", "hit_idx", "matched")


def e5_first_seen_providers(spark, d):
    return D.detected_providers(_lex(spark, d)).select("app_id", F.array_join("detected_providers", "|").alias("providers"))


def _struct(spark, d):
    src = sources(spark, d)
    return D.structural_evidence(src, D.detected_providers(D.lexical_matches(src)))


def c2_structural_evidence(spark, d):
    return _struct(spark, d)


def i3_structural_invocation(spark, d):
    return _struct(spark, d).filter("kind = 'invocation'").groupBy("app_id", "provider", "pattern_idx").agg(F.count("*").alias("n"))


def i4_structural_json_body(spark, d):
    return _struct(spark, d).filter("kind = 'json_body'").groupBy("app_id", "pattern_idx").agg(F.count("*").alias("n"))


def b3_llm_confirmed(spark, d):
    src = sources(spark, d)
    lex = staged(D.lexical_matches(src))
    return D.integration(lex, D.structural_evidence(src, D.detected_providers(lex)))


def b2_llm_lexical_rule(spark, d):
    lex = _lex(spark, d)
    return D.integration(lex, lex.limit(0).select("app_id")).select("app_id", "n_sdk", "quorum")


def i5_lexical_findings(spark, d):
    return D.lexical_findings(_lex(spark, d)).select("app_id", "kind", "severity", "provider", "evidence", "confidence", "file_path")


def e1_dedup_findings(spark, d):
    out = D.dedup_findings(D.lexical_findings(_lex(spark, d)))
    return out.select("app_id", "kind", "provider", "evidence", "confidence", "file_path", "occurrences", F.array_join("locations", "|").alias("locations"))


def d1_severity_histogram(spark, d):
    src = sources(spark, d)
    return D.severity_histogram(D.dedup_findings(D.lexical_findings(D.lexical_matches(src)).unionByName(D.rag_findings(src))))


def c1_rules_x_sources(spark, d):
    return _lex(spark, d).groupBy("rule_idx", "provider").agg(F.count("*").alias("n_hits"), F.count_distinct("app_id").alias("n_apps"))


def i8_rag_paths(spark, d):
    return D.rag_path_matches(sources(spark, d)).select("app_id", "source_idx", "name", "severity", "confidence", "evidence", "container")


def i9_rag_content(spark, d):
    return D.rag_content_matches(sources(spark, d)).select("app_id", "source_idx", "name", "severity", "confidence", "matched")


def i6_prompt_components(spark, d):
    s = D.prompt_scores(sources(spark, d))
    return s.select("app_id", "source_idx", "hit_idx", F.md5("run").alias("run"), "length", "opener", "role_language", "template_slots", "multi_sentence", "policy_penalty", "path_penalty", "url_penalty", "strong", "score")


def i6_system_prompts(spark, d):
    return D.prompt_findings(sources(spark, d)).select("app_id", "source_idx", "kind", "severity", "evidence", "confidence", "file_path")


def h10_printable_runs(spark, d):
    runs = S.printable_runs(F.col("content"))
    return sources(spark, d).select("source_idx", F.size(runs).cast("long").alias("n_runs"), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("long").alias("longest"))


def i7_tool_schemas(spark, d):
    return D.tool_schemas(sources(spark, d)).select("app_id", "source_idx", "rule_idx", "confidence", "parsed_ok", "tool_name")


def is_credentials(spark, d):
    return D.credential_findings(sources(spark, d)).select("app_id", "source_idx", "title", "provider", "severity", "evidence", "confidence")


def i10_scan_app(spark, d):
    found, providers, integ = D.scan(sources(spark, d), keep=staged)
    kinds = found.groupBy("app_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in rules.KINDS])
    return kinds.join(integ.select("app_id", "confirmed"), "app_id", "left").join(providers.select("app_id", F.array_join("detected_providers", "|").alias("providers")), "app_id", "left")


def i10_scan_kinds(spark, d):
    """The same scan's findings by application and kind, of the kinds that SQL can find, in long form."""
    found, providers, integ = D.scan(sources(spark, d))
    rows = found.filter(~F.col("kind").isin("system_prompt", "tool_schema")).groupBy("app_id", "kind", "provider", "severity").agg(F.count("*").alias("n"), F.sum(F.coalesce("occurrences", F.lit(1))).alias("occurrences"))
    named = providers.select("app_id", F.array_join("detected_providers", "|").alias("providers"))
    return rows.join(integ.select("app_id", "confirmed", "n_structural"), "app_id", "left").join(named, "app_id", "left")


def g4_findings_union(spark, d):
    src = sources(spark, d)
    rows = D.lexical_findings(D.lexical_matches(src)).unionByName(D.rag_findings(src))
    return rows.groupBy("kind", "severity").agg(F.count("*").alias("n"))


def c6_gemini_corroboration(spark, d):
    src = sources(spark, d)
    lex = D.lexical_matches(src)
    keys = src.select("app_id", "source_idx", "source_file")
    made = D._finding(keys, D.SECRETS, kind=F.lit("secret"), severity=F.lit("medium"), title=F.lit(D.UNKNOWN_GOOGLE), provider=F.lit("generic"), evidence=F.concat(F.lit("k"), "source_idx"), confidence=F.lit(0.85))
    return D.promote_google(made, D.detected_providers(lex)).groupBy("app_id", "provider", "severity").agg(F.count("*").alias("n"))


def h15_classify_prompt(spark, d):
    c = sources(spark, d).select("source_idx", S.classify_prompt(F.col("content")).alias("c"))
    return c.select("source_idx", "c.*")


def d24_prompt_rollup(spark, d):
    return D.prompt_rollup(sources(spark, d).select("app_id", S.classify_prompt(F.col("content")).alias("c")))


def d22_host_counts(spark, d):
    pages = read(spark, d, "pages").selectExpr("concat('site', page_id % 7) AS app_id", "url || ' ' || html AS content")
    return D.top_hosts(pages).select("app_id", "host", "n", F.col("rank").cast("long").alias("rank"))


def b5_host_interesting(spark, d):
    hosts = read(spark, d, "pages").select(F.explode_outer(S.hosts_in(F.concat("url", F.lit(" "), "html"))).alias("host")).filter("host is not null")
    return hosts.groupBy("host").agg(F.count("*").alias("n")).withColumn("interesting", S.host_interesting(F.col("host")))


def f4_snippets(spark, d):
    return D.snippets(sources(spark, d)).select("app_id", "source_idx", "term", F.col("rank").cast("long").alias("rank"))


def h13_snippet(spark, d):
    return sources(spark, d).select("source_idx", S.snippet(F.col("content"), "openai").alias("snippet")).filter("snippet is not null")


def f3_sdk_paths(spark, d):
    return D.sdk_paths(sources(spark, d)).select("app_id", "line", F.col("rank").cast("long").alias("rank"))


def e8_container_class(spark, d):
    return sources(spark, d).groupBy(S.container_class(F.col("source_file")).alias("container")).agg(F.count("*").alias("n"))


def b10_non_dex(spark, d):
    return sources(spark, d).filter(S.not_dex(F.col("source_file"))).groupBy(S.top_component(F.col("source_file")).alias("top")).agg(F.count("*").alias("n"))


def h8_paths(spark, d):
    p = F.col("url")
    return read(spark, d, "pages").select("page_id", S.basename(p).alias("base"), S.dirname(p).alias("dir"), S.top_component(p).alias("top"), S.is_media(p).alias("media"))


def i12_audit_patterns(spark, d):
    """Sources in which each pattern of the wider net occurs."""
    return D.audit_matches(sources(spark, d)).groupBy("app_id", "name").agg(F.count("*").alias("n"))


def i12_audit(spark, d):
    """Per application: does a wider net agree with the detectors' lexical findings?"""
    src = sources(spark, d)
    seen = D.audit_signals(src)
    found = _lex(spark, d).filter("is_endpoint").select("app_id").distinct().withColumn("found", F.lit(True))
    both = seen.join(found, "app_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return both.withColumn("verdict", F.when(~F.col("found") & F.col("signal"), "EMPTY-BUT-SIGNAL").when(F.col("found") & ~F.col("signal"), "WEAK").otherwise("AGREE"))


def d25_audit_partition(spark, d):
    v = i12_audit(spark, d)
    names = ("AGREE", "EMPTY-BUT-SIGNAL", "WEAK")
    return v.agg(F.count("*").alias("audited"), *[F.count_if(F.col("verdict") == n).alias(n.lower().replace("-", "_")) for n in names])


_AUDIT_TEST = " OR ".join("regexp_matches(content, '" + p.replace("'", "''") + "')" for n, p in rules.AUDIT if n.startswith(tuple(rules.AUDIT_STRONG)))
_AUDIT_SQL = f"""{LEX}, verdicts AS (SELECT app_id, signal, found, CASE WHEN NOT found AND signal THEN 'EMPTY-BUT-SIGNAL' WHEN found AND NOT signal THEN 'WEAK' ELSE 'AGREE' END AS verdict FROM
 (SELECT app_id, bool_or({_AUDIT_TEST}) AS signal, app_id IN (SELECT app_id FROM lex WHERE is_endpoint) AS found FROM sources GROUP BY 1))"""
CONTAINER = """CASE WHEN regexp_full_match(source_file, 'classes\\d*\\.dex') THEN 'dex' WHEN source_file LIKE 'lib/%.so' THEN 'native_library' WHEN source_file = 'resources.arsc' THEN 'resource_table'
 WHEN source_file = 'AndroidManifest.xml' THEN 'manifest' WHEN source_file LIKE 'assets/%' THEN 'asset' WHEN source_file LIKE 'res/%' THEN 'resource' ELSE 'other' END"""


def _re(p: str, i: bool = True) -> str:
    return "'" + ("(?i)" if i else "") + p.replace("'", "''") + "'"


def _first(p: str) -> str:
    """Place of a pattern's first match from 1, or 0."""
    return f"(CASE WHEN regexp_matches(content, {_re(p)}) THEN length(regexp_extract(content, {_re('(?s)^(.*?)(?:' + p + ')')}, 1)) + 1 ELSE 0 END)"


_CLASSES = f"""{SOURCES}, classed AS (SELECT app_id, source_idx, CASE WHEN confidential THEN 'system_prompt' WHEN f > 0 AND s = 0 THEN 'preset' WHEN s > 0 AND f = 0 THEN 'system_prompt'
  WHEN f > 0 AND f < s THEN 'preset' WHEN f > 0 THEN 'system_prompt' ELSE 'unclassified' END AS class, f > 0 AS first_person, s > 0 AS second_person, confidential, role_binding, white_label
  FROM (SELECT app_id, source_idx, {_first(rules.FIRST_PERSON)} AS f, {_first(rules.SECOND_PERSON)} AS s, regexp_matches(content, {_re(rules.CONFIDENTIAL)}) AS confidential,
  regexp_matches(content, {_re(rules.ROLE_BINDING, False)}) AS role_binding, regexp_matches(content, {_re(rules.WHITE_LABEL)}) AS white_label FROM sources))"""
_HOSTS = f"""hosts AS (SELECT app_id, lower(unnest(regexp_extract_all(content, '(?i){rules.HOST}', 1))) AS host FROM (SELECT concat('site', page_id % 7) AS app_id, url || ' ' || html AS content FROM pages)),
judged AS (SELECT *, list_contains([{", ".join(f"'{x}'" for x in rules.TLDS)}], split_part(host, '.', -1)) AND NOT ({" OR ".join(f"suffix(host, '{x}')" for x in rules.BORING_HOSTS)})
 AND split_part(host, '.', 1) NOT IN ({", ".join(f"'{x}'" for x in rules.PACKAGE_ROOTS)}) AS interesting FROM hosts)"""
_RAG_SQL = f"""{SOURCES}, paths(rule_idx, name, re, severity, confidence) AS {values(_RAG)}, ragp AS (SELECT app_id, source_idx, rule_idx, name, severity, confidence::DOUBLE AS confidence, split_part(source_file, '/', -1) AS evidence,
 CASE WHEN contains(source_file, '/') THEN regexp_replace(source_file, '/[^/]*$', '') END AS container FROM sources, paths WHERE regexp_matches(source_file, re)),
 contents(rule_idx, name, re, severity, confidence) AS {values(_CONTENT)}, ragc AS (SELECT app_id, source_idx, rule_idx, name, severity, confidence::DOUBLE AS confidence, unnest(regexp_extract_all(content, re)) AS matched FROM sources, contents)"""
_KEYS = [(i, n, who, p.replace("(?!proj-|ant-|or-)", ""), s, c) for i, (n, who, p, s, c) in enumerate(rules.CREDENTIALS)]  # none of what follows is a letter or digit, so the look-ahead changes nothing
_SECRETS = f"""{SOURCES}, shapes(rule_idx, title, provider, re, severity, base) AS {values(_KEYS)}, secrets AS (SELECT app_id, source_idx, source_file, rule_idx, title, provider, severity, base::DOUBLE AS base, unnest(regexp_extract_all(content, re)) AS matched FROM sources, shapes)"""


def _n(name: str) -> str:
    """How often a named test of prompts matches a run; a sign that may not come before is taken with the match, which changes no count as no match ends with one."""
    pattern, case = S.PROMPT_TESTS[name]
    return f"len(regexp_extract_all(run, {_re(pattern.replace(chr(40) + '?<![' + chr(92) + 'w' + chr(92) + ']])', '(?:^|[^' + chr(92) + 'w' + chr(92) + ']])'), not case)}))"


#: prompts(app_id, source_idx, source_file, hit_idx, run, parts, strong, score): the scores of all runs that pass the length gate
PROMPTS = f"""runs AS (SELECT app_id, source_idx, source_file, list[h] AS run, h - 1 AS hit_idx FROM (SELECT *, unnest(range(1, len(list) + 1)) AS h FROM (SELECT *, list_filter(regexp_split_to_array(content, '[\\pC\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> '') AS list FROM sources)) WHERE length(list[h]) >= {rules.MIN_LENGTH_SHORT}),
gated AS (SELECT *, len(regexp_extract_all(run, '{rules.CJK}')) / length(run) >= {rules.CJK_DENSITY} AS dense, {_n("opener")} + {_n("opener_intl")} > 0 AS opener FROM runs),
counted AS (SELECT *, {", ".join(f"{_n(x)} AS n_{x}" for x in S.PROMPT_TESTS if not x.startswith("opener"))} FROM gated WHERE length(run) >= {rules.MIN_LENGTH} OR dense OR opener),
parted AS (SELECT *, round(0.20 * greatest(0.0, least(1.0, CASE WHEN dense THEN (length(run) - {rules.MIN_LENGTH_SHORT}) / 180.0 ELSE (length(run) - {rules.MIN_LENGTH}) / 520.0 END::DOUBLE)), 3)::DOUBLE AS length, CASE WHEN opener THEN 0.35 ELSE 0 END::DOUBLE AS opener_part,
 round(least(0.30, 0.06 * (n_role + n_role_intl))::DOUBLE, 3) AS role_language, CASE WHEN n_slot >= 2 THEN 0.15 ELSE 0 END::DOUBLE AS template_slots, CASE WHEN CASE WHEN dense THEN n_ends + n_clauses >= 1 ELSE n_ends >= 2 END THEN 0.1 ELSE 0 END::DOUBLE AS multi_sentence,
 {", ".join(f"CASE WHEN {test} THEN -{x} ELSE 0 END::DOUBLE AS {name}_penalty" for name, test, x in (("policy", "n_policy > 0", 0.25), ("path", f"regexp_matches(source_file, {_re(rules.POLICY_PATH)})", 0.25), ("markup", "n_markup > 0", 0.2), ("machine_pool", f"regexp_matches(source_file, {_re(rules.MACHINE_POOL_PATH)})", 0.3), ("framework", "n_framework > 0", 0.35), ("code", "n_code > 0", 0.4), ("licence", "n_licence > 0", 0.35), ("label_array", "n_labels >= 3", 0.35), ("url", "n_url > 0", 0.2), ("log", "n_log > 0", 0.3)))},
 n_code = 0 AND (opener OR n_slot >= 2 OR n_marker > 0) AS strong FROM counted),
prompts AS (SELECT *, round(CASE WHEN strong THEN total ELSE least(total, {rules.WEAK_CEILING}) END, 3) AS score FROM (SELECT *, greatest(0, least(1, length + opener_part + role_language + template_slots + multi_sentence + policy_penalty + path_penalty + markup_penalty + machine_pool_penalty + framework_penalty + code_penalty + licence_penalty + label_array_penalty + url_penalty + log_penalty)) AS total FROM parted))"""
#: every(app_id, kind, provider, evidence, severity, source_file, and the order c, d, s, r, h): the findings of the kinds that SQL finds, before they are made one an evidence
EVERY = f"""{_SECRETS}, {_RAG_SQL.removeprefix(SOURCES + ",")}, {LEX.removeprefix(SOURCES + ",")},
 every AS (SELECT app_id, CASE WHEN is_endpoint THEN 'llm_endpoint' ELSE 'llm_sdk_reference' END AS kind, provider, matched AS evidence, 'info' AS severity, source_file, -CASE WHEN is_endpoint THEN 0.9 ELSE 0.7 END::DOUBLE AS c, 0 AS d, source_idx AS s, rule_idx AS r, hit_idx AS h FROM lex
 UNION ALL SELECT app_id, 'secret', CASE WHEN g THEN 'google_gemini' ELSE provider END, matched, CASE WHEN g THEN 'high' ELSE severity END, source_file, -base, 1, source_idx, rule_idx, 0 FROM (SELECT *, title = '{D.UNKNOWN_GOOGLE}' AND app_id IN (SELECT app_id FROM lex WHERE provider = 'google_gemini') AS g FROM secrets)
 UNION ALL SELECT app_id, 'rag_artefact', NULL, evidence, severity, source_file, -confidence, 4, source_idx, rule_idx, 0 FROM ragp JOIN sources USING (app_id, source_idx) UNION ALL SELECT app_id, 'rag_artefact', NULL, matched, severity, source_file, -confidence, 4, source_idx, rule_idx + {len(_RAG)}, 0 FROM ragc JOIN sources USING (app_id, source_idx))"""
_TERMS = values([(i, t) for i, t in enumerate(rules.EVIDENCE_TERMS)])
_HINTS = " OR ".join(f"contains(lower(line), '{h}')" for h in rules.SDK_HINTS)

QUERIES = {f.__name__: f for f in (
    i1_lexical_endpoints, i2_lexical_sdk, e5_first_seen_providers, c2_structural_evidence, i3_structural_invocation, i4_structural_json_body, b3_llm_confirmed,
    b2_llm_lexical_rule, i5_lexical_findings, e1_dedup_findings, d1_severity_histogram, c1_rules_x_sources, i8_rag_paths, i9_rag_content, i6_prompt_components,
    i6_system_prompts, h10_printable_runs, i7_tool_schemas, is_credentials, i10_scan_app, i10_scan_kinds, g4_findings_union, c6_gemini_corroboration, h15_classify_prompt,
    d24_prompt_rollup, d22_host_counts, b5_host_interesting, f4_snippets, h13_snippet, f3_sdk_paths, e8_container_class, b10_non_dex, h8_paths, i12_audit_patterns, i12_audit, d25_audit_partition,
)}

ORACLE_SQL = {
    "i1_lexical_endpoints": f"WITH {LEX} SELECT app_id, source_idx, source_file, rule_idx, provider, hit_idx, matched FROM lex WHERE is_endpoint",
    "i2_lexical_sdk": f"WITH {LEX} SELECT app_id, source_idx, source_file, rule_idx, provider, hit_idx, matched FROM lex WHERE NOT is_endpoint",
    "e5_first_seen_providers": f"WITH {LEX}, {PROVIDERS} SELECT app_id, providers FROM prov",
    "c2_structural_evidence": f"WITH {LEX}, {STRUCT} SELECT app_id, provider, source_idx, source_file, pattern_idx, kind, detail FROM struct",
    "i3_structural_invocation": f"WITH {LEX}, {STRUCT} SELECT app_id, provider, pattern_idx, count(*) AS n FROM struct WHERE kind = 'invocation' GROUP BY ALL",
    "i4_structural_json_body": f"WITH {LEX}, {STRUCT} SELECT app_id, pattern_idx, count(*) AS n FROM struct WHERE kind = 'json_body' GROUP BY ALL",
    "b3_llm_confirmed": f"WITH {LEX}, {INTEGRATION} SELECT * FROM integ",
    "b2_llm_lexical_rule": f"WITH {LEX}, {INTEGRATION} SELECT app_id, n_sdk, quorum FROM integ",
    "i5_lexical_findings": f"WITH {LEX}, {LEXICAL_FINDINGS} SELECT app_id, kind, severity, provider, evidence, confidence, file_path FROM found",
    "e1_dedup_findings": f"""WITH {LEX}, {LEXICAL_FINDINGS} SELECT app_id, kind, provider, evidence, max(confidence) AS confidence, arg_min(file_path, (-confidence, source_idx, rule_idx, hit_idx)) AS file_path,
 CASE WHEN count(*) > 1 THEN count(*) END AS occurrences, CASE WHEN count(*) > 1 THEN string_agg(DISTINCT file_path, '|' ORDER BY file_path) END AS locations FROM found GROUP BY ALL""",
    "d1_severity_histogram": f"""WITH {_RAG_SQL}, {LEX.removeprefix(SOURCES + ",")}, every AS (SELECT DISTINCT app_id, is_endpoint::VARCHAR AS kind, provider, matched AS evidence, 'info' AS severity FROM lex
 UNION ALL SELECT app_id, 'rag', NULL, evidence, arg_min(severity, -confidence) FROM (SELECT app_id, evidence, severity, confidence FROM ragp UNION ALL SELECT app_id, matched, severity, confidence FROM ragc) GROUP BY app_id, evidence)
 SELECT app_id, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical FROM every GROUP BY 1""",
    "c1_rules_x_sources": f"WITH {LEX} SELECT rule_idx, provider, count(*) AS n_hits, count(DISTINCT app_id) AS n_apps FROM lex GROUP BY ALL",
    "i8_rag_paths": f"WITH {_RAG_SQL} SELECT * EXCLUDE (rule_idx) FROM ragp",
    "i9_rag_content": f"WITH {_RAG_SQL} SELECT * EXCLUDE (rule_idx) FROM ragc",
    "g4_findings_union": f"""WITH {_RAG_SQL}, {LEX.removeprefix(SOURCES + ",")} SELECT kind, severity, count(*) AS n FROM (SELECT CASE WHEN is_endpoint THEN 'llm_endpoint' ELSE 'llm_sdk_reference' END AS kind, 'info' AS severity FROM lex
 UNION ALL SELECT 'rag_artefact', severity FROM ragp UNION ALL SELECT 'rag_artefact', severity FROM ragc) GROUP BY ALL""",
    "c6_gemini_corroboration": f"""WITH {LEX} SELECT app_id, CASE WHEN g THEN 'google_gemini' ELSE 'generic' END AS provider, CASE WHEN g THEN 'high' ELSE 'medium' END AS severity, count(*) AS n
 FROM (SELECT app_id, app_id IN (SELECT app_id FROM lex WHERE provider = 'google_gemini') AS g FROM sources) GROUP BY ALL""",
    "is_credentials": f"""WITH {_SECRETS} SELECT app_id, source_idx, title, provider, severity, 'fp:' || left(sha256(matched), 16) || ' len:' || length(matched) AS evidence,
 round(base * pow(0.5, (regexp_matches(matched, {_re(rules.PLACEHOLDER.removeprefix("(?i)"))}))::INT + (bits < 3.0)::INT), 4) AS confidence FROM
 (SELECT *, (SELECT sum(-n / length(matched) * log2(n / length(matched))) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(matched, '')) AS c) GROUP BY c)) AS bits FROM secrets)""",
    "i10_scan_kinds": f"""WITH {EVERY}, {PROVIDERS}, {INTEGRATION},
 once AS (SELECT app_id, kind, provider, evidence, arg_min(severity, (c, d, s, r, h)) AS severity, count(*) AS occurrences FROM every GROUP BY ALL)
 SELECT o.*, confirmed, n_structural, providers FROM (SELECT app_id, kind, provider, severity, count(*) AS n, sum(occurrences)::BIGINT AS occurrences FROM once GROUP BY ALL) o LEFT JOIN integ USING (app_id) LEFT JOIN prov USING (app_id)""",
    "i6_system_prompts": f"WITH {SOURCES}, {PROMPTS} SELECT app_id, source_idx, 'system_prompt' AS kind, 'medium' AS severity, left(run, 200) AS evidence, score AS confidence, source_file AS file_path FROM prompts WHERE score >= {rules.PROMPT_THRESHOLD}",
    "i6_prompt_components": f"WITH {SOURCES}, {PROMPTS} SELECT app_id, source_idx, hit_idx::INT AS hit_idx, md5(run) AS run, length, opener_part AS opener, role_language, template_slots, multi_sentence, policy_penalty, path_penalty, url_penalty, strong, score FROM prompts",
    "h10_printable_runs": f"""WITH {SOURCES}, r AS (SELECT source_idx, list_filter(regexp_split_to_array(content, '[\\pC\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> '') AS runs FROM sources)
 SELECT source_idx, len(runs) AS n_runs, coalesce(list_max(list_transform(runs, lambda x: length(x))), 0) AS longest FROM r""",
    "h15_classify_prompt": f"WITH {_CLASSES} SELECT source_idx, class, first_person, second_person, confidential, role_binding, white_label FROM classed",
    "d24_prompt_rollup": f"""WITH {_CLASSES} SELECT app_id, bool_or(class = 'system_prompt') AS system, bool_or(class = 'preset') AS preset, bool_or(confidential) AS confidential, bool_or(role_binding) AS role_binding,
 bool_or(white_label) AS white_label, bool_or(class = 'preset') AND NOT bool_or(class = 'system_prompt') AS preset_only FROM classed GROUP BY 1""",
    "d22_host_counts": f"WITH {_HOSTS} SELECT * FROM (SELECT app_id, host, n, row_number() OVER (PARTITION BY app_id ORDER BY n DESC, host) AS rank FROM (SELECT app_id, host, count(*) AS n FROM judged WHERE interesting GROUP BY app_id, host)) WHERE rank <= 40",
    "b5_host_interesting": f"WITH {_HOSTS} SELECT host, count(*) AS n, any_value(interesting) AS interesting FROM judged GROUP BY 1",
    "f4_snippets": f"""WITH {SOURCES}, terms(i, term) AS {_TERMS} SELECT * FROM (SELECT app_id, source_idx, term, row_number() OVER (PARTITION BY app_id ORDER BY source_idx, i) AS rank FROM sources, terms WHERE contains(lower(content), term)) WHERE rank <= 40""",
    "h13_snippet": f"""WITH {SOURCES}, p AS (SELECT source_idx, content, strpos(lower(content), 'openai') AS pos FROM sources) SELECT source_idx, trim(replace(substr(content, greatest(1, pos - 60), pos + 66 - greatest(1, pos - 60)), chr(10), ' ')) AS snippet FROM p WHERE pos > 0""",
    "f3_sdk_paths": f"""WITH {SOURCES}, l AS (SELECT app_id, unnest(string_split(content, chr(10))) AS line FROM sources), k AS (SELECT DISTINCT app_id, trim(line) AS line FROM l WHERE length(line) < 200 AND ({_HINTS}) AND (contains(line, '/') OR contains(line, '.')))
 SELECT * FROM (SELECT app_id, line, row_number() OVER (PARTITION BY app_id ORDER BY line) AS rank FROM k) WHERE rank <= 40""",
    "e8_container_class": f"WITH {SOURCES} SELECT {CONTAINER} AS container, count(*) AS n FROM sources GROUP BY 1",
    "b10_non_dex": f"WITH {SOURCES} SELECT split_part(source_file, '/', 1) AS top, count(*) AS n FROM sources WHERE NOT regexp_full_match(split_part(source_file, '/', -1), 'classes\\d*\\.dex') GROUP BY 1",
    "h8_paths": f"SELECT page_id, split_part(url, '/', -1) AS base, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') END AS dir, split_part(url, '/', 1) AS top, regexp_matches(lower(url), '\\.({'|'.join(S.MEDIA)})$') AS media FROM pages",
    "i12_audit_patterns": f"WITH {SOURCES}, wide(name, re) AS {values(rules.AUDIT)} SELECT app_id, name, count(*) AS n FROM sources, wide WHERE regexp_matches(content, re) GROUP BY ALL",
    "i12_audit": f"WITH {_AUDIT_SQL} SELECT * FROM verdicts",
    "d25_audit_partition": f"WITH {_AUDIT_SQL} SELECT count(*) AS audited, count(*) FILTER (verdict = 'AGREE') AS agree, count(*) FILTER (verdict = 'EMPTY-BUT-SIGNAL') AS empty_but_signal, count(*) FILTER (verdict = 'WEAK') AS weak FROM verdicts",
}
