"""Shares over a whole scan's findings as queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry import rules
from textquarry.operators import detectors as D
from textquarry.operators import prevalence as P
from textquarry.plans.corpus import _interval
from textquarry.plans.detection import EVERY, INTEGRATION, PROMPTS, _first, _re
from textquarry.plans.overlay import sources


def _memberships(spark, d):
    src = sources(spark, d)
    found, _, integ = D.scan(src)
    return P.memberships(found, integ, src)


def d17_prevalence_of_findings(spark, d):
    """Ten shares of the integrated applications, from the findings of a whole scan."""
    return P.prevalence(_memberships(spark, d))


def d18_sensitivity_of_findings(spark, d):
    """What applications that were not confirmed, but hold a provider's credential, would change."""
    return P.sensitivity(_memberships(spark, d))


def d19_co_occurrence_of_findings(spark, d):
    """Credentials and system prompts in the same application."""
    return P.co_occurrence(_memberships(spark, d))


def g1_sets_of_findings(spark, d):
    """Union, intersection and differences of applications' sets, by application."""
    both = P.CREDENTIAL | P.SYSTEM_PROMPT
    return _memberships(spark, d).select("app_id", P.any_of(P.ARTEFACT).alias("artefact"), P.all_of(both).alias("credential_and_prompt"), (F.col("confirmed") & ~P.any_of(P.ARTEFACT)).alias("proxied"), (P.any_of(P.PROVIDER_BITS) & ~P.only(P.AMBIGUOUS)).alias("attributed"))


_CLASS = f"CASE WHEN confidential THEN 'system_prompt' WHEN f > 0 AND s = 0 THEN 'preset' WHEN s > 0 AND f = 0 THEN 'system_prompt' WHEN f > 0 AND f < s THEN 'preset' WHEN f > 0 THEN 'system_prompt' ELSE 'unclassified' END"
_DEX = "regexp_full_match(split_part(source_file, '/', -1), 'classes\\d*\\.dex')"
#: members(app_id, confirmed, cred, other, sys, preset, tool, rag, endpoint, outside, of): of lists the providers of credentials. All marks of tools lie in objects here, so each is a finding.
MEMBERS = f"""{EVERY}, {INTEGRATION}, {PROMPTS},
 classed AS (SELECT *, {_CLASS} AS class FROM (SELECT *, {_first(rules.FIRST_PERSON)} AS f, {_first(rules.SECOND_PERSON)} AS s, regexp_matches(content, {_re(rules.CONFIDENTIAL)}) AS confidential FROM (SELECT app_id, source_idx, source_file, hit_idx, score, left(run, 200) AS content FROM prompts WHERE score >= {rules.PROMPT_THRESHOLD}))),
 found AS (SELECT app_id, kind, provider, evidence, source_file, c, d, s, r, h, NULL AS class FROM every UNION ALL SELECT app_id, 'system_prompt', NULL, content, source_file, -score, 2, source_idx, 0, hit_idx, class FROM classed
  UNION ALL SELECT app_id, 'tool_schema', NULL, source_idx::VARCHAR, source_file, 0, 3, source_idx, 0, 0, NULL FROM sources WHERE regexp_matches(content, '{rules.TOOL_SHORT}') OR regexp_matches(content, '{rules.TOOL_INPUT}')),
 once AS (SELECT app_id, kind, provider, evidence, arg_min(source_file, (c, d, s, r, h)) AS source_file, any_value(class) AS class FROM found GROUP BY ALL),
 flags AS (SELECT app_id, bool_or(kind = 'secret' AND provider <> 'generic') AS cred, bool_or(kind = 'secret' AND provider = 'generic') AS other, bool_or(coalesce(class, '') = 'system_prompt') AS sys, bool_or(coalesce(class, '') = 'preset') AS preset, bool_or(kind = 'tool_schema') AS tool,
  bool_or(kind = 'rag_artefact') AS rag, bool_or(kind = 'llm_endpoint') AS endpoint, bool_or(source_file <> '' AND NOT {_DEX}) AS outside, coalesce(list(DISTINCT provider) FILTER (kind = 'secret' AND provider <> 'generic'), []) AS of FROM (SELECT app_id, kind, coalesce(provider, 'none') AS provider, source_file, class FROM once) GROUP BY 1),
 members AS (SELECT app_id, coalesce(confirmed, false) AS confirmed, coalesce(cred, false) AS cred, coalesce(other, false) AS other, coalesce(sys, false) AS sys, coalesce(preset, false) AS preset, coalesce(tool, false) AS tool, coalesce(rag, false) AS rag, coalesce(endpoint, false) AS endpoint, coalesce(outside, false) AS outside, coalesce(of, []) AS of,
  coalesce(cred OR sys OR tool OR rag, false) AS artefact FROM (SELECT DISTINCT app_id FROM sources) LEFT JOIN integ USING (app_id) LEFT JOIN flags USING (app_id))"""
_ROUNDED = "SELECT category, successes, n, round(proportion, 4) AS proportion, round(ci_lower, 4) AS ci_lower, round(ci_upper, 4) AS ci_upper, round(ci_upper - ci_lower, 4) AS ci_width FROM i"
_SETS = {"inference_credential": "cred", "other_secret": "other", "system_prompt": "sys", "preset_only": "preset AND NOT sys", "tool_schema": "tool", "rag_artefact": "rag", "llm_endpoint": "endpoint", "any_artefact": "artefact", "no_artefact": "NOT artefact", "finding_outside_dex": "outside"}
_ONE = " UNION ALL ".join(f"SELECT '{k}' AS category, count(*) FILTER ({v}) AS successes, count(*) AS n FROM members WHERE confirmed" for k, v in _SETS.items())
_HIT, _AWS = "NOT confirmed AND len(of) > 0", "NOT confirmed AND of = ['aws_bedrock']"
_WIDE = f"""t AS (SELECT count(*) AS scanned, count(*) FILTER (confirmed) AS n, count(*) FILTER ({_HIT}) AS hit, count(*) FILTER ({_AWS}) AS aws, count(*) FILTER (confirmed AND cred) AS cred, count(*) FILTER (confirmed AND artefact) AS art FROM members),
 c AS (SELECT unnest(['rejected_with_provider_credential', 'ambiguous_only', 'unambiguous_credential', 'integration', 'inference_credential', 'any_artefact']) AS category, unnest([hit, aws, hit - aws, n + hit - aws, cred + hit - aws, art + hit - aws]) AS successes, unnest([scanned - n, scanned - n, scanned - n, scanned, n + hit - aws, n + hit - aws]) AS n FROM t)"""

QUERIES = {f.__name__: f for f in (d17_prevalence_of_findings, d18_sensitivity_of_findings, d19_co_occurrence_of_findings, g1_sets_of_findings)}
ORACLE_SQL = {
    "d17_prevalence_of_findings": f"WITH {MEMBERS}, c AS ({_ONE}), i AS (SELECT *, {_interval('1.0')} FROM c) {_ROUNDED}",
    "d18_sensitivity_of_findings": f"WITH {MEMBERS}, {_WIDE}, i AS (SELECT *, {_interval('1.0')} FROM c) {_ROUNDED}",
    "d19_co_occurrence_of_findings": f'WITH {MEMBERS} SELECT count(*) FILTER (cred) AS "first", count(*) FILTER (cred AND sys) AS "both", CASE WHEN count(*) FILTER (cred) > 0 THEN round(count(*) FILTER (cred AND sys) / count(*) FILTER (cred), 4) END AS share FROM members WHERE confirmed',
    "g1_sets_of_findings": f"WITH {MEMBERS} SELECT app_id, artefact, cred AND sys AS credential_and_prompt, confirmed AND NOT artefact AS proxied, len(of) > 0 AND of <> ['aws_bedrock'] AS attributed FROM members",
}
