"""Detectors over sources(app_id, source_idx, source_file, content).

Texts are read in one pass (`matching`): an automaton of all literals marks the
rules that may match, and one projection applies those alone. Only the small rows
of matches are shuffled by application, never the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry import rules
from textquarry.functions import scalars as S
from textquarry.operators import matching as M
from textquarry.operators.tools import TOOL, find_tools
from textquarry.sources.staging import staged

KEYS = ["app_id", "source_idx", "source_file"]
#: The order of detectors, which breaks ties between findings.
LEXICAL, SECRETS, PROMPTS, SCHEMAS, RAG = range(5)


Family = list[tuple[str, str, dict[str, object]]]


def _rules(family: Family, number: int = 0, take: int = M.EVERY) -> list[M.Rule]:
    return M.rules_of(number, [(plain, java) for plain, java, _ in family], take)


def _valued(hits: DataFrame, family: Family, *columns: str) -> DataFrame:
    """Matches with their rules' values, looked up in the catalogue by rule_idx."""
    names = list(family[0][2])
    kinds = {str: "string", bool: "boolean", int: "int", float: "double"}
    types = [kinds[type(next((v[n] for _, _, v in family if v[n] is not None), ""))] for n in names]
    listed = M.constant([v for _, _, v in family], ", ".join(f"{n}: {t}" for n, t in zip(names, types, strict=True)))
    return hits.withColumn("_v", F.get(listed, F.col("rule_idx"))).select(*KEYS, "rule_idx", *[F.col(f"_v.{n}").alias(n) for n in names], *columns)


def _hits(sources: DataFrame, family: Family, places: bool = False) -> DataFrame:
    """A row for each match of each (pattern, its Java form, values) of a family in content: keys, rule_idx, the values, hit_idx and matched, and with places their offset."""
    found = M.hits(sources, _rules(family, take=M.PLACES if places else M.EVERY), KEYS)
    return _valued(found, family, "hit_idx", "matched", *(["offset"] if places else []))


def lexical_family(endpoints=None, sdks=None) -> list[tuple[str, str, dict[str, object]]]:
    endpoints = rules.ENDPOINTS if endpoints is None else endpoints
    sdks = rules.SDK_NAMESPACES if sdks is None else sdks
    out = [(p, S.java(p, ic), {"provider": who, "pattern": p, "is_endpoint": True}) for who, p, ic in endpoints]
    return out + [(x.replace(".", "\\."), rf"\Q{x}\E(?![\p{{L}}\p{{N}}_])", {"provider": who, "pattern": x, "is_endpoint": False}) for who, x in sdks]


def lexical_matches(sources: DataFrame, endpoints=None, sdks=None) -> DataFrame:
    """Endpoint and SDK matches (rules of one's own replace the defaults, and an empty list means none)."""
    family = lexical_family(endpoints, sdks)
    return _hits(sources, family) if family else sources.limit(0).select(*KEYS, F.lit(0).alias("rule_idx"), *[F.lit("").alias(x) for x in ("provider", "pattern")], F.lit(True).alias("is_endpoint"), F.lit(0).alias("hit_idx"), F.lit("").alias("matched"))


def detected_providers(lexical: DataFrame) -> DataFrame:
    """Each application's distinct providers by first appearance: endpoints of a source before its SDKs, rules in order."""
    first = lexical.groupBy("app_id", "provider").agg(F.min(F.struct("source_idx", "rule_idx", "hit_idx")).alias("first"))
    listed = first.groupBy("app_id").agg(F.sort_array(F.collect_list(F.struct("first", "provider"))).alias("p"))
    return listed.select("app_id", F.transform("p", lambda x: x["provider"]).alias("detected_providers"))


def structural_family(invocations=None, bodies=None) -> Family:
    tests = [("invocation", who, p) for who, p in (rules.INVOCATIONS if invocations is None else invocations)] + [("json_body", None, p) for p in (rules.JSON_BODIES if bodies is None else bodies)]
    return [(p, p, {"kind": kind, "provider": who, "detail": p}) for kind, who, p in tests]


def _scoped(rows: DataFrame, providers: DataFrame) -> DataFrame:
    """Of structural evidence, invocations of providers detected in the application, and request bodies of any provider."""
    known = providers.select("app_id", F.explode("detected_providers").alias("provider"))
    scoped = rows.filter("kind = 'invocation'").join(known, ["app_id", "provider"], "left_semi")
    return scoped.unionByName(rows.filter("kind = 'json_body'"))


def structural_evidence(sources: DataFrame, providers: DataFrame, invocations=None, bodies=None) -> DataFrame:
    """One row per source and pattern that occurs: invocations of providers detected in the application, and request bodies of any provider."""
    family = structural_family(invocations, bodies)
    if not family:
        return sources.limit(0).select(*KEYS, F.lit(0).alias("pattern_idx"), *[F.lit("").alias(x) for x in ("kind", "provider", "detail")])
    found = M.hits(sources, _rules(family, take=M.ANY), KEYS)
    return _scoped(_valued(found, family).withColumnRenamed("rule_idx", "pattern_idx"), providers)


def integration(lexical: DataFrame, structural: DataFrame, min_unique: int = 2) -> DataFrame:
    """Per application with a match: the confirmed rule (an endpoint, or a lexical and a structural sign) and the older quorum rule."""
    lex = lexical.groupBy("app_id").agg(F.bool_or("is_endpoint").alias("has_endpoint"), F.count("*").alias("n_lexical"), F.count_distinct(F.when(~F.col("is_endpoint"), F.col("matched"))).alias("n_sdk"))
    both = lex.join(structural.groupBy("app_id").agg(F.count("*").alias("n_structural")), "app_id", "left").withColumn("n_structural", F.coalesce("n_structural", F.lit(0)))
    return both.withColumns({"confirmed": F.col("has_endpoint") | (F.col("n_structural") > 0), "quorum": F.col("has_endpoint") | (F.col("n_sdk") >= min_unique)})


FINDING = ["app_id", "kind", "severity", "title", "description", "provider", "file_path", "offset", "container", "evidence", "confidence", "detector_idx", "source_idx", "rule_idx", "hit_idx"]


def _finding(rows: DataFrame, detector: int, **columns) -> DataFrame:
    given = {"provider": F.lit(None).cast("string"), "file_path": F.col("source_file"), "offset": F.lit(None).cast("int"), "container": F.lit(None).cast("string"), "detector_idx": F.lit(detector), "rule_idx": F.lit(0), "hit_idx": F.lit(0)}
    given |= {c: F.col(c) for c in ("provider", "rule_idx", "hit_idx") if c in rows.columns} | columns
    return rows.select(*[given.get(c, F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in FINDING])


def lexical_findings(lexical: DataFrame) -> DataFrame:
    e = F.col("is_endpoint")
    return _finding(lexical, LEXICAL, kind=F.when(e, "llm_endpoint").otherwise("llm_sdk_reference"), severity=F.lit("info"), title=F.when(e, "LLM endpoint").otherwise("LLM SDK reference"), evidence=F.col("matched"), confidence=F.when(e, 0.9).otherwise(0.7))


def rag_path_matches(sources: DataFrame, paths=None) -> DataFrame:
    """Retrieval artefacts by path alone; content is never read."""
    paths = rules.RAG_PATHS if paths is None else paths
    found = F.array(*[F.when(F.col("source_file").rlike(p), F.struct(F.lit(i).alias("rule_idx"), F.lit(n).alias("name"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"))) for i, (n, p, s, c) in enumerate(paths)])
    return sources.select(*KEYS, F.explode_outer(found).alias("r")).filter("r is not null").select(*KEYS, "r.*", S.basename(F.col("source_file")).alias("evidence"), S.dirname(F.col("source_file")).alias("container"))


def rag_content_family(contents=None) -> Family:
    return [(p, p, {"name": n, "severity": s, "confidence": c}) for n, p, s, c in (rules.RAG_CONTENT if contents is None else contents)]


def rag_content_matches(sources: DataFrame, contents=None) -> DataFrame:
    """Client names in texts, with the places of their matches (offset, in code points from 0)."""
    return _hits(sources, rag_content_family(contents), places=True)


def rag_content_findings(matches: DataFrame, n_paths: int = len(rules.RAG_PATHS)) -> DataFrame:
    return _finding(matches, RAG, kind=F.lit("rag_artefact"), title=F.col("name"), evidence=F.col("matched"), offset=F.col("offset"), rule_idx=F.col("rule_idx") + n_paths)


def rag_path_findings(sources: DataFrame, paths=None) -> DataFrame:
    return _finding(rag_path_matches(sources, paths), RAG, kind=F.lit("rag_artefact"), title=F.col("name"), container=F.col("container"))


def rag_findings(sources: DataFrame, paths=None, contents=None) -> DataFrame:
    """Findings by path and by content (rules of one's own replace the defaults, and an empty list means none)."""
    n = len(rules.RAG_PATHS if paths is None else paths)
    out = [rag_path_findings(sources, paths)] if n else []
    if contents is None or contents:
        out.append(rag_content_findings(rag_content_matches(sources, contents), n))
    return reduce(DataFrame.unionByName, out) if out else _finding(sources.limit(0), RAG)


def prompt_runs(content: Column, strong_only: bool = False) -> Column:
    """The runs (hit_idx, run) of a text that pass the length gate; strong_only drops those that stay under the weak ceiling."""
    # small letters are made first, so that all tests share them
    made = F.transform(S.printable_runs(content), lambda x, k: F.struct(k.alias("hit_idx"), x.alias("run"), S.folded(x).alias("low")))
    made = F.filter(made, lambda r: S.prompt_candidate(r["run"], r["low"]))
    made = F.filter(made, lambda r: S.prompt_strong(r["run"], r["low"])) if strong_only else made
    return F.transform(made, lambda r: F.struct(r["hit_idx"].alias("hit_idx"), r["run"].alias("run")))


def prompt_scores(sources: DataFrame, strong_only: bool = False) -> DataFrame:
    """Candidate runs of every source with their scores and components; strong_only drops runs that stay under the weak ceiling before they are scored."""
    # one automaton over the whole text marks the tests that may find something in it; most texts' runs need few of them
    tests = [M.Rule(PROMPTS, k, p, tuple(map(M.folded, S.prompt_literals(p)))) for k, (p, _) in enumerate(S.PROMPT_TESTS.values())]
    marked = sources.select(*KEYS, "content", F.get(M.marks(tests, F.col("content")), F.lit(0)).alias("_bits"))
    runs = marked.select(*KEYS, "_bits", F.explode_outer(prompt_runs(F.col("content"), strong_only)).alias("_r")).filter("_r is not null").select(*KEYS, "_bits", "_r.*")
    return runs.withColumn("s", S.prompt_score(F.col("run"), F.col("source_file"), bits=F.col("_bits"))).select(*KEYS, "hit_idx", "run", "s.*")


def _prompt_findings(scores: DataFrame, threshold: float) -> DataFrame:
    rows = scores.filter(F.col("score") >= threshold)
    return _finding(rows, PROMPTS, kind=F.lit("system_prompt"), severity=F.lit("medium"), title=F.lit("Embedded system prompt"), evidence=F.left("run", F.lit(200)), confidence=F.col("score"))


def prompt_findings(sources: DataFrame, threshold: float = rules.PROMPT_THRESHOLD) -> DataFrame:
    return _prompt_findings(prompt_scores(sources, strong_only=threshold > rules.WEAK_CEILING), threshold)


def tool_schemas(sources: DataFrame) -> DataFrame:
    """Tool schemas of the sources with a trace of one."""
    some = sources.filter(F.col("content").rlike(rules.TOOL_SHORT) | F.col("content").rlike(rules.TOOL_INPUT))
    return some.select(*KEYS, F.posexplode_outer(find_tools(F.col("content"))).alias("hit_idx", "t")).filter("t is not null").select(*KEYS, "hit_idx", "t.*")


def _tool_findings(schemas: DataFrame) -> DataFrame:
    full = F.col("rule_idx") < 2
    return _finding(schemas, SCHEMAS, kind=F.lit("tool_schema"), severity=F.when(full, "medium").otherwise("low"), title=F.when(full, "Embedded tool/function schema").otherwise("Possible tool schema fragment"), offset=F.col("offset"))


def tool_findings(sources: DataFrame) -> DataFrame:
    return _tool_findings(tool_schemas(sources))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - F.size(F.filter(chars, lambda x: x == c)) / F.size(chars) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)))


def credential_family() -> Family:
    return [(p, p, {"title": n, "provider": who, "severity": s, "base": c}) for n, who, p, s, c in rules.CREDENTIALS]


def credential_findings(sources: DataFrame, least_entropy: float = 3.0) -> DataFrame:
    """Credential-shaped strings, by rules of our own. Evidence is a fingerprint with the length, never the string."""
    return _credential_findings(_hits(sources, credential_family()), least_entropy)


def _credential_findings(found: DataFrame, least_entropy: float = 3.0) -> DataFrame:
    weak = F.col("matched").rlike(rules.PLACEHOLDER).cast("int") + (entropy(F.col("matched")) < least_entropy).cast("int")
    shown = F.concat(F.lit("fp:"), S.fingerprint(F.col("matched")), F.lit(" len:"), F.length("matched"))
    return _finding(found, SECRETS, kind=F.lit("secret"), title=F.col("title"), severity=F.col("severity"), evidence=shown, confidence=F.round(F.col("base") * F.pow(F.lit(0.5), weak), 4))


UNKNOWN_GOOGLE = "Google API key (service unknown)"
#: What is added to the description of a key that is attributed.
ATTRIBUTED = " Attributed to Gemini, which this application addresses too."


def promote_google(findings: DataFrame, providers: DataFrame) -> DataFrame:
    """Google keys of applications in which Gemini was detected are attributed to it, with high severity."""
    flag = providers.select("app_id", F.array_contains("detected_providers", "google_gemini").alias("_g"))
    joined = findings.join(flag, "app_id", "left")
    hit = F.coalesce(F.col("_g"), F.lit(False)) & (F.col("title") == UNKNOWN_GOOGLE) & (F.col("kind") == "secret")
    return joined.withColumns({"provider": F.when(hit, "google_gemini").otherwise(F.col("provider")), "severity": F.when(hit, "high").otherwise(F.col("severity")), "description": F.when(hit, F.concat(F.coalesce("description", F.lit("")), F.lit(ATTRIBUTED))).otherwise(F.col("description"))}).drop("_g")


ORDER = ["detector_idx", "source_idx", "rule_idx", "hit_idx"]


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One finding per application, kind, provider and evidence: the most confident, of those the first; with occurrences and locations if there are more."""
    best = F.min_by(F.struct(*[c for c in findings.columns if c not in ("app_id", "kind", "provider", "evidence")]), F.struct((-F.col("confidence")).alias("c"), *ORDER))
    grouped = findings.groupBy("app_id", "kind", "provider", "evidence").agg(best.alias("b"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("file_path") != "", F.col("file_path")))).alias("l"))
    many = F.col("n") > 1
    return grouped.select("app_id", "kind", "provider", "evidence", "b.*", F.when(many, F.col("n")).alias("occurrences"), F.when(many, F.col("l")).alias("locations"))


class Scanner(Protocol):
    """A detector of one's own: stateless, from sources to findings (columns FINDING)."""

    def __call__(self, sources: DataFrame) -> DataFrame: ...


#: Families of rules in the scan's one pass, besides detectors' numbers.
STRUCTURAL, RAG_FILE = 5, 6
_SEEN = "family int, rule_idx int, hit_idx int, matched string, offset int, confidence double"


def one_pass(sources: DataFrame, lexical_only: bool = False, threshold: float = rules.PROMPT_THRESHOLD) -> DataFrame:
    """A row (keys, family, rule_idx, hit_idx, matched, offset, confidence) for all that the detectors see in the sources, which are read once.

    One automaton marks the candidates of all families, also texts that may hold a
    strong prompt or a tool definition; one projection gathers the matches.
    """
    listed = _rules(lexical_family(), LEXICAL) + _rules(structural_family(), STRUCTURAL, M.ANY)
    if lexical_only:
        return M.hits(sources, listed, KEYS).withColumn("confidence", F.lit(None).cast("double"))
    listed += _rules(credential_family(), SECRETS) + _rules(rag_content_family(), RAG, M.PLACES)
    hints = {PROMPTS: [rules.PROMPT_OPENERS, rules.PROMPT_OPENERS_INTL, rules.PROMPT_MARKERS, rules.TEMPLATE_SLOT], SCHEMAS: [rules.TOOL_SHORT, rules.TOOL_INPUT]}
    of = {family: [M.Rule(family, k, p, tuple(S.anchors(p))) for k, p in enumerate(patterns)] for family, patterns in hints.items()}
    every = [*listed, *of[PROMPTS], *of[SCHEMAS]]

    def hinted(family: int) -> Column:
        return reduce(Column.__or__, [M.marked(F.col("_bits"), k) for k, r in enumerate(every) if r.family == family])

    def seen(family: int, rule_idx: Column, hit_idx: Column, matched: Column, offset: Column, confidence: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), rule_idx.cast("int").alias("rule_idx"), hit_idx.cast("int").alias("hit_idx"), matched.alias("matched"), offset.cast("int").alias("offset"), confidence.cast("double").alias("confidence"))

    null, kind = F.lit(None), f"array<struct<{_SEEN.replace(' int', ': int').replace(' string', ': string').replace(' double', ': double')}>>"
    strong_only = threshold > rules.WEAK_CEILING
    runs = prompt_runs(F.col("content"), strong_only)
    marked = sources.select(*KEYS, "content", M.marks(every, F.col("content")).alias("_bits"))
    marked = marked.withColumn("_tools", find_tools(F.when(hinted(SCHEMAS), F.col("content"))))
    by_rule = F.transform(M.matches(F.col("_bits"), F.col("content"), listed), lambda m: F.struct(m["family"].alias("family"), m["rule_idx"].alias("rule_idx"), m["hit_idx"].alias("hit_idx"), m["matched"].alias("matched"), m["offset"].alias("offset"), null.cast("double").alias("confidence")))
    by_run = F.transform(F.when(hinted(PROMPTS), runs).otherwise(F.array().cast("array<struct<hit_idx:int,run:string>>")) if strong_only else runs, lambda r: seen(PROMPTS, F.lit(0), r["hit_idx"], r["run"], null, null))
    by_tool = F.transform(F.coalesce("_tools", F.array().cast(TOOL)), lambda t, k: seen(SCHEMAS, t["rule_idx"], k, t["evidence"], t["offset"], t["confidence"]))
    by_path = F.filter(F.array(*[F.when(F.col("source_file").rlike(p), seen(RAG_FILE, F.lit(k), F.lit(0), null.cast("string"), null, null)) for k, (_, p, _, _) in enumerate(rules.RAG_PATHS)]), lambda x: x.isNotNull())
    found = F.concat(*[F.coalesce(x, F.array().cast(kind)) for x in (by_rule, by_run, by_tool, by_path)])
    return marked.select(*KEYS, F.explode_outer(found).alias("_m")).filter("_m is not null").select(*KEYS, "_m.*")


def scan(sources: DataFrame, scanners: Sequence[Scanner] | None = None, keep: Callable[[DataFrame], DataFrame] = staged, threshold: float = rules.PROMPT_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole scan: deduplicated findings, detected providers and integration per application.

    The texts are read once; keep() stages the small rows of what was seen in them,
    from which all results are made. Scanners of one's own replace the default
    detectors but the lexical one, and read the texts themselves.
    """
    seen = keep(one_pass(sources, scanners is not None, threshold))
    lexical = _valued(seen.filter(F.col("family") == LEXICAL), lexical_family(), "hit_idx", "matched")
    providers = keep(detected_providers(lexical))
    found = [lexical_findings(lexical)]
    if scanners is None:
        of = {family: seen.filter(F.col("family") == family) for family in (SECRETS, PROMPTS, SCHEMAS, RAG, RAG_FILE)}
        scores = of[PROMPTS].withColumnRenamed("matched", "run").withColumn("score", S.prompt_score(F.col("run"), F.col("source_file"))["score"])
        paths = M.constant([{"name": n, "severity": s, "confidence": c} for n, _, s, c in rules.RAG_PATHS], "name: string, severity: string, confidence: double")
        by_path = of[RAG_FILE].withColumn("_v", F.get(paths, F.col("rule_idx"))).select(*KEYS, "rule_idx", "_v.*", S.basename(F.col("source_file")).alias("evidence"), S.dirname(F.col("source_file")).alias("container"))
        found += [
            _credential_findings(_valued(of[SECRETS], credential_family(), "hit_idx", "matched")),
            _prompt_findings(scores, threshold),
            _tool_findings(of[SCHEMAS].withColumnRenamed("matched", "evidence")),
            _finding(by_path, RAG, kind=F.lit("rag_artefact"), title=F.col("name"), container=F.col("container")),
            rag_content_findings(_valued(of[RAG], rag_content_family(), "hit_idx", "matched", "offset")),
        ]
    else:
        found += [scanner(sources).select(*FINDING) for scanner in scanners]
    findings = dedup_findings(promote_google(reduce(DataFrame.unionByName, found), providers))
    structural = _valued(seen.filter(F.col("family") == STRUCTURAL), structural_family()).withColumnRenamed("rule_idx", "pattern_idx")
    return findings, providers, integration(lexical, _scoped(structural, providers))


def audit_family(patterns=None) -> Family:
    return [(p, p, {"name": n}) for n, p in (rules.AUDIT if patterns is None else patterns)]


def audit_matches(sources: DataFrame, patterns=None) -> DataFrame:
    """One row for each source and pattern of the audit's wider net that occurs in it, whatever the detectors say."""
    family = audit_family(patterns)
    return _valued(M.hits(sources, _rules(family, take=M.ANY), KEYS), family).select(*KEYS, "name")


def occurring(sources: DataFrame, families: dict[int, Family]) -> DataFrame:
    """One row (keys, family, rule_idx) for each source and rule that occurs in it, of all families in one read."""
    return M.hits(sources, [r for number, family in families.items() for r in _rules(family, number, M.ANY)], KEYS).select(*KEYS, "family", "rule_idx")


def audit_signals(sources: DataFrame) -> DataFrame:
    """Applications with whether the audit saw a strong signal in them."""
    seen = audit_matches(sources, [(n, p) for n, p in rules.AUDIT if n.startswith(tuple(rules.AUDIT_STRONG))]).select("app_id").distinct().withColumn("signal", F.lit(True))
    return sources.select("app_id").distinct().join(seen, "app_id", "left").withColumn("signal", F.coalesce("signal", F.lit(False)))


def severity_histogram(findings: DataFrame) -> DataFrame:
    """Findings by severity of each application, zeros included, in one pass."""
    return findings.groupBy("app_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES])


def prompt_rollup(classified: DataFrame) -> DataFrame:
    """Flags over an application's strings (app_id, c): system, preset, preset_only, confidential, role_binding, white_label."""
    flags = classified.groupBy("app_id").agg(F.bool_or(F.col("c.class") == "system_prompt").alias("system"), F.bool_or(F.col("c.class") == "preset").alias("preset"), *[F.bool_or(F.col(f"c.{x}")).alias(x) for x in ("confidential", "role_binding", "white_label")])
    return flags.withColumn("preset_only", F.col("preset") & ~F.col("system"))


def top_hosts(sources: DataFrame, n: int = 40) -> DataFrame:
    hosts = sources.select("app_id", F.explode_outer(S.hosts_in(F.col("content"))).alias("host")).filter(F.col("host").isNotNull()).filter(S.host_interesting(F.col("host")))
    counts = hosts.groupBy("app_id", "host").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("app_id").orderBy(F.desc("n"), "host"))).filter(F.col("rank") <= n)


def snippets(sources: DataFrame, terms=None, n: int = 40) -> DataFrame:
    """First occurrence of each term in each source, in order, at most n an application."""
    terms = rules.EVIDENCE_TERMS if terms is None else terms
    some = sources.select(*KEYS, "content", F.lower("content").alias("_low"))
    found = [f"CASE WHEN contains(_low, {S.sql(t)}) THEN named_struct('term_idx', {i}, 'term', {S.sql(t)}, 'at', locate({S.sql(t)}, _low)) END" for i, t in enumerate(terms)]
    rows = some.selectExpr(*KEYS, "content", f"explode_outer(array({', '.join(found)})) AS f").filter("f is not null").select(*KEYS, "content", "f.*")
    start = F.greatest(F.lit(1), F.col("at") - 60)
    cut = F.trim(F.replace(F.substring("content", start, F.col("at") + F.length("term") + 60 - start), F.lit("\n"), F.lit(" ")))
    rows = rows.withColumn("snippet", cut).drop("content", "at")
    rank = F.row_number().over(W.partitionBy("app_id").orderBy("source_idx", "term_idx"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def sdk_paths(sources: DataFrame, n: int = 40) -> DataFrame:
    """Sorted distinct lines with an SDK hint and a path or package sign, at most n an application."""
    lines = sources.select("app_id", F.explode_outer(F.split("content", "\r\n|\r|\n")).alias("line")).filter(F.length("line") < 200)
    kept = lines.filter(S.any_of(F.lower("line"), rules.SDK_HINTS) & (F.col("line").contains("/") | F.col("line").contains("."))).select("app_id", F.trim("line").alias("line")).distinct()
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("app_id").orderBy("line"))).filter(F.col("rank") <= n)
