"""Smaller operators as queries of their own, and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry import rules
from textquarry.functions import scalars as S
from textquarry.operators import corpus as C
from textquarry.operators import detectors as D
from textquarry.plans.corpus import _L, _TOK, APPS, INDEX, _apps, _interval, index
from textquarry.plans.detection import _CLASSES, _HOSTS, _RAG_SQL, LEX, LEXICAL_FINDINGS
from textquarry.plans.overlay import SOURCES, read, sources
from textquarry.sources.staging import new_folder


def parse_years(text: str) -> list[int]:
    """Years from '2020-2026' or '2019,2020'."""
    if "-" in text:
        a, b = map(int, text.split("-"))
        return list(range(a, b + 1))
    return [int(x) for x in text.split(",")]


def b4_media_skip(spark, d):
    return sources(spark, d).withColumn("path", F.concat("source_file", F.when(F.col("source_idx") % 4 == 0, ".PNG").otherwise(""))).groupBy(S.is_media(F.col("path")).alias("media")).agg(F.count("*").alias("n"))


def b7_high_confidence(spark, d):
    return D.lexical_findings(D.lexical_matches(sources(spark, d))).filter("confidence >= 0.85").groupBy("kind", "provider").agg(F.count("*").alias("n"))


def b12_year_parse(spark, d):
    return read(spark, d, "orders").filter(F.year("o_orderdate").isin(parse_years("1996-1998"))).groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))


def c4_detail_semi(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "customer").filter("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def c8_provider_outer(spark, d):
    """Providers in the order of declaration, those alone that some application has."""
    dim = spark.createDataFrame([(p, i) for i, p in enumerate(rules.PROVIDERS)], "provider string, ord int")
    n = _apps(spark, d).select(F.explode("providers").alias("provider")).groupBy("provider").agg(F.count("*").alias("n"))
    return dim.join(n, "provider").orderBy("ord")


def d3_by_kind(spark, d):
    f = D.lexical_findings(D.lexical_matches(sources(spark, d))).filter("confidence >= 0.7")
    apps = f.groupBy("app_id").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in rules.KINDS])
    return C.category_stats(apps, {k: F.col(k) for k in rules.KINDS}, F.lit(True))


def d17_prevalence(spark, d):
    """Ten set-valued shares of the integrated applications, with intervals and their widths, in one pass over flags by application."""
    return prevalence(sources(spark, d))


def prevalence(src):
    """d17_prevalence of these sources, whose texts are searched once for the rules of all families."""
    lexical, audit = D.lexical_family(), 7
    seen = D.occurring(src, {D.LEXICAL: lexical, D.RAG: D.rag_content_family(), audit: D.audit_family([x for x in rules.AUDIT if x[0] == "schema.tool"])})
    seen = seen.select("app_id", "source_file", "family", "rule_idx").unionByName(D.rag_path_matches(src).select("app_id", "source_file", F.lit(D.RAG_FILE).alias("family"), "rule_idx"))

    def by_rule(test):
        return (F.col("family") == D.LEXICAL) & F.col("rule_idx").isin([k for k, (_, _, values) in enumerate(lexical) if test(values)])

    tool = F.col("family") == audit
    # stand-ins for what the supplied texts lack: SDK references as credentials, of one provider as other secrets
    flags = seen.groupBy("app_id").agg(
        F.bool_or(by_rule(lambda v: not v["is_endpoint"] and v["provider"] == "openai")).alias("credential"), F.bool_or(by_rule(lambda v: not v["is_endpoint"] and v["provider"] != "openai")).alias("other"),
        F.bool_or(F.col("family").isin(D.RAG, D.RAG_FILE)).alias("rag"), F.bool_or(by_rule(lambda v: v["is_endpoint"])).alias("endpoint"),
        F.bool_or(~tool & S.not_dex(F.col("source_file"))).alias("outside"), (F.bool_or(tool) & F.col("app_id").isNotNull()).alias("tool"), F.bool_or(~tool).alias("found"),
    ).filter("found")
    prompts = D.prompt_rollup(src.select("app_id", S.classify_prompt(F.col("content")).alias("c"))).select("app_id", F.col("system").alias("prompt"), F.col("preset_only").alias("preset"))
    apps = flags.join(prompts, "app_id", "left").na.fill(False)
    c = F.col
    every = c("credential") | c("prompt") | c("tool") | c("rag")
    names = {"inference_credential": c("credential"), "other_secret": c("other"), "system_prompt": c("prompt"), "preset_only": c("preset"), "tool_schema": c("tool"), "rag_artefact": c("rag"), "llm_endpoint": c("endpoint"), "any_artefact": every, "no_artefact": ~every, "finding_outside_dex": c("outside")}
    return C.category_stats(apps, names, F.lit(True), "unit").withColumn("ci_width", F.col("ci_upper") - F.col("ci_lower"))


def e7_unique_signals(spark, d):
    return index(spark, d).select("sha256", F.array_join(F.array_distinct(S.tokenize_package(F.concat("pkg_name", F.lit("."), "pkg_name"))), " ").alias("tokens"))


def f2_top_hosts(spark, d):
    hosts = read(spark, d, "pages").select(F.explode_outer(S.hosts_in(F.concat("url", F.lit(" "), "html"))).alias("host")).filter("host is not null").filter(S.host_interesting(F.col("host")))
    return hosts.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(10)


def g5_token_intersect(spark, d):
    tokens = F.array_sort(F.array_intersect(S.tokenize_package(F.col("pkg_name")), F.array(*map(F.lit, rules.SIGNAL_TOKENS))))
    return index(spark, d).select("sha256", F.array_join(tokens, ",").alias("tokens"))


def h31_confidence_tier(spark, d):
    return read(spark, d, "lineitem").groupBy(S.confidence_tier(1 - F.col("l_discount") * 4).alias("tier")).agg(F.count("*").alias("n"))


def j1_event_stream(spark, d):
    """Events read as a stream, counted by hour and kind under a watermark, and written once; hours that the watermark hasn't passed stay open."""
    from textquarry.streaming.ledger import event_counts

    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/events.parquet*")
    folder = new_folder(spark, "stream")
    counts = event_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/out")


_KIND_SQL = ", ".join(f"count(DISTINCT app_id) FILTER (kind = '{k}')" for k in rules.KINDS)
QUERIES = {f.__name__: f for f in (b4_media_skip, b7_high_confidence, b12_year_parse, c4_detail_semi, c8_provider_outer, d3_by_kind, d17_prevalence, e7_unique_signals, f2_top_hosts, g5_token_intersect, h31_confidence_tier, j1_event_stream)}
ORACLE_SQL = {
    "b4_media_skip": "SELECT doc_id % 4 = 0 AS media, count(*) AS n FROM documents GROUP BY 1",
    "b7_high_confidence": f"WITH {LEX}, {LEXICAL_FINDINGS} SELECT kind, provider, count(*) AS n FROM found WHERE confidence >= 0.85 GROUP BY ALL",
    "b12_year_parse": "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1",
    "c4_detail_semi": "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "c8_provider_outer": f"WITH {LEX} SELECT d.provider, d.ord, n FROM (SELECT unnest({_L(rules.PROVIDERS)}) AS provider, unnest(range(0, {len(rules.PROVIDERS)}))::INT AS ord) d JOIN (SELECT provider, count(DISTINCT app_id) AS n FROM lex GROUP BY 1) USING (provider)",
    "d3_by_kind": f"WITH {LEX}, {LEXICAL_FINDINGS}, c AS (SELECT unnest({_L(rules.KINDS)}) AS category, unnest([{_KIND_SQL}]) AS successes, count(DISTINCT app_id) AS n FROM found) SELECT *, {_interval()} FROM c",
    "d17_prevalence": f"""WITH {_RAG_SQL}, {LEX.removeprefix(SOURCES + ",")}, {_CLASSES.removeprefix(SOURCES + ",")},
 f AS (SELECT app_id, CASE WHEN is_endpoint THEN 'llm_endpoint' ELSE 'llm_sdk_reference' END AS kind, provider, source_file FROM lex UNION ALL SELECT app_id, 'rag_artefact', NULL, source_file FROM ragp JOIN sources USING (app_id, source_idx) UNION ALL SELECT app_id, 'rag_artefact', NULL, source_file FROM ragc JOIN sources USING (app_id, source_idx)),
 g AS (SELECT app_id, coalesce(bool_or(kind = 'llm_sdk_reference' AND provider = 'openai'), false) AS credential, coalesce(bool_or(kind = 'llm_sdk_reference' AND provider <> 'openai'), false) AS other, bool_or(kind = 'rag_artefact') AS rag, bool_or(kind = 'llm_endpoint') AS endpoint,
  bool_or(NOT regexp_full_match(split_part(source_file, '/', -1), 'classes\\d*\\.dex')) AS outside FROM f GROUP BY 1),
 p AS (SELECT app_id, bool_or(class = 'system_prompt') AS prompt, bool_or(class = 'preset') AND NOT bool_or(class = 'system_prompt') AS preset FROM classed GROUP BY 1),
 t AS (SELECT DISTINCT app_id, true AS tool FROM sources WHERE regexp_matches(content, '{dict(rules.AUDIT)["schema.tool"]}')),
 a AS (SELECT app_id, credential, other, rag, endpoint, outside, coalesce(prompt, false) AS prompt, coalesce(preset, false) AS preset, coalesce(tool, false) AS tool FROM g LEFT JOIN p USING (app_id) LEFT JOIN t USING (app_id)),
 c AS (SELECT unnest(['inference_credential', 'other_secret', 'system_prompt', 'preset_only', 'tool_schema', 'rag_artefact', 'llm_endpoint', 'any_artefact', 'no_artefact', 'finding_outside_dex']) AS category, unnest([count(*) FILTER (credential), count(*) FILTER (other), count(*) FILTER (prompt), count(*) FILTER (preset), count(*) FILTER (tool), count(*) FILTER (rag), count(*) FILTER (endpoint),
  count(*) FILTER (credential OR prompt OR tool OR rag), count(*) FILTER (NOT (credential OR prompt OR tool OR rag)), count(*) FILTER (outside)]) AS successes, count(*) AS n FROM a), i AS (SELECT *, {_interval('1.0')} FROM c) SELECT *, ci_upper - ci_lower AS ci_width FROM i""",
    "e7_unique_signals": f"WITH {INDEX}, t AS (SELECT sha256, {_TOK} AS t FROM (SELECT sha256, pkg_name || '.' || pkg_name AS pkg_name FROM idx)) SELECT sha256, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS tokens FROM t",
    "f2_top_hosts": f"WITH {_HOSTS} SELECT host, count(*) AS n FROM judged WHERE interesting GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "g5_token_intersect": f"WITH {INDEX} SELECT sha256, array_to_string(list_sort(list_distinct(list_filter({_TOK}, lambda x: list_contains({_L(rules.SIGNAL_TOKENS)}, x)))), ',') AS tokens FROM idx",
    "j1_event_stream": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)",
    "h31_confidence_tier": "SELECT CASE WHEN 1 - l_discount * 4 >= 0.9 THEN 'high' WHEN 1 - l_discount * 4 >= 0.7 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM lineitem GROUP BY 1",
}
