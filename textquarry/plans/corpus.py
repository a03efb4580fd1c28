"""Frame, sampling, ledger, validation and statistics queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry import rules
from textquarry.functions import scalars as S
from textquarry.operators import corpus as C
from textquarry.operators import detectors as D
from textquarry.plans.detection import CONTAINER, LEX, LEXICAL_FINDINGS, STRUCT
from textquarry.plans.overlay import SOURCES, read, sources
from textquarry.sources.renderers import by_content
from textquarry.sources.staging import staged

# A package index made of parts: names with and without signals, versions and dates of all kinds.
_WORDS = ["chatGPT", "aiHelper", "photo", "wallpaperAI", "OpenAIClient", "maps", "llm2go", "notes"]
_NAME = "concat('com.', lower(p_brand), '.', CASE " + " ".join(f"WHEN p_partkey % 8 = {k} THEN '{w}'" for k, w in enumerate(_WORDS)) + " END, '_v', p_size % 3)"
_INDEX = [
    "concat('s', p_partkey) AS sha256",
    f"replace({_NAME}, '#', '') AS pkg_name",
    "CASE WHEN p_partkey % 5 = 0 THEN 'x' WHEN p_partkey % 5 = 1 THEN '' ELSE concat('', p_partkey % 50) END AS vercode",
    "CASE WHEN p_partkey % 3 = 0 THEN '1980-01-01' WHEN p_partkey % 3 = 1 THEN concat(2015 + p_partkey % 9, '-05-01') END AS dex_date",
    "CASE WHEN p_partkey % 4 = 0 THEN concat(2010 + p_partkey % 15, '-07-01') WHEN p_partkey % 4 = 1 THEN 'none' END AS vt_scan_date",
    "CASE WHEN p_partkey % 7 = 0 THEN '2024-01-01' END AS added",
    "CASE WHEN p_partkey % 6 = 0 THEN 'play.google.com|anzhi' WHEN p_partkey % 6 = 1 THEN 'F-Droid' WHEN p_partkey % 6 = 2 THEN 'Google Play' ELSE 'appchina' END AS markets",
]
INDEX = f"idx AS (SELECT {', '.join(_INDEX)} FROM part)"


def index(spark, d):
    return read(spark, d, "part").selectExpr(*_INDEX)


def h1_tokenize_package(spark, d):
    return index(spark, d).select("sha256", F.array_join(S.tokenize_package(F.col("pkg_name")), " ").alias("tokens"))


def h2_ai_signals(spark, d):
    return index(spark, d).select("sha256", F.array_join(S.ai_signals(F.col("pkg_name")), "|").alias("signals"))


def b1_ai_candidates(spark, d):
    return C.ai_candidates(index(spark, d)).groupBy("pkg_name").agg(F.count("*").alias("n"))


def e2_dedup_by_package(spark, d):
    return C.dedup_by_package(index(spark, d)).select("pkg_name", "sha256", "vercode", "dex_date")


def _dates():
    return F.col("dex_date"), F.col("vt_scan_date"), F.col("added")


def h3_year_of(spark, d):
    return index(spark, d).select("sha256", S.year_of(*_dates()).cast("long").alias("year"), S.date_source(*_dates()).alias("date_source"))


def d21_frame_dating(spark, d):
    return index(spark, d).groupBy(S.date_source(*_dates()).alias("date_source")).agg(F.count("*").alias("n"), F.count_if(F.size(S.ai_signals(F.col("pkg_name"))) > 0).alias("n_candidates"))


def h5_store_stratum(spark, d):
    return index(spark, d).groupBy(S.store_stratum(F.col("markets")).alias("store")).agg(F.count("*").alias("n"))


def b6_year_window(spark, d):
    return index(spark, d).withColumn("year", S.year_of(*_dates()).cast("long")).filter(F.col("year").isin(2020, 2021, 2022)).groupBy("year").agg(F.count("*").alias("n"))


def h22_version_numeric(spark, d):
    return index(spark, d).groupBy(S.version_numeric(F.col("vercode")).alias("version")).agg(F.count("*").alias("n"))


def _orders(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("store"))


def d15_by_stratum(spark, d):
    return _orders(spark, d).groupBy("year", "store").agg(F.count("*").alias("size"))


def e6_largest_remainder(spark, d):
    return C.largest_remainder(d15_by_stratum(spark, d), 100, ["year", "store"])


def l1_stratified_sample(spark, d):
    return C.stratified_sample(_orders(spark, d), 100, ["year", "store"], "o_orderkey", "seed1")


def _flagged(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", (F.length("text") > 2000).alias("flagged"))


def l2_validation_sample(spark, d):
    return C.validation_sample(_flagged(spark, d), "flagged", "doc_id", 25, "v1").select("doc_id", "flagged", "is_short")


def l3_blind_shuffle(spark, d):
    rows = C.blind_order(_flagged(spark, d), "doc_id", "b1").limit(50)
    return rows.select("doc_id")


def l4_first_negatives(spark, d):
    return _flagged(spark, d).filter("not flagged").orderBy(C.hash_order("", "doc_id")).limit(20).select("doc_id")


# The ledger as a log of events: a user is an application, kinds of events are transitions.
_EVENT = "CASE event_type WHEN 'click' THEN 'downloaded' WHEN 'view' THEN 'scanned' WHEN 'purchase' THEN 'scan_failed' WHEN 'signup' THEN 'download_failed' ELSE CASE WHEN event_id % 3 = 0 THEN 'reset' ELSE 'download_failed' END END"
LOG = f"log AS (SELECT concat('u', user_id) AS sha256, ts AS moment, event_id AS seq, {_EVENT} AS event FROM events)"
FOLD = """fold AS (SELECT sha256, CASE WHEN last IN ('reset', 'enroll') THEN 'pending' ELSE last END AS state, attempts FROM (SELECT sha256, arg_max(event, (moment, seq)) AS last,
 count(*) FILTER (event IN ('download_failed', 'scan_failed') AND (r IS NULL OR (moment, seq) > r)) AS attempts FROM (SELECT *, max(CASE WHEN event = 'reset' THEN (moment, seq) END) OVER (PARTITION BY sha256) AS r FROM log) GROUP BY 1))"""


def log(spark, d):
    return read(spark, d, "events").selectExpr("concat('u', user_id) AS sha256", "ts AS at", "event_id AS seq", f"{_EVENT} AS event")


def j2_ledger_state(spark, d):
    return C.fold(log(spark, d))


def d6_state_counts(spark, d):
    return C.fold(log(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


def b8_pending(spark, d):
    return C.pending(C.fold(log(spark, d)), 50)


def j3_enroll(spark, d):
    new = read(spark, d, "customer").selectExpr("concat('u', c_custkey) AS sha256")
    return C.enroll(C.fold(log(spark, d)), new)


def j5_reset(spark, d):
    more = log(spark, d).unionByName(C.reset_events(C.fold(log(spark, d)), F.to_timestamp(F.lit("2030-01-01 00:00:00"))))
    return C.fold(more).groupBy("state").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


def e3_latest_label(spark, d):
    return C.latest(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_type")


def e4_last_wins(spark, d):
    rows = read(spark, d, "events").withColumn("sha", F.lower(F.concat(F.lit("U"), "user_id")))
    return C.latest(rows.select("sha", "event_id", "value"), "sha", ["event_id"]).select("sha", "event_id")


def d7_ledger_stats(spark, d):
    rows = read(spark, d, "documents").select((F.col("lang") == "en").alias("llm_integrated"), (F.length("text") % 4).cast("long").alias("n_findings"))
    return C.ledger_stats(rows)


def d8_provider_counts(spark, d):
    json = read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, '["openai","cohere"]').when(F.col("o_orderkey") % 3 == 1, '["openai"]').otherwise("[]").alias("providers"))
    return json.select(F.explode(F.from_json("providers", "array<string>")).alias("provider")).groupBy("provider").agg(F.count("*").alias("n"))


def c3_confusion(spark, d):
    """Predictions (hashes in capitals) restricted to labelled applications, whose hashes may be in small letters."""
    labels = read(spark, d, "labels").select(F.upper(F.concat(F.lit("s"), "doc_id")).alias("sha"), (F.col("quality") == 1).alias("truth"))
    return C.confusion(read(spark, d, "documents").select(F.concat(F.lit("S"), "doc_id").alias("sha"), (F.length("text") > 1500).alias("flag")).join(labels, "sha"), "flag", "truth")


_OUTCOMES = ["concat('fp', c_custkey % 40) AS fingerprint", "CASE WHEN c_custkey % 2 = 0 THEN 'openai' ELSE 'google_gemini' END AS provider", "c_mktsegment AS package"]
_DISPOSED = "CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 THEN false END AS valid"
OUTCOMES = f"""disp AS (SELECT concat('fp', k) AS fingerprint, CASE WHEN k % 2 = 0 THEN 'openai' ELSE 'google_gemini' END AS provider, {_DISPOSED} FROM range(0, 30) t(k)),
outcomes AS (SELECT c.*, valid, CASE WHEN valid THEN 'live' WHEN NOT valid THEN 'revoked' ELSE 'unknown' END AS state FROM (SELECT {", ".join(_OUTCOMES)} FROM customer) c LEFT JOIN disp USING (provider, fingerprint))"""


def _outcomes(spark, d):
    disp = spark.range(30).selectExpr("concat('fp', id) AS fingerprint", "CASE WHEN id % 2 = 0 THEN 'openai' ELSE 'google_gemini' END AS provider", _DISPOSED.replace("k %", "id %"))
    return C.attach_dispositions(read(spark, d, "customer").selectExpr(*_OUTCOMES), disp)


def d11_credential_summary(spark, d):
    return C.credential_summary(_outcomes(spark, d))


def d12_credential_by_provider(spark, d):
    return C.credential_summary(_outcomes(spark, d), "provider")


def b9_disclosure(spark, d):
    return C.to_disclose(_outcomes(spark, d)).groupBy("provider", "package").agg(F.count("*").alias("n"))


def d13_distinct_keys(spark, d):
    return _outcomes(spark, d).agg(F.count_distinct("fingerprint").alias("n"))


def h7_fingerprint(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.fingerprint(F.col("c_name")).alias("fp"), S.redact(F.concat("c_name", F.lit(" of segment "), F.repeat("c_mktsegment", F.lit(8)))).alias("shown"))


def h19_html_escape(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(S.html_escape(F.col("html"))).alias("digest"))


def h14_cjk_density(spark, d):
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.repeat(F.lit("你是一個教授請總結"), F.ceil(F.length("text") / 20).cast("int")), "text")).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", S.cjk_dense(text).alias("dense"))


# Per application: what was found (overlay), as flags.
APPS = f"""{LEX}, flags AS (SELECT app_id, bool_or(provider = 'openai') AS openai, bool_or(provider = 'anthropic') AS anthropic, bool_or(NOT is_endpoint) AS sdk, bool_or(source_idx % 2 = 0) AS even, list_sort(list(DISTINCT provider)) AS providers FROM lex GROUP BY 1)"""


def _apps(spark, d):
    return _flags(D.lexical_matches(sources(spark, d)))


def _flags(lex):
    return lex.groupBy("app_id").agg(F.bool_or(F.col("provider") == "openai").alias("openai"), F.bool_or(F.col("provider") == "anthropic").alias("anthropic"), F.bool_or(~F.col("is_endpoint")).alias("sdk"), F.bool_or(F.col("source_idx") % 2 == 0).alias("even"), F.array_sort(F.collect_set("provider")).alias("providers"))


def d2_category_stats(spark, d):
    flags = {k: F.col(k) for k in ("openai", "anthropic", "sdk")}
    return C.category_stats(_apps(spark, d), flags, F.col("even"))


def c7_zero_filled(spark, d):
    """Categories without any finding are there with zero."""
    found = D.lexical_findings(D.lexical_matches(sources(spark, d))).groupBy("kind").agg(F.count_distinct("app_id").alias("n"))
    dim = spark.createDataFrame([(k, i) for i, k in enumerate(rules.KINDS)], "kind string, ord int")
    return dim.join(found, "kind", "left").select("kind", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def d4_by_provider(spark, d):
    """Of the applications with a provider, those that also invoke it."""
    src = sources(spark, d)
    lex = staged(D.lexical_matches(src))
    return C.by_provider(_flags(lex), D.structural_evidence(src, D.detected_providers(lex)).filter("kind = 'invocation'").select("app_id", "provider"))


def d5_by_provider_and_kind(spark, d):
    return C.by_provider_and_kind(_apps(spark, d), {"sdk": F.col("sdk"), "even": F.col("even")})


def d14_integration_by_year(spark, d):
    rows = _orders(spark, d).groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("store") == "1-URGENT").alias("successes"))
    return C.with_interval(rows, "unit")


def h30_wilson(spark, d):
    rows = spark.range(0, 40).selectExpr("id AS k", "id * 3 % 17 AS n").selectExpr("k", "least(k, n) AS successes", "n")
    return C.with_interval(rows, "unit")


def g1_set_operations(spark, d):
    a = _apps(spark, d)
    one, two = (a.filter(x).select("app_id") for x in ("openai", "anthropic"))
    every = {"union": one.union(two).distinct(), "intersect": one.intersect(two), "except": one.subtract(two), "anti": a.select("app_id").join(one, "app_id", "left_anti")}
    out = None
    for k, v in every.items():
        own = v.withColumn("op", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def d16_finding_counters(spark, d):
    """Tallies by kind, severity, tier and container, of findings and of applications, in one pass by grouping sets."""
    f = D.lexical_findings(D.lexical_matches(sources(spark, d))).select("app_id", "kind", "severity", S.confidence_tier(F.col("confidence")).alias("tier"), S.container_class(F.col("file_path")).alias("container"))
    names = [F.col(c) for c in ("kind", "severity", "tier", "container")]
    return f.groupingSets([[c] for c in names], *names).agg(F.count("*").alias("n"), F.count_distinct("app_id").alias("n_apps"))


def d18_sensitivity(spark, d):
    """Applications whose only provider is a given one, by their set of providers."""
    a = _apps(spark, d)
    only = C.widened(a, F.col("openai"), F.col("providers"), "openai")
    return a.agg(F.count("*").alias("n"), F.count_if(F.col("providers") == F.array(F.lit("openai"))).alias("openai_only"), F.count_if(F.size("providers") > 1).alias("several")).crossJoin(only)  # one row each


def d19_co_occurrence(spark, d):
    a = _apps(spark, d).agg(F.count_if("openai").alias("a"), F.count_if(F.col("openai") & F.col("anthropic")).alias("both"))
    return a.withColumn("share", F.try_divide("both", "a"))


def d20_provider_distribution(spark, d):
    a = _apps(spark, d)
    n = a.select("app_id", F.explode("providers").alias("provider")).groupBy("provider").agg(F.count_distinct("app_id").alias("n"))
    return n.crossJoin(F.broadcast(a.agg(F.count("*").alias("_all")))).select("provider", "n", S.share(F.col("n"), F.col("_all")).alias("share")).orderBy(F.desc("n"), "provider")  # one row of totals


_MARKS = ["lib/arm/libflutter.so", "index.android.bundle", "lib/libunity.so", "assets/www/index.html", "assemblies/x.dll", "kotlin/kotlin.kotlin_builtins", "res/a.xml"]


def _frameworks(spark, d):
    name = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("c_custkey") % 7 + 1).cast("int"))
    apps = read(spark, d, "customer").groupBy((F.col("c_custkey") % 60).alias("app")).agg(F.collect_set(F.when(F.col("c_custkey") % 11 < 3, name).otherwise("res/z.png")).alias("names"))
    return apps.select("app", S.framework_class(F.col("names")).alias("framework"))


def e9_framework_class(spark, d):
    return _frameworks(spark, d)


def d23_framework_counts(spark, d):
    """Applications by toolchain, with shares, and the share of those that aren't native."""
    n = _frameworks(spark, d).groupBy("framework").agg(F.count("*").alias("n"))
    every = n.agg(F.sum("n").alias("_all"), F.coalesce(F.sum(F.when(F.col("framework") != rules.NATIVE, F.col("n"))), F.lit(0)).alias("_cross"))
    return n.crossJoin(F.broadcast(every)).select("framework", "n", S.share(F.col("n"), F.col("_all")).alias("share"), S.share(F.col("_cross"), F.col("_all")).alias("cross_platform_share"))  # one row of totals


def c10_worksheet_order(spark, d):
    """Listed applications first, in their order, then the rest sorted; labelled ones are left out."""
    docs, labels = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id")
    listed = docs.filter("doc_id % 10 = 3").select("doc_id", (1000000 - F.col("doc_id")).alias("place"))
    return docs.join(labels, "doc_id", "left_anti").join(listed, "doc_id", "left").select("doc_id", "place").orderBy(F.col("place").asc_nulls_last(), "doc_id")


def c11_source_reconcile(spark, d):
    """Rows of three stores that disagree or are missing in one."""
    a = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    b = a.filter("o_orderkey % 97 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 89 == 0, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    c = a.filter("o_orderkey % 83 <> 0")
    return C.reconcile({"log": a, "detail": b, "ledger": c}, "o_orderkey", "o_orderstatus")


def c12_path_lookup(spark, d):
    a, b = read(spark, d, "nation").select("n_nationkey"), read(spark, d, "supplier").select("s_nationkey").distinct()
    j = a.join(b, a["n_nationkey"] == b["s_nationkey"], "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("s_nationkey").isNull()).alias("unavailable"))


def f7_content_order(spark, d):
    """Publication without identifiers, ordered by content."""
    rows = read(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("region"), F.round("s_acctbal", -3).alias("bal")).groupBy("region", "bal").agg(F.count("*").alias("n"))
    return by_content(rows)




def _interval(zero: str = "0.0") -> str:
    p, n = "(successes::DOUBLE / n)", "n::DOUBLE"
    half = f"1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / {n} / (4 * {n}))"
    return f"""CASE WHEN n > 0 THEN {p} ELSE 0.0 END::DOUBLE AS proportion, CASE WHEN n > 0 THEN greatest(0.0, ({p} + 3.8416 / {n} / 2 - {half}) / (1 + 3.8416 / {n})) ELSE 0.0 END::DOUBLE AS ci_lower,
 CASE WHEN n > 0 THEN least(1.0, ({p} + 3.8416 / {n} / 2 + {half}) / (1 + 3.8416 / {n})) ELSE {zero} END::DOUBLE AS ci_upper"""


def _y(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[0-9]{{4}}') AND left({c}, 4)::INT >= 2008 THEN left({c}, 4)::INT END"


_YEAR = f"coalesce({_y('dex_date')}, {_y('vt_scan_date')}, {_y('added')})"
STORE = "CASE WHEN regexp_matches(lower(markets), 'play.google.com|google ?play') THEN 'google_play' WHEN regexp_matches(lower(markets), 'f-?droid') THEN 'f_droid' ELSE 'other' END"
_SOURCE = f"CASE WHEN {_y('dex_date')} IS NOT NULL THEN 'dex_date' WHEN {_y('vt_scan_date')} IS NOT NULL THEN 'vt_scan_date' WHEN {_y('added')} IS NOT NULL THEN 'added' ELSE 'none' END"
_TOK = "list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(pkg_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[._ -]+'), lambda x: x <> ''), lambda x: lower(x))"
_L = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_TOOLS = " ".join(f"WHEN {' OR '.join(f'len(list_filter(names, lambda x: contains(x, {chr(39)}{m}{chr(39)}))) > 0' for m in marks)} THEN '{label}'" for label, marks in rules.FRAMEWORKS)
_FRAMEWORKS = f"""named AS (SELECT c_custkey % 60 AS app, list(CASE WHEN c_custkey % 11 < 3 THEN {_L(_MARKS)}[c_custkey % 7 + 1] ELSE 'res/z.png' END) AS names FROM customer GROUP BY 1), classed AS (SELECT app, CASE {_TOOLS} ELSE '{rules.NATIVE}' END AS framework FROM named)"""
SIGNALS = f"""{INDEX}, tok AS (SELECT *, {_TOK} AS t FROM idx), sig AS (SELECT *, CASE WHEN len(list_filter(t, lambda x: {" OR ".join(f"contains(x, '{v}')" for v in rules.VETO_SUBSTRINGS)})) > 0 OR starts_with(lower(pkg_name), 'appinventor.ai_') THEN []
 ELSE list_concat(list_concat(list_transform(list_filter({_L(rules.SIGNAL_PREFIXES)}, lambda p: starts_with(lower(pkg_name), p)), lambda p: 'pkg:' || p), list_sort(list_distinct(list_filter(t, lambda x: list_contains({_L(rules.SIGNAL_TOKENS)}, x))))),
 flatten(list_transform(t, lambda x: list_filter({_L(rules.SIGNAL_SUBSTRINGS)}, lambda s: contains(x, s))))) END AS s FROM tok)"""
_ALLOC = """st AS (SELECT year(o_orderdate) AS year, o_orderpriority AS store, count(*) AS size FROM orders GROUP BY ALL), q AS (SELECT *, (sum(size) OVER ())::BIGINT AS total, least(100, sum(size) OVER ())::BIGINT AS wanted FROM st),
 q2 AS (SELECT *, size * wanted // total AS base, size * wanted % total AS rest FROM q), alloc AS (SELECT year, store, size, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, year, store) <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS alloc FROM q2)"""

QUERIES = {f.__name__: f for f in (
    h1_tokenize_package, h2_ai_signals, b1_ai_candidates, e2_dedup_by_package, h3_year_of, d21_frame_dating, h5_store_stratum, b6_year_window, h22_version_numeric, d15_by_stratum,
    e6_largest_remainder, l1_stratified_sample, l2_validation_sample, l3_blind_shuffle, l4_first_negatives, j2_ledger_state, d6_state_counts, b8_pending, j3_enroll, j5_reset, e3_latest_label,
    e4_last_wins, d7_ledger_stats, d8_provider_counts, c3_confusion, d11_credential_summary, d12_credential_by_provider, b9_disclosure, d13_distinct_keys, h7_fingerprint, h19_html_escape,
    h14_cjk_density, d2_category_stats, c7_zero_filled, d4_by_provider, d5_by_provider_and_kind, d14_integration_by_year, h30_wilson, g1_set_operations, d16_finding_counters, d18_sensitivity,
    d19_co_occurrence, d20_provider_distribution, e9_framework_class, d23_framework_counts, c10_worksheet_order, c11_source_reconcile, c12_path_lookup, f7_content_order,
)}

ORACLE_SQL = {
    "h1_tokenize_package": f"WITH {INDEX} SELECT sha256, array_to_string({_TOK}, ' ') AS tokens FROM idx",
    "h2_ai_signals": f"WITH {SIGNALS} SELECT sha256, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), '|') AS signals FROM sig",
    "b1_ai_candidates": f"WITH {SIGNALS} SELECT pkg_name, count(*) AS n FROM sig WHERE len(s) > 0 GROUP BY 1",
    "e2_dedup_by_package": f"""WITH {INDEX} SELECT pkg_name, sha256, vercode, dex_date FROM (SELECT *, row_number() OVER (PARTITION BY pkg_name ORDER BY CASE WHEN regexp_full_match(vercode, '[0-9]+') THEN vercode::BIGINT ELSE -1 END DESC, coalesce(dex_date, added, '') DESC, sha256 DESC) AS r FROM idx) WHERE r = 1""",
    "h3_year_of": f"WITH {INDEX} SELECT sha256, ({_YEAR})::BIGINT AS year, {_SOURCE} AS date_source FROM idx",
    "d21_frame_dating": f"WITH {SIGNALS} SELECT {_SOURCE} AS date_source, count(*) AS n, count(*) FILTER (len(s) > 0) AS n_candidates FROM sig GROUP BY 1",
    "h5_store_stratum": f"WITH {INDEX} SELECT {STORE} AS store, count(*) AS n FROM idx GROUP BY 1",
    "b6_year_window": f"WITH {INDEX} SELECT ({_YEAR})::BIGINT AS year, count(*) AS n FROM idx WHERE {_YEAR} IN (2020, 2021, 2022) GROUP BY 1",
    "h22_version_numeric": f"WITH {INDEX} SELECT CASE WHEN regexp_full_match(vercode, '[0-9]+') THEN vercode::BIGINT ELSE -1 END AS version, count(*) AS n FROM idx GROUP BY 1",
    "d15_by_stratum": "SELECT year(o_orderdate) AS year, o_orderpriority AS store, count(*) AS size FROM orders GROUP BY ALL",
    "e6_largest_remainder": f"WITH {_ALLOC} SELECT year, store, size, alloc::BIGINT AS alloc FROM alloc",
    "l1_stratified_sample": f"WITH {_ALLOC} SELECT year, store, o_orderkey FROM (SELECT year(o_orderdate) AS year, o_orderpriority AS store, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY sha256('seed1' || o_orderkey::VARCHAR), o_orderkey) AS r FROM orders) JOIN alloc USING (year, store) WHERE r <= alloc",
    "l2_validation_sample": "SELECT doc_id, flagged, is_short FROM (SELECT doc_id, length(text) > 2000 AS flagged, row_number() OVER (PARTITION BY length(text) > 2000 ORDER BY sha256('v1' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY length(text) > 2000) < 25 AS is_short FROM documents) WHERE r <= 25",
    "l3_blind_shuffle": "SELECT doc_id FROM documents ORDER BY sha256('b1' || doc_id::VARCHAR), doc_id LIMIT 50",
    "l4_first_negatives": "SELECT doc_id FROM documents WHERE length(text) <= 2000 ORDER BY sha256(doc_id::VARCHAR) LIMIT 20",
    "j2_ledger_state": f"WITH {LOG}, {FOLD} SELECT * FROM fold",
    "d6_state_counts": f"WITH {LOG}, {FOLD} SELECT state, count(*) AS n FROM fold GROUP BY 1",
    "b8_pending": f"WITH {LOG}, {FOLD} SELECT * FROM fold WHERE state <> 'scanned' AND attempts < 3 ORDER BY sha256 LIMIT 50",
    "j3_enroll": f"WITH {LOG} SELECT DISTINCT concat('u', c_custkey) AS sha256, 'pending' AS state, 0::BIGINT AS attempts FROM customer WHERE concat('u', c_custkey) NOT IN (SELECT sha256 FROM log)",
    "j5_reset": f"WITH {LOG}, {FOLD} SELECT CASE WHEN state IN ('download_failed', 'scan_failed') THEN 'pending' ELSE state END AS state, count(*) AS n, sum(CASE WHEN state IN ('download_failed', 'scan_failed') THEN 0 ELSE attempts END)::BIGINT AS attempts FROM fold GROUP BY 1",
    "e3_latest_label": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "e4_last_wins": "SELECT lower('U' || user_id) AS sha, max(event_id) AS event_id FROM events GROUP BY 1",
    "d7_ledger_stats": "SELECT count(*) AS scanned, count(*) FILTER (lang = 'en') AS integrated, sum(length(text) % 4)::BIGINT AS findings, (count(*) FILTER (lang = 'en'))::DOUBLE / count(*) AS llm_rate FROM documents",
    "d8_provider_counts": "SELECT 'openai' AS provider, count(*) FILTER (o_orderkey % 3 <> 2) AS n FROM orders UNION ALL SELECT 'cohere', count(*) FILTER (o_orderkey % 3 = 0) FROM orders",
    "c3_confusion": """WITH r AS (SELECT length(text) > 1500 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM r)
 SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)) AS f1 FROM c""",
    "d11_credential_summary": f"WITH {OUTCOMES} SELECT count(*) AS found, count(*) FILTER (state = 'live') AS live, count(*) FILTER (state = 'revoked') AS revoked, count(*) FILTER (state = 'unknown') AS unknown, (count(*) FILTER (state = 'live'))::DOUBLE / count(*) FILTER (state <> 'unknown') AS live_rate FROM outcomes",
    "d12_credential_by_provider": f"WITH {OUTCOMES} SELECT provider, count(*) AS found, count(*) FILTER (state = 'live') AS live, count(*) FILTER (state = 'revoked') AS revoked, count(*) FILTER (state = 'unknown') AS unknown, (count(*) FILTER (state = 'live'))::DOUBLE / count(*) FILTER (state <> 'unknown') AS live_rate FROM outcomes GROUP BY 1",
    "b9_disclosure": f"WITH {OUTCOMES} SELECT provider, package, count(*) AS n FROM outcomes WHERE valid IS DISTINCT FROM false GROUP BY ALL",
    "d13_distinct_keys": "SELECT count(DISTINCT c_custkey % 40) AS n FROM customer",
    "h7_fingerprint": "SELECT c_custkey, left(sha256(c_name), 16) AS fp, CASE WHEN length(x) <= 60 THEN x ELSE left(x, 30) || '…' || right(x, 15) END AS shown FROM (SELECT *, c_name || ' of segment ' || repeat(c_mktsegment, 8) AS x FROM customer)",
    "h19_html_escape": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages",
    "h14_cjk_density": "SELECT doc_id, length(regexp_replace(t, '[^\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}]', '', 'g')) >= 0.25 * length(t) AND length(t) > 0 AS dense FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN repeat('你是一個教授請總結', ceil(length(text) / 20)::INT) || text ELSE text END AS t FROM documents)",
    "d2_category_stats": f"WITH {APPS}, c AS (SELECT unnest(['openai', 'anthropic', 'sdk']) AS category, unnest([count(*) FILTER (even AND openai), count(*) FILTER (even AND anthropic), count(*) FILTER (even AND sdk)]) AS successes, count(*) FILTER (even) AS n FROM flags) SELECT *, {_interval()} FROM c",
    "c7_zero_filled": f"WITH {LEX}, k AS (SELECT CASE WHEN is_endpoint THEN 'llm_endpoint' ELSE 'llm_sdk_reference' END AS kind, count(DISTINCT app_id) AS n FROM lex GROUP BY 1) SELECT d.kind, d.ord, coalesce(n, 0) AS n FROM (SELECT unnest({_L(rules.KINDS)}) AS kind, unnest(range(0, 6))::INT AS ord) d LEFT JOIN k USING (kind)",
    "d4_by_provider": f"WITH {APPS}, {STRUCT}, h AS (SELECT DISTINCT app_id, provider FROM struct WHERE kind = 'invocation'), c AS (SELECT provider, count(h.app_id) AS successes, count(*) AS n FROM (SELECT DISTINCT app_id, provider FROM lex) p LEFT JOIN h USING (app_id, provider) GROUP BY 1) SELECT *, {_interval()} FROM c",
    "d5_by_provider_and_kind": f"WITH {APPS}, p AS (SELECT *, unnest(providers) AS provider FROM flags), c AS (SELECT provider, 'sdk' AS kind, count(*) FILTER (sdk) AS successes, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT provider, 'even', count(*) FILTER (even), count(*) FROM p GROUP BY 1) SELECT *, {_interval()} FROM c",
    "d14_integration_by_year": f"WITH c AS (SELECT year(o_orderdate) AS year, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS successes FROM orders GROUP BY 1) SELECT *, {_interval('1.0')} FROM c",
    "h30_wilson": f"WITH c AS (SELECT k, least(k, k * 3 % 17) AS successes, k * 3 % 17 AS n FROM range(0, 40) t(k)) SELECT *, {_interval('1.0')} FROM c",
    "g1_set_operations": f"WITH {APPS} SELECT app_id, 'union' AS op FROM flags WHERE openai OR anthropic UNION ALL SELECT app_id, 'intersect' FROM flags WHERE openai AND anthropic UNION ALL SELECT app_id, 'except' FROM flags WHERE openai AND NOT anthropic UNION ALL SELECT app_id, 'anti' FROM flags WHERE NOT openai",
    "d18_sensitivity": f"WITH {APPS} SELECT count(*) AS n, count(*) FILTER (providers = ['openai']) AS openai_only, count(*) FILTER (len(providers) > 1) AS several, count(*) FILTER (NOT openai AND len(providers) > 0) AS attributed, count(*) FILTER (NOT openai AND providers = ['openai']) AS one_only, (count(*) FILTER (openai) + count(*) FILTER (NOT openai AND len(providers) > 0))::BIGINT AS denominator FROM flags",
    "d19_co_occurrence": f"WITH {APPS} SELECT count(*) FILTER (openai) AS a, count(*) FILTER (openai AND anthropic) AS both, (count(*) FILTER (openai AND anthropic))::DOUBLE / nullif(count(*) FILTER (openai), 0) AS share FROM flags",
    "d20_provider_distribution": f"WITH {LEX} SELECT provider, count(DISTINCT app_id) AS n, count(DISTINCT app_id)::DOUBLE / (SELECT count(DISTINCT app_id) FROM lex) AS share FROM lex GROUP BY 1 ORDER BY n DESC, provider",
    "c10_worksheet_order": "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 1000000 - doc_id END AS place FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY place NULLS LAST, doc_id",
    "d16_finding_counters": f"""WITH {LEX}, {LEXICAL_FINDINGS}, g AS (SELECT app_id, kind, severity, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS tier, {CONTAINER.replace("source_file", "file_path")} AS container FROM found)
 SELECT kind, severity, tier, container, count(*) AS n, count(DISTINCT app_id) AS n_apps FROM g GROUP BY GROUPING SETS ((kind), (severity), (tier), (container))""",
    "e9_framework_class": f"WITH {_FRAMEWORKS} SELECT app, framework FROM classed",
    "d23_framework_counts": f"WITH {_FRAMEWORKS} SELECT framework, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM classed) AS share, (SELECT count(*) FILTER (framework <> '{rules.NATIVE}') / count(*)::DOUBLE FROM classed) AS cross_platform_share FROM classed GROUP BY 1",
    "c11_source_reconcile": "WITH k AS (SELECT o_orderkey % 97 = 0 AS no_detail, o_orderkey % 83 = 0 AS no_ledger, o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0 AS changed FROM orders) SELECT 0::BIGINT AS missing_log, count(*) FILTER (no_detail) AS missing_detail, count(*) FILTER (no_ledger) AS missing_ledger, count(*) FILTER (NOT no_detail AND NOT no_ledger AND changed) AS different, count(*) FILTER (NOT no_detail AND NOT no_ledger AND NOT changed) AS same FROM k",
    "c12_path_lookup": "SELECT count(*) AS n, count(*) FILTER (n_nationkey NOT IN (SELECT s_nationkey FROM supplier)) AS unavailable FROM nation",
    "f7_content_order": "SELECT s_nationkey % 5 AS region, round(s_acctbal, -3) AS bal, count(*) AS n FROM supplier GROUP BY ALL",
}
