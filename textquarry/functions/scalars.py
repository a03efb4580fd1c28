"""Scalar functions, as Column expressions that stay in the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry import rules


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with Unicode classes and word boundaries, and Unicode case folding if case is ignored."""
    return f"(?{'iu' if ignore_case else ''}U){pattern}"


def anchors(pattern: str) -> list[str]:
    """Lower-case literals of which each match of a pattern holds one; empty if there are none."""
    from re import IGNORECASE, _parser

    def of(items) -> list[str] | None:
        best, run = None, ""
        for op, arg in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg).lower()
                continue
            if len(run) > max(map(len, best or [""])):
                best = [run]
            run = ""
            if name == "SUBPATTERN" and not best:
                best = of(arg[3])
            elif name == "BRANCH" and not best:
                every = [of(x) for x in arg[1]]
                best = [y for x in every for y in x] if all(every) else None
        return best

    return sorted(set(of(_parser.parse(pattern, IGNORECASE)) or []))


def sql(value: object) -> str:
    """A Spark SQL literal. Long rule lists are written as SQL text, which is parsed at once; building them Column by Column takes seconds."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool | int):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def holds_any(literals: list[str], low: str) -> str:
    return "(" + (" OR ".join(f"contains({low}, {sql(x)})" for x in literals) or "true") + ")"


def folded(text: Column) -> Column:
    """Small letters as patterns that ignore case see them: letters with a capital or a small form in ASCII included."""
    # a search for each of these letters costs far less than a look at each letter
    return F.lower(F.when(any_of(text, list("İıſ")), F.translate(text, "İıſ", "iis")).otherwise(text))


def holds(low: Column, pattern: str) -> Column | None:
    """Whether a text in small letters holds one of a pattern's literals, None if it has none. Plain ASCII text isn't searched for others."""
    literals = anchors(pattern)
    if not literals:
        return None
    plain, rest = ([x for x in literals if x.isascii() is k] for k in (True, False))
    out = any_of(low, plain)
    return out | (F.octet_length(low) > F.length(low)) & any_of(low, rest) if rest else out


def found(column: Column, pattern: str, ignore_case: bool = False, low: Column | None = None) -> Column:
    """column.rlike(pattern), after a cheap look for the pattern's literals in the text in small letters, if there are few or these letters are at hand."""
    test = column.rlike(java(pattern, ignore_case))
    some = holds(folded(column) if low is None else low, pattern)
    return some & test if some is not None and (low is not None or len(anchors(pattern)) <= 6) else test


def any_of(column: Column, values: list[str], how: str = "contains") -> Column:
    out = F.lit(False)
    for v in values:
        out = out | getattr(column, how)(v)
    return out


# --- package names and index rows -------------------------------------------------------------------------------------------------


def tokenize_package(name: Column) -> Column:
    """Lower-case tokens of a package name: split at . _ - and between lower and upper case, letter and digit."""
    parts = F.split(name, r"[._-]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
    return F.filter(F.transform(parts, F.lower), lambda x: x != "")


def ai_signals(name: Column) -> Column:
    """Signals in a package name, in order: prefixes, whole tokens (sorted), substrings of tokens; none for vetoed names."""
    low, tokens = F.lower(name), tokenize_package(name)
    prefixes = F.filter(F.array(*[F.when(low.startswith(p), F.lit(f"pkg:{p}")) for p in rules.SIGNAL_PREFIXES]), lambda x: x.isNotNull())
    whole = F.array_sort(F.array_intersect(F.array_distinct(tokens), F.array(*map(F.lit, rules.SIGNAL_TOKENS))))
    listed = F.array(*map(F.lit, rules.SIGNAL_SUBSTRINGS))
    inside = F.flatten(F.transform(tokens, lambda t: F.filter(listed, lambda s: t.contains(s))))
    vetoed = any_of(low, rules.VETO_PREFIXES, "startswith") | F.exists(tokens, lambda t: any_of(t, rules.VETO_SUBSTRINGS))
    return F.when(vetoed | name.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(prefixes, whole, inside)))


def _year(date: Column, least: int) -> Column:
    year = F.when(date.rlike("^[0-9]{4}"), F.substring(date, 1, 4).cast("int"))
    return F.when(year >= least, year)


def year_of(dex_date: Column, scan_date: Column, added: Column, least: int = 2008) -> Column:
    return F.coalesce(*[_year(x, least) for x in (dex_date, scan_date, added)])


def date_source(dex_date: Column, scan_date: Column, added: Column, least: int = 2008) -> Column:
    named = [(dex_date, "dex_date"), (scan_date, "vt_scan_date"), (added, "added")]
    return F.coalesce(*[F.when(_year(x, least).isNotNull(), F.lit(n)) for x, n in named], F.lit("none"))


# Names of stores in the list of markets.
PLAY_MARKERS, FDROID_MARKERS = ["play.google.com", "google play", "googleplay"], ["f-droid", "fdroid"]


def store_stratum(markets: Column) -> Column:
    low = F.lower(markets)
    return F.when(any_of(low, PLAY_MARKERS), "google_play").when(any_of(low, FDROID_MARKERS), "f_droid").otherwise("other")


def version_numeric(code: Column) -> Column:
    return F.coalesce(F.when(code.rlike("^[0-9]+$"), code).try_cast("bigint"), F.lit(-1))


# --- evidence and paths -----------------------------------------------------------------------------------------------------------


def redact(text: Column, n: int = 60) -> Column:
    """Texts over n characters: the first half of n, an ellipsis, the last quarter."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n // 2)), F.lit("…"), F.right(text, F.lit(n // 4))))


def fingerprint(secret: Column) -> Column:
    return F.left(F.sha2(secret.cast("binary"), 256), F.lit(16))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def top_component(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def container_class(path: Column) -> Column:
    return (
        F.when(path.rlike(r"^classes\d*\.dex$"), "dex").when(path.startswith("lib/") & path.endswith(".so"), "native_library").when(path == "resources.arsc", "resource_table")
        .when(path == "AndroidManifest.xml", "manifest").when(path.startswith("assets/"), "asset").when(path.startswith("res/"), "resource").otherwise("other")
    )


def not_dex(path: Column) -> Column:
    return (F.coalesce(path, F.lit("")) != "") & ~basename(path).rlike(r"^classes\d*\.dex$")


#: Suffixes of media that are not read.
MEDIA = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "svg", "mp3", "mp4", "wav", "ogg", "m4a", "aac", "webm", "avi", "mov", "ttf", "otf", "woff", "woff2", "eot", "zip", "gz", "br", "7z", "rar", "jar", "aar"]


def is_media(path: Column, suffixes: list[str] | None = None) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(suffixes or MEDIA)})$")


def framework_class(names: Column) -> Column:
    """The toolchain whose marker one of the archive's entry names has, by priority."""
    out = None
    for label, marks in rules.FRAMEWORKS:
        test = F.exists(names, lambda n: any_of(n, marks))  # noqa: B023  called at once
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(rules.NATIVE)


def hosts_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?i){rules.HOST}"), F.lit(1)), F.lower)


def host_interesting(host: Column) -> Column:
    return F.substring_index(host, ".", -1).isin(rules.TLDS) & ~any_of(host, rules.BORING_HOSTS, "endswith") & ~F.substring_index(host, ".", 1).isin(rules.PACKAGE_ROOTS)


def snippet(text: Column, term: str, around: int = 60) -> Column:
    """Up to `around` characters on both sides of a term's first place, on one line; null without it."""
    at = F.locate(term, F.lower(text))
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.trim(F.replace(F.substring(text, start, at + len(term) + around - start), F.lit("\n"), F.lit(" "))))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# --- text -------------------------------------------------------------------------------------------------------------------------


def printable_runs(text: Column) -> Column:
    """Runs without control, format and separator characters (but the space)."""
    return F.filter(F.split(text, r"[\p{C}\p{Z}&&[^ ]]+"), lambda x: x != "")


def cjk_dense(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(rules.CJK)) / F.length(text) >= rules.CJK_DENSITY).otherwise(F.lit(False))


def ascii_strings(content: Column, least: int = 4) -> Column:
    """Printable runs of a binary column."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"[\x20-\x7e\t]{{{least},}}"), F.lit(0))


def utf16_strings(content: Column, least: int = 4, chunk: int = 1 << 20) -> Column:
    """Runs of printable ASCII in a binary column read as little-endian 16-bit units at even places; a run ends at each chunk's edge."""
    edges = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.octet_length(content) - 1)).cast("bigint"), F.lit(chunk))
    # each match goes on where the last one ended, in steps of two bytes
    units = F.lit(rf"(?s)\G(?:..)*?((?:[\x20-\x7e\t]\x00){{{least},}})")
    found = F.flatten(F.transform(edges, lambda at: F.regexp_extract_all(F.decode(F.substring(content, at.cast("int") + 1, F.lit(chunk)), "ISO-8859-1"), units, F.lit(1))))
    return F.transform(found, lambda x: F.translate(x, "\0", ""))


def classify_prompt(text: Column) -> Column:
    """Whether a prompt is a system prompt or a preset, with its marks."""

    def tests(low: Column, folds: Column) -> Column:
        first, second = (F.when(any_of(low, anchors(p)), F.regexp_instr(text, F.lit(java(p, True)))).otherwise(0) for p in (rules.FIRST_PERSON, rules.SECOND_PERSON))
        return F.struct(first.alias("first"), second.alias("second"), found(text, rules.CONFIDENTIAL, True, folds).alias("secret"), found(text, rules.ROLE_BINDING, False, folds).alias("role_binding"), found(text, rules.WHITE_LABEL, True, folds).alias("white_label"))

    def judged(t: Column) -> Column:
        first, second, secret = t["first"], t["second"], t["secret"]
        kind = (
            F.when(secret, "system_prompt").when((first > 0) & (second == 0), "preset").when((second > 0) & (first == 0), "system_prompt")
            .when((first > 0) & (first < second), "preset").when(first > 0, "system_prompt").otherwise("unclassified")
        )
        return F.struct(kind.alias("class"), (first > 0).alias("first_person"), (second > 0).alias("second_person"), secret.alias("confidential"), t["role_binding"].alias("role_binding"), t["white_label"].alias("white_label"))

    # small letters are made once, and with them at hand few texts are searched for patterns, each once; branches of a CASE would do it again
    return let(let(F.lower(text), lambda low: let(F.when(any_of(text, list("İıſ")), folded(text)).otherwise(low), lambda folds: tests(low, folds))), judged)


#: Tests of prompts by name: pattern, whether case counts.
PROMPT_TESTS = {
    "opener": (rules.PROMPT_OPENERS, False), "opener_intl": (rules.PROMPT_OPENERS_INTL, False), "role": (rules.ROLE_WORDS, False), "role_intl": (rules.ROLE_WORDS_INTL, False),
    "slot": (rules.TEMPLATE_SLOT, True), "ends": (f"[{rules.TERMINATORS}]", False), "clauses": (f"[{rules.CLAUSE_SEPARATORS}]", False), "code": (rules.CODE_LIKE, False),
    "policy": (rules.POLICY_LIKE, False), "markup": (rules.MARKUP_LIKE, False), "framework": (rules.FRAMEWORK_NOISE, False), "licence": (rules.LICENCE_LIKE, False),
    "labels": (rules.LABEL_ARRAY, True), "url": (rules.URL_LIKE, True), "log": (rules.LOG_LIKE, False), "marker": (rules.PROMPT_MARKERS, False),
}


def let(value: Column, body) -> Column:
    """body(x) with x evaluated once, also within lambdas, where Spark doesn't share what occurs twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tests(names: list[str]) -> Column:
    """Tests as data that one expression goes through: written out they are more code than the JVM compiles in one method."""
    listed = []
    for name in names:
        literals = prompt_literals(PROMPT_TESTS[name][0])
        plain, other = ([x for x in literals if x.isascii() is k] for k in (True, False))
        listed.append({"re": _pattern(name), "any": not literals, "plain": plain, "other": other})
    return F.from_json(F.lit(json.dumps(listed)), "array<struct<re: string, any: boolean, plain: array<string>, other: array<string>>>")


def _pattern(name: str) -> str:
    pattern, case = PROMPT_TESTS[name]
    return java(pattern, not case and pattern.lower() != pattern.upper())


def prompt_literals(pattern: str) -> list[str]:
    """A pattern's literals; of one that is a list of characters, these."""
    from re import _parser

    items = _parser.parse(pattern)
    listed = len(items) == 1 and str(items[0][0]) == "IN" and all(str(op) == "LITERAL" for op, _ in items[0][1])
    return sorted({chr(x).lower() for _, x in items[0][1]}) if listed else anchors(pattern)


def _may(test: Column, low: Column) -> Column:
    """Whether a text in small letters holds one of a test's literals; only then its pattern runs. Plain ASCII text isn't searched for others."""
    return test["any"] | F.exists(test["plain"], lambda x: F.contains(low, x)) | ((F.octet_length(low) > F.length(low)) & F.exists(test["other"], lambda x: F.contains(low, x)))


def passes_any(text: Column, low: Column, names: list[str]) -> Column:
    return F.exists(_tests(names), lambda t: _may(t, low) & F.rlike(text, t["re"]))


def prompt_score(text: Column, path: Column, low: Column | None = None, bits: Column | None = None) -> Column:
    """Components and score of a candidate system prompt; low is its text folded, if at hand. Tests that bits (one number, by their order) doesn't mark find nothing in it."""
    names = list(PROMPT_TESTS)

    def count(k: int, x: Column) -> Column:
        t = F.get(_tests(names), F.lit(k))
        marked = _may(t, x) if bits is None else (F.getbit(bits, F.lit(k)) == 1) & _may(t, x)
        return F.when(marked, F.regexp_count(text, F.lit(_pattern(names[k])))).otherwise(0)

    # patterns as literals: Spark keeps an expression's last pattern alone, and would compile those of a list again for each text
    counts = let(folded(text) if low is None else low, lambda x: F.array(*[count(k, x) for k in range(len(names))]))
    return let(counts, lambda n: _scored(text, path, {name: F.get(n, F.lit(k)) for k, name in enumerate(names)}))


def _scored(text: Column, path: Column, n: dict[str, Column]) -> Column:
    on_path = lambda p: found(path, p, True)
    dense = cjk_dense(text)
    length = (F.length(text) - F.when(dense, rules.MIN_LENGTH_SHORT).otherwise(rules.MIN_LENGTH)) / F.when(dense, 180.0).otherwise(520.0)
    opener = (n["opener"] > 0) | (n["opener_intl"] > 0)
    slots, code = n["slot"] >= 2, n["code"] > 0
    minus = lambda test, x: F.when(test, -x).otherwise(0.0)
    parts = {
        "length": F.round(0.20 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), length)), 3),
        "opener": F.when(opener, 0.35).otherwise(0.0),
        "role_language": F.round(F.least(F.lit(0.30), 0.06 * (n["role"] + n["role_intl"])), 3),
        "template_slots": F.when(slots, 0.15).otherwise(0.0),
        "multi_sentence": F.when(F.when(dense, n["ends"] + n["clauses"] >= 1).otherwise(n["ends"] >= 2), 0.10).otherwise(0.0),
        "policy_penalty": minus(n["policy"] > 0, 0.25),
        "path_penalty": minus(on_path(rules.POLICY_PATH), 0.25),
        "markup_penalty": minus(n["markup"] > 0, 0.20),
        "machine_pool_penalty": minus(on_path(rules.MACHINE_POOL_PATH), 0.30),
        "framework_penalty": minus(n["framework"] > 0, 0.35),
        "code_penalty": minus(code, 0.40),
        "licence_penalty": minus(n["licence"] > 0, 0.35),
        "label_array_penalty": minus(n["labels"] >= 3, 0.35),
        "url_penalty": minus(n["url"] > 0, 0.20),
        "log_penalty": minus(n["log"] > 0, 0.30),
    }
    strong = ~code & (opener | slots | (n["marker"] > 0))
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(list(parts.values())[1:], parts["length"])))
    score = F.round(F.when(strong, total).otherwise(F.least(total, F.lit(rules.WEAK_CEILING))), 3)
    return F.struct(*[c.alias(k) for k, c in parts.items()], strong.alias("strong"), score.alias("score"))


def prompt_strong(text: Column, low: Column) -> Column:
    """Whether a run can score over the ceiling of weak ones at all (program text apart)."""
    slots = (text.contains("[") | text.contains("{{")) & (F.regexp_count(text, F.lit(java(rules.TEMPLATE_SLOT))) >= 2)
    return slots | passes_any(text, low, ["opener", "opener_intl", "marker"])


def prompt_candidate(text: Column, low: Column) -> Column:
    """The length gate before scoring."""
    n = F.length(text)
    return F.when(n >= rules.MIN_LENGTH, True).when(n < rules.MIN_LENGTH_SHORT, False).otherwise(cjk_dense(text) | passes_any(text, low, ["opener", "opener_intl"]))


def wilson(successes: Column, n: Column, z: float = 1.96, on_empty: str = "zero") -> Column:
    """Wilson interval (lower, upper) of a proportion; without trials (0, 0), or (0, 1) with on_empty='unit'."""
    p = F.try_divide(successes.cast("double"), n.cast("double"))
    q = F.try_divide(F.lit(z * z), n.cast("double"))
    centre, half = (p + q / 2) / (1 + q), z * F.sqrt(p * (1 - p) / n + q / (4 * n)) / (1 + q)
    lower, upper = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.struct(F.when(n > 0, lower).otherwise(0.0).alias("lower"), F.when(n > 0, upper).otherwise(1.0 if on_empty == "unit" else 0.0).alias("upper"))


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")


def round_exact(x: Column, digits: int = 4) -> Column:
    """A double rounded to so many digits (at most 6) by its exact binary value, halves to even; other rounding goes by its shortest decimal form.

    The number of last digits, x * 10**digits, lies between n and n + 1, and which
    side of n + 0.5 it is on decides: x is the sum of a number of 24 bits and one of
    29, whose products with 10**digits have no rounding, nor has the first one's
    difference from n + 0.5 where it matters; so the sum's sign is exact.
    Numbers of 2**22 and more stay as they are.
    """
    least = 2.0 ** -(4 * digits)  # less than half of the last digit
    size, tens = F.abs(x), F.lit(float(10**digits))
    n = F.floor(size * tens).cast("double")
    high = size.cast("float").cast("double")
    side = (high * tens - (n + 0.5)) + (size - high) * tens
    out = F.when((side > 0) | ((side == 0) & (n % 2 == 1)), n + 1).otherwise(n) / tens
    return F.when(size < least, F.lit(0.0)).when(size < (1 << 22), F.when(x < 0, -out).otherwise(out)).otherwise(x)


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def register(spark) -> None:
    """Functions for SQL: every pattern's expression as a SQL function without Python."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fingerprint(x STRING) RETURNS STRING RETURN left(sha2(CAST(x AS BINARY), 256), 16)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION redact(x STRING) RETURNS STRING RETURN CASE WHEN length(x) <= 60 THEN x ELSE concat(left(x, 30), '…', right(x, 15)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION wilson_lower(k BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN greatest(0D, (k / n + 1.9208D / n - 1.96D * sqrt(k / n * (1 - k / n) / n + 0.9604D / n / n)) / (1 + 3.8416D / n)) ELSE 0D END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION wilson_upper(k BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN least(1D, (k / n + 1.9208D / n + 1.96D * sqrt(k / n * (1 - k / n) / n + 0.9604D / n / n)) / (1 + 3.8416D / n)) ELSE 0D END")


def match_places(text: Column, pattern: Column, matches: Column) -> Column:
    """(matched, offset) of all matches of a pattern, given what it matched: what lies between two matches holds no text of a match by itself, so places add up over the parts that a split leaves."""
    parts = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<matched:string,offset:int>>").alias("out"))

    def step(a: Column, k: Column) -> Column:
        own, at = F.get(matches, k), a["at"] + F.length(F.get(parts, k))
        return F.struct((at + F.length(own)).alias("at"), F.concat(a["out"], F.array(F.struct(own.alias("matched"), at.alias("offset")))).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step, lambda a: a["out"])
