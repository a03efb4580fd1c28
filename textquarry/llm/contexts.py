"""Personal data by patterns and bootstrapped contexts (operator 5).

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They
seed a bootstrap in the manner of Snowball: a mention's left context (the end of the
word before it, however far, or none) with its exact shape, and its left context, its
right context (the begin of the word after it) and both with its looser form are
lexical patterns. Patterns and the
strings they cover (instances) make a bipartite graph; its scores are iterated in
Spark: a pattern is as good as its instances, an instance as good as its best
pattern, with the seeds fixed; instances over the threshold propose patterns in
the next round as seeds do. Patterns over a threshold then mark candidates that the
base rules missed: identifier-like tokens (a digit or @ among letters, digits and
joining signs), of any length (long ones are known by their digests).

Defined cases: null or empty text gives no spans and the digest of the empty
string; repeated rows give a row each; ties between patterns go to the kind
listed first; very long texts and runs of digits or letters take linear time; an
empty table gives no rows; other columns, however named, are not used.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import few, slices, staged, table, text_or_empty, whole
from textquarry.llm.spans import digest_columns

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always begins where a run of digits begins, so a look-behind changes nothing but the time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates: identifier-like tokens with a digit or an at sign.
CANDIDATE = re.compile(r"[+(]?[A-Za-z0-9](?:[A-Za-z0-9@._%+()/:\[\]-]|(?<=[0-9)])\x20(?=[0-9(]))*")
LONGEST = 80  # characters of a string or shape that is kept itself, not as its digest
MARK = re.compile(r"[0-9@]")
SPACES, CONTEXT = frozenset(" \t\n\v\f\r"), 24
DIGITS, UPPERS, LOWERS = re.compile("[0-9]+"), re.compile("[A-Z]+"), re.compile("[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: each ends a run of local characters at an at sign, so only those are looked at."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns' matches, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    """Runs of digits as one to four 9 by length (3, 7, 13 and more), of capitals as A, of small letters as a; other signs stay."""
    return DIGITS.sub(lambda m: "9" * (1 + bisect_left((4, 8, 14), len(m[0]) + 1)), UPPERS.sub("A", LOWERS.sub("a", token)))


def form(token: str) -> str:
    """Looser than the shape: @ if there is one, else 9 and a band of the number of digits if they outnumber the letters, else a."""
    if "@" in token:
        return "@"
    digits = sum("0" <= c <= "9" for c in token)
    return f"9{bisect_left((4, 7, 14), digits + 1)}" if digits > sum(map(str.isalpha, token)) else "a"


def short(token: str) -> str:
    return token if len(token) <= LONGEST else "#" + hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest()


def right_context(text: str, end: int) -> str:
    """The first CONTEXT characters of the word after a mention."""
    while end < len(text) and text[end] in SPACES:
        end += 1
    to = end
    while to < len(text) and to - end < CONTEXT and text[to] not in SPACES:
        to += 1
    return text[end:to].lower() or "$"


def left_context(text: str, start: int) -> str:
    """The last CONTEXT characters of the word before a mention."""
    while start and text[start - 1] in SPACES:
        start -= 1
    at = start
    while at and start - at < CONTEXT and text[at - 1] not in SPACES:
        at -= 1
    return text[at:start].lower() or "^"


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, str, str, str, str]]:
    """(start, end, kind or '', left context, right context, shape, form, string) of seeds and of candidates that overlap none."""

    def mention(a: int, b: int, kind: str) -> tuple[int, int, str, str, str, str, str, str]:
        token = text[a:b]
        return a, b, kind, left_context(text, a), right_context(text, b), short(shape(token)), form(token), short(token)

    out = [mention(a, b, KINDS[k]) for a, k, b in base]
    starts, reach, at = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max)), 0
    if MARK.search(text):
        for m in MARK.finditer(text):
            if m.start() < at:
                continue
            start = m.start()
            while start > at and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "@._%+(-")):
                start -= 1
            found = CANDIDATE.match(text, start)
            end = max(found.end() if found else 0, m.end())
            at = end
            end -= len(text[start:end]) - len(text[start:end].rstrip(".:/-(["))
            over = bisect_left(starts, end)  # base spans that begin before the end
            if 4 <= end - start and not (over and reach[over - 1] > start):
                out.append(mention(start, end, ""))
    return out


FOUND = "struct<base:array<struct<start:int,kind:string,end:int>>,mentions:array<struct<start:int,end:int,kind:string,before:string,after:string,shape:string,form:string,string:string>>>"
FOUND_TYPE = pa.struct([
    ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))),
    ("mentions", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("before", pa.string()), ("after", pa.string()), ("shape", pa.string()), ("form", pa.string()), ("string", pa.string())]))),
])


def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = ("start", "end", "kind", "before", "after", "shape", "form", "string")
    for batch in slices(batches):
        done = []
        for x in batch.to_pylist():
            base = base_spans(x)
            done.append({"base": [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in base], "mentions": [dict(zip(names, m, strict=True)) for m in mentions(x, base)]})
        yield pa.array(done, FOUND_TYPE)


PATTERN = ["before", "form", "after"]


def patterned(seen: DataFrame) -> DataFrame:
    """Mentions once for each pattern (before, form, after) that covers them; '' stands for any context, a context that is missing makes no pattern alone."""
    left, right, loose, any_ = F.col("before"), F.col("after"), F.concat(F.lit("~"), "form"), F.lit("")

    def pattern(before, form, after):
        return F.struct(before.alias("before"), form.alias("form"), after.alias("after"))

    has_left, has_right = left != "^", right != "$"
    all_ = F.array(
        pattern(left, F.concat(F.lit("="), "shape"), any_), F.when(has_left, pattern(left, loose, any_)),
        F.when(has_right, pattern(any_, loose, right)), F.when(has_left & has_right, pattern(left, loose, right)),
    )
    rest = [c for c in seen.columns if c not in ("before", "after", "shape", "form")]
    return seen.select(*rest, F.explode(F.array_compact(all_)).alias("_p")).select(*rest, "_p.*")


def score_patterns(seen: DataFrame, rounds: int = 3, support: int = 3, threshold: float = 0.5) -> DataFrame:
    """Scores of patterns (before, form, after, kind) from patterned mentions (kind, before, form, after, string).

    A pattern proposes a kind that one of its own seeds has, or one of its instances
    over the threshold in the round before. Its score is the
    mean score of its instances, weighed by the logarithm of how often they
    occur and shrunk towards 0 by `support`; an instance's score for a kind is
    1 if it is a seed of it anywhere, 0 if it is one of another kind, and else the best score of
    a pattern that covers it. Only counts and scores are joined, never pairs of mentions.
    """
    edges = staged(seen.groupBy(*PATTERN, "string").agg(F.count("*").alias("n")))
    seeds = staged(seen.filter("kind != ''").select("string", "kind").distinct())
    known = seeds.groupBy("string").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    weight, sure, best = F.log1p("n"), seeds, None
    for k in range(rounds):
        proposed = edges.join(sure, "string").select(*PATTERN, "kind").distinct()
        links = edges.join(proposed, PATTERN).join(known, "string", "left")
        links = links.withColumn("fixed", F.when(F.col("kinds").isNotNull(), F.array_contains("kinds", F.col("kind")).cast("double"))).drop("kinds")
        links = links.withColumn("best", F.lit(0.0)) if best is None else links.join(best, ["string", "kind"], "left")
        links = staged(links.withColumn("score", F.coalesce("fixed", "best", F.lit(0.0))).drop("best"))
        mean = (F.sum(F.col("score") * weight) / (F.sum(weight) + support)).alias("score")
        scores = staged(links.groupBy(*PATTERN, "kind").agg(mean))
        if k == rounds - 1:
            return scores
        best = staged(links.filter("fixed is null").drop("score").join(scores, [*PATTERN, "kind"]).groupBy("string", "kind").agg(F.max("score").alias("best")))
        sure = seeds.unionByName(best.filter(F.col("best") >= threshold).select("string", "kind"))
    return None


def identity(doc_id: Column, text: Column) -> Column:
    """128 bits of a document's id, which may be null, and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-")), F.lit("\n"), text).cast("binary")))


def personal_data(docs: DataFrame, threshold: float = 0.5, rounds: int = 3, text: str = "text") -> DataFrame:
    """Rows (doc_id, _row, _key, base, added): _key is 128 bits of id and text; spans (start, kind, end) of the base rules and of the bootstrap."""
    whole = text_or_empty(text)
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), identity(F.col("doc_id"), whole).alias("_key"), F.arrow_udf(find, FOUND)(whole).alias("_found"))
    kept = staged(own.select("doc_id", "_row", "_key", "_found.*"))
    seen = kept.filter(F.size("mentions") > 0).select("_row", F.explode("mentions").alias("m")).select("_row", "m.*")
    scores = score_patterns(patterned(seen.drop("_row", "start", "end")), rounds, threshold=threshold).filter(F.col("score") >= threshold)
    order = F.struct(-F.col("score"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.col("kind"))
    chosen = few(staged(scores.groupBy(*PATTERN).agg(F.min_by(F.struct(F.col("kind").alias("_kind"), order.alias("_order")), order).alias("_c")).select(*PATTERN, "_c.*")))
    marked = patterned(seen.filter("kind = ''").drop("kind", "string")).join(chosen, PATTERN).groupBy("_row", "start", "end").agg(F.min_by("_kind", "_order").alias("kind"))
    new = marked.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return kept.drop("mentions").join(new, "_row", "left").withColumn("added", F.coalesce("added", none))


def op5_contextual_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(personal_data(table(spark, sf_dir, "documents")), KINDS)


def redact(docs: DataFrame, found: DataFrame, most: int = 500_000) -> DataFrame:
    """docs with each span of found replaced by <kind>; found is broadcast if it has at most `most` rows and spans (30 bytes each), else joined by a shuffle."""
    spans = staged(found.filter(F.size("base") + F.size("added") > 0).select("_key", F.concat("base", "added").alias("_spans")).dropDuplicates(["_key"]))
    if spans.agg(F.coalesce(F.count("*") + F.sum(F.size("_spans")), F.lit(0))).first()[0] <= most:
        spans = F.broadcast(spans)

    @F.arrow_udf("string")
    def cover(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([covered(x, s) for x, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    keyed = docs.select(whole(docs).alias("_doc"), identity(F.col("doc_id"), text_or_empty()).alias("_key"), F.col("text").alias("_text")).join(spans, "_key", "left")
    clean = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(cover("_text", F.coalesce("_spans", F.array().cast("array<struct<start:int,kind:string,end:int>>"))))
    return keyed.select(F.col("_doc").withField("text", clean).alias("_doc")).select("_doc.*")


def covered(text: str | None, spans: list[dict]) -> str | None:
    """text with its spans replaced by <kind>; overlapping spans are covered as one, by the first and longest one's kind."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>"]
            at = s["end"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]
