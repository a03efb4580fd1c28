"""Secrets, with weak parts reported where complementary parts meet (operator 10).

Base patterns find assigned secrets, access key ids and hexadecimal strings.
Multipart linking looks at further parts: access identifiers and assigned values
too short for the base rules, opaque tokens, and endpoints. Parts are interval
joined within scopes (a number of characters): the text is cut into bins as wide
as the scope, each part is dealt to the bins that its scope touches and a weak part
also to all that it touches itself, and it is kept by a semi join if a
complementary part begins or ends near it. No pairs are emitted, and a bin holds
no more parts than fit into it.

Defined cases: null or empty text gives no spans and the digest of the empty
string; repeated rows give a row each; a weak part that overlaps a base span is not
one, and of weak parts that overlap the first stays; very long texts and tokens are
read whole in linear time; an empty table gives no rows; other columns, however
named, are not used.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import slices, staged, table, text_or_empty
from textquarry.llm.spans import digest_columns

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
# Weak parts: shorter values and ids, tokens of mixed letters and digits, short hexadecimal strings.
SHORT_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{8,}(?![A-Za-z0-9])")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")
SHORT_HEX = re.compile(r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{12,15}(?![A-Za-z0-9])")
# Endpoints: anything with a scheme; hosts of three labels or more whose last one has letters alone, as endings have; hosts of two and addresses if a port follows. Each begins where a run of its signs does, which keeps the search linear.
ENDPOINT = re.compile(
    r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s\"'<>]{3,}+"
    r"|(?<![A-Za-z0-9.@_-])(?:[A-Za-z0-9][A-Za-z0-9-]*+\.){2,}+[A-Za-z]{2,}+(?::[0-9]{1,5}+)?+(?![A-Za-z0-9-])"
    r"|(?<![A-Za-z0-9.@_-])(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)++(?:[A-Za-z]{2,}+|[0-9]{1,3}+):[0-9]{1,5}+(?![A-Za-z0-9-])"
)
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
SHORT_ASSIGN = 6  # characters of an assigned value that is at least a weak part


def mixed(text: str, start: int, end: int) -> bool:
    """A token is opaque if it has a letter and a digit."""
    return bool(DIGIT.search(text, start, end) and LETTER.search(text, start, end))


def scan(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int, str]]]:
    """Base spans (start, kind, end), and parts (start, kind or '', end, role); parts with a kind are weak."""
    base: list[tuple[int, str, int]] = []
    weak: list[tuple[int, str, int, str]] = []
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 12:
            base.append((m.start(), "assign", m.end()))
        elif len(m[1]) >= SHORT_ASSIGN:
            weak.append((m.start(), "assign", m.end(), "secret"))
    if "AKIA" in text:
        base += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    base.sort()
    if "AKIA" in text or "ASIA" in text:
        weak += [(m.start(), "access", m.end(), "identifier") for m in SHORT_ACCESS.finditer(text)]
    weak += [(m.start(), "assign", m.end(), "secret") for m in OPAQUE.finditer(text) if mixed(text, m.start(), m.end())]
    weak += [(m.start(), "hex", m.end(), "secret") for m in SHORT_HEX.finditer(text)]
    weak.sort()
    starts = [a for a, _, _ in base]
    reach, most = [], 0
    for _, _, b in base:
        most = max(most, b)
        reach.append(most)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not (k and reach[k - 1] > a)

    parts, done = [], -1
    for a, kind, b, role in weak:
        if a >= done and free(a, b):
            parts.append((a, kind, b, role))
            done = b
    parts += [(a, "", b, "identifier" if kind == "access" else "secret") for a, kind, b in base]
    if "." in text or "://" in text:
        parts += [(m.start(), "", m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    return base, parts


FOUND = "struct<base:array<struct<start:int,kind:string,end:int>>,parts:array<struct<start:int,kind:string,end:int,role:string>>>"
SPAN = [("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]
FOUND_TYPE = pa.struct([("base", pa.list_(pa.struct(SPAN))), ("parts", pa.list_(pa.struct([*SPAN, ("role", pa.string())])))])


def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in slices(batches):
        done = []
        for x in batch.to_pylist():
            base, parts = scan(x)
            names = ("start", "kind", "end", "role")
            # parts matter only where one is weak
            weak = parts if any(p[1] for p in parts) else []
            done.append({"base": [dict(zip(names, b, strict=False)) for b in base], "parts": [dict(zip(names, p, strict=True)) for p in weak]})
        yield pa.array(done, FOUND_TYPE)


def linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts of rows (_row, start, kind, end, role) that have a complementary part within `scope` characters.

    An identifier needs a secret; a secret needs an identifier or an endpoint.
    """
    own = F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))
    weak = parts.filter("kind != ''").withColumn("_bin", F.explode(own))
    bins = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    near = parts.select("_row", F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("role").alias("_role"), F.explode(bins).alias("_bin"))
    meets = F.when(F.col("role") == "identifier", F.col("_role") == "secret").otherwise(F.col("_role").isin("identifier", "endpoint"))
    apart = (F.col("_start") < F.col("end") + scope) & (F.col("_end") > F.col("start") - scope)
    w, n = weak.alias("w"), near.alias("n")
    same = (F.col("w._row") == F.col("n._row")) & (F.col("w._bin") == F.col("n._bin"))
    return w.join(n, same & meets & apart, "left_semi").drop("_bin").distinct()


def secrets(docs: DataFrame, scope: int = 200, text: str = "text") -> DataFrame:
    """Rows (doc_id, _row, base, added): spans (start, kind, end) of the base rules and of linked weak parts."""
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.arrow_udf(find, FOUND)(text_or_empty(text)).alias("_found"))
    kept = staged(own.select("doc_id", "_row", "_found.*"))
    parts = kept.filter(F.size("parts") > 0).select("_row", F.explode("parts").alias("p")).select("_row", "p.*")
    new = linked(parts, scope).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return kept.drop("parts").join(new, "_row", "left").withColumn("added", F.coalesce("added", none))


def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(secrets(table(spark, sf_dir, "documents")), KINDS)
