"""Rules over texts in one read: an automaton of all rules' literals marks candidates, patterns then run on those alone.

All families' rules share one automaton, compiled once in a worker. For each text
it gives the rules of which the text holds a literal (and those without literals),
as a set of bits. Then one projection applies the marked rules' patterns in place
and gives an array of matches, so a text is neither joined with the rules nor
copied, and several families cost one read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import scalars as S

MATCH = "array<struct<family: int, rule_idx: int, hit_idx: int, matched: string, offset: int>>"
#: What is taken of a text for a rule: each match, each match with its place, or only that there is one.
EVERY, PLACES, ANY = range(3)


@dataclass(frozen=True)
class Rule:
    family: int
    rule_idx: int
    pattern: str  # in Java's form
    literals: tuple[str, ...]  # in small letters; each match holds one of them, if there are any
    take: int = EVERY


# Letters whose small form is one in ASCII to patterns that ignore case, and that lower() keeps.
FOLDS = {"\u0130": "i", "\u0131": "i", "\u017f": "s"}


def folded(text: str) -> str:
    if not text.isascii():
        for letter, small in FOLDS.items():
            text = text.replace(letter, small)  # str.translate takes several times as long as all the rest of a text's search
    return text.lower()


def rules_of(family: int, patterns: Sequence[tuple[str, str]], take: int = EVERY) -> list[Rule]:
    """Rules from (plain pattern, its Java form), numbered in order."""
    return [Rule(family, k, java, tuple(map(folded, S.anchors(plain))), take) for k, (plain, java) in enumerate(patterns)]


def marks(rules: Sequence[Rule], text: Column) -> Column:
    """The rules that may match a text, as bits: rule k is bit k % 64 of long k // 64; null text has none."""
    longs = -(-len(rules) // 64)

    @F.arrow_udf("array<bigint>")
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        always, of = 0, {}
        for k, rule in enumerate(rules):
            always |= 0 if rule.literals else 1 << k
            for literal in rule.literals:
                of[literal] = of.get(literal, 0) | 1 << k
        automaton = ahocorasick.Automaton()
        for literal, bits in of.items():
            automaton.add_word(literal, bits)
        if of:
            automaton.make_automaton()

        def one(x: str | None) -> list[int] | None:
            if x is None:
                return None
            bits = always
            for own in {own for _, own in automaton.iter(folded(x))} if of else ():
                bits |= own
            raw = bits.to_bytes(8 * longs, "little")
            return [int.from_bytes(raw[k : k + 8], "little", signed=True) for k in range(0, 8 * longs, 8)]

        for batch in batches:
            yield pa.array([one(x.as_py()) for x in batch], pa.list_(pa.int64()))

    return mark(text)


def marked(bits: Column, k: int) -> Column:
    """Whether rule k is marked."""
    return F.coalesce(F.getbit(F.get(bits, F.lit(k // 64)), F.lit(k % 64)) == 1, F.lit(False))


def constant(rows: Sequence[dict], kind: str) -> Column:
    """An array of structs as one literal; long lists built Column by Column take seconds to plan."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def matches(bits: Column, text: Column, rules: Sequence[Rule]) -> Column:
    """The matches (MATCH) of the marked rules in a text, rules in order; the patterns of other rules are not tried."""
    listed = constant([{"k": k, "family": r.family, "rule_idx": r.rule_idx, "re": r.pattern, "take": r.take} for k, r in enumerate(rules)], "k: int, family: int, rule_idx: int, re: string, take: int")
    some = F.filter(listed, lambda r: F.getbit(F.get(bits, F.floor(r["k"] / 64).cast("int")), r["k"] % 64) == 1)

    def match(r: Column, hit: Column, matched: Column, offset: Column) -> Column:
        return F.struct(r["family"].alias("family"), r["rule_idx"].alias("rule_idx"), hit.cast("int").alias("hit_idx"), matched.alias("matched"), offset.alias("offset"))

    no_text, no_place = F.lit(None).cast("string"), F.lit(None).cast("int")

    def found(r: Column) -> Column:
        every = F.regexp_extract_all(text, r["re"], F.lit(0))
        placed = F.when(F.size(every) > 0, S.match_places(text, r["re"], every)).otherwise(F.array().cast("array<struct<matched:string,offset:int>>"))
        return (
            F.when(r["take"] == ANY, F.when(F.rlike(text, r["re"]), F.array(match(r, F.lit(0), no_text, no_place))).otherwise(F.array().cast(MATCH)))
            .when(r["take"] == PLACES, F.transform(placed, lambda m, i: match(r, i, m["matched"], m["offset"])))
            .otherwise(F.transform(every, lambda m, i: match(r, i, m, no_place)))
        )

    return F.flatten(F.transform(some, found))


def hits(texts: DataFrame, rules: Sequence[Rule], keys: Sequence[str], text: str = "content") -> DataFrame:
    """A row (keys, family, rule_idx, hit_idx, matched, offset) for each match of the rules in the texts."""
    some = texts.select(*keys, F.col(text).alias("_text"), marks(rules, F.col(text)).alias("_bits"))
    # an outer explode: an inner one would make Spark evaluate the patterns again to drop empty arrays
    return some.select(*keys, F.explode_outer(matches(F.col("_bits"), F.col("_text"), rules)).alias("_m")).filter("_m is not null").select(*keys, "_m.*")
