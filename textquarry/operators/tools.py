"""Tool definitions in texts, without Python: objects by brace depth, their fields as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry import rules
from textquarry.functions import scalars as S
from textquarry.functions.scalars import let

TOOL = "array<struct<offset:int,rule_idx:int,evidence:string,confidence:double,parsed_ok:boolean,tool_name:string>>"


def places(text: Column, pattern: str) -> Column:
    """(matched, offset) of a pattern's matches, none for a null text."""
    re = F.lit(S.java(pattern))
    none = F.array().cast("array<struct<matched:string,offset:int>>")
    return let(F.regexp_extract_all(text, re, F.lit(0)), lambda every: F.when(F.size(every) > 0, S.match_places(text, re, every)).otherwise(none))


def enclosing_object(text: Column, at: Column) -> Column:
    """The object from the nearest { before a place (from 0) to the } that balances it; braces in strings count too. Null without either.

    The depth runs over the braces from there on; the first return to 0 is the end,
    and what the braces before it set apart adds up to its place.
    """
    head = F.left(text, at)
    start = at - F.length(F.substring_index(head, "{", -1)) - 1

    def step(a: Column, brace: Column) -> Column:
        depth = a["depth"] + F.when(brace == "{", 1).otherwise(-1)
        end = F.when(a["end"] >= 0, a["end"]).when(depth == 0, a["k"]).otherwise(-1)
        return F.struct(depth.alias("depth"), (a["k"] + 1).alias("k"), end.alias("end"))

    def cut(rest: Column, k: Column) -> Column:
        parts = F.slice(F.split(rest, "[{}]", k + 2), F.lit(1), k + 1)
        return F.left(rest, F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x)) + k + 1)

    def balanced(rest: Column) -> Column:
        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("k"), F.lit(-1).alias("end"))
        walk = F.aggregate(F.regexp_extract_all(rest, F.lit("[{}]"), F.lit(0)), zero, step, lambda a: a["end"])
        return let(walk, lambda k: F.when(k >= 0, cut(rest, k)))

    return F.when(F.contains(head, F.lit("{")), let(F.substring(text, start + 1, F.length(text)), balanced))


def _judged(own: Column) -> Column:
    """confidence, parsed_ok and tool_name of an object."""

    def of(v: Column) -> Column:
        kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        word = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(v, path, "string"))
        function = F.coalesce(word("$.type") == "function", F.lit(False))
        real = function & word("$.function.name").isNotNull() & kind("$.function.parameters").isNotNull() | word("$.name").isNotNull() & F.coalesce(word("$.input_schema.type") == "object", F.lit(False))
        confidence = F.when(v.isNull(), 0.5).when(real, 0.95).otherwise(0.7)
        return F.struct(confidence.alias("confidence"), v.isNotNull().alias("parsed_ok"), F.when(function, word("$.function.name")).otherwise(word("$.name")).alias("tool_name"))

    return let(F.try_parse_json(own), of)


def find_tools(text: Column) -> Column:
    """Tool definitions (TOOL) of a text: each distinct object once, and signs of one at places where no object was found, which count for little. Null for a null text."""

    def objects(rule: int, pattern: str) -> Column:
        return F.transform(places(text, pattern), lambda m: F.struct(F.lit(rule).alias("rule_idx"), m["offset"].alias("offset"), enclosing_object(text, m["offset"]).alias("own")))

    def whole(x: Column) -> Column:
        return let(_judged(x["own"]), lambda j: F.struct(x["offset"].alias("offset"), x["rule_idx"].alias("rule_idx"), F.left(x["own"], F.lit(300)).alias("evidence"), j["confidence"].alias("confidence"), j["parsed_ok"].alias("parsed_ok"), j["tool_name"].alias("tool_name")))

    def sign(m: Column) -> Column:
        null = F.lit(None)
        return F.struct(m["offset"].alias("offset"), F.lit(2).alias("rule_idx"), F.substring(text, m["offset"] + 1, F.lit(80)).alias("evidence"), F.lit(0.4).alias("confidence"), null.cast("boolean").alias("parsed_ok"), null.cast("string").alias("tool_name"))

    def listed(first: Column) -> Column:
        alone = F.filter(places(text, rules.TOOL_SHORT), lambda m: ~F.exists(first, lambda x: x["offset"] == m["offset"]))
        return F.concat(F.transform(first, whole), F.transform(alone, sign))

    found = F.filter(F.concat(objects(0, rules.TOOL_FULL), objects(1, rules.TOOL_INPUT)), lambda x: x["own"].isNotNull())
    once = let(found, lambda every: F.filter(every, lambda x, k: ~F.exists(F.slice(every, F.lit(1), k), lambda y: y["own"] == x["own"])))
    return F.when(text.isNotNull(), let(once, listed))
