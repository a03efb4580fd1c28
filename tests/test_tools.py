"""Tool definitions against a plain walk over characters and the JSON module."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from textquarry import rules
from textquarry.operators.tools import enclosing_object as column_of_object
from textquarry.operators.tools import find_tools


def enclosing_object(text: str, at: int) -> str | None:
    """The object from the nearest { before a position to the } that balances it; braces in strings count too."""
    start = text.rfind("{", 0, at)
    depth = 0
    for k in range(start, len(text)) if start >= 0 else ():
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return text[start : k + 1]
    return None


def is_real_tool(x: object) -> bool:
    if not isinstance(x, dict):
        return False
    function, schema = x.get("function"), x.get("input_schema")
    if x.get("type") == "function" and isinstance(function, dict) and isinstance(function.get("name"), str) and "parameters" in function:
        return True
    return isinstance(x.get("name"), str) and isinstance(schema, dict) and schema.get("type") == "object"


def tool_schemas_in(text: str) -> list[dict]:
    """Tool definitions of one source; fragments at places where nothing fuller was found count for little."""
    out, objects, places = [], set(), set()
    for k, pattern in enumerate((rules.TOOL_FULL, rules.TOOL_INPUT)):
        for m in re.finditer(pattern, text):
            own = enclosing_object(text, m.start())
            if own is None or own in objects:
                continue
            objects.add(own)
            places.add(m.start())
            try:
                parsed = json.loads(own)
            except ValueError:
                parsed = None
            name = None
            if isinstance(parsed, dict):
                inner = parsed.get("function")
                name = (inner if isinstance(inner, dict) else {}).get("name") if parsed.get("type") == "function" else parsed.get("name")
            confidence = 0.95 if is_real_tool(parsed) else 0.7 if parsed is not None else 0.5
            out.append({"offset": m.start(), "rule_idx": k, "evidence": own[:300], "confidence": confidence, "parsed_ok": parsed is not None, "tool_name": name if isinstance(name, str) else None})
    for m in re.finditer(rules.TOOL_SHORT, text):
        if m.start() not in places:
            out.append({"offset": m.start(), "rule_idx": 2, "evidence": text[m.start() : m.start() + 80], "confidence": 0.4, "parsed_ok": None, "tool_name": None})
    return out


FULL = '{"type": "function", "function": {"name": "f%d", "parameters": {"type": "object"}}}'
PIECES = [FULL % 1, FULL % 2, '{"name": "g", "input_schema": {"type": "object"}}', '"type": "function" alone', '{"type": "function", "function": {"name": "f", oops}}', "{", "}", "{}", '"', "\n", "é漢\U0001f600 ", '{"type": "function", "function": {"name": 5, "parameters": 1}}',
          '{"type" :\t"function"\u00a0, "function": {"name": "wide"}}', '{"name": null, "input_schema" : {"type": "object"}}', '{"name": "h", "input_schema": {"type": "object", "x": [1, {"a": "}"}]}}', '{"a": [' + FULL % 3 + "]}", "x" * 50]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    return [None, "", *PIECES, *made, "{" * 300 + FULL % 4 + "}" * 299, " ".join(FULL % k for k in range(60)), '"type": "function" ' * 50]


def test_tools_are_those_of_the_plain_walk(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: None if r["t"] is None else [x.asDict() for x in r["t"]] for r in rows.select("k", find_tools(F.col("text")).alias("t")).collect()}
    for k, text in enumerate(texts):
        assert got[k] == (None if text is None else tool_schemas_in(text)), text
    assert sum(len(x or ()) for x in got.values()) > 300


def test_objects_by_depth(spark, texts):
    rng = random.Random(3)
    rows = [(k, t, rng.randint(0, len(t))) for k, t in enumerate(texts) if t]
    got = {r["k"]: r["o"] for r in spark.createDataFrame(rows, "k int, text string, at int").select("k", column_of_object(F.col("text"), F.col("at")).alias("o")).collect()}
    assert got == {k: enclosing_object(t, at) for k, t, at in rows}


def test_no_python_worker(spark):
    rows = spark.createDataFrame([("a",)], "text string")
    assert "Python" not in rows.select(find_tools(F.col("text")))._jdf.queryExecution().executedPlan().toString()
