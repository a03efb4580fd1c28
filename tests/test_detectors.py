"""Detectors, deduplication and the whole scan on seeded texts."""

from pyspark.sql import functions as F

from textquarry.operators import detectors as D
from textquarry.operators.tools import find_tools

ROWS = [
    ("a", 0, "assets/x.txt", "see https://api.openai.com/v1/chat/completions and API.OPENAI.COM"),
    ("a", 1, "assets/y.txt", "Lcom/openai/client; com/openaix"),
    ("b", 2, "classes.dex", 'software/amazon/awssdk/services/bedrockruntime {"temperature": 1}'),
    ("c", 3, "assets/db/vectors.pkl", "import chromadb"),
    ("d", 4, "x", 'z {"type": "function", "function": {"name": "f", "parameters": {}}} {"name": "g", "input_schema": {"type": "object"}} "type": "function"'),
]


def sources(spark, rows=ROWS):
    return spark.createDataFrame(rows, "app_id string, source_idx bigint, source_file string, content string")


def test_lexical(spark):
    got = {(r["app_id"], r["provider"], r["matched"], r["is_endpoint"]) for r in D.lexical_matches(sources(spark)).collect()}
    assert got == {("a", "openai", "api.openai.com", True), ("a", "openai", "API.OPENAI.COM", True), ("a", "openai", "com/openai", False), ("b", "aws_bedrock", "software/amazon/awssdk/services/bedrockruntime", False)}
    assert D.lexical_matches(sources(spark), [], []).count() == 0


def test_integration(spark):
    src = sources(spark)
    lex = D.lexical_matches(src)
    got = {r["app_id"]: (r["confirmed"], r["quorum"]) for r in D.integration(lex, D.structural_evidence(src, D.detected_providers(lex))).collect()}
    assert got == {"a": (True, True), "b": (True, False)}


def test_tool_schemas(spark):
    find = lambda x: spark.createDataFrame([(x,)], "text string").select(find_tools(F.col("text")).alias("t")).first()["t"]
    assert [(t["tool_name"], t["confidence"]) for t in find(ROWS[4][3])] == [("f", 0.95), ("g", 0.95), (None, 0.4)]
    assert find('{"type": "function", "function": {"name": "f", oops}}')[0]["confidence"] == 0.5


def test_rag(spark):
    got = {(r["app_id"], r["evidence"], r["severity"]) for r in D.rag_findings(sources(spark)).collect()}
    assert got == {("c", "vectors.pkl", "high"), ("c", "chromadb", "info")}


def test_dedup_keeps_first_of_the_most_confident(spark):
    cols = ", ".join(f"{c} {'double' if c == 'confidence' else 'int' if c.endswith('idx') or c == 'offset' else 'string'}" for c in D.FINDING)
    row = lambda conf, path, idx: ("a", "k", "info", "t", None, None, path, None, None, "e", conf, 0, idx, 0, 0)
    got = D.dedup_findings(spark.createDataFrame([row(0.7, "p", 0), row(0.9, "q", 2), row(0.9, "r", 1)], cols)).collect()
    assert len(got) == 1
    assert (got[0]["file_path"], got[0]["occurrences"], got[0]["locations"]) == ("r", 3, ["p", "q", "r"])


def test_credentials_are_never_kept(spark):
    key = "sk-" + "proj-" + "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY"
    google = "AI" + "zaSyB" + "k3Jd9Lq0Xw7Zv5Tn2Rm8Pc4Hf6Gb1Ya3Qe"
    src = sources(spark, [("a", 0, "f", f"k={key}"), ("a", 1, "f", f"{google[:39]} generativelanguage.googleapis.com"), ("b", 2, "f", google[:39])])
    found, _, _ = D.scan(src)
    rows = [r for r in found.collect() if r["kind"] == "secret"]
    assert {(r["app_id"], r["provider"], r["severity"]) for r in rows} == {("a", "openai", "critical"), ("a", "google_gemini", "high"), ("b", "generic", "medium")}
    assert all(key not in str(r) and google[:39] not in str(r) for r in found.collect())


def test_scan_is_the_same_on_any_partitioning(spark):
    src = sources(spark)
    one, many = (sorted(map(str, D.scan(src.repartition(n))[0].drop("hit_idx").collect())) for n in (1, 7))
    assert one == many
