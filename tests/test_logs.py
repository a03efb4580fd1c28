"""Order of lines, transcripts, the ledger's snapshot, exact rounding and shares by bits."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from textquarry import rules
from textquarry.functions import scalars as S
from textquarry.operators import corpus as C
from textquarry.operators import prevalence as P
from textquarry.operators.snapshots import Ledger, export_rows
from textquarry.plans import logs
from textquarry.sources import tables as T


def test_last_line_wins_across_appended_files(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for name in ("b.jsonl", "a.jsonl"):  # later by time, not by name
        with open(tmp_path / name, "w") as f:
            for _ in range(3000):
                key, note = rng.choice("pqrst"), rng.randint(0, 10**9)
                f.write(rng.choice([json.dumps({"key": key, "note": note}), json.dumps({"key": key, "note": note}), "not json", json.dumps({"note": 1})]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for name in ("b.jsonl", "a.jsonl"):
            for line in (tmp_path / name).read_text().splitlines():
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if "key" in row:
                    want[row["key"]] = row["note"]
        import os

        os.utime(tmp_path / "b.jsonl", (1000, 1000))
        assert T.lines(spark, str(tmp_path)).select("split").distinct().count() > 5
        for n in (1, 6):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {r["key"]: r["note"] for r in T.last_lines(spark, str(tmp_path), "key string, note bigint", "key").collect()}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


TRANSCRIPT = """preamble
com.a  [scanner: 3 findings, llm=1]  AGREE
   detail one

   detail two
com.b [scanner: 0 findings, llm=0]  SCANNER SAID EMPTY but there is AGREE
com.c  [scanner: 12 findings, llm=1]  nothing much
   last
"""


def test_audit_blocks(spark, tmp_path):
    (tmp_path / "log.txt").write_text(TRANSCRIPT)
    for size in ("40", "100000"):  # lines cut into many parts, or into one
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        blocks = T.audit_blocks(spark, str(tmp_path / "log.txt"))
        got = sorted(map(tuple, blocks.collect()))
        assert got == [(1, "com.a", 3, True, "AGREE", 2), (2, "com.b", 0, False, "SCANNER SAID EMPTY but there is AGREE", 0), (3, "com.c", 12, True, "nothing much", 1)]
        assert T.audit_tally(blocks).first().asDict() == {"audited": 3, "llm_audited": 2, "empty_but_signal": 1, "agree": 1, "weak": 1}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_transcript_that_doesnt_add_up_fails(spark, tmp_path):
    (tmp_path / "log.txt").write_text(TRANSCRIPT + "com.d [scanner: many findings, llm=1]  AGREE\n")
    with pytest.raises(Exception, match="verdicts 3 of 4 audited"):
        T.audit_tally(T.audit_blocks(spark, str(tmp_path / "log.txt"))).collect()


def events(rng, n, start):
    kinds = ["enroll", "downloaded", "scanned", "download_failed", "scan_failed", "reset"]
    return [(f"k{rng.randint(0, 30)}", start + k // 3, k, rng.choice(kinds)) for k in range(n)]


def test_ledger_snapshot_is_the_whole_fold(spark):
    rng, log, ledger = random.Random(7), [], Ledger(spark, buckets=3)
    frame = lambda rows: spark.createDataFrame(rows, "sha256 string, at long, seq bigint, event string").withColumn("at", F.timestamp_seconds("at"))
    assert ledger.state().count() == 0
    for k in range(5):
        new = events(rng, 60 if k != 3 else 0, 1000 * (k + 1))
        log += new
        ledger.append(frame(new))
        want = sorted(map(tuple, C.fold(frame(log)).select("sha256", "state", "attempts").collect()))
        assert sorted(map(tuple, ledger.state().collect())) == want
    assert ledger.versions() == [4, 5]
    for partitions in ("2", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        plan = ledger.merged(frame(events(rng, 9, 9000)))._jdf.queryExecution().executedPlan().toString()
        snapshot = plan[: plan.index("ledger_")].splitlines()  # from the join down to the scan of the snapshot
        join = max(i for i, x in enumerate(snapshot) if "SortMergeJoin" in x)
        assert not any("Exchange" in x for x in snapshot[join:])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    names = spark.createDataFrame([("k1", "one")], "sha256 string, pkg_name string")
    rows = export_rows(ledger.state(), names, ["pkg_name"]).collect()
    assert [r["sha256"] for r in rows] == sorted(r["sha256"] for r in rows) and {r["sha256"]: r["pkg_name"] for r in rows}["k1"] == "one"
    ledger.drop()
    assert not ledger.versions()


def test_rounding_is_of_the_binary_value(spark):
    rng, values = random.Random(5), [0.0, -0.0, 0.00005, 2.675, 0.03125, -0.03125, 0.09375, 1.00005, 4.00005, 3.99995, 4194303.99995, 1e15 + 0.5, 1e-300, 5e-5, 1.5e-4]
    for _ in range(10_000):
        base = rng.randint(0, 40_000) / 10_000 + 0.00005
        bits = struct.unpack("<q", struct.pack("<d", base))[0] + rng.randint(-2, 2)
        values.append(rng.choice([struct.unpack("<d", struct.pack("<q", bits))[0], rng.random(), (2 * rng.randint(0, 1 << 20) + 1) / (1 << rng.randint(5, 18)), -base * rng.randint(1, 1000)]))
    got = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").select("k", S.round_exact(F.col("x")).alias("r")).orderBy("k").collect()
    wrong = [(x, r["r"], round(x, 4)) for x, r in zip(values, got, strict=True) if r["r"] != (round(x, 4) if abs(x) < 1 << 22 else x)]
    assert not wrong


def test_shares_are_set_algebra(spark):
    rng = random.Random(9)
    kinds = [("secret", "openai"), ("secret", "aws_bedrock"), ("secret", "generic"), ("secret", None), ("system_prompt", None), ("tool_schema", None), ("rag_artefact", None), ("llm_endpoint", "openai")]
    texts = ["you are a helper", "i want you to act as a poet", "neither"]
    rows = [(f"a{rng.randint(0, 40)}", *rng.choice(kinds), rng.choice(texts), rng.choice(["classes.dex", "assets/x", "", None])) for _ in range(70)]
    findings = spark.createDataFrame(rows, "app_id string, kind string, provider string, evidence string, file_path string")
    scanned = [f"a{k}" for k in range(50)]
    confirmed = {a for a in scanned if rng.random() < 0.5}
    integration = spark.createDataFrame([(a, a in confirmed) for a in scanned[:40]], "app_id string, confirmed boolean")
    confirmed &= set(scanned[:40])
    of = lambda test: {r[0] for r in rows if test(r)}
    cred = of(lambda r: r[1] == "secret" and r[2] not in (None, "generic"))
    system, preset = of(lambda r: r[1] == "system_prompt" and r[3] == texts[0]), of(lambda r: r[1] == "system_prompt" and r[3] == texts[1])
    kind = {k: of(lambda r, k=k: r[1] == k) for k in rules.KINDS}
    union = cred | system | kind["tool_schema"] | kind["rag_artefact"]
    want = {
        "inference_credential": cred, "other_secret": of(lambda r: r[1] == "secret" and r[2] in (None, "generic")), "system_prompt": system, "preset_only": preset - system, "tool_schema": kind["tool_schema"], "rag_artefact": kind["rag_artefact"],
        "llm_endpoint": kind["llm_endpoint"], "any_artefact": union, "no_artefact": confirmed - union, "finding_outside_dex": of(lambda r: r[4] == "assets/x"),
    }
    apps = P.memberships(findings, integration, spark.createDataFrame([(a,) for a in scanned + scanned], "app_id string"))
    got = {r["category"]: r for r in P.prevalence(apps).collect()}
    assert {k: (r["successes"], r["n"]) for k, r in got.items()} == {k: (len(v & confirmed), len(confirmed)) for k, v in want.items()}
    assert got["inference_credential"]["proportion"] == round(len(cred & confirmed) / len(confirmed), 4)
    attributed = cred - confirmed
    aws = {a for a in attributed if {r[2] for r in rows if r[0] == a and r[1] == "secret" and r[2] not in (None, "generic")} == {"aws_bedrock"}}
    missed, sens = len(attributed - aws), {r["category"]: (r["successes"], r["n"]) for r in P.sensitivity(apps).collect()}
    wide = len(confirmed) + missed
    assert sens == {
        "rejected_with_provider_credential": (len(attributed), 50 - len(confirmed)), "ambiguous_only": (len(aws), 50 - len(confirmed)), "unambiguous_credential": (missed, 50 - len(confirmed)), "integration": (wide, 50),
        "inference_credential": (len(cred & confirmed) + missed, wide), "any_artefact": (len(union & confirmed) + missed, wide),
    }
    one = P.co_occurrence(apps).first()
    assert (one["first"], one["both"]) == (len(cred & confirmed), len(cred & system & confirmed))
    assert P.prevalence(apps.limit(0)).filter("n = 0 and ci_upper = 1").count() == 10


def test_utf16_strings_are_those_of_a_loop(spark):
    from textquarry.sources.archives import utf16_strings

    rng = random.Random(3)
    blobs = [None, b"", b"a", b"a\0b", "wide text".encode("utf-16-le"), b"\0" + "wide".encode("utf-16-le"), ("x" * 50_000).encode("utf-16-le")]
    for _ in range(200):
        blobs.append(b"".join(rng.choice([rng.choice("ab \t~\n\x7fé漢\U0001f600").encode("utf-16-le"), rng.choice("abc").encode("utf-16-le") * 5, bytes([rng.randrange(256)])] if rng.random() < 0.2 else ["wxyz"[rng.randrange(4)].encode("utf-16-le")]) for _ in range(rng.randint(0, 60))))
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(blobs)], "k int, content binary")
    for chunk in (16, 1 << 20):
        got = {r["k"]: r["f"] for r in rows.select("k", S.utf16_strings(F.col("content"), 4, chunk).alias("f")).collect()}
        assert got == {k: None if x is None else utf16_strings(x, 4, chunk) for k, x in enumerate(blobs)}


def test_rounded_numbers_against_sql_with_zeros_of_both_signs(spark, tmp_path):
    import duckdb

    rows = [(k, 900.0 + k, k % 7, 0.05 / 0.7 - e, k % 5, k % 3) for k in range(30) for e in (0.0, 1e-5, 1e-4, -1e-5)] + [(None, None, None, None, None, None)] * 2
    frame = spark.createDataFrame(rows, "l_orderkey bigint, l_extendedprice double, l_partkey bigint, l_discount double, l_suppkey bigint, l_linenumber bigint")
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {r["rounded"]: r["n"] for r in logs.h32_rounding(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(logs.ORACLE_SQL["h32_rounding"]).fetchall())
    assert {"0.0000", "-0.0000", None} <= set(got)


def test_rounding_is_compiled_as_a_whole(spark):
    plan = spark.range(3).select(S.round_exact(F.col("id") / 7))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    assert "decimal" not in plan
