"""Runs, retention, renderers, publication, commands, rules of one's own."""

import random

from pyspark.sql import functions as F

from test_sources import package
from textquarry import cli
from textquarry.operators import corpus as C
from textquarry.operators import detectors as D
from textquarry.sources import archives as A
from textquarry.sources import renderers as R
from textquarry.sources import tables as T
from textquarry.streaming import runs as J

SOURCES = "app_id string, source_idx int, source_file string, content string"


def test_each_application_has_one_outcome(spark):
    ledger = spark.createDataFrame([("a", "pending", 0), ("b", "pending", 0), ("c", "scan_failed", 1), ("d", "scanned", 0), ("e", "scan_failed", 3)], "sha256 string, state string, attempts int")
    manifest = spark.createDataFrame([(x, 10) for x in "abcdef"], "sha256 string, apk_size bigint")
    sources = spark.createDataFrame([("a", 0, "x", "api.openai.com", None), ("a", 1, "y", "none", None), ("c", 0, None, None, "BadZipFile: x"), ("d", 0, "x", "api.openai.com", None)], SOURCES + ", error string")
    run = J.bounded_run(ledger, manifest, sources)
    got = {r["sha256"]: (r["event"], r["n_findings"], r["llm_integrated"], r["providers"], r["bytes"]) for r in run.outcomes.collect()}
    assert got == {"a": ("scanned", 1, True, ["openai"], 10), "b": ("download_failed", None, None, [], 0), "c": ("scan_failed", None, None, [], 10)}
    rows, seen = J.observed(run.outcomes)
    rows.collect()
    assert (seen.get["scanned"], seen.get["download_failed"], seen.get["scan_failed"], seen.get["bytes_downloaded"], seen.get["findings"]) == (1, 1, 1, 20, 1)
    assert J.bounded_run(ledger, manifest.limit(0), sources).outcomes.count() == 0


def test_retention_is_the_greedy_walk(spark):
    rng = random.Random(4)
    rows = [(f"{k:03}", rng.choice(["scanned"] * 5 + ["scan_failed"]), rng.randint(1, 40), rng.choice([0, 0, 1]), rng.random() < 0.2) for k in range(200)]
    df = spark.createDataFrame(rows, "sha256 string, event string, bytes bigint, n_findings bigint, llm_integrated boolean").repartition(5)
    for budget, negatives, used in ((500, 7, 20), (0, 3, 0)):
        total, n, want = used, 0, set()
        for sha, event, size, found, llm in rows:
            positive = event == "scanned" and (found > 0 or llm)
            if positive or event == "scanned" and n < negatives:
                if budget and total + size > budget:
                    continue
                total += size
                n += not positive
                want.add(sha)
        got = J.retention(df, keep_negatives=negatives, budget=budget, used=used).collect()
        assert {r["sha256"] for r in got if r["kept"]} == want
        assert len(got) == len(rows)
    assert J.retention(df, keep_all=True).filter("not kept").isEmpty()


def test_own_rules_and_rules_without_a_literal(spark):
    src = spark.createDataFrame([("a", 0, "x", "ABCDEFGHIJKLMNOPQRSTUVWXYZ and 2024"), ("b", 0, "f.bin", "say Foo Foo")], SOURCES)
    got = D.lexical_matches(src, endpoints=[("openai", "[A-Z]{20}", False), ("openai", r"\d{4}", False)], sdks=[]).collect()
    assert sorted(r["matched"] for r in got) == ["2024", "ABCDEFGHIJKLMNOPQRST"]
    assert D.lexical_matches(src, [], []).isEmpty()
    found = D.rag_findings(src, paths=[("own", r"\.bin$", "low", 0.5)], contents=[("foo", "Foo", "low", 0.5)]).collect()
    assert sorted((r["app_id"], r["title"], r["offset"]) for r in found) == [("b", "foo", 4), ("b", "foo", 8), ("b", "own", None)] or {(r["title"], r["offset"]) for r in found} == {("foo", 4), ("foo", 8), ("own", None)}
    assert D.rag_findings(src, [], []).isEmpty()
    assert D.structural_evidence(src, D.detected_providers(D.lexical_matches(src)), [], []).isEmpty()
    own = lambda s: D._finding(s.limit(1), 9, kind=F.lit("secret"), title=F.lit("own"), severity=F.lit("low"), evidence=F.lit("e"), confidence=F.lit(0.5))
    assert [r["title"] for r in D.scan(src, scanners=[own])[0].collect()] == ["own"]


def test_google_keys_are_attributed(spark):
    src = spark.createDataFrame([("a", 0, "x", "generativelanguage.googleapis.com"), ("b", 0, "x", "none")], SOURCES)
    keys = D._finding(src, D.SECRETS, kind=F.lit("secret"), severity=F.lit("medium"), title=F.lit(D.UNKNOWN_GOOGLE), provider=F.lit("generic"), evidence=F.lit("k"), confidence=F.lit(0.85), description=F.lit("Key."))
    got = {r["app_id"]: (r["provider"], r["severity"], r["description"]) for r in D.promote_google(keys, D.detected_providers(D.lexical_matches(src))).collect()}
    assert got == {"a": ("google_gemini", "high", "Key." + D.ATTRIBUTED), "b": ("generic", "medium", "Key.")}


def test_texts_and_publication(spark):
    counts = C.confusion(spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, a boolean"), "p", "a")
    text = R.confusion_text(counts).first()["report"]
    assert "TP = 1 | FN = 1" in text
    assert "- F1:        0.5000" in text
    out = spark.createDataFrame([("openai", "f1", "com.x", "live", True, "ok", "2026-01-02T03:04")], "provider string, fingerprint string, package string, state string, valid boolean, note string, checked_at string")
    report = R.credential_text(out, C.credential_summary(out)).first()["report"]
    assert report.split("\n")[5] == "  live rate: 100% of those checked"
    assert report.split("\n")[7].startswith("  [live   ] openai         f1 com.x ")
    published = R.publish_credentials(out).first()
    assert "package" not in published
    assert published["checked_at"] == "2026-01-02"
    empty = R.credential_text(out.limit(0), C.credential_summary(out.limit(0))).first()["report"]
    assert "checked : 0" in empty
    strings = spark.createDataFrame([("s1", "assets/x", "b"), ("s2", "classes.dex", "a")], "sha256 string, source_file string, text string")
    assert [tuple(r) for r in R.publish_strings(strings).collect()] == [("asset", "b"), ("dex", "a")]


def test_reconcile(spark):
    a, b, c = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "x"), (2, "x"), (3, None)], [(1, "x"), (2, "y"), (3, None)], [(1, "x"), (2, "x"), (3, None), (4, "z")]))
    assert C.reconcile({"a": a, "b": b, "c": c}, "k", "v").first().asDict() == {"missing_a": 1, "missing_b": 1, "missing_c": 0, "different": 1, "same": 2}


def test_probe_of_entries(spark, tmp_path):
    package(tmp_path / "one.apk", [("w.bin", "ollama wide".encode("utf-16-le"))])
    (tmp_path / "bad.apk").write_bytes(b"no zip")
    got = {(r["entry"], r["name"]) for r in A.probe_entries(spark, str(tmp_path), [("self", "ollama"), ("open", r"api\.openai\.com")]).collect()}
    assert got == {("w.bin", "self"), ("classes.dex", "open")}


def test_commands(spark, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    (tmp_path / "in").mkdir()
    package(tmp_path / "in/one.apk")
    (tmp_path / "in/bad.apk").write_bytes(b"no zip")
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)[1]
    assert "Confirmed LLM-integrated: **yes**" in run("scan", at("in"))
    assert '"is_llm_integrated" : true' in run("scan", at("in"), "--format", "json")
    assert "1/1 flagged" in run("filter", at("in"))
    run("pipeline", at("in"), "--output-dir", at("out"))
    run("aggregate", at("out"), "--output-dir", at("agg"))
    assert spark.read.csv(at("agg/severity/csv"), header=True).filter("category = 'info'").count() == 1
    sha = A.files(spark, at("in")).filter("file like '%one.apk'").first()["app_id"]
    (tmp_path / "i.csv").write_text(f"sha256,sha1,md5,dex_date,apk_size,pkg_name,vercode,vt_detection,vt_scan_date,dex_size,markets,added\n{sha},,,2021-01-01,12,com.x.chatgpt,3,,,,play.google.com,\nzz,,,2021-01-01,12,com.y.openai,3,,,,play.google.com,\n")
    run("corpus", "frame", "--index", at("i.csv"), "--output", at("frame"))
    assert T.read_frame(spark, at("frame")).count() == 2
    assert "2021" in run("corpus", "sample", "--metadata", at("i.csv"), "--output", at("manifest"))
    assert "ZZ" in run("corpus", "download", "--manifest", at("manifest"), "--output-dir", at("in"))
    assert "scanned=1" in run("corpus", "run", "--manifest", at("manifest"), "--ledger", at("ledger"), "--findings", at("findings"), "--detail-dir", at("detail"), "--staging-dir", at("in"), "--keep-with-findings")
    assert "download_failed\t1" in run("corpus", "status", "--ledger", at("ledger"))
    assert "scanned=0" in run("corpus", "run", "--manifest", at("manifest"), "--ledger", at("ledger"), "--findings", at("findings"), "--detail-dir", at("detail"), "--staging-dir", at("in"))
    assert "1 applications are" in run("corpus", "retry", "--ledger", at("ledger"), "--yes")
    assert "pending\t1" in run("corpus", "status", "--ledger", at("ledger"))
    run("validate", "sample", "--findings", at("findings"), "--output-dir", at("v"))
    T.append_labels(spark.createDataFrame([(sha, "", True, "", "2026", "x")], T.LABELS), at("labels"))
    assert "recall meets" in run("validate", "score", "--labels", at("labels"), "--key", at("v/sample_key"))
    (tmp_path / "c.csv").write_text("provider,key,sha256,package\nopenai,k1,s,p\nnobody,k2,s,p\n")
    assert "checked : 1" in run("validate", "credentials", "--staging", at("c.csv"))
