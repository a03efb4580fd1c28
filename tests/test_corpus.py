"""Frame, sampling, ledger, validation and statistics."""

import random

from pyspark.sql import functions as F

from textquarry.operators import corpus as C


def test_dedup_by_package(spark):
    rows = spark.createDataFrame([("s1", "p", "2", None, None), ("s2", "p", "10", None, None), ("s3", "q", "x", "2020-01-01", None), ("s4", "q", None, None, "2021-01-01")], "sha256 string, pkg_name string, vercode string, dex_date string, added string")
    assert {r["pkg_name"]: r["sha256"] for r in C.dedup_by_package(rows).collect()} == {"p": "s2", "q": "s4"}


def test_largest_remainder(spark):
    rows = spark.createDataFrame([(2020, "a", 10), (2021, "a", 20), (2021, "b", 3)], "year int, store string, size bigint")
    for target in (0, 1, 7, 10, 33, 50):
        got = C.largest_remainder(rows, target, ["year", "store"]).collect()
        assert sum(r["alloc"] for r in got) == min(target, 33)
        assert all(0 <= r["alloc"] <= r["size"] for r in got)


def test_sample_doesnt_depend_on_partitions(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("k"))
    a, b = ({r["id"] for r in C.stratified_sample(rows.repartition(n), 50, ["k"], "id").collect()} for n in (1, 9))
    assert a == b
    assert len(a) == 50


def test_seeded_draws_are_those_of_lists(spark):
    """What a generator draws from sorted lists, stratum after stratum."""
    rng = random.Random(2)
    rows = [(rng.choice([2019, 2020, 2021]), rng.choice(["é", "a", "b"]), f"{k * 7919 % 1000:04d}") for k in range(400)]
    frame = spark.createDataFrame(rows, "year int, store string, sha256 string").repartition(7)
    for target, seed in ((0, 1), (37, 5), (399, 8), (1000, 3)):
        strata = {}
        for r in rows:
            strata.setdefault(r[:2], []).append(r)
        alloc = {(r["year"], r["store"]): r["alloc"] for r in C.largest_remainder(frame.groupBy("year", "store").agg(F.count("*").alias("size")), target, ["year", "store"]).collect()}
        generator, want = random.Random(seed), []
        for key in sorted(strata):
            want += generator.sample(sorted(strata[key], key=lambda r: r[2]), alloc[key]) if alloc[key] else []
        assert sorted(map(tuple, C.seeded_sample(frame, target, ["year", "store"], "sha256", seed).collect())) == sorted(want)


def test_seeded_validation_draw(spark):
    rows = [(f"{k:03d}", None if k % 10 == 0 else k % 3 == 0) for k in range(90)]
    frame = spark.createDataFrame(rows, "sha256 string, flagged boolean").repartition(5)
    for n in (5, 30, 60, 200):
        pools, generator, want = [[r for r in rows if bool(r[1]) is on] for on in (True, False)], random.Random(4), []
        for pool in pools:
            want += [(*r, len(pool) < n) for r in (generator.sample(pool, n) if len(pool) > n else pool)]
        assert sorted(map(repr, map(tuple, C.seeded_validation_sample(frame, "flagged", "sha256", n, 4).collect()))) == sorted(map(repr, want))
    assert C.seeded_validation_sample(frame.limit(0), "flagged", "sha256", 3, 1).count() == 0


def test_ledger(spark):
    log = spark.createDataFrame([("a", 1, 0, "enroll"), ("a", 2, 0, "download_failed"), ("a", 3, 0, "download_failed"), ("b", 1, 0, "scanned"), ("c", 1, 0, "scan_failed"), ("c", 2, 0, "reset"), ("c", 3, 0, "scan_failed")], "sha256 string, at int, seq int, event string")
    state = C.fold(log)
    assert {r["sha256"]: (r["state"], r["attempts"]) for r in state.collect()} == {"a": ("download_failed", 2), "b": ("scanned", 0), "c": ("scan_failed", 1)}
    assert [r["sha256"] for r in C.pending(state).collect()] == ["a", "c"]
    assert [r["sha256"] for r in C.pending(state, most_attempts=2).collect()] == ["c"]
    assert C.enroll(state, log.select("sha256")).count() == 0
    assert C.reset_events(state, F.lit(9), ()).count() == 0


def test_retention():
    assert C.retain_within([("a", 5), ("b", 7), ("c", 3)], 9) == ["a", "c"]


def test_confusion(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (True, None)], "p boolean, a boolean")
    r = C.confusion(rows, "p", "a").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["f1"]) == (1, 1, 1, 1, 0.5)
    assert C.confusion(rows.limit(0), "p", "a").first()["f1"] == 0.0


def test_credentials(spark):
    cred = spark.createDataFrame([("openai", "f1", "x"), ("openai", "f1", "y"), ("openai", "f2", "x"), ("groq", "f3", "z")], "provider string, fingerprint string, package string")
    disp = spark.createDataFrame([("openai", "f1", True), ("openai", "f2", False)], "provider string, fingerprint string, valid boolean")
    out = C.attach_dispositions(cred, disp)
    r = C.credential_summary(out).first()
    assert (r["live"], r["revoked"], r["unknown"]) == (2, 1, 1)
    assert {x["fingerprint"] for x in C.to_disclose(out).collect()} == {"f1", "f3"}


def test_published_rate(spark):
    rows = spark.range(24).select(F.when(F.col("id") < 6, "live").when(F.col("id") < 20, "revoked").otherwise("unknown").alias("state"))
    assert C.credential_summary(rows).first()["live_rate"] == 0.3
