"""The state machine as a stream, poisoned packages and resumed runs."""

import random

from pyspark.sql import functions as F

from textquarry.streaming import machine, resume

HOUR = 3_600_000_000


def plain(events, retry_after, late, most=3):
    """Transitions by a loop over each application's events, and retries due by the last watermark."""
    end = max((e[1] for e in events), default=0) // 1000 * 1000 - late
    out, by = [], {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        by.setdefault(e[0], []).append(e)
    for key, own in by.items():
        state, attempts, failed = "pending", 0, None
        for _, at, seq, event in own:
            if state.endswith("failed") and attempts < most and at >= failed + retry_after:
                out.append((key, failed + retry_after, None, "retry", state, "pending", attempts, True))
                state = "pending"
            legal = event in machine.LEGAL[state]
            before = state
            if legal:
                state = "pending" if event == "reset" else event
                attempts = 0 if event == "reset" else attempts + event.endswith("failed")
                failed = at if event.endswith("failed") else None
            out.append((key, at, seq, event, before, state, attempts, legal))
        if state.endswith("failed") and attempts < most and failed + retry_after <= end:
            out.append((key, failed + retry_after, None, "retry", state, "pending", attempts, True))
    return out


def test_machine_in_any_cut_of_the_events(spark, tmp_path):
    rng = random.Random(1)
    kinds = ["downloaded", "downloaded", "scanned", "download_failed", "scan_failed", "reset", "unknown"]
    events = [(f"k{rng.randint(0, 12)}", k * HOUR // 3 + rng.randint(0, HOUR // 4), k, rng.choice(kinds)) for k in range(240)]
    want = sorted(map(repr, plain(events, 6 * HOUR, HOUR)))
    schema = "sha256 string, us bigint, seq bigint, event string"
    for name, cuts in (("one", [240]), ("three", [90, 91, 240])):
        place, start = str(tmp_path / name), 0
        for end in cuts:
            spark.createDataFrame(events[start:end], schema).select("sha256", F.timestamp_micros("us").alias("at"), "seq", "event").write.mode("append").parquet(f"{place}/in")
            machine.write(spark.readStream.schema("sha256 string, at timestamp, seq bigint, event string").parquet(f"{place}/in"), f"{place}/out", f"{place}/checkpoint")
            start = end
        done = spark.read.schema(machine.TRANSITION).parquet(f"{place}/out")
        got = done.select("sha256", F.unix_micros("at"), "seq", "event", "before", "state", "attempts", "accepted").collect()
        assert sorted(map(repr, map(tuple, got))) == want
        last = {}
        for row in sorted(map(tuple, got), key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
            last[row[0]] = row[5:7]
        assert {r["sha256"]: (r["state"], r["attempts"]) for r in machine.current(done).collect()} == last
    assert any("'retry'" in r for r in want) and any("False" in r for r in want)


def test_poisoned_rows_fail_alone(spark):
    import zlib

    good = zlib.compress("täxt".encode())
    rows = [("a", 0, "x", good), ("b", 0, "x", good[:5]), ("b", 1, "y", good), ("c", 0, "x", None), ("d", 0, "x", zlib.compress(b"\xff\xfe"))]
    got = resume.guarded(spark.createDataFrame(rows, "app_id string, source_idx int, source_file string, payload binary"), resume.inflate).collect()
    assert [tuple(r)[0:2] + tuple(r)[3:] for r in got] == [("a", 0, "täxt", None), ("b", 0, None, "error"), ("b", 1, "täxt", None), ("c", 0, None, "TypeError"), ("d", 0, None, "UnicodeDecodeError")]


def test_a_killed_batch_counts_for_nothing_until_repeated(spark, tmp_path):
    apps = [f"a{k:02d}" for k in range(24)]
    packages = spark.createDataFrame([(a, 0, "x", b"bad" if k % 7 == 3 else a.encode()) for k, a in enumerate(apps) if k % 5], "app_id string, source_idx int, source_file string, payload binary")
    manifest = spark.createDataFrame([(a,) for a in apps], "sha256 string")
    schema, folder = "app_id string, note string", f"file://{tmp_path}"

    def read(payload):
        if payload == b"bad":
            raise ValueError("unreadable")
        return payload.decode()

    def scan(tag, fail=False):
        def run(sources):
            def note(batches):
                yield from batches
                if fail:
                    raise RuntimeError("killed")

            found = sources.select("app_id", F.concat(F.lit(tag), "content").alias("note"))
            return found.mapInArrow(note, found.schema)

        return run

    state = lambda: resume.state(spark, folder, manifest)
    assert resume.findings(spark, folder, schema).count() == 0
    resume.run(state(), packages, folder, 1, scan("one "), read, only=(0, 1))
    try:
        resume.run(state(), packages, folder, 1, scan("lost ", fail=True), read, only=(2,))
        raise AssertionError("the batch should have died")
    except Exception as e:
        assert "killed" in str(e)
    before = {r["app_id"] for r in resume.findings(spark, folder, schema).collect()}
    spark.createDataFrame([("a01", "stray")], schema).write.mode("append").parquet(f"{folder}/findings/run=1/batch=2")  # what a dead batch left behind
    assert {r["app_id"] for r in resume.findings(spark, folder, schema).collect()} == before
    resume.run(state(), packages, folder, 1, scan("one "), read, only=(2,))
    resume.run(state(), packages, folder, 2, scan("two "), read)
    got = {r["app_id"]: r["note"] for r in resume.findings(spark, folder, schema).collect()}
    readable = {a for k, a in enumerate(apps) if k % 5 and k % 7 != 3}
    assert set(got) == readable and all(n.split()[1] == a for a, n in got.items()) and {n.split()[0] for n in got.values()} == {"one", "two"}
    assert {a for a in before} == {a for a in got if a in before and got[a].startswith("one ")}
    left = {r["sha256"]: (r["state"], r["attempts"]) for r in state().collect()}
    for k, a in enumerate(apps):
        assert left[a][0] == ("download_failed" if not k % 5 else "scan_failed" if k % 7 == 3 else "scanned")
        assert left[a][1] in ((0,) if a in readable else (1, 2))


def test_an_application_costs_one_read_and_one_write(spark):
    from pyspark.sql import Row

    asked = []

    class Store:
        """Stands for the state store and the timers."""

        kept = None

        def getValueState(self, *_):  # noqa: N802
            return self

        def __getattr__(self, name):
            return lambda *a: asked.append((name, *a)) or (self.kept if name == "get" else self.__dict__.update(kept=a[0]) if name == "update" else None)

    processor = machine.Processor(6 * HOUR, 3)
    processor.init(Store())
    given = [Row(sha256="a", us=us, seq=seq, event=event) for us, seq, event in ((2_000, 2, "scan_failed"), (1_000, 1, "downloaded"), (1_500, 9, "reset"))]
    got = [r.asDict() for r in processor.handleInputRows(("a",), iter(given), None)]
    assert [(r["us"], r["event"], r["before"], r["state"], r["attempts"], r["accepted"]) for r in got] == [(1_000, "downloaded", "pending", "downloaded", 0, True), (1_500, "reset", "downloaded", "downloaded", 0, False), (2_000, "scan_failed", "downloaded", "scan_failed", 1, True)]
    assert asked == [("get",), ("update", ("scan_failed", 1, 2_000)), ("registerTimer", 6 * HOUR // 1000 + 2)]
    asked.clear()
    later = [r.asDict() for r in processor.handleInputRows(("a",), iter([Row(sha256="a", us=6 * HOUR + 2_000, seq=10, event="downloaded")]), None)]
    assert [(r["seq"], r["event"], r["state"]) for r in later] == [(None, "retry", "pending"), (10, "downloaded", "downloaded")]
    assert [x[0] for x in asked] == ["get", "update", "deleteTimer"]
