"""Archives, table readers, reports and the stream."""

import gzip
import io
import json
import struct
import zipfile

from textquarry.sources import archives as A
from textquarry.sources import tables as T
from textquarry.streaming import ledger as L


def dex(strings):
    body = b"".join(bytes([len(s)]) + s.encode() + b"\0" for s in strings)
    start, offsets = 0x70 + 4 * len(strings), []
    at = start
    for s in strings:
        offsets.append(at)
        at += len(s.encode()) + 2
    head = b"dex\n035\0".ljust(0x38, b"\0") + struct.pack("<II", len(strings), 0x70)
    return head.ljust(0x70, b"\0") + struct.pack(f"<{len(strings)}I", *offsets) + body


def package(path, extra=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("classes.dex", dex(["api.openai.com", "hello"]))
        z.writestr("lib/a.so", b"\0\1eightchr\0\0" + "widechars".encode("utf-16-le"))
        z.writestr("assets/p.txt", "You are a helpful assistant")
        z.writestr("a.png", b"\x89PNG")
        for name, data in extra:
            z.writestr(name, data)


def test_strings():
    assert A.ascii_strings(b"abc\0defg\0hi") == ["defg"]
    assert A.utf16_strings("wide text".encode("utf-16-le")) == ["wide text"]
    assert A.utf16_strings(b"\0" + "wide".encode("utf-16-le")) == []
    assert A.extract_strings(b"") == A.extract_strings(b"a") == []
    assert A.dex_strings(dex(["x", "yz"])) == ["x", "yz"]
    assert A.decode_asset("viele grüße aus dem tiefen dunklen Wald".encode()) == "viele grüße aus dem tiefen dunklen Wald"
    assert A.decode_asset(b"\0\1\2\3textual\0\1\2\3\4\5\6\7") == "textual"


def test_packages(spark, tmp_path):
    package(tmp_path / "one.APK")
    (tmp_path / "._one.apk").write_bytes(b"x")
    (tmp_path / "bad.apk").write_bytes(b"not a zip")
    rows = A.read_packages(spark, str(tmp_path)).collect()
    assert len({r["app_id"] for r in rows}) == 2
    assert [r["error"] for r in rows if r["error"]][0].startswith("BadZipFile")
    good = [(r["source_file"], r["content"]) for r in rows if not r["error"]]
    assert ("classes.dex", "api.openai.com\nhello") in good
    assert ("lib/a.so", "eightchr\nwidechars") in good
    assert ("a.png", "a.png") in good
    assert [c for n, c in good if n == "a.png"] == ["a.png"]
    names = A.entry_names(spark, str(tmp_path)).filter("names is not null").first()["names"]
    assert "lib/a.so" in names


def test_unwrap():
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.gz", gzip.compress(b"deep"))
    got = dict(A.unwrap("r", inner.getvalue()))
    assert got["r!x.gz!gz"] == b"deep"
    assert [n for n, _ in A.unwrap("r", b"PKbroken")] == ["r"]


def test_tables(spark, tmp_path):
    (tmp_path / "i.csv").write_text("sha256,sha1,md5,dex_date,apk_size,pkg_name,vercode,vt_detection,vt_scan_date,dex_size,markets,added\nA,,,2020-01-01,12,com.x,3,,,,play.google.com,\n,,,,,,,,,,,\nB,,,,x,,,,,,,2021-01-01\n")
    rows = {r["sha256"]: r for r in T.read_index(spark, str(tmp_path / "i.csv")).collect()}
    assert set(rows) == {"A", "B"}
    assert (rows["A"]["apk_size"], rows["B"]["apk_size"], rows["B"]["pkg_name"], rows["B"]["dex_date"]) == (12, None, "", None)
    frame = spark.createDataFrame([("A", "com.x", 2020, "dex_date", "other", None, "m", 12, ["ai", "ml"]), ("B", "com.y", None, "none", "other", "1", "", None, [])], "sha256 string, pkg_name string, year int, date_source string, store string, vercode string, markets string, apk_size bigint, signals array<string>")
    T.write_frame(frame, str(tmp_path / "f"))
    back = {r["sha256"]: r for r in T.read_frame(spark, str(tmp_path / "f")).collect()}
    assert back["A"]["signals"] == ["ai", "ml"]
    assert (back["B"]["year"], back["B"]["signals"], back["A"]["date_source"]) == (None, [], "dex_date")
    assert T.read_labels(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("a", "info", "t<1>", None, "e" * 200, 0.5), ("a", "critical", "u", "openai", "x", 0.9)], "app_id string, severity string, title string, provider string, evidence string, confidence double")
    text = T.markdown_report(rows).first()["report"]
    assert text.index("critical") < text.index("info")
    assert "e" * 41 not in text
    page = T.html_report(rows).first()["report"]
    assert "t&lt;1&gt;" in page
    assert "t<1>" not in page


def test_stream_resumes(spark, tmp_path):
    schema = "app_id string, source_idx bigint, source_file string, content string"
    spark.createDataFrame([("a", 0, "x", "api.openai.com")], schema).write.parquet(str(tmp_path / "in/1"))
    scan = lambda s: s.select("app_id", "source_file")

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        L.scan_stream(stream, str(tmp_path / "ledger"), str(tmp_path / "out"), str(tmp_path / "cp"), scan).awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert go() == 1
    assert go() == 1
    spark.createDataFrame([("a", 0, "x", "again"), ("b", 0, "x", "new")], schema).write.parquet(str(tmp_path / "in/2"))
    assert go() == 2


def test_json_report(spark):
    from pyspark.sql import functions as F

    x = spark.range(1).select(T.json_report(F.struct(F.lit("é").alias("k"))).alias("j")).first()["j"]
    assert json.loads(x) == {"k": "é"}
