"""Package archives as sources(app_id, source_idx, source_file, content).

Archives are read by Spark's binaryFile source, so paths may be in any store that
Spark reads. Each archive is opened in a Python worker; one that can't be read
gives a row with an error and stops nothing.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.scalars import MEDIA

# Sizes and lengths of the reference behaviour.
MOST_ENTRY = 64 * 1024 * 1024
NATIVE_RUN, ASSET_RUN, SAMPLE, PRINTABLE_SHARE = 6, 4, 4096, 0.85
MOST_NESTED, NESTED_DEPTH, NESTED_ENTRIES = 40_000_000, 2, 400
MOST_PROBED, SAMPLE_ZEROS = 80_000_000, 2000

_MEDIA = re.compile(rf"\.({'|'.join(MEDIA)})$", re.IGNORECASE)
_NOT_PRINTABLE = re.compile(rb"[^\x20-\x7e\t\n\r]")


def ascii_strings(data: bytes, least: int = 4) -> list[str]:
    return [m.decode() for m in re.findall(rb"[\x20-\x7e\t]{%d,}" % least, data)]


def utf16_strings(data: bytes, least: int = 4, chunk: int = 1 << 20) -> list[str]:
    """Runs of printable low bytes with a zero high byte at even places; a run ends at each chunk's edge."""
    out = []
    for start in range(0, len(data), chunk):
        part = data[start : start + chunk]
        low, high = part[0 : len(part) & ~1 : 2], part[1 : len(part) & ~1 : 2]
        shown = bytes(a if not b and (0x20 <= a <= 0x7E or a == 9) else 0 for a, b in zip(low, high, strict=True))
        out += [m.decode() for m in re.findall(rb"[^\x00]{%d,}" % least, shown)]
    return out


def extract_strings(data: bytes, least: int = 4) -> list[str]:
    return ascii_strings(data, least) + utf16_strings(data, least)


def decode_asset(data: bytes) -> str:
    """Text if the first bytes are mostly printable, else the printable runs."""
    head = data[:SAMPLE]
    if head and len(head) - len(_NOT_PRINTABLE.findall(head)) >= PRINTABLE_SHARE * len(head):
        return data.decode("utf-8", "replace")
    return "\n".join(extract_strings(data, ASSET_RUN))


def dex_strings(data: bytes) -> list[str]:
    """The string table of a dex file: offsets at 0x3c, each entry a length and modified UTF-8 up to a zero byte."""
    if data[:4] != b"dex\n":
        raise ValueError("not a dex file")
    count, at = struct.unpack_from("<II", data, 0x38)
    out = []
    for offset in struct.unpack_from(f"<{count}I", data, at):
        while data[offset] & 0x80:
            offset += 1
        offset += 1
        raw = data[offset : data.index(b"\0", offset)].replace(b"\xc0\x80", b"\0")
        out.append(raw.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
    return out


def axml_strings(data: bytes) -> list[str]:
    """The string pool of a binary manifest (UTF-8 or UTF-16), which holds its names, permissions and values."""
    if data[:4] != b"\x03\x00\x08\x00" or struct.unpack_from("<H", data, 8)[0] != 1:
        raise ValueError("not a binary manifest")
    count, _, flags, start = struct.unpack_from("<IIII", data, 16)
    out = []
    for offset in struct.unpack_from(f"<{count}I", data, 36):
        at = 8 + start + offset
        if flags & 0x100:  # UTF-8: length in characters, length in bytes
            at += 2 if data[at] & 0x80 else 1
            n = data[at]
            if n & 0x80:
                n, at = (n & 0x7F) << 8 | data[at + 1], at + 1
            out.append(data[at + 1 : at + 1 + n].decode("utf-8", "replace"))
        else:
            n = struct.unpack_from("<H", data, at)[0]
            if n & 0x8000:
                n, at = (n & 0x7FFF) << 16 | struct.unpack_from("<H", data, at + 2)[0], at + 2
            out.append(data[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace"))
    return out


def archive_sources(data: bytes, dedupe_entries: bool = True) -> list[tuple[str, str]]:
    """(name, text) of one archive: manifest, dex tables, native libraries, then each entry's path and text.

    dedupe_entries=False also reads manifest, dex and libraries again as assets, as the behaviour to match does.
    """
    out: list[tuple[str, str]] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [i.filename for i in z.infolist() if not i.is_dir()]
        sizes = {i.filename: i.file_size for i in z.infolist()}

        def add(name: str, read) -> None:
            try:
                if text := read(z.read(name)):
                    out.append((name, text))
            except Exception:  # noqa: BLE001  a damaged entry doesn't stop the others
                pass

        done = set()
        if "AndroidManifest.xml" in names:
            add("AndroidManifest.xml", lambda b: "\n".join(axml_strings(b)) if b[:1] == b"\x03" else b.decode("utf-8", "replace"))
            done.add("AndroidManifest.xml")
        for name in names:
            if re.fullmatch(r"classes\d*\.dex", name):
                add(name, lambda b: "\n".join(dex_strings(b)))
                done.add(name)
        for name in names:
            if name.endswith(".so") and sizes[name] <= MOST_ENTRY:
                add(name, lambda b: "\n".join(extract_strings(b, NATIVE_RUN)))
                done.add(name)
        for name in names:
            out.append((name, name))
            if not (_MEDIA.search(name) or sizes[name] > MOST_ENTRY or dedupe_entries and name in done):
                add(name, decode_asset)
    return out


def unwrap(name: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, bytes]]:
    """An entry and what is nested in it as gzip or zip, to a bounded depth, size and number."""
    yield name, data
    if depth >= NESTED_DEPTH or len(data) > MOST_NESTED:
        return
    try:
        if data[:2] == b"\x1f\x8b":
            yield from unwrap(f"{name}!gz", gzip.decompress(data), depth + 1)
        elif data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist()[:NESTED_ENTRIES]:
                    yield from unwrap(f"{name}!{info.filename}", z.read(info), depth + 1)
    except (OSError, EOFError, zipfile.BadZipFile, RuntimeError):
        return


def packages(spark: SparkSession, path: str, suffix: str = "apk") -> DataFrame:
    """Files below a path with a suffix in any case, without AppleDouble companions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(F.lower("path").endswith(f".{suffix}") & ~F.substring_index("path", "/", -1).startswith("._"))


def read_packages(spark: SparkSession, path: str, dedupe_entries: bool = True) -> DataFrame:
    """sources of all packages below a path, with an error column for archives that can't be read."""

    def run(batches):
        for batch in batches:
            for app, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                error = None
                try:
                    rows = archive_sources(data, dedupe_entries)
                except Exception as e:  # noqa: BLE001
                    rows, error = [(None, None)], f"{type(e).__name__}: {e}"
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([app] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([error] * n, pa.string())], ["app_id", "source_idx", "source_file", "content", "error"])

    return packages(spark, path).select(F.sha2("content", 256).alias("app_id"), "content").mapInArrow(run, "app_id string, source_idx int, source_file string, content string, error string")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, file, bytes) of the packages below a path."""
    return packages(spark, path).select(F.sha2("content", 256).alias("app_id"), F.col("path").alias("file"), F.col("length").alias("bytes"))


def entry_names(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, names) from the archives' directories; names are null if there is none that can be read."""

    @F.arrow_udf("array<string>")
    def names(archives: pa.Array) -> pa.Array:
        out = []
        for data in archives:
            try:
                with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as z:
                    out.append(z.namelist())
            except zipfile.BadZipFile:
                out.append(None)
        return pa.array(out, pa.list_(pa.string()))

    return packages(spark, path).select(F.sha2("content", 256).alias("app_id"), names("content").alias("names"))


def probe_entries(spark: SparkSession, path: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(app_id, entry, name, match) of an audit's patterns in all entries and in what is nested in them, raw and with zero bytes left out (a fold of UTF-16)."""
    compiled = [(n, p) for n, p in patterns]

    def run(batches):
        tests = [(n, re.compile(p.encode())) for n, p in compiled]
        for batch in batches:
            for app, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = set()
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for info in z.infolist():
                            if info.file_size > MOST_PROBED:
                                continue
                            for entry, raw in _nested(z, info):
                                probes = [raw, raw.replace(b"\0", b"")] if b"\0" in raw[:SAMPLE_ZEROS] else [raw]
                                seen |= {(entry, n, m[0][:70].decode("utf-8", "replace")) for n, t in tests for x in probes for m in t.finditer(x)}
                except zipfile.BadZipFile:
                    continue
                rows = sorted(seen)
                yield pa.RecordBatch.from_arrays([pa.array([app] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))], ["app_id", "entry", "name", "match"])

    return packages(spark, path).select(F.sha2("content", 256).alias("app_id"), "content").mapInArrow(run, "app_id string, entry string, name string, match string")


def _nested(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> list[tuple[str, bytes]]:
    try:
        return list(unwrap(info.filename, z.read(info)))
    except Exception:  # noqa: BLE001  a damaged entry doesn't stop the others
        return []
