"""Document fingerprints by threshold-scaled sketches (operator 9).

Of a document's shingle hashes (five words) all below a fixed fraction of the
64-bit range are retained, so the sketch's size follows the document's, two
sketches compare like the full sets whatever their sizes, and the sketch of a
union is the union of sketches. The least hash is always retained too, so that
short documents have a sketch; merging keeps the union's least one.

Defined cases: null text is empty; a text without words has an empty
fingerprint, which is like another empty one (1.0) and unlike all others (0.0);
repeated rows and equal ids follow each other in the order of their texts; very
long texts are taken whole; other columns are not used; a
table of one row is its own next document; an empty table gives no rows; null
ids come last; ids are of any type that has an order.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, NumericType, StructField, StructType

from textquarry.llm.common import slices, table, text_or_empty
from textquarry.llm.shingles import Shingles

#: Ranges of ids for each shuffle partition; each bound is one number on the driver.
FINER = 4


def sketch(hashes: np.ndarray, scale: int) -> np.ndarray:
    """The hashes (sorted) below 1/scale of the range, and the least one."""
    return hashes[: max(int(np.searchsorted(hashes, np.uint64((1 << 64) // scale - 1))), min(1, len(hashes)))]


def merged(a: np.ndarray, b: np.ndarray, scale: int) -> np.ndarray:
    """The sketch of the union of what two sketches stand for."""
    return sketch(np.union1d(a, b), scale)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all (Jaccard)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too, whatever the sizes."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def as_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(x: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(x), ">u8").astype(np.uint64)


def fingerprints(df: DataFrame, shingle: int = 5, scale: int = 8, text: str = "text") -> DataFrame:
    """Add fingerprint, the retained hashes in hexadecimal, ascending."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut = Shingles(shingle)
        for batch in slices(batches):
            yield pa.array([as_text(sketch(cut(x), scale)) for x in batch.to_pylist()], pa.string())

    return df.withColumn("fingerprint", of(text_or_empty(text)))


def ordinal(docs: DataFrame) -> Column:
    """A number that rises with doc_id: itself, or the six bytes of its text after what all ids begin with; ids that share a number are told apart by sorting."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, NumericType):
        return F.col("doc_id").cast("double")
    raw = F.col("doc_id") if isinstance(kind, BinaryType) else F.col("doc_id").cast("string").cast("binary")
    ends = docs.agg(F.hex(F.min(raw)).alias("a"), F.hex(F.max(raw)).alias("b")).first()
    same = len(os.path.commonprefix([ends["a"] or "", ends["b"] or ""])) // 2
    return F.conv(F.rpad(F.hex(F.substring(raw, same + 1, 6)), 12, "0"), 16, 10).cast("double")


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows (range, ahead, doc_id, text), dealt by range of ids and sorted so that each document is followed by the next one by descending id.

    Texts are shuffled once. Each range also gets the first document of the
    range after it (ahead = 1), the last range that of the first.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"), ordinal(docs).alias("_at"))
    ranges = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile("_at", [k / ranges for k in range(1, ranges)], 0.2 / ranges) or []))
    listed = F.from_json(F.lit(json.dumps(bounds)), "array<double>")
    steps = F.lit([1 << k for k in reversed(range(max(1, len(bounds).bit_length())))])  # a binary search for the bounds up to an id
    upto = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(listed, p + s - 1) <= F.col("_at"), p + s).otherwise(p))
    place = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(len(bounds) - upto)
    rows = rows.withColumn("range", place.cast("int")).drop("_at")
    firsts = sorted(((r["range"], r["first"]) for r in rows.groupBy("range").agg(F.max("doc_id").alias("first")).collect()), key=lambda r: r[0])
    ahead = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]  # the range before, or the last one
    few = spark.createDataFrame(ahead, StructType([StructField("_first", docs.schema["doc_id"].dataType), StructField("_before", IntegerType())]))
    rows = rows.join(F.broadcast(few), F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("ahead"))
    twice = F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("_before").alias("range"), F.lit(1).alias("ahead"))))
    rows = rows.select("doc_id", "text", F.explode(twice).alias("_at")).select("_at.range", "_at.ahead", "doc_id", "text")
    return rows.repartition("range").sortWithinPartitions("range", "ahead", F.col("doc_id").desc_nulls_last(), "text")


SCHEMA = "doc_id {}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_contains double"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def compare_with_edits(docs: DataFrame, shingle: int = 5, scale: int = 8) -> DataFrame:
    """Each document's fingerprint against those of an edited text, whose last half is the next document's begin, and of the next document."""

    named = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingles(shingle)
        kind = pa.schema([("doc_id", to_arrow_type(named)), ("n_chars", pa.int64()), *((x, pa.string()) for x in COLUMNS[2:5]), *((x, pa.float64()) for x in COLUMNS[5:])])
        last = None  # range, id, text and sketch of the row before

        def row(now: tuple, text: str, own: np.ndarray) -> tuple:
            _, doc_id, before, kept = now
            half = len(before) // 2
            edited = before[: len(before) - half] + text[:half]
            other = sketch(cut(edited), scale)
            return doc_id, len(before), hashlib.sha256(edited.encode()).hexdigest(), as_text(kept), as_text(other), likeness(kept, other), likeness(kept, own), containment(kept, other)

        for batch in slices(batches):
            out = []
            for at, ahead, doc_id, text in zip(*(batch.column(x).to_pylist() for x in ("range", "ahead", "doc_id", "text")), strict=True):
                if last is None and ahead:
                    continue  # further rows with the id of a first document
                own = sketch(cut(text), scale)
                if last is not None:
                    out.append(row(last, text, own))
                last = None if ahead else (at, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

    return neighbours(docs).mapInArrow(run, SCHEMA.format(named.simpleString()))


def op9_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
