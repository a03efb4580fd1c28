"""Shared pieces of the text operators: tables, word rules, staged tables."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
SPACE_REGEX = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters that one round of vectorised work takes from an Arrow batch.
ROUND_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text"):
    """Null text counts as empty text in every operator of this package."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def whole(docs: DataFrame) -> Column:
    """A row of docs as one struct, so that its columns' names meet none of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def ascii_lower(column):
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(column, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; anywhere
    else a missing setting is an error, as executors could not see the files.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_before = context._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        context.setCheckpointDir(folder)
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def staged(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage, survives lost executors and lets later steps read
    single columns; the files go when `release` is called, or at last when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if not STAGED:
        atexit.register(release, spark)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of staged tables that are still there.
STAGED: list[str] = []


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the staged tables STAGED[first:last]; nothing may need them any more."""
    for path in STAGED[first:last]:
        STAGED.remove(path)
        _forget(spark, path)


#: Rows of ids (8 bytes each, or a few times that) that are broadcast at most.
FEW = 500_000


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; df must be staged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def firsts(rows: DataFrame, bucket: Column, order: list, k: int) -> DataFrame:
    """The first k rows by order, which begins with what bucket rises with.

    A plain limit takes k rows from each partition. Here the buckets are counted and
    only rows up to the one with row k are sorted, so k rows and a bucket come together.
    """
    sizes = rows.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.orderBy("_b")))
    cut = sizes.filter(F.col("_upto") >= k).agg(F.min("_b")).first()[0]
    return (rows if cut is None else rows.filter(bucket <= cut)).orderBy(*order).limit(k)


def hash_firsts(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The first k rows by a hash of columns, whose 16,384 buckets are alike in size."""
    drawn = F.xxhash64(*columns)
    return firsts(rows, F.shiftright(drawn, 50), [drawn, *columns], k)


def slices(batches, rows: int = 400, made: bool = False):
    """Parts of Arrow batches with few rows each, so that what Python holds of them at once stays small.

    A Python worker outlives its task and stays beside the tasks of later stages. So
    what `once` made goes, unless the caller works with it (made), and free memory
    goes back to the system, when a task begins and when it ends.
    """
    if not made:
        _MADE.clear()
    give_back()
    for batch in batches:
        for k in range(0, max(1, len(batch)), rows):
            yield batch.slice(k, rows)
    give_back()


def give_back() -> None:
    """Return what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
_MADE: dict = {}


def once(kind, *args):
    """kind(*args), made once in a Python worker and used by its later tasks too; only the latest one is kept, until a task needs none."""
    key = kind, args
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = kind(*args)
    return _MADE[key]
