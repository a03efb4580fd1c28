"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


def new_folder(spark: SparkSession, name: str = "staged") -> str:
    """A new folder below spark.checkpoint.dir, deleted when the driver's Python ends; a temporary one only in a local session without that setting."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="textquarry-")
    if not _STAGED:
        atexit.register(_forget, spark)
    _STAGED.append(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _STAGED[-1]


def _forget(spark: SparkSession) -> None:
    for path in _STAGED:
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session may have ended
            return


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: what several branches of a plan need is then computed once."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
