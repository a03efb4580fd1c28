"""Digest columns of found spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    listed = F.array(*map(F.lit, kinds))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(listed, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of the base spans, their digest, and all spans."""

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number, kinds)
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), kinds).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added"), kinds).alias("spans"))
