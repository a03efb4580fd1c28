"""Removal of passages that repeat across documents, by level-wise doubling (operator 13).

Short windows come first, halves of the wanted length. Only where a window repeats
and so does the one right after it (or overlapping it) can a window of twice the
length, so these alone are tried at the next level, until the wanted length is
reached or no candidate survives. Levels meet in `exchange`: those below the wanted
length by short keys, an upper bound that only weeds out, the last one by 96 bits,
which decide.

A shard is a row of some megabytes of documents, packed. After each level only
documents with a survivor go on, with the survivors' places; so all texts are read
twice and joined to answers once, by shard, whose sizes are alike whatever repeats
how often. The first level's windows are long enough (`shortest`) to be rare by
chance; shorter ones would weed out no more and cost a pass.

Defined cases: null text is empty and keeps no word; windows don't cross documents,
and a document with fewer words than a window loses none; repeated rows and rows
with equal or null ids are documents of their own, so whole copies remove each
other; very long texts are taken whole; other columns are not used; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textquarry.llm.common import slices, staged, table, text_or_empty
from textquarry.llm.exchange import Cells, Keys, frequent, grain, hashed, packed, taken, text_bytes, unpacked, windows

#: Documents of a shard with a window that survives, packed, and the windows' places; the other documents, packed.
PART = "shard bigint, some binary, at binary, rest binary"


def blob(docs: pa.Table) -> bytes:
    """Documents packed for shuffles and files, whatever the type of their ids."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(docs)
    return sink.getvalue().to_pybytes()


def unblob(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def sharded(docs: DataFrame, size: int) -> DataFrame:
    """Staged rows (shard, docs) of whole documents (doc_id, text), packed; of `size` bytes or as much as one run of 16 documents passes it."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, full = TaskContext.get().partitionId() << 33, [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob(pa.Table.from_batches(held))], pa.binary())], ["shard", "docs"])

        for batch in slices(batches, 16):
            if len(batch):
                held.append(batch)
                full += batch.column("text").nbytes
                if full >= size:
                    yield shard()
                    held, full, number = [], 0, number + 1
        if held:
            yield shard()

    return staged(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(gather, "shard bigint, docs binary"))


class Part:
    """Documents of a shard and the places of their words: each document's number from `start` on, one place between two documents."""

    def __init__(self, docs: pa.Table):
        self.words: list[bytes] = []
        ends = []
        for text in docs.column("text").to_pylist():
            self.words += text.encode().split()  # bytes are split at exactly the six ASCII white-space characters
            ends.append(len(self.words))
            self.words.append(b"")
        self.ends = np.array(ends, np.int64)  # where the empty word after each document is
        self.begins = np.append(0, self.ends[:-1] + 1) if ends else self.ends
        if "start" not in docs.column_names:
            docs = docs.append_column("start", pa.array(self.begins))
        self.docs, self.starts = docs, docs.column("start").to_numpy()

    def doc(self, at: np.ndarray) -> np.ndarray:
        """The document of each place."""
        return np.searchsorted(self.starts, at, "right") - 1

    def here(self, at: np.ndarray) -> np.ndarray:
        doc = self.doc(at)
        return at + (self.begins - self.starts)[doc]

    def all(self, length: int) -> np.ndarray:
        """The places of all windows of `length` words within a document."""
        inside = np.zeros(len(self.words) + 1, np.int64)
        ends = np.maximum(self.ends - length + 1, self.begins)
        np.add.at(inside, self.begins, 1)
        np.add.at(inside, ends, -1)
        here = np.flatnonzero(np.cumsum(inside)[:-1])
        return here + (self.starts - self.begins)[np.searchsorted(self.begins, here, "right") - 1]


class Level:
    """Windows of `length` words of a row's documents: all, or those with a surviving window at both ends."""

    def __init__(self, length: int, before: int, low: bool):
        self.length, self.before, self.low = length, before, low

    def __call__(self, row: dict) -> tuple[Part, np.ndarray, Keys]:
        part = Part(unblob(row["docs"]))
        if row["at"] is not None:
            at = unpacked(row["at"], np.int64)
            other = np.searchsorted(at, at + self.length - self.before)
            there = other < len(at)
            there[there] = at[other[there]] == at[there] + self.length - self.before
            at = at[there]
        else:
            at = part.all(self.length)
        return part, at, taken(windows(hashed(part.words, self.low), self.length), part.here(at))


def surviving(rows: DataFrame, level: Level, blocks: int, long: bool) -> DataFrame:
    """Staged parts of rows (shard, docs, at): documents with windows that occur at two places or more, the windows' places, and the other documents."""
    marks = frequent(rows, lambda row: level(row)[2], 2, blocks, long)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                part, at, keys = level(row)
                at = at[Cells(keys, blocks, long).marked(row["marks"])]
                some = np.zeros(len(part.docs), bool)
                some[part.doc(at)] = True
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([blob(part.docs.filter(pa.array(some)))], pa.binary()), pa.array([packed(at)], pa.binary()), pa.array([blob(part.docs.filter(pa.array(~some)))], pa.binary())], ["shard", "some", "at", "rest"])

    return staged(rows.join(marks, "shard", "left").mapInArrow(keep, PART))


def lengths(window: int, shortest: int) -> list[int]:
    """Lengths of the levels: halves of the wanted one, down to `shortest` at least."""
    out = [window]
    while out[0] >= 2 * shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def without_repeats(docs: DataFrame, window: int = 35, shortest: int = 16, shard_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept: each document without the words of windows that occur elsewhere too; kept is the words left, joined by one space."""
    size, blocks = grain(text_bytes(docs))
    shards = sharded(docs, shard_bytes or size)
    rows, rests, before = shards.select("shard", "docs", F.lit(None).cast("binary").alias("at")), [], 0
    nothing = F.lit(b"").alias("at")
    for length in lengths(window, shortest)[:-1]:
        now = surviving(rows, Level(length, before, False), blocks, False)
        rests.append(now.select("shard", F.col("rest").alias("docs"), nothing))
        rows, before = now.filter("length(at) > 0").select("shard", F.col("some").alias("docs"), "at"), length
        if rows.isEmpty():
            break
    level = Level(window, before, True)
    marks = frequent(rows, lambda row: level(row)[2], 2, blocks, True)
    found = rows.join(marks, "shard", "left")
    for rest in rests:
        found = found.unionByName(rest.withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType)))
    one = docs.select("doc_id").schema["doc_id"]
    schema = StructType([one, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                if row["marks"]:
                    part, at, keys = level(row)
                    at = part.here(at[Cells(keys, blocks, True).marked(row["marks"])])
                else:
                    part, at = Part(unblob(row["docs"])), np.zeros(0, np.int64)
                if not len(part.docs):
                    continue
                edges = np.zeros(len(part.words) + window, np.int64)
                edges[at] += 1
                edges[at + window] -= 1
                left = np.cumsum(edges) == 0
                n, gone, kept = [], [], []
                for begin, end in zip(part.begins.tolist(), part.ends.tolist(), strict=True):
                    own = part.words[begin:end]
                    if not left[begin:end].all():
                        own = [own[k] for k in np.flatnonzero(left[begin:end])]
                    n.append(end - begin)
                    gone.append(end - begin - len(own))
                    kept.append(b" ".join(own).decode())
                ids = part.docs.column("doc_id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [one.name, "n_words", "n_removed", "kept"])

    return found.mapInArrow(remove, schema)


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Windows of 35 words as text, counted over all documents.
REPEAT_SQL = r"""
with split_docs as (
  select row_number() over () as rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') as words from documents
), placed as (
  select rid, unnest(words) as word, unnest(range(len(words))) as pos from split_docs
), starts as (
  select d.rid, p.pos, array_to_string(d.words[p.pos + 1 : p.pos + 35], ' ') as w from split_docs d, lateral (select unnest(range(len(d.words) - 34)) as pos) p where len(d.words) >= 35
), repeated as (
  select rid, pos from (select *, count(*) over (partition by w) as n from starts) where n > 1
), marked as (
  select p.*, max(case when r.rid is not null then 1 else 0 end) over (partition by p.rid order by p.pos rows between 34 preceding and current row) as gone from placed p left join repeated r on p.rid = r.rid and p.pos = r.pos
), kept as (
  select rid, sum(gone) as n_removed, coalesce(string_agg(case when gone = 0 then word end, ' ' order by pos), '') as kept from marked group by rid
)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from split_docs d left join kept k using (rid)
"""
