"""Which keys of all shards add up to a wanted count: sketches met block by block, answers sent back as bits.

A shard is a row of some megabytes of text, whose keys (hashes of words or windows)
a function derives in a fixed order. Each shard sends its distinct keys with their
counts, packed, to blocks by the keys' first bits; a block adds up what all shards
sent and answers each shard with one bit a key. So a key's number of copies doesn't
matter (a shard sends it once), no list of keys is broadcast or gathered, and what
comes back to a shard is an eighth of a byte for each of its keys.

Short keys keep 26 bits beside those of the block, as a sketch does: keys may share
a cell, so sums are upper bounds. Long keys keep 96.

A message, from a shard to a block, stands for the keys of some 20 kB of text: both
grow with the root of the texts' size, so messages grow in proportion, until shards
and blocks are as large as a worker's memory allows (`grain`); beyond that messages
get smaller, down to one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import slices
from textquarry.llm.shingles import STEP, mixed

#: Bytes of text that a message stands for, and the least and most in a shard and in a block's share of the texts.
MESSAGE, LEAST, MOST_SHARD, MOST_BLOCK = 20_000, 1_000_000, 16_000_000, 64_000_000
#: Bits of a short key beside its block's: some 60 cells for each word that a block has in its share of the texts.
SHORT = 26

#: High and low 64 bits; short keys need no low ones.
Keys = tuple[np.ndarray, np.ndarray | None]


def hashed(words: list[bytes], low: bool = True) -> Keys:
    """128-bit keys of words, or their high halves alone."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64) if low else None


def followed(a: Keys, b: Keys) -> Keys:
    """Keys of sequences that are one of a and one of b."""
    return mixed(a[0] * STEP + b[0]), None if a[1] is None else mixed(b[1] + (a[1] ^ STEP) * np.uint64(0xD6E8FEB86659FD93))


def taken(keys: Keys, where) -> Keys:
    return keys[0][where], None if keys[1] is None else keys[1][where]


def windows(words: Keys, length: int) -> Keys:
    """Keys of all windows of `length` words, put together by doubling."""
    n, now, size = len(words[0]) - length + 1, words, 1
    if n <= 0:
        return taken(words, slice(0))
    while 2 * size <= length:
        now = followed(taken(now, slice(None, -size)), taken(now, slice(size, None)))
        size *= 2
    if size < length:
        now = followed(taken(now, slice(n)), taken(now, slice(length - size, length - size + n)))
    return now


def _runs(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The sorting order of keys, and where a new one begins in it."""
    order = np.argsort(first) if second is None else np.lexsort((second, first))
    new = np.ones(len(order), bool)
    if len(order):
        sorted_ = first[order]
        new[1:] = sorted_[1:] != sorted_[:-1]
        if second is not None:
            sorted_ = second[order]
            new[1:] |= sorted_[1:] != sorted_[:-1]
    return order, new


def packed(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, their bytes by place, so that compression finds the zeros."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


class Cells:
    """A shard's distinct keys in order, by block: a block is a range of keys' first bits. Without `places`, what was given where isn't kept."""

    def __init__(self, keys: Keys, blocks: int, long: bool, places: bool = True):
        high, low = keys
        self.blocks, self.long, self.keys = blocks, long, keys
        bits = 64 if long else min(64, SHORT + blocks.bit_length())
        self.order = np.lexsort((low >> np.uint64(32), high)) if long else np.argsort(high) if places else None
        sorted_ = (np.sort(high) if self.order is None else high[self.order]) >> np.uint64(64 - bits)
        self.new = np.ones(len(high), bool)
        self.new[1:] = sorted_[1:] != sorted_[:-1]
        if long:
            self.low = (low[self.order] >> np.uint64(32)).astype(np.uint32)
            self.new[1:] |= self.low[1:] != self.low[:-1]
        starts = np.flatnonzero(self.new)
        self.counts = np.diff(np.append(starts, len(high)))
        self.high = sorted_[starts]
        self.low = self.low[starts] if long else None
        self.begins = np.array([-(-(k << bits) // blocks) for k in range(blocks)], np.uint64)
        self.edges = np.append(np.searchsorted(self.high, self.begins), len(starts))

    def rows(self) -> Iterator[tuple]:
        """block, number of keys, their parts, and counts up to 255."""
        counts = np.minimum(self.counts, 255).astype(np.uint8)
        for block in np.flatnonzero(np.diff(self.edges)):
            here = slice(self.edges[block], self.edges[block + 1])
            high = self.high[here] - self.begins[block]
            yield int(block), len(high), packed(high if self.long else high.astype(np.uint32)), self.low[here].tobytes() if self.long else b"", counts[here].tobytes()

    def _wanted(self, marks: list[dict] | None) -> np.ndarray:
        wanted = np.zeros(len(self.counts), bool)
        for mark in marks or ():
            first, end = self.edges[mark["block"]], self.edges[mark["block"] + 1]
            wanted[first:end] = np.unpackbits(np.frombuffer(mark["bits"], np.uint8))[: end - first]
        return wanted[np.cumsum(self.new) - 1]

    def marked(self, marks: list[dict] | None) -> np.ndarray:
        """For each key as it was given, whether its block's answer says that it is wanted."""
        out = np.empty(len(self.order), bool)
        out[self.order] = self._wanted(marks)
        return out


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def grain(size: int, most_shard: int = MOST_SHARD, most_block: int = MOST_BLOCK) -> tuple[int, int]:
    """Bytes of text in a shard, and the number of blocks, for `size` bytes of text."""
    shard = min(most_shard, max(LEAST, isqrt(size * MESSAGE)))
    block = min(most_block, max(LEAST, size * MESSAGE // shard))
    return shard, -(-size // block) or 1


def frequent(rows: DataFrame, keys: Callable[[dict], Keys], least: int, blocks: int, long: bool) -> DataFrame:
    """(shard, marks) of the shards that hold a key whose counts in all shards add up to `least` (255 at most).

    rows has a row for each `shard`, from which `keys` derives the shard's keys;
    `Cells(keys(row), blocks, long).marked(marks)` reads the answer.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                out = list(Cells(keys(row), blocks, long, False).rows())
                if out:
                    block, n, high, low, counts = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(out), pa.int64()), pa.array(block, pa.int32()), pa.array(n, pa.int32()), pa.array(high, pa.binary()), pa.array(low, pa.binary()), pa.array(counts, pa.binary())], ["shard", "block", "n", "high", "low", "counts"])

    def meet(sent: pa.Table) -> pa.Table:
        n = sent.column("n").to_pylist()
        high = np.concatenate([unpacked(x.as_py(), np.uint64 if long else np.uint32) for x in sent.column("high")])
        low = np.frombuffer(b"".join(sent.column("low").to_pylist()), np.uint32) if long else None
        counts = np.frombuffer(b"".join(sent.column("counts").to_pylist()), np.uint8)
        order, new = _runs(high, low)
        sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
        wanted = np.empty(len(order), bool)
        wanted[order] = (sums >= least)[np.cumsum(new) - 1]
        parts = np.split(wanted, np.cumsum(n)[:-1])
        some = [k for k, part in enumerate(parts) if part.any()]
        return pa.table([sent.column("shard").take(pa.array(some, pa.int64())), sent.column("block").take(pa.array(some, pa.int64())), pa.array([np.packbits(parts[k]).tobytes() for k in some], pa.binary())], ["shard", "block", "bits"])

    sent = rows.mapInArrow(send, "shard bigint, block int, n int, high binary, low binary, counts binary")
    return sent.groupBy("block").applyInArrow(meet, "shard bigint, block int, bits binary").groupBy("shard").agg(F.collect_list(F.struct("block", "bits")).alias("marks"))
