"""Repeated passages and the exchange of keys against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from textquarry.llm import exchange, repeats
from textquarry.llm.exchange import Cells, frequent, grain, hashed, windows
from textquarry.llm.repeats import without_repeats

SCHEMA = "doc_id string, text string, shard string, docs string, at string, kept string, bytes string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(texts, window):
    """(n_words, n_removed, kept) of each text, by counting all windows of all texts."""
    words = [[w for w in SPACE.split(t or "") if w] for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    shared = [" ".join(rng.choice(["a", "b", "C", "ü", "漢"]) for _ in range(rng.randint(3, 50))) for _ in range(6)]
    out = [None, "", " \n\t", "one", "tie tie tie tie tie tie tie tie tie", " a　b "]
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        out.append(rng.choice([" ", "\n", "\x0b "]).join(parts))
    long = " ".join(f"v{k}" for k in range(20_000))
    return [*out, *out[8:12], *[out[20]] * 30, long, long + " end"]


def frame(spark, texts):
    return spark.createDataFrame([(None if k % 7 == 0 else str(k % 50), t, "clash", "clash", "clash", "clash", "clash") for k, t in enumerate(texts)], SCHEMA)


def test_levels():
    assert [repeats.lengths(*x) for x in ((35, 16), (35, 2), (1, 1), (2, 1), (100, 16))] == [[18, 35], [3, 5, 9, 18, 35], [1], [1, 2], [25, 50, 100]]


@pytest.mark.parametrize(("window", "shortest", "size"), [(5, 1, 300), (8, 16, 1_000_000), (1, 1, 300), (35, 16, 2000), (35, 2, 900)])
def test_repeats_are_all_windows_counted(spark, texts, window, shortest, size):
    docs = frame(spark, texts)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in without_repeats(docs, window, shortest, size).collect())
    ids = [r["doc_id"] for r in docs.collect()]
    assert got == collections.Counter((i, *p) for i, p in zip(ids, plain([r["text"] for r in docs.collect()], window), strict=True))


def test_no_documents_and_no_repeats(spark):
    assert without_repeats(frame(spark, [])).count() == 0
    assert [r["kept"] for r in without_repeats(frame(spark, ["a b c"]), 2).collect()] == ["a b c"]


def test_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, repeats.op13_repeated_passages(spark, sf).collect())) == sorted(con.execute(repeats.REPEAT_SQL).fetchall())


def test_windows_are_told_apart():
    words = [b"a", b"b", b"a", b"b", b"a", b"c", b""]
    for length in (1, 2, 3, 4, 5):
        high, low = windows(hashed(words), length)
        named = [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]
        assert len(high) == len(named) and len(set(zip(high.tolist(), low.tolist(), strict=True))) == len(set(named))
    assert len(windows(hashed(words[:2]), 3)[0]) == 0


def test_messages_grow_with_the_texts():
    for size in (0, 1, 10**6, 10**8, 10**9, 10**10):
        shard, blocks = grain(size)
        assert blocks >= 1 and (size // shard + 1) * blocks <= size / 10_000 + 30


@pytest.mark.parametrize(("long", "blocks"), [(False, 1), (False, 5), (True, 1), (True, 37)])
def test_exchange_counts_all_shards(spark, long, blocks):
    rng = np.random.default_rng(1)
    shards = [rng.integers(0, 3000, rng.integers(1, 2000)) for _ in range(9)] + [np.zeros(700, np.int64)] * 20
    total = collections.Counter(np.concatenate(shards).tolist())
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(shards)], "shard bigint, numbers array<bigint>")

    def keys(row):
        x = np.array(row["numbers"], np.uint64)
        return exchange.mixed(x * exchange.STEP), exchange.mixed(x + np.uint64(9))

    for r in rows.join(frequent(rows, keys, 9, blocks, long), "shard", "left").collect():
        got = Cells(keys(r), blocks, long).marked(r["marks"])
        assert got.tolist() == [total[x] >= 9 for x in r["numbers"]]


