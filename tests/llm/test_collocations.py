"""Phrase collocations against counting by hand."""

import collections
import random
import re

import pyarrow as pa
import pytest

from textquarry.llm import collocations
from textquarry.llm.collocations import collocations as mine
from textquarry.llm.collocations import matches
from textquarry.llm.exchange import Cells, hashed

SCHEMA = "doc_id bigint, lang string, text string, shard string, body string, marks string, phrase string, words string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, fewest, most, least, covered, top):
    count, total = collections.Counter(), collections.Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, most + 1):
                count.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {key: a for key, a in count.items() if a >= least and len(key[1]) >= fewest}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        longer = [b for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if longer and 100 * max(longer) >= covered * a:
            continue
        cuts = [(1_000_000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["a", "A", "b", "the", "The", "of", "éÉ", "x'y", "漢", "　", "z\x85z", "\x1c"]
    out = [(None, "en", None), (1, None, ""), (1, None, " . , \t"), (2, "en", "a " * 300 + "a"), (3, "de", "tie up"), (3, "de", "tie up")]
    for k in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for _ in range(rng.randint(1, 80)))
        out.append((k % 40, rng.choice(["en", "en", "de", None, "und"]), text))
    return [*out, *out[20:40]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], SCHEMA)


@pytest.mark.parametrize(("fewest", "most", "least", "covered", "top", "size"), [(2, 3, 10, 50, 2000, 500), (2, 3, 3, 50, 7, 10_000_000), (2, 4, 5, 30, 2000, 900), (3, 3, 4, 50, 50, 900)])
def test_phrases_counted_by_hand(spark, rows, fewest, most, least, covered, top, size):
    got = mine(frame(spark, rows), fewest, most, least, covered, top, size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, fewest, most, least, covered, top)
    assert sorted(map(tuple, got.collect())) == want
    assert want


def test_no_documents(spark):
    assert mine(frame(spark, [])).count() == 0
    assert mine(frame(spark, [(1, None, None)])).count() == 0


def test_long_runs_of_space_and_breaks(spark):
    rows = [(k, "en", "a b" + " " * 200_000 + "c\t \t" + "\n " * 50_000 + "." * 100_000 + " a b") for k in range(3)]
    got = [(r["phrase"], r["a"], r["n"]) for r in mine(frame(spark, rows), least=3).collect()]
    assert got == [("a b c", 3, 15)]  # it covers half of all "a b"


def test_matches_overlap_and_keep_to_words():
    assert matches(" a a a b \n aa a a ", ["a a", "a", "a b", "b a"]).tolist() == [3, 5, 1, 0]


def test_large_counts_stay_exact(spark):
    counts = spark.createDataFrame([("en", "x y", 2, 3_000_000_000_001), ("en", "x", 1, 3_000_000_000_007), ("en", "y", 1, 3_000_000_000_011)], "lang string, phrase string, words int, a bigint")
    row = collocations.scored(counts, 2, 3, 50).first()
    assert row["score"] == 1_000_000 * 3_000_000_000_001**2 // (3_000_000_000_007 * 3_000_000_000_011)


def test_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, collocations.op12_phrase_collocations(spark, sf).collect())) == sorted(con.execute(collocations.PHRASE_SQL).fetchall())


def test_automata_and_shards_stay_small(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(collocations, "AT_ONCE", 7)
    monkeypatch.setattr(collocations, "matches", lambda body, phrases: asked.append(len(phrases)) or matches(body, phrases))
    words = [b"a", b"b", b"a", b"b", b"\n", b"a", *(b"w%d" % k for k in range(40))]

    class Shards:
        """Stands for one shard, whose keys are all wanted."""

        sparkSession = None

        def __getattr__(self, _):
            return lambda *a, **_: self

        def mapInArrow(self, scan, _):  # noqa: N802
            row = {"lang": "en", "body": f" {b' '.join(words).decode()} "}
            cells = collocations.Cells(collocations.phrases(row, 3)[2], 1, False)
            row["marks"] = [{"block": 0, "bits": b"\xff" * len(cells.counts)}]
            self.rows = [r for b in scan([pa.RecordBatch.from_pylist([row])]) for r in b.to_pylist()]
            return self

    shards = Shards()
    monkeypatch.setattr(collocations, "frequent", lambda *_: shards)
    monkeypatch.setattr(collocations, "staged", lambda df: df)
    collocations.phrase_counts(shards, 3, 10, 1)
    want = collections.Counter(w for n in (1, 2, 3) for i in range(len(words) - n + 1) if b"\n" not in (w := tuple(words[i : i + n])))
    assert {r["phrase"]: (r["words"], r["a"]) for r in shards.rows} == {b" ".join(w).decode(): (len(w), a) for w, a in want.items()}
    assert len(shards.rows) == len(want)
    assert len(asked) > 10
    assert max(asked) <= 7
    assert collocations.grain(10**12, collocations.MOST_SHARD, collocations.MOST_BLOCK)[0] <= 4_000_000


def test_short_names_differ():
    words = [b"%d" % k for k in range(70_000)]
    names = list(collocations.short_names([*words[:5], b"\n", *words[5:]]))
    assert names[5] == "\n"
    assert len(set(names)) == 70_001
    assert [len(names[k]) for k in (0, 64, 65, 64 + 64**2)] == [1, 1, 2, 2]


def test_a_shards_words_are_hashed_once_each(monkeypatch):
    asked = []
    monkeypatch.setattr(collocations, "hashed", lambda words, *a: asked.append(len(words)) or hashed(words, *a))
    words, places, keys = collocations.phrases({"lang": "en", "body": " a b a b \n " + "a b " * 500}, 3)
    assert max(asked) == 3
    assert words.to_pylist() == ["a", "b", "a", "b", "\n", *["a", "b"] * 500]
    assert [len(at) for at in places] == [1004, 3 + 999, 2 + 998]
    assert len(set(keys[0].tolist())) == 6


def test_cells_without_places_send_the_same():
    keys = hashed([b"%d" % (k % 700) for k in range(2000)])
    for long in (False, True):
        assert list(Cells(keys, 5, long, False).rows()) == list(Cells(keys, 5, long).rows())
