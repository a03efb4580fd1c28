"""Phrase collocation mining (operator 12).

A sketch of all phrases' counts, by language, gives upper bounds; the phrases of a
shard of text whose bound reaches the least count compile into an automaton, each
between spaces, which scans the shard and counts all matches, overlapping ones
too (single words, which are parts only, are counted as they come). Counts are
summed over the shards, and then only are thresholds applied, so what the sketch
lets through needlessly costs time, not correctness.

The sketch is distributed (see `exchange`): its cells grow with the texts, and a
shard asks for its own phrases' bounds only. A shard has 4 MB of text however large
the texts are, and an automaton takes so many of its phrases at a time, spelt by
short names of their words; so what a task holds doesn't grow. Parts' counts are joined by (lang, part); single words,
whose phrases may be many, are salted.

Defined cases: a null text is empty, a null lang is `und`; repeated rows and equal
or null ids count each; very long texts are taken whole and may span shards at the
ends of pieces; ties in score go by count, then phrase in byte order; other columns
are not used; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.common import UPPER, slices, staged, table, text_or_empty
from textquarry.llm.exchange import Cells, Keys, frequent, grain, hashed, taken, text_bytes, windows

#: Pieces end at these; words within a piece are set apart by spaces and tabs.
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLDED = bytes.maketrans(UPPER.encode() + ENDS + b"\t", UPPER.lower().encode() + b"\n" * len(ENDS) + b" ")
#: Between pieces, as a word of its own.
BREAK = b"\n"
SPACES, GAPS = re.compile(rb"  +"), re.compile(rb" ?\n[ \n]*")
#: Bytes of text in a shard, and in a block's share of the texts, at most: a worker's keys of a shard take some 50 times that for a while.
MOST_SHARD, MOST_BLOCK = 4_000_000, 16_000_000
#: Phrases in an automaton; each takes some hundred bytes and more.
AT_ONCE = 200_000
#: Letters of short names.
LETTERS = [chr(k) for k in range(ord("!"), ord("!") + 64)]
#: Single words meet their phrases in so many tasks.
SALTS = 32


def sharded(docs: DataFrame, size: int) -> DataFrame:
    """Staged rows (shard, lang, n_words, body): body is the folded words and the breaks between pieces, each between single spaces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[str, list[bytes]] = {}
        full: dict[str, int] = {}
        every = 0

        def out(langs: list[str]) -> pa.RecordBatch:
            nonlocal number, every
            rows = []
            for lang in langs:
                body = b" " + b" \n ".join(held.pop(lang)) + b" "
                rows.append((number, lang, body.count(b" ") - 1 - body.count(BREAK), body.decode()))
                number, every = number + 1, every - full.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["shard", "lang", "n_words", "body"])

        for batch in slices(batches, 16):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rest = GAPS.sub(BREAK, SPACES.sub(b" ", text.encode().translate(FOLDED))).strip(b" \n")
                while rest:
                    end = rest.find(BREAK, size)  # only a text that fills a shard by itself is cut
                    part, rest = (rest, b"") if end < 0 else (rest[:end], rest[end + 1 :])
                    held.setdefault(lang, []).append(part.replace(BREAK, b" \n "))
                    full[lang] = full.get(lang, 0) + len(part)
                    every += len(part)
                    if full[lang] >= size:
                        yield out([lang])
                    elif every >= 4 * size:
                        yield out(list(held))
        if held:
            yield out(list(held))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    return staged(rows.mapInArrow(gather, "shard bigint, lang string, n_words bigint, body string"))


def listed(strings: pa.Array) -> list:
    """to_pylist, several times as fast."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def phrases(row: dict, most: int) -> tuple[pa.DictionaryArray, list[np.ndarray], Keys]:
    """A shard's words, the places of its phrases of 1 to `most` words within pieces, by number of words, and their keys, which differ by language and number."""
    words = pc.split_pattern(pa.array([row["body"]], pa.string()), " ").values[1:-1].dictionary_encode()
    once, at = listed(words.dictionary.cast(pa.binary())), words.indices.to_numpy()
    keys = taken(hashed(once, False), at)
    breaks = np.flatnonzero(at == once.index(BREAK)) if BREAK in once else at[:0]
    places, found = [], []
    for n in range(1, most + 1):
        here = windows(keys, n)
        inside = np.ones(len(here[0]), bool)
        for k in range(n):
            off = breaks - k
            inside[off[(off >= 0) & (off < len(inside))]] = False
        at = np.flatnonzero(inside)
        places.append(at)
        found.append(here[0][at] ^ hashed([f"{n} {row['lang']}".encode()], False)[0])
    return words, places, (np.concatenate(found), None)


def matches(body: str, phrases: list[str]) -> np.ndarray:
    """How often each phrase occurs in body between spaces, overlaps included."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase} ", k)
    if not phrases:
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    return np.bincount(np.fromiter((k for _, k in automaton.iter(body)), np.int64), minlength=len(phrases))


def short_names(words: list[bytes]) -> Iterator[str]:
    """A name for each of distinct words, none twice: the first have one letter, the next two, and so on; a break stays one."""
    names = ("".join(x) for n in itertools.count(1) for x in itertools.product(LETTERS, repeat=n))
    return ("\n" if word == BREAK else next(names) for word in words)


def spelt(words: pa.Array, numbers: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The phrases of n words at these places, with single spaces; a word is words[its number]."""
    return pc.binary_join_element_wise(*(words.take(pa.array(numbers[at + k])) for k in range(n)), " ")


def different(at: np.ndarray, n: int, numbers: np.ndarray) -> np.ndarray:
    """Places of phrases of n words in the order of their words' numbers, each phrase once."""
    at = at[np.lexsort([numbers[at + k] for k in reversed(range(n))])]
    new = np.ones(len(at), bool)
    new[1:] = np.any([numbers[at[1:] + k] != numbers[at[:-1] + k] for k in range(n)], axis=0)
    return at[new]


def phrase_counts(shards: DataFrame, most: int, least: int, blocks: int) -> DataFrame:
    """(lang, phrase, words, a) of all phrases of 1 to `most` words that occur `least` times or more in their language."""
    if least > 255:
        raise ValueError("sums in the exchange tell counts up to 255 apart")
    marks = frequent(shards, lambda row: phrases(row, most)[2], least, blocks, False)

    def counted(lang: str, named: pa.Array, sizes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(named), pa.string()), named, pa.array(sizes), pa.array(counts, pa.int64())], ["lang", "phrase", "words", "a"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                words, places, keys = phrases(row, most)
                wanted = np.split(Cells(keys, blocks, False).marked(row["marks"]), np.cumsum([len(at) for at in places])[:-1])
                del keys
                every = np.bincount(words.indices)
                often = np.argsort(-every, kind="stable")
                texts, every = words.dictionary.take(pa.array(often)), every[often]
                numbers = np.argsort(often).astype(np.int32)[words.indices]
                names = pa.array(short_names(listed(texts.cast(pa.binary()))), pa.string())
                body = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(numbers)], names.take(pa.array(numbers))), " ")[0].as_py() + " "
                single = np.unique(numbers[places[0][wanted[0]]])
                found = [different(at[some], n, numbers) for n, (at, some) in enumerate(zip(places[1:], wanted[1:], strict=True), 2)]
                del words, places, wanted
                for k in range(0, len(single), AT_ONCE):  # parts of candidates, not candidates
                    here = single[k : k + AT_ONCE]
                    yield counted(row["lang"], texts.take(pa.array(here)), np.ones(len(here), np.int32), every[here])
                sizes, starts = np.repeat(np.arange(2, most + 1, dtype=np.int32), [len(at) for at in found]), np.concatenate([single[:0], *found])
                for k in range(0, len(starts), AT_ONCE):
                    here = sizes[k : k + AT_ONCE]
                    parts = [(starts[k : k + AT_ONCE][here == n], n) for n in range(2, most + 1)]
                    counts = matches(body, listed(pa.concat_arrays([spelt(names, numbers, at, n) for at, n in parts])))
                    yield counted(row["lang"], pa.concat_arrays([spelt(texts, numbers, at, n) for at, n in parts]), here, counts)

    found = shards.join(marks, "shard").select("lang", "body", "marks").mapInArrow(scan, "lang string, phrase string, words int, a bigint")
    return staged(found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least))


def scored(counts: DataFrame, fewest: int, most: int, covered: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers by `covered` percent; counts as `phrase_counts` gives them."""
    words = F.split("phrase", " ")
    phrases = counts.filter(F.col("words") >= fewest).withColumn("all", words)

    def joined(start, length):
        return F.array_join(F.slice("all", start, length), " ")

    cuts = phrases.select("lang", "phrase", "words", "a", "all", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), joined(F.lit(1), F.col("k")).alias("part"), F.col("k").alias("size")), F.struct(F.lit("r").alias("side"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("part"), (F.col("words") - F.col("k")).alias("size"))))
    parts = cuts.select("lang", "phrase", "a", "k", sides.alias("of")).select("lang", "phrase", "a", "k", "of.side", "of.part", F.when(F.col("of.size") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    known = counts.filter(F.col("words") < most).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"), F.explode(F.sequence(F.lit(0), F.when(F.col("words") == 1, SALTS - 1).otherwise(0))).alias("salt"))
    met = parts.join(known, ["lang", "part", "salt"]).select("lang", "phrase", "a", "k", "side", "f", F.lit(None).cast("bigint").alias("longer"))
    # the same grouping also brings each phrase the most frequent longer candidate that holds it
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(fewest), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: joined(i, n)))))
    longer = phrases.filter(F.col("words") > fewest).select("lang", "a", inner.alias("phrase")).select("lang", "phrase", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("bigint").alias("f"), F.col("a").alias("longer"))
    whole = met.unionByName(longer).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *(F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in range(1, most) for side in "lr"))
    whole = whole.filter(f"longer is null or 100 * cast(longer as decimal(20)) < {int(covered)} * cast(a as decimal(20))")
    score = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(1000000 * cast(a as decimal(16)) * cast(a as decimal(16))) div (cast(l{k} as decimal(19)) * cast(r{k} as decimal(19)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, most)]
    best = F.array_min(F.array_compact(F.array(*score)))
    return whole.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, fewest: int = 2, most: int = 3, least: int = 10, covered: int = 50, top: int = 2000, shard_bytes: int | None = None) -> DataFrame:
    """Each language's first `top` phrases of fewest to most words by score.

    A phrase with `least` occurrences or more is a candidate. Its score is
    floor(1000000 a a / (l r)) of its lowest-scoring cut in two, and a candidate
    within a longer one that has `covered` percent of its occurrences is dropped.
    """
    size, blocks = grain(text_bytes(docs), MOST_SHARD, MOST_BLOCK)
    shards = sharded(docs, shard_bytes or size)
    counts = phrase_counts(shards, most, least, most * blocks)
    n = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(counts, fewest, most, covered).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: All phrases of one to three words, counted.
PHRASE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, list_filter(string_split_regex(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x != '') as ws from documents
), grams as (
  select lang, k as words, array_to_string(ws[i + 1 : i + k], ' ') as phrase from pieces, (values (1), (2), (3)) t(k), lateral (select unnest(range(len(ws) - k + 1)) as i) p where len(ws) >= k
), counts as (
  select lang, words, phrase, count(*) as a from grams group by all having count(*) >= 10
), totals as (
  select lang, sum(len(ws))::bigint as n from pieces group by lang
), cuts as (
  select c.lang, c.words, c.phrase, c.a, k, array_to_string(string_split(c.phrase, ' ')[1 : k], ' ') as left_part, array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ') as right_part from counts c, (values (1), (2)) t(k) where c.words > k
), scores as (
  select c.lang, c.words, c.phrase, c.a, k, l.a as l, r.a as r, ((1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a))::bigint as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = left_part join counts r on r.lang = c.lang and r.phrase = right_part
), lowest as (
  select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_parts as (
  select lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') as phrase, max(a) as longer from counts, (values (1), (2)) t(i) where words = 3 group by all
), ranked as (
  select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank from lowest s left join inner_parts i on s.lang = i.lang and s.phrase = i.phrase where i.longer is null or 100 * i.longer < 50 * s.a
)
select r.lang, rank, phrase, a, l, r, n, score from ranked r join totals t on r.lang = t.lang where rank <= 2000
"""
