"""Packing documents into sequences of fixed length (operator 2).

Pattern packing: the histogram of piece lengths (at most `capacity` rows, the
only thing the driver sees) is fitted by repeat counts of few-document patterns
through non-negative least squares; the counts are rounded down, and what the
patterns leave is packed best-fit decreasing, a whole run of equal lengths at a
time. The plan says for each length which sequences its first, second, ...
piece goes to. Pieces are numbered within their length in two steps, by salted
bucket and then by the buckets' prefix sums, so that one very frequent length
doesn't meet in one task.

Defined cases: null or empty text is a document of the end token alone; repeated
rows (and null or equal ids) are packed each on its own; no documents give no rows; a document longer
than a sequence is cut into full pieces and a rest; other columns are not used.
"""

from __future__ import annotations

import bisect
import collections
import itertools
import json
import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry.llm.bpe import byte_symbols
from textquarry.llm.common import once, slices, staged, table, text_or_empty
from textquarry.llm.token_counts import tokenizer_text

#: Rows of a salted bucket of equal lengths, and buckets of one length at most.
BUCKET_ROWS, MOST_BUCKETS = 128, 65_536
#: Bytes of text whose words are looked up at once, about (or one text).
ROUND_BYTES = 1_000_000
#: Words beyond this code point go to the tokenizer library one by one.
PLAIN = 0x250


class Known:
    """Token ids by key: keys have numbers, and their ids lie side by side in one array. When full, it keeps what came more than once since the last time."""

    def __init__(self, most: int):
        self.most = most
        self._begin([], np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _begin(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.at = collections.defaultdict(itertools.count(len(keys)).__next__, zip(keys, itertools.count()))  # noqa: B905
        self.ids, self.counts, self.starts, self.uses = ids, counts, np.cumsum(counts) - counts, np.zeros(len(keys), np.int64)

    def trim(self) -> None:
        """Make room if it is full; numbers change."""
        if len(self.at) >= self.most:
            kept, half = np.flatnonzero(self.uses > 1), self.most // 2
            if len(kept) > half:
                kept = np.sort(np.argpartition(-self.uses, half)[:half])
            keys = list(self.at)
            self._begin([keys[k] for k in kept.tolist()], self.gather(kept)[0], self.counts[kept])

    def find(self, keys: list[str]) -> tuple[np.ndarray, list[str]]:
        """The keys' numbers, and those that are new, in the order of their numbers; `learn` must follow."""
        before = len(self.at)
        where = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        uses = np.bincount(where, minlength=len(self.at))
        uses[:before] += self.uses
        self.uses = uses
        return where, list(itertools.islice(reversed(self.at), len(self.at) - before))[::-1]

    def learn(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """The new keys' ids side by side, and how many each has."""
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
        self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))

    def gather(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys side by side, and where each key's end."""
        counts = self.counts[where]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.starts[where] + counts - ends, counts) + np.arange(counts.sum())], ends


class WordTokens:
    """Token ids of texts whose tokenizer drops white space, word by word.

    White space ends a pretoken there, so a text's ids are those of its parts
    between spaces and line ends. New parts are cut into lower-cased pretokens
    all at once, and new pretokens go side by side to the library's model, without the
    normalizer and the patterns that have been applied by then: of a
    pretoken's tokens just the last one closes a word, so their ids fall apart again.
    """

    def __init__(self, spec: str, most_words: int = 400_000, most_pretokens: int = 250_000, together: int = 20_000):
        import regex
        from tokenizers import Tokenizer

        declared = json.loads(spec)
        split, model = declared["pre_tokenizer"]["pretokenizers"][0], declared["model"]
        if split["behavior"] != "Removed" or not split["invert"] or not model["end_of_word_suffix"]:
            raise ValueError("this operator needs a tokenizer that drops white space and marks words' ends")
        slow = regex.compile(split["pattern"]["Regex"] + "|[ \n]")
        there = sorted({c for k in range(PLAIN) for c in unicodedata.normalize("NFC", chr(k)).lower()})
        quick = re.compile(re.sub(r"\\p\{\w+\}|\\s", lambda m: "".join(re.escape(c) for c in there if regex.match(m[0], c)), slow.pattern))  # no classes but lists, several times as fast
        probe = "".join(there) + "a".join(there) + " ".join(there)
        self.pattern = quick if quick.findall(probe) == slow.findall(probe) else slow
        marks = [re.escape(x["content"]) for x in declared["added_tokens"]]
        self.odd = re.compile("|".join([*marks, f"[{chr(PLAIN)}-{chr(sys.maxunicode)}]"]))
        self.library = Tokenizer.from_str(spec)
        self.model = Tokenizer.from_str(json.dumps(declared | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}}))
        self.symbols = np.zeros(256, "<u4")
        for symbol, byte in byte_symbols().items():
            self.symbols[byte] = ord(symbol)
        self.symbols[ord(" ")] = ord(" ")  # between pretokens; none has one
        self.closes = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.closes[[i for x, i in model["vocab"].items() if x.endswith(model["end_of_word_suffix"])]] = True
        self.together, self.words, self.pretokens = together, Known(most_words), Known(most_pretokens)

    def _encode(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pretokens' ids side by side, and how many each has."""
        text = self.symbols[np.frombuffer(" ".join(own).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        if len(own) == 1:
            return ids, np.array([len(ids)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(own) else tuple(map(np.concatenate, zip(*(self._encode([x]) for x in own), strict=True)))

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.library.encode(x, add_special_tokens=False).ids for x in parts]
        return np.array(list(itertools.chain.from_iterable(found)), "<u4"), np.array([len(x) for x in found])

    def _learn(self, words: list[str]) -> None:
        """Words with special strings or rare letters stand for themselves among the pretokens, after a line end."""
        self.pretokens.trim()
        joined, odd = " ".join(words), []
        if self.odd.search(joined):
            shown = ["\n" if self.odd.search(x) else x for x in words]
            odd = ["\n" + x for x, y in zip(words, shown, strict=True) if y == "\n"]
            joined = " ".join(shown)
        parts = self.pattern.findall(unicodedata.normalize("NFC", joined).lower())
        if odd:
            rest = iter(odd)
            parts = [next(rest) if x == "\n" else x for x in parts]
        if new := self.pretokens.find([" ", *odd])[1]:
            self.pretokens.learn(*self._alone([x[1:] for x in new]))
        where, new = self.pretokens.find(parts)
        for k in range(0, len(new), self.together):
            self.pretokens.learn(*self._encode(new[k : k + self.together]))
        ids, ends = self.pretokens.gather(where)
        self.words.learn(ids, np.diff([*ends[where == self.pretokens.at[" "]], len(ids)], prepend=0))

    def ids(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        parts = cut.flatten().dictionary_encode()  # Python sees each part once, and splits one string sooner than it makes many
        own = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts.dictionary)], pa.int32()), parts.dictionary), " ")[0].as_py().split(" ")
        self.words.trim()
        where, new = self.words.find(own)
        if new:
            self._learn(new)
        ids, ends = self.words.gather(where[parts.indices.to_numpy()])
        raw, last = ids.tobytes(), (4 * np.append(0, ends)[np.cumsum(cut.value_lengths().to_numpy(), dtype=np.int64)]).tolist()
        return [raw[a:b] for a, b in zip([0, *last], last)]  # noqa: B905


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, text: str = "text") -> DataFrame:
    """Add the column pieces: an array of (piece, start, length, ids), ids as little-endian unsigned 32-bit numbers."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    end = np.array([end_id], "<u4").tobytes()
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]))

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids:binary>>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, width = once(WordTokens, spec.value), 4 * capacity
        for batch in slices(batches, made=True):
            done, turn = [], np.cumsum(pc.binary_length(batch).to_numpy(zero_copy_only=False), dtype=np.int64) // ROUND_BYTES
            edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(batch)] if len(batch) else []
            for a, b in itertools.pairwise(edges):
                offsets, piece, start, ids = [0], [], [], []
                for x in words.ids(batch[a:b]):
                    own = x + end
                    for k in range(-(-len(own) // width)):
                        piece.append(k)
                        start.append(k * capacity)
                        ids.append(own[k * width : (k + 1) * width])
                    offsets.append(len(piece))
                values = pa.StructArray.from_arrays([pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], fields=list(kind.value_type))
                done.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=kind))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    return df.withColumn("pieces", pieces(text_or_empty(text)))


def patterns(lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Few-document combinations of the given lengths (ascending) that fill a sequence as far as these lengths can."""

    def most(room: int) -> int:
        k = bisect.bisect_right(lengths, room)
        return lengths[k - 1] if k else 0

    if not lengths:
        return []
    spread = sorted({lengths[round(q * (len(lengths) - 1) / 8)] for q in range(9)})
    found = set()
    for a in lengths:
        tops = {most(capacity - a), a, *spread}
        for b in tops - {0}:
            if a + b > capacity:
                continue
            third = most(capacity - a - b)
            found.add(tuple(sorted((a, b, third) if third else (a, b))))
            for c in {third, most((capacity - a - b) // 2)} - {0}:
                rest = most(capacity - a - b - c)
                found.add(tuple(sorted((a, b, c, rest) if rest else (a, b, c))))
        if a < capacity == a + most(capacity - a):
            found.add(tuple(sorted((a, capacity - a))))
        if a == capacity:
            found.add((a,))
    return sorted(found, key=lambda p: (capacity - sum(p), p))


def repeat_counts(options: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = 12) -> list[float]:
    """Non-negative least squares: counts x of the patterns that bring A x closest to the histogram, by cyclic coordinate descent."""
    left = dict.fromkeys(histogram, 0.0) | {k: float(v) for k, v in histogram.items()}
    norms = [sum(p.count(i) for i in p) for p in options]
    x = [0.0] * len(options)
    for _ in range(sweeps):
        moved = 0.0
        for k, p in enumerate(options):
            new = max(0.0, x[k] + sum([left[i] for i in p]) / norms[k])
            if change := new - x[k]:
                for i in p:
                    left[i] -= change
                x[k], moved = new, max(moved, abs(change))
        if moved < 0.5:
            break
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, pieces a sequence, offset): from that rank on, until the length's next row, pieces go to consecutive sequences.

    Costs depend on the number of distinct lengths, not on how many pieces there are.
    """
    left, given, rows, sequences = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    open_runs: dict[int, list[tuple[int, int]]] = {}  # by free room: runs (first sequence, how many)
    rooms: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_runs:
                bisect.insort(rooms, room)
            open_runs.setdefault(room, []).append((first, n))

    def put(length: int, n: int, first: int, each: int, room: int) -> None:
        rows.append((length, given[length], first, each, capacity - room))
        given[length] += n * each
        left[length] -= n * each

    options = patterns(sorted(k for k, n in histogram.items() if n > 0), capacity)
    for p, x in zip(options, repeat_counts(options, histogram), strict=True):
        n = min([math.floor(x), *(left[i] // p.count(i) for i in set(p))])
        if n > 0:
            room = capacity
            for i in sorted(set(p), reverse=True):
                put(i, n, sequences, p.count(i), room)
                room -= i * p.count(i)
            leave(room, sequences, n)
            sequences += n
    for length in sorted(left, reverse=True):
        while left[length] > 0:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):  # no open sequence has room
                each = min(capacity // length, left[length])
                n = left[length] // each
                put(length, n, sequences, each, capacity)
                leave(capacity - each * length, sequences, n)
                sequences += n
                continue
            room = rooms[k]
            first, n = open_runs[room].pop()
            if not open_runs[room]:
                del open_runs[room], rooms[k]
            each = min(room // length, left[length])
            used = min(n, left[length] // each)
            put(length, used, first, each, room)
            leave(room - each * length, first, used)
            leave(room, first + used, n - used)
    return rows


def numbered(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Add rank, each piece's number within its length from 0, the same in each run."""
    spark = pieces.sparkSession
    buckets = spark.createDataFrame([(k, min(MOST_BUCKETS, -(-n // BUCKET_ROWS))) for k, n in histogram.items()], "length long, _n long")
    salted = pieces.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.col("_n"))).drop("_n")
    sums = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_in"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    within = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "_row")) - 1
    return salted.withColumn("_within", within).join(sums, ["length", "_bucket"]).withColumn("rank", F.col("_before") + F.col("_within")).drop("_bucket", "_within", "_before")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, _row and more; read more than once, so stage them first)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < k <= capacity for k in histogram):
        raise ValueError("pieces must have 1 to `capacity` tokens")
    ranked = numbered(pieces, histogram)
    rows = np.array(sorted(plan(histogram, capacity)) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast((rows[:, 0] << 44 | rows[:, 1], rows[:, 1:]))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        starts, found = shared.value
        length, rank = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (length, rank))
        first, sequence, each, offset = found[np.searchsorted(starts, length << 44 | rank, "right") - 1].T
        turn = rank - first
        return pa.StructArray.from_arrays([pa.array(sequence + turn // each), pa.array(offset + turn % each * length)], ["sequence_id", "offset"])

    return ranked.withColumn("_place", place("length", "rank")).select("*", "_place.sequence_id", "_place.offset").drop("_place", "rank")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenize, cut and pack documents (doc_id, text): one row per piece, with the crc32 of its ids and the md5 of its text, by which `sequences` finds its ids."""
    own = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    cut = token_pieces(own, tokenizer_path, capacity, end_id).select("doc_id", "_row", _digest().alias("text_md5"), F.explode_outer("pieces").alias("p"))  # an inner explode would run the tokenizer twice, once to drop empty arrays
    slim = staged(cut.select("doc_id", "_row", "text_md5", "p.piece", "p.start", "p.length", F.crc32("p.ids").alias("ids_crc32")))
    return pack(slim, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "text_md5")


def _digest() -> Column:
    return F.md5(text_or_empty().cast("binary"))


def sequences(packed: DataFrame, docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The packed sequences' ids (sequence_id, ids), whatever documents' ids are: tokenizes each distinct text again, joins its pieces to all places of that text and puts each sequence's pieces, capacity tokens at most, side by side."""
    texts = docs.select(text_or_empty().alias("text")).withColumn("text_md5", _digest()).dropDuplicates(["text_md5"])
    cut = token_pieces(texts.withColumn("doc_id", F.lit(0)), tokenizer_path, capacity, end_id).select("text_md5", F.explode_outer("pieces").alias("p")).select("text_md5", "p.piece", "p.ids")
    parts = packed.select("text_md5", "piece", "sequence_id", "offset").join(cut, ["text_md5", "piece"])
    joined = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return joined.select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("text_md5")
