"""Token counts by a finite-state tokenizer (operator 1).

A byte-level BPE tokenizer is compiled to a cascade of two deterministic
transducers. The first splits text into pretokens: nine states over eleven
character classes, whose transitions say where a pretoken begins. Text is cut
into chunks; each chunk's map from entry state to exit state is found for all
chunks at once, a parallel prefix scan composes the maps, and with each chunk's
entry state known the transitions' output is read off. The second transducer
(bpe.Transducer) runs over each pretoken's bytes and emits one token on each of
its transitions.

Defined cases: null or empty text has 0 tokens; repeated rows are counted each
on its own; very long texts are cut where white space follows other text (a
pretoken always begins there), so memory stays bounded; an empty table gives no
rows; other columns pass through, and a column named like an output is replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.bpe import Kept, Transducer
from textquarry.llm.common import ROUND_CHARS, once, slices, table, text_or_empty

# Character classes.
LETTER, ENDS, R_OR_V, L, E, DIGIT, SPACE, OTHER_SPACE, APOSTROPHE, OTHER, BREAK = range(11)
CLASSES = 11
# States: at a pretoken's begin; in letters, digits or other signs; after white space; after an apostrophe that began a pretoken, then with r or v, or l.
START, LETTERS, DIGITS, OTHERS, AFTER_SPACE, AFTER_OTHER_SPACE, QUOTE, QUOTE_RV, QUOTE_L = range(9)
STATES = 9
HERE, BEFORE = 1, 2  # output: a pretoken begins at this character, or at the one before it
CHUNK = 128


def _begin(c: int) -> int:
    """The state after a pretoken's first character."""
    if c <= E:
        return LETTERS
    return {DIGIT: DIGITS, SPACE: AFTER_SPACE, OTHER_SPACE: AFTER_OTHER_SPACE, APOSTROPHE: QUOTE, OTHER: OTHERS, BREAK: START}[c]


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for state * CLASSES + class."""
    to, out = np.zeros(STATES * CLASSES, np.uint8), np.zeros(STATES * CLASSES, np.uint8)
    for s in range(STATES):
        for c in range(CLASSES):
            nxt, o = _begin(c), HERE
            spaced = c in (SPACE, OTHER_SPACE)
            if c == BREAK:
                o = HERE | (BEFORE if s in (QUOTE_RV, QUOTE_L) else 0)
            elif s == LETTERS and c <= E or s == DIGITS and c == DIGIT:
                o = 0
            elif s == OTHERS and c in (OTHER, APOSTROPHE):
                nxt, o = OTHERS, 0
            elif s in (AFTER_SPACE, AFTER_OTHER_SPACE) and spaced:
                o = 0
            elif s == AFTER_SPACE:  # one space joins what follows
                nxt, o = (OTHERS if c == APOSTROPHE else nxt), BEFORE
            elif s == AFTER_OTHER_SPACE:
                o = HERE | BEFORE
            elif s == QUOTE:
                if c == ENDS:
                    nxt, o = START, 0
                elif c in (R_OR_V, L):
                    nxt, o = (QUOTE_L if c == L else QUOTE_RV), 0
                elif c in (OTHER, APOSTROPHE):
                    nxt, o = OTHERS, 0
            elif s in (QUOTE_RV, QUOTE_L):
                if s == QUOTE_RV and c == E or s == QUOTE_L and c == L:
                    nxt, o = START, 0
                elif c <= E:
                    nxt, o = LETTERS, BEFORE
                else:
                    o = HERE | BEFORE
            to[s * CLASSES + c], out[s * CLASSES + c] = nxt, o
    return to, out


TO, OUT = transitions()


def class_table() -> np.ndarray:
    """Class of each code point, by the Unicode properties that the split pattern names."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", OTHER_SPACE)):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    for signs, kind in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", ENDS), ("rv", R_OR_V), ("l", L), ("e", E)):
        for c in signs:
            kinds[ord(c)] = kind
    return kinds


def pretoken_starts(kinds: np.ndarray) -> np.ndarray:
    """Positions where a pretoken begins, from character classes, by chunk maps and a prefix scan."""
    n = len(kinds)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, BREAK, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, 1)
    for row in grid:
        maps = TO.take(maps * np.uint8(CLASSES) + row)
    step = 1  # inclusive scan: maps[:, i] becomes the map of all chunks up to i
    while step < chunks:
        late = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), 0)
        maps = np.concatenate([maps[:, :step], late], 1)
        step *= 2
    state = np.concatenate([[START], maps[START, :-1]]).astype(np.uint8)
    said = np.empty_like(grid)
    for row, told in zip(grid, said, strict=True):
        at = state * np.uint8(CLASSES) + row
        OUT.take(at, out=told)
        state = TO.take(at)
    said = said.T.reshape(-1)[:n]
    begins = (said & HERE).astype(bool)
    begins[:-1] |= (said[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins)


#: Cuts of very long texts: white space after other text always begins a pretoken.
CUT = re.compile(r"(?<=[A-Za-z0-9.,;])[ \n]")


def pieces_of(text: str, special: re.Pattern | None) -> tuple[list[str], int]:
    """Parts that are tokenized apart, and the number of special tokens between them."""
    parts = special.split(text) if special else [text]
    out = []
    for x in parts:
        at = 0
        while len(x) - at > ROUND_CHARS and (m := CUT.search(x, at + ROUND_CHARS)):
            out.append(x[at : m.start()])
            at = m.start()
        out.append(x[at:])
    return out, len(parts) - 1


class Counter:
    """Counts tokens of many texts; made once in a Python worker."""

    def __init__(self, spec: str, most_words: int = 500_000):
        declared = json.loads(spec)
        step = declared["pre_tokenizer"]
        if declared.get("normalizer") or step["type"] != "ByteLevel" or step["add_prefix_space"]:
            raise ValueError("this operator compiles byte-level BPE files without a normalizer")
        marks = [x["content"] for x in declared["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))) if marks else None
        self.kinds = class_table()
        transducer = Transducer(spec)
        self.words = Kept(lambda w: transducer.tokens(w.encode()), most_words)

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, x in enumerate(texts):
            own, extra[i] = pieces_of(x, self.special)
            parts += own
            owner += [i] * len(own)
        start = total = 0
        sums = []
        for k, x in enumerate(parts):
            total += len(x) + 1
            if total >= ROUND_CHARS or k == len(parts) - 1:
                sums.append(self._round(parts[start : k + 1]))
                start, total = k + 1, 0
        if sums:
            np.add.at(extra, np.array(owner), np.concatenate(sums))
        return extra

    def _round(self, parts: list[str]) -> np.ndarray:
        text = "\n".join(parts) + "\n"
        kinds = self.kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(x) + 1 for x in parts]) - 1
        kinds[ends] = BREAK
        starts = pretoken_starts(kinds)
        cuts = [*starts.tolist(), len(text)]
        words = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        counts = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        counts[np.searchsorted(starts, ends)] = 0  # the breaks themselves
        sums = np.concatenate([[0], np.cumsum(counts)])
        edges = np.searchsorted(starts, np.concatenate([[0], ends + 1]))
        return np.diff(sums[edges])


def tokenizer_text(path: str) -> str:
    """A tokenizer file, read on the driver; its size doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to each row of df."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = once(Counter, spec.value)
        for batch in slices(batches, made=True):
            yield pa.array(counter.count(batch.to_pylist()), pa.int64())

    whole = text_or_empty(text)
    return df.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": n_tokens(whole)}).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
