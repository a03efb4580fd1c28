"""Quality classifier by ordinal cumulative-link regression (operator 6).

Grades: 0 for bad quality, 1 for good quality with toxic language, 2 for good.
One vector of hashed-text weights is shared by ordered thresholds: P(grade > k) =
sigmoid(score - threshold k). It is fitted by FTRL-proximal steps with an L1
penalty on a bounded sample of labelled rows (parameter `most`); all documents are
scored over their whole texts.

Features: each distinct word (case and outer signs dropped), and the text's
shares of symbols, capitals, exclamation marks, repeated words, neighbours that
are equal, and repeated lines, in steps.

Defined cases: null or empty text has the features of its length and shares alone;
very long texts are read whole; without labels of at least two grades every
document gets the top grade and is kept; an id with several labels has its lowest
grade; repeated rows and ties get equal scores; a tail probability equal to the
bound is accepted; an empty table gives no rows; other columns pass through, and
columns named like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.bpe import Kept
from textquarry.llm.common import hash_firsts, slices, table, text_or_empty

BITS = 18
GRADES = 3
STEPS = (0.0, 0.01, 0.03, 0.1, 0.2, 0.4, 0.7)
OUTER = ".,;:!?\"'()[]{}<>*#$%&|-_"
SYMBOLS, CAPITALS, MARKS = re.compile(r"[#*$%&|<>]"), re.compile("[A-Z]"), re.compile("[!?]")


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (1 << BITS) - 1


def word_bucket(word: str) -> int:
    return bucket(word.strip(OUTER).lower())


def split_features(text: str) -> tuple[set[str], list[str]]:
    """Distinct raw words, and the stepped shares."""
    words = text.split()
    distinct, n = set(words), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = {
        "symbols": len(SYMBOLS.findall(text)) / n,
        "capitals": len(CAPITALS.findall(text)) / max(1, len(text)),
        "marks": len(MARKS.findall(text)) / n,
        "repeats": 1 - len(distinct) / n,
        "equal": sum(map(str.__eq__, words, words[1:])) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    return distinct, [f"\0{k} {sum(v > s for s in STEPS)}" for k, v in shares.items()] + [f"\0length {min(12, n.bit_length())}"]


def buckets(text: str) -> list[int]:
    words, shares = split_features(text)
    return [*map(word_bucket, words), *map(bucket, shares)]


def fit(values: np.ndarray, offsets: np.ndarray, grades: np.ndarray, passes: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, least_rows: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds, from all rows' distinct features side by side (32-bit) and where each row begins."""
    size = 1 << BITS
    keep = (np.bincount(values, minlength=size) >= least_rows)[values]
    at_row = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[offsets]
    values = values[keep]
    z, n = np.zeros(size), np.zeros(size)
    share = [(np.mean(grades > k) * len(grades) + 1) / (len(grades) + 2) for k in range(GRADES - 1)]
    theta = -np.log(np.array(share) / (1 - np.array(share)))
    theta_n = np.ones(GRADES - 1)
    order = np.random.default_rng(11)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for k in order.permutation(len(grades)):
            at = values[at_row[k] : at_row[k + 1]]
            w = weights(at)
            tail = 1 / (1 + np.exp(-np.clip(w.sum() - theta, -30, 30)))  # P(grade > k)
            bounds = np.concatenate([[1.0], tail, [0.0]])
            slope = np.concatenate([[0.0], tail * (1 - tail), [0.0]])
            y = grades[k]
            p = max(bounds[y] - bounds[y + 1], 1e-9)
            g = -(slope[y] - slope[y + 1]) / p  # of the loss by the score
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
            n[at] = new
            for j, d in ((y - 1, slope[y] / p), (y, -slope[y + 1] / p)):
                if 0 <= j < GRADES - 1:
                    theta_n[j] += d * d
                    theta[j] -= 0.1 * d / theta_n[j] ** 0.5
            theta = np.maximum.accumulate(theta)
    return weights(np.arange(size)).astype(np.float32), theta


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on at most `most` labelled documents, taken in an order by hash of the id; of rows with one id the one whose text has the least digest."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    sample = hash_firsts(known, ["doc_id"], most)

    @F.arrow_udf("array<int>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Kept(word_bucket, 400_000)
        for batch in slices(batches):
            out = []
            for x in batch.to_pylist():
                own, shares = split_features(x)
                out.append(np.unique(np.array([*map(words.__getitem__, own), *map(bucket, shares)], np.int32)))
            yield pa.array(out, pa.list_(pa.int32()))

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", F.sha2(text_or_empty().cast("binary"), 256).alias("digest"), hashed(text_or_empty()).alias("x"))
    got = rows.groupBy("doc_id", "grade").agg(F.min_by("x", "digest").alias("x")).select("doc_id", "grade", "x").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return None
    lists = got["x"].chunk(0)
    grades, values, offsets = got["grade"].to_numpy().astype(np.int64), lists.values.to_numpy(), lists.offsets.to_numpy()
    del got
    model = fit(values, offsets, grades) if len(np.unique(grades)) > 1 else None
    del lists, values, offsets
    pa.default_memory_pool().release_unused()  # the driver keeps nothing of the rows
    return model


def classify(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, least_tail: float = 0.5, text: str = "text") -> DataFrame:
    """Add expected_grade, tail_probability (of the top grade) and accepted to docs."""
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(float(GRADES - 1)), "tail_probability": F.lit(1.0), "accepted": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, _ = shared.value
        values = weights.astype(float).tolist()
        words = Kept(lambda w: values[word_bucket(w)], 600_000)
        for batch in slices(batches):
            out = []
            for x in batch.to_pylist():
                own, shares = split_features(x)
                out.append(sum(map(words.__getitem__, own)) + sum(values[bucket(s)] for s in shares))
            yield pa.array(out, pa.float64())

    own = "_score" + "_" * max(map(len, docs.columns))  # a name that no column has
    tails = [1 / (1 + F.exp(F.lit(float(t)) - F.col(own))) for t in model[1]]
    return docs.withColumn(own, score(text_or_empty(text))).withColumns({"expected_grade": sum(tails[1:], tails[0]), "tail_probability": tails[-1], "accepted": tails[-1] >= least_tail}).drop(own)


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "expected_grade", "tail_probability", "accepted")
