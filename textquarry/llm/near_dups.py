"""MinHash near-duplicates with odd sketches (operator 7).

A document is its set of distinct word shingles. MinHash values in bands propose
candidates; each document's MinHash samples (one for each bin of hashes) are folded
into an odd sketch, a bitmap in which every sample flips one bit. The population
count of two sketches' exclusive or says how many samples differ, and with the
bitmaps of filled bins how many there are. Candidates whose sizes can't reach the
threshold, or whose estimate is five standard deviations below it, are dropped;
all others are confirmed on the full sets. Bands are many enough that a pair at the
threshold is missed less than once in a million.

Equal sets are one class from the start. A band's bucket is led by the member that
meets most others. Each member is compared with one of its leaders, and if it is
still apart with one of another component; so a large group of near copies costs two
comparisons a member. Buckets that hold several components then are compared in all
pairs if they are small (SMALL members), else by differences from a leader:

* x and y differ in |Dx| + |Dy| - 2 |Dx and Dy| shingles, Dx being what x differs in
  from the leader. So a link needs an overlap of Dx and Dy, of one shingle at least
  unless both are linked with the leader, as else y would be as near to the leader.
* With the rarest differences first, the overlap must begin within a prefix of each
  (prefix and position filter), and only pairs that share a shingle there meet.

Overlaps are of full sets, so those links are exact. This leaves out no link,
whatever the size of a bucket, and never pairs all members of a large one.

Defined cases: null text and text without words have an empty set and are linked
with nothing; fewer words than a shingle make one shingle; a document's rows with
one id are one node, linked by any of its texts; rows without an id are linked with
nothing and kept; very long texts are taken whole; an empty table gives no rows;
other columns are not used. Ids are of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textquarry.llm.common import few, slices, staged, table, text_or_empty
from textquarry.llm.components import components
from textquarry.llm.shingles import Shingles, mixed

ROWS, BANDS = 6, 46
SAMPLES = ROWS * BANDS
#: Bins of the odd sketch's MinHash samples, its bits, and both in words of 64 bits.
BINS, BITS = 2048, 4096
PARITY, FILLED = BITS // 64, BINS // 64
#: Buckets with so many members are compared in all pairs at last.
SMALL = 6
#: Members of one leader that are confirmed in one task.
TOGETHER = 256


class Signer:
    def __init__(self, shingle: int):
        draw = np.random.Generator(np.random.PCG64(7))
        self.cut = Shingles(shingle, lower=True)
        self.multiply = draw.integers(1, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = draw.integers(0, 1 << 63, SAMPLES, np.uint64)
        self.band = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(20))

    def odd_sketch(self, hashes: np.ndarray) -> np.ndarray:
        """Parity bits of the bins' least hashes, then the bitmap of bins that have one."""
        drawn = np.sort(mixed(hashes ^ np.uint64(0x5BD1E995)))
        bins = (drawn >> np.uint64(53)).astype(np.int64)
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        parity = np.bincount((mixed(drawn[first]) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
        filled = np.bincount(bins[first], minlength=BINS)
        return np.packbits(np.concatenate([parity, filled]).astype(np.uint8)).view("<i8")

    def __call__(self, text: str) -> tuple[int, bytes | None, list[int], list[int]]:
        hashes = self.cut(text)
        if not len(hashes):
            return 0, None, [], []
        least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(hashes), 256):
            np.minimum(least, (hashes[k : k + 256, None] * self.multiply + self.add).min(0), out=least)
        least >>= np.uint64(16)
        keys = self.band.copy()
        for row in least.reshape(BANDS, ROWS).T:
            keys = mixed(keys * np.uint64(31) + row)
        return len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), keys.view(np.int64).tolist(), self.odd_sketch(hashes).tolist()


SIGNED = "struct<n_shingles:bigint,digest:binary,bands:array<bigint>,sketch:array<bigint>>"


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    kind = pa.struct([("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        signer = Signer(shingle)
        for batch in slices(batches):
            yield pa.array([dict(zip(("n_shingles", "digest", "bands", "sketch"), signer(x), strict=True)) for x in batch.to_pylist()], kind)

    return docs.select("doc_id", F.arrow_udf(sign, SIGNED)(text_or_empty()).alias("_s")).select("doc_id", "_s.*")


def likely(one: Column, two: Column, sizes: Column, threshold: float, sigmas: float = 5.0) -> Column:
    """Whether two sketches allow a similarity at the threshold; sizes is the sum of the sets' sizes.

    Samples are the bins that either set fills; those that agree are half of what
    both sketches hold less the samples that differ. The margin is for drawing
    samples (none if each shingle has a bin of its own) and for bits that fall together.
    """
    zero, count = F.lit(0), lambda x, y: x + F.bit_count(y)
    differ = F.aggregate(F.zip_with(F.slice(one, 1, PARITY), F.slice(two, 1, PARITY), lambda x, y: x.bitwiseXOR(y)), zero, count)
    held = F.aggregate(F.concat(F.slice(one, PARITY + 1, FILLED), F.slice(two, PARITY + 1, FILLED)), zero, count)
    either = F.aggregate(F.zip_with(F.slice(one, PARITY + 1, FILLED), F.slice(two, PARITY + 1, FILLED), lambda x, y: x.bitwiseOR(y)), zero, count)

    def test(x: Column) -> Column:
        p, n, s = x["p"].cast("double"), x["n"].cast("double"), x["s"].cast("double")
        most = s - 2 * threshold * n  # samples that differ at the threshold
        flipped = BITS / 2 * (1 - F.exp(-2 * most / BITS))
        drawn = n * threshold * (1 - threshold) * 4 * F.greatest(F.lit(0.0), 1 - n * (1 + threshold) / sizes)
        fallen = BITS / 4 * (1 - F.exp(-4 * most / BITS)) - most * F.exp(-4 * most / BITS)
        return p <= flipped + sigmas * F.sqrt(drawn + F.greatest(F.lit(0.0), fallen) + 0.5)

    return F.element_at(F.transform(F.array(F.struct(differ.alias("p"), either.alias("n"), held.alias("s"))), test), 1)


def with_leaders(pairs: DataFrame, texts: DataFrame, shingle: int, schema: str, say: Callable) -> DataFrame:
    """Rows that say(a, set of a, b, set of b) yields for pairs (a, b), or none.

    A leader's text (a) is sent once for up to about TOGETHER members (b); members stream by.
    """
    heavy = staged(pairs.groupBy("a").agg(F.count("*").alias("_n")).filter(F.col("_n") > TOGETHER))
    salt = F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("_n") / TOGETHER), F.lit(1)))
    dealt = staged(pairs.select("a", "b").join(few(heavy, 100_000), "a", "left").select("a", "b", salt.alias("salt")))
    wanted = dealt.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct().unionByName(dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("doc_id")))
    rows = wanted.join(texts, "doc_id").repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "doc_id")
    named = texts.schema["doc_id"].dataType  # of a and b; the other columns are numbers
    kind = pa.schema([(x.split()[0], to_arrow_type(named) if x.split()[0] in ("a", "b") else pa.list_(pa.int64()) if "array" in x else pa.int64()) for x in schema.split(", ")])
    schema = ", ".join(f"{x.split()[0]} {named.simpleString()}" if x.split()[0] in ("a", "b") else x for x in schema.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, group, sets = Shingles(shingle, lower=True), None, []
        for batch in slices(batches):
            found = []
            for a, salt, role, doc_id, text in zip(*(batch.column(x).to_pylist() for x in ("a", "salt", "role", "doc_id", "text")), strict=True):
                if group != (a, salt):
                    group, sets = (a, salt), []
                own = cut(text)
                if not role:
                    sets.append(own)
                elif len(own):
                    found += [row for other in sets if len(other) and (row := say(a, other, doc_id, own))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kind.types, strict=True)], schema=kind)

    return rows.select("a", "salt", "role", "doc_id", "text").mapInArrow(run, schema)


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those with 100 * intersection >= percent * union, on full sets."""

    def say(a: int, one: np.ndarray, b: int, two: np.ndarray) -> tuple | None:
        least, most = sorted((len(one), len(two)))
        if 100 * least < percent * most:
            return None
        both = len(np.intersect1d(one, two, assume_unique=True))
        return (a, b) if 100 * both >= percent * (least + most - both) else None

    return with_leaders(pairs, texts, shingle, "a bigint, b bigint", say).distinct()


def differences(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """For pairs (a, b) the sizes and the shingles that one of both has; ref and own tell several texts of one id apart."""

    def say(a: int, one: np.ndarray, b: int, two: np.ndarray) -> tuple:
        ref, own = (xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in (one, two))
        return a, ref, len(one), b, own, len(two), np.setxor1d(one, two, assume_unique=True).view(np.int64)

    return with_leaders(pairs, texts, shingle, "a bigint, ref bigint, n_ref bigint, b bigint, own bigint, n bigint, d array<bigint>", say)


def overlapping(differ: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members with different labels, from their differences from one leader each.

    With p in percent, m differences of n shingles and f = (100 + p) m - (100 - p) n, x
    and y are linked if 2 (100 + p) overlap >= f(x) + f(y), and never without overlap,
    as their labels differ. The side with less f can count on 2 f of its own; the
    other on what the sizes leave: a set in reach has at most 100 n / p shingles, so
    its f is at least f - 2 (100 - p) 100 n / p.
    """
    up, down = 100 + percent, 100 - percent
    who = ["a", "ref", "b", "own", "n", "m"]
    one = differ.select(*who[:-1], F.size("d").alias("m"), F.explode("d").alias("token"))
    often = one.groupBy("a", "ref", "token").agg(F.count("*").alias("df")).filter("df > 1")
    listed = one.join(often, ["a", "ref", "token"]).groupBy(*who).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    f = up * F.col("m") - down * F.col("n")
    least = F.greatest(F.lit(1), F.ceil(f / up - 1e-6))
    least_far = F.greatest(F.lit(1), F.ceil((f - down * 100 * F.col("n") / percent) / up - 1e-6))
    listed = listed.withColumns({"f": f, "_near": F.col("m") - least + 1, "_far": F.col("m") - least_far + 1})
    listed = listed.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    listed = staged(listed.select("a", "ref", "b", "own", "n", "m", "f", "label", "_near", "_far", F.transform("t", lambda x: x["token"]).alias("tokens")))
    placed = listed.select("a", "ref", "b", "own", "n", "m", "f", "label", "_near", "_far", F.posexplode("tokens").alias("_k", "token"), F.size("tokens").alias("_size"))
    placed = placed.withColumn("place", F.col("m") - F.col("_size") + F.col("_k") + 1).drop("_k", "_size")
    x = placed.filter("place <= _near").select("a", "ref", "token", *[F.col(c).alias(f"_{c}") for c in ("b", "own", "n", "m", "f", "label", "place")])
    y = placed.filter("place <= _far").drop("_near", "_far")
    first = (F.col("_f") < F.col("f")) | ((F.col("_f") == F.col("f")) & (F.col("_b") < F.col("b")))
    sizes = (100 * F.col("_n") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("_n"))
    room = 2 * up * F.least(F.col("_m") - F.col("_place") + 1, F.col("m") - F.col("place") + 1) >= F.col("_f") + F.col("f")
    met = x.join(y, ["a", "ref", "token"]).filter(first & (F.col("_label") != F.col("label")) & sizes & room)
    pairs = staged(met.select("a", "ref", "_b", "_own", "_f", "b", "own", "f").distinct())
    left = listed.select("a", "ref", F.col("b").alias("_b"), F.col("own").alias("_own"), F.col("tokens").alias("_t"))
    both = pairs.join(left, ["a", "ref", "_b", "_own"]).join(listed.select("a", "ref", "b", "own", "tokens"), ["a", "ref", "b", "own"])
    linked = both.filter(2 * up * F.size(F.array_intersect("_t", "tokens")) >= F.col("_f") + F.col("f"))
    return linked.select(F.least("b", "_b").alias("a"), F.greatest("b", "_b").alias("b")).distinct()


def linked(buckets: DataFrame, sketches: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Labels (node, label) of nodes with links, from buckets (key, rep, n_shingles)."""
    sums = buckets.groupBy("key").agg(F.count("*").alias("_in"))
    meets = staged(buckets.join(sums, "key").groupBy("rep").agg(F.sum("_in").alias("meets")))
    buckets = staged(buckets.join(few(meets), "rep"))
    order = F.struct((-F.col("meets")).alias("o"), F.col("rep").alias("rep"), F.col("n_shingles").alias("n"), F.col("label").alias("label"))
    one, two = sketches.select(F.col("rep").alias("a"), F.col("n_shingles").alias("_n"), F.col("sketch").alias("_s")), sketches.select(F.col("rep").alias("b"), "n_shingles", F.col("sketch").alias("_t"))
    seen = links = labels = None

    def apart(least: int) -> tuple[DataFrame, DataFrame]:
        """Members with labels, and buckets of at least so many members with two components or more, with their leaders."""
        at = buckets.withColumn("label", F.col("rep")) if labels is None else buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        heads = at.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count("*").alias("members"), F.min(order).alias("lead"))
        return at, staged(heads.filter((F.col("_lo") < F.col("_hi")) & (F.col("members") >= least)).drop("_lo", "_hi"))

    def unseen(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
        return pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")

    def compare(pairs: DataFrame) -> None:
        """Confirm new pairs (a, b), and bring links and labels up to date."""
        nonlocal seen, links, labels
        new = staged(unseen(pairs.select("a", "b")).distinct())
        hopeful = staged(new.join(one, "a").join(two, "b").filter(likely(F.col("_s"), F.col("_t"), F.col("_n") + F.col("n_shingles"), percent / 100)).select("a", "b"))
        often = staged(hopeful.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("_c")).filter("_c > 1"))
        leads = hopeful.join(few(often.select(F.col("node").alias("a"), F.col("_c").alias("_ca"))), "a", "left").join(few(often.select(F.col("node").alias("b"), F.col("_c").alias("_cb"))), "b", "left")
        turn = F.coalesce("_ca", F.lit(1)) >= F.coalesce("_cb", F.lit(1))
        got = confirm(leads.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("b")), texts, shingle, percent)
        links = staged(got if links is None else links.unionByName(got))
        seen = new if seen is None else seen.unionByName(new)
        labels = components(links)

    def best(rows: DataFrame) -> DataFrame:
        """Of rows (rep, label, n_shingles, lead) with a leader in reach, each member's pair with the leader that meets most."""
        near = (F.col("n_shingles") * 100 >= F.col("lead.n") * percent) & (F.col("lead.n") * 100 >= F.col("n_shingles") * percent)
        some = rows.filter(near & (F.col("label") != F.col("lead.label"))).select("rep", "lead", F.col("lead.rep").alias("a"), F.col("rep").alias("b"))
        return unseen(some).groupBy("rep").agg(F.min_by(F.struct("a", "b"), "lead").alias("p")).select("p.*")

    at, heads = apart(2)
    compare(best(at.join(heads, "key")))
    at, heads = apart(2)
    at = staged(at.join(heads, "key"))
    others = at.filter(F.col("label") != F.col("lead.label")).groupBy("key").agg(F.min(order).alias("_other"))
    compare(best(at.unionByName(at.join(others, "key").withColumn("lead", F.col("_other")).drop("_other"))))
    at, heads = apart(2)
    at = staged(at.join(heads, "key"))
    small = at.filter(F.col("members") <= SMALL)
    other = small.select("key", F.col("rep").alias("_a"), F.col("n_shingles").alias("_n"), F.col("label").alias("_label"))
    near = (F.col("n_shingles") * 100 >= F.col("_n") * percent) & (F.col("_n") * 100 >= F.col("n_shingles") * percent)
    compare(small.join(other, "key").filter((F.col("_a") < F.col("rep")) & (F.col("_label") != F.col("label")) & near).select(F.col("_a").alias("a"), F.col("rep").alias("b")))
    # one leader for as many large buckets as can be: of all leaders of all their members' buckets the one that meets most
    large = at.filter(F.col("members") > SMALL)
    own = large.groupBy("rep").agg(F.min("lead").alias("_own"))
    refs = staged(large.join(own, "rep").groupBy("key").agg(F.min("_own").alias("_ref")))
    differ = staged(differences(large.join(refs, "key").select(F.col("_ref.rep").alias("a"), F.col("rep").alias("b")).filter("a != b").distinct(), texts, shingle))
    reached = differ.filter((100 + percent) * F.size("d") <= (100 - percent) * (F.col("n") + F.col("n_ref"))).select("a", "b")
    if not reached.isEmpty():
        links = staged(links.unionByName(reached))
        labels = components(links)
    more = staged(overlapping(differ, labels, percent))
    return labels if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Each row's doc_id with n_shingles, component_id (the least id reachable by links) and kept (the least one itself)."""
    signed = staged(signatures(docs, shingle))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = staged(full.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    nodes = full.join(classes.select(F.col("digest").alias("_d"), F.col("rep").alias("doc_id")), "doc_id").filter("digest = _d").drop("_d", "digest").withColumnRenamed("doc_id", "rep")
    keyed = nodes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    # a bucket counts if it has two different nodes
    several = few(staged(keyed.groupBy("key").agg(F.min("rep").alias("_least"), F.max("rep").alias("_most")).filter("_least < _most").select("key")))
    buckets = staged(keyed.join(several, "key", "left_semi"))
    reps = few(staged(buckets.select("rep").distinct()))
    sketches = staged(nodes.select("rep", "n_shingles", "sketch").join(reps, "rep", "left_semi"))
    texts = staged(docs.select("doc_id", text_or_empty().alias("text")).join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"))
    labels = linked(buckets, sketches, texts, shingle, percent)
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("_component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


#: The same classes in DuckDB, from all pairs of documents that share a shingle.
NEAR_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
sized AS (SELECT sh.*, n FROM sh JOIN sizes USING (doc_id)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.seen = e.a),
least_of AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least_of USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
