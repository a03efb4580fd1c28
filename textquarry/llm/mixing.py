"""Mixing sources to target weights (operator 3), in DataFrame functions alone.

Weighted fair queueing: each source's documents are shuffled by a hash of their
id; a document's virtual finish time is the source's cumulated size up to and
with it, divided by the source's target. Merging all documents by finish time
takes, by virtual time v, v times each target. A source that is to give more than
it has starts over (at most `repeats` times). A document in service at virtual
time 1 is two packets, cut there, so that no source is served a document too far;
the queue of all packets is sorted by finish time over all sources, summed up in
that order and truncated at the total budget.

Running sums come in two steps, of salted buckets of the shuffled order and within
them, so that a source with most rows is dealt out. Finish times are spread evenly
over virtual time by their making, so ranges of them need no sample: their sums
are cumulated in blocks of ranges, then in ranges, then in rows.

Whole documents in the queue's order (`sequenced`) are shuffled once: the queue's
rows, without texts, are sorted and dealt into ranges, and bounds of the sources'
orders tell each document which ranges its copies are in.

Defined cases: null text has size 0; null sources are a source, ordered last;
repeated rows are documents of their own, in a fixed order by id and content (ties
between rows alike in id and size may change places, which changes no sum);
packets with one finish time are ordered by source, then in their source's order;
very long texts are cut like any other; empty tables give no rows; other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry.llm.common import WORD_REGEX, few, staged, table, text_or_empty, whole

#: Rows of a salted bucket of one source, and buckets of one source at most.
BUCKET_ROWS, MOST_BUCKETS = 128, 1 << 20
#: The sources' totals are broadcast up to so many of them; beyond, they are joined by a shuffle, in which Spark splits skewed keys.
FEW_SOURCES = 10_000
#: Buckets of a cell, whose bounds documents are looked up in, cells that are broadcast at most, and rows of a range of the queue at least (if there is more than one).
CELL, FEW_CELLS, RANGE_ROWS = 16, 100_000, 1000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Each source's size, rows and target, from rows (source, size).

    share times all sizes is dealt by weight; targets stop at `repeats` times
    the source's size and the rest is dealt among the others again. At the end
    each target is min(repeats * size, level * weight), and the level follows
    from running sums over sources by size / weight. One row per source is
    gathered for this, however many documents there are.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    top, order = F.col("source_size") * float(repeats), F.col("source_size") * float(repeats) / F.col("weight")
    upto = W.orderBy("_order", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    whole = W.orderBy("_order", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    run = sums.withColumn("weight", weight).withColumn("_order", order)
    run = run.withColumn("_turn", F.row_number().over(W.orderBy("_order", F.col("source").asc_nulls_last())))
    run = run.withColumns({"_capped": F.sum(top).over(upto), "_lighter": F.sum("weight").over(upto), "_weights": F.sum("weight").over(whole), "_budget": F.sum("source_size").over(whole) * share})
    # with this source and all before it capped, the level of the rest
    run = run.withColumn("_level", F.when(F.col("_weights") > F.col("_lighter"), (F.col("_budget") - F.col("_capped")) / (F.col("_weights") - F.col("_lighter"))))
    first = F.first("_budget").over(whole) / F.first("_weights").over(whole)
    fits = F.lead("_order").over(W.orderBy("_order", F.col("source").asc_nulls_last())) >= F.col("_level")
    run = run.withColumns({"_fits": fits, "_none": F.min("_order").over(whole) >= first, "_start": first})
    level = F.when(F.col("_none"), F.col("_start")).otherwise(F.min(F.when(F.col("_fits"), F.struct("_turn", "_level"))).over(whole)["_level"])
    run = run.withColumn("_at", level)
    target = F.when(F.col("_at").isNull(), top).otherwise(F.least(top, F.col("_at") * F.col("weight")))
    return run.select("source", "source_size", "source_rows", target.alias("target"))


def words() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD_REGEX)).cast("long")


def turns(rows: DataFrame, marks: DataFrame, seed: int = 20240) -> DataFrame:
    """Add the columns of marks (source, source_rows), and _bucket and _at, the place in the source's shuffled order, to rows (doc_id, source)."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    shuffled = F.conv(F.substring(drawn, 1, 15), 16, 10).cast("bigint")
    buckets = F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("source_rows") / BUCKET_ROWS)).cast("long")
    rows = rows.join(marks, rows["source"].eqNullSafe(marks["source"])).drop(marks["source"])
    return rows.withColumn("_at", shuffled).withColumn("_bucket", F.pmod("_at", buckets))


def fair_queue(sized: DataFrame, targets: DataFrame, seed: int = 20240) -> DataFrame:
    """Add source_size, target, budget (the target in whole words) and _from (words of the source before the document, in shuffled order) to rows (doc_id, source, size, _row)."""
    queue = turns(sized, F.broadcast(targets) if targets.count() <= FEW_SOURCES else targets, seed)
    key = [F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("_bucket")]
    sums = queue.groupBy(key[0].alias("_s"), key[1].alias("_null"), key[2].alias("_b")).agg(F.sum("size").alias("_in"))
    before = W.partitionBy("_s", "_null").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    within = W.partitionBy("_s", "_null", "_b").orderBy("_at", "doc_id", "size", "_row").rowsBetween(W.unboundedPreceding, 0)
    queue = queue.withColumns({"_s": key[0], "_null": key[1], "_b": key[2]}).withColumn("_upto", F.sum("size").over(within))
    queue = queue.join(sums, ["_s", "_null", "_b"]).withColumn("_upto", F.col("_before") + F.col("_upto"))
    queue = queue.withColumns({"budget": F.round("target").cast("long"), "_from": F.col("_upto") - F.col("size")})
    return queue.drop("_s", "_null", "_b", "_bucket", "_at", "_upto", "_before", "source_rows")


def packets(queue: DataFrame, repeats: int = 2) -> DataFrame:
    """One row for each packet that begins before virtual time 1 or makes a document's first copy: copy, words, finish_time.

    _from is where the document begins in its source's first turn.
    """

    def both(copy: int) -> Column:
        start = F.col("_from") + F.col("source_size") * copy
        end = start + F.col("size")
        cut = F.when((start < F.col("budget")) & (F.col("budget") < end), F.col("budget")).otherwise(end)
        packet = lambda a, b: F.struct(F.lit(copy).alias("copy"), (b - a).alias("words"), F.when(F.col("budget") > 0, b / F.col("budget")).otherwise(F.lit(2.0)).alias("finish_time"))
        live = packet(start, cut)
        return F.array_compact(F.array(live if not copy else F.when(start < F.col("budget"), live), F.when(cut < end, packet(cut, end))))

    return queue.withColumn("_p", F.explode(F.flatten(F.array(*map(both, range(repeats)))))).select("*", "_p.*").drop("_p")


def truncated(rows: DataFrame, total: int, count: int) -> DataFrame:
    """Add taken, the words of each packet that are out when the queue, sorted by finish time, reaches the total budget."""
    blocks = min(1024, 1 + count // 65_536)
    ranges = blocks * max(1, min(1024, count // blocks // 256))
    # what finishes by virtual time 1 adds up to the budget; behind time 2 the order is of no account, so those rows are just spread
    late = F.lit(2 * ranges + 1) + F.pmod(F.xxhash64("_row", "copy"), F.lit(ranges))
    rows = staged(rows.withColumn("_range", F.when(F.col("finish_time") < 2, F.greatest(F.ceil(F.col("finish_time") * ranges), F.lit(1))).otherwise(late).cast("long")))
    sums = rows.groupBy("_range").agg(F.sum("words").alias("_in")).withColumn("_block", F.floor(F.col("_range") / (ranges // blocks)))
    whole = sums.groupBy("_block").agg(F.sum("_in").alias("_all")).withColumn("_past", F.coalesce(F.sum("_all").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_all")  # 3,073 blocks at most
    sums = sums.join(whole, "_block").withColumn("_before", F.col("_past") + F.coalesce(F.sum("_in").over(W.partitionBy("_block").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    order = W.partitionBy("_range").orderBy("finish_time", F.col("source").asc_nulls_last(), "_from", "copy", "doc_id", "_row").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("_before") + F.sum("words").over(order) - F.col("words")
    return rows.join(sums, "_range").withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), F.lit(total) - start)).cast("long")).drop("_range", "_before")


def numbered(docs: DataFrame) -> DataFrame:
    """Staged rows (_doc, doc_id, source, _row, _size): documents as structs, whose columns' names meet no others, with a number and the number of words."""
    return staged(docs.select(whole(docs).alias("_doc"), "doc_id", "source", F.monotonically_increasing_id().alias("_row"), words().alias("_size")))


def measured(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, keep: tuple[str, ...] = (), row: str | None = None, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, _row, source, size and the columns to keep) and the sources' targets of documents (doc_id, text, source), whose numbers and sizes are the columns `row` and `size`, if these are named."""
    own = F.monotonically_increasing_id() if row is None else F.col(row)
    sized = staged(docs.select("doc_id", "source", own.alias("_row"), *keep, (words() if size is None else F.col(size)).alias("size")))
    return sized, staged(source_targets(sized, weights, share))


def queued(sized: DataFrame, targets: DataFrame, seed: int = 20240) -> DataFrame:
    """The queue's packets of measured rows."""
    sums = targets.agg(F.coalesce(F.sum(F.round("target").cast("long")), F.lit(0)).alias("total"), F.coalesce(F.sum("source_rows"), F.lit(0)).alias("n")).first()
    return truncated(packets(fair_queue(sized, targets, seed)), int(sums["total"]), int(sums["n"]))


def served(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, seed: int = 20240, keep: tuple[str, ...] = ()) -> DataFrame:
    """The queue's packets (doc_id, _row, source, size, source_size, target, copy, words, finish_time, taken and the columns to keep) of documents (doc_id, text, source)."""
    return queued(*measured(docs, weights, share, keep), seed)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, seed: int = 20240, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mix documents (doc_id, text, source): one row per document with size, source_size, target, taken, finish_time (of the first copy) and the columns to keep."""
    same = ["_row", "doc_id", "source", "size", "source_size", "target", *keep]
    out = served(docs, weights, share, seed, keep).groupBy("_row").agg(*[F.first(c).alias(c) for c in same[1:]], F.sum("taken").alias("taken"), F.min("finish_time").alias("finish_time"))
    return out.drop("_row")


def stream(rows: DataFrame) -> DataFrame:
    """The mixed order of the queue's packets: those taken, globally range-sorted by virtual finish time."""
    return rows.filter("taken > 0").orderBy("finish_time", F.col("source").asc_nulls_last(), "_from", "copy", "doc_id", "_row")


def sequenced(docs: DataFrame, kept: DataFrame, targets: DataFrame, seed: int = 20240) -> DataFrame:
    """The documents of docs (as `numbered` gives them) as often as kept (_row, copy, doc_id, source, size, finish_time) has the row, in order of finish time.

    kept is sorted and dealt into ranges. In a source's order one copy's finish times
    rise, so a range holds a stretch of it; the stretches of a cell are a few bounds,
    and a document goes to the ranges whose bounds it is in. There it meets its rows
    of kept; where bounds held it but kept doesn't, it is dropped.
    """
    marks = few(targets.select("source", "source_rows"), FEW_CELLS)
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + kept.count() // RANGE_ROWS)
    cell = {"_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull(), "_cell": F.floor(F.col("_bucket") / CELL)}
    turn = F.struct("_bucket", "_at", "doc_id", "size", "_row")
    order = F.struct("finish_time", "_null", "_s", "_turn", "copy")  # ties by source, then in their source's order

    places = turns(kept, marks, seed).withColumns(cell).withColumn("_turn", turn).withColumn("_order", order)
    places = staged(places.select("_row", "copy", "size", *cell, "_turn", "_order").repartitionByRange(parts, "_order").withColumn("_range", F.spark_partition_id()))
    bounds = places.groupBy(*cell, "copy", "_range").agg(F.min("_turn").alias("_first"), F.max("_turn").alias("_last"), (F.max("size") > 0).alias("_words"))
    cells = staged(bounds.groupBy(*cell).agg(F.collect_list(F.struct("copy", "_range", "_first", "_last", "_words")).alias("_bounds")))

    rows = docs.select("_row", "doc_id", "source", F.col("_size").alias("size"), "_doc")
    rows = turns(rows, marks, seed).withColumns(cell).withColumn("_turn", turn).select("_row", "size", *cell, "_turn", "_doc")
    inside = F.filter("_bounds", lambda x: (x["_first"] <= F.col("_turn")) & (F.col("_turn") <= x["_last"]) & (x["_words"] | (F.col("size") == 0)))
    sent = rows.join(few(cells, FEW_CELLS), list(cell)).select("_row", "_doc", F.explode(inside).alias("_to")).select("_row", "_to.copy", "_to._range", "_doc")

    both = sent.unionByName(places.select("_row", "copy", "_range", "_order"), allowMissingColumns=True).repartitionById(parts, "_range")
    both = both.withColumn("_when", F.max("_order").over(W.partitionBy("_range", "_row", "copy")))
    return both.filter("_doc is not null and _when is not null").sortWithinPartitions("_when").select("_doc.*")


def op3_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in DuckDB.
MIX_SQL = r"""WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY 1),
r AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w FROM s),
o AS (SELECT *, source_size * 2::DOUBLE AS top, source_size * 2::DOUBLE / w AS ord FROM r),
c AS (SELECT *, sum(top) OVER u AS capped, sum(w) OVER u AS lighter, sum(w) OVER () AS weights, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
  row_number() OVER (ORDER BY ord, source NULLS LAST) AS turn, lead(ord) OVER (ORDER BY ord, source NULLS LAST) AS following FROM o WINDOW u AS (ORDER BY ord, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT *, CASE WHEN weights > lighter THEN (budget - capped) / (weights - lighter) END AS level FROM c),
pick AS (SELECT CASE WHEN min(ord) >= min(budget / weights) THEN min(budget / weights) ELSE arg_min(level, turn) FILTER (following >= level) END AS chosen FROM lv),
t AS (SELECT source, source_size, n, CASE WHEN chosen IS NULL THEN top ELSE least(top, chosen * w) END AS target FROM lv, pick),
h AS (SELECT d.doc_id, d.size, t.*, ('0x' || substr(sha256('20240:' || coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, round(target)::BIGINT AS budget, sum(size) OVER (PARTITION BY source ORDER BY draw % least(1048576, ceil(n / 128.0)::BIGINT), draw, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM h)
SELECT doc_id, size::BIGINT AS size, source_size, target, (greatest(0, least(size, budget - (upto - size))) + greatest(0, least(size, budget - source_size - (upto - size))))::BIGINT AS taken FROM q"""
