"""Index, frame, sampling, ledger, validation and statistics operators."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry.functions import scalars as S
from textquarry.sources.staging import staged

# --- frame and sampling -----------------------------------------------------------------------------------------------------------


def ai_candidates(index: DataFrame, name: str = "pkg_name") -> DataFrame:
    """Index rows with a signal in their package name; the signals are carried along."""
    return index.withColumn("signals", S.ai_signals(F.col(name))).filter(F.size("signals") > 0)


def dedup_by_package(index: DataFrame) -> DataFrame:
    """One row per package: the highest numeric version, then the latest date, then the greatest hash. Partial aggregates keep one row a package before the shuffle."""
    order = F.struct(S.version_numeric(F.col("vercode")), F.coalesce("dex_date", "added", F.lit("")), F.col("sha256"))
    rest = [c for c in index.columns if c != "pkg_name"]
    return index.groupBy("pkg_name").agg(F.max_by(F.struct(*rest), order).alias("r")).select("pkg_name", "r.*")


def largest_remainder(strata: DataFrame, target: int, keys: list[str]) -> DataFrame:
    """Allocation of `target` among strata (keys, size) in proportion to size, capped by it; leftovers go to the largest fractions, ties by key.

    One row per stratum is gathered, however many rows they have.
    """
    whole = W.partitionBy()
    total = F.sum("size").over(whole)
    wanted = F.least(F.lit(target), total)
    # whole numbers throughout: size * wanted = base * total + rest
    rows = strata.withColumns({"_total": total, "_wanted": wanted}).withColumn("_base", F.floor(F.expr("size * _wanted div _total"))).withColumn("_rest", F.expr("size * _wanted % _total"))
    left = F.col("_wanted") - F.sum("_base").over(whole)
    rank = F.row_number().over(W.orderBy(F.desc("_rest"), *keys))
    rows = rows.withColumns({"_left": left, "_rank": rank})
    return rows.select(*keys, "size", (F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("bigint")).alias("alloc"))


def hash_order(seed: str, key: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"), 256)


def first_of_each(rows: DataFrame, keys: list[str], limit: Column, order: list[Column], salts: int = 64) -> DataFrame:
    """The first rows of each group, as many as its limit says (a column of rows): first within salted parts of a group, then among what those leave, so that a group with most rows is no single task."""
    part = W.partitionBy(*keys, F.pmod(F.xxhash64(*order), F.lit(salts))).orderBy(*order)
    some = rows.withColumns({"_limit": limit, "_rank": F.row_number().over(part)}).filter("_rank <= _limit")
    return some.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank <= _limit").drop("_rank", "_limit")


def stratified_sample(rows: DataFrame, target: int, keys: list[str], key: str, seed: str = "1") -> DataFrame:
    """Exactly the allocated number of each stratum's rows, the first by a seeded hash of their key; independent of partitioning."""
    alloc = largest_remainder(rows.groupBy(*keys).agg(F.count("*").alias("size")), target, keys)
    return first_of_each(rows.join(alloc.select(*keys, "alloc"), keys), keys, F.col("alloc"), [hash_order(seed, key), F.col(key)]).drop("alloc")


def validation_sample(rows: DataFrame, flag: str, key: str, per_stratum: int, seed: str = "1") -> DataFrame:
    """At most per_stratum flagged and unflagged rows; is_short says that a pool had fewer."""
    sizes = rows.groupBy(flag).agg((F.count("*") < per_stratum).alias("is_short"))  # three rows at most
    return first_of_each(rows, [flag], F.lit(per_stratum), [hash_order(seed, key), F.col(key)]).join(F.broadcast(sizes.withColumnRenamed(flag, "_flag")), F.col(flag).eqNullSafe(F.col("_flag"))).drop("_flag")


def blind_order(rows: DataFrame, key: str, seed: str = "1") -> DataFrame:
    """A seeded shuffle that tells nothing of strata."""
    return rows.orderBy(hash_order(seed, key), key)


def ranked(rows: DataFrame, keys: list[str], key: str) -> DataFrame:
    """rows with `_rank`, their place from 0 in the order of keys and key: sorted by ranges, numbered by sums of the ranges' sizes before."""
    spots = staged(rows.orderBy(*keys, key).withColumn("_spot", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_spot", 33))
    sizes = spots.groupBy("_part").agg(F.count("*").alias("_size"))  # one row a range
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    return spots.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_spot").bitwiseAND((1 << 33) - 1)).drop("_spot", "_part", "_before")


def _at(rows: DataFrame, keys: list[str], key: str, places: list[int]) -> DataFrame:
    """The rows at places of their order; as many as are asked for."""
    wanted = rows.sparkSession.createDataFrame([(p,) for p in places], "_rank bigint")
    return ranked(rows, keys, key).join(F.broadcast(wanted), "_rank", "left_semi").drop("_rank")


def seeded_sample(rows: DataFrame, target: int, keys: list[str], key: str, seed: int) -> DataFrame:
    """The draw that random.Random(seed) makes, stratum after stratum in order, of each one's rows sorted by key.

    The generator needs sizes alone: it draws places, and rows are joined by their
    rank. Only one number a stratum and one a drawn row are on the driver.
    """
    strata = largest_remainder(rows.groupBy(*keys).agg(F.count("*").alias("size")), target, keys).orderBy(*keys).collect()
    generator, start, places = random.Random(seed), 0, []
    for stratum in strata:
        places += [start + k for k in generator.sample(range(stratum["size"]), stratum["alloc"])] if stratum["alloc"] else []
        start += stratum["size"]
    return _at(rows, keys, key, places)


def seeded_validation_sample(rows: DataFrame, flag: str, key: str, per_stratum: int, seed: int) -> DataFrame:
    """Flagged rows first, then the others, per_stratum of each by one seeded generator, or all of a smaller pool, which takes no draw; is_short says so."""
    pools = rows.withColumn("_pool", F.when(F.col(flag), 0).otherwise(1))
    sizes = {r["_pool"]: r["n"] for r in pools.groupBy("_pool").agg(F.count("*").alias("n")).collect()}
    generator, start, places = random.Random(seed), 0, []
    for pool in (0, 1):
        n = sizes.get(pool, 0)
        places += [start + k for k in (generator.sample(range(n), per_stratum) if n > per_stratum else range(n))]
        start += n
    short = F.col("_pool").isin([p for p in (0, 1) if sizes.get(p, 0) < per_stratum])
    return _at(pools, ["_pool"], key, places).withColumn("is_short", short).drop("_pool")


# --- ledger -----------------------------------------------------------------------------------------------------------------------

#: States of an application.
PENDING, DOWNLOADED, SCANNED, DOWNLOAD_FAILED, SCAN_FAILED = "pending", "downloaded", "scanned", "download_failed", "scan_failed"
MOST_ATTEMPTS = 3


def enroll(ledger: DataFrame, new: DataFrame, key: str = "sha256") -> DataFrame:
    """The new keys that the ledger lacks, once each, as pending."""
    return new.select(key).distinct().join(ledger.select(key), key, "left_anti").withColumns({"state": F.lit(PENDING), "attempts": F.lit(0).cast("bigint")})


def fold(events: DataFrame, key: str = "sha256") -> DataFrame:
    """Current state from an append-only log (key, at, seq, event): the last event's state; attempts count failures since the last reset.

    Both are aggregates with partial sums; only the few last resets are joined to the log.
    """
    at = F.struct("at", "seq")
    reset = events.filter("event = 'reset'").groupBy(key).agg(F.max(at).alias("_reset"))
    failed = F.col("event").isin(DOWNLOAD_FAILED, SCAN_FAILED)
    counted = failed & (F.col("_reset").isNull() | (at > F.col("_reset")))
    return events.join(reset, key, "left").groupBy(key).agg(F.max_by("event", at).alias("_last"), F.count_if(counted).alias("attempts")).select(key, F.when(F.col("_last").isin("reset", "enroll"), PENDING).otherwise(F.col("_last")).alias("state"), "attempts")


def pending(ledger: DataFrame, limit: int | None = None, key: str = "sha256", most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    out = ledger.filter((F.col("state") != SCANNED) & (F.col("attempts") < most_attempts)).orderBy(key)
    return out if limit is None else out.limit(limit)


def reset_events(ledger: DataFrame, at: Column, states: tuple[str, ...] = (DOWNLOAD_FAILED, SCAN_FAILED), key: str = "sha256") -> DataFrame:
    """Events that put the chosen states back to pending; none for an empty choice."""
    return ledger.filter(F.col("state").isin(*states) if states else F.lit(False)).select(key, at.alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit("reset").alias("event"))


def ledger_stats(scanned: DataFrame) -> DataFrame:
    return scanned.agg(F.count("*").alias("scanned"), F.coalesce(F.sum(F.col("llm_integrated").cast("bigint")), F.lit(0)).alias("integrated"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings")).withColumn("llm_rate", S.share(F.col("integrated"), F.col("scanned")))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by max_by with partial aggregates."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def retain_within(files: list[tuple[str, int]], budget: int, used: int = 0) -> list[str]:
    """Retention by budget: files in order, skipping those that would exceed it (a later smaller one may fit); a decision for each next file depends on all before, so it stays on the driver."""
    kept = []
    for name, size in files:
        if used + size <= budget:
            kept.append(name)
            used += size
    return kept


# --- validation and credentials ---------------------------------------------------------------------------------------------------


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Counts over rows with a truth, with precision, recall and F1 (0 without a denominator)."""
    p, a = F.col(predicted), F.col(actual)
    known = rows.filter(a.isNotNull())
    counts = known.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    out = counts.withColumns({"precision": S.share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": S.share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", S.share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def attach_dispositions(credentials: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Each credential (provider, fingerprint, ...) with its looked-up state; every distinct fingerprint is looked up once."""
    keys = credentials.select("provider", "fingerprint").distinct().join(dispositions, ["provider", "fingerprint"], "left")
    state = F.when(F.col("valid"), "live").when(~F.col("valid"), "revoked").otherwise("unknown")
    return credentials.join(keys, ["provider", "fingerprint"]).withColumn("state", state)


def to_disclose(outcomes: DataFrame) -> DataFrame:
    """All but those known to be invalid; unknown ones stay."""
    return outcomes.filter(~F.col("valid").eqNullSafe(F.lit(False)))


def credential_summary(outcomes: DataFrame, *by: str) -> DataFrame:
    counts = [F.count("*").alias("found"), *[F.count_if(F.col("state") == s).alias(s) for s in ("live", "revoked", "unknown")]]
    out = outcomes.groupBy(*by).agg(*counts) if by else outcomes.agg(*counts)
    return out.withColumn("live_rate", S.share(F.col("live"), F.col("live") + F.col("revoked")))


def reconcile(stores: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """How many keys each store lacks, and of those that all have on how many values they agree: one row."""
    rows = reduce(DataFrame.unionByName, [df.select(key, F.col(value).alias("_v"), F.lit(name).alias("_store")) for name, df in stores.items()])
    has = rows.groupBy(key).agg(*[F.bool_or(F.col("_store") == n).alias(f"_{n}") for n in stores], (F.min("_v").eqNullSafe(F.max("_v")) & (F.count("_v").isin(0, len(stores)))).alias("_same"))
    every = reduce(Column.__and__, [F.col(f"_{n}") for n in stores])
    return has.agg(*[F.count_if(~F.col(f"_{n}")).alias(f"missing_{n}") for n in stores], F.count_if(every & ~F.col("_same")).alias("different"), F.count_if(every & F.col("_same")).alias("same"))


# --- statistics -------------------------------------------------------------------------------------------------------------------


def category_stats(apps: DataFrame, flags: dict[str, Column], n: Column, on_empty: str = "zero") -> DataFrame:
    """Long form (category, successes, n, proportion, ci_lower, ci_upper) of boolean columns over the rows where n holds, in one pass over apps."""
    one = apps.agg(F.count_if(n).alias("n"), *[F.count_if(n & c).alias(f"_{k}") for k, c in enumerate(flags.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("category"), F.col(f"_{k}").alias("successes")) for k, name in enumerate(flags)]))
    return with_interval(one.select("n", rows.alias("r")).select("r.category", "r.successes", "n"), on_empty)


def with_interval(rows: DataFrame, on_empty: str = "zero") -> DataFrame:
    w = S.wilson(F.col("successes"), F.col("n"), on_empty=on_empty)
    return rows.withColumns({"proportion": S.share(F.col("successes"), F.col("n")), "_w": w}).select("*", F.col("_w.lower").alias("ci_lower"), F.col("_w.upper").alias("ci_upper")).drop("_w")


def by_provider(apps: DataFrame, secrets: DataFrame) -> DataFrame:
    """Of the applications in which a provider was detected, those with a secret of it. apps(app_id, providers), secrets(app_id, provider)."""
    pairs = apps.select("app_id", F.explode("providers").alias("provider")).distinct()
    hit = secrets.select("app_id", "provider").distinct().withColumn("hit", F.lit(True))
    return with_interval(pairs.join(hit, ["app_id", "provider"], "left").groupBy("provider").agg(F.count_if("hit").alias("successes"), F.count("*").alias("n")))


def by_provider_and_kind(apps: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """For each provider and kind: applications with the provider that have a finding of the kind, of any provider. One shuffle."""
    pairs = apps.select("app_id", F.explode("providers").alias("provider"), *[c.alias(k) for k, c in flags.items()])
    wide = pairs.groupBy("provider").agg(F.count("*").alias("n"), *[F.count_if(F.col(k)).alias(f"_{k}") for k in flags])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("successes")) for k in flags]))
    return with_interval(wide.select("provider", "n", rows.alias("r")).select("provider", "r.kind", "r.successes", "n"))


def widened(apps: DataFrame, confirmed: Column, providers: Column, ambiguous: str) -> DataFrame:
    """How a denominator changes if applications that are not confirmed, but have something attributed to a provider, count too: those with any provider, those whose only one is ambiguous, and the denominator with the former but for the latter."""
    hit = ~confirmed & (F.size(providers) > 0)
    only = hit & (providers == F.array(F.lit(ambiguous)))
    return apps.agg(F.count_if(hit).alias("attributed"), F.count_if(only).alias("one_only"), (F.count_if(confirmed) + F.count_if(hit) - F.count_if(only)).alias("denominator"))
