"""Quality rules with a learned decision list (operator 8), in DataFrame functions alone.

Statistics of each text are computed in place by array functions; nothing is
shuffled for them. Labelled rows (a bounded sample, the parameter `most`) then
teach a decision list by sequential covering: rules are conjunctions of
thresholds, grown condition by condition on two thirds of the rows by
information gain, pruned on the rest, and accepted if they are precise there;
what a rule covers is set aside before the next one. The list becomes one
ordered Spark conditional.

Defined cases: null or empty text has no words; texts without words fail the base
rule; very long texts are read whole; no labels, or labels of one kind, teach no
rules, and then the base rule decides alone; an id with several labels is bad if
one of them is; repeated rows are judged each on its own; a value equal to a
threshold meets it; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import SPACE_REGEX, WORD_REGEX, hash_firsts, staged, table, text_or_empty

WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body names it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more in the text, the first included."""
    none = F.lit(0).cast("long")

    def windows(h: Column) -> Column:
        key = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        places = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.sort_array(F.transform(places, lambda i: F.struct(key(i).alias("h"), i.alias("p"))))

    def twice(s: Column) -> Column:
        beside = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.sort_array(F.array_compact(F.transform(s, lambda x, i: F.when(beside(x, i), x["p"]))))

    start = F.struct(none.alias("n"), F.lit(-WINDOW).alias("last"))
    covered = lambda starts: F.aggregate(starts, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda s: covered(twice(s))))
    return F.when(F.size(words) > WINDOW, counted).otherwise(none)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base statistics and the further ones that rules may use."""
    whole = text_or_empty(text)
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD_REGEX))
    df = df.withColumn("_text", whole).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD_REGEX), F.lit(0)))
    return df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.length("_text") - count(SPACE_REGEX)).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        "n_capitals": count("[A-Z]"),
        "n_marks": count("[!?]"),
        "n_lines": F.size(lines).cast("long"),
        "n_equal": let(F.col("_words"), lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1)))).cast("long"),
    }).drop("_text", "_words")


#: What thresholds apply to, as shares where lengths differ.
FEATURES: dict[str, str] = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "equal_share": "n_equal / greatest(n_words, 1)",
}

Condition = tuple[str, str, float]


def holds(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, sign, value in rule:
        out &= x[name] >= value if sign == ">=" else x[name] <= value
    return out


def grown(x: dict[str, np.ndarray], bad: np.ndarray, at: np.ndarray, cuts: dict[str, np.ndarray], most_conditions: int, support: int) -> list[Condition]:
    """One rule, grown on the rows `at` condition by condition, by information gain."""
    rule: list[Condition] = []
    while len(rule) < most_conditions and (bad & at).sum() >= support and (at & ~bad).any():
        p, q = (bad & at).sum(), (~bad & at).sum()
        base, gain, best = np.log2(p / (p + q)), 0.0, None
        for name, values in x.items():
            own, ill = values[at], bad[at]
            for cut in cuts[name]:
                for sign, hit in ((">=", own >= cut), ("<=", own <= cut)):
                    good, wrong = (hit & ill).sum(), (hit & ~ill).sum()
                    more = good * (np.log2(good / (good + wrong)) - base) if good >= support else 0.0
                    if more > gain + 1e-9:
                        gain, best = more, (name, sign, float(cut))
        if best is None:
            break
        rule.append(best)
        at = at & holds([best], x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.85, support: int = 5) -> list[list[Condition]]:
    """Rules for bad rows, in order.

    For each rule every third of the rows (by position) prunes in turn what the
    others grew: the conditions at the end go if the third is covered more
    precisely without them. Precision is smoothed, (p + 1) / (p + q + 2), so that a
    few rows say little. Of the three the rule that covers most bad rows is taken,
    each good row weighing as many as `precision` allows, if it is precise on its
    own third and on all rows left.
    """
    n = len(bad)
    third, left, rules = np.arange(n) % 3, np.ones(n, bool), []
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, 65))) for k, v in x.items()} if n else {}

    def counts(r: list[Condition], at: np.ndarray) -> tuple[int, int]:
        hit = at & holds(r, x)
        return int((hit & bad).sum()), int((hit & ~bad).sum())

    def smoothed(r: list[Condition], at: np.ndarray) -> float:
        p, q = counts(r, at)
        return (p + 1) / (p + q + 2)

    while len(rules) < most_rules:
        found = []
        for k in range(3):
            held = left & (third == k)
            rule = grown(x, bad, left & (third != k), cuts, most_conditions, max(2, support * 2 // 3))
            if rule:
                rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=lambda r: smoothed(r, held))
                (p, q), (own, wrong) = counts(rule, left), counts(rule, held)
                if p >= support and smoothed(rule, left) >= precision and own and own >= precision * (own + wrong):
                    found.append((p - q / (1 - precision), rule))
        if not found:
            break
        rules.append(max(found, key=lambda f: f[0])[1])
        left &= ~holds(rules[-1], x)
    return rules


def learn_rules(stats: DataFrame, labels: DataFrame, most: int = 20_000) -> list[list[Condition]]:
    """A decision list from labels (doc_id, quality; 0 is bad) and a sample of at most `most` labelled rows, in an order by hash of the id."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = hash_firsts(known, ["doc_id"], most)
    rows = stats.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", *[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()]).orderBy(F.xxhash64("doc_id"), *FEATURES).limit(most).collect()
    x = {k: np.array([r[k] for r in rows], float) for k in FEATURES}
    return learn(x, np.array([r["quality"] == 0 for r in rows], bool))


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1, else 0, as one ordered conditional."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, sign, value in rule:
            own = F.expr(FEATURES[name]).cast("double")
            test = test & (own >= value if sign == ">=" else own <= value)
        out = F.when(test, k) if out is None else out.when(test, k)
    return out.otherwise(0) if out is not None else F.lit(0)


def judge(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """docs' ids with statistics, base_failed, rule (0: none) and kept."""
    stats = staged(statistics(docs.select("doc_id", "text")).drop("text"))
    rules = learn_rules(stats, labels, most)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op8_learned_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*names)
