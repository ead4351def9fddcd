"""Quality rules whose cutoffs are certified on labelled rows.

Every rule rejects a text when a measure exceeds a cutoff.  For each stratum and
rule a fixed grid of cutoffs is tested on the labelled good rows: with n good rows,
k of which the cutoff would reject, the hypothesis "the false rejection rate is at
least ``alpha`` / rules" is tested with its exact binomial tail P(Bin(n, a) <= k)
(the Clopper-Pearson bound in test form) at level ``delta`` / (strata * rules *
grid), Bonferroni's correction.  So with probability 1 - ``delta`` over the labels
no stratum loses more than ``alpha`` of its good texts, whichever cutoff is taken.
Among certified cutoffs the one that rejects most labelled bad rows, less
``GOOD_WEIGHT`` for each good one, is taken, the laxest of equals; with none certified the rule is off in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_RUN, cut, fresh, split_words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ALPHA = 0.02
DELTA = 0.05
#: Rejecting a labelled good row outweighs rejecting this many bad ones when a certified cutoff is taken.
GOOD_WEIGHT = 5
#: Rules: measure -> (numerator, denominator, grid of cutoffs, lax to strict).
RULES = {
    "symbols": ("n_symbols", "n_words", (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "shouts": ("n_shouts", "n_words", (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
    "repeats": ("n_repeat_words", "n_words", (0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02)),
}
#: Tables of cutoffs up to this many strata are broadcast; larger ones are joined by shuffle.
BROADCAST_STRATA = 50_000


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base measures of ``text``; NULL counts as the empty text.

    n_words, word_chars, n_symbols, n_shouts (exclamation marks), n_lines (lines with
    a word), n_dup_lines, n_repeat_words, all long, and base_failed.  All columns of
    ``docs`` stay; those with the names of measures are replaced.
    """
    work = ["words", "marks", "lines", "hashes", "grams", "sorted", "twice"]
    words, marks, lines, hashes, grams, in_order, twice = (fresh(docs, f"_{x}") for x in work)
    names = ["n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    own = [c for c in docs.columns if c not in names]
    value = F.coalesce(F.col(text), F.lit(""))
    # Every step below hands on as few arrays as it can: each is copied between steps.
    df = docs.select(
        *own,
        split_words(F.col(text), BLANK_RUN).alias(words),
        F.regexp_replace(value, "[^#*$%&|<>!]+", "").alias(marks),
        F.filter(F.split(value, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias(lines),
    )
    df = df.select(
        *own,
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(marks, "!+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(marks, "[^!]+", "")).cast("long").alias("n_shouts"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias(hashes),
    )
    counts = names[:6]
    df = df.select(*own, *counts, F.when(F.size(hashes) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
    )).alias(grams))
    # Equal hashes lie side by side once sorted; the places marked so, in order again,
    # cover min(gap, WINDOW) words each.  Only texts with a repeated window are sorted.
    df = df.select(*own, *counts, F.when(
        F.size(F.array_distinct(grams)) < F.size(grams),
        F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("at")))),
    ).alias(in_order))
    df = df.select(*own, *counts, F.sort_array(F.transform(
        F.filter(
            F.transform(in_order, lambda x, i: F.struct(
                x["at"].alias("at"),
                (F.coalesce(x["g"] == F.get(in_order, i - 1)["g"], F.lit(False))
                 | F.coalesce(x["g"] == F.get(in_order, i + 1)["g"], F.lit(False))).alias("twice"),
            )),
            lambda x: x["twice"],
        ),
        lambda x: x["at"],
    )).alias(twice))
    covered = F.aggregate(
        F.transform(twice, lambda at, i: F.least(F.coalesce(F.get(twice, i + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda acc, x: acc + x,
    )
    df = df.select(*own, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def measure(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.when(F.col(bottom) == 0, F.lit(0.0)).otherwise(F.col(top) / F.col(bottom))


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k) as a sum of terms in logarithms; 1 where k reaches the mean."""
    first = n * F.lit(math.log1p(-rate))
    odds = F.lit(math.log(rate) - math.log1p(-rate))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(acc["total"] - high) + F.exp(term - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.exp(F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc["total"]))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(tail)


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang",
        label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(stratum, one cutoff per rule)`` from labelled rows that pass the base rules.

    NULL labels, keys without a label and NULL strata give no evidence; a NULL cutoff
    switches the rule off.  A key labelled twice counts once, as bad if either says so.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_label"))
    rows = measured.where(~F.col("base_failed") & F.col(stratum).isNotNull()).select(
        key, F.col(stratum).alias("stratum"), *[measure(r).alias(r) for r in RULES]
    ).join(known, key)
    good, bad = F.col("_label") == 1, F.col("_label") == 0
    grid = [(r, i, c) for r in RULES for i, c in enumerate(RULES[r][2])]
    counts = rows.groupBy("stratum").agg(
        F.count_if(good).alias("n"),
        *[F.count_if(good & (F.col(r) > c)).alias(f"k_{r}_{i}") for r, i, c in grid],
        *[F.count_if(bad & (F.col(r) > c)).alias(f"b_{r}_{i}") for r, i, c in grid],
    )
    counts = counts.withColumn("strata", F.count("*").over(Window.partitionBy()))
    cells = counts.select("stratum", "n", "strata", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k_{r}_{i}").alias("k"), F.col(f"b_{r}_{i}").alias("bad"))
        for r, i, c in grid
    ])).alias("x")).select("stratum", "n", "strata", "x.*")
    certified = cells.where(
        binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= F.lit(delta) / (F.col("strata") * len(grid))
    )
    gain = F.col("bad") - GOOD_WEIGHT * F.col("k")
    best = certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain, "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``kept``: false where the base rules fail or a certified cutoff is exceeded."""
    if cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    exceeded = F.lit(False)
    for r in RULES:
        exceeded = exceeded | F.coalesce(measure(r) > F.col(f"cut_{r}"), F.lit(False))
    other = fresh(measured, "_stratum")
    joined = measured.drop("kept").join(cutoffs.withColumnRenamed("stratum", other), F.col(stratum) == F.col(other), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~exceeded).drop(other, *[f"cut_{r}" for r in RULES])


def quality_verdicts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """``key``, the measures and ``kept`` for every row; repeated rows and NULL keys stay as they are."""
    measured = cut(features(docs.select(key, text, stratum), text).drop(text))
    return judge(measured, cut(fit(measured, labels, key, stratum)), stratum)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names; repeated rows and NULL keys stay.

    Texts are measured once: rows and measures are written as a table, the cutoffs are
    fitted on its measures and its rows filtered.  NULL and empty texts fail the base rules.
    """
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(stratum).alias("stratum"))
    measured = cut(features(named, "text").drop("text"))
    known = labels.select(F.col(key).alias("key"), F.col("quality").alias("quality"))
    cutoffs = cut(fit(measured, known, "key", "stratum"))
    return judge(measured, cutoffs, "stratum").where("kept").select("row.*")
