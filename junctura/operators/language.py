"""Smoothed bigram models over residues, with segment-conditioned and length variants."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.fixed import ADD_K, CONDITIONED_SHARE, LENGTH_SLOTS, PAIR_FLOOR, RESIDUES
from junctura.functions.sequence import col, transitions
from junctura.session import stage

# Outcomes of a step: a residue or the end.
VOCABULARY = len(RESIDUES) + 1
# Transition codes are pairs of a letter number, or 0 for a boundary.
LETTERS = 27


def transition_counts(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of every transition code by model key: at most 441 rows per key, as there are
    twenty residues and the boundary."""
    return (
        df.select(*keys, F.explode(transitions(text)).alias("code"))
        .groupBy(*keys, "code")
        .agg(F.count("*").alias("n"))
    )


def bigram_counts(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """The same with tokens spelled out, and the total of the previous token."""

    def token(code: Column, boundary: str) -> Column:
        return F.when(code == 0, boundary).otherwise(F.chr(code + 64))

    counts = stage(transition_counts(df, text, keys)).select(
        *keys,
        token(F.floor(F.col("code") / LETTERS).cast("int"), "^").alias("prev"),
        token(F.col("code") % LETTERS, "$").alias("next"),
        "n",
    )
    totals = counts.groupBy(*keys, "prev").agg(F.sum("n").alias("total"))
    return counts.join(totals, [*keys, "prev"])


def fit_bigrams(df: DataFrame, text: str, keys: Sequence[str] = (), add_k: float = ADD_K) -> DataFrame:
    """One row per model key: training sequences, and log-probabilities by transition code."""
    letters = F.sequence(F.lit(0), F.lit(LETTERS - 1))
    counts = transition_counts(df, text, keys).select(
        *keys,
        F.floor(F.col("code") / LETTERS).cast("int").alias("prev"),
        (F.col("code") % LETTERS).alias("next"),
        "n",
    )

    def step(at: Column) -> Column:
        n = F.coalesce(F.try_element_at("m", at), F.lit(0))
        return F.log((n + add_k) / (F.col("total") + add_k * VOCABULARY))

    # At most 21 outcomes per previous token, then at most 21 previous tokens per model.
    by_prev = (
        counts.groupBy(*keys, "prev")
        .agg(F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("m"), F.sum("n").alias("total"))
        .select(*keys, "prev", "total", F.transform(letters, step).alias("row"))
    )
    unseen = F.array_repeat(F.lit(-math.log(VOCABULARY)), LETTERS)
    by_model = by_prev.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("prev", "row"))).alias("m"),
        F.max(F.when(F.col("prev") == 0, F.col("total"))).alias("sequences"),
    )
    rows = F.transform(letters, lambda at: F.coalesce(F.try_element_at("m", at), unseen))
    return by_model.select(*keys, "sequences", F.flatten(rows).alias("logp"))


def bigram_logprob(codes: str | Column, logp: str | Column) -> Column:
    """Log-probability of a sequence, given its transitions, under the model in ``logp``.

    Without a model every step is one of the equally likely outcomes.
    """
    untrained = F.lit(-math.log(VOCABULARY))
    return F.when(
        col(logp).isNotNull(),
        F.aggregate(codes, F.lit(0.0), lambda total, code: total + F.get(col(logp), code)),
    ).otherwise(F.size(codes) * untrained)


def mixture(conditioned: Column, pooled: Column, sequences: Column, share: float = CONDITIONED_SHARE,
            floor: int = PAIR_FLOOR) -> Column:
    """Log of the weighted mix of two sequence probabilities; pooled alone for rare pairs."""
    a, b = conditioned + F.log(F.lit(share)), pooled + F.log(F.lit(1 - share))
    top = F.greatest(a, b)
    mixed = top + F.log(F.exp(a - top) + F.exp(b - top))
    return F.when(F.coalesce(sequences, F.lit(0)) >= floor, mixed).otherwise(pooled)


def fit_lengths(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sequences by length, with the total of the model key."""
    counts = df.groupBy(*keys, F.length(text).alias("length")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    if keys:
        return counts.join(totals, list(keys))
    return counts.withColumn("total", totals.scalar())


def length_logprob(n: Column, total: Column) -> Column:
    return F.log((F.coalesce(n, F.lit(0)) + ADD_K) / (F.coalesce(total, F.lit(0)) + ADD_K * LENGTH_SLOTS))


def score_models(
    train: DataFrame,
    rows: DataFrame,
    text: str,
    labels: dict[str, tuple[str, str]],
    keys: Sequence[str] = (),
    train_text: str | None = None,
) -> DataFrame:
    """Add ``flat`` and one conditioned score per entry of ``labels`` (name to its two columns).

    ``keys`` name independent experiments: each has its own models. The written model tables
    hold 729 numbers per key, and their size decides between broadcast and shuffle.
    """
    train_text = train_text or text
    keys = list(keys)
    # One pass fits every model: a training row counts once for the pooled model and once for
    # each label pair.
    nothing = F.lit("")
    sets = [("flat", nothing, nothing)] + [(n, F.col(a), F.col(b)) for n, (a, b) in labels.items()]
    members = F.array(
        *[F.struct(F.lit(n).alias("_m"), a.alias("_a"), b.alias("_b")) for n, a, b in sets]
    )
    fitted = stage(
        fit_bigrams(
            train.select(*keys, train_text, F.explode(members).alias("_s")).select(*keys, train_text, "_s.*"),
            train_text,
            [*keys, "_m", "_a", "_b"],
        )
    )
    pooled = fitted.filter("_m = 'flat'").select(*keys, F.col("logp").alias("_pool"))
    coded = rows.withColumn("_codes", transitions(text))
    scored = coded.join(pooled, keys, "left") if keys else coded.withColumn("_pool", pooled.scalar())
    scored = scored.withColumn("flat", bigram_logprob("_codes", "_pool")).drop("_pool")
    for name, (first, second) in labels.items():
        model = fitted.filter(F.col("_m") == name).drop("_m")
        scored = (
            scored.withColumn("_a", F.col(first))
            .withColumn("_b", F.col(second))
            .join(model, [*keys, "_a", "_b"], "left")
            .withColumn("_own", bigram_logprob("_codes", "logp"))
            .withColumn(name, mixture(F.col("_own"), F.col("flat"), F.col("sequences")))
            .drop("_a", "_b", "logp", "sequences", "_own")
        )
    return scored.drop("_codes")
