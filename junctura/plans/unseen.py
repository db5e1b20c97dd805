"""Binding to epitopes that training never saw, with the seen-epitope control beside it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.fixed import (
    CONTROL_PASS,
    CONTROL_SEEDS,
    EPITOPE_CAP,
    EPITOPE_CLASS_FLOOR,
    FOLDS,
    MEAN_PLACES,
    MEAN_RESAMPLES,
    SEED,
    SEEDS,
)
from junctura.functions.crossing import SIDES, codes
from junctura.functions.features import kmer_tokens, parsed_tokens, peptide_tokens, segment_tokens
from junctura.functions.sequence import digest
from junctura.operators.cleaning import CLONOTYPE
from junctura.operators.metrics import auc, over_seeds
from junctura.operators.models import sequential_fits
from junctura.operators.negatives import epitope_negatives
from junctura.operators.resampling import bootstrap_mean
from junctura.operators.splits import capped, folds, split_within
from junctura.session import stage

ARMS = ["kmer3", "morpheme", "vjonly"]
FIELDS = [*CLONOTYPE, "v_prefix", "n_region", "j_suffix"]


def receptor_tokens(arm: str) -> Column:
    return {
        "kmer3": lambda: kmer_tokens("cdr3"),
        "morpheme": lambda: parsed_tokens("v", "j", F.col("v_prefix"), F.col("n_region"), F.col("j_suffix")),
        "vjonly": lambda: segment_tokens("v", "j"),
    }[arm]()


def examples(pairs: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """Both sides of the hashed cross of every pair under every arm; all arms share the same pairs.

    Tokens are made and hashed once for each receptor and each epitope, not for each pair.
    """
    of = [c for c in FIELDS if c != "epitope"]
    pairs = stage(pairs)
    hashed = F.array(*[F.struct(F.lit(a).alias("arm"), codes(receptor_tokens(a)).alias("left")) for a in arms])
    # A struct compares nulls as equal.
    receptor = F.struct(*of).alias("receptor")
    left = stage(pairs.select(*of).distinct().select(receptor, hashed.alias("hashed")))
    right = stage(pairs.select("epitope").distinct().withColumn("right", codes(peptide_tokens("epitope"))))
    rows = pairs.join(left, receptor == left.receptor).join(right, "epitope").drop("receptor")
    rows = rows.withColumn("example", digest(*CLONOTYPE, F.col("label"))).withColumn("_a", F.explode("hashed"))
    return rows.select(*pairs.columns, "example", "_a.arm", "_a.left", "right")


def _per_seed(data: DataFrame, seeds: Sequence[int]) -> list[tuple[int, DataFrame]]:
    return [(seed, data.withColumn("seed", F.lit(seed))) for seed in seeds]


def control_pairs(data: DataFrame, n_seeds: int = CONTROL_SEEDS, cap: int = EPITOPE_CAP) -> DataFrame:
    """Seen epitopes: clonotypes of every epitope split 80/20, each side with its own negatives.

    At most ``cap`` training clonotypes of an epitope enter; every held-out one does.
    """
    parts = []
    for seed, rows in _per_seed(data.select(*FIELDS), [SEED + 999 + 31 * k for k in range(n_seeds)]):
        split = stage(split_within(rows, "epitope", seed=seed))
        train = capped(split.filter("in_train"), "epitope", cap=cap, seed=seed)
        kept = stage(train.unionByName(split.filter("NOT in_train")))
        pool = kept.select("in_train", "epitope").distinct()
        every = kept.select("seed", *CLONOTYPE).distinct()
        known = every.withColumn("in_train", F.explode(F.array(F.lit(True), F.lit(False))))
        parts.append(epitope_negatives(kept, pool, ["in_train"], seed=seed, known=known))
    return reduce(DataFrame.unionByName, parts)


def control_scores(data: DataFrame, n_seeds: int = CONTROL_SEEDS, arms: Sequence[str] = ARMS) -> DataFrame:
    """Test scores for seen epitopes: one fit per seed and arm."""
    return sequential_fits(examples(control_pairs(data, n_seeds), arms), ["seed", "arm"], SIDES)


def unseen_pairs(
    data: DataFrame, n_seeds: int = SEEDS, n_folds: int = FOLDS, cap: int = EPITOPE_CAP
) -> DataFrame:
    """Unseen epitopes: every fold's epitopes held out, receptors shared with training removed.

    At most ``cap`` training clonotypes of an epitope enter; every held-out one does.
    """
    parts = []
    for seed, rows in _per_seed(data.select(*FIELDS), [SEED + 1000 * k for k in range(n_seeds)]):
        dealt = stage(folds(rows, "epitope", n_folds, seed).withColumnRenamed("fold", "own_fold"))
        every = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))

        def sided(some: DataFrame, dealt: DataFrame = dealt, every: Column = every) -> DataFrame:
            return (
                some.join(dealt, "epitope")
                .withColumn("fold", every)
                .withColumn("in_train", F.col("fold") != F.col("own_fold"))
                .drop("own_fold")
            )

        train = stage(sided(capped(rows, "epitope", cap=cap, seed=seed)).filter("in_train"))
        receptor = ["fold", "cdr3", "v", "j"]
        test = sided(rows).filter("NOT in_train").join(train.select(*receptor).distinct(), receptor, "left_anti")
        kept = stage(train.unionByName(test))
        pool = kept.select("fold", "in_train", "epitope").distinct()
        parts.append(epitope_negatives(kept, pool, ["fold", "in_train"], seed=seed))
    return reduce(DataFrame.unionByName, parts)


def unseen_scores(
    data: DataFrame, n_seeds: int = SEEDS, n_folds: int = FOLDS, arms: Sequence[str] = ARMS
) -> DataFrame:
    """Test scores for unseen epitopes: one fit per seed, fold and arm."""
    scored = examples(unseen_pairs(data, n_seeds, n_folds), arms).withColumn(
        "example", F.concat_ws("|", "epitope", "example")
    )
    return sequential_fits(scored, ["seed", "fold", "arm"], SIDES).withColumn(
        "epitope", F.split_part("example", F.lit("|"), F.lit(1))
    )


def control_summary(scored: DataFrame) -> DataFrame:
    """Mean and deviation over seeds by arm, and whether the best arm clears the power check."""
    per_seed = stage(auc(scored, ["seed", "arm"], "score", "label"))
    table = over_seeds(per_seed, ["arm"], "auc")
    best = table.agg(F.max("mean")).scalar()
    return table.withColumn("passes", best > CONTROL_PASS)


def unseen_summary(scored: DataFrame) -> DataFrame:
    """Mean and deviation over seeds of the fold-averaged AUC, by arm."""
    per_fold = auc(scored, ["seed", "fold", "arm"], "score", "label")
    per_seed = per_fold.groupBy("seed", "arm").agg(F.avg("auc").alias("auc"))
    return over_seeds(per_seed, ["arm"], "auc")


def epitope_deltas(scored: DataFrame, a: str = "morpheme", b: str = "kmer3",
                   floor: int = EPITOPE_CLASS_FLOOR) -> DataFrame:
    """Difference of two arms by seed and epitope with enough examples of both classes."""
    areas = auc(scored, ["seed", "epitope", "arm"], "score", "label").filter(
        (F.col("n_pos") >= floor) & (F.col("n_neg") >= floor)
    )
    return (
        areas.groupBy("seed", "epitope")
        .agg(
            F.max(F.when(F.col("arm") == a, F.col("auc"))).alias("a"),
            F.max(F.when(F.col("arm") == b, F.col("auc"))).alias("b"),
        )
        .select("seed", "epitope", (F.col("a") - F.col("b")).alias("delta"))
        .dropna()
    )


def unseen_verdict(
    deltas: DataFrame,
    control_ok: bool,
    resamples: int = MEAN_RESAMPLES,
    places: tuple[int, int] = MEAN_PLACES,
) -> DataFrame:
    """Pooled interval of the differences, seeds in favour, and the resulting statement."""
    deltas = stage(deltas)
    pooled = bootstrap_mean(deltas, "delta", ["seed", "epitope"], (), resamples, minimum=1, places=places)
    seeds = (
        deltas.groupBy("seed")
        .agg(F.avg("delta").alias("d"))
        .agg(
            F.avg("d").alias("mean"),
            F.stddev_pop("d").alias("sd"),
            F.count_if(F.col("d") > 0).alias("in_favour"),
            F.count("*").alias("n_seeds"),
        )
    )
    seeds = stage(seeds)
    low = pooled.select("lo").scalar()
    return seeds.select(
        "*", low.alias("lo"), pooled.select("hi").scalar().alias("hi")
    ).withColumn(
        "verdict",
        F.when(F.lit(not control_ok), "invalid")
        .when((F.col("in_favour") == F.col("n_seeds")) & (F.col("lo") > 0), "better in every seed")
        .when(F.col("lo") > 0, "suggestive only")
        .otherwise("no reliable advantage"),
    )
