"""Ranking quality by group: whole and partial area under the ROC curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.fixed import MAX_FPR
from junctura.operators.ranking import running_sums


def score_steps(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    label: str,
    weight: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """One row per group and distinct score, best first, with the classes at and above it.

    Rows collapse to distinct scores before anything is ordered.
    """
    unit = F.col(weight) if weight else F.lit(1)
    steps = df.groupBy(*group, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, unit).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(unit)).alias("neg"),
    )
    return running_sums(steps, group, "score", ["pos", "neg"], descending=True, slices=slices)


def auc(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    label: str,
    weight: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half; null for one class."""
    steps = score_steps(df, group, score, label, weight, slices)
    lost = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    measures = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), lost.alias("lost")]
    sums = steps.groupBy(*group).agg(*measures) if group else steps.agg(*measures)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return sums.select(
        *group, "n_pos", "n_neg", (1.0 - F.try_divide(F.col("lost"), pairs)).alias("auc")
    )


def partial_auc(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    label: str,
    max_fpr: float = MAX_FPR,
    slices: int | None = None,
) -> DataFrame:
    """Standardised area up to ``max_fpr`` for every group with both classes.

    The step crossing the limit is cut by linear interpolation; a constant score gives 0.5.
    """
    steps = score_steps(df, group, score, label, None, slices)
    totals = steps.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    limit = F.lit(max_fpr) * F.col("n_neg")
    width = F.least(F.col("neg").cast("double"), limit - F.col("before_neg"))
    rise = F.col("pos") * F.try_divide(width, F.col("neg"))
    area = F.when(width > 0, width * (F.col("before_pos") + rise / 2.0)).otherwise(0.0)
    lowest = max_fpr * max_fpr / 2.0
    raw = F.col("area") / (F.col("n_pos").cast("double") * F.col("n_neg"))
    return (
        steps.join(totals.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0)), list(group))
        .groupBy(*group)
        .agg(F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"), F.sum(area).alias("area"))
        .select(
            *group,
            "n_pos",
            "n_neg",
            (0.5 * (1.0 + (raw - lowest) / (max_fpr - lowest))).alias("auc01"),
        )
    )


def macro_mean(per_group: DataFrame, value: str, seen: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean over groups, and over those seen and not seen in training."""
    measures = [F.count(value).alias("n_groups"), F.avg(value).alias("all")]
    if seen:
        measures += [
            F.avg(F.when(F.col(seen), F.col(value))).alias("seen"),
            F.avg(F.when(~F.col(seen), F.col(value))).alias("unseen"),
        ]
    return per_group.groupBy(*by).agg(*measures) if by else per_group.agg(*measures)


def flag_seen(df: DataFrame, training: DataFrame, key: str) -> DataFrame:
    """Add ``seen``: whether the key occurs in the training rows."""
    known = training.select(key).distinct().withColumn("seen", F.lit(True))
    return df.join(known, key, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def over_seeds(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation over repeated runs."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def best_first(df: DataFrame, value: str, key: Sequence[str]) -> DataFrame:
    """Add ``place``, from 1, by descending value (to nine digits) and then by key.

    The rows are one per group, and ranked range by range.
    """
    rows = df.withColumn("_order", F.struct(-F.round(value, 9), *key)).withColumn("_one", F.lit(1))
    placed = running_sums(rows, [], "_order", ["_one"])
    return placed.withColumn("place", F.col("before__one") + 1).drop("_order", "_one", "before__one")
