"""Bootstrap intervals and curve fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from junctura.fixed import GAP_PLACES, GAP_RESAMPLES, PEPTIDE_RESAMPLES, SEED
from junctura.functions.sequence import pick
from junctura.operators.metrics import auc
from junctura.operators.ranking import hash_rank
from junctura.session import stage


def resample_counts(items: DataFrame, by: Sequence[str], key: Sequence[str], resamples: int, seed: int = SEED) -> DataFrame:
    """How often each item of a group is drawn in each resample: as many draws as items, with
    replacement. Items are numbered, every (resample, draw) picks a number, and repeats collapse
    to a count before meeting the items again."""
    numbered = stage(hash_rank(stage(items), by, key, seed, "item").withColumnRenamed("rank", "item"))
    draws = (
        numbered.select(*by, "size", F.col("item").alias("draw"))
        .withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .withColumn("item", pick("size", seed, F.lit("draw"), *by, "resample", "draw") + 1)
        .groupBy(*by, "resample", "item")
        .agg(F.count("*").alias("times"))
    )
    return draws.join(numbered.drop("size"), [*by, "item"]).drop("item")


def interval(
    samples: DataFrame, value: str, by: Sequence[str] = (), places: tuple[int, int] | None = None
) -> DataFrame:
    """The central 95 % of the resampled values: interpolated, or at ``places`` (from 0) in sorted order."""
    if places is None:
        ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
        packed = samples.groupBy(*by).agg(ends.alias("e"))
        return packed.select(*by, F.get("e", F.lit(0)).alias("lo"), F.get("e", F.lit(1)).alias("hi"))
    low, high = places
    order = F.array_sort(F.collect_list(value))
    packed = samples.groupBy(*by).agg(order.alias("e"))
    return packed.select(*by, F.get("e", F.lit(low)).alias("lo"), F.get("e", F.lit(high)).alias("hi"))


def bootstrap_mean(
    deltas: DataFrame,
    value: str,
    key: Sequence[str],
    by: Sequence[str] = (),
    resamples: int = PEPTIDE_RESAMPLES,
    seed: int = SEED,
    minimum: int = 3,
    places: tuple[int, int] | None = None,
) -> DataFrame:
    """Mean difference per group with its interval, wins, and the verdict that follows."""
    by = list(by)
    counts = resample_counts(deltas.select(*by, *key, value), by, key, resamples, seed)
    means = counts.groupBy(*by, "resample").agg(
        (F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("m")
    )
    ends = interval(means, "m", by, places)
    stats = (
        deltas.groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.sum(F.when(F.col(value) > 0, 1).otherwise(0)).alias("wins"),
            F.avg(value).alias("delta"),
        )
        .filter(F.col("n") >= minimum)
    )
    if by:
        joined = stats.join(ends, by)
    else:
        ends = stage(ends)
        joined = stats.select(
            "*", ends.select("lo").scalar().alias("lo"), ends.select("hi").scalar().alias("hi")
        )
    return joined.withColumn("verdict", verdict(F.col("lo"), F.col("hi")))


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "better").when(high > 0, "no sig. difference").otherwise("worse")


def paired_deltas(scores: DataFrame, arm: str, key: Sequence[str], value: str, a: str, b: str) -> DataFrame:
    """``a`` minus ``b`` for every key both arms scored."""
    left = scores.filter(F.col(arm) == a).select(*key, F.col(value).alias("va"))
    right = scores.filter(F.col(arm) == b).select(*key, F.col(value).alias("vb"))
    return left.join(right, list(key)).select(*key, (F.col("va") - F.col("vb")).alias("delta"))


def auc_gap_interval(
    items: DataFrame,
    key: Sequence[str],
    models: dict[str, tuple[str, str]],
    by: Sequence[str] = (),
    resamples: int = GAP_RESAMPLES,
    seed: int = SEED,
    places: tuple[int, int] = GAP_PLACES,
) -> DataFrame:
    """Interval of AUC(first model) - AUC(second model) over paired resamples of the items.

    Every item carries a positive and a negative score for both models; a resample reuses the
    same items for all four. Drawn items enter as weights, so nothing is copied.
    """
    by = list(by)
    first, second = models
    counts = resample_counts(items, by, key, resamples, seed)
    outcomes = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"), F.lit(label).alias("label"), F.col(column).alias("score")
            )
            for name, columns in models.items()
            for label, column in zip((1, 0), columns)
        ]
    )
    scored = counts.select(*by, "resample", "times", F.explode(outcomes).alias("o")).select(
        *by, "resample", "times", "o.*"
    )
    areas = auc(scored, [*by, "resample", "model"], "score", "label", weight="times")
    gaps = areas.groupBy(*by, "resample").agg(
        (
            F.max(F.when(F.col("model") == first, F.col("auc")))
            - F.max(F.when(F.col("model") == second, F.col("auc")))
        ).alias("gap")
    )
    return interval(gaps, "gap", by, places)


def fit_curve(curve: DataFrame, size: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of the value on the logarithm of the size, over all and the upper half."""
    x = F.log(F.col(size))
    # A curve has one row per training size.
    order = W.partitionBy(*(by or [F.lit(1)])).orderBy(size)
    ranked = curve.withColumn("_at", F.row_number().over(order)).withColumn(
        "_n", F.count("*").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    )
    upper = F.col("_at") > F.floor(F.col("_n") / 2)
    return ranked.groupBy(*by).agg(
        F.regr_slope(value, x).alias("slope"),
        F.regr_intercept(value, x).alias("intercept"),
        F.corr(value, x).alias("r"),
        F.regr_slope(F.when(upper, F.col(value)), F.when(upper, x)).alias("upper_slope"),
        F.min_by(value, size).alias("first_value"),
        F.max_by(value, size).alias("last_value"),
        F.max(size).alias("largest"),
    )


def size_to_reach(target: float) -> Column:
    """Training size at which the fitted line meets ``target``."""
    return F.exp((F.lit(target) - F.col("intercept")) / F.col("slope"))


def curve_shape(last: str = "last_value") -> Column:
    """Whether an advantage is absent, still rising, levelled off, or undecided."""
    upper, whole = F.col("upper_slope"), F.col("slope")
    return (
        F.when(F.col(last) <= 0.005, "none")
        .when((upper > 0.5 * whole) & (upper > 0.004), "trend")
        .when(upper < 0.25 * whole, "threshold")
        .otherwise("ambiguous")
    )
