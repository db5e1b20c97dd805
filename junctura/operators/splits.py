"""Train/test splits, folds, caps and subsamples that never depend on row placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.fixed import EPITOPE_CAP, EPITOPE_FLOOR, EPITOPES, FOLDS, SEED, VALIDATION_SHARE
from junctura.functions.sequence import digest
from junctura.operators.cleaning import CLONOTYPE
from junctura.operators.ranking import SLICE_ROWS, hash_rank
from junctura.session import stage


def with_home_study(df: DataFrame) -> DataFrame:
    """The study a clonotype is held out by: the first of its sorted studies."""
    return df.withColumn("home", F.array_min("studies"))


def study_holdout(df: DataFrame, seed: int = SEED, share: int = 5) -> DataFrame:
    """Add ``held_out``: one study in ``share`` (at least one) is set aside as a whole."""
    rows = with_home_study(df)
    ranked = hash_rank(stage(rows.select("home").distinct()), [], ["home"], seed, "study")
    held = stage(
        ranked.select(
            "home",
            (F.col("rank") <= F.greatest(F.floor(F.col("size") / share), F.lit(1))).alias("held_out"),
        )
    )
    return rows.join(held, "home").drop("home")


def permuted_labels(df: DataFrame, key: Sequence[str], labels: Sequence[str], seed: int = SEED) -> DataFrame:
    """Add ``fake_<label>``: the labels of another row, by one permutation of all rows."""
    here = hash_rank(df, [], key, seed, "to").drop("size")
    there = hash_rank(df.select(*key, *labels), [], key, seed, "from").select(
        "rank", *[F.col(c).alias(f"fake_{c}") for c in labels]
    )
    return here.join(there, "rank").drop("rank")


def top_groups(df: DataFrame, group: str, floor: int = EPITOPE_FLOOR, limit: int = EPITOPES) -> DataFrame:
    """The largest groups with at least ``floor`` rows; equal sizes in name order."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") >= floor)
    return sizes.orderBy(F.col("n").desc(), group).limit(limit)


def capped(
    df: DataFrame,
    group: str,
    key: Sequence[str] = tuple(CLONOTYPE),
    cap: int = EPITOPE_CAP,
    seed: int = SEED,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """At most ``cap`` pseudo-random rows of every group."""
    ranked = hash_rank(df, [group], key, seed, "cap", slice_rows=slice_rows)
    return ranked.filter(F.col("rank") <= cap).drop("rank", "size")


def folds(groups: DataFrame, group: str, n_folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Deal the groups round-robin into folds in pseudo-random order."""
    ranked = hash_rank(groups.select(group).distinct(), [], [group], seed, "fold")
    return ranked.select(group, ((F.col("rank") - 1) % n_folds).cast("int").alias("fold"))


def split_within(
    df: DataFrame,
    group: str,
    key: Sequence[str] = tuple(CLONOTYPE),
    share: float = 0.8,
    seed: int = SEED,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``in_train``: the first ``floor(share * n)`` rows of every group."""
    ranked = hash_rank(df, [group], key, seed, "within", slice_rows=slice_rows)
    return ranked.withColumn("in_train", F.col("rank") <= F.floor(F.col("size") * share)).drop("rank", "size")


def without_overlap(test: DataFrame, train: DataFrame, key: Sequence[str] = ("cdr3", "v", "j")) -> DataFrame:
    """Test rows whose receptor does not occur in training."""
    return test.join(train.select(*key).distinct(), list(key), "left_anti")


def keep_groups(
    pairs: DataFrame, group: str, fraction: float, floor: int, seed: int, salt: str = "curve"
) -> DataFrame:
    """Rows of a pseudo-random share of the groups, each kept whole; at least ``floor`` groups."""
    ranked = hash_rank(stage(pairs.select(group).distinct()), [], [group], seed, salt)
    wanted = F.greatest(F.lit(floor).cast("bigint"), F.floor(F.col("size") * fraction))
    return pairs.join(ranked.filter(F.col("rank") <= wanted).select(group), group, "left_semi")


def validation_split(
    pairs: DataFrame, group: str, share: float = VALIDATION_SHARE, seed: int = SEED, groups: DataFrame | None = None
) -> DataFrame:
    """Add ``in_validation`` so that a positive and its negatives stay on one side.

    The groups up to the one of rank ``floor(share * n)`` are set aside. Ranks follow (digest, group), so
    the place of that one group tells every row's side, and the rows aren't shuffled. ``groups`` may list
    each group once, to save looking for them among the rows.
    """
    listed = stage(pairs.select(group).distinct() if groups is None else groups.select(group))
    ranked = hash_rank(listed, [], [group], seed, "validation")
    order = F.struct(F.unhex(digest(seed, F.lit("validation"), group)).alias("_h"), F.col(group))
    last = stage(
        ranked.filter(F.col("rank") == F.floor(F.col("size") * share)).select(order.alias("_last"))
    ).agg(F.max("_last").alias("_last"))
    side = F.coalesce(order <= last.scalar(), F.lit(False))
    return pairs.withColumn("in_validation", side)
