"""Ranks and running sums that stay distributed when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from junctura.functions.sequence import all_of, digest, digest_number
from junctura.session import stage

# A window partition holds about this many rows.
SLICE_ROWS = 50_000


def _grouped(group: Sequence[str]) -> list[Column]:
    return [F.col(g) for g in group] or [F.lit(1)]


def _match(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join on equal or equally missing values, with the left side's columns and the new ones."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in columns else F.col(c) for c in right.columns])
    same = all_of([F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns])
    return left.join(renamed, same).drop(*[f"_r_{c}" for c in columns])


def _offsets(totals: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums over the earlier slices of each group; one row per slice, so a small window."""
    order = W.partitionBy(*_grouped(group)).orderBy("_slice")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *group,
        "_slice",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_off_{v}") for v in values],
    )


def hash_rank(
    df: DataFrame,
    group: Sequence[str],
    key: Sequence[str],
    *salt: str | int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``rank`` (from 1) in pseudo-random order within each group, and group size ``size``.

    The order is that of a digest of the salt and the key, hence uniform: a group is cut into equal
    digest ranges of about ``slice_rows`` rows, each is ranked in its own task, and the sizes of the
    earlier ranges are added. Nothing depends on how the rows were partitioned. The input is read
    for the sizes, the ranges and the ranks, so it should be a written table.
    """
    parts = [F.lit(str(s)) for s in salt] + [F.col(k) for k in key]
    # As bytes, which sort like the hex digits and are half as long.
    rows = df.withColumn("_h", F.unhex(digest(*parts)))
    if group:
        rows = _match(rows, df.groupBy(*group).agg(F.count("*").alias("size")), group)
    else:
        rows = rows.withColumn("size", df.agg(F.count("*")).scalar())
    share = digest_number(F.hex("_h")) / F.lit(float(1 << 48))
    rows = rows.withColumn("_slice", F.floor(share * F.ceil(F.col("size") / slice_rows)))
    offsets = _offsets(
        rows.groupBy(*group, "_slice").agg(F.count("*").alias("n")), group, ["n"]
    )
    local = W.partitionBy(*_grouped(group), "_slice").orderBy("_h", *key)
    return _match(
        rows.withColumn("_local", F.row_number().over(local)), offsets, [*group, "_slice"]
    ).select(*df.columns, (F.col("_off_n") + F.col("_local")).alias("rank"), "size")


def _by_range(df: DataFrame, order: Sequence[Column], slices: int | None) -> DataFrame:
    """``df`` written in ranges of ``order`` with the number of the range as ``_slice``.

    There are as many ranges as shuffle partitions unless ``slices`` says otherwise.
    """
    ranged = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    return stage(ranged.withColumn("_slice", F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    values: Sequence[str],
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Add ``before_<v>``: the sum over the group's earlier rows; ``order`` is unique in a group.

    The rows are range-partitioned on (group, order) and written with the number of their range,
    summed range by range, and the totals of a group's earlier ranges added.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    sliced = _by_range(df, [*[F.col(g) for g in group], key], slices)
    totals = sliced.groupBy(*group, "_slice").agg(*[F.sum(v).alias(v) for v in values])
    window = W.partitionBy(*_grouped(group), "_slice").orderBy(key)
    earlier = window.rowsBetween(W.unboundedPreceding, -1)
    local = sliced.select(
        "*", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_local_{v}") for v in values]
    )
    return _match(local, _offsets(totals, group, values), [*group, "_slice"]).select(
        *df.columns,
        *[(F.col(f"_off_{v}") + F.col(f"_local_{v}")).alias(f"before_{v}") for v in values],
    )


def adjust_fdr(
    df: DataFrame, group: Sequence[str], p: str, q: str = "q", slices: int | None = None
) -> DataFrame:
    """Benjamini-Hochberg q-values within each group.

    Equal p-values share the q-value of the last of them, so the work is done on distinct
    p-values: a running count gives the rank, and a running minimum from the top the q-value.
    """
    distinct = df.groupBy(*group, p).agg(F.count("*").alias("_n"))
    ranked = stage(running_sums(distinct, group, p, ["_n"], slices=slices))
    if group:
        ranked = _match(ranked, ranked.groupBy(*group).agg(F.sum("_n").alias("_m")), group)
    else:
        ranked = ranked.withColumn("_m", ranked.agg(F.sum("_n")).scalar())
    scaled = ranked.withColumn(
        "_scaled", F.col(p) * F.col("_m") / (F.col("before__n") + F.col("_n"))
    )
    stepped = _suffix_min(scaled, group, p, "_scaled", q, slices)
    adjusted = stepped.select(*group, p, F.least(F.lit(1.0), F.col(q)).alias(q))
    return _match(df, adjusted, [*group, p])


def _suffix_min(
    df: DataFrame, group: Sequence[str], order: str, value: str, out: str, slices: int | None
) -> DataFrame:
    sliced = _by_range(df, [*[F.col(g) for g in group], F.col(order).asc()], slices)
    later = W.partitionBy(*_grouped(group)).orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    tails = (
        sliced.groupBy(*group, "_slice")
        .agg(F.min(value).alias("_low"))
        .select(*group, "_slice", F.min("_low").over(later).alias("_tail"))
    )
    window = W.partitionBy(*_grouped(group), "_slice").orderBy(order)
    onward = window.rowsBetween(0, W.unboundedFollowing)
    return _match(
        sliced.withColumn("_local", F.min(value).over(onward)), tails, [*group, "_slice"]
    ).withColumn(out, F.least("_local", "_tail"))
