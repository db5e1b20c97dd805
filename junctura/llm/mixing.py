"""Mixing sources to target weights by subset-sum budget fitting over exact document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from junctura.llm.shared import SPACES, packed, stage, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SEED = 20250101
# What is left for the knapsack when lengths have been taken in proportion.
KNAPSACK = 1 << 15
# Rows that one task ranks when documents of one source and length are chosen from.
SLICE = 1_000
# White space at the start, or a word, with its first character as a group, and the white space behind it.
HEADS = rf"^{SPACES}|([^\x20\x09-\x0D])[^\x20\x09-\x0D]*[\x20\x09-\x0D]*"


def word_count(text: str = "text") -> Column:
    """The number of runs of anything but ASCII white space; null counts as empty.

    Each word is cut to its first character and those are counted: ``regexp_count`` holds all words
    of a text at once, which takes many times the memory of the text.
    """
    return F.length(F.regexp_replace(text_or_empty(f"`{text}`"), HEADS, "$1")).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """(source, source_size, target) from (source, length, n).

    Sources take the weights in turn, in the order of their names, null last. The budget is
    ``share`` of all sizes. A target stops at ``most`` times its source, and the rest shares the
    excess by weight: with sources in ascending order of cap / weight, the level is settled at the
    first source that the level of itself and all later ones leaves below its cap. There is one row
    per source from here on, and the weights are given per source, so single windows order them.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("length") * F.col("n")).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    caps = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    budget = F.sum("source_size").over(W.partitionBy()) * share
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    levels = caps.withColumn("level", (budget - earlier) / onward)
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    settled = F.first(open_level, ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    target = F.least(F.col("cap"), F.coalesce(settled * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", target.alias("target"))


def fit_counts(lengths: np.ndarray, have: np.ndarray, budget: int, room: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take so that their sum comes nearest to ``budget``.

    All but about ``room`` words of the budget are taken in proportion, from the longest length
    down, with the remainder of each length carried on to the next. Bounded-knapsack dynamic
    programming over the documents left fits the rest: ``first[s]`` is the batch of equal lengths
    with which sum s is first reached, so walking back gives the choice. Sums up to twice the rest
    are reached, as beyond them taking nothing is nearer. A budget up to ``room`` is fitted by the
    knapsack alone, so then no other choice comes nearer. Of two equally near sums the lower wins.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * have).sum())
    if budget >= total:
        return have.astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    share, rest = max(0, budget - room) / total, budget
    carry = 0.0
    for i in order.tolist():
        size = int(lengths[i])
        if size <= 0:
            continue
        carry += share * size * int(have[i])
        take[i] = min(int(have[i]), int(carry // size), rest // size)
        carry -= size * int(take[i])
        rest -= size * int(take[i])
    top = 2 * rest
    first = np.full(top + 1, -1, np.int32)
    first[0] = 0
    batches: list[tuple[int, int]] = [(0, 0)]
    for i in order[::-1].tolist():
        size, left = int(lengths[i]), int(have[i] - take[i])
        if size <= 0 or first[rest] >= 0:
            continue
        left, step = min(left, top // size), 1
        while left > 0:
            copies = min(step, left)
            weight = size * copies
            fresh = (first[weight:] < 0) & (first[:-weight] >= 0)
            batches.append((i, copies))
            first[weight:][fresh] = len(batches) - 1
            left, step = left - copies, step * 2
    reached = np.flatnonzero(first >= 0)
    at = int(reached[np.argmin(np.abs(reached - rest))])
    while at:
        i, copies = batches[first[at]]
        take[i] += copies
        at -= copies * int(lengths[i])
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("length").reset_index(drop=True)
    budget = int(rows["budget"].iloc[0])
    rows["extra"] = fit_counts(rows["length"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), budget)
    return rows[["place", "length", "n", "extra", "passes"]]


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    most: int = MOST_REPEATS,
    seed: int = SEED,
    room: int = KNAPSACK,
    slice_rows: int = SLICE,
    number: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, source, size, source_size, target, copies, taken.

    A source whose target is at least its size is first taken whole as often as fits; the budget
    that remains is fitted by ``fit_counts`` over the counts of its exact lengths (at most the root
    of twice its words many). Of the documents of a length, those with the smallest seeded digest
    are taken once more. Groups of one source and length are ranked in digest slices of about
    ``slice_rows``, so neither a large source nor a frequent length is ordered in one task.

    A null text has size 0, a null source is a source of its own, null keys and repeated rows count
    each for themselves (digest ties go by key, and rows equal in both are interchangeable). Empty
    texts are never taken, as copies of nothing. An empty table gives no rows; other columns are
    ignored. The choice depends on seed, keys and sizes only. A column ``number`` tells rows of null or equal
    keys apart, and is returned beside the key.
    """
    rows = stage(
        docs.select(
            F.col(f"`{key}`").alias("key"),
            (F.lit(None).cast("bigint") if number is None else F.col(f"`{number}`")).alias("number"),
            F.col(f"`{source}`").cast("string").alias("source"),
            word_count(text).alias("length"),
        ),
        "lengths",
    )
    # Counted for each of its two uses, as that is little work; written, it was a small file for every task.
    sizes = rows.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    targets = stage(source_targets(sizes, weights, share, most).withColumn("place", place), "targets")
    passes = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    goals = targets.withColumn("passes", F.least(passes, F.lit(most))).withColumn(
        "budget",
        F.when(F.col("passes") >= most, 0).otherwise(
            F.round(F.col("target") - F.col("passes") * F.col("source_size"))
        ).cast("long"),
    )
    fitted = (
        sizes.join(goals, F.equal_null(sizes.source, goals.source))
        .select("place", "length", "n", "passes", "budget")
        .groupBy("place")
        .applyInPandas(_fit_source, "place int, length bigint, n bigint, extra bigint, passes bigint")
    )
    plan = stage(
        fitted.join(targets, "place").select(
            "source", "length", "n", "extra", "passes", "source_size", "target"
        ),
        "plan",
    )
    chosen = _choose(rows, plan, seed, slice_rows)
    chosen = chosen.drop("number") if number is None else chosen.withColumnRenamed("number", number)
    return chosen.withColumnRenamed("key", key)


def _choose(rows: DataFrame, plan: DataFrame, seed: int, slice_rows: int) -> DataFrame:
    """Mark the ``extra`` rows with the smallest digests of each source and length."""
    same = F.equal_null(rows.source, plan.source) & (rows.length == plan.length)
    joined = rows.join(plan, same).select(
        "key", "number", rows.source, rows.length, "n", "extra", "passes", "source_size", "target"
    )
    # The upper 31 bits of the digest are uniform, so equal ranges of them hold about equally many.
    # Rows without a key go by their number, so that they spread too.
    digest = F.xxhash64(F.lit(seed), F.col("key"), F.when(F.col("key").isNull(), F.col("number")))
    slices = F.ceil(F.col("n") / slice_rows)
    joined = joined.withColumn("digest", digest).withColumn("upper", F.shiftrightunsigned("digest", 33))
    joined = joined.withColumn("slice", F.shiftright(F.col("upper") * slices, 31))
    counted = joined.groupBy("source", "length", "slice").agg(F.count(F.lit(1)).alias("in_slice"))
    before = F.sum("in_slice").over(
        W.partitionBy("source", "length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = counted.select("source", "length", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(W.partitionBy("source", "length", "slice").orderBy("upper", "digest", "key", "number"))
    ranked = joined.withColumn("local", local)
    keyed = (
        F.equal_null(ranked.source, offsets.source)
        & (ranked.length == offsets.length)
        & (ranked.slice == offsets.slice)
    )
    once_more = (F.col("before") + F.col("local") <= F.col("extra")).cast("long")
    copies = F.when(ranked.length > 0, F.col("passes") + once_more).otherwise(0).cast("long")
    return ranked.join(offsets, keyed).select(
        "key",
        "number",
        ranked.source.alias("source"),
        ranked.length.alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * ranked.length).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns as they are.

    Rows are told apart by a number of their own, so rows with null or equal keys are taken each for
    itself and a source gets as many words as ``mix`` gives it. Null and empty texts are never taken; an
    empty table gives no rows. Of equally long documents those are taken that ``mix`` takes, by their key; the number
    decides only between null or equal keys.
    """
    rows = stage(packed(docs, id=F.monotonically_increasing_id()), "rows")
    named = F.col(f"doc.`{key}`") if key in docs.columns else F.lit(None).cast("bigint")
    own = rows.select(
        "id", named.alias("key"), F.col(f"doc.`{text}`").alias("text"), F.col(f"doc.`{source}`").alias("source")
    )
    chosen = mix(own, "key", "text", "source", number="id").filter("copies > 0").select("id", "copies")
    taken = rows.join(chosen, "id").select("doc", "copies")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
