"""Decoy sequences drawn from digests of the row key, so that every run agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.fixed import DECOY_TRIES, SEED
from junctura.functions.sequence import col, digest, digest_number, kmers
from junctura.session import stage


def shuffled_decoy(text: str | Column, *key: str | Column, tries: int = DECOY_TRIES, seed: int = SEED) -> Column:
    """The residues in another order, from the first try that differs.

    If none does, the first residue changes places with the first one that differs from it, so only
    a text of one repeated residue (or none) has no decoy and gives null.
    """
    original = col(text)

    def attempt(salt: int) -> Column:
        order = F.transform(
            kmers(original, 1),
            lambda aa, i: F.struct(digest(seed, salt, *key, i).alias("h"), aa.alias("aa")),
        )
        mixed = F.array_join(F.transform(F.array_sort(order), lambda s: s["aa"]), "")
        return F.when(mixed != original, mixed)

    first = F.substring(original, 1, 1)
    same = F.regexp_extract(original, r"^((.)\2*)", 1)
    other = F.substring(original, F.length(same) + 1, F.lit(1))
    swapped = F.concat(
        other,
        F.substring(same, F.lit(2), F.length(same)),
        first,
        F.substring(original, F.length(same) + 2, F.length(original)),
    )
    swap = F.when(F.length(same) < F.length(original), swapped)
    return F.coalesce(*[attempt(salt) for salt in range(tries)], swap)


def residue_weights(df: DataFrame, text: str) -> DataFrame:
    """Background residue counts: at most one row per residue."""
    return (
        df.select(F.explode(kmers(text, 1)).alias("aa")).groupBy("aa").agg(F.count("*").alias("n"))
    )


def with_resampled_decoy(
    rows: DataFrame, text: str, weights: DataFrame, key: Sequence[str], out: str, seed: int = SEED
) -> DataFrame:
    """Add a sequence of the same length with residues drawn from the background counts."""
    ranked = F.array_sort(F.collect_list(F.struct("aa", "n")))
    steps = F.aggregate(
        "ranked",
        F.array().cast("array<struct<aa:string,upto:bigint>>"),
        lambda acc, s: F.concat(
            acc,
            F.array(
                F.struct(
                    s["aa"].alias("aa"),
                    (F.coalesce(F.get(acc, F.size(acc) - 1)["upto"], F.lit(0)) + s["n"]).alias("upto"),
                )
            ),
        ),
    )
    table = stage(weights.agg(ranked.alias("ranked")).select(steps.alias("_steps")))
    total = F.get("_steps", F.size("_steps") - 1)["upto"]

    at = F.transform(
        kmers(text, 1),
        lambda _, i: F.pmod(digest_number(digest(seed, F.lit("resample"), *key, i)), total),
    )
    drawn = F.array_join(
        F.transform(at, lambda u: F.get(F.filter("_steps", lambda s: s["upto"] > u), F.lit(0))["aa"]), ""
    )
    return rows.withColumn("_steps", table.scalar()).withColumn(out, drawn).drop("_steps")
