"""N-gram profiles and their enrichment between groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from junctura.fixed import FDR, FOCUS, GRAM_FLOOR, STUDY_FLOOR
from junctura.functions.sequence import kmers
from junctura.operators.ranking import adjust_fdr
from junctura.session import stage


def ngram_counts(df: DataFrame, text: str, k: int, group: Sequence[str]) -> DataFrame:
    """Occurrences of every k-gram by group; the map-side combine runs before the shuffle."""
    return (
        df.select(*group, F.explode(kmers(text, k)).alias("gram"))
        .groupBy(*group, "gram")
        .agg(F.count("*").alias("n"))
    )


def study_sizes(annotated: DataFrame) -> DataFrame:
    """Clonotypes per epitope and study; a clonotype counts for each of its studies."""
    return (
        annotated.select("epitope", F.explode("studies").alias("study"))
        .groupBy("epitope", "study")
        .agg(F.count("*").alias("n"))
    )


def large_studies(annotated: DataFrame, floor: int = STUDY_FLOOR) -> DataFrame:
    return study_sizes(annotated).filter(F.col("n") >= floor)


def study_composition(annotated: DataFrame) -> DataFrame:
    """Clonotypes, distinct studies, and the largest study with its share of clonotypes."""
    sizes = annotated.groupBy("epitope").agg(F.count("*").alias("clonotypes"))
    top = (
        study_sizes(annotated)
        .groupBy("epitope")
        .agg(
            F.count("*").alias("n_studies"),
            F.min_by("study", F.struct(-F.col("n"), F.col("study"))).alias("top_study"),
            F.max("n").alias("top_n"),
        )
    )
    return sizes.join(top, "epitope").select(
        "epitope",
        "clonotypes",
        "n_studies",
        "top_study",
        (100.0 * F.col("top_n") / F.col("clonotypes")).alias("top_share"),
    )


def study_profiles(annotated: DataFrame, k: int = 2, floor: int = STUDY_FLOOR) -> DataFrame:
    """K-gram frequencies within each large study of an epitope."""
    by_study = annotated.select("epitope", "n_region", F.explode("studies").alias("study"))
    kept = by_study.join(
        stage(large_studies(annotated, floor)).select("epitope", "study"), ["epitope", "study"], "left_semi"
    )
    counts = stage(ngram_counts(kept, "n_region", k, ["epitope", "study"]))
    totals = counts.groupBy("epitope", "study").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["epitope", "study"])


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided exact p-value of the table ``[[a, b], [c, d]]``.

    Spark has no log-gamma, so the hypergeometric tail is summed in Arrow batches. Terms rise
    to the mode and then fall: the sum runs outwards from the mode and ends where what remains
    cannot change a double.
    """

    @F.pandas_udf("double")
    def tail(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        from math import exp, lgamma

        import numpy as np

        def log_choose(n: int, k: int) -> float:
            return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

        def outward(start: int, stop: int, row1: int, row2: int, col1: int) -> float:
            """Sum of terms from start towards stop (inclusive), relative to the first."""
            total, scale, step = 0.0, 1.0, 1 if stop >= start else -1
            at = start
            while True:
                n = min(4096, abs(stop - at) + 1)
                k = at + step * np.arange(n, dtype=float)
                if step > 0:
                    ratio = (row1 - k) * (col1 - k) / ((k + 1) * (row2 - col1 + k + 1))
                else:
                    ratio = k * (row2 - col1 + k) / ((row1 - k + 1) * (col1 - k + 1))
                terms = scale * np.concatenate([[1.0], np.cumprod(ratio)])
                total += float(terms[:n].sum())
                if at + step * (n - 1) == stop or terms[n] == 0.0:
                    return total
                last = float(ratio[-1])
                if last < 1.0 and terms[n] / (1.0 - last) < 1e-18 * total:
                    return total
                scale, at = float(terms[n]), at + step * n

        def p_value(a: int, b: int, c: int, d: int) -> float:
            row1, row2, col1 = a + b, c + d, a + c
            if row1 + row2 == 0 or row1 == 0 or col1 == 0:
                return 1.0
            low, high = max(a, col1 - row2, 0), min(row1, col1)
            if low > high:
                return 0.0
            mode = (row1 + 1) * (col1 + 1) // (row1 + row2 + 2)
            peak = min(max(mode, low), high)
            sums = outward(peak, high, row1, row2, col1)
            if peak > low:
                sums += outward(peak, low, row1, row2, col1) - 1.0
            log_peak = (
                log_choose(row1, peak)
                + log_choose(row2, col1 - peak)
                - log_choose(row1 + row2, col1)
            )
            return min(1.0, exp(log_peak) * sums)

        for cols in batches:
            yield pd.Series(
                [p_value(*map(int, row)) for row in zip(*cols)], dtype="float64"
            )

    return tail(a, b, c, d)


def compare_profiles(profile: DataFrame, groups: Sequence[str], floor: int = GRAM_FLOOR) -> DataFrame:
    """Every ordered pair of ``groups`` and every gram frequent in its first group, with counts
    of both sides and the ratio against the smoothed second side."""
    spark = profile.sparkSession
    pairs = spark.createDataFrame(
        [(a, b) for a in groups for b in groups if a != b], "group_a string, group_b string"
    )
    totals = profile.groupBy("epitope").agg(F.sum("n").alias("total"))
    side_a = (
        pairs.join(profile.filter(F.col("n") >= floor), F.col("epitope") == F.col("group_a"))
        .select("group_a", "group_b", "gram", F.col("n").alias("count_a"))
        .join(totals.select(F.col("epitope").alias("group_a"), F.col("total").alias("total_a")), "group_a")
    )
    side_b = profile.select(F.col("epitope").alias("group_b"), "gram", F.col("n").alias("count_b"))
    total_b = totals.select(F.col("epitope").alias("group_b"), F.col("total").alias("total_b"))
    joined = (
        side_a.join(side_b, ["group_b", "gram"], "left")
        .join(total_b, "group_b", "left")
        .fillna(0, ["count_b", "total_b"])
    )
    expected = (F.col("count_b") + 1) / (F.col("total_b") + 1)
    return joined.select(
        "group_a",
        "group_b",
        "gram",
        "count_a",
        "count_b",
        "total_a",
        "total_b",
        expected.alias("base_b"),
        (F.col("count_a") / F.col("total_a") / expected).alias("ratio"),
    )


def with_significance(compared: DataFrame) -> DataFrame:
    """Add the exact p-value and the q-value within each comparison."""
    a, c = F.col("count_a"), F.col("count_b")
    p = fisher_greater(a, F.col("total_a") - a, c, F.col("total_b") - c)
    return adjust_fdr(stage(compared.withColumn("p", p)), ["group_a", "group_b"], "p")


def enrichment(
    annotated: DataFrame,
    groups: Sequence[str] = tuple(e for e, _ in FOCUS),
    k: int = 2,
    floor: int = GRAM_FLOOR,
    fdr: float = FDR,
    study_floor: int = STUDY_FLOOR,
) -> DataFrame:
    """Significant grams of each comparison and how many large studies replicate them."""
    focus = annotated.filter(F.col("epitope").isin(list(groups)))
    profile = stage(ngram_counts(focus, "n_region", k, ["epitope"]))
    tested = with_significance(compare_profiles(profile, groups, floor)).filter(F.col("q") < fdr)
    studies = study_profiles(focus, k, study_floor).select(
        F.col("epitope").alias("group_a"), "gram", (F.col("n") / F.col("total")).alias("freq")
    )
    n_studies = (
        large_studies(focus, study_floor)
        .groupBy(F.col("epitope").alias("group_a"))
        .agg(F.count("*").alias("n_studies"))
    )
    keys = ["group_a", "group_b", "gram"]
    tested = stage(tested)
    replicated = (
        studies.join(tested.select(*keys, "base_b"), ["group_a", "gram"])
        .filter(F.col("freq") > F.col("base_b"))
        .groupBy(*keys)
        .agg(F.count("*").alias("replicating"))
    )
    return (
        tested.join(replicated, keys, "left")
        .join(n_studies, "group_a", "left")
        .fillna(0, ["replicating", "n_studies"])
        .drop("base_b", "total_a", "total_b")
    )


def top_by_ratio(table: DataFrame, limit: int = 8) -> DataFrame:
    """The ``limit`` grams of each comparison with the largest ratio (to nine digits), then by gram."""
    order = W.partitionBy("group_a", "group_b").orderBy(F.round("ratio", 9).desc(), "gram")
    return table.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def enrichment_report(enriched: DataFrame) -> DataFrame:
    """The enrichment rows as written out: rounded text and replication as a fraction."""
    names = F.create_map(*[F.lit(x) for pair in FOCUS for x in pair])
    return enriched.select(
        F.coalesce(names[F.col("group_a")], "group_a").alias("group_a"),
        F.coalesce(names[F.col("group_b")], "group_b").alias("group_b"),
        F.col("gram").alias("bigram"),
        "count_a",
        "count_b",
        F.format_string("%.3f", "ratio").alias("ratio"),
        F.format_string("%.3e", "p").alias("p"),
        F.format_string("%.3e", "q").alias("q"),
        F.concat_ws("/", F.col("replicating").cast("string"), F.col("n_studies").cast("string")).alias(
            "studies_replicating"
        ),
    )


def pseudocount_enrichment(profile: DataFrame, group_a: str, group_b: str) -> DataFrame:
    """Frequency ratios both ways: a gram missing on the other side counts one half there."""
    a = profile.filter(F.col("epitope") == group_a).select("gram", F.col("n").alias("a"))
    b = profile.filter(F.col("epitope") == group_b).select("gram", F.col("n").alias("b"))
    totals = profile.agg(
        F.sum(F.when(F.col("epitope") == group_a, F.col("n"))).alias("ta"),
        F.sum(F.when(F.col("epitope") == group_b, F.col("n"))).alias("tb"),
    ).select(*[F.greatest(F.coalesce(t, F.lit(0)), F.lit(1)).alias(t) for t in ("ta", "tb")])
    both = a.join(b, "gram", "full").select(
        "*", totals.select("ta").scalar().alias("ta"), totals.select("tb").scalar().alias("tb")
    )

    def ratio(own: str, own_total: str, other: str, other_total: str) -> Column:
        rest = F.coalesce(F.col(other).cast("double"), F.lit(0.5)) / F.col(other_total)
        return F.col(own) / F.col(own_total) / F.greatest(rest, F.lit(0.0001))

    return both.select(
        "gram",
        ratio("a", "ta", "b", "tb").alias("ratio_a"),
        ratio("b", "tb", "a", "ta").alias("ratio_b"),
    )
