"""Consensus start and end residues of every gene, and their check against a segment table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.fixed import ANCHOR_MAX, ANCHOR_SHARE, ANCHOR_SUPPORT, SPECIES


def residue_counts(rows: DataFrame, max_anchor: int = ANCHOR_MAX) -> DataFrame:
    """Counts by (side, gene, position, residue) in one pass over ``rows(cdr3, v, j)``.

    Position -1 counts the gene's rows. A sequence never gives its last residue away, so a
    position counts only sequences at least two longer. The map-side combine leaves a handful
    of rows per gene, whatever the input size.
    """
    votes = [
        f"named_struct('side', '{side}', 'gene', {gene}, 'k', -1, 'aa', '')"
        for side, gene in (("V", "v"), ("J", "j"))
    ]
    for k in range(max_anchor):
        for side, gene, at in (("V", "v", k + 1), ("J", "j", -(k + 1))):
            votes.append(
                f"if(length(cdr3) > {k + 1}, named_struct('side', '{side}', 'gene', {gene}, "
                f"'k', {k}, 'aa', substring(cdr3, {at}, 1)), null)"
            )
    return (
        rows.select(F.explode(F.expr(f"array({', '.join(votes)})")).alias("vote"))
        .filter(F.col("vote").isNotNull())
        .groupBy("vote.side", "vote.gene", "vote.k", "vote.aa")
        .agg(F.count("*").alias("n"))
    )


def position_profile(rows: DataFrame, max_anchor: int = ANCHOR_MAX) -> DataFrame:
    """Modal residue and its share at every position; ties go to the smaller residue."""
    return (
        residue_counts(rows, max_anchor)
        .groupBy("side", "gene", "k")
        .agg(
            F.min_by("aa", F.struct(-F.col("n"), F.col("aa"))).alias("aa"),
            F.max("n").alias("n"),
            F.sum("n").alias("total"),
        )
        .withColumn("share", F.col("n") / F.col("total"))
    )


def derive_anchors(
    rows: DataFrame,
    threshold: float = ANCHOR_SHARE,
    max_anchor: int = ANCHOR_MAX,
    min_support: int = ANCHOR_SUPPORT,
) -> DataFrame:
    """Anchors ``(side, gene, anchor, support, profile)``: the modal residues up to the first
    position whose modal share falls below the threshold. The profile includes that position.
    """
    spots = F.array_sort(F.collect_list(F.when(F.col("k") >= 0, F.struct("k", "aa", "share"))))
    first_miss = F.coalesce(
        F.min(F.when((F.col("k") >= 0) & (F.col("share") < threshold), F.col("k"))),
        F.lit(max_anchor),
    )
    residues = F.array_join(
        F.transform(F.filter("spots", lambda s: s["k"] < F.col("miss")), lambda s: s["aa"]), ""
    )
    return (
        position_profile(rows, max_anchor)
        .groupBy("side", "gene")
        .agg(
            spots.alias("spots"),
            first_miss.alias("miss"),
            F.max(F.when(F.col("k") == -1, F.col("n"))).alias("support"),
        )
        .filter(F.col("support") >= min_support)
        .select(
            "side",
            "gene",
            F.when(F.col("side") == "V", residues).otherwise(F.reverse(residues)).alias("anchor"),
            "support",
            F.transform(
                F.filter("spots", lambda s: s["k"] <= F.col("miss")),
                lambda s: F.struct(s["aa"].alias("aa"), F.round(s["share"], 3).alias("share")),
            ).alias("profile"),
        )
        .filter(F.col("anchor") != "")
    )


def reference_anchors(
    segments: DataFrame, species: str = SPECIES, gene: str = "TRB", ordinal: str | None = None
) -> DataFrame:
    """Longest listed contribution per segment; the first by ``ordinal`` (or text) among equals."""
    tie = F.col(ordinal) if ordinal else F.col("cdr3")
    return (
        segments.filter((F.col("species") == species) & (F.col("gene") == gene))
        .groupBy(F.when(F.col("type") == "V", "V").otherwise("J").alias("side"), F.col("segm").alias("gene"))
        .agg(F.min_by("cdr3", F.struct(-F.length("cdr3"), tie)).alias("reference"))
        .filter(F.col("reference") != "")
    )


def validate_anchors(anchors: DataFrame, reference: DataFrame) -> DataFrame:
    """Derived and reference anchors side by side where both exist, and whether they agree."""
    derived, listed = F.col("anchor"), F.col("reference")
    agree = F.when(
        F.col("side") == "V", listed.startswith(derived) | derived.startswith(listed)
    ).otherwise(listed.endswith(derived) | derived.endswith(listed))
    return anchors.join(reference, ["side", "gene"]).select(
        "side", "gene", "anchor", "reference", agree.alias("agree")
    )


def edge_leakage(annotated: DataFrame, min_length: int = 4, min_total: int = 50) -> DataFrame:
    """Mean modal residue share at the three outer positions of either end of the interior,
    by the segment that abuts it."""
    spots = [
        F.struct(
            F.lit(p).alias("position"),
            F.col("v" if p > 0 else "j").alias("segment"),
            F.substring("n_region", p, 1).alias("aa"),
        )
        for p in (1, 2, 3, -1, -2, -3)
    ]
    return (
        annotated.filter(F.length("n_region") >= min_length)
        .select(F.explode(F.array(*spots)).alias("s"))
        .groupBy("s.position", "s.segment", "s.aa")
        .agg(F.count("*").alias("n"))
        .groupBy("position", "segment")
        .agg(F.max("n").alias("top"), F.sum("n").alias("total"))
        .filter(F.col("total") >= min_total)
        .groupBy("position")
        .agg(F.avg(F.col("top") / F.col("total")).alias("modal_share"), F.count("*").alias("n_segments"))
    )
