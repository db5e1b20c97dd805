"""Splitting clonotypes around their anchors, with the reasons for those that drop out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.fixed import ANCHOR_FULL, ANCHOR_MIN_J, ANCHOR_USABLE, TRAILING
from junctura.functions.parse import interior, j_suffix, v_prefix
from junctura.operators.anchors import derive_anchors
from junctura.session import stage


def _full_j(anchors: DataFrame) -> DataFrame:
    return (
        anchors.filter((F.col("side") == "J") & (F.length("anchor") >= ANCHOR_FULL))
        .select("anchor")
        .distinct()
    )


def contains_full_j(rows: DataFrame, anchors: DataFrame, text: Column, flag: str) -> DataFrame:
    """Flag rows whose ``text`` contains any J anchor of at least four residues.

    There is at most one anchor a gene, so they come as one array of a subquery and nothing is shuffled.
    """
    known = _full_j(anchors).agg(F.array_sort(F.collect_set("anchor"))).scalar()
    found = F.exists(F.col("_known"), lambda anchor: F.contains(F.col("_text"), anchor))
    return (
        rows.withColumns({"_text": text, "_known": known})
        .withColumn(flag, F.coalesce(found, F.lit(False)))
        .drop("_text", "_known")
    )


def with_anchors(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Add ``v_anchor`` and ``j_anchor``; the anchor table's written size decides the join."""
    by_v = anchors.filter("side = 'V'").select(F.col("gene").alias("v"), F.col("anchor").alias("v_anchor"))
    by_j = anchors.filter("side = 'J'").select(F.col("gene").alias("j"), F.col("anchor").alias("j_anchor"))
    return rows.join(by_v, "v", "left").join(by_j, "j", "left")


def with_parts(rows: DataFrame, usable: int = ANCHOR_USABLE, min_v: int = 1, min_j: int = ANCHOR_MIN_J) -> DataFrame:
    """Replace ``v_anchor`` and ``j_anchor`` by ``v_prefix``, ``n_region`` and ``j_suffix``.

    All three are null unless both anchors have ``usable`` residues and the sequence parses.
    """
    cdr3, v, j = F.col("cdr3"), F.col("v_anchor"), F.col("j_anchor")
    known = (F.length(v) >= usable) & (F.length(j) >= usable)
    kept = [c for c in rows.columns if c not in ("v_anchor", "j_anchor")]
    found = rows.select(
        *kept,
        F.when(known, v_prefix(cdr3, v, min_v)).alias("_v"),
        F.when(known, j_suffix(cdr3, j, min_j)).alias("_j"),
    ).select(*kept, "_v", "_j", interior(cdr3, F.col("_v"), F.col("_j")).alias("n_region"))
    parsed = F.col("n_region").isNotNull()
    return found.select(
        *kept,
        F.when(parsed, F.col("_v")).alias("v_prefix"),
        "n_region",
        F.when(parsed, F.col("_j")).alias("j_suffix"),
    )


def parse(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every row with ``v_prefix``, ``n_region``, ``j_suffix`` and its ``status``.

    A row is malformed when a full J anchor already ends more than two residues before the
    end of the sequence, that is, when the sequence without its last three residues contains
    one. The parts of a malformed row are null.
    """
    body = F.substring(F.col("cdr3"), F.lit(1), F.length("cdr3") - (TRAILING + 1))
    flagged = contains_full_j(rows, anchors, body, "_malformed")
    anchored = with_anchors(flagged, anchors)
    for side in ("v_anchor", "j_anchor"):
        anchored = anchored.withColumn(side, F.when(~F.col("_malformed"), F.col(side)))
    return with_parts(anchored).select(
        *rows.columns,
        "v_prefix",
        "n_region",
        "j_suffix",
        F.when(F.col("_malformed"), "malformed")
        .when(F.col("n_region").isNull(), "unparsed")
        .otherwise("parsed")
        .alias("status"),
    )


def annotate(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    return parse(rows, anchors).filter(F.col("status") == "parsed").drop("status")


def parse_stats(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    return parse(rows, anchors).groupBy("status").agg(F.count("*").alias("n"))


def leaking(annotated: DataFrame, anchors: DataFrame) -> DataFrame:
    """Parsed rows whose interior still contains a full J anchor; there must be none."""
    return contains_full_j(annotated, anchors, F.col("n_region"), "_leak").filter("_leak").drop("_leak")


def require_no_leak(annotated: DataFrame, anchors: DataFrame) -> None:
    examples = leaking(annotated, anchors).select("cdr3", "v", "j", "n_region").take(5)
    if examples:
        raise ValueError(f"interior contains a J anchor: {[tuple(e) for e in examples]}")


def staged_anchors(rows: DataFrame, **options: float) -> DataFrame:
    """Derive the anchors of ``rows`` once and write them, so that their size is known."""
    return stage(derive_anchors(rows, **options))
