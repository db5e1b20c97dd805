"""The shared early steps and the single-chain analyses built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from junctura.fixed import ANCHOR_SUPPORT, EPITOPE_CAP, EPITOPE_FLOOR, EPITOPES
from junctura.operators import annotate as parsing
from junctura.operators.cleaning import clean_records, unique_clonotypes
from junctura.operators.splits import capped, top_groups
from junctura.session import stage


@dataclass(frozen=True)
class Dataset:
    """Written clonotypes and anchors, and the plans that read them."""

    clonotypes: DataFrame
    anchors: DataFrame

    @property
    def parsed_all(self) -> DataFrame:
        return parsing.parse(self.clonotypes, self.anchors)

    @property
    def annotated(self) -> DataFrame:
        return parsing.annotate(self.clonotypes, self.anchors)


def build_dataset(raw: DataFrame, min_support: int = ANCHOR_SUPPORT) -> Dataset:
    """Clean, collapse to clonotypes, write them once, and derive the anchors from that table.

    Every later pass reads the written clonotypes with only the columns it needs.
    """
    clonotypes = stage(unique_clonotypes(clean_records(raw)))
    return Dataset(clonotypes, parsing.staged_anchors(clonotypes, min_support=min_support))


def largest_epitopes(
    annotated: DataFrame, floor: int = EPITOPE_FLOOR, limit: int = EPITOPES, cap: int | None = EPITOPE_CAP
) -> DataFrame:
    """Clonotypes of the best represented epitopes, capped per epitope."""
    keep = stage(top_groups(annotated, "epitope", floor, limit)).select("epitope")
    rows = annotated.join(keep, "epitope", "left_semi")
    return capped(stage(rows), "epitope", cap=cap) if cap else rows
