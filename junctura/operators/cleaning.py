"""From raw records to unique clonotypes with their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.fixed import MIN_SEQUENCE, SPECIES
from junctura.functions.sequence import base_gene, residues, strip

CLONOTYPE = ["cdr3", "v", "j", "epitope"]
RAW_COLUMNS = [
    "cdr3.beta",
    "v.beta",
    "j.beta",
    "antigen.epitope",
    "species",
    "mhc.a",
    "reference.id",
]


def clean_records(raw: DataFrame, species: str = SPECIES, min_length: int = MIN_SEQUENCE) -> DataFrame:
    """Complete records of one species with canonical residues, normalised; other columns stay."""
    extra = [c for c in raw.columns if c not in RAW_COLUMNS]
    return (
        raw.filter(F.col("species") == species)
        .select(
            residues("`cdr3.beta`", min_length).alias("cdr3"),
            base_gene("`v.beta`").alias("v"),
            base_gene("`j.beta`").alias("j"),
            residues("`antigen.epitope`").alias("epitope"),
            strip("`mhc.a`").alias("mhc"),
            F.coalesce(F.nullif(strip("`reference.id`"), F.lit("")), F.lit("unknown")).alias("study"),
            *extra,
        )
        .filter((F.col("v") != "") & (F.col("j") != "") & F.col("cdr3").isNotNull() & F.col("epitope").isNotNull())
    )


def annotated_records(raw: DataFrame, species: str = SPECIES) -> DataFrame:
    """The weaker filter of the first analysis: four fields present, one species, text as is."""
    fields = ["cdr3.beta", "v.beta", "j.beta", "antigen.epitope"]
    kept = raw.filter(F.col("species") == species)
    for field in fields:
        kept = kept.filter(strip(f"`{field}`") != "")
    return kept


def unique_clonotypes(clean: DataFrame, first_by: str | None = None) -> DataFrame:
    """One row per (cdr3, v, j, epitope) with its record count and sorted distinct studies.

    The other field comes from the first record by ``first_by``, or is the smallest value. Equal records
    are counted before the studies are gathered, as sets make every task sort what it gathers them from.
    """
    studies = F.array_sort(F.collect_set("study")).alias("studies")
    if first_by:
        mhc = F.min_by("mhc", first_by).alias("mhc")
        return clean.groupBy(*CLONOTYPE).agg(mhc, F.count("*").alias("n_rows"), studies)
    equal = clean.groupBy(*CLONOTYPE, "mhc", "study").agg(F.count("*").alias("n"))
    return equal.groupBy(*CLONOTYPE).agg(F.min("mhc").alias("mhc"), F.sum("n").alias("n_rows"), studies)


def row_inflation(clean: DataFrame) -> DataFrame:
    """Records, unique clonotypes and their ratio, overall."""
    return (
        clean.groupBy(*CLONOTYPE)
        .agg(F.count("*").alias("n"))
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"))
        .select("*", F.try_divide("n_rows", "n_unique").alias("inflation"))
    )

