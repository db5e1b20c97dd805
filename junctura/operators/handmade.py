"""The first, superseded analysis: hand-made germline tables and a per-epitope summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from junctura.fixed import HAND_J, HAND_V
from junctura.functions.sequence import kmers
from junctura.operators.annotate import with_parts


FIELDS = ["cdr3.beta", "v.beta", "j.beta", "antigen.epitope", "species"]


def counted_records(raw: DataFrame) -> DataFrame:
    """Distinct values of the fields that the filter and the parse read, with the number of records ``n``.

    Both go by these fields alone, so equal records need them once.
    """
    return raw.groupBy(*[F.col(f"`{c}`") for c in FIELDS]).agg(F.count("*").alias("n"))


def _records(parsed: DataFrame) -> Column:
    return F.col("n") if "n" in parsed.columns else F.lit(1)


def hand_parsed(records: DataFrame) -> DataFrame:
    """Parts of every record by the fixed tables: a V prefix of two or more residues and a J
    suffix of one or more; null where the tables do not cover it. Alleles share their gene's row.
    A column ``n`` of :func:`counted_records` is kept, and the tables below count a row as so many.
    """
    rows = records.select(
        *[c for c in records.columns if c == "n"],
        F.col("`antigen.epitope`").alias("epitope"),
        F.col("`cdr3.beta`").alias("cdr3"),
        F.col("`v.beta`").alias("v"),
        F.col("`j.beta`").alias("j"),
    )
    for side, table in (("v", HAND_V), ("j", HAND_J)):
        pairs = list(table.items())
        # A fixed table of at most some thirty genes.
        genes = F.broadcast(
            rows.sparkSession.createDataFrame(pairs, f"_{side} string, {side}_anchor string")
        )
        rows = (
            rows.withColumn(f"_{side}", F.split_part(side, F.lit("*"), F.lit(1)))
            .join(genes, f"_{side}", "left")
            .drop(f"_{side}")
            .withColumn(f"{side}_anchor", F.when(F.length("cdr3") >= 5, F.col(f"{side}_anchor")))
        )
    return with_parts(rows, usable=1, min_v=2, min_j=1)


def summary(parsed: DataFrame) -> DataFrame:
    """Records, parsed records and rate by epitope."""
    total = F.sum(_records(parsed))
    done = F.sum(F.when(F.col("n_region").isNotNull(), _records(parsed)).otherwise(0))
    return parsed.groupBy("epitope").agg(
        total.alias("total"), done.alias("parsed"), (100.0 * done / total).alias("rate")
    )


def _top(counts: DataFrame, value: str, limit: int) -> DataFrame:
    """The ``limit`` most frequent values of each epitope with their share in percent."""
    totals = counts.groupBy("epitope").agg(F.sum("n").alias("total"))
    order = W.partitionBy("epitope").orderBy(F.col("n").desc(), value)
    ranked = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return ranked.join(totals, "epitope").select(
        "epitope", "place", value, "n", (100.0 * F.col("n") / F.col("total")).alias("share")
    )


def top_regions(parsed: DataFrame, limit: int = 15) -> DataFrame:
    filled = parsed.filter(F.col("n_region") != "")
    return _top(filled.groupBy("epitope", "n_region").agg(F.sum(_records(parsed)).alias("n")), "n_region", limit)


def region_bigrams(parsed: DataFrame) -> DataFrame:
    """Occurrences of every bigram by epitope; equal interiors are cut up once."""
    filled = parsed.filter(F.col("n_region") != "").groupBy("epitope", "n_region").agg(F.sum(_records(parsed)).alias("n"))
    return filled.select("epitope", "n", F.explode(kmers("n_region", 2)).alias("gram")).groupBy("epitope", "gram").agg(
        F.sum("n").alias("n")
    )


def top_bigrams(parsed: DataFrame, limit: int = 10) -> DataFrame:
    return _top(region_bigrams(parsed), "gram", limit)


def region_lengths(parsed: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` shortest interior lengths of each epitope and their counts."""
    counts = (
        parsed.filter(F.col("n_region") != "")
        .groupBy("epitope", F.length("n_region").alias("length"))
        .agg(F.sum(_records(parsed)).alias("n"))
    )
    order = W.partitionBy("epitope").orderBy("length")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("place")
