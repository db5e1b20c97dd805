"""Queries on saved scores and on files: what follows a model fit, and every reader and writer.

Scores are numbers derived from the test receptors, as a model elsewhere would have saved them, and
files go to the shared folder and are read back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.fixed import FRACTIONS, SCHEMES, SEED, SEEDS
from junctura.operators import metrics, ngrams, reports, resampling
from junctura.operators.cleaning import CLONOTYPE, clean_records
from junctura.plans import benchmark as paired
from junctura.plans import unseen
from junctura.plans.dataset import build_dataset
from junctura.session import shared_dir, stage
from junctura.sources import records, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ARMS = ["morpheme", "kmer3", "vjonly"]
SERIES = ["delta_seen", "delta_unseen", "morpheme_seen", "kmer3_seen", "vjonly_seen"]
TARGETS = [0.02, 0.05, 0.10]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _score(k: Column | int, modulus: Column | int = 23) -> Column:
    """A whole number in place of a model's margin."""
    k = k if isinstance(k, Column) else F.lit(k)
    first = F.ascii(F.substring("CDR3b", 2, 1))
    return F.pmod(first * (k + 2) + F.length("CDR3b") * 7 + F.ascii(F.substring("CDR3a", 3, 1)) * k, modulus)


def _arms(names: list[str], shift: Column | int = 0) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(a).alias("arm"), (F.lit(k + 1) + shift).alias("k")) for k, a in enumerate(names)])
    )


def saved_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(arm, Peptide, Label, score) of three models over the test pairs."""
    rows = tables.challenge(spark, sf).withColumn("a", _arms(ARMS))
    return rows.select("a.arm", "Peptide", "Label", _score(F.col("a.k")).cast("double").alias("score"))


def _per_peptide(spark: SparkSession, sf: str) -> DataFrame:
    return paired.peptide_scores(saved_scores(spark, sf), tables.binders(spark, sf))


@query
def benchmark_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Partial AUC by arm and peptide, with whether training knows the peptide."""
    return _rounded(_per_peptide(spark, sf), "auc01")


@query
def benchmark_means(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(paired.seen_unseen(_per_peptide(spark, sf)), "all", "seen", "unseen")


@query
def benchmark_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Paired intervals of two arms over all, seen and unseen peptides."""
    compared = paired.compare_arms(stage(_per_peptide(spark, sf)), "morpheme", "kmer3")
    return _rounded(compared, "delta", "lo", "hi")


def _scheme_means(spark: SparkSession, sf: str) -> DataFrame:
    schemes = F.explode(
        F.array(*[F.struct(F.lit(s).alias("scheme"), F.lit(i).alias("i")) for i, s in enumerate(SCHEMES)])
    )
    rows = tables.challenge(spark, sf).withColumn("s", schemes).withColumn("a", _arms(ARMS, F.col("s.i") * 3))
    scored = rows.select(
        "s.scheme", "a.arm", "Peptide", "Label", _score(F.col("a.k"), F.col("s.i") + 19).cast("double").alias("score")
    )
    by = ["scheme", "arm"]
    return paired.seen_unseen(paired.peptide_scores(scored, tables.binders(spark, sf), by), by)


@query
def scheme_means(spark: SparkSession, sf: str) -> DataFrame:
    """All, seen and unseen means by scheme of negatives and arm."""
    return _rounded(_scheme_means(spark, sf), "all", "seen", "unseen")


@query
def scheme_verdict(spark: SparkSession, sf: str) -> DataFrame:
    verdict = reports.scheme_verdict(stage(_scheme_means(spark, sf)))
    return _rounded(verdict, "full_size_delta", "reduced_size_delta")


def _seed_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Gap of two arms by seed and epitope, from scores that a fit of each seed would have saved."""
    seeds = F.explode(
        F.array(*[F.struct(F.lit(SEED + 1000 * i).alias("seed"), F.lit(i).alias("i")) for i in range(SEEDS)])
    )
    rows = tables.challenge(spark, sf).withColumn("s", seeds).withColumn("a", _arms(ARMS[:2], F.col("s.i") * 2))
    scored = rows.select(
        "s.seed",
        "a.arm",
        F.col("Peptide").alias("epitope"),
        F.col("Label").alias("label"),
        _score(F.col("a.k")).cast("double").alias("score"),
    )
    return stage(unseen.epitope_deltas(scored))


@query
def epitope_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of the two arms' AUC for every seed and epitope with enough of both classes."""
    return _rounded(_seed_deltas(spark, sf), "delta")


@query
def unseen_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds in favour, the pooled interval of the differences, and the statement that follows."""
    verdict = unseen.unseen_verdict(_seed_deltas(spark, sf), control_ok=True)
    return _rounded(verdict, "mean", "sd", "lo", "hi")


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    """Means by share of the test pairs, arms side by side, with their gaps."""
    place = F.pmod(F.length("CDR3a") * 7 + F.ascii(F.substring("CDR3b", 3, 1)) * 13, F.lit(100)) / 100.0
    shares = F.explode(F.array(*[F.lit(f) for f in FRACTIONS]))
    kept = stage(tables.challenge(spark, sf).withColumn("fraction", shares).filter(place < F.col("fraction")))
    scored = kept.withColumn("a", _arms(ARMS)).select(
        "fraction", "a.arm", "Peptide", "Label", _score(F.col("a.k")).cast("double").alias("score")
    )
    by = ["fraction", "arm"]
    means = paired.seen_unseen(paired.peptide_scores(scored, tables.binders(spark, sf), by), by)
    sizes = kept.groupBy("fraction").agg(F.count("*").alias("pairs"))
    curve = means.join(sizes, "fraction").groupBy("fraction", "pairs").agg(
        *[
            F.max(F.when(F.col("arm") == arm, F.col(v))).alias(f"{arm}_{v}")
            for arm in ARMS
            for v in ("all", "seen", "unseen")
        ]
    )
    return curve.withColumns(
        {
            "delta_seen": F.col("morpheme_seen") - F.col("kmer3_seen"),
            "delta_unseen": F.col("morpheme_unseen") - F.col("kmer3_unseen"),
            "delta_vs_vjonly_seen": F.col("morpheme_seen") - F.col("vjonly_seen"),
        }
    )


def _curve_file(spark: SparkSession, sf: str) -> DataFrame:
    """The curve, written as one list and read back."""
    path = _folder(spark, "curve")
    sinks.write_curve(_curve(spark, sf), path)
    return records.read_curve(spark, path)


@query
def curve_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = _curve_file(spark, sf)
    return _rounded(rows, *[c for c in rows.columns if c not in ("fraction", "pairs")])


def _series(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).alias("value")) for s in SERIES])
    rows = _curve_file(spark, sf).select("pairs", F.explode(cells).alias("c")).select("pairs", "c.*")
    return resampling.fit_curve(stage(rows), "pairs", "value", ["series"])


@query
def curve_series(spark: SparkSession, sf: str) -> DataFrame:
    """Slope, correlation and ends of the five series of the curve."""
    fitted = _series(spark, sf).withColumn("shape", resampling.curve_shape())
    return _rounded(fitted, "slope", "intercept", "r", "upper_slope", "first_value", "last_value")


@query
def curve_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Logarithm of the size at which the unseen gap would reach each target."""
    fitted = _series(spark, sf).filter("series = 'delta_unseen'")
    reach = [F.struct(F.lit(t).alias("target"), F.log(resampling.size_to_reach(t)).alias("log_size")) for t in TARGETS]
    return _rounded(fitted.select(F.explode(F.array(*reach)).alias("r")).select("r.*"), "log_size")


@query
def scores_file(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by arm and peptide, written as one document and read back."""
    path = _folder(spark, "scores")
    sinks.write_document(paired.per_peptide_document(stage(_per_peptide(spark, sf))), path)
    return _rounded(records.read_scores(spark, path), "auc01")


@query
def predictions_file(spark: SparkSession, sf: str) -> DataFrame:
    """An outside model's predictions, written, read back and scored by peptide, best first."""
    path = _folder(spark, "predictions")
    rows = tables.challenge(spark, sf).withColumn("score", _score(5).cast("double"))
    sinks.write_predictions(rows, path)
    scored = paired.score_predictions(records.read_predictions(spark, path, "score"), tables.binders(spark, sf), "score")
    placed = metrics.best_first(scored, "auc01", ["Peptide"])
    return _rounded(placed.select("Peptide", "n_pos", "n_neg", "auc01", "seen", "place"), "auc01")


@query
def chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records written as chunks with two orders of columns, read by name and cleaned."""
    path = _folder(spark, "chunks")
    raw = tables.receptor_records(spark, sf)
    names = [f"`{c}`" for c in raw.columns]
    odd = F.pmod(F.xxhash64(*names), F.lit(2)) == 1
    sinks.write_tsv(raw.filter(odd), path)
    rest = raw.filter(~odd).select(*reversed(names), F.lit("x").alias("more"))
    rest.write.mode("append").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    return clean_records(records.read_chunks(spark, path, glob="part-*"))


@query
def pair_files(spark: SparkSession, sf: str) -> DataFrame:
    """Training and test pairs written once as two files with other orders of columns, read by name, also together."""
    path = _folder(spark, "pairs")
    rows = tables.paired_records(spark, sf).withColumnRenamed("Label", "Target")
    sinks.write_csv(rows.filter("part = 'train'"), f"{path}/train")
    sinks.write_csv(rows.filter("part = 'test'").select(*reversed(rows.columns)), f"{path}/test")
    parts = {
        "binders": records.read_binders(spark, f"{path}/train"),
        "test": records.read_pairs(spark, f"{path}/test", "Target").filter("Target = 1"),
        "both": records.read_pairs(spark, f"{path}/*", "Target").filter("Target = 0"),
    }
    counted = [
        df.groupBy("Peptide", "HLA").agg(
            F.count("*").alias("n"), F.count("CDR1a").alias("loops"), F.sum(F.length("CDR3b")).alias("chars")
        ).withColumn("part", F.lit(name))
        for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query
def annotated_file(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed clonotypes written without their studies and read back."""
    path = _folder(spark, "annotated")
    sinks.write_annotated(build_dataset(tables.receptor_records(spark, sf)).annotated, path)
    rows = records.read_chunks(spark, path, sinks.ANNOTATED_COLUMNS, "part-*")
    return rows.select(*CLONOTYPE, "v_prefix", "n_region", "j_suffix", F.col("n_rows").cast("long").alias("n_rows"))


@query
def enrichment_file(spark: SparkSession, sf: str) -> DataFrame:
    """The formatted enrichment table written and read back."""
    path = _folder(spark, "enrichment")
    annotated = stage(build_dataset(tables.receptor_records(spark, sf)).annotated)
    report = ngrams.enrichment_report(ngrams.enrichment(annotated))
    sinks.write_tsv(report, path)
    rows = records.read_chunks(spark, path, report.columns, "part-*")
    return rows.select(*[F.col(c).cast(t) for c, t in report.dtypes])


@query
def export_files(spark: SparkSession, sf: str) -> DataFrame:
    """The three tables for an outside network, written, read back and counted by peptide."""
    path = _folder(spark, "export")
    sinks.write_export(paired.external_export(tables.binders(spark, sf), tables.challenge(spark, sf)), path)
    names = ["A1", "A2", "A3", "B1", "B2", "B3", "peptide", "binder", "partition"]
    parts = [
        records.read_named(spark, f"{path}/{part}", names).withColumn("part", F.lit(part))
        for part in ("train", "val", "test")
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("part", "peptide").agg(
        F.count("*").alias("n"),
        F.sum(F.col("binder").cast("int")).alias("binders"),
        F.sum(F.length(F.concat("A1", "A2", "A3", "B1", "B2", "B3"))).alias("chars"),
    )
