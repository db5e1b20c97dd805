"""Receptor records derived from the line-item table by integer arithmetic and slicing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.fixed import RESIDUES
from junctura.session import stage

V_STARTS = "CASS CSAR CSVG CAWS CATS CASR CSAS CAIS".split()
J_ENDS = "YEQYF NEQFF DTQYF YGYTF TEAFF GELFF".split()
V_GENES = "TRBV19 TRBV20-1 TRBV29-1 TRBV30 TRBV15 TRBV27 TRBV5-9 TRBV10-3".split()
J_GENES = "TRBJ2-7 TRBJ2-1 TRBJ2-3 TRBJ1-2 TRBJ1-1 TRBJ2-2".split()
PEPTIDES = ["GILGFVFTL", "NLVPMVATV", "GLCTLVAML", "GILGFVFTV", "ELAGIGILTV"]
# Enough epitopes for five folds with several in each.
MANY_PEPTIDES = [
    *PEPTIDES,
    *"""
    LLWNGPMAV KLGGALQAK RAKFKQLL AVFDRKSDAK TTDPSFLGRY YLQPRTFLL IVTDFSVIK SPRWYFYYL LTDEMIAQY RLRAEAQVK
    ATDALMTGF NQKLIANQF KRWIILGLNK TPRVTGGGAM RPHERNGFTVL CINGVCWTV FLKEKGGL KAFSPEVIPMF EAAGIGILTV GTSGSPIVNR
    """.split(),
]


_written: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write derived records on first use in a session; later queries read them as files."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = stage(build())
    return _written[key]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entry(values: list[str], index: Column) -> Column:
    """The index-th of some equally or unequally long fixed words."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _residue(index: Column) -> Column:
    return F.substring(F.lit(RESIDUES), (index % 20).cast("int") + 1, F.lit(1))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, ln, pk, sk = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    numbers = load(spark, sf_dir, "lineitem").select(
        ok.alias("ok"), pk.alias("pk"), sk.alias("sk"), (ok * 8 + ln).alias("rid")
    )
    # A small file is a single split; spread its few columns over every core. By a key, as rows that are
    # dealt out in turn are sorted first.
    numbers = numbers.repartition(spark.sparkContext.defaultParallelism, "rid")
    ok, pk, sk, rid = (F.col(c) for c in ("ok", "pk", "sk", "rid"))
    numbers = numbers.select(
        "ok", "pk", "sk", "rid", (sk % 8).alias("vi"), (pk % 6).alias("ji"), ((pk + sk) % 5).alias("ei")
    )
    vi, ji, ei = (F.col(c) for c in ("vi", "ji", "ei"))
    v_full, j_full = _entry(V_STARTS, vi), _entry(J_ENDS, ji)
    r0 = rid % 10007
    region = F.concat(
        _residue(vi * 3 + ok % 4),
        _residue(ok * 7 + pk),
        F.when((ei == 0) & (ok % 3 == 0), "RS").otherwise(""),
        F.when(ok % 2 == 0, _residue(pk * 11 + ok)).otherwise(""),
        _residue(ji * 5 + ok % 3),
    )
    cdr3 = F.concat(
        F.when(r0 % 9 == 0, F.substring(v_full, 1, 3)).otherwise(v_full),
        region,
        F.when(r0 % 11 == 0, F.right(j_full, F.lit(4))).otherwise(j_full),
        F.when(r0 % 997 == 0, F.concat(F.lit("GPG"), j_full))
        .when(r0 % 13 == 0, "F")
        .otherwise(""),
    )
    return numbers.select(
        "*",
        cdr3.alias("cdr3"),
        v_full.alias("v_full"),
        j_full.alias("j_full"),
        _entry(V_GENES, vi).alias("v_gene"),
        _entry(J_GENES, ji).alias("j_gene"),
        F.concat(_entry(V_GENES, vi), F.when(rid % 3 == 0, "*01").otherwise("")).alias("v_call"),
        F.concat(_entry(J_GENES, ji), F.when(rid % 4 == 0, "*01").otherwise("")).alias("j_call"),
    )


def receptor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw single-chain records with the usual blemishes: case, blanks, other species, gaps."""
    return _once(spark, sf_dir, "receptors", lambda: _receptors(spark, sf_dir))


def many_receptor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records over ``MANY_PEPTIDES``, for experiments that hold out folds of epitopes."""
    epitope = _entry(MANY_PEPTIDES, (F.col("pk") + F.col("sk")) % len(MANY_PEPTIDES))
    return _once(spark, sf_dir, "many receptors", lambda: _receptors(spark, sf_dir, epitope))


def _receptors(spark: SparkSession, sf_dir: str, epitope: Column | None = None) -> DataFrame:
    ok, pk, rid = F.col("ok"), F.col("pk"), F.col("rid")
    return _base(spark, sf_dir).select(
        F.when(rid % 31 == 0, F.concat(F.lit(" "), F.lower("cdr3"), F.lit(" ")))
        .when(rid % 43 == 0, F.concat(F.col("cdr3"), F.lit("X")))
        .otherwise(F.col("cdr3"))
        .alias("cdr3.beta"),
        F.col("v_call").alias("v.beta"),
        F.when(rid % 53 == 0, "").otherwise(F.col("j_call")).alias("j.beta"),
        (_entry(PEPTIDES, F.col("ei")) if epitope is None else epitope).alias("antigen.epitope"),
        F.when(rid % 29 == 0, "MusMusculus").otherwise("HomoSapiens").alias("species"),
        F.concat(F.lit("HLA-A*0"), (pk % 3 + 1).cast("string")).alias("mhc.a"),
        F.when(ok % 23 == 7, "")
        .otherwise(F.concat(F.lit("S"), (ok % 23).cast("string")))
        .alias("reference.id"),
    )


def segment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Germline segment rows: the full and the shortened contribution of every gene seen."""
    base = _base(spark, sf_dir)
    sides = [("V", "v_gene", "v_full"), ("J", "j_gene", "j_full")]
    forms = [
        F.struct(
            F.col(gene).alias("segm"),
            part.alias("cdr3"),
            F.lit(side).alias("type"),
        )
        for side, gene, full in sides
        for part in (F.col(full), F.right(F.col(full), F.lit(3)))
    ]
    return (
        base.select(F.explode(F.array(*forms)).alias("s"))
        .select("s.*")
        .distinct()
        .select(F.lit("HomoSapiens").alias("species"), F.lit("TRB").alias("gene"), "*")
    )


def paired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired-chain rows, repeats included. ``part`` is train or test; some peptides occur in test only."""
    return _once(spark, sf_dir, "pairs", lambda: _pairs(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, pk, sk, rid, vi, ei = (F.col(c) for c in ("ok", "pk", "sk", "rid", "vi", "ei"))
    in_test = ok % 5 == 0
    label = F.when(~in_test | (rid % 6 == 0), 1).otherwise(0)
    # The variants of the last peptide occur in test rows only; training has another in their place.
    family = (
        F.when(~in_test & (ok % 4 == 0) & (ei == 4), 3)
        .when(label == 1, ei)
        .otherwise((ei + 1 + rid % 4) % 5)
    )
    peptide = _entry(PEPTIDES, family)
    variant = F.concat(
        F.substring(peptide, 1, 4), _residue(pk * 7 + sk), F.substring(peptide, 6, 10)
    )
    twice = F.lit(RESIDUES + RESIDUES)

    def run(start: Column, size: Column) -> Column:
        return F.substring(twice, start.cast("int"), size)

    return (
        _base(spark, sf_dir)
        .select(
            F.when(in_test, "test").otherwise("train").alias("part"),
            F.when(ok % 4 == 0, variant).otherwise(peptide).alias("Peptide"),
            F.concat(F.lit("HLA-A*0"), (family % 3 + 1).cast("string")).alias("HLA"),
            F.concat(F.lit("TRAV"), (pk % 7 + 1).cast("string")).alias("Va"),
            F.concat(F.lit("TRAJ"), (pk % 5 + 1).cast("string")).alias("Ja"),
            F.when(rid % 17 != 0, run(pk % 7 * 2 + 1, F.lit(6))).alias("CDR1a"),
            run(pk % 5 * 3 + 1, F.when(rid % 19 == 0, 9).otherwise(7)).alias("CDR2a"),
            F.concat(
                F.lit("AV"), _residue(ok), run(pk % 11 + 1, F.lit(3)), F.lit("KLT")
            ).alias("CDR3a"),
            F.col("v_call").alias("Vb"),
            F.col("j_call").alias("Jb"),
            run(vi * 2 + 1, F.lit(5)).alias("CDR1b"),
            run(vi * 3 + 2, F.lit(6)).alias("CDR2b"),
            F.substring("cdr3", F.lit(2), F.length("cdr3") - 2).alias("CDR3b"),
            F.when(~in_test & (rid % 67 == 0), 0).otherwise(label).alias("Label"),
        )
    )


def binders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training positives."""
    return (
        paired_records(spark, sf_dir)
        .filter((F.col("part") == "train") & (F.col("Label") == 1))
        .drop("part", "Label")
    )


def challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with their labels."""
    return paired_records(spark, sf_dir).filter(F.col("part") == "test").drop("part")
