"""Do real interiors outscore decoys under models of held-out studies, and at which trims?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.fixed import MIN_REGION, SEED, TRIMS
from junctura.functions.sequence import trimmed
from junctura.operators.cleaning import CLONOTYPE
from junctura.operators.decoys import residue_weights, shuffled_decoy, with_resampled_decoy
from junctura.operators.language import fit_lengths, length_logprob, score_models
from junctura.operators.metrics import auc
from junctura.operators.resampling import auc_gap_interval
from junctura.operators.splits import permuted_labels, study_holdout
from junctura.session import stage

MODELS = ["length", "flat", "morpheme", "permuted"]
UNTRIMMED = TRIMS[:1]


def held_out_rows(annotated: DataFrame, seed: int = SEED, min_region: int = MIN_REGION) -> DataFrame:
    """Long enough interiors with their side of the study split and permuted segment labels."""
    rows = stage(annotated.select(*CLONOTYPE, "studies", "n_region").filter(F.length("n_region") >= min_region))
    return stage(permuted_labels(stage(study_holdout(rows, seed)), CLONOTYPE, ["v", "j"], seed))


def trimmed_rows(rows: DataFrame, trims: Sequence[tuple[str, int, int]], min_region: int = MIN_REGION) -> DataFrame:
    """The rows under every trim setting, as ``trim`` and ``real``; too short ones drop out."""
    settings = F.array(
        *[F.struct(F.lit(n).alias("trim"), F.lit(a).alias("l"), F.lit(b).alias("r")) for n, a, b in trims]
    )
    return (
        rows.withColumn("_s", F.explode(settings))
        .withColumn("trim", F.col("_s.trim"))
        .withColumn("real", trimmed("n_region", F.col("_s.l"), F.col("_s.r")))
        .drop("_s")
        .filter(F.length("real") >= min_region)
    )


def scored_pairs(
    rows: DataFrame,
    trims: Sequence[tuple[str, int, int]] = UNTRIMMED,
    decoys: Sequence[str] = ("shuffled", "resampled"),
    seed: int = SEED,
) -> DataFrame:
    """Log-probability of every held-out interior (label 1) and its decoy (label 0), by model."""
    cut = trimmed_rows(rows, trims)
    train = stage(cut.filter(~F.col("held_out")))
    made = cut.filter("held_out")
    if "resampled" in decoys:
        made = with_resampled_decoy(made, "real", residue_weights(train, "real"), CLONOTYPE, "resampled", seed)
    if "shuffled" in decoys:
        made = made.withColumn("shuffled", shuffled_decoy("real", *CLONOTYPE, seed=seed))
    kinds = F.array(*[F.struct(F.lit(d).alias("decoy"), F.col(d).alias("fake")) for d in decoys])
    pairs = (
        stage(made)
        .withColumn("_d", F.explode(kinds))
        .filter(F.col("_d.fake").isNotNull())
        .select(*CLONOTYPE, "fake_v", "fake_j", "trim", "real", "_d.decoy", "_d.fake")
        .withColumn(
            "_t",
            F.explode(
                F.array(
                    F.struct(F.lit(1).alias("label"), F.col("real").alias("text")),
                    F.struct(F.lit(0).alias("label"), F.col("fake").alias("text")),
                )
            ),
        )
        .select(*CLONOTYPE, "fake_v", "fake_j", "trim", "decoy", "_t.label", "_t.text")
    )
    labels = {"morpheme": ("v", "j"), "permuted": ("fake_v", "fake_j")}
    scored = score_models(train, pairs, "text", labels, ["trim"], train_text="real")
    lengths = stage(fit_lengths(train, "real", ["trim"]))
    totals = lengths.groupBy("trim").agg(F.max("total").alias("_total"))
    return (
        scored.withColumn("length", F.length("text"))
        .join(lengths.select("trim", "length", F.col("n").alias("_n")), ["trim", "length"], "left")
        .join(totals, "trim", "left")
        .withColumn("length", length_logprob(F.col("_n"), F.col("_total")))
        .select(*CLONOTYPE, "trim", "decoy", "label", "text", *MODELS)
    )


def model_aucs(scored: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """AUC of real against decoy by trim, decoy and model."""
    values = F.array(*[F.struct(F.lit(m).alias("model"), F.round(m, 9).alias("score")) for m in models])
    long = scored.select("trim", "decoy", "label", F.explode(values).alias("m")).select(
        "trim", "decoy", "label", "m.*"
    )
    return auc(long, ["trim", "decoy", "model"], "score", "label")


def gap_intervals(scored: DataFrame, better: str = "morpheme", base: str = "flat", seed: int = SEED) -> DataFrame:
    """Paired bootstrap interval of the AUC gap between two models, by trim and decoy."""
    sides = {(m, y): f"{m}_{y}" for m in (better, base) for y in (1, 0)}
    items = scored.groupBy(*CLONOTYPE, "trim", "decoy").agg(
        *[F.max(F.when(F.col("label") == y, F.round(m, 9))).alias(name) for (m, y), name in sides.items()]
    )
    models = {m: (sides[m, 1], sides[m, 0]) for m in (better, base)}
    return auc_gap_interval(items, CLONOTYPE, models, ["trim", "decoy"], seed=seed)


def grammaticality(annotated: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """AUCs of all models against both decoys, and the intervals of the conditioned gain."""
    scored = stage(scored_pairs(held_out_rows(annotated, seed), seed=seed))
    return model_aucs(scored), gap_intervals(scored, seed=seed)


def trim_control(annotated: DataFrame, seed: int = SEED, intervals: bool = True) -> DataFrame:
    """The same under eight trims against shuffled decoys: gap, interval and share retained."""
    rows = held_out_rows(annotated, seed)
    scored = stage(scored_pairs(rows, TRIMS, ["shuffled"], seed))
    areas = model_aucs(scored, ["flat", "morpheme", "permuted"])

    def of(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("auc")))

    table = stage(
        areas.groupBy("trim").agg(
            F.max("n_pos").alias("pairs"),
            of("flat").alias("flat"),
            of("morpheme").alias("morpheme"),
            of("permuted").alias("permuted"),
            (of("morpheme") - of("flat")).alias("gap"),
        )
    )
    base = table.filter(F.col("trim") == TRIMS[0][0]).select("gap").scalar()
    table = table.withColumn("retained", F.try_divide(F.col("gap"), base))
    if intervals:
        table = table.join(gap_intervals(scored, seed=seed).drop("decoy"), "trim")
    return table
