"""The paired-chain benchmark: hashed models and nearest-binder baselines by peptide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.fixed import (
    BENCHMARK_SUPPORT,
    CURVE_GROUP_FLOOR,
    CURVE_SEEDS,
    FRACTIONS,
    LOOPS,
    SCHEMES,
    SEED,
)
from junctura.functions.crossing import SIDES, codes
from junctura.functions.features import (
    kmer_tokens,
    loop_tokens,
    parsed_tokens,
    peptide_tokens,
    segment_tokens,
    unparsed_tokens,
)
from junctura.functions.sequence import base_gene
from junctura.operators import annotate as parsing
from junctura.operators.metrics import flag_seen, macro_mean, partial_auc
from junctura.operators.logistic import fit_weights, margins
from junctura.operators.negatives import peptide_index, swap_negatives
from junctura.operators.neighbours import nearest_binder, nearest_loops
from junctura.operators.reports import loop_export
from junctura.operators.resampling import bootstrap_mean, paired_deltas
from junctura.operators.splits import keep_groups, validation_split
from junctura.session import stage

ARMS = ["kmer3", "morpheme", "vjonly", "cdr123"]
# What the tokens of an arm are made from.
ARM_FIELDS = {"kmer3": ["CDR3b"], "morpheme": ["v", "j", "CDR3b"], "vjonly": ["v", "j"], "cdr123": LOOPS}


def _receptors(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*", F.upper("CDR3b").alias("cdr3"), base_gene("Vb").alias("v"), base_gene("Jb").alias("j")
    )


def read_columns(rows: DataFrame) -> list[str]:
    """What the parse and the tokens of all arms read."""
    return [c for c in ("Peptide", "HLA", "Vb", "Jb", *LOOPS) if c in rows.columns]


def train_anchors(train: DataFrame, min_support: int = BENCHMARK_SUPPORT) -> DataFrame:
    """Anchors of the training receptors themselves."""
    rows = _receptors(train.filter(F.col("CDR3b").isNotNull())).select("cdr3", "v", "j")
    return parsing.staged_anchors(rows, min_support=min_support)


def with_parts(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Add genes and the parse; unlike the record analyses no row counts as malformed."""
    return parsing.with_parts(parsing.with_anchors(_receptors(rows), anchors))


def arm_tokens(arm: str) -> Column:
    """Receptor tokens of an arm for rows from :func:`with_parts`."""
    prefix, region, suffix = F.col("v_prefix"), F.col("n_region"), F.col("j_suffix")
    return {
        "kmer3": lambda: kmer_tokens("CDR3b"),
        "vjonly": lambda: segment_tokens("v", "j"),
        "cdr123": lambda: loop_tokens(),
        "morpheme": lambda: F.when(
            region.isNotNull(), parsed_tokens("v", "j", prefix, region, suffix)
        ).otherwise(unparsed_tokens("v", "j", "CDR3b")),
    }[arm]()


def with_codes(rows: DataFrame, anchors: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """``rows`` under every arm, with the hashed tokens of both sides in place of their cross."""
    sides = F.array(*[F.struct(F.lit(a).alias("arm"), codes(arm_tokens(a)).alias("left")) for a in arms])
    prepared = with_parts(rows, anchors).withColumn("_arm", F.explode(sides))
    right = codes(peptide_tokens("Peptide", "HLA")).alias("right")
    return prepared.select(*rows.columns, "_arm.arm", "_arm.left", right)


def counted_examples(pairs: DataFrame, arms: Sequence[str] = ARMS, by: Sequence[str] = ()) -> DataFrame:
    """(by.., arm, Peptide, HLA, fields.., label, times): the distinct examples of every arm.

    Pairs that an arm can't tell apart become one row, with the sum of their labels and their number. Fields
    that the arm doesn't read are null. Rows of one peptide stand together, and are put so before they have tokens.
    """
    rows = _receptors(pairs)
    fields = [c for c in ("v", "j", *LOOPS) if c in rows.columns]
    none = F.lit(None).cast("string")
    sides = [
        F.struct(F.lit(a).alias("arm"), *[(F.col(c) if c in ARM_FIELDS[a] else none).alias(c) for c in fields])
        for a in arms
    ]
    spread = rows.select(*by, "Peptide", "HLA", "label", F.explode(F.array(*sides)).alias("_a"))
    keys = [*by, "arm", "Peptide", "HLA", *fields]
    told = spread.select(*by, "Peptide", "HLA", "label", "_a.*").groupBy(*keys)
    sums = told.agg(F.sum("label").alias("label"), F.count("*").alias("times"))
    return stage(sums.repartitionByRange(*keys).sortWithinPartitions(*keys))


def example_codes(rows: DataFrame, anchors: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """Rows of :func:`counted_examples` with the hashed tokens of both sides."""
    anchored = parsing.with_anchors(rows.withColumn("cdr3", F.upper("CDR3b")), anchors)
    left = F.coalesce(*[F.when(F.col("arm") == a, codes(arm_tokens(a))) for a in arms]).alias("left")
    right = codes(peptide_tokens("Peptide", "HLA")).alias("right")
    return parsing.with_parts(anchored).select(*rows.columns, left, right)


def model_scores(
    pairs: DataFrame,
    test: DataFrame,
    anchors: DataFrame,
    arms: Sequence[str] = ARMS,
    max_iter: int = 100,
    by: Sequence[str] = (),
) -> DataFrame:
    """Test margins of one distributed fit per arm, as ``(by.., arm, Peptide, Label, score)``.

    With ``by`` there is a fit for each of its values among the pairs as well, all in the same passes.
    """
    by = list(by)
    train = example_codes(counted_examples(pairs, arms, by), anchors, arms)
    names, weights, _ = fit_weights(train, SIDES, by=[*by, "arm"], max_iter=max_iter, times="times")
    tests = with_codes(test, anchors, arms)
    if by:
        tests = tests.crossJoin(F.broadcast(pairs.select(*by).distinct()))
    scored = margins(tests.select(*by, "arm", "Peptide", "Label", *SIDES), names, weights, SIDES, [*by, "arm"])
    return scored.drop(*SIDES)


def baseline_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    nearest = nearest_binder(test, train, "Peptide", "CDR3b").withColumn("arm", F.lit("tcrbase"))
    loops = nearest_loops(test, train, "Peptide").withColumn("arm", F.lit("tcrdist"))
    columns = ["arm", "Peptide", "Label", F.col("sim").alias("score")]
    return nearest.select(*columns).unionByName(loops.select(*columns))


def peptide_scores(scored: DataFrame, train: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """Partial AUC by arm and peptide, flagged by whether training knows the peptide."""
    return flag_seen(partial_auc(scored, [*by, "Peptide"], "score", "Label"), train, "Peptide")


def seen_unseen(per_peptide: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    return macro_mean(per_peptide, "auc01", "seen", by)


def compare_arms(per_peptide: DataFrame, a: str, b: str, seed: int = SEED) -> DataFrame:
    """Paired bootstrap of two arms over all, seen and unseen peptides."""
    deltas = paired_deltas(per_peptide, "arm", ["Peptide", "seen"], "auc01", a, b)
    subsets = F.array(F.lit("all"), F.when(F.col("seen"), "seen").otherwise("unseen"))
    return bootstrap_mean(
        deltas.select("Peptide", "delta", F.explode(subsets).alias("subset")), "delta", ["Peptide"], ["subset"], seed=seed
    )


def per_peptide_document(per_peptide: DataFrame) -> DataFrame:
    """One row shaped like the published JSON: seen and unseen peptides, scores by arm."""

    def by_name(a: Column, b: Column) -> Column:
        return F.when(a["arm"] < b["arm"], -1).otherwise(1)

    by_arm = per_peptide.groupBy("arm").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("Peptide", "auc01")))).alias("scores"),
        F.array_sort(F.collect_set(F.when(F.col("seen"), F.col("Peptide")))).alias("s"),
        F.array_sort(F.collect_set(F.when(~F.col("seen"), F.col("Peptide")))).alias("u"),
    )
    return by_arm.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("seen_peptides"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("u")))).alias("unseen_peptides"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", "scores")), by_name)).alias("per_peptide"),
    )


def benchmark(train: DataFrame, test: DataFrame, arms: Sequence[str] = ARMS, max_iter: int = 100) -> DataFrame:
    """Per-peptide scores of all arms and both baselines."""
    train, test = stage(train), stage(test)
    anchors = train_anchors(train)
    pairs = stage(swap_negatives(train, "challenge"))
    scored = model_scores(pairs, test, anchors, arms, max_iter).unionByName(baseline_scores(train, test))
    return stage(peptide_scores(stage(scored), train))


def negative_schemes(
    train: DataFrame,
    test: DataFrame,
    schemes: Sequence[str] = SCHEMES,
    arms: Sequence[str] = ARMS[:3],
    max_iter: int = 100,
) -> DataFrame:
    """All, seen and unseen means by negative scheme and arm."""
    train, test = stage(train), stage(test)
    anchors, index = train_anchors(train), peptide_index(train)
    pairs = None
    for scheme in schemes:
        made = swap_negatives(train, scheme, exclude_binders=True, index=index).withColumn("scheme", F.lit(scheme))
        pairs = made if pairs is None else pairs.unionByName(made)
    scored = model_scores(stage(pairs), test, anchors, arms, max_iter, ["scheme"])
    by = ["scheme", "arm"]
    return seen_unseen(peptide_scores(stage(scored), train, by), by)


def learning_curve(
    train: DataFrame,
    test: DataFrame,
    fractions: Sequence[float] = FRACTIONS,
    n_seeds: int = CURVE_SEEDS,
    arms: Sequence[str] = ARMS[:3],
    max_iter: int = 100,
) -> DataFrame:
    """Means by training size, averaged over seeds, with the differences between arms."""
    train, test = stage(train), stage(test)
    anchors = train_anchors(train)
    pairs = stage(swap_negatives(train, "challenge"))
    kept = None
    for fraction in fractions:
        for k in range(n_seeds):
            part = keep_groups(pairs, "grp", fraction, CURVE_GROUP_FLOOR, SEED + 17 * k)
            part = part.withColumns({"fraction": F.lit(fraction), "run": F.lit(k)})
            kept = part if kept is None else kept.unionByName(part)
    kept = stage(kept)
    scored = model_scores(kept, test, anchors, arms, max_iter, ["fraction", "run"])
    by = ["fraction", "run", "arm"]
    means = seen_unseen(peptide_scores(stage(scored), train, by), by)
    table = kept.groupBy("fraction", "run").agg(F.count("*").alias("pairs"))
    averaged = means.join(table, ["fraction", "run"]).groupBy("fraction")

    def mean(arm: str, value: str) -> Column:
        return F.avg(F.when(F.col("arm") == arm, F.col(value)))

    columns = [
        mean(arm, value).alias(f"{arm}_{value}") for arm in arms for value in ("all", "seen", "unseen")
    ]
    curve = averaged.agg(F.avg("pairs").cast("bigint").alias("pairs"), *columns)
    gaps = {"delta_seen": ("kmer3", "seen"), "delta_unseen": ("kmer3", "unseen"), "delta_vs_vjonly_seen": ("vjonly", "seen")}
    for name, (other, value) in gaps.items():
        if "morpheme" in arms and other in arms:
            curve = curve.withColumn(name, F.col(f"morpheme_{value}") - F.col(f"{other}_{value}"))
    return curve


def external_export(train: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """Train, validation and test tables for an outside network."""
    usable = train.na.drop(subset=["CDR1a", "CDR2a", "CDR3a", "CDR1b", "CDR2b", "CDR3b", "Peptide"])

    def sided(positives: DataFrame) -> DataFrame:
        return validation_split(positives, "grp", groups=positives)

    # A positive's side goes with its draws in place of its digest. Only what the tables hold is looked up and written.
    made = swap_negatives(usable, "challenge", kept=["Peptide", *LOOPS], mark=sided)
    pairs = stage(made.select("in_validation", "label", "Peptide", *LOOPS))
    return {
        "train": loop_export(pairs.filter("NOT in_validation"), "label"),
        "val": loop_export(pairs.filter("in_validation"), "label"),
        "test": loop_export(test, "Label"),
    }


def score_predictions(predictions: DataFrame, train: DataFrame, score: str) -> DataFrame:
    """Per-peptide scores of an outside model from its (peptide, binder, score) table, best first."""
    rows = predictions.select(
        F.lit("external").alias("arm"),
        F.col("peptide").alias("Peptide"),
        F.col("binder").alias("Label"),
        F.col(score).alias("score"),
    )
    return peptide_scores(rows, train).orderBy(F.col("auc01").desc(), "Peptide")
