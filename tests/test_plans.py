"""The registered queries against an independent engine, and the composed analyses end to end."""

import hashlib
import math
import pickle
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from junctura.fixed import EPOCHS, L2, LEARNING_RATE, SEED
from junctura.functions.crossing import SIDES, codes
from junctura.functions.features import buckets, cross_tokens
from junctura.operators import logistic, models, negatives
from junctura.plans import benchmark, unseen
from junctura.session import stage
from junctura.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = ["lineitem", "part", "documents", "labels"]
CHECKED = [
    "clean_records", "germline_anchors", "parsed_clonotypes", "bigram_significance", "hand_parse", "region_logprobs",
    "shuffled_decoys", "grammaticality", "partial_auc_by_source", "peptide_pools", "nearest_binder",
    "epitope_negatives", "hard_negatives", "feature_cross",
]


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return float(value) if isinstance(value, (int, float)) or hasattr(value, "dtype") else value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in records)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, engine, name):
    df = contract.queries()[name](spark, SF)
    result = engine.sql(contract.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(result.columns, result.fetchall())


def test_contract_is_consistent(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_sequential_fit_learns_and_refuses_large_groups(spark):
    data = [("a", f"e{i}", [1, 1, 7] if i % 2 else [2, 7], i % 2, i < 80) for i in range(120)]
    df = spark.createDataFrame(data, "arm string, example string, idx array<int>, label int, in_train boolean")
    scored = models.sequential_fits(df, ["arm"]).collect()
    assert len(scored) == 40 and all((r["score"] > 0) == (r["label"] == 1) for r in scored)
    with pytest.raises(ValueError):
        models.sequential_fits(df, ["arm"], max_rows=10)
    assert models.sequential_fits(df, ["arm"], max_rows=80).count() == 40


def test_sequential_fit_token_by_token(spark):
    """The weights again, by visiting every token of every example in turn in plain Python."""
    rng = random.Random(4)
    tokens = {"r": ["V=a", "J=b", "N3=AAA", "N2=CC"], "e": ["E=x", "EL=1", "EP0=x"]}
    data = []
    for i in range(60):
        left = [rng.choice(tokens["r"]) for _ in range(rng.randrange(0, 5))]
        right = tokens["e"][: rng.randrange(0, 4)]
        # Some rows share a key.
        data.append((i % 2, f"e{i // 2 if i > 50 else i}", left, right, int(rng.random() < 0.5), i % 3 > 0))
    df = spark.createDataFrame(data, "arm int, example string, l array<string>, r array<string>, label int, in_train boolean")
    rows = df.select("arm", "example", "label", "in_train", codes("l").alias("left"), codes("r").alias("right"))
    found = {r.example: r.score for r in models.sequential_fits(rows, ["arm"], SIDES, slice_rows=3).collect()}
    crossed = df.withColumn("idx", buckets(cross_tokens("l", "r")))
    same = {r.example: r.score for r in models.sequential_fits(crossed, ["arm"]).collect()}
    for arm in (0, 1):
        own = [r for r in crossed.filter(F.col("arm") == arm).collect()]
        fit = sorted((r for r in own if r.in_train), key=lambda r: (r.example, r.label))
        if len({r.example for r in fit}) < len(fit):
            continue
        weights, bias = {}, 0.0
        for epoch in range(EPOCHS):
            for r in sorted(fit, key=lambda r: hashlib.md5(f"{SEED}:{epoch}:{r.example}".encode()).hexdigest()):
                z = bias + sum(weights.get(b, 0.0) for b in r.idx)
                step = LEARNING_RATE * (1 / (1 + math.exp(-z)) - r.label)
                bias -= step
                for b in r.idx:
                    weights[b] = weights.get(b, 0.0) * (1 - L2) - step
        for r in own:
            if not r.in_train:
                expected = bias + sum(weights.get(b, 0.0) for b in r.idx)
                assert found[r.example] == pytest.approx(expected, abs=1e-9)
                assert same[r.example] == pytest.approx(expected, abs=1e-9)


def test_models_side_by_side(spark):
    """Fits of several models in the same passes, over both forms of tokens, and a gradient of nothing."""
    rng = random.Random(6)
    tokens = [f"t{i}" for i in range(6)]
    data = [
        (i % 3, rng.sample(tokens, rng.randrange(0, 4)), ["E=" + rng.choice("xy")], int(rng.random() < 0.4))
        for i in range(240)
    ]
    df = spark.createDataFrame(data, "run int, l array<string>, r array<string>, label int")
    sided = df.select("run", "label", codes("l").alias("left"), codes("r").alias("right"))
    names, weights, facts = logistic.fit_weights(sided, SIDES, by=["run"], tolerance=1e-8)
    crossed = df.withColumn("tokens", cross_tokens("l", "r"))
    for i, (run,) in enumerate(names):
        alone = crossed.filter(F.col("run") == run)
        _, single, _ = logistic.fit_weights(alone, tolerance=1e-8)
        assert abs(single[0] - weights[i]).max() < 1e-5
        n, first, last = facts[i]
        gradient = weights[i].copy()
        for r in alone.withColumn("idx", buckets("tokens")).collect():
            places = [*r.idx, len(gradient) - 1]
            error = 1 / (1 + math.exp(-sum(weights[i][p] for p in places))) - r.label
            for p in places:
                gradient[p] += error
        assert n == 80 and last <= 1e-8 * first and (gradient**2).sum() ** 0.5 <= 1e-7 * first
    scored = logistic.margins(sided.withColumn("run", F.when(F.col("run") < 2, F.col("run")).otherwise(9)), names, weights, SIDES, ["run"])
    assert scored.filter("run = 9 AND score IS NULL").count() == 80 and scored.filter("run < 2 AND score IS NULL").count() == 0


def test_blocks_take_up_batches(spark, monkeypatch):
    rows = [(i % 2, i % 3 == 0, [i % 7, i % 5] if i % 11 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "m int, l boolean, t array<int>").coalesce(1)
    rows = df.select("m", F.col("l").cast("double"), F.lit(1.0).alias("n"), "t")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        made = logistic._prepared(rows, 1, 18).collect()
        monkeypatch.setattr(logistic, "BLOCK_ROWS", 500)
        several = logistic._prepared(rows, 1, 18).collect()
        monkeypatch.setattr(logistic, "BLOCK_NUMBERS", 90)
        many = logistic._prepared(rows, 1, 18).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    # Forty batches of both models: a block each, then one after ten batches, then one a batch.
    assert [len(x) for x in (made, several, many)] == [2, 8, 80]
    for blocks in (made, several, many):
        found = [pickle.loads(b.block) for b in blocks]
        assert sum(bags.n for bags, *_ in found) == 4000 and sum(label.sum() for _, label, _ in found) == 1334
        total = sum(bags.spread(np.ones(bags.n), 7) for bags, *_ in found)
        assert total.tolist() == np.bincount([x for _, _, t in df.collect() for x in t or []], minlength=7).tolist()


def test_logistic_margin_matches_direct_minimisation(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [([t for t in "abc" if rng.random() < 0.5], int(rng.random() < 0.5)) for _ in range(60)]
    df = spark.createDataFrame(data, "tokens array<string>, label int")
    got = logistic.fit_logistic(df, df.withColumn("Label", F.col("label")), max_iter=200, tolerance=1e-7)
    got = {tuple(r["tokens"]): r["score"] for r in got.collect()}
    x = np.array([[t in ts for t in "abc"] + [True] for ts, _ in data], float)
    y, w = np.array([label for _, label in data]), np.zeros(4)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(4), x.T @ (p - y) + w)
    for ts, _ in data:
        assert got[tuple(ts)] == pytest.approx(float(np.array([t in ts for t in "abc"] + [True], float) @ w), abs=1e-3)


def test_benchmark_small(spark):
    train, test = stage(tables.binders(spark, SF).filter("Peptide like 'GIL%'")), tables.challenge(spark, SF)
    per = benchmark.benchmark(train, test.filter("Peptide like 'GIL%' or Peptide like 'NLV%'"), arms=["vjonly"], max_iter=5)
    assert {r["arm"] for r in per.select("arm").distinct().collect()} == {"vjonly", "tcrbase", "tcrdist"}
    # Nearest-binder scores are constant for a peptide without binders.
    assert per.filter("NOT seen AND arm <> 'vjonly' AND abs(auc01 - 0.5) > 1e-9").count() == 0
    document = benchmark.per_peptide_document(per).first()
    assert set(document["per_peptide"]) == {"vjonly", "tcrbase", "tcrdist"}
    assert benchmark.seen_unseen(per).count() == 3


def test_unseen_verdict(spark):
    deltas = spark.createDataFrame([(s, f"e{k}", 0.05 + k / 1000) for s in range(3) for k in range(5)], "seed int, epitope string, delta double")
    assert unseen.unseen_verdict(deltas, True, 200, (5, 195)).first()["verdict"] == "better in every seed"
    assert unseen.unseen_verdict(deltas, False, 200, (5, 195)).first()["verdict"] == "invalid"
    mixed = deltas.withColumn("delta", F.when(F.col("seed") == 0, -F.col("delta")).otherwise(F.col("delta") / 10))
    assert unseen.unseen_verdict(mixed, True, 200, (5, 195)).first()["verdict"] == "no reliable advantage"


def test_pools_agree_with_schemes(spark):
    train = stage(tables.binders(spark, SF))
    index = negatives.peptide_index(train)
    made = negatives.swap_negatives(train, "hard", exclude_binders=True, index=index).filter("label = 0")
    lonely = negatives.pool_sizes(index).filter("n_near = 0").select("Peptide")
    assert made.join(lonely, "Peptide", "left_semi").count() == 0


def test_equal_examples_are_fitted_once_with_their_number(spark):
    rng = random.Random(31)
    loops = {c: ["AC", "ACD"] for c in benchmark.LOOPS} | {"CDR3b": ["CASSF", "CASTF", "CAWF", None]}
    data = [
        (rng.choice(["TRBV1*01", "TRBV1", "TRBV2"]), "TRBJ1", rng.choice(["PEPT", "PEPS"]), "A2", int(rng.random() < 0.4),
         *[rng.choice(loops[c]) for c in benchmark.LOOPS])
        for _ in range(300)
    ]
    columns = ", ".join(f"{c} string" for c in benchmark.LOOPS)
    pairs = spark.createDataFrame(data, f"Vb string, Jb string, Peptide string, HLA string, label int, {columns}")
    anchors = spark.createDataFrame([("V", "TRBV1", "CASS"), ("J", "TRBJ1", "F")], "side string, gene string, anchor string")
    counted = benchmark.counted_examples(pairs)
    sums = {r.arm: (r.n, r.times, r.label) for r in counted.groupBy("arm").agg(
        F.count("*").alias("n"), F.sum("times").alias("times"), F.sum("label").alias("label")).collect()}
    positives = sum(r[4] for r in data)
    assert set(sums) == set(benchmark.ARMS) and {v[1:] for v in sums.values()} == {(300, positives)}
    assert sums["vjonly"][0] == 4 and sums["kmer3"][0] == 8
    names, once, facts = logistic.fit_weights(
        benchmark.example_codes(counted, anchors), SIDES, by=["arm"], tolerance=1e-8, times="times"
    )
    plain_names, plain, plain_facts = logistic.fit_weights(benchmark.with_codes(pairs, anchors), SIDES, by=["arm"], tolerance=1e-8)
    assert names == plain_names and all(facts[i][0] == plain_facts[i][0] == 300 for i in facts)
    assert all(abs(once[i] - plain[i]).max() < 1e-5 for i in once)
