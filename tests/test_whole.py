"""Registered queries give the whole result of their operators."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as contract
from junctura.plans import benchmark, unseen
from junctura.sources import tables
from tests.test_plans import SF, TABLES, rows


def test_trim_intervals_match_sql(spark):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    df = contract.queries()["trim_intervals"](spark, SF)
    got = [tuple(r) for r in df.collect()]
    # The derived interiors are too short for two of the eight trims.
    assert len(got) == 6 and all(r.lo is not None and r.lo <= r.hi for r in df.collect())
    result = con.sql(contract.oracle_sql()["trim_intervals"])
    assert rows(df.columns, got) == rows(result.columns, result.fetchall())


def test_unseen_epitopes_run_the_whole_grid(spark, monkeypatch):
    seen = []

    def scores(data, *args, **options):
        seen.append((data.select("epitope").distinct().count(), args, options))
        return scores_of(data, arms=["vjonly"])

    scores_of = unseen.unseen_scores
    summary = unseen.unseen_summary
    monkeypatch.setattr(unseen, "unseen_scores", scores)
    monkeypatch.setattr(unseen, "unseen_summary", lambda scored: scored)
    scored = contract.queries()["unseen_epitopes"](spark, "/root/testdata/sf0.01")
    assert tables.many_receptor_records(spark, SF).select("`antigen.epitope`").distinct().count() == 25
    # The design takes the 20 largest epitopes; seeds and folds are the operator's own.
    assert seen == [(20, (), {})]
    sides = scored.groupBy("seed", "fold").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    got = sides.collect()
    assert len(got) == 25 and all(r.p and r.n for r in got)
    assert all(0 <= r["mean"] <= 1 for r in summary(scored).collect())


def test_segment_logistic_fits_every_arm(spark, monkeypatch):
    whole = benchmark.fit_weights
    # A few steps are enough to tell which arms are fitted.
    monkeypatch.setattr(benchmark, "fit_weights", lambda *a, **o: whole(*a, **{**o, "max_iter": 3}))
    got = contract.queries()["segment_logistic"](spark, SF).collect()
    arms = {r.arm for r in got}
    assert arms == {"kmer3", "morpheme", "vjonly", "cdr123"}
    assert len({frozenset(r.Peptide for r in got if r.arm == a) for a in arms}) == 1
