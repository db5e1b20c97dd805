"""Files in, files out, and the stream over arriving chunks."""

import json

import pytest
from pyspark.sql import functions as F

from junctura.operators import anchors as anchoring
from junctura.operators import cleaning
from junctura.sources import records, sinks, tables
from junctura.streaming import ingest

HEADER = "cdr3.beta\tv.beta\tj.beta\tspecies\tmhc.a\tantigen.epitope\treference.id"
OTHER = "species\tcdr3.beta\textra\tantigen.epitope\tv.beta\tj.beta"


@pytest.fixture()
def chunks(tmp_path):
    folder = tmp_path / "chunks"
    folder.mkdir()
    (folder / "a.txt").write_text(
        HEADER + '\nCASSIRSSYEQYF\tTRBV19*01\tTRBJ2-7\tHomoSapiens\tA*02\tGILGFVFTL\t"PMID ""1"""\nCASSF\n', "utf-8"
    )
    (folder / "b.txt").write_bytes(
        (OTHER + "\nHomoSapiens\tCASSIRSSYEQYF\tx").encode() + b"\xff" + b"\tGILGFVFTL\tTRBV19\tTRBJ2-7\n"
    )
    (folder / "notes.md").write_text("cdr3.beta\nX\n")
    return folder


def test_chunks_are_matched_by_name(spark, chunks):
    raw = records.read_chunks(spark, str(chunks), order="place")
    rows = {(r["cdr3.beta"], r["species"], r["antigen.epitope"], r["reference.id"]) for r in raw.collect()}
    assert rows == {
        ("CASSIRSSYEQYF", "HomoSapiens", "GILGFVFTL", 'PMID "1"'), ("CASSF", "", "", ""),
        ("CASSIRSSYEQYF", "HomoSapiens", "GILGFVFTL", ""),
    }
    merged = cleaning.unique_clonotypes(cleaning.clean_records(raw), first_by="place").collect()
    assert [(r["n_rows"], r["studies"], r["mhc"]) for r in merged] == [(2, ['PMID "1"', "unknown"], "A*02")]


def test_segments_keep_the_first_longest(spark, tmp_path):
    table = tmp_path / "segments.txt"
    table.write_text(
        "species\tgene\tsegm\tcdr3\ttype\nHomoSapiens\tTRB\tTRBV19\tCASS\tV\nHomoSapiens\tTRB\tTRBV19\tCASR\tV\n"
        "HomoSapiens\tTRB\tTRBV19\tCA\tV\nMusMusculus\tTRB\tTRBV19\tCASSSS\tV\nHomoSapiens\tTRA\tX\tCAV\tV\n"
        "HomoSapiens\tTRB\tTRBJ2-7\tSYEQYF\tJ\n"
    )
    found = anchoring.reference_anchors(records.read_segments(spark, str(table)), ordinal="place")
    assert sorted(map(tuple, found.collect())) == [("J", "TRBJ2-7", "SYEQYF"), ("V", "TRBV19", "CASS")]
    anchors = spark.createDataFrame(
        [("V", "TRBV19", "CAS"), ("J", "TRBJ2-7", "QYF"), ("J", "TRBJ2-1", "FF")], "side string, gene string, anchor string"
    )
    agreed = anchoring.validate_anchors(anchors, found).collect()
    assert sorted((r["gene"], r["agree"]) for r in agreed) == [("TRBJ2-7", True), ("TRBV19", True)]
    assert records.read_segments(spark, str(tmp_path / "absent.txt")).count() == 0


def test_saved_results_round_trip(spark, tmp_path):
    document = {"seen_peptides": ["P"], "unseen_peptides": ["Q"], "per_peptide": {"kmer3": {"P": 0.5, "Q": 0.25}}}
    path = tmp_path / "scores.json"
    path.write_text(json.dumps(document, indent=1))
    scores = records.read_scores(spark, str(path))
    assert sorted(map(tuple, scores.collect())) == [("kmer3", "P", 0.5, True), ("kmer3", "Q", 0.25, False)]
    curve = spark.createDataFrame([(0.2, 20), (0.1, 10)], "fraction double, pairs long")
    sinks.write_curve(curve, str(tmp_path / "curve"))
    text = "".join(p.read_text() for p in (tmp_path / "curve").glob("part-*"))
    assert json.loads(text) == [{"fraction": 0.1, "pairs": 10}, {"fraction": 0.2, "pairs": 20}]
    assert [r["pairs"] for r in records.read_curve(spark, str(tmp_path / "curve")).orderBy("pairs").collect()] == [10, 20]


def test_pairs_and_predictions(spark, tmp_path):
    columns = [*records.PAIR_COLUMNS, "Target", "Extra"]
    path = tmp_path / "train.csv"
    path.write_text(",".join(columns) + "\n" + ",".join(["x"] * 12 + ["1", "e"]) + "\n" + ",".join(["y"] * 11 + ["", "0", "e"]) + "\n")
    assert records.read_binders(spark, str(path)).count() == 1
    everything = records.read_pairs(spark, str(path), "Target")
    assert everything.filter(F.col("CDR3b").isNull()).count() == 1
    scored = spark.createDataFrame([("GIL", 1, 0.75)], "Peptide string, Label int, score double")
    sinks.write_predictions(scored, str(tmp_path / "p"))
    assert records.read_predictions(spark, str(tmp_path / "p"), "score").first().asDict() == {"peptide": "GIL", "binder": 1, "score": 0.75}


def test_stream_cleans_arriving_chunks(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    header = "\t".join(cleaning.RAW_COLUMNS)
    rows = ["CASSIRSSYEQYF\tTRBV19*01\tTRBJ2-7\tGILGFVFTL\tHomoSapiens\tA\tS1", "CAXF\tV\tJ\tGIL\tHomoSapiens\tA\tS1"]
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join([header, *rows]) + "\n")
        ingest.clean_to(ingest.chunk_stream(spark, source), target, state).awaitTermination()
        assert spark.read.parquet(target).count() == k + 1


def test_table_rows_are_spread_by_key(spark, tmp_path):
    columns = [f"l_{c}" for c in ("orderkey", "linenumber", "partkey", "suppkey")]
    rows = spark.range(700).select(*[(F.col("id") * k % m).alias(c) for c, k, m in zip(columns, (1, 3, 5, 7), (640, 7, 99, 11))])
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    base = tables._base(spark, str(tmp_path))
    assert base.count() == 700
    assert "RoundRobin" not in base._jdf.queryExecution().executedPlan().toString()
    assert base.filter("vi <> sk % 8 OR ji <> pk % 6 OR ei <> (pk + sk) % 5").isEmpty()
