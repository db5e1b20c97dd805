"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from junctura.plans.catalog import QUERIES
from junctura.session import build_session
from junctura.sources import tables

HEADLINE = [
    "unique_clonotypes",
    "germline_anchors",
    "parsed_clonotypes",
    "edge_leakage",
    "study_composition",
    "bigram_profile",
    "bigram_enrichment",
    "document_bigrams",
    "hand_parse",
    "region_logprobs",
    "shuffled_decoys",
    "grammaticality",
    "auc_by_source",
    "partial_auc_by_source",
    "near_part_names",
    "peptide_pools",
    "nearest_binder",
    "challenge_negatives",
    "epitope_negatives",
    "feature_cross",
    "permuted_labels",
    "trim_control",
    "hard_negatives",
    "external_export",
    "control_pairs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    # The record tables stand for input files; writing them is listed apart and counts in the total.
    start = time.perf_counter()
    tables.receptor_records(spark, sf_dir)
    tables.paired_records(spark, sf_dir)
    derive = time.perf_counter() - start
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries and deriving their records, total time",
                "value": round(sum(times.values()) + derive, 3),
                "unit": "sec",
                "queries": times,
                "derive_records": round(derive, 3),
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
