"""Cleaning of record chunks that keep arriving in a folder.

The batch reader and filter do the same work over a folder that is complete; both share the
cleaning step, which keeps no state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from junctura.operators.cleaning import RAW_COLUMNS, clean_records


def chunk_stream(spark: SparkSession, path: str, columns: Sequence[str] = tuple(RAW_COLUMNS)) -> DataFrame:
    """A stream over tab-separated files that all carry ``columns`` in this order.

    A file whose header differs stops the stream rather than filling the wrong columns.
    """
    return (
        spark.readStream.schema(", ".join(f"`{c}` string" for c in columns))
        .option("sep", "\t")
        .option("header", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def clean_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the cleaned records of every new file to a parquet folder and stop when caught up."""
    return (
        clean_records(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
