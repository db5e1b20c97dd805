"""Exact de-duplication by salted, content-comparing combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.shared import SPACES, packed, stage, text_or_empty

# Salts over which the copies of one text are spread before the last merge.
SALTS = 32


def _content(text: str) -> Column:
    return F.regexp_replace(text_or_empty(f"`{text}`"), SPACES, " ")


def _grouped(docs: DataFrame, key: str, text: str, salts: int) -> DataFrame:
    named = docs.select(F.col(f"`{key}`").alias("key"), _content(text).alias("content")).withColumn(
        "digest", F.unhex(F.sha2("content", 256))
    )
    salted = named.withColumn("salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("digest", "salt", "content").agg(
        F.min("key").alias("low"), F.count(F.lit(1)).alias("size")
    )
    groups = (
        merged.groupBy("digest", "content")
        .agg(F.min("low").alias("keep_id"), F.sum("size").alias("group_size"))
        # Distinct texts with one digest stay apart: a second one tells a row which text it has.
        .select("digest", F.xxhash64("content").alias("check"), "keep_id", "group_size")
    )
    rows = named.select("key", "digest", F.xxhash64("content").alias("check"))
    return rows.join(groups, ["digest", "check"]).withColumn(
        "kept", F.col("key").eqNullSafe(F.col("keep_id"))
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after every run of ASCII white space has become one
    space. A map task first combines its own equal texts; what is left of a text meets under
    (digest, salt), where the salt is the number of the map task modulo ``salts``; the winners of
    the salts then meet under the digest. The text itself is part of every grouping key, so equal
    digests alone never merge two texts. Only counts and smallest keys of a text travel, so a text
    with any number of copies adds at most ``salts`` rows to the last merge.

    A null text counts as empty. The smallest key of a group stays; a null key is smaller than none
    and stays only in a group without other keys. Rows that repeat the key that stays are told
    apart by nothing, so exactly one of them would be arbitrary: all of them are marked kept.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return _grouped(docs, key, text, salts).select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of ``docs`` for each text, with its columns as they are.

    It is the row with the smallest key; of rows that repeat this key and text one stays, and which
    of them is arbitrary if other columns differ. Only keys and digests of rows that can't simply
    stay are joined back.
    """
    groups = _grouped(docs, key, text, salts)
    # Rows to drop, and keys that several rows of one text have.
    marked = stage(
        groups.filter(F.col("group_size") > 1)
        .groupBy("key", "check", "kept")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(~F.col("kept") | (F.col("rows") > 1)),
        "marked",
    )
    rows = packed(docs, key=F.col(f"`{key}`"), check=F.xxhash64(_content(text)))

    def match(others: DataFrame) -> Column:
        return rows.key.eqNullSafe(others.key) & (rows.check == others.check)

    plain = rows.join(marked, match(marked), "left_anti").select("doc.*")
    repeated = marked.filter("kept")
    if repeated.isEmpty():
        return plain
    once = rows.join(repeated, match(repeated), "left_semi").groupBy("key", "check").agg(F.first("doc").alias("doc"))
    return plain.unionByName(once.select("doc.*"))
