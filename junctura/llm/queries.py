"""The registered queries of the operators and their independent SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.best_fit import pack_best_fit
from junctura.llm.chat import conversation_digests, format_turns
from junctura.llm.exact_dedup import exact_groups
from junctura.llm.html_text import extract
from junctura.llm.langid import fit, identify
from junctura.llm.mixing import mix
from junctura.llm.packing import pack
from junctura.llm.quality import judge, verdict_sql
from junctura.llm.shared import stage
from junctura.llm.simhash import near_groups
from junctura.llm.token_count import token_counts
from junctura.llm.turns import audit_turns, damage_turns
from junctura.llm.turns_sql import repair_sql
from junctura.llm.warc import round_trip
from junctura.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract(name, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")

    return round_trip(spark, _table(spark, sf_dir, "pages")).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
        (F.col("digests_hold") & F.col("refers_hold")).alias("verified"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents")).select(
        "doc.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # A document without an id teaches nothing.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, out="text").withColumn("n_chars", F.length("text").cast("long"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


# A conversation whose texts hold the template's own marks.
TRAP = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], conversations.schema)
    formatted = stage(format_turns(conversations.unionByName(trap)), "formatted")
    return conversation_digests(formatted).withColumnRenamed("conv", "conv_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return audit_turns(damage_turns(conversations), conversations)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_html_extraction": op8_html_extraction,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_whitening": op11_whitening,
    "op12_turn_repair": op12_turn_repair,
    "op13_best_fit": op13_best_fit,
}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content
            FROM documents
        ), g AS (
            SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY content
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
        FROM t JOIN g USING (content)
    """,
    "op4_quality_rules": verdict_sql(),
    "op10_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), f AS (
            SELECT *, CASE
                WHEN contains(text, '\###') OR contains(text, '\</turn>') OR contains(text, '\\')
                    THEN regexp_replace(replace(text, '\', '\\'), '(###|</turn>)', '\\\1', 'g')
                ELSE regexp_replace(text, '(###|</turn>)', '\\\1', 'g')
            END AS body
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                      FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(body) + 15 + CASE WHEN role IN ('system', 'user', 'assistant', 'tool')
                   THEN length(role) ELSE 1 + length(role) + length(regexp_replace(role, '[^\\:]', '', 'g'))
                   END)::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id
    """,
    "op12_turn_repair": repair_sql(),
}
