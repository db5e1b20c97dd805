"""Quality rules for texts: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.shared import SPACES, WORDS

# Frequent function words of English, German, French and Spanish.
STOP_WORD_LANGS = ["en", "de", "fr", "es"]
STOP_WORDS = """
the of and to a in is that it for on as with was by this be at from are or an not have
der die und den von das mit sich des auf für ist im dem nicht ein eine als auch es zu
le la les de du et un une est en que qui dans pour sur pas avec au il ce par plus
el los las y del se con por para su al lo como más no una o
""".split()


@dataclass(frozen=True)
class Rule:
    """A text fails when ``metric`` lies below ``low`` or above ``high``; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


BASE_RULES = (
    Rule("few words", "n_words", low=50),
    Rule("repeated passages", "repeat_ratio", high=0.5),
)

RULES = (
    Rule("word length", "mean_word_chars", low=3.0, high=10.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop words", "stop_ratio", low=0.03),
    Rule("duplicate lines", "dup_line_ratio", high=0.4),
    Rule("capitals", "capital_ratio", high=0.5),
)


def _metrics(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` packed into a struct, so that no name clashes, beside the measures of its text.

    Each array is used more than once below, so Spark computes it once for each row instead of
    inlining it into a lambda.
    """
    white = F.lit(" \t\n\v\f\r")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"),
    ).withColumn("trimmed", F.btrim("body", white))
    rows = rows.withColumn(
        "words",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACES)),
    ).withColumn(
        "lines", F.filter(F.split("body", "\n"), lambda x: F.btrim(x, white) != "")
    )
    words = F.col("words")
    # A digest of the three-word window that starts at each word.
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "windows",
        F.slice(
            F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
            F.lit(1),
            F.greatest(F.size("words") - 2, F.lit(0)),
        ),
    )
    rows = rows.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(
                F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("at")))
            ),
        ),
    )
    ordered = F.col("sorted")

    def same(x: Column, y: Column) -> Column:
        equal = [F.get(words, x.at + k) == F.get(words, y.at + k) for k in range(3)]
        return (x.h == y.h) & equal[0] & equal[1] & equal[2]

    def found_twice(x: Column, k: Column) -> Column:
        twice = F.coalesce(same(x, F.get(ordered, k - 1)), F.lit(False)) | F.coalesce(
            same(x, F.get(ordered, k + 1)), F.lit(False)
        )
        return F.when(twice, x.at)

    rows = rows.withColumn(
        "starts", F.filter(F.transform(ordered, found_twice), lambda at: at.isNotNull())
    )
    covered = F.array_union(
        F.array_union("starts", F.transform("starts", lambda at: at + 1)),
        F.transform("starts", lambda at: at + 2),
    )
    every = [*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]
    return rows.select(
        "doc",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", r"[#*$%&|<>]+", "")))
        .cast("long")
        .alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(ordered.isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: w.isin(every))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("body", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
    ).select(
        "*",
        *[
            (F.col(part) / F.nullif(F.col(whole), F.lit(0))).alias(name)
            for name, part, whole in (
                ("mean_word_chars", "word_chars", "n_words"),
                ("symbol_ratio", "n_symbols", "n_words"),
                ("stop_ratio", "n_stop_words", "n_words"),
                ("repeat_ratio", "n_repeat_words", "n_words"),
                ("dup_line_ratio", "n_dup_lines", "n_lines"),
                ("capital_ratio", "n_capitals", "word_chars"),
            )
        ],
    )


def _fails(rule: Rule) -> Column:
    value = F.col(rule.metric)
    sides = []
    if rule.low is not None:
        sides.append(value < rule.low)
    if rule.high is not None:
        sides.append(value > rule.high)
    return F.coalesce(reduce(lambda a, b: a | b, sides, F.lit(False)), F.lit(False))


def judge(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES
) -> DataFrame:
    """The struct ``doc`` (all columns of ``docs``), the measures, and the verdict on each text.

    ``failed`` lists the names of the rules a text breaks, ``base_failed`` says whether one of
    ``base`` is among them, and ``kept`` whether there is none. A null or empty text has no words,
    so it fails the least number of words; ratios over nothing are null and break no rule. Repeated
    rows are judged alike, and columns with any name are carried in ``doc``. Everything is one
    projection without a shuffle; a row needs memory in proportion to its own text.
    """
    # Spark moves no filter below a value that depends on the partition. Without that, a filter on
    # the verdict would be rewritten over the texts, with the arrays computed again in each lambda.
    measured = _metrics(docs, text)
    names = [c for c in measured.columns if c != "doc"]
    measured = measured.select(
        "doc", F.struct(*names, F.spark_partition_id().alias("partition")).alias("measures")
    ).select("doc", *[F.col(f"measures.{c}") for c in names])
    named = [F.when(_fails(r), F.lit(r.name)) for r in (*base, *rules)]
    any_base = reduce(lambda a, b: a | b, [_fails(r) for r in base], F.lit(False))
    any_rule = reduce(lambda a, b: a | b, [_fails(r) for r in rules], F.lit(False))
    return measured.select(
        "*",
        F.array_compact(F.array(*named)).alias("failed"),
        any_base.alias("base_failed"),
        (~any_base & ~any_rule).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text breaks no rule, with their columns as they are.

    Where there is a column ``lang``, the rule on stop words holds for the four languages it knows
    and for null only.
    """
    judged, kept = judge(docs, text), F.col("kept")
    if "lang" in docs.columns:
        alone = F.col("failed") == F.array(F.lit("stop words"))
        kept |= alone & F.coalesce(~F.col("doc.lang").isin(STOP_WORD_LANGS), F.lit(False))
    return judged.filter(kept).select("doc.*")


def verdict_sql() -> str:
    """The same counts and verdict in SQL over ``documents``, built from the same threshold table."""
    ratios = {
        "mean_word_chars": "word_chars / nullif(n_words, 0)",
        "symbol_ratio": "n_symbols / nullif(n_words, 0)",
        "stop_ratio": "n_stop_words / nullif(n_words, 0)",
        "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
        "capital_ratio": "n_capitals / nullif(word_chars, 0)",
    }
    broken = " OR ".join(
        f"coalesce({ratios[r.metric]} {op} {limit}, false)"
        for r in RULES
        for op, limit in (("<", r.low), (">", r.high))
        if limit is not None
    )
    stops = ", ".join(f"'{w}'" for s in STOP_WORDS for w in (s, s.capitalize()))
    return rf"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS body,
                   regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda x: regexp_matches(x, '{WORDS}')) AS lines
            FROM documents
        ), w AS (
            SELECT doc_id, unnest(range(1, len(words) - 1)) AS p, words FROM t WHERE len(words) >= 3
        ), twice AS (
            SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p], words[p + 1], words[p + 2]) AS n
            FROM w
        ), covered AS (
            SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
            FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
        ), m AS (
            SELECT doc_id, len(words) AS n_words,
                   length(array_to_string(words, '')) AS word_chars,
                   length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words,
                   len(lines) AS n_lines,
                   len(list_filter(words, lambda x: x IN ({stops}))) AS n_stop_words,
                   length(regexp_replace(body, '\P{{Lu}}', '', 'g')) AS n_capitals
            FROM t LEFT JOIN covered USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({broken}) AS kept
        FROM m
    """
