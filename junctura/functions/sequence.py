"""Cleaning, tokenising, hashing and comparing short sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from junctura.fixed import RESIDUES


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: str | Column) -> Column:
    """Drop white space of any kind at both ends; a missing value becomes empty.

    Most values begin and end with a printable ASCII character and are left as they are without a search.
    """
    text = col(value)
    plain = (text >= "!") & (text < "\x7f") & F.substring(text, -1, 1).between("!", "~")
    return F.when(plain, text).otherwise(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))


def base_gene(value: str | Column) -> Column:
    """Gene name without its allele: ``TRBV19*01`` gives ``TRBV19``."""
    return strip(F.substring_index(F.coalesce(col(value), F.lit("")), "*", 1))


def kmers(value: str | Column, k: int) -> Column:
    """Overlapping k-mers in order; empty for shorter or missing text.

    A look-ahead captures ``k`` characters at every position, one pass over texts of any length.
    """
    text = F.coalesce(col(value), F.lit(""))
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{k}}}))."), F.lit(1))


def trimmed(value: str | Column, left: Column, right: Column) -> Column:
    """Drop ``left`` leading and ``right`` trailing characters."""
    text = col(value)
    return F.substring(text, left + 1, F.greatest(F.length(text) - left - right, F.lit(0)))


def canonical(value: str | Column) -> Column:
    return col(value).rlike(f"^[{RESIDUES}]+$")


def residues(value: str | Column, least: int = 1) -> Column:
    """A stripped text in capitals where it has ``least`` or more characters, all canonical residues; else null.

    What is in that form already isn't folded first.
    """
    text, whole = col(value), rf"^[{RESIDUES}]{{{max(least, 1)},}}\z"
    folded = F.upper(strip(text))
    return F.when(text.rlike(whole), text).when(folded.rlike(whole), folded)


def transitions(value: str | Column) -> Column:
    """Codes ``previous * 27 + next`` along a sequence of capital letters A to Z (1 to 26),
    with 0 for both boundaries."""
    bounded = F.concat(F.lit("@"), col(value), F.lit("@"))
    return F.transform(
        kmers(bounded, 2),
        lambda pair: (F.ascii(pair) - 64) * 27 + F.ascii(F.substring(pair, 2, 1)) - 64,
    )


def norm_sim(a: str | Column, b: str | Column) -> Column:
    """One minus edit distance over the longer length; 0 when either side is empty."""
    left, right = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    return F.when(
        (left != "") & (right != ""),
        1.0 - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right)),
    ).otherwise(0.0)


def digest(*parts: str | Column | int) -> Column:
    """Hex digest of the parts: a pseudo-random order that any partitioning reproduces."""
    as_text = [F.lit(str(p)) if isinstance(p, int) else col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *as_text))


def digest_number(hex_digest: Column) -> Column:
    """The first 48 bits of a hex digest as a whole number."""
    return F.conv(F.substring(hex_digest, 1, 12), 16, 10).cast("bigint")


def pick(size: str | Column, *parts: str | Column | int) -> Column:
    """A pseudo-random whole number in ``[0, size)`` fixed by the parts."""
    return F.pmod(digest_number(digest(*parts)), col(size).cast("bigint"))


def skip_past(index: Column, excluded: Column) -> Column:
    """Map the index-th allowed slot to its place among all slots, given sorted excluded ones."""
    return F.aggregate(
        excluded, index.cast("bigint"), lambda at, gap: at + F.when(at >= gap, 1).otherwise(0)
    )


def deletions(value: str | Column, edits: int) -> Column:
    """Every string left after deleting up to ``edits`` characters.

    Two strings at edit distance ``d`` share at least one such string for ``edits >= d``.
    """

    def shorter(words: Column) -> Column:
        return F.array_distinct(
            F.flatten(
                F.transform(
                    words,
                    lambda w: F.when(
                        F.length(w) > 0,
                        F.transform(
                            F.sequence(F.lit(1), F.length(w)),
                            lambda i: F.concat(
                                F.substring(w, F.lit(1), i - 1),
                                F.substring(w, i + 1, F.length(w)),
                            ),
                        ),
                    ).otherwise(F.array().cast("array<string>")),
                )
            )
        )

    levels = [F.array(col(value))]
    for _ in range(edits):
        levels.append(shorter(levels[-1]))
    return F.concat(*levels)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
