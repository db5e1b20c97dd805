"""Splitting a junction around its two anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from junctura.fixed import ANCHOR_MIN_J, TRAILING


def v_prefix(cdr3: Column, anchor: Column, shortest: int = 1) -> Column:
    """The longest start that the sequence shares with its anchor; empty for none.

    Anchor and sequence stand on two lines, and a greedy group on the first line has to recur
    at the start of the second.
    """
    return F.regexp_extract(F.concat_ws("\n", anchor, cdr3), rf"^(.{{{shortest},}}).*\n\1", 1)


def j_suffix(cdr3: Column, anchor: Column, shortest: int = ANCHOR_MIN_J, trailing: int = TRAILING) -> Column:
    """The end of the sequence from the last place, at most ``trailing`` residues early, where
    the longest possible tail of the anchor occurs; empty for none.

    The same with both lines reversed: longer tails are tried first, then fewer extra residues.
    """
    lines = F.concat_ws("\n", F.reverse(anchor), F.reverse(cdr3))
    pattern = rf"^(.{{{shortest},}}).*\n(.{{0,{trailing}}}?\1)"
    return F.reverse(F.regexp_extract(lines, pattern, 2))


def interior(cdr3: Column, prefix: Column, suffix: Column) -> Column:
    """What lies between prefix and suffix; null when either is missing or they overlap."""
    rest = F.length(cdr3) - F.length(prefix) - F.length(suffix)
    fits = (F.length(prefix) > 0) & (F.length(suffix) > 0) & (rest >= 0)
    return F.when(fits, F.substring(cdr3, F.length(prefix) + 1, rest))
