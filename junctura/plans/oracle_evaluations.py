"""SQL of the queries on saved scores and files; completes ``ORACLE_SQL``."""

from __future__ import annotations

from junctura.fixed import EPITOPE_CLASS_FLOOR, FRACTIONS, MEAN_PLACES, MEAN_RESAMPLES, SCHEMES, SEED, SEEDS
from junctura.plans.evaluations import ARMS, SERIES, TARGETS
from junctura.plans.oracle import ORACLE_SQL, add, area, order, partial, pick
from junctura.plans.oracle_base import CLEAN, PAIRED, PARSED

__all__ = ["ORACLE_SQL"]


def _score(k: str, modulus: str = "23") -> str:
    return (
        f"((ascii(substr(\"CDR3b\", 2, 1)) * ({k} + 2) + length(\"CDR3b\") * 7 "
        f"+ ascii(substr(\"CDR3a\", 3, 1)) * ({k})) % ({modulus}))::DOUBLE"
    )


_SEEN = '"Peptide" IN (SELECT "Peptide" FROM train)'
_arms = ", ".join(f"('{a}', {k + 1})" for k, a in enumerate(ARMS))
SCORED = f"""{PAIRED}, scored AS (
  SELECT arm, "Peptide", "Label", {_score('k')} score FROM test, (VALUES {_arms}) a(arm, k)
), per AS (
  SELECT *, {_SEEN} seen FROM {partial('scored', 'arm, "Peptide"', 'score', '"Label"')}
)"""


def means(table: str, by: str) -> str:
    return f"""(SELECT {by}, count(*) n_groups, avg(auc01) "all", avg(auc01) FILTER (seen) seen,
      avg(auc01) FILTER (NOT seen) unseen FROM {table} GROUP BY {by})"""


_ROUNDED = 'round("all", 6) "all", round(seen, 6) seen, round(unseen, 6) unseen'
add("benchmark_scores", 'SELECT arm, "Peptide", n_pos, n_neg, round(auc01, 6) auc01, seen FROM per', SCORED)
add("scores_file", 'SELECT arm, "Peptide", round(auc01, 6) auc01, seen FROM per', SCORED)
add("benchmark_means", f"SELECT arm, n_groups, {_ROUNDED} FROM {means('per', 'arm')}", SCORED)
add(
    "benchmark_intervals",
    f""", d AS (
      SELECT subset, "Peptide", a.auc01 - b.auc01 delta
      FROM per a JOIN per b USING ("Peptide"),
        LATERAL (SELECT unnest(['all', CASE WHEN a.seen THEN 'seen' ELSE 'unseen' END]) subset)
      WHERE a.arm = 'morpheme' AND b.arm = 'kmer3'
    ), items AS (
      SELECT *, row_number() OVER (PARTITION BY subset ORDER BY {order('item', '"Peptide"')}) item,
        count(*) OVER (PARTITION BY subset) size FROM d
    ), m AS (
      SELECT p.subset, resample, avg(i.delta) m FROM (
        SELECT subset, resample, {pick('size', SEED, "'draw'", 'subset', 'resample', 'item')} + 1 item
        FROM items, range(5000) b(resample)
      ) p JOIN items i ON i.subset = p.subset AND i.item = p.item GROUP BY ALL
    ), e AS (SELECT subset, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi FROM m GROUP BY subset)
    SELECT subset, count(*) n, count(*) FILTER (delta > 0) wins, round(avg(delta), 6) delta,
      round(any_value(lo), 6) lo, round(any_value(hi), 6) hi,
      CASE WHEN any_value(lo) > 0 THEN 'better' WHEN any_value(hi) > 0 THEN 'no sig. difference' ELSE 'worse' END verdict
    FROM d JOIN e USING (subset) GROUP BY subset HAVING count(*) >= 3""",
    SCORED,
)
_seeds = ", ".join(f"({SEED + 1000 * i}, {i})" for i in range(SEEDS))
_pair = ", ".join(f"('{a}', {k + 1})" for k, a in enumerate(ARMS[:2]))
DELTAS = f"""{PAIRED}, scored AS (
  SELECT seed, arm, "Peptide" epitope, "Label" label, {_score('(k + i * 2)')} score
  FROM test, (VALUES {_seeds}) s(seed, i), (VALUES {_pair}) a(arm, k)
), areas AS (
  SELECT * FROM {area('scored', 'seed, epitope, arm', 'score', 'label')}
  WHERE n_pos >= {EPITOPE_CLASS_FLOOR} AND n_neg >= {EPITOPE_CLASS_FLOOR}
), d AS (
  SELECT seed, epitope, a.auc - b.auc delta FROM areas a JOIN areas b USING (seed, epitope)
  WHERE a.arm = 'morpheme' AND b.arm = 'kmer3'
)"""
add("epitope_deltas", "SELECT seed, epitope, round(delta, 6) delta FROM d", DELTAS)
add(
    "unseen_verdict",
    f""", items AS (
      SELECT delta, row_number() OVER (ORDER BY {order('item', 'seed', 'epitope')}) item, count(*) OVER () size FROM d
    ), m AS (
      SELECT resample, avg(i.delta) m FROM (
        SELECT resample, {pick('size', SEED, "'draw'", 'resample', 'item')} + 1 item
        FROM items, range({MEAN_RESAMPLES}) b(resample)
      ) JOIN items i USING (item) GROUP BY resample
    ), e AS (
      SELECT list_sort(list(m))[{MEAN_PLACES[0] + 1}] lo, list_sort(list(m))[{MEAN_PLACES[1] + 1}] hi FROM m
    ), seeds AS (SELECT seed, avg(delta) g FROM d GROUP BY seed), w AS (
      SELECT avg(g) mean, stddev_pop(g) sd, count(*) FILTER (g > 0) in_favour, count(*) n_seeds FROM seeds
    )
    SELECT round(mean, 6) mean, round(sd, 6) sd, in_favour, n_seeds, round(lo, 6) lo, round(hi, 6) hi,
      CASE WHEN in_favour = n_seeds AND lo > 0 THEN 'better in every seed' WHEN lo > 0 THEN 'suggestive only'
        ELSE 'no reliable advantage' END verdict
    FROM w, e""",
    DELTAS,
)
_schemes = ", ".join(f"('{s}', {i})" for i, s in enumerate(SCHEMES))
SCHEMED = f"""{PAIRED}, scored AS (
  SELECT scheme, arm, "Peptide", "Label", {_score('k + i * 3', 'i + 19')} score
  FROM test, (VALUES {_schemes}) s(scheme, i), (VALUES {_arms}) a(arm, k)
), per AS (
  SELECT *, {_SEEN} seen FROM {partial('scored', 'scheme, arm, "Peptide"', 'score', '"Label"')}
), schemed AS {means('per', 'scheme, arm')}"""
add("scheme_means", f"SELECT scheme, arm, n_groups, {_ROUNDED} FROM schemed", SCHEMED)
add(
    "scheme_verdict",
    """, b AS (
      SELECT scheme, m.seen - k.seen d_seen, m."all" - v."all" d_segments, greatest(m.unseen, k.unseen, v.unseen) top
      FROM schemed m JOIN schemed k USING (scheme) JOIN schemed v USING (scheme)
      WHERE m.arm = 'morpheme' AND k.arm = 'kmer3' AND v.arm = 'vjonly')
    SELECT bool_and(d_seen > 0) beats_kmers, bool_and(d_segments > 0.02) beats_segments,
      bool_and(top < 0.55) unseen_near_chance,
      abs(max(d_seen) FILTER (scheme = 'hard') - max(d_seen) FILTER (scheme = 'matched')) > 0.02 similarity_matters,
      round(avg(d_seen) FILTER (scheme IN ('challenge', 'random')), 6) full_size_delta,
      round(avg(d_seen) FILTER (scheme IN ('hard', 'matched')), 6) reduced_size_delta FROM b""",
    SCHEMED,
)
_shares = ", ".join(f"({f}::DOUBLE)" for f in FRACTIONS)
_cells = ", ".join(
    f'max("{v}") FILTER (arm = \'{arm}\') {arm}_{v}' for arm in ARMS for v in ("all", "seen", "unseen")
)
CURVED = f"""{PAIRED}, kept AS (
  SELECT fraction, test.* FROM test, (VALUES {_shares}) f(fraction)
  WHERE (length("CDR3a") * 7 + ascii(substr("CDR3b", 3, 1)) * 13) % 100 / 100.0::DOUBLE < fraction
), scored AS (
  SELECT fraction, arm, "Peptide", "Label", {_score('k')} score FROM kept, (VALUES {_arms}) a(arm, k)
), per AS (
  SELECT *, {_SEEN} seen FROM {partial('scored', 'fraction, arm, "Peptide"', 'score', '"Label"')}
), curve AS (
  SELECT *, morpheme_seen - kmer3_seen delta_seen, morpheme_unseen - kmer3_unseen delta_unseen,
    morpheme_seen - vjonly_seen delta_vs_vjonly_seen
  FROM (SELECT fraction, {_cells} FROM {means('per', 'fraction, arm')} GROUP BY fraction)
  JOIN (SELECT fraction, count(*) pairs FROM kept GROUP BY fraction) USING (fraction)
), series AS (
  SELECT series, pairs, "value", ln(pairs) x, row_number() OVER (PARTITION BY series ORDER BY pairs) rk,
    count(*) OVER (PARTITION BY series) n
  FROM (UNPIVOT (SELECT pairs, {', '.join(SERIES)} FROM curve) ON {', '.join(SERIES)} INTO NAME series VALUE "value")
), fitted AS (
  SELECT series, regr_slope("value", x) slope, regr_intercept("value", x) intercept, corr("value", x) r,
    regr_slope("value", x) FILTER (rk > n // 2) upper_slope, max("value") FILTER (rk = 1) first_value,
    max("value") FILTER (rk = n) last_value, max(pairs) largest
  FROM series GROUP BY series
)"""
_values = [f"{arm}_{v}" for arm in ARMS for v in ("all", "seen", "unseen")]
_values += ["delta_seen", "delta_unseen", "delta_vs_vjonly_seen"]
add("curve_file", f"SELECT fraction, pairs, {', '.join(f'round({v}, 6) {v}' for v in _values)} FROM curve", CURVED)
add(
    "curve_series",
    """SELECT series, round(slope, 6) slope, round(intercept, 6) intercept, round(r, 6) r,
      round(upper_slope, 6) upper_slope, round(first_value, 6) first_value, round(last_value, 6) last_value, largest,
      CASE WHEN last_value <= 0.005 THEN 'none'
           WHEN upper_slope > 0.5 * slope AND upper_slope > 0.004 THEN 'trend'
           WHEN upper_slope < 0.25 * slope THEN 'threshold' ELSE 'ambiguous' END shape FROM fitted""",
    CURVED,
)
add(
    "curve_targets",
    f"""SELECT target, round(ln(exp((target - intercept) / slope)), 6) log_size
    FROM fitted, (VALUES {', '.join(f'({t}::DOUBLE)' for t in TARGETS)}) t(target) WHERE series = 'delta_unseen'""",
    CURVED,
)
add(
    "predictions_file",
    f"""SELECT "Peptide", n_pos, n_neg, round(auc01, 6) auc01, {_SEEN} seen,
      row_number() OVER (ORDER BY round(auc01, 9) DESC, "Peptide") place
    FROM {partial(f'(SELECT "Peptide", "Label", {_score("5")} score FROM test)', '"Peptide"', 'score', '"Label"')}""",
    PAIRED,
)
add("chunk_files", "SELECT * FROM clean", CLEAN)
add(
    "pair_files",
    """SELECT part, "Peptide", "HLA", count(*) n, count("CDR1a") loops, sum(length("CDR3b"))::BIGINT chars FROM (
      SELECT 'binders' part, * EXCLUDE (part) FROM paired WHERE part = 'train' AND "Label" = 1
      UNION ALL SELECT 'test', * EXCLUDE (part) FROM paired WHERE part = 'test' AND "Label" = 1
      UNION ALL SELECT 'both', * EXCLUDE (part) FROM paired WHERE "Label" = 0) GROUP BY ALL""",
    PAIRED,
)
add(
    "annotated_file",
    "SELECT cdr3, v, j, epitope, v_prefix, n_region, j_suffix, n_rows FROM parsed",
    PARSED,
)
ORACLE_SQL["enrichment_file"] = ORACLE_SQL["enrichment_report"]
ORACLE_SQL["export_files"] = (
    'SELECT part, peptide, count(*) n, sum(binder)::BIGINT binders, '
    'sum(length("A1" || "A2" || "A3" || "B1" || "B2" || "B3"))::BIGINT chars '
    f'FROM ({ORACLE_SQL["external_export"]}) GROUP BY part, peptide'
)
