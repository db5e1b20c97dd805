"""Independent SQL for the registered queries."""

from __future__ import annotations

from junctura.fixed import FRACTIONS, HAND_J, HAND_V, SEED, TRIMS
from junctura.plans.oracle_base import (
    ANCHORS,
    CLEAN,
    CLONES,
    PAIRED,
    PARSED,
    RAW,
    anchors_from,
    parse_from,
)

ORACLE_SQL: dict[str, str] = {}
FOCUS = "('GILGFVFTL', 'NLVPMVATV', 'GLCTLVAML')"
NAME = (
    "CASE {0} WHEN 'GILGFVFTL' THEN 'Influenza A (M1)' WHEN 'NLVPMVATV' THEN 'CMV (pp65)' "
    "WHEN 'GLCTLVAML' THEN 'EBV (BMLF1)' END"
)


def add(name: str, text: str, ctes: str = "") -> None:
    ORACLE_SQL[name] = f"WITH {ctes} {text}" if ctes else text


def digest(*parts: str | int) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"'{p}'" if isinstance(p, int) else p for p in parts) + "))"


def pick(size: str, *parts: str | int) -> str:
    return f"(('0x' || substr({digest(*parts)}, 1, 12))::BIGINT % ({size}))"


def order(salt: str, *key: str, seed: int = SEED) -> str:
    return f"{digest(seed, repr(salt), *key)}, {', '.join(key)}"


KEY = ("cdr3", "v", "j", "epitope")
KEYS = ", ".join(KEY)

# Records and clonotypes
add("gene_calls", "SELECT v_call AS call, trim(split_part(v_call, '*', 1)) AS gene, count(*) n FROM raw GROUP BY ALL", RAW)
add("clean_records", "SELECT * FROM clean", CLEAN)
COMPLETE = f"""{RAW}, complete AS (
  SELECT * FROM raw WHERE species = 'HomoSapiens' AND trim(cdr3) <> '' AND trim(v_call) <> ''
    AND trim(j_call) <> '' AND trim(epitope) <> ''
)"""
add("complete_records", "SELECT epitope, v_call AS call, count(*) n FROM complete GROUP BY ALL", COMPLETE)
add("unique_clonotypes", f"SELECT {KEYS}, mhc, n_rows, array_to_string(studies, ',') studies FROM clones", CLONES)
add(
    "row_inflation",
    "SELECT sum(n_rows) n_rows, count(*) n_unique, round(sum(n_rows)::DOUBLE / count(*), 6) inflation FROM clones",
    CLONES,
)

# Anchors and parse
add(
    "position_profile",
    "SELECT side, gene, k, aa, n, total, round(n::DOUBLE / total, 6) \"share\" FROM modal WHERE rn = 1",
    ANCHORS,
)
add(
    "germline_anchors",
    """SELECT side, gene, anchor, support, string_agg(aa, '' ORDER BY k) AS profile
    FROM anchors JOIN called c USING (side, gene)
    WHERE holds = 1 OR k = (SELECT min(k) FROM called d WHERE d.side = c.side AND d.gene = c.gene AND holds = 0)
    GROUP BY ALL""",
    ANCHORS,
)
add(
    "anchor_validation",
    """SELECT side, gene, anchor, reference,
      CASE side WHEN 'V' THEN starts_with(reference, anchor) OR starts_with(anchor, reference)
           ELSE ends_with(reference, anchor) OR ends_with(anchor, reference) END agree
    FROM anchors JOIN (
      SELECT DISTINCT 'V' side, v_gene gene, v_full reference FROM base
      UNION ALL SELECT DISTINCT 'J', j_gene, j_full FROM base) USING (side, gene)""",
    ANCHORS,
)
add(
    "parsed_clonotypes",
    f"""SELECT {KEYS}, status,
      CASE WHEN status = 'parsed' THEN v_prefix END v_prefix,
      CASE WHEN status = 'parsed' THEN n_region END n_region,
      CASE WHEN status = 'parsed' THEN j_suffix END j_suffix FROM parsed_all""",
    PARSED,
)
add("parse_stats", "SELECT status, count(*) n FROM parsed_all GROUP BY ALL", PARSED)
add(
    "leak_check",
    """SELECT count(*) leaks FROM parsed
    WHERE EXISTS (SELECT 1 FROM anchors WHERE side = 'J' AND length(anchor) >= 4 AND contains(n_region, anchor))""",
    PARSED,
)
add(
    "edge_leakage",
    """, spots AS (
      SELECT p AS position, CASE WHEN p > 0 THEN v ELSE j END seg,
             substr(n_region, CASE WHEN p > 0 THEN p ELSE length(n_region) + p + 1 END, 1) aa
      FROM parsed, (VALUES (1), (2), (3), (-1), (-2), (-3)) t(p) WHERE length(n_region) >= 4
    ), c AS (SELECT position, seg, aa, count(*) n FROM spots GROUP BY ALL),
    s AS (SELECT position, max(n) top, sum(n) total FROM c GROUP BY position, seg HAVING sum(n) >= 50)
    SELECT position, round(avg(top::DOUBLE / total), 6) modal_share, count(*) n_segments FROM s GROUP BY position""",
    PARSED,
)
add(
    "focus_summary",
    f"""SELECT epitope, {NAME.format('epitope')} AS name, sum(n_rows) n_rows, count(*) n_unique,
      count(*) FILTER (status = 'parsed') n_parsed,
      round(100.0::DOUBLE * count(*) FILTER (status = 'parsed') / count(*), 6) rate
    FROM parsed_all WHERE epitope IN {FOCUS} GROUP BY epitope""",
    PARSED,
)
STUDIES = f"""{PARSED}, by_study AS (
  SELECT epitope, study, count(*) n FROM (SELECT epitope, unnest(studies) study FROM parsed) GROUP BY ALL
), top_study AS (
  SELECT epitope, study top_study, n top_n, count(*) OVER (PARTITION BY epitope) n_studies
  FROM by_study QUALIFY row_number() OVER (PARTITION BY epitope ORDER BY n DESC, study) = 1
)"""
add(
    "focus_shares",
    f"""SELECT epitope, {NAME.format('epitope')} AS name,
      round(100 * avg(contains(n_region, 'C')::INT), 6) cysteine_share,
      round(100 * avg(contains(n_region, 'RS')::INT), 6) rs_share,
      round(100 * avg((v = 'TRBV19')::INT), 6) trbv19_share,
      round(100.0::DOUBLE * any_value(top_n) / count(*), 6) top_share
    FROM parsed JOIN top_study USING (epitope) WHERE epitope IN {FOCUS} GROUP BY epitope""",
    STUDIES,
)
add(
    "study_composition",
    """SELECT epitope, count(*) clonotypes, any_value(n_studies) n_studies, any_value(top_study) top_study,
      round(100.0::DOUBLE * any_value(top_n) / count(*), 6) top_share
    FROM parsed JOIN top_study USING (epitope) GROUP BY epitope""",
    STUDIES,
)
add("large_studies", "SELECT * FROM by_study WHERE n >= 200", STUDIES)

# N-grams
GRAMS = f"""{STUDIES}, grams AS (
  SELECT {KEYS}, epitope ep, studies, substr(n_region, i::INT, 2) gram
  FROM parsed, LATERAL (SELECT unnest(range(1, length(n_region))) i)
), profile AS (
  SELECT epitope, gram, count(*) n FROM grams GROUP BY ALL
), big AS (SELECT epitope, study FROM by_study WHERE n >= 200
), study_profile AS (
  SELECT epitope, study, gram, count(*) n, sum(count(*)) OVER (PARTITION BY epitope, study) total
  FROM (SELECT epitope, unnest(studies) study, gram FROM grams) JOIN big USING (epitope, study)
  GROUP BY epitope, study, gram
), totals AS (SELECT epitope, sum(n)::BIGINT total FROM profile GROUP BY epitope
), compared AS (
  SELECT a.epitope group_a, tb.epitope group_b, a.gram, a.n count_a, coalesce(b.n, 0) count_b,
         ta.total ta, tb.total tb
  FROM profile a JOIN totals ta ON ta.epitope = a.epitope
  JOIN totals tb ON tb.epitope <> a.epitope
  LEFT JOIN profile b ON b.epitope = tb.epitope AND b.gram = a.gram
  WHERE a.n >= 20 AND a.epitope IN {FOCUS} AND tb.epitope IN {FOCUS}
), tested AS (
  SELECT *, (count_a::DOUBLE / ta) / ((count_b + 1)::DOUBLE / (tb + 1)) ratio,
    least(1.0, list_sum(list_transform(range(count_a, least(ta, count_a + count_b) + 1), lambda k:
      CASE WHEN count_a + count_b - k <= tb THEN exp(
        lgamma(ta + 1.0) - lgamma(k + 1.0) - lgamma(ta - k + 1.0)
        + lgamma(tb + 1.0) - lgamma(count_a + count_b - k + 1.0) - lgamma(tb - count_a - count_b + k + 1.0)
        - lgamma(ta + tb + 1.0) + lgamma(count_a + count_b + 1.0)
        + lgamma(ta + tb - count_a - count_b + 1.0)) ELSE 0 END))) p
  FROM compared
), adjusted AS (
  SELECT *, least(1.0, min(p * m / rk) OVER (PARTITION BY group_a, group_b ORDER BY rk DESC)) q
  FROM (SELECT *, row_number() OVER (PARTITION BY group_a, group_b ORDER BY p, gram) rk,
               count(*) OVER (PARTITION BY group_a, group_b) m FROM tested)
), replicated AS (
  SELECT group_a, group_b, gram, count_a, count_b, ratio, p, q,
    (SELECT count(*) FROM study_profile s WHERE s.epitope = group_a AND s.gram = t.gram
       AND s.n::DOUBLE / s.total > (count_b + 1)::DOUBLE / (tb + 1)) replicating,
    (SELECT count(*) FROM big WHERE big.epitope = group_a) n_studies
  FROM adjusted t WHERE q < 0.01
)"""
add("bigram_profile", "SELECT * FROM profile", GRAMS)
add("study_profiles", "SELECT epitope, study, gram, n, total FROM study_profile", GRAMS)
add(
    "bigram_significance",
    "SELECT group_a, group_b, gram, count_a, count_b, round(ratio, 6) ratio, round(p, 6) p, round(q, 6) q FROM adjusted",
    GRAMS,
)
add(
    "bigram_enrichment",
    """SELECT group_a, group_b, gram, count_a, count_b, replicating, n_studies,
      round(ratio, 6) ratio, round(p, 6) p, round(q, 6) q FROM replicated""",
    GRAMS,
)
add(
    "top_enriched",
    """SELECT group_a, group_b, gram, place, round(ratio, 6) ratio FROM (
      SELECT *, row_number() OVER (PARTITION BY group_a, group_b ORDER BY round(ratio, 9) DESC, gram) place FROM replicated)
    WHERE place <= 8""",
    GRAMS,
)
add(
    "enrichment_report",
    f"""SELECT {NAME.format('group_a')} group_a, {NAME.format('group_b')} group_b, gram bigram, count_a, count_b,
      printf('%.3f', ratio) ratio, printf('%.3e', p) p, printf('%.3e', q) q,
      replicating || '/' || n_studies studies_replicating FROM replicated""",
    GRAMS,
)
add(
    "document_bigrams",
    """SELECT lang, substr(text, i::INT, 2) gram, count(*) n
    FROM documents, LATERAL (SELECT unnest(range(1, length(text))) i) GROUP BY ALL""",
)

# First analysis
_hand = {
    side: ", ".join(f"('{gene}', '{residues}')" for gene, residues in table.items())
    for side, table in (("v", HAND_V), ("j", HAND_J))
}
HAND = f"""{COMPLETE}, hv(g, va) AS (VALUES {_hand['v']}), hj(g, ja) AS (VALUES {_hand['j']}),
tried AS (
  SELECT epitope, cdr3, v_call v, j_call j, va, ja,
    list_filter(range(length(va), 1, -1), lambda i: starts_with(cdr3, left(va, i::INT)))[1] vl,
    list_filter(list_transform(range(0, length(ja)), lambda i:
      CASE WHEN instr(reverse(cdr3), reverse(substr(ja, i::INT + 1))) BETWEEN 1 AND 3
           THEN instr(reverse(cdr3), reverse(substr(ja, i::INT + 1))) - 1 + length(ja) - i END),
      lambda x: x IS NOT NULL)[1] jl
  FROM complete LEFT JOIN hv ON hv.g = split_part(v_call, '*', 1) LEFT JOIN hj ON hj.g = split_part(j_call, '*', 1)
), hand AS (
  SELECT epitope, cdr3, v, j, CASE WHEN ok THEN left(cdr3, vl::INT) END v_prefix,
    CASE WHEN ok THEN substr(cdr3, vl::INT + 1, (length(cdr3) - jl - vl)::INT) END n_region,
    CASE WHEN ok THEN right(cdr3, jl::INT) END j_suffix
  FROM (SELECT *, coalesce(length(cdr3) >= 5 AND length(cdr3) - jl >= vl, false) ok FROM tried)
), hgrams AS (
  SELECT epitope, substr(n_region, i::INT, 2) gram, count(*) n
  FROM hand, LATERAL (SELECT unnest(range(1, length(n_region))) i) GROUP BY ALL
)"""
add("hand_parse", "SELECT * FROM hand", HAND)
add(
    "hand_summary",
    """SELECT epitope, count(*) total, count(n_region) parsed,
      round(100.0::DOUBLE * count(n_region) / count(*), 6) rate FROM hand GROUP BY epitope""",
    HAND,
)
_top = """SELECT epitope, place, {0}, n, round(100.0::DOUBLE * n / total, 6) AS "share" FROM (
  SELECT *, row_number() OVER (PARTITION BY epitope ORDER BY n DESC, {0}) place,
         sum(n) OVER (PARTITION BY epitope) total FROM {1}) WHERE place <= {2}"""
add(
    "hand_top_regions",
    _top.format(
        "n_region", "(SELECT epitope, n_region, count(*) n FROM hand WHERE n_region <> '' GROUP BY ALL)", 15
    ),
    HAND,
)
add("hand_top_bigrams", _top.format("gram", "hgrams", 10), HAND)
add(
    "hand_region_lengths",
    """SELECT epitope, length, n FROM (
      SELECT epitope, length(n_region) length, count(*) n,
             row_number() OVER (PARTITION BY epitope ORDER BY length(n_region)) place
      FROM hand WHERE n_region <> '' GROUP BY epitope, length(n_region)) WHERE place <= 10""",
    HAND,
)
add(
    "hand_enrichment",
    """, a AS (SELECT gram, n a FROM hgrams WHERE epitope = 'GILGFVFTL'),
    b AS (SELECT gram, n b FROM hgrams WHERE epitope = 'NLVPMVATV')
    SELECT coalesce(a.gram, b.gram) gram,
      round(a::DOUBLE / ta / greatest(coalesce(b::DOUBLE, 0.5::DOUBLE) / tb, 0.0001::DOUBLE), 6) ratio_a,
      round(b::DOUBLE / tb / greatest(coalesce(a::DOUBLE, 0.5::DOUBLE) / ta, 0.0001::DOUBLE), 6) ratio_b
    FROM a FULL JOIN b ON a.gram = b.gram, (SELECT sum(a)::DOUBLE ta FROM a), (SELECT sum(b)::DOUBLE tb FROM b)""",
    HAND,
)

# Language models
ELIGIBLE = f"""{PARSED}, elig AS (
  SELECT {KEYS}, studies, studies[1] home, n_region FROM parsed WHERE length(n_region) >= 3
)"""


def steps(table: str, text: str, columns: str) -> str:
    """Every (previous, next) token pair of a sequence with its boundaries."""
    return f"""SELECT {columns}, CASE WHEN i = 0 THEN '^' ELSE substr({text}, i::INT, 1) END prev,
      CASE WHEN i = length({text}) THEN '$' ELSE substr({text}, i::INT + 1, 1) END nxt
    FROM {table}, LATERAL (SELECT unnest(range(0, length({text}) + 1)) i)"""


add(
    "bigram_model",
    f"""SELECT prev, nxt AS next, count(*) n, sum(count(*)) OVER (PARTITION BY prev) total
    FROM ({steps('elig', 'n_region', 'epitope')}) GROUP BY prev, nxt""",
    ELIGIBLE,
)
add(
    "segment_bigram_model",
    f"""SELECT v, j, prev, nxt AS next, count(*) n, sum(count(*)) OVER (PARTITION BY v, j, prev) total
    FROM ({steps('elig', 'n_region', 'v, j')}) GROUP BY v, j, prev, nxt""",
    ELIGIBLE,
)


def scored(train: str, rows: str, row_key: str, text: str, scope: str, tag: str, a: str, b: str) -> str:
    """CTE ``tag(row_key, lp, seqs)``: add-half bigram score under models by (scope, a, b)."""
    on = " AND ".join(f"s.{c} = m.{c}" for c in (scope, "a", "b"))
    return f"""{tag}_c AS (
  SELECT {scope}, a, b, prev, nxt, count(*) n
  FROM ({steps(f"(SELECT {scope}, {a} a, {b} b, real FROM {train})", 'real', f'{scope}, a, b')}) GROUP BY ALL
), {tag}_t AS (SELECT {scope}, a, b, prev, sum(n) total FROM {tag}_c GROUP BY ALL
), {tag}_s AS ({steps(f"(SELECT {row_key}, {scope}, {a} a, {b} b, {text} FROM {rows})", text, f'{row_key}, {scope}, a, b')}
), {tag} AS (
  SELECT {', '.join('s.' + c.strip() for c in row_key.split(','))},
    sum(ln((coalesce(m.n, 0) + 0.5::DOUBLE) / (coalesce(t.total, 0) + 10.5::DOUBLE))) lp,
    coalesce(max(t.total) FILTER (s.prev = '^'), 0) seqs
  FROM {tag}_s s LEFT JOIN {tag}_c m ON {on} AND s.prev = m.prev AND s.nxt = m.nxt
  LEFT JOIN {tag}_t t ON {on.replace('m.', 't.')} AND s.prev = t.prev
  GROUP BY {', '.join('s.' + c.strip() for c in row_key.split(','))}
)"""


def mixed(cond: str, pool: str, seqs: str) -> str:
    return f"""CASE WHEN {seqs} >= 20 THEN greatest(ln(0.7::DOUBLE) + {cond}, ln(1 - 0.7::DOUBLE) + {pool})
      + ln(exp(ln(0.7::DOUBLE) + {cond} - greatest(ln(0.7::DOUBLE) + {cond}, ln(1 - 0.7::DOUBLE) + {pool}))
         + exp(ln(1 - 0.7::DOUBLE) + {pool} - greatest(ln(0.7::DOUBLE) + {cond}, ln(1 - 0.7::DOUBLE) + {pool})))
      ELSE {pool} END"""


_rows = f"{ELIGIBLE}, rws AS (SELECT {KEYS}, n_region AS real, 'x' AS trim FROM elig)"
add(
    "region_logprobs",
    f"SELECT {KEYS}, round(f.lp, 6) flat, round({mixed('c.lp', 'f.lp', 'c.seqs')}, 6) morpheme "
    f"FROM f JOIN c USING ({KEYS})",
    f"{_rows}, {scored('rws', 'rws', KEYS, 'real', 'trim', 'f', repr('x'), repr('x'))}, "
    f"{scored('rws', 'rws', KEYS, 'real', 'trim', 'c', 'v', 'j')}",
)
add(
    "length_model",
    """SELECT length(n_region) length, count(*) n,
      round(ln((count(*) + 0.5::DOUBLE) / (sum(count(*)) OVER () + 20)), 6) logp
    FROM elig GROUP BY length(n_region)""",
    ELIGIBLE,
)
add(
    "residue_background",
    """SELECT substr(n_region, i::INT, 1) aa, count(*) n
    FROM elig, LATERAL (SELECT unnest(range(1, length(n_region) + 1)) i) GROUP BY ALL""",
    ELIGIBLE,
)
HELD = f"""{ELIGIBLE}, homes AS (
  SELECT home, row_number() OVER (ORDER BY {order('study', 'home')}) rk, count(*) OVER () n
  FROM (SELECT DISTINCT home FROM elig)
), held AS (
  SELECT elig.*, rk <= greatest(n // 5, 1) held_out FROM elig JOIN homes USING (home)
), to_rank AS (
  SELECT *, row_number() OVER (ORDER BY {order('to', *KEY)}) rk FROM held
), from_rank AS (
  SELECT v fake_v, j fake_j, row_number() OVER (ORDER BY {order('from', *KEY)}) rk FROM held
), labelled AS (SELECT * EXCLUDE (rk) FROM to_rank JOIN from_rank USING (rk))"""
add("study_holdout", f"SELECT {KEYS}, held_out FROM held", HELD)
add("permuted_labels", f"SELECT {KEYS}, fake_v, fake_j FROM labelled", HELD)


def shuffles(table: str, text: str, extra: str = "") -> str:
    """CTE ``shuffled(key, extra, decoy)``: the first of ten orders that differs."""
    also = f", {extra}" if extra else ""
    return f"""tries AS (
  SELECT {KEYS}{also}, {text} orig, salt,
    string_agg(substr({text}, i::INT + 1, 1), '' ORDER BY
      {digest(SEED, 'salt', *KEY, 'i')}, substr({text}, i::INT + 1, 1)) mix
  FROM {table}, range(10) s(salt), LATERAL (SELECT unnest(range(0, length({text}))) i)
  GROUP BY {KEYS}{also}, {text}, salt
), shuffled AS (
  SELECT {KEYS}{also}, orig, arg_min(mix, salt) FILTER (mix <> orig) decoy FROM tries GROUP BY {KEYS}{also}, orig
)"""


def resamples(table: str, text: str, train: str, train_text: str, extra: str = "") -> str:
    also = f", {extra}" if extra else ""
    return f"""bg AS (
  SELECT aa, sum(n) OVER (ORDER BY aa) upto, sum(n) OVER () total FROM (
    SELECT substr({train_text}, i::INT, 1) aa, count(*) n
    FROM {train}, LATERAL (SELECT unnest(range(1, length({train_text}) + 1)) i) GROUP BY ALL)
), spots AS (
  SELECT {KEYS}{also}, {text} orig, i,
    {pick('(SELECT max(total)::BIGINT FROM bg)', SEED, "'resample'", *KEY, 'i')} u
  FROM {table}, LATERAL (SELECT unnest(range(0, length({text}))) i)
), resampled AS (
  SELECT {KEYS}{also}, orig, string_agg(aa, '' ORDER BY i) decoy
  FROM (SELECT s.*, bg.aa FROM spots s JOIN bg ON s.u < bg.upto
        QUALIFY row_number() OVER (PARTITION BY {KEYS}{also}, i ORDER BY bg.upto) = 1)
  GROUP BY {KEYS}{also}, orig
)"""


add(
    "shuffled_decoys",
    f"SELECT {KEYS}, orig n_region, decoy FROM shuffled",
    f"{ELIGIBLE}, {shuffles('elig', 'n_region')}",
)
add(
    "resampled_decoys",
    f"SELECT {KEYS}, orig n_region, decoy FROM resampled",
    f"{ELIGIBLE}, {resamples('elig', 'n_region', 'elig', 'n_region')}",
)


def grammar(trims: list[tuple[str, int, int]], with_resampled: bool) -> str:
    """CTEs ending in ``long(key, trim, decoy, label, model, score)``."""
    values = ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', {a}, {b})" for n, a, b in trims)
    row = f"{KEYS}, trim, decoy, label"
    body = f"""{HELD}, trims(trim, l, r) AS (VALUES {values}), cut AS (
  SELECT labelled.*, trim, substr(n_region, l + 1, length(n_region) - l - r) AS real
  FROM labelled, trims WHERE length(n_region) - l - r >= 3
), train AS (SELECT * FROM cut WHERE NOT held_out), test AS (SELECT * FROM cut WHERE held_out),
{shuffles('test', 'real', 'trim')}"""
    kinds = "SELECT * EXCLUDE (decoy), decoy fake, 'shuffled' decoy FROM shuffled"
    if with_resampled:
        body += f", {resamples('test', 'real', 'train', 'real', 'trim')}"
        kinds += " UNION ALL SELECT * EXCLUDE (decoy), decoy fake, 'resampled' decoy FROM resampled"
    body += f""", kinds AS ({kinds}), pairs AS (
  SELECT {KEYS}, trim, k.decoy, label, fake_v, fake_j, CASE label WHEN 1 THEN orig ELSE fake END txt
  FROM kinds k JOIN test USING ({KEYS}, trim), (VALUES (1), (0)) y(label) WHERE fake IS NOT NULL
), {scored('train', 'pairs', row, 'txt', 'trim', 'f', repr('x'), repr('x'))},
{scored('train', 'pairs', row, 'txt', 'trim', 'c', 'v', 'j')},
{scored('train', 'pairs', row, 'txt', 'trim', 'z', 'fake_v', 'fake_j')},
lens AS (SELECT trim, length(real) len, count(*) n FROM train GROUP BY ALL),
lens_total AS (SELECT trim, sum(n) total FROM lens GROUP BY trim),
wide AS (
  SELECT {', '.join('pairs.' + c for c in (*KEY, 'trim', 'decoy', 'label'))}, f.lp flat,
    {mixed('c.lp', 'f.lp', 'c.seqs')} morpheme, {mixed('z.lp', 'f.lp', 'z.seqs')} permuted,
    ln((coalesce(lens.n, 0) + 0.5::DOUBLE) / (coalesce(lens_total.total, 0) + 20)) AS length
  FROM f JOIN c USING ({row}) JOIN z USING ({row}) JOIN pairs USING ({row})
  LEFT JOIN lens ON lens.trim = pairs.trim AND lens.len = length(txt)
  LEFT JOIN lens_total ON lens_total.trim = pairs.trim
)"""
    return body + """, long AS (
  UNPIVOT (SELECT cdr3, v, j, epitope, trim, decoy, label, round(flat, 9) flat, round(morpheme, 9) morpheme,
           round(permuted, 9) permuted, round(length, 9) "length" FROM wide)
  ON flat, morpheme, permuted, "length" INTO NAME model VALUE score
)"""


def area(table: str, by: str, score: str, label: str) -> str:
    """AUC from mid-ranks."""
    return f"""(SELECT {by}, count(*) FILTER (y = 1) n_pos, count(*) FILTER (y = 0) n_neg,
      (sum(CASE WHEN y = 1 THEN mid END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
        / nullif(count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0), 0) auc
    FROM (SELECT {by}, {label} y, rank() OVER (PARTITION BY {by} ORDER BY {score})
            + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0::DOUBLE mid FROM {table}) GROUP BY {by})"""


_areas = area("long", "trim, decoy, model", "score", "label")
add("grammaticality", f"SELECT trim, decoy, model, n_pos, n_neg, round(auc, 6) auc FROM {_areas}", grammar(TRIMS[:1], True))
add(
    "trim_control",
    f""", areas AS {_areas}, t AS (
      SELECT trim, max(n_pos) pairs, max(auc) FILTER (model = 'flat') flat,
        max(auc) FILTER (model = 'morpheme') morpheme, max(auc) FILTER (model = 'permuted') permuted
      FROM areas GROUP BY trim)
    SELECT trim, pairs, round(flat, 6) flat, round(morpheme, 6) morpheme, round(permuted, 6) permuted,
      round(morpheme - flat, 6) gap,
      round((morpheme - flat) / (SELECT morpheme - flat FROM t WHERE trim = 'none'), 6) retained FROM t""",
    grammar(TRIMS, False),
)
_boot = f"""{grammar(TRIMS[:1], False)}, items AS (
  SELECT {KEYS}, trim, decoy, row_number() OVER (PARTITION BY trim, decoy ORDER BY {order('item', *KEY)}) item,
    count(*) OVER (PARTITION BY trim, decoy) size
  FROM (SELECT DISTINCT {KEYS}, trim, decoy FROM long)
), draws AS (
  SELECT trim, decoy, resample, item draw,
    {pick('size', SEED, "'draw'", 'trim', 'decoy', 'resample', 'item')} + 1 item
  FROM items, range(200) b(resample)
), drawn AS (
  SELECT d.trim, d.decoy, d.resample, l.model, l.label, l.score
  FROM draws d JOIN items i ON i.trim = d.trim AND i.decoy = d.decoy AND i.item = d.item
  JOIN long l ON l.cdr3 = i.cdr3 AND l.v = i.v AND l.j = i.j AND l.epitope = i.epitope
    AND l.trim = i.trim AND l.decoy = i.decoy
  WHERE l.model IN ('flat', 'morpheme')
)"""
add(
    "gap_interval",
    f""", g AS (
      SELECT trim, decoy, resample,
        max(auc) FILTER (model = 'morpheme') - max(auc) FILTER (model = 'flat') gap
      FROM {area('drawn', 'trim, decoy, resample, model', 'score', 'label')} GROUP BY ALL
    ), s AS (SELECT trim, decoy, list_sort(list(gap)) gaps FROM g GROUP BY ALL)
    SELECT trim, decoy, round(gaps[6], 6) lo, round(gaps[196], 6) hi FROM s""",
    _boot,
)
add(
    "trim_intervals",
    f""", areas AS {_areas}, t AS (
      SELECT trim, max(n_pos) pairs, max(auc) FILTER (model = 'flat') flat,
        max(auc) FILTER (model = 'morpheme') morpheme, max(auc) FILTER (model = 'permuted') permuted
      FROM areas GROUP BY trim
    ), g AS (
      SELECT trim, resample, max(auc) FILTER (model = 'morpheme') - max(auc) FILTER (model = 'flat') gap
      FROM {area('drawn', 'trim, decoy, resample, model', 'score', 'label')} GROUP BY ALL
    ), s AS (SELECT trim, list_sort(list(gap)) gaps FROM g GROUP BY ALL)
    SELECT trim, pairs, round(flat, 6) flat, round(morpheme, 6) morpheme, round(permuted, 6) permuted,
      round(morpheme - flat, 6) gap,
      round((morpheme - flat) / (SELECT morpheme - flat FROM t WHERE trim = 'none'), 6) retained,
      round(gaps[6], 6) lo, round(gaps[196], 6) hi FROM t JOIN s USING (trim)""",
    _boot.replace(grammar(TRIMS[:1], False), grammar(TRIMS, False)),
)

# Ranking metrics
LABELLED = "labelled AS (SELECT l.*, lang, source, n_chars FROM labels l JOIN documents USING (doc_id))"


def partial(table: str, by: str, score: str, label: str) -> str:
    """Standardised partial AUC by walking the ROC points of every group."""
    return f"""(WITH pts AS (
      SELECT {by}, {score} s, count(*) FILTER ({label} = 1)::DOUBLE p, count(*) FILTER ({label} <> 1)::DOUBLE n
      FROM {table} GROUP BY ALL
    ), roc AS (
      SELECT {by}, sum(p) OVER w / sum(p) OVER g tpr, sum(n) OVER w / sum(n) OVER g fpr,
        (sum(p) OVER w - p) / sum(p) OVER g tpr0, (sum(n) OVER w - n) / sum(n) OVER g fpr0,
        sum(p) OVER g n_pos, sum(n) OVER g n_neg
      FROM pts WINDOW w AS (PARTITION BY {by} ORDER BY s DESC), g AS (PARTITION BY {by})
    ), seg AS (
      SELECT {by}, n_pos, n_neg, CASE WHEN fpr0 >= 0.1::DOUBLE OR fpr = fpr0 THEN 0
        WHEN fpr <= 0.1::DOUBLE THEN (fpr - fpr0) * (tpr + tpr0) / 2
        ELSE (0.1::DOUBLE - fpr0) * (tpr0 + (tpr - tpr0) * (0.1::DOUBLE - fpr0) / (fpr - fpr0) / 2) END a
      FROM roc WHERE n_pos > 0 AND n_neg > 0
    )
    SELECT {by}, any_value(n_pos) n_pos, any_value(n_neg) n_neg,
      0.5::DOUBLE * (1 + (sum(a) - 0.005::DOUBLE) / (0.1::DOUBLE - 0.005::DOUBLE)) auc01
    FROM seg GROUP BY {by})"""


add(
    "auc_by_source",
    f"SELECT source, n_pos, n_neg, round(auc, 6) auc FROM {area('labelled', 'source', 'n_chars', 'quality')}",
    LABELLED,
)
_by_source = partial("labelled", "source", "n_chars", "quality")
add("partial_auc_by_source", f"SELECT source, n_pos, n_neg, round(auc01, 6) auc01 FROM {_by_source}", LABELLED)
add(
    "macro_partial_auc",
    f"""SELECT count(*) n_groups, round(avg(auc01), 6) "all",
      round(avg(auc01) FILTER (source IN (SELECT source FROM labelled WHERE toxic = 1)), 6) seen,
      round(avg(auc01) FILTER (source NOT IN (SELECT source FROM labelled WHERE toxic = 1)), 6) unseen
    FROM {_by_source}""",
    LABELLED,
)
add("constant_score", "SELECT source, 0.5::DOUBLE auc01 FROM labelled GROUP BY source HAVING count(DISTINCT quality) = 2", LABELLED)
add(
    "paired_bootstrap",
    f""", d AS (
      SELECT source, a.auc01 - b.auc01 delta FROM {_by_source} a
      JOIN {partial('labelled', 'source', '-n_chars', 'quality')} b USING (source)
    ), items AS (
      SELECT delta, row_number() OVER (ORDER BY {order('item', 'source')}) item, count(*) OVER () size FROM d
    ), m AS (
      SELECT resample, avg(i.delta) m FROM (
        SELECT resample, {pick('size', SEED, "'draw'", 'resample', 'item')} + 1 item FROM items, range(5000) b(resample)
      ) JOIN items i USING (item) GROUP BY resample
    )
    SELECT (SELECT count(*) FROM d) n, (SELECT count(*) FROM d WHERE delta > 0) wins,
      (SELECT round(avg(delta), 6) FROM d) delta, round(lo, 6) lo, round(hi, 6) hi,
      CASE WHEN lo > 0 THEN 'better' WHEN hi > 0 THEN 'no sig. difference' ELSE 'worse' END verdict
    FROM (SELECT quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi FROM m)
    WHERE (SELECT count(*) FROM d) >= 3""",
    LABELLED,
)
add(
    "pooled_bootstrap",
    f""", d AS (
      SELECT source, a.auc01 - b.auc01 delta FROM {_by_source} a
      JOIN {partial('labelled', 'source', '-n_chars', 'quality')} b USING (source)
    ), items AS (
      SELECT delta, row_number() OVER (ORDER BY {order('item', 'source')}) item, count(*) OVER () size FROM d
    ), m AS (
      SELECT resample, avg(i.delta) m FROM (
        SELECT resample, {pick('size', SEED, "'draw'", 'resample', 'item')} + 1 item FROM items, range(2000) b(resample)
      ) JOIN items i USING (item) GROUP BY resample
    )
    SELECT (SELECT count(*) FROM d) n, (SELECT count(*) FROM d WHERE delta > 0) wins,
      (SELECT round(avg(delta), 6) FROM d) delta, round(lo, 6) lo, round(hi, 6) hi,
      CASE WHEN lo > 0 THEN 'better' WHEN hi > 0 THEN 'no sig. difference' ELSE 'worse' END verdict
    FROM (SELECT list_sort(list(m))[51] lo, list_sort(list(m))[1950] hi FROM m)
    WHERE (SELECT count(*) FROM d) >= 1""",
    LABELLED,
)
add(
    "ranked_sources",
    f"""SELECT source, row_number() OVER (ORDER BY round(auc, 9) DESC, source) place, round(auc, 6) auc
    FROM {area('labelled', 'source', 'n_chars', 'quality')} WHERE auc IS NOT NULL""",
    LABELLED,
)
add(
    "auc_spread",
    f"""SELECT lang, round(avg(auc), 6) mean, round(stddev_pop(auc), 6) sd
    FROM {area('labelled', 'source, lang', 'n_chars', 'quality')} GROUP BY lang""",
    LABELLED,
)
_fractions = ", ".join(f"({f}::DOUBLE)" for f in FRACTIONS)
CURVE = f"""{LABELLED}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY {order('curve', 'doc_id')}) rk, count(*) OVER () n FROM labelled
), kept AS (
  SELECT * FROM ranked, (VALUES {_fractions}) f(fraction) WHERE rk <= greatest(20, floor(n * fraction))
), curve AS (
  SELECT fraction, pairs, value FROM (SELECT fraction, count(*) pairs FROM kept GROUP BY fraction)
  JOIN (SELECT fraction, avg(auc) AS value FROM {area('kept', 'fraction, lang', 'n_chars', 'quality')} GROUP BY fraction)
  USING (fraction)
)"""
add("size_curve", 'SELECT fraction, pairs, round("value", 6) AS "value" FROM curve', CURVE)
add(
    "curve_fit",
    """, c AS (SELECT *, ln(pairs) x, row_number() OVER (ORDER BY pairs) rk, count(*) OVER () n FROM curve),
    f AS (
      SELECT regr_slope("value", x) slope, regr_intercept("value", x) intercept, corr("value", x) r,
        regr_slope("value", x) FILTER (rk > n // 2) upper_slope,
        max("value") FILTER (rk = 1) first_value, max("value") FILTER (rk = n) last_value, max(pairs) largest
      FROM c)
    SELECT round(slope, 6) slope, round(intercept, 6) intercept, round(r, 6) r, round(upper_slope, 6) upper_slope,
      round(first_value, 6) first_value, round(last_value, 6) last_value, largest,
      CASE WHEN last_value <= 0.005 THEN 'none'
           WHEN upper_slope > 0.5 * slope AND upper_slope > 0.004 THEN 'trend'
           WHEN upper_slope < 0.25 * slope THEN 'threshold' ELSE 'ambiguous' END shape FROM f""",
    CURVE,
)

add(
    "size_to_reach",
    """, f AS (SELECT regr_slope("value", ln(pairs)) slope, regr_intercept("value", ln(pairs)) intercept FROM curve)
    SELECT target, round(ln(exp((target - intercept) / slope)), 6) log_size
    FROM f, (VALUES (0.45::DOUBLE), (0.55::DOUBLE)) t(target)""",
    CURVE,
)

# Distances
NEAR = f"""{PAIRED}, peps AS (SELECT DISTINCT "Peptide" s FROM train), near AS (
  SELECT a.s a, b.s b, levenshtein(a.s, b.s) distance FROM peps a JOIN peps b ON a.s <> b.s
  WHERE levenshtein(a.s, b.s) <= 3
)"""
add("near_peptides", "SELECT * FROM near WHERE a < b", NEAR)
add(
    "peptide_pools",
    """SELECT s "Peptide", (SELECT count(*) FROM near WHERE a = s) n_near,
      (SELECT count(*) FROM peps q WHERE q.s <> peps.s AND levenshtein(q.s, peps.s) > 3) n_far FROM peps""",
    NEAR,
)
PARTS = "names AS (SELECT DISTINCT p_name s FROM part)"
add(
    "near_part_names",
    """SELECT a.s a, b.s b, levenshtein(a.s, b.s) distance FROM names a JOIN names b ON a.s < b.s
    WHERE levenshtein(a.s, b.s) <= 3""",
    PARTS,
)
add(
    "far_part_names",
    """SELECT a.s p_name, count(*) FILTER (levenshtein(a.s, b.s) <= 3 AND a.s <> b.s) near,
      count(*) FILTER (levenshtein(a.s, b.s) > 3) far FROM names a CROSS JOIN names b GROUP BY a.s""",
    PARTS,
)


def sim(a: str, b: str) -> str:
    return f"""(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0
      ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"""


NEAREST = f"""{PAIRED}, nq AS (SELECT DISTINCT "Peptide", "CDR3b" FROM test),
nr AS (SELECT DISTINCT "Peptide", "CDR3b" FROM train), best AS (
  SELECT nq."Peptide", nq."CDR3b", max({sim('nq."CDR3b"', 'nr."CDR3b"')}) sim
  FROM nq JOIN nr USING ("Peptide") GROUP BY ALL
), found AS (
  SELECT test.*, coalesce(sim, 0) sim FROM test LEFT JOIN best USING ("Peptide", "CDR3b")
)"""
add("nearest_binder", 'SELECT "Peptide", "CDR3b", "Vb", "Jb", "Label", round(sim, 6) sim FROM found', NEAREST)
add(
    "nearest_binder_means",
    f"""SELECT count(*) n_groups, round(avg(auc01), 6) "all",
      round(avg(auc01) FILTER ("Peptide" IN (SELECT "Peptide" FROM train)), 6) seen,
      round(avg(auc01) FILTER ("Peptide" NOT IN (SELECT "Peptide" FROM train)), 6) unseen
    FROM {partial('found', '"Peptide"', 'round(sim, 9)', '"Label"')}""",
    NEAREST,
)
_loops = ["CDR1a", "CDR2a", "CDR3a", "CDR1b", "CDR2b", "CDR3b"]
_quoted = ", ".join(f'"{c}"' for c in _loops)
_weighted = " + ".join(f"{w} * {sim(f'lq.{chr(34)}{c}{chr(34)}', f'lr.{chr(34)}{c}{chr(34)}')}" for c, w in zip(_loops, (1, 1, 3, 1, 1, 3)))
add(
    "nearest_loops",
    f"""SELECT test."Peptide", {', '.join(f'test."{c}"' for c in _loops)}, "Label", round(coalesce(sim, 0), 6) sim
    FROM test LEFT JOIN lbest b ON test."Peptide" = b."Peptide"
      AND {' AND '.join(f'test."{c}" IS NOT DISTINCT FROM b."{c}"' for c in _loops)}""",
    f"""{PAIRED}, lq AS (SELECT DISTINCT "Peptide", {_quoted} FROM test),
    lr AS (SELECT DISTINCT "Peptide", {_quoted} FROM train), lbest AS (
      SELECT lq."Peptide", {', '.join(f'lq."{c}"' for c in _loops)}, max({_weighted}) / 10 sim
      FROM lq JOIN lr ON lq."Peptide" = lr."Peptide" GROUP BY ALL)""",
)

# Splits and samples
add("top_epitopes", "SELECT epitope, count(*) n FROM parsed GROUP BY epitope HAVING count(*) >= 150 ORDER BY n DESC, epitope LIMIT 20", PARSED)
add(
    "capped_epitopes",
    f"""SELECT {KEYS} FROM parsed
    WHERE epitope IN (SELECT epitope FROM parsed GROUP BY epitope HAVING count(*) >= 150 ORDER BY count(*) DESC, epitope LIMIT 20)
    QUALIFY row_number() OVER (PARTITION BY epitope ORDER BY {order('cap', *KEY)}) <= 800""",
    PARSED,
)
add(
    "study_folds",
    f"""SELECT study, (row_number() OVER (ORDER BY {order('fold', 'study')}) - 1) % 5 fold
    FROM (SELECT DISTINCT unnest(studies) study FROM clones)""",
    CLONES,
)
add(
    "within_epitope_split",
    f"""SELECT {KEYS}, row_number() OVER (PARTITION BY epitope ORDER BY {order('within', *KEY)})
      <= floor(count(*) OVER (PARTITION BY epitope) * 0.8::DOUBLE) in_train FROM clones""",
    CLONES,
)
add(
    "overlap_removal",
    f""", dealt AS (
      SELECT epitope, (row_number() OVER (ORDER BY {order('fold', 'epitope')}) - 1) % 5 fold
      FROM (SELECT DISTINCT epitope FROM clones)
    ), sides AS (SELECT {KEYS}, fold FROM clones JOIN dealt USING (epitope))
    SELECT {KEYS} FROM sides WHERE fold = 0
      AND (cdr3, v, j) NOT IN (SELECT (cdr3, v, j) FROM sides WHERE fold <> 0)""",
    CLONES,
)
_skip = "list_reduce({0}, lambda acc, gap: acc + (acc >= gap)::BIGINT, {1})"
add(
    "epitope_negatives",
    f""", pool AS (
      SELECT epitope, row_number() OVER (ORDER BY {order('pool', 'epitope')}) - 1 slot, count(*) OVER () slots
      FROM (SELECT DISTINCT epitope FROM clones)
    ), taken AS (
      SELECT cdr3, v, j, list_sort(list(slot::BIGINT)) taken FROM clones JOIN pool USING (epitope) GROUP BY ALL
    ), drawn AS (
      SELECT cdr3, v, j, {_skip.format('taken', pick('(SELECT max(slots) FROM pool) - len(taken)', SEED, "'negative'", 'cdr3', 'v', 'j', 'epitope', "'1'"))} slot
      FROM clones JOIN taken USING (cdr3, v, j) WHERE len(taken) < (SELECT max(slots) FROM pool)
    )
    SELECT {KEYS}, 1 AS label FROM clones
    UNION ALL SELECT cdr3, v, j, epitope, 0 FROM drawn JOIN pool USING (slot)""",
    CLONES,
)
_donor = ["Va", "Ja", "CDR1a", "CDR2a", "CDR3a", "Vb", "Jb", "CDR1b", "CDR2b", "CDR3b"]
_train_columns = ["Peptide", "HLA", *_donor]
_copy = "row_number() OVER (PARTITION BY {0})".format(", ".join(f'"{c}"' for c in _train_columns))
_grp = digest(*[f"coalesce(\"{c}\", '')" for c in _train_columns], _copy)


def swaps(scheme: str, exclude: bool, source: str = "train") -> str:
    """CTEs ending in ``pairs``: positives and drawn negatives."""
    tries = 15 if exclude else 5
    excluded = {
        "challenge": "list_sort(list_append(near, slot))",
        "matched": "list_sort(list_append(near, slot))",
    }.get(scheme, "[slot]")
    free = {
        "hard": "len(near)",
        "matched": f"CASE WHEN len(near) > 0 THEN slots - len({excluded}) ELSE 0 END",
    }.get(scheme, f"slots - len({excluded})")
    at = pick("free", SEED, "'donor peptide'", "grp", "draw")
    slot = f"near[({at})::INT + 1]" if scheme == "hard" else _skip.format("excluded", at)
    known = (
        'AND ("CDR3b", pep) NOT IN (SELECT ("CDR3b", "Peptide") FROM pos)' if exclude else ""
    )
    donors = ", ".join(f'd."{c}"' for c in _donor)
    return f"""pos AS (SELECT *, {_grp} grp FROM {source}),
sizes AS (SELECT "Peptide", count(*) n_rows FROM pos GROUP BY ALL),
slots AS (
  SELECT "Peptide", n_rows, (row_number() OVER (ORDER BY {order('peptide', '"Peptide"')}) - 1)::BIGINT slot,
    count(*) OVER () slots FROM sizes
), idx AS (
  SELECT s.*, coalesce((SELECT list_sort(list(t.slot)) FROM slots t
    WHERE t."Peptide" <> s."Peptide" AND levenshtein(t."Peptide", s."Peptide") <= 3), []::BIGINT[]) near
  FROM slots s
), pools AS (
  SELECT "Peptide" pep, near, {excluded} excluded, {free} free FROM idx
), draws AS (
  SELECT grp, pep, "HLA" hla, draw, {slot} slot
  FROM pos JOIN pools ON pep = "Peptide", range(1, {tries + 1}) t(draw) WHERE free > 0
), placed AS (
  SELECT draws.*, {pick('n_rows', SEED, "'donor row'", 'grp', 'draw')} + 1 place FROM draws JOIN idx USING (slot)
), donors AS (
  SELECT slot, row_number() OVER (PARTITION BY "Peptide" ORDER BY {order('donor', 'grp')}) place,
    {', '.join(f'"{c}"' for c in _donor)} FROM pos JOIN idx USING ("Peptide")
), made AS (
  SELECT grp, draw, 0 AS label, pep "Peptide", hla "HLA", {donors}
  FROM placed p JOIN donors d ON d.slot = p.slot AND d.place = p.place WHERE true {known}
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY draw) <= 5
), pairs AS (
  SELECT grp, 0 AS draw, 1 AS label, {', '.join(f'"{c}"' for c in _train_columns)} FROM pos
  UNION ALL SELECT * FROM made
)"""


add(
    "pair_summary",
    """SELECT part, count(*) n_rows, count(DISTINCT "Peptide") peptides, round(avg("Label"), 6) positive_rate
    FROM paired GROUP BY part""",
    PAIRED,
)
_pair_columns = 'SELECT grp, draw, label, "Peptide", "HLA", "Vb", "Jb", "CDR3a", "CDR3b" FROM pairs'
for _name, _scheme, _exclude in (
    ("challenge_negatives", "challenge", False),
    ("challenge_negatives_excluding", "challenge", True),
    ("random_negatives", "random", True),
    ("hard_negatives", "hard", True),
    ("matched_negatives", "matched", True),
):
    add(_name, _pair_columns, f"{PAIRED}, {swaps(_scheme, _exclude)}")

_short = ", ".join(f'"{c}" AS "{t}"' for c, t in zip(_loops, ("A1", "A2", "A3", "B1", "B2", "B3")))
_present = " AND ".join(f'"{c}" IS NOT NULL' for c in _loops)
_widths = (
    'length("CDR1a") <= 7 AND length("CDR2a") <= 8 AND length("CDR3a") <= 22 AND length("CDR1b") <= 6 '
    'AND length("CDR2b") <= 7 AND length("CDR3b") <= 23 AND length("Peptide") <= 12'
)
add(
    "external_export",
    f"""SELECT CASE WHEN in_validation THEN 'val' ELSE 'train' END part, {_short}, "Peptide" peptide,
      label binder, 0 AS "partition" FROM pairs JOIN side USING (grp) WHERE {_widths}
    UNION ALL SELECT 'test', {_short}, "Peptide", "Label", 0 FROM test WHERE {_present} AND {_widths}""",
    f"""{PAIRED}, usable AS (SELECT * FROM train WHERE {_present}), {swaps('challenge', False, 'usable')},
    side AS (
      SELECT grp, row_number() OVER (ORDER BY {order('validation', 'grp')}) <= floor(count(*) OVER () * 0.2::DOUBLE) in_validation
      FROM (SELECT DISTINCT grp FROM pairs))""",
)


# Tokens
def grams(text: str, k: int, tag: str) -> str:
    return f"list_transform(range(1, length({text}) - {k - 2}), lambda i: '{tag}' || substr({text}, i::INT, {k}))"


_kmer = f"CASE WHEN length(cdr3) >= 3 THEN {grams('cdr3', 3, 'K3=')} ELSE ['K3=NONE'] END"
_segment = "['V=' || v, 'J=' || j]"
_parsed = (
    "['V=' || v, 'J=' || j, 'VP=' || v_prefix, 'JS=' || j_suffix, 'NL=' || least(length(n_region), 12)] || "
    f"{grams('n_region', 3, 'N3=')} || {grams('n_region', 2, 'N2=')}"
)


def epitope_list(text: str, hla: str = "") -> str:
    head = f"['E=' || {text}, 'EL=' || length({text})" + (f", 'H=' || {hla}]" if hla else "]")
    spots = f"list_transform(range(0, length({text})), lambda i: 'EP' || i || '=' || substr({text}, i::INT + 1, 1))"
    return f"{head} || {spots} || {grams(text, 3, 'E3=')}"


for _name, _list in (("kmer_tokens", _kmer), ("parsed_tokens", _parsed), ("segment_tokens", _segment)):
    add(_name, f"SELECT {KEYS}, array_to_string({_list}, ' ') tokens FROM parsed", PARSED)
_tags = ("A13=", "A23=", "A33=", "B13=", "B23=", "B33=")
_loop_list = " || ".join(
    f"CASE WHEN coalesce(length(\"{c}\"), 0) >= 3 THEN {grams(chr(34) + c + chr(34), 3, t)} ELSE []::VARCHAR[] END"
    for c, t in zip(_loops, _tags)
)
add(
    "loop_token_lists",
    f"""SELECT "Peptide", {_quoted}, "Label",
      array_to_string(CASE WHEN len(toks) > 0 THEN toks ELSE ['CDR=NONE'] END, ' ') tokens,
      array_to_string({epitope_list('"Peptide"', '"HLA"')}, ' ') peptide_tokens
    FROM (SELECT *, {_loop_list} toks FROM test)""",
    PAIRED,
)
add(
    "benchmark_tokens",
    f"""SELECT DISTINCT "Peptide", "HLA", "Vb", "Jb", "CDR3b", array_to_string(
      CASE WHEN okay THEN {_parsed}
      ELSE ['MORPH=UNPARSED', 'V=' || v, 'J=' || j] || {grams('"CDR3b"', 3, 'K3=')} END, ' ') tokens
    FROM (SELECT *, status <> 'unparsed' okay FROM parsed_all)""",
    f"""{PAIRED}, src AS (
      SELECT upper("CDR3b") cdr3, trim(split_part("Vb", '*', 1)) v, trim(split_part("Jb", '*', 1)) j FROM train
    ), tst AS (
      SELECT * EXCLUDE ("Va", "Ja"), upper("CDR3b") cdr3, trim(split_part("Vb", '*', 1)) v, trim(split_part("Jb", '*', 1)) j FROM test
    ), {anchors_from('src', 10)}, {parse_from('tst').replace("WHEN malformed THEN 'malformed'", "WHEN false THEN ''")}""",
)
add(
    "feature_cross",
    f"""SELECT {KEYS}, len(toks) n, md5(array_to_string(toks, ' ')) digest FROM (
      SELECT {KEYS}, flatten(list_transform(t, lambda a: list_transform(e, lambda b: a || '|' || b)))
        || list_transform(t, lambda a: 'T!' || a) || list_transform(e, lambda b: 'E!' || b) toks
      FROM (SELECT {KEYS}, ({_parsed}) t, ({epitope_list('epitope')}) e FROM parsed))""",
    PARSED,
)

def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return table


# CRC-32 of each distinct token, byte by byte.
add(
    "bucket_counts",
    f""", tokens AS (
      SELECT tok, count(*) n FROM (
        SELECT unnest(flatten(list_transform(t, lambda a: list_transform(e, lambda b: a || '|' || b)))
          || list_transform(t, lambda a: 'T!' || a) || list_transform(e, lambda b: 'E!' || b)) tok
        FROM (SELECT ({_parsed}) t, ({epitope_list('epitope')}) e FROM parsed)) GROUP BY tok
    ), hashed AS (
      SELECT n, list_reduce(
        list_transform(range(1, length(tok) + 1), lambda i: ascii(substr(tok, i::INT, 1))::BIGINT),
        lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT) crc
      FROM tokens
    )
    SELECT (xor(crc, 4294967295) & 262143)::INT bucket, sum(n)::BIGINT n FROM hashed GROUP BY ALL""",
    PARSED,
)
add(
    "linear_scores",
    f""", listed AS (
      SELECT {KEYS}, unnest(flatten(list_transform(t, lambda a: list_transform(e, lambda b: a || '|' || b)))
        || list_transform(t, lambda a: 'T!' || a) || list_transform(e, lambda b: 'E!' || b)) tok
      FROM (SELECT {KEYS}, ({_parsed}) t, ({epitope_list('epitope')}) e FROM parsed)
    ), hashed AS (
      SELECT tok, (xor(list_reduce(
        list_transform(range(1, length(tok) + 1), lambda i: ascii(substr(tok, i::INT, 1))::BIGINT),
        lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) & 262143) bucket
      FROM (SELECT DISTINCT tok FROM listed)
    )
    SELECT {KEYS}, round(0.25::DOUBLE + sum((bucket * 7919 % 1009 - 504) / 1000.0::DOUBLE), 6) score
    FROM listed JOIN hashed USING (tok) GROUP BY ALL""",
    PARSED,
)


def _seed_pairs(seed: int, kept: str, scope: list[str], known: str) -> str:
    """Rows of ``kept`` and one negative for each, drawn within ``scope``; ``known`` lists what is recorded."""
    at = ", ".join(scope)
    free = "slots - len(taken)"
    drawn = pick(free, seed, "'negative'", *scope, "cdr3", "v", "j", "epitope", "'1'")
    return f"""(WITH kept AS ({kept}), pool AS (
      SELECT *, row_number() OVER (PARTITION BY {at} ORDER BY {order('pool', 'epitope', seed=seed)}) - 1 slot,
        count(*) OVER (PARTITION BY {at}) slots FROM (SELECT DISTINCT {at}, epitope FROM kept)
    ), known AS ({known}), taken AS (
      SELECT {at}, cdr3, v, j, list_sort(list(DISTINCT slot::BIGINT)) taken
      FROM known JOIN pool USING ({at}, epitope) GROUP BY ALL
    ), based AS (
      SELECT k.*, s.slots, taken FROM kept k JOIN (SELECT DISTINCT {at}, slots FROM pool) s USING ({at})
      JOIN taken USING ({at}, cdr3, v, j) WHERE {free} > 0
    ), drawn AS (SELECT {at}, cdr3, v, j, {_skip.format('taken', drawn)} slot FROM based)
    SELECT {seed} seed, {at}, {KEYS}, 1 AS label FROM kept
    UNION ALL SELECT {seed}, {at}, cdr3, v, j, epitope, 0 FROM drawn JOIN pool USING ({at}, slot))"""


LARGEST = f"""{PARSED}, rws AS (
  SELECT {KEYS} FROM parsed WHERE epitope IN (
    SELECT epitope FROM parsed GROUP BY epitope HAVING count(*) >= 150 ORDER BY count(*) DESC, epitope LIMIT 20)
)"""


def _control(seed: int) -> str:
    ranked = f"""SELECT *, row_number() OVER (PARTITION BY epitope ORDER BY {order('within', *KEY, seed=seed)})
      <= floor(count(*) OVER (PARTITION BY epitope) * 0.8::DOUBLE) in_train FROM rws"""
    kept = f"""SELECT in_train, {KEYS} FROM ({ranked})
      QUALIFY NOT in_train OR row_number() OVER (PARTITION BY epitope, in_train ORDER BY {order('cap', *KEY, seed=seed)}) <= 800"""
    known = "SELECT b.in_train, k.cdr3, k.v, k.j, k.epitope FROM kept k, (VALUES (true), (false)) b(in_train)"
    return f"SELECT seed, in_train, {KEYS}, label FROM {_seed_pairs(seed, kept, ['in_train'], known)}"


def _unseen(seed: int) -> str:
    dealt = f"""(SELECT epitope, (row_number() OVER (ORDER BY {order('fold', 'epitope', seed=seed)}) - 1) % 2 own
      FROM (SELECT DISTINCT epitope FROM rws))"""
    sides = f"""SELECT fold::INT fold, fold <> own in_train, r.*,
        row_number() OVER (PARTITION BY epitope, fold ORDER BY {order('cap', *KEY, seed=seed)}) cp
      FROM rws r JOIN {dealt} d USING (epitope), range(2) f(fold)"""
    kept = f"""SELECT fold, in_train, {KEYS} FROM ({sides}) s
      WHERE (in_train AND cp <= 800) OR (NOT in_train AND NOT EXISTS (
        SELECT 1 FROM ({sides}) t WHERE t.in_train AND t.cp <= 800 AND t.fold = s.fold AND t.cdr3 = s.cdr3
          AND t.v = s.v AND t.j = s.j))"""
    pairs = _seed_pairs(seed, kept, ["fold", "in_train"], f"SELECT fold, in_train, {KEYS} FROM kept")
    return f"SELECT seed, fold, in_train, {KEYS}, label FROM {pairs}"


add("control_pairs", " UNION ALL ".join(_control(SEED + 999 + 31 * k) for k in range(3)), LARGEST)
add("unseen_pairs", " UNION ALL ".join(_unseen(SEED + 1000 * k) for k in range(5)), LARGEST)

# Text checks
add(
    "bullet_lengths",
    """SELECT doc_id, bullet, length(trim(line)) chars, length(trim(line)) > 85 too_long FROM (
      SELECT doc_id, unnest(lines) line, unnest(range(1, len(lines) + 1)) bullet
      FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^- (.+)$', 1) lines FROM documents))""",
)
add(
    "document_words",
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\*\*(.+?)\*\*', '\1', 'g'),
        '\[[\d,–— -]+\]', '', 'g'), ' +([.,;])', '\1', 'g'), '\nKeywords:.*', '', 'gs'), '\s+'),
      lambda w: w <> '')) words FROM documents""",
)
