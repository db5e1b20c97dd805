"""SQL text, for an independent engine, of the record tables and the shared early steps."""

from __future__ import annotations

AA = "ACDEFGHIKLMNPQRSTVWY"


def _res(index: str) -> str:
    return f"substr('{AA}', (({index}) % 20)::INT + 1, 1)"


def _run(start: str, size: str) -> str:
    return f"substr('{AA}{AA}', ({start})::INT, {size})"


BASE = f"""
nums AS (
  SELECT l_orderkey ok, l_partkey pk, l_suppkey sk, l_orderkey * 8 + l_linenumber rid,
         l_suppkey % 8 vi, l_partkey % 6 ji, (l_partkey + l_suppkey) % 5 ei
  FROM lineitem
), ends AS (
  SELECT *,
    substr('CASSCSARCSVGCAWSCATSCASRCSASCAIS', (vi * 4)::INT + 1, 4) v_full,
    substr('YEQYFNEQFFDTQYFYGYTFTEAFFGELFF', (ji * 5)::INT + 1, 5) j_full,
    CASE vi WHEN 0 THEN 'TRBV19' WHEN 1 THEN 'TRBV20-1' WHEN 2 THEN 'TRBV29-1' WHEN 3 THEN 'TRBV30'
            WHEN 4 THEN 'TRBV15' WHEN 5 THEN 'TRBV27' WHEN 6 THEN 'TRBV5-9' ELSE 'TRBV10-3' END v_gene,
    CASE ji WHEN 0 THEN 'TRBJ2-7' WHEN 1 THEN 'TRBJ2-1' WHEN 2 THEN 'TRBJ2-3' WHEN 3 THEN 'TRBJ1-2'
            WHEN 4 THEN 'TRBJ1-1' ELSE 'TRBJ2-2' END j_gene
  FROM nums
), base AS (
  SELECT *,
    CASE WHEN rid % 10007 % 9 = 0 THEN left(v_full, 3) ELSE v_full END
    || {_res('vi * 3 + ok % 4')} || {_res('ok * 7 + pk')}
    || CASE WHEN ei = 0 AND ok % 3 = 0 THEN 'RS' ELSE '' END
    || CASE WHEN ok % 2 = 0 THEN {_res('pk * 11 + ok')} ELSE '' END
    || {_res('ji * 5 + ok % 3')}
    || CASE WHEN rid % 10007 % 11 = 0 THEN right(j_full, 4) ELSE j_full END
    || CASE WHEN rid % 10007 % 997 = 0 THEN 'GPG' || j_full
            WHEN rid % 10007 % 13 = 0 THEN 'F' ELSE '' END AS cdr3,
    v_gene || CASE WHEN rid % 3 = 0 THEN '*01' ELSE '' END AS v_call,
    j_gene || CASE WHEN rid % 4 = 0 THEN '*01' ELSE '' END AS j_call
  FROM ends
)"""

PEPTIDE = (
    "CASE {0} WHEN 0 THEN 'GILGFVFTL' WHEN 1 THEN 'NLVPMVATV' WHEN 2 THEN 'GLCTLVAML' "
    "WHEN 3 THEN 'GILGFVFTV' ELSE 'ELAGIGILTV' END"
)

RAW = f"""{BASE}, raw AS (
  SELECT CASE WHEN rid % 31 = 0 THEN ' ' || lower(cdr3) || ' '
              WHEN rid % 43 = 0 THEN cdr3 || 'X' ELSE cdr3 END AS cdr3,
         v_call, CASE WHEN rid % 53 = 0 THEN '' ELSE j_call END AS j_call,
         {PEPTIDE.format('ei')} AS epitope,
         CASE WHEN rid % 29 = 0 THEN 'MusMusculus' ELSE 'HomoSapiens' END AS species,
         'HLA-A*0' || (pk % 3 + 1) AS mhc,
         CASE WHEN ok % 23 = 7 THEN '' ELSE 'S' || (ok % 23) END AS study
  FROM base
)"""

CLEAN = f"""{RAW}, clean AS (
  SELECT upper(trim(cdr3)) cdr3, trim(split_part(v_call, '*', 1)) v,
         trim(split_part(j_call, '*', 1)) j, upper(trim(epitope)) epitope, mhc,
         CASE WHEN trim(study) = '' THEN 'unknown' ELSE trim(study) END study
  FROM raw
  WHERE species = 'HomoSapiens' AND trim(v_call) <> '' AND trim(j_call) <> ''
    AND regexp_full_match(upper(trim(cdr3)), '[{AA}]{{6,}}')
    AND regexp_full_match(upper(trim(epitope)), '[{AA}]+')
)"""

CLONES = f"""{CLEAN}, clones AS (
  SELECT cdr3, v, j, epitope, min(mhc) mhc, count(*) n_rows,
         list_sort(list(DISTINCT study)) studies
  FROM clean GROUP BY cdr3, v, j, epitope
)"""


def anchors_from(table: str, support: int) -> str:
    """Consensus anchors of ``table(cdr3, v, j)``, as CTEs ending in ``anchors``."""
    return f"""pos AS (
  SELECT 'V' side, v gene, k, substr(cdr3, k::INT + 1, 1) aa
  FROM {table}, range(8) r(k) WHERE length(cdr3) > k + 1
  UNION ALL
  SELECT 'J', j, k, substr(cdr3, length(cdr3) - k::INT, 1)
  FROM {table}, range(8) r(k) WHERE length(cdr3) > k + 1
), hist AS (
  SELECT side, gene, k, aa, count(*) n FROM pos GROUP BY ALL
), modal AS (
  SELECT side, gene, k, aa, n, sum(n) OVER (PARTITION BY side, gene, k) total,
         row_number() OVER (PARTITION BY side, gene, k ORDER BY n DESC, aa) rn
  FROM hist
), called AS (
  SELECT side, gene, k, aa, n, total,
         min(CASE WHEN n::DOUBLE / total >= 0.80 THEN 1 ELSE 0 END)
           OVER (PARTITION BY side, gene ORDER BY k) AS holds
  FROM modal WHERE rn = 1
), sup AS (
  SELECT 'V' side, v gene, count(*) support FROM {table} GROUP BY ALL
  UNION ALL SELECT 'J', j, count(*) FROM {table} GROUP BY ALL
), anchors AS (
  SELECT side, gene,
         CASE side WHEN 'V' THEN string_agg(aa, '' ORDER BY k)
              ELSE string_agg(aa, '' ORDER BY k DESC) END anchor,
         any_value(support) support
  FROM called JOIN sup USING (side, gene)
  WHERE holds = 1 AND support >= {support} GROUP BY side, gene
)"""


def parse_from(table: str) -> str:
    """Status and parts of ``table`` rows, as CTEs ending in ``parsed_all``.

    Written with whole-string searches from the end, unlike the plan under test.
    """
    return f"""full_j AS (
  SELECT list(DISTINCT anchor) fj FROM anchors WHERE side = 'J' AND length(anchor) >= 4
), matched AS (
  SELECT c.*, av.anchor va, aj.anchor ja, coalesce(fj, []) fj
  FROM {table} c
  LEFT JOIN anchors av ON av.side = 'V' AND av.gene = c.v
  LEFT JOIN anchors aj ON aj.side = 'J' AND aj.gene = c.j
  CROSS JOIN full_j
), probed AS (
  SELECT *,
    len(list_filter(fj, lambda s: instr(cdr3, s) > 0
        AND instr(cdr3, s) - 1 + length(s) < length(cdr3) - 2)) > 0 AS malformed,
    list_filter(range(length(va), 0, -1), lambda i: starts_with(cdr3, left(va, i::INT)))[1] vl,
    list_filter(
      list_transform(range(0, length(ja) - 1), lambda i:
        CASE WHEN instr(reverse(cdr3), reverse(substr(ja, i::INT + 1))) BETWEEN 1 AND 3
             THEN instr(reverse(cdr3), reverse(substr(ja, i::INT + 1))) - 1 + length(ja) - i
        END),
      lambda x: x IS NOT NULL)[1] jl
  FROM matched
), parsed_all AS (
  SELECT * EXCLUDE (fj, va, ja, vl, jl, malformed), malformed,
    CASE WHEN malformed THEN 'malformed'
         WHEN length(va) >= 3 AND length(ja) >= 3 AND vl IS NOT NULL AND jl IS NOT NULL
              AND length(cdr3) - jl >= vl THEN 'parsed'
         ELSE 'unparsed' END status,
    left(cdr3, vl::INT) v_prefix,
    substr(cdr3, vl::INT + 1, (length(cdr3) - jl - vl)::INT) n_region,
    right(cdr3, jl::INT) j_suffix
  FROM probed
)"""


ANCHORS = f"{CLONES}, {anchors_from('clones', 20)}"
PARSED = f"""{ANCHORS}, {parse_from('clones')}, parsed AS (
  SELECT * FROM parsed_all WHERE status = 'parsed'
)"""

_test = "ok % 5 = 0"
_label = f"CASE WHEN NOT ({_test}) OR rid % 6 = 0 THEN 1 ELSE 0 END"
PAIRED = f"""{BASE}, fam AS (
  SELECT *, {_label} lab, CASE WHEN NOT ({_test}) AND ok % 4 = 0 AND ei = 4 THEN 3
       WHEN ({_label}) = 1 THEN ei ELSE (ei + 1 + rid % 4) % 5 END fm
  FROM base
), pep AS (
  SELECT *, {PEPTIDE.format('fm')} pep0 FROM fam
), paired AS (
  SELECT CASE WHEN {_test} THEN 'test' ELSE 'train' END part,
    CASE WHEN ok % 4 = 0 THEN left(pep0, 4) || {_res('pk * 7 + sk')} || substr(pep0, 6, 10)
         ELSE pep0 END "Peptide",
    'HLA-A*0' || (fm % 3 + 1) "HLA",
    'TRAV' || (pk % 7 + 1) "Va", 'TRAJ' || (pk % 5 + 1) "Ja",
    CASE WHEN rid % 17 <> 0 THEN {_run('pk % 7 * 2 + 1', '6')} END "CDR1a",
    {_run('pk % 5 * 3 + 1', 'CASE WHEN rid % 19 = 0 THEN 9 ELSE 7 END')} "CDR2a",
    'AV' || {_res('ok')} || {_run('pk % 11 + 1', '3')} || 'KLT' "CDR3a",
    v_call "Vb", j_call "Jb",
    {_run('vi * 2 + 1', '5')} "CDR1b", {_run('vi * 3 + 2', '6')} "CDR2b",
    substr(cdr3, 2, length(cdr3) - 2) "CDR3b",
    CASE WHEN NOT ({_test}) AND rid % 67 = 0 THEN 0 ELSE lab END "Label"
  FROM pep
), train AS (
  SELECT * EXCLUDE (part, "Label") FROM paired WHERE part = 'train' AND "Label" = 1
), test AS (
  SELECT * EXCLUDE (part) FROM paired WHERE part = 'test'
)"""
