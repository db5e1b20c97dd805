"""Hand-computed values and brute-force checks of the single operators."""

import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from junctura.functions import features as feat
from junctura.functions import sequence as seq
from junctura.operators import anchors as anchoring
from junctura.operators import annotate, cleaning, handmade, language, metrics, negatives
from junctura.operators import neighbours, ngrams, ranking, reports, resampling, splits
from junctura.operators.decoys import shuffled_decoy


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def mann_whitney(pos, neg):
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_base_gene_and_strip(spark):
    df = spark.createDataFrame([("TRBV19*01",), (" TRBV9 ",), ("A*01,B*02",), (None,)], "g string")
    assert [r[0] for r in df.select(seq.base_gene("g")).collect()] == ["TRBV19", "TRBV9", "A", ""]


@pytest.mark.parametrize("text,k,expected", [
    ("ABCD", 2, ["AB", "BC", "CD"]), ("ABCD", 4, ["ABCD"]), ("ABCD", 5, []), ("", 2, []), (None, 3, []),
    ("a\nb", 2, ["a\n", "\nb"]), ("é😀x", 2, ["é😀", "😀x"]),
])
def test_kmers(spark, text, k, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(seq.kmers("t", k)).first()[0] == expected


def test_norm_sim(spark):
    df = spark.createDataFrame([("ABC", "ABD"), ("", "A"), ("AB", "AB"), (None, "A")], "a string, b string")
    assert [r[0] for r in df.select(seq.norm_sim("a", "b")).collect()] == pytest.approx([2 / 3, 0.0, 1.0, 0.0])


def test_clean_records_drops_each_kind(spark):
    rows = [
        (" cassirssyeqyf ", "TRBV19*01", "TRBJ2-7", "gilgfvftl", "HomoSapiens", "A", ""),
        ("CASSX1", "TRBV19", "TRBJ2-7", "GIL", "HomoSapiens", "A", "s"),
        ("CASSF", "TRBV19", "TRBJ2-7", "GIL", "HomoSapiens", "A", "s"),
        ("CASSIRF", "", "TRBJ2-7", "GIL", "HomoSapiens", "A", "s"),
        ("CASSIRF", "TRBV19", "TRBJ2-7", "GIL", "MusMusculus", "A", "s"),
        ("CASSIRF", "TRBV19", "TRBJ2-7", None, "HomoSapiens", "A", "s"),
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cleaning.RAW_COLUMNS))
    assert values(cleaning.clean_records(raw), "cdr3", "v", "j", "epitope", "study") == [
        ("CASSIRSSYEQYF", "TRBV19", "TRBJ2-7", "GILGFVFTL", "unknown")
    ]


def test_clonotypes_do_not_depend_on_order_or_partitions(spark):
    rows = [("CASSF" * 2, "V", "J", "E", f"m{i % 3}", f"s{i % 4}", i) for i in range(20)] + [
        ("CASSG" * 2, "V", "J", "E", "m", "s", 99)
    ]
    schema = "cdr3 string, v string, j string, epitope string, mhc string, study string, at int"
    results = []
    for parts in (1, 5):
        df = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), schema).repartition(parts)
        out = cleaning.unique_clonotypes(df, first_by="at")
        results.append(sorted((r["cdr3"], r["mhc"], r["n_rows"], tuple(r["studies"])) for r in out.collect()))
    assert results[0] == results[1] == [
        ("CASSFCASSF", "m0", 20, ("s0", "s1", "s2", "s3")), ("CASSGCASSG", "m", 1, ("s",))
    ]


def test_cleaning_equals_a_search_of_every_value(spark):
    blanks = ["", " ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u200b", "\u3000"]
    bodies = ["", "*", "CASSIRF", "cassirf", "CASS IRF", "TRBV19*01", "TRBV9 *01", "*01", "é", "Cé", "éC", "\x7f", "\x7fC", "CASSX", "ſASSIRF", "😀", "CASSI\nF"]
    rows = [(a + body + b,) for a in blanks for body in bodies for b in blanks] + [(None,)]
    df = spark.createDataFrame(rows, "t string")

    def searched(value):
        return F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")

    def text(value):
        return F.upper(searched(value))

    def residues(value, least):
        return F.when(seq.canonical(text(value)) & (F.length(text(value)) >= least), text(value))

    got = df.select("t", seq.strip("t"), seq.base_gene("t"), seq.residues("t"), seq.residues("t", 7), seq.residues("t", 8))
    gene = searched(F.split_part(F.coalesce("t", F.lit("")), F.lit("*"), F.lit(1)))
    want = df.select("t", searched(F.col("t")), gene, *[residues(F.col("t"), n) for n in (1, 7, 8)])
    for a, b in zip(got.collect(), want.collect(), strict=True):
        assert tuple(a) == tuple(b)


def test_equal_records_are_counted_before_their_studies(spark):
    schema = "cdr3 string, v string, j string, epitope string, mhc string, study string"
    rows = [("C", "V", "J", "E", m, s) for m, s in [("b", "y"), ("b", "x"), ("b", "x"), ("a", "y"), (None, "y")]]
    found = cleaning.unique_clonotypes(spark.createDataFrame(rows + [("C", "V", "J", "F", None, None)], schema))
    assert values(found, *cleaning.CLONOTYPE, "mhc", "n_rows", "studies") == [
        ("C", "V", "J", "E", "a", 5, ["x", "y"]), ("C", "V", "J", "F", None, 1, [])
    ]
    # Read from the leaves up, records are first counted by all of their columns.
    steps = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x]
    assert len(steps) == 2 and "study" in steps[-1].split("]")[0] and "collect_set" not in steps[-1]


def test_anchor_stops_at_first_miss_and_needs_support(spark):
    rows = [("CASSQEYF", "V1", "J1")] * 16 + [("CATSQEYF", "V1", "J1")] * 4 + [("CASSQEYF", "RARE", "J1")]
    df = spark.createDataFrame(rows, "cdr3 string, v string, j string")
    got = {(r["side"], r["gene"]): r["anchor"] for r in anchoring.derive_anchors(df).collect()}
    # 16 of 20 is exactly the threshold, so position three passes; the last residue never counts.
    assert got == {("V", "V1"): "CASSQEY", ("J", "J1"): "ASSQEYF"}
    strict = anchoring.derive_anchors(df, threshold=0.81).filter("gene = 'V1'").first()
    assert strict["anchor"] == "CA"
    assert [p["aa"] for p in strict["profile"]] == ["C", "A", "S"]


def brute_split(cdr3, va, ja, min_j=2):
    if len(va) < 3 or len(ja) < 3:
        return None
    prefix = next((va[:i] for i in range(len(va), 0, -1) if cdr3.startswith(va[:i])), None)
    if not prefix:
        return None
    for i in range(len(ja) - min_j + 1):
        at = cdr3.rfind(ja[i:])
        if at >= 0 and len(cdr3) - at - len(ja[i:]) <= 2:
            suffix = cdr3[at:]
            if len(cdr3) - len(suffix) < len(prefix):
                return None
            return prefix, cdr3[len(prefix):len(cdr3) - len(suffix)], suffix
    return None


def test_split_matches_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        word = "".join(rng.choice("CASF") for _ in range(rng.randint(1, 12)))
        va = "".join(rng.choice("CAS") for _ in range(rng.randint(2, 5)))
        ja = "".join(rng.choice("ASF") for _ in range(rng.randint(2, 6)))
        if i % 2:
            word = va[: rng.randint(1, 5)] + word + ja[rng.randint(0, 3):] + rng.choice(["", "", "A", "FA"])
        rows.append((i, word, va, ja))
    df = spark.createDataFrame(rows, "i int, cdr3 string, v_anchor string, j_anchor string")
    got = {r["i"]: (r["v_prefix"], r["n_region"], r["j_suffix"]) for r in annotate.with_parts(df).collect()}
    wanted = {i: brute_split(c, v, j) or (None, None, None) for i, c, v, j in rows}
    assert got == wanted
    assert sum(w[0] is not None for w in wanted.values()) > 100


def test_malformed_sequence_is_set_apart(spark):
    anchors = spark.createDataFrame(
        [("V", "V1", "CSV"), ("J", "J1", "NEQFF"), ("J", "J2", "YF")], "side string, gene string, anchor string"
    )
    rows = [("CSVPPGTDYNEQFFGPGTDYNEQFF", "V1", "J1"), ("CSVPPGTDYNEQFF", "V1", "J1"), ("CSVNEQFFGG", "V1", "J1"),
            ("CSVPPYF", "V1", "J2")]
    df = spark.createDataFrame(rows, "cdr3 string, v string, j string")
    assert values(annotate.parse(df, anchors), "cdr3", "status") == [
        ("CSVNEQFFGG", "parsed"), ("CSVPPGTDYNEQFF", "parsed"),
        ("CSVPPGTDYNEQFFGPGTDYNEQFF", "malformed"), ("CSVPPYF", "unparsed"),
    ]
    longer = anchors.unionByName(
        spark.createDataFrame([("J", "J3", "PPGTDYNEQFF")], anchors.schema)
    )
    found = annotate.contains_full_j(df, longer.filter("gene <> 'J1'"), F.col("cdr3"), "hit")
    assert [h for _, h in values(found, "cdr3", "hit")] == [False, True, True, False]
    none = annotate.contains_full_j(df, anchors.filter("side = 'V'"), F.col("cdr3"), "hit")
    assert not any(h for _, h in values(none, "cdr3", "hit"))


def test_hand_parse_examples(spark):
    rows = [("CASSIRSSYEQYF", "TRBV19", "TRBJ2-7"), ("CASSIGAYGYTF", "TRBV19", "TRBJ1-2"),
            ("CASSGLAGLNEQFF", "TRBV19*01", "TRBJ2-1*01"), ("CSVGTGGTNEKLFF", "TRBV29-1", "TRBJ1-4"),
            ("CSARLAGTEAFF", "TRBV20-1", "TRBJ1-1"), ("CASSLF", "UNKNOWN", "TRBJ1-1")]
    raw = spark.createDataFrame(
        [(c, v, j, "E") for c, v, j in rows], "`cdr3.beta` string, `v.beta` string, `j.beta` string, `antigen.epitope` string"
    )
    got = {r["cdr3"]: (r["v_prefix"], r["n_region"], r["j_suffix"]) for r in handmade.hand_parsed(raw).collect()}
    assert got == {
        "CASSIRSSYEQYF": ("CASS", "IRSS", "YEQYF"),
        "CASSIGAYGYTF": ("CASS", "IGA", "YGYTF"),
        "CASSGLAGLNEQFF": ("CASS", "GLAGL", "NEQFF"),
        "CSVGTGGTNEKLFF": ("CSVG", "TGGT", "NEKLFF"),
        "CSARLAGTEAFF": ("CSAR", "LAG", "TEAFF"),
        "CASSLF": (None, None, None),
    }


def fisher(a, b, c, d):
    n, r, k = a + b + c + d, a + b, a + c
    total = sum(math.comb(r, i) * math.comb(n - r, k - i) for i in range(a, min(r, k) + 1) if 0 <= k - i <= n - r)
    return total / math.comb(n, k)


def test_fisher_matches_exact_counts(spark):
    rng = random.Random(2)
    rows = [tuple(rng.randint(0, 60) for _ in range(4)) for _ in range(200)] + [(0, 0, 5, 5), (5, 0, 0, 0), (0, 5, 0, 5)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = df.select("a", "b", "c", "d", ngrams.fisher_greater(*[F.col(x) for x in "abcd"]).alias("p")).collect()
    for a, b, c, d, p in got:
        assert p == pytest.approx(1.0 if 0 in (a + b, a + c) else min(1.0, fisher(a, b, c, d)), rel=1e-9)
    big = spark.createDataFrame([(5_000_000, 5_000_000, 5_000_000, 5_000_000)], "a long, b long, c long, d long")
    assert big.select(ngrams.fisher_greater(*[F.col(x) for x in "abcd"])).first()[0] == pytest.approx(0.5, abs=1e-3)


@pytest.mark.parametrize("slices", [None, 1, 7])
def test_fdr_by_hand_and_in_slices(spark, slices):
    rng = random.Random(3)
    ps = {g: [round(rng.random(), 2) for _ in range(n)] for g, n in (("a", 40), ("b", 1), ("c", 9))}
    df = spark.createDataFrame([(g, i, p) for g, xs in ps.items() for i, p in enumerate(xs)], "g string, i int, p double")
    got = {(r["g"], r["i"]): r["q"] for r in ranking.adjust_fdr(df, ["g"], "p", slices=slices).collect()}
    for g, xs in ps.items():
        order = sorted(range(len(xs)), key=lambda i: xs[i], reverse=True)
        low = 1.0
        for place, i in enumerate(order):
            low = min(low, xs[i] * len(xs) / (len(xs) - place))
            assert got[g, i] == pytest.approx(low)


@pytest.mark.parametrize("slices", [None, 1, 9])
def test_auc_with_ties_and_hot_group(spark, slices):
    rng = random.Random(4)
    rows = [("hot", rng.randint(0, 30) / 3.0, rng.randint(0, 1)) for _ in range(300)]
    rows += [("tied", 1.0, i % 2) for i in range(6)] + [("one", float(i), 1) for i in range(4)]
    rows += [("perfect", float(i), int(i > 2)) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r["g"]: r["auc"] for r in metrics.auc(df, ["g"], "s", "y", slices=slices).collect()}
    hot = [(s, y) for g, s, y in rows if g == "hot"]
    assert got["hot"] == pytest.approx(mann_whitney([s for s, y in hot if y], [s for s, y in hot if not y]))
    assert got["tied"] == 0.5 and got["perfect"] == 1.0 and got["one"] is None


def brute_partial(rows, limit=0.1):
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    points, tp, fp = [(0.0, 0.0)], 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp += sum(1 for x, y in rows if x == s and y)
        fp += sum(1 for x, y in rows if x == s and not y)
        points.append((fp / neg, tp / pos))
    area = 0.0
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x0 >= limit or x1 == x0:
            continue
        end = min(x1, limit)
        y_end = y0 + (y1 - y0) * (end - x0) / (x1 - x0)
        area += (end - x0) * (y0 + y_end) / 2
    low = limit * limit / 2
    return 0.5 * (1 + (area - low) / (limit - low))


@pytest.mark.parametrize("slices", [None, 1, 11])
def test_partial_auc(spark, slices):
    rng = random.Random(5)
    groups = {f"g{k}": [(rng.randint(0, 12), rng.randint(0, 1)) for _ in range(60)] for k in range(6)}
    groups["flat"] = [(0, i % 3 == 0) for i in range(30)]
    groups["one"] = [(i, 1) for i in range(5)]
    df = spark.createDataFrame([(g, float(s), int(y)) for g, xs in groups.items() for s, y in xs], "g string, s double, y int")
    got = {r["g"]: r["auc01"] for r in metrics.partial_auc(df, ["g"], "s", "y", slices=slices).collect()}
    assert "one" not in got and got["flat"] == pytest.approx(0.5)
    for g in groups:
        if g.startswith("g"):
            assert got[g] == pytest.approx(brute_partial([(s, int(y)) for s, y in groups[g]]))


@pytest.mark.parametrize("slice_rows", [1_000_000, 10])
def test_hash_rank_is_the_same_in_slices(spark, slice_rows):
    df = spark.range(200).select(F.when(F.col("id") < 150, "hot").otherwise("cold").alias("g"), "id")
    rows = ranking.hash_rank(df.repartition(3), ["g"], ["id"], 1, "x", slice_rows=slice_rows).collect()
    import hashlib

    for g, ids in (("hot", range(150)), ("cold", range(150, 200))):
        order = sorted(ids, key=lambda i: hashlib.md5(f"1|x|{i}".encode()).hexdigest())
        assert {r["id"]: r["rank"] for r in rows if r["g"] == g} == {i: k + 1 for k, i in enumerate(order)}
        assert {r["size"] for r in rows if r["g"] == g} == {len(ids)}
    flat = ranking.hash_rank(df, [], ["id"], 1, slice_rows=slice_rows)
    assert sorted(r["rank"] for r in flat.collect()) == list(range(1, 201))


def test_near_pairs_are_complete(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("ABC") for _ in range(rng.randint(1, 8))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    wanted = {(a, b): edit_distance(a, b) for a, b in itertools.combinations(words, 2) if edit_distance(a, b) <= 3}
    got = {(r["a"], r["b"]): r["distance"] for r in neighbours.near_pairs(df, "w").collect()}
    assert got == wanted
    far = {r["w"]: r["far"] for r in neighbours.far_pairs(df, "w").collect()}
    assert far == {w: sum(edit_distance(w, x) > 3 for x in words) for w in words}


def test_near_pairs_of_long_variants(spark):
    rng = random.Random(16)
    words = set()
    for size in (12, 25, 60):
        base = [rng.choice("ACDE") for _ in range(size)]
        for _ in range(60):
            word = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(word))
                word[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "C", "G"])
            words.add("".join(word))
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for edits in (1, 2, 3):
        got = {(r["a"], r["b"]): r["distance"] for r in neighbours.near_pairs(df, "w", edits).collect()}
        every = {(a, b): edit_distance(a, b) for a, b in itertools.combinations(words, 2) if abs(len(a) - len(b)) <= 3}
        assert got == {pair: d for pair, d in every.items() if d <= edits}


def test_keys_of_a_value_do_not_grow_with_its_length(spark):
    df = spark.range(8, 200, 16).select(F.repeat(F.lit("ACDEF"), F.col("id").cast("int")).alias("w"))
    for keys, most in ((neighbours.own_segments, 4), (neighbours.sought_segments, 64)):
        sizes = keys(df, "w", 3).groupBy("w").count().collect()
        assert len(sizes) == 12 and all(r["count"] <= most for r in sizes)


def test_a_hot_family_of_variants(spark):
    """All share most segments, but only neighbours in the list are within three edits."""
    rng = random.Random(17)
    base = "".join(rng.choice("ACDEFGHIKL") for _ in range(40))
    words = [base[:20] + "".join("ACDEFGHIKL"[int(c)] for c in f"{i:04d}" for _ in (0, 1)) + base[20:] for i in range(600)]
    got = neighbours.near_pairs(spark.createDataFrame([(w,) for w in words], "w string"), "w").count()
    wanted = sum(edit_distance(a, b) <= 3 for a, b in itertools.combinations(words[:60], 2))
    part = neighbours.near_pairs(spark.createDataFrame([(w,) for w in words[:60]], "w string"), "w").count()
    assert part == wanted and got > part


def test_nearest_binder_and_loops_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = random.Random(7)

    def word():
        return "".join(rng.choice("CASFG") for _ in range(rng.randint(2, 9)))

    queries = [(g, word(), rng.choice(["AA", "AB", None]), i) for i in range(60) for g in ("p", "q", "none")]
    refs = [(g, word(), rng.choice(["AA", "BB", None])) for g in ("p", "q") for _ in range(50 if g == "p" else 3)]
    q = spark.createDataFrame(queries, "g string, t string, u string, i int")
    r = spark.createDataFrame(refs, "g string, t string, u string")

    def sim(a, b):
        return 0.0 if not a or not b else 1 - edit_distance(a, b) / max(len(a), len(b))

    got = {(x["g"], x["i"]): x["sim"] for x in neighbours.nearest_binder(q, r, "g", "t").collect()}
    both = {(x["g"], x["i"]): x["sim"] for x in neighbours.nearest_loops(q, r, "g", ["t", "u"], [3, 1]).collect()}
    for g, t, u, i in queries:
        mine = [x for x in refs if x[0] == g]
        assert got[g, i] == pytest.approx(max((sim(t, x[1]) for x in mine), default=0.0))
        assert both[g, i] == pytest.approx(max(((3 * sim(t, x[1]) + sim(u, x[2])) / 4 for x in mine), default=0.0))


def test_decoys(spark):
    df = spark.createDataFrame([("ABCDE",), ("AAAA",), ("AB",), ("",)], "s string")
    got = dict(df.select("s", shuffled_decoy("s", "s")).collect())
    assert got["AAAA"] is None and got["AB"] == "BA" and got[""] is None
    swapped = dict(df.select("s", shuffled_decoy("s", "s", tries=1)).collect())
    assert swapped["AB"] == "BA"
    words = spark.createDataFrame([("AABCA",), ("AAAB",), ("ABA",)], "s string")
    first = dict(words.select("s", shuffled_decoy("s", "s", tries=0)).collect())
    assert first == {"AABCA": "BAACA", "AAAB": "BAAA", "ABA": "BAA"}
    assert sorted(got["ABCDE"]) == sorted("ABCDE") and got["ABCDE"] != "ABCDE"


def test_bigram_model_by_hand(spark):
    train = spark.createDataFrame([("AC",), ("AA",)], "s string")
    scored = language.score_models(train, train, "s", {}).collect()
    counts = {("^", "A"): 2, ("A", "C"): 1, ("C", "$"): 1, ("A", "A"): 1, ("A", "$"): 1}
    totals = {"^": 2, "A": 3, "C": 1}
    for row in scored:
        path = "^" + row["s"] + "$"
        wanted = sum(math.log((counts.get(p, 0) + 0.5) / (totals[p[0]] + 10.5)) for p in zip(path, path[1:]))
        assert row["flat"] == pytest.approx(wanted)


def test_features_by_hand(spark):
    df = spark.createDataFrame([("CASS", "V1", "J1", "GIL", "CA", "S", "S")], "c string, v string, j string, e string, p string, n string, s string")
    got = df.select(
        feat.kmer_tokens("c"), feat.parsed_tokens("v", "j", F.col("p"), F.col("n"), F.col("s")), feat.peptide_tokens("e"),
        feat.cross_tokens(feat.segment_tokens("v", "j"), feat.peptide_tokens("e"), 2), feat.buckets(F.array(F.lit("T!V=V1"))),
    ).first()
    import zlib

    assert got[0] == ["K3=CAS", "K3=ASS"]
    assert got[1] == ["V=V1", "J=J1", "VP=CA", "JS=S", "NL=1"]
    assert got[2] == ["E=GIL", "EL=3", "EP0=G", "EP1=I", "EP2=L", "E3=GIL"]
    assert got[3] == ["V=V1|E=GIL", "V=V1|EL=3", "J=J1|E=GIL", "J=J1|EL=3", "T!V=V1", "T!J=J1", "E!E=GIL", "E!EL=3"]
    assert got[4] == [zlib.crc32(b"T!V=V1") & (2**18 - 1)]


def test_epitope_negatives_are_valid(spark):
    rows = [(f"C{i}", "V", "J", f"E{i % 4}") for i in range(80)] + [("C0", "V", "J", f"E{k}") for k in range(1, 4)]
    df = spark.createDataFrame(rows, "cdr3 string, v string, j string, epitope string")
    out = negatives.epitope_negatives(df, df.select("epitope"))
    made = values(out.filter("label = 0"), "cdr3", "v", "j", "epitope")
    assert len(made) == 79 and not set(made) & set(rows)
    assert {m[3] for m in made} == {"E0", "E1", "E2", "E3"}


def test_swap_negatives_keep_their_rules(spark):
    peptides = ["AAAAAAAA", "AAAAAAAC", "CCCCCCCC", "DDDDDDDD"]
    columns = ["Peptide", "HLA", "Va", "Ja", "CDR1a", "CDR2a", "CDR3a", "Vb", "Jb", "CDR1b", "CDR2b", "CDR3b"]
    rows = [(p, "H", "v", "j", "a", "b", "c", "v", "j", "a", "b", f"{p[-2:]}{i}") for p in peptides for i in range(30)]
    train = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    home = {r[11]: r[0] for r in rows}
    for scheme, size in (("challenge", 600), ("random", 600), ("hard", 300), ("matched", 300)):
        for slice_rows in (1_000_000, 7):
            out = negatives.swap_negatives(train, scheme, exclude_binders=scheme != "challenge", slice_rows=slice_rows)
            made = values(out.filter("label = 0"), "grp", "draw", "Peptide", "CDR3b")
            assert len(made) == size, scheme
            for _, _, peptide, cdr3 in made:
                gap = edit_distance(peptide, home[cdr3])
                assert gap > 0 and (gap <= 3 if scheme == "hard" else gap > 3 or scheme == "random")
            first = made if slice_rows == 1_000_000 else first
            assert made == first


def test_equal_positives_each_get_negatives(spark):
    columns = ["Peptide", "HLA", "Va", "Ja", "CDR1a", "CDR2a", "CDR3a", "Vb", "Jb", "CDR1b", "CDR2b", "CDR3b"]
    rows = [("AAAAAAAA", "H", "v", "j", None, "b", "c", "v", "j", "a", "b", "AA1")] * 4
    rows += [("DDDDDDDD", "H", "v", "j", "a", "b", "c", "v", "j", "a", "b", f"DD{i}") for i in range(30)]
    train = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    for exclude in (False, True):
        made = negatives.swap_negatives(train, "challenge", exclude_binders=exclude).collect()
        drawn = {}
        for r in made:
            if r["label"] == 0 and r["Peptide"] == "AAAAAAAA":
                drawn.setdefault(r["grp"], []).append(r["CDR3b"])
        assert len(drawn) == 4 and all(len(d) == 5 for d in drawn.values())
        assert len({tuple(sorted(d)) for d in drawn.values()}) > 1
        assert sum(r["label"] for r in made) == 34


def shared_loops(spark):
    """Receptors of which many CDR3b are recorded with several peptides."""
    columns = ["Peptide", "HLA", "Va", "Ja", "CDR1a", "CDR2a", "CDR3a", "Vb", "Jb", "CDR1b", "CDR2b", "CDR3b"]
    peptides = ["AAAAAAAA", "AAAAAAAC", "CCCCCCCC", "DDDDDDDD", "DDDDDDDE"]
    rows = [
        (p, "H", "v", "j", "a", "b", f"c{i}", "v", "j", "a", "b", f"AS{i % (7 + 3 * k)}" if i % 9 else None)
        for k, p in enumerate(peptides)
        for i in range(40)
    ]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def test_segments_are_never_broadcast(spark):
    values_ = spark.createDataFrame([(0, "CASSAAAYEQYF"), (0, "CASSAAYEQYF")], "g int, x string")
    close = neighbours._close(values_, values_.withColumnRenamed("x", "y"), 2)
    assert "Broadcast" not in close._jdf.queryExecution().executedPlan().toString()
    found = neighbours.nearest_binder(
        values_.withColumnRenamed("g", "p"), values_.limit(1).withColumnRenamed("g", "p"), "p", "x"
    )
    assert sorted(r["sim"] for r in found.collect()) == [pytest.approx(11 / 12), 1.0]


def test_counted_records_are_parsed_once_and_count_for_all(spark):
    rows = [("CASSAAYEQYF", "TRBV19*01", "TRBJ2-7", "E", "HomoSapiens")] * 3
    rows += [("CASSGGGYEQYF", "TRBV19", "TRBJ2-7", "E", "HomoSapiens"), ("CASSAYEQYF", "TRBV19", "", "E", "HomoSapiens")] * 2
    rows += [("CASSAAYEQYF", "TRBV19", "TRBJ2-7", "F", "MusMusculus"), ("CASSWWYEQYF", "none", "TRBJ2-7", "F", "HomoSapiens")]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in handmade.FIELDS))
    counted = handmade.hand_parsed(cleaning.annotated_records(handmade.counted_records(raw)))
    plain = handmade.hand_parsed(cleaning.annotated_records(raw))
    assert (counted.count(), plain.count()) == (3, 6)
    for table in (handmade.summary, handmade.top_regions, handmade.region_bigrams, handmade.top_bigrams, handmade.region_lengths):
        assert sorted(table(counted).collect()) == sorted(table(plain).collect())
        assert table(counted).dtypes == table(plain).dtypes


@pytest.mark.parametrize("listed", [64, 2, 0])
def test_excluded_draws_are_the_first_that_pass(spark, monkeypatch, listed):
    train = shared_loops(spark)
    monkeypatch.setattr(negatives, "LISTED", listed)
    known = {(r["CDR3b"], r["Peptide"]) for r in train.collect()}
    got = negatives.swap_negatives(train, "random", per_positive=3, exclude_binders=True).filter("label = 0")
    # The same nine draws without exclusion, cut here row by row.
    every = negatives.swap_negatives(train, "random", per_positive=9).filter("label = 0").collect()
    want = {}
    for r in sorted(every, key=lambda r: (r["grp"], r["draw"])):
        mine = want.setdefault(r["grp"], [])
        if len(mine) < 3 and (r["CDR3b"] is None or (r["CDR3b"], r["Peptide"]) not in known):
            mine.append((r["draw"], r["Peptide"], r["CDR3a"], r["CDR3b"]))
    have = {}
    for r in got.orderBy("grp", "draw").collect():
        have.setdefault(r["grp"], []).append((r["draw"], r["Peptide"], r["CDR3a"], r["CDR3b"]))
    assert have == {g: rows for g, rows in want.items() if rows}
    assert max(draw for rows in have.values() for draw, *_ in rows) > 6


def test_only_missing_draws_are_made_again(spark, monkeypatch):
    train, rows = shared_loops(spark), []

    def counted(df):
        out = real(df)
        rows.append(out.count() if "known" in out.columns else 0)
        return out

    real = negatives.stage
    monkeypatch.setattr(negatives, "stage", counted)
    negatives.swap_negatives(train, "random", exclude_binders=True)
    first, second, third = [n for n in rows if n]
    assert first == 5 * 200 and second < first and first + second + third < 15 * 200


def test_validation_split_shuffles_no_pairs(spark):
    pairs = spark.range(3000).select(F.expr("md5(cast(id % 500 as string))").alias("grp"), "id")
    split = splits.validation_split(pairs, "grp")
    assert "Join" not in split._jdf.queryExecution().executedPlan().toString()
    sides = values(split.groupBy("grp").agg(F.count_distinct("in_validation").alias("n"), F.max("in_validation").alias("v")), "n", "v")
    assert [n for n, _ in sides] == [1] * 500 and sum(v for _, v in sides) == 100
    ranked = ranking.hash_rank(pairs.select("grp").distinct(), [], ["grp"], splits.SEED, "validation")
    held = {r["grp"] for r in split.filter("in_validation").collect()}
    assert held == {r["grp"] for r in ranked.filter("rank <= 100").collect()}
    assert splits.validation_split(pairs.limit(0), "grp").count() == 0


def test_splits(spark):
    rows = [(f"C{i}", "V", "J", "big" if i < 90 else "small", [f"s{i % 10}"]) for i in range(100)]
    df = spark.createDataFrame(rows, "cdr3 string, v string, j string, epitope string, studies array<string>")
    held = splits.study_holdout(df).collect()
    assert len({r["studies"][0] for r in held if r["held_out"]}) == 2
    assert not {r["studies"][0] for r in held if r["held_out"]} & {r["studies"][0] for r in held if not r["held_out"]}
    sizes = splits.split_within(df, "epitope").filter("in_train").groupBy("epitope").count()
    assert values(sizes, "epitope", "count") == [("big", 72), ("small", 8)]
    assert values(splits.capped(df, "epitope", cap=20).groupBy("epitope").count(), "epitope", "count") == [("big", 20), ("small", 10)]
    faked = splits.permuted_labels(df.withColumn("v", F.col("cdr3")), ["cdr3"], ["v"]).collect()
    assert sorted(r["fake_v"] for r in faked) == sorted(r["cdr3"] for r in faked)
    assert [r["n"] for r in splits.top_groups(df, "epitope", floor=50).collect()] == [90]


def test_curve_fit_reproduces_published_values(spark):
    # Published training sizes and differences, to seven digits.
    rows = [
        (6786, 0.0079970),
        (13572, 0.0207040),
        (23754, 0.0229864),
        (33936, 0.0282592),
        (50904, 0.0318241),
        (67872, 0.0375396),
    ]
    curve = spark.createDataFrame(rows, "pairs long, delta double")
    got = resampling.fit_curve(curve, "pairs", "delta").withColumn("shape", resampling.curve_shape()).first()
    assert got["slope"] == pytest.approx(0.0118, abs=5e-5) and got["r"] == pytest.approx(0.985, abs=5e-4)
    assert got["upper_slope"] == pytest.approx(0.0131, abs=5e-5) and got["shape"] == "trend"


def test_bootstrap_mean(spark):
    df = spark.createDataFrame([(f"p{i}", 0.1 + i / 100) for i in range(20)] + [("z", -1.0)], "k string, delta double")
    got = resampling.bootstrap_mean(df.filter("k <> 'z'"), "delta", ["k"], resamples=400).first()
    assert (got["n"], got["wins"], got["verdict"]) == (20, 20, "better")
    assert 0.15 < got["lo"] < got["delta"] < got["hi"] < 0.25
    assert resampling.bootstrap_mean(df.limit(2), "delta", ["k"], resamples=10).count() == 0


def test_export_and_text_checks(spark):
    rows = [("AAAAAA", "B", "C", "D", "E", "F", "GILGFVFTL", 1), ("A" * 9, "B", "C", "D", "E", "F", "GIL", 1),
            (None, "B", "C", "D", "E", "F", "GIL", 0)]
    df = spark.createDataFrame(rows, "CDR1a string, CDR2a string, CDR3a string, CDR1b string, CDR2b string, CDR3b string, Peptide string, y int")
    assert values(reports.loop_export(df, "y"), "A1", "peptide", "binder", "partition") == [("AAAAAA", "GILGFVFTL", 1, 0)]
    text = spark.createDataFrame([(1, "x\n- short\n- " + "y" * 90 + "\nend **bold** [1, 2] text")], "id int, text string")
    assert values(reports.bullet_lengths(text, "id", "text"), "bullet", "chars", "too_long") == [(1, 5, False), (2, 90, True)]
    assert reports.plain_words(text, "id", "text").first()["words"] == 8


def test_scheme_verdict(spark):
    rows = [(s, a, base + d, base + d, 0.5) for s, d in (("challenge", 0.03), ("random", 0.03), ("hard", 0.01), ("matched", 0.01))
            for a, base in (("morpheme", 0.5 + d), ("kmer3", 0.5), ("vjonly", 0.5))]
    df = spark.createDataFrame(rows, "scheme string, arm string, all double, seen double, unseen double")
    got = reports.scheme_verdict(df).first()
    assert (got["beats_kmers"], got["beats_segments"], got["unseen_near_chance"], got["similarity_matters"]) == (True, False, True, False)


def test_nearest_loops_asks_only_contexts_that_can_win(spark, monkeypatch):
    rng = random.Random(23)
    short, letters = ["ACDEF", "GHIKL", "MNPQR", "STVWY"], "ACDEFGHIKLMNPQRSTVWY"

    def some(n):
        return [
            ("p", rng.choice(short), rng.choice(short), rng.choice(["CAS", "CAT", ""]), "".join(rng.choices(letters, k=8)))
            for _ in range(n)
        ]

    refs = some(300)
    # Each query is one edit from a binder of its own context.
    queries = sorted({(g, a, b, c, d[:-1] + "B") for g, a, b, c, d in refs[:40]} | {("p", "ACDEF", "X", "", "")})
    names, schema = ["a", "b", "t", "u"], "g string, a string, b string, t string, u string"
    weights = [1, 1, 3, 3]
    asked = []

    def counted(found, pairs, short):
        rows = opened(found, pairs, short)
        asked.append((rows.count(), found.join(pairs, ["g", *short]).count()))
        return rows

    opened = neighbours._open_contexts
    monkeypatch.setattr(neighbours, "_open_contexts", counted)
    got = neighbours.nearest_loops(
        spark.createDataFrame(queries, schema), spark.createDataFrame(refs, schema), "g", names, weights
    ).collect()

    def sim(a, b):
        return 0.0 if not a or not b else 1 - edit_distance(a, b) / max(len(a), len(b))

    assert len(got) == len(queries)
    for row in got:
        every = (sum(w * sim(row[n], x[i + 1]) for i, (n, w) in enumerate(zip(names, weights))) / 8 for x in refs)
        assert row["sim"] == pytest.approx(max(every))
    ((met, all_of_them),) = asked
    assert met * 4 < all_of_them


def test_nearest_loops_broadcasts_no_table_of_its_rows(spark, monkeypatch):
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    real = neighbours.stage
    monkeypatch.setattr(neighbours, "stage", planned)
    monkeypatch.setattr(neighbours, "SMALL_ROWS", -1)
    rows = [("p", "AC", f"CAS{a}{b}F") for a in "ACDEFG" for b in "ACDEFG"]
    schema = "g string, a string, t string"
    q, r = spark.createDataFrame(rows[::2] + [("p", "AC", "CASWWF")], schema), spark.createDataFrame(rows[1:], schema)
    found = neighbours.nearest_loops(q, r, "g", ["a", "t"], [1, 3])
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
    assert len(found.collect()) == 19


def test_draws_by_parts_are_the_same_and_known_ones_go(spark, monkeypatch):
    train = shared_loops(spark)
    kept, staged, gone = ["Peptide", "HLA", "CDR3b"], [], []
    plain = negatives.swap_negatives(train, "random", exclude_binders=True).select("grp", "draw", "label", *kept)
    want = sorted(tuple(map(str, r)) for r in plain.collect())

    def written(df):
        staged.append(real(df))
        return staged[-1]

    real, remove = negatives.stage, negatives.discard
    monkeypatch.setattr(negatives, "stage", written)
    monkeypatch.setattr(negatives, "discard", lambda df: (gone.append(df.filter("known").count()), remove(df)))
    monkeypatch.setattr(negatives, "PART_ROWS", 70)
    # Some CDR3b have a list then, some a mask, and some are met by a join.
    monkeypatch.setattr(negatives, "LISTED", 1)
    monkeypatch.setattr(negatives, "MASK_BITS", 3)
    made = negatives.swap_negatives(train, "random", exclude_binders=True, kept=kept)
    assert made.columns == ["grp", "draw", "label", *kept]
    assert sorted(tuple(map(str, r)) for r in made.collect()) == want
    # Three parts a round; what the first two rounds found to be known is off the disk, and no other columns were written.
    assert len(gone) == 6 and sum(gone) > 0
    assert not any({"Va", "CDR1a"} & set(x.columns) for x in staged)


def test_marks_of_positives_go_with_their_negatives(spark):
    train = shared_loops(spark)
    side = lambda rows: rows.withColumn("first", F.col("grp") < "8")
    made = negatives.swap_negatives(train, "challenge", kept=["Peptide", "CDR3b"], mark=side)
    assert made.columns == ["grp", "draw", "label", "first", "Peptide", "CDR3b"]
    rows_ = made.collect()
    assert all(r["first"] == (r["grp"] < "8") for r in rows_) and {r["first"] for r in rows_} == {True, False}
    assert sum(r["label"] == 0 for r in rows_) > 200
    # Where nothing asks for the digests they aren't shuffled.
    plan = made.select("first", "Peptide", "CDR3b")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "_id" in x]


def test_stage_removes_its_shuffle_files_and_discard_the_table(spark, monkeypatch):
    from junctura import session

    set_to = []
    table = spark.range(1000).repartition(3, "id")
    put = type(spark.conf).set
    monkeypatch.setattr(type(spark.conf), "set", lambda self, k, v: (set_to.append((k, v)), put(self, k, v))[1])
    written = session.stage(table)
    assert set_to == [(session.CLEANED, "true"), (session.CLEANED, "false")] and written.count() == 1000
    folder = written.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    session.discard(written)
    session.discard(table)
    assert not os.path.exists(folder)


def test_exports_are_written_compressed(spark, tmp_path):
    from junctura.sources import records, sinks

    table = spark.createDataFrame([("CASSF", 1)] * 5, "A1 string, binder int")
    sinks.write_export({"train": table}, str(tmp_path))
    assert list((tmp_path / "train").glob("*.csv.gz")) and not list((tmp_path / "train").glob("*.csv"))
    assert [tuple(r) for r in records.read_named(spark, f"{tmp_path}/train", ["A1", "binder"]).collect()] == [("CASSF", "1")] * 5
