"""Operators on documents against brute force, with nulls, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from junctura.llm import mixing, packing
from junctura.llm.components import components
from junctura.llm.exact_dedup import drop_copies, exact_groups
from junctura.llm.langid import cluster, fit, grams, identify
from junctura.llm.mixing import fit_counts, mix, mixed_documents, word_count
from junctura.llm.packing import Encoder, Packer, pack, padding
from junctura.llm.quality import STOP_WORDS, judge, keep_good
from junctura.llm.shared import stage
from junctura.llm.simhash import (
    covering_masks,
    drop_near_copies,
    fingerprint,
    near_groups,
    near_links,
)
from junctura.llm.token_count import Automaton, byte_level_pieces, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside.
CLASHING = ["key", "doc", "digest", "content", "check", "words", "body", "length", "n", "fp", "root", "t", "salt", "m"]
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def awkward(spark):
    """Nulls, empty, long, equal and repeated texts."""
    long = " ".join(f"word{i % 977} and" for i in range(30_000))
    rows = [
        (1, "a  b\tc", "en", "s1", 1),
        (2, "a b c", "en", "s2", 1),
        (3, None, None, None, None),
        (4, "", "en", "s1", 0),
        (5, " \n\t ", "de", "s1", 0),
        (6, long, "en", None, 5),
        (7, long, "en", "s2", 5),
        (None, "a b c", "fr", "s1", 3),
        (8, "ünï çode — 日本語 \U0001f600", None, "s3", 3),
        (8, "ünï çode — 日本語 \U0001f600", None, "s3", 3),
        (9, "a b C", "en", "s3", 3),
    ]
    return clashing(frame(spark, rows)), rows


OPERATORS = {
    "exact_groups": exact_groups,
    "near_groups": near_groups,
    "mix": mix,
    "judge": lambda d: judge(d).select("doc.doc_id", "kept", "failed"),
    "pack": lambda d: pack(d, BPE),
    "token_counts": lambda d: token_counts(d, BPE),
    "drop_copies": drop_copies,
    "drop_near_copies": drop_near_copies,
    "keep_good": keep_good,
    "mixed_documents": mixed_documents,
    "identify": lambda d: identify(d, fit(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](clashing(frame(spark, []))).count() == 0


@pytest.mark.parametrize("name", ["drop_copies", "drop_near_copies", "keep_good", "mixed_documents"])
def test_row_keeping_forms_return_the_columns_as_they_are(spark, name):
    docs, _ = awkward(spark)
    assert OPERATORS[name](docs).columns == docs.columns


@pytest.mark.parametrize("name", ["exact_groups", "near_groups", "mix", "judge", "token_counts", "identify"])
def test_one_row_per_row(spark, name):
    docs, rows = awkward(spark)
    got = OPERATORS[name](docs).select("doc_id").collect()
    assert Counter(r[0] for r in got) == Counter(r[0] for r in rows)


def test_mix_and_fit_with_rows_that_share_a_key(spark):
    """Null and equal keys: a source gets its words, and a language its sample."""
    rows = [(None if i % 3 else 7, f"w{i} " * (1 + i % 9), "en", "ab"[i % 2], 0) for i in range(600)]
    docs = frame(spark, rows)
    wanted = {r.source: r.words for r in mix(docs).groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    counted = F.size(F.split(F.trim("text"), " +"))
    got = mixed_documents(docs).groupBy("source").agg(F.sum(counted).alias("words")).collect()
    assert {r.source: r.words for r in got} == wanted
    model = fit(docs.unionByName(docs), sample=50)
    assert set(model.langs) == {"en"}


# Exact copies


def test_exact_groups_match_brute_force(spark):
    docs, rows = awkward(spark)
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for row, text in zip(rows, normal, strict=True):
        groups[text].append(row[0])
    want = Counter()
    for row, text in zip(rows, normal, strict=True):
        keep = min((k for k in groups[text] if k is not None), default=None)
        want[row[0], keep, len(groups[text]), row[0] == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    for salts in (1, 3):
        assert Counter(map(tuple, exact_groups(docs.repartition(5), salts=salts).collect())) == want


def test_drop_copies_leaves_one_row_a_text(spark):
    docs, rows = awkward(spark)
    got = [(r.doc_id, r.text) for r in drop_copies(docs).collect()]
    texts = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in got)
    assert set(texts) == {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows}
    assert set(texts.values()) == {1}
    assert {k for k, _ in got} == {1, 3, 5, 6, 8, 9}


def test_equal_keys_with_other_texts_are_apart(spark):
    rows = [(1, "x", "en", "s", 1), (1, "y", "en", "s", 1), (0, "y", "en", "s", 1)]
    assert sorted((r.doc_id, r.text) for r in drop_copies(frame(spark, rows)).collect()) == [(0, "y"), (1, "x")]


def test_a_hot_text_sends_few_rows(spark):
    docs = spark.range(20_000, numPartitions=8).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string")).alias("text")
    )
    got = exact_groups(docs).groupBy("text_sha256", "keep_id", "group_size").count()
    hot = got.orderBy(F.desc("group_size")).first()
    assert (hot.keep_id, hot.group_size, hot["count"]) == (0, 6667, 6667)
    assert got.count() == 20_000 - 6667 + 1


# Near copies


def bits_apart(x, y):
    return (x ^ y).bit_count()


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


@pytest.mark.parametrize("text", [None, "", "  ", "one", "One TWO", "a b c", "a b c d a b c d É é", "x " * 500 + "\U0001f600"])
def test_fingerprint_matches_its_definition(text):
    assert fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for n in range(radius + 1):
        for bits in combinations(range(0, 64, 3 if radius == 3 else 1), n):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("radius", "bucket"), [(1, 2), (2, 2), (2, 32), (3, 32), (3, 2)])
def test_links_connect_what_pairs_connect(spark, radius, bucket):
    rng = random.Random(radius)
    values = {0, 2**64 - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            values.add(base)
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    values |= {hub ^ (1 << i) for i in range(40)}
    signed = sorted(v - 2**64 if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    links = near_links(fps, radius, bucket)
    got = {r.node: r.root for r in components(links).collect()}
    mask = 2**64 - 1
    want = plain_components(signed, lambda a, b: bits_apart(a & mask, b & mask) <= radius)
    assert {v: got.get(v, v) for v in signed} == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2001, 2000), (2000, 2002)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 2001: 2000, 2002: 2000}


def test_near_groups_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(15):
        words = rng.choices(vocabulary, k=rng.choice([2, 30, 900]))
        for _ in range(6):
            rows.append((doc, " ".join(words), "en", "s", 0))
            doc += 1
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rows += [(doc, None, "en", "s", 0), (doc + 1, " ", "en", "s", 0)]
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    want = plain_components(sorted(prints), lambda a, b: bits_apart(prints[a], prints[b]) <= 2)
    docs = frame(spark, rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_groups(docs).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}
    assert len(set(want.values())) < len(rows)
    kept = {r.doc_id for r in drop_near_copies(docs).collect()}
    assert kept == set(want.values())


# Quality


def plain_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(repeated),
    )


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "a b c", "a b c a b c", "x\n\nx\n x\ny\ny", "# * | a<b> &", "\U0001f600 é\tb"]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "b", "the", " ", " ", "\n", "#", "É", "\t"]) for _ in range(rng.randint(1, 400))))
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    rows = judge(docs).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for r in rows.collect():
        want = plain_quality(texts[r.doc_id])
        assert tuple(r)[1:6] == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_verdicts(spark):
    rng = random.Random(1)
    good = " ".join(rng.choice([*STOP_WORDS[:12], *[f"{a}{b}ing" for a in "bcdfg" for b in ("ar", "ol", "un", "ist")]]) for _ in range(120))
    cases = {
        "good": good,
        "symbols": re.sub(r"(\w+)", r"\1###", good),
        "capitals": good.upper(),
        "stop words": " ".join(f"zx{i}q" for i in range(90)),
        "duplicate lines": good.replace(" ", "\n") + "\n" + "same line here\n" * 200,
        "few words": "too short",
        "repeated passages": "one two three " * 40,
        "word length": " ".join(f"the{'z' * 30}{i} the" for i in range(60)).replace(" the ", " of") + " the of and to",
    }
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(cases.values())])
    got = {r.doc_id: r for r in judge(docs).select("doc.doc_id", "failed", "kept").collect()}
    for i, name in enumerate(cases):
        assert got[i].kept == (name == "good")
        assert name == "good" or name in got[i].failed, (name, got[i])
    # A filter on the verdict, as the row-keeping form has.
    assert [r.doc_id for r in keep_good(docs).collect()] == [0]


def test_quality_runs_without_python(spark):
    docs = frame(spark, [(1, "a b c", None, None, None)])
    plan = judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# Mixing


def test_knapsack_is_nearest(spark):
    rng = random.Random(2)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 6))))
        have = np.array([rng.randint(1, 4) for _ in lengths])
        budget = rng.randint(0, int((lengths * have).sum()))
        take = fit_counts(lengths, have, budget)
        assert (take >= 0).all() and (take <= have).all()
        sums = {0}
        for size, n in zip(lengths.tolist(), have.tolist(), strict=True):
            sums = {s + k * size for s in sums for k in range(n + 1)}
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_large_budgets_are_met_in_proportion():
    lengths, have = np.arange(1, 3000), np.full(2999, 50)
    total = int((lengths * have).sum())
    take = fit_counts(lengths, have, total // 3, room=1000)
    assert int((take * lengths).sum()) == total // 3
    assert abs(take[1000:].sum() / have[1000:].sum() - 1 / 3) < 0.02


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_names, rest = {}, list(names), float(sum(sizes.values()))
    while open_names:
        level = rest / sum(weight[s] for s in open_names)
        over = [s for s in open_names if level * weight[s] > most * sizes[s]]
        for s in over or open_names:
            target[s] = float(most * sizes[s]) if over else level * weight[s]
        if not over:
            break
        rest -= sum(target[s] for s in over)
        open_names = [s for s in open_names if s not in over]
    return target


def test_mix_meets_its_targets_whatever_the_slices(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        source = rng.choice(["a", "b", "b", "c", "é", "Z", None, "tiny"]) if i else "tiny"
        if source == "tiny" and i > 40:
            source = "b"
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 3, 3, 7, 90])), None, source, None))
    docs = frame(spark, rows)
    got = mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r["size"] == len((rows[r.doc_id][1] or "").split())
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1.5, source
    again = mix(docs.repartition(7), slice_rows=10)
    assert {r.doc_id: r.copies for r in again.collect()} == {r.doc_id: r.copies for r in got}
    copies = Counter(r.doc_id for r in mixed_documents(docs).collect())
    assert copies == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_words_are_counted_without_holding_them(spark):
    rng = random.Random(7)
    marks = [*" \t\n\x0b\x0c\r", *"a$\\é漢😀\0\x1c\x1f\x85\xa0\u2003\u3000\ufeff"]
    texts = [None, "", " ", "\r\n", " a", "a ", "$1", "\\1 \\$"]
    texts += ["".join(rng.choices(marks, k=rng.randrange(30))) for _ in range(2000)]
    docs = frame(spark, [(i, text, None, None, None) for i, text in enumerate(texts)])
    counted = docs.select("doc_id", word_count().alias("n"))
    assert "regexp_extract_all" not in counted._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.n for r in counted.collect()} == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}


def test_counts_by_length_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(mixing, "stage", lambda df, name: written.append(name) or stage(df, name))
    docs = frame(spark, [(i, "w " * (i % 5), None, "ab"[i % 2], None) for i in range(40)])
    assert mix(docs).count() == 40
    assert sorted(written) == ["lengths", "plan", "targets"]


def test_mixed_documents_agree_with_the_mix_in_any_order(spark):
    rows = [(i, "w " * (i % 3 + 1), None, "ab"[i % 7 > 4], None) for i in range(400)]
    docs = frame(spark, rows)
    want = Counter({r.doc_id: r.copies for r in mix(docs).collect() if r.copies})
    for parts in (1, 7):
        some = docs.repartition(parts, "text", "source")
        assert Counter(r.doc_id for r in mixed_documents(some).collect()) == want


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def encoder():
    with open(BPE, encoding="utf-8") as file:
        return Encoder(file.read())


def test_ids_are_those_of_the_tokenizer(tokenizer, encoder, monkeypatch):
    rng = random.Random(6)
    texts = ["", " ", "a<|endoftext|>b", "<|endoftext|>", "don't 12x  \n\n y \x1c z", "日本語 é́ \U0001f600"]
    parts = ["word", " ", "  ", "\n", "é", "12", ".", "'s", "日", "\t", "A B c d", "<|endoftext|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 300))) for _ in range(200)]
    for piece in (5, 1 << 16):
        monkeypatch.setattr(packing, "PIECE", piece)
        for text in texts:
            assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def plain_cost(places, costs, window):
    best = [0] + [None] * (len(places) - 1)
    for i in range(1, len(places)):
        best[i] = min(
            best[j] + padding(places[i] - places[j], window) + costs[i]
            for j in range(i)
            if places[i] - places[j] <= window
        )
    return best


def test_cuts_are_cheapest():
    rng = random.Random(7)
    for _ in range(200):
        places = np.cumsum([0] + [rng.randint(1, 16) for _ in range(rng.randint(1, 60))])
        costs = np.array([rng.choice([0, 1, 4, 9]) for _ in places])
        cuts = packing.choose_cuts(places, costs, 16, last=True)
        by = dict(zip(places.tolist(), costs.tolist(), strict=True))
        chosen = places[cuts].tolist()
        cost = sum(padding(b - a, 16) + by[b] for a, b in zip(chosen, chosen[1:], strict=False))
        assert chosen[0] == 0 and chosen[-1] == places[-1]
        assert all(0 < b - a <= 16 for a, b in zip(chosen, chosen[1:], strict=False))
        assert cost == plain_cost(places.tolist(), costs.tolist(), 16)[-1]


def check_pieces(pieces, texts, tokenizer, window=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_sequence[p[5]].append(p)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for _, start, length, crc, total, _, _ in sorted(by_doc[doc], key=lambda p: p[1]):
            assert start == at and total == len(ids) and length > 0
            assert crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    wasted = used = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= window
        wasted, used = wasted + padding(at, window), used + at
    return wasted / used


def test_packing_is_whole_and_tight(spark, tokenizer):
    docs, rows = awkward(spark)
    rng = random.Random(8)
    more = [
        (100 + i, ". ".join(" ".join(rng.choices(["alpha", "beta,", "gamma", "x"], k=9)) for _ in range(rng.randint(1, 90))), "en", "s", 0)
        for i in range(150)
    ]
    texts = {r[0]: r[1] for r in more}
    pieces = [tuple(r) for r in pack(frame(spark, more).repartition(3), BPE).collect()]
    assert check_pieces(pieces, texts, tokenizer) < 0.03
    small = [tuple(r) for r in pack(docs.filter("doc_id <> 8"), BPE, block=4096).collect()]
    check_pieces(small, {r[0]: r[1] for r in rows if r[0] not in (8, None)}, tokenizer)


def test_a_text_without_boundaries_is_cut(encoder, tokenizer):
    packer = Packer(encoder, block=3000)
    text = "ab" * 20_000
    pieces = [*packer.add(1, text), *packer.finish()]
    check_pieces(pieces, {1: text}, tokenizer)


# Language


def sentences(rng, lang, n):
    stems = {"en": ["the", "ing", "tion", "with", "er"], "de": ["der", "ung", "sch", "über", "zu"], "fr": ["eau", "ment", "é", "que", "les"]}
    return " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rng = random.Random(9)
    rows = [(i, sentences(rng, lang, rng.randint(5, 60)), lang, "s", 0) for i, lang in enumerate(rng.choices(["en", "de", "fr"], k=600))]
    docs = frame(spark, rows)
    model = fit(docs.filter("doc_id % 5 <> 0"), sample=50)
    assert set(model.langs) == {"en", "de", "fr"} and len(model.langs) > 3
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    held_out = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[r[0]].lang_pred == r[2] for r in held_out) / len(held_out) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_letters_is_undetermined(spark):
    docs, _ = awkward(spark)
    model = fit(docs)
    odd = frame(spark, [(1, None, None, None, None), (2, "12 34 !?", None, None, None), (3, "", None, None, None), (4, "Ж", None, None, None)])
    got = {r.doc_id: r for r in identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0
    assert got[4].lang_pred in model.langs and got[4].rejected


def test_grams_do_not_depend_on_chunks(monkeypatch):
    text = "Abc, déf! xyz  q " * 40
    whole = grams(text)
    monkeypatch.setattr("junctura.llm.langid.CHUNK", 7)
    parts = grams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_clusters_of_equal_vectors():
    centres, reach = cluster(np.array([[1.0, 0.0]] * 4), 3)
    assert centres.shape == (1, 2) and reach.tolist() == [1.0]


# Token counts


def greedy(word, first, later):
    at = n = 0
    while at < len(word):
        pieces = later if at else first
        stop = next((j for j in range(len(word), at, -1) if word[at:j] in pieces), None)
        if stop is None:
            return None
        at, n = stop, n + 1
    return n


def test_automaton_is_greedy():
    rng = random.Random(10)
    for _ in range(1500):
        first, later = ({bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 7))} for _ in range(2))
        automaton = Automaton.build(sorted(first), sorted(later))
        for _ in range(10):
            word = bytes(rng.choices(b"abc", k=rng.randint(0, 12)))
            assert automaton.length(word) == greedy(word, first, later)


def test_token_counts_match_brute_force(spark):
    with open(BPE, encoding="utf-8") as file:
        first, later = map(set, byte_level_pieces(file.read()))
    docs, rows = awkward(spark)
    want = Counter()
    known = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        words = raw.split()
        for w in words:
            if w not in known:
                known[w] = greedy(b" " + w, first, later)
        want[doc, len(raw), len(words), sum(known[w] for w in words), 0] += 1
    assert Counter(map(tuple, token_counts(docs, BPE).collect())) == want
