"""Whitening, conversation repair and best-fit packing against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from junctura.llm.best_fit import WordEncoder, best_fit_decreasing, pack_best_fit
from junctura.llm.turns import FINAL_CLASS, Table, audit_turns, damage_turns, repair_turns, sweep, vector_of
from junctura.llm.whitening import leading_components, whiten

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


# Whitening


@pytest.mark.parametrize("d", [1, 2, 3, 5, 40])
def test_leading_components(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    spectra = [[5.0] * d, [5.0, 5, 5] + [1.0] * d, [1, 1 - 1e-10, 1 - 1e-5] + [0.5] * d, [1e8] + [1e-3] * d, [0.0] * d]
    spectra += [rng.random(d) for _ in range(5)]
    matrices = [(q * np.array(s[:d])) @ q.T for s in spectra] + [np.diag(np.arange(d) + 1.0), np.ones((d, d))]
    for matrix in matrices:
        matrix = (matrix + matrix.T) / 2
        k = min(4, d)
        values, vectors = leading_components(matrix, k)
        size = max(np.abs(matrix).max(), 1e-300)
        np.testing.assert_allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], atol=1e-13 * size * d)
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12
        assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-12 * size * d


def plain_whitening(rows):
    """{row number: (deviation, whitened up to sign)} and shares, by numpy on all rows at once."""
    kept = {
        i: [int(np.floor(256 * float(c))) for c in v]
        for i, v in enumerate(rows)
        if v is not None and all(c is not None and np.isfinite(c) for c in v)
    }
    fit = np.array(sorted(set(map(tuple, kept.values()))), float)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    sums = [int(s) for s in fit.sum(axis=0)]
    out = {}
    for i, x in kept.items():
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, sums, strict=True))
        turned = (np.array(x) - mean) @ vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
        out[i] = deviation, turned
    return out, values[::-1][:4] / values.sum(), n


def test_whiten_given_table_and_awkward_rows(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in given]
    width = len(rows[0][1])
    bad = [None, [None] * width, [float("nan")] + [0.0] * (width - 1), [float("inf")] * width]
    rows += [(None, rows[0][1]), (rows[1][0], rows[1][1]), *((10_000 + i, v) for i, v in enumerate(bad))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    table = table.withColumns({"component": F.lit("x"), "n": F.lit(1), "key": F.lit(None)})
    found = whiten(table).collect()
    expected, shares, n = plain_whitening([v for _, v in rows])
    by_key = {}
    for i, (deviation, turned) in expected.items():
        by_key.setdefault(rows[i][0], []).append((deviation, turned))
    assert len(found) == 4 * len(expected) and {r.n for r in found} == {n}
    sign = {}
    for r in found:
        deviation, turned = by_key[r.vec_id][0]
        assert r.deviation == deviation
        sign.setdefault(r.component, np.sign(r.whitened * turned[r.component - 1]))
        assert abs(r.whitened * sign[r.component] - turned[r.component - 1]) < 1e-9
        assert abs(r.explained - shares[r.component - 1]) < 1e-10 and r.identity_error < 1e-9


def test_whiten_small_tables(spark):
    kind = "vec_id bigint, embedding array<double>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [])], kind)
    # The empty vector counts as zeros, so there are two distinct vectors and one component.
    found = whiten(one).collect()
    assert {(r.vec_id, r.component) for r in found} == {(1, 1), (2, 1), (4, 1)}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in found)
    assert whiten(one.filter("vec_id < 3")).count() == 0
    large = spark.createDataFrame([(1, [2.0**40, 0.0]), (2, [0.0, 1.0]), (3, [-(2.0**40), 7.0])], kind)
    assert {r.vec_id: r.deviation for r in whiten(large).collect() if r.component == 1} == {
        1: None,
        2: (0 * 3) ** 2 + (3 * 256 - 8 * 256) ** 2,
        3: None,
    }


# Conversation repair


def plain_faults(rows):
    """The fault of each (role, text): blank, duplicate, truncated or none."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, repaired rows) by trying every sequence of edits with up to two insertions in a gap."""
    faults, best = plain_faults(rows), None
    for choice in itertools.product("DKRr", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and c != "D" for f, c in zip(faults, choice, strict=True)):
            continue
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            cost, audit, made = 0, "", []
            for i, gap in enumerate(gaps):
                for initial in gap:
                    cost, audit = cost + 2, audit + "I"
                    made.append(({"u": "user", "a": "assistant"}[initial], ""))
                if i == len(rows):
                    continue
                cost += {"D": 3, "K": 0, "R": 2, "r": 2}[choice[i]]
                cost += choice[i] != "D" and faults[i] == "truncated"
                audit += choice[i].upper()
                if choice[i] != "D":
                    role = {"K": rows[i][0], "R": "user", "r": "assistant"}[choice[i]]
                    made.append((role, rows[i][1]))
            initials = "".join(r[:1] or "-" for r, _ in made)
            body = initials[1:] if initials[:1] == "s" else initials
            legal = not initials or (body and body == "ua" * (len(body) // 2))
            if legal and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, made
    return best


def digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_repair_matches_every_edit_tried(spark):
    rng = random.Random(3)
    talks = {}
    for conv in range(60):
        roles = ["system", "user", "assistant", "tool", ""]
        texts = ["a.", "b", "", " ", "c!", "d\n", "e? "]
        talks[conv] = [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(0, 4))]
    rows = [(c, t, *row) for c, talk in talks.items() for t, row in enumerate(talk)]
    table = spark.createDataFrame(rows, TURNS)
    everyone = spark.createDataFrame([(c,) for c in talks], "conv_id bigint")
    for size in (1, 2, 4096):
        found = {r.conv_id: r for r in audit_turns(table, everyone, size=size).collect()}
        assert set(found) == set(talks)
        for conv, talk in talks.items():
            cost, audit, made = plain_repair(talk)
            r = found[conv]
            assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, digest(made)), talk
            faults = plain_faults(talk)
            assert [r.blank, r.duplicate, r.truncated] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
            initials = [role[:1] for role, _ in talk]
            pairs = zip(initials, initials[1:], strict=False)
            assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in pairs)


def plain_long_repair(rows):
    """(cost, audit) by a forward search that keeps the best path of each state."""
    faults = plain_faults(rows)
    lead = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    far = (10**9, "")

    def put(best, state, path):
        best[state] = min(best[state], path)

    def inserted(best):
        for _ in range(2):
            for state in range(4):
                cost, audit = best[state]
                put(best, 3 if state == 2 else 2, (cost + 2, audit + "I"))
        return best

    best = [(0, ""), far, far, far]
    for (role, _), fault in zip(rows, faults, strict=True):
        then = [far] * 4
        for state, (cost, audit) in enumerate(inserted(best)):
            put(then, state, (cost + 3, audit + "D"))
            if fault in ("", "truncated"):
                late = fault == "truncated"
                put(then, 3 if state == 2 else 2, (cost + 2 + late, audit + "R"))
                if (role[:1], state) in lead:
                    put(then, lead[role[:1], state], (cost + late, audit + "K"))
        best = then
    best = inserted(best)
    return min(best[0], best[3])


@pytest.mark.parametrize("kind", ["mixed", "users", "doomed"])
def test_long_conversations_in_chunks(spark, kind):
    """Chunks whose vectors converge, alternate for ever, or never change."""
    rng = random.Random(7)
    roles = {"mixed": ["user", "assistant", "system", "x"], "users": ["user"], "doomed": ["user", "assistant"]}[kind]
    text = (lambda i: "") if kind == "doomed" else (lambda i: f"{i}" + rng.choice([".", ""]))
    talks = {c: [(rng.choice(roles), text(i)) for i in range(n)] for c, n in enumerate([301, 300, 7, 1, 64])}
    rows = [(c, t, *row) for c, talk in talks.items() for t, row in enumerate(talk)]
    table = spark.createDataFrame(rows, TURNS).repartition(7)
    everyone = table.select("conv_id").distinct()
    for size in (7, 64):
        found = {r.conv_id: r for r in audit_turns(table, everyone, size=size).collect()}
        for conv, talk in talks.items():
            assert (found[conv].cost, found[conv].audit) == plain_long_repair(talk)


def test_passes_agree_up_to_a_constant():
    """A fix-up sweep that stops where the classes meet finds what a whole sweep finds."""
    rng = random.Random(5)
    table = Table()
    for _ in range(200):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randrange(1, 40)))
        known, _ = sweep(table, symbols, FINAL_CLASS)
        other = table.before(rng.randrange(8), FINAL_CLASS)
        whole, left = sweep(table, symbols, other)
        quick, quick_left = sweep(table, symbols, other, known)
        assert (whole == quick).all() and left == quick_left
        assert max(vector_of(left)) <= 4


def test_repair_awkward_rows(spark):
    rows = [
        (None, None, "user", "a."), (None, 0, None, None), (None, 0, "assistant", "b."), (None, 5, "assistant", "b."),
        (1, 1, "user", "q?"), (1, 1, "user", "q?"), (1, 1, "assistant", "x"), (2, None, None, None),
    ]
    table = spark.createDataFrame(rows, TURNS)
    table = table.withColumns({c: F.lit("z") for c in ("conv", "digest", "own", "chunk", "had", "text2")})
    everyone = spark.createDataFrame([(None,), (1,), (2,), (3,)], "conv_id bigint")
    found = {r.conv_id: r for r in audit_turns(table, everyone).collect()}
    # Rows of a turn go by role: the space, which stands for a null, comes first.
    r = found[None]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (4, 1, 1, 0, 3)
    assert (r.cost, r.audit) == (6, "KDKD") and r.repaired_sha256 == digest([("user", "a."), ("assistant", "b.")])
    r = found[1]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (0, 0, 1, 1, 1)
    assert (r.cost, r.audit) == plain_long_repair([("assistant", "x"), ("user", "q?"), ("user", "q?")])
    assert (found[2].gaps, found[2].blank, found[2].audit) == (0, 1, "D")
    assert (found[3].cost, found[3].audit, found[3].repaired_sha256) == (0, "", digest([]))
    edited, faults = repair_turns(spark.createDataFrame([], TURNS))
    assert edited.count() == 0 and faults.count() == 0
    edited, _ = repair_turns(spark.createDataFrame([(1, 1, "system", "s." * 200_000), (1, 2, "user", "u.")], TURNS))
    kept = [(r.edit, r.role, len(r.text)) for r in edited.orderBy("chunk", "place").collect()]
    assert kept == [("K", "system", 400_000), ("K", "user", 2), ("I", "assistant", 0)]


def test_damage(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    expected = []
    for r in table.collect():
        harm = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = "user" if harm == 4 else r.role, r.text
        if harm:
            text = "" if harm == 1 else text.translate({ord(c): None for c in ".!?"}) if harm == 2 else text
            expected += [(r.conv_id, r.turn, role, text)] * (2 if harm == 3 else 1)
    assert sorted(map(tuple, damage_turns(table).collect())) == sorted(expected)
    odd = spark.createDataFrame([(None, None, None, None)] * 2, TURNS)
    harm = zlib.crc32(b" : ") % 20
    assert harm > 4 and list(map(tuple, damage_turns(odd).collect())) == [(None, None, " ", " ")] * 2


# Best-fit packing


def plain_best_fit(items, room):
    bins = []
    for length in sorted(items, reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= length]
        if fits:
            bins[min(fits)[1]] -= length
        else:
            bins.append(room - length)
    return sorted(bins)


def test_best_fit_like_piece_by_piece():
    rng = random.Random(11)
    for _ in range(300):
        room = rng.choice([10, 37, 100])
        items = [rng.randrange(1, rng.choice([5, room + 1])) for _ in range(rng.randrange(0, 250))]
        counts = {x: items.count(x) for x in items}
        runs, used, met = best_fit_decreasing(counts, room), {}, 0
        for i, (length, first, each, sequence, offset) in enumerate(runs):
            more = i + 1 < len(runs) and runs[i + 1][0] == length
            for j in range((runs[i + 1][1] if more else counts[length]) - first):
                at = sequence + j // each
                assert used.get(at, 0) == offset + j % each * length
                used[at] = used.get(at, 0) + length
                met += 1
        assert met == len(items) and sorted(used) == list(range(len(used)))
        assert sorted(room - u for u in used.values()) == plain_best_fit(items, room)
    # As many runs for billions of pieces as for a few.
    assert len(best_fit_decreasing({x: 10**9 + x for x in range(1, 4097)})) < 4 * 4096


ODD_TEXTS = [
    "", "  ", "It's DON'T we'LL \x1c a\x1db ΑΣ Σ ², ½ Ⅷ", "<|endoftext|> and <|startoftext|>x", "İstanbul ß ẞ ſ K Å",
    "汉字 テスト 🙂", "a\xa0b c​d\x85e", "é ́x", "0x1F €5 – “q” … don'tre 'RE", "x" * 5000, "word " * 9000,
]


def test_word_ids_like_the_library():
    with open(WORDS, encoding="utf-8") as file:
        encoder = WordEncoder(file.read())
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(2)
    ranges = [(0, 0x180), (0, 0x530), (0x2000, 0x20C0), (0x20, 0x7F), (0x300, 0x370)]
    made = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    for text in [*ODD_TEXTS, *made]:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pack_best_fit(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in given] + [(None, None), (1, "again."), (1, "again.")]
    rows += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    table = table.withColumns({c: F.lit("z") for c in ("key", "part", "length", "nth")})
    found = pack_best_fit(table, WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    expected = []
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 4096):
            own = ids[start : start + 4096]
            expected.append((key, start // 4096, start, len(own), zlib.crc32(own.tobytes())))
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == order(expected)
    bins = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert sorted(4096 - b for b in bins.values()) == plain_best_fit([e[3] for e in expected], 4096)
    assert pack_best_fit(table.filter("false"), WORDS).count() == 0
