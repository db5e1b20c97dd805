"""Near copies of the pipeline's stage against brute force, and rows with null or repeated keys."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from junctura.llm import similar
from junctura.llm.similar import centre_of, drop_similar
from junctura.llm.simhash import drop_near_copies, fingerprint, near_groups

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA)


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """The smallest key of each component under a similarity of 0.8."""
    root = {k: k for k, _ in rows}
    sets = {k: plain_shingles(t) for k, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {find(k) for k in root}


def planted(rng, families=25, copies=4, words=120):
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(families):
        text = rng.choices(vocabulary, k=words)
        for _ in range(copies):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.choice([1, 2, 6])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    return rows


def test_stage_drops_planted_near_copies(spark):
    rows = planted(random.Random(1))
    rng = random.Random(2)
    base = rng.choices([f"h{i}" for i in range(500)], k=100)
    # A large group whose members are often farther from each other than from the first.
    for _ in range(150):
        text = list(base)
        for _ in range(rng.randint(1, 3)):
            text[rng.randrange(100)] = f"new{len(rows)}"
        rows.append((len(rows), " ".join(text)))
    want = plain_kept(rows)
    assert len(want) < 125
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows).repartition(5), "").collect()]
    assert sorted(got) == sorted(want)


def edited(rng, base, low, high, mark):
    """``base`` with a number of words from ``low`` to ``high`` changed."""
    text = list(base)
    for at in rng.sample(range(len(text)), rng.randint(low, high)):
        text[at] = f"{mark}{rng.randrange(10**6)}"
    return " ".join(text)


@pytest.mark.parametrize("pairwise", [1, similar.PAIRWISE, 10**6])
def test_groups_about_the_limit_match_brute_force(spark, monkeypatch, pairwise):
    """Members of these groups are similar to some of their group only; two groups share a passage."""
    rng = random.Random(4)
    passage = rng.choices([f"p{i}" for i in range(400)], k=60)
    one = rng.choices([f"g{i}" for i in range(500)], k=150)
    two = passage + rng.choices([f"g{i}" for i in range(500)], k=60)
    three = passage + rng.choices([f"g{i}" for i in range(500)], k=40)
    texts = [edited(rng, base, 1, high, "e") for base, high in [(one, 8), (two, 6), (three, 5)] for _ in range(90)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = plain_kept(rows)
    assert 10 < len(want) < 200
    monkeypatch.setattr(similar.similar_links, "__defaults__", (similar.SHINGLE, pairwise))
    assert sorted(r.doc_id for r in drop_similar(frame(spark, rows).repartition(4)).collect()) == sorted(want)


def test_a_hot_group_below_the_limit_gives_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = rng.choices([f"b{i}" for i in range(900)], k=300)
    rows = [(i, edited(rng, base, 9, 11, "e")) for i in range(400)]
    # A copy of the last one with one more word changed is the only pair to find.
    rows.append((len(rows), rows[-1][1].rsplit(" ", 1)[0] + " last"))
    made = {}
    stage = similar.stage

    def kept(df, name="stage"):
        out = stage(df, name)
        made.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(similar, "stage", kept)
    got = sorted(r.doc_id for r in drop_similar(frame(spark, rows)).collect())
    assert got == sorted(plain_kept(rows)) == list(range(400))
    compared = [x.count() for x in made["pairs"]]
    buckets = made["members"][0].groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert buckets > 50 and compared[1] < 400, (buckets, compared)


def test_centre_is_what_most_have():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [1, 2, 5], [1, 7, 8], [2, 9])]
    assert centre_of(sets).tolist() == [1, 2]
    assert centre_of(sets[:1]).tolist() == [1, 2, 3]


def test_short_and_empty_texts(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, "a c"), (4, None), (5, " "), (6, "a b c d e f")]
    assert sorted(r.doc_id for r in drop_similar(frame(spark, rows)).collect()) == [1, 3, 4, 6]
    assert drop_similar(frame(spark, [])).count() == 0


@pytest.mark.parametrize("drop", [drop_similar, drop_near_copies])
def test_null_and_repeated_keys_drop_their_own_rows_only(spark, drop):
    rng = random.Random(3)
    a, b, c, d = (" ".join(rng.choices([f"{p}{i}" for i in range(900)], k=300)) for p in "abcd")
    assert len({fingerprint(t) for t in (a, b, c, d)}) == 4
    # Null is in a component with key 1; key 5 is the smallest of one component and not of another.
    rows = [(1, a), (None, a.upper()), (None, d), (5, b), (6, b.upper()), (5, c), (4, c.upper())]
    got = Counter((r.doc_id, r.text) for r in drop(frame(spark, rows)).collect())
    assert got == Counter([(1, a), (None, d), (5, b), (4, c.upper())])


def test_stop_words_are_asked_of_known_languages_only(spark):
    text = " ".join(f"zx{i}q" for i in range(90))
    langs = ["en", "de", None, "pl", "pl"]
    rows = [(i, text if i < 4 else "krótki", lang, "s", 0) for i, lang in enumerate(langs)]
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert [r.doc_id for r in got] == [3]


def test_fingerprint_links_reach_through_similar_texts(spark):
    """A text of near fingerprint counts as a near copy although it shares too few five-word runs."""
    words = [f"w{i}" for i in range(4000)]
    base, far = " ".join(words[:400]), " ".join([*words[:399], "x"])
    texts = [base, far, " ".join(words[1000:1400])]
    # A repeated run weighs most in a fingerprint and little in a set of runs.
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(10, "a b c " * 60 + " ".join(words[2000:2008])), (11, "a b c " * 60 + " ".join(words[2100:2108]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r["doc_id"]: r["component_id"] for r in near_groups(docs).collect()}
    assert near[11] == 10
    assert {r["doc_id"] for r in drop_similar(docs).collect()} == {0, 2, 10, 11}
    assert {r["doc_id"] for r in drop_similar(docs, fingerprints=True).collect()} == {0, 2, 10}


def test_a_long_text_is_hashed_in_pieces():
    import tracemalloc

    text = "word " * 400_000
    tracemalloc.start()
    got = fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == fingerprint("word word word") and peak < 56_000_000
