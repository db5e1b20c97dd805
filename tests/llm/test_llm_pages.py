"""WARC archives, main text of pages, chat formatting and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from junctura.llm import queries
from junctura.llm.chat import (
    GrammarError,
    conversation_digests,
    escape,
    format_turns,
    parse,
    render,
    unescape,
)
from junctura.llm.html_text import extract, main_text, site_templates
from junctura.llm.shared import new_path
from junctura.llm.warc import (
    WarcError,
    _member,
    page_of,
    page_record,
    read_archives,
    read_records,
    resolved,
    round_trip,
    write_archives,
)

PAGES = "page_id bigint, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


# WARC


def test_archives_round_trip(spark):
    big = "<p>long " * 60_000
    rows = [
        (1, "http://a/é x\r\ny", "same"), (2, "http://b", "same"), (7, None, "same"), (3, "http://c", None),
        (4, "http://d", ""), (5, "http://e", big), (6, "http://f", "ünï \U0001f600\r\n\r\nx"), (7, None, "same"),
        (None, "http://g", "same"), (None, "http://h", "alone"), (8, "http://i", "WARC/1.1\r\n\r\n"),
    ]
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("page", "body", "digest", "bytes")})
    folder = new_path(spark, "warc-test")
    archives = write_archives(pages.repartition(3), folder, archive_bytes=200)
    assert archives.agg(F.sum("records")).first()[0] == len(rows) and archives.count() > 3
    records = resolved(read_archives(archives, folder, step=11)).collect()
    assert all(r.digests_hold and r.refers_hold for r in records)
    got = Counter((page_of(r.record_id), r.record_type, page_of(r.refers_to), r.payload_bytes, r.payload_digest) for r in records)
    last = {"same": 7, None: 4, "": 4}
    want = Counter()
    for page, _, body in rows:
        refers = last.get(body)
        revisit = refers is not None and page != refers
        name = None if page is None else str(page)
        want[name, "revisit" if revisit else "response", str(refers) if revisit else None, len((body or "").encode()), sha(body)] += 1
    assert got == want
    bodies = {page_of(r.record_id): bytes(r.payload) for r in records if r.record_type == "response"}
    assert bodies["5"] == big.encode() and bodies["6"] == rows[6][2].encode()


def test_short_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", ""), (2, "u", ""), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    got = {page_of(r.record_id): page_of(r.refers_to) for r in round_trip(spark, pages, least_bytes=1).collect()}
    assert got == {"1": None, "2": None, "3": "4", "4": None}


def test_no_pages_no_records(spark):
    assert round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_reader_inflates_step_by_step():
    data = b"".join(page_record(i, f"http://x/{i}", b"p" * (i * 1000)) for i in range(5))
    for step in (1, 7, 1 << 16):
        records = list(read_records(io.BytesIO(data), step))
        assert [r.payload_bytes for r in records] == [i * 1000 for i in range(5)]
        assert [zlib.decompressobj(31).decompress(data[r.offset :])[:8] for r in records] == [b"WARC/1.1"] * 5
    assert [r.payload for r in read_records(io.BytesIO(data), keep_payload=False)] == [b""] * 5


@pytest.mark.parametrize(
    "broken",
    [
        lambda d: d[:-5],
        lambda d: d[:30],
        lambda d: b"x" + d,
        lambda d: d + b"junk",
        lambda d: _member([("WARC-Type", "response"), ("Content-Length", "9")], b"short"),
        lambda d: _member([("WARC-Type", "response"), ("Content-Length", "2")], b"longer"),
        lambda d: _member([("WARC-Type", "response")], b"none"),
    ],
)
def test_broken_archives_are_refused(broken):
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(broken(page_record(1, "http://x", b"payload")))))


def test_a_changed_payload_shows_in_its_digest():
    plain = zlib.decompressobj(31).decompress(page_record(1, "http://x", b"payload"))
    packer = zlib.compressobj(wbits=31)
    changed = packer.compress(plain.replace(b"payload\r\n", b"PAYLOAD\r\n")) + packer.flush()
    (record,) = read_records(io.BytesIO(changed))
    assert record.headers["warc-payload-digest"] != f"sha1:{record.payload_digest}"


# Main text

ARTICLE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script>
</head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div class="cookie-notice">Cookies!</div><article><h1>Title &amp; more</h1><p>One <b>bo</b>ld<br>line<p>Two
  &lt;b&gt;<!-- no --> &eacute;<aside>aside</aside><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>
<form>form</form><div id="comments">Comment</div><article>nested</article></article><footer>foot</footer>"""


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("<", "<"),
        ("<p", ""),
        ("a<b>c</b>d</x> 1 < 2 & 3 &am", "acd 1 < 2 & 3 &am"),
        ("x<script>y", "x"),
        ("x<!-- y", "x"),
        ("<div>a</div>b<span>c</span>", "a bc"),
        ("<p>a  &nbsp;\t b</p>", "a b"),
        (ARTICLE, "Title & more One bold line Two <b> é x y 1 2"),
        (ARTICLE[: ARTICLE.index("<ul><li>x")], "Title & more One bold line Two <b> é"),
        ("<div class='ad'>buy</div><main><p>m</main><footer>f", "m"),
        ("<p hidden>h</p><div role=navigation>n</div><p>p</p><p>q r s t", "p q r s t"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<article><p>one</p><p data-x=it's>two words</p><p>three</p></article>", "one two words three"),
        ("<article><p>one<p data-x=it's>two<p>it's four</article>", "one two it's four"),
        ("<p a = 'x>y' b=\"it's\"c=d=\"e/ =f>in <br/>out", "in out"),
        ("<p title='class=ad'>kept <p data-class=ad>too <p class = ad>gone <p CLASS=it's id=ad>gone <p>end it on <p>words", "kept too end it on words"),
        ("before <p title='open>after", "before"),
    ],
)
def test_main_text(source, text):
    assert main_text(source) == text


def site(n, host="a.example"):
    rows = []
    for i in range(n):
        body = f"<div class=box><p>Read our daily letter now</p></div><p>Story {i} of many words</p>"
        article = f"<article><h1>Head {i}</h1><div><p>Tell your friends about us</p></div><p>{'shared passage ' * 40}</p><p>Shared end</p></article>"
        rows.append((i, f"http://u:p@{host.upper()}:80/{i}", body if i % 2 else body + article))
    return rows


def test_templates_are_what_recurs_on_a_host(spark):
    pages = spark.createDataFrame([*site(20), (99, "http://b.example/", site(1)[0][2]), (100, None, None)], PAGES)
    hosts = {r.host: len(r.templates) for r in site_templates(pages).collect()}
    assert set(hosts) == {"a.example"}
    pages = pages.withColumns({c: F.lit("x") for c in ("page", "source", "host", "templates", "main_text")})
    got = extract(pages)
    assert got.columns == [c for c in pages.columns if c != "html"] + ["_main_text"]
    texts = {r.page_id: r._main_text for r in got.collect()}
    assert texts[1] == "Story 1 of many words"
    assert texts[2] == "Head 2 " + "shared passage " * 40 + "Shared end"
    # The other host has too few pages to tell.
    assert texts[99].startswith("Head 0 Tell your friends") and texts[100] == ""


def test_no_pages_no_texts(spark):
    assert extract(spark.createDataFrame([], PAGES)).count() == 0


# Chat

PARTS = ["###", "</turn>", "\\", "\\\\", " ", "\n", "### User: ", "a", "é\U0001f600", ":", "=", "#", "<"]


def test_turns_come_back_whatever_they_say():
    rng = random.Random(11)
    texts = ["", "\\", " </turn>\n", queries.TRAP, *["".join(rng.choices(PARTS, k=rng.randint(0, 9))) for _ in range(3000)]]
    roles = ["user", "assistant", "system", "tool", "", "=x", "User", "a: b\\", "###", "\n"]
    whole, turns = "", []
    for text in texts:
        assert unescape(escape(text, 2)) == text
        role = rng.choice(roles)
        turn, start, end, _ = render(role, text)
        assert unescape(turn[start:end]) == text
        whole += turn
        turns.append((role, text))
    assert [(r, t) for r, t, _, _ in parse(whole)] == turns


def test_no_more_is_escaped_than_needed():
    assert [render("user", t)[3] for t in ("plain \\n", "a ### b", queries.TRAP, "\\\\")] == [0, 1, 2, 2]


@pytest.mark.parametrize("text", ["x", "### Nobody: x </turn>\n", "### User: x", "### User: x </turn>", "### User: ### </turn>\n", "### =a"])
def test_other_text_is_no_conversation(text):
    with pytest.raises(GrammarError):
        parse(text)


def test_conversations_match_brute_force(spark):
    rng = random.Random(12)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None, "odd: one"]),
             rng.choice([None, "", "x" * 5000, "".join(rng.choices(PARTS, k=6))])) for _ in range(300)]
    rows += rows[:5]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    table = table.withColumns({c: F.lit("x") for c in ("conv", "body", "formatted")})
    got = {r.conv: tuple(r)[1:] for r in conversation_digests(format_turns(table.repartition(4))).collect()}
    for conv in (1, 2, 3, None):
        own = [(t, r or "", x or "") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], render(t[1], t[2])[0]))
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        chars = sum(len(render(r, x)[0]) for _, r, x in own)
        assert got[conv] == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    assert conversation_digests(format_turns(table.limit(0))).count() == 0


# The pipeline


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what it should do with all that the stage before it kept."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, sf_dir).cache()
        seen.append(docs.toPandas())
    good, exact, near, mixed, pieces = seen
    assert all(list(d.columns) == columns for d in seen[:-1])
    from test_llm_documents import plain_components, plain_quality

    for text in good["text"]:
        words, _, _, _, repeated = plain_quality(text)
        assert words >= 50 and 2 * repeated <= words
    firsts = {}
    for doc, text in sorted(zip(good["doc_id"], good["text"], strict=True)):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), doc)
    assert set(exact["doc_id"]) == set(firsts.values())
    sets = {d: plain_shingles(t) for d, t in zip(exact["doc_id"], exact["text"], strict=True)}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    roots = plain_components(sorted(sets), alike)
    assert set(near["doc_id"]) == set(roots.values())
    size = near.set_index("doc_id")["text"].str.split().str.len()
    assert set(mixed["doc_id"]) <= set(near["doc_id"]) and mixed["doc_id"].value_counts().max() <= 3
    taken = size.loc[mixed["doc_id"]].sum()
    assert abs(taken - size.sum()) <= 0.01 * size.sum() + 2 * near["source"].nunique()
    whole = pieces.groupby("doc_id")["length"].sum() / pieces.groupby("doc_id")["doc_tokens"].first()
    assert (whole == mixed["doc_id"].value_counts().reindex(whole.index)).all()


def test_every_query_is_listed_with_its_sql():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences",
    ]
