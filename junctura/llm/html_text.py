"""Main text of web pages, with site templates found by counting element subtrees per host."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.shared import free_name, stage

# A subtree is a template of a host from this many pages and this share of its pages on.
LEAST_PAGES = 5
LEAST_SHARE = 0.05
# A paragraph of this many words is prose, and a recurring container of more is content.
PROSE_WORDS = 30
CONTAINER_WORDS = 60

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav
    ol option p pre search section summary table tbody td tfoot th thead title tr ul""".split()
)
CLOSES_P = BLOCKS - frozenset("body caption head html legend option tbody td tfoot th thead title tr dd dt li".split())
ACROSS_CELLS = frozenset("html body table caption tbody thead tfoot tr td th".split())
SCOPE = frozenset("html table td th caption template object button marquee applet".split())
# What a start tag closes, up to where.
CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dd": (frozenset("dd dt".split()), frozenset(["dl"])),
    "dt": (frozenset("dd dt".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset(["table", "tr"])),
    "th": (frozenset("td th".split()), frozenset(["table", "tr"])),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
# Elements that are never part of an article, and the words in a class, id or role that say so.
ASIDE = frozenset(
    """nav aside footer form head script style noscript template iframe svg canvas object embed audio
    video button select textarea input datalist dialog menu title xmp noembed noframes search""".split()
)
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie
    cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup
    share sharing social related recommended recommendations sidebar menu nav navbar navigation
    breadcrumb breadcrumbs pagination footer comment comments respond disqus masthead contentinfo
    complementary search alert dialog""".split()
)
NEGATIONS = frozenset("has with no without is js".split())
CONTAINERS = frozenset("div section ul ol dl table header".split())

# An attribute by the standard's states: a name, and after an equals sign a value that ends at its own quote,
# or unquoted at white space or the tag's end, whatever quotes it holds.
_SPACE = r"[\t\n\f\r ]"
_NAME = r"=[^\t\n\f\r />=]*+|[^\t\n\f\r />=]++"
_VALUE = r"""\"[^"]*+"|'[^']*+'|(?!["'])[^\t\n\f\r >]*+"""
_EQUALS = rf"{_SPACE}*+={_SPACE}*+"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"""
    rf"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"""
    rf"""(?P<attrs>(?:[\s/]++|(?:{_NAME})(?:{_EQUALS}(?:{_VALUE})|(?!{_SPACE}*+=)))*+)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_EQUALS}({_VALUE}))?+")
_TOLD = frozenset("class id role hidden itemprop".split())
_WORD = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Elements in document order; a parent always comes before its children."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    hints: list[str] = field(default_factory=lambda: [""])
    # Of each element, its texts and the numbers of its children, in order.
    parts: list[list[str | int]] = field(default_factory=lambda: [[]])
    # Texts with their element, and breaks between blocks as None.
    flow: list[tuple[int, str] | None] = field(default_factory=list)

    def open(self, tag: str, parent: int, hint: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.hints.append(hint)
        self.parts.append([])
        self.parts[parent].append(len(self.tags) - 1)
        return len(self.tags) - 1


def _attributes(raw: str) -> str:
    """Class, id, role and the like as one lower-case string."""
    if "=" not in raw and "hidden" not in raw.lower():
        return ""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in _TOLD and name not in found:
            plain = value[1:-1] if value[:1] in ('"', "'") else value
            found[name] = "=hidden" if name == "hidden" else f"{name}={plain.lower()}"
    return " ".join(found.values())


def parse(source: str) -> Page:
    """A page's elements, with the end tags that may be left out put in; cut-off tags are dropped."""
    page = Page()
    stack = [0]
    tags = page.tags
    # How many elements of each tag are open, so that deep pages aren't searched in vain.
    opened: Counter[str] = Counter()

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw)
            page.parts[stack[-1]].append(plain)
            page.flow.append((stack[-1], plain))

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag = tags[stack.pop()]
            opened[tag] -= 1
            if tag in BLOCKS:
                page.flow.append(None)

    def close_implied(names: frozenset[str], stop: frozenset[str]) -> None:
        outermost = 0
        if not any(opened[n] for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = tags[stack[depth]]
            if tag in stop:
                break
            if tag in names:
                outermost = depth
        if outermost:
            close(outermost)

    at, size = 0, len(source)
    while at < size:
        mark = source.find("<", at)
        if mark < 0:
            text(source[at:])
            break
        token = _TOKEN.match(source, mark)
        if token is None:
            cut_off = re.compile(r"</?[a-zA-Z]").match(source, mark)
            text(source[at:mark] if cut_off else source[at : mark + 1])
            if cut_off:
                break
            at = mark + 1
            continue
        text(source[at:mark])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            if not opened[tag]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == tag:
                    close(depth)
                    break
                # An inline end tag closes nothing across a block, nor any but a table's across a cell.
                if tag not in BLOCKS and tags[stack[depth]] in BLOCKS:
                    break
                if tags[stack[depth]] in ("td", "th", "table") and tag not in ACROSS_CELLS:
                    break
            continue
        if tag in CLOSES_P:
            close_implied(frozenset(["p"]), SCOPE)
            if tag[0] == "h" and tag[1:].isdigit() and tags[stack[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                close(len(stack) - 1)
        if tag in CLOSED_BY:
            close_implied(*CLOSED_BY[tag])
        node = page.open(tag, stack[-1], _attributes(token["attrs"]))
        if tag in BLOCKS or tag == "br":
            page.flow.append(None)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(source, at)
            page.parts[node].append(source[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        stack.append(node)
        opened[tag] += 1
    return page


def _normal(text: str) -> str:
    return " ".join(text.split())


def digests(page: Page) -> tuple[list[int], list[int]]:
    """Of each element's subtree, a signed 64-bit digest (tags, classes and texts) and its words."""
    count = len(page.tags)
    made, words = [0] * count, [0] * count
    for node in range(count - 1, -1, -1):
        parts = [page.tags[node].encode(), page.hints[node].encode("utf-8", "surrogatepass")]
        for part in page.parts[node]:
            if isinstance(part, int):
                parts.append(made[part].to_bytes(8, "little", signed=True))
                words[node] += words[part]
            elif plain := part.split():
                parts.append(" ".join(plain).encode("utf-8", "surrogatepass"))
                words[node] += 0 if page.tags[node] in RAW else len(plain)
        value = xxhash.xxh64_intdigest(b"\x00".join(parts))
        made[node] = value - (1 << 64) if value >> 63 else value
    return made, words


def _hinted(hint: str) -> bool:
    """Whether a class, id or role names something aside; "has-sidebar" and the like don't."""
    if not hint:
        return False
    if "=hidden" in hint:
        return True
    for name in re.sub(r"(?:^| )(?:class|id|role|itemprop)=", " ", hint).split():
        words = _WORD.findall(name)
        if words and words[0] not in NEGATIONS and not HINTS.isdisjoint(words):
            return True
    return False


def _content(page: Page, words: list[int]) -> tuple[int, list[bool]]:
    """The element that holds the main text (0: the whole page), and which elements lie aside.

    That is the article with the most words, or else the main element with the most. An article in
    another is a reader's comment, and a header outside of any is the site's. A wrapper of an article
    isn't aside, and without one a hint doesn't remove what holds most of the page.
    """
    count, tags, parents = len(page.tags), page.tags, page.parents
    wraps = [tags[n] in ("article", "main") for n in range(count)]
    for node in range(count - 1, 0, -1):
        wraps[parents[node]] = wraps[parents[node]] or wraps[node]
    article, main, aside = [False] * count, [False] * count, [False] * count
    for node in range(1, count):
        tag, parent = tags[node], parents[node]
        article[node] = article[parent] or tags[parent] == "article"
        main[node] = main[parent] or tags[parent] == "main"
        if tag == "article":
            own = article[node] or _hinted(page.hints[node])
        elif wraps[node]:
            own = False
        else:
            own = tag in ASIDE or (tag == "header" and not article[node] and not main[node])
            if not own and tag not in ("html", "body"):
                own = _hinted(page.hints[node]) and (wraps[0] or 2 * words[node] <= words[0])
        aside[node] = aside[parent] or own
    for tag in ("article", "main"):
        found = [n for n in range(1, count) if tags[n] == tag and not aside[n]]
        if found:
            return max(found, key=lambda n: (words[n], -n)), aside
    return 0, aside


def _may_be_template(page: Page, node: int, words: list[int], rooted: bool) -> bool:
    """Whether an element is left out once it recurs: prose and wrappers of much text never are."""
    tag = page.tags[node]
    if tag not in BLOCKS or tag in ("html", "body", "main", "article", "head"):
        return False
    if tag in CONTAINERS:
        return words[node] <= CONTAINER_WORDS
    return not rooted and words[node] < PROSE_WORDS


def subtree_digests(source: str | None) -> list[int]:
    """The distinct digests of a page's subtrees that hold words and may turn out to be templates."""
    page = parse(source or "")
    made, words = digests(page)
    found = {
        made[n]
        for n in range(1, len(page.tags))
        if words[n] and page.tags[n] in BLOCKS and page.tags[n] not in ("html", "body", "head", "title")
    }
    return list(found)


def main_text(source: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page, without the subtrees whose digests are among ``templates``."""
    page = parse(source or "")
    made, words = digests(page)
    root, aside = _content(page, words)
    count = len(page.tags)
    inside, gone = [root == 0] * count, list(aside)
    inside[root] = True
    for node in range(root + 1, count):
        parent = page.parents[node]
        inside[node] = inside[node] or inside[parent]
        if gone[parent] or (
            templates
            and inside[node]
            and made[node] in templates
            and _may_be_template(page, node, words, root > 0)
        ):
            gone[node] = True
    out: list[str] = []
    for item in page.flow:
        if item is None:
            out.append(" ")
        elif inside[item[0]] and not gone[item[0]]:
            out.append(item[1])
    return _normal("".join(out))


def host_of(url: str) -> Column:
    """The host of an address in lower case, without user and port; empty if it has none."""
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    return F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(
    pages: DataFrame,
    url: str = "url",
    source: str = "html",
    least_pages: int = LEAST_PAGES,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """(host, templates) for each host with subtrees that recur on many of its pages.

    A page names each of its subtrees once; counts are combined in each task before they are
    shuffled, so a host with most of the pages is no burden. As a template is on ``least_share`` of a
    host's pages, a host has at most 1 / ``least_share`` times as many as its average page has subtrees.
    """
    rows = pages.select(host_of(url).alias("host"), F.col(f"`{source}`").cast("string").alias("source"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found = [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = subtree_digests(page.as_py())
                hosts += [host] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(found, pa.int64())], ["host", "digest"]
            )

    counts = rows.mapInArrow(work, "host string, digest bigint").groupBy("host", "digest").count()
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.filter(F.col("count") >= least_pages).join(sizes, "host")
    return (
        often.filter(F.col("count") >= least_share * F.col("pages"))
        .groupBy("host")
        .agg(F.array_sort(F.collect_list("digest")).alias("templates"))
    )


def extract(
    pages: DataFrame,
    url: str = "url",
    source: str = "html",
    out: str = "main_text",
    least_pages: int = LEAST_PAGES,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """``pages`` without its source but with column ``out``, the main text of each page.

    The main text is that of the page's article, or of its main element, or else of its body.
    Elements that are never content (menus, asides, footers, forms, scripts), those that a class, id
    or role gives away (adverts, notices, comments), and subtrees that recur on many pages of the
    host are left out; within an article only recurring containers of few words are, so passages and
    whole articles that are published twice stay. Character references are decoded, white space is
    one space, and blocks are joined by one space in page order.

    A null or empty source gives an empty text, as does a page with nothing left. Pages without a
    host share one. Repeated rows each give a row, and count as pages of their own. An empty table
    gives no rows. Other columns stay as they are; ``out`` gets underscores before it if it is taken.
    """
    templates = stage(site_templates(pages, url, source, least_pages, least_share), "templates")
    others = [c for c in pages.columns if c != source]
    named = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("page"),
        F.col(f"`{source}`").cast("string").alias("source"),
        host_of(url).alias("host"),
    )
    rows = named.join(templates, "host", "left").select("page", "source", "templates")
    out = free_name(pages.drop(source), out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(page.as_py(), frozenset(known.as_py() or ()))
                for page, known in zip(batch.column(1), batch.column(2), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page", "text"])

    kind = rows.schema["page"].dataType.simpleString()
    kept = rows.mapInArrow(work, f"page {kind}, text string")
    return kept.select(*[F.col("page").getField(c).alias(c) for c in others], F.col("text").alias(out))
