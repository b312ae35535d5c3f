"""HTML extraction by equivalence-class template deduction.

Every page becomes tokens: tags by their path from the root, and runs of text by path and words.
The pages of a host that have one layout (the same elements near the root) share a template. Over
them, a token's occurrence vector says how often each page has it; tokens with equal vectors form
an equivalence class. A class is considered if it has ``MIN_CLASS`` tokens, or is a run of text,
and occurs in ``MIN_SHARE`` of the layout's distinct pages, in ``MIN_PAGES`` at least. Classes are
valid if they nest: each lies within one gap of every class that holds it, or apart from it. The
valid ones nest into the template; what stands between its tokens are the slots, and a run of text
that is a token of the template itself is no slot. The main text is what the slots hold inside the
page's main element; a heading of the article stays.

The vectors are never gathered: one hash a (page, count), combined by exclusive or, stands for a
token's vector, so that Spark counts a host with a third of all pages like any other. A template is
small, its tokens being in most pages of its layout. Templates are written as a table and joined by
host and layout, broadcast or shuffled as their size asks for. A page is read once: its tokens and
the runs of its main element are written and read again.

Structure decides what a template cannot: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments are dropped by element, role or class name; ``article`` or
``main`` delimit the text where a page has them, else the whole rest of the page counts. Inside an
article, a name that joins the word for an aside with a subject (related-work) is no aside.

Text: character references are decoded, white space inside a block is one blank, blocks are
trimmed and joined in page order by a blank. Nothing else is dropped or cut. A null page gives an
empty text. Pages whose url names no host count as one host. Rows that repeat a page_id each get a
row; pages of equal content count once for the template. An empty table gives an empty table;
further columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.common import schema_of, stored

MIN_PAGES, MIN_SHARE = 4, 0.6
#: Tokens a class needs; one run of text that is the same in so many pages is a class by itself.
MIN_CLASS = 2
#: Levels of elements, from the root on, that make the layout of a page.
LAYOUT_DEPTH = 3
#: Elements nested deeper are counted by name, and dropped as elsewhere.
DEPTH = 512

# Fixed lists of HTML elements and of words that name parts of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
DROPPED = set(
    "head title nav footer aside form script style noscript template svg math button select "
    "textarea iframe object audio video canvas map dialog menu datalist input option search".split()
)
ROLES = set(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
    "toolbar form note".split()
)
#: Words in names of parts that hold no main text wherever they stand ...
ASIDES = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notices?|disclaimer|alert|popup|"
    r"modal|overlay|newsletter|subscri\w+|signup|share|sharing|social|related|recommend\w*|comments?|"
    r"commentlist|disqus|replies|reply|respond|pagination|pager|skip-link|login|breadcrumbs?)(?=$|[_-])"
)
#: ... and of parts of the layout, whose names a box around the whole page may bear too.
LAYOUT = re.compile(
    r"(?:^|[_-])(?:banner|nav|navbar|navigation|menu|sidebar|side-bar|aside|widget|footer|site-header|"
    r"page-header|masthead|topbar|toolbar|search)(?=$|[_-])"
)
_TELLS_STATE = re.compile(r"(?:has|with|no|without|is|js)[_-]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
#: Elements that end when another of their kind begins.
SIBLINGS = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Blocks that end an open paragraph.
END_PARAGRAPH = BLOCKS - {"br", "option", "optgroup"}
SCOPES = {"table", "ul", "ol", "dl", "select", "article", "main", "section", "div", "body", "html"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
    # A quote opens a value only behind an equals sign, and the value may hold anything else.
    r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^<>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Run:
    """A run of text between two tags: its block, its token, and how far it is main text.

    ``article`` is 2 inside an article, 1 inside one that stands in a box named like a part of
    the layout, 0 elsewhere.
    """

    __slots__ = ("article", "block", "heading", "text", "token")

    def __init__(self, block: int, text: str, token: int, article: int, heading: bool):
        self.block, self.text, self.token = block, text, token
        self.article, self.heading = article, heading


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) >> 1


#: How an element is kept out: not at all, by a name of the layout, or for good.
KEPT, LAID_OUT, OUT = 0, 1, 2


#: Words that go with the names of asides; inside an article others make it a subject of the text.
_NEUTRAL = set(
    "area article articles banner bar block body bottom box btn button buttons card container content entry footer "
    "form grid group head header icon icons image images inner item items left line link links list main "
    "message module panel page post posts right row section side site slot small story text title top unit "
    "view widget wrap wrapper".split()
)


#: Words that name an aside beside an article, and may name a section in it.
_SUBJECTS = re.compile(r"promotions?|subscriptions?")


def _only_aside(word: str) -> bool:
    """Whether a class or id names nothing but an aside: its parts are such words or neutral ones."""
    if _SUBJECTS.fullmatch(word):
        return False
    rest = ASIDES.sub("", word)
    return all(len(x) <= 2 or x in _NEUTRAL or x.isdigit() for x in re.split(r"[_-]+", rest))


def _kept_out(tag: str, attributes: str, in_article: bool) -> int:
    """Whether the element is no main text."""
    if tag in DROPPED or tag == "header" and not in_article:
        return OUT
    if not attributes or tag in ("html", "body"):
        return KEPT
    found = KEPT
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" and m[0].lower() == "hidden":
            return OUT
        if name == "aria-hidden" and value.lower() == "true" or name == "itemprop" and value == "comment":
            return OUT
        if name == "role" and value.lower() in ROLES:
            return OUT
        if name in ("class", "id"):
            for word in _CAMEL.sub("-", value).lower().split():
                if _TELLS_STATE.match(word):
                    continue
                if ASIDES.search(word) and (tag not in ("article", "main") or "comment" in word):
                    if not in_article or _only_aside(word):
                        return OUT
                if tag not in ("article", "main") and LAYOUT.search(word):
                    found = LAID_OUT
    return found


def read_page(html: str) -> tuple[list[int], list[Run], int]:
    """The tokens of the page in order, the runs of text outside dropped elements, and its layout.

    Tokens of text are odd, those of tags even. The layout is a hash of the paths of the elements
    near the root, whatever their number.
    """
    tokens: list[int] = []
    runs: list[Run] = []
    skeleton: set[int] = set()
    deep: dict[str, int] = {}
    # Open elements: name, how it is kept out, how far it is an article, hash of the path.
    open_: list[tuple[str, int, int, int]] = [("", KEPT, 0, 0)]
    block, at = 0, 0

    def text(raw: str) -> None:
        value = unescape(raw) if "&" in raw else raw
        if not value:
            return
        tag, dropped, article, path = open_[-1]
        words = " ".join(value.split())
        token = _hash(str(path), words) | 1 if words else 0
        if words:
            tokens.append(token)
        if dropped == KEPT or dropped == LAID_OUT and article:
            heading = article > 0 and any(e[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for e in open_)
            runs.append(Run(block, value, token, article, heading))

    def close(k: int) -> None:
        del open_[k:]

    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            block += 1
        if m[1] and deep.get(tag):
            deep[tag] -= 1
            continue
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == tag:
                    close(k)
                    tokens.append(_hash(str(open_[-1][3]), "/" + tag) & ~1)
                    break
            continue
        ended = SIBLINGS.get(tag, {"p"} if tag in END_PARAGRAPH else None)
        if ended:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in ended:
                    close(k)
                    break
                if open_[k][0] in SCOPES or open_[k][0] in DROPPED:
                    break
        _, dropped, article, path = open_[-1]
        here = _kept_out(tag, m[3], article > 0)
        opens = tag in ("article", "main") or "main" in m[3] and _main(m[3])
        if here == OUT or dropped == OUT:
            dropped, article = OUT, 0
        elif here == LAID_OUT:
            dropped, article = LAID_OUT, 0
        elif opens and not article:
            article = 1 if dropped == LAID_OUT else 2
        path = _hash(str(path), tag, " ".join(sorted(_classes(m[3])))) & ~1
        tokens.append(path)
        if len(open_) <= LAYOUT_DEPTH and tag not in VOID and tag not in DROPPED:
            skeleton.add(path)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else len(html)
            if tag not in DROPPED:
                open_.append((tag, dropped, article, path))
                text(html[at:stop])
                open_.pop()
            closing = html.find(">", stop)
            at = closing + 1 if end and closing >= 0 else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            if len(open_) < DEPTH or here == OUT and open_[-1][1] != OUT:
                open_.append((tag, dropped, article, path))
            else:
                deep[tag] = deep.get(tag, 0) + 1
    return tokens, runs, _hash(*map(str, sorted(skeleton)))


def _classes(attributes: str) -> list[str]:
    if "class" not in attributes:
        return []
    return [
        w
        for m in _ATTR.finditer(attributes)
        if m[1].lower() == "class"
        for w in (m[2] or m[3] or m[4] or "").split()
    ]


def _main(attributes: str) -> bool:
    return any(m[1].lower() == "role" and (m[2] or m[3] or m[4]) == "main" for m in _ATTR.finditer(attributes))


def main_runs(runs: list[Run]) -> list[Run]:
    """The runs inside the page's main element, or of the whole page where it has none."""
    best = max((r.article for r in runs if r.token), default=0)
    return [r for r in runs if r.article == best]


def main_text(runs: list[Run], template: frozenset[int]) -> str:
    """The runs left in the slots, as blocks of one line each."""
    blocks: dict[int, list[str]] = {}
    for r in main_runs(runs):
        if r.token == 0 or r.heading or r.token not in template:
            blocks.setdefault(r.block, []).append(r.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return " ".join(x for x in lines if x)


def host_of(url: Column) -> Column:
    """The host as a number."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.xxhash64(F.coalesce(found, F.lit("")))


def group_of(host: int, layout: int) -> int:
    """The group of pages that share a template."""
    return _hash(str(host), str(layout))


_RUN = pa.struct(
    [("block", pa.int32()), ("text", pa.string()), ("token", pa.int64()), ("article", pa.int32()), ("heading", pa.bool_())]
)
_READ = (
    "host long, seed long, tokens array<struct<token: long, n: int, place: int>>, "
    "runs array<struct<block: int, text: string, token: long, article: int, heading: boolean>>"
)


def read_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, host) read once: each page's tokens and runs of main text.

    ``host`` becomes the hash of a page's host and its layout: each layout of a host has its own
    template. ``tokens`` says how often each token occurs and where first; token -1 stands for the
    page. ``seed`` is a hash of the page's content.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, seeds, tokens, runs = [], [], [], []
            for host, html in zip(*(batch.column(c).to_pylist() for c in ("host", "html")), strict=True):
                found, own, layout = read_page(html or "")
                counts: dict[int, list[int]] = {}
                for at, token in enumerate([-1, *found]):
                    counts.setdefault(token, [at, 0])[1] += 1
                hosts.append(group_of(host, layout))
                seeds.append(_hash(html or ""))
                tokens.append([(t, n, at) for t, (at, n) in counts.items()])
                runs.append([(r.block, r.text, r.token, r.article, r.heading) for r in main_runs(own)])
            token = pa.struct([("token", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(hosts, pa.int64()),
                    pa.array(seeds, pa.int64()),
                    _structs(tokens, token),
                    _structs(runs, _RUN),
                ],
                ["page_id", "url", "host", "seed", "tokens", "runs"],
            )

    return pages.select("page_id", "url", "html", "host").mapInArrow(
        rows, f"{schema_of(pages, 'page_id', 'url')}, {_READ}"
    )


def _structs(lists: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Lists of tuples as lists of structs."""
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    columns = list(zip(*(row for x in lists for row in x), strict=True)) or [[]] * kind.num_fields
    fields = [pa.array(c, kind.field(k).type) for k, c in enumerate(columns)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


def occurrences(read: DataFrame) -> DataFrame:
    """(host, token, vector, place), a row for each page and token.

    ``vector`` is a hash of (page content, count), ``place`` where the token comes first.
    """
    found = read.select("host", "seed", F.explode("tokens").alias("t"))
    return found.select("host", "t.token", F.xxhash64("seed", "t.n").alias("vector"), "t.place")


def nest(classes: list[tuple[int, list[tuple[float, int]]]]) -> list[int]:
    """The tokens of the valid classes; a class is (support, its tokens with their mean places).

    The most frequent and largest class comes first. A class that comes later is valid if it lies
    within one gap of each class before it (before its first, between two of its tokens, or behind
    its last) or, where it is as frequent, holds it within one gap of its own.
    """
    valid: list[list[float]] = []
    out: list[int] = []
    for _, members in sorted(classes, key=lambda c: (-c[0], -len(c[1]), min(c[1]))):
        places = sorted(p for p, _ in members)

        def within(inner: list[float], outer: list[float]) -> bool:
            return bisect.bisect_left(outer, inner[0]) == bisect.bisect_left(outer, inner[-1])

        if all(within(places, other) or within(other, places) for other in valid):
            valid.append(places)
            out += [token for _, token in members]
    return out


def templates(
    read: DataFrame,
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    min_class: int = MIN_CLASS,
) -> DataFrame:
    """(host, tokens): the template of each layout of a host that has one, from the pages as read."""
    seen = occurrences(read).groupBy("host", "token", "vector").agg(F.first("place").alias("place"))
    vectors = seen.groupBy("host", "token").agg(
        F.bit_xor("vector").alias("vector"),
        F.count("*").alias("support"),
        F.avg("place").alias("place"),
    )
    vectors = vectors.where(F.col("support") >= min_pages)
    # The token of the page itself stands in the class of what every page has once.
    of_host = vectors.where("token = -1").select("host", F.col("support").alias("n_pages"))
    frequent = vectors.join(of_host, "host").where(
        F.col("support") >= min_share * F.col("n_pages")
    )

    def one(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        classes = [
            (int(part["support"].iloc[0]), list(zip(part["place"], part["token"], strict=True)))
            for _, part in found.groupby("vector")
            if len(part) >= min_class or int(part["token"].iloc[0]) % 2 and part["token"].iloc[0] != -1
        ]
        tokens = [int(t) for t in nest(classes) if t != -1]
        return pd.DataFrame({"host": [key[0]], "tokens": [tokens]})

    return frequent.groupBy("host").applyInPandas(one, "host long, tokens array<long>")


def extract(pages: DataFrame, **rule) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    read = stored(read_pages(hosted), "zstd")  # mostly text, read twice
    known = stored(templates(read, **rule))
    joined = read.select("page_id", "url", "host", "runs").join(known, "host", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("runs", "tokens"))
            texts = [
                main_text([Run(*r.values()) for r in runs], frozenset(tokens or ()))
                for runs, tokens in zip(*columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(x) for x in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    schema = f"{schema_of(pages, 'page_id', 'url')}, text string, n_chars long"
    return joined.select("page_id", "url", "runs", "tokens").mapInArrow(rows, schema)
