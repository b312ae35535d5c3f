"""Main text of pages: structure alone, deduced templates, odd markup."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stocklens.llm import html_extract

from conftest import sentence  # isort: skip


def text_of(html, template=()):
    return html_extract.main_text(html_extract.read_page(html)[1], frozenset(template))


def test_structure():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
      <header><h1>Site</h1></header><nav><a href="/">Menu</a></nav><!-- no <p>no</p> -->
      <div class="ad banner">Buy</div><div id="cookie-notice">Cookies</div>
      <article><header><h1>Fish &amp; chips</h1></header><p>One<b>two</b> &lt;three&gt;
      four<br>five<p>six <a href="x" title="a > b">link</a>.<script>var t="</p>no";</script>
      <ul><li>s&eacute;ven<li>eight&nbsp;&#57;</ul><aside>Aside</aside><form>Form <input></form>
      <table><tr><td>a<td>b</table><section class="comments"><p>First!</p></section></article>
      <article class="comment">Me too</article><div role="complementary">Other</div>
      <footer>&copy; foot</footer></body></html>"""
    assert text_of(page) == "Fish & chips Onetwo <three> four five six link. séven eight 9 a b"


def test_without_article():
    assert text_of("<body><div class='sidebar'>x</div><div>Main <i>te</i>xt</div>tail") == "Main text tail"
    assert text_of("<div role=main><p>in</div><p>out") == "in"
    assert text_of("plain text, a < b & c") == "plain text, a < b & c"
    assert text_of("<p>adjust headings address</p>") == "adjust headings address"


def test_boxes_named_like_the_layout():
    page = "<div class='page sidebar-left'><nav>n</nav><main><h1>T</h1><p>text</p></main></div><div class=sidebar>s</div>"
    assert text_of(page) == "T text"
    page = "<div class='sidebar'><article>teaser</article></div><article>real</article><div id=userComments>c</div>"
    assert text_of(page) == "real"
    assert text_of("<div class='has-sidebar no-ads'><p>in</p></div><div class='cookieNotice'>x</div>") == "in"
    assert text_of("<article>a<div class=related-posts><article>b</article></div></article>") == "a"


def test_odd_markup():
    for page in ("", "<", "<a", "<p", "</p>", "<!--", "<![CDATA[", "<p class=", '<p class="x', "<b><i></b></i>", "&", "&#xZ;"):
        text_of(page)
    assert text_of("<p>a<script>if (a < b) {</script>b</p>") == "ab"
    assert text_of("<p>a<script>never closed <p>b") == "a"
    assert text_of("<![CDATA[x & y]]>") == "x & y"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after"
    assert text_of(deep) == "deep after"
    assert text_of('<a "' * 20000 + "x") .endswith("x")
    assert len(text_of("<p>word " * 50000).split()) == 50000


def test_sections_of_an_article_stay():
    for name in ("related-work", "social-history", "notice-of-change", "promotion", "comments-on-kant", "subscription-guide"):
        page = f"<article><h1>T</h1><section class='{name}'><p>text of it</p></section><p>end</p></article>"
        assert text_of(page) == "T text of it end", name
    for name in ("related-posts", "social-share", "share buttons", "cookie-notice", "newsletter-box", "post-comments", "ad-slot-3"):
        assert text_of(f"<article>T<div class='{name}'>x</div></article>") == "T", name


def test_long_attributes_and_deep_elements():
    value = "x < y > z " * 500
    assert text_of(f'Hello <div data-x="{value}" title=\'a "b" > c\'>world</div>') == "Hello world"
    assert text_of('<p class=x">one</p><p title="a>b">two') == "one two"
    deep = "<div>" * 700 + "<nav>MENU<nav>MORE</nav></nav>T<section><aside>A</aside>U</section>" + "</div>" * 700 + "<p>after"
    assert text_of(deep) == "T U after"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_goes_and_article_stays(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(40):
        host = "a.example" if k < 30 else f"h{k}.example"
        parts = [sentence(rng, "en", rng.randint(5, 20)) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{p}</p>" for p in parts)
        html = (
            f"<html><body><div><span>Welcome to the site</span><em>Since 1999</em></div>"
            f"<div class=story><h2>{parts[0][:9]}</h2>{body}</div><div><i>All rights</i> <u>reserved</u></div>"
        )
        rows.append((k, f"http://{host}/p/{k}", html))
        kept = [parts[0][:9].strip(), *parts]
        if k >= 30:
            kept = ["Welcome to the siteSince 1999", *kept, "All rights reserved"]
        want[k] = " ".join(kept)
    rows.append((99, "http://a.example/copy", rows[0][2]))
    want[99] = want[0]
    got = html_extract.extract(pages_of(spark, rows)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_copies_of_a_page_make_no_template(spark):
    html = "<article><h1>Head</h1><p>The same article on many pages.</p></article>"
    got = html_extract.extract(pages_of(spark, [(k, "http://b.example/x", html) for k in range(20)])).collect()
    assert {r["text"] for r in got} == {"Head The same article on many pages."} and len(got) == 20


def test_each_layout_of_a_host_has_its_template(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for k in range(40):
        parts = [sentence(rng, "en", rng.randint(5, 20)) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{p}</p>" for p in parts)
        notice = "<p>You read this free of charge.</p>" if k % 20 < 15 else ""
        if k % 2:
            html = f"<html><body><div class=top><b>Daily</b> <i>news</i></div><div class=story>{body}{notice}</div></body></html>"
        else:
            html = f"<html><body><section><em>Our shop</em><div class=text>{body}</div><u>Call us</u></section></body></html>"
            notice = ""
        rows.append((k, "http://two.example/", html))
        want[k] = " ".join(parts)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages_of(spark, rows)).collect()}
    assert got == want
    # Without templates the boxes' texts stay: it is the deduction that drops them.
    alone = {r["page_id"]: r["text"] for r in html_extract.extract(pages_of(spark, rows), min_pages=99).collect()}
    assert all(len(alone[k]) > len(want[k]) for k in want)


def classes_by_hand(pages, min_pages, min_share, min_class):
    """The valid classes of pages of one layout, from whole occurrence vectors."""
    distinct = list(dict.fromkeys(pages))
    read = [html_extract.read_page(html)[0] for html in distinct]
    tokens = {t for found in read for t in found}
    classes = {}
    for t in tokens:
        vector = tuple(found.count(t) for found in read)
        support = sum(n > 0 for n in vector)
        if support >= min_pages and support >= min_share * len(distinct):
            places = [1 + found.index(t) for found in read if t in found]
            classes.setdefault(vector, (support, []))[1].append((sum(places) / len(places), t))
    every = tuple([1] * len(distinct))
    if every in classes:  # what stands for the page itself
        classes[every][1].append((0.0, -1))
    kept = [c for c in classes.values() if len(c[1]) >= min_class or c[1][0][1] % 2]
    return set(html_extract.nest(kept)) - {-1}


def test_templates_by_brute_force(spark):
    rng = random.Random(10)
    for _ in range(3):
        shell = [f"<div class=c{rng.randrange(9)}><b>{sentence(rng, 'en', 2)}</b></div>" for _ in range(4)]
        pages = []
        for _ in range(14):
            inner = "".join(f"<p>{sentence(rng, 'en', 4)}</p>" for _ in range(rng.randint(1, 3)))
            some = [x for x in shell if rng.random() < 0.9]
            pages.append(f"<html><body><main>{''.join(some[:2])}<div class=slot>{inner}</div>{''.join(some[2:])}</main></body></html>")
        pages.append(pages[0])
        rows = [(k, "http://x.example", html) for k, html in enumerate(pages)]
        hosted = pages_of(spark, rows).withColumn("host", F.lit(5).cast("long"))
        found = html_extract.templates(html_extract.read_pages(hosted)).collect()
        assert [set(r["tokens"]) for r in found] == [classes_by_hand(pages, 4, 0.6, 2)]


def test_nesting():
    outer = (9, [(0.0, 1), (10.0, 2), (20.0, 3)])
    inner = (9, [(11.0, 4), (12.0, 5)])
    across = (8, [(9.0, 6), (13.0, 7)])
    assert sorted(html_extract.nest([inner, across, outer])) == [1, 2, 3, 4, 5]


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "x", ""), (2, "ftp://é/ü", "<p>ü"), (3, "http://c.example", "<p>" + "long " * 60000)]
    pages = pages_of(spark, rows).withColumn("host", F.lit("x")).withColumn("text", F.lit(1))
    got = sorted((str(r["page_id"]), r["url"], r["n_chars"]) for r in html_extract.extract(pages).collect())
    assert got == [("1", None, 0), ("1", None, 0), ("2", "ftp://é/ü", 1), ("3", "http://c.example", 299999), ("None", "x", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0
