"""Main text of pages against the known text of planted layouts."""

import html
import re

import numpy as np
from pyspark.sql import functions as F

from sparkmarts.llm.op13_html_extraction import (GROUP, KEY, aligned, article_paths, extract, folded, keys,
                                                 page_blocks, shape, slots)
from sparkmarts.llm.queries import op13_html_extraction
from tests.conftest import SF_SMALL

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor".split()


def sentence(draw, low=8, high=30):
    return " ".join(draw.choice(WORDS, int(draw.integers(low, high)))) + "."


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("id", "host", "shape", "text", "keep")})


def texts(df):
    out = df.collect()
    assert all(r.n_chars == len(r.text) for r in out)
    return sorted(((r.page_id, r.text) for r in out), key=repr)


def brackets(items):
    """The expression as text."""
    sign = lambda o, r: {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[bool(o), bool(r)]
    return " ".join((f"({brackets(i)})" if k == GROUP else k if k == "#" else f"{k}[{brackets(i)}]") + sign(o, r)
                    for k, o, r, i in items)


def of_page(page):
    return page_blocks(page)[0]


def test_repeats_and_options_become_groups():
    one = of_page("<div><h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p></div>")
    assert brackets(one) == "div[(h2[#] p[#]+)+]"
    other = of_page("<div><h1>t</h1><h2>a</h2><ul><li>x<li>y</ul><p>b</p></div>")
    assert brackets(other) == "div[h1[#] h2[#] ul[li[#]+] p[#]]"
    both = aligned(one, other, 1)
    assert brackets(both) == "div[h1[#]? (h2[#] ul[li[#]+]? p[#]+)+]"
    figures = dict(slots(both))
    assert figures["/div/h2/#"][0] == 2 and figures["/div/h1/#"][0] == 1
    same = aligned(of_page("<p>same</p>"), of_page("<p>same</p>"), 1)
    assert same[0][3][0][3][3] == same[0][3][0][3][4]


def test_wrapper_accepts_every_page_and_names_slots_once():
    draw = np.random.default_rng(0)
    tags = ["p", "h2", "ul", "div", "table", "blockquote"]

    def some(depth):
        out = []
        for tag in draw.choice(tags, int(draw.integers(1, 6))):
            inner = some(depth - 1) if depth and tag == "div" else sentence(draw, 1, 4)
            out.append(f"<{tag}>{f'<li>{inner}' if tag == 'ul' else inner}</{tag}>")
        return "".join(out)

    pages = [of_page(some(3)) for _ in range(60)]
    wrapper = pages[0]
    for page in pages[1:]:
        wrapper = aligned(wrapper, page, 1)
    names = [path for path, _ in slots(wrapper)]
    assert len(names) == len(set(names))
    for page in pages:
        assert {path for path, _ in slots(page)} <= set(names)

    def unique(items):
        found = [k for item in items for k in keys(item)]
        assert len(found) == len(set(found))
        for item in items:
            if item[KEY] != "#":
                unique(item[3])

    unique(wrapper)
    assert shape(folded(wrapper)) == shape(wrapper)


def landmarks(draw, n):
    """A page in the style of the test tables, and its article."""
    paragraphs = [sentence(draw) for _ in range(int(draw.integers(1, 7)))]
    title = sentence(draw, 3, 6)
    body = "".join(f"<p>{p.replace('sit', '<b>sit</b>')}" + "</p>" * int(draw.integers(0, 2)) for p in paragraphs)
    page = (f"<!DOCTYPE html><html><head><title>x{n}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
            f"<body class='has-sidebar'><header>Site {n}<h1>Logo</h1></header><nav><ul><li><a href=a>{n}</a></ul></nav>"
            f"<div class='cookie-notice'>We use {n} cookies</div><article><header><h1>{title}</h1></header>{body}"
            f"<aside>Also {n}</aside><form>Name <input></form><!-- ad <p>no</p> --></article>"
            f"<section id='comments'><article>First {n}!</article></section><footer>&copy; {n}")
    return page, " ".join([title, *paragraphs])


def soup(draw, n):
    """A page without landmarks or telling names."""
    paragraphs = [sentence(draw, 20, 40) for _ in range(int(draw.integers(2, 7)))]
    title = sentence(draw, 3, 6)
    links = "".join(f"<li><a href=x>{sentence(draw, 1, 3)}</a>" for _ in range(5))
    extra = "<blockquote>Quoted &amp; kept</blockquote>" if n % 3 == 0 else ""
    page = (f"<html><body><div id=top>Our shop sells things of all kinds</div><div class=w><div><ul>{links}</ul></div>"
            f"<div class=c><h1>{title}</h1><p>{'</p><p>'.join(paragraphs)}</p>{extra}</div></div>"
            "<div>Call us on working days</div></body></html>")
    return page, " ".join([title, *paragraphs, *(["Quoted & kept"] if extra else [])])


def main_element(draw, n):
    items = [sentence(draw, 3, 9) for _ in range(4)]
    page = (f"<body><div role=banner>Head {n}</div><main><h1>List {n}</h1><ul><li>{'<li>'.join(items)}</ul>"
            f"<ul class=x><li><a href=1>more of {n}</a><li><a href=2>and {n} more</a></ul>"
            "<p>a &lt; b &nbsp; c\n\t d<br>e</p></main><div role=contentinfo>Imprint</div>")
    return page, " ".join([f"List {n}", *items, "a < b c d e"])


def test_planted_layouts(spark):
    draw = np.random.default_rng(1)
    rows, want = [], []
    for host, layout in enumerate((landmarks, soup, main_element)):
        for n in range(40):
            page, text = layout(draw, n)
            rows.append((1000 * host + n, f"https://user@Host{host}.example.com:80/{n}?q=//x", page))
            want.append((1000 * host + n, text))
    for fan_in in (64, 3):
        assert texts(extract(frame(spark, rows), fan_in=fan_in)) == sorted(want, key=repr)


def test_odd_pages(spark):
    page, text = landmarks(np.random.default_rng(2), 1)
    deep = "<div>" * 3000 + "<p>deep text here</p>" + "</div>" * 3000
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    rows = [(1, "http://a/", None), (2, None, page), (3, "http://a/", ""), (4, "not a url", page), (4, "http://b/", page),
            (4, "http://b/", page), (None, "http://b/", page), (5, "http://c/", deep), (6, "http://d/", long),
            (7, "http://e/", "plain text, 1 < 2"), (8, "http://e/", "<nav>menu only</nav>"),
            (9, "http://f/", "<article><p>cut <b>off"), (10, "http://f/", "<p>no landmark</p><script>x"),
            (11, "http://g/", "<article>&#x41;&eacute;&notanentity; &amp;lt;</article><!-- open"),
            (12, "http://h/", "<p title='a>b' class=x>quoted</p><p don't>next</p>")]
    want = [(1, ""), (2, text), (3, ""), (4, text), (4, text), (4, text), (None, text), (5, "deep text here"),
            (6, " ".join(["word"] * 20000)), (7, "plain text, 1 < 2"), (8, ""), (9, "cut off"), (10, "no landmark"),
            (11, html.unescape("Aé&notanentity; &lt;").replace("<", "&lt;")), (12, "quoted next")]
    assert texts(extract(frame(spark, rows))) == sorted(want, key=repr)
    out = extract(frame(spark, rows).limit(0))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.collect() == []


def test_pages_that_are_all_copies_keep_their_text(spark):
    page = "<div><h1>Title</h1><p>The same words on every page of this host.</p></div>"
    got = texts(extract(frame(spark, [(i, "http://a/", page) for i in range(5)])))
    assert got == [(i, "Title The same words on every page of this host.") for i in range(5)]
    assert article_paths([]) == set()


def test_query_gives_the_article_elements(spark):
    want = []
    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        body = re.sub("<[^>]+>", "", re.sub("</?(p|h1|br)>", " ", body))
        want.append((r.page_id, " ".join(html.unescape(body).split())))
    assert texts(op13_html_extraction(spark, SF_SMALL)) == sorted(want, key=repr)
