"""Main text of pages against what was put into them."""

import html
import os
import random
import time

import pytest

from impressa.llm import queries
from impressa.llm.maintext import extract, main_text

WORDS = "alpha beta gamma delta é ß < & > \" ' one two three".split()
BESIDE = [
    "<nav><ul><li><a href='/a'>a</a><li><a href='/b'>b</a></ul></nav>", '<header class="x"><h1>Site name</h1><p>{}</p></header>', "<aside><h2>More</h2><p>{}</p></aside>", '<div class="ad"><p>{}</p><div>{}</div></div>',
    '<div id="cookie-notice">{}</div>', "<form action='/s'><label>{}</label><input name=q></form>", "<script>var a = '<p>{}</p>' < 3;</script>", "<style>p > a {{ }} /* {} */</style>", "<!-- <p>{}</p> -->",
    '<section class="comments"><h3>Comments</h3><article class="comment"><p>{}</p></article><p>{}</p></section>', '<ul class="menu"><li><a href=#>{}</a></li></ul>', '<div role="alert">{}</div>', '<div style="display: none">{}</div>',
]


def sentence(r, n):
    return " ".join(r.choices(WORDS, k=n))


def page(r, wrap):
    """(page, its article)"""
    paragraphs = [sentence(r, r.choice([1, 2, 30, 60, 90])) for _ in range(r.randrange(3, 9))]
    paragraphs[1] = sentence(r, 70)

    def beside(given=BESIDE):
        return "".join(x.format(*(html.escape(sentence(r, r.choice([2, 40]))) for _ in range(3))) for x in r.sample(given, 4))

    body = ""
    for k, p in enumerate(paragraphs):
        text = html.escape(p).replace(" ", r.choice([" ", "\n ", "&#32;\t"]), 2)
        body += (f"<h1>{text}</h1>" if k == 0 else r.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"])) + (beside([x for x in BESIDE if "header" not in x]) if r.random() < 0.3 else "")
    head = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>T &amp; t</title></head><body class="with-sidebar">'
    return head + beside() + wrap.format(body) + beside() + "<footer>&copy; someone</footer></body></html>", "\n".join(paragraphs)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div class='x'>{}</div></main>", "<div class='ad-layout'><main><article>{}</article></main></div>", '<div id="content">{}</div>'])
def test_the_article_comes_back(wrap):
    r = random.Random(wrap)
    for _ in range(60):
        given, want = page(r, wrap)
        assert extract(given) == want


def test_pages_without_marks():
    body = "<div><a>1</a></div><p>Menu</p><h2>Head</h2><p>" + "word " * 30 + "</p><p>short</p><p>" + "more " * 30 + "</p><p>tail</p>"
    assert extract(f"<body>{body}</body>") == "\n".join(["Head", ("word " * 30).strip(), "short", ("more " * 30).strip()])
    assert extract("<p>a<p>b") == "a\nb" and extract("1 < 2 & 3 &amp; 4") == "1 < 2 & 3 & 4" and extract("<div>x<!-- y") == "x"
    assert extract("a<br>b<br><br>c &nbsp; d<wbr>e") == "a b\nc de" and extract("<script>x") == extract("<nav>x</nav>") == extract("") == extract(None) == ""
    links = "".join(f"<li><a href={k}>name {k}</a></li>" for k in range(5))
    assert extract(f"<article><p>One.</p><ul>{links}</ul><p>Two <a>link</a>.</p><p><a>Source</a></p></article>") == "One.\nTwo link.\nSource"


@pytest.mark.parametrize("evil", ["<a ", '<a "', "<div class=x>", "<", "<p>x", "<!--", "<script", "<span class=ad>", "<article>", "<li><a>x</a>"])
def test_long_malformed_pages_take_linear_time(evil):
    began = time.time()
    extract(evil * 30_000)
    extract("<div>" * 20_000 + evil * 1000 + "</section></div>" * 20_000)
    assert time.time() - began < 20


def test_frame(spark):
    rows = [(1, "u", "<p>a &amp; b"), (1, "u", "<p>a &amp; b"), (None, None, None), (3, "v", ""), (4, "w", "<article>" + "<p>long text</p>" * 50_000 + "</article>")]
    pages = spark.createDataFrame([(*x, "t", 7) for x in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a & b"), (1, "u", "a & b"), (None, None, ""), (3, "v", ""), (4, "w", "\n".join(["long text"] * 50_000))], key=str)
    assert main_text(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    for x in queries.QUERIES["op11_html_extraction"](spark, "/root/testdata/sf0.001").collect():
        assert x.n_chars == len(x.text) > 0
