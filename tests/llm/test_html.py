"""Main text of pages: templates, broken markup, and the given pages by their known template."""

import html
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pytest

from movewatch.llm import html_text, queries

ARTICLE = "A storm crossed the coast, late at night. Roofs were torn off; trees fell, and roads were closed.", "Nobody was hurt."
BODY = f"<h1>Storm</h1><p>{ARTICLE[0]}</p>\n<p>{ARTICLE[1]}</p>"
TEXT = f"Storm\n\n{ARTICLE[0]}\n\n{ARTICLE[1]}"
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News of the day</a></li><li><a href="/s">Sports</a></li></ul>'


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{NAV}</nav><article>{BODY}</article><footer>&copy; us</footer></body></html>",
    f"<body><header><h1>The Site</h1>{NAV}</header><main>{BODY}<aside>Read also, please: more storms.</aside></main></body>",
    f'<div class="menu">{NAV}</div><div id="content">{BODY}</div><div class="sidebar"><p>Popular, today: cats, dogs.</p></div>',
    f'<div id="wrap" class="with-sidebar"><div>{NAV}</div><div class="post">{BODY}</div><div id="comments"><p>First, really! I saw it, too.</p></div></div>',
    f"<body>{NAV}<section><div>{BODY}</div></section><form><p>Your name, please.</p><input name=x></form><script>if (a<b) '<p>no</p>'</script></body>",
    f'<article>{BODY}<div class="ad">Buy now, pay later.</div><p class="notice">We use cookies, of course.</p></article>',
    f'<article><header>{BODY[:14]}</header>{BODY[14:]}<section class="comment-list"><p>Me too, me too.</p></section></article>',
    f'<article>{BODY}<p hidden>x</p><p style="display: none">y</p><div aria-hidden="true">z</div></article>',
    f"<!-- <article><p>old</p></article> --><article>{BODY}</article><!-- open",
    f"<ARTICLE>{BODY.replace('</p>', '')}",
    f'<article title="a > b" data-x=\'"\'>{BODY}</article>',
    f"<article>{BODY.replace('storm', '<b>st<i>orm').replace('late', '<a href=x>late</a>')}",
    f"<div><p>{ARTICLE[0]}</p></div>".join(["<article><h1>Storm</h1>", f"<p>{ARTICLE[1]}</p></article>"]),
    f"<article>{BODY}</article><p",
    f"<article>{BODY}</article><p class=\"unclosed",
])
def test_templates(page):
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<p></p><div> &nbsp; </div>", ""), ("<nav>only</nav>", ""), ("plain text", "plain text"),
    ("a < b &amp;&lt; c", "a < b &< c"), ("<article>one&nbsp;two\n\tthree</article>", "one two three"), ("<p>&#233;&eacute;&#xe9;", "ééé"),
    ("<article><p>line<br>break</p>tail<ul><li>i<li>j</ul></article>", "line break\n\ntail\n\ni\n\nj"), ("</div></p>text</b>", "text"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\n\nb\n\nc"), ("<!DOCTYPE html>", ""), ("<", ""), ("x<", "x"), ("x</", "x"),
])
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "<p>Deep, indeed.</p>"
    assert html_text.main_text(deep) == "Deep, indeed."
    many = "<article>" + "<p>One, two.</p>" * 20000
    assert html_text.main_text(many).count("\n\n") == 19999


def test_query_on_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = queries.QUERIES["op10_main_text"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id]
        start = page.find("<article>")
        end = page.find("</article>")
        parts = re.split("</?(?:p|h1)>", page[start : end if end >= 0 else len(page)])
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_edge_tables(spark):
    rows = [(1, "u", None, "t", 5), (1, "u", None, "t", 5), (None, None, "<p>é, ü.</p>", None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert sorted(((r.page_id, r.text, r.n_chars) for r in got.collect()), key=repr) == [(1, "", 0), (1, "", 0), (None, "é, ü.", 5)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def template(seed):
    """A page of div elements only, and its article's blocks: menu, article, links, advert and comments in a random order of classes."""
    rnd = random.Random(seed)

    def sentence():
        return " ".join(rnd.choice("storm coast night roof tree road town river bridge".split()) for _ in range(rnd.randrange(8, 25))) + rnd.choice(".!?;") + " So it was, again."
    own = rnd.choice(["post category-social", "entry tag-legal", "c1", "story related-tag", "x-7"])
    wrap = rnd.choice(["with-sidebar", "page", "container nav-open"])
    paragraphs = [sentence() for _ in range(rnd.randrange(3, 9))]
    links = "".join(f'<div class="l"><a href="/{i}">{rnd.choice(["Home", "News of today", "Sports", "Contact us now"])}</a></div>' for i in range(rnd.randrange(3, 12)))
    article = f'<div class="{own}"><h2>{"Storm over town"}</h2>' + "".join(f'<p>{p}</p>' for p in paragraphs) + "</div>"
    advert = f'<div class="{rnd.choice(["ad", "promo-box", "z9"])}"><span>Buy now</span></div>'
    comments = f'<div id="comments"><div class="reply">{sentence()}</div></div>' if rnd.random() < 0.5 else ""
    parts = [f'<div class="m">{links}</div>', advert, article, comments + f'<div class="b"><a href="/">Imprint</a></div>']
    return f'<!--><body><div class="{wrap}">' + rnd.choice(["", "<!-- x -->"]).join(parts) + "</div></body>", "\n\n".join(["Storm over town", *paragraphs])


def test_ratios_decide(monkeypatch):
    pages = [template(i) for i in range(120)]
    assert [html_text.main_text(p) for p, _ in pages] == [t for _, t in pages]
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "ratios", lambda found: rng.uniform(0, 9, len(found)))
    assert sum(html_text.main_text(p) != t for p, t in pages) > 100


def test_ratios_are_those_of_plain_paths():
    for seed in range(20):
        found = html_text.blocks(template(seed)[0])
        fused = {}
        for path in {b.path for b in found}:
            own = [b for b in found if b.path == path]
            length = sum(len(b.text[0]) for b in own)
            marks = sum(c in ".,;:!?" for b in own for c in b.text[0])
            linked = sum(min(b.linked, len(b.text[0])) for b in own)
            fused[path] = math.sqrt(length / len(own) * (1 + marks / len(own))), max(1 - linked / length, 0.05) * sum(b.weight for b in own) / len(own)
        row = [fused[b.path][0] for b in found]
        near, far = 1 / (1 + 2 * math.exp(-0.5)), math.exp(-0.5) / (1 + 2 * math.exp(-0.5))
        want = [(near * r + far * (row[max(i - 1, 0)] + row[min(i + 1, len(row) - 1)])) * fused[b.path][1] for i, (r, b) in enumerate(zip(row, found))]
        assert html_text.ratios(found) == pytest.approx(want)
        # a path is the chain of tags from the root: one label a step
        assert len({b.path for b in found if b.text[0].endswith("again.")}) <= 2


@pytest.mark.parametrize("page", [
    f'<article class="post type-post category-social">{BODY}</article>',
    f'<div class="post category-legal"><div>{BODY}</div></div><p>Imprint</p>',
    f'<div id="widget-area" class="site promo-theme">{BODY}</div>',
    f"<!--><div>{BODY}</div>", f"<!---><div>{BODY}</div><!-- x --!>",
])
def test_names_never_drop_the_article(page):
    assert html_text.main_text(page).startswith(TEXT)


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "<p>Deep, indeed.</p>",
    "<b>" * 50_000 + "Deep, indeed." + "</i>" * 50_000,
    '<div class="x-promo">' * 50_000 + "Deep, indeed.",
    "<div>" * 30_000 + "Deep, indeed." + "</div>" * 30_000 + "<ul><li>" * 20_000,
])
def test_deep_pages_in_bounded_memory_and_time(page):
    tracemalloc.start()
    began = time.monotonic()
    assert html_text.main_text(page) == "Deep, indeed."
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and time.monotonic() - began < 60
