"""Main texts of pages: the given template by regular expressions, other layouts by hand, broken markup by what must survive."""

import html
import random
import re

import pytest
from foliant.llm import html_extract as H
from hypothesis import given, settings
from hypothesis import strategies as st

STORY = "A first paragraph, long enough to be told from the rest; it has marks, and words.", "The second paragraph goes on: it says more, and ends.", "Short."
JUNK = """<div class="cookie-notice">We use cookies, as everybody does; accept them all.</div><aside><p>Read on, there is more, much more, elsewhere.</p></aside>
<form action="/s"><p>Your mail, please, and your name, too.</p><input name=q></form><div class="ad-slot"><p>Buy this, now, it is cheap, really.</p></div>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I, for one, disagree, entirely, with all of it. Truly, I do; believe me, everybody, I do.</p></article></section>"""


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Site, the, title.</title>{head}</head><body>{body}</body></html>"


def paragraphs(parts=STORY, tag="p"):
    return "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in parts)


NAV = "<nav><ul>" + "".join(f'<li><a href="/{k}">Section, number {k}</a></li>' for k in range(8)) + "</ul></nav>"
FOOT = "<footer><p>&copy; 2024, all rights reserved, of course.</p></footer>"


@pytest.mark.parametrize("body", [
    f"{NAV}<article><h1>Title</h1>{paragraphs()}</article>{JUNK}{FOOT}",
    f"<header><h1>Site</h1></header>{NAV}<main><h1>Title</h1>{paragraphs()}{JUNK}</main>{FOOT}",
    f"<div id=top class='site-header'>The site, of sites.</div>{NAV}<div class='page'><div class=content><h1>Title</h1>{paragraphs()}</div><div class=sidebar>{paragraphs(('Other, things, here.',) * 3)}</div></div>{JUNK}{FOOT}",
    f"{NAV}<div><h1>Title</h1>{paragraphs(tag='div')}</div><div><ul>" + "".join(f'<li><a href="{k}">Another story, number {k}</a></li>' for k in range(12)) + f"</ul></div>{FOOT}",
    f"{NAV}<article class='post with-sidebar'><header class='entry-header'><h1>Title</h1><p>By Nobody</p></header>{paragraphs()}<footer>Tags: a, b</footer></article>{FOOT}",
    f"{NAV}<table><tr><td><a href=1>One</a> <a href=2>Two</a><td><h1>Title</h1>{paragraphs()}</table>{FOOT}",
    f"<NAV><A HREF='x'>X</A></NAV><DIV ROLE='main'><H1>Title{paragraphs()}</DIV><div role=contentinfo>Imprint.</div>".replace("Title<p>", "Title</H1><p>"),
])
def test_articles_of_many_layouts(body):
    assert H.article(page(body)) == ["Title", *STORY]


def test_characters_space_and_markup():
    body = "<article><p>a &amp; b &lt;p&gt; &eacute;&#8364;\n\t c&nbsp;d<!-- no <p> --></p><p>x<br>y<b>z<p>bold <i>goes</i> on<script>var t='</p><p>no</p>';</script>.</p><ul><li>one<li>two</ul><pre>  k\n  v</pre></article>"
    assert H.article(page(body)) == ["a & b <p> é€ c d", "x yz", "bold goes on.", "one", "two", "k v"]


def test_hidden_parts_and_inline_adverts():
    body = '<article><p>Seen, <span class="ad">Buy!</span>and read. <button>Press</button></p><p hidden>a</p><p style="display: none">b</p><div aria-hidden="true">c</div><p title="x > y">last</p></article>'
    assert H.article(page(body)) == ["Seen, and read.", "last"]


@pytest.mark.parametrize("text", [None, "", " \n", "<", "<p", "<!--", "<script>never closed", "</p></div>", page(""), page(NAV + FOOT), "&"])
def test_pages_without_an_article(text):
    assert H.article(text) in ([], ["<"], ["&"], ["<p"])


def test_plain_text_is_its_own_article():
    assert H.article("no tags, at all.\nnone") == ["no tags, at all. none"]


def test_long_and_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    deep = "<div><b><i>" * 20_000 + "<p>Words, at the bottom, of it.</p>"
    assert "Words, at the bottom, of it." in H.article(deep)
    odd = "<a href=\"x " * 20_000 + "a < b " * 20_000
    H.article(odd)
    long = page("<article>" + paragraphs(STORY * 8000) + "</article>")
    assert len(H.article(long)) == 24_000
    assert time.perf_counter() - began < 30


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab p=\"'&;!-\n.", max_size=120))
def test_no_markup_breaks_it(text):
    assert all(x == " ".join(x.split()) and x for x in H.article(text))


def test_scores_of_paths_from_their_definition():
    nodes = [H.Node(("a",), (), "x, y.", 0), H.Node(("b",), (), "linked text", 11), H.Node(("a",), (), "zz", 0)]
    w = H.SMOOTHING
    text = [(5 + 2) / 2, 0.0, (5 + 2) / 2]
    marks = [1.0, 0.0, 1.0]

    def smooth(v, k):
        near = [(w[abs(d)], v[k + d]) for d in (-2, -1, 0, 1, 2) if 0 <= k + d < 3]
        return sum(a * b for a, b in near) / sum(a for a, _ in near)

    got = H.score(nodes)
    for path, own in ((("a",), (0, 2)), (("b",), (1,))):
        length, mark = (sum(smooth(v, k) for k in own) / len(own) for v in (text, marks))
        assert abs(got[path] - length * (1 + mark)) < 1e-9


def expected(text):
    inner = re.search(r"<article>(.*?)</article>", text or "", re.S)
    blocks = re.split(r"<p>|</p>|<h1>|</h1>", re.sub(r"</?b>|<br>", " ", inner[1])) if inner else []
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_query_over_the_given_pages(spark):
    from foliant.llm import queries
    from oracle import SF

    got = queries.QUERIES["op12_html_extract"](spark, SF).collect()
    given_pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(given_pages)
    assert all(r.text == expected(given_pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == given_pages[r.page_id].url for r in got)


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    rows = [(None, None, None, 1), (1, "u", page("<article><p>x.</p></article>"), 2), (1, "u", page("<article><p>x.</p></article>"), 2), (2, "", "", 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    assert sorted(map(tuple, H.extract(df).collect()), key=repr) == sorted([(None, None, "", 0), (1, "u", "x.", 2), (1, "u", "x.", 2), (2, "", "", 0)], key=repr)
    assert H.extract(df.limit(0)).count() == 0
    rng = random.Random(1)
    assert all(H.article(page("<article>" + paragraphs(rng.sample(STORY, 2)) + "</article>")) for _ in range(5))
