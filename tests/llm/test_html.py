import math
import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomline.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="ad">Buy now and buy a lot of it today, friends</div><div id="cookie-notice">We use cookies</div>
<aside>Side text that is long enough to look like an article, if it were one</aside>
<article><h1>Title &amp; more</h1><p>First   paragraph\n of a <b>text</b> that goes on for a while, with words.<br><p>Short.</p>
<p>R&eacute;sum&#233; &lt;tag&gt; &amp;&amp;&amp; and so on, at some length, to the end of it.</p><form><p>Your mail</p></form></article>
<div class="comments"><p>I like this a lot, said a reader at great length indeed.</p></div><footer>&copy; all</footer></body></html>"""
TEXT = "Title & more\nFirst paragraph of a text that goes on for a while, with words.\nShort.\nRésumé <tag> &&& and so on, at some length, to the end of it."


def test_main_text():
    assert H.main_text(PAGE) == TEXT


@pytest.mark.parametrize("html", [None, "", "<", "<![CDATA[x", "<![foo[ x ]]>", "<html><nav>a</nav></html>", "<script>never closed", "&#xD800;" * 3, "</p></div>", "<p" * 500])
def test_broken_pages_do_not_crash(html):
    assert isinstance(H.main_text(html), str)


def test_plain_fragments():
    assert H.main_text("just some text &amp; more") == "just some text & more"
    assert H.main_text("<p>one</p><p>two</p>") == "one\ntwo"
    assert H.main_text("<html><nav>a</nav><footer>b</footer></html>") == ""


def test_page_without_article_element():
    long = "A sentence with quite some words in it, so that it is content. " * 3
    page = f"<body><div><a href=x>Home</a></div><div><a>One</a></div><div><h2>Head</h2><p>{long}</p><p>Yes.</p><p>{long}</p></div><div><a>Imprint</a></div></body>"
    assert H.main_text(page) == "\n".join(["Head", long.strip(), "Yes.", long.strip()])


def test_very_long_page():
    assert len(H.main_text("<article>" + "<p>word word</p>" * 50_000 + "</article>").split("\n")) == 50_000


def test_table(spark):
    rows = [(1, "u", PAGE, 1, "x"), (1, "u", PAGE, 1, "x"), (None, None, None, None, None), (2, "v", "", 2, "y")]
    got = sorted(map(tuple, H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")).collect()), key=repr)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert H.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_smoothing_and_clusters():
    assert H.smooth([4.0]) == [4.0]
    assert H.threshold([1.0, 1.0, 9.0, 9.0]) == 5.0
    assert H.threshold([3.0, 3.0]) == 3.0


def paragraphs(sizes):
    return [(f"para{i} " + "some words of text " * n)[:n].strip() for i, n in enumerate(sizes)]


@pytest.mark.parametrize("sizes", [[300, 320, 310, 60, 40], [40, 60, 300, 320, 310], [120, 150, 140, 2000, 1800, 130, 120]])
def test_short_first_and_last_paragraphs_stay(sizes):
    text = paragraphs(sizes)
    inner = "<h1>Head</h1>" + "".join(f"<p>{t}</p>" for t in text)
    menu, end = "<div><a href=x>Home</a></div>", "<div><a href=y>Imprint</a></div>"
    for page in (f"<body>{menu}<div>{inner}</div>{end}</body>", f"<body>{menu}{inner}{end}</body>", inner):
        assert H.main_text(page) == "\n".join(["Head", *text])


@pytest.mark.parametrize("sizes", [[1500, 400, 300], [900, 40], [400, 1500, 60]])
def test_blocks_beside_the_longest_stay(sizes):
    text = paragraphs(sizes)
    blocks = "".join(f"<div><p>{t}</p></div>" for t in text)
    assert H.main_text(f"<body><div><a href=x>Home</a></div><div>{blocks}</div><div><a href=y>Imprint</a></div></body>") == "\n".join(text)


def test_links_inside_the_text_stay():
    text = paragraphs([300, 30, 310])
    assert H.main_text(f"<body><div><p>{text[0]}</p><p><a href=x>{text[1]}</a></p><p>{text[2]}</p><p><a href=y>The end</a></p></div></body>") == "\n".join([*text, "The end"])


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "with-ads page", "comments-open", "share-enabled", "skip-lazy", "sidebar", "ad-wrapper"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "{}"])
def test_wrappers_with_marks(name, inner):
    text = "".join(f"<p>Paragraph {i} of the text, which is long enough to be one.</p>" for i in range(8))
    page = f'<body><div class="{name}">{inner.format(text)}</div><div class="site-footer">Imprint and more</div></body>'
    assert H.main_text(page).count("Paragraph") == 8 and "Imprint" not in H.main_text(page)


def test_marks_inside():
    page = '<article><p>One <span class="ad">Buy</span>two.</p><div class="comment-list"><p>' + "Nice! " * 90 + "</p></div><p>Three <math><mi>x</mi></math>.</p></article>"
    assert H.main_text(page) == "One two.\nThree x."


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 50])
@pytest.mark.parametrize("letters", [1, 7, 57, 58, 333])
def test_equal_lines(n, letters):
    page = "<body>" + f"<p>{'x' * letters}</p>" * n + "</body>"
    assert H.main_text(page) == "\n".join(["x" * letters] * n)


@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=40))
def test_smooth_and_threshold(values):
    got = H.smooth(values)
    for i in range(len(values)):
        w = {j: math.exp(-((i - j) ** 2) / 2) for j in range(len(values)) if abs(i - j) <= 3}
        assert got[i] == pytest.approx(sum(values[j] * x for j, x in w.items()) / sum(w.values()))
    assert any(v >= H.threshold(got) for v in got)


LONG = "A sentence with quite some words in it, so that it is content. " * 3


def test_article_in_a_form_around_the_page():
    page = f'<body><form id="aspnetForm"><div class="menu"><a href=x>One</a></div><div><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div class="footer">All rights</div></form></body>'
    assert H.main_text(page) == "\n".join(["Head", LONG.strip(), "Yes.", LONG.strip()])
    inner = f"<body><form><nav>a</nav><article><p>{LONG}</p><form><label>Mail</label></form></article></form></body>"
    assert H.main_text(inner) == LONG.strip()


def test_names_that_only_hold_a_marking_word():
    page = (
        f'<body><article><p>{LONG}</p><div class="ad-free-content"><p>{LONG}</p><p>Short.</p></div><section class="related-work"><h2>Work</h2><p>{LONG}</p></section>'
        f'<div class="ad-box"><p>{LONG}</p></div><div class="related-reading"><a href=a>One</a> <a href=b>Two</a></div><div class="newsletter-signup"><p>{LONG}</p></div></article></body>'
    )
    assert H.main_text(page) == "\n".join([LONG.strip(), LONG.strip(), "Short.", "Work", LONG.strip()])
    whole = f'<article><h1>Head</h1><div class="banner promo"><p>{LONG}</p><p>{LONG}</p></div><div class="comments"><p>{LONG * 9}</p></div></article>'
    assert H.main_text(whole) == "\n".join(["Head", LONG.strip(), LONG.strip()])  # the most of an article is no advert, but comments may be the most


@pytest.mark.parametrize(
    "page",
    ["<div>t" * 200_000, "<span>t" * 100_000, "<b><div>" + "<span>" * 20_000 + "</b>x" * 20_000, "<div>" + "<span>" * 20_000 + "<p>a</p>" * 20_000, '<div class="ad">t' * 50_000, "<div>" * 20_000 + "</i>x" * 20_000, "<article>t" * 50_000],
    ids=["divs", "spans", "inline ends", "paragraphs", "marks", "unmatched ends", "articles"],
)
def test_deep_markup_is_linear(page):
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 40  # seconds where it was hours


def plain_region(lines, parents, least):
    """The region by its definition: of all containers, walked up from each line, the deepest chain that holds most of the high text."""
    held = {}
    for size, at, high in lines:
        while high and at >= 0:
            held[at] = held.get(at, 0) + size
            at = parents[at]
    whole, region = sum(s for s, _, h in lines if h), -1
    while deeper := [k for k, p in enumerate(parents) if p == region and held.get(k, 0) >= least * whole and held.get(k, 0)]:
        region = deeper[0]
    return region


def test_region_against_its_definition():
    rng = random.Random(8)
    for _ in range(60):
        html, names = [], 0
        for _ in range(rng.randrange(2, 9)):  # paragraphs of different sizes in nested containers
            depth = rng.randrange(1, 4)
            html.append("<div>" * depth + "".join(f"<p>n{(names := names + 1)} " + "word " * rng.choice((3, 60)) + "</p>" for _ in range(rng.randrange(1, 4))) + "</div>" * depth)
        page = H._Page()
        lines = page.lines("<body>" + "".join(html) + "</body>")
        ratios = H.smooth([len(t) / max(1, n) for t, n, *_ in lines])
        least = H.threshold(ratios)
        region = plain_region([(len(x[0]), x[2], r >= least) for x, r in zip(lines, ratios, strict=True)], [p for p, _ in page.parents], H.MOST)
        inside = set()
        for k in range(len(page.parents)):
            at = k
            while at >= 0 and at != region:
                at = page.parents[at][0]
            if at == region:
                inside.add(k)
        text = H.main_text("<body>" + "".join(html) + "</body>").split("\n")
        assert {x[0] for x in lines if x[2] in inside or region < 0} <= set(text)  # and the region grows over unmarked text around it
