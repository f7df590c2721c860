"""Main-text extraction on the tables' pages, on other layouts, and on awkward input."""

import html
import re

import pytest

from millrace.llm import queries
from millrace.llm.html_text import clusters, extract, main_text, smoothed

SF = "/root/testdata/sf0.01"
LONG = ["A first paragraph that is long enough to be told from the menus around it, with a comma.", "Short.", "Another long paragraph & its <b>bold</b> word, a <a href='/x'>link</a> and   white\n space; nothing else."]
TEXT = "A first paragraph that is long enough to be told from the menus around it, with a comma.\nShort.\nAnother long paragraph & its bold word, a link and white space; nothing else."
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(12)) + "</ul>"


def test_query_gives_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op2_html_text(spark, SF).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        blocks = re.split(r"</?p>|</?h1>", re.search(r"<article>(.*)</article>", page, re.S)[1])
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        want = "\n".join(t for t in texts if t)
        assert (got[i].text, got[i].n_chars) == (want, len(want))


BODY = "".join(f"<p>{x}</p>" for x in LONG)
LAYOUTS = {
    "article": f"<nav>{MENU}</nav><article>{BODY}</article><footer>&copy; all rights reserved by someone or other</footer>",
    "main": f"<header><h1>Site</h1>{MENU}</header><main>{BODY}</main><aside><p>Read this other long text that is advertised here.</p></aside>",
    "divs": f"<div id=menu>{MENU}</div><div class='content'>{BODY}</div><div class='sidebar-left'><p>Some long words that stand in a side bar of the page.</p></div>",
    "nameless": f"<div>{MENU}</div><div>{BODY}</div><div>{MENU}</div>",
    "notice": f"<div class='cookie-notice'><p>We use cookies to give you the best experience, and more words.</p></div><article>{BODY}</article>",
    "advert": f"<article><p>{LONG[0]}</p><div class='ad'>Buy this thing now, it is a very good one.</div><p>Short.</p><p>{LONG[2]}</p></article>",
    "comments": f"<article>{BODY}<section class='comments'><article class='comment'><p>I do not agree with this long article at all.</p></article></section></article>",
    "form": f"<article>{BODY}<form><label>Your name</label><input><textarea>text</textarea><button>Send the form</button></form></article>",
    "script": f"<script>var a = '</p><p>not text but code that is long enough';</script><style>p {{ margin: 0 }}</style><article>{BODY}<noscript>Turn on scripts</noscript></article>",
    "unclosed": f"<nav>{MENU}</nav><article><p>{LONG[0]}<p>{LONG[1]}<p>{LONG[2]}</article><footer>The end of the page, with some words",
    "references": f"<!-- c --><article><p>A first paragraph that is long enough to be told from the menus around it&#44; with a comma.</p><p>Sh&#111;rt&period;</p><p>{LONG[2].replace('&', '&amp;')}</p></article>",
    "role": f"<div role=navigation>{MENU}</div><div role=banner>Welcome to this site of ours</div><section>{BODY}</section>",
}


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("frame", ["<!DOCTYPE html><html><head><title>Not this</title></head><body>{}</body></html>", "{}"])
def test_layouts(name, frame):
    assert main_text(frame.format(LAYOUTS[name])).text == TEXT


@pytest.mark.parametrize("name", ["related-work", "widget", "entry social-science", "story hidden-gems", "comment-on-law"])
def test_an_element_with_most_of_the_text_is_not_judged_by_its_name(name):
    assert main_text(f"<html><body><div>{MENU}</div><div class='{name}'>{BODY}</div><div>{MENU}</div></body></html>").text == TEXT
    aside = f"<html><body><article>{BODY}</article><div class='{name}'><p>{'Words of a reader or of a notice. ' * 40}</p></div></body></html>"
    assert main_text(aside).text == TEXT


def test_the_ratios_choose_the_region():
    """With other ratios the text is another one."""
    import numpy as np

    page = f"<html><body><div>{MENU}</div><div>{BODY}</div><div>{MENU}</div></body></html>"
    turned = main_text(page, lambda lines: np.array([100.0 * (x.link_chars == len(x.text)) for x in lines]))
    assert main_text(page).text == TEXT
    assert turned.text != TEXT and "Item 3" in turned.text


def test_a_deep_menu_goes():
    deep = "<div>" * 800 + "<nav><p>A menu that stands very deep in the page, with many words in it.</p></nav>" + BODY + "</div>" * 800
    assert main_text(deep).text == TEXT


PARTS = [
    ("<p>{}</p>", "In brief."),
    *(("<p>{}</p>", f"Long paragraph number {i} with enough words in it to stand out from what is around it, and more.") for i in range(5)),
    ("<p><a href='/a'>{}</a></p>", "A paragraph that is one link"),
    ("<ul><li>{}</li></ul>", "An item"),
    ("<pre>{}</pre>", "x = 1"),
    ("<table><tr><td>{}</td></tr></table>", "A cell"),
    *(("<p>{}</p>", x) for x in ("One.", "Two.", "Three.")),
    *(("<ol><li><a href='/r'>{}</a></li></ol>", f"Reference {i}") for i in range(3)),
]


@pytest.mark.parametrize("parts", [PARTS, PARTS[1:6] + PARTS[-6:-3], PARTS[:6] + PARTS[-3:]])
def test_a_region_without_article_element_gives_all_its_lines(parts):
    body = "".join(frame.format(text) for frame, text in parts)
    page = f"<html><body><div>{MENU}</div><div>{body}</div><div class='footer'>All rights reserved</div></body></html>"
    assert main_text(page).text == "\n".join(text for _, text in parts)


AWKWARD = ["", " \n", "<![foo bar]>x", "<!DOCTYPE [<!ELEMENT", "<?php echo ?>hi", "</", '<a b="', "&#xFFFFFFFFFF;&#0;&am", "<script>abc", "plain text", "<>", "<title>t", "<!--" * 50_000, "<" * 100_000, "<div>a " * 20_000, "<p>a " * 20_000, "w " * 500_000]


def test_awkward_pages(spark):
    rows = [(1, None, None, 1), (None, "u", "<p>text</p>", 2), (None, "u", "<p>text</p>", 2)] + [(i, "u", x, 3) for i, x in enumerate(AWKWARD)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows)
    assert [(r.page_id, r.text, r.n_chars) for r in got if r.page_id is None] == [(None, "text", 4)] * 2
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_smoothing_and_clusters():
    import numpy as np

    assert np.allclose(smoothed(np.full(9, 3.0)), 3)
    spread = smoothed(np.array([0.0] * 10 + [10.0] + [0.0] * 10))
    assert spread.argmax() == 10 and np.allclose(spread, spread[::-1]) and spread[9] > spread[8] > 0
    assert clusters(np.array([True, True, False, True])) == [(0, 2), (3, 4)]
