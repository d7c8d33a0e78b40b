"""Main text of pages: hand-made templates with a known article, and a plain reading of the test pages."""

from __future__ import annotations

import html
import re
import time

import pytest

from geoledger.llm import queries
from geoledger.llm.common import table
from geoledger.llm.main_text import extracted, main_text

from ..conftest import SF

LONG = "The harbour was quiet, the boats had left, and nobody on the pier knew when they would come back to the town."
OTHER = "By noon the wind had turned, clouds came over the hills, and the first of the boats could be seen again from the tower."
ARTICLE = ["A quiet day", LONG, "Short one.", OTHER, "End."]
BODY = f"<p>{LONG}</p><p>Short one.</p><p>{OTHER}<p>End."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us, our team</a></li></ul>'
CHATTER = "I was there too, and I must say, the weather was nothing like that, not even close, my friends, believe me or not."

PAGES = {
    "semantic": f"<nav>{MENU}</nav><header><h1>Site name</h1></header><main><article><h1>A quiet day</h1>{BODY}</article></main><aside><p>{CHATTER}</p></aside><footer>c, d, e</footer>",
    "article with its own header": f"<header>Site</header><article><header><h1>A quiet day</h1></header>{BODY}<section class='comments'><p>{CHATTER}</p></section></article>",
    "blog": f"<div id=page><div id='site-header'><a href=/>Site</a></div><div class='main-nav'>{MENU}</div><div class='post'><h1 class='entry-title'>A quiet day</h1>"
            f"<div class='entry-content'>{BODY}</div><div class='sharedaddy share-buttons'>Share this, please, now</div></div>"
            f"<div id='comments' class='comments-area'><ol><li class='comment'><p>{CHATTER}</p></li></ol><div id='respond'><form><p>Leave a reply, be kind</p></form></div></div>"
            f"<div class='widget-area sidebar'><p>{CHATTER}</p></div><div id='footer'><p>Imprint, contact, legal</p></div></div>",
    "tables": f"<table><tr><td class=menu>{MENU}</td><td><h1>A quiet day</h1>{BODY}</td></tr></table>",
    "unnamed menus": f"<div>{MENU}</div><div><h1>A quiet day</h1>{BODY}</div><div><a href=/x>More, more</a> <a href=/y>Still more, and more of that</a></div>",
    "title outside": f"<div><h1>A quiet day</h1><div><div>{BODY}</div></div></div><div class='cookie-consent'><p>{CHATTER}</p></div>",
    "lists of links inside": f"<article><h1>A quiet day</h1>{BODY}</p><div>{MENU}</div></article>",
    "comment articles": f"<article class=story><h1>A quiet day</h1>{BODY}</article><div id=disqus_thread><article class=comment-body><p>{CHATTER} {CHATTER}</p></article></div>",
    "notice and adverts": f"<div role=alert><p>{CHATTER}</p></div><article><h1>A quiet day</h1><div class='ad-slot'>Buy, buy, buy</div>{BODY}<div class='newsletter-signup'><p>{CHATTER}</p></div></article>",
    "hidden": f"<body><div style='display: none'><p>{CHATTER}</p></div><div hidden><p>{CHATTER}</p></div><article><h1>A quiet day</h1>{BODY}</article>",
    "form around all": f"<form action=/><div><h1>A quiet day</h1><main>{BODY}</main></div></form><form class=x><p>{CHATTER}</p></form>",
    "scripts": f"<script>if (a<b) document.write('<p>{CHATTER}</p>')</script><style>p{{}}</style><article><h1>A quiet day</h1><!-- <p>{CHATTER}</p> -->{BODY}</article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    assert main_text(f"<!DOCTYPE html><html><head><title>A quiet day</title></head><body>{PAGES[name]}</body></html>").split("\n") == ARTICLE


def test_text_is_kept_as_it_reads():
    assert main_text("<article><p>a&nbsp;&amp; b\n\t<b>bo</b>ld &#233;&eacute; &lt;p&gt; 1 < 2<br>next<br><br>apart<p title='>'>more</article>") == "a & b bold éé <p> 1 < 2 next\napart\nmore"
    assert main_text("only text, no markup") == "only text, no markup"
    assert main_text("<div>one<p>two</p>three</div>") == "one\ntwo\nthree"
    assert [main_text(s) for s in ("", None, "<", "<p", "<!-- x", "<script>x", "<nav>x</nav>", "</p></div>")] == ["", "", "<", "", "", "", "", ""]


def test_long_and_odd_pages_end():
    start = time.time()
    assert main_text("<div>" * 50_000 + "deep") == "deep"
    assert main_text("<p>x" * 50_000).count("\n") == 49_999
    for odd in ("<!--" * 50_000, "<a href='" * 50_000, "<" * 200_000, "<script>" * 50_000, "<b>" * 20_000 + "</i>" * 20_000):
        main_text(odd)
    assert time.time() - start < 30


def read_plainly(source: str) -> str:
    """Article of a test page: they name it, so no scoring is needed."""
    article = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:h1|p)>|<br>", article)]
    return "\n".join(b for b in blocks if b)


def test_query_over_whole_table(spark):
    got = {r["page_id"]: r for r in queries.QUERIES["op11_tree_scoring"](spark, SF).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    for page in pages:
        expected = read_plainly(page["html"])
        assert (got[page["page_id"]]["text"], got[page["page_id"]]["n_chars"], got[page["page_id"]]["url"]) == (expected, len(expected), page["url"])


def test_frames(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 2), (3, "<p>a", "x", 3), (3, "<p>a", "x", 3), (None, "<p>ä", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    assert sorted(map(str, ((r["page_id"], r["text"], r["n_chars"]) for r in extracted(pages).collect()))) == sorted(
        map(str, [(1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1), (None, "ä", 1)])
    )
    assert extracted(pages.limit(0)).collect() == []
