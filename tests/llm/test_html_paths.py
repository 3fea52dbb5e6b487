"""Article extraction on the given pages and on hand-made layouts."""

import html
import re

import pyarrow.parquet as pq
from text_cases import SF

from locusmill.llm import html_paths as hp


def plain(page):
    """The blocks of the one article element, as the given pages are laid out."""
    body = re.search(r"<article>(.*?)(</article>|<footer|\Z)", page, re.S)
    parts = re.split(r"</?(?:h1|p)>", body[1]) if body else []
    texts = [" ".join(html.unescape(re.sub(r"</?[a-z][^<>]*(>|\Z)", " " if "br" in p else "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages():
    table = pq.read_table(f"{SF.replace('0.001', '0.01')}/pages.parquet", columns=["html"])
    for page in table["html"].to_pylist():
        assert hp.main_text(page) == plain(page)


LONG = "This is a sentence of the story, and it goes on; nobody knows why. "


def page(body, head=""):
    return f"<!doctype html><html><head><title>Title</title>{head}</head><body>{body}</body></html>"


def test_no_article_element():
    links = "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(12))
    text = hp.main_text(page(
        f"<div><ul>{links}</ul></div><div><h1>Head line</h1><p>{LONG * 4}</p><p>{LONG * 3}<br>next</p><p>Short.</p>"
        f"<ul><li>{LONG}</li><li>{LONG}</li></ul></div><div><p><a href=x>About</a> <a href=y>Contact</a></p></div>"
    ))
    story = LONG.strip()
    assert text == "\n".join(["Head line", " ".join([story] * 4), " ".join([story] * 3) + " next", "Short.", story, story])


def test_boilerplate():
    text = hp.main_text(page(
        "<header><h1>Site</h1></header><nav>Menu</nav><div class='cookie-notice'>We use cookies. " + LONG * 9 + "</div>"
        f"<main><article><h2>Tom &amp; Jerry&nbsp;&#8211; part&#x20;2</h2><p>{LONG}</p><aside>{LONG * 9}</aside>"
        f"<div class='ad'>{LONG * 5}</div><script>if (a < b) document.write('<p>no</p>')</script><style>p > b {{}}</style>"
        f"<form><input><button>Go</button>{LONG}</form><p hidden>{LONG}</p><p>a<b>b</b>c <i>d</i>\n\t e</p>"
        f"<section id='comments'><p>{LONG * 9}</p></section></article></main><div id=sidebar>{LONG * 9}</div><footer>{LONG * 9}</footer>"
        "<!-- <p>hidden</p> -->"
    ))
    assert text == f"Tom & Jerry – part 2\n{LONG.strip()}\nabc d e"


def test_broken_markup():
    assert hp.main_text("<article><p><b>one<br><p>two &am") == "one\ntwo &am"
    assert hp.main_text("<article><p>one</p><p>two<a hre") == "one\ntwo"
    assert hp.main_text("<article><p>x <!-- never closed <p>y</p>") == "x"
    assert hp.main_text("just words, 1 < 2 and so on.") == "just words, 1 < 2 and so on."
    assert hp.main_text("<p>" * 3000 + "deep") == "deep"
    assert hp.main_text("<div>" * 3000 + "deep, text.") == "deep, text."
    for empty in (None, "", "   ", "<html></html>", "<script>x", "<nav>only</nav>", "<"):
        assert hp.main_text(empty) in ("", "<")


def test_query(spark):
    rows = [(1, "u", "<article><p>a  b</p></article>"), (2, None, None), (2, None, ""), (None, "v", "<p>é, x.</p>")]
    pages = spark.createDataFrame([(*r, "n", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = sorted((tuple(r) for r in hp.extract_pages(pages).collect()), key=str)
    assert out == sorted([(1, "u", "a b", 3), (2, None, "", 0), (2, None, "", 0), (None, "v", "é, x.", 5)], key=str)
    assert hp.extract_pages(pages.limit(0)).count() == 0
