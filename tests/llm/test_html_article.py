"""Path ratios decide on pages with an article or main element as well."""

import pytest
from test_html_paths import LONG, page

from locusmill.llm import html_paths as hp

STORY = LONG.strip()


@pytest.mark.parametrize("name", ["article", "main"])
def test_thread_inside_article(name):
    thread = "".join(f"<li><div>user{i} says ok</div></li>" for i in range(12))
    text = hp.main_text(page(
        f"<{name}><h1>Head</h1>" + f"<p>{LONG * 3}</p>" * 5 + f"<p>Short.</p><p>{LONG * 3}</p><div class='x7'><ul>{thread}</ul></div></{name}>"
    ))
    assert text.split("\n") == ["Head"] + [" ".join([STORY] * 3)] * 5 + ["Short.", " ".join([STORY] * 3)]


def test_text_outside_article():
    text = hp.main_text(page(f"<div><article><p>{LONG * 3}</p></article>" + f"<p>{LONG * 2}</p>" * 4 + "</div>"))
    assert text.split("\n") == [" ".join([STORY] * 3)] + [" ".join([STORY] * 2)] * 4


PROSE = f"<p>{LONG * 3}</p>"


@pytest.mark.parametrize("name", ["article", "main", "div"])
def test_parts_between_paragraphs_stay(name):
    parts = (
        "<ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>1</td></tr></table><pre>x = 1</pre>"
        "<p><a href='/long'>A link that is most of its paragraph</a> here.</p><figure><figcaption>Cap</figcaption></figure>"
    )
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Story {i}</a></li>" for i in range(5)) + "</ul>"
    text = hp.main_text(page(f"<{name}>{PROSE}{parts}{menu}{PROSE}</{name}>")).split("\n")
    own = " ".join([STORY] * 3)
    assert text == [own, "one", "two", "a 1", "x = 1", "A link that is most of its paragraph here.", "Cap", own]


def test_parts_at_the_end_of_an_article_stay():
    text = hp.main_text(page(f"<article><p>Lead.</p>{PROSE * 4}<ul><li>one</li></ul><pre>x</pre></article>")).split("\n")
    assert text[0] == "Lead." and text[-2:] == ["one", "x"] and len(text) == 7


def test_names_that_may_mean_boilerplate():
    """An article's own part with such a name stays by its ratio; a notice, a comment thread and an advert go."""
    own = " ".join([STORY] * 3)
    inside = (
        f"{PROSE}<div class='legal-history'>{PROSE}</div><div class='form-of-verse'>{PROSE}</div><h2 class='header'>Part</h2>{PROSE}"
        f"<div class='notice-box'><p>Prices may change.</p></div><div class='ad-slot'><p>Buy now!</p></div><div class='notice'>{PROSE}</div>"
        f"<div class='comments-list'>{PROSE}</div><div class='ad'>{PROSE}</div>{PROSE}"
    )
    assert hp.main_text(page(f"<article>{inside}</article>")).split("\n") == [own] * 3 + ["Part", own, own]
    outside = hp.main_text(page(f"<div class='legal-notes'>{PROSE}</div><article>{PROSE * 3}</article>"))
    assert outside.split("\n") == [own] * 3
    only = hp.main_text(page(f"<article><div class='legal-text'>{PROSE * 3}</div></article>"))
    assert only.split("\n") == [own] * 3
