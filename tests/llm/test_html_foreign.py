"""Drawings and formulas on hand-written pages."""

import pytest

from locusmill.llm import html_paths

FIRST = "The first paragraph of the article is long enough to count as text, and it says so in two clauses."
SECOND = "The second one has a small drawing in it, which must not take the rest of the page along with it."
THIRD = "A third paragraph closes the article; it stands behind the drawing, and so it is easily lost."


@pytest.mark.parametrize("drawing", [
    "<svg class=i/>", "<svg class='i' viewBox=\"0 0 1 1\"/>", "<SVG />", "<math/>", "<svg><path d='M0 0>1'/></svg>", "<svg data-x='a>b'/>",
    "<svg viewBox='0 0 9 9'><use href='#a'/><title>icon</title></svg>", "<math><mi>x</mi></math>",
])
def test_text_behind_a_drawing_stays(drawing):
    words = SECOND.split(" ")
    page = f"<html><body><article><p>{FIRST}</p><p>{' '.join(words[:9])} {drawing} {' '.join(words[9:])}</p><p>{THIRD}</p></article></body></html>"
    assert html_paths.main_text(page) == "\n".join([FIRST, SECOND, THIRD])
