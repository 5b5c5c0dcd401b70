import pytest

from panelspark.llm import html_extract as h
from tests.llm.helpers import words

UTILITY = "mx-auto px-4 py-2 flex items-center justify-between w-full max-w-3xl rounded-lg shadow-md bg-white dark:bg-black md:flex-row"


@pytest.fixture(scope="module")
def model():
    import random

    rng = random.Random(3)
    return h.fit([h._labelled_page(rng, words(i % 40, 300).split()) for i in range(400)])


def page(inside, before=""):
    text = words(1, 60)
    return f"<html><body>{before}<article><h1>Title here</h1><p>{text}</p>{inside}<p>{words(2, 60)}</p></article></body></html>"


def test_cue_words_behind_utility_classes(model):
    nodes, _ = h.parse(f"<div class='{UTILITY} sidebar'>x</div>")
    assert "sidebar" in nodes[1].cues
    out = h.extract(page("", f"<div class='{UTILITY} sidebar'><p>beside the article</p></div>"), model)
    assert "beside" not in out and "Title here" in out


def test_hidden_and_advert_inline_text_goes_and_its_line_stays_whole(model):
    inside = "<p>Before <span hidden>secretly <span>nested</span> more</span> between <a class='sponsored' href='#'>buy now</a> <b>bold</b> <small style='display:none'>unseen</small> after.</p>"
    out = h.extract(page(inside), model)
    assert "Before between bold after." in out
    assert not any(w in out for w in ("secretly", "nested", "more", "buy", "unseen"))


def test_unclosed_inline_nodes_end_with_their_block(model):
    out = h.extract(page("<p>one <span hidden>gone</p><p>two</span> three</p>"), model)
    assert "one" in out and "gone" not in out and "two three" in out
