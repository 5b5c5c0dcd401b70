import itertools
import random
import time

import numpy as np

from panelspark.llm import html_extract as h

SCHEMA = "page_id long, url string, html string, text string, n_chars int, w int"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-banner"><p>We use cookies to improve this site for you.</p></div>
<article><h1>The  title &amp;
 more</h1><p>First <b>bold</b> words &#x41;&#66; of a <a href="x">link</a> in the text.<br>next line<p>Second paragraph of the story, unclosed.
<ul><li>point one of the list<li>point two of the list</ul><div class="ad">Buy now</div></article>
<section class="comments"><div class="comment"><p>I liked it, thanks a lot for it.</p></div></section><footer>&copy; Site</footer></body></html>"""
TEXT = "The title & more\n\nFirst bold words AB of a link in the text. next line\n\nSecond paragraph of the story, unclosed.\n\npoint one of the list\n\npoint two of the list"


def model():
    rng = random.Random(4)
    w = [f"word{i}" for i in range(50)]
    return h.fit([h._labelled_page(rng, w) for _ in range(400)], rounds=600)


def brute_marginals(m, nodes):
    """Sums over all labellings."""
    unary = h.features(nodes) @ m.weights
    total, on = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(u for u, v in zip(unary, y, strict=True) if v)
        s += sum(m.edge[h._GROUP.get(nodes[v.parent].tag, 2)][y[v.parent], y[i]] for i, v in enumerate(nodes) if i)
        total += np.exp(s)
        on += np.exp(s) * np.array(y)
    return on / total


def test_messages_give_exact_marginals():
    m = h.Model(np.random.default_rng(1).normal(0, 0.5, h.N_FEATURES), np.random.default_rng(2).normal(0, 1, (3, 2, 2)))
    nodes, _ = h.parse("<html><body><div><p>a b c</p><ul><li>x<li>y</ul></div><p>z</p></body></html>")
    assert np.allclose(m.marginals(nodes), brute_marginals(m, nodes))


def test_pages(spark):
    m = model()
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "just text & no tags"), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "<div><p>unclosed <b"), (6, "u", "<article><p>" + "long words " * 100_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA)
    got = h.main_text(df, m).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["text"] == TEXT and by_id[2]["text"] == "" and by_id[None]["text"] == "" and by_id[2]["n_chars"] == 0
    assert by_id[6]["text"] == ("long words " * 100_000).strip()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert h.main_text(df.limit(0)).collect() == []


def test_accuracy_on_fresh_labelled_pages():
    m, rng, right = model(), random.Random(77), []
    for _ in range(100):
        nodes, y = h.labelled(h._labelled_page(rng, [f"other{i}" for i in range(90)]))
        own = np.array([v.own > 0 for v in nodes])
        right += list(((m.marginals(nodes) > 0.5) == y)[own])
    assert np.mean(right) > 0.97


def test_broken_markup_is_read_in_linear_time():
    m = model()
    assert "kept" in h.extract("<article><h1>A title here</h1><p title=it's>All of this is kept in the text.</p><p>And it's \"this\" kept too.</p></article>", m)
    assert "kept" in h.extract('<article><h1>A title here</h1><p title="open>One more line, lost or not.</p><p>Much of this is kept here.</p></article>', m)
    began = time.time()
    for page in ("<div>" * 50_000, "<li>" * 50_000, "</p>" * 50_000, "<p " * 50_000, "<ul><li>" * 20_000 + "x" + "</ul>" * 20_000, '<a href="' * 2_000, "<p><button>" + "<div>" * 50_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000):
        h.extract(page, m)
    assert time.time() - began < 60
