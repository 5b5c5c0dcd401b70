from panelspark.llm import html_extract as h
from tests.llm.test_html_whole import model, page  # noqa: F401


def test_formulas_and_embedded_text_stay_in_their_lines(model):  # noqa: F811
    inside = "<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds.</p><p>See <svg><path d='M0 0'/><text>drawn words</text></svg> and <object data='x'>fallback words</object>.</p>"
    out = h.extract(page(inside + "<script>var gone</script><style>gone</style>"), model)
    assert "Energy E=mc2 holds." in out and "See drawn words and fallback words." in out and "gone" not in out


def test_formulas_of_junk_go_with_it(model):  # noqa: F811
    out = h.extract(page("", "<nav><ul><li><a href='/'><svg><text>picture</text></svg></a></li><li><a href='/b'>Other</a></li></ul></nav>"), model)
    assert "picture" not in out
