"""The text of the given pages against labels by an independent rule: what stands inside of article, by the standard library's parser."""

from collections import Counter
from html.parser import HTMLParser

from panelspark.llm import html_extract as h

#: Parts of an article that are none of its text.
OUT = {"script", "style", "nav", "aside", "form", "footer", "header", "template", "head", "title", "noscript", "button", "select", "textarea", "iframe", "figure"}
CLASSES = ("ad", "ads", "comment", "comments", "cookie", "sidebar", "share", "related", "newsletter", "promo", "menu", "breadcrumb")
VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "source"}


class Labels(HTMLParser):
    """Words of a page, split by whether an article holds them outside of the parts above."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.inside, self.outside = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            names = dict(attrs).get("class") or ""
            self.open.append((tag, tag in OUT or any(c in CLASSES for c in names.lower().replace("-", " ").split())))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        article = any(t == "article" for t, _ in self.open)
        (self.inside if article and not any(out for _, out in self.open) else self.outside).append(data)


def test_precision_and_recall_on_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r["page_id"]: r["text"] for r in h.main_text(pages).collect()}
    both = wanted = found = n = 0
    for r in pages.select("page_id", "html").collect():
        p = Labels()
        p.feed(r["html"] or "")
        p.close()
        want = Counter(" ".join(p.inside).split())
        if want:
            have = Counter(got[r["page_id"]].split())
            both, wanted, found, n = both + (want & have).total(), wanted + want.total(), found + have.total(), n + 1
    print(f"{n} pages, {wanted} words: precision {both / found:.4f}, recall {both / wanted:.4f}")
    assert n >= 100 and both / found > 0.98 and both / wanted > 0.98
