"""HTML extraction with a tree-structured graphical model over the DOM.

Every element is a node that is content or not. A node's potential comes from
its tag, its attributes and its text by a learned logistic model; an edge's
potential says how likely a child is content given that its parent is. One
pass of messages from the leaves upward and one back downward (sum-product)
give exact marginals, in time proportional to the nodes. Text whose element is
likelier content than not is kept, in page order.

The model is fitted on labelled pages: pages made by rule around texts of the
input table, with menus, notices, adverts, forms, comments and articles in
many mark-up styles, where each element's label is known.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import short_batches

#: Pages of the input whose texts the labelled pages are made from, at most.
MAX_TRAINING = 400
SEED = 11

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea select title head".split())
NO_MARKUP = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Formulas, drawings and embedded media: what they say is text of the block around them.
FOREIGN = frozenset(
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mspace mpadded mphantom munder mover munderover mtable mtr mtd mlabeledtr merror menclose mmultiscripts mprescripts semantics annotation annotation-xml "
    "svg g text tspan textpath defs desc symbol use path rect circle line polyline polygon ellipse lineargradient radialgradient stop clippath mask filter foreignobject object canvas audio video".split()
)
INLINE = FOREIGN | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A block's start tag ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SCOPES = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table",)), "th": frozenset(("table",)), "option": frozenset(("select", "datalist"))}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|\s(hidden)\b""")
_CUE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    cues: list[str] = field(default_factory=list)
    hidden: bool = False
    #: Words of the element's own text, inline elements included; those within links.
    own: int = 0
    links: int = 0
    children: int = 0
    #: In a line of the block around it.
    inline: bool = False


def _attributes(name: str, raw: str) -> tuple[list[str], bool]:
    """The tag and the words of the names that an element goes by, and whether it is hidden."""
    cues, hidden = [name], False
    for key, value, bare in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role", "itemprop", "data-component", "data-testid", "aria-label"):
            cues += [w.lower() for w in _CUE.findall(value)]
        hidden |= bool(bare) or key == "aria-hidden" and value == "true" or key == "style" and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or key == "hidden"
    return cues, hidden


def _own_node(cues: list[str], hidden: bool) -> bool:
    """Whether an inline element is a node of its own: hidden, or named as something that is no content."""
    return hidden or any(_KIND.get(c) in _JUNK for c in cues[1:])


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, pieces): elements in page order, each after its parent, and pieces of text by node.

    Inline elements are part of the block around them, but those that are hidden
    or named as junk are nodes of their own in its lines. A piece of None ends a
    line of text. Nothing in the page is an error: unknown, unclosed and
    misplaced tags are read as browsers would, roughly.
    """
    nodes, pieces = [Node("#root", -1)], []
    stack = [0]  # open blocks
    #: Depths of the open elements of each tag, so that the nearest one is found without walking the stack.
    opened: defaultdict[str, list[int]] = defaultdict(list)
    in_link = 0
    #: Open inline elements by name, each with its depth, the block there and whether it is a node.
    inline: dict[str, list[tuple[int, int, bool]]] = {}
    at, n = 0, len(page)

    def say(raw: str) -> None:
        if raw:
            top = stack[-1]
            pieces.append((top, raw))
            if not raw.isspace():
                count = raw.count(" ") + 1
                nodes[top].own += count
                if in_link:
                    nodes[top].links += count

    def nearest(tags: Iterable[str]) -> int:
        """The depth of the innermost open element of these tags; 0 without any."""
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    def pop_to(depth: int) -> None:
        nonlocal in_link
        if len(stack) > depth:
            for i in stack[depth:]:
                opened[nodes[i].tag].pop()
            ends = any(not nodes[i].inline for i in stack[depth:])
            del stack[depth:]
            if ends:
                in_link = 0
                pieces.append((stack[-1], None))

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(html.unescape(page[at:]))
            break
        if m.start() > at:
            say(html.unescape(page[at : m.start()]))
        at = m.end()
        end, start = m.group(1), m.group(2)
        if end:
            name = end.lower()
            if name in INLINE:
                if name == "a" and in_link:
                    in_link -= 1
                own = inline.get(name, [])
                while own:
                    depth, block, is_node = own.pop()
                    if depth <= len(stack) and stack[depth - 1] == block:
                        if is_node:
                            pop_to(depth)
                        break
                continue
            if name == "br" or name == "p" and not opened["p"]:
                pieces.append((stack[-1], None))
                continue
            if opened[name]:
                pop_to(opened[name][-1])
            continue
        if not start:
            if m.group().startswith("<![CDATA["):
                say(m.group()[9:].removesuffix("]]>"))
            continue
        name = start.lower()
        if name in INLINE:
            in_link += name == "a" and "href" in m.group(3).lower()
            if name == "wbr" or name in FOREIGN and m.group().endswith("/>"):
                continue
            cues, hidden = _attributes(name, m.group(3)) if m.group(3) else ([name], False)
            is_node = _own_node(cues, hidden)
            inline.setdefault(name, []).append((len(stack), stack[-1], is_node))
            if is_node:
                nodes.append(Node(name, stack[-1], cues, hidden, inline=True))
                opened[name].append(len(stack))
                stack.append(len(nodes) - 1)
            continue
        if name in VOID:
            if name == "br":
                pieces.append((stack[-1], " "))
            elif name == "hr":
                pieces.append((stack[-1], None))
            continue
        if name == "body" and opened["body"]:
            continue
        if name in ENDS_P and opened["p"]:
            if nearest(("p",)) > nearest(("td", "th", "button", "table")):
                pop_to(nearest(("p",)))
        elif name in CLOSES and nearest(CLOSES[name]) > nearest(SCOPES[name]):
            pop_to(nearest(CLOSES[name]))
        if name in ("body", "main", "article", "nav", "div", "header", "footer") and nodes[stack[-1]].tag == "head":
            pop_to(len(stack) - 1)
        cues, hidden = _attributes(name, m.group(3))
        me = len(nodes)
        nodes[stack[-1]].children += 1
        nodes.append(Node(name, stack[-1], cues, hidden))
        pieces.append((stack[-1], None))
        if name in NO_MARKUP and not m.group().endswith("/>"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if not (m.group().endswith("/>") and name in RAW):
            opened[name].append(len(stack))
            stack.append(me)
            in_link = 0
    return nodes, pieces


# What names of classes, ids and roles tell, as cues of the potentials.
CUES = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs topnav subnav tabs toc pagination pager sitemap skip",
    "header": "header masthead banner branding logo topbar site",
    "footer": "footer foot copyright colophon contentinfo legal bottom",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more trending popular tags complementary",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe subscription signup paywall toast warning dialog privacy",
    "advert": "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner outbrain taboola dfp",
    "form": "form search searchbox login register input button btn share sharing social follow",
    "comment": "comment comments reply replies respond discussion disqus responses reader readers",
    "content": "article content main post entry story body text prose blog page paragraph markdown rich",
    "meta": "meta byline author date time published timestamp tagline caption",
}
_KIND = {w: k for k, ws in CUES.items() for w in ws.split()}
_TAGS = ["p", "div", "article", "section", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "h3", "h4", "table", "tr", "td", "th", "pre", "blockquote", "figure", "figcaption", "body", "button", "dl", "dt", "dd", "dialog", "fieldset", "tbody", "thead", "html", "#root"]
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
_KINDS = list(CUES)
_KIND_AT = {k: len(_TAGS) + i for i, k in enumerate(_KINDS)}
_STATS = len(_TAGS) + len(_KINDS)
N_FEATURES = _STATS + 14
#: Edges fall into groups by the parent: the page's frame, plain boxes, and the rest.
_GROUP = {"#root": 0, "html": 0, "body": 0, "div": 1, "section": 1, "td": 1}
_JUNK = tuple(k for k in CUES if k not in ("content", "meta"))
_NEVER = RAW | frozenset(("noscript", "button", "nav", "form", "dialog", "menu", "aside", "footer"))


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node: tag, cues, sizes and link density of itself and of its parent's tag."""
    x = np.zeros((len(nodes), N_FEATURES), dtype=np.float32)
    words = np.array([v.own for v in nodes], dtype=np.float64)
    links = np.array([v.links for v in nodes], dtype=np.float64)
    own = words.copy()
    for i in range(len(nodes) - 1, 0, -1):
        words[nodes[i].parent] += words[i]
        links[nodes[i].parent] += links[i]
    total = max(1.0, words[0])
    for i, v in enumerate(nodes):
        row = x[i]
        at = _TAG_AT.get(v.tag)
        if at is not None:
            row[at] = 1
        for c in v.cues[1:]:
            kind = _KIND.get(c)
            if kind:
                row[_KIND_AT[kind]] = 1
    density = links / np.maximum(words, 1)
    s = x[:, _STATS:]
    s[:, 0] = np.log1p(own) / 5
    s[:, 1] = np.log1p(words) / 7
    s[:, 2] = density
    s[:, 3] = words / total
    s[:, 4] = own == 0
    s[:, 5] = own < 8
    s[:, 6] = [v.hidden for v in nodes]
    s[:, 7] = [v.tag in _NEVER for v in nodes]
    s[:, 8] = np.arange(len(nodes)) / len(nodes)
    parents = np.array([max(0, v.parent) for v in nodes])
    s[:, 9] = density[parents]
    s[:, 10] = np.minimum([v.children for v in nodes], 10) / 10
    s[:, 11] = 1
    good = [v.tag in ("article", "main") or bool(x[i, _KIND_AT["content"]]) for i, v in enumerate(nodes)]
    poor = [v.tag in _NEVER or any(x[i, _KIND_AT[k]] for k in _JUNK) for i, v in enumerate(nodes)]
    for i in range(1, len(nodes)):  # of the ancestors
        p = nodes[i].parent
        s[i, 12] = good[p] or s[p, 12]
        s[i, 13] = poor[p] or s[p, 13]
    return x


@dataclass
class Model:
    """Weights of a node's log odds, and log potentials of (parent, child) states for each group of edges."""

    weights: np.ndarray
    edge: np.ndarray

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of each node by sum-product on the tree."""
        unary = features(nodes) @ self.weights
        parent = [v.parent for v in nodes]
        edges = np.exp(self.edge).reshape(-1, 4).tolist()
        edge = [edges[_GROUP.get(nodes[p].tag, 2)] for p in parent]
        odds = np.exp(np.clip(unary, -30, 30)).tolist()
        n = len(nodes)
        # up[i]: odds of content of the subtree under i; to[i]: the message to its parent, as the ratio content : not.
        up, to = odds[:], [1.0] * n
        for i in range(n - 1, 0, -1):
            o = up[i]
            e00, e01, e10, e11 = edge[i]
            to[i] = (e10 + e11 * o) / (e00 + e01 * o)
            p = parent[i]
            up[p] = min(max(up[p] * to[i], 1e-30), 1e30)
        out = up[:]
        for i in range(1, n):
            e00, e01, e10, e11 = edge[i]
            q = min(max(out[parent[i]] / to[i], 1e-30), 1e30)  # the parent's belief without this child
            out[i] = min(max(up[i] * (e01 + e11 * q) / (e00 + e10 * q), 1e-30), 1e30)
        o = np.array(out)
        return o / (1 + o)


def extract(page: str, model: Model) -> str:
    """The main text: kept blocks in page order, joined by an empty line."""
    if not page:
        return ""
    nodes, pieces = parse(page)
    keep = model.marginals(nodes) > 0.5
    dead = [v.tag in RAW or v.hidden for v in nodes]
    for i in range(1, len(nodes)):
        dead[i] |= dead[nodes[i].parent]
    block = list(range(len(nodes)))
    for i, v in enumerate(nodes):
        if v.inline:
            block[i] = block[v.parent]
    blocks, line, owner = [], [], -1
    for node, piece in pieces:
        if block[node] != owner or piece is None:
            if line:
                blocks.append("".join(line))
                line = []
            owner = block[node]
        if piece is not None and keep[node] and not dead[node]:
            line.append(piece)
    if line:
        blocks.append("".join(line))
    return "\n\n".join(b for b in (_SPACE.sub(" ", b).strip() for b in blocks) if b)


# --- labelled pages -------------------------------------------------------------------------------------------------

_MARK = "data-label"
_UTILITY = "mx-auto px-4 py-2 flex items-center justify-between w-full max-w-3xl rounded-lg shadow"


def _labelled_page(rng: random.Random, words: list[str]) -> str:
    """A page made by rule. Each element that settles a label carries it; the others inherit it."""
    def some(a: int, b: int) -> str:
        n, i = rng.randint(a, b), rng.randrange(max(1, len(words)))
        return html.escape(" ".join((words * 2)[i : i + n]) or "text")

    def tag(name: str, label: int, inside: str, cues: str = "") -> str:
        if cues and rng.random() < 0.2:
            cues = f"{_UTILITY} {cues}"
        named = f' {rng.choice(("class", "class", "id"))}="{cues}"' if cues else ""
        return f'<{name}{named} {_MARK}="{label}">{inside}</{name}>'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{some(1, 3)}</a></li>' for i in range(n))

    pick = lambda kind: rng.choice(CUES[kind].split())
    junk = {
        "menu": lambda: tag(rng.choice(("nav", "div", "ul")), 0, f"<ul>{links(rng.randint(3, 9))}</ul>", pick("menu")) if rng.random() < 0.7 else tag("nav", 0, f"<ul>{links(rng.randint(3, 8))}</ul>"),
        "header": lambda: tag("header", 0, rng.choice((f"<a href='/'>{some(1, 3)}</a><p>{some(2, 10)}</p>", f"<h1>{some(1, 3)}</h1>", f"<a href='/'>{some(1, 3)}</a>")), rng.choice(("", pick("header")))),
        "footer": lambda: tag("footer", 0, f"&copy; {some(3, 16)}") if rng.random() < 0.5 else tag("div", 0, f"<p>&copy; {some(3, 20)}</p>", pick("footer")),
        "side": lambda: tag(rng.choice(("aside", "div", "section")), 0, f"<h3>{some(1, 4)}</h3><ul>{links(rng.randint(2, 6))}</ul><p>{some(4, 30)}</p>", pick("side")),
        "notice": lambda: tag(rng.choice(("div", "section", "dialog")), 0, f"<p>{some(6, 30)}</p><button>{some(1, 2)}</button>", pick("notice")),
        "advert": lambda: tag(rng.choice(("div", "aside", "section")), 0, rng.choice((some(1, 25), f"<p>{some(1, 25)}</p>", f"<a href='#'>{some(1, 20)}</a>")), pick("advert")),
        "form": lambda: tag("form", 0, f"<label>{some(1, 5)}</label><input name='q'><button>{some(1, 2)}</button>", rng.choice(("", pick("form")))) if rng.random() < 0.6 else tag("div", 0, f"<span>{some(1, 4)}</span><a href='#'>{some(1, 2)}</a>", pick("form")),
        "comment": lambda: tag(rng.choice(("section", "div", "ol")), 0, "".join(tag("div", 0, f"<p>{some(3, 60)}</p>", rng.choice(("", pick("comment")))) for _ in range(rng.randint(1, 4))), pick("comment")),
    }

    def content() -> str:
        title = f"<h1>{some(1, 10)}</h1>"
        out = [f"<header>{title}</header>" if rng.random() < 0.25 else title]
        for _ in range(rng.randint(1, 12)):
            k = rng.random()
            if k < 0.62:
                out.append(f"<p>{some(1, 120)}</p>")
            elif k < 0.68:
                out.append(f"<p>{some(3, 60)} {tag(rng.choice(('span', 'a', 'small')), 0, some(1, 12), pick(rng.choice(('advert', 'form', 'notice', 'side'))))} {some(3, 60)}</p>")
            elif k < 0.74:
                out.append(f"<p><b>{some(2, 40)}<br><p>{some(3, 60)}</p>")
            elif k < 0.80:
                out.append(f"<h2>{some(1, 8)}</h2>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li>{some(2, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif k < 0.90:
                out.append(f"<blockquote><p>{some(4, 40)}</p></blockquote>")
            elif k < 0.94:
                out.append("<table><tr>" + "".join(f"<td>{some(1, 6)}</td>" for _ in range(4)) + "</tr></table>")
            elif k < 0.97:
                out.append(f"<pre>{some(3, 30)}</pre>")
            else:
                out.append(f"<div>{some(5, 60)}</div>")
            if rng.random() < 0.35:
                out.append(junk[rng.choice(("advert", "advert", "form", "side", "notice", "comment", "menu"))]())
        return "".join(out)

    frame = rng.random()
    main = tag("article", 1, content(), rng.choice(("", "", pick("content")))) if frame < 0.55 else tag("main", 1, content(), rng.choice(("", pick("content")))) if frame < 0.7 else tag(rng.choice(("div", "section")), 1, content(), pick("content"))
    if rng.random() < 0.3:
        main = f"<div {_MARK}='1'>{main}</div>"
    before = [junk[k]() for k in rng.sample(["menu", "header", "notice", "advert", "form", "side"], rng.randint(1, 4))]
    after = [junk[k]() for k in rng.sample(["footer", "comment", "side", "advert", "notice", "menu"], rng.randint(1, 4))]
    return f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title><style>p{{}}</style></head><body {_MARK}='1'>{''.join(before)}{main}{''.join(after)}</body></html>"


_LABEL = re.compile(rf"""\s{_MARK}=["']([01])["']""")


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a page made by :func:`_labelled_page` and their labels, the nearest marked element's."""
    marks: list[int | None] = []
    for m in _TOKEN.finditer(page):
        name = (m.group(2) or "").lower()
        if name and name not in VOID and (name not in INLINE or _own_node(*_attributes(name, m.group(3)))):
            found = _LABEL.search(m.group(3))
            marks.append(int(found[1]) if found else None)
    nodes, _ = parse(_LABEL.sub("", page))
    y = np.zeros(len(nodes))
    y[0] = 1
    for i, mark in enumerate(marks[: len(nodes) - 1], 1):
        y[i] = mark if mark is not None else 0 if nodes[i].tag in RAW or nodes[i].tag == "button" else y[nodes[i].parent]
    return nodes, y


def fit(pages: list[str], rounds: int = 1_000, rate: float = 0.5, l2: float = 1e-4, coupling: float = 1.0) -> Model:
    """Potentials from labelled pages.

    Node potentials are a logistic model of a node's own label. Edge potentials
    are the pointwise information of (parent, child) states, scaled by
    ``coupling`` since nodes and edges see some of the same evidence.
    """
    xs, ys, counts = [], [], np.ones((3, 2, 2))
    for page in pages:
        nodes, y = labelled(page)
        xs.append(features(nodes))
        ys.append(y)
        parents = np.array([v.parent for v in nodes[1:]], dtype=int)
        groups = np.array([_GROUP.get(nodes[p].tag, 2) for p in parents], dtype=int)
        np.add.at(counts, (groups, y[parents].astype(int), y[1:].astype(int)), 1)
    joint = counts / counts.sum(axis=(1, 2), keepdims=True)
    edge = coupling * np.log(joint / (joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)))
    x, y = np.concatenate(xs), np.concatenate(ys)
    w, v = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for _ in range(rounds):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(y) + l2 * w
        v = 0.9 * v + g
        w -= rate * v
    return Model(w, edge)


def train(pages: DataFrame, most: int = MAX_TRAINING, seed: int = SEED) -> Model:
    """A model fitted on labelled pages made from words of at most ``most`` pages of the table.

    Those with the smallest hashes of their ids are taken; ids are picked
    first, so that no page travels that isn't used.
    """
    words = F.expr("slice(regexp_extract_all(regexp_replace(coalesce(html, ''), '<[^>]*>', ' '), '[^ \\t\\n\\r<>&]+', 0), 1, 400)")
    few = pages.select("page_id").dropna().distinct().orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id").limit(most)
    rows = pages.select("page_id", words.alias("w")).join(F.broadcast(few), "page_id").groupBy("page_id").agg(F.min("w").alias("w")).orderBy("page_id").collect()
    rng = random.Random(seed)
    texts = [list(r["w"]) or ["text"] for r in rows] or [["some", "words", "of", "text"]]
    return fit([_labelled_page(rng, texts[i % len(texts)]) for i in range(800)])


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): a row for each row of pages, repeated ones too.

    pages has page_id, url and html; other columns are ignored. A null or empty
    html gives an empty text; a null page_id or url stays null. Without a model
    one is trained first. An empty table gives an empty result.
    """
    model = train(pages) if model is None else model

    @F.pandas_udf("string")
    def text(htmls: pd.Series) -> pd.Series:
        return pd.Series([extract(h, model) for h in htmls])

    short_batches(pages.sparkSession)
    out = pages.select("page_id", "url", text(F.coalesce("html", F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
