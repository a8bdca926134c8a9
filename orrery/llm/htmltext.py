"""Main text of web pages: flat blocks with word count and link density of themselves and their neighbours, classified by a
decision tree that is trained here on a small labelled table.

Where a page says what its parts are (elements, names), the tree follows that; where it doesn't, counts and neighbours decide.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orrery.llm.common import add_columns

#: Elements by what they do to blocks (fixed values).
SILENT = frozenset("script style noscript template svg math iframe object canvas head title textarea select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Containers that stay open until they are closed; others are closed by what follows them.
CONTAINER = frozenset("article aside body dialog div fieldset footer form header main menu nav section button label".split())
#: Containers, and words of class, id and role, that mark what isn't the article (fixed values).
ASIDE = frozenset("nav header footer aside form menu dialog fieldset button label".split())
MARKS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead "
    "cookie cookies consent notice alert popup modal overlay subscribe newsletter signup login social share sharing related recommended comment comments disqus reply replies "
    "widget toolbar pagination pager tags copyright legal disclaimer search".split()
)
#: Words that may stand beside a mark in a compound name (site-header); any other word makes it another name (no-sidebar, tag-social).
BESIDE = frozenset("site page main top bottom left right list area box bar container wrapper wrap block section inner global primary secondary links items posts form".split())
#: Marks of lists that may be made of articles themselves.
LISTS = frozenset("comment comments disqus reply replies related recommended nav navbar navigation menu".split())
#: Silent elements that hold text up to their end tag or the end of the page; others without an end tag hide nothing.
RAW = frozenset("script style title textarea iframe".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    linked: int
    words: int
    in_article: bool
    heading: bool
    #: Within an element that isn't the article (nav, footer), a list of links or comments by its name, and another mark by its name.
    landmark: bool = False
    listed: bool = False
    marked: bool = False
    #: The container that it stands in, by number.
    container: int = 0


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order: what stands between tags of block elements, white space made one space, references decoded."""
    out: list[Block] = []
    #: of all containers: name, article, if the name and what marks make it an aside, the one around it; and the open ones
    opened: list[tuple[str, bool, list, int]] = [("", False, [False, set()], 0)]
    stack = [0]
    inside: list[int] = []
    firsts = {"article", "main"}
    endless: set[str] = set()
    text: list[str] = []
    links = 0
    linked: list[str] = []
    heading = False

    def close() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                top = opened[stack[-1]]
                in_link = len(html.unescape(" ".join(linked)).split())
                n = len(joined.split())
                out.append(Block(joined, min(in_link, n), n, top[1], heading))
                inside.append(stack[-1])
            text, linked = [], []

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            if links:
                linked.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
            if links:
                linked.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        closing, name = m[1], m[2].lower()
        if name in SILENT:
            if not closing and not (name in ("svg", "math") and m[0].endswith("/>")):
                end = None if name in endless else re.compile(rf"</{name}\s*>" if name != "head" else r"</head\s*>|(?=<body\b)", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in RAW:
                    at = len(page)
                else:
                    endless.add(name)
                text.append(" ")
            continue
        if name == "a":
            links = max(0, links - 1) if closing else 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCK or name in CONTAINER:
            close()
            links = 0
            if name in CONTAINER:
                if closing:
                    k = next((i for i in range(len(stack) - 1, 0, -1) if opened[stack[i]][0] == name), 0)
                    if k:
                        del stack[k:]
                    heading = False
                else:
                    marks = _marks(m[3])
                    top = opened[stack[-1]]
                    article = top[1] or name in ("article", "main")
                    marks = set() if name == "body" else marks - {"header", "masthead"} if top[1] else marks
                    opened.append((name, article, [name in ASIDE and not (name == "header" and top[1]), marks], stack[-1]))
                    stack.append(len(opened) - 1)
                    if name in firsts:
                        # what holds the page's first article is no aside by its marks, unless they name a list; nor is a form around it
                        firsts.discard(name)
                        for c in (opened[k] for k in stack):
                            c[2][1] = c[2][1] if c[2][1] & LISTS else set()
                            c[2][0] = c[2][0] and c[0] != "form"
                    heading = False
            elif closing:
                heading = False
            else:
                heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
    close()
    within = [(False, False, False)]
    for _, _, (landmark, marks), around in opened[1:]:
        own = landmark, bool(marks & LISTS), bool(marks - LISTS)
        within.append(tuple(x or y for x, y in zip(own, within[around], strict=True)))
    for b, k in zip(out, inside, strict=True):
        b.landmark, b.listed, b.marked = within[k]
        b.container = k
    return out


def _marks(attributes: str) -> set[str]:
    """The marks among whole names of class, id and role, or in compound names of marks and words beside them."""
    marks: set[str] = set()
    for _, *value in _ATTRIBUTE.findall(attributes or ""):
        for token in "".join(value).lower().split():
            parts = set(_PART.findall(token))
            if parts <= MARKS | BESIDE:
                marks |= parts & MARKS
    return marks


#: The columns of the labelled table and of the tree.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "heading", "landmark", "listed", "marked")

#: Those that elements and names alone tell.
NAMED = ("landmark", "listed", "marked")


def features(found: list[Block]) -> np.ndarray:
    """One row for each block: word counts (to 200) and link densities of it and its neighbours, and where it stands. Neighbours are the
    blocks before and after it in the same container; where there is none, they have no words."""
    n = len(found)
    inside = np.array([-1, *[b.container for b in found], -2])
    w = np.array([0, *[min(b.words, 200) for b in found], 0], dtype=float)
    d = np.array([0, *[b.linked / b.words for b in found], 0], dtype=float)
    before, after = inside[:-2] == inside[1:-1], inside[2:] == inside[1:-1]
    where = np.array([[b.in_article, b.heading, b.landmark, b.listed, b.marked] for b in found], dtype=float).reshape(n, 5)
    return np.column_stack([w[1:-1], d[1:-1], w[:-2] * before, d[:-2] * before, w[2:] * after, d[2:] * after, where])


#: What the words of the labelled pages begin with: the article's, and all others.
MAIN, REST = "m", "x"


def labelled_pages(n: int = 2000, seed: int = 3) -> list[str]:
    """The small labelled table, as pages of made-up words: those of the article begin with MAIN, all others with REST.

    Layouts are drawn anew for each page: articles in an article or main element or in plain containers; menus, adverts, notices and
    footers with a name, with an element, or with neither, so that only counts tell them apart.
    """
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]


def _words(start: str, n: int) -> str:
    return " ".join([f"{start}y"] * n)


#: Words in a part that an element or a name gives away, however long it is.
SIZES = (2, 4, 8, 15, 30, 60, 120, 200)


def _prose(rng: random.Random) -> str:
    n = rng.choice(SIZES)
    return _words(REST, n) + (f" <a href=/l>{_words(REST, rng.randint(1, 4))}</a>" if rng.random() < 0.4 else "")


def _links(rng: random.Random, n: int, most: int = 3) -> str:
    return "".join(f"<li><a href=/{i}>{_words(REST, rng.randint(1, most))}</a></li>" for i in range(n))


def _row(rng: random.Random) -> str:
    return " ".join(f"<a href=/{i}>{_words(REST, rng.randint(1, 4))}</a>" for i in range(rng.randint(5, 30)))


def _before(rng: random.Random, plain: bool) -> str:
    """A part that stands before the article; `plain` ones have neither an element nor a name that says so."""
    kind = rng.choice(["menu", "banner", "advert", "notice"])
    if kind == "menu":
        body = f"<ul>{_links(rng, rng.randint(3, 9))}</ul>"
        if plain and rng.random() < 0.5:  # many links in a row
            body = f"<p>{_row(rng)}</p>"
        return f"<div>{body}</div>" if plain else rng.choice([f"<nav>{body}</nav>", f'<div class="main-menu">{body}</div>', f"<header>{body}</header>"])
    name = {"banner": "site-header", "advert": rng.choice(["ad", "sponsored", "promo"]), "notice": rng.choice(["cookie-notice", "alert", "newsletter"])}[kind]
    if plain:
        return f"<div><p>{_words(REST, rng.randint(1, 9))}</p></div>"
    prose = "".join(f"<p>{_prose(rng)}</p>" for _ in range(rng.choice([1, 1, 2, 3])))
    return rng.choice([f'<div class="{name}">{_prose(rng)}</div>', f'<div class="{name}">{prose}</div>', f"<header>{prose}</header>", f"<aside>{prose}</aside>"])


def _after(rng: random.Random, plain: bool) -> str:
    """A part that stands after the article."""
    kind = rng.choice(["foot", "related", "comments", "form"])
    if kind == "comments":  # nothing but a name tells readers' prose from the author's
        return f'<div id="comments"><h3>{_words(REST, 2)}</h3>' + "".join(f"<p>{_prose(rng)}</p>" for _ in range(rng.randint(1, 4))) + "</div>"
    if kind == "related":
        body = f"<h4>{_words(REST, 2)}</h4>" + (f"<p>{_row(rng)}</p>" if plain and rng.random() < 0.5 else f"<ul>{_links(rng, rng.randint(2, 6), 9)}</ul>")
        return f"<div>{body}</div>" if plain else rng.choice([f"<aside>{body}<p>{_prose(rng)}</p></aside>", f'<div class="related">{body}</div>', f'<div id="sidebar">{body}<p>{_prose(rng)}</p><p>{_prose(rng)}</p></div>'])
    if kind == "form":
        body = f"<p>{_words(REST, rng.randint(2, 12)) if plain else _prose(rng)}</p>"
        return f"<div>{body}</div>" if plain else f"<form>{body}<label>{_words(REST, 2)}</label><button>{_words(REST, 1)}</button></form>"
    body = f"<p>{_words(REST, rng.randint(2, 10)) if plain else _prose(rng)}</p>" + (f"<p><a href=/t>{_words(REST, 3)}</a> <a href=/p>{_words(REST, 1)}</a></p>" if rng.random() < 0.6 else "")
    if not plain:
        body += "".join(f"<p>{_prose(rng)}</p>" for _ in range(rng.choice([0, 0, 1, 2])))
    return f"<div>{body}</div>" if plain else rng.choice([f"<footer>{body}</footer>", f'<div class="footer">{body}</div>'])


def _unnamed_story(rng: random.Random) -> list[str]:
    """An article in a plain container: long paragraphs, many short ones, one alone, a preformatted block or bare text."""
    kind = rng.choice(["long", "long", "short", "single", "pre", "bare"])
    if kind == "pre":
        return [f"<pre>{_words(MAIN, rng.choice([30, 60, 120, 300]))}</pre>"]
    if kind == "bare":
        return ["<br><br>".join(_words(MAIN, rng.choice([15, 30, 60, 120])) for _ in range(rng.randint(2, 5)))]
    if kind == "single":
        return [f"<p>{_words(MAIN, rng.choice([30, 60, 120, 200]))}</p>" for _ in range(rng.randint(1, 2))]
    if kind == "short":
        return [f"<p>{_linked(rng, rng.randint(5, 22))}</p>" for _ in range(rng.randint(3, 20))]
    lengths = [rng.choice([22, 30, 45, 60, 90, 120, 200]) for _ in range(rng.randint(3, 8))]
    if len(lengths) > 3 and rng.random() < 0.4:
        lengths[rng.randint(1, len(lengths) - 2)] = rng.randint(4, 12)
    return [f"<p>{_linked(rng, k)}</p>" for k in lengths]


def _linked(rng: random.Random, k: int) -> str:
    """Words of the article, now and then with a link among them."""
    return _words(MAIN, k) + (f" <a href=/q>{_words(MAIN, 3)}</a> {_words(MAIN, 5)}" if k > 10 and rng.random() < 0.3 else "")


def _page(rng: random.Random) -> str:
    element = rng.choice(["article", "main", "div"])
    sure = element in ("article", "main")
    if sure:
        story = []
        for k in [rng.choice([1, 2, 4, 8, 15, 30, 60, 120, 200]) for _ in range(rng.randint(1, 8))]:
            p = _linked(rng, k)
            story.append(f"<p>{p}</p>" if rng.random() < 0.9 else f"<ul><li>{p}</li></ul>")
        for _ in range(rng.choice([0, 0, 1, 2])):
            story.insert(rng.randint(0, len(story)), rng.choice([f'<div class="ad">{_prose(rng)}</div>', f'<div class="share">{_words(REST, 2)}</div>', _after(rng, False)]))
    else:
        story = _unnamed_story(rng)
    title = f"<h1>{_words(MAIN, rng.choice([2, 4, 6, 9, 15, 25, 60]))}</h1>" if rng.random() < 0.85 else ""
    if element == "article" and rng.random() < 0.3:
        title = f"<header>{title}</header>"
    body = f"<{element}>{title}{''.join(story)}</{element}>"
    alone = rng.random() < 0.15  # a page of nothing but the article, or with it and named parts alone
    before = [_before(rng, not alone and rng.random() < 0.4) for _ in range(rng.randint(0 if alone else 1, 1 if alone else 3))]
    after = [_after(rng, not alone and rng.random() < 0.4) for _ in range(rng.randint(0 if alone else 1, 1 if alone else 3))]
    return f"<html><head><title>t</title></head><body>{''.join([*before, body, *after])}</body></html>"


def labels(found: list[Block]) -> np.ndarray:
    """Of blocks of labelled pages, whether they are the article's."""
    return np.array([b.text.startswith(MAIN) for b in found], dtype=int)


def by_names_alone(x: np.ndarray) -> np.ndarray:
    """What elements and names say without any count: the yardstick that the tree is held against, and what decides a page of which the
    tree keeps nothing."""
    return ~x[:, [FEATURES.index(c) for c in NAMED]].any(axis=1)


def accuracy(decide: Callable[[np.ndarray], np.ndarray], n: int = 200, seed: int = 1003) -> tuple[float, float]:
    """Precision and recall, by words, of a decision over labelled pages drawn with another seed."""
    found = [blocks(p) for p in labelled_pages(n, seed)]
    x, y = np.concatenate([features(b) for b in found]), np.concatenate([labels(b) for b in found])
    size = np.array([b.words for page in found for b in page])
    kept = decide(x)
    right = size[kept & (y == 1)].sum()
    return float(right / max(1, size[kept].sum())), float(right / max(1, size[y == 1].sum()))


@dataclass
class Tree:
    """A node: a leaf with `main`, or a split at feature <= limit."""

    main: bool = False
    feature: int = -1
    limit: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def decide(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.main)
        low = x[:, self.feature] <= self.limit
        out = np.empty(len(x), dtype=bool)
        out[low], out[~low] = self.low.decide(x[low]), self.high.decide(x[~low])
        return out

    def deciding(self, x: np.ndarray) -> dict[str, float]:
        """Of each feature, the share of the rows that a split by it sees on their way."""
        total: dict[str, float] = {}
        todo = [(self, np.ones(len(x), dtype=bool))]
        while todo:
            node, at = todo.pop()
            if node.feature >= 0 and at.any():
                name = FEATURES[node.feature]
                total[name] = total.get(name, 0.0) + float(at.mean())
                low = x[:, node.feature] <= node.limit
                todo += [(node.low, at & low), (node.high, at & ~low)]
        return total


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> Tree:
    """A tree by least Gini impurity; ties go to the first feature and the lowest limit."""
    leaf = Tree(main=bool(2 * y.sum() > len(y)))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return leaf
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        k = k[(k >= least) & (len(y) - k >= least)]
        if not len(k):
            continue
        a, b = t[k - 1], t[-1] - t[k - 1]
        impurity = a * (k - a) / k + b * (len(y) - k - b) / (len(y) - k)
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0] - 1e-12:
            best = (impurity[i], f, (v[k[i] - 1] + v[k[i]]) / 2)
    if best is None or best[0] >= y.sum() * (len(y) - y.sum()) / len(y) - 1e-12:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(False, best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def trained_tree() -> Tree:
    """The tree of the labelled table. Its first splits are by the marks, as these are sure there; what is in no marked part goes on to
    splits by least impurity."""
    found = [blocks(p) for p in labelled_pages()]
    x, y = np.concatenate([features(b) for b in found]), np.concatenate([labels(b) for b in found])
    named = [FEATURES.index(c) for c in NAMED]
    rest = ~x[:, named].any(axis=1)
    tree = grow(x[rest], y[rest])
    for f in named:
        inside = x[:, f] > 0.5
        tree = Tree(False, f, 0.5, tree, grow(x[inside], y[inside]))
    return tree


def main_text(page: str | None, tree: Tree) -> str:
    """The main text of one page: its main blocks, joined by an empty line. Of a page without any, the blocks that aren't mostly links
    and stand in no part that an element or a name marks as another."""
    found = blocks(page or "")
    if not found:
        return ""
    x = features(found)
    keep = tree.decide(x)
    if not keep.any():
        keep = by_names_alone(x) & (x[:, FEATURES.index("links")] < 0.5)
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Add text: the main text of the whole page (null or empty page, or none found: empty), however long it is.

    Repeated rows are read alike, an empty table gives no rows; a column named text is replaced, all others are kept.
    """
    tree = trained_tree()

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            return [pa.array([main_text(x.as_py(), tree) for x in column], pa.string())]

        return work

    return add_columns(pages, make, [html_column], [T.StructField("text", T.StringType())])
