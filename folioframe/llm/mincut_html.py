"""Main text of web pages by minimum-cut labelling.

A page is read into blocks (runs of text between block-level tags; a line break is white
space), each with a pointer to its element, so that deep pages cost no more than flat ones.
A logistic classifier over a block's text and its own element gives it a
capacity to the source (content) or to the sink (boilerplate). Articles, menus and other
sectioning or marked elements are nodes too, tied to source or sink for certain; a block is
tied to the one around it by an edge whose capacity is what the marks weigh in the fit.
Smoothness edges join blocks that follow one another and blocks whose elements have the same
parent; their capacity falls with the distance in the tree, and none crosses the border of
such an element. The minimum cut, found by augmenting along shortest paths, labels all
blocks together: a short line of an article or among paragraphs stays, a sentence of a
menu or among links goes, whatever the line or sentence says by itself.

The classifier is fitted on ``N_TRAIN`` pages that are made here with a fixed seed; no
page of a table takes part.

Text inside script, style, noscript, template, form controls and the like is never a
block, nor are comments. An unclosed script, style or text area reaches to the end of the
page, another unclosed one to the end of its parent, and an unclosed head to the first
element that can't stand in it.

Defined results: a null or empty page has an empty text; unbalanced tags and cut pages
are read as far as they go; repeated rows are extracted each on its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Element names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas select button title noembed noframes xmp".split())
TO_THE_END = frozenset("script style textarea title iframe noembed noframes xmp".split())
IN_HEAD = frozenset("head base link meta noscript script style template title".split())
SECTION = frozenset("article aside footer form header main nav section".split())
#: An opening tag of the key closes an open element of its values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Words in class, id and role that speak against or for content; what they weigh is fitted.
AGAINST = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|toast|newsletter|subscribe|signup|login|menu|nav|navbar|navigation|breadcrumbs?|topbar|header|masthead|footer|foot|copyright|sidebar|side|aside|widget|related|recommended|popular|trending|share|sharing|social|comments?|comment-?list|respond|replies|reply|discussion|disqus|tags?|pagination|pager|search|toolbar|skip|legal|complementary|contentinfo|dialog|toc)(?:$|[\s_-]|\d)",
    re.I,
)
FOR = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])", re.I)

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACE = re.compile(r"\s+")


_BAD = frozenset("nav footer aside form menu dialog fieldset address head".split())
_STOP = re.compile(r"[.!?…]['\"”»)]*(?:\s|$)")


@dataclass(slots=True)
class Element:
    """An open element, with what its ancestors and it say of the text inside."""

    name: str
    parent: int
    depth: int
    border: int  # nearest sectioning or marked element
    bad: bool = False
    header: bool = False
    inside: bool = False  # of an article or main element
    head_in: bool = False  # the header stands in one
    against: bool = False
    speaks_for: bool = False
    hidden: bool = False


@dataclass(slots=True)
class Block:
    text: str
    element: int
    linked: int = 0  # code points in links


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag; quotes may hold one."""
    end = page.find(">", at)
    if end < 0:
        return len(page)
    if '"' not in page[at:end] and "'" not in page[at:end]:
        return end
    quote = ""
    for i in range(at, len(page)):
        c = page[i]
        if quote:
            if c == quote:
                quote = ""
        elif c == ">":
            return i
        elif c in "\"'" and page[i - 1] in "= \t\n":
            quote = c
    return end


def _child(elements: list[Element], at: int, name: str, mark: str) -> Element:
    up = elements[at]
    here = len(elements)
    marked = bool(mark) and name not in ("html", "body")
    against = marked and AGAINST.search(mark) is not None
    e = Element(
        name, at, up.depth + 1, here if name in SECTION or name in _BAD or against else up.border, up.bad or name in _BAD,
        up.header or name == "header", up.inside or name in ("article", "main"), up.head_in or (name == "header" and up.inside),
        up.against or against, up.speaks_for or (marked and not against and FOR.search(mark) is not None), up.hidden or "hidden" in mark.split(),
    )
    if name == "h1" and up.head_in:  # the title in an article's own header
        e.header = False
    return e


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks with text, in page order, and all elements that may hold some."""
    out: list[Block] = []
    elements = [Element("", 0, 0, 0)]
    stack: list[tuple[str, int]] = []  # (name, number of the nearest element that counts)
    opened: Counter = Counter()
    absent: set[str] = set()  # names without a further end tag
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, stack[-1][1] if stack else 0, linked))
            parts.clear()
        linked = 0

    def close(name: str) -> None:
        while opened[name]:
            last, _ = stack.pop()
            opened[last] -= 1
            if last == name:
                return

    def end_of(name: str, at: int) -> re.Match | None:
        if name in absent:
            return None
        stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
        if not stop:
            absent.add(name)
        return stop

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        raw = page[at : m.start() if m else n]
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            if opened["head"] and text.strip():
                close("head")
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())
        if not m:
            break
        if m.group(2) is None:
            if m.group(0) == "<!--":
                end = page.find("-->", m.end())
                at = n if end < 0 else end + 3
            else:
                at = _tag_end(page, m.end()) + 1
            continue
        name, closing = m.group(2).lower(), bool(m.group(1))
        end = _tag_end(page, m.end())
        inside = page[m.end() : end]
        at = end + 1
        if name in BLOCK:
            flush()
        if closing:
            if name in BLOCK or name in ("a", "span", "b", "i", "em", "strong"):
                close(name)
            continue
        if opened["head"] and name not in IN_HEAD:
            close("head")
        if name in RAW:
            if not inside.endswith("/"):
                stop = end_of(name, at)
                if not stop and name not in TO_THE_END and stack:
                    stop = end_of(stack[-1][0], at)  # where the parent ends, which is read next
                    at = stop.start() if stop else n
                else:
                    at = stop.end() if stop else n
            continue
        if name in VOID:
            if name == "br":  # white space within its block
                parts.append(" ")
            continue
        if name in BLOCK and opened["p"]:
            close("p")
        for other in CLOSES.get(name, ()):
            if opened[other] and any(x[0] == other for x in stack[-4:]):
                close(other)
        mark = ""
        if "=" in inside:
            mark = " ".join(v.strip("\"'") for k, v in _ATTR.findall(inside) if k.lower() in ("class", "id", "role"))
            low = inside.lower()
            if "hidden" in low and re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden", low):
                mark += " hidden"
        above = stack[-1][1] if stack else 0
        if name in BLOCK or name == "span" and mark:
            elements.append(_child(elements, above, name, mark))
            above = len(elements) - 1
        stack.append((name, above))
        opened[name] += 1
    flush()
    return out, elements


FEATURES = ("bias", "words", "linked", "sentence", "paragraph", "heading", "item", "inside", "bad", "header", "against", "for", "hidden")


def features(b: Block, e: Element) -> list[float]:
    """Of a block and where it stands, each from 0 to about 1."""
    words = b.text.count(" ") + 1
    clear = not (e.bad or e.header or e.against or e.hidden)  # what stands in the main element and in a menu is of the menu
    return [
        1.0, min(1.0, math.log1p(words) / 3), b.linked / max(1, len(b.text)), float(_STOP.search(b.text) is not None),
        float(e.name in ("p", "pre", "blockquote")), float(e.name in ("h1", "h2", "h3")), float(e.name in ("li", "dt", "dd", "td", "th")),
        float(clear and e.inside), float(e.bad), float(e.header), float(e.against), float(clear and e.speaks_for), float(e.hidden),
    ]


#: Of these, what an element around the block says.
MARKS = ("inside", "bad", "header", "against", "for", "hidden")
#: Capacity of an edge between neighbours, and how it falls with the distance in the tree.
NEAR = 3.0
FALL = 0.6


def _distance(a: int, b: int, elements: list[Element]) -> int:
    steps = 0
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def edges(found: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
    """Smoothness edges within a border: next blocks, and the next one whose element has the same parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        e = elements[b.element]
        beside = last.get(e.parent, -1)
        for j in {i - 1, beside} - {-1}:
            if elements[found[j].element].border == e.border:
                d = 2 if j == beside else _distance(found[j].element, b.element, elements)
                out.append((j, i, NEAR * FALL ** max(0, d - 2)))
        last[e.parent] = i
    return out


def minimum_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels with the least cost: |score| for each block against its sign, the capacity of each parted link."""
    n = len(scores)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(scores):
        if x > 0:
            join(s, i, x, 0.0)
        elif x < 0:
            join(i, t, -x, 0.0)
    for a, b, c in links:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:  # augment along the levels
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            else:
                if a == s:
                    break
                a = to[path.pop() ^ 1]
                nxt[a] += 1
                continue
            path.append(e)
            a = to[e]


# ---- the classifier

N_TRAIN = 300
SEED = 5


def _made(r: random.Random) -> tuple[str, set[str]]:
    """A page from templates and the texts of its content blocks; every text is its own."""
    words = "reou thing ander le la de et que der die und mit el los por con note see page item value order room about the of and".split()
    own = 0
    content = set()

    def say(n: int, stop: bool = True) -> str:
        nonlocal own
        own += 1
        body = " ".join(r.choice(words) for _ in range(n))
        return f"{body.capitalize()} {own}{'.' if stop else ''}"

    def keep(x: str) -> str:
        content.add(x)
        return x

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{say(r.randint(1, 3), False)}</a></li>' for _ in range(n))

    def paragraphs(n: int) -> str:
        out = ""
        tag = r.choice(["p", "p", "div"])
        for _ in range(n):
            kind = r.random()
            if kind < 0.1:
                out += f"<h2>{keep(say(r.randint(2, 6), False))}</h2>"
            elif kind < 0.2:
                out += "<ul>" + "".join(f"<li>{keep(say(r.randint(2, 12), r.random() < 0.5))}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
            elif kind < 0.25:
                out += f"<{tag}><a href='/y'>{keep(say(r.randint(2, 9), False))}</a></{tag}>"
            else:
                out += f"<{tag}>{keep(say(r.choice([1, 2, 3, 8, 20, 40, 80]), r.random() < 0.9))}</{tag}>"
        return out

    mark = lambda *x: r.choice([f' class="{r.choice(x)}"', f' id="{r.choice(x)}"', ""])
    head = f"<head><title>{say(4)}</title><script>x()</script></head>"
    top = r.choice(["", f"<header><a href='/'>{say(2, False)}</a><p>{say(4)}</p></header>", f"<div{mark('masthead', 'topbar')}><a href='/'>{say(2, False)}</a></div>"])
    menu = r.choice([f"<nav><ul>{links(r.randint(3, 8))}</ul></nav>", f"<div{mark('menu', 'navbar')}><ul>{links(r.randint(3, 8))}</ul></div>"])
    notice = r.choice(["", f"<div class=\"{r.choice(['cookie-notice', 'ad', 'newsletter', 'banner'])}\"><p>{say(r.randint(5, 60))}</p></div>"])
    side = r.choice(["", f"<aside><h3>{say(1, False)}</h3><p>{say(r.randint(3, 60))}</p></aside>", f"<div class=\"{r.choice(['sidebar', 'related', 'widget'])}\"><p>{say(r.randint(3, 60))}</p><ul>{links(3)}</ul></div>"])
    talk = r.choice(["", f"<section{mark('comments')}><h2>{say(1, False)}</h2><div class='comment'><p>{say(r.choice([3, 10, 30, 100, 200]))}</p></div></section>", f"<div class='comments'><p>{say(r.choice([3, 10, 30, 100, 200]))}</p></div>"])
    plain = lambda: r.choice(["", f"<div>{say(r.randint(1, 4), False)}</div>", f"<p><a href='/z'>{say(2, False)}</a></p>", f"<div>{say(3)}</div>", f"<p>{say(r.randint(1, 5))}</p>", f"<ul>{links(4)}</ul>"])
    foot = r.choice([f"<footer><p>{say(6)}</p><ul>{links(2)}</ul></footer>", f"<div class='footer'>{say(5)}<a href='/'>{say(1, False)}</a></div>"])
    title = f"<h1>{keep(say(r.randint(3, 8), False))}</h1>"
    body = title + paragraphs(r.randint(2, 9))
    if r.random() < 0.5:  # what is no content stands in the main element as often as beside it
        body += notice + paragraphs(r.randint(0, 2)) + side + talk + r.choice(["", f"<footer>{say(r.randint(3, 30))}</footer>", f"<form><p>{say(20)}</p></form>"])
        notice = side = talk = ""
    main = r.choice([f"<article>{body}</article>", f"<main>{body}</main>", f"<div{mark('content', 'post', 'story')}>{body}</div>", f"<div>{body}</div>"])
    return f"<html>{head}<body>{top}{menu}{plain()}{notice}{main}{plain()}{side}{talk}{foot}</body></html>", content


@lru_cache(maxsize=1)
def fitted(n: int = N_TRAIN, rounds: int = 25, decay: float = 0.3) -> tuple[float, ...]:
    """Weights of FEATURES by Newton steps on made pages, the same in every run."""
    r = random.Random(SEED)
    x, y = [], []
    for _ in range(n):
        page, content = _made(r)
        found, elements = blocks(page)
        for b in found:
            x.append(features(b, elements[b.element]))
            y.append(b.text in content)
        # hidden text is never content; few pages have some
        x += [[v if k != "hidden" else 1.0 for k, v in zip(FEATURES, f)] for f, keep in zip(x[-len(found) :], y[-len(found) :]) if keep]
        y += [False] * (len(x) - len(y))
    a, t = np.array(x), np.array(y, float)
    w = np.zeros(len(FEATURES))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (t - p) - decay * w
        h = (a * (p * (1 - p))[:, None]).T @ a + decay * np.eye(len(w))
        w += np.linalg.solve(h, g)
    return tuple(float(v) for v in w)


def scores(found: list[Block], elements: list[Element], weights: tuple[float, ...]) -> list[float]:
    """Log-odds of content by a block's text and its own element."""
    own = [i for i, k in enumerate(FEATURES) if k not in MARKS]
    return [sum(weights[i] * x[i] for i in own) for x in (features(b, elements[b.element]) for b in found)]


#: Capacity of what is certain.
CERTAIN = 1e6


def ties(found: list[Block], elements: list[Element], weights: tuple[float, ...]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Capacities of the sectioning and marked elements, numbered after the blocks, and the edges from them to their blocks."""
    marks = [i for i, k in enumerate(FEATURES) if k in MARKS]
    place: dict[tuple[int, bool], int] = {}
    more: list[float] = []
    links = []
    for i, b in enumerate(found):
        x = features(b, elements[b.element])
        said = sum(weights[k] * x[k] for k in marks)
        if said:
            key = elements[b.element].border, said > 0
            if key not in place:
                place[key] = len(found) + len(more)
                more.append(CERTAIN if said > 0 else -CERTAIN)
            links.append((place[key], i, abs(said)))
    return more, links


def labels(found: list[Block], elements: list[Element], weights: tuple[float, ...]) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    more, links = ties(found, elements, weights)
    return minimum_cut(scores(found, elements, weights) + more, edges(found, elements) + links)[: len(found)]


def extract(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The main text: content blocks in page order, one line each."""
    if not page:
        return ""
    found, elements = blocks(page)
    if not found:
        return ""
    keep = labels(found, elements, weights or fitted())
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def digest(pages: DataFrame) -> DataFrame:
    """The rows of op10."""

    weights = fitted()

    def make():
        def one(i, url, page):
            text = extract(page, weights)
            return i, url, text, len(text)

        return lambda rows: [one(*r) for r in rows]

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_rows(rows, make, "page_id long, url string, text string, n_chars long")
