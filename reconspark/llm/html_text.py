"""HTML main-text extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

Every block element of a page becomes a row of features: its tag, its attribute tokens, depth, sibling statistics,
and text, link and tag density of its subtree.  Boosted trees score how likely the node belongs to the article.
Decoding then chooses the best labelling in which a kept node has only kept ancestors, so a
paragraph is never kept inside a dropped menu nor a menu item on its own.  Text straight in the body is a node of its own
for each run between block elements, scored like any other.  The trees are fitted in numpy on
the nodes of a bounded sample of pages (SAMPLE, MOST_CHARS), each in its own markup and re-rendered in other layouts, most of
them without any name or telling tag, so that the model leans neither on one template nor on the names
that its labels come from; extraction is one narrow pass over all pages.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most pages that training reads, and the longest of them in characters: the documented bound of the sample.
SAMPLE, MOST_CHARS = 120, 200_000
TREES, DEPTH, RATE, BINS = 60, 5, 0.3, 32

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[a-z]+")
LONG_TEXT = re.compile(r"(?<=>)[^<>]{60,}(?=<)")
RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg"}
#: Of these, those that take the rest of a page when unclosed; the others end, unclosed, at the next tag that can't be in them.
TO_THE_END = {"script", "style", "title", "textarea"}
#: Controls: their labels are no text.  They end at their closing tag or, unclosed, at the next tag that can't be in them.
CONTROLS = {"select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: A run of text straight in the body.
LOOSE = "#text"
#: Elements that a new one of the second kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "tbody", "thead", "body", "html", "article", "section", "div", "main", "aside", "nav", "footer", "header", "blockquote", "form"}
TAG_KINDS = [{"p", "blockquote", "pre", LOOSE}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "ul", "ol", "dl", "dt", "dd"}, {"div", "section"}, {"article", "main"}, {"nav", "menu"}, {"footer"}, {"header"}, {"aside"}, {"form", "fieldset"}, {"table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"figure", "figcaption"}, {"dialog"}, {"details", "summary"}]
GOOD = {"article", "content", "post", "story", "entry", "main", "body", "text", "page"}
BAD_KINDS = [
    {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"},
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination"},
    {"footer", "foot", "copyright", "legal"},
    {"header", "masthead", "topbar", "logo"},
    {"sidebar", "side", "aside", "widget", "related", "recommended", "share", "social", "tags"},
    {"comment", "comments", "reply", "replies", "respond", "discussion"},
    {"cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "alert", "gdpr"},
]


#: Words of reader comments: a comment's body is no article, whatever else its name says.
COMMENTS = BAD_KINDS[5]

#: What ends an unclosed control: any tag of a block element, of a control, or of the document.
ENDS_CONTROL = re.compile(rf"</?(?:{'|'.join(sorted(set().union(*TAG_KINDS, SCOPE, CONTROLS, {'hr', 'input', 'textarea', 'address', 'details'}) - {LOOSE}))})\b[^>]*>", re.I)
SENTENCE = re.compile(r"[.!?。！？,;:،।]")


class Node:
    __slots__ = ("before", "children", "depth", "index", "link", "marks", "parent", "parts", "start", "tag", "tags", "text", "tokens")

    def __init__(self, tag: str, tokens: frozenset, parent):
        self.tag, self.tokens, self.parent, self.children, self.parts = tag, tokens, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.text = self.link = self.tags = self.marks = 0
        self.index, self.before, self.start = 0, 0, ""


def parse(page: str) -> list[Node]:
    """Block elements in page order, the root first.  A node's parts are its texts and child nodes in order."""
    root = Node("body", frozenset(), None)
    nodes, stack, links, at, end, seen = [root], [root], 0, 0, len(page), 0

    def place(node: Node) -> None:
        node.index, node.before = len(node.parent.children), seen
        node.parent.children.append(node)
        node.parent.parts.append(node)
        nodes.append(node)

    def add(text: str, size: int) -> None:
        nonlocal seen
        node = stack[-1]
        if node is root:  # a run of loose text goes on until a block starts
            last = root.parts[-1] if root.parts else None
            if not (isinstance(last, Node) and last.tag == LOOSE):
                if not size:
                    return
                last = Node(LOOSE, frozenset(), root)
                place(last)
            node = last
        node.parts.append(text)
        if size:
            node.text += size
            node.link += size if links else 0
            node.marks += len(SENTENCE.findall(text))
            if len(node.start) < 40:
                node.start += text[:40]
            seen += size

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw)
            add(plain, len("".join(plain.split())))

    while at < end:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if not close and tag not in TO_THE_END:
                    close = ENDS_CONTROL.search(page, at)
                    at = close.start() if close else end
                else:
                    at = close.end() if close else end
            continue
        if tag in CONTROLS:
            if not m[1] and (close := ENDS_CONTROL.search(page, at)):
                at = close.end() if close[0].lower().startswith(f"</{tag}") else close.start()
            continue
        if tag in INLINE or tag in VOID:
            stack[-1].tags += 1
            if tag == "a":
                links = 0 if m[1] else 1
            elif tag in ("br", "hr", "img"):
                add(" ", 0)
            continue
        stack[-1].tags += 1
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    links = 0
                    break
                if tag == "p" and stack[i].tag in SCOPE:
                    break
            continue
        if stack[-1].tag == "p" or (stack[-1].tag in TAG_KINDS[1] and tag in TAG_KINDS[1]):
            stack.pop()  # a new block ends a paragraph or heading
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in CLOSES.get(tag, ()):
                del stack[i:]
                break
            if stack[i].tag in SCOPE:
                break
        tokens = frozenset(t for a in ATTRIBUTE.finditer(m[3]) for t in TOKEN.findall((a[2] or a[3] or a[4] or "").lower()))
        node = Node(tag, tokens, stack[-1])
        place(node)
        links = 0
        if not m[3].endswith("/"):
            stack.append(node)
    for node in reversed(nodes):
        if node.parent:
            node.parent.text += node.text
            node.parent.link += node.link
            node.parent.marks += node.marks
            node.parent.tags += node.tags + 1
            node.parent.start = (node.start + node.parent.start)[:40]
    return nodes


BAD_TAGS, NAMED_BAD = {"nav", "menu", "footer", "aside", "form", "dialog"}, set().union(*BAD_KINDS)


def says_bad(node: Node) -> bool:
    """Whether tag or name call the element something else than article; a name that says both is no such name, but for comments."""
    return node.tag in BAD_TAGS or bool(node.tokens & COMMENTS) or bool(node.tokens & NAMED_BAD and not node.tokens & GOOD)


#: What a block that is no article may begin with.
SAYS_BAD = [{"comments", "comment", "reply", "replies", "responses"}, {"related", "recommended", "tags", "share", "follow", "popular"}, {"copyright", "rights", "imprint", "privacy"}, {"advertisement", "sponsored", "cookies", "newsletter", "subscribe"}]


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: tag kind, attribute tokens, those of the ancestors, depth, siblings, subtree densities."""
    whole = max(1, nodes[0].text)
    rows, inherited, mates, largest = [], {}, {}, {}
    for node in nodes:
        if node.children:
            mates[id(node)], largest[id(node)] = Counter(c.tag for c in node.children), max(c.text for c in node.children)
    for node in nodes:
        own = [float(node.tag in kind) for kind in TAG_KINDS] + [float(bool(node.tokens & GOOD and not node.tokens & COMMENTS))] + [float(bool(node.tokens & kind)) for kind in BAD_KINDS] + [float(says_bad(node))]
        parent = node.parent
        above = inherited[id(parent)] if parent else [0.0] * len(own)
        inherited[id(node)] = [max(a, b) for a, b in zip(own, above)]
        n = len(parent.children) if parent else 1
        alike = mates[id(parent)][node.tag] if parent else 1
        said = set(TOKEN.findall(node.start.lower()))
        rows.append([
            *own, *above, node.depth, n, node.index / n, alike / n, (parent.text - node.text) / (1 + node.text) if parent else 0.0,
            node.text, node.text / whole, node.link / max(1, node.text), node.tags / max(1, node.text), len(node.children),
            node.text / max(1, parent.text) if parent else 1.0, node.text / max(1, largest[id(parent)]) if parent else 1.0,
            node.before / whole, parent.link / max(1, parent.text) if parent else 0.0, parent.text / whole if parent else 1.0,
            node.marks / max(1, node.text), node.marks, n - node.index, *[float(bool(said & kind)) for kind in SAYS_BAD], float("\u00a9" in node.start),
        ])
    return np.array(rows, dtype="float32")


class Trees:
    """Boosted regression trees on binned features, for the logistic loss."""

    def __init__(self):
        self.trees = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        cells = binned + np.arange(binned.shape[1]) * BINS  # one histogram holds those of all features
        score = np.zeros(len(y))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(cells, weight * (p - y), weight * p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, cells, g, h, rows, depth):
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        if depth and len(rows) > 1:
            n, flat = cells.shape[1], cells[rows].ravel()
            left_g, left_h = (np.cumsum(np.bincount(flat, weights=np.repeat(v[rows], n), minlength=n * BINS).reshape(n, BINS), axis=1) for v in (g, h))
            gain = left_g**2 / (left_h + 1) + (sum_g - left_g) ** 2 / (sum_h - left_h + 1) - sum_g**2 / (sum_h + 1)
            j, at = divmod(int(np.argmax(gain)), BINS)
            if gain[j, at] > 1e-6 and at < len(self.edges[j]):
                low = cells[rows, j] <= at + j * BINS
                return (j, float(self.edges[j][at]), self._grow(cells, g, h, rows[low], depth - 1), self._grow(cells, g, h, rows[~low], depth - 1))
        return -RATE * sum_g / (sum_h + 1)

    def _walk(self, tree, x) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(tree, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, tuple):
                out[rows] = node
            elif len(rows):
                low = x[rows, node[0]] <= node[1]
                todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labelling in which every kept node's ancestors are kept; the root always is."""
    place = {id(n): i for i, n in enumerate(nodes)}
    best = odds.astype(float).copy()
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        if best[i] > 0:
            best[place[id(nodes[i].parent)]] += best[i]
    kept = [True]
    for i in range(1, len(nodes)):
        kept.append(bool(best[i] > 0 and kept[place[id(nodes[i].parent)]]))
    return kept


def blocks(nodes: list[Node], kept: list[bool]) -> list[str]:
    """Texts of the kept blocks in page order: runs of text between block borders, white space as one space."""
    keep = {id(n): k for n, k in zip(nodes, kept)}
    out, todo, run = [], [iter(nodes[0].parts)], []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
            flush()
        elif isinstance(part, str):
            run.append(part)
        else:
            flush()
            if keep[id(part)]:
                todo.append(iter(part.parts))
    return out


def weak_labels(nodes: list[Node]) -> np.ndarray:
    """Labels of a page from its own markup: what its tags and tokens call article, less what they call anything else."""
    article = any(n.tag in TAG_KINDS[4] for n in nodes)
    state, out = {id(nodes[0]): (not article, False)}, [1.0]
    for n in nodes[1:]:
        inside, bad = state[id(n.parent)]
        bad = bad or says_bad(n) or (n.tag == "header" and not inside)
        inside = inside or n.tag in TAG_KINDS[4] or bool(n.tokens & GOOD)
        state[id(n)] = (inside, bad)
        holds = any(c.tag in TAG_KINDS[4] for c in n.children)
        out.append(float((inside or holds) and not bad))
    return np.array(out)


#: What a footer inside an article begins with.
TAILS = ("Tags", "Filed under", "Posted in", "Published", "Author", "Last updated")
#: Marks the blocks of the article in a rendering; taken from the tokens before anything is learnt.
KEEP = "zkeep"
NAMES = re.compile(r"""\s(?:class|id)=(?:'[^']*'|"[^"]*")""")
TELLING = re.compile(r"<(/?)(?:nav|header|aside|footer|form|article|main|section)\b")


def shaped(text: str, k_: str, rng: random.Random) -> str:
    """A text of the article in one of the shapes that an article's blocks have; ``k_`` marks its nodes."""
    words = text.split()
    short = lambda: " ".join(words[(at := rng.randrange(len(words))) : at + rng.randint(1, 3)]) if words else "x"
    cell = lambda tag: f"<{tag}{k_}>{rng.choice([short(), short(), str(rng.randint(1, 3000)), text[: rng.randint(5, 90)]])}</{tag}>"
    row = lambda tags: f"<tr{k_}>{''.join(map(cell, tags))}</tr>"
    shape = rng.random()
    if shape < 0.45:
        return f"<p{k_}>{text}</p>"
    if shape < 0.6:
        return f"<div{k_}>{text}</div>"
    if shape < 0.68:
        return f"<blockquote{k_}><p{k_}>{text}</p></blockquote>"
    if shape < 0.76:
        return f"<{(t := rng.choice(['ul', 'ol']))}{k_}>" + "".join(f"<li{k_}>{v}</li>" for v in [text, *(short() for _ in range(rng.choice([0, 0, 2, 4])))]) + f"</{t}>"
    if shape < 0.86:
        width, head, body = rng.randint(2, 4), "", f"<tbody{k_}>"
        if rng.random() < 0.7:
            head = row(["th"] * width)
            head = rng.choice([head, f"<thead{k_}>{head}</thead>"])
        rows = "".join(row([rng.choice(["td", "td", "th"]), *["td"] * (width - 1)]) for _ in range(rng.randint(1, 5)))
        caption = f"<caption{k_}>{short()}</caption>" if rng.random() < 0.3 else ""
        return f"<table{k_}>{caption}{head}{rng.choice([rows, f'{body}{rows}</tbody>'])}</table>"
    if shape < 0.91:
        return f"<dl{k_}>" + "".join(f"<dt{k_}>{short()}</dt><dd{k_}>{v}</dd>" for v in [text, *(short() for _ in range(rng.randint(0, 2)))]) + "</dl>"
    if shape < 0.96:
        return f"<details{k_}><summary{k_}>{short()}</summary><p{k_}>{text}</p></details>"
    return f"<figure{k_}><img src='a.png'><figcaption{k_}>{text[: rng.randint(10, 200)]}</figcaption></figure>"


def rendered(good: list[str], bad: list[str], rng: random.Random, named: bool) -> str:
    """The texts of a page in another layout, to train on: same article (its blocks marked KEEP), other markup around it.

    Not ``named``: without class names, ids and telling tags, in <div>s or straight in the body.
    """
    say = lambda: html.escape(rng.choice(bad) if bad else "Home")
    item = lambda: f"<li><a href='#'>{say()[:20]}</a></li>"
    items = lambda: "".join(item() for _ in range(rng.randint(3, 8)))
    bar = lambda: rng.choice([" ", " | ", " &middot; "]).join(f"<a href='#'>{say()[:20]}</a>" for _ in range(rng.randint(3, 8)))
    title = lambda *words: rng.choice([say()[:30], rng.choice(words)])
    around = {
        "nav": lambda: f"<nav><ul>{items()}</ul></nav>",
        "menu": lambda: f"<div class='{rng.choice(['menu', 'main-nav', 'navbar', 'breadcrumbs'])}'>{rng.choice([f'<ul>{items()}</ul>', bar()])}</div>",
        "header": lambda: f"<header><div class='logo'>{say()[:30]}</div><p>{say()[:60]}</p></header>",
        "aside": lambda: f"<aside><h3>{title('Related', 'Popular posts')}</h3><p>{say()}</p><ul>{item()}{item()}</ul></aside>",
        "side": lambda: f"<div class='{rng.choice(['sidebar', 'widget', 'related', 'share'])}'><h4>{title('Share this', 'Tags')}</h4><p>{bar()}</p></div>",
        "ad": lambda: f"<div class='{rng.choice(['ad', 'ads', 'advert', 'sponsored', 'promo-box'])}'>{rng.choice(['', 'Advertisement '])}{say()}</div>",
        "notice": lambda: f"<div class='{rng.choice(['cookie-notice', 'consent', 'newsletter', 'popup'])}'><p>{rng.choice(['', 'We use cookies. '])}{say()}</p></div>",
        "form": lambda: f"<form><p>{say()[:40]}</p><input><label>{say()[:20]}</label></form>",
        "comments": lambda: f"<{(t := rng.choice(['div', 'section']))} {rng.choice(['class', 'id'])}='{rng.choice(['comments', 'comment-list', 'replies'])}'><h3>{title('3 comments', 'Leave a reply')}</h3><div class='comment'><p>{say()}</p><p>{say()}</p></div></{t}>",
        "comment": lambda: "".join(f"<div class='{rng.choice(['comment-body', 'comment-content', 'comment-text', 'comment', 'user-comment', 'reply-body'])}'>{rng.choice([say(), f'<p>{say()}</p>'])}</div>" for _ in range(rng.randint(1, 3))),
        "tail": lambda: f"<footer{rng.choice(['', '', ' class=entry-footer', ' class=post-meta'])}>{rng.choice([f'<p>{title(*TAILS)}: {bar()}</p>', f'<p>{title(*TAILS)}: {say()[:40]}</p>', say()[:60]])}</footer>",
        "links": lambda: rng.choice([f"<table><tr><td><a href='#'>{say()[:20]}</a></td><td><a href='#'>{say()[:20]}</a></td></tr></table>", f"<details><summary>{title('Menu', 'More')}</summary><ul>{items()}</ul></details>"]),
        "footer": lambda: f"<footer><p>{rng.choice(['', '&copy; '])}{say()}</p></footer>",
        "foot": lambda: f"<div class='{rng.choice(['footer', 'site-footer', 'copyright'])}'>{rng.choice(['', '&copy; ', 'Copyright '])}{say()}</div>",
    }
    loose = not named and rng.random() < 0.25
    k_ = f" role='{KEEP}'"
    body = []
    for k, text in enumerate(good):
        text = html.escape(text)
        if loose:
            body.append(f"{text}<br><br>")
        elif k == 0 and len(text) < 120 and rng.random() < 0.8:
            body.append(f"<h{(level := rng.randint(1, 3))}{k_}>{text}</h{level}>")
        else:
            body.append(shaped(text, k_, rng))
        if named and rng.random() < 0.06:
            body.append(around[rng.choice(["ad", "side", "aside", "notice"])]())
    wraps = [("<article@>", "</article>"), ("<main@>", "</main>"), ("<main@><article@>", "</article></main>"), ("<div class='post-content'@>", "</div>"), ("<div id='content'@>", "</div>"), ("<div@><div class='entry'@>", "</div></div>"), ("<article class='post side'@>", "</article>"), ("<div class='with-sidebar'@>", "</div>"), ("<div@>", "</div>"), ("<section class='story'@>", "</section>")]
    open_, close = ("", "") if loose or (not named and rng.random() < 0.15) else rng.choice(wraps)
    tail = "".join(around[kind]() for kind in rng.sample(["comments", "comment", "comment", "side", "tail", "tail"], rng.randint(1, 2))) if named and open_ and rng.random() < 0.35 else ""
    # Without names only what its text, links, place or size tell apart can be told apart.
    before = [around[k]() for k in rng.sample(["nav", "menu", "header", "ad", "notice", "side", "form", "links"] if named else ["nav", "menu", "header", "side", "form"], rng.randint(0, 4 if named else 3))]
    after = [around[k]() for k in rng.sample(["comments", "aside", "side", "ad", "footer", "foot", "form", "notice"] if named else ["aside", "side", "footer", "foot", "form", "menu"], rng.randint(0, 4 if named else 3))]
    around_it = "".join(before), open_.replace("@", k_) + "".join(body) + tail + close, "".join(after)
    if not named:
        around_it = tuple(TELLING.sub(r"<\1div", NAMES.sub("", part)) for part in around_it)
    return "<body>" + "".join(around_it) + "</body>"


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a rendering with their true labels, the marks taken off.  Loose text of a page that has any is its article."""
    nodes = parse(page)
    truth = np.array([1.0] + [float(KEEP in n.tokens or n.tag == LOOSE) for n in nodes[1:]])
    for n in nodes:
        n.tokens -= {KEEP}
    return nodes, truth


def layouts(page: str, rng: random.Random, turns: int = 8) -> list[tuple[list[Node], np.ndarray]]:
    """A page in its own markup and, long and short, in other layouts; half of them with names."""
    nodes = parse(page)
    labels = weak_labels(nodes)
    good = blocks(nodes, [bool(v) for v in labels])
    bad = [b for b in blocks(nodes, [True] * len(nodes)) if b not in set(good)]
    short = parse(LONG_TEXT.sub(lambda m: m[0][: rng.randint(4, 60)], page))  # same markup, less text
    out = [(nodes, labels), (short, weak_labels(short))]
    for turn in range(turns if good else 0):
        own = good
        if turn in (2, 4, 5, 6):
            own = [g[: rng.randint(1, 60) if turn == 2 else rng.randint(40, 160)] for g in good[: rng.randint(1, 4)]]
        out.append(labelled(rendered(own, bad, rng, named=turn % 4 in (1, 2))))
    return out


def invented(rng: random.Random, n: int = 60) -> list[tuple[list[Node], np.ndarray]]:
    """Pages of made-up words, with and without names: what is learnt from where a table has no page to sample."""
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    say = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high))).capitalize()
    return [labelled(rendered([say(2, 8), *[say(3, 120) + "." for _ in range(rng.randint(1, 8))]], [say(2, 12) for _ in range(12)], rng, named=k % 3 < 2)) for k in range(n)]


def train(pages: list[str], seed: int = 11) -> Trees:
    """Fit on the nodes of the pages, in their own markup and in other layouts; without pages, on invented ones."""
    rng = random.Random(seed)
    sample = [x for page in pages for x in layouts(page, rng)] or invented(rng)
    # Pages with many paragraphs or menu items don't drown the others.
    weight = np.concatenate([np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum())) ** -0.5 for _, y in sample])
    return Trees().fit(np.concatenate([features(n) for n, _ in sample]), np.concatenate([y for _, y in sample]), weight / weight.mean())


def blockless(nodes: list[Node]) -> bool:
    """Whether the page has no block element; then its loose text is its text."""
    return all(n.tag == LOOSE for n in nodes[1:])


def main_text(page: str | None, model: Trees) -> str:
    if not page:
        return ""
    nodes = parse(page)
    return "\n\n".join(blocks(nodes, [True] * len(nodes) if blockless(nodes) else decode(nodes, model.log_odds(features(nodes)))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null and empty pages give an empty text.  Each run of text outside all block elements is a block of its own;
    of a page without block elements it is the text.
    A table whose pages are all too long for the sample is read by trees that learnt from invented pages.
    An unclosed script, style, title or textarea takes the rest of its page, as HTML has it; an unclosed svg, noscript, template
    or iframe ends at the next block tag.  Footers and reader comments inside the article go; its tables, lists, details and
    captions stay.  Rows of one id with different html are extracted each by its own.
    Repeated pages are extracted alike; null ids and urls are carried; an empty table gives an
    empty result.  Other columns are ignored.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # Hashes are chosen first, so that only the sample's pages move.
    keyed = own.where(F.length("html").between(1, MOST_CHARS)).select("html", F.xxhash64("page_id", "url").alias("h"))
    chosen = keyed.join(F.broadcast(keyed.select("h").distinct().orderBy("h").limit(sample)), "h", "left_semi").groupBy("h").agg(F.max("html").alias("html")).orderBy("h")
    model = pages.sparkSession.sparkContext.broadcast(train([r["html"] for r in chosen.collect()]))

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        parsed = [parse(p or "") for p in column]
        whole = [n for n in parsed if not blockless(n)]
        odds = np.split(model.value.log_odds(np.concatenate([features(n) for n in whole])), np.cumsum([len(n) for n in whole])[:-1]) if whole else []
        score = {id(n): o for n, o in zip(whole, odds)}
        return pd.Series(["\n\n".join(blocks(n, decode(n, score[id(n)]) if id(n) in score else [True] * len(n))) for n in parsed])

    return own.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
