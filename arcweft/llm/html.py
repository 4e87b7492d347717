"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Every element and every run of text is a node with two states, boilerplate and content. A node's features (tag, words of
class, id and role, amount of text, share of text in links, what stands around it) give its own potential; a potential
of parent and child state, one for elements and one for runs of text, ties it to its parent. Sum-product messages go up
from the leaves and down from the root, and yield the exact marginal of every node: a run of text is kept if content is
the likelier state. The weights are fitted to labelled pages by the gradient of the likelihood, with the same messages.

Labelled pages mark elements with `data-label="1"` or `"0"`; what lies within inherits it. `labelled_pages` writes such
pages from a seed: articles in many kinds of markup among menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, or nothing but prose, with an element around the article or none, in pages that spell out html, head and body or leave them out.

Result: the kept runs in page order; character references decoded; block elements and <br> part blocks; white space within
a block is one space, blocks are trimmed, empty ones go, the rest are joined by one line feed. What no page shows never counts: scripts,
styles, head, templates, frames, form controls and the fallbacks of noscript, audio, video and canvas; anything else is up to the
marginals. Null and empty pages, and pages without any content node, give the empty text. Pages are read whole, of any length and depth
of nesting, in time linear in their length; unclosed comments and scripts reach to the end of the page. Rows are independent: repeated
rows and ids give repeated results; empty tables give none. Other columns stay; one with the name of the result is replaced.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without end, elements whose content is no text of the page, elements that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NO_TEXT = RAW - {"xmp"} | frozenset("head canvas audio video select option button datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: An opening tag of the key closes open elements of the value, up to the nearest of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select", "datalist")),
}
#: What may stand in a head and in a list of options; other tags close these.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
IN_OPTIONS = frozenset("option optgroup hr script template".split())
#: Block elements, and others that an open paragraph does not reach beyond.
BOUNDS = BLOCKS - {"p"} | frozenset("button object".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
STOP = re.compile(r"=\s*+([\"'])|>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Depth up to which trees are passed through level by level, many at once; deeper ones go node by node.
LEVELS = 200
#: Fitting: generated pages, gradient steps, penalty on squared weights.
PAGES, STEPS, PENALTY = 400, 120, 1e-3


@dataclass
class Tree:
    """A parsed page: nodes in document order, the root first, as parallel lists."""

    parent: list[int]
    tag: list[str]  # "" for a run of text
    text: list[str]  # of runs, references decoded
    names: list[str]  # class, id and role of elements
    label: list[int]  # 0, 1 or -1
    depth: int = 0  # of the deepest element


def parse(page: str) -> Tree:
    """A forgiving parse: stray end tags go, missing ones are implied, as is a body around what is not in one; whatever is no tag is text.

    Of open elements the depths by tag are kept, so that no tag looks through the elements that stay open.
    """
    t = Tree([-1], ["#"], [""], [""], [-1])
    stack, skip = [0], 0
    depths: dict[str, list[int]] = {}  # of open elements, by tag; "" has those of BOUNDS
    endless: set[str] = set()  # quotes that do not come again

    def add(tag: str, text: str, names: str, label: int) -> int:
        t.parent.append(stack[-1])
        t.tag.append(tag)
        t.text.append(text)
        t.names.append(names)
        t.label.append(label)
        return len(t.tag) - 1

    def push(node: int) -> None:
        nonlocal skip
        tag = t.tag[node]
        depths.setdefault(tag, []).append(len(stack))
        if tag in BOUNDS:
            depths.setdefault("", []).append(len(stack))
        stack.append(node)
        skip += tag in NO_TEXT
        t.depth = max(t.depth, len(stack))

    def run(text: str) -> None:
        if text and not text.isspace() and (t.tag[stack[-1]] == "head" or not last("body")):
            make_room("")
        if text and not skip:
            add("", _html.unescape(text) if not text.isspace() else " ", "", -1)

    def leave(depth: int) -> None:
        nonlocal skip
        for i in stack[depth:]:
            skip -= t.tag[i] in NO_TEXT
            depths[t.tag[i]].pop()
            if t.tag[i] in BOUNDS:
                depths[""].pop()
        del stack[depth:]

    def last(tag: str) -> int:
        return found[-1] if (found := depths.get(tag)) else 0

    def make_room(tag: str) -> None:
        """Leaves the elements that an opening tag ends."""
        if tag not in IN_HEAD and last("head"):
            leave(depths["head"][0])
        if tag not in IN_HEAD and tag != "body" and not last("body"):
            push(add("body", "", "", -1))
        if tag not in IN_OPTIONS and (open_list := max(last("select"), last("datalist"))):
            leave(open_list)
        if tag in BLOCKS or tag == "button":
            if last("button"):
                leave(depths["button"][0])
            if tag not in IN_OPTIONS and last("option"):
                leave(depths["option"][0])
        if tag in CLOSES:
            close, until = CLOSES[tag]
            limit = max(map(last, until))
            gone = [d[k] for name in (*close, "p") if (d := depths.get(name)) and (k := bisect_right(d, limit)) < len(d)]
            if gone:
                leave(min(gone))
        elif tag in BLOCKS and last("p") > last(""):
            leave(depths["p"][-1])

    def tag_end(at: int) -> int:
        """Where the `>` of a tag stands; quotes hide it only as those of a value, and only if they close."""
        while m := STOP.search(page, at):
            if not m[1]:
                return m.start()
            end = -1 if m[1] in endless else page.find(m[1], m.end())
            if end < 0:
                endless.add(m[1])
            at = m.end() if end < 0 else end + 1
        return -1

    begun, at = 0, page.find("<")
    while at >= 0:
        mark, closing = page[at + 1 : at + 2], page.startswith("/", at + 1)
        if mark in ("!", "?") or closing and not NAME.match(page, at + 2):
            run(page[begun:at])
            end = page.find("-->", at + 2) if page.startswith("!--", at + 1) else page.find(">", at + 1)
            at = begun = len(page) if end < 0 else end + (3 if page.startswith("!--", at + 1) else 1)
            at = page.find("<", at)
            continue
        m = NAME.match(page, at + 1 + closing)
        if not m:
            at = page.find("<", at + 1)
            continue
        end = tag_end(m.end())
        if end < 0:
            break  # no tag ends any more: all that is left is text
        run(page[begun:at])
        at = begun = end + 1
        tag = m[0].lower()
        if closing:
            if tag not in ("body", "html") and (found := depths.get(tag)):  # what comes after these is still in the body
                leave(found[-1])
        elif tag not in ("body", "html") or not last(tag):
            make_room(tag)
            names, label = _attributes(page[m.end() : end])
            node = add(tag, "", names, label)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
                if tag == "xmp" and not skip:
                    t.parent.append(node)
                    for column, value in ((t.tag, ""), (t.text, page[at : close.start() if close else None]), (t.names, ""), (t.label, -1)):
                        column.append(value)
                at = close.start() if close else len(page)
                begun = at = (page.find(">", at) + 1 or len(page)) if close else at
            elif tag not in VOID:
                push(node)
        at = page.find("<", at)
    run(page[begun:])
    return t


def _attributes(text: str) -> tuple[str, int]:
    """Class, id and role of a tag, with `hidden` for those that no page shows; its label."""
    names, label, hidden = [], -1, False
    if text and not text.isspace():
        for a in ATTRIBUTE.finditer(text):
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key in ("class", "id", "role"):
                names.append(value)
            elif key == "data-label":
                label = int(value) if value in ("0", "1") else -1
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
    return " ".join(names + ["hidden"] * hidden), label


def _bucket(n: float) -> int:
    return int(math.log2(n + 1))


def features(t: Tree) -> list[list[str]]:
    """Names of the features of every node."""
    n = len(t.tag)
    chars, linked, marks, children = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if not t.tag[i]:
            chars[i] = len(t.text[i])
            marks[i] = t.text[i].count(".") + t.text[i].count(",")
        elif t.tag[i] == "a":
            linked[i] = chars[i]
        p = t.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        children[p] += 1
    out = []
    for i in range(n):
        if not t.tag[i]:
            out.append(["text", f"in={t.tag[t.parent[i]]}", f"run={_bucket(chars[i])}", f"marks={min(_bucket(marks[i]), 4)}"])
            continue
        own = [f"<{t.tag[i]}>", f"size={min(_bucket(chars[i]), 12)}", f"links={math.ceil(4 * linked[i] / chars[i]) if chars[i] else -1}", f"in={t.tag[t.parent[i]] if i else ''}>{t.tag[i]}"]
        if t.names[i]:
            words = {w.lower() for w in WORD.findall(t.names[i])}
            own += [f".{w}" for w in words] + [f".{w[:4]}*" for w in words if len(w) > 4] + [f".{w[:-1]}" for w in words if w.endswith("s") and len(w) > 2]
        out.append(own)
    return out


@dataclass
class Model:
    weights: dict[str, float]
    ties: np.ndarray  # [kind of child: element, text][parent state][child state], log potentials


class Forest:
    """Several trees as flat arrays, by level, for messages that go over all of them at once."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.tag) for t in trees]
        first = np.cumsum([0, *sizes[:-1]])
        self.parent = np.concatenate([np.where((p := np.array(t.parent)) < 0, -1, p + f) for t, f in zip(trees, first, strict=True)])
        self.kind = np.concatenate([np.fromiter((not x for x in t.tag), np.int64, len(t.tag)) for t in trees])
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):  # parents come first
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])[1:]

    def marginals(self, own: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content for each node and expected [kind][parent state][child state] counts."""
        e = np.exp(ties)
        up = own.copy()  # log odds from the node and what is below
        sent = np.zeros_like(own)
        for level in reversed(self.levels):
            k, x = self.kind[level], np.exp(np.clip(up[level], -40, 40))
            sent[level] = np.log((e[k, 1, 0] + e[k, 1, 1] * x) / (e[k, 0, 0] + e[k, 0, 1] * x))
            np.add.at(up, self.parent[level], sent[level])
        full = up.copy()
        expected = np.zeros((2, 2, 2))
        for level in self.levels:
            k, p = self.kind[level], self.parent[level]
            above = np.exp(np.clip(full[p] - sent[level], -40, 40))
            x = np.exp(np.clip(up[level], -40, 40))
            joint = np.stack([e[k, 0, 0], e[k, 0, 1] * x, above * e[k, 1, 0], above * e[k, 1, 1] * x])
            joint /= joint.sum(0)
            for kind in (0, 1):
                expected[kind] += joint[:, k == kind].sum(1).reshape(2, 2)
            full[level] += np.log((e[k, 0, 1] + e[k, 1, 1] * above) / (e[k, 0, 0] + e[k, 1, 0] * above))
        return 1 / (1 + np.exp(-np.clip(full, -40, 40))), expected


def train(pages: list[str], steps: int = STEPS) -> Model:
    """Weights from labelled pages (see above; what no label covers is boilerplate)."""
    trees = [parse(p) for p in pages]
    label: list[int] = []
    for t in trees:
        for i in range(len(t.label)):
            if t.label[i] < 0:
                t.label[i] = t.label[t.parent[i]] if i else 0
        label += t.label
    y = np.array(label, float)
    named = [fs for t in trees for fs in features(t)]
    count = Counter(f for fs in named for f in fs)
    index = {f: i for i, f in enumerate(sorted(f for f, c in count.items() if c >= 5))}
    owner = np.array([i for i, fs in enumerate(named) for f in fs if f in index])
    feature = np.array([index[f] for fs in named for f in fs if f in index])
    forest = Forest(trees)
    observed = np.zeros((2, 2, 2))
    child = forest.parent >= 0
    np.add.at(observed, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    weight, ties = np.zeros(len(index)), np.zeros((2, 2, 2))
    seen = [np.full(len(index), 1e-6), np.full((2, 2, 2), 1e-6)]
    for _ in range(steps):
        p, expected = forest.marginals(np.bincount(owner, weight[feature], len(named)), ties)
        gradient = [np.bincount(feature, (y - p)[owner], len(index)) - PENALTY * len(pages) * weight, observed - expected - PENALTY * len(pages) * ties]
        seen = [s + g * g for s, g in zip(seen, gradient, strict=True)]
        weight = weight + 0.5 * gradient[0] / np.sqrt(seen[0])
        ties = ties + 0.3 * gradient[1] / np.sqrt(seen[1])
    return Model({f: float(weight[i]) for f, i in index.items()}, ties)


def _one_by_one(t: Tree, own: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The marginals of one tree, node by node in and against document order: for trees of any depth."""
    (e, c), exp, log = np.exp(ties).tolist(), math.exp, math.log  # of elements and of runs of text
    up, sent = own.tolist(), [0.0] * len(own)
    for i in range(len(up) - 1, 0, -1):
        k, x = e if t.tag[i] else c, exp(max(min(up[i], 40.0), -40.0))
        sent[i] = log((k[1][0] + k[1][1] * x) / (k[0][0] + k[0][1] * x))
        up[t.parent[i]] += sent[i]
    for i in range(1, len(up)):
        k, above = e if t.tag[i] else c, exp(max(min(up[t.parent[i]] - sent[i], 40.0), -40.0))
        up[i] += log((k[0][1] + k[1][1] * above) / (k[0][0] + k[1][0] * above))
    return 1 / (1 + np.exp(-np.clip(np.array(up), -40, 40)))


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(p or "") for p in pages]
    get = model.weights.get
    own = [np.array([sum(get(f, 0.0) for f in fs) for fs in features(t)]) for t in trees]
    flat = [i for i, t in enumerate(trees) if t.depth <= LEVELS]
    found = dict(zip(flat, np.split(Forest([trees[i] for i in flat]).marginals(np.concatenate([own[i] for i in flat]), model.ties)[0], np.cumsum([len(own[i]) for i in flat])[:-1]), strict=True)) if flat else {}
    return [_joined(t, (found[i] if i in found else _one_by_one(t, own[i], model.ties)) > 0.5) for i, t in enumerate(trees)]


def _joined(t: Tree, content: np.ndarray) -> str:
    blocks: list[list[str]] = [[]]
    block_of = [0] * len(t.tag)  # nearest block element
    last = 0
    for i in range(1, len(t.tag)):
        tag, p = t.tag[i], t.parent[i]
        block_of[i] = i if tag in BLOCKS else block_of[p]
        if tag == "br" or tag in BLOCKS or block_of[i] != last:
            blocks.append([])
            last = block_of[i]
        if not tag and (content[i] or t.text[i] == " "):
            blocks[-1].append(t.text[i])
    return "\n".join(b for b in (" ".join("".join(x).split()) for x in blocks) if b)


# --- labelled pages ---

#: Words for class and id attributes by what they mark.
NAMES = {
    "header": "header masthead site-header top-bar banner branding page-head", "menu": "nav menu navbar navigation breadcrumb breadcrumbs main-menu topnav tabs pagination",
    "ad": "ad ads advert advertisement sponsored promo ad-slot adsbox banner-ad google-ad sponsor commercial", "side": "sidebar widget rail aside related side-column secondary recommended popular trending more-stories",
    "notice": "notice cookie cookie-banner alert newsletter subscribe gdpr consent popup modal paywall announcement disclaimer message", "comments": "comments comment-list responses discussion replies disqus comment-thread reader-comments user-comments feedback",
    "footer": "footer site-footer bottom copyright legal colophon foot page-footer", "share": "share social share-buttons tools tags meta byline author-box",
    "content": "content article post entry story main body text article-body post-content entry-content main-content story-body page-content markdown prose",
}
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zé ñu ßa çe ön är la re ti mo".split()


def labelled_pages(n: int = PAGES, seed: int = 7) -> list[str]:
    """`n` pages with labels, the same for the same seed."""
    r = random.Random(seed)

    def words(k: int) -> str:
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(k))

    def sentences(k: int) -> str:
        return " ".join(words(r.randint(1, 16)).capitalize() + r.choice(". . . , ! ? : ;".split()) for _ in range(k))

    def inline(k: int) -> str:
        parts = []
        for _ in range(k):
            s, kind, tag = sentences(1), r.random(), r.choice("b i em strong span u code small font".split())
            parts.append(f"<{tag}>{s}</{tag}>" if kind < 0.15 else f"<{tag}>{s}" + r.choice(["", "<br>"]) if kind < 0.18 else f'<a href="/x">{s}</a>' if kind < 0.24 else s + r.choice(["<br>", " <br><br>"]) if kind < 0.27 else s)
        return " ".join(parts)

    def named(kind: str) -> str:
        name = r.choice(NAMES[kind].split())
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {words(1)}"', f' class="{words(1)} {name}" id="x{r.randint(1, 99)}"'])

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1)}">{words(r.randint(1, 4))}</a></li>' for _ in range(k)) + "</ul>"

    def box(kind: str, tags: str, inner: str) -> str:
        tag = r.choice(tags.split())
        plain = tag not in ("div", "section", "span", "p")
        return f'<{tag}{"" if plain and r.random() < 0.5 else named(kind)} data-label="0">{inner}</{tag}>'

    def prose() -> str:
        return r.choice([lambda: sentences(r.randint(1, 4)), lambda: f"<p>{inline(r.randint(1, 4))}</p>" * 1, lambda: words(r.randint(1, 6)), lambda: f"<p>{sentences(2)}</p><p>{sentences(1)}</p>"])()

    def junk(kind: str) -> str:
        if kind == "header":
            return box("header", "header div", r.choice([f"<h1>{words(3)}</h1>", f'<a href="/">{words(2)}</a>', f"<p>{words(5)}</p>", f"<span>{words(2)}</span>"]) + (links(3) if r.random() < 0.4 else ""))
        if kind == "menu":
            return box("menu", "nav nav div ul", links(r.randint(2, 9)) if r.random() < 0.8 else " | ".join(f'<a href="#">{words(1)}</a>' for _ in range(5)))
        if kind == "side":
            return box("side", "aside aside div section", (f"<h3>{words(2)}</h3>" if r.random() < 0.7 else "") + r.choice([lambda: links(4), prose])())
        if kind == "comments":
            one = lambda: f'<{(c := r.choice(["div", "li", "article", "section"]))} class="{r.choice(["comment", "reply", "response", "comment-body"])}"><b>{words(1)}</b><p>{inline(r.randint(1, 5))}</p></{c}>'
            return box("comments", "section div ol", (f"<h3>{words(2)}</h3>" if r.random() < 0.7 else "") + "".join(one() for _ in range(r.randint(1, 5))))
        if kind == "form":
            return f'<form action="/s" data-label="0">{r.choice([f"<p>{sentences(1)}</p>", f"<label>{words(2)}</label>", words(3)])}<input type="text" name="q"><button>{words(1)}</button></form>'
        if kind == "footer":
            return box("footer", "footer footer div", f"&copy; {words(2)} &middot; " + r.choice([lambda: sentences(1), lambda: links(4), prose])())
        return box(kind, "div div section aside p" if kind != "share" else "div ul p", prose() if kind != "share" else r.choice([links(3), f"{words(2)} {r.randint(1, 28)}"]))

    def body_block() -> str:
        k = r.random()
        if k < 0.62:
            return f"<p>{inline(r.randint(1, 6))}" + ("</p>" if r.random() < 0.9 else "")
        if k < 0.7:
            return f"<h{(h := r.randint(2, 4))}>{words(r.randint(1, 7))}</h{h}>"
        if k < 0.77:
            return f"<{(u := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{inline(1)}</li>" for _ in range(r.randint(1, 6))) + f"</{u}>"
        if k < 0.81:
            return f"<blockquote><p>{inline(2)}</p></blockquote>"
        if k < 0.85:
            return "<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(1)}</td></tr>" for _ in range(3)) + "</table>"
        if k < 0.88:
            return f"<pre><code>{words(6)}</code></pre>"
        if k < 0.91:
            return f'<figure><img src="x.png"><figcaption>{sentences(1)}</figcaption></figure>'
        if k < 0.95:
            return f"<div>{inline(2)}</div>"
        return f"<section><h2>{words(3)}</h2><p>{inline(3)}</p></section>"

    def shell(main: str, label: str) -> str:
        """The page around its body, spelled out or not."""
        head = f'<meta charset="utf-8"><title>{words(4)}</title><style>p{{}}</style><script>var a = 1;</script>'
        begin, end = r.choice([("<!DOCTYPE html>\n<html>", "</html>"), ("<html lang=x>", "</html>"), ("<!doctype html>", ""), ("", "")])
        head = r.choice([f"<head>{head}</head>", f"<head>{head}</head>\n", f"<head>{head}", head, ""])
        body, close = (f"<body{label}>", r.choice(["</body>", ""])) if label or r.random() < 0.8 else ("", "")
        return f"{begin}{head}{body}{main}{close}{end if r.random() < 0.9 else ''}"

    pages = []
    for _ in range(n):
        blocks = [body_block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12]))]
        title = f"<h1>{words(r.randint(1, 9))}</h1>" if r.random() < 0.85 else ""
        around = [k for k in ("menu", "header", "ad", "notice", "side", "form", "share") if r.random() < 0.45]
        after = [*(["comments"] if r.random() < 0.35 else []), *(["footer"] if r.random() < 0.85 else [])]
        r.shuffle(around)
        kind = r.random()
        if kind < 0.12:  # nothing but prose, or hardly anything else
            around, after = around[:1] if r.random() < 0.4 else [], after[-1:] if r.random() < 0.3 else []
        if r.random() < 0.25:
            blocks.insert(r.randint(0, len(blocks)), junk(r.choice(["ad", "side", "share", "notice", "form"])))
        tag, label = r.choice("article article article main div section".split()), ""
        name = named("content") if tag in ("div", "section") and r.random() < 0.75 or r.random() < 0.3 else ""
        if kind < 0.22 and r.random() < 0.6:  # nothing around the article but the body, or not even that
            if r.random() < 0.45:
                title, blocks = r.choice(["", title]), r.choice([[f"<p>{words(r.randint(1, 5))}</p>"], [sentences(r.randint(1, 9))], [f"<div>{sentences(2)}</div>"]])
            core, label = title + "".join(blocks), ' data-label="1"'
        else:
            core = f'<{tag}{name} data-label="1">{title}{"".join(blocks)}</{tag}>'
            if r.random() < 0.15:
                core = core.replace(f"</{tag}>", junk("comments") + f"</{tag}>") if core.count(f"</{tag}>") == 1 else core + junk("comments")
        split = r.randint(0, len(around))
        main = "".join(junk(k) for k in around[:split]) + core + "".join(junk(k) for k in [*around[split:], *after])
        if not label and r.random() < 0.35:
            main = f"<div{r.choice(['', ' class=wrapper', ' id=page', ' class=container', ' id=root', ' id=app'])}>{main}</div>"
        pages.append(shell(main, label))
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, html: str = "html", name: str = "text") -> DataFrame:
    """`pages` with the main text of each row's html."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[str] = []
            for i in range(0, len(batch), 100):
                out += main_texts(list(batch.iloc[i : i + 100]), shared.value)
            yield pd.Series(out, dtype=object)

    return pages.withColumn(name, F.pandas_udf(texts, "string", F.PandasUDFType.SCALAR_ITER)(F.col(html)))
