"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded top-down so that choices don't contradict.

The trees learn from pages that a generator writes, where it is known which nodes are main text or hold some. A node is kept
or dropped together with all below it; the choice of nodes is the likeliest one of that form for the whole page.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import ready, table

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Up to their end tag, or the page's end, there is no markup in these; the others of which nothing is shown have some.
RAW = frozenset("script style iframe textarea title".split())
HIDDEN = frozenset("noscript template svg select annotation annotation-xml".split())
#: Parts of formulas: their text is that of the element around the formula.
MATH = frozenset("math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mover munder munderover mfrac msqrt mroot mfenced mtable mtr mtd mstyle mpadded mphantom menclose".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the key ends an open element of these, unless one of the second set lies between.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"table", "tr"}), "th": ({"td", "th", "p"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_P_SCOPE = frozenset("article aside body button caption dialog div figure footer form header html li main nav section table td th".split())

# Words of class and id attributes, by what they tell of an element.
HINTS = (
    "article post entry story content main body text blog news page hentry prose",
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc tabs links skip",
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner affiliate dfp adsense",
    "comment comments reply replies respond discussion disqus thread feedback review reviews",
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup paywall privacy",
    "sidebar aside widget widgets related recommended recommendations more rail trending popular teaser tags",
    "header masthead topbar top brand logo site hero toolbar",
    "footer foot bottom copyright colophon legal imprint",
    "share sharing social follow facebook twitter meta byline author date",
    "form login search register contact input field",
)
_HINT = {w: i for i, words in enumerate(HINTS) for w in words.split()}
TAGS = ("article main section div p span a ul ol li h1 h2 h3 nav header footer aside form table tr td blockquote pre figure figcaption body html button label dl dd dt b i em strong").split()
_TAG = {t: i for i, t in enumerate(TAGS)}
_GROUPS = (("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "button", "fieldset", "label"), ("article", "main"))
_GROUP_BIT = {t: 1 << len(HINTS) + i for i, g in enumerate(_GROUPS) for t in g}
FEATURES = 20 + len(TAGS) + 2 * len(HINTS) + len(_GROUPS)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s>/]*)[^>]*>?|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    hints: int  # a bit for each line of HINTS
    children: list[int] = field(default_factory=list)
    items: list = field(default_factory=list)  # text, or the number of a child, in page order


@functools.lru_cache(20_000)
def _hints(attributes: str) -> int:
    parts = [p.lower() for m in _ATTRIBUTE.finditer(attributes) for p in _PART.findall(m[1] or m[2] or m[3] or "")]
    mask = 0
    for p in parts:
        if p in _HINT:
            mask |= 1 << _HINT[p]
    return mask


def parse(page: str) -> list[Node]:
    """All elements in page order; the first is a root. Elements that are never shown as text are left out.

    Tolerant as browsers are: unknown end tags are ignored, missing ones follow from the elements that start or end, an
    open tag at the page's end counts as ended. Hidden elements without an end tag hide nothing. Time is linear in the page.
    """
    nodes = [Node("html", -1, 0, 0)]
    stack, at, size = [0], 0, len(page)
    open_: dict[str, list[int]] = {}  # by tag, its places in the stack
    hidden: dict[str, dict[int, int]] = {}

    def text(upto: int) -> None:
        if upto > at:
            nodes[stack[-1]].items.append(page[at:upto])

    def close(tags, stops) -> None:
        """Ends the innermost open element of tags, and all in it, unless one of stops is nearer."""
        last = max([open_[t][-1] for t in tags if open_.get(t)], default=0)
        if last and (last == len(stack) - 1 or last >= max([open_[t][-1] for t in stops if open_.get(t)], default=0)):
            for i in stack[last:]:
                open_[nodes[i].tag].pop()
            del stack[last:]

    def pairs(tag: str) -> dict[int, int]:
        """Where each element of this tag that has an end tag begins and ends."""
        found, begun = {}, []
        for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", page, re.I):
            if not m[1]:
                begun += [] if m[0].endswith("/>") else [m.start()]
            elif begun:
                found[begun.pop()] = m.end()
        return found

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            break
        text(m.start())
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in MATH:
                continue
            if tag in INLINE:
                close({tag}, _P_ENDERS | _P_SCOPE)
            elif tag == "br":
                nodes[stack[-1]].items.append(" ")
            else:
                close({tag}, {"table"} if tag in ("p", "li", "div") else ())
        elif m[2]:
            tag = m[2].lower()
            if tag in RAW or tag == "head":
                if not (m[3] or "").endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>" if tag != "head" else r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                    if tag == "head" and not end:
                        continue
                    at = end.end() if end else size
                continue
            if tag in MATH:
                continue
            if tag in HIDDEN:
                if tag not in hidden:
                    hidden[tag] = pairs(tag)
                at = max(at, hidden[tag].get(m.start(), at))
                continue
            if tag in VOID:
                nodes[stack[-1]].items.append(" " if tag in INLINE else "\n")
                if tag == "hr":
                    close({"p"}, _P_SCOPE)
                continue
            if tag == "html" and stack == [0]:
                continue
            if tag in _P_ENDERS:
                close({"p"}, _P_SCOPE)
                if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    close({"h1", "h2", "h3", "h4", "h5", "h6"}, _P_ENDERS - {"h1", "h2", "h3", "h4", "h5", "h6"})
            if tag in ENDS:
                close(*ENDS[tag])
            up = stack[-1]
            nodes.append(Node(tag, up, nodes[up].depth + 1, _hints(m[3]) if m[3] else 0))
            nodes[up].children.append(len(nodes) - 1)
            nodes[up].items.append(len(nodes) - 1)
            if not (m[3] or "").endswith("/") or tag not in ("path", "rect", "circle"):
                open_.setdefault(tag, []).append(len(stack))
                stack.append(len(nodes) - 1)
    text(size)
    return nodes


def features(pages: list[list[Node]]) -> np.ndarray:
    """A row for each node of each page: tag and attribute words of it and of what is above, depth, text and links below, siblings."""
    n = sum(map(len, pages))
    chars, links, tags, paragraphs, commas, own, above, place, before, up, root = ([0] * n for _ in range(11))
    siblings, biggest = [1] * n, [1] * n
    base = 0
    for nodes in pages:
        for i in range(len(nodes) - 1, -1, -1):
            node, size, stops, k = nodes[i], 0, 0, base + i
            for x in node.items:
                if type(x) is str:
                    size += len(x.strip())
                    stops += x.count(",") + x.count(".")
            own[k] = size
            chars[k] += size
            commas[k] += stops
            if node.tag == "a":
                links[k] = chars[k]
            elif node.tag == "p":
                paragraphs[k] += 1
            root[k] = base
            up[k] = above_ = base + max(node.parent, 0)
            if node.parent >= 0:
                chars[above_] += chars[k]
                links[above_] += links[k]
                tags[above_] += tags[k] + 1
                paragraphs[above_] += paragraphs[k]
                commas[above_] += commas[k]
        for i, node in enumerate(nodes):
            if node.children:
                mask = above[base + i] | node.hints | _GROUP_BIT.get(node.tag, 0)
                k, last = len(node.children), 0
                most = max([chars[base + c] for c in node.children]) or 1
                for j, c in enumerate(node.children, base):
                    c += base
                    above[c], place[c], siblings[c], biggest[c], before[c] = mask, j - base, k, most, last
                    last = chars[c]
        base += len(nodes)
    nodes = [x for page in pages for x in page]
    up, root = np.array(up, np.int64), np.array(root, np.int64)
    c, o, lk, tg, pg, cm, pl, sb, bg, bf = (np.array(v, np.float32) for v in (chars, own, links, tags, paragraphs, commas, place, siblings, biggest, before))
    one = np.maximum(c, 1)
    number = [np.array([x.depth for x in nodes], np.float32), np.log1p(c), np.log1p(o), lk / one, np.log1p(tg), c / (1 + tg) / 100, c / one[root], np.log1p(pg), cm / one * 20, np.array([len(x.children) for x in nodes], np.float32)]
    number += [sb, lk[up] / one[up], c / one[up], np.log1p(c[up]), pl / np.maximum(sb - 1, 1), pl, c / bg, bf / bg]
    number += [np.array([x.tag in INLINE for x in nodes], np.float32), np.array([x.tag == "body" or x.parent < 0 for x in nodes], np.float32)]
    kinds = np.zeros((n, len(TAGS) + 1), np.float32)
    kinds[np.arange(n), [_TAG.get(x.tag, len(TAGS)) for x in nodes]] = 1
    bits = lambda masks, size: (np.array(masks)[:, None] >> np.arange(size) & 1).astype(np.float32)
    return np.concatenate([np.stack(number, 1), kinds[:, :-1], bits([x.hints for x in nodes], len(HINTS)), bits(above, len(HINTS) + len(_GROUPS))], 1)


@dataclass
class Trees:
    """Boosted trees of one depth for log-odds. split: feature and threshold of each inner node, in heap order; leaf: values."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while True:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
                if at[0] >= len(f) if len(at) else True:
                    break
            out += leaf[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 50, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss, splits at quantiles."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    n, m = coded.shape
    few = np.array([len(c) <= 1 for c in cuts])  # sums of these are matrix products
    wide, flags = np.flatnonzero(~few), coded[:, few].astype(float)
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    score, inner = np.full(n, start), 2**depth - 1
    fs, ts, ls = [], [], []
    offset = np.arange(len(wide)) * bins
    slots = (coded[:, wide] + offset).astype(np.int32)

    def sums(rows: np.ndarray, node: np.ndarray, width: int, v: np.ndarray) -> np.ndarray:
        """By node and feature, the sum of v over rows up to each bin."""
        v, size = v[rows], len(wide) * bins
        out = np.empty((width, m, bins))
        slot = (slots[rows] + (node * size).astype(np.int32)[:, None]).ravel()
        out[:, wide] = np.bincount(slot, np.repeat(v, len(wide)), minlength=width * size).reshape(width, len(wide), bins).cumsum(2)
        total = np.bincount(node, v, minlength=width)[:, None]
        out[:, few, 1:] = total[:, :, None]
        out[:, few, 0] = total - ((node[:, None] == np.arange(width)) * v[:, None]).T @ flags[rows]
        return out

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        before = None
        for level in range(depth):
            first = 2**level - 1
            width = 2**level
            # A right child's sums are its parent's less the left child's.
            rows = np.flatnonzero((at - first) % 2 == 0)
            left = [sums(rows, (at[rows] - first) // 2, max(1, width // 2), v) for v in (g, h)]
            before = [np.stack([a, b - a], 1).reshape(width, m, bins) for a, b in zip(left, before)] if level else left
            G, H = before
            Gt, Ht = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + ridge) + (Gt - G) ** 2 / (Ht - H + ridge) - Gt**2 / (Ht + ridge)
            gain[:, :, -1] = 0
            gain[(H < 1) | (Ht - H < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = -rate * np.bincount(at - inner, g, minlength=inner + 1) / (np.bincount(at - inner, h, minlength=inner + 1) + ridge)
        score += leaf[at - inner]
        fs.append(feature)
        ts.append(threshold)
        ls.append(leaf)
    return Trees(start, np.array(fs), np.array(ts), np.array(ls))


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[bool]:
    """The likeliest choice in which all below a dropped node are dropped. A node's say grows with the text below it."""
    n = len(nodes)
    keep = np.clip(log_odds, -8, 8).tolist()  # gain of keeping over dropping, own and best below
    for i in range(n - 1, 0, -1):
        if keep[i] > 0:
            keep[nodes[i].parent] += keep[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and keep[i] > 0
    return kept


def blocks(nodes: list[Node], kept: list[bool]) -> str:
    """Text of kept nodes: character references decoded, white space in a block made one space, a block a line."""
    lines, line = [], []

    def end() -> None:
        if line:
            if text := " ".join(html.unescape("".join(line)).split()):
                lines.append(text)
            line.clear()

    todo: list = [(0, 0)]
    while todo:
        i, k = todo.pop()
        node = nodes[i]
        inline = node.tag in INLINE
        if not k and not inline:
            end()
        while k < len(node.items):
            x = node.items[k]
            k += 1
            if type(x) is str:
                if x == "\n" and not inline:
                    end()
                line.append(x)
            elif kept[x]:
                todo.append((i, k))
                todo.append((x, 0))
                break
            elif nodes[x].tag not in INLINE:
                end()
        else:
            if not inline:
                end()
    end()
    return "\n".join(lines)


class _Pages:
    """Writes pages of which it knows the main text: elements of the article carry the mark k="1", as do those above."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice("bcdfglmnprst") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 4))) for _ in range(400)]

    def say(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = [self.r.choice(self.words) + ("," if self.r.random() < 0.08 else ". " if self.r.random() < 0.08 else "") for _ in range(n)]
        return " ".join(out).capitalize() + self.r.choice([".", ".", "", "!"])

    def el(self, tag: str, inner: str, keep: bool = False, hints: str = "") -> str:
        name = f' {self.r.choice(["class", "class", "id"])}="{hints}"' if hints else ""
        return f"<{tag}{name}{' k=1' if keep else ''}>{inner}</{tag}>"

    def hint(self, k: int) -> str:
        words = HINTS[k].split()
        return self.r.choice(["", "", "main-", "js-", "c-", "the_", "box-"]) + self.r.choice(words) + self.r.choice(["", "", "-box", "-list", "-1", " clearfix", "-wrapper"])

    def link_list(self, keep: bool = False) -> str:
        items = [self.el("li", self.el("a", self.say(1, 4), keep), keep) for _ in range(self.r.randint(2, 10))]
        return self.el("ul", "".join(items), keep)

    def paragraph(self, keep: bool) -> str:
        text = self.say(*self.r.choice([(3, 12), (10, 60), (40, 160)]))
        if self.r.random() < 0.3:
            text += " " + self.el(self.r.choice(["b", "i", "em", "strong", "a", "span"]), self.say(1, 6), keep) + " " + self.say(2, 20)
        if self.r.random() < 0.1:
            text = self.el("b", text, keep) + "<br>"
        return f"<p{' k=1' if keep else ''}>{text}" + ("" if self.r.random() < 0.15 else "</p>")

    def boilerplate(self, kind: int) -> str:
        r = self.r
        by_tag = {1: "nav", 5: "aside", 6: "header", 7: "footer", 9: "form"}
        if kind in by_tag and r.random() < 0.6:
            tag, hints = by_tag[kind], r.choice(["", "", self.hint(kind)])
        else:
            tag, hints = r.choice(["div", "div", "section", "aside" if kind in (2, 4, 5) else "div"]), self.hint(kind)
        if kind == 1:
            inner = r.choice([self.link_list, lambda: " | ".join(self.el("a", self.say(1, 3)) for _ in range(r.randint(3, 9)))])()
        elif kind == 3:
            one = lambda: self.el("div", self.el("b", self.say(1, 2)) + self.paragraph(False) + r.choice(["", self.el("a", "Reply")]), hints=r.choice(["", self.hint(3)]))
            inner = self.el(r.choice(["h2", "h3"]), self.say(1, 3)) + "".join(one() for _ in range(r.randint(1, 7)))
        elif kind == 9:
            inner = self.el("label", self.say(1, 4)) + '<input name="q">' + self.el("button", self.say(1, 2))
        elif kind == 7:
            inner = "&copy; " + self.say(2, 20) + r.choice(["", self.link_list()])
        elif kind == 6:
            inner = self.el(r.choice(["h1", "div", "a", "p"]), self.say(1, 5)) + r.choice(["", self.link_list()])
        elif kind == 5:
            inner = self.el("h3", self.say(1, 4)) + r.choice([self.link_list(), self.paragraph(False), self.paragraph(False) + self.paragraph(False)])
        else:
            inner = r.choice([self.say(2, 40), self.paragraph(False), self.el("p", self.say(3, 30)) + self.el("a", self.say(1, 3))])
        return self.el(tag, inner, hints=hints)

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            title = self.el(r.choice(["h1", "h1", "h2"]), self.say(2, 14), True)
            out.append(self.el("header", title, True) if r.random() < 0.15 else title)
        for _ in range(r.choice([0, 1, 1, 2, 4, 8, 16])):
            x = r.random()
            if x < 0.78:
                out.append(self.paragraph(True))
            elif x < 0.84:
                out.append(self.el(r.choice(["h2", "h3"]), self.say(1, 8), True))
            elif x < 0.9:
                out.append(self.el(r.choice(["ul", "ol"]), "".join(self.el("li", self.say(3, 25), True) for _ in range(r.randint(2, 6))), True))
            elif x < 0.93:
                out.append(self.el("blockquote", self.paragraph(True), True))
            elif x < 0.95:
                out.append(self.el("table", "".join(self.el("tr", "".join(self.el("td", self.say(1, 5), True) for _ in range(3)), True) for _ in range(3)), True))
            else:
                out.append(self.el("figure", '<img src="x.png">' + self.el("figcaption", self.say(3, 15), True), True))
            if r.random() < 0.06:
                out.append(self.boilerplate(r.choice([2, 2, 4, 5, 8, 9])))
        if not out:
            out.append(self.paragraph(True))
        if r.random() < 0.15:
            out.append(self.boilerplate(r.choice([3, 5, 8])))
        tag = r.choice(["article", "article", "main", "div", "section"])
        return self.el(tag, "".join(out), True, "" if tag in ("article", "main") and r.random() < 0.7 else self.hint(0))

    def page(self) -> str:
        r = self.r
        before = [self.boilerplate(k) for k in (6, 1, 2, 4, 9, 5) if r.random() < 0.4]
        after = [self.boilerplate(k) for k in (3, 5, 2, 8, 4, 1, 7) if r.random() < 0.4]
        r.shuffle(before)
        body = self.article()
        for _ in range(r.choice([0, 0, 1, 2])):
            side = r.random()
            if side < 0.3 and after:
                body += after.pop(0)
            elif side < 0.5 and before:
                body = before.pop() + body
            body = self.el(r.choice(["div", "div", "main", "section"]), body, True, r.choice(["", "wrapper", "container", "page", "layout-grid", self.hint(0)]))
        return f"<!DOCTYPE html><html><head><title>{self.say(1, 5)}</title></head><body k=1>" + "".join(before) + body + "".join(after) + "</body></html>"


@functools.cache
def model(pages: int = 900, seed: int = 11) -> Trees:
    """Trees fitted on so many written pages. The same on every machine."""
    maker, parsed, ys = _Pages(seed), [], []
    for _ in range(pages):
        page = maker.page()
        marks = [bool(m[2]) for m in re.finditer(r"<([a-z][a-z0-9]*)[^>]*?( k=1)?>", page.partition("</head>")[2]) if m[1] not in VOID]
        nodes = parse(page.replace(" k=1", ""))
        assert len(nodes) == len(marks) + 1
        parsed.append(nodes)
        ys.append(np.array([1.0, *marks]))
    return boost(features(parsed), np.concatenate(ys))


def extract(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    odds = np.split(trees.log_odds(features(parsed)), np.cumsum([len(nodes) for nodes in parsed])[:-1])
    return [blocks(nodes, decode(nodes, o)) for nodes, o in zip(parsed, odds)]


def _extract(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plotweave.llm.html_text import extract

        for batch in batches:
            pages = batch["html"].to_pylist()
            texts = [t for at in range(0, len(pages), 64) for t in extract(pages[at : at + 64], trees)]
            own = batch.drop_columns(["html"])
            yield own.append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))

    return run


def extract_pages(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages.

    Null html and empty html: empty text. Very long pages: whole, in time linear in their length; 64 pages are held at a time.
    Null page_id or url stays null. Repeated rows: each by itself, with equal results. No rows: no rows. Other columns are
    ignored, whatever they are called.
    """
    ready(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extract(trees or model()), rows.drop("html").schema.add("text", "string").add("n_chars", "long"))


def op10(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
