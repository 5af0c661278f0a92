"""HTML extraction with gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into block-level nodes.  Boosted trees give each node's chance to be a piece of
the main text from its tag, attribute tokens, depth, siblings, the density of text and links in
its subtree, and the tokens of its ancestors.  Decoding then picks the most likely consistent states
from the root down: undecided nodes may hold anything, below a main node only main and dropped
nodes may follow, below a dropped node all is dropped.  The trees are trained on generated pages
whose blocks are known; fit() takes any other pages with labels.

Defined results: a null or empty page, one without text and one whose text is all dropped give an
empty text; unclosed, misnested and unknown tags are accepted; an unclosed script, style, title or
textarea ends with the page, of other elements whose content is no text only the tag is skipped if
they are not closed before the next of their name; what stands before the first tag is text of the root; an
empty table gives an empty result; further columns pass through extracted() unless they are
named text, which is replaced.  Time and memory grow with a page's length, however deep it is.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import loaded, pieces, shared_value, table

TREES, DEPTH, RATE, BINS = 60, 4, 0.3, 16
#: Hash buckets of a node's own attribute tokens and of its ancestors'.
OWN, ABOVE = 192, 96
TRAIN_PAGES = 900
#: Log-odds that a node must offer to be dropped below a main node.
DROP_COST = 2.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
#: Those of them whose content ends at their own end tag only, or with the page.
OPAQUE = frozenset("script style textarea title".split())
BLOCKS = (
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th nav header footer aside form "
    "fieldset blockquote pre figure figcaption address details summary hgroup button label head"
).split()
_BLOCK_NUMBER = {t: k for k, t in enumerate(BLOCKS)}
_CLOSES_P = frozenset(BLOCKS) - {"button", "label"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl table body html div section article nav aside header footer main form".split())
_GROUPS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "li", "blockquote", "pre", "td", "figure", "button", "label", "fieldset", "address", "head"]
NUMERIC = ["depth", "index", "siblings", "same_tag", "text", "link_share", "blocks", "mean_block", "stops", "page_share", "place", "tags_per_text", "heading", "list", "own_text", "sibling_text"]
#: Flags: the node's tag, tags above it, its attribute tokens, and those of the nodes above it.
_IS, _IN, _OWN = 0, len(_GROUPS), len(_GROUPS) + 8
_ABOVE = _OWN + OWN
FLAGS = _ABOVE + ABOVE
_FLAG_BYTES = -(-FLAGS // 8)
#: Nodes whose features are laid out and scored at once.
NODES = 1 << 12


_buckets: dict[tuple[str, int], int] = {}


def _bucket(token: str, size: int) -> int:
    """A bucket by the token's bytes; those of many tokens are kept."""
    got = _buckets.get((token, size))
    if got is None:
        n = 0
        for c in token.encode():
            n = (n * 31 + c) & 0xFFFFFFFF
        got = ((n * 2654435761) & 0xFFFFFFFF) * size >> 32
        if len(_buckets) < 1 << 16:
            _buckets[token, size] = got
    return got


#: The next start or end tag of each name; group 1 is "/" in an end tag.
_RAW_TAG = {name: re.compile(rf"<(/?){name}\b[^>]*>", re.I) for name in RAW}


def laid_out(numbers: np.ndarray, flags: list[int]) -> np.ndarray:
    """Feature rows of nodes: numbers, then flags."""
    bits = np.frombuffer(b"".join(f.to_bytes(_FLAG_BYTES, "little") for f in flags), np.uint8).reshape(-1, _FLAG_BYTES)
    return np.concatenate((numbers, np.unpackbits(bits, axis=1, count=FLAGS, bitorder="little")), 1, dtype=np.float32)


class Page:
    """Block-level nodes in page order, each with its parent, tokens and text runs."""

    __slots__ = ("tag", "parent", "tokens", "runs", "texts")

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens = ["html"], [-1], [()]
        self.runs: list[list] = []  # [node, raw text, characters in links]
        stack: list[tuple[str, int, int]] = [("html", 0, 0)]  # name, own node or -1, node that text belongs to
        opened: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
        scopes = [0]  # and of those that end tags of inline elements do not reach beyond
        node, at, links, run, last = 0, 0, 0, None, source.rfind(">") + 1

        def close(k):
            nonlocal node, links, run
            for name, number, _ in stack[k:]:
                opened[name].pop()
                if name in _SCOPE:
                    scopes.pop()
                links -= name == "a"
                if number >= 0:
                    run = None
            del stack[k:]
            node = stack[-1][2]

        while m := _TOKEN.search(source, at, last):
            if m.start() > at:
                piece = source[at : m.start()]
                if run is None:
                    run = [node, [], 0]
                    self.runs.append(run)
                run[1].append(piece)
                run[2] += len(piece) if links else 0
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:  # an end tag closes the nearest open element of its name
                if places := opened.get(name):
                    if name in _SCOPE or places[-1] > scopes[-1]:
                        close(places[-1])
                continue
            if name in RAW:
                if not (m[3] or m[6] or "").endswith("/"):
                    end = _RAW_TAG[name].search(source, at)
                    if name in OPAQUE:
                        while end and not end[1]:
                            end = _RAW_TAG[name].search(source, end.end())
                        at = end.end() if end else len(source)
                    elif end and end[1]:
                        at = end.end()
                continue
            if name in VOID:
                if run is not None and name in ("br", "hr"):
                    run[1].append(" ")
                    run = None if name == "hr" else run
                continue
            if name in _CLOSES_P or name in _SIBLINGS:
                ends = {*_SIBLINGS.get(name, ()), *(("p",) if name in _CLOSES_P else ())}
                top = max((opened[e][-1] for e in ends if opened.get(e)), default=0)
                if top > scopes[-1]:
                    close(top)
            number = -1
            if name in _BLOCK_NUMBER:
                number = len(self.tag)
                words = []
                for a in _ATTRIBUTE.finditer(m[3] or m[6] or ""):
                    words += [p.lower() for p in _PART.findall(a[1] or a[2] or a[3] or "")]
                self.tag.append(name)
                self.parent.append(node)
                self.tokens.append(tuple(words))
                node, run = number, None
            links += name == "a"
            opened.setdefault(name, []).append(len(stack))
            if name in _SCOPE:
                scopes.append(len(stack))
            stack.append((name, number, node))
        if at < len(source):
            if run is None:
                run = [node, [], 0]
                self.runs.append(run)
            run[1].append(source[at:])
        self.texts = []
        for node, raw, linked in self.runs:
            text = " ".join(html.unescape("".join(raw)).split())
            if text:
                self.texts.append((node, text, linked))

    def numbers(self) -> np.ndarray:
        """The numeric features of all nodes."""
        n, parent, tag = len(self.tag), self.parent, self.tag
        text, link, blocks, stops, own = ([0] * n for _ in range(5))
        first, total = [-1] * n, 0
        for node, t, linked in self.texts:
            own[node] += len(t)
            link[node] += min(linked, len(t))
            blocks[node] += 1
            stops[node] += t.count(". ") + t.count(", ") + (t[-1] in ".!?")
            if first[node] < 0:
                first[node] = total
            total += len(t)
        text, depth, tags = own.copy(), [0] * n, [1] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
            children[parent[k]].append(k)
        for k in range(n - 1, 0, -1):  # children come after their parents
            p = parent[k]
            text[p] += text[k]
            link[p] += link[k]
            blocks[p] += blocks[k]
            stops[p] += stops[k]
            tags[p] += tags[k]
            if first[k] >= 0 and (first[p] < 0 or first[k] < first[p]):
                first[p] = first[k]
        x = np.zeros((n, len(NUMERIC)), np.float32)
        for group in children:
            for i, c in enumerate(group):
                x[c, 1], x[c, 2] = i, len(group)
                x[c, 3] = sum(tag[o] == tag[c] for o in group[max(0, i - 2) : i + 3]) - 1
        text, link, blocks, stops, own, first = (np.array(v, float) for v in (text, link, blocks, stops, own, first))
        some = np.maximum(text, 1)
        x[:, 0], x[:, 4], x[:, 5], x[:, 6] = depth, np.log1p(text), link / some, blocks
        x[:, 7], x[:, 8], x[:, 9] = np.log1p(text / np.maximum(blocks, 1)), stops / some * 100, text / max(total, 1)
        x[:, 10], x[:, 11], x[:, 14] = first / max(total, 1), np.array(tags) / some * 100, np.log1p(own)
        x[:, 12] = [t[0] == "h" and t[1:].isdigit() for t in tag]
        x[:, 13] = [t in ("ul", "ol", "dl") for t in tag]
        if n > 1:
            x[1:, 15] = np.log1p(text[np.array(parent[1:])] - text[1:])
        return x

    def flags(self) -> list[int]:
        """The yes-or-no features of all nodes, as bits of whole numbers."""
        group = {g: 1 << (_IS + i) for i, g in enumerate(_GROUPS)}
        inside = {g: 1 << (_IN + i) for i, g in enumerate(_GROUPS[:8])}
        handed, out = [], []  # what a node's children get, and what it has
        for tag, p, tokens in zip(self.tag, self.parent, self.tokens, strict=True):
            above = handed[p] if p >= 0 else 0
            own, give = above | group.get(tag, 0), above | inside.get(tag, 0)
            for w in tokens:
                own |= 1 << (_OWN + _bucket(w, OWN))
                give |= 1 << (_ABOVE + _bucket(w, ABOVE))
            out.append(own)
            handed.append(give)
        return out

    def states(self, chance: np.ndarray) -> np.ndarray:
        """2 for main nodes, 1 for dropped ones, 0 for undecided ones; the likeliest consistent choice."""
        n = len(self.tag)
        p = np.clip(chance, 1e-4, 1 - 1e-4)
        yes, no = np.log(p), np.log(1 - p)
        main, drop, free = yes.copy(), no.copy(), no.copy()
        for k in range(n - 1, 0, -1):
            q = self.parent[k]
            main[q] += max(main[k], drop[k] - DROP_COST)
            drop[q] += drop[k]
            free[q] += max(free[k], main[k], drop[k])
        out = np.zeros(n, np.int8)
        for k in range(n):
            above = out[self.parent[k]] if k else 0
            if above == 1:
                out[k] = 1
            elif above == 2:
                out[k] = 2 if main[k] >= drop[k] - DROP_COST else 1
            else:
                out[k] = 0 if free[k] >= max(main[k], drop[k]) else 2 if main[k] >= drop[k] else 1
        return out

    def text(self, chance: np.ndarray) -> str:
        state = self.states(chance)
        return "\n\n".join(t for node, t, _ in self.texts if state[node] == 2)


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, by histograms of feature bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.cuts = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])) for v in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        some = np.flatnonzero([len(c) > 0 and (b != b[0]).any() for c, b in zip(self.cuts, binned.T, strict=True)])
        share = float((weight * y).sum() / weight.sum())
        self.base, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, some, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            score += self._add(tree, x)

    def _tree(self, binned, some, gradient, hessian):
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        limit = np.full(2**DEPTH - 1, BINS)
        leaf = np.zeros(len(gradient), np.int64)
        flat = binned[:, some] + np.arange(len(some)) * BINS
        size = len(some) * BINS
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = (flat + ((leaf - first) * size)[:, None]).ravel()
            left_g, left_h = (np.cumsum(np.bincount(at, np.repeat(v, len(some)), minlength=width * size).reshape(width, len(some), BINS), 2) for v in (gradient, hessian))
            total_g, total_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            for node, k in enumerate(gain.reshape(width, -1).argmax(1)):
                f, c = int(some[k // BINS]), int(k % BINS)
                if gain[node].ravel()[k] > 1e-3 and c < len(self.cuts[f]):
                    feature[first + node], cut[first + node] = f, self.cuts[f][c]
                    limit[first + node] = c
            values = binned[np.arange(len(leaf)), feature[leaf]]
            leaf = 2 * leaf + 1 + (values > limit[leaf])
        number = leaf - (2**DEPTH - 1)
        value = RATE * np.bincount(number, gradient, minlength=2**DEPTH) / (np.bincount(number, hessian, minlength=2**DEPTH) + 1)
        return feature, cut, value

    @staticmethod
    def _add(tree, x):
        feature, cut, value = tree
        leaf = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            leaf = 2 * leaf + 1 + (x[rows, feature[leaf]] > cut[leaf])
        return value[leaf - (2**DEPTH - 1)]

    def chance(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._add(tree, x)
        return 1 / (1 + np.exp(-score))


MAIN = "\x01"  # marks main text in generated pages
#: Weight of a heading against other nodes: few they are, and an article without its title lacks much.
HEADING = 3.0
#: Share of generated pages that are short articles of any blocks with little around them.
PLAIN = 0.4


def training_page(rng: np.random.Generator) -> str:
    """A page of invented words with many kinds of surroundings; words of the main text are marked."""

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def some(n, main=False):
        odd = 0.05 if rng.random() < 0.1 else 0.0  # some runs of words have character references and signs among them
        word = lambda: pick("&#x4e2d;", "&hellip;", "&amp;", "3.14", "x=1;", "&#8211;") if odd and rng.random() < odd else "".join(pick("ba", "re", "ti", "on", "ka", "lu", "es", "an", "mo") for _ in range(int(rng.integers(1, 5))))
        return " ".join((MAIN if main else "") + word() for _ in range(n))

    def sentence(n, main=False):
        return some(max(2, n // 2), main) + pick(", ", " ") + some(max(1, n // 2), main) + pick(".", ".", "!", "?")

    def names(*options):
        return pick(f' class="{pick(*options)}"', f' class="{pick("x", "box", "col", "wrap")} {pick(*options)}"', f' id="{pick(*options)}"', f' class="{pick("site", "page", "block", "the")}-{pick(*options)}"')

    def links(n):
        return "".join(f'<li><a href="/{some(1)}">{some(int(rng.integers(1, 4)))}</a></li>' for _ in range(n))

    def item(tag, attributes, body):
        return f"<{tag}{attributes}>{body}</{tag}>" if rng.random() < 0.97 else f"<{tag}{attributes}>{body}"

    def menu():
        return pick(item("nav", pick("", names("nav", "menu")), f"<ul>{links(int(rng.integers(3, 9)))}</ul>"), f"<ul{names('menu', 'nav', 'navigation', 'breadcrumb')}>{links(int(rng.integers(2, 8)))}</ul>", f"<div{names('nav', 'menu', 'topbar', 'breadcrumbs')}><ul>{links(5)}</ul></div>")

    def header():
        return pick(f"<header{pick('', names('header', 'masthead', 'branding'))}><a href=\"/\">{some(2)}</a><p>{sentence(6)}</p></header>", f"<div{names('header', 'masthead', 'banner')}><h2>{some(3)}</h2>{sentence(5)}</div>", f"<header><h1>{some(2)}</h1>{menu()}</header>")

    def footer():
        return pick(f"<footer{pick('', names('footer'))}>&copy; {some(2)} &middot; {sentence(int(rng.integers(3, 30)))}</footer>", f"<div{names('footer', 'copyright', 'bottom', 'colophon')}><p>&copy; {some(3)}</p><p>{sentence(9)}</p></div>")

    def aside():
        return pick(f"<aside{pick('', names('sidebar'))}><h3>{some(2)}</h3><p>{sentence(int(rng.integers(5, 40)))}</p></aside>", f"<div{names('sidebar', 'widget', 'related', 'recommended', 'share', 'social', 'tags', 'author', 'newsletter', 'subscribe')}><h4>{some(2)}</h4>{pick('<ul>' + links(4) + '</ul>', '<p>' + sentence(15) + '</p>')}</div>")

    def advert():
        return pick(f"<div{names('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsor', 'sponsored', 'promo', 'promotion')}>{pick(sentence(int(rng.integers(3, 40))), '<p>' + sentence(12) + '</p>')}</div>", f"<aside class=\"ad\">{sentence(8)}</aside>", f"<p{names('ad', 'promo', 'sponsored')}>{sentence(9)}</p>")

    def notice():
        tag = pick("div", "section")
        return f"<{tag}{names('notice', 'cookie', 'cookies', 'consent', 'alert', 'popup', 'modal', 'disclaimer', 'warning', 'paywall', 'message')}><p>{sentence(int(rng.integers(6, 30)))}</p>{pick('<button>' + some(1) + '</button>', '')}</{tag}>"

    def form():
        return f"<form{pick('', names('search', 'login', 'signup', 'contact', 'form'))}><label>{some(2)}</label><input name=\"q\"><p>{sentence(6)}</p><button>{some(1)}</button></form>"

    def comments():
        tag, inner = pick("div", "section", "ol"), pick("div", "li", "article")
        one = "".join(f"<{inner}{names('comment', 'reply', 'comment-body')}><b>{some(1)}</b><p>{sentence(int(rng.integers(4, 50)))}</p></{inner}>" for _ in range(int(rng.integers(1, 5))))
        return f"<{tag}{names('comments', 'comment-list', 'responses', 'discussion', 'replies', 'disqus')}><h3>{some(2)}</h3>{one}</{tag}>"

    def paragraph():
        body = sentence(int(rng.integers(1, 90)), True)
        for _ in range(int(rng.integers(0, 3))):
            body += " " + sentence(int(rng.integers(2, 30)), True)
        kind = rng.random()
        if kind < 0.1:
            return f"<p><b>{body}<br><p>{sentence(10, True)}</p>"
        if kind < 0.15:
            level = pick(2, 3)
            return f"<h{level}>{some(int(rng.integers(1, 5)), True)}</h{level}><p>{body}</p>"
        if kind < 0.2:
            return "<ul>" + "".join(f"<li>{sentence(8, True)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        if kind < 0.24:
            return f"<blockquote><p>{body}</p></blockquote>"
        if kind < 0.27:
            return f"<pre>{some(20, True)}</pre>"
        if kind < 0.3:
            return "<table>" + "".join(f"<tr><td>{some(2, True)}</td><td>{some(3, True)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.35:
            return f"<p>{sentence(9, True)} <a href=\"/x\">{some(2, True)}</a> {body}</p>"
        if kind < 0.4:
            return f"<div>{body}</div>"
        if kind < 0.48:
            return block()
        return f"<p{pick('', '', '', names('text', 'para', 'lead', 'intro'))}>{body}</p>"

    def block():
        """Blocks of an article other than paragraphs: lists, definitions, code, tables, headings, quotations, lines that are one link."""
        many = range(int(rng.integers(1, 7)))
        line = lambda: pick(sentence(int(rng.integers(2, 16)), True), some(int(rng.integers(1, 6)), True))
        linked = lambda: f'<a href="/{some(1)}">{line()}</a>'
        return pick(
            *(f"<{tag}>" + "".join(f"<li>{pick(line, line, line, linked)()}</li>" for _ in many) + f"</{tag}>" for tag in ("ul", "ol")),
            "<dl>" + "".join(f"<dt>{some(2, True)}</dt><dd>{line()}</dd>" for _ in many) + "</dl>",
            f"<pre>{pick('', '<code>')}" + "\n".join(some(int(rng.integers(1, 8)), True) for _ in many) + "</pre>",
            "<table>" + f"<tr><th>{some(1, True)}</th><th>{some(2, True)}</th></tr>" * int(rng.integers(0, 2)) + "".join(f"<tr><td>{some(2, True)}</td><td>{line()}</td></tr>" for _ in many) + "</table>",
            f"<h{pick(1, 2, 3, 4)}>{some(int(rng.integers(1, 8)), True)}</h1>", f"<blockquote>{line()}</blockquote>",
            f"<p>{linked()}</p>", f"<p>{linked()}</p>", f"<figure><img src=x><figcaption>{line()}</figcaption></figure>", f"<div>{line()}</div>", f"<p>{line()}</p>",
        )

    def plain_article():
        """A short article of any blocks, with or without a heading and a wrapper."""
        n = int(rng.integers(1, 7))
        kinds = [pick(block, paragraph, lambda: f"<p>{sentence(int(rng.integers(2, 20)), True)}</p>") for _ in range(n)]
        parts = [f"<h{pick(1, 1, 1, 2)}>{some(int(rng.integers(1, 9)), True)}</h1>"] * (rng.random() < 0.7) + [kind() + (pick(advert, aside, comments, notice)() if rng.random() < 0.15 else "") for kind in kinds]
        wrapper = pick("", "", "", "article", "article", "main", "div", "section")
        attributes = pick("", "", names("content", "article", "post", "entry")) if wrapper else ""
        return f"<{wrapper}{attributes}>{''.join(parts)}</{wrapper}>" if wrapper else "".join(parts)

    if rng.random() < PLAIN:
        around = [f() for f in (menu, header, advert, notice, aside) if rng.random() < 0.15]
        after = [f() for f in (aside, comments, advert, footer) if rng.random() < 0.2]
        page = "".join(around) + plain_article() + "".join(after)
        return pick(f"<html><head><title>{some(3)}</title></head><body>{page}</body></html>", f"<body>{page}</body>", page)
    body = []
    short = rng.random() < 0.3
    for _ in range(1 if short else int(rng.integers(1, 25))):
        body.append(f"<p>{pick('', '<b>')}{sentence(int(rng.integers(1, 14)), True)}</p>" if short else paragraph())
        if not short and rng.random() < 0.06:
            body.append(pick(advert, aside, form, notice)())
    head = f"<h1>{some(int(rng.integers(1, 9)), True)}</h1>" if rng.random() < 0.85 else ""
    if rng.random() < 0.15:
        body.append(comments())
    tag = pick("article", "article", "article", "main", "div", "section", "div")
    attributes = names("content", "article", "post", "entry", "story", "main", "body", "text") if tag in ("div", "section") else pick("", "", names("content", "post", "entry"))
    main = f"<{tag}{attributes}>{head}{''.join(body)}</{tag}>"
    if rng.random() < 0.06:
        main = head + "".join(b for b in body)
    before = [f() for f in (menu, header, advert, notice, form, aside) if rng.random() < 0.4]
    after = [f() for f in (aside, advert, comments, form, menu, notice) if rng.random() < 0.3] + ([footer()] if rng.random() < 0.85 else [])
    if rng.random() < 0.6:
        before = [f() for f in (menu, advert) if rng.random() < 0.9]
    rng.shuffle(before)
    page = "".join(before) + main + "".join(after)
    for _ in range(int(rng.integers(0, 3))):
        page = f"<div{pick('', names('wrap', 'container', 'page', 'row', 'col'))}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{some(4)}</title><style>p{{margin:0}}</style></head><body>{page}</body></html>"


def labelled_nodes(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """1 for nodes that are main, 0 for others; nodes without text get no weight.

    Main are nodes with marked texts only, and from the lowest node that holds all marked text
    downwards those with marked text for the most part; body and html never are.
    """
    marked, plain = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    for node, text, _ in page.texts:
        k, words = node, text.split(" ")
        share = sum(w.startswith(MAIN) for w in words) / len(words)
        while k >= 0:
            (marked if share > 0.5 else plain)[k] += len(text)
            k = page.parent[k]
    pure = (marked > 0) & (plain == 0)
    lowest = int(np.flatnonzero(marked == marked[0])[-1]) if marked[0] else 0
    below = np.zeros(len(page.tag), bool)
    for k in range(lowest, len(page.tag)):
        below[k] = k == lowest or (page.parent[k] >= 0 and below[page.parent[k]])
    wide = np.array([t in ("html", "body") for t in page.tag])
    weight = np.where([t[0] == "h" and t[1:].isdigit() for t in page.tag], HEADING, 1.0)
    return (pure | (below & (marked > plain) & ~wide)).astype(float), weight * ((marked + plain) > 0)


def fit(pages: list[str]) -> Boosted:
    """Trees from pages whose main words carry the mark."""
    xs, ys, ws = [], [], []
    for source in pages:
        parsed = Page(source)
        y, w = labelled_nodes(parsed)
        clean = Page(source.replace(MAIN, ""))
        xs.append(laid_out(clean.numbers(), clean.flags()))
        ys.append(y)
        ws.append(w)
    return Boosted(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


@lru_cache(4)
def trained(pages: int = TRAIN_PAGES, seed: int = 5) -> Boosted:
    """Trees from generated pages; they are fitted once in a process."""
    rng = np.random.default_rng(seed)
    return fit([training_page(rng) for _ in range(pages)])


def main_texts(model: Boosted, sources: list[str | None]) -> list[str]:
    parsed = [Page(s or "") for s in sources]
    if not parsed:
        return []
    numbers, flags = np.concatenate([p.numbers() for p in parsed]), [f for p in parsed for f in p.flags()]
    chance = np.concatenate([model.chance(laid_out(numbers[k : k + NODES], flags[k : k + NODES])) for k in range(0, len(flags), NODES)])
    at = np.cumsum([0] + [len(p.tag) for p in parsed])
    return [p.text(chance[a:b]) for p, a, b in zip(parsed, at[:-1], at[1:], strict=True)]


def _extract(model, source: str, target: str):
    def run(batches):
        import pyarrow as pa

        trees = loaded(model)
        for whole in batches:
            for batch in pieces(whole, source):
                names = batch.schema.names
                got = main_texts(trees, batch.column(names.index(source)).to_pylist())
                keep = [k for k, c in enumerate(names) if c != source]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(got, pa.string())], names=[names[k] for k in keep] + [target])

    return run


def extracted(pages: DataFrame, model: Boosted, source: str = "html") -> DataFrame:
    """The main text, as column text, in place of the page's source."""
    rows = pages.drop("text")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != source]
    return rows.mapInArrow(_extract(shared_value(pages.sparkSession, model), source, "text"), ", ".join([*kept, "text string"]))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, trained()).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
