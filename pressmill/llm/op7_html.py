"""Main text of web pages by a tree-structured graphical model.

The blocks of a page's DOM are binary variables (main text or not). Each block has a unary potential from its tag, its
class and id words, its text length, link density and shape; each parent-child edge has a potential that depends on the
child's kind of tag. Sum-product messages go upward from the leaves and downward from the root, and give every block's
exact marginal; text of blocks whose marginal is above one half is kept, in page order.

Weights are trained by maximum likelihood (the gradient is observed minus expected features, the latter from the same
messages) on labelled pages: a built-in set made from layout rules with every block labelled, and a bounded sample of
the given pages whose markup labels itself with exactly one article or main element: at most PAGES_FITTED pages of at
most CHARS_FITTED characters among the CANDIDATES first ids by hash. Extraction itself reads every page whole.

Inline elements, line breaks included, belong to the block around them. Inside a block white space becomes one space;
blocks are joined by one line feed. Nothing else is dropped or capped. Markup is read in time linear in the page.

Scripts and styles reach to their end tag or, without one, to the end of the page. Of the other elements in HIDDEN that
have no end tag of their own (self-closing, unclosed, or opened again before it) only the tag is left out.

Nulls, empties, ties: null or empty html gives an empty text; unclosed, misnested and truncated markup is read as far as
it goes; repeated rows give repeated results; an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import html as htmllib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import ship, table, text_or_empty

PAGES_FITTED, CANDIDATES, CHARS_FITTED, LAYOUTS, ROUNDS, RATE, DECAY = 150, 3000, 100_000, 150, 120, 0.15, 1e-3

# Element names of the HTML standard by the part they play here.
KINDS = {
    "article": "article", "main": "article",
    "nav": "nav", "menu": "nav",
    "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "form",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "hgroup": "heading",
    "p": "text", "pre": "text", "blockquote": "text", "figcaption": "text", "address": "text",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "caption": "table", "td": "item", "th": "item",
    "div": "div", "section": "div", "center": "div", "details": "div", "summary": "div", "figure": "div", "hr": "div", "title": "head",
    "html": "root", "body": "root", "head": "head",
}
RAW = {"script", "style"}
HIDDEN = RAW | {"textarea", "title", "noscript", "template", "iframe", "svg", "select", "button", "option", "object", "canvas", "audio", "video", "math"}
NEVER = {"head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_P = {k for k, v in KINDS.items() if v not in ("root", "head", "item")} | {"li", "dt", "dd"}
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
GOOD_WORDS = re.compile(r"article|content|post|story|entry|main|body|text")
BAD_WORDS = re.compile(r"\bads?\b|advert|sponsor|promo|banner|nav|menu|sidebar|side-bar|widget|comment|reply|disqus|footer|header|masthead|cookie|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|social|related|recommend|breadcrumb|pagination|pager|toolbar|legal|copyright|tags\b")

_NAME = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_OWN_TAGS = {name: re.compile(rf"<(/?){name}(?=[\s/>])" if name in RAW else rf"(?s:<!--(?:.*?-->|.*))|<(/?){name}(?=[\s/>])", re.I) for name in HIDDEN}
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")

UNARY = ["bias"] + sorted({f"kind:{k}" for k in KINDS.values()}) + ["good", "bad", "links", "mostly_links", "long", "short", "empty", "stops"]
_UNARY_AT = {n: k for k, n in enumerate(UNARY)}
PAIR_KINDS = sorted(set(KINDS.values()))
_PAIR_AT = {n: k for k, n in enumerate(PAIR_KINDS)}


class Markup:
    """A page's tags and comments in order. What one search finds missing is not searched for again, so reading is linear."""

    def __init__(self, html: str):
        self.html, self.last_end = html, html.rfind(">")
        self.absent: set[str] = set()
        self.spans: dict[str, dict[int, int]] = {}
        self.open_ended: set[int] = set()  # places outside quotes from which no tag ends

    def _find(self, what: str, at: int) -> int:
        found = -1 if what in self.absent else self.html.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def _tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, quoted ones left out; -1 if there is none."""
        html, seen = self.html, []
        while at < self.last_end + 1 and at not in self.open_ended:
            seen.append(at)
            at = _PLAIN.match(html, at).end()
            if at < len(html) and html[at] == ">":
                return at
            at = self._find(html[at], at + 1) + 1 if at < len(html) else 0
            if not at:
                break
        self.open_ended.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(first, behind, name, closing, attributes) of the next tag or comment, the latter without a name."""
        html = self.html
        while (first := html.find("<", at)) >= 0:
            if html.startswith("<!--", first):
                end = self._find("-->", first + 4)
                return first, end + 3 if end >= 0 else len(html), "", False, ""
            if first > self.last_end:
                return None
            if html[first + 1] in "!?":
                return first, html.find(">", first) + 1, "", False, ""
            m = _NAME.match(html, first)
            end = self._tag_end(m.end()) if m else -1
            if end >= 0:
                return first, end + 1, m[1].lower(), html[first + 1] == "/", html[m.end() : end]
            at = first + 1
        return None

    def hidden_end(self, name: str, first: int, at: int) -> int:
        """Where the text hidden by an element ends whose tag begins at `first` and ends at `at`; `at` if it hides none."""
        html = self.html
        if name not in RAW:
            if name not in self.spans:
                self.spans[name] = self._spans(name)
            return self.spans[name].get(first, at)
        if "/" + name in self.absent:
            return len(html)
        m = _OWN_TAGS[name].search(html, at)
        while m and not m[1]:
            m = _OWN_TAGS[name].search(html, m.end())
        if m is None:
            self.absent.add("/" + name)
            return len(html)
        end = self._find(">", m.end())
        return end + 1 if end >= 0 else at

    def _spans(self, name: str) -> dict[int, int]:
        """Of every element of a name that is closed, where it begins and ends, elements of the same name inside it counted."""
        html, open_, spans = self.html, [], {}
        for m in _OWN_TAGS[name].finditer(html):
            if m[1] is None:
                continue
            end = self._tag_end(m.end())
            if end < 0:
                continue
            if not m[1]:
                if html[end - 1] != "/":
                    open_.append(m.start())
            elif open_:
                spans[open_.pop()] = end + 1
        return spans


class Page:
    """Blocks in page order (a parent before its children): parent, kind, hint words, and runs of text with their block."""

    def __init__(self, html: str):
        self.parent, self.tag, self.hints = [-1], ["html"], [""]
        self.runs: list[tuple[int, str]] = []
        self.linked = [0]
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack, in_link, at, size = [0], 0, 0, len(html)
        piece: list[str] = []
        links = 0
        markup = Markup(html)

        opened: Counter = Counter()  # of the tags on the stack, so that an end tag of nothing open costs no walk

        def leave(depth: int) -> None:
            opened.subtract(self.tag[k] for k in stack[depth:])
            del stack[depth:]

        def flush() -> None:
            nonlocal links
            if piece:
                text = _SPACE.sub(" ", htmllib.unescape("".join(piece))).strip()
                piece.clear()
                if text:
                    self.runs.append((stack[-1], text))
                    self.linked[stack[-1]] += links
            links = 0

        while at < size:
            found = markup.next(at)
            if found is None:
                piece.append(html[at:])
                break
            start, behind, name, closing, attributes = found
            if start > at:
                piece.append(html[at:start])
                if in_link:
                    links += start - at
            at = behind
            if not name:
                continue
            if name in HIDDEN and not closing:
                if not attributes.endswith("/") or name in RAW:
                    at = markup.hidden_end(name, start, at)
                if name == "button" or name == "select":
                    piece.append(" ")
                continue
            if name == "a":
                in_link = 0 if closing else 1
            if name == "br":
                piece.append(" ")
            if name not in KINDS:
                continue
            flush()
            if closing:
                if opened[name] > 0:
                    leave(next(d for d in range(len(stack) - 1, 0, -1) if self.tag[stack[d]] == name))
                continue
            in_link = 0
            if name in CLOSES_P and len(stack) > 1 and self.tag[stack[-1]] == "p":
                leave(len(stack) - 1)
            if name in SELF_CLOSING:
                ends, stops = SELF_CLOSING[name]
                if any(opened[x] > 0 for x in ends):
                    for depth in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[depth]] in stops:
                            break
                        if self.tag[stack[depth]] in ends:
                            leave(depth)
                            break
            if name == "html" or name == "body" and opened["body"] > 0:
                continue
            if name == "body":
                leave(1)
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.hints.append(" ".join("".join(h) for h in _HINT.findall(attributes)).lower() if attributes else "")
            self.linked.append(0)
            if name not in VOID and not attributes.endswith("/"):
                stack.append(len(self.tag) - 1)
                opened[name] += 1
        flush()

    def unary(self) -> list[list[int]]:
        """Active features of every block."""
        n = len(self.tag)
        chars, stops = [0] * n, [0] * n
        for k, text in self.runs:
            chars[k] += len(text)
            stops[k] += text.count(". ") + text.endswith((".", "!", "?"))
        total, linked = chars[:], self.linked[:]
        for k in range(n - 1, 0, -1):
            total[self.parent[k]] += total[k]
            linked[self.parent[k]] += linked[k]
        at, out = _UNARY_AT, []
        for k in range(n):
            f = [0, at["kind:" + KINDS[self.tag[k]]]]
            hints = self.hints[k]
            if hints:
                if BAD_WORDS.search(hints):
                    f.append(at["bad"])
                elif GOOD_WORDS.search(hints):
                    f.append(at["good"])
            if linked[k] > 0.2 * total[k]:
                f.append(at["links"])
            if linked[k] > 0.6 * total[k]:
                f.append(at["mostly_links"])
            f.append(at["empty"] if not chars[k] else at["long"] if chars[k] > 120 else at["short"])
            if stops[k]:
                f.append(at["stops"])
            out.append(f)
        return out


def marginals(page: Page, active: list[list[int]], unary: list[float], pair: list[list[float]]) -> tuple[list[float], list[tuple]]:
    """P(block is main text) and, for each edge, P(parent, child) of the four states, by exact messages on the tree.

    Every message is the log of its ratio of main to not; pair[kind] holds the potentials (00, 01, 10, 11) of (parent, child)."""
    n, parent = len(page.tag), page.parent
    local = [sum(unary[j] for j in f) for f in active]
    kinds = [_PAIR_AT[KINDS[t]] for t in page.tag]
    up = [0.0] * n
    belief = local[:]
    for k in range(n - 1, 0, -1):
        a, b, c, d = pair[kinds[k]]
        s = belief[k]
        up[k] = _log_add(c, d + s) - _log_add(a, b + s)
        belief[parent[k]] += up[k]
    edges = [(0.0, 0.0, 0.0, 0.0)] * n
    for k in range(1, n):
        a, b, c, d = pair[kinds[k]]
        s, outer = belief[k], belief[parent[k]] - up[k]
        belief[k] += _log_add(b, d + outer) - _log_add(a, c + outer)
        x = (a, b + s, c + outer, d + outer + s)
        top = max(x)
        e = [math.exp(v - top) for v in x]
        z = sum(e)
        edges[k] = (e[0] / z, e[1] / z, e[2] / z, e[3] / z)
    return [1 / (1 + math.exp(-max(-500.0, min(500.0, b)))) for b in belief], edges


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def train(labelled: list[tuple[str, object]]) -> tuple[list[float], list[list[float]]]:
    """labelled: (html, label of a block given page and index)."""
    seen = []
    for html, label in labelled:
        page = Page(html)
        seen.append((page, page.unary(), [int(label(page, k)) for k in range(len(page.tag))]))
    u, p = np.zeros(len(UNARY)), np.zeros((len(PAIR_KINDS), 4))
    su, sp = np.full(u.shape, 1e-8), np.full(p.shape, 1e-8)
    for _ in range(ROUNDS):
        gu, gp = -DECAY * u, -DECAY * p
        weights, pairs = u.tolist(), p.tolist()
        for page, active, truth in seen:
            m, edges = marginals(page, active, weights, pairs)
            share = 1 / len(seen)
            for k, f in enumerate(active):
                gu[f] += (truth[k] - m[k]) * share
                if k:
                    row = gp[_PAIR_AT[KINDS[page.tag[k]]]]
                    row -= np.array(edges[k]) * share
                    row[2 * truth[page.parent[k]] + truth[k]] += share
        su, sp = su + gu * gu, sp + gp * gp
        u, p = u + RATE * gu / np.sqrt(su), p + RATE * gp / np.sqrt(sp)
    return u.tolist(), p.tolist()


def _under(page: Page, k: int, tags: set[str]) -> bool:
    while k > 0:
        if page.tag[k] in tags:
            return True
        k = page.parent[k]
    return False


def _landmark_label(page: Page, k: int) -> bool:
    return _under(page, k, {"article", "main"}) and not _under(page, k, {"nav", "aside", "footer", "form", "header"}) and not any(BAD_WORDS.search(page.hints[j]) for j in _line(page, k))


def _line(page: Page, k: int) -> Iterator[int]:
    while k > 0:
        yield k
        k = page.parent[k]


def _marked_label(page: Page, k: int) -> bool:
    """Built-in pages carry their label as a word: the nearest yes or no above a block."""
    return next((w == "yes" for j in _line(page, k) for w in page.hints[j].split() if w in ("yes", "no")), False)


def layout_page(seed: int) -> str:
    """A labelled page by layout rules; the words 'yes' and 'no' in class attributes are the labels."""
    r = random.Random(seed)
    words = lambda a, b: " ".join("".join(r.choice("bdfklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + "."
    links = lambda n: "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(n))
    body = [f"<h1>{words(3, 9)}</h1>"]
    for _ in range(r.randint(2, 9)):
        kind = r.random()
        if kind < 0.7:
            body.append(f"<p>{sentence(4, 60)}" + (f" <a href='/y'>{words(1, 3)}</a> {sentence(3, 20)}" if r.random() < 0.3 else "") + "</p>")
        elif kind < 0.8:
            body.append(f"<h2>{words(2, 6)}</h2>")
        elif kind < 0.88:
            body.append("<ul>" + "".join(f"<li>{sentence(4, 15)}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.94:
            body.append(f"<blockquote><p>{sentence(8, 30)}</p></blockquote>")
        else:
            body.append(f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>")
    noise = [f"<div class='{r.choice(['ad', 'advert', 'promo', 'sponsored'])} no'>{sentence(3, 15)}</div>", f"<div class='{r.choice(['share', 'related', 'newsletter'])} no'><p>{words(2, 6)}</p><ul>{links(3)}</ul></div>"]
    for x in noise:
        if r.random() < 0.5:
            body.insert(r.randint(1, len(body)), x)
    outer = r.choice(["<article class='yes'>{}</article>", "<main class='yes'>{}</main>", "<main><article class='yes'>{}</article></main>", "<div class='content yes'>{}</div>", "<div id='article-body' class='yes'>{}</div>", "<div class='wrap'><div class='post yes'>{}</div></div>", "<article class='yes'>{}</article>"])
    parts = [f"<nav class='no'><ul>{links(r.randint(3, 8))}</ul></nav>", f"<header class='no'><h2>{words(1, 4)}</h2><p>{words(2, 7)}</p></header>", outer.format("".join(body))]
    parts += r.sample([f"<aside class='no'><h3>{words(1, 3)}</h3><p>{sentence(5, 30)}</p></aside>", f"<div class='sidebar no'><ul>{links(4)}</ul><p>{sentence(3, 20)}</p></div>", f"<form class='no'><p>{words(2, 8)}</p><label>{words(1, 2)}</label></form>", f"<div class='comments no'><p>{sentence(6, 40)}</p><p>{sentence(3, 30)}</p></div>", f"<section id='comments' class='no'><ul><li><p>{sentence(5, 30)}</p></li></ul></section>", f"<div class='cookie-notice no'><p>{sentence(6, 20)}</p></div>", f"<div class='ad no'>{sentence(4, 12)}</div>"], r.randint(1, 4))
    parts.append(f"<footer class='no'>&copy; {words(2, 8)} <p>{sentence(4, 12)}</p></footer>")
    if r.random() < 0.3:
        parts.insert(0, f"<div class='banner no'>{sentence(3, 14)}</div>")
    return "<html><body class='no'>" + "".join(parts) + "</body></html>"


def fitted(pages: DataFrame | None = None, n_pages: int = PAGES_FITTED) -> tuple[list[float], list[list[float]]]:
    """Weights from the built-in layouts and a bounded sample of self-labelled pages."""
    labelled = [(layout_page(k), _marked_label) for k in range(LAYOUTS)]
    if pages is not None:
        # Ids first, so that pages outside the sample are neither lowered nor split; CANDIDATES bounds the broadcast.
        ids = pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(CANDIDATES)
        near = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").where(F.length("html") <= CHARS_FITTED)
        marks = F.size(F.split(F.lower("html"), "<article|<main", -1)) - 1
        rows = near.select("page_id", "html", marks.alias("marks")).where("marks = 1").orderBy(F.xxhash64("page_id"), "page_id", "html").limit(n_pages).collect()
        labelled += [(r.html, _landmark_label) for r in rows]
    return train(labelled)


def main_text(html: str, unary: list[float], pair: list[list[float]]) -> str:
    page = Page(html)
    if not page.runs:
        return ""
    m, _ = marginals(page, page.unary(), unary, pair)
    return "\n".join(text for k, text in page.runs if m[k] > 0.5 and KINDS[page.tag[k]] not in NEVER)


def _extract(weights):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unary, pair = weights
        for pdf in batches:
            text = [main_text(h, unary, pair) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return run


def extract(pages: DataFrame, weights=None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ship(pages.sparkSession)
    weights = weights or fitted(pages)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", text_or_empty("html").alias("html")).mapInPandas(_extract(weights), "page_id bigint, url string, text string, n_chars bigint")


def query(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
