"""Main-text extraction from HTML with a tree-structured graphical model.

Every DOM element is a binary variable (content or not).  Unary potentials come
from its tag, its class / id / role words, how much text it has of its own and
in all, and how much of that is links; pairwise potentials tie each element to its
parent, with a 2 x 2 table for each kind of child (its tag, what its words say, whether
it has much of the page's text), so an advert inside an article says nothing against the article.  One sum-product pass from the leaves to the root and one back
give exact marginals; text whose element is more likely content than not is
kept.  All pages of an Arrow batch are solved together, one tree level at a
time, with numpy.

The weights maximise the exact likelihood of labelled pages (the gradient is
observed minus expected features, with the marginals from the same sum-product).
The labelled pages are written by :func:`labelled_pages`, a seeded generator of
page layouts whose parts are labelled by construction; other labelled pages can
be passed to :func:`train`.  The default model is fitted once per process.

Blocks are split at block-level tags.  Character references are decoded, white
space inside a block becomes one space, blocks are joined by two newlines.
Nothing that is content is shortened or dropped.

Defined results: null or empty html gives an empty text; markup that is broken
or cut off is repaired (unclosed elements end with their parent, a tag cut off at
the end is dropped); text outside any element belongs to the root; very deep
nesting is handled without recursion; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .staging import fresh, with_fields

# Element and keyword lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas object svg script style iframe".split()
)
CLOSES_P = BLOCK - frozenset("body button head html noscript option optgroup script style title template td th tr tbody thead tfoot caption svg iframe object video audio canvas select textarea legend".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
TAG_GROUPS = [
    "html body", "head meta link base title", "script style noscript template iframe object embed svg canvas", "article", "main", "section", "div center", "span font", "p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol menu dir dl", "li dt dd", "nav", "header", "footer", "aside", "form fieldset legend",
    "input button select option optgroup textarea label output", "table tbody thead tfoot", "tr td th caption", "figure figcaption img picture video audio", "blockquote q cite", "pre code samp kbd", "a", "b strong i em u small sub sup mark s del ins abbr time br wbr", "dialog", "details summary", "address",
]
WORD_GROUPS = [
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense adslot dfp anzeige werbung publicidad publicite",
    "nav navbar navi navigation navegacion menu menubar menue breadcrumb breadcrumbs pagination pager toc skip topnav subnav",
    "header masthead topbar banner branding logo kopf kopfzeile cabecera entete",
    "footer foot bottom copyright colophon legal contentinfo fuss fusszeile impressum pie pied",
    "sidebar side aside rail related recommended widget widgets trending popular more complementary recirc teaser",
    "cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe subscription signup paywall toast",
    "comment comments reply replies disqus respond discussion feedback reader",
    "share sharing social follow tweet facebook twitter likes",
    "search searchbox login form search-form contact poll",
    "article content main post entry story text body page prose copy inhalt artikel beitrag contenido articulo contenu texte",
    "hidden sr-only visually-hidden noprint",
]

_GROUP_OF_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_GROUPS_OF_WORD: dict[str, list[int]] = {}
for _i, _g in enumerate(WORD_GROUPS):
    for _w in _g.split():
        _GROUPS_OF_WORD.setdefault(_w, []).append(_i)

N_TAGS, N_WORDS = len(TAG_GROUPS) + 1, len(WORD_GROUPS)
#: Steps of the graded features: characters of an element's own text, share of the page's text, share of links.
OWN, SHARE, LINKED = (0, 20, 80, 200), (0.05, 0.25, 0.5), (0.2, 0.5, 0.8)
#: Own text that ends like a sentence, and own text with a sign of copyright.
ENDS, RIGHTS = re.compile(r"[.!?…:;][\"'”»)]*\s*\Z"), re.compile("©|&copy;|\\(c\\)", re.I)
_AT_OWN = N_TAGS + N_WORDS
_AT_SHARE = _AT_OWN + len(OWN)
_AT_LINKED = _AT_SHARE + len(SHARE)
SENTENCE, COPYRIGHT, BIAS = (_AT_LINKED + len(LINKED) + i for i in range(3))
N_FEATURES = BIAS + 1
#: Kinds of child: its tag's group, what its words say (nothing, not content, content), and whether it has much text.
CONTENT_WORDS = N_TAGS + 9
#: The log potential of content below an element that is none: what is left out is left out whole, unless
#: its inside says otherwise very clearly.
CUT_OFF = -6.0
MUCH = 0.3
EDGES = N_TAGS * 3 * 2

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


@functools.lru_cache(maxsize=65536)
def word_features(attributes: str) -> tuple[int, ...]:
    found = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() == "style":
            if re.search(r"display\s*:\s*none", values[0] or values[1]):
                found.add(N_TAGS + N_WORDS - 1)
            continue
        for w in SPLIT.split("".join(values).lower()):
            found.update(N_TAGS + g for g in _GROUPS_OF_WORD.get(w, ()))
    return tuple(sorted(found))


class Page:
    """Elements (parent, depth, tag, attributes) and text runs (block, element, text)."""

    __slots__ = ("attributes", "depth", "in_link", "open", "parent", "runs", "tags")

    def __init__(self, source: str):
        self.parent, self.depth, self.tags, self.attributes = [-1], [0], ["html"], [""]
        self.in_link: list[bool] = [False]
        self.runs: list[tuple[int, int, str]] = []
        self.open: dict[str, list[int]] = {}
        self._parse(source)

    def _open(self, at: int, tag: str, attributes: str) -> int:
        self.parent.append(at)
        self.depth.append(self.depth[at] + 1)
        self.tags.append(tag)
        self.attributes.append(attributes)
        self.in_link.append(self.in_link[at] or tag == "a")
        return len(self.parent) - 1

    def _close(self, at: int, names, stop) -> int:
        """The open element left when the nearest of ``names`` above ``at`` is closed, unless a
        ``stop`` is nearer.  The open elements of each name are at hand, so that an end tag without
        a start costs nothing and every element is left once."""
        nearest = lambda tags: max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        found = nearest(names)
        if found <= nearest(stop):
            return at
        while at >= found:
            self.open[self.tags[at]].pop()
            at = self.parent[at]
        return at

    def _parse(self, s: str) -> None:
        at, pos, block, end = 0, 0, 0, len(s)
        while pos < end:
            lt = s.find("<", pos)
            if lt < 0:
                lt = end
            if lt > pos:
                self.runs.append((block, at, s[pos:lt]))
            if lt == end:
                break
            follow = s[lt + 1 : lt + 2]
            if follow in ("!", "?"):
                if s.startswith(("<!-->", "<!--->"), lt):  # a comment that ends where it begins
                    pos = s.index(">", lt) + 1
                elif s.startswith("<!--", lt):
                    close = s.find("-->", lt + 4)
                    pos = end if close < 0 else close + 3
                elif s.startswith("<![CDATA[", lt):
                    close = s.find("]]>", lt)
                    pos = end if close < 0 else close + 3
                else:
                    close = s.find(">", lt)
                    pos = end if close < 0 else close + 1
                continue
            m = TAG.match(s, lt)
            if not m:
                if follow.isalpha() or follow == "/":  # a tag that is cut off or broken
                    close = s.find(">", lt)
                    pos = end if close < 0 else close + 1
                else:
                    self.runs.append((block, at, "<"))
                    pos = lt + 1
                continue
            pos, tag = m.end(), m[2].lower()
            if tag in BLOCK:
                block += 1
            if m[1]:
                if tag == "p" or tag not in ("html", "body"):
                    at = self._close(at, (tag,), ("table",) if tag not in BLOCK else ())
                continue
            if tag in CLOSES_P:
                at = self._close(at, ("p",), ("button", "td", "th", "table"))
            if tag in CLOSED_BY:
                names, stop = CLOSED_BY[tag]
                at = self._close(at, names, stop)
            if tag == "br":
                self.runs.append((block, at, " "))
            if tag == "html":
                continue
            node = self._open(at, tag, m[3])
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(s, pos)
                pos = end if not close else close.start()
                after = s.find(">", pos)
                pos = end if after < 0 else after + 1
                block += tag in BLOCK
            elif tag not in VOID:  # a slash does not close such an element
                at = node
                self.open.setdefault(tag, []).append(node)


class Forest:
    """All elements of several pages, for vectorised potentials and messages."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(self.start[-1])
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, self.start, strict=False)]) if pages else np.zeros(0, np.int64)
        depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.zeros(0, np.int64)
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(1, (depth.max() if n else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        rows, columns = [], []
        own, linked, ends, rights = (np.zeros(n) for _ in range(4))
        kind = np.zeros(n, np.int64)
        for p, s in zip(pages, self.start.tolist(), strict=False):
            for i, (tag, attributes) in enumerate(zip(p.tags, p.attributes, strict=True)):
                group = _GROUP_OF_TAG.get(tag, N_TAGS - 1)
                rows.append(s + i)
                columns.append(group)
                found = word_features(attributes) if attributes else ()
                for f in found:
                    rows.append(s + i)
                    columns.append(f)
                says = 0 if not found else 2 if found == (CONTENT_WORDS,) else 1
                kind[s + i] = 6 * group + 2 * says
            for _, node, run in p.runs:
                if k := len(run.strip()):
                    own[s + node] += k
                    ends[s + node] = bool(ENDS.search(run[-8:]))
                    rights[s + node] += bool(RIGHTS.search(run))
                    if p.in_link[node]:
                        linked[s + node] += k
        text = own.copy()
        for level in reversed(self.levels):
            np.add.at(text, self.parent[level], text[level])
            np.add.at(linked, self.parent[level], linked[level])
        share = text / np.maximum(1, np.repeat(text[self.start[:-1]], sizes))
        self.kind = kind + (share > MUCH)
        some = text > 0
        graded = [(_AT_OWN + i, own > x) for i, x in enumerate(OWN)] + [(_AT_SHARE + i, share > x) for i, x in enumerate(SHARE)] + [(_AT_LINKED + i, some & (linked > x * text)) for i, x in enumerate(LINKED)]
        graded += [(SENTENCE, ends > 0), (COPYRIGHT, rights > 0), (BIAS, np.ones(n, bool))]
        places = [np.flatnonzero(on) for _, on in graded]
        self.rows = np.concatenate([np.array(rows, np.int64), *places])
        self.columns = np.concatenate([np.array(columns, np.int64), *[np.full(len(at), f) for (f, _), at in zip(graded, places, strict=True)]])
        self.n = n

    def marginals(self, unary: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(content) of each element, P(parent state, own state) of each edge, log partition."""
        local = np.zeros((self.n, 2))
        local[:, 1] = np.bincount(self.rows, unary[self.columns], self.n)
        up = local.copy()
        message = np.zeros((self.n, 2))
        for level in reversed(self.levels):
            m = np.logaddexp(tables[self.kind[level], :, 0] + up[level, None, 0], tables[self.kind[level], :, 1] + up[level, None, 1])
            message[level] = m
            np.add.at(up, self.parent[level], m)
        belief = up.copy()
        pair = np.zeros((self.n, 2, 2))
        for level in self.levels:
            rest = belief[self.parent[level]] - message[level]
            joint = rest[:, :, None] + tables[self.kind[level]] + up[level][:, None, :]
            top = joint.max((1, 2), keepdims=True)
            weights = np.exp(joint - top)
            pair[level] = weights / weights.sum((1, 2), keepdims=True)
            belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))
        roots = self.start[:-1]
        return p, pair, float(np.logaddexp(up[roots, 0], up[roots, 1]).sum())


class Model:
    def __init__(self, unary: np.ndarray, tables: np.ndarray):
        self.unary, self.tables = unary, tables

    def extract(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s or "") for s in sources]
        forest = Forest(pages)
        content = forest.marginals(self.unary, self.tables)[0] > 0.5
        out = []
        for page, s in zip(pages, forest.start.tolist(), strict=False):
            blocks: list[str] = []
            now, parts = -1, []
            for block, node, run in [*page.runs, (-2, 0, "")]:
                if block != now:
                    if parts and (joined := " ".join(html.unescape("".join(parts)).split())):
                        blocks.append(joined)
                    now, parts = block, []
                if block >= 0 and content[s + node]:
                    parts.append(run)
            out.append("\n\n".join(blocks))
        return out


LABEL = re.compile(r'\s*data-content="([01])"')
OFF = ' data-content="0"'


def labelled_pages(n: int = 600, seed: int = 5) -> list[str]:
    """Pages whose elements carry ``data-content="0"`` where something begins that is not content.
    A page and what wraps its article count as content: the question is what to leave out."""
    r = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do", "tempor", "magna", "ut", "enim", "quis", "nisi"]
    say = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b))).capitalize() + "."
    title = lambda a, b: say(a, b).rstrip("." if r.random() < 0.85 else "")
    odd = lambda: "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 3))) + r.choice(["", "", "-1", "_box"])
    attr = lambda *names: f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'
    # Any page may name its parts in words that say nothing.
    named = lambda *names: attr(*names) if r.random() < 0.8 else attr(odd())
    links = lambda k: "".join(f'<li><a href="/{i}">{title(1, 3)}</a></li>' for i in range(k))

    def noise() -> str:
        """Text that is content although it reads like none: marks instead of words, no sentences."""
        mark = r.choice(["&&&", "***", "|", "#", "...", "~"])
        return r.choice(["", " "]).join(f"{r.choice(words)}{mark} " for _ in range(r.randint(1, 9)))

    def inline() -> str:
        t = noise() if r.random() < 0.06 else say(3, 40).rstrip("." if r.random() < 0.15 else "")
        if r.random() < 0.3:
            t += f" <{(g := r.choice(['b', 'i', 'em', 'strong', 'code', 'span']))}>{say(1, 4)}</{g}>"
        while r.random() < 0.25:
            t += f' <a href="/x">{title(1, 3)}</a> {say(2, 9)}'
        return t

    def junk() -> str:
        return r.choice([
            lambda: f"<nav{OFF}><ul>{links(r.randint(2, 8))}</ul></nav>",
            lambda: f"<div{attr('menu', 'nav', 'breadcrumbs', 'navbar')}{OFF}>{''.join(f'<a href=/{i}>{title(1, 2)}</a> ' for i in range(4))}</div>",
            lambda: f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'ad-banner', 'promo')}{OFF}>{say(3, 30)}</div>",
            lambda: f"<p{attr('ad', 'advertisement', 'sponsored')}{OFF}>{say(3, 20)}</p>",
            lambda: f"<aside{attr('sidebar', 'related', 'rail')}{OFF}><h3>{title(1, 3)}</h3><p>{say(5, 30)}</p><ul>{links(3)}</ul></aside>",
            lambda: f"<aside{OFF}><p>{say(4, 20)}</p></aside>",
            lambda: f"<aside{OFF}>{say(1, 8)}</aside>",
            lambda: f"<aside{OFF}><a href=/r>{title(2, 6)}</a></aside>",
            lambda: f"<{(t := r.choice(['div', 'div', 'span']))}{attr('top', odd()) if r.random() < 0.4 else ''}{OFF}>{r.choice([' ', ' ', ' | ', ' &middot; ', ' &gt; ', ' / ']).join(f'<a href=/{i}>{title(1, 2)}</a>' for i in range(r.randint(2, 7)))}</{t}>",
            lambda: f"<div{attr(odd())}{OFF}><ul>{links(r.randint(2, 7))}</ul></div>",
            lambda: f"<{(t := r.choice(['div', 'p', 'div', 'small']))}{OFF}>{r.choice(['© 2021 ', '&copy; 2019 ', 'Copyright (c) '])}{say(1, 8)}</{t}>",
            lambda: f"<p{attr('byline', 'meta', 'share', 'legal')}{OFF}>{say(1, 4)}</p>" if r.random() < 0.3 else f"<div{attr('ad', 'werbung', 'anzeige')}{OFF}><p>{say(3, 25)}</p></div>",
            lambda: f"<div{attr('sidebar', 'widget', 'related')}{OFF}><h3>{title(1, 3)}</h3><p>{say(4, 20)}</p></div>",
            lambda: f"<div{attr('cookie-notice', 'notice', 'consent', 'newsletter', 'popup')}{OFF}><p>{say(5, 20)}</p><button>{title(1, 1)}</button></div>",
            lambda: f"<section{attr('comments', 'comment-list')}{OFF}><h2>{title(1, 1)}</h2><div class=\"comment\"><p>{say(4, 40)}</p></div><article class=\"comment\"><p>{say(4, 40)}</p></article></section>",
            lambda: f"<div{attr('comments', 'comment', 'disqus')}{OFF}><ul><li><p>{say(5, 40)}</p></li><li><p>{say(2, 30)}</p></li></ul></div>",
            lambda: f"<form action=\"/s\"{OFF}><label>{title(1, 3)}</label><input name=q><select><option>{title(1, 1)}</option></select><button>{title(1, 1)}</button></form>",
            lambda: f"<div{attr('share', 'social', 'share-links')}{OFF}><a href=#>{title(1, 1)}</a> <a href=#>{title(1, 1)}</a></div>",
            lambda: f"<div{OFF} style=\"display:none\">{say(3, 9)}</div>",
            lambda: f"<dialog{OFF}><p>{say(4, 14)}</p></dialog>",
            lambda: f"<dialog{OFF}>{title(2, 9)}</dialog>",
            lambda: f"<noscript{OFF}>{say(4, 10)}</noscript>",
            lambda: f"<template{OFF}><p>{say(4, 10)}</p></template>",
        ])()

    def piece() -> str:
        return r.choice([
            lambda: f"<p>{inline()}</p>", lambda: f"<p>{inline()}</p>", lambda: f"<p>{' '.join(say(6, 18) for _ in range(r.randint(2, 7)))}</p>", lambda: f"<p>{' '.join(say(6, 18) for _ in range(r.randint(2, 5)))}</p>", lambda: f"<p>{inline()}<br>{inline()}</p>", lambda: f"<p>{say(1, 2)}</p>",
            lambda: f"<h2>{title(2, 6)}</h2>", lambda: f"<h3>{title(2, 6)}</h3>", lambda: f"<ul>{''.join(f'<li>{inline()}</li>' for _ in range(3))}</ul>", lambda: f"<ol>{''.join(f'<li><p>{inline()}</p></li>' for _ in range(2))}</ol>",
            lambda: f"<blockquote><p>{inline()}</p></blockquote>", lambda: f"<pre><code>{say(3, 20)}</code></pre>", lambda: f"<table><tbody><tr><th>{title(1, 2)}</th><td>{title(1, 4)}</td></tr></tbody></table>",
            lambda: f"<figure><img src=x><figcaption>{say(3, 8)}</figcaption></figure>", lambda: f"<div>{inline()}</div>", lambda: f"<div>{say(1, 5)}</div>", lambda: f"<div><p>{inline()}</p><p>{inline()}</p></div>", lambda: f"<section><h2>{title(1, 4)}</h2><p>{inline()}</p></section>",
            lambda: f"<dl><dt>{title(1, 2)}</dt><dd>{inline()}</dd></dl>", lambda: f"<p><a href=/y>{title(2, 5)}</a></p>", lambda: f"<section{attr('intro', 'text', 'body')}><p>{inline()}</p></section>", lambda: f"<details><summary>{title(1, 3)}</summary><p>{inline()}</p></details>",
        ])()

    pages = []
    for _ in range(n):
        body = f"<h1>{title(3, 9)}</h1>" * (r.random() < 0.8) + "".join(piece() if r.random() < 0.85 else junk() for _ in range(r.randint(1, 14)))
        if r.random() < 0.15:  # an article of a few short or repeated lines
            line = say(1, 3)
            body = f"<h1>{title(1, 3)}</h1>" + "".join(f"<p>{'<b>' * (r.random() < 0.1)}{line if r.random() < 0.7 else say(1, 2)}{'<br>' * (r.random() < 0.1)}</p>" for _ in range(r.choice([2, 4, 7, 60])))
        if r.random() < 0.25:
            body = f'<header{OFF}>{"<h1>" + title(2, 8) + "</h1>" if r.random() < 0.6 else ""}<p{attr("byline", "meta", "author") if r.random() < 0.5 else ""}>{say(2, 8)}</p></header>' + body
        if r.random() < 0.25:
            body += f'<footer{OFF}><p>{say(2, 12)}</p></footer>'
        kind = r.random()
        if kind < 0.35:
            core = f"<article{named('post', 'story', 'x1') if r.random() < 0.4 else ''}>{body}</article>"
        elif kind < 0.5:
            core = f"<main>{body}</main>" if r.random() < 0.5 else f"<main><article>{body}</article></main>"
        elif kind < 0.68:
            core = f"<div{named('content', 'main-content', 'post', 'entry-content', 'article-body', 'inhalt', 'contenido', 'texte')}>{body}</div>"
        elif kind < 0.8:
            core = f"<div{named('wrapper', 'x2', 'container') if r.random() < 0.5 else ''}><div{named('content', 'story') if r.random() < 0.6 else ''}>{body}</div></div>"
        elif kind < 0.88:
            core = f"<div>{body}</div>"
        elif kind < 0.92:  # without a container
            core = body
        else:
            core = f"<table><tr><td{OFF}>{''.join(f'<a href=/{i}>{title(1, 2)}</a><br>' for i in range(r.randint(3, 8)))}</td><td>{body}</td></tr></table>"
        before = f"<header{OFF}><div class=logo>{say(1, 2)}</div>{'<h1>' + title(1, 3) + '</h1>' if r.random() < 0.4 else ''}<p>{say(2, 6)}</p></header>" * (r.random() < 0.6)
        before += "".join(junk() for _ in range(r.randint(0, 4)))
        after = "".join(junk() for _ in range(r.randint(0, 4))) + f"<{(t := r.choice(['footer', 'footer', 'div']))}{attr('footer', 'x3', 'fuss', 'pie')}{OFF}><p>{say(2, 12)}</p><ul>{links(2)}</ul></{t}>" * (r.random() < 0.8)
        if r.random() < 0.25:
            before, after = f'<div class="{r.choice(["page", "wrap", "layout"])}">{before}', f"{after}</div>"
        head = f"<head{OFF}><title>{say(2, 6)}</title><style>p{{}}</style></head>" * (r.random() < 0.7)
        whole = r.random() < 0.85
        pages.append(f"<!DOCTYPE html><html>{head}<body>{before}{core}{after}</body></html>" if whole else f"{before}{core}{after}<script{OFF}>var a;</script>")
    return pages


def labels_of(page: Page) -> np.ndarray:
    """Each element's label; elements without one take their parent's, the root is content."""
    out = np.ones(len(page.parent), bool)
    for i in range(1, len(out)):
        m = LABEL.search(page.attributes[i])
        out[i] = m[1] == "1" if m else out[page.parent[i]]
    return out


def tables_of(ties: np.ndarray) -> np.ndarray:
    """The pair tables [kind, parent, child]: for each kind of child what it means below content to be none or
    to be content, and the cut."""
    tables = np.zeros((EDGES, 2, 2))
    tables[:, 0, 1], tables[:, 1] = CUT_OFF, ties.reshape(EDGES, 2)
    return tables


def train(sources: list[str] | None = None, steps: int = 50, memory: int = 8, decay: float = 5e-4) -> Model:
    """Maximum likelihood by L-BFGS with backtracking: the likelihood of fully labelled pages is concave."""
    pages = [Page(s) for s in (sources or labelled_pages())]
    truth = np.concatenate([labels_of(p) for p in pages])
    for p in pages:
        p.attributes = [LABEL.sub("", a) for a in p.attributes]
    forest = Forest(pages)
    inner = np.flatnonzero(forest.parent >= 0)
    below = forest.kind[inner]
    seen = np.concatenate([np.bincount(forest.columns, truth[forest.rows], N_FEATURES), np.bincount(2 * below + truth[inner], truth[forest.parent[inner]], 2 * EDGES)])
    fixed = CUT_OFF * np.count_nonzero(~truth[forest.parent[inner]] & truth[inner])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        p, pair, total = forest.marginals(x[:N_FEATURES], tables_of(x[N_FEATURES:]))
        expected = np.concatenate([np.bincount(forest.columns, p[forest.rows], N_FEATURES), np.stack([np.bincount(below, pair[inner, 1, k], EDGES) for k in (0, 1)], axis=1).ravel()])
        return (total - x @ seen - fixed) / len(pages) + decay / 2 * (x @ x), (expected - seen) / len(pages) + decay * x

    x = np.zeros(N_FEATURES + 2 * EDGES)
    value, gradient = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, kept = -gradient, []
        for move, turn in reversed(past):
            kept.append((move @ direction) / (move @ turn))
            direction = direction - kept[-1] * turn
        if past:
            direction = direction * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (move, turn), k in zip(past, reversed(kept), strict=True):
            direction = direction + (k - (turn @ direction) / (move @ turn)) * move
        slope, step = gradient @ direction, 1.0 if past else 1.0 / max(1.0, np.linalg.norm(gradient))
        while True:
            new, new_gradient = loss(x + step * direction)
            if new <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if step < 1e-6:
            break
        move, turn = step * direction, new_gradient - gradient
        if move @ turn > 1e-12:
            past = [*past, (move, turn)][-memory:]
        x, value, gradient = x + move, new, new_gradient
    return Model(x[:N_FEATURES], tables_of(x[N_FEATURES:]))


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return train()


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = model.value.extract(part.column(part.num_columns - 1).to_pylist())
                columns = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "text", "n_chars"])

    return textcore.tidy(run)


def extract(pages: DataFrame, html_column: str = "html", model: Model | None = None) -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars`` (code points)."""
    model = model or default_model()
    base = pages.drop("text", "n_chars")
    keep = [c for c in base.columns if c != html_column]
    shared = pages.sparkSession.sparkContext.broadcast(model)
    out = with_fields(base.select(*keep).schema, "text string, n_chars long")
    return base.select(*keep, F.col(html_column).alias(fresh(keep, "_html"))).mapInArrow(_extract(shared), out)
