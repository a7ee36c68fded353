"""Main text of web pages by a tree-structured graphical model over DOM nodes.

A page is parsed into its block elements (inline markup is transparent; scripts, styles, comments and the head vanish).
Each node is content or not; a node that holds content is content too. Node potentials come from the tag, class and id
words, own text and links; parent-child potentials connect the nodes. Sum-product message passing, upward from the
leaves and downward from the root, gives each node's marginal; text of nodes at 0.5 or more is kept. The weights
maximise the likelihood of labelled pages, by gradients that the same message passing computes.

The labelled pages are made here from templates (``labelled_pages``): articles in the usual containers, with menus,
headers, footers, sidebars, notices, adverts, forms, share bars, related links and reader comments around and in them.

Character references are decoded; white space in a block becomes one space; blocks are trimmed and joined by two
newlines in page order. Formulas and drawings inside a block are text of the block, as is what stands in for sound,
video and other objects. Null and empty pages give an empty text, as do pages without content. Markup that is cut off or
badly nested is parsed as far as it goes, at any depth and in a time that grows with the page's length. Rows are handled one by one; extra columns pass through; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of HTML elements by how they are laid out.
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark object picture q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title noscript template textarea iframe select".split())
WRAPPERS = frozenset("div section center figure".split())
#: All markup inside of these is inline.
FOREIGN = frozenset("math svg".split())
#: What an opening tag closes, and what that search does not leave.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|data-keep|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
FEATURES = 1 << 13


@dataclass
class Page:
    """Nodes by parent (-1 for the root), depth and features; segments of text in page order."""

    parent: list[int]
    depth: list[int]
    features: list[list[int]]
    segments: list[tuple[int, str]]
    keep: list[bool]


def _bucket(*parts: object) -> int:
    return zlib.crc32("\x00".join(map(str, parts)).encode()) % FEATURES


@lru_cache(1 << 14)
def _static(tag: str, attributes: str) -> tuple[tuple[int, ...], bool]:
    """Features of a tag and its attributes, and whether a label marks it."""
    out, keep = [_bucket("tag", tag), _bucket("bias")], False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-keep":
            keep = True
        elif name == "style":
            if "none" in value and "display" in value:
                out.append(_bucket("hidden"))
        elif name == "hidden":
            out.append(_bucket("hidden"))
        else:
            words = [p.lower() for p in PART.findall(value)]
            out += [_bucket("word", w) for w in words] + [_bucket("word", w[:-1]) for w in words if len(w) > 3 and w.endswith("s")]
    return tuple(dict.fromkeys(out)), keep


class _Open:
    """The open elements, with the places of each tag among them, so that no search goes over the stack."""

    def __init__(self, tags: list[str]):
        self.tags, self.stack = tags, [0]
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> int:
        return self.stack[-1]

    def push(self, node: int) -> None:
        self.places.setdefault(self.tags[node], []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.places[self.tags[self.stack.pop()]].pop()

    def nearest(self, tags: Iterable[str]) -> int:
        """The depth of the innermost open element of these tags, 0 for none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)


class _Ends:
    """Closing tags of elements whose inside is not parsed; a tag that has none left is not searched for again."""

    def __init__(self, html: str):
        self.html, self.none = html, set()

    def after(self, tag: str, pos: int) -> int | None:
        if tag in self.none:
            return None
        found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.html, pos)
        if found is None:
            self.none.add(tag)
            return None
        return found.end()


def parse(html: str) -> Page:
    parent, tags, static, keep = [-1], ["#root"], [_static("#root", "")[0]], [False]
    words, link_words, links = [0], [0], [0]
    segments: list[tuple[int, str]] = []
    buffer: list[str] = []
    elements, ends, in_link, pos, end = _Open(tags), _Ends(html), 0, 0, html.rfind(">") + 1
    skip_head, foreign = False, 0

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            segments.append((elements.top, text))

    def add(raw: str) -> None:
        if raw and not skip_head:
            text = entities.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            n = len(text.split())
            words[elements.top] += n
            if in_link:
                link_words[elements.top] += n

    while pos < end:
        m = TAG.search(html, pos, end)
        if not m:
            break
        add(html[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                found = ends.after(tag, pos)
                if found is not None:
                    pos = found
                elif tag in ("script", "style", "textarea", "title"):
                    pos = len(html)
        elif tag in FOREIGN:
            if not closing and not attributes.endswith("/"):
                foreign = max(foreign, ends.after(tag, pos) or 0)
        elif pos < foreign:
            if tag == "br":
                buffer.append(" ")
        elif tag == "br":
            buffer.append(" ")
        elif tag == "head":
            skip_head = not closing
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
                links[elements.top] += not closing
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag == "html":
            pass
        elif closing:
            at = elements.nearest((tag,))
            if at:
                flush()
                elements.cut(at)
                in_link = 0
        else:
            skip_head = False
            flush()
            in_link = 0
            if tag in CLOSES:
                closed, bounds = CLOSES[tag]
                at = elements.nearest(closed)
                if at > elements.nearest(bounds):
                    elements.cut(at)
            elif tags[elements.top] == "p":
                elements.cut(len(elements.stack) - 1)
            features, marked = _static(tag, attributes)
            top = elements.top
            parent.append(top)
            tags.append(tag)
            static.append(features)
            keep.append((marked or keep[top]) and "data-drop" not in attributes)
            words.append(0)
            link_words.append(0)
            links.append(0)
            if not attributes.rstrip().endswith("/"):
                elements.push(len(parent) - 1)
    add(html[pos:])
    flush()

    # Wrappers that say nothing: no text, no name, one child. The child hangs where the wrapper hangs.
    kids = [0] * len(parent)
    for up in parent[1:]:
        kids[up] += 1
    hollow = [k > 0 and kids[k] == 1 and not words[k] and tags[k] in WRAPPERS and len(static[k]) == 2 for k in range(len(parent))]
    place, left = [0] * len(parent), []
    for k in range(len(parent)):  # parents come before children
        if hollow[k]:
            place[k] = place[parent[k]]
        else:
            place[k] = len(left)
            left.append(k)
    parent = [-1 if k == 0 else place[parent[k]] for k in left]
    tags, static, keep, words, link_words, links = ([x[k] for k in left] for x in (tags, static, keep, words, link_words, links))
    depth = [0] * len(left)
    for k in range(1, len(left)):
        depth[k] = depth[parent[k]] + 1
    segments = [(place[k], text) for k, text in segments]

    features = []
    whole = max(1, sum(words))
    for k in range(len(parent)):
        n, l = words[k], link_words[k]
        own = [_bucket("words", min(7, n.bit_length())), _bucket("links", min(3, links[k])), _bucket("density", 4 * l // n if n else -1)]
        own.append(_bucket("share", min(4, 10 * n // whole)))
        own.append(_bucket("tag+words", tags[k], min(4, (n + 3) // 8)))
        own.append(_bucket("in", tags[parent[k]] if k else "", tags[k]))
        features.append([*static[k], *own])
    return Page(parent, depth, features, segments, keep)


class Forest:
    """The trees of some pages, nodes end to end: parents, features, and the nodes of each depth."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages])
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        raw = np.concatenate([np.array(p.parent) for p in pages])
        self.parent = np.where(raw < 0, -1, raw + base)
        depth = np.concatenate([np.array(p.depth) for p in pages])
        self.levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
        counts = np.array([len(f) for p in pages for f in p.features])
        self.at = np.cumsum(counts) - counts
        self.flat = np.array([i for p in pages for f in p.features for i in f])


class TreeModel:
    """Weights of the node features and the 2 x 2 parent-child potentials (parent's label first)."""

    def __init__(self, weights: np.ndarray | None = None, edge: np.ndarray | None = None):
        self.w = np.zeros(FEATURES) if weights is None else weights
        self.edge = np.zeros((2, 2)) if edge is None else edge

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """For all nodes: log P(label) (nodes, 2), and P(parent, own label)."""
        parent = forest.parent
        score = np.add.reduceat(self.w[forest.flat], forest.at)
        own = np.stack([np.zeros(len(score)), score], 1)
        up, message = own.copy(), np.zeros_like(own)
        for nodes in forest.levels[:0:-1]:
            m = np.logaddexp(self.edge[:, 0] + up[nodes, :1], self.edge[:, 1] + up[nodes, 1:])
            message[nodes] = m
            np.add.at(up, parent[nodes], m)
        down = np.zeros_like(own)
        for nodes in forest.levels[1:]:
            rest = up[parent[nodes]] + down[parent[nodes]] - message[nodes]
            down[nodes] = np.logaddexp(rest[:, :1] + self.edge[0], rest[:, 1:] + self.edge[1])
            down[nodes] -= down[nodes].max(1, keepdims=True)
        belief = up + down
        z = np.logaddexp(belief[:, 0], belief[:, 1])
        joint = np.zeros((len(own), 2, 2))
        kids = np.flatnonzero(parent >= 0)
        rest = belief[parent[kids]] - message[kids]
        j = rest[:, :, None] + self.edge[None] + up[kids][:, None, :]
        j = np.exp(j - j.max((1, 2), keepdims=True))
        joint[kids] = j / j.sum((1, 2), keepdims=True)
        return belief - z[:, None], joint

    def fit(self, pages: list[Page], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> TreeModel:
        """Gradient ascent (Adam) on the likelihood of the labels of all nodes."""
        forest, y = Forest(pages), []
        for p in pages:
            own = np.array(p.keep)
            for k in range(len(own) - 1, 0, -1):  # what holds content is content
                if own[k]:
                    own[p.parent[k]] = True
            y.append(own)
        y = np.concatenate(y).astype(float)
        kids = np.flatnonzero(forest.parent >= 0)
        owner = np.repeat(np.arange(len(forest.at)), np.diff(np.append(forest.at, len(forest.flat))))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[forest.parent[kids]].astype(int), y[kids].astype(int)), 1)
        m, v = [0.0, 0.0], [0.0, 0.0]
        for at in range(1, rounds + 1):
            belief, joint = self.marginals(forest)
            gw = np.bincount(forest.flat, (y - np.exp(belief[:, 1]))[owner], FEATURES) / len(pages) - decay * self.w
            ge = (seen - joint.sum(0)) / len(pages) - decay * self.edge
            for k, (g, x) in enumerate(((gw, self.w), (ge, self.edge))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                x += rate * (m[k] / (1 - 0.9**at)) / (np.sqrt(v[k] / (1 - 0.99**at)) + 1e-8)
        return self

    def texts(self, pages: list[Page]) -> list[str]:
        if not pages:
            return []
        good = self.marginals(Forest(pages))[0][:, 1] >= np.log(0.5)
        out, at = [], 0
        for p in pages:
            out.append("\n\n".join(t for k, t in p.segments if good[at + k]))
            at += len(p.parent)
        return out


# --- labelled pages ---------------------------------------------------------------------------------------------------

SYLLABLES = "ka lo mi ren tus var el on ti sa do pre mun est or al ine qua fer dis".split()
#: Class and id words of the usual kinds of blocks.
KINDS = {
    "nav": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs site-nav pagination pager tabs toolbar skip-link toc",
    "header": "header site-header masthead page-header top-bar logo branding banner hero-banner tagline topbar",
    "footer": "footer site-footer page-footer colophon copyright legal bottom foot credits",
    "sidebar": "sidebar side aside widget widget-area rail right-column left-column secondary sidebar-widget tags tag-cloud archive archives",
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr alert message warning popup modal overlay disclaimer announcement paywall privacy info-bar",
    "ad": "ad ads advert advertisement adsense sponsored sponsor promo promotion ad-slot adbox banner-ad commercial partner dfp ad-container",
    "form": "form newsletter subscribe signup login search searchform contact-form search-box register poll survey feedback",
    "share": "share social sharing share-bar social-links follow likes buttons tools print actions",
    "related": "related related-posts recommended more-stories popular trending teaser read-more also-read recent-posts latest see-also suggestions",
    "comment": "comments comment comment-list commentlist replies reply discussion disqus responses thread reader-comments comment-body user-comments respond review",
    "meta": "byline author meta post-meta date timestamp published author-bio entry-meta post-info",
}
GOOD = "article post entry content post-content entry-content article-body main story story-body text body-text page-content post-body main-content articleText single wrapper prose".split()
NEUTRAL = "container wrap row col inner page outer section block box left right clearfix grid main-col layout".split()


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    """Pages with ``data-keep`` on blocks that are content and ``data-drop`` on blocks inside them that are not."""
    rng = random.Random(seed)

    def sentence(lo: int, hi: int) -> str:
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(lo: int = 1, hi: int = 5) -> str:
        return " ".join(sentence(4, 18) for _ in range(rng.randint(lo, hi)))

    def link() -> str:
        return f'<a href="/{rng.randint(1, 99)}">{sentence(1, 5).rstrip(".!?")}</a>'

    def attribute(words: str | list[str], chance: float = 1.0) -> str:
        if rng.random() > chance:
            return ""
        word = rng.choice(words.split() if isinstance(words, str) else words)
        return f' {rng.choice(["class", "class", "class", "id"])}="{word}{rng.choice(["", "", "-1", " " + rng.choice(NEUTRAL)])}"'

    def noise(kind: str) -> str:
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "ad": "aside", "comment": "section", "related": "aside"}.get(kind)
        tag = semantic if semantic and rng.random() < 0.45 else rng.choice(["div", "div", "div", "section", "p" if kind in ("ad", "notice", "meta", "share") else "div"])
        attrs = attribute(KINDS[kind], 0.3 if tag in ("nav", "header", "footer", "form") else 1.0)
        if tag == "aside" and not attrs and rng.random() < 0.5:
            attrs = attribute(KINDS[kind])
        if kind in ("nav", "share", "related") or (kind == "sidebar" and rng.random() < 0.7):
            inside = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>" if rng.random() < 0.7 and tag != "p" else " ".join(link() for _ in range(rng.randint(2, 6)))
            if kind != "nav" and rng.random() < 0.4 and tag != "p":
                inside = f"<h{rng.randint(2, 4)}>{sentence(1, 4)}</h3>" + inside
            if kind in ("related", "sidebar") and rng.random() < 0.3 and tag != "p":
                inside += f"<p>{prose(1, 2)}</p>"
        elif kind == "form":
            inside = f"<label>{sentence(1, 4)}</label><input name=q><button>{sentence(1, 2)}</button>"
            if rng.random() < 0.6:
                inside = f"<p>{prose(1, 2)}</p>" + inside
            if tag == "div" and rng.random() < 0.7:
                inside = f"<form action='/s'>{inside}</form>"
        elif kind == "footer":
            inside = rng.choice(["&copy; ", "Copyright ", ""]) + f"{rng.choice(['example.com', '2024'])} &middot; {prose(1, 2)}"
            if rng.random() < 0.5:
                inside = f"<p>{inside}</p>" + " ".join(link() for _ in range(rng.randint(0, 4)))
        elif kind == "header":
            inside = rng.choice([link(), sentence(1, 5), f"<h1>{sentence(1, 3)}</h1><p>{sentence(2, 7)}</p>", f"<div class='logo'>{link()}</div>"])
            if rng.random() < 0.4:
                inside += noise("nav")
        elif kind == "comment":
            one = lambda: f"<{(t := rng.choice(['div', 'li', 'article', 'p']))}{attribute('comment comment-body reply', 0.6)}>" + (prose(1, 4) if t == "p" or rng.random() < 0.3 else f"<p>{prose(1, 4)}</p>") + f"</{t}>"
            inside = (f"<h3>{sentence(1, 3)}</h3>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 5)))
            if not attrs:
                attrs = attribute(KINDS["comment"])
            tag = "div" if tag == "p" else tag
        elif tag == "p" or rng.random() < 0.5:
            inside = prose(1, 3)
        else:
            inside = "".join(f"<p>{prose(1, 2)}</p>" for _ in range(rng.randint(1, 2)))
        if kind in ("ad", "notice", "share") and tag in ("aside", "section", "div", "p") and not attrs:
            attrs = attribute(KINDS[kind])
        return f"<{tag}{attrs} data-drop>{inside}</{tag}>"

    def nested(inside: str) -> str:
        """Containers without a meaning of their own around content."""
        kinds = [rng.choice(["div", "div", "div", "section", "figure", "center", "article"]) for _ in range(rng.choice([1, 1, 2, 3, 5, 8]))]
        return "".join(f"<{k}{attribute(NEUTRAL + GOOD, 0.25)}>" for k in kinds) + inside + "".join(f"</{k}>" for k in reversed(kinds))

    def block() -> str:
        if rng.random() < 0.12:
            return nested("".join(block() for _ in range(rng.choice([1, 1, 2, 4]))))
        kind = rng.random()
        if kind < 0.06:
            return f"<p>{sentence(1, 4)}</p>"
        if kind < 0.08:
            return f"<figure><img src=x.png><figcaption>{sentence(2, 12)}</figcaption></figure>"
        if kind < 0.10:
            return "<dl>" + "".join(f"<dt>{sentence(1, 3)}</dt><dd>{sentence(2, 12)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"
        if kind < 0.11:
            return f"<details><summary>{sentence(1, 5)}</summary>{prose(1, 2)}</details>"
        kind = rng.random()
        if kind < 0.72:
            inner = prose(1, 6)
            if rng.random() < 0.2:
                inner = f"{inner} {link()} {sentence(3, 9)}"
            if rng.random() < 0.12:
                return f"<p><b>{inner}<br>"
            return f"<p>{inner}</p>"
        if kind < 0.84:
            return f"<h{rng.randint(2, 4)}>{sentence(1, 7)}</h2>"
        if kind < 0.90:
            t = rng.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{sentence(2, 15)}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>"
        if kind < 0.94:
            return f"<blockquote><p>{prose(1, 3)}</p></blockquote>" if rng.random() < 0.6 else f"<blockquote>{prose(1, 3)}</blockquote>"
        if kind < 0.96:
            return f"<pre>{sentence(3, 9)}</pre>"
        if kind < 0.98:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{sentence(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        return f"<div>{prose(1, 4)}</div>"

    pages = []
    for _ in range(n):
        title = f"<h1>{sentence(2, 10)}</h1>" if rng.random() < 0.85 else ""
        if title and rng.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [title] if title else []
        for _ in range(rng.randint(1, 10)):
            parts.append(block())
            if rng.random() < 0.08:
                parts.append(noise(rng.choice(["ad", "share", "related", "form", "notice", "ad"])))
        if title and rng.random() < 0.25:
            parts.insert(1, noise("meta"))
        if rng.random() < 0.15:
            parts.append(noise(rng.choice(["comment", "share", "related", "nav", "footer"])))
        body = "".join(parts)
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        attrs = attribute(GOOD) if tag in ("div", "section") and rng.random() < 0.9 else attribute(GOOD, 0.3)
        body = f"<{tag}{attrs} data-keep>{body}</{tag}>"
        if rng.random() < 0.3:
            body = f"<{rng.choice(['main', 'div', 'div'])}{attribute(GOOD + NEUTRAL, 0.7)}>{body}" + (noise("comment") if rng.random() < 0.3 else "") + "</div>"
        before = [noise(k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.35]
        after = [noise(k) for k in ("related", "comment", "sidebar", "ad", "form", "share", "notice", "footer") if rng.random() < 0.3]
        rng.shuffle(before)
        middle = "".join(before) + body + "".join(after)
        if rng.random() < 0.4:
            middle = f"<div{attribute(NEUTRAL, 0.8)}>{middle}</div>"
        if rng.random() < 0.3:
            middle = noise("header") + middle + noise("footer")
        pages.append(f"<!DOCTYPE html><html><head><title>{sentence(2, 6)}</title></head><body>{middle}" + rng.choice(["</body></html>", "</body></html>", ""]))
    return pages


@lru_cache(1)
def trained_model() -> TreeModel:
    return TreeModel().fit([parse(p) for p in labelled_pages()])


def extract_text(pages: DataFrame, model: TreeModel | None = None, html: str = "html", column: str = "text") -> DataFrame:
    """``pages`` with the main text in ``column``."""
    model = model or trained_model()

    @F.arrow_udf("string")
    def main_text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for source in columns:
            out: list[str] = []
            for at in range(0, len(source), 64):
                out += model.texts([parse(x or "") for x in source[at : at + 64].to_pylist()])
            yield pa.array(out, pa.string())

    return pages.withColumn(column, main_text(F.col(html).cast("string")))
