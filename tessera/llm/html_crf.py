"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

States are boilerplate (0) and article (1). Features are the tags and names of a block's
ancestors, its own tag, its length, how much of it is linked, how it ends and telling
words. Weights maximise the penalised conditional likelihood of labelled pages, and the
best state sequence of a page is found by Viterbi's algorithm.

The labelled pages are composed here: layouts that differ in how they mark the article
and what surrounds it, with blocks whose labels are known as they are written. Their
number is ``TRAINING_PAGES``; nothing is fitted to the table that is read.

Defined cases: a null or empty page has the empty text; broken markup is read as far as
it goes; a very long page is one row and is read once, with a state for each block;
repeated rows are each extracted; columns other than page_id, url and the page are not read,
so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks

TRAINING_PAGES = 1200
SEED = 7
PENALTY = 0.02
STEPS = 160

# ---- labelled pages


def _words(rng: random.Random, low: int, high: int) -> str:
    syllable = ["an", "er", "ti", "on", "re", "lo", "ka", "mi", "su", "té", "ñe", "ü", "the", "of", "de"]
    words = ["".join(rng.choice(syllable) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize()


#: Names that pages give to the article and to what is around it.
ARTICLE_NAMES = ("content", "post", "entry", "entry-content", "post-content", "article", "article-body", "story", "main-content", "text", "body-text", "page-content")
AROUND = {
    "menu": ("menu", "nav", "navbar", "navigation", "top-menu", "breadcrumb", "breadcrumbs", "links", "toc"),
    "side": ("sidebar", "side", "widget", "related", "rail", "aside", "recent-posts", "popular", "more", "read-next"),
    "notice": ("cookie", "cookies", "cookie-banner", "consent", "notice", "gdpr", "alert", "banner", "popup", "modal", "overlay", "message"),
    "advert": ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-slot", "adsbygoogle", "ad-top", "ad-box"),
    "form": ("search", "subscribe", "newsletter", "login", "signup", "search-form", "contact-form", "form"),
    "comments": ("comments", "comment", "comment-list", "commentlist", "discussion", "replies", "reader-comments", "user-comments", "disqus", "respond"),
    "foot": ("footer", "foot", "copyright", "legal", "bottom", "site-footer"),
    "head": ("header", "masthead", "site-header", "top", "branding", "logo", "site-title"),
    "share": ("share", "sharing", "social", "share-buttons", "tags", "meta-links"),
}
#: Elements of each kind; those after the bar say what they are without a name.
BOXES = {
    "menu": ("div", "ul", "|", "nav", "menu"), "side": ("div", "section", "|", "aside"), "notice": ("div", "section", "p", "aside", "|", "dialog"),
    "advert": ("div", "section", "aside", "table", "p", "ins"), "form": ("div", "section", "|", "form", "form"), "comments": ("div", "section", "ol", "ul"),
    "foot": ("div", "p", "|", "footer", "footer"), "head": ("div", "|", "header", "header"), "share": ("div", "ul", "p"),
}
SAYING = {"notice": ("We use cookies. ", "Cookie: "), "advert": ("Advertisement ", "Sponsored: "), "foot": ("&copy; ", "Copyright ", "All rights reserved. "), "comments": ("Reply: ",), "form": ("Subscribe ",)}


def _said(rng: random.Random, mark: str = "") -> str:
    """A run of words; its length and ending say nothing about where it stands."""
    low, high = rng.choice(((1, 4), (3, 12), (8, 30), (20, 90)))
    words = " ".join(mark + w for w in _words(rng, low, high).split())
    return words + rng.choice((".", ".", ".", ""))


def _piece(rng: random.Random, within: str, opening: str) -> str:
    """Something that stands in a box around the article."""
    link = lambda: f'<a href="/{rng.randrange(99)}">{_words(rng, 1, 3)}</a>'
    item = lambda: f"<li>{link() if rng.random() < 0.6 else _said(rng)}{rng.choice(('</li>', ''))}"
    if within in ("ul", "ol"):
        return "".join(f"<li>{rng.choice(('', '<p>'))}{opening}{link() if rng.random() < 0.5 else _said(rng)}</li>" for _ in range(rng.randint(1, 4)))
    if within == "table":
        return f"<tr><td>{opening}{_said(rng)}</td></tr>"
    if within == "p":
        return opening + _said(rng)
    return rng.choice((
        lambda: f"<p>{opening}{_said(rng)}</p>", lambda: f"<p>{opening}{_said(rng)}</p>", lambda: opening + _said(rng), lambda: f"<ul>{item()}{item()}{item()}</ul>",
        lambda: f"<{(h := rng.choice(('h1', 'h2', 'h3', 'h4')))}>{_words(rng, 1, 8)}</{h}>", lambda: f"{link()} {link()}", lambda: f"<div>{opening}{_said(rng)}</div>",
    ))()


def _around(rng: random.Random, kind: str) -> str:
    """A box of a kind: a telling element, a name, or both, with anything in it."""
    boxes = BOXES[kind]
    tag = rng.choice([b for b in boxes if b != "|"])
    tells = "|" in boxes and boxes.index("|") < len(boxes) - 1 - boxes[::-1].index(tag)
    name = rng.choice(AROUND[kind])
    attribute = "" if tells and rng.random() < 0.5 else f' {rng.choice(("class", "class", "id"))}="{name}"'
    opening = rng.choice(SAYING[kind]) if kind in SAYING and rng.random() < 0.12 else ""
    inside = "".join(_piece(rng, tag, opening if not i else "") for i in range(1 if tag == "p" else rng.randint(1, 4)))
    if kind == "form" and tag == "form":
        inside += f"<label>{_words(rng, 1, 3)}</label><input name=q><button>{_words(rng, 1, 2)}</button>"
    if kind == "comments" and rng.random() < 0.5:
        inside += f'<div class="{rng.choice(("comment", "reply", "comment-body"))}"><p>{_said(rng)}</p></div>' if tag in ("div", "section") else ""
    return f"<{tag}{attribute}>{inside}</{tag}>"


def _article_parts(rng: random.Random, keep: str) -> list[str]:
    """Pieces of an article; ``keep`` stands before each word of its blocks."""
    phrases = [w for words in SAYING.values() for w in words]

    def said() -> str:
        """Articles use the phrases of notices and footers too."""
        opening = " ".join(keep + w for w in rng.choice(phrases).split()) if rng.random() < 0.2 else ""
        return rng.choice((opening, f"{opening} {_said(rng, keep)}")) if opening else _said(rng, keep)

    short = lambda: " ".join(keep + w for w in _words(rng, 1, 10).split())
    parts = [f"<h1>{short()}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.62:
            inline = f" <b>{short()}</b> <a href='/x'>{short()}</a>" if rng.random() < 0.2 else ""
            parts.append(f"<p>{said()}{inline}{rng.choice(('</p>', '</p>', ''))}")
        elif kind < 0.7:
            parts.append(f"<p><b>{said()}<br>{said()}</p>")
        elif kind < 0.78:
            parts.append(f"<{(h := rng.choice(('h2', 'h3')))}>{short()}</{h}>")
        elif kind < 0.87:
            parts.append("<ul>" + "".join(f"<li>{said()}{rng.choice(('</li>', ''))}" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.92:
            parts.append(f"<blockquote>{said()}</blockquote>")
        elif kind < 0.96:
            parts.append(f"<table><tr><td>{said()}</td><td>{said()}</td></tr></table>")
        else:
            parts.append(f"<{(t := rng.choice(('pre', 'div', 'section')))}>{said()}</{t}>")
    return parts


#: A private-use character that stands before the words of articles while pages are composed.
KEEP = "\ue000"


def training_page(rng: random.Random) -> list[tuple[Block, int]]:
    """The blocks of one composed page with their labels."""
    parts = _article_parts(rng, KEEP)
    for kind in AROUND:
        if rng.random() < 0.22:
            parts.insert(rng.randint(1, len(parts)), _around(rng, kind))
    shape = rng.random()
    if shape < 0.45:
        opening, closing = f"<article{rng.choice(('', ' class=post'))}>", "</article>"
    elif shape < 0.6:
        opening, closing = "<main>", "</main>"
    elif shape < 0.92:
        opening, closing = f'<div {rng.choice(("class", "id"))}="{rng.choice(ARTICLE_NAMES)}">', "</div>"
    else:
        opening, closing = rng.choice((("<div>", "</div>"), ("<section>", "</section>"), ("", "")))
    if shape < 0.45 and rng.random() < 0.3:
        opening, closing = "<main>" + opening, closing + "</main>"
    before = [_around(rng, k) for k in AROUND if rng.random() < 0.3]
    after = [_around(rng, k) for k in AROUND if rng.random() < 0.3]
    rng.shuffle(before)
    rng.shuffle(after)
    wrap = rng.choice((("", ""), ('<div class="wrapper">', "</div>"), ('<div id="page"><div class="container">', "</div></div>")))
    page = f"<html><head><title>x</title></head><body>{wrap[0]}{''.join(before)}{opening}{''.join(parts)}{closing}{''.join(after)}{wrap[1]}</body></html>"
    return [(b._replace(text=b.text.replace(KEEP, "")), int(b.text.startswith(KEEP))) for b in blocks(page)]


# ---- the model


class Crf:
    """Weights: one for each feature and state, and one for each pair of states."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, pair: np.ndarray, edge: np.ndarray):
        self.names, self.unary, self.pair, self.edge = names, unary, pair, edge

    def scores(self, page: list[Block]) -> np.ndarray:
        get = self.names.get
        out = np.zeros((len(page), 2))
        for i, b in enumerate(page):
            at = [k for f in b.features if (k := get(f)) is not None]
            out[i] = self.unary[at].sum(axis=0) if at else 0
        return out

    def decode(self, page: list[Block]) -> np.ndarray:
        """The best states of a page's blocks (Viterbi)."""
        if not page:
            return np.empty(0, int)
        s = self.scores(page)
        best, came = s[0] + self.edge[0], np.zeros((len(s), 2), int)
        for i in range(1, len(s)):
            step = best[:, None] + self.pair
            came[i] = step.argmax(axis=0)
            best = step.max(axis=0) + s[i]
        states = np.empty(len(s), int)
        states[-1] = int((best + self.edge[1]).argmax())
        for i in range(len(s) - 1, 0, -1):
            states[i - 1] = came[i, states[i]]
        return states


def train(pages: list[list[tuple[Block, int]]], steps: int = STEPS, penalty: float = PENALTY) -> Crf:
    """Fit by Adam over the exact gradient: empirical minus expected feature counts."""
    pages = [p for p in pages if p]
    names: dict[str, int] = {}
    for p in pages:
        for b, _ in p:
            for f in b.features:
                names.setdefault(f, len(names))
    sizes = np.array([len(p) for p in pages])
    order = np.argsort(-sizes, kind="stable")
    pages, sizes = [pages[i] for i in order], sizes[order]
    n, longest = len(pages), int(sizes[0])
    row = np.array([i for p_i, p in enumerate(pages) for t, (b, _) in enumerate(p) for i in [p_i * longest + t] * len(b.features)])
    column = np.array([names[f] for p in pages for b, _ in p for f in b.features])
    label = np.zeros((n, longest), int)
    for i, p in enumerate(pages):
        label[i, : len(p)] = [y for _, y in p]
    live = np.arange(longest) < sizes[:, None]
    gold = np.eye(2)[label] * live[..., None]
    w = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    last = sizes - 1
    for step in range(1, steps + 1):
        s = np.stack([np.bincount(row, w[0][column, k], n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        s[:, 0] += w[2][0]
        s[np.arange(n), last] += w[2][1]
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0]
        for t in range(1, longest):
            k = int((sizes > t).sum())
            forward[:k, t] = s[:k, t] + np.logaddexp(forward[:k, t - 1, :1] + w[1][0], forward[:k, t - 1, 1:] + w[1][1])
        for t in range(longest - 2, -1, -1):
            k = int((sizes > t + 1).sum())
            after = s[:k, t + 1] + backward[:k, t + 1]
            backward[:k, t] = np.logaddexp(after[:, :1] + w[1][:, 0], after[:, 1:] + w[1][:, 1])
        z = np.logaddexp.reduce(forward[np.arange(n), last], axis=1)
        p = np.exp(np.minimum(0, forward + backward - z[:, None, None])) * live[..., None]
        off = (gold - p).reshape(-1, 2)
        pair = np.zeros((2, 2))
        both = live[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                joint = forward[:, :-1, a] + w[1][a, b] + s[:, 1:, b] + backward[:, 1:, b] - z[:, None]
                pair[a, b] = (gold[:, :-1, a] * gold[:, 1:, b] * both).sum() - (np.exp(np.minimum(0, joint)) * both).sum()
        edge = np.stack([(gold - p)[:, 0].sum(axis=0), (gold - p)[np.arange(n), last].sum(axis=0)])
        unary = np.stack([np.bincount(column, off[row, k], len(names)) for k in (0, 1)], axis=1)
        for i, g in enumerate((unary, pair, edge)):
            g = g - penalty * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] + 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Crf(names, *w)


@lru_cache(maxsize=2)
def default_model(pages: int = TRAINING_PAGES, seed: int = SEED) -> Crf:
    """The model of composed pages, fitted once in a process."""
    rng = random.Random(seed)
    return train([training_page(rng) for _ in range(pages)])


def main_text(page: str | None, model: Crf) -> str:
    found = blocks(page) if page else []
    return " ".join(b.text for b, y in zip(found, model.decode(found)) if y)


def extract(pages: DataFrame, model: Crf | None = None, html_col: str = "html") -> DataFrame:
    """page_id, url, text of each row."""
    model = model or default_model()
    shared = pages.sparkSession.sparkContext.broadcast((model.names, model.unary, model.pair, model.edge))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*shared.value)
        for batch in batches:
            texts = [main_text(x.as_py(), crf) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(rows, "page_id long, url string, text string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
