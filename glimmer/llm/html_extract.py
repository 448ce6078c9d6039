"""Main text of web pages by a tree-structured graphical model.

Each node of a page's tree is content or not.  Its features (kind, names and roles, length,
links, sentences, place) give a potential of its own, and each parent and child have a joint
potential by their kinds.  Sum-product messages pass up to the root and down again, for all
pages of a chunk level by level, and give the exact marginal of each node; a text run is kept
if its marginal is above one half.  The weights maximise the likelihood of labelled pages, with
expectations from the same messages.

The labelled pages are laid out by ``labelled_pages``: a page of each draw has navigation,
headers, adverts, notices, sidebars, forms, comments and footers around and inside an article,
in semantic elements, in named ones or in bare ones, with words of a bounded sample of the given
pages (``SAMPLE_PAGES`` rows, ``SAMPLE_WORDS`` words of each).

Null html counts as empty, and an empty page gives an empty text.  Repeated rows give repeated
results, ids are only carried, an empty table gives no rows, other columns are dropped whatever
their names.  Whole pages are read; broken markup is read as browsers do: open elements end with
their parents, unfinished tags, comments and scripts reach to the end.
"""

from __future__ import annotations

import html as entities
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import as_text
from glimmer.llm.html_tree import KINDS, Forest, block_text, chunk

#: Rows whose words fill the labelled pages, and words taken of each.
SAMPLE_PAGES, SAMPLE_WORDS = 40, 2000
#: Labelled pages, and rounds of gradient steps.
LABELLED, ROUNDS = 900, 240
#: Characters of html that are read at a time; a longer page is one chunk.
CHUNK_CHARS = 1 << 20
#: Used where the pages have no words.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


class Layout:
    """Draws labelled pages; ``data-keep`` marks what is content."""

    def __init__(self, words: list[str], seed: int) -> None:
        self.words, self.rng = words or WORDS, random.Random(seed)

    def some(self, *options):
        return self.rng.choice(options)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def text(self, least: int, most: int) -> str:
        n = self.rng.randint(least, most)
        return entities.escape(" ".join(self.rng.choice(self.words) for _ in range(n)))

    def sentences(self, most: int) -> str:
        return " ".join(self.text(3, 18).rstrip(".,") + "." for _ in range(self.rng.randint(1, most)))

    def links(self, least: int = 2, most: int = 9) -> str:
        n = self.rng.randint(least, most)
        each = [f'<a href="/{k}">{self.text(1, 3)}</a>' for k in range(n)]
        return self.some("<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>", " | ".join(each), "".join(f"<p>{a}</p>" for a in each), "<ul><li>" + "<li>".join(each) + "</ul>")

    def named(self, tag: str, names: list[str], inner: str, keep: int, bare: float = 0.15) -> str:
        """An element of its own kind, a named one, or a bare one."""
        p = self.rng.random()
        if p < bare:
            return f"<div data-keep={keep}>{inner}</div>"
        name = self.rng.choice(names)
        if p < 0.55:
            what, tag = self.some("class", "class", "id"), self.some("div", "div", "section")
            return f'<{tag} {what}="{name}" data-keep={keep}>{inner}</{tag}>'
        if p < 0.7:
            return f'<{tag} class="{name}" data-keep={keep}>{inner}</{tag}>'
        return f"<{tag} data-keep={keep}>{inner}</{tag}>"

    def boxed(self, named: str, inner: str) -> str:
        """A named box that is no content; a paragraph where nothing in it would end one."""
        tags = ["div", "div", "section", "aside"] + ["p", "span"] * ("<p" not in inner and "<h" not in inner)
        tag = self.rng.choice(tags)
        return f"<{tag} {named} data-keep=0>{inner}</{tag}>"

    def nav(self) -> str:
        return self.named("nav", ["nav", "navbar", "main-menu", "menu", "breadcrumbs", "topnav", "pagination", "tabs", "site-nav"], self.links(), 0)

    def header(self) -> str:
        inner = self.some(f"<a href='/'>{self.text(1, 3)}</a>", f"<h1>{self.text(1, 4)}</h1>", f"<p>{self.text(1, 6)}</p>", f"<div>{self.text(1, 4)}</div>{self.links()}", self.text(1, 5))
        return self.named("header", ["header", "masthead", "site-header", "branding", "topbar", "page-header", "logo"], inner, 0, 0.05)

    def footer(self) -> str:
        inner = self.some(f"&copy; {self.text(1, 4)} &middot; {self.sentences(2)}", f"<p>{self.sentences(2)}</p>{self.links()}", self.links(), f"<p>Copyright 2024 {self.text(1, 5)}. All rights reserved.</p>", self.sentences(3))
        return self.named("footer", ["footer", "site-footer", "colophon", "page-bottom", "copyright", "legal"], inner, 0, 0.05)

    def advert(self) -> str:
        inner = self.some(self.sentences(2), f"<p>{self.sentences(2)}</p>", f"<a href='/x'>{self.text(2, 12)}</a>", f"Advertisement<p>{self.text(2, 20)}</p>")
        name = self.some("ad", "ads", "ad-box", "advert", "advertisement", "sponsored", "promo", "adslot", "banner-ad", "top_ad", "sponsor-message", "promotion")
        return self.boxed(f'{self.some("class", "id")}="{name}"', inner)

    def notice(self) -> str:
        inner = self.some(f"<p>{self.sentences(3)}</p><button>{self.text(1, 2)}</button>", f"{self.sentences(2)} <a href='/p'>{self.text(1, 2)}</a>", f"We use cookies. {self.sentences(2)}", f"<h3>{self.text(1, 3)}</h3><p>{self.sentences(2)}</p>")
        kind = self.some("class='cookie-notice'", "id='consent'", "class='cookie-banner'", "role='alert'", "class='notice'", "class='gdpr-popup'", "role='dialog'", "class='newsletter-signup'", "class='site-notice'", "class='subscribe-box'", "class='notification'", "class='modal overlay'")
        return self.boxed(kind, inner)

    def aside(self) -> str:
        inner = self.some(f"<h3>{self.text(1, 3)}</h3>{self.links()}", self.links(), f"<h2>{self.text(1, 3)}</h2><p>{self.sentences(3)}</p>", f"<p>{self.sentences(4)}</p>", "".join(f"<div><a href='/'>{self.text(3, 10)}</a></div>" for _ in range(4)))
        return self.named("aside", ["sidebar", "side", "related", "related-posts", "widget", "right-sidebar", "recommended", "trending", "popular"], inner, 0, 0.0)

    def form(self) -> str:
        inner = self.some(f"<label>{self.text(1, 3)}</label><input name=q><button>{self.text(1, 2)}</button>", f"<p>{self.sentences(2)}</p><input type=email><textarea></textarea>", f"<label>{self.text(1, 2)} <input></label><select><option>{self.text(1, 1)}</select>")
        return self.some(f"<form data-keep=0>{inner}</form>", f"<form class='{self.some('search', 'contact', 'login')}' data-keep=0>{inner}</form>", f"<div class='{self.some('search-form', 'login-box', 'contact-form')}' data-keep=0><form>{inner}</form></div>")

    def share(self) -> str:
        return f"<div class='{self.some('share', 'social', 'share-buttons', 'social-links', 'toolbar')}' data-keep=0>{self.some(self.links(), self.text(1, 4))}</div>"

    def comments(self) -> str:
        one = lambda: self.some(f"<div class='comment'><b>{self.text(1, 2)}</b><p>{self.sentences(5)}</p></div>", f"<article class='comment'><p>{self.sentences(4)}</p></article>", f"<li class='comment-body'><p>{self.sentences(4)}</p></li>", f"<div><h4>{self.text(1, 2)}</h4><p>{self.sentences(6)}</p></div>", f"<p>{self.sentences(5)}</p>")
        inner = "".join(one() for _ in range(self.rng.randint(1, 6)))
        head = self.some("", f"<h2>{self.text(1, 2)}</h2>", f"<h3>{self.rng.randint(1, 30)} Comments</h3>")
        tag, name = self.some("div", "section", "aside", "ol"), self.some("id='comments'", "class='comments'", "class='comment-list'", "id='disqus_thread'", "class='reader-comments'", "id='responses'", "class='discussion'", "class='user-comments'")
        return f"<{tag} {name} data-keep=0>{head}{inner}{self.some('', self.form())}</{tag}>"

    def unit(self) -> str:
        """A block of an article."""
        p = self.rng.random()
        if p < 0.45:
            return self.some(f"<p>{self.sentences(9)}</p>", f"<p>{self.sentences(9)}", f"<p><b>{self.sentences(6)}<br>", f"<p>{self.sentences(2)}</p>", f"<p>{self.text(1, 2)}.</p>")
        if p < 0.6:
            return f"<p>{self.sentences(3)} <a href='/y'>{self.text(1, 4)}</a> {self.sentences(3)}</p>"
        if p < 0.66:
            return f"<h2>{self.text(1, 7)}</h2>"
        if p < 0.72:
            return f"<ul>{''.join(f'<li>{self.text(2, 14)}</li>' for _ in range(self.rng.randint(1, 6)))}</ul>"
        if p < 0.77:
            return f"<blockquote><p>{self.sentences(4)}</p></blockquote>"
        if p < 0.81:
            return f"<figure><img src=a.png><figcaption>{self.text(2, 12)}</figcaption></figure>"
        if p < 0.85:
            return "<table>" + "".join(f"<tr><td>{self.text(1, 3)}<td>{self.text(1, 6)}</tr>" for _ in range(3)) + "</table>"
        if p < 0.9:
            return f"<p>{self.sentences(3)} <span class='{self.some('highlight', 'dropcap', 'term', 'text')}'>{self.text(1, 3)}</span> {self.sentences(3)}</p>"
        if p < 0.95:
            return f"<div>{self.sentences(7)}</div>"
        return f"<pre>{self.text(4, 30)}</pre><ol><li>{self.sentences(2)}<li><a href='/z'>{self.text(1, 4)}</a></ol>"

    def article(self) -> str:
        title = f"<h1>{self.text(1, 12)}</h1>"
        title = self.some(title, title, title, f"<h1 class='{self.some('title', 'entry-title', 'headline')}'>{self.text(2, 9)}</h1>", f"<h2>{self.text(2, 9)}</h2>", f"<header data-keep=1>{title}</header>", "")
        units = [self.unit() for _ in range(self.rng.choice((1, 1, 2, 3, 5, 8, 14, 25)))]
        for _ in range(self.rng.choice((0, 0, 0, 1, 2))):
            units.insert(self.rng.randint(0, len(units)), self.some(self.advert, self.aside, self.share, self.notice, self.form, self.nav)())
        inner = title + "".join(units)
        name = self.some("content", "main-content", "article-body", "post", "entry-content", "story", "post-body", "text")
        p = self.rng.random()
        if p < 0.45:
            return f"<article data-keep=1>{inner}</article>"
        if p < 0.55:
            return f"<main data-keep=1>{inner}</main>"
        if p < 0.65:
            return f"<main><article class='{name}' data-keep=1>{inner}</article></main>"
        if p < 0.82:
            return f"<div {self.some('class', 'id')}='{name}' data-keep=1>{inner}</div>"
        if p < 0.88:
            return f"<article><div class='{name}' data-keep=1>{inner}</div></article>"
        if p < 0.95:
            return f"<div data-keep=1>{inner}</div>"
        return f"<section data-keep=1>{inner}</section>"

    def page(self) -> str:
        around = lambda options, p: "".join(o() for o in self.rng.sample(options, len(options)) if self.chance(p))
        top = around([self.header, self.nav, self.advert, self.notice, self.form], 0.45)
        bottom = around([self.comments, self.aside, self.notice, self.advert, self.form, self.nav, self.share, self.comments], 0.25) + (self.footer() if self.chance(0.8) else "")
        body = self.article()
        if self.chance(0.3):
            beside = self.some(self.aside, self.aside, self.nav)()
            body = self.some(f"<table><tr><td>{beside}</td><td>{body}</td></tr></table>", f"<div class='{self.some('wrapper', 'container', 'row')}'>{body}{beside}</div>", f"<div>{beside}{body}</div>")
        return f"<html><head><title>x</title><script>var t='</p>';</script></head><body>{top}{body}{bottom}</body></html>"


def labelled_pages(words: list[str], n: int = LABELLED, seed: int = 7) -> list[str]:
    layout = Layout(words, seed)
    return [layout.page() for _ in range(n)]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


class Model:
    """Weights of the features, and tables of joint potentials by kind of the child and of the parent."""

    def __init__(self, features: int) -> None:
        self.node = np.zeros(features)
        self.child = np.zeros((len(KINDS), 2, 2))
        self.above = np.zeros((len(KINDS), 2, 2))

    def weights(self) -> list[np.ndarray]:
        return [self.node, self.child, self.above]

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """(probability of content of each node, joint probability of each node and its parent)."""
        n = len(f.parent)
        own = np.zeros((n, 2))
        own[:, 1] = f.features @ self.node
        parents = np.maximum(f.parent, 0)
        joint = self.child[f.kind] + self.above[f.kind[parents]]  # [node, parent's state, own state]
        sent = np.zeros((n, 2))
        for nodes in reversed(f.levels[1:]):
            sent[nodes] = _log_sum(joint[nodes] + own[nodes][:, None, :], 2)
            f.add(own, nodes, sent[nodes])
        full = own.copy()
        for nodes in f.levels[1:]:
            rest = full[f.parent[nodes]] - sent[nodes]
            full[nodes] += _log_sum(joint[nodes] + rest[:, :, None], 1)
        p = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700)))
        both = joint + (full[parents] - sent)[:, :, None] + own[:, None, :]
        both = np.exp(both - both.max((1, 2), keepdims=True))
        both /= both.sum((1, 2), keepdims=True)
        both[f.parent < 0] = 0
        return p, both


def labels(f: Forest) -> np.ndarray:
    """A text run is content if the nearest mark above says so, another node if a run below is."""
    mark = f.mark.copy()
    for nodes in f.levels[1:]:
        mark[nodes] = np.where(mark[nodes] < 0, mark[f.parent[nodes]], mark[nodes])
    is_leaf = np.zeros(len(mark))
    is_leaf[f.leaf] = mark[f.leaf] == 1
    return (f.up(is_leaf) > 0).astype(int)


def fitted(pages: list[str], rounds: int = ROUNDS, rate: float = 0.3, ridge: float = 2e-6) -> Model:
    """Gradient ascent on the likelihood of the labels of all nodes."""
    t, f = chunk(pages)
    y = labels(f)
    n, parents, child = len(y), np.maximum(f.parent, 0), f.parent >= 0
    seen = np.zeros((n, 2, 2))
    seen[np.arange(n), y[parents], y] = 1
    seen[~child] = 0
    m = Model(f.features.shape[1])
    first, second = [np.zeros_like(w) for w in m.weights()], [np.zeros_like(w) for w in m.weights()]
    for k in range(1, rounds + 1):
        p, both = m.messages(f)
        more = seen - both
        by_child, by_parent = (np.stack([np.bincount(k, w, len(KINDS)) for w in more.reshape(n, 4).T], 1).reshape(-1, 2, 2) for k in (f.kind, f.kind[parents]))
        for w, g, a, b in zip(m.weights(), (f.features.T @ (y - p), by_child, by_parent), first, second, strict=True):
            g = g / n - ridge * w
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += rate * (1 - 0.9 * k / rounds) * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return m


def train(pages: DataFrame) -> Model:
    """Fit the model on labelled pages with words of a sample of the given ones, chosen by a hash."""
    plain = F.regexp_replace(as_text("html"), "(?s)<(script|style)\\b.*?</|<[^>]*>|&#?\\w+;?", " ")
    words = F.slice(F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.contains("<")), 1, SAMPLE_WORDS)
    chosen = pages.select("page_id", "html").orderBy(F.xxhash64(F.col("page_id").cast("string")), F.xxhash64("html")).limit(SAMPLE_PAGES)
    return fitted(labelled_pages([w for r in chosen.select(words.alias("words")).collect() for w in r["words"]]))


def extract(pages: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every row.  There is no shuffle: pages are read where they lie."""

    def texts(some: list[str]) -> list[str]:
        t, f = chunk(some)
        keep = model.messages(f)[0][f.leaf] > threshold
        return [block_text(t, i, keep) for i in range(len(some))]

    def run(batches):
        for batch in batches:
            some, size, out = [], 0, []
            for page in batch.column(2).to_pylist():
                if some and size + len(page) > CHUNK_CHARS:
                    out += texts(some)
                    some, size = [], 0
                some.append(page)
                size += len(page)
            out += texts(some) if some else []
            counts = pa.array([len(x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema}
    return pages.select("page_id", "url", as_text("html").alias("html")).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
