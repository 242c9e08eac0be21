"""Operator 7: main text of web pages by boosted trees over DOM nodes.

Every element gets features of its subtree (text and link density, marks),
attribute tokens, depth, siblings and ancestors; boosted trees score whether it
belongs to the article.  Decoding picks the likeliest choice for the whole tree
in which no element is in while an ancestor is out, so a paragraph cannot be
kept inside a dropped sidebar and a dropped advert takes all it holds along.

The trees are trained on the driver on pages that are made up here from many
layouts with a fixed seed, of which the article is known; no page of the input
is read for it.

Edge cases: null and empty html give an empty text; broken or cut-off markup is
parsed forgivingly; text outside any element belongs to the root; repeated rows
are alike; null ids stay null; other columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import html as html_module
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import read_table
from .dom import Page, parse

TRAINING_PAGES = 700
SEED = 11
#: Pages that are judged at once: these characters, or one page that is longer.
BATCH_CHARS = 1 << 20

# What names of classes, ids and roles tell, by kind.
NAME_KINDS = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc topnav",
    "header": "header masthead banner branding logo topbar hero",
    "footer": "footer foot copyright colophon legal bottom",
    "side": "side sidebar aside rail widget widgets secondary complementary",
    "advert": "ad ads advert adverts advertisement advertising promo promotion sponsor sponsored banner dfp adsense",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe paywall toast privacy",
    "comment": "comment comments reply replies discussion disqus respond thread responses",
    "share": "share sharing social follow twitter facebook",
    "related": "related recommended recommendations more popular trending readnext also teaser",
    "form": "form search login signup register input",
    "article": "article post story entry news blog articlebody hentry",
    "content": "content body text main maincontent prose page copy",
    "meta": "meta byline author date tags tag category categories caption credit",
}
TAG_KINDS = [
    {"p"},
    {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"li", "dd", "dt"},
    {"ul", "ol", "dl", "menu"},
    {"a"},
    {"div"},
    {"section"},
    {"article", "main"},
    {"nav"},
    {"header"},
    {"footer"},
    {"aside"},
    {"form", "input", "button", "label", "fieldset", "option"},
    {"table", "tr", "td", "th", "tbody", "thead"},
    {"pre", "code", "blockquote"},
    {"figure", "figcaption", "img"},
    {"b", "i", "em", "strong", "span", "u", "small", "sup", "sub", "abbr", "q", "cite", "mark"},
]
_OF_TAG = {tag: k for k, tags in enumerate(TAG_KINDS) for tag in tags}
_OF_NAME = {name: k for k, names in enumerate(NAME_KINDS.values()) for name in names.split()}
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
N_TAGS, N_NAMES = len(TAG_KINDS), len(NAME_KINDS)
#: Ancestors of these kinds of tags count, as do names of all kinds.
_ABOVE = (7, 8, 9, 10, 11, 12)


@lru_cache(maxsize=10_000)
def _name_kinds(names: str) -> tuple[int, ...]:
    tokens = _SPLIT.split(_CAMEL.sub(" ", names).lower())
    return tuple(sorted({_OF_NAME[t] for t in tokens if t in _OF_NAME}))


def node_features(page: Page) -> np.ndarray:
    """One row per node of the page, in page order."""
    nodes = page.nodes
    n = len(nodes)
    own = np.zeros((n, 6))  # characters, words, stops, commas, characters of ©|»·, blocks
    for block in page.blocks:
        for node, piece in block:
            words = len(piece.split())
            if words:
                own[node] += (len(piece), words, piece.count(".") + piece.count("?") + piece.count("!"), piece.count(","), sum(map(piece.count, "©|»·›")) + piece.count("&copy;") + piece.count("&middot;"), 0)
        own[block[0][0], 5] += 1
    sub = own.copy()
    size, links, paragraphs, items, anchors = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n - 1, 0, -1):  # children come after their parents
        node = nodes[k]
        if node.tag == "a":
            links[k], anchors[k] = sub[k, 0], anchors[k] + 1
        elif node.tag == "p":
            paragraphs[k] += 1
        elif node.tag == "li":
            items[k] += 1
        up = node.parent
        sub[up] += sub[k]
        size[up] += size[k]
        links[up] += links[k]
        paragraphs[up] += paragraphs[k]
        items[up] += items[k]
        anchors[up] += anchors[k]
    tags, names = np.zeros((n, N_TAGS)), np.zeros((n, N_NAMES))
    above_tags, above_names = np.zeros((n, N_TAGS)), np.zeros((n, N_NAMES))
    place, brothers, share, before, deep = np.zeros(n), np.ones(n), np.ones(n), np.zeros(n), np.zeros(n)
    seen = 0.0
    for k, node in enumerate(nodes):
        kind = _OF_TAG.get(node.tag)
        if kind is not None:
            tags[k, kind] = 1
        if node.names:
            names[k, list(_name_kinds(node.names))] = 1
        before[k] = seen
        seen += own[k, 0]
        deep[k] = node.depth
        if k:
            up = node.parent
            above_tags[k] = np.maximum(above_tags[up], tags[up])
            above_names[k] = np.maximum(above_names[up], names[up])
            share[k] = sub[k, 0] / max(sub[up, 0], 1)
        for at, child in enumerate(node.children):
            place[child], brothers[child] = at, len(node.children)
    total = max(sub[0, 0], 1)
    chars, words = sub[:, 0], np.maximum(sub[:, 1], 1)
    rest = [
        np.log1p(chars),
        chars / total,
        np.log1p(own[:, 0]),
        chars / size,
        links / np.maximum(chars, 1),
        anchors / words,
        sub[:, 2] / words,
        sub[:, 3] / words,
        sub[:, 4] / words,
        chars / np.maximum(sub[:, 5], 1),
        np.log1p(paragraphs),
        np.log1p(items),
        size,
        deep,
        place,
        brothers,
        place / brothers,
        share,
        before / total,
    ]
    return np.concatenate([np.stack(rest, 1), tags, names, above_tags[:, _ABOVE], above_names], 1)


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """Which nodes are in: the likeliest choice where children need parents."""
    log_in, log_out = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    inside, outside = log_in.copy(), log_out.copy()
    for k in range(len(page.nodes) - 1, 0, -1):
        up = page.nodes[k].parent
        inside[up] += max(inside[k], outside[k])
        outside[up] += outside[k]
    chosen = np.zeros(len(page.nodes), bool)
    for k, node in enumerate(page.nodes):
        chosen[k] = (node.parent < 0 or chosen[node.parent]) and inside[k] > outside[k]
    return chosen


def main_text(page: Page, chosen: np.ndarray) -> str:
    blocks = []
    for block in page.blocks:
        text = " ".join(html_module.unescape("".join(piece for node, piece in block if chosen[node])).split())
        if text:
            blocks.append(text)
    return "\n\n".join(blocks)


#: Marks article text in pages made up for training; private-use character.
_MAIN = "\ue000"


class PageMaker:
    """Pages of invented prose in varied layouts with a known article."""

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choices("abcdefghilmnoprstuvéüñ", k=self.r.randint(1, 4))) for _ in range(120)]

    def words(self, low: int, high: int) -> list[str]:
        return ["".join(self.r.choices(self.syllables, k=self.r.randint(1, 3))) for _ in range(self.r.randint(low, high))]

    def sentences(self, low: int, high: int) -> str:
        style = self.style
        out = []
        for _ in range(self.r.randint(low, high)):
            w = self.words(1, 22)
            if style == "symbols":
                w = [x + self.r.choice(["***", "$$$", "###", "%%%", "&amp;&amp;"]) for x in w]
            if style == "shout":
                w = [x.upper() + "!!" for x in w]
            if style == "bars":
                w = [x + " |" for x in w]
            out.append(" ".join(x + ("," if self.r.random() < 0.08 else "") for x in w).capitalize() + self.r.choice("....?"))
        return " ".join(out)

    def tag(self, name: str, body: str, names: str | None = None, close: float = 1.0) -> str:
        shown = ""
        if names is None and self.r.random() < 0.25:
            names = self.r.choice(["x1", "css-9f2", "row", "col-8", "wrap", "inner", "clearfix", "box"])
        if names:
            shown = f' {self.r.choice(["class", "class", "id"])}="{names}"'
        return f"<{name}{shown}>{body}" + (f"</{name}>" if self.r.random() < close else "")

    def link_list(self, n: int) -> str:
        items = [f'<a href="/{k}">{" ".join(self.words(1, 3))}</a>' for k in range(n)]
        form = self.r.choice(["ul", "flat", "bars"])
        if form == "ul":
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return (" | " if form == "bars" else " ").join(items)

    def noise(self) -> str:
        r, kind = self.r, self.r.choice(["nav", "header", "ad", "ad", "notice", "side", "form", "share", "related", "comments", "footer"])
        style, self.style = self.style, "plain"
        try:
            if r.random() < 0.1:  # links in boxes that tell nothing
                return self.nested(self.link_list(r.randint(3, 10)), 3)
            if kind == "nav":
                body = self.link_list(r.randint(2, 9))
                return self.tag("nav", body) if r.random() < 0.6 else self.tag("div", body, r.choice(["menu", "nav-main", "breadcrumbs", "top-menu"]))
            if kind == "header":
                body = self.tag(r.choice(["div", "h1", "p", "span"]), " ".join(self.words(1, 5))) + (self.link_list(3) if r.random() < 0.5 else "")
                return self.tag("header", body) if r.random() < 0.6 else self.tag("div", body, r.choice(["header", "masthead", "site-header"]))
            if kind == "ad":
                body = self.sentences(1, 3) if r.random() < 0.7 else self.tag("p", self.sentences(1, 2))
                return self.tag(r.choice(["div", "div", "aside", "section"]), body, r.choice(["ad", "ads", "advert", "ad-slot", "promo", "sponsored", "banner-ad"]))
            if kind == "notice":
                body = self.tag("p", self.sentences(1, 3)) + ("<button>OK</button>" if r.random() < 0.6 else "")
                return self.tag("div", body, r.choice(["cookie-notice", "notice", "consent", "newsletter", "popup", "gdpr", "alert"]))
            if kind == "side":
                body = self.tag("h3", " ".join(self.words(1, 3))) + (self.link_list(5) if r.random() < 0.6 else self.tag("p", self.sentences(1, 4)))
                return self.tag("aside", body) if r.random() < 0.6 else self.tag("div", body, r.choice(["sidebar", "side", "widget", "right-rail"]))
            if kind == "form":
                body = "".join(f"<label>{' '.join(self.words(1, 3))}</label><input name=a>" for _ in range(r.randint(1, 3)))
                return self.tag("form", body + self.tag("p", self.sentences(0, 2)) + "<button>" + " ".join(self.words(1, 2)) + "</button>")
            if kind == "share":
                return self.tag("div", self.link_list(r.randint(2, 5)), r.choice(["share", "social", "share-buttons"]))
            if kind == "related":
                return self.tag(r.choice(["div", "section", "aside"]), self.tag("h2", " ".join(self.words(1, 3))) + self.link_list(r.randint(2, 6)), r.choice(["related", "recommended", "more-stories", "popular"]))
            if kind == "comments":
                one = lambda: self.tag(r.choice(["div", "li", "article"]), self.tag("span", " ".join(self.words(1, 2))) + self.tag("p", self.sentences(1, 4)), r.choice(["comment", "comment-body", "reply"]))
                return self.tag(r.choice(["section", "div", "ol"]), "<h3>" + " ".join(self.words(1, 2)) + "</h3>" + "".join(one() for _ in range(r.randint(1, 6))), r.choice(["comments", "comment-list", "discussion", "responses"]))
            body = f"&copy; {' '.join(self.words(1, 2))}.example.com &middot; " + self.sentences(1, 2) if r.random() < 0.6 else self.link_list(4)
            return self.tag("footer", body) if r.random() < 0.7 else self.tag("div", body, r.choice(["footer", "copyright", "page-footer"]))
        finally:
            self.style = style

    def plain_name(self) -> str:
        """A name that tells nothing, as style compilers make them."""
        return self.r.choice(["css-", "sc-", "jsx-", "x", "c", "u-", "b"]) + "".join(self.r.choices("0123456789abcdef", k=self.r.randint(1, 6)))

    def nested(self, body: str, most: int) -> str:
        """The body in some elements that tell nothing."""
        for _ in range(self.r.randint(0, most)):
            body = self.tag(self.r.choice(["div", "div", "div", "section", "span"]), body, self.plain_name() if self.r.random() < 0.7 else None)
        return body

    def bare_paragraphs(self) -> str:
        """An article of elements that tell nothing: each part in nested boxes of its own."""
        m, depth = _MAIN, self.r.choice([0, 1, 2, 4])
        parts = [self.nested(self.tag(self.r.choice(["h1", "h2", "div", "span"]), m + " ".join(self.words(2, 9)), self.plain_name()), depth)]
        for _ in range(self.r.choice([1, 2, 2, 3, 5, 8])):
            parts.append(self.nested(self.tag(self.r.choice(["div", "div", "p", "span"]), m + self.sentences(1, self.r.choice([1, 2, 4, 7])), self.plain_name() if self.r.random() < 0.6 else None), depth))
            if self.r.random() < 0.08:
                parts.append(self.noise())
        return self.nested("".join(parts), 4)

    def old_table(self) -> str:
        """A page of tables: links in one cell, the article with its fonts in another."""
        r, m = self.r, _MAIN
        title = m + " ".join(self.words(2, 9))
        head = r.choice([f"<font size=+2><b>{title}</b></font>", f"<font size=5 color=#333>{title}</font>", f"<center><font face=arial>{title}</font></center>", f"<b>{title}</b>"])
        gap = r.choice(["<br><br>", "<p>", "<br>"])
        texts = [r.choice(["", "<font size=2>"]) + m + self.sentences(1, r.choice([1, 3, 6])) for _ in range(r.randint(1, 6))]
        body = head + gap + gap.join(t + ("</font>" if t.startswith("<font") else "") for t in texts)
        links = "<td width=120>" + r.choice(["<br>", " "]).join(f'<a href="/{k}">{" ".join(self.words(1, 2))}</a>' for k in range(r.randint(3, 9))) + "</td>"
        cells = links + f"<td valign=top>{body}</td>" if r.random() < 0.7 else f"<td>{body}</td>" + links
        low = r.choice(["", f"<tr><td colspan=2><font size=1>&copy; {' '.join(self.words(1, 2))} {self.link_list(2)}</font></td></tr>"])
        return f"<table border=0><tr>{cells}</tr>{low}</table>"

    def article(self) -> str:
        r, m = self.r, _MAIN
        layout = r.random()
        if layout < 0.14:
            return self.bare_paragraphs()
        if layout < 0.22:
            return self.old_table()
        parts = []
        if r.random() < 0.85:
            title = self.tag(r.choice(["h1", "h1", "h2"]), m + " ".join(self.words(1, 12)))
            parts.append(f"<center>{title}</center>" if r.random() < 0.06 else title)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.7:
                form = r.random()
                text = m + self.sentences(1, r.choice([1, 2, 5, 8]))
                if form < 0.2:
                    parts.append(f"<p><b>{text}<br>")
                elif form < 0.3:
                    parts.append(f"<p><i>{text}</i> {m}{self.sentences(1, 1)} <a href='/x'>{m}{' '.join(self.words(1, 3))}</a>.</p>")
                elif form < 0.36:
                    parts.append(self.tag("div", text))
                elif form < 0.42:
                    parts.append(text + "<br><br>")
                else:
                    parts.append(self.tag("p", text, close=0.85))
            elif kind < 0.78:
                parts.append(self.tag(r.choice(["h2", "h3"]), m + " ".join(self.words(1, 8))))
            elif kind < 0.86:
                parts.append(self.tag(r.choice(["ul", "ol"]), "".join(self.tag("li", m + self.sentences(1, 1), close=0.8) for _ in range(r.randint(2, 6)))))
            elif kind < 0.9:
                parts.append(self.tag("blockquote", self.tag("p", m + self.sentences(1, 3))))
            elif kind < 0.93:
                parts.append(self.tag("pre", m + " ".join(self.words(4, 30))))
            elif kind < 0.96:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{' '.join(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                parts.append(self.noise())
        body = "".join(parts)
        form = r.random()
        if form < 0.5:
            return self.tag("article", body, r.choice(["", "", "post", "entry"]), close=0.95)
        if form < 0.65:
            return self.tag("main", body)
        return self.tag(r.choice(["div", "section", "td"]), body, r.choice(["content", "post-body", "article-body", "story", "main-content", "entry-content", "text", ""]))

    def page(self) -> str:
        r = self.r
        self.style = r.choice(["plain"] * 6 + ["symbols", "shout", "bars"])
        head = f"<!DOCTYPE html><html><head><title>{' '.join(self.words(2, 5))}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        before = "".join(self.noise() for _ in range(r.randint(0, 4)))
        after = "".join(self.noise() for _ in range(r.randint(0, 4)))
        article = self.article()
        body = before + article + after
        if r.random() < 0.4:
            body = self.tag("div", body, r.choice(["page", "wrapper", "container", "site"]))
        page = head + body + ("</body></html>" if r.random() < 0.85 else "")
        return page


@lru_cache(maxsize=1)
def trained() -> BoostedTrees:
    maker, xs, ys = PageMaker(), [], []
    for _ in range(TRAINING_PAGES):
        page = parse(maker.page())
        inside = np.zeros(len(page.nodes))
        for block in page.blocks:
            for at, (node, piece) in enumerate(block):
                if _MAIN in piece:
                    inside[node] = 1
                    block[at] = (node, piece.replace(_MAIN, ""))
        for k in range(len(page.nodes) - 1, 0, -1):
            inside[page.nodes[k].parent] = max(inside[page.nodes[k].parent], inside[k])
        # elements without any text decide nothing
        x = node_features(page)
        keep = x[:, 0] > 0
        xs.append(x[keep])
        ys.append(inside[keep])
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract_pages(pages: list[str | None], model: BoostedTrees) -> list[str]:
    parsed = [parse(p) if p else None for p in pages]
    features = [node_features(p) for p in parsed if p]
    if not features:
        return ["" for _ in pages]
    margins = np.split(model.margin(np.concatenate(features)), np.cumsum([len(f) for f in features])[:-1])
    rest = iter(margins)
    return ["" if p is None else main_text(p, decode(p, next(rest))) for p in parsed]


def _extract(model: BoostedTrees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            low = 0
            while low < whole.num_rows:
                pages, size = [], 0
                while low + len(pages) < whole.num_rows and len(pages) < 128 and size < BATCH_CHARS:
                    pages.append(whole.column(2)[low + len(pages)].as_py())
                    size += len(pages[-1] or "")
                batch = whole.slice(low, len(pages))
                low += len(pages)
                texts = extract_pages(pages, model)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of ``pages(page_id, url, html)``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(trained()), "page_id long, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
