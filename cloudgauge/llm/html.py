"""Main text of web pages by boosted trees over the nodes of the document tree.

Each block-level node is described by its tag, attribute words, depth, siblings, and the density of text, links and
tags in its subtree. Trees learn from sample pages which nodes hold main text: blocks under the page's own
``article`` or ``main`` element, except in menus, side matter, forms and comments. The sample is used as it is and
once more with its blocks dealt into layouts without such elements, so that attribute words and shape are learned too.
Decoding is hierarchical: a node's gain is its log odds plus the gains of the children worth keeping, and a block is
kept only below kept ancestors, so no kept block stands in a dropped one.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudgauge.llm.boost import Boosted, fit
from cloudgauge.llm.common import appended, slices, with_field

#: Pages that the trees are fitted on: those with the smallest hashes. Every page is extracted.
FIT_SAMPLE = 200
#: Characters below which a page may teach; longer ones are extracted like all others.
FIT_LONGEST = 1_000_000
#: Start tags, end tags, comments and declarations. An unclosed comment or tag runs to the end of the page.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:\b(?:class|id|role|itemprop|aria-label)\s*=\s*)(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
TOKEN = re.compile(r"[a-z]+")
#: Elements whose content is not text.
RAW = ("script", "style", "template", "svg", "iframe", "textarea", "select", "head")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "label", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Open elements that a start tag closes, searched up to the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words in attributes, and elements, that mark side matter, and those that mark main text.
SIDE_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "form", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice",
    "pagination", "popup", "promo", "promoted", "recommended", "related", "reply", "respond", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "warning", "widget", "alert", "login", "search",
    "aside", "contentinfo", "complementary", "legal", "copyright", "discussion", "responses", "modal", "teaser"}
MAIN_WORDS = {"article", "articlebody", "body", "content", "entry", "main", "maincontent", "page", "post", "story", "text"}
SIDE_TAGS = {"nav", "footer", "aside", "header", "form", "menu", "button", "dialog", "fieldset", "label", "legend"}
MAIN_TAGS = {"article", "main"}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    side: int = 0  # attribute words of side matter
    main: int = 0
    index: int = 0
    text: int = 0  # characters in the subtree
    links: int = 0  # of them in links
    tags: int = 0
    blocks: int = 0
    stops: int = 0  # sentence ends
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]  # owning node, text


def parse(source: str) -> Page:
    """Block-level tree of a page and its text blocks in page order; unclosed and stray tags are put up with."""
    nodes = [Node("html", -1, 0)]
    blocks: list[tuple[int, str]] = []
    # Open elements with their nodes; an inline element that has ended amid others stays as an empty name.
    stack: list[tuple[str, int]] = [("html", 0)]
    places: dict[str, list[int]] = {"html": [0]}  # where each name stands on the stack, so that no tag walks through it
    tops = [0]  # where the open block elements stand
    held: list[str] = []
    in_link, linked, spans = 0, 0, 0

    def close_block() -> None:
        nonlocal linked, spans
        text = " ".join("".join(held).split())
        held.clear()
        owner = stack[-1][1]
        if text:
            blocks.append((owner, text))
            node = nodes[owner]
            node.text += len(text)
            node.links += min(linked, len(text))
            node.blocks += 1
            node.stops += sum(text.count(c) for c in ".!?。")
        nodes[owner].tags += spans
        linked = spans = 0

    def pop_to(position: int) -> None:
        nonlocal in_link
        close_block()
        for name, _ in stack[position:]:
            if name:
                places[name].pop()
                in_link -= name == "a"
        while tops[-1] >= position:
            tops.pop()
        del stack[position:]

    def push(name: str, node: int) -> None:
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            tops.append(len(stack))
        stack.append((name, node))

    def nearest(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    at = 0
    while True:
        match = TAG.search(source, at)
        raw = source[at : match.start()] if match else source[at:]
        if raw:
            text = html.unescape(raw)
            held.append(text)
            if in_link:
                linked += len(text.strip())
        if not match:
            break
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        closing = bool(match[1])
        if not closing and name in RAW and not match[3].rstrip().endswith("/"):
            end = RAW_END[name].search(source, at)
            at = end.end() if end else len(source)
            if name != "head":
                held.append(" ")
            continue
        if name == "br":
            held.append(" ")
            spans += 1
        elif name in VOID:
            if name == "hr":
                close_block()
            spans += 1
        elif closing:
            position = nearest({name})
            if position and name in BLOCK:
                pop_to(position)
            elif position > tops[-1]:  # an inline end tag does not reach beyond its block
                places[name].pop()
                in_link -= name == "a"
                stack[position] = ("", stack[position][1])
                while stack[-1][0] == "":
                    stack.pop()
        elif name in BLOCK:
            closes, within = CLOSES.get(name, ({"p"}, {"td", "th", "button", "table"}))
            if name in HEADINGS:
                closes = closes | HEADINGS
            position = nearest(closes)
            if position > nearest(within):
                pop_to(position)
            close_block()
            if name in ("html", "body") and nearest({name}):
                continue
            parent = stack[-1][1]
            node = Node(name, parent, nodes[parent].depth + 1, index=len(nodes[parent].children))
            for groups in ATTRIBUTE.findall(match[3]):
                for token in TOKEN.findall("".join(groups).lower()):
                    node.side += token in SIDE_WORDS
                    node.main += token in MAIN_WORDS
            nodes[parent].children.append(len(nodes))
            nodes.append(node)
            if not match[3].rstrip().endswith("/"):
                push(name, len(nodes) - 1)
        else:
            spans += 1
            if name == "a":
                in_link += 1
            push(name, stack[-1][1])
    close_block()
    for i in range(len(nodes) - 1, 0, -1):
        node, parent = nodes[i], nodes[nodes[i].parent]
        parent.text += node.text
        parent.links += node.links
        parent.tags += node.tags + 1
        parent.blocks += node.blocks
        parent.stops += node.stops
    return Page(nodes, blocks)


TAG_GROUPS = [{"p", "blockquote", "pre"}, HEADINGS, {"ul", "ol", "li", "dl", "dt", "dd"}, {"table", "tr", "td", "th", "tbody"},
              {"div", "section", "body", "html"}, SIDE_TAGS, MAIN_TAGS]


def features(page: Page) -> np.ndarray:
    """A row per node."""
    nodes = page.nodes
    total = max(1, nodes[0].text)
    rows = np.zeros((len(nodes), 29))
    above = [(0, 0, 0, 0, 99, 99)] * len(nodes)  # of the ancestors: side and main words and tags, distance to the nearest
    for i, node in enumerate(nodes):
        parent = nodes[node.parent] if node.parent >= 0 else node
        if node.parent >= 0:
            s, m, st, mt, ds, dm = above[node.parent]
            is_side, is_main = parent.side > 0 or parent.tag in SIDE_TAGS, parent.main > 0 or parent.tag in MAIN_TAGS
            above[i] = (s + parent.side, m + parent.main, st + (parent.tag in SIDE_TAGS), mt + (parent.tag in MAIN_TAGS),
                        1 if is_side else ds + 1, 1 if is_main else dm + 1)
        siblings = parent.children
        before = nodes[siblings[node.index - 1]].text if node.parent >= 0 and node.index > 0 else 0
        after = nodes[siblings[node.index + 1]].text if node.parent >= 0 and node.index + 1 < len(siblings) else 0
        rows[i, :22] = (
            node.depth, node.side, node.main, *above[i], np.log1p(node.text), node.text / total,
            node.text / (parent.text or 1), node.links / (node.text or 1), node.text / (node.tags + 1), node.blocks,
            node.stops / (node.text or 1) * 100, len(node.children), len(siblings), node.index / (len(siblings) or 1),
            np.log1p(before), np.log1p(after), node.links / (nodes[0].links or 1))
        rows[i, 22:] = [node.tag in group for group in TAG_GROUPS]
    return rows


def decode(page: Page, odds: np.ndarray) -> str:
    """Blocks of the kept nodes, two line feeds between them."""
    nodes = page.nodes
    gain = odds.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    keep = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        keep[i] = gain[i] > 0 and (node.parent < 0 or keep[node.parent])
    # A kept container shows its own text only if it is itself likely main text; kept leaves always do.
    return "\n\n".join(text for owner, text in page.blocks if keep[owner] and (odds[owner] > 0 or not nodes[owner].children))


def telling(page: Page) -> bool:
    """Whether the page marks its main text by an element."""
    return any(node.tag in MAIN_TAGS and not node.side for node in page.nodes)


def assumed(page: Page) -> Page:
    """The page with paragraphs and headings as main elements: what teaches where no page of a table marks its text."""
    for node in page.nodes:
        if node.tag in HEADINGS | {"p", "blockquote", "pre"} and node.links * 2 <= node.text:
            node.tag = "main"
    return page


def targets(page: Page) -> np.ndarray:
    """Whether each node holds main text, by the page's own elements and attribute words."""
    nodes = page.nodes
    state = [0] * len(nodes)  # 1: inside main matter
    held = np.zeros(len(nodes))
    for i, node in enumerate(nodes):
        inside = state[node.parent] if node.parent >= 0 else 0
        if node.tag in MAIN_TAGS:
            inside = 1
        if node.tag in SIDE_TAGS or node.side:
            inside = 0 if not (node.tag == "header" and inside and not node.side) else inside
            if node.tag != "header" or node.side:
                state[i] = -1
                continue
        state[i] = inside if node.parent < 0 or state[node.parent] >= 0 else -1
    for owner, _ in page.blocks:
        if state[owner] == 1:
            i = owner
            while i >= 0 and not held[i]:
                held[i] = 1
                i = nodes[i].parent
    return held


def relaid(page: Page, number: int) -> list[str]:
    """The page's blocks in layouts without telling elements, for training."""
    held = targets(page)
    main = [(page.nodes[o].tag, html.escape(t)) for o, t in page.blocks if held[o]]
    side = [html.escape(t) for o, t in page.blocks if not held[o]] or ["menu"]
    if not main:
        return []
    pick = zlib.crc32(str(number).encode())

    def choose(words: list[str], salt: int) -> str:
        return words[(pick >> salt) % len(words)]

    body = "".join(f"<h1>{t}</h1>" if tag in HEADINGS else f"<p>{t}</p>" for tag, t in main)
    short = "".join(f"<p>{t[:400]}</p>" for _, t in main[-2:])
    menu = "".join(f'<li><a href="/">{t[:30]}</a></li>' for t in side[:8])
    note = " ".join(side)[:300]
    content = choose(["content", "post-body", "entry-content", "story", "main-content", "article-body"], 3)
    before = choose([
        f'<div class="header"><p>{note[:60]}</p></div><div id="menu"><ul>{menu}</ul></div>',
        f'<header><p>{note[:80]}</p></header><nav><ul>{menu}</ul></nav><div class="notice"><p>{note}</p></div>',
        f'<div class="top-banner"><p>{note}</p></div><div class="navbar">{menu}</div><div class="cookie-consent"><p>{note}</p></div>'], 5)
    inner = choose(["", f'<div class="share">{menu}</div>', f'<div class="ad"><p>{note}</p></div>',
                    f'<aside class="related"><ul>{menu}</ul><p>{note}</p></aside>'], 9)
    after = choose([
        f'<div class="comments"><div class="comment"><p>{short}</p></div><div class="comment"><p>{note}</p></div></div>',
        f'<section id="comments"><article class="comment">{short}</article><form><p>{note}</p></form></section>',
        f'<div class="sidebar"><p>{note}</p>{short}</div><form class="signup"><p>{note}</p><label>{note[:20]}</label></form>'], 13)
    end = choose([f"<footer><p>{note}</p></footer>", f'<div id="footer"><p>{note[:90]}</p></div>'], 17)
    wrap = choose(["div", "section", "main", "article"], 21)
    half = len(body) // 2
    cut = body.find("</p>", half) + 4 if "</p>" in body[half:] else len(body)
    mixed = body[:cut] + inner + body[cut:]
    return [
        f"<html><body><div><ul>{menu}</ul></div><div>{body}</div><div>{note[:90]}<ul>{menu}</ul></div></body></html>",
        f'<html><body>{before}<{wrap} class="{content}">{mixed}</{wrap}>{after}{end}</body></html>',
        f"<html><body>{before}<article>{mixed}{after}</article>{end}</body></html>",
        f"<html><body>{before}<main>{body}</main>{inner}{after}{end}</body></html>"]


def relaid_targets(page: Page) -> np.ndarray:
    """As ``targets`` for a re-laid page, whose main text also stands under main attribute words."""
    for node in page.nodes:
        if node.main and node.tag in ("div", "section"):
            node.tag = "main"
    return targets(page)


def train(pages: DataFrame, column: str = "html", sample: int = FIT_SAMPLE, longest: int = FIT_LONGEST) -> Boosted:
    """Trees fitted on the ``sample`` pages of smallest text hash, at most, of those that mark their main text by an
    element and have less than ``longest`` characters. Other pages teach nothing, unless no page of the table marks its text:
    then a sample of all pages teaches, with paragraphs and headings outside side matter as main text.

    Only hashes are sorted; of the pages no more than the sample leaves the executors.
    """
    every = pages.select(F.col(column).cast("string").alias("_html"), F.xxhash64(F.col(column).cast("string")).alias("_hash"))
    every = every.filter(F.length("_html") < longest)
    known = every.filter(F.col("_html").rlike(r"(?i)<(article|main)[\s>]"))
    if not known.limit(1).count():
        known = every
    last = known.select("_hash").distinct().orderBy("_hash").limit(sample).agg(F.max("_hash")).first()[0]
    chosen = known.filter(F.col("_hash") <= F.lit(last).cast("long")).dropDuplicates(["_hash"]).orderBy("_hash").select("_html").collect()
    xs, ys = [np.zeros((0, 29))], [np.zeros(0)]
    for number, row in enumerate(chosen):
        page = parse(row[0])
        x = features(page)
        if not telling(page):
            page = assumed(page)
        xs.append(x)
        ys.append(targets(page))
        for text in relaid(page, number):
            again = parse(text)
            xs.append(features(again))
            ys.append(relaid_targets(again if telling(again) or any(n.main for n in again.nodes) else assumed(again)))
    return fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, model: Boosted, column: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text of ``column`` in ``out``: blocks in page order, two line feeds between them.

    Character references are decoded, white space inside a block is one space. Null and empty pages, and pages without
    main text, give an empty text. A column named ``out`` is replaced; all other columns and rows stay.
    """
    schema = with_field(pages.schema, (out, T.StringType()))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            parsed = [parse(x or "") for x in batch.column(column).to_pylist()]
            odds = shared.value.margin(np.concatenate([features(p) for p in parsed]))
            ends = np.cumsum([0] + [len(p.nodes) for p in parsed])
            texts = [decode(p, odds[a:b]) for p, a, b in zip(parsed, ends[:-1], ends[1:])]
            yield appended(batch, schema, **{out: pa.array(texts, pa.string())})

    return pages.mapInArrow(run, schema)
