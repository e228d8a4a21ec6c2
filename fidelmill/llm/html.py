"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

A page becomes a tree of block-level elements whose leaves are text blocks. Each
node gets features of itself (tag kind, attribute tokens, depth), its subtree
(text, link and tag density, punctuation, block lengths), its siblings (share of
the parent's text, place, repetition) and its ancestors. Boosted trees give the
odds that a node holds article text. Decoding takes the likeliest labelling in
which no node is kept below one that is dropped, by one pass up and one down the
tree; a kept leaf's block is part of the article.

The trees are fitted on ``TRAINING_PAGES`` generated pages of many layouts whose
article parts are known, so nothing is learned from the pages to be extracted.

Defined results. Null or empty html: the empty text. Text outside any element:
a block of the body. Unclosed, stray and misnested tags: closed by the nearest
enclosing block; an unclosed drawing, player or choice is skipped as a tag alone,
and of an unclosed script, style, title or field only what stands before the next
(block's) tag, so that nothing after it is lost. White space inside a block, line breaks too: one space. Repeated
rows: each by itself. Empty table: no rows. Extra columns are ignored. The whole
html is read, whatever its length.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fidelmill.llm.common import arrow_map, column, tune
from fidelmill.llm.trees import Boosted

TRAINING_PAGES = 400

# Kinds of tags, and tokens of class, id and role.
KINDS = {
    "nav": "nav menu header footer aside dialog".split(),
    "form": "form fieldset button select option label input textarea datalist".split(),
    "article": "article main".split(),
    "paragraph": "p blockquote pre dd dt figcaption".split(),
    "heading": "h1 h2 h3 h4 h5 h6 hgroup".split(),
    "list": "ul ol dl li".split(),
    "table": "table thead tbody tfoot tr td th caption".split(),
    "box": "div section body html center figure details summary address hr".split(),
}
BLOCK_TAGS = {t: i for i, ts in enumerate(KINDS.values()) for t in ts}
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = set("script style noscript template title textarea iframe svg canvas audio video head select".split())
#: Of these, what stands in an unclosed one up to the next tag is no text of the page either.
PLAIN_TAGS = set("script style title textarea iframe".split())
BAD_TOKENS = set(
    "nav navbar navigation menu menubar topbar toolbar header masthead banner footer foot copyright legal sidebar side aside rail widget related recommended more ad ads advert adverts advertisement"
    " sponsor sponsored promo promotion cookie cookies consent notice alert popup modal overlay comment comments reply replies disqus respond discussion share sharing social breadcrumb breadcrumbs"
    " pagination pager tags login signup subscribe newsletter search form hidden meta byline skip outbrain taboola".split()
)
GOOD_TOKENS = set("article content post entry story main text body maincontent postbody articlebody prose page".split())
BAD_ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>""", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
OPENING = re.compile(rf"<(?:/head|{'|'.join(sorted(BLOCK_TAGS))})\b[^>]*>", re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SENTENCE = re.compile(r"[.!?。،;:,](?=\s|$)")


class Node:
    __slots__ = ("tag", "parent", "children", "depth", "bad", "good", "marked", "text", "link", "n_text", "n_link", "n_tags", "n_stops", "n_blocks", "n_long", "longest", "before")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.bad = self.good = self.link = 0
        self.marked, self.text = False, ""
        if parent:
            parent.children.append(self)


def describe(node: Node, attributes: str) -> None:
    """Counts of telling tokens in class, id, role and itemprop; hidden elements count as bad."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name in ("class", "id", "itemprop"):
            tokens = [t.lower() for t in TOKEN.findall(value)]
            node.bad += sum(t in BAD_TOKENS for t in tokens)
            node.good += sum(t in GOOD_TOKENS for t in tokens)
        elif name == "role":
            node.bad += value.lower() in BAD_ROLES
            node.good += value.lower() in ("main", "article")
        elif name == "style" and re.search(r"display\s*:\s*none", value) or name == "aria-hidden" and value == "true":
            node.bad += 2
        elif name == "data-article":
            node.marked = value == "yes"
    if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
        node.bad += 2


def parse(html: str) -> Node:
    """The tree of block-level elements; each leaf ``#text`` is one text block."""
    root = here = Node("html", None)
    held: list[str] = []
    links = link_chars = 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal held, link_chars
        text = " ".join(unescape("".join(held)).split()) if held else ""
        if text:
            leaf = Node("#text", here)
            leaf.text, leaf.link = text, min(link_chars, len(text))
        held, link_chars = [], 0

    def keep(raw: str) -> None:
        nonlocal link_chars
        held.append(raw)
        if links:
            link_chars += len(" ".join(raw.split()))

    while at < end:
        m = TAG.search(html, at)
        if not m:
            m = LOOSE.search(html, at)  # a tag with an unclosed quote
            if not m:
                keep(html[at:])
                break
        if m.start() > at:
            loose = LOOSE.search(html, at, m.start())
            if loose:
                m = loose
            if m.start() > at:
                keep(html[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS:
                up = here
                while up is not root and up.tag != tag:
                    up = up.parent
                if up is not root:
                    flush()
                    here = up.parent
                elif tag == "p":
                    flush()
            continue
        if tag in RAW_TAGS:
            if not m.group(3).endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                if close:
                    at = close.end()
                elif tag in PLAIN_TAGS:
                    close = (OPENING if tag in ("script", "style") else LOOSE).search(html, at)
                    at = close.start() if close else end
            held.append(" ")
        elif tag == "a":
            links = 1  # a link inside a link closes the first
        elif tag in ("br", "img", "input", "wbr"):
            held.append(" ")
        elif tag == "body" or tag == "html":
            describe(root, m.group(3))
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            while here is not root and (here.tag == "p" or here.tag in KINDS["heading"] and tag in KINDS["heading"]):
                here = here.parent
            if tag in ("li", "tr", "td", "th", "dd", "dt", "option"):
                stop = {"li": ("ul", "ol"), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "dd": ("dl",), "dt": ("dl",), "option": ("select",)}[tag]
                up = here
                while up is not root and up.tag not in stop and up.tag != tag:
                    up = up.parent
                if up.tag == tag:
                    here = up.parent
            if tag != "hr":
                node = Node(tag, here)
                describe(node, m.group(3))
                if not m.group(3).endswith("/"):
                    here = node
    flush()
    return root


def ordered(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += n.children[::-1]
    return out


def summed(nodes: list[Node]) -> None:
    """Subtree figures of every node."""
    total = 0
    for n in nodes:
        n.before = total
        n.n_tags, n.n_text, n.n_link, n.n_stops, n.n_blocks, n.n_long, n.longest = 1, 0, 0, 0, 0, 0, 0
        if n.tag == "#text":
            size = len(n.text)
            total += size
            n.n_tags, n.n_text, n.n_link, n.n_stops, n.n_blocks, n.n_long, n.longest = 0, size, n.link, len(SENTENCE.findall(n.text)), 1, size >= 80, size
    for n in reversed(nodes):
        p = n.parent
        if p is not None:
            p.n_tags += n.n_tags
            p.n_text += n.n_text
            p.n_link += n.n_link
            p.n_stops += n.n_stops
            p.n_blocks += n.n_blocks
            p.n_long += n.n_long
            p.longest = max(p.longest, n.longest)


N_KINDS = len(KINDS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node."""
    total = max(1, nodes[0].n_text)
    last = max(1, nodes[0].longest)
    above: dict[int, tuple] = {}
    alike: dict[int, int] = {}
    rows = []
    for n in nodes:
        p = n.parent
        up = above[id(p)] if p else (0, 0, 0, 0, 0)
        kind = BLOCK_TAGS.get(n.tag, N_KINDS)
        bad, good = min(n.bad, 3), min(n.good, 3)
        is_nav, is_form, is_article = kind == 0, kind == 1, kind == 2
        above[id(n)] = (up[0] + bad, up[1] + good, up[2] + is_nav, up[3] + is_form, up[4] + is_article)
        siblings = p.children if p else [n]
        if id(n) not in alike:  # the first child counts for all
            tags = Counter(s.tag for s in siblings)
            alike.update((id(s), tags[s.tag]) for s in siblings)
        same = alike[id(n)]
        parent_kind = BLOCK_TAGS.get(p.tag, N_KINDS) if p else N_KINDS + 1
        size = n.n_text
        rows.append(
            (
                kind, bad, good, *up, parent_kind, n.depth, size**0.5, n.n_link / max(1, size), size / (1 + n.n_tags), 100 * n.n_stops / max(1, size), n.n_blocks, n.n_long / max(1, n.n_blocks), n.longest / last,
                size / max(1, p.n_text if p else size), len(siblings), same, n.before / total, (n.before + size) / total, size / total, n.tag == "#text", n.tag == "h1", n.n_stops > 0,
            )
        )
    return np.array(rows, np.float32)


def decoded(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Kept nodes of the likeliest labelling in which a dropped node keeps nothing below it."""
    place = {id(n): i for i, n in enumerate(nodes)}
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    parent = [place[id(n.parent)] if n.parent else -1 for n in nodes]
    best = np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, -1, -1):  # keep and drop become sums over the subtree
        best[i] = keep[i] > drop[i]
        if parent[i] >= 0:
            keep[parent[i]] += max(keep[i], drop[i])
            drop[parent[i]] += drop[i]
    out = np.zeros(len(nodes), bool)
    for i in range(len(nodes)):
        out[i] = best[i] and (parent[i] < 0 or out[parent[i]])
    return out


# ---- generated training pages -------------------------------------------------------------------------------------

_SYLLABLES = "an en in on er re ti te ha th la le ou de es st ra ne lo vi ka mo se ta po li".split()


def _words(r: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(r.randint(low, high)):
        w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
        out.append(w + (r.choice(".,") if r.random() < 0.12 else ""))
    return " ".join(out)


def _sentence(r: random.Random, low: int = 6, high: int = 20) -> str:
    return _words(r, low, high).capitalize().rstrip(".,") + "."


def _links(r: random.Random, n: int) -> str:
    items = [f'<a href="/{i}">{_words(r, 1, 3)}</a>' for i in range(n)]
    if r.random() < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return r.choice([" | ", " ", "<br>"]).join(items)


def _wrap(r: random.Random, inner: str, tags: str, names: str, bare: float = 0.1) -> str:
    tag = r.choice(tags.split())
    if r.random() < bare:
        return f"<{tag}>{inner}</{tag}>"
    attribute = r.choice(["class", "class", "class", "id"])
    return f'<{tag} {attribute}="{r.choice(names.split()).replace("_", " ")}">{inner}</{tag}>'


def _boilerplate(r: random.Random, kind: str) -> str:
    s = lambda a=1, b=2: " ".join(_sentence(r) for _ in range(r.randint(a, b)))
    if kind == "menu":
        return _wrap(r, _links(r, r.randint(3, 10)), "nav nav div ul", "nav menu navbar main-nav topbar navigation site-menu")
    if kind == "header":
        return _wrap(r, r.choice(["", f"<h1>{_words(r, 1, 3)}</h1>", f"<div>{_words(r, 2, 4)}</div>"]) + r.choice(["", f"<p>{s(1, 1)}</p>", _links(r, 4)]), "header header div", "header site-header masthead top")
    if kind == "footer":
        inner = r.choice([f"&copy; {_words(r, 1, 3)} &middot; {s()}", f"<p>{s()}</p>{_links(r, 3)}", _links(r, 5), f"<div>{_words(r, 3, 8)}</div>", s()])
        return _wrap(r, inner, "footer footer div", "footer site-footer copyright bottom-footer legal")
    if kind == "sidebar":
        return _wrap(r, f"<h3>{_words(r, 1, 3)}</h3>" + r.choice([_links(r, r.randint(3, 8)), f"<p>{s()}</p>", f"<p>{s(1, 3)}</p>{_links(r, 3)}"]), "aside aside div section", "sidebar side related widget related-posts more recommended")
    if kind == "notice":
        return _wrap(r, f"<p>{s(1, 3)}</p>" + r.choice(["", f"<button>{_words(r, 1, 2)}</button>"]), "div div section dialog", "cookie cookie-notice consent alert notice popup banner_message", 0.02)
    if kind == "advert":
        return _wrap(r, r.choice([s(), f"<p>{s()}</p>", f"<a href='/x'>{s()}</a>", f"<h4>{_words(r, 2, 5)}</h4><p>{s()}</p>"]), "div div section aside", "ad ads advert ad-box sponsored promo advertisement ad_slot", 0.02)
    if kind == "form":
        return _wrap(r, f"<label>{_words(r, 1, 3)}</label><input name=q><button>{_words(r, 1, 2)}</button>" + r.choice(["", f"<p>{s(1, 1)}</p>"]), "form form div", "search newsletter login signup subscribe contact-form", 0.4)
    one = lambda: _wrap(r, f"<b>{_words(r, 1, 2)}</b> " + r.choice([s(1, 3), f"<p>{s(1, 3)}</p>"]), "div li article", "comment reply comment-body", 0.3)
    return _wrap(r, f"<h3>{_words(r, 1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))), "section div ol", "comments comment-list discussion disqus responses_comments replies", 0.02)


def _article(r: random.Random) -> str:
    mark = ' data-article="yes"'
    parts = [f"<h1{mark}>{_words(r, 4, 12)}</h1>"] if r.random() < 0.85 else []
    if parts and r.random() < 0.15:
        parts = [f"<header{mark}>{parts[0]}</header>"]
    for i in range(r.choice([1, 1, 2, 3, 4, 5, 6, 8, 12])):
        text = " ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 4, 6, 9])))
        if r.random() < 0.2:
            text = text.replace(" ", f' <a href="/z">{_words(r, 1, 2)}</a> ', 1)
        kind = r.random()
        if kind < 0.78:
            lead = r.choice(["", "", "<b>", "<i>"])
            parts.append(f"<p{mark}>{lead}{text}" + r.choice(["</p>", "</p>", "</p>", "<br>", ""]))
        elif kind < 0.84:
            parts.append(f"<h2{mark}>{_words(r, 2, 6)}</h2>")
        elif kind < 0.9:
            parts.append(f"<ul{mark}>" + "".join(f"<li>{_sentence(r, 2, 9)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.95:
            parts.append(f"<blockquote{mark}>{text}</blockquote>")
        elif kind < 0.97:
            parts.append(f"<table{mark}><tr>" + "".join(f"<td>{_words(r, 1, 4)}</td>" for _ in range(r.randint(2, 6))) + "</tr></table>")
        else:
            parts.append(f"<div{mark}>{text}</div>")
        if r.random() < 0.06:
            parts.append(_boilerplate(r, "advert"))
    inner = "".join(parts)
    style = r.random()
    if style < 0.5:
        return f"<article>{inner}</article>"
    if style < 0.85:
        return _wrap(r, inner, "div div section main", "content post entry article post-content story article-body main", 0.15)
    return f'<div class="c{r.randint(10, 99)}">{inner}</div>'


def training_page(r: random.Random) -> str:
    """A page whose article elements carry data-article="yes"."""
    kinds = ["menu", "header", "advert", "notice", "form", "sidebar"]
    before = [_boilerplate(r, k) for k in kinds if r.random() < (0.8 if k == "menu" else 0.35)]
    after = [_boilerplate(r, k) for k in ("advert", "sidebar", "comments", "form", "notice", "menu") if r.random() < 0.35]
    after += [_boilerplate(r, "footer")] if r.random() < 0.85 else []
    middle = _article(r)
    if r.random() < 0.3:
        cut = r.randint(0, len(before))
        middle = _wrap(r, "".join(before[cut:]) + middle + "".join(after[:1]), "div main", "container wrapper page layout row", 0.3)
        before, after = before[:cut], after[1:]
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 6)}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def trained(pages: int = TRAINING_PAGES, seed: int = 1) -> Boosted:
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = ordered(parse(training_page(r)))
        summed(nodes)
        marked: set[int] = set()
        for n in nodes:  # below a marked element, all but what has no mark of its own is article
            if n.marked or n.parent is not None and id(n.parent) in marked and not n.bad:
                marked.add(id(n))
        holds = set(marked)
        for n in reversed(nodes):
            if id(n) in holds and n.parent is not None:
                holds.add(id(n.parent))
        xs.append(features(nodes))
        ys.append([id(n) in holds for n in nodes])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract_many(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page."""
    trees = []
    for html in pages:
        nodes = ordered(parse(html or ""))
        summed(nodes)
        trees.append(nodes)
    out = []
    for at in range(0, len(trees), 64):
        some = trees[at : at + 64]
        odds = model.predict(np.concatenate([features(n) for n in some]))
        for nodes, o in zip(some, np.split(odds, np.cumsum([len(n) for n in some])[:-1])):
            kept = decoded(nodes, o.copy())
            out.append("\n".join(n.text for n, k in zip(nodes, kept) if k and n.tag == "#text"))
    return out


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    spark = pages.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model or trained())  # a fixed number of small trees

    def make():
        def handle(batch):
            got = extract_many(column(batch, "html").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return handle

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return arrow_map(pages.select("page_id", "url", "html"), make, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
