"""Main text of web pages: boosted trees judge DOM nodes, a tree pass makes the judgements agree.

A node is *main* when it holds main text anywhere below it. The trees see tag and attribute tokens, text and
link density of the subtree, depth and sibling statistics. Decoding picks the likeliest labelling in which
nothing below a dropped node is kept.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from rowtide.llm.boosting import BoostedTrees
from rowtide.llm.common import arrow_map, column, hash_sample, texts_of

# --- document tree -------------------------------------------------------------------------------------

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
TOKEN = re.compile(r"[a-z]+")

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
QUIET = frozenset("svg select template".split())  # parsed, but nothing below them is text of the page
SILENT = RAW | QUIET | {"head"}
# HTML elements that end an open svg, and svg elements inside which they do not.
LEAVES_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)
HTML_IN_SVG = ("~foreignobject", "~desc", "~title")
SELECT_TAG = re.compile(r"<(/?)select(?=[\s/>]|\Z)", re.IGNORECASE)
BLOCK = frozenset(
    "html body head article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre "
    "blockquote figure figcaption nav header footer aside form fieldset address details summary hr menu center dialog "
    "button label legend search hgroup".split()
)
CLOSES_P = BLOCK - {"html", "body", "head", "button", "label", "legend", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Node:
    """A block element: its parent's number, tag, attribute tokens, depth, and what lies right inside it."""

    __slots__ = ("parent", "tag", "tokens", "depth", "chars", "linked", "links", "children", "index")

    def __init__(self, parent: int, tag: str, tokens: list[str], depth: int, index: int):
        self.parent, self.tag, self.tokens, self.depth, self.index = parent, tag, tokens, depth, index
        self.chars = self.linked = self.links = self.children = 0


def read_page(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order and the blocks of text: (number of the innermost element, text).

    Character references are decoded, white space inside a block is one space. Unclosed and stray tags are
    taken as browsers take them: a new block closes an open paragraph, an end tag closes up to its start.
    What lies in ``svg``, ``select`` and ``template`` is left out. They end at their end tag or with the block
    around them; a self-closed svg is empty, an HTML block inside an svg ends it, and a select without an end
    tag of its own ends at the next block.
    """
    nodes = [Node(-1, "#page", [], 0, 0)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements; inline ones have the number of their block
    open_count: Counter = Counter()
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    in_link = 0
    quiet = 0  # open elements in or at the root of a silent subtree; their names start with ~
    loose_select = False

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                node = stack[-1][1]
                blocks.append((node, text))
                nodes[node].chars += len(text)
            parts.clear()

    def pop():
        nonlocal in_link, quiet
        tag, _ = stack[-1]
        if tag[0] == "~":
            quiet -= 1
        elif tag in BLOCK:
            flush()
        elif tag == "a":
            in_link -= 1
        stack.pop()
        open_count[tag] -= 1

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() < at:
            continue  # inside raw text
        if m.start() > at and not quiet:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link > 0:
                nodes[stack[-1][1]].linked += len(piece)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if quiet and not m.group(1):
            leaving = ""
            if open_count["~svg"] > 0:
                if tag in LEAVES_SVG and not any(open_count[t] > 0 for t in HTML_IN_SVG):
                    leaving = "~svg"
            elif open_count["~select"] > 0 and (tag == "select" or loose_select and (tag in BLOCK and tag != "hr" or tag in ("input", "textarea"))):
                leaving = "~select"
            while leaving and open_count[leaving] > 0:
                pop()
        if quiet and m.group(1):
            if open_count["~" + tag] > 0:
                tag = "~" + tag
            elif tag not in BLOCK:
                continue  # an inline element around the silent subtree does not end inside it
        foreign = tag == "svg" or open_count["~svg"] > 0
        if not m.group(1) and (tag in QUIET or quiet and (foreign or tag not in RAW)):
            if tag not in VOID and not (foreign and m.group(3).endswith("/")):
                if tag == "select":
                    following = SELECT_TAG.search(page, at)
                    loose_select = not (following and following.group(1))
                stack.append(("~" + tag, stack[-1][1]))
                open_count["~" + tag] += 1
                quiet += 1
            continue
        if m.group(1):
            if tag in BLOCK:
                flush()
            if open_count[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and open_count["p"] > 0:
                while stack[-1][0] != "p":
                    pop()
                pop()
            closing = SAME.get(tag)
            if closing and any(open_count[t] > 0 for t in closing):
                depth = len(stack) - 1
                while depth > 0 and stack[depth][0] not in closing and stack[depth][0] not in STOPS[tag]:
                    depth -= 1
                if stack[depth][0] in closing:
                    while len(stack) > depth:
                        pop()
            if tag == "hr":
                continue
            tokens = []
            if m.group(3):
                for value in ATTRIBUTE.findall(m.group(3)):
                    tokens += TOKEN.findall("".join(value).lower())
            parent = stack[-1][1]
            nodes.append(Node(parent, tag, tokens, nodes[parent].depth + 1, nodes[parent].children))
            nodes[parent].children += 1
            stack.append((tag, len(nodes) - 1))
            open_count[tag] += 1
        elif tag in VOID:
            if tag == "br":
                parts.append(" ")
        else:
            if tag == "a":
                in_link += 1
                nodes[stack[-1][1]].links += 1
            stack.append((tag, stack[-1][1]))
            open_count[tag] += 1
    if at < len(page) and not quiet:
        parts.append(page[at:])
    flush()
    return nodes, blocks


# --- features ----------------------------------------------------------------------------------------

NUMBERS = 17


def features(nodes: list[Node], vocabulary: dict[str, int]) -> np.ndarray:
    """One row per node: subtree, depth and sibling numbers, then tag and attribute tokens as 0/1."""
    n = len(nodes)
    chars = np.array([v.chars for v in nodes], dtype=np.float64)
    linked = np.array([v.linked for v in nodes], dtype=np.float64)
    links = np.array([v.links for v in nodes], dtype=np.float64)
    size = np.ones(n)
    filled = (chars > 0).astype(np.float64)
    longest = chars.copy()
    own = chars.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        links[p] += links[i]
        size[p] += size[i]
        filled[p] += filled[i]
        longest[p] = max(longest[p], longest[i])
    kin = Counter((v.parent, v.tag) for v in nodes)
    total = max(chars[0], 1.0)
    out = np.zeros((n, NUMBERS + 2 * len(vocabulary)), dtype=np.float32)
    before = 0.0
    for i, v in enumerate(nodes):
        p = max(v.parent, 0)
        out[i, :NUMBERS] = (
            math.log1p(chars[i]), math.log1p(own[i]), chars[i] / size[i], chars[i] / max(filled[i], 1.0), math.log1p(longest[i]),
            linked[i] / (chars[i] + 1.0), links[i] / size[i], chars[i] / total, math.log1p(size[i]), v.depth,
            v.children, v.index, nodes[p].children, kin[v.parent, v.tag], v.index / max(nodes[p].children, 1),
            chars[i] / max(chars[p], 1.0), before / total,
        )
        before += own[i]
        row = out[i]
        for token in (f"<{v.tag}>", *v.tokens):
            k = vocabulary.get(token)
            if k is not None:
                row[NUMBERS + k] = 1.0
        # Tokens above a node count for it too.
        if v.parent >= 0:
            row[NUMBERS + len(vocabulary) :] = np.maximum(
                out[p, NUMBERS + len(vocabulary) :], out[p, NUMBERS : NUMBERS + len(vocabulary)]
            )
    return out


def decode(nodes: list[Node], logit: np.ndarray) -> np.ndarray:
    """The likeliest labels under which a dropped node has only dropped nodes below it."""
    main = -np.logaddexp(0, -logit)  # log chance of main; of dropped: the same of -logit
    drop = -np.logaddexp(0, logit)
    n = len(nodes)
    keep_best, drop_all = main.copy(), drop.copy()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        keep_best[p] += max(keep_best[i], drop_all[i])
        drop_all[p] += drop_all[i]
    out = np.zeros(n, dtype=bool)
    for i, v in enumerate(nodes):
        out[i] = (v.parent < 0 or out[v.parent]) and keep_best[i] >= drop_all[i]
    return out


class PageModel:
    def __init__(self, vocabulary: dict[str, int], trees: BoostedTrees):
        self.vocabulary, self.trees = vocabulary, trees

    def main_texts(self, pages: list[str]) -> list[str]:
        """Main text of each page; the trees judge all nodes of a batch at once."""
        read = [read_page(p) for p in pages]
        out = []
        for at in range(0, len(read), 64):
            some = read[at : at + 64]
            logit = self.trees.logit(np.concatenate([features(nodes, self.vocabulary) for nodes, _ in some]))
            start = 0
            for nodes, blocks in some:
                kept = decode(nodes, logit[start : start + len(nodes)])
                start += len(nodes)
                out.append("\n\n".join(text for node, text in blocks if kept[node]))
        return out


# --- training ------------------------------------------------------------------------------------------

# Bound of the sample that lends the training pages their words, and of the pages made from each.
SAMPLE_PAGES = 120
SAMPLE_CHARS = 20_000
LAYOUTS = 6


def _words(pick: random.Random, words: list[str], low: int, high: int) -> str:
    return html.escape(" ".join(pick.choice(words) for _ in range(pick.randint(low, high))))


def _page(pick: random.Random, paragraphs: list[str], words: list[str]) -> str:
    """A page around given paragraphs in one of many layouts; ``data-main`` marks the article.

    Layouts name their parts by element, by class or hardly at all, and put notices, adverts, forms, share
    bars, related links and comments around or inside the article.
    """
    some = lambda low, high: _words(pick, words, low, high)

    def wrap(inner: str, element: str, names: list[str]) -> str:
        style = pick.random()
        if style < 0.4 and element:
            return f"<{element}>{inner}</{element}>"
        if style < 0.9 or not element:
            name = pick.choice(names)
            return f'<div {pick.choice(["class", "id"])}="{name}">{inner}</div>'
        return f'<{element} class="{pick.choice(names)}">{inner}</{element}>'

    links = lambda n: "<ul>" + "".join(f'<li><a href="/x">{some(1, 3)}</a></li>' for _ in range(n)) + "</ul>"
    menu = lambda: wrap(links(pick.randint(3, 9)), "nav", ["menu", "nav", "navbar", "navigation", "top-menu", "breadcrumbs"])
    head = lambda: wrap(pick.choice([f"<h2>{some(1, 4)}</h2>", f"<a href='/'>{some(1, 3)}</a>", f"<p>{some(2, 8)}</p>"]), "header", ["header", "site-header", "masthead", "topbar", "banner"])
    foot = lambda: wrap(pick.choice([f"&copy; {some(1, 3)} &middot; {some(3, 14)}", f"<p>{some(4, 12)}</p>" + links(3)]), "footer", ["footer", "site-footer", "bottom", "copyright", "legal"])
    side = lambda: wrap(f"<h3>{some(1, 3)}</h3>" + pick.choice([links(5), f"<p>{some(8, 30)}</p>"]), "aside", ["sidebar", "side", "widget", "related", "recommended", "trending"])
    notice = lambda: wrap(pick.choice([f"<p>{some(6, 25)}</p><button>{some(1, 2)}</button>", some(6, 20)]), "", ["cookie-notice", "cookies", "consent", "notice", "alert", "gdpr", "popup", "newsletter", "subscribe"])
    advert = lambda: wrap(pick.choice([some(4, 16), f"<p>{some(4, 16)}</p>", f"<a href='/y'>{some(3, 9)}</a>"]), "", ["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement"])
    form = lambda: f"<form action='/s'><label>{some(1, 3)}</label><input name='q'>{pick.choice(['', some(2, 6)])}<button>{some(1, 2)}</button></form>"
    share = lambda: wrap(links(3), "", ["share", "social", "tags", "author-box", "byline", "meta"])
    talk = lambda: wrap(
        f"<h3>{some(1, 3)}</h3>" + "".join(wrap(f"<b>{some(1, 2)}</b><p>{some(5, 45)}</p>", "", ["comment", "reply", "comment-body", "user-comment"]) for _ in range(pick.randint(1, 5))),
        "section", ["comments", "discussion", "responses", "comment-list", "disqus", "reader-comments"],
    )
    extra = [menu, head, side, notice, advert, form, share, talk]
    inside = [advert, share, form, side, notice, talk]
    body = []
    title = " ".join(html.unescape(paragraphs[0]).split()[: pick.randint(1, 9)])
    heading = f"<h1>{html.escape(title)}</h1>" if pick.random() < 0.8 else ""
    for k, p in enumerate(paragraphs):
        shape = pick.random()
        if shape < 0.7:
            body.append(f"<p>{p}</p>")
        elif shape < 0.8:
            body.append(f"<p><b>{p}<br>")
        elif shape < 0.87:
            body.append(f"<blockquote><p>{p}</p></blockquote>")
        elif shape < 0.94:
            body.append(f"<ul><li>{p}</li><li>{some(3, 20)}</li></ul>")
        else:
            body.append(f"<h2>{some(2, 7)}</h2><p>{p}</p>")
        if pick.random() < 0.06:
            body.append("\0" + pick.choice(inside)() + "\1")
    if pick.random() < 0.25:
        body.append("\0" + pick.choice(inside)() + "\1")
    inner = heading + "".join(body)
    shape = pick.random()
    if shape < 0.45:
        article = f"<article data-main>{inner}</article>"
    elif shape < 0.6:
        article = f"<main data-main>{inner}</main>"
    else:
        name = pick.choice(["content", "post", "entry-content", "article-body", "main", "story", "text", "page-content", "body-text", "post-content"])
        article = f'<div {pick.choice(["class", "id"])}="{name}" data-main>{inner}</div>'
    if pick.random() < 0.3:
        article = f"<div class='{pick.choice(['container', 'wrapper', 'row', 'layout', 'page'])}'>{article}{side() if pick.random() < 0.5 else ''}</div>"
    above = "".join(pick.choice(extra[:6])() for _ in range(pick.randint(0, 4)))
    below = "".join(pick.choice(extra)() for _ in range(pick.randint(0, 3))) + (foot() if pick.random() < 0.8 else "")
    return f"<html><head><title>{html.escape(title)}</title></head><body>{above}{article}{below}</body></html>"


def _labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a made page, and which of them hold main text."""
    marked = page.replace("\0", "<center>").replace("\1", "</center>")  # what the article does not mean
    nodes, blocks = read_page(marked.replace(" data-main>", " role='zzmain'>"))
    inside = [False] * len(nodes)
    for i, v in enumerate(nodes):
        if v.parent >= 0:
            inside[i] = (inside[v.parent] or "zzmain" in v.tokens) and v.tag != "center"
    holds = np.zeros(len(nodes), dtype=bool)
    for node, _ in blocks:
        if inside[node]:
            while node >= 0 and not holds[node]:
                holds[node] = True
                node = nodes[node].parent
    plain, _ = read_page(page.replace("\0", "").replace("\1", "").replace(" data-main>", ">"))
    kept = [i for i, v in enumerate(nodes) if v.tag != "center"]
    if len(kept) != len(plain):
        return plain, None
    return plain, holds[kept]


def fit_pages(pages: DataFrame, column_: str = "html", sample_pages: int = SAMPLE_PAGES, seed: int = 5) -> PageModel:
    """Fit the trees on made-up layouts around the text of at most ``sample_pages`` pages.

    The sample is the pages of smallest hash among those of at most ``SAMPLE_CHARS`` characters; it only lends
    words and paragraph lengths. Without pages the layouts are filled with placeholder words.
    """
    return fit_layouts(hash_sample(pages, column_, sample_pages, SAMPLE_CHARS), seed)


def fit_layouts(sample: list[str], seed: int = 5) -> PageModel:
    pick = random.Random(seed)
    texts = [[t for _, t in read_page(h)[1]] for h in sample]
    words = [w for blocks in texts for t in blocks for w in t.split()[:40]][:20_000] or ["lorem", "ipsum", "dolor", "sit", "amet"]
    nodes, labels = [], []
    for k in range(max(len(texts), 40) * LAYOUTS):
        lent = [t for t in texts[k % len(texts)] if len(t) > 20] if texts else []
        paragraphs = [html.escape(t) for t in lent[: pick.randint(1, 12)]] or [_words(pick, words, 5, 60) for _ in range(pick.randint(1, 8))]
        made, label = _labelled(_page(pick, paragraphs, words))
        if label is not None:
            nodes.append(made)
            labels.append(label)
    counts = Counter(t for page in nodes for t in {t for v in page for t in (f"<{v.tag}>", *v.tokens)})
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, c in counts.items() if c >= 5))}
    trees = BoostedTrees().fit(
        np.concatenate([features(page, vocabulary) for page in nodes]), np.concatenate(labels).astype(np.float64)
    )
    return PageModel(vocabulary, trees)


def extract_pages(
    pages: DataFrame, model: PageModel, id_column: str = "page_id", url: str = "url", html_column: str = "html"
) -> DataFrame:
    """Main text of every whole page: (id, url, text, n_chars).

    Blocks are joined by an empty line. Null, empty and textless pages have an empty text. Rows are not moved;
    repeated pages are read one by one, and other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred tokens and small trees

    def run(piece):
        found = shared.value.main_texts(texts_of(piece, html_column))
        return {id_column: column(piece, id_column), url: column(piece, url), "text": found, "n_chars": [len(t) for t in found]}

    pages = pages.select(id_column, url, html_column)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return arrow_map(pages, run, html_column, f"{id_column} {kinds[id_column]}, {url} {kinds[url]}, text string, n_chars bigint")
