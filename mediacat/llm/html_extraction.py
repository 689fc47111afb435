"""Main text of web pages by minimum cut.

A page becomes blocks of text in page order.  A classifier gives each block log-odds of being content: a weighted sum of
features of the block (length, end of sentence, share of link text, own tag) and of the elements around it (tags, names, and how
much of the page's text they hold), see ``W``.  The log-odds become its capacities to the two terminals.  Smoothness edges join
neighbouring blocks, more strongly the closer they are in the tree, and join blocks to a node for their container, and containers
to their parents.  The minimum cut separates content from the rest; nodes whose terminal capacity outweighs all their edges are
settled first (any minimum cut has them so), and maximum flow settles the others.

Names of page furniture count against an element, unless it holds the article itself: the ancestors of an article's main heading, or
where there is none those of an ``article`` or ``main`` with much of the text, are layout whatever they are called.

Null, empty and text-free pages give the empty text; broken markup is read as browsers do where that matters (unclosed head,
button, svg and the like); very long pages are solved whole, as one graph; blocks whose two labels cost the same are left out;
repeated rows are extracted one by one; other columns are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released
from .words import slices

NEAR, FAR, MEMBER, NESTED = 1.5, 0.4, 0.5, 0.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|template|textarea|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose whole content is no text, if they are closed at all.
_SKIPPED = {"noscript", "select", "svg", "object", "button", "annotation"}
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Names of page furniture, of the heads among it, and of content.
_FURNITURE = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|sidebar\w*|aside|widget\w*|"
    r"related|recommend\w*|share|sharing|social|cookies?|consent|notices?|alerts?|popup|modal|dialog|newsletter|subscri\w+|signup|login|comments?|commentlist|disqus|respond|"
    r"repl(?:y|ies)|search|pagination|pager|copyright|legal|toolbar|contentinfo|complementary)(?![a-z])"
)
_HEADS = re.compile(r"(?<![a-z])(?:header|masthead|banner)(?![a-z])")
_CONTENT = re.compile(r"(?<![a-z])(?:article|content|main|post|entry|story|articlebody)(?![a-z])")
_COMMENTS = re.compile(r"(?<![a-z])(?:comments?|commentlist|disqus|respond|repl(?:y|ies))(?![a-z])")
#: Words that a name of furniture may have besides: of place, of form and of what is listed.  Inside an article a name counts as that of furniture
#: only if it is made of both kinds of words alone; one that merely has such a word in it ("legal-basis") weighs a little.
_PARTS = frozenset(
    "site page main top bottom left right upper lower inner outer box block bar area list items item links link wrap wrapper container section panel group row col column buttons button icons icon tools "
    "inline slot post posts article articles story stories entry form title heading head body text count number the and to us this more also tags tag primary secondary global mobile desktop js c is u x".split()
)
_SPLIT = re.compile(r"[-_:]+")
_DROP = {"nav", "footer", "aside", "menu", "dialog"}
_HEADINGS = {"h1": 1.5, "h2": 0.8, "h3": 0.6, "h4": 0.4, "h5": 0.2, "h6": 0.2}
_LEAVES = {"p", "li", "dt", "dd", "td", "th", "caption", "figcaption", "pre", "blockquote", "address", "summary", "option", "legend", *_HEADINGS}
_CONTAINERS = {"html", "body", "div", "section", "article", "main", "header", "nav", "footer", "aside", "form", "fieldset", "ul", "ol", "dl", "table", "thead", "tbody",
               "tfoot", "tr", "figure", "details", "menu", "dialog", "center", "hgroup", "search", "head"}
_VOID_BREAKS = {"br", "wbr", "img", "input", "hr"}
#: The classifier's weights.  Of elements, passed on to all that they hold: furniture (and nothing inside takes it back), forms,
#: content names, articles.  Of blocks: words up to 30, the constant, the end of a sentence, the share of link text outside and
#: inside an article, prose tags, list items; headings have their own.  A hint is a word of furniture in a name that has other words, in an article.
W = {"furniture": -6.0, "hint": -1.5, "form": -5.0, "content": 2.0, "article": 4.0, "word": 0.1, "constant": -1.0, "sentence": 0.5, "links": -4.0, "own_links": -2.0, "prose": 1.0, "item": -0.5}
#: Shares of the page's text from which an article or main is the page's, a form is the page's layout, an element is the page's whatever
#: its name, unless that is one of comments, and whatever its name at all.
ANCHOR, WHOLE_FORM, WHOLE, ALL = 0.4, 0.6, 0.6, 0.98


class Element:
    """An open or closed element: its place in the tree, what it is called, and the characters of unlinked text that it holds."""

    __slots__ = ("tag", "parent", "node", "names", "hidden", "solid", "lifted", "bias", "article")

    def __init__(self, tag: str, parent: int, node: int, names: str, hidden: bool) -> None:
        self.tag, self.parent, self.node, self.names, self.hidden = tag, parent, node, names, hidden
        self.solid, self.lifted, self.bias, self.article = 0.0, False, 0.0, False


class Block:
    __slots__ = ("text", "node", "score", "element", "links")

    def __init__(self, text: str, node: int, element: int, links: float) -> None:
        self.text, self.node, self.element, self.links = text, node, element, links
        self.score = 0.0


def read_page(page: str) -> tuple[list[Block], list[int], list[Element]]:
    """Blocks in page order, the parent of each container node (node 0 is the page), and all elements, parents first."""
    elements = [Element("", -1, 0, "", False)]
    stack, parents, out = [0], [-1], []
    text: list[str] = []
    linked = inside = 0  # characters of link text in the block; depth of links
    at = 0
    unclosed: set[str] = set()  # skipped elements that nothing closes any more

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            whole = " ".join(html.unescape(raw).split()) if not raw.isspace() else ""
            if whole:
                out.append(Block(whole, elements[stack[-1]].node, stack[-1], min(linked / max(len(raw), 1), 1)))
            text.clear()
        linked = 0

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
            if inside:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"]:
                text.append(" ")
            continue
        tag = tag.lower()
        closing = m["end"] if m["tag"] else m["end2"]
        if tag in _SKIPPED and not closing and tag not in unclosed:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            if end:
                at = end.end()
                text.append(" ")
            else:
                unclosed.add(tag)
        elif tag == "a":
            inside = 0 if closing else 1
        elif tag in _VOID_BREAKS:
            if tag == "hr":
                flush()
            else:
                text.append(" ")
        elif tag in _LEAVES or tag in _CONTAINERS:
            flush()
            if closing:
                limit = len(stack) - 1
                while limit > 0 and elements[stack[limit]].tag != tag and (tag in _CONTAINERS or elements[stack[limit]].tag in _LEAVES):
                    limit -= 1
                if limit > 0 and elements[stack[limit]].tag == tag:
                    del stack[limit:]
                continue
            inside = 0
            top = elements[stack[-1]].tag
            while top == "p" or top == "head" or top in _HEADINGS and tag in _HEADINGS or (tag in ("li", "dt", "dd", "td", "th", "tr") and top in ("li", "dt", "dd", "td", "th")):
                stack.pop()
                top = elements[stack[-1]].tag
            if tag == "body":  # whatever the head left open
                del stack[1:]
            node = elements[stack[-1]].node
            if tag in _CONTAINERS:
                parents.append(node)
                node = len(parents) - 1
            attributes = (m["attr"] if m["tag"] else m["attr2"]) or ""
            names = " ".join(x.strip("\"'") for x in _NAMES.findall(attributes)).lower()
            elements.append(Element(tag, stack[-1], node, names, bool(_HIDDEN.search(attributes))))
            stack.append(len(elements) - 1)
    tail = page[at:]
    if tail and not re.match(r"<[/!a-zA-Z]", tail):
        text.append(tail)
    flush()
    return out, parents, elements


def lift(blocks: list[Block], elements: list[Element]) -> None:
    """Marks the elements that hold the article: what they are called does not count."""
    for b in blocks:
        elements[b.element].solid += len(b.text) * (1 - b.links)
    for e in reversed(elements[1:]):  # children come after their parents
        elements[e.parent].solid += e.solid
    whole = elements[0].solid or 1.0
    inside: list[bool] = []  # in an article or main; below a tag that is furniture by itself
    dropped: list[bool] = []
    for e in elements:
        inside.append(e.tag in ("article", "main") or e.parent >= 0 and inside[e.parent])
        dropped.append(e.tag in _DROP or e.hidden or e.parent >= 0 and dropped[e.parent])
    anchors = [k for k, e in enumerate(elements) if e.tag in ("article", "main") and not dropped[k] and e.solid >= ANCHOR * whole]
    headings = [k for k, e in enumerate(elements) if e.tag == "h1" and inside[k] and not dropped[k]]
    for k in headings[:1] or anchors:
        while k > 0 and not elements[k].lifted:
            elements[k].lifted = elements[k].tag != "header" or inside[k]
            k = elements[k].parent
    for e in elements:
        if e.tag in ("html", "body", "div", "section", "center", "table", "tbody", "tr", "td") and (e.solid >= ALL * whole or e.solid >= WHOLE * whole and not _COMMENTS.search(e.names)):
            e.lifted = True


def all_furniture(names: str) -> bool:
    """Whether one of an element's names is made of words of furniture, and of words of place or form, alone."""
    for name in names.split():
        words = [w for w in _SPLIT.split(name) if w]
        known = [bool(_FURNITURE.fullmatch(w)) for w in words]
        if any(known) and all(k or w in _PARTS or w.isdigit() for k, w in zip(known, words)):
            return True
    return False


def weigh(blocks: list[Block], elements: list[Element]) -> None:
    """The log-odds of every block, from its own features and what its elements pass on."""
    whole = elements[0].solid or 1.0
    for e in elements[1:]:
        above = elements[e.parent]
        e.article = above.article or e.tag in ("article", "main")
        e.bias = above.bias
        if above.bias <= W["furniture"]:
            continue
        named = e.names and e.tag not in ("html", "body", "article", "main")
        if e.hidden or e.tag in _DROP or e.tag == "header" and not (above.article or e.lifted):
            e.bias = W["furniture"]
        elif named and not e.lifted and (all_furniture(e.names) if above.article else _FURNITURE.search(e.names) or _HEADS.search(e.names)):
            e.bias = W["furniture"]
        elif named and not e.lifted and above.article and _FURNITURE.search(e.names):
            e.bias += W["hint"]
        elif e.tag in ("article", "main"):
            e.bias = W["article"]
        elif e.tag in ("form", "fieldset") and e.solid < WHOLE_FORM * whole:
            e.bias += W["form"]
        elif e.names and _CONTENT.search(e.names):
            e.bias = max(e.bias, W["content"])
    for b in blocks:
        e = elements[b.element]
        b.score = e.bias + W["constant"] + W["word"] * min(b.text.count(" ") + 1, 30) + (W["sentence"] if b.text[-1] in ".!?…。" else 0)
        b.score += W["own_links" if e.article else "links"] * b.links
        b.score += _HEADINGS.get(e.tag, W["prose"] if e.tag in ("p", "blockquote", "pre") else W["item"] if e.tag == "li" else 0.0)


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """Blocks in page order with their log-odds, and the parent of each container node."""
    blocks, parents, elements = read_page(page)
    lift(blocks, elements)
    weigh(blocks, elements)
    return blocks, parents


def min_cut(unary: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labels (True: source side) of a minimum cut; unary > 0 is capacity from the source, < 0 to the sink."""
    n = len(unary)
    unary = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        if a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    total = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None:
            continue
        if abs(unary[i]) > total[i] + 1e-9 or not near[i]:  # ``total`` loses digits as edges go
            label[i] = unary[i] > 0
            for j, w in near[i].items():  # its edges become capacities of its neighbours
                unary[j] += w if label[i] else -w
                total[j] -= w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        reach = _max_flow(rest, unary, near)
        for i in rest:
            label[i] = i in reach
    return label


def _max_flow(rest: list[int], unary: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source reaches in the residual graph of a maximum flow (shortest augmenting layers)."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = defaultdict(dict)
    for i in rest:
        if unary[i] > 0:
            cap[source][i], cap[i][source] = unary[i], 0.0
        elif unary[i] < 0:
            cap[i][sink], cap[sink][i] = -unary[i], 0.0
        for j, w in near[i].items():
            cap[i][j] = w
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level) - {source}
        arcs = {i: list(cap[i]) for i in level}
        at = dict.fromkeys(level, 0)  # the arc in use; those before it lead nowhere
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:]))
                flow = min(cap[a][b] for a, b in steps)
                for a, b in steps:
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                full = next(k for k, (a, b) in enumerate(steps) if cap[a][b] <= 1e-12)
                path = path[: full + 1]
                continue
            while at[i] < len(arcs[i]):
                j = arcs[i][at[i]]
                if cap[i][j] > 1e-12 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
                at[i] += 1
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1


def label_blocks(blocks: list[Block], parents: list[int]) -> list[bool]:
    n, node = len(blocks), [b.node for b in blocks]
    used: dict[int, int] = {}
    edges: dict[tuple[int, int], float] = {}
    for g, p in enumerate(node):
        while p >= 0 and p not in used:
            used[p] = n + len(used)
            p = parents[p]
        edges[g, used[node[g]]] = MEMBER
        if g:
            edges[g - 1, g] = NEAR if node[g] == node[g - 1] else FAR
    for p, k in used.items():
        if parents[p] >= 0:
            edges[k, used[parents[p]]] = NESTED
    return min_cut([b.score for b in blocks] + [0.0] * len(used), edges)[:n]


def main_text(page: str | None) -> str:
    blocks, parents = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, parents)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points of text)."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    @released
    def read(batches):
        for batch in batches:
            for where, raw in slices(batch["html"], pa.array(range(len(batch)))):
                texts = [main_text(x) for x in raw.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch["page_id"].take(where), batch["url"].take(where), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
