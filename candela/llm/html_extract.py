"""Main text of web pages by minimum-cut labelling.

A page becomes a graph. Its text blocks are nodes: a linear classifier over length against the page's own blocks, link
density, tag and closing mark gives the cost of calling one content or boilerplate, and these costs are its capacities to
the two terminals. Items of a list or cells of a table share out one such evidence, so that its length doesn't decide.

Smoothness edges carry what a block alone doesn't tell: short lines, lists, table heads and links within an article look
like boilerplate, and stay because of what is around them. Neighbouring blocks are joined; so is each block to the
element that holds it, each such element to the next one around it, and to the article or main element it lies in, whose
tag makes it dear to call boilerplate. No edge crosses the border of an element that looks like boilerplate.

Elements that look like boilerplate by tag, role or class are nodes too, with a price for being content after all, and an
edge that no cut may cross from each block or such element to the next one around it: a block can be content only if the
elements around it are. So a page-wide form or a misleading class is paid for by the paragraphs it holds, while a small
one closes with all that is in it. The minimum cut, found by maximum flow, is the labelling of least total cost; the
content blocks in page order are the text. A button or label with text of its own block on both sides is part of the
sentence; any other goes.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm._shared import ship

#: Fixed values of HTML: elements without content, elements whose content is raw text, and elements that make blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea iframe noembed noframes xmp template canvas select".split())
BLOCKS = set(
    "html head body title address article aside blockquote button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav noscript ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that end at the next of their kind; an open paragraph ends at any block.
SELF_ENDING = set("p li dt dd tr td th option".split())
#: Elements and roles that are boilerplate, and those of the page as a whole, whose classes tell nothing.
AWAY_TAGS = set("head title nav footer aside button dialog noscript menu label legend search option".split())
AWAY_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar status".split())
ROOTS = {"html", "body", "head"}
AWAY_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header legal login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion "
    "recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "tags teaser toolbar topbar widget".split()
)
#: Parts of a class name that leave the meaning of a boilerplate word beside them, and parts that deny it.
PLAIN_PARTS = set(
    "area bar block body bottom box btn button buttons col column container content entry footer form global group holder icons inner item "
    "items left links list main meta module outer page panel post primary reader region right row secondary section site "
    "slot text thread top unit user view wrap wrapper zone article story".split()
)
DENIALS = set("no not non without has have with is js hide hides show shows toggle".split())
NEAR_WORDS, ARTICLE_WORDS = set("body content main text".split()), set("article articlebody entry post story".split())
NEAR_TAGS = {"article", "main"}
#: Buttons and labels, and the elements whose texts are pieces of a list or a table.
CONTROLS, ITEMS = {"button", "label"}, set("li dt dd td th".split())
#: First words of a heading over readers' comments.
COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader |user )?(?:comments?|responses|replies|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply))(?:\s*\(?\d*\)?)?:?$", re.I)
#: Capacity of the edge to a content element by tag or role, by a word for articles, by another word.
NEAR, NEAR_ARTICLE, NEAR_WORD = 2.5, 2.0, 1.5
#: Price of calling a whole content element boilerplate, in such capacities.
FRAME = 3.0
#: Evidence: at the start, for a paragraph, for a heading, for a closing mark, for a whole block of links; letters of a full-length block at most.
PRIOR, PARAGRAPH, HEADING, CLOSED, LINKED, LONG = -0.6, 0.3, 0.2, 0.4, -3.0, 80
#: Prices of an element for being content: certain, likely and doubtful boilerplate; of a certain one that holds <main>.
CERTAIN, LIKELY, FORM, DOUBTFUL, AROUND_MAIN = 1000.0, 8.0, 1.6, 1.4, 3.2
#: Capacities of smoothness edges, whole units in one unit of cost, and the capacity of an edge that no cut crosses.
ADJACENT, SIBLING, HELD, UNITS, UNCUT = 0.3, 0.6, 0.5, 1000, 1 << 60

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|=|$)")


class Block:
    """Text of one block, the tag of its element, linked characters, the number of the element that holds it and the boilerplate element around it (or -1)."""

    __slots__ = ("text", "tag", "linked", "parent", "mark")

    def __init__(self, text: str, tag: str, linked: int, parent: int, mark: int):
        self.text, self.tag, self.linked, self.parent, self.mark = text, tag, linked, parent, mark


class Element:
    """Tag, number, number of the parent, the nearest content element (strength and number, or 0) and boilerplate element (or -1), itself included."""

    __slots__ = ("tag", "number", "parent", "near", "anchor", "mark")

    def __init__(self, tag: str, number: int, parent: int, near: float, anchor: int, mark: int):
        self.tag, self.number, self.parent, self.near, self.anchor, self.mark = tag, number, parent, near, anchor, mark


def class_price(name: str) -> float:
    """Price of one class or id name. Whole names and names with plain parts are certain; "no-sidebar" tells nothing."""
    if name.lower() in AWAY_WORDS:
        return CERTAIN
    parts = [w.lower() for w in PARTS.findall(name)]
    if len(parts) < 2 or DENIALS.intersection(parts) or not AWAY_WORDS.intersection(parts):
        return 0.0
    if all(w in AWAY_WORDS or w in PLAIN_PARTS for w in parts):
        return CERTAIN
    return LIKELY if parts[-1] in AWAY_WORDS else DOUBTFUL


@lru_cache(maxsize=1 << 12)
def class_evidence(value: str) -> tuple[float, float, bool]:
    """(price of the clearest name, nearness, whether a whole name is a boilerplate word or "hidden") of a class or id value."""
    names = value.split()
    price = max(map(class_price, names), default=0.0)
    whole = any(n.lower() in AWAY_WORDS or n.lower() == "hidden" for n in names)
    parts = {w.lower() for n in names if not class_price(n) for w in PARTS.findall(n)}
    return price, NEAR_ARTICLE if ARTICLE_WORDS & parts else NEAR_WORD if NEAR_WORDS & parts else 0.0, whole


def _element(tag: str, attributes: str, above: Element, number: int, marks: list[list]) -> Element:
    """The element that a start tag opens; boilerplate elements are added to marks as [price, mark around it, holds <main>]."""
    near = NEAR if tag in NEAR_TAGS else 0.0
    # A header of the article itself holds its title; any other header is the site's.
    price = CERTAIN if tag in AWAY_TAGS or tag == "header" and above.near < NEAR_ARTICLE else FORM if tag in ("form", "fieldset") else 0.0
    if attributes and tag not in ROOTS:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                # Long values are read whole too, but not remembered.
                found, nearness, whole = (class_evidence if len(value) <= 1000 else class_evidence.__wrapped__)(value)
                # An article's compound names are its topic or state, not its kind.
                price = max(price, found if tag not in NEAR_TAGS else CERTAIN if whole else 0.0, CERTAIN if whole else 0.0)
                near = max(near, nearness)
            elif name == "role":
                price = max(price, CERTAIN if value.lower() in AWAY_ROLES else FORM if value.lower() == "form" else 0.0)
                near = max(near, NEAR) if value.lower() in ("main", "article") else near
            elif name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                price = CERTAIN
        if HIDDEN.search(attributes):
            price = CERTAIN
    mark = above.mark
    if tag == "main" and mark >= 0:
        marks[mark][2] = True
    if price:
        marks.append([price, mark, False])
        mark = len(marks) - 1
    strength, anchor = (near, number) if near else (0.0, 0) if price else (above.near, above.anchor)
    return Element(tag, number, above.number, strength, anchor, mark)


def _list(b: Block, elements: list[Element]) -> int | None:
    """The list or table that a block is an item of."""
    if b.tag not in ITEMS:
        return None
    of = elements[b.parent]
    while b.tag in ("td", "th") and of.tag in ("tr", "tbody", "thead", "tfoot"):
        of = elements[of.parent]
    return of.number


def evidence(found: list[Block], elements: list[Element]) -> list[float]:
    """Log odds that each block is content. A full length is that of the page's unlinked text (weighted by length), LONG at most."""
    own = [max(len(b.text) - b.linked, 0) for b in found]
    full = max(1.0, min(LONG, sum(x * x for x in own) / max(1, sum(own))))
    out = []
    for b in found:
        z = PRIOR + min(len(b.text) / full, 2.0) + LINKED * min(1.0, b.linked / len(b.text))
        z += HEADING if b.tag in HEADINGS else PARAGRAPH if b.tag in ("p", "blockquote", "pre") else 0.0
        out.append(z + (CLOSED if b.text[-1] in ".!?:;…。\"'”»" else 0.0))
    lists = [_list(b, elements) for b in found]
    items = Counter(lists)
    return [z if of is None else z / items[of] for z, of in zip(out, lists)]


def blocks(page: str) -> tuple[list[Block], list[list], list[Element]]:
    """The text blocks of a page in order, its boilerplate elements (see _element) and its elements by number.

    Markup, comments, scripts and styles are gone, white space is one space. Time is linear in the page.
    """
    root = Element("", 0, 0, 0.0, 0, -1)
    stack, elements, places = [root], [root], defaultdict(list)  # places: of the open elements of a tag, in the stack
    out, marks, parts, linked, in_link = [], [], [], 0, False
    control, doubt = "", -1  # an open button or label within text, and where in parts those begin that no text follows yet

    def push(tag: str, attributes: str) -> None:
        places[tag].append(len(stack))
        stack.append(_element(tag, attributes, stack[-1], len(elements), marks))
        elements.append(stack[-1])

    def end_block() -> None:
        nonlocal linked, doubt
        if doubt >= 0:
            del parts[doubt:]
            doubt = -1
        if parts:
            if text := " ".join("".join(parts).split()):
                top = stack[-1]
                if top.tag in HEADINGS and COMMENTS.match(text) and top.mark == stack[-2].mark and stack[-2].tag not in ROOTS | NEAR_TAGS | {""}:
                    marks.append([LIKELY, top.mark, False])  # what follows under the same parent is readers' comments
                    top.mark = stack[-2].mark = len(marks) - 1
                out.append(Block(text, top.tag, linked, top.parent, top.mark))
            parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked, doubt
        if raw:
            if doubt >= 0 and not control and not raw.isspace():
                doubt = -1
            parts.append(html.unescape(raw) if "&" in raw else raw)
            if in_link:
                linked += len(parts[-1].strip())

    at, n, tags_end = 0, len(page), page.rfind(">") + 1  # beyond it nothing is a tag
    while at < n:
        m = TAG.search(page, at, tags_end)
        if m is None:
            text(page[at:].partition("<!--")[0])
            break
        text(page[at : m.start()])
        at, closing, tag = m.end(), m[1], (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # a comment that never ends holds the rest of the page
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in RAW and not closing:
            close = RAW_END[tag].search(page, at)
            at = n if close is None else close.start()
        elif tag in CONTROLS and (control == tag if closing else not control and stack[-1].tag not in CONTROLS and any(map(str.strip, parts))):
            control = "" if closing else tag
            if not closing and doubt < 0:
                doubt = len(parts)
        elif tag in BLOCKS:
            end_block()
            if control:  # it holds blocks, so it is no part of a sentence
                push(control, "")
                control = ""
            if closing:
                if places[tag]:  # it ends all that is open inside it
                    first = places[tag][-1]
                    for gone in stack[first:]:
                        places[gone.tag].pop()
                    del stack[first:]
            elif tag not in VOID:
                if stack[-1].tag == "p" or tag in SELF_ENDING and stack[-1].tag == tag:
                    places[stack.pop().tag].pop()
                push(tag, m[3])
    end_block()
    return out, marks, elements


def minimum_cut(content: list[int], boilerplate: list[int], edges: list[tuple[int, ...]]) -> list[bool]:
    """Labels (True: content) of least cost: content[i] if i is content, boilerplate[i] if not, and c for each edge (i, j, c) cut.

    An edge (i, j, c, back) costs c if i alone is content and back if j alone is.

    Maximum flow by shortest augmenting layers. A node's direct flow between both terminals is taken first, so that only
    the excess moves along edges. Of several least cuts the one with the most content is returned.
    """
    n = len(content)
    supply = [b - a for a, b in zip(content, boilerplate)]  # above 0: from the content terminal, below: to the other
    to, room, out = [], [], [[] for _ in range(n)]
    for i, j, c, *back in edges:
        out[i].append(len(to))
        out[j].append(len(to) + 1)
        to += [j, i]
        room += [c, back[0] if back else c]
    while True:
        layer, queue, reached = [-1] * n, deque(i for i in range(n) if supply[i] > 0), False
        for i in queue:
            layer[i] = 0
        while queue:
            i = queue.popleft()
            reached = reached or supply[i] < 0
            for e in out[i]:
                if room[e] and layer[to[e]] < 0:
                    layer[to[e]] = layer[i] + 1
                    queue.append(to[e])
        if not reached:
            break
        seen = [0] * n
        for s in range(n):
            while supply[s] > 0 and layer[s] == 0:
                path, i = [], s
                while supply[i] >= 0:
                    while seen[i] < len(out[i]) and not (room[out[i][seen[i]]] and layer[to[out[i][seen[i]]]] == layer[i] + 1):
                        seen[i] += 1
                    if seen[i] < len(out[i]):
                        path.append(out[i][seen[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        seen[i] += 1
                    else:
                        break
                if not path:
                    break
                flow = min(supply[s], -supply[i], *(room[e] for e in path))
                supply[s] -= flow
                supply[i] += flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
    # Boilerplate is what can still reach its terminal.
    away, queue = [x < 0 for x in supply], deque(i for i in range(n) if supply[i] < 0)
    while queue:
        i = queue.popleft()
        for e in out[i]:
            if room[e ^ 1] and not away[to[e]]:
                away[to[e]] = True
                queue.append(to[e])
    return [not x for x in away]


def prices(marks: list[list]) -> list[float]:
    """Prices of the boilerplate elements: one around <main>, however deep, is the page's frame rather than a part of it."""
    for price, around, holds in reversed(marks):
        if holds and around >= 0:
            marks[around][2] = True
    return [min(price, AROUND_MAIN) / (2 if price <= FORM else 1) if holds else price for price, _, holds in marks]


def graph(found: list[Block], marks: list[list], elements: list[Element], smooth: float = 1.0) -> tuple[list[float], list[float], list[tuple]]:
    """(cost of content, cost of boilerplate, edges) of a page's nodes: its blocks, then its boilerplate elements, then the elements that hold blocks."""
    n, z = len(found), evidence(found, elements)
    content = [math.log1p(math.exp(-x)) for x in z] + prices(marks)
    boilerplate = [math.log1p(math.exp(x)) for x in z] + [0.0] * len(marks)
    fixed = [(n + i, n + around) for i, (_, around, _) in enumerate(marks) if around >= 0] + [(j, n + b.mark) for j, b in enumerate(found) if b.mark >= 0]
    edges = [(j - 1, j, ADJACENT + (SIBLING if found[j - 1].parent == found[j].parent else 0.0)) for j in range(1, n) if found[j - 1].mark == found[j].mark]
    node: dict[int, int] = {}

    def holder(number: int) -> int:
        """The node of an element; the first call joins it, and those around it, to their parents and content elements."""
        first = number
        while number not in node:
            node[number] = len(content)
            content.append(0.0)
            of = elements[number]
            boilerplate.append(FRAME * of.near if of.anchor == number else 0.0)
            if of.mark >= 0:
                fixed.append((node[number], n + of.mark))
            number = of.parent
        return node[first]

    for j, b in enumerate(found):
        # An item's edge carries its share of the evidence, so a list is kept or dropped as one.
        above = holder(b.parent)
        if b.mark == elements[b.parent].mark:
            edges.append((j, above, max(HELD, 1.5 * abs(z[j])) if b.tag in ITEMS - {"td", "th"} else HELD))
    for number, i in list(node.items()):
        of = elements[number]
        if number and of.mark == elements[of.parent].mark:
            edges.append((i, node[of.parent], HELD))
        if of.anchor and of.anchor != number and of.anchor in node:
            edges.append((i, node[of.anchor], of.near))
    for j, b in enumerate(found):
        if b.tag not in ITEMS and (of := elements[b.parent]).anchor in node and of.anchor and of.mark == b.mark:
            edges.append((j, node[of.anchor], of.near))
    return content, boilerplate, [(i, j, UNCUT, 0) for i, j in fixed] + [(i, j, smooth * c) for i, j, c in edges]


def main_text(page: str | None, smooth: float = 1.0) -> str:
    """Content blocks joined by newlines; empty for a null or empty page. smooth scales the smoothness edges."""
    found, marks, elements = blocks(page or "")
    if not found:
        return ""
    content, boilerplate, edges = graph(found, marks, elements, smooth)
    whole = lambda x: round(UNITS * x)
    labels = minimum_cut(list(map(whole, content)), list(map(whole, boilerplate)), [e if len(e) == 4 else (*e[:2], whole(e[2])) for e in edges])
    return "\n".join(b.text for b, keep in zip(found, labels) if keep)


def extract(page: Column) -> Column:
    """Main text of a column of HTML."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype="str")

    return F.pandas_udf(texts, "string")(page)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars (code points). Whole pages, no shuffle.

    Null and empty pages have empty texts, null ids and urls stay null, rows that repeat an id or a page give a row each,
    and an empty table gives an empty result. Other columns, of whatever name, are left out. Of several least cuts the one
    with the most content is taken.
    """
    ship(pages.sparkSession)
    out = pages.select(pages[id_col], pages[url_col], F.coalesce(extract(pages[html_col]), F.lit("")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
