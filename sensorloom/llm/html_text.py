"""Operator 8, main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with the path of block-level tags from the root; paths and elements are
numbers in a tree with parent numbers, so time grows with the length of a page, not with its depth. Every path has ratios:
characters per block, punctuation marks per block, and the share of characters outside links. The first two are
smoothed over the neighbouring blocks of the page, and each counts as the geometric mean of its plain and smoothed form, so that a
single line beside a long paragraph does not borrow all of its weight. Their product, averaged over the blocks of a path,
times the share outside links, is the score of the path.

Names only weigh: an element whose class, id or role is that of a menu, notice, advert or comment, or a form, makes paths of
its own below it, and their score is multiplied by a small factor. Where a whole page stands in such an
element all of its paths have the factor, and nothing changes.

Paths that reach a share of the spread of all scores are content. They give the content root: the article or main element that
holds most of their text, otherwise the lowest element around all of them. Below the root, low paths stay with their parent (lists,
tables, captions of an article) unless they are weighed down or mostly links, or stand in a bare container beside content that
lies directly in the page; elsewhere only content paths stay,
with headings that share a parent. Elements that are never the article (nav, footer, aside, scripts and the like) are left out.

Defined cases: a null or empty page, or one without content, gives an empty text; unclosed elements
end with their parent; an unfinished tag at the end of a page is dropped; equal rows give equal rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from math import exp, sqrt
from typing import NamedTuple

from pyspark.sql import DataFrame

from sensorloom.llm.batches import map_texts

RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|select|canvas|audio|video|title"
#: Rest of a start tag that ends with a slash outside an unquoted value.
SELF_CLOSED = r"(?:\s*/>|\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?(?<=[\s\"'])/>)"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:{SELF_CLOSED}|.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
WHITE = re.compile(r"\s+")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav footer aside form button dialog menu head".split())
#: Words of class, id and role values that name something other than the article.
NOT_CONTENT = re.compile(
    r"ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|gdpr|header|masthead"
    r"|menu|modal|nav|navbar|navigation|newsletter|notices?|alert|pagination|pager|popup|promo\w*|recommended|related|replies|respond"
    r"|search|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|tags?|toolbar|widgets?|complementary|contentinfo|disclaimer|legal",
    re.I,
)
#: Words of parts that stand beside an article and never around it.
BESIDE = re.compile(r"ads?|advert\w*|adsense|banner|comments?|commentlist|cookies?|consent|disqus|gdpr|popup|promo\w*|replies|respond|sponsor\w*")
#: Words of place or form, which leave the meaning of a name to its other words.
OF_LAYOUT = frozenset(
    "area bar block bottom box btn button buttons container form global group inner item items left link links list main outer primary right"
    " row secondary section site slot top unit wrap wrapper".split()
)
#: Words that say what an element has or lacks, not what it is.
OF_STATE = frozenset("has have no not with without is hide show".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag that ends an open element of the second set.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
          "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
SCOPES = frozenset("ul ol dl table article section div main body html td th aside nav footer header form".split())
WHOLE, CONTAINERS = frozenset(("", "html", "body")), frozenset(("div", "section"))
PUNCTUATION = re.compile(r"[^\w\s]")
WIDTH = 1.0
SHARE_OF_SPREAD = 0.25
#: From this share of link characters on, neighbouring blocks of a low path are a menu.
LINK_SHARE = 0.5
HREF = re.compile(r"\bhref\s*=", re.I)


SEEN, FORM, NAMED, APART, HIDDEN = range(5)
#: What a path's score is multiplied by below a form, a named element, and one that never holds an article.
WEIGHTS = (1.0, 0.2, 0.05, 0.005)


def names(token: str) -> int:
    """Whether a class, id or role names something other than the article: a word, alone or the last of a
    compound ("cookie-notice"), or with words of layout only ("comment-list")."""
    parts = [x for x in re.split(r"[_-]+", token.lower()) if x]
    other = [x for x in parts if NOT_CONTENT.fullmatch(x)]
    if not other or not OF_STATE.isdisjoint(parts):
        return SEEN
    rest = [x for x in parts if x not in other and x not in OF_LAYOUT]
    if rest and (other[-1] != parts[-1] or parts[-1] == "header"):
        return SEEN
    return APART if any(map(BESIDE.fullmatch, parts)) else NAMED


def named_otherwise(attrs: str) -> int:
    """What the attributes say of the element: SEEN, NAMED as not content, APART from any, or HIDDEN."""
    found = SEEN
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HIDDEN
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return HIDDEN
        elif value and name in ("class", "id", "role") and NOT_CONTENT.search(value):
            found = max(found, *map(names, value.split()), SEEN)
    return found


class Block(NamedTuple):
    path: int  # number of the path
    element: int  # number of the element that holds it
    text: str
    linked: int  # characters in links


def plain(text: str) -> str:
    return WHITE.sub(" ", html.unescape(text)).strip()


class Page:
    """Blocks of a page in order, with the trees of its elements and paths; element 0 and path 0 are the page itself.

    A parent has a smaller number than its children.
    """

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        # Per element: parent, tag, path, what names around it say, outermost article and main element.
        self.parent, self.tags, self.path_of, self.said = [0], [""], [0], [SEEN]
        self.article, self.main = [0], [0]
        # Per path: parent, tag, what names around it say.
        self.path_parent, self.path_tags, self.path_said = [0], [""], [SEEN]
        self.numbers: dict[tuple[int, str, int], int] = {}
        self.read(page)

    def open_element(self, parent: int, tag: str, said: int) -> int:
        around = max(said, self.said[parent])
        number = len(self.parent)
        key = (self.path_of[parent], tag, around)
        if key not in self.numbers:
            self.numbers[key] = len(self.path_parent)
            self.path_parent.append(key[0])
            self.path_tags.append(tag)
            self.path_said.append(around)
        self.parent.append(parent)
        self.tags.append(tag)
        self.path_of.append(self.numbers[key])
        self.said.append(around)
        self.article.append(self.article[parent] or (number if tag == "article" else 0))
        self.main.append(self.main[parent] or (number if tag == "main" else 0))
        return number

    def read(self, page: str) -> None:
        stack: list[tuple[str, int, int]] = [("", SEEN, 0)]  # open block-level elements: tag, whether hidden, number
        is_open: Counter[str] = Counter()
        held: list[str] = []
        hidden = linked = 0
        link = -1  # depth of the open link
        inline_hidden: list[str] = []

        def hold(text: str) -> None:
            nonlocal linked
            if not hidden and not inline_hidden:
                held.append(text)
                if link >= 0:
                    linked += len(plain(text))

        def flush() -> None:
            nonlocal linked
            if held:
                text = plain("".join(held))
                if text:
                    element = stack[-1][2]
                    self.blocks.append(Block(self.path_of[element], element, text, linked))
                held.clear()
            linked = 0

        def close_down_to(depth: int) -> None:
            nonlocal hidden, link
            while len(stack) > depth:
                tag, said, _ = stack.pop()
                is_open[tag] -= 1
                hidden -= said == HIDDEN
            if link > depth:
                link = -1

        def leave_head(content: bool) -> None:
            if content and stack[-1][0] == "head":
                close_down_to(len(stack) - 1)

        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                leave_head(page[at:m.start()].strip() != "")
                hold(page[at:m.start()])
            at = m.end()
            tag = m.group("tag")
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                flush()
                continue
            leave_head(tag not in VOID and not m.group("end"))
            if tag in INLINE:
                if tag in VOID:
                    continue
                if tag == "a":
                    link = len(stack) if not m.group("end") and HREF.search(m.group("attrs")) else -1
                if m.group("end"):
                    if inline_hidden and tag == inline_hidden[-1]:
                        inline_hidden.pop()
                elif inline_hidden and tag == inline_hidden[-1] or not inline_hidden and m.group("attrs") and named_otherwise(m.group("attrs")) == HIDDEN:
                    inline_hidden.append(tag)
                continue
            flush()
            inline_hidden.clear()
            if m.group("end"):
                if is_open[tag]:
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    close_down_to(depth)
                continue
            if tag in VOID or tag == "head" and any(t not in ("", "html") for t, _, _ in stack):
                continue
            closes = CLOSES.get(tag) or ({"p"} if tag in ENDS_PARAGRAPH else ())
            if any(is_open[t] for t in closes):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in closes:
                        close_down_to(depth)
                    elif stack[depth][0] in SCOPES:
                        break
            parent = stack[-1][2]
            in_article = self.article[parent] or self.main[parent]
            said = HIDDEN if tag in LEFT_OUT and tag != "form" or tag == "header" and not in_article else SEEN
            if said != HIDDEN and tag not in ("html", "body", "article", "main") and m.group("attrs"):
                said = named_otherwise(m.group("attrs"))
            if tag == "form":
                said = max(said, FORM)
            is_open[tag] += 1
            # Inside a hidden element nothing is seen, whatever it is called.
            stack.append((tag, said, self.open_element(parent, tag, SEEN if said == HIDDEN else said)))
            hidden += said == HIDDEN
        if at < len(page):
            hold(page[at:])
        flush()


def smoothed(values: list[float], width: float = WIDTH) -> list[float]:
    """Gaussian mean over the neighbouring blocks."""
    reach = int(2 * width)
    weights = {k: exp(-k * k / (2 * width * width)) for k in range(-reach, reach + 1)}
    out = []
    for i in range(len(values)):
        near = [(values[i + k], w) for k, w in weights.items() if 0 <= i + k < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def path_scores(page: Page) -> dict[int, float]:
    """Score of every path that has blocks."""
    blocks = page.blocks
    chars, marks, links, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        chars[b.path] += len(b.text)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        links[b.path] += min(b.linked, len(b.text))
        count[b.path] += 1
    # Ratio of the block's path in page order.
    by_chars, by_marks = [chars[b.path] / count[b.path] for b in blocks], [(marks[b.path] + 1) / count[b.path] for b in blocks]
    fused: dict[int, float] = defaultdict(float)
    for block, x, y, near_x, near_y in zip(blocks, by_chars, by_marks, smoothed(by_chars), smoothed(by_marks)):
        fused[block.path] += sqrt(x * near_x) * sqrt(y * near_y) / count[block.path]
    return {p: s * (1 - links[p] / chars[p]) * WEIGHTS[page.path_said[p]] for p, s in fused.items()}


def found_paths(scores: dict[int, float], share_of_spread: float) -> set[int]:
    """The paths whose score reaches the share of the spread."""
    mean = sum(scores.values()) / len(scores)
    limit = share_of_spread * sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores))
    return {p for p, s in scores.items() if s >= limit}


def content_roots(page: Page, found: list[Block]) -> set[int]:
    """Elements that hold the content: articles (or main elements), or the lowest element around all found blocks."""
    of = [page.article[b.element] or page.main[b.element] for b in found]
    inside = sum(len(b.text) if a else -len(b.text) for a, b in zip(of, found))
    if any(of) and inside >= 0:
        return set(of) - {0}
    below = [0] * len(page.parent)  # found blocks below each element, those directly in it apart
    for b in found:
        below[page.parent[b.element]] += 1
    lowest = 0
    for i in range(len(below) - 1, 0, -1):
        if below[i] == len(found):
            lowest = i
            break
        below[page.parent[i]] += below[i]
    return {lowest}


def main_text(html_page: str, share_of_spread: float = SHARE_OF_SPREAD) -> str:
    page = Page(html_page)
    if not page.blocks:
        return ""
    kept = found_paths(path_scores(page), share_of_spread)
    parents: set[int] = set()
    for p in kept:
        while p and page.path_parent[p] not in parents:
            p = page.path_parent[p]
            parents.add(p)
    roots = content_roots(page, [b for b in page.blocks if b.path in kept])
    holds = [False] * len(page.parent)  # whether a content path has blocks below the element
    for b in page.blocks:
        holds[b.element] = holds[b.element] or b.path in kept
    for i in range(len(holds) - 1, 0, -1):
        holds[page.parent[i]] = holds[page.parent[i]] or holds[i]
    # Whether an element is below a root, and what names say of it there. Directly below the page, a container without content is no part of it.
    inside = [i in roots for i in range(len(page.parent))]
    root_said, whole_page = list(page.said), not roots.isdisjoint(i for i, t in enumerate(page.tags) if t in WHOLE)
    for i in range(1, len(inside)):
        if inside[page.parent[i]]:
            inside[i], root_said[i] = not whole_page or holds[i] or page.tags[i] not in CONTAINERS, root_said[page.parent[i]]
    # Characters and link characters of neighbours with the same tag.
    size, linked = defaultdict(int), defaultdict(int)
    for b in page.blocks:
        size[page.parent[b.element], page.tags[b.element]] += len(b.text)
        linked[page.parent[b.element], page.tags[b.element]] += b.linked

    def stays(b: Block) -> bool:
        if b.path in kept or page.path_tags[b.path] in HEADINGS and page.path_parent[b.path] in parents:
            return True
        beside = page.parent[b.element], page.tags[b.element]
        weighed_down = page.said[b.element] > root_said[b.element]
        return inside[b.element] and not weighed_down and linked[beside] < LINK_SHARE * size[beside]

    return "\n".join(b.text for b in page.blocks if stays(b))


def extract_text(pages: DataFrame, id_columns: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """The id columns, text (empty if there is none) and n_chars, its code points, per row."""

    def compute(texts: list[bytes]) -> list[list]:
        found = [main_text(t.decode("utf-8")) for t in texts]
        return [found, list(map(len, found))]

    return map_texts(pages, [(c, c) for c in id_columns], html_column, compute, "text string, n_chars long")
