"""Main text of web pages by tag-path ratios.

Every block of text belongs to the path of tags from the root to its leaf. Per path, text length, punctuation and link
text are summed over the page; their ratios to the number of blocks are smoothed over paths that share a container,
fused into one value, and paths below a share of the best are no content. The deepest element that holds nearly all
text of content paths is the article: what lies in it is its text, short lists and cells too, so a path's value decides
where the article is and not which of its lines are kept. Elements that are never an article's by the HTML standard, or
that say so by a name of their own (comments, adverts, menus), take no part; names that contain such a word do.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from relops.llm.rowwise import annotate

# Element names of the HTML standard.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
NEVER = {"nav", "footer", "aside", "form", "head", "button", "select", "option", "dialog", "menu", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# An opening tag of the key ends an open one of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "blockquote"}
# Words that name what is around an article, words that go with them, and words that name the article.
AROUND = set(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion promoted cookie cookies consent notice notices alert "
    "popup modal nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments respond disqus share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login search widget widgets pagination pager copyright".split()
)
HEADS = {"header", "masthead"}
BESIDE = set("list box wrap wrapper container block area section form item items bar left right top bottom page site inner outer link links slot unit body text content".split())
ARTICLE = {"article", "post", "entry", "story", "content", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[A-Za-z])[^>]*\Z", re.S)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")

# A path is content above this share of the page's best path.
LEAST_SHARE = 0.15
# The article is the deepest element with this share of the text of content paths.
MOST_TEXT = 0.8
# A path below article or main counts so much more.
RAISED = 2.0


@dataclass
class Page:
    """Elements by number, parents before children, and blocks of text outside of what is never content."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    # Paths are numbered too: each is one tag below another path.
    paths: list[int] = field(default_factory=lambda: [0])
    raised: list[bool] = field(default_factory=lambda: [False])
    above: list[int] = field(default_factory=lambda: [-1])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def main_text(page: str | None) -> str:
    """Main text of one page: its content blocks in page order, one a line, white space inside each made one space."""

    found = _parse(page or "")
    if not found.blocks:
        return ""
    content = _content_paths(found)
    # Text of content paths below each element, and below the child that has most of it.
    size = [0] * len(found.tags)
    for node, text, _ in found.blocks:
        if found.paths[node] in content:
            size[node] += len(text)
    heaviest = [-1] * len(size)
    for node in range(len(size) - 1, 0, -1):
        parent = found.parents[node]
        size[parent] += size[node]
        if heaviest[parent] < 0 or size[node] >= size[heaviest[parent]]:
            heaviest[parent] = node
    article = 0
    while heaviest[article] >= 0 and size[heaviest[article]] >= MOST_TEXT * size[0]:
        article = heaviest[article]
    # One block may hold most of the text: its siblings belong to the article as well.
    while article and found.tags[article] not in HOLDERS:
        article = found.parents[article]
    # So does what stands in the same article element, or below the same title.
    headed = [False] * len(size)
    for node, _, _ in found.blocks:
        headed[node] = headed[node] or found.tags[node] == "h1"
    for node in range(len(size) - 1, 0, -1):
        headed[found.parents[node]] |= headed[node]
    article = _outer(found, article, lambda node: found.tags[node] in ("article", "main"))
    if not headed[article]:
        article = _outer(found, article, lambda node: headed[node])
    whole = found.tags[article] not in ("", "html", "body")
    # Where only the page holds the text, each part of it with a content block is the article's.
    inside = [False] * len(size)
    for node in range(len(size)):
        parent = found.parents[node]
        if whole:
            inside[node] = node == article or (parent >= 0 and inside[parent])
        else:
            inside[node] = (parent >= 0 and inside[parent]) or (size[node] > 0 and found.tags[node] not in ("", "html", "body"))
    titled = any(inside[node] and found.tags[node] == "h1" for node, _, _ in found.blocks)
    kept = []
    for node, text, _ in found.blocks:
        alone = not whole and found.paths[node] in content
        if inside[node] or alone or (found.tags[node] == "h1" and not titled):
            kept.append(text)
    return "\n".join(kept)


def _outer(page: Page, node: int, fits) -> int:
    """The nearest element around ``node``, itself included, that fits and is not the whole page; else ``node``."""

    around = node
    while around and page.tags[around] not in ("html", "body"):
        if fits(around):
            return around
        around = page.parents[around]
    return node


def _content_paths(page: Page) -> set[int]:
    """Paths whose smoothed and fused ratio reaches the share of the best."""

    sums: dict[int, list[float]] = {}
    raised: set[int] = set()
    for node, text, linked in page.blocks:
        entry = sums.setdefault(page.paths[node], [0, 0, 0])
        entry[0] += len(text) - linked
        entry[1] += len(PUNCTUATION.findall(text))
        entry[2] += 1
        if page.raised[node]:
            raised.add(page.paths[node])
    own = {path: (length / count) * (1 + marks / count) for path, (length, marks, count) in sums.items()}
    # What a container's paths hold in all, and how many they are.
    held: dict[int, list[float]] = {}
    for path, value in own.items():
        entry = held.setdefault(page.above[path], [0.0, 0.0])
        entry[0] += value * sums[path][2]
        entry[1] += sums[path][2]
    total = sum(entry[0] for entry in held.values()) or 1.0
    fused = {}
    for path, value in own.items():
        mass, count = held[page.above[path]]
        # Smoothing: half a path's own ratio, half its container's; fused with the share of the page that lies there.
        fused[path] = (0.5 * value + 0.5 * mass / count) * (mass / total) ** 0.5 * (RAISED if path in raised else 1.0)
    least = LEAST_SHARE * max(fused.values(), default=0)
    return {path for path, value in fused.items() if value >= least}


def _around(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element names itself as something around the article."""

    if tag in HEADINGS or tag in ("html", "body", "article", "main"):
        return False
    for kind, *values in MARKS.findall(attributes):
        value = next((v for v in values if v), "")
        if kind.lower() == "role":
            if value.strip().lower() in ROLES:
                return True
            continue
        for name in value.split():
            words = [w.lower() for w in WORDS.findall(name)]
            named = [w for w in words if w in AROUND]
            if named and (words[-1] in AROUND or words[-1] in BESIDE or words[-1].isdigit()):
                return True
            if words and words[-1] in HEADS and not inside and not ARTICLE & set(words):
                return True
    return False


def _parse(page: str) -> Page:
    """Elements and blocks of a page. A block is the text between two block-level tags."""

    out = Page()
    known: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, block-level element, hidden, in an article
    # Where in the stack elements of each tag stand, and those that are not inline.
    places: dict[str, list[int]] = {}
    outer: list[int] = []
    endless: set[str] = set()
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text and not stack[-1][2]:
            out.blocks.append((stack[-1][1], text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        if last(outer) >= depth:
            flush()
        for tag, *_ in stack[depth:]:
            places[tag].pop()
            links -= tag == "a"
        while last(outer) >= depth:
            outer.pop()
        del stack[depth:]

    def last(some: list[int] | None) -> int:
        return some[-1] if some else 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    at = 0
    while at < len(page):
        found = TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        closing, name, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not name:
            continue
        if closing:
            depth = last(places.get(name))
            # An inline end tag never closes a block.
            if depth and not (name in INLINE and last(outer) > depth):
                pop_to(depth)
            elif name == "p":
                flush()
            continue
        if name in RAW:
            if name not in INLINE:
                flush()
            end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if not end:
                endless.add(name)
            at = end.end() if end else (len(page) if not attributes.endswith("/") else at)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            add(" ")
            continue
        if name not in INLINE:
            flush()
            ends = {"p"} | HEADINGS if name == "p" or name in HEADINGS else {"p"} | CLOSES.get(name, set())
            begun = max(last(places.get(tag)) for tag in ends)
            if begun > max(last(places.get(tag)) for tag in HOLDERS):
                pop_to(begun)
        if attributes.rstrip().endswith("/") and name not in INLINE:
            continue
        _, node, hidden, inside = stack[-1]
        hidden = hidden or name in NEVER or (name == "header" and not inside) or _around(name, attributes, inside)
        inside = inside or name in ("article", "main")
        if name not in INLINE:
            above = out.paths[node]
            path = known.setdefault((above, name), len(out.above))
            if path == len(out.above):
                out.above.append(above)
            out.tags.append(name)
            out.parents.append(node)
            out.paths.append(path)
            out.raised.append(inside)
            node = len(out.tags) - 1
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            outer.append(len(stack))
        stack.append((name, node, hidden, inside))
        links += name == "a"
    flush()
    return out


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Main text of every page as ``text``, beside the columns ``keep``.

    A null or empty page, and one without content, has the empty text. References are decoded; nothing is cut or
    capped. Time and memory grow with the page's length, however deeply it is nested; equal pages have equal texts. A
    kept column named ``text`` is replaced.
    """

    def compute(pages: pa.Array) -> list[pa.Array]:
        return [pa.array([main_text(page) for page in pages.to_pylist()], pa.string())]

    return annotate(pages, html_col, compute, [("text", "string")], keep)
