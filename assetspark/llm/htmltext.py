"""Main text of web pages by composite text density.

A page becomes a small tree, of which only what is never shown (scripts, styles, the head) is left out. Each node's
density is its characters per tag, adjusted for the share of them that stands in links; a node's sum is that of its
child blocks' densities, or its own where it has none. The path from the block of the greatest sum up to the body gives
two thresholds, its least density and its least sum. From the body down, each node that reaches the first gives the
subtree of the greatest sum in it as content if that reaches the second. So the article is told from menus, adverts and
footers by density, whatever their tags and names.

Only then, inside what was found, elements, roles and names of menus, adverts, notices, forms and comments are taken
out. If the block of the greatest sum is of these itself, as where comments are longer than the article, all of them
are left out of the tree, which is measured once more. Of equal sums the block of more characters is taken, of these
the first of its parents' children.

Null and empty pages, and pages without text, give an empty text. Rows are handled one by one, whole, so repeated rows
give repeated results; other columns are left alone. A page is read in one pass, also where quotes, comments or elements
are left open: a tag without an end is text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title".split())
NOISE = frozenset("nav header footer aside form button select dialog menu head".split()) | RAW
HIDDEN = RAW | {"head"}
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset(("body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"))
#: A start tag of the first kind ends an open element of the second, up to the nearest of the third.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
NOISE_NAME = re.compile(r"(?:^|\s)(?:(?:site|page|top|global)[_-]?)?header(?=$|\s)|(?:^|[\s_-])(?<!no-)(?<!has-)(?<!with-)(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|disclaimer|popup|modal|comments?|replies|respond|disqus|sidebar|side|rail|widget|menu|nav\w*|breadcrumbs?|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|footer|masthead|pager|pagination|toolbar|skip|print|tags)(?=$|[\s_-])", re.IGNORECASE)
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: The rest of a tag: quotes hold together only after an equals sign. Nothing is tried twice.
REST = re.compile(r"(?>[^>\"'=]+|=\s*+(?:\"[^\"]*\"|'[^']*')|[=\"'])*+>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "hidden", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.hidden = tag in HIDDEN
        self.parts: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0

    def children(self) -> Iterator[Node]:
        return (x for x in self.parts if isinstance(x, Node))


def _is_noise(tag: str, attributes: str) -> bool:
    if tag in NOISE:
        return True
    if tag in ("article", "main", "body", "html") or not attributes.strip():
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and NOISE_NAME.search(value) or name == "role" and value.lower() in NOISE_ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def marks(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, name with a slash where a tag ends an element, attributes) of each tag, and the text after the last.

    Comments and declarations have no name. The time is linear: once a tag's end isn't found with quotes heeded, quotes
    are no longer heeded, and where no > follows, all else is text. What raw elements hold is left out.
    """
    at, n, quoted, text = 0, len(page), True, []
    while at < n:
        left = page.find("<", at)
        if left < 0:
            break
        text.append(page[at:left])
        if page.startswith("<!--", left):
            end = page.find("-->", left + 4)
            at = end + 3 if end >= 0 else n
            continue
        name = NAME.match(page, left + 1)
        if not name and page[left + 1 : left + 2] not in ("!", "?"):
            text.append("<")
            at = left + 1
            continue
        rest = REST.match(page, name.end() if name else left + 2) if quoted else None
        quoted = rest is not None
        end = rest.end() if rest else page.find(">", left) + 1
        if not end:
            at = left
            break
        at = end
        if not name:
            continue
        tag, held = name[0].lower(), page[name.end() : end - 1]
        yield "".join(text), tag, held
        text = []
        if tag in RAW and not held.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
    yield "".join(text) + page[at:], "", ""


def parse(page: str) -> Node:
    """The tree of a page; tags that are missing, crossed or left open are mended as browsers do in the common cases."""
    root = here = Node("html", None, False)
    opened: Counter[str] = Counter()
    seen = set()

    def leave(node: Node) -> Node:
        """What is open once node and all inside it are closed."""
        x = here
        while True:
            opened[x.tag] -= 1
            if x is node:
                return node.parent
            x = x.parent

    for text, name, held in marks(page):
        if text:
            here.parts.append(text)
        tag = name.lstrip("/")
        if not tag or tag == "html" or tag in RAW and name != tag:
            continue
        if name != tag:
            node = here if opened[tag] > 0 else root
            while node is not root and node.tag != tag and not (tag not in BLOCK and node.tag in BLOCK):
                node = node.parent
            if node is not root and node.tag == tag:
                here = leave(node)
            continue
        ends, until = ("p",) if tag in CLOSES_P else (), ("div", "article", "section", "main", "td", "li", "blockquote", "body", "button")
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
        node = here if any(opened[x] > 0 for x in ends) else root
        while node is not root and node.tag not in until:
            up = node.parent
            if node.tag in ends:
                here = leave(node)
                if tag != "tr":
                    break
            node = up
        node = Node(tag, here, _is_noise(tag, held))
        here.parts.append(node)
        if tag in ("main", "article") and tag not in seen:  # what holds the article isn't noise, whatever its name
            seen.add(tag)
            for up in _up(here):
                up.noise &= up.tag in NOISE
        if tag in VOID or tag in RAW or held.rstrip().endswith("/") and tag not in BLOCK:
            continue
        opened[tag] += 1
        here = node
    return root


def _kept(node: Node, names: bool) -> list[Node]:
    """The children that count: those that are shown, with names only those that aren't noise by tag, role or name."""
    return [x for x in node.children() if not (x.hidden or names and x.noise)]


def _ordered(root: Node, names: bool) -> list[Node]:
    """All nodes that count, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += _kept(node, names)
    return out


def measure(root: Node, names: bool = False) -> list[Node]:
    nodes = _ordered(root, names)
    for node in nodes:
        node.chars = node.link_chars = node.tags = node.link_tags = 0
    for node in reversed(nodes):
        text = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        node.chars += text
        link = node.tag == "a"
        if link:
            node.link_chars, node.link_tags = node.chars, node.tags
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + link
    ratio = root.link_chars / max(1, root.chars)
    for node in nodes:
        tags, links, link_tags = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        plain = max(1, node.chars - node.link_chars)
        base = math.log(node.chars / plain * node.link_chars + ratio * node.chars + math.e)
        node.density = node.chars / tags * max(0.0, math.log(max(1.0, node.chars / links * tags / link_tags)) / base) if node.chars else 0.0
    for node in nodes:
        inner = [x.density for x in _kept(node, names) if x.tag in BLOCK]
        node.total = sum(inner) if inner else node.density  # what stands inside a line is no block of its own
    return nodes


def content(root: Node, names: bool = False) -> set[Node]:
    """The nodes whose subtrees are the main text, by density; with names without what is noise."""
    nodes = measure(root, names)
    body = next((x for x in nodes if x.tag == "body"), root)
    densest = max((x for x in nodes if x.tag in BLOCK or x is root), key=lambda x: x.total)
    path = list(_up(densest))
    path = path[: 1 + next((k for k, x in enumerate(path) if x is body), len(path) - 1)]
    if not names and any(x.noise for x in path):
        return content(root, True)
    least_density, least_total = min(x.density for x in path), min(x.total for x in path)
    best = {}
    for node in reversed(nodes):
        inner = [best[x] for x in _kept(node, names) if x in best and best[x].chars]
        own = [node] if node in (body, root) or node.tag in BLOCK else []
        if own or inner:
            best[node] = max(own + inner, key=lambda x: (x.total, x.chars))
    found, todo = set(), [body]
    while todo:
        node = todo.pop()
        if node.density >= least_density and node in best and best[node].total >= least_total:
            found.add(best[node])
            todo += _kept(node, names)
    return found


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def blocks(root: Node, found: set[Node], names: bool = True) -> list[str]:
    """The texts of the blocks of the subtrees found, in page order; with names less the noise in them."""
    out: list[list[str]] = [[]]
    todo: list[tuple[Node | str | None, bool]] = [(root, False)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            if inside:
                out[-1].append(x)
        elif x.tag in ("br", "wbr"):
            out[-1].append(" " if x.tag == "br" else "")
        elif not (x.hidden or names and x.noise):
            inside = inside or x in found
            if x.tag in BLOCK:
                out.append([])
                todo.append((None, inside))
            todo += [(y, inside) for y in reversed(x.parts)]
    return [" ".join(html.unescape("".join(x)).split()) for x in out]


def main_text(page: str | None, names: bool = True) -> str:
    """The main text of a page; without names as density alone finds it."""
    if not page:
        return ""
    root = parse(page)
    return " ".join(x for x in blocks(root, content(root), names) if x)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(x) for x in text]})

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
