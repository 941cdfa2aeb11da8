"""Main text of web pages by tag-path ratios.

A page becomes text nodes with their root-to-leaf tag paths, menus and adverts included. Per path, text length outside
links and punctuation are averaged over the path's nodes; both ratios are smoothed along the page and multiplied. The
threshold is a share of the page's spread of the fused ratio, and paths whose mean reaches it are content. Names of
elements don't enter the ratios or the threshold; they lower what a path below elements that seldom hold an article has to
show, so that they settle close cases. The smallest element around the content is the article; its headings, paragraphs,
lists and tables stay, short ones too. Within it go: boxes (div, section and the like) without a content path, and
elements that seldom hold an article whose ratios stay below the threshold.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements whose content isn't markup, that have no end tag, that break the flow of text,
#: and for a start tag the open elements that it closes.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "dl", "article", "section", "div", "td", "body", "main"}
#: Elements whose text isn't shown as such, and elements that seldom hold an article.
SILENT = {"head", "button", "select", "svg", "canvas", "object", "audio", "video"} | RAW
SELDOM = {"nav", "footer", "aside", "menu", "dialog", "label", "form"}
#: Words of class, id and role that an element of little prior starts or ends with.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "menubar", "sidebar", "sidenav", "side", "breadcrumb", "breadcrumbs",
    "footer", "foot", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "skip", "search", "complementary", "contentinfo", "dialog", "form", "hidden", "masthead", "topbar", "outbrain", "taboola",
}
TOP_MARKS = {"header", "head", "top"}
#: First words of names that say what an element has or lacks, not what it is.
ABOUT = {"has", "have", "is", "no", "not", "non", "with", "without", "show", "hide"}
#: The prior: factor of the ratio below an element that seldom holds an article.
LITTLE = 1 / 256
#: What text within links counts for, as a share of its length.
LINKED = 0.1
#: Elements nest this deep at most, as in browsers: of deeper ones the text is read, below the last one that counts.
MOST_DEPTH = 512
RAW_END = {tag: re.compile("</" + tag, re.I) for tag in sorted(RAW)}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)""")
#: Rest of a tag up to its end, quoted values whole.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、؟¿¡]")
#: Share of the spread of the fused ratio that a path must reach, and the half width of the smoothing.
SHARE, WIDTH = 2.0, 2
#: Part of the content's characters that the article element must hold.
COVER = 0.9
#: Elements that are part of an article's text and not the article.
PARTS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr", "blockquote"}
#: Elements that group others without being a kind of text.
BOXES = {"div", "section", "aside", "nav", "header", "footer", "form", "fieldset", "menu", "dialog", "details", "center", "address"}


class _Element:
    __slots__ = ("tag", "path", "prior", "marked", "silent", "inside", "link", "parent", "depth", "holder", "weight", "kept")

    def __init__(self, tag: str, path: int, parent: _Element | None):
        self.tag, self.path, self.parent = tag, path, parent
        self.prior, self.marked, self.silent, self.inside, self.link, self.depth = 1.0, False, False, False, tag == "a", 0
        self.holder: _Element = self
        self.weight, self.kept = 0, True
        if parent is not None:
            self.prior, self.silent, self.inside, self.link = parent.prior, parent.silent, parent.inside, parent.link or tag == "a"
            self.depth = parent.depth + 1
            self.holder = self if tag in BLOCK else parent.holder


def _marks(raw: str) -> tuple[set[str], set[str], bool]:
    """All words of class, id and role; the first and last word of each name, which say what the element is; hidden."""
    words, heads, hidden = set(), set(), False
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role"):
            for one in (a or b or c).split():
                parts = re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower())
                words.update(parts)
                named = [x for x in parts if not x.isdigit()]
                if named and named[0] not in ABOUT:
                    heads |= {named[0], named[-1]}
        elif name == "hidden" or (name == "aria-hidden" and (a or b or c) == "true") or (name == "style" and re.search(r"display\s*:\s*none", a or b or c)):
            hidden = True
    return words, heads, hidden


class _Page:
    """Elements in order of their start, and the text nodes (element, number of the block, text) of a page."""

    def __init__(self, page: str):
        self.paths = Paths()
        self.root = _Element("", 0, None)
        self.elements = [self.root]
        self.nodes: list[tuple[_Element, int, str]] = []
        self._read(page)

    def _open(self, tag: str, raw: str, parent: _Element) -> _Element:
        words, heads, hidden = _marks(raw) if raw else (set(), set(), False)
        name = tag + "".join(f".{w}" for w in sorted(words) if not w.isdigit())
        path = self.paths.number(parent.path, name)
        e = _Element(tag, path, parent)
        e.silent |= hidden or tag in SILENT
        if tag in ("article", "main") and not e.inside:
            e.inside = True
        top = not e.inside and (tag == "header" or (heads & TOP_MARKS and tag not in ("h1", "h2") and not words & {"article", "entry", "post", "content", "story"}))
        if tag not in ("html", "body", "main") and (tag in SELDOM or heads & MARKS or top):
            e.marked, e.prior = True, LITTLE
        self.elements.append(e)
        return e

    def _read(self, page: str) -> None:
        """One pass; what can't be a tag is text. A tag whose quotes never close ends at its first '>'."""
        stack, block, at, quotes, last = [self.root], 0, 0, True, page.rfind(">")
        while at < len(page):
            start = page.find("<", at)
            if start != at:
                start = len(page) if start < 0 else start
                self.nodes.append((stack[-1], block, page[at:start]))
                at = start
                continue
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = len(page) if end < 0 else end + 3
                continue
            m = TAG.match(page, at)
            if at > last or (m is None and page[at + 1 : at + 2] not in ("!", "?", "/")):
                self.nodes.append((stack[-1], block, "<"))
                at += 1
                continue
            if m is None:
                at = page.find(">", at) + 1
                continue
            rest = REST.match(page, m.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else page.find(">", m.end()) + 1
            raw, tag, at = page[m.end() : end - 1], m.group(2).lower(), end
            if m.group(1):
                block += tag in BLOCK
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if tag not in BLOCK and stack[i].tag in BLOCK:
                        break
                continue
            if tag == "br" or tag == "hr":
                self.nodes.append((stack[-1], block, " "))
            if tag in BLOCK:
                block += 1
                shut = {"p"} | CLOSES.get(tag, set())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in shut:
                        del stack[i:]
                        if tag not in CLOSES:
                            break
                    elif i < len(stack) and stack[i].tag in SCOPE:
                        break
            if tag in RAW:
                stop = RAW_END[tag].search(page, at)
                gone = page.find(">", stop.end()) if stop else -1
                at = len(page) if gone < 0 else gone + 1
            elif tag not in VOID and not (raw.endswith("/") and tag not in BLOCK) and len(stack) < MOST_DEPTH:
                stack.append(self._open(tag, raw, stack[-1]))


class Paths:
    """Tag paths as numbers: 0 is the root, and every other one has the path above it."""

    def __init__(self):
        self.above, self.depth = [0], [0]
        self._numbers: dict[tuple[int, str], int] = {}
        self._shared: dict[tuple[int, int], int] = {}

    def number(self, above: int, name: str) -> int:
        path = self._numbers.setdefault((above, name), len(self.above))
        if path == len(self.above):
            self.above.append(above)
            self.depth.append(self.depth[above] + 1)
        return path

    def shared(self, a: int, b: int) -> int:
        """Depth of the deepest path that both begin with."""
        key = (a, b)
        if key not in self._shared:
            while a != b:
                if self.depth[a] >= self.depth[b]:
                    a = self.above[a]
                else:
                    b = self.above[b]
            self._shared[key] = self.depth[a]
        return self._shared[key]


def fused_ratios(nodes: list[tuple[int, str, float]], paths: Paths) -> list[float]:
    """Smoothed ratios of text and of punctuation, multiplied, of (tag path, text, share that counts) nodes in page order.
    Neighbours weigh by the part of their paths that they share below what all paths of the page share."""
    sums: dict[int, list[float]] = {}
    for path, text, share in nodes:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += len(text) * share
        s[1] += len(PUNCTUATION.findall(text)) * share
        s[2] += 1
    long = [sums[p][0] / sums[p][2] for p, _, _ in nodes]
    marks = [(sums[p][1] + 1) / sums[p][2] for p, _, _ in nodes]
    base = min(paths.shared(nodes[0][0], p) for p in sums)
    kernel = [math.exp(-k * k / 2) for k in range(WIDTH + 1)]
    out = []
    for i, (path, _, _) in enumerate(nodes):
        weight = length = points = 0.0
        for j in range(max(0, i - WIDTH), min(len(nodes), i + WIDTH + 1)):
            other = nodes[j][0]
            deep = max(paths.depth[path], paths.depth[other]) - base
            w = kernel[abs(i - j)] * ((paths.shared(path, other) - base) / deep if other != path else 1.0)
            weight, length, points = weight + w, length + w * long[j], points + w * marks[j]
        out.append(length / weight * points / weight)
    return out


def content_paths(nodes: list[tuple[int, str, float, float]], paths: Paths) -> set[int]:
    """The paths that are content, of (tag path, text, share that counts, prior) nodes in page order."""
    if not nodes:
        return set()
    fused = fused_ratios([n[:3] for n in nodes], paths)
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    by: dict[int, list[float]] = {}
    priors: dict[int, float] = {}
    for (p, _, _, prior), x in zip(nodes, fused, strict=True):
        by.setdefault(p, []).append(x)
        priors[p] = min(prior, priors.get(p, 1.0))
    means = {p: sum(x) / len(x) * priors[p] for p, x in by.items()}
    least = min(SHARE * spread, max(means.values()))
    return {p for p, x in means.items() if x >= least}


def main_text(page: str | None) -> str:
    """The page's article: blocks of single-spaced text, joined by two line feeds. Null and empty pages give ''."""
    if not page:
        return ""
    read = _Page(page)
    nodes = [(e, block, html.unescape(text)) for e, block, text in read.nodes if not e.silent]
    shown = [(e, block, text) for e, block, text in nodes if text.strip()]
    good = content_paths([(e.path, text.strip(), LINKED if e.link else 1.0, e.prior) for e, _, text in shown], read.paths)
    chosen = [(e, block, text) for e, block, text in shown if e.path in good]
    for e, _, text in chosen:
        e.holder.weight += len(text)
    for e in reversed(read.elements):
        if e.parent is not None:
            e.parent.weight += e.weight
    article = max((e for e in read.elements if e.weight >= COVER * read.root.weight and e.tag not in PARTS), key=lambda e: e.depth)
    holds = {e for e, _, _ in chosen}  # elements with content below them
    for e in reversed(read.elements):
        if e in holds and e.parent is not None:
            holds.add(e.parent)
    # each element is outside the article, within it, or barred: within it, but below a box without content or a marked one
    place: dict[_Element, str] = {}
    for e in read.elements:
        above = "outside" if e.parent is None else place[e.parent]
        place[e] = "within" if e is article else "barred" if above == "within" and (e.marked or (e.tag in BOXES and e not in holds)) else above
    with_content = {block for _, block, _ in chosen}
    blocks: dict[int, list[str]] = {}
    for e, block, text in nodes:
        if e.path in good or place[e] == "within" or (place[e] == "outside" and block in with_content):
            blocks.setdefault(block, []).append(text)
    found = (" ".join("".join(b).split()) for _, b in sorted(blocks.items()))
    return "\n\n".join(x for x in found if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of all pages. Null and empty html give an empty text; repeated rows, and rows with a
    null page_id, stay; no pages give no rows. Other columns are ignored, whatever their names."""
    rows = pages.select(F.struct("page_id", "url").alias("kept"), "html")
    schema = "kept " + rows.schema["kept"].dataType.simpleString() + ", text string, n_chars long"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = [main_text(h) for h in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["kept", "text", "n_chars"])

    return rows.mapInArrow(apply, schema).select("kept.*", "text", "n_chars")
