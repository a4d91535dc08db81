"""HTML to element records, without a browser.

One pass of a tolerant parser builds a light tree; a walk in document order makes the records. What a node inherits
(footer, list, search list, link) is handed down on that walk, so time grows with the page and not with its depth. What
needs a rendered page is read from attributes and inline styles only: a crawl document that a browser made carries
more, and goes past this module.

Pages are read whole. ``Limits`` can bound what a page gives; ``PARITY`` has the bounds of crawls made by a browser.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.sources.batches import bounded_batches
from pagewarden.sources.crawl import ELEMENT



@dataclass(frozen=True)
class Limits:
    """Characters of a record, records of a page (the telling kinds and the others apart), nodes, links of a record, characters of a page's text; None: all."""

    text: int | None = None
    records: int | None = None
    nodes: int | None = None
    links: int | None = None
    page_text: int | None = None


WHOLE = Limits()
# Limits of a frame, from which length on an element is shown by its own text, tags that hold no content,
# fields of search engines, and how navigation, footers, items, titles and search lists are recognised.
PARITY = Limits(text=500, records=3000, nodes=20000, links=20, page_text=50000)
LONG_TEXT = 1000
SKIPPED = set("script style noscript template meta link br hr option wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PRIORITY = {"hidden", "iframe", "redirect", "meta", "noscript"}
META_FIELDS = set("description keywords og:title og:description og:site_name twitter:title twitter:description subject abstract".split())
NAV_ATTRIBUTES = "data-href data-url data-link data-route data-path routerlink ng-reflect-router-link".split()
NAV_CALL = re.compile(
    r"(?:location(?:\.href)?\s*=\s*|location\.(?:assign|replace)\(\s*|window\.open\(\s*"
    r"|\b(?:navigate|push|goto|go[A-Z_]\w*|go|move\w*|fn\w*|link\w*)\(\s*|path\s*:\s*)['\"`]([^'\"`\s]+)['\"`]"
)
LIKE_URL = re.compile(r"(?i)^(?:https?://|/|\.\.?/)|\.(?:html?|do|jsp|php|aspx?)(?:\?|#|$)|^[\w-]+\?[\w-]+=")
SEARCH_HEAD = re.compile(
    r"인기\s*검색어|최근\s*검색어|실시간\s*검색어|검색어\s*순위|추천\s*검색어|급상승\s*검색어|많이\s*찾(?:는|은)\s*검색어|인기\s*키워드|"
    r"popular\s*(?:search|keyword)|trending\s*search|hot\s*keyword|top\s*searches", re.IGNORECASE,
)
SEARCH_NAME = re.compile(
    r"(?:popular|hot|rank|recent|best|trend)[-_]?(?:keyword|search|word|query)|(?:keyword|search|query)[-_]?(?:rank|popular|hot|recent|best|trend|list)",
    re.IGNORECASE,
)
ITEM_NAME = re.compile(r"post|item|card|article|entry|comment", re.IGNORECASE)
TITLE_NAME = re.compile(r"title|subject", re.IGNORECASE)
SEARCH_LABEL = "검색어 목록"
#: Tags that end an open one of the same kind, up to the tag that keeps them apart.
CLOSES = {"li": {"ul", "ol"}, "p": set(), "option": {"select"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "dt": {"dl"}, "dd": {"dl"}}
BLOCKS = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEAD_TAGS = set("title meta link base style script".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "place", "kinds", "known", "footer", "item", "widget", "in_link")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.kinds: dict[str, int] = {}
        self.known: str | None = None
        self.footer, self.item, self.widget, self.in_link = False, None, None, False
        self.place = 1
        if parent is not None:
            parent.children.append(self)
            self.place = parent.kinds[tag] = parent.kinds.get(tag, 0) + 1

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        stack = self.elements[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements[::-1])

    def own_text(self) -> str:
        return squeezed("".join(c for c in self.children if isinstance(c, str)))

    def text(self, enough: int | None = None) -> str:
        """The text inside; no more is gathered than it takes to have so many characters besides white space."""
        out, stack, held = [], [self], 0
        while stack and (enough is None or held <= enough):
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                held += len(x) - x.count(" ") - x.count("\n")
            else:
                stack.extend(x.children[::-1])
        return "".join(out)

    def ancestors(self):
        node = self
        while node is not None:
            yield node
            node = node.parent


class Builder(HTMLParser):
    """Builds the tree; ``html``, ``head`` and ``body`` are always there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.head, self.body = Node("head", {}, self.root), Node("body", {}, self.root)
        self.at = self.head
        self.open: Counter = Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = {}
        for k, v in attrs:
            named.setdefault(k, v if v is not None else "")
        if tag in ("html", "head", "body"):
            {"html": self.root, "head": self.head, "body": self.body}[tag].attrs.update(named)
            if tag == "body":
                self.leave_to(self.body)
            return
        if self.at is self.head and tag not in HEAD_TAGS and tag != "noscript":
            self.at = self.body
        if tag in CLOSES or tag in BLOCKS:
            self.close_open("p" if tag in BLOCKS else tag, CLOSES.get(tag, set()))
        node = Node(tag, named, self.at)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def leave_to(self, node: Node) -> None:
        """Close what is open below a node that is around the present place, or leave for another."""
        for inner in self.at.ancestors():
            if inner is node or inner.tag in ("html", "head", "body"):
                break
            self.open[inner.tag] -= 1
        self.at = node

    def close_open(self, tag: str, apart: set[str]) -> None:
        if not self.open[tag]:
            return
        for node in self.at.ancestors():
            if node.tag == tag:
                self.leave_to(node.parent)
                return
            if node.tag in apart or node.tag in ("body", "head", "html") or (tag == "p" and node.tag in BLOCKS) or node.tag in ("table", "td"):
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.leave_to(self.body)
        if self.open[tag]:
            for node in self.at.ancestors():
                if node.tag == tag:
                    self.leave_to(node.parent)
                    return

    def handle_data(self, data: str) -> None:
        if self.at is self.head and data.strip():
            self.at = self.body
        self.at.children.append(data)


def parsed(html: str) -> Builder:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder


def squeezed(text: str) -> str:
    return " ".join(text.split())


def style_of(node: Node) -> dict[str, str]:
    pairs = (p.partition(":") for p in node.get("style").lower().split(";"))
    return {k.strip(): v.replace("!important", "").strip() for k, _, v in pairs if k.strip()}


def pixels(value: str) -> float | None:
    m = re.match(r"(-?[\d.]+)\s*(px|pt|em|rem)?$", value)
    try:
        return float(m[1]) * {"pt": 4 / 3, "em": 16, "rem": 16}.get(m[2] or "", 1) if m else None
    except ValueError:
        return None


NAMED_COLOURS = {"white": (255, 255, 255, 1), "black": (0, 0, 0, 1), "transparent": (0, 0, 0, 0), "red": (255, 0, 0, 1), "blue": (0, 0, 255, 1)}


def colour(value: str) -> tuple | None:
    value = value.strip()
    if value in NAMED_COLOURS:
        return NAMED_COLOURS[value]
    if m := re.match(r"#([0-9a-f]{3}|[0-9a-f]{6})$", value):
        digits = m[1] if len(m[1]) == 6 else "".join(2 * d for d in m[1])
        return (*(int(digits[i : i + 2], 16) for i in (0, 2, 4)), 1)
    if m := re.match(r"rgba?\(\s*([\d.]+)[,\s]+([\d.]+)[,\s]+([\d.]+)(?:[,\s/]+([\d.]+)(%?))?", value):
        return (float(m[1]), float(m[2]), float(m[3]), float(m[4] or 1) / (100 if m[5] else 1))
    return None


def background(node: Node | None) -> tuple | None:
    """What is behind a node as far as inline styles tell; None behind an image."""
    for n in node.ancestors() if node else ():
        style = style_of(n)
        if "url(" in style.get("background", "") + style.get("background-image", ""):
            return None
        found = colour(style.get("background-color") or style.get("background", "") or n.get("bgcolor"))
        if found and found[3] > 0.1:
            return found
    return NAMED_COLOURS["white"]


def hidden_reasons(node: Node) -> list[str]:
    """Why a node isn't seen, by its attributes and inline style."""
    if not node.attrs:
        return []
    style, found = style_of(node), []
    none = style.get("display") == "none" or ("hidden" in node.attrs and "display" not in style)
    size = [pixels(style.get(d, "")) if d in style else pixels(node.get(d)) for d in ("width", "height")]
    at = {d: pixels(style.get(d, "")) for d in ("left", "top", "right", "margin-left", "margin-top", "text-indent", "font-size")}
    if none:
        found.append("display:none")
    if style.get("visibility") in ("hidden", "collapse"):
        found.append("visibility:hidden")
    opacity = pixels(style.get("opacity", ""))
    if opacity is not None and opacity <= 0.05:
        found.append("opacity:0")
    if re.search(r"rect\((?:0(?:px)?[,\s]*){4}\)", style.get("clip", "")) or re.search(r"inset\(\s*(?:50|100)%", style.get("clip-path", "")):
        found.append("clip")
    if none:
        return found
    moved = style.get("position") in ("absolute", "fixed")
    if (moved and any((at[d] or 0) <= -500 for d in ("left", "top", "right"))) or any((at[d] or 0) <= -500 for d in ("margin-left", "margin-top")):
        found.append("off-screen")
    if any(s is not None and s <= 1 for s in size) and re.search("hidden|clip", style.get("overflow", "")):
        found.append("zero-size")
    if (at["text-indent"] or 0) <= -999:
        found.append("text-indent")
    if node.own_text():
        if at["font-size"] is not None and at["font-size"] < 2:
            found.append("tiny-font")
        ink = colour(style.get("color", "") or node.get("color"))
        if ink and ink[3] <= 0.05:
            found.append("transparent-text")
        elif ink and (behind := background(node)) and math.dist(ink[:3], behind[:3]) < 20:
            found.append("same-color-as-background")
    return found


class Extractor:
    """The records of one page."""

    def __init__(self, html: str, base: str, limits: Limits = WHOLE):
        self.tree, self.limits = parsed(html), limits
        nodes = list(self.tree.root.walk())
        self.ids = Counter(n.get("id") for n in nodes if n.attrs and n.get("id"))
        href = next((n.get("href") for n in nodes if n.tag == "base" and n.get("href")), "")
        self.base, self.nodes, self.records = self.joined(href, base) if href else base, nodes, []
        self.seen = Counter()
        self.titles: dict[int, str] = {}
        labels = {id(root): label for root, label in self.search_lists()}
        for n in nodes:  # parents come first
            above = n.parent
            n.footer = above.footer or self.is_footer(n)
            n.item = n if n.tag in ("article", "li") or (n.attrs and ITEM_NAME.search(n.get("class"))) else above.item
            n.widget = labels.get(id(n), above.widget)
            n.in_link = above.in_link or (n.tag == "a" and "href" in n.attrs)

    def clipped(self, text: str | None) -> str:
        text, most = squeezed(text or ""), self.limits.text
        return text[:most] + "…" if most is not None and len(text) > most else text

    @staticmethod
    def joined(url: str, base: str) -> str:
        try:
            return urljoin(base, url.strip())
        except ValueError:
            return ""

    def url(self, url: str) -> str:
        return self.joined(url, self.base)

    def selector(self, node: Node) -> str:
        """The path to a node from the nearest one around it that has an id of its own, or from the root."""
        steps: list[str] = []
        for n in node.ancestors():
            if n.known is not None:
                steps.append(n.known)
                break
            own = n.get("id") if n.attrs else ""
            if own and self.ids[own] == 1:
                steps.append("#" + re.sub(r"([^\w-])", r"\\\1", own))
                break
            several = n.parent is not None and n.parent.kinds[n.tag] > 1
            steps.append(f"{n.tag}:nth-of-type({n.place})" if several else n.tag)
        if node.parent is None or len(steps) < 40:
            node.known = " > ".join(steps[::-1])
            return node.known
        return " > ".join(steps[::-1])

    def search_lists(self) -> list[tuple[Node, str]]:
        """Lists of what visitors search for, and their names."""
        found: list[tuple[Node, str]] = []

        def add(node: Node | None, label: str) -> None:
            if node is not None and node.tag not in ("body", "html") and not any(r in node.ancestors() for r, _ in found) and len(found) < 10:
                found.append((node, label))

        def full(node: Node) -> bool:
            return sum(n.tag in ("li", "a") for n in node.walk()) >= 2

        for n in self.tree.body.walk():
            if (n.get("class") or n.get("id")) and SEARCH_NAME.search(f"{n.get('class')} {n.get('id')}") and full(n):
                head = SEARCH_HEAD.search(n.text())
                add(n, squeezed(head[0]) if head else SEARCH_LABEL)
        for n in self.tree.body.walk():
            for text in n.children:
                if isinstance(text, str) and len(text) <= 40 and (head := SEARCH_HEAD.search(text)):
                    add(next((a for a, _ in zip(n.ancestors(), range(4)) if full(a)), None), squeezed(head[0]))
        return found

    def context_title(self, node: Node) -> str:
        """The heading of the nearest list item or article around a node."""
        item = node.item
        for _ in range(4):
            if item is None:
                return ""
            if id(item) not in self.titles:
                head = next((n for n in item.walk() if n.tag in ("h1", "h2", "h3", "h4", "h5") or (n.attrs and TITLE_NAME.search(n.get("class")))), None)
                self.titles[id(item)] = squeezed(head.text())[:80] if head else ""
            if self.titles[id(item)]:
                return self.titles[id(item)]
            item = item.parent.item
        return ""

    @staticmethod
    def is_footer(n: Node) -> bool:
        if n.tag == "footer" or not n.attrs:
            return n.tag == "footer"
        name, cls = n.get("id").lower(), n.get("class").lower()
        return n.get("role") == "contentinfo" or "foot" in name or "footer" in cls or "copyright" in cls

    def put(self, node: Node | None, **record) -> None:
        kind = record["type"] in PRIORITY
        self.seen[kind] += 1
        if self.limits.records is None or self.seen[kind] <= self.limits.records:
            if node is not None:
                record["context_title"] = self.context_title(node)
                record["search_widget"] = node.widget
            self.records.append(record)

    def navigation(self, node: Node) -> tuple[str, str] | None:
        for name in NAV_ATTRIBUTES:
            if (value := node.get(name).strip()) and LIKE_URL.search(value):
                return value, name
        return next(((m[1], "onclick") for m in NAV_CALL.finditer(node.get("onclick")) if LIKE_URL.search(m[1])), None)

    def head_records(self) -> None:
        for n in self.nodes:
            if n.tag == "meta" and n.get("http-equiv").lower() == "refresh":
                self.put(None, type="redirect", selector=self.selector(n), content=self.clipped(n.get("content")))
        for n in self.nodes:
            name = "property" if n.get("property") else "name"
            field, content = n.get(name).lower(), self.clipped(n.get("content"))
            if n.tag == "meta" and field in META_FIELDS and len(content) >= 2:
                self.put(None, type="meta", field=field, selector=f'meta[{name}="{field}"]', content=content)
        for n in self.nodes:
            if n.tag == "noscript":
                content = self.clipped(" ".join(c.text() if isinstance(c, Node) else c for c in n.children))
                links = [u for a in n.walk() if a.tag == "a" and "href" in a.attrs and (u := self.url(a.get("href")))][: self.limits.links]
                if len(content) >= 2 or links:
                    self.put(None, type="noscript", selector=self.selector(n), content=content, links=links)

    def links_inside(self, node: Node) -> list[str]:
        return [self.url(a.get("href")) for a in node.walk() if a.tag in ("a", "area") and "href" in a.attrs][: self.limits.links]

    def run(self) -> list[dict]:
        self.head_records()
        covered: set[int] = set()  # nodes that are hidden, or inside of one
        off: set[int] = set()
        for scanned, n in enumerate(self.tree.body.walk()):
            if self.limits.nodes is not None and scanned >= self.limits.nodes:
                break
            if n.tag in SKIPPED or id(n.parent) in off:
                off.add(id(n))
                continue
            inside = id(n.parent) in covered
            is_link = n.tag in ("a", "area") and "href" in n.attrs
            raw = n.get("href").strip() if is_link else ""
            plain = is_link and raw and not raw.startswith("#") and not raw.lower().startswith("javascript:")
            nav = None if plain else self.navigation(n)
            reasons = [] if inside else hidden_reasons(n)
            unseen = inside or bool(reasons)
            if unseen:
                covered.add(id(n))
            if reasons:
                content, links = self.clipped(n.text(self.limits.text)), ([self.url(raw)] if is_link else []) + self.links_inside(n)
                if content or links or any(x.tag in ("iframe", "img") for x in n.walk()):
                    self.put(n, type="hidden", tag=n.tag, selector=self.selector(n), content=content, hidden_reasons=reasons, links=links)
            if is_link:
                label = n.text(self.limits.text) or n.get("title")
                label = label if label.strip() or inside else next((x.get("alt") for x in n.walk() if x.tag == "img"), "")
                self.put(n, type="link", selector=self.selector(n), href=self.url(raw), raw_href=n.get("href"), content=self.clipped(label),
                         target=n.get("target"), hidden=unseen, footer=n.footer)
            if nav:
                self.put(n, type="link", source=nav[1], selector=self.selector(n), href=self.url(nav[0]), raw_href=nav[0],
                         content=self.clipped(n.text(self.limits.text) or n.get("aria-label") or n.get("title")), target="", hidden=unseen, footer=n.footer)
            if n.tag in ("iframe", "frame"):
                why = ["inside-hidden-element"] if inside else list(reasons)
                sizes = [pixels(style_of(n).get(d, "") or n.get(d)) for d in ("width", "height")]
                if not inside and "display:none" not in reasons and any(s is not None and s <= 2 for s in sizes):
                    why.append("tiny-size")
                self.put(n, type="iframe", selector=self.selector(n), src=self.url(n.get("src")) if n.get("src") else "", raw_src=n.get("src"),
                         content=self.clipped(n.get("title") or n.get("name")), hidden=bool(why), hidden_reasons=why)
            if inside:
                continue
            if n.tag == "img" and not n.in_link:
                alt = self.clipped(n.get("alt") or n.get("title"))
                if len(alt) >= 2 and reasons:
                    self.put(n, type="hidden", tag="img", selector=self.selector(n), content=alt, hidden_reasons=reasons, links=[])
                elif len(alt) >= 2:
                    self.put(n, type="alt", selector=self.selector(n), content=alt, src=self.url(n.get("src")))
            own = n.own_text()
            if not reasons and len(own) >= 2:
                whole = n.text(LONG_TEXT) if 0 < len(n.elements) <= 10 else own
                self.put(n, type="text", tag=n.tag, selector=self.selector(n), content=self.clipped(whole if len(whole) <= LONG_TEXT else own))
        return self.records

    def title(self) -> str:
        return squeezed(next((n.text() for n in self.nodes if n.tag == "title"), ""))

    def page_text(self) -> str:
        """Visible text, a line for each block."""
        out: list[str] = []

        def visit(node: Node) -> None:
            stack: list = [node]
            while stack:
                x = stack.pop()
                if isinstance(x, str):
                    out.append(re.sub(r"\s+", " ", x))
                elif x.tag not in SKIPPED or x.tag == "br":
                    if x is not node and "display:none" in hidden_reasons(x):
                        continue
                    block = x.tag in BLOCKS or x.tag in ("br", "li", "tr")
                    stack.extend((["\n"] if block else []) + x.children[::-1])
                    if block:
                        out.append("\n")

        visit(self.tree.body)
        text = re.sub(r" *\n[ \n]*", "\n", re.sub(r"[ \t]+", " ", "".join(out)))
        return text.strip()[: self.limits.page_text]


def extract(html: str | None, base: str | None, limits: Limits = WHOLE) -> tuple[str, str, list[dict]]:
    """(title, text, records) of a page."""
    page = Extractor(html or "", base or "", limits)
    return page.title(), page.page_text(), page.run()


def source_title(html: Column | str) -> Column:
    """The title as a page's source has it, with single spaces; of its character references those of ``<``, ``>`` and ``&`` are read.

    ``extract`` reads all references as browsers do, also ``&quot;`` and those that end without a semicolon.
    """
    read = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        read = F.replace(read, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(read, "[\\t\\n\\f\\r ]+", " "))


def pages_from_html(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limits: Limits = WHOLE) -> DataFrame:
    """(page_id, url, title, text, elements) of each page; elements as in a crawl document."""
    bounded_batches(pages.sparkSession)
    found = f"page_id long, url string, title string, text string, elements array<{ELEMENT}>"
    schema = pages.sparkSession.createDataFrame([], found).schema
    element = schema["elements"].dataType.elementType
    names = [f.name for f in element.fields]
    default = {"hidden": False, "footer": False, "hidden_reasons": [], "links": [], "frame_path": []}

    def extracted(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["elements"].dataType)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                ids, urls, htmls = (c.to_pylist() for c in batch.slice(k, 64).columns)
                rows = [extract(h, u, limits) for h, u in zip(htmls, urls)]
                records = [[{n: {**default, "frame_url": u, **r}.get(n) for n in names} for r in x[2]] for x, u in zip(rows, urls)]
                columns = [pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in (urls, [x[0] for x in rows], [x[1] for x in rows]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(records, kind)], ["page_id", "url", "title", "text", "elements"])

    return pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(extracted, schema)
