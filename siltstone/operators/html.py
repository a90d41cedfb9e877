"""HTML pages as articles: ordered blocks, images and passages that keep their exact place in the text.

A page is parsed into a tree of open and closed elements, its furniture is taken out, and a walk gives
each piece of text once.  Blocks are packed into passages in the same batch, so that a page's text is
never shuffled.  Pages that can't be read safely get a status instead of blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "header", "main", "nav", "ol", "p", "pre", "section", "table", "ul"} | _HEADS
#: What the start of an element ends, where it is still open, and within what it must be.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_BOUNDS = {"div", "td", "th", "li", "body", "html", "section", "article", "main", "table", "blockquote", "aside"}

#: What is nested deeper lies beside its parent: pages may leave any number of elements open.
_DEPTH = 200

# Labels of related links and of sections, and the section before the first heading.
RELATED = r"^(Pracuj ze źródłami|Opracowanie tematu|Galeria ilustracji|Zobacz też|Rozwiąż quiz)\s*:"
HEADINGS = (r"^[IVXLCDM]+\.\s", r"(?i)^Najważniejsze (?:pojęcia|daty|postaci[e]?)$")
FIRST_SECTION = "Wstęp"


@dataclass(frozen=True)
class PageRule:
    """What an article is made of."""

    body_class: str | None = None  #: the class of the one element that holds the article; without one, the whole body
    drop_tags: tuple[str, ...] = ("script", "style", "nav", "form")
    drop_classes: tuple[str, ...] = ()  #: such as a site's tabs
    related: str = RELATED
    headings: tuple[str, ...] = HEADINGS
    bold_heading: int = 200  #: a paragraph of bold text only, up to so many characters, is a heading
    first_section: str = FIRST_SECTION
    least_text: int = 150
    least_blocks: int = 2
    limit: int = 1300


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict
    parent: Node | None = None
    children: list = field(default_factory=list)
    places: dict | None = None  #: numbers of children, made when first asked for

    def every(self, *tags: str):
        """The elements below of these kinds, in order."""
        for child in self.children:
            if isinstance(child, Node):
                if child.tag in tags or not tags:
                    yield child
                yield from child.every(*tags)

    def text(self) -> str:
        return "".join(child if isinstance(child, str) else child.text() for child in self.children)

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def path(self) -> str:
        """Where it stands: the kinds above it, with its number among those of its kind where there are several."""
        if self.parent is None:
            return ""
        if self.parent.places is None:
            self.parent.places, seen = {}, Counter()
            for c in self.parent.children:
                if isinstance(c, Node):
                    seen[c.tag] += 1
                    self.parent.places[id(c)] = seen[c.tag]
            self.parent.places[""] = seen
        several = self.parent.places[""][self.tag] > 1
        return f"{self.parent.path()}/{self.tag}" + (f"[{self.parent.places[id(self)]}]" if several else "")


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def _end(self, tags: set[str], within: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in within:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._end({"p"}, _BOUNDS)
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag == "br":
            self.open[-1].children.append(" ")
        elif tag not in _VOID and len(self.open) < _DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open[-1].children and isinstance(self.open[-1].children[-1], str):
            self.open[-1].children[-1] += data
        else:
            self.open[-1].children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _clean(text: str) -> str:
    return " ".join(text.split())


def compact(text: str) -> str:
    return re.sub(r"\W+", "", text)


def _furniture(body: Node, rule: PageRule) -> list[Node]:
    """Elements that aren't the article's: by kind or class, paragraphs of related links, and those that only link to a file."""
    found = [n for n in body.every() if n.tag in rule.drop_tags or any(n.has_class(c) for c in rule.drop_classes)]
    for p in body.every("p"):
        text, links = _clean(p.text()), [a for a in p.every("a") if "href" in a.attrs]
        filed = len(links) == 1 and text == _clean(links[0].text()) and urlsplit(links[0].attrs["href"]).path.lower().endswith(".pdf")
        if filed or re.match(rule.related, text, re.I):
            found.append(p)
    return found


def _blocks(body: Node, rule: PageRule) -> list[tuple[str, str, str]]:
    """Kind, text and path of each block, in order: tables by row, items without the items below them, direct text of other elements."""
    out: list[tuple[str, str, str]] = []

    def add(node: Node, text: str, kind: str = "paragraph") -> None:
        text = _clean(text)
        if not text or re.match(rule.related, text, re.I):
            return
        bold = node.tag == "p" and len(text) <= rule.bold_heading and not any(True for _ in node.every("a"))
        if bold:
            bold = _clean("".join(c for b in node.every("strong", "b") for c in b.children if isinstance(c, str))) == text
        if node.tag in _HEADS or bold or any(re.search(h, text) for h in rule.headings):
            kind = "heading"
        out.append((kind, text, node.path()))

    def walk(node: Node) -> None:
        if node.tag == "table":
            for row in node.every("tr"):
                add(row, " | ".join(_clean(c.text()) for c in row.children if isinstance(c, Node) and c.tag in {"th", "td"}), "table_row")
        elif node.tag == "p" or node.tag in _HEADS:
            add(node, node.text())
        elif node.tag == "li":
            below = [c for c in node.children if isinstance(c, Node) and c.tag in {"ul", "ol"}]
            add(node, "".join(c if isinstance(c, str) else c.text() for c in node.children if c not in below))
            for child in below:
                walk(child)
        else:
            for child in node.children:
                add(node, child) if isinstance(child, str) else walk(child)

    walk(body)
    return out


def packed(text: str, blocks: list[dict], limit: int) -> list[tuple[str, int, int]]:
    """Section, start and end of passages: blocks in a row up to the limit, never over a heading or a change of section; longer ones are split.

    A split is after the last sentence end beyond the middle of the limit, else at the last space, else hard.
    """
    out: list[tuple[str, int, int]] = []
    section, start, end = "", None, 0
    for b in blocks:
        lo, hi = b["start"], b["end"]
        if start is not None and (b["kind"] == "heading" or section != b["section"] or hi - start > limit):
            out.append((section, start, end))
            start = None
        if b["kind"] == "heading":
            continue
        section = b["section"]
        while hi - lo > limit:
            step = cut_at(text[lo : lo + limit], limit)
            out.append((section, lo, lo + step))
            lo += step
        start, end = lo if start is None else start, hi
    if start is not None:
        out.append((section, start, end))
    return out


def cut_at(window: str, limit: int) -> int:
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", window)]
    step = ends[-1] if ends and ends[-1] > limit // 2 else window.rfind(" ")
    return step if step > 0 else limit


def article(html: str | None, url: str | None, title: str | None, rule: PageRule = PageRule()) -> dict:
    """status, title, text, blocks, images and passages of one page.

    status: ok; no_body (none, or more than one, of the body's class); empty (published without text or
    pictures); coverage (letters or numbers of the page aren't all in the blocks, in order); short.
    """
    root = tree(html or "")
    bodies = [n for n in root.every("div") if n.has_class(rule.body_class)] if rule.body_class else list(root.every("body"))[:1] or [root]
    out = {"status": "ok", "title": title, "text": None, "blocks": [], "images": [], "passages": []}
    if len(bodies) != 1:
        return out | {"status": "no_body"}
    body = bodies[0]
    if not _clean(body.text()) and not any(True for _ in body.every("img", "iframe", "object")):
        return out | {"status": "empty"}
    for node in _furniture(body, rule):
        node.parent.children = [c for c in node.parent.children if c is not node]
    out["images"] = [{"src": urljoin(url or "", i.attrs.get("src", "")), "alt": i.attrs.get("alt", "")} for i in body.every("img")]
    found = _blocks(body, rule)
    if compact(body.text()) != compact("".join(text for _, text, _ in found)):
        return out | {"status": "coverage"}
    if not found:
        return out | {"status": "empty"}
    if re.match(r"^\d+\.\s*\d+", found[0][1]):
        title = found.pop(0)[1]
    elif title is None or found[0][1] == _clean(title):
        title = found.pop(0)[1]
    at, section, parts = len(title), rule.first_section, [title]
    for kind, text, path in found:
        section = text if kind == "heading" else section
        out["blocks"].append({"kind": kind, "text": text, "path": path, "section": section, "start": at + 2, "end": at + 2 + len(text)})
        parts.append(text)
        at += 2 + len(text)
    out |= {"title": title, "text": "\n\n".join(parts)}
    if at < rule.least_text or len(found) < rule.least_blocks:
        return out | {"status": "short", "blocks": []}
    out["passages"] = [{"section": s, "start": a, "end": b} for s, a, b in packed(out["text"], out["blocks"], rule.limit)]
    return out


_KINDS = pa.struct([("status", pa.string()), ("title", pa.string()), ("text", pa.string()),
    ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("path", pa.string()), ("section", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ("images", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())]))), ("passages", pa.list_(pa.struct([("section", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
_SCHEMA = "page_id long, url string, status string, title string, text string, blocks array<struct<kind:string,text:string,path:string,section:string,start:long,end:long>>, images array<struct<src:string,alt:string>>, passages array<struct<section:string,start:long,end:long>>"


def articles(pages: DataFrame, rule: PageRule = PageRule()) -> DataFrame:
    """A row for each page (page_id, url, html, and title if there is one): page_id, url and what article() gives."""
    title = F.col("title") if "title" in pages.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few pages at once, whatever their size
                some = batch.slice(at, 64)
                made = [article(*row, rule) for row in zip(*(some.column(c).to_pylist() for c in ("html", "url", "title")))]
                columns = pa.array(made, _KINDS).flatten()
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), *columns], ["page_id", "url", *(f.name for f in _KINDS)])

    return pages.select(F.col("page_id").cast("long"), "url", "html", title.alias("title")).mapInArrow(run, _SCHEMA)


def html_blocks(pages: DataFrame, rule: PageRule = PageRule()) -> DataFrame:
    """page_id, pos, kind, text, section, start, end, path."""
    rows = articles(pages, rule).select("page_id", F.posexplode("blocks").alias("pos", "b"))
    return rows.select("page_id", "pos", "b.kind", "b.text", "b.section", "b.start", "b.end", "b.path")


def images(pages: DataFrame, rule: PageRule = PageRule()) -> DataFrame:
    """page_id, src, alt: pictures of the articles, whose content isn't in the text."""
    return articles(pages, rule).select("page_id", F.explode("images").alias("i")).select("page_id", "i.src", "i.alt")


def section_passages(pages: DataFrame, rule: PageRule = PageRule()) -> DataFrame:
    """page_id, ordinal, section, start, end, body, text: body is the article's text from start to end, text puts title and section before it."""
    rows = articles(pages, rule).select("page_id", "title", F.col("text").alias("whole"), F.posexplode("passages").alias("ordinal", "p"))
    body = F.substring("whole", (F.col("p.start") + 1).cast("int"), (F.col("p.end") - F.col("p.start")).cast("int"))
    rows = rows.select("page_id", "ordinal", "p.section", "p.start", "p.end", body.alias("body"), "title")
    return rows.select("page_id", "ordinal", "section", "start", "end", "body", F.concat("title", F.lit(" — "), "section", F.lit("\n"), "body").alias("text"))
