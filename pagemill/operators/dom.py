"""Pages as relations of nodes: the one place where Python reads HTML.

parse() builds a tree by the main rules of HTML5 tree construction: implied html, head and body,
implied ends of p, li, dt, dd, tr, td and option, void and raw-text elements, and unclosed formatting elements that
are opened again in what follows. Of the adoption agency algorithm only the common case is done: a
formatting end tag inside a block ends the formatting there and leaves the block where it is.
Comments give no nodes. A null page has no nodes.

Everything runs where the page is read (mapInArrow over the scan): a page's tree never leaves its task,
and no shuffle is needed to get at a page's features.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe xmp noframes".split())
RCDATA = frozenset(("title", "textarea"))
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD = frozenset("base link meta title style script noscript template".split())
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template button".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
SITE_STRIP = ("script", "noscript", "style", "iframe", "br", "link", "svg")
CONTENT_STRIP = (*SITE_STRIP, "textarea")


class Node:
    __slots__ = ("tag", "attrs", "text", "parent", "children", "pre", "end", "depth")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str | None = None):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.parent: Node | None = None
        self.children: list[Node] = []

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self) -> list[Node]:
        """This node and all below it in page order, without recursion."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            out.append(n)
            if n.children:
                stack += n.children[::-1]
        return out

    def string(self) -> str:
        if self.text is not None:
            return self.text
        parts, stack = [], self.children[::-1]
        while stack:
            n = stack.pop()
            if n.text is not None:
                parts.append(n.text)
            elif n.children:
                stack += n.children[::-1]
        return "".join(parts)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        value = m.group(2) or m.group(3) or m.group(4) or ""
        out.setdefault(m.group(1).lower(), entities.unescape(value) if "&" in value else value)
    return out


class Builder:
    def __init__(self) -> None:
        self.root = Node("html")
        self.head: Node | None = None
        self.body: Node | None = None
        self.stack: list[Node] = [self.root]
        self.active: list[Node] = []

    def into_body(self) -> None:
        if self.body is None:
            if self.head is None:
                self.head = self.root.add(Node("head"))
            self.body = self.root.add(Node("body"))
            self.stack = [self.root, self.body]

    def reopen(self) -> None:
        """Formatting elements that an enclosing block's end has closed are opened again."""
        if not self.active:
            return
        for k, old in enumerate(self.active):
            if old not in self.stack:
                new = self.stack[-1].add(Node(old.tag, dict(old.attrs)))
                self.stack.append(new)
                self.active[k] = new

    def text(self, s: str) -> None:
        if not s:
            return
        if self.body is None:
            if not s.strip(" \t\n\r\f"):
                return
            self.into_body()
        self.reopen()
        top = self.stack[-1]
        if top.children and top.children[-1].text is not None:
            top.children[-1].text += s
        else:
            top.add(Node("#text", text=s))

    def pop_to(self, names, stop) -> bool:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in names:
                del self.stack[k:]
                return True
            if self.stack[k].tag in stop:
                return False
        return False

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> Node | None:
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return None
        if tag == "head":
            if self.head is None:
                self.head = self.root.add(Node("head", attrs))
                self.stack = [self.root, self.head]
            return None
        if tag == "body":
            if self.body is None:
                self.into_body()
                self.body.attrs = attrs
            return None
        if self.body is None:
            if tag in HEAD:
                if self.head is None:
                    self.head = self.root.add(Node("head"))
                    self.stack = [self.root, self.head]
                return self.head.add(Node(tag, attrs))
            self.into_body()
        if tag in IMPLIED:
            self.pop_to(*IMPLIED[tag])
        if tag in CLOSE_P:
            self.pop_to(("p",), SCOPE)
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and self.stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.stack.pop()
        if tag in FORMAT:
            if tag == "a":
                for old in [n for n in self.active if n.tag == "a"]:
                    self.active.remove(old)
                    if old in self.stack:
                        del self.stack[self.stack.index(old) :]
            self.reopen()
        elif tag not in CLOSE_P and tag not in IMPLIED and tag not in ("tbody", "thead", "tfoot"):
            self.reopen()
        node = self.stack[-1].add(Node(tag, attrs))
        if tag not in VOID and not (closed and tag in ("svg", "path")):
            self.stack.append(node)
            if tag in FORMAT:
                same = [n for n in self.active if n.tag == tag and n.attrs == attrs]
                if len(same) >= 3:
                    self.active.remove(same[0])
                self.active.append(node)
        return node

    def end(self, tag: str) -> None:
        if self.body is None or tag in ("body", "html", "head"):
            if tag == "head" and self.body is None and self.head is not None:
                self.stack = [self.root]
            return
        if tag in FORMAT:
            found = next((n for n in reversed(self.active) if n.tag == tag), None)
            if found is None:
                return
            self.active.remove(found)
            if found in self.stack:
                k = self.stack.index(found)
                if any(n.tag not in FORMAT and n.tag in CLOSE_P for n in self.stack[k + 1 :]):
                    self.stack.remove(found)
                else:
                    del self.stack[k:]
            return
        if tag == "p" and not any(n.tag == "p" for n in self.stack):
            self.start("p", {}, False)
        self.pop_to((tag,), ("table",) if tag not in SCOPE else ("html",))


def parse(page: str, numbered: bool = True) -> Node:
    """The html element of a page, its nodes numbered in page order unless that is left out."""
    b, at = Builder(), 0
    while True:
        m = TOKEN.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            b.text(entities.unescape(chunk) if "&" in chunk else chunk)
        if m is None:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            b.end(tag)
            continue
        raw = m.group(3) or ""
        node = b.start(tag, attributes(raw) if raw.strip(" /") else {}, raw.endswith("/"))
        if tag in RAW or tag in RCDATA:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            inner = page[at : close.start()] if close else page[at:]
            at = close.end() if close else len(page)
            if node is not None:
                if inner:
                    node.add(Node("#text", text=entities.unescape(inner) if tag in RCDATA and "&" in inner else inner))
                if b.stack[-1] is node:
                    b.stack.pop()
    b.into_body()
    if numbered:
        number(b.root)
    return b.root


def number(root: Node) -> list[Node]:
    """pre and end (last descendant's pre) of every node, in page order."""
    order = root.walk()
    for k, n in enumerate(order):
        n.pre, n.end = k, k
        n.depth = 0 if n.parent is None else n.parent.depth + 1
    for n in reversed(order):
        if n.parent is not None:
            n.parent.end = max(n.parent.end, n.end)
    return order


def strip(root: Node, tags: tuple[str, ...], numbered: bool = True) -> Node:
    """Removes all elements of these names with what is in them."""
    names, stack = frozenset(tags), [root]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if c.tag not in names]
        stack += [c for c in n.children if c.children]
    if numbered:
        number(root)
    return root


NODES = "page_id long, pre int, end int, parent int, depth int, tag string, attrs map<string,string>, text string"


def html_nodes(pages: DataFrame, strip_tags: tuple[str, ...] = (), html: str = "html") -> DataFrame:
    """One row per node of every page; text nodes are tagged #text. strip_tags: subtrees left out."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                cols: list[list] = [[] for _ in range(8)]
                part = batch.slice(k, 64)
                for page, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if source is None:
                        continue
                    root = parse(source)
                    if strip_tags:
                        strip(root, strip_tags)
                    for n in root.walk():
                        row = (page, n.pre, n.end, n.parent.pre if n.parent else None, n.depth, n.tag, list(n.attrs.items()), n.text)
                        for c, v in zip(cols, row):
                            c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in NODES.split(", ")])

    return pages.select(F.col("page_id").cast("long"), html).mapInArrow(run, NODES)
