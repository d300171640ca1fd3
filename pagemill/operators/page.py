"""Features of a page in one pass over its tree, for all row-wise operators.

page_features() parses each page once, where it is read, and gives the few strings and arrays that the
cascades of titles, times, languages and links look at. What follows is built-in expressions on one
row, without a shuffle. Only the columns asked for are computed.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dom import CONTENT_STRIP, SITE_STRIP, Node, number, parse, strip

SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
FEATURES = {
    "title": "string",
    "html_lang": "string",
    "xml_lang": "string",
    "content_language": "string",
    "meta_lang": "string",
    "keywords": "string",
    "description": "string",
    "refresh": "string",
    "metas": "array<struct<name:string,property:string,content:string>>",
    "scripts": "array<string>",
    "links": "array<struct<pos:int,href:string,title:string>>",
    "list_text": "string",
    "para_text": "string",
    "body_text": "string",
    "headings": "array<string>",
    "titled": "array<string>",
    "datetime": "string",
    "news_text": "string",
    "content": "string",
    "content_tag": "string",
    "content_pre": "int",
    "content_html": "string",
}
SITE = {"links", "list_text", "para_text", "body_text"}
NEWS = {"headings", "titled", "datetime", "news_text", "content", "content_tag", "content_pre", "content_html"}
KINDS = {
    "string": pa.string(),
    "int": pa.int32(),
    "array<string>": pa.list_(pa.string()),
    FEATURES["metas"]: pa.list_(pa.struct([("name", pa.string()), ("property", pa.string()), ("content", pa.string())])),
    FEATURES["links"]: pa.list_(pa.struct([("pos", pa.int32()), ("href", pa.string()), ("title", pa.string())])),
}


def tidy(s: str) -> str:
    return SPACE.sub(" ", s).strip(" ")


def content_of(node: Node) -> str:
    """Text of a node with a line end after each paragraph; lines trimmed, blank ones dropped."""
    parts: list[str] = []
    stack: list[tuple[Node, bool]] = [(node, False)]
    while stack:
        n, closing = stack.pop()
        if closing:
            parts.append("\n")
        elif n.text is not None:
            parts.append(n.text)
        else:
            if n.tag == "p" and n is not node:
                stack.append((n, True))
            stack.extend((c, False) for c in reversed(n.children))
    return "\n".join(line for line in (tidy(x) for x in "".join(parts).split("\n")) if line)


def markup_of(node: Node) -> str:
    """Paragraphs and images alone."""
    parts: list[str] = []
    stack: list[tuple[Node, bool]] = [(node, False)]
    while stack:
        n, closing = stack.pop()
        if closing:
            parts.append("</p>")
        elif n.text is not None:
            parts.append(n.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        else:
            if n.tag == "img":
                parts.append(f'<img src="{n.attrs.get("src", "")}"/>')
            if n.tag == "p":
                parts.append("<p>")
                stack.append((n, True))
            stack.extend((c, False) for c in reversed(n.children))
    return "".join(parts)


def best_node(body: Node) -> Node | None:
    """The element below body, links apart, with the highest content score: one bottom-up pass."""
    order = body.walk()
    stat: dict[int, tuple] = {}
    best, most = None, 0.0
    for n in reversed(order):
        if n.text is not None:
            size = len(tidy(n.text))
            stat[id(n)] = (size, 0, 0, 0, 0, 1, size * size, 0.0)
            continue
        text = linked = tags = link_tags = p = leaves = squares = 0
        total = 0.0
        for c in n.children:
            a = stat[id(c)]
            text, linked, tags, link_tags, p = text + a[0], linked + a[1], tags + a[2], link_tags + a[3], p + a[4]
            leaves, squares, total = leaves + a[5], squares + a[6], total + a[7]
        tags += 1
        if n.tag == "a":
            linked, link_tags = text, link_tags + 1
        elif n.tag == "p":
            p += 1
        own, rest = text - linked, tags - link_tags
        density = own / rest if own and rest else 0.0
        stat[id(n)] = (text, linked, tags, link_tags, p, leaves, squares, density)
        if n is body or n.tag == "a" or not p:
            continue
        variance = 0.0 if leaves == 0 else text / 2 if leaves == 1 else max(squares / leaves - (text / leaves) ** 2, 0.0)
        score = math.log(math.sqrt(variance + 1)) * total * math.log(own + 1.0) * math.log10(p + 1.0)
        if score > 0 and (score > most or score == most):  # in reverse order: the earlier node of equals
            best, most = n, score
    return best


def features_of(source: str, want: set[str]) -> dict:
    root = parse(source, numbered=False)
    out: dict = {}
    nodes = root.walk()
    metas = [n.attrs for n in nodes if n.tag == "meta"]

    def named(key: str, value: str) -> str | None:
        return next((m.get("content", "") for m in metas if m.get(key, "").lower() == value), None)

    out["title"] = next((n.string() for n in nodes if n.tag == "title"), None)
    out["html_lang"], out["xml_lang"] = root.attrs.get("lang"), root.attrs.get("xml:lang")
    out["content_language"], out["meta_lang"] = named("http-equiv", "content-language"), named("name", "lang")
    out["keywords"], out["description"] = named("name", "keywords"), named("name", "description")
    out["refresh"] = named("http-equiv", "refresh")
    out["metas"] = [{"name": m.get("name"), "property": m.get("property"), "content": m.get("content")} for m in metas]
    if "scripts" in want:
        out["scripts"] = [n.string() for n in nodes if n.tag == "script"]
    if want & (SITE | NEWS):
        strip(root, SITE_STRIP, numbered=False)
        nodes = root.walk()
        body = next((n for n in nodes if n.tag == "body"), root)
        anchors = [n for n in nodes if n.tag == "a"]
        if "links" in want:
            out["links"] = [{"pos": k, "href": n.attrs["href"], "title": n.string()} for k, n in enumerate(anchors) if "href" in n.attrs]
        out["list_text"] = "".join(n.string() for n in anchors[:64]) if len(anchors) >= 16 and "list_text" in want else ""
        if out["list_text"].count("{") >= 5 and out["list_text"].count("}") >= 5:
            out["list_text"] = ""
        if want & {"para_text", "body_text"}:
            out["body_text"] = body.string()
            if "para_text" in want:
                out["para_text"] = "".join(n.string() for n in [n for n in nodes if n.tag == "p"][:64])
                if len(out["para_text"]) < 64:
                    out["para_text"] = out["body_text"]
    if want & NEWS:
        strip(root, CONTENT_STRIP, numbered=False)
        nodes = number(root)
        body = next((n for n in nodes if n.tag == "body"), root)
        inside = body.walk()
        out["headings"] = [tidy(n.string()) for n in inside if n.tag in ("h1", "h2") and n.children]
        marks = [n for n in inside[1:] if n.text is None and any(n.attrs.get(k, "").startswith("title") or n.attrs.get(k, "").endswith("title") for k in ("id", "class"))]
        out["titled"] = [tidy(n.string()) for n in marks]
        out["datetime"] = next((n.attrs.get("datetime", "") for n in nodes if n.tag == "time"), None)
        out["news_text"] = tidy("".join(tidy(n.text) for n in inside if n.text is not None)) if "news_text" in want else None
        best = best_node(body)
        if best is not None:
            out["content"], out["content_tag"], out["content_pre"] = content_of(best), best.tag, best.pre
            out["content_html"] = markup_of(best) if "content_html" in want else None
    return out


def page_features(pages: DataFrame, *names: str, html: str = "html") -> DataFrame:
    """pages without html, with the named features (see FEATURES; all if none is named). A null page has null features."""
    want = [n for n in FEATURES if not names or n in names]
    kept = [f for f in pages.schema.fields if f.name != html and f.name not in want]
    schema = T.StructType([*kept, *[T.StructField(n, T._parse_datatype_string(FEATURES[n])) for n in want]])
    chosen = set(want)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = [features_of(s, chosen) if s is not None else {} for s in part.column(0).to_pylist()]
                arrays = [pa.array([r.get(n) for r in rows], KINDS[FEATURES[n]]) for n in want]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *arrays], names=[f.name for f in schema.fields])

    return pages.select(F.col(html), *[f.name for f in kept]).mapInArrow(run, schema)
