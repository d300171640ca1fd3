"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open
elements above it. A bidirectional LSTM (numpy) reads the blocks of the whole page in order; a block's input is the
mean vector of its path's hashed tags, classes and ids, the mean vector of its hashed words, and a few
measures (length, link share, punctuation, place). Every block is labelled with both directions'
state, so that what stands elsewhere on the page counts. Blocks labelled as article are joined.

train() fits all weights on TRAIN_PAGES generated pages (article bodies of many layouts among menus,
headers, sidebars, notices, adverts, forms, comments and footers); weights/blocks.npz holds the result.

Scripts, styles, head, comments and markup never become blocks. White space in a block becomes one
space; character references are decoded. A quoted value ends at its next quote; where there is none, at the next space or ">".
An unclosed script or style ends the page, other elements without text of their own are then read as any.

A null or empty page gives an empty text, an empty table no rows; repeated rows repeat, so there are no ties; incoming columns but page_id, url
and html are not read. Pages are read whole, however long: they go through the network in batches of at most BATCH padded blocks
(or one page), so memory follows the longest page, and of a path deeper than DEPTH its inner elements count.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WEIGHTS = Path(__file__).with_name("weights") / "blocks.npz"
PATHS, WORDS, PATH_DIM, WORD_DIM, MEASURES, STATE = 1024, 1024, 16, 8, 8, 16
TRAIN_PAGES = 6000
BATCH, DEPTH, PAGES, PAGE_CHARS = 16_384, 64, 256, 4_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "svg", "template", "canvas", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup html ins label legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPE = {"table", "td", "th", "button", "html", "body"}


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def parse(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    open_: Counter[str] = Counter()
    unclosed: set[str] = set()
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not open_["head"]:
                blocks.append(Block(text, tuple(stack[-DEPTH:]), linked))
            parts.clear()
        linked = 0

    def pop(names: set[str], stop: set[str]) -> None:
        if not any(open_[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                flush()
                open_.subtract(n for n, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    def text(s: str) -> None:
        nonlocal linked
        if s:
            s = entities.unescape(s) if "&" in s else s
            parts.append(s)
            if in_link:
                linked += len(s)

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                in_link = False
            elif name in BLOCK:
                flush()
                pop({name}, {"table"} if name not in ("table", "html", "body") and name not in SCOPE else set())
            continue
        if name in RAW and name not in unclosed:
            if name == "svg" and m.group(3).endswith("/"):
                continue
            end = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            if end is not None:
                at = end.start()
                continue
            if name in ("script", "style"):
                break
            unclosed.add(name)
        if name == "a":
            in_link = True
        elif name == "br":
            parts.append(" ")
        elif name == "hr":
            flush()
        elif name in BLOCK:
            flush()
            if name in CLOSES:
                pop(*CLOSES[name])
            if name not in ("option", "button", "label", "ins", "select"):
                pop({"p"}, SCOPE)
            if name[0] == "h" and name[1:].isdigit():
                pop({"h1", "h2", "h3", "h4", "h5", "h6"}, SCOPE | {"div", "section", "article"})
            found = []
            for a in ATTRIBUTE.finditer(m.group(3) or ""):
                found += NAME.findall((a.group(1) or a.group(2) or a.group(3) or "").lower())
            if not (m.group(3) or "").rstrip().endswith("/") or name not in VOID:
                stack.append((name, tuple(found)))
                open_[name] += 1
    flush()
    return blocks


@lru_cache(maxsize=200_000)
def _bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % n


@lru_cache(maxsize=50_000)
def _path(path: tuple) -> tuple[int, ...]:
    tokens = []
    for k, (name, words) in enumerate(path):
        if name not in ("html", "body"):
            tokens.append("t " + name)
        tokens += ["c " + w for w in words]
        if k == len(path) - 1:
            tokens.append("last " + name)
    return tuple(_bucket(t, PATHS) for t in tokens) or (0,)


def inputs(blocks: list[Block]) -> tuple[list[tuple], list[list[int]], np.ndarray]:
    """Path buckets, word buckets and measures of each block."""
    n = len(blocks)
    paths = [_path(b.path) for b in blocks]
    words, measures = [], np.zeros((n, MEASURES), np.float32)
    for k, b in enumerate(blocks):
        own = b.text.split()
        words.append([_bucket(w.lower() if len(w) < 40 else "long", WORDS) for w in own])
        size = len(b.text)
        measures[k] = (
            np.log1p(len(own)) / 4,
            min(1.0, b.linked / size),
            np.log1p(size) / 7,
            sum(b.text.count(c) for c in ".!?;") / len(own),
            b.text[-1] in ".!?:\"”",
            k / n,
            1 / (1 + k),
            1 / (n - k),
        )
    return paths, words, measures


def _means(table: np.ndarray, lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    cut = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(table[flat], cut) / sizes[:, None], flat, sizes, cut


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """States (T, B, H) of one direction; padded steps keep the state. keep: what the backward pass needs."""
    steps, batch, _ = x.shape
    h, c = np.zeros((batch, STATE), x.dtype), np.zeros((batch, STATE), x.dtype)
    out, saved = np.zeros((steps, batch, STATE), x.dtype), []
    z_in = x @ w + b
    for t in range(steps):
        z = z_in[t] + h @ u
        gates = _sigmoid(z)
        i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 3 * STATE :]
        g = np.tanh(z[:, 2 * STATE : 3 * STATE])
        m = mask[t][:, None]
        c2 = m * (f * c + i * g) + (1 - m) * c
        h2 = m * (o * np.tanh(c2)) + (1 - m) * h
        if keep:
            saved.append((h, c, i, f, g, o, c2))
        h, c = h2, c2
        out[t] = h
    return out, saved


def _lstm_back(dout: np.ndarray, x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, saved: list):
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1]), np.zeros_like(x)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, g, o, c2 = saved[t]
        m = mask[t][:, None]
        dh = dh + dout[t]
        live, rest = dh * m, dh * (1 - m)
        tc = np.tanh(c2)
        dcell = dc + live * o * (1 - tc * tc)
        d2 = dcell * m
        dz = np.concatenate([d2 * g * i * (1 - i), d2 * c * f * (1 - f), d2 * i * (1 - g * g), live * tc * o * (1 - o)], axis=1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dx[t] = dz @ w.T
        dh = dz @ u.T + rest
        dc = d2 * f + dcell * (1 - m)
    return dw, du, db, dx


def _flip(sizes: np.ndarray, steps: int) -> np.ndarray:
    """Indices (T, B) that reverse each sequence inside its length; their own inverse."""
    t = np.arange(steps)[:, None]
    return np.where(t < sizes[None, :], sizes[None, :] - 1 - t, t)


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Labeller:
        with np.load(path) as z:
            return cls({k: z[k] for k in z.files})

    def forward(self, pages: list, keep: bool = False):
        """Logits (T, B) for pages given as inputs(); a mask of real blocks."""
        w = self.w
        sizes = np.array([len(p[0]) for p in pages])
        steps = int(sizes.max())
        path, *path_ = _means(w["paths"], [x for p in pages for x in p[0]])
        word, *word_ = _means(w["words"], [x for p in pages for x in p[1]])
        flat = np.concatenate([path, word, np.concatenate([p[2] for p in pages])], axis=1)
        col = np.repeat(np.arange(len(pages)), sizes)
        row = np.concatenate([np.arange(n) for n in sizes])
        x = np.zeros((steps, len(pages), flat.shape[1]), flat.dtype)
        x[row, col] = flat
        mask = np.zeros((steps, len(pages)), flat.dtype)
        mask[row, col] = 1
        flip, b = _flip(sizes, steps), np.arange(len(pages))[None, :]
        xr = x[flip, b]
        fore, sf = _lstm(x, mask, w["wf"], w["uf"], w["bf"], keep)
        back, sb = _lstm(xr, mask, w["wb"], w["ub"], w["bb"], keep)
        state = np.concatenate([fore, back[flip, b], x], axis=2)
        logits = state @ w["wo"] + w["bo"]
        return logits, mask, (x, xr, flip, b, sf, sb, state, row, col, path_, word_)

    def labels(self, pages: list) -> list[np.ndarray]:
        """For each page (inputs()), which of its blocks are article."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < min(len(order), at + 64) and (end + 1 - at) * len(pages[order[end]][0]) <= BATCH:
                end += 1
            some, at = order[at:end], end
            logits, _, _ = self.forward([pages[i] for i in some])
            for c, i in enumerate(some):
                out[i] = logits[: len(pages[i][0]), c] > 0
        return out


def train(pages: list, labels: list[np.ndarray], seed: int = 0, epochs: int = 6, batch: int = 24, rate: float = 0.01) -> Labeller:
    """Adam on the logistic loss of every block, by back-propagation through the whole page."""
    rng = np.random.default_rng(seed)
    d = PATH_DIM + WORD_DIM + MEASURES
    w = {"paths": rng.normal(0, 0.3, (PATHS, PATH_DIM)), "words": rng.normal(0, 0.1, (WORDS, WORD_DIM))}
    for k in "fb":
        w |= {f"w{k}": rng.normal(0, 0.2, (d, 4 * STATE)), f"u{k}": rng.normal(0, 0.2, (STATE, 4 * STATE)), f"b{k}": np.zeros(4 * STATE)}
        w[f"b{k}"][STATE : 2 * STATE] = 1
    w |= {"wo": rng.normal(0, 0.2, 2 * STATE + d), "bo": np.zeros(())}
    net, m1, m2, step = Labeller(w), {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        order = np.concatenate([sorted(order[i : i + 8 * batch], key=lambda j: len(labels[j])) for i in range(0, len(order), 8 * batch)])
        for i in range(0, len(order), batch):
            some = [int(j) for j in order[i : i + batch]]
            logits, mask, (x, xr, flip, b, sf, sb, state, row, col, path_, word_) = net.forward([pages[j] for j in some], True)
            y = np.zeros_like(logits)
            y[row, col] = np.concatenate([labels[j] for j in some])
            dz = (_sigmoid(logits) - y) * mask / mask.sum()
            g = {"wo": np.einsum("tbs,tb->s", state, dz), "bo": dz.sum()}
            ds = dz[:, :, None] * w["wo"]
            g["wf"], g["uf"], g["bf"], dxf = _lstm_back(ds[:, :, :STATE], x, mask, w["wf"], w["uf"], sf)
            g["wb"], g["ub"], g["bb"], dxb = _lstm_back(ds[:, :, STATE : 2 * STATE][flip, b], xr, mask, w["wb"], w["ub"], sb)
            dx = (dxf + dxb[flip, b] + ds[:, :, 2 * STATE :])[row, col]
            for key, (flat, sizes, _), part in (("paths", path_, dx[:, :PATH_DIM]), ("words", word_, dx[:, PATH_DIM : PATH_DIM + WORD_DIM])):
                g[key] = np.zeros_like(w[key])
                np.add.at(g[key], flat, np.repeat(part / sizes[:, None], sizes, axis=0))
            step += 1
            for k in w:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - rate * 0.6**epoch * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net


MARK = ""


def generated(rnd: random.Random) -> str:
    """A page of random layout; article blocks begin with MARK."""
    syll = "the er on an re he in ed nd ha en ou ti es or th sh ea ing tion ble st nt wh ly é è ge ver sch heit ción mente que aux der la de und".split()
    word = lambda: "".join(rnd.choice(syll) for _ in range(rnd.randint(1, 3)))
    noise = rnd.choice(["", "", "", "", "%%%", "&amp;&amp;", "###", "$$$"])
    end = lambda: rnd.choice([".", ".", ".", "?", "!", ",", "", ":"])

    def say(a: int, b: int) -> str:
        w = [word() + (noise if noise and rnd.random() < 0.7 else "") for _ in range(rnd.randint(a, b))]
        for k in range(rnd.randint(6, 14), len(w), rnd.randint(6, 14)):
            w[k - 1] += rnd.choice([".", ",", ".", "."])
        return " ".join(w).capitalize()

    link = lambda a=1, b=3: f'<a href="/{word()}">{say(a, b)}</a>'
    tag = lambda t, c, s: f'<{t}{rnd.choice([f" class={chr(34)}{c}{chr(34)}", f" id={chr(34)}{c}{chr(34)}", f" class={chr(34)}{c} {word()}{chr(34)}"])}>{s}</{t}>'
    items = lambda a, b, t="ul": f"<{t}>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(a, b))) + f"</{t}>"
    any_of = lambda *x: rnd.choice(x)()

    def menu() -> str:
        return any_of(
            lambda: f"<nav>{items(2, 9)}</nav>",
            lambda: tag("div", rnd.choice(["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "main-menu", "site-nav"]), rnd.choice([items(2, 9), " | ".join(link() for _ in range(rnd.randint(2, 6)))])),
            lambda: tag("ul", rnd.choice(["menu", "nav", "tabs", "pagination"]), "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 8)))),
            lambda: f"<nav>{' '.join(link() for _ in range(rnd.randint(2, 6)))}</nav>",
        )

    def head() -> str:
        inner = rnd.choice([f"<h1>{say(1, 4)}</h1>", f"<p>{say(2, 8)}</p>", say(1, 5), link(), f"<h2>{say(2, 5)}</h2><p>{say(3, 9)}.</p>"])
        return rnd.choice([f"<header>{inner}{rnd.choice(['', menu()])}</header>", tag("div", rnd.choice(["header", "masthead", "banner", "site-header", "logo", "top"]), inner)])

    def foot() -> str:
        inner = rnd.choice([f"&copy; {word()}.example.com &middot; {say(4, 14)}.", f"<p>&copy; 20{rnd.randint(10, 30)} {say(1, 6)}. All rights reserved.</p>", items(2, 6), f"<p>{say(3, 30)}.</p>{items(1, 4)}", f"<div>{say(2, 20)}</div>"])
        return rnd.choice([f"<footer>{inner}</footer>", tag("div", rnd.choice(["footer", "site-footer", "bottom", "copyright", "colophon", "legal"]), inner)])

    def side() -> str:
        inner = rnd.choice([f"<h3>{say(1, 3)}</h3>{items(2, 8)}", f"<p>{say(5, 60)}.</p>", f"<h4>{say(1, 4)}</h4><p>{say(5, 40)}.</p><p>{link(2, 6)}</p>", items(3, 8)])
        return rnd.choice([f"<aside>{inner}</aside>", tag(rnd.choice(["div", "section", "aside"]), rnd.choice(["sidebar", "side", "related", "widget", "related-posts", "recommended", "trending", "popular", "share", "social", "tags", "author-box", "toc"]), inner)])

    def notice() -> str:
        inner = rnd.choice([f"<p>{say(5, 40)}.</p>", say(4, 30) + ".", f"<p>{say(6, 20)}. {link()}</p><button>{say(1, 2)}</button>"])
        return tag(rnd.choice(["div", "section", "p", "aside"]), rnd.choice(["notice", "cookie", "cookie-banner", "alert", "consent", "newsletter", "subscribe", "paywall", "popup", "modal", "gdpr", "message", "warning", "disclaimer"]), inner)

    def advert() -> str:
        inner = rnd.choice([say(3, 60) + ".", f"<p>{say(5, 80)}.</p>", link(3, 9), f"<h3>{say(2, 6)}</h3><p>{say(5, 30)}!</p>"])
        return tag(rnd.choice(["div", "ins", "aside", "section", "div"]), rnd.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "adsense", "ad-slot", "banner-ad", "sponsor"]), inner)

    def form() -> str:
        inner = f"<label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button>"
        inner = rnd.choice([inner, f"<p>{say(2, 20)}</p>{inner}", f"<fieldset><legend>{say(1, 4)}</legend>{inner}</fieldset>", f"<select><option>{say(1, 2)}<option>{say(1, 2)}</select>{inner}"])
        return f"<form{rnd.choice(['', ' class=search', ' id=login', ' action=/x'])}>{inner}</form>"

    def comments() -> str:
        kind = rnd.choice(["comment", "comments", "reader-comments", "responses", "discussion", "comment-list", "replies"])
        one = lambda: rnd.choice([f"<p>{say(3, 60)}.</p>", f"<h4>{say(1, 2)}</h4><p>{say(3, 50)}.</p>", f"<li>{say(3, 40)}{end()}</li>", f"<div class={chr(34)}comment{chr(34)}><b>{word()}</b> {say(3, 40)}.</div>"])
        inner = rnd.choice(["", f"<h3>{say(1, 3)}</h3>"]) + "".join(one() for _ in range(rnd.randint(1, 7)))
        return tag(rnd.choice(["div", "section", "ol", "ul", "aside"]), kind, inner)

    junk = lambda: rnd.choice([side, notice, advert, advert, form, menu])()
    close = rnd.random() < 0.8
    repeated = say(1, 6) if rnd.random() < 0.06 else ""  # junk articles say one short thing again and again

    def para() -> str:
        body = MARK + (rnd.choice(["", repeated]) or say(1, 8 if rnd.random() < 0.25 else 120)) + end()
        if rnd.random() < 0.06:
            body = MARK + rnd.choice(["All rights reserved.", f"Copyright {say(1, 5)}.", f"Licensed under {say(1, 5)}.", f"Subscribe {say(1, 9)}.", f"{say(1, 9)} &copy; 20{rnd.randint(10, 30)}"])
        if rnd.random() < 0.25:
            body += f" <b>{say(1, 5)}{rnd.choice(['</b>', '<br>', ''])} {say(1, 20)}{end()}"
        if rnd.random() < 0.2:
            body += f" {link(1, 4)} {say(1, 20)}{end()}"
        return f"<p>{body}" + ("</p>" if close or rnd.random() < 0.7 else "")

    def article() -> str:
        level = rnd.choice(["h1", "h1", "h2"])
        out = [f"<{level}>{MARK}{say(2, 14)}{end()}</{level}>"] if rnd.random() < 0.85 else []
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 12, 18])):
            r = rnd.random()
            if r < 0.8:
                out.append(para())
            elif r < 0.85:
                out.append(f"<h{rnd.randint(2, 4)}>{MARK}{say(1, 7)}</h{rnd.randint(2, 4)}>".replace("</h2>", "").replace("</h3>", "").replace("</h4>", "") if rnd.random() < 0.1 else f"<h3>{MARK}{say(1, 7)}</h3>")
            elif r < 0.89:
                t = rnd.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{MARK}{say(2, 25)}{end()}</li>" for _ in range(rnd.randint(2, 5))) + f"</{t}>")
            elif r < 0.92:
                out.append(f"<blockquote>{rnd.choice([MARK + say(4, 40) + '.', f'<p>{MARK}{say(4, 40)}.</p>'])}</blockquote>")
            elif r < 0.94:
                out.append(f"<pre>{MARK}{say(3, 20)}</pre>")
            elif r < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{say(1, 4)}</td><td>{MARK}{say(1, 6)}</td></tr>" for _ in range(rnd.randint(1, 3))) + "</table>")
            else:
                out.append(junk())
        if rnd.random() < 0.1:
            out.append(comments())
        inner = "".join(out)
        return any_of(
            lambda: f"<article>{inner}</article>",
            lambda: f"<article>{inner}</article>",
            lambda: f"<main>{inner}</main>",
            lambda: f"<main><article>{inner}</article></main>",
            lambda: tag("div", rnd.choice(["content", "post", "entry", "article", "story", "main", "article-body", "post-content", "entry-content", "text", "body"]), inner),
            lambda: f"<div><div>{inner}</div></div>",
            lambda: tag("section", rnd.choice(["content", "article", "story"]), inner),
        )

    some = lambda f, p, n=1: "".join(f() for _ in range(n) if rnd.random() < p)
    before = [some(notice, 0.2), some(head, 0.45), some(menu, 0.8), some(advert, 0.5), some(form, 0.15), some(side, 0.2)]
    after = [some(side, 0.3, 2), some(advert, 0.2), some(comments, 0.3), some(form, 0.15), some(notice, 0.15), some(foot, 0.85)]
    if rnd.random() < 0.2:
        rnd.shuffle(before)
    body = "".join(before) + article() + "".join(after)
    if rnd.random() < 0.15:
        body = tag("div", rnd.choice(["wrapper", "page", "container", "site", "layout"]), body)
    tail = rnd.choice(["</body></html>", "</body></html>", ""])
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{say(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body><!-- x -->{body}{tail}'


def labelled(n: int, seed: int = 0) -> tuple[list, list[np.ndarray]]:
    rnd, pages, labels = random.Random(seed), [], []
    while len(pages) < n:
        blocks = parse(generated(rnd))
        if blocks:
            labels.append(np.array([float(MARK in b.text) for b in blocks]))
            for b in blocks:
                b.text = b.text.replace(MARK, "") or "-"
            pages.append(inputs(blocks))
    return pages, labels


@lru_cache(maxsize=1)
def labeller() -> Labeller:
    return Labeller.load()


def texts(pages: list[str], net: Labeller) -> list[str]:
    """Main text of each page."""
    parsed = [parse(p) for p in pages]
    marks = net.labels([inputs(b) for b in parsed])
    return ["\n".join(b.text for b, k in zip(blocks, keep) if k) for blocks, keep in zip(parsed, marks)]


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches):
        net = labeller()
        for batch in batches:
            size = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).cumsum()
            k = 0
            while k < batch.num_rows:
                upto = int(np.searchsorted(size, (size[k - 1] if k else 0) + PAGE_CHARS, side="right"))
                part = batch.slice(k, min(PAGES, max(1, upto - k)))
                k += part.num_rows
                out = texts([h or "" for h in part.column(2).to_pylist()], net)
                arrays = [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, SCHEMA)


def op9(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


if __name__ == "__main__":
    WEIGHTS.parent.mkdir(exist_ok=True)
    found = train(*labelled(TRAIN_PAGES))
    np.savez_compressed(WEIGHTS, **{k: np.asarray(x, np.float32) for k, x in found.w.items()})
