"""HTML extraction by a tree-structured graphical model.

A page becomes its DOM tree. Each node is content or boilerplate, a hidden variable; a parent and a child share a
potential by the child's kind, and each element has evidence: tag group, words in class, id and role, amount of text
and share of link text below it. Sum-product messages go up the tree and down again, which gives the exact marginal of
every node in two sweeps. Text whose marginal is above one half is content. Potentials and evidence are counts over
labelled pages, made here from templates with a fixed seed.
"""

from __future__ import annotations

import math
import random
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from kinsplit.plans.names import column

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/](?![a-zA-Z\[])[^>]*>|<!\[CDATA\[.*?(?:\]\]>|\Z)|<![a-zA-Z][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)>""", re.S)
_OPENS = re.compile(r"<[!?/a-zA-Z]")
DEPTH = 512  # elements below this many open ones are siblings, as in browsers: no page takes more than linear time
# Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset(("br", "td", "th", "img", "option"))
ENDS_P = BLOCK - {"body", "html", "head", "caption", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
GROUPS = {t: g for g, ts in {"navigation": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form button select input label textarea fieldset dialog", "article": "article main", "section": "section", "p": "p pre blockquote", "h": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl", "item": "li dt dd", "a": "a", "table": "table tbody thead tr td th", "root": "html body", "head": "head title meta link"}.items() for t in ts.split()}
_NEGATIVE = re.compile(r"(?:^|[\s\"'=_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|banner|promo|nav|navbar|navigation|menu|sidebar|side|footer|foot|masthead|topbar|comments?|replies|respond|cookies?|consent|notice|alert|related|recommended|share|social|newsletter|subscribe|signup|login|breadcrumbs?|popup|modal|widget|search|pagination|pager|copyright|toolbar|header|contentinfo|complementary|disqus)(?=$|[\s\"'_-]|\d)", re.I)
_POSITIVE = re.compile(r"(?:^|[\s\"'=_-])(?:content|article|post|entry|story|body|main|text|prose)(?=$|[\s\"'_-]|\d)", re.I)
_NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Tree:
    """Nodes in page order; a node's parent comes before it. ``tag`` None: text. ``breaks``: block boundaries before each text."""

    __slots__ = ("tag", "attrs", "parent", "text", "breaks")

    def __init__(self):
        self.tag, self.attrs, self.parent, self.text, self.breaks = ["html"], [""], [-1], [""], [0]

    def add(self, tag, attrs, parent, text, breaks) -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.text.append(text)
        self.breaks.append(breaks)
        return len(self.tag) - 1


def parse(html: str) -> Tree:
    """The tree of a page. Omitted end tags are supplied, unmatched ones ignored, comments and raw elements left out.

    From a tag that never ends, the rest of the page is text.
    """
    t = Tree()
    open_, names = [0], {"html": 1}
    block, at, end = 0, 0, len(html)

    def text(s: str) -> None:
        if s and not (s.isspace() and t.tag[-1] is not None and len(open_) == 1):
            t.add(None, "", open_[-1], unescape(s) if "&" in s else s, block)

    def close(upto: int) -> None:
        nonlocal block
        while len(open_) > upto:
            name = t.tag[open_.pop()]
            names[name] -= 1
            if name in BLOCK:
                block += 1

    def close_named(wanted, stop) -> None:
        for i in range(len(open_) - 1, 0, -1):
            name = t.tag[open_[i]]
            if name in wanted:
                close(i)
                return
            if name in stop:
                return

    while at < end:
        m, look = None, at
        while m is None and (look := html.find("<", look)) >= 0:
            m = _TOKEN.match(html, look)
            if m is None and _OPENS.match(html, look):  # it has no end, and what comes after lies inside it
                break
            look += 1
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "br":
                t.add(None, "", open_[-1], " ", block)
            elif names.get(name) and name not in ("html", "body"):
                close_named((name,), ())
            elif name == "p":
                block += 1
        elif m[2]:
            name, attrs = m[2].lower(), m[3]
            if name in RAW:
                if not attrs.endswith("/") or name not in ("svg", "math"):
                    done = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                    at = done.end() if done else end
                continue
            if name in ("html", "body") and names.get(name):
                continue
            if name in ENDS_P and names.get("p"):
                close_named(("p",), {"td", "th", "button", "article", "section", "div", "li", "table", "blockquote"})
            if name in SIBLINGS:
                wanted, stop = SIBLINGS[name]
                close_named(wanted.split(), stop)
            if name in BLOCK:
                block += 1
            if name in SPACED:
                t.add(None, "", open_[-1], " ", block)
            if name in VOID:
                continue
            node = t.add(name, attrs, open_[-1], "", block)
            if len(open_) < DEPTH:
                open_.append(node)
                names[name] = names.get(name, 0) + 1
    return t


def evidence(t: Tree) -> list[tuple | None]:
    """(tag group, keywords, text bucket, link bucket) of each element, None of texts."""
    n = len(t.tag)
    size, linked = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if t.tag[i] is None:
            size[i] = len(t.text[i].strip())
        elif t.tag[i] == "a":
            linked[i] = size[i]
        size[t.parent[i]] += size[i]
        linked[t.parent[i]] += linked[i]
    out: list[tuple | None] = []
    for i in range(n):
        tag = t.tag[i]
        if tag is None:
            out.append(None)
            continue
        named = " ".join(_NAMED.findall(t.attrs[i])) if t.attrs[i] else ""
        key = 2 if named and _NEGATIVE.search(named) else 1 if named and _POSITIVE.search(named) else 0
        s = size[i]
        out.append((GROUPS.get(tag, "other"), key, 0 if s < 40 else 1 if s < 300 else 2, 0 if not s or linked[i] < 0.3 * s else 1 if linked[i] < 0.7 * s else 2))
    return out


def _kind(tag: str | None) -> int:
    return 0 if tag is None else 2 if tag in BLOCK else 1


class PageModel:
    """Counts of a directed tree model: P(root), P(child | parent, kind of child), P(each evidence | label)."""

    def __init__(self, pages, prior: float = 0.5):
        pair = [[[prior, prior], [prior, prior]] for _ in range(3)]
        seen: list[dict] = [{}, {}, {}, {}]
        total = [4 * prior, 4 * prior]
        for html in pages:
            t = parse(html)
            y = labels_of(t)
            for i, e in enumerate(evidence(t)):
                if i:
                    pair[_kind(t.tag[i])][y[t.parent[i]]][y[i]] += 1
                if e:
                    total[y[i]] += 1
                    for d, v in zip(seen, e):
                        d.setdefault(v, [prior, prior])[y[i]] += 1
        self.step = [[[c / sum(r) for c in r] for r in k] for k in pair]
        self.odds = [{v: math.log(c[1] / total[1]) - math.log(c[0] / total[0]) for v, c in d.items()} for d in seen]

    def marginals(self, t: Tree) -> list[float]:
        """Log-odds of content of every node, by one sweep up and one down."""
        n, exp, log = len(t.tag), math.exp, math.log
        odds = self.odds
        up = [0.0] * n
        for i, e in enumerate(evidence(t)):
            if e:
                up[i] = sum(d.get(v, 0.0) for d, v in zip(odds, e))
        up[0] -= 4.0
        sent = [0.0] * n
        steps = [self.step[_kind(x)] for x in t.tag]
        for i in range(n - 1, 0, -1):
            (a00, a01), (a10, a11) = steps[i]
            b = exp(max(-40.0, min(40.0, up[i])))
            sent[i] = log((a11 * b + a10) / (a01 * b + a00))
            up[t.parent[i]] += sent[i]
        for i in range(1, n):
            (a00, a01), (a10, a11) = steps[i]
            q = exp(max(-40.0, min(40.0, up[t.parent[i]] - sent[i])))
            up[i] += log((a11 * q + a01) / (a10 * q + a00))
        return up


def extract(html: str | None, model: PageModel) -> str:
    """The main text: blocks in page order, white space inside each folded to single spaces, joined by two line feeds."""
    if not html:
        return ""
    t = parse(html)
    odds = model.marginals(t)
    blocks: dict[int, list[str]] = {}
    for i, tag in enumerate(t.tag):
        if tag is None and odds[i] > 0:
            blocks.setdefault(t.breaks[i], []).append(t.text[i])
    return "\n\n".join(s for s in (" ".join("".join(b).split()) for b in blocks.values()) if s)


# ---- labelled pages


def labels_of(t: Tree) -> list[int]:
    """1 below data-y="1", 0 below data-y="0"; a node without the mark is as its parent is."""
    y = [0] * len(t.tag)
    for i in range(1, len(t.tag)):
        mark = re.search(r'data-y="([01])"', t.attrs[i]) if t.attrs[i] else None
        y[i] = int(mark[1]) if mark else y[t.parent[i]]
    return y


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Pages from templates: semantic and plain containers, menus, notices, adverts, forms, comments, short and long articles."""
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice("rano melit dovat sire polin tase gur venol kasi brem ortan lupe".split()) for _ in range(k)) + r.choice([".", "", ".", "?"])
    link = lambda: f'<a href="/x">{some(r.randint(1, 3))}</a>'

    def paragraph() -> str:
        k = r.choice([1, 2, 3, 8, 20, 50, 90])
        inner = some(k)
        if r.random() < 0.2:
            inner = f"<b>{some(4)}</b> {inner}"
        if r.random() < 0.15:
            inner += f" {link()} {some(6)}"
        return r.choice([f"<p>{inner}</p>"] * 5 + [f"<p>{inner}", f"<h2>{some(4)}</h2><p>{inner}</p>", f"<ul><li>{some(6)}</li><li>{some(3)}</li></ul>", f"<blockquote>{inner}</blockquote>", f"<p><b>{inner}<br><p>{some(9)}</p>", f"<div>{inner}</div>"])

    def boiler() -> str:
        k = r.randint(0, 11)
        c = lambda *names: r.choice(names)
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8)))
        return [
            f"<nav><ul>{items}</ul></nav>", f"<ul class=\"{c('menu', 'nav', 'breadcrumb', 'navbar')}\">{items}</ul>",
            f"<div class=\"{c('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo-box')}\">{some(r.choice([3, 9, 30]))}</div>",
            f"<aside>{c('', '<h3>' + some(2) + '</h3>')}<p>{some(r.choice([5, 25]))}</p></aside>", f"<div id=\"{c('sidebar', 'related', 'share', 'social')}\"><ul>{items}</ul><p>{some(8)}</p></div>",
            f"<form action=\"/s\"><label>{some(2)}</label><input name=q><button>{some(1)}</button></form>", f"<div class=\"{c('cookie-notice', 'notice', 'newsletter', 'popup', 'alert')}\"><p>{some(r.choice([6, 20]))}</p></div>",
            f"<section class=\"{c('comments', 'comment-list', 'replies')}\"><h3>{some(1)}</h3>" + "".join(f"<div class=\"comment\"><p>{some(r.choice([4, 15, 60]))}</p></div>" for _ in range(r.randint(1, 4))) + "</section>",
            f"<header><h1>{some(2)}</h1><p>{some(4)}</p></header>", f"<footer>{some(r.choice([4, 12, 30]))} {link()}</footer>", f"<div class=\"{c('footer', 'header', 'topbar')}\">{some(6)}</div>",
            f"<div class=\"login\"><p>{some(5)}</p></div>",
        ][k].replace(">", ' data-y="0">', 1)

    pages = []
    for _ in range(n):
        inside = [f"<h1>{some(5)}</h1>"] * (r.random() < 0.8) + [paragraph() for _ in range(r.choice([1, 1, 2, 3, 6, 12, 25]))]
        if r.random() < 0.25:
            inside.insert(r.randint(1, len(inside)), boiler())
        box = r.choice(["article"] * 5 + ["main", 'div class="content"', 'div id="main-text"', 'div class="post-body"', 'section class="story"', 'div class="entry"'])
        body = "".join(boiler() for _ in range(r.randint(1, 4))) + f'<{box} data-y="1">{"".join(inside)}</{box.split()[0]}>' + "".join(boiler() for _ in range(r.randint(0, 4)))
        if r.random() < 0.3:
            body = f"<div class=\"{r.choice(['page', 'wrapper', 'container'])}\">{body}</div>"
        pages.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{some(4)}</title></head><body>{body}</body></html>")
    return pages


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html gives empty text; pages are read whole, in time linear in their length. Repeated rows all stay,
    with null and large ids as they are. Other columns are not looked at, whatever their names. An empty table gives
    no rows.
    """
    model = PageModel(labelled_pages())

    def run(batches):
        for batch in batches:
            texts = [extract(h, model) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = df.select(column(id_col).cast("long").alias("page_id"), column(url_col).cast("string").alias("url"), column(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
