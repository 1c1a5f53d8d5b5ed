"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page is parsed to its elements. Every element that can hold a block of text is a node
with features: text and tags in its subtree and their density, share of text in links,
punctuation, words in its class, id and role, its tag, depth, place among its siblings
and their sizes. Boosted trees give each node the odds of being (or holding) main text.
The tree is then decoded as a whole: a dropped node takes its subtree with it and a kept
node has only kept ancestors, and the assignment with the highest likelihood is chosen
bottom up, so ancestor and descendant never contradict each other.

There are no labels for pages. The model is fitted on a bounded sample (``SAMPLE_PAGES``
pages, chosen by a hash of their address and markup) labelled by the page's own semantic
tags, and on rewritten copies of these pages in which the same article stands in plain
containers among menus, sidebars, notices, forms and comments, so that it does not hang
on the semantic tags.

Null or empty markup gives an empty text. Broken markup is closed as browsers do. Text
that is never shown (script, style, head and so on) is no text. Pages are handled one by
one, so repeated rows give repeated results; nothing is cut short.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import BoostedTrees
from .common import hash_sample, in_slices

SAMPLE_PAGES = 150
#: Markup longer than this is not used for training (it is extracted like any other).
SAMPLE_CHARS = 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTR = re.compile(r"(class|id|role|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_LABEL = "data-main"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style textarea title noscript xmp iframe noembed noframes head template svg math select option button object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_KINDS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "ul", "ol", "menu", "dl", "dt", "dd"}, {"article", "main"}, {"nav"}, {"header"},
    {"footer"}, {"aside"}, {"form", "fieldset", "input", "legend"}, {"div", "section"}, {"table", "tr", "td", "th", "tbody", "thead"},
    {"blockquote", "pre", "figure", "figcaption"}, {"body", "html"},
]
_WORDS = [
    re.compile(x)
    for x in (
        r"nav|menu|breadcrumb|toolbar|pagination|\btabs?\b", r"head(?!line)|banner|masthead|brand|logo|top-?bar", r"foot|copyright|legal",
        r"side|aside|widget|related|recommend|rail|trending|popular", r"\bads?\b|\bad-|-ad\b|advert|promo|sponsor|\bdfp\b|banner-ad",
        r"cookie|notice|consent|alert|gdpr|popup|modal|newsletter|subscri|message", r"comment|repl(y|ies)|disqus|discussion|respon[ds]",
        r"form|search|login|signup|sign-up|contact", r"content|article|post|main|story|entry|text|body|prose", r"share|social|follow|tags?\b|meta|byline|author",
    )
]


class Node:
    __slots__ = ("tag", "attrs", "up", "kids", "label", "depth", "at", "text", "links", "tags", "stops", "paras", "own", "run")

    def __init__(self, tag: str, attrs: str, up: int, depth: int) -> None:
        self.tag, self.attrs, self.up, self.depth = tag, attrs, up, depth
        self.kids, self.label = [], False
        self.text = self.links = self.tags = self.stops = self.paras = self.own = 0
        self.at = 0


def parse(markup: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order (parents first; 0 is the root) and the blocks: (node, text)."""
    nodes, blocks = [Node("html", "", -1, 0)], []
    stack: list[tuple[str, int]] = [("html", 0)]  # open tags with the node they are in
    held: list[str] = []
    links = [0]
    hidden = 0  # open hidden elements
    seen = 0

    def close_block() -> None:
        nonlocal held, seen
        if held:
            text = " ".join("".join(held).split())
            if text:
                node = nodes[stack[-1][1]]
                node.own += len(text)
                node.links += min(links[0], len(text))
                node.stops += sum(text.count(c) for c in ".,;:!?")
                blocks.append((stack[-1][1], text))
                seen += len(text)
            held = []
        links[0] = 0

    def say(raw: str) -> None:
        if raw and not hidden:
            text = html_lib.unescape(raw) if "&" in raw else raw
            held.append(text)
            if any(t == "a" for t, _ in stack[-4:]):
                links[0] += len(text.strip())

    def pop_to(k: int) -> None:
        nonlocal hidden
        if any(t not in INLINE for t, _ in stack[k:]):
            close_block()
        hidden -= sum(t in HIDDEN for t, _ in stack[k:])
        del stack[k:]

    at = 0
    while True:
        m = _TOKEN.search(markup, at)
        if m is None:
            say(markup[at:])
            break
        say(markup[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br" or tag in VOID:
                continue
            if tag in ("html", "body"):
                continue
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if k and not (tag in INLINE and any(t not in INLINE for t, _ in stack[k + 1 :])):
                pop_to(k)
            elif k and tag in INLINE:  # closed across a block: it ends there
                del stack[k]
            continue
        if tag in ("html",):
            continue
        if tag == "body":
            pop_to(1)
        if tag in RAW:  # no text and no block of its own
            end = re.compile(rf"</{tag}\s*>", re.I).search(markup, at)
            at = end.end() if end else len(markup)
            continue
        if tag in _CLOSES_P:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), 0)
            if k and all(t in INLINE for t, _ in stack[k + 1 :]):
                pop_to(k)
        if tag in _SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _SCOPE[tag]:
                    break
                if stack[i][0] in _SAME[tag]:
                    pop_to(i)
                    break
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                close_block()
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            nodes[stack[-1][1]].tags += 1
        else:
            close_block()
            found = [(a.lower(), b or c or d) for a, b, c, d in _ATTR.findall(m[3])] if m[3] else []
            node = Node(tag, " ".join(v for _, v in found).lower(), stack[-1][1], nodes[stack[-1][1]].depth + 1)
            node.label = _LABEL in m[3]
            node.at = seen
            nodes[node.up].kids.append(len(nodes))
            if tag in HIDDEN:
                hidden += 1
            stack.append((tag, len(nodes)))
            nodes.append(node)
    close_block()
    return nodes, blocks


def features(nodes: list[Node], blocks: list[tuple[int, str]]) -> np.ndarray:
    """One row per node. Sums run up the tree first."""
    for n in nodes:
        n.text, n.paras = n.own, int(n.tag == "p" and n.own > 40)
        n.run = 0
    for i in range(len(nodes) - 1, 0, -1):
        n, up = nodes[i], nodes[nodes[i].up]
        up.text += n.text
        up.links += n.links
        up.tags += n.tags + 1
        up.stops += n.stops
        up.paras += n.paras
    total = max(1, nodes[0].text)
    rows, flags = [], []
    for i, n in enumerate(nodes):
        up = nodes[n.up] if n.up >= 0 else n
        own = [1.0 if n.attrs and w.search(n.attrs) else 0.0 for w in _WORDS]
        kind = [1.0 if n.tag in k else 0.0 for k in _KINDS]
        over = flags[n.up] if n.up >= 0 else [0.0] * (len(own) + len(kind))
        flags.append([max(a, b) for a, b in zip(own + kind, over)])
        same = up.kids
        where = n.run
        for k, kid in enumerate(n.kids):
            nodes[kid].run = k
        before = nodes[same[where - 1]].text if n.up >= 0 and where else 0
        after = nodes[same[where + 1]].text if n.up >= 0 and where + 1 < len(same) else 0
        alike = sum(nodes[k].tag == n.tag for k in same[max(0, where - 3) : where + 4]) if n.up >= 0 else 1
        rows.append([
            np.log1p(n.text), np.log1p(n.own), n.links / max(1, n.text), np.log1p(n.tags), n.text / (n.tags + 1.0), n.stops / max(1, n.text),
            np.log1p(n.paras), n.text / total, n.text / max(1, up.text), n.at / total, (n.at + n.text) / total, n.depth, len(n.kids),
            where, len(same), alike, np.log1p(before), np.log1p(after), up.links / max(1, up.text), np.log1p(up.paras), np.log1p(up.text),
            *own, *kind, *over,
        ])
    return np.array(rows)


def decode(nodes: list[Node], margin: np.ndarray) -> np.ndarray:
    """The most likely set of kept nodes in which every kept node's parent is kept."""
    bound = np.clip(margin, -8, 8)
    keep_one, drop_one = -np.log1p(np.exp(-bound)), -np.log1p(np.exp(bound))
    keep, drop = keep_one.copy(), drop_one.copy()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].up
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].up] and keep[i] > drop[i]
    return kept


# ------------------------------------------------------------------------------ training

_BOILER = re.compile("|".join(w.pattern for k, w in enumerate(_WORDS) if k not in (8,)))
_OUT = {"nav", "footer", "aside", "form", "header"}


def weak_labels(nodes: list[Node]) -> np.ndarray:
    """Labels by the page's own tags: text in article or main (or marked), outside menus,
    notices and the like; if there is neither tag, text of plain paragraphs. A node is
    main if it has or holds such text."""
    marked = any(n.label for n in nodes)
    semantic = any(n.tag in ("article", "main") for n in nodes)
    inside, main = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    bad = np.zeros(len(nodes), bool)
    for i, n in enumerate(nodes):
        up = n.up if n.up >= 0 else 0
        start = n.label if marked else n.tag in ("article", "main") if semantic else n.tag in ("p", "h1", "blockquote")
        inside[i] = inside[up] or start
        out = n.tag in _OUT or (n.attrs and _BOILER.search(n.attrs) is not None and not start)
        bad[i] = (bad[up] and not start) or out
        main[i] = inside[i] and not bad[i] and n.own > 0
    for i in range(len(nodes) - 1, 0, -1):
        main[nodes[i].up] |= main[i]
    return main


def rewritten(markup: str, others: list[str]) -> list[str]:
    """Copies of a page with its article in other surroundings, marked for training."""
    m = re.search(r"<(article|main)\b[^>]*>(.*?)</\1>", markup, re.S | re.I)
    if m is None:
        return []
    main = m[2]
    say = [html_lib.escape(t) for t in others] or ["Read more."]
    line = lambda k: say[k % len(say)]
    menu = "".join(f'<li><a href="#">{" ".join(line(k).split()[:2])}</a></li>' for k in range(6))
    notes = "".join(f'<div class="comment"><p class="author">{line(k)[:20]}</p><p>{line(k)} {line(k + 1)}</p></div>' for k in range(3))
    form = f"<form><p>{line(1)}</p><label>{line(2)[:20]}</label><input name=q><button>Go</button></form>"
    side = f"<h3>{line(3)[:30]}</h3><ul>{menu}</ul><p>{line(4)}</p>"
    return [
        f'<html><body><div class="cookie-notice"><p>{line(5)} {line(6)}</p></div><header class="site-header"><div class="logo">{line(0)[:20]}</div><p>{line(7)}</p></header>'
        f'<div class="menu"><ul>{menu}</ul></div><div id="content" class="post-body" {_LABEL}="1">{main}</div><aside class="sidebar">{side}</aside>'
        f'<section id="comments"><h2>{line(2)[:20]}</h2>{notes}</section>{form}<div class="footer"><p>{line(8)}</p></div></body></html>',
        f'<html><body><nav><ul>{menu}</ul></nav><main><div class="promo"><p>{line(3)}</p></div><article {_LABEL}="1">{main}</article><div class="newsletter">{form}</div>'
        f'<div class="comments">{notes}</div></main><footer><p>{line(2)}</p><ul>{menu}</ul></footer></body></html>',
        f'<html><body><table><tr><td><ul>{menu}</ul></td><td {_LABEL}="1">{main}</td><td><p>{line(1)}</p><ul>{menu}</ul></td></tr></table><p><a href="#">{line(0)}</a> | <a href="#">{line(2)[:30]}</a></p></body></html>',
        f'<html><body><div><div><a href="#">{line(0)[:20]}</a> <a href="#">{line(1)[:20]}</a></div><div {_LABEL}="1">{main}</div><div class="related"><h4>{line(2)[:20]}</h4><ul>{menu}</ul></div>'
        f'<div class="alert">{line(4)}</div><div id="respond">{form}</div></div></body></html>',
    ]


def shortened(markup: str, k: int) -> str:
    """A training page whose article is cut to one to three short paragraphs."""
    m = re.search(r"<(article|main)\b[^>]*>(.*?)</\1>", markup, re.S | re.I)
    if m is None:
        return markup
    parts = [p for p in re.split(r"(?=<(?:p|h1|h2)\b)", m[2]) if p.strip()]
    few = [re.sub(r"(>)([^<]{%d})[^<]*" % (20 + 15 * (k % 6)), r"\1\2", p) for p in parts[: 2 + k % 3]]
    return markup[: m.start(2)] + "".join(few) + markup[m.end(2) :]


def fit(samples: list[str]) -> BoostedTrees:
    """A model from a bounded list of page markups."""
    x, y = [], []
    shorts: list[str] = []
    for markup in samples:
        nodes, blocks = parse(markup)
        main = weak_labels(nodes)
        shorts += [t for i, t in blocks if not main[i]][-2:]
        shorts = shorts[-40:]
        brief = shortened(markup, len(x))
        for version in [markup, brief, *rewritten(markup, shorts[::-1]), *rewritten(brief, shorts[::-1])[len(x) % 2 :: 2]]:
            nodes, blocks = parse(version)
            if any(n.own for n in nodes):
                x.append(features(nodes, blocks))
                y.append(weak_labels(nodes))
    if not x or len({bool(v) for part in y for v in part}) < 2:
        x, y = [], []
        for version in rewritten("<article><h1>Title</h1>" + "<p>Some words of a text, and more of them.</p>" * 5 + "</article>", ["A note."]):
            nodes, blocks = parse(version)
            x.append(features(nodes, blocks))
            y.append(weak_labels(nodes))
    return BoostedTrees().fit(np.concatenate(x), np.concatenate(y).astype(float))


def main_text(model: BoostedTrees, markups: list[str | None]) -> list[str]:
    """The main text of each page; nodes of all pages are scored together."""
    pages = [parse(m) if m else None for m in markups]
    rows = [features(*p) for p in pages if p and p[1]]
    scores = model.margin(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p in pages:
        if not p or not p[1]:
            out.append("")
            continue
        nodes, blocks = p
        kept = decode(nodes, scores[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(t for i, t in blocks if kept[i]))
    return out


def extract(pages: DataFrame, html: str = "html", training: DataFrame | None = None, result: str = "text") -> DataFrame:
    """``pages`` without their markup, with the main text and its length in code points."""
    source = pages if training is None else training
    # equal pages count once
    short = source.where(F.length(html).between(1, SAMPLE_CHARS)).select(F.col(html).alias("html"))
    sample = hash_sample(short, F.col("html"), SAMPLE_PAGES).orderBy(F.xxhash64("html"), "html").collect()
    model = fit([r["html"] for r in sample])
    keep = [c for c in pages.columns if c not in (html, result, "n_chars")]
    schema = pages.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, html, 2 << 20):
            texts = main_text(model, batch.column(html).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, result, "n_chars"],
            )

    return pages.select(*keep, html).mapInArrow(run, f"{ddl}{', ' if keep else ''}`{result}` string, n_chars bigint")
