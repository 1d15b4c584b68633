"""Main text of web pages by a tree-structured graphical model.

Block elements of a page form a tree of nodes, each of which is a container of the article, its top, part of it, or boilerplate. A node's
potential comes from its tag, the cues in its class, id and role, and the length, links and ending of its own text; a
parent's and a child's states have a potential too. Sum-product messages, first upward, then downward, give each node's exact
marginals; text whose node is content with a probability over one half is kept. All potentials are estimated from labelled
pages, pairs of html and main text; ``labelled_pages`` makes such pairs from page layouts, and other pairs can be given.

Character references are decoded, white space within a block becomes one blank, blocks are joined by line feeds.

Defined cases: null and empty html gives an empty text; text without any markup is a block of the body; unclosed, stray or torn
tags are taken as browsers do, an unfinished last tag is dropped; ids may be null or repeated; other columns are ignored; an empty
table gives no rows. A page is handled as a whole, in time linear in its length.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------
#: Elements of the flow that are no blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that show no text of the page, or only controls.
SILENT = frozenset("script style noscript template title svg iframe object canvas audio video select button textarea math applet noframes".split())
#: Of these, those whose content is no markup, so that they reach to the end of the page without an end tag.
RAW = frozenset("script style title textarea iframe noframes noscript".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Start tags that end open elements of these kinds, and the elements that this doesn't reach beyond.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
#: Words in class, id and role, and what they point to.
CUES = {
    "article": "article content entry post story main body text maincontent".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "frame": "header footer masthead topbar banner sidebar side aside rail widget copyright colophon contentinfo complementary logo".split(),
    "advert": "ad ads adv advert advertisement adslot sponsor sponsored promo promotion dfp".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay subscribe newsletter paywall hidden".split(),
    "comment": "comment comments reply replies disqus discussion respond reviews".split(),
    "share": "share sharing social related recommended more tags meta byline".split(),
    "form": "form login search signup register contact".split(),
}
# ------------------------------------------------------------------------------------------------------------------
_CUE = {w: kind for kind, words in CUES.items() for w in words}
#: Of several cues the first in this order holds.
_ORDER = ("advert", "comment", "notice", "menu", "form", "share", "frame", "article")

#: Where markup may begin, the name of a tag, and within a tag what ends it or begins a quoted value; a whole tag without quotes.
_START, _NAME, _NEXT = re.compile(r"<(?=[a-zA-Z/!?])"), re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*"), re.compile(r">|=\s*([\"'])")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*)>")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
CONTAINER, TOP, PART, OTHER = range(4)


@dataclass
class Page:
    """Nodes in document order (parents before children), and text runs in page order."""

    tags: list[str]
    cues: list[str]
    parents: list[int]
    runs: list[tuple[int, str, float]]  # node, text, share of its characters in links


def _cue(attrs: str) -> str:
    found = set()
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            found.add("notice")
        elif key in ("class", "id", "role"):
            found.update(_CUE[w] for w in _WORD.findall(value) if w in _CUE)
    return next((k for k in _ORDER if k in found), "none") if found else "none"


def _tag_end(source: str, pos: int) -> int:
    """The place of the > that ends a tag; -1 if none does. Quotes count in values only."""
    while (m := _NEXT.search(source, pos)) is not None:
        if m[1] is None:
            return m.start()
        pos = source.find(m[1], m.end()) + 1
        if not pos:
            break
    return -1


def parse(source: str) -> Page:
    """Nodes and text runs. Each character is looked at a bounded number of times: what has no end ends the page, and open
    elements are found by their names' places on the stack."""
    tags, cues, parents = ["body"], ["none"], [-1]
    runs: list[tuple[int, str, float]] = []
    stack = [0]
    pieces: list[str] = []
    links, anchor, pos, n = 0, 0, 0, len(source)
    endless: set[str] = set()
    places: dict[str, list[int]] = {}  # of each name, where on the stack it is open

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                runs.append((stack[-1], text, min(1.0, links / len(text))))
            pieces.clear()
        links = 0

    def text(s: str) -> None:
        nonlocal links
        if "&" in s:
            s = html.unescape(s)
        pieces.append(s)
        if anchor:
            links += len(s.strip())

    def close(names: tuple[str, ...], within: tuple[str, ...] = ()) -> bool:
        """Closes the innermost open element of these names, and all in it."""
        at = max((places[x][-1] for x in names if places.get(x)), default=0)
        if not at or any(places[x][-1] > at for x in within if places.get(x)):
            return False
        flush()
        for node in stack[at:]:
            places[tags[node]].pop()
        del stack[at:]
        return True

    while pos < n:
        m = _START.search(source, pos)
        if m is None:
            text(source[pos:])
            break
        at = m.end()
        if m.start() > pos:
            text(source[pos : m.start()])
        if plain := _PLAIN.match(source, m.start()):
            closing, name, attrs = plain.groups()
            pos = plain.end()
        elif source.startswith("!--", at):
            end = source.find("-->", at + 1)  # <!--> is a whole comment
            pos = n if end < 0 else end + 3
            continue
        else:
            closing = source[at] == "/"
            name = _NAME.match(source, at + closing)
            if name is None:  # a declaration, or no tag
                end = source.find(">", at)
                pos = n if end < 0 else end + 1
                continue
            end = _tag_end(source, name.end())
            if end < 0:
                break
            name, attrs, pos = name[0], source[name.end() : end], end + 1
        name = name.lower()
        if closing:
            if name == "a":
                anchor = 0
            elif name == "br":
                pieces.append(" ")
            elif name not in INLINE:
                if close((name,)):
                    anchor = 0
            continue
        if name in INLINE:
            if name == "br":
                pieces.append(" ")
            elif name == "a":
                anchor = 1
            continue
        if name in SILENT or name == "head":
            if attrs.endswith("/") and name in ("svg", "math"):
                continue
            end = None if name in endless else re.compile(r"</head\s*>|(?=<body[\s>])" if name == "head" else rf"</{name}\s*>", re.I).search(source, pos)
            if end is None:
                endless.add(name)  # nor is there one further on, which keeps the time linear
            pos = end.end() if end else (n if name in RAW else pos)
            if name not in ("svg", "math", "button", "select"):
                flush()
            continue
        if name in ("html", "body"):
            if name == "body" and len(tags) == 1:
                cues[0] = _cue(attrs)
            continue
        flush()
        if name in ENDS_P:
            close(("p",), ("table", "td", "th"))
        if name in SIBLINGS:
            while close(*SIBLINGS[name]):
                pass
        if name in VOID:
            continue
        tags.append(name)
        cues.append(_cue(attrs) if attrs else "none")
        parents.append(stack[-1])
        places.setdefault(name, []).append(len(stack))
        stack.append(len(tags) - 1)
    flush()
    return Page(tags, cues, parents, runs)


def features(page: Page) -> list[tuple[str, ...]]:
    """Of each node: its cue; its tag with the bins of its own text's links, length and ending."""
    words, chars, linked, ends, sign = ([0] * len(page.tags) for _ in range(5))
    for node, text, share in page.runs:
        words[node] += text.count(" ") + 1
        chars[node] += len(text)
        linked[node] += share * len(text)
        ends[node] = 1 if text[-1] in ".!?:;\"'”»…" else 0
        sign[node] |= "©" in text
    out = []
    for k, tag in enumerate(page.tags):
        w = words[k]
        if not w:
            out.append((f"c:{page.cues[k]}", f"t:{tag}"))
            continue
        length = "1" if w < 4 else "4" if w < 12 else "12" if w < 40 else "40"
        link = "all" if linked[k] > 0.7 * chars[k] else "some" if linked[k] > 0.2 * chars[k] else "few"
        out.append((f"c:{page.cues[k]}", f"t:{tag} {link} {length} {'©' if sign[k] else ends[k]}"))
    return out


TINY = 1e-200


@dataclass(frozen=True)
class TreeModel:
    """Potentials by feature and state (a feature that training didn't show says nothing), and of children's states: container, top or other below a container; part or other below
    the top and below a part. Below what isn't the article's nothing is."""

    emit: dict[str, tuple[float, ...]]
    from_container: tuple[float, float, float]
    from_top: tuple[float, float]
    from_part: tuple[float, float]

    def potential(self, f: tuple[str, ...]) -> tuple[float, ...]:
        a, b, c, d = 1.0, 1.0, 1.0, 1.0
        for x in f:
            p = self.emit.get(x)
            if p is None:
                continue
            a, b, c, d = a * p[0], b * p[1], c * p[2], d * p[3]
        top = max(a, b, c, d)
        return a / top, b / top, c / top, d / top

    def marginals(self, page: Page) -> list[float]:
        """Probability of content (top or part) of each node, by one pass up and one down."""
        known: dict[tuple[str, ...], tuple[float, ...]] = {}
        up: list[list[float]] = []
        for f in features(page):
            if f not in known:
                known[f] = self.potential(f)
            up.append(list(known[f]))
        cc, ct, co = self.from_container
        tp, to = self.from_top
        pp, po = self.from_part
        n, parents = len(up), page.parents
        sent = [(1.0, 1.0, 1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            a, b, c, d = up[k]
            m0, m1, m2, m3 = cc * a + ct * b + co * d, tp * c + to * d, pp * c + po * d, d
            top = max(m0, m1, m2, m3)
            sent[k] = m = max(m0 / top, TINY), max(m1 / top, TINY), max(m2 / top, TINY), max(m3 / top, TINY)
            p = up[parents[k]]
            a, b, c, d = p[0] * m[0], p[1] * m[1], p[2] * m[2], p[3] * m[3]
            top = max(a, b, c, d)
            p[:] = max(a / top, TINY), max(b / top, TINY), max(c / top, TINY), max(d / top, TINY)
        # the body is a container or the top
        belief = [(0.0, 0.0, 0.0, 0.0)] * n
        a, b = up[0][0] * cc, up[0][1] * ct
        belief[0] = a / (a + b), b / (a + b), 0.0, 0.0
        for k in range(1, n):
            q, m, v = belief[parents[k]], sent[k], up[k]
            e0, e1, e2, e3 = q[0] / m[0], q[1] / m[1], q[2] / m[2], q[3] / m[3]
            a, b, c, d = v[0] * e0 * cc, v[1] * e0 * ct, v[2] * (e1 * tp + e2 * pp), v[3] * (e0 * co + e1 * to + e2 * po + e3)
            total = a + b + c + d
            belief[k] = (a / total, b / total, c / total, d / total) if 0 < total < math.inf else (0.0, 0.0, 0.0, 1.0)
        return [x[1] + x[2] for x in belief]

    def extract(self, source: str | None) -> str:
        page = parse(source or "")
        if not page.runs:
            return ""
        p = self.marginals(page)
        return "\n".join(text for node, text, _ in page.runs if p[node] > 0.5)


def labelled_states(page: Page, main: str) -> list[int]:
    """States of the nodes, from the main text: the least node that holds all its lines is the top; what holds lines below is a
    part; what holds the top is a container; everything else is not the article's."""
    lines = Counter(main.split("\n")) if main else Counter()
    n = len(page.tags)
    below = [0] * n
    for node, text, _ in page.runs:
        if lines[text] > 0:
            lines[text] -= 1
            below[node] += 1
    for k in range(n - 1, 0, -1):
        below[page.parents[k]] += below[k]
    if not below[0]:
        return [CONTAINER] + [OTHER] * (n - 1)
    top = max(k for k in range(n) if below[k] == below[0])
    if page.tags[top] in ("p", "h1") and len(page.runs) > 1 and page.parents[top] > 0:
        top = page.parents[top]  # an article of one block
    state = [OTHER] * n
    for k in range(n):
        if k == top:
            state[k] = TOP
        elif below[k]:
            state[k] = PART if k > top else CONTAINER
    return state


def fit(pages: Iterable[tuple[str, str]], smooth: float = 1.0) -> TreeModel:
    """Potentials from pairs of html and main text: shares, smoothed by ``smooth`` nodes that are as all nodes are."""
    emit: dict[str, list[float]] = {}
    states, moves = [0.0] * 4, [[smooth] * 4 for _ in range(4)]
    for source, main in pages:
        page = parse(source)
        state = labelled_states(page, main)
        for k, f in enumerate(features(page)):
            states[state[k]] += 1
            for x in f:
                emit.setdefault(x, [0.0] * 4)[state[k]] += 1
            if k:
                moves[state[page.parents[k]]][state[k]] += 1
    total = sum(states)

    def share(v: list[float]) -> tuple[float, ...]:
        return tuple((v[s] + smooth * sum(v) / total) / (states[s] + smooth) for s in range(4))

    def shares(state: int, *to: int) -> tuple[float, ...]:
        return tuple(moves[state][t] / sum(moves[state][u] for u in to) for t in to)

    return TreeModel(
        {x: share(v) for x, v in emit.items()},
        shares(CONTAINER, CONTAINER, TOP, OTHER),
        shares(TOP, PART, OTHER),
        shares(PART, PART, OTHER),
    )


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, str]]:
    """Pages of varied layout with their main text."""
    r = random.Random(seed)
    syllables = "ba con der est fi gra hol in ka lo men nor pu ra sti to ul ver wi zo".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi)))

    def sentences(k: int) -> str:
        return " ".join(words(1, 14).capitalize() + "." for _ in range(k))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(k)) + "</ul>"

    def box(tag: str, name: str, inner: str) -> str:
        return f'<{tag} {r.choice(["class", "id"])}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def aside() -> str:
        return r.choice([
            lambda: box("div", r.choice(CUES["advert"]), words(2, 12).capitalize() + "."),
            lambda: box("div", r.choice(CUES["share"][:5]), links(3)),
            lambda: box("aside", r.choice(["", "sidebar", "widget"]), f"<h3>{words(1, 3)}</h3>" + r.choice([links(4), f"<p>{sentences(1)}</p>"])),
            lambda: box("form", "", f"<p>{words(2, 6)}</p><input type=text><button>{word()}</button>"),
            lambda: box("div", r.choice(CUES["notice"][:6]), f"<p>{sentences(2)}</p>"),
        ])()

    def article() -> tuple[str, list[str]]:
        out, main = [], []
        title = words(1, 14).capitalize() + r.choice(["", "", ".", "?", ","])
        if r.random() < 0.85:
            head = f"<h1>{title}</h1>"
            out.append(box("header", "", head) if r.random() < 0.15 else head)
            main.append(title)
        for _ in range(r.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9])):
            kind = r.random()
            if kind < 0.72:
                body = sentences(r.choice([1, 1, 2, 4, 8])) if r.random() < 0.9 else words(1, 3)
                if r.random() < 0.3:
                    body = body.rstrip(".") + r.choice(["", ",", "!!", " |", "%%%"])
                shown = body if r.random() < 0.8 else body.replace(" ", " <b>", 1) + ("</b>" if r.random() < 0.5 else "")
                if r.random() < 0.15:
                    shown = f'<a href="/{word()}">{shown.split(" ")[0]}</a>' + shown[len(shown.split(" ")[0]) :]
                out.append(f"<p>{shown}" + ("</p>" if r.random() < 0.7 else "<br>" if r.random() < 0.5 else ""))
                main.append(body)
            elif kind < 0.8:
                out.append(f"<h2>{title}</h2>")
                main.append(title)
            elif kind < 0.88:
                items = [words(2, 9).capitalize() for _ in range(r.randint(2, 5))]
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                main += items
            elif kind < 0.94:
                quote = sentences(2)
                out.append(f"<blockquote><p>{quote}</p></blockquote>")
                main.append(quote)
            else:
                out.append(aside())
        return "".join(out), main

    pages = []
    for _ in range(n):
        inner, main = article()
        name = r.choice(CUES["article"][:6])
        whole = r.choice([
            lambda: f"<article>{inner}</article>", lambda: f"<main><article>{inner}</article></main>", lambda: box("main", "", inner), lambda: box("div", name, inner),
            lambda: f'<div class="wrapper"><div>{box("article", name, inner)}</div></div>', lambda: box("section", name, inner),
        ])()
        before, after = [], []
        if r.random() < 0.5:
            before.append(box("header", r.choice(["", "masthead"]), f'<a href="/">{word()}</a>' + (f"<nav>{links(4)}</nav>" if r.random() < 0.5 else f"<p>{words(2, 5)}</p>")))
        if r.random() < 0.7:
            before.append(box("nav", r.choice(["", "menu"]), links(r.randint(3, 8))) if r.random() < 0.7 else box("div", r.choice(CUES["menu"]), links(5)))
        before += [aside() for _ in range(r.choice([0, 0, 1, 1, 2]))]
        if r.random() < 0.35:
            one = lambda: box(r.choice(["div", "li", "article"]), r.choice(["comment", "reply"]), f"<p>{sentences(r.randint(1, 3))}</p>")
            after.append(box(r.choice(["section", "div"]), r.choice(["comments", "respond"]), f"<h3>{words(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 4)))))
        after += [aside() for _ in range(r.choice([0, 0, 1, 2]))]
        if r.random() < 0.85:
            after.append(box(r.choice(["footer", "footer", "div"]), "footer" if r.random() < 0.5 else "copyright", f"&copy; {word()}.example &middot; {sentences(1)}" if r.random() < 0.7 else f"<p>{words(3, 8)}</p>{links(3)}"))
        pages.append((f"<html><head><title>{word()}</title></head><body>{''.join(before)}{whole}{''.join(after)}</body></html>", "\n".join(main)))
    return pages


_MODEL: list[TreeModel] = []


def default_model() -> TreeModel:
    """Fitted on the driver's side once per process."""
    if not _MODEL:
        _MODEL.append(fit(labelled_pages()))
    return _MODEL[0]


def text_column(source: Column, model: TreeModel | None = None) -> Column:
    model = model or default_model()

    @F.arrow_udf("string")
    def extracted(batch: pa.Array) -> pa.Array:
        return pa.array([model.extract(x) for x in batch.to_pylist()], pa.string())

    return extracted.asNondeterministic()(source)


def query(pages: DataFrame) -> DataFrame:
    out = pages.select("page_id", "url", text_column(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
