"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements and text leaves. Each node is content (it is, or holds, main text) or not. Node potentials come from a
logistic regression over tag, name hints (class, id, role), length, link share and marks; parent-child potentials from how often labelled
pages show a child state under a parent state, by kind of child. Sum-product messages run upward and downward once; a text leaf whose
marginal is at least one half is main text. The labelled pages are made here by a seeded writer of many page layouts.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("noscript iframe xmp template noembed noframes svg math select object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body br button dd dt head html label legend li option tbody td tfoot th thead tr caption summary".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|</?[a-zA-Z][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_HINT = re.compile(r"""\s(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element (tag) or a text leaf (tag "#text", text set)."""

    __slots__ = ("tag", "hints", "parent", "children", "text", "words", "linked", "label")

    def __init__(self, tag: str, parent: Node | None, hints: tuple[str, ...] = (), text: str = "") -> None:
        self.tag, self.parent, self.hints, self.text = tag, parent, hints, text
        self.children: list[Node] = []
        self.words = self.linked = 0
        self.label: int | None = None
        if parent is not None:
            parent.children.append(self)


@lru_cache(20_000)
def _opened(tag: str) -> tuple[str, tuple[str, ...], bool]:
    """Name, hint words and whether it closes itself, of a start tag."""
    name = _NAME.match(tag).group(1).lower()  # type: ignore[union-attr]
    hints = tuple(dict.fromkeys(w.lower() for m in _HINT.finditer(tag) for w in _PART.findall(m.group(1)) if len(w) > 1))
    return name, hints, name in VOID


class _Ends:
    """Where elements without main text end, by where their start tag ends: at the end tag that matches it, nested ones counted. A start tag
    that no end tag matches has no end: it is passed over alone, so that nothing after it is lost. Each name's tags are looked up once."""

    def __init__(self, page: str) -> None:
        self.page, self.found = page, {}

    def __call__(self, name: str, at: int) -> int | None:
        if name not in self.found:
            ends, open_ = {}, []
            for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", self.page, re.I):
                if m.group(1):
                    if open_:
                        ends[open_.pop()] = m.end()
                elif not m.group(0).endswith("/>"):
                    open_.append(m.end())
            self.found[name] = ends
        return self.found[name].get(at)


def parse(page: str) -> list[Node]:
    """All nodes, parents first, in page order. Bad markup never fails: stray end tags are passed over, open elements end with the page, a
    script, style, text area or title without end tag takes the rest of the page, as in browsers."""
    root = Node("#root", None)
    nodes, top, at, n = [root], root, 0, len(page)
    match, ends, open_ = _TOKEN.match, _Ends(page), Counter()

    def close(to: Node) -> Node:
        """Closes all open elements up to `to` with it; the new innermost one."""
        x = top
        while x is not to:
            open_[x.tag] -= 1
            x = x.parent  # type: ignore[assignment]
        open_[to.tag] -= 1
        return to.parent or root

    while at < n:
        m = match(page, at)
        token, at = m.group(0), m.end()  # type: ignore[union-attr]
        if token[0] != "<" or len(token) == 1:
            if not token.isspace() or top.tag not in ("#root", "html", "head", "table", "tr", "tbody", "ul", "ol"):
                nodes.append(Node("#text", top, (), token))
        elif token[1] == "/":
            name = _NAME.match(token).group(1).lower()  # type: ignore[union-attr]
            if open_[name] > 0:  # else a stray one: no need to look for what it closes
                x = top
                while x.tag != name:
                    x = x.parent  # type: ignore[assignment]
                top = close(x)
        elif token[1] in "!?":
            continue
        else:
            name, hints, void = _opened(token)
            if name in ("html", "body") and any(c.tag == name for c in nodes[:40]):
                continue
            if (name in CLOSES_P or name == "p") and open_["p"] > 0:
                x = top
                while x is not root and x.tag not in ("p", "td", "th", "button", "table", "li", "div", "article", "section"):
                    x = x.parent  # type: ignore[assignment]
                if x.tag == "p":
                    top = close(x)
            elif name in SAME and any(open_[t] > 0 for t in SAME[name]):
                x, to = top, None
                while x is not root and x.tag not in WALLS[name]:
                    if x.tag in SAME[name]:
                        to = x
                    x = x.parent  # type: ignore[assignment]
                if to is not None:
                    top = close(to)
            if name in RAW or name in SKIPPED:
                if name in RAW and not token.endswith("/>"):
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else n
                elif name in SKIPPED:
                    at = ends(name, at) or at
                continue
            node = Node(name, top, hints)
            nodes.append(node)
            if not void and not (token.endswith("/>") and name not in BLOCK):
                top = node
                open_[name] += 1
    return nodes


def measure(nodes: list[Node]) -> None:
    """Words below each node, and how many of them are in links."""
    for x in nodes:
        x.words = x.linked = 0
    for x in reversed(nodes):
        if x.tag == "#text":
            x.words = len(x.text.split())
        elif x.tag == "a":
            x.linked = x.words
        if x.parent is not None:
            x.parent.words += x.words
            x.parent.linked += x.linked


def _bucket(n: int) -> str:
    return "0" if n == 0 else "1" if n < 4 else "4" if n < 10 else "10" if n < 25 else "25" if n < 80 else "80"


def features(x: Node) -> tuple[str, ...]:
    """Names of what holds for a node."""
    if x.tag == "#text":
        p = x.parent
        text = x.text
        tail = text.rstrip()[-1:]
        out = ["leaf", f"in={p.tag if p and p.tag in ('a', 'button', 'label', 'time', 'td', 'pre') else ''}", f"n={_bucket(x.words)}"]
        out.append("stop" if tail and tail in ".!?…:;\"'»”" else "no stop")
        if "©" in text or "&copy" in text or "|" in text or "»" in text:
            out.append("mark")
        return tuple(out)
    share = x.linked / x.words if x.words else 0.0
    out = [f"tag={x.tag}", f"N={_bucket(x.words)}", f"links={0 if share < 0.05 else 1 if share < 0.3 else 2 if share < 0.7 else 3}"]
    out += [f"hint={h}" for h in x.hints]
    return tuple(out)


_OWN = frozenset("p div section ul ol li a table tr td article main blockquote header footer nav aside form br body".split())


#: Elements of which a text has many, as features.
_SMALL = frozenset(f"tag={t}" for t in "p h1 h2 h3 h4 h5 h6 li dd dt td th tr a b strong i em span br pre blockquote".split())


def kind(x: Node) -> str:
    """Kind of child for the parent-child potentials."""
    tag = x.tag
    if tag == "#text":
        return "text" if x.words else "empty"
    if not x.words:
        return "empty"
    return tag if tag in _OWN else "heading" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else "block" if tag in BLOCK else "inline"


class TreeModel:
    """Weights of node features, and log potentials [kind][parent state][child state]."""

    def __init__(self, weights: dict[str, float], bias: float, pair: dict[str, list[list[float]]], scale: dict[str, float]) -> None:
        self.weights, self.bias, self.pair, self.scale = weights, bias, pair, scale
        self._known: dict[tuple[str, ...], float] = {}

    def lean(self, found: tuple[str, ...]) -> float:
        out = self._known.get(found)
        if out is None:
            if len(self._known) > 50_000:
                self._known.clear()
            out = self._known[found] = self.scale["leaf" if found[0] == "leaf" else "small" if found[0] in _SMALL else "holder"] * (self.bias + sum(self.weights.get(f, 0.0) for f in found))
        return out

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node; nodes come parents first, so the reverse order goes upward. Messages are log odds forms of the two-state
        sum-product rule."""
        at = {id(x): i for i, x in enumerate(nodes)}
        n = len(nodes)
        belief = [0.0, *[self.lean(features(x)) for x in nodes[1:]]]  # log odds from the node and the messages of its children
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            x = nodes[i]
            up[i] = self._through(self.pair[kind(x)], belief[i], False)
            belief[at[id(x.parent)]] += up[i]
        for i in range(1, n):
            x = nodes[i]
            belief[i] += self._through(self.pair[kind(x)], belief[at[id(x.parent)]] - up[i], True)
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, b)))) for b in belief]

    @staticmethod
    def _through(t: list[list[float]], odds: float, down: bool) -> float:
        """The log odds that a neighbour sends over an edge: sum over its state, upward (child to parent) or downward."""
        odds = max(-50.0, min(50.0, odds))
        if down:
            one, zero = _add(t[1][1] + odds, t[0][1]), _add(t[1][0] + odds, t[0][0])
        else:
            one, zero = _add(t[1][1] + odds, t[1][0]), _add(t[0][1] + odds, t[0][0])
        return one - zero


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


# Names that page layouts give to their parts.
_PARTS = {
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager tabs toc skip links".split(),
    "head": "header masthead banner topbar logo branding tagline hero".split(),
    "foot": "footer foot colophon copyright legal bottom".split(),
    "side": "sidebar side aside widget related recommended popular trending archive tags".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner outbrain".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe signup disclaimer message".split(),
    "form": "form search login subscribe contact".split(),
    "reader": "comment comments commentlist disqus replies reply discussion respond review reviews feedback".split(),
    "share": "share sharing social buttons follow meta byline author timestamp".split(),
    "main": "content main article post entry story text body page".split(),
}
_OFF = "zzoff"
_SYLLABLES = "ba co du fe gi ho ju ka le mi no pu ra se ti vo wa xe yo zu an er in on st th".split()


def labelled_page(rng: random.Random) -> list[Node]:
    """A made page with the label of every node."""

    def word() -> str:
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 4, b: int = 18) -> str:
        return words(a, b).capitalize() + rng.choice(["."] * 6 + ["!", "?", ""])

    def prose(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def name(part: str) -> str:
        a = rng.choice(_PARTS[part])
        form = rng.choice(["{0}", "{0}", "{0}-{1}", "{1}-{0}", "{0}_{1}", "site-{0}", "{0}-wrapper", "{0}-box"]).format(a, rng.choice(["inner", "list", "area", "block", "item", "container", word()]))
        return f'{rng.choice(["class", "class", "id"])}="{form}"'

    def links(a: int, b: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 4)}</a>' for _ in range(rng.randint(a, b))]
        form = rng.randrange(3)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if form == 0 else rng.choice([" | ", " ", " &middot; "]).join(items) if form == 1 else "".join(f"<div>{x}</div>" for x in items)

    def part(which: str) -> str:
        own = name(which) if rng.random() < 0.8 else ""
        tags = {"menu": ["nav", "nav", "div", "ul"], "head": ["header", "header", "div"], "foot": ["footer", "footer", "div"], "side": ["aside", "aside", "div", "section"], "advert": ["div", "div", "aside", "ins"], "notice": ["div", "div", "section"], "form": ["form"], "reader": ["div", "section", "ol", "section"], "share": ["div", "ul"]}
        tag = rng.choice(tags[which])
        if tag in ("div", "ul", "section", "p", "ol", "ins") and not own:
            own = name(which)
        if which == "menu":
            inner = links(3, 9)
        elif which == "head":
            inner = rng.choice([f"<h1>{words(1, 4)}</h1><p>{sentence(3, 9)}</p>", f'<a href="/">{words(1, 3)}</a>' + links(2, 5), f"<div>{words(1, 4)}</div>", f"<h2>{words(2, 8)}</h2>", prose(1, 3)])
        elif which == "foot":
            inner = rng.choice([f"&copy; {word()}.example &middot; {sentence(2, 14)}", f"<p>© 2020 {words(1, 3)}. {prose(1, 3)}</p>", links(3, 8) + f"<p>{sentence()}</p>", prose(1, 4)])
        elif which == "side":
            inner = rng.choice([f"<h3>{words(1, 3)}</h3>" + links(3, 8), f"<h4>{words(1, 3)}</h4><p>{prose(1, 4)}</p>", "".join(f"<p>{prose(1, 2)}</p>" for _ in range(rng.randint(1, 4))), prose(1, 5)])
        elif which == "reader":
            each = [f'<{"li" if tag == "ol" else "div"} {name("reader") if rng.random() < 0.6 else ""}><{(u := rng.choice(["b", "span", "strong", "cite", "a", "div", "h4", "small"]))}>{words(1, 2)}</{u}><p>{prose(1, 5)}</p></{"li" if tag == "ol" else "div"}>' for _ in range(rng.randint(1, 5))]
            inner = ("" if tag == "ol" else f"<h3>{words(1, 3)}</h3>") * rng.randint(0, 1) + "".join(each)
        elif which == "form":
            inner = f'<label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button>' + rng.choice(["", f"<p>{prose(1, 2)}</p>"])
        elif which == "share":
            inner = rng.choice([links(2, 5), f"<span>{words(1, 3)}</span> <time>{rng.randint(1, 28)} 2020</time>"])
        else:
            inner = rng.choice([prose(1, 4), f"<p>{prose(1, 3)}</p>", f'<a href="/{word()}">{words(2, 6)}</a>', f"<span>{prose(1, 2)}</span>", f"<b>{prose(1, 2)}</b>", f'<p>{sentence()} <a href="#">{words(1, 2)}</a></p>'])
        return f'<{tag} {own} role="{_OFF}">{inner}</{tag}>'

    terse = rng.random() < 0.15

    def paragraph() -> str:
        p = sentence(1, 4) if terse else prose(1, 7) if rng.random() < 0.8 else sentence(2, 12)
        if rng.random() < 0.25:
            p = f'{p} <a href="/{word()}">{words(1, 4)}</a> {prose(1, 2)}'
        if rng.random() < 0.4:
            p = f"<{(t := rng.choice(['b', 'em', 'strong', 'i', 'span']))}>{p}" + (f"</{t}>" if rng.random() < 0.6 else "<br>")
        return f"<p>{p}" + ("</p>" if rng.random() < 0.8 else "")

    body = [rng.choice([f"<h1>{words(2, 9)}</h1>", f"<h1>{sentence()}</h1>", f"<h2>{words(2, 9)}</h2>", ""])]
    for _ in range(rng.choice([8, 15, 30]) if terse else rng.choice([1, 1, 1, 2, 3, 5, 9])):
        body.append(rng.choice([paragraph()] * 8 + [f"<h2>{words(2, 7)}</h2>", f"<h3>{words(1, 6)}</h3>", "<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(3)) + "</ul>", f"<blockquote>{prose(1, 3)}</blockquote>", f"<pre>{words(3, 20)}</pre>", "<table><tr>" + "".join(f"<td>{words(1, 4)}</td>" for _ in range(3)) + "</tr></table>", f"<div>{prose(1, 5)}</div>", f"<figure><figcaption>{sentence()}</figcaption></figure>"]))
        if rng.random() < 0.12:
            body.append(part(rng.choice(["advert", "side", "share", "notice", "form"])))
    if len(body) == 1:
        body.append(rng.choice([paragraph(), prose(1, 6)]))
    if rng.random() < 0.2:
        body.append(part("share"))
    if rng.random() < 0.15:
        body.append(part("reader"))
    inner = "".join(body)
    form = rng.randrange(6)
    main = f"<article>{inner}</article>" if form < 2 else f"<main>{inner}</main>" if form == 2 else f'<div {name("main")}>{inner}</div>' if form < 5 else f'<main><section {name("main")}>{inner}</section></main>'
    if rng.random() < 0.3:
        main = f'<div {name("main")}>{main}</div>'
    before = [part(rng.choice(["menu", "menu", "head", "advert", "notice", "form", "share"])) for _ in range(rng.randint(1, 4))]
    after = [part(rng.choice(["foot", "foot", "side", "reader", "advert", "menu", "notice"])) for _ in range(rng.randint(1, 4))]
    if rng.random() < 0.3:
        main = f'<div class="{rng.choice(["row", "wrapper", "container", "layout"])}">{main}{part("side")}</div>'
    page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"

    nodes, off = parse(page), {}
    for x in nodes:  # the writer's own mark for the parts around the text is taken off again: it is no feature
        off[id(x)] = _OFF in x.hints
        x.hints = tuple(h for h in x.hints if h != _OFF)
    for x in nodes[1:]:
        off[id(x)] = off[id(x)] or off[id(x.parent)]
    for x in reversed(nodes):
        x.label = int(not off[id(x)] and (any(c.label for c in x.children) or (x.tag == "#text" and not x.text.isspace())))
    return nodes


def train(pages: int = 1000, seed: int = 1, steps: int = 300) -> TreeModel:
    """The model of that many made pages: node weights by gradient ascent with a ridge, edge potentials by counting (less what the child's
    own state frequency says, which the node weights already hold)."""
    rng = random.Random(seed)
    rows, ys, edges, alone = [], [], Counter(), Counter()
    for _ in range(pages):
        nodes = labelled_page(rng)
        measure(nodes)
        for x in nodes[1:]:
            rows.append(features(x))
            ys.append(x.label)
            edges[kind(x), x.parent.label, x.label] += 1  # type: ignore[union-attr]
            alone[kind(x), x.label] += 1
    often = Counter(f for r in rows for f in r)
    names = {f: i for i, f in enumerate(sorted(f for f, n in often.items() if n >= 4))}
    row = np.array([i for i, r in enumerate(rows) for f in r if f in names])
    col = np.array([names[f] for r in rows for f in r if f in names])
    y = np.array(ys, float)
    w, b, m, s = np.zeros(len(names)), 0.0, np.zeros(len(names)), np.zeros(len(names))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], len(y)) + b)))
        g = np.bincount(col, (p - y)[row], len(names)) / len(y) + 5e-6 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        b -= 0.5 * (p - y).mean()
    pair = {}
    for k in sorted(_OWN | {"text", "heading", "block", "inline"}):
        usual = [(alone[k, down] + 1) / (alone[k, 0] + alone[k, 1] + 2) for down in (0, 1)]
        pair[k] = [[math.log((edges[k, up, down] + 4 * usual[down]) / (edges[k, up, 0] + edges[k, up, 1] + 4) / usual[down]) for down in (0, 1)] for up in (0, 1)]
    pair["empty"] = [[0.0, 0.0], [0.0, 0.0]]  # nothing to keep or drop
    weights = {f: float(w[i]) for f, i in names.items()}
    # Neighbouring nodes tell much the same, so their potentials are damped by the factors that judge other made pages best.
    trial = [labelled_page(rng) for _ in range(max(1, pages // 5))]
    for nodes in trial:
        measure(nodes)

    def right(scale: dict[str, float]) -> int:
        model, out = TreeModel(weights, b, pair, scale), 0
        for nodes in trial:
            out += sum((p >= 0.5) == bool(x.label) for x, p in zip(nodes, model.marginals(nodes)) if x.tag == "#text" and not x.text.isspace())
        return out

    grid = [{"leaf": x, "small": y, "holder": z} for x in (0.1, 0.4) for y in (0.2, 0.35, 0.5) for z in (2.0, 3.0)]
    return TreeModel(weights, float(b), pair, max(grid, key=right))


def main_text(model: TreeModel, page: str) -> str:
    """Text leaves with a marginal of one half or more; blocks are parted by a blank, white space runs are one blank."""
    nodes = parse(page)
    measure(nodes)
    at = {id(x): p for x, p in zip(nodes, model.marginals(nodes))}
    out: list[str] = []
    todo: list[Node | str] = [nodes[0]]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "#text":
            if at[id(x)] >= 0.5:
                out.append(html.unescape(x.text))
        else:
            block = x.tag in BLOCK
            if block:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.children))
    return " ".join("".join(out).split())


_trained: dict[tuple[int, int], TreeModel] = {}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", made_pages: int = 1000, seed: int = 1) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page, a row for a row.

    Null or empty html gives the empty text; so does a page without main text. Text outside any element, or in a cut-off page, is judged like
    any other. Ids null or repeated pass through. An empty table gives an empty result; other columns are ignored.
    """
    if (made_pages, seed) not in _trained:
        _trained[made_pages, seed] = train(made_pages, seed)
    shared = pages.sparkSession.sparkContext.broadcast(_trained[made_pages, seed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = [main_text(model, t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
