"""Main text of web pages by a tree-structured graphical model.

Nodes are a page's block elements and its runs of text. Each is content or not; a node's own potential is linear in what it looks like
(tag, hints in class, id and role, text, links, place), and a potential for each pair of states joins it to its parent. Sum-product
messages, upward and then downward, give exact marginals; whole batches of pages pass them level by level. Weights maximise the
likelihood of labelled pages: pages whose elements carry ``data-content="1"`` or ``"0"``, valid for all they hold.

``labelled_pages`` makes such pages from varied templates; any others may be given instead.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import in_pieces, utf8

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input meta link source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
DROPPED = frozenset("noscript template svg math object select button canvas audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
KEEPS = frozenset("ul ol dl table body html div section article main aside nav".split())
TAGS = ("", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h1", "h2", "list", "li", "table", "quote", "figure", "menu", "other")
KIND = {t: TAGS.index(t) for t in TAGS} | {t: TAGS.index("h2") for t in ("h3", "h4", "h5", "h6")} | {t: TAGS.index("list") for t in ("ul", "ol", "dl")} | {t: TAGS.index("li") for t in ("dt", "dd")}
KIND |= {t: TAGS.index("table") for t in ("thead", "tbody", "tr", "td", "th", "caption")} | {t: TAGS.index("quote") for t in ("blockquote", "pre")} | {"figcaption": TAGS.index("figure"), "fieldset": TAGS.index("form"), "dialog": TAGS.index("other")}
HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs toolbar skip",
    "header": "header masthead banner topbar logo branding",
    "footer": "footer foot copyright colophon legal contentinfo",
    "side": "sidebar side aside rail widget widgets complementary related recommended trending popular more also tags archive",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsbygoogle dfp outbrain taboola affiliate",
    "notice": "notice notices cookie cookies consent gdpr alert warning popup modal overlay dialog paywall announcement message",
    "comment": "comment comments reply replies respond response responses discussion disqus thread reactions feedback reader readers",
    "form": "form login signin signup register subscribe subscription newsletter search contact",
    "share": "share sharing social follow buttons actions",
    "content": "article content post entry story text body main prose copy",
}
HINT_OF = {w: k for k, (_, ws) in enumerate(HINTS.items()) for w in ws.split()}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
WORDS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LABEL = re.compile(r"data-content\s*=\s*\"?([01])")
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*\"?true", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。、，]")


END_OF = {name: re.compile(rf"</{name}[^>]*>", re.I) for name in (*RAW, *DROPPED)}


@dataclass
class Tree:
    parent: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    hint: list[int] = field(default_factory=list)
    hidden: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: int, hint: int, hidden: int, text: str, links: int, label: int) -> int:
        self.parent.append(parent)
        self.level.append(self.level[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.hint.append(hint)
        self.hidden.append(hidden)
        self.texts.append(text)
        self.links.append(links)
        self.label.append(label)
        return len(self.parent) - 1


def _attributes(attrs: str) -> tuple[int, int, int | None]:
    hint = 0
    for groups in WORDS.findall(attrs):
        for piece in PIECE.findall("".join(groups)):
            if (k := HINT_OF.get(piece.lower())) is not None:
                hint |= 1 << k
    found = LABEL.search(attrs)
    return hint, int(bool(HIDDEN.search(attrs))), int(found[1]) if found else None


def parse(page: str) -> Tree:
    """The tree of block elements and text runs, in page order; broken markup is read as a browser would, roughly: open paragraphs and
    list items end where another block begins, stray end tags count for nothing."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("", tree.add(-1, 0, 0, 0, "", 0, 0))]
    pieces: list[str] = []
    linked = in_link = at = skip = 0
    opened: Counter[str] = Counter()  # how often each element is on the stack
    endless: set[str] = set()  # elements that no end tag follows any more

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                tree.add(stack[-1][1], 0, 0, 0, text, min(linked, len(text)), tree.label[stack[-1][1]])
            linked = 0

    def close(depth: int) -> None:
        flush()
        opened.subtract(name for name, _ in stack[depth:])
        del stack[depth:]

    for m in TOKEN.finditer(page):
        begin, end = m.span()
        if begin < skip:
            continue
        if at < begin:
            pieces.append(page[at:begin])
            if in_link:
                linked += len(" ".join(page[at:begin].split()))
        at = end
        name = m[2] or m[5]
        if not name:
            continue
        name, ending, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in RAW or name in DROPPED:
            if not ending and not (attrs.endswith("/") and name in DROPPED):
                gone = None if name in endless else END_OF[name].search(page, end)
                if gone:
                    at = skip = gone.end()
                else:
                    endless.add(name)
                if not gone and name in RAW:
                    at = skip = len(page)
                    break
            pieces.append(" ")
        elif name in INLINE:
            if name == "a":
                in_link = not ending
            elif name == "br":
                pieces.append(" ")
        elif ending:
            if opened[name]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name))
                in_link = 0
            else:
                flush()
        else:
            if stack[-1][0] == "p" or stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6") and name[0] == "h" and name[1:].isdigit():
                close(len(stack) - 1)
            elif name in CLOSES:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] in CLOSES[name] or stack[d][0] in KEEPS), 0)
                if depth and stack[depth][0] in CLOSES[name]:
                    close(depth)
            flush()
            if name not in VOID and name not in ("html", "body", "head"):
                hint, hidden, label = _attributes(attrs) if attrs else (0, 0, None)
                above = stack[-1][1]
                stack.append((name, tree.add(above, KIND.get(name, len(TAGS) - 1), hint, hidden, "", 0, tree.label[above] if label is None else label)))
                opened[name] += 1
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return tree


def _by_level(level: np.ndarray) -> list[np.ndarray]:
    """The nodes of each level, ascending."""
    order = np.argsort(level, kind="stable")
    return np.split(order, np.searchsorted(level[order], np.arange(1, int(level.max(initial=0)) + 1)))


def _features(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents and levels of all nodes of all trees; a parent stands before its children."""
    offset = np.cumsum([0, *(len(t.parent) for t in trees)])
    flat = lambda name: np.array([x for t in trees for x in getattr(t, name)], np.int64)
    own = flat("parent")
    parent = np.where(own >= 0, own + np.repeat(offset[:-1], np.diff(offset)), -1)
    level, tag, hint, hidden, links = (flat(k) for k in ("level", "tag", "hint", "hidden", "links"))
    texts = [x for t in trees for x in t.texts]
    size = np.array([len(x) for x in texts], np.float64)
    marks = np.array([len(PUNCTUATION.findall(x)) if x else 0 for x in texts], np.float64)
    n, top = len(parent), int(level.max(initial=0))
    leaf = size > 0
    by_level = _by_level(level)
    total = np.stack([size, links.astype(np.float64), marks, leaf.astype(np.float64)], axis=1)
    inside = np.zeros((n, len(HINTS) + len(TAGS) + 1), bool)
    inside[np.arange(n), len(HINTS) + tag] = True
    for k in range(len(HINTS)):
        inside[:, k] = hint >> k & 1
    inside[:, -1] = hidden > 0
    mine = inside.copy()
    for k in range(top, 0, -1):
        np.add.at(total, parent[by_level[k]], total[by_level[k]])
    for k in range(1, top + 1):
        inside[by_level[k]] |= inside[parent[by_level[k]]]
    above = np.where((parent >= 0)[:, None], inside[np.maximum(parent, 0)], False)
    full = np.maximum(total[:, 0], 1)
    tags = {t: len(HINTS) + k for k, t in enumerate(TAGS)}
    held = above[:, tags["article"]] | above[:, tags["main"]]
    density = total[:, 1] / full
    marked = np.minimum(total[:, 2] / full * 20, 2)
    extra = np.stack([
        np.ones(n), leaf, np.log1p(total[:, 0]) / 5, density, density > 0.5, marked, total[:, 2] == 0, total[:, 0] < 40, held, held & mine[:, tags["header"]],
        held & mine[:, tags["footer"]], leaf & held, leaf & (total[:, 0] < 40), leaf & (density > 0.5), np.minimum(level, 8) / 8, total[:, 3] == 0, inside[:, -1],
    ], axis=1)
    bad = [k for k, h in enumerate(HINTS) if h != "content"] + [tags[t] for t in ("nav", "footer", "aside", "form", "menu")]
    return np.concatenate([extra, mine, mine[:, bad] * held[:, None], above[:, bad].any(axis=1)[:, None]], axis=1).astype(np.float64), parent, level


def _lse(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x[..., 0], x[..., 1])


def marginals(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state) of each node, and P(state of parent, state of node), by one upward and one downward sweep. unary: log potentials of the
    two states; pair[parent's state, node's state]: log potentials of an edge."""
    by = _by_level(level)
    up, message = unary.copy(), np.zeros_like(unary)
    for nodes in by[:0:-1]:
        message[nodes] = _lse(pair[None] + up[nodes][:, None, :])
        np.add.at(up, parent[nodes], message[nodes])
    down, joint = np.zeros_like(unary), np.zeros((len(unary), 2, 2))
    for nodes in by[1:]:
        p = parent[nodes]
        rest = up[p] + down[p] - message[nodes]
        both = rest[:, :, None] + pair[None]
        down[nodes] = np.logaddexp(both[:, 0], both[:, 1])
        both = both + up[nodes][:, None, :]
        joint[nodes] = np.exp(both - np.logaddexp(np.logaddexp(both[:, 0, 0], both[:, 0, 1]), np.logaddexp(both[:, 1, 0], both[:, 1, 1]))[:, None, None])
    belief = up + down
    return np.exp(belief - _lse(belief)[:, None]), joint


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def content(self, trees: list[Tree]) -> list[np.ndarray]:
        """P(content) of every node, tree by tree."""
        x, parent, level = _features(trees)
        p, _ = marginals(np.stack([np.zeros(len(x)), x @ self.weights], axis=1), self.pair, parent, level)
        return np.split(p[:, 1], np.cumsum([len(t.parent) for t in trees])[:-1])

    def extract(self, pages: list[str]) -> list[str]:
        trees = [parse(p) for p in pages]
        return ["\n".join(t.texts[i] for i in range(len(t.texts)) if t.texts[i] and p[i] >= 0.5) for t, p in zip(trees, self.content(trees), strict=True)]


def train(pages: list[str], steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """The model under which the labels of the pages are likeliest; Adam on the exact gradient."""
    trees = [parse(p) for p in pages]
    x, parent, level = _features(trees)
    y = np.array([v for t in trees for v in t.label], np.int64)
    child = np.flatnonzero(parent >= 0)
    seen = np.bincount(y[parent[child]] * 2 + y[child], minlength=4).reshape(2, 2)
    w, n = np.zeros(x.shape[1] + 4), len(x)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p, joint = marginals(np.stack([np.zeros(n), x @ w[:-4]], axis=1), w[-4:].reshape(2, 2), parent, level)
        grad = np.concatenate([x.T @ (p[:, 1] - y), (joint.sum(axis=0) - seen).ravel()]) / n + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(w[:-4], w[-4:].reshape(2, 2))


def labelled_pages(n: int = 240, seed: int = 8) -> list[str]:
    """Pages from varied templates, labelled by data-content."""
    r = random.Random(seed)
    parts = "an be con de en for ge hi in ka le mo na or pa que ra si ta un ver wo".split()
    word = lambda: "".join(r.choices(parts, k=r.choice([1, 1, 2, 2, 3])))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(2, 16).capitalize() + r.choice([".", ".", ".", ", " + words(1, 6) + "."])
    prose = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5])))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    hint = lambda k: r.choice([f' class="{r.choice(HINTS[k].split())}"', f' id="{r.choice(HINTS[k].split())}"', f' class="{word()} {r.choice(HINTS[k].split())}-{word()}"'])
    menu = lambda: "<ul>" + "".join(f"<li>{link()}" + r.choice(["</li>", "</li>", ""]) for _ in range(r.randint(2, 7))) + "</ul>"
    field_ = lambda: f"<label>{words(1, 3)}</label><input name=x><button>{word()}</button>"

    def off(tag: str, key: str, inner: str, must: bool = False) -> str:
        return f'<{tag} data-content="0"{hint(key) if must or r.random() < 0.6 else ""}>{inner}</{tag}>'

    def clutter(inside: bool) -> str:
        kinds = [
            lambda: off("div", "ad", r.choice([prose(), f"<p>{prose()}</p>", link()]), True), lambda: off("aside", "side", f"<h3>{words(1, 3)}</h3>" + r.choice([menu(), f"<p>{prose()}</p>"])),
            lambda: off("div", "share", menu(), True), lambda: off("div", "notice", f"<p>{prose()}</p>" + r.choice(["", "<button>ok</button>"]), True), lambda: off("form", "form", r.choice([field_(), f"<p>{prose()}</p>{field_()}"])),
            lambda: off("div", "side", f"<h4>{words(1, 4)}</h4>{menu()}", True), lambda: off("nav", "nav", menu()), lambda: off("section", "comment", f"<h3>{words(1, 2)}</h3>" + "".join(f"<div{hint('comment')}><p>{prose()}</p></div>" for _ in range(r.randint(1, 4))), True),
            lambda: off("div", "form", f"<p>{prose()}</p>{field_()}", True),
            lambda: f'<section data-content="0"><h3>{words(1, 2)}</h3><ol{hint("comment")}>' + "".join(f"<li><b>{word()}</b> <p>{prose()}</p></li>" for _ in range(r.randint(1, 4))) + "</ol></section>",
        ]
        return r.choice(kinds)()

    def piece() -> str:
        rich = prose() + r.choice(["", f" <b>{words(1, 3)}</b> &amp; {words(1, 4)}.", f" {link()} {words(1, 5)}.", f"<br>{words(2, 8)}", f" <em>{word()}</em>"])
        many = "".join(f"<li>{r.choice([words(1, 6), prose()])}</li>" for _ in range(r.randint(2, 5)))
        return r.choice([f"<p>{rich}</p>"] * 7 + [f"<p>{rich}", f"<p><b>{words(2, 9)}.<br>", f"<h2>{words(1, 6)}</h2><p>{rich}</p>", f"<ul>{many}</ul>", f"<ol>{many}</ol>", f"<blockquote><p>{rich}</p></blockquote>", f"<pre>{words(2, 9)}</pre>",
                         f"<table><tr><th>{word()}<th>{word()}</tr><tr><td>{word()}<td>{words(1, 4)}</tr></table>", f"<figure><img src=x><figcaption>{words(2, 8)}</figcaption></figure>", f"<div>{rich}</div>", f"<section><h3>{words(1, 4)}</h3><p>{rich}</p></section>", f"<p>{words(1, 3)}.</p>"])

    out = []
    for _ in range(n):
        body = [piece() for _ in range(r.choice([0, 1, 2, 4, 8, 15]))]
        if r.random() < 0.35:
            body.insert(r.randint(0, len(body)), clutter(True))
        head = f"<h1>{words(1, 12)}{r.choice(['', '.'])}</h1>"
        head = r.choice([head, head, f"<header>{head}</header>", ""])
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        attr = hint("content") if tag in ("div", "section") or r.random() < 0.4 else ""
        story = f'<{tag} data-content="1"{attr}>{head}{"".join(body)}</{tag}>'
        if r.random() < 0.4:
            story = f"<{r.choice(['main', 'div'])}{r.choice(['', hint('content')])}>{story}{clutter(False) if r.random() < 0.4 else ''}</div>"
        before = [off("nav", "nav", menu()) if r.random() < 0.7 else off("div", "nav", menu(), True), *(clutter(False) for _ in range(r.choice([0, 1, 1, 2])))]
        if r.random() < 0.6:
            before.insert(0, off("header", "header", f"<h2>{words(1, 3)}</h2>" + r.choice([menu(), f"<p>{words(2, 8)}</p>", prose()])))
        after = [*(clutter(False) for _ in range(r.choice([0, 0, 1, 2]))), off("footer", "footer", f"&copy; {words(1, 9)} &middot; {prose()}") if r.random() < 0.8 else off("div", "footer", f"<p>{prose()}</p>", True)]
        out.append(f"<html><head><title>{words(2, 6)}</title><script>{word()}</script></head><body>{''.join(before)}{story}{''.join(after)}</body></html>")
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: Model | None = None) -> DataFrame:
    """(page_id, url, text) for each row: the main text of the whole page, blocks joined by a line feed.

    Null or empty html and pages without an article have an empty text; ids and urls may be null or repeat; broken markup and bad
    references never fail the job. Other columns are ignored whatever their names."""
    model = train(labelled_pages()) if model is None else model
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, "html", 1 << 20):
                data, at = utf8(piece.column(2))
                found = model.extract([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    return base.mapInArrow(run, base.select("page_id", "url").schema.add("text", "string"))


def digest(pages: DataFrame) -> DataFrame:
    """The columns of ``op8_html_extraction``."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
