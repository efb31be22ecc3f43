"""Main text of web pages by gradient-boosted trees over DOM nodes, with a decision over the whole tree.

Every element and every piece of text is a node with dense features: its tag, the words in its attributes and in those of the
elements around it, text and link density of its subtree, depth, and its place among its siblings. The trees give the chance that a node holds main
text. The decision maximises the summed log-chances under one rule: below a dropped node nothing is kept. So no piece can be kept inside a dropped menu,
and a kept article can still lose an advert.

No labels come with the pages, so the trees learn from a bounded sample of them: the page itself, where a semantic container marks the article, and
copies of its paragraphs laid into page layouts drawn at random from a seed, whose parts are known.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.llm.boosting import Trees, fit_trees
from assayframe.llm.common import chosen

#: Pages the model is fitted on, and layouts drawn from each.
SAMPLE, LAYOUTS, SEED = 200, 5, 3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
OPAQUE = frozenset("script style noscript template textarea title svg iframe object select option canvas audio video head button annotation annotation-xml".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Parts of a formula; its signs and numbers belong to the text before it.
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img font".split()) | MATH
#: Elements that stand within a line of text or show nothing at all: they end no block.
PHRASING = INLINE | frozenset("script style noscript template link meta base svg iframe object canvas audio video button input select textarea map area param source track embed output progress meter datalist".split())
#: A start tag here ends an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of its own group, up to the group's container.
GROUPS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TEXT, RUN = "#text", "#run"

#: Kinds of attribute words; a kind is present if one of its patterns begins a word of class, id, role, itemprop or an aria label.
KINDS = {
    "content": "article content entry post story body main text page-content hentry articlebody prose markdown reader",
    "menu": "nav menu breadcrumb tabs toolbar pagination pager toc sitemap dropdown links",
    "head": "header masthead banner topbar logo brand hero",
    "foot": "footer foot copyright colophon bottom legal imprint",
    "side": "sidebar side aside widget rail complementary related recommend more popular trending teaser tags",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsbygoogle dfp outbrain taboola affiliate",
    "notice": "cookie notice consent gdpr alert popup modal overlay paywall banner-cookie privacy subscribe newsletter signup toast",
    "form": "form search login contact input field register",
    "comment": "comment comments reply replies disqus respond discussion reaction feedback thread",
    "social": "share social follow like tweet facebook twitter author-box meta byline",
    "hidden": "hidden invisible sr-only visually-hidden print-only d-none",
}
_KIND = {k: re.compile("(?:^|[^a-z])(?:" + "|".join(map(re.escape, sorted(v.split(), key=len, reverse=True))) + ")", re.I) for k, v in KINDS.items()}
_KIND["ad"] = re.compile(r"(?:^|[^a-z])(?:ads?(?![a-z])|ad[-_]|advert|sponsor|promo|adsbygoogle|dfp|outbrain|taboola|affiliate)", re.I)
NAMES = tuple(KINDS)
TAGS = {t: i for i, g in enumerate(("p", "h1 h2 h3 h4 h5 h6", "li dt dd", "a", "div", "section", "article", "main", "nav menu", "header", "footer", "aside", "form fieldset input button label",
                                    "ul ol dl", "table tbody thead tr td th", "blockquote pre figure figcaption", "b i em strong span small u mark code", TEXT, "html body", RUN)) for t in g.split()}
N_TAGS = max(TAGS.values()) + 2
#: Tag groups passed on to everything below: article, main, nav, header, footer, aside, form, list, table.
PASSED = (6, 7, 8, 9, 10, 11, 12, 13, 14)


#: Kinds for which an element within a line is decided on by itself.
OWN = sum(1 << i for i, k in enumerate(NAMES) if k != "content")


class Page:
    """Nodes of a page in document order; a node's parent comes before it.

    What stands within a block (pieces of text, also blank ones, links, emphasis) follows the block's decision. Text beside blocks, in an element that
    holds both, is put into a block of its own (``RUN``) per stretch between two blocks, as a browser does.
    """

    __slots__ = ("parent", "tag", "kinds", "text", "block", "names", "follows")

    def __init__(self, source: str | None):
        self.parent: list[int] = [-1]
        self.tag: list[int] = [TAGS["html"]]
        self.kinds: list[int] = [0]  # bits of NAMES
        self.text: list[str] = [""]
        self.block: list[int] = [0]
        self.names: list[str] = ["#root"]
        self._parse(source or "")
        self._settle()

    def _settle(self) -> None:
        """Put loose text into runs and find the nodes that follow their parent."""
        old = list(zip(self.parent, self.names, self.kinds, self.text, self.block))
        blocks = [name not in PHRASING and name != TEXT for name in self.names]
        mixed = [False] * len(old)  # has a block below
        for i in range(len(old) - 1, 0, -1):
            if blocks[i] or mixed[i]:
                mixed[self.parent[i]] = True
        for column in (self.parent, self.names, self.kinds, self.text, self.block, self.tag):
            column.clear()
        self.follows: list[bool] = []
        place: list[int] = []
        runs: dict[tuple[int, int], int] = {}
        for i, (parent, name, kinds, text, block) in enumerate(old):
            own = blocks[i] or mixed[i] or bool(kinds & OWN)
            at = place[parent] if parent >= 0 else -1
            if not own and parent >= 0 and mixed[parent]:
                if (parent, block) not in runs:
                    if name == TEXT and not text.strip():
                        place.append(at)
                        continue
                    runs[parent, block] = self._add(at, RUN, 0, "", block)
                    self.follows.append(False)
                at = runs[parent, block]
            place.append(self._add(at, name, kinds, text, block))
            self.follows.append(not own)

    def _add(self, parent: int, name: str, kinds: int, text: str, block: int) -> int:
        self.parent.append(parent)
        self.tag.append(TAGS.get(name, N_TAGS - 1))
        self.kinds.append(kinds)
        self.text.append(text)
        self.block.append(block)
        self.names.append(name)
        return len(self.parent) - 1

    def _parse(self, s: str) -> None:
        stack, at, block, opaque = [0], 0, 0, 0  # opaque: how many open elements hide their text
        names = self.names
        for m in TOKEN.finditer(s):
            if m.start() < at:
                continue  # inside raw text
            if m.start() > at and not opaque:
                self._text(stack[-1], s[at:m.start()], block)
            at = m.end()
            name = m.group(2)
            if name is None:
                if s.startswith("<![CDATA[", m.start()) and not opaque:
                    self._text(stack[-1], s[m.start() + 9:at].removesuffix("]]>"), block, plain=True)
                continue
            name = name.lower()
            inline = name in PHRASING
            if name == "br":
                if not opaque:
                    self._text(stack[-1], " ", block)
                continue
            if not inline:
                block += 1
            if m.group(1):  # end tag
                for k in range(len(stack) - 1, 0, -1):
                    if names[stack[k]] == name:
                        opaque -= sum(names[i] in OPAQUE for i in stack[k:])
                        del stack[k:]
                        break
                    if inline and names[stack[k]] not in PHRASING:
                        break  # a stray end tag of an inline element closes no block
                continue
            if name in CLOSES_P:
                self._close(stack, {"p"}, {"#root", "body", "td", "th", "li", "button", "table", "div", "article", "section", "main", "aside", "blockquote"} - {name})
            elif name in GROUPS:
                self._close(stack, *GROUPS[name])
            elif name == "body":
                opaque -= sum(names[i] in OPAQUE for i in stack if names[i] == "head")
                self._close(stack, {"head"}, {"#root"})
            node = self._add(stack[-1], name, self._kinds(m.group(3)) if m.group(3) else 0, "", block)
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(s, at)
                at = end.end() if end else len(s)
            elif name not in VOID and not m.group(3).endswith("/"):
                stack.append(node)
                opaque += name in OPAQUE
            elif name not in VOID:
                stack.append(node)  # a slash means nothing on other elements
                opaque += name in OPAQUE
        if at < len(s) and not opaque:
            self._text(stack[-1], s[at:], block)

    def _close(self, stack: list[int], wanted: set[str], limit: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            name = self.names[stack[k]]
            if name in wanted:
                if name != "p":  # all of the group, up to the container
                    while k > 1 and self.names[stack[k - 1]] in wanted:
                        k -= 1
                del stack[k:]
                return
            if name in limit:
                return

    def _text(self, parent: int, raw: str, block: int, plain: bool = False) -> None:
        text = raw if plain or "&" not in raw else entities.unescape(raw)
        if self.names[parent] in MATH:
            k = len(self.names) - 1
            while self.block[k] == block and self.names[k] in MATH:
                k -= 1
            if self.block[k] == block and self.names[k] == TEXT:
                self.text[k] += text
                return
        self._add(parent, TEXT, 0, text, block)

    def _kinds(self, attributes: str) -> int:
        words, bits = [], 0
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key in ("class", "id", "role", "itemprop", "aria-label", "name", "data-testid"):
                words.append(value)
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                bits |= 1 << NAMES.index("hidden")
        joined = re.sub(r"([a-z])([A-Z])", r"\1-\2", " ".join(words))
        if joined:
            for i, k in enumerate(NAMES):
                if _KIND[k].search(joined):
                    bits |= 1 << i
        return bits


def features(pages: Sequence[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of all pages; their parents, their depths, and the page each belongs to."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    page = np.repeat(np.arange(len(pages)), sizes)
    n = len(page)
    parent = np.concatenate([np.array(p.parent) for p in pages])
    root = parent < 0
    parent = np.where(root, np.arange(n), parent + base[page])
    tag = np.concatenate([np.array(p.tag) for p in pages])
    bits = np.concatenate([np.array(p.kinds) for p in pages])
    texts = [t for p in pages for t in p.text]
    chars = np.fromiter(map(len, map(str.strip, texts)), dtype=float, count=n)
    words = np.fromiter((t.count(" ") + 1 if t and not t.isspace() else 0 for t in texts), dtype=float, count=n)
    stops = np.fromiter((t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts), dtype=float, count=n)
    depth = np.zeros(n, dtype=np.int64)
    levels, here = [], np.flatnonzero(root)
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(n))
    last = np.searchsorted(parent[order], np.arange(n), side="right")
    while len(here):
        levels.append(here)
        count = last[here] - first[here]
        at = np.repeat(first[here] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        nxt = order[at]
        here = nxt[parent[nxt] != nxt]
        depth[here] = len(levels)
    is_text = tag == TAGS[TEXT]
    has = is_text & (chars > 0)
    down = np.stack([chars, words, stops, has.astype(float), np.zeros(n), (tag == TAGS["p"]).astype(float), (tag == TAGS["li"]).astype(float), (tag == TAGS["a"]).astype(float), np.ones(n)], axis=1)
    # What is handed down: passed tags and kinds of all elements above, and whether a link is above.
    kind = (bits[:, None] >> np.arange(len(NAMES)) & 1).astype(float)
    above = np.concatenate([(tag[:, None] == np.array(PASSED)).astype(float), kind, (tag == TAGS["a"]).astype(float)[:, None]], axis=1)
    nearest = kind.copy()  # kinds of the nearest element with any
    for level in levels[1:]:
        above[level] = np.maximum(above[level], above[parent[level]])
        bare = nearest[level].sum(axis=1) == 0
        nearest[level[bare]] = nearest[parent[level[bare]]]
    down[:, 4] = chars * above[:, -1]
    for level in reversed(levels[1:]):
        np.add.at(down, parent[level], down[level])
    total = np.maximum(1, down[np.flatnonzero(root)][page, 0])
    mother = down[parent]
    siblings = np.bincount(parent[~root], minlength=n)[parent] + 0.0
    start = np.searchsorted(parent[order], parent)
    rank = np.empty(n)
    rank[order] = np.arange(n)
    rank = rank - start
    alike = np.unique(parent * N_TAGS + tag, return_inverse=True)
    alike = np.bincount(alike[1])[alike[1]] / np.maximum(1, siblings)
    size = down[:, 0]
    before = np.cumsum(np.where(has, chars, 0)) - np.where(has, chars, 0)
    before = before - before[base][page]
    x = np.concatenate([
        (tag[:, None] == np.arange(N_TAGS)).astype(float), kind, above, nearest,
        np.stack([np.log1p(size), np.log1p(down[:, 1]), down[:, 4] / np.maximum(1, size), down[:, 2] / np.maximum(1, down[:, 1]), size / np.maximum(1, down[:, 3]), size / down[:, 8],
                  np.log1p(down[:, 3]), np.log1p(down[:, 5]), np.log1p(down[:, 6]), np.log1p(down[:, 7]), size / total, size / np.maximum(1, mother[:, 0]), mother[:, 4] / np.maximum(1, mother[:, 0]),
                  np.log1p(mother[:, 0]), np.log1p(mother[:, 5]), tag[parent].astype(float), depth.astype(float), np.log1p(siblings), rank / np.maximum(1, siblings), alike, before / total], axis=1)], axis=1)
    return x, parent, depth, page


def decide(p: np.ndarray, parent: np.ndarray, depth: np.ndarray, follows: np.ndarray | None = None) -> np.ndarray:
    """Nodes to keep: the choice with the greatest sum of log-chances in which no kept node lies below a dropped one and nodes that follow go with their parent."""
    follows = np.zeros(len(p), dtype=bool) if follows is None else follows
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log(1 - p)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    for level in reversed(levels[1:]):
        np.add.at(drop, parent[level], drop[level])
        np.add.at(keep, parent[level], np.where(follows[level], keep[level], np.maximum(keep[level], drop[level])))
    kept = np.zeros(len(p), dtype=bool)
    kept[levels[0]] = keep[levels[0]] > drop[levels[0]]
    for level in levels[1:]:
        kept[level] = kept[parent[level]] & (follows[level] | (keep[level] > drop[level]))
    return kept


def join_blocks(page: Page, kept: np.ndarray) -> str:
    """Kept pieces: white space inside a block becomes one space, blocks are joined by one space, in page order."""
    blocks: dict[int, list[str]] = {}
    for i in np.flatnonzero(kept):
        if page.text[i]:
            blocks.setdefault(page.block[i], []).append(page.text[i])
    return " ".join(t for b in sorted(blocks) if (t := " ".join("".join(blocks[b]).split())))


def extract(sources: Sequence[str | None], model: Trees) -> list[str]:
    if not sources:
        return []
    pages = [Page(s) for s in sources]
    x, parent, depth, page = features(pages)
    kept = decide(1 / (1 + np.exp(-model.margin(x))), parent, depth, np.concatenate([p.follows for p in pages]))
    ends = np.cumsum(np.bincount(page, minlength=len(pages)))
    return [join_blocks(p, kept[e - len(p.parent):e]) for p, e in zip(pages, ends)]


# Layouts to learn from. Words of the main text carry a mark that is taken out before features are computed.
MARK = "\ue000"

def _words(rng: random.Random, stock: Sequence[str], low: int, high: int) -> str:
    k = rng.randint(low, high)
    at = rng.randrange(max(1, len(stock) - k))
    return " ".join(stock[at:at + k])


def _attr(rng: random.Random, kind: str) -> str:
    name = rng.choice(KINDS[kind].split())
    name = rng.choice([name, f"{name}-{rng.choice(['wrap', 'box', 'inner', 'list', 'container', 'area', '1'])}", f"{rng.choice(['site', 'page', 'main', 'block', 'c', 'l'])}-{name}"])
    return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{rng.choice(["col", "row", "clearfix", "x12"])} {name}"', ""] if kind not in ("content",) else [f' class="{name}"', f' id="{name}"', ""])


def layout(paragraphs: Sequence[str], stock: Sequence[str], rng: random.Random) -> str:
    """A page with the paragraphs as its main text, each word marked, amid parts of other kinds."""
    w = lambda a, b: entities.escape(_words(rng, stock, a, b))
    link = lambda a=1, b=3: f'<a href="/{rng.randrange(999)}">{w(a, b)}</a>'
    tag = lambda *names: rng.choice(names)

    def menu() -> str:
        t, items = tag("nav", "nav", "div", "ul", "header"), [link() for _ in range(rng.randint(3, 12))]
        inner = rng.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(items)])
        return f"<{t}{_attr(rng, 'menu')}>{inner}</{t}>" if t != "ul" else f"<ul{_attr(rng, 'menu')}>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"

    def head() -> str:
        t = tag("header", "header", "div")
        attr = _attr(rng, "head") if t == "header" else f' class="{rng.choice(KINDS["head"].split())}"'
        return f"<{t}{attr}>{rng.choice(['', f'<h1>{w(1, 4)}</h1>', f'<p>{w(2, 9)}</p>', f'<div>{link()}</div>', f'<span>{w(1, 5)}</span>'])}{rng.choice(['', menu()])}</{t}>"

    def foot() -> str:
        t = tag("footer", "footer", "div")
        attr = _attr(rng, "foot") if t == "footer" else f' class="{rng.choice(KINDS["foot"].split())}"'
        return f"<{t}{attr}>{rng.choice(['&copy; ', '', '<p>'])}{w(2, 25)} {rng.choice(['', link(), menu(), f'<p>{w(3, 20)}</p>'])}</{t}>"

    def side() -> str:
        t = tag("aside", "aside", "div", "section")
        attr = _attr(rng, "side") if t == "aside" else f' class="{rng.choice(KINDS["side"].split())}"'
        body = rng.choice([f"<h3>{w(1, 3)}</h3><ul>" + "".join(f"<li>{link(2, 8)}</li>" for _ in range(rng.randint(2, 8))) + "</ul>", f"<p>{w(4, 40)}</p>", f"<h2>{w(1, 4)}</h2><p>{w(5, 40)}</p>{link()}", w(3, 20)])
        return f"<{t}{attr}>{body}</{t}>"

    def ad() -> str:
        t = tag("div", "div", "div", "aside", "section", "ins", "p")
        return f'<{t} class="{rng.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "adsbygoogle"])}">{rng.choice([w(3, 30), f"<p>{w(4, 40)}</p>", link(2, 8), f"<span>{w(1, 3)}</span> {link(3, 9)}"])}</{t}>'

    def notice() -> str:
        t = tag("div", "div", "section", "aside", "p")
        return f'<{t} {rng.choice(["class", "id"])}="{rng.choice(["cookie", "cookie-banner", "notice", "consent", "alert", "gdpr", "popup", "newsletter", "subscribe-box", "paywall"])}">{rng.choice([w(4, 40), f"<p>{w(5, 40)}</p>"])}{rng.choice(["", f"<button>{w(1, 2)}</button>", link()])}</{t}>'

    def form() -> str:
        return f"<form{_attr(rng, 'form')}>{rng.choice(['', f'<p>{w(3, 20)}</p>'])}<label>{w(1, 4)}</label><input name=q>{rng.choice(['', f'<button>{w(1, 2)}</button>', f'<span>{w(1, 6)}</span>'])}</form>"

    def comments() -> str:
        t, name = tag("section", "div", "ol", "ul", "aside"), rng.choice(["comments", "comment-list", "reader-comments", "replies", "disqus_thread", "discussion", "responses comments"])
        one = lambda: f'<p>{w(4, 60)}</p>'
        item = tag("li") if t in ("ol", "ul") else tag("div", "article", "p", "li")
        items = "".join(f'<{item}{rng.choice(["", " class=comment", " class=\"comment-body\""])}>{rng.choice([f"<b>{w(1, 2)}</b> ", "", link()])}{one() if item != "p" else w(4, 60)}</{item}>' for _ in range(rng.randint(1, 6)))
        title = f"<h2>{w(1, 3)}</h2>" if t not in ("ol", "ul") and rng.random() < 0.5 else ""
        return f'<{t} {rng.choice(["class", "id"])}="{name}">{title}{items}</{t}>'

    def social() -> str:
        return f'<div class="{rng.choice(["share", "social", "follow-us", "share-buttons", "tags"])}">' + " ".join(link() for _ in range(rng.randint(2, 5))) + "</div>"

    def hidden() -> str:
        return rng.choice([f"<script>var t=\"</p>\";f({rng.randrange(99)})</script>", "<style>p{margin:0}</style>", f"<noscript><p>{w(3, 9)}</p></noscript>", f'<div style="display:none">{w(3, 20)}</div>', f"<!-- {w(2, 6)} <p> -->", f"<div hidden><p>{w(3, 20)}</p></div>"])

    def marked(text: str) -> str:
        return " ".join(MARK + t for t in text.split())

    def block(text: str) -> str:
        t = entities.escape(marked(text), quote=False)
        cut = t.split(" ")
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 4])):
            if len(cut) > 6:
                a = rng.randrange(0, len(cut) - 2)
                inline = tag("b", "i", "em", "strong", "span", "a href='/x'", "a href='/y'", "code")
                cut[a:a + 2] = [f"<{inline}>{cut[a]} {cut[a + 1]}</{inline.split()[0]}>{rng.choice(['', '', '<br>', '<br/>'])}"]
        t = " ".join(cut)
        kind = rng.random()
        if kind < 0.05:
            half, a = max(1, len(cut) // 2), rng.choice([1, 1, 2, 4])
            return f"<dl><dt>{' '.join(cut[:a])}</dt><dd>{' '.join(cut[a:half])}</dd><dt>{' '.join(cut[half:half + a])}</dt><dd>{' '.join(cut[half + a:])}</dd></dl>"
        if kind < 0.72:
            return f"<p{rng.choice(['', '', '', ' class=lead'])}>{t}{rng.choice(['</p>', '</p>', '</p>', ''])}"
        if kind < 0.78:
            return f"<div>{t}</div>"
        if kind < 0.84:
            return f"<blockquote>{rng.choice(['', '<p>'])}{t}</blockquote>"
        if kind < 0.92:
            third = max(1, len(cut) // 3)
            return f"<{(u := tag('ul', 'ol'))}>" + "".join(f"<li>{' '.join(cut[i:i + third])}</li>" for i in range(0, len(cut), third)) + f"</{u}>"
        if kind < 0.96:
            return f"<table><tr><td>{' '.join(cut[:len(cut) // 2])}</td><td>{' '.join(cut[len(cut) // 2:])}</td></tr></table>"
        return f"<{(h := tag('h2', 'h3', 'h4'))}>{' '.join(cut[:8])}</{h}>"

    main = []
    if rng.random() < 0.85:
        title = entities.escape(marked(_words(rng, stock, 1, rng.choice([1, 3, 10]))))
        main.append(rng.choice([f"<h1>{title}</h1>", f"<h1 class=title>{title}</h1>", f"<h2>{title}</h2>", f"<header><h1>{title}</h1></header>"]))
    for text in paragraphs:
        main.append(block(text))
        if rng.random() < 0.12:
            main.append(rng.choice([ad, ad, side, social, notice, form, hidden])())
    kind, bare = rng.random(), False
    if kind < 0.55:
        container = tag("article", "article", "article", "main", "div", "div", "section")
        attr = _attr(rng, "content") if container in ("article", "main") else f' {rng.choice(["class", "id"])}="{rng.choice(KINDS["content"].split())}"'
        tail = rng.choice([comments, social, side])() if rng.random() < 0.25 else ""
        middle = f"<{container}{attr}>{''.join(main)}{tail}</{container}>"
    elif kind < 0.65:  # a layout table
        parts = [rng.choice(["", menu(), side(), link() + "<br>" + link()]), "".join(main), rng.choice(["", side(), ad()])]
        middle = f"<table{rng.choice(['', ' width=100%', ' border=0'])}><tr>" + "".join(f"<td{rng.choice(['', ' width=160', ' valign=top'])}>{part}</td>" for part in parts if part) + "</tr></table>"
    elif kind < 0.8:
        middle = f"<{(c := tag('div', 'div', 'main', 'center'))}>{''.join(main)}</{c}>"
    else:  # no container at all
        middle, bare = "".join(main), True
    for _ in range(0 if bare else rng.choice([0, 0, 1, 1, 2])):
        middle = f"<{(c := tag('div', 'main', 'section'))}{rng.choice(['', ' class=container', ' class=wrapper', ' id=page', ' class=row', ' class=main-content'])}>{rng.choice(['', '', side(), menu(), ad()])}{middle}{rng.choice(['', '', side(), comments(), ad()])}</{c}>"
    amid = 0.0 if rng.random() < 0.15 else 0.4  # some pages are nothing but their article
    before = [f() for f in (head, menu, ad, notice, form, side, hidden) if rng.random() < amid]
    after = [f() for f in (side, comments, ad, form, notice, foot, foot, hidden, social) if rng.random() < amid]
    rng.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{w(2, 8)}</title>{hidden()}</head><body>{''.join(before)}{middle}{''.join(after)}{rng.choice(['</body></html>', ''])}"


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A drawn page and, for each node, whether it holds main text: words with the mark, and all elements around them."""
    page = Page(source)
    label = np.array([MARK in t for t in page.text])
    page.text = [t.replace(MARK, "") for t in page.text]
    return page, _upwards(page, label)


def _upwards(page: Page, label: np.ndarray) -> np.ndarray:
    for i in range(len(page.parent) - 1, 0, -1):
        if label[i]:
            label[page.parent[i]] = True
    for i, follows in enumerate(page.follows):
        if follows:
            label[i] = label[page.parent[i]]
    return label


def within_article(source: str) -> tuple[Page, np.ndarray] | None:
    """A page that marks its article by the one element of this name: text inside is main text."""
    page = Page(source)
    if page.names.count("article") != 1:
        return None
    inside = np.zeros(len(page.parent), dtype=bool)
    for i in range(1, len(inside)):
        inside[i] = inside[page.parent[i]] or page.names[i] == "article"
    return page, _upwards(page, inside & np.array([n == TEXT and bool(t.strip()) for n, t in zip(page.names, page.text)]))


def train(sources: Sequence[str], layouts: int = LAYOUTS, seed: int = SEED) -> Trees:
    """Fit the trees on the pages themselves and on layouts drawn with their paragraphs. Without pages nothing is kept."""
    rng, pages = random.Random(seed), []
    stock = [w for s in sources for t in Page(s).text for w in t.split()][:200_000] or ["word"]
    for s in sources:
        if known := within_article(s):
            pages.append(known)
        pieces = [" ".join(t.split()) for t in Page(s).text if len(t) > 60]
        for _ in range(layouts):
            some = rng.sample(pieces, min(len(pieces), rng.randint(1, 12)))
            if rng.random() < 0.4:  # short articles
                some = [" ".join(t.split()[:rng.randint(3, 30)]) for t in some[:rng.randint(1, 4)]]
            if some:
                pages.append(labelled(layout(some, stock, rng)))
    if not pages:
        return fit_trees(np.zeros((0, 1)), np.zeros(0))
    x = features([p for p, _ in pages])[0]
    return fit_trees(x, np.concatenate([y for _, y in pages]).astype(float), trees=50, depth=4, rate=0.25)


def extract_pages(pages: DataFrame, model: Trees) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``: the main text of the whole html.

    Null, empty and text-free pages give empty text; markup cut off at any place is read as far as it goes.
    Repeated rows are returned as often as they occur; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = extract(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def fit(pages: DataFrame, bound: int = SAMPLE) -> Trees:
    """Fit on at most ``bound`` different pages, the first in the order of a hash of the html. The trees are a model of page layouts: the bound is theirs, all pages are extracted."""
    known = pages.where("html IS NOT NULL").select("html")
    rows = known.where(chosen(min(1.0, 8 * bound / max(1, known.count())), F.col("html"), F.lit("sample"))).distinct()
    first = lambda df: df.orderBy(F.xxhash64("html", F.lit("sample")), "html").limit(bound).collect()
    taken = first(rows) or first(known.distinct())
    return train([r["html"] for r in taken])


def op1_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return extract_pages(pages, fit(pages))
