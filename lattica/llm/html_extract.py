"""Main text of web pages by tree scoring.

A forgiving parser makes the element tree and cuts the text into blocks.  A
block passes points for its length and commas to its container, half of them
to the next ancestor and so on, discounted by the share of its text inside
links.  The best container, or the article or main element that it is in, and
siblings with enough points are kept, without the parts that are furniture by
element, role or name.  Names may mislead: a part cut by name comes back if it
has the page's only article or main element, outscores the chosen container,
or holds most of the text.  Text of inline elements that are furniture (buttons,
hidden spans, links that are named adverts) is left out of its block.

All passes are linear in the page: what depends on ancestors is carried down,
what depends on descendants is summed up, and the parser knows for each tag
where it is open.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|</?([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
#: What may begin after the last ">" of a page: it goes on to the end.
_UNENDED = re.compile(r"<[!?].*", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# fixed values of HTML
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_ENDS_P = _BLOCK - frozenset("body head html caption tbody td tfoot th thead tr".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

#: Elements that never hold the article.
_FURNITURE = frozenset("nav footer aside form head template svg math canvas object embed button select dialog menu video audio map datalist fieldset applet".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id that name furniture.
_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets rail header masthead topbar footer foot copyright social share sharing related recommended recommendation recommendations "
    "trending popular comment comments commentlist disqus reply replies respond form login search toolbar skip hidden".split()
)
_TITLES = frozenset("header masthead".split())
#: Names of article elements that are no article.
_REMARKS = frozenset("comment comments reply replies sponsored advert advertisement promo related".split())
#: Parts with these names stay cut whatever they hold: they are texts of others or about other pages.
_OTHERS = _REMARKS | frozenset("recommended recommendation recommendations trending popular".split())
#: Words that leave a name of furniture one.
_PLACES = _NAMES | frozenset("left right top bottom primary secondary area bar box block list link links item items".split())
#: First words of names that say what a page has or lacks, such as has-sidebar.
_ABOUT = frozenset("has no with without".split())
_GOOD = frozenset("article content entry main page post story text body blog".split())
_PARAGRAPH = frozenset("p pre blockquote td li dd dt figcaption h1 h2 h3 h4 h5 h6 caption summary".split())
_HEAD = frozenset("h1 h2 h3 h4 h5 h6".split())
_START = {"article": 25.0, "main": 20.0, "div": 5.0, "section": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0, "th": -5.0}


def _attrs(raw: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


def _names(attrs: dict[str, str]) -> list[set[str]]:
    """Words of each name in class and id, without names that only say what a page has."""
    parts = [[w.lower() for w in _PARTS.findall(x)] for k in ("class", "id") for x in attrs.get(k, "").split()]
    return [set(n) for n in parts if n and n[0] not in _ABOUT]


def _furniture(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is furniture by itself or its role, or is hidden."""
    if tag in _FURNITURE or tag == "header" and not in_article:
        return True
    return attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _named(tag: str, names: list[set[str]], in_article: bool) -> bool:
    """Whether an element is furniture by name."""
    if tag in ("body", "html", "main"):
        return False
    # a header inside the article holds its title
    bad = _REMARKS if tag == "article" else _NAMES - _TITLES if in_article else _NAMES
    if not any(n & bad for n in names):
        return False
    if tag in _PARAGRAPH:
        # a paragraph is furniture only if all its names say so
        return all(n & bad and n <= _PLACES for n in names)
    # "content sidebar-left" is the content, but "content sidebar" and "main-nav" are furniture
    return any(n & bad and n <= _PLACES for n in names) or not any(n & _GOOD and not n & _NAMES for n in names)


def _insert(tag: str, names: list[set[str]]) -> bool:
    """Whether an inline element's own text is furniture: each of its names says so and nothing else."""
    return tag not in _BLOCK and bool(names) and all(n & _NAMES and n <= _PLACES for n in names)


class Tree:
    """Elements (tag, parent, names, furniture or inside it, furniture by its own name) and text blocks (element, text, characters in links), in page order."""

    def __init__(self, page: str):
        self.tag, self.parent, self.names, self.hard, self.named = ["#"], [0], [[]], [False], [False]
        #: Carried down: the nearest block element, whether a link is open, whether an article or main element is.
        self.block, self.link, self.in_article = [0], [False], [False]
        #: Whether text in it is left out although its block may stay: it is in an inline element that is furniture.
        self.left_out = [False]
        self.blocks: list[tuple[int, str, int]] = []
        # the open elements; for each the depth of the nearest block element and of the paragraph that a new block ends
        self._stack, self._block_at, self._p_at = [0], [0], [0]
        self._open_at: dict[str, list[int]] = {}
        self._text: list[str] = []
        self._links, at, n = 0, 0, len(page)
        last = page.rfind(">")
        while at < n:
            # after the last ">" no tag ends: each would be sought to the end of the page
            m = _TAG.search(page, at, last + 1) if at <= last else _UNENDED.search(page, at)
            if m is None:
                self._add(page[at : last + 1] if at <= last else page[at:])
                at = last + 1 if at <= last else n
                continue
            self._add(page[at : m.start()])
            whole, named, at = m.group(), m.re is _TAG and (m[1] or m[3]), m.end()
            if whole.startswith("<!--") and not whole.endswith("-->") or whole.startswith("<![CDATA[") and not whole.endswith("]]>"):
                whole, at = page[m.start() :], n
            name = (named or "").lower()
            if not name:
                if whole.startswith("<![CDATA["):
                    self._add(_html.escape(whole[9:].removesuffix("]]>")))
                continue
            if m.group()[1] == "/":
                self._close(name)
                continue
            raw = m[2] if m[1] else m[4]
            if name in _RAW:
                end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at) if at <= last else None
                at = end.end() if end else n
                continue
            self._open(name, raw or "")
        self._flush()

    def _add(self, s: str) -> None:
        if s and not self.left_out[self._stack[-1]]:
            self._text.append(s)
            self._links += len(s) * self.link[self._stack[-1]]

    def _flush(self) -> None:
        if self._text:
            text = " ".join(_html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self.block[self._stack[-1]], text, self._links))
            self._text, self._links = [], 0

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._open_at[self.tag[self._stack.pop()]].pop()
            self._block_at.pop()
            self._p_at.pop()

    def _ends(self, tag: str) -> None:
        """Closes what a new element of this tag ends."""
        if tag in _ENDS_P and self._p_at[-1]:
            self._pop_to(self._p_at[-1])
        if tag in _ENDS:
            stop = max((self._open_at[t][-1] for t in _STOPS[tag] if self._open_at.get(t)), default=0)
            at = [self._open_at[t][k] for t in _ENDS[tag] if self._open_at.get(t) and (k := bisect_right(self._open_at[t], stop)) < len(self._open_at[t])]
            if at:
                self._pop_to(min(at))

    def _open(self, tag: str, raw: str) -> None:
        if tag in ("br", "wbr"):
            self._text.append(" " if tag == "br" else "")
            return
        if tag in _BLOCK:
            self._flush()
        self._ends(tag)
        if tag in _VOID:
            return
        attrs = _attrs(raw)
        up, number = self._stack[-1], len(self.tag)
        inside = self.in_article[up]
        self.tag.append(tag)
        self.parent.append(up)
        self.names.append(_names(attrs))
        self.hard.append(self.hard[up] or _furniture(tag, attrs, inside))
        self.named.append(_named(tag, self.names[-1], inside))
        self.block.append(number if tag in _BLOCK else self.block[up])
        inline = tag not in _BLOCK
        self.left_out.append(inline and (self.left_out[up] or _furniture(tag, attrs, inside) or _insert(tag, self.names[-1])))
        self.link.append(self.link[up] or tag == "a")
        self.in_article.append(inside or tag in ("article", "main"))
        if not raw.rstrip().endswith("/") or tag in _BLOCK or tag == "a":
            depth = len(self._stack)
            self._stack.append(number)
            self._open_at.setdefault(tag, []).append(depth)
            self._block_at.append(depth if tag in _BLOCK else self._block_at[-1])
            self._p_at.append(depth if tag == "p" else 0 if tag in _BLOCK else self._p_at[-1])

    def _close(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        at = self._open_at.get(tag)
        # an inline element that began outside the nearest block stays open
        if at and (tag in _BLOCK or at[-1] > self._block_at[-1]):
            self._pop_to(at[-1])

    def cut(self, spared: set[int]) -> list[bool]:
        """Which elements are furniture or inside it; names of ``spared`` elements don't count."""
        out = self.hard.copy()
        for i in range(1, len(out)):
            out[i] |= out[self.parent[i]] or self.named[i] and i not in spared
        return out

    def above(self, node: int) -> list[int]:
        """The element and its ancestors but the root."""
        out = []
        while node:
            out.append(node)
            node = self.parent[node]
        return out

    def plain(self, cut: list[bool]) -> list[int]:
        """Characters outside links in what each element holds and is not cut."""
        out = [0] * len(self.tag)
        for o, t, n in self.blocks:
            out[o] += 0 if cut[o] else len(t) - min(n, len(t))
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out


def _spared(tree: Tree) -> set[int]:
    """Elements whose names say furniture and that hold the article all the same."""
    every = {i for i in range(1, len(tree.tag)) if tree.named[i] and not tree.hard[i]}
    if not every:
        return every
    out: set[int] = set()
    others = {i for i in every if any(n & _OTHERS for n in tree.names[i])}
    maybe = every - others
    cut, loose = tree.cut(out), tree.cut(maybe)
    live, could = tree.plain(cut), tree.plain(loose)
    for tags in (("article",), ("article", "main")):
        if not any(t in tags and live[i] for i, t in enumerate(tree.tag)):
            holds = [t in tags and could[i] > 0 for i, t in enumerate(tree.tag)]
            for i in range(len(holds) - 1, 0, -1):
                holds[tree.parent[i]] |= holds[i]
            out |= {k for k in maybe if holds[k]}
    cut = tree.cut(out)
    live = tree.plain(cut)
    marked = [live[i] > 0 and (t == "article" or t not in ("body", "html") and any(n & _GOOD for n in tree.names[i])) for i, t in enumerate(tree.tag)]
    some = any(marked)
    # characters of marked elements: below an element, and beside it and its ancestors
    below, beside = [0] * len(marked), [0] * len(marked)
    held = lambda i: live[i] if marked[i] else below[i]
    for i in range(len(marked) - 1, 0, -1):
        below[tree.parent[i]] += held(i)
    for i in range(1, len(marked)):
        beside[i] = beside[tree.parent[i]] + below[tree.parent[i]] - held(i)

    def doubtful(i: int) -> bool:
        """Whether a name says too little: nothing is marked as the article, or far less text is and the name has other words than those of furniture."""
        pure = any(n & _NAMES and n <= _PLACES for n in tree.names[i])
        return not some or not pure and could[i] > 4 * beside[i]

    maybe = {i for i in maybe - out if could[i] and doubtful(i)}
    if not maybe:
        return out
    loose = tree.cut(out | maybe)
    best, points = _best(tree, loose)[:2]
    inside = maybe & set(tree.above(best))
    if inside and points > _best(tree, cut)[1]:
        return out | inside
    most = {i for i in maybe if 2 * could[i] > could[0]}
    if most:
        best = _best(tree, tree.cut(out | most))[0]
        if best == 0 or most & set(tree.above(best)) or best in tree.above(max(most)):
            return out | most
    return out


def points(tree: Tree, owner: int, text: str, linked: int) -> float:
    """What a block passes to its container: for its length and commas, less its share inside links; a heading counts a fifth."""
    return (0.2 if tree.tag[owner] in _HEAD else 1.0) * (1 + sum(text.count(c) for c in ",،，、") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def container(tree: Tree, owner: int) -> int:
    """The element that a block's points go to first: the parent of a paragraph, else the block's own."""
    return tree.parent[owner] if tree.tag[owner] in _PARAGRAPH else owner


def _best(tree: Tree, cut: list[bool]) -> tuple[int, float, dict[int, float], list[int], list[int]]:
    """The container with the most points, its points, and points, characters and characters in links of all."""
    live = [(o, t, min(n, len(t))) for o, t, n in tree.blocks if not cut[o]]
    size = len(tree.tag)
    score, reached, chars, links = [0.0] * size, [False] * size, [0] * size, [0] * size
    for owner, text, linked in live:
        first = container(tree, owner)
        score[first] += points(tree, owner, text, linked)
        reached[first] = True
        chars[owner] += len(text)
        links[owner] += linked
    for i in range(size - 1, 0, -1):
        up = tree.parent[i]
        score[up] += score[i] / 2
        reached[up] |= reached[i]
        chars[up] += chars[i]
        links[up] += links[i]
    for i in range(size):
        good = any(n & _GOOD and not (tree.named[i] and n & _NAMES) for n in tree.names[i])
        score[i] += _START.get(tree.tag[i], 0.0) + 25.0 * good
    value = lambda i: score[i] * (1 - links[i] / max(chars[i], 1))
    scored = {i: score[i] for i in range(size) if reached[i]}
    best = max(scored, key=lambda i: (value(i), -i), default=0)
    return best, value(best) if scored else float("-inf"), scored, chars, links


#: What a sentence ends with.
_STOP = tuple(".!?…。！？:;\"'”’»)")
#: A list whose items have so many characters on average holds references rather than a menu.
_ITEM = 20


def _main(tree: Tree, spared: set[int]) -> list[str]:
    cut = tree.cut(spared)
    live = [(o, t) for o, t, _ in tree.blocks if not cut[o]]
    if not live:
        return []
    best, _, score, chars, links = _best(tree, cut)
    density = lambda i: links[i] / max(chars[i], 1)
    # the article or main element around the best container holds the whole article
    above = tree.above(best)
    best = next((i for t in ("article", "main") for i in above if tree.tag[i] == t), best)
    keep = {best}
    if best:
        least = max(10.0, 0.2 * score[best])
        last: dict[int, str] = {}
        for owner, text in live:
            last[owner] = text
        for i in range(len(tree.tag) - 1, 0, -1):
            if i in last:
                last.setdefault(tree.parent[i], last[i])
        for i in range(1, len(tree.tag)):
            if tree.parent[i] != tree.parent[best] or i == best or cut[i] or not chars[i]:
                continue
            # siblings: with enough points, of the same kind, or text without links that ends as sentences do
            alike = tree.tag[i] == tree.tag[best] and tree.names[i] == tree.names[best] and density(i) < 0.25 and tree.tag[best] not in ("article", "main")
            plain = tree.tag[i] in ("p", "div", "section", "blockquote", "pre") and not links[i] and last[i].endswith(_STOP)
            if score.get(i, 0) * (1 - density(i)) >= least or alike or plain or tree.tag[i] == "p" and chars[i] > 80 and density(i) < 0.25:
                keep.add(i)
    # lists of short links are menus; inside an article element nothing is
    items = [0] * len(tree.tag)
    for owner, _ in live:
        items[tree.parent[owner]] += tree.tag[owner] in ("li", "dd", "dt", "td")
    menu, inside, head, in_article = ([False] * len(tree.tag) for _ in range(4))
    for i in range(len(tree.tag)):
        up = tree.parent[i]
        in_article[i] = in_article[up] or tree.tag[i] == "article"
        listed = i and tree.tag[i] in ("ul", "ol", "div", "section", "table", "dl") and chars[i] and density(i) > 0.66 and not in_article[i] and chars[i] < _ITEM * max(items[i], 1)
        inside[i] = inside[up] or i in keep
        menu[i] = i not in keep and (menu[up] or bool(listed))
        head[i] = i not in keep and (head[up] or tree.tag[i] == "header")
    return [text for owner, text in live if inside[owner] and not menu[owner] and not (head[owner] and tree.tag[owner] not in _HEAD)]


def extract(page: str | None) -> str:
    """The main text of one page: blocks joined by an empty line, empty if there is none."""
    if not page:
        return ""
    tree = Tree(page)
    return "\n\n".join(_main(tree, _spared(tree)) or _main(tree, set(range(len(tree.tag)))))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Returns a row per input row: all other columns, text and n_chars (its code points).

    A null or empty page has an empty text; a page of any length is read whole,
    in time in proportion to it; markup that never ends is read to the end of
    the page.  Of containers with equal points the first counts.  Null ids
    stay null; repeated rows each get their row; an empty table gives an empty
    result.  Columns named text or n_chars are replaced, others stay.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = pages.select(*rest).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                found = [extract(x.as_py()) for x in part.column(html_col)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*rest, "text", "n_chars"])

    return pages.select(*rest, F.col(html_col)).mapInArrow(run, schema)


