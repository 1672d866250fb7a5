"""Main text of web pages by wrapper induction.

All distinct pages of a host are parsed into DOM trees and aligned with one of them (that with the least hash of its content), its reference, by simple
tree matching: the largest set of node pairs that keeps ancestors and the order of siblings. A slot is an element of the reference with the texts that the
aligned pages have there; they are counted over all pages. Slots whose text varies are content: the regions of a host are the articles that hold most of the varying text, else
main elements that do, else the deepest element with four fifths of it and its title. So names only choose between elements that vary; an article
with one text on nearly all pages, shorter than what varies elsewhere, is template. Pages that lack the regions are of other layouts: those with equal paths of containers are
aligned with a reference of their own, then what is still without regions by the upper containers, and at last together (``LEVELS``). Template is
counted over all distinct pages of the host, those with an article aside: the texts that a tenth of the pages have, and most pages with their path.

A page's main text is what its host's regions hold, without what serves navigation, notices, adverts, forms, comments and the like by tag, role, or a
class or id as a whole (see ``judge``), and without the host's constant texts, which an article keeps. A page without those regions (fewer than
three distinct pages of its host or layout) falls back on its article, else main, else body. Template marks are
used only where a host's pages differ and constant text is a minor part of the region, so that hosts whose pages are copies of
each other keep their text. A constant text is dropped at the path where it was seen alone.

Every page is learnt from and extracted whole. What is shuffled are hashes and lengths of slots' texts, never pages, and no host's rows meet in one task. References and wrappers, one
row a host and layout, are sent to the tasks up to ``BROADCAST_HOSTS`` rows and ``BROADCAST_CHARS``, and joined otherwise, with pages of a host dealt over salts.

Defined results: a null or empty page has the empty text. A page cut off in the middle yields what it has; unclosed elements end with their
parent. White space inside a block, a line break element included, is one space. Repeated rows give equal rows; an empty table an
empty one; a null URL is a host of its own without a name; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm._words import map_texts, only, settle, shared_folder

#: A text is constant in a slot where this share of the pages that have the slot have it, and the slot is everywhere on this share of the pages.
CONSTANT_SHARE = 0.9
#: Lists of children with up to so many pairs are aligned number by number, longer ones by rows of numbers.
TABLE = 512
#: Pages without the host's regions are grouped by their containers' paths down to these depths, one after the other; none at last.
LEVELS = (1 << 30, 4, 0)
CONTAINERS = frozenset("article body div main section td".split())
#: Template is on this many of a host's distinct pages, this share of all of them, and this share of those with its path.
LEAST_PAGES, HOST_SHARE, SLOT_SHARE = 3, 0.1, 0.8
#: An unnamed region has this share of all varying text; articles, or else main elements, with more than the second share go before it.
REGION_SHARE, NAMED_SHARE = 0.8, 0.5
BROADCAST_HOSTS, BROADCAST_CHARS = 5000, 1 << 25
#: Pages without regions up to which they are sent to the tasks.
LEFT = 200_000
SALTS = 32

#: Element roles of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption".split())
SKIP = frozenset("nav aside footer form script style noscript iframe template head title button select option textarea input svg canvas object embed menu dialog".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div body html main aside nav footer header form blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
BOILER = re.compile(r"ads?|adv|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|form|login|menu|menubar|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promo\w*|related|recommend\w*|respond|share|sharing|sidebar|sidebars|signup|skip|social|sponsor\w*|subscribe|toolbar|widget")

#: Names of page headers; they count outside the article only, since an article's own header holds its title.
HEAD = re.compile(r"header|masthead|topbar")

#: Words that may stand beside those in a name: places, containers and kinds of page. All others (has-, no-, with-, content-) make it another name.
PLAIN = re.compile(r"\d+(?:x\d+)?|accept|area|article|bar|blog|block|body|bottom|box|brand|btn|buttons?|col|column|container|count|desktop|div|dropdown|entry|first|fixed|global|google|group|head|header|heading|holder|icons?|id|inner|items?|js|layer|left|links?|lists?|logo|main|message|meta|mobile|outer|overlay|page|panel|policy|posts?|primary|region|right|row|second|secondary|section|site|slot|sticky|sub|text|title|toggler?|top|unit|wp|wrap|wrapper|zone")

_token = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|$)", re.S)
_attribute = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


def named(names: str, words: re.Pattern) -> bool:
    """Whether one of the names consists of these words and plain ones; ``content`` may end such a name."""
    for name in names.lower().split():
        parts = [x for x in re.split("[-_]+", name) if x]
        own = [bool(words.fullmatch(x)) for x in parts]
        if any(own) and all(o or PLAIN.fullmatch(x) or k and x == "content" for k, (o, x) in enumerate(zip(own, parts, strict=True))):
            return True
    return False


def traits(tag: str, given: str) -> tuple[str, bool, bool, bool]:
    """Of a start tag: its label, whether it is hidden, and whether its names are those of boilerplate, or of a page header."""
    attributes = {a.lower(): b or c or d for a, b, c, d in reversed(_attribute.findall(given))} if given.strip() else {}  # the first of a name counts
    name = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    label = f"{tag}.{' '.join(sorted(attributes.get('class', '').split()))}" if "class" in attributes else tag
    hidden = tag in SKIP or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    return label, hidden, named(name, BOILER), named(name, HEAD)


def place(up: int, label: str) -> int:
    return key(str(up), label)


#: Pages of a host repeat their tags. A worker keeps so many of them; long ones aren't kept, so the memory is bounded in bytes too.
MEMO, MEMO_CHARS = 20_000, 200
_known_traits, _known_place = lru_cache(MEMO)(traits), lru_cache(MEMO)(place)


class Node:
    __slots__ = ("tag", "label", "children", "parent", "hidden", "named", "skip", "place", "depth", "inside")

    def __init__(self, tag: str, label: str, parent: Node | None, hidden: bool, named: bool = False) -> None:
        self.tag, self.label, self.parent, self.hidden, self.named = tag, label, parent, hidden, named
        self.skip = hidden or named
        self.inside: bool = tag in ("article", "main") or parent is not None and parent.inside
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.place = (place if len(label) > MEMO_CHARS else _known_place)(parent.place, label) if parent else 0  # stands for the labels from the root to here


def parse(page: str) -> Node:
    """The DOM: elements, and text as strings with references undecoded. Comments and declarations are left out."""
    root = node = Node("#", "", None, False)
    at, n = 0, len(page)
    still: Counter = Counter()  # open elements by tag, so that no end tag without a start searches the whole chain

    def leave(last: Node) -> Node:
        """Close the open elements up to this one."""
        up = node
        while up is not last:
            still[up.tag] -= 1
            up = up.parent
        still[last.tag] -= 1
        return last.parent

    while at < n:
        m = _token.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if still[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up)
            continue
        if tag in ENDS_P and still["p"]:
            up = node
            while up.tag not in SCOPE and up.tag not in ("#", "p", "button", "td", "th"):
                up = up.parent
            if up.tag == "p":
                node = leave(up)
        if tag in SAME and any(still[t] for t in SAME[tag]):
            up = node
            while up.tag not in SAME[tag] and up.tag not in SCOPE and up.tag != "#":
                up = up.parent
            if up.tag in SAME[tag]:
                node = leave(up)
        label, hidden, boiler, head = (traits if len(tag) + len(m[3]) > MEMO_CHARS else _known_traits)(tag, m[3])
        by_name = boiler and tag not in ("html", "body")
        if not node.inside and tag not in ("html", "body", "article", "main"):
            hidden = hidden or tag == "header"
            by_name = by_name or head
        hidden = hidden or node.hidden
        child = Node(tag, label, node, hidden, by_name)
        node.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            child.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            node = child
            still[tag] += 1
    judge(root)
    return root


def judge(root: Node) -> None:
    """Marks what is skipped: hidden elements, and named ones with all below them.

    Names never drop a main element, nor the longest article: neither its own name counts then, nor its ancestors'. Other articles in named
    elements, as comments and teasers are, stay out. Where no article is left, the one in a named element must be longer than the rest of the page.
    """
    order = elements(root)

    def mark() -> None:
        for x in order:
            x.skip = x.hidden or x.named or x.parent is not None and x.parent.skip

    mark()
    texts = [x for x in order if x.tag in ("article", "main") and not x.hidden]
    dropped = [x for x in texts if x.skip]
    if not dropped:
        return
    size: dict[int, int] = {}
    for x in reversed(order):
        size[id(x)] = sum(len(c.strip()) if isinstance(c, str) else 0 if c.hidden or c.named else size[id(c)] for c in x.children)
    rest = max((size[id(x)] for x in texts if not x.skip), default=size[id(root)])
    longest = max(size[id(x)] for x in dropped)
    for x in dropped:
        if x.tag == "main" or longest > rest and (not rest or size[id(x)] == longest):
            up: Node | None = x
            while up is not None:
                up.named, up = False, up.parent
    mark()


def clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(node: Node) -> list[tuple[int, str]]:
    """(place, text) of the blocks below the node that aren't skipped, in page order."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    where = node.place

    def end() -> None:
        if parts:
            text = clean(parts)
            parts.clear()
            if text:
                out.append((where, text))

    stack: list = [iter(node.children)]
    owners = [node]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            gone = owners.pop()
            if gone.tag in BLOCK:
                end()
                where = owners[-1].place if owners else node.place
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append(" ")
        elif not x.skip:
            if x.tag in BLOCK:
                end()
                where = x.place
            stack.append(iter(x.children))
            owners.append(x)
        elif x.tag in BLOCK:
            end()
    end()
    return out


def elements(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def forms(root: Node) -> tuple[dict[int, int], dict[int, int]]:
    """For each element (by id) the hash of its subtree's labels, and its number of elements."""
    form: dict[int, int] = {}
    size: dict[int, int] = {}
    for x in reversed(elements(root)):
        below = [c for c in x.children if isinstance(c, Node)]
        form[id(x)] = hash((x.label, *(form[id(c)] for c in below)))
        size[id(x)] = 1 + sum(size[id(c)] for c in below)
    return form, size


def table(gains: np.ndarray, left: np.ndarray, right: np.ndarray, above: np.ndarray) -> Iterator[np.ndarray]:
    """The rows below ``above`` of the table that aligns two lists: the most that the children of the first so far gain with the first j of the other."""
    for k in left:
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gains[k][right]), out=row[1:])
        yield row
        above = row


def aligned(gains: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The positions that are paired, in any order, where the table keeps both lists' order and gains most. The lists are numbers of kinds, by which ``gains`` is indexed.

    Every so many rows one is kept, and those between are made again on the way back, so that long lists take no memory by their product.
    """
    step, kept, row = math.isqrt(len(left)) + 1, [], np.zeros(len(right) + 1, np.int64)
    for i, below in enumerate(table(gains, left, right, row)):
        if i % step == 0:
            kept.append(row)
        row = below
    pairs, j = [], len(right)
    for k in reversed(range(len(kept))):
        rows = [kept[k], *table(gains, left[k * step : (k + 1) * step], right, kept[k])]
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j = int(np.searchsorted(rows[i], rows[i][j]))
            else:
                i, j = i - 1, j - 1
                pairs.append((k * step + i, j))
    return pairs


def match(a: Node, b: Node, known: tuple[dict[int, int], dict[int, int]] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the number of matched pairs and the pairs. ``known``: the first tree's forms.

    What two subtrees gain follows from their labels, so it is solved once for two forms. Children whose subtrees have equal labels match as a whole, so
    those that both lists begin or end with need no table; the rest is solved from the leaves up with a stack of its own. Lists are aligned whole, whatever
    their lengths: in time by their product, by rows of numbers where that is over ``TABLE``.
    """
    if a.label != b.label:
        return 0, []
    (form_a, size), (form_b, _) = known or forms(a), forms(b)
    worth: dict[int, dict[int, int]] = defaultdict(dict)  # of the first form with the other, where their roots have one label

    def gain(c: Node, d: Node) -> int:
        own, other = form_a[id(c)], form_b[id(d)]
        return size[id(c)] if own == other else worth[own][other] if c.label == d.label else 0

    def between(x: Node, y: Node) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
        """The equal children that both begin or end with, and those between."""
        xs, ys = ([c for c in n.children if isinstance(c, Node)] for n in (x, y))
        short, head, tail = min(len(xs), len(ys)), 0, 0
        while head < short and form_a[id(xs[head])] == form_b[id(ys[head])]:
            head += 1
        while tail < short - head and form_a[id(xs[-1 - tail])] == form_b[id(ys[-1 - tail])]:
            tail += 1
        m, n = len(xs) - tail, len(ys) - tail
        return [*zip(xs[:head], ys[:head]), *zip(xs[m:], ys[n:])], xs[head:m], ys[head:n]

    def unsolved(left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        theirs: dict[str, dict[int, Node]] = defaultdict(dict)
        for d in right:
            theirs[d.label][form_b[id(d)]] = d
        mine = {form_a[id(c)]: c for c in left}
        return [(c, d) for own, c in mine.items() for other, d in theirs.get(c.label, {}).items() if own != other and other not in worth[own]]

    def few(left: list[Node], right: list[Node]) -> list[list[int]]:
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, c in enumerate(left):
            for j, d in enumerate(right):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain(c, d))
        return best

    def many(left: list[Node], right: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine, theirs = {}, {}
        rows = [mine.setdefault(form_a[id(c)], len(mine)) for c in left]
        columns = [theirs.setdefault(form_b[id(d)], len(theirs)) for d in right]
        gains = np.zeros((len(mine), len(theirs)), np.int64)
        for c, i in zip(left, rows):
            own = form_a[id(c)]
            for other, n in [*worth[own].items(), (own, size[id(c)])] if not gains[i].any() else ():
                if other in theirs:
                    gains[i, theirs[other]] = n
        return gains, np.array(rows), np.array(columns)

    def most(left: list[Node], right: list[Node]) -> int:
        if len(left) * len(right) <= TABLE:
            return few(left, right)[-1][-1]
        gains, rows, columns = many(left, right)
        row = np.zeros(len(columns) + 1, np.int64)
        for row in table(gains, rows, columns, row):  # noqa: B007
            pass
        return int(row[-1])

    def paired(left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        if len(left) * len(right) > TABLE:
            return [(left[i], right[j]) for i, j in aligned(*many(left, right))]
        best, i, j, pairs = few(left, right), len(left), len(right), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((left[i], right[j]))
        return pairs

    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        own, other = form_a[id(x)], form_b[id(y)]
        same, left, right = between(x, y) if other not in worth[own] else ([], [], [])
        if missing := unsolved(left, right):
            todo += missing
            continue
        todo.pop()
        if other not in worth[own]:
            worth[own][other] = 1 + sum(size[id(c)] for c, _ in same) + most(left, right)
    out, open_ = [], [(a, b)]
    while open_:
        x, y = open_.pop()
        out.append((x, y))
        if form_a[id(x)] == form_b[id(y)]:
            open_ += zip([c for c in x.children if isinstance(c, Node)], [c for c in y.children if isinstance(c, Node)])
        else:
            same, left, right = between(x, y)
            open_ += same + paired(left, right)
    return len(out), out


def outermost(root: Node, wanted: Callable[[Node], bool]) -> list[Node]:
    """The wanted elements in page order, without those inside others; nothing below a skipped element counts."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.skip and x.tag != "#":
            continue
        if wanted(x):
            found.append(x)
        else:
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return found


def region(root: Node, fixed: frozenset[int] | set[int] = frozenset()) -> list[Node]:
    """The elements named as main text: outermost articles, else main; those at fixed places are template and don't count."""
    articles = outermost(root, lambda x: x.tag == "article" and x.place not in fixed)
    return articles or outermost(root, lambda x: x.tag == "main" and x.place not in fixed)


def own_text(x: Node) -> str:
    """The text of the node's block: its strings and those of inline elements below it."""
    parts, todo = [], list(reversed(x.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag == "br":
            parts.append(" ")
        elif c.tag not in BLOCK and not c.skip:
            todo += reversed(c.children)
    return clean(parts)


def is_named(x: Node) -> bool:
    return x.tag in ("article", "main")


def whole_text(x: Node) -> str:
    return "\n".join(t for _, t in blocks(x))


def slots(reference: Node) -> list[Node]:
    return [x for x in elements(reference) if x.tag in BLOCK and not x.skip]


def observe(reference: Node, given: list[Node], tree: Node, known: tuple[dict[int, int], dict[int, int]] | None = None) -> list[tuple[int, str]]:
    """Of the reference's slots that the tree has: (2 * slot, own text), and of articles and main elements (2 * slot + 1, whole text)."""
    at = {id(x): k for k, x in enumerate(given)}
    found = [(at[id(a)], a, b) for a, b in match(reference, tree, known)[1] if id(a) in at]
    return [(2 * k, own_text(b)) for k, _, b in found] + [(2 * k + 1, whole_text(b)) for k, a, b in found if is_named(a)]


def decide(reference: Node, pages: int, counts: dict[int, tuple[int, int, int]]) -> dict:
    """``regions``, ``template`` and ``fixed`` as in ``induce``. counts: for the numbers of ``observe`` the pages that have the slot, those with its most frequent text,
    and the characters of all; slots without text on the reference count the pages with a text only."""
    varying: Counter = Counter()
    depth: dict[int, int] = {}
    outer: dict[str, set[int]] = {"article": set(), "main": set()}
    titled: set[int] = set()
    constant, fixed, standing, length = [], [], 0, defaultdict(int)
    everywhere = lambda n: n >= CONSTANT_SHARE * pages
    for k, x in enumerate(slots(reference)):
        if is_named(x):
            n, top, _ = counts.get(2 * k + 1, (0, 0, 0))
            whole = whole_text(x)
            if whole and everywhere(n) and top >= CONSTANT_SHARE * n:
                fixed.append(x.place)
                standing += len(whole)
            above = x.parent
            while above is not None and above.tag != x.tag:
                above = above.parent
            if above is None:
                outer[x.tag].add(x.place)
        n, top, chars = counts.get(2 * k, (0, 0, 0))
        if not chars:
            continue
        own = own_text(x)
        one = bool(own) and top >= CONSTANT_SHARE * n
        same = one and everywhere(n)
        length[same] += len(own)
        if same:
            constant.append((x.place, own))
        elif not one:
            up = x if is_named(x) else x.parent
            while up is not None:  # text counts for every element that contains it
                varying[up.place] += chars
                depth[up.place] = up.depth
                if x.tag == "h1":
                    titled.add(up.place)
                up = up.parent
    whole = varying[reference.place]
    deep = [p for p, v in varying.items() if whole and v >= REGION_SHARE * whole and depth[p] > 0]
    regions = [max([p for p in deep if p in titled] or deep, key=depth.__getitem__)] if deep else []
    for tag in ("article", "main"):
        places = [p for p in outer[tag] if varying[p]]
        if sum(varying[p] for p in places) > NAMED_SHARE * whole:
            regions = places
            break
    trusted = length[False] and length[True] <= 0.3 * (length[True] + length[False])
    return {"regions": sorted(regions), "template": constant if trusted else [], "fixed": fixed if length[False] > standing else []}


def layout(trees: list[Node]) -> dict:
    """What the first tree's alignment with all shows."""
    given, known = slots(trees[0]), forms(trees[0])
    texts: dict[int, Counter] = defaultdict(Counter)
    for tree in trees:
        for k, text in observe(trees[0], given, tree, known):
            texts[k][text] += 1
    return decide(trees[0], len(trees), {k: (sum(c.values()), max(c.values()), sum(n * len(t) for t, n in c.items())) for k, c in texts.items()})


def induce(pages: list[str]) -> dict:
    """The wrapper of a few pages of one host: ``regions`` (places whose slots vary), ``template`` (place, text) pairs, and ``fixed``: the places of articles
    and main elements that have one text on all pages while other slots vary, so that their name misleads.

    The first page is aligned with the others; those that lack its regions are of another layout and are aligned among themselves. ``wrappers`` does
    this for tables.
    """
    trees = [parse(p) for p in dict.fromkeys(pages)]
    out: dict[str, list] = {"regions": [], "template": [], "fixed": []}
    while len(trees) >= LEAST_PAGES:
        found = layout(trees)
        for name, values in found.items():
            out[name] += [v for v in values if v not in out[name]]
        trees = [t for t in trees[1:] if not outermost(t, lambda x: x.place in found["regions"])]  # noqa: B023
    return out


def shape(root: Node, depth: int) -> str:
    """Stands for the paths of the page's containers down to the depth."""
    return f"{depth}:{key(*map(str, sorted({x.place for x in elements(root) if x.depth <= depth and x.tag in CONTAINERS and not x.skip})))}"


def regions_of(root: Node, wrapper: dict) -> tuple[list[Node], set[int]]:
    """The page's elements at learnt regions, those of the host before those of its layout, and the fixed places that go with them."""
    within = lambda places: outermost(root, lambda x: x.place in places)
    found = within(set(wrapper.get("regions") or ()))
    shaped = wrapper.get("shaped") or {}
    for depth in LEVELS:
        if not found and shaped and (own := shaped.get(shape(root, depth))):
            found = within(set(own["regions"]))
            if found:
                return found, set(own["fixed"])
    return found, set(wrapper.get("fixed") or ())


def extract(page: str, wrapper: dict | None = None) -> str:
    """The main text."""
    root = parse(page)
    wrapper = wrapper or {}
    found, fixed = regions_of(root, wrapper)
    if not found or any(x.tag == "article" for x in found):  # no layout, or articles: those at places that the reference lacks are content too
        found = region(root, fixed)
    out = [b for x in (found or [root]) for b in blocks(x)]
    if any(x.tag == "article" for x in found):
        return "\n".join(t for _, t in out)
    template, keys = {tuple(t) for t in wrapper.get("template", ())}, set(wrapper.get("keys") or ())
    kept = [t for p, t in out if (p, t) not in template and not (keys and key(str(p), t) in keys)]
    return "\n".join(kept)


def hosts(pages: DataFrame) -> DataFrame:
    return only(pages, "page_id", "url", "html").withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))


def key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


def templates(named: DataFrame) -> DataFrame:
    """host, keys: the hashes of (path, text) that are template, counted over all distinct pages of a host, except those with an article."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        rows = []
        for host, text in zip(part.column(0).to_pylist(), texts, strict=True):
            page = text.decode()
            root = parse(page)
            if not page or any(x.tag == "article" for x in region(root)):
                continue
            own, seen = key(page), blocks(root)
            rows.append((host, own, 0, 0, 0, sum(len(t) for _, t in seen)))
            rows += [(host, own, 1, p, p, 0) for p in {p for p, _ in seen}]
            rows += [(host, own, 2, h, up, n) for h, (up, n) in {key(str(p), t): (p, len(t)) for p, t in seen}.items()]
        return {n: [r[k] for r in rows] for k, n in enumerate(("host", "page", "kind", "key", "path", "size"))}

    rows = map_texts(named.select("host", "html"), work, "host string, page long, kind int, key long, path long, size long", "html")
    # a kind is an aggregate and every branch uses all columns, so that the three share one shuffle and pages are parsed once
    rows = rows.where("host is not null and path is not null")
    distinct = rows.groupBy("host", "page", "key", "path").agg(F.min("size").alias("size"), F.max("kind").alias("kind"))
    counts = distinct.groupBy("host", "key", "path").agg(F.count_if(F.col("kind") >= 0).alias("n"), F.sum("size").alias("chars"), F.max("kind").alias("kind"))
    whole = counts.where("kind = 0").select("host", F.col("n").alias("pages"), F.col("chars").alias("all_chars"))
    paths = counts.where("kind = 1 and chars >= 0").select("host", "path", F.col("n").alias("with_path"))
    often = counts.where(f"kind = 2 and n >= {LEAST_PAGES}").join(paths, ["host", "path"]).where(F.col("n") >= SLOT_SHARE * F.col("with_path"))
    often = often.join(whole, "host").where(F.col("n") >= HOST_SHARE * F.col("pages"))
    found = often.groupBy("host").agg(F.collect_list("key").alias("keys"), F.sum("chars").alias("chars"), F.first("all_chars").alias("all_chars"))  # at most 1 / HOST_SHARE pages
    return found.where(F.col("chars") <= 0.3 * F.col("all_chars")).select("host", "keys")


#: References that a worker keeps parsed have at most so many characters; longer ones are parsed again for each slice of pages.
KEPT_CHARS = 200_000


def parsed(page: str) -> tuple[Node, list[Node], tuple[dict[int, int], dict[int, int]], list[str]]:
    """A reference: its tree, slots, forms and the slots' own texts."""
    root = parse(page)
    given = slots(root)
    return root, given, forms(root), list(map(own_text, given))


_known_parsed = lru_cache(32)(parsed)


def reference_of(page: str) -> tuple[Node, list[Node], tuple[dict[int, int], dict[int, int]], list[str]]:
    return (parsed if len(page) > KEPT_CHARS else _known_parsed)(page)


def beside(rows: DataFrame, keys: list[str], table: DataFrame, value: str, salt: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], list]]:
    """Rows, and what gives a batch's values of a table with one row a key: sent to the tasks if small, else joined as a further column, with a key's rows dealt over salts."""
    size = table.agg(F.count("*").alias("n"), F.sum(F.length(value)).alias("chars")).first()
    if size["n"] <= BROADCAST_HOSTS and (size["chars"] or 0) <= BROADCAST_CHARS:
        known = {tuple(r[k] for k in keys): r[value] for r in table.select(*keys, value).toArrow().to_pylist()}
        return rows, lambda part: [known.get(k) for k in zip(*(part.column(c).to_pylist() for c in keys), strict=True)]
    copies = table.select(*keys, value).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS))).join(copies, [*keys, "salt"], "left").select(*rows.columns, value)
    return joined, lambda part: part.column(value).to_pylist()


def learn(named: DataFrame, drawn: DataFrame | None, folder: str, name: str) -> DataFrame:
    """host, shape, regions, fixed from all pages of the drawn (host, shape, digest), or of each host with the shape ''; fewer than three distinct ones teach nothing."""
    pool, drawn = named.withColumn("shape", F.lit("")), None if drawn is None else drawn.distinct()
    if drawn is not None:
        pool = named.join(F.broadcast(drawn) if drawn.count() <= LEFT else drawn, ["host", "digest"])
    least = (pool.select("host", "shape", "digest").distinct() if drawn is None else drawn).groupBy("host", "shape").agg(F.min("digest").alias("digest"), F.count("*").alias("pages"))
    least = settle(least.where(f"pages >= {LEAST_PAGES}"), folder, f"{name}-least")
    few = F.broadcast(least) if least.count() <= BROADCAST_HOSTS else least  # so that pages are shuffled for more hosts only
    picked = pool.join(few, ["host", "shape", "digest"]).groupBy("host", "shape", "pages").agg(F.min("html").alias("reference"))
    picked = settle(picked.withColumn("ref", F.xxhash64("host", "shape")), folder, f"{name}-references")
    rows, given = beside(pool.select(F.xxhash64("host", "shape").alias("ref"), "digest", "html"), ["ref"], picked, "reference", "digest")

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        out, last = [], {}
        for ref, own, text, reference in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, given(part), strict=True):
            if reference is None:
                continue
            if ref not in last:
                last = {ref: reference_of(reference)}
            root, own_slots, known, first = last[ref]
            out += [(ref, own, k, key(t), len(t)) for k, t in observe(root, own_slots, parse(text.decode()), known) if k % 2 or t or first[k // 2]]
        return {n: [r[k] for r in out] for k, n in enumerate(("ref", "own", "slot", "text", "size"))}

    seen = map_texts(rows, work, "ref long, own long, slot int, text long, size int", "html").distinct()  # a page counts once
    counts = seen.groupBy("ref", "slot", "text").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    counts = counts.groupBy("ref", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum(F.col("n") * F.col("size")).alias("chars"))
    counts = counts.groupBy("ref").agg(F.collect_list(F.struct("slot", "n", "top", "chars")).alias("counts"))  # of one page's elements

    def judged(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        found = [
            decide(parse(t.decode()), pages, {c["slot"]: (c["n"], c["top"], c["chars"]) for c in counted or ()})
            for t, pages, counted in zip(texts, part.column(2).to_pylist(), part.column(4).to_pylist(), strict=True)
        ]
        return {"host": part.column(0), "shape": part.column(1), **{n: [f[n] for f in found] for n in ("regions", "fixed")}}

    whole = picked.join(counts, "ref", "left").select("host", "shape", "pages", "reference", "counts")
    return settle(map_texts(whole, judged, "host string, shape string, regions array<long>, fixed array<long>", "reference"), folder, name)


def united(learnt: DataFrame, *more: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of what was learnt, and of further columns by host."""
    out = learnt.where("shape = ''").drop("shape")
    shaped = learnt.where("shape <> ''").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("shape", F.struct("regions", "fixed")))).alias("shaped"))
    for df in (shaped, *more):
        out = out.join(df, "host", "left")
    return out.select("host", F.to_json(F.struct(*(c for c in out.columns if c != "host"))).alias("wrapper"))


def without_regions(named: DataFrame, wrapper: DataFrame, depth: int) -> DataFrame:
    """host, shape, digest of the pages without a learnt region whose host has a wrapper."""
    rows, given = beside(named.select("host", "digest", "html"), ["host"], wrapper, "wrapper", "digest")

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        known, out = given(part), []
        loaded = {g: json.loads(g) for g in set(known) if g}
        for host, own, text, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, known, strict=True):
            if g and not regions_of(root := parse(text.decode()), loaded[g])[0]:
                out.append((host, shape(root, depth), own))
        return {n: [r[k] for r in out] for k, n in enumerate(("host", "shape", "digest"))}

    return map_texts(rows, work, "host string, shape string, digest long", "html")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): regions and template, both counted over all pages. No host's pages are gathered."""
    named = hosts(pages).where("html <> ''").withColumn("digest", F.xxhash64("html")).select("host", "digest", "html")
    folder = shared_folder(pages.sparkSession)
    learnt, pool = learn(named, None, folder, "learnt"), named
    for k, depth in enumerate(LEVELS):
        left = settle(without_regions(pool, united(learnt), depth), folder, f"left-{k}")
        n = left.count()
        if n < LEAST_PAGES:
            break
        if not left.distinct().groupBy("host", "shape").count().where(f"count >= {LEAST_PAGES}").isEmpty():
            learnt = settle(learnt.union(learn(named, left, folder, f"learnt-{k}")), folder, f"united-{k}")
        if n <= LEFT:  # else all are looked at again
            pool = named.join(F.broadcast(left.select("host", "digest").distinct()), ["host", "digest"])
    return united(learnt, templates(named))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    rows, given = beside(hosts(pages), ["host"], settle(wrappers(pages), shared_folder(pages.sparkSession), "wrappers"), "wrapper", "page_id")

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        known = given(part)
        loaded = {g: json.loads(g) for g in set(known) if g}
        found = [extract(t.decode(), loaded.get(g)) for t, g in zip(texts, known, strict=True)]
        return {"page_id": part.column(0), "url": part.column(1), "text": found, "n_chars": list(map(len, found))}

    return map_texts(rows, work, "page_id long, url string, text string, n_chars long", "html")
