"""HTML extraction by wrapper induction: pages of a host are aligned by simple tree matching.

A page becomes a tree of containers and blocks. All distinct pages of a host are aligned with the reference pages of its
layouts: nodes whose text stays the same are the host's template, nodes whose text varies are slots. What is found is the
host's wrapper, and it is applied to every page of the host, so no page depends on which others it is looked at with:

* a block that is template goes, wherever it stands, also inside an article;
* the page's slot is the article or main element, or where the markup names none the least container that holds most of
  the text that is no template;
* what HTML itself marks as no main text (``nav``, ``aside``, ``footer``, forms, scripts, roles, hidden elements) goes;
* outside the slot elements whose class or id says menu, advert, notice or comments go, too. Inside it such a name counts
  only as a whole, and only if the wrapper confirms it: an element of that name recurs there on the host's pages.

A host with fewer than ``SUPPORT`` distinct pages has no wrapper; there the markup alone decides.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, release, sized

#: Reference pages that one round of learning picks on a host, at most; rounds go on until no layout is left.
SEEDS = 32
#: Distinct pages of a host that wrappers were learned from before all pages were; only a test still goes by it.
SAMPLE = 48
#: Cells of a table of children that are kept at once; a larger one is filled twice, some rows at a time.
CELLS = 1 << 24
#: A template block is the same on so many distinct pages at least, and on that share of its layout's pages.
SUPPORT, SHARE = 4, 0.6
#: An element whose name speaks of boilerplate is confirmed by so many pages.
CONFIRM = 2
#: Wrappers are broadcast up to this size, by hosts and entries; beyond it they are joined.
BROADCAST_BYTES = 32 << 20

_SET = lambda s: frozenset(s.split())
VOID = _SET("area base br col embed hr img input link meta param source track wbr")
RAW = _SET("script style textarea title xmp iframe noembed noframes")
BLOCK = _SET(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul"
)
NOT_TEXT = _SET("script style noscript template head title nav footer aside form iframe svg math canvas object embed audio video select button input textarea dialog menu search noembed noframes map datalist progress meter")
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An element that its own kind, starting, ends; and where the search for it stops.
ENDS_OWN = {"li": _SET("ul ol menu dir"), "dt": _SET("dl"), "dd": _SET("dl"), "tr": _SET("table"), "td": _SET("table tr"), "th": _SET("table tr"), "option": _SET("select")}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menu|side-?bar|footer|header|masthead|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|banner|ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|"
    r"share|sharing|social|comments?|respond|replies|disqus|related|recommend(?:ed|ations)?|newsletter|subscribe|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|skip-?link|tags|hidden|visually-hidden|sr-only)(?:$|[\s_-])",
    re.I,
)
HEADINGS = _SET("h1 h2 h3 h4 h5 h6")
ROLES = _SET("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar")
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "name", "role", "skip", "loose", "whole", "kids", "text", "label", "size", "key")

    def __init__(self, tag: str, name: str = "", role: str = "", skip: bool = False) -> None:
        self.tag, self.name, self.role, self.skip = tag, name, role, skip
        self.loose = self.whole = False  # whether the name speaks of boilerplate: somewhere in it, as a whole class or id
        self.kids: list[Node] = []
        self.text: str | None = None  # of a block: its text
        self.label = (tag, name)
        self.size, self.key = 0, 0  # of all text below; a hash of the labels from the root on, and of a block's text


def _open(tag: str, attrs: str, inside: bool) -> Node:
    got = {}
    if attrs and attrs != "/":
        for k, a, b, c in ATTR.findall(attrs):
            got.setdefault(k.lower(), a or b or c)
    name = f"{got.get('class', '')} {got.get('id', '')}".strip()
    role = got.get("role", "").lower()
    skip = tag in NOT_TEXT or role in ROLES or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    if tag == "header" and not inside:  # an article's own header holds its title
        skip = True
    node = Node(tag, name, role, skip)
    if name and tag not in ("html", "body", "main", "article"):
        node.loose = NAMED.search(name) is not None
        # a heading's id is a slug of its words
        node.whole = node.loose and any(NAMED.fullmatch(x) for x in [*(got.get("class") or "").split(), *([] if tag in HEADINGS else (got.get("id") or "").split())])
    if node.whole and tag not in BLOCK:  # a part of a line: it is not held against other pages
        node.skip = True
    return node


def parse(html: str) -> Node:
    """The tree of containers and blocks. Blocks hold text; inline elements have become part of theirs."""
    root = Node("#root")
    stack: list[Node] = [root]
    words: list[str] = []
    at, n = 0, len(html)

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                block = Node("#text", stack[-1].label[0])
                block.text, block.size = text, len(text)
                # a block's label is that of the elements around it
                block.label = ("#text", *(x for s in stack[-2:] for x in s.label))
                next(s for s in reversed(stack) if s.tag in BLOCK or s is root or s.skip).kids.append(block)

    def close(upto: int) -> None:
        if any(s.tag in BLOCK or s.skip for s in stack[upto:]):
            flush()
        del stack[upto:]

    while at < n:
        m = TAG.search(html, at)
        if not m:
            words.append(unescape(html[at:]))
            break
        if m.start() > at:
            words.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[0].startswith("<![CDATA["):
            words.append(m[0][9:].removesuffix("]]>"))
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("article", "main", "table") and tag not in BLOCK:
                    break
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ENDS_OWN:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag in ("td", "th", "dt", "dd") and stack[i].tag in ("td", "th", "dt", "dd")):
                    close(i)
                    break
                if stack[i].tag in ENDS_OWN[tag]:
                    break
        if tag in BLOCK:
            flush()
        if tag in VOID:
            if tag != "wbr":
                words.append(" ")
            continue
        node = _open(tag, m[3], any(s.tag in ("article", "main") for s in stack))
        if node.skip:
            flush()
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK or node.skip:
            next(s for s in reversed(stack) if s.tag in BLOCK or s is root or s.skip).kids.append(node)
        stack.append(node)
    flush()
    _measure(root)
    return root


def _measure(root: Node) -> None:
    order = [root]
    for x in order:
        order.extend(x.kids)
        for k in x.kids:
            k.key = xxhash.xxh64_intdigest("\0".join(k.label) if k.text is None else "\0".join((*k.label, "\0", k.text)), x.key)
    for x in reversed(order):
        if x.kids:
            x.size = sum(k.size for k in x.kids)


def match(a: Node, b: Node, known: dict | None = None) -> int:
    """Simple tree matching: the most nodes that two trees share in order, if their roots have the same label.

    Blocks weigh one, and one more if their texts are equal. ``known`` keeps, for each two nodes compared, their weight
    and which of their children match, so that no two are compared twice. The children's table is filled a row at a time.
    """
    known = {} if known is None else known
    if a.label != b.label:
        return 0
    if (id(a), id(b)) in known:
        return known[id(a), id(b)][0]
    kids: list[tuple[Node, Node]] = []
    weight = 1
    if a.text is not None or b.text is not None:
        weight += a.text == b.text
    elif a.kids and b.kids:
        got, kids = (_match_few if len(a.kids) * len(b.kids) <= 64 else _match_many)(a.kids, b.kids, known)
        weight += got
    known[id(a), id(b)] = weight, kids
    return weight


def _match_many(xs: list[Node], ys: list[Node], known: dict) -> tuple[int, list[tuple[Node, Node]]]:
    """The same for many children, a row at a time, in bounded memory: of a large table only some rows are kept, and the
    rows between two of them are filled again on the way back."""
    n, m = len(xs), len(ys)
    weigh = _weights(xs, ys, known)

    def below(last: np.ndarray, i: int) -> np.ndarray:
        row = np.zeros(m + 1, dtype=np.int32)
        row[1:] = np.maximum.accumulate(np.maximum(last[1:], last[:-1] + weigh(i)))
        return row

    step, last = n if n * m <= CELLS else isqrt(n) + 1, np.zeros(m + 1, dtype=np.int32)
    starts = [last]
    for i in range((n - 1) // step * step):
        last = below(last, i)
        if (i + 1) % step == 0:
            starts.append(last)
    total, kids, i, j = None, [], n, m
    while i and j:
        first = (i - 1) // step * step
        last = starts[first // step]
        above = np.empty((i - first, m + 1), dtype=bool)  # whether a cell's value is that above it
        left = np.zeros((i - first, m + 1), dtype=bool)  # and whether it is that to its left
        for r in range(first, i):
            row = below(last, r)
            above[r - first], left[r - first, 1:] = row == last, row[1:] == row[:-1]
            last = row
        total = int(last[m]) if total is None else total
        while i > first and j:
            if above[i - 1 - first, j]:
                i -= 1
            elif left[i - 1 - first, j]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                kids.append((xs[i], ys[j]))
    return total or 0, kids


def _weights(xs: list[Node], ys: list[Node], known: dict) -> Callable[[int], np.ndarray]:
    """The weights of one of ``xs`` with all ``ys``. Containers that share no text weigh what their shapes do, so each two
    shapes are compared once; those that share some are compared once for each two contents, as far as both sides have it."""
    numbers: dict = {}
    la, lb = (np.array([numbers.setdefault(k.label, len(numbers)) for k in x]) for x in (xs, ys))
    ta, tb = (np.array([numbers.setdefault((k.label, k.text), len(numbers)) if k.text is not None else -i - 1 for i, k in enumerate(x)]) for x in (xs, ys))
    both = set().union(*map(_texts, xs)) & set().union(*map(_texts, ys))
    alike, places = [_forms(x, both) for x in xs], [_forms(y, both) for y in ys]
    shapes: dict[int, list[int]] = {}
    contents: dict[int, list[int]] = {}
    holds: dict = {}
    for j, y in enumerate(ys):
        if y.kids:
            shapes.setdefault(places[j][0], []).append(j)
            contents.setdefault(places[j][1], []).append(j)
            for t in _texts(y) & both:
                holds.setdefault(t, set()).add(places[j][1])
    at = {form: np.array(js) for forms in (shapes, contents) for form, js in forms.items()}

    def weight(i: int, j: int, kind: int) -> int:
        pair = (kind, alike[i][kind], places[j][kind])
        if pair not in known:
            known[pair] = match(xs[i], ys[j]) if kind else match(_bare(xs[i]), _bare(ys[j]))
        return known[pair]

    def weigh(i: int) -> np.ndarray:
        x, w = xs[i], (la[i] == lb).astype(np.int32)
        if x.text is not None:
            w += ta[i] == tb
        elif x.kids:
            for form, js in shapes.items():
                if ys[js[0]].label == x.label:
                    w[at[form]] = weight(i, js[0], 0)
            for form in {form for t in _texts(x) & both for form in holds.get(t, ())}:
                if ys[contents[form][0]].label == x.label:
                    w[at[form]] = weight(i, contents[form][0], 1)
        return w

    return weigh


def _forms(x: Node, both: set) -> tuple[int, int]:
    """Hashes of a tree's labels, and of its labels and those texts."""
    shape: dict[int, int] = {}
    content: dict[int, int] = {}
    for y in reversed(list(_walk(x))):
        shape[id(y)] = hash((0, y.label, y.text is None, *(shape[id(k)] for k in y.kids)))
        content[id(y)] = hash((1, y.label, y.text if (y.label, y.text) in both else y.text is None, *(content[id(k)] for k in y.kids)))
    return shape[id(x)], content[id(x)]


def _texts(x: Node) -> set:
    return {(y.label, y.text) for y in _walk(x) if y.text is not None}


def _bare(x: Node) -> Node:
    """A copy with texts that no other block has."""
    copies = {id(y): Node("") for y in _walk(x)}
    for y in _walk(x):
        c = copies[id(y)]
        c.label, c.text, c.kids = y.label, None if y.text is None else object(), [copies[id(k)] for k in y.kids]
    return copies[id(x)]


def _match_few(xs: list[Node], ys: list[Node], known: dict) -> tuple[int, list[tuple[Node, Node]]]:
    """The table for a few children, cell by cell: its last value and the children that match."""
    best = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = best[-1], [0]
        for j, y in enumerate(ys):
            w = 0
            if x.label == y.label:
                w = 1 + (x.text == y.text) if x.text is not None and y.text is not None else match(x, y, known)
            row.append(max(above[j + 1], row[j], above[j] + w))
        best.append(row)
    kids, i, j = [], len(xs), len(ys)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            kids.append((xs[i], ys[j]))
    return best[-1][-1], kids


def aligned(a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
    """The nodes that two trees share in a largest match."""
    known: dict = {}
    todo = [(a, b)] if match(a, b, known) else []
    while todo:
        x, y = todo.pop()
        yield x, y
        if x.kids and y.kids:
            match(x, y, known)
            todo.extend(known[id(x), id(y)][1])


def _named_slot(root: Node) -> Node | None:
    """The largest article or main element that is not part of what never counts."""
    found, todo = None, [root]
    while todo:
        x = todo.pop()
        if x.skip:
            continue
        if (x.tag in ("article", "main") or x.role in ("main", "article")) and (found is None or x.size > found.size):
            found = x
        todo.extend(x.kids)
    if found is not None and found.tag == "main":  # an article in it says more, if it holds most of the text
        inner = [y for y in _walk(found) if y.tag == "article" and not y.skip and 2 * y.size > found.size]
        found = max(inner, key=lambda y: y.size, default=found)
    return found


def _walk(x: Node) -> Iterator[Node]:
    todo = [x]
    while todo:
        y = todo.pop()
        yield y
        todo.extend(reversed(y.kids))


class Wrapper:
    """What a host's pages have in common: keys of template blocks, and of elements whose names are confirmed."""

    __slots__ = ("template", "confirmed")

    def __init__(self, template: frozenset[int] = frozenset(), confirmed: frozenset[int] | None = None) -> None:
        self.template, self.confirmed = template, confirmed  # no keys, as of too few pages: every name counts

    def drops(self, x: Node, inside: bool) -> bool:
        """Whether an element never counts, inside the slot or outside."""
        if x.skip or not x.loose:
            return x.skip
        return not inside or (x.whole and (self.confirmed is None or x.key in self.confirmed))


def _way_to_slot(root: Node, w: Wrapper) -> list[Node]:
    """The way down to the least container that holds most of the text that varies and stands under no name of boilerplate."""
    for names in (True, False):  # a page may stand under such a name as a whole
        live: dict[int, int] = {}
        order = [root]
        for x in order:
            order.extend(k for k in x.kids if not k.skip and not (names and k.loose))
        for x in reversed(order):
            own = len(x.text) if x.text is not None and x.key not in w.template else 0
            live[id(x)] = own + sum(live.get(id(k), 0) for k in x.kids)
        if total := live[id(root)]:
            way = [root]
            while (inner := next((k for k in way[-1].kids if k.text is None and 2 * live.get(id(k), 0) > total), None)) is not None:
                way.append(inner)
            return way
    return [root]


def _kept(start: Node, way: list[Node], w: Wrapper) -> Iterator[Node]:
    """The blocks from ``start`` on, in page order, under no element that is dropped. ``way`` leads to the slot, its last
    element, through elements that count whatever their names."""
    slot, on_way = way[-1], {id(x) for x in way}
    todo = [(start, start is slot)]
    while todo:
        x, inside = todo.pop()
        if x.text is not None:
            yield x
        todo.extend((k, inside or k is slot) for k in reversed(x.kids) if id(k) in on_way or not w.drops(k, inside))


def main_text(root: Node, w: Wrapper) -> str:
    """The blocks of the slot that are no template; beside a slot that the markup doesn't name, those of the whole page.

    A named slot that is template throughout stands for no content: then the page's other blocks count, or if there are
    none, all that the slot holds.
    """
    named = _named_slot(root)
    blocks = list(_kept(named, [named], w)) if named else []
    varies = [b for b in blocks if b.key not in w.template]
    if not varies:
        varies = [b for b in _kept(root, _way_to_slot(root, w), w) if b.key not in w.template]
    return "\n".join(b.text for b in varies or blocks)


def _live(root: Node) -> dict[int, Node]:
    """The blocks that no markup drops."""
    out, todo = {}, [root]
    while todo:
        x = todo.pop()
        if x.text is not None:
            out[id(x)] = x
        todo.extend(k for k in x.kids if not k.skip)
    return out


def _depth(root: Node) -> int:
    deep, level = 0, [root]
    while level:
        deep, level = deep + 1, [k for x in level for k in x.kids]
    return deep


class Reference:
    """A page that others of its host are matched with; its blocks that no markup drops are numbered."""

    def __init__(self, root: Node) -> None:
        self.root, self.nodes = root, sum(1 for _ in _walk(root))
        self.live = list(_live(root).values())
        self.places = {id(x): i for i, x in enumerate(self.live)}
        self.labels = Counter(x.label for x in self.live)
        self.frames = 3 * _depth(root) + 1_000  # matching goes down the tree by recursion

    def meet(self, t: Node) -> list[int] | None:
        """Twice the number of each block that aligns with one of the page, and one if their texts are equal; None if
        under half of the blocks of either do: the page has another layout. What markup drops has no say in that."""
        least = min(len(self.live), len(_live(t)))
        labels = Counter(y.label for y in _walk(t) if y.text is not None)
        if 2 * sum(min(n, labels[k]) for k, n in self.labels.items()) < least:  # only blocks of the same label align
            return None
        sys.setrecursionlimit(max(sys.getrecursionlimit(), self.frames))
        at = [2 * self.places[id(x)] + (x.text == y.text) for x, y in aligned(self.root, t) if id(x) in self.places]
        return at if 2 * len(at) >= least else None


def _blocks(root: Node) -> tuple[dict[int, int], int]:
    """Of the blocks that no markup drops: their keys, with those of their labels, and the label that most text has."""
    keys, sizes = {}, {0: 0}
    for label, x in _labelled(root):
        keys[x.key] = label
        sizes[label] = sizes.get(label, 0) + x.size
    return keys, max(sizes, key=lambda k: (sizes[k], k))


def _labelled(root: Node) -> Iterator[tuple[int, Node]]:
    """The blocks that no markup drops, with hashes of their labels from the root on."""
    todo = [(root, 0)]
    while todo:
        x, above = todo.pop()
        if x.text is not None:
            yield _label_key(x, above), x
        todo.extend((k, x.key) for k in x.kids if not k.skip)


def _label_key(x: Node, above: int) -> int:
    return x.key if x.text is None else xxhash.xxh64_intdigest("\0".join(x.label), above)


def induce(trees: dict[int, Node]) -> Wrapper:
    """The wrapper of the distinct pages of one host, by their hashes; ``learn_wrappers`` does the same for all hosts.

    A round takes references for the labels under which most of the pages left have most of their text: one in the first,
    then ever more at once. Of such pages, if they hold a block found on ``SUPPORT`` of those left, it is one that has most
    blocks which half of the pages with their label share, and of these that of median size. A page belongs to the first
    reference that shares half of its blocks, or of its own, with it; pages of no reference, and those of one that belongs
    to another itself, are left for the next round. Rounds end when nothing is found on ``SUPPORT`` of the pages left.

    A block is template if it is the same on ``SUPPORT`` pages and on the ``SHARE`` of its layout's. Pages that agree in nine
    tenths of what nearly all pages do not share are copies, and tell no template from content; neither do pages that agree
    in everything.
    """
    if len(trees) < SUPPORT:
        return Wrapper()
    names: dict[int, int] = {}
    for t in trees.values():
        for k in {x.key for x in _walk(t) if x.whole}:
            names[k] = names.get(k, 0) + 1
    template: set[int] = set()
    rest = dict(trees)
    for turn in count():
        held = {h: _blocks(t) for h, t in rest.items()}
        n = Counter(k for keys, _ in held.values() for k in keys)
        labels = Counter(k for keys, _ in held.values() for k in set(keys.values()))
        classes: dict[int, list[tuple[int, int, int]]] = {}
        for h, (keys, main) in held.items():
            often = [2 * n[k] >= labels[label] for k, label in keys.items() if n[k] >= SUPPORT]
            if often:
                classes.setdefault(_sign(main), []).append((sum(often), rest[h].size, h))
        if not classes:
            break
        seeds: dict[int, Reference] = {}
        for main in sorted(classes, key=lambda k: (-len(classes[k]), k))[: min(1 << turn, SEEDS)]:
            most = max(classes[main])[0]
            sizes = sorted(size for c, size, _ in classes[main] if c == most)
            low, high = sizes[(len(sizes) - 1) // 2], sizes[len(sizes) // 2]
            h = min((abs(size - (low + high) / 2), h) for c, size, h in classes[main] if c == most)[1]
            seeds[h] = Reference(rest[h])
        first: dict[int, tuple[int, list[int]]] = {}
        for h, t in rest.items():
            met = next(((s, at) for s, r in seeds.items() if (at := r.meet(t)) is not None), None)
            if met:
                first[h] = met
        first = {h: (s, at) for h, (s, at) in first.items() if first[s][0] == s}
        for s, r in seeds.items():
            if s in first:
                alike = [[(r.live[x >> 1], bool(x & 1)) for x in at] for h, (to, at) in first.items() if to == s and h != s]
                template |= _constant({id(x): x for x in r.live}, alike)
        rest = {h: t for h, t in rest.items() if h not in first}
    return Wrapper(frozenset(template), frozenset(k for k, c in names.items() if c >= CONFIRM))


def _constant(live: dict[int, Node], alike: list[list[tuple[Node, bool]]]) -> set[int]:
    """The keys of the seed's blocks that stay the same on the pages aligned with it."""

    def same(pages: list[list[tuple[Node, bool]]], share: float) -> set[int]:
        n: dict[int, int] = {}
        for pairs in pages:
            for x, equal in pairs:
                n[id(x)] = n.get(id(x), 1) + equal  # the seed's own
        return {i for i, equal in n.items() if equal >= SUPPORT and equal >= share * (len(pages) + 1)}

    common = same(alike, 0.9)
    own = sum(x.size for i, x in live.items() if i not in common)
    apart = [pairs for pairs in alike if 10 * sum(x.size for x, equal in pairs if equal and id(x) not in common) <= 9 * own]
    found = same(apart, SHARE)
    return {live[i].key for i in found} if len(found) < len(live) else set()


def extract_group(pages: list[str | None]) -> list[str]:
    """The main texts of pages of one host, by the wrapper that they give."""
    trees = [parse(h or "") for h in pages]
    w = induce({_sign(xxhash.xxh64_intdigest(h, 42)): t for h, t in zip(pages, trees, strict=True) if h})
    return [main_text(t, w) for t in trees]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _sign(k: int) -> int:
    return k - (1 << 64) if k >> 63 else k


def _signed(keys: Iterable[int]) -> list[int]:
    return sorted(map(_sign, keys))


_FIELDS = (("deep", "<u4"), ("label", "<u8"), ("text", "<u8"), ("size", "<u4"), ("flags", "u1"))


def _pack(root: Node) -> bytes:
    """A tree without its words: of each node, in page order, depth, hashes of labels and text, size, and what counts."""
    rows, todo = [], [(root, 0, 0)]
    while todo:
        x, deep, above = todo.pop()
        rows.append((deep, _label_key(x, above), x.key, min(x.size, (1 << 32) - 1), 4 * (x.text is not None) + 2 * x.whole + x.skip))
        todo.extend((k, deep + 1, x.key) for k in reversed(x.kids))
    return b"".join(np.array(c, dtype=kind).tobytes() for c, (_, kind) in zip(zip(*rows, strict=True), _FIELDS, strict=True))


def _unpack(data: bytes) -> Node:
    n, at, columns = len(data) // 25, 0, []
    for _, kind in _FIELDS:
        columns.append(np.frombuffer(data, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    way: list[Node] = []
    for deep, label, key, size, flags in zip(*columns, strict=True):
        x = Node("", skip=bool(flags & 1))
        x.label, x.key, x.size, x.whole = label, key, size, bool(flags & 2)
        if flags & 4:
            x.text = key
        del way[deep:]
        if way:
            way[-1].kids.append(x)
        way.append(x)
    return way[0]


def _trees(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``host, h, size, main, keys, labels, names, tree``: each distinct page that is not empty, its tree packed, with what
    ``_blocks`` gives and the keys of its elements whose names speak of boilerplate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                rows: list[tuple] = []
                for html in some.column(2).to_pylist():
                    t = parse(html)
                    keys, main = _blocks(t)
                    rows.append((t.size, _sign(main), [*map(_sign, keys)], [*map(_sign, keys.values())], _signed({x.key for x in _walk(t) if x.whole}), _pack(t)))
                kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary())
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *made], ["host", "h", "size", "main", "keys", "labels", "names", "tree"])
            release()

    p = pages.where(F.octet_length(html_col) > 0).select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    return p.mapInArrow(run, "host string, h bigint, size bigint, main bigint, keys array<bigint>, labels array<bigint>, names array<bigint>, tree binary").dropDuplicates(["host", "h"])


def _seeds(rest: DataFrame, turn: int, hosts: int) -> DataFrame:
    """``host, h, rank``: the references of a round, of so many hosts at most. See ``induce``."""
    by_host = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")  # noqa: E731  else pages would go to their hosts
    labels = rest.select("host", F.explode(F.array_distinct("labels")).alias("label")).groupBy("host", "label").agg(F.count("*").alias("n"))
    held = rest.select("host", "h", "size", "main", F.explode(F.arrays_zip("keys", "labels")).alias("x")).select("host", "h", "size", "main", "x.keys", "x.labels")
    often = held.groupBy("host", F.col("keys").alias("key")).agg(F.count("*").alias("c"), F.first("labels").alias("label")).where(F.col("c") >= SUPPORT)
    often = materialize(often.join(labels, ["host", "label"]).select("host", "key", (2 * F.col("c") >= F.col("n")).cast("int").alias("wide")), "often")
    own = held.withColumnRenamed("keys", "key").join(sized(often, often.count()), ["host", "key"]).groupBy("host", "main", "h", "size").agg(F.sum("wide").alias("wide"))
    own = materialize(own, "candidates")
    n = min(1 << turn, SEEDS)
    best = own.groupBy("host", "main").agg(F.count("*").alias("n"), F.max("wide").alias("wide"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "main")) - 1).where(F.col("rank") < n).drop("n")
    best = materialize(best, "classes")
    own = own.join(by_host(best, hosts * n), ["host", "main", "wide"])
    near = own.join(by_host(own.groupBy("host", "rank").agg(F.percentile("size", 0.5).alias("q")), hosts * n), ["host", "rank"])
    return materialize(near.groupBy("host", "rank").agg(F.min(F.struct(F.abs(F.col("size") - F.col("q")), "h"))["h"].alias("h")), "seeds")


def _light(df: DataFrame, cost: Column) -> DataFrame:
    """``df`` for a join with pages: broadcast up to ``BROADCAST_BYTES``, beyond that merged, which AQE can split."""
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(cost + 128), F.lit(0))).first()[0] <= BROADCAST_BYTES else df.hint("merge")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches pages with a reference of their host. The reference's own row tells of its blocks."""
    known: dict[tuple[str, int], Reference] = {}
    nodes = 0
    for b in batches:
        for start in range(0, b.num_rows, 500):
            some = b.slice(start, 500)
            at, sizes, keys = [], [], []
            for i, (host, h, rank, seed) in enumerate(zip(*(some.column(c).to_pylist() for c in range(4)), strict=True)):
                r = known.get((host, rank))
                if r is None:
                    if nodes > 500_000:
                        known.clear()
                        nodes = 0
                    r = known[host, rank] = Reference(_unpack(some.column(5)[i].as_py()))
                    nodes += r.nodes
                at.append(r.meet(_unpack(some.column(4)[i].as_py())))
                sizes.append([x.size for x in r.live] if h == seed else None)
                keys.append([_sign(x.key) for x in r.live] if h == seed else None)
            made = [pa.array(at, pa.list_(pa.int32())), *(pa.array(x, pa.list_(pa.int64())) for x in (sizes, keys))]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in range(4)), *made], ["host", "h", "rank", "seed", "at", "sizes", "keys"])
        release()


def _counts(alike: DataFrame, share: float) -> DataFrame:
    """``host, rank, i``: the blocks of references that are the same on ``SUPPORT`` pages, the reference among them, and on
    that share of all pages of the layout."""
    pages = alike.groupBy("host", "rank").agg((F.count("*") + 1).alias("pages"))
    n = alike.select("host", "rank", F.explode("at").alias("x")).groupBy("host", "rank", F.shiftright("x", 1).alias("i"))
    n = n.agg((F.sum(F.col("x").bitwiseAND(1)) + 1).alias("equal")).where(F.col("equal") >= SUPPORT).join(pages, ["host", "rank"])
    return n.where(F.col("equal") >= F.lit(share) * F.col("pages")).select("host", "rank", "i")


def _template(met: DataFrame) -> DataFrame:
    """``host, key``: the template blocks of a round's references. See ``_constant``."""
    alike = met.where("h <> seed").select("host", "rank", "at")
    blocks = met.where("h = seed").select("host", "rank", F.posexplode(F.arrays_zip("sizes", "keys")).alias("i", "of")).select("host", "rank", "i", "of.sizes", "of.keys")
    blocks = materialize(blocks, "blocks")
    own = blocks.join(_counts(alike, 0.9).withColumn("common", F.lit(True)), ["host", "rank", "i"], "left")
    own = own.select("host", "rank", F.struct("i", F.when(F.col("common"), 0).otherwise(F.col("sizes")).alias("n")).alias("x")).groupBy("host", "rank").agg(F.sort_array(F.collect_list("x"))["n"].alias("own"))
    own = materialize(own, "own")
    pages = alike.join(_light(own, F.size("own") * 8), ["host", "rank"])
    total = lambda c, n: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + n(x))
    agreed = total(F.filter("at", lambda x: x.bitwiseAND(1) == 1), lambda x: F.col("own")[F.shiftright(x, 1)])
    apart = pages.where(10 * agreed <= 9 * total(F.col("own"), lambda x: x))
    found = blocks.join(_counts(apart, SHARE).withColumn("found", F.lit(True)), ["host", "rank", "i"], "left")
    found = found.groupBy("host", "rank").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("found"), F.col("keys"))).alias("keys"))
    return found.where(F.size("keys") < F.col("n")).select("host", F.explode("keys").alias("key"))


def learn_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, template, confirmed``: the wrapper of each host with at least ``SUPPORT`` distinct pages, as ``induce`` gives.

    It is learned from all of them, whatever their size. Pages are parsed, and matched with the references of their host,
    where they are read; what they agree in is counted by host, reference and block before it is shuffled, so a host of any
    size is many tasks. A round of references is a few jobs; hosts of few layouts need one or two.
    """
    trees = materialize(_trees(pages, url_col, html_col), "page-trees")
    hosts = trees.groupBy("host").count().where(F.col("count") >= SUPPORT).select("host")
    n_hosts = hosts.count()
    named = trees.select("host", F.explode("names").alias("key")).groupBy("host", "key").count().where(F.col("count") >= CONFIRM)
    keys = [named.select("host", F.lit(None).cast("bigint").alias("t"), F.col("key").alias("c"))]
    rest = trees.drop("names")
    for turn in count():
        seeds = _seeds(rest, turn, n_hosts)
        n = seeds.count()
        if not n:
            break
        refs = rest.join(sized(seeds, n), ["host", "h"]).select("host", "rank", F.col("h").alias("seed"), F.col("tree").alias("ref"))
        refs = materialize(refs, "references")
        pairs = rest.select("host", "h", "tree").join(_light(refs, F.octet_length("ref")), "host").select("host", "h", "rank", "seed", "tree", "ref")
        met = materialize(pairs.mapInArrow(_meet, "host string, h bigint, rank int, seed bigint, at array<int>, sizes array<bigint>, keys array<bigint>"), "met")
        first = met
        if turn:  # a page belongs to the first reference like it, if that one belongs to no other
            own = F.struct("rank", "seed", "at", "sizes", "keys")
            first = met.groupBy("host", "h").agg(F.min(F.when(F.col("at").isNotNull(), own)).alias("own")).select("host", "h", "own.*")
            good = first.where("h = seed").select("host", "rank", F.lit(True).alias("good"))
            first = first.join(sized(good, n), ["host", "rank"], "left")
            first = materialize(first.withColumn("at", F.when(F.col("good"), F.col("at"))).drop("good"), "first")
        keys.append(materialize(_template(first.where(F.col("at").isNotNull())), "template").select("host", F.col("key").alias("t"), F.lit(None).cast("bigint").alias("c")))
        left = materialize(first.where(F.col("at").isNull()).select("host", "h"), "left")
        rest = materialize(rest.join(sized(left, left.count()), ["host", "h"], "left_semi"), "rest")
    found = keys[0]
    for k in keys[1:]:
        found = found.unionByName(k)
    found = found.groupBy("host").agg(F.collect_set("t").alias("template"), F.collect_set("c").alias("confirmed"))
    none = F.array().cast("array<bigint>")
    return hosts.join(found, "host", "left").select("host", F.coalesce("template", none).alias("template"), F.coalesce("confirmed", none).alias("confirmed"))


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each page, its blocks joined by one line feed.

    Null or empty html: empty text. Null urls and urls without a host: one host. Repeated rows: each its own text.
    Null ids: kept as they are. Empty table: no rows. No page moves to its host; the wrappers, a few keys a host, meet
    the pages where these are read, by a broadcast if their size allows, else by a join that AQE can split.
    """
    wrappers = materialize(learn_wrappers(pages, url_col, html_col), "wrappers").withColumnRenamed("host", "__host")
    n, keys = wrappers.agg(F.count("*"), F.coalesce(F.sum(F.size("template") + F.size("confirmed")), F.lit(0))).first()
    if n * 128 + keys * 8 <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    ready = p.join(wrappers, F.col("host") == F.col("__host"), "left").select("id", "url", "html", "__host", "template", "confirmed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper] = {None: Wrapper()}

        def text(at: int, b: pa.RecordBatch) -> str:
            host = b.column(3)[at].as_py()
            w = known.get(host)
            if w is None:
                if len(known) > 1_000:
                    known.clear()
                    known[None] = Wrapper()
                w = known[host] = Wrapper(*(frozenset(k % (1 << 64) for k in b.column(c)[at].as_py()) for c in (4, 5)))
            return main_text(parse(b.column(2)[at].as_py() or ""), w)

        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([text(i, some) for i in range(some.num_rows)], pa.string())], ["page_id", "url", "text"])
            release()

    kinds = dict(pages.dtypes)
    out = ready.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
