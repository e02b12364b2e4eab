"""Wrappers: union-free regular expressions over the token streams of pages, inferred by alignment.

A stream is the nested sequence of a page's block tags and text slots, every tag closed. An expression has the same form;
besides, an item may be optional, and runs of items of one list may be loops, (X Y)+. There are no alternatives. Two
streams are aligned by `embedding`: the match of one's items with the other's, in order and with returns along loops, that
covers the most items at all depths. A mismatch is settled as one of two: an item that only one side has becomes
optional; where that leaves equal neighbours, or equal sequences of neighbours, these are one repeated group. A list that
has more than WIDEST items after that is generalised to one loop over its kinds of items, each optional, so that an
expression is bounded by the kinds of items, however many streams go in.
"""

from __future__ import annotations

import json
import re

WIDEST = 64
#: Elements of running text: equal neighbours of these are a repeated group in one page already. Others repeat where pages differ in their number, or from four on.
FLOW = frozenset("# <p> <li> <tr> <td> <th> <dd> <dt> <blockquote> <pre> <h2> <h3> <h4> <h5> <h6> <figure> <ul> <ol> <dl> <table>".split())
ALWAYS = 4


class Item:
    """A text slot (kids is None) or an element; refs are a page's blocks that stand in a slot, or a slot's own number."""

    __slots__ = ("name", "kids", "loops", "optional", "refs")

    def __init__(self, name: str, kids: list[Item] | None = None, loops: list[tuple[int, int]] | None = None, optional: bool = False):
        self.name, self.kids, self.loops, self.optional, self.refs = name, kids, loops or [], optional, []


def text_slot() -> Item:
    return Item("#")


def flows(name: str) -> bool:
    return name in FLOW or (name[:1] == "<" and "." in name and name.split(".")[0] + ">" in FLOW)


def encoded(root: Item) -> str:
    def code(x: Item):
        if x.kids is None:
            return 1 if x.optional else 0
        return [x.name, int(x.optional), [code(k) for k in x.kids], x.loops]

    return json.dumps(code(root), separators=(",", ":"))


def decoded(text: str) -> Item:
    def item(x) -> Item:
        if isinstance(x, int):
            return Item("#", None, None, bool(x))
        return Item(x[0], [item(k) for k in x[2]], [(s, e) for s, e in x[3]], bool(x[1]))

    return item(json.loads(text))


def slots(root: Item) -> list[Item]:
    """The text slots, in order."""
    out: list[Item] = []

    def walk(x: Item) -> None:
        if x.kids is None:
            out.append(x)
        else:
            for k in x.kids:
                walk(k)

    walk(root)
    return out


def size(x: Item) -> int:
    return 1 + sum(size(k) for k in x.kids or ())


def _reach(n: int, loops: list[tuple[int, int]]) -> list[int]:
    """After item j - 1: the first item that can come next."""
    return [min([j, *(s for s, e in loops if s < j <= e + 1)]) for j in range(n + 1)]


def embedding(page: list[Item], wide: list[Item], loops: list[tuple[int, int]], memo: dict | None = None) -> tuple[int, list[int]]:
    """How many items of page, at all depths, find a place in wide; and the place of each of page's own items (-1: none)."""
    memo = {} if memo is None else memo
    key = (id(page), id(wide))
    if key in memo:
        return memo[key]
    n, m = len(page), len(wide)
    where: dict[str, list[int]] = {}
    for j, x in enumerate(wide):
        where.setdefault(x.name, []).append(j)

    def gain(i: int, j: int) -> int:
        if page[i].kids is None:
            return 1
        return 1 + embedding(page[i].kids, wide[j].kids, wide[j].loops, memo)[0]

    reach = _reach(m, loops)
    best = [[0] * (m + 1)]  # best[-1 - i]: for page[i:], by the place in wide
    for i in range(n - 1, -1, -1):
        after = best[-1]
        raw = [-1] * (m + 1)
        for j in where.get(page[i].name, ()):
            raw[j] = gain(i, j) + after[j + 1]
        for j in range(m - 1, -1, -1):
            raw[j] = max(raw[j], raw[j + 1])
        best.append([max(after[j], raw[reach[j]]) for j in range(m + 1)])
    best.reverse()
    at, state = [], 0
    for i in range(n):
        # The match is taken where it loses nothing; of equal ones the first that needs no return.
        took = -1
        options = where.get(page[i].name, ())
        for j in [j for j in options if j >= state] + [j for j in options if reach[state] <= j < state]:
            if gain(i, j) + best[i + 1][j + 1] == best[i][state]:
                took = j
                break
        at.append(took)
        if took >= 0:
            state = took + 1
    memo[key] = (best[0][0], at)
    return memo[key]


def covers(expression: Item, page: Item) -> bool:
    """Whether every token of the page has a place in the expression."""
    return expression.name == page.name and 1 + embedding(page.kids or [], expression.kids or [], expression.loops)[0] == size(page)


def unite(a: Item, b: Item) -> None:
    """a becomes an expression for both; the names are equal."""
    a.optional |= b.optional
    if a.kids is None:
        a.refs += b.refs
        return
    if len(a.kids) == len(b.kids) and a.loops == b.loops and all(x.name == y.name for x, y in zip(a.kids, b.kids)):
        for x, y in zip(a.kids, b.kids):
            unite(x, y)
        return
    _, at = embedding(b.kids, a.kids, a.loops)
    x, y = a.kids, b.kids
    spans = [(x[s], x[e]) for s, e in a.loops]
    additions: dict[int, list[tuple[int, Item]]] = {}  # before place j: (start of the loop that it ends, or -1), item
    before, waiting = -1, []

    def left_out(lo: int, hi: int) -> None:
        for k in range(lo, hi):
            x[k].optional = True

    for i, j in enumerate(at):
        if j < 0:
            y[i].optional = True
            waiting.append(y[i])
            continue
        if before >= 0 and j <= before:
            s, e = min(((s, e) for s, e in a.loops if s <= j and before <= e), key=lambda r: r[1] - r[0])
            left_out(before + 1, e + 1), left_out(s, j)
            additions.setdefault(e + 1, []).extend((s, w) for w in waiting)
        else:
            left_out(before + 1, j)
            additions.setdefault(before + 1 if before >= 0 else j, []).extend((-1, w) for w in waiting)
        waiting = []
        unite(x[j], y[i])
        before = j
    left_out(before + 1, len(x))
    additions.setdefault(before + 1, []).extend((-1, w) for w in waiting)
    kids: list[Item] = []
    last = {}  # loop (start, end) -> its last item, where some were added to it
    for j in range(len(x) + 1):
        for s, w in sorted(additions.get(j, ()), key=lambda r: -r[0]):
            kids.append(w)
            if s >= 0:
                for r in a.loops:
                    if r[1] == j - 1 and r[0] <= s:
                        last[r] = w
        if j < len(x):
            kids.append(x[j])
    place = {id(k): n for n, k in enumerate(kids)}
    found = {(place[id(p)], place[id(last.get(r, q))]) for r, (p, q) in zip(a.loops, spans)}
    own = [place[id(x[j] if j >= 0 else y[i])] for i, j in enumerate(at)]
    found |= {(min(own[s : e + 1]), max(own[s : e + 1])) for s, e in b.loops}
    a.kids, a.loops = kids, _nested(found)
    fold(a)


def _nested(loops: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Loops that cross become the one that spans them."""
    out = sorted(loops)
    k = 0
    while k < len(out):
        for n in range(k + 1, len(out)):
            (s, e), (t, f) = out[k], out[n]
            if s < t <= e < f:
                out = sorted({*out[:k], *out[k + 1 : n], *out[n + 1 :], (s, f)})
                k = -1
                break
        k += 1
    return out


def _joined(a: Item, first: int, width: int, copies: int) -> None:
    """The sequences of `width` items that begin at `first` become one loop."""
    end = first + width * copies
    for k in range(width):
        optional = [a.kids[first + c * width + k].optional for c in range(copies)]
        for c in range(1, copies):
            unite(a.kids[first + k], a.kids[first + c * width + k])
        a.kids[first + k].optional = any(optional)
    to = lambda j: j if j < first else first + (j - first) % width if j < end else j - width * (copies - 1)
    whole = (first, first + width - 1)
    loops = {whole} | {(to(s), to(e)) if s < first or e >= end or (s - first) // width == (e - first) // width else whole for s, e in a.loops}
    a.kids = a.kids[: first + width] + a.kids[end:]
    a.loops = _nested(loops)


def _runs(a: Item) -> None:
    """Equal neighbours become one repeated item: always in running text, from ALWAYS on, or where one is optional."""
    kids: list[Item] = []
    to: list[int] = []
    loops: set[tuple[int, int]] = set()
    i, n = 0, len(a.kids)
    while i < n:
        run = 1
        while i + run < n and a.kids[i + run].name == a.kids[i].name:
            run += 1
        own = a.kids[i : i + run]
        if run > 1 and (flows(own[0].name) or run >= ALWAYS or any(k.optional for k in own)):
            # A loop that holds some of them and not others: any iteration may lack it.
            parted = any(s < e and s < i + run and e >= i and not (s <= i and e >= i + run - 1) for s, e in a.loops)
            optional = (any if parted else all)([k.optional for k in own])
            for k in own[1:]:
                unite(own[0], k)
            own[0].optional = optional
            loops.add((len(kids), len(kids)))
            to += [len(kids)] * run
            kids.append(own[0])
        else:
            to += range(len(kids), len(kids) + run)
            kids += own
        i += run
    a.loops = _nested(loops | {(to[s], to[e]) for s, e in a.loops})
    a.kids = kids


def _by_kind(a: Item) -> None:
    """One loop over the kinds of items, each optional."""
    kinds: dict[str, Item] = {}
    for k in a.kids:
        if k.name in kinds:
            unite(kinds[k.name], k)
        else:
            kinds[k.name] = k
    a.kids = list(kinds.values())
    for k in a.kids:
        k.optional = True
    a.loops = _nested({(0, len(a.kids) - 1), *((j, j) for j in range(len(a.kids)))})


def fold(a: Item) -> None:
    """Equal neighbours, and equal sequences of neighbours, become repeated groups."""
    while len({k.name for k in a.kids}) < len(a.kids):
        _runs(a)
        if len(a.kids) > ALWAYS * WIDEST:
            _by_kind(a)
        elif not _sequences(a, [k.name for k in a.kids]):
            break
    if len(a.kids) > WIDEST and (len({k.name for k in a.kids}) < len(a.kids) or (0, len(a.kids) - 1) not in a.loops):
        _by_kind(a)


def _sequences(a: Item, names: list[str]) -> bool:
    n = len(names)
    code = {x: k for k, x in enumerate(dict.fromkeys(names))}
    s = [code[x] for x in names]
    for width in range(2, min(n // 2, WIDEST) + 1):
        run = 0
        for i in range(n - width):
            run = run + 1 if s[i] == s[i + width] else 0
            last = i + 1 == n - width or s[i + 1] != s[i + 1 + width]
            if run < width or not last:
                continue
            first, copies = i - run + 1, run // width + 1
            end = first + width * copies
            if copies < 3 and not any(k.optional for k in a.kids[first:end]):
                continue
            inside = lambda p, q: (p - first) // width == (q - first) // width
            if all(q < first or p >= end or (p <= first and q >= end - 1) or (p >= first and q < end and inside(p, q)) for p, q in a.loops):
                _joined(a, first, width, copies)
                return True
    return False


def inferred(streams: list[str]) -> str:
    """The expression for encoded streams and expressions, aligned one after another in order of length and text."""
    out: Item | None = None
    for s in sorted(set(streams), key=lambda x: (len(x), x)):
        if out is None:
            out = decoded(s)
        else:
            unite(out, decoded(s))
    return encoded(out) if out else ""


def pattern(x: Item) -> str:
    """The expression as a pattern of Python's re, over streams written as `<p>#</p>`."""
    if x.kids is None:
        body = "#"
    else:
        parts = [pattern(k) for k in x.kids]
        for s, e in sorted(x.loops, key=lambda r: r[1] - r[0]):
            parts[s] = "(?:" + parts[s]
            parts[e] += ")+"
        body = re.escape(x.name) + "".join(parts) + re.escape("/" + x.name)
    return f"(?:{body})?" if x.optional else body
