"""HTML extraction by wrappers: union-free regular expressions inferred from the token streams of a host's pages.

A page's tokens are its block tags, with their first class, and its text slots. The streams of a host are aligned one
after another (see `wrapper`): mismatches become optional or repeated groups, and the result is the host's wrapper. Streams
are counted by (host, stream) first and aligned in rounds, FAN to a task, so that a host with very many pages is no burden
to one task. Every page's stream is then matched against the wrapper of its host, and each text slot of the wrapper carries
what its pages have there: pages, text outside links, text in links, and whether the text changes.

The slots decide. A slot in an element set apart (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments, told by tag, role or class) never holds the article. A slot whose text never changes, on
LEAST_PAGES pages or more, belongs to the template. Of the others, those inside <article> or <main> hold the article; on
pages without these, those inside the group of the wrapper with the largest mass of text outside links, and others with
more text than links. Where a page has text in none of these, its slots of unchanging text are taken. A page's text
is that of the slots so chosen, in page order; character references are decoded and white space is folded.

Within chosen slots, a block of text that stands on half or more of a host's pages, COMMON_PAGES at least, is fixed text of
the template and goes, unless such blocks make up more than a third of a page's text: then they are copies of an article.

Defined cases: null html or url counts as empty; a page without text gives an empty text; markup cut short is read to its
end; elements nested deeper than DEPTH add no tokens, but their text stays where it is; repeated rows are each read, and
ties between slots go to the first in page order; texts of any length are read whole; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import wrapper
from quire.llm.common import cut, discard
from quire.llm.wrapper import Item

#: Elements (fixed values, from the HTML standard).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button option title head map".split())
#: Of these, the ones whose inside is markup like any other, and those that TOKEN reads whole.
EMPTY = UNSEEN - frozenset("head button select object audio video canvas map math option".split())
APART = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Elements that end when another of the same kind begins beside them.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
#: Words of a class or id that mark what is not the article (fixed values).
APART_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar header masthead footer comment comments respond disqus replies reply share sharing social related recommended".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Pages on which a slot's text must be the same to be the template's.
LEAST_PAGES = 3
#: Pages on which a block must stand to be fixed text, besides half of its host's.
COMMON_PAGES = 8
#: Streams and expressions that one task aligns, on average.
FAN = 256
#: Depth to which elements are tokens.
DEPTH = 48
LETTERS = re.compile(r"[a-z][a-z_-]*")


def host_of(url: str | Column) -> Column:
    """The host of a URL, in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def apart(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is not part of the article, and its first class if that is a word."""
    out, label = tag in APART, ""
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name == "role":
                out |= value in ROLES
            elif tag not in ("body", "html", "article", "main"):
                out |= any(w in APART_WORDS for w in re.split(r"[^a-z]+", value))
            if name == "class" and value.split() and LETTERS.fullmatch(value.split()[0]):
                label = value.split()[0]
    return out, label


class Page:
    """The blocks of a page, (text, characters in links), and the stream of its tokens; slots refer to blocks by number."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int]] = []
        self.root = Item("", [])
        stack: list[tuple[str, Item | None]] = []  # tag, item (None: too deep to be a token)
        buf: list[str] = []
        links, in_link = 0, False
        at, here, depth = 0, self.root, 0

        def flush() -> None:
            nonlocal links
            if buf:
                text = "".join(buf)
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    slot = here.kids[-1] if here.kids and here.kids[-1].kids is None else None
                    if slot is None:
                        here.kids.append(slot := wrapper.text_slot())
                    elif not here.loops or here.loops[-1][0] != len(here.kids) - 1:
                        here.loops.append((len(here.kids) - 1, len(here.kids) - 1))
                    slot.refs.append(len(self.blocks))
                    self.blocks.append((text, min(links, len(text))))
                buf.clear()
            links = 0

        def push(tag: str, name: str, away: bool) -> None:
            nonlocal here, depth
            if depth >= DEPTH and not (away and here.name[:1] != "!"):
                stack.append((tag, None))
                return
            item = Item(("!" if away else "") + name, [])
            here.kids.append(item)
            stack.append((tag, item))
            here, depth = item, depth + 1

        def pop() -> None:
            """Ends the innermost element; where it equals the neighbour before it in running text, they are one group."""
            nonlocal here, depth
            _, item = stack.pop()
            if item is None:
                return
            wrapper.fold(item)
            here, depth = next((x for _, x in reversed(stack) if x is not None), self.root), depth - 1
            if len(here.kids) > 1 and here.kids[-2].name == item.name and wrapper.flows(item.name):
                here.kids.pop()
                last = len(here.kids) - 1
                wrapper.unite(here.kids[last], item)
                if (last, last) not in here.loops[-1:]:
                    here.loops.append((last, last))

        for m in TOKEN.finditer(html):
            if m.start() > at:
                buf.append(html[at : m.start()])
                if in_link:
                    links += m.start() - at
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if tag == "br":
                buf.append(" ")
                continue
            if tag == "a":
                in_link = not m[2]
            if tag in EMPTY and not m[2]:
                continue
            if tag not in BLOCKS and tag not in UNSEEN:
                if not m[2] and tag not in VOID and m[4]:
                    if apart(tag, m[4])[0]:  # an inline element that is not the article's: its text stands apart
                        flush()
                        push(tag, f"<{tag}>", True)
                elif m[2] and stack and stack[-1][0] == tag:
                    flush()
                    pop()
                continue
            flush()
            if tag == "hr":
                continue
            if m[2]:
                if any(x[0] == tag for x in stack):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            away, label = apart(tag, m[4]) if m[4] or tag in APART else (False, "")
            if stack and tag in BLOCKS and tag != "li" and stack[-1][0] == "p":
                pop()
            if tag in SELF_ENDING and stack and stack[-1][0] == tag:
                pop()
            if tag == "body":
                while any(x[0] == "head" for x in stack):
                    pop()
            push(tag, f"<{tag}.{label}>" if label else f"<{tag}>", away or tag in UNSEEN)
        if at < len(html) and not html.startswith("<", at):
            buf.append(html[at:])
        flush()
        while stack:
            pop()
        wrapper.fold(self.root)

    def masses(self) -> list[tuple[int, int, int]]:
        """For each slot: characters outside links, characters in links, hash of its text."""
        out = []
        for slot in wrapper.slots(self.root):
            own = [self.blocks[k] for k in slot.refs]
            h = 0
            for text, _ in own:
                h = zlib.crc32(text.encode(), h)
            out.append((sum(len(t) - n for t, n in own), sum(n for _, n in own), h))
        return out


def block_hash(text: str) -> int:
    data = text.encode()
    return len(data) << 32 | zlib.crc32(data)


def paths(root: Item) -> list[tuple[str, ...]]:
    """For each slot the names of the elements around it."""
    out: list[tuple[str, ...]] = []

    def walk(x: Item, above: tuple[str, ...]) -> None:
        if x.kids is None:
            out.append(above)
        else:
            for k in x.kids:
                walk(k, (*above, x.name))

    walk(root, ())
    return out


def is_apart(path: tuple[str, ...]) -> bool:
    return any(x[:1] == "!" for x in path)


def is_inside(path: tuple[str, ...]) -> bool:
    return any(x[:9] == "<article>" or x[:9] == "<article." or x[:6] in ("<main>", "<main.") for x in path)


def places(page: Item, expression: Item) -> list[int]:
    """For each slot of a page the number of the expression's slot that it matches (-1: none)."""
    for n, slot in enumerate(wrapper.slots(expression)):
        slot.refs = [n]
    out: list[int] = []
    memo: dict = {}

    def walk(x: Item, wide: Item | None) -> None:
        if x.kids is None:
            out.append(wide.refs[0] if wide is not None else -1)
            return
        at = wrapper.embedding(x.kids, wide.kids, wide.loops, memo)[1] if wide is not None else [-1] * len(x.kids)
        for k, j in zip(x.kids, at):
            walk(k, wide.kids[j] if j >= 0 else None)

    walk(page, expression)
    return out


#: What a slot is to a page, the best first: the article, the same in text that never changes, text outside the article element, the same unchanging, nothing.
ARTICLE, FIXED, OUTSIDE, REST, NEVER = range(5)


def verdicts(expression: Item, stats: dict[int, tuple[int, int, int, bool]]) -> list[int]:
    """For each slot of the expression what it is. stats: slot -> (pages, text outside links, text in links, whether it changes)."""
    around = paths(expression)
    out = [NEVER] * len(around)
    live = [n for n, path in enumerate(around) if not is_apart(path) and n in stats]
    changing = {n for n in live if stats[n][3] or stats[n][0] < LEAST_PAGES}
    for n in live:
        if is_inside(around[n]):
            out[n] = ARTICLE if n in changing else FIXED
    loose = [n for n in live if out[n] == NEVER]
    # The groups of the wrapper, by the slots that they hold: the innermost that has most of the changing text.
    groups: list[tuple[int, str, list[int]]] = []
    count = 0

    def walk(x: Item, depth: int) -> list[int]:
        nonlocal count
        if x.kids is None:
            count += 1
            return [count - 1]
        held = [n for k in x.kids for n in walk(k, depth + 1)]
        groups.append((depth, x.name, held))
        return held

    walk(expression, 0)
    mass = {n: stats[n][1] - stats[n][2] for n in loose if n in changing}
    total = max((sum(mass.get(n, 0) for n in held) for _, _, held in groups), default=0)
    fit = [(depth, -held[0], held) for depth, name, held in groups if held and name.strip("<>").split(".")[0] not in ("p", "li", "h1", "h2", "h3", "td") and sum(mass.get(n, 0) for n in held) >= 0.7 * total]
    container = set(max(fit)[2]) if fit and mass else set()
    for n in loose:
        out[n] = OUTSIDE if n in changing and (n in container or stats[n][1] > stats[n][2]) else REST
    return out


def chosen(kinds: list[int]) -> int:
    return min(kinds, default=NEVER)


def article_text(page: Page, kinds: list[int], fixed: frozenset) -> str:
    """The page's text in slots of the best kind that it has, less blocks that are fixed text of its host."""
    best = chosen(kinds)
    if best == NEVER:
        return ""
    keep = sorted(b for slot, kind in zip(wrapper.slots(page.root), kinds) if kind == best for b in slot.refs)
    texts = [page.blocks[b][0] for b in keep]
    if fixed:
        own = [t for t in texts if block_hash(t) not in fixed]
        if 3 * sum(map(len, own)) >= 2 * sum(map(len, texts)):
            texts = own
    return "\n\n".join(texts)


def _pages(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), host_of(F.col("url").cast("string")).alias("host"))


STREAMS, SLOTS, BLOCKS_SEEN = range(3)
SEEN = "host string, kind int, key long, slot int, stream string, pages long, text long, link long, low long, high long"


def observed(pages: DataFrame) -> DataFrame:
    """Streams by host, with what their slots hold; and how many pages of a host have a block of text."""
    names = [x.split()[0] for x in SEEN.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in SEEN.split(", ")]

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams: dict[tuple, list] = {}
            blocks: dict[tuple, int] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html)
                key = (host, wrapper.encoded(page.root))
                seen = page.masses()
                x = streams.setdefault(key, [0, [[0, 0, h, h] for _, _, h in seen]])
                x[0] += 1
                for s, (text, link, h) in zip(x[1], seen):
                    s[0], s[1], s[2], s[3] = s[0] + text, s[1] + link, min(s[2], h), max(s[3], h)
                around = paths(page.root)
                own = {block_hash(page.blocks[b][0]) for slot, path in zip(wrapper.slots(page.root), around) if not is_apart(path) for b in slot.refs}
                for h in own:
                    blocks[host, h] = blocks.get((host, h), 0) + 1
            rows: list[tuple] = [(host, BLOCKS_SEEN, h, 0, "", n, 0, 0, 0, 0) for (host, h), n in blocks.items()]
            for (host, stream), (n, held) in streams.items():
                h = int.from_bytes(hashlib.blake2b(stream.encode(), digest_size=8).digest(), "big", signed=True)
                rows.append((host, STREAMS, h, 0, stream, n, 0, 0, 0, 0))
                rows += [(host, SLOTS, h, k, "", n, *s) for k, s in enumerate(held)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    seen = pages.select("host", "html").mapInArrow(observe, SEEN)
    total = lambda c: F.sum(c).alias(c)
    seen = seen.groupBy("host", "kind", "key", "slot", "stream").agg(total("pages"), total("text"), total("link"), F.min("low").alias("low"), F.max("high").alias("high"))
    return cut(seen.where((F.col("kind") != BLOCKS_SEEN) | (F.col("pages") >= COMMON_PAGES)), "html-streams")


def expressions(streams: DataFrame) -> DataFrame:
    """host and its expression (in column stream), from distinct (host, stream): aligned in rounds, FAN to a task on average."""

    def some(t: pa.Table) -> pa.Table:
        return pa.table({"host": [t["host"][0].as_py()], "stream": [wrapper.inferred(t["stream"].to_pylist())]})

    parts = max(1, -(-streams.count() // FAN))
    while True:
        dealt = streams.withColumn("part", F.pmod(F.xxhash64("stream"), F.lit(parts)))
        out = cut(dealt.groupBy("host", "part").applyInArrow(some, "host string, stream string"), "html-expressions")
        if parts == 1:
            return out
        if hasattr(streams, "quire_path"):
            discard(streams)
        parts, streams = -(-parts // FAN), out


def wrappers(pages: DataFrame) -> DataFrame:
    """host, expression, verdicts (what each of its slots is) and fixed (hashes of fixed blocks). pages: host, html."""
    seen = observed(pages)
    streams = seen.where(F.col("kind") == STREAMS)
    known = expressions(streams.select("host", "stream"))
    held = seen.where(F.col("kind") == SLOTS).groupBy("host", "key").agg(F.sort_array(F.collect_list(F.struct("slot", "pages", "text", "link", "low", "high"))).alias("held"))
    expression = known.select("host", F.col("stream").alias("expression"))
    each = streams.select("host", "key", "stream").join(held, ["host", "key"], "left").join(expression, "host")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide: dict[str, Item] = {}
        names = ["host", "slot", "pages", "text", "link", "low", "high"]
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, stream, slots, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if text not in wide:
                    wide = {text: wrapper.decoded(text)}
                for n, s in zip(places(wrapper.decoded(stream), wide[text]), slots or ()):
                    x = sums.setdefault((host, n), [0, 0, 0, s["low"], s["high"]])
                    x[0], x[1], x[2], x[3], x[4] = x[0] + s["pages"], x[1] + s["text"], x[2] + s["link"], min(x[3], s["low"]), max(x[4], s["high"])
            rows = [(*k, *v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), *[pa.int64()] * 5))], names=names)

    each = each.select("host", "stream", "held", "expression").mapInArrow(matched, "host string, slot int, pages long, text long, link long, low long, high long")
    stats = each.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("text").alias("text"), F.sum("link").alias("link"), (F.min("low") != F.max("high")).alias("changes"))
    stats = stats.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "text", "link", "changes")).alias("stats"))
    # Blocks on half of a host's pages or more: at most twice as many as a page of it has.
    size = streams.groupBy("host").agg(F.sum("pages").alias("all"))
    fixed = seen.where(F.col("kind") == BLOCKS_SEEN).join(size, "host").where(F.col("pages") * 2 >= F.col("all")).groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("fixed"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(verdicts(wrapper.decoded(text), {r["slot"]: (r["pages"], r["text"], r["link"], r["changes"]) for r in rows or () if r["slot"] >= 0}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32())), batch.column(3)], names=["host", "expression", "verdicts", "fixed"])

    whole = expression.join(stats, "host", "left").join(fixed, "host", "left").select("host", "expression", "stats", "fixed")
    out = cut(whole.mapInArrow(judged, "host string, expression string, verdicts array<int>, fixed array<long>"), "html-wrappers")
    discard(seen, known)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = _pages(pages)
    known = wrappers(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, tuple[Item, list[int], frozenset, dict]] = {}
        for batch in batches:
            texts = []
            for html, host, expression, kinds, fixed in zip(*(batch.column(i) for i in range(2, 7))):
                host = host.as_py()
                if host not in hosts:
                    if len(hosts) > 2000:
                        hosts.clear()
                    hosts[host] = (wrapper.decoded(expression.as_py()), kinds.as_py(), frozenset(fixed.as_py() or ()), {})
                wide, kinds, fixed, known_streams = hosts[host]
                page = Page(html.as_py())
                stream = wrapper.encoded(page.root)
                if stream not in known_streams:
                    if len(known_streams) > 20_000:
                        known_streams.clear()
                    known_streams[stream] = [kinds[n] if n >= 0 else NEVER for n in places(page.root, wide)]
                texts.append(article_text(page, known_streams[stream], fixed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(known, "host", "left").select("page_id", "url", "html", "host", "expression", "verdicts", "fixed").mapInArrow(read, "page_id long, url string, text string, n_chars long")
