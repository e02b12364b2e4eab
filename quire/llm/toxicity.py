"""Toxicity: Levenshtein automata over a lexicon trie, with context windows that tell quotation from abuse.

The lexicon and the weights are learned from a bounded sample of labelled rows: of either class the TRAIN_DOCS with the
least hash of doc_id, of those of at most TRAIN_BYTES bytes. Terms are words with a letter, of two characters or more, or
stems that stand for every word they begin: what all toxic words have in common that share their first 4 to 6 characters.
A term is seen in toxic texts in LEAST_CONTEXTS contexts (word before, word after) or more, so that copies of one text count
once, and so seldom elsewhere, not counting quoted uses, that chance would explain less than CHANCE terms of all that are
tried; one that begins with another is left out. All that pass are kept. Terms of 5 bytes or more are also found with
one byte inserted, deleted or replaced, of 10 or more with two. Sure terms are those that clean texts of the sample
never have and toxic ones in SURE_CONTEXTS contexts.

The automaton's states are sets of (trie node, edits so far); it is built as it is used, and all words of a chunk take
their steps together. A hit is quoted if quotation marks open before and close after it within WINDOW words of its line,
or a reporting word stands shortly before it. A logistic regression over the counts of hits, exact of sure terms, exact
of others and misspelled, quoted and not, gives the score; it starts from PRIOR weights, so that kinds of hits that the sample lacks still count.

Defined cases: null text counts as empty; a text without hits gets the score of none; without labels of both classes the
lexicon is empty and the score is the base rate's; repeated rows are each scored; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import words

TRAIN_DOCS, TRAIN_BYTES = 1500, 1 << 16
LEAST_CONTEXTS, CHANCE = 5, 1.0
#: Clean contexts of a term for each toxic one, not counting quoted ones: wrong labels, and quotation that shows no marks.
CLEAN_SHARE = 0.1
#: The same for what a stem adds to the terms under it.
STEM_SHARE = 0.005
#: Toxic contexts from which on a term that no clean text has is sure.
SURE_CONTEXTS = 40
WINDOW = 12
#: Weights before training (logarithms of counts): exact hits of sure terms, of others, misspelled ones; the three quoted; constant. One sure hit is enough where the sample does not say otherwise.
PRIOR = np.array([8.0, 4.0, 2.0, 0.5, 0.4, 0.25, -3.0])
KINDS = ("hits", "unsure", "misspelled", "quoted", "quoted_unsure", "quoted_misspelled")
#: Words that report what others say (fixed values).
REPORTING = frozenset("said says wrote writes quoted quote called calls word term sagte schrieb nannte wort dit écrit appelé mot dijo escribió llamó palabra".split())
MARKS = b".,;:!?\"'()[]|#*$%&<>{}"


def edits_allowed(term: bytes) -> int:
    return 2 if len(term) >= 10 else 1 if len(term) >= 5 else 0


class Automaton:
    """Levenshtein automata of all terms, run over their common trie. terms: (bytes, is_stem, sure)."""

    DEAD, START = 0, 1

    def __init__(self, terms: list[tuple[bytes, bool, bool]]):
        self.child: list[dict[int, int]] = [{}]
        self.bound, self.end, self.stem, self.own, self.sure = [0], [False], [False], {}, {}
        for term, stem, sure in terms:
            node, most = 0, edits_allowed(term)
            self.bound[0] = max(self.bound[0], most)
            for c in term:
                node = self.child[node].setdefault(c, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.bound.append(0), self.end.append(False), self.stem.append(False)
                self.bound[node] = max(self.bound[node], most)
            self.end[node], self.stem[node] = True, stem
            self.own[node], self.sure[node] = most, sure
        letters = sorted({c for t, _, _ in terms for c in t})
        self.code = np.zeros(256, dtype=np.int64)
        self.code[letters] = np.arange(1, len(letters) + 1)
        self.letters = [-1, *letters]
        self.states: list[frozenset] = [frozenset(), self._closed({(0, 0)})]
        self.number = {s: i for i, s in enumerate(self.states)}
        self.table = np.full((64, len(self.letters)), -1, dtype=np.int64)
        self.table[0] = 0
        self.verdict = [(-1, False), self._verdict(self.states[1])]

    def _closed(self, state: set) -> frozenset:
        """With letters of the term left out, and without what needs more edits at the same node."""
        best: dict[int, int] = {}
        todo = sorted(state, key=lambda x: x[1])
        while todo:
            node, e = todo.pop(0)
            if best.get(node, 99) <= e or e > self.bound[node]:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.child[node].values()]
        return frozenset(best.items())

    def _verdict(self, state: frozenset) -> tuple[int, bool]:
        """Least number of edits with which a term is read (-1: none), and whether such a term is sure."""
        e, unsure = min(((e, not self.sure[node]) for node, e in state if self.end[node] and e <= self.own[node]), default=(-1, True))
        return e, not unsure

    def _step(self, state: int, code: int) -> int:
        letter, out = self.letters[code], set()
        for node, e in self.states[state]:
            if self.stem[node] and self.end[node] and e <= self.own[node]:
                out.add((node, e))
            for c, n in self.child[node].items():
                out.add((n, e + (c != letter)))
            out.add((node, e + 1))
        closed = self._closed(out)
        if closed not in self.number:
            self.number[closed] = len(self.states)
            self.states.append(closed)
            self.verdict.append(self._verdict(closed))
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return self.number[closed] if closed else 0

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the least number of edits from a term (-1: from none), and whether that is a sure one."""
        n = len(start)
        state = np.full(n, self.START, dtype=np.int64)
        live = np.flatnonzero(end > start)
        at = 0
        while len(live):
            codes, now = self.code[data[start[live] + at]], state[live]
            nxt = self.table[now, codes]
            if (nxt < 0).any():
                for s, c in {(int(s), int(c)) for s, c in zip(now[nxt < 0], codes[nxt < 0])}:
                    self.table[s, c] = self._step(s, c)
                nxt = self.table[now, codes]
            state[live] = nxt
            at += 1
            live = live[(nxt != self.DEAD) & (end[live] - start[live] > at)]
        edits, sure = np.array(self.verdict).T
        return edits[state].astype(np.int64), sure[state].astype(bool)


def _trimmed(col: pa.Array, t: dict[str, np.ndarray]) -> words.Words:
    """Words without marks at their ends; begin and finish are where they stood with them."""
    w = words.Words(col, t)
    w.begin, w.finish = w.start, w.end
    for _ in range(4):
        if len(w.start):
            w.end = w.end - (t["mark"][w.data[w.end - 1]] & (w.end - w.start > 1))
            w.start = w.start + (t["mark"][w.data[w.start]] & (w.end - w.start > 1))
    return w


def _tables() -> dict[str, np.ndarray]:
    t = words.tables()
    mark = np.zeros(256, dtype=bool)
    mark[list(MARKS)] = True
    return t | {"mark": mark}


def quoted(before: str, after: str) -> bool:
    """Whether what stands between the two is quoted, or reported. before, after: the WINDOW words on either side."""
    line, rest = before.rsplit("\n", 1)[-1], after.split("\n", 1)[0]
    for opening, closing in (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“")):
        if opening == closing:
            if line.count(opening) % 2 and opening in rest:
                return True
        elif line.rfind(opening) > line.rfind(closing) and closing in rest:
            return True
    return any(x.strip(".,:;\"'") in REPORTING for x in line.lower().split(" ")[-4:])


def hit_counts(col: pa.Array, automaton: Automaton, t: dict[str, np.ndarray]) -> np.ndarray:
    """For each text the number of hits: exact of sure terms, exact of others, misspelled; and the same three quoted."""
    out = np.zeros((len(col), 6))
    w = _trimmed(col, t)
    if not len(w.start):
        return out
    edits, sure = automaton.run(w.data, w.start, w.end)
    for i in np.flatnonzero(edits >= 0):
        d = w.doc[i]
        before = bytes(w.raw[w.begin[max(w.first[d], i - WINDOW)] : w.start[i]]).decode(errors="ignore")
        after = bytes(w.raw[w.end[i] : w.finish[min(w.first[d + 1] - 1, i + WINDOW)]]).decode(errors="ignore")
        out[d, 3 * quoted(before, after) + (2 if edits[i] else int(not sure[i]))] += 1
    return out


def learn_terms(texts: list[str], toxic: list[int]) -> list[tuple[bytes, bool, bool]]:
    """Words and stems that toxic texts have in many contexts and others hardly at all, but for quoted ones; sure are those
    that clean texts never have, and toxic ones in SURE_CONTEXTS contexts or more."""
    seen: dict[str, list[set]] = {}
    for text, label in dict(zip(texts, toxic)).items():
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        ws = [text[a:b].lower().strip(MARKS.decode()) for a, b in at]
        for i, x in enumerate(ws):
            if len(x) < 2 or not any(c.isalpha() for c in x):
                continue
            a, b = at[i]
            a += len(text[a:b]) - len(text[a:b].lstrip(MARKS.decode()))
            b -= len(text[a:b]) - len(text[a:b].rstrip(MARKS.decode()))
            if not label and quoted(text[at[max(0, i - WINDOW)][0] : a], text[b : at[min(len(at) - 1, i + WINDOW)][1]]):
                continue
            seen.setdefault(x, [set(), set()])[label].add(hash((ws[i - 1] if i else "", ws[i + 1] if i + 1 < len(ws) else "")))
    weight = [sum(len(v[k]) for v in seen.values()) for k in (0, 1)]
    share = weight[1] / max(1, sum(weight))

    common: dict[str, list[str]] = {}
    for x, (no, yes) in sorted(seen.items()):
        for k in (4, 5, 6):
            if len(x) >= k and yes:
                common.setdefault(x[:k], []).append(x)
    # A stem is all that its toxic words have in common, not just their first characters.
    stems = {os.path.commonprefix(xs) for xs in common.values()}
    most = np.log(CHANCE / max(1, len(seen) + len(stems)))

    def telling(no: int, yes: int) -> bool:
        """A term unrelated to the label would be seen in toxic texts this often with a chance of less than CHANCE / terms tried (Chernoff)."""
        if yes < LEAST_CONTEXTS or not 0 < share < 1 or yes <= share * (no + yes):
            return False
        return bool(-yes * np.log(yes / (no + yes) / share) - (no and no * np.log(no / (no + yes) / (1 - share))) < most)

    words_in = {x for x, (no, yes) in seen.items() if len(no) <= CLEAN_SHARE * len(yes) and telling(len(no), len(yes))}
    under: dict[str, list[set]] = {x: [set(), set()] for x in stems}
    for x, (no, yes) in seen.items():
        for k in range(4, len(x) + 1):
            if x[:k] in under:
                under[x[:k]][1] |= yes
                if x not in words_in:  # what a stem adds to the terms under it must hardly occur in clean texts
                    under[x[:k]][0] |= no
    good = [(len(x), x, False) for x in words_in]
    good += [(len(x), x, True) for x, (no, yes) in under.items() if len(no) <= STEM_SHARE * len(yes) and telling(len(no), len(yes))]
    chosen: list[tuple[str, bool]] = []
    taken: set[str] = set()
    for _, term, stem in sorted(good, key=lambda x: (x[0] + (not x[2]) * 0.5, x[1])):
        if not any(term[:k] in taken for k in range(1, len(term) + 1)):
            chosen.append((term, stem))
            if stem:
                taken.add(term)
    heard = {x[:k] for x, (no, _) in seen.items() if no for k in range(1, len(x) + 1)}  # what clean texts have words that begin so
    sure = lambda x, stem: x not in heard if stem else not seen[x][0]
    return [(term.encode(), stem, sure(term, stem) and len((under if stem else seen)[term][1]) >= SURE_CONTEXTS) for term, stem in sorted(chosen)]


def learn_weights(x: np.ndarray, y: np.ndarray, toxic_rate: float) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to PRIOR; a hit never speaks for a text, so that weights of hits are 0 or
    more; the constant is set for the rate of toxic rows."""
    z = np.c_[np.log1p(x), np.ones(len(x))]

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - y * m).sum() + 0.5 * ((w - PRIOR) ** 2).sum())

    w, free = PRIOR.copy(), np.ones(len(PRIOR), dtype=bool)
    while True:
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.zeros_like(w)
            step[free] = np.linalg.solve((z[:, free] * (p * (1 - p))[:, None]).T @ z[:, free] + np.eye(free.sum()), (z.T @ (p - y) + w - PRIOR)[free])
            size = 1.0
            while size > 1e-4 and loss(w - size * step) > loss(w):
                size /= 2
            w = w - size * step
        against = free & (w < 0) & (np.arange(len(w)) < len(w) - 1)
        if not against.any():
            break
        w[against], free = 0.0, free & ~against
    drawn = y.mean() if len(y) else 0.5
    if 0 < drawn < 1 and 0 < toxic_rate < 1:
        w[-1] += np.log(toxic_rate / (1 - toxic_rate)) - np.log(drawn / (1 - drawn))
    return w


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[bytes, bool, bool]], np.ndarray]:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picks = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for k in (0, 1)]
    texts = docs.where((F.octet_length("text") <= TRAIN_BYTES) & ~held_out()).select("doc_id", F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(picks[0].union(picks[1])), "doc_id").select("doc_id", "text", "toxic").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    text, toxic = [x or "" for x in sample["text"].to_pylist()], sample["toxic"].to_pylist()
    terms = learn_terms(text, toxic)
    t, automaton = _tables(), Automaton(terms)
    x = hit_counts(pa.array(text, pa.large_string()), automaton, t)
    return terms, learn_weights(x, np.array(toxic, dtype=float), counts.get(1, 0) / max(1, sum(counts.values())))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the hits by kind."""
    terms, weights = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, automaton = _tables(), Automaton(terms)
        for batch in batches:
            for part in words.chunks(batch):
                x = hit_counts(part.column(2), automaton, t)
                score = 1 / (1 + np.exp(-np.clip(np.c_[np.log1p(x), np.ones(len(x))] @ weights, -30, 30)))
                hits = [pa.array(x[:, k].astype(np.int64)) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *hits],
                    names=["doc_id", "held_out", "score", "predicted", *KINDS],
                )

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, " + ", ".join(f"{k} long" for k in KINDS))
