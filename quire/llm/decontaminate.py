"""Benchmark decontamination by latent semantic retrieval.

Passages of BLOCK words, over all documents, give TF-IDF vectors over FEATURES hashed words (the commonest,
that make up STOP_SHARE of all words of passages, count as stop words). A randomised SVD of that matrix A is computed in one distributed pass: with a Gaussian
test matrix W, tasks sum A'(A W), and the Nystrom form of A'A gives the right singular vectors V and values s. Texts are
projected on V/s, so that no common topic rules the cosine. Every benchmark item is then sought in sliding windows of
every document, of the least size that holds it and a quarter (from 40 words on a third) of that size apart, in whole
GRAINs: windows with a cosine of COSINE or more
where that is not less than at the neighbouring windows are candidates. A candidate must hold OVERLAP of the item by TF-IDF mass; then the longest common subsequence of the
item's words and the words around the window is taken. A paraphrase covers LCS_SHARE of the item and ANSWER_SHARE of its
answer; the benchmark has no column for answers, so the item's last ANSWER_WORDS words stand for one. A copy needs no
answer: it covers SURE_SHARE of the item, or holds RUN_WORDS of its words in a row. Items under SHORT_WORDS words must be
covered whole.

Words are runs of characters other than space and tab to carriage return, without marks at either end; A-Z and U+00C0 to
U+00DE count as lower case.
Items are broadcast in blocks of ITEM_BLOCK, a pass over the documents each; 2 KB an item. The sums that reach the driver have
FEATURES * RANK entries, of any input; they are added as whole numbers, of 2^-16, so that their order does not matter.

Defined cases: null or empty text has no passages and is clean; null or empty items match nothing; texts of any length are
searched whole; repeated rows are each reported under their doc_id once, and `clean` drops all rows of a doc_id that one
of them is reported for, and keeps those with none; of equal finds the one with the greatest shares counts; empty tables
give an empty result; other columns are not read by the search and pass through `clean`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words
from quire.llm.common import apart, cut, together

FEATURES, RANK = 1 << 14, 48
BLOCK, STOP_SHARE = 64, 0.35
#: Sizes of windows, and how far apart they are, in words: multiples of GRAIN.
SIZES, STEPS, GRAIN = (20, 28, 36, 48, 64), (4, 8, 8, 16, 20), 4
COSINE, OVERLAP = 0.35, 0.45
LCS_SHARE, ANSWER_SHARE, ANSWER_WORDS, SHORT_WORDS = 0.6, 0.5, 6, 8
SURE_SHARE, RUN_WORDS = 0.75, 20
ITEM_BLOCK = 16384
U = np.uint64
#: Bytes that may stand at either end of a word and do not belong to it (fixed values: ASCII marks).
MARKS = b".,;:!?\"'()[]"


def _tables() -> dict[str, np.ndarray]:
    t = words.tables()
    mark = np.zeros(256, dtype=bool)
    mark[list(MARKS)] = True
    return t | {"mark": mark}


class Text:
    """Word hashes h and features f of a text column, and first: each row's first word and the number of words."""

    def __init__(self, col: pa.Array, t: dict[str, np.ndarray]):
        w = words.Words(col, t)
        accented = np.flatnonzero((w.data[:-1] == 0xC3) & (w.data[1:] >= 0x80) & (w.data[1:] <= 0x9E) & (w.data[1:] != 0x97)) + 1
        w.data[accented] += 32
        at = np.arange(len(w.start))
        for _ in range(3):  # marks at the ends, where something is left
            at = at[t["mark"][w.data[w.end[at] - 1]] & (w.end[at] - w.start[at] > 1)]
            w.end[at] -= 1
        at = np.arange(len(w.start))
        for _ in range(3):
            at = at[t["mark"][w.data[w.start[at]]] & (w.end[at] - w.start[at] > 1)]
            w.start[at] += 1
        self.h = w.hashes(t)
        self.f = ((self.h >> U(40)) & U(FEATURES - 1)).astype(np.int64)
        self.first, self.doc = w.first, w.doc

    def blocks(self, size: int) -> np.ndarray:
        """The features of each text in rows of `size` words, the last one of a text filled up with FEATURES."""
        n = -(-np.diff(self.first) // size)
        self.block_first = np.concatenate([[0], np.cumsum(n)])
        out = np.full((self.block_first[-1], size), FEATURES, dtype=np.int32)
        out.reshape(-1)[np.arange(len(self.f)) - self.first[self.doc] + self.block_first[self.doc] * size] = self.f
        return out


def _texts(docs: DataFrame, work, schema: str, finish=None) -> DataFrame:
    """mapInArrow over (doc_id, text): work(part, text, state) may give a batch for each part; finish(state) one at the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, state = _tables(), {}
        for batch in batches:
            for part in words.chunks(batch):
                if (out := work(part, Text(part.column(1), t), state)) is not None:
                    yield out
        if finish and (out := finish(state)) is not None:
            yield out

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _sum_rows(rows: DataFrame) -> np.ndarray:
    """The sum of the vectors in column v by slice j, in a tree: of PARTS tasks' vectors FAN at a time are added."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for x in batches:
            for j, part, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2)):
                v, key = np.frombuffer(v.as_buffer(), dtype=np.int64), (j, part)
                total[key] = total[key] + v if key in total else v
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["j", "part", "v"])

    parts = PARTS
    while parts > 1:
        rows, parts = rows.withColumn("part", F.expr(f"part div {FAN}").cast("int")).repartition("j", "part").mapInArrow(add, "j int, part int, v binary"), parts // FAN
    got = rows.toArrow().sort_by("j")
    return np.concatenate([np.frombuffer(v.as_buffer(), dtype=np.int64) for c in got["v"].chunks for v in c]) if got.num_rows else np.empty(0, dtype=np.int64)


#: Pieces that a vector of sums is cut into; vectors of so many tasks are told apart, and so many are added at a time.
SLICES, PARTS, FAN = 16, 4096, 16


def _slices(v: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId() % PARTS
    cut_up = np.split(v.astype(np.int64), SLICES)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([x.tobytes() for x in cut_up], pa.binary())], names=["j", "part", "v"])


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each feature stands, and how many passages there are."""

    def work(part, x: Text, state: dict) -> None:
        if len(x.f):
            passages = np.sort(x.blocks(BLOCK).astype(np.uint16), axis=1)
            new = np.ones(passages.shape, dtype=bool)
            new[:, 1:] = passages[:, 1:] != passages[:, :-1]
            state["df"] = state.get("df", 0) + np.bincount(passages[new], minlength=FEATURES + 1)[:FEATURES]
            state["n"] = state.get("n", 0) + len(passages)

    def finish(state: dict):
        # The number of passages rides in SLICES further places.
        return _slices(np.concatenate([state["df"].reshape(SLICES, -1), np.full((SLICES, 1), state["n"])], axis=1).ravel()) if state else None

    got = _sum_rows(_texts(docs, work, "j int, part int, v binary", finish))
    if not len(got):
        return np.zeros(FEATURES, dtype=np.int64), 0
    got = got.reshape(SLICES, -1)
    return got[:, :-1].ravel(), int(got[0, -1])


def latent_space(docs: DataFrame, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features (IDF; 0 for stop words), and the projection, FEATURES by RANK."""
    df, n = document_frequency(docs)
    idf = np.log((n + 1) / (df + 1))
    order = np.argsort(-df, kind="stable")
    idf[order[np.cumsum(df[order]) <= STOP_SHARE * df.sum()]] = 0.0
    test = np.random.Generator(np.random.PCG64(seed)).standard_normal((FEATURES, RANK)) * (idf > 0)[:, None]
    ahead = np.append(test * idf[:, None], np.zeros((1, RANK)), axis=0).astype(np.float32)
    ahead_is = np.append(idf > 0, False)

    def work(part, x: Text, state: dict) -> None:
        if not len(x.f):
            return
        passages = x.blocks(BLOCK)
        y = np.zeros((len(passages), RANK), dtype=np.float32)
        for k in range(BLOCK):
            y += ahead[passages[:, k]]
        if "g" not in state:
            state["g"] = np.zeros((FEATURES + 1, RANK), dtype=np.float64)
        flat = passages.ravel()
        live = np.flatnonzero(ahead_is[flat])
        order = live[np.argsort(flat[live].astype(np.uint16), kind="stable")]
        f, row = flat[order], order // BLOCK
        for a in range(0, len(f), 4096):  # as much as stays in a core's cache
            own = f[a : a + 4096]
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            state["g"][own[at]] += np.add.reduceat(y[row[a : a + 4096]], at, axis=0)

    def finish(state: dict):
        return _slices(np.rint((state["g"][:FEATURES] * idf[:, None]).ravel() * 65536)) if state else None

    g = _sum_rows(_texts(docs, work, "j int, part int, v binary", finish))
    g = g.reshape(FEATURES, RANK) / 65536 if len(g) else np.zeros((FEATURES, RANK))
    core = test.T @ g
    core = (core + core.T) / 2
    size = np.trace(core) / RANK
    if size <= 0:
        return idf, np.zeros((FEATURES, RANK), dtype=np.float32)
    low = np.linalg.cholesky(core + np.eye(RANK) * size * 1e-6)
    v, s, _ = np.linalg.svd(np.linalg.solve(low, g.T).T, full_matrices=False)
    return idf, (v / np.maximum(s, s[0] * 1e-4)).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Items:
    """A block of the benchmark, ready for search. Items longer than the largest window are sought by pieces."""

    def __init__(self, ids: list[int], texts: list[str], idf: np.ndarray, projection: np.ndarray, t: dict[str, np.ndarray]):
        x = Text(pa.array(texts, pa.large_string()), t)
        self.ids, self.words = ids, [x.h[a:b].tolist() for a, b in zip(x.first[:-1], x.first[1:])]
        self.runs = [{tuple(w[i : i + RUN_WORDS]) for i in range(len(w) - RUN_WORDS + 1)} for w in self.words]
        self.classes = []
        #: What a feature's word weighs in the mass that a window shares with an item.
        self.weight = np.append(np.maximum(idf, 0.05), 0.0).astype(np.float32)
        weighted = projection * idf[:, None].astype(np.float32)
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for k, (a, b) in enumerate(zip(x.first[:-1], x.first[1:])):
            for s in range(a, b, SIZES[-1]) if b - a > SIZES[-1] else [a] if b > a else []:
                e = min(b, s + SIZES[-1])
                by_size.setdefault(next(z for z in SIZES if z >= e - s), []).append((k, s, e))
        for size, pieces in sorted(by_size.items()):
            y = np.stack([weighted[x.f[s:e]].sum(axis=0) for _, s, e in pieces])
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            has = np.zeros((len(pieces), FEATURES // 8 + 1), dtype=np.uint8)  # a bit a feature
            for i, (_, s, e) in enumerate(pieces):
                np.bitwise_or.at(has[i], x.f[s:e] >> 3, np.left_shift(1, x.f[s:e] & 7).astype(np.uint8))
            least = np.array([OVERLAP * self.weight[x.f[s:e]].sum() for _, s, e in pieces], dtype=np.float32)
            self.classes.append((size, np.array([k for k, _, _ in pieces]), y.astype(np.float32), has, least))

    def found(self, x: Text, idf: np.ndarray, weighted: np.ndarray) -> dict[tuple[int, int], tuple]:
        """(row, item) -> (share of the item's words found, cosine, share of the answer, first word of the window)."""
        out: dict[tuple[int, int], tuple] = {}
        n = len(x.f)
        if not n:
            return out
        grains = x.blocks(GRAIN)
        own = weighted[grains[:, 0]]
        for k in range(1, GRAIN):
            own += weighted[grains[:, k]]
        sums = np.zeros((len(own) + 1, RANK), dtype=np.float32)
        np.cumsum(own, axis=0, out=sums[1:])
        rows = np.flatnonzero(np.diff(x.first))
        a, b, base = x.first[rows], x.first[rows + 1], x.block_first[rows]
        padded = np.concatenate([x.f, np.full(SIZES[-1], FEATURES)])
        for size, item, y, has, least in self.classes:
            step = STEPS[SIZES.index(size)]
            count = np.maximum(0, -(-(b - a - size) // step)) + 1
            place = step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            row, low = np.repeat(rows, count), np.repeat(base, count) + place // GRAIN
            start = np.repeat(a, count) + place
            end = np.minimum(start + size, x.first[row + 1])
            z = sums[low - (start - end) // GRAIN] - sums[low]
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)
            block = max(3, (1 << 22) // len(y))  # 16 MB of cosines at a time, and a window more on either side
            for top in range(0, len(z), block):
                lead = min(top, 1)
                here = slice(top - lead, top + block + 1)
                near = (z[here] @ y.T) / norm[here, None]
                hits = np.flatnonzero(near[lead : lead + block] >= COSINE) + lead * len(y)
                win, col = hits // len(y), hits % len(y)
                # Of neighbouring windows of a text, those where the item's cosine is at a peak.
                of, flat = row[here], near.ravel()
                before, after = np.maximum(win - 1, 0), np.minimum(win + 1, len(near) - 1)
                value = flat[hits]
                peak = ((of[before] != of[win]) | (flat[before * len(y) + col] <= value)) & ((of[after] != of[win]) | (flat[after * len(y) + col] <= value))
                win, col = win[peak] + top - lead, col[peak]
                value = value[peak]
                for lo in range(0, len(win), 8192):
                    w, c = win[lo : lo + 8192], col[lo : lo + 8192]
                    span = start[w][:, None] + np.arange(size)
                    f = np.where(span < end[w][:, None], padded[span], FEATURES)
                    got = (self.weight[f] * ((has[c[:, None], f >> 3] >> (f & 7)) & 1)).sum(axis=1)
                    for i in np.flatnonzero(got >= least[c]):
                        self._check(x, int(row[w[i]]), int(item[c[i]]), int(start[w[i]]), int(end[w[i]]), float(value[lo + i]), out)
        return out

    def _check(self, x: Text, row: int, item: int, start: int, end: int, cosine: float, out: dict) -> None:
        target = self.words[item]
        room = len(target) // 2 + 4 if len(target) <= SIZES[-1] else len(target)
        region = x.h[max(int(x.first[row]), start - room) : min(int(x.first[row + 1]), end + room)].tolist()
        if out.get((row, item), (0.0,))[0] == 1.0:
            return
        share = common_subsequence(target, region) / len(target)
        answer = target[-ANSWER_WORDS:]
        answered = common_subsequence(answer, region) / len(answer)
        if len(target) < SHORT_WORDS:
            leaks = share == 1.0
        else:
            leaks = share >= SURE_SHARE or (share >= LCS_SHARE and answered >= ANSWER_SHARE) or any(tuple(region[i : i + RUN_WORDS]) in self.runs[item] for i in range(len(region) - RUN_WORDS + 1))
        if leaks:
            out[row, item] = max(out.get((row, item), (0.0,)), (share, cosine, answered, start - int(x.first[row])))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share and cosine of every document that holds a benchmark item."""
    idf, projection = latent_space(docs)
    weighted = np.append(projection * idf[:, None], np.zeros((1, RANK)), axis=0).astype(np.float32)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null").distinct()
    blocks = max(1, math.ceil(items.count() / ITEM_BLOCK))
    out = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        ids, texts = own["item_id"].to_pylist(), own["text"].to_pylist()

        def work(part, x: Text, state: dict, ids=ids, texts=texts):
            if "items" not in state:
                state["items"] = Items(ids, texts, idf, projection, _tables())
            found = state["items"].found(x, idf, weighted)
            keys = sorted(found)
            doc = part.column(0).take(pa.array([r for r, _ in keys], pa.int64()))
            column = lambda i: pa.array([float(found[k][i]) for k in keys], pa.float64())
            return pa.RecordBatch.from_arrays([doc, pa.array([ids[i] for _, i in keys], pa.int64()), column(0), column(2), column(1)], names=["doc_id", "item_id", "lcs_share", "answer_share", "cosine"])

        hits = cut(_texts(docs, work, "doc_id long, item_id long, lcs_share double, answer_share double, cosine double"), "leaks")
        out = hits if out is None else out.union(hits)
    best = F.max_by(F.struct("lcs_share", "answer_share", "cosine"), F.struct("lcs_share", "answer_share", "cosine")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.round("b.lcs_share", 6).alias("lcs_share"), F.round("b.answer_share", 6).alias("answer_share"), F.round("b.cosine", 4).alias("cosine"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; those with null doc_id are kept."""
    found = cut(contaminated(docs, benchmark).select("doc_id").distinct(), "leaks-found")
    rows = apart(docs, doc_id=F.col("doc_id"))
    return together(rows.join(found.select(F.struct("doc_id").alias("v")), F.col("own.doc_id") == F.col("v.doc_id"), "left_anti"), docs.columns)
