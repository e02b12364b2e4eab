"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

A text is cut into pieces of `capacity` words; what is left over is a piece too. Pieces are dealt by a seeded hash into
groups of about GROUP_PIECES, each packed on its own: longest piece first (ties by doc_id, piece, cluster
and source; what ties then is alike), into the bin with
the least room that holds it and conflicts with nothing in it. Open bins stand in order of room (ties: older bin first)
and carry one bitmap of sources and one of duplicate clusters; the search starts at the successor of the piece's length
and goes on until the bitmaps show no conflict. No compatible bin: a new one. Every piece is packed, so a group of any
size gives a whole result; hot sources or clusters only mean more bins.

Conflicts: two pieces of one duplicate cluster never share a bin, and at most one piece of a source stands in a bin.
Clusters are equal texts (lower case, white space folded) unless cluster_col names a column. Null source or cluster
conflicts with nothing. Defined cases: null or empty text, or one without words, gives one row with no bin; texts of any
length are packed whole, in as many pieces as it takes; repeated rows are packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, text_or_empty

CAPACITY = 2048
#: Pieces that one task packs at a time, on average.
GROUP_PIECES = 4096
SCHEMA = "doc_id long, piece int, start_word long, n_words int, bin string, bin_start int"


def _bits(codes: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the bitmap's word and mask; values met once, and nulls, need no bit."""
    _, inverse, count = np.unique(codes, return_inverse=True, return_counts=True)
    shared = (count[inverse] > 1) & ~null
    ids = np.zeros(len(codes), dtype=np.int64)
    if shared.any():
        ids[shared] = np.unique(inverse[shared], return_inverse=True)[1]
    masks = np.where(shared, np.left_shift(np.uint64(1), (ids % 64).astype(np.uint64)), np.uint64(0)).astype(np.uint64)
    return ids // 64, masks, int(ids.max(initial=0)) // 64 + 1


def best_fit(sizes: np.ndarray, source: np.ndarray, no_source: np.ndarray, cluster: np.ndarray, no_cluster: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each piece; pieces come longest first."""
    n = len(sizes)
    s_word, s_mask, s_words = _bits(source, no_source)
    c_word, c_mask, c_words = _bits(cluster, no_cluster)
    room = np.empty(n + 1, dtype=np.int64)  # room << 32 | bin, ascending
    used_s, used_c = np.zeros((n + 1, s_words), dtype=np.uint64), np.zeros((n + 1, c_words), dtype=np.uint64)  # by bin
    bins, starts, open_, made = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), 0, 0
    for i in range(n):
        size, ws, ms, wc, mc = int(sizes[i]), s_word[i], s_mask[i], c_word[i], c_mask[i]
        at, found = int(np.searchsorted(room[:open_], size << 32)), -1
        step = 64
        while at < open_ and found < 0:
            ids = room[at : min(at + step, open_)] & 0xFFFFFFFF
            free = ((used_s[ids, ws] & ms) | (used_c[ids, wc] & mc)) == 0
            first = int(free.argmax())
            if free[first]:
                found = at + first
            at, step = at + len(ids), step * 4
        if found < 0:
            bin_, left = made, capacity
            made += 1
        else:
            bin_, left = int(room[found] & 0xFFFFFFFF), int(room[found] >> 32)
            room[found : open_ - 1] = room[found + 1 : open_].copy()
            open_ -= 1
        bins[i], starts[i] = bin_, capacity - left
        used_s[bin_, ws] |= ms
        used_c[bin_, wc] |= mc
        if left > size:
            key = (left - size) << 32 | bin_
            to = int(np.searchsorted(room[:open_], key))
            room[to + 1 : open_ + 1] = room[to:open_].copy()
            room[to] = key
            open_ += 1
    return bins, starts


def pieces(docs: DataFrame, capacity: int, cluster_col: str | None = None) -> DataFrame:
    t = text_or_empty()
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    folded = F.xxhash64(F.lower(F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " "))))
    cluster = F.xxhash64(F.col(cluster_col).cast("string")) if cluster_col else folded
    no_cluster = F.col(cluster_col).isNull() if cluster_col else F.lit(False)
    d = docs.select(
        "doc_id", F.size(words).alias("_n"), cluster.alias("cluster"), no_cluster.alias("no_cluster"),
        F.xxhash64(F.col("source").cast("string")).alias("source"), F.col("source").isNull().alias("no_source"),
    )
    last = F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("int")
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * capacity
    return d.select("doc_id", "piece", start.alias("start_word"), F.least(F.lit(capacity), F.col("_n") - start).cast("int").alias("n_words"), "source", "no_source", "cluster", "no_cluster")


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster_col: str | None = None, seed: int = 7, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start_word, n_words, bin and bin_start (words before it in the bin)."""
    cut_up = cut(pieces(docs, capacity, cluster_col), "pieces")
    groups = max(1, math.ceil(cut_up.where("n_words > 0").count() / group_pieces))
    dealt = cut_up.where("n_words > 0").withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "cluster", "source"), F.lit(groups)).cast("long"))

    def one_group(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_words", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "cluster", "source"))])
        arr = lambda c: t[c].to_numpy()
        bins, starts = best_fit(arr("n_words"), arr("source"), arr("no_source").astype(bool), arr("cluster"), arr("no_cluster").astype(bool), capacity)
        g = t["g"][0].as_py()
        return pa.table({
            "doc_id": t["doc_id"], "piece": t["piece"], "start_word": t["start_word"], "n_words": t["n_words"],
            "bin": pa.array([f"{g}-{b}" for b in bins], pa.string()), "bin_start": pa.array(starts.astype(np.int32)),
        })

    packed = dealt.groupBy("g").applyInArrow(one_group, SCHEMA)
    none = cut_up.where("n_words <= 0").select("doc_id", "piece", "start_word", "n_words", F.lit(None).cast("string").alias("bin"), F.lit(None).cast("int").alias("bin_start"))
    return packed.unionByName(none)
