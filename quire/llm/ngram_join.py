"""Jaccard self-join of documents on five-word shingles, by adaptive multi-match prefixes.

Two texts link when 100 * |A & B| >= 75 * |A | B| over their sets of distinct shingles. Equal sets form a class, and the
join runs on classes. All sets are ordered by shingle hash. With o(n) = ceil(0.75 n), the overlap that a set of n
shingles needs at least, a set's *window* is its first n - o + slack shingles, slack = ceil(SLACK * n): two sets that
link share `slack` shingles or more of both windows, with the lesser slack of the two. A partner has 0.75 n shingles or
more, so its slack is at least s = ceil(0.75 * SLACK * n). Hence of its window a set can leave out the s - 1 commonest
shingles, and must then share one of the others with any partner; leaving out s - q, it must share q. This prefix of the
|window| - s + q rarest shingles is lengthened while the estimated cost (postings scanned, and candidates verified, that
become fewer as q grows) falls. Shingles that one class alone has make up most prefixes and cost nothing.

A set whose prefix is still common (a text that is mostly a passage of many others) takes its whole set as its window,
slack = o: then only the shingles outside the rarest n - o + 1 are left out. Links between two such sets are found at
this second level, all others at the first, by the side that is not such a set. For them q is 1: the shingles of a
passage come together, so that asking for more of them would not thin out the candidates.

Prefixes follow one order of shingles, by number of classes and then hash, so that those of both sides must meet.
Candidates: of each set, its nearest neighbour by size in the posting lists and the most typical set of its lists are
verified first and linked groups merged. Then every pair of the posting lists whose sides are in different groups, and
whose sizes, and at the second level numbers of shingles of their own and parity bitmaps, allow a link, is counted over the shingles that stand early enough in
both to be among the first q shared, kept with the lesser q of them or more and room for enough overlap after the last of them, and verified on the whole sets. So no link between different groups is lost, and a
large group of near copies costs a few candidates a member, not all its pairs. Nothing is capped or sampled.

Defined cases: null text, and text without words, has an empty set, linked with nothing; repeated rows are copies; an
empty table gives an empty result; other columns are not read. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import words
from quire.llm.common import apart, cut, discard, release, together
from quire.llm.components import components

PERCENT = 75
#: Share of a set by which its window is longer than the shortest possible.
SLACK = 0.05
#: Verification of a candidate costs as much as so many postings.
VERIFY = 20
#: Longest prefix extension: shared shingles asked for.
MOST = 6
#: Mean number of other classes that hold a prefix's shingles, over which a set goes to the second level.
COMMON = 12
#: 64-bit words of the parity bitmap of a set at the second level.
CELLS = 8
#: Least and most bits of the filter through which later passes over the texts pick sets, eight bits a set: 32 MB at most. An exact join follows.
LEAST_BITS, FILTER_BITS = 1 << 20, 1 << 28


def need(n):
    """Least overlap of a set of n with any partner."""
    return (PERCENT * n + 99) // 100


def slack(n):
    return np.maximum(1, np.ceil(SLACK * n)).astype(np.int64)


def _sets(docs: DataFrame, emit, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, state = words.tables(), {}
        for batch in batches:
            for part in words.chunks(batch):
                yield emit(part, words.shingle_sets(part.column(1), t), state)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and sig (a hash of the set; null if empty)."""

    def emit(part, sets, state):
        sig = pa.array([words.set_hash(s) if len(s) else None for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), sig], names=["doc_id", "n_shingles", "sig"])

    return _sets(docs, emit, "doc_id long, n_shingles long, sig long")


def _new(sets, state, mask=None):
    """(sig, set) of the sets that this task meets for the first time and that the filter may hold."""
    seen = state.setdefault("seen", set())
    for s in sets:
        if len(s) and (sig := words.set_hash(s)) not in seen and (mask is None or mask[(sig % (8 * len(mask))) >> 3] >> (sig % 8) & 1):
            seen.add(sig)
            yield sig, s


def postings(docs: DataFrame, whole: np.ndarray | None = None) -> DataFrame:
    """(token, sig) of every window; with `whole`, of all shingles of the sets that this filter picks."""

    def emit(part, sets, state):
        sigs, out = [], []
        for sig, s in _new(sets, state, whole):
            out.append(s if whole is not None else s[: len(s) - need(len(s)) + int(slack(len(s)))])
            sigs.append(sig)
        tokens = np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)
        owner = np.repeat(np.array(sigs, dtype=np.int64), [len(x) for x in out]) if out else tokens
        return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(owner)], names=["token", "sig"])

    return _sets(docs, emit, "token long, sig long")


def whole_sets(docs: DataFrame, picked: np.ndarray) -> DataFrame:
    def emit(part, sets, state):
        got = list(_new(sets, state, picked))
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int64()), pa.array([s.tobytes() for _, s in got], pa.binary())], names=["sig", "tokens"])

    return _sets(docs, emit, "sig long, tokens binary").dropDuplicates(["sig"])


def filter_of(sigs: DataFrame) -> np.ndarray:
    """A bitmap of the column `sig`, of eight bits a row."""
    size = max(LEAST_BITS, min(FILTER_BITS, 1 << (8 * sigs.count()).bit_length()))
    at = F.pmod(F.col("sig"), F.lit(size))
    bits = sigs.select(F.floor(at / 8).alias("i"), F.expr("shiftleft(1, cast(pmod(sig, 8) as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    rows = bits.toArrow()
    mask = np.zeros(size // 8, dtype=np.uint8)
    mask[rows["i"].to_numpy().astype(np.int64)] = rows["b"].to_numpy().astype(np.uint8)
    return mask


def shared_tokens(posts: DataFrame) -> DataFrame:
    """sig -> its window's shingles that another class has too, rarest first: tokens, and df (in how many classes)."""
    # One shuffle of the postings. A shingle of very many classes is one sorted run of a task, which spills; counting first and joining back shuffles all postings twice.
    w = Window.partitionBy("token")
    counted = posts.select("token", "sig", F.min("sig").over(w).alias("a"), F.max("sig").over(w).alias("b"), F.count("*").over(w).cast("int").alias("df")).where("a <> b")
    return counted.groupBy("sig").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("t"))


def prefixes(shared: DataFrame, classes: DataFrame, whole: bool) -> DataFrame:
    """sig, n, w (size of the window), u (shingles that no other window has), q, prefix, mean and typical (how common the
    prefix's and all of the window's shingles are). Sets whose prefix is theirs alone are left out: they have no partner."""
    d = shared.join(classes, "sig")
    if whole:
        d = d.withColumn("w", F.col("n")).withColumn("s", F.expr(f"({PERCENT} * n + 99) div 100"))
    else:
        d = d.withColumn("w", F.expr(f"n - ({PERCENT} * n + 99) div 100 + greatest(1, cast(ceil(n * {SLACK}D) as bigint))"))
        d = d.withColumn("s", F.expr(f"greatest(1L, cast(ceil({SLACK} * {PERCENT} / 100 * n - 1e-9) as bigint))"))
    d = d.withColumn("base", F.expr("size(t) - s")).where("base + 1 > 0")
    cost = "array({})".format(", ".join(f"if({q} > s or base + {q} > size(t), 1e300, aggregate(slice(t, 1, cast(base + {q} as int)), 0D, (a, x) -> a + x.df - 1) * (1 + {VERIFY} / {q}D))" for q in range(1, MOST + 1)))
    d = d.withColumn("c", F.expr(cost))
    d = d.withColumn("mean", F.expr(f"c[0] / (1 + {VERIFY}) / (base + 1)"))
    # The parity of each of 512 cells that its shared shingles fall in: cells in which two sets differ are shingles that they do not share.
    bits = [
        F.expr(f"aggregate(t, 0L, (a, x) -> if(pmod(x.token, {CELLS}L) = {i}, a ^ shiftleft(1L, cast(shiftright(x.token, 6) & 63 as int)), a))") if whole else F.lit(0).cast("long")
        for i in range(CELLS)
    ]
    d = d.withColumns({f"b{i}": b for i, b in enumerate(bits)})
    fixed = F.lit(whole) | (F.col("mean") > COMMON)
    d = d.withColumn("q", F.when(fixed, 1).otherwise(F.expr("array_position(c, array_min(c))")).cast("int"))
    return d.select(
        "sig", "n", "w", F.expr("w - size(t)").alias("u"), "q", F.expr("transform(slice(t, 1, cast(base + q as int)), x -> x.token)").alias("prefix"),
        "mean", F.expr("aggregate(t, 0D, (a, x) -> a + x.df) / w").alias("typical"), *[f"b{i}" for i in range(CELLS)],
    )


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for i in range(x.num_rows):
                p, q = (np.frombuffer(x.column(k)[i].as_buffer(), dtype=np.uint64) for k in (2, 3))
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append(100 * both >= PERCENT * (len(p) + len(q) - both) and both > 0)
            yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = cut(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "ngram-sides")
    sets = cut(whole_sets(docs, filter_of(sides)).join(sides, "sig", "left_semi"), "ngram-sets")
    left, right = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("p")), sets.select(F.col("sig").alias("b"), F.col("tokens").alias("q"))
    out = cut(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(check, "a long, b long"), "ngram-links")
    discard(sides, sets)
    return out


def class_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, component over classes: links between sets that differ."""
    first = cut(prefixes(shared_tokens(postings(docs)), classes, False), "ngram-prefixes")
    release(docs)
    common = cut(first.where(F.col("mean") > COMMON).select("sig"), "ngram-common")
    mask = filter_of(common)
    posts = postings(docs, mask).join(common, "sig", "left_semi") if mask.any() else postings(docs.limit(0), mask)
    second = cut(prefixes(shared_tokens(posts), classes, True), "ngram-prefixes-whole")
    release(docs)
    bitmap = [f"b{i}" for i in range(CELLS)]
    row = ["sig", "n", "w", "u", "q", "typical", *bitmap, F.posexplode("prefix").alias("at", "token")]
    asks = first.select(F.lit(1).alias("level"), (F.col("mean") <= COMMON).alias("active"), *row).union(second.select(F.lit(2).alias("level"), F.lit(True).alias("active"), *row))
    asks = cut(asks.withColumn("at", F.col("u") + F.col("at") + 1), "ngram-asks")
    fits = lambda a, b: (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))

    # Of a set's neighbours in the posting lists, by size, that with which it shares most lists; and the same of the
    # sets that are most typical of a list, as the text that others were copied from.
    w = Window.partitionBy("level", "token")
    near = asks.withColumn("a", F.lag(F.struct("sig", "n")).over(w.orderBy("n", "sig"))).withColumn("b", F.max(F.struct("typical", "sig", "n")).over(w))
    near = near.select("sig", "n", F.posexplode(F.array("a", F.struct("b.sig", "b.n"))).alias("kind", "o"))
    near = near.where((F.col("o.sig") != F.col("sig")) & fits(F.col("n"), F.col("o.n"))).groupBy("sig", "kind", F.col("o.sig").alias("other")).agg(F.count("*").alias("c"))
    near = near.groupBy("sig", "kind").agg(F.max_by("other", F.struct("c", "other")).alias("other"))
    near = cut(near.select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b")).distinct(), "ngram-near")
    links = verified(near, docs)
    release(docs)

    # All pairs of the lists between sets that are not yet in one group and may still overlap enough.
    group = components(links).toDF("sig", "g")
    tagged = cut(asks.join(group, "sig", "left").withColumn("g", F.coalesce("g", "sig")), "ngram-asks-grouped")
    side = lambda d, k: d.select("level", "token", *[F.col(c).alias(c + k) for c in ("sig", "n", "w", "u", "q", "at", "g", *bitmap)])
    x, y = side(tagged.where("active"), "x"), side(tagged, "y")
    # At the first level u counts what no other window has: the partner may have it after its window's end. So only
    # whole sets are apart by it; windows are bounded by the positions in them and by what lies outside.
    apart = F.when(F.col("level") == 2, F.col("ux") + F.col("uy") + sum((F.bit_count(F.col(b + "x").bitwiseXOR(F.col(b + "y"))) for b in bitmap), F.lit(0))).otherwise(0)
    both = x.join(y, ["level", "token"]).where(
        (F.col("gx") != F.col("gy")) & fits(F.col("nx"), F.col("ny"))
        & ((F.least("qx", "qy") + F.least(F.col("wx") - F.col("atx"), F.col("wy") - F.col("aty")) + F.greatest(F.col("nx") - F.col("wx"), F.col("ny") - F.col("wy"))) * (100 + PERCENT) >= PERCENT * (F.col("nx") + F.col("ny")))
        & ((F.col("nx") + F.col("ny") - apart) * (100 + PERCENT) >= 2 * PERCENT * (F.col("nx") + F.col("ny")))
    )
    pairs = both.groupBy("level", "sigx", "sigy").agg(
        F.count("*").alias("c"), F.least(F.max("qx"), F.max("qy")).alias("q"), F.max("nx").alias("nx"), F.max("ny").alias("ny"),
        F.least(F.max("wx") - F.max("atx"), F.max("wy") - F.max("aty")).alias("after"), F.greatest(F.max("nx") - F.max("wx"), F.max("ny") - F.max("wy")).alias("outside"),
    )
    pairs = pairs.where((F.col("c") >= F.col("q")) & ((F.col("c") + F.col("after") + F.col("outside")) * (100 + PERCENT) >= PERCENT * (F.col("nx") + F.col("ny"))))
    pairs = pairs.select(F.least("sigx", "sigy").alias("a"), F.greatest("sigx", "sigy").alias("b")).distinct()
    pairs = cut(pairs.join(near, ["a", "b"], "left_anti"), "ngram-pairs")
    release(docs)
    out = components(links.union(verified(pairs, docs)))
    discard(first, second, asks, tagged, near, pairs)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document."""
    sigs = cut(signatures(docs), "ngram-signatures")
    classes = sigs.where("sig is not null").groupBy("sig").agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("first"))
    classes = cut(classes, "ngram-classes")
    merged = class_links(docs, classes.select("sig", "n"))
    rooted = classes.join(merged.toDF("sig", "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = cut(rooted.join(least, "root").select("sig", "component_id"), "ngram-components")
    out = sigs.join(by_class, "sig", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of linked documents that with the least doc_id; of rows that repeat it and its text, one."""
    found = near_duplicates(docs)
    first = cut(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct(), "ngram-first")
    rows = apart(docs, doc_id=F.col("doc_id"), th=F.xxhash64("text"))
    rows = rows.join(first.select(F.struct("doc_id").alias("v")), F.col("own.doc_id").eqNullSafe(F.col("v.doc_id")), "left_semi")
    return together(rows.dropDuplicates(["own"]), docs.columns)
