"""Quality rules: counted statistics and minimum-covariance-determinant outliers, in DataFrame operations only.

Statistics of a text (null counts as empty): words are runs of characters other than space and tab to carriage return;
n_dup_lines counts \\n-split lines that hold a word and equal an earlier line; n_repeat_words counts words covered by a
three-word window that occurs twice or more. Windows are compared by hash: 64 bits less the bits of the number of words.

The MCD estimate is taken for each (lang, source), for each lang and for all rows, however few they are, and then drawn to
that of the next wider group: with n rows its share is n / (n + PRIOR_ROWS). Null lang or source is a value like any other.
A concentration step is one pass that gathers counts and moments by distance bucket, so a hot group costs no more than its
partial aggregates; of the bucket in which the subset ends the moments count in part, so that the subset has h rows
exactly. Steps go on, for the groups that still change, until the determinant settles.

Defined cases: empty or null text has zero statistics and fails the base rule; texts of any length count whole; repeated
rows are each judged; of two starts with one determinant the first counts, and rows that tie at the edge of a subset are in
it to equal parts; an empty table gives an empty result; further columns pass through `kept` untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, discard, keep_rows, text_or_empty

#: Weight of the next wider group's estimate, in rows.
PRIOR_ROWS = 50
#: Share of rows in the covariance subset, and the factor that makes the estimate consistent (5 dimensions, normal data).
SUBSET, CONSISTENCY = 0.75, 1.41
#: Least standard deviation of each transformed statistic: differences below it are not evidence (one line in four said twice is none).
FLOOR = (0.5, 0.08, 0.35, 0.15, 0.12)
#: Squared distance above which a vector is rejected: beyond the 1 - 1e-9 quantile of chi-square with 5 degrees.
LIMIT = 50.0
#: Change of the logarithm of the root of the determinant at which a group has settled, and steps after which it is taken as it is.
SETTLED, MOST_STEPS = 1e-3, 40
#: Groups up to which their estimates are broadcast: at 0.4 KB each, 8 MB. Beyond it Spark chooses the join.
BROADCAST_GROUPS = 20_000
DIM = len(FLOOR)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: keep, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    word = r"[^\x20\x09-\x0D]"
    d = docs.select(*keep, text_or_empty().alias("_t"))
    d = d.select(
        *keep, F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(word)).alias("_lines"),
        F.filter(F.split("_t", r"[\x20\x09-\x0D]+", -1), lambda x: x != "").alias("_w"),
    )
    d = d.select(
        *keep, F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_w").alias("_n"), F.expr("length(bin(size(_w)))").alias("_b"), "_w",
    )
    # Most texts have no window twice. In others, (hash << bits | position), sorted: equal windows stand side by side.
    d = d.withColumn("_h", F.expr("if(_n < 4, cast(array() as array<bigint>), transform(sequence(0, greatest(_n - 3, 0)), i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _b)))"))
    d = d.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), cast(array() as array<bigint>), sort_array(transform(_h, (h, i) -> h | cast(i as bigint))))"))
    mask = "(shiftleft(1L, _b) - 1L)"
    pairs = f"zip_with(slice(_s, 1, _n - 3), slice(_s, 2, _n - 3), (a, b) -> if(shiftrightunsigned(a ^ b, _b) = 0L, shiftleft(a & {mask}, 32) | (b & {mask}), cast(null as bigint)))"
    d = d.withColumn("_p", F.expr(f"if(size(_s) = 0, _s, array_compact({pairs}))"))
    d = d.withColumn("_q", F.expr("sort_array(array_distinct(concat(transform(_p, x -> shiftrightunsigned(x, 32)), transform(_p, x -> x & 4294967295L))))"))
    # Each window of three adds the words that the one before it does not have.
    rep = F.expr("if(size(_q) = 0, 0L, 3L + aggregate(zip_with(slice(_q, 1, greatest(size(_q) - 1, 0)), slice(_q, 2, greatest(size(_q) - 1, 0)), (a, b) -> least(3L, b - a)), 0L, (a, x) -> a + x))")
    return d.select(*keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_lines", rep.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    """The transformed statistics, rounded so that sums do not hinge on the order of rows."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    raw = [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.log1p(100.0 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]
    return [F.round(c, 6).alias(f"x{j}") for j, c in enumerate(raw)]


PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _with_factor(est: DataFrame) -> DataFrame:
    """Adds l00..l44, the Cholesky factor of c00..c44, and logdet, the logarithm of its determinant. Entries refer to those before them."""
    entries = []
    for i, j in PAIRS:
        rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        entries.append(f"sqrt(greatest({rest}, {FLOOR[i] ** 2 * 1e-3}D)) as l{i}{j}" if i == j else f"({rest}) / l{j}{j} as l{i}{j}")
    det = " + ".join(f"ln(l{i}{i})" for i in range(DIM))
    return est.selectExpr("*", *entries, f"round({det}, 9) as logdet")


def _distance(df: DataFrame, *keep: str) -> DataFrame:
    """keep, and d2 = |L^-1 (x - m)|^2 by forward substitution."""
    z = [f"(x{i} - m{i}{''.join(f' - l{i}{k} * z{k}' for k in range(i))}) / l{i}{i} as z{i}" for i in range(DIM)]
    return df.selectExpr(*keep, *z, " + ".join(f"z{i} * z{i}" for i in range(DIM)) + " as d2").select(*keep, "d2")


def _center_and_spread(x: DataFrame) -> DataFrame:
    """key -> median and MAD of each coordinate, from counts of values rounded to 1/64."""
    coords = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"x{j}").alias("v")) for j in range(DIM)])).alias("e")

    def middle(h: DataFrame) -> DataFrame:
        w = Window.partitionBy("key", "j")
        cum = h.withColumn("c", F.sum("n").over(w.orderBy("q"))).withColumn("all", F.sum("n").over(w))
        return cum.where("2 * c >= all").groupBy("key", "j").agg(F.min("q").alias("q"))

    long = x.select("key", coords).select("key", "e.j", F.round(F.col("e.v") * 64).cast("long").alias("q"))
    med = cut(middle(long.groupBy("key", "j", "q").agg(F.count("*").alias("n"))), "mcd-median")
    dev = long.groupBy("key", "j", "q").agg(F.count("*").alias("n")).join(med.withColumnRenamed("q", "m"), ["key", "j"])
    mad = middle(dev.groupBy("key", "j", F.abs(F.col("q") - F.col("m")).alias("q")).agg(F.sum("n").alias("n")))
    both = med.withColumnRenamed("q", "m").join(mad, ["key", "j"])
    at = lambda c, j: F.max(F.when(F.col("j") == j, F.col(c) / 64.0))
    return both.groupBy("key").agg(
        *[at("m", j).alias(f"m{j}") for j in range(DIM)],
        *[F.greatest(1.4826 * at("q", j), F.lit(FLOOR[j])).alias(f"s{j}") for j in range(DIM)],
    )


def _c_step(x: DataFrame, est: DataFrame, first: bool, small: bool) -> DataFrame:
    """One concentration step for each (key, start) of est: moments of the share of rows that lie nearest."""
    d = _distance(x.join(F.broadcast(est) if small else est, "key"), "key", "start", *[f"x{j}" for j in range(DIM)])
    d = d.withColumn("bucket", F.floor(F.log(F.col("d2") + 1e-9) * 64))
    hist = d.groupBy("key", "start", "bucket").agg(
        F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS]
    )
    w = Window.partitionBy("key", "start")
    # The second start begins with the inner half.
    share = F.when((F.col("start") == 1) & F.lit(first), 0.5).otherwise(SUBSET)
    near = hist.withColumn("before", F.sum("n").over(w.orderBy("bucket")) - F.col("n")).withColumn("h", F.ceil(F.sum("n").over(w) * share))
    near = near.where("before < h").withColumn("part", F.least(F.lit(1.0), (F.col("h") - F.col("before")) / F.col("n")))
    part = lambda c: F.sum(F.col(c) * F.col("part")).alias(c)
    sums = near.groupBy("key", "start").agg(part("n"), *[part(f"s{i}") for i in range(DIM)], *[part(f"p{i}{j}") for i, j in PAIRS])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(DIM)]
    return _with_factor(sums.select(
        "key", "start", *[F.round(mean[i], 9).alias(f"m{i}") for i in range(DIM)],
        *[F.round(CONSISTENCY * (F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) + (FLOOR[i] ** 2 if i == j else 0.0), 9).alias(f"c{i}{j}") for i, j in PAIRS],
    ))


def estimates(x: DataFrame, small: bool = False) -> DataFrame:
    """key -> mean, covariance and its factor of the subset with the smallest determinant, over two starts. x: key, x0..x4."""
    first = _center_and_spread(x)
    diag = lambda i, j: F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)
    start = first.select("key", F.explode(F.array(F.lit(0), F.lit(1))).alias("start"), *[f"m{j}" for j in range(DIM)], *[diag(i, j).alias(f"c{i}{j}") for i, j in PAIRS])
    moving, settled = cut(_with_factor(start), "mcd-start"), []
    for k in range(MOST_STEPS):
        after = _c_step(x, moving, k == 0, small)
        before = moving.select("key", "start", F.col("logdet").alias("_before"))
        own = cut(after.join(before, ["key", "start"]).withColumn("_moves", F.lit(k == 0) | (F.abs(F.col("logdet") - F.col("_before")) > SETTLED)).drop("_before"), f"mcd-step{k}")
        discard(moving)
        settled.append(own.where("not _moves").drop("_moves"))
        moving = own.where("_moves").drop("_moves")
        moving.quire_path = own.quire_path
        if moving.isEmpty():
            break
        if k + 1 < MOST_STEPS:
            moving = cut(moving, "mcd-moving")
        else:
            settled.append(moving)
    found = reduce(DataFrame.unionByName, settled)
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("logdet", "start")))
    return cut(best.where("_r = 1").drop("_r"), "mcd")


def _drawn(est: DataFrame, rows: str, own: str, wider: str) -> DataFrame:
    """Replaces columns own + m0..c44 by the mixture of own's and wider's estimates, own weighing rows / (rows + PRIOR_ROWS)."""
    share = f"if({own}m0 is null, 0D, {rows} / ({rows} + {PRIOR_ROWS}D))"
    of = lambda c: f"coalesce({own}{c}, {wider}{c})"
    mixed = [f"_a * {of(f'm{i}')} + (1 - _a) * {wider}m{i} as _m{i}" for i in range(DIM)]
    mixed += [f"_a * {of(f'c{i}{j}')} + (1 - _a) * {wider}c{i}{j} + _a * (1 - _a) * ({of(f'm{i}')} - {wider}m{i}) * ({of(f'm{j}')} - {wider}m{j}) as _c{i}{j}" for i, j in PAIRS]
    names = [f"m{i}" for i in range(DIM)] + [f"c{i}{j}" for i, j in PAIRS]
    keep = [c for c in est.columns if c not in {own + n for n in names}]
    return est.selectExpr(*est.columns, f"{share} as _a", *mixed).select(*keep, *[F.col("_" + n).alias(own + n) for n in names])


def judged(stats: DataFrame) -> DataFrame:
    """Adds base_failed, distance2 and kept to statistics that carry lang and source."""
    piece = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c)))
    keys = [F.to_json(F.array(piece("lang"), piece("source"))), F.to_json(F.array(piece("lang"))), F.lit("[]")]
    rows = stats.withColumns({f"k{i}": k for i, k in enumerate(keys)}).withColumn("base_failed", base_failed()).select("*", *_vector())
    sound = rows.where(~F.col("base_failed"))
    groups = rows.groupBy("k0", "k1", "k2").agg(F.count_if(~F.col("base_failed")).alias("n0"))
    groups = cut(groups.withColumn("n1", F.sum("n0").over(Window.partitionBy("k1"))), "mcd-groups")
    small = groups.count() <= BROADCAST_GROUPS
    hint = F.broadcast if small else lambda df: df
    est = estimates(sound.select(F.explode(F.array("k0", "k1", "k2")).alias("key"), *[f"x{j}" for j in range(DIM)]), small)
    names = [f"m{i}" for i in range(DIM)] + [f"c{i}{j}" for i, j in PAIRS]
    for k, prefix in (("k0", "g"), ("k1", "l"), ("k2", "a")):
        groups = groups.join(hint(est.select(F.col("key").alias(k), *[F.col(c).alias(prefix + c) for c in names])), k, "left")
    groups = _drawn(_drawn(groups, "n1", "l", "a"), "n0", "g", "l")
    known = cut(_with_factor(groups.select("k0", *[F.col("g" + c).alias(c) for c in names])), "mcd-drawn")
    keep = [*stats.columns, "base_failed"]
    out = _distance(rows.join(hint(known), "k0", "left"), *keep)
    return out.select(*keep, F.col("d2").alias("distance2"), (~F.col("base_failed") & F.coalesce(F.col("d2") <= LIMIT, F.lit(True))).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, distance2 and kept of every document."""
    stats = cut(statistics(docs, "doc_id", "lang", "source"), "quality-stats")
    return judged(stats)


def kept(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, unchanged; rows are told apart by doc_id and text."""
    own = docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("th"))
    verdict = judged(cut(statistics(own, "doc_id", "th", "lang", "source"), "quality-stats"))
    return keep_rows(docs, cut(verdict.where("kept").select("doc_id", "th"), "quality-kept"))
