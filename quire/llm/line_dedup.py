"""Line dedup by a deletion-neighbourhood join.

Lines are \\n-split; a line's words are runs of characters other than space and tab to carriage return, with A-Z as a-z.
The edit distance of two lines is that of their word sequences (Levenshtein). The bound is 1 for lines of NEAR_WORDS words
or more, and 0 for shorter ones; lines without a word always stay. A line goes if an earlier line, in the order of
(doc_id, text hash, line number), lies within the bound of the two (the lesser of their bounds).

Equal lines form classes. Each class of NEAR_WORDS words or more emits the hash of every variant with up to one word
deleted; classes that share a variant at the same place (one word replaced), or of which one's variant is the other's
whole (one word more), are candidates; the words of both are then compared. Of the classes that share a variant only the
earliest matters to each other one, so candidates are found by minima, and a variant that very many lines share costs
no more than its rows. First, classes whose two halves (words before and after the middle, for either length) are no
other class's halves are set aside: one edit leaves one of the halves whole, so they have no neighbour.

Later passes over the texts pick lines through a bitmap with eight bits a line sought, of at most FILTER_BITS; where that
is full it lets more lines through, and an exact join on the line's key follows in any case.

Defined cases: null text stays null and has no lines; empty text is one empty line; texts and lines of any length are read
whole; rows that repeat doc_id and text are treated alike, and so stay or go together; an empty table gives an empty
result; columns other than doc_id and text pass through, whatever their names, but for n_lines and n_dropped, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words
from quire.llm.common import apart, cut, discard, release

NEAR_WORDS = 5
#: Least and most bits of the filter through which later passes over the texts pick lines: 32 MB at most.
LEAST_BITS, FILTER_BITS = 1 << 20, 1 << 28
U = np.uint64


def _sequence_tables() -> dict[str, np.ndarray]:
    t = words.tables()
    return t | {"w": _powers(4096, False), "winv": _powers(4096, True)}


def _powers(n: int, inverse: bool) -> np.ndarray:
    base = 0x9FB21C651E98DF25
    p = np.full(n, pow(base, -1, 1 << 64) if inverse else base, dtype=U)
    p[0] = 1
    return np.multiply.accumulate(p)


class Lines:
    """The lines of a text column that hold a word: doc, number (within the text), at (first word), n (words), key."""

    def __init__(self, col: pa.Array, t: dict[str, np.ndarray]):
        w = self.words = words.Words(col, t)
        h = self.h = w.hashes(t)
        breaks = np.concatenate([[0], np.cumsum(w.raw == 10)])
        line = breaks[w.start] if len(w.start) else np.empty(0, dtype=np.int64)
        new = np.ones(len(h), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(h)))
        k = np.arange(len(h)) - np.repeat(at, n)
        most = int(n.max(initial=1)) + 1
        self.w, self.winv = (t["w"], t["winv"]) if most <= len(t["w"]) else (_powers(most, False), _powers(most, True))
        #: sums[i]: of the terms before word i, over all lines of the column.
        self.sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(h * self.w[k], dtype=U)])
        self.at, self.n = at, n
        self.doc = w.doc[self.at] if len(self.at) else self.at
        self.number = (line[self.at] - breaks[w.offsets[self.doc]]) if len(self.at) else self.at
        self.key = words.mix(self.sums[self.at + self.n] - self.sums[self.at] + self.n.astype(U))

    def part(self, i: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of words a to b of lines i, wherever they stand."""
        at = self.at[i]
        return words.mix((self.sums[at + b] - self.sums[at + a]) * self.winv[a] + (b - a).astype(U))

    def halves(self, i: np.ndarray) -> np.ndarray:
        """Four hashes a line: its first and its last half, as long as for this length and for one word less."""
        n, out = self.n[i], []
        for k, h in enumerate((n // 2, (n - 1) // 2)):
            out += [self.part(i, np.zeros_like(n), h) ^ U(0x1111), self.part(i, n - h, n) ^ U(0x2222)]
        return np.stack(out, axis=1)

    def text(self, i: int) -> str:
        w, a = self.words, self.at[i]
        return bytes(w.data[w.start[a] : w.end[a + self.n[i] - 1]]).decode()


def _pass(docs: DataFrame, emit, schema: str, columns: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen = _sequence_tables(), set()
        for batch in batches:
            for part in words.chunks(batch):
                yield emit(part, Lines(part.column(part.schema.get_field_index("text")), t), seen)

    return docs.select(*columns).mapInArrow(run, schema)


def _unseen(keys: np.ndarray, seen: set) -> np.ndarray:
    """Places of the keys that this task has not met before."""
    out = []
    for i, k in enumerate(keys.tolist()):
        if k not in seen:
            seen.add(k)
            out.append(i)
    return np.array(out, dtype=np.int64)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, th, number, key and n of every line that may go; halves where this task meets the class first."""

    def emit(part, x: Lines, seen: set):
        near = np.flatnonzero(x.n >= NEAR_WORDS)
        near = near[_unseen(x.key[near], seen)]
        halves = x.halves(near).view(np.int64).ravel()
        has = np.zeros(len(x.n), dtype=np.int64)
        has[near] = 4
        off = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(off), pa.array(halves), mask=pa.array(has == 0)) if len(has) else pa.array([], pa.list_(pa.int64()))
        doc = pa.array(x.doc)
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(doc), part.column(1).take(doc), pa.array(x.number.astype(np.int32)), pa.array(x.key.view(np.int64)), pa.array(x.n.astype(np.int32)), lists],
            names=["doc_id", "th", "number", "key", "n", "halves"],
        )

    return _pass(docs, emit, "doc_id long, th long, number int, key long, n int, halves array<long>", ("doc_id", "th", "text"))


def line_hashes(docs: DataFrame, picked: np.ndarray) -> DataFrame:
    """key and the hashes of the words of the lines that the filter picks."""

    def emit(part, x: Lines, seen: set):
        i = _picked(x, picked, seen)
        return pa.RecordBatch.from_arrays([pa.array(x.key[i].view(np.int64)), pa.array([x.h[x.at[k] : x.at[k] + x.n[k]].tobytes() for k in i], pa.binary())], names=["key", "hashes"])

    return _pass(docs, emit, "key long, hashes binary", ("text",))


def variants(h: np.ndarray, n: np.ndarray, weights: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines of n words, their hashes h one after another: owner, position of the word left out (-1: none) and hash of each variant."""
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(h)) - first[owner]
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(h * weights[pos], dtype=U)])
    begin, end, at = first[owner], (first + n)[owner], np.arange(len(h))
    left = sums[at] - sums[begin] + (sums[end] - sums[at + 1]) * inverse[1]
    whole = words.mix(sums[first + n] - sums[first] + n.astype(U))
    return np.concatenate([owner, np.arange(len(n))]), np.concatenate([pos, np.full(len(n), -1)]), np.concatenate([words.mix(left + (n[owner] - 1).astype(U)), whole])


def variant_rows(lines: DataFrame) -> DataFrame:
    """v, pos, n and key of every variant. lines: key, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _sequence_tables()
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                held = [x.as_buffer() for x in part.column(1)]
                n = np.array([x.size // 8 for x in held], dtype=np.int64)
                most = int(n.max(initial=1)) + 1
                weights, inverse = (t["w"], t["winv"]) if most <= len(t["w"]) else (_powers(most, False), _powers(most, True))
                owner, pos, v = variants(np.frombuffer(b"".join(held), dtype=U), n, weights, inverse)
                key = part.column(0).to_numpy()[owner]
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(n[owner].astype(np.int32)), pa.array(key)], names=["v", "pos", "n", "key"])

    return lines.mapInArrow(run, "v long, pos int, n int, key long")


def line_words(docs: DataFrame, picked: np.ndarray) -> DataFrame:
    def emit(part, x: Lines, seen: set):
        i = _picked(x, picked, seen)
        return pa.RecordBatch.from_arrays([pa.array(x.key[i].view(np.int64)), pa.array([x.text(k) for k in i], pa.string())], names=["key", "line"])

    return _pass(docs, emit, "key long, line string", ("text",))


def _picked(x: Lines, mask: np.ndarray, seen: set) -> np.ndarray:
    at = x.key & U(8 * len(mask) - 1)
    i = np.flatnonzero((x.n >= NEAR_WORDS) & ((mask[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1).astype(bool))
    return i[_unseen(x.key[i], seen)]


def filter_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of the column `key`, of eight bits a row."""
    size = max(LEAST_BITS, min(FILTER_BITS, 1 << (8 * keys.count()).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(size - 1))
    bits = keys.select(F.shiftright(at, 6).alias("i"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    rows = bits.toArrow()
    mask = np.zeros(size // 64, dtype=np.int64)
    mask[rows["i"].to_numpy()] = rows["b"].to_numpy()
    return mask.view(np.uint8)


def shared(rows: DataFrame, by: str) -> DataFrame:
    """The rows whose value in column `by` more than one key has. Least and greatest keys are gathered within tasks first."""
    ends = rows.groupBy(by).agg(F.min("key").alias("_a"), F.max("key").alias("_b")).where("_a <> _b").select(by)
    return rows.join(ends, by, "left_semi")


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Levenshtein distance of two word sequences is 1 or less."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def near_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Keys of the classes with an earlier class within one edit. classes: key, first, n, halves."""
    halves = classes.where("halves is not null").select("key", F.explode("halves").alias("half"))
    suspect = cut(shared(halves, "half").select("key").distinct(), "lines-suspect")
    hashes = line_hashes(docs, filter_of(suspect)).join(suspect, "key", "left_semi").dropDuplicates(["key"])
    every = cut(variant_rows(hashes), "lines-every-variant")
    rows = cut(shared(every, "v").join(classes.select("key", "first"), "key"), "lines-variants")
    release(docs)
    first = F.struct("first", "key")
    replaced = rows.where("pos >= 0").groupBy("v", "pos", "n").agg(F.min(first).alias("w"))
    wholes = rows.where("pos < 0").groupBy("v").agg(F.min(first).alias("w"))
    longer = rows.where("pos >= 0").groupBy("v").agg(F.min(first).alias("w"))
    found = [
        rows.where("pos >= 0").join(replaced, ["v", "pos", "n"]),
        rows.where("pos >= 0").join(wholes, "v"),
        rows.where("pos < 0").join(longer, "v"),
    ]
    pairs = [d.where(F.col("w.first") < F.col("first")).select("key", F.col("w.key").alias("other")) for d in found]
    pairs = cut(pairs[0].union(pairs[1]).union(pairs[2]).distinct(), "lines-pairs")
    sides = cut(pairs.select(F.explode(F.array("key", "other")).alias("key")).distinct(), "lines-sides")
    text = cut(line_words(docs, filter_of(sides)).join(sides, "key", "left_semi").dropDuplicates(["key"]), "lines-text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = [within_one_edit(words_of(a), words_of(b)) for a, b in zip(x.column(1).to_pylist(), x.column(2).to_pylist())]
            yield x.select([0]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(text, "key").join(text.toDF("other", "other_line"), "other").select("key", "line", "other_line")
    out = cut(both.mapInArrow(check, "key long").distinct(), "lines-near")
    discard(suspect, every, rows, pairs, sides, text)
    return out


def words_of(line: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        line = line.replace(c, " ")
    return [w for w in line.split(" ") if w]


def lines_to_drop(docs: DataFrame) -> DataFrame:
    """doc_id, th and `gone`, the numbers of the lines that go. docs: doc_id, th (a hash of the text), text."""
    lines = cut(occurrences(docs), "lines")
    classes = lines.groupBy("key").agg(F.min(F.struct("doc_id", "th", "number")).alias("first"), F.first("halves", ignorenulls=True).alias("halves"), F.count("*").alias("c"))
    classes = cut(classes, "lines-classes")
    near = near_classes(docs, classes)
    verdict = classes.join(near.withColumn("near", F.lit(True)), "key", "left").where("near or c > 1").select("key", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.drop("halves", "n").join(verdict, "key").where(F.col("near") | ~F.col("first").eqNullSafe(F.struct("doc_id", "th", "number")))
    out = cut(gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("number")).alias("gone")), "lines-gone")
    discard(lines, classes, near)
    return out


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with their text less the lines that go, and n_lines and n_dropped (0 for null text)."""
    docs = docs.drop("n_lines", "n_dropped")
    th = F.xxhash64("text")
    gone = lines_to_drop(docs.select("doc_id", th.alias("th"), F.col("text").cast("string").alias("text")))
    release(docs)
    row, g = apart(docs, doc_id=F.col("doc_id"), th=th, text=F.col("text")), gone.select(F.struct("*").alias("g"))
    out = row.join(g, F.col("own.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("own.th") == F.col("g.th")), "left").withColumn("lines", F.split("own.text", "\n", -1))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), g.gone), i -> get(lines, i)), '\n')")
    columns = [F.when(F.col("g").isNull(), F.col("own.text")).otherwise(kept).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return out.select(*columns, size("lines").alias("n_lines"), size("g.gone").alias("n_dropped"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with their text less the lines that go, and n_chars to match; a document that loses lines and has no word left goes."""
    out = line_dedup(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars") if c == "n_chars" else c for c in docs.columns]
    return out.select(*columns)
