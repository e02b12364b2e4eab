"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has hashed features: its prefixes and suffixes of 1 to 3 characters, its character 2- and 3-grams, and the word
itself, which makes the weights a lexicon. Words without a letter have no features of their own. Feature weights and label
transitions are learned together by gradient descent on the likelihood, with the expected features and moves that
forward-backward gives, from a bounded sample: TRAIN_PER_LABEL documents a label, those with the least hash, of each about
SEGMENT words in a stretch of SEGMENT_CHARS characters, cut anywhere in the text; labels beyond the MOST_LABELS commonest
are not learned. Sequences for training join two segments, of either label, so that transitions learn how rarely the
language changes and the model reads code-switched text. Forward-backward gives every word of every whole text the
probability of each label; a document's label is that with the largest sum (ties: the first by name), and its score the
mean probability of that label over the words that have a letter.

Long texts are cut into blocks of words whose transfer matrices are multiplied up first, so that a text of any length is
scored exactly, and all texts of a chunk take their steps together.

Defined cases: null or empty text, or one without a letter, is `und` with score 0; without any label the model has none
and all texts are `und`; null doc_id and repeated rows are scored like others; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import words

FEATURES = 1 << 17
#: The bounded sample: documents a label, and labels; of each document so many words, within so many characters.
TRAIN_PER_LABEL, MOST_LABELS, SEGMENT, SEGMENT_CHARS = 700, 256, 48, 640
EPOCHS, RATE = 30, 0.25
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLOCK = 32
U = np.uint64


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def _tables() -> dict[str, np.ndarray]:
    t = words.tables()
    byte = np.arange(256)
    # Bytes that make a letter likely: a-z, A-Z and lead bytes of two and more. Which characters are letters is settled by _lettered.
    t["ascii_letter"] = ((byte >= 97) & (byte <= 122)) | ((byte >= 65) & (byte <= 90))
    t["high"] = byte >= 0x80
    return t


def _lettered(data: np.ndarray, start: np.ndarray, end: np.ndarray, t: dict) -> np.ndarray:
    """Which words hold a letter: by their bytes where these tell, else by their characters."""
    if not len(start):
        return np.empty(0, dtype=bool)
    upto = lambda m: np.concatenate([[0], np.cumsum(m)])
    a, h = upto(t["ascii_letter"][data]), upto(t["high"][data])
    out = a[end] > a[start]
    for i in np.flatnonzero(~out & (h[end] > h[start])):
        out[i] = any(c.isalpha() for c in bytes(data[start[i] : end[i]]).decode(errors="ignore"))
    return out


class Vocabulary:
    """The distinct words of a chunk: of each word its place among them, and of each distinct word its features."""

    def __init__(self, w: words.Words, t: dict):
        h = w.hashes(t)
        self.hash, first, self.at = np.unique(h, return_index=True, return_inverse=True)
        self.start, self.end = w.start[first], w.end[first]
        self.letter = _lettered(w.data, self.start, self.end, t)


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one word after another, and how many each has. Characters are UTF-8 bytes here."""
    n = end - start
    value = t["value"][data]
    rows, codes = [np.arange(len(start))], [words.mix(hashes ^ U(0x57))]
    for k in (1, 2, 3):
        i = np.flatnonzero(n >= k)
        left, right = np.zeros(len(i), dtype=U), np.zeros(len(i), dtype=U)
        for j in range(k):
            left = left * U(31) + value[start[i] + j]
            right = right * U(31) + value[end[i] - k + j]
        rows += [i, i]
        codes += [words.mix(left ^ U(0x100 + k)), words.mix(right ^ U(0x200 + k))]
    for k in (2, 3):
        i = np.flatnonzero(n > k)
        count = n[i] - k + 1
        owner = np.repeat(i, count)
        at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        gram = np.zeros(len(owner), dtype=U)
        for j in range(k):
            gram = gram * U(31) + value[at + j]
        rows.append(owner)
        codes.append(words.mix(gram ^ U(0x300 + k)))
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.argsort(row, kind="stable")
    return (code[order] & U(FEATURES - 1)).astype(np.int64), np.bincount(row, minlength=len(start))


def _emissions(weights: np.ndarray, feature: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean weight of each word's features for every label."""
    if not len(count):
        return np.empty((0, weights.shape[1]), dtype=np.float32)
    return np.add.reduceat(weights[feature], np.cumsum(count) - count, axis=0) / np.sqrt(count)[:, None].astype(np.float32)


def _normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.reshape(len(x), -1).sum(axis=1).reshape(-1, *[1] * (x.ndim - 1)), 1e-300)


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Forward-backward: the probability of every label for every word. first: each text's first word, and the number of words."""
    forward, backward, _ = messages(emission, first, transition)
    return _normed(forward * backward) if len(emission) else emission


def expected_moves(forward: np.ndarray, backward: np.ndarray, e: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """How often each label is expected to follow each other one, the label before a text's first word included."""
    move = np.exp(transition - transition.max())
    left = np.empty_like(forward)
    left[1:] = forward[:-1]
    left[first[:-1][np.diff(first) > 0]] = 1.0 / forward.shape[1]
    right = e * backward
    total = np.einsum("ik,kl,il->i", left, move, right)
    return move * ((left / np.maximum(total, 1e-300)[:, None]).T @ right)


def messages(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word: what the words up to it say of its label, what those after it say, and the word's own say."""
    n, k = emission.shape
    if not n:
        return emission, emission, emission
    e = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64)
    move = np.exp(transition - transition.max())
    length = np.diff(first)
    per_text = -(-length // BLOCK)
    text = np.repeat(np.arange(len(length)), per_text)
    within = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = first[text] + within * BLOCK
    size = np.minimum(BLOCK, first[text + 1] - start)
    # Blocks in order of size, so that the words at step j are those of the first blocks.
    order = np.argsort(-size, kind="stable")
    blocks = start[order]
    alive = [int((size >= j + 1).sum()) for j in range(BLOCK)]

    # Transfer matrix of each block: product over its words of (move, then emission).
    product = np.repeat(np.eye(k)[None], len(text), axis=0)
    for j in range(BLOCK):
        m = alive[j]
        if m:
            product[:m] = _normed((product[:m] @ move) * e[blocks[:m] + j][:, None, :])
    by_block = np.empty_like(product)
    by_block[order] = product
    # Messages at the blocks' ends, block after block for all texts at once.
    base = np.cumsum(per_text) - per_text
    ahead, behind = np.empty((len(text), k)), np.empty((len(text), k))  # before the first word, after the last
    begin = np.full(k, 1.0 / k)
    most = int(per_text.max(initial=0))
    longest = np.argsort(-per_text, kind="stable")
    counts = [int((per_text >= j + 1).sum()) for j in range(most)]
    message = np.repeat(begin[None], len(length), axis=0)
    for j in range(most):
        i = longest[: counts[j]]
        ahead[base[i] + j] = message[i]
        message[i] = _normed(np.einsum("tk,tkl->tl", message[i], by_block[base[i] + j]))
    message = np.ones((len(length), k))
    for j in range(most):
        i = longest[: counts[j]]
        at = base[i] + per_text[i] - 1 - j
        behind[at] = message[i]
        message[i] = _normed(np.einsum("tkl,tl->tk", by_block[at], message[i]))
    # Within the blocks.
    forward, backward = np.empty((n, k)), np.empty((n, k))
    message = ahead[order]
    for j in range(BLOCK):
        m = alive[j]
        if m:
            message[:m] = _normed((message[:m] @ move) * e[blocks[:m] + j])
            forward[blocks[:m] + j] = message[:m]
    message = behind[order]
    for j in range(BLOCK - 1, -1, -1):
        m = alive[j]
        if m:
            backward[blocks[:m] + j] = message[:m]
            message[:m] = _normed((message[:m] * e[blocks[:m] + j]) @ move.T)
    return forward, backward, e


def learn(sequences: list[tuple[list[bytes], list[int]]], labels: int, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions that make the labels of the sequences likely: full-batch AdaGrad."""
    text = b" ".join(x for ws, _ in sequences for x in ws)
    w = words.Words(pa.array([text.decode()], pa.large_string()), t)
    v = Vocabulary(w, t)
    feature, count = _features(w.data, v.start, v.end, v.hash, t)
    count_root = np.sqrt(count).astype(np.float32)
    owner = np.repeat(np.arange(len(count)), count)
    gold = np.array([y for _, ys in sequences for y in ys])
    first = np.cumsum([0, *(len(ws) for ws, _ in sequences)])
    inner = np.ones(len(gold), dtype=bool)
    inner[first[:-1]] = False
    weights, move = np.zeros((FEATURES, labels), dtype=np.float32), np.zeros((labels, labels))
    seen_w, seen_m = np.full((FEATURES, labels), 1e-6, dtype=np.float32), np.full((labels, labels), 1e-6)
    target = np.eye(labels)
    went = np.zeros((labels, labels))
    np.add.at(went, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    begun = np.bincount(gold[first[:-1]], minlength=labels)
    for _ in range(EPOCHS):
        emission = _emissions(weights, feature, count) * v.letter[:, None]
        forward, backward, own = messages(emission[v.at], first, move)
        diff = (target[gold] - _normed(forward * backward)) * v.letter[v.at][:, None]
        by_word = np.stack([np.bincount(v.at, diff[:, k], minlength=len(count)) for k in range(labels)], axis=1).astype(np.float32) / count_root[:, None]
        g = np.stack([np.bincount(feature, by_word[owner, k], minlength=FEATURES) for k in range(labels)], axis=1).astype(np.float32) - 0.02 * weights
        seen_w += g * g
        weights += RATE * g / np.sqrt(seen_w)
        # The label before a first word is unknown: it counts as each label's share of the moves to that word's label.
        before = np.exp(move - move.max(axis=0))
        gm = went + before / before.sum(axis=0) * begun - expected_moves(forward, backward, own, first, move) - 0.1 * move
        seen_m += gm * gm
        move += RATE * gm / np.sqrt(seen_m)
    return weights, move


def sample(docs: DataFrame, labels: dict[str, int]) -> DataFrame:
    """lang, rank and stretch of TRAIN_PER_LABEL documents a label, all picked by hashes before any text leaves the JVM. labels: documents of each."""
    rank = F.xxhash64(F.lit(5), "doc_id")
    # A first bound on the rank lets about four times as many through, so that the window sorts a bounded number of rows.
    bounds = {x: -(1 << 63) + min((1 << 64) - 1, 4 * TRAIN_PER_LABEL * (1 << 64) // n) for x, n in labels.items()}
    bound = F.element_at(F.create_map(*[F.lit(y) for x, n in bounds.items() for y in (x, n)]), F.col("lang"))
    rows = docs.select("lang", "text", rank.alias("rank")).where(F.col("lang").isin(list(labels)) & (F.col("rank") <= bound))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = F.length("text")
    start = F.pmod(F.xxhash64(F.lit(6), "rank", "tie"), F.greatest(size - SEGMENT_CHARS, F.lit(0)) + 1).cast("int")
    rows = rows.select("lang", "rank", "tie", F.expr("text").substr(start + 1, F.lit(SEGMENT_CHARS)).alias("stretch"), (start > 0).alias("cut_before"), (start + SEGMENT_CHARS < size).alias("cut_after"))
    w = Window.partitionBy("lang").orderBy("rank", "tie")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= TRAIN_PER_LABEL)


def segment(stretch: str, cut_before: bool, cut_after: bool) -> list[str]:
    """The whole words of a stretch, SEGMENT at most. A stretch within one word has none."""
    words_in = WORD.findall(stretch)
    if cut_before and stretch[:1] not in " \t\n\x0b\x0c\r":
        words_in = words_in[1:]
    if cut_after and stretch[-1:] not in " \t\n\x0b\x0c\r":
        words_in = words_in[:-1]
    return words_in[:SEGMENT]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, weights and transitions, from a bounded sample of the labelled texts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LABELS).collect()}
    labels = sorted(counts)
    if not labels:
        return [], np.zeros((FEATURES, 0), dtype=np.float32), np.zeros((0, 0))
    drawn = sorted(((r["rank"], r["tie"], r["lang"], segment(r["stretch"], r["cut_before"], r["cut_after"])) for r in sample(known, counts).collect()), key=lambda r: r[:3])
    number = {x: i for i, x in enumerate(labels)}
    sequences = []
    for k in range(0, len(drawn), 2):
        pair = [(x.encode(), number[lang]) for _, _, lang, ws in drawn[k : k + 2] for x in ws]
        if pair:
            sequences.append(([x for x, _ in pair], [y for _, y in pair]))
    weights, move = learn(sequences, len(labels), _tables()) if sequences else (np.zeros((FEATURES, len(labels)), dtype=np.float32), np.zeros((len(labels),) * 2))
    return labels, weights, move


def label_texts(col: pa.Array, weights: np.ndarray, move: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each text the best label (-1: none) and its score."""
    w = words.Words(col, t)
    best, score = np.full(len(col), -1), np.zeros(len(col))
    if not len(w.start) or not weights.shape[1]:
        return best, score
    v = Vocabulary(w, t)
    feature, count = _features(w.data, v.start, v.end, v.hash, t)
    emission = _emissions(weights, feature, count) * v.letter[:, None]
    p = marginals(emission[v.at], w.first, move) * v.letter[v.at][:, None]
    sums = np.stack([np.bincount(w.doc, p[:, k], minlength=len(col)) for k in range(p.shape[1])], axis=1)
    total = np.bincount(w.doc, v.letter[v.at], minlength=len(col))
    has = total > 0
    best[has] = sums[has].argmax(axis=1)
    score[has] = np.clip(sums[has].max(axis=1) / total[has], 0, 1)
    return best, score


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    labels, weights, move = train(docs)
    names = pa.array([*labels, "und"], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tables()
        for batch in batches:
            for part in words.chunks(batch):
                best, score = label_texts(part.column(2), weights, move, t)
                best = np.where(best < 0, len(labels), best)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pc.take(names, pa.array(best)), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
