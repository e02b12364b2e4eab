"""Words, word hashes and shingles of whole Arrow text columns, by array operations on their UTF-8 bytes.

Words are runs of bytes other than space and tab to carriage return; A-Z counts as a-z where `fold` is set. A word's hash
is a polynomial over random byte values modulo 2^64, taken from the sums up to its ends, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is handled whole.
CHUNK = 1 << 18
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64 (fixed values)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def tables() -> dict[str, np.ndarray]:
    byte = np.arange(256)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    space = (byte == 32) | ((byte >= 9) & (byte <= 13))
    value = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    return {"lower": lower, "space": space, "value": value, "power": _powers(2 * CHUNK), "inverse": _powers(2 * CHUNK, inverse=True)}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = 0x5851F42D4C957F2B
    p = np.full(n, pow(base, -1, 1 << 64) if inverse else base, dtype=U)
    p[0] = 1
    return np.multiply.accumulate(p)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and where each row begins and ends in them; null rows have none."""
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    col = col.fill_null("") if col.null_count else col
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(off):
        return np.empty(0, dtype=np.uint8), np.zeros(len(col) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK bytes of text each."""
    col = batch.column(batch.schema.get_field_index(text))
    _, off = text_bytes(col)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


class Words:
    """The words of a text column: start, end (byte positions in data), doc (row), and first (each row's first word, and the number of words)."""

    def __init__(self, col: pa.Array, t: dict[str, np.ndarray], fold: bool = True):
        raw, self.offsets = text_bytes(col)
        self.raw = raw
        self.data = t["lower"][raw] if fold else raw
        inside = ~t["space"][raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = self.offsets[1:] > self.offsets[:-1]
        at = self.offsets[:-1][full]
        begins[at] = inside[at]
        at = self.offsets[1:][full] - 1
        ends[at] = inside[at]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(col)), np.diff(self.first))

    def hashes(self, t: dict[str, np.ndarray]) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, dtype=U)
        n = len(self.data)
        power, inverse = (t["power"], t["inverse"]) if n <= len(t["power"]) else (_powers(n), _powers(n, inverse=True))
        upto = np.zeros(n + 1, dtype=U)
        np.cumsum(t["value"][self.data] * power[:n], out=upto[1:])
        length = (self.end - self.start).astype(U)
        return mix((upto[self.end] - upto[self.start]) * inverse[self.start] + length * U(0x9E3779B97F4A7C15))


def shingle_sets(col: pa.Array, t: dict[str, np.ndarray], width: int = 5) -> list[np.ndarray]:
    """For each row the sorted hashes of its distinct shingles; a text with fewer words has its whole sequence as one."""
    w = Words(col, t)
    h = w.hashes(t)
    weight = mix(np.arange(101, 101 + width, dtype=U))
    n = len(h)
    total = np.zeros(max(n - width + 1, 0), dtype=U)
    for k in range(width):
        total += h[k : n - width + 1 + k] * weight[k] if n >= width else 0
    total = mix(total)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            out.append(mix((h[a:b] * weight[: b - a]).sum(keepdims=True) + np.array([b - a], dtype=U) * U(0xD1B54A32D192ED03)))
        else:
            out.append(np.empty(0, dtype=U))
    return out


def set_hash(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set, from its elements in any order."""
    return int((mix(mix(s ^ U(0xA0761D6478BD642F)).sum(keepdims=True) + U(len(s)))).view(np.int64)[0])
