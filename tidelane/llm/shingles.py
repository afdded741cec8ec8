"""Words of many texts at once, their hashes, shingle sets and minhashes in numpy, for use in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_STEP = U(0x9E3779B97F4A7C15)
CHUNK = 1 << 18  # bytes of text that are worked on at once; a longer text makes a chunk of its own

_SEPARATOR = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_RANDOM = np.random.Generator(np.random.PCG64(20))
_LETTER = np.where(_SEPARATOR, U(0), _RANDOM.integers(1, 1 << 64, 256, dtype=np.uint64))[_LOWER]
_PLACE = _RANDOM.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * U(2) + U(1)
_PLACES = (1 << 16) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= _MIX[0]
    x ^= x >> U(27)
    x *= _MIX[1]
    x ^= x >> U(31)
    return x


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of the texts in data, which begin at the first of offsets, end at the others.

    inside tells the bytes of words, where other words are meant.
    starts and ends are the words' bytes in data; docs tells, for each text, how many words it and those before it have.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
        self.data, cut = data, offsets - offsets[0]
        word = ~_SEPARATOR[data] if inside is None else inside
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = cut[1:-1][(cut[1:-1] > 0) & (cut[1:-1] < len(data))]
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.docs = np.searchsorted(self.starts, cut[1:])

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, block: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased: a sum of its bytes' values times those of their places."""
        return self._hashes(self.ends, block)

    def beginnings(self, size: int) -> np.ndarray:
        """A hash of the first `size` bytes of each word that is longer; 0 for others."""
        longer = np.flatnonzero(self.ends - self.starts > size)
        out = np.zeros(len(self), dtype=np.uint64)
        if len(longer):
            x = np.zeros(len(longer), dtype=np.uint64)
            for k in range(size):
                x += _LETTER[self.data[self.starts[longer] + k]] * _PLACE[k]
            out[longer] = mix(x + U(size)) | U(1)
        return out

    def _hashes(self, ends: np.ndarray, block: int) -> np.ndarray:
        out = np.empty(len(self), dtype=np.uint64)
        at, n = 0, len(self)
        while at < n:  # blocks keep what is made for each byte small, whatever a text's length
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + block, "left")))
            begin, end = int(self.starts[at]), int(ends[to - 1])
            edges = np.empty(2 * (to - at), dtype=np.int64)
            edges[::2], edges[1::2] = self.starts[at:to] - begin, ends[at:to] - begin
            place = np.arange(end - begin, dtype=np.int32)
            place -= np.repeat(edges[::2].astype(np.int32), np.diff(np.append(edges[::2], end - begin)))
            place &= _PLACES
            x = _LETTER[self.data[begin:end]]
            x *= _PLACE[place]
            out[at:to] = np.add.reduceat(np.append(x, U(0)), edges)[::2]
            at = to
        return mix(out + (self.ends - self.starts).astype(np.uint64) * _STEP)

    def lines(self) -> np.ndarray:
        """How many words come before each line's end, a text's end being one, too; lines without words have none."""
        ends = np.unique(np.append(np.searchsorted(self.starts, np.flatnonzero(self.data == 10)), self.docs))
        return ends[ends > 0]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each text ends; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    cut = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), cut


def chunks(b: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """Rows from, to, and their words, for runs of rows of about `most` bytes of text."""
    data, cut = texts_of(b.column(column))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + most, "right")) - 1)
        yield at, to, Words(data[cut[at] : cut[to]], cut[at : to + 1])
        at = to


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k words in a row, from hashes of 1, 2, 4 ... words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, mix(h + U(k)), 1
    while size <= k:
        if k & size:
            here = part[done : done + n]
            out = here if out is None else mix(out * _STEP + here)
            done += size
        if 2 * size <= k:
            part = mix(part[:-size] * _STEP + part[size:])
        size *= 2
    return out


def distinct(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and of, without the later ones of equal pairs."""
    y = mix(x + of.astype(np.uint64) * _STEP)
    order = np.argsort(y, kind="stable")
    y = y[order]
    again = np.flatnonzero(y[1:] == y[:-1]) + 1
    if not len(again):
        return x, of
    keep = np.ones(len(x), dtype=bool)
    keep[order[again]] = False
    return x[keep], of[keep]


def shingles(h: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the windows of size words of each text, text by text, and how many each text has.

    A text with fewer words has its whole sequence as one; one without words has none. docs is as in Words.
    """
    n = np.diff(np.append(0, docs))
    x, first = grams(h, size), np.arange(max(len(h) - size + 1, 0))
    of = np.searchsorted(docs, first, "right")
    whole = first + size <= docs[of] if len(of) else np.zeros(0, bool)
    x, of = x[whole], of[whole]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        own = np.array([grams(h[docs[i] - n[i] : docs[i]], int(n[i]))[0] for i in few], dtype=np.uint64)
        x, of = np.append(x, own), np.append(of, few)
        order = np.argsort(of, kind="stable")
        x, of = x[order], of[order]
    x, of = distinct(x, of)
    return x, np.bincount(of, minlength=len(docs))


def digests(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, whatever the order of its hashes; n tells how many each has."""
    out = []
    begin = np.append(0, np.cumsum(n)[:-1]).astype(np.int64)
    has = n > 0
    for salt in (0xA24BAED4963EE407, 0x8CB92BA72F3D8DD7):
        d = np.zeros(len(n), dtype=np.uint64)
        if has.any():
            d[has] = mix(np.add.reduceat(mix(x + U(salt)), begin[has]) + n[has].astype(np.uint64))
        out.append(d.view(np.int64))
    return out[0], out[1]


def constants(seed: int, n: int) -> np.ndarray:
    """Odd 32-bit multipliers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def keys(x: np.ndarray, n: np.ndarray, c: np.ndarray, rows: int) -> np.ndarray:
    """For each set of one hash or more, len(c) / rows keys of `rows` 32-bit minhashes; n tells how many each has."""
    low = (x >> U(32)).astype(np.uint32)
    begin = np.append(0, np.cumsum(n)[:-1]).astype(np.int64)
    least = np.empty((len(n), len(c)), dtype=np.uint64)
    y, z = np.empty_like(low), np.empty_like(low)
    for j, m in enumerate(c):
        np.multiply(low, m, out=y)
        np.right_shift(y, np.uint32(15), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, np.uint32(0x2C1B3C6D), out=y)
        least[:, j] = np.minimum.reduceat(y, begin)
    spread = np.arange(1, rows + 1, dtype=np.uint64) * _STEP | U(1)
    place = np.arange(len(c) // rows, dtype=np.uint64)
    return mix((least.reshape(len(n), -1, rows) * spread).sum(axis=2) + place).view(np.int64)
