"""Byte-pair encoding and decoding with a memory-mapped automaton of frequent words and exact merges for the rest."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as sh
from .frequent import commonest
from .scratch import Scratch

FREQUENT = 30_000
NONE = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file of the kind BPE with word ends.

    The file's normaliser (NFC, white space, lower case), its pre-tokeniser (the pattern below, byte level) and
    the absence of a post-processor and a decoder are checked, for other files would need other steps.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]], [s["type"] for s in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["post_processor"] or spec["decoder"]:
            raise ValueError("not a word-end BPE file of the supported kind")
        self.end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max(chain(vocab.values(), self.special.values())) + 1)
        for t, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = t
        letters = byte_alphabet()
        self.first = [vocab.get(c, -1) for c in letters]
        self.last = [vocab.get(c + self.end, -1) for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))


class PairTable:
    """Ranks of merges by pair of ids, for arrays of pairs at once: open addressing with few probes."""

    def __init__(self, merges: dict[int, tuple[int, int]], bits: int = 18):
        self.bits, self.probes = max(bits, (4 * len(merges)).bit_length()), 0
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)  # -1: free
        self.new = np.zeros(max((r for r, _ in merges.values()), default=0) + 1, np.int32)
        keys, ranks = np.fromiter(merges, np.int64, len(merges)), np.array([r for r, _ in merges.values()], np.int32)
        self.new[ranks] = [i for _, i in merges.values()]
        while len(keys):
            at = self._slot(keys, self.probes)
            free = np.flatnonzero(self.key[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            took = free[first]
            self.key[at[took]], self.rank[at[took]] = keys[took], ranks[took]
            rest = np.ones(len(keys), bool)
            rest[took] = False
            keys, ranks, self.probes = keys[rest], ranks[rest], self.probes + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (h.view(np.int64) + probe) & ((1 << self.bits) - 1)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        out, open_, probe = np.full(len(keys), NONE, np.int32), np.flatnonzero((a >= 0) & (b >= 0)), 0
        while len(open_):
            at = self._slot(keys[open_], probe)
            there = self.key[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.rank[at[hit]]
            open_, probe = open_[~hit & (there != -1)], probe + 1
        return out


class Merger:
    """Exact encoding of pieces of text, and the split of white-space-free stretches into pieces by the library's parts.

    Letters are normalised and told apart by the tokenizer library's own parts, for its tables of Unicode are of
    another version than Python's; merging is done here.
    """

    def __init__(self, v: Vocabulary):
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.v, self.table = v, PairTable(v.merges)
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.cut = pre_tokenizers.Split(Regex(v.pattern), "removed", invert=True)

    def pieces(self, raw: str) -> list[str]:
        return [p for p, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(raw))]

    def word(self, raw: str) -> list[int]:
        """Ids of a stretch of text without special tokens."""
        return list(chain.from_iterable(self.merge(p.encode()) for p in self.pieces(raw)))

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.v.first[b] for b in piece[:-1]] + [self.v.last[piece[-1]]]
        ids = [i for i in ids if i >= 0]
        return self._short(ids) if len(ids) < 100 else self._long(ids)

    def merge_many(self, pieces: list[bytes], most: int = 40, block: int = 4096) -> list[list[int]]:
        """merge() of each: pieces of like length stand in a matrix, and each step merges one pair in every row."""
        out: list[list[int]] = [[]] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        known = min(self.v.first) >= 0 and min(self.v.last) >= 0
        first, last = np.array(self.v.first, np.int32), np.array(self.v.last, np.int32)
        while order and (not known or len(pieces[order[-1]]) > most):
            i = order.pop()
            out[i] = self.merge(pieces[i])
        for at in range(0, len(order), block):
            own = np.array(order[at : at + block])
            size = np.array([len(pieces[i]) for i in own])
            width = int(size[-1])
            s = np.full((len(own), width + 1), -1, np.int32)
            data = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8)
            s[:, :width][np.arange(width) < size[:, None]] = first[data]
            s[np.arange(len(own)), size - 1] = last[data[np.cumsum(size) - 1]]
            rank = self.table.get(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(own), width)
            column = np.arange(width)
            while len(own):
                m = rank.argmin(axis=1)
                row = np.arange(len(own))
                best = rank[row, m]
                done = best == NONE
                if done.any():
                    ids, n = s[done], (s[done] >= 0).sum(axis=1)
                    for i, x, k in zip(own[done].tolist(), ids.tolist(), n.tolist(), strict=True):
                        out[i] = x[:k]
                    live = ~done
                    own, s, rank, m, best = own[live], s[live], rank[live], m[live], best[live]
                    row = np.arange(len(own))
                    if not len(own):
                        break
                after = column > m[:, None]
                s[:, :-1] = np.where(after, s[:, 1:], s[:, :-1])
                s[:, -1] = -1
                s[row, m] = self.table.new[best]
                rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
                rank[:, -1] = NONE
                rank[row, m] = self.table.get(s[row, m], s[row, m + 1])
                has = np.flatnonzero(m > 0)
                rank[has, m[has] - 1] = self.table.get(s[has, m[has] - 1], s[has, m[has]])
        return out

    def _short(self, ids: list[int]) -> list[int]:
        merges, none = self.v.merges, (1 << 60, -1)
        best = [merges.get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while best:
            at = best.index(low := min(best))
            if low is none:
                break
            ids[at : at + 2] = [low[1]]
            del best[at]
            if at:
                best[at - 1] = merges.get(ids[at - 1] << 32 | ids[at], none)
            if at < len(best):
                best[at] = merges.get(ids[at] << 32 | ids[at + 1], none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for pieces of any length."""
        merges, n = self.v.merges, len(ids)
        left, right, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def push(i: int) -> None:
            if i >= 0 and (j := right[i]) >= 0 and (m := merges.get(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            push(left[i]), push(i)
        return [x for x in ids if x >= 0]


SPACE, LETTER, NUMBER, OTHER, STRANGE = range(5)
#: Code points up to here can be told apart by a table, but for those that may change or join with their neighbours.
LIMIT = 0x2100
_LONE = [(0, 0x300), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C1)]


class Splitter:
    """Cuts texts into pieces by arrays: letters, single numbers, other signs, and contractions.

    What a code point is, and what it becomes in lower case, is asked of the library once. A stretch between white
    space that holds any other code point is one strange piece, to be split by the library itself.
    """

    def __init__(self, merger: Merger):
        self.kind, self.low = np.full(LIMIT + 1, STRANGE, np.uint8), np.arange(LIMIT + 1, dtype=np.uint32)
        for c in chain.from_iterable(range(*r) for r in _LONE):
            n = merger.normal.normalize_str(chr(c))
            if len(n) == 1 and ord(n) < LIMIT:
                twice = merger.cut.pre_tokenize_str(n + n)
                letter = len(merger.cut.pre_tokenize_str("a" + n)) == 1
                self.kind[c], self.low[c] = SPACE if not twice else NUMBER if len(twice) == 2 else LETTER if letter else OTHER, ord(n)

    def split(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray, list[tuple[int, str]], np.ndarray]:
        """The pieces of text: UTF-8 of the normalised text, where pieces begin and end in it, the strange ones by number, and where each begins in text."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        small = np.minimum(points, LIMIT)
        kind, low = self.kind[small], self.low[small]
        n, strange_at = len(points), np.flatnonzero(kind == STRANGE)
        if len(strange_at):
            blank = np.concatenate([[-1], np.flatnonzero(kind == SPACE), [n]])
            k = np.unique(np.searchsorted(blank, strange_at))
            for i, j in zip(blank[k - 1] + 1, blank[k], strict=True):
                kind[i:j] = STRANGE
        before = np.append(np.uint8(SPACE), kind[:-1])
        begins = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        mark = np.flatnonzero((low == 39) & (kind == OTHER) & (before != OTHER))
        if len(mark):
            ahead = np.append(low, np.zeros(2, np.uint32))
            one, two = ahead[mark + 1], ahead[mark + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for at, size in ((mark[short], 2), (mark[long], 3)):
                begins[at + 1] = False
                rest = at + size
                rest = rest[rest < n]
                begins[rest] |= kind[rest] == LETTER
        ends = kind != SPACE
        ends[:-1] &= begins[1:] | (kind[1:] == SPACE)
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not n or int(low.max()) < 128 and not len(strange_at):
            return low.astype(np.uint8).tobytes(), starts, ends, [], starts
        strange = [(int(i), text[starts[i] : ends[i]]) for i in np.flatnonzero(kind[starts] == STRANGE)] if len(strange_at) else []
        low[strange_at] = ord("?")
        wide = np.concatenate([[0], np.cumsum(1 + (low >= 0x80) + (low >= 0x800))])
        return low.tobytes().decode("utf-32-le").encode(), wide[starts], wide[ends], strange, starts


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton over the words' bytes, with each word's ids, as one block of 32-bit numbers.

    Words enter in sorted order; a state whose word ends and arcs equal another's is replaced by it, so
    suffixes are shared. Each arc carries how many words sort before those through it, so that a word's path
    sums to its number, and the number finds its ids. Layout: counts of states, arcs and words; first arc by
    state; whether a word ends, by state; byte, target and number by arc; first id by word; the ids.
    """
    words = sorted(entries.items())
    states: list[tuple[bool, tuple]] = []
    register: dict[tuple[bool, tuple], int] = {}
    path: list[list] = [[False, []]]  # of each open state: whether a word ends, and its arcs (byte, state)
    before = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1].append((before[len(path) - 1], register[key]))

    for w, _ in words:
        same = 0
        while same < min(len(w), len(before)) and w[same] == before[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in range(len(w) - same))
        path[-1][0], before = True, w
    close(0)
    states.append((path[0][0], tuple(path[0][1])))  # the root comes last
    under = np.zeros(len(states), dtype=np.int64)
    first, byte, target, number = [0], [], [], []
    for i, (final, arcs) in enumerate(states):
        at = int(final)
        for b, s in arcs:
            byte.append(b), target.append(s), number.append(at)
            at += int(under[s])
        under[i] = at
        first.append(len(byte))
    starts = np.append(0, np.cumsum([len(ids) for _, ids in words])).astype(np.uint32)
    parts = [
        [len(states), len(byte), len(words)], first, [int(f) for f, _ in states], byte, target, number, starts,
        list(chain.from_iterable(ids for _, ids in words))
    ]
    return np.concatenate([np.asarray(p, dtype=np.uint32) for p in parts]).tobytes()


class Lexicon:
    """Lookups in a compiled lexicon through a memory map, in which each state has a row of targets by byte."""

    def __init__(self, block: bytes):
        n = np.frombuffer(block, dtype=np.uint32)
        states, arcs, words = (int(x) for x in n[:3])
        cut, at = [], 3
        for size in (states + 1, states, arcs, arcs, arcs, words + 1):
            cut.append(n[at : at + size].astype(np.int32))
            at += size
        first, final, byte, target, number, self.start = cut
        self.final, self.ids, self.root = final == 1, n[at:].astype(np.int32), states - 1
        used = np.unique(byte)
        self.column = np.zeros(256, np.int32)  # bytes that no word has share column 0, whose targets are -1
        self.column[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        rows = np.full((2, states, self.width), -1, np.int32)
        at = np.repeat(np.arange(states), np.diff(first)), self.column[byte]
        rows[0][at], rows[1][at] = target, number
        with tempfile.TemporaryFile() as f:  # of this worker alone, gone with it
            f.write(rows.tobytes())
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.target, self.number = np.frombuffer(self.map, dtype=np.int32).reshape(2, -1)

    def numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word, a stretch of data; -1 if the lexicon hasn't got it. All words take a step at a time."""
        out, own = np.full(len(starts), -1, np.int32), np.arange(len(starts))
        column = self.column[data]
        state, number, k = np.full(len(own), self.root, np.int32), np.zeros(len(own), np.int32), 0
        while len(own):
            ended = sizes == k
            if ended.any():
                done = ended & self.final[state]
                out[own[done]] = number[done]
                own, state, number, starts, sizes = (x[~ended] for x in (own, state, number, starts, sizes))
            at = state * np.int32(self.width) + column[starts + k]
            state = self.target[at]
            number = number + self.number[at]
            live = state >= 0
            if not live.all():
                own, state, number, starts, sizes = (x[live] for x in (own, state, number, starts, sizes))
            k += 1
        return out


def _ragged(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of pool that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    return pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Encoder:
    """Ids of whole texts: pieces by arrays, the lexicon's ids for those it has, exact merges for all others."""

    def __init__(self, v: Vocabulary, lexicon: bytes | None):
        self.merger, self.lexicon = Merger(v), Lexicon(lexicon) if lexicon else None
        self.splitter = Splitter(self.merger)
        self.marks = regex.compile("|".join(f"({regex.escape(s)})" for s in v.special)) if v.special else None

    def _parts(self, text: str | None, most: int = 1 << 18) -> list[str]:
        """text between its special tokens, and these; long parts are cut at spaces, for no piece goes beyond one."""
        special = self.merger.v.special
        parts = [p for p in self.marks.split(text) if p] if text and any(s in text for s in special) else [text] if text else []
        out = []
        for p in parts:
            while len(p) > most and (at := p.rfind(" ", 0, most) if " " in p[:most] else p.find(" ", most)) >= 0:
                out.append(p[:at])
                p = p[at + 1 :]
            out.append(p)
        return [p for p in out if p]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after another, and how many each has."""
        special, parts, of = self.merger.v.special, [], []
        for k, t in enumerate(texts):
            own = self._parts(t)
            parts += own
            of += [k] * len(own)
        flat, n = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(parts):
            to, size = at, 0
            while to < len(parts) and (to == at or size + len(parts[to]) < 1 << 18):
                size += len(parts[to])
                to += 1
            ids, counts = self._encode(
                ["" if p in special else p for p in parts[at:to]], {i: special[p] for i, p in enumerate(parts[at:to]) if p in special}
            )
            flat.append(ids)
            np.add.at(n, of[at:to], counts)
            at = to
        return np.concatenate(flat), n

    def _encode(self, parts: list[str], special: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, and how many each has; special gives the one id of some."""
        raw, starts, ends, strange, place = self.splitter.split("\n".join(parts))
        data, sizes = np.frombuffer(raw, np.uint8), ends - starts
        number = self.lexicon.numbers(data, starts, sizes) if self.lexicon else np.full(len(starts), -1, np.int32)
        if strange:
            number[[i for i, _ in strange]] = -1
        other = {i: self.merger.word(w) for i, w in strange}
        unseen = [i for i in np.flatnonzero(number < 0).tolist() if i not in other] if other else np.flatnonzero(number < 0).tolist()
        known: dict[bytes, int] = {}
        which = [known.setdefault(raw[i:j], len(known)) for i, j in zip(starts[unseen].tolist(), ends[unseen].tolist(), strict=True)]
        merged = [*self.merger.merge_many(list(known)), *other.values()]
        held, first = (self.lexicon.ids, self.lexicon.start) if self.lexicon else (np.zeros(0, np.int32), np.zeros(1, np.int32))
        length = np.array([len(m) for m in merged], dtype=np.int64)
        pool = np.concatenate([held, np.fromiter(chain.from_iterable(merged), np.int32, int(length.sum()))])
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        hit = np.flatnonzero(number >= 0)
        begin[hit] = first[number[hit]]
        count[hit] = first[number[hit] + 1] - begin[hit]
        new = np.append(0, np.cumsum(length))[:-1] + len(held)
        at = np.array([*unseen, *other], dtype=np.int64)
        of = np.array([*which, *range(len(known), len(merged))], dtype=np.int64)
        begin[at], count[at] = new[of] if len(of) else 0, length[of] if len(of) else 0
        ids = _ragged(pool, begin, count)
        cut = np.cumsum([len(p) + 1 for p in parts])  # the parts' ends, with what joins them
        piece = np.searchsorted(place, cut)
        total = np.append(0, np.cumsum(count))[piece]
        n = np.diff(np.append(0, total))
        if special:
            ids = np.insert(ids, [int(total[i]) for i in special], list(special.values()))
            n[list(special)] = 1
        return ids, n


class Writer:
    """Digits and tokens of ids, as bytes, by arrays."""

    def __init__(self, tokens: list[str]):
        self.pools = []
        for words in ([b" %d" % i for i in range(len(tokens))], [b" " + t.encode() for t in tokens]):
            size = np.array([len(w) for w in words], dtype=np.int64)
            self.pools.append((np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size))

    def _write(self, pool: tuple, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        data, start, size = pool
        ends = np.append(0, np.cumsum(size[ids]))[np.append(0, np.cumsum(n))]
        out = _ragged(data, start[ids], size[ids]).tobytes()
        return [out[i + 1 : j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def digits(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """For each text, of n ids, these in decimal, joined by a space."""
        return self._write(self.pools[0], ids, n)

    def decoded(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """For each text its tokens, special ones too, joined by a space, in UTF-8."""
        return self._write(self.pools[1], ids, n)


_made: dict[str, tuple] = {}


def _tools(shipped) -> tuple[Encoder, Writer]:
    """The encoder and writer of a worker process, made once for all its tasks; another lexicon takes the place of the last."""
    v, lexicon, name = shipped.value
    if name not in _made:
        _made.clear()
        _made[name] = Encoder(v, lexicon), Writer(v.tokens)
    return _made[name]


def _shipped(sc, v: Vocabulary, lexicon: bytes | None):
    """A broadcast of a size that the vocabulary and the lexicon's number of entries bound."""
    return sc.broadcast((v, lexicon, uuid.uuid4().hex))


def piece_counts(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(piece, n) over all texts of docs, but for strange pieces; each task counts first."""
    shipped = _shipped(docs.sparkSession.sparkContext, v, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _tools(shipped)
        seen: Counter = Counter()
        whole = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"]
        )
        held = 0
        for b in batches:
            for t in b.column("text"):
                for part in encoder._parts(t.as_py()):
                    raw, starts, ends, strange, _ = encoder.splitter.split(part)
                    begin, end = starts.tolist(), ends.tolist()
                    for i, _ in strange:
                        begin[i] = end[i]
                    seen.update(map(raw.__getitem__, map(slice, begin, end)))
            if len(seen) > 100_000:
                yield whole()
                seen.clear()
        yield whole()

    return docs.select("text").mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, v: Vocabulary, scratch: Scratch, frequent: int = FREQUENT) -> bytes | None:
    """The lexicon of the commonest pieces, `frequent` at most; None where no piece comes twice."""
    counts = scratch.table(piece_counts(docs, v).where((F.col("n") > 1) & F.length("piece").between(1, 40)))
    top = commonest(counts, "n", frequent).orderBy("piece").collect()
    scratch.drop(counts)
    words = [bytes(r.piece) for r in top]
    return compile_lexicon(dict(zip(words, Merger(v).merge_many(words), strict=True))) if words else None


def _chunks(b: pa.RecordBatch, column: str, most: int = sh.CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of b with about `most` bytes of text; a longer text makes one of its own."""
    _, cut = sh.texts_of(b.column(column))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + most, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def _hex(texts: list[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())


def encode_documents(docs: DataFrame, v: Vocabulary, lexicon: bytes | None, digests: bool = False) -> DataFrame:
    """docs with ids: the token ids of each whole text, equal to the tokenizer library's without added tokens.

    Null and empty texts have no ids; columns that are named as the new ones already are replaced. The strings of
    special tokens in a text become these tokens, as there. With digests, n_tokens, ids_sha256 and decoded_sha256
    come, too: of the ids in decimal joined by a space, and of the text that decoding them gives. Repeated rows
    are encoded each; an empty table gives an empty result.
    """
    made = ["ids", *(["n_tokens", "ids_sha256", "decoded_sha256"] if digests else [])]
    names, shipped = [c for c in docs.columns if c not in made], _shipped(docs.sparkSession.sparkContext, v, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = _tools(shipped)
        for b in batches:
            for part in _chunks(b, "__text"):
                ids, n = encoder.encode(part.column("__text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids))
                more = [pa.array(n), _hex(writer.digits(ids, n)), _hex(writer.decoded(ids, n))] if digests else []
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("__text"), lists, *more], ["row", "__text", *made])

    row = docs.select(F.struct(*(n for n in names if n != "text"), F.lit(0).alias("__none")).alias("row"), F.col("text").alias("__text"))
    more = [F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")] if digests else []
    out = row.mapInArrow(run, row.select("row", "__text", F.lit(None).cast("array<int>").alias("ids"), *more).schema)
    return out.select(*(F.col("__text").alias(n) if n == "text" else F.col("row")[n].alias(n) for n in names), *made)


def decode_documents(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """encoded (with ids) with decoded: the tokens of ids, special ones too, joined by a space; no or null ids: empty."""
    names = [c for c in encoded.columns if c != "decoded"]
    shipped = encoded.sparkSession.sparkContext.broadcast(v.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(shipped.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids = part.column("__ids")
                text = writer.decoded(ids.flatten().to_numpy(), ids.value_lengths().fill_null(0).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), ids, pa.array([t.decode() for t in text], pa.string())], ["row", "__ids", "decoded"]
                )

    row = encoded.select(F.struct(*(n for n in names if n != "ids"), F.lit(0).alias("__none")).alias("row"), F.col("ids").alias("__ids"))
    out = row.mapInArrow(run, row.select("row", "__ids", F.lit("").alias("decoded")).schema)
    return out.select(*(F.col("__ids").alias(n) if n == "ids" else F.col("row")[n].alias(n) for n in names), "decoded")


def text_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs, for the tokenizer file at path.

    The ids stay in the worker that encodes and decodes them. Null and empty texts have no token; repeated rows
    count each; an empty table gives an empty result; columns besides doc_id and text are not looked at.
    """
    v = Vocabulary(path)
    shipped = _shipped(docs.sparkSession.sparkContext, v, build_lexicon(docs, v, Scratch(docs.sparkSession, "op3")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = _tools(shipped)
        for b in batches:
            for part in _chunks(b, "text"):
                ids, n = encoder.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), _hex(writer.digits(ids, n)), _hex(writer.decoded(ids, n))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodings and decodings of the whole documents table."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return text_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
