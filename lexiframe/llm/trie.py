"""A compact, memory-mapped trigram trie: Elias-Fano levels and quantised smoothed log probabilities.

Levels of a trie (all id sequences are Elias-Fano coded, made increasing by adding their parent's base):

* ``v``: the middle words, each with a back-off weight;
* ``vw``: the words seen after ``v``, each with the smoothed ``log10 P(w | v)``;
* ``vu``: the words seen before ``v``, that is the contexts ``u v``, each with a back-off weight;
* ``uvw``: the words seen after ``u v``.  Such a word is stored as its position among the successors of ``v``
  (it must be one of them), so the numbers are small: the context-relative remapping.

A query looks ``v`` up, finds ``w`` among its successors by a successor search, and searches the position found
within the context ``u v``.  Pointers (where a parent's children begin) are increasing and Elias-Fano coded too.

Look-ups run on whole numpy arrays: a bucket of the high bits is found by two select operations on the bit
vector (directory per 64-bit word), the low bits are searched within it.
"""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np

LOG_FLOOR = -20.0
CODES = 65535  # 16-bit codes: a rounding error of at most 1.6e-4 in log10


def quantise(logp: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logp, LOG_FLOOR, 0) * (CODES / LOG_FLOOR)).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return code * (LOG_FLOOR / CODES)


_SELECT8 = np.zeros((256, 8), dtype=np.uint8)
for _b in range(256):
    for _k, _p in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT8[_b, _k] = _p


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the ``k``-th set bit (from 0) of each word."""
    w, k, pos = words.copy(), k.copy(), np.zeros(len(words), dtype=np.int64)
    for half in (32, 16, 8):
        low = w & np.uint64((1 << half) - 1)
        c = np.bitwise_count(low).astype(np.int64)
        up = k >= c
        k -= np.where(up, c, 0)
        w = np.where(up, w >> np.uint64(half), low)
        pos += np.where(up, half, 0)
    return pos + _SELECT8[w.astype(np.int64) & 255, k]


class EliasFano:
    """A non-decreasing sequence: ``low`` bits packed, high parts in unary in ``high``."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros, self.ones = n, width, low, high, zeros, ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, int(universe // max(n, 1)).bit_length() - 1)
        top = (values >> np.uint64(width)).astype(np.int64)
        n_high = int(universe >> width) + n + 2
        bits = np.zeros(-(-n_high // 64) * 64, dtype=np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        if width:
            low = np.zeros(-(-n * width // 64) + 2, dtype=np.uint64)
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = values & np.uint64((1 << width) - 1)
            np.bitwise_or.at(low, word, part << shift)
            spill = shift + np.uint64(width) > np.uint64(64)
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (np.uint64(64) - shift[spill]))
        else:
            low = np.zeros(2, dtype=np.uint64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]
        return cls(n, width, low, high, np.arange(len(ones), dtype=np.int64) * 64 - ones, ones)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        directory = self.ones if one else self.zeros
        word = np.searchsorted(directory, k, side="right") - 1
        w = self.high[word]
        return word * 64 + _select_in_word(w if one else ~w, k - directory[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        lo = self.low[word] >> shift
        hi = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (lo | hi) & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        top = (self._select(i, True) - i).astype(np.uint64)
        return (top << np.uint64(self.width) | self._low(i)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: the successor search, then a comparison."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        top = (x >> np.uint64(self.width)).astype(np.int64)
        inside = np.flatnonzero(top < self.zeros[-1])
        top, want = top[inside], x[inside] & np.uint64((1 << self.width) - 1)
        lo = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) - top + 1, 0)
        end = self._select(top, False) - top
        hi = end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        ok = np.flatnonzero(lo < end)
        ok = ok[self._low(lo[ok]) == want[ok]]
        out[inside[ok]] = lo[ok]
        return out

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros, self.ones]


_LEVELS = ("v", "v_first", "vw", "vu", "vu_first", "uvw_base", "uvw")
_TABLES = ("v_bow", "vw_p", "vu_bow", "uvw_p")


class Trie:
    """A trie over sorted, distinct trigrams ``(v, u, w)`` with counts."""

    def __init__(self, levels: dict[str, EliasFano], tables: dict[str, np.ndarray], span: int):
        self.levels, self.tables, self.span = levels, tables, span

    @classmethod
    def build(cls, v, u, w, count, bv, bw, bc, v_total, b_log1, strength2: float, strength3: float, span: int) -> Trie:
        """``v, u, w, count``: distinct training trigrams sorted by ``(v, u, w)``.  ``bv, bw, bc``: training
        pairs of their middle words, sorted, with counts, and every pair of the trigrams among them; ``v_total``:
        counts of the distinct ``bv`` as contexts; ``b_log1``: unigram log10 probabilities of ``bw``.
        ``span`` is above every id.

        Each level is smoothed by the one below, with its mass as pseudo-counts (a Dirichlet prior):
        ``P(w | u v) = (c(uvw) + s3 P(w | v)) / (c(uv) + s3)``; the back-off weight of a context is
        ``s / (c + s)``, so unseen words come out by the same formula."""
        vs, v_at = np.unique(bv, return_index=True)
        rank = np.repeat(np.arange(len(vs)), np.diff(np.r_[v_at, len(bv)]))
        total = np.asarray(v_total, dtype=np.float64)
        p2 = (bc + strength2 * 10.0 ** b_log1) / (total[rank] + strength2)
        new = np.r_[True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])] if len(v) else np.zeros(0, bool)
        c_at = np.flatnonzero(new)
        context = np.cumsum(new) - 1
        c_rank = np.searchsorted(vs, v[c_at])  # of each context's v
        # position of w among the successors of v
        mine = np.searchsorted(vs, v)
        succ = np.searchsorted(rank * np.int64(span) + bw, mine * np.int64(span) + w)
        pos = succ - v_at[mine] if len(v) else succ
        n_succ = np.diff(np.r_[v_at, len(bv)])
        base = np.r_[0, np.cumsum(n_succ[c_rank])].astype(np.int64)
        c_total = np.add.reduceat(count, c_at).astype(np.float64) if len(c_at) else np.zeros(0)
        p3 = (count + strength3 * p2[succ]) / (c_total[context] + strength3) if len(v) else np.zeros(0)
        ef = EliasFano.build
        levels = {
            "v": ef(vs, span),
            "v_first": ef(np.r_[v_at, len(bv)], len(bv) + 1),
            "vw": ef(rank * np.int64(span) + bw, len(vs) * span),
            "vu": ef(c_rank * np.int64(span) + u[c_at], len(vs) * span),
            "vu_first": ef(np.r_[c_at, len(v)], len(v) + 1),
            "uvw_base": ef(base, int(base[-1]) + 1),
            "uvw": ef(base[context] + pos if len(v) else pos, int(base[-1]) + 1),
        }
        tables = {"v_bow": quantise(np.log10(strength2 / (total + strength2))), "vw_p": quantise(np.log10(p2)),
                  "vu_bow": quantise(np.log10(strength3 / (c_total + strength3))), "uvw_p": quantise(np.log10(p3))}
        return cls(levels, tables, span)

    def query(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, log_unigram: np.ndarray) -> np.ndarray:
        """``log10 P(w | u v)`` of each trigram, seen or not."""
        lv, tb = self.levels, self.tables
        out = log_unigram.astype(np.float64).copy()
        rank = lv["v"].find(v)
        k = np.flatnonzero(rank >= 0)
        if not len(k):
            return out
        rank, u, w = rank[k], u[k], w[k]
        at = lv["vw"].find(rank * np.int64(self.span) + w)
        p = np.where(at >= 0, dequantise(tb["vw_p"][np.maximum(at, 0)]) if lv["vw"].n else 0.0,
                     out[k] + dequantise(tb["v_bow"][rank]))
        context = lv["vu"].find(rank * np.int64(self.span) + u)
        seen = np.flatnonzero(context >= 0)
        if len(seen):
            c = context[seen]
            p3 = p[seen] + dequantise(tb["vu_bow"][c])
            both = np.flatnonzero(at[seen] >= 0)
            cb = c[both]
            pos = at[seen[both]] - lv["v_first"].access(rank[seen[both]])
            got = lv["uvw"].find(lv["uvw_base"].access(cb) + pos)
            hit = np.flatnonzero(got >= 0)
            p3[both[hit]] = dequantise(tb["uvw_p"][got[hit]])
            p[seen] = p3
        out[k] = p
        return out

    # ------------------------------------------------------------------ memory-mapped file

    def save(self, path: str) -> None:
        head, arrays, at = {"span": self.span, "levels": {}, "tables": {}}, [], 0

        def add(a: np.ndarray) -> list:
            nonlocal at
            a = np.ascontiguousarray(a)
            entry = [at, len(a), a.dtype.str]
            arrays.append(a)
            at += -(-a.nbytes // 8) * 8
            return entry

        for name in _LEVELS:
            e = self.levels[name]
            head["levels"][name] = [e.n, e.width, [add(a) for a in e.parts()]]
        for name in _TABLES:
            head["tables"][name] = add(self.tables[name])
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)
        with open(path, "wb") as f:
            f.write(len(text).to_bytes(8, "little") + text)
            for a in arrays:
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))

    @classmethod
    def open(cls, path: str) -> Trie:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head, start = json.loads(raw[8:8 + size].tobytes()), 8 + size

        def get(entry) -> np.ndarray:
            at, n, kind = entry
            return raw[start + at:start + at + n * np.dtype(kind).itemsize].view(kind)

        levels = {k: EliasFano(n, width, *map(get, parts)) for k, (n, width, parts) in head["levels"].items()}
        return cls(levels, {k: get(e) for k, e in head["tables"].items()}, head["span"])

    def mapped(self) -> tuple[Trie, str]:
        """This trie through a file in the task's own temporary folder; the caller removes the file."""
        fd, path = tempfile.mkstemp(suffix=".trie")
        os.close(fd)
        self.save(path)
        return Trie.open(path), path
