"""Spelling variants: near words by composing the vocabulary's acceptor with a one-edit transducer and itself.

Words are counted by Spark.  The pairs of words that differ by one inserted, deleted or replaced code point are the
pairs that ``A . T . A`` accepts, where ``A`` is the minimised acyclic acceptor of the vocabulary and ``T`` the
transducer that copies symbols and makes one edit on the way.  The composition is cut by its initial states, so that no
task holds the whole vocabulary:

* A pair whose shorter word has ``a`` symbols first differs at some position ``p`` (the length of the common
  prefix).  A *window* ``[lo, hi)`` stands for the pairs with ``lo <= p < hi``: both words have the first ``lo``
  symbols in common and the last ``a - hi``.  Windows ``[a/2, a + 1)`` start the composition in the state that
  the common first half leads to; windows ``[0, a/2)`` do the same from the other end.  Each word is in two windows for
  each ``a`` (its own length and one less): four rows, dealt by the window and the shared symbols.
* A window of more than ``group_words`` words is cut in halves, again and again down to one position, where the words
  share all but one or two symbols and no two groups can be cut further.
* Within a group the words' middles become a minimal acceptor (built from sorted words).  While ``T`` copies, both
  sides are in the same state, so the edit is tried once for each state of the minimal acceptor, not for each prefix:
  a substitution takes two arcs of one state, a deletion one arc against none, and then both sides go in step.
  Words are numbered by the acceptor (each arc knows how many words come before it), so pairs are numbers.

Every pair comes up in one window only.  Tasks emit, for each word, how many near words a group gave and the best of
them; Spark adds these up.  Forms are followed to their roots by pointer doubling; a form has at least ``ratio`` times
the word's count, so the chain's length is bounded by the largest count.

Defined results: a null text has no words and a null id counts as the empty string; equal rows count as often as they
come; words of equal count tie by code-point order; texts and words of any length are handled whole; an empty table
or one without frequent words has an empty result; extra columns are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.rows import explode_rows
from lexiframe.llm.common import materialize

LETTERS = "[A-Za-z\u00C0-\u00FF]"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
SLIP = 199  # one run in so many loses a code point
GROUP_WORDS = 20_000
_KEYS = ("a", "lo", "hi", "prefix", "suffix")
_ROWS_OUT, _TABLE_WORDS = 20_000, 200_000
_LONG_TEXT = 1 << 22
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# ------------------------------------------------------------------ acceptor

class Acceptor:
    """Minimal acyclic acceptor of ascending distinct words.  States are numbered so that arcs lead to smaller ones;
    ``arcs[s]`` maps a symbol to ``(target, words of s before that arc)``."""

    def __init__(self, words: Iterable[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]  # the states of the last word, not yet merged with equal ones
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                number = self._state(known, *path.pop())
                path[-1][1][last[len(path) - 1]] = number

        for w in words:
            k, most = 0, min(len(w), len(last))
            while k < most and w[k] == last[k]:
                k += 1
            close(k)
            path.extend([False, {}] for _ in range(len(w) - k))
            path[-1][0] = True
            last = w
        close(0)
        self.start = self._state(known, *path.pop())

    def _state(self, known: dict[tuple, int], final: bool, arcs: dict[str, int]) -> int:
        same = (final, *arcs.items())
        number = known.get(same)
        if number is None:
            number = known[same] = len(self.final)
            at, numbered = int(final), {}
            for c, t in arcs.items():
                numbered[c] = (t, at)
                at += self.count[t]
            self.final.append(final)
            self.arcs.append(numbered)
            self.count.append(at)
        return number

    def common(self, pairs: list[tuple[int, int, int, int]], out: list[tuple[int, int]]) -> None:
        """Both sides go in step from ``(state, state, number, number)``: the numbers of what both accept."""
        final, arcs, count = self.final, self.arcs, self.count
        while pairs:
            s, t, i, j = pairs.pop()
            if s == t:
                out.extend((i + k, j + k) for k in range(count[s]))
                continue
            if final[s] and final[t]:
                out.append((i, j))
            other = arcs[t]
            for c, (u, at) in arcs[s].items():
                if c in other:
                    v, bt = other[c]
                    pairs.append((u, v, i + at, j + bt))

    def one_edit(self, at_end: bool = True) -> Iterator[tuple[int, int]]:
        """Numbers of the accepted pairs, each once.  A deletion takes the longer word's arc while the shorter stays,
        and the shorter must not go on with the same symbol (else the edit is found later).  ``at_end``: with edits
        after the shorter word's last symbol."""
        prefixes: list[list[int]] = [[] for _ in self.final]
        prefixes[self.start].append(0)
        for s in range(len(self.final) - 1, -1, -1):
            own, before = self.arcs[s], prefixes[s]
            if not before:
                continue
            local: list[tuple[int, int]] = []
            arcs = list(own.items())
            for n, (c, (t, i)) in enumerate(arcs):
                for _, (u, j) in arcs[n + 1:]:  # c becomes another symbol
                    if t == u or self.final[t] and self.final[u] or not self.arcs[t].keys().isdisjoint(self.arcs[u]):
                        self.common([(t, u, i, j)], local)
                if at_end and self.final[s] and self.final[t]:  # c goes
                    local.append((i, 0))
                after = self.arcs[t]
                self.common([(after[d][0], u, i + after[d][1], j) for d, (u, j) in arcs if d != c and d in after], local)
                prefixes[t].extend([b + i for b in before] if i else before)
            for b in before:
                for i, j in local:
                    yield i + b, j + b
            prefixes[s] = []


def near_in_group(middles: list[str], longer: int, at_end: bool) -> Iterator[tuple[int, int]]:
    """Index pairs of ascending ``middles`` that differ by one edit; pairs of two of length ``longer`` belong to another
    window."""
    for i, j in Acceptor(middles).one_edit(at_end):
        if len(middles[i]) < longer or len(middles[j]) < longer:
            yield i, j


# --------------------------------------------------------------------- words

def runs_of(text: str, min_chars: int = 1) -> Counter[str]:
    """How often each run of at least ``min_chars`` letters occurs, A-Z lower-cased (on bytes, where that is one
    table look-up); very long texts are read run by run."""
    find = re.compile(f"{LETTERS}{{{max(min_chars, 1)},}}")
    text = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    if len(text) < _LONG_TEXT:
        return Counter(find.findall(text))
    return Counter(m.group() for m in find.finditer(text))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, slip: int | None = SLIP) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters; with ``slip``, a run whose ``crc32('<id>:<run>')`` it divides loses
    the code point at that number modulo the run's length.  Tasks add words up in a bounded table before the
    shuffle, so a hot word is a few rows a task."""
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"),
                                                      F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                             names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = zlib.crc32(f"{k}:".encode())
                for r, n in runs_of(t, min_chars).items():
                    if slip:
                        h = zlib.crc32(r.encode(), start)
                        if h % slip == 0:
                            at = h % len(r)
                            r = r[:at] + r[at + 1:]
                            if len(r) < min_chars:
                                continue
                    total[r] = total.get(r, 0) + n
                if len(total) >= _TABLE_WORDS:
                    yield flush()
        yield flush()

    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def _with_window(rows: DataFrame, windows: Column, *keep: str) -> DataFrame:
    """A row for each window, with the symbols that its words share."""
    w = explode_rows(rows, windows, "_w", *keep)
    tail = F.greatest(F.col("_w.a") - F.col("_w.hi"), F.lit(0))
    size = F.char_length("word")
    return w.select(*keep, "_w.a", "_w.lo", "_w.hi", F.substring("word", F.lit(1), F.col("_w.lo")).alias("prefix"),
                    F.substring("word", size - tail + 1, tail).alias("suffix"))


def _window(a: Column, lo: Column, hi: Column) -> Column:
    return F.struct(a.alias("a"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def windows_of(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``(word, n, a, lo, hi, prefix, suffix)``; windows of more than ``group_words`` words are halved until none is or
    it has one position."""
    size, zero = F.char_length("word"), F.lit(0)

    def halves(a: Column) -> Column:
        m = F.floor(a / 2)
        return F.array(_window(a, zero, m), _window(a, m, a + 1))

    # windows of words as the longer one are kept for all, also where no word is as short
    rows = _with_window(words, F.concat(halves(size), F.when(size > 1, halves(size - 1)).otherwise(F.array().cast(
        "array<struct<a:int,lo:int,hi:int>>"))), "word", "n")
    while True:
        large = (rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_n"))
                 .where((F.col("_n") > group_words) & (F.col("hi") - F.col("lo") > 1)).select(*_KEYS))
        if large.isEmpty():
            return rows
        marked = rows.join(large.withColumn("_cut", F.lit(True)), list(_KEYS), "left")
        a, lo, hi = F.col("a"), F.col("lo"), F.col("hi")
        mid = F.floor((lo + hi) / 2)
        parts = F.when(F.col("_cut"), F.array(_window(a, lo, mid), _window(a, mid, hi))).otherwise(F.array(_window(a, lo, hi)))
        rows = materialize(_with_window(marked, parts, "word", "n"), "spelling-windows")


def near_counts(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``(word, n_near, best_n, best)`` for words ``(word, n)`` with near words: how many, and the one of the largest
    count (ties: the first in code-point order)."""
    rows = windows_of(words, group_words).repartition(*_KEYS).sortWithinPartitions(*_KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, str]] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [(), (), (), ()]
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["word", "cnt", "best_n", "best"])

        def solve(window: tuple, group: list[tuple[str, int]]) -> None:
            a, lo, hi = window[:3]
            tail = max(a - hi, 0)
            group = sorted((w[lo:len(w) - tail], w, n) for w, n in group)
            seen = [0] * len(group)
            best: list[tuple[int, str] | None] = [None] * len(group)
            for i, j in near_in_group([g[0] for g in group], a + 1 - lo - tail, hi > a):
                for x, y in ((i, j), (j, i)):
                    seen[x] += 1
                    b = (-group[y][2], group[y][1])
                    if best[x] is None or b < best[x]:
                        best[x] = b
            out.extend((g[1], k, -b[0], b[1]) for g, k, b in zip(group, seen, best) if k)

        window, group = None, []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(7)]
            for word, n, *own in zip(*cols):
                if own != window:
                    if len(group) > 1:
                        solve(window, group)
                        if len(out) >= _ROWS_OUT:
                            yield flush()
                    window, group = own, []
                group.append((word, n))
        if len(group) > 1:
            solve(window, group)
        yield flush()

    found = rows.mapInArrow(run, "word string, cnt long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))  # strings are ordered by code point
    return (found.groupBy("word").agg(F.sum("cnt").alias("n_near"), best.alias("_b"))
            .select("word", "n_near", (-F.col("_b.m")).alias("best_n"), F.col("_b.best").alias("best")))


def spelling_variants(words: DataFrame, ratio: int = RATIO, group_words: int = GROUP_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for a table ``(word, n)`` of distinct words."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    near = near_counts(words, group_words).withColumnRenamed("word", "_word")
    is_form = F.col("best_n") >= ratio * F.col("n")
    forms = materialize(words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # a chain of k links needs a count of ratio ** k: doubling ends after log2(k) rounds
    most = forms.agg(F.max("n")).first()[0] or 1
    links = math.log(most, max(ratio, 2)) + 1
    for _ in range(math.ceil(math.log2(max(links, 1))) + 1 if ratio > 1 else 0):
        ahead = roots.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        roots = materialize(roots.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_on", "root").alias("root")), "spelling-roots")
    roots = roots.withColumnRenamed("word", "_word")
    return forms.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
