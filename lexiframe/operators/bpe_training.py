"""Exact byte-pair training of a large vocabulary in few Spark rounds.

The distinct words live in *blocks* (flat symbol ids, word lengths, frequencies): one row holds thousands of words, so
a round is array work on a few rows, however many words there are.  A round learns many merges at once:

1. Every block counts its pairs, the counts are added up by pair, and the ``k`` pairs that come first by ``(count
   desc, left id, right id)`` are *tracked*, with the next one as the *bound*.
2. Words are cut at every pair that is not tracked.  What stays together are *islands*.  The blocks' islands are added
   up by content; there are at most ``max_islands`` distinct ones, else the step is repeated with fewer tracked
   pairs (one tracked pair alone has an island for each length of a run, at most).
3. The driver trains on the islands, one merge at a time, as long as the best pair comes before the bound.
4. The blocks replace each island by what became of it, and the next round begins.

Why that equals training on all words: a pair that is not tracked comes after the bound and only loses occurrences.  A
pair with a new symbol arises where two neighbours met; if their pair was not tracked, the new one is not more
frequent than that was, and its new id is larger than any id in the bound, so it comes after the bound too.
All other occurrences lie inside islands.  So whatever comes before the bound is counted in full.  A merge whose text is
already a token adds occurrences of an old symbol, which breaks the argument, so it ends its round.

The driver holds the vocabulary and one round's islands.  Pairs and islands are cut to the rows asked for on the
executors (``toArrow`` runs the plan and fetches its one last partition; ``collect`` would fetch the first rows of
every partition), so what a round sends to the driver does not grow with the corpus.  Blocks are written to the checkpoint folder every round;
a lost executor costs its tasks of one round, and a round's blocks go when the next ones are written.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.session import materialize, release

BLOCK_WORDS = 16_384
MAX_ISLANDS, MAX_PAIRS, FIRST_PAIRS = 50_000, 16_384, 256
_TABLE_ROWS = 500_000
_STATE = "ids binary, lens binary, n binary, pair long, island binary, w long"


def _table(counts: dict, kind: str) -> pa.RecordBatch:
    """Rows of one kind: a pair or an island with its weight."""
    rows = len(counts)
    cols = {c: pa.nulls(rows, pa.binary()) for c in ("ids", "lens", "n", "island")} | {"pair": pa.nulls(rows, pa.int64())}
    cols[kind] = pa.array(list(counts), pa.int64() if kind == "pair" else pa.binary())
    cols["w"] = pa.array(list(counts.values()), pa.int64())
    return pa.RecordBatch.from_pydict({c: cols[c] for c in ("ids", "lens", "n", "pair", "island", "w")})


def _block_row(ids: np.ndarray, lens: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    one = {c: pa.array([v.tobytes()], pa.binary()) for c, v in (("ids", ids), ("lens", lens), ("n", n))}
    return pa.RecordBatch.from_pydict(one | {"pair": pa.nulls(1, pa.int64()), "island": pa.nulls(1, pa.binary()),
                                             "w": pa.nulls(1, pa.int64())})


def _pairs(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a pair begins, the pairs there (left id in the high half), and each symbol's word."""
    word = np.repeat(np.arange(len(lens)), lens)
    at = np.flatnonzero(word[1:] == word[:-1])
    return at, (ids[at].astype(np.int64) << 32) | ids[at + 1], word


def _add_pairs(total: dict[int, int], ids: np.ndarray, lens: np.ndarray, n: np.ndarray) -> None:
    at, code, word = _pairs(ids, lens)
    if len(code):
        found, which = np.unique(code, return_inverse=True)
        # frequencies can exceed what a double holds exactly: sums stay integers
        order = np.argsort(which, kind="stable")
        sums = np.add.reduceat(n[word[at]][order], np.searchsorted(which[order], np.arange(len(found))))
        for p, w in zip(found.tolist(), sums.tolist()):
            total[p] = total.get(p, 0) + w


def _islands(ids: np.ndarray, lens: np.ndarray, tracked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last symbol of every run of tracked pairs, and each symbol's word."""
    at, code, word = _pairs(ids, lens)
    pos = np.minimum(np.searchsorted(tracked, code), len(tracked) - 1)
    at = at[tracked[pos] == code]
    if not len(at):
        return at, at, word
    new = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    return at[new], at[np.r_[new[1:] - 1, len(at) - 1]] + 1, word


def _replace(ids: np.ndarray, lens: np.ndarray, n: np.ndarray, tracked: np.ndarray, became: dict[bytes, bytes]):
    """The block with each island that changed replaced; words of one symbol leave."""
    first, last, word = _islands(ids, lens, tracked)
    raw, out, at = ids.tobytes(), [], 0
    lens = lens.copy()
    for s, e in zip(first.tolist(), last.tolist()):
        new = became.get(raw[4 * s:4 * e + 4])
        if new is not None:
            out.append(raw[at:4 * s])
            out.append(new)
            at = 4 * e + 4
            lens[word[s]] -= e + 1 - s - len(new) // 4
    out.append(raw[at:])
    ids = np.frombuffer(b"".join(out), dtype=np.int32)
    stay = lens > 1
    return ids[np.repeat(stay, lens)], lens[stay], n[stay]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for ids, lens, n in zip(*[b.column(i).to_pylist() for i in range(3)]):
            yield (np.frombuffer(ids, dtype=np.int32), np.frombuffer(lens, dtype=np.int64), np.frombuffer(n, dtype=np.int64))


def first_blocks(word_table: DataFrame, char_ids: dict[str, int]) -> DataFrame:
    """Blocks of the words ``(word, n)`` as character ids, with their pair counts as rows beside them."""
    chars = sorted(char_ids)  # by code point
    codes = np.array([ord(c) for c in chars], dtype=np.uint32)
    numbers = np.array([char_ids[c] for c in chars], dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            words, counts = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), dtype=np.int64)
            for s in range(0, len(words), BLOCK_WORDS):
                own = words[s:s + BLOCK_WORDS]
                lens = np.array([len(w) for w in own], dtype=np.int64)
                flat = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype="<u4")
                ids = numbers[np.searchsorted(codes, flat)]
                stay = lens > 1
                block = ids[np.repeat(stay, lens)], lens[stay], counts[s:s + BLOCK_WORDS][stay]
                if len(block[1]):
                    _add_pairs(total, *block)
                    yield _block_row(*block)
                if len(total) >= _TABLE_ROWS:
                    yield _table(total, "pair")
                    total.clear()
        yield _table(total, "pair")

    return word_table.select("word", F.col("n").cast("long").alias("n")).mapInArrow(run, _STATE)


def next_blocks(blocks: DataFrame, tracked: np.ndarray, became: dict[bytes, bytes]) -> DataFrame:
    """Blocks after a round, with their pair counts as rows beside them."""
    shared = blocks.sparkSession.sparkContext.broadcast((tracked, became))  # bounded by max_islands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracked, became = shared.value
        total: dict[int, int] = {}
        for block in _blocks(batches):
            block = _replace(*block, tracked, became)
            if len(block[1]):
                _add_pairs(total, *block)
                yield _block_row(*block)
            if len(total) >= _TABLE_ROWS:
                yield _table(total, "pair")
                total.clear()
        yield _table(total, "pair")

    return blocks.mapInArrow(run, _STATE)


def count_islands(blocks: DataFrame, tracked: np.ndarray) -> DataFrame:
    """``(island, w)``: distinct runs of tracked pairs, as bytes of their ids, with the frequency of their words."""
    shared = blocks.sparkSession.sparkContext.broadcast(tracked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracked = shared.value
        total: dict[bytes, int] = {}
        for ids, lens, n in _blocks(batches):
            first, last, word = _islands(ids, lens, tracked)
            raw = ids.tobytes()
            for s, e, w in zip((4 * first).tolist(), (4 * last + 4).tolist(), n[word[first]].tolist()):
                key = raw[s:e]
                total[key] = total.get(key, 0) + w
            if len(total) >= _TABLE_ROWS:
                yield _table(total, "island")
                total.clear()
        yield _table(total, "island")

    return (blocks.mapInArrow(run, _STATE).select("island", "w").groupBy("island").agg(F.sum("w").alias("w")))


def merge_islands(islands: dict[bytes, int], bound: tuple[int, int, int] | None, tokens: list[str], ids_of: dict[str, int],
                  limit: int) -> tuple[list[tuple[int, int, int]], dict[bytes, bytes]]:
    """One round on the driver: the merges in order (``tokens`` and ``ids_of`` grow), and what islands became.
    ``bound`` is ``(-count, left, right)`` of the first pair that is not tracked."""
    names = list(islands)
    weight = [islands[x] for x in names]
    seqs = [np.frombuffer(x, dtype=np.int32).tolist() for x in names]
    counts: dict[tuple[int, int], int] = {}
    where: dict[tuple[int, int], set[int]] = {}
    for k, s in enumerate(seqs):
        for p in zip(s, s[1:]):
            counts[p] = counts.get(p, 0) + weight[k]
            where.setdefault(p, set()).add(k)
    heap = [(-c, *p) for p, c in counts.items()]
    heapq.heapify(heap)
    merges, changed, again = [], set(), False
    while heap and len(tokens) < limit and not again:
        c, lft, rgt = top = heapq.heappop(heap)
        if counts.get((lft, rgt)) != -c or not c:
            continue
        if bound is not None and top >= bound:
            break
        text = tokens[lft] + tokens[rgt]
        again = text in ids_of
        new = ids_of.setdefault(text, len(tokens))
        if not again:
            tokens.append(text)
        merges.append((lft, rgt, new))
        touched: set[tuple[int, int]] = set()
        for k in where.pop((lft, rgt)):
            s, out, i = seqs[k], [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == lft and s[i + 1] == rgt:
                    out.append(new)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            if len(out) == len(s):
                continue  # the pair left this island in an earlier merge
            w = weight[k]
            for p in zip(s, s[1:]):
                counts[p] -= w
                touched.add(p)
            for p in zip(out, out[1:]):
                counts[p] = counts.get(p, 0) + w
                where.setdefault(p, set()).add(k)
                touched.add(p)
            seqs[k] = out
            changed.add(k)
        for p in touched:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], *p))
    return merges, {names[k]: np.array(seqs[k], dtype=np.int32).tobytes() for k in changed}


def learn_merges(word_table: DataFrame, tokens: list[str], ids_of: dict[str, int], limit: int,
                 max_islands: int = MAX_ISLANDS, max_pairs: int = MAX_PAIRS, first_pairs: int = FIRST_PAIRS
                 ) -> tuple[list[tuple[int, int, int]], int]:
    """Merges ``(left id, right id, new id)`` of the words ``(word, n)`` until there are ``limit`` tokens, and the number
    of rounds.  ``tokens`` and ``ids_of`` hold specials and alphabet, and grow."""
    char_ids = {t: i for t, i in ids_of.items() if len(t) == 1}
    state = materialize(first_blocks(word_table, char_ids), "bpe-blocks")
    merges: list[tuple[int, int, int]] = []
    rounds, k = 0, first_pairs
    while len(tokens) < limit:
        blocks = state.where(F.col("ids").isNotNull())
        left, right = F.shiftright("pair", 32).alias("l"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("r")
        top = (state.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("w").alias("w"))
               .select("w", left, right).orderBy(F.desc("w"), "l", "r").limit(max_pairs + 1).toArrow().to_pylist())
        if not top:
            break
        while True:
            k = min(k, max_pairs)
            tracked = np.sort(np.array([(r["l"] << 32) | r["r"] for r in top[:k]], dtype=np.int64))
            rows = count_islands(blocks, tracked).limit(max_islands + 1).toArrow()
            if len(rows) <= max_islands or k == 1:
                break
            k = max(k // 4, 1)
        bound = (-top[k]["w"], top[k]["l"], top[k]["r"]) if len(top) > k else None
        islands = dict(sorted(zip(rows["island"].to_pylist(), rows["w"].to_pylist())))
        found, became = merge_islands(islands, bound, tokens, ids_of, limit)
        merges += found
        rounds += 1
        if not found:
            if bound is None:
                break
            raise AssertionError("a round without a merge")  # the first tracked pair always comes before the bound
        if len(tokens) < limit:
            old, state = state, materialize(next_blocks(blocks, tracked, became), "bpe-blocks")
            release(old)
        if len(rows) * 4 <= max_islands:
            k *= 2
    release(state)
    return merges, rounds


def merges_of_texts(spark: SparkSession, words: dict[str, int], tokens: list[str], limit: int) -> list[tuple[int, int, int]]:
    """Merges of a small word table given as a dictionary (tests)."""
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    return learn_merges(table, tokens, {t: i for i, t in enumerate(tokens)}, limit)[0]
