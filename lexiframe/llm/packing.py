"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n`` (feed-forward
and attention work).  Documents are cut into pieces of at most ``max_tokens``;
the pieces of a block, in descending cost, each go to the sequence of lowest
cost that has room for them.  A block opens just as many sequences as its
tokens need, so the few pieces that fit nowhere whole are cut over the
lowest-cost sequences with room, and a block wastes less than one sequence.

Blocks: each task packs its own partition in blocks of ``block_tokens`` tokens,
so there is no shuffle, no global state and bounded memory whatever the
corpus; padding is below ``max_tokens`` per block.  Sequence ids are
``partition << 33 | number``; a recomputed task makes the same ones from the
same rows.

Tokens: the ids of the public byte-level BPE vocabulary, then id 0.  A text
that holds the string of an added token is encoded by the ``tokenizers``
library itself.  A space with no other white space beside it is always a
pre-token boundary of this vocabulary's pattern: a text that has only such
spaces is cut at them and its units are encoded through a bounded cache (ids
are equal, tests compare both).  A text with a space next to white space of
any kind (U+00A0 included) is encoded whole, as one pre-token can hold the run.

Defined results: a null or empty text is the single id 0; null or repeated ids
are packed like any others; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiframe.llm.common import texts_of

MAX_TOKENS = 1024
BLOCK_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048  # attention costs as much as the rest at twice the window
CACHE_UNITS = 200_000
# A space beside white space; Python's \s holds all that the pattern's \s does.
_SPACE_RUN = re.compile(r" (?:\s|(?<=\s ))")

SCHEMA = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
          "sequence_tokens long, cost double")


class UnitEncoder:
    """Text -> little-endian uint32 ids, as bytes."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str, cache_units: int = CACHE_UNITS):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = Tokenizer.from_file(json_path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.cache_units = cache_units

    def _ids(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _SPACE_RUN.search(text):
            return self._ids(text)
        first, *units = text.split(" ")
        cache = self.cache
        new = [u for u in set(units) if u not in cache] if units else []
        if len(cache) + len(new) > self.cache_units:
            cache.clear()
            new = list(set(units))
        for u in new:
            cache[u] = self._ids(" " + u)
        return (self._ids(first) if first else b"") + b"".join([cache[u] for u in units])


def pack_block(lengths: np.ndarray, max_tokens: int, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Place documents of the given lengths: pieces ``(document, start, length, sequence)`` in the order in
    which they stand in their sequences, and the cost of each sequence."""
    n_seq = int(-(-int(lengths.sum()) // max_tokens))
    room = np.full(n_seq, max_tokens, dtype=np.int64)
    cost = np.zeros(n_seq)
    price = lambda n: linear * n + quadratic * n * n
    pieces: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths.tolist()):
        pieces += [(min(max_tokens, n - s), d, s) for s in range(0, n, max_tokens)]
    # descending cost = descending length; ties by document and start
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    out: list[tuple[int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []

    def place(n: int, d: int, s: int, q: int) -> None:
        out.append((d, s, n, q))
        room[q] -= n
        cost[q] += price(n)

    for n, d, s in pieces:
        q = int(np.where(room >= n, cost, np.inf).argmin())
        if room[q] >= n:
            place(n, d, s, q)
        else:
            rest.append((n, d, s))
    for n, d, s in rest:  # cut over what is left
        while n:
            q = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(n, int(room[q]))
            place(take, d, s, q)
            n, s = n - take, s + take
    out.sort(key=lambda p: p[3])
    return out, cost


def default_paths() -> tuple[str, str, str]:
    """The public vocabulary: tokenizer file, the same vocabulary as ranks, its pre-token pattern."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS,
                   block_tokens: int = BLOCK_TOKENS, end_id: int = 0, linear: float = LINEAR,
                   quadratic: float = QUADRATIC, paths: tuple[str, str, str] | None = None,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: ``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens,
    cost)`` and, ``with_ids``, the ids themselves.  ``cost`` is the sequence's."""
    if not 0 < max_tokens < 1 << 31:
        raise ValueError("max_tokens must be positive")
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = UnitEncoder(*(paths or default_paths()))
        base, done = TaskContext.get().partitionId() << 33, 0
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def flush(key_type):
            nonlocal done, held
            lengths = np.array([len(i) // 4 for i in ids], dtype=np.int64)
            pieces, cost = pack_block(lengths, max_tokens, linear, quadratic)
            used = np.zeros(len(cost), dtype=np.int64)
            cols: list[list] = [[] for _ in range(10)]
            for d, s, n, q in pieces:
                own = ids[d][4 * s:4 * (s + n)]
                for c, v in zip(cols, (keys[d], s, n, zlib.crc32(own), int(lengths[d]), base + done + q,
                                       int(used[q]), q, float(cost[q]), own)):
                    c.append(v)
                used[q] += n
            cols[7] = used[np.array(cols[7], dtype=np.int64)].tolist() if cols[7] else []
            done += len(cost)
            arrays = [pa.array(cols[0], key_type), *[pa.array(c, pa.int64()) for c in cols[1:8]],
                      pa.array(cols[8], pa.float64())]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens",
                     "cost"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in cols[9]],
                                       pa.list_(pa.int32())))
                names.append("ids")
            keys.clear()
            ids.clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            key_type = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), texts_of(b, text)):
                keys.append(k)
                ids.append(enc.encode(t) + tail)
                held += len(ids[-1]) // 4
                if held >= block_tokens:
                    yield flush(key_type)
        if keys:
            yield flush(key_type)

    return rows.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}" + (", ids array<int>" if with_ids else ""))
