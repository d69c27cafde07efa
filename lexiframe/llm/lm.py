"""N-gram language-model scoring: trigram statistics of the training part score every document.

Tokens are words (A-Z lower-cased) and one end token per text.  The model is a trigram with Dirichlet smoothing
(see ``trie.py``); unigrams are add-one smoothed with one place for unknown words.

How the work is spread:

1. ``parts``: each task numbers the words of about ``part_chars`` bytes of text by their 64-bit hashes and writes the
   texts as word numbers, and its word table split by hash range.
2. ``words``: a task per hash range sums the training counts of its words, gives every word a global id, and
   answers each part with ids and counts.  Parts are pre-aggregated, so a hot word is one entry a part.
3. ``grams``: a part meets its answers, turns its texts into trigrams, and sends them on by middle word, packed
   per part and shard.  A middle word with more than ``shard_tokens`` occurrences is spread over several shards
   by its left neighbour; the successor counts of such words are summed on their own and sent to all of them.
4. ``score``: a shard counts its trigrams, builds its trie, maps it, looks up each distinct trigram once, and
   returns sums per document, which are added up.

Nothing passes through the driver but totals and the list of hot words (at most ``MAX_HOT``).  Words are told
apart by 64-bit hashes; the chance that any two of a billion words clash is 3 %, and such a clash would merge
two words' counts.

Defined results: a null or empty text is the end token alone; repeated rows are scored each; with no training
text every token has probability ``1 / (0 + 0 + 1)``, so scores are 0; texts of any length are read whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import pack_array, scratch_path, unpack_array
from lexiframe.llm.trie import Trie

PART_CHARS = 14 << 20
SHARD_TOKENS = 1_000_000
STRENGTH2, STRENGTH3 = 20.0, 10.0
MAX_HOT = 100_000
END = b"\n"  # not a word of any text
_BEGIN = 0  # global id; words start at 1

#: Rows of the written tables: packed columns of one part (and hash range).
_PART = "part long, kind int, shard int, n long, a binary, b binary, c binary"


def _batch(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, schema)], names=[x for x, _ in schema])


_PART_TYPES = [("part", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("a", pa.binary()),
               ("b", pa.binary()), ("c", pa.binary())]


def _planes(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return pack_array(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)


def _unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(unpack_array(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _deltas(a: np.ndarray) -> bytes:
    return _planes(np.diff(a, prepend=a.dtype.type(0)))


# ------------------------------------------------------------------ 1. parts

def write_parts(docs: DataFrame, train: Column, path: str, n_ranges: int, key: str, text: str,
                part_chars: int) -> None:
    """Kind 0: a part's texts (``a``: word numbers, ``b``: tokens per text, ``c``: training flags, with their
    ``keys``; ``shard``: training texts, ``n``: tokens).  Kind 1: its words in one hash range (``a``: hashes, ``b``: training counts)."""
    rows = docs.select(key, text, F.coalesce(train, F.lit(False)).alias("_train"))
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        base, n_part = TaskContext.get().partitionId() << 24, 0
        # words as UTF-8 bytes: ``lower`` changes A-Z only, and ``split`` cuts at space and \t to \r only
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids, lens, flags, keys, size = [], [], [], [], 0

        def flush(key_type) -> pa.RecordBatch:
            nonlocal n_part, size
            h = np.array([xxhash.xxh64_intdigest(x) for x in number], dtype=np.uint64)
            uniq, new_number = np.unique(h, return_inverse=True)
            flat = new_number[np.concatenate(ids)].astype(np.uint32)
            n = np.array(lens, dtype=np.uint32)
            t = np.array(flags, dtype=np.uint8)
            counts = np.bincount(flat[np.repeat(t, n) > 0], minlength=len(uniq)).astype(np.uint32)
            part = base + n_part
            out = [(part, 0, int(t.sum()), len(flat), _planes(flat), _planes(n), pack_array(t), list(keys))]
            owner = hash_range(uniq, n_ranges)
            cut = np.searchsorted(owner, np.arange(n_ranges + 1))
            for r in range(n_ranges):
                s = slice(cut[r], cut[r + 1])
                if cut[r] < cut[r + 1]:
                    out.append((part, 1, r, None, _deltas(uniq[s]), _planes(counts[s]), None, None))
            number.clear()
            for x in (ids, lens, flags, keys):
                x.clear()
            n_part, size = n_part + 1, 0
            return _batch(out, [*_PART_TYPES, ("keys", pa.list_(key_type))])

        for b in batches:
            key_type = b.schema.field(0).type
            for k, t, f in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                ws = t.lower().split() if t else []
                ws.append(END)
                ids.append(np.fromiter(map(number.__getitem__, ws), dtype=np.int32, count=len(ws)))
                lens.append(len(ws))
                flags.append(f)
                keys.append(k)
                size += len(t or b"") + 1
                if size >= part_chars:
                    yield flush(key_type)
        if keys:
            yield flush(key_type)

    schema = f"{_PART}, keys array<{kind.simpleString()}>"
    rows.mapInArrow(run, schema).write.partitionBy("kind").parquet(path)


def hash_range(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """Range of each 64-bit hash among equal ones (monotone)."""
    return ((h >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """Consecutive rows with the same ``by``."""
    held: list[dict] = []
    for b in batches:
        cols = list(zip(b.schema.names, b.columns))
        for i in range(b.num_rows):  # one row at a time: rows are large
            r = {n: c[i].as_py() for n, c in cols}
            if held and r[by] != held[0][by]:
                yield held[0][by], held
                held = []
            held.append(r)
    if held:
        yield held[0][by], held


# ------------------------------------------------------------------ 2. words

def write_words(parts: DataFrame, path: str, n_ranges: int, hot_tokens: int) -> None:
    """Kind 1: the answer to a part's words of one range (``a``: global ids, ``b``: counts, in hash order).
    Kind 2: per range, ``shard``: words seen in training, ``n``: their tokens, ``a``: largest id, ``b``/``c``: ids
    and counts of words above ``hot_tokens``."""
    rows = parts.where("kind = 1").select("part", "shard", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, group in _grouped(batches, "shard"):
            hs = [np.cumsum(_unplanes(g["a"], np.uint64), dtype=np.uint64) for g in group]
            cs = [_unplanes(g["b"], np.uint32) for g in group]
            uniq, place = np.unique(np.concatenate(hs), return_inverse=True)
            count = np.bincount(place, weights=np.concatenate(cs), minlength=len(uniq)).astype(np.int64)
            # frequent words get small ids, which pack well
            rank = np.empty(len(uniq), dtype=np.int64)
            rank[np.lexsort((uniq, -count))] = np.arange(len(uniq))
            ids = 1 + rank * n_ranges + r
            hot = np.flatnonzero(count > hot_tokens)
            out, at = [], 0
            for g, h in zip(group, hs):
                own = place[at:at + len(h)]
                at += len(h)
                out.append((g["part"], 1, r, None, _planes(ids[own]), _planes(count[own]), None))
            out.append((-1, 2, int((count > 0).sum()), int(count.sum()), ids.max().tobytes(), ids[hot].tobytes(),
                        count[hot].tobytes()))
            yield _batch(out, _PART_TYPES)

    (rows.repartition("shard").sortWithinPartitions("shard", "part").mapInArrow(run, _PART)
     .write.partitionBy("kind").parquet(path))


# ------------------------------------------------------------------ 3. grams

def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = a.astype(np.uint64)
        z += np.uint64(salt)
        z *= np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        return z


def _parts_with_words(batches: Iterator[pa.RecordBatch]):
    """Per part: keys, flags, tokens per text, and global id and count of each token."""
    for part, group in _grouped(batches, "part"):
        group.sort(key=lambda g: (g["kind"], g["shard"]))
        head, answers = group[0], group[1:]
        ids = np.concatenate([_unplanes(g["a"], np.int64) for g in answers])
        counts = np.concatenate([_unplanes(g["b"], np.int64) for g in answers])
        flat = _unplanes(head["a"], np.uint32)
        yield (part, head["keys"], unpack_array(head["c"], np.uint8) > 0, _unplanes(head["b"], np.uint32).astype(np.int64),
               ids[flat], counts[flat])


def _contexts(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each token; before a text stands the begin mark."""
    v, u = np.r_[_BEGIN, w[:-1]], np.r_[_BEGIN, _BEGIN, w[:-2]][:len(w)]
    first = np.cumsum(n) - n
    v[first] = _BEGIN
    u[first] = _BEGIN
    second = first[n > 1] + 1
    u[second] = _BEGIN
    return v, u


def _shard_of(v: np.ndarray, u: np.ndarray, n_shards: int, hot_ids: np.ndarray, hot_salts: np.ndarray) -> np.ndarray:
    salt = np.zeros(len(v), dtype=np.uint64)
    if len(hot_ids):
        at = np.minimum(np.searchsorted(hot_ids, v), len(hot_ids) - 1)
        hot = np.flatnonzero(hot_ids[at] == v)
        salt[hot] = _mix(u[hot], 1) % hot_salts[at[hot]].astype(np.uint64)
    return salted_shard(v, salt, n_shards)


def salted_shard(v: np.ndarray, salt: np.ndarray, n_shards: int) -> np.ndarray:
    return (_mix(v.astype(np.uint64) + (salt.astype(np.uint64) << np.uint64(40)), 2) % np.uint64(n_shards)).astype(np.int64)


def _gram_blobs(batches: Iterator[pa.RecordBatch], n_shards: int, hot_ids, hot_salts) -> Iterator[pa.RecordBatch]:
    """Per part and shard, sorted by middle word: ``a``: words after (dictionary, counts), ``b``: dictionary
    numbers and middle words, ``c``: words before, and twice the text's number plus its training flag."""
    for part, _, flags, n, w, c in _parts_with_words(batches):
        v, u = _contexts(w, n)
        # few bits: sorted by radix, and small beside the other columns
        shard = _shard_of(v, u, n_shards, hot_ids, hot_salts).astype(np.uint16 if n_shards <= 1 << 16 else np.int64)
        order = np.argsort(v, kind="stable")
        order = order[np.argsort(shard[order], kind="stable")]
        cut = np.r_[0, np.cumsum(np.bincount(shard, minlength=n_shards))]
        del shard
        text = np.repeat((np.arange(len(n)) * 2 + flags).astype(np.uint32), n)
        rows = []
        for s in np.flatnonzero(np.diff(cut)):
            at = order[cut[s]:cut[s + 1]]
            ws, first, wi = np.unique(w[at], return_index=True, return_inverse=True)
            rows.append((int(s), 4, part, _join(_deltas(ws), _planes(c[at][first])),
                         _join(_planes(wi.astype(np.uint32)), _deltas(v[at])),
                         _join(_planes(u[at]), _planes(text[at]))))
            if len(rows) == 16:
                yield _batch(rows, _BLOB_TYPES)
                rows = []
        yield _batch(rows, _BLOB_TYPES)


_BLOB = "shard int, kind int, part long, a binary, b binary, c binary"
_BLOB_TYPES = [("shard", pa.int32()), ("kind", pa.int32()), ("part", pa.int64()), ("a", pa.binary()),
               ("b", pa.binary()), ("c", pa.binary())]


def _join(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _split(x: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(x[:8], "little")
    return x[8:8 + n], x[8 + n:]


def _hot_pairs(batches: Iterator[pa.RecordBatch], hot_ids) -> Iterator[pa.RecordBatch]:
    """Training pairs of hot middle words, counted per part: ``(v, w, n, c)`` with ``c`` the count of ``w``."""
    for _, _, flags, n, w, c in _parts_with_words(batches):
        v, _ = _contexts(w, n)
        at = np.minimum(np.searchsorted(hot_ids, v), len(hot_ids) - 1)
        mine = np.flatnonzero(np.repeat(flags, n) & (hot_ids[at] == v))
        order = mine[np.lexsort((w[mine], v[mine]))]
        first = np.flatnonzero(np.r_[True, (np.diff(v[order]) != 0) | (np.diff(w[order]) != 0)]) if len(order) else order
        number = np.diff(np.r_[first, len(order)])
        yield pa.RecordBatch.from_arrays([pa.array(x[order[first]]) for x in (v, w)] + [pa.array(number.astype(np.int64)),
                                         pa.array(c[order[first]])], names=["v", "w", "n", "c"])


def _spread_pairs(batches: Iterator[pa.RecordBatch], n_shards: int, hot_ids, hot_salts) -> Iterator[pa.RecordBatch]:
    """Summed pairs of hot words, once for each shard that holds a part of the word."""
    for b in batches:
        v, w, k, c = (b.column(i).to_numpy() for i in range(4))
        at = np.searchsorted(hot_ids, v)
        for salt in range(int(hot_salts[at].max()) if len(at) else 0):
            mine = np.flatnonzero(hot_salts[at] > salt)
            shard = salted_shard(v[mine], np.full(len(mine), salt), n_shards)
            # the salt stands in place of a part, to tell two salts that meet in one shard apart
            out = [(int(s), 5, salt, pack_array(np.stack([x[mine[shard == s]] for x in (v, w, k, c)])), None, None)
                   for s in np.unique(shard)]
            yield _batch(out, _BLOB_TYPES)


# ------------------------------------------------------------------ 4. score

def _score_shard(group: list[dict], log_total: float, strength2: float, strength3: float, span: int) -> pa.RecordBatch:
    """Build a shard's trie, look its distinct trigrams up through the mapped file, and sum per part and text."""
    blobs = [g for g in group if g["kind"] == 4]
    v_, u_, w_, t_, dw, dc = [], [], [], [], [], []
    for g in blobs:
        (a1, a2), (b1, b2), (c1, c2) = _split(g["a"]), _split(g["b"]), _split(g["c"])
        ws = np.cumsum(_unplanes(a1, np.int64))
        dw.append(ws)
        dc.append(_unplanes(a2, np.int64))
        w_.append(ws[_unplanes(b1, np.uint32)])
        v_.append(np.cumsum(_unplanes(b2, np.int64)))
        u_.append(_unplanes(c1, np.int64))
        t_.append(_unplanes(c2, np.uint32).astype(np.int64))
        g["a"] = g["b"] = g["c"] = None
    if not blobs:
        return _batch([], _SUM_TYPES)
    v, u, w, text = map(np.concatenate, (v_, u_, w_, t_))
    del v_, u_, w_
    words, first = np.unique(np.concatenate(dw), return_index=True)
    log1 = np.log10(np.concatenate(dc)[first] + 1.0) - log_total
    del dw, dc

    # distinct trigrams, in the order (v, u, w)
    vs, vi = np.unique(v, return_inverse=True)
    pair, pi = np.unique(vi * span + u, return_inverse=True)
    del v, u, vi
    tri, ti = np.unique(pi * span + w, return_inverse=True)
    del pi, w
    tw, tp = tri % span, tri // span
    tu, tv = pair[tp] % span, vs[pair[tp] // span]
    count = np.bincount(ti[(text & 1) > 0], minlength=len(tri))
    at = np.flatnonzero(count)
    # pairs (v, w): counted here, but for hot words, whose full counts came along
    big, bi = np.unique(np.searchsorted(vs, tv[at]) * span + tw[at], return_inverse=True)
    bv, bw, bc = vs[big // span], big % span, np.bincount(bi, weights=count[at], minlength=len(big)).astype(np.int64)
    # A hot word's pairs come along with their full counts.  Only the pairs of this shard's trigrams are looked up
    # here, so the rest only add to the word's total.
    asked = np.unique(np.searchsorted(vs, tv) * span + tw)
    full, total = [(bv, bw, bc)], {}
    for g in group:
        if g["kind"] == 5:
            hv, hw, hn, _ = unpack_array(g["a"], np.int64).reshape(4, -1)
            g["a"] = None
            here = np.flatnonzero(np.isin(hv, vs))
            key = np.searchsorted(vs, hv[here]) * span + hw[here]
            pos = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
            wanted = asked[pos] == key
            wanted[np.unique(hv[here], return_index=True)[1]] = True  # one pair at least, so that the word is a context
            here_too = here[wanted]
            for x in np.unique(hv):
                # rows of one word may come in several pieces, and twice if two of its salts meet in a shard
                total.setdefault((int(x), g["part"]), 0)
                total[int(x), g["part"]] += int(hn[hv == x].sum())
            full.append((hv[here_too], hw[here_too], hn[here_too], g["part"]))
    hot_v = np.array(sorted({x for x, _ in total}), dtype=np.int64)
    if len(hot_v):
        first_salt = {x: min(salt for y, salt in total if y == x) for x in hot_v.tolist()}
        own = ~np.isin(bv, hot_v)
        rows = [(bv[own], bw[own], bc[own])]
        for hv, hw, hn, salt in full[1:]:
            mine = np.array([first_salt[x] == salt for x in hv.tolist()], dtype=bool) if len(hv) else np.zeros(0, bool)
            rows.append((hv[mine], hw[mine], hn[mine]))
        bv, bw, bc = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((bw, bv))
        bv, bw, bc = bv[order], bw[order], bc[order]
    of_v = np.unique(bv)
    v_total = np.bincount(np.searchsorted(of_v, bv), weights=bc, minlength=len(of_v))
    for x in hot_v.tolist():
        at_v = np.flatnonzero(of_v == x)
        v_total[at_v] = total[x, first_salt[x]]
    trie, file = Trie.build(tv[at], tu[at], tw[at], count[at], bv, bw, bc, v_total, log1[np.minimum(np.searchsorted(words, bw), len(words) - 1)],
                            strength2, strength3, span).mapped()
    try:
        step = 1 << 18
        found = [trie.query(tv[i:i + step], tu[i:i + step], tw[i:i + step], log1[np.searchsorted(words, tw[i:i + step])])
                 for i in range(0, len(tri), step)]
    finally:
        os.remove(file)
    logp = np.concatenate(found)[ti]
    out, at = [], 0
    for g, t in zip(blobs, t_):
        s = np.bincount(t >> 1, weights=logp[at:at + len(t)])
        at += len(t)
        here = np.unique(t >> 1)
        out.append((g["part"], 6, _deltas(here), pack_array(s[here].astype(np.float32))))
    return _batch(out, _SUM_TYPES)


_SUM_TYPES = [("part", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]


def _base_rows(batches: Iterator[pa.RecordBatch], log_total: float, key_type) -> Iterator[pa.RecordBatch]:
    """Kind 3: per part, ``a``: base scores, ``b``: tokens, known tokens and training flags, with the keys."""
    for part, keys, flags, n, _, c in _parts_with_words(batches):
        first = np.cumsum(n) - n
        base = np.add.reduceat(np.log10(c + 1.0) - log_total, first)
        known = np.add.reduceat((c > 0).astype(np.int64), first)
        yield _batch([(part, 3, pack_array(base), pack_array(np.stack([n, known, flags.astype(np.int64)])), keys)],
                     [*_SUM_TYPES, ("keys", pa.list_(key_type))])


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text",
                    part_chars: int = PART_CHARS, shard_tokens: int = SHARD_TOKENS, strength2: float = STRENGTH2,
                    strength3: float = STRENGTH3) -> DataFrame:
    """``(key, train, n_tokens, n_known, train_tokens, base_score, score)`` for every row; ``train`` is the
    condition of the rows that the model learns from."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    key_kind, key_type = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    n_ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts_path, words_path = scratch_path(spark, "lm-parts"), scratch_path(spark, "lm-words")
    write_parts(docs, train, parts_path, n_ranges, key, text, part_chars)
    schema = f"{_PART}, keys array<{key_kind}>"
    parts = spark.read.schema(schema).parquet(parts_path)
    sizes = parts.where("kind = 0").agg(F.sum("n").alias("n"), F.sum("shard").alias("texts")).first()
    write_words(parts, words_path, n_ranges, shard_tokens)
    words = spark.read.schema(_PART).parquet(words_path)
    n_train, n_words, top_id, hot = 0, 0, 0, []
    for r in words.where("kind = 2").select("n", "shard", "a").toLocalIterator():
        n_train, n_words = n_train + r["n"], n_words + r["shard"]
        top_id = max(top_id, int(np.frombuffer(bytes(r["a"]), np.int64)[0]))
    limit = max(shard_tokens, n_train // MAX_HOT)  # so there are at most MAX_HOT hot words
    for r in words.where("kind = 2 AND length(b) > 0").select("b", "c").toLocalIterator():
        i, c = np.frombuffer(bytes(r["b"]), np.int64), np.frombuffer(bytes(r["c"]), np.int64)
        hot += [(x, y) for x, y in zip(i.tolist(), c.tolist()) if y > limit]
    if (sizes["texts"] or 0) > limit:
        hot.append((_BEGIN, sizes["texts"]))
    hot.sort()
    hot_ids = np.array([h[0] for h in hot], dtype=np.int64)
    hot_salts = np.array([-(-h[1] // limit) for h in hot], dtype=np.int64)
    n_shards = max(n_ranges, -(-int(sizes["n"] or 0) // shard_tokens))
    span, log_total = top_id + 1, float(np.log10(n_train + n_words + 1))

    stream = (parts.where("kind = 0").select("part", "kind", "shard", "a", "b", "c", "keys")
              .unionByName(words.where("kind = 1").select("part", "kind", "shard", "a", "b", "c",
                                                          F.lit(None).cast(f"array<{key_kind}>").alias("keys")))
              .repartition("part").sortWithinPartitions("part", "kind", "shard"))
    blobs = stream.mapInArrow(lambda it: _gram_blobs(it, n_shards, hot_ids, hot_salts), _BLOB)
    if hot:
        pairs = (stream.mapInArrow(lambda it: _hot_pairs(it, hot_ids), "v long, w long, n long, c long")
                 .groupBy("v", "w").agg(F.sum("n").alias("n"), F.max("c").alias("c")))
        blobs = blobs.unionByName(pairs.mapInArrow(lambda it: _spread_pairs(it, n_shards, hot_ids, hot_salts), _BLOB))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, "shard"):
            yield _score_shard(group, log_total, strength2, strength3, span)

    sums = blobs.repartition(n_shards, "shard").sortWithinPartitions("shard", "kind", "part").mapInArrow(
        score, "part long, kind int, a binary, b binary")
    base = stream.mapInArrow(lambda it: _base_rows(it, log_total, key_type),
                             f"part long, kind int, a binary, b binary, keys array<{key_kind}>")
    both = base.unionByName(sums.withColumn("keys", F.lit(None).cast(f"array<{key_kind}>")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, "part"):
            head = group[0]
            n, known, flags = unpack_array(head["b"], np.int64).reshape(3, -1)
            total = np.zeros(len(n))
            for g in group[1:]:
                total[np.cumsum(_unplanes(g["a"], np.int64))] += unpack_array(g["b"], np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(head["keys"], key_type), pa.array(flags > 0), pa.array(n), pa.array(known),
                 pa.array(np.full(len(n), n_train, dtype=np.int64)),
                 pa.array(unpack_array(head["a"], np.float64)), pa.array(total)],
                names=[key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return (both.repartition("part").sortWithinPartitions("part", "kind")
            .mapInArrow(finish, f"`{key}` {key_kind}, train boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double"))
