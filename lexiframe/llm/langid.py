"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram (orders 1 to 3, lower-cased, hashed into ``2 ** bits`` bins) of every labelled
text.  Tasks add counts up in numpy and emit one block row per language and 1024 bins; block rows are shuffled
by block and summed as they stream, so no key gathers rows.  The result is a ``languages x bins`` matrix of
log probabilities, whose size is fixed by the parameters; it is broadcast after a check of that size.
Scoring is sparse: the bins a batch holds index the matrix, one sum per text.  More than ``MAX_LANGUAGES`` languages are
counted and scored in blocks of so many; the best, the second and the summed probability so far travel with each text.

Defined results: a text that is null or has no letter is ``und`` with score 0; equal scores go to the language
first in alphabetical order; without any training text every other text is ``und`` too.  Very long texts are
scored in slices, every n-gram once.  Repeated rows are counted and scored each; an empty table has an empty result;
extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import materialize

BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGUAGES = 64  # of a block; bound of the broadcast: languages x 2**bits x 4 bytes
UNDETERMINED = "und"
_BLOCK = 1024
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)
_SLICE = 1 << 20  # characters handled at once


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def gram_bins(codes: np.ndarray, owner: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and owner of every n-gram of one order that lies within one owner's codes."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, order * 0x27D4EB2F, dtype=np.uint64)
    for i in range(order):
        h = (h ^ codes[i:i + n]) * _MULT[i % 3]
        h ^= h >> np.uint64(15)
    keep = owner[:n] == owner[order - 1:]
    return ((h[keep] * _MULT[0]) >> np.uint64(13)).astype(np.int64) & ((1 << bits) - 1), owner[:n][keep]


def grams_of(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bins and owners of all n-grams of a batch, in bounded arrays.  Texts are joined up to ``_SLICE``
    characters; a longer text is cut into parts that overlap by one less than the order, so every n-gram
    comes up once."""
    group: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes = np.concatenate([c for _, c in group])
        owner = np.repeat([i for i, _ in group], [len(c) for _, c in group])
        for n in orders:
            for s in range(0, len(codes), _SLICE) if len(codes) > 2 * _SLICE else (0,):
                e = s + _SLICE + n - 1 if len(codes) > 2 * _SLICE else len(codes)
                yield gram_bins(codes[s:e], owner[s:e], n, bits)

    for i, t in enumerate(texts):
        if t:
            group.append((i, _codes(t)))
            size += len(t)
            if size >= _SLICE:
                yield from flush()
                group, size = [], 0
    if group:
        yield from flush()


def languages_of(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang") -> list[str]:
    """The languages of the training rows, in order (a list of names on the driver)."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    return sorted(r[0] for r in rows.select(lang).distinct().toLocalIterator())


def count_matrix(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", bits: int = BITS,
                 orders: tuple[int, ...] = ORDERS, langs: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (all, or the given ones), and n-gram counts ``languages x bins`` over their training rows."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    if langs is None:
        langs = languages_of(docs, train, text, lang)
    else:
        rows = rows.where(F.col(lang).isin(langs))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in a block")
    bins, place = 1 << bits, {x: i for i, x in enumerate(langs)}
    blocks = max(1, bins // _BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), bins), dtype=np.int64)
        for b in batches:
            own = np.array([place[x] for x in b.column(0).to_pylist()], dtype=np.int64)
            for g, o in grams_of(b.column(1).to_pylist(), orders, bits):
                total += np.bincount(own[o] * bins + g, minlength=total.size).reshape(total.shape)
        parts = total.reshape(len(langs) * blocks, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[u].tobytes() for u in used],
                                                                              pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(c, dtype=np.int64)
                sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()],
                                                                                    pa.binary())], names=["block", "counts"])

    out = np.zeros((len(langs), bins), dtype=np.int64)
    if langs:
        kind = "block int, counts binary"
        parts = out.reshape(len(langs) * blocks, -1)
        for r in rows.mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toLocalIterator():
            parts[r["block"]] += np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    return langs, out


def log_matrix(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """``languages x bins`` log probabilities with additive smoothing (uniform prior over languages)."""
    c = counts + smoothing
    return np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)


def score_texts(texts: list[str], logp: np.ndarray, bits: int, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Summed log probability of every text under every language."""
    out = np.zeros((len(texts), len(logp)))
    for g, o in grams_of(texts, orders, bits):
        if len(g):
            starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            for j in range(len(logp)):
                out[o[starts], j] += np.add.reduceat(logp[j][g], starts, dtype=np.float64)
    return out


def identify(docs: DataFrame, langs: list[str], counts: np.ndarray, key: str = "doc_id", text: str = "text",
             bits: int = BITS, orders: tuple[int, ...] = ORDERS, smoothing: float = SMOOTHING,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *keep, lang_pred, score, margin)``; score is the posterior of the prediction, margin the mean
    log-probability lead per n-gram over the second language."""
    rows = docs.select(key, text, *keep)
    assert len(langs) <= MAX_LANGUAGES and counts.shape == (len(langs), 1 << bits)
    model = docs.sparkSession.sparkContext.broadcast(log_matrix(counts, smoothing) if langs else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = model.value
        for b in batches:
            texts = [t if t is not None and any(map(str.isalpha, t)) else "" for t in b.column(1).to_pylist()]
            pred, score, margin = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if langs and texts:
                s = score_texts(texts, logp, bits, orders)
                best = s.argmax(axis=1)
                post = np.exp(s - s.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                top = np.sort(s, axis=1)
                for i, t in enumerate(texts):
                    if t:
                        pred[i], score[i] = langs[best[i]], post[i, best[i]]
                        margin[i] = (top[i, -1] - top[i, -2]) / len(t) if len(langs) > 1 else 0.0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[b.column(2 + i) for i in range(len(keep))], pa.array(pred, pa.string()),
                 pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
                names=[key, *keep, "lang_pred", "score", "margin"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.mapInArrow(run, kinds + ", lang_pred string, score double, margin double")


def identify_languages(docs: DataFrame, train: Column, target: DataFrame | None = None, key: str = "doc_id", text: str = "text",
                       lang: str = "lang", keep: tuple[str, ...] = (), bits: int = BITS, orders: tuple[int, ...] = ORDERS,
                       smoothing: float = SMOOTHING) -> DataFrame:
    """Learn from the training rows of ``docs`` and predict those of ``target`` (``docs`` unless given; the same names for
    key and text, and ``keep``): the result of ``identify``, for any number of languages."""
    target = docs if target is None else target
    langs = languages_of(docs, train, text, lang)
    if len(langs) <= MAX_LANGUAGES:
        counts = count_matrix(docs, train, text, lang, bits, orders, langs)[1]
        return identify(target, langs, counts, key, text, bits, orders, smoothing, keep)
    rows = target.select(key, text, *keep)
    none = F.lit(None).cast("double")
    state = rows.select(F.struct(*[F.col(c) for c in (key, *keep)]).alias("row"), F.col(text).alias("t"),
                        F.lit(None).cast("string").alias("lang"), none.alias("best"), none.alias("second"), none.alias("all"))
    schema = state.schema
    for at in range(0, len(langs), MAX_LANGUAGES):
        state = materialize(_with_block(state, schema, *count_matrix(docs, train, text, lang, bits, orders, langs[at:at + MAX_LANGUAGES]),
                                        bits, orders, smoothing), "languages")
    known = F.col("lang").isNotNull()
    return state.select(*[F.col(f"row.`{c}`").alias(c) for c in (key, *keep)],
                        F.when(known, F.col("lang")).otherwise(UNDETERMINED).alias("lang_pred"),
                        F.when(known, F.exp(F.col("best") - F.col("all"))).otherwise(0.0).alias("score"),
                        F.when(known, (F.col("best") - F.col("second")) / F.char_length("t")).otherwise(0.0).alias("margin"))


def _with_block(state: DataFrame, schema, langs: list[str], counts: np.ndarray, bits: int, orders: tuple[int, ...],
                smoothing: float) -> DataFrame:
    """Texts with one more block of languages: the best so far (of equal ones the earlier block's, which come first in
    order), the second, and the log of the summed probabilities."""
    model = state.sparkSession.sparkContext.broadcast(log_matrix(counts, smoothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is not None and any(map(str.isalpha, t)) else "" for t in b.column(1).to_pylist()]
            old = [np.array([np.nan if v is None else v for v in b.column(i).to_pylist()], dtype=float) for i in (3, 4, 5)]
            best, second, total = (np.where(np.isnan(v), -np.inf, v) for v in old)
            s = score_texts(texts, model.value, bits, orders)
            top = np.sort(s, axis=1)
            mine, next_ = top[:, -1], top[:, -2] if s.shape[1] > 1 else np.full(len(s), -np.inf)
            total = np.logaddexp(total, np.logaddexp.reduce(s, axis=1))
            new = mine > best
            first = s.argmax(axis=1) if len(s) else np.zeros(0, int)
            names = [langs[f] if n else o for f, n, o in zip(first, new, b.column(2).to_pylist())]
            second = np.where(new, np.maximum(best, next_), np.maximum(second, mine))
            best = np.maximum(best, mine)
            blank = [not t for t in texts]
            cols = [pa.array([None if k else n for k, n in zip(blank, names)], pa.string())]
            cols += [pa.array(v, pa.float64(), mask=np.array(blank, dtype=bool)) for v in (best, second, total)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["row", "t", "lang", "best", "second", "all"])

    return state.mapInArrow(run, schema)
