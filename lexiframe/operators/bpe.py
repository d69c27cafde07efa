"""Byte-pair vocabularies: training, encoding, markers, supplied byte-level vocabularies.

Training (``train_bpe``) learns thousands of merges a round on islands of frequent pairs, see ``bpe_training``.

Encoding is narrow: the JVM normalises and cuts texts into pre-tokens; an Arrow UDF turns the pre-tokens of a slice of
a batch into a dictionary (each distinct one once, in Arrow's own code), looks each distinct one up in the worker's
cache, runs the merge loop for new ones only, and gathers the ids of all occurrences with array operations.  No Python
code runs per occurrence, no occurrence is shuffled, and a hot word is one entry of a slice's dictionary.  Slices and
cache are bounded, so a worker holds one batch (its bytes are bounded by Spark) and one slice, whatever the table.  The merge loop is a linked
list with a heap of candidate pairs, ``n log n`` in a word's length.  The vocabulary is broadcast once; the encoder
built from it and its cache stay with the broadcast value in the worker, for all tasks.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.functions.rows import row_slices
from lexiframe.functions.text import SPECIAL_TOKENS, byte_alphabet, byte_pretokens, normalize, \
    pretokenize_keep_specials, protect_specials, sentinel_for, unescape
from lexiframe.operators.bpe_training import FIRST_PAIRS, MAX_ISLANDS, MAX_PAIRS, learn_merges
from lexiframe.operators.vocab import MERGES_SCHEMA, VOCAB_SCHEMA, alphabet, word_counts
from lexiframe.session import checkpoint_dir, materialize, release


@dataclass
class BpeModel:
    """A trained vocabulary: id -> token, merges in rank order as (left id, right id, new id)."""

    tokens: list[str]
    kinds: list[str]
    merges: list[tuple[int, int, int]] = field(default_factory=list)
    specials: list[str] = field(default_factory=lambda: list(SPECIAL_TOKENS))
    unk_token: str = "[UNK]"
    rounds: int = 0
    _shared: tuple | None = field(default=None, repr=False, compare=False)

    def token_to_id(self, tok: str) -> int | None:
        try:
            return self.tokens.index(tok)
        except ValueError:
            return None

    @property
    def unk_id(self) -> int:
        return self.token_to_id(self.unk_token)

    def shared(self):
        """The vocabulary as one broadcast a session, in plain types (workers need not have this package)."""
        sc = SparkSession.active().sparkContext
        if self._shared is None or self._shared[0] != sc.applicationId:
            value = {"model": (self.tokens, self.merges, self.specials, self.unk_token)}
            self._shared = (sc.applicationId, sc.broadcast(value))
        return self._shared[1]

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(t, i, k) for i, (t, k) in enumerate(zip(self.tokens, self.kinds))], VOCAB_SCHEMA)

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        t = self.tokens
        return spark.createDataFrame(
            [(r, t[a], t[b], t[c]) for r, (a, b, c) in enumerate(self.merges)], MERGES_SCHEMA)

    @classmethod
    def from_frames(cls, vocab: DataFrame, merges: DataFrame, specials: list[str] | None = None,
                    unk_token: str = "[UNK]") -> BpeModel:
        """Load from vocabulary/merge tables (both bounded by the vocabulary size)."""
        rows = sorted(vocab.collect(), key=lambda r: r["id"])
        tokens = [r["token"] for r in rows]
        kinds = [r["kind"] for r in rows]
        ids = {t: i for i, t in enumerate(tokens)}
        ms = sorted(merges.collect(), key=lambda r: r["rank"])
        mlist = [(ids[r["left"]], ids[r["right"]], ids[r["merged"]]) for r in ms]
        sp = specials if specials is not None else [t for t, k in zip(tokens, kinds) if k == "special"]
        return cls(tokens, kinds, mlist, sp, unk_token)


def train_bpe(texts: DataFrame, vocab_size: int, text: str = "text",
              specials: list[str] | None = None, unk_token: str = "[UNK]", word_table: DataFrame | None = None,
              max_islands: int = MAX_ISLANDS, max_pairs: int = MAX_PAIRS, first_pairs: int = FIRST_PAIRS) -> BpeModel:
    """Train a BPE vocabulary of ``vocab_size`` entries (specials and alphabet included).

    Ids: specials in list order, then the alphabet by code point, then merges
    in the order they are learned; ties between equal counts go to the
    smaller ``(left id, right id)``.  The other parameters bound a round (see ``bpe_training``) and do not change the
    result.
    """
    specials = list(SPECIAL_TOKENS if specials is None else specials)
    checkpoint_dir(texts.sparkSession)
    wc = materialize(word_table if word_table is not None else word_counts(texts, text), "bpe-words")
    alpha = sorted(alphabet(wc, specials=specials, first_id=len(specials)).collect(), key=lambda r: r["id"])
    tokens = specials + [r["token"] for r in alpha]
    model = BpeModel(tokens, ["special"] * len(specials) + ["alphabet"] * len(alpha), [], specials, unk_token)
    if len(tokens) < vocab_size and alpha:
        ids_of = {t: i for i, t in enumerate(tokens)}
        model.merges, model.rounds = learn_merges(wc, tokens, ids_of, vocab_size, max_islands, max_pairs, first_pairs)
        model.kinds += ["merge"] * (len(tokens) - len(model.kinds))
    release(wc)
    return model


# ---------------------------------------------------------------------------
# Encoding
# ---------------------------------------------------------------------------

_CACHED_WORDS, _CACHED_CHARS = 200_000, 64  # of a worker: some 60 MB of usual words
_SLICE_WORDS = 1 << 19
_LOW = (1 << 32) - 1


def merge_symbols(syms: list[int], ranks: dict[int, int]) -> list[int]:
    """Merge a word's symbols: always the pair of the lowest rank, the leftmost of them.  ``ranks`` maps
    ``left << 32 | right`` to ``rank << 32 | new id``."""
    n = len(syms)
    if n < 2:
        return syms
    syms = list(syms)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        e = ranks.get(syms[i] << 32 | syms[i + 1])
        if e is not None:
            heap.append((e >> 32, i, e & _LOW))
    heapq.heapify(heap)
    while heap:
        _, i, new = heapq.heappop(heap)
        j = after[i]
        if syms[i] < 0 or j < 0:
            continue
        e = ranks.get(syms[i] << 32 | syms[j])
        if e is None or e & _LOW != new:
            continue  # a neighbour was merged meanwhile
        syms[i], syms[j] = new, -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            e = ranks.get(new << 32 | syms[k])
            if e is not None:
                heapq.heappush(heap, (e >> 32, i, e & _LOW))
        p = before[i]
        if p >= 0:
            e = ranks.get(syms[p] << 32 | new)
            if e is not None:
                heapq.heappush(heap, (e >> 32, p, e & _LOW))
    return [s for s in syms if s >= 0]


def word_encoder(tokens: list[str], merges: list[tuple[int, int, int]], specials: list[str], unk_token: str
                 ) -> Callable[[str], bytes]:
    """Pre-token -> ids (as bytes of 32-bit integers), with a cache of the words seen."""
    ids = {t: i for i, t in enumerate(tokens)}
    ranks: dict[int, int] = {}
    for r, (a, b, c) in enumerate(merges):
        ranks.setdefault(a << 32 | b, r << 32 | c)
    unk = ids.get(unk_token, 0)
    sentinels = {sentinel_for(i): array("i", [ids[s]]).tobytes() for i, s in enumerate(specials) if s in ids}
    cache: dict[str, bytes] = {}

    def encode_word(w: str) -> bytes:
        out = cache.get(w) or sentinels.get(w)
        if out is None:
            out = array("i", merge_symbols([ids.get(ch, unk) for ch in unescape(w)], ranks)).tobytes()
            if len(w) <= _CACHED_CHARS:
                if len(cache) >= _CACHED_WORDS:
                    cache.clear()
                cache[w] = out
        return out

    return encode_word


def encode_lists(words: pa.ListArray, encode_word: Callable[[str], bytes], slice_words: int = _SLICE_WORDS
                 ) -> Iterator[pa.ListArray]:
    """Lists of pre-tokens -> lists of ids, in slices of about ``slice_words`` pre-tokens (one row at least), so that
    what is held beside a batch does not grow with it; each distinct pre-token of a slice is encoded once."""
    per_row = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for start, stop in row_slices(per_row, slice_words):
        rows = words.slice(start, stop - start)
        seen = rows.flatten().dictionary_encode()
        per_word = [encode_word(w) for w in seen.dictionary.to_pylist()]
        lens = np.array([len(x) for x in per_word], dtype=np.int64) // 4
        ids = np.frombuffer(b"".join(per_word), dtype=np.int32)
        at = seen.indices.to_numpy(zero_copy_only=False)
        size = lens[at]
        ends = np.r_[0, np.cumsum(size)]
        flat = ids[np.arange(ends[-1]) + np.repeat((np.cumsum(lens) - lens)[at] - ends[:-1], size)]
        offsets = pa.array(ends[np.r_[0, np.cumsum(per_row[start:stop])]].astype(np.int32))
        yield pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=rows.is_null() if rows.null_count else None)


def encode_words_udf(model: BpeModel):
    """Arrow UDF: array<string> of pre-tokens -> array<int> of ids."""
    shared = model.shared()

    @F.arrow_udf("array<int>")
    def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = shared.value  # stays in the worker while the broadcast lives, and the encoder with it
        if "encoder" not in state:
            state["encoder"] = word_encoder(*state["model"])
        for words in batches:
            yield from encode_lists(words, state["encoder"])

    return _encode


def encode(text: Column, model: BpeModel, max_ids: int | None = None) -> Column:
    """Text -> ids: special strings become their ids, the rest is normalised,
    pre-tokenized (JVM) and BPE-encoded per word (Arrow UDF).

    ``max_ids``: the caller keeps only the first ``max_ids`` ids (right
    truncation).  Every pre-token yields at least one id and a word's ids do
    not depend on the words after it, so encoding the first ``max_ids``
    pre-tokens gives exactly the first ``max_ids`` ids of the whole text;
    the text itself is still normalised and pre-tokenized in full.
    """
    prot = protect_specials(text, model.specials)
    # through a lambda, which names the protected text: normalising reads it several times
    norm = F.get(F.transform(F.array(prot), normalize), F.lit(0))
    toks = pretokenize_keep_specials(norm)
    if max_ids is not None:
        toks = F.slice(toks, 1, max_ids)
    out = encode_words_udf(model)(toks)
    return F.slice(out, 1, max_ids) if max_ids is not None else out


def with_markers(ids: Column, begin_id: int | None, end_id: int | None, max_length: int | None = None) -> Column:
    """Id form of the boundary markers, then right truncation (the end marker is
    lost on long rows, as when truncating after concatenation)."""
    parts = ([F.array(F.lit(begin_id))] if begin_id is not None else []) + [ids] + \
            ([F.array(F.lit(end_id))] if end_id is not None else [])
    out = F.concat(*parts) if len(parts) > 1 else ids
    return F.slice(out, 1, max_length) if max_length else out


def add_pad_token(model: BpeModel, pad_token: str = "[PAD]") -> BpeModel:
    """Supplied-vocabulary variant: add a pad token at ``max(id) + 1`` if missing."""
    if pad_token in model.tokens:
        return model
    return BpeModel(model.tokens + [pad_token], model.kinds + ["special"], list(model.merges),
                    model.specials + [pad_token], model.unk_token)


# ---------------------------------------------------------------------------
# Byte-level vocabularies
# ---------------------------------------------------------------------------

def byte_model(marker: str = "<|endoftext|>") -> BpeModel:
    """The byte alphabet alone: the marker is id 0, byte ``b`` is id ``b + 1``."""
    return BpeModel([marker, *byte_alphabet()], ["special"] + ["alphabet"] * 256, [], [marker], marker)


def load_byte_model(spark: SparkSession, path: str, marker: str = "<|endoftext|>") -> BpeModel:
    """A supplied byte-level vocabulary from a tokenizer JSON file (its size bounds what is read)."""
    if "://" in path:
        file = json.loads(spark.read.text(path, wholetext=True).first()[0])
    else:  # a local file of the driver, which executors need not have
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
    model = file["model"]
    ids = model["vocab"] | {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    tokens = sorted(ids, key=ids.get)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    return BpeModel(tokens, ["special" if t == marker else "alphabet" if len(t) == 1 else "merge" for t in tokens],
                    merges, [marker], marker)


def encode_byte_level(text: Column, model: BpeModel, max_ids: int | None = None) -> Column:
    """Text -> ids by a byte-level vocabulary: no normalising, byte-level pre-tokens (JVM), then the per-word
    step of ``encode``.  ``max_ids`` as there."""
    toks = byte_pretokens(text, model.specials)
    if max_ids is not None:
        toks = F.slice(toks, 1, max_ids)
    out = encode_words_udf(model)(toks)
    return F.slice(out, 1, max_ids) if max_ids is not None else out
