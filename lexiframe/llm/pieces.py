"""Piece sampling by forward filtering and backward sampling, and lossless decoding.

A text is segmented into the pieces of a public SentencePiece vocabulary.  Every path through the lattice of
matching pieces has a probability proportional to the product of its pieces' probabilities to the power
``alpha``; one path is drawn exactly from that distribution.  The forward pass sums path weights up to every
position; the backward pass draws, from the end, which piece ends there.  Draws come from a counter hash of
seed, row key, unit number and step, so a row's sample depends on nothing else: not on partitions, batches or
retries.

The vocabulary gives merge ranks, not probabilities; a piece of rank ``r`` gets ``1 / (r + 10)`` (Zipf's law),
normalised.  A space is the vocabulary's space mark; there is no normalisation and no prefix, and characters
without a piece are spelled in byte pieces (a literal space mark too), so decoding gives back every text.

No piece runs from a non-space into a space, and none holds a line break, so the lattice falls apart there
into units; a longer unit is cut further where two neighbouring characters never meet inside a piece.  The
forward pass runs once per distinct unit (bounded cache); the backward pass runs for all units of a block of
text at once: a node's edges are an interval of one sorted array, so a draw is a binary search.

Defined results: a null or empty text has no pieces; rows with equal keys and texts get equal samples; a null
key counts as the empty string; texts of any length are encoded whole; an empty table has an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiframe.llm.common import texts_of

ALPHA, SEED = 1.0, 11
ARENA_EDGES = 6_000_000
BLOCK_CHARS = 1 << 20
_LONG_UNIT = 64
_FILTER_BITS = 20
SPACE_MARK = "▁"


def default_path() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


def char_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def substring_hashes(codes: np.ndarray, length: int, shorter: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of all substrings of one length, by extending those of one less."""
    with np.errstate(over="ignore"):
        m = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(32)
        if shorter is not None:
            return shorter[:len(codes) - length + 1] * np.uint64(0xD6E8FEB86659FD93) + m[length - 1:]
        h = m
        for n in range(2, length + 1):
            h = h[:len(codes) - n + 1] * np.uint64(0xD6E8FEB86659FD93) + m[n - 1:]
        return h


def extended(shorter: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Hashes of substrings that are one character longer (``mixed`` are the hashes of that character)."""
    with np.errstate(over="ignore"):
        return shorter * np.uint64(0xD6E8FEB86659FD93) + mixed


class Vocabulary:
    """Surface strings, ids, log probabilities and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str, offset: float = 10.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [-1] * 256
        self.piece: dict[str, tuple[int, float]] = {}
        normal = []
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
                self.byte_id[int(name[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                surface = name.replace(SPACE_MARK, " ")
                self.bytes_of[i] = surface.encode()
                normal.append((-sp.get_score(i), i, surface))
        normal.sort()
        weight = 1.0 / (np.arange(len(normal)) + offset)
        logp = np.log(weight / weight.sum())
        self.byte_logp = float(logp[-1]) if len(logp) else 0.0
        for (_, i, surface), lp in zip(normal, logp):
            self.piece.setdefault(surface, (i, float(lp)))
        self.longest = max(map(len, self.piece), default=1)
        if any(re.search(r"[^ ] ", s) for s in self.piece):
            raise ValueError("a piece runs from a non-space into a space")
        line = "" if any("\n" in s for s in self.piece) else r"\n"
        self.units = re.compile(rf" *[^ {line}]+| +" + (r"|\n+" if line else ""))
        by_length: dict[int, list] = {}
        for text, (i, lp) in self.piece.items():
            by_length.setdefault(len(text), []).append((text, i, lp))
        self.tables = {}  # length -> sorted hashes, ids, log probabilities
        # length -> which leading bits occur in hashes of piece beginnings of that length, to drop places early
        self.maybe = {n: np.zeros(1 << _FILTER_BITS, dtype=bool) for n in range(1, self.longest + 1)}
        for n, rows in by_length.items():
            texts, i, lp = zip(*rows)
            codes, first = char_codes("".join(texts)), np.arange(len(rows)) * n
            h = None
            for k in range(1, n + 1):  # all pieces of one length at once
                h = substring_hashes(codes, k, h)
                self.maybe[k][h[first] >> np.uint64(64 - _FILTER_BITS)] = True
            order = np.argsort(h[first])
            self.tables[n] = (h[first][order], np.array(i, dtype=np.int64)[order], np.array(lp)[order])
        self.pairs = {s[i:i + 2] for s in self.piece for i in range(len(s) - 1)}

    def split(self, text: str) -> list[str]:
        """Units of a text; no piece crosses their borders."""
        out = self.units.findall(text)
        if max(map(len, out), default=0) > _LONG_UNIT:
            parts = []
            for u in out:
                if len(u) <= _LONG_UNIT:
                    parts.append(u)
                    continue
                at = 0
                for i in range(1, len(u)):
                    if u[i - 1:i + 1] not in self.pairs:
                        parts.append(u[at:i])
                        at = i
                parts.append(u[at:])
            out = parts
        return out


class Sampler:
    """Draws segmentations.  The arena holds the lattices of the units seen: for node ``v`` the edges that end
    there lie together in ``cum``, as ``v`` plus their cumulative probability."""

    def __init__(self, vocab: Vocabulary, alpha: float = ALPHA, seed: int = SEED, arena_edges: int = ARENA_EDGES):
        self.vocab, self.alpha, self.seed, self.arena_edges = vocab, alpha, seed, arena_edges
        self._reset()

    def _reset(self):
        self.place: dict[str, int] = {}  # unit -> its number
        self.starts, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)  # nodes of each unit
        self.cum, self.prev, self.ids = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)  # of each node's edges
        self.used = np.zeros(0, np.int64)  # how often each unit came up
        self.nodes = 0

    def _evict(self) -> None:
        """Keep the units that came up most, up to half of the arena."""
        last = np.r_[self.first, len(self.cum)]
        edges = last[self.ends + 1] - last[self.starts]
        order = np.argsort(-self.used, kind="stable")
        keep = np.sort(order[np.cumsum(edges[order]) <= self.arena_edges // 2])
        names = list(self.place)
        lens, n = self.ends[keep] - self.starts[keep] + 1, edges[keep]
        at_node, at_edge = np.cumsum(lens) - lens, np.cumsum(n) - n
        shift = at_node - self.starts[keep]  # of node numbers
        nodes = np.arange(lens.sum()) + np.repeat(self.starts[keep] - at_node, lens)
        own = np.arange(n.sum()) + np.repeat(last[self.starts[keep]] - at_edge, n)
        self.first = self.first[nodes] + np.repeat(at_edge - last[self.starts[keep]], lens)
        self.cum, self.prev, self.ids = self.cum[own] + np.repeat(shift, n), self.prev[own] + np.repeat(shift, n), self.ids[own]
        self.place = {names[u]: i for i, u in enumerate(keep.tolist())}
        self.starts, self.ends, self.nodes = at_node, at_node + lens - 1, int(lens.sum())
        self.used = self.used[keep] // 2

    def _add(self, units: list[str]) -> None:
        """Forward filtering of new units, all at once.  A unit of ``n`` characters has ``n + 1`` nodes.  An edge
        with a negative id spells a character without a piece in bytes."""
        vocab, base, n_edges = self.vocab, self.nodes, len(self.cum)
        codes = char_codes("".join(units))
        lens = np.array([len(u) for u in units], dtype=np.int64)
        unit = np.repeat(np.arange(len(units)), lens)
        first_node = np.cumsum(lens) - lens + np.arange(len(units))
        start, ids, logp, length = [], [], [], []
        mixed = substring_hashes(codes, 1)
        room = np.cumsum(lens)[unit] - np.arange(len(codes))  # characters left in the unit
        at, h = np.arange(len(codes)), mixed
        for k in range(1, min(vocab.longest, int(lens.max())) + 1):
            if k > 1:  # places where a piece may still go on
                stay = (room[at] >= k) & vocab.maybe[k - 1][h >> np.uint64(64 - _FILTER_BITS)]
                at = at[stay]
                h = extended(h[stay], mixed[at + k - 1])
            if k in vocab.tables:
                names, of, lp = vocab.tables[k]
                near = np.flatnonzero(vocab.maybe[k][h >> np.uint64(64 - _FILTER_BITS)])
                pos = np.minimum(np.searchsorted(names, h[near]), len(names) - 1)
                hit = names[pos] == h[near]
                i, pos = at[near[hit]], pos[hit]
                start.append(i + unit[i])
                ids.append(of[pos])
                logp.append(lp[pos])
                length.append(np.full(len(i), k))
            if k == 1:
                alone = np.ones(len(codes), dtype=bool)
                alone[i if k in vocab.tables else []] = False
                i = np.flatnonzero(alone)
                c = codes[i].astype(np.int64)
                start.append(i + unit[i])
                ids.append(-c - 1)
                logp.append(vocab.byte_logp * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
                length.append(np.ones(len(i), dtype=np.int64))
        start, ids, logp, length = map(np.concatenate, (start, ids, logp, length))
        # by end, then start: few sorted runs, which a stable sort merges
        order = np.argsort((start + length) * (vocab.longest + 1) + vocab.longest - length, kind="stable")
        start, end, ids, logp = start[order], (start + length)[order], ids[order], logp[order] * self.alpha
        total = int(lens.sum()) + len(units)
        node_unit = np.repeat(np.arange(len(units)), lens + 1)
        depth = end - first_node[node_unit[end]]
        weight = np.zeros(total)  # log of the summed weight of all paths to a node
        within = np.empty(len(end))
        by_depth = np.argsort(depth.astype(np.uint16) if int(lens.max()) < 1 << 16 else depth, kind="stable")
        cut = np.searchsorted(depth[by_depth], np.arange(1, int(lens.max()) + 2))
        for lo, hi in zip(cut, cut[1:]):
            at = by_depth[lo:hi]
            if not len(at):
                continue
            node = end[at]
            seg = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[seg, len(at)])
            value = weight[start[at]] + logp[at]
            top = np.maximum.reduceat(value, seg)
            share = np.exp(value - np.repeat(top, size))
            mass = np.add.reduceat(share, seg)
            weight[node[seg]] = top + np.log(mass)
            run = np.cumsum(share / np.repeat(mass, size))
            run -= np.repeat(run[seg] - share[seg] / mass, size)
            run[np.r_[seg[1:], len(at)] - 1] = 1.0
            within[at] = run
        self.place.update(zip(units, range(len(self.starts), len(self.starts) + len(units))))
        self.starts = np.concatenate([self.starts, base + first_node])
        self.ends = np.concatenate([self.ends, base + first_node + lens])
        self.nodes = base + total
        self.cum = np.concatenate([self.cum, base + end + within])
        self.prev = np.concatenate([self.prev, base + start])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.first = np.concatenate([self.first, n_edges + np.searchsorted(end, np.arange(total))])

    def sample(self, texts: list[str], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        import xxhash

        per_text = [self.vocab.split(t) for t in texts]
        flat = [u for us in per_text for u in us]
        counts = np.zeros(len(texts), dtype=np.int64)
        if not flat:
            return np.zeros(0, np.int32), counts
        new = [u for u in dict.fromkeys(flat) if u not in self.place]
        if new:
            self._add(new)
            self.used = np.r_[self.used, np.zeros(len(new), np.int64)]
        unit = np.fromiter(map(self.place.__getitem__, flat), dtype=np.int64, count=len(flat))
        self.used += np.bincount(unit, minlength=len(self.used))
        start, cur = self.starts[unit], self.ends[unit]
        n_units = np.array([len(us) for us in per_text], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), n_units)
        row_hash = np.array([xxhash.xxh64_intdigest(k, self.seed) for k in keys], dtype=np.uint64)
        unit_no = np.arange(len(flat)) - np.repeat(np.cumsum(n_units) - n_units, n_units)
        with np.errstate(over="ignore"):
            state = row_hash[row] ^ (unit_no.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live = np.argsort(cur, kind="stable")  # neighbours in the arena are searched together
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(live):
            node = cur[live]
            with np.errstate(over="ignore"):  # a counter hash in [0, 1)
                z = state[live] + np.uint64(step + 1) * np.uint64(0xD1B54A32D192ED03)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            edge = np.searchsorted(self.cum, node + u, side="right")
            # rounding must not leave the node's own edges
            last = np.where(node + 1 < len(self.first), self.first[np.minimum(node + 1, len(self.first) - 1)], len(self.cum))
            edge = np.clip(edge, self.first[node], last - 1)
            steps.append((live, self.ids[edge]))
            cur[live] = self.prev[edge]
            live = live[cur[live] != start[live]]
            step += 1
        n_ids = np.zeros(len(flat), dtype=np.int64)
        for at, _ in steps:
            n_ids[at] += 1
        offset = np.cumsum(n_ids) - n_ids
        out = np.empty(int(n_ids.sum()), dtype=np.int32)
        for k, (at, ids) in enumerate(steps):  # the first draw is the unit's last piece
            out[offset[at] + n_ids[at] - 1 - k] = ids
        if len(self.cum) > self.arena_edges:
            self._evict()
        owner = np.repeat(row, n_ids)
        size = np.ones(len(out), dtype=np.int64)
        spelled = np.flatnonzero(out < 0)
        if len(spelled):
            chars, which = np.unique(out[spelled], return_inverse=True)
            data = [chr(-c - 1).encode("utf-8", "surrogatepass") for c in chars.tolist()]
            size[spelled] = np.array([len(d) for d in data])[which]
            to = np.cumsum(size) - size
            flat_ids = np.repeat(out, size)
            for j, d in enumerate(data):
                places = to[spelled[which == j]]
                for k, byte in enumerate(d):
                    flat_ids[places + k] = self.vocab.byte_id[byte]
            out = flat_ids
        counts += np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
        return out, counts


def decode_ids(vocab: Vocabulary, ids) -> str:
    table = vocab.bytes_of
    return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")


def _blocks(keys: list[str], texts: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS or i + 1 == len(texts):
            yield keys[at:i + 1], texts[at:i + 1]
            at, size = i + 1, 0


def encode_sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, seed: int = SEED,
                   path: str | None = None) -> DataFrame:
    """``(key, ids, n_ids, lossless)``; ``lossless`` says that the ids decode to the very text."""
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(path or default_path())
        sampler = Sampler(vocab, alpha, seed)
        for b in batches:
            at = 0
            names = ["" if k is None else str(k) for k in b.column(0).to_pylist()]
            for keys, texts in _blocks(names, texts_of(b, text)):
                flat, counts = sampler.sample(texts, keys)
                ends = np.cumsum(counts)
                same = [decode_ids(vocab, flat[e - n:e].tolist()) == t for t, e, n in zip(texts, ends, counts)]
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), ids, pa.array(counts), pa.array(same, pa.bool_())],
                    names=[key, "ids", "n_ids", "lossless"])
                at += len(texts)

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_ids long, lossless boolean")


def decode_rows(rows: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``(key, text)`` from id arrays; a null array gives a null text."""
    rows = rows.select(key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(path or default_path())
        for b in batches:
            out = [None if i is None else decode_ids(vocab, i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")
