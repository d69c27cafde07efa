"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most ``max_bits`` bits are linked; the classes are the connected
components.  A fingerprint is cut into ``max_bits // 2 + 1`` segments, so that two linked fingerprints differ
by at most one bit in at least one segment (plain block hashing needs ``max_bits + 1`` shorter segments).
Each segment is indexed under its one-wildcard variants (one per bit, with that bit left out): two segments
that differ by at most one bit share a variant.  An equality join on the variant gives the candidates, and the
whole fingerprints verify them.

Scale:

* Only distinct fingerprints are indexed; exact copies never meet each other.
* A variant's rows meet in one task only up to ``bucket_rows``.  Segment values are counted first (pre-aggregated);
  a variant that may hold more is split into blocks, and each pair of blocks is a group of its own.
* A task emits no pairs: it links the fingerprints of its groups in a spanning forest and emits one link per
  fingerprint at most.  In a large group it first links everything close to a few leaders; leaders further
  apart than three times ``max_bits`` cannot have linked members (triangle inequality), and groups that are
  in one component already are never compared again.  No link between components is lost.
* Components come from large-star/small-star rounds on those links, with a written table per round.

Defined results: a null or empty text has fingerprint zero, linked like any other; repeated rows and null ids
keep their rows; ``component_id`` is the smallest non-null id of the component (null if all are null); an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import WORDS, drop_scratch, lower_az, scratch_path, texts_of

SHINGLE, MAX_BITS, SEED = 4, 4, 42
BUCKET_ROWS = 20_000
BROADCAST_ROWS = 20_000  # of the hot variants; 24 bytes a row
_SMALL = 64  # runs up to this length are compared by shifting


# ------------------------------------------------------------------ fingerprints

def fingerprints(texts: list[str], width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if more than half of the shingle hashes have it."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    own: list[int] = []

    def flush():
        h = np.array(hashes, dtype=np.uint64)
        n = np.array(own, dtype=np.int64)
        ends = np.cumsum(n)
        at = 0
        for i, e in zip(idx, ends.tolist()):
            part = h[at:e]
            counts = np.zeros(64, dtype=np.int64)
            for s in range(0, len(part), 1 << 15):
                bits = np.unpackbits(part[s:s + (1 << 15)].astype(">u8").view(np.uint8))
                counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * counts > len(part)).view(">u8")[0]
            at = e
        hashes.clear()
        own.clear()
        idx.clear()

    idx: list[int] = []
    for i, t in enumerate(texts):
        ws = WORDS.findall(lower_az(t))
        if not ws:
            continue
        if len(ws) <= width:
            grams = [" ".join(ws)]
        else:
            grams = map(" ".join, zip(*[ws[j:] for j in range(width)]))
        before = len(hashes)
        hashes.extend([digest(g, seed) for g in grams])
        own.append(len(hashes) - before)
        idx.append(i)
        if len(hashes) > 1 << 18:
            flush()
    if idx:
        flush()
    return out


def fingerprint_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
                     seed: int = SEED) -> DataFrame:
    """``(key, fp long)`` for every row; one narrow pass."""
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(texts_of(b, text), width, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[key, "fp"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, fp long")


# ------------------------------------------------------------------ candidate index

def segments(max_bits: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of each segment, from the lowest bits up."""
    m = max_bits // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _variant_key(value, i: int, shift: int, width: int, free_bits: int):
    """The value with bit ``i`` left out (the bits above move down), tagged by the bit's place in 64."""
    low = value.bitwiseAND(F.lit((1 << i) - 1))
    high = F.shiftleft(F.shiftright(value, i + 1), i)
    # the tag keeps variants of different bits apart; 64 tags fit above a segment of up to 57 bits
    return (F.shiftleft(F.lit(shift + i).cast("long"), free_bits) + high + low).cast("long")


def variant_rows(fps: DataFrame, max_bits: int = MAX_BITS, fp: str = "fp") -> DataFrame:
    """``(vkey, fp)``: every one-wildcard variant of every segment of each fingerprint."""
    segs = segments(max_bits)
    if max(w for _, w in segs) > 57:
        # one segment of 64 bits: its variants do not fit beside a tag, so hash tag and value
        keys = [F.xxhash64(F.lit(i), F.col(fp).bitwiseAND(F.lit(~(1 << i) if i < 63 else (1 << 63) - 1))) for i in range(64)]
    else:
        free = max(w for _, w in segs)
        keys = [_variant_key(_segment(F.col(fp), s, w), i, s, w, free) for s, w in segs for i in range(w)]
    return fps.select(F.explode(F.array(*keys)).alias("vkey"), F.col(fp).alias("fp"))


def hot_variants(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(vkey, blocks)`` of variants that may hold more than ``bucket_rows`` fingerprints.

    A variant holds the fingerprints of two segment values, so counting the values (a few rows per
    fingerprint, pre-aggregated) bounds every variant: a value counted over half the limit makes its variants hot."""
    parts = None
    free = max(w for _, w in segments(max_bits))
    for s, w in segments(max_bits):
        v = (fps.groupBy(_segment(F.col("fp"), s, w).alias("v")).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") * 2 > bucket_rows))
        if free > 57:
            continue  # a whole fingerprint per segment: a variant holds two rows at most
        keys = F.array(*[_variant_key(F.col("v"), i, s, w, free) for i in range(w)])
        v = v.select(F.explode(keys).alias("vkey"), "n")
        parts = v if parts is None else parts.unionByName(v)
    if parts is None:
        return fps.sparkSession.createDataFrame([], "vkey long, blocks int")
    # the larger value's count at most doubles the smaller's, which is at most half the limit or listed too
    total = F.sum("n") + F.lit(bucket_rows // 2)
    return parts.groupBy("vkey").agg(F.ceil(total / bucket_rows).cast("int").alias("blocks"))


# ------------------------------------------------------------------ linking within groups

class _Forest:
    """Union-find over numbered fingerprints."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(q, p):
                self.parent = p
                return p
            p = q

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join ``a[i]`` with ``b[i]`` for all i."""
        while len(a):
            r = self.roots()
            ra, rb = r[a], r[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            np.minimum.at(self.parent, hi, lo)


def link_run(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Component labels of one large group: fingerprints that differ in at most ``max_bits`` bits are linked."""
    left = np.arange(len(fp))
    leaders, members, radius = [], [], []
    while len(left):
        d = np.bitwise_count(fp[left] ^ fp[left[0]])
        near = d <= max_bits
        leaders.append(left[0])
        members.append(left[near])
        radius.append(int(d[near].max()))
        left = left[~near]
    lead, rad = fp[np.array(leaders)], np.array(radius)
    forest = _Forest(len(leaders))
    root = forest.roots()
    for i in range(len(leaders)):
        # members can only be linked if their leaders are this close
        close = np.bitwise_count(lead[i + 1:] ^ lead[i]) <= rad[i] + rad[i + 1:] + max_bits
        for j in np.flatnonzero(close & (root[i + 1:] != root[i])) + i + 1:
            if root[i] == root[j]:
                continue
            a, b = members[i], members[j]
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            if any((np.bitwise_count(fp[b] ^ fp[x]) <= max_bits).any() for x in a):
                forest.link(np.array([i]), np.array([j]))  # one link joins both groups whole
                root = forest.roots()
    label = np.empty(len(fp), dtype=np.int64)
    for i, m in enumerate(members):
        label[m] = leaders[root[i]]
    return label


def link_groups(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links ``(fp, root fp)`` of all groups; ``group`` is sorted."""
    uniq, ids = np.unique(fp, return_inverse=True)
    forest = _Forest(len(uniq))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    run_of = np.repeat(np.arange(len(starts)), sizes)
    small = sizes[run_of] <= _SMALL
    for d in range(1, min(_SMALL, int(sizes.max())) if len(sizes) else 0):
        i = np.flatnonzero(small[:-d] & (run_of[d:] == run_of[:-d]))
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
        forest.link(ids[i], ids[i + d])
    for r in np.flatnonzero(sizes > _SMALL):
        s = slice(starts[r], starts[r] + sizes[r])
        forest.link(ids[s], ids[s][link_run(fp[s], max_bits)])
    root = forest.roots()
    at = np.flatnonzero(root != np.arange(len(uniq)))
    return uniq[at], uniq[root[at]]


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fps(fp)`` whose components are those of all pairs that
    differ in at most ``max_bits`` bits."""
    rows = variant_rows(fps, max_bits)
    hot = hot_variants(fps, max_bits, bucket_rows)
    n_hot = hot.limit(BROADCAST_ROWS + 1).count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "vkey", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
        rows = rows.select("vkey", "fp", F.coalesce(mine, F.lit(0)).alias("_m"), other.alias("_o"))
        # hashing the block pair into the key keeps the shuffle rows short; a clash only adds candidates
        rows = rows.select(F.when((F.col("_m") == 0) & (F.col("_o") == 0), F.col("vkey")).otherwise(
            F.xxhash64("vkey", F.least("_m", "_o"), F.greatest("_m", "_o"))).alias("vkey"), "fp")
    rows = rows.repartition("vkey").sortWithinPartitions("vkey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps_, held = [], [], 0

        def out():
            k, f = np.concatenate(keys), np.concatenate(fps_)
            # the last run may go on in the next batch
            last = np.searchsorted(k, k[-1], side="left") if not done else len(k)
            a, b = link_groups(k[:last], f[:last], max_bits)
            keys[:], fps_[:] = [k[last:]], [f[last:]]
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        done = False
        for b in batches:
            keys.append(b.column(0).to_numpy())
            fps_.append(b.column(1).to_numpy().view(np.uint64))
            held += b.num_rows
            if held >= 1 << 20:
                yield out()
                held = len(keys[0])
        done = True
        if keys and sum(map(len, keys)):
            yield out()

    return rows.mapInArrow(run, "a long, b long")


# ------------------------------------------------------------------ components

def components(links: DataFrame, name: str = "components", max_rounds: int = 50) -> tuple[DataFrame, list[str]]:
    """``(node, root)`` for every linked node, root the smallest node of its component, and the written tables
    that the caller may drop when done.

    Large-star and small-star rounds (each node's larger neighbours, then its smaller ones, are hung on the
    smallest neighbour) until nothing changes.  A hub's neighbours are not gathered: its minimum is a partial
    aggregate, and the join back is on unique keys, which Spark splits when skewed."""
    spark = links.sparkSession
    paths: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    def star(edges: DataFrame, large: bool) -> DataFrame:
        u, v = F.col("u"), F.col("v")
        if large:
            both = edges.select("u", "v").unionByName(edges.select(v.alias("u"), u.alias("v")))
        else:
            both = edges  # u > v already: a node's smaller neighbours
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(low, "u")
        if large:
            return joined.where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # each smaller neighbour, and the node itself, hangs on the smallest
        return (joined.select(v.alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v")))
                .where(F.col("u") != F.col("v")).distinct())

    a, b = F.col("a"), F.col("b")
    edges = written(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(max_rounds):
        new = written(star(star(edges, True), False))
        # settled when every node hangs on one node that hangs on none: then no round changes the edges
        bad = (new.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")))
        several = bad.where("n > 1").limit(1).count()
        deep = 0 if several else new.select("v").distinct().join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        edges = new
        if not several and not deep:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")), paths
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
                    max_bits: int = MAX_BITS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(key, fp, component_id)`` for every row of ``docs``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "simhash")
    fingerprint_rows(docs, key, text, width, seed).write.parquet(path)
    rows = spark.read.parquet(path)
    fps_path = scratch_path(spark, "simhash-distinct")
    rows.groupBy("fp").agg(F.min(key).alias("low")).write.parquet(fps_path)
    fps = spark.read.parquet(fps_path)
    roots, paths = components(near_links(fps.select("fp"), max_bits, bucket_rows), "simhash-links")
    tagged = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = tagged.groupBy("root").agg(F.min("low").alias("component_id"))
    table_path_ = scratch_path(spark, "simhash-classes")
    tagged.join(low, "root").select("fp", "component_id").write.parquet(table_path_)
    for p in [*paths, fps_path]:
        drop_scratch(spark, p)
    return rows.join(spark.read.parquet(table_path_), "fp").select(key, "fp", "component_id")


def fingerprint_hex(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
                  max_bits: int = MAX_BITS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` (all its columns) that stand for their class: smallest id, and one of repeated rows.

    Rows are told apart by id and a hash of all their columns; of rows that agree in both, one stays."""
    spark = docs.sparkSession
    # the row's columns are hashed one by one, so any type and any name will do
    mark = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns])
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"),
                         F.col(text).alias("_text"), mark.alias("_mark"))
    ids = near_duplicates(tagged.select(F.struct("_key", "_mark").alias("_id"), "_text"), "_id", "_text", width,
                          max_bits, seed, bucket_rows)
    # min of the structs puts null ids first; such a row still stands for its class
    first = ids.where(F.col("_id") == F.col("component_id")).select(F.col("component_id").alias("_id")).distinct()
    path = scratch_path(spark, "simhash-kept")
    first.select(F.col("_id._key").alias("_key"), F.col("_id._mark").alias("_mark")).write.parquet(path)
    kept = spark.read.parquet(path).withColumnRenamed("_key", "_k").withColumnRenamed("_mark", "_m")
    out = tagged.join(kept, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m")))
    return out.groupBy("_key", "_mark").agg(F.first("_row").alias("_row")).select("_row.*")
