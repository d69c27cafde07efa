"""Nearest neighbours by inner product: one hierarchical navigable small-world graph per shard.

Vectors are collapsed to distinct ones (a vector shared by many rows is indexed once, with the ``k + 1``
smallest ids, which is all a result of ``k`` can hold of it), and hashed into shards of about ``shard_rows``.
Each shard is one graph, kept as flat neighbour arrays in a row of an index table in the shared folder.
Inner product is turned into distance by one more component that gives all vectors of a shard the same length.

Queries are sent to every shard; a task reads its shard's index row first, then streams the queries, so its
memory is one graph and one batch.  Each shard answers with its ``k`` best rows by the exact inner product in
double precision; the answers are merged with a window that keeps ``k`` per query (limited before the shuffle).

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null id,
take no part; vectors of different lengths never meet; repeated rows (same id and vector) count once; ties go
to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.common import scratch_path

K, DEGREE, EF_BUILD, EF_SEARCH, SHARD_ROWS, SEED = 20, 16, 64, 64, 4096, 5


class Graph:
    """A small-world graph over the rows of ``x`` in flat arrays.

    ``links`` holds the neighbours of all nodes on all layers, ``-1`` where there are fewer; row ``first[v] + l``
    belongs to node ``v`` on layer ``l``.  Layer 0 may use all ``2 * degree`` places, upper layers ``degree``."""

    def __init__(self, x: np.ndarray, links: np.ndarray, first: np.ndarray, entry: int, top: int, degree: int):
        self.x, self.links, self.first, self.entry, self.top, self.degree = x, links, first, entry, top, degree
        self.seen, self.stamp = np.zeros(len(x), dtype=np.int64), 0

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, ef: int = EF_BUILD, seed: int = SEED) -> Graph:
        n = len(x)
        u = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(1 - u) / math.log(degree)).astype(np.int64), 12)
        first = np.cumsum(level + 1) - (level + 1)
        g = cls(x, np.full((int((level + 1).sum()), 2 * degree), -1, dtype=np.int32), first, 0, int(level[0]) if n else 0,
                degree)
        for v in range(1, n):
            g._insert(v, int(level[v]), ef)
        return g

    def _dist(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        # rows have equal length, so the order of distances is that of inner products, downwards
        return -(self.x[nodes] @ q)

    def _greedy(self, q: np.ndarray, at: int, layer: int) -> int:
        best = float(self._dist(q, np.array([at]))[0])
        while True:
            nb = self.links[self.first[at] + layer]
            nb = nb[nb >= 0]
            if not len(nb):
                return at
            d = self._dist(q, nb)
            i = int(d.argmin())
            if d[i] >= best:
                return at
            best, at = float(d[i]), int(nb[i])

    def _search(self, q: np.ndarray, at: int, layer: int, ef: int) -> list[tuple[float, int]]:
        """The ``ef`` closest nodes found from ``at``, closest first."""
        self.stamp += 1
        seen, stamp, links, first = self.seen, self.stamp, self.links, self.first
        d0 = float(self._dist(q, np.array([at]))[0])
        seen[at] = stamp
        todo, found = [(d0, at)], [(-d0, at)]
        while todo:
            d, v = heapq.heappop(todo)
            if d > -found[0][0] and len(found) >= ef:
                break
            nb = links[first[v] + layer]
            nb = nb[nb >= 0]
            nb = nb[seen[nb] != stamp]
            if not len(nb):
                continue
            seen[nb] = stamp
            ds = self._dist(q, nb)
            if len(found) >= ef:
                near = ds < -found[0][0]
                nb, ds = nb[near], ds[near]
            for dist, w in zip(ds.tolist(), nb.tolist()):
                if len(found) < ef:
                    heapq.heappush(found, (-dist, w))
                    heapq.heappush(todo, (dist, w))
                elif dist < -found[0][0]:
                    heapq.heapreplace(found, (-dist, w))
                    heapq.heappush(todo, (dist, w))
        return sorted((-d, v) for d, v in found)

    def _pick(self, nodes: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in different directions: a node is taken if no taken one is closer to it than the base.
        The closest of the rest fill up."""
        if len(nodes) <= most:
            return nodes
        x = self.x[nodes]
        between = -(x @ x.T)
        taken: list[int] = []
        near = np.full(len(nodes), np.inf)
        by_dist = np.argsort(dist, kind="stable").tolist()
        for i in by_dist:
            if near[i] > dist[i]:
                taken.append(i)
                if len(taken) == most:
                    break
                near = np.minimum(near, between[i])
        if len(taken) < most:
            have = set(taken)
            taken += [i for i in by_dist if i not in have][:most - len(taken)]
        return nodes[taken]

    def _insert(self, v: int, level: int, ef: int) -> None:
        q, at = self.x[v], self.entry
        for layer in range(self.top, level, -1):
            at = self._greedy(q, at, layer)
        for layer in range(min(self.top, level), -1, -1):
            found = self._search(q, at, layer, ef)
            at = found[0][1]
            nodes = np.array([w for _, w in found], dtype=np.int32)
            nb = self._pick(nodes, np.array([d for d, _ in found]), self.degree)
            self.links[self.first[v] + layer, :len(nb)] = nb
            most = self.degree * (2 if layer == 0 else 1)
            for w in nb.tolist():
                row = self.links[self.first[w] + layer]
                free = np.flatnonzero(row[:most] < 0)
                if len(free):
                    row[free[0]] = v
                else:
                    every = np.append(row[:most], np.int32(v))
                    # some places are left free, so that not every later link picks anew
                    kept = self._pick(every, self._dist(self.x[w], every), most - most // 8)
                    row[:] = -1
                    row[:len(kept)] = kept
        if level > self.top:
            self.entry, self.top = v, level

    def query(self, q: np.ndarray, ef: int) -> np.ndarray:
        at = self.entry
        for layer in range(self.top, 0, -1):
            at = self._greedy(q, at, layer)
        return np.array([v for _, v in self._search(q, at, 0, ef)], dtype=np.int64)


def augment(x: np.ndarray) -> np.ndarray:
    """Rows with one more component that makes them equally long (float32: the graph only guides)."""
    sq = (x * x).sum(axis=1)
    return np.hstack([x, np.sqrt(np.maximum(sq.max(initial=0.0) - sq, 0))[:, None]]).astype(np.float32)


def valid_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, vec array<double>, dim)`` of the rows that take part."""
    v = F.col("vec")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False))
                   & F.exists(v, lambda c: c != 0))
            .withColumn("dim", F.size("vec")))


_INDEX = "dim int, shard int, x binary, links binary, first binary, entry int, top int, members binary, member_first binary"


def build_index(vectors: DataFrame, n_shards: int, k: int = K, degree: int = DEGREE, ef: int = EF_BUILD) -> DataFrame:
    """One row per shard: vectors, flat neighbour arrays and the ids that share each vector."""
    w = Window.partitionBy("vec").orderBy("id")
    rows = (vectors.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= k + 1).drop("_r")
            .withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(n_shards)).cast("int")))

    names = [c.split()[0] for c in _INDEX.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(),
             pa.binary()]

    def graph_row(dim: int, shard: int, x: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        uniq, inverse = np.unique(x, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([inverse.ravel(), ids], axis=1), axis=0)
        member_first = np.searchsorted(pairs[:, 0], np.arange(len(uniq) + 1))
        g = Graph.build(augment(uniq), degree, ef)
        row = [dim, shard, uniq.tobytes(), g.links.tobytes(), g.first.astype(np.int64).tobytes(), g.entry, g.top,
               pairs[:, 1].astype(np.int64).tobytes(), member_first.astype(np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names=names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition is one shard, so this holds the vectors of one graph
        parts: dict[tuple[int, int], list] = {}
        for b in batches:
            dims, shards = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("dim", "shard"))
            ids = b.column(b.schema.get_field_index("id")).to_numpy()
            vec = b.column(b.schema.get_field_index("vec"))
            ends = np.concatenate([[0], np.cumsum(dims)])
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = flat[ends[at][:, None] + np.arange(dim)]
                for shard in np.unique(shards[at]).tolist():
                    mine = shards[at] == shard
                    parts.setdefault((dim, shard), []).append((x[mine], ids[at][mine]))
        for (dim, shard), got in sorted(parts.items()):
            yield graph_row(dim, shard, np.concatenate([x for x, _ in got]), np.concatenate([i for _, i in got]))

    # one shard to a partition: hashing would put several graphs into one task
    return rows.repartitionById(n_shards, F.col("shard")).mapInArrow(build, _INDEX)


def search(index: DataFrame, queries: DataFrame, n_shards: int, k: int = K, degree: int = DEGREE,
           ef: int = EF_SEARCH) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for queries ``(id, vec, dim)``: the best ``k`` of all shards."""
    blank = {c.split()[0]: c.split()[1] for c in _INDEX.split(", ")}
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"),
                           *[F.lit(None).cast(t).alias(c) for c, t in blank.items() if c not in ("dim", "shard")],
                           F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.lit(1).alias("kind"))
    held = index.select(*blank, F.lit(None).cast("long").alias("qid"), F.lit(None).cast("array<double>").alias("qvec"),
                        F.lit(0).alias("kind"))
    # a shard's index row comes before its queries
    stream = (held.unionByName(asked).repartitionById(n_shards, F.col("shard"))
              .sortWithinPartitions("dim", "shard", "kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, g, x, members, member_first = None, None, None, None, None
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            kinds, dims, shards = (cols[c].to_pylist() for c in ("kind", "dim", "shard"))
            qids = cols["qid"].to_pylist()
            out_q, out_v, out_s = [], [], []
            for i, kind in enumerate(kinds):
                if kind == 0:
                    raw = lambda c: cols[c][i].as_buffer()  # noqa: B023, E731
                    x = np.frombuffer(raw("x"), dtype=np.float64).reshape(-1, dims[i])
                    g = Graph(augment(x), np.frombuffer(raw("links"), dtype=np.int32).reshape(-1, 2 * degree),
                              np.frombuffer(raw("first"), dtype=np.int64), cols["entry"][i].as_py(),
                              cols["top"][i].as_py(), degree)
                    members = np.frombuffer(raw("members"), dtype=np.int64)
                    member_first = np.frombuffer(raw("member_first"), dtype=np.int64)
                    here = (dims[i], shards[i])
                    continue
                if here != (dims[i], shards[i]):
                    continue  # an empty shard
                q = np.array(cols["qvec"][i].as_py(), dtype=np.float64)
                found = g.query(np.append(q, 0).astype(np.float32), ef)
                score = x[found] @ q
                n = member_first[found + 1] - member_first[found]
                ids = np.concatenate([members[member_first[f]:member_first[f + 1]] for f in found])
                score = np.repeat(score, n)
                own = ids != qids[i]
                ids, score = ids[own], score[own]
                best = np.lexsort((ids, -score))[:k]
                out_q += [qids[i]] * len(best)
                out_v += ids[best].tolist()
                out_s += score[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()),
                                              pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    got = stream.mapInArrow(run, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest(table: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K,
            shard_rows: int = SHARD_ROWS, degree: int = DEGREE, ef_build: int = EF_BUILD,
            ef_search: int = EF_SEARCH) -> DataFrame:
    """The ``k`` nearest of all rows for every row with ``is_query`` (a condition on ``id``)."""
    spark = table.sparkSession
    vectors = valid_vectors(table, key, vector)
    n_shards = max(1, -(-vectors.count() // shard_rows))
    path = scratch_path(spark, "hnsw")
    build_index(vectors, n_shards, k, degree, ef_build).write.parquet(path)
    queries = vectors.where(is_query).dropDuplicates(["id", "vec"])
    return search(spark.read.parquet(path), queries, n_shards, k, degree, ef_search)
