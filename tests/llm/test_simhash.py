import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lexiframe.llm import simhash
from tests.llm.util import docs, words


def _fingerprint(t):
    ws = words(t)
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + 4]) for i in range(len(ws) - 3)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _classes(fps, k=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    f = np.array(fps, dtype=np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= k):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def _check(rows, texts, ids):
    fps = [_fingerprint(t) for t in texts]
    roots = _classes(fps)
    low = defaultdict(list)
    for r, i in zip(roots, ids):
        if i is not None:
            low[r].append(i)
    want = sorted(((str(i), f"{f:016x}", min(low[r], default=None)) for i, f, r in zip(ids, fps, roots)), key=str)
    got = sorted(((str(r[0]), r[1], r[2]) for r in rows), key=str)
    assert got == want


def test_awkward_rows(spark):
    df = docs(spark)
    out = simhash.near_duplicates(df).select("doc_id", simhash.fingerprint_hex("fp"), "component_id").collect()
    all_ = df.collect()
    _check(out, [r.text for r in all_], [r.doc_id for r in all_])
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bucket_rows", [30, 20_000])
def test_near_copies_and_chains(spark, bucket_rows):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(120)]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
            if rng.random() < 0.3:
                base = t  # chains: neighbours are near, ends need not be
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    out = simhash.near_duplicates(df, bucket_rows=bucket_rows)
    _check(out.select("doc_id", simhash.fingerprint_hex("fp"), "component_id").collect(), texts, list(range(len(texts))))


@pytest.mark.parametrize("seed", range(4))
def test_links_of_dense_groups(seed):
    rng = np.random.default_rng(seed)
    f = []
    for b in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(120):
            y = b
            for i in rng.choice(64, rng.integers(0, 6), replace=False):
                y ^= np.uint64(1) << np.uint64(i)
            f.append(y)
            if rng.random() < 0.3:
                b = y
    f = np.unique(np.array(f, dtype=np.uint64))
    a, b = simhash.link_groups(np.zeros(len(f), int), f, 4)
    mine = f.copy()
    mine[np.searchsorted(f, a)] = b
    assert (f[np.array(_classes(f))] == mine).all()


@pytest.mark.parametrize("max_bits", [1, 2, 3, 4, 6])
def test_variants_meet_whenever_close(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    pairs = []
    for a in rng.integers(0, 2**63, 60, dtype=np.uint64):
        b = a
        for i in rng.choice(64, max_bits, replace=False):
            b ^= np.uint64(1) << np.uint64(i)
        pairs.append((int(a.view(np.int64)), int(b.view(np.int64))))
    fps = spark.createDataFrame([(x,) for p in pairs for x in p], "fp long")
    keys = defaultdict(set)
    for r in simhash.variant_rows(fps, max_bits).collect():
        keys[r.fp].add(r.vkey)
    assert all(keys[a] & keys[b] for a, b in pairs)
    assert sum(w for _, w in simhash.segments(max_bits)) == 64


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(5, 5)]
    roots, _ = simhash.components(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.root for r in roots.collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 150)}}


def test_one_row_per_class_stays(spark):
    df = docs(spark)
    kept = simhash.one_per_class(df)
    assert kept.columns == df.columns
    all_ = df.collect()
    roots = _classes([_fingerprint(r.text) for r in all_])
    assert kept.count() == len(set(roots))
    low = {}
    for r, x in zip(all_, roots):
        low.setdefault(x, []).append(r.doc_id)
    ids = {r.doc_id for r in kept.collect()}
    for members in low.values():
        assert (None if None in members else min(members)) in ids
