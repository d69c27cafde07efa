import itertools
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import packing, sharding, urls
from tests.llm.util import TEXTS, docs


def _library_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_paths()[0])
    return [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_ids_equal_the_tokenizer_library():
    enc = packing.UnitEncoder(*packing.default_paths(), cache_units=50)
    texts = [*TEXTS, "a  b", "a   b", " lead", "trail ", "x \n y", "x\n  y", "a\u00a0 b", "it's <|endoftext|> here",
             "don't  <|endoftext|>", "\n\n x", "  ", " ", "a\tb \t c"]
    for t, want in zip(texts, _library_ids(texts)):
        assert np.frombuffer(enc.encode(t or ""), "<u4").tolist() == want[:-1], repr(t)[:40]


def test_ids_of_mixed_white_space_runs_equal_the_tokenizer_library():
    enc = packing.UnitEncoder(*packing.default_paths())
    texts = ["a \u00a0 \u00a0 b", "a" + " \u00a0" * 4 + " b", "a" + "\u00a0 " * 4 + "b", "\u00a0 \u00a0 x y", "x \u00a0 \u00a0",
             *[f"a{''.join(r)}b c" for n in (2, 3, 4) for r in itertools.product(" \u00a0\n\t\u3000\u2003\x85\x1c", repeat=n)]]
    for t, want in zip(texts, _library_ids(texts)):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want[:-1], repr(t)


def test_pack_block_is_whole_and_balanced():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 3000, 400)
    pieces, cost = packing.pack_block(lengths, 1024)
    assert len(cost) == -(-lengths.sum() // 1024)  # as few sequences as the tokens need
    used, seen = Counter(), defaultdict(list)
    for d, s, n, q in pieces:
        used[q] += n
        seen[d].append((s, n))
    assert max(used.values()) <= 1024
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at
            at += k
        assert at == n


def test_lowest_cost_sequence_gets_the_next_piece():
    pieces, cost = packing.pack_block(np.array([6, 5, 4, 3, 2]), 10, 1.0, 1.0)
    # 20 tokens, two sequences: 6 | 5, then 4 to the cheaper second, 3 to the first, 2 is cut or fits
    where = {(d, s): q for d, s, n, q in pieces}
    assert where[(0, 0)] != where[(1, 0)] and where[(2, 0)] == where[(1, 0)] and where[(3, 0)] == where[(0, 0)]
    assert sorted(cost.tolist()) == sorted(sum(n + n * n for _, _, n, q in pieces if q == k) for k in (0, 1))


def test_pack_documents(spark):
    df = docs(spark)
    rows = packing.pack_documents(df, max_tokens=64, block_tokens=5000, with_ids=True).collect()
    want = Counter((r.doc_id, tuple(i)) for r, i in zip(df.collect(), _library_ids([r.text for r in df.collect()])))
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.length == len(r.ids)
        by_seq[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
        by_doc[(r.doc_id, r.doc_tokens)].append((r.start, tuple(r.ids)))
    for parts in by_seq.values():
        at = 0
        for off, n, total in sorted(parts):
            assert off == at
            at += n
        assert at == total <= 64
    for (i, n), parts in by_doc.items():
        copies = [k for (j, t), k in want.items() if j == i and len(t) == n]
        assert sum(len(p) for _, p in parts) == n * sum(copies)
    assert {(i, n) for i, n in by_doc} == {(i, len(t)) for i, t in want}
    assert packing.pack_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bucket_rows", [2, 8192])
def test_stratified_shards(spark, bucket_rows):
    df = spark.range(1000).selectExpr("id as doc_id", "concat('t', id % 300) as text",
                                      "if(id % 3 = 0, 'hot', if(id % 50 = 1, null, concat('s', id % 7))) as source",
                                      "'clash' as shard", "1 as _h")
    rows = sharding.stratified_shards(df, 24, bucket_rows=bucket_rows).collect()
    assert sorted(r.position for r in rows) == list(range(1000))
    per, mix, total = defaultdict(list), defaultdict(Counter), Counter(r.stratum for r in rows)
    for r in rows:
        per[r.shard].append(r.slot)
        mix[r.shard][r.stratum] += 1
        assert r.shard == r.position * 24 // 1000
    sizes = [len(v) for v in per.values()]
    assert len(per) == 24 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    for shard, c in mix.items():  # every shard holds every source in proportion
        for s, n in total.items():
            assert abs(c[s] - n / 24) <= 2
    assert len({r.doc_id for r in rows}) == 1000 and None in total
    check_order(df, rows)


def check_order(df, rows):
    """Brute force: ranks in the seeded order of each source, then all rows by fractional rank and that order."""
    body = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(body) + 8).cast("long"), F.crc32(body.cast("binary"))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(sharding.SEED), "doc_id", crc, size), 2)
    by_source = defaultdict(list)
    for r in df.select("doc_id", "source", size.alias("n"), crc.alias("c"), h.alias("h")).collect():
        by_source[r.source].append((r.h, r.doc_id, r.c, r.n))
    placed = []
    for source, own in by_source.items():
        for k, x in enumerate(sorted(own)):
            placed.append((Fraction(2 * k + 1, 2 * len(own)), *x, (source is not None, source or ""), source))
    placed.sort(key=lambda x: x[:-1])
    want = [(x[2], x[-1]) for x in placed]
    assert [(r.doc_id, r.stratum) for r in sorted(rows, key=lambda r: r.position)] == want


def test_many_small_sources_share_no_task(spark):
    """Every source of one row has the rank 1/2; that rank is cut too, and the order stays."""
    df = spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text",
                                      "if(id < 2400, concat('one', id), if(id < 2800, concat('two', id div 2), 'large')) as source")
    rows = sharding.stratified_shards(df, 7, bucket_rows=64).collect()
    check_order(df, rows)
    frac = df.select((F.when(F.col("doc_id") < 2400, 0.5).otherwise(F.col("doc_id") / 3000)).alias("_f"),
                     F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("_h"))
    sizes = [r["count"] for r in sharding._rank_buckets(frac, 47, 64).groupBy("_fb").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 2 * 64


def test_shards_of_awkward_rows(spark):
    df = docs(spark)
    rows = sharding.stratified_shards(df, 3).collect()
    n = df.count()
    assert sorted(r.position for r in rows) == list(range(n))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.stratified_shards(docs(spark, [])).count() == 0


URLS = ["http://a.example.net/en/x?free=bets", "https://WWW.Example.com/de/1", "http://x.org/fr/", "http://x.org/fr",
        "http://x.org", None, "", "no scheme /en/", "http://casino-win.org/fr/a", "http://cheap-pills.com/x",
        "http://my.com/free/page", "http://sexton.com/adults", "http://a.com/free-FREE", "ftp://net/", "http://net",
        "://example.net/en/", "http://b.net:80/en/", "http://a.com/porn?x#y", "http://a.com/?win&prize",
        "http://a.com#b/casino", "x://y://z.net/q", "http://spam_farm.org/de/", "http://ÄXXX.com/xxx"]


def _brute(url):
    import re

    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fit = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = (url or "").translate({i: i + 32 for i in range(65, 91)})
    has = lambda t: re.findall(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)
    strict, soft = sum(len(has(t)) for t in urls.STRICT_TERMS), sum(bool(has(t)) for t in urls.SOFT_TERMS)
    own = "block" if strict or soft >= urls.MIN_SOFT else "allow"
    rule = max(fit, key=lambda f: len(f[0])) if fit else (None, own)
    return host, path, rule[0], rule[1], strict, soft


def test_urls(spark):
    rows = [(i, u, "h", "v") for i, u in enumerate(URLS)] + [(None, URLS[0], "h", "v"), (0, URLS[0], "h", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = Counter(tuple(r) for r in urls.judge_urls(df).collect())
    assert got == Counter((i, *_brute(u)) for i, u, _, _ in rows)
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_url_oracle(spark, tmp_path):
    import duckdb

    rows = [(i, u) for i, u in enumerate(URLS)]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    got = con.execute(f"select page_id, host, path, rule, verdict, n_strict, n_soft from ({urls.oracle_sql()}) order by 1").fetchall()
    assert got == [(i, *_brute(u)) for i, u in rows]
