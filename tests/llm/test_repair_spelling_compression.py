import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import compression, repair, spelling
from lexiframe.llm.common import fold as fold_col
from lexiframe.llm.queries import op11_conversation_repair
from tests.llm.util import LONG, UP, docs, fold

SF01 = "/root/testdata/sf0.01"

# ------------------------------------------------------------------ conversations

FILLED = re.compile(r"[^\x20\x09-\x0D]")
STATES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        c, t, r, x = (" " if v is None else str(v) for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        own = out[conv]
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            own += [(turn, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """Forward relaxation over automaton states; every candidate carries its messages."""
    def better(best, q, v):
        if q not in best or v[:2] < best[q][:2]:
            best[q] = v
            return True
        return False

    def insert(best):
        while any([better(best, STATES[q, x], (c + 5, a + "I", m + (role + ":",))) for q, (c, a, m) in list(best.items())
                   for x, role in (("u", "user"), ("a", "assistant")) if (q, x) in STATES]):
            pass
        return best

    best = insert({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for q, (c, a, m) in best.items():
            better(new, q, (c + 2, a + "D", m))
            if fault in ("blank", "duplicate"):
                continue
            c += 5 * (fault == "truncated")
            if (q, role[:1]) in STATES:
                better(new, STATES[q, role[:1]], (c, a + "K", m + (f"{role}:{text}",)))
            for x, other in (("u", "user"), ("a", "assistant")):
                if (q, x) in STATES:
                    better(new, STATES[q, x], (c + 1, a + "R", m + (f"{other}:{text}",)))
        best = insert(new)
    return min(best[q] for q in ("", "a") if q in best)


def plain_repair(rows):
    out = set()
    for conv, own in damage(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            chars = FILLED.findall(text)
            faults.append("blank" if not chars else "duplicate" if (role, text) in seen else
                          "truncated" if chars[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, faults)
        out.add((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                 hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for c in [*range(150), None]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t, t - 1, None, t * 2]),
                         rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]),
                         rng.choice(["a.", "b", "c!", "", " \t", None, "ends. ", "ä?"])))
    rows += rows[:30]  # repeated rows
    # a conversation with half of all rows, one with many equal rows
    rows += [(7777, t, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", "same.", f"{t}"])) for t in range(500)]
    return rows + [(8888, 1, "user", "hi.")] * 300 + [(8888, None, "system", "x.")] * 3 + [(9, 50, "user", LONG + ".")]


def run_repair(spark, rows):
    # a column that clashes with names inside
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, digest string")
    damaged = repair.damaged(df)
    plans = repair.repair_plans(damaged)
    return damaged, plans, repair.repair_digests(damaged, plans)


@pytest.mark.parametrize("segment, fan", [(256, 64), (3, 2)])
def test_repairs_equal_brute_force(spark, talks, monkeypatch, segment, fan):
    monkeypatch.setattr(repair, "SEGMENT", segment)  # conversations are cut and joined in rounds
    monkeypatch.setattr(repair, "FAN", fan)
    got = [tuple(r) for r in run_repair(spark, talks)[2].collect()]
    assert len(got) == len(set(got)) and set(got) == plain_repair(talks)


def test_agenda_equals_all_edit_strings():
    """Small cases against every string of edits, in order of cost and then ASCII."""
    rng = random.Random(2)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.choice((repair.NONE, repair.NONE, repair.BLANK, repair.DUPLICATE, repair.CUT)), 1)
                for _ in range(rng.randint(0, 3))]
        found = []
        for n in range(len(rows), len(rows) + 3):
            for letters in product("DIKR", repeat=n):
                if sum(x != "I" for x in letters) != len(rows):
                    continue
                left = list(rows)
                options = {("",)}  # initials that the edits can give
                cost, ok = 0, True
                shown = [""]
                for x in letters:
                    if x == "I":
                        cost += 5
                        shown = [s + y for s in shown for y in "ua"]
                        continue
                    initial, fault, _ = left.pop(0)
                    if x == "D":
                        cost += 2
                        continue
                    ok &= fault not in (repair.BLANK, repair.DUPLICATE)
                    cost += 5 * (fault == repair.CUT) + (x == "R")
                    shown = [s + y for s in shown for y in ("ua" if x == "R" else initial)]
                if ok and any(re.fullmatch("(s?(ua)+)?", s) for s in shown):
                    found.append((cost, "".join(letters)))
        # two insertions more than rows cannot be cheaper than deleting
        want = min(found)
        assert repair.lightest([repair.row_edges(*r) for r in rows], repair.START, repair.ACCEPTING) == want


def test_messages_and_empty_tables(spark, talks):
    damaged, plans, digests = run_repair(spark, talks)
    sha = {r.conv: r.repaired_sha256 for r in digests.collect()}
    lines = defaultdict(list)
    rows = repair.repaired_messages(damaged, plans).collect()
    for r in rows:
        if r.edit != "D":
            lines[r.conv].append((r.place, f"{r.role}:{r.text}"))
    for conv, want in sha.items():
        own = sorted(lines[conv])
        assert [p for p, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(x for _, x in own).encode()).hexdigest() == want
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for _, x in own))
    assert sum(r.edit != "I" for r in rows) == damaged.where("not dropped").count()
    assert run_repair(spark, [])[2].count() == 0
    gone = [(c, t, "user", "x.") for c in range(40) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:1]
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in run_repair(spark, gone)[2].collect()] == [(gone[0][0], 0, 0, 0, 0, 0, 0, "", none)]


def test_query_over_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op11_conversation_repair(spark, SF01)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {tuple(r) for r in got.collect()} == plain_repair(rows)


def test_rows_without_damage(spark):
    rows = repair.as_rows(spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")],
                                                "conv_id int, turn int, role string, text string"))
    assert [tuple(r) for r in repair.repair_plans(rows).collect()] == [(1, 0, 0, 0, 0, 0, 0, "KK")]


# ----------------------------------------------------------------------- spelling

def plain_near(words):
    near, by = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i] + "\0" + w[i + 1:]].add(w)
            if (d := w[:i] + w[i + 1:]) in words:
                near[w].add(d)
                near[d].add(w)
    for g in by.values():
        for w in g:
            near[w] |= g - {w}
    return near


def plain_variants(counts, ratio=5):
    near = plain_near(set(counts))
    form = {}
    for w, own in near.items():
        if own:
            b = min(own, key=lambda x: (-counts[x], x))
            if counts[b] >= ratio * counts[w]:
                form[w] = b

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near.get(w, ())), counts.get(form.get(w))) for w, n in counts.items()}


def plain_counts(rows):
    c = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            c[r[:h % len(r)] + r[h % len(r) + 1:] if h % 199 == 0 else r] += 1
    return {w: n for w, n in c.items() if n >= 5 and len(w) >= 6}


def test_acceptor_is_minimal_and_numbers_its_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    a = spelling.Acceptor(words)
    for n, w in enumerate(words):
        s, at = a.start, 0
        for c in w:
            s, add = a.arcs[s][c]
            at += add
        assert a.final[s] and at == n
    assert a.count[a.start] == len(words)

    def language(s):
        return frozenset([""] if a.final[s] else []) | {c + x for c, (t, _) in a.arcs[s].items() for x in language(t)}

    assert len({language(s) for s in range(len(a.final))}) == len(a.final)


def test_composition_equals_all_pairs():
    rng = random.Random(3)
    for size in (2, 40, 300):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(size)})
        got = list(spelling.Acceptor(words).one_edit())
        near = plain_near(set(words))
        assert len(got) == len({frozenset(p) for p in got})  # each pair once
        assert {frozenset((words[i], words[j])) for i, j in got} == {frozenset((w, x)) for w in words for x in near[w]}


@pytest.mark.parametrize("group", [20_000, 2])
def test_variants_equal_brute_force(spark, group):
    rng = random.Random(7)
    counts = {}
    for _ in range(1500):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(1, 8)))
        counts[w] = rng.choice([5, 6, 30, 160, 900, 5000, 40_000])
    long = "abc" * 900  # a very long word and its neighbours
    counts |= {long: 5, long + "d": 30, long[:-1]: 200, long[:700] + "x" + long[701:]: 5}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, best string")
    got = [tuple(r) for r in spelling.spelling_variants(df, group_words=group).collect()]
    assert len(got) == len(counts) and set(got) == plain_variants(counts)


def test_word_counts_and_query_rows(spark):
    many = ["Straße über ÉCOLE wordwordword wordwordwort"] * 300 + [None, "", "12 34", "x" * 40 + " " + "a×b÷c"]
    for frame in (docs(spark, many), docs(spark), docs(spark, [])):
        got = {(r.word, r.n) for r in spelling.word_counts(frame).collect()}
        assert got == set(plain_counts([(r.doc_id, r.text) for r in frame.collect()]).items())
    assert spelling.spelling_variants(spelling.word_counts(docs(spark, []))).count() == 0
    d = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {tuple(r) for r in spelling.spelling_variants(spelling.word_counts(d)).collect()}
    assert got == plain_variants(plain_counts([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]))


def test_long_texts_are_read_whole(monkeypatch):
    text = LONG + "Übung Ñandú \ud800 end"
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "_LONG_TEXT", 10)
    assert spelling.runs_of(text) == whole == Counter(r.translate(UP) for r in re.findall("[A-Za-zÀ-ÿ]+", text))
    assert set(spelling.runs_of(text, 6)) == {r for r in whole if len(r) >= 6}


# -------------------------------------------------------------------- compression

def _quality_rows(n, seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.randint(20, 300))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(ws) + "." if good else " ".join(w.upper() + "!!" for w in ws), int(good)))
    return rows


def _frames(spark, rows):
    d = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    return d, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")


def test_compression_tells_good_from_bad(spark):
    rows = _quality_rows(500)
    d, lab = _frames(spark, rows)
    model = compression.fit_compression(d, lab, fold_col(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r for r in compression.score_compression(d, model).collect()}
    held = [(i, y) for i, _, y in rows if fold(i, 5) == 0]
    assert len(held) > 60 and np.mean([got[i].predicted == y for i, y in held]) > 0.97
    bad, good, slope, intercept = model
    import zstandard

    def plain(data, text):  # the sizes by the library's plain interface
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False,
                                     write_dict_id=False)
        raw = text.encode()
        return sum(len(c.compress(raw[k:k + 1024])) for k in range(0, len(raw), 1024)), len(raw)

    for i, t, _ in rows[:40]:
        (b, n), (g, _) = plain(bad, t), plain(good, t)
        assert got[i].difference == pytest.approx((b - g) / n)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(slope * (b - g) / n + intercept))))
        assert got[i].predicted == (got[i].score >= 0.3)


def test_compression_awkward_rows(spark):
    d, lab = _frames(spark, _quality_rows(200))
    model = compression.fit_compression(d, lab.unionByName(lab.withColumn("quality", F.lit(None).cast("int"))), F.lit(True))
    out = compression.score_compression(docs(spark), model).collect()
    assert len(out) == docs(spark).count() and all(0 <= r.score <= 1 for r in out)
    empty = {r.score for r, t in zip(out, [r.text for r in docs(spark).collect()]) if not t}
    assert len(empty) == 1  # null and empty texts
    by_text = defaultdict(set)
    for r, t in zip(out, [r.text for r in docs(spark).collect()]):
        by_text[t].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert compression.score_compression(docs(spark, []), model).count() == 0


@pytest.mark.parametrize("quality, want", [([], 0.5), ([1, 1, 1], 4 / 5), ([0], 1 / 3)])
def test_compression_without_two_classes(spark, quality, want):
    lab = spark.createDataFrame([(i, q) for i, q in enumerate(quality)], "doc_id long, quality int")
    model = compression.fit_compression(docs(spark), lab, F.lit(True))
    assert {round(r.score, 9) for r in compression.score_compression(docs(spark), model).collect()} == {round(want, 9)}


def test_same_fit_with_repeated_ids(spark):
    """Conflicting labels count as the smallest; the order of rows does not matter."""
    rows = _quality_rows(120)
    d, lab = _frames(spark, rows)
    twice = d.unionByName(d.limit(30).withColumn("text", F.concat("text", F.lit(" more"))))
    clash = lab.unionByName(lab.where("doc_id < 20").withColumn("quality", F.lit(0)))
    one = compression.fit_compression(twice, clash, F.lit(True))
    two = compression.fit_compression(twice.orderBy(F.desc("doc_id")).repartition(7), clash.repartition(3), F.lit(True))
    assert one == two


def test_calibration_is_the_least_loss():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.6).astype(float)
    x = rng.normal(size=400) * 0.02 + 0.03 * y
    slope, intercept, loss = compression.fit_logistic(x, y)
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def mean_loss(a, b):
        s = a * x + b
        return (np.logaddexp(0, s) - t * s).mean()

    for da in (-1.0, 0.0, 1.0):
        for db in (-0.05, 0.0, 0.05):
            assert mean_loss(slope + da, intercept + db) >= mean_loss(slope, intercept) - 1e-6
    assert compression.fit_logistic(-x, y)[0] == 0.0


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_spelling_variants"])
def test_queries_equal_their_oracles(spark, name):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
    from check_oracle import compare, duck

    from lexiframe.llm import queries

    want = duck(SF01).execute(queries.oracle_sql()[name]).df()
    assert compare(queries.queries()[name](spark, SF01).toPandas(), want) == "OK"
