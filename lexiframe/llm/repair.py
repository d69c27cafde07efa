"""Conversation structure repair as a lightest derivation (Knuth's generalisation of Dijkstra's algorithm).

A conversation is repaired by edits to its rows in order: keep (cost 0), rerole to user or assistant (1), delete (2,
required for blank and duplicate rows), insert an empty user or assistant row anywhere (5); a truncated row that
stays costs 5 more.  The roles' initials must become ``(s?(ua)+)?``.  Of the cheapest edits the audit (their initials
in order) that is least in ASCII wins.

Items and deductions: ``(i, q)`` says that rows ``i..`` can be repaired from state ``q`` of the automaton of that
pattern.  Its weight is ``(cost, audit)``.  An edit of row ``i - 1`` or an insertion derives an earlier item from a
later one and puts its initial before the audit; the items after the last row are axioms.  A heap pops the
lightest item, which is then final, until the goal ``(0, start)`` is popped.  Keeping a row costs nothing, and putting
a letter before a string can make it smaller, so ``(cost, audit)`` alone would not be superior (a popped item could
still improve); the agenda is ordered by ``(cost, rows covered, audit)``, in which every deduction's result is above its
antecedents, and which orders the derivations of one item as ``(cost, audit)`` does.

Long conversations: an item ``(i..j, p, q)`` over a *segment* of rows has the same weights; two neighbouring segments
derive one, audits joined.  This is monotone in both: audits of one segment with equal costs are never one the
beginning of the other, because more insertions cost more.  So a conversation of any length is cut into segments
of ``SEGMENT`` rows in order, solved for all pairs of states where they stand, and joined ``FAN`` at a time in rounds; no
task holds a conversation's rows.  Segments come from range partitions over ``(conversation, turn, role, text
digest)``, whose bounds cut a hot conversation anywhere; rows equal in all of these are one row with a count.
Duplicates are found by an aggregate over text digests and a join that Spark splits when it is skewed.  Texts
are read twice (digest, repair) and shuffled once, to be put in order for the repaired messages; that pass
streams, and holds one row and one audit at a time.

Defined results: rows are ordered by turn (nulls first), then role, then text digest; equal rows are the first and
its duplicates; a null id is a conversation like others; null roles and texts count as one space (as the contract's
damage has it); a conversation without rows left has zeros, an empty audit and no messages; texts of any length are
handled whole; an empty table has an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.rows import explode_rows
from lexiframe.llm.common import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SEGMENT, FAN = 256, 64
START, SYSTEM, USER, ASSISTANT = range(4)
#: Automaton of ``(s?(ua)+)?``: initial -> {state before: state after}.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ACCEPTING = (START, ASSISTANT)
NONE, BLANK, DUPLICATE, CUT = range(4)  # a row's first fault
_LEGAL = {"su", "ua", "au"}
_SPACE = r"\x20\x09-\x0D"
_ROWS_OUT = 5_000

#: An edge over one position: (state before, state after, cost, audit).
Edge = tuple[int, int, int, str]


# -------------------------------------------------------------------- agenda

def row_edges(initial: str, fault: int, copies: int = 1) -> list[Edge]:
    """Edits of a row that comes ``copies`` times: every copy but the first is a duplicate (or all are blank)."""
    out = [(q, q, DELETE * copies, "D" * copies) for q in range(4)]
    if fault not in (BLANK, DUPLICATE):
        rest, more = "D" * (copies - 1), DELETE * (copies - 1) + (TRUNCATED if fault == CUT else 0)
        out += [(p, q, KEEP + more, "K" + rest) for p, q in STEPS.get(initial, {}).items()]
        out += [(p, q, REROLE + more, "R" + rest) for x in "ua" for p, q in STEPS[x].items()]
    return out


def lightest(positions: list[list[Edge]], start: int, ends: tuple[int, ...], insert: bool = True) -> tuple[int, str] | None:
    """The lightest ``(cost, audit)`` from ``start`` before the first position to one of ``ends`` after the last."""
    n = len(positions)
    heap = [(0, 0, "", q) for q in ends]  # cost, positions covered, audit, state
    done: set[tuple[int, int]] = set()
    into: list[dict[int, list[Edge]]] = []
    for edges in positions:
        by: dict[int, list[Edge]] = {}
        for e in edges:
            by.setdefault(e[1], []).append(e)
        into.append(by)
    inserts = [(p, q) for x in "ua" for p, q in STEPS[x].items()] if insert else []
    while heap:
        cost, covered, audit, q = heapq.heappop(heap)
        if (covered, q) in done:
            continue
        if covered == n and q == start:
            return cost, audit
        done.add((covered, q))
        for p, after in inserts:
            if after == q and (covered, p) not in done:
                heapq.heappush(heap, (cost + INSERT, covered, "I" + audit, p))
        if covered < n:
            for p, _, c, letters in into[n - 1 - covered].get(q, ()):
                if (covered + 1, p) not in done:
                    heapq.heappush(heap, (cost + c, covered + 1, letters + audit, p))
    return None


def segment_edges(rows: list[tuple[str, int, int]], starts: tuple[int, ...] = (0, 1, 2, 3)) -> list[Edge]:
    """The items of a segment of ``(initial, fault, copies)`` rows: the lightest edits for each pair of states."""
    positions = [row_edges(*r) for r in rows]
    found = ((p, q, lightest(positions, p, (q,))) for p in starts for q in range(4))
    return [(p, q, *w) for p, q, w in found if w is not None]


def join_edges(segments: list[list[Edge]]) -> list[Edge]:
    """The items of neighbouring segments in order."""
    if len(segments) == 1:
        return segments[0]
    found = ((p, q, lightest(segments, p, (q,), insert=False)) for p in range(4) for q in range(4))
    return [(p, q, *w) for p, q, w in found if w is not None]


# -------------------------------------------------------------------- tables

def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, dropped)``: the rows with the damage of their own ``crc32('conv:turn') % 20``."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    new_text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(name[3], ".!?", "")).otherwise(name[3])
    new_role = F.when(kind == 4, F.lit("user")).otherwise(name[2])
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), new_role.alias("role"), new_text.alias("text"),
                      (kind == 0).alias("dropped"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(
                          F.array(F.lit(0))).alias("_times"))
    return explode_rows(out, F.col("_times"), "_time", "conv", "turn", "role", "text", "dropped").drop("_time")


def as_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, dropped)`` without damage."""
    blank = F.lit(" ")
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
                       F.coalesce(F.col(text), blank).alias("text"), F.lit(False).alias("dropped"))


def _digest() -> Column:
    return F.when(~F.col("dropped"), F.md5(F.col("text").cast("binary")))


def faults(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, digest, fault, copies)``: distinct rows in no order, ``copies`` of each (0: dropped, which
    only says that the conversation exists)."""
    filled, ended = F.col("text").rlike(f"[^{_SPACE}]"), F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    own = F.when(F.col("dropped"), NONE).when(~filled, BLANK).when(~ended, CUT).otherwise(NONE)
    role = F.when(~F.col("dropped"), F.col("role"))
    one = (rows.select("conv", F.when(~F.col("dropped"), F.col("turn")).alias("turn"), role.alias("role"),
                       _digest().alias("digest"), own.alias("fault"), F.when(F.col("dropped"), 0).otherwise(1).alias("_c"))
           .groupBy("conv", "turn", "role", "digest", "fault").agg(F.sum("_c").alias("copies")))
    one = materialize(one, "repair-rows")
    # the first turn of a message that several turns of a conversation repeat (a null turn comes first)
    at = F.struct(F.col("turn").isNotNull().alias("k"), "turn")
    again = (one.where(F.col("digest").isNotNull()).groupBy("conv", "role", "digest")
             .agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
             .select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "_first"))
    same = (F.col("digest") == F.col("_digest")) & (F.col("role") == F.col("_role")) & F.col("conv").eqNullSafe(F.col("_conv"))
    later = F.col("_first").isNotNull() & ~at.eqNullSafe(F.col("_first")) & (F.col("fault") != BLANK)
    return one.join(again, same, "left").select("conv", "turn", "role", "digest", "copies",
                                                F.when(later, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENT_TYPE = ("part int, seg int, whole boolean, n long, " + ", ".join(f"{c} long" for c in _COUNTS)
                 + ", first_turn long, last_turn long, low long, first string, last string, "
                   "edges array<struct<p:int,q:int,cost:long,audit:string>>")
_FIELDS = [f.strip().split(" ")[0] for f in _SEGMENT_TYPE.split(", ")]


def _summary(rows: list[tuple[int | None, str, int, int]]) -> dict:
    """Counts of ``(turn, initial, fault, copies)`` rows in order."""
    d = dict.fromkeys(("n", *_COUNTS), 0)
    last_turn, low, before = None, None, None
    for turn, initial, fault, copies in rows:
        d["n"] += copies
        d["blank"] += copies if fault == BLANK else 0
        d["duplicate"] += copies if fault == DUPLICATE else 0 if fault == BLANK else copies - 1
        d["truncated"] += fault == CUT
        d["illegal"] += copies - 1 + (before is not None and before + initial not in _LEGAL)
        before = initial
        if turn is not None and turn != last_turn:
            d["turns"] += 1
            last_turn = turn
            low = turn if low is None else low
    return d | {"first_turn": rows[0][0] if rows else None, "last_turn": last_turn, "low": low,
                "first": rows[0][1] if rows else None, "last": before}


def _joined(parts: list[dict]) -> dict:
    """The summary and edges of neighbouring segments in order."""
    filled = [x for x in parts if x["n"]]
    if not filled:
        return parts[0]
    out = dict(filled[0])
    for x in filled[1:]:
        for c in ("n", *_COUNTS):
            out[c] += x[c]
        out["illegal"] += out["last"] + x["first"] not in _LEGAL
        # the same turn on both sides is one
        out["turns"] -= x["low"] is not None and x["first_turn"] is not None and x["first_turn"] == out["last_turn"]
        out["low"] = x["low"] if out["low"] is None else out["low"]
        out["last_turn"] = out["last_turn"] if x["last_turn"] is None else x["last_turn"]
        out["last"] = x["last"]
    out["edges"] = join_edges([x["edges"] for x in filled])
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _schema(conv_type: pa.DataType) -> pa.Schema:
    edge = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [(f.strip().split(" ")[0], kinds.get(f.strip().split(" ")[1], pa.list_(edge))) for f in
              _SEGMENT_TYPE.split(", ")]
    return pa.schema([("conv", conv_type), *fields])


def _row(conv, part: int, seg: int, whole: bool, d: dict) -> tuple:
    edges = [dict(zip(("p", "q", "cost", "audit"), e)) for e in d["edges"]]
    return (conv, part, seg, whole, *[d[f] for f in _FIELDS[3:-1]], edges)


def segments(rows: DataFrame) -> DataFrame:
    """Solved segments of the rows of ``faults``: whole conversations, or pieces of those that a partition's border or
    the length of a segment cuts (``part`` and ``seg`` give their order)."""
    kind, keys = rows.schema["conv"].dataType.simpleString(), ("conv", "turn", "role", "digest")
    rows = materialize(rows, "repair-faults")  # the range bounds are sampled from the rows that are then dealt
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
             .select("conv", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), "fault", "copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, schema, out = TaskContext.get().partitionId(), None, []
        # edge: the partition's first conversation may have begun elsewhere
        conv, seg, own, edge, begun = None, 0, [], True, False

        def solve(whole: bool) -> None:
            d = _summary(own)
            if whole:
                best = lightest([row_edges(*r[1:]) for r in own], START, ACCEPTING)
                d["edges"] = [(START, START, *best)]
            else:
                d["edges"] = segment_edges([r[1:] for r in own])
            out.append(_row(conv, part, seg, whole, d))

        for b in batches:
            schema = schema or _schema(b.schema.field(0).type)
            for c, turn, initial, fault, copies in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if begun and c != conv:
                    solve(not edge and seg == 0)
                    seg, own, edge = 0, [], False
                elif len(own) == SEGMENT:
                    solve(False)
                    seg, own = seg + 1, []
                conv, begun = c, True
                if copies:
                    own.append((turn, initial, fault, copies))
            if len(out) >= _ROWS_OUT:
                yield _batch(out, schema)
                out.clear()
        if schema is not None:  # the partition's last conversation may go on elsewhere
            solve(False)
            yield _batch(out, schema)

    return dealt.mapInArrow(run, f"conv {kind}, {_SEGMENT_TYPE}")


def repair_plans(rows: DataFrame) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)`` for each conversation of ``(conv, turn,
    role, text, dropped)`` rows."""
    kind = rows.schema["conv"].dataType.simpleString()
    solved = materialize(segments(faults(rows)), "repair-segments")
    ends = solved.agg(F.max("part").alias("p"), F.max("seg").alias("s")).first()
    whole, pieces = solved.where("whole"), solved.where("not whole")
    width = (ends["s"] or 0) + 1
    pieces = pieces.withColumn("_at", F.col("part").cast("long") * width + F.col("seg"))
    most = ((ends["p"] or 0) + 1) * width  # places that can be taken; each round joins FAN neighbours

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = _schema(b.schema.field(0).type)
            out = []
            for conv, at, group in zip(*[b.column(i).to_pylist() for i in range(3)]):
                parts = [x | {"edges": [(e["p"], e["q"], e["cost"], e["audit"]) for e in x["edges"]]} for x in group]
                out.append(_row(conv, 0, 0, False, _joined(parts)) + (at,))
            yield _batch(out, schema.append(pa.field("_at", pa.int64())))

    while True:
        group = F.struct("_at", *_FIELDS)
        pieces = (pieces.groupBy("conv", F.floor(F.col("_at") / FAN).alias("_to")).agg(F.sort_array(F.collect_list(group)).alias("g"))
                  .select("conv", "_to", "g").mapInArrow(join, f"conv {kind}, {_SEGMENT_TYPE}, _at long"))
        most = -(-most // FAN)
        if most <= 1:
            break
    every = whole.unionByName(pieces.drop("_at"))
    best = F.array_min(F.transform(F.filter("edges", lambda e: (e["p"] == START) & e["q"].isin(*ACCEPTING)),
                                   lambda e: F.struct(e["cost"].alias("cost"), e["audit"].alias("audit"))))
    gaps = F.coalesce(F.col("last_turn") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return every.select("conv", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                        best.alias("_b")).select("*", F.col("_b.cost").alias("cost"), F.col("_b.audit").alias("audit")).drop("_b")


# ------------------------------------------------------------------- repairs

def _with_audits(rows: DataFrame, plans: DataFrame, *keep: str) -> DataFrame:
    """Every conversation's audit and then its rows in order, a partition for whole conversations."""
    kept = rows.where(~F.col("dropped")).select("conv", F.lit(1).alias("k"), "turn", "role", _digest().alias("digest"), "text")
    empty = F.lit(None).cast("string")
    heads = plans.select("conv", F.lit(0).alias("k"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                         empty.alias("role"), empty.alias("digest"), F.col("audit").alias("text"), *keep)
    every = heads.unionByName(kept, allowMissingColumns=True)
    return (every.repartition("conv").sortWithinPartitions("conv", "k", "turn", "role", "digest")
            .select("conv", "k", "role", "text", *keep))


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, str, str, str]]:
    """``(head, edit, role, text)`` of every conversation in a partition: first its head row (edit ``""``), then its
    edits; deleted rows come with their own role."""
    audit, at, parity = "", 0, 0

    def inserted() -> Iterator[tuple[None, str, str, str]]:
        nonlocal at, parity
        while at < len(audit) and audit[at] == "I":
            yield None, "I", ("user", "assistant")[parity], ""
            at, parity = at + 1, 1 - parity

    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for conv, k, role, text, *keep in zip(*cols):
            if k == 0:
                yield from inserted()
                audit, at = text, 0
                # rows that stay: an odd number begins with a system row
                parity = -1 if (len(audit) - audit.count("D")) % 2 else 0
                yield (conv, *keep), "", "", audit
            else:
                yield from inserted()
                edit = audit[at]
                at += 1
                if edit == "D":
                    yield None, "D", role, text
                else:
                    yield None, edit, ("user", "assistant")[parity] if edit == "R" else role, text
                    parity = 0 if parity < 0 else 1 - parity
    yield from inserted()


def repaired_messages(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv, place, edit, role, text)``: each repaired conversation's messages in order (``place`` from 0), and the
    deleted rows without a place."""
    dealt = _with_audits(rows, plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, conv, place, size = None, [], None, 0, 0

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = kind or b.schema.field(0).type
                yield b

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (kind, pa.int64(), pa.string(), pa.string(), pa.string()))],
                names=["conv", "place", "edit", "role", "text"])

        for head, edit, role, text in _messages(typed()):
            if head:
                conv, place = head[0], 0
                continue
            out.append((conv, None if edit == "D" else place, edit, role, text))
            place += edit != "D"
            size += len(text)
            if len(out) >= _ROWS_OUT or size > 1 << 24:
                yield flush()
                size = 0
        if out:
            yield flush()

    kind = rows.schema["conv"].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")


def repair_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with ``repaired_sha256``: the digest of each conversation's repaired ``role:text`` lines, taken as the
    messages stream by."""
    names = [c for c in plans.columns if c != "conv"]
    dealt = _with_audits(rows, plans, *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, head, digest, first = None, [], None, None, True

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for b in batches:
                schema = schema or pa.schema([b.schema.field(0), *[b.schema.field(i) for i in range(4, b.num_columns)],
                                              pa.field("repaired_sha256", pa.string())])
                yield b

        def flush() -> pa.RecordBatch:
            batch = _batch(out, schema)
            out.clear()
            return batch

        for own, edit, role, text in _messages(typed()):
            if own:
                if head:
                    out.append((*head, digest.hexdigest()))
                    if len(out) >= _ROWS_OUT:
                        yield flush()
                head, digest, first = own, hashlib.sha256(), True
            elif edit != "D":
                digest.update(("" if first else "\n").encode() + f"{role}:".encode("utf-8", "surrogatepass"))
                digest.update(text.encode("utf-8", "surrogatepass"))
                first = False
        if head:
            out.append((*head, digest.hexdigest()))
        if out:
            yield flush()

    kinds = ", ".join(f"`{c}` {plans.schema[c].dataType.simpleString()}" for c in ("conv", *names))
    return dealt.mapInArrow(run, f"{kinds}, repaired_sha256 string")
