"""Conversation repair: the cheapest edits that make a conversation a system turn (or none) and pairs of user and assistant.

The lattice of a conversation has a node for each number of rows read and each state of the grammar: nothing said (0), after
the system (1), after a user (2), after an assistant (3). Keep, Rerole and Delete read a row, Insert does not. A
conversation ends with nothing said or after an assistant. The search runs from both ends: two heaps meet, and stop only when no further path can
be as cheap as the best one found, so that all cheapest crossings are known; of these the one whose audit (initials of the
edits in order) is least wins. Two audits that reach the same node at the same cost never begin one with the other,
since further edits that read no row cost more, so the least audit goes through least parts.

A conversation of over CHUNK rows is searched chunk by chunk: the cheapest edits from each state to each, joined at the cut by
the same rule, so the lattice in memory is that of a chunk.

Spark sorts the rows of each conversation behind each other; a task reads them as a stream, first without texts (the audits), then with
texts (the hash). Neither holds a conversation's rows, only its audit, which is part of the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.llm.common import WORD, table, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The state that a turn of each role initial leads to, by state.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {2: "user", 3: "assistant"}
#: Rows that one lattice holds.
CHUNK = 256
#: Rows of a conversation are (role initial, fault); faults in the order in which they count.
BLANK, DUPLICATE, CUT_OFF = "b", "d", "t"

Row = tuple[str, str]
Best = tuple[int, str]


def edits_of(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of the edits that read a row."""
    initial, fault = row
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    late = TRUNCATED if fault == CUT_OFF else 0
    if initial in STEPS[state]:
        yield "K", KEEP + late, STEPS[state][initial]
    for role, to in STEPS[state].items():
        if role != "s" and role != initial:
            yield "R", REROLE + late, to


def inserts(state: int) -> Iterator[int]:
    """Next states of an inserted turn."""
    return (to for role, to in STEPS[state].items() if role != "s")


def cheapest(rows: list[Row], start: int, end: int) -> Best | None:
    """Cost and least audit of the cheapest edits of rows from one state to another."""
    n = len(rows)
    back: list[list[tuple[str, int, int]]] = [[] for _ in range(4 * (n + 1))]
    ahead: list[list[tuple[str, int, int]]] = [[] for _ in range(4 * (n + 1))]
    for i in range(n + 1):
        for state in range(4):
            edges = [("I", INSERT, 4 * i + to) for to in inserts(state)]
            if i < n:
                edges += [(letter, cost, 4 * (i + 1) + to) for letter, cost, to in edits_of(rows[i], state)]
            for letter, cost, to in edges:
                ahead[4 * i + state].append((letter, cost, to))
                back[to].append((letter, cost, 4 * i + state))
    goal = 4 * n + end
    labels: tuple[dict[int, Best], dict[int, Best]] = ({start: (0, "")}, {goal: (0, "")})
    heaps = ([(0, 0, start)], [(0, 0, goal)])
    done: tuple[set[int], set[int]] = (set(), set())
    best: Best | None = (0, "") if start == goal else None
    while True:
        tops = [heap[0][0] if heap else None for heap in heaps]
        if tops[0] is None or tops[1] is None or best and tops[0] + tops[1] > best[0]:
            break
        side = 0 if tops[0] <= tops[1] else 1
        own, other, edges = labels[side], labels[1 - side], ahead if side == 0 else back
        _, _, at = heapq.heappop(heaps[side])
        if at in done[side]:
            continue
        done[side].add(at)
        cost, audit = own[at]
        for letter, price, to in edges[at]:
            new = (cost + price, audit + letter if side == 0 else letter + audit)
            if to not in done[side] and (to not in own or new < own[to]):
                own[to] = new
                # equal costs: rows in reading order, so that edits that cost nothing are followed to their end first
                heapq.heappush(heaps[side], (new[0], to // 4 if side == 0 else -(to // 4), to))
            if to in other:
                a, b = (own[to], other[to]) if side == 0 else (other[to], own[to])
                crossing = (a[0] + b[0], a[1] + b[1])
                best = crossing if best is None or crossing < best else best
    # labels of the side that stopped early can have become less since they were crossed
    for to, a in labels[0].items():
        if (b := labels[1].get(to)) and (a[0] + b[0], a[1] + b[1]) < (best or (1 << 60, "")):
            best = (a[0] + b[0], a[1] + b[1])
    return best


class Repair:
    """Cheapest edits of a conversation whose rows come one after the other."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.known: dict[int, Best] = {0: (0, "")}

    def add(self, row: Row) -> None:
        self.rows.append(row)
        if len(self.rows) > CHUNK:
            self._close(range(4))

    def _close(self, ends: range | tuple[int, ...]) -> None:
        found: dict[int, Best] = {}
        for start, (cost, audit) in self.known.items():
            for end in ends:
                part = cheapest(self.rows, start, end)
                if part and (end not in found or (cost + part[0], audit + part[1]) < found[end]):
                    found[end] = (cost + part[0], audit + part[1])
        self.rows, self.known = [], found

    def result(self) -> Best:
        self._close(ENDS)
        return min(self.known.values())


def turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired turns, from an audit and the rows that it was made for."""
    state = 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = STEPS[state][role[:1]]
        else:
            state = 3 if state == 2 else 2
            role = ROLES[state]
        yield role, text


# The table


def _crc(conv: Column, turn: Column) -> Column:
    return F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage (op13's contract); a null text or role is one space."""
    role, text, h = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("h")
    out = rows.withColumn("h", _crc(F.col("conv_id"), F.col("turn"))).filter("h > 0")
    new = F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.sequence(F.lit(1), F.when(h == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), new.alias("text"), copies.alias("copy")).drop("copy")


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text; no nulls but in conv_id and turn) with its faults and repair.

    Rows are taken by turn, nulls first, equal turns by role and hash of the text. A null conv_id is a conversation of
    its own.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    marks = F.regexp_extract(F.col("text"), f"({WORD})[\\x20\\x09-\\x0D]*\\z", 1)
    keyed = rows.withColumn("digest", digest).withColumn("last", marks)
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("last") == "", BLANK).when(seen > 1, DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT_OFF).otherwise("")
    light = keyed.drop("text").withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    light = light.select("conv_id", "turn", "role", "digest", "initial", "fault").repartition("conv_id").sortWithinPartitions("conv_id", *order, F.col("fault") == DUPLICATE)
    audits = written(light.select("conv_id", "turn", "initial", "fault").mapInArrow(_audits, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"), "audits")
    first = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    both = first.unionByName(keyed.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text"))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order)
    hashes = both.select("conv_id", "kind", "role", "text").mapInArrow(_hashes, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    h = hashes.select(F.col("conv_id").alias("h_id"), "repaired_sha256")
    return audits.join(h, audits["conv_id"].eqNullSafe(h["h_id"])).drop("h_id")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults, cost and audit of each conversation of sorted rows (conv_id, turn, initial, fault)."""
    kind, out = None, []
    conv, repair, n, low, last, distinct, faults, illegal, before = None, None, 0, None, None, 0, {}, 0, None

    def row() -> tuple:
        cost, audit = repair.result()
        gaps = last - low + 1 - distinct if distinct else 0
        return conv, gaps, faults.get(BLANK, 0), faults.get(DUPLICATE, 0), faults.get(CUT_OFF, 0), illegal, cost, audit

    def batch() -> pa.RecordBatch:
        names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        types = (kind, *[pa.int64()] * 6, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def watch() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for b in batches:
            kind = b.schema.field("conv_id").type
            yield b

    for c, turn, initial, fault in _rows_of(watch()):
        if repair is None or c != conv:
            if repair is not None:
                out.append(row())
                if len(out) >= 1000:
                    yield batch()
                    out = []
            conv, repair, n, low, last, distinct, faults, illegal, before = c, Repair(), 0, None, None, 0, {}, 0, None
        if turn is not None and (last is None or turn != last):
            low, last, distinct = turn if low is None else low, turn, distinct + 1
        illegal += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
        faults[fault] = faults.get(fault, 0) + 1
        repair.add((initial, fault))
    if repair is not None:
        out.append(row())
    if out:
        yield batch()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the repaired turns of each conversation of sorted rows (conv_id, kind, role, text); the audit comes first."""
    from itertools import groupby

    kind = None

    def watch() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for b in batches:
            kind = b.schema.field("conv_id").type
            yield b

    out: list[tuple] = []
    for conv, rows in groupby(_rows_of(watch()), key=lambda r: r[0]):
        audit, h, sep = next(rows)[3], sha256(), b""
        for role, text in turns(audit, ((r[2], r[3]) for r in rows)):
            h.update(sep + f"{role}:{text}".encode())
            sep = b"\n"
        out.append((conv, h.hexdigest()))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out])], ["conv_id", "repaired_sha256"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out])], ["conv_id", "repaired_sha256"])


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and repair of every conversation after damage.

    Null conv_id, turn, role and text count as one space in the damage; a null conv_id is a conversation of its own. A conversation without rows
    after damage has zeros, an empty audit and the hash of the empty text; an empty table gives no rows. Other columns are not read.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repaired(damaged(rows)).withColumnRenamed("conv_id", "f_id")
    ids = rows.select("conv_id").distinct()
    out = ids.join(found, ids["conv_id"].eqNullSafe(found["f_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
