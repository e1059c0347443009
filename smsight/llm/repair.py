"""Repair of conversations: the cheapest edits that make roles alternate, found by Hirschberg's divide and conquer.

A repaired conversation is empty, or has an optional system turn and then user and assistant in turn. Four states say what
has been given so far: nothing, a system turn, a user turn, an assistant turn. Every row is kept (cost 0), given the role that
is due (1, ``R``) or deleted (2); empty turns may be inserted anywhere (5). Blank and repeated rows have to be deleted; a
truncated row that stays adds 5. Of equally cheap edits the audit, the initials of the edits in order, decides.

1. Spark counts identical rows, finds the first of equal role and text in each conversation, and deals the rows out by ranges
   of (conversation, turn, role, text digest), so that a long conversation spans several tasks. Texts stay behind.
2. A row is a matrix of four states by four, of cost and rank: the rank orders the audits of the cheapest ways from one state.
   No audit of some rows begins another one of the same rows (each row's own edit comes last), so ranks decide ties without
   any string, and matrices of pieces of up to PIECE rows are made from those of their rows.
3. Hirschberg's step: the forward vector (cost and rank) of the first half meets the backward cost vector of the second half;
   of the cheapest crossings the one of least rank is taken, and both halves are solved alike. This is done first over the
   pieces of a conversation, then inside every piece, each in linear space.
4. Texts are joined to the rows that stay.

Defined results: a null role or text is one space; rows of null turns come first, ties in the order of role, then SHA-256 of
the text; rows of a null conversation form one conversation; the role's initial is its first character; an empty table gives
empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smsight.llm.frames import Scratch
from smsight.llm.words import slices

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
DUE = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the state that an inserted or reroled turn leads to
NAMES = {USER: "user", ASSISTANT: "assistant"}
TAIL = {EMPTY: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}  # turns to insert at the end
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
PIECE = 1 << 14
WHITE = " \t\n\x0b\x0c\r"

Matrix = list[list[tuple[int, int] | None]]  # [from][to]: cost and rank among the ways from that state


def _ways(initial: str, truncated: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest letters, of those the least, that lead from state to state over one row."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, inserts in product(STATES, range(3)):
        at = start
        for _ in range(inserts):
            at = DUE[at]
        kept = SYSTEM if at == EMPTY and initial == "s" else DUE[at] if initial == INITIALS[DUE[at] - 1] else None
        for letter, to, cost in (("K", kept, KEEP + TRUNCATED * truncated), ("R", DUE[at], REROLE + TRUNCATED * truncated), ("D", at, DELETE)):
            if to is not None:
                way = (cost + INSERT * inserts, "I" * inserts + letter)
                best[start, to] = min(best.get((start, to), way), way)
    return best


def _ranked(ways: dict[tuple[int, int], tuple[int, object]]) -> Matrix:
    out: Matrix = [[None] * 4 for _ in STATES]
    for start in STATES:
        own = sorted((order, to) for (a, to), (_, order) in ways.items() if a == start)
        for rank, (_, to) in enumerate(own):
            out[start][to] = (ways[start, to][0], rank)
    return out


WAYS = {(i, t): _ways(i, t) for i, t in product("sua?", (False, True))}
ROWS = {key: _ranked(ways) for key, ways in WAYS.items()}


def deletions(n: int) -> Matrix:
    """``n`` rows that all have to go."""
    return [[(DELETE * n, 0) if a == b else None for b in STATES] for a in STATES]


def forward(items: list[Matrix], start: int) -> list[tuple[int, int] | None]:
    """Cost and rank of the cheapest ways from ``start`` over the items to each state."""
    at: list[tuple[int, int] | None] = [(0, 0) if s == start else None for s in STATES]
    for item in items:
        reach: list[tuple[int, int, int] | None] = [None] * 4
        for s in STATES:
            if at[s] is not None:
                cost, rank = at[s]
                for t, step in enumerate(item[s]):
                    if step is not None:
                        way = (cost + step[0], rank, step[1])
                        if reach[t] is None or way < reach[t]:
                            reach[t] = way
        order = sorted(x[1:] for x in reach if x is not None)
        at = [None if x is None else (x[0], order.index(x[1:])) for x in reach]
    return at


def backward(items: list[Matrix], end: int) -> list[float]:
    """Cost of the cheapest way over the items from each state to ``end``."""
    at = [0 if s == end else float("inf") for s in STATES]
    for item in reversed(items):
        at = [min((step[0] + at[t] for t, step in enumerate(item[s]) if step is not None), default=float("inf")) for s in STATES]
    return at


def crossings(items: list[Matrix], start: int, end: int) -> list[int]:
    """The state behind every item on the way from ``start`` to ``end`` that is cheapest and, of those, has the least audit."""
    if len(items) == 1:
        return [end]
    half = len(items) // 2
    first, second = forward(items[:half], start), backward(items[half:], end)
    meet = min((f[0] + second[s], f[1], s) for s, f in enumerate(first) if f is not None)[2]
    return crossings(items[:half], start, meet) + crossings(items[half:], meet, end)


def summary(items: list[Matrix]) -> Matrix:
    return [forward(items, s) for s in STATES]


def _pack(matrix: Matrix) -> list[int]:
    return [x for row in matrix for step in row for x in (step or (-1, -1))]


def _unpack(flat: list[int]) -> Matrix:
    steps = [None if flat[i] < 0 else (flat[i], flat[i + 1]) for i in range(0, 32, 2)]
    return [steps[i:i + 4] for i in range(0, 16, 4)]


def _items(row: dict) -> tuple[list[Matrix], list[tuple[int, str, int]]]:
    """Matrices of a piece, and for each its entry, letter class and number of rows."""
    items, of = [], []
    for k, (code, n) in enumerate(zip(row["codes"], row["times"])):
        if code[0] != "D":
            items.append(ROWS[code[0], code[1] == "t"])
            of.append((k, code, 1))
            n -= 1
        if n:
            items.append(deletions(n))
            of.append((k, "D", n))
    return items, of


def faults(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct rows (conv_id, turn, role, digest) with text, how often they stand there, and whether blank or truncated."""
    space = F.lit(" ")
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                                F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
                                F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    grouped = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).groupBy("conv_id", "turn", "role", "digest").agg(
        F.count(F.lit(1)).alias("times"), F.first("text").alias("text"))
    return grouped.withColumn("bare", F.rtrim(F.col("text"), F.lit(WHITE))).select(
        "*", (F.col("bare") == "").alias("blank"), (~F.right(F.col("bare"), F.lit(1)).isin(".", "!", "?")).alias("truncated")).drop("bare")


def _same(*columns: str) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return condition


PIECES = ("conv_id {kind}, piece bigint, turns array<bigint>, roles array<string>, digests array<binary>, codes array<string>, times array<bigint>, "
          "inside bigint, head string, foot string, matrix array<bigint>")


def _pieces(entries: DataFrame, kind: str) -> DataFrame:
    """Rows of a conversation in order, up to PIECE at a time, with the matrix of all of them."""
    order = ["conv_id", "turn", "role", "digest"]
    dealt = entries.repartitionByRange(*order).sortWithinPartitions(*order)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        here, held = None, []

        def made() -> pa.RecordBatch:
            row = {k: [r[k] for r in held] for k in ("turn", "role", "digest", "code", "times")}
            row["codes"] = row["code"]
            roles = [r["role"][:1] for r in held for _ in range(min(2, r["times"]))]
            inside = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:])) + sum(r["times"] - 2 for r in held if r["times"] > 2)
            matrix = _pack(summary(_items(row)[0]))
            return pa.record_batch({
                "conv_id": pa.array([here], batch.schema.field("conv_id").type), "piece": pa.array([number], pa.int64()),
                "turns": pa.array([row["turn"]], pa.list_(pa.int64())), "roles": pa.array([row["role"]], pa.list_(pa.string())),
                "digests": pa.array([row["digest"]], pa.list_(pa.binary())), "codes": pa.array([row["code"]], pa.list_(pa.string())),
                "times": pa.array([row["times"]], pa.list_(pa.int64())), "inside": pa.array([inside], pa.int64()),
                "head": pa.array([roles[0]]), "foot": pa.array([roles[-1]]), "matrix": pa.array([matrix], pa.list_(pa.int64()))})

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and (row["conv_id"] != here or len(held) == PIECE):
                    out.append(made())
                    number, held = number + 1, []
                here = row["conv_id"]
                held.append(row)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if held:
            yield made()

    return dealt.mapInArrow(gather, PIECES.format(kind=kind))


CROSSED = "conv_id {kind}, piece bigint, part int, begin int, finish int, tail int, illegal bigint, cost bigint"


def _crossed(pieces: DataFrame, kind: str) -> DataFrame:
    """States before and behind every piece; the last piece of a conversation has its cost and its pairs of roles out of order."""
    small = pieces.select("conv_id", "piece", "inside", "head", "foot", "matrix")
    dealt = small.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def solved() -> list[dict]:
            items = [_unpack(r["matrix"]) for r in held]
            ends = forward(items, EMPTY)
            cost, _, last = min((f[0] + INSERT * TAIL[s], f[1], s) for s, f in enumerate(ends) if f is not None)
            states = crossings(items, EMPTY, last)
            illegal = sum(r["inside"] for r in held) + sum(a["foot"] + b["head"] not in LEGAL for a, b in zip(held, held[1:]))
            rows = [{"conv_id": here, "piece": r["piece"], "part": k, "begin": states[k - 1] if k else EMPTY, "finish": states[k],
                     "tail": 0, "illegal": None, "cost": None} for k, r in enumerate(held)]
            rows[-1] |= {"tail": TAIL[last], "illegal": illegal, "cost": cost}
            return rows

        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), ("piece", pa.int64()), ("part", pa.int32()), ("begin", pa.int32()),
                                ("finish", pa.int32()), ("tail", pa.int32()), ("illegal", pa.int64()), ("cost", pa.int64())])
            out = []
            for row in batch.to_pylist():
                if held and row["conv_id"] != here:
                    out += solved()
                    held = []
                here = row["conv_id"]
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(solved(), schema)

    return dealt.mapInArrow(solve, CROSSED.format(kind=kind))


EDITS = "conv_id {kind}, part int, place int, edit string, times bigint, new_role string, turn bigint, role string, digest binary"


def _edits(solved: DataFrame, kind: str) -> DataFrame:
    """One row for every edit, in order of (part, place); a stretch of deleted copies is one row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), ("part", pa.int32()), ("place", pa.int32()), ("edit", pa.string()), ("times", pa.int64()),
                                ("new_role", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())])
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                items, of = _items(row)
                out, state = [], row["begin"]

                def add(edit, role, entry=None, times=1):
                    out.append((row["conv_id"], row["part"], len(out), edit, times, role,
                                *((row[c][entry] for c in ("turns", "roles", "digests")) if entry is not None else (None,) * 3)))

                for (entry, code, n), to in zip(of, crossings(items, state, row["finish"])):
                    letters = "D" if code == "D" else WAYS[code[0], code[1] == "t"][state, to][1]
                    for letter in letters:
                        if letter == "I":
                            state = DUE[state]
                            add("I", NAMES[state])
                        elif letter == "D":
                            add("D", None, entry, n)
                        else:
                            add(letter, row["roles"][entry] if letter == "K" else NAMES[to], entry)
                    state = to
                for _ in range(row["tail"]):
                    state = DUE[state]
                    add("I", NAMES[state])
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    columns = ["conv_id", "part", "begin", "finish", "tail", "turns", "roles", "digests", "codes", "times"]
    return solved.select(*columns).mapInArrow(work, EDITS.format(kind=kind))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Edits (conv_id, part, place, edit, times, role, text, turn) in order of part and place, and a report on each conversation.

    The edit is K, R, D or I; ``times`` identical deleted rows are one edit; role and text are those of the repaired turn, null
    where it is deleted. The report: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    """
    spark = conversations.sparkSession
    scratch, result = Scratch(spark), Scratch(spark)
    rows = scratch.keep(faults(conversations, conv_col, turn_col, role_col, text_col), "rows")
    kind = rows.schema["conv_id"].dataType.simpleString()
    slim = rows.drop("text")
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"))
    marked = slim.alias("x").join(first.alias("y"), _same("conv_id", "role", "digest")).select(
        "x.*", F.col("x.turn").eqNullSafe(F.col("y.first.turn")).alias("leads"))
    stays = F.col("leads") & ~F.col("blank")
    initial = F.when(F.left("role", F.lit(1)).isin(*INITIALS), F.left("role", F.lit(1))).otherwise("?")
    entries = scratch.keep(marked.withColumn(
        "code", F.when(stays, F.concat(initial, F.when(F.col("truncated"), "t").otherwise("-"))).otherwise("D")), "entries")

    by_turn = entries.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("times") - F.col("leads").cast("bigint"))).alias("duplicate"),
        F.sum((F.col("truncated") & (F.col("code") != "D")).cast("bigint")).alias("truncated"))
    counts = by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))

    pieces = scratch.keep(_pieces(entries.select("conv_id", "turn", "role", "digest", "code", "times"), kind), "pieces")
    crossed = scratch.keep(_crossed(pieces, kind), "crossed")
    edits = scratch.keep(_edits(pieces.join(crossed.drop("conv_id"), "piece"), kind), "edits")
    place = ["x.conv_id", "x.part", "x.place", "x.edit", "x.times", F.col("x.new_role").alias("role")]
    kept = edits.where("edit IN ('K', 'R')").alias("x").join(rows.alias("y"), _same("conv_id", "turn", "role", "digest")).select(
        *place, "y.text", "x.turn")
    others = edits.where("edit NOT IN ('K', 'R')").alias("x").select(*place, F.when(F.col("edit") == "I", "").alias("text"), "x.turn")
    turns = result.keep(kept.unionByName(others), "turns")
    report = result.keep(counts.alias("x").join(crossed.where("cost IS NOT NULL").alias("y"), _same("conv_id")).select(
        "x.*", "y.illegal", "y.cost"), "report")
    scratch.drop()
    return turns, report


def read_back(turns: DataFrame) -> DataFrame:
    """(conv_id, ``audit``, ``repaired_sha256``) of the edits that :func:`repair` gives.

    A digest depends on the order, so one task passes over a conversation; it holds the audit and one batch of texts.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.select("conv_id", "part", "place", "edit", "times", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, done = None, None, []
        names = ["conv_id", "audit", "repaired_sha256"]

        def closed() -> tuple:
            return here, "".join(held[0]), held[1].hexdigest()

        def made(like) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), (like, pa.string(), pa.string()))], names)

        for batch in slices(batches, "text"):
            like = batch.schema.field("conv_id").type
            for conv, edit, times, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "times", "role", "text"))):
                if held is None or conv != here:
                    if held is not None:
                        done.append(closed())
                    here, held = conv, ([], hashlib.sha256(), [])
                held[0].append(edit * times)
                if edit != "D":
                    held[1].update(f"{chr(10) if held[2] else ''}{role}:{text}".encode())
                    held[2][:] = [True]
            if done:
                yield made(like)
                done = []
        if held is not None:
            done = [closed()]
            yield made(like)

    return dealt.mapInArrow(digest, f"conv_id {kind}, audit string, repaired_sha256 string")
