"""Conversation repair against plain dynamic programming over audits, and against SQL on odd rows."""

import hashlib
import random
import re
import string

import duckdb
import pytest

from smsight.llm import repair
from smsight.llm.oracles import SQL
from smsight.llm.queries import QUERIES

DUE = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain(rows):
    """(cost, audit) over (initial, forced, truncated) rows; every state carries its cheapest, then least audit."""
    def inserted(reach):
        out = dict(reach)
        for state, (cost, audit) in reach.items():
            for n in (1, 2, 3):
                state, cost, audit = DUE[state], cost + 5, audit + "I"
                out[state] = min(out.get(state, (cost, audit)), (cost, audit))
        return out

    reach = {"": (0, "")}
    for initial, forced, truncated in rows:
        then = {}
        for state, (cost, audit) in inserted(reach).items():
            ways = [(state, 2, "D")]
            if not forced:
                ways.append((DUE[state], 1 + 5 * truncated, "R"))
                if initial == DUE[state] or (state == "" and initial == "s"):
                    ways.append((initial, 5 * truncated, "K"))
            for to, price, letter in ways:
                way = (cost + price, audit + letter)
                then[to] = min(then.get(to, way), way)
        reach = then
    return min(way for state, way in inserted(reach).items() if state in ("", "a"))


def test_crossings_give_the_least_audit():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice("suaax"), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randint(1, 14))]
        items = [repair.deletions(1) if f else repair.ROWS[i if i in "sua" else "?", t] for i, f, t in rows]
        cut = rng.randint(0, len(items))  # pieces of rows, crossed first
        pieces = [p for p in (items[:cut], items[cut:]) if p]
        ends = repair.forward([repair.summary(p) for p in pieces], repair.EMPTY)
        cost, _, last = min((f[0] + 5 * repair.TAIL[s], f[1], s) for s, f in enumerate(ends) if f is not None)
        audit, state = "", repair.EMPTY
        at = iter(rows)
        for piece, end in zip(pieces, repair.crossings([repair.summary(p) for p in pieces], repair.EMPTY, last)):
            for to in repair.crossings(piece, state, end):
                i, f, t = next(at)
                audit += "D" if f else repair.WAYS[i if i in "sua" else "?", t][state, to][1]
                state = to
        assert (cost, audit + "I" * repair.TAIL[last]) == plain(rows), rows


def odd_rows():
    rng = random.Random(2)
    texts = ["Hello.", "hello", "", " \n", "ok!", "well?  ", "no", None, "what?\n", "Ünd so."]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", None, "", "User", "u"]), rng.choice(texts), "x", 5)
            for c in [*range(40), None] for _ in range(rng.randint(0, 12))]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}" + rng.choice([".", ""]), "x", 5) for t in range(3000)]
    rows += [(1001, 1, "user", "same.", "x", 5)] * 500 + [(1002, 5, "assistant", "", "x", 5)]
    return rows


@pytest.mark.parametrize("piece", [repair.PIECE, 7])
def test_odd_rows_match_sql(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    df = spark.createDataFrame(odd_rows(), "conv_id bigint, turn bigint, role string, text string, edit string, part int")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    theirs = con.execute(SQL["op13_conversation_repair"]).df().astype(object)
    assert len(theirs) == len(got) > 40
    for row in theirs.to_dict("records"):
        mine = got[None if row["conv_id"] is None or row["conv_id"] != row["conv_id"] else row["conv_id"]]
        for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"):
            assert mine[c] == row[c], (row["conv_id"], c)


def test_edits_and_texts(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 3, "user", "Still there?"), (1, 4, "tool", "cut off")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    turns, report = repair.repair(df)
    edits = [(r.edit, r.role, r.text) for r in turns.orderBy("part", "place").collect()]
    assert edits == [("K", "system", "Be kind."), ("K", "user", "Hi."), ("D", None, None), ("R", "assistant", "Still there?"), ("D", None, None)]
    assert report.collect()[0].asDict() == {"conv_id": 1, "gaps": 1, "blank": 0, "duplicate": 1, "truncated": 1, "illegal": 3, "cost": 5}
    back = repair.read_back(turns).collect()[0]
    assert back.audit == "KKDRD"
    assert back.repaired_sha256 == hashlib.sha256("system:Be kind.\nuser:Hi.\nassistant:Still there?".encode()).hexdigest()
    empty = repair.repair(df.limit(0))
    assert empty[0].collect() == [] and empty[1].collect() == [] and repair.read_back(empty[0]).collect() == []


def test_repaired_conversations_are_legal(spark):
    folder = "/root/testdata/sf0.001"
    from smsight.llm.queries import damaged
    turns, _ = repair.repair(damaged(spark.read.parquet(f"{folder}/conversations.parquet")))
    by: dict = {}
    for r in turns.orderBy("conv_id", "part", "place").collect():
        by.setdefault(r.conv_id, []).append(r)
    for rows in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows if r.edit != "D"))
        assert set("".join(r.edit for r in rows)) <= set(string.ascii_uppercase) and all(r.text == "" for r in rows if r.edit == "I")
