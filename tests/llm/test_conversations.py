"""Conversation repair against all possible edits of short conversations, and against its SQL on longer ones in many chunks."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from brindle.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        shown = BLANK.findall(text)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by trying every edit of every row and up to two insertions at every place."""
    marks, best = faults(rows), None
    inserts = [(0, "", []), *[(5 * len(x), "I" * len(x), [(r, "") for r in x]) for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]]
    choices = []
    for (role, text), fault in zip(rows, marks, strict=True):
        more = 5 if fault == "t" else 0
        one = [(2, "D", [])]
        if fault in "-t":
            one += [(more, "K", [(role, text)]), *[(1 + more, "R", [(r, text)]) for r in ("user", "assistant")]]
        choices += [inserts, one]
    for way in itertools.product(*choices, inserts):
        cost = sum(x[0] for x in way)
        if best is None or cost <= best[0]:
            lines = [line for x in way for line in x[2]]
            if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in lines)):
                found = (cost, "".join(x[1] for x in way), "\n".join(f"{r}:{t}" for r, t in lines))
                best = found if best is None else min(best, found)
    return best


def conversations(seed, n, longest):
    pick = random.Random(seed)
    texts, roles = ["Yes.", "No!", "", " \n", "cut", "Why?", "x. \t", "...,"], ["user", "assistant", "system", "tool", "", "u", "User"]
    return [(c, t, pick.choice(roles[:3] * 3 + roles), pick.choice(texts)) for c in range(n) for t in range(pick.randrange(longest + 1))]


@pytest.mark.parametrize("chunk_rows", [1, 2, 512])
def test_all_edits_of_short_conversations(spark, chunk_rows):
    rows = conversations(1, 50, 3)
    got = {r["conv_id"]: r for r in cv.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk_rows=chunk_rows).collect()}
    for conv, mine in itertools.groupby(rows, key=lambda r: r[0]):
        mine = [(role, text) for _, _, role, text in mine]
        cost, audit, lines = cheapest(mine)
        r, marks = got[conv], faults(mine)
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(mine)]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256(lines.encode()).hexdigest())
        assert [r["blank"], r["duplicate"], r["truncated"], r["illegal"]] == [*map(marks.count, "bdt"), sum(p not in cv.LEGAL for p in pairs)]
    assert len(got) == len({r[0] for r in rows})


def test_long_conversations_in_chunks_equal_sql(spark):
    rows = [(c, t * (1 + c % 2), role, text + str(t // 4) * (text != "")) for c, t, role, text in conversations(2, 12, 60)]
    rows += [(None, 1, "user", "A null id."), (None, None, "assistant", None), (99, 0, "user", "gone?"), *[(50, 3, "user", "Repeated.")] * 9]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    hurt = cv.damaged(df)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = {r[0]: r[1:] for r in con.execute(f"select {', '.join(columns)} from ({cv.OP11_SQL})").fetchall()}
    for chunk_rows in (3, 512):
        got = {r[0]: tuple(r[1:]) for r in cv.repair(hurt, chunk_rows=chunk_rows).select(columns).collect()}
        assert got == {k: want[k] for k in got}
        lines = cv.repaired_rows(hurt, chunk_rows=chunk_rows).orderBy("conv_id", "chunk", "place").collect()
        for conv, mine in itertools.groupby(lines, key=lambda r: r["conv_id"]):
            mine = list(mine)
            assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == got[conv][-1]
            assert [r["edit"] for r in mine] == [x for x in got[conv][-2] if x != "D"] and all((r["turn"] is None) <= (r["edit"] == "I" or conv is None) for r in mine)


def test_equal_rows_are_one_short_row(spark):
    df = spark.range(20_000).selectExpr("7L as conv_id", "0L as turn", "'user' as role", "'Again.' as text", "id as extra")
    assert cv.chunked(df).count() == 1
    r = cv.repair(df).first()
    assert (r["duplicate"], r["illegal"], r["gaps"], r["cost"]) == (19_999, 19_999, 0, 40_000) and r["audit"] == "D" * 20_000
    assert cv.repair(df.limit(0)).count() == 0


def test_no_rows_after_damage(spark, tmp_path):
    lost = next(t for t in range(1000) if __import__("zlib").crc32(f"5:{t}".encode()) % 20 == 0)
    spark.createDataFrame([(5, lost, "user", "Gone.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    r = cv.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert [tuple(x) for x in r] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
