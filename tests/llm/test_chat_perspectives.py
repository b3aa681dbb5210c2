"""Perspective rotation against SQL and a plain rendering."""

from collections import defaultdict

import duckdb

from wingspan.llm import chat_perspectives as C
from wingspan.llm.common import table
from wingspan.llm.queries import REGISTRY, SQL


def brute(rows, block_turns):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = []
    for conv, turns in talks.items():
        turns = [(*t, i // block_turns) for i, t in enumerate(sorted(turns))]
        for p in {t[2] for t in turns} - {"system"}:
            for block in {t[4] for t in turns}:
                text, mask, n = "", [], 0
                for _, _, role, said, b in sorted(turns, key=lambda t: t[:4]):
                    if b == block:
                        text += "<|assistant|>\n" if role == p else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                        if role == p:
                            mask.append((len(text), len(text) + len(said) + 7))
                        text += said + "<|end|>\n"
                        n += 1
                out.append((conv, p, block, n, text, mask))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.conv_id, r.perspective, r.block, r.n_turns, r.text, [tuple(m) for m in r.mask]) for r in df.collect()), key=str)


def test_small_table(spark):
    turns = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    assert rows_of(C.views(turns)) == brute(rows, 512)
    assert rows_of(C.views(turns, block_turns=3)) == brute(rows, 3)


def test_odd_rows(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, None, "x"), (1, 2, "ann", "ü\n"), (1, None, "system", "be kind"), (1, 0, "ann", "hi"),
            (2, 0, "system", "alone"), (None, 5, "cy", ""), (None, 4, "di", "z"), (3, -1, "ann", "before"), (3, 700, "bob", "long " * 20_000)]
    turns = spark.createDataFrame([(*r, 1, "m") for r in rows], "conv_id long, turn long, role string, text string, block int, mask string")
    got = rows_of(C.views(turns))
    assert got == brute(rows, 512)
    assert not any(g[0] == 2 for g in got)
    for _, _, _, _, text, mask in got:
        assert all(text[a:b].endswith("<|end|>") for a, b in mask)
    assert C.views(turns.limit(0)).collect() == []


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    df = REGISTRY["op3_chat_perspectives"](spark, "/root/testdata/sf0.01")
    res = con.execute(SQL["op3_chat_perspectives"])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in res.fetchall())


def test_native(spark):
    plan = REGISTRY["op3_chat_perspectives"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
