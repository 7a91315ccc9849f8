import hashlib
import re
from collections import defaultdict

import pytest

from jalur.llm import chat_format as cf

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def expected(rows):
    """conv_id: (n_turns, turns digest, loss chars, loss digest) of (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    none = lambda x: (x is not None, x)
    for c, turn, role, text in rows:
        convs[c].append((none(turn), role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)
    return out


def found(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.digests(cf.read_back(df)).collect()}


def test_whole_table(spark, sf_dir):
    from jalur.llm.queries import op9_chat_windows

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = op9_chat_windows(spark, sf_dir).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)
    from jalur.llm.queries import oracle_sql
    from tests.oracle import connection

    sql = connection(sf_dir).execute(oracle_sql()["op9_chat_windows"])
    names = [c[0] for c in sql.description]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(sql.fetchall())


ROWS = [
    (1, 0, "system", "be <turn>brief</turn>\n"), (1, 1, "user", None), (1, 2, "assistant", "x" * 400), (1, 3, "user", "\\l \\b \\e \\"), (1, 4, "assistant", "y</turn>\n<turn>user\nz"), (1, 4, "assistant", "y</turn>\n<turn>user\nz"),
    (1, 9, "assistant", "long " * 20_000), (1, 10, "user", "short"), (1, 11, "assistant", ""), (None, None, None, None), (None, 1, "ro\nle<\\", "é😀 tail\n"), (3, 0, "assistant", "only"), (4, 0, "system", "s" * 9000), (4, 1, "assistant", "t"),
    (4, 2, "assistant", "u"), *((5, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 5)) for i in range(300)),
]


@pytest.mark.parametrize(("budget", "history", "chunk"), [(1024, 256, 4096), (60, 20, 4096), (30, 0, 40), (200, 60, 37)])
def test_edges(spark, budget, history, chunk):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, window string")
    out = cf.windows(df, budget, history, chunk=chunk)
    assert found(out) == expected(ROWS)
    count = lambda x: -(-len(x.encode()) // 4) + 4
    for r in out.collect():
        parts = r.text.split(cf.CLOSE)[:-1]
        plain = [re.sub(r"\\(.)", lambda m: {"e": "\n", "l": "<", "b": "\\"}[m[1]], p.split("\n", 1)[1]) for p in parts]
        assert r.n_tokens == sum(map(count, plain))
        new = len(parts) - r.context_turns
        assert new >= 1 and (r.n_tokens <= budget or new == 1)
        assert [r.text[a : a + n] for a, n in r.loss] == [p.split("\n", 1)[1] for p in parts[r.context_turns :] if p.startswith("<turn>assistant\n")]
        if r.conv_id == 1:
            assert parts[0].startswith("<turn>system\n")


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (60, 20), (200, 0)])
def test_chunks_change_no_window(spark, budget, history):
    """Small chunks, also smaller than a window and than the history, and several levels of maps."""
    rows = ROWS + [(6, i, ("system", "user", "assistant")[min(i, 1 + i % 2)], "w " * (i * i % 23)) for i in range(170)] + [(None, i, "assistant", "z" * (i % 90)) for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda out: sorted(map(str, out.collect()))
    want = key(cf.windows(df, budget, history))
    fan, cf.FAN = cf.FAN, 3
    try:
        for chunk in (3, 8, 41):
            assert key(cf.windows(df, budget, history, chunk=chunk)) == want
    finally:
        cf.FAN = fan


def test_empty(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").limit(0)
    assert cf.digests(cf.read_back(cf.windows(df))).count() == 0
