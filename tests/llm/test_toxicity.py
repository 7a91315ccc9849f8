import zlib

import pytest

from jalur.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain(terms, word):
    out = {}
    for t in terms:
        core = t.removesuffix("$")
        d = distance(core, word) if t.endswith("$") else min(distance(core, word[:k]) for k in range(len(word) + 1))
        if d <= (len(core) >= tx.MISSPELT):
            out[t] = d
    return out


def test_automaton_against_distances():
    import itertools
    import random

    terms = ["moron", "loser$", "vequ", "idiot$", "stup$", "stupid", "lo"]
    a, r = tx.Automaton(terms), random.Random(1)
    words = {"".join(x) for x in itertools.product("loserx", repeat=4)} | {"", "moro", "m0ron", "mooron", "morons", "idiots", "idot", "vequta", "vequ", "veqx", "stupi", "xstupid", "lsoer"}
    words |= {"".join(r.choice("stupidmoronleq") for _ in range(r.randint(3, 9))) for _ in range(4000)}
    for w in words:
        assert a.find(w) == plain(terms, w), w


def model():
    return tx.Model(-2.0, {"moron$": (6.0, 4.0), "scum$": (5.0, 0.0)})


@pytest.mark.parametrize(
    ("text", "toxic"),
    [(None, 0), ("", 0), ("a quiet text", 0), ("You moron!", 1), ("you m0ron", 1), ("morone x", 1), ("scums", 0), ('they wrote "moron" on the wall, a quoted word', 0), ("x " * 200_000 + "scum", 1), ("MORON", 1),
     ('they wrote "a" moron "b", a quoted word', 1), ('they wrote "a" and "moron", a quoted word', 0), ('they wrote "moron, an open quote of a word', 1), ('"x\nthey wrote moron" word', 1), ("sie schrieb „moron“ als zitat", 0), ("il a écrit « moron » mot", 0), ('wrote "' + "long " * 60 + 'moron" said', 0)],
)
def test_texts(text, toxic):
    score, _ = model().scorer()(text)
    assert int(score >= 0.3) == toxic and 0 <= score <= 1


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.6), ("sf0.1", 0.9)])
def test_whole_table_and_held_out(spark, sf, recall):
    """With some 50 toxic documents to learn from at sf0.01, and ten times as many at sf0.1."""
    from jalur.llm.queries import op4_toxicity

    sf_dir = f"/root/testdata/{sf}"
    rows = {r.doc_id: r for r in op4_toxicity(spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    n = {(x, y): 0 for x in (0, 1) for y in (0, 1)}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        x = rows[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and x.predicted == int(x.score >= 0.3)
        if x.held_out:
            n[r.toxic, x.predicted] += 1
    print(sf, n)
    assert n[1, 1] >= recall * (n[1, 0] + n[1, 1]) and n[1, 1] >= 0.9 * (n[0, 1] + n[1, 1])


def test_states_are_bounded(monkeypatch):
    a = tx.Automaton(["moron", "scum$"])
    for k in range(0x4E00, 0x5E00):
        a.find(chr(k) + "moron" + chr(k + 1))
    assert len(a.sets) < 200
    monkeypatch.setattr(tx, "STATES", 3)
    assert a.find("moran") == {"moron": 1} and a.find("scum") == {"scum$": 0} and a.find("scums") == {}


def test_edges(spark):
    docs = [(i, f"word{i} you moron and {'x' * (i % 7)}" if i % 3 == 0 else f"a quiet text {i}", "s") for i in range(90)] + [(None, None, "s"), (200, "", "s"), (201, "big m0ron", None), (201, "big m0ron", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    m = tx.learn(df, labels)
    out = tx.scored(df, m)
    got = {r.doc_id: r.predicted for r in out.collect()}
    assert out.count() == len(docs) and got[201] == 1 and got[200] == 0 and got[None] == 0
    assert all(got[i] == (i % 3 == 0) for i in range(90))
    kept = tx.clean(df, labels)
    assert kept.columns == df.columns and kept.count() == 62
    assert tx.scored(df.limit(0), m).count() == 0
    assert tx.learn(df, labels.limit(0)).weights == {} and tx.clean(df, labels.limit(0)).count() == len(docs)
