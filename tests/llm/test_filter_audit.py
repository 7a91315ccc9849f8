import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jalur.llm import queries
from jalur.llm.filter_audit import audit, failures, popcounts
from tests.oracle import connection, differs


def brute(docs, labels):
    """docs: (id, text, lang); labels: (id, quality, toxic)."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs = [(i, t or "", p or "") for i, t, p in docs]

    def fails(i, t):
        words = re.findall("[^\x20\x09-\x0d]+", t)
        return {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in docs),
        }

    failing = [fails(i, t) for i, t, _ in docs]
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for p in {p for *_, p in docs}:
            alive = [k for k, d in enumerate(docs) if d[2] == p]
            mine = alive
            for step, f in enumerate(order):
                gone = [k for k in alive if failing[k][f]]
                alive = [k for k in alive if not failing[k][f]]
                shapley[p, f] += len(gone)
                out[p, order, step + 1] = [len(alive), len(gone), sum(failing[k][f] for k in mine) - len(gone), sum(failing[k][f] and sum(failing[k].values()) == 1 for k in mine), sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone)]
    return {(p, order, step, *v, shapley[p, order[step - 1]]) for (p, order, step), v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


many = " ".join(f"wort{k}" for k in range(120))
DOCS = [
    (1, many, "de"), (2, many, "en"), (2, many, "de"), (None, many, "de"), (None, None, None), (3, "", ""), (4, None, "en"), (5, "x " * 50_000, "en"), (6, many + " #", "de"),
    (7, many.upper(), "fr"), (8, "ÄÖÜ É\x0bé\x1cA", "fr"), (8, "ÄÖÜ É\x0bé\x1cA", "fr"), (9, "A" * 11 + "é" * 99, "fr"), (10, "A" * 10 + "é" * 90, "fr"), (11, "a b c", "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (7, 1, 1), (99, 1, 1)]


def test_brute_force(spark):
    docs = spark.createDataFrame([(*d, i, "x") for i, d in enumerate(DOCS)], "doc_id long, text string, lang string, fails int, kept string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = audit(docs, labels)
    assert rows.count() == 600 * len({p or "" for *_, p in DOCS})
    assert got(rows) == brute(DOCS, LABELS)
    assert got(audit(docs.repartition(7), labels.limit(0))) == brute(DOCS, [])
    assert audit(docs.limit(0), labels).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\x0b\x1c#|é\U0001f600", max_size=40))
def test_failures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    want = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * text.count("B") > 10 * len(text), bool(set(text) & set("#|"))]
    assert failures(text.encode()) == sum(x << k for k, x in enumerate(want))


def test_popcounts():
    rng = np.random.default_rng(1)
    part, fails, labels = rng.integers(0, 5, 1000), rng.integers(0, 32, 1000), rng.integers(0, 4, 1000)
    part[:400] = 2
    counts = popcounts(part, fails, labels)
    for p in range(5):
        for s in range(32):
            alive = (part == p) & (fails & s == 0)
            assert counts[p, s].tolist() == [alive.sum(), (alive & (labels & 1 == 1)).sum(), (alive & (labels & 2 == 2)).sum()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert differs(queries.op11_filter_audit(spark, sf_dir), connection(sf_dir), queries.oracle_sql()["op11_filter_audit"]) is None
