"""Ranked search against a full scan."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jalur.operators.search import Index, build

WORDS = "jalan jalan jalan taman ampang kuala lumpur kl kluang klang bukit batu b é 1 12 50450 jln".split()


def texts(n, seed, most=9):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def full_scan(rows, queries, limit):
    """rows: (id, text, rank); queries: (id, text)."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w, n: [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    out = []
    fields = {n: [(i, r, Counter(grams(cut(t), n))) for i, t, r in rows] for n in (1, 2, 3)}
    for q, text in queries:
        score = Counter()
        for n, docs in fields.items():
            asked = grams(cut(text), n)
            if not asked:
                continue
            having = [d for d in docs if d[2]]
            mean = sum(sum(c.values()) for *_, c in having) / max(1, len(having))
            for term in asked[:-1]:
                df = sum(term in c for *_, c in having)
                for i, _, c in having:
                    if c[term]:
                        score[i] += math.log(1 + (len(having) - df + 0.5) / (df + 0.5)) * c[term] / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            for i, _, c in having:
                score[i] += any(t.startswith(asked[-1]) for t in c)
        rank = {i: r for i, _, r in rows}
        found = sorted(((-round(s, 6), rank[i] is None, -(rank[i] or 0), i) for i, s in score.items() if s > 0))
        out += [(q, k, f[3], rank[f[3]], -f[0]) for k, f in enumerate(found[:limit], 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.place, r.id, r.rank, r.score) for r in df.collect())


@pytest.mark.parametrize(("block", "letters", "limit"), [(2, 1, 3), (16, 3, 10), (128, 3, 50), (1, 5, 1)])
def test_full_scan(spark, tmp_path, block, letters, limit):
    rng = random.Random(block)
    rows = [(i, t, rng.choice([None, 1.0, 2.0, 50.0])) for i, t in enumerate([None, "", "!?", *texts(250, block)])]
    queries = [(k, q) for k, q in enumerate([None, "", "jalan", "ja", "jalan kl", "Jalan  AMPANG k", "kuala lumpur 5", "kuala lumpur 50450", "jalan jalan jalan jal", "nothing here", "nothing kl", *texts(15, 7, 5)])]
    df = spark.createDataFrame(rows, "id long, text string, rank double")
    asked = spark.createDataFrame(queries, "query_id int, query string")
    build(df, f"{tmp_path}/index", "id", "text", "rank", block, letters)
    index = Index(spark, f"{tmp_path}/index")
    want = full_scan(rows, queries, limit)
    for a, b in zip(got(index.top(asked, limit)), want, strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 2e-6
    assert index.top(asked.limit(0), limit).collect() == []


def test_blocks_are_skipped(spark, tmp_path):
    """A rare word beside a common one leaves out the common one's light blocks."""
    rows = [(i, "jalan " * (1 + i % 3) + ("rare" if i % 500 == 0 else "x " * (i % 40)) + f" n{i}", float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, text string, rank double")
    index = build(df, f"{tmp_path}/index", "id", "text", "rank")
    asked = spark.createDataFrame([(1, "rare jalan zz")], "query_id int, query string")
    bounded = index.bounded(asked, "query_id", "query", 5)
    assert index.met(bounded).where("term = 'jalan'").count() == 0
    candidates = index.met(bounded).select("query", F.explode("rows.id").alias("id"))
    probed = index.probed(bounded, candidates).where("term = 'jalan'").count()
    assert 0 < probed < index.blocks.where("field = 1 and term = 'jalan'").count()
    assert index.blocks.agg(F.max(F.size("rows"))).first()[0] < 300
    assert [r[2] for r in got(index.top(asked, 5))] == [r[2] for r in full_scan(rows, [(1, "rare jalan zz")], 5)]


def test_queries_of_the_same_words_are_worked_out_once(spark, tmp_path, monkeypatch):
    rows = [(i, t, float(i % 7)) for i, t in enumerate(texts(120, 3))]
    queries = [(k, q) for k, q in enumerate(["jalan kl", "Jalan, KL!", "jalan kl", "klang b", None, "", "nothing here"] * 5)]
    index = build(spark.createDataFrame(rows, "id long, text string, rank double"), f"{tmp_path}/index", "id", "text", "rank")
    met, bounded = [], Index.bounded
    monkeypatch.setattr(Index, "bounded", lambda self, df, *rest: met.append(df.count()) or bounded(self, df, *rest))
    found = got(index.top(spark.createDataFrame(queries, "query_id int, query string"), 4))
    assert met == [4]  # the empty one is one of them
    assert [r[:4] for r in found] == [r[:4] for r in full_scan(rows, queries, 4)]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "id long, text string, rank double")
    index = build(df, f"{tmp_path}/index", "id", "text", "rank")
    assert index.top(spark.createDataFrame([(1, "jalan")], "query_id int, query string")).collect() == []
