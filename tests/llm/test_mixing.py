import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from jalur.llm import queries
from jalur.llm.mixing import _GOLDEN, Mix, point, taken, with_before
from tests.oracle import connection, differs


def brute(docs, block):
    """docs: (id, text, source). Fills slot by slot; one row a document: (id, size, source size, target, taken)."""
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in docs]
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    of = {s: sum(n for n, d in zip(size, docs, strict=True) if d[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total, capped = sum(size), set()
    while True:
        level = Fraction(total - sum(3 * of[s] for s in capped), sum(w for s, w in weight.items() if s not in capped)) if total else 0
        more = {s for s in sources if s not in capped and weight[s] * level > 3 * of[s]}
        if not more:
            break
        capped |= more
    target = {s: float(3 * of[s] if s in capped else weight[s] * level) for s in sources}
    ends, at = [], 0
    for s in sources:
        at += int(target[s] / max(total, 1) * 2**52)
        ends.append(at)
    got, rank = Counter(), Counter()
    stream = defaultdict(list)
    for k in sorted(range(len(docs)), key=lambda k: hashlib.md5(f"{'?' if docs[k][0] is None else docs[k][0]}:{docs[k][1] or ''}".encode()).hexdigest()):
        stream[docs[k][2]] += [k] * size[k]
    for k in range(-(-total // block)):
        u = k * _GOLDEN % 2**52
        s = next((s for s, e in zip(sources, ends, strict=True) if u < e), "none")
        if s == "none":
            continue
        words = stream[s]
        for w in range(rank[s] * block, min((rank[s] + 1) * block, 3 * len(words))):
            got[words[w % len(words)]] += 1
        rank[s] += 1
    return sorted(((str(d[0]), str(d[2]), size[k], of[d[2]], round(target[d[2]], 6), got[k]) for k, d in enumerate(docs)))


def rows(df):
    return sorted((str(r.doc_id), str(r.source), r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def docs_of(n):
    out = []
    for k in range(n):
        source = ("big" if k % 3 == 0 else ("a", "é", "zz", None, "", "tiny", "\U0001f600")[k % 7]) if k % 50 else "one"
        out.append((k // 2 if k % 10 == 0 else k, " ".join(f"w{k * j}" for j in range(1 if source == "tiny" else k * k % 97)), source))
    return [*out, (None, "a\x0bb\x1cc  d", "a"), (None, None, "void"), (5, "", "void"), (7, "wort " * 3000, "é"), (1, "x", "twice"), (1, "x", "twice")]


@pytest.mark.parametrize("block", [1, 7, 32])
def test_brute_force(spark, block):
    docs = docs_of(150)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, row int, key string")
    want = brute(docs, block)
    assert rows(taken(Mix(df, block=block))) == want
    assert rows(taken(Mix(df.repartition(5), block=block))) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    mix = Mix(df)
    assert taken(mix).collect() == [] and mix.spans.count() == 0
    df = spark.createDataFrame([(1, None, None), (None, " ", "a")], df.schema)
    assert rows(taken(Mix(df))) == [("1", "None", 0, 0, 0.0, 0), ("None", "a", 0, 0, 0.0, 0)]


def test_spans(spark):
    """Every slot is one source's and full, spans are parts of documents, and repetitions come in order."""
    docs = spark.createDataFrame(docs_of(400), "doc_id long, text string, source string")
    mix = Mix(docs)
    spans = mix.spans.join(mix.documents, "row")
    assert spans.where("first < 0 or words < 1 or first + words > size or epoch > 2").count() == 0
    full = spans.groupBy("slot").agg(F.count_distinct("source").alias("s"), F.sum("words").alias("w"), F.min("source_size").alias("z"))
    assert full.where("s > 1 or w > 32").count() == 0
    assert full.where("w < 32").count() <= mix.documents.select("source").distinct().count()
    turns = spans.groupBy("source", "epoch").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    assert turns.alias("a").join(turns.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("b.epoch") > F.col("a.epoch"))).where("b.lo < a.hi").count() == 0
    mix.drop()


def test_point(spark):
    ks = [0, 1, 2, 1 << 26, (1 << 26) + 1, 123456789012, (1 << 52) - 1, 1 << 52, (1 << 60) + 7]
    df = spark.createDataFrame([(k,) for k in ks], "k long").select("k", point(F.col("k")).alias("u"))
    assert {r.k: r.u for r in df.collect()} == {k: k * _GOLDEN % 2**52 for k in ks}


def test_with_before(spark):
    at = [0, 1, 4095, 4096, 4097, 9000, 20_000]
    df = spark.createDataFrame([(g, p, p + 1) for g in (1, 2) for p in at], "g int, p long, v long")
    assert {(r.g, r.p): r.before for r in with_before(df, ["g"], "p", "v").collect()} == {(g, p): sum(q + 1 for q in at if q < p) for g in (1, 2) for p in at}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql_and_targets(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    df = queries.op13_mixing(spark, sf_dir)
    assert differs(df, connection(sf_dir), queries.oracle_sql()["op13_mixing"]) is None
    df = df.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in df.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("most")).collect():
        assert abs(r.taken - r.target) <= 3 * 32 and r.most <= 3
