import zlib
from collections import defaultdict

from jalur.llm import sharding


def checked(docs, rows, shards):
    loads, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    texts = defaultdict(list)
    for d in docs:
        texts[d[0]].append(d[1] or "")
    assert len(rows) == len(docs)
    for r in rows:
        t = next(t for t in texts[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32 and r["size"] == len(t.encode()) + 8)
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[t].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    return loads


def test_whole_table(spark, sf_dir):
    from jalur.llm.queries import op2_lpt_sharding

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    loads = checked(docs, op2_lpt_sharding(spark, sf_dir).collect(), 24)
    groups = defaultdict(int)
    for _, t in docs:
        groups[t] += len(t.encode()) + 8
    mean = sum(groups.values()) / 24
    assert max(loads.values()) <= max(4 / 3 * mean, max(groups.values()))


def test_balance_over_parts(spark, monkeypatch):
    docs = [(i, "x" * (i % 97) + str(i % 400)) for i in range(5000)] + [(i, "hot") for i in range(5000, 7000)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    loads = checked(docs, rows, 4)
    assert len(loads) == 4 and max(loads.values()) < 1.02 * sum(loads.values()) / 4


def test_bins_are_packed_again_where_they_are_too_many(spark):
    docs = spark.createDataFrame([(i, "y" * (i % 50) + str(i)) for i in range(3000)], "doc_id long, text string")
    for heap in (sharding.HEAP, 300):
        rows = sharding.homes(docs, 3, rows=200, heap=heap).collect()
        assert len({bytes(r["key"]) for r in rows}) == len(rows) == 3000
        of = {bytes(r["key"]): r["shard"] for r in rows}
        loads = [0, 0, 0]
        for r in docs.select("text", sharding._key("text").alias("key")).collect():
            loads[of[bytes(r["key"])]] += len(r["text"]) + 8
        assert max(loads) < 1.05 * sum(loads) / 3


def test_nulls_repeats_empty_and_clashes(spark):
    docs = [(None, None, 1), (None, "", 1), (3, "a", 2), (3, "a", 2), (4, "b" * 100_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, key int").withColumnRenamed("key", "shard")
    checked(docs, sharding.shard(df, 3).collect(), 3)
    none = sharding.shard(df.limit(0), 3)
    assert none.count() == 0 and none.columns[:3] == ["doc_id", "size", "text_crc32"]


def test_files(spark, tmp_path):
    docs = [(i, "t" * i) for i in range(50)] * 2
    sharding.write_shards(spark.createDataFrame(docs, "doc_id long, text string"), f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(docs)
    assert back.select("doc_id", "shard").distinct().count() == 50


def test_schedule_is_longest_first():
    assert sharding.schedule([(3, "a"), (3, "b"), (2, "c"), (2, "d"), (2, "e")], 2) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 0}
