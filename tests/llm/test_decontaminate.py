import pytest

from jalur.llm import decontaminate as dc


def test_whole_table(spark, sf_dir):
    from jalur.llm.queries import op8_decontamination

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = op8_decontamination(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    words = {n: [w.decode() for w in dc.words_of(t.encode())] for n, t in items}
    for r in rows:
        t = docs[r.doc_id]
        line = " " + " ".join(w.decode() for w in dc.words_of(t.encode())) + " "
        likely = [(n, x) for n, x in items if any(" " + " ".join(words[n][i : i + 10]) + " " in line for i in range(max(1, len(words[n]) - 9)))]
        n_words, n_hit, names = dc.brute_force(t, likely)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n_words, n_hit, len(names), dc.digest_of(names), n_hit > 0)


DOCS = [
    (None, "One two three four five six seven eight nine TEN eleven", "x"),
    (1, None, "y"),
    (2, "", None),
    (3, "...", "z"),
    (4, "alpha-beta; Ünder alpha beta", "z"),
    (4, "alpha-beta; Ünder alpha beta", "z"),
    (5, "zero one two three four five six seven eight nine ten eleven twelve " * 50, "z"),
    (6, "a b a b a b a b a b a b a b", "z"),
]
ITEMS = [(7, "one two three four five six seven eight nine ten eleven"), (8, "Alpha beta"), (9, None), (10, "..."), (11, "a b a b a b a b a b"), (None, "ünder alpha"), (12, "Alpha beta")]


@pytest.mark.parametrize("block", [1 << 20, 12])
def test_edges(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = dc.matches(docs, bench, block_bytes=block).collect()
    assert len(rows) == len(DOCS)
    items = [(None if n is None else str(n), t) for n, t in ITEMS]
    for r in rows:
        n, hit, names = dc.brute_force(r.text, items)
        assert (r.n_words, sum(b - a for a, b in r.spans), r["items"]) == (n, hit, names)
    kept = dc.clean(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.matches(docs.limit(0), bench).count() == 0
    assert dc.clean(docs, bench.limit(0)).count() == len(DOCS)
