import re

import pytest

from jalur.llm import line_dedup as ld

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, least):
    """{(id, text): places that go}, of (id, text) rows: every line in a run of least words that is also earlier."""
    docs = sorted(set(docs), key=lambda d: (d[0] is not None, d[0]))
    lines = [[(p, x.strip(" \t\n\x0b\x0c\r"), len(WORD.findall(x))) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t in docs]
    first, gone = {}, {d: set() for d in docs}
    for d, of in zip(docs, lines, strict=True):
        for lo in range(len(of)):
            words, run = 0, ()
            for hi in range(lo, len(of)):
                words += of[hi][2]
                run += (of[hi][1],)
                if words >= least and first.setdefault(run, (d, lo)) != (d, lo):
                    gone[d] |= {of[k][0] for k in range(lo, hi + 1)}
                elif words >= least and hi - lo > 25:
                    break
    return {d: sorted(g) for d, g in gone.items()}


def found(spark, docs, least):
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, place int")
    out = ld.without_copies(df, min_words=least, report=True).collect()
    assert len(out) == len(docs)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    import random

    r = random.Random(seed)
    pool = ["a", "b b", "c c c", "d d d d", "e e e e e e"]
    docs = []
    for i in range(60):
        own = [r.choice(pool) if r.random() < 0.8 else f"unique {i} {k}" for k in range(r.randint(0, 22))]
        if docs and r.random() < 0.5:
            other = r.choice(docs)[1].split("\n")
            k = r.randint(0, len(own))
            own[k:k] = other[r.randint(0, len(other)) :][: r.randint(1, 9)]
        docs.append((i, "\n".join(own)))
    docs.append((60, docs[3][1]))
    want = brute(docs, 8)
    texts = dict(docs)
    for row in found(spark, docs, 8):
        assert row.cut_places == want[row.doc_id, texts[row.doc_id]], row.doc_id


def test_edges(spark):
    para = "one two three four five"
    docs = [(None, f"{para}\n{para}"), (1, None), (2, ""), (3, "\n \n"), (4, f" {para}\t\n\n{para} \nlast"), (4, f" {para}\t\n\n{para} \nlast"), (5, f"{para}\nnew"), (6, f"x\n{para}\n\n\n{para}"), (7, para + "\n" + para), (8, "w " * 60_000), (9, "w " * 60_000), (10, f"{para}\n" * 3000)]
    want = brute([d for d in docs if d[0] != 10], 10)
    out = found(spark, docs, 10)
    for row in out:
        t = next(t for i, t in docs if i == row.doc_id)
        if row.doc_id == 10:
            assert row.cut_places == list(range(3000)) and row.text == ""
            continue
        assert row.cut_places == want[row.doc_id, t], row.doc_id
        if row.cut_places:
            left = [x for k, x in enumerate(t.split("\n")) if k not in row.cut_places]
            assert row.text == ("\n".join(left) if any(WORD.search(x) for x in left) else "")
        else:
            assert row.text == t
    empty = spark.createDataFrame([], "doc_id long, text string, h int")
    assert ld.without_copies(empty).columns == empty.columns and ld.without_copies(empty).count() == 0


def test_whole_table(spark, sf_dir):
    from jalur.llm.queries import op7_line_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {d[0]: g for d, g in brute(docs, 50).items()}
    got = op7_line_dedup(spark, sf_dir).collect()
    assert {r.doc_id: r.n_cut for r in got} == {i: len(g) for i, g in want.items()}
    assert sum(r.n_cut for r in got) > 0


def test_sql(spark, sf_dir):
    from jalur.llm.queries import op7_line_dedup, oracle_sql
    from tests.oracle import connection, differs

    assert differs(op7_line_dedup(spark, sf_dir), connection(sf_dir), oracle_sql()["op7_line_dedup"]) is None
