"""The pipeline's stages on their own, and in a row."""

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from jalur.llm import bpe
from tests.llm.test_line_dedup import brute as cut_lines
from tests.llm.test_simhash import kept_of


def test_stages_against_brute_force(spark, sf_dir):
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(cp.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}
    # lines: cut where brute force cuts; documents without a line left go
    cut = {d: g for d, g in cut_lines(list(rows.items()), 50).items() if g}
    left = {}
    for i, t in rows.items():
        gone = cut.get((i, t), [])
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or kept.strip():
            left[i] = kept if gone else t
    out = stages["line_dedup"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert {i: t for i, (t, _) in got.items()} == left
    assert all(got[i][1] == len(got[i][0]) for i, _ in cut if i in got)
    # near duplicates: the least of each component
    out = stages["simhash"](spark, docs, sf_dir)
    assert out.columns == docs.columns and sorted((r.doc_id, r.text) for r in out.collect()) == kept_of(sorted(rows.items()))
    # toxic documents and those with benchmark passages go
    from jalur.llm.queries import op4_toxicity, op8_decontamination

    for name, query, flag in (("toxicity", op4_toxicity, "predicted = 0"), ("decontamination", op8_decontamination, "not contaminated")):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in query(spark, sf_dir).where(flag).collect())


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir).collect()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert 0 < len(out) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(np.frombuffer(r.token_ids, "<u4").tolist() == own.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) // 4 for r in out)


def test_nulls_repeats_empty_and_more_columns(spark, sf_dir):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", None, 0, "y"), (2, "one two three", None, "s", 13, None), (2, "one two three", None, "s", 13, None), (3, "w " * 50_000, "en", "s", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").withColumns({"fingerprint": F.lit(1), "hits": F.lit("h"), "n_words": F.lit("n"), "cut_places": F.lit(0)})
    for _, stage in cp.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, sf_dir)
            assert set(docs.columns) <= set(out.columns)
            assert out.count() <= some.count()
