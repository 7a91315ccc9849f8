import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from jalur.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


HARD = [
    "", " ", "  ", "\n", " a", "a ", "a  b", "a\n b", "a \n b", "a \nb", "\t\ta", "a  b", "a  b", "a b   c", "it's I'LL they'll  'twas '", "x\x1cy \x1f z\x85w",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "абвгд 12345 ½ ²  漢字かな交じり文", "<|endoftext|>", "é \U0001f600\U0001f600 ‍", "﻿ a", "a\x00b \x00",
]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(other, text):
    c = bpe.codec(PATH, P.PATTERN)
    ids = c.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'sé0½"), st.characters(blacklist_categories=("Cs", "Cn")))))
def test_any_text(text):
    c = bpe.codec(PATH, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    assert np.frombuffer(c.encode(text), "<u4").tolist() == own.encode_ordinary(text)


def test_very_long_pretoken(other):
    text = "abcdefghij" * 20_000
    assert np.frombuffer(bpe.codec(PATH, P.PATTERN).encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_whole_table(spark, sf_dir, other):
    from jalur.llm.queries import op1_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(other.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_nulls_repeats_and_clashes(spark, other):
    rows = [(None, "hi there", 1, "x"), (1, None, 2, "y"), (1, "", 3, "z"), (1, "hi there", 3, "z"), (1, "hi there", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int, decoded string")
    out = bpe.encode(docs, PATH, P.PATTERN, decoded="decoded")
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    back = bpe.decode(out, PATH, P.PATTERN).withColumn("numbers", bpe.as_array()).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"", b"hi there", b"hi there", b"hi there"]
    assert all(r.numbers == other.encode_ordinary(r.text or "") for r in back)
    empty = bpe.encode(docs.limit(0), PATH, P.PATTERN)
    assert empty.count() == 0 and "token_ids" in empty.columns
