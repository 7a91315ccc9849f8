import hashlib
import random
from collections import Counter
from pathlib import Path

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jalur.llm import queries
from jalur.llm.token_align import Memory, _floor, align, aligned, first_tokens, pair_counts, scored, second_tokens, stretches, tokens

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(both, text):
    """(id, start, end) of both tokenisers over space + text; none where bytes differ."""
    a, b = both
    if not text:
        return [], []
    letters = {}
    for c in range(256):
        letters[chr(c) if c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)] else chr(256 + sum(x not in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)] for x in range(c)))] = c
    out = []
    for ids, entry in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))), (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
        at, one, whole = 0, [], b""
        for i in ids:
            e = entry(i)
            one.append((i, at, at + len(e)))
            at, whole = at + len(e), whole + e
        if whole != (" " + text).encode():
            return [], []
        out.append(one)
    return out


def brute(both, docs):
    every = []
    for i, text in docs:
        a, b = spans(both, text)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ["|".join(",".join(str(x) for x, s, e in side if lo <= s and e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(x, y) for x, s, e in a for y, t, f in b if max(s, t) < min(e, f)]
        every.append((i, len(a), len(b), groups, links))
    n = Counter(p for *_, links in every for p in set(links))
    top = {}
    for (x, _), c in n.items():
        top[x] = max(top.get(x, 0), c)
    return sorted(((str(i), la, lb, len(groups), len(links), sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if la else "") for i, la, lb, groups, links in every))


def rows(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a", "b", "the", " the", "ing", "1", "23", "'s", ".", "!", "é", "ß", "日本", "\U0001f600", "<s>", "<|endoftext|>", "<0x0A>", "\x00", "﻿", "é", "ﬁ", "​"]


def some_texts(n, seed, parts=PARTS, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, most))) for _ in range(n)]


def test_memory(both):
    """Stretches encoded apart give what whole texts give, whatever is remembered."""
    for remembered in (5, 300, 10_000):
        memory = Memory([first_tokens(Path(A).read_bytes()), second_tokens(Path(B).read_bytes())], remembered)
        for text in some_texts(1500, remembered):
            parts = stretches(text)
            assert "".join(" " + x for x in parts) == " " + text
            (a, n, ok), (b, m, fine) = memory(parts)
            assert a.tolist() == both[0].encode(" " + text, add_special_tokens=False).ids and b.tolist() == both[1].encode(text)
            assert ok.all() and fine.all() and n.sum() == len(a) and m.sum() == len(b)
        assert len(memory.known) <= remembered


def test_brute_force(spark, both):
    texts = [None, "", " ", "a▁b", "▁", "<|endoftext|> x <s>", "The same text here.", "The same text here.", "x" * 3000, "word " * 500, *some_texts(150, 3), *some_texts(20, 4, most=200), *some_texts(20, 5, [*PARTS, "▁"])]
    docs = [*enumerate(texts), (6, texts[6]), (None, "Der Ährenkranz"), (None, None)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, a_ids string, row int")
    want = brute(both, docs)
    assert rows(align(df, A, B)) == want
    assert rows(align(df.repartition(5), A, B)) == want
    assert align(df.limit(0), A, B).collect() == []


def test_frequent_and_seldom_pairs_agree(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(some_texts(120, 9))], "doc_id long, text string")
    made = aligned(tokens(docs, A, B)).select(F.col("id").alias("row"), "links").cache()
    pairs = pair_counts(made)
    want = scored(made, pairs, frequent=1 << 20).collect()
    for k in (0, 3, 40):
        assert pairs.where(F.col("n") >= _floor(pairs, k)).count() <= k
        assert sorted(scored(made, pairs, frequent=k).collect()) == sorted(want)


def test_groups_and_links(spark, both):
    texts = ["Antidisestablishment, naïve 日本語\n\nx", "a", "the the", "x" * 300 + "日" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in aligned(tokens(docs, A, B)).collect():
        a, b = spans(both, texts[r.id])
        assert (r.n_a, r.n_b) == (len(a), len(b)) and r.groups.count(";") + 1 == r.n_groups
        assert r.links == [(x << 32) + y for x, s, e in a for y, t, f in b if max(s, t) < min(e, f)]
        for k, side in enumerate((a, b)):
            assert [int(x) for g in r.groups.split(";") for x in g.split("|")[k].split(",")] == [x for x, *_ in side]


def test_an_order_of_ends_is_aligned_once(spark, both):
    """Stretches whose tokens end in the same order share what is worked out from the ends, however many bytes lie between."""
    texts = [" ".join(f"{w}{k}" for w in ("the", "alignment", "\u00e9t\u00e9", "x") for k in range(10, 60)), "a a the", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    for r in tokens(docs, A, B).collect():
        ends = list(zip(map(tuple, r.a_ends), map(tuple, r.b_ends), strict=True))
        assert len(set(ends)) == len(ends) < len(r.tokens) // 5
        assert all(sorted({*a, *b}) == [*range(1, max(a) + 1)] for a, b in ends)
        assert all(len(t) == sum(map(len, ends[k])) for t, k in zip(r.tokens, r.shapes, strict=True))
    assert rows(align(docs, A, B)) == brute(both, list(enumerate(texts)))


def test_whole_table(spark, both):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = [d for d in docs if len(d[1] or "") < 4000]  # brute force is quadratic in a text
    got = rows(queries.op12_token_alignment(spark, sf_dir))
    assert len(got) == len(docs)
    want = {x[0]: x for x in brute(both, short)}
    assert all(x[:5] + x[7:] == want[x[0]][:5] + want[x[0]][7:] for x in got if x[0] in want)
