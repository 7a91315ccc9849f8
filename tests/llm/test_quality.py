import re
from collections import Counter, defaultdict

from jalur.llm import quality
from jalur.llm.quality import Limits

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(hit)


def brute(docs, limits):
    """Verdicts of (id, host, text) rows."""
    norm = lambda x: re.sub("[0-9]+", "0", x.strip(" \t\n\x0b\x0c\r").lower())
    of, hosts = defaultdict(set), defaultdict(set)
    for i, host, text in docs:
        for x in (text or "").split("\n"):
            if WORD.search(x):
                of[host or "", norm(x)].add(i)
                hosts[host or ""].add(i)
    often = {k for k, v in of.items() if len(v) >= limits.min_docs and len(v) > limits.host_share * len(hosts[k[0]])}
    out = []
    for i, host, text in docs:
        b = base(text)
        full = [x for x in (text or "").split("\n") if WORD.search(x)]
        cut = [x for x in full if (host or "", norm(x)) in often]
        gone, left = sum(map(len, cut)), b[0] - sum(len(WORD.findall(x)) for x in cut)
        failed = b[0] < limits.min_words or 100 * b[4] > limits.max_repeat_percent * b[0]
        out.append((i, *b, failed, not failed and gone <= limits.max_removed * sum(map(len, full)) and left >= limits.min_words))
    return out


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
key = lambda x: tuple((v is not None, v) for v in x)


def test_whole_table(spark, sf_dir):
    from jalur.llm.queries import op3_line_frequency

    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op3_line_frequency(spark, sf_dir).collect()
    assert sorted(tuple(r[c] for c in ["doc_id", *NAMES]) for r in rows) == sorted(brute(docs, Limits()))


def test_depleted_documents_are_rejected(spark):
    line = "subscribe to our newsletter and accept all cookies now"  # nine words
    own = lambda i, n: "\n".join(" ".join(f"w{i}x{k}x{j}" for j in range(10)) for k in range(n)).translate(str.maketrans("0123456789", "abcdefghij"))
    docs = [(i, "h", own(i, 12) + "\n" + line) for i in range(20)] + [(100, "h", own(100, 4) + "\n" + line + "\n" + line), (101, "h", own(101, 6) + ("\n" + line) * 9), (102, "other", own(102, 4) + "\n" + line + "\n" + line)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = {r.doc_id: r for r in quality.verdicts(df, limits=Limits()).collect()}
    assert {i for i, r in rows.items() if not r.base_failed and not r.kept} == {100}
    assert rows[101].base_failed and rows[102].kept and rows[0].kept
    assert sorted(tuple(rows[i][c] for c in ["doc_id", *NAMES]) for i in rows) == sorted(brute(docs, Limits()))


def test_edges(spark):
    long = " ".join(f"w{i} x y z" for i in range(20_000))
    docs = [
        (None, None, None, 1), (1, "a", "", 2), (2, "a", "  \n\t\n", 3), (3, "a", "one two three four\none two three four\nBuy 12 now", 4), (4, "a", "buy 7 NOW", 5), (5, "a", "buy 8 now \n# unique | line", 6),
        (5, "a", "buy 8 now \n# unique | line", 6), (6, "b", "buy 8 now", 7), (7, None, long, 8), (8, "a", "a b a b a b", 9), (None, "a", "buy 1 now", 1), (9, "c", "x\xa0y é\u2003z", 0),
    ]
    df = spark.createDataFrame([(i, h, t, k) for i, h, t, k in docs], "doc_id long, source string, text string, kept int")
    limits = Limits(min_docs=3, host_share=0.1, max_removed=0.5, min_words=1)
    got = sorted((tuple(r[c] for c in ["doc_id", *NAMES]) for r in quality.verdicts(df, limits=limits).collect()), key=key)
    assert got == sorted(brute([d[:3] for d in docs], limits), key=key)
    cut = {r.doc_id: r.text for r in quality.without_boilerplate(df, limits=limits).collect()}
    assert cut[5] == "# unique | line" and cut[4] == "" and cut[6] == "buy 8 now" and cut[3] == "one two three four\none two three four" and cut[7] == long
    assert quality.without_boilerplate(df, limits=limits).columns == df.columns
    assert quality.verdicts(df.limit(0)).count() == 0 and quality.without_boilerplate(df.limit(0)).count() == 0
