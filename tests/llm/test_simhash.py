import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jalur.llm import simhash
from jalur.llm.components import connected


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute(ids, fps):
    """The least id that is reachable, by comparing all pairs."""
    fps, low = np.array(fps, np.uint64), list(ids)
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 3) for f in fps]
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(low[j] for j in js)
            for j in js:
                changed |= low[j] > m
                low[j] = min(low[j], m)
    return low


def test_whole_table(spark, sf_dir):
    from jalur.llm.queries import op10_simhash

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sorted(op10_simhash(spark, sf_dir).collect())
    assert [r.doc_id for r in rows] == sorted(docs)
    assert [r.fingerprint for r in rows] == [f"{plain(docs[r.doc_id]):016x}" for r in rows]
    assert [r.component_id for r in rows] == brute([r.doc_id for r in rows], [int(r.fingerprint, 16) for r in rows])


@pytest.mark.parametrize("at_most", [250_000, 100])
def test_groups(spark, at_most):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(12)}
    fps |= {(0xABCD << 48) | int(x) for x in rng.integers(0, 1 << 14, 300)}  # a crowded sub-trie
    fps |= {(1 << i) | (3 << 62) for i in range(0, 60)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    values = spark.createDataFrame([(x, x) for x in signed], "fingerprint long, node long")
    table = connected(simhash.links(values, 3, at_most))
    root = {r.node: r.root for r in table.df.collect()}
    want = brute(list(range(len(fps))), fps)
    got = [root.get(x, x) for x in signed]
    same = {}
    for w, g in zip(want, got, strict=True):
        assert same.setdefault(w, g) == g
    assert len(set(got)) == len(set(want))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 500), (601, 600), (600, 601)], "u long, v long")
    got = {r.node: r.root for r in connected(edges).df.collect()}
    assert got == {i: 0 for i in range(301)} | {600: 600, 601: 600}


def test_edges(spark):
    rows = [(5, None, 1), (4, "", 2), (None, "  \n", 3), (9, "One two", 4), (8, "one  TWO", 5), (8, "one  TWO", 5), (7, "w " * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").withColumns({"least": F.lit(1), "rows": F.lit(2), "node": F.lit("n")})
    out = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in out) == [(-1, 4), (4, 4), (5, 4), (7, 7), (8, 8), (8, 8), (9, 8)]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_ids_alone_do_not_tell_documents_apart(spark):
    a, b, c, d, e = ("alpha beta gamma delta", "red green blue white black", "one two three four five six", "north south east west", "salt pepper sugar flour")
    rows = [(None, a), (1, a), (None, b), (None, c), (7, d), (7, e), (7, e), (9, "East of  eden"), (3, "east of EDEN"), (3, "salt  pepper sugar flour")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or -1, r.text) for r in simhash.one_of_each(docs).collect()))
    # each group keeps one document: of the least id, null last; texts that share an id, or have none, are different documents
    assert kept == sorted([(1, a), (-1, b), (-1, c), (7, d), (3, "east of EDEN"), (3, "salt  pepper sugar flour")])


def kept_of(rows, similarity=0.8):
    """What one_of_each keeps of (id, text), by comparing all pairs of wide fingerprints."""
    known = {}
    prints = np.array([simhash.wide_fingerprint((t or "").encode(), known) for _, t in rows]).reshape(len(rows), -1)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        bits = np.bitwise_count(prints ^ prints[i])
        linked = (bits[:, : simhash.TABLES].min(1) <= 3) & (bits[:, simhash.TABLES :].sum(1) <= simhash.wide_budget(similarity))
        same = {label[j] for j in np.flatnonzero(linked)}
        label = [min(same) if x in same else x for x in label]
    least = {}
    for x, (i, t) in zip(label, rows, strict=True):
        least[x] = min(least.get(x, (True,)), (i is None, -1 if i is None else i, t))
    return sorted((i, t) for _, i, t in least.values())


def edited(rng, words, share):
    """words with this share of them changed, added or left out."""
    out = []
    for w in words:
        kind = rng.random()
        out += [] if kind < share / 3 else [w, f"new{rng.integers(1000)}"] if kind < 2 * share / 3 else [f"other{rng.integers(1000)}"] if kind < share else [w]
    return out


def jaccard(a, b):
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


@pytest.mark.parametrize("at_most", [100_000, 400])
def test_near_copies(spark, at_most):
    rng = np.random.default_rng(3)
    rows = []
    for n in (40, 80, 150, 300, 1000) * 4:
        words = [f"w{int(x)}" for x in rng.zipf(1.4, n) % 5000]
        rows += [(" ".join(words)), *(" ".join(edited(rng, words, s)) for s in (0.005, 0.01, 0.02, 0.02, 0.1, 0.3))]
    crowd = [f"c{int(x)}" for x in rng.integers(0, 3000, 200)]
    rows += [" ".join(edited(rng, crowd, 0.01)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in simhash.one_of_each(docs, at_most=at_most).collect())
    assert kept == kept_of(rows)
    if at_most > 1000:  # the decision against exact similarity
        pairs = [(jaccard(a, b), i, j) for i, (_, a) in enumerate(rows[:140]) for j, (_, b) in enumerate(rows[:140]) if i < j and i // 7 == j // 7]
        known = {}
        prints = np.array([simhash.wide_fingerprint(t.encode(), known) for _, t in rows[:140]])
        linked = lambda i, j: np.bitwise_count(prints[i, : simhash.TABLES] ^ prints[j, : simhash.TABLES]).min() <= 3 and np.bitwise_count(prints[i, simhash.TABLES :] ^ prints[j, simhash.TABLES :]).sum() <= simhash.wide_budget(0.8)
        close = [linked(i, j) for s, i, j in pairs if s >= 0.8]
        assert len(close) > 30 and np.mean(close) >= 0.9
        assert not any(linked(i, j) for s, i, j in pairs if s < 0.6)


@pytest.mark.parametrize("at_most", [100_000, 120])
def test_a_crowd_of_unlike_texts_with_the_same_word_fingerprints(spark, at_most):
    """A word that is half of a text or more makes its word fingerprints by itself; only the shingles tell such texts apart."""
    rng = np.random.default_rng(8)
    crowd = [[x for w in rng.integers(0, 4000, rng.integers(30, 60)) for x in (f"t{w}", "|")] + ["|"] for _ in range(300)]
    crowd += [edited(rng, crowd[k], 0.01) for k in range(0, 300, 6)] + [[*crowd[k], "end", "|"] for k in range(3, 300, 12)]
    rows = list(enumerate(" ".join(words) for words in crowd))
    prints = np.array([simhash.wide_fingerprint(t.encode(), {}) for _, t in rows])
    assert np.unique(prints[:, 0], return_counts=True)[1].max() >= 250
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_of(rows)
    assert 290 <= len(want) < 340
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(docs, at_most=at_most).collect()) == want


def test_no_task_holds_a_crowd(spark, monkeypatch):
    """Of a value that is there many times, no part of a sub-trie has more than some at_most rows."""

    def sizes(budget, far):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                rows = list(zip(*(b.column(c).to_pylist() for c in ("path", "turn", "fixed", "value", *(["part"] if "part" in b.schema.names else []))), strict=True))
                seen = {x: rows.count(x) for x in set(rows)}
                yield pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.int64()), pa.array([0] * len(seen), pa.int64())], names=["u", "v"])

        return run

    monkeypatch.setattr(simhash, "_stars", sizes)
    values = spark.range(600).select(F.col("id").alias("node"), F.lit(77).cast("long").alias("fingerprint"), F.lit(0).alias("path"), F.lit(b"").alias("wide"))
    found = [r.u for r in simhash.links(values, 3, 100, 90).collect()]
    assert max(found) <= 150  # two chunks of some 50
    assert sum(found) <= 4 * 600 * 13  # each value once for each pair of chunks and turn


def test_a_crowd_costs_little_more_than_its_plain_comparison():
    import time

    rng = np.random.default_rng(4)
    wide = rng.integers(0, 1 << 64, (4000, 8), dtype=np.uint64)
    values = np.full(4000, 5, np.uint64)

    def plain_pairs():
        for k in range(0, 4000, 100):
            sum(np.bitwise_count(wide[k : k + 100, None, p] ^ wide[k:, p]) for p in range(8)).min()

    def spent(f):
        at = time.process_time()
        f()
        return time.process_time() - at

    groups = []
    walk = min(spent(lambda: groups.append(simhash.trie_groups(values, 16, 3, wide, 90))) for _ in range(3))
    assert np.array_equal(groups[-1], np.arange(4000))
    assert walk < 4 * min(spent(plain_pairs) for _ in range(3))


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_each_pair_has_one_sub_trie(levels):
    """Of the sub-tries in which two values agree, just one has the pair: the earlier ones' blocks are masked in the others."""
    rng = np.random.default_rng(6)

    def places(x, y, turn, path=1, fixed=16):
        """Sub-tries (level by level) that hold both: (path, turn, fixed, their values there)."""
        if x >> (64 - fixed) != y >> (64 - fixed):
            return
        if len(range(16, fixed)) == sum((12, 9, 6)[:levels]):
            yield path, turn, fixed, x, y
            return
        rest, full = 64 - fixed, (1 << (64 - fixed)) - 1
        for b in range(4):
            step = b * rest // 4
            moved = [z & ~full | ((z & full) << step | (z & full) >> (rest - step)) & full for z in (x, y)]
            yield from places(*moved, turn, path * 5 + b + 1, fixed + rest // 4)

    for _ in range(300):
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        y = x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
        turned = lambda z, t: (z << t | z >> (64 - t)) & ((1 << 64) - 1)
        held = [p for t in (0, 16, 32, 48) for p in places(turned(x, t), turned(y, t), t)]
        ours = [p for p in held if all((p[3] ^ p[4]) & int(m) for m in simhash._earlier(*p[:3], 4))]
        assert held and len(ours) == 1


def test_recall_on_the_given_table():
    """Of the pairs of texts whose five-word shingles agree by 0.8 or more, found through their least shingle hashes, nine in ten pass both fingerprints."""
    import duckdb
    import xxhash

    texts = list({r[0] or "" for r in duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet'").fetchall()})
    sets, prints, known, holders = [], [], {}, {}
    for k, text in enumerate(texts):
        words = text.encode().translate(simhash._LOWER).split()
        sets.append({xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))})
        prints.append(simhash.wide_fingerprint(text.encode(), known))
        for h in sorted(sets[-1])[:24]:
            holders.setdefault(h, []).append(k)
    pairs = {(a, b) for v in holders.values() if len(v) <= 60 for i, a in enumerate(v) for b in v[i + 1 :]}
    far, counts = simhash.wide_budget(0.8), {True: [0, 0], False: [0, 0]}
    for a, b in pairs:
        same = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        bits = np.bitwise_count(prints[a] ^ prints[b])
        linked = bits[: simhash.TABLES].min() <= 3 and bits[simhash.TABLES :].sum() <= far
        if same >= 0.8 or same < 0.6:
            counts[same >= 0.8][0] += 1
            counts[same >= 0.8][1] += linked
    n, linked = counts[True]
    assert n >= 40 and linked >= 0.9 * n
    assert counts[False][0] > 1000 and counts[False][1] == 0
