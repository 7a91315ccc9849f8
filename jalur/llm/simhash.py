"""SimHash fingerprints and near-duplicate groups.

Method: a binary trie self-join.  Node pairs of the trie of all distinct
fingerprints are walked together, the differing bits are added up, and a pair
is dropped once it exceeds the Hamming budget.  Two fingerprints within k bits
agree wholly in at least one of k + 1 equal blocks, so the trie is built k + 1
times, each time with another block at the top; under that block only pairs of
a node with itself need visiting.  These sub-tries are independent, which is
what deals the join out to tasks.  Sub-tries that are too large for a task are
dealt out again by the same rule, over the bits that are left, while a block
of these still parts them.

Two uses.  near_duplicates links documents by one fingerprint of their word
shingles.  At a similarity of 0.8 five-word shingles differ in some 10 of 64
bits, beyond what a trie can prune by, so one_of_each lets four fingerprints of
the single words (which an edit changes a fifth as much) find the pairs, and a
fingerprint of 512 bits over five-word shingles decides them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, binary_texts, slices, text_key
from .components import connected

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Pairs of trie nodes that a task holds at once; pairs of leaves up to which node pairs are compared together, and up to which one is compared as a square.
FRONTIER, LEAVES, SQUARE = 1 << 15, 128, 1 << 15
#: Of the wide fingerprint's parts so many are compared first, where over one pair in so many of a square has near words.
FIRST_PARTS, DENSE = 4, 8
#: Bits of a block by which a sub-trie that is too large is dealt out, at least.
LEAST_BLOCK = 6
#: Values of a sub-trie from which on some of them are first compared with all, and so many of them at most.
CROWD, LEADERS = 256, 16
#: Fingerprints over words, and 64-bit parts of the one over shingles; words whose hash a worker remembers at most.
TABLES, PARTS, HASHES = 4, 8, 100_000
#: Standard deviations that texts of just the similarity asked for may be off by: one in twenty is off by more.
SLACK = 1.6


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits, unsigned: bit b is 1 if set in over half the XXH64 hashes (seed 42) of the word shingles.

    Words are what white space (U+0020, U+0009 to U+000D) separates, A-Z lower-cased.
    Fewer words than width: one shingle of them all; none: 0.
    """
    words = text.translate(_LOWER).split()
    n = len(words) - width + 1
    if not words:
        return 0
    line = b" ".join(words)
    if n < 2:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, starts, (ends[width - 1 :] - 1).tolist())), repeat(42)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):  # bounded memory for any length
        bits = np.unpackbits(hashes[lo : lo + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        for k in range(0, len(bits), 255):
            counts += bits[k : k + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 3) -> DataFrame:
    """docs without the text, with the fingerprint as a signed 64-bit number. No shuffle."""
    rest = [f for f in docs.schema.fields if f.name not in (text, out)]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = np.array([fingerprint(x, width) for x in binary_texts(part.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found)], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.LongType())]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers (two rounds of multiply and shift)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_SEEDS = _mixed(np.arange(1, TABLES + PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _majority(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The fingerprint of hashes, 64 bits for each seed: a bit is 1 if set in over half of them."""
    total = np.zeros(64 * len(seeds), np.int64)
    for lo in range(0, len(hashes), 255):  # bounded memory for any length, and counts that fit a byte
        mixed = _mixed(hashes[lo : lo + 255, None] ^ seeds)
        total += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


def wide_fingerprint(text: bytes, known: dict[bytes, int], width: int = 5) -> np.ndarray:
    """TABLES words of 64 bits over the text's words, by how often they occur, then PARTS over its distinct word shingles.

    Fewer words than width: one shingle of them all; none: 0.  known: hashes of words, kept between calls.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(TABLES + PARTS, np.uint64)
    if len(known) > HASHES:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, 42)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    shingle = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        shingle = _mixed(shingle + h[k : k + n])
    return np.concatenate([_majority(h, _SEEDS[:TABLES]), _majority(np.unique(shingle), _SEEDS[TABLES:])])


def wide_budget(similarity: float) -> int:
    """Bits of the shingle fingerprint that texts of this Jaccard similarity differ in, and SLACK standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * PARTS
    return int(n * share + SLACK * (n * share * (1 - share)) ** 0.5)


def wide_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 5) -> DataFrame:
    """docs without the text, with wide_fingerprint() as binary. No shuffle."""
    rest = [f for f in docs.schema.fields if f.name not in (text, out)]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for part in slices(batches, text):
            found = [wide_fingerprint(x, known, width).tobytes() for x in binary_texts(part.column(text))]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, pa.binary())], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.BinaryType())]))


class Groups:
    """Sets of positions, joined by arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def _earlier(path: int, turn: int, fixed: int, blocks: int) -> list[np.uint64]:
    """Masks of the blocks before this sub-trie's own, at each of its levels, where they are in its values.

    Another sub-trie has the pairs that agree in one of them wholly.
    """
    width = 64 // blocks
    at, top, before = np.roll(np.arange(64), -turn), width, [range(b, b + width) for b in range(0, turn, width)]
    tops = []
    while top < fixed:
        tops.append(top)
        top += (64 - top) // blocks
    for level, top in enumerate(tops):
        b, rest = path // (blocks + 1) ** (len(tops) - 1 - level) % (blocks + 1) - 1, 64 - top
        tail = at[top:]
        before += [tail[c * rest // blocks : c * rest // blocks + rest // blocks] for c in range(b)]
        at = np.r_[at[:top], np.roll(tail, -(b * rest // blocks))]
    place = np.argsort(at)
    return [np.bitwise_or.reduce(np.uint64(1) << (63 - place[list(bits)]).astype(np.uint64)) for bits in before]


def trie_groups(values: np.ndarray, top: int, budget: int, wide: np.ndarray | None = None, far: int = 0, earlier: list[np.uint64] | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """For each of the sorted unsigned values the position of the first of its group.

    Values with the same top bits are linked if they differ in budget bits or
    fewer and, if wide has a row of 64-bit parts for each, these in far or fewer.
    Node pairs all of whose values are in one group already aren't walked any
    further, so that a crowd of copies doesn't cost its square.  Left to others
    are pairs that agree in all bits of a mask of earlier, and those of one side.
    """
    groups, n = Groups(len(values)), len(values)
    earlier = earlier or []
    parts = [np.ascontiguousarray(wide[:, k]) for k in range(wide.shape[1])] if wide is not None else []
    room = {kind: np.empty(SQUARE, kind) for kind in (np.uint64, np.uint8, bool)}
    more = np.empty(SQUARE, np.uint8)

    def near(i: np.ndarray, j: np.ndarray, known: bool = False) -> np.ndarray:
        ok = np.ones(len(j), bool) if known else np.bitwise_count(values[i] ^ values[j]) <= budget
        if wide is not None and ok.any():
            at = np.flatnonzero(ok)
            ok[at] = np.bitwise_count(wide[i[at]] ^ wide[j[at]]).sum(1) <= far
        return ok

    def ours(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = i < j
        ok &= groups.label[i] != groups.label[j]
        if earlier:
            differ = values[i] ^ values[j]
            for mask in earlier:
                ok &= differ & mask != 0
        if side is not None:
            ok &= side[i] != side[j]
        return ok

    def square(a: int, b: int, c: int, d: int) -> None:
        """All pairs of two nodes; first those whose words and then whose first parts are near, without fetching a pair."""
        turned = b - a > d - c  # the longer side is the one that lies together
        if turned:
            a, b, c, d = c, d, a, b
        shape = (b - a, d - c)
        bits, count, ok = (x[: shape[0] * shape[1]].reshape(shape) for x in room.values())
        equal = values[a] == values[b - 1] == values[c] == values[d - 1]
        if not equal:
            np.less_equal(np.bitwise_count(np.bitwise_xor(values[a:b, None], values[c:d], out=bits), out=count), budget, out=ok)
        at = np.arange(ok.size) if equal else np.flatnonzero(ok)
        if len(at) * DENSE > ok.size and len(parts) > FIRST_PARTS:
            # eight bits hold these parts' sum but for one value, which is taken for 0 and so compared in full
            added = more[: ok.size].reshape(shape)
            for k, part in enumerate(parts[:FIRST_PARTS]):
                np.bitwise_count(np.bitwise_xor(part[a:b, None], part[c:d], out=bits), out=added if k else count)
                if k:
                    np.add(count, added, out=count)
            near_parts = np.less_equal(count, far)
            at = np.flatnonzero(near_parts if equal else near_parts & ok)
        if len(at):
            i, j = a + at // shape[1], c + at % shape[1]
            if turned:
                i, j = j, i
            mine = ours(i, j)
            i, j = i[mine], j[mine]
            linked = near(i, j, known=True)
            groups.join(i[linked], j[linked])

    key = values >> np.uint64(64 - top) if top else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    hi = np.r_[lo[1:], n] if n else lo
    many = hi - lo > 1
    for first, end in zip(lo[hi - lo > CROWD].tolist(), hi[hi - lo > CROWD].tolist(), strict=True):
        # some values against all, which joins a crowd of copies before the walk; the walk finds what this leaves
        members = np.arange(first, end)
        alone = members
        for _ in range(LEADERS):
            if len(alone) < 2:
                break
            i = np.full(len(members), alone[0])
            at = near(i, members)
            groups.join(i[at], members[at])
            alone = alone[1:][~at[alone[1:] - first]]
    sides = np.cumsum(np.r_[0, side[1:] != side[:-1]]) if side is not None else None
    todo = [(63 - top, np.stack([lo, hi, lo, hi, np.zeros(len(lo), np.int64)])[:, many])]
    while todo:
        bit, pairs = todo.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            todo += [(bit, pairs[:, half:]), (bit, pairs[:, :half])]
            continue
        label = groups.label
        turns = np.cumsum(np.r_[0, label[1:] != label[:-1]])
        a, b, c, d, differ = pairs
        done = (turns[a] == turns[b - 1]) & (turns[c] == turns[d - 1]) & (label[a] == label[c])
        if earlier:  # equal values agree in every block
            done |= (values[a] == values[b - 1]) & (values[a] == values[c]) & (values[a] == values[d - 1])
        if sides is not None:
            done |= (sides[a] == sides[b - 1]) & (sides[c] == sides[d - 1]) & (side[a] == side[c])
        pairs = pairs[:, ~done]
        a, b, c, d, differ = pairs
        few = (b - a) * (d - c) <= LEAVES
        if few.any():
            p = pairs[:, few]
            size = (p[1] - p[0]) * (p[3] - p[2])
            owner = np.repeat(np.arange(len(size)), size)
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            width = (p[3] - p[2])[owner]
            i, j = p[0][owner] + nth // width, p[2][owner] + nth % width
            close = np.bitwise_count(values[i] ^ values[j]) <= budget
            i, j = i[close], j[close]
            mine = ours(i, j)
            i, j = i[mine], j[mine]
            at = near(i, j, known=True)
            groups.join(i[at], j[at])
            pairs = pairs[:, ~few]
            a, b, c, d, differ = pairs
        some = (b - a) * (d - c) <= SQUARE
        if some.any():
            for sides_of in pairs[:4, some].T.tolist():
                square(*sides_of)
            pairs = pairs[:, ~some]
            a, b, c, d, differ = pairs
        if not pairs.shape[1]:
            continue

        def middle(lo: np.ndarray, hi: np.ndarray, bit: int = bit) -> np.ndarray:
            """Where, in a node's values, those with this bit set begin; halfway in a node of equal values."""
            if bit < 0:
                return (lo + hi) // 2
            one = np.uint64(1) << np.uint64(bit)
            return np.clip(np.searchsorted(values, values[lo] & ~((one << np.uint64(1)) - np.uint64(1)) | one), lo, hi)

        m, o, same, step = middle(a, b), middle(c, d), a == c, int(bit >= 0)
        below = [np.stack([a, m, c, o, differ]), np.stack([m, b, o, d, differ]), np.stack([a, m, o, d, differ + step]), np.stack([m, b, c, o, differ + step])[:, ~same]]
        pairs = np.concatenate(below, axis=1)
        alive = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= budget)
        alive &= ~((pairs[0] == pairs[2]) & (pairs[1] - pairs[0] == 1))
        pairs = pairs[:, alive]
        if pairs.shape[1]:
            todo.append((max(bit - 1, -1), pairs))
    return groups.label


def _rotated(fp: str, by: int) -> str:
    return f"(shiftleft({fp}, {by}) | shiftrightunsigned({fp}, {64 - by}))" if by else fp


def links(values: DataFrame, budget: int = 3, at_most: int = 250_000, far: int | None = None) -> DataFrame:
    """Edges (u, v) that join nodes to their groups.

    values: fingerprint (signed), node, and with far also wide (binary) and path,
    the number of the fingerprint where a node has several.  Nodes are linked if
    a fingerprint of theirs differs in budget bits or fewer, and wide in far or
    fewer.  Of each sub-trie every group is returned as a star, so there are at
    most budget + 1 edges a fingerprint, or that many times more where sub-tries
    of over at_most values were split.  Where that doesn't help, as one value is
    over half of at_most or few bits are left, their values are dealt
    into chunks, and each pair of chunks is a task's.
    """
    spark, blocks = values.sparkSession, budget + 1
    width = 64 // blocks
    carried = ["node", *(["wide"] if far is not None else [])]
    # value: rotated so that the block is on top, turn: by how much, fixed: bits at the top that sub-trie members share
    turned = F.explode(F.array(*[F.struct(F.expr(_rotated("fingerprint", b * width)).alias("value"), F.lit(b * width).alias("turn")) for b in range(blocks)]))
    path = F.col("path").cast("long") if "path" in values.columns else F.lit(0).cast("long")
    level = values.select(turned.alias("x"), F.lit(width).alias("fixed"), path.alias("path"), *carried).select("x.*", "fixed", "path", *carried)
    head = F.expr("shiftrightunsigned(value, 64 - fixed)")
    on = ["path", "turn", "fixed", "head"]
    level = Table(level.withColumn("head", head))
    ready: list[Table] = []
    while True:
        large = Table(level.df.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > at_most))
        if large.df.isEmpty():
            large.drop()
            break
        ready.append(Table(level.df.join(large.df, on, "left_anti")))
        same = level.df.join(large.df, on, "left_semi").groupBy(*on, "value").count().groupBy(*on).agg(F.max("count").alias("same"))
        # a block of fewer bits than LEAST_BLOCK deals out less than it repeats
        sizes = Table(large.df.join(same, on).withColumn("whole", F.expr(f"2 * same > {at_most} or (64 - fixed) div {blocks} < {LEAST_BLOCK}")))
        ready.append(Table(_chunks(level.df.join(sizes.df.where("whole"), on), at_most)))
        hot = level.df.join(sizes.df.where("not whole"), on, "left_semi")
        # the bits below the shared ones, once more in blocks: block b of the rest comes next to the shared ones
        parts = []
        for b in range(blocks):
            rest = "(64 - fixed)"
            step = f"({b} * (64 - fixed) div {blocks})"
            tail = f"(value & (shiftleft(1L, {rest}) - 1))"
            moved = f"(shiftleft({tail}, {step}) | shiftrightunsigned({tail}, {rest} - {step})) & (shiftleft(1L, {rest}) - 1)"
            parts.append(F.struct(F.expr(f"(value & ~(shiftleft(1L, {rest}) - 1)) | ({moved})").alias("value"), F.col("turn"), F.expr(f"fixed + (64 - fixed) div {blocks}").cast("int").alias("fixed"), (F.col("path") * (blocks + 1) + b + 1).alias("path")))
        new = Table(hot.select(F.explode(F.array(*parts)).alias("x"), *carried).select("x.*", *carried).withColumn("head", head))
        for table in (level, large, sizes):
            table.drop()
        level = new
    ready.append(level)
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    out = None
    for table in ready:
        rows = table.df.count()
        if not rows and out is not None:
            continue
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // at_most))
        dealt = [c for c in ("part", "side") if c in table.df.columns]
        edges = table.df.repartition(n, *on, *dealt[:1]).select("value", "turn", "fixed", "path", *carried, *dealt).mapInArrow(_stars(budget, far), schema)
        out = edges if out is None else out.unionAll(edges)
    return out


def _chunks(rows: DataFrame, at_most: int) -> DataFrame:
    """rows of sub-tries of n rows, each once in every part that has its chunk; side: the chunk, in parts of two chunks."""
    # two chunks hold at_most rows
    g = f"cast(ceil(2 * n / {at_most}) as int)"
    mine = rows.withColumn("_mine", F.expr(f"pmod(xxhash64(node), {g})"))
    out = mine.withColumn("_other", F.explode(F.expr(f"sequence(0, {g} - 1)")))
    out = out.withColumn("part", F.expr(f"least(_mine, _other) * {g} + greatest(_mine, _other)"))
    return out.withColumn("side", F.expr("if(_mine = _other, -1, _mine)").cast("long")).drop("_mine", "_other", "n", "same", "whole")


def _stars(budget: int, far: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        columns = [[c.to_numpy(zero_copy_only=False) for c in b.columns[:5]] for b in held]
        value, turn, fixed, path, node = (np.concatenate(x) for x in zip(*columns, strict=True))
        wide = np.concatenate([np.frombuffer(b"".join(b.column("wide").to_pylist()), np.uint64).reshape(b.num_rows, -1) for b in held]) if far is not None else None
        part, side = (np.concatenate([b.column(c).to_numpy() for b in held]) if c in held[0].schema.names else np.full(len(value), -1) for c in ("part", "side"))
        value = value.view(np.uint64)
        kinds = np.stack([path, turn, fixed, part, side >= 0])
        order = np.lexsort((node, side, value, *kinds))
        value, node, side, kinds = value[order], node[order], side[order], kinds[:, order]
        if wide is not None:
            wide = wide[order]
        cut = np.flatnonzero(np.any(kinds[:, 1:] != kinds[:, :-1], axis=0)) + 1
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(value)], strict=True):
            earlier = _earlier(*kinds[:3, lo].tolist(), budget + 1)
            first = trie_groups(value[lo:hi], int(kinds[2, lo]), budget, None if wide is None else wide[lo:hi], far or 0, earlier, side[lo:hi] if side[lo] >= 0 else None)
            member = np.flatnonzero(first != np.arange(hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][member]), pa.array(node[lo:hi][first[member]])], names=["u", "v"])

    return run


def _named(least: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Of groups of several nodes: the keys of each member, and the least name of the group.  least: keys, node, least."""
    members = connected(edges)
    roots = least.join(members.df, "node").select(*keys, "root", "least")
    named = roots.groupBy("root").agg(F.min("least").alias("_named"))
    return roots.join(named, "root").select(*keys, F.col("_named").alias("least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 3, width: int = 3, at_most: int = 250_000) -> DataFrame:
    """One row a document: id_col, fingerprint (signed), component_id.

    component_id is the least id that is reachable over links of budget bits or
    fewer, the document's own included.  Documents with the same fingerprint,
    exact copies among them, are linked through it and never expanded to pairs.
    Null and empty texts have fingerprint 0.  Null ids don't name a component
    unless it has no other.
    """
    marked = Table(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), width=width))
    least = Table(marked.df.groupBy("fingerprint").agg(F.min("id").alias("least")).withColumn("node", F.col("fingerprint")))
    groups = Table(_named(least.df, links(least.df.select("fingerprint", "node"), budget, at_most), ["fingerprint"]))
    rest = least.df.join(groups.df, "fingerprint", "left_anti").select("fingerprint", "least")
    rows = marked.df.join(groups.df.unionByName(rest), "fingerprint")
    return rows.select(F.col("id").alias(id_col), "fingerprint", F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5, budget: int = 3, at_most: int = 100_000) -> DataFrame:
    """docs with one document of each near-duplicate group, the one of the least id and then text key; its columns stay.

    Documents are linked if one of their TABLES fingerprints over words differs
    in budget bits or fewer, and the one over shingles of width words in
    wide_budget(similarity) or fewer.  Null ids come last.  Rows equal in id and
    text are one document, of which one row stays; an id alone, null or not,
    doesn't tell documents apart.  Texts without a word are one group.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), text_key(text).alias("key"))
    marked = Table(wide_fingerprints(named, width=width))
    name = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")
    least = Table(marked.df.groupBy("fingerprint").agg(F.min(name).alias("least"), F.count("*").alias("rows")).withColumn("node", F.xxhash64("fingerprint")))
    word = lambda k: F.expr(f"cast(conv(hex(substring(fingerprint, {8 * k + 1}, 8)), 16, -10) as long)")
    number = [F.struct(F.lit(k).alias("path"), word(k).alias("fingerprint")) for k in range(TABLES)]
    values = least.df.select("node", F.expr(f"substring(fingerprint, {8 * TABLES + 1}, {8 * PARTS})").alias("wide"), F.explode(F.array(*number)).alias("x")).select("node", "wide", "x.*")
    groups = Table(_named(least.df, links(values, budget, at_most, wide_budget(similarity)), ["fingerprint"]))
    # only fingerprints of several rows or of a group can lose a document
    some = groups.df.unionByName(least.df.where("rows > 1").join(groups.df, "fingerprint", "left_anti").select("fingerprint", "least"))
    rows = Table(marked.df.join(some, "fingerprint").select("id", "key", "least"))
    stays = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key"))
    gone = Table(rows.df.where(~stays).select(F.col("id").alias("_jl_id"), F.col("key").alias("_jl_key")).distinct())
    kept = docs.join(gone.df, docs[id_col].eqNullSafe(F.col("_jl_id")) & (text_key(docs[text]) == F.col("_jl_key")), "left_anti")
    again = rows.df.where(stays).groupBy("id", "key").count().where("count > 1").isEmpty()
    for table in (marked, least, groups, rows):
        table.drop()
    return kept if again else kept.withColumn("_jl_key", text_key(text)).dropDuplicates([id_col, "_jl_key"]).drop("_jl_key")
