"""How do the tokens of two tokenisers lie over each other?

Method: Python tokenises and gives the ids and end offsets of both tokenisers;
all else is Spark's higher-order functions.  Offsets at which tokens of both
end (array_intersect) cut a text into groups.  The ends of both, sorted as one
array, are the smallest pieces of the text: the p-th of them, if it is the end
of A's token i, lies in B's token p - i, as p - i of B's ends come before it; so
each end gives one link, and an end of both the same one twice.

What both tokenisers do to a stretch between blanks doesn't depend on what is
around it, and tokens of both end where it ends.  So each worker remembers the
tokens of stretches, and a block of documents has each of its distinct stretches
once, and each distinct order of ends once: groups and links are worked out from
the ends as places, then filled with the ids of each stretch that has this order,
and a document's groups and links are its stretches' in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, binary_texts, let, slices

#: Stretches that a worker remembers, characters of new ones that are encoded at once, and bytes of a block's texts (or one longer text).
REMEMBERED, AT_ONCE, BLOCK = 100_000, 1 << 16, 4 << 20
#: Pairs of ids that are broadcast at most (some 40 bytes each), those that most documents have.
FREQUENT = 1 << 17
_LOW = (1 << 32) - 1
#: What the spelling of groups has besides ids.
SIGNS = (",", "|", ";")
_COLUMNS = ["ids", "codes", "tokens", "shapes", "a_ends", "b_ends", "n_a", "n_b"]
#: Stretches of space + text start with a space that follows no white space.  No pre-token of A and no piece of B crosses their bounds.
_SPACE = r"\s\x1c-\x1f"
_STRETCH = regex.compile(rf"[{_SPACE}]++(?:[^{_SPACE}]++(?:(?! )[{_SPACE}]++)?+)*+")
_SPACES = "".join(chr(c) for c in range(0x3001) if regex.fullmatch(f"[{_SPACE}]", chr(c)))


def stretches(text: str) -> list[str]:
    """The stretches of space + text, each without its first space."""
    whole = " " + text
    if any(c + " " in whole for c in _SPACES):
        return [x[1:] for x in _STRETCH.findall(whole)]
    return text.split(" ")


class Tokeniser:
    """encode: texts with their first space to lists of ids; entries: the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: list[bytes]):
        self.encode, self.entries, self.sizes = encode, entries, np.array([len(e) for e in entries], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))

    def each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all stretches, how many each has, and whether their bytes are the stretch's own.

        Those up to the first that ends in white space or is empty are encoded many at once.
        """
        plain = next((k for k, x in enumerate(parts) if not x or x[-1] in _SPACES), len(parts))
        chars = np.cumsum([len(x) + 1 for x in parts[:plain]])
        bounds = [0, *np.searchsorted(chars, range(AT_ONCE, int(chars[-1]), AT_ONCE)), plain] if plain else [0]
        out = [self._at_once(parts[lo:hi]) for lo, hi in pairwise(bounds)] + [self._singly(parts[plain:])]
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def _singly(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = self.encode([" " + x for x in parts])
        same = [self.joined(ids) == (" " + x).encode() for ids, x in zip(lists, parts, strict=True)]
        return np.fromiter(chain.from_iterable(lists), np.int32), np.array([len(x) for x in lists], np.int64), np.array(same, bool)

    def _at_once(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = "".join(" " + x for x in parts)
        [ids] = self.encode([whole])
        if not ids or self.joined(ids) != whole.encode():
            return self._singly(parts)
        ends = np.cumsum(self.sizes[ids])
        want = np.cumsum([len(x) + 1 for x in parts] if whole.isascii() else [len(x.encode()) + 1 for x in parts])
        at = np.searchsorted(ends, want)
        return (np.array(ids, np.int32), np.diff(at, prepend=-1), np.ones(len(parts), bool)) if (ends[at] == want).all() else self._singly(parts)


class Memory:
    """What a worker knows of stretches: those that it met first, as long as it meets a fifth of them again."""

    def __init__(self, tokenisers: list[Tokeniser], remembered: int):
        self.tokenisers, self.remembered = tokenisers, remembered
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)) for _ in self.tokenisers]

    def __call__(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each tokeniser what Tokeniser.each() says."""
        codes = list(map(self.known.get, parts))
        fresh, held = {}, self.held
        if None in codes:
            fresh = dict.fromkeys(x for x, c in zip(parts, codes, strict=True) if c is None)
            if 5 * len(fresh) > 4 * len(parts) and len(self.known) == self.remembered:
                self.clear()
                held, fresh, codes = self.held, dict.fromkeys(parts), [None] * len(parts)
            fresh = {x: len(self.known) + k for k, x in enumerate(sorted(fresh, key=lambda x: not x or x[-1] in _SPACES))}
            held = [tuple(map(np.concatenate, zip(h, t.each(list(fresh)), strict=True))) for h, t in zip(held, self.tokenisers, strict=True)]
            codes = [fresh[x] if c is None else c for x, c in zip(parts, codes, strict=True)]
        places = np.array(codes, np.int64)
        out = []
        for ids, counts, same in held:
            starts, n = np.cumsum(counts) - counts, counts[places]
            out.append((ids[np.repeat(starts[places] - np.cumsum(n) + n, n) + np.arange(n.sum())], n, same[places]))
        if fresh and (room := self.remembered - len(self.known)) > 0:
            self.known.update(list(fresh.items())[:room])
            self.held = [(ids[: counts[: len(self.known)].sum()], counts[: len(self.known)], same[: len(self.known)]) for ids, counts, same in held]
        return out


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level entries: printable Latin-1 letters are their own, the other bytes follow in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def first_tokens(model: bytes) -> Tokeniser:
    """A: byte-level BPE, from the bytes of its JSON file."""
    from tokenizers import Tokenizer

    of = Tokenizer.from_buffer(model)
    of.encode_special_tokens = True  # their strings in a text are plain text
    byte, entries = byte_letters(), [b""] * of.get_vocab_size(with_added_tokens=True)
    for entry, i in of.get_vocab(with_added_tokens=True).items():
        entries[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return Tokeniser(lambda texts: [of.encode(t, add_special_tokens=False).ids for t in texts], entries)


def second_tokens(model: bytes) -> Tokeniser:
    """B: pieces with byte fallback, from the bytes of its model file; it adds the first space itself."""
    import sentencepiece

    of = sentencepiece.SentencePieceProcessor(model_proto=model)
    space = [of.piece_to_id("\u2581")]
    entry = lambda i: bytes([int(of.id_to_piece(i)[3:5], 16)]) if of.is_byte(i) else of.id_to_piece(i).replace("\u2581", " ").encode()
    # a lone space is the one that B adds, but it adds none to an empty text
    return Tokeniser(lambda texts: [x if t != " " else space for x, t in zip(of.encode([t[1:] for t in texts], num_threads=1), texts, strict=True)], [entry(i) for i in range(of.get_piece_size())])


@lru_cache(maxsize=1)
def _memory(first: bytes, second: bytes, remembered: int) -> Memory:
    """One for all tasks of a worker."""
    return Memory([first_tokens(first), second_tokens(second)], remembered)


def _side_by_side(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each stretch's ids of A, then its ids of B."""
    stretch_of = np.concatenate([np.repeat(np.arange(len(counts)), counts) for _, counts, _ in sides])
    return np.concatenate([ids for ids, *_ in sides])[np.argsort(stretch_of, kind="stable")]


def _shapes(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """For each stretch the number of its shape, and the ends of A and of B in each shape.

    Only the order of ends matters to an alignment, not how many bytes lie
    between, so ends are counted in a stretch's pieces: the k-th end of either is k.
    """
    pieces = np.zeros(max((int(ends[-1]) for *_, ends in sides if len(ends)), default=0) + 1, bool)
    for *_, ends in sides:
        pieces[ends] = True
    number = np.cumsum(pieces)
    lists, cuts = [], []
    for _, counts, ends in sides:
        at, bounds = number[ends], np.concatenate([[0], np.cumsum(counts)])
        tops = np.concatenate([[0], at])[bounds]  # where the stretches end
        lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((at - np.repeat(tops[:-1], counts)).astype(np.int32))))
        raw, to = lists[-1].values.to_numpy().tobytes(), (4 * bounds).tolist()
        cuts.append([raw[lo:hi] for lo, hi in pairwise(to)])
    numbers: dict[tuple[bytes, ...], int] = {}
    shapes = np.array([numbers.setdefault(k, len(numbers)) for k in zip(*cuts, strict=True)], np.int32)
    firsts = pa.array(np.unique(shapes, return_index=True)[1])
    return [pa.array(shapes), *(x.take(firsts) for x in lists)]


def _tokens(models, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(*models.value, remembered)
        for batch in slices(batches, "text", BLOCK):
            raw = binary_texts(batch["text"])
            numbers: dict[str, int] = {}
            codes = [[numbers.setdefault(x, len(numbers)) for x in stretches(t.decode())] if t else [] for t in raw]
            met = memory(list(numbers))
            whole = np.logical_and.reduce([same for *_, same in met])
            if not whole.all():  # where the first such stretch is, the document's bytes differ too
                codes = [c if whole[c].all() else [] for c in codes]
            lists = lambda values, bounds: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32)))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            docs = np.cumsum([0, *map(len, codes)])
            places = np.fromiter(chain.from_iterable(codes), np.int64, docs[-1])
            sides, totals = [], []
            for of, (ids, counts, _) in zip(memory.tokenisers, met, strict=True):
                ids, counts = ids[np.repeat(whole, counts)], np.where(whole, counts, 0)
                sides.append((ids, counts, np.cumsum(of.sizes[ids])))
                totals.append(one(pa.array(np.diff(np.concatenate([[0], np.cumsum(counts[places])])[docs]))))
            both = np.sum([counts for _, counts, _ in sides], axis=0)
            columns = [one(batch["id"]), one(lists(places, docs)), one(lists(_side_by_side(sides), np.concatenate([[0], np.cumsum(both)])))]
            columns += [one(x) for x in _shapes(sides)] + totals
            yield pa.RecordBatch.from_arrays(columns, _COLUMNS)

    return run


def tokens(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Blocks of some megabytes of docs: what both tokenisers make of their distinct stretches, and which stretches each document is.

    ids: the documents' id_col.  codes: for each document its stretches, as
    places in the block's arrays; none where the text is null or empty, or where
    the bytes of either tokeniser's tokens, joined, aren't space + text.
    tokens: for each stretch A's ids, then B's.  shapes: for each stretch its
    place in a_ends and b_ends, which have each distinct pair of ends once, in
    pieces (see _shapes()).  n_a, n_b: for each document its tokens.

    first: a byte-level BPE file (JSON) whose pre-tokens keep a space with the
    word after it; second: a piece model.  The driver reads them.
    """
    models = docs.sparkSession.sparkContext.broadcast((Path(first).read_bytes(), Path(second).read_bytes()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kinds = f"ids array<{rows.schema['id'].dataType.simpleString()}>, " + ", ".join(f"{c} {'array<bigint>' if c.startswith('n_') else 'array<int>' if c == 'shapes' else 'array<array<int>>'}" for c in _COLUMNS[1:])
    return rows.mapInArrow(_tokens(models, remembered), kinds)


def merged_ends(a_ends: Column, b_ends: Column) -> Column:
    """The ends of both in order, A's before B's: end, whose it is, and which of its tokens, in one number.

    For stretches of under 1 GB, as the end has 30 bits.
    """
    key = lambda side: lambda end, i: F.shiftleft(end.cast("long"), 33).bitwiseOR(i + side)
    return F.sort_array(F.concat(F.transform(a_ends, key(0)), F.transform(b_ends, key(F.lit(1 << 32)))))


def shape(e: Column) -> Column:
    """What the ends alone say of the stretches that have them: a and b, spelling, and n (groups).

    a, b: for each pair of tokens whose bytes overlap, their places in a
    stretch's ids.  spelling: places in the ids and SIGNS, one after the other,
    that make the groups as `a1,a2|b1;a3|b2,b3`.
    """
    n_a, n_b = F.size(e["a_ends"]), F.size(e["b_ends"])
    same = lambda m, p: F.shiftright(m[p], 33) == F.shiftright(F.get(m, p - 1), 33)
    which = lambda x: x.bitwiseAND(_LOW).cast("int")
    place = lambda i, j: F.struct(i.alias("a"), (n_a + j).alias("b"))

    def link(m: Column, x: Column, p: Column) -> Column:
        of_a = x.bitwiseAND(1 << 32) == 0
        return F.when(of_a, place(which(x), p - which(x))).when(same(m, p), None).otherwise(place(p - which(x), which(x)))

    def spelling(m: Column, ends: Column) -> Column:
        """ends: where in m a group ends; before it is A's last token of the group."""
        sign = lambda c: F.lit(SIGNS.index(c)) + n_a + n_b

        def part(p: Column, k: Column, d: int, base: Column, opens: str) -> Column:
            first = F.coalesce(which(F.get(m, F.get(ends, k - 1) - d)), F.lit(-1)) + 1
            return F.flatten(F.transform(F.sequence(first, which(m[p - d])), lambda i, at: F.array(F.when(at == 0, sign(opens)).otherwise(sign(",")), i + base)))

        whole = F.flatten(F.transform(ends, lambda p, k: F.concat(part(p, k, 1, F.lit(0), ";"), part(p, k, 0, n_a, "|"))))
        return F.slice(whole, F.lit(2), F.size(whole))  # no sign opens the first group

    def both(m: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(m) - 1), lambda p: same(m, p))
        links = F.array_compact(F.transform(m, lambda x, p: link(m, x, p)))
        n = F.size(F.array_intersect(e["a_ends"], e["b_ends"])).cast("long")
        return F.struct(links["a"].alias("a"), links["b"].alias("b"), let(ends, lambda at: spelling(m, at)).alias("spelling"), n.alias("n"))

    return F.when(n_a > 0, let(merged_ends(e["a_ends"], e["b_ends"]), both))  # null for a stretch that no document has


def stretch(e: Column, shapes: Column) -> Column:
    """groups (as `a1,a2|b1;a3|b2,b3`), links (A's id * 2^32 + B's id of each pair whose bytes overlap) and n (groups) of a stretch's tokens."""
    ids, of = e["tokens"], shapes[e["shapes"]]
    texts = F.concat(ids.cast("array<string>"), F.array(*map(F.lit, SIGNS)))
    groups = let(texts, lambda t: F.array_join(F.transform(of["spelling"], lambda k: t[k]), ""))
    links = F.zip_with(of["a"], of["b"], lambda i, j: F.shiftleft(ids[i].cast("long"), 32).bitwiseOR(ids[j].cast("long")))
    return F.struct(groups.alias("groups"), links.alias("links"), of["n"].alias("n"))


def aligned(blocks: DataFrame) -> DataFrame:
    """One row a document of tokens(): id, n_a, n_b, n_groups, groups and links, both in order, as stretch() says."""
    known, docs = F.col("known"), F.arrays_zip("ids", "codes", "n_a", "n_b")

    def document(d: Column) -> Column:
        of = lambda field: F.transform(d["codes"], lambda c: known[c][field])
        n = F.aggregate(d["codes"], F.lit(0).cast("long"), lambda s, c: s + known[c]["n"])
        return F.struct(d["ids"].alias("id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), n.alias("n_groups"), F.array_join(of("groups"), ";").alias("groups"), F.flatten(of("links")).alias("links"))

    # each step's arrays are a column of their own, so that the next reads them packed
    shaped = blocks.withColumn("known", F.transform(F.arrays_zip("a_ends", "b_ends"), shape))
    filled = shaped.withColumn("known", F.transform(F.arrays_zip("tokens", "shapes"), lambda e: stretch(e, known)))
    return filled.select(F.inline(F.transform(docs, document)))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (rows that have it in links) and best (whether n is the highest of the pair's A id)."""
    counts = Table(rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    highest = counts.df.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    out = Table(counts.df.join(highest, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")))
    counts.drop()
    return out.df


def _floor(pairs: DataFrame, at_most: int) -> int:
    """The least power of 2 so that at most at_most pairs have a count as high."""
    sizes = {r["e"]: r["count"] for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()}  # 63 rows at most
    e, left = max(sizes, default=0) + 1, at_most
    while e > 0 and sizes.get(e - 1, 0) <= left:
        e -= 1
        left -= sizes.get(e, 0)
    return 1 << e


def scored(rows: DataFrame, pairs: DataFrame, row: str = "row", frequent: int = FREQUENT) -> DataFrame:
    """row (a unique number), n_best and count_sum over its links; rows without links are left out.

    The pairs of the highest counts, frequent at most, are broadcast, which meets
    most links where they are; what is left is added up by row and pair and
    then joined, with no pair that very many rows have.
    """
    floor = _floor(pairs, frequent)
    often = F.broadcast(pairs.where(F.col("n") >= floor).select(F.col("pair").alias("p"), "n", "best"))
    met = rows.select(row, F.explode("links").alias("pair")).join(often, F.col("pair") == F.col("p"), "left")
    key = F.when(F.col("n").isNull(), F.col("pair")).alias("pair")
    sums = Table(met.groupBy(row, key).agg(F.count("*").alias("links"), F.coalesce(F.sum("n"), F.lit(0)).alias("count_sum"), F.count_if("best").alias("n_best")))
    seldom = sums.df.where("pair is not null").select(row, "pair", "links").join(pairs.where(F.col("n") < floor), "pair")
    rest = seldom.select(row, F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    return sums.df.where("pair is null").select(row, "n_best", "count_sum").unionAll(rest).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose count is the highest of their A id in the corpus;
    count_sum: the counts of all links.  A pair's count is of documents, and
    every row is one.  Documents without tokens (see tokens()) have zeros and ''.
    """
    rows = aligned(tokens(docs, first, second, id_col, text))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    made = rows.select(F.monotonically_increasing_id().alias("row"), "id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "links")
    held = Table(made, compression="zstd")
    sums = scored(held.df, pair_counts(held.df))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return held.df.drop("links").join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
