"""Benchmark passages in documents.

Method: a prefix-filtered set join at containment 1.  A window of an item is the
set of its word shingles; all of them must be in a document that holds the
window, so one of them, the rarest by the order of the item collection, is
prefix enough.  Documents are probed with these prefix shingles only; a hit is
a candidate if the window fits between the document's first and last word at
the offset of the shingle (length and positional bounds), and then the words
are compared.  Windows have the length of the item, or ten words if that is
less.

A benchmark of up to BLOCK_BYTES is sent to all tasks as it is.  A larger one is
joined: the order of shingles and the prefixes are worked out by shuffles, the
documents are read once, a bitmap of the prefix shingles' hashes leaves the few
places that can be one, and these meet the windows in a join that AQE can split.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, binary_texts, slices, text_key

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Word bytes are kept, every other byte parts words: all but ASCII letters, digits and what is beyond ASCII.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)
#: Items of so many bytes of text are sent to the executors as they are; a larger benchmark is joined.
BLOCK_BYTES = 8 << 20
#: Bits of the bitmap of prefix shingles (32 MB): with more shingles more places are verified, none is missed.
BITMAP = 1 << 28


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    return text.translate(_WORDS).split()


class Windows:
    """The distinct windows of some items, found by prefix shingle."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = 10, shingle: int = 5):
        self.shingle = shingle
        owners: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        for name, text in items:
            words = words_of(text)
            for i in range(max(len(words) - size, 0) + 1 if words else 0):
                owners[tuple(words[i : i + size])].add(name)
        self.owners = owners
        often = Counter(s for w in owners for s in set(self._shingles(w)))
        #: prefix shingle: (its offset, the window)
        self.prefix: dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...]]]] = defaultdict(list)
        for w in owners:
            tokens = self._shingles(w)
            at = min(range(len(tokens)), key=lambda i: (often[tokens[i]], tokens[i], i))
            self.prefix[tokens[at]].append((at, w))
        self.first = {s[0] for s in self.prefix}
        self.short = sorted({len(s) for s in self.prefix})

    def _shingles(self, window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
        k = min(self.shingle, len(window))
        return [window[i : i + k] for i in range(len(window) - k + 1)]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of words in windows, joined and in order; the items."""
        found, items, n, first = set(), set(), len(words), self.first
        # a shingle can only start where its first word stands
        for at in [i for i, w in enumerate(words) if w in first]:
            for k in self.short:
                for offset, window in self.prefix.get(tuple(words[at : at + k]), ()):
                    start = at - offset
                    if start >= 0 and start + len(window) <= n and tuple(words[start : start + len(window)]) == window:
                        found.add((start, start + len(window)))
                        items |= self.owners[window]
        spans: list[tuple[int, int]] = []
        for lo, hi in sorted(found):
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
        return spans, items - {None}


_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))]


def _probe(docs: DataFrame, text: str, items: list[tuple[str, bytes]], size: int) -> DataFrame:
    out = [f.name for f in _FOUND]
    rest = [f for f in docs.schema.fields if f.name not in out]
    names = [f.name for f in rest]
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, size)
        for part in slices(batches, text):
            n, spans, found = [], [], []
            for x in binary_texts(part.column(text)):
                words = words_of(x)
                s, i = windows.find(words)
                n.append(len(words))
                spans.append(s)
                found.append(sorted(i))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(found, pa.list_(pa.string()))], names=[*names, *out])

    return docs.mapInArrow(run, T.StructType([*rest, *_FOUND]))


def _windows(benchmark: DataFrame, item: str, text: str, size: int, shingle: int = 5) -> Table:
    """One row a distinct window: number, window (its words, spaced), names of its items, and its prefix: hash, words, place in the window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            names, found = [], []
            for name, x in zip(part.column("item").to_pylist(), binary_texts(part.column("text")), strict=True):
                words = words_of(x)
                some = {b" ".join(words[i : i + size]).decode("utf-8", "replace") for i in range(max(len(words) - size, 0) + 1 if words else 0)}
                names += [name] * len(some)
                found += some
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], names=["item", "window"])

    owners = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut, "item string, window string").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("names"))
    owners = Table(owners.withColumn("number", F.monotonically_increasing_id()))
    words = F.split("window", " ")
    k = F.least(F.lit(shingle), F.size(words))
    parts = owners.df.select("number", k.alias("k"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).alias("at", "s"))
    often = parts.select("number", "s").distinct().groupBy("s").agg(F.count("*").alias("n"))
    first = parts.join(often, "s").groupBy("number").agg(F.min(F.struct("n", "s", "at", "k")).alias("p")).select("number", F.xxhash64("p.s").alias("h"), "p.at", "p.k")
    return Table(owners.df.join(first, "number"))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bit h mod BITMAP for each hash; at most BITMAP / 64 rows come to the driver."""
    slot = F.pmod("h", F.lit(BITMAP))
    out = np.zeros(BITMAP >> 6, np.int64)
    rows = hashes.select(F.shiftright(slot, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(pmod(h, {BITMAP}) & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _joined(docs: DataFrame, windows: Table, size: int) -> DataFrame:
    """Of documents (_jl_id, _jl_text, _jl_words: the text) those with a window: spans, joined, and items."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_bitmap(windows.df.select("h")))
    ks = sorted(r["k"] for r in windows.df.select("k").distinct().collect())  # lengths of shingles, a handful
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "_jl_words"), T.StructField("h", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("lo", T.IntegerType()), T.StructField("near", T.StringType())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_jl_words"):
            row, found = [], []
            for r, x in enumerate(binary_texts(part.column("_jl_words"))):
                words = words_of(x)
                for k in ks:
                    if len(words) < k:
                        continue
                    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1)
                    slot = h % np.uint64(BITMAP)
                    for i in np.flatnonzero(bits.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).tolist():
                        lo = max(0, i - size)
                        row.append(r)
                        found.append((int(h[i : i + 1].view(np.int64)[0]), k, i, lo, b" ".join(words[lo : i + size + 1]).decode("utf-8", "replace")))
            keys = part.select(["_jl_id", "_jl_text"]).take(pa.array(row, pa.int64()))
            columns = zip(*found, strict=True) if found else ([],) * 5
            yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True))], names=schema.names)

    near = docs.mapInArrow(probe, schema)
    hits = near.join(windows.df.select("h", "k", "at", "window", "names"), ["h", "k"])
    # the window fits where its shingle stands, and its words are the document's
    n, start = F.size(F.split("window", " ")), F.col("place") - F.col("at")
    fits = (start >= F.col("lo")) & (F.array_join(F.slice(F.split("near", " "), F.greatest(start - F.col("lo") + 1, F.lit(1)), n), " ") == F.col("window"))
    spans = hits.where(fits).select("_jl_id", "_jl_text", F.array(start, start + n).alias("span"), "names")
    merged = spans.groupBy("_jl_id", "_jl_text").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("items"))
    return merged.select("_jl_id", "_jl_text", F.expr(_JOINED).alias("spans"), "items")


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (array of [start, end) word positions) and items (ids as strings, sorted).

    A window is size consecutive words of an item, or the whole of a shorter
    one; items without a word have none.  Windows of an item with a null id make
    spans, but its id is in no list.  Spans cover each word in any occurrence of
    any window.  An empty benchmark finds nothing.  A benchmark of over
    block_bytes is joined to the documents, which are read once for it.
    """
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    if total <= block_bytes:
        rows = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string"), F.col(item_text)).collect()
        return _probe(docs, text, [(name, x.encode()) for name, x in rows], size)
    rest = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    keyed = docs.select(*[F.col(c) for c in rest], F.col(doc_id).alias("_jl_id"), text_key(text).alias("_jl_text"))
    found = _joined(keyed.select("_jl_id", "_jl_text", F.col(text).alias("_jl_words")), _windows(benchmark, item_id, item_text, size), size)
    found = found.select(F.col("_jl_id").alias("_jl_id2"), F.col("_jl_text").alias("_jl_text2"), "spans", "items")
    none = _probe(keyed, text, [], size).drop("spans", "items")
    out = none.join(found, none["_jl_id"].eqNullSafe(F.col("_jl_id2")) & (none["_jl_text"] == F.col("_jl_text2")), "left")
    return out.select(*rest, "n_words", F.coalesce("spans", F.array().cast(_FOUND[1].dataType)).alias("spans"), F.coalesce("items", F.array().cast(_FOUND[2].dataType)).alias("items"))


#: Sorted spans with those that touch joined.
_JOINED = """aggregate(spans, cast(array() as array<array<int>>), (a, s) -> case
  when size(a) > 0 and s[0] <= element_at(a, -1)[1] then concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(s[1], element_at(a, -1)[1]))))
  else concat(a, array(s)) end)"""


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a window of an item; the columns stay."""
    return matches(docs, benchmark, **options).where(F.size("spans") == 0).select(*docs.columns)


def item_digest(items):
    """Lower-case hex SHA-256 of the ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


def brute_force(text: str | None, items: list[tuple[str, str | None]], size: int = 10) -> tuple[int, int, list[str]]:
    """Number of words, of hit words, and the items, by comparing every window at every place; for tests."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words, hit, names = cut(text), set(), set()
    for name, x in items:
        w = cut(x)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            window = w[i : i + size]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    names.add(name)
    return len(words), len(hit), sorted(names - {None})


def digest_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
