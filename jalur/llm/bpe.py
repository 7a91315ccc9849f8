"""Byte-level byte-pair encoding and decoding.

Method: a hierarchical-bitmap rank queue.  Each merge rank has a bucket of
positions in the linked list of parts; three levels of bitmaps, 64 ranks to a
word, tell which buckets hold something, and find-first-set walks down to the
least rank.  A position whose pair has changed since it was queued is stale and
skipped.  A pre-token of n bytes costs O(n log n) whatever its length.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Encoded pre-tokens, and words, of each generation that a worker remembers at most (some 200 bytes each).
PIECES, WORDS = 350_000, 50_000
#: A space before white space or at the end.
_ODD = re.compile(r" (?:\s|\Z)").search


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Remembered:
    """What was worked out for short keys, in two generations; the older one goes when the newer is full."""

    def __init__(self, make, at_most: int):
        self.make, self.at_most, self.new, self.old = make, at_most, {}, {}

    def find(self, key: str) -> bytes:
        if len(key) > 64:
            return self.make(key)
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self.new) >= self.at_most:
            self.old, self.new = self.new, {}
        self.new[key] = found
        return found


class Codec:
    """Encodes and decodes by ranks that hold every single byte.

    pattern splits a text into pre-tokens; merges never cross them.  It must let
    a pre-token start at every space that no white space follows, as those of the
    public tokenizers do, or else say words=0: then texts aren't cut at spaces
    first.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = PIECES, words: int = WORDS):
        import regex

        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        # \s is the White_Space property, without the separators U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        size = max(ranks.values(), default=0) + 1
        #: rank of each pair of bytes, or -1
        self.two = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        # bitmaps of the rank queue: a bit for each rank, for each word of low, and for each word of mid; empty between calls
        self.low, self.mid = [0] * ((size >> 6) + 1), [0] * ((size >> 12) + 1)
        self.pieces = Remembered(lambda piece: _packed(self.merge(piece.encode())), pieces)
        self.words = Remembered(lambda word: self._stretch(" " + word), words) if words else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, low, mid, top, get = len(piece), self.low, self.mid, 0, ranks.get
        end, before, pair = list(range(1, n + 1)), list(range(-1, n)), [-1] * n  # of the part that starts here
        buckets: dict[int, list[int]] = {}

        def push(rank: int, i: int) -> int:
            """The top bitmap, with position i in the bucket of its rank."""
            if rank in buckets:
                heappush(buckets[rank], i)
                return top
            buckets[rank] = [i]
            a = rank >> 6
            low[a] |= 1 << (rank & 63)
            mid[a >> 6] |= 1 << (a & 63)
            return top | 1 << (a >> 6)

        two = self.two
        for i in range(n - 1):
            rank = two[piece[i]][piece[i + 1]]
            if rank >= 0:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    a = rank >> 6
                    low[a] |= 1 << (rank & 63)
                    mid[a >> 6] |= 1 << (a & 63)
                    top |= 1 << (a >> 6)
        while top:
            b = (top & -top).bit_length() - 1
            x = mid[b]
            a = b << 6 | (x & -x).bit_length() - 1
            x = low[a]
            rank = a << 6 | (x & -x).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                x = low[a] = x & x - 1
                if not x:
                    x = mid[b] = mid[b] & mid[b] - 1
                    if not x:
                        top &= top - 1
            if pair[i] != rank:
                continue  # stale
            j = end[i]
            k = end[i] = end[j]
            pair[j] = pair[i] = -1
            if k < n:
                before[k] = i
                new = get(piece[i : end[k]])
                if new is not None:
                    pair[i] = new
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        a = new >> 6
                        low[a] |= 1 << (new & 63)
                        mid[a >> 6] |= 1 << (a & 63)
                        top |= 1 << (a >> 6)
            h = before[i]
            if h >= 0:
                new = get(piece[h:k])
                if new is None:
                    pair[h] = -1
                elif new != pair[h]:
                    pair[h] = new
                    top = push(new, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _stretch(self, stretch: str) -> bytes:
        known, find = self.pieces.new, self.pieces.find
        return b"".join([known.get(piece) or find(piece) for piece in self.split(stretch)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers, one after another.

        A pre-token always starts at a space that no white space follows, so the
        text is cut there and words seen before, with that space, are looked up.
        """
        if self.words is None:
            return self._stretch(text)
        known, find, words = self.words.new, self.words.find, text.split(" ")
        if not _ODD(text):
            out = [known.get(word) or find(word) for word in words[1:]]
            return b"".join([self._stretch(words[0]), *out])
        out, held = [], words[0]
        for word in words[1:]:
            if word and not word[0].isspace():
                out.append(self._stretch(held))
                held = " " + word
            else:
                held += " " + word
        return b"".join([*out, self._stretch(held)])

    def decode(self, ids: bytes | list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids))


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_codecs: dict[tuple, Codec] = {}


def codec(ranks_path: str, pattern: str, pieces: int = PIECES, words: int = WORDS) -> Codec:
    """One for each worker process; the rank file is installed on every machine."""
    key = (ranks_path, pattern, pieces, words)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(ranks_path), pattern, pieces, words)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None, pieces: int = PIECES, words: int = WORDS) -> DataFrame:
    """docs with the ids of every whole text, and if named the bytes they decode to.

    ids: binary, each id as four bytes, little-endian; as_array() makes numbers
    of them.  A null or empty text gives an empty value.  Repeated rows are
    encoded each.  There is no shuffle: rows stay where they are, and a lost
    executor costs its tasks alone.  pieces and words bound what a worker
    remembers.
    """
    made = [ids] + [decoded] * bool(decoded)
    rest = [f for f in docs.schema.fields if f.name not in made]
    schema = T.StructType([*rest, *(T.StructField(n, T.BinaryType()) for n in made)])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern, pieces, words)
        for part in slices(batches, text, 4 << 20):
            out = [c.encode(x or "") for x in part.column(text).to_pylist()]
            columns = [part.column(n) for n in names] + [pa.array(out, pa.binary())]
            if decoded:
                columns.append(pa.array([c.decode(x) for x in out], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """rows with the bytes that the ids of encode() stand for (null ids: null)."""
    rest = [f for f in rows.schema.fields if f.name != decoded]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for part in slices(batches, ids, 4 << 20):
            out = [None if x is None else c.decode(x) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(out, pa.binary())], names=[*names, decoded])

    return rows.mapInArrow(run, T.StructType([*rest, T.StructField(decoded, T.BinaryType())]))


def as_array(ids: str = "token_ids"):
    """The packed ids of a column as array<int>."""
    ids = F.col(ids)
    quads = F.sequence(F.lit(0), F.floor(F.octet_length(ids) / 4).cast("int") - 1)
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k + 1, F.lit(1))), 16, 10).cast("int")
    number = lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216
    return F.when(F.octet_length(ids) == 0, F.array().cast("array<int>")).otherwise(F.transform(quads, number))
