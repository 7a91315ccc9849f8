"""Toxicity scores.

Method: a lexicon of terms and word stems, learned from labelled documents, is
held in a trie; its product with the Levenshtein automata of all terms is made
deterministic as words need it, so that one walk over a word finds every term it
spells or misspells.  Each hit is weighed by what the labelled documents say of
it, and by its context window: a term that is quoted and talked about counts
less than one that is hurled at someone.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, slices

_WORD = re.compile(r"\w+")
#: Labelled documents of each label that the lexicon is learned from at most.
TOXIC, CLEAN = 4000, 12_000
#: States of the automaton that a worker remembers at most; beyond, it starts anew.
STATES = 50_000
#: Letters of the shortest and longest stem; letters from which a term may be misspelt by one edit.
STEM, MISSPELT = (4, 8), 5
#: Share of words from which on a term is dense in a text; share of toxic documents from which on a term is taken though others explain them.
DENSE, COMMON = 0.007, 0.05
#: Least log odds of a term, and most clean documents with it for each toxic one.
ODDS, IMPURE = 3.0, 0.2
#: Share of a term's hits that are taken to be misspelt before any is seen, and least log odds of a misspelt hit that counts.
SLIPS, SURE = 0.02, 2.0
#: Words around a hit that are its context, and what its weight is multiplied by.
WINDOW, QUOTED, HURLED = 6, 0.1, 1.1
#: Words of talking about a word, and of address; both in the languages of the corpus.
ABOUT = frozenset("said says wrote called quote quoted quoting word term slur insult sagte schrieb nannte zitat wort beleidigung dit écrit mot terme insulte citation dijo escribió palabra término insulto cita".split())
ADDRESS = frozenset("you your youre ur du dich dein ihr sie tu te toi ton vous tú ti eres usted".split())
#: Closed quotations within a line; an opening mark without its closing one quotes nothing.
_QUOTED = re.compile('"[^"\n]*"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|‘[^’\n]*’')
_END = "$"  # of a whole word, in the lexicon
_DENSE = "+"  # before a term that counts only if DENSE of the text's words or more are hits of it


class Automaton:
    """Lexicon trie and Levenshtein automata as one automaton over letters.

    terms: a stem fits every word that begins with it, a term that ends in $
    fits the whole word.  A state is a set of (trie node, edits); it's numbered
    when a word first needs it.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.whole: list[str | None] = [None]
        self.edits: list[int] = [0]  # that the terms below a node allow
        for t in terms:
            word, node = t.removesuffix(_END), 0
            allowed = int(len(word) >= MISSPELT)
            self.edits[0] = max(self.edits[0], allowed)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.whole.append(None)
                    self.edits.append(0)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], allowed)
            if t.endswith(_END):
                self.whole[node] = t
            else:
                self.term[node] = t
        self.letters = {c for node in self.children for c in node}
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._number({(0, 0)}, {})
        self.dead = self._number(set(), {})

    def _number(self, nodes: set[tuple[int, int]], found: dict[str, int]) -> int:
        """The state of these nodes; found: stems that the word begins with, and edits."""
        todo, found = list(nodes), dict(found)
        nodes = set(nodes)
        while todo:  # a letter left out
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.edits[child] and (child, e + 1) not in nodes:
                    nodes.add((child, e + 1))
                    todo.append((child, e + 1))
        for node, e in nodes:
            t = self.term[node]
            if t is not None and e <= int(len(t) >= MISSPELT):
                found[t] = min(e, found.get(t, e))
        nodes = {(n, e) for n, e in nodes if self.children[n] or self.whole[n]}
        key = frozenset([*nodes, *(("found", t, e) for t, e in found.items())])
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append((frozenset(nodes), found))
            self.steps.append({})
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        nodes, found = self.sets[state]
        new: set[tuple[int, int]] = set()
        for node, e in nodes:
            for letter, child in self.children[node].items():
                if letter == c:
                    new.add((child, e))
                elif e < self.edits[child]:
                    new.add((child, e + 1))
            if e < self.edits[node]:
                new.add((node, e + 1))
        out = self.steps[state][c] = self._number(new, found)
        return out

    def find(self, word: str) -> dict[str, int]:
        """Terms that fit the word, and the edits.  Letters that no term has are all one letter to it."""
        if len(self.sets) > STATES:
            self._clear()
        state, dead, steps, letters = self.start, self.dead, self.steps, self.letters
        for c in word:
            try:
                state = steps[state][c]
            except KeyError:
                if c not in letters:
                    c = ""
                state = steps[state][c] if c in steps[state] else self._step(state, c)
            if state == dead:
                return {}
        nodes, found = self.sets[state]
        found = dict(found)
        for node, e in nodes:
            t = self.whole[node]
            if t is not None and e <= int(len(t) > MISSPELT):
                found[t] = min(e, found.get(t, e))
        return found


@dataclass
class Model:
    """Log odds: the bias, and for each term of an exact and of a misspelt hit."""

    bias: float = -6.0
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)

    def scorer(self):
        """A function from a text to (score, hits); a hit is (term, word, edits, times, weight)."""
        weights, bias = self.weights, self.bias
        automaton = Automaton(sorted({t.removeprefix(_DENSE) for t in weights}))

        find = automaton.find

        def score(text: str | None) -> tuple[float, list[tuple[str, str, int, int, float]]]:
            lower = (text or "").lower()
            words = _WORD.findall(lower)
            exact: dict[str, float] = {}
            near, hits = 0.0, []
            found = {w: t for w in set(words) if (t := find(w))}
            if found:
                many: Counter = Counter()
                quotes = [m.span() for m in _QUOTED.finditer(lower)]
                for w in words:
                    if w in found:
                        many.update(t for t, e in found[w].items() if not e)
                for word in sorted(found):
                    places = list(re.finditer(rf"(?<!\w){re.escape(word)}(?!\w)", lower))
                    context = max((_context(lower, m, quotes) for m in places), default=1.0)
                    for t, edits in found[word].items():
                        for term in (t, _DENSE + t):
                            if term not in weights or term[0] == _DENSE and (edits or many[t] < DENSE * len(words)):
                                continue
                            weight = context * weights[term][edits]
                            if edits:
                                near = max(near, weight)
                            else:
                                exact[term] = max(weight, exact.get(term, 0.0))
                            hits.append((term, word, edits, len(places), weight))
            total = bias + sum(exact.values()) + near
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, total)))), hits

        return score


def _context(text: str, hit: re.Match, quotes: list[tuple[int, int]]) -> float:
    """What a hit's weight is multiplied by; quotes: spans of closed quotations, in order."""
    lo, hi = max(0, hit.start() - 120), hit.end() + 120
    near = {*_WORD.findall(text[lo : hit.start()])[-WINDOW:], *_WORD.findall(text[hit.end() : hi])[:WINDOW]}
    k = bisect_right(quotes, (hit.start(), hit.start())) - 1
    if k >= 0 and hit.end() <= quotes[k][1] and near & ABOUT:
        return QUOTED
    return HURLED if near & ADDRESS else 1.0


def held_out(id_col: Column) -> Column:
    """Whether a document's label is kept from learning: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _terms(text: str) -> set[str]:
    """Words and stems of a text, and once more those that are dense in it."""
    count: Counter = Counter()
    words = Counter(_WORD.findall(text.lower()))
    for w, n in words.items():
        count[w + _END] += n
        for k in range(STEM[0], min(len(w), STEM[1]) + 1):
            count[w[:k]] += n
    least = DENSE * words.total()
    return {*count, *(_DENSE + t for t, n in count.items() if n >= least)}


def _counted(rows: DataFrame, found, schema: str) -> DataFrame:
    """Sums over rows (y, text) of what found(text) yields, by task; schema: term and more, then n long."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        of = found()
        for part in slices(batches, "text"):
            for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
                count.update((k, y) for k in of(text or ""))
            if len(count) > 200_000:
                yield from batches_of(count)
                count.clear()
        yield from batches_of(count)

    def batches_of(count: Counter) -> Iterator[pa.RecordBatch]:
        keys = list(count)
        for lo in range(0, len(keys), 50_000):
            some = keys[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string() if n == "term" else pa.int32()) for n, x in zip(names, zip(*some, strict=True), strict=False)), pa.array([count[k] for k in some], pa.int64())], names=names)

    return rows.mapInArrow(run, schema).groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled documents that aren't held out.

    At most TOXIC and CLEAN documents, those of the least hash of the id, are
    used, whole.  Of several labels of an id the largest counts; null labels and
    ids don't.  Terms are words and stems; one after another the term is taken
    that is in most toxic documents without an earlier term, if its log odds are
    high.  Terms that are looked into are in a hundredth of the toxic documents or
    more, so the sample bounds how many there are.  Without a toxic label the
    lexicon is empty.
    """
    known = labels.select(F.col(id_col).alias("_jl_id"), F.col(label).cast("int").alias("y")).where("_jl_id is not null and y is not null").where(~held_out(F.col("_jl_id"))).groupBy("_jl_id").agg(F.max("y").alias("y"))
    pick = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("_jl_id"), "_jl_id").limit(n)
    sample = Table(pick(1, TOXIC).unionAll(pick(0, CLEAN)))  # at most TOXIC + CLEAN rows, so it may be broadcast
    rows = Table(docs.select(F.col(id_col).alias("_jl_id"), F.col(text).alias("text")).join(F.broadcast(sample.df), "_jl_id").select("y", "text"))
    sample.drop()
    sizes = {r["y"]: r["count"] for r in rows.df.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        rows.drop()
        return Model()
    least = max(4, toxic // 100)
    often = _counted(rows.df.where("y = 1"), lambda: _terms, "term string, y int, n long").where(F.col("n") >= least)
    in_all = {r["term"]: r["n"] for r in often.collect()}
    pairs = _counted(rows.df.where("y = 0"), lambda: lambda x: _terms(x) & in_all.keys(), "term string, y int, n long")
    in_clean = {r["term"]: r["n"] for r in pairs.collect()}
    odds = lambda a, b: math.log((a + 0.1) / (toxic + 1)) - math.log((b + 0.1) / (clean + 1))
    names = [t for t, a in sorted(in_all.items()) if odds(a, in_clean.get(t, 0)) > ODDS and in_clean.get(t, 0) <= IMPURE * a]
    place = {t: k for k, t in enumerate(names)}
    in_toxic = [set(r["terms"]) for r in rows.df.where("y = 1").mapInArrow(_which(place), "terms array<int>").collect()]  # at most TOXIC rows
    # the terms, by what they newly explain
    members: list[set[int]] = [set() for _ in names]
    for d, found in enumerate(in_toxic):
        for k in found:
            members[k].add(d)
    # of terms in the same documents the purest, the plainest and the longest is the most particular
    heap = [(-len(members[k]), in_clean.get(names[k], 0), names[k][0] == _DENSE, names[k].endswith(_END), -len(names[k]), names[k], k) for k in range(len(names))]
    heapq.heapify(heap)
    open_docs, chosen = set(range(toxic)), []
    core = lambda t: t.strip(_DENSE + _END)
    while heap:
        n, *rest, k = heapq.heappop(heap)
        left, all_of = len(members[k] & open_docs), len(members[k])
        akin = any(core(t).startswith(core(names[k])) or core(names[k]).startswith(core(t)) for t in chosen)
        if left < least and (akin or all_of < max(4, COMMON * toxic)):
            continue
        if left >= least and -n != left:
            heapq.heappush(heap, (-left, *rest, k))
            continue
        chosen.append(names[k])
        open_docs -= members[k]
    hits = _counted(rows.df, lambda: _misspelt([t for t in chosen if t[0] != _DENSE]), "term string, y int, n long").collect()
    rows.drop()
    slips = {(r["term"], r["y"]): r["n"] for r in hits}
    weights = {}
    for t in chosen:
        a, b = len(members[place[t]]), in_clean.get(t, 0)
        near = math.log((slips.get((t, 1), 0) + SLIPS * a + 0.1) / (toxic + 1)) - math.log((slips.get((t, 0), 0) + 0.1) / (clean + 1))
        weights[t] = (odds(a, b), 0.0 if t[0] == _DENSE or near < SURE else near)
    return Model(math.log((toxic + 1) / (clean + toxic + 1)), weights)


def _which(place: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([[place[t] for t in _terms(x or "") if t in place] for x in part.column("text").to_pylist()], pa.list_(pa.int32()))], names=["terms"])

    return run


def _misspelt(terms: list[str]):
    """Terms that a text misspells and doesn't spell."""
    automaton = Automaton(sorted(terms))

    def of(text: str) -> set[str]:
        exact, near = set(), set()
        for w in set(_WORD.findall(text.lower())):
            for t, e in automaton.find(w).items():
                (near if e else exact).add(t)
        return near - exact

    return of


_HIT = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("word", T.StringType()), T.StructField("edits", T.IntegerType()), T.StructField("times", T.IntegerType()), T.StructField("weight", T.DoubleType())]))


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= threshold) and hits. No shuffle.

    Only the text is looked at; a null or empty one has no hit.
    """
    made = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("hits", _HIT)]
    rest = [f for f in docs.schema.fields if f.name not in {m.name for m in made}]
    names = [f.name for f in rest]
    kind = pa.list_(pa.struct([("term", pa.string()), ("word", pa.string()), ("edits", pa.int32()), ("times", pa.int32()), ("weight", pa.float64())]))
    bias, weights = model.bias, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Model(bias, weights).scorer()
        for part in slices(batches, text):
            found = [score(x) for x in part.column(text).to_pylist()]
            hits = pa.array([[dict(zip(("term", "word", "edits", "times", "weight"), h, strict=True)) for h in x[1]] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([x[0] for x in found], pa.float64()), pa.array([int(x[0] >= threshold) for x in found], pa.int32()), hits], names=[*names, *(m.name for m in made)])

    return docs.mapInArrow(run, T.StructType([*rest, *made]))


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that score as toxic; the columns stay."""
    return scored(docs, learn(docs, labels), **options).where("predicted = 0").select(*docs.columns)
