"""Problem 7: evaluation texts leaking into training text.

The normalised test items are put into one generalised suffix automaton. Every corpus
text is streamed through it word by word; the automaton's state and length give the
longest stretch of any item that ends at each word. Stretches that are long enough mark
the words of the items they come from (following suffix links, so an item that shares
only the end of a stretch is found too), and an item leaks if enough of it is marked.

Before streaming, each text's hashes of eight successive words are looked up in those of
the items: a text without one holds no stretch, so skipping it loses nothing.

The items are a stated query set: it is split into shards of a bounded number of bytes,
whose automata are broadcast as texts, built once in a worker and streamed over all
documents one after the other. Spans to be removed are gathered from all shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

from scriptorium.llm.wordrun import words

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of items in one automaton; it takes some two hundred times as much memory.
SHARD_BYTES = 1 << 20
#: The automata a worker holds, the last ones used.
_BUILT: dict = {}


class SuffixAutomaton:
    """Of several sequences of word ids; no stretch crosses from one into the next."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, position) whose whole prefix ends here
        for s, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].append((s, at))
        self.children: list[list[int]] = [[] for _ in self.next]
        for v in range(1, len(self.next)):
            self.children[self.link[v]].append(v)

    def _new(self, length: int, link: int, next_: dict[int, int]) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # the stretch is known from another sequence
            return self._split(last, word, q)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def positions(self, state: int) -> list[tuple[int, int]]:
        """Where the stretches of a state end in the sequences."""
        found, open_ = [], [state]
        while open_:
            v = open_.pop()
            found += self.ends[v]
            open_ += self.children[v]
        return found

    def stream(self, sequence: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) wherever a stretch of at least ``least`` ends."""
        state, length = 0, 0
        for at, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            if length >= least:
                yield at, state, length


class Leaks:
    """The automaton over the items, and what one text holds of them."""

    def __init__(self, items: list[tuple[int, str]], least_words: int = 8, least_signs: int = 12, cover: float = 0.4):
        self.least_words, self.least_signs, self.cover = least_words, least_signs, cover
        self.ids = [i for i, _ in items]
        texts = [words(t, markup=True) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t] for t in texts]
        signs = [sum("㐀" <= w <= "鿿" for w in t) for t in texts]
        #: the shortest stretch that counts, by item
        self.least = [least_signs if 2 * n > len(t) else least_words for n, t in zip(signs, texts)]
        self.sizes = [len(t) for t in texts]
        self.automaton = SuffixAutomaton(coded)
        self.window = min(self.least, default=least_words)
        hashes = [self._windows(np.asarray(c, np.uint64)) for c in coded]
        self.known = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)

    def _windows(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes) - self.window + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(self.window):
            out = out * _MIX + codes[k : k + n]
        return out ^ (out >> np.uint64(31))

    def screen(self, texts: list[str]) -> Iterator[tuple[int, list[int], list[str]]]:
        """(index, word codes, words) of the texts that share a window with some item."""
        get, at, codes, bounds, split = self.vocabulary.get, 0, [], [], []
        for text in texts:
            found = words(text, markup=True)
            coded = np.fromiter((get(w, 0) for w in found), np.uint64, len(found))
            codes.append(coded)
            split.append(found)
            bounds.append(at := at + len(found))
        if not at or not len(self.known):
            return
        hashed = self._windows(np.concatenate(codes))
        place = np.searchsorted(self.known, hashed)
        place[place == len(self.known)] = 0
        hit = np.flatnonzero(self.known[place] == hashed)
        for k in np.unique(np.searchsorted(bounds, hit, side="right")):
            yield int(k), codes[k].tolist(), split[k]

    def marked(self, codes: list[int]) -> dict[int, list[tuple[int, int, int]]]:
        """By item: (first, last) word of the item and last word of the text, of each stretch."""
        auto, out = self.automaton, {}
        for at, state, length in auto.stream(codes, self.window):
            v, size = state, length
            seen: set[tuple[int, int]] = set()
            while v > 0 and size >= self.window:
                for s, end in auto.positions(v):
                    if size >= self.least[s] and (s, end) not in seen:
                        seen.add((s, end))
                        out.setdefault(s, []).append((end - size + 1, end, at))
                v = auto.link[v]
                size = auto.length[v]
        return out

    def leaked(self, codes: list[int]) -> list[tuple[int, int, float]]:
        """(item id, words held, share of the item) of the items that leak into a text."""
        out = []
        for s, stretches in self.marked(codes).items():
            held = np.zeros(self.sizes[s], bool)
            for first, last, _ in stretches:
                held[first : last + 1] = True
            n = int(held.sum())
            if n >= self.cover * self.sizes[s] - 1e-9:
                out.append((self.ids[s], n, n / self.sizes[s]))
        return out


def _items(items: DataFrame, shard_bytes: int) -> list[list[tuple[int, str]]]:
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    out = []
    for k in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k) if shards > 1 else rows
        out.append(sorted((r["item_id"], r["text"]) for r in part.collect()))  # some ``shard_bytes`` on average
    return [x for x in out if x] or [[]]


def _built(token: str, shared, params: dict) -> Leaks:
    """The automaton of a broadcast shard, built once in a worker."""
    if token not in _BUILT:
        while len(_BUILT) > 1:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[token] = Leaks(shared.value, **params)
    return _BUILT[token]


def _over_shards(docs: DataFrame, items: DataFrame, shard_bytes: int, params: dict, make: Callable, schema: str) -> DataFrame:
    """``make(leaks, ids, texts)`` gives the columns of a batch; all shards, one after the other."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    names = StructType.fromDDL(schema).names
    out = None
    for part in _items(items, shard_bytes):
        shared, token = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            leaks_ = _built(token, shared, params)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(make(leaks_, batch.column(0).to_pylist(), batch.column(1).to_pylist()), names)

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def leaks(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES, **params) -> DataFrame:
    """``(doc_id, item_id, held, share)``: the items that leaked into each document.

    ``params`` are those of ``Leaks``. Null ids and texts are left out, empty texts hold
    nothing, copies of a document count each, rows delivered twice count once. Items too
    short for a stretch cannot leak.
    """
    def make(leaks_: Leaks, ids: list, texts: list[str]) -> list[pa.Array]:
        rows = [(ids[k], *leak) for k, codes, _ in leaks_.screen(texts) for leak in leaks_.leaked(codes)]
        columns = zip(*rows) if rows else ((), (), (), ())
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))]

    return _over_shards(docs, items, shard_bytes, params, make, "doc_id long, item_id long, held int, share double").distinct()


def removed(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES, **params) -> DataFrame:
    """``(doc_id, spans, words_removed, words_left, cleaned)`` for documents that hold leaked
    items: the normalised text without the stretches of the items that leaked into it. The
    stretches of all shards are gathered by document, at most a pair of positions a word."""
    def make(leaks_: Leaks, ids: list, texts: list[str]) -> list[pa.Array]:
        rows = []
        for k, codes, _ in leaks_.screen(texts):
            leaked = {i for i, _, _ in leaks_.leaked(codes)}
            gone = np.zeros(len(codes) + 2, np.int8)
            for s, stretches in leaks_.marked(codes).items():
                if leaks_.ids[s] in leaked:
                    for first, last, at in stretches:
                        gone[at - (last - first) + 1 : at + 2] = 1
            step = np.diff(gone)
            if leaked:
                rows.append((ids[k], np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
        columns = zip(*rows) if rows else ((), (), ())
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))]

    found = _over_shards(docs, items, shard_bytes, params, make, "doc_id long, first array<int>, after array<int>")
    found = found.groupBy("doc_id").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("after")).alias("after"))

    @pandas_udf("spans int, words_removed int, words_left int, cleaned string")
    def cut_out(texts: pd.Series, firsts: pd.Series, afters: pd.Series) -> pd.DataFrame:
        out = []
        for text, first, after in zip(texts, firsts, afters):
            found_ = words(text, markup=True)
            step = np.zeros(len(found_) + 1, np.int64)
            np.add.at(step, np.asarray(first, np.int64), 1)
            np.add.at(step, np.asarray(after, np.int64), -1)
            gone = np.cumsum(step)[:-1] > 0
            left = [w for w, g in zip(found_, gone) if not g]
            out.append((int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1)), int(gone.sum()), len(left), " ".join(left)))
        return pd.DataFrame(out, columns=["spans", "words_removed", "words_left", "cleaned"])

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(found, "doc_id")
    return texts.distinct().select("doc_id", cut_out("text", "first", "after").alias("_c")).select("doc_id", "_c.*")
