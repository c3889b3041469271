"""Problem 4: mapping freely typed values to a reference list.

Every entry of the list is kept under its normal form, words in order and words sorted,
in BK-trees under Levenshtein distance (a true metric); the triangle inequality prunes
subtrees, and a search returns every entry within the threshold. Values are searched
together: a node is compared with all values that still are in its subtree at once. The
list is broadcast when it is small (counted); a larger one is split into shards, each
value is searched in every shard and the winners of the shards are merged by cost, which
tells the stages apart, so the result does not depend on the number of shards. Distinct
typed values are searched once. Shortened and qualified forms (initials, cut words,
dropped vowels, a part that only one entry has, additions around an entry) are looked up
in hash indexes, an automaton and trees of the same kind when no entry is near; nothing
goes through the list entry by entry.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lookalike import learn, rewriter
from scriptorium.session import cut

VALUES_A_TASK = 5_000

# fixed values: words around a name that do not change what it names
ADDED = frozenset(
    "the a an our new my your for of and in on with old pilot draft final beta alpha test copy version rev "
    "project programme program phase edition ver".split()
)
ADDED_ZH = ("试点", "二期", "一期", "三期", "校级", "区域", "全校", "我校", "本校", "平台", "系统", "新版", "新", "的", "草案", "草稿", "版本")
_WORD = re.compile(r"[一-鿿]+|[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_VERSION = re.compile(r"(?i)(?:\bv|\bver\.?|(?<=[一-鿿])v)\s*\d+(?:\.\d+)*|(?<![\w.])\d+\.\d+(?![\w.])")
_ZH = re.compile(r"[一-鿿]")
_VOWELS = str.maketrans("", "", "aeiou")


def _masks(pattern: str) -> dict[str, int]:
    """Where each character stands in a pattern, as bits."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def levenshtein(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Myers' bit-parallel distance; ``masks`` of ``b``, where many are measured against it."""
    if not b:
        return len(a)
    get = (_masks(b) if masks is None else masks).get
    full, last = (1 << len(b)) - 1, 1 << (len(b) - 1)
    pv, mv, score = full, 0, len(b)
    for ch in a:
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = ph << 1 | 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
    return score


class Words:
    """Many strings, longest first, as a matrix of small numbers, to be measured together."""

    def __init__(self, texts: list[str]):
        self.order = np.asarray(sorted(range(len(texts)), key=lambda k: -len(texts[k])), dtype=np.int64)
        self.sizes = np.asarray([len(texts[k]) for k in self.order], dtype=np.int64)
        self.code: dict[str, int] = {}
        self.signs = np.zeros((len(texts), int(self.sizes[0]) if len(texts) else 0), np.int32)
        for row, k in enumerate(self.order):
            self.signs[row, : len(texts[k])] = [self.code.setdefault(ch, len(self.code)) for ch in texts[k]]

    def distance(self, text: str, rows: np.ndarray) -> np.ndarray:
        """The Levenshtein distances of ``text`` to some rows, given in ascending order."""
        m = len(text)
        if not m:
            return self.sizes[rows]
        if m > 64:
            back = {n: ch for ch, n in self.code.items()}
            masks = _masks(text)
            return np.asarray([levenshtein("".join(back[n] for n in self.signs[r, : self.sizes[r]]), text, masks) for r in rows], dtype=np.int64)
        table = np.zeros(len(self.code) + 1, np.uint64)
        for i, ch in enumerate(text):
            if ch in self.code:
                table[self.code[ch]] |= np.uint64(1 << i)
        one, top = np.uint64(1), np.uint64(m - 1)
        sizes = self.sizes[rows]
        pv, mv = np.full(len(rows), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(rows), np.uint64)
        score = np.full(len(rows), m, np.int64)
        for j in range(int(sizes[0]) if len(rows) else 0):
            n = int(np.searchsorted(-sizes, -j, side="left"))  # rows longer than j stand first
            p, q, at = pv[:n], mv[:n], rows[:n]
            eq = table[self.signs[at, j]]
            xv = eq | q
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = q | ~(xh | p), p & xh
            score[:n] += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
            ph = (ph << one) | one
            pv[:n] = (mh << one) | ~(xv | ph)
            mv[:n] = ph & xv
        return score


class BKTree:
    """Strings with their payloads; ``near`` gives all within a distance."""

    def __init__(self):
        self.root: list | None = None  # [string, payloads, {distance: child}]
        self.longest = 0

    def add(self, text: str, payload) -> None:
        self.longest = max(self.longest, len(text))
        if self.root is None:
            self.root = [text, {payload}, {}]
            return
        node = self.root
        while True:
            d = levenshtein(text, node[0])
            if d == 0:
                node[1].add(payload)
                return
            if d not in node[2]:
                node[2][d] = [text, {payload}, {}]
                return
            node = node[2][d]

    def near(self, text: str, within: int) -> list[tuple[int, set]]:
        return self.near_all([text], [within])[0]

    def near_all(self, texts: list[str], within: list[int]) -> list[list[tuple[int, set]]]:
        """(distance, payloads) of every string of the tree within its distance, for each text."""
        found: list[list[tuple[int, set]]] = [[] for _ in texts]
        able = [k for k in range(len(texts)) if len(texts[k]) <= self.longest + within[k]]  # others are too long for any
        if self.root is None or not able:
            return found
        many = Words([texts[k] for k in able])
        radius = np.asarray(within, dtype=np.int64)[np.asarray(able)[many.order]]
        open_ = [(self.root, np.arange(len(able)))]
        while open_:
            (text, payloads, children), rows = open_.pop()
            d, r = many.distance(text, rows), radius[rows]
            for at in np.flatnonzero(d <= r):
                found[able[many.order[rows[at]]]].append((int(d[at]), payloads))
            for k, child in children.items():
                left = rows[np.abs(d - k) <= r]
                if len(left):
                    open_.append((child, left))
        return found


def words(text: str, added: bool = False) -> list[str]:
    """Lower-case words of a value; marks of version and, unless ``added``, words that say
    nothing are left out."""
    text = unicodedata.normalize("NFKC", text)
    if text.swapcase()[1:2].isupper() and text[:1].islower() and not text.isupper():
        pass  # inverted case has no camel humps
    elif not re.search(r"[a-z][A-Z]{2,}|\s[a-z][A-Z]", text):
        text = _CAMEL.sub(" ", text)
    text = _VERSION.sub(" ", text).lower()
    text = "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn")
    found = _WORD.findall(text)
    kept = [w for w in found if w not in ADDED]
    return found if added or not kept or all(len(w) == 1 for w in found) else kept


#: What an answer costs, by stage; a nearer entry costs its distance more.
EXACT, BARE, HELD, NEAR, INITIALS, SHORT, PART, NEAR_PART, NONE = 0, 1, 2, 10, 20, 21, 22, 30, 99


class Matcher:
    """One shard of the reference list."""

    def __init__(self, terms: list[tuple[int, str]]):
        self.tree, self.exact = BKTree(), defaultdict(set)
        self.part_tree, self.word_tree = BKTree(), BKTree()
        self.initials, self.parts = defaultdict(set), defaultdict(set)
        #: entries by number of words, place and word; words by what they are cut to; what typed words may mean
        self.places, self.cuts, self.meant = defaultdict(set), defaultdict(set), {}
        vocabulary: set[str] = set()
        self.held = ahocorasick.Automaton()
        zh: dict[str, set[int]] = {}
        for term_id, term in terms:
            w = words(term)
            if not w:
                continue
            plain, by_word = "".join(w), "".join(sorted(w))
            for form in {plain, by_word}:
                self.tree.add(form, term_id)
                self.exact[form].add(term_id)
            if _ZH.search(plain):
                zh.setdefault(plain, set()).add(term_id)
                continue
            if len(w) > 2:
                self.initials["".join(x[0] for x in w)].add(term_id)
            for k, x in enumerate(w):
                self.places[len(w), k, x].add(term_id)
                if x not in vocabulary:
                    vocabulary.add(x)
                    self.word_tree.add(x, x)
                    for n in range(3, len(x) + 1):
                        self.cuts[x[:n]].add(x)
                    self.cuts[x[0] + x[1:].translate(_VOWELS)].add(x)
                rest = w[:k] + w[k + 1 :]
                if len(rest) > 1:
                    for form in {"".join(rest), "".join(sorted(rest))}:
                        self.parts[form].add(term_id)
                        self.part_tree.add(form, form)
        for form, ids in zh.items():
            self.held.add_word(form, ids)
        if zh:
            self.held.make_automaton()
        self.zh = bool(zh)

    def find(self, typed: str) -> tuple[int, set[int]]:
        return self.find_all([typed])[0]

    def find_all(self, typed: list[str]) -> list[tuple[int, set[int]]]:
        """(cost, entries of that cost) of each value; NONE and an empty set if none is meant."""
        asked = [(tuple(words(x)), not x.strip().islower()) for x in typed]
        distinct = list(dict.fromkeys(asked))
        answers: dict[tuple, tuple[int, set[int]]] = {}
        open_: list[tuple] = []
        for key in distinct:
            answer = self._known(key[0])
            if answer:
                answers[key] = answer
            else:
                open_.append(key)
        for most in (1, 2, 4):  # a small ball prunes more, and most values are near
            ask = [(k, form) for k in open_ if self._radius(k[0]) >= most for form in self._forms(k[0])]
            near = self.tree.near_all([f for _, f in ask], [most] * len(ask))
            best: dict[tuple, tuple[int, set[int]]] = {}
            for (k, _), found in zip(ask, near):
                for d, ids in found:
                    old = best.get(k, (NONE, set()))
                    if NEAR + d <= old[0]:
                        best[k] = (NEAR + d, ids | old[1] if NEAR + d == old[0] else set(ids))
            answers |= best
            open_ = [k for k in open_ if k not in best]
        left = []
        self._meet({x for w, _ in open_ if len(w) > 1 for x in w})
        for key in open_:
            answer = self._shortened(*key)
            if answer:
                answers[key] = answer
            elif len(key[0]) > 1 and len("".join(key[0])) >= 12 and not _ZH.search("".join(key[0])):
                left.append(key)
        for key, found in zip(left, self.part_tree.near_all(["".join(w) for w, _ in left], [2] * len(left))):
            if found:
                answers[key] = (NEAR_PART, set().union(*(self.parts[f] for _, forms in found for f in forms)))
        return [answers.get(k, (NONE, set())) for k in asked]

    def _known(self, w: tuple[str, ...]) -> tuple[int, set[int]] | None:
        if not w:
            return NONE, set()
        plain = "".join(w)
        for form in (plain, "".join(sorted(w))):
            if form in self.exact:
                return EXACT, self.exact[form]
        if _ZH.search(plain):
            bare = _bare(plain)
            if bare in self.exact:
                return BARE, self.exact[bare]
            held = set().union(*(ids for _, ids in self.held.iter(plain))) if self.zh else set()
            if held:
                return HELD, held
        return None

    @staticmethod
    def _forms(w: tuple[str, ...]) -> set[str]:
        plain = "".join(w)
        return {plain, _bare(plain)} if _ZH.search(plain) else {plain, "".join(sorted(w))}

    @staticmethod
    def _radius(w: tuple[str, ...]) -> int:
        plain = "".join(w)
        if _ZH.search(plain):
            return 1 if len(_bare(plain)) < 9 else 2
        return 1 if len(plain) < 9 else 2 if len(plain) < 14 else 4

    def _meet(self, typed: set[str]) -> None:
        """Finds for every typed word the words of the list it may be short for, or a slip of."""
        if len(self.meant) > 1_000_000:
            self.meant = {}
        new = sorted(typed - self.meant.keys())
        for x, found in zip(new, self.word_tree.near_all(new, [2] * len(new))):
            near = {y for d, ys in found for y in ys if len(y) > 4 or d == 0}
            self.meant[x] = near | (self.cuts.get(x, set()) if len(x) >= 3 else set())

    def _shortened(self, w: tuple[str, ...], loud: bool) -> tuple[int, set[int]] | None:
        plain = "".join(w)
        if _ZH.search(plain):
            return None
        if len(w) > 1 or loud:
            letters = plain if len(w) == 1 or all(len(x) == 1 for x in w) else ""
            if letters in self.initials:
                return INITIALS, self.initials[letters]
        if len(w) > 1:
            each = [set().union(*(self.places.get((len(w), k, y), set()) for y in self.meant[x])) for k, x in enumerate(w)]
            if found := set.intersection(*each):
                return SHORT, found
            for form in (plain, "".join(sorted(w))):
                if form in self.parts:
                    return PART, self.parts[form]
        return None


def _bare(plain: str) -> str:
    for x in ADDED_ZH:
        plain = plain.replace(x, "")
    return plain


def map_to_list(
    values: DataFrame, terms: DataFrame, value: str = "value", term: str = "term", term_id: str = "term_id",
    shard_terms: int = 20_000,
) -> DataFrame:
    """``(value, term_id)`` for every distinct non-null value; -1 if it means no entry, or
    two entries equally.

    Blank values are unmatched; null terms are ignored; an empty list leaves every value
    unmatched; of entries with one id the first counts. The list is split into shards of
    at most ``shard_terms`` entries, each broadcast as one object of bounded size.
    """
    spark = values.sparkSession
    typed = values.where(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct()
    looks = rewriter(learn(typed.unionByName(terms.select(F.col(term).alias("value")))), spark)
    # one search costs a millisecond and a value a few bytes: partitions are counted in rows
    typed = cut(typed.withColumn("form", looks("value")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-typed.count() // VALUES_A_TASK))
    typed = typed.repartition(parts)
    listed = terms.where(F.col(term).isNotNull() & F.col(term_id).isNotNull()).select(
        F.col(term_id).cast("long").alias("id"), looks(F.col(term)).alias("form")).distinct()
    shards = max(1, -(-listed.count() // shard_terms))
    winners = None
    for k in range(shards):
        shard = listed.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == k) if shards > 1 else listed
        rows = sorted((r["id"], r["form"]) for r in shard.collect())  # at most some shard_terms rows
        shared = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value)
            for batch in batches:
                if not len(batch):
                    continue
                found = matcher.find_all(batch["form"].tolist())
                yield pd.DataFrame({"value": batch["value"].astype(object), "cost": [c for c, _ in found],
                                    "ids": [sorted(ids) for _, ids in found]})

        part = typed.mapInPandas(search, "value string, cost int, ids array<long>")
        winners = part if winners is None else winners.unionByName(part)
    if shards > 1:
        best = winners.groupBy("value").agg(F.min("cost").alias("cost"))
        winners = winners.join(best, ["value", "cost"]).groupBy("value").agg(
            F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    return winners.select("value", F.when(F.size("ids") == 1, F.element_at("ids", 1)).otherwise(F.lit(-1)).cast("long").alias("term_id"))
