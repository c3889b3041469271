"""Problem 9: the reading level of each document.

Whole texts are measured (length, vocabulary, syntax, cohesion distributions), the
measures are standardised within each language over all documents, and gradient-boosted
regression trees learn the grade (easy 0, middle 1, hard 2) from labelled documents.
Models are cross-validated by source: documents of one source are graded by a model that
saw none of it, and the two limits between the bands are set on those grades. An isotonic
regression of the labels on them calibrates the grades that come out (for the measured
error, one that saw none of the source either); it only rises, so the limits hold for
calibrated grades as well.

The labelled rows used for training are bounded by ``max_labels`` (a seeded sample by
hash where there are more); everything else covers all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut

MAX_LABELS = 8_000
BANDS = {"easy": 0.0, "middle": 1.0, "hard": 2.0}
FEATURES = (
    "sentence_mean", "sentence_sd", "sentence_q25", "sentence_q50", "sentence_q75", "sentence_q90", "short_sentences",
    "long_sentences", "word_mean", "word_q90", "long_words", "very_long_words", "short_words", "variety", "rare_share",
    "clauses", "clause_words", "links", "cohesion", "words_by_length",
)

# fixed values: words that tell the language, and words that link clauses
_STOP = {
    "en": frozenset("the of and to in is was for with that by on as this from".split()),
    "de": frozenset("der die das und ist den mit von ein eine nicht sich auf im zu".split()),
    "es": frozenset("el la los las de que y en un una por con se del para".split()),
}
_LINKS = frozenset(
    "because although while whereas since unless until whereby insofar inasmuch notwithstanding that which who when once if after before "
    "weil obwohl während da dass welche welcher wenn damit sobald bevor nachdem indem insofern wodurch wobei "
    "porque aunque mientras cuando que cual donde si pues puesto conforme siempre toda vez".split()
)
_LINKS_ZH = re.compile("因为|所以|虽然|但是|不过|由于|从而|进而|继而|鉴于|相较于|基于|之于|以便|只是|由此|在于|亟须|并据此")
_FRONT = re.compile(r"\A---\n.*?\n---\n", re.S)
_DROP = re.compile(r"<!--[^>]*-->|^[ \t]*#[^\n]*$|\[\[[^\]\n]*\]\]|^[ \t]*\|[^\n]*$|^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", re.M)
_END = re.compile(r"[.!?。！？]+|\n\s*\n|\n")
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[,;:，；：、]")
_ZH = re.compile(r"[一-鿿]")


def language(words: list[str], signs: int, chars: int) -> str:
    """The language a text is written in, from its own words, whatever it is said to be."""
    if signs * 3 > chars:
        return "zh"
    seen = Counter(words)
    score = {k: sum(seen[w] for w in stop) for k, stop in _STOP.items()}
    best = max(score, key=lambda k: (score[k], k))
    return best if score[best] else "en"


def measure(text: str) -> tuple[str, list[float]] | None:
    """(language, measures) of a whole text; None if it has no words."""
    body = _DROP.sub(" ", _FRONT.sub("", text)).lower()
    signs = len(_ZH.findall(body)) if not body.isascii() else 0
    zh = signs * 3 > len(body)
    sentences, all_words = [], []
    for part in _END.split(body):
        w = _ZH.findall(part) if zh else _WORD.findall(part)
        if w:
            sentences.append((part, w))
            all_words += w
    if not all_words:
        return None
    lang = "zh" if zh else language(all_words, signs, len(body))
    sizes = np.fromiter((len(w) for _, w in sentences), float, len(sentences))
    q = np.percentile(sizes, (25, 50, 75, 90))
    n = len(all_words)
    if zh:
        runs = [len(x) for part, _ in sentences for x in _CLAUSE.split(part) if x]
        lengths = np.asarray(runs or [0], float)
        bands = (18.0, 30.0, 9.0)
        links = len(_LINKS_ZH.findall(body))
    else:
        lengths = np.fromiter(map(len, all_words), float, n)
        bands = (7.0, 11.0, 3.0)
        links = sum(w in _LINKS for w in all_words)
    seen = Counter(all_words)
    marks = len(_CLAUSE.findall(body))
    content = [frozenset(w) if zh else frozenset(x for x in w if len(x) > 3) for _, w in sentences]
    overlap = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(content, content[1:])]
    # measures are weighed by words where sentences of one kind would drown the others
    weighed = float((sizes * sizes).sum() / n)
    by_length = float((lengths * lengths).sum() / max(1.0, lengths.sum()))
    return lang, [
        float(sizes.mean()), float(sizes.std()), *map(float, q), float(sizes[sizes < 8].sum() / n), float(sizes[sizes > 24].sum() / n),
        float(lengths.mean()), float(np.percentile(lengths, 90)), float((lengths >= bands[0]).mean()), float((lengths >= bands[1]).mean()),
        float((lengths <= bands[2]).mean()), len(seen) / np.sqrt(n), sum(c == 1 for c in seen.values()) / n, marks / len(sentences),
        n / (marks + len(sentences)), links / len(sentences), float(np.mean(overlap)) if overlap else 0.0, by_length + weighed / 10,
    ]


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, langs, rows = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = measure(text)
            if found:
                ids.append(i)
                langs.append(found[0])
                rows.append(found[1])
        flat = np.asarray(rows, np.float64).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), lists], ["doc_id", "language", "x"])


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, language, x): raw measures of every document that has words."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(_measures, "doc_id long, language string, x array<double>").dropDuplicates(["doc_id"])


def standardised(raw: DataFrame) -> DataFrame:
    """The measures as deviations from the mean of their language, over all documents."""
    k = len(FEATURES)
    stats = raw.groupBy("language").agg(
        F.array(*[F.avg(F.col("x")[j]) for j in range(k)]).alias("_m"), F.array(*[F.stddev_pop(F.col("x")[j]) for j in range(k)]).alias("_d"))
    z = F.zip_with(F.zip_with("x", "_m", lambda a, b: a - b), "_d", lambda a, b: F.when(b > 1e-9, a / b).otherwise(F.lit(0.0)))
    return raw.join(F.broadcast(stats), "language").select("doc_id", "language", z.alias("x"))  # four languages


class Trees:
    """Gradient-boosted regression trees of squared error over binned measures."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 8, shrink: float = 3.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.shrink = rounds, depth, rate, bins, least, shrink

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = np.quantile(x, np.linspace(0, 1, self.bins + 1)[1:-1], axis=0)
        binned = self._bin(x)
        self.base = float(y.mean())
        rest = y - self.base
        self.trees = []
        nodes, (n, f) = 2**self.depth - 1, binned.shape
        least = min(self.least, max(1, n // 6))
        for _ in range(self.rounds):
            feature, cut_at = np.zeros(nodes, int), np.full(nodes, self.bins)  # bins: all go left
            at = np.zeros(n, int)
            for level in range(self.depth):
                first, wide = 2**level - 1, 2**level
                local = at - first
                code = (local[:, None] * f + np.arange(f)) * self.bins + binned
                total = np.bincount(code.ravel(), np.repeat(rest, f), wide * f * self.bins).reshape(wide, f, self.bins).cumsum(axis=2)
                count = np.bincount(code.ravel(), minlength=wide * f * self.bins).reshape(wide, f, self.bins).cumsum(axis=2)
                s, c = total[:, :, -1:], count[:, :, -1:]
                gain = total**2 / (count + self.shrink) + (s - total) ** 2 / (c - count + self.shrink) - s**2 / (c + self.shrink)
                gain[(count < least) | (c - count < least)] = 0
                best = gain.reshape(wide, -1).argmax(axis=1)
                for k in range(wide):
                    if gain[k].reshape(-1)[best[k]] > 1e-9:
                        feature[first + k], cut_at[first + k] = divmod(int(best[k]), self.bins)
                at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut_at[at])
            leaf = at - nodes
            value = np.bincount(leaf, rest, 2**self.depth) / (np.bincount(leaf, minlength=2**self.depth) + self.shrink) * self.rate
            rest = rest - value[leaf]
            self.trees.append((feature, cut_at, value))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[:, j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, out, row = self._bin(x), np.full(len(x), self.base), np.arange(len(x))
        nodes = 2**self.depth - 1
        for feature, cut_at, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[row, feature[at]] > cut_at[at])
            out += value[at - nodes]
        return out


class Calibration:
    """A rising curve from raw grades to the labels they mean: isotonic regression (adjacent
    means out of order are pooled), straight between the middles of its steps."""

    def fit(self, grade: np.ndarray, y: np.ndarray) -> Calibration:
        order = np.argsort(grade, kind="stable")
        steps: list[list[float]] = []  # sum of labels, sum of grades, number
        for g, t in zip(grade[order].tolist(), y[order].tolist()):
            steps.append([t, g, 1.0])
            while len(steps) > 1 and steps[-2][0] * steps[-1][2] >= steps[-1][0] * steps[-2][2]:
                last = steps.pop()
                steps[-1] = [a + b for a, b in zip(steps[-1], last)]
        self.at = np.asarray([g / n for _, g, n in steps])
        self.means = np.asarray([t / n for t, _, n in steps])
        return self

    def __call__(self, grade: np.ndarray) -> np.ndarray:
        return np.interp(grade, self.at, self.means)


def _limits(grade: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The two limits between the bands: the middle of all limits that put, but for two in a
    hundred, as many labelled grades right as any; so a few wrong labels far from the gap
    between two bands don't draw the limit to them."""
    order = np.argsort(grade, kind="stable")
    g, t = grade[order], y[order]
    cuts = np.r_[g[:1] - 1, (g[1:] + g[:-1]) / 2, g[-1:] + 1]

    def between(a: float, b: float) -> float:
        right = np.r_[0, np.cumsum(t == a)] + (np.sum(t == b) - np.r_[0, np.cumsum(t == b)])
        inside = np.ones(len(cuts), bool)
        if (t == a).any() and (t == b).any():  # a limit lies between the middles of its bands
            low, high = np.median(g[t == a]), np.median(g[t == b])
            inside = (cuts >= min(low, high)) & (cuts <= max(low, high))
            if not inside.any():
                return float(low + high) / 2
        good = cuts[inside & (right >= right[inside].max() - 0.02 * np.sum((t == a) | (t == b)))]
        return float(good.min() + good.max()) / 2

    low, high = between(0.0, 1.0), between(1.0, 2.0)
    return (low, high) if low <= high else ((low + high) / 2,) * 2


class Grader:
    """The model, its calibration, the limits of its bands, and how well it did on sources it had
    not seen: by source, the number of labels, the share of bands that are right and the mean
    absolute error of the calibrated grade."""

    def fit(self, x: np.ndarray, y: np.ndarray, source: np.ndarray, folds: int = 5) -> Grader:
        names = sorted(set(source))
        fold = {s: k % folds for k, s in enumerate(names)}
        part = np.asarray([fold[s] for s in source])
        if len(set(part)) < 2:
            part = np.arange(len(y)) % max(2, min(folds, len(y)))
        grade = np.empty(len(y))
        for k in np.unique(part):
            held = part == k
            grade[held] = Trees().fit(x[~held], y[~held]).predict(x[held]) if (~held).any() else y.mean()
        self.calibration = Calibration().fit(grade, y)
        unseen = np.empty(len(y))
        for k in np.unique(part):
            held = part == k
            unseen[held] = Calibration().fit(grade[~held], y[~held])(grade[held]) if (~held).any() else grade[held]
        self.low, self.high = _limits(grade, y)
        self.trees = Trees().fit(x, y)
        right, off = self.band(grade) == y, np.abs(unseen - y)
        self.accuracy = {s: (int((source == s).sum()), float(right[source == s].mean()), float(off[source == s].mean())) for s in names}
        return self

    def grade(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated grades, bands)."""
        raw = self.trees.predict(x)
        return self.calibration(raw), self.band(raw)

    def band(self, grade: np.ndarray) -> np.ndarray:
        return np.where(grade < self.low, 0, np.where(grade > self.high, 2, 1))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the commonest known band of each document; a tie is no label."""
    known = labels.select("doc_id", F.lower(F.trim("band")).alias("band"), "annotator").where("doc_id is not null").distinct()
    known = known.where(F.col("band").isin(list(BANDS)))
    n = [F.sum((F.col("band") == b).cast("int")).alias(b) for b in BANDS]
    counted = known.groupBy("doc_id").agg(*n).withColumn("_m", F.greatest(*BANDS))
    y = F.when(F.col("easy") == F.col("_m"), 0.0).when(F.col("middle") == F.col("_m"), 1.0).otherwise(2.0)
    ties = sum((F.col(b) == F.col("_m")).cast("int") for b in BANDS)
    return counted.where(ties == 1).select("doc_id", y.alias("y"))


def train(z: DataFrame, docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Grader | None:
    """A grader, or None where there are no labels. At most ``max_labels`` labelled rows, the
    first by a hash of the id, come to the driver."""
    source = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source")).dropDuplicates(["doc_id"])
    ids = labelled(labels)
    rows = z.join(ids, "doc_id").join(source, "doc_id").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(max_labels)
    pdf = rows.select("doc_id", "x", "y", "source").toPandas()
    if not len(pdf):
        return None
    return Grader().fit(np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(float), pdf["source"].to_numpy(object))


def reading_levels(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[DataFrame, Grader | None]:
    """(levels, grader). ``levels``: (doc_id, language, grade, band) for every document that
    has words, by its whole text. Null ids and texts and texts without words have no
    level; a repeated id counts once; without labels every band is ``middle``."""
    z = cut(standardised(cut(measures(docs))))
    grader = train(z, docs, labels, max_labels)
    if grader is None:
        return z.select("doc_id", "language", F.lit(1.0).alias("grade"), F.lit("middle").alias("band")), None
    shared = z.sparkSession.sparkContext.broadcast(grader)
    names = np.asarray(list(BANDS), object)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                g, band = shared.value.grade(np.stack(batch["x"].to_numpy()))
                yield pd.DataFrame({"doc_id": batch["doc_id"], "language": batch["language"].astype(object), "grade": g, "band": names[band]})

    return z.mapInPandas(grade, "doc_id long, language string, grade double, band string"), grader
