"""Problem 6: near-duplicate records with small edits.

Every text gets a fingerprint of 256 bits whose Hamming distances follow the share of
common word runs. Pairs that meet in a block (a band of minhashes, or a key of a file
name) are compared through a pivot table: each row's distances to reference
fingerprints of its block are computed once, a pair whose coordinates differ by more
than the radius at any pivot cannot be within the radius and is discarded, survivors
are compared by fingerprint and verified on the texts. Pivot tables alone would still
look at all pairs of the collection, and distances between unrelated texts concentrate
so that far pivots discard nothing; hence the blocks, and pivots drawn from the block.

Exact copies are collapsed first. Blocks of more than ``BLOCK_ROWS`` rows (counted with
map-side combine) are cut into chunks, and every pair of chunks is its own group of at
most twice that many rows, so no block is ever collected in one task and none is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType

from scriptorium.llm import filenames
from scriptorium.llm.components import connected_components
from scriptorium.llm.lookalike import Looks
from scriptorium.llm.wordrun import word_hashes
from scriptorium.session import BROADCAST_ROWS, cut

BITS = 256
BANDS, ROWS = 50, 5
BLOCK_ROWS = 2_000
#: Neighbouring letters two slips can change, in two words: three go and three come each.
NAME_RADIUS = 12
NAME_BITS = 128
#: Rows of blocks one task takes on average: 48 bytes each.
PART_ROWS = 500_000
PIVOTS = 4
_RNG = np.random.default_rng(20240601)
_A = (_RNG.integers(0, 2**32, BITS, dtype=np.uint64) | 1).astype(np.uint32)
_SPACE = np.empty((64, 512), np.uint32)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def runs(text: str, size: int = 3) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` consecutive words, ascending."""
    return np.unique(_runs(word_hashes(text), size))


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ (h[k : k + n] * _M[k % 3])) * _M[(k + 1) % 3]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def sketch(found: np.ndarray) -> np.ndarray:
    """256 minhashes of a set of run hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BITS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):  # blocks that stay in the processor's cache
        part = x[at : at + 512]
        for k in range(0, BITS, 64):
            mixed = _SPACE[:, : len(part)]
            np.multiply(_A[k : k + 64, None], part, out=mixed)
            np.minimum(least[k : k + 64], mixed.min(axis=1), out=least[k : k + 64])
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    """The keys of the bands of each row of minhashes."""
    h = least[:, : BANDS * ROWS].astype(np.uint64).reshape(len(least), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _M[0], (len(least), 1))
    for k in range(ROWS):
        key = (key ^ (h[:, :, k] + _M[1])) * _M[2]
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _bits(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit of each minhash, and another, a row each."""
    mixed = least * np.uint32(0x9E3779B1)
    return tuple(np.packbits((mixed >> np.uint32(k)).astype(np.uint8) & 1, axis=1) for k in (31, 27))


_SKETCHES = pa.schema([("id", pa.int64()), ("copy_of", pa.binary()), ("fp", pa.binary()), ("more", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _prefix(found: np.ndarray, least: float) -> np.ndarray:
    """The smallest run hashes of a set, so many that two sets with the share ``least`` in common
    have one of them in common: what is left is fewer than the runs that must be common."""
    x = np.unique(found)
    return x[: len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1].view(np.int64)


def _sketches(size: int, exact: float | None = None) -> Callable:
    """``exact``: the share of common runs from which no pair may be missed; keys are then prefixes in place of bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, least, keys = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = word_hashes(text)
                found = _runs(h, size)
                if len(found):
                    ids.append(i)
                    copies.append(xxhash.xxh128_digest(h.tobytes()))
                    least.append(sketch(found))
                    if exact is not None:
                        keys.append(_prefix(found, exact))
            if not ids:
                continue
            least = np.stack(least)
            flat = _bands(least).ravel() if exact is None else np.concatenate(keys)
            ends = np.arange(0, len(flat) + 1, BANDS) if exact is None else np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            fps, more = ([x.tobytes() for x in part] for part in _bits(least))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.binary()), pa.array(fps, pa.binary()), pa.array(more, pa.binary()), lists], schema=_SKETCHES)

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int16)  # signed: differences are taken


def _block_pairs(key: np.ndarray, ids: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids within ``radius`` in each run of equal keys (rows are sorted by key).
    side: 0 and 1 in a group of two different chunks, where only pairs across count; else 2.

    Rows of a block are ordered by the distance to its first pivot, so that a row meets only
    rows within ``radius`` of it on that coordinate; the other coordinates are tested next."""
    n = len(key)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[new, n])
    order = np.lexsort((_distance(fp, fp[np.repeat(new, lengths)]), key))
    key, ids, side, fp = key[order], ids[order], side[order], fp[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[new, n])
    start, length = np.repeat(new, lengths), np.repeat(lengths, lengths)
    many = np.flatnonzero(length > 1)
    table = np.zeros((PIVOTS, n), np.int16)
    for k in range(PIVOTS):  # the pivot table: distances to reference fingerprints of the block
        pivot = start[many] + (length[many] * k) // PIVOTS
        table[k, many] = _distance(fp[many], fp[pivot])
    one, two, open_, d = [], [], many, 1
    while len(open_):
        open_ = open_[open_ + d < start[open_] + length[open_]]
        open_ = open_[table[0, open_ + d] - table[0, open_] <= radius]
        i = open_
        for k in range(1, PIVOTS):
            i = i[np.abs(table[k, i] - table[k, i + d]) <= radius]
        i = i[(side[i] != side[i + d]) | (side[i] == 2)]
        i = i[_distance(fp[i], fp[i + d]) <= radius]
        one.append(ids[i])
        two.append(ids[i + d])
        d += 1
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (one, two))
    keep = a != b
    return np.minimum(a, b)[keep], np.maximum(a, b)[keep]


def _fixed(column: pa.ChunkedArray) -> np.ndarray:
    """Fingerprints of one length as rows of words, without a copy for each."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2], np.uint64)[ends[0] // 8 : ends[-1] // 8].reshape(len(flat), -1)


def _reduce(radius: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole blocks are in one partition, of some ``PART_ROWS`` rows."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        ids, side, fp = table.column("id").to_numpy()[order], table.column("side").to_numpy()[order], _fixed(table.column("fp"))[order]
        a, b = _block_pairs(key, ids, side, fp, radius)
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], ["a", "b"])

    return run


def candidate_pairs(rows: DataFrame, radius: int, block_rows: int = BLOCK_ROWS, expected: int = 0) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of ids that share a key and whose fingerprints are within
    ``radius``. ``rows``: (key long, id long, fp binary, as long in all rows, in words of 64 bits), some ``expected`` of them."""
    spark = rows.sparkSession
    # keys are first counted in coarse classes, which combine on the map side to few rows; only
    # in classes that are large enough to hold a large block are keys counted one by one
    coarse = F.pmod("key", F.lit(max(1 << 16, expected // 64)))
    large = cut(rows.groupBy(coarse.alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows).select("_k"))
    few = large.count()
    hot = rows.where(F.lit(False)).select("key", F.lit(0).cast("long").alias("_n"))
    if few:
        some = rows.withColumn("_k", coarse).join(F.broadcast(large) if few <= BROADCAST_ROWS else large, "_k", "left_semi")
        hot = cut(some.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows))
    plain = rows.withColumn("side", F.lit(2))
    if few and not hot.isEmpty():
        few = hot.count() <= BROADCAST_ROWS
        hint = F.broadcast if few else (lambda x: x)
        plain = plain.join(hint(hot.select("key")), "key", "left_anti")
        cut_up = rows.join(hint(hot), "key").withColumn("_of", F.ceil(F.col("_n") / block_rows).cast("long"))
        cut_up = cut_up.withColumn("_c", F.pmod(F.xxhash64("id"), F.col("_of")))
        cut_up = cut_up.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
        group = F.xxhash64("key", F.least("_c", "_o"), F.greatest("_c", "_o"), F.lit("chunks"))
        side = F.when(F.col("_c") == F.col("_o"), 2).when(F.col("_c") < F.col("_o"), 0).otherwise(1)
        plain = plain.select("key", "id", "fp", "side").unionByName(
            cut_up.select(group.alias("key"), "id", "fp", side.alias("side")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), expected // PART_ROWS)
    return plain.select("key", "id", "fp", "side").repartition(parts, "key").mapInArrow(_reduce(radius), "a long, b long").distinct()


def near_texts(
    texts: DataFrame, key: str, text: str, size: int = 5, least: float = 0.8, at_least: bool = True, radius: int | None = None, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(links, members). ``links``: (a, b, similarity), a < b, pairs of representatives whose
    texts have the share ``least`` of their distinct runs of ``size`` words in common
    (``at_least``: or just that share); ``members``: (rep, id), every id with the smallest
    id whose words are the same. Ids are longs.

    Null keys and texts, and texts of fewer than ``size`` words, are left out; an id
    delivered again with the same text counts once. Empty input gives empty results.
    Blocks are bands of 5 minhashes, 50 of them: pairs of similarity 0.65, 0.7 and 0.8
    are missed with probability 2e-3, 1e-4 and below 1e-8, one just above 0.55 with 7.6e-2.
    ``exact``: blocks are the runs of a prefix of each text (some 45 % of its runs at 0.55)
    and no pair of a block is discarded by fingerprint, so none is missed; many times the work.
    """
    def above(p: float) -> int:  # four standard deviations above the mean distance at the threshold
        return int(np.ceil(BITS * p + 4 * np.sqrt(BITS * p * (1 - p))))

    if radius is None:
        radius = BITS if exact else above((1 - least) / 2)
    docs = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    made = cut(docs.mapInArrow(_sketches(size, least if exact else None), "id long, copy_of binary, fp binary, more binary, bands array<long>"))
    reps = made.groupBy("copy_of").agg(F.min("id").alias("rep"))
    members = cut(made.select("copy_of", "id").distinct().join(reps, "copy_of").select("rep", "id"))
    copies = members.where("rep <> id").select("id").distinct()
    keyed = made.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "id", "left_anti")
    rows = keyed.select("id", "fp", F.explode("bands").alias("key"))
    pairs = cut(candidate_pairs(rows.select("key", "id", "fp"), radius, expected=made.agg(F.sum(F.size("bands"))).first()[0] or 0))
    if exact:
        return verify_texts(pairs, docs, size, least, at_least), members
    # two bits of each minhash tell unequal minhashes apart in three of four cases
    bits = keyed.select("id", "fp", "more")
    for c in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("id").alias(c), F.col("fp").alias(f"{c}1"), F.col("more").alias(f"{c}2")), c)
    pairs = cut(pairs.where(_unequal("a1", "a2", "b1", "b2") <= above((1 - least) * 0.75)).select("a", "b").distinct())
    return verify_texts(pairs, docs, size, least, at_least), members


@pandas_udf(IntegerType())
def _unequal(a1: pd.Series, a2: pd.Series, b1: pd.Series, b2: pd.Series) -> pd.Series:
    if not len(a1):
        return pd.Series([], dtype="int32")
    a1, a2, b1, b2 = (np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1) for x in (a1, a2, b1, b2))
    return pd.Series(np.bitwise_count((a1 ^ b1) | (a2 ^ b2)).sum(axis=1).astype(np.int32))


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """How many values two ascending arrays of distinct values share."""
    both = np.concatenate([p, q])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def verify_texts(pairs: DataFrame, docs: DataFrame, size: int, least: float, at_least: bool) -> DataFrame:
    """The pairs whose texts have enough runs in common. Only texts of some pair are moved."""
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    hint = F.broadcast if ids.count() <= BROADCAST_ROWS else (lambda x: x)
    some = docs.join(hint(ids), "id", "left_semi").dropDuplicates(["id"])

    @pandas_udf(BinaryType())
    def runs_of(texts: pd.Series) -> pd.Series:
        # 32 bits of each run's hash: one pair in some 25,000 is off by one run
        return texts.map(lambda x: _distinct((_runs(word_hashes(x), size) >> np.uint64(32)).astype(np.uint32)).tobytes())

    @pandas_udf(DoubleType())
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = _common(p, q)
            out.append(both / (len(p) + len(q) - both))
        return pd.Series(out, dtype=float)

    some = cut(some.select("id", runs_of("text").alias("runs")))  # each text is read once, whatever its pairs
    if pairs.count() <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    joined = pairs.join(some.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(
        some.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    found = joined.select("a", "b", share("ra", "rb").alias("similarity"))
    return found.where(F.col("similarity") >= least if at_least else F.col("similarity") > least)


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b): the links with copies written out."""
    one = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    two = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(one, "a").join(two, "b").select("x", "y")
    copied = members.groupBy("rep").agg(F.count("*").alias("_n")).where("_n > 1").select("rep")
    within = members.join(copied, "rep", "left_semi")
    same = within.withColumnRenamed("id", "x").join(within.withColumnRenamed("id", "y"), "rep").where("x < y").select("x", "y")
    return across.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


class _Bits(dict):
    def __missing__(self, pair: str) -> int:
        bit = self[pair] = 1 << (filenames._HASH[pair] % NAME_BITS)
        if len(self) > 500_000:
            self.clear()
        return bit


_BIT = _Bits()


@pandas_udf(BinaryType())
def _bigram_bits(forms: pd.Series) -> pd.Series:
    def one(form: str) -> bytes:
        bits = 0
        for word in form.split(" "):
            for k in range(len(word)):
                bits |= _BIT[word[k - 1] + word[k]]
        return bits.to_bytes(NAME_BITS // 8, "little")

    return forms.map(one)


@pandas_udf(ArrayType(LongType()))
def name_keys(forms: pd.Series) -> pd.Series:
    return forms.map(lambda x: list(dict.fromkeys(filenames.keys(x))))


@pandas_udf(BooleanType())
def same_name(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([filenames.same(x, y) for x, y in zip(a, b)], dtype=bool)


def name_forms(uploads: DataFrame, key: str, name: str) -> DataFrame:
    """(id, form): the normal form of every named row; rows without a name or a form are left out."""
    named = uploads.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(name).alias("name")).distinct()
    shared = named.sparkSession.sparkContext.broadcast(Looks.universal())

    @pandas_udf(StringType())
    def form(names: pd.Series) -> pd.Series:
        table = shared.value
        return names.map(lambda x: filenames.normal(x, table))

    # as if not deterministic: else the filter, and the function with it, would also run below the distinct
    return named.select("id", form.asNondeterministic()("name").alias("form")).where("form <> ''")


def name_links(forms: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct forms' smallest ids whose names differ by slips. ``forms``: (rep, form)."""
    made = cut(forms.select(name_keys("form").alias("keys"), F.col("rep").alias("id"), _bigram_bits("form").alias("fp")))
    rows = made.select(F.explode("keys").alias("key"), "id", "fp")
    pairs = cut(candidate_pairs(rows, radius=NAME_RADIUS, expected=made.count() * 16))
    named = pairs.join(forms.select(F.col("rep").alias("a"), F.col("form").alias("fa")), "a").join(
        forms.select(F.col("rep").alias("b"), F.col("form").alias("fb")), "b")
    return named.where(same_name("fa", "fb")).select("a", "b")


def name_groups(uploads: DataFrame, key: str, name: str) -> DataFrame:
    """(rep, id): the ids of near-duplicate file names, grouped under the group's smallest id."""
    forms = cut(name_forms(uploads, key, name))
    reps = cut(forms.groupBy("form").agg(F.min("id").alias("rep")))
    groups = connected_components(name_links(reps))
    root = groups.groupBy("group_id").agg(F.min(F.col("node").cast("long")).alias("root"))
    move = groups.join(root, "group_id").select(F.col("node").cast("long").alias("rep"), "root")
    top = reps.join(move, "rep", "left").select("form", F.coalesce("root", "rep").alias("rep"))
    return forms.join(top, "form").select("rep", "id").distinct()
