"""Problem 5: checking new batches against all history.

A store in the shared folder holds one row for each fingerprint of each distinct hash and
name form, in parts by fingerprint, and one Bloom filter a part. A batch is prescreened
against the filters of the parts its fingerprints fall in; only fingerprints that may be
known are looked up, in those parts only, what they hit is verified, and the batch joins
the store: its rows as a new run, its bits in the filters of its parts. Runs are merged
by tiers, so a lookup reads few of them and history is never processed again. A store
is reopened by its path; what a batch that broke off has left behind is overwritten.
Batches that wait together are absorbed in one turn: a document repeated in any of them
is linked as if they came one by one, and what is known is read once for all of them.

Fingerprints that are looked up are the hash (its first 16 digits), the whole normal form
of the name, and the form with words left out (see ``filenames.keys``). What they hit is
verified by shared coverage: of the winnowed three-letter runs of two forms (the least of
every two neighbours, by hash) so many must be common that slips in two words explain the
rest; then by the rule itself. Winnowed runs alone can't be looked up: two slips may leave
a name of six words no run of its own but those all names of its topic have.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType

from scriptorium.llm import filenames
from scriptorium.llm.components import connected_components
from scriptorium.llm.lookalike import Looks
from scriptorium.llm.neardup import name_keys
from scriptorium.session import BROADCAST_ROWS, cut, scratch, skew_lookup

HASHES = 5
PART_ROWS = 150_000
#: Forms under one fingerprint that are compared in one task.
CHUNK = 2_000
#: Forms under one fingerprint before they are told apart by the words left out.
SPLIT = 32
#: Runs of one size before they are merged into one.
TIER = 32
# the tables of a store
ROWS = "fp long, form string, exact boolean, id long, known boolean, n int, part int"
LINKS = "a long, b long, turn int"


def hash_key(column: str = "sha256"):
    """The first 16 digits of a hash however written; null for anything that is no hash."""
    bare = F.regexp_replace(F.lower(F.trim(column)), r"^sha[-_ ]?256\s*[:\-_= ]\s*", "")
    return F.when(bare.rlike("^([0-9a-f]{16}|[0-9a-f]{64})$"), F.substring(bare, 1, 16))


def fingerprints(uploads: DataFrame, key: str = "upload_id", sha: str = "sha256", name: str = "original_filename", batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, stars). ``rows``: (fp, form, exact, id, _b), one row for each fingerprint of each
    distinct hash or name form of a batch, with the smallest id that has it; ``exact``:
    sharing it suffices, else the forms are to be verified. ``stars``: (a, b, _b), links
    from that smallest id to every other id of the batch with the hash or form.

    Rows delivered twice count once, an id in two batches counts for the smaller; an upload
    with neither a hash nor a name has no row; null ids are left out; without ``batch``, and
    where it is null, all is batch 0.
    """
    shared = uploads.sparkSession.sparkContext.broadcast(Looks.universal())

    @pandas_udf(StringType())
    def form(names: pd.Series) -> pd.Series:
        table = shared.value
        return names.map(lambda x: None if x is None else filenames.normal(x, table) or None)

    number = F.coalesce(F.col(batch).cast("long"), F.lit(0)) if batch else F.lit(0).cast("long")
    rows = uploads.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id"), hash_key(sha).alias("h"), F.col(name).alias("n")).agg(F.min(number).alias("_b"))
    hashed = rows.where("h is not null").select("id", "_b", F.xxhash64(F.lit("sha"), "h").alias("fp"), F.lit(None).cast("string").alias("form"))
    # as if not deterministic: else the filter, and the function with it, would also run below the aggregate
    named = rows.where("n is not null").select("id", "_b", form.asNondeterministic()("n").alias("form")).where("form is not null")
    whole = cut(hashed.unionByName(named.select("id", "_b", F.xxhash64(F.lit("name"), "form").alias("fp"), "form")).withColumn("_k", F.xxhash64("_b", "fp")))
    firsts = cut(whole.groupBy("_k", "_b", "fp", "form").agg(F.min("id").alias("id"), F.count("*").alias("_n")))
    many = firsts.where("_n > 1").select("_k", F.col("id").alias("a"))
    stars = skew_lookup(whole.select("_k", "_b", F.col("id").alias("b")), many, "_k").where("a <> b").select("a", "b", "_b").distinct()
    exact = firsts.select("fp", F.lit(None).cast("string").alias("form"), F.lit(True).alias("exact"), "id", "_b")
    keyed = cut(firsts.where("form is not null").select(name_keys("form").alias("keys"), "form", "id", "_b"))  # made once, read for the parts and for the rows
    near = keyed.select(F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("fp"), "form", F.lit(False).alias("exact"), "id", "_b")
    return exact.unionByName(near), stars


def _bits(fps: np.ndarray, size: int) -> np.ndarray:
    """Positions of the fingerprints in a filter of ``size`` bits, a row each."""
    x = fps.astype(np.uint64)
    a = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    b = ((a ^ (a >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(size)


@pandas_udf(ArrayType(LongType()))
def _splits(forms: pd.Series, fps: pd.Series) -> pd.Series:
    return pd.Series([[0] if x is None else filenames.splits(x, k) for x, k in zip(forms, fps)], dtype=object)


@pandas_udf(BooleanType())
def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two forms share enough coverage and name the same document."""
    return pd.Series([x is None or (filenames.covers(x, y) and filenames.same(x, y)) for x, y in zip(a, b)], dtype=bool)


class FingerprintStore:
    """The store at ``path``; one that is there is opened as it was left, with its own number
    of parts. A new one is made for some ``expected`` fingerprints: ``parts`` filters of
    ``part_bits`` bits (256 KB each, good for some 200,000 fingerprints at one false alarm
    in a hundred). A false alarm costs a lookup and changes no result, so an overfull filter
    is slow but not wrong. A task takes one part of a batch."""

    def __init__(self, spark: SparkSession, path: str, expected: int = 0, parts: int | None = None, part_bits: int = 1 << 21, tier: int = TIER, chunk: int = CHUNK):
        self.spark, self.path, self.tier, self.chunk = spark, path.rstrip("/"), tier, chunk
        #: batches absorbed, the run that holds each part's filter, the runs and their tiers, most forms a fingerprint may have
        self.turn, self.filters, self.runs, self.most = 0, {}, [], 0
        self.parts, self.part_bits = parts or max(16, -(-expected // PART_ROWS)), part_bits
        self.jvm = spark.sparkContext._jvm
        folder = self._at(f"{self.path}/commits")
        self.files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.files.exists(folder):
            names = sorted(x.getPath().getName() for x in self.files.listStatus(folder))
            if names := [x for x in names if x.endswith(".json")]:
                stream = self.files.open(self._at(f"{self.path}/commits/{names[-1]}"))
                state = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
                self.turn, self.parts, self.part_bits, self.most = state["turn"], state["parts"], state["part_bits"], state["most"]
                self.filters = {int(p): t for p, t in state["filters"].items()}
                self.runs = [tuple(x) for x in state["runs"]]

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _commit(self) -> None:
        """What the store holds now, by one rename; it grows with the parts, not with the rows."""
        text = json.dumps({"turn": self.turn, "parts": self.parts, "part_bits": self.part_bits, "most": self.most, "filters": self.filters, "runs": self.runs})
        written, final = (self._at(f"{self.path}/commits/{self.turn:08d}.{x}") for x in ("tmp", "json"))
        out = self.files.create(written, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.files.rename(written, final):
            raise OSError(f"the store at {self.path} could not be committed")

    def _rows(self, *runs: str) -> DataFrame:
        """The rows of some runs; a given schema saves a job, run and part are folders."""
        if len(runs) == 1:
            return self.spark.read.schema(ROWS).parquet(f"{self.path}/turns/run={runs[0]}/what=row")
        return self.spark.read.schema(ROWS + ", run string, what string").parquet(f"{self.path}/turns").where(F.col("run").isin(*runs) & (F.col("what") == "row"))

    def _screen(self, batch: DataFrame, touched: list[int]) -> DataFrame:
        """The batch's rows with ``known``, whether the fingerprint may be in the store, and
        ``n``, how many of them have it; and the filters of their parts with the batch added."""
        size = self.part_bits
        out = "what string, fp long, form string, exact boolean, id long, known boolean, n int, bits binary, part int"
        types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int32()]
        schema = pa.schema(list(zip([x.split()[0] for x in out.split(", ")], types)))

        def test(new: pa.Table, old: pa.Table) -> pa.Table:
            bits, rows, part = np.zeros(size // 8, np.uint8), new.num_rows, new["part"][0].as_py()
            for x in old["bits"].to_pylist():
                bits |= np.frombuffer(x, np.uint8)
            fps, of, n = np.unique(new["fp"].to_numpy(), return_inverse=True, return_counts=True)
            at = _bits(fps, size)
            known = ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).ravel().astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())
            made = {"what": pa.repeat("row", rows), "known": pa.array(known[of]), "n": pa.array(n[of].astype(np.int32)), "bits": pa.nulls(rows, pa.binary())}
            table = pa.table([(made[f.name] if f.name in made else new[f.name]).cast(f.type) for f in schema], schema=schema)
            last = pa.Table.from_pylist([{"what": "bits", "n": part, "bits": bits.tobytes(), "part": part}], schema=schema)
            return pa.concat_tables([table, last])

        held = [f"{self.path}/turns/run={self.filters[p]}/what=bits/part={p}" for p in touched if p in self.filters]
        old = self.spark.createDataFrame([], "part int, bits binary")
        if held:
            old = self.spark.read.schema("n int, bits binary").parquet(*held).select(F.col("n").alias("part"), "bits")
        # parts without new rows have no old rows either, so each group has new ones
        return batch.groupBy("part").cogroup(old.groupBy("part")).applyInArrow(test, out)

    def absorb(self, rows: DataFrame, stars: DataFrame | None = None, touched: list[int] | None = None) -> DataFrame:
        """Check a batch (see ``fingerprints``) against all before and itself, then add it;
        ``touched``: the parts its fingerprints fall in, where they are known.

        Gives (a, b): links from an upload to one known, or of this batch, with the same
        document; following links to the end gives all repeats. A hash or form that a third
        of all rows share is one row of ``rows`` and as many links as uploads in ``stars``.
        """
        batch = rows.select("fp", "form", "exact", "id", F.pmod("fp", F.lit(self.parts)).cast("int").alias("part"))
        if touched is None:
            touched = sorted(r["part"] for r in batch.select("part").distinct().collect())  # at most the number of parts
        turn = self.turn
        links = self.spark.createDataFrame([], "a long, b long") if stars is None else stars.select("a", "b")
        if touched:
            screened = self._screen(batch, touched).sortWithinPartitions("what", "part", "fp")
            screened.write.mode("overwrite").partitionBy("what", "part").parquet(f"{self.path}/turns/run={turn}")
            new = self._rows(str(turn))
            seen = new.agg(F.max("n").alias("n"), F.count(F.when(F.col("known"), 1)).alias("hits"), F.collect_set(F.when(F.col("known"), F.col("part"))).alias("parts")).first()
            self.most += seen["n"]
            links = links.unionByName(self._pairs(new, seen["hits"], sorted(seen["parts"])))
            self.filters |= dict.fromkeys(touched, turn)
            self.runs.append((str(turn), 0))
        out = f"{self.path}/links/turn={turn}"
        links.write.mode("overwrite").parquet(out)
        self.turn += 1
        gone = self._merge()
        self._commit()
        for run in gone:
            self.files.delete(self._at(f"{self.path}/turns/run={run}/what=row"), True)
        return self.spark.read.schema("a long, b long").parquet(out)

    def _pairs(self, new: DataFrame, hits: int, parts: list[int]) -> DataFrame:
        """(a, b): uploads of the batch and of all before that share a fingerprint and pass."""
        columns = ["fp", "form", "exact", "id"]
        new = new.where("n > 1 or known")  # others are alone under their fingerprint
        pool = new.select(*columns, F.lit(False).alias("old"))
        if hits:
            asked = new.where("known").select("fp")
            known = self._rows(*[x for x, _ in self.runs]).where(F.col("part").isin(parts))
            known = known.join(F.broadcast(asked) if hits <= BROADCAST_ROWS else asked, "fp", "left_semi")
            pool = pool.unionByName(known.select(*columns, F.lit(True).alias("old")))
        left = new.select("fp", "exact", F.col("form").alias("fb"), F.col("id").alias("b"))
        right = pool.select("fp", "exact", F.col("form").alias("fa"), F.col("id").alias("a"), "old")
        by = ["fp", "exact"]
        split = min(SPLIT, self.chunk)
        if self.most > split:  # some fingerprint may have many forms: they meet by the words left out of them
            right = cut(right)
            hot = cut(right.where("fa is not null").groupBy("fp").agg(F.count("*").alias("_n")).where(F.col("_n") > split).select("fp"))
            hint = F.broadcast if hot.count() <= BROADCAST_ROWS else (lambda x: x)
            parted = lambda df, form: df.join(hint(hot), "fp", "left_anti").withColumn("_s", F.lit(0).cast("long")).unionByName(
                df.join(hint(hot), "fp", "left_semi").withColumn("_s", F.explode(_splits(form, "fp"))))
            left, right, by = parted(left, "fb"), parted(right, "fa"), [*by, "_s"]
        if self.most > self.chunk:  # and where they still are many, they are compared in chunks
            right = cut(right)
            hot = right.groupBy("fp", "_s").agg(F.count("*").alias("_n")).where(F.col("_n") > self.chunk)
            hot = cut(hot.select("fp", "_s", F.ceil(F.col("_n") / self.chunk).cast("int").alias("_of")))
            hint = F.broadcast if hot.count() <= BROADCAST_ROWS else (lambda x: x)
            left = left.join(hint(hot), ["fp", "_s"], "left").withColumn("_c", F.explode(F.sequence(F.lit(0), F.coalesce("_of", F.lit(1)) - 1))).drop("_of")
            right = right.join(hint(hot), ["fp", "_s"], "left").withColumn("_c", F.pmod(F.xxhash64("a"), F.coalesce("_of", F.lit(1))).cast("int")).drop("_of")
            by = [*by, "_c"]
        met = left.join(right, by).where("a <> b and (old or a < b or exact) and (exact or fa <> fb)")
        return met.select("a", "b", "fa", "fb").where(_verified("fa", "fb")).select("a", "b").distinct()

    def _merge(self) -> list[str]:
        """Runs of one tier become one of the next, one row a fingerprint and form; the runs
        that are no longer read."""
        gone = []
        for tier in range(64):
            runs = [x for x, t in self.runs if t == tier]
            if len(runs) < self.tier:
                break
            to = f"{self.turn}m{tier}"
            one = self._rows(*runs).groupBy("part", "fp", "form", "exact").agg(F.min("id").alias("id"), F.lit(False).alias("known"), F.max("n").alias("n"))
            one = one.repartition("part").sortWithinPartitions("part", "fp")
            one.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/turns/run={to}/what=row")
            self.runs = [x for x in self.runs if x[1] != tier] + [(to, tier + 1)]
            gone += runs
        return gone

    def repeats(self) -> DataFrame:
        """(first_id, id): every upload with an earlier one of the same document."""
        if not self.turn:
            return self.spark.createDataFrame([], "first_id long, id long")
        links = self.spark.read.schema(LINKS).parquet(f"{self.path}/links").where(F.col("turn") < self.turn)
        groups = connected_components(links).select("group_id", F.col("node").cast("long").alias("id"))
        first = groups.groupBy("group_id").agg(F.min("id").alias("first_id"))
        return skew_lookup(groups, first, "group_id").where("id <> first_id").select("first_id", "id")


def check_batches(uploads: DataFrame, path: str | None = None, batch: str = "batch_id", parts: int | None = None) -> FingerprintStore:
    """Absorb the first batch, the history, and then all that wait after it in one turn; a null
    batch counts as 0. A store that is there already absorbs both as what is new to it."""
    spark = uploads.sparkSession
    path = path or scratch(spark, "store")
    number = F.coalesce(F.col(batch).cast("long"), F.lit(0))
    first = uploads.agg(F.min(number)).first()[0]
    rows, stars = fingerprints(uploads.withColumn(batch, (number > F.lit(first)).cast("long")), batch=batch)
    stars = cut(stars)
    store = FingerprintStore(spark, path, expected=2 * rows.where("_b = 0").count(), parts=parts)
    part = F.pmod("fp", F.lit(store.parts)).cast("int")
    touched = {r["_b"]: sorted(r["parts"]) for r in rows.groupBy("_b").agg(F.collect_set(part).alias("parts")).collect()}  # a batch and part each
    for b in sorted(touched):
        store.absorb(rows.where(F.col("_b") == b), stars.where(F.col("_b") == b), touched[b])
    return store
