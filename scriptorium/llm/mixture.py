"""Problem 8: mixing sources to target weights.

Documents are counted by source and exact token length. Each source's token budget is
met by whole rounds over all its documents, then by an even share of every length, and
what remains by a bounded knapsack over lengths (a subset-sum dynamic programme on bit
sets), which finds the nearest total that can be reached. Which documents of a length
are taken is decided by a seeded hash. What reaches one task is the histogram of a
source: one row a distinct length, never the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from scriptorium.session import BROADCAST_ROWS, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how a text is cut before byte pairs are merged
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
#: Tokens the knapsack may have to fill exactly; what an even share leaves beyond is filled greedily.
KNAPSACK = 1 << 17
BUCKET_ROWS = 20_000

_ENCODERS: dict[int, object] = {}


def token_counter(spark, path: str = TOKENIZER, pattern: str = PATTERN):
    """A column function: text -> tokens of a public byte-pair vocabulary; null -> null. The
    vocabulary (about 1 MB) is read on the driver and broadcast."""
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        encoder = _ENCODERS.get(0)
        if encoder is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            encoder = _ENCODERS[0] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        one = encoder._core_bpe.encode_ordinary if hasattr(encoder, "_core_bpe") else encoder.encode_ordinary
        return pd.Series([None if x is None else len(one(x)) for x in texts], dtype="Int32")

    return count


def source_key(column):
    """A source however written: case, blanks and separators aside."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_\-./]+", "")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK) -> tuple[int, np.ndarray]:
    """(rounds, extra): whole rounds over all documents and how many of each length to take
    once more, so that the total comes as near below ``budget`` as can be found."""
    total = int((lengths * counts).sum())
    if total <= 0 or budget <= 0:
        return 0, np.zeros(len(counts), np.int64)
    rounds, rest = divmod(budget, total)
    share = max(0.0, (rest - knapsack / 2) / total)
    take = np.floor(counts * share).astype(np.int64)
    rest -= int((take * lengths).sum())
    left = counts - take
    for k in np.argsort(-lengths, kind="stable"):  # what even shares leave beyond the knapsack
        if rest <= knapsack:
            break
        n = min(int(left[k]), -(-(rest - knapsack) // int(lengths[k])), rest // int(lengths[k]))
        take[k] += n
        left[k] -= n
        rest -= n * int(lengths[k])
    parts: list[tuple[int, int]] = []  # bounded: a length with n copies as 1, 2, 4, ... copies
    for k in range(len(lengths)):
        n, step = min(int(left[k]), rest // int(lengths[k])), 1
        while n > 0:
            parts.append((k, min(step, n)))
            n -= step
            step *= 2
    mask, reach = (1 << (rest + 1)) - 1, [1]
    # no total but multiples of the common divisor can be met; with many lengths the nearest is
    # met after a few parts, so few bit sets are ever held
    common = int(np.gcd.reduce(lengths[left > 0])) if (left > 0).any() else 1
    goal, used = rest - rest % common, 0
    for k, n in parts:
        reach.append((reach[-1] | reach[-1] << (int(lengths[k]) * n)) & mask)
        used += 1
        if reach[-1] >> goal & 1:
            break
    at = reach[-1].bit_length() - 1
    for p in range(used - 1, -1, -1):
        if not reach[p] >> at & 1:
            k, n = parts[p]
            take[k] += n
            at -= int(lengths[k]) * n
    return int(rounds), take


def mix(docs: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    ``chosen``: (doc_id, source, n_tokens, repeats), every document used and how often, at
    most ``max_repeats`` of its source. ``report``: (source, target_share, actual_share,
    target_tokens, actual_tokens, documents, used), one row a source of ``weights``.

    ``total`` is the size wanted in tokens; without it, and at most, the largest total at
    which every source that has documents can fill its share. A source without documents
    or share gets nothing and the report says so. Null ids, texts and sources, texts
    without tokens and sources not in ``weights`` are left out; a repeated id counts once.
    """
    spark = docs.sparkSession
    w = weights.where("source is not null and target_share is not null").dropDuplicates(["source"])
    w = cut(w.select(source_key("source").alias("_s"), "source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")))
    count = token_counter(spark, tokenizer)
    # sources are few: the list is counted before it is broadcast
    known = F.broadcast(w.select("_s", "source")) if w.count() <= BROADCAST_ROWS else w.select("_s", "source")
    rows = docs.where("doc_id is not null and text is not null and source is not null").select("doc_id", "text", source_key("source").alias("_s"))
    rows = rows.join(known, "_s").select("doc_id", "source", count("text").alias("n_tokens"))
    rows = cut(rows.where("n_tokens > 0").groupBy("doc_id").agg(F.min("source").alias("source"), F.min("n_tokens").alias("n_tokens")))
    histogram = cut(rows.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    have = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("docs"))
    budgets = cut(w.join(have, "source", "left").na.fill(0, ["tokens", "docs"]))
    limit = budgets.where("target_share > 0 and tokens > 0").agg(
        F.min(F.floor(F.col("max_repeats") * F.col("tokens") / F.col("target_share")))).first()[0]
    size = min(x for x in (total, limit or 0) if x is not None)
    budgets = budgets.withColumn("budget", F.least(F.round(F.col("target_share") * F.lit(size)).cast("long"), F.col("max_repeats") * F.col("tokens")))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        rounds, take = fit(pdf["n_tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["budget"].iloc[0]))
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "n": pdf["n"], "rounds": rounds, "take": take})

    plans = cut(histogram.join(budgets.select("source", "budget"), "source").groupBy("source").applyInPandas(
        plan, "source string, n_tokens int, n long, rounds int, take long"))
    # a length that many documents share is cut into buckets by the seeded hash: all but one
    # bucket are taken whole or not at all, and only that one is ranked
    buckets = F.ceil(F.col("n") / BUCKET_ROWS).cast("long")
    hint = F.broadcast if plans.count() <= BROADCAST_ROWS else (lambda x: x)
    rows = rows.join(hint(plans), ["source", "n_tokens"]).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    rows = rows.withColumn("_b", F.pmod("_h", buckets))
    group = ["source", "n_tokens"]
    sizes = rows.where("n > %d" % BUCKET_ROWS).groupBy(*group, "_b", "take").agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_b", (F.col("take") - F.coalesce(F.sum("_m").over(before), F.lit(0))).alias("_want"))
    small = rows.where("n <= %d" % BUCKET_ROWS).withColumn("_want", F.col("take"))
    large = rows.where("n > %d" % BUCKET_ROWS).join(sizes, [*group, "_b"])
    ranked = small.unionByName(large.select(*small.columns))
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", "doc_id"))
    chosen = ranked.withColumn("repeats", F.col("rounds") + F.when(rank <= F.col("_want"), 1).otherwise(0))
    chosen = chosen.where("repeats > 0").select("doc_id", "source", "n_tokens", F.col("repeats").cast("int").alias("repeats"))
    used = plans.groupBy("source").agg(
        F.sum(F.col("n_tokens") * (F.col("n") * F.col("rounds") + F.col("take"))).alias("actual_tokens"),
        F.sum(F.when(F.col("rounds") > 0, F.col("n")).otherwise(F.col("take"))).alias("used"))
    report = budgets.join(used, "source", "left").na.fill(0, ["actual_tokens", "used"])
    whole = report.agg(F.sum("actual_tokens")).first()[0] or 1
    report = report.select(
        "source", "target_share", F.round(F.col("actual_tokens") / F.lit(whole), 9).alias("actual_share"),
        F.col("budget").alias("target_tokens"), "actual_tokens", F.col("docs").alias("documents"), "used")
    return chosen, report
