"""Problem 2: the best representative of each duplicate group.

The pages of a group are unpivoted to long rows (group, field, value, page), every row
votes for its normalised value, votes of a value are summed, ``max_by`` picks the winner
of each field and the fields are pivoted back to one surviving record. All aggregates
combine on the map side, so a group that holds a third of all rows is never collected
in one task.

A vote is source trust times recency decay. ``graded`` takes both in steps of three within a
group and field: a vote weighs a third of the next more trusted or newer one, so it
outweighs all votes after it together and the strict order asked for by ``p2_found``
holds. ``decayed`` takes 1 / trust rank and a half life, so that many weak votes may
outvote a trusted one.
"""

from __future__ import annotations

import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from scriptorium.session import numbered, skew_lookup

FIELDS = ("summary", "concept_kind", "subject_area")

# fixed values: what a field holds when it says nothing, after folding
NOTHING = (
    "n/a", "na", "n.a", "nan", "null", "none", "nil", "nothing", "tbd", "tba", "tbc", "todo", "to do",
    "unknown", "empty", "missing", "undefined", "not available", "not applicable", "no data",
    "暂无", "待补充", "无", "未知", "待定", "空", "未填写", "没有", "不详", "暂缺", "待完善", "缺失", "待填",
)


@pandas_udf(StringType())
def page_key(refs: pd.Series) -> pd.Series:
    """What a reference names, however written: folder, ending, case and encoding removed."""

    def one(x):
        if x is None:
            return None
        for _ in range(2):  # encoded once or twice
            x = unquote(x)
        x = unicodedata.normalize("NFKC", x)
        x = "".join(ch for ch in x if unicodedata.category(ch) not in ("Cf", "Cc") or ch in "\t\n")
        x = " ".join(x.replace("\\", "/").rstrip("/ ").rpartition("/")[2].split())
        stem, dot, ending = x.rpartition(".")
        if dot and ending.strip().lower() in ("md", "mdx", "markdown", "html", "htm", "txt"):
            x = stem
        return x.strip().casefold() or None

    return refs.map(one)


@pandas_udf(StringType())
def says(values: pd.Series) -> pd.Series:
    """The normalised value, null if it says nothing (blank, signs only, a stand-in)."""
    nothing = frozenset(NOTHING)

    def one(x):
        if x is None:
            return None
        x = unicodedata.normalize("NFKC", x)
        x = "".join(ch for ch in x if unicodedata.category(ch) not in ("Cf", "Cc") or ch in "\t\n")
        x = " ".join(x.split()).casefold()
        bare = x.strip(" .,;:!?<>()[]{}-_—–…'\"*#/\\|~")
        return None if not any(ch.isalnum() for ch in x) or bare in nothing else x

    return values.map(one)


def group_pages(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct (group_id, page_id) pairs; references to no page are ignored."""
    refs = groups.where("group_id is not null").select(
        "group_id",
        F.explode(F.concat(F.array("canonical_file"), F.coalesce("duplicate_files", F.array().cast("array<string>")))).alias("ref"),
    )
    refs = refs.where("ref is not null").select("group_id", page_key("ref").alias("_key")).where("_key is not null").distinct()
    known = pages.where("page_id is not null and path is not null").select("page_id", page_key("path").alias("_key")).distinct()
    return refs.join(known, "_key").select("group_id", "page_id").distinct()


def long_votes(groups: DataFrame, pages: DataFrame, trust: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(group_id, page_id, trust_rank, compiled_at, field_name, value, norm): one row for each
    page and field that says something. Rows delivered twice count once."""
    rank = trust.where("compiled_by is not null").groupBy(F.lower(F.trim("compiled_by")).alias("_by")).agg(
        F.min("trust_rank").alias("trust_rank"))  # one row a compiler
    wide = pages.select("page_id", F.lower(F.trim("compiled_by")).alias("_by"), "compiled_at", *fields).distinct()
    wide = wide.join(rank, "_by", "left").drop("_by")
    wide = wide.select("page_id", "trust_rank", "compiled_at",
                       *[F.col(f).cast("string").alias(f) for f in fields])
    long = wide.unpivot(["page_id", "trust_rank", "compiled_at"], list(fields), "field_name", "value")
    long = long.withColumn("norm", says("value")).where("norm is not null")
    return group_pages(groups, pages).join(long, "page_id")


def _order() -> Column:
    """Greatest first: trusted compilers, then new pages, then small page ids."""
    return F.struct(
        (-F.coalesce(F.col("trust_rank"), F.lit(2**31 - 1)).cast("long")).alias("t"),
        F.col("compiled_at").isNotNull().alias("n"),
        F.col("compiled_at").alias("c"),
        (-F.col("page_id")).alias("p"),
    )


def graded(votes: DataFrame, step: float = 3.0) -> DataFrame:
    """The votes with ``weight``: of all votes of a group and field in order (trust, then time,
    then page), ``step`` to the power of minus the votes of more trusted sources, times
    ``step`` to the power of minus its place by recency among those of equal trust. The
    order is made by ranges over all votes, so no group is sorted in one task."""
    by = ["group_id", "field_name"]
    rows = votes.withColumns({"_t": F.coalesce(F.col("trust_rank"), F.lit(2**31 - 1)).cast("long"), "_k": F.xxhash64(*by), "_v": F.coalesce("value", F.lit(""))})
    rows = numbered(rows, [*by, "_t", F.desc_nulls_last("compiled_at"), "page_id", "_v"], "_i").withColumn("_l", F.xxhash64(*by, "_t"))
    groups = rows.groupBy("_k").agg(F.min("_i").alias("_g"))
    levels = rows.groupBy("_l").agg(F.min("_i").alias("_m"))
    rows = skew_lookup(skew_lookup(rows, groups, "_k"), levels, "_l")
    trust = F.pow(F.lit(step), (F.col("_g") - F.col("_m")).cast("double"))
    decay = F.pow(F.lit(step), (F.col("_m") - F.col("_i") - 1).cast("double"))
    return rows.withColumn("weight", trust * decay).drop("_t", "_k", "_l", "_v", "_i", "_g", "_m")


def decayed(votes: DataFrame, half_life_days: float = 365.0, unlisted_rank: int = 99) -> DataFrame:
    """The votes with ``weight``: (1 / trust rank) x 2^(-age / half life), age counted from the
    newest page of all; an unknown time counts as two half lives. Which value wins does not
    depend on where age is counted from, but for unknown times."""
    newest = votes.agg(F.unix_timestamp(F.max("compiled_at"))).first()[0]  # one value
    age = (F.lit(newest or 0) - F.unix_timestamp("compiled_at")) / 86400.0
    return votes.withColumn("weight", F.pow(F.lit(2.0), -F.coalesce(age / half_life_days, F.lit(2.0))) / F.coalesce("trust_rank", F.lit(unlisted_rank)))


def voted(votes: DataFrame) -> DataFrame:
    """(group_id, field_name, norm, value, page_id, weight): the value of each field with the
    greatest sum of weights, written as its best page has it; ties go to the better page."""
    per_value = votes.groupBy("group_id", "field_name", "norm").agg(
        F.sum("weight").alias("weight"), F.max_by(F.struct("page_id", "value"), _order()).alias("_w"), F.max(_order()).alias("_o"))
    best = per_value.withColumn("_s", F.round("weight", 9)).groupBy("group_id", "field_name").agg(
        F.max_by(F.struct("norm", "_w", "weight"), F.struct("_s", "_o")).alias("_b"))
    return best.select("group_id", "field_name", F.col("_b.norm").alias("norm"), F.col("_b._w.value").alias("value"),
                       F.col("_b._w.page_id").alias("page_id"), F.col("_b.weight").alias("weight"))


def survivors(winners: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One record a group, the winners pivoted back; null where no page says anything."""
    return winners.groupBy("group_id").pivot("field_name", list(fields)).agg(F.first("value"))
