"""The concept index: partial rows merged, aliases parsed, names mapped, terms matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.contains import containing
from scriptorium.session import cut

# fixed value: aliases announced inside a summary
ALIASES = r"(?i)[（(]\s*(?:别名|aka|also\s+known\s+as|a\.k\.a\.?)\s*[:：]\s*([^)）]+)[)）]"


def reduce_index(partials: DataFrame) -> DataFrame:
    """(name, path, aliases, summary, article_count): the partial rows of each name merged in
    the order of ``seq``: last path, all aliases, last summary that says something, summed
    counts. Rows delivered twice count once, null names are left out, null counts are 0.
    Sets and maxima combine on the map side, so one name may hold any share of the rows."""
    rows = partials.where("name is not null").select("seq", "name", "path", "aliases", "summary", "article_count").distinct()
    said = F.when(F.trim("summary") != "", F.col("summary"))
    main = rows.groupBy("name").agg(
        F.max_by("path", F.when(F.col("path").isNotNull(), F.col("seq"))).alias("path"), F.max_by("summary", F.when(said.isNotNull(), F.col("seq"))).alias("summary"),
        F.sum(F.coalesce("article_count", F.lit(0))).alias("article_count"))
    named = rows.select("name", F.explode("aliases").alias("alias")).where("trim(alias) <> ''").groupBy("name").agg(
        F.array_sort(F.collect_set("alias")).alias("aliases"))
    return main.join(named, "name", "left").select("name", "path", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "summary", "article_count")


def summary_aliases(summary: Column | str) -> Column:
    """Aliases announced in a summary, in order; none gives an empty array."""
    found = F.transform(F.split(F.regexp_extract(F.coalesce(summary, F.lit("")), ALIASES, 1), "[,，、;；]"), lambda x: F.trim(x))
    return F.filter(found, lambda x: x != "")


def backfill_aliases(index: DataFrame) -> DataFrame:
    """The index with empty alias lists filled from the summaries."""
    empty = F.col("aliases").isNull() | (F.size("aliases") == 0)
    return index.withColumn("aliases", F.when(empty, summary_aliases("summary")).otherwise(F.col("aliases")))


def canonical_map(index: DataFrame) -> DataFrame:
    """(key, name): lower-cased names and aliases to the concept. Of explicit entries the last
    name in plain order wins; aliases of summaries count only where nothing explicit does,
    the first name wins."""
    names = index.where("name is not null").select(F.lower("name").alias("key"), "name")
    listed = index.select(F.explode("aliases").alias("a"), "name").where("a <> ''").select(F.lower("a").alias("key"), "name")
    weak = index.select(F.explode(summary_aliases("summary")).alias("a"), "name").select(F.lower("a").alias("key"), "name")
    every = names.unionByName(listed).withColumn("strong", F.lit(True)).unionByName(weak.withColumn("strong", F.lit(False)))
    best = every.where("key is not null and name is not null").groupBy("key").agg(
        F.max(F.when(F.col("strong"), F.col("name"))).alias("_s"), F.min(F.when(~F.col("strong"), F.col("name"))).alias("_w"))
    return best.select("key", F.coalesce("_s", "_w").alias("name"))


def match_terms(terms: DataFrame, index: DataFrame, key: str = "doc_id", top: int = 5) -> DataFrame:
    """(key, name, score): concepts related to a text: how many of its terms contain, or are
    contained in, the name or an alias of the concept; the ``top`` of each text.

    ``terms``: (key, term). Distinct terms are matched once against distinct names, each by its
    rarest run, in place of all pairs.
    """
    names = index.select("name", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("n"))
    names = names.where("n <> ''").select("name", F.lower("n").alias("n")).distinct()
    asked = terms.where("term is not null and term <> ''").select(key, F.lower("term").alias("t")).distinct()
    words = asked.select("t").distinct()
    words, forms = cut(words), cut(names.select("n").distinct())
    inside = containing(words.withColumnRenamed("t", "needle"), forms.withColumnRenamed("n", "hay")).select(F.col("needle").alias("t"), F.col("hay").alias("n"))
    around = containing(forms.withColumnRenamed("n", "needle"), words.withColumnRenamed("t", "hay")).select(F.col("hay").alias("t"), F.col("needle").alias("n"))
    pairs = inside.unionByName(around).distinct().join(names, "n").select("t", "name").distinct()
    scored = asked.join(pairs, "t").groupBy(key, "name").agg(F.count("*").alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "name"))
    return scored.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")
