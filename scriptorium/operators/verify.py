"""Gates over a whole knowledge base: issues as rows, none if all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.paths import stem_of
from scriptorium.operators import graph


def verify_graph(nodes: DataFrame, edges: DataFrame, members: DataFrame, stem_chars: int = 120) -> DataFrame:
    """(check, ref) of a built graph: empty, relations that are not allowed, ends that are no
    nodes, nodes without a community, labels with signs of markup or too long for a file."""
    empty = nodes.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("graph is empty").alias("check"), F.lit("").alias("ref"))
    rel = edges.where(~F.col("relation").isin(list(graph.RELATIONS)) | F.col("relation").isNull()).groupBy(F.coalesce("relation", F.lit("(none)")).alias("ref")).agg(F.count("*").alias("n"))
    rel = rel.select(F.lit("relation not allowed").alias("check"), "ref")
    ids = nodes.select("id")
    loose = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select("source").unionByName(
        edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select(F.col("target").alias("source"))).distinct()
    loose = loose.select(F.lit("edge end is no node").alias("check"), F.col("source").alias("ref"))
    single = nodes.join(members.select("id"), "id", "left_anti").select(F.lit("node without community").alias("check"), F.col("id").alias("ref"))
    marked = nodes.where(F.col("label").rlike(r"[*`\[\]#]")).select(F.lit("label holds markup").alias("check"), F.col("id").alias("ref"))
    long = nodes.where(F.length("label") > stem_chars).select(F.lit("label too long for a file").alias("check"), F.col("id").alias("ref"))
    out = empty
    for part in (rel, loose, single, marked, long):
        out = out.unionByName(part)
    return out


def verify_index(index: DataFrame, pages: DataFrame) -> DataFrame:
    """(check, ref) of a concept index against its pages: no page, no summary, negative counts."""
    paths = pages.where("path is not null").select("path").distinct()
    none = index.join(paths, "path", "left_anti").select(F.lit("page missing").alias("check"), F.col("name").alias("ref"))
    blank = index.where("summary is null or trim(summary) = ''").select(F.lit("summary missing").alias("check"), F.col("name").alias("ref"))
    below = index.where("article_count < 0").select(F.lit("count negative").alias("check"), F.col("name").alias("ref"))
    return none.unionByName(blank).unionByName(below)


def verify_wiki(articles: DataFrame, concepts: DataFrame, index: DataFrame, tasks: DataFrame) -> DataFrame:
    """(check, ref) of a compiled knowledge base: no articles, no concepts, no index; concept
    pages named after an article (stem ends with ``_concepts``); tasks that are not ended.
    ``articles`` and ``concepts``: (path)."""
    out = None
    for name, df in (("articles", articles), ("concepts", concepts), ("concept index", index)):
        part = df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("nothing there").alias("check"), F.lit(name).alias("ref"))
        out = part if out is None else out.unionByName(part)
    named = concepts.where(stem_of("path").endswith("_concepts")).select(F.lit("page named after an article").alias("check"), F.col("path").alias("ref")).distinct()
    left = tasks.where(F.col("status").isin("pending", "processing")).select(F.lit("task not ended").alias("check"), F.col("task_id").alias("ref")).distinct()
    return out.unionByName(named).unionByName(left)
