"""The queries of the training-data problems, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import canonical, components, history, leakage, lookalike, mixture, neardup, reading, survivors
from scriptorium.session import cut, skew_lookup, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every node of a match and the smallest node of its group."""
    matches = components.matching_edges(table(spark, d, "edges"), table(spark, d, "nodes"))
    return components.connected_components(matches).select(F.col("node").alias("node_id"), "group_id")


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return survivors.long_votes(table(spark, d, "duplicate_groups"), table(spark, d, "concept_pages"), table(spark, d, "compiler_trust"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The page whose value survives, by summed votes that keep the order."""
    return survivors.voted(survivors.graded(_votes(spark, d))).select("group_id", "field_name", "page_id")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record a group, by summed votes that decay with age."""
    return survivors.survivors(survivors.voted(survivors.decayed(_votes(spark, d))))


def _looks(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "concepts_index")
    none = F.lit(None).cast("string")
    labels = table(spark, d, "nodes").where("file_type = 'document'").select(
        F.lit("label").alias("field_name"), none.alias("row"), F.col("id").alias("key"), F.col("label").alias("value"))
    summaries = index.select(F.lit("summary").alias("field_name"), none.alias("row"), F.col("seq").cast("string").alias("key"), F.col("summary").alias("value"))
    seq = F.col("seq").cast("string")
    aliases = index.select(seq.alias("row"), F.posexplode("aliases").alias("at", "value")).select(
        F.lit("alias").alias("field_name"), "row", F.concat_ws("#", "row", "at").alias("key"), "value")
    rows = labels.unionByName(summaries).unionByName(aliases).where("value is not null")
    return rows.withColumn("row", F.coalesce("row", F.lit("")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of values that look the same and differ."""
    return lookalike.same_look(_looks(spark, d), ["field_name", "row"]).select("field_name", "key_a", "key_b").distinct()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a value written in several ways: its class, and how many rows are written otherwise."""
    return lookalike.look_classes(_looks(spark, d), ["field_name", "row"]).drop("row").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every typed value and the entry it means."""
    labels = table(spark, d, "nodes").where("file_type = 'concept' and id is not null and label is not null").select(
        F.lit("label").alias("field_name"), F.col("id").alias("row_key"), F.lit(0).cast("long").alias("item_no"), F.col("label").alias("value"))
    aliases = table(spark, d, "concepts_index").where("seq is not null").select(
        F.lit("alias").alias("field_name"), F.col("seq").cast("string").alias("row_key"), F.posexplode("aliases").alias("item_no", "value"))
    aliases = aliases.where(F.col("value").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}\p{Cf}]"))
    typed = labels.unionByName(aliases.withColumn("item_no", F.col("item_no").cast("long"))).distinct()
    found = cut(canonical.map_to_list(typed, table(spark, d, "canonical_terms")))
    # the mapping has one row a distinct value, the typed rows may repeat one very often
    return skew_lookup(typed, found, "value").select("field_name", "row_key", "item_no", "term_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every repeat and the first upload of the same document, batch after batch."""
    store = history.check_batches(table(spark, d, "source_map"))
    return store.repeats().select(F.col("first_id").alias("first_upload_id"), F.col("id").alias("upload_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of edited versions, of contents and of file names."""
    links, members = neardup.near_texts(table(spark, d, "structure"), "struct_id", "content_md", size=3, least=0.55, at_least=False)
    contents = neardup.all_pairs(links, members).select(F.lit("content_md").alias("field_name"), "id_a", "id_b")
    groups = cut(neardup.name_groups(table(spark, d, "source_map"), "upload_id", "original_filename"))
    names = neardup.all_pairs(groups.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where(F.lit(False)), groups)
    return contents.unionByName(names.select(F.lit("original_filename").alias("field_name"), "id_a", "id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a text: its class of near-duplicates (five words, 0.8) and its number of links."""
    links, members = neardup.near_texts(table(spark, d, "structure"), "struct_id", "content_md")
    links = cut(links)
    groups = components.connected_components(links).select(F.col("node").cast("long").alias("rep"), F.col("group_id").cast("long").alias("class_id"))
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("links"))
    rows = members.join(groups, "rep", "left").join(degree, "rep", "left")
    return rows.select(F.col("id").alias("struct_id"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold test items, and which."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_removed(spark: SparkSession, d: str) -> DataFrame:
    """Spans and words taken out of the documents that hold test items."""
    return leakage.removed(table(spark, d, "documents"), table(spark, d, "eval_items")).drop("cleaned")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents used, and how often."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source has beside its target."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are easy or hard to read."""
    levels, _ = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    return levels.where("band <> 'middle'").select("doc_id", "band")


def p9_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """By source: labelled documents, the share that got their band, and the mean error of the
    calibrated grade, from models that had not seen the source."""
    _, grader = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    rows = [(s, n, round(a, 6), round(e, 6)) for s, (n, a, e) in (grader.accuracy if grader else {}).items()]
    return spark.createDataFrame(rows, "source string, labelled int, accuracy double, error double")


QUERIES = {f.__name__: f for f in (
    p1_found, p2_found, p2_records, p3_found, p3_classes, p4_found, p5_found, p6_found, p6_groups, p7_found, p7_removed, p8_mixture, p8_shares, p9_found, p9_accuracy,
)}

_NOTHING = ", ".join("'" + x + "'" for x in survivors.NOTHING)
_KEY = r"""lower(trim(regexp_replace(regexp_extract(replace(url_decode({0}), '\', '/'), '([^/]*)$', 1), '(?i)\.(md|mdx|markdown|html|htm|txt)\s*$', '')))"""

SQL = {
    "p1_found": r"""
with recursive m as (
    select distinct source a, target b from edges
    where regexp_replace(lower(trim(relation)), '[-_\s]+', '_', 'g') = 'semantically_similar_to'
      and confidence_score between 0.85 and 1 and not isnan(confidence_score) and source <> target
      and source in (select id from nodes) and target in (select id from nodes)),
l as (select a, b from m union select b, a from m),
r(node_id, other) as (select a, a from l union select r.node_id, l.b from r join l on l.a = r.other)
select node_id, min(other) as group_id from r group by node_id""",
    "p2_found": rf"""
with refs as (
    select distinct group_id, {_KEY.format("ref")} as k from (
        select group_id, canonical_file as ref from duplicate_groups
        union all select group_id, unnest(duplicate_files) from duplicate_groups) where ref is not null),
pages as (select distinct page_id, path, lower(trim(compiled_by)) as by_, compiled_at, summary, concept_kind, subject_area from concept_pages),
long as (
    select r.group_id, p.page_id, t.trust_rank, p.compiled_at, f.field_name,
        case f.field_name when 'summary' then summary when 'concept_kind' then concept_kind else subject_area end as v
    from refs r join pages p on r.k = {_KEY.format("p.path")} left join compiler_trust t on t.compiled_by = p.by_
    cross join (values ('summary'), ('concept_kind'), ('subject_area')) f(field_name)),
said as (select distinct * from long where regexp_matches(v, '[\p{{L}}\p{{N}}]')
    and trim(lower(v), ' .,;:!?<>()[]{{}}-_') not in ({_NOTHING})),
ranked as (select *, row_number() over (partition by group_id, field_name
    order by coalesce(trust_rank, 2147483647), compiled_at desc nulls last, page_id) as n from said)
select group_id, field_name, page_id from ranked where n = 1""",
}
