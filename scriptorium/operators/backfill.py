"""Frontmatter for legacy pages, taken from sources, nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.pages import title_of, wikilinks
from scriptorium.functions.paths import stem_of

# fixed values: relations by which an article names its concepts
CONCEPT_RELATIONS = ("includes_module", "references", "uses", "applied_to")


def sha_lookup(sources: DataFrame) -> DataFrame:
    """(stem, sha256): stems of made pages count before stems of file names; ties by hash."""
    made = sources.select(F.explode("generated_pages").alias("p"), "sha256").select(stem_of("p").alias("stem"), "sha256", F.lit(0).alias("k"))
    named = sources.select(stem_of("original_filename").alias("stem"), "sha256", F.lit(1).alias("k"))
    rows = made.unionByName(named).where("stem <> '' and sha256 is not null")
    return rows.groupBy("stem").agg(F.min_by("sha256", F.struct("k", "sha256")).alias("sha256"))


def concepts_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, concepts): labels of concepts each document names, in plain order."""
    named = nodes.where("file_type = 'concept' and label <> ''").select(F.col("id").alias("target"), "label")
    rows = edges.where(F.col("relation").isin(list(CONCEPT_RELATIONS))).join(named, "target")
    return rows.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("label")).alias("concepts"))


def needs_backfill(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pages without frontmatter, with their first title."""
    rows = docs.where(F.col(text).isNotNull() & ~F.col(text).rlike(r"\A---[ \t]*\n"))
    return rows.select("doc_id", title_of(text).alias("title"), F.length(text).alias("chars"))


def summary_paragraph(text: str):
    """The first paragraph that is no heading, 300 characters of it; empty if there is none."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("<!--") & ~p.startswith("---"))
    return F.substring(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), 1, 300)


def scalar(value: Column | str) -> Column:
    """A value in frontmatter: quoted text, numbers as they are, lists in brackets, nothing as \"\"."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))


def block(fields: dict[str, Column]) -> Column:
    """Frontmatter of one line a field; values are rendered already."""
    return F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()], F.lit("---"))


def article_pages(docs: DataFrame, sources: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): legacy articles with the frontmatter they lack, confidence 0.7; pages that
    have some are left out. ``concepts``: (stem, concepts) of the graph's nodes by file."""
    bare = docs.where(F.col("text").isNotNull() & ~F.col("text").rlike(r"\A---[ \t]*\n"))
    rows = article_fields(bare, sources).join(bare.select("doc_id", "stem", "text"), "doc_id")
    empty = F.array().cast("array<string>")
    if concepts is not None:
        one = concepts.where("stem is not null").groupBy("stem").agg(F.min("concepts").alias("_c"))
        rows = rows.join(one, "stem", "left")
    names = F.coalesce("_c", empty) if concepts is not None else empty
    listed = F.concat(F.lit("["), F.array_join(F.transform(names, lambda x: scalar(x)), ", "), F.lit("]"))
    head = block({"title": scalar("title"), "doc_type": scalar(F.lit("article")), "source_sha256": scalar("source_sha256"), "concepts": listed, "aliases": F.lit("[]"),
                  "tldr": scalar("summary"), "created_at": scalar(F.col("created").cast("string")), "compiled_by": scalar(F.lit("backfill")), "confidence": F.lit("0.7")})
    return rows.select("doc_id", F.concat(head, F.lit("\n\n"), "text").alias("text"))


def node_of_file(nodes: DataFrame) -> DataFrame:
    """(source_file, id, label, file_type): the node of each file, the first by id."""
    rows = nodes.where("source_file <> ''").groupBy("source_file").agg(F.min_by(F.struct("id", "label", "file_type"), "id").alias("_n"))
    return rows.select("source_file", "_n.id", "_n.label", "_n.file_type")


def article_fields(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, title, source_sha256, summary, created): what a legacy article gets."""
    rows = docs.where("text is not null").select("doc_id", "stem", title_of("text").alias("title"), summary_paragraph("text").alias("summary"), F.to_date("created_at").alias("created"))
    return rows.join(sha_lookup(sources), "stem", "left").select("doc_id", "title", F.substring("sha256", 1, 16).alias("source_sha256"), "summary", "created")


def related_count(text: str, heading: str = "Related articles"):
    """How many bullets stand under a heading, up to the next one."""
    block = F.regexp_extract(text, r"(?ms)^#+\s*" + heading + r"\s*$(.*?)(?=^#|\z)", 1)
    return F.size(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*[-*]\s+\S"), F.lit(0)))


def concept_fields(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, name, summary, articles): what a legacy concept page gets; how many texts link to it."""
    links = docs.where("text is not null").select("doc_id", F.explode(wikilinks("text")).alias("name"))
    counted = links.groupBy("name").agg(F.count("*").alias("articles"))
    rows = pages.where("page_id is not null").select("page_id", "name", F.substring("summary", 1, 300).alias("summary")).distinct()
    return rows.join(counted, "name", "left").na.fill(0, ["articles"]).select("page_id", "name", "summary", "articles")


def done(docs: DataFrame) -> DataFrame:
    """(state, n): pages that have frontmatter and pages that need it."""
    front = F.col("text").rlike(r"\A---[ \t]*\n")
    return docs.where("text is not null").groupBy(F.when(front, "skipped").otherwise("done").alias("state")).agg(F.count("*").alias("n"))
