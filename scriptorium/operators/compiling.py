"""Tasks, gates and pages of the compile phase, over whole tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.pages import body_of, frontmatter, items_of, safe_title, title_of
from scriptorium.session import numbered

# fixed values: required fields, kinds of concept, sections of a concept page
ARTICLE_FIELDS = ("title", "doc_type", "source_sha256", "concepts", "compiled_by", "tldr")
CONCEPT_FIELDS = ("name", "aliases", "doc_type", "summary")
CONCEPT_KINDS = ("product", "capability", "module", "framework", "method", "metric", "policy", "role", "other")
CHUNK = 20


def tasks(sources: DataFrame, kind: str = "compile_wiki") -> DataFrame:
    """(task_id, sha256, raw_path, status, enqueued_at): one pending task for each hash without
    pages; the earliest upload of a hash counts."""
    rows = sources.where("sha256 is not null").groupBy("sha256").agg(
        F.max(F.coalesce(F.size("generated_pages") > 0, F.lit(False))).alias("_done"),
        F.min_by(F.struct("raw_path", "uploaded_at"), "upload_id").alias("_f"))
    return rows.where("not _done").select(
        F.concat(F.substring("sha256", 1, 8), F.lit("_" + kind)).alias("task_id"), "sha256", F.col("_f.raw_path").alias("raw_path"),
        F.lit("pending").alias("status"), F.col("_f.uploaded_at").alias("enqueued_at"))


def move(tasks_: DataFrame, status: str, at: Column) -> DataFrame:
    """Tasks in another state: the first processing is stamped, so are done and failed, not review."""
    started = F.when(F.lit(status == "processing"), F.coalesce("started_at", at)).otherwise(F.col("started_at"))
    finished = F.when(F.lit(status in ("done", "failed")), at).otherwise(F.col("finished_at"))
    return tasks_.withColumns({"status": F.lit(status), "started_at": started, "finished_at": finished})


def prepare(tasks_: DataFrame, size: int = CHUNK) -> DataFrame:
    """(task_id, chunk): tasks in plain order, ``size`` to a chunk."""
    return numbered(tasks_.select("task_id"), ["task_id"], "_i").select("task_id", F.ceil(F.col("_i") / size).cast("int").alias("chunk"))


def articles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fm, concepts, confidence, title, body): texts with their frontmatter taken apart."""
    fm = frontmatter(text)
    rows = docs.where(F.col(text).isNotNull()).select(key, fm.alias("fm"), F.col(text).alias("_t"))
    return rows.select(key, "fm", items_of(F.coalesce(F.col("fm")["concepts"], F.lit(""))).alias("concepts"),
                       F.expr("try_cast(fm['confidence'] as double)").alias("confidence"),
                       F.coalesce(F.col("fm")["title"], title_of("_t")).alias("title"), body_of("_t").alias("body"))


def missing_fields(fm: Column, required: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(r) for r in required]), lambda k: ~F.coalesce(F.map_contains_key(fm, k), F.lit(False)))


def article_issues(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, level, issue): required fields, short tldr, few concepts, short body, no aliases."""
    fm = F.col("fm")
    body = F.length(F.trim("body"))
    errors = F.array_compact(F.array(
        *[F.when(~F.map_contains_key(fm, F.lit(k)), f"{k} missing") for k in ARTICLE_FIELDS],
        *[F.when(F.coalesce(fm[k] == "", F.lit(False)), f"{k} empty") for k in ("title", "doc_type")],
        F.when(F.length(F.coalesce(fm["tldr"], F.lit(""))) < 20, "tldr too short"),
        F.when(F.size("concepts") < 3, "fewer than three concepts"),
        F.when(body < 500, "body too short"),
    ))
    warnings = F.array_compact(F.array(F.when(~F.map_contains_key(fm, F.lit("aliases")), "aliases missing")))
    one = pages.select(key, F.lit("error").alias("level"), F.explode(errors).alias("issue"))
    return one.unionByName(pages.select(key, F.lit("warning").alias("level"), F.explode(warnings).alias("issue")))


def concept_issues(pages: DataFrame) -> DataFrame:
    """(page_id, issue) of concept rows: name, summary and path present, kind known, confidence in range."""
    issues = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name missing"),
        F.when(F.coalesce(F.trim("summary"), F.lit("")) == "", "summary missing"),
        F.when(F.col("aliases").isNull() | (F.size("aliases") == 0), "aliases missing"),
        F.when(F.col("concept_kind").isNull() | ~F.col("concept_kind").isin(list(CONCEPT_KINDS)), "kind unknown"),
        F.when(~F.coalesce(F.col("path").startswith("concepts/"), F.lit(False)), "path outside concepts"),
        F.when(~F.isnan("confidence") & ~F.col("confidence").between(0, 1), "confidence out of range"),
    ))
    return pages.select("page_id", F.explode(issues).alias("issue")).distinct()


def risk(pages: DataFrame, snapshot: DataFrame, key: str = "doc_id", least: float = 0.7) -> DataFrame:
    """(key, new_concepts, risk): review if a concept is not in the snapshot (name) or the
    confidence is under ``least`` or unknown; else auto."""
    known = snapshot.select(F.col("name").alias("c"), F.lit(True).alias("_k")).distinct()
    rows = pages.select(key, "confidence", F.explode_outer("concepts").alias("c")).join(known, "c", "left")
    out = rows.groupBy(key).agg(F.sum((F.col("c").isNotNull() & F.col("_k").isNull()).cast("int")).alias("new_concepts"), F.max("confidence").alias("_c"))
    review = (F.col("new_concepts") > 0) | F.coalesce(F.col("_c") < least, F.lit(True))
    return out.select(key, "new_concepts", F.when(review, "review").otherwise("auto").alias("risk"))


def concept_page(name: Column, aliases: Column, summary: Column, kind: Column, related: Column) -> Column:
    """The markdown of a concept page."""
    shown = F.when(kind.isin(list(CONCEPT_KINDS)), kind).otherwise("other")
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("name: "), name), F.concat(F.lit("aliases: ["), F.array_join(aliases, ", "), F.lit("]")),
                       F.lit("doc_type: concept"), F.concat(F.lit("concept_kind: "), shown), F.concat(F.lit("summary: "), F.coalesce(summary, F.lit(""))), F.lit("---"))
    links = F.array_join(F.transform(related, lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    return F.concat_ws("\n\n", head, F.concat(F.lit("# "), name), F.coalesce(summary, F.lit("")), F.concat(F.lit("## Related articles\n\n"), links))


def compiled_pages(pages: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(file, name, articles, body): the page of every concept that articles name, with links
    to them. Titles are collected as a set per concept, at most one a distinct title."""
    rows = pages.select("title", F.explode("concepts").alias("name")).where("title <> '' and name <> ''")
    made = rows.groupBy("name").agg(F.array_sort(F.collect_set("title")).alias("related"))
    made = made.join(index, "name", "left")
    body = concept_page(F.col("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.col("summary"), F.lit("other"), F.col("related"))
    return made.select(F.concat(F.lit("concepts/"), safe_title("name"), F.lit(".md")).alias("file"), "name", F.size("related").alias("articles"), body.alias("body"))


def tokens_of(text: Column | str) -> Column:
    """The estimate of the compile log: a token for two and a half characters."""
    return F.floor(F.length(text) / 2.5).cast("long")
