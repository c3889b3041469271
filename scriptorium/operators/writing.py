"""The write step of the compile phase, over all deliveries of a run at once: gate, pages,
partial rows, risk, task states, log and events; and what a task is given to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.pages import body_of, frontmatter, safe_title
from scriptorium.operators import compiling, concepts
from scriptorium.session import numbered, skew_lookup

# fixed values: headings of an article by its type, of a concept page, and of its list of articles
SECTIONS = {
    "solution": ("项目背景", "核心需求", "解决方案", "关键模块", "KPI 与指标", "报价结构", "时间线", "关联概念", "来源"),
    "manual": ("适用版本", "前置条件", "操作步骤", "故障码", "注意事项", "关联概念", "来源"),
    "faq": ("问题与答案", "关联概念", "来源"),
    "step": ("流程节点", "责任人", "输入", "输出", "注意事项", "关联概念", "来源"),
}
CONCEPT_SECTIONS = ("概要", "关键特征", "在方案中的应用", "相关概念")
RELATED = "## 相关文章"
SUMMARY, DETAIL = "## 核心摘要", "## 详细内容"
LEAST_CONCEPTS, LEAST_BODY, LEAST_CONCEPT_BODY = 3, 500, 200

#: What an agent delivers for a task.
DELIVERIES = (
    "task_id string, sha256 string, title string, text string, confidence double, input_chars long, "
    "concepts array<struct<name: string, summary: string, aliases: array<string>, domain: array<string>, concept_kind: string, "
    "sections: array<struct<heading: string, content: string>>>>"
)


def sections_of(doc_type: Column | str) -> Column:
    """The headings of an article of a type; an unknown type has those of a solution."""
    known = F.create_map(*[x for k, v in SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(known[F.col(doc_type) if isinstance(doc_type, str) else doc_type], F.array(*map(F.lit, SECTIONS["solution"])))


def _listed(items: Column) -> Column:
    quoted = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit('"'), F.coalesce(x, F.lit("")), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _line(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'{key}: "'), F.coalesce(value, F.lit("")), F.lit('"'))


def article_head(values: dict[str, Column], created: Column) -> Column:
    """The frontmatter of an article. ``values`` by field; lists are domain, topic, concepts
    and aliases; a field that is absent is empty, the type is solution, confidence 0.9."""
    text = lambda k: _line(k, values.get(k, F.lit("")))
    many = lambda k: F.concat(F.lit(f"{k}: "), _listed(values.get(k, F.array().cast("array<string>"))))
    return F.concat_ws(
        "\n", F.lit("---"), text("title"), F.concat(F.lit("doc_type: "), F.coalesce(values.get("doc_type", F.lit(None).cast("string")), F.lit("solution"))),
        many("domain"), many("topic"), text("region"), text("customer"), text("customer_type"), text("source_sha256"), many("concepts"), many("aliases"),
        F.concat(F.lit('created_at: "'), F.date_format(created, "yyyy-MM-dd"), F.lit('"')), text("compiled_by"),
        F.concat(F.lit("confidence: "), F.coalesce(values.get("confidence", F.lit(0.9)), F.lit(0.9)).cast("string")), text("tldr"), F.lit("---"))


def concept_page(c: Column, title: Column, today: Column) -> Column:
    """The page of a concept (name, summary, aliases, domain, concept_kind, sections) that an
    article names first: eleven lines of frontmatter, its sections or else its summary, and
    the list of articles, unless a section is that list."""
    kind = F.when(c["concept_kind"].isin(list(compiling.CONCEPT_KINDS)), c["concept_kind"]).otherwise("other")
    day = F.date_format(today, "yyyy-MM-dd")
    head = F.concat_ws(
        "\n", F.lit("---"), _line("name", c["name"]), F.concat(F.lit("aliases: "), _listed(c["aliases"])), _line("summary", c["summary"]),
        F.concat(F.lit("domain: "), _listed(c["domain"])), F.lit('doc_type: "concept"'), _line("concept_kind", kind), F.lit("article_count: 1"),
        _line("created_at", day), _line("updated_at", day), F.lit("---"))
    parts = F.coalesce(c["sections"], F.array().cast("array<struct<heading: string, content: string>>"))
    told = F.array_join(F.transform(parts, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), F.trim(F.coalesce(s["content"], F.lit(""))), F.lit("\n"))), "\n")
    body = F.when(F.size(parts) > 0, told).otherwise(F.concat(F.coalesce(c["summary"], F.lit("")), F.lit("\n")))
    listed = F.exists(parts, lambda s: s["heading"] == RELATED[3:])
    more = F.when(listed | (F.coalesce(title, F.lit("")) == ""), F.lit("")).otherwise(F.concat(F.lit(f"\n{RELATED}\n- [["), title, F.lit("]]\n")))
    return F.concat(head, F.lit("\n\n# "), c["name"], F.lit("\n\n"), body, more)


def named(text: Column, title: Column) -> Column:
    """A page that names one more article: unchanged if the title is in it already, else the
    article is added at the end, under the heading of articles."""
    bare = F.regexp_replace(text, r"\s+\z", "")
    link = F.concat(F.lit("- [["), title, F.lit("]]\n"))
    added = F.when(F.contains(text, F.lit(RELATED)), F.concat(bare, F.lit("\n"), link)).otherwise(F.concat(bare, F.lit(f"\n\n{RELATED}\n"), link))
    return F.when(F.contains(text, title), text).otherwise(added)


def gate(deliveries: DataFrame) -> DataFrame:
    """(task_id, issue): why a delivery is not written; none if it is."""
    fm = frontmatter("text")
    rows = deliveries.select("task_id", F.coalesce(F.size(F.filter("concepts", lambda c: F.coalesce(c["name"], F.lit("")) != "")), F.lit(0)).alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("fm", fm)
    issues = F.array_compact(F.array(
        F.when(F.col("n") < LEAST_CONCEPTS, "fewer than three concepts"),
        *[F.when(~F.coalesce(F.map_contains_key("fm", F.lit(k)), F.lit(False)), f"{k} missing") for k in compiling.ARTICLE_FIELDS],
        *[F.when(F.coalesce(F.col("fm")[k] == "", F.lit(False)), f"{k} empty") for k in ("title", "doc_type")],
    ))
    return rows.select("task_id", F.explode(issues).alias("issue")).distinct()


def write(deliveries: DataFrame, snapshot: DataFrame, pages: DataFrame, today: Column, least: float = 0.7) -> dict[str, DataFrame]:
    """All that a run of deliveries changes, by table:

    issues (task_id, issue) of those that don't pass the gate, of which nothing else is
    written; articles (path, sha256, text), the last delivery of a path; concepts (path,
    name, text, created), new pages and known ones with the articles added in the order of
    tasks; partials (task_id, seq, name, path, aliases, summary, article_count); tasks
    (task_id, sha256, status), review or done; costs; events.

    ``pages`` are the concept pages there are (path, text), ``snapshot`` the concept index
    before the run (name). Deliveries without a task are left out, a task delivered again
    with all the same counts once; concepts without a name are passed over. A page is one
    text, so it grows with the articles that name its concept.
    """
    rows = deliveries.where("task_id is not null").select("task_id", "sha256", "title", "text", "confidence", "input_chars", "concepts").distinct()
    issues = gate(rows)
    ok = rows.join(issues.select("task_id").distinct(), "task_id", "left_anti")
    path = F.concat(F.lit("articles/"), safe_title("title"), F.lit(".md"))
    files = ok.select("task_id", "sha256", path.alias("path"), "text")
    articles = files.groupBy("path").agg(F.max_by(F.struct("sha256", "text"), F.struct("task_id", "sha256")).alias("_f")).select("path", "_f.sha256", "_f.text")
    each = ok.select("task_id", "title", F.posexplode("concepts").alias("pos", "c")).where("c.name <> ''")
    name = F.regexp_replace("c.name", r'[\\/*?:"<>|]', "")
    each = each.withColumn("path", F.concat(F.lit("concepts/"), name, F.lit(".md")))
    order = F.struct("task_id", "pos")
    told = each.groupBy("path").agg(F.min_by(F.struct("c", "title"), order).alias("_f"), F.array_sort(F.collect_list(F.struct("task_id", "pos", "title"))).alias("_t"))
    known = pages.where("path is not null and text is not null").groupBy("path").agg(F.max("text").alias("_old"))
    told = told.join(known, "path", "left")
    first = concept_page(F.col("_f.c"), F.col("_f.title"), today)
    start = F.coalesce("_old", first)
    rest = F.when(F.col("_old").isNull(), F.slice("_t", 2, 1 << 30)).otherwise(F.col("_t"))
    text = F.aggregate(F.filter(rest, lambda t: F.coalesce(t["title"], F.lit("")) != ""), start, lambda acc, t: named(acc, t["title"]))
    made = told.select("path", F.col("_f.c.name").alias("name"), text.alias("text"), F.col("_old").isNull().alias("created"))
    partials = numbered(each.select("task_id", "pos", F.col("c.name").alias("name"), "path", F.col("c.aliases").alias("aliases"), F.col("c.summary").alias("summary")), ["task_id", "pos", "name"], "seq")
    partials = partials.select("task_id", "seq", "name", "path", "aliases", "summary", F.lit(1).cast("long").alias("article_count"))
    states = risk(ok, snapshot, least)
    tasks = states.join(ok.select("task_id", "sha256").distinct(), "task_id").select("task_id", "sha256", F.when(F.col("risk") == "review", "review").otherwise("done").alias("status"))
    costs = ok.join(states, "task_id").select(
        "task_id", "title", F.size("concepts").alias("concepts"), "confidence", "risk", "new_concepts", "input_chars", F.length("text").alias("output_chars"),
        compiling.tokens_of("text").alias("tokens"))
    events = files.select("sha256", F.lit("wiki_updated").alias("event"), F.array("path").alias("pages")).distinct()
    return {"issues": issues, "articles": articles, "concepts": made, "partials": partials, "tasks": tasks, "costs": costs, "events": events}


def risk(deliveries: DataFrame, snapshot: DataFrame, least: float = 0.7) -> DataFrame:
    """(task_id, new_concepts, risk) of deliveries, as ``compiling.risk``."""
    rows = deliveries.select("task_id", "confidence", F.filter(F.transform("concepts", lambda c: c["name"]), lambda x: x != "").alias("concepts"))
    return compiling.risk(rows, snapshot, "task_id", least)


def with_pages(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Sources with the articles (path, sha256) just made of them as their pages."""
    made = articles.where("sha256 is not null").groupBy("sha256").agg(F.array_sort(F.collect_set("path")).alias("_p"))
    rest = [c for c in sources.columns if c != "generated_pages"]
    return skew_lookup(sources, made, "sha256", "left").select(*rest, F.coalesce("_p", "generated_pages").alias("generated_pages"))


def context(tasks: DataFrame, terms: DataFrame, index: DataFrame, pages: DataFrame | None = None, key: str = "sha256", top: int = 5) -> DataFrame:
    """(key, ord, name, summary, aliases, article_count): the concepts a task is given to read,
    best first: those that share most terms (key, term) with its text. A concept without a
    summary is told by the first paragraph of its page (path, text)."""
    found = concepts.match_terms(terms.join(tasks.select(key).distinct(), key, "left_semi"), index, key, top)
    rows = found.join(index, "name")
    summary = F.col("summary")
    if pages is not None:
        rows = rows.join(pages.select("path", first_paragraph("text").alias("_p")).where("path is not null").groupBy("path").agg(F.max("_p").alias("_p")), "path", "left")
        summary = F.coalesce(F.when(F.trim("summary") != "", F.col("summary")), F.when(F.col("_p") != "", F.col("_p")), F.col("summary"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "name"))
    return rows.select(key, order.alias("ord"), "name", summary.alias("summary"), "aliases", "article_count")


def first_paragraph(text: Column | str) -> Column:
    """The first line of a page that is no heading and not blank, outside its frontmatter."""
    lines = F.filter(F.transform(F.split(body_of(text), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & (x != "---"))
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def text_issues(pages: DataFrame, key: str = "doc_id", text: str = "text", strict: bool = False) -> DataFrame:
    """(key, level, issue) of articles beyond ``compiling.article_issues``: a detailed part that
    repeats the summary (blocks over 200 characters, lengths within 5 %, the first 200 alike),
    aliases that are no list, and, with ``strict``, aliases that are missing."""
    fm, body = frontmatter(text), body_of(text)
    at, to = F.instr(body, SUMMARY), F.instr(body, DETAIL)
    rows = pages.where(F.col(text).isNotNull()).select(key, fm.alias("fm"), body.alias("b"), at.alias("at"), to.alias("to"))
    a, b = F.substr("b", F.col("at"), F.col("to") - F.col("at")), F.substr("b", F.col("to"))
    both = (F.col("at") > 0) & (F.col("to") > F.col("at")) & (F.length(a) > 200) & (F.length(b) > 200)
    alike = (F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)) > 0.95) & (
        F.substring(a, 1, 200) == F.substring(F.concat(F.lit(SUMMARY), F.substr(b, F.lit(len(DETAIL) + 1))), 1, 200))
    has = F.map_contains_key("fm", F.lit("aliases"))
    issues = F.array_compact(F.array(
        F.when(both & alike, "detail repeats the summary"), F.when(has & ~F.col("fm")["aliases"].rlike(r"^\[.*\]$"), "aliases are no list"),
        *([F.when(~has, "aliases missing")] if strict else [])))
    return rows.select(key, F.lit("error").alias("level"), F.explode(issues).alias("issue")).distinct()


def concept_text_issues(pages: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, issue) of the texts of concept pages: fields that are missing, a type that is not
    concept, an unknown kind, sections that are missing, a short body."""
    fm = F.col("fm")
    rows = pages.where(F.col(text).isNotNull()).select(key, frontmatter(text).alias("fm"), body_of(text).alias("b"))
    issues = F.array_compact(F.array(
        *[F.when(~F.map_contains_key(fm, F.lit(k)), f"{k} missing") for k in compiling.CONCEPT_FIELDS],
        F.when(F.map_contains_key(fm, F.lit("doc_type")) & (F.coalesce(fm["doc_type"], F.lit("")) != "concept"), "no concept page"),
        F.when(~F.coalesce(fm["concept_kind"], F.lit("")).isin(list(compiling.CONCEPT_KINDS)), "kind unknown"),
        *[F.when(~F.contains("b", F.lit(f"## {s}")), f"{s} missing") for s in CONCEPT_SECTIONS],
        F.when(F.length(F.trim("b")) < LEAST_CONCEPT_BODY, "body too short"),
    ))
    return rows.select(key, F.explode(issues).alias("issue")).distinct()
