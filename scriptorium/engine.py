"""The engine: the pipelines as methods over a warehouse folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.convert import convert
from scriptorium.operators import analytics, compiling, concepts, exports, graph, ingest, louvain, retrieval, structure, verify, writing
from scriptorium.session import cut
from scriptorium.sources.warehouse import Warehouse

VERSION = "0.2.0"
SOURCES = "sha256 string, original_filename string, raw_path string, generated_pages array<string>, text string"
TASKS = "task_id string, sha256 string, raw_path string, status string, enqueued_at timestamp, started_at timestamp, finished_at timestamp"
PARTIALS = "task_id string, seq long, name string, path string, aliases array<string>, summary string, article_count long"
INDEX = "name string, path string, aliases array<string>, summary string, article_count long"
PAGES = "path string, text string"
HYPER = "id string, members array<string>"


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Warehouse(spark, root)

    def init(self) -> list[str]:
        """Makes the tables that are not there yet, empty; their names. What is there stays."""
        made = []
        for name, schema in (("sources", SOURCES), ("tasks", TASKS), ("partials", PARTIALS), ("concepts_index", INDEX), ("articles", PAGES), ("concepts", PAGES)):
            if not self.store.has(name):
                self.store.write(name, self.spark.createDataFrame([], schema), "status" if name == "tasks" else None)
                made.append(name)
        return made

    def ingest(self, folder: str, ignore: list[str | tuple[str, str]] | None = None, auto_update: bool = True) -> DataFrame:
        """Scan a folder, convert what is taken and classify it against the sources; the class
        of every file. New and updated files join the sources and get their structure, a task
        and an event; what an update replaces leaves them for the trash. Without
        ``auto_update`` a file of a known name is new and replaces nothing."""
        files = ingest.classify(ingest.scan(self.spark, folder), ignore=ignore).where("status = 'taken'")
        made = cut(files.select("path", F.sha2("content", 256).alias("sha256")).join(convert(files), "path"))
        name = F.regexp_extract("path", "([^/]*)$", 1)
        rows = made.select(F.xxhash64("path").alias("upload_id"), "sha256", name.alias("original_filename"), F.length(F.trim("markdown")).cast("long").alias("chars"))
        known = cut(self.store.read("sources", SOURCES))
        found = ingest.ingest(rows, known)
        if not auto_update:
            found = found.withColumns({"status": F.when(F.col("status") == "updated", "new").otherwise(F.col("status")), "replaces": F.lit(None).cast("string")})
        found = cut(found.join(rows.select("upload_id", "original_filename"), "upload_id"))
        new = found.where("status in ('new', 'updated')").select("sha256").distinct().join(made, "sha256").dropDuplicates(["sha256"])
        new = cut(new.select("sha256", name.alias("original_filename"), F.col("path").alias("raw_path"), F.array().cast("array<string>").alias("generated_pages"), F.col("markdown").alias("text")))
        gone = cut(found.where("replaces is not null").select(F.col("replaces").alias("sha256")).distinct())
        left, trash = ingest.remove(known.select(*new.columns), gone, F.current_timestamp())
        left, trash = cut(left.join(new.select("sha256"), "sha256", "left_anti")), cut(trash)
        self.store.write("sources", left.unionByName(new))
        if not trash.isEmpty():
            self.store.append("trash", trash)
        self.store.append("structure", structure.structure(new, "sha256", "text"))
        tasks = compiling.tasks(new.select("sha256", "raw_path", "generated_pages", F.current_timestamp().alias("uploaded_at"), F.xxhash64("raw_path").alias("upload_id")))
        self._tasks(tasks.select("task_id", "sha256", "raw_path", "status", "enqueued_at", *[F.lit(None).cast("timestamp").alias(c) for c in ("started_at", "finished_at")]), gone)
        self.store.append("events", new.select("sha256", F.lit("ingested").alias("event"), F.array("original_filename").alias("pages")))
        return found

    def _tasks(self, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Tasks written by status; those of ``changed`` take the place of the known ones."""
        known = cut(self.store.read("tasks", TASKS))
        if gone is not None:
            known = known.join(gone, "sha256", "left_anti")
        left = known.join(changed.select("task_id"), "task_id", "left_anti")
        self.store.write("tasks", cut(left.select(*changed.columns).unionByName(changed)), "status")

    def tasks(self, status: str | None = None) -> DataFrame:
        """Tasks of a state, by id; only the folder of that state is read."""
        rows = self.store.read("tasks", TASKS)
        return (rows.where(F.col("status") == status) if status else rows).orderBy("task_id")

    def prepare(self, size: int = compiling.CHUNK) -> DataFrame:
        """Pending tasks go into work, in chunks; the concept index is kept as the run finds it."""
        made = cut(compiling.move(self.store.read("tasks", TASKS).where("status = 'pending'"), "processing", F.current_timestamp()))
        self.store.write("snapshot", cut(self.store.read("concepts_index", INDEX)))
        self._tasks(made)
        return made.join(compiling.prepare(made, size), "task_id")

    def context(self, tasks: DataFrame) -> DataFrame:
        """The concepts each task is given to read."""
        terms = self.store.read("structure").select("sha256", F.explode(F.transform("key_terms", lambda x: x["term"])).alias("term"))
        return writing.context(tasks, terms, self.store.read("concepts_index", INDEX), self.store.read("concepts", PAGES))

    def write(self, deliveries: DataFrame) -> DataFrame:
        """What agents deliver for tasks becomes pages, partial rows, states, log and events, all
        together; (task_id, issue) of deliveries that do not pass, of which nothing is written."""
        pages = cut(self.store.read("concepts", PAGES))
        out = {k: cut(v) for k, v in writing.write(deliveries, self.store.read("snapshot", INDEX), pages, F.current_date()).items()}
        kept = cut(self.store.read("articles", PAGES).join(out["articles"].select("path"), "path", "left_anti"))
        self.store.write("articles", kept.unionByName(out["articles"].select("path", "text")))
        self.store.write("concepts", cut(pages.join(out["concepts"].select("path"), "path", "left_anti").unionByName(out["concepts"].select("path", "text"))))
        # one folder a task: a task that is written again takes the place of what it wrote
        self.store.replace("partials", out["partials"], "task_id")
        known = self.store.read("tasks", TASKS).join(out["tasks"].select("task_id", F.col("status").alias("_s")), "task_id")
        self._tasks(cut(known.withColumn("status", F.col("_s")).drop("_s").withColumn("finished_at", F.when(F.col("status") == "done", F.current_timestamp()))))
        sources = self.store.read("sources", SOURCES)
        self.store.write("sources", cut(writing.with_pages(sources, out["articles"])))
        self.store.append("costs", out["costs"])
        self.store.append("events", out["events"])
        return out["issues"]

    def dirty(self) -> bool:
        """Whether there are partial rows that no reduce has merged."""
        return not self.store.read("partials", PARTIALS).isEmpty()

    def reduce(self, partials: DataFrame | None = None) -> DataFrame:
        """Partial rows (those delivered, or all that tasks have written) merged into the concept
        index there is; reducing again changes nothing, since merged rows are gone."""
        own = partials is None
        rows = self.store.read("partials", PARTIALS) if own else partials
        base = self.store.read("concepts_index", INDEX).withColumn("seq", F.lit(-(2**62)).cast("long"))
        columns = ["seq", "name", "path", "aliases", "summary", "article_count"]
        index = cut(concepts.backfill_aliases(concepts.reduce_index(base.select(*columns).unionByName(rows.select(*columns)))))
        self.store.write("concepts_index", index)
        if own:
            self.store.write("partials", self.spark.createDataFrame([], PARTIALS), "task_id")
        return index

    def build_graph(self, nodes: DataFrame, edges: DataFrame, index: DataFrame | None = None, hyper: DataFrame | None = None) -> dict[str, DataFrame]:
        """The whole pipeline: validation, files and aliases consolidated, validation again, the
        graph with its hyperedges, communities, analytics, reports, exports, indexes, and a run
        record. ``index``: the concept index, else the one of the store."""
        began = time.time()
        hyper = self.spark.createDataFrame([], HYPER) if hyper is None else hyper
        index = cut(concepts.backfill_aliases(self.store.read("concepts_index", INDEX) if index is None else index))
        raw = cut(graph.issues(nodes, edges).unionByName(graph.hyper_issues(hyper, nodes)))
        n, by_file = graph.consolidate(nodes)
        n, by_file = cut(n), cut(by_file)
        e, h = graph.redirect_edges(edges, by_file), graph.redirect_members(hyper, by_file)
        n, by_name = graph.merge_aliases(n, concepts.canonical_map(index))
        n, by_name = cut(n), cut(by_name)
        e, h = graph.redirect_edges(e, by_name), graph.redirect_members(h, by_name, 1)
        n = cut(graph.merge_nodes(n))
        e = cut(e)
        h = cut(graph.attach(self.spark.createDataFrame([], HYPER), h))
        issues = cut(graph.issues(n, e).unionByName(graph.hyper_issues(h, n)))
        _, dropped = graph.pruned(n, e)
        e = cut(graph.build_edges(e, n))
        m = cut(louvain.clusters(n, e))
        out = {"issues": raw, "issues_left": issues, "nodes": n, "edges": e, "hyperedges": h, "membership": m, "cohesion": analytics.cohesion(m, e),
               "god_nodes": analytics.god_nodes(n, e), "surprising": analytics.surprising(n, e, m, reasons=True), "gaps": analytics.gaps(n, e, m),
               "bridges": analytics.bridges(n, e, m), "names": analytics.name_communities(n, e, m), "questions": analytics.questions(n, e, m),
               "report": exports.summary_lines(n, e, m), "report_full": exports.full_lines(n, e, m, h), "node_links": exports.node_links(n, e, m),
               "vis_nodes": exports.vis_nodes(n, e, m), "notes": exports.notes(n, e, m), "community_notes": exports.community_notes(n, e, m),
               "canvas": exports.canvas_cards(n, m), "pages": exports.community_pages(n, e, m).unionByName(exports.god_pages(n, e)), "index": exports.index_lines(n, e, m),
               "verify": verify.verify_graph(n, e, m)}
        for name in ("nodes", "edges", "hyperedges", "membership", "names", "report", "report_full", "node_links", "pages"):
            self.store.write(f"graph_{name}" if name in ("names", "report", "report_full", "node_links", "pages") else name, out[name])
        counts = [("nodes", n.count()), ("edges", e.count()), ("communities", out["names"].count()), ("hyperedges", h.count()), ("edges_pruned", dropped),
                  ("source_file_redirects", by_file.count()), ("alias_redirects", by_name.count()), ("issues_raw", raw.count()), ("issues_left", issues.count())]
        state = "success" if not counts[-1][1] else "partial"
        out["stats"] = self.spark.createDataFrame(counts, "stat string, n long")
        self.record("graph", state, time.time() - began, dict(counts))
        return out

    def record(self, command: str, status: str, seconds: float, stats: dict[str, int]) -> None:
        """A row in the log of runs."""
        row = [(command, status, float(seconds), {k: int(v) for k, v in stats.items()})]
        self.store.append("runs", self.spark.createDataFrame(row, "command string, status string, seconds double, stats map<string,long>"))

    def query(self, question: str, filters: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
        """The answer's pages and text, and a row in the query log."""
        n, e = self.store.read("nodes"), self.store.read("edges")
        found = retrieval.ask(n, e, question, filters)
        asked = self.spark.createDataFrame([(question,)], "question string").select(F.substring(F.sha2("question", 256), 1, 8).alias("query_id"), "question")
        self.store.append("query_log", asked)
        return found

    def save_answer(self, question: str, answer: str, nodes: list[str], satisfied: bool = True) -> DataFrame:
        """(path, text): an answer kept as a page for the next extraction."""
        row = self.spark.createDataFrame([(question, answer, nodes, satisfied)], "question string, answer string, nodes array<string>, satisfied boolean")
        page = retrieval.answer_page(F.col("question"), F.col("answer"), F.col("nodes"), F.col("satisfied"), F.current_timestamp())
        made = cut(row.select(F.concat(F.lit("memory/query_"), F.substring(F.sha2("question", 256), 1, 8), F.lit(".md")).alias("path"), page.alias("text")))
        self.store.append("memory", made)
        return made

    def status(self) -> DataFrame:
        """(part, n): rows of each table, and tasks of each state."""
        out = [(name, self.store.read(name).count() if self.store.has(name) else 0) for name in ("sources", "articles", "concepts", "tasks", "concepts_index", "nodes", "edges", "membership", "query_log")]
        states = self.store.read("tasks", TASKS).groupBy("status").count().collect()  # five states at most
        return self.spark.createDataFrame(out + sorted((f"tasks {r['status']}", r["count"]) for r in states), "part string, n long")

    def verify_compile(self) -> DataFrame:
        """What is wrong with articles, concept pages, index and tasks."""
        articles, pages = self.store.read("articles", PAGES), self.store.read("concepts", PAGES)
        out = verify.verify_wiki(articles, pages, self.store.read("concepts_index", INDEX), self.store.read("tasks", TASKS))
        checked = compiling.article_issues(compiling.articles(articles, "path", "text"), "path").unionByName(writing.text_issues(articles, "path"))
        out = out.unionByName(checked.where("level = 'error'").select(F.col("issue").alias("check"), F.col("path").alias("ref")))
        return out.unionByName(writing.concept_text_issues(pages).select(F.col("issue").alias("check"), F.col("path").alias("ref")))

    def verify_ingest(self) -> DataFrame:
        """What is wrong with sources, their structure and their tasks."""
        sources = self.store.read("sources", SOURCES)
        built = self.store.read("structure") if self.store.has("structure") else self.spark.createDataFrame([], "sha256 string, headings array<string>")
        rows = sources.select(F.col("sha256").alias("upload_id"), "sha256", "raw_path", "original_filename")
        one = ingest.verify_ingest(rows, sources.select("sha256", F.col("text").alias("content_md")))
        filled = built.select("sha256", F.coalesce("headings", F.array()).alias("headings"))
        return one.unionByName(ingest.verify_tasks(sources, filled, self.store.read("tasks", TASKS)))

    def verify_graph(self) -> DataFrame:
        """What is wrong with the graph that is stored."""
        return verify.verify_graph(*(self.store.read(x) for x in ("nodes", "edges", "membership")))

    def audit(self, stems: DataFrame, remove: bool = False) -> DataFrame:
        """(id, label, pages): orphans and how many articles hold their label as text; with
        ``remove`` the graph is written again without those no article holds, hyperedges
        included, and the graph as it was is kept beside it."""
        n, e = self.store.read("nodes"), self.store.read("edges")
        hyper = self.store.read("hyperedges", HYPER)
        found = cut(graph.orphans(n, e, stems, hyper))
        told = retrieval.evidence(self.store.read("articles", PAGES), found).groupBy("id").agg(F.count("*").alias("pages"))
        found = cut(found.join(told, "id", "left").na.fill(0, ["pages"]))
        if remove:
            gone = found.where("pages = 0")
            left = [cut(x) for x in (*graph.without(n, e, gone), graph.shrunk(hyper, gone).select("id", "members"))]
            for name, df in zip(("nodes", "edges", "hyperedges"), left):
                self.store.write(f"{name}_before", self.store.read(name, HYPER if name == "hyperedges" else None))
                self.store.write(name, df)
        return found

    def merge_duplicates(self, decided: DataFrame) -> DataFrame:
        """(path, text): concept pages after others (canonical_name, duplicate) were merged into
        them: the duplicate's text becomes a section, its name and aliases aliases of the
        canonical entry, its own entry leaves the index. Decisions about names that are not
        in the index are passed over; pages before are kept."""
        index, pages = cut(self.store.read("concepts_index", INDEX)), cut(self.store.read("concepts", PAGES))
        pairs = decided.select("canonical_name", "duplicate").where("canonical_name <> duplicate").distinct()
        pairs = pairs.join(index.select(F.col("name").alias("canonical_name"), F.col("path").alias("to")), "canonical_name").join(
            index.select(F.col("name").alias("duplicate"), F.col("path").alias("from"), F.col("aliases").alias("more")), "duplicate")
        pairs = cut(pairs.groupBy("duplicate", "from", "more").agg(F.min(F.struct("canonical_name", "to")).alias("_c")).select("duplicate", "from", "more", "_c.*"))
        told = pairs.join(pages.select(F.col("path").alias("from"), F.col("text").alias("_t")), "from", "left")
        parts = told.groupBy(F.col("to").alias("path")).agg(F.array_sort(F.collect_list(F.struct("duplicate", F.concat(F.lit("## "), "duplicate", F.lit("\n\n"), writing.body_of(F.coalesce("_t", F.lit("")))).alias("s")))).alias("_s"))
        changed = cut(pages.join(parts, "path").select("path", F.concat_ws("\n\n", "text", F.array_join(F.transform("_s", lambda x: x["s"]), "\n\n")).alias("text")))
        self.store.write("concepts_before", pages)
        gone = pairs.select(F.col("from").alias("path")).distinct()
        self.store.write("concepts", cut(pages.join(changed.select("path"), "path", "left_anti").unionByName(changed).join(gone, "path", "left_anti")))
        names = pairs.groupBy(F.col("canonical_name").alias("name")).agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("duplicate"), F.coalesce("more", F.array().cast("array<string>")))))).alias("_a"))
        left = index.join(pairs.select(F.col("duplicate").alias("name")), "name", "left_anti").join(names, "name", "left")
        self.store.write("concepts_index", cut(left.withColumn("aliases", F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("_a", F.array().cast("array<string>"))))).drop("_a").select("name", "path", "aliases", "summary", "article_count")))
        return changed
