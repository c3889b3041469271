"""Small cases of the operators: what the tables do not hold."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium import session
from scriptorium.functions import convert, pages, paths
from scriptorium.operators import analytics, compiling, concepts, exports, graph, ingest, louvain, retrieval, structure
from scriptorium.sources import warehouse
from scriptorium.streaming import jobs


def col(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr("x")).first()[0]


TEXT = "# One\n###Two\n####### Seven\n#\n|a|b|\n|---|---|\n|1|2|\n|3|4|\nx\n|not|\n- a\n  - b\n\n- c\n1. x\n2. y\nAI AI 95% and 95% 30人 检索门户 检索门户 Search Portal, Search Portal\n"


def test_structure(spark, rows):
    docs = spark.createDataFrame([(1, TEXT, 0, "p"), (2, None, 0, "p"), (3, "", 0, "p")], "doc_id long, text string, line int, raw string")
    assert rows(structure.headings(docs)) == [(1, 1, 1, "One"), (1, 2, 3, "Two")]
    assert rows(structure.tables(docs)) == [(1, 5, ["a", "b"], 2)]
    assert rows(structure.lists(docs)) == [(1, "ordered", 15, 2, 1), (1, "unordered", 11, 3, 2)]
    assert {r[1] for r in rows(structure.metrics(docs))} == {"95%", "30人"}
    assert [(r[1], r[2]) for r in rows(structure.key_terms(docs))] == [("AI", 2), ("Search Portal", 2), ("检索门户", 2)]
    assert {r["doc_id"] for r in structure.structure(docs).collect()} == {1, 3}


@pytest.mark.parametrize("path,kind,secret", [("a/B.MD", "document", False), ("x.pdf", "paper", False), ("my_token.txt", "document", True), (".env", None, True), ("k.pem", None, True), ("noend", None, False), (None, None, None)])
def test_paths(spark, path, kind, secret):
    assert col(spark, paths.file_class, path) == kind and col(spark, paths.is_secret, path) == secret


def test_ignore_noise_urls_and_stems(spark):
    for path, ignored in [("a/b/c.md", True), ("x/draft-1.md", True), ("x/keep.md", False)]:
        assert col(spark, lambda x: paths.is_ignored(x, ["b", "draft-*", "# note", ""]), path) == ignored
    assert col(spark, paths.in_noise, "a/node_modules/b.md") and not col(spark, paths.in_noise, "a/b.md")
    for url, safe in [("https://example.org/a", True), ("http://169.254.169.254/x", False), ("ftp://example.org", False), ("http://10.0.0.1", False), ("http://user@localhost:8/", False)]:
        assert col(spark, paths.safe_url, url) == safe
    assert [col(spark, paths.stem_of, x) for x in ("a/b.c.md", ".env", "x")] == ["b.c", ".env", "x"]


def test_pages(spark):
    text = '---\ntitle: "A: b"\nconcepts: [X, "Y z"]\nconfidence: 0.5\nconfidence: 0.6\n---\n# T\nbody'
    fm = col(spark, pages.frontmatter, text)
    assert fm["title"] == "A: b" and fm["confidence"] == "0.6"
    assert col(spark, lambda x: pages.items_of(pages.frontmatter(x)["concepts"]), text) == ["X", "Y z"]
    assert col(spark, pages.frontmatter, "---\nopen: 1") == {} and col(spark, pages.frontmatter, None) is None
    assert col(spark, pages.title_of, text) == "T" and col(spark, pages.fold_accents, "Éa") == "Ea" and col(spark, pages.fold_accents, None) is None
    assert col(spark, lambda x: ingest.cache_key(x, F.lit("p")), text) == col(spark, lambda x: ingest.cache_key(x, F.lit("p")), text.replace("0.5", "0.9"))


def test_ingest_order_within_a_batch(spark, rows):
    known = spark.createDataFrame([("h1", "a.md", ["p"]), ("h2", "b.md", []), (None, None, None)], "sha256 string, original_filename string, generated_pages array<string>")
    files = spark.createDataFrame([(1, "h1", "a.md", 99), (2, "h3", "b.md", 99), (3, "h4", "c.md", 9), (4, "h5", "d.md", 99), (5, "h5", "d.md", 99), (6, "h6", "d.md", 99), (7, None, "e.md", 99)], "upload_id long, sha256 string, original_filename string, chars long")
    got = {r["upload_id"]: (r["status"], r["replaces"]) for r in ingest.ingest(files, known).collect()}
    assert got == {1: ("skipped", None), 2: ("updated", "h2"), 3: ("failed", None), 4: ("new", None), 5: ("skipped", None), 6: ("updated", "h5"), 7: ("failed", None)}
    assert rows(ingest.ingest(files.limit(0), known)) == []


def test_conflicts_are_those_of_all_pairs(spark, rows):
    known = spark.createDataFrame([("Alpha report.md",), ("beta.md",), (None,), ("年报2020.pdf",)], "original_filename string")
    inbox = spark.createDataFrame([("in/alpha.txt",), ("b.md",), ("年报.md",), ("zzz.md",), (None,)], "path string")
    assert rows(ingest.conflicts(inbox, known)) == [("b.md", "beta.md"), ("in/alpha.txt", "Alpha report.md"), ("年报.md", "年报2020.pdf")]


def test_cache_and_changes(spark, rows):
    files = spark.createDataFrame([("a", 1), ("b", 2)], "cache_key string, x int")
    hit, miss = ingest.split_cached(files, spark.createDataFrame([("a",), ("a",)], "cache_key string"))
    assert rows(hit) == [("a", 1)] and rows(miss) == [("b", 2)]
    now = spark.createDataFrame([("a", 1), ("b", 5), ("c", 1)], "path string, modified int")
    old = spark.createDataFrame([("a", 1), ("b", 4), ("d", 1)], "path string, modified int")
    assert rows(ingest.changes(now, old)) == [("a", "unchanged"), ("b", "new"), ("c", "new"), ("d", "deleted")]


def test_concept_index(spark, rows):
    part = spark.createDataFrame(
        [(1, "A", "p1", ["x", None, " "], "s1", 1), (2, "A", "p2", None, " ", None), (2, "A", "p2", None, " ", None), (3, None, "p", [], "s", 1), (4, "B", None, [], "B (aka: q, A)", 2)],
        "seq long, name string, path string, aliases array<string>, summary string, article_count long")
    index = concepts.reduce_index(part)
    assert rows(index) == [("A", "p2", ["x"], "s1", 1), ("B", None, [], "B (aka: q, A)", 2)]
    assert rows(concepts.canonical_map(index)) == [("a", "A"), ("b", "B"), ("q", "B"), ("x", "A")]
    terms = spark.createDataFrame([(1, "xyz"), (1, "q"), (2, None), (3, "a")], "doc_id long, term string")
    assert rows(concepts.match_terms(terms, index)) == [(1, "A", 1), (3, "A", 1)]


def small(spark):
    nodes = spark.createDataFrame([("a", "Alpha", "concept", "concepts/Alpha.md", {}), ("a", None, None, None, None), ("b", None, "document", "Beta.md", {}), ("c", "Alpha two", "concept", "concepts/Alpha.md", {}), ("d", "Dé", None, "", {}), ("", "no", None, None, {})], "id string, label string, file_type string, source_file string, attrs map<string,string>")
    edges = spark.createDataFrame([("a", "b", "uses", "EXTRACTED", 1.0, 1), ("a", "b", "references", "AMBIGUOUS", 0.2, 2), ("c", "a", "uses", "INFERRED", 0.5, 3), ("a", "x", "uses", None, None, 4), (None, "b", "uses", None, None, 5), ("b", "d", "semantically_similar_to", "INFERRED", 0.9, 6)], "source string, target string, relation string, confidence string, confidence_score double, seq long")
    return nodes, edges


def test_graph(spark, rows):
    nodes, edges = small(spark)
    n, e = graph.build(nodes, edges)
    assert [r[0:2] for r in rows(n)] == [("a", "Alpha"), ("b", None), ("c", "Alpha two"), ("d", "Dé")]
    assert [r[:3] for r in rows(e)] == [("a", "b", "references"), ("b", "d", "semantically_similar_to"), ("c", "a", "uses")]
    kept, moved = graph.consolidate(nodes)
    assert rows(moved) == [("c", "a")] and {(r["id"], r["label"]) for r in kept.collect()} == {("a", "Alpha"), ("b", "Beta"), ("d", "Dé")}
    assert [r[:2] for r in rows(graph.redirect_edges(edges, moved).select("source", "target"))] == [("a", "b"), ("a", "b"), ("a", "x"), ("b", "d")]
    hyper = spark.createDataFrame([("h", ["c", "a", "b"]), ("i", ["a", "c"])], "id string, members array<string>")
    assert rows(graph.redirect_members(hyper, moved)) == [("h", ["a", "b"], 2)]
    assert {r[0] for r in rows(graph.issues(nodes, edges))} >= {"node id missing", "node id repeated", "edge end missing", "edge end unknown", "edge score missing"}
    left = graph.without(n, e, spark.createDataFrame([("a",)], "id string"))
    assert rows(left[1].select("source")) == [("b",)]
    assert rows(graph.merge_nodes(nodes.limit(0))) == [] and rows(graph.build_edges(edges.limit(0), n)) == []


def test_analytics(spark, rows):
    n, e = graph.build(*small(spark))
    assert rows(analytics.degrees(n, e)) == [("a", 2), ("b", 2), ("c", 1), ("d", 1)]
    m = louvain.clusters(n, e)
    assert {r["id"] for r in m.collect()} == set("abcd")
    assert analytics.cohesion(m, e).count() == m.select("community").distinct().count()
    path = spark.createDataFrame([(f"v{k}", f"v{k + 1}") for k in range(4)], "source string, target string")
    verts = spark.createDataFrame([(f"v{k}",) for k in range(5)], "id string")
    assert rows(analytics.betweenness(verts, path, sources=5)) == [("v0", 0.0), ("v1", 6.0), ("v2", 8.0), ("v3", 6.0), ("v4", 0.0)]
    for f in (analytics.surprising, analytics.cross_file, analytics.gaps, analytics.questions, analytics.name_communities, analytics.bridges):
        f(n, e, m).collect()
        f(n.limit(0), e.limit(0), m.limit(0)).collect()


def test_retrieval(spark, rows):
    n, e = graph.build(*small(spark))
    assert retrieval.parse_filters(["--filter", "a=x, y", "--filter=a=z", "--filter", "bad"]) == {"a": ["x", "y", "z"]}
    assert [tuple(r)[::2] for r in retrieval.score_nodes(n, retrieval.query_terms("dé alpha x")).collect()] == [("a", 1.0), ("c", 1.0), ("d", 1.0)]
    starts = spark.createDataFrame([("c",)], "id string")
    visited, steps = retrieval.bfs(e, starts, 2)
    assert rows(visited) == [("a", 1), ("b", 2), ("c", 0)] and rows(steps) == [("a", "b", 2), ("c", "a", 1)]
    assert [r["id"] for r in retrieval.dfs(e, ["c"], 2).orderBy("ord").collect()] == ["c", "a", "b"]
    assert [r["id"] for r in retrieval.shortest_path(e, "c", "d").orderBy("step").collect()] == ["c", "a", "b", "d"]
    assert rows(retrieval.shortest_path(e, "c", "zz")) == []
    assert retrieval.render(n, e, visited, 20).agg(F.sum(F.length("line") + 1)).first()[0] <= 40
    found = retrieval.ask(n, e, "Alpha?", {"region": ["none"]})
    assert found["pages"].count() >= 1
    text = spark.createDataFrame([("articles/x.md", 'tldr: "short"\n')], "source_file string, text string")
    assert rows(retrieval.tldrs(n, e, visited, text)) == []


def test_compiling(spark, rows):
    docs = spark.createDataFrame([(1, "---\ntitle: T\nconcepts: [A, B, C]\nconfidence: 0.9\n---\nbody"), (2, "# no front"), (3, None)], "doc_id long, text string")
    pages_ = compiling.articles(docs)
    snap = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    assert rows(compiling.risk(pages_, snap)) == [(1, 0, "auto"), (2, 0, "review")]
    assert "tldr missing" in {r[2] for r in rows(compiling.article_issues(pages_))}
    t = spark.createDataFrame([("t1", "pending", None, None)], "task_id string, status string, started_at timestamp, finished_at timestamp")
    at = F.lit(dt.datetime(2024, 1, 1))
    done = compiling.move(compiling.move(t, "processing", at), "review", at).first()
    assert done["started_at"] and done["finished_at"] is None and done["status"] == "review"
    chunks = compiling.prepare(spark.range(45).select(F.format_string("t%03d", "id").alias("task_id"))).groupBy("chunk").count()
    assert rows(chunks) == [(1, 20), (2, 20), (3, 5)]


def test_exports(spark):
    n, e = graph.build(*small(spark))
    m = analytics.number(n.select("id", F.lit("x").alias("label")))
    assert exports.graphml(n, e, m).count() == 7 and exports.node_links(n, e, m).count() == 7 and exports.notes(n, e, m).count() == 4
    assert "<canvas" in exports.html(n, e, m)
    with pytest.raises(ValueError):
        exports.html(n, e, m, most=1)
    assert exports.canvas(m).count() == m.select("community").distinct().count()
    assert col(spark, exports.note_name, "a/b?.md") == "ab" and col(spark, exports.note_name, "") == "unnamed"
    assert col(spark, exports.relation_name, "is a-b") == "IS_A_B" and col(spark, exports.type_name, "!") == "Entity"


def office(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_convert(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = office({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = office({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S1"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {s}><si><t>hey</t></si></sst>",
                    "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'})
    files = [("x/a.docx", doc), ("b.xlsx", sheet), ("c.html", b"<h1>T</h1><p>a  b</p><table><tr><th>x</th></tr><tr><td>1</td></tr></table>"), ("d.pdf", b"%PDF stream\nBT (Hi \\(x\\)) Tj ET\nendstream"), ("e.md", b"plain"), ("f.bin", b"?"), ("g.docx", b"broken"), ("h.md", b" "), ("i.md", None)]
    got = {r["path"]: r for r in convert.convert(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert "## Head" in got["x/a.docx"]["markdown"] and got["x/a.docx"]["markdown"].rstrip().endswith("|") is True
    assert "| hey |  | 3 |" in got["b.xlsx"]["markdown"] and "# T" in got["c.html"]["markdown"] and "| --- |" in got["c.html"]["markdown"]
    assert "Hi (x)" in got["d.pdf"]["markdown"] and got["e.md"]["error"] is None
    assert all(got[k]["error"] and got[k]["markdown"] == "" for k in ("f.bin", "g.docx", "h.md", "i.md"))


def test_warehouse(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path / "kb"))
    w.append("events", spark.createDataFrame([("x",)], "kind string"))
    w.append("events", spark.createDataFrame([("y",)], "kind string"))
    assert w.read("events").count() == 2 and "at" in w.read("events").columns
    with pytest.raises(ValueError):
        w.path("../x")
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\nbroken\n')
    good, bad = warehouse.read_json_lines(spark, str(tmp_path / "rows.jsonl"), "a int")
    assert [r[0] for r in good.collect()] == [1] and [r[0] for r in bad.collect()] == ["broken"]
    (tmp_path / "x.json").write_text('{"nodes": [{"id": "a"}], "edges": [{"from": "a", "to": "b", "relation": "uses"}]}')
    assert [tuple(r)[:3] for r in warehouse.read_extraction(spark, str(tmp_path / "x.json"))["edges"].collect()] == [("a", "b", "uses")]
    assert warehouse.tolerant("[1]") == {} and warehouse.tolerant("{") == {} and warehouse.tolerant('{"a": 1}') == {"a": 1}


def test_streams(spark, rows, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    data = [(1, "h1", "a.md", at, 9), (2, "h1", "a.md", at, 9), (3, "h2", "a.md", at + dt.timedelta(minutes=5), 9), (4, None, "b.md", at + dt.timedelta(hours=3), 9), (5, "h3", None, at, 9)]
    spark.createDataFrame(data, jobs.UPLOADS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.uploads(spark, str(tmp_path / "in"))
    jobs.run_once(jobs.classify_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["upload_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "new", 2: "skipped", 3: "updated", 4: "failed", 5: "failed"}
    jobs.merge_into(stream, str(tmp_path / "kb"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kb")).count() == 3
    spark.createDataFrame([(6, "h1", "a.md", at, 9), (7, "h4", "c.md", at, 9)], jobs.UPLOADS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.merge_into(jobs.uploads(spark, str(tmp_path / "in")), str(tmp_path / "kb"), str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r["sha256"] for r in spark.read.parquet(str(tmp_path / "kb")).collect()) == ["h1", "h2", "h3", "h4"]
    table = spark.createDataFrame(data, jobs.UPLOADS)
    assert sorted(r["n"] for r in jobs.windowed(table, "uploaded_at", "original_filename", "1 hour").collect()) == [1, 1, 3]
    assert sorted(r["n"] for r in jobs.sessions(table, "original_filename", "uploaded_at").collect()) == [1, 1, 3]


def test_ends_that_are_no_nodes_are_found_without_shuffling_edges(spark, monkeypatch):
    n = spark.createDataFrame([(f"n{k}",) for k in range(9)], "id string")
    e = [(f"n{k % 9}", f"n{k * 2 % 9}", "uses", k) for k in range(40)] + [("n1", "gone", "uses", 90), ("gone", "n2", "uses", 91), (None, "n2", "uses", 92), ("n1", None, "uses", 93)]
    e = spark.createDataFrame(e * 2, "source string, target string, relation string, seq long")
    want = {(f"n{k % 9}", f"n{k * 2 % 9}"): k for k in range(40)}
    monkeypatch.setattr(session, "BROADCAST_ROWS", 2)  # fewer than nodes, more than ends that are none
    built = graph.build_edges(e, n)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {(r["source"], r["target"]): r["seq"] for r in built.collect()} == want and built.count() == len(want)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    built = graph.build_edges(e, n)
    assert {(r["source"], r["target"]): r["seq"] for r in built.collect()} == want and built.count() == len(want)
    ends = built.select("source", "target")
    assert session.skew_lookup(ends, n.withColumnRenamed("id", "target"), "target", like=e).count() == len(want)


def test_facts_of_both_ends_are_made_once(spark):
    n, e = graph.build(*small(spark))
    m = n.select("id", F.lit(0).alias("community"))
    found = analytics._edge_facts(n, session.cut(e), m)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()  # degrees are not counted again for each end
    assert found.count() == e.count()


def test_full_report_makes_what_its_parts_share_once(spark, rows, monkeypatch):
    n, e = graph.build(*small(spark))
    e, m = session.cut(e), session.cut(n.select("id", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("community")))
    summary, asked, made = rows(exports.summary_lines(n, e, m)), rows(analytics.questions(n, e, m)), []
    for name in ("cohesion", "name_communities", "surprising"):
        for module in (exports, analytics):
            monkeypatch.setattr(module, name, lambda *a, f=getattr(analytics, name), name=name, **k: made.append(name) or f(*a, **k))
    lines = exports.full_lines(n, e, m)
    assert rows(lines.where("ord <= 7")) == summary and lines.where("ord = 13").count() == len([x for x in asked if x[2]])
    assert sorted(made) == ["cohesion", "name_communities", "surprising"]
