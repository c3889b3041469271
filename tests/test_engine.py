import pytest
from pyspark.sql import functions as F

from scriptorium.__main__ import main
from scriptorium.engine import Engine
from scriptorium.operators import backfill, exports, ingest, logs, writing

TEXT = "# Title\n\n" + "word " * 30


FRONT = '---\ntitle: "{t}"\ndoc_type: solution\nsource_sha256: "{s}"\nconcepts: ["Alpha", "Beta", "Gamma"]\naliases: []\ncompiled_by: "x"\ntldr: "what this is about, told in a line"\n---\n\n# {t}\n\n'


def delivery(task, sha, title, names, confidence=0.9, text=None):
    return (task, sha, title, FRONT.format(t=title, s=sha) + "word " * 120 if text is None else text, confidence, 600, [(n, f"about {n}", ["al"] if n == "Alpha" else [], [], "method", None) for n in names])


def test_pipeline(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.md").write_text(TEXT + "AB CD AB CD Some Thing Some Thing")
    (inbox / "b.txt").write_text("short")
    (inbox / "my_secret.md").write_text(TEXT)
    e = Engine(spark, str(tmp_path / "kb"))
    assert "sources" in e.init() and e.init() == []
    assert sorted(r["status"] for r in e.ingest(str(inbox)).collect()) == ["failed", "new"]
    first = e.store.read("sources").first()["sha256"]
    assert e.tasks("pending").count() == 1 and e.store.read("structure").count() == 1
    (inbox / "a.md").write_text(TEXT + "more AB CD AB CD Some Thing Some Thing")
    assert sorted(r["status"] for r in e.ingest(str(inbox)).collect()) == ["failed", "updated"]
    assert e.store.read("sources").count() == 1 and e.store.read("trash").first()["sha256"] == first
    assert e.tasks("pending").count() == 1 and {r["event"] for r in e.store.read("events").collect()} == {"ingested"}
    prepared = e.prepare().collect()
    assert len(prepared) == 1 and e.tasks("pending").count() == 0 and prepared[0]["started_at"] is not None
    task, sha = prepared[0]["task_id"], prepared[0]["sha256"]
    assert [r["check"] for r in e.verify_ingest().collect()] == []
    assert "task not ended" in {r["check"] for r in e.verify_compile().collect()}
    # the write step: one delivery passes, one does not; the same again changes nothing
    schema = writing.DELIVERIES
    deliveries = spark.createDataFrame([delivery(task, sha, "Doc: one", ["Alpha", "Beta", "Gamma"]), delivery("other", "ff", "Bad", ["Alpha"], text="no head")], schema)
    for _ in range(2):
        issues = {(r["task_id"], r["issue"]) for r in e.write(deliveries).collect()}
        assert ("other", "fewer than three concepts") in issues and ("other", "title missing") in issues and {t for t, _ in issues} == {"other"}
        assert e.store.read("articles").count() == 1 and e.store.read("concepts").count() == 3 and e.dirty()
    assert e.tasks("review").count() == 1 and e.store.read("sources").first()["generated_pages"] == ["articles/Doc one.md"]
    page = e.store.read("concepts").where("path = 'concepts/Alpha.md'").first()["text"]
    assert page.count("[[Doc: one]]") == 1 and 'concept_kind: "method"' in page and page.count("\n", 0, page.index("\n---\n", 4) + 1) == 10
    index = e.reduce()
    assert {(r["name"], r["article_count"]) for r in index.collect()} == {("Alpha", 1), ("Beta", 1), ("Gamma", 1)} and not e.dirty()
    assert e.reduce().collect() == index.collect()
    partials = spark.createDataFrame([(1, "Alpha", "concepts/Alpha.md", ["al2"], "s", 1)], "seq long, name string, path string, aliases array<string>, summary string, article_count long")
    index = e.reduce(partials)  # the base stays
    assert {(r["name"], r["article_count"], tuple(r["aliases"])) for r in index.collect()} == {("Alpha", 2, ("al", "al2")), ("Beta", 1, ()), ("Gamma", 1, ())}
    nodes = spark.createDataFrame([("a", "Alpha", "concept", "concepts/Alpha.md", None), ("b", "al", "concept", "concepts/al.md", None), ("d", "Doc", "document", "articles/Doc.md", None), ("o", "Lone", "concept", None, None), ("w", "word", "concept", None, None)], "id string, label string, file_type string, source_file string, attrs map<string,string>")
    edges = spark.createDataFrame([("d", "b", "uses", "EXTRACTED", 1.0, 1), ("d", "a", "references", "INFERRED", 0.5, 2), ("d", "gone", "uses", "EXTRACTED", 1.0, 3)], "source string, target string, relation string, confidence string, confidence_score double, seq long")
    hyper = spark.createDataFrame([("h1", ["a", "b", "d"]), ("h2", ["d", "zz"]), ("h2", ["a"])], "id string, members array<string>")
    made = e.build_graph(nodes, edges, index, hyper)
    assert {r["id"] for r in made["nodes"].collect()} == {"a", "d", "o", "w"} and made["edges"].count() == 1
    assert {r["id"]: r["members"] for r in made["hyperedges"].collect()}["h1"] == ["a", "d"]
    stats = {r["stat"]: r["n"] for r in made["stats"].collect()}
    assert stats["edges_pruned"] == 1 and stats["alias_redirects"] == 1 and stats["issues_left"] > 0
    assert made["report"].count() > 5 and made["report_full"].count() > made["report"].count() and e.verify_graph().count() == 0
    assert e.store.read("runs").first()["status"] == "partial"
    found = e.query("alpha")
    assert found["pages"].count() == 2
    assert "query_hash" in e.save_answer("why?", "so", ["a"]).first()["text"]
    assert {r["part"]: r["n"] for r in e.status().collect()}["query_log"] == 1
    stems = spark.createDataFrame([("Alpha",)], "stem string")
    assert {(r["id"], r["pages"]) for r in e.audit(stems, remove=True).collect()} == {("o", 0), ("w", 1)}
    assert e.store.read("nodes").count() == 3 and e.store.read("nodes_before").count() == 4
    changed = e.merge_duplicates(spark.createDataFrame([("Alpha", "Beta"), ("Alpha", "Unknown")], "canonical_name string, duplicate string"))
    assert "## Beta" in changed.first()["text"] and {r["name"] for r in e.store.read("concepts_index").collect()} == {"Alpha", "Gamma"}
    assert "Beta" in e.store.read("concepts_index").where("name = 'Alpha'").first()["aliases"]


def test_commands(spark, tmp_path, capsys):
    kb = str(tmp_path / "kb")
    assert main(["version"]) == 0 and main(["ingest", "--kb", kb]) == 2 and main(["status"]) == 2 and main(["init", "--kb", kb]) == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(TEXT)
    (tmp_path / "in" / "skip.md").write_text(TEXT + "x")
    (tmp_path / "in" / ".ignore").write_text("skip.*\n")
    assert main(["ingest", "--kb", kb, "--inbox", str(tmp_path / "in")]) == 0 and "new=1" in capsys.readouterr().out
    assert main(["ingest-verify", "--kb", kb]) == 0 and main(["prepare", "--kb", kb]) == 0 and main(["compile-verify", "--kb", kb]) == 1
    task = Engine(spark, kb).tasks("processing").first()
    row = spark.createDataFrame([delivery(task["task_id"], task["sha256"], "T", ["A", "B", "C"])], writing.DELIVERIES)
    row.write.json(str(tmp_path / "out"))
    assert main(["compile-write", "--kb", kb, "--deliveries", str(tmp_path / "out")]) == 0 and main(["compile-reduce", "--kb", kb]) == 0
    (tmp_path / "x.json").write_text('{"nodes": [{"id": "a", "label": "A", "file_type": "concept", "source_file": "concepts/A.md", "attrs": {"region": "West"}}, {"id": "d", "label": "D", "file_type": "document", "source_file": "articles/D.md"}], "edges": [{"from": "d", "to": "a", "relation": "uses", "confidence": "EXTRACTED", "confidence_score": 1.0}], "hyperedges": []}')
    assert main(["graph", "--kb", kb, "--extraction", str(tmp_path / "x.json")]) == 0 and main(["graph-verify", "--kb", kb]) == 0
    assert main(["query", "--kb", kb, "--question", "what is d?", "--filter", "region=west"]) == 0 and main(["status", "--kb", kb]) == 0


def test_removal_and_mentions(spark, rows):
    s = spark.createDataFrame([("h1", "a", ["articles/x.md"]), ("h2", "b", []), (None, "c", None)], "sha256 string, original_filename string, generated_pages array<string>")
    left, trash = ingest.remove(s, s.where("sha256 = 'h1'"), F.current_timestamp())
    assert rows(left.select("original_filename")) == [("b",), ("c",)] and trash.count() == 1
    pages = spark.createDataFrame([("articles/x.md", "X")], "path string, title string")
    texts = spark.createDataFrame([("p", "see [[X]] and [[X|again]]"), ("q", None)], "path string, text string")
    assert rows(ingest.mentions(texts, pages)) == [("p", "X")]


@pytest.mark.parametrize("text,n", [("## Related articles\n\n- a\n* b\n\n## Next\n- c", 2), ("none", 0), ("", 0)])
def test_related_count(spark, text, n):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(backfill.related_count("text")).first()[0] == n


def test_append_and_run_report(spark):
    df = spark.createDataFrame([("# A",), ("# A\n- [[T]]",)], "b string")
    assert [r[0] for r in df.select(exports.append_article("b", F.lit("T"))).collect()] == ["# A\n- [[T]]", "# A\n- [[T]]"]
    text = logs.run_report({"command": "graph", "stats": {"nodes": 3}, "files": list(range(12)), "warnings": ["w"] * 30})
    assert "- nodes: 3" in text and "and 2 more" in text and text.count("- w") == 20
