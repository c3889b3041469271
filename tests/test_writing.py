"""The write step, containment joins, names of communities and hyperedges against brute force and small cases."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import paths
from scriptorium.operators import analytics, contains, graph, retrieval, writing

DAY = "2024-01-02"
HEAD = '---\ntitle: "t"\ndoc_type: faq\nsource_sha256: "s"\nconcepts: [a]\ncompiled_by: x\ntldr: y\n---\nbody'


def test_containing_against_brute_force(spark, rows):
    rng = random.Random(4)
    some = ["".join(rng.choice("ab数") for _ in range(rng.randrange(1, 9))) for _ in range(80)] + ["", None, "x" * 4000]
    needles, hay = some[::2] + ["xxx", "zzzz"], some[1::2] + ["x" * 4000]
    got = rows(contains.containing(spark.createDataFrame([(x, "c") for x in needles], "needle string, hay string"), spark.createDataFrame([(x, "c") for x in hay], "hay string, needle string")))
    assert got == sorted({(n, h) for n in needles for h in hay if n and h and n in h}, key=str)
    empty = spark.createDataFrame([], "needle string, hay string")
    assert rows(contains.containing(empty, empty)) == []


def test_write_in_order_of_tasks(spark, rows):
    c = lambda n, s=None: (n, s, None, None, "odd", None)
    given = [("t2", "h2", "Two", HEAD, 0.9, 9, [c("A", "later"), c("B"), c("a/b")]), ("t1", "h1", "One", HEAD, 0.9, 9, [c("A", "first"), c("B"), c("C")]),
             ("t3", "h3", "Thr", HEAD, None, 9, [c("A"), c("C"), c(None), c("D")]), ("t4", "h4", "One", HEAD, 0.5, 9, [c("A"), c("B"), c("C")]), ("t5", "h5", "No", None, 0.9, 9, None), (None, "h6", "x", HEAD, 1.0, 1, [c("A")])]
    given.append(given[0])
    rows_ = spark.createDataFrame([(*g, "z") for g in given], writing.DELIVERIES + ", path string")
    pages = spark.createDataFrame([("concepts/B.md", "# B\n\n## 相关文章\n- [[One]]\n\n"), ("concepts/X.md", "x"), (None, "y")], "path string, text string")
    snapshot = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    out = writing.write(rows_, snapshot, pages, F.lit(DAY).cast("date"))
    assert {t for t, _ in rows(out["issues"])} == {"t5"}
    assert rows(out["tasks"].select("task_id", "status")) == [("t1", "done"), ("t2", "review"), ("t3", "review"), ("t4", "review")]
    assert rows(out["articles"].select("path", "sha256")) == [("articles/One.md", "h4"), ("articles/Thr.md", "h3"), ("articles/Two.md", "h2")]
    text = {r["path"]: r for r in out["concepts"].collect()}
    assert set(text) == {f"concepts/{x}.md" for x in ("A", "B", "C", "D", "ab")} and not text["concepts/B.md"]["created"]
    assert text["concepts/B.md"]["text"] == "# B\n\n## 相关文章\n- [[One]]\n- [[Two]]\n"
    assert text["concepts/A.md"]["text"].endswith("# A\n\nfirst\n\n## 相关文章\n- [[One]]\n- [[Two]]\n- [[Thr]]\n") and 'concept_kind: "other"' in text["concepts/A.md"]["text"]
    assert [r["seq"] for r in out["partials"].orderBy("task_id", "seq").collect()] == list(range(1, 13))
    nothing = writing.write(rows_.limit(0), snapshot, pages, F.lit(DAY).cast("date"))
    assert all(rows(df) == [] for df in nothing.values())


def test_page_with_own_sections(spark):
    c = ("N", "s", ["x"], ["d"], "role", [("概要", " a "), ("相关文章", "- own")])
    row = spark.createDataFrame([(c,)], "c " + writing.DELIVERIES.split("concepts array<")[1][:-1])
    text = row.select(writing.concept_page(F.col("c"), F.lit("T"), F.lit(DAY).cast("date"))).first()[0]
    assert text.count("## 相关文章") == 1 and "[[T]]" not in text and "## 概要\n\na\n" in text and 'aliases: ["x"]' in text


@pytest.mark.parametrize("detail,found", [(True, True), (False, False)])
def test_copied_summary(spark, detail, found):
    block = "word " * 60
    text = f"{HEAD}\n{writing.SUMMARY}\n{block}\n{writing.DETAIL}\n{block if detail else block[::-1]}"
    got = {r["issue"] for r in writing.text_issues(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert ("detail repeats the summary" in got) == found


def test_names_are_told_apart_in_order(spark):
    rng = random.Random(3)
    nodes = [(f"n{k:02}", rng.choice("AB"), "concept" if k % 3 else "document", None) for k in range(40)] + [("z", None, "concept", None)]
    members = [(n[0], rng.randrange(9)) for n in nodes[:-1]] + [("z", 20)]
    edges = [(rng.choice(nodes)[0], rng.choice(nodes)[0]) for _ in range(60)]
    n, m = spark.createDataFrame(nodes, "id string, label string, file_type string, source_file string"), spark.createDataFrame(members, "id string, community int")
    got = {r["community"]: r["name"] for r in analytics.name_communities(n, spark.createDataFrame(edges, "source string, target string"), m).collect()}
    degree = {x[0]: sum((a == x[0]) + (b == x[0]) for a, b in edges) for x in nodes}
    kind, label, used, want = {x[0]: x[2] for x in nodes}, {x[0]: x[1] for x in nodes}, set(), {}
    for c in sorted({c for _, c in members}):
        ids = [i for i, k in members if k == c and label[i]]
        ids = [i for i in ids if kind[i] == "concept"] or ids
        top = [label[i] for i in sorted(ids, key=lambda i: (-degree[i], i))[:4]]
        tries = [" / ".join(top[: k + 1]) for k in range(len(top)) if " / ".join(top[: k + 1]) not in used]
        want[c] = tries[0] if tries else f"社区{c}"
        used.add(want[c])
    assert got == want


def test_hyperedges(spark, rows):
    h = spark.createDataFrame([("h", ["a", "b", "c"]), ("i", ["a", "b"]), ("j", None)], "id string, members array<string>")
    gone = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.shrunk(h, gone)) == [("h", ["b", "c"], 2)]
    more = spark.createDataFrame([("h", ["z"]), ("k", ["y"]), ("k", ["x"]), (None, ["w"])], "id string, members array<string>")
    assert {r["id"]: r["members"] for r in graph.attach(h, more).collect()} == {"h": ["a", "b", "c"], "i": ["a", "b"], "j": None, "k": ["x"]}
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(graph.hyper_issues(h, nodes)) == [("hyperedge member unknown", "h"), ("hyperedge too small", "j")]
    with pytest.raises(ValueError, match="2 issues"):
        graph.assert_valid(graph.hyper_issues(h, nodes))
    graph.assert_valid(graph.hyper_issues(h.limit(0), nodes))
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), (None, "b")], "source string, target string")
    left, dropped = graph.pruned(nodes, edges)
    assert rows(left) == [("a", "b")] and dropped == 2


def test_addresses(spark):
    bad = ["ftp://a.b", "http://localhost/x", "http://127.1", "http://0x7f000001/", "http://2130706433", "http://017700000001", "http://[::ffff:10.0.0.1]/", "http://100.64.0.1", "http://10.0.0.8:80", "http://[fe80::1]", "", None, "http://a.localhost", "http://[::1]"]
    good = ["http://example.org/a", "https://93.184.216.34/x", "http://[2606:2800::1]/", "https://10x.example.org"]
    df = spark.createDataFrame([(x,) for x in bad + good], "u string").select("u", paths.safe_url(F.col("u")).alias("ok"))
    assert {r["u"] for r in df.collect() if r["ok"]} == set(good)


def test_ignore_patterns_with_their_folder(spark):
    df = spark.createDataFrame([("file:/kb/in/a/b.md",), ("file:/kb/other/a/b.md",), ("file:/kb/in/c.md",)], "path string")
    got = [r[0] for r in df.where(paths.is_ignored("path", [("/kb/in", "a/*"), "# note"])).select("path").collect()]
    assert got == ["file:/kb/in/a/b.md"]


def test_summaries_are_read_again_when_pages_change(spark, rows):
    schema = "path string, modified long, text string"
    cache = retrieval.TldrCache(spark.createDataFrame([("a", 1, 'tldr: "one"'), ("b", 1, "none")], schema))
    assert cache.warm_up() == 2
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert rows(cache.get(asked)) == [("a", "one"), ("b", "(no tldr)"), ("c", "(no tldr)")]
    cache.refresh(spark.createDataFrame([("a", 2, "tldr: two"), ("b", 1, "tldr: not read")], schema))
    assert rows(cache.get(asked)) == [("a", "two"), ("b", "(no tldr)"), ("c", "(no tldr)")]
    cache.reset()
