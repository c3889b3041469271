"""The removal plan: all that a source has left behind."""

from scriptorium.operators import ingest


def test_removal_of_several_hashes(spark, rows):
    s = spark.createDataFrame([("h1", "raw/a", ["articles/x.md", "articles/y[1].md"]), ("h1", "raw/a", ["articles/x.md"]), ("h2", "raw/b", []), ("h3", "raw/c", ["articles/z.md"]), (None, "raw/d", ["articles/x.md"])],
                              "sha256 string, raw_path string, generated_pages array<string>")
    tasks = spark.createDataFrame([("t1", "h1", "review"), ("t2", "h2", "failed"), ("t3", "h3", "done")], "task_id string, sha256 string, status string")
    pages = spark.createDataFrame([("c1", "see [[x]] and [[x]]"), ("c2", "[[y[1]]]"), ("c3", "[[x|again]] [[z]]"), ("c4", None)], "path string, text string")
    gone = spark.createDataFrame([("h1",), ("h2",), ("h2",), ("unknown",), (None,)], "sha256 string")
    assert rows(ingest.removal(s, gone, tasks, pages)) == sorted([
        ("h1", "archive", "raw/a"), ("h1", "article", "articles/x.md"), ("h1", "article", "articles/y[1].md"), ("h1", "mention", "c1"), ("h1", "mention", "c2"),
        ("h1", "task", "review/t1"), ("h2", "archive", "raw/b"), ("h2", "task", "failed/t2")], key=str)
