import datetime as dt

from scriptorium.llm.survivors import decayed, graded, long_votes, survivors, voted

T = dt.datetime(2024, 1, 1)


def data(spark):
    groups = spark.createDataFrame(
        [(1, "x", "A.md", ["concepts\\B.MD", "gone.md", None, "vault/wiki/concepts/c%20d.md", " a "]), (2, None, "(missing)", None), (3, "y", "E.md", []), (None, "z", "A.md", [])],
        "group_id long, canonical_name string, canonical_file string, duplicate_files array<string>")
    pages = spark.createDataFrame(
        [(1, "concepts/A.md", "n/a", "other", "parks", " Legacy ", T), (2, "concepts/B.md", "weak", "TBD", None, "importer", None),
         (2, "concepts/B.md", "weak", "TBD", None, "importer", None), (3, "concepts/C d.md", "weak", "role", "​", "importer", T),
         (4, "concepts/E.md", "", "—", "待补充", "reviewer", T), (5, None, "s", "s", "s", None, None)],
        "page_id long, path string, summary string, concept_kind string, subject_area string, compiled_by string, compiled_at timestamp")
    trust = spark.createDataFrame([("reviewer", 1), ("importer", 4), ("legacy", 5)], "compiled_by string, trust_rank int")
    return groups, pages, trust


def test_ranked_order(spark, rows):
    got = rows(voted(graded(long_votes(*data(spark)))).select("group_id", "field_name", "page_id"))
    assert got == [(1, "concept_kind", 3), (1, "subject_area", 1), (1, "summary", 3)]


def test_votes_add_up_and_pivot(spark, rows):
    groups, pages, trust = data(spark)
    won = {(r["group_id"], r["field_name"]): r for r in voted(decayed(long_votes(groups, pages, trust))).collect()}
    assert won[1, "summary"]["norm"] == "weak" and won[1, "summary"]["weight"] > 1 / 4
    assert rows(survivors(voted(decayed(long_votes(groups, pages, trust))))) == [(1, "weak", "role", "parks")]


def test_ties_take_the_smaller_page_and_empty_tables(spark, rows):
    groups, pages, trust = data(spark)
    same = pages.where("page_id in (1, 3)").withColumn("compiled_by", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("nobody"))
    got = dict(((r[1]), r[2]) for r in rows(voted(graded(long_votes(groups, same, trust))).select("group_id", "field_name", "page_id")))
    assert got["concept_kind"] == 1
    assert rows(voted(graded(long_votes(groups.limit(0), pages, trust)))) == []
    assert rows(voted(graded(long_votes(groups, pages.limit(0), trust)))) == []


def test_many_weak_votes_do_not_outvote_a_trusted_one(spark, rows):
    """Over 200 votes, as many as underflow would hit, the best page wins; by decay the many do."""
    votes = [(1, k, 1 if k == 250 else 4, T + dt.timedelta(days=k % 7), "summary", "A" if k == 250 else "b", "a" if k == 250 else "b") for k in range(251)]
    df = spark.createDataFrame([(*v, "c") for v in votes], "group_id long, page_id long, trust_rank int, compiled_at timestamp, field_name string, value string, norm string, weight2 string")
    assert rows(voted(graded(df)).select("page_id", "value")) == [(250, "A")]
    assert rows(voted(decayed(df)).select("page_id", "value")) == [(6, "b")]
    again = voted(graded(df.where("trust_rank = 4"))).first()
    assert again["page_id"] == 6 and abs(again["weight"] - 0.5) < 1e-9
