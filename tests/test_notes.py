"""Notes hold every target of a node."""

from pyspark.sql import functions as F

from scriptorium.operators import exports


def test_a_hub_keeps_all_its_links(spark):
    ids = ["hub", *(f"t{k:03}" for k in range(130))]
    n = spark.createDataFrame([(i, i, "concept") for i in ids], "id string, label string, file_type string")
    e = spark.createDataFrame([("hub", i, "EXTRACTED") for i in ids[1:]], "source string, target string, confidence string")
    m = n.select("id", F.lit(0).alias("community"))
    for got in (exports.notes(n, e, m), exports.notes(n, e, m, links=50)):
        hub = [r["body"] for r in got.where("file = 'hub.md'").orderBy("part").collect()]
        assert [x for b in hub for x in b.split("\n") if x.startswith("- ")] == [f"- [[{i}]]" for i in ids[1:]]
        assert got.where("body like '# %'").count() == len(ids)
