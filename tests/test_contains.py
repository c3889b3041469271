"""Which texts hold which strings, against plain search."""

import pytest

from scriptorium.operators import contains

TEXTS = [("a", "the meal ordering plan"), ("b", "eal ordering"), ("c", "薪酬复核 plan"), ("d", ""), ("e", None), ("f", "the meal ordering plan"), ("g", "aaaa")]
NEEDLES = ["meal", "eal ordering", "a", "aa", "plan", "薪酬", "酬复核 p", "nothing", "", None, "meal", "the meal ordering plan", "x" * 50]


@pytest.mark.parametrize("most, shard", [(1 << 20, 1 << 20), (1 << 20, 6), (1 << 20, 1), (0, 1)])
def test_held_is_plain_search(spark, rows, most, shard):
    texts = spark.createDataFrame(TEXTS, "path string, hay string")
    needles = spark.createDataFrame([(x,) for x in NEEDLES], "needle string")
    want = sorted({(p, x) for p, t in TEXTS if t for x in NEEDLES if x and x in t}, key=str)
    assert rows(contains.held(texts, needles, most, shard)) == want


def test_held_without_needles(spark, rows):
    texts = spark.createDataFrame(TEXTS, "path string, hay string")
    assert rows(contains.held(texts, spark.createDataFrame([("",)], "needle string"))) == []


def test_texts_are_not_shuffled(spark):
    texts = spark.createDataFrame(TEXTS, "path string, hay string")
    plan = contains.held(texts, spark.createDataFrame([("plan",)], "needle string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
