import random

import pytest

from scriptorium.llm.components import connected_components, matching_edges


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("task_rows", [1_000_000, 20])
def test_against_brute_force(spark, rows, task_rows):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(90)]
    pairs += [("hub", f"n{k}") for k in range(40)] + [(None, "n1"), ("n2", None), ("alone", "alone")]
    pairs += [(f"p{k:03}", f"p{k + 1:03}") for k in range(60)]
    df = spark.createDataFrame(pairs + pairs[:9], "a string, b string").repartition(5)
    assert rows(connected_components(df, task_rows=task_rows)) == brute(pairs)


def test_empty_and_extra_columns(spark, rows):
    empty = spark.createDataFrame([], "a string, b string, node string, root string")
    assert rows(connected_components(empty)) == []
    df = spark.createDataFrame([("b", "a", "x", "y")], "a string, b string, node string, group_id string")
    assert rows(connected_components(df)) == [("a", "a"), ("b", "a")]


def test_matching_edges(spark, rows):
    nan = float("nan")
    edges = spark.createDataFrame(
        [("a", "b", " Semantically-Similar to ", 0.85), ("b", "a", "semantically_similar_to", 1.0), ("a", "c", "semantically_similar_to", 0.84),
         ("a", "d", "semantically_similar_to", nan), ("a", "x", "semantically_similar_to", 0.9), ("a", "a", "semantically_similar_to", 0.9),
         ("b", "c", "uses", 0.9), (None, "a", "semantically_similar_to", 0.9), ("c", "d", "semantically_similar_to", None), ("c", "d", None, 0.9)],
        "source string, target string, relation string, confidence_score double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,), ("a",)], "id string")
    assert rows(matching_edges(edges, nodes)) == [("a", "b")]
