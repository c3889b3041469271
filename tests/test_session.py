import random

import pytest
from pyspark.sql import functions as F

from scriptorium import session


def test_lag_over_ranges_is_the_window(spark):
    rng = random.Random(8)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), k, rng.choice(["x", "y", None])) for k in range(500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, k int, v string").repartition(6)
    want = {}
    last = {}
    for g, k, v in sorted(data, key=lambda r: r[1]):
        want[k] = last.get(g)
        last[g] = v
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["k"]: r["before"] for r in session.skew_lag(df, "v", "g", ["k"], "before").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    # a null value handed on and no row before are both null
    assert got == want
    assert session.skew_lag(df.limit(0), "v", "g", ["k"], "before").collect() == []


@pytest.mark.parametrize("rows", [200_000, 3])
def test_lookup_with_hot_keys(spark, monkeypatch, rows):
    monkeypatch.setattr(session, "BROADCAST_ROWS", rows)
    left = spark.createDataFrame([("hot", k) for k in range(300)] + [(f"k{k}", k) for k in range(30)] + [(None, 1)], "key string, n int")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{k}", k) for k in range(20)], "key string, v int")
    for how in ("inner", "left"):
        got = sorted((tuple(r) for r in session.skew_lookup(left, right, "key", how).collect()), key=str)
        assert got == sorted((tuple(r) for r in left.join(right, "key", how).collect()), key=str)


def test_texts_count_for_size(spark, monkeypatch):
    df = spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("t"), F.array("id").alias("a"))
    assert session.is_small(df)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 2000)
    assert not session.is_small(df)
