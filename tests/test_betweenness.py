"""Betweenness of small graphs, against the count of all shortest paths."""

import random

import numpy as np

from scriptorium.operators import analytics, packed


def brute(ids, pairs):
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in ids}
    score = dict.fromkeys(ids, 0.0)
    for s in ids:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for x in sorted(near[v]):
                if x not in dist:
                    dist[x], paths[x] = dist[v] + 1, 0
                    order.append(x)
                if dist[x] == dist[v] + 1:
                    paths[x] += paths[v]
        d = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            for v in near[x]:
                if dist.get(v) == dist[x] - 1:
                    d[v] += paths[v] / paths[x] * (1 + d[x])
            if x != s:
                score[x] += d[x]
    return score


def test_long_chain_and_every_source(spark):
    rng = random.Random(3)
    ids = [f"n{k:02}" for k in range(40)]
    pairs = [(ids[k], ids[k + 1]) for k in range(11)] + [tuple(rng.sample(ids[12:], 2)) for _ in range(50)]
    n, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "source string, target string")
    want = brute(ids, pairs)
    got = {r["id"]: r["score"] for r in analytics.betweenness(n, e).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in ids)


def test_packed_graph_and_joins_agree(spark, monkeypatch):
    """A packed graph in several pieces, with copies, a loop, a double link and an isolate, gives what joins give."""
    rng = random.Random(4)
    ids = [f"n{k:02}" for k in range(60)]
    pairs = [tuple(rng.sample(ids[:59], 2)) for _ in range(90)] + [("n03", "n03"), ("n01", "n02"), ("n02", "n01")]
    n, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "source string, target string")
    monkeypatch.setattr(analytics, "PIECE", 7)
    for sources, exact in ((100, 1000), (5, 10)):
        a, b = ({r["id"]: r["score"] for r in analytics.betweenness(n, e, sources, exact, task_links=k).collect()} for k in (0, 1000))
        assert a.keys() == b.keys() == set(ids) and all(abs(a[i] - b[i]) < 1e-5 for i in ids)
    none = analytics.betweenness(n, e.limit(0))
    assert {(r["id"], r["score"]) for r in none.collect()} == {(i, 0.0) for i in ids}


def test_packed_walk_against_brute_force():
    rng = random.Random(6)
    ids = list(range(30))
    pairs = [tuple(rng.sample(ids, 2)) for _ in range(45)]
    a, b = packed.paired(*(np.array(x) for x in zip(*pairs)), 30)
    start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=30))])
    want = brute(ids, pairs)
    assert all(abs(x - want[i]) < 1e-9 for i, x in enumerate(packed.walked(start, b, ids)))
