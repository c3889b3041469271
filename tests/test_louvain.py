"""Communities by modularity against brute force on small graphs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.operators import graph, louvain
from scriptorium.plans import catalog


def quality(pairs, of):
    links = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    degree = {i: sum(a == i for a, _ in links) for i in of}
    tot = {c: sum(degree[i] for i in of if of[i] == c) for c in set(of.values())}
    return sum(of[a] == of[b] for a, b in links) / len(links) - sum((t / len(links)) ** 2 for t in tot.values())


def partitions(ids):
    if not ids:
        yield {}
        return
    for rest in partitions(ids[1:]):
        for c in range(max(rest.values(), default=-1) + 2):
            yield rest | {ids[0]: c}


def groups(of):
    return sorted(sorted(i for i in of if of[i] == c) for c in set(of.values()))


def tables(spark, folder, ids, pairs):
    n = spark.createDataFrame([(i, i, "concept", f"concepts/{i}.md", {}) for i in ids], "id string, label string, file_type string, source_file string, attrs map<string,string>")
    e = spark.createDataFrame([(a, b, "uses", "EXTRACTED", 1.0, k) for k, (a, b) in enumerate(pairs)], "source string, target string, relation string, confidence string, confidence_score double, seq long")
    n.write.parquet(f"{folder}/nodes.parquet")
    e.write.parquet(f"{folder}/edges.parquet")
    return str(folder)


PATH = [f"v{k:02}" for k in range(16)], [(f"v{k:02}", f"v{k + 1:02}") for k in range(15)]


def test_best_of_all_partitions(spark):
    ids = list("abcdefghi")
    pairs = [(ids[3 * t + x], ids[3 * t + y]) for t in range(3) for x, y in ((0, 1), (1, 2), (2, 0))] + [("a", "d"), ("d", "g"), ("g", "a"), ("a", "g")]
    best = max(partitions(ids), key=lambda of: quality(pairs, of))
    n, e = spark.createDataFrame([(i,) for i in (*ids, "lone")], "id string"), spark.createDataFrame(pairs, "source string, target string")
    got = {r["id"]: r["community"] for r in louvain.clusters(n, e).collect()}
    assert groups(got) == sorted([*groups(best), ["lone"]]) and got["lone"] == 3


def test_graph_communities_is_settled(spark, tmp_path):
    ids, pairs = PATH
    got = {r["id"]: r["community"] for r in catalog.QUERIES["graph_communities"](spark, tables(spark, tmp_path, ids, pairs)).collect()}
    assert all(quality(pairs, got | {i: c}) <= quality(pairs, got) + 1e-12 for i in ids for c in set(got.values()))


def test_too_large_for_one_task_and_split(spark):
    ids = [f"{c}{k}" for c in "abcde" for k in range(8)]
    pairs = [(x, y) for x in ids for y in ids if x < y and x[0] == y[0]] + [("a0", "b0"), ("b1", "c1"), ("c2", "d2"), ("d3", "e3")]
    n, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "source string, target string")
    want = [[i for i in ids if i[0] == c] for c in "abcde"]
    for links in (0, 10**6):
        found = {r["id"]: r["label"] for r in louvain.partition(n, e, links).collect()}
        assert groups(found) == want
    ids, pairs = [f"h{k:02}" for k in range(30)], [(f"h{a:02}", f"h{b:02}") for a in range(30) for b in range(a)]  # one clique stays whole
    n, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "source string, target string")
    assert len({r["community"] for r in louvain.clusters(n, e).collect()}) == 1
    assert louvain.clusters(n.limit(0), e.limit(0)).count() == 0


def test_queries_show_the_communities_of_the_operator(spark, tmp_path):
    d = tables(spark, tmp_path, *PATH)
    want = {r["id"]: r["community"] for r in catalog.QUERIES["graph_communities"](spark, d).collect()}
    assert {r["id"]: r["community"] for r in catalog._settled(spark, d)[2].collect()} == want
    notes = {r["file"][:-3]: r["body"] for r in catalog.QUERIES["export_notes"](spark, d).collect()}
    assert all(f"community: {c}\n" in notes[i] for i, c in want.items())
    assert catalog.QUERIES["export_canvas"](spark, d).count() == len(set(want.values()))
    assert f"communities: {len(set(want.values()))}" in {r["line"] for r in catalog.QUERIES["report_summary"](spark, d).collect()}


@pytest.mark.parametrize("heaviest", [1, 3])
@pytest.mark.parametrize("sets", [2, 64])
def test_sets_of_nodes_are_settled(heaviest, sets):
    """At the end no more nodes gain by a move than the rule leaves, loops and weights counted."""
    rng, n = random.Random(5), 1500
    pairs = {tuple(sorted((rng.randrange(n), rng.randrange(n) if rng.random() < 0.3 else 0))) for _ in range(900)} | {tuple(sorted(rng.sample(range(k, k + 10), 2))) for k in range(0, n, 10) for _ in range(25)}
    weight = {p: rng.randint(1, heaviest) * (2 if p[0] == p[1] else 1) for p in pairs}
    ends = sorted({(*p, w) for p, w in weight.items()} | {(p[1], p[0], w) for p, w in weight.items()})
    a, b, w = (np.array(x) for x in zip(*ends))
    com, _ = louvain._settle_sets(a, b, w, n, random.Random(42), sets)
    degree, whole = np.bincount(a, w, n), w.sum()
    tot, moves = np.bincount(com, degree, n), 0
    for i in range(n):
        near = {}
        for j, x in zip(b[a == i], w[a == i]):
            near[com[j]] = near.get(com[j], 0) + (x if j != i else 0)
        stay = whole * near.get(com[i], 0) - degree[i] * (tot[com[i]] - degree[i])
        moves += any(whole * x - degree[i] * tot[c] > stay for c, x in near.items() if c != com[i])
    assert moves <= 2 * louvain.REST * n
    one = louvain._settle(a, b, w, n, random.Random(42))[0]
    assert louvain._quality(a, b, w, com) > louvain._quality(a, b, w, one) - 0.02


def test_one_task_codes_strings_by_their_order():
    batches = [pa.RecordBatch.from_pydict({"a": ["é", "b"], "b": ["a", "é"]}), pa.RecordBatch.from_pydict({"a": ["z"], "b": ["a"]})]
    for rows in (1, 10):
        names, a, b, w = louvain.coded(iter(batches), rows)
        assert names.to_pylist() == ["a", "b", "z", "é"] and (a.tolist(), b.tolist(), w) == ([3, 1, 2], [0, 3, 0], None)
    assert [x.tolist() for x in louvain.paired(a, b, 4)] == [[0, 0, 1, 2, 3, 3], [2, 3, 3, 0, 0, 1]]


def test_sets_and_single_moves_on_cliques(spark, monkeypatch):
    ids = [f"{c}{k}" for c in "abcde" for k in range(8)]
    pairs = [(x, y) for x in ids for y in ids if x < y and x[0] == y[0]] + [("a0", "b0"), ("b1", "c1")]
    code = {i: k for k, i in enumerate(ids)}
    a, b = louvain.paired(np.array([code[x] for x, _ in pairs]), np.array([code[y] for _, y in pairs]), len(ids))
    monkeypatch.setattr(louvain, "LOOP_LINKS", 0)
    com, _ = louvain.louvain(a, b, np.ones(len(a), np.int32), len(ids))
    assert groups({i: com[code[i]] for i in ids}) == [[i for i in ids if i[0] == c] for c in "abcde"]


def test_levels_by_sets_set_out_from_an_outline(monkeypatch):
    """A graph linked throughout, with a hub: few visits of nodes, and communities as good as those of single moves."""
    rng, n, seen = np.random.default_rng(3), 12_000, []
    a, b = rng.integers(0, n, 7 * n), (n * rng.random(7 * n) ** 2.2).astype(np.int64)
    a, b = louvain.paired(a, np.where(rng.random(7 * n) < 0.1, 0, rng.permutation(n)[b]), n)
    w = np.where(a == b, 2, 1).astype(np.int32)
    one, _ = louvain.louvain(a, b, w, n)
    links_of = louvain.links_of
    monkeypatch.setattr(louvain, "links_of", lambda start, v: seen.append(len(v)) or links_of(start, v))
    monkeypatch.setattr(louvain, "LOOP_LINKS", 0)
    com, _ = louvain.louvain(a, b, w, n)
    assert sum(seen) < 20 * n and louvain._quality(a, b, w, com) > louvain._quality(a, b, w, one)


def test_edges_of_no_other_column_are_the_same_pairs(spark, tmp_path):
    pairs = [("v00", "v01"), ("v00", "v01"), ("v01", "v00"), ("v02", "v02"), ("v03", "gone"), (None, "v01"), ("v04", "v05")]
    d = tables(spark, tmp_path, [f"v{k:02}" for k in range(7)], pairs)
    n, e = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nodes", "edges"))
    ends = [sorted(map(tuple, graph.build(n, x)[1].select("source", "target").collect())) for x in (e, e.select("source", "target"))]
    assert ends[0] == ends[1] == [("v00", "v01"), ("v01", "v00"), ("v02", "v02"), ("v04", "v05")]
    sizes = {r["community"]: r["cards"] for r in catalog.QUERIES["export_canvas_cards"](spark, d).collect()}
    want = [r["community"] for r in catalog.QUERIES["graph_communities"](spark, d).collect()]
    assert sizes == {c: want.count(c) for c in want}
