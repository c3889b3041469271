"""Problem 1: consolidating pairwise matches into groups.

Union-find runs inside each partition of the pair list and keeps only a spanning
forest, written as stars (node, root). Forests are merged by repartitioning them over
fewer, bounded partitions and running union-find again. When a forest is too large for
one task it is contracted first: every node draws a coin from its hash, each "tail"
with a "head" neighbour melts into the smallest such head, and the pairs are rewritten.
A round melts a fixed share of the nodes on average, so the number of rounds is
logarithmic and the work geometric; no task ever gets more than ``task_rows`` pairs on
average and a hub node has at most one pair a partition after the first pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut, skew_lookup

#: Pairs of a forest one task may merge; some 200 MB of Python memory.
TASK_ROWS = 1_000_000


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spanning stars of the pairs a, b: every node but the roots, and its root, the
    smallest node of its tree."""
    both = np.concatenate([a, b])
    names, codes = np.unique(both, return_inverse=True)
    parent = list(range(len(names)))
    left, right = codes[: len(a)].tolist(), codes[len(a):].tolist()
    for x, y in zip(left, right):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    # a parent is never larger than its child, so one ascending pass flattens the trees
    for k in range(len(parent)):
        parent[k] = parent[parent[k]]
    roots = np.asarray(parent, dtype=np.int64)
    own = np.flatnonzero(roots != np.arange(len(roots)))
    return names[own], names[roots[own]]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += len(batch)
        if rows > 200_000 and len(kept) > 1:  # only a spanning forest stays in memory
            kept = [_stars(kept)]
            rows = max(0, len(kept[0]) - 100_000)
    if kept:
        out = _stars(kept)
        for at in range(0, len(out), 50_000):
            yield out.iloc[at : at + 50_000]


def _stars(parts: list[pd.DataFrame]) -> pd.DataFrame:
    pairs = pd.concat(parts, ignore_index=True)
    a, b = _union(pairs["node"].to_numpy(object), pairs["root"].to_numpy(object))
    return pd.DataFrame({"node": a, "root": b})


def _merge(pairs: DataFrame) -> DataFrame:
    return pairs.mapInPandas(_forest, "node string, root string")


def connected_components(
    pairs: DataFrame, a: str = "a", b: str = "b", task_rows: int = TASK_ROWS, max_rounds: int = 200
) -> DataFrame:
    """``(node string, group_id string)`` for every node of a pair; ``group_id`` is the
    smallest node, in plain string order, among all nodes linked to it.

    Pairs with a null end are ignored, a pair of a node with itself makes a group of
    one, repeated and reversed pairs count once. No pairs: no rows. Other columns of
    ``pairs`` are ignored, whatever their names.
    """
    links = pairs.select(F.col(a).cast("string").alias("node"), F.col(b).cast("string").alias("root"))
    links = links.where("node is not null and root is not null")
    loners = links.where("node = root").select("node")
    forest = cut(_merge(links.where("node <> root")))
    melted: list[DataFrame] = []
    before = None
    for turn in range(max_rounds):
        rows = forest.count()
        if rows <= task_rows:
            break
        tasks = -(-rows // task_rows)
        if before is None or rows < before:  # merge forests over bounded partitions
            forest = cut(_merge(forest.repartition(tasks, "node")))
        before = rows
        if forest.count() <= task_rows:
            break
        melt = cut(_melt(forest, turn))
        melted.append(melt)
        forest = cut(_rewrite(forest, melt))
    else:
        raise RuntimeError("the pairs did not shrink")
    top = cut(_merge(forest.repartition(1)))
    labels = top.unionByName(top.select(F.col("root").alias("node"), "root").distinct())
    for melt in reversed(melted):
        # nodes melted in this round take the label of what they melted into
        up = skew_lookup(
            melt.withColumnRenamed("root", "head"), labels.withColumnRenamed("node", "head"), "head", "left"
        ).select("node", F.coalesce("root", "head").alias("root"))
        heads = up.select("root").join(labels.select(F.col("node").alias("root")), "root", "left_anti").distinct()
        labels = cut(labels.unionByName(up).unionByName(heads.select(F.col("root").alias("node"), "root")))
    if melted:  # a root of contracted pairs need not be the smallest of its group
        least = labels.groupBy("root").agg(F.min("node").alias("group_id"))
        labels = skew_lookup(labels, least, "root").select("node", "group_id")
    else:
        labels = labels.withColumnRenamed("root", "group_id")
    alone = loners.distinct().join(labels.select("node"), "node", "left_anti")
    return labels.unionByName(alone.select("node", F.col("node").alias("group_id")))


def _melt(forest: DataFrame, turn: int) -> DataFrame:
    """(node, root): tails and the smallest head next to each; aggregated on the map side."""
    both = forest.unionByName(forest.select(F.col("root").alias("node"), F.col("node").alias("root")))
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2)) == 0
    return both.where(~coin("node") & coin("root")).groupBy("node").agg(F.min("root").alias("root"))


def _rewrite(forest: DataFrame, melt: DataFrame) -> DataFrame:
    """The pairs with every melted node replaced by its head."""
    one = skew_lookup(forest, melt.select("node", F.col("root").alias("_n")), "node", "left")
    two = skew_lookup(one, melt.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left")
    out = two.select(F.coalesce("_n", "node").alias("node"), F.coalesce("_r", "root").alias("root"))
    return out.where("node <> root").distinct()


def matching_edges(edges: DataFrame, nodes: DataFrame, relation: str = "semantically_similar_to",
                   low: float = 0.85, high: float = 1.0) -> DataFrame:
    """Distinct undirected matches (a, b), a < b: edges of the relation (case, outer blanks
    and separators aside) whose score lies in [low, high] and whose ends differ and both
    exist in ``nodes``. Null or non-number scores and null ends make no match."""
    name = F.regexp_replace(F.lower(F.trim("relation")), "[-_\\s]+", "_")
    score = F.col("confidence_score")
    found = (
        edges.where((name == relation) & score.between(low, high) & ~F.isnan(score))
        .where("source <> target")
        .select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
        .distinct()
    )
    ids = nodes.where("id is not null").select("id").distinct()
    return found.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(
        ids.withColumnRenamed("id", "b"), "b", "left_semi"
    ).select("a", "b")
