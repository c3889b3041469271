"""Communities by modularity: Louvain to a threshold, large communities split once.

A graph whose links fit one task is partitioned there, node after node in a seeded order,
until a pass over all nodes moves at most one in a thousand: none, below a thousand nodes.
Above some links the nodes of one of many seeded sets move at once, set after set, and a level
sets out from an outline by melted graphs, not from single nodes. A graph
too large for one task is contracted first: all nodes of a half (drawn by hash, another
each pass) move at once to the neighbouring community of most gain, passes go on while
modularity gains over the threshold, and the best labelling is melted into a smaller graph.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.analytics import both_ways, number
from scriptorium.operators.packed import TASK_LINKS, coded, links_of, paired
from scriptorium.session import cut, skew_lookup

THRESHOLD, LEVELS, SEED = 1e-4, 10, 42
#: A level is settled when a pass moves at most this share of its nodes.
REST = 0.001
#: Links up to which nodes move one by one; above, those of one of ``SETS`` sets at once.
LOOP_LINKS, SETS = 400_000, 64
#: Share of the nodes that the last pass of an outline may move; the level is settled after it as any other.
ROUGH = 0.1


def _settle(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, rng: random.Random) -> tuple[np.ndarray, int]:
    """(community of each node, passes): moves until a pass over all nodes moves at most ``REST``
    of them. Links are sorted by a. Gains are whole numbers, so each move raises modularity
    and it ends."""
    start = np.searchsorted(a, np.arange(n + 1)).tolist()
    degree = np.bincount(a, w, n).astype(np.int64).tolist()
    to, weight, whole = b.tolist(), w.tolist(), int(w.sum())
    com, tot, order = list(range(n)), degree[:], list(range(n))
    # links of each node to each community, kept up as nodes move
    near = [{j: x for j, x in zip(to[s:e], weight[s:e]) if j != i} for i, (s, e) in enumerate(zip(start, start[1:]))]
    rng.shuffle(order)
    active, full, passes = bytearray(b"\1") * n, True, 0
    while True:
        passes, moved = passes + 1, 0
        for i in order:
            if not active[i]:
                continue
            active[i] = 0
            c, k, own = com[i], degree[i], near[i]
            tot[c] -= k
            best, gain, tie = c, whole * own.get(c, 0) - k * tot[c], False
            for d, x in own.items():
                g = whole * x - k * tot[d]
                if g > gain:
                    best, gain, tie = d, g, False
                elif g == gain and best != c:
                    tie = True
            s, e = start[i], start[i + 1]
            if tie:  # the first by the order of the links
                best = next(com[j] for j in to[s:e] if j != i and whole * own[com[j]] - k * tot[com[j]] == gain)
            tot[best] += k
            if best != c:
                com[i], moved = best, moved + 1
                for j, x in zip(to[s:e], weight[s:e]):
                    active[j] = 1
                    if j != i:
                        own = near[j]
                        if own[c] == x:
                            del own[c]
                        else:
                            own[c] -= x
                        own[best] = own.get(best, 0) + x
        if moved > REST * n:
            full = False
        elif full:
            return np.asarray(com, dtype=np.int64), passes
        else:  # neighbours of what moved are at rest; the sizes of communities changed for all
            active, full = bytearray(b"\1") * n, True


def _summed(key: np.ndarray, w: np.ndarray | None, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (below ``most``) in order, each once, with the sum of their weights (of at most ``bits``
    bits; none: 1 each). ``key`` is overwritten."""
    if w is None:
        key.sort()
    elif most.bit_length() + bits < 63:  # in place
        key <<= bits
        key |= w
        key.sort()
        w = key & ((1 << bits) - 1)
        key >>= bits
    else:
        order = np.argsort(key)
        key, w = key[order], w[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[head], np.diff(np.append(head, len(key))) if w is None else np.add.reduceat(w.astype(np.int64), head)


def _settle_sets(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, rng: random.Random, sets: int = SETS, begin: np.ndarray | None = None, rest: float = -1.0) -> tuple[np.ndarray, int]:
    """``_settle`` by seeded sets of nodes that move at once, to the same end: a pass over all nodes
    moves at most ``REST`` of them. ``begin``: the communities to set out from; ``rest``: ends after
    any pass that moves at most this share.

    A pass goes over nodes whose neighbours moved, and, when that moves at most ``REST``, over all. A
    node is passed over only where it can't move: by no more than its ``slack`` (of staying over
    the best move) can its neighbours' moves and the sizes of communities have changed what it
    gains. A neighbour's move takes a link from it where the neighbour left its community, and one
    where it didn't come to it; what was best bounds a community that had no link, unless that is
    so small that it must be looked at. Where passes gain nothing, sets are made smaller, in the
    end of one node, and then each move raises modularity."""
    whole, far = int(w.sum()), np.int64(1) << 60
    at = np.random.default_rng(rng.randrange(1 << 32)).permutation(n)
    degree = np.empty(n, np.int64)
    degree[at] = np.bincount(a, w, n).astype(np.int64)
    keep = a != b
    key, weight, loops = at[a[keep]], w[keep], int(w[~keep].sum())
    key *= n
    key += at[b[keep]]
    bits = int(weight.max()).bit_length() if len(weight) else 1
    if bits == 1:
        key.sort()
        weight = None
    else:  # links are given once
        key, weight = _summed(key, weight, n * n, bits)
        weight = weight.astype(np.int32)
    start = np.searchsorted(key, np.arange(n + 1) * n)
    key %= n
    to = key.astype(np.int32)
    del key, keep
    com = np.arange(n)
    if begin is not None:
        com[at] = begin
    tot = np.bincount(com, degree, n).astype(np.int64)
    touched = start[1:] > start[:-1]
    slack, own_then, fallen_then, best_then, fallen = np.where(touched, -far, far), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -far * 4), 0
    passes, before, full = 0, -far * 4, True
    while True:
        passes, moved, step = passes + 1, 0, max(1, -(-n // sets))
        for low in range(0, n, step):
            s = slice(low, low + step)
            could = slack[s] < degree[s] * (fallen - fallen_then[s] + tot[com[s]] - own_then[s])
            v = low + np.flatnonzero(could if full else could & touched[s])
            v = v[start[v + 1] > start[v]]
            if not len(v):
                continue
            links, size = links_of(start, v)
            near = np.repeat(np.arange(len(v)) * n, size)
            near += com[to[links]]
            near, x = _summed(near, None if weight is None else weight[links], n * n, bits)
            node = near // n
            other = near - node * n
            k, own = degree[v], com[v]
            mine = other == own[node]
            stay = -k * (tot[own] - k)
            stay[node[mine]] += whole * x[mine]
            gain = np.where(mine, -far * 4, whole * x - k[node] * tot[other])
            best = np.maximum.reduceat(gain, np.searchsorted(node, np.arange(len(v))))
            win = np.flatnonzero(gain == best[node])[::-1]
            new = np.empty(len(v), np.int64)
            new[node[win]] = other[win]  # the least of the best
            slack[v], own_then[v], fallen_then[v], best_then[v], touched[v] = np.where(best <= -far * 4, far, stay - best), tot[own], fallen, best, False
            go = best > stay
            if go.any():
                v, new, own, k = v[go], new[go], own[go], k[go]
                com[v], had = new, tot[own]
                np.add.at(tot, new, k)
                np.subtract.at(tot, own, k)
                fallen += max(0, int((had - tot[own]).max()))
                links, size = links_of(start, v)
                left, came, near = np.repeat(own, size), np.repeat(new, size), to[links]
                mine = com[near]
                less = whole * ((mine == left).astype(np.int64) + (mine != came))
                if weight is not None:
                    less *= weight[links]
                np.subtract.at(slack, near, less)
                slack[near[(mine != came) & (-degree[near] * tot[came] > best_then[near])]] = -far
                touched[near[less > 0]] = True
                slack[v], touched[v] = -far, True
                moved += len(v)
        if moved <= (max(rest, REST) if full else rest) * n:
            return com[at], passes
        full = moved <= REST * n
        if passes % 8 == 0:
            c = com.astype(np.int32)
            inside = np.repeat(c, np.diff(start)) == c[to]
            now = whole * (loops + int(np.count_nonzero(inside) if weight is None else weight[inside].sum())) - int((tot * tot).sum())
            sets, before = sets if now > before else min(n, sets * 4), max(now, before)


def _melted(a: np.ndarray, b: np.ndarray, w: np.ndarray, com: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between communities, by both ends in order, with the sum of their weights."""
    key = com[a]
    key *= n
    key += com[b]
    key, w = _summed(key, w, n * n, int(w.max()).bit_length())
    return (key // n).astype(np.int32), (key % n).astype(np.int32), w.astype(np.int32) if w.max() < 1 << 31 else w


def _outline(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, rng: random.Random) -> tuple[np.ndarray, int]:
    """(community of each node, passes) to set out from: passes by sets until one moves at most
    ``ROUGH`` of the nodes, what they found melted and outlined in turn, as long as that merges over
    ``ROUGH`` of the nodes, and moved by its nodes again."""
    com, passes = _settle_sets(a, b, w, n, rng, rest=ROUGH)
    names, com = np.unique(com, return_inverse=True)
    if len(names) > (1 - ROUGH) * n:
        return com, passes
    links = _melted(a, b, w, com, len(names))
    outer, more = _outline(*links, len(names), rng)
    outer, last = _settle_sets(*links, len(names), rng, begin=outer, rest=ROUGH)
    return outer[com], passes + more + last


def _quality(a: np.ndarray, b: np.ndarray, w: np.ndarray, com: np.ndarray) -> float:
    whole = w.sum()
    return float(w[com[a] == com[b]].sum() / whole - ((np.bincount(com[a], w) / whole) ** 2).sum())


def louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, levels: int = LEVELS) -> tuple[np.ndarray, int]:
    """(community of each node, passes) of a graph of n nodes; links are given from both ends."""
    found, passes, rng = np.arange(n), 0, random.Random(SEED)
    if not (np.diff(a) >= 0).all() or not (np.diff(b)[a[1:] == a[:-1]] >= 0).all():
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
    before = _quality(a, b, w, found) if len(a) else 0.0
    for _ in range(levels if len(a) else 0):
        one_by_one = len(a) <= LOOP_LINKS or int(w.sum()) >= 1 << 30  # squares of larger sums don't fit a word
        if one_by_one:
            com, used = _settle(a, b, w, n, rng)
        else:
            begin, rough = _outline(a, b, w, n, rng)
            com, used = _settle_sets(a, b, w, n, rng, begin=begin)
            used += rough
        passes += used
        after = _quality(a, b, w, com)
        _, com = np.unique(com, return_inverse=True)
        found, n = com[found], int(com.max()) + 1
        if after - before <= THRESHOLD:
            break
        before = after
        a, b, w = _melted(a, b, w, com, n)
    return found, passes


def _in_one_task(levels: int):
    """Over links (a, b, w) from both ends, or over edges (source, target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, a, b, w = coded(batches)
        if not len(names):
            return
        if w is None:
            a, b = paired(a, b, len(names))
            w = np.where(a == b, np.int32(2), np.int32(1))
        com, passes = louvain(a, b, w, len(names), levels)
        _, first = np.unique(com, return_index=True)  # a community is named by its smallest member
        labels = names.take(pa.array(first[com]))
        for k in range(0, len(names), 100_000):
            ids = names.slice(k, 100_000).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, labels.slice(k, 100_000).cast(pa.string()), pa.array([passes] * len(ids), pa.int32())], ["id", "label", "passes"])

    return run


def _melt(links: DataFrame) -> tuple[DataFrame, int, float]:
    """(labels, passes, gain): one level over links (a, b, w) too many for one task."""
    degree = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").cast("double").alias("k"))
    labels = cut(degree.select("id", F.col("id").alias("label"), "k"))
    whole = labels.agg(F.sum("k")).first()[0]

    def quality(labels: DataFrame) -> float:
        one = skew_lookup(links, labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
        inside = skew_lookup(one, labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").where("la = lb").agg(F.sum("w")).first()[0] or 0
        squares = labels.groupBy("label").agg(F.sum("k").alias("t")).agg(F.sum(F.pow(F.col("t") / whole, F.lit(2.0)))).first()[0]
        return inside / whole - squares

    others = links.where("a <> b")
    began = best = quality(labels)
    kept, passes = labels, 0
    while True:
        passes += 1
        for half in (0, 1):
            turn = F.pmod(F.xxhash64(F.lit(SEED + passes), "id"), F.lit(2)) == half
            movers = labels.where(turn)
            asked = others.join(movers.select(F.col("id").alias("a")), "a", "left_semi")
            votes = skew_lookup(asked, labels.select(F.col("id").alias("b"), F.col("label").alias("to")), "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("x"))
            votes = votes.unionByName(movers.select("id", F.col("label").alias("to"), F.lit(0).cast("long").alias("x"))).groupBy("id", "to").agg(F.sum("x").alias("x"))
            tot = labels.groupBy(F.col("label").alias("to")).agg(F.sum("k").alias("t"))
            rows = skew_lookup(votes.join(movers, "id"), tot, "to")
            own = F.col("to") == F.col("label")
            gain = F.lit(whole) * F.col("x") - F.col("k") * (F.col("t") - F.when(own, F.col("k")).otherwise(0.0))
            moved = rows.groupBy("id").agg(F.min_by("to", F.struct(F.negative(gain), F.when(own, 0).otherwise(1), "to")).alias("label"))
            labels = cut(labels.where(~turn).unionByName(moved.join(movers.select("id", "k"), "id").select("id", "label", "k")))
        now = quality(labels)
        gained, (kept, best) = now - best, (labels, now) if now > best else (kept, best)
        if gained <= THRESHOLD:
            return kept.select("id", "label"), passes, best - began


def partition(nodes: DataFrame, edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(id, label, passes): the community of each node by modularity of the undirected graph
    (a pair linked both ways counts once, a loop twice in the degree), and how many passes
    over nodes it took. Nodes without links are communities of their own."""
    if edges.count() <= task_links // 2:
        found = cut(edges.select("source", "target").repartition(1).mapInArrow(_in_one_task(LEVELS), "id string, label string, passes int"))
        return _with_isolates(nodes, found)
    links = cut(both_ways(edges).distinct().select(F.col("id").alias("a"), F.col("other").alias("b"), F.when(F.col("id") == F.col("other"), 2).otherwise(1).cast("long").alias("w")))
    found, passes, levels = None, 0, LEVELS
    while levels and links.count() > task_links:
        labels, used, gain = _melt(links)
        passes, levels = passes + used, levels - 1
        found = labels if found is None else cut(skew_lookup(found.withColumnRenamed("label", "_l"), labels.withColumnRenamed("id", "_l"), "_l").select("id", "label"))
        one = skew_lookup(links, labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
        both = skew_lookup(one, labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        links = cut(both.groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w")))
        if gain <= THRESHOLD:
            levels = 0
    if levels:
        last = cut(links.repartition(1).mapInArrow(_in_one_task(levels), "id string, label string, passes int"))
        if found is None:
            found = last
        else:
            found = skew_lookup(found.withColumnRenamed("label", "_l"), last.withColumnRenamed("id", "_l"), "_l").select("id", "label", (F.col("passes") + passes).alias("passes"))
    else:
        found = found.withColumn("passes", F.lit(passes))
    return _with_isolates(nodes, found)


def _with_isolates(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"), F.coalesce("passes", F.lit(0)).alias("passes"))


def clusters(nodes: DataFrame, edges: DataFrame, share: float = 0.25, least: int = 10, task_links: int = TASK_LINKS) -> DataFrame:
    """(id, community): partitioned by modularity; each community over ``max(least, share x
    nodes)`` is partitioned once more by its inner edges; isolates are communities of one."""
    labels = cut(partition(nodes, edges, task_links).select("id", "label"))
    limit = max(least, int(share * nodes.count()))
    big = [r["label"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()]  # at most 1 / share, or nodes / least of a small graph
    for label in big:
        inside = labels.where(F.col("label") == label).select("id")
        within = edges.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi")
        again = partition(inside, within, task_links).select("id", "label")
        labels = cut(labels.where(F.col("label") != label).unionByName(again))
    return number(labels)
