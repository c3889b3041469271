"""Graph analytics: degrees, communities, cohesion, bridges, surprises, gaps, questions.

``nodes`` and ``edges`` are a built graph (one row an id, one edge a pair of ends);
``members`` is (id, community). Degrees count both directions, a loop twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.packed import TASK_LINKS, coded, paired, walked
from scriptorium.session import cut, numbered, skew_lookup

#: Copies of a packed graph, at most, and their bytes together; values in one row of it.
COPIES, COPIED_BYTES, PIECE = 12, 400 << 20, 250_000
STRUCTURAL = ("imports", "imports_from", "contains", "method")


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other): every edge from each end."""
    return edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node; 0 without edges. Counts combine on the map side. Nodes that carry
    their ``degree`` are not counted again."""
    if "degree" in nodes.columns:
        return nodes.select("id", "degree")
    counted = both_ways(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counted, "id", "left").na.fill(0, ["degree"])


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10, without_types: tuple[str, ...] = (), file_names: bool = True) -> DataFrame:
    """(id, label, degree): the most linked nodes, ties by id. ``file_names=False`` leaves out
    nodes that stand for a file (label equals the file's name) or have no file."""
    rows = nodes.where(~F.coalesce(F.col("file_type").isin(list(without_types)), F.lit(False))) if without_types else nodes
    if not file_names:
        name = F.regexp_extract("source_file", r"([^/\\]*)$", 1)
        rows = rows.where(F.col("source_file").isNotNull() & name.contains(".") & (F.coalesce("label", F.lit("")) != name))
    found = rows.select("id", F.coalesce("label", "id").alias("label")).join(degrees(nodes, edges), "id")
    return found.orderBy(F.desc("degree"), "id").limit(top)


def number(labels: DataFrame) -> DataFrame:
    """(id, community): communities numbered from 0 by size, then smallest member."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    ranked = numbered(sizes, [F.desc("n"), "first"], "_i").withColumn("community", (F.col("_i") - 1).cast("int"))
    return skew_lookup(labels, ranked.select("label", "community"), "label").select("id", "community")


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, members, cohesion): edges inside over possible pairs, two places; 1 for one node."""
    sizes = members.groupBy("community").agg(F.count("*").alias("members"))
    joined = with_communities(edges, members).where("_cu = _cv and source <> target")
    inside = joined.groupBy(F.col("_cu").alias("community")).agg(F.count("*").alias("_e"))
    n = F.col("members")
    return sizes.join(inside, "community", "left").select(
        "community", "members", F.when(n < 2, 1.0).otherwise(F.round(F.coalesce("_e", F.lit(0)) / (n * (n - 1) / 2), 2)).alias("cohesion"))


def with_communities(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``edges`` with ``_cu`` and ``_cv``, the communities of their ends; those that carry them are as they were."""
    if "_cu" in edges.columns:
        return edges
    one = skew_lookup(edges, members.select(F.col("id").alias("source"), F.col("community").alias("_cu")), "source")
    return skew_lookup(one, members.select(F.col("id").alias("target"), F.col("community").alias("_cv")), "target", like=edges)


def bridges(nodes: DataFrame, edges: DataFrame, members: DataFrame, top: int = 3) -> DataFrame:
    """(community, id, label, degree, connected): nodes by how many other communities their
    targets are in; the ``top`` of each community, ties by id."""
    out = with_communities(edges, members).where("_cu <> _cv").groupBy(F.col("source").alias("id"), F.col("_cu").alias("community")).agg(
        F.countDistinct("_cv").alias("connected"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("connected"), "id"))
    found = out.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")
    return found.join(nodes.select("id", F.coalesce("label", "id").alias("label")), "id").join(degrees(nodes, edges), "id").select(
        "community", "id", "label", "degree", "connected")


def _edge_facts(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    facts = nodes.select("id", F.coalesce("label", "id").alias("l"), "file_type", "source_file").join(degrees(nodes, edges), "id").join(members, "id", "left")
    facts = cut(facts)  # looked up from both ends
    out = edges
    for end, x in (("source", "u"), ("target", "v")):
        side = facts.select(F.col("id").alias(end), F.col("l").alias(f"_l{x}"), F.col("file_type").alias(f"_t{x}"),
                            F.col("source_file").alias(f"_f{x}"), F.col("degree").alias(f"_d{x}"), F.col("community").alias(f"_c{x}"))
        out = skew_lookup(out, side, end, like=edges)
    return out


def _trust(c: Column) -> Column:
    return F.when(c == "AMBIGUOUS", 3).when(c == "INFERRED", 2).otherwise(1)


def _hub() -> Column:
    return ((F.col("_du") <= 2) & (F.col("_dv") >= 5)) | ((F.col("_dv") <= 2) & (F.col("_du") >= 5))


def _reasons(*more: tuple[Column, str]) -> Column:
    told = [*more, (F.col("_cu") != F.col("_cv"), "across communities"), (F.col("relation") == "semantically_similar_to", "similar in meaning"), (_hub(), "from a loose node to a hub")]
    unsure = F.when(F.col("confidence") == "AMBIGUOUS", "uncertain edge").when(F.col("confidence") == "INFERRED", "inferred edge")
    return F.array_compact(F.array(unsure, *[F.when(test, text) for test, text in told]))


def surprising(nodes: DataFrame, edges: DataFrame, members: DataFrame, top: int = 5, reasons: bool = False) -> DataFrame:
    """(source, target, source_label, target_label, relation, confidence, score): edges one
    would not expect: uncertain, across types or communities, similar in meaning, from a
    loose node to a hub. Score over 1, the ``top``, ties by arrival. ``reasons`` adds the
    column of that name, what made the score."""
    rows = _edge_facts(nodes, edges, members)
    score = _trust(F.col("confidence")) + F.when(F.col("_tu") != F.col("_tv"), 2).otherwise(0) + F.when(F.col("_cu") != F.col("_cv"), 1).otherwise(0)
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5)).otherwise(score).cast("int") + F.when(_hub(), 1).otherwise(0)
    rows = rows.withColumn("score", score).where("score > 1").orderBy(F.desc("score"), "seq", "source", "target").limit(top)
    more = [_reasons((F.col("_tu") != F.col("_tv"), "across types")).alias("reasons")] if reasons else []
    return rows.select("source", "target", F.col("_lu").alias("source_label"), F.col("_lv").alias("target_label"), "relation", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"), "score", *more)


def file_category(path: str) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(end == "pdf", "paper").when(end.isin("png", "jpg", "jpeg", "gif", "webp", "svg"), "image").when(end.isin("md", "txt", "rst", ""), "doc").otherwise("code")


def cross_file(nodes: DataFrame, edges: DataFrame, members: DataFrame, top: int = 5, reasons: bool = False) -> DataFrame:
    """(source, target, relation, score): edges between different files, scored by
    uncertainty, category and folder of the files, community, meaning and hubs; ``reasons``
    adds what made the score."""
    rows = _edge_facts(nodes, edges, members).where("_fu <> '' and _fv <> '' and _fu <> _fv").where(~F.coalesce(F.col("relation").isin(list(STRUCTURAL)), F.lit(False)))
    folder = lambda c: F.substring_index(c, "/", 1)
    score = _trust(F.col("confidence")) + F.when(file_category("_fu") != file_category("_fv"), 2).otherwise(0)
    score = score + F.when(folder("_fu") != folder("_fv"), 2).otherwise(0) + F.when(F.col("_cu") != F.col("_cv"), 1).otherwise(0)
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5)).otherwise(score).cast("int") + F.when(_hub(), 1).otherwise(0)
    rows = rows.withColumn("score", score).orderBy(F.desc("score"), "seq", "source", "target").limit(top)
    told = _reasons((file_category("_fu") != file_category("_fv"), "across kinds of file"), (folder("_fu") != folder("_fv"), "across folders"))
    return rows.select("source", "target", "relation", "score", *([told.alias("reasons")] if reasons else []))


def surprises(nodes: DataFrame, edges: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """(source, target, relation, score): ``cross_file`` where nodes are of several files and it
    finds any, else an edge for each pair of communities, with score 0."""
    several = nodes.where("source_file <> ''").select("source_file").distinct().limit(2).count() > 1
    found = cut(cross_file(nodes, edges, members, top)) if several else None
    if found is not None and not found.isEmpty():
        return found
    return cross_community(edges, members, top).select("source", "target", "relation", F.lit(0).alias("score"))


def cross_community(edges: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """(community_a, community_b, source, target, relation, confidence): one edge for each
    unordered pair of communities, the least certain first."""
    rows = with_communities(edges, members).where("_cu <> _cv")
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).when(F.col("confidence") == "EXTRACTED", 2).otherwise(3)
    first = rows.groupBy(F.least("_cu", "_cv").alias("community_a"), F.greatest("_cu", "_cv").alias("community_b")).agg(
        F.min_by(F.struct("source", "target", "relation", "confidence", rank.alias("r"), "seq"), F.struct(rank, "seq", "source", "target")).alias("_e"))
    out = first.select("community_a", "community_b", *[F.col("_e")[c].alias(c) for c in ("source", "target", "relation", "confidence", "r", "seq")])
    return out.orderBy("r", "seq", "community_a", "community_b").limit(top).drop("r", "seq")


def gaps(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(gap, ref, n): isolated nodes (degree at most 1), communities under three members, and
    the ambiguous share of all edges in tenths of a percent."""
    lone = degrees(nodes, edges).where("degree <= 1").select(F.lit("isolated").alias("gap"), F.col("id").alias("ref"), F.col("degree").cast("double").alias("n"))
    thin = members.groupBy("community").agg(F.count("*").alias("n")).where("n < 3").select(F.lit("thin community"), F.col("community").cast("string"), F.col("n").cast("double"))
    part = edges.agg(F.sum((F.col("confidence") == "AMBIGUOUS").cast("int")).alias("a"), F.count("*").alias("t"))
    share = part.select(F.lit("ambiguous percent"), F.lit(""), F.round(F.coalesce("a", F.lit(0)) * 100 / F.greatest("t", F.lit(1)), 1))
    return lone.union(thin).union(share)


def _quote(c: Column | str) -> Column:
    return F.concat(F.lit("`"), F.coalesce(c, F.lit("")), F.lit("`"))


def _no_concept(file: str) -> Column:
    """A node that stands for something in a file: its file has an ending."""
    return F.coalesce(F.col(file).contains("."), F.lit(False)) & (F.col(file) != "")


def questions(nodes: DataFrame, edges: DataFrame, members: DataFrame, top: int = 7, sources: int = 100, exact: int = 1_000, names: DataFrame | None = None, dense: DataFrame | None = None) -> DataFrame:
    """(ord, kind, question, why): what to ask next: uncertain edges by arrival; the three nodes of
    highest betweenness (all nodes of a graph up to ``exact`` start paths, else a seeded
    sample) that link communities; of the five most linked nodes those with two inferred
    edges or more; the loose nodes; communities of five nodes or more with cohesion under
    0.15. The first ``top`` of all, in this order; one row of kind no_signal if there is none.
    Nodes that stand for a file, or for none, are no bridges and not loose. ``names`` and ``dense``
    are ``name_communities`` and ``cohesion`` where they are at hand."""
    label = nodes.select("id", F.coalesce("label", "id").alias("l"), "source_file", "label")
    own = F.coalesce("label", F.lit("")) == F.regexp_extract(F.coalesce("source_file", F.lit("")), r"([^/\\]*)$", 1)
    inner = label.where(_no_concept("source_file") & ~own).select("id", "l")
    names = name_communities(nodes, edges, members) if names is None else names
    row = lambda k, kind, s, t, q, w: [F.lit(k).alias("k"), F.lit(kind).alias("kind"), s.cast("double").alias("s"), t.alias("t"), q.alias("question"), w.alias("why")]
    unsure = edges.where("confidence = 'AMBIGUOUS'").orderBy("seq", "source", "target").limit(top)
    unsure = unsure.join(label.select(F.col("id").alias("source"), F.col("l").alias("a")), "source").join(label.select(F.col("id").alias("target"), F.col("l").alias("b")), "target")
    one = unsure.select(*row(1, "ambiguous_edge", F.col("seq"), F.concat_ws("|", "source", "target"), F.concat(F.lit("What is the exact relationship between "), _quote("a"), F.lit(" and "), _quote("b"), F.lit("?")),
                             F.concat(F.lit("The edge is uncertain (relation: "), F.coalesce("relation", F.lit("related to")), F.lit(")."))))
    n = nodes.count()
    scored = betweenness(nodes, edges, sources, exact).where("score > 0").join(inner, "id").orderBy(F.desc("score"), "id").limit(3)
    scored = cut(scored)
    most = max(1.0, (n - 1) * (n - 2)) * (1.0 if n <= exact else min(sources, n) / max(1, n))
    near = both_ways(edges).distinct().join(F.broadcast(scored.select("id")), "id", "left_semi")  # three rows
    near = near.join(members.select("id", F.col("community").alias("c")), "id").join(members.select(F.col("id").alias("other"), F.col("community").alias("o")), "other").where("c <> o").select("id", "c", "o").distinct()
    near = near.join(names.select(F.col("community").alias("o"), F.col("name").alias("on")), "o").join(names.select(F.col("community").alias("c"), F.col("name").alias("cn")), "c")
    linked = near.groupBy("id", "cn").agg(F.array_sort(F.collect_set(F.struct("o", "on"))).alias("x"))
    two = scored.join(linked, "id").select(*row(2, "bridge_node", -F.col("score"), F.col("id"), F.concat(F.lit("Why does "), _quote("l"), F.lit(" connect "), _quote("cn"), F.lit(" to "), F.array_join(F.transform("x", lambda y: _quote(y["on"])), ", "), F.lit("?")),
                                                F.format_string("Many shortest paths pass through it (%.3f).", F.col("score") / F.lit(most))))
    hubs = degrees(nodes, edges).join(label.where(~own), "id").orderBy(F.desc("degree"), "id").limit(5)
    guessed = edges.where("confidence = 'INFERRED'").join(F.broadcast(hubs.select(F.col("id").alias("source"))), "source", "left_semi")
    guessed = guessed.join(label.select(F.col("id").alias("target"), F.col("l").alias("b")), "target")
    # the first two by arrival: a count and two minima, so that a hub's edges are not collected
    first = F.struct("seq", "target", "b")
    counted = guessed.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"), F.min(first).alias("p"))
    second = guessed.join(counted.select(F.col("id").alias("source"), "p"), "source").where(first > F.col("p")).groupBy(F.col("source").alias("id")).agg(F.min(first).alias("q"))
    three = hubs.join(counted.where("n >= 2"), "id").join(second, "id").select(*row(3, "verify_inferred", -F.col("degree"), F.col("id"), F.concat(
        F.lit("Are the "), F.col("n").cast("string"), F.lit(" inferred relationships of "), _quote("l"), F.lit(" (e.g. with "), _quote("p.b"), F.lit(" and "), _quote("q.b"), F.lit(") correct?")),
        F.concat(_quote("l"), F.lit(" has "), F.col("n").cast("string"), F.lit(" inferred edges to verify."))))
    loose = degrees(nodes, edges).where("degree <= 1").join(inner, "id")
    some = loose.orderBy("id").limit(3).agg(F.array_sort(F.collect_list(F.struct("id", "l"))).alias("x"))
    four = some.join(F.broadcast(loose.agg(F.count("*").alias("n"))), F.lit(True)).where("n > 0").select(*row(4, "isolated_nodes", F.lit(0), F.lit(""), F.concat(  # one row and one row
        F.lit("What connects "), F.array_join(F.transform("x", lambda y: _quote(y["l"])), ", "), F.lit(" to the rest?")), F.concat(F.col("n").cast("string"), F.lit(" nodes have one link or none."))))
    thin = (cohesion(members, edges) if dense is None else dense).where("members >= 5 and cohesion < 0.15").orderBy("community").limit(top).join(names, "community")
    five = thin.select(*row(5, "low_cohesion", F.col("community"), F.lit(""), F.concat(F.lit("Should "), _quote("name"), F.lit(" be split into smaller groups?")), F.format_string("Cohesion is %.2f.", "cohesion")))
    every = cut(one.unionByName(two).unionByName(three).unionByName(four).unionByName(five).orderBy("k", "s", "t").limit(top))
    if every.isEmpty():
        return every.sparkSession.createDataFrame([(1, "no_signal", None, "No uncertain or inferred edges, no bridges, no loose nodes or communities.")], "ord int, kind string, question string, why string")
    return every.select(F.row_number().over(Window.orderBy("k", "s", "t")).alias("ord"), "kind", "question", "why")  # at most ``top`` rows


def name_communities(nodes: DataFrame, edges: DataFrame, members: DataFrame, top: int = 4) -> DataFrame:
    """(community, name): the label of its most linked node, and as many of the next (at most
    ``top``, joined by " / ") as tell it from all communities before it; only concepts count
    where there are any. Nodes without a label are not used; a community that no such name
    tells apart is called by its number.

    A name of k labels goes to the first community that has it among those that got none of
    fewer labels, so all names of k labels are given at once."""
    rows = members.join(nodes.where("label <> ''").select("id", "label", "file_type"), "id").join(degrees(nodes, edges), "id")
    concept = F.when(F.col("file_type") == "concept", 0).otherwise(1)
    # the limit on the rank is applied before the rows of a community meet
    rank = F.row_number().over(Window.partitionBy("community").orderBy(concept, F.desc("degree"), "id"))
    picked = rows.withColumn("_k", concept).withColumn("_r", rank).where(F.col("_r") <= top)
    best = picked.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("_r", "label", "_k"))).alias("x"))  # at most ``top``
    left = best.select("community", F.transform(F.filter("x", lambda y: y["_k"] == F.col("x")[0]["_k"]), lambda y: y["label"]).alias("labels"))
    named = None
    for k in range(1, top + 1):
        name = F.array_join(F.slice("labels", 1, k), " / ")
        left = cut(left)
        part = left.where(F.size("labels") >= k).groupBy(name.alias("name")).agg(F.min("community").alias("community")).select("community", "name")
        named = part if named is None else named.unionByName(part)
        left = left.join(part.select("community"), "community", "left_anti")
    ids = members.select("community").distinct()
    return ids.join(named, "community", "left").select("community", F.coalesce("name", F.format_string("社区%d", "community")).alias("name"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int = 100, exact: int = 1_000, task_links: int = TASK_LINKS) -> DataFrame:
    """(id, score): how many shortest paths pass through a node (Brandes, level by level until
    nothing new is reached). Paths start at all nodes of a graph of up to ``exact`` nodes,
    else at a seeded sample of ``sources``. A graph of up to ``task_links`` links is packed in
    one task, and tasks that hold a copy share the sources; in a larger one all sources move
    together, one join a level."""
    seeds = nodes.select("id") if nodes.count() <= exact else nodes.select("id").orderBy(F.xxhash64(F.lit(42), "id"), "id").limit(sources)
    if edges.count() > task_links // 2:
        return _joined_betweenness(nodes, edges, seeds)
    packed = cut(edges.where("source <> target").select("source", "target").repartition(1).mapInArrow(_pack, "id string, n int, piece int, data binary"))
    codes = packed.where("id is not null").select("id", "n")
    starts = [r["n"] for r in seeds.join(codes, "id").select("n").orderBy("n").collect()]  # at most ``exact`` or ``sources``
    size = packed.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    tasks = max(1, min(len(starts), COPIES, COPIED_BYTES // max(1, size)))
    copies = packed.where("id is null").drop("id").crossJoin(packed.sparkSession.range(tasks).withColumnRenamed("id", "task"))
    copies = copies.repartitionByRange(tasks, "task").sortWithinPartitions("task", "n", "piece").select("task", "n", "data")
    found = copies.mapInArrow(_walk_parts(starts, tasks), "n int, d double").groupBy("n").agg(F.sum("d").alias("d"))
    found = codes.join(found, "n").select("id", "d")
    return nodes.select("id").join(found, "id", "left").select("id", F.round(F.coalesce("d", F.lit(0.0)), 6).alias("score"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n) of the nodes, and the degrees (n = 0) and links (n = 1) as bytes in pieces."""
    names, a, b, _ = coded(batches)
    a, b = paired(a, b, len(names))
    columns = ["id", "n", "piece", "data"]
    for k in range(0, len(names), PIECE):
        ids, none = names.slice(k, PIECE).cast(pa.string()), len(names.slice(k, PIECE))
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(k, k + len(ids)), pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], columns)
    for n, whole in enumerate((np.bincount(a, minlength=len(names)).astype(np.int32), b)):
        for k in range(0, len(whole), PIECE):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([n], pa.int32()), pa.array([k // PIECE], pa.int32()), pa.array([whole[k : k + PIECE].tobytes()], pa.binary())], columns)


def _walk_parts(starts: list[int], tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t, n, x) for batch in batches for t, n, x in zip(*(c.to_pylist() for c in batch.columns)))
        for task, own in groupby(rows, key=lambda r: r[0]):
            parts: list[list[np.ndarray]] = [[], []]
            for _, n, x in own:
                parts[n].append(np.frombuffer(x, np.int32))
            start = np.concatenate([[0], np.cumsum(np.concatenate(parts[0]), dtype=np.int64)])
            score = walked(start, np.concatenate(parts[1]), starts[task::tasks])
            some = np.flatnonzero(score)
            for k in range(0, len(some), PIECE):
                at = some[k : k + PIECE]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(score[at])], ["n", "d"])

    return run


def _joined_betweenness(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All sources move together, one join a level."""
    codes = cut(numbered(nodes.select("id"), ["id"], "n"))
    pairs = skew_lookup(both_ways(edges.where("source <> target")).distinct(), codes, "id").select(F.col("n").alias("id"), F.col("other").alias("_o"))
    links = cut(skew_lookup(pairs, codes.select(F.col("id").alias("_o"), F.col("n").alias("other")), "_o").select("id", "other"))
    front = cut(seeds.join(codes, "id").select(F.col("n").alias("s"), F.col("n").alias("id"), F.lit(1.0).alias("paths")))
    levels, before = [front], None
    while True:
        step = front.join(links, "id").groupBy("s", F.col("other").alias("id")).agg(F.sum("paths").alias("paths"))
        near = front if before is None else front.unionByName(before)  # a neighbour is at most one level off
        before, front = front, cut(step.join(near.select("s", "id"), ["s", "id"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
    flow, sums = levels[-1].select("s", "id", "paths", F.lit(0.0).alias("d")), None
    for k in range(len(levels) - 1, -1, -1):
        if k < len(levels) - 1:
            down = flow.select("s", "id", ((1 + F.col("d")) / F.col("paths")).alias("x"))
            share = down.join(links, "id").groupBy("s", F.col("other").alias("id")).agg(F.sum("x").alias("x"))
            flow = cut(levels[k].join(share, ["s", "id"], "left").select("s", "id", "paths", (F.col("paths") * F.coalesce("x", F.lit(0.0))).alias("d")))
        part = flow.where("s <> id").select("id", "d")
        sums = cut((part if sums is None else sums.unionByName(part)).groupBy("id").agg(F.sum("d").alias("d")))
    return codes.join(sums.withColumnRenamed("id", "n"), "n", "left").select("id", F.round(F.coalesce("d", F.lit(0.0)), 6).alias("score"))
