"""Graph assembly: deliveries merged, nodes consolidated, aliases merged, dangling parts pruned, issues listed.

``nodes``: (id, label, file_type, source_file, attrs); ``edges``: (source, target,
relation, confidence, confidence_score, seq). Arrival order of edges is ``seq``; of
nodes, which have none, a delivery with a label comes before one without, then plain
order of label, type and file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.paths import stem_of
from scriptorium.session import cut, is_small, skew_lookup

# fixed values: allowed values of a delivery
NODE_TYPES = ("document", "concept")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
RELATIONS = (
    "applied_to", "references", "includes_module", "uses", "semantically_similar_to", "depends_on", "provides", "part_of",
    "example_of", "triggered_by",
)
ID_LIKE = r"(?i)^(concept|solution|document|article|region|customer)[_:].+"


def merge_nodes(nodes: DataFrame, last: bool = False) -> DataFrame:
    """One row an id: the first delivery (``last``: the last one); rows without id are dropped."""
    order = F.struct(F.coalesce("label", F.lit("")) == "", "label", "file_type", "source_file")
    pick = F.max_by if last else F.min_by
    rest = ["label", "file_type", "source_file", "attrs"]
    rows = nodes.where("id is not null and id <> ''").groupBy("id").agg(pick(F.struct(*rest), order).alias("_n"))
    return rows.select("id", *[F.col("_n")[c].alias(c) for c in rest])


def build_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """At most one edge a (source, target), the last by ``seq``; edges with an end that is no node
    are dropped, a score that is not a number is null. Edges of no other column are made distinct. One target may hold any share of the edges:
    ends are made distinct on the map side, and where those that are no nodes are counted to be
    few, they are broadcast and no edge is shuffled to find its ends."""
    if "confidence_score" in edges.columns:
        edges = edges.withColumn("confidence_score", F.when(~F.isnan("confidence_score"), F.col("confidence_score")))
    rest = [c for c in edges.columns if c not in ("source", "target")]
    rows = edges.where("source is not null and target is not null")
    ends = rows.select(F.col("source").alias("id")).union(rows.select("target")).distinct()
    gone = cut(ends.join(nodes.select("id"), "id", "left_anti"))
    few = is_small(gone)
    if few:
        for end in ("source", "target"):
            rows = rows.join(F.broadcast(gone.withColumnRenamed("id", end)), end, "left_anti")
    if rest:
        rows = rows.groupBy("source", "target").agg(F.max_by(F.struct(*rest), F.struct("seq", F.coalesce("relation", F.lit("")))).alias("_e"))
    else:
        rows = rows.distinct()
    if not few:
        rows = cut(rows)
        for end in ("source", "target"):
            rows = skew_lookup(rows, nodes.select(F.col("id").alias(end)), end)
    return rows.select("source", "target", *[F.col("_e")[c].alias(c) for c in rest])


def build(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph: (nodes, edges)."""
    n = cut(merge_nodes(nodes))
    return n, build_edges(edges, n)


def heal_source(nodes: DataFrame) -> DataFrame:
    """Files get the folder of their type; a folder that is there decides the type."""
    src = F.replace(F.col("source_file"), F.lit("\\"), F.lit("/"))
    kind = F.when(src.startswith("concepts/"), "concept").when(src.startswith("articles/"), "document")
    file = F.when(kind.isNotNull(), src).when(F.col("source_file") == "", F.col("source_file")).when(
        F.col("file_type") == "concept", F.concat(F.lit("concepts/"), src)).when(F.col("file_type") == "document", F.concat(F.lit("articles/"), src)).otherwise(F.col("source_file"))
    return nodes.withColumn("_k", kind).withColumn("source_file", file).withColumn("file_type", F.coalesce("_k", "file_type")).drop("_k")


def redirect_edges(edges: DataFrame, redirect: DataFrame) -> DataFrame:
    """Edges with ends rewritten by (id, to); loops and later repeats of (source, target, relation) go."""
    a = redirect.select(F.col("id").alias("source"), F.col("to").alias("_s"))
    b = redirect.select(F.col("id").alias("target"), F.col("to").alias("_t"))
    rows = skew_lookup(skew_lookup(edges.where("source <> '' and target <> ''"), a, "source", "left"), b, "target", "left")
    rows = rows.withColumn("source", F.coalesce("_s", "source")).withColumn("target", F.coalesce("_t", "target")).drop("_s", "_t").where("source <> target")
    rest = [c for c in edges.columns if c not in ("source", "target", "relation")]
    first = rows.groupBy("source", "target", "relation").agg(F.min_by(F.struct(*rest), "seq").alias("_e"))
    return first.select("source", "target", "relation", *[F.col("_e")[c].alias(c) for c in rest])


def consolidate(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, redirect): nodes of one file become one, the first with a label; labels and
    types that are missing come from the file; (id, to) says where the others went."""
    rows = heal_source(merge_nodes(nodes))
    filed = rows.where("source_file <> ''")
    order = F.struct(F.coalesce("label", F.lit("")) == "", "id")
    head = filed.groupBy("source_file").agg(F.min_by(F.struct("id", "label", "file_type", "attrs"), order).alias("_h"))
    kept = head.select(F.col("_h.id").alias("id"), F.coalesce(F.when(F.col("_h.label") != "", F.col("_h.label")), stem_of("source_file")).alias("label"),
                       F.col("_h.file_type").alias("file_type"), "source_file", F.col("_h.attrs").alias("attrs"))
    loose = rows.where("source_file is null or source_file = ''").withColumn("label", F.coalesce(F.when(F.col("label") != "", F.col("label")), "id"))
    moved = filed.select("id", "source_file").join(kept.select("source_file", F.col("id").alias("to")), "source_file").where("id <> to").select("id", "to")
    return kept.unionByName(loose.select(*kept.columns)), moved


def redirect_members(hyper: DataFrame, redirect: DataFrame, least: int = 2) -> DataFrame:
    """Hyperedges (id, members) with members rewritten, repeats dropped in order, and those
    under ``least`` members dropped."""
    rows = hyper.select("id", F.posexplode("members").alias("pos", "m")).join(redirect.withColumnRenamed("id", "m"), "m", "left")
    rows = rows.groupBy("id", F.coalesce("to", "m").alias("m")).agg(F.min("pos").alias("pos"))
    out = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("members"))
    return out.where(F.size("members") >= least).withColumn("member_count", F.size("members"))


def merge_aliases(nodes: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, redirect): concept nodes whose label maps to one name (key, name) become one:
    the one labelled so, else the first id; ``aliases_ids`` are the others."""
    rows = nodes.withColumn("key", F.when(F.col("file_type") == "concept", F.lower(F.trim("label"))))
    rows = rows.join(names.withColumnRenamed("name", "_name"), "key", "left").drop("key")
    mapped = rows.where("_name is not null")
    heads = mapped.groupBy("_name").agg(
        F.min_by(F.struct("id", "file_type", "source_file", "attrs"), F.struct(F.trim("label") != F.col("_name"), "id")).alias("_h"), F.collect_set("id").alias("_ids"))
    merged = heads.select(F.col("_h.id").alias("id"), F.col("_name").alias("label"), F.col("_h.file_type").alias("file_type"),
                          F.col("_h.source_file").alias("source_file"), F.col("_h.attrs").alias("attrs"),
                          F.array_sort(F.array_remove("_ids", F.col("_h.id"))).alias("aliases_ids"))
    moved = mapped.select("id", "_name").join(heads.select("_name", F.col("_h.id").alias("to")), "_name").where("id <> to").select("id", "to")
    rest = rows.where("_name is null").drop("_name").withColumn("aliases_ids", F.array().cast("array<string>"))
    return merged.unionByName(rest.select(*merged.columns)), moved


def orphans(nodes: DataFrame, edges: DataFrame, stems: DataFrame, hyper: DataFrame | None = None) -> DataFrame:
    """(id, label): concept nodes without a file, without an edge, in no hyperedge, and whose
    label is no page's stem."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target"))
    if hyper is not None:
        ends = ends.union(hyper.select(F.explode("members")))
    ends = ends.where("id is not null").distinct()
    rows = nodes.where("file_type = 'concept' and (source_file is null or source_file = '')")
    rows = rows.join(ends, "id", "left_anti").join(stems.select(F.col("stem").alias("label")).distinct(), "label", "left_anti")
    return rows.select("id", "label")


def without(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without some nodes (id) and the edges that touch them."""
    ids = gone.select("id")
    left = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


def shrunk(hyper: DataFrame, gone: DataFrame, least: int = 2) -> DataFrame:
    """Hyperedges without some nodes (id), order kept; those under ``least`` members are dropped.
    Members that are null are dropped as well."""
    rows = hyper.select("id", F.posexplode("members").alias("pos", "m")).where("m is not null")
    left = rows.join(gone.select(F.col("id").alias("m")), "m", "left_anti").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_m"))
    out = left.select("id", F.transform("_m", lambda x: x["m"]).alias("members")).where(F.size("members") >= least)
    return out.withColumn("member_count", F.size("members"))


def attach(hyper: DataFrame, more: DataFrame) -> DataFrame:
    """The hyperedges (id, members) and those of ``more`` with an id that is not among them, the
    first in plain order of members where an id comes twice."""
    new = more.where("id is not null and id <> ''").groupBy("id").agg(F.min("members").alias("members"))
    both = hyper.select("id", "members").unionByName(new.join(hyper.select("id"), "id", "left_anti"))
    return both.withColumn("member_count", F.size("members"))


def hyper_issues(hyper: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(issue, ref): hyperedges without an id, with too few members, or with members that are no nodes."""
    rows = hyper.select("id", "members").distinct()
    ref = F.coalesce("id", F.lit("")).alias("ref")
    checks = F.array_compact(F.array(F.when(F.coalesce("id", F.lit("")) == "", "hyperedge id missing"), F.when(F.coalesce(F.size("members"), F.lit(0)) < least, "hyperedge too small")))
    one = rows.select(F.explode(checks).alias("issue"), ref)
    ids = nodes.where("id is not null").select(F.col("id").alias("m")).distinct()
    loose = rows.select("id", F.explode("members").alias("m")).join(ids, "m", "left_anti").select(F.lit("hyperedge member unknown").alias("issue"), ref).distinct()
    return one.unionByName(loose)


def summary(issues_: DataFrame) -> DataFrame:
    """(issue, n): how many rows of each issue, none where there are none."""
    return issues_.groupBy("issue").agg(F.count("*").alias("n"))


def assert_valid(issues_: DataFrame, shown: int = 20) -> None:
    """ValueError if there is an issue; it counts all and names the first ``shown``."""
    counts = {r["issue"]: r["n"] for r in summary(issues_).orderBy("issue").collect()}  # one row a kind of issue
    if counts:
        some = [f"{r['issue']}: {r['ref']}" for r in issues_.orderBy("issue", "ref").limit(shown).collect()]
        raise ValueError(f"{sum(counts.values())} issues ({', '.join(f'{k}: {n}' for k, n in counts.items())})\n" + "\n".join(some))


def pruned(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(edges whose ends are both nodes, how many were not)."""
    ids = nodes.where("id is not null").select("id").distinct()
    left = edges
    for end in ("source", "target"):
        left = skew_lookup(left, ids.withColumnRenamed("id", end), end)
    return left.select(*edges.columns), edges.count() - left.count()


def duplicates(stems: DataFrame, names: DataFrame, nodes: DataFrame, edges: DataFrame, least: float = 0.85) -> DataFrame:
    """(canonical_name, duplicate, source): pages that may be one concept: a stem that is an
    alias of another name; or two stems joined by a similar edge, the shorter label first
    (ties: the source of the edge), unless aliases say it already."""
    stem = stems.select("stem").distinct()
    by_alias = stem.join(names.select(F.col("key"), F.col("name").alias("canonical_name")), F.lower("stem") == F.col("key")).where(
        "canonical_name <> stem").select("canonical_name", F.col("stem").alias("duplicate"))
    pairs = edges.where((F.col("relation") == "semantically_similar_to") & (F.col("confidence_score") >= least) & ~F.isnan("confidence_score"))
    a = nodes.where("label <> ''").select(F.col("id").alias("source"), F.col("label").alias("a"))
    b = nodes.where("label <> ''").select(F.col("id").alias("target"), F.col("label").alias("b"))
    pairs = pairs.select("source", "target").join(a, "source").join(b, "target").where("a <> b")
    for c in ("a", "b"):
        pairs = pairs.join(stem.withColumnRenamed("stem", c), c, "left_semi")
    first = F.length("a") <= F.length("b")
    similar = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical_name"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("duplicate")).distinct()
    similar = similar.join(by_alias, ["canonical_name", "duplicate"], "left_anti")
    return by_alias.withColumn("source", F.lit("aliases")).unionByName(similar.withColumn("source", F.lit("graph_semantic")))


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, ref): everything wrong with a delivery; it never fails."""
    label = F.coalesce("label", F.lit(""))
    n = nodes.select("id", "label", "file_type", "source_file").distinct()
    checks = F.array_compact(F.array(
        F.when(F.col("id").isNull() | (F.col("id") == ""), "node id missing"),
        F.when(label == "", "node label missing"),
        F.when((label != "") & ((label == F.col("id")) | label.rlike(ID_LIKE)), "node label is an id"),
        F.when(F.col("file_type").isNull(), "node type missing"),
        F.when(~F.col("file_type").isin(list(NODE_TYPES)), "node type unknown"),
    ))
    one = n.select(F.explode(checks).alias("issue"), F.coalesce("id", F.lit("")).alias("ref"))
    twice = n.where("id is not null").groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.lit("node id repeated").alias("issue"), F.col("id").alias("ref"))
    e = edges.select("seq", "source", "target", "relation", "confidence", "confidence_score").distinct()
    ids = nodes.where("id is not null").select("id").distinct()
    e = e.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    score = F.col("confidence_score")
    checks = F.array_compact(F.array(
        F.when(F.coalesce("source", F.lit("")).eqNullSafe("") | F.coalesce("target", F.lit("")).eqNullSafe(""), "edge end missing"),
        F.when(F.col("source") == F.col("target"), "edge is a loop"),
        F.when((F.col("source").isNotNull() & F.col("_s").isNull()) | (F.col("target").isNotNull() & F.col("_t").isNull()), "edge end unknown"),
        F.when(score.isNull(), "edge score missing"),
        F.when(F.isnan(score), "edge score not a number"),
        F.when(~F.isnan(score) & ~score.between(0, 1), "edge score out of range"),
        F.when(~F.col("relation").isin(list(RELATIONS)), "edge relation unknown"),
        F.when(F.col("confidence").isNull() | ~F.col("confidence").isin(list(CONFIDENCES)), "edge confidence unknown"),
    ))
    two = e.select(F.explode(checks).alias("issue"), F.col("seq").cast("string").alias("ref"))
    return one.unionByName(twice).unionByName(two)


def diff(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, directed: bool = True) -> DataFrame:
    """(change, kind, key): nodes and edges (source, target, relation) only one of two graphs has."""

    def keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        a, b = (F.col("source"), F.col("target")) if directed else (F.least("source", "target"), F.greatest("source", "target"))
        e = edges.where("source is not null and target is not null").select(F.lit("edge").alias("kind"), F.concat_ws("|", a, b, F.coalesce("relation", F.lit(""))).alias("key"))
        return nodes.where("id is not null").select(F.lit("node").alias("kind"), F.col("id").alias("key")).unionByName(e).distinct()

    old, new = keys(old_nodes, old_edges), keys(new_nodes, new_edges)
    added = new.join(old, ["kind", "key"], "left_anti").select(F.lit("new").alias("change"), "kind", "key")
    return added.unionByName(old.join(new, ["kind", "key"], "left_anti").select(F.lit("removed").alias("change"), "kind", "key"))


def hyperedges(edges: DataFrame, relation: str = "includes_module", least: int = 3) -> DataFrame:
    """(id, members, member_count): targets that one source includes, as one hyperedge."""
    rows = edges.where((F.col("relation") == relation) & F.col("source").isNotNull() & F.col("target").isNotNull())
    out = rows.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("members"))
    return out.where(F.size("members") >= least).select(F.concat(F.lit("h:"), "source").alias("id"), "members", F.size("members").alias("member_count"))
