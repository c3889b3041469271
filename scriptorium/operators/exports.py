"""Reports and exports: texts made from a graph, written by ordinary sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.pages import fold_accents, sanitise_label
from scriptorium.operators.analytics import bridges, cohesion, degrees, gaps, god_nodes, name_communities, questions, surprising, with_communities
from scriptorium.session import cut, numbered, skew_lookup

# fixed values: scores of edges without one, by confidence
DEFAULT_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}


def file_name(c: Column | str) -> Column:
    """Blanks to underscores, slashes and colons to hyphens."""
    return F.translate(c, "/ :", "-_-")


def note_name(c: Column | str) -> Column:
    """Without characters notes must not have and without a markdown ending; never empty."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r'[\\/*?:"<>|#^\[\]]', ""), r"(?i)\.(md|mdx|markdown)$", ""))
    return F.when(F.coalesce(bare, F.lit("")) == "", "unnamed").otherwise(bare)


def relation_name(c: Column | str) -> Column:
    bare = F.regexp_replace(F.upper(c), "[^A-Z0-9_]", "_")
    return F.when(F.coalesce(bare, F.lit("")) == "", "RELATED_TO").otherwise(bare)


def type_name(c: Column | str) -> Column:
    bare = F.regexp_replace(c, "[^A-Za-z0-9_]", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "Entity").otherwise(bare)


def node_links(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, id, json): the graph as lines of node-link JSON; absent scores get the default of
    their confidence."""
    n = nodes.join(members, "id", "left")
    n = n.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct(
        "id", F.coalesce("label", "id").alias("label"), "file_type", "source_file", "community", F.lower(fold_accents(F.coalesce("label", "id"))).alias("norm_label"))).alias("json"))
    known = F.when(F.isnan("confidence_score"), None).otherwise(F.col("confidence_score"))
    default = F.lit(1.0)
    for k, v in DEFAULT_SCORES.items():
        default = F.when(F.col("confidence") == k, v).otherwise(default)
    e = edges.select(F.lit("link").alias("kind"), F.concat_ws("|", "source", "target").alias("id"), F.to_json(F.struct(
        "source", "target", "relation", "confidence", F.coalesce(known, default).alias("confidence_score"))).alias("json"))
    return n.unionByName(e)


def _quoted(c: Column | str) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): statements that make the graph anew; nodes sort before edges."""
    n = nodes.select(F.concat(F.lit("MERGE (n:"), type_name("file_type"), F.lit(" {id: "), _quoted("id"), F.lit(", label: "), _quoted(sanitise_label(F.coalesce("label", "id"))), F.lit("});")).alias("line"))
    e = edges.select(F.concat(F.lit("MATCH (a {id: "), _quoted("source"), F.lit("}), (b {id: "), _quoted("target"), F.lit("}) MERGE (a)-[:"), relation_name("relation"), F.lit("]->(b);")).alias("line"))
    return n.unionByName(e)


def _xml(c: Column | str) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(ord, line): GraphML elements; nodes without a community have -1."""
    n = nodes.join(members, "id", "left").select(F.lit(1).alias("ord"), F.concat(
        F.lit('<node id="'), _xml("id"), F.lit('"><data key="label">'), _xml(F.coalesce("label", "id")), F.lit('</data><data key="community">'),
        F.coalesce("community", F.lit(-1)).cast("string"), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("ord"), F.concat(
        F.lit('<edge source="'), _xml("source"), F.lit('" target="'), _xml("target"), F.lit('"><data key="relation">'), _xml("relation"), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


def vis_nodes(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(id, label, size, show, community): what a picture of the graph draws; size 10 to 40 by
    degree, labels from 15 % of the largest degree on."""
    d = degrees(nodes, edges)
    top = d.agg(F.max("degree").alias("_m")).first()["_m"] or 1
    return nodes.select("id", sanitise_label(F.coalesce("label", "id")).alias("label")).join(d, "id").join(members, "id", "left").select(
        "id", "label", F.round(F.lit(10) + 30 * F.col("degree") / F.lit(top), 1).alias("size"), (F.col("degree") >= 0.15 * F.lit(top)).alias("show"), "community")


def html(nodes: DataFrame, edges: DataFrame, members: DataFrame, most: int = 5_000) -> str:
    """A page that draws a small graph; more than ``most`` nodes, or twenty times as many edges, are an error."""
    if nodes.count() > most or edges.count() > most * 20:
        raise ValueError(f"a picture of over {most} nodes or {most * 20} edges can't be read; filter the graph first")
    vis = vis_nodes(nodes, edges, members).toJSON().collect()
    links = edges.select(F.to_json(F.struct("source", "target", "relation", (F.col("confidence") != "EXTRACTED").alias("dashed")))).collect()
    safe = lambda rows: "[" + ",".join(rows).replace("</", "<\\/") + "]"
    return ("<!doctype html><meta charset=utf-8><title>graph</title><canvas id=c width=1200 height=800></canvas><script>const N=" + safe(vis)
            + ",L=" + safe([r[0] for r in links]) + """;const p={},x=document.getElementById('c').getContext('2d');
N.forEach((n,i)=>{const r=350*Math.sqrt((i+1)/N.length),t=i*2.4;p[n.id]=[600+r*Math.cos(t),400+r*Math.sin(t)]});
L.forEach(e=>{if(p[e.source]&&p[e.target]){x.setLineDash(e.dashed?[4,4]:[]);x.beginPath();x.moveTo(...p[e.source]);x.lineTo(...p[e.target]);x.stroke()}});
N.forEach(n=>{x.beginPath();x.arc(...p[n.id],n.size/4,0,7);x.fill();if(n.show)x.fillText(n.label,...p[n.id])});</script>""")


def notes(nodes: DataFrame, edges: DataFrame, members: DataFrame, links: int = 1_000) -> DataFrame:
    """(file, part, body): a note for each node: type, community, commonest confidence of its
    edges (ties: plain order), and all its targets by name. Notes of one name get a number.
    Part 0 holds the head and the first ``links`` targets, each further part as many more, so
    that no cell grows with a hub; the parts of a file in order, one a line, are the note."""
    name = note_name(F.coalesce("label", "id"))
    named = numbered(nodes.select("id", "file_type", name.alias("_n")).withColumn("_l", F.lower("_n")), ["_l", "id"], "_i")
    named = skew_lookup(named, named.groupBy("_l").agg(F.min("_i").alias("_f")), "_l").withColumn("_k", F.col("_i") - F.col("_f"))
    named = cut(named.select("id", "file_type", F.when(F.col("_k") > 0, F.concat_ws("_", "_n", "_k")).otherwise(F.col("_n")).alias("name")))
    conf = edges.groupBy(F.col("source").alias("id"), F.coalesce("confidence", F.lit("EXTRACTED")).alias("c")).agg(F.count("*").alias("n"))
    conf = conf.groupBy("id").agg(F.min_by("c", F.struct(F.negative("n"), "c")).alias("confidence"))
    out = skew_lookup(edges.select(F.col("source").alias("id"), F.col("target").alias("t")), named.select(F.col("id").alias("t"), "name"), "t")
    out = numbered(out, ["id", "name", "t"], "_i")
    out = skew_lookup(out, out.groupBy("id").agg(F.min("_i").alias("_f")), "id")
    out = out.withColumn("part", F.floor((F.col("_i") - F.col("_f")) / links).cast("int")).groupBy("id", "part").agg(F.array_sort(F.collect_list("name")).alias("links"))
    first, more = out.where("part = 0").drop("part"), out.where("part > 0")
    rows = named.join(conf, "id", "left").join(first, "id", "left").join(members, "id", "left")
    text = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    body = F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.concat(F.lit("type: "), F.coalesce("file_type", F.lit(""))), F.concat(F.lit("community: "), F.coalesce(F.col("community").cast("string"), F.lit(""))),
                       F.concat(F.lit("confidence: "), F.coalesce("confidence", F.lit("EXTRACTED"))), text)
    file = F.concat("name", F.lit(".md")).alias("file")
    return rows.select(file, F.lit(0).alias("part"), body.alias("body")).unionByName(more.join(named, "id").select(file, "part", text.alias("body")))


def canvas(members: DataFrame, width: int = 220, height: int = 60) -> DataFrame:
    """(community, x, y, width, height): a grid of groups, as many columns as the root of
    their number; a group holds three cards a row."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    k = sizes.count()  # one row a community
    columns = max(1, int(-(-(k**0.5) // 1)))
    rows = numbered(sizes, ["community"], "_n").withColumn("_i", F.col("_n") - 1)
    h = (F.ceil(F.col("n") / 3) * (height + 20) + 60).cast("int")
    w = (F.least("n", F.lit(3)) * (width + 20) + 20).cast("int")
    rows = rows.select("community", (F.col("_i") % columns).alias("_c"), F.floor(F.col("_i") / columns).alias("_r"), w.alias("width"), h.alias("height"))
    wide = rows.groupBy("_c").agg(F.max("width").alias("_w"))
    high = rows.groupBy("_r").agg(F.max("height").alias("_h"))
    before = lambda key, v: F.coalesce(F.sum(F.col(v) + 40).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    xs = wide.select("_c", before("_c", "_w").alias("x"))
    ys = high.select("_r", before("_r", "_h").alias("y"))
    return rows.join(F.broadcast(xs), "_c").join(F.broadcast(ys), "_r").select("community", "x", "y", "width", "height")


def summary_lines(nodes: DataFrame, edges: DataFrame, members: DataFrame, dense: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(ord, line): the short report: counts, share of each confidence, most linked nodes, communities,
    surprises. ``dense`` and ``found`` are ``cohesion`` and ``surprising`` where they are at hand."""
    n, e = nodes.agg(F.count("*").alias("v")), edges.agg(F.count("*").alias("v"))
    c = members.agg(F.countDistinct("community").alias("v"))
    line = lambda df, ord_, text: df.select(F.lit(ord_).alias("ord"), F.lit(0).alias("sub"), F.format_string(text, "v").alias("line"))
    out = line(n, 1, "nodes: %d").unionByName(line(e, 2, "edges: %d")).unionByName(line(c, 3, "communities: %d"))
    total = edges.count() or 1
    share = edges.groupBy(F.coalesce("confidence", F.lit("EXTRACTED")).alias("k")).agg(F.count("*").alias("v"))
    share = share.select(F.lit(4).alias("ord"), F.row_number().over(Window.orderBy("k")).alias("sub"), F.format_string("%s: %.1f%%", "k", F.col("v") * 100 / F.lit(total)).alias("line"))
    gods = god_nodes(nodes, edges)
    gods = gods.select(F.lit(5).alias("ord"), F.row_number().over(Window.orderBy(F.desc("degree"), "id")).alias("sub"), F.format_string("god: %s (%d)", "label", "degree").alias("line"))
    comm = (cohesion(members, edges) if dense is None else dense).select(F.lit(6).alias("ord"), (F.col("community") + 1).cast("int").alias("sub"), F.format_string("community %d: %d members, cohesion %.2f", "community", "members", "cohesion").alias("line"))
    s = surprising(nodes, edges, members) if found is None else found
    s = s.select(F.lit(7).alias("ord"), F.row_number().over(Window.orderBy(F.desc("score"), "source", "target")).alias("sub"), F.format_string("surprise: %s -> %s (%d)", "source_label", "target_label", "score").alias("line"))
    return out.unionByName(share).unionByName(gods).unionByName(comm).unionByName(s)


def community_pages(nodes: DataFrame, edges: DataFrame, members: DataFrame, top: int = 25, links: int = 12, files: int = 20) -> DataFrame:
    """(file, body): the page of each community: its size and cohesion, its best linked nodes
    and how many more there are, the communities it is linked to by number of edges, its
    source files in plain order, and the share of each confidence among its nodes' edges.

    The limits are those of the page; each is applied as a rank before the rows of a
    community meet, so none is gathered whole."""
    names = name_communities(nodes, edges, members)
    rows = members.join(nodes.select("id", F.coalesce("label", "id").alias("label"), F.coalesce("source_file", F.lit("")).alias("file")), "id").join(degrees(nodes, edges), "id")
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    line = F.concat(F.format_string("- **%s** (%d connections)", "label", "degree"), F.when(F.col("file") != "", F.concat(F.lit(" — `"), "file", F.lit("`"))).otherwise(""))
    best = rows.withColumn("_r", rank).where(F.col("_r") <= top).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("line")))).alias("best"))
    cu, cv = members.select(F.col("id").alias("source"), F.col("community").alias("cu")), members.select(F.col("id").alias("target"), F.col("community").alias("cv"))
    ends = cut(skew_lookup(skew_lookup(edges.select("source", "target", F.coalesce("confidence", F.lit("EXTRACTED")).alias("c")), cu, "source"), cv, "target").groupBy("cu", "cv", "c").agg(F.count("*").alias("n")))
    across = ends.where("cu <> cv").groupBy(F.col("cu").alias("community"), F.col("cv").alias("other")).agg(F.sum("n").alias("n"))
    across = across.join(names.select(F.col("community").alias("other"), F.col("name").alias("other_name")), "other")
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "other"))
    across = across.withColumn("_r", rank).where(F.col("_r") <= links).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("_r", F.format_string("- [[%s]] (%d shared connections)", "other_name", "n").alias("line")))).alias("across"))
    filed = rows.where("file <> ''").select("community", "file").distinct()
    rank = F.row_number().over(Window.partitionBy("community").orderBy("file"))
    filed = filed.withColumn("_r", rank).where(F.col("_r") <= files).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("_r", F.format_string("- `%s`", "file").alias("line")))).alias("files"))
    conf = ends.groupBy(F.col("cu").alias("community")).agg(F.sum("n").alias("_all"), *[F.sum(F.when(F.col("c") == k, F.col("n")).otherwise(0)).alias(k) for k in DEFAULT_SCORES])
    page = names.join(cohesion(members, edges), "community")
    for part in (best, across, filed, conf):
        page = page.join(part, "community", "left")
    lines_ = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    share = [F.format_string(f"- {k}: %d (%d%%)", F.coalesce(F.col(k), F.lit(0)), F.round(100 * F.coalesce(F.col(k), F.lit(0)) / F.greatest(F.coalesce("_all", F.lit(0)), F.lit(1))).cast("int")) for k in DEFAULT_SCORES]
    body = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), "name"), F.format_string("> %d nodes · cohesion %.2f", "members", "cohesion"), F.lit("## Key concepts"), lines_("best"),
        F.when(F.col("members") > top, F.format_string("- *and %d more nodes*", F.col("members") - top)), F.lit("## Relationships"),
        F.coalesce(lines_("across"), F.lit("- No links to other communities")), F.when(F.size("files") > 0, F.concat(F.lit("## Source files\n\n"), lines_("files"))),
        F.lit("## Audit trail"), F.concat_ws("\n", *share), F.lit("---\n\n*See [[index]] for all communities.*"))
    return page.select(F.concat(file_name("name"), F.lit(".md")).alias("file"), body.alias("body"))


def community_notes(nodes: DataFrame, edges: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """(file, body): a note for each community: its tag, size and cohesion, its ``top`` nodes with
    targets in most other communities, and the number of edges to each other community."""
    names = name_communities(nodes, edges, members)
    best = bridges(nodes, edges, members, top).groupBy("community").agg(F.array_sort(F.collect_list(F.struct(F.negative("connected").alias("c"), "id", "label"))).alias("best"))
    cu, cv = members.select(F.col("id").alias("source"), F.col("community").alias("cu")), members.select(F.col("id").alias("target"), F.col("community").alias("cv"))
    across = skew_lookup(skew_lookup(edges.select("source", "target"), cu, "source"), cv, "target").where("cu <> cv").groupBy(F.col("cu").alias("community"), F.col("cv").alias("other")).agg(F.count("*").alias("n"))
    across = across.join(names.select(F.col("community").alias("other"), F.col("name").alias("on")), "other")
    across = across.groupBy("community").agg(F.array_sort(F.collect_list(F.struct(F.negative("n").alias("n"), "other", "on"))).alias("across"))  # one entry a community
    page = names.join(cohesion(members, edges), "community").join(best, "community", "left").join(across, "community", "left")
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), "name"), F.format_string("tags: community-%d", "community"), F.format_string("members: %d", "members"), F.format_string("cohesion: %.2f", "cohesion"),
        F.array_join(F.transform("best", lambda x: F.concat(F.lit("- bridge: [["), note_name(x["label"]), F.lit("]]"))), "\n"),
        F.array_join(F.transform("across", lambda x: F.concat(F.lit("- to [["), note_name(x["on"]), F.lit("]]: "), (-x["n"]).cast("string"))), "\n"))
    return page.select(F.concat(F.lit("_COMMUNITY_"), note_name("name"), F.lit(".md")).alias("file"), body.alias("body"))


def canvas_cards(nodes: DataFrame, members: DataFrame, width: int = 220, height: int = 60) -> DataFrame:
    """(id, file, community, x, y): the cards of the groups of ``canvas``, three a row, by label.
    Cards are numbered by ranges over all nodes, not within a community."""
    labelled = members.join(nodes.select("id", F.coalesce("label", "id").alias("l")), "id")
    rows = numbered(labelled, ["community", "l", "id"], "_n")
    first = rows.groupBy("community").agg(F.min("_n").alias("_f"))
    rows = skew_lookup(rows, first, "community").withColumn("_i", F.col("_n") - F.col("_f"))
    rows = skew_lookup(rows, canvas(members, width, height).select("community", "x", "y"), "community")
    return rows.select("id", F.concat(note_name("l"), F.lit(".md")).alias("file"), "community",
                       (F.col("x") + 20 + (F.col("_i") % 3) * (width + 20)).cast("int").alias("x"), (F.col("y") + 40 + F.floor(F.col("_i") / 3) * (height + 20)).cast("int").alias("y"))


def full_lines(nodes: DataFrame, edges: DataFrame, members: DataFrame, hyper: DataFrame | None = None, shown: int = 8) -> DataFrame:
    """(ord, sub, line): the full report: the summary, then surprises with their reasons,
    hyperedges, each community with its first ``shown`` members and its bridges, gaps and
    suggested questions."""
    # what several parts of the report use is made once
    nodes = cut(nodes.join(degrees(nodes, edges), "id"))
    placed = cut(with_communities(edges.select("source", "target"), members))
    dense, names, s = cut(cohesion(members, placed)), cut(name_communities(nodes, edges, members)), cut(surprising(nodes, edges, members, reasons=True))
    out = summary_lines(nodes, edges, members, dense, s)
    order = F.row_number().over(Window.orderBy(F.desc("score"), "source", "target"))  # five rows
    out = out.unionByName(s.select(F.lit(8).alias("ord"), order.alias("sub"), F.format_string("- `%s` --%s--> `%s` [%s] (score %d: %s)", "source_label", F.coalesce("relation", F.lit("")), "target_label", "confidence", "score", F.array_join("reasons", ", ")).alias("line")))
    if hyper is not None:
        ranked = numbered(hyper.select("id", "members"), ["id"], "_n")
        out = out.unionByName(ranked.select(F.lit(9).alias("ord"), F.col("_n").cast("int").alias("sub"), F.format_string("- **%s** — %s", "id", F.array_join("members", ", ")).alias("line")))
    labelled = members.join(nodes.select("id", F.coalesce("label", "id").alias("l")), "id")
    rank = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    some = labelled.withColumn("_r", rank).where(F.col("_r") <= shown).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("_r", "l"))).alias("x"))
    page = names.join(dense, "community").join(some, "community")
    more = F.when(F.col("members") > shown, F.format_string(" (+%d more)", F.col("members") - shown)).otherwise("")
    text = F.concat(F.format_string("### %s: cohesion %.2f, %d members: ", "name", "cohesion", "members"), F.array_join(F.transform("x", lambda y: y["l"]), ", "), more)
    out = out.unionByName(page.select(F.lit(10).alias("ord"), (4 * F.col("community")).cast("int").alias("sub"), text.alias("line")))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("connected"), "id"))  # three rows each
    out = out.unionByName(bridges(nodes, placed, members).select(F.lit(10).alias("ord"), (4 * F.col("community") + rank).cast("int").alias("sub"), F.format_string("  bridge: `%s` (%d communities)", "label", "connected").alias("line")))
    g = gaps(nodes, edges, members)
    lone = g.where("gap = 'isolated'").agg(F.count("*").alias("n")).where("n > 0")
    lone = lone.select(F.lit(11).alias("ord"), F.lit(1).alias("sub"), F.format_string("- %d isolated nodes", "n").alias("line"))
    thin = g.where("gap = 'thin community'").select(F.lit(11).alias("ord"), (F.expr("try_cast(ref as int)") + 2).alias("sub"), F.format_string("- thin community %s (%d nodes)", "ref", F.col("n").cast("int")).alias("line"))
    vague = g.where("gap = 'ambiguous percent' and n > 20").select(F.lit(12).alias("ord"), F.lit(1).alias("sub"), F.format_string("- %.1f%% of the edges are uncertain", "n").alias("line"))
    q = questions(nodes, edges, members, names=names, dense=dense).where("question is not null").select(F.lit(13).alias("ord"), F.col("ord").alias("sub"), F.concat_ws(" ", F.concat(F.lit("- **"), "question", F.lit("**")), "why").alias("line"))
    for part in (lone, thin, vague, q):
        out = out.unionByName(part)
    return out


def bridge_lines(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, line) of the full report."""
    return bridges(nodes, edges, members).select("community", F.format_string("%s: %d communities", "label", "connected").alias("line"))


def write_files(pages: DataFrame, folder: str) -> None:
    """(file, body) rows as JSON lines, in parallel; one row a file."""
    pages.select("file", "body").write.mode("overwrite").json(folder)


def god_pages(nodes: DataFrame, edges: DataFrame, top: int = 10, each: int = 20) -> DataFrame:
    """(file, body): the page of each of the most linked nodes: neighbours by relation, the
    most linked first, ``each`` a relation."""
    gods = god_nodes(nodes, edges, top)
    d = degrees(nodes, edges)
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "relation").union(edges.select("target", "source", "relation"))
    near = ends.join(F.broadcast(gods.select("id")), "id", "left_semi").where("id <> other").distinct()  # top rows
    near = near.join(nodes.select(F.col("id").alias("other"), F.coalesce("label", "id").alias("l")), "other").join(d.select(F.col("id").alias("other"), F.col("degree").alias("n")), "other")
    rank = F.row_number().over(Window.partitionBy("id", "relation").orderBy(F.desc("n"), "other"))
    near = near.withColumn("_r", rank).where(F.col("_r") <= each)
    parts = near.groupBy("id", F.coalesce("relation", F.lit("")).alias("relation")).agg(F.array_sort(F.collect_list(F.struct("_r", "l"))).alias("x"))
    text = F.concat(F.lit("## "), "relation", F.lit("\n\n"), F.array_join(F.transform("x", lambda x: F.concat(F.lit("- [["), x["l"], F.lit("]]"))), "\n"))
    parts = parts.groupBy("id").agg(F.array_sort(F.collect_list(text)).alias("parts"))
    page = gods.join(parts, "id", "left")
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), "label"), F.format_string("links: %d", "degree"), F.array_join(F.coalesce("parts", F.array().cast("array<string>")), "\n\n"))
    return page.select(F.concat(file_name("label"), F.lit(".md")).alias("file"), body.alias("body"))


def index_lines(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(ord, sub, line) of the index page: communities by size, then the most linked nodes."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n")).join(name_communities(nodes, edges, members), "community")
    sizes = numbered(sizes, [F.desc("n"), "community"], "_i")
    a = sizes.select(F.lit(1).alias("ord"), F.col("_i").cast("int").alias("sub"), F.format_string("- [[%s]] (%d)", "name", "n").alias("line"))
    gods = god_nodes(nodes, edges)
    return a.unionByName(gods.select(F.lit(2).alias("ord"), F.row_number().over(Window.orderBy(F.desc("degree"), "id")).alias("sub"), F.format_string("- [[%s]] (%d)", "label", "degree").alias("line")))


def canvas_edges(edges: DataFrame, top: int = 200) -> DataFrame:
    """(source, target, relation, weight): the heaviest edges of the canvas, ties by arrival."""
    weight = F.coalesce(F.when(~F.isnan("confidence_score"), F.col("confidence_score")), F.lit(0.0))
    return edges.select("source", "target", "relation", weight.alias("weight"), "seq").orderBy(F.desc("weight"), "seq", "source", "target").limit(top).drop("seq")


def wiki_index(index: DataFrame) -> DataFrame:
    """(ord, line) of the wiki's index: the number of concepts, then a link to each."""
    n = index.agg(F.count("*").alias("n")).select(F.lit("").alias("ord"), F.format_string("concepts: %d", "n").alias("line"))
    return n.unionByName(index.select(F.col("name").alias("ord"), F.concat(F.lit("- [["), "name", F.lit("]]")).alias("line")))


def append_article(body: Column | str, title: Column | str) -> Column:
    """A concept page with a link to one more article; unchanged where it names it already."""
    b, t = F.col(body) if isinstance(body, str) else body, F.col(title) if isinstance(title, str) else title
    return F.when(F.contains(b, t), b).otherwise(F.concat(b, F.lit("\n- [["), t, F.lit("]]")))
