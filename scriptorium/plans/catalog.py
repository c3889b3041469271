"""All queries of the engine over the test tables and, where SQL can express them, their SQL.

A query takes (spark, folder of tables) and covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import pages, paths
from scriptorium.operators import analytics, backfill, compiling, concepts, exports, graph, ingest, logs, louvain, retrieval, structure, verify, writing
from scriptorium.session import cut, table
from scriptorium.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def over_groups(sql: str, pairs: bool = False):
    """A query over the communities, and, under the name with ``_groups``, the same over given
    groups, which have SQL; SQL can't say the communities. ``pairs``: the query looks at no more of
    an edge than its ends."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(*_settled(spark, d, pairs))
        QUERIES[f.__name__ + "_groups"] = lambda spark, d: f(*_grouped(spark, d))
        SQL[f.__name__ + "_groups"] = sql
        return f

    return add


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- parts of SQL that several queries share

# the graph: first delivery of each node, last edge of each pair
NODES = """n as (select id, label, file_type, source_file from (
    select *, row_number() over (partition by id order by coalesce(label, '') = '', label nulls first, file_type nulls first, source_file nulls first) as k
    from nodes where id is not null and id <> '') where k = 1)"""
EDGES = """e as (select source, target, relation, confidence, case when not isnan(confidence_score) then confidence_score end as confidence_score, seq from (
    select *, row_number() over (partition by source, target order by seq desc, coalesce(relation, '') desc) as k
    from edges where source in (select id from n) and target in (select id from n)) where k = 1)"""
DEG = """deg as (select n.id, count(x.id) as degree from n left join (select source as id from e union all select target from e) x using (id) group by n.id)"""
GRAPH = f"{NODES}, {EDGES}, {DEG}"
# groups that SQL can follow: nodes of one type whose labels begin alike
MEMBERS = """k0 as (select id, coalesce(file_type, '') || '|' || coalesce(substr(label, 1, 2), '') as label from n),
sz as (select label, row_number() over (order by count(*) desc, min(id)) - 1 as community from k0 group by label),
m as (select id, community from k0 join sz using (label))"""


_LEVEL = "lv{k} as (select name, min(community) as community from (select community, array_to_string(labels[1:{k}], ' / ') as name from lf{p} where len(labels) >= {k}) group by name), lf{k} as (select * from lf{p} where community not in (select community from lv{k}))"
NAMES = """p as (select m.community, n.label, n.file_type, row_number() over (partition by m.community order by case when file_type = 'concept' then 0 else 1 end, degree desc, n.id) as r from m join n using (id) join deg using (id) where label <> ''),
p4 as (select *, max(cast(file_type = 'concept' as int)) over (partition by community) as conc from p where r <= 4),
lf0 as (select community, list(label order by r) as labels from p4 where coalesce(conc, 0) = 0 or file_type = 'concept' group by community), """ + ", ".join(_LEVEL.format(k=k, p=k - 1) for k in range(1, 5)) + """,
nm as (select c.community, coalesce(f.name, '社区' || c.community) as name, c.n from (select community, count(*) as n from m group by 1) c
    left join (""" + " union all ".join(f"from lv{k}" for k in range(1, 5)) + ") f using (community))"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.build(table(spark, d, "nodes"), table(spark, d, "edges"))


def _grouped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph and given groups of its nodes, for queries that have SQL over them."""
    n, e = _graph(spark, d)
    e = cut(e)
    labels = n.select("id", F.concat_ws("|", F.coalesce("file_type", F.lit("")), F.coalesce(F.substring("label", 1, 2), F.lit(""))).alias("label"))
    return n, e, cut(analytics.number(labels))


def _settled(spark: SparkSession, d: str, pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph and its communities by the whole rule; ``pairs``: of its edges only their ends."""
    n, e = graph.build(table(spark, d, "nodes"), table(spark, d, "edges").select("source", "target")) if pairs else _graph(spark, d)
    e = cut(e)
    return n, e, cut(louvain.clusters(n, e))


# ---- sources and scans

ENDING = r"lower(regexp_extract(regexp_extract(original_filename, '([^/\\]*)$', 1), '[^.].*(\.[^.]+)$', 1))"
FILE_CLASS = f"""case {' '.join(f"when {ENDING} in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in paths.ENDINGS.items())} end"""


@query(f"select upload_id, {FILE_CLASS} as file_type, case when original_filename is null then 'unsupported' when regexp_matches(original_filename, '(?i)(credential|secret|passwd|password|token|private_key)') then 'sensitive' when {FILE_CLASS} is null then 'unsupported' else 'taken' end as status from (select distinct upload_id, original_filename from source_map)")
def scan_classify(spark, d):
    """Class and status of every upload by its path."""
    files = table(spark, d, "source_map").select("upload_id", F.col("original_filename").alias("path")).distinct()
    return ingest.classify(files).select("upload_id", "file_type", "status")


@query(f"""select {FILE_CLASS} as file_type, count(*) as files from (select distinct upload_id, original_filename from source_map) group by 1""")
def scan_file_types(spark, d):
    """Files of each class."""
    files = table(spark, d, "source_map").select("upload_id", "original_filename").distinct()
    return files.groupBy(paths.file_class("original_filename").alias("file_type")).agg(F.count("*").alias("files"))


@query("select doc_id, sha256(text) as sha256, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as words from documents where text is not null")
def scan_hash_words(spark, d):
    """Content hash and word count of every document."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), pages.words_of("text").alias("words"))


@query("select doc_id, " + " + ".join(f"cast(regexp_matches(substr(text, 1, 3000), '{p}') as int)" for p in paths.PAPER_SIGNALS) + " as signals from documents where text is not null")
def scan_paper_signals(spark, d):
    """Signs of an academic paper at the start of every document."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", paths.paper_signals("text").alias("signals"))


@query("""with a as (select original_filename as path, max(uploaded_at) as t from source_map where original_filename is not null group by 1),
b as (select original_filename as path, max(uploaded_at) as t from source_map where original_filename is not null and batch_id = 0 group by 1)
select path, case when a.path is null then 'deleted' when b.path is null or b.t is null or a.t > b.t then 'new' else 'unchanged' end as change from a full join b using (path)""")
def scan_incremental(spark, d):
    """Files that are new against the manifest of the first batch."""
    rows = table(spark, d, "source_map").where("original_filename is not null").withColumnRenamed("original_filename", "path")
    now = rows.groupBy("path").agg(F.max("uploaded_at").alias("modified"))
    before = rows.where("batch_id = 0").groupBy("path").agg(F.max("uploaded_at").alias("modified"))
    return ingest.changes(now, before)


# ---- structure

LINES = r"""ls as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null),
s as (select *, regexp_replace(raw, '^\s+|\s+$', '', 'g') as s from ls)"""


@query(f"""with {LINES} select doc_id, line, length(regexp_extract(s, '^(#+)', 1)) as level,
regexp_replace(substr(s, length(regexp_extract(s, '^(#+)', 1)) + 1), '^\\s+|\\s+$', '', 'g') as title from s where s like '#%'
and length(regexp_extract(s, '^(#+)', 1)) between 1 and 6 and regexp_replace(substr(s, length(regexp_extract(s, '^(#+)', 1)) + 1), '^\\s+|\\s+$', '', 'g') <> ''""")
def structure_headings(spark, d):
    return structure.headings(table(spark, d, "documents"))


@query(f"""with {LINES}, p as (select *, s like '|%' as pipe, lead(s) over (partition by doc_id order by line) as nxt from s),
i as (select *, sum(cast(not pipe as int)) over (partition by doc_id order by line) as island from p),
h as (select doc_id, island, min(case when nxt like '|%' and contains(nxt, '---') then line end) as line, max(line) as last from i where pipe group by 1, 2)
select h.doc_id, h.line, list_filter(list_transform(string_split(i.s, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as columns, last - h.line - 1 as rows
from h join i on i.doc_id = h.doc_id and i.line = h.line where h.line is not null""")
def structure_tables(spark, d):
    return structure.tables(table(spark, d, "documents"))


@query(f"""with {LINES}, k as (select *, case when regexp_matches(s, '^[-*]\\s+\\S') then 'unordered' when regexp_matches(s, '^\\d+\\.\\s+\\S') then 'ordered' else 'other' end as type from s where s <> ''),
i as (select *, row_number() over (partition by doc_id order by line) - row_number() over (partition by doc_id, type order by line) as island from k)
select doc_id, type, min(line) as line, count(*) as items, cast(max(case when type = 'unordered' then length(regexp_extract(raw, '^(\\s*)', 1)) // 2 + 1 else 1 end) as int) as depth
from i where type <> 'other' group by doc_id, type, island""")
def structure_lists(spark, d):
    return structure.lists(table(spark, d, "documents"))


@query(f"""with {LINES}, v as (select doc_id, line, unnest(list_concat({', '.join(f"regexp_extract_all(raw, '{p}', 0)" for p in structure.METRICS)})) as v from s)
select doc_id, regexp_replace(v, '^\\s+|\\s+$', '', 'g') as value, min(line) as line from v group by 1, 2""")
def structure_metrics(spark, d):
    return structure.metrics(table(spark, d, "documents"))


@query(r"""with t as (""" + " union all ".join(
    f"select doc_id, {c} as channel, unnest(x) as term, generate_subscripts(x, 1) - 1 as pos from (select doc_id, regexp_extract_all(text, '{p}', 0) as x from documents)"
    for c, p in enumerate(structure.TERM_PATTERNS)) + rf"""), g as (select doc_id, term, count(*) as n, min(channel * 1000000 + pos) as f from t
where not (channel = 0 and regexp_full_match(term, '[{structure.TERM_STOP}]+')) and not (channel = 2 and term in {structure.NO_TERMS}) group by 1, 2)
select doc_id, term, n from (select *, row_number() over (partition by doc_id order by n desc, f) as r from g) where r <= 30 and n >= 2""")
def structure_key_terms(spark, d):
    return structure.key_terms(table(spark, d, "documents"))


def _count(name: str, out: str) -> str:
    return f"(select doc_id, count(*) as {out} from ({SQL[name]}) group by 1)"


@query(f"""select d.doc_id, {', '.join(f'coalesce({x}, 0) as {x}' for x in ('headings', 'tables', 'lists', 'metrics', 'key_terms'))}
from (select distinct doc_id from documents where text is not null) d {' '.join(f'left join {_count("structure_" + x, x)} using (doc_id)' for x in ('headings', 'tables', 'lists', 'metrics', 'key_terms'))}""")
def structure_nested(spark, d):
    """How much of each kind the nested structure of a document holds."""
    parts = ("headings", "tables", "lists", "metrics", "key_terms")
    return structure.structure(table(spark, d, "documents")).select("doc_id", *[F.coalesce(F.size(x), F.lit(0)).cast("long").alias(x) for x in parts])


# ---- ingest

STEM = r"regexp_replace(regexp_extract(original_filename, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')"
STEM_OF = lambda c: rf"regexp_replace(regexp_extract({c}, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')"


@query(rf"""with s as (select distinct upload_id, sha256, original_filename, generated_pages, batch_id from source_map), known as (select sha256, max(coalesce(len(generated_pages) > 0, false)) as done from s where batch_id = 0 and sha256 is not null group by 1),
stems as (select {STEM} as stem, min(sha256) as lo, max(sha256) as hi from s where batch_id = 0 and sha256 is not null and original_filename is not null group by 1),
c as (select sha256, max(length(content_md)) as chars from structure group by 1),
f as (select s.upload_id, s.sha256, s.original_filename, {STEM} as stem, c.chars from s left join c using (sha256) where batch_id > 0),
r as (select f.*, k.done, lo, hi, row_number() over (partition by f.sha256 order by original_filename nulls first, upload_id) > 1 as same,
lag(f.sha256) over (partition by f.stem order by original_filename nulls first, upload_id) as earlier from f left join known k using (sha256) left join stems using (stem)),
o as (select *, case when earlier is not null and earlier <> sha256 then earlier when lo <> sha256 then lo when hi <> sha256 then hi end as other from r),
p as (select *, case when sha256 is null or original_filename is null then 'failed' when coalesce(done, false) or same then 'skipped' when coalesce(chars, 0) < 50 then 'failed' when other is not null then 'updated' else 'new' end as status from o)
select upload_id, sha256, stem, status, case when status = 'updated' then other end as replaces from p""")
def ingest_classify(spark, d):
    """Uploads after the first batch against the first."""
    s = table(spark, d, "source_map").select("upload_id", "sha256", "original_filename", "generated_pages", "batch_id").distinct()
    chars = table(spark, d, "structure").groupBy("sha256").agg(F.max(F.length("content_md")).alias("chars"))
    return ingest.ingest(s.where("batch_id > 0").join(chars, "sha256", "left"), s.where("batch_id = 0"))


@query("select sha256, original_filename, upload_id from (select *, row_number() over (partition by sha256 order by upload_id desc) as k from (select distinct sha256, original_filename, upload_id from source_map)) where k = 1")
def ingest_upsert(spark, d):
    """The latest row of each hash."""
    s = table(spark, d, "source_map").select("sha256", "original_filename", "upload_id", "batch_id").distinct()
    return ingest.upsert(s.where("batch_id = 0").drop("batch_id"), s.where("batch_id > 0").drop("batch_id"), "sha256", "upload_id")


@query(f"select {STEM} as stem, list_sort(list(distinct sha256)) as shas from source_map where sha256 is not null and {STEM} <> '' group by 1")
def ingest_stem_index(spark, d):
    return ingest.stem_index(table(spark, d, "source_map"))


@query("select distinct upload_id, original_filename from source_map where contains(lower(original_filename), 'handbook')")
def ingest_find(spark, d):
    return ingest.find_records(table(spark, d, "source_map"), "Handbook").select("upload_id", "original_filename").distinct()


@query(f"""with q as (select distinct original_filename as path, lower({STEM}) as stem from source_map where batch_id > 0 and lower({STEM}) <> '')
select distinct path, s.original_filename from q join (select distinct original_filename from source_map where batch_id = 0) s on contains(lower(s.original_filename), q.stem)""")
def ingest_conflicts(spark, d):
    """Files after the first batch whose stem a name of the first contains."""
    s = table(spark, d, "source_map")
    return ingest.conflicts(s.where("batch_id > 0").select(F.col("original_filename").alias("path")), s.where("batch_id = 0"))


@query(r"select doc_id, sha256(regexp_replace(text, '(?s)\A---.*?\n---', '') || coalesce(stem, '')) as cache_key from documents where text is not null")
def ingest_cache_keys(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", ingest.cache_key("text", "stem").alias("cache_key"))


@query("""with s as (select distinct upload_id, sha256, raw_path, original_filename from source_map),
h as (select sha256, max(length(trim(coalesce(content_md, '')))) as c from structure where sha256 is not null group by 1), j as (select s.*, c from s left join h using (sha256))
select x.check, upload_id as ref from (select 'hash missing' as check, upload_id from j where sha256 is null
union all select 'hash malformed', upload_id from j where not regexp_matches(sha256, '^[0-9a-f]{64}$') union all select 'raw path missing', upload_id from j where raw_path is null or trim(raw_path) = ''
union all select 'file name missing', upload_id from j where original_filename is null union all select 'content missing', upload_id from j where c is null
union all select 'content too short', upload_id from j where c < 50) x""")
def ingest_verify(spark, d):
    return ingest.verify_ingest(table(spark, d, "source_map"), table(spark, d, "structure"))


@query("""select article, sha256, raw_path from (select *, row_number() over (partition by article order by sha256 is null, sha256, raw_path nulls first) as k from (select distinct unnest(generated_pages) as article, sha256, raw_path from source_map)) where k = 1""")
def ingest_trace(spark, d):
    """The upload each made page comes from."""
    s = table(spark, d, "source_map")
    return retrieval.trace(s, s.select(F.explode("generated_pages").alias("article")))


@query(rf"""with g as (select distinct sha256 from source_map where batch_id = 1 and sha256 is not null), s as (select * from source_map where sha256 in (select sha256 from g)),
a as (select distinct sha256, unnest(generated_pages) as ref from s), t as (select distinct sha256, {STEM_OF('ref')} as title from a where ref is not null),
k as (select sha256, max(coalesce(len(generated_pages) > 0, false)) as done from s group by 1),
p as (select path, summary as text from concept_pages union all select 'doc_' || doc_id, text from documents)
select sha256, 'article' as kind, ref from a where ref is not null union select sha256, 'archive', raw_path from s where raw_path <> ''
union select sha256, 'task', 'pending/' || sha256[1:8] || '_compile_wiki' from k where not done
union select sha256, 'mention', path from p join t on contains(text, '[[' || title || ']]') where path is not null""")
def ingest_removal(spark, d):
    """The removal plan of the hashes of one batch, over concept pages and texts."""
    s = table(spark, d, "source_map")
    texts = table(spark, d, "concept_pages").select("path", F.col("summary").alias("text")).unionByName(
        table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), "text"))
    return ingest.removal(s, s.where("batch_id = 1"), compiling.tasks(s), texts.where("path is not null"))


@query(f"""with ix as ({SQL['ingest_stem_index']}), q as (select distinct {STEM} as stem, sha256 from source_map where batch_id > 0 and {STEM} <> '')
select stem, sha256, coalesce(list_filter(shas, lambda x: x is distinct from sha256), []) as others from q left join ix using (stem)""")
def ingest_probe(spark, d):
    """Other hashes known under the stem of each later upload."""
    s = table(spark, d, "source_map")
    return ingest.probe(ingest.stem_index(s), s.where("batch_id > 0").select(paths.stem_of("original_filename").alias("stem"), "sha256"))


@query(f"""with c as (select distinct k.status, original_filename, k.sha256, replaces from ({SQL['ingest_classify']}) k join (select distinct upload_id, original_filename from source_map) using (upload_id)),
o as (select list_position({list(ingest.STATUSES)}, status) as ord, concat_ws('  ', '- ' || coalesce(original_filename, ''), 'sha=' || sha256[1:12], 'old=' || replaces[1:12]) as line from c)
select 0 as ord, 0 as sub, concat_ws('  ', {', '.join(f"'{x}=' || count(*) filter (status = '{x}')" for x in ingest.STATUSES)}) as line from c
union all select ord, sub, line from (select *, row_number() over (partition by ord order by line) as sub from o) where sub <= 1000
union all select ord, 1001, '- and ' || (count(*) - 1000) || ' more' from o group by ord having count(*) > 1000""")
def ingest_report(spark, d):
    """The ingest of all later uploads, told."""
    names = table(spark, d, "source_map").select("upload_id", "original_filename").distinct()
    return ingest.report_lines(ingest_classify(spark, d).join(names, "upload_id"))


@query(f"""with s as (select distinct sha256 from source_map where sha256 is not null), t as (select sha256[1:8] || '_x' as task_id, sha256 from structure where sha256 is not null)
select 'structure missing' as "check", sha256 as ref from s where sha256 not in (select sha256 from structure where headings is not null and sha256 is not null)
union select 'task of an unknown source', task_id from t where sha256 not in (from s)""")
def ingest_verify_tasks(spark, d):
    """Hashes without structure, and tasks of unknown hashes (here one for each text)."""
    texts = table(spark, d, "structure")
    tasks = texts.where("sha256 is not null").select(F.concat(F.substring("sha256", 1, 8), F.lit("_x")).alias("task_id"), "sha256")
    return ingest.verify_tasks(table(spark, d, "source_map"), texts, tasks)


@query("""with w as (select len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as words from documents where text is not null)
select count(*) as files, coalesce(sum(words), 0)::bigint as words, coalesce(sum(words), 0) >= 50000 as needs_graph, case when coalesce(sum(words), 0) < 50000 then 'a graph may not be needed' when sum(words) >= 500000 or count(*) >= 200 then 'a large corpus' end as warning from w""")
def scan_advice(spark, d):
    """Whether the corpus is worth a graph."""
    rows = table(spark, d, "documents").where("text is not null").select(F.lit("taken").alias("status"), "text")
    return ingest.graph_advice(rows, pages.words_of("text"))


# ---- compile phase

@query("""select sha256[1:8] || '_compile_wiki' as task_id, sha256, f.raw_path as raw_path, 'pending' as status, f.uploaded_at as enqueued_at from (
select sha256, max(coalesce(len(generated_pages) > 0, false)) as done, arg_min(struct_pack(raw_path := raw_path, uploaded_at := uploaded_at), upload_id) as f from source_map where sha256 is not null group by 1) where not done""")
def compile_tasks(spark, d):
    return compiling.tasks(table(spark, d, "source_map"))


@query("""select task_id, cast(ceil(row_number() over (order by task_id) / 20) as int) as chunk from (select distinct task_id from concepts_index where task_id is not null)""")
def compile_chunks(spark, d):
    return compiling.prepare(table(spark, d, "concepts_index").where("task_id is not null").select("task_id").distinct())


FM = r"""b as (select doc_id, text, regexp_extract(text, '(?s)\A---\n(.*?)\n---(?:\n|\z)', 1) as block from documents where text is not null),
f as (select doc_id, text, regexp_extract(block, '(?m)^title:\s*(.*)$', 1) as t, regexp_extract(block, '(?m)^concepts:\s*\[(.*)\]$', 1) as c, regexp_extract(block, '(?m)^confidence:\s*(.*)$', 1) as conf, block from b)"""


@query(rf"""with {FM} select doc_id, list_filter(list_transform(string_split(c, ','), lambda x: trim(x)), lambda x: x <> '') as concepts, try_cast(nullif(conf, '') as double) as confidence,
case when block <> '' and t <> '' then trim(trim(t), '"') else regexp_extract(text, '(?m)^#[ ]+(.+?)\s*$', 1) end as title from f""")
def compile_frontmatter(spark, d):
    return compiling.articles(table(spark, d, "documents")).select("doc_id", "concepts", "confidence", "title")


_HAS = {k: f"regexp_matches(block, '(?m)^\\s*{k}\\s*:')" for k in (*compiling.ARTICLE_FIELDS, "aliases")}
_VALUE = lambda k: f"trim(trim(regexp_extract(block, '(?m)^{k}:(.*)$', 1)), '\"')"


@query(rf"""with {FM}, g as (select doc_id, block, len(list_filter(list_transform(string_split(c, ','), lambda x: trim(x)), lambda x: x <> '')) as cs,
length(trim(regexp_replace(text, '(?s)\A---.*?\n---', ''), ' ')) as body from f)
""" + " union all ".join(
    [f"select doc_id, 'error' as level, '{k} missing' as issue from g where not {_HAS[k]}" for k in compiling.ARTICLE_FIELDS]
    + [f"select doc_id, 'error', '{k} empty' from g where {_HAS[k]} and {_VALUE(k)} = ''" for k in ("title", "doc_type")]
    + [f"select doc_id, 'error', 'tldr too short' from g where length({_VALUE('tldr')}) < 20", "select doc_id, 'error', 'fewer than three concepts' from g where cs < 3",
       "select doc_id, 'error', 'body too short' from g where body < 500", f"select doc_id, 'warning', 'aliases missing' from g where not {_HAS['aliases']}"]))
def compile_article_issues(spark, d):
    return compiling.article_issues(compiling.articles(table(spark, d, "documents")))


@query(f"""with p as (select distinct page_id, path, name, aliases, concept_kind, summary, confidence from concept_pages)
select page_id, issue from (select page_id, 'name missing' as issue from p where coalesce(trim(name, ' '), '') = '' union select page_id, 'summary missing' from p where coalesce(trim(summary, ' '), '') = ''
union select page_id, 'aliases missing' from p where aliases is null or len(aliases) = 0 union select page_id, 'kind unknown' from p where concept_kind is null or concept_kind not in {compiling.CONCEPT_KINDS}
union select page_id, 'path outside concepts' from p where not coalesce(path like 'concepts/%', false) union select page_id, 'confidence out of range' from p where not isnan(confidence) and (confidence < 0 or confidence > 1))""")
def compile_concept_issues(spark, d):
    return compiling.concept_issues(table(spark, d, "concept_pages"))


@query(rf"""with {FM}, x as (select doc_id, try_cast(nullif(conf, '') as double) as confidence, list_filter(list_transform(string_split(c, ','), lambda x: trim(x)), lambda x: x <> '') as cs from f),
y as (select doc_id, confidence, unnest(case when len(cs) = 0 then [null] else cs end) as c from x), k as (select distinct name from concepts_index),
g as (select doc_id, max(confidence) as conf, count(c) filter (c not in (select name from k where name is not null)) as new_concepts from y group by 1)
select doc_id, new_concepts, case when new_concepts > 0 or coalesce(conf < 0.7, true) then 'review' else 'auto' end as risk from g""")
def compile_risk(spark, d):
    return compiling.risk(compiling.articles(table(spark, d, "documents")), table(spark, d, "concepts_index"))


@query("select source, count(*) as documents, sum(cast(floor(length(text) / 2.5) as bigint)) as tokens from documents where text is not null group by 1")
def compile_costs(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum(compiling.tokens_of("text")).alias("tokens"))


# ---- concept index

REDUCED = """r as (select distinct seq, name, path, aliases, summary, article_count from concepts_index where name is not null),
al as (select name, list_sort(list(distinct a)) as aliases from (select name, unnest(aliases) as a from r) where trim(a, ' ') <> '' group by 1),
red as (select name, arg_max(path, seq) as path, arg_max(summary, seq) filter (trim(summary, ' ') <> '') as summary, sum(coalesce(article_count, 0)) as article_count from r group by 1),
idx as (select name, path, coalesce(al.aliases, []) as aliases, summary, article_count from red left join al using (name))"""
# both sides leave out the reading of lists inside summaries of more than one kind of bracket
ANNOUNCED = r"list_filter(list_transform(regexp_split_to_array(regexp_extract(coalesce(summary, ''), '(?i)[（(]\s*(?:别名|aka|also\s+known\s+as|a\.k\.a\.?)\s*[:：]\s*([^)）]+)[)）]', 1), '[,，、;；]'), lambda x: trim(x)), lambda x: x <> '')"
CANON = f"""w as (select name, unnest({ANNOUNCED}) as a from idx),
ex as (select lower(name) as key, name from idx union all select lower(a), name from (select name, unnest(aliases) as a from idx) where a <> ''),
canon as (select coalesce(x.key, y.key) as key, coalesce(x.name, y.name) as name from (select key, max(name) as name from ex group by 1) x
full join (select lower(a) as key, min(name) as name from w group by 1) y using (key))"""


@query(f"with {REDUCED} select * from idx")
def concepts_reduce(spark, d):
    return concepts.reduce_index(table(spark, d, "concepts_index"))


@query(f"with {REDUCED} select name, case when len(aliases) = 0 then {ANNOUNCED} else aliases end as aliases from idx")
def concepts_backfill_aliases(spark, d):
    return concepts.backfill_aliases(concepts.reduce_index(table(spark, d, "concepts_index"))).select("name", "aliases")


@query(f"with {REDUCED}, {CANON} select key, name from canon")
def concepts_canonical_map(spark, d):
    return concepts.canonical_map(concepts.reduce_index(table(spark, d, "concepts_index")))


@query(f"""with {REDUCED}, names as (select distinct name, lower(n) as n from (select name, unnest(list_append(aliases, name)) as n from idx) where n <> ''),
terms as (select distinct struct_id, lower(t) as t from (select struct_id, unnest(key_terms) as t from structure) where t <> ''),
g as (select struct_id, name, count(distinct t) as score from terms join names on contains(n, t) or contains(t, n) group by 1, 2)
select struct_id, name, score from (select *, row_number() over (partition by struct_id order by score desc, name) as r from g) where r <= 5""")
def concepts_match(spark, d):
    """Concepts related to the key terms of each text."""
    terms = table(spark, d, "structure").select("struct_id", F.explode("key_terms").alias("term"))
    return concepts.match_terms(terms, concepts.reduce_index(table(spark, d, "concepts_index")), "struct_id")


_ITEMS = "list_filter(list_transform(string_split(c, ','), lambda x: trim(x)), lambda x: x <> '')"
_NL = "chr(10)"


@query(rf"""with {FM}, {REDUCED}, t as (select unnest({_ITEMS}) as name, case when block <> '' and t <> '' then trim(trim(t), '"') else regexp_extract(text, '(?m)^#[ ]+(.+?)\s*$', 1) end as title from f),
r2 as (select name, list_sort(list(distinct title)) as related from t where title <> '' and name <> '' group by 1)
select 'concepts/' || substr(trim(regexp_replace(r2.name, '[\\/*?:"<>|]', '', 'g'), ' '), 1, 80) || '.md' as file, r2.name as name, len(related) as articles,
concat_ws({_NL} || {_NL}, concat_ws({_NL}, '---', 'name: ' || r2.name, 'aliases: [' || array_to_string(coalesce(aliases, []), ', ') || ']', 'doc_type: concept', 'concept_kind: other', 'summary: ' || coalesce(summary, ''), '---'),
'# ' || r2.name, coalesce(summary, ''), '## Related articles' || {_NL} || {_NL} || array_to_string(list_transform(related, lambda x: '- [[' || x || ']]'), {_NL})) as body from r2 left join idx on idx.name = r2.name""")
def compile_pages(spark, d):
    """The page of every concept that articles name."""
    return compiling.compiled_pages(compiling.articles(table(spark, d, "documents")), concepts.reduce_index(table(spark, d, "concepts_index")))


# ---- the write step

_SECTIONS = " ".join(f"when '{k}' then {list(v)}" for k, v in writing.SECTIONS.items())


@query(rf"""with {FM} select doc_id, unnest(case {_VALUE('doc_type')} {_SECTIONS} else {list(writing.SECTIONS['solution'])} end) as section from f""")
def compile_sections(spark, d):
    """The headings an article of each text's type has."""
    fm = compiling.articles(table(spark, d, "documents"))
    return fm.select("doc_id", F.explode(writing.sections_of(F.coalesce(F.col("fm")["doc_type"], F.lit("")))).alias("section"))


_Q = lambda k, c: f"'{k}: \"' || coalesce({c}, '') || '\"'"
_L = lambda k, c: f"'{k}: [' || array_to_string(list_transform(coalesce({c}, []), lambda x: '\"' || coalesce(x, '') || '\"'), ', ') || ']'"


@query(f"""select distinct page_id, concat_ws({_NL}, '---', {_Q('title', 'name')}, 'doc_type: solution', {_L('domain', "case when subject_area is null then [null] else [subject_area] end")}, 'topic: []', 'region: ""', 'customer: ""', 'customer_type: ""',
'source_sha256: ""', 'concepts: []', {_L('aliases', 'aliases')}, 'created_at: "2024-01-02"', {_Q('compiled_by', 'compiled_by')}, 'confidence: 0.9', {_Q('tldr', 'summary')}, '---') as head from concept_pages""")
def compile_heads(spark, d):
    """The frontmatter of an article for each page's fields."""
    values = {"title": F.col("name"), "domain": F.array("subject_area"), "aliases": F.col("aliases"), "compiled_by": F.col("compiled_by"), "tldr": F.col("summary")}
    return table(spark, d, "concept_pages").select("page_id", writing.article_head(values, F.lit("2024-01-02").cast("date")).alias("head")).distinct()


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Every text as an agent would deliver it, with the concepts its frontmatter names."""
    rows = compiling.articles(table(spark, d, "documents")).join(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id")
    none, listed = F.lit(None).cast("string"), F.array().cast("array<string>")
    concept = lambda x: F.struct(x.alias("name"), none.alias("summary"), listed.alias("aliases"), listed.alias("domain"), none.alias("concept_kind"),
                                 F.lit(None).cast("array<struct<heading: string, content: string>>").alias("sections"))
    return rows.select(F.concat(F.lit("doc_"), "doc_id").alias("task_id"), F.sha2("text", 256).alias("sha256"), "title", "text", "confidence", F.length("text").cast("long").alias("input_chars"), F.transform("concepts", concept).alias("concepts"))


def _written(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The write step over the contents, as if an agent had delivered each with its key terms as concepts."""
    none, listed = F.lit(None).cast("string"), F.array().cast("array<string>")
    concept = lambda x: F.struct(x.alias("name"), none.alias("summary"), listed.alias("aliases"), listed.alias("domain"), none.alias("concept_kind"),
                                 F.lit(None).cast("array<struct<heading: string, content: string>>").alias("sections"))
    rows = table(spark, d, "structure").select("struct_id", "sha256", "content_md", "key_terms").distinct()
    title = F.concat(F.lit("Text "), "struct_id")
    values = {"title": title, "source_sha256": F.col("sha256"), "concepts": F.col("key_terms"), "compiled_by": F.lit("agent"), "tldr": F.lit("a text delivered with its key terms")}
    text = F.concat_ws("\n\n", writing.article_head(values, F.lit("2024-01-02").cast("date")), "content_md")
    given = rows.select(F.concat(F.lit("text_"), "struct_id").alias("task_id"), "sha256", title.alias("title"), text.alias("text"), F.when(F.col("struct_id") % 2 == 0, 0.9).otherwise(0.6).alias("confidence"),
                        F.length("content_md").cast("long").alias("input_chars"), F.transform("key_terms", concept).alias("concepts"))
    index = concepts.reduce_index(table(spark, d, "concepts_index")).select("name").union(rows.where("struct_id % 3 = 0").select(F.explode("key_terms")))
    pages = table(spark, d, "concept_pages").select("path", F.coalesce("summary", F.lit("")).alias("text"))
    return writing.write(given, index, pages, F.lit("2024-01-02").cast("date"))


GATED = rf"""{FM}, gt as (select 'doc_' || doc_id as task_id, text, block, {_ITEMS} as cs from f),
bad as (select task_id, 'fewer than three concepts' as issue from gt where len(cs) < 3 {''.join(f" union select task_id, '{k} missing' from gt where not {_HAS[k]}" for k in compiling.ARTICLE_FIELDS)}
{''.join(f" union select task_id, '{k} empty' from gt where {_HAS[k]} and {_VALUE(k)} = ''" for k in ('title', 'doc_type'))})"""
# every other text is sure enough; what every third text names is taken for known
GIVEN = r"""dl as (select distinct struct_id, sha256, key_terms, content_md from structure), kn as (select name from concepts_index where name is not null union select unnest(key_terms) from dl where struct_id % 3 = 0),
ok as (select *, 'text_' || struct_id as task_id from dl where len(list_filter(key_terms, lambda x: x <> '')) >= 3),
each as (select task_id, struct_id, sha256, unnest(key_terms) as name, generate_subscripts(key_terms, 1) as pos from ok),
w as (select *, 'concepts/' || regexp_replace(name, '[\\/*?:"<>|]', '', 'g') || '.md' as path from each where name <> '')"""


@query(f"with {GATED} select * from bad")
def compile_write_issues(spark, d):
    """Why deliveries are not written."""
    return writing.gate(_deliveries(spark, d))


@query(f"""with {GIVEN}, nw as (select task_id, max(sha256) as sha256, max(struct_id) as struct_id, count(*) filter (name not in (from kn where name is not null)) as k from w group by 1)
select task_id, sha256, case when k > 0 or struct_id % 2 <> 0 then 'review' else 'done' end as status from nw""")
def compile_write_tasks(spark, d):
    """The state of the tasks that are written."""
    return _written(spark, d)["tasks"]


@query(f"""with {GIVEN} select path, arg_min(name, task_id || lpad(cast(pos as varchar), 6, '0')) as name, path not in (select path from concept_pages where path is not null) as created from w group by path""")
def compile_write_pages(spark, d):
    """The concept pages that are made or added to."""
    return _written(spark, d)["concepts"].select("path", "name", "created")


@query(f"""with {GIVEN} select task_id, row_number() over (order by task_id, pos, name) as seq, name, path from w""")
def compile_write_partials(spark, d):
    """The partial rows of the concept index, in order."""
    return _written(spark, d)["partials"].select("task_id", "seq", "name", "path")


@query(f"""with {GIVEN}, h as (select *, 'Text ' || struct_id as title from ok)
select 'articles/' || title || '.md' as path, sha256, concat_ws({_NL} || {_NL}, concat_ws({_NL}, '---', {_Q('title', 'title')}, 'doc_type: solution', 'domain: []', 'topic: []', 'region: ""', 'customer: ""', 'customer_type: ""', {_Q('source_sha256', 'sha256')},
{_L('concepts', 'key_terms')}, 'aliases: []', 'created_at: "2024-01-02"', 'compiled_by: "agent"', 'confidence: 0.9', 'tldr: "a text delivered with its key terms"', '---'), content_md) as text from h""")
def compile_write_articles(spark, d):
    """The articles that are written."""
    return _written(spark, d)["articles"]


@query(f"""with {REDUCED}, mt as ({SQL['concepts_match']}) select struct_id, row_number() over (partition by struct_id order by score desc, name) as ord, name, summary, aliases, article_count from mt join idx using (name)""")
def compile_context(spark, d):
    """The concepts a task is given to read with each text."""
    terms = table(spark, d, "structure").select("struct_id", F.explode("key_terms").alias("term"))
    return writing.context(table(spark, d, "structure").select("struct_id"), terms, concepts.reduce_index(table(spark, d, "concepts_index")), key="struct_id")


@query(rf"""with {FM}, x as (select doc_id, block, regexp_replace(text, '(?s)\A---.*?\n---', '') as b from f) select distinct doc_id, issue from (
""" + " union ".join([f"select doc_id, '{k} missing' as issue from x where not regexp_matches(block, '(?m)^\\s*{k}\\s*:')" for k in compiling.CONCEPT_FIELDS]
    + [f"select doc_id, '{k} missing' from x where not contains(b, '## {k}')" for k in writing.CONCEPT_SECTIONS]
    + [f"select doc_id, 'no concept page' from x where {_HAS['doc_type']} and {_VALUE('doc_type')} <> 'concept'", f"select doc_id, 'kind unknown' from x where {_VALUE('concept_kind')} not in {compiling.CONCEPT_KINDS}",
       "select doc_id, 'body too short' from x where length(trim(b, ' ')) < 200"]) + ")")
def compile_concept_texts(spark, d):
    """What keeps each text from being a concept page."""
    return writing.concept_text_issues(table(spark, d, "documents"), "doc_id")


@query(rf"""with {FM}, x as (select doc_id, block, regexp_replace(text, '(?s)\A---.*?\n---', '') as b from f),
y as (select doc_id, substr(b, instr(b, '{writing.SUMMARY}'), instr(b, '{writing.DETAIL}') - instr(b, '{writing.SUMMARY}')) as u, substr(b, instr(b, '{writing.DETAIL}')) as v from x where instr(b, '{writing.SUMMARY}') > 0 and instr(b, '{writing.DETAIL}') > instr(b, '{writing.SUMMARY}'))
select doc_id, 'error' as level, 'detail repeats the summary' as issue from y where length(u) > 200 and length(v) > 200 and least(length(u), length(v)) / greatest(length(u), length(v)) > 0.95
and substr(u, 1, 200) = substr('{writing.SUMMARY}' || substr(v, {len(writing.DETAIL) + 1}), 1, 200)
union select doc_id, 'error', 'aliases missing' from x where not {_HAS['aliases']}
union select doc_id, 'error', 'aliases are no list' from x where {_HAS['aliases']} and not regexp_full_match({_VALUE('aliases')}, '\[.*\]')""")
def compile_article_texts(spark, d):
    """Copied summaries and aliases of articles, by the strict rule."""
    return writing.text_issues(table(spark, d, "documents"), strict=True)


@query(f"""select 'page named after an article' as "check", path as ref from concept_pages where {STEM_OF('path')} like '%@_concepts' escape '@' group by path
union all select 'task not ended', task_id from ({SQL['compile_tasks']}) group by task_id""")
def verify_wiki(spark, d):
    """What is wrong with the compiled pages and tasks."""
    return verify.verify_wiki(table(spark, d, "source_map").select(F.explode("generated_pages").alias("path")), table(spark, d, "concept_pages").where("path is not null"),
                              concepts.reduce_index(table(spark, d, "concepts_index")), compiling.tasks(table(spark, d, "source_map")))


# ---- graph assembly

@query(f"with {NODES} select * from n")
def graph_nodes(spark, d):
    return graph.merge_nodes(table(spark, d, "nodes")).drop("attrs")


@query(f"with {NODES}, {EDGES} select source, target, relation, confidence, confidence_score, seq from e")
def graph_edges(spark, d):
    return _graph(spark, d)[1].select("source", "target", "relation", "confidence", "confidence_score", "seq")


HEALED = """h0 as (select id, label, replace(source_file, '\\', '/') as src, source_file as sf, file_type as ft from n),
h as (select id, label, case when src like 'concepts/%' then 'concept' when src like 'articles/%' then 'document' else ft end as file_type,
case when src like 'concepts/%' or src like 'articles/%' then src when sf = '' then sf when ft = 'concept' then 'concepts/' || src when ft = 'document' then 'articles/' || src else sf end as source_file from h0)"""
CONSOLIDATED = HEALED + r""", kh as (select source_file, arg_min(struct_pack(id := id, label := label, ft := file_type), (case when coalesce(label, '') = '' then '1' else '0' end) || id) as x from h where source_file <> '' group by 1),
kept as (select x.id as id, coalesce(nullif(x.label, ''), regexp_replace(regexp_extract(source_file, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')) as label, x.ft as file_type, source_file from kh
union all select id, coalesce(nullif(label, ''), id), file_type, source_file from h where source_file is null or source_file = ''),
red1 as (select h.id, kept.id as to_ from h join kept using (source_file) where h.source_file <> '' and h.id <> kept.id)"""


@query(f"with {NODES}, {CONSOLIDATED} select * from kept")
def graph_consolidate(spark, d):
    return graph.consolidate(table(spark, d, "nodes"))[0].drop("attrs")


REWIRED = """rw as (select coalesce(a.to_, source) as source, coalesce(b.to_, target) as target, relation, confidence, seq from (select distinct source, target, relation, confidence, seq from edges) ed
left join red1 a on a.id = source left join red1 b on b.id = target where source <> '' and target <> ''),
rewired as (select source, target, relation, arg_min(confidence, seq) as confidence, min(seq) as seq from rw where source <> target group by 1, 2, 3)"""


@query(f"with {NODES}, {CONSOLIDATED}, {REWIRED} select source, target, relation, seq from rewired")
def graph_rewired_edges(spark, d):
    """Edges after nodes of one file became one."""
    moved = graph.consolidate(table(spark, d, "nodes"))[1]
    e = table(spark, d, "edges").select("source", "target", "relation", "confidence", "seq").distinct()
    return graph.redirect_edges(e, moved).select("source", "target", "relation", "seq")


@query(f"""with {NODES}, {REDUCED}, {CANON}, mp as (select n.*, c.name as cname from n join canon c on n.file_type = 'concept' and c.key = lower(trim(n.label, ' '))),
hd as (select cname, arg_min(id, (case when trim(label, ' ') <> cname then '1' else '0' end) || id) as id, list(distinct id) as ids from mp group by 1)
select id, cname as label, list_sort(list_filter(ids, lambda x: x <> id)) as aliases_ids from hd""")
def graph_merge_aliases(spark, d):
    """Concept nodes that mean one name, and the ids that melted into them."""
    names = concepts.canonical_map(concepts.reduce_index(table(spark, d, "concepts_index")))
    merged, _ = graph.merge_aliases(graph.merge_nodes(table(spark, d, "nodes")), names)
    listed = names.select(F.col("name").alias("label")).distinct()
    return merged.where("file_type = 'concept'").join(listed, "label", "left_semi").select("id", "label", "aliases_ids")


@query(f"with {NODES} select id, label from n where file_type = 'concept' and coalesce(source_file, '') = '' and id not in (select source from edges where source is not null union select target from edges where target is not null) and coalesce(label, '') not in (select name from concept_pages where name is not null) and label is not null union all select id, label from n where file_type = 'concept' and coalesce(source_file, '') = '' and id not in (select source from edges where source is not null union select target from edges where target is not null) and label is null")
def graph_orphans(spark, d):
    stems = table(spark, d, "concept_pages").select(F.col("name").alias("stem"))
    return graph.orphans(graph.merge_nodes(table(spark, d, "nodes")), table(spark, d, "edges"), stems)


@query(f"""with {NODES}, {REDUCED}, {CANON}, st as (select distinct regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1') as stem from concepts_index where path is not null),
ba as (select name as canonical_name, stem as duplicate from st join canon on key = lower(stem) where name <> stem),
sm as (select distinct case when length(a.label) <= length(b.label) then a.label else b.label end as canonical_name, case when length(a.label) <= length(b.label) then b.label else a.label end as duplicate
from edges e join n a on a.id = e.source join n b on b.id = e.target where relation = 'semantically_similar_to' and confidence_score >= 0.85 and not isnan(confidence_score)
and a.label in (select stem from st) and b.label in (select stem from st) and a.label <> b.label and a.label <> '' and b.label <> '')
select *, 'aliases' as source from ba union all select *, 'graph_semantic' from (select * from sm except select * from ba)""")
def graph_duplicates(spark, d):
    index = concepts.reduce_index(table(spark, d, "concepts_index"))
    stems = table(spark, d, "concepts_index").where("path is not null").select(paths.stem_of("path").alias("stem"))
    return graph.duplicates(stems, concepts.canonical_map(index), graph.merge_nodes(table(spark, d, "nodes")), table(spark, d, "edges"))


_ONE = "select distinct id, label, file_type, source_file from nodes"
_EDGE = "select distinct seq, source, target, relation, confidence, confidence_score from edges"


@query(f"""with nn as ({_ONE}), ee as ({_EDGE}), ids as (select distinct id from nodes where id is not null)
select issue, ref from (select 'node id missing' as issue, coalesce(id, '') as ref from nn where id is null or id = ''
union all select 'node label missing', coalesce(id, '') from nn where coalesce(label, '') = ''
union all select 'node label is an id', coalesce(id, '') from nn where label <> '' and (label = id or regexp_matches(label, '{graph.ID_LIKE}'))
union all select 'node type missing', coalesce(id, '') from nn where file_type is null union all select 'node type unknown', coalesce(id, '') from nn where file_type not in {graph.NODE_TYPES}
union all select 'node id repeated', id from nn where id is not null group by id having count(*) > 1
union all select 'edge end missing', cast(seq as varchar) from ee where coalesce(source, '') = '' or coalesce(target, '') = ''
union all select 'edge is a loop', cast(seq as varchar) from ee where source = target
union all select 'edge end unknown', cast(seq as varchar) from ee where (source is not null and source not in (select id from ids)) or (target is not null and target not in (select id from ids))
union all select 'edge score missing', cast(seq as varchar) from ee where confidence_score is null
union all select 'edge score not a number', cast(seq as varchar) from ee where isnan(confidence_score)
union all select 'edge score out of range', cast(seq as varchar) from ee where not isnan(confidence_score) and (confidence_score < 0 or confidence_score > 1)
union all select 'edge relation unknown', cast(seq as varchar) from ee where relation not in {graph.RELATIONS}
union all select 'edge confidence unknown', cast(seq as varchar) from ee where confidence is null or confidence not in {graph.CONFIDENCES})""")
def graph_issues(spark, d):
    return graph.issues(table(spark, d, "nodes"), table(spark, d, "edges"))


@query(f"""with nn as (select distinct id, label, file_type from nodes), ee as ({_EDGE}) select 'nodes' as part, coalesce(file_type, '(none)') as kind, count(*) as n from nn group by 2
union all select 'edges', coalesce(confidence, '(none)'), count(*) from ee group by 2""")
def graph_status(spark, d):
    """How many nodes and edges of each kind."""
    n = table(spark, d, "nodes").select("id", "label", "file_type").distinct().groupBy(F.coalesce("file_type", F.lit("(none)")).alias("kind")).agg(F.count("*").alias("n"))
    e = table(spark, d, "edges").select("seq", "source", "target", "relation", "confidence", "confidence_score").distinct()
    e = e.groupBy(F.coalesce("confidence", F.lit("(none)")).alias("kind")).agg(F.count("*").alias("n"))
    return n.select(F.lit("nodes").alias("part"), "kind", "n").unionByName(e.select(F.lit("edges").alias("part"), "kind", "n"))


_KEYS = "select 'edge' as kind, source || '|' || target || '|' || coalesce(relation, '') as key from"


@query(f"""with {NODES}, {CONSOLIDATED}, {REWIRED}, o as (select 'node' as kind, id as key from nodes where id is not null union {_KEYS} edges where source is not null and target is not null),
w as (select 'node' as kind, id as key from kept union {_KEYS} rewired)
select 'new' as change, kind, key from (select * from w except select * from o) union all select 'removed', kind, key from (select * from o except select * from w)""")
def graph_diff(spark, d):
    """What joining the nodes of one file changes in the graph."""
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    kept, moved = graph.consolidate(n)
    after = graph.redirect_edges(e.select("source", "target", "relation", "confidence", "seq").distinct(), moved)
    return graph.diff(n, e, kept, after)


HYPER = "hy as (select 'h:' || source as id, list_sort(list(distinct target)) as members from edges where relation = 'includes_module' and source is not null and target is not null group by source having count(distinct target) >= 3)"


@query(f"with {HYPER} select id, members, len(members) as member_count from hy")
def graph_hyperedges(spark, d):
    return graph.hyperedges(table(spark, d, "edges"))


@query(f"""with {NODES}, {CONSOLIDATED}, {HYPER}, x as (select id, unnest(members) as m, generate_subscripts(members, 1) as pos from hy), y as (select x.id, coalesce(to_, m) as m, min(pos) as pos from x left join red1 on red1.id = m group by 1, 2)
select id, list(m order by pos) as members, count(*) as member_count from y group by 1 having count(*) >= 2""")
def graph_hyper_members(spark, d):
    """Hyperedges after nodes of one file became one."""
    return graph.redirect_members(graph.hyperedges(table(spark, d, "edges")), graph.consolidate(table(spark, d, "nodes"))[1])


@query(f"""with {NODES}, {HYPER}, x as (select id, unnest(members) as m from hy)
select distinct 'hyperedge member unknown' as issue, id as ref from x where m not in (select id from nodes where id is not null)""")
def graph_hyper_issues(spark, d):
    """Hyperedges whose members are no nodes."""
    return graph.hyper_issues(graph.hyperedges(table(spark, d, "edges")), table(spark, d, "nodes"))


@query(f"""with {HYPER}, gone as (select distinct id from nodes where file_type = 'document' and id is not null), x as (select id, unnest(members) as m, generate_subscripts(members, 1) as pos from hy)
select id, list(m order by pos) as members, count(*) as member_count from x where m not in (from gone) group by 1 having count(*) >= 2""")
def graph_hyper_shrunk(spark, d):
    """Hyperedges without the documents among their members."""
    gone = table(spark, d, "nodes").where("file_type = 'document'").select("id").distinct()
    return graph.shrunk(graph.hyperedges(table(spark, d, "edges")), gone)


@query(f"select issue, count(*) as n from ({SQL['graph_issues']}) group by 1")
def graph_issue_counts(spark, d):
    """How many issues of each kind."""
    return graph.summary(graph.issues(table(spark, d, "nodes"), table(spark, d, "edges")))


@query("""select id, label, file_type, source_file from (select *, row_number() over (partition by id order by coalesce(label, '') = '' desc, label desc nulls last, file_type desc nulls last, source_file desc nulls last) as k
from nodes where id is not null and id <> '') where k = 1""")
def graph_nodes_last(spark, d):
    """The last delivery of each node."""
    return graph.merge_nodes(table(spark, d, "nodes"), last=True).drop("attrs")


@query("""select seq, source, target from (select distinct seq, source, target from edges) where source in (select id from nodes where id is not null) and target in (select id from nodes where id is not null)""")
def graph_pruned(spark, d):
    """Edges whose ends are both nodes."""
    return graph.pruned(table(spark, d, "nodes"), table(spark, d, "edges").select("seq", "source", "target").distinct())[0]


# ---- analytics

@query(f"with {GRAPH} select * from deg")
def graph_degrees(spark, d):
    return analytics.degrees(*_graph(spark, d))


@query(f"with {GRAPH} select id, coalesce(label, id) as label, degree from n join deg using (id) order by degree desc, id limit 10")
def graph_god_nodes(spark, d):
    return analytics.god_nodes(*_graph(spark, d))


@query(f"with {GRAPH} select id, coalesce(label, id) as label, degree from n join deg using (id) where file_type <> 'document' or file_type is null order by degree desc, id limit 10")
def graph_god_concepts(spark, d):
    """The most linked nodes that are no documents."""
    return analytics.god_nodes(*_graph(spark, d), without_types=("document",))


@over_groups(f"with {GRAPH}, {MEMBERS} select id, community from m")
def graph_members(n, e, m):
    """The group of each node."""
    return m


@query()
def graph_communities(spark, d):
    """Communities by the whole rule: modularity until it settles, large ones split."""
    n, e = _graph(spark, d)
    return louvain.clusters(n, cut(e))


@over_groups(f"""with {GRAPH}, {MEMBERS}, sizes as (select community, count(*) as members from m group by 1), ins as (select a.community, count(*) as c from e join m a on a.id = source join m b on b.id = target where a.community = b.community and source <> target group by 1)
select community, members, case when members < 2 then 1.0 else round(coalesce(c, 0) / (members * (members - 1) / 2), 2) end as cohesion from sizes left join ins using (community)""")
def graph_cohesion(n, e, m):
    return analytics.cohesion(m, e)


@over_groups(f"""with {GRAPH}, {MEMBERS}, o as (select source as id, a.community, count(distinct b.community) as connected from e join m a on a.id = source join m b on b.id = target where a.community <> b.community group by 1, 2),
r as (select *, row_number() over (partition by community order by connected desc, id) as k from o) select community, id, coalesce(label, id) as label, degree, connected from r join n using (id) join deg using (id) where k <= 3""")
def graph_bridges(n, e, m):
    return analytics.bridges(n, e, m)


FACTS = """fx as (select e.*, coalesce(a.label, a.id) as lu, coalesce(b.label, b.id) as lv, a.file_type as tu, b.file_type as tv, a.source_file as fu, b.source_file as fv, da.degree as du, db.degree as dv, ma.community as cu, mb.community as cv
from e join n a on a.id = source join n b on b.id = target join deg da on da.id = source join deg db on db.id = target join m ma on ma.id = source join m mb on mb.id = target)"""
_TRUST = "case confidence when 'AMBIGUOUS' then 3 when 'INFERRED' then 2 else 1 end"
_HUB = "case when (du <= 2 and dv >= 5) or (dv <= 2 and du >= 5) then 1 else 0 end"


def _surprise(base: str) -> str:
    return f"cast((case when relation = 'semantically_similar_to' then floor(({base}) * 1.5) else {base} end) as int) + {_HUB}"


_BASE = f"{_TRUST} + case when tu <> tv then 2 else 0 end + case when cu <> cv then 1 else 0 end"


@over_groups(f"""with {GRAPH}, {MEMBERS}, {FACTS}, sc as (select *, {_surprise(_BASE)} as score from fx)
select source, target, lu as source_label, lv as target_label, relation, coalesce(confidence, 'EXTRACTED') as confidence, score from sc where score > 1 order by score desc, seq, source, target limit 5""")
def graph_surprising(n, e, m):
    return analytics.surprising(n, e, m)


def _cat(c: str) -> str:
    x = f"lower(regexp_extract({c}, '\\.([^./]+)$', 1))"
    return f"case when {x} = 'pdf' then 'paper' when {x} in ('png','jpg','jpeg','gif','webp','svg') then 'image' when {x} in ('md','txt','rst','') then 'doc' else 'code' end"


_BASE2 = f"{_TRUST} + case when {_cat('fu')} <> {_cat('fv')} then 2 else 0 end + case when split_part(fu, '/', 1) <> split_part(fv, '/', 1) then 2 else 0 end + case when cu <> cv then 1 else 0 end"


@over_groups(f"""with {GRAPH}, {MEMBERS}, {FACTS}, sc as (select *, {_surprise(_BASE2)} as score from fx where fu <> '' and fv <> '' and fu <> fv and coalesce(relation not in {analytics.STRUCTURAL}, true))
select source, target, relation, score from sc order by score desc, seq, source, target limit 5""")
def graph_cross_file(n, e, m):
    return analytics.cross_file(n, e, m)


@over_groups(f"""with {GRAPH}, {MEMBERS}, {FACTS}, z as (select *, case confidence when 'AMBIGUOUS' then 0 when 'INFERRED' then 1 when 'EXTRACTED' then 2 else 3 end as rk from fx where cu <> cv),
k as (select *, row_number() over (partition by least(cu, cv), greatest(cu, cv) order by rk, seq, source, target) as p from z)
select least(cu, cv) as community_a, greatest(cu, cv) as community_b, source, target, relation, confidence from k where p = 1 order by rk, seq, 1, 2 limit 5""")
def graph_cross_community(n, e, m):
    return analytics.cross_community(e, m)


@over_groups(f"""with {GRAPH}, {MEMBERS} select 'isolated' as gap, id as ref, cast(degree as double) as n from deg where degree <= 1
union all select 'thin community', cast(community as varchar), cast(count(*) as double) from m group by community having count(*) < 3
union all select 'ambiguous percent', '', round(sum(cast(confidence = 'AMBIGUOUS' as int)) * 100 / greatest(count(*), 1), 1) from e""")
def graph_gaps(n, e, m):
    return analytics.gaps(n, e, m)


@query()
def graph_questions(spark, d):
    return analytics.questions(*_settled(spark, d))


@over_groups(f"with {GRAPH}, {MEMBERS}, {NAMES} select community, name from nm")
def graph_community_names(n, e, m):
    return analytics.name_communities(n, e, m)


@query()
def graph_betweenness(spark, d):
    n, e = _graph(spark, d)
    return analytics.betweenness(cut(n), cut(e))


# ---- retrieval

# SQL has no compatibility decomposition; of it, only full-width letters occur in labels
WIDE = ''.join(map(chr, range(0xFF01, 0xFF5F)))
PLAIN = ''.join(map(chr, range(0x21, 0x7F))).replace("'", "''")
TERMS = ("payroll", "metering", "采购")
_SCORE = " + ".join(f"case when contains(l, '{t}') then 1.0 when contains(s, '{t}') then 0.5 else 0.0 end" for t in TERMS)
SCORED = f"scored as (select id, coalesce(label, id) as label, cast({_SCORE} as double) as score from (select id, label, lower(strip_accents(translate(coalesce(label, ''), '{WIDE}', '{PLAIN}'))) as l, lower(coalesce(source_file, '')) as s from n))"
STARTS = "starts as (select id from scored where score > 0 order by score desc, id limit 3)"
BFS = """bl as (select source as a, target as b from e union select target, source from e), v0 as (select id, 0 as depth from starts),
s1 as (select distinct a as source, b as target, 1 as depth from v0 join bl on a = id where b not in (select id from v0)), v1 as (select * from v0 union all select distinct target, 1 from s1),
s2 as (select distinct a, b, 2 from v1 join bl on a = id where v1.depth = 1 and b not in (select id from v1)), v2 as (select * from v1 union all select distinct b, 2 from s2),
s3 as (select distinct a, b, 3 from v2 join bl on a = id where v2.depth = 2 and b not in (select id from v2)), v3 as (select * from v2 union all select distinct b, 3 from s3)"""
BFS_ALL = f"{GRAPH}, {SCORED}, {STARTS}, {BFS}"


@query(f"with {NODES}, {SCORED} select * from scored where score > 0")
def retrieve_scores(spark, d):
    """All nodes a question hits, with their score."""
    return retrieval.score_nodes(graph.merge_nodes(table(spark, d, "nodes")), list(TERMS))


@query("""select distinct id from nodes where contains(lower(attrs['region']), 'west') and contains(lower(file_type), 'doc')""")
def retrieve_filtered(spark, d):
    """Nodes that pass a filter on their attributes."""
    chosen = retrieval.parse_filters(["--filter", "region=west", "--filter=file_type=doc"])
    return table(spark, d, "nodes").where(retrieval.matches(chosen)).select("id").distinct()


def _visited(spark, d):
    n, e = _graph(spark, d)
    n, e = cut(n), cut(e)
    starts = cut(retrieval.score_nodes(n, list(TERMS)).limit(3))
    return n, e, starts, *retrieval.bfs(e, starts)


@query(f"with {BFS_ALL} select * from v3")
def retrieve_bfs(spark, d):
    """Nodes within three steps of the best three, and how far they are."""
    return _visited(spark, d)[3]


@query(f"with {BFS_ALL} select * from s1 union all select * from s2 union all select * from s3")
def retrieve_bfs_steps(spark, d):
    return _visited(spark, d)[4]


INNER = "inn as (select v.id, count(e.source) as inner_ from (select distinct id from v3) v left join (select source, target from e where target in (select id from v3)) e on e.source = v.id group by 1)"


@query(f"""with {BFS_ALL}, {INNER}, c as (select source_file, inner_ + case when inn.id in (select id from starts) then 10000 else 0 end as score, case when source_file like 'concepts/%' then 1 when source_file like 'articles/%' then 0 end as kind from inn join n using (id)),
r as (select *, row_number() over (partition by kind order by score desc, source_file) as k from c where kind is not null), q as (select count(*) filter (kind = 1 and k <= 6) as nc, count(*) filter (kind = 0 and k <= 6) as na from r),
t as (select case when nc > least(3, nc) then least(nc, least(3, nc) + (6 - least(3, nc) - least(3, na))) else least(3, nc) end as tc, case when nc > least(3, nc) then least(3, na) else least(na, least(3, na) + (6 - least(3, nc) - least(3, na))) end as ta from q)
select row_number() over (order by kind, k) as ord, source_file, score from r, t where k <= case when kind = 1 then tc else ta end""")
def retrieve_pages(spark, d):
    n, e, starts, visited, _ = _visited(spark, d)
    return retrieval.rank_pages(n, e, visited, starts)


@query(f"""with {BFS_ALL}, vis as (select distinct id from v3), ln as (
select 0 as k, -degree as o, n.id as i, '- `' || coalesce(label, n.id) || '` [' || coalesce(file_type, '') || '] ' || degree as line from vis join n using (id) join deg using (id)
union all select 1, seq, source || '|' || target, '  ' || coalesce(a.label, a.id) || ' --' || coalesce(relation, '') || '--> ' || coalesce(b.label, b.id) || ' [' || coalesce(confidence, '') || ']'
from e join n a on a.id = source join n b on b.id = target where source in (from vis) and target in (from vis)),
ru as (select *, row_number() over (order by k, o, i) as ord, sum(length(line) + 1) over (order by k, o, i) as used from ln) select ord, line from ru where used <= 4000""")
def retrieve_text(spark, d):
    n, e, _, visited, _ = _visited(spark, d)
    return retrieval.render(n, e, visited)


@query()
def retrieve_dfs(spark, d):
    n, e, starts, _, _ = _visited(spark, d)
    return retrieval.dfs(e, [r["id"] for r in starts.collect()])  # three rows


# ---- reports and exports

@query(f"""with {NODES}, {EDGES} select 'MERGE (n:' || coalesce(nullif(regexp_replace(file_type, '[^A-Za-z0-9_]', '', 'g'), ''), 'Entity') || ' {{id: ''' || replace(replace(id, '\\', '\\\\'), '''', '\\''') || ''', label: ''' || replace(replace(substr(regexp_replace(coalesce(label, id), '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256), '\\', '\\\\'), '''', '\\''') || '''}});' as line from n
union all select 'MATCH (a {{id: ''' || replace(replace(source, '\\', '\\\\'), '''', '\\''') || '''}}), (b {{id: ''' || replace(replace(target, '\\', '\\\\'), '''', '\\''') || '''}}) MERGE (a)-[:' || coalesce(nullif(regexp_replace(upper(relation), '[^A-Z0-9_]', '_', 'g'), ''), 'RELATED_TO') || ']->(b);' from e""")
def export_cypher(spark, d):
    return exports.cypher(*_graph(spark, d))


@query()
def export_node_links(spark, d):
    return exports.node_links(*_settled(spark, d))


_X = lambda c: f"replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@over_groups(f"""with {GRAPH}, {MEMBERS} select 1 as ord, '<node id="' || {_X('id')} || '"><data key="label">' || {_X('coalesce(label, id)')} || '</data><data key="community">' || coalesce(community, -1) || '</data></node>' as line from n left join m using (id)
union all select 2, '<edge source="' || {_X('source')} || '" target="' || {_X('target')} || '"><data key="relation">' || {_X('relation')} || '</data></edge>' from e""")
def export_graphml(n, e, m):
    return exports.graphml(n, e, m)


@over_groups(f"""with {GRAPH}, {MEMBERS}, t as (select max(degree) as top from deg)
select id, substr(regexp_replace(coalesce(label, id), '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256) as label, round(10 + 30 * degree / top, 1) as size, degree >= 0.15 * top as show, community from n join deg using (id) join m using (id), t""")
def export_vis_nodes(n, e, m):
    return exports.vis_nodes(n, e, m)


@query()
def export_notes(spark, d):
    return exports.notes(*_settled(spark, d))


@query()
def export_canvas(spark, d):
    return exports.canvas(_settled(spark, d)[2])


@query()
def report_summary(spark, d):
    return exports.summary_lines(*_settled(spark, d))


@query()
def report_community_pages(spark, d):
    return exports.community_pages(*_settled(spark, d))


# ---- backfill

@query(rf"""with s as (select unnest(generated_pages) as p, sha256 from source_map), x as (select {STEM_OF('p')} as stem, sha256, '0' as k from s union all select {STEM}, sha256, '1' from source_map)
select stem, arg_min(sha256, k || sha256) as sha256 from x where stem <> '' and sha256 is not null group by 1""")
def backfill_sha(spark, d):
    return backfill.sha_lookup(table(spark, d, "source_map"))


@query(f"""with {NODES}, {EDGES} select source as id, list_sort(list(distinct label)) as concepts from e join n on n.id = target where relation in {backfill.CONCEPT_RELATIONS} and file_type = 'concept' and label <> '' group by 1""")
def backfill_concepts(spark, d):
    return backfill.concepts_of(*_graph(spark, d))


@query(r"""select doc_id, regexp_extract(text, '(?m)^#\s+(.+?)\s*$', 1) as title, length(text) as chars from documents where text is not null and not regexp_matches(text, '\A---[ \t]*\n')""")
def backfill_needed(spark, d):
    return backfill.needs_backfill(table(spark, d, "documents"))


@query(rf"""with s as (select unnest(generated_pages) as p, sha256 from source_map), x as (select {STEM_OF('p')} as stem, sha256, '0' as k from s union all select {STEM}, sha256, '1' from source_map),
lk as (select stem, arg_min(sha256, k || sha256) as sha256 from x where stem <> '' and sha256 is not null group by 1)
select doc_id, regexp_extract(text, '(?m)^#\s+(.+?)\s*$', 1) as title, sha256[1:16] as source_sha256,
substr(coalesce(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p, ' ')), lambda p: p <> '' and p not like '#%' and p not like '<!--%' and p not like '---%')[1], ''), 1, 300) as summary,
cast(created_at at time zone 'UTC' as date) as created from documents left join lk using (stem) where text is not null""")
def backfill_articles(spark, d):
    return backfill.article_fields(table(spark, d, "documents"), table(spark, d, "source_map"))


@query(r"""select doc_id, list_sort(list_distinct(regexp_extract_all(text, '\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]', 1))) as links from documents where text is not null""")
def backfill_wikilinks(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_sort(pages.wikilinks("text")).alias("links"))


# ---- logs and verifiers

@query("select event_type, time_bucket(interval 1 day, ts) as start, count(*) as calls, round(sum(value), 4) as total from events where ts is not null group by 1, 2")
def logs_daily(spark, d):
    """Events of each type by day."""
    rows = logs.costs(table(spark, d, "events"), at="ts", op="event_type", amount="value")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select event_id, event_type, ts from events order by ts desc, event_id desc limit 20")
def logs_tail(spark, d):
    """The last twenty events."""
    return logs.tail(table(spark, d, "events"), 20, "ts", "event_id").select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""select user_id, start, "end", n from (select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from (
select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as new from events where ts is not null)) group by user_id, s)""")
def logs_sessions(spark, d):
    """Sessions of each user: events no more than half an hour apart."""
    rows = jobs.sessions(table(spark, d, "events").where("ts is not null"), "user_id", "ts")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_type, event_id) as before_kind from events")
def logs_previous(spark, d):
    """What each user did before."""
    by = ["ts", "event_type", "event_id"]
    rows = table(spark, d, "events").withColumn("order", F.struct(*by))
    return logs.previous(rows, "user_id", "order", "event_type").select("event_id", "user_id", "event_type", "before_kind")


@query(f"""with {NODES}, {EDGES} select 'relation not allowed' as "check", coalesce(relation, '(none)') as ref from e where relation is null or relation not in {graph.RELATIONS} group by 2
union all select 'label holds markup', id from n where regexp_matches(label, '[*`\\[\\]#]') union all select 'label too long for a file', id from n where length(label) > 120""")
def verify_graph(spark, d):
    """What is wrong with the built graph."""
    return verify.verify_graph(*_settled(spark, d))


@query(f"""with {REDUCED} select 'page missing' as "check", name as ref from idx where path is null or path not in (select path from concept_pages where path is not null)
union all select 'summary missing', name from idx where summary is null or trim(summary, ' ') = '' union all select 'count negative', name from idx where article_count < 0""")
def verify_index(spark, d):
    """What is wrong with the concept index."""
    return verify.verify_index(concepts.reduce_index(table(spark, d, "concepts_index")), table(spark, d, "concept_pages"))


# ---- further reports, sidecars and backfills

_CODE = ", ".join(repr(x) for x in paths.CODE)


@query(f"""with x as (select doc_id, coalesce(stem, '') || '.md' as path, {' + '.join(f"cast(regexp_matches(substr(text, 1, 3000), '{p}') as int)" for p in paths.PAPER_SIGNALS)} as sig from documents where text is not null)
select doc_id, case when sig >= 3 then 'paper' when path <> '.md' then 'document' end as kind from x""")
def scan_content_class(spark, d):
    """Class of every document by its name and content."""
    rows = table(spark, d, "documents").where("text is not null").withColumn("path", F.concat(F.coalesce("stem", F.lit("")), F.lit(".md")))
    return rows.select("doc_id", paths.content_class("path", F.col("text")).alias("kind"))


@query(rf"select distinct original_filename, {STEM} || '_' || sha256(original_filename)[1:8] || '.md' as sidecar from source_map where original_filename is not null")
def scan_sidecars(spark, d):
    rows = table(spark, d, "source_map").where("original_filename is not null").select("original_filename").distinct()
    return rows.select("original_filename", paths.sidecar("original_filename").alias("sidecar"))


@query(r"""with l as (select 'doc_' || doc_id as path, unnest(list_distinct(regexp_extract_all(text, '\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]', 1))) as title from documents where text is not null)
select distinct path, title from l where title in (select term from canonical_terms)""")
def ingest_mentions(spark, d):
    """Texts that link to an entry of the list."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), "text")
    return ingest.mentions(docs, table(spark, d, "canonical_terms").select(F.col("term").alias("title")))


@query("select sha256, upload_id from (select distinct sha256, upload_id, batch_id from source_map) where sha256 is null or sha256 not in (select sha256 from source_map where batch_id = 1 and sha256 is not null)")
def ingest_remove(spark, d):
    """What is left when the hashes of one batch are removed."""
    s = table(spark, d, "source_map").select("sha256", "upload_id", "batch_id").distinct()
    return ingest.remove(s, s.where("batch_id = 1"), F.lit(None).cast("timestamp"))[0].select("sha256", "upload_id")


@query(f"""with {GRAPH}, gd as (select id, coalesce(label, id) as label, degree from n join deg using (id) order by degree desc, id limit 10),
nr as (select distinct id, other, relation from (select source as id, target as other, relation from e union all select target, source, relation from e) where id in (select id from gd) and id <> other),
rk as (select nr.*, coalesce(n.label, n.id) as l, row_number() over (partition by nr.id, relation order by degree desc, other) as r from nr join n on n.id = other join deg on deg.id = other),
pt as (select id, '## ' || coalesce(relation, '') || chr(10) || chr(10) || string_agg('- [[' || l || ']]', chr(10) order by r) as x from rk where r <= 20 group by id, relation),
pp as (select id, string_agg(x, chr(10) || chr(10) order by x) as x from pt group by id)
select translate(label, '/ :', '-_-') || '.md' as file, '# ' || label || chr(10) || chr(10) || 'links: ' || degree || chr(10) || chr(10) || coalesce(x, '') as body from gd left join pp using (id)""")
def report_god_pages(spark, d):
    return exports.god_pages(*[cut(x) for x in _graph(spark, d)])


@over_groups(f"""with {GRAPH}, {MEMBERS}, {NAMES}
select 1 as ord, row_number() over (order by n desc, community) as sub, '- [[' || name || ']] (' || n || ')' as line from nm
union all select 2, row_number() over (order by degree desc, id), '- [[' || coalesce(label, id) || ']] (' || degree || ')' from (select * from n join deg using (id) order by degree desc, id limit 10)""")
def report_index(n, e, m):
    return exports.index_lines(n, e, m)


@query(f"with {GRAPH} select source, target, relation, case when isnan(confidence_score) then 0.0 else coalesce(confidence_score, 0.0) end as weight from e order by weight desc, seq, source, target limit 200")
def export_canvas_edges(spark, d):
    return exports.canvas_edges(_graph(spark, d)[1])


@query(f"with {REDUCED} select '' as ord, 'concepts: ' || count(*) as line from idx union all select name, '- [[' || name || ']]' from idx")
def report_wiki_index(spark, d):
    return exports.wiki_index(concepts.reduce_index(table(spark, d, "concepts_index")))


@query(r"""with l as (select name, count(*) as articles from (select doc_id, unnest(list_distinct(regexp_extract_all(text, '\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]', 1))) as name from documents where text is not null) group by 1)
select page_id, p.name, summary, coalesce(articles, 0) as articles from (select distinct page_id, name, substr(summary, 1, 300) as summary from concept_pages where page_id is not null) p left join l using (name)""")
def backfill_concept_fields(spark, d):
    return backfill.concept_fields(table(spark, d, "concept_pages"), table(spark, d, "documents"))


@query(r"select case when regexp_matches(text, '\A---[ \t]*\n') then 'skipped' else 'done' end as state, count(*) as n from documents where text is not null group by 1")
def backfill_done(spark, d):
    return backfill.done(table(spark, d, "documents"))


@query(f"""with lab as (select distinct id, lower(label) as l from nodes where file_type = 'concept' and label <> '' and id is not null) select distinct id, 'doc_' || doc_id as path from lab join documents on contains(lower(text), l)""")
def retrieve_evidence(spark, d):
    """Texts that hold the label of a concept node."""
    labels = table(spark, d, "nodes").where("file_type = 'concept' and id is not null").select("id", "label")
    return retrieval.evidence(table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), "text"), labels)


@query(r"""select doc_id, coalesce(nullif(regexp_extract(text, '(?m)^tldr:\s*"?(.+?)"?\s*$', 1), ''), '(no tldr)') as tldr from documents where text is not null""")
def retrieve_tldrs(spark, d):
    """The short summary of every text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", retrieval.tldr_of("text").alias("tldr"))


_S = lambda c: f"""'"' || replace(coalesce({c}, ''), '"', '\\"') || '"'"""


@query(rf"""with b as ({SQL['backfill_articles']}) select doc_id, concat_ws(chr(10), '---', 'title: ' || {_S('title')}, 'doc_type: "article"', 'source_sha256: ' || {_S('source_sha256')}, 'concepts: []', 'aliases: []', 'tldr: ' || {_S('summary')},
'created_at: ' || {_S('cast(created as varchar)')}, 'compiled_by: "backfill"', 'confidence: 0.7', '---') || chr(10) || chr(10) || text as text
from b join documents using (doc_id) where not regexp_matches(text, '\A---[ \t]*\n')""")
def backfill_pages(spark, d):
    """Legacy texts with the frontmatter they lack."""
    return backfill.article_pages(table(spark, d, "documents"), table(spark, d, "source_map"))


@query()
def report_full(spark, d):
    """The full report."""
    n, e, m = _settled(spark, d)
    return exports.full_lines(n, e, m, graph.hyperedges(table(spark, d, "edges")))


@query()
def export_community_notes(spark, d):
    return exports.community_notes(*_settled(spark, d))


@over_groups(f"""with {GRAPH}, {MEMBERS}, q as (select m.community, n.id, coalesce(label, n.id) as l from m join n using (id)) select community, count(*) as cards, min(l) as first from q group by 1""", pairs=True)
def export_canvas_cards(n, e, m):
    """How many cards each group of the canvas has, and the first."""
    cards = exports.canvas_cards(n, m).join(n.select("id", F.coalesce("label", "id").alias("l")), "id")
    return cards.groupBy("community").agg(F.count("*").alias("cards"), F.min("l").alias("first"))
