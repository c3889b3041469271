"""Incremental ingest: what is new, updated, skipped or failed; lookups; removals; caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.pages import body_of, wikilinks
from scriptorium.functions.paths import file_class, in_noise, is_ignored, is_secret, is_skipped, name_of, stem_of
from scriptorium.operators.contains import containing
from scriptorium.session import skew_lag, skew_lookup

STATUSES = ("new", "updated", "skipped", "failed")
MIN_CHARS = 50
MAX_FILES, MAX_WORDS = 200, 2_000_000
# fixed values: words from which a graph pays, and from which it costs much
GRAPH_WORDS, COSTLY_WORDS = 50_000, 500_000


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def classify(files: DataFrame, path: str = "path", ignore: list[str | tuple[str, str]] | None = None, cloud: bool = False, wide: bool = False) -> DataFrame:
    """The files with ``file_type`` and ``status``: taken, or why not (noise, sensitive,
    ignored, unsupported), tested in this order. A null path is unsupported. ``wide`` takes
    the longer list of folders and the generated files for noise as well."""
    kind = file_class(path)
    noise = in_noise(path, wide) | is_skipped(path) if wide else in_noise(path)
    status = (
        F.when(F.col(path).isNull(), "unsupported").when(noise, "noise").when(is_secret(path, cloud), "sensitive")
        .when(is_ignored(path, ignore or []), "ignored").when(kind.isNull(), "unsupported").otherwise("taken")
    )
    return files.select("*", kind.alias("file_type"), status.alias("status"))


def corpus_summary(classified: DataFrame, words: Column | None = None) -> DataFrame:
    """(files, words, skipped_sensitive, warning): one row for a whole scan."""
    taken = F.col("status") == "taken"
    n, w = F.sum(taken.cast("long")), F.sum(F.when(taken, words if words is not None else F.lit(0)).otherwise(0))
    out = classified.agg(F.coalesce(n, F.lit(0)).alias("files"), F.coalesce(w, F.lit(0)).alias("words"),
                         F.coalesce(F.sum((F.col("status") == "sensitive").cast("long")), F.lit(0)).alias("skipped_sensitive"))
    warning = F.when(F.col("files") == 0, "no files").when(F.col("files") > MAX_FILES, "many files").when(F.col("words") > MAX_WORDS, "many words")
    return out.withColumn("warning", warning)


def graph_advice(classified: DataFrame, words: Column) -> DataFrame:
    """(files, words, needs_graph, warning): one row for a scan by the wide rule."""
    taken = F.col("status") == "taken"
    out = classified.agg(F.coalesce(F.sum(taken.cast("long")), F.lit(0)).alias("files"), F.coalesce(F.sum(F.when(taken, words)), F.lit(0)).cast("long").alias("words"))
    warning = F.when(F.col("words") < GRAPH_WORDS, "a graph may not be needed").when((F.col("words") >= COSTLY_WORDS) | (F.col("files") >= MAX_FILES), "a large corpus")
    return out.select("files", "words", (F.col("words") >= GRAPH_WORDS).alias("needs_graph"), warning.alias("warning"))


def changes(now: DataFrame, before: DataFrame, key: str = "path", stamp: str = "modified") -> DataFrame:
    """(key, change): new where the manifest lacks it or is older, deleted where only the
    manifest has it, else unchanged. One row a key of each side is expected."""
    a = now.select(key, F.col(stamp).alias("_now")).withColumn("_a", F.lit(True))
    b = before.select(key, F.col(stamp).alias("_old")).withColumn("_b", F.lit(True))
    change = F.when(F.col("_a").isNull(), "deleted").when(F.col("_b").isNull() | F.col("_old").isNull() | (F.col("_now") > F.col("_old")), "new").otherwise("unchanged")
    return a.join(b, key, "full").select(key, change.alias("change"))


def ingest(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(upload_id, sha256, stem, status, replaces): the class of each file against what is
    known and against earlier files of the batch (by name).

    skipped: the hash is known and has pages, or an earlier file of the batch has it;
    failed: under 50 characters of text; updated: another hash is known, or came earlier,
    under the same stem; else new. Files without a hash or name fail. ``files`` has
    (upload_id, sha256, original_filename, chars); ``sources`` has (sha256,
    original_filename, generated_pages) and may repeat rows.
    """
    known = sources.where("sha256 is not null").groupBy("sha256").agg(F.max(F.coalesce(F.size("generated_pages") > 0, F.lit(False))).alias("_done"))
    stems = sources.where("sha256 is not null and original_filename is not null").groupBy(stem_of("original_filename").alias("stem")).agg(
        F.min("sha256").alias("_lo"), F.max("sha256").alias("_hi"))
    rows = files.select("upload_id", "sha256", "original_filename", "chars", stem_of("original_filename").alias("stem"))
    rows = rows.join(known, "sha256", "left").join(stems, "stem", "left")
    # the first file of each hash by an aggregate, the file before of each stem by ranges: one
    # hash or stem may hold any share of the files, and so may null
    first = rows.where("sha256 is not null").groupBy("sha256").agg(F.min_by("upload_id", F.struct("original_filename", "upload_id")).alias("_first"))
    rows = skew_lookup(rows, first, "sha256", "left").withColumn("_same", F.col("upload_id") != F.col("_first"))
    rows = skew_lag(rows, "sha256", "stem", ["original_filename", "upload_id"], "_earlier")
    other = F.when(F.col("_earlier").isNotNull() & (F.col("_earlier") != F.col("sha256")), F.col("_earlier")).when(
        F.col("_lo") != F.col("sha256"), F.col("_lo")).when(F.col("_hi") != F.col("sha256"), F.col("_hi"))
    status = (
        F.when(F.col("sha256").isNull() | F.col("original_filename").isNull(), "failed").when(F.coalesce("_done", F.lit(False)) | F.col("_same"), "skipped")
        .when(F.coalesce("chars", F.lit(0)) < MIN_CHARS, "failed").when(other.isNotNull(), "updated").otherwise("new")
    )
    rows = rows.withColumn("status", status)
    return rows.select("upload_id", "sha256", "stem", "status", F.when(F.col("status") == "updated", other).alias("replaces"))


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The tables merged, the latest row of each key; ``max_by`` combines on the map side."""
    both = table.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order and not isinstance(both.schema[c].dataType, _Maps)])).alias("_r"))
    return latest.select(key, *[F.col("_r")[c].alias(c) for c in rest])


from pyspark.sql.types import MapType as _Maps  # noqa: E402  maps have no order


def stem_index(sources: DataFrame) -> DataFrame:
    """(stem, shas): the hashes known under each file stem; empty stems are left out."""
    rows = sources.where("sha256 is not null").select(stem_of("original_filename").alias("stem"), "sha256").where("stem <> ''")
    return rows.groupBy("stem").agg(F.array_sort(F.collect_set("sha256")).alias("shas"))


def probe(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(stem, sha256, others): the hashes a stem index (stem, shas) knows for each asked (stem,
    sha256) beside its own; empty where there are none."""
    rows = asked.select("stem", "sha256").where("stem <> ''").distinct()
    own = F.filter("shas", lambda x: ~x.eqNullSafe(F.col("sha256")))
    return skew_lookup(rows, index.select("stem", "shas"), "stem", "left").select("stem", "sha256", F.coalesce(own, F.array().cast("array<string>")).alias("others"))


def report_lines(classes: DataFrame, shown: int = 1_000) -> DataFrame:
    """(ord, sub, line): an ingest told: the number of files of each class, then the files of
    each class by name, at most ``shown`` a class and a count of the rest. ``classes``:
    (original_filename, sha256, status, replaces)."""
    order = F.array(*map(F.lit, STATUSES))
    rows = classes.select("status", "original_filename", "sha256", "replaces").distinct()
    head = rows.agg(F.concat_ws("  ", *[F.concat(F.lit(f"{s}="), F.sum((F.col("status") == s).cast("long")).cast("string")) for s in STATUSES]).alias("line"))
    head = head.select(F.lit(0).alias("ord"), F.lit(0).cast("long").alias("sub"), F.coalesce("line", F.lit("")).alias("line"))
    text = F.concat_ws("  ", F.concat(F.lit("- "), F.coalesce("original_filename", F.lit(""))), F.concat(F.lit("sha="), F.substring("sha256", 1, 12)), F.concat(F.lit("old="), F.substring("replaces", 1, 12)))
    named = rows.select(F.array_position(order, F.col("status")).cast("int").alias("ord"), text.alias("line"))
    ends = [named.where(F.col("ord") == k + 1).orderBy("line").limit(shown) for k in range(len(STATUSES))]
    some = ends[0]
    for x in ends[1:]:
        some = some.unionByName(x)
    some = some.select("ord", F.row_number().over(Window.partitionBy("ord").orderBy("line")).cast("long").alias("sub"), "line")
    more = named.groupBy("ord").agg(F.count("*").alias("n")).where(F.col("n") > shown)
    more = more.select("ord", F.lit(shown + 1).cast("long").alias("sub"), F.format_string("- and %d more", F.col("n") - shown).alias("line"))
    return head.unionByName(some).unionByName(more)


def find_records(sources: DataFrame, needle: str) -> DataFrame:
    """Rows whose file name contains the needle, case aside; an empty needle finds none."""
    return sources.where(F.lit(needle != "") & F.contains(F.lower("original_filename"), F.lit(needle.lower())))


def conflicts(inbox: DataFrame, sources: DataFrame, path: str = "path") -> DataFrame:
    """(path, original_filename): known names that contain the stem of a file in the inbox, met
    by the rarest run of the stem."""
    asked = inbox.select(F.col(path).alias("path"), F.lower(stem_of(path)).alias("_stem")).where("_stem <> ''").distinct()
    names = sources.where("original_filename is not null").select("original_filename").distinct()
    found = containing(asked.select(F.col("_stem").alias("needle")), names.select(F.lower("original_filename").alias("hay")))
    named = names.select("original_filename", F.lower("original_filename").alias("hay"))
    return asked.join(found.withColumnRenamed("needle", "_stem"), "_stem").join(named, "hay").select("path", "original_filename").distinct()


def removal(sources: DataFrame, gone: DataFrame, tasks: DataFrame, pages: DataFrame, text: str = "text") -> DataFrame:
    """(sha256, kind, ref): the removal plan of all hashes of ``gone``: the articles made of a
    source, its archive folder, its tasks (status/id) and the pages that hold [[title]] of one
    of its articles. Nothing is changed. ``tasks`` has (task_id, sha256, status), ``pages``
    (path, text)."""
    keys = gone.select("sha256").where("sha256 is not null").distinct()
    rows = sources.join(keys, "sha256", "left_semi")
    made = rows.select("sha256", F.explode("generated_pages").alias("ref")).where("ref is not null").distinct()
    kept = rows.where("raw_path <> ''").select("sha256", F.lit("archive").alias("kind"), F.col("raw_path").alias("ref"))
    open_ = tasks.join(keys, "sha256", "left_semi").select("sha256", F.lit("task").alias("kind"), F.concat_ws("/", "status", "task_id").alias("ref"))
    titles = made.select("sha256", stem_of("ref").alias("title")).distinct()
    links = pages.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1)))).alias("title"))
    # titles that the pattern can't hold are looked for as strings
    odd = titles.where(F.col("title").rlike(r"[\[\]\n]")).withColumn("needle", F.concat(F.lit("[["), "title", F.lit("]]")))
    held = containing(odd, pages.select(F.col(text).alias("hay")))
    told = links.join(titles, "title").select("sha256", "path").unionByName(
        odd.join(held, "needle").join(pages.select("path", F.col(text).alias("hay")), "hay").select("sha256", "path"))
    out = made.select("sha256", F.lit("article").alias("kind"), "ref").unionByName(kept).unionByName(open_)
    return out.unionByName(told.select("sha256", F.lit("mention").alias("kind"), F.col("path").alias("ref"))).distinct()


def cache_key(text: Column | str, path: Column | str) -> Column:
    """Hash of the text after its frontmatter and of its path: metadata edits keep it."""
    return F.sha2(F.concat(body_of(text), F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit(""))), 256)


def split_cached(files: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(cached, uncached) files."""
    keys = cache.select(key).distinct()
    return files.join(keys, key, "left_semi"), files.join(keys, key, "left_anti")


def verify_tasks(sources: DataFrame, contents: DataFrame, tasks: DataFrame) -> DataFrame:
    """(check, ref): what is wrong around the sources: none at all, hashes without structure
    (no headings array), tasks of a hash that is not known or without one."""
    none = sources.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no sources").alias("check"), F.lit("").alias("ref"))
    known = sources.where("sha256 is not null").select("sha256").distinct()
    built = contents.where("headings is not null").select("sha256").distinct()
    bare = known.join(built, "sha256", "left_anti").select(F.lit("structure missing").alias("check"), F.col("sha256").alias("ref"))
    loose = tasks.join(known, "sha256", "left_anti").select(F.lit("task of an unknown source").alias("check"), F.coalesce("task_id", F.lit("")).alias("ref")).distinct()
    return none.unionByName(bare).unionByName(loose)


def verify_ingest(sources: DataFrame, contents: DataFrame) -> DataFrame:
    """(check, ref, n): what is wrong with the sources; no rows if nothing is."""
    has = contents.where("sha256 is not null").groupBy("sha256").agg(F.max(F.length(F.trim(F.coalesce("content_md", F.lit(""))))).alias("_chars"))
    rows = sources.select("upload_id", "sha256", "raw_path", "original_filename").distinct().join(has, "sha256", "left")
    checks = F.array_compact(F.array(
        F.when(F.col("sha256").isNull(), "hash missing"),
        F.when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "hash malformed"),
        F.when(F.col("raw_path").isNull() | (F.trim("raw_path") == ""), "raw path missing"),
        F.when(F.col("original_filename").isNull(), "file name missing"),
        F.when(F.col("_chars").isNull(), "content missing"),
        F.when(F.col("_chars") < MIN_CHARS, "content too short"),
    ))
    return rows.select(F.explode(checks).alias("check"), F.col("upload_id").alias("ref"))


def mentions(concept_pages: DataFrame, titles: DataFrame, text: str = "text") -> DataFrame:
    """(path, title): pages that link to a title, by their exploded links, not by all pairs."""
    links = concept_pages.select("path", F.explode(wikilinks(text)).alias("title"))
    return links.join(titles.select("title").distinct(), "title", "left_semi").select("path", "title").distinct()


def remove(sources: DataFrame, gone: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(left, trash): the sources without some hashes, and the removed rows stamped."""
    keys = gone.select("sha256").where("sha256 is not null").distinct()
    return sources.join(keys, "sha256", "left_anti"), sources.join(keys, "sha256", "left_semi").withColumn("removed_at", at)
