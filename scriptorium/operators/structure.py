"""Structure of markdown texts: headings, tables, lists, metrics, key terms.

Texts are exploded to lines once; runs of lines are found with windows inside one
document (gaps and islands), so nothing is shuffled but by document.
Null texts have no lines; an empty text has one empty line and no structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: metric patterns, term stop characters, acronyms that are no terms
METRICS = (
    r"[≥≤><]?\s*(\d+(?:\.\d+)?)\s*%",
    r"[¥￥]?\s*(\d+(?:\.\d+)?)\s*(?:元|万元|亿元|万|亿)",
    r"(\d+(?:\.\d+)?)\s*(?:人|年|个|台|课时|天|小时|分钟|所|间|套|册|节)",
)
TERM_STOP = "的了是在有和与及等也都对为不到要这那就被从而但或如果可以一个人我你他她它们上下中大小多少"
NO_TERMS = ("MD", "PDF", "HTML", "HTTP", "URL", "API")
TERM_PATTERNS = (r"[\x{4e00}-\x{9fff}]{2,6}", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", r"\b[A-Z]{2,6}\b")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, raw): every line of every text, numbered from 1."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    return rows.select(key, (F.col("pos") + 1).alias("line"), "raw")


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, level, title): lines that start with one to six signs and say something;
    no blank is needed after the signs, fences are not looked at."""
    marks = F.regexp_extract("s", "^(#+)", 1)
    rows = lines(docs, key, text).select(key, "line", strip("raw").alias("s")).where(F.col("s").startswith("#"))
    rows = rows.select(key, "line", F.length(marks).alias("level"), strip(F.expr("substring(s, length(regexp_extract(s, '^(#+)', 1)) + 1)")).alias("title"))
    return rows.where("level between 1 and 6 and title <> ''")


def tables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, columns, rows): a header line of pipes, a rule line under it, and the pipe
    lines that follow. A run of pipe lines holds at most one table."""
    by = Window.partitionBy(key).orderBy("line")
    rows = lines(docs, key, text).select(key, "line", strip("raw").alias("s"))
    rows = rows.withColumn("pipe", F.col("s").startswith("|"))
    rows = rows.withColumn("island", F.sum((~F.col("pipe")).cast("int")).over(by)).withColumn("next", F.lead("s").over(by))
    head = F.col("pipe") & F.col("next").startswith("|") & F.col("next").contains("---")
    found = rows.where("pipe").groupBy(key, "island").agg(
        F.min(F.when(head, F.col("line"))).alias("line"), F.max("line").alias("last"),
        F.min_by(F.when(head, F.col("s")), F.when(head, F.col("line"))).alias("header"))
    cells = F.filter(F.transform(F.split("header", r"\|"), strip), lambda x: x != "")
    return found.where("line is not null").select(key, "line", cells.alias("columns"), (F.col("last") - F.col("line") - 1).alias("rows"))


def lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, type, items, depth): runs of items; blank lines do not end a list."""
    rows = lines(docs, key, text).withColumn("s", strip("raw")).where("s <> ''")
    kind = F.when(F.col("s").rlike(r"^[-*]\s+\S"), "unordered").when(F.col("s").rlike(r"^\d+\.\s+\S"), "ordered").otherwise("other")
    rows = rows.withColumn("type", kind)
    a, b = Window.partitionBy(key).orderBy("line"), Window.partitionBy(key, "type").orderBy("line")
    rows = rows.withColumn("island", F.row_number().over(a) - F.row_number().over(b)).where("type <> 'other'")
    indent = F.length(F.regexp_extract("raw", r"^(\s*)", 1))
    depth = F.when(F.col("type") == "unordered", F.floor(indent / 2) + 1).otherwise(1)
    return rows.groupBy(key, "type", "island").agg(
        F.min("line").alias("line"), F.count("*").alias("items"), F.max(depth).cast("int").alias("depth")).drop("island")


def metrics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, value, line): percentages, amounts and counts with units; the first line of each
    value of a document. The minimum combines on the map side."""
    rows = lines(docs, key, text).where(F.col("raw").rlike(r"\d"))
    every = F.array_union(F.array(), F.flatten(F.array(*[F.regexp_extract_all("raw", F.lit(p), F.lit(0)) for p in METRICS])))
    return rows.select(key, "line", F.explode(every).alias("value")).groupBy(key, strip("value").alias("value")).agg(F.min("line").alias("line"))


def key_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", top: int = 30) -> DataFrame:
    """(key, term, n): terms found at least twice among the ``top`` most frequent; Chinese
    runs first, then capitalised phrases, then acronyms, then order of appearance."""
    found = None
    for channel, pattern in enumerate(TERM_PATTERNS):
        part = docs.where(F.col(text).isNotNull()).select(
            key, F.lit(channel).alias("channel"), F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "term"))
        found = part if found is None else found.unionByName(part)
    real = ~((F.col("channel") == 0) & F.col("term").rlike(f"^[{TERM_STOP}]+$")) & ~((F.col("channel") == 2) & F.col("term").isin(list(NO_TERMS)))
    counted = found.where(real).groupBy(key, "term").agg(F.count("*").alias("n"), F.min(F.struct("channel", "pos")).alias("_f"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "_f"))
    return counted.withColumn("_r", rank).where((F.col("_r") <= top) & (F.col("n") >= 2)).select(key, "term", "n")


def structure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with all of it as nested arrays; documents without structure too."""
    ids = docs.where(F.col(text).isNotNull()).select(key).distinct()
    parts = {
        "headings": headings(docs, key, text).select(key, F.struct("line", "level", "title").alias("x")),
        "tables": tables(docs, key, text).select(key, F.struct("line", "columns", "rows").alias("x")),
        "lists": lists(docs, key, text).select(key, F.struct("line", "type", "items", "depth").alias("x")),
        "metrics": metrics(docs, key, text).select(key, F.struct("line", "value").alias("x")),
        "key_terms": key_terms(docs, key, text).select(key, F.struct(F.negative("n").alias("n"), "term").alias("x")),
    }
    for name, part in parts.items():
        ids = ids.join(part.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias(name)), key, "left")
    return ids
