"""Frontmatter and other parts of wiki pages, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

BLOCK = r"(?s)\A---\n(.*?)\n---(?:\n|\z)"


def frontmatter(text: Column | str) -> Column:
    """Map of the ``key: value`` lines of the block at the start of a text; a text without a
    closed block gives an empty map. Outer quotes go, a later line of one key wins."""
    block = F.regexp_extract(text, BLOCK, 1)
    rows = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[^:]+:"))
    pair = lambda x: F.struct(
        F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"),
        F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), "^[\"']|[\"']$", "").alias("value"))
    pairs = F.transform(rows, pair)
    n = F.size(pairs)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def items_of(value: Column) -> Column:
    """The entries of an inline list ``[a, b]``; anything else has none."""
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    cut = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.filter(cut, lambda x: x != "")


def body_of(text: Column | str) -> Column:
    """The text after its frontmatter."""
    return F.regexp_replace(text, r"(?s)\A---.*?\n---", "")


def title_of(text: Column | str) -> Column:
    """The first heading of level one; empty if there is none."""
    return F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1)


def words_of(text: Column | str) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def wikilinks(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]"), F.lit(1)))


def safe_title(title: Column | str) -> Column:
    """Without characters files must not have, 80 characters at most."""
    return F.substring(F.trim(F.regexp_replace(title, r'[\\/*?:"<>|]', "")), 1, 80)


def sanitise_label(label: Column | str) -> Column:
    return F.substring(F.regexp_replace(label, r"[\x00-\x1f\x7f]", ""), 1, 256)


@pandas_udf(StringType())
def fold_accents(values: pd.Series) -> pd.Series:
    """Decomposed and without combining marks; null stays null."""

    def one(x):
        if x is None or x.isascii():
            return x
        return "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch))

    return values.map(one)
