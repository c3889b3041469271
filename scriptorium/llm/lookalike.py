"""Problem 3: text that looks the same in different characters.

Look-alike pairs of code points and short strings (width forms, compatibility forms,
kinds of blank, characters without ink, letters and signs of one shape) are closed
transitively by union-find. Each class gets one representative: the member most frequent
in the data or, where programs read the result on, its ASCII member first. Values are
decomposed, rewritten greedily (leftmost, longest) with one Aho-Corasick automaton over
all members, and composed again. Classes never join two different ASCII strings.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from scriptorium.session import cut, skew_lookup

# fixed values: letters and signs of one shape, the first of each line stands for it
SHAPES = (
    "aаɑα", "bЬ", "cсϲ", "dԁ", "eеҽ", "gɡց", "hһհ", "iіı", "jјϳ", "lӏ", "nո", "oоοօ", "pрρ", "qԛ", "sѕ", "uսυ",
    "vνѵ", "wԝ", "xх", "yуү",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "GԌ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜ", "NΝ", "OОΟՕ", "PРΡ", "QԚ", "SЅՏ", "TТΤ",
    "UՍ", "VѴ", "WԜ", "XХΧ", "YҮΥ", "ZΖ", "3З",
    "ΓГ", "ΠП", "ΦФ", "κкĸ", "εɛ", "дԀ",
    "-‐‑‒–−˗⁃﹘", "—―─", "'’‘‛′ʹʼˈ", "\"“”‟″", "‚¸", ":∶ː꞉", "!ǃ", "/⁄∕⧸", "~∼", "|∣ǀ│", "*∗⁎", "<‹", ">›",
    ".․", "·・‧∙⋅•", "°˚", "〇○◯", "口囗ロ", "二ニ", "力カ", "工エ", "卜ト", "夕タ", "八ハ",
)
_LOOKS = frozenset(("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>"))
_INKLESS = frozenset("͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍⠀")
_PLAIN = re.compile(r"[ -~]*\Z")


def inkless(ch: str) -> bool:
    n = ord(ch)
    return (unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\n\r\x0b\x0c\x85") or ch in _INKLESS or (
        0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF)


def _seeds(ch: str) -> Iterator[tuple[str, str]]:
    """Pairs that look the same, of one code point."""
    if inkless(ch):
        yield ch, ""
    elif ch in "\t\n\r\x0b\x0c\x85" or unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
        yield ch, " "
    else:
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0] in _LOOKS:
            other = "".join(chr(int(x, 16)) for x in parts[1:])
            if not (other.startswith(" ") and len(other) > 1):
                yield ch, other


class Looks:
    """The rewriting table. ``counts``: code points of the data and how often they occur.
    ``ascii_first``: the ASCII member of a class represents it, whatever its frequency."""

    def __init__(self, counts: dict[str, int], ascii_first: bool = True):
        self.parent: dict[str, str] = {}
        self.fixed: dict[str, str | None] = {}
        for line in SHAPES:
            for ch in line[1:]:
                self._join(line[0], ch)
        for ch in sorted(counts):
            for a, b in _seeds(ch):
                self._join(a, b)
        classes: dict[str, list[str]] = {}
        for x in self.parent:
            classes.setdefault(self._find(x), []).append(x)
        self.table: dict[str, str] = {}
        for root, members in classes.items():
            plain = self.fixed[root]
            long = [m for m in members if len(m) > 1]
            if plain is not None and (ascii_first or plain in ("", " ")):  # without ink, and blanks
                best = plain
            elif long and not ascii_first:  # what takes several code points to write is written out
                best = min(long, key=lambda m: (m != plain, m))
            else:
                best = min(members, key=lambda m: (-counts.get(m, 0), m != plain, m))
            for m in members:
                if m and m != best:
                    self.table[m] = best
        self._automaton()
        del self.parent, self.fixed

    @classmethod
    def universal(cls) -> Looks:
        """The table of all code points, without counts: the same in every session, for
        normal forms that are kept in a store."""
        seeded = (ch for ch in map(chr, (*range(0x20000), *range(0xE0000, 0xE0200))) if next(_seeds(ch), None))
        return cls(dict.fromkeys(seeded, 0))

    def _automaton(self) -> None:
        self.plain = not any(a.isascii() for a in self.table if a.isprintable())  # plain texts stay as they are
        self.automaton = ahocorasick.Automaton()
        for a, b in self.table.items():
            self.automaton.add_word(a, (len(a), b))
        self.automaton.make_automaton()

    def _find(self, x: str) -> str:
        if x not in self.parent:
            self.parent[x] = x
            self.fixed[x] = x if x.isascii() and x not in ("\t", "\n", "\r", "\x0b", "\x0c") and not (x and inkless(x[0])) else None
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _join(self, a: str, b: str) -> None:
        a, b = self._find(a), self._find(b)
        if a == b:
            return
        if self.fixed[a] is not None and self.fixed[b] is not None:
            return  # two ASCII strings never look the same
        self.parent[b] = a
        self.fixed[a] = self.fixed[a] if self.fixed[a] is not None else self.fixed[b]

    def rewrite(self, text: str) -> str:
        """The one form of all texts that look like this one."""
        if self.plain and _PLAIN.match(text):
            return text
        text = unicodedata.normalize("NFD", text)
        for _ in range(3):  # a decomposition may hold members of other classes
            out, at = [], 0
            for end, (n, new) in self.automaton.iter_long(text):
                out += (text[at : end + 1 - n], new)
                at = end + 1
            if not out:
                break
            text = unicodedata.normalize("NFD", "".join(out) + text[at:])
        return unicodedata.normalize("NFC", text)

    def __getstate__(self):
        return self.table

    def __setstate__(self, table):
        self.table = table
        self._automaton()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch["value"]:
            if text is not None:
                seen.update(text if text.isascii() else unicodedata.normalize("NFD", text))
    if seen:
        yield pd.DataFrame({"ch": list(seen), "n": list(seen.values())}, dtype=object)


def learn(values: DataFrame, column: str = "value", ascii_first: bool = True) -> Looks:
    """The table for the code points of all values. Counts are taken over all rows; what
    comes to the driver is one row a distinct code point, 1.1 million at the very most."""
    counted = (
        values.select(F.col(column).alias("value")).mapInPandas(_count, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))
    )
    return Looks({r["ch"]: r["n"] for r in counted.collect()}, ascii_first)


def rewriter(looks: Looks, spark: SparkSession):
    """A column function: string -> string, null stays null."""
    shared = spark.sparkContext.broadcast(looks)

    @pandas_udf(StringType())
    def rewritten(values: pd.Series) -> pd.Series:
        table = shared.value
        return values.map(lambda x: None if x is None else table.rewrite(x))

    return rewritten


def looked_up(values: DataFrame, group: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """``(*group, _k, _v, _c)``: distinct keys and values with the one form of all that look
    alike. Null keys and null or blank (also inkless) values are left out."""
    looks = learn(values, value, ascii_first=False)
    rows = values.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(*group, F.col(key).alias("_k"), F.col(value).alias("_v"))
    # as if not deterministic: else the filter, and the rewriting with it, would also run below the distinct
    form = rewriter(looks, values.sparkSession).asNondeterministic()
    return cut(rows.distinct().withColumn("_c", form("_v")).where("trim(_c) <> ''"))


def _mixed(rows: DataFrame, by: list[str]) -> DataFrame:
    """The distinct strings of the forms that are written in several ways."""
    strings = rows.select(*by, "_v").distinct()
    return strings.join(strings.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), by, "left_semi")


def look_classes(values: DataFrame, group: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """``(*group, key, class_key, strings, links)``: one row for each key of a form that is
    written in several ways: the smallest key of its class, how many strings the class has,
    and how many other rows of the class are written differently. A class that holds a third
    of all rows makes as many rows as it has keys, never pairs."""
    rows = looked_up(values, group, key, value).withColumn("_id", F.xxhash64(*group, "_c")).withColumn("_s", F.xxhash64(*group, "_v"))
    per = rows.groupBy("_id", "_s").agg(F.count("*").alias("_n"), F.min("_k").alias("_k"))
    classes = per.groupBy("_id").agg(F.count("*").alias("strings"), F.sum("_n").alias("_all"), F.min("_k").alias("class_key")).where("strings > 1")
    found = skew_lookup(skew_lookup(rows, classes, "_id"), per.select("_s", "_n"), "_s")
    return found.select(*group, F.col("_k").alias("key"), "class_key", "strings", (F.col("_all") - F.col("_n")).alias("links"))


def same_look(values: DataFrame, group: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """``(*group, key_a, key_b)``: pairs of different keys of one group whose values differ
    as strings and look the same; ``key_a`` is the smaller in plain string order.

    Null keys and null or blank (also inkless) values have no pairs; repeated rows count
    once; no rows, no pairs. Equal strings are first collapsed, so the join that finds
    look-alikes runs on distinct strings, and rows are joined only to differing ones. The
    pairs of two strings that many rows have grow with both; ``look_classes`` has the same
    links without pairs.
    """
    rows = looked_up(values, group, key, value)
    by = [*group, "_c"]
    strings = _mixed(rows, by)
    pairs = strings.withColumnRenamed("_v", "_va").join(strings.withColumnRenamed("_v", "_vb"), by).where("_va < _vb")
    rows = rows.join(strings, [*by, "_v"], "left_semi")
    one = rows.select(*by, F.col("_v").alias("_va"), F.col("_k").alias("_ka"))
    two = rows.select(*by, F.col("_v").alias("_vb"), F.col("_k").alias("_kb"))
    found = pairs.join(one, [*by, "_va"]).join(two, [*by, "_vb"]).where("_ka <> _kb")
    return found.select(*group, F.least("_ka", "_kb").alias("key_a"), F.greatest("_ka", "_kb").alias("key_b")).distinct()
