"""Which strings contain which, without comparing all pairs.

A needle of three letters or more is met in the hay by its rarest run of three letters (by
the number of hay strings that have it), a shorter one by itself; so a run that most
strings share leads to none of the pairs, unless a needle has no other. Where all needles
may be sent to the workers, ``held`` streams texts through an automaton of them instead, and
no text is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import BROADCAST_BYTES, cut

RUN = 3
#: Letters of the needles of one automaton, some 50 bytes each in a worker.
SHARD = 4_000_000


def _runs(column: str, size: int) -> Column:
    """The distinct runs of a string, each read once: an empty match at every letter looks ahead."""
    return F.array_distinct(F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def containing(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle, hay): every string of ``hay`` (hay) with every string of ``needles`` (needle) in
    it, each pair once. Null and empty strings on either side have no pair. Runs go with a
    hash of their string; strings that share one by chance are told apart at the end."""
    needles = cut(needles.select("needle").where("needle <> ''").distinct())
    hay = cut(hay.select("hay").where("hay <> ''").distinct().withColumn("_h", F.xxhash64("hay")))
    short = needles.where(F.length("needle") < RUN)
    runs = hay.select("_h", F.explode(F.concat(*[_runs("hay", size) for size in range(1, RUN + 1)])).alias("_g"))
    long_runs = hay.select("_h", F.explode(_runs("hay", RUN)).alias("_g"))
    asked = needles.where(F.length("needle") >= RUN).select("needle", F.explode(_runs("needle", RUN)).alias("_g"))
    # only runs that some needle has are counted; one that the hay does not have leaves its needle without a pair
    often = long_runs.join(asked.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count("*").alias("_n"))
    rare = asked.join(often, "_g", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_r"))
    keys = rare.where("_r.n > 0").select("needle", F.col("_r.g").alias("_g")).unionByName(short.select("needle", F.col("needle").alias("_g")))
    met = runs.join(cut(keys), "_g").select("needle", "_h").distinct()
    return met.join(hay, "_h").where(F.contains("hay", "needle")).select("needle", "hay")


_LAST: dict[str, ahocorasick.Automaton] = {}  # the automaton a worker used last


def _search(token: str, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _LAST:
            _LAST.clear()
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, word in enumerate(words.value):
                made.add_word(word, k)
            made.make_automaton()
            _LAST[token] = made
        automaton, names = _LAST[token], words.value
        for batch in batches:
            paths, found = [], []
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = {k for _, k in automaton.iter(text)}
                paths += [path] * len(own)
                found += [names[k] for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], ["path", "needle"])

    return run


def held(texts: DataFrame, needles: DataFrame, most: int = BROADCAST_BYTES, shard: int = SHARD) -> DataFrame:
    """(path, needle): every text of ``texts`` (path, hay) with every string of ``needles`` (needle)
    in it. Null and empty strings have no pair. Needles of up to ``most`` bytes, counted, are
    sent to the workers; an automaton holds those of ``shard`` letters, and texts are read once
    for each. More needles meet texts by their runs."""
    needles = cut(needles.select("needle").where("needle <> ''").distinct())
    texts = texts.select("path", "hay").where("hay <> ''")
    size = needles.agg(F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()[0]
    if size > most:
        return containing(needles, texts.select("hay")).join(texts, "hay").select("path", "needle")
    words, shards, room = sorted(r["needle"] for r in needles.toLocalIterator()), [[]], shard  # in order, since common beginnings are kept once
    for word in words:
        if len(word) > room and shards[-1]:
            shards.append([])
            room = shard
        shards[-1].append(word)
        room -= len(word)
    found = None
    for own in shards if words else []:
        part = texts.mapInArrow(_search(uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(own)), "path string, needle string")
        found = part if found is None else found.unionByName(part)
    return texts.sparkSession.createDataFrame([], "path string, needle string") if found is None else found
