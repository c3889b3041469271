"""Session helpers: reading tables, cutting lineage, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, NumericType, StringType

#: Rows and bytes of a side that may be broadcast; both are counted, never assumed.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is a local one a temporary folder of this
    machine is used; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.getCheckpointDir():
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder: computed once, survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame) -> bool:
    """Whether a table may be broadcast: its rows and the bytes of its texts are counted."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, NumericType):
            size = size + 8
        else:
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    rows, bytes_ = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and bytes_ <= BROADCAST_BYTES


def skew_lag(df: DataFrame, value: str, by: str, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row before in ``order`` among the rows of one ``by``.

    Rows are sorted by range, so that a value of ``by`` that holds most rows is spread over
    partitions; only the last row of each partition and ``by`` at its end is handed on, one
    row a partition. ``order`` must be unique within ``by``; rows
    whose ``by`` is null have nothing handed on.
    """
    placed = cut(df.orderBy(by, *order)).withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p", by).orderBy(*order)
    rows = placed.withColumn(out, F.lag(value).over(inside)).withColumn("_f", F.row_number().over(inside) == 1)
    ends = placed.groupBy("_p").agg(F.max_by(F.struct(F.col(by).alias("by"), F.col(value).alias("value")), F.struct(by, *order)).alias("_l"))
    last = [(r["_p"], r["_l"]["by"], r["_l"]["value"]) for r in ends.orderBy("_p").collect()]  # one row a partition
    carried = [(p, *last[k - 1][1:]) for k, (p, _, _) in enumerate(last) if k]
    schema = f"_p int, {by} {df.schema[by].dataType.simpleString()}, _v {df.schema[value].dataType.simpleString()}"
    before = df.sparkSession.createDataFrame(carried, schema).withColumn("_f", F.lit(True))
    rows = rows.join(F.broadcast(before), ["_p", by, "_f"], "left")
    return rows.withColumn(out, F.coalesce(out, "_v")).drop("_p", "_f", "_v")


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """``df`` with ``out``, the row's number from 1 in ``order`` (which should be unique). Rows
    are sorted by range and numbered in their partitions; what comes to the driver is one
    count a partition."""
    placed = cut(df.orderBy(*order)).withColumn("_p", F.spark_partition_id())
    sizes = [(r["_p"], r["_n"]) for r in placed.groupBy("_p").agg(F.count("*").alias("_n")).orderBy("_p").collect()]
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    before = df.sparkSession.createDataFrame(starts, "_p int, _b long")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.withColumn("_r", rank).join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.col("_r")).drop("_p", "_b", "_r")


def skew_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", like: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` where ``right`` has at most one row a key
    and a few keys of ``left`` may hold most of its rows.

    A ``right`` that is counted to be small is broadcast. Else keys of
    ``left`` with over 1/2000 of its rows are hot; there are at most 2000 of them, and
    their rows of ``right`` are broadcast, while all others are joined by shuffle. ``like``
    is a table whose keys are counted in place of those of ``left``: one that is at hand,
    where ``left`` has been made from it.
    """
    if is_small(right):
        return left.join(F.broadcast(right), key, how)
    counted = left if like is None else like
    total = counted.count()
    hot = (
        counted.groupBy(key).agg(F.count("*").alias("_n"))
        .where((F.col("_n") > total / 2000) & F.col(key).isNotNull()).select(key)
    )
    hot = cut(hot)  # at most 2000 rows, counted once
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    few = right.join(F.broadcast(hot), key, "left_semi")
    a = marked.where("_hot").drop("_hot").join(F.broadcast(few), key, how)
    b = marked.where("_hot is null").drop("_hot").join(right, key, how)
    return a.unionByName(b)
