"""The warehouse: one Parquet folder a table, JSON and JSON lines read tolerantly."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        """The folder of a table; a name that would leave the root is an error."""
        if name in ("", ".", "..") or "/" in name or "\\" in name:
            raise ValueError(f"no table name: {name!r}")
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        """Whether the table's folder is there; any other fault of the storage is an error."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table; with a ``schema`` an empty one where it was never written."""
        if schema is None:
            return self.spark.read.parquet(self.path(name))
        if not self.has(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def replace(self, name: str, df: DataFrame, partition: str) -> None:
        """Writes partitions; those of other values stay as they are."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(self.path(name))

    def write(self, name: str, df: DataFrame, partition: str | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(partition) if partition else w).parquet(self.path(name))

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows, stamped with the time where they have none."""
        rows = df if "at" in df.columns else df.withColumn("at", F.current_timestamp())
        rows.write.mode("append").parquet(self.path(name))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt): lines that parse, and those that do not."""
    parsed = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE"})
    rows = spark.read.text(path).where("trim(value) <> ''").select(parsed.alias("r")).select("r.*")
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("_corrupt_record")


def read_extraction(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes, edges and hyperedges of deliveries in JSON files; ``from`` and ``to`` name ends too."""
    schema = (
        "nodes array<struct<id string, label string, file_type string, source_file string, attrs map<string,string>>>, "
        "edges array<struct<source string, target string, `from` string, `to` string, relation string, confidence string, confidence_score double>>, "
        "hyperedges array<struct<id string, label string, members array<string>>>"
    )
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    out = {k: raw.select(F.inline(k)) for k in ("nodes", "hyperedges")}
    e = raw.select(F.posexplode("edges").alias("seq", "e"))
    out["edges"] = e.select(F.coalesce("e.source", "e.from").alias("source"), F.coalesce("e.target", "e.to").alias("target"),
                            "e.relation", "e.confidence", "e.confidence_score", F.col("seq").cast("long").alias("seq"))
    return out


def read_ignore(folder: str, name: str = ".ignore") -> list[tuple[str, str]]:
    """(folder, pattern) of the ignore files in a folder and those above it, up to a repository's root."""
    at = Path(folder).absolute()
    above = [at, *at.parents]
    roots = [k for k, x in enumerate(above) if (x / ".git").is_dir()]
    files = [x / name for x in above[: roots[0] + 1 if roots else len(above)]]
    lines = [(str(f.parent), x.strip()) for f in files if f.is_file() for x in f.read_text(encoding="utf-8").splitlines()]
    return [(where, x) for where, x in lines if x and not x.startswith("#")]


def tolerant(text: str) -> dict:
    """A JSON object; anything else is empty."""
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}
