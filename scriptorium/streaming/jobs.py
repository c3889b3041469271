"""Structured Streaming: the inbox, and windows over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from scriptorium.functions.paths import stem_of

#: The schema of uploads that arrive in the inbox.
UPLOADS = StructType([
    StructField("upload_id", LongType()), StructField("sha256", StringType()), StructField("original_filename", StringType()),
    StructField("uploaded_at", TimestampType()), StructField("chars", LongType()),
])


def uploads(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(UPLOADS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def classify_stream(stream: DataFrame) -> DataFrame:
    """(stem, sha256, upload_id, status) of each upload, in order of arrival within a stem:
    skipped if the stem's last hash is the same, updated if it is another, else new. State is
    one hash a stem. Rows without hash or name fail and keep no state."""
    keyed = stream.select("upload_id", "sha256", F.coalesce(stem_of("original_filename"), F.lit("")).alias("stem"))

    def step(key, batches, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("upload_id", kind="stable")
        out = []
        for sha in pdf["sha256"]:
            if sha is None or not key[0]:
                out.append("failed")
                continue
            out.append("skipped" if sha == last else "new" if last is None else "updated")
            last = sha
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"stem": key[0], "sha256": pdf["sha256"], "upload_id": pdf["upload_id"], "status": out})

    return keyed.groupBy("stem").applyInPandasWithState(
        step, "stem string, sha256 string, upload_id long, status string", "sha string", "append", "NoTimeout")


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that has arrived, then stop; exactly once by the checkpoint."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def merge_into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Uploads kept once by hash, the one of the first batch that has it: each batch is written
    under its own number without the hashes of those before, so a batch that runs again
    overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("sha256 is not null").dropDuplicates(["sha256"])
        if number:
            kept = batch.sparkSession.read.schema("sha256 string, batch long").parquet(path)
            rows = rows.join(kept.where(F.col("batch") < number).select("sha256"), "sha256", "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str = "at", kind: str = "kind", size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events of each kind in tumbling or sliding windows; rows later than ``late`` are dropped in a stream."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return rows.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def sessions(events: DataFrame, key: str, at: str = "at", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each key: rows less than ``gap`` apart."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
