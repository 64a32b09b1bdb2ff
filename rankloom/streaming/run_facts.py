"""Run facts as a stream: new result files become rows of the run table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.plans import leaderboard
from rankloom.sources import results


def arriving_files(spark: SparkSession, folder: str, include_smoke: bool = False) -> DataFrame:
    """(file_id, file_path, created_at, body) of each JSON file of a folder, once; the id is a hash of the path."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    path = F.col("_metadata.file_path")
    got = files.select(F.xxhash64(path).alias("file_id"), path.alias("file_path"), F.col("_metadata.file_modification_time").alias("created_at"), F.col("value").alias("body"))
    return got.where(results.keep_path(F.col("file_path"), include_smoke))


def append_runs(files: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Normalises each micro-batch and writes it to a folder of its own below `table`, so that a repeated batch replaces
    itself and no row is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        leaderboard.runs(results.facts(batch)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    w = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
