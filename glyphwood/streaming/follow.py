"""An index that follows a stream of documents.

New and changed documents arrive as rows of files; each micro-batch is one publication, so a restart repeats a batch at
most, and repeating one changes nothing: a document whose fingerprint is known is left as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from glyphwood.config import Config, EngineError
from glyphwood.functions import text as t
from glyphwood.operators import semantic
from glyphwood.plans import ingest as plans
from glyphwood.sources.store import Store


def sources_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of (file, content) as they arrive in a folder; the version of a row is its file's time."""
    rows = spark.readStream.schema("file string, content string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.select("file", "content", F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path")).alias("version"))


def changed(batch: DataFrame, store: Store) -> DataFrame:
    """The last version of each document of a batch, by its column `version`, without those that the index has in this
    very version. A stream without versions can't say which of several is the last, so its batches may hold each document
    once only."""
    if "version" in batch.columns:
        latest = F.max_by("content", F.struct("version", F.sha2("content", 256)))
        one = batch.groupBy("file").agg(latest.alias("content"))
    else:
        one = batch.select("file", "content").distinct()
        twice = one.groupBy("file").count().filter("count > 1").select("file").limit(1).collect()
        if twice:
            raise EngineError("no_version", f"several texts of {twice[0][0]} in one batch, and no version column")
    if store.current() is None:
        return one
    had = store.table("docs").select("file", F.col("fingerprint.sha256").alias("_had"))
    mine = F.sha2(t.blank_to_empty(F.col("content")), 256)
    return one.join(had, "file", "left").filter(~mine.eqNullSafe(F.col("_had"))).drop("_had")


def follow(stream: DataFrame, store: Store, config: Config, checkpoint: str, model: semantic.Summariser = semantic.extractive, once: bool = True) -> StreamingQuery:
    """Starts the query. once: takes what there is and ends."""

    def step(batch: DataFrame, _: int) -> None:
        fresh = changed(batch, store).persist()
        try:
            if fresh.limit(1).count():
                plans.ingest(store, fresh, config, model, "modify")
        finally:
            fresh.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
