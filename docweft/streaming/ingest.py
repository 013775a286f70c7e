"""Documents as a stream of files: parsed a micro-batch at a time, upserted into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweft.config import Config
from docweft.operators import vectors
from docweft.plans import pipelines
from docweft.sources import files


def file_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """``path, filename, ext, content`` of new files in a landing folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(path)
    return raw.where(files.is_supported("path")).select("path", files.file_name("path").alias("filename"), files.extension("path").alias("ext"), "content", "modificationTime")


def first_of_content(stream: DataFrame, within: str = "1 day") -> DataFrame:
    """Without files whose bytes came already within a time; older state is dropped by the watermark."""
    return stream.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["digest"])


def ingest(spark: SparkSession, path: str, checkpoint: str, cfg: Config = Config(), files_a_batch: int = 1000) -> StreamingQuery:
    """Index what is there and end (``availableNow``); run it again, or on a schedule, for what comes later.

    A batch that is repeated after a failure upserts the same ids, so nothing is stored twice.
    """

    def store(batch: DataFrame, _: int) -> None:
        e, _errors = files.parse(batch.select("path", "filename", "ext", "content"), cfg.parsing.parser)
        done = pipelines.from_elements(e, batch.select(F.col("path").alias("doc_id"), "filename"), cfg)
        vectors.Store(batch.sparkSession, cfg.store.path, cfg.store.collection).upsert(pipelines.embedded(done.chunks, cfg))

    return file_stream(spark, path, files_a_batch).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
