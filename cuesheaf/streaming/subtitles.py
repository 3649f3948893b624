"""Subtitle files as a stream: the stream's checkpoint takes the place of a resume file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuesheaf.plans.pipelines import bilingual_subtitles


def translate_stream(spark: SparkSession, source: str, memory: DataFrame, lexicon: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Translate each new subtitle file under `source` once; ends when all present files are done.

    One media is one file, so the windows of a media lie inside a batch. A batch writes the folder of
    its own number, over what a failed try of it may have left.
    """
    files = spark.readStream.format("text").option("wholetext", "true").load(source)
    files = files.select(F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("content"))

    def write(batch: DataFrame, number: int) -> None:
        bilingual_subtitles(batch, memory, lexicon).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
