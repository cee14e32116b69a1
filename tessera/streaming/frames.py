"""Frames decoded as they arrive: a stream of encoded images to a stream of planes.

The decoder keeps no state between frames, so each micro-batch decodes alone and the
checkpoint of the query is all that a restart needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import codec


def decoded_frames(spark: SparkSession, path: str, files_per_batch: int = 3) -> DataFrame:
    """Planes of the encoded images that appear as parquet files under a path."""
    source = spark.readStream.schema(codec.ENCODED).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return codec.decode(source)


def write_frames(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what there is to parquet, once each, and stops."""
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
