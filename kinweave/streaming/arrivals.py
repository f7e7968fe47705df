"""Extension: interchange files that arrive in a folder, parsed as a stream.

The line parser is stateless, so the stream writes lines exactly once per file; records
and events are shaped from the stored lines, as their windows need whole files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.sources.gedcom import lines


def arriving_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Streaming (file, line_no, level, xref, tag, value) of the files of a folder."""
    raw = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines(raw.select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def store_lines(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes all files that have arrived, then stops."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
