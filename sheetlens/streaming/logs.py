"""Log folder as a stream of parsed lines (``readStream.text``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.operators.logs import FILE_GLOB, parse_lines


def stream_logs(spark: SparkSession, directory: str, glob: str = FILE_GLOB, schema=None) -> DataFrame:
    """Streaming DataFrame of parsed lines of files arriving in ``directory``
    (``schema`` adds partition columns of a partitioned log folder)."""
    reader = spark.readStream.option("pathGlobFilter", glob)
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.text(directory).withColumn("file", F.col("_metadata.file_path"))
    return parse_lines(raw)

