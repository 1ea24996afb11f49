"""Log lines as JSON, by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.formats import log_record


def records(lines: DataFrame) -> DataFrame:
    """``day`` and ``value``, a JSON object, of each log line (``line``, ``at``)."""
    return lines.select(F.to_date("at").alias("day"), log_record(F.col("line"), F.col("at")).alias("value"))


def append(lines: DataFrame, path: str) -> None:
    """Append log lines to a folder of text files by day; what is there stays."""
    records(lines).write.mode("append").partitionBy("day").text(path)


def sink(lines: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same for a stream of log lines; each is written once."""
    return records(lines).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")
