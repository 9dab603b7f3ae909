"""Archives of binary records in the shared folder, written and read by Spark alone.

Spark's text writer copies the bytes of a string as they are and ends each row with a separator, so
it writes binary records whose format has a fixed end mark. Its commit protocol keeps files of
failed or repeated tasks out, on any file system that Spark reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(df: DataFrame, record: str, path: str, end: str, per_file: int, compression: str = "none") -> None:
    """Writes the binary column `record` as files of at most `per_file` records, each followed by `end`."""
    rows = df.select(F.col(record).cast("string").alias("value"))
    rows.write.option("lineSep", end).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per archive: path, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
