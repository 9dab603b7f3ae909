"""Where records and texts come from and go to: projects of Parquet, text and PDF files, JSON."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import Other

RECORD_SCHEMA = "id string, vector array<float>, source string, text string"


class Projects:
    """Named sets of records under one folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", name) or set(name) == {"."}:
            raise Other(f"not a project name: {name!r}")
        return f"{self.base}/{name}/records"

    def _files(self, path: str) -> tuple:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _there(self, path: str) -> bool:
        files, target = self._files(path)
        return files.exists(target)

    def _current(self, name: str) -> str | None:
        """The folder of the records: that of the last save which ended, or of the one before while the last was putting its own in place."""
        self.path(name)
        return next((p for p in (self.path(name), f"{self.base}/{name}/_old") if self._there(p)), None)

    def remove(self, path: str) -> None:
        files, target = self._files(path)
        files.delete(target, True)

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def save(self, name: str, records: DataFrame) -> None:
        """Replaces the project. The records may come from the project itself, so a new folder is written first.

        The old one is set aside until the new one is in place, so a crash at any point leaves one of them to load.
        """
        target, fresh, aside = self.path(name), f"{self.base}/{name}/_new", f"{self.base}/{name}/_old"
        records.write.mode("overwrite").parquet(fresh)
        files, new = self._files(fresh)
        _, now = self._files(target)
        _, old = self._files(aside)
        if files.exists(now):
            files.delete(old, True)
            if not files.rename(now, old):
                raise Other(f"could not move {target} to {aside}")
        if not files.rename(new, now):
            raise Other(f"could not move {fresh} to {target}")
        files.delete(old, True)

    def load(self, name: str, schema: str = RECORD_SCHEMA) -> DataFrame:
        """The records; none, with the given schema, if there is no such project."""
        found = self._current(name)
        return self.spark.read.parquet(found) if found else self.spark.createDataFrame([], schema)


def read_texts(spark: SparkSession, path: str, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, text) of each file; files that end in .pdf need a function that gets their text."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    is_pdf = F.lower("path").endswith(".pdf")
    plain = files.where(~is_pdf).select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path")))).alias("text"))
    if pdf_text is None:
        if files.where(is_pdf).limit(1).count():
            raise Other("PDF files need a function that extracts their text")
        return plain

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(pdf_text)

    return plain.unionByName(files.where(is_pdf).select("path", extract("content").alias("text")))


def to_json(records: DataFrame) -> DataFrame:
    """A column `json` with one record a row."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("json"))


def from_json(lines: DataFrame, column: str = "json") -> DataFrame:
    """Records with their metadata as a VARIANT; missing metadata is an empty object."""
    v = F.parse_json(F.col(column))
    meta = F.coalesce(F.variant_get(v, "$.metadata", "variant"), F.parse_json(F.lit("{}")))
    return lines.select(F.variant_get(v, "$.id", "string").alias("id"), F.variant_get(v, "$.vector", "array<float>").alias("vector"), meta.alias("metadata"))


def to_variant(records: DataFrame, metadata: list[str]) -> DataFrame:
    """Typed metadata columns as one VARIANT column, without the fields that are null."""
    pairs = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, metadata)), F.array(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in metadata])), lambda _, j: j != "{}")
    fields = F.transform(F.map_entries(pairs), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"].substr(F.lit(6), F.length(e["value"]) - 6)))
    return records.withColumn("metadata", F.parse_json(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))).drop(*metadata)
