"""Posting lists of metadata: one row for each record, field and value that can be looked up.

Strings, numbers (integers as doubles) and booleans are posted; lists and nulls are not. The lists are a
DataFrame of (field, kind, s, n, b, id), so lookups are filters that Parquet can push down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Postings:
    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def of(cls, records: DataFrame, fields: list[str] | None = None, id_column: str = "id") -> Postings:
        """Posts typed metadata columns."""
        entries = []
        for f in records.schema.fields:
            if f.name == id_column or fields is not None and f.name not in fields:
                continue
            kind = "string" if isinstance(f.dataType, T.StringType) else "bool" if isinstance(f.dataType, T.BooleanType) else "number" if isinstance(f.dataType, T.NumericType) else None
            if kind:
                c, none = F.col(f"`{f.name}`"), F.lit(None)
                entries.append(F.struct(
                    F.lit(f.name).alias("field"), F.lit(kind).alias("kind"), (c if kind == "string" else none).cast("string").alias("s"),
                    (c if kind == "number" else none).cast("double").alias("n"), (c if kind == "bool" else none).cast("boolean").alias("b"), c.isNotNull().alias("there"),
                ))
        if not entries:
            return cls(records.sparkSession.createDataFrame([], "field string, kind string, s string, n double, b boolean, id string"))
        rows = records.select(F.col(id_column).alias("id"), F.explode(F.array(*entries)).alias("e")).where("e.there")
        return cls(rows.select("e.field", "e.kind", "e.s", "e.n", "e.b", "id"))

    def index(self, records: DataFrame, **how) -> Postings:
        """With the entries of further records."""
        return Postings(self.df.unionByName(Postings.of(records, **how).df))

    def deindex(self, entries: DataFrame) -> Postings:
        """Without the entries of these (id, field) pairs."""
        return Postings(self.df.join(entries.select("id", "field").distinct(), ["id", "field"], "left_anti"))

    def clear_field(self, field: str) -> Postings:
        return Postings(self.df.where(F.col("field") != field))

    def _ids(self, field: str, condition) -> DataFrame:
        return self.df.where((F.col("field") == field) & condition).select("id")

    def string(self, field: str, value: str) -> DataFrame:
        return self._ids(field, F.col("s") == value)

    def string_prefix(self, field: str, value: str) -> DataFrame:
        return self._ids(field, F.startswith("s", F.lit(value)))

    def string_contains(self, field: str, value: str) -> DataFrame:
        return self._ids(field, F.contains("s", F.lit(value)))

    def string_suffix(self, field: str, value: str) -> DataFrame:
        return self._ids(field, F.endswith("s", F.lit(value)))

    def number(self, field: str, value: float) -> DataFrame:
        return self._ids(field, F.col("n") == float(value))

    def number_above(self, field: str, value: float) -> DataFrame:
        """Ascending by value."""
        return self.df.where((F.col("field") == field) & (F.col("n") > float(value))).orderBy("n", "id").select("id")

    def number_below(self, field: str, value: float) -> DataFrame:
        """Ascending by value."""
        return self.df.where((F.col("field") == field) & (F.col("n") < float(value))).orderBy("n", "id").select("id")

    def boolean(self, field: str, value: bool) -> DataFrame:
        return self._ids(field, F.col("b") == value)

    def with_field(self, field: str) -> DataFrame:
        return self._ids(field, F.lit(True)).distinct()

    def field_counts(self) -> DataFrame:
        """kind, and how many fields have entries of it."""
        return self.df.groupBy("kind").agg(F.count_distinct("field").alias("fields"))
