"""A collection of records: id, vector of one dimension, metadata.

A collection wraps a DataFrame and never changes it: each change gives a new collection, and an index that was
built goes with it. Metadata is either ordinary columns or one VARIANT column named ``metadata``.

Repeated ids. Records inserted with on_duplicate="append" stand beside older ones of their id; a hidden number
tells which came later. `get` gives the newest record of an id, `delete` and `update` change that one alone, and
after a delete the one before it is the newest. Of repeated ids in one batch the last in order of the
`order` column (of the vectors, if there is none) is the newest. Records that carry no number, because a table
with repeated ids was passed in, are one record to `delete` and `update`, and `get` gives that of the greatest vector.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, EmptyVector, NotFound
from nearfield.functions.metrics import Distance, Metric
from nearfield.operators import ann, knn
from nearfield.plans.compile import Fields, TypedFields, VariantFields, matching_ids, to_column
from nearfield.plans.filters import Filter, parse

#: Records from which index="auto" searches approximately.
EXACT_BELOW = 1000
#: The hidden column that numbers records with repeated ids.
SEQ = "_nearfield_seq"


def records_from(df: DataFrame, *, id: str = "id", vector: str = "vector", metadata: Sequence[str] = ()) -> DataFrame:  # noqa: A002
    """Any table as records: id as a string, vector as floats, metadata columns as they are."""
    return df.select(F.col(id).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"), *metadata)


class Collection:
    def __init__(self, records: DataFrame, *, index: str = "exact", params: ann.Params | None = None):
        if index not in ("exact", "ivf", "auto"):
            raise ValueError("index is one of exact, ivf, auto")
        self.df, self.index, self.params = records, index, params
        self._dimension: int | None = None
        self._ivf: ann.IvfIndex | None = None

    def _with(self, df: DataFrame, index: ann.IvfIndex | None = None) -> Collection:
        out = Collection(df, index=self.index, params=self.params)
        out._ivf = index
        return out

    def _changed(self, keep: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> Collection:
        """With the rows that a function leaves, and more rows; the index, if there is one, changes alike."""
        df = keep(self.df)
        index = self._ivf and self._ivf.kept(keep)
        if more is not None:
            df = df.unionByName(more, allowMissingColumns=True)
            index = index and index.with_records(more)
        return self._with(df, index)

    # What is there

    @property
    def fields(self) -> Fields:
        return VariantFields("metadata") if dict(self.df.dtypes).get("metadata") == "variant" else TypedFields(self.df.schema)

    @property
    def dimension(self) -> int:
        """Of the vectors, which must agree; 0 if there are none. Looked up once, from the sizes alone."""
        if self._dimension is None:
            low, high = self.df.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
            if low != high:
                raise DimensionMismatch(high, low)
            self._dimension = max(0, low or 0)
        return self._dimension

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def records(self) -> DataFrame:
        return self.df.drop(SEQ)

    def get(self, record_id: str) -> Row | None:
        """The newest record of an id; the filter on id reaches the scan."""
        found = self.df.where(F.col("id") == record_id)
        order = [F.col(SEQ).desc_nulls_last()] if SEQ in self.df.columns else []
        return found.orderBy(*order, F.col("vector").desc_nulls_last()).drop(SEQ).first()

    # Changes

    def _checked(self, rows: DataFrame) -> DataFrame:
        """The rows, if all of their vectors fit; one pass over their sizes."""
        low, high, null = rows.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count_if(F.col("vector").isNull())).first()
        if null or low is not None and low <= 0:
            raise EmptyVector
        if low is None:
            return rows
        expected = self.dimension or low
        for n in (low, high):
            if n != expected:
                raise DimensionMismatch(expected, n)
        return rows

    def insert(self, rows: DataFrame, *, on_duplicate: str = "replace", order: str | None = None) -> Collection:
        """Adds records, all or none. A known id is replaced, or with on_duplicate="append" kept beside.

        Of an id that a batch has several times, the record with the largest `order` is the last.
        """
        rows = self._checked(rows)
        last = W.partitionBy("id").orderBy(F.col(order or "vector"))
        if on_duplicate == "append":
            begin = (self.df.agg(F.max(SEQ)).first()[0] or 0) if SEQ in self.df.columns else 0
            rows = rows.withColumn(SEQ, F.row_number().over(last).cast("long") + begin)
            return self._changed(lambda df: df, rows)
        latest = W.partitionBy("id").orderBy(F.col(order or "vector").desc_nulls_last())
        rows = rows.withColumn(SEQ, F.row_number().over(latest)).where(F.col(SEQ) == 1).drop(SEQ)
        return self._changed(lambda df: df.join(rows.select("id"), "id", "left_anti"), rows)

    def _newest(self, ids: DataFrame) -> DataFrame:
        """(id, number) of the newest record of each of these ids; 0 for records that carry none."""
        number = F.coalesce(SEQ, F.lit(0).cast("long")) if SEQ in self.df.columns else F.lit(0).cast("long")
        return self.df.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max(number).alias(SEQ))

    def delete(self, ids: Sequence[str] | DataFrame) -> Collection:
        """Without the newest record of each of these ids; unknown ones are no error. Pass a DataFrame with a column id for many."""
        if not isinstance(ids, DataFrame):
            if not ids:
                return self
            if SEQ not in self.df.columns:
                return self._changed(lambda df: df.where(~F.col("id").isin(*ids)))
            ids = self.df.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        elif SEQ not in self.df.columns:
            return self._changed(lambda df: df.join(ids.select("id"), "id", "left_anti"))
        gone = self._newest(ids).select(F.col("id").alias("_id"), F.col(SEQ).alias("_seq"))
        return self._changed(lambda df: df.join(gone, (F.col("id") == F.col("_id")) & (F.coalesce(SEQ, F.lit(0).cast("long")) == F.col("_seq")), "left_anti"))

    def update(self, record_id: str, values: Sequence[float]) -> Collection:
        """With another vector for one record, whose metadata stays."""
        if self.get(record_id) is None:
            raise NotFound(record_id)
        if not values:
            raise EmptyVector
        self._expect(len(values))
        rows = self.df.sparkSession.createDataFrame([(record_id, [float(x) for x in values])], "id string, vector array<float>")
        return self._moved(rows)

    def update_many(self, changes: DataFrame) -> Collection:
        """With the vectors of `changes` (id, vector, each id once); unknown ids are an error."""
        changes = self._checked(changes.select("id", F.col("vector").alias("vector")))
        lost = changes.join(self.df.select("id"), "id", "left_anti").first()
        if lost:
            raise NotFound(lost["id"])
        return self._moved(changes)

    def _moved(self, changes: DataFrame) -> Collection:
        """The newest records of some ids with other vectors; the rest of a record stays."""
        new = changes.select("id", F.col("vector").alias("_new"))
        if SEQ not in self.df.columns:
            moved = self.df.join(new, "id").withColumn("vector", F.col("_new").cast(self.df.schema["vector"].dataType)).select(*self.df.columns)
            return self._changed(lambda df: df.join(new.select("id"), "id", "left_anti"), moved)
        at = self._newest(new).select(F.col("id").alias("_id"), F.col(SEQ).alias("_seq"))
        here = (F.col("id") == F.col("_id")) & (F.coalesce(SEQ, F.lit(0).cast("long")) == F.col("_seq"))
        moved = self.df.join(at, here).join(new, "id").withColumn("vector", F.col("_new").cast(self.df.schema["vector"].dataType)).select(*self.df.columns)
        return self._changed(lambda df: df.join(at, here, "left_anti"), moved)

    # Searches

    def _expect(self, n: int) -> None:
        if n != self.dimension:
            raise DimensionMismatch(self.dimension, n)

    def _uses_ivf(self) -> bool:
        return self.index == "ivf" or self.index == "auto" and self.df.limit(EXACT_BELOW).count() >= EXACT_BELOW

    @property
    def ivf(self) -> ann.IvfIndex:
        if self._ivf is None:
            self._ivf = ann.build(self.df, self.params)
        return self._ivf

    def search(self, query: Sequence[float], k: int, metric: str | Distance = Metric.COSINE) -> DataFrame:
        """The k nearest records with their distance. Nothing to search gives no rows, whatever the query."""
        if k == 0 or self.dimension == 0:
            return self.df.withColumn("distance", F.lit(0.0)).limit(0)
        self._expect(len(query))
        if self._uses_ivf():
            return self.ivf.search(query, k, metric).drop(SEQ)
        return knn.nearest(self.df, query, k, metric).drop(SEQ)

    def search_batch(self, queries: DataFrame, k: int, metric: str | Distance = Metric.COSINE, *, method: str = "auto") -> DataFrame:
        """(query_id, id, distance, rank) for queries with columns query_id and query_vector.

        Dimensions of all queries are checked first, even if there is nothing to search.
        """
        low, high, null = queries.agg(F.min(F.size("query_vector")), F.max(F.size("query_vector")), F.count_if(F.col("query_vector").isNull())).first()
        if null:
            raise EmptyVector
        for n in (low, high):
            if n is not None:
                self._expect(n)
        if k > 0 and self.dimension and self._uses_ivf():
            return self.ivf.search_batch(queries, k, metric)
        return knn.nearest_for_each(self.df, queries, k, metric, method=method)

    def where(self, condition: str | Filter, *, compat: bool = False) -> Column:
        return to_column(parse(condition) if isinstance(condition, str) else condition, self.fields, compat)

    def search_filtered(self, query: Sequence[float], k: int, condition: str | Filter, metric: str | Distance = Metric.COSINE, *, compat: bool = False) -> DataFrame:
        """The k nearest of the records that match; always exact. The filter reaches the scan."""
        matching = self.where(condition, compat=compat)
        if self.dimension:
            self._expect(len(query))
        return knn.nearest(self.df, query, k, metric, where=matching).drop(SEQ)

    def matching_ids(self, condition: str | Filter, *, compat: bool = False) -> DataFrame:
        return matching_ids(self.df, parse(condition) if isinstance(condition, str) else condition, self.fields, compat=compat)

    def candidates(self, ids: DataFrame) -> Collection:
        """The records whose ids are given from outside."""
        return self._changed(lambda df: df.join(ids.select("id").distinct(), "id", "left_semi"))

    def latest(self, order: str) -> Collection:
        """One record of each id, the one with the largest value of a column."""
        w = W.partitionBy("id").orderBy(F.col(order).desc_nulls_last())
        return self._changed(lambda df: df.withColumn(SEQ, F.row_number().over(w)).where(F.col(SEQ) == 1).drop(SEQ))
