"""Exact nearest neighbours.

One query is a projection and a top-k, which Spark runs as TakeOrderedAndProject: each task keeps k
rows. Many queries run as blocks: a query block goes to all tasks once, each Arrow batch is scored
against it as a matrix, and only the k best of a batch for each query are shuffled. Ties are broken by
id, and distances that are not numbers come last. In blocks, records without a vector are left out, a vector
of another length is an error, and so is a query without one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import DimensionMismatch, EmptyVector
from nearfield.functions.metrics import Distance, Metric, cosine, distance, norm, vector

#: Bytes of the queries that are sent to all tasks at once; bytes of the distances of one batch.
QUERY_BYTES, GRID_BYTES = 16 << 20, 32 << 20
#: Queries up to which the expression path may broadcast them.
BROADCAST_QUERIES = 10_000
#: A k over this is cut to the number of records beforehand.
LARGE_K = 100_000


def scored(records: DataFrame, query: Sequence[float], metric: str | Distance, vector_column: str = "vector") -> DataFrame:
    """The records with their distance to the query; uses a `norm` column for cosine if there is one."""
    v, q = F.col(vector_column), vector(query)
    if metric == Metric.COSINE and "norm" in records.columns:
        d = cosine(v, q, F.col("norm"), F.lit(float(np.sqrt(sum(float(x) ** 2 for x in query)))))
    else:
        d = distance(metric, v, q)
    return records.withColumn("distance", d)


def nearest(records: DataFrame, query: Sequence[float], k: int, metric: str | Distance = Metric.COSINE, *, id_column: str = "id", vector_column: str = "vector", where: Column | None = None) -> DataFrame:
    """The k records nearest to one query, ascending by distance then id."""
    if where is not None:
        records = records.where(where)
    if k > LARGE_K:
        k = min(k, records.count())  # top-k memory is reserved for k rows
    return scored(records, query, metric, vector_column).orderBy(F.col("distance").asc_nulls_last(), id_column).limit(k)


def _ranked(scored_pairs: DataFrame, k: int, query_id: str, id_column: str) -> DataFrame:
    # Written as a filter on row_number so that tasks drop all but k rows a query before the shuffle.
    order = W.partitionBy(query_id).orderBy(F.col("distance").asc_nulls_last(), id_column)
    return scored_pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_for_each(records: DataFrame, queries: DataFrame, k: int, metric: str | Distance = Metric.COSINE, *, id_column: str = "id", vector_column: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", method: str = "auto") -> DataFrame:
    """(query_id, id, distance, rank) of the k records nearest to each query.

    method: "blocks" for the matrix path (the five named metrics), "expressions" for built-in
    expressions over a broadcast of at most BROADCAST_QUERIES queries; "auto" takes blocks where it can.
    """
    blocks = isinstance(metric, str) and metric in set(Metric)
    if method == "expressions" or method == "auto" and not blocks:
        some = queries.select(query_id, query_vector)
        if some.limit(BROADCAST_QUERIES + 1).count() > BROADCAST_QUERIES:
            raise ValueError(f"more than {BROADCAST_QUERIES} queries: use blocks, or pass them in parts")
        pairs = records.select(id_column, vector_column).crossJoin(F.broadcast(some))
        pairs = pairs.withColumn("distance", distance(metric, F.col(vector_column), F.col(query_vector)))
        return _ranked(pairs.select(query_id, id_column, "distance"), k, query_id, id_column)
    out = None
    for ids, grid in _query_blocks(queries, query_id, query_vector):
        part = _block(records, ids, grid, k, Metric(metric), id_column, vector_column, query_id, dict(queries.dtypes)[query_id])
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = f"{query_id} {dict(queries.dtypes)[query_id]}, {id_column} {dict(records.dtypes)[id_column]}, distance double, rank int"
        return queries.sparkSession.createDataFrame([], kinds)
    return out


def _query_blocks(queries: DataFrame, query_id: str, query_vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """Streams the queries through the driver, a block at a time."""
    ids, rows = [], []
    for r in queries.select(query_id, F.col(query_vector).cast("array<double>").alias(query_vector)).toLocalIterator():
        if not r[1]:
            raise EmptyVector
        ids.append(r[0])
        rows.append(np.array(r[1], np.float64))  # a null element is NaN
        if len(rows[-1]) != len(rows[0]):
            raise DimensionMismatch(len(rows[0]), len(rows[-1]))
        if 8 * len(ids) * len(rows[0]) >= QUERY_BYTES:
            yield ids, np.stack(rows)
            ids, rows = [], []
    if ids:
        yield ids, np.stack(rows)


def distances(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """Distances of all rows of x to all rows of q, as the Column expressions define them."""
    if metric == Metric.DOT:
        return -(x @ q.T)
    if metric == Metric.COSINE:
        length = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(length == 0, 0.0, 1 - (x @ q.T) / length)
    if metric == Metric.EUCLIDEAN:
        square = (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (x @ q.T)
        return np.sqrt(np.maximum(square, 0))
    out = np.empty((len(x), len(q)))
    for j, row in enumerate(q):
        if metric == Metric.MANHATTAN:
            out[:, j] = np.abs(x - row).sum(1)
        else:
            same = (x == row) & (np.signbit(x) == np.signbit(row)) | np.isnan(x) & np.isnan(row)
            out[:, j] = (~same).mean(1)
    return out


def _slack(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """For each query, how far apart the distances of distances() and those of _exact() can be at most, by rounding.

    For the Euclidean distance it is that of the squares, which are what is compared.
    """
    unit = 4 * (x.shape[1] + 4) * np.finfo(np.float64).eps
    if metric == Metric.COSINE:
        return np.full(len(q), unit)
    longest, own = np.sqrt(np.nanmax((x * x).sum(1), initial=0.0)), np.sqrt((q * q).sum(1))
    return unit * ((longest + own) ** 2 if metric == Metric.EUCLIDEAN else longest * own)


def _exact(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """Distances of row i of x to row i of q, without the cancellation of the expanded form."""
    if metric == Metric.EUCLIDEAN:
        return np.sqrt(((x - q) ** 2).sum(1))
    dots = np.einsum("ij,ij->i", x, q)
    if metric == Metric.DOT:
        return -dots
    length = np.linalg.norm(x, axis=1) * np.linalg.norm(q, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length == 0, 0.0, 1 - dots / length)


def _k_least(x: np.ndarray, q: np.ndarray, k: int, metric: Metric, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, query and distance of the k least of each query, ties by rank and distances that are no numbers last.

    The matrix form finds what may be among them, by a bound of its rounding; these get exact distances, of which
    the k least are taken. So however many vectors nearly equal a query, none of its neighbours is lost.
    """
    d = distances(x, q, metric)
    if metric in (Metric.MANHATTAN, Metric.HAMMING):
        rows, queries = np.nonzero(~(d > np.partition(d, k - 1, axis=0)[k - 1]))
        found = d[rows, queries]
    else:
        score = d * d if metric == Metric.EUCLIDEAN else d
        rows, queries = np.nonzero(~(score > np.partition(score, k - 1, axis=0)[k - 1] + 2 * _slack(x, q, metric)))
        step = max(1, GRID_BYTES // (8 * x.shape[1]))
        found = np.concatenate([np.zeros(0), *(_exact(x[rows[a : a + step]], q[queries[a : a + step]], metric) for a in range(0, len(rows), step))])
    order = np.lexsort((rank[rows], found, queries))  # NaN sorts last
    rows, queries, found = rows[order], queries[order], found[order]
    first = np.searchsorted(queries, np.arange(len(q)))
    kept = np.arange(len(queries)) - first[queries] < k
    return rows[kept], queries[kept], found[kept]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a batch as rows; all of them must have the width."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise DimensionMismatch(width, int(lengths[lengths != width][0]))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _block(records: DataFrame, ids: list, grid: np.ndarray, k: int, metric: Metric, id_column: str, vector_column: str, query_id: str, query_kind: str) -> DataFrame:
    shared = records.sparkSession.sparkContext.broadcast(grid)
    id_kind = dict(records.dtypes)[id_column]
    rows = max(1, GRID_BYTES // (8 * len(grid)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows if k else 0, rows):
                batch = whole.slice(a, rows)
                x = _matrix(batch.column(1), q.shape[1])
                rank = np.argsort(np.argsort(np.array(batch.column(0).to_pylist()), kind="stable"), kind="stable")
                i, j, d = _k_least(x, q, min(k, len(x)), metric, rank)
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), batch.column(0).take(pa.array(i)), pa.array(d, pa.float64())], names=["_query", id_column, "distance"])

    lean = records.where(F.col(vector_column).isNotNull()).select(id_column, F.col(vector_column).cast("array<double>").alias(vector_column))
    found = _ranked(lean.mapInArrow(run, f"_query int, `{id_column}` {id_kind}, distance double"), k, "_query", id_column)
    names = records.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("_query", T.IntegerType()), T.StructField(query_id, T._parse_datatype_string(query_kind))]))
    return found.join(F.broadcast(names), "_query").select(query_id, id_column, "distance", "rank")  # the queries of one block


def with_norm(records: DataFrame, vector_column: str = "vector") -> DataFrame:
    return records.withColumn("norm", norm(F.col(vector_column)))
