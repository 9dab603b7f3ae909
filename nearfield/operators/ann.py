"""Approximate search by an inverted file of cells.

Records are assigned to the nearest of some centroids, which k-means finds on a bounded sample. A search
ranks the centroids, probes the records of the nearest cells and ranks those exactly. Saved indexes
are Parquet partitioned by cell, so a search reads the probed folders only. Probing all cells is exact.

How many cells are probed is measured when the index is built: for some records of a sample, their neighbours in
it are found exactly, and as many cells are probed as hold ``RECALL`` of them. Where vectors lie in clusters
these are few; where they have no order at all, nearly half.

Records come and go without a new fit: new ones get the nearest cell of the centroids there are, and deleted
ones are left out.

Zero vectors have no direction: for the cosine they are in a cell of their own, which is always
probed. The cells are Euclidean, over vectors scaled to length 1 if the metric is cosine; other
metrics probe the same cells and rank by their own distance.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, Other
from nearfield.functions.metrics import Distance, Metric, distance, norm
from nearfield.operators import knn

#: The version that saved indexes must have; the cell of zero vectors.
FORMAT, VERSION, ZERO_CELL = "nearfield-ivf", 1, -1
#: Rows that the centroids are fitted on at most.
FIT_ROWS = 200_000
#: Share of the neighbours that the probed cells are to hold; sampled records, and those whose neighbours are looked for; neighbours.
RECALL, SAMPLE, ASKED, NEIGHBOURS = 0.96, 8000, 400, 10


@dataclass(frozen=True)
class Params:
    """n_cells: by default the square root of the number of records. nprobe: by default measured, see above.
    budget: records that a search ranks at least."""

    n_cells: int | None = None
    nprobe: int | None = None
    metric: str = Metric.EUCLIDEAN
    budget: int = 200
    seed: int = 42
    iterations: int = 20


class IvfIndex:
    def __init__(self, df: DataFrame | None, centroids: np.ndarray, sizes: dict[int, int] | None, params: Params, measured: int | None = None):
        self.df, self.centroids, self.params, self.measured = df, centroids, params, measured
        self._sizes = sizes

    @property
    def sizes(self) -> dict[int, int]:
        """Records of each cell; counted when asked for after a change."""
        if self._sizes is None:
            self._sizes = {r["cell"]: r["count"] for r in self.df.groupBy("cell").count().collect()}
        return self._sizes

    @property
    def nprobe(self) -> int:
        return self.params.nprobe or self.measured or math.ceil(len(self.centroids) / 2)

    def _changed(self, df: DataFrame) -> IvfIndex:
        return IvfIndex(df, self.centroids, None, self.params, self.measured)

    def with_records(self, records: DataFrame) -> IvfIndex:
        """With further records, in the cells of the centroids there are."""
        return self._changed(self.df.unionByName(assigned(records, self.centroids, self.params.metric), allowMissingColumns=True))

    def kept(self, keep: Callable[[DataFrame], DataFrame]) -> IvfIndex:
        """With the records that a function of them leaves."""
        return self._changed(keep(self.df))

    def cells(self, query: Sequence[float], k: int) -> list[int]:
        """The cells to probe: the nearest ones, more of them until they hold enough records."""
        return self.cells_of_all(np.asarray(query, np.float64)[None, :], k)[0]

    def cells_of_all(self, queries: np.ndarray, k: int) -> list[list[int]]:
        if queries.shape[1:] != self.centroids.shape[1:]:
            raise DimensionMismatch(self.centroids.shape[1], queries.shape[1])
        order = np.argsort(_to_centroids(queries, self.centroids, self.params.metric), axis=1, kind="stable")
        held = np.cumsum(np.array([self.sizes.get(c, 0) for c in range(len(self.centroids))])[order], axis=1)
        enough = (held < max(k, self.params.budget)).sum(1) + 1
        zero = [ZERO_CELL] * (ZERO_CELL in self.sizes)
        return [row[: max(self.nprobe, n)].tolist() + zero for row, n in zip(order, enough.tolist(), strict=True)]

    def search(self, query: Sequence[float], k: int, metric: str | Distance = Metric.COSINE, *, where: Column | None = None) -> DataFrame:
        probed = self.df.where(F.col("cell").isin(self.cells(query, k)))
        return knn.nearest(probed, query, k, metric, where=where).drop("cell")

    def search_batch(self, queries: DataFrame, k: int, metric: str | Distance = Metric.COSINE) -> DataFrame:
        """Joins queries and records on the cell; each query meets the records of its cells alone."""
        lean = IvfIndex(None, self.centroids, self.sizes, self.params, self.measured)  # without the DataFrame, which stays on the driver

        @F.pandas_udf("array<int>")
        def probe(vectors: pd.Series) -> pd.Series:
            found: list[list[int]] = []
            for a in range(0, len(vectors), 1024):
                found += lean.cells_of_all(np.stack(vectors.iloc[a : a + 1024]).astype(np.float64), k)
            return pd.Series(found, index=vectors.index)

        wanted = queries.select("query_id", "query_vector", F.explode(probe("query_vector")).alias("cell"))
        met = self.df.join(wanted, "cell").withColumn("distance", distance(metric, F.col("vector"), F.col("query_vector")))
        return knn._ranked(met.select("query_id", "id", "distance"), k, "query_id", "id")

    def save(self, path: str) -> None:
        """Writes records by cell, and centroids with the parameters."""
        spark = self.df.sparkSession
        self.df.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/records")
        head = {"format": FORMAT, "version": VERSION, "params": asdict(self.params), "measured": self.measured, "sizes": {str(c): n for c, n in self.sizes.items()}}
        spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        rows = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> IvfIndex:
    head = json.loads(spark.read.parquet(f"{path}/head").first()["head"])
    if (head.get("format"), head.get("version")) != (FORMAT, VERSION):
        raise Other(f"not an index of format {FORMAT} version {VERSION}: {head.get('format')} {head.get('version')}")
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])
    return IvfIndex(spark.read.parquet(f"{path}/records"), centroids, {int(c): n for c, n in head["sizes"].items()}, Params(**head["params"]), head.get("measured"))


def _to_centroids(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Squares of the distances of vectors to centroids."""
    if metric == Metric.COSINE:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (x @ centroids.T)


def assigned(records: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """The records with the cell of their nearest centroid."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        for a in range(0, len(vectors), 1024):
            x = np.stack(vectors.iloc[a : a + 1024]).astype(np.float64)
            if x.shape[1] != centroids.shape[1]:
                raise DimensionMismatch(centroids.shape[1], x.shape[1])
            out[a : a + 1024] = _to_centroids(x, centroids, metric).argmin(1)
        return pd.Series(out, index=vectors.index)

    cell = nearest(F.col("vector"))
    if metric == Metric.COSINE:
        cell = F.when(norm(F.col("vector")) == 0, F.lit(ZERO_CELL)).otherwise(cell)
    return records.withColumn("cell", cell)


def probes_for(points: np.ndarray, centroids: np.ndarray, recall: float = RECALL) -> int:
    """The least number of cells whose records hold this share of the neighbours of some of the points.

    Neighbours in a sample are further off than in all records, so for these the share is higher.
    """
    asked = points[:: max(1, len(points) // ASKED)]
    near = ((points * points).sum(1)[None, :] - 2 * asked @ points.T).argsort(1)[:, 1 : NEIGHBOURS + 1]
    if not near.size:
        return 1
    cell = _to_centroids(points, centroids, Metric.EUCLIDEAN).argmin(1)
    rank = _to_centroids(asked, centroids, Metric.EUCLIDEAN).argsort(1).argsort(1)
    needed = np.sort(np.take_along_axis(rank, cell[near], 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


def build(records: DataFrame, params: Params | None = None) -> IvfIndex:
    """Fits the centroids on a sample of at most FIT_ROWS rows and assigns every record."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    params = params or Params()
    n = records.count()
    if n == 0:
        raise Other("an index needs records")
    v = F.col("vector").cast("array<double>")
    if params.metric == Metric.COSINE:
        length = norm(v)
        v = F.transform(v, lambda x: x / F.when(length > 0, length).otherwise(F.lit(1.0)))
    k = min(n, params.n_cells or max(1, math.isqrt(n)))
    points = records.select(v.alias("v"))
    if n > FIT_ROWS:
        points = points.sample(fraction=FIT_ROWS / n, seed=params.seed)
    model = KMeans(k=max(2, k), seed=params.seed, maxIter=params.iterations).fit(points.select(array_to_vector("v").alias("features"))) if k > 1 else None
    centroids = np.array(model.clusterCenters()) if model else np.array([points.first()["v"]])
    some = points if n <= SAMPLE else points.sample(fraction=SAMPLE / n, seed=params.seed)
    sampled = np.array([r["v"] for r in some.limit(2 * SAMPLE).collect()])  # to measure the probes; the records may be fewer
    measured = None if params.nprobe else probes_for(sampled, centroids) if len(sampled) else None
    return IvfIndex(assigned(records, centroids, params.metric), centroids, None, params, measured)
