"""Helpers that several corpus operators use."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.workers import ship

#: Bytes of one Arrow batch sent to a Python worker; long rows make smaller batches.
BATCH_BYTES = 4 << 20
#: Ranges of ids at most, so that what the driver knows of them is bounded; sampled ids a range.
MOST_RANGES, POINTS = 1 << 16, 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Only where that is unset: a temporary folder in local mode,
    where driver and executors are one machine, else a folder under the warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        path = tempfile.mkdtemp(prefix="nearfield-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    else:
        path = spark.conf.get("spark.sql.warehouse.dir") + "/_staging"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders made inside the scopes that are open.
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the folders that were made inside, but for those that are taken off the list."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        for path in made:
            discard(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and rereads it: cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def private(df: DataFrame) -> Callable[[str], str]:
    """Makes names of columns that the table does not have, whatever its columns are called."""
    mark = "_nf"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return lambda name: f"{mark}_{name}"


def drop_staged(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, path)


def arrow_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as a few thousand very long texts would not fit in a worker.

    Also sends this package to Python workers that would not find it on their path.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


def held_out(doc_id: Column) -> Column:
    """True for the rows kept from training; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _literal(values: list[int]) -> Column:
    """A list of integers as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _range_of(column: Column, bounds: list[int]) -> Column:
    """How many bounds an id is not below, by binary search."""
    if not bounds:
        return F.lit(0)
    known = _literal(bounds)
    bits = F.sequence(F.lit(len(bounds).bit_length() - 1), F.lit(0), F.lit(-1))

    def step(low: Column, bit: Column) -> Column:
        high = low + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((high <= len(bounds)) & (F.get(known, high - 1) <= column), high).otherwise(low)

    return F.aggregate(bits, F.lit(0), step)


@dataclass
class Ranges:
    """Ranges of ids, in ascending order, null ids before all. An id of very many rows has several parts by hash of the text."""

    bounds: list[int]
    ways: list[int]
    #: The place of each part among those that have rows; the least id of each of these.
    dense: list[int] | None = None
    leads: list[int | None] = field(default_factory=lambda: [None])

    def part(self, doc_id: Column, text: Column) -> Column:
        """The number of the part that holds a row."""
        doc_id = doc_id.cast("long")
        at = F.when(doc_id.isNull(), F.lit(0)).otherwise(_range_of(doc_id, self.bounds) + 1)
        if max(self.ways) > 1:
            firsts = [0, *accumulate(self.ways)][:-1]
            ways = F.get(_literal(self.ways), at)
            at = F.get(_literal(firsts), at) + F.when(ways > 1, F.pmod(F.xxhash64(text), ways)).otherwise(F.lit(0).cast("long"))
        return at.cast("int") if self.dense is None else F.get(_literal(self.dense), at).cast("int")


def id_ranges(df: DataFrame, column: str, rows: int, text: str = "text") -> Ranges:
    """Cuts the ids into ranges of about `rows` rows each: as many as there are shuffle partitions at least, MOST_RANGES at most.

    Bounds come from a sample of POINTS ids a range. An id that fills several ranges gets as many parts. Every part
    that is numbered has rows. Reads the id column only, and the texts if there is such an id; the driver gets the
    sample and one row a part.
    """
    ids = df.select(F.col(column).cast("long").alias("id"))
    n = ids.count()
    if not n:
        return Ranges([], [1, 1])
    k = max(1, min(MOST_RANGES, n, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))))
    share = min(1.0, POINTS * k / n)
    found = (ids if share == 1 else ids.sample(share, 11)).toArrow().column("id").drop_null()
    points = np.sort(found.to_numpy())
    step = max(1.0, len(points) / k)
    cuts = {int(points[int(i * step)]) for i in range(1, k) if int(i * step) < len(points)}
    values, counts = np.unique(points, return_counts=True)
    heavy = {int(v): round(c / step) for v, c in zip(values, counts, strict=True) if c >= 2 * step}
    highest = (1 << 63) - 1
    bounds = sorted(cuts | set(heavy) | {v + 1 for v in heavy if v < highest})
    nulls = ids.where("id is null").count()
    ways = [max(1, round(nulls * k / n)), 1, *[heavy.get(b, 1) for b in bounds]]
    out = Ranges(bounds, ways)
    several = max(ways) > 1
    placed = df.select(F.col(column).cast("long").alias("id"), out.part(F.col(column), F.col(text).cast("binary") if several else F.lit(None)).alias("part"))
    parts = sorted((r["part"], r["least"]) for r in placed.groupBy("part").agg(F.min("id").alias("least")).collect())
    out.dense = [0] * sum(ways)
    for i, (part, _) in enumerate(parts):
        out.dense[part] = i
    out.leads = [least for _, least in parts]
    return out
