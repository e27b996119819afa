"""Integer k-means whose centroids are filtered by n-simplex projection.

Distances of a vector to a few pivots are worked out once and kept. They place it as the apex of a simplex over the pivots: coordinates in the pivots' own
space, and a height above it. Between two apexes, the distance with both heights on one side is a lower bound of the true one, and with the heights on opposite
sides an upper bound. Centroids whose lower bound is above the least upper bound are out; the others are compared in exact integers.

A round reads the kept table once; each task gives one exact sum for each centroid and component, and the driver sees no more than those of all
centroids. Bounds have a margin far above rounding, so they decide nothing that integers would decide otherwise.

Defined results: vectors with another number of components, or a null or non-finite one, or one of LARGEST or more in size (distances would not fit a long) are left out, as are null
vectors. Rows that repeat are vectors of their own. Rows without id are assigned but never start a centroid. With fewer vectors than centroids there are fewer centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped
from ._common import scratch_table

#: Components are kept as floor(SCALE * x); larger ones than LARGEST are outside the range of exact sums of squares.
SCALE, LARGEST = 1024, 1 << 17
#: Pivots: the starting centroids and as many again. A pivot counts if its height above the others is at least this share of its distance.
PIVOTS, LEAST_HEIGHT = 16, 0.1
#: Margin of the bounds, as a share of the squared distances that they come from.
MARGIN = 1e-7


class Simplex:
    """Apexes over a fixed set of pivots (rows of integers)."""

    def __init__(self, pivots: np.ndarray) -> None:
        used = pivots[:1].astype(np.float64)
        self.low = np.zeros((0, 0))
        for p in pivots[1:].astype(np.float64):
            y, height = self._place(((p - used) ** 2).sum(1)[None, :], ((used[1:] - used[0]) ** 2).sum(1))
            if height[0] ** 2 > LEAST_HEIGHT**2 * ((p - used[0]) ** 2).sum():
                self.low = np.block([[self.low, np.zeros((len(self.low), 1))], [y, height[:, None]]])
                used = np.vstack([used, p])
        self.pivots, self.base = used, ((used[1:] - used[0]) ** 2).sum(1)

    def _place(self, squared: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = (squared[:, :1] + base - squared[:, 1:]) / 2
        y = np.linalg.solve(self.low, rest.T).T if len(base) else rest
        return y, np.sqrt(np.maximum(squared[:, 0] - (y**2).sum(1), 0))

    def apex(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates over the pivots, the height last, from the distances to the pivots alone."""
        squared = np.stack([((vectors - p) ** 2).sum(1) for p in self.pivots], 1)
        y, height = self._place(squared, self.base)
        return np.hstack([y, height[:, None]])


def candidates(apex: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each vector, whether each centroid may be its nearest."""
    flat = ((apex[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(2)
    low, high = (flat + (apex[:, -1:] + sign * centres[:, -1]) ** 2 for sign in (-1, 1))
    scale = (apex**2).sum(1) + (centres**2).sum(1).max()
    return low <= high.min(1)[:, None] + MARGIN * (1 + scale[:, None])


def nearest(vectors: np.ndarray, apex: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, ties to the smaller number, and how many were compared exactly (0: one was left)."""
    may = candidates(apex, simplex.apex(centroids.astype(np.float64)))
    n = may.sum(1)
    told = may.argmax(1)
    open_rows = np.flatnonzero(n > 1)
    exact = np.full((len(open_rows), len(centroids)), np.iinfo(np.int64).max)
    for k, centroid in enumerate(centroids):
        rows = np.flatnonzero(may[open_rows, k])
        exact[rows, k] = ((vectors[open_rows[rows]] - centroid) ** 2).sum(1)
    told[open_rows] = exact.argmin(1)
    return told, np.where(n > 1, n, 0)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def _chunks(batches: Iterator[pa.RecordBatch], simplex_width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            yield part, _matrix(part.column("q"), np.int64), _matrix(part.column("apex"), np.float64).reshape(-1, simplex_width)


def cluster(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """One row per vector that is kept: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, n_compared.

    Centroids start as the k vectors with the smallest SHA-256 of ``seed:id``. n_compared is the number of centroids that the bounds left for the last assignment.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    kept = kept.where((F.size("v") == dims) & fits).select("id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("q"))
    named = kept.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    starts = [r["q"] for r in named.orderBy("h", "q").limit(max(k, PIVOTS)).collect()]
    shape = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_compared int"
    if not starts:
        return spark.createDataFrame([], shape)
    centroids, simplex = np.array(starts[:k], np.int64), Simplex(np.array(starts, np.int64))
    width = len(simplex.base) + 1

    def with_apex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("q"), _lists(simplex.apex(_matrix(part.column("q"), np.float64)))], ["id", "q", "apex"])

    placed = scratch_table(kept.transform(shipped).mapInArrow(with_apex, "id long, q array<long>, apex array<double>"), "apexes")
    for _ in range(rounds):
        centroids = _moved(placed, centroids, simplex)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q, apex in _chunks(batches, width):
            told, n = nearest(q, apex, centroids, simplex)
            distance = ((q - centroids[told]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(told.astype(np.int32)), pa.array(distance), pa.array(n.astype(np.int32))], ["id", "cluster", "distance", "n_compared"])

    told = scratch_table(placed.mapInArrow(assigned, "id long, cluster int, distance long, n_compared int"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, long(s), long(sum(sums.values())), names[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared")


def _moved(placed: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round; those that get no vector stay."""
    width = len(simplex.base) + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, q, apex in _chunks(batches, width):
            told, _ = nearest(q, apex, centroids, simplex)
            for c in range(len(centroids)):
                total[c] += q[told == c].sum(0)
            n += np.bincount(told, minlength=len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), _lists(total)], ["c", "n", "total"])

    parts = placed.mapInArrow(summed, "c int, n long, total array<long>").where("n > 0").select("c", "n", F.posexplode("total").alias("at", "x"))
    sums = parts.groupBy("c", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    moved = centroids.copy()
    for r in sums.collect():
        moved[r["c"], r["at"]] = int(r["x"]) // r["n"]
    return moved
