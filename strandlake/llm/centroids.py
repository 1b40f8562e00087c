"""Centroid clustering in integers, with PCA-rotated filtering.

Vectors become integers, floor(scale * component). The covariance of all of them (sums of dims x dims numbers, added up by Spark) gives a
rotation; of every vector its leading rotated coordinates and the norm of the rest are stored beside it. For a vector x and a centroid c,
|lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2 is at most |x - c|^2, so the exact distance to the centroid that looks nearest rules most of
the others out. What remains is compared in integers. The filter works on doubles with a margin for rounding; it decides nothing.

A round reads the stored vectors once and adds up sums and counts by centroid in each task; k x dims sums reach the driver. Groups of equal
vectors, however large, need no task of their own.

Vectors that are null, hold null or non-finite components or have another number of components take no part. Repeated rows count each;
rows with null vec_id are clustered, but begin no cluster as long as there are others. Equal start hashes (equal vec_ids) go by components.
Fewer vectors than k give fewer clusters; an empty table gives no rows. Components beyond 2**27 for 64 dimensions (in general: where a squared
distance could pass 64 bits) raise a ValueError. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import drop_stages, stage, staged
from strandlake.llm.vectors import matrix

#: Rows that a task looks at together.
SLICE = 2048


def integers(vectors: DataFrame, dims: int, scale: int, vector: str = "embedding") -> DataFrame:
    """vec_id and x (array<long>) of the vectors that take part."""
    whole = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dims)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    whole = whole.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    most = 2 ** (int(np.log2((2**63 - 1) / dims)) // 2 - 1)
    fits = F.when(F.forall("v", lambda x: F.abs(scale * x) < most), True).otherwise(F.raise_error(F.lit(f"a component times {scale} passes {most}")))
    return whole.where(fits).select("vec_id", F.transform("v", lambda x: F.floor(scale * x)).alias("x"))


@dataclass(frozen=True)
class Rotation:
    """The mean and the leading axes (columns), widest first."""

    mean: np.ndarray
    axes: np.ndarray

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and norm of the rest."""
        away = x.astype(np.float64) - self.mean
        lead = away @ self.axes
        rest = away - lead @ self.axes.T
        return lead, np.sqrt((rest * rest).sum(1))


def fit_rotation(x: DataFrame, dims: int, leading: int) -> Rotation:
    """From the covariance of all rows of x: each task adds its rows up, and Spark adds those sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dims + dims * dims)
        for batch in batches:
            v = matrix(batch.column(0), np.float64)
            if batch.num_rows:
                total += np.concatenate(([len(v)], v.sum(0), (v.T @ v).ravel()))
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "s"])

    rows = x.select("x").mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(1 + dims + dims * dims)
    for r in rows:
        total[r["i"]] = r["s"]
    mean = total[1 : 1 + dims] / total[0]
    _, axes = np.linalg.eigh(total[1 + dims :].reshape(dims, dims) / total[0] - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1][:, :leading]))


class Nearest:
    """The nearest of some integer centroids, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray, rotation: Rotation):
        self.whole = centroids
        self.lead, self.rest = rotation.of(centroids)
        self.size = (self.lead**2).sum(1) + self.rest**2

    def of(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, squared distance, and how many distances were computed, by row."""
        size = (lead**2).sum(1) + rest**2
        least = size[:, None] + self.size - 2 * (lead @ self.lead.T) - 2 * np.outer(rest, self.rest)
        least -= 1e-9 * (size[:, None] + self.size + 1)
        at = np.arange(len(x))
        first = least.argmin(1)
        found = np.full(least.shape, np.iinfo(np.int64).max)
        found[at, first] = ((x - self.whole[first]) ** 2).sum(1)
        left = least <= found[at, first][:, None]
        left[at, first] = False
        row, col = np.nonzero(left)
        for a in range(0, len(row), 8 * SLICE):
            r, c = row[a : a + 8 * SLICE], col[a : a + 8 * SLICE]
            found[r, c] = ((x[r] - self.whole[c]) ** 2).sum(1)
        best = found.argmin(1)
        return best, found[at, best], 1 + left.sum(1)


def _slices(batches, leading: int):
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            yield part.column("vec_id"), matrix(part.column("x"), np.int64), matrix(part.column("lead"), np.float64).reshape(-1, leading), part.column("rest").to_numpy()


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, leading: int = 16, salt: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): vec_id, cluster, distance (squared) and compared (exact distances computed) of every vector that takes part, and
    the final centroids' components. The first centroids are the vectors with the smallest sha256 of salt and vec_id."""
    spark, before = vectors.sparkSession, staged()
    out = "vec_id long, cluster int, distance long, compared int"
    x = stage(integers(vectors, dims, scale), "integers")
    start = x.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).select("x").collect()
    if not start:
        return spark.createDataFrame([], out), []
    leading = min(leading, dims)
    rotation = fit_rotation(x, dims, leading)

    def rotate(batches):
        for batch in batches:
            if batch.num_rows:
                lead, rest = rotation.of(matrix(batch.column("x"), np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, lead.size + 1, leading, dtype=np.int32)), pa.array(lead.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), flat, pa.array(rest)], names=["vec_id", "x", "lead", "rest"])

    rotated = stage(x.mapInArrow(rotate, "vec_id long, x array<long>, lead array<double>, rest double"), "rotated")
    drop_stages(before, but_last=1)
    centroids = np.array([r["x"] for r in start], np.int64)

    def sums_of(near: Nearest):
        def run(batches):
            n, total = np.zeros(len(near.whole), np.int64), np.zeros((len(near.whole), dims), np.int64)
            for _, v, lead, rest in _slices(batches, leading):
                best = near.of(v, lead, rest)[0]
                n += np.bincount(best, minlength=len(n))
                order = np.argsort(best, kind="stable")
                used, first = np.unique(best[order], return_index=True)
                total[used] += np.add.reduceat(v[order], first, axis=0)
            # place dims of a centroid holds its count
            c, i = np.divmod(np.arange(n.size * (dims + 1)), dims + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(np.column_stack([total, n]).ravel())], names=["c", "i", "s"])

        return run

    for _ in range(rounds):
        moved = rotated.mapInArrow(sums_of(Nearest(centroids, rotation)), "c int, i int, s long").groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        total = np.zeros((len(centroids), dims + 1), object)
        for r in moved:
            total[r["c"], r["i"]] = int(r["s"])
        # division of Python's whole numbers rounds down
        centroids = np.array([[int(s) // int(t[dims]) for s in t[:dims]] if t[dims] else list(old) for t, old in zip(total, centroids)], np.int64)
    last = Nearest(centroids, rotation)

    def assign(batches):
        for ids, v, lead, rest in _slices(batches, leading):
            best, distance, compared = last.of(v, lead, rest)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance), pa.array(compared.astype(np.int32))], names=["vec_id", "cluster", "distance", "compared"])

    done = stage(rotated.mapInArrow(assign, out), "clusters")
    drop_stages(before, but_last=1)
    return done, centroids.tolist()
