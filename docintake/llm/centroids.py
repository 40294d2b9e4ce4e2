"""Centroid clustering in exact integers with an incremental distance matrix.

A vector's components become integers.  Its dot products with all centroids are
kept beside it in a table.  When centroids move, only their components that
changed are multiplied: the differences are added to the products kept, and the
nearest centroid follows from ``|v|^2 - 2 v.c + |c|^2`` without another look at
the components that stayed.  Every round writes the table anew and deletes the
one before.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.llm.common import forget, kept
from docintake.session import send_by_value

send_by_value(__name__)

#: Integers below this have squared distances and dot products of 64 components that fit a long.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of ``dims`` components, none null or not finite, as integers floor(scale * x)."""
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))

    def usable(x: Column) -> Column:
        # a null or NaN fails both bounds
        return F.coalesce((scale * x > -LARGEST) & (scale * x < LARGEST), F.lit(False))

    sound = vectors.where(F.size(vector) == dims).where(F.forall(parts, usable))
    return sound.select(F.col(vec_id).alias("vec_id"), F.transform(parts, lambda x: F.floor(scale * x).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:vec_id``, in that order; ``k`` rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def moved(rows: DataFrame, before: np.ndarray | None, after: np.ndarray) -> DataFrame:
    """(vec_id, v, dots, cluster, distance) for new centroids, from the dot products with those before."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    dims = after.shape[1]
    change = after - (0 if before is None else before)
    # of each centroid, the components that changed
    places = [(k, np.flatnonzero(row)) for k, row in enumerate(change) if row.any()]
    norms = (after * after).sum(axis=1)

    def assign(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, dims).astype(np.int64)
            if before is None:
                dots = np.zeros((len(v), len(after)), np.int64)
            else:
                dots = batch.column("dots").flatten().to_numpy().reshape(len(v), -1).copy()
            for k, at in places:
                dots[:, k] += v[:, at] @ change[k, at]
            far = norms - 2 * dots
            # the first of equal minima: ties go to the smaller number
            nearest = far.argmin(axis=1)
            distance = far[np.arange(len(v)), nearest] + (v * v).sum(axis=1)
            flat = pa.array(dots.ravel())
            starts = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(after))
            columns = [batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(starts, flat)]
            columns += [pa.array(nearest.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "dots", "cluster", "distance"])

    return rows.mapInArrow(assign, f"vec_id {kind}, v array<int>, dots array<bigint>, cluster int, distance bigint")


def means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the exact means; sums are made map-side, one row per cluster reaches the driver."""
    k, dims = centroids.shape
    sums = [F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(dims)]
    new = centroids.copy()
    for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[r.cluster] = [r[f"s{j}"] // r.n for j in range(dims)]
    return new


def clustered(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Left out are null vectors, those of another length or with a component
    that is null or not finite, and those whose scaled components reach 2^27,
    as their distances fit no long.  Rows that repeat an id are vectors of
    their own; starts that tie by id are taken by their components.  Fewer
    vectors than ``k`` give as many centroids.  A sum of distances that fits
    no long is null.  An empty table gives an empty result.
    """
    rows = kept(whole_vectors(vectors, vec_id, vector, dims, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)
    state = kept(moved(rows, None, centroids), "dots")
    forget(rows)
    for _ in range(rounds):
        new = means(state, centroids)
        last, state = state, kept(moved(state, centroids, new), "dots")
        forget(last)
        centroids = new

    totals = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # k rows
    of_cluster = {r.cluster: int(r.total) for r in totals}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def listed(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)

    return state.select(
        "vec_id",
        "cluster",
        "distance",
        listed([long_or_none(of_cluster.get(n, 0)) for n in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(long_or_none(sum(of_cluster.values()))).cast("long").alias("inertia"),
        listed(digests, "string").alias("centroid_sha256"),
    )


def long_or_none(n: int) -> int | None:
    return n if n < 1 << 63 else None
