"""Centroid clustering of vectors by sort-means, in whole numbers.

In each round the other centroids are ordered by their distance from each
centroid. A vector looks at them in the order of the centroid it was assigned to
last, and stops at the first that is strictly further from that centroid than
twice its own distance: by the triangle inequality neither that one nor any after
it can be as near. Sums and distances are whole numbers, so results do not
depend on the order of rows.

A round reads the table of vectors with their last cluster, written by the round
before, and writes the next one. Tasks send the sums of their clusters; what comes
to the driver is a sum per cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop

#: Whole components beyond this leave a vector out: squared distances would not fit 64 bits.
LARGEST = 1 << 26
#: Vectors that one numpy step holds.
STEP = 4096


def kept(vectors: DataFrame, vector: str, row_id: str, size: int, scale: int) -> DataFrame:
    """(vec_id, x) of vectors of `size` finite components, x being floor(scale * component) as whole numbers."""
    given = vectors.select(F.col(row_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("given")).where(F.size("given") == size)
    finite = F.forall("given", lambda c: F.coalesce(F.abs(c * scale) < LARGEST, F.lit(False)))  # false of NaN, which is above all numbers
    return given.where(finite).select("vec_id", F.transform("given", lambda c: F.floor(c * scale).cast("int")).alias("x"))


def seeds(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of least hash of seed and id, in that order."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in points.select("x", draw.alias("draw")).orderBy("draw", "x").limit(k).collect()], np.int64)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of the nearest centroid of each vector, the smaller number of ties; the
    scan goes out from the centroid `before`."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    own = ((x - centroids[before]) ** 2).sum(axis=1)
    best, cluster = own.copy(), before.copy()
    for c in np.unique(before).tolist():
        rows = np.flatnonzero(before == c)
        for other in np.argsort(apart[c], kind="stable").tolist():
            rows = rows[apart[c, other] <= 4 * own[rows]]  # of distances: not strictly beyond twice the own
            if not len(rows):
                break
            d = ((x[rows] - centroids[other]) ** 2).sum(axis=1)
            closer = (d < best[rows]) | ((d == best[rows]) & (other < cluster[rows]))
            best[rows[closer]], cluster[rows[closer]] = d[closer], other
    return cluster, best


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, x, cluster, distance) of rows (vec_id, x, cluster)."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                cluster, distance = nearest(matrix(part.column("x"), size), part.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "x", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    return points.select("vec_id", "x", "cluster").mapInArrow(run, f"vec_id {kind}, x array<int>, cluster int, distance long")


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the exact floor of the mean of its vectors; one without vectors stays."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            np.add.at(sums, cluster, matrix(batch.column("x"), size))
            rows += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(rows[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "rows", "sums"])

    parts = assigned.select("cluster", "x").mapInArrow(run, "cluster int, rows long, sums array<long>")
    whole = F.sum(F.col("s").cast("decimal(38,0)"))
    out = centroids.copy()
    for r in parts.select("cluster", "rows", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(whole.alias("s"), F.sum("rows").alias("rows")).collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // int(r["rows"])
    return out


def cluster(vectors: DataFrame, vector: str = "embedding", row_id: str = "vec_id", k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256), one row per vector kept.

    Kept are vectors of exactly `size` components, none null, NaN or infinite;
    a component becomes floor(scale * component), and vectors with one beyond
    LARGEST are left out too, since their squared distances do not fit 64 bits.
    The k vectors of least hash of seed and id are the first centroids. Each of
    `rounds` assigns every vector to its nearest centroid, the smaller number of
    ties, and moves centroids to the floor of the mean; empty ones stay. Then
    vectors are assigned once more.

    Repeated rows count as often as they come, and may be two equal centroids, of
    which the smaller number takes all. A null id is hashed as empty text. Fewer
    than k vectors make fewer centroids; none, or an empty table, give no rows.
    Other columns are ignored, whatever their names. A sum of distances
    beyond 64 bits is null.
    """
    points = cut(kept(vectors, vector, row_id, size, scale).withColumn("cluster", F.lit(0)), "vectors")
    centroids = seeds(points, k, seed)
    if not len(centroids):
        nothing = points.select("vec_id", "cluster", *[F.lit(None).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit(None).cast("array<long>").alias("centroid"), F.lit(None).cast("string").alias("centroid_sha256"))
        return nothing.limit(0)
    for turn in range(rounds + 1):
        assigned = cut(assign(points, centroids), "vectors")
        drop(points)
        points = assigned
        if turn < rounds:
            centroids = moved(assigned, centroids)
    # A row per cluster, so k rows.
    sums = {r["cluster"]: int(r["s"]) for r in points.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(c, fits(sums.get(c, 0)), fits(sum(sums.values())), row, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    per = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return points.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    near = "SELECT vec_id, x, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (SELECT v.vec_id, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{0} m) GROUP BY vec_id, x"
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS ({near.format(r)})")
        mean = f"SELECT cluster, list({floor} ORDER BY i) AS x FROM (SELECT cluster, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster"
        steps.append(f"m{r} AS ({mean})")
        steps.append(f"c{r + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.c)")
    steps.append(f"f AS ({near.format(rounds)})")
    last = f"SELECT f.vec_id, f.cluster::INTEGER AS cluster, f.distance, (sum(f.distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia, (sum(f.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c ON c.c = f.cluster"
    return "WITH " + ",\n".join(steps) + "\n" + last


ORACLE = _oracle()
