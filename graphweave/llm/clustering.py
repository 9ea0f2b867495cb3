"""Clustering around centroids in whole numbers; rotated coordinates rule centroids out before any exact distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import written

#: Bound of the fit: vectors sampled for the rotation. It shapes how much is ruled out, never the result.
SAMPLE_VECTORS = 8192
DIM, CLUSTERS, ROUNDS, LEADING, SCALE, SEED = 64, 8, 10, 16, 1024, "3"
#: Components from here on would take squared distances out of 64 bits.
TOO_LARGE = 1 << 27


@dataclass
class Rotation:
    """``axes``: orthonormal rows, those of greatest variance first; the first ``leading`` coordinates are kept, the others by their norm."""

    centre: np.ndarray
    axes: np.ndarray
    leading: int

    def turn(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the rest."""
        y = (x.astype(np.float64) - self.centre) @ self.axes.T
        return y[:, : self.leading], np.sqrt((y[:, self.leading :] ** 2).sum(axis=1))


def fit_rotation(sample: np.ndarray, leading: int) -> Rotation:
    """Principal axes of the sample."""
    wide = sample.astype(np.float64)
    centre = wide.mean(axis=0) if len(wide) else np.zeros(wide.shape[1])
    _, axes = np.linalg.eigh((wide - centre).T @ (wide - centre))
    return Rotation(centre, axes.T[::-1].copy(), leading)


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turned: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each whole vector the nearest centroid (ties: the smaller number), the squared distance, and how many exact distances that took.

    |x - c|^2 is at least the squared distance of the leading coordinates plus the squared difference of the other coordinates' norms. The
    centroid of the least such bound is measured first; of the others only those whose bound (less what rounding may add) does not exceed the best distance.
    """
    c_lead, c_rest = turned
    low = ((lead[:, None, :] - c_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None]) ** 2
    sizes = (lead**2).sum(axis=1) + rest**2
    slack = 1 + 1e-9 * (sizes[:, None] + (c_lead**2).sum(axis=1) + c_rest**2)
    near = low.argmin(axis=1)
    best = ((x - centroids[near]) ** 2).sum(axis=1)
    measured, first = len(x), near.copy()
    for j, c in enumerate(centroids):
        at = np.flatnonzero((low[:, j] - slack[:, j] <= best) & (first != j))
        measured += len(at)
        d = ((x[at] - c) ** 2).sum(axis=1)
        wins = (d < best[at]) | ((d == best[at]) & (j < near[at]))
        near[at[wins]], best[at[wins]] = j, d[wins]
    return near, best, measured


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, q``: floor(scale * x) of the vectors of exactly ``dim`` components, none null or non-finite."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.size("embedding") == dim).where(finite)
    rows = rows.where(F.forall("embedding", lambda v: F.abs(v.cast("double") * scale) < TOO_LARGE))
    return rows.select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("q"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(kind)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(batch.column("q"), np.int64), _matrix(batch.column("lead"), np.float64), batch.column("rest").to_numpy()


@dataclass
class Clusters:
    """``assigned`` (``vec_id, cluster, distance``), the final ``centroids`` and the ``inertia`` of each."""

    assigned: DataFrame
    centroids: np.ndarray
    inertia: list[int]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, leading: int = LEADING, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> Clusters:
    """``rounds`` rounds of exact k-means in whole numbers over ``vec_id, embedding``.

    The centroids start as the k vectors with the least SHA-256 of ``seed:vec_id`` (fewer where there are fewer; null ids last, equal ids by components). Each
    round assigns every vector and replaces every centroid that has some by floor(sum / count) of its components; a last pass assigns once more. A round that
    moves nothing ends the loop, as all later ones would do the same. Vectors are turned once and written; a round is one pass
    that returns k times ``dim`` sums. Vectors of another length, with null or non-finite components, or with components of 2^27 and more after
    scaling (whose distances need not fit 64 bits) take no part. Repeated rows each count. No vectors give no rows.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, dim, scale)
    sample = kept.where(F.pmod(F.xxhash64("vec_id", F.lit("rotation")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_VECTORS / max(1, kept.count())))).limit(2 * SAMPLE_VECTORS)
    rotation = fit_rotation(np.array([r["q"] for r in sample.select("q").collect()], np.float64).reshape(-1, dim), leading)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation.turn(_matrix(batch.column("q"), np.int64).reshape(-1, dim))
            offsets = pa.array(np.arange(len(rest) + 1, dtype=np.int32) * leading)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(lead.reshape(-1))), pa.array(rest)], ["vec_id", "q", "lead", "rest"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    table = written(kept.mapInArrow(turned, f"vec_id {kind}, q array<int>, lead array<double>, rest double"), "turned")
    hashed = F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")), 256)
    first = table.select(hashed.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_to = rotation.turn(centroids)
        total, count = np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, lead, rest = _arrays(batch)
                near, _, _ = nearest(x, lead, rest, centroids, near_to)
                for j in np.unique(near):
                    total[j] += x[near == j].sum(axis=0)
                count += np.bincount(near, minlength=len(count))
        c, p = np.divmod(np.arange(total.size), dim)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(c.astype(np.int32)), "place": pa.array(p.astype(np.int32)), "total": pa.array(total.reshape(-1)), "n": pa.array(count[c])})

    for _ in range(rounds if len(centroids) else 0):
        found = table.mapInArrow(sums, "cluster int, place int, total long, n long").groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect()
        moved = centroids.copy()
        for r in found:
            moved[r["cluster"], r["place"]] = r["total"] // r["n"]
        if (moved == centroids).all():
            break
        centroids = moved

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_to = rotation.turn(centroids)
        for batch in batches:
            if batch.num_rows:
                near, best, _ = nearest(*_arrays(batch), centroids, near_to)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    assigned = written(table.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    return Clusters(assigned, centroids, [inertia.get(j, 0) for j in range(len(centroids))])


def query(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    facts = spark.createDataFrame([(j, i, sum(found.inertia), d) for j, (i, d) in enumerate(zip(found.inertia, digests))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows, as many as centroids
    return found.assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds() -> str:
    """The ten rounds as a chain of common table expressions."""
    out = []
    for i in range(ROUNDS + 1):
        out.append(f"""
d{i} AS MATERIALIZED (SELECT DISTINCT ON (r) r, vec_id, q, c, d FROM (
       SELECT k.r, k.vec_id, k.q, o.c, CAST(list_sum(list_transform(list_zip(k.q, o.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept k, c{i} o) ORDER BY r, d, c)""")
        if i < ROUNDS:
            out.append(f"""
s{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS q
         FROM (SELECT c, p, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS v, unnest(range(64)) AS p FROM d{i}) GROUP BY c, p) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(s.q, o.q) AS q FROM c{i} o LEFT JOIN s{i} s ON o.c = s.c)""")
    return ",".join(out)


#: The same rows in DuckDB.
SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q FROM kept ORDER BY sha256('3:' || vec_id), q LIMIT 8),{_rounds()}
SELECT d.vec_id, CAST(d.c AS INTEGER) AS cluster, d.d AS distance, CAST(sum(d.d) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia, CAST(sum(d.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(o.q, ',')) AS centroid_sha256
FROM d{ROUNDS} d JOIN c{ROUNDS} o ON d.c = o.c
"""
