"""Centroid clustering by delta Lloyd: a round looks only at what can have changed.

Vectors are written once, in buckets of a row key; each round's assignments are a narrow table in the same buckets, so
that they meet again without moving vectors. A round is told the centroids and which of them changed. A vector whose
owner stayed where it was has its distance from the last round, and compares it with the changed centroids only; a vector
whose owner moved compares all. Where a vector changes hands, its components go as signed integers from one cluster to
the other: a task adds up what it transfers, Spark adds the tasks' sums, and the driver keeps the global sums of k
clusters. Everything is whole numbers, so that the order of additions does not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buckets, one_thread

LIMB = 40  # bits of the parts in which tasks hand on their sums, so that Spark's 64-bit sums of them can't overflow
ROWS = 100_000  # of a bucket
FLOATS, LONGS, WHOLE = "f8", "i8", "O"


def arithmetic(dims: int, most: float) -> str:
    """The numbers in which squared distances of components up to `most` are exact."""
    far = dims * (2 * most + 1) ** 2
    return FLOATS if far < 1 << 53 else LONGS if far < 1 << 63 else WHOLE


def matrix(column: pa.Array, stored: str, dims: int, kind: str) -> np.ndarray:
    m = np.frombuffer(b"".join(column.to_pylist()), dtype=stored).reshape(len(column), dims)
    return np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape) if kind == WHOLE else m.astype(kind)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, vectors by centroids."""
    return (vectors * vectors).sum(axis=1)[:, None] - 2 * (vectors @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :]


def reassigned(vectors: np.ndarray, owner: np.ndarray, near: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and their squared distances; owner -1 is none yet, ties go to the smaller number."""
    owner, near = owner.copy(), near.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        all_of = distances(vectors[lost], centroids)
        best = np.argmin(all_of, axis=1)
        owner[lost], near[lost] = best, all_of[np.arange(len(best)), best]
    steady = np.flatnonzero(~lost)
    if len(steady) and changed.any():
        numbers = np.flatnonzero(changed)
        some = distances(vectors[steady], centroids[numbers])
        best = np.argmin(some, axis=1)
        gap, number = some[np.arange(len(best)), best], numbers[best]
        won = (gap < near[steady]) | ((gap == near[steady]) & (number < owner[steady]))
        owner[steady[won]], near[steady[won]] = number[won], gap[won]
    return owner, near


def limbs(total: int) -> list[int]:
    """A whole number in parts of LIMB bits, lowest first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) <= total < 1 << LIMB:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


ASSIGNED = "row long, id long, owner int, near long, cluster int, part int, size long, total array<long>"


def _round(joined: DataFrame, stored: str, dims: int, kind: str, centroids: list[list[int]], changed: list[bool]) -> DataFrame:
    """(row, id, owner, near) of every vector and, under rows below zero, each task's transfers (cluster, part, size, total)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        at, moved = np.array(centroids, dtype=kind).reshape(len(centroids), dims), np.array(changed)
        totals, sizes = np.zeros((len(centroids), dims), dtype=object if kind == WHOLE else np.int64), np.zeros(len(centroids), dtype=np.int64)
        names = [c.split()[0] for c in ASSIGNED.split(", ")]
        for batch in batches:
            n = batch.num_rows
            x = matrix(batch.column(2), stored, dims, kind)
            was = batch.column(3).to_numpy(zero_copy_only=False)
            near = np.full(n, 0, dtype=object) if kind == WHOLE else batch.column(4).to_numpy(zero_copy_only=False).astype(kind)
            # Distances that take over 64 bits aren't kept: such vectors are compared with all centroids again.
            now, near = reassigned(x, np.full(n, -1) if kind == WHOLE else was, near, at, moved)
            left = np.flatnonzero(now != was)
            whole = x[left] if kind == WHOLE else x[left].astype(np.int64)
            np.add.at(totals, now[left], whole)
            np.add.at(sizes, now[left], 1)
            had = was[left] >= 0
            np.subtract.at(totals, was[left][had], whole[had])
            np.subtract.at(sizes, was[left][had], 1)
            near = pa.array([int(d) if d < 1 << 63 else None for d in near], pa.int64()) if kind == WHOLE else pa.array(near.astype(np.int64))
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(now.astype(np.int32)), near, *none], names)
        rows = []
        for c in range(len(centroids)):
            parts = [limbs(int(t)) for t in totals[c]]
            for part in range(max(map(len, parts), default=0)):
                total = [p[part] if part < len(p) else 0 for p in parts]
                if any(total) or (part == 0 and sizes[c]):
                    row = -1 - (TaskContext.get().partitionId() << 32) - len(rows)  # of its own, so that no bucket gets them all
                    rows.append((row, None, None, None, c, part, int(sizes[c]) if part == 0 else 0, total))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return joined.select("row", "id", "v", "owner", "near").mapInArrow(step, ASSIGNED)


def lloyd(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept vector, and the final centroids' whole components.

    Kept are vectors of exactly `dims` components, none of them null, NaN or infinite; component x counts as
    floor(scale * x). The first centroids are the k kept vectors of the smallest SHA-256 of `seed:id` (null ids last, then
    by components). In each round every vector goes to its nearest centroid, ties to the smaller number, and each cluster
    that has vectors takes floor(sum / count) of each component; then vectors are assigned once more. Rounds in which no
    centroid changed change nothing, and are not run. Repeated rows are vectors of their own; fewer than k vectors give
    as many clusters; none give an empty result and no centroids. Components of any finite size are exact; a squared
    distance that takes more than 63 bits comes back as null. Other columns play no part. The driver holds k centroids
    and sums; no frame is broadcast by us.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.where(x.isNotNull() & (F.size(x) == dims) & finite).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    seen = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c * scale)))).alias("most")).first()
    if not seen["n"] or not k:
        return spark.createDataFrame([], "id long, cluster int, distance long"), []
    most = seen["most"] + 1  # rounding down can add one to the size
    kind, stored = arithmetic(dims, most), "<f4" if most < 1 << 24 else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False) * scale).astype(stored).reshape(batch.num_rows, dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in flat], pa.binary())], ["row", "id", "v"])

    tables = Buckets(spark, max(16, -(-seen["n"] // ROWS)))
    rows = kept.select(F.monotonically_increasing_id().alias("row"), "id", "x").mapInArrow(packed, "row long, id long, v binary")
    rows = tables.written(rows, "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select("v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = [[int(c) for c in np.frombuffer(r["v"], dtype=stored).tolist()] for r in first]
    sums, sizes, changed = [[0] * dims for _ in centroids], [0] * len(centroids), [True] * len(centroids)
    state = rows.select("row", "id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("near"))
    for turn in range(rounds + 1):
        assigned = tables.written(_round(state, stored, dims, kind, centroids, changed), "assigned")
        if turn == rounds:
            break
        moves = assigned.where("cluster IS NOT NULL").select("cluster", "part", "size", F.posexplode("total").alias("d", "t"))
        for r in moves.groupBy("cluster", "part", "d").agg(F.sum("size").alias("size"), F.sum("t").alias("t")).collect():
            sums[r["cluster"]][r["d"]] += r["t"] << LIMB * r["part"]
            sizes[r["cluster"]] += r["size"] if r["d"] == 0 else 0
        new = [[s // n for s in total] if n else old for total, n, old in zip(sums, sizes, centroids, strict=True)]
        changed = [a != b for a, b in zip(new, centroids, strict=True)]
        centroids = new
        if not any(changed):
            break
        state = rows.join(assigned.where("cluster IS NULL").select("row", "owner", "near"), "row")
    out = tables.released("assigned").where("cluster IS NULL")
    tables.forget("vectors")
    return out.select("id", F.col("owner").alias("cluster"), F.col("near").alias("distance")), centroids


def op12(spark, sf_dir: str) -> DataFrame:
    found, centroids = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    names = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = found.groupBy("cluster").agg(exact.alias("d"))  # a row for each of the k clusters
    total = inertia.agg(F.sum("d").try_cast("long").alias("inertia"))
    inertia = inertia.select("cluster", F.col("d").try_cast("long").alias("cluster_inertia"))
    known = inertia.join(names, "cluster").crossJoin(total)
    return found.join(F.broadcast(known), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_GAPS = "list_transform(c, lambda q: list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
OP12_SQL = f"""
WITH RECURSIVE kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rounds(r, c) AS (
  SELECT 0, list(v ORDER BY h) FROM (SELECT v, sha256('3:' || vec_id) AS h FROM kept ORDER BY h LIMIT 8)
  UNION ALL
  SELECT r + 1, list_transform(range(1, len(c) + 1), lambda i: coalesce(m[i], c[i])) FROM (
    SELECT r, any_value(c) AS c, map(list(owner), list(list_transform(s, lambda t: ((t - ((t % n) + n) % n) // n)::BIGINT))) AS m FROM (
      SELECT r, any_value(c) AS c, owner, count(*) AS n, [{', '.join(f'sum(v[{j}])' for j in range(1, 65))}] AS s FROM (
        SELECT r, c, v, list_position(g, list_min(g))::BIGINT AS owner FROM (SELECT r, c, v, {_GAPS} AS g FROM rounds, kept WHERE r < 10))
      GROUP BY r, owner) GROUP BY r)),
last AS (SELECT vec_id, c, list_position(g, list_min(g)) AS owner, list_min(g)::BIGINT AS distance FROM (SELECT vec_id, c, {_GAPS} AS g FROM rounds, kept WHERE r = 10))
SELECT vec_id, (owner - 1)::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY owner))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c[owner], ',')) AS centroid_sha256 FROM last
"""
