"""Spherical k-means over any number of vectors, seeded by squared cosine distance.

Seeding draws one centre a pass: a row of weight w and draw u has the key -log(u) / w, and the row of the least key is one
drawn with probability in proportion to w. Keys merge by minimum, so a pass gives one row whatever the partitions are.
A round gives, in one aggregation, the sums and sizes of all clusters, how many rows moved and the row that fits worst,
which an empty cluster takes as its centre. Only centres, at most k times the dimension, come to the driver.

Vectors that are null, zero or of null or non-finite components take no part; one of another length raises. Fewer distinct
directions than k give fewer clusters; ties go to the first centre; no vectors give no clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.vectors import normalize
from fathom.operators.held import hold

#: Squared distances below this are those of one direction.
SAME = 1e-18


def prepared(vectors: DataFrame) -> DataFrame:
    """(id, v): vectors (id, vector) of unit length, held."""
    usable = F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return hold(vectors.where(usable & F.exists("vector", lambda x: x != 0)).select("id", normalize(F.col("vector")).alias("v")))


def draw(seed: int, step: int) -> Column:
    """A whole number of 64 bits for each id and step; :func:`uniform` makes it one between 0 and 1."""
    return F.xxhash64(F.col("id").cast("string"), F.lit(seed), F.lit(step))


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h.astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != dim).any():
        raise ValueError(f"a vector has another length than {dim}")
    return flat.reshape(-1, dim)


def seeds(rows: DataFrame, k: int, dim: int, seed: int) -> np.ndarray:
    """Up to k rows (id, v), each drawn by its squared distance to the nearest of those before; the first by chance alone."""
    found: list[list[float]] = []
    for step in range(k):
        centers = np.array(found)

        def least(batches, centers=centers):
            best = None
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                m = _matrix(batch.column("v"), dim)
                w = np.ones(len(m)) if not len(centers) else (1 - (m @ centers.T).max(axis=1)) ** 2
                h = batch.column("h").to_numpy(zero_copy_only=False)
                with np.errstate(divide="ignore"):
                    keys = np.where(w > SAME, -np.log(uniform(h)) / w, np.inf)
                at = np.lexsort((h, keys))[0]
                if np.isfinite(keys[at]) and (best is None or (keys[at], h[at]) < best[:2]):
                    best = keys[at], h[at], m[at].tolist()
            if best is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "h", "v"), best))], schema=pa.schema({"key": pa.float64(), "h": pa.int64(), "v": pa.list_(pa.float64())}))

        drawn = rows.select("v", draw(seed, step).alias("h")).mapInArrow(least, "key double, h long, v array<double>")
        first = drawn.agg(F.min(F.struct("key", "h", "v")).alias("m")).first().m
        if first is None:
            break
        found.append(first.v)
    return np.array(found).reshape(-1, dim)


_PART = pa.schema({"cluster": pa.int32(), "n": pa.int64(), "moved": pa.int64(), "sums": pa.list_(pa.float64()), "sim": pa.float64(), "v": pa.list_(pa.float64())})


def fitted(rows: DataFrame, centers: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after rounds over rows (id, v), until no row moves."""
    k, dim = centers.shape
    before = None
    for _ in range(rounds):

        def sums(batches, centers=centers, before=before):
            total, n, moved, worst = np.zeros((k, dim)), np.zeros(k, np.int64), 0, None
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                m = _matrix(batch.column("v"), dim)
                sims = m @ centers.T
                now = sims.argmax(axis=1)
                moved += len(now) if before is None else int((now != (m @ before.T).argmax(axis=1)).sum())
                own = sims[np.arange(len(m)), now]
                np.add.at(total, now, m)
                n += np.bincount(now, minlength=k)
                at = int(own.argmin())
                if worst is None or own[at] < worst[0]:
                    worst = float(own[at]), m[at].tolist()
            if worst is not None:
                none = [None] * (k - 1)
                columns = [list(range(k)), n.tolist(), [moved] + [0] * (k - 1), total.tolist(), [worst[0], *none], [worst[1], *none]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PART)], schema=_PART)

        parts = rows.select("v").mapInArrow(sums, "cluster int, n long, moved long, sums array<double>, sim double, v array<double>")
        parts = parts.select("cluster", F.posexplode("sums").alias("d", "x"), "n", "moved", F.when(F.col("sim").isNotNull(), F.struct("sim", "v")).alias("worst"))
        first = F.col("d") == 0
        merged = parts.groupBy("cluster", "d").agg(F.sum("x").alias("x"), F.sum(F.when(first, F.col("n"))).alias("n"), F.sum(F.when(first, F.col("moved"))).alias("moved"), F.min(F.when(first, F.col("worst"))).alias("worst"))
        found = merged.collect()  # k times the dimension
        if not sum(r.moved or 0 for r in found):
            break
        before, total = centers, np.zeros((k, dim))
        size = np.zeros(k, np.int64)
        for r in found:
            total[r.cluster, r.d] = r.x
            size[r.cluster] += r.n or 0
        worst = min((r.worst for r in found if r.worst is not None), key=tuple)
        total[size == 0] = worst.v
        centers = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return centers


def assigned(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, cluster): the nearest centre of each row (id, v), ties to the first."""
    dim = centers.shape[1]

    def nearest(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((_matrix(batch.column("v"), dim) @ centers.T).argmax(axis=1), pa.int64())], ["id", "cluster"])

    return rows.select("id", "v").mapInArrow(nearest, f"id {rows.schema['id'].dataType.simpleString()}, cluster long")


def spherical_kmeans(vectors: DataFrame, k: int, seed: int, rounds: int) -> DataFrame:
    """(id, cluster) of vectors (id, vector)."""
    rows = prepared(vectors)
    any_ = rows.select(F.size("v").alias("d")).first()
    if any_ is None:
        return rows.select("id", F.lit(None).cast("long").alias("cluster"))
    return assigned(rows, fitted(rows, seeds(rows, k, any_.d, seed), rounds))
