"""Near-duplicate vectors by Euclidean p-stable hashing in several tables, then exact cosine checks.

A table's hash of a normalised vector v is floor((a_i v + b_i) / w) for k Gaussian directions a_i. On the unit
sphere a cosine is a distance, so k and the number of tables follow from the number of vectors and the
wanted recall at the threshold: k grows with log N, so that an unrelated vector meets about one other a table.

Equal vectors are one class, counted with its size. A bucket of at most SMALL classes gives their pairs, so a class
has at most SMALL - 1 of them a table. Larger buckets are compared block against block as matrices; a pair counts in
the first table where it shares a large bucket, and pairs of small buckets that share a large one are left to that.
So each pair counts once, and a large bucket writes a count for each class and a spanning forest of its links, never
its links. Every link is confirmed by its cosine in double precision; nothing is capped.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing
(n_links 0, own component, kept); vectors of different lengths never link; rows that repeat a vec_id count
as vectors of their own; a null vec_id has no component; an empty table gives an empty result; other columns
are ignored, clashing names too; components tie to the smallest vec_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import GOLDEN, Stage, components, mix64, read

SMALL, BLOCK = 16, 1024
WIDTH = 2.0


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one p-stable hash of two points at this distance is equal."""
    if distance <= 0:
        return 1.0
    t = width / distance
    phi = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_shape(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(hashes a table, tables) for n vectors: recall at the threshold, about one unrelated partner a table."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that no square is too large or too small
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _keys(k: int, tables: int, seed: int):
    def run(batches):
        drawn: dict[int, tuple] = {}
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            out = np.zeros((batch.num_rows, tables), np.uint64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                if dim not in drawn:
                    rng = np.random.default_rng([seed, int(dim)])
                    drawn[dim] = rng.standard_normal((int(dim), k * tables)), rng.uniform(0, WIDTH, k * tables)
                a, b = drawn[dim]
                unit = _unit(_matrix(batch.column("v").take(pa.array(at)), len(at)))
                codes = np.floor((unit @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(at), tables, k)
                with np.errstate(over="ignore"):
                    h = np.broadcast_to(mix64(np.arange(1, tables + 1, dtype=np.uint64) * GOLDEN + np.uint64(dim)), (len(at), tables))
                    for i in range(k):
                        h = mix64(h * GOLDEN + codes[:, :, i])
                out[at] = h
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(out.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("c"), batch.column("v"), listed], ["rep", "c", "v", "keys"])

    return run


def _cosines(cosine: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = np.zeros(batch.num_rows, bool)
            size = np.diff(batch.column("va").offsets.to_numpy())
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x, y = (_unit(_matrix(batch.column(c).take(pa.array(at)), len(at))) for c in ("va", "vb"))
                keep[at] = np.einsum("ij,ij->i", x, y) >= cosine
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def _block_links(cosine: float):
    """Of one block pair: (a, b, n) with b null and n the vectors that class a links with, or b a link of a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table.num_rows
        side, rep, c = (table.column(x).to_numpy() for x in ("side", "rep", "c"))
        t = int(table.column("t")[0].as_py())
        large = table.column("large").combine_chunks()
        at = np.repeat(np.arange(n), np.diff(large.offsets.to_numpy()))
        entries = large.flatten()
        earlier, bucket = entries.field("t").to_numpy(), entries.field("bucket").to_numpy()
        keys = np.arange(n, dtype=np.int64)[:, None] * np.ones(t, np.int64) if t else np.empty((n, 0), np.int64)
        held = np.zeros((n, t), bool)
        before = earlier < t
        keys[at[before], earlier[before]], held[at[before], earlier[before]] = bucket[before], True
        unit = _unit(np.array(table.column("v").to_pylist(), np.float64).reshape(n, -1))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        degree = np.zeros(n, np.int64)
        up = np.arange(n)

        def find(x: int) -> int:
            root = x
            while up[root] != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        forest: list[tuple[int, int]] = []
        for start in range(0, len(left), 128):
            some = left[start : start + 128]
            i, j = np.nonzero(unit[some] @ unit[right].T >= cosine)
            x, y = some[i], right[j]
            # within one block each pair is there twice, and each vector meets itself; between blocks it is there once
            ok = (rep[x] < rep[y]) | ((side[x] == 0) & (side[y] == 1))
            x, y = x[ok], y[ok]
            for e in range(t):
                first = ~(held[x, e] & held[y, e] & (keys[x, e] == keys[y, e]))
                x, y = x[first], y[first]
            np.add.at(degree, x, c[y])
            np.add.at(degree, y, c[x])
            for p, q in zip(x.tolist(), y.tolist()):
                p, q = find(p), find(q)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    forest.append((p, q))
        some = np.flatnonzero(degree)
        a = np.concatenate([rep[some], rep[[p for p, _ in forest]] if forest else np.empty(0, np.int64)])
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rep[[q for _, q in forest]] if forest else [], pa.int64())])
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.concat_arrays([pa.array(degree[some], pa.int64()), pa.nulls(len(forest), pa.int64())])})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.98, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    stage = Stage(spark, "vectors")
    component = F.col("embedding")
    fine = F.coalesce(F.size(component) > 0, F.lit(False)) & F.coalesce(F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(component, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(fine & F.col("vec_id").isNotNull(), component.cast("array<double>")).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c"))
    classes = stage.write(classes, "classes")
    k, tables = table_shape(classes.count(), cosine, recall)
    coded = stage.write(classes.mapInArrow(_keys(k, tables, seed), "rep long, c long, v array<double>, keys array<long>"), "coded")
    met = coded.select("rep", F.posexplode("keys").alias("t", "bucket"))
    many = met.groupBy("bucket", "t").agg(F.count("*").alias("size")).where("size > 1")
    members = stage.write(met.join(many, ["bucket", "t"]), "members")
    big = members.where(F.col("size") > SMALL)
    large_of = big.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("t", "bucket"))).alias("large"))  # at most one a table
    none = F.array().cast("array<struct<t: int, bucket: bigint>>")
    of = stage.write(coded.select("rep", "c", "v").join(large_of, "rep", "left").withColumn("large", F.coalesce("large", none)), "of")
    # pairs of small buckets: at most SMALL - 1 partners for each member
    lists = members.where(F.col("size") <= SMALL).groupBy("bucket", "t").agg(F.array_sort(F.collect_list("rep")).alias("r"))
    pairs = lists.select(F.posexplode("r").alias("p", "a"), "r").select("a", F.explode(F.slice("r", F.col("p") + 2, F.lit(SMALL))).alias("b")).distinct()
    a, b = (of.select(F.col("rep").alias(x), F.col("v").alias(f"v{x}"), F.col("large").alias(f"large{x}")) for x in "ab")
    met_small = pairs.join(a, "a").join(b, "b").where("size(va) = size(vb) and not arrays_overlap(largea, largeb)").select("a", "b", "va", "vb")
    checked = stage.write(met_small.mapInArrow(_cosines(cosine), "a long, b long"), "small")
    nb = big.withColumns({"nb": F.ceil(F.col("size") / BLOCK).cast("int"), "x": F.xxhash64("rep", F.lit(1))}).withColumn("x", F.pmod("x", "nb").cast("int"))
    copies = nb.select("bucket", "t", "rep", "x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"))
    copies = copies.select("bucket", "t", "rep", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.when(F.col("x") == F.col("y"), 2).when(F.col("x") < F.col("y"), 0).otherwise(1).alias("side"))
    blocks = stage.write(copies.join(of, "rep").groupBy("bucket", "t", "i", "j").applyInArrow(_block_links(cosine), "a long, b long, n long"), "blocks")
    links = checked.union(blocks.where("b is not null").select("a", "b"))
    comp = components(links, stage)
    both = checked.union(checked.select("b", "a")).toDF("rep", "other")
    counted = both.join(classes.select(F.col("rep").alias("other"), "c"), "other").select("rep", "c").union(blocks.where("n is not null").select("a", "n"))
    degree = counted.groupBy("rep").agg(F.sum("c").alias("n"))
    of_class = classes.select("rep", "c", "v").join(degree, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("v", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component", "rep").alias("g"))
    out = rows.join(of_class, "v", "left")
    group = F.coalesce("g", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), group).alias("component_id"), (F.col("vec_id") == group).alias("kept"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
