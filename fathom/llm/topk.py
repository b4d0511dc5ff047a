"""Exact top-k by inner product over a bit-sliced index.

Index: rows in blocks; of each block and attribute the integers u = (v - min) >> shift, stored as bitmaps, one
a bit of u (a slice holds that bit of all rows). A query's weighted sum of attributes is made by bitmap
arithmetic alone: its weights, in signed binary digits, file each slice (or its complement, for a negative
digit) under a power of two, and full adders on whole bitmaps reduce these to the slices of the sum. The k-th
largest sum is found from the most significant slice downward. What the shift cut off bounds how far a score
can be from its sum, so all rows within that bound of the k-th are boundary rows; they are resolved by exact
scores. The result is exact, whatever the data.

Queries are the rows the caller names, in blocks of about QUERIES. Index blocks are dealt into groups of about GROUP; a
task holds one group and the query blocks stream past it, so an index block is moved once, the queries once a
group, and k rows a query leave a group.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without an id; a query meets vectors of its own length only, and never rows of its own id; ties go to the
smaller vec_id; fewer than k candidates give fewer rows; an empty table gives an empty result; scores beyond
64 bits raise an error; rows that repeat a vec_id are candidates of their own, and the unlike vectors of a repeated
query id ask together, their best rows under one id; other columns, clashing names too, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import Stage, read

ROWS, QUERIES, GROUP, KEPT_BITS = 8192, 128, 16, 7


def _ints(column: pa.Array, rows: int) -> np.ndarray:
    m = np.floor(1024.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(rows, -1)
    if m.size and np.abs(m).max() >= 2.0**62:
        raise OverflowError("a component is too large for 64-bit scores")
    return m.astype(np.int64)


def _small(m: np.ndarray) -> np.ndarray:
    top = int(np.abs(m).max()) if m.size else 0
    return m.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _index(batches):
    """Index blocks of the rows of one partition."""
    held: dict[int, list] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids = np.concatenate([x for x, _ in held[dim]])
        m = np.concatenate([x for _, x in held[dim]])
        del held[dim]
        low = m.min(axis=0)
        width = int((m.max(axis=0) - low).max()).bit_length()
        shift = max(0, width - KEPT_BITS)
        u = (m - low) >> shift
        bits = max(1, width - shift)
        slices = np.packbits(((u[:, :, None] >> np.arange(bits)) & 1).astype(np.uint8).transpose(1, 2, 0), axis=2, bitorder="little")
        small = _small(m)
        row = [dim, len(ids), ids.tobytes(), small.tobytes(), small.dtype.itemsize, low.tobytes(), shift, bits, slices.tobytes()]
        names = ["dim", "n", "ids", "ints", "size", "low", "shift", "bits", "slices"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

    for batch in batches:
        sizes = np.diff(batch.column("v").offsets.to_numpy())
        ids = batch.column("vec_id").to_numpy()
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            m = _ints(batch.column("v").take(pa.array(at)), len(at))
            for i in range(0, len(at), ROWS):
                held.setdefault(int(dim), []).append((ids[at[i : i + ROWS]], m[i : i + ROWS]))
                if sum(len(x) for x, _ in held[dim]) >= ROWS:
                    yield block(int(dim))
    for dim in list(held):
        yield block(dim)


INDEX = "dim int, n int, ids binary, ints binary, size int, low binary, shift int, bits int, slices binary"


def _digits(x: int) -> list[tuple[int, int]]:
    """(position, sign) of the signed binary digits of x, no two of them adjacent."""
    out, at, sign = [], 0, 1 if x >= 0 else -1
    x = abs(x)
    while x:
        if x & 1:
            d = 2 - (x & 3)
            out.append((at, d * sign))
            x -= d
        x >>= 1
        at += 1
    return out


def _sum_slices(terms: dict[int, list[int]]) -> list[int]:
    """Add bitmaps filed by power of two: full adders three at a time, until one slice a power is left."""
    out: list[int] = []
    at, top = 0, max(terms, default=-1)
    while at <= top:
        have = terms.get(at, [])
        carry = terms.setdefault(at + 1, [])
        while len(have) > 2:
            a, b, c = have.pop(), have.pop(), have.pop()
            x = a ^ b
            have.append(x ^ c)
            carry.append((a & b) | (x & c))
        if len(have) == 2:
            a, b = have
            have = [a ^ b]
            carry.append(a & b)
        out.append(have[0] if have else 0)
        if carry:
            top = max(top, at + 1)
        at += 1
    return out


def _kth(slices: list[int], among: int, k: int) -> int:
    """The k-th largest value, from the most significant slice downward."""
    sure, value = 0, 0
    for at in range(len(slices) - 1, -1, -1):
        ones = among & slices[at]
        if (sure | ones).bit_count() >= k:
            among = ones
            value |= 1 << at
        else:
            sure |= ones
            among &= ~slices[at]
    return value


def _at_least(slices: list[int], among: int, value: int) -> int:
    if value <= 0:
        return among
    if value >> len(slices):
        return 0
    more, same = 0, among
    for at in range(len(slices) - 1, -1, -1):
        if value >> at & 1:
            same &= slices[at]
        else:
            more |= same & slices[at]
            same &= ~slices[at]
    return more | same


def _search(k: int):
    """Rows come by group, in each the index blocks (kind 0) before the query blocks (kind 1); only one group's index is held."""

    def run(batches):
        group, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):  # one at a time: a row is a block
                row = batch.slice(at, 1).to_pylist()[0]
                if row["group"] != group:
                    group, held = row["group"], []
                if row["kind"] == 0:
                    held.append(_opened(row))
                    continue
                found = pa.Table.from_batches([_block_top(block, row, k) for block in held if block["dim"] == row["dim"]] or [pa.RecordBatch.from_pylist([], _FOUND)])
                yield from _best(found, k).to_batches()

    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query."""
    found = found.sort_by([("query_id", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
    q = found.column("query_id").to_numpy()
    first = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.empty(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
    return found.filter(pa.array(nth < k))


def _opened(row: dict) -> dict:
    """An index block with its slices as bitmaps."""
    n, dim, bits = row["n"], row["dim"], row["bits"]
    packed = np.frombuffer(row["slices"], np.uint8).reshape(dim, bits, -1)
    slices = [[int.from_bytes(packed[d, b].tobytes(), "little") for b in range(bits)] for d in range(dim)]
    ints = np.frombuffer(row["ints"], {2: np.int16, 4: np.int32, 8: np.int64}[row["size"]]).reshape(n, dim)
    return {"n": n, "dim": dim, "bits": bits, "shift": row["shift"], "ids": np.frombuffer(row["ids"], np.int64), "ints": ints, "slices": slices}


def _block_top(block: dict, asked: dict, k: int) -> pa.RecordBatch:
    n, bits, shift, ids, ints, slices = (block[x] for x in ("n", "bits", "shift", "ids", "ints", "slices"))
    full = (1 << n) - 1
    top_u = (1 << bits) - 1
    queries, vectors, scores, bound = [], [], [], int(np.abs(ints.astype(np.int64)).max()) if n else 0
    for q_id, q in zip(asked["q_ids"], asked["q_vectors"]):
        q = [math.floor(1024.0 * x) for x in q]
        if sum(map(abs, q)) * bound >= 1 << 63:
            raise OverflowError("a score does not fit 64 bits")
        among = full
        for at in np.flatnonzero(ids == q_id):
            among &= ~(1 << int(at))
        have = min(k, among.bit_count())
        if not have:
            continue
        terms: dict[int, list[int]] = {}
        lifted = 0  # what the complements add to every row's sum
        for d, x in enumerate(q):
            for at, sign in _digits(x):
                for b in range(bits):
                    terms.setdefault(at + b, []).append(slices[d][b] if sign > 0 else full ^ slices[d][b])
                if sign < 0:
                    lifted += top_u << at
        sums = _sum_slices(terms)
        kth = _kth(sums, among, have)
        # a score is a constant + (sum << shift) + what was cut off, between these
        cut = (1 << shift) - 1
        spread = cut * sum(map(abs, q))
        near = _at_least(sums, among, kth - -(-spread // (1 << shift)))
        at = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n])
        exact = ints[at].astype(np.int64) @ np.array(q, np.int64)
        best = np.lexsort((ids[at], -exact))[:k]
        queries += [q_id] * len(best)
        vectors += ids[at][best].tolist()
        scores += exact[best].tolist()
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (queries, vectors, scores)], schema=_FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows of vectors (vec_id, embedding) for each query row."""
    if k < 1:
        raise ValueError("k is at least 1")
    spark = vectors.sparkSession
    stage = Stage(spark, "topk")
    c = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.size(c) > 0, F.lit(False)) & F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.where(fine)
    index = stage.write(rows.select("vec_id", c.cast("array<double>").alias("v")).mapInArrow(_index, INDEX), "index")
    asked = stage.write(rows.where(is_query).select(F.col("vec_id").alias("q_id"), c.cast("array<double>").alias("v")).distinct(), "queries")
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    grouped = asked.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("q_id"), F.lit(blocks)).alias("q")).agg(F.collect_list(F.struct("q_id", "v")).alias("l"))
    asked = grouped.select("dim", F.col("l.q_id").alias("q_ids"), F.col("l.v").alias("q_vectors"))
    groups = max(1, math.ceil(index.select("n").count() / GROUP))
    index = index.withColumns({"group": F.pmod(F.xxhash64("ids"), F.lit(groups)), "kind": F.lit(0)})
    asked = asked.withColumns({"group": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))), "kind": F.lit(1)})
    pairs = index.unionByName(asked, allowMissingColumns=True).repartition("group").sortWithinPartitions("group", "kind")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH fine AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
