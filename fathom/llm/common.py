"""Shared pieces of the operators: stage tables, word splitting, hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, a temporary folder stands in for an unset one.
    """
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="fathom-")
    return _own_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles_only(spark: SparkSession):
    """Shuffle files of the queries run within go when each of them ends."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Stage:
    """Tables written between the steps of one operator call.

    A written table cuts lineage: a lost executor costs its tasks, not the steps before. Its shuffle files go
    with the query that wrote it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/fathom-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with _own_shuffles_only(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *wanted: str) -> str:
    """A column name that does not clash with those of df."""
    name = wanted[0]
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept between batches up to a bounded number of words."""

    def __init__(self, most: int = 400_000):
        import xxhash

        super().__init__()
        self.most, self.digest = most, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.digest(word)
        return found

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """One a Python worker: words that one task has met are known to the next."""
    return WordHashes()


def hash_words(text: bytes, hashes: WordHashes, most: int = 4_000_000) -> np.ndarray:
    """Hashes of the words of one text, which is split piece by piece, so a long one is never a list of all its words."""
    if len(text) <= most:
        return hashes(text.split())
    found, at = [], 0
    while at < len(text):
        to = at + most
        while to < len(text) and text[to] not in b" \t\n\r\x0b\x0c":
            to += 1
        found.append(hashes(text[at:to].split()))
        at = to
    return np.concatenate(found)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; the whole sequence as one if it is shorter; nothing for no words."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = words[: n - width + 1].copy()
    with np.errstate(over="ignore"):
        out = mix64(out + np.uint64(width))
        for i in range(1, width):
            out = mix64(out * GOLDEN + words[i : n - width + 1 + i])
    return out


_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def rolling_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words, from prefix sums of a polynomial; nothing for fewer words."""
    global _powers
    n = len(words)
    if n < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(_powers[0]) < n:
            most = max(n, 4096)
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(most, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers[0][:n])])
        return mix64((sums[size:] - sums[:-size]) * _powers[1][: n - size + 1] + np.uint64(size))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 texts of an Arrow string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def in_batches(rows_iter, column: str, most_chars: int = 2_000_000):
    """Cut Arrow batches so that one holds about `most_chars` bytes of text, a single row at least."""
    for batch in rows_iter:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most_chars
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for at, to in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(at), int(to - at))


def local_forest(batches):
    """Union-find over the edges (a, b) of one partition: a star for each component, at most as many rows as edges."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(find(x), x) for x in parent if find(x) != x]
    for i in range(0, len(pairs), 10_000):
        a, b = zip(*pairs[i : i + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


#: Edges that one task of a round handles and writes, at least.
EDGES_A_TASK = 200_000


def components(edges: DataFrame, stage: Stage, name: str = "cc", most_rounds: int = 60, shrunk: bool = False) -> DataFrame:
    """Connected components of undirected edges (a long, b long): (node, component), component the least node.

    Each partition first shrinks its edges by union-find, unless the caller has done so; then large-star and small-star steps run over
    written tables until nothing changes, in as many tasks and files as their edges need. No node's neighbours are
    gathered anywhere: minima are aggregated before the shuffle. Nodes without an edge are not returned.
    """
    edges = edges.where("a <> b").select("a", "b")
    now = stage.write(edges if shrunk else edges.mapInArrow(local_forest, "a long, b long"), f"{name}-0")
    most = now.count()
    for turn in range(1, most_rounds + 1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("mb")).select("a", F.least("a", "mb").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: every node's smaller neighbours, and the node itself, point to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").distinct()
        new = stage.write(small.select(F.col("x").alias("a"), F.col("y").alias("b")).coalesce(1 + most // EDGES_A_TASK), f"{name}-{turn}")
        n, held = new.select(F.count("*"), F.countDistinct("b")).first()
        settled = n == held and new.join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        stage.drop(f"{name}-{turn - 1}")
        now = new
        if settled:  # every node hangs on one root, and no root hangs on another
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
