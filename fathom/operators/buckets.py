"""Keyed tables in buckets, of which a change writes only those whose rows differ.

A table is a folder: data/v=N/bucket=B holds bucket B as version N wrote it, commits/v=N says for every bucket which version
that is. A version is there once its commit is complete, so a job that is killed while it writes leaves the version
before it as it was, and doing the same change again gives the same table. A change that changes nothing writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketTable:
    """One table under path; key is its column of unique keys, buckets how many parts it has (a bound of the commits' rows)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column.cast("string")), F.lit(self.buckets)).cast("int")

    def _files(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of complete versions."""
        fs, path = self._files("commits")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self._files("commits", n, "_SUCCESS")[1]))

    def _commit(self, version: int) -> dict[int, int]:
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/commits/v={version}").collect()  # at most one a bucket
        return {r.bucket: r.version for r in rows}

    def _read(self, held: dict[int, int]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(held.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as its newest version, or one of the two newest, has it."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no complete version in {self.path}")
        return self._read(self._commit(found[-1] if version is None else version))

    def _write(self, rows: DataFrame, version: int, held: dict[int, int], touched: set[int]) -> None:
        rows.withColumn("bucket", self._bucket(F.col(self.key))).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/v={version}")
        fs, path = self._files("data", f"v={version}")
        full = {int(s.getPath().getName()[7:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket=")}
        now = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(full, version)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/v={version}")

    def create(self, rows: DataFrame) -> None:
        """Write the whole table anew."""
        self.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{self.path}/schema")
        version = 1 + max(self.versions(), default=-1)
        self._write(rows, version, {}, set(range(self.buckets)))
        self._clear()

    def apply(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Put rows of changed in place of those of their keys, take keys of removed out; returns how many buckets were written.

        Rows that are stored as they are, and keys that are not there, touch nothing. Of rows that repeat a key one stays.
        """
        version = self.versions()[-1]
        held = self._commit(version)
        stored = self._read(held)
        columns, own = stored.columns, F.col(self.key)
        new = self.spark.createDataFrame([], stored.schema) if changed is None else changed.select(*columns).dropDuplicates([self.key])
        out = self.spark.createDataFrame([], stored.select(self.key).schema) if removed is None else removed.select(self.key).distinct()
        new = new.join(out, self.key, "left_anti")
        was = stored.select(own.alias("k"), F.struct(*columns).alias("was"))
        differ = new.join(was, own == F.col("k"), "left").where(~F.struct(*columns).eqNullSafe(F.col("was"))).select(*columns)
        gone = out.join(stored.select(self.key), self.key, "left_semi")
        numbers = differ.select(self._bucket(own).alias("b")).union(gone.select(self._bucket(own).alias("b"))).distinct()
        touched = {r.b for r in numbers.collect()}  # at most one a bucket
        if not touched:
            return 0
        before = self._read({b: v for b, v in held.items() if b in touched})
        rows = before.join(differ.select(self.key), self.key, "left_anti").join(out, self.key, "left_anti").select(*columns).unionByName(differ)
        self._write(rows, version + 1, held, touched)
        self._clear()
        return len(touched)

    def _clear(self) -> None:
        """Remove what neither of the two newest versions reads."""
        found = self.versions()
        used = {(b, v) for n in found[-2:] for b, v in self._commit(n).items()}
        for n in found[:-2]:
            fs, path = self._files("commits", f"v={n}")
            fs.delete(path, True)
        fs, data = self._files("data")
        for v in fs.listStatus(data):
            number = int(v.getPath().getName()[2:])
            if number > found[-1]:
                continue
            for b in fs.listStatus(v.getPath()):
                name = b.getPath().getName()
                if name.startswith("bucket=") and (int(name[7:]), number) not in used:
                    fs.delete(b.getPath(), True)
