"""Passes over a stored library that a killed job takes up where it was: ingest, embedding, tags.

A ledger holds the last input version that each step has finished. A step writes its tables and then its row of the ledger;
steps do the same when run again, and write only buckets whose rows differ, so a pass that stops anywhere is finished by
running it again, and a pass over what has not changed writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import embed, library, tags
from fathom.operators.buckets import BucketTable
from fathom.operators.held import hold
from fathom.operators.store import stale

LEDGER = "step string, version string"


def new_ledger(spark: SparkSession, path: str) -> BucketTable:
    ledger = BucketTable(spark, path, key="step", buckets=1)
    if not ledger.versions():
        ledger.create(spark.createDataFrame([], LEDGER))
    return ledger


def run(steps: list[tuple[str, Callable[[], None]]], ledger: BucketTable, version: str) -> list[str]:
    """Run the steps that the ledger does not have under this version, in order; returns their names."""
    done = {r.step for r in ledger.read().where(F.col("version") == version).collect()}  # a row a step
    ran = []
    for name, step in steps:
        if name in done:
            continue
        step()
        ledger.apply(ledger.spark.createDataFrame([(name, version)], LEDGER))
        ran.append(name)
    return ran


def ingest(now: DataFrame, records: BucketTable, vectors: BucketTable) -> None:
    """Records of the current tree `now`: rows rebuilt, those that went are taken out, their vectors first."""
    stored = records.read()
    rebuilt = hold(library.rebuild(now, stored))
    gone = hold(stored.join(rebuilt.select("id"), "id", "left_anti").select("id"))
    vectors.apply(removed=gone)
    # columns that a pass does not make stay as they are stored
    kept = [c for c in stored.columns if c not in rebuilt.columns]
    records.apply(rebuilt.join(stored.select("id", *kept), "id", "left"), gone)


def embed_pass(records: BucketTable, vectors: BucketTable, make: Callable[[], embed.EmbeddingProvider], version: str) -> None:
    """Vectors of records whose text has none of this model version; the stamp is written after the vector."""
    stored = records.read()
    made = hold(embed.embed_stale(stored, make, version))
    vectors.apply(made)
    stamped = stored.join(made.select("id"), "id", "left_semi").withColumn("model_version", F.lit(version))
    records.apply(stamped)


def tag_stamp(model_version: str, taxonomy: DataFrame) -> str:
    """The version of tags: model and contents of the taxonomy (id, description, ...) they are made by; it does not depend on row order."""
    total = taxonomy.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "description").cast("decimal(38,0)")).alias("h")).first()
    return f"{model_version}#{total.n}#{int(total.h or 0) % 2**64:016x}"


def tag_vectors(taxonomy: DataFrame, stored: BucketTable, make: Callable[[], embed.EmbeddingProvider], version: str) -> DataFrame:
    """(tag, ordinal, vector) of taxonomy (ordinal, id, description): only descriptions that changed, or a new model, are embedded.

    stored: (id, model_version, text_hash, vector), the dimension from earlier passes; tags that went are taken out.
    """
    wanted = taxonomy.select("id", "ordinal", "description", F.sha2("description", 256).alias("text_hash"))
    known = stored.read()
    fresh = wanted.join(known.where(F.col("model_version") == version).select("id", "text_hash"), ["id", "text_hash"], "left_anti")
    todo = fresh.select("id", F.col("description").alias("composite_text"), F.lit(None).cast("string").alias("model_version"))
    made = hold(embed.embed_stale(todo, make, version).join(fresh.select("id", "text_hash"), "id"))
    stored.apply(made, known.join(wanted.select("id"), "id", "left_anti").select("id"))
    return stored.read().join(wanted.select("id", "ordinal"), "id").select(F.col("id").alias("tag"), "ordinal", "vector")


def tag_pass(records: BucketTable, vectors: BucketTable, taxonomy: DataFrame, dimension: BucketTable, make: Callable[[], embed.EmbeddingProvider], version: str, threshold: float = tags.THRESHOLD) -> None:
    """Tags of embedded records whose tag stamp is not the current one: the host's first, then the nearest, at most four."""
    stamp = tag_stamp(version, taxonomy)
    todo = records.read().where(stale(F.col("tag_model_version"), stamp, F.col("composite_text")))
    own = vectors.read().where(F.col("model_version") == version).join(todo.select("id"), "id", "left_semi")
    nearest = tags.zero_shot(own, tag_vectors(taxonomy, dimension, make, version), threshold)
    listed = nearest.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda t: t["tag"]).alias("near"))  # two a record
    none = F.array().cast("array<string>")
    tagged = tags.host_tags(todo.join(own.select("id"), "id", "left_semi")).join(listed, "id", "left")
    tagged = tagged.withColumn("tags", tags.merged(F.col("heuristic"), F.coalesce("near", none))).withColumn("tag_model_version", F.lit(stamp))
    records.apply(tagged)


def stamp_topics(records: BucketTable, topics: DataFrame) -> int:
    """Write learned_tags of records from topics (id, label), null or missing: none; returns how many buckets were written."""
    given = topics.where("label is not null").select("id", F.array("label").alias("given"))
    both = records.read().join(given, "id", "left")
    return records.apply(both.withColumn("learned_tags", F.coalesce("given", F.array().cast("array<string>"))))
