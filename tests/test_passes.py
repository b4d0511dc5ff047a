"""Passes over a stored library: killed between steps, run twice, after changes."""

import pytest
from pyspark.sql import functions as F

from fathom.operators import passes
from fathom.operators.buckets import BucketTable
from fathom.operators.embed import HashingProvider

NOW = "id string, url string, canonical_url string, title string, folder_path string, date_added long"
RECORD = NOW + ", composite_text string, content_hash string, status string, tags array<string>, learned_tags array<string>, model_version string, tag_model_version string"
TAGS = "ordinal int, id string, description string"


def page(i, title):
    return str(i), f"https://site{i}.example/", f"https://site{i}.example/", title, "Library", i


class Library:
    def __init__(self, spark, path):
        self.spark = spark
        self.records, self.vectors, self.dimension = (BucketTable(spark, f"{path}/{n}", buckets=4) for n in ("records", "vectors", "dimension"))
        self.records.create(spark.createDataFrame([], RECORD))
        self.vectors.create(spark.createDataFrame([], "id string, vector array<float>, model_version string"))
        self.dimension.create(spark.createDataFrame([], "id string, model_version string, text_hash string, vector array<float>"))
        self.ledger = passes.new_ledger(spark, f"{path}/ledger")
        self.taxonomy = spark.createDataFrame([(0, "sea", "ships and harbours"), (1, "wood", "trees and forests")], TAGS)

    def steps(self, pages, killed=None):
        now = self.spark.createDataFrame(pages, NOW)
        version = HashingProvider(32).model_version
        steps = {
            "ingest": lambda: passes.ingest(now, self.records, self.vectors),
            "embed": lambda: passes.embed_pass(self.records, self.vectors, lambda: HashingProvider(32), version),
            "tag": lambda: passes.tag_pass(self.records, self.vectors, self.taxonomy, self.dimension, lambda: HashingProvider(32), version, 0.3),
        }

        def kill():
            raise InterruptedError

        return [(n, kill if n == killed else s) for n, s in steps.items()]

    def state(self):
        return [sorted(map(str, t.read().select(*sorted(t.read().columns)).collect())) for t in (self.records, self.vectors)]

    def versions(self):
        return [t.versions() for t in (self.records, self.vectors, self.dimension)]


def test_killed_pass_goes_on(spark, tmp_path):
    pages = [page(1, "ships and harbours"), page(2, "trees and forests"), page(3, "nothing else")]
    killed, whole = Library(spark, tmp_path / "killed"), Library(spark, tmp_path / "whole")
    with pytest.raises(InterruptedError):
        passes.run(killed.steps(pages, "tag"), killed.ledger, "1")
    assert passes.run(killed.steps(pages), killed.ledger, "1") == ["tag"]
    assert passes.run(whole.steps(pages), whole.ledger, "1") == ["ingest", "embed", "tag"]
    assert killed.state() == whole.state()
    found = {r.id: r for r in whole.records.read().collect()}
    assert "sea" in found["1"].tags and "wood" in found["2"].tags and "sea" not in found["3"].tags
    # the same input again under another version runs all steps and writes nothing
    before = whole.versions()
    assert passes.run(whole.steps(pages), whole.ledger, "2") == ["ingest", "embed", "tag"]
    assert whole.versions() == before
    # a page that goes takes its vector with it
    passes.run(whole.steps(pages[:2]), whole.ledger, "3")
    assert {r.id for r in whole.vectors.read().collect()} == {r.id for r in whole.records.read().collect()} == {"1", "2"}


def test_topics_are_stamped_only_where_they_change(spark, tmp_path):
    records = BucketTable(spark, str(tmp_path / "records"), buckets=4)
    records.create(spark.range(20).select(F.col("id").cast("string").alias("id"), F.array().cast("array<string>").alias("learned_tags")))
    topics = spark.createDataFrame([("1", "sea ships"), ("2", None)], "id string, label string")
    assert passes.stamp_topics(records, topics) == 1
    assert passes.stamp_topics(records, topics) == 0
    assert {r.id: r.learned_tags for r in records.read().where("size(learned_tags) > 0").collect()} == {"1": ["sea ships"]}


def test_only_changed_descriptions_are_embedded(spark, tmp_path):
    library = Library(spark, tmp_path)

    class Counted(HashingProvider):
        def embed_documents(self, texts):
            if "ships and harbours" in texts:
                raise AssertionError("embedded again")
            return super().embed_documents(texts)

    first = passes.tag_vectors(library.taxonomy, library.dimension, lambda: HashingProvider(32), "m")
    assert {r.tag for r in first.collect()} == {"sea", "wood"}
    changed = spark.createDataFrame([(0, "sea", "ships and harbours"), (1, "hill", "hills")], TAGS)
    second = passes.tag_vectors(changed, library.dimension, lambda: Counted(32), "m")
    assert {r.tag for r in second.collect()} == {"sea", "hill"}
    assert passes.tag_stamp("m", changed) != passes.tag_stamp("m", library.taxonomy) == passes.tag_stamp("m", library.taxonomy.orderBy(F.desc("id")))
