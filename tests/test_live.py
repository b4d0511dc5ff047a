"""Trees under change, bucketed tables, and streams whose rows equal those of a batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import hierarchy
from fathom.operators.buckets import BucketTable
from fathom.streaming import changes

NODE = "id string, parent_id string, title string, url string"
CHANGE = "id string, seq long, op string, parent_id string, title string, url string"
TREE = [("0", None, "", None), ("a", "0", "A", None), ("b", "a", "B", None), ("c", "0", "C", None), ("x", "b", "X", "u:x"), ("y", "a", "Y", "u:y"), ("z", "c", "Z", "u:z")]
BEGIN = datetime.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def after(spark, told, nodes=TREE):
    tree = hierarchy.index(spark.createDataFrame(nodes, NODE))
    delta = hierarchy.apply_changes(tree, spark.createDataFrame(told, CHANGE))
    return {r.id: r.path for r in hierarchy.merged(tree, delta).collect()}, {r.id: r.action for r in delta.collect()}


CASES = {
    "created": ([("n", 1, "created", "b", "N", "u:n"), ("f", 2, "created", "c", "F", None), ("m", 3, "created", "f", "M", "u:m")], {"n": "A / B", "m": "C / F"}, set()),
    "renamed": ([("a", 1, "changed", None, "AA", None)], {"x": "AA / B", "y": "AA", "z": "C"}, set()),
    "moved": ([("b", 1, "moved", "c", None, None)], {"x": "C / B", "y": "A"}, set()),
    "removed": ([("a", 1, "removed", None, None, None)], {"z": "C"}, {"a", "b", "x", "y"}),
    "out of a removed folder": ([("x", 1, "moved", "c", None, None), ("a", 2, "removed", None, None, None)], {"x": "C"}, {"a", "b", "y"}),
    "removed and made again": ([("b", 1, "removed", None, None, None), ("b", 2, "created", "c", "again", None), ("n", 3, "created", "b", "N", "u:n")], {"n": "C / again"}, {"x"}),
    "into a circle": ([("a", 1, "moved", "b", None, None)], {"z": "C"}, {"a", "b", "x", "y"}),
    "unknown": ([("q", 1, "changed", None, "Q", None), ("r", 2, "removed", None, None, None)], {"x": "A / B", "y": "A", "z": "C"}, {"q", "r"}),
}


def test_tree_changes(spark):
    """All cases at once, each in a tree of its own whose ids begin with its number."""

    def own(i, row, *places):
        return tuple(f"{i}-{v}" if at in places and v is not None else v for at, v in enumerate(row))

    nodes = [own(i, n, 0, 1) for i in range(len(CASES)) for n in TREE]
    told = [own(i, c, 0, 3) for i, (log, _, _) in enumerate(CASES.values()) for c in log]
    paths, _ = after(spark, told, nodes)
    for i, (name, (_, there, gone)) in enumerate(CASES.items()):
        found = {k.split("-")[1]: v for k, v in paths.items() if k.split("-")[0] == str(i)}
        assert there.items() <= found.items(), name
        assert not gone & set(found), name
    random.Random(1).shuffle(told)
    assert after(spark, told, nodes)[0] == paths


def test_tree_changes_touch_only_what_is_below(spark):
    _, actions = after(spark, [("b", 1, "changed", None, "BB", None)])
    assert actions == {"b": "updated", "x": "updated"}
    assert after(spark, [])[1] == {}


def test_tree_too_deep(spark):
    deep = [("0", None, "", None)] + [(str(i), str(i - 1), f"t{i}", None) for i in range(1, 6)]
    with pytest.raises(ValueError, match="levels"):
        hierarchy.index(spark.createDataFrame(deep, NODE), max_depth=4)


# --- tables in buckets


@pytest.fixture
def table(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "table"), buckets=8)
    t.create(spark.createDataFrame([(str(i), i) for i in range(40)], "id string, n long"))
    return t


def test_bucket_table(spark, table):
    assert table.apply(spark.createDataFrame([("3", 33), ("99", 99)], "id string, n long"), spark.createDataFrame([("5",), ("none",)], "id string")) in (1, 2, 3)
    want = {str(i): i for i in range(40) if i != 5} | {"3": 33, "99": 99}
    assert {r.id: r.n for r in table.read().collect()} == want


def test_bucket_table_writes_nothing_twice(spark, table):
    new, gone = spark.createDataFrame([("3", 33), ("4", None)], "id string, n long"), spark.createDataFrame([("5",)], "id string")
    assert table.apply(new, gone) > 0
    held = table.versions()
    assert table.apply(new, gone) == 0
    assert table.versions() == held


def test_bucket_table_killed_while_writing(spark, table):
    before = rows(table.read())
    number = table.versions()[-1] + 1
    spark.createDataFrame([("7", -1, 0)], "id string, n long, bucket int").write.partitionBy("bucket").parquet(f"{table.path}/data/v={number}")
    assert rows(table.read()) == before
    assert table.apply(spark.createDataFrame([("7", 70)], "id string, n long")) == 1
    assert {r.id: r.n for r in table.read().collect()}["7"] == 70
    assert table.read().count() == 40


# --- streams


def stream(spark, df, path, files, by="seq"):
    """df as a stream whose batches are files of random rows."""
    parts = df.withColumn("part", F.pmod(F.xxhash64(by), F.lit(files)))
    for i in range(files):
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def results(spark, df, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows(spark.read.schema(df.schema).parquet(out))


def told(spark, n, seed, last):
    """n random events of five keys within half an hour, and one of another key ten days later, which lets all time pass."""
    r = random.Random(seed)
    found = [(i, f"k{r.randrange(5)}", r.random() < 0.5, BEGIN + datetime.timedelta(seconds=r.randrange(1800))) for i in range(n)]
    return spark.createDataFrame([*found, (n, "last", last, BEGIN + datetime.timedelta(days=10))], "seq long, tab string, flag boolean, ts timestamp")


@pytest.mark.parametrize("files", [1, 3])
def test_bounces(spark, tmp_path, files):
    events = told(spark, 120, 2, True)

    def parts(df):
        return df.where("flag").select(F.col("seq").alias("click_id"), "tab", "ts"), df.where("not flag").select("tab", "ts")

    batch = rows(changes.bounces(*parts(events), "90 seconds"))
    want, state = [], {}
    for e in sorted(events.collect(), key=lambda e: (e.ts, not e.flag, e.seq)):
        if e.flag:
            state[e.tab] = e
        elif e.tab in state:
            o = state.pop(e.tab)
            if e.ts - o.ts < datetime.timedelta(seconds=90):
                want.append((o.seq, o.ts, e.ts))
    assert batch == sorted(want, key=str)
    assert batch
    assert rows(changes.bounces(*parts(events), "90 seconds", span="2 minutes")) == batch
    assert results(spark, changes.bounces(*parts(stream(spark, events, tmp_path / "in", files)), "90 seconds"), tmp_path) == batch


@pytest.mark.parametrize("files", [1, 3])
def test_retries(spark, tmp_path, files):
    events = told(spark, 60, 3, False).select(F.col("tab").alias("id"), F.col("seq").alias("event_id"), F.when(F.col("flag"), "dead").otherwise("full").alias("status"), F.when(F.col("flag"), "HTTP 503").alias("detail"), "ts")
    batch = rows(changes.retries(events))
    assert {r[2] for r in batch} == {1, 2}
    assert results(spark, changes.retries(stream(spark, events, tmp_path / "in", files, "event_id")), tmp_path) == batch


def test_retries_give_up_and_clear(spark):
    def at(i, minutes, failed):
        return "k", i, "dead" if failed else "full", "HTTP 503" if failed else None, BEGIN + datetime.timedelta(minutes=minutes)

    schema = "id string, event_id long, status string, detail string, ts timestamp"
    failing = spark.createDataFrame([at(i, 10 * i, True) for i in range(4)], schema)
    assert [(r.event_id, r.attempts) for r in changes.retries(failing).orderBy("event_id").collect()] == [(0, 1), (1, 2), (3, 1)]  # the third is given up
    cleared = spark.createDataFrame([at(0, 0, True), at(1, 10, False), at(2, 20, True)], schema)
    assert [(r.event_id, r.attempts) for r in changes.retries(cleared).orderBy("event_id").collect()] == [(0, 1), (2, 1)]
    assert changes.retries(failing.limit(0)).count() == 0


def test_tree_stream(spark, tmp_path):
    tree = hierarchy.index(spark.createDataFrame(TREE, NODE))
    leaves = tree.where("url is not null").select("id", "title", "url", F.col("path").alias("folder_path"), F.lit("kept").alias("note"))
    stored, records, vectors = (BucketTable(spark, str(tmp_path / n), buckets=4) for n in ("tree", "records", "vectors"))
    stored.create(tree)
    records.create(leaves)
    vectors.create(leaves.select("id", F.lit(1.0).alias("v")))
    log = [("a", 1, "changed", None, "AA", None), ("n", 2, "created", "b", "N", "u:n"), ("z", 3, "removed", None, None, None), ("b", 4, "moved", "c", None, None)]
    source = stream(spark, spark.createDataFrame(log, CHANGE), tmp_path / "in", 1)
    changes.run_tree_cdc(source, stored, records, vectors, str(tmp_path / "checkpoint")).awaitTermination()
    want = hierarchy.merged(tree, hierarchy.apply_changes(tree, spark.createDataFrame(log, CHANGE)))
    assert rows(stored.read()) == rows(want)
    assert {(r.id, r.folder_path, r.note) for r in records.read().collect()} == {("x", "C / B", "kept"), ("y", "AA", "kept"), ("n", "C / B", None)}
    assert {r.id for r in vectors.read().collect()} == {"x", "y"}


def test_refined_refuses_old_versions(spark, tmp_path):
    schema = "query_id long, version int, rank int, id string"
    shown = BucketTable(spark, str(tmp_path / "shown"), key="query_id", buckets=4)
    shown.create(spark.createDataFrame([], "query_id long, version int, hits array<struct<rank: int, id: string>>"))
    batches = [[(1, 0, 1, "a"), (1, 0, 2, "b"), (2, 1, 1, "c")], [(2, 0, 1, "old"), (1, 1, 1, "b")], [(3, 0, 1, "d")], [(3, 1, None, None)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        changes.run_refined(source, shown, str(tmp_path / "checkpoint")).awaitTermination()
    found = {r.query_id: (r.version, [h.id for h in r.hits]) for r in shown.read().collect()}
    assert found == {1: (1, ["b"]), 2: (1, ["c"]), 3: (1, [])}
