"""File and page sources, embedding, and the engine's surface."""

import json

from pyspark.sql import functions as F

from fathom.operators import crawl, embed, tags
from fathom.plans.api import Engine
from fathom.sources import adapters, files, http

SF = "/root/testdata/sf0.001"


def test_profile_tree(spark, tmp_path):
    leaf = {"id": "10", "name": "x", "type": "url", "url": "https://a.example"}
    roots = {"bookmark_bar": {"id": "1", "name": "Bar", "children": [leaf, {"id": "11", "name": "Dev", "children": [{**leaf, "id": "110"}]}]}, "other": {"id": "2", "name": "Other", "children": []}}
    (tmp_path / "b.json").write_text(json.dumps({"roots": roots}))
    got = {(r.id, r.parent_id) for r in files.profile_tree(spark, str(tmp_path / "b.json")).collect()}
    assert got == {("0", None), ("1", "0"), ("10", "1"), ("11", "1"), ("110", "11")}


def test_deep_profile_tree(spark, tmp_path):
    node = {"id": "40", "name": "leaf", "type": "url", "url": "https://a.example/?q=x\"y"}
    for i in range(39, 0, -1):
        node = {"id": str(i), "name": f"folder {i}", "type": "folder", "children": [node]}
    (tmp_path / "b.json").write_text(json.dumps({"roots": {"other": node}}))
    got = {r.id: (r.parent_id, r.url) for r in files.profile_tree(spark, str(tmp_path / "b.json")).collect()}
    assert got["40"] == ("39", node_url(tmp_path / "b.json"))
    assert len(got) == 41


def node_url(path):
    node = json.loads(path.read_text())["roots"]["other"]
    while "children" in node:
        node = node["children"][0]
    return node["url"]


def test_goldens(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"minHitRate": 0.75, "queries": [{"query": "a", "expect": ["x"], "k": 3}, {"query": "b", "expect": []}]}))
    assert [(r.text, r.k, r.min_hit_rate) for r in files.goldens(spark, str(tmp_path / "g.json")).orderBy("query_id").collect()] == [("a", 3, 0.75), ("b", 5, 0.75)]


def test_fetch(spark):
    def transport(u):
        if "down" in u:
            raise OSError("no route")
        return (200, "text/html", b"<title>t</title>") if "ok" in u else (503, "text/html", b"")

    rows = spark.createDataFrame([("1", "https://ok.example"), ("2", "https://bad.example"), ("3", "https://down.example")], "id string, url string")
    got = {r.id: (r.http_status, r.body, r.detail) for r in http.fetch(rows, transport).collect()}
    assert got == {"1": (200, "<title>t</title>", None), "2": (503, None, "HTTP 503"), "3": (None, None, "no route")}


def test_status_and_icons(spark):
    row = spark.range(1)
    status = crawl.fetch_status(F.lit(False), F.lit("Text/HTML; charset=x"), F.lit(True), F.lit("words"), F.lit(False))
    assert row.select(status).first()[0] == "full"
    assert row.select(crawl.fetch_status(F.lit(False), F.lit("image/png"), F.lit(True), F.lit("w"), F.lit(True))).first()[0] == "baseline"
    icons = spark.createDataFrame([("a", True, 1, None), ("b", False, 3, None), ("c", False, 2, None)], "origin string, has_icon boolean, sync_version int, declared_url string")
    declared = spark.createDataFrame([("a", "u"), ("b", None), ("c", None), ("d", None)], "origin string, declared string")
    assert {r.origin for r in crawl.icon_due(icons, declared).collect()} == {"c", "d"}
    queue = spark.createDataFrame([("1", 2, 50)], "id string, attempts int, not_before long")
    both = crawl.enqueue(queue, spark.createDataFrame([("1",), ("2",)], "id string"))
    assert {(r.id, r.attempts) for r in both.collect()} == {("1", 2), ("2", 0)} and crawl.due(both, 10).count() == 1


def test_embed_stale(spark):
    rows = spark.createDataFrame([("1", "some text", None), ("2", "other", "v"), ("3", "", None)], "id string, composite_text string, model_version string")
    out = embed.embed_stale(rows, lambda: embed.HashingProvider(16), "v").collect()
    assert [(r.id, len(r.vector), r.model_version) for r in out] == [("1", 16, "v")]


def test_engine(spark):
    records, vectors, clicks = adapters.records(spark, SF), adapters.vectors(spark, SF), adapters.clicks(spark, SF)
    engine = Engine(spark, records, vectors, clicks)
    queries = engine.embed_queries(["the and", "", "of the"])
    hits = engine.search(queries, {"floor": 0.1}, now_ms=1_707_000_000_000)
    assert hits.count() > 0 and hits.where("query_id = 1").count() == 0
    first = hits.where("rank = 1").first()
    less = engine.delete(first.id)
    assert less.reveal(first.id).count() == 0 and less.undo_delete().reveal(first.id).count() == 1
    assert less.vectors.count() < vectors.count() == less.undo_delete().vectors.count()
    assert engine.ingest(adapters.records(spark, SF)).records.count() == records.count()
    assert engine.browse("name", "Library / en").count() < engine.browse().count()
    assert engine.suggest(queries.drop("vector")).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 6
    assert engine.state().first().records == records.count()
    labels = tags.centroids(vectors, "label").select(F.concat(F.lit("l"), "cluster").alias("tag"), F.col("cluster").alias("ordinal"), F.col("centroid").alias("vector"))
    assert engine.tag(labels, 0.0).groupBy("id").count().agg(F.max("count")).first()[0] <= 2
