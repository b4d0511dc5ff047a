"""Spherical k-means against a plain loop on the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import clusters, tags


def plain(ids, vectors, k, draws, rounds):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    centers = []
    for step in range(k):
        weight = [1.0 if not centers else min((1 - float(v @ c)) ** 2 for c in centers) for v in unit]
        keys = [(-np.log(clusters.uniform(np.array([draws[step][i]]))[0]) / w, draws[step][i], at) for at, (i, w) in enumerate(zip(ids, weight)) if w > clusters.SAME]
        if not keys:
            break
        centers.append(unit[min(keys)[2]])
    centers = np.array(centers)
    before = None
    for _ in range(rounds):
        sims = unit @ centers.T
        now = sims.argmax(axis=1)
        if before is not None and (now == before).all():
            break
        before, worst = now, unit[sims.max(axis=1).argmin()]
        sums = [unit[now == j].sum(axis=0) if (now == j).any() else worst for j in range(len(centers))]
        centers = np.array([s / np.linalg.norm(s) for s in sums])
    return dict(zip(ids, (unit @ centers.T).argmax(axis=1).tolist()))


def frame(spark, x):
    return spark.createDataFrame([(str(i), [float(c) for c in v]) for i, v in enumerate(x)], "id string, vector array<double>")


@pytest.mark.parametrize("n, parts", [(90, 1), (90, 7), (2000, 5)])
def test_equals_plain_loop(spark, n, parts):
    rng = np.random.default_rng(n)
    x = np.eye(8)[np.arange(n) % 5] + rng.uniform(-0.3, 0.3, (n, 8))
    df = frame(spark, x).repartition(parts)
    draws = [{r.id: r.h for r in df.select("id", clusters.draw(7, step).alias("h")).collect()} for step in range(6)]
    got = {r.id: r.cluster for r in clusters.spherical_kmeans(df, 6, 7, 30).collect()}
    assert got == plain([str(i) for i in range(n)], x, 6, draws, 30)


def test_groups_of_many_rows(spark):
    """50,000 rows about three directions: one algorithm at every size finds them."""
    rows = spark.range(50_000).select(F.col("id").cast("string").alias("id"), *[(F.when(F.col("id") % 3 == d, 1.0).otherwise(0.0) + F.rand(d) * 0.1).alias(f"x{d}") for d in range(4)])
    df = rows.select("id", F.array("x0", "x1", "x2", "x3").alias("vector"))
    found = clusters.spherical_kmeans(df, 3, 1, 30).groupBy((F.col("id").cast("long") % 3).alias("g"), "cluster").count().collect()
    assert len(found) == 3
    assert len({r.cluster for r in found}) == 3
    assert sum(r["count"] for r in found) == 50_000


def test_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [float("nan"), 1.0]), ("e", [2.0, None]), ("f", [3.0, 0.0]), ("g", [0.0, 5.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    got = {r.id: r.cluster for r in clusters.spherical_kmeans(df, 4, 1, 30).collect()}
    assert set(got) == {"a", "f", "g"}
    assert got["a"] == got["f"] != got["g"]
    assert clusters.spherical_kmeans(df.limit(0), 4, 1, 30).count() == 0
    with pytest.raises(Exception, match="another length"):
        clusters.spherical_kmeans(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0])], "id string, vector array<double>"), 2, 1, 5).collect()


def test_small_libraries_have_no_topics(spark):
    assert tags.learn_topics(frame(spark, np.eye(8))).count() == 0
