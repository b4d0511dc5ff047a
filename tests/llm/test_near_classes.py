"""Classes of near-duplicates: ids that repeat with unlike texts, and the bounded comparison of blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import near_dedup


@pytest.mark.parametrize("turned", [False, True])
def test_unlike_texts_of_one_id_keep_all_links(spark, turned):
    rng = random.Random(1)
    a, b = ([f"w{rng.randrange(10_000)}" for _ in range(60)] for _ in range(2))
    near = lambda words, i: " ".join([*words[:i], "changed", *words[i + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b, 20)), (3, near(a, 30)), (4, "some other text"), (0, near(b, 59))]
    rows = rows[::-1] if turned else rows
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shingle=2)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)}


def test_blocks_are_compared_whole(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 60, 50).astype(np.uint64)
    sets = []
    for i in range(60):
        own = base.copy() if i % 3 else rng.integers(1, 1 << 60, 30 + i).astype(np.uint64)
        own[: i % 7] = rng.integers(1, 1 << 60, min(i % 7, len(own))).astype(np.uint64)
        sets.append(np.unique(own))
    sets.append(np.unique(rng.integers(1, 1 << 60, 5000).astype(np.uint64)))
    sets.append(sets[-1][:4500])
    side = [i % 2 for i in range(len(sets))]
    table = pa.table({"side": pa.array(side, pa.int32()), "rep": pa.array(range(len(sets)), pa.int64()), "comp": pa.array(range(len(sets)), pa.int64()), "members": pa.array([x.tobytes() for x in sets], pa.binary())})

    def forest(links):
        up = list(range(len(sets)))
        for x, y in links:
            p, q = up[x], up[y]
            up = [min(p, q) if u in (p, q) else u for u in up]
        return up

    want = forest((i, j) for i in range(len(sets)) for j in range(len(sets)) if side[i] == 0 and side[j] == 1 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])))
    for filed, meetings in ((1 << 18, 1 << 20), (200, 300), (1, 1)):
        monkeypatch.setattr(near_dedup, "FILED", filed)
        monkeypatch.setattr(near_dedup, "MEETINGS", meetings)
        found = near_dedup._block_links(80)(table.slice(0))
        assert forest(zip(found["a"].to_pylist(), found["b"].to_pylist())) == want
    assert len(set(want)) < len(sets) - 20
