"""Co-training picks its pseudo-labels from all unlabelled documents."""

import numpy as np

from fathom.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sure_ones_are_of_all_documents(spark):
    rng = np.random.default_rng(2)
    n = 7000
    texts = ["".join(rng.choice(list("abc #$"), 12)) for _ in range(n)]
    rows = [(i, texts[i - 3] if i % 50 == 3 else texts[i], "en", f"s{i % 9}", 12) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    known = spark.createDataFrame([(i,) for i in range(0, n, 3)], "doc_id long")
    fitted = [rng.normal(0, 4, d + 1).astype(np.float32) for d in (quality.TEXT_DIMS, quality.META_DIMS)]
    keys = {r.doc_id: r.key for r in quality._keyed(df).select("doc_id", "key").collect()}
    learned = ({keys[1]}, {keys[i] for i in range(1, n, 7)})
    got = {(r.view, r.label, r.key) for r in quality.sure_ones(df, known, fitted, learned, 40).collect()}
    want = set()
    for v in (0, 1):
        x = np.stack([quality.text_view(t.encode()) if v == 0 else quality.meta_view(s, g, c, t.encode()) for _, t, g, s, c in rows])
        z = (x @ fitted[v]).astype(np.float64)
        for label in (0, 1):
            sign = 1 if label else -1
            best = {keys[i]: z[i] * sign for i in range(n) if i % 3 and z[i] * sign >= np.log(19) and keys[i] not in learned[1 - v]}
            top = sorted(best.items(), key=lambda kv: -kv[1])
            if len(top) > 40:
                edge = top[39][1]
                sure = {(v, label, k) for k, s in top if s > edge + 1e-4}
                near = {(v, label, k) for k, s in top if s >= edge - 1e-4}
                mine = {g for g in got if g[:2] == (v, label)}
                assert len(mine) == 40 and sure <= mine <= near
            else:
                want = {(v, label, k) for k, _ in top}
                assert want == {g for g in got if g[:2] == (v, label)}
    assert got


def test_every_document_can_be_learned_from(spark, monkeypatch):
    """Two rare, very sure documents among 9,000 reach the other view, whatever their ids."""
    seen = {}
    inner = quality.co_train

    def spy(xs, y, surest, held):
        def noted(fitted, learned):
            out = surest(fitted, learned)
            for _, rows in out:
                seen.update(rows)
            return out

        return inner(xs, y, noted, held)

    monkeypatch.setattr(quality, "co_train", spy)
    rows = [(i, "good clean words here" if i % 2 else "$$$ ### !!! $$$", "en", "a" if i % 2 else "b", 20) for i in range(300)]
    rows += [(i, "x1 y2 z3", "en", "c", 8) for i in range(300, 9300)]
    rows += [(9300 + i, "$$$ ### !!! $$$ ###" + "!" * i, "en", "b", 20) for i in range(2)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    assert quality.fit(df, labels) is not None
    rare = {r.key for r in quality._keyed(df.where("doc_id >= 9300")).select("key").collect()}
    assert rare <= set(seen)
