"""What the stages of the pipeline decide is still there in its last rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import bpe, mixing
from fathom.llm.common import Stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def last(spark):
    """Documents of many files, mixed, written, read and tokenized as run() does."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Alpha", "beta", "gamma,", "x1"]) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    texts[7], texts[8] = "", None
    docs = spark.createDataFrame([(i, t, "en", "abc"[min(i % 7, 2)], len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(6)
    stages = dict(corpus_pipeline.STAGES)
    stage = Stage(spark, "order")
    again = stage.write(stages["mixing sources to target weights"](spark, docs, ""), "mixed")
    return docs, corpus_pipeline.STAGES[-1][1](spark, again.repartition(5, F.hash("doc_id")), "").collect()


def test_order_is_the_mixture(last):
    docs, rows = last
    want = mixing.schedule(docs.select("doc_id", "source")).select("doc_id", "mix.slot", "mix.place").orderBy("slot", "place").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in want]
    assert [(r.slot, r.place) for r in rows] == [(r.slot, r.place) for r in want]


def test_ids_are_decoded_too(last):
    docs, rows = last
    encoder = bpe.Encoder(bpe.tokenizer_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        ids = encoder(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(encoder.decode(r.token_ids).encode()).hexdigest()
        assert bool(r.token_ids) == bool(texts[r.doc_id])
