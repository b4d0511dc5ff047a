"""Quality classifier by co-training two views of a document.

The text view sees hashed byte trigrams of the whole text; the metadata view sees source, language, length and
line layout. Each is a logistic regression, first fitted to labelled rows. In every round each view labels,
of all unlabelled documents, those that it is most sure of, and the other view trains on them. A part of the
labelled rows is held out to calibrate both views (Platt scaling) and their combination, which scores every
document. Documents scored below `keep_at` are rejected.

Labelled rows are a bounded sample, at most MOST_LABELLED by the least hashes of their ids. A round is a pass over
all documents: the sure ones give a narrow row each (no text), those with a label go by an anti join, and of each
view and class the surest SHARE, at most MOST_NEW, are taken; only their features reach the driver. Documents alike
in text and metadata count once there, ties go to the least hash. Scoring runs over all documents, whole texts,
without a shuffle, and its state is the two weight vectors.

Defined results: a null text counts as empty; missing metadata is a value of its own; a document labelled more
than once has the mean label; labels of one class alone, or none, train nothing: then scores are null and every
document is kept; repeated rows get equal scores; an empty table gives an empty result; all other columns,
clashing names too, are passed on by :func:`keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import in_batches, mix64, read, texts

MOST_LABELLED, MOST_NEW = 4000, 200
TEXT_DIMS, META_DIMS = 1024, 256
ROUNDS, SURE, SHARE = 4, 0.95, 0.05


def text_view(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, unit length; a last element for the bias."""
    out = np.zeros(TEXT_DIMS + 1, np.float32)
    out[-1] = 1
    count = np.zeros(TEXT_DIMS, np.int64)
    for at in range(0, max(len(text) - 2, 0), 1 << 20):
        b = np.frombuffer(text[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        count += np.bincount(((code * np.uint32(2654435761)) >> np.uint32(20)) & np.uint32(TEXT_DIMS - 1), minlength=TEXT_DIMS)
    if total := count.sum():
        out[:-1] = np.sqrt(count / total)
    return out


def _bucket(name: str, value) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{name}={value}") % META_DIMS


def meta_view(source, lang, n_chars, text: bytes) -> np.ndarray:
    """Hashed indicators of source, language, length and line layout; a last element for the bias."""
    out = np.zeros(META_DIMS + 1, np.float32)
    lines = text.count(b"\n") + 1
    size = len(text) if n_chars is None else n_chars
    known = {"source": source, "lang": lang, "size": int(np.log2(max(size, 0) + 1) * 2), "lines": int(np.log2(lines) * 2), "per line": int(np.log2(len(text) / lines + 1) * 2)}
    for item in known.items():
        out[_bucket(*item)] = 1
    out[-1] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 150, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression by accelerated gradient descent, in the precision of x."""
    kind = x.dtype
    w = np.zeros(x.shape[1], kind) if start is None else start.astype(kind)
    back, look, turned = w, w, np.ascontiguousarray(x.T)
    scale = (weight / weight.sum()).astype(kind)
    shrink = np.append(np.full(x.shape[1] - 1, penalty), 0).astype(kind)
    rate = kind.type(1.0 / (0.25 * float((x * x).sum(axis=1) @ scale) + penalty))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        w = look - rate * (turned @ (scale * (p - y).astype(kind)) + shrink * look)
        look = w + kind.type((t - 1) / (t + 2)) * (w - back)
        back = w
    return w


def _balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)


class Model:
    """Weights of both views, and of their calibrated combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, calibrate: list[tuple[float, float]], combine: np.ndarray):
        self.text, self.meta, self.calibrate, self.combine = text, meta, calibrate, combine

    def __call__(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: by text, by metadata, and together."""
        logits = [a * (x @ w) + b for (a, b), x, w in zip(self.calibrate, (x_text, x_meta), (self.text, self.meta))]
        both = np.stack([*logits, np.ones(len(logits[0]))], axis=1) @ self.combine
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*logits, both))


def co_train(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest, held: np.ndarray) -> Model:
    """Fit both views. xs, y: labelled rows; held: those of them kept for calibration.

    surest: (weights of both views, keys learned so far by each) to (label by key, row of features by key) of what
    each view has to learn from the other.
    """
    penalty = (1e-4, 1e-3)
    train = ~held
    extra: tuple[dict[int, int], dict[int, int]] = ({}, {})  # unlabelled rows each view has learned from the other
    seen: tuple[dict[int, np.ndarray], dict[int, np.ndarray]] = ({}, {})
    fitted: list[np.ndarray] = []
    for turn in range(ROUNDS + 1):
        new: list[np.ndarray] = []
        for v in (0, 1):
            x = np.concatenate([xs[v][train], *(seen[v][k][None] for k in extra[v])])
            t = np.concatenate([y[train], np.fromiter(extra[v].values(), np.int64, len(extra[v]))])
            new.append(logistic(x, t, _balanced(t), penalty[v], 60 if turn else 300, fitted[v] if turn else None))
        fitted = new
        if turn == ROUNDS:
            break
        found = surest(fitted, extra)
        for v, (labels, features) in enumerate(found):
            extra[v].update(labels)
            seen[v].update(features)
        if not any(labels for labels, _ in found):
            break
    tuned, logits = [], []
    for v in (0, 1):
        z = xs[v][held] @ fitted[v]
        a, b = logistic(np.stack([z, np.ones(len(z))], axis=1), y[held], np.ones(held.sum()), 1e-4)
        tuned.append((float(max(a, 0.0)), float(b)))
        logits.append(tuned[-1][0] * z + tuned[-1][1])
    combine = logistic(np.stack([*logits, np.ones(len(logits[0]))], axis=1), y[held], np.ones(held.sum()), 1e-4)
    return Model(fitted[0], fitted[1], tuned, combine)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    whole = texts(batch.column("text"))
    meta = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
    return np.stack([text_view(t) for t in whole]), np.stack([meta_view(*m, t) for m, t in zip(meta, whole)])


def _features(batches):
    for batch in in_batches(batches, "text", 1_000_000):
        a, b = _views(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary())], ["doc_id", "label", "t", "m"])


COLUMNS = ["doc_id", "text", "source", "lang", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """What the views see of docs, and `key`, a hash of that without the id."""
    rows = docs.select(*COLUMNS[:4], F.col("n_chars").cast("long").alias("n_chars"))
    return rows.withColumn("key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS[1:]]))


def sure_ones(docs: DataFrame, known: DataFrame, fitted: list[np.ndarray], learned: tuple, most: int) -> DataFrame:
    """(view, label, key): of all rows without a known id, the `most` distinct ones each view is surest of, class by class.

    learned: keys that each view has learned already and is not given again.
    """
    old = tuple(np.array(sorted(keys), np.int64) for keys in learned)

    def run(batches):
        for batch in in_batches(batches, "text", 1_000_000):
            key = batch.column("key").to_numpy()
            for v, x in enumerate(_views(batch)):
                z = (x @ fitted[v]).astype(np.float64)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                fits = np.flatnonzero(((p >= SURE) | (p <= 1 - SURE)) & ~np.isin(key, old[1 - v]))
                columns = [batch.column("doc_id").take(pa.array(fits)), pa.array(key[fits]), pa.array(np.full(len(fits), v, np.int32)), pa.array((p[fits] >= SURE).astype(np.int32)), pa.array(np.abs(z[fits]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "view", "label", "sure"])

    sure = _keyed(docs).mapInArrow(run, "doc_id long, key long, view int, label int, sure double")
    once = sure.join(known.select("doc_id"), "doc_id", "left_anti").groupBy("view", "label", "key").agg(F.max("sure").alias("sure"))
    nth = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.desc("sure"), "key"))  # a task keeps `most` before the shuffle
    return once.withColumn("nth", nth).where(F.col("nth") <= most).select("view", "label", "key")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = MOST_LABELLED, most_new: int = MOST_NEW) -> Model | None:
    """The co-trained model, or None where the labels hold one class or none."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("m")).select("doc_id", (F.col("m") >= 0.5).cast("int").alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    present = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = present.orderBy(order, "doc_id").limit(most_labelled)
    rows = _keyed(docs).join(F.broadcast(sample), "doc_id")  # at most most_labelled ids
    found = rows.mapInArrow(_features, "doc_id long, label int, t binary, m binary").dropDuplicates(["doc_id"]).toArrow()
    found = found.sort_by("doc_id")
    x = tuple(np.frombuffer(b"".join(found.column(c).to_pylist()), np.float32).reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, 1), np.float32) for c in ("t", "m"))
    good = np.array(found.column("label").to_pylist(), np.int64)
    held = mix64(np.array(found.column("doc_id").to_pylist(), np.int64).view(np.uint64)) % np.uint64(5) == 0 if found.num_rows else np.zeros(0, bool)
    if any(len(set(part.tolist())) < 2 for part in (good[held], good[~held])):
        return None
    unlabelled = docs.select("doc_id").join(known, "doc_id", "left_anti").count()
    most = min(most_new, max(1, int(SHARE * unlabelled)))

    def surest(fitted, learned):
        out = ({}, {}), ({}, {})
        picked = [tuple(r) for r in sure_ones(docs, known, fitted, learned, most).collect()] if unlabelled else []
        if not picked:
            return out
        keys = docs.sparkSession.createDataFrame([(k,) for k in sorted({k for _, _, k in picked})], "key long")
        rows = _keyed(docs).join(F.broadcast(keys), "key")  # at most 4 * most keys
        rows = rows.select(F.col("key").alias("doc_id"), *COLUMNS[1:], F.lit(None).cast("int").alias("label")).dropDuplicates(["doc_id"])
        table = rows.mapInArrow(_features, "doc_id long, label int, t binary, m binary").toArrow()
        features = {k: (np.frombuffer(t, np.float32), np.frombuffer(m, np.float32)) for k, t, m in zip(*(table.column(c).to_pylist() for c in ("doc_id", "t", "m")))}
        for view, value, key in sorted(picked):
            labels_, rows_ = out[1 - view]
            labels_[key], rows_[key] = value, features[key][1 - view]
        return out

    return co_train(x, good, surest, held)


def _scores(model: Model | None, batch: pa.RecordBatch):
    if model is None or not batch.num_rows:
        nothing = pa.nulls(batch.num_rows, pa.float64())
        return nothing, nothing, nothing
    return tuple(pa.array(x.astype(np.float64)) for x in model(*_views(batch)))


def score(docs: DataFrame, model: Model | None, keep_at: float = 0.3) -> DataFrame:
    """(doc_id, p_text, p_meta, quality, kept) of every row of docs (doc_id, text, source, lang, n_chars)."""

    def run(batches):
        for batch in in_batches(batches, "text", 1_000_000):
            a, b, c = _scores(model, batch)
            kept = pa.array([True] * batch.num_rows) if model is None else pa.array(c.to_numpy() >= keep_at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), a, b, c, kept], ["doc_id", "p_text", "p_meta", "quality", "kept"])

    return docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, "doc_id long, p_text double, p_meta double, quality double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that the co-trained classifier does not reject."""
    model = fit(docs, labels)
    if model is None:
        return docs

    def run(batches):
        for batch in in_batches(batches, "text", 1_000_000):
            yield batch.filter(pa.array(_scores(model, batch)[2].to_numpy() >= keep_at))

    return docs.mapInArrow(run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
