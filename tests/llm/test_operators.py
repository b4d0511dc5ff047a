"""The training-data operators against brute force, and their defined results for odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.llm import bpe, embedding_dedup, licenses, mixing, near_dedup, pii, quality, substring, token_files, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(400)]


@pytest.fixture(scope="module")
def corpus(words):
    """Documents with copies, near copies, shared passages, odd texts, a repeated row and a null."""
    rng = random.Random(9)
    make = lambda n: [rng.choice(words) for _ in range(n)]
    out = []
    base, passage = make(120), make(60)
    for i in range(60):
        body = make(rng.randrange(1, 150))
        if i % 6 == 0:
            body = body[:20] + passage[: 30 + i] + body[20:]
        out.append(" ".join(body))
    for i in range(40):
        near = list(base)
        for _ in range(i % 12):
            near[rng.randrange(len(near))] = rng.choice(words)
        out.append("  ".join(near) if i % 2 else " ".join(near).upper())
    out += [out[3], out[3], "", "   \n\t", "one", "Two  words", "a b " * 60, "x" * 5000, None, "mail me: a.b@c.org 10.0.0.1"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(out)]
    return [*rows, rows[5]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def components(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# 1 --- mixing


def test_mixing_keeps_every_row_within_one_block(spark):
    rows = [(i, "big" if i % 3 else f"small{i % 4}") for i in range(900)] + [(900, None), (901, None), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("mix", F.lit(1)).withColumn("key", F.lit("k"))
    units = {"big": 5, "small0": 3, "small1": 1, "small2": 1}
    out = mixing.schedule(df, units, block_rows=2, chunk_rows=50)
    assert out.columns == ["doc_id", "source", "mix", "key", "_mix"]
    got = out.select("doc_id", "source", "_mix.*").toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in rows)
    slots = got.groupby("slot").agg(source=("source", lambda s: s.iloc[0]), n=("block", "nunique"))
    assert list(slots.index) == list(range(len(slots))) and (slots.n == 1).all()
    assert ((got.release <= got.slot) & (got.slot < got.deadline)).all()
    within_one_block(slots.source, {"big": 5, "small0": 3, "small1": 1, "small2": 1, "small3": 1, None: 1})


def within_one_block(order, units):
    """After every slot each source is less than one block off its share, whichever sources have run out by then."""
    names = [None if x != x or x is None else x for x in order]
    left, share, had = Counter(names), dict.fromkeys(units, Fraction(0)), Counter()
    for name in names:
        had[name] += 1
        now = Fraction(1)
        while now:  # one slot of time, in proportion to units, in steps in which no source runs out
            going = {n: u for n, u in units.items() if share[n] < left[n]}
            total = sum(going.values())
            step = min([now, *((left[n] - share[n]) * total / u for n, u in going.items())])
            for n, u in going.items():
                share[n] += step * u / total
            now -= step
        assert all(abs(had[n] - share[n]) < 1 for n in units)


@pytest.mark.parametrize("units, blocks", [({"a": 50, "b": 50}, {"a": 51, "b": 300}), ({"a": 50, "b": 30, "c": 20}, {"a": 20, "b": 90, "c": 90}), ({"a": 7, "b": 2, "c": 3}, {"a": 3, "b": 1, "c": 40})])
def test_mixing_is_fair_to_the_last_block(spark, units, blocks):
    rows = [(i, name) for name, n in blocks.items() for i in range(n)]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), units, block_rows=1, chunk_rows=7).select("source", "mix.*").orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(rows)))
    assert all(r.release <= r.slot < r.deadline for r in got)
    within_one_block([r.source for r in got], units)


def test_mixing_odd_inputs(spark, docs):
    assert mixing.schedule(empty(spark)).count() == 0
    assert mixing.mixed(docs).count() == docs.count() and mixing.mixed(docs).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"s0": 0})


# 2 --- top-k


def brute_top(rows, queries, k):
    out = {}
    good = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in queries:
        if q in good:
            scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * (100 if i % 17 == 0 else 1)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(15)]  # ties
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, []), (505, [0.0] * 8), (506, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=4).collect()
    want = brute_top(rows, [i for i, _ in rows if i is not None and i % 10 == 0], 4)
    have = {}
    for r in got:
        have.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in have.items()} == {q: v for q, v in want.items() if v}
    assert topk.top_k(empty(spark, "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_top_k_of_many_blocks(spark, monkeypatch):
    """Many index blocks in several groups and many query blocks, with ids that repeat, against brute force."""
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "GROUP", 1)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6)]) for i in range(400)]
    df = spark.createDataFrame(rows + [(41, rows[41][1])], "vec_id long, embedding array<float>").repartition(5)
    have = {}
    for r in topk.top_k(df.where("vec_id <> 41").union(df.where("vec_id = 41").limit(1)), F.col("vec_id") % 5 == 0, k=3).collect():
        have.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in have.items()} == brute_top(rows, range(0, 400, 5), 3)


def test_bit_arithmetic():
    for x in range(-70, 70):
        assert sum(s << a for a, s in topk._digits(x)) == x
    rng = random.Random(1)
    columns = [[rng.randrange(32) for _ in range(50)] for _ in range(9)]
    terms = {}
    for c in columns:
        for b in range(5):
            terms.setdefault(b, []).append(sum((v >> b & 1) << i for i, v in enumerate(c)))
    sums = topk._sum_slices(terms)
    total = [sum(c[i] for c in columns) for i in range(50)]
    assert [sum((s >> i & 1) << b for b, s in enumerate(sums)) for i in range(50)] == total
    full = (1 << 50) - 1
    assert all(topk._kth(sums, full, k) == sorted(total)[-k] for k in range(1, 51))
    assert all(bin(topk._at_least(sums, full, t)).count("1") == sum(v >= t for v in total) for t in range(0, 400, 7))


# 3 --- BPE


def test_bpe_equals_library(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    vocab = [w.replace("</w>", "") for w in sorted(library.get_vocab())]
    odd = ["<|endoftext|>a<|startoftext|> b", "it's I'LL", "Ως ΣΑΣ İ ǅ", "a\x1cb\x85c\xa0d", "日本語 12 ½", "aaaa" * 40, "é ﬁ", "\x00"] + ["".join(rng.sample(vocab, 3)) for _ in range(300)]
    df = docs.unionByName(spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd)], DOCS))
    for r in bpe.digests(df, path).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    clash = docs.withColumn("token_ids", F.lit(1))
    both = bpe.decode(bpe.encode(clash, path), path, ids="_token_ids")
    assert both.columns == [*clash.columns, "_token_ids", "decoded"] and both.count() == docs.count()
    assert bpe.digests(empty(spark), path).count() == 0


# 4 --- token files


def test_token_files(spark, docs, corpus, tmp_path):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    token_files.write_tokens(docs.withColumn("ids", F.lit(0)), str(tmp_path), path)
    got = {r.doc_id: r for r in token_files.checksums(spark, str(tmp_path)).collect()}
    start = 0
    for i, text in sorted({(r[0], r[1]) for r in corpus}, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        copies = 2 if i == corpus[-1][0] else 1
        assert got[i].n_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        if copies == 1:
            assert got[i].start == start
        start += len(ids) * copies
    assert token_files.read_tokens(spark, str(tmp_path)).where("doc_id = 7").select("ids").first()[0][-1] == 2
    token_files.write_tokens(empty(spark), str(tmp_path / "none"), path)
    assert token_files.checksums(spark, str(tmp_path / "none")).count() == 0


def test_token_file_footers(spark, docs, tmp_path):
    """Ids are dictionary-encoded, ids of documents and starts delta-encoded, and pages are indexed."""
    import pyarrow.parquet as pq

    token_files.write_tokens(docs, str(tmp_path), bpe.tokenizer_path("byte_bpe_50k.json"))
    seen = 0
    for file in (tmp_path / "tokens").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids"].encodings
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "start_in_part"))
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert meta.row_group(g).total_byte_size <= 32 << 20
            seen += 1
    assert seen


def test_pieces():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    library, pieces, rng = Tokenizer.from_file(path), token_files.Pieces(path), random.Random(5)
    odd = ["", " ", "  a", "a  b", "a \n b", "a\n b", "x <|endoftext|> y", "\n <|endoftext|>", "a\xa0 b"] + ["".join(rng.choice("ab '\n\t.1é\xa0s") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    few = token_files.Pieces(path, most=50)  # turns its caches over all the time
    assert all(np.frombuffer(p(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids for t in odd for p in (pieces, few))


def test_pieces_of_a_batch():
    """Texts of one batch get the library's ids, and words that are new in it go to the library's model in one call."""
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(6)
    parts = ["Stra\u00dfe", "\u00e9\u0101", "word", "Word,", "word.\nNext", "\n", "don't", "12", "\u4e2d", "x\u0301", "a\n\nb", ",", "", "<|endoftext|>", "\ta", "r\u00e9union!?"]
    texts = ["", " ", "a", "<|endoftext|>", *[" ".join(rng.choice(parts[: rng.choice([6, 12, 16])]) for _ in range(rng.randrange(1, 9))) for _ in range(2000)]]
    column = pa.array(["left out", *texts])[1:]
    for pieces in (token_files.Pieces(path), token_files.Pieces(path, most=5)):
        for _ in range(2):  # the second time from what is held
            ids, sizes = pieces.encode(column)
            want = [library.encode(t, add_special_tokens=False).ids for t in texts]
            assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    assert [len(x) for x in token_files.Pieces(path).encode(pa.array([], pa.string()))] == [0, 0]

    class Counted:
        calls = 0

        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, *args, **more):
            Counted.calls += 1
            return self.model.encode_batch_fast(*args, **more)

    pieces = token_files.Pieces(path)
    pieces.model = Counted(pieces.model)
    texts = ["a " + " ".join("".join(rng.choice("abcde\u00e9") for _ in range(9)) + rng.choice(["", ",", "."]) for _ in range(500)) for _ in range(20)]
    ids, sizes = pieces.encode(pa.array(texts))
    assert Counted.calls == 1 and sizes.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


# 5 --- quality


def test_quality_held_out(spark, words):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["###", "$$$", "!!"])) for _ in range(rng.randrange(5, 60)))
        rows.append((i, text, "en", "src%d" % (i % 4 if good else 4 + i % 2), len(text)))
        if i < 300:
            labels.append((i, int(good), 0))
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.score(df, quality.fit(df, lab)).toPandas()
    rest = out[out.doc_id >= 300]
    assert (rest.kept == (rest.doc_id % 3 > 0)).mean() > 0.97
    kept = quality.keep_good(df.withColumn("label", F.lit("x")), lab)
    assert kept.columns == [*df.columns, "label"] and {r.doc_id for r in kept.select("doc_id").collect()} == set(out[out.kept].doc_id)


def test_quality_odd_inputs(spark, docs):
    none = empty(spark, "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    assert quality.keep_good(docs, none).count() == docs.count()
    same = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, same) is None
    out = quality.score(docs, None)
    assert out.where("kept").count() == docs.count() and out.where("quality is null").count() == docs.count()
    assert quality.score(empty(spark), None).count() == 0


# 6 --- near-duplicates


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups(docs, corpus, size):
    sets = {r[0]: shingles(r[1], size) for r in corpus}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, ids)
    got = near_dedup.groups(docs.withColumn("members", F.lit(1)), size).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_near_odd_inputs(spark, docs, corpus):
    assert near_dedup.groups(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5)], DOCS)
    assert near_dedup.groups(nulls).where("doc_id is null and component_id is null").count() == 2
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {60 + i for i in range(40)} & set(ids) and not {100, 101} & set(ids)


def test_signature_of_a_very_long_text():
    """Millions of shingles are signed slice by slice, with the minima of all of them."""
    rng = np.random.default_rng(3)
    elements = np.unique(rng.integers(0, 2**63, 2_000_000, dtype=np.int64).view(np.uint64))
    table = near_dedup.superminhash(elements, np.zeros(len(elements), np.int64), 1, 200)
    half = len(elements) // 2
    parts = [near_dedup.superminhash(x, np.zeros(len(x), np.int64), 1, 200) for x in (elements[:half], elements[half:])]
    assert (table == np.minimum(*parts)).all()


def test_words_of_a_long_text_are_hashed_piece_by_piece():
    from fathom.llm.common import WordHashes, hash_words

    text = " \n".join(f"w{i % 977}" for i in range(5000)).encode()
    assert (hash_words(text, WordHashes(), 100) == WordHashes()(text.split())).all()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.int64).view(np.uint64)
    for common in (50, 200, 400):
        a, b = pool[:500], pool[500 - common : 1000 - common]
        table = near_dedup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 500), 2, 400)
        assert abs((table[0] == table[1]).mean() - common / (1000 - common)) < 0.09


# 7 --- vectors


def test_near_vectors(spark):
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((40, 16))
    rows = [(i, (centers[i % 40] + rng.standard_normal(16) * 0.15).tolist()) for i in range(400)]
    rows += [(500 + i, (centers[0] * (i + 1)).tolist()) for i in range(30)] + [(540, rows[3][1]), (541, rows[3][1])]
    odd = [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] * 16), (604, []), (605, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df.withColumn("rep", F.lit(0))).collect()}
    found, true = sum(got[i].n_links for i, _ in rows), int(near.sum()) - len(rows)
    assert 0.95 * true <= found <= true
    assert all(got[i].n_links <= near[j].sum() - 1 for j, (i, _) in enumerate(rows))
    assert got[540].component_id == got[3].component_id
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert embedding_dedup.near_vectors(empty(spark, "vec_id long, embedding array<float>")).count() == 0


def test_near_vectors_recall_at_the_threshold(spark):
    """Pairs planted just above the threshold are found, those just below are not, in small and large buckets alike."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x)
    rows = []
    for i in range(1500):
        v = unit(rng.standard_normal(32))
        w = rng.standard_normal(32)
        w = unit(w - (w @ v) * v)
        cos = 0.902 + 0.02 * rng.random() if i % 2 else 0.898 - 0.02 * rng.random()
        rows += [(2 * i, v), (2 * i + 1, cos * v + math.sqrt(1 - cos * cos) * w)]
    center = unit(rng.standard_normal(32))
    rows += [(5000 + i, unit(center + rng.standard_normal(32) * 0.055)) for i in range(120)]  # many links within one group
    rows += [(6000 + i, rows[1][1]) for i in range(3)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    m = np.array([v for _, v in rows])
    near = m @ m.T >= 0.9
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    true = near.sum(axis=1) - 1
    found = np.array([got[i].n_links for i, _ in rows])
    assert (found <= true).all() and found[true == 0].sum() == 0
    planted = np.array([i < 3000 and (i // 2) % 2 == 1 for i, _ in rows])
    assert found[planted].sum() >= 0.95 * true[planted].sum()
    group = np.array([5000 <= i < 5120 for i, _ in rows])
    assert found[group].sum() >= 0.95 * true[group].sum() > 1000


# 8 --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii(spark):
    rng = random.Random(1)
    texts = ["", None, "a@b@c.d", "x@y.z_w@q.r e@f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +1", "\U0001f600 a@b.co 1.2.3.4", "call me 555-123-4567", "9" * 20000, "a" * 30000 + "@b", " 1" * 9000, "a.b@c" + ".d" * 9000]
    texts += ["".join(rng.choice("a1.@+ -()é9_%\n") for _ in range(rng.randrange(5, 60))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    for r in pii.find(df).collect():
        want = base_spans(texts[r.doc_id] or "")
        shown = ",".join(f"{n}:{a}:{z}" for a, _, z, n in want)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert tuple(sum(w[3] == n for w in want) for n in BASE) == (r.n_email, r.n_ip, r.n_card, r.n_phone)
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))


def numpy_posteriors(counts):
    """Two-class expectation-maximisation over (v1, v2, v3) counts, from the published starting point."""
    start = np.array([0.7, 0.1, 0.2, 0.2, 0.1, 0.7, 0.6, 0.2, 0.3, 0.3, 0.1, 0.5, 0.6, 0.1, 0.35, 0.5, 0.05, 0.4]).reshape(3, 3, 2)
    votes, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)], float)
    share, table = 0.5, start

    def chance():
        like = np.stack([np.prod([table[j, votes[:, j] + 1, y] for j in range(3)], axis=0) for y in (0, 1)])
        like *= np.array([[1 - share], [share]])
        return like[1] / like.sum(axis=0)

    for _ in range(pii.ROUNDS):
        w = chance()
        share = ((w * n).sum() + 0.5) / (n.sum() + 1.0)
        table = np.array([[[(((w if y else 1 - w) * n)[votes[:, j] + 1 == v].sum() + 0.5) / (((w if y else 1 - w) * n).sum() + 1.5) for y in (0, 1)] for v in range(3)] for j in range(3)])
    return dict(zip(map(tuple, votes.tolist()), chance()))


def test_pii_posteriors_equal_numpy(spark):
    rng = random.Random(8)
    spans = []
    for _ in range(900):
        true = rng.random() < 0.6
        spans.append((0, *(rng.choices([-1, 0, 1], [1, 2, 6] if true else [6, 2, 1])[0] for _ in range(3))))
    got = {(r.v1, r.v2, r.v3): r.p for r in pii.posteriors(spark.createDataFrame(spans, "kind int, v1 int, v2 int, v3 int")).collect()}
    want = numpy_posteriors(Counter(s[1:] for s in spans))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


ADDED = {
    "email": ["john.doe [at] example [dot] com", "JOHN (AT) MAIL.EXAMPLE.ORG", "jane at example dot net"],
    "ip": ["97[.]51[.]17[.]173", "97 (dot) 51 (dot) 17 (dot) 173", "2001:db8:0:1:2:3:4:5", "2001:db8::17"],
    "card": ["4111.1111.1111.1111", "4111  1111  1111  1111", "5500/0000/0000/0004", "3782_822463_10005"],
    "phone": ["(212) 555-0142", "415.555.0199", "0049 30 1234567"],
}
REFUSED = ["97[.]51[.]17[.]973", "4111.1111.1111.1112", "1234_5678_9012_3456"]


def test_pii_classifier_adds_spans_of_all_kinds(spark):
    """Loose forms that labelers vote for are added, those whose check fails are not; without the classifier none is."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    lead = {"email": "contact me by mail: ", "ip": "the server address is ", "card": "paid by credit card ", "phone": "call my phone "}
    base = {"email": lambda i: f"u{i}@host.example.com", "ip": lambda i: f"97.51.{i}.17", "card": lambda i: "4111 1111 1111 1111", "phone": lambda i: f"+1 (212) 555-01{i:02}"}
    texts = [f"{word()} {lead[k]}{f(i)} {word()}" for k, f in base.items() for i in range(40)]
    texts += [f"{word()} serial 9{i:03}-1234-5678-1111 version 999.{i}.300.1 {word()}" for i in range(60)]
    wanted = {}
    for kind, forms in ADDED.items():
        for form in forms:
            at = f"{word()} {lead[kind]}"
            wanted[len(texts)] = f"{kind}:{len(at)}:{len(at) + len(form)}"
            texts.append(f"{at}{form} {word()}")
    refused = {}
    for form in REFUSED:
        refused[len(texts)] = form
        texts.append(f"{word()} {form} {word()}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.find(df).collect()}
    assert {i: got[i] for i in wanted} == {i: [s] for i, s in wanted.items()}
    assert all(got[i] == [""] for i in refused)
    told = pii.candidates(df, "text", "spans").select("doc_id", pii._shown(pii._accepted(F.col("spans"), {})).alias("s"))
    assert {r.s for r in told.where(F.col("doc_id").isin(list(wanted))).collect()} == {""}


def test_pii_positions_in_a_text_with_many_matches(spark):
    text = "".join(f"a{i}@b.co 😀" for i in range(3000))
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.spans == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"a[0-9]+@b\.co", text)) and r.n_email == 3000


def test_redact(spark):
    rows = [(0, "mail a@b.org or 10.1.2.3 now", "x"), (1, None, "x"), (2, "clean", "x"), (2, "clean", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(0, "mail [EMAIL] or [IP] now"), (1, ""), (2, "clean"), (2, "clean")]
    assert pii.find(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


# 9 --- repeated passages


@pytest.mark.parametrize("window", [8, 35])
def test_repeated_passages(docs, corpus, window):
    texts = [(r[0], (r[1] or "").encode().split()) for r in corpus]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    got = {r.doc_id: r for r in substring.remove_repeats(docs.withColumn("k", F.lit(1)), window).collect()}
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def test_passages_are_located_by_the_automaton(corpus):
    """Passages of some texts are found at all their places in others, and without passages nothing is."""
    import pyarrow as pa

    window, rng = 35, random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*(rng.choice("xyz") for _ in range(rng.randrange(30))), *passage[rng.randrange(9) : 40 + rng.randrange(20)], *(rng.choice("xyz") for _ in range(rng.randrange(30)))]) for _ in range(200)]
    patterns = [(" ".join(passage), [0, 1, 2, 5, 25]), (" ".join("xyz" * 20), [0])]
    rows = [(0, 1, i, t.encode(), o) for i, (t, o) in enumerate(patterns)] + [(1, 2, i, t.encode(), None) for i, t in enumerate(texts)]
    schema = pa.schema([("kind", pa.int32()), ("k", pa.int64()), ("s", pa.int64()), ("seg", pa.binary()), ("offs", pa.list_(pa.int32()))])
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    got = {r["s"]: {o for x in r["runs"] for o in range(x["off"], x["to"])} for r in substring._locate(window)(table).to_pylist()}
    wanted = {tuple(t.split()[o : o + window]) for t, offs in patterns for o in offs}
    for i, t in enumerate(texts):
        w = t.split()
        assert got.get(i, set()) == {j for j in range(len(w) - window + 1) if tuple(w[j : j + window]) in wanted}
    assert any(got.values())
    assert substring._locate(window)(table.slice(len(patterns))).num_rows == 0


@pytest.mark.parametrize("window", [1, 2, 3, 35, 37])
def test_windows_are_two_symbols(window, monkeypatch):
    """An automaton has at most two symbols' letters a window, also for windows of a prime number of words."""
    import ahocorasick

    rng, made, whole = random.Random(window), [], ahocorasick.Automaton
    monkeypatch.setattr(ahocorasick, "Automaton", lambda *kind: made.append(whole(*kind)) or made[-1])
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(400)]
    offs = list(range(len(words) - window + 1))
    other = words[7 : 7 + window] + ["x"] + words[50 : 49 + window] + ["y"] + words[90 : 92 + window]
    rows = [(0, 1, 1, " ".join(words).encode(), offs), (1, 1, 2, " ".join(other).encode(), None)]
    kinds = [("kind", pa.int32()), ("k", pa.int64()), ("s", pa.int64()), ("seg", pa.binary()), ("offs", pa.list_(pa.int32()))]
    table = pa.table([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), kinds)], names=[name for name, _ in kinds])
    got = {o for r in substring._locate(window)(table).to_pylist() for x in r["runs"] for o in range(x["off"], x["to"])}
    held = {tuple(words[o : o + window]) for o in offs}
    assert got == {o for o in range(len(other) - window + 1) if tuple(other[o : o + window]) in held}
    digits = -(-len(held).bit_length() // substring.DIGIT) + 1
    assert made[0].get_stats()["nodes_count"] <= 1 + 2 * digits * len(offs)
    if window > 30:
        assert made[0].get_stats()["longest_word"] <= 2 * digits


def test_passages_in_many_small_blocks(spark, monkeypatch):
    """Blocks of few passages and segments give the same result as one."""
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(300)]
    rows = [(i, " ".join(base[(a := rng.randrange(200)) : a + rng.randrange(20, 100)])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, substring.remove_repeats(df, 12, 4).collect()))
    monkeypatch.setattr(substring, "SHARD_WINDOWS", 30)
    monkeypatch.setattr(substring, "SHARD_SEGMENTS", 50)
    assert sorted(map(tuple, substring.remove_repeats(df, 12, 4).collect())) == whole
    assert sum(r[2] for r in whole)


def test_passages_odd_inputs(spark):
    assert substring.remove_repeats(empty(spark)).count() == 0
    twice = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (-1, "a b c d e")], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(twice, 4, 2).orderBy("n_words").collect()] == [4, 4, 4]


# 10 --- licences


def test_licenses(spark):
    mit = max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len)
    rows = ["Released under the MIT License.", "x\nReleased   under the mit license\ny", "intro\n\n" + mit.replace(". ", ".\n") + "\n\nend", "Licensed under CC BY-NC 4.0.", "released under the", "", None, "word " * 3000, mit[: len(mit) // 2]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("license", F.lit("?"))
    got = {r.doc_id: (r.license, r.dice) for r in licenses.scan(df).collect()}
    assert got[0] == ("MIT", 1.0) and got[1] == ("MIT", 1.0) and got[2][0] == "MIT" and got[3][0] == "CC-BY-NC-4.0"
    assert all(got[i] == (None, None) for i in (4, 5, 6, 7))
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_inside_texts():
    """Whole licences on one line within a long text, without blank lines, cut at odd places or commented."""
    scanner, noise = licenses.Scanner(), " ".join(f"w{i}" for i in range(3000))
    whole = {n: t for n, t in licenses.TEMPLATES if len(t) > 600}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Zlib", "Unlicense"} <= set(whole)
    for name, text in whole.items():
        words = text.split()
        for shown in (" ".join(words), "\n".join("// " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))):
            assert scanner(f"{noise} {shown} {noise}".encode()).get(name) == 1.0
            assert scanner(shown.encode())[name] == 1.0
    assert scanner(noise.encode()) == {}


def test_license_windows_equal_brute_force():
    rng = random.Random(6)
    templates = tuple((f"T{i}", " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 25)))) for i in range(8))
    scanner = licenses.Scanner(templates, 0.7)
    for _ in range(300):
        text = " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))
        if rng.random() < 0.7:
            text += " " + rng.choice(templates)[1] + " " + text[:9]
        words, want = text.encode().split(), {}
        for name, t in templates:
            t = t.encode().split()
            own = licenses.bigrams(t)
            units = [words] + [words[i : i + len(t)] for i in range(len(words) - 1) if (words[i], words[i + 1]) in own]
            best = max((2 * len(licenses.bigrams(u) & own) / (len(licenses.bigrams(u)) + len(own)) for u in units if len(u) > 1), default=0)
            if best >= 0.7:
                want[name] = max(best, want.get(name, 0))
        assert scanner(text.encode()) == want
