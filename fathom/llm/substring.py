"""Removal of passages that recur, word by word, anywhere in the corpus.

A window is `window` consecutive words of one document. A window recurs if its word sequence also starts
anywhere else, in the same document too; every word that a recurring window covers is removed.

Steps, each over all documents:

1. Each window is filed under an anchor, the 8-word phrase of it with the least hash, so equal windows share
   their anchor. Consecutive windows mostly share one; such a run is a segment. Only anchors that occur in
   two segments or more can hold a recurring window.
2. Segments of recurring anchors are read again as text. Equal segments are counted together before the
   shuffle, so a passage with millions of copies is one row; windows of the remaining distinct segments are
   counted by (anchor hash, window hash), 128 bits in all. That confirms the recurring windows, of each of which one
   place, the least, is kept as its passage.
3. Passages and segments go to the shard of their anchor. A shard compiles its passages into an Aho-Corasick
   automaton, and all its segments stream through it: it alone says where in a segment the passages of
   other segments occur. A window is a pattern of two symbols, the phrases of half its words, rounded up, that begin and
   end it, so its automaton is that much smaller than one over words, and a segment streams through once a phase.
   A symbol is its number in the shard, written in DIGIT-fold letters (pyahocorasick looks children up one by one, so no
   node may have many); the first letter of a number is of another alphabet, so no match begins within a number.
   Shards with many passages or segments are cut into blocks, in which every passage meets every segment.
4. The words of the located windows go, document by document.

Equal segments stream once; documents get the windows of the segments they hold. Results are those of streaming every
whole document through every shard, without as many passes as there are shards.

Defined results: a null or blank text has no words; repeated rows are windows that recur; a null doc_id is
an ordinary document; fewer than `window` words never lose any; an empty table gives an empty result; other
columns are ignored, clashing names too; of equal windows the least (segment hash, place) stands for all. A very long
text is one task's work and is held as a list of its words; its segments are dealt out as those of other texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import Stage, in_batches, read, rolling_hashes, texts, word_hashes

WINDOW, ANCHOR = 35, 8
#: Windows of an automaton and segments that one task streams through it.
SHARD_WINDOWS, SHARD_SEGMENTS = 50_000, 40_000
_LOW = np.uint64((1 << 24) - 1)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[: len(v) - (width - done)], v[width - done :]) if width > done else v


def _starts(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of `width` words that lies in one of the parts of a list: its part, its place in it, and its place in the list."""
    each = np.maximum(sizes - width + 1, 0)
    part = np.repeat(np.arange(len(sizes)), each)
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return part, place, np.repeat(np.cumsum(sizes) - sizes, each) + place


def _segments(words: np.ndarray, sizes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Document, anchor hash, first window and number of windows of each segment; `sizes` words make a document."""
    doc, place, start = _starts(sizes, window)
    if not len(start):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    grams = rolling_hashes(words, anchor)
    at = np.arange(len(grams), dtype=np.uint64) & _LOW
    low = _sliding_min((grams & ~_LOW) | at, window - anchor + 1)[start]
    where = start + (((low & _LOW).astype(np.int64) - start) & int(_LOW))
    first = np.flatnonzero(np.diff(where, prepend=-1))  # windows of two documents never share a place
    return doc[first], grams[where[first]].view(np.int64), place[first], np.diff(first, append=len(start))


def _scan(window: int, anchor: int):
    def run(batches):
        hashes = word_hashes()
        for batch in in_batches(batches, "text"):
            parts = [text.split() for text in texts(batch.column("text"))]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            digests = [hashlib.sha256(b" ".join(words)).hexdigest() for words in parts]
            doc, k, i, n = _segments(hashes([w for words in parts for w in words]), sizes, window, anchor)
            fields = [pa.array(k), pa.array(i.astype(np.int32)), pa.array(n.astype(np.int32))]
            ends = np.searchsorted(doc, np.arange(len(parts) + 1)).astype(np.int32)
            segments = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["k", "i", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sizes), pa.array(digests, pa.string()), segments], ["doc_id", "h", "n_words", "sha", "segments"])

    return run


def _segment_texts(window: int):
    """The text of each candidate segment: its words joined by one space."""

    def run(batches):
        for batch in in_batches(batches, "text", 2_000_000):
            found = batch.column("found")
            first, past = found.offsets.to_numpy()[:-1].tolist(), found.offsets.to_numpy()[1:].tolist()
            flat = found.values
            begin, count = (flat.field(c).to_numpy() for c in ("i", "n"))
            starts, ends, seg, held = begin.tolist(), (begin + count + (window - 1)).tolist(), [], []
            for text, a, b in zip(texts(batch.column("text")), first, past):
                words = text.split()
                seg += [b" ".join(words[i:j]) for i, j in zip(starts[a:b], ends[a:b])]
                held.append(b - a)
            own, at = pa.array(np.repeat(np.arange(len(held)), held)), slice(first[0], past[-1])
            columns = [pa.array(flat.field("k").to_numpy()[at]), batch.column("d").take(own), batch.column("h").take(own), pa.array(begin[at]), pa.array(count[at]), pa.array(seg, pa.binary())]
            whole = pa.RecordBatch.from_arrays(columns, ["k", "d", "h", "i", "n", "seg"])
            for row in range(0, whole.num_rows, 20_000):
                yield whole.slice(row, 20_000)

    return run


def _windows(window: int):
    """Of each distinct segment the hashes of its windows."""

    def run(batches):
        hashes = word_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                parts = [x.split() for x in part.column("seg").to_pylist()]
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                w = rolling_hashes(hashes([x for p in parts for x in p]), window).view(np.int64)
                row, off, start = _starts(sizes, window)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("k").take(row), pa.array(w[start]), part.column("s").take(row), pa.array(off.astype(np.int32)), part.column("c").take(row)], ["k", "w", "s", "off", "c"])

    return run


def _phrases(window: int) -> tuple[int, int, int]:
    """Symbols of a window, the words from one to the next, and the words of each: together they cover the window."""
    symbols, step = min(window, 2), max(window // 2, 1)
    return symbols, step, window - (symbols - 1) * step


def _by_phase(sizes: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of segments with these numbers of phrases: each phrase's place within its segment, and its place in the stream.

    The stream has a segment's phrases 0, gram, 2 gram, ..., then 1, gram + 1, ... and so on; a gap ends each.
    """
    lengths = np.maximum(sizes[:, None] - np.arange(gram) + gram - 1, 0) // gram
    ends = np.cumsum(lengths.reshape(-1) + 1)
    starts = (ends - lengths.reshape(-1) - 1).reshape(-1, gram)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return place, starts[owner, place % gram] + place // gram


#: Bits of a letter.
DIGIT = 6


def _letters(n: int, digits: int) -> np.ndarray:
    """The numbers below n as rows of `digits` letters, and a last row of letters that no number has."""
    numbers, out = np.arange(n), np.zeros((n + 1, digits), np.uint8)
    for i in range(digits):
        out[:n, i] = ((numbers >> (DIGIT * (digits - 1 - i))) & ((1 << DIGIT) - 1)) + (1 if i else 1 + (1 << DIGIT))
    return out


def _locate(window: int):
    """Of one block (kind 0: passages with the offsets of their windows; kind 1: segments) the windows found in its segments."""

    def run(table: pa.Table) -> pa.Table:
        import ahocorasick

        symbols, step, length = _phrases(window)
        hashes = word_hashes()

        def phrases(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
            flat, counts = [], []
            for at in range(0, len(column), 4000):
                parts = [t.split() for t in column.slice(at, 4000).to_pylist()]
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                flat.append(rolling_hashes(hashes([w for p in parts for w in p]), length)[_starts(sizes, length)[2]])
                counts.append(sizes - length + 1)
            return np.concatenate(flat), np.concatenate(counts)

        kind = table.column("kind").to_numpy()
        passages, segments = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
        out: tuple[list, list, list] = ([], [], [])
        if passages.num_rows and segments.num_rows:
            flat, sizes = phrases(passages.column("seg"))
            begin = np.cumsum(sizes) - sizes
            offs = passages.column("offs").to_pylist()
            first = np.repeat(begin, [len(x) for x in offs]) + np.array([o for x in offs for o in x], np.int64)
            pattern = pa.array(flat[(first[:, None] + step * np.arange(symbols)).reshape(-1)]).dictionary_encode()
            known = pattern.dictionary
            digits = -(-len(known).bit_length() // DIGIT)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            letters = _letters(len(known), digits)
            patterns, size = letters[pattern.indices.to_numpy()].tobytes().decode("latin-1"), symbols * digits
            for start in range(0, len(patterns), size):
                automaton.add_word(patterns[start : start + size])
            automaton.make_automaton()
            for at in range(0, segments.num_rows, 4000):
                part = segments.slice(at, 4000)
                flat, sizes = phrases(part.column("seg"))
                place, to = _by_phase(sizes, step)
                number = pc.fill_null(pc.index_in(pa.array(flat), value_set=known), len(known)).to_numpy()
                stream, source = np.zeros((int(to.max()) + 2, digits), np.uint8), np.zeros(int(to.max()) + 2, np.int64)
                stream[to] = letters[number]
                source[to] = np.arange(len(flat))
                found = automaton.iter(stream.tobytes().decode("latin-1"))
                ends = np.fromiter((end for end, _ in found), np.int64) // digits
                if not len(ends):
                    continue
                starts = np.sort(source[ends - symbols + 1])
                owner = np.searchsorted(np.cumsum(sizes), starts, "right")
                off = place[starts]
                new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(off, prepend=-2) != 1))
                past = off[np.append(new[1:], len(off)) - 1] + 1
                listed: dict[int, list] = {}
                for o, i, j in zip(owner[new].tolist(), off[new].tolist(), past.tolist()):
                    listed.setdefault(o, []).append({"off": i, "to": j})
                k, s = part.column("k").to_pylist(), part.column("s").to_pylist()
                out[0].extend(k[o] for o in listed)
                out[1].extend(s[o] for o in listed)
                out[2].extend(listed.values())
        runs = pa.array(out[2], pa.list_(pa.struct([("off", pa.int32()), ("to", pa.int32())])))
        return pa.table({"k": pa.array(out[0], pa.int64()), "s": pa.array(out[1], pa.int64()), "runs": runs})

    return run


def _remove(window: int):
    """Leave out the words that the located windows of each text cover."""

    def run(batches):
        for batch in in_batches(batches, "text", 1_000_000):
            removed, digests = [], []
            for text, ranges in zip(texts(batch.column("text")), batch.column("ranges").to_pylist()):
                words = text.split()
                kept, at = [], 0
                for i, j in _merged(ranges):
                    kept += words[at:i]
                    at = max(at, j + window - 1)
                kept += words[at:]
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("h"), pa.array(removed, pa.int64()), pa.array(digests)], ["d", "h", "n_removed", "kept"])

    return run


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Runs [first, end) of window starts, joined where they touch."""
    out: list[tuple[int, int]] = []
    for i, j in sorted((r["i"], r["j"]) for r in ranges):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


def _located(passages: DataFrame, segments: DataFrame, window: int) -> DataFrame:
    """(k, s, runs): the windows of passages (k, s, seg, offs) that segments (k, s, seg) hold, shard by shard."""
    n_windows, n_segments = passages.agg(F.coalesce(F.sum(F.size("offs")), F.lit(0))).first()[0], segments.count()
    shards = 1 + max(n_windows // SHARD_WINDOWS, n_segments // SHARD_SEGMENTS)
    shard = F.pmod("k", F.lit(shards)).cast("long")
    own = passages.groupBy(shard.alias("shard")).agg(F.ceil(F.sum(F.size("offs")) / SHARD_WINDOWS).cast("int").alias("nq"))
    size = own.join(segments.groupBy(shard.alias("shard")).agg(F.ceil(F.count("*") / SHARD_SEGMENTS).cast("int").alias("nc")), "shard")
    if shards < 1_000_000:
        size = F.broadcast(size)  # a row a shard, 16 bytes each: checked above
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = passages.withColumn("shard", shard).join(size, "shard").select("shard", F.pmod("s", "nq").cast("int").alias("q"), every("nc").alias("part"), F.lit(0).alias("kind"), "k", "s", "seg", "offs")
    right = segments.withColumn("shard", shard).join(size, "shard").select("shard", every("nq").alias("q"), F.pmod("s", "nc").cast("int").alias("part"), F.lit(1).alias("kind"), "k", "s", "seg", F.lit(None).cast("array<int>").alias("offs"))
    return left.unionByName(right).groupBy("shard", "q", "part").applyInArrow(_locate(window), "k long, s long, runs array<struct<off: int, to: int>>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs (doc_id, text)."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor has at least one word and no more than a window")
    spark = docs.sparkSession
    stage = Stage(spark, "substring")
    # a row is known by its id and text; rows alike in both have the same passages
    key = [F.coalesce("doc_id", F.lit(-1)).alias("d"), "h"]
    rows = docs.select("doc_id", "text", F.xxhash64("text", F.col("doc_id").isNull()).alias("h"))
    scan = stage.write(rows.mapInArrow(_scan(window, anchor), "doc_id long, h long, n_words long, sha string, segments array<struct<k: long, i: int, n: int>>"), "scan")
    segments = scan.select(*key, F.explode("segments").alias("s")).select("d", "h", "s.k", "s.i", "s.n")
    recurring = stage.write(segments.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k"), "recurring")
    found = segments.join(recurring, "k").groupBy("d", "h").agg(F.collect_set(F.struct("k", "i", "n")).alias("found"))
    candidates = stage.write(rows.select(*key, "text").join(found, ["d", "h"]), "candidates")
    stage.drop("recurring")
    placed = stage.write(candidates.mapInArrow(_segment_texts(window), "k long, d long, h long, i int, n int, seg binary").withColumn("s", F.xxhash64("seg")), "segments")
    distinct = stage.write(placed.groupBy("k", "s", "seg").agg(F.count("*").alias("c")), "distinct")
    places = stage.write(placed.select("k", "s", "d", "h", "i"), "places")
    stage.drop("segments")  # of their texts the distinct ones are enough
    windows = distinct.mapInArrow(_windows(window), "k long, w long, s long, off int, c long")
    counted = windows.groupBy("k", "w").agg(F.sum("c").alias("total"), F.min(F.struct("s", "off")).alias("at")).where("total > 1")
    passages = counted.groupBy("k", F.col("at.s").alias("s")).agg(F.collect_list("at.off").alias("offs"))  # at most window - anchor + 1 of them
    passages = stage.write(passages.join(distinct.select("k", "s", "seg"), ["k", "s"]), "passages")
    located = stage.write(_located(passages, distinct.select("k", "s", "seg"), window), "located")
    ranges = places.join(located, ["k", "s"]).select("d", "h", F.transform("runs", lambda r: F.struct((F.col("i") + r["off"]).alias("i"), (F.col("i") + r["to"]).alias("j"))).alias("runs"))
    per_doc = ranges.groupBy("d", "h").agg(F.flatten(F.collect_list("runs")).alias("ranges"))
    located = candidates.select("d", "h", "text").join(per_doc, ["d", "h"]).mapInArrow(_remove(window), "d long, h long, n_removed long, kept string")
    changed = stage.write(located.dropDuplicates(["d", "h"]), "changed")
    for name in ("candidates", "places", "distinct", "passages", "located"):
        stage.drop(name)
    out = scan.select("doc_id", *key, "n_words", "sha").join(changed, ["d", "h"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
