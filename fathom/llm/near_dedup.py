"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

Steps:

1. One pass over the texts gives each document the size and digest of its shingle set and the hashes of
   its signature's bands. Equal sets fall into one class, known by its least ``doc_id`` and the set, as unlike texts
   may repeat an id.
2. Classes that share a band are candidates. Of each bucket the class that meets most others leads; each class
   is checked against one leader, the one it shares most buckets with, on whole sets, and links are grouped by
   union-find. Edited copies of one text meet in their original, so this connects most of a large group.
3. Buckets whose classes are not yet in one component are compared further. Such a bucket belongs to its main
   component; the classes of a component's buckets that lie outside it are compared, in blocks bounded by bytes,
   with all classes of these buckets, each class once whatever the number of buckets it came from. Only
   pairs already connected are passed over; every other pair is decided on whole sets. So no link that shares a band
   is lost, and no list of all pairs is ever written.

With 40 bands of 5 rows a pair at the threshold 0.8 shares no band with probability 1.3e-7, at 0.9 with 3e-16.

Defined results: a null or wordless text has an empty set, is its own component and is kept; repeated rows
share a class; rows that repeat an id with unlike texts are one document with the links of all of them; a null ``doc_id`` takes no part in links; an empty table gives an empty result; extra columns
are ignored by :func:`groups` and passed on by :func:`deduplicate`, clashing names too; a very long text is hashed
piece by piece and signed SLICE shingles at a time, so it costs 8 bytes a word; equal similarities tie to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import GOLDEN, Stage, WordHashes, components, fresh, hash_words, in_batches, mix64, read, shingle_hashes, texts, word_hashes

BANDS, ROWS = 40, 5
#: Shingles signed at a time, followers of a leader checked by one task, and bytes of sets on one side of a block.
SLICE, FOLLOWERS, BLOCK_BYTES = 1 << 16, 1000, 24 << 20
#: Shingles of one side filed at a time, and meetings with them counted at a time; a set's own are filed together.
FILED, MEETINGS = 1 << 18, 1 << 20


def superminhash(elements: np.ndarray, owner: np.ndarray, n_owners: int, m: int) -> np.ndarray:
    """SuperMinHash signatures of many sets at once: (n_owners, m) unsigned integers.

    Element e draws, rank after rank j, a uniform r and the j-th entry p of a random permutation of the
    positions (Fisher-Yates), and position p keeps the least j + r. A set is done as soon as all its
    positions lie below the next rank, which for large sets is after a few ranks. Elements draw on their own, so
    they come in slices: later ones start from the minima of earlier ones.
    """
    low = np.full(n_owners * m, np.iinfo(np.uint64).max, np.uint64)
    table = low.reshape(n_owners, m)
    with np.errstate(over="ignore"):
        for start in range(0, len(elements), SLICE):
            alive_e, own = elements[start : start + SLICE], owner[start : start + SLICE].astype(np.int64)
            perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint32), (len(alive_e), m)).copy()
            for j in range(m):
                if not len(alive_e):
                    break
                draw = mix64(alive_e + np.uint64(j + 1) * GOLDEN)
                k = j + (((draw & np.uint64(0xFFFFFF)) * np.uint64(m - j)) >> np.uint64(24)).astype(np.int64)
                at = np.arange(len(alive_e))
                p = perm[at, k]
                perm[at, k] = perm[:, j]
                np.minimum.at(low, own * m + p, (np.uint64(j) << np.uint64(40)) | (draw >> np.uint64(24)))
                first, last = int(own[0]), int(own[-1]) + 1  # owners come in order
                done = table[first:last].max(axis=1) < np.uint64((j + 1) << 40)
                going = ~done[own - first]
                if not going.all():
                    alive_e, own, perm = alive_e[going], own[going], perm[going]
    return table


def _shingle_sets(batch: pa.RecordBatch, size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, one after the other, and how many each has."""
    found = []
    for text in texts(batch.column("text")):
        found.append(np.unique(shingle_hashes(hash_words(text.lower(), hashes), size)))
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), counts


def _signatures(size: int, bands: int, rows: int):
    def run(batches):
        import xxhash

        hashes = word_hashes()
        for batch in in_batches(batches, "text", 250_000):
            sets, counts = _shingle_sets(batch, size, hashes)
            ends = np.cumsum(counts)
            digests = [xxhash.xxh3_128_digest(sets[e - c : e].tobytes()) if c else None for e, c in zip(ends, counts)]
            full = np.flatnonzero(counts)
            keys = np.zeros((len(counts), bands), np.uint64)
            if len(full):
                table = superminhash(sets, np.repeat(np.arange(len(full)), counts[full]), len(full), bands * rows)
                with np.errstate(over="ignore"):
                    part = table.reshape(len(full), bands, rows)
                    h = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(full), bands))
                    for i in range(rows):
                        h = mix64(h * GOLDEN + part[:, :, i])
                    keys[full] = h
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(counts), pa.array(digests, pa.binary()), listed], ["doc_id", "h", "n_shingles", "set_key", "bands"])

    return run


def _sets(size: int):
    def run(batches):
        import xxhash

        hashes = word_hashes()
        for batch in in_batches(batches, "text", 250_000):
            sets, counts = _shingle_sets(batch, size, hashes)
            ends = np.cumsum(counts)
            members = [sets[e - c : e].tobytes() for e, c in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(m) for m in members], pa.binary()), pa.array(members, pa.binary())], ["doc_id", "set_key", "members"])

    return run


def _similar(common: np.ndarray, na, nb, percent: int):
    return 100 * common >= percent * (na + nb - common)


def _verified(percent: int):
    """Pairs (a, b, members_a, members_b) whose whole sets are similar enough."""

    def run(batches):
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = batch.column("ma").to_pylist(), batch.column("mb").to_pylist()
            ok = []
            for i in range(len(a)):
                x, y = np.frombuffer(left[i], np.uint64), np.frombuffer(right[i], np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                if _similar(n, len(x), len(y), percent):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], ["a", "b"])

    return run


def _runs(sizes: np.ndarray, most: int):
    """Ranges of positions whose sizes add up to `most` or less, one position at least."""
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _block_links(percent: int):
    """Links between the two sides of one block pair; pairs already connected are skipped.

    The left sets are filed by shingle, FILED shingles at a time; the right ones are looked up in runs of MEETINGS
    shingles they share with the left, so copies and very long texts take no more memory than others.
    """

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rep, comp = table.column("rep").to_pylist(), table.column("comp").to_pylist()
        binary = table.column("members").combine_chunks()
        offsets = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1] // 8
        held = np.frombuffer(binary.buffers()[2], np.uint64, int(offsets[-1]))
        sizes = np.diff(offsets).astype(np.int64)
        up: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (y := up.get(root, root)) != root:
                root = y
            while (y := up.get(x, x)) != root:
                up[x], x = root, y
            return root

        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links: list[tuple[int, int]] = []
        for a, past_a in _runs(sizes[left], FILED):
            some = left[a:past_a]
            flat, holder = np.concatenate([held[offsets[i] : offsets[i + 1]] for i in some]), np.repeat(np.arange(len(some)), sizes[some])
            order = np.argsort(flat, kind="stable")
            flat, holder = flat[order], holder[order]
            for b, past_b in _runs(sizes[right], FILED):
                others = right[b:past_b]
                asked = np.concatenate([held[offsets[j] : offsets[j + 1]] for j in others])
                first = np.searchsorted(flat, asked, "left")
                count = np.searchsorted(flat, asked, "right") - first
                starts = np.concatenate([[0], np.cumsum(sizes[others])])
                met = np.add.reduceat(count, starts[:-1]) if len(asked) else np.zeros(len(others), np.int64)
                # a run of the right side times the left sets is one table of counts
                for c, past_c in _runs(np.maximum(met, len(some)), MEETINGS):
                    own = slice(starts[c], starts[past_c])
                    n = count[own]
                    at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    asker = np.repeat(np.repeat(np.arange(past_c - c), sizes[others[c:past_c]]), n)
                    common = np.bincount(holder[at] * (past_c - c) + asker, minlength=len(some) * (past_c - c)).reshape(len(some), -1)
                    for x, y in np.argwhere(_similar(common, sizes[some][:, None], sizes[others[c:past_c]][None, :], percent)):
                        i, j = some[x], others[c + y]
                        p, q = find(comp[i]), find(comp[j])
                        if p != q:
                            up[max(p, q)] = min(p, q)
                            links.append((rep[i], rep[j]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _class(doc_id: str) -> Column:
    """A class by its least document and its set: two classes of one document are not the same."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64("set_key").alias("k"))


def _grouped(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h, n_shingles, set_key, component_id, kept) of every row of docs; h is a hash of its text."""
    spark = docs.sparkSession
    stage = Stage(spark, "near")
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    sig = stage.write(narrow.mapInArrow(_signatures(shingle, bands, rows), "doc_id long, h long, n_shingles long, set_key binary, bands array<long>"), "sig")
    linkable = sig.where("doc_id is not null and n_shingles > 0")
    classes = linkable.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    reps = linkable.join(classes, ["set_key", "doc_id"], "left_semi").select(_class("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands").distinct()
    met = reps.select(F.explode("bands").alias("bucket"), "rep", "n")
    many = met.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("size")).where("least <> most").select("bucket", "size")
    members = stage.write(met.join(many, "bucket"), "members")
    # sets of all classes that meet another one
    need = members.select(F.col("rep.id").alias("doc_id")).distinct()
    made = narrow.select("doc_id", "text").join(need, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, set_key binary, members binary").where("length(members) > 0")
    sets = stage.write(made.select(_class("doc_id").alias("rep"), "members").dropDuplicates(["rep"]), "sets")

    def check(pairs: DataFrame) -> DataFrame:
        # a leader's set goes to as many keys as it has thousands of followers
        spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("w")).where("w > 1")
        salted = pairs.join(spread, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("w", F.lit(1))).cast("int").alias("salt"))
        leaders = pairs.select("a").distinct().join(spread, "a", "left").join(sets.select(F.col("rep").alias("a"), F.col("members").alias("ma")), "a")
        leaders = leaders.select("a", "ma", F.explode(F.sequence(F.lit(0), F.coalesce("w", F.lit(1)) - 1)).alias("salt"))
        both = salted.join(sets.select(F.col("rep").alias("b"), F.col("members").alias("mb")), "b").join(leaders, ["a", "salt"])
        fits = F.least(F.length("ma"), F.length("mb")) * 100 >= F.greatest(F.length("ma"), F.length("mb")) * percent
        return both.where(fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "ma", "mb").mapInArrow(_verified(percent), "a long, b long")

    weight = members.groupBy("rep").agg(F.sum("size").alias("w"))
    heads = members.join(weight, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("w", -F.col("rep.id"), "rep.k")).alias("first"))
    meet = members.join(heads, "bucket").where("first <> rep").groupBy("rep", "first").count()
    star = meet.groupBy("rep").agg(F.max_by("first", F.struct("count", -F.col("first.id"), "first.k")).alias("a")).select("a", F.col("rep").alias("b"))
    comp = components(check(star), stage, "cc-star", shrunk=True)  # a class has one leader
    placed = members.join(comp, F.col("rep.id") == F.col("node"), "left").select("bucket", "rep", "n", F.coalesce("component", "rep.id").alias("comp"))
    # a bucket of several components belongs to the largest of them
    parts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    open_ = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("size", -F.col("comp"))).alias("main"), F.count("*").alias("k")).where("k > 1").select("bucket", "main")
    todo = stage.write(placed.join(open_, "bucket").select("main", "rep", "n", "comp").distinct(), "todo")
    outside, nbytes = F.col("comp") != F.col("main"), F.sum(F.col("n") * 8)
    size = todo.groupBy("main").agg(F.ceil(nbytes / BLOCK_BYTES).cast("int").alias("nr"), F.ceil(F.sum(F.when(outside, F.col("n") * 8)) / BLOCK_BYTES).cast("int").alias("nl"))
    todo = todo.join(size, "main").withColumn("h", F.xxhash64("rep"))
    right = todo.select("main", "rep", "comp", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), F.pmod("h", "nr").cast("int").alias("j"))
    left = todo.where(outside).select("main", "rep", "comp", F.lit(0).alias("side"), F.pmod("h", "nl").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"))
    blocks = left.union(right).join(sets, "rep").select("main", "i", "j", "side", F.col("rep.id").alias("rep"), "comp", "members")
    more = blocks.groupBy("main", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    stars = comp.select(F.col("component").alias("a"), F.col("node").alias("b"))  # as good as the links they come from
    final = components(stars.union(more), stage, "cc", shrunk=True)  # a block gives a forest
    of_class = classes.join(final, F.col("doc_id") == F.col("node"), "left").select("set_key", F.coalesce("component", "doc_id").alias("c"))
    out = sig.select("doc_id", "h", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "h", "n_shingles", "set_key", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    return _grouped(docs, shingle, percent, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which one document of each group stays: the least doc_id.

    Rows that repeat a doc_id are copies of one document if their shingle sets are equal, and one of them stays;
    texts without words are alike if they are equal. Rows without a doc_id stay.
    """
    stage = Stage(docs.sparkSession, "near-keep")
    found = stage.write(_grouped(docs, shingle, percent, BANDS, ROWS).where("doc_id is not null").select("doc_id", "h", "set_key", "kept"), "groups")
    # a row is known by its id and the hash of its text
    own, text_hash = fresh(docs, "row_id"), fresh(docs, "row_text")
    alike = F.coalesce(F.hex("set_key"), F.col("h").cast("string"))
    first = found.where("kept").groupBy("doc_id", alike.alias("alike")).agg(F.min("h").alias("keep"), F.count("*").alias("rows"), F.countDistinct("h").alias("texts"))
    repeated = first.where("rows > 1")
    drop = found.where("not kept").select("doc_id", "h").distinct()
    again = not repeated.isEmpty()
    if again:
        copies = found.where("kept").withColumn("alike", alike).join(repeated.where("texts > 1").select("doc_id", "alike", "keep"), ["doc_id", "alike"])
        drop = drop.union(copies.where("h <> keep").select("doc_id", "h")).distinct()
    marked = docs.withColumns({own: F.col("doc_id"), text_hash: F.xxhash64("text")})
    gone = drop.select(F.col("doc_id").alias("d"), F.col("h").alias("t"))
    left = marked.join(gone, (F.col(own) == F.col("d")) & (F.col(text_hash) == F.col("t")), "left_anti")
    if again:
        named = left.where(F.col(own).isNotNull()).dropDuplicates([own, text_hash])
        left = named.unionByName(left.where(F.col(own).isNull()))
    return left.select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"), shingle=2, percent=80)
