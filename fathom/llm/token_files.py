"""Token ids as Parquet files: one list of ids a document, in ascending doc_id order, with a manifest.

Files: a range partition of doc_id each, rows in order. Columns: doc_id, part, start_in_part (ids of the
part's documents before), n_tokens, ids. Ids are dictionary-encoded (a vocabulary fits a dictionary page) and
doc_id, part and starts delta-encoded by the version 2 writer; row groups and pages are small enough, and carry
page indexes, so that a reader of some documents, or of the metadata alone, reads little else.
The manifest has a row for each part: first and last doc_id, documents, ids, and the ids of all parts before.

Defined results: a null text counts as empty (only the end id); null doc_ids come first; rows that repeat a
doc_id stay, in the order of a hash of their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.bpe import tokenizer_path
from fathom.llm.common import Stage, in_batches, read

END = 2
#: Bytes of text that are encoded together: the more, the fewer distinct pieces a byte.
BATCH = 3_000_000
#: Writer settings: 32 MB row groups, 64 KB pages, version 2 encodings.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "v2",
    "compression": "zstd",
}


#: Letters that any version of Unicode knows, and the punctuation that ends them.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_SHAPE = "^(?P<word>" + _LETTERS + r")(?P<end>[!-&(-/:-@\[-`{-~]*)$"


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids between one end and the next, as bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(4 * ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])


def _joined(entries: pa.Array, at: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The entries `at`, those from each `begin` to the next as one."""
    _, ends, data = entries.take(pa.array(at)).buffers()
    ends = np.frombuffer(ends, np.int64)[np.append(begin, len(at))] if len(at) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), data])


class Held:
    """Ids of units with `lead` before them, in Arrow: at most `most` and a batch's; past that, those not asked for since the last time go."""

    def __init__(self, lead: str, most: int):
        self.lead, self.most = lead, most
        self._keep(pa.array([], pa.large_string()), pa.array([], pa.large_binary()))

    def _keep(self, units: pa.Array, found: pa.Array) -> None:
        self.units, self.found, self.asked = units, found, np.zeros(len(units), bool)

    def ids(self, units: pa.Array, find) -> pa.Array:
        """Ids of distinct units; `find` gets those that are not held."""
        at = np.full(len(units), -1, np.int64)
        place = pc.index_in(self.units, value_set=units)
        known = place.is_valid().to_numpy(zero_copy_only=False)
        at[place.drop_null().to_numpy()] = np.flatnonzero(known)
        self.asked |= known
        new = at < 0
        if new.any():
            more = units.filter(pa.array(new))
            at[new] = len(self.units) + np.arange(len(more))
            self.units = pa.concat_arrays([self.units, more])
            self.found = pa.concat_arrays([self.found, find(more, self.lead)])
            self.asked = np.append(self.asked, np.ones(len(more), bool))
        out = self.found.take(pa.array(at))
        if len(self.units) > self.most:
            if self.asked.sum() > self.most:
                self._keep(units, out)
            else:
                last = pa.array(self.asked)
                self._keep(self.units.filter(last), self.found.filter(last))
        return out


class Pieces:
    """Ids of texts from the tokenizers library, which sees each distinct word while it is held once.

    A byte-level pre-tokeniser never joins what stands before a space with what follows it, unless the space
    is in a run of white space; texts with such runs, or with a special token, go to the library whole. A piece
    between spaces is cut further where the pre-tokeniser cuts too: at single line breaks, and between letters
    and the punctuation that ends them, so `word`, `word,` and `word.` share what the library finds for `word`.
    Arrow finds the distinct words of a batch, looks up those that are held, and puts the ids of texts together;
    the other words go to the library's model in one call.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self.cuts = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["post_processor"] in (None, {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True})
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that byte-level files write as themselves
        other = iter(range(256, 512))
        letters = [b if b in shown else next(other) for b in range(256)]
        self.space = chr(letters[ord(" ")])
        self.table = np.array(letters, "<u4")
        self.table[ord("\n")] = ord(" ")  # never in a word, so it can stand between words
        self.model = Tokenizer(self.library.model)  # alone: words as byte-level files write them, between spaces
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.leads = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
        self.leads[[i for t, i in spec["model"]["vocab"].items() if t.startswith(self.space)]] = True
        self.words = Held(" ", most)  # letters, with a space before them
        self.plain = Held("", most // 4)  # letters and punctuation without one
        self.others = {lead: Held(lead, most // 4) for lead in ("", " ")}  # pieces of other kinds

    def _whole(self, texts: list[str]) -> pa.Array:
        """Ids of texts, or of units that can stand alone, from the library."""
        found = [self.library.encode(t, add_special_tokens=False).ids for t in texts]
        return _binary(np.array([i for ids in found for i in ids], "<i4"), np.cumsum([0, *map(len, found)]))

    def _units(self, units: pa.Array, lead: str) -> pa.Array:
        return self._whole([lead + u for u in units.to_pylist()])

    def _words(self, words: pa.Array, lead: str = " ") -> pa.Array:
        """Ids of words of letters with a space before each. Letters alone are one word to the library's model."""
        before, after, none = (pa.scalar(x, pa.large_string()) for x in (lead, "\n", ""))
        raw = np.frombuffer(pc.binary_join_element_wise(before, words, after, none).buffers()[2], np.uint8)
        flat = np.array(self.model.encode_batch_fast([self.table[raw].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<i4")
        starts = np.flatnonzero(self.leads[flat])  # only a word's first token begins with the space
        if len(starts) != len(words) or starts[0]:
            return self._units(words, lead)
        return _binary(flat, np.append(starts, len(flat)))

    def _shaped(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of those distinct pieces, a space before each, whose lines are letters and what ends them; and which these are."""
        parts = pc.split_pattern(pieces, "\n")
        begin = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        cut = pc.extract_regex(parts.flatten(), pattern=_SHAPE)
        fits = cut.is_valid().to_numpy(zero_copy_only=False)
        able = np.logical_and.reduceat(fits, begin) if len(begin) else np.zeros(0, bool)
        n = np.diff(np.append(begin, len(fits)))
        first = np.zeros(len(fits), bool)
        first[begin] = True
        lines = np.repeat(able, n)
        word, end = cut.filter(pa.array(lines)).flatten()
        first, n = first[lines], n[able]
        words = word.filter(pa.array(first)).dictionary_encode()
        later = word.filter(pa.array(~first))
        plain = pa.concat_arrays([end, later, pa.array(["", "\n"], pa.large_string())]).dictionary_encode()
        entries = pa.concat_arrays([self.plain.ids(plain.dictionary, self._units), self.words.ids(words.dictionary, self._words)])
        codes = plain.indices.to_numpy()
        units = np.empty((len(first), 3), np.int64)  # a line: its line break, letters, and what ends them
        units[:, 0] = np.where(first, codes[-2], codes[-1])
        units[first, 1] = len(plain.dictionary) + words.indices.to_numpy().astype(np.int64)
        units[~first, 1] = codes[len(end) : -2]
        units[:, 2] = codes[: len(end)]
        return _joined(entries, units.reshape(-1), 3 * (np.cumsum(n) - n)), able

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column without nulls, one after the other, and the number of ids of each text."""
        if not self.cuts or not len(column):
            return self._flat(self._whole(column.to_pylist()))
        parts = pc.split_pattern(column.cast(pa.large_string()), " ")
        begin = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        values = parts.flatten()
        named = values.dictionary_encode()
        codes = named.indices.to_numpy()
        first = np.zeros(len(codes), bool)
        first[begin] = True
        used = np.zeros(len(named.dictionary), bool)  # a text's first piece has no space before it
        used[codes[~first]] = True
        used = np.flatnonzero(used)
        pieces = named.dictionary.take(pa.array(used))
        shaped, able = self._shaped(pieces)
        starts = values.take(pa.array(begin)).dictionary_encode()
        others, lone = self._alone(pieces.filter(pa.array(~able)), " ")
        begun, alone = self._alone(starts.dictionary, "")
        entries = [pa.array([b""], pa.large_binary()), shaped, others, begun]
        place = np.zeros(len(named.dictionary), np.int64)
        place[used[able]] = 1 + np.arange(len(shaped))
        place[used[~able]] = 1 + len(shaped) + np.arange(len(others))
        at = place[codes]
        at[begin] = 1 + len(shaped) + len(others) + starts.indices.to_numpy()
        # texts for the library: all of their ids at the first piece, none at the others
        whole = np.zeros(len(column), bool)
        if lone.any() or alone.any():
            whole |= np.logical_or.reduceat(np.concatenate([np.zeros(1 + len(shaped), bool), lone, alone])[at], begin)
        for token in self.special:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if whole.any():
            rows = np.flatnonzero(whole)
            at[np.repeat(whole, np.diff(np.append(begin, len(codes))))] = 0
            at[begin[rows]] = sum(map(len, entries)) + np.arange(len(rows))
            entries.append(self._whole(column.take(pa.array(rows)).to_pylist()))
        return self._flat(_joined(pa.concat_arrays(entries), at, begin))

    def _alone(self, pieces: pa.Array, lead: str) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct pieces of any kind; and which of them cannot stand alone and have none."""
        lone = np.array([not p or p[0].isspace() for p in pieces.to_pylist()], bool)
        found = self.others[lead].ids(pieces.filter(pa.array(~lone)), self._units)
        place = np.cumsum(~lone) - 1
        place[lone] = len(found)
        return pa.concat_arrays([found, pa.array([b""], pa.large_binary())]).take(pa.array(place)), lone

    @staticmethod
    def _flat(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(found) + 1] // 4
        return np.frombuffer(data, "<i4")[ends[0] : ends[-1]] if data else np.zeros(0, "<i4"), np.diff(ends)

    def __call__(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=2)
def pieces_for(path: str) -> Pieces:
    """One a Python worker: words that one task has met are known to the next."""
    return Pieces(path)


def _encode(path: str, end: int):
    def run(batches):
        pieces, start = pieces_for(path), 0
        for batch in in_batches(batches, "text", BATCH):
            found, sizes = pieces.encode(pc.fill_null(batch.column("text"), ""))
            ends = np.cumsum(sizes)
            flat = pa.array(np.insert(found, ends, end))
            sizes, ends = sizes + 1, ends + np.arange(1, len(ends) + 1)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(start + ends - sizes), pa.array(sizes), ids], ["doc_id", "start_in_part", "n_tokens", "ids"])
            start += int(ends[-1])
            pa.default_memory_pool().release_unused()  # else a worker keeps half as much again between batches

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = END) -> None:
    """Encode docs (doc_id, text) and write their token files and manifest under folder."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    made = rows.mapInArrow(_encode(path, end), "doc_id long, start_in_part long, n_tokens long, ids array<int>").withColumn("part", F.spark_partition_id())
    made.select("doc_id", "part", "start_in_part", "n_tokens", "ids").write.mode("overwrite").options(**LAYOUT).parquet(f"{folder}/tokens")
    parts = spark.read.parquet(f"{folder}/tokens").groupBy("part").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): filters on doc_id and unread columns are left to the Parquet reader."""
    parts = spark.read.parquet(f"{folder}/manifest").select("part", "base")
    return spark.read.parquet(f"{folder}/tokens").join(parts, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def _crc(batches):
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written token files; ids never leave the task that reads them."""
    parts = spark.read.parquet(f"{folder}/manifest").select("part", "base")
    found = spark.read.parquet(f"{folder}/tokens").mapInArrow(_crc, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return found.join(parts, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Stage(spark, "tokens").root
    write_tokens(read(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return checksums(spark, folder)
