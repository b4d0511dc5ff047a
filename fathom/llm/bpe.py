"""BPE encoding and decoding over a trie of words, each prefix of which is encoded once.

Every prefix of a word has a last token. It is the only vocabulary entry t that ends the prefix, such that t
and the last token of what stands before t stay two tokens when BPE encodes them together. So a word's
tokens follow from those of its prefixes: distinct words go into a trie, a depth-first walk gives every new
node its last token from its ancestors', and words that share a prefix share that work. A word's ids are
read off by going back along last tokens.

Whether two tokens stay apart is decided once a pair, by applying the merges to the two. The normaliser, the
pre-tokeniser and the special tokens are those of the tokenizer file; a text is cut at white space, and each
distinct piece is normalised, split, and looked up in the trie once while it is held.

Defined results: a null text counts as empty (no ids, decoded as the empty text); repeated rows give repeated
results; an empty table gives an empty result; all other columns, clashing names too, are passed on by
:func:`encode`; very long texts are cut into pieces at white space, one text being held whole in one task. A file with
a decoder, or with added tokens that strip or normalise what is around them, raises ValueError.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import fresh, in_batches, read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files are; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Trie:
    """Last tokens along the trie of words; words come sorted, so a walk over them is depth-first.

    Of the trie only the path to the present node is held. A word goes on from the node where it leaves the
    word before it.
    """

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.vocab, self.end = vocab, end
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        self.longest = max((self.size(t) for t in vocab), default=1)
        #: of each token, once known: whether BPE makes it of its own symbols
        self.whole: dict[str, bool | None] = dict.fromkeys(vocab)
        self.apart: dict[tuple[str, str], bool] = {}

    def size(self, token: str) -> int:
        return len(token) - len(self.end) if self.end and token.endswith(self.end) else len(token)

    def _symbols(self, token: str) -> list[str]:
        n = self.size(token)
        return [*token[: n - 1], token[n - 1 :]]

    def _merge(self, symbols: list[str]) -> list[str]:
        rank, none = self.rank, 1 << 60
        while len(symbols) > 1:
            best, at = min((rank.get(p, none), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if best == none:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _stay_apart(self, a: str, b: str) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            known = self.apart[a, b] = self._merge(self._symbols(a) + self._symbols(b)) == [a, b]
        return known

    def _last(self, word: str, depth: int, mark: str, path: list[str]) -> str:
        """The last token of the prefix of `depth` symbols; mark: what the last symbol carries besides."""
        whole, apart = self.whole, self.apart
        for size in range(1, min(depth, self.longest) + 1):  # one token fits, so the order is free
            token = word[depth - size : depth] + mark
            known = whole.get(token, 0)
            if known is None:
                known = whole[token] = self._merge(self._symbols(token)) == [token]
            if known:
                if size == depth:
                    return token
                pair = path[depth - size], token
                ok = apart.get(pair)
                if ok or ok is None and self._stay_apart(*pair):
                    return token
        raise ValueError(f"the vocabulary has no token for {word[depth - 1]!r}")

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words, which are sorted first."""
        out: dict[str, list[int]] = {}
        path, before, vocab, end = [""], "", self.vocab, self.end
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word) - 1, len(path) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            for depth in range(shared + 1, len(word)):
                path.append(self._last(word, depth, "", path))
            token = self._last(word, len(word), end, path)  # the node of the whole word is no prefix of another
            ids, depth = [vocab[token]], len(word) - self.size(token)
            while depth:
                token = path[depth]
                ids.append(vocab[token])
                depth -= len(token)
            out[word], before = ids[::-1], word
        return out


#: What Python's str.split() takes for white space and the tokenizer's pattern does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Encoder:
    """Encodes texts with one tokenizer file by the trie; holds a bounded number of pieces of text."""

    def __init__(self, path: str, most_pieces: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("decoder") is not None:
            raise ValueError("only files without a decoder are decoded here")
        if any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip, normalise or want whole words are not supported")
        own = Tokenizer.from_file(path)
        self.normalize = own.normalizer.normalize_str if own.normalizer else str
        self.pre = own.pre_tokenizer.pre_tokenize_str
        self.end = model.get("end_of_word_suffix") or ""
        self.trie = Trie(model["vocab"], model["merges"], self.end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.most_pieces = most_pieces
        self.names = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            self.names[i] = token
        self.split = self._pattern(spec)
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _pattern(spec: dict):
        """The file's own word pattern, where its steps on printable ASCII are lower case and that pattern alone."""
        import regex

        steps = (spec["normalizer"] or {}).get("normalizers", [])
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]:
            return regex.compile(cuts[0]["pattern"]["Regex"])
        return None

    def _words(self, piece: str) -> list[str]:
        if self.split is not None and piece.isascii() and piece.isprintable():
            return self.split.findall(piece.lower())
        return [w for w, _ in self.pre(self.normalize(piece))]

    def _learn(self, parts: list[str]) -> None:
        if len(self.pieces) > self.most_pieces:
            self.pieces.clear()
        new = {piece: self._words(piece) for piece in set(parts).difference(self.pieces)}
        ids = self.trie.encode(list({w for words in new.values() for w in words}))
        for piece, words in new.items():
            self.pieces[piece] = np.array([i for w in words for i in ids[w]], "<u4").tobytes()

    def learn(self, texts_: list[str | None]) -> None:
        """Take the distinct pieces of many texts at once, so that their words share one walk."""
        self._learn([x for t in texts_ if t for x in self._parts(t)])

    @staticmethod
    def _parts(text: str) -> list[str]:
        return text.split() if not _NOT_SPACE.search(text) else [x for x in _SPACE.split(text) if x]

    def _plain(self, text: str) -> bytes:
        parts = self._parts(text)
        try:
            return b"".join(map(self.pieces.__getitem__, parts))
        except KeyError:
            self._learn(parts)
            return b"".join(map(self.pieces.__getitem__, parts))

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.cut is None or not any(t in text for t in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: list[int]) -> str:
        """A tokenizer file without a decoder joins its tokens by one space."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """One encoder a Python worker: pieces and token pairs that one task has met are known to the next."""
    return Encoder(path)


def _hashes(encoder: Encoder, found: bytes) -> tuple[str, str]:
    """SHA-256 of ids and of the text they decode to."""
    return hashlib.sha256(found).hexdigest(), hashlib.sha256(encoder.decode(np.frombuffer(found, "<u4").tolist()).encode()).hexdigest()


def _digests(path: str):
    def run(batches):
        encoder = encoder_for(path)
        for batch in in_batches(batches, "text"):
            n, ids, decoded = [], [], []
            whole = batch.column("text").to_pylist()
            encoder.learn(whole)
            for text in whole:
                found = encoder(text)
                n.append(len(found) // 4)
                a, b = _hashes(encoder, found)
                ids.append(a)
                decoded.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids are made, hashed and decoded in one pass, without a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, into: str = "token_ids", hashed: bool = False) -> DataFrame:
    """docs with a column of token ids; its name gets a leading underscore where docs has it already.

    hashed: decode the ids too, in the same pass, and add ids_sha256 and decoded_sha256, as :func:`digests` has them.
    """
    name = fresh(docs, into)
    added = [T.StructField(name, T.ArrayType(T.IntegerType()))]
    if hashed:
        added += [T.StructField(fresh(docs, x), T.StringType()) for x in ("ids_sha256", "decoded_sha256")]

    def run(batches):
        encoder = encoder_for(path)
        for batch in in_batches(batches, "text"):
            whole = batch.column("text").to_pylist()
            encoder.learn(whole)
            found = [encoder(t) for t in whole]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            more = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))]
            if hashed:
                more += [pa.array(list(column), pa.string()) for column in zip(*(_hashes(encoder, x) for x in found))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(rows: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """rows with the text of their token ids; null ids count as none."""
    name = fresh(rows, into)

    def run(batches):
        encoder = encoder_for(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([encoder.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), tokenizer_path())
