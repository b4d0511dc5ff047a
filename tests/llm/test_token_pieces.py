"""Pieces of token files: what is held, and how often the library's model is called."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from fathom.llm import bpe, token_files

PATH = bpe.tokenizer_path("byte_bpe_50k.json")


class Counted:
    def __init__(self, model):
        self.model, self.calls, self.words = model, 0, 0

    def encode_batch_fast(self, texts, **more):
        self.calls += 1
        self.words += sum(len(t.split()) for t in texts)
        return self.model.encode_batch_fast(texts, **more)


def counted(**more):
    pieces = token_files.Pieces(PATH, **more)
    pieces.model = Counted(pieces.model)
    return pieces


def words(rng, n):
    return ["".join(rng.choice("abcdeé") for _ in range(9)) for _ in range(n)]


def same(pieces, texts):
    library = Tokenizer.from_file(PATH)
    ids, sizes = pieces.encode(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


def test_lines_share_the_call_of_the_batch():
    """The first words of pieces with line breaks are looked up with the other words: one call a batch, none for held words."""
    rng = random.Random(1)
    texts = ["a " + " ".join(f"{a}.\n{b}{rng.choice(['', ',', '.'])} {c}" for a, b, c in zip(words(rng, 99), words(rng, 99), words(rng, 99))) for _ in range(5)]
    pieces = counted()
    for _ in range(2):
        same(pieces, texts)
        assert pieces.model.calls == 1


def test_held_words_are_bounded_and_those_in_use_stay():
    rng = random.Random(2)
    common = words(rng, 50)
    pieces = counted(most=200)
    for turn in range(20):
        pieces.encode(pa.array(["a " + " ".join([*common, *words(rng, 60)])]))
        assert len(pieces.words.units) == len(pieces.words.found) <= 200
    assert pieces.model.words == 50 + 20 * 60  # a common word once
    same(pieces, ["a " + " ".join(common)])
    assert pieces.model.words == 50 + 20 * 60
    same(pieces, ["a " + " ".join(words(rng, 500))])  # more than are to be held: a batch's
    assert len(pieces.words.units) == 500
    same(pieces, ["a " + " ".join(common)])


def test_lines_of_all_kinds():
    rng = random.Random(3)
    parts = ["a", "\u00c9t\u00e9", "word", "\n", "\n", " ", " ", ".", ",", "'s", "'", "1", "\t", "\r", "\u4e2d", "\u0301", "\xa0", "\u2003", "<|endoftext|>", "it's"]
    for pieces in (token_files.Pieces(PATH), token_files.Pieces(PATH, most=4)):
        for size in (1, 2, 700):
            for _ in range(20 if size < 3 else 3):
                same(pieces, ["".join(rng.choice(parts[: rng.choice([9, 20])]) for _ in range(rng.randrange(0, 25))) for _ in range(size)])
    assert np.array_equal(token_files.Pieces(PATH).encode(pa.array(["", ""]))[1], [0, 0])
