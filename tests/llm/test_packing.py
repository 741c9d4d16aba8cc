"""Tokens against the tokenizer, packing against its rules."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventloom.llm.packing import CAPACITY, best_fit, local_search, pack_documents, pieces
from eventloom.llm.word_bpe import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(count=300):
    rng = random.Random(1)
    made = ["".join(rng.choice("ABab éÉßÿ.,'sit<|>endoftext 12\n\t3Σςİ é日 #*%") for _ in range(rng.randint(0, 80)))
            for _ in range(count)]
    return [*made, "<|endoftext|> a<|startoftext|>b don't I'll Straße ÀÉ ﬁ", "", " \n", "word " * 9000, "x" * 5000]


def test_ids_are_the_tokenizers():
    made = texts()
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(made, add_special_tokens=False)]
    got = encoder(PATH).encode([t.encode() for t in made])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


@pytest.mark.parametrize("low, high", [(1, 900), (1100, 2500), (2049, 4095), (4000, 4096)])
def test_search_keeps_items_and_bounds(low, high):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(700)]
    first = best_fit(lengths, CAPACITY)
    better = local_search(first, lengths, CAPACITY)
    assert sorted(i for items in better for i in items) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in items) <= CAPACITY for items in better)
    assert -(-sum(lengths) // CAPACITY) <= len(better) <= len(first)


def test_steps_empty_a_bin():
    # A move; an exchange of one for one and a move.
    assert len(local_search([[0], [1]], [3, 5], 10)) == 1
    assert len(local_search([[0, 1], [2, 3], [4]], [6, 2, 4, 4, 3], 10)) == 2


def test_two_for_one_raises_squared_fill():
    # The five can only go in for two twos.
    lengths = [2, 2, 2, 2, 9, 5, 1]
    found = local_search([[0, 1, 2, 3], [4], [5, 6]], lengths, 10, donors=3)
    squares = sorted(sum(lengths[i] for i in items) ** 2 for items in found)
    assert sum(squares) >= 8 ** 2 + 9 ** 2 + 6 ** 2


def test_documents(spark):
    made = [None, *texts(120)]
    rows = [(i, t, i) for i, t in enumerate(made)] + [(3, made[3], 0), (None, made[4], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = pack_documents(docs, group_pieces=50).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for key, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), CAPACITY):
            part = ids[at:at + CAPACITY]
            row = (key, at // CAPACITY, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            want[row] = want.get(row, 0) + 1
    found = {}
    for r in got:
        row = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        found[row] = found.get(row, 0) + 1
    assert found == want
    filled = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= CAPACITY


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces(empty).collect() == [] and pack_documents(empty).collect() == []
