"""Byte-pair encoding of many words at once, for vocabularies with word ends.

Rows of a matrix are words; each step merges the best pair of every row, the leftmost of equal ones, until no row has a pair that
the vocabulary merges.  Plain words are encoded here, everything else by the tokenizer itself; the ids are the same.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
from tokenizers import Tokenizer

# Letters that the normaliser only lower-cases, one to one, then punctuation that is one token to split further.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|%$&#*()]*)")
CACHED_WORDS = 1_000_000
_NONE = np.int32(1 << 30)
_ROWS = 16_384


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    named = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
    return [named[b] for b in range(256)]


@dataclass
class Encoder:
    tokenizer: Tokenizer
    inner: np.ndarray  # id of each byte within a word
    last: np.ndarray  # id of each byte at its end
    keys: np.ndarray  # open hash table of pairs
    ranks: np.ndarray
    merged: np.ndarray
    known: dict[bytes, bytes] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, or ``_NONE``, and its place in the table."""
        pair = left.astype(np.int64) << 20 | right
        slot = _slot(pair, len(self.keys))
        open_ = np.flatnonzero((self.keys[slot] != pair) & (self.keys[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            there = self.keys[slot[open_]]
            open_ = open_[(there != pair[open_]) & (there >= 0)]
        return np.where(self.keys[slot] == pair, self.ranks[slot], _NONE), slot

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of whole words, as little-endian 32-bit numbers; words of like length are encoded together."""
        coded = [w.encode() for w in words]
        made: list[bytes] = [b""] * len(words)
        by_length = sorted(range(len(words)), key=lambda i: len(coded[i]))
        for at in range(0, len(by_length), _ROWS):
            rows = by_length[at:at + _ROWS]
            for row, ids in zip(rows, self._encode_block([coded[i] for i in rows])):
                made[row] = ids
        return made

    def _encode_block(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        inside = np.arange(width) < sizes[:, None]
        symbols = np.where(inside, self.inner[data], -1).astype(np.int32)
        every = np.arange(len(words))
        symbols[every, sizes - 1] = self.last[data[every, sizes - 1]]
        out = symbols.copy()
        lengths = sizes.copy()
        rows = every
        if width > 1:
            ranks = np.full((len(words), width), _NONE, np.int32)
            pairs = inside[:, 1:]
            ranks[:, :-1][pairs] = self._find(symbols[:, :-1][pairs], symbols[:, 1:][pairs])[0]
            columns = np.arange(width)
            while True:
                at = ranks.argmin(axis=1)
                alive = ranks[np.arange(len(rows)), at] < _NONE
                if not alive.all():
                    out[rows[~alive]] = symbols[~alive]
                    rows, symbols, ranks, at = rows[alive], symbols[alive], ranks[alive], at[alive]
                if not len(rows):
                    break
                number = np.arange(len(rows))
                slot = self._find(symbols[number, at], symbols[number, at + 1])[1]
                # Everything behind the pair moves up by one.
                source = np.minimum(columns + (columns > at[:, None]), width - 1)
                symbols = np.take_along_axis(symbols, source, axis=1)
                ranks = np.take_along_axis(ranks, source, axis=1)
                lengths[rows] -= 1
                symbols[:, -1], ranks[:, -1] = -1, _NONE
                symbols[number, at] = self.merged[slot]
                ends = lengths[rows]
                after = np.flatnonzero(at + 1 < ends)
                ranks[number, at] = _NONE
                ranks[after, at[after]] = self._find(symbols[after, at[after]], symbols[after, at[after] + 1])[0]
                before = np.flatnonzero(at > 0)
                ranks[before, at[before] - 1] = self._find(symbols[before, at[before] - 1], symbols[before, at[before]])[0]
        flat = out.astype("<i4")
        return [flat[i, :n].tobytes() for i, n in enumerate(lengths.tolist())]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text.

        The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in a row.
        """
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
            self.words.clear()
        split = [text.split() for text in texts]
        missing = {w for words in split for w in words if w not in self.known}
        plain, rest = [], []
        for chunk in missing:
            text = chunk.decode()
            match = PLAIN.fullmatch(text)
            if match:
                plain.append((chunk, match[1].lower(), match[2]))
            else:
                rest.append((chunk, text))
        fresh = list({part for _, word, mark in plain for part in (word, mark) if part and part not in self.words})
        self.words.update(zip(fresh, self.encode_words(fresh)))
        self.words[""] = b""
        for chunk, word, mark in plain:
            self.known[chunk] = self.words[word] + self.words[mark]
        if rest:
            for (chunk, _), coded in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)):
                self.known[chunk] = np.array(coded.ids, "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def _slot(pair: np.ndarray, size: int) -> np.ndarray:
    mixed = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % size


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, once per worker."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        characters = _byte_characters()
        size = 1 << 18
        keys, ranks, merged = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        coded = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        for rank, (pair, slot) in enumerate(zip(coded.tolist(), _slot(coded, size).tolist())):
            while keys[slot] >= 0 and keys[slot] != pair:
                slot = (slot + 1) % size
            if keys[slot] < 0:
                keys[slot], ranks[slot], merged[slot] = pair, rank, vocabulary["".join(pairs[rank])]
        _loaded[path] = Encoder(Tokenizer.from_file(path), np.array([vocabulary[c] for c in characters]),
                                np.array([vocabulary[c + end] for c in characters]), keys, ranks, merged)
    return _loaded[path]
