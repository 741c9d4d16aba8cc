"""SentencePiece encoding and decoding of whole texts with the pieces and scores of a model file.

An Aho-Corasick automaton over the pieces reports, at each character, the pieces that end there, longest first; each is
relaxed against the best score where it starts.  That is a Viterbi search in one pass.  No piece goes on after a space that
follows a word, so a text is cut there and the result of a word is remembered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from eventloom.llm.common import map_batches

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
CACHED_WORDS = 1_000_000
_UNKNOWN_PENALTY = 10.0


@dataclass
class Codec:
    automaton: ahocorasick.Automaton
    singles: frozenset[str]
    unknown_id: int
    unknown_score: float
    byte_ids: list[int] | None
    spelled: list[bytes]
    cut: re.Pattern
    known: dict[str, bytes] = field(default_factory=dict)

    def encode_part(self, part: str) -> list[int]:
        """Best segmentation; of equal ones, at each end the longest last piece."""
        size = len(part)
        best, last = [0.0] + [-np.inf] * size, [(0, 0)] * (size + 1)
        plain = self.singles.issuperset(part)
        done = 0
        for at, (length, score, piece) in self.automaton.iter(part):
            end = at + 1
            if not plain:
                while done < end - 1:
                    done += 1
                    self._unknown(part, done, best, last)
            total = best[end - length] + score
            if total > best[end]:
                best[end], last[end] = total, (length, piece)
        if not plain:
            while done < size:
                done += 1
                self._unknown(part, done, best, last)
        ids: list[int] = []
        end = size
        while end:
            length, piece = last[end]
            if piece != self.unknown_id or self.byte_ids is None:
                ids.append(piece)
            else:
                ids += [self.byte_ids[b] for b in reversed(part[end - 1].encode())]
            end -= length
        return ids[::-1]

    def _unknown(self, part: str, end: int, best: list[float], last: list[tuple[int, int]]) -> None:
        """A character that is no piece may stand for itself, at a score below all pieces."""
        if part[end - 1] not in self.singles and best[end - 1] + self.unknown_score > best[end]:
            best[end], last[end] = best[end - 1] + self.unknown_score, (1, self.unknown_id)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, parts = self.known, self.cut.findall(SPACE + text.replace(" ", SPACE))
        for part in set(parts).difference(known):
            known[part] = np.array(self.encode_part(part), "<i4").tobytes()
        return b"".join(map(known.__getitem__, parts))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str = VOCABULARY) -> Codec:
    """The codec of a model file without a normaliser, once per worker."""
    if path not in _codecs:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        usable = [i for i in range(count) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        automaton, spelled = ahocorasick.Automaton(), [b""] * count
        names = {i: model.id_to_piece(i) for i in range(count)}
        for i in usable:
            automaton.add_word(names[i], (len(names[i]), model.get_score(i), i))
            spelled[i] = names[i].encode()
        automaton.make_automaton()
        byte_ids = [i for i in range(count) if model.is_byte(i)]
        for value, i in enumerate(byte_ids):
            spelled[i] = bytes([value])
        if not byte_ids:
            spelled[model.unk_id()] = " ⁇ ".encode()
        # Words may be cut apart only if no piece holds a space after another character; a line break may stand alone
        # only if no piece holds one.
        crossing = any(SPACE in names[i].lstrip(SPACE) for i in usable)
        breaks = any("\n" in names[i] for i in usable)
        part = f"{SPACE}*[^{SPACE}]+|{SPACE}+" if breaks else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        _codecs[path] = Codec(
            automaton, frozenset(names[i] for i in usable if len(names[i]) == 1), model.unk_id(),
            min(model.get_score(i) for i in usable) - _UNKNOWN_PENALTY, byte_ids or None, spelled,
            re.compile(r"(?s).+" if crossing else part))
    return _codecs[path]


def encode_documents(docs: DataFrame, columns: list[str], path: str = VOCABULARY) -> DataFrame:
    """``columns``, ``ids`` and ``restored``: whether decoding gives the text back.

    Null and empty texts have no ids.  A text that holds the space mark itself comes back with spaces.  Rows are coded one
    by one, so repeated rows and ties between rows need no rule; an empty table gives an empty result.
    """

    def coded(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        with_path = codec(path)
        ids = [np.frombuffer(with_path.encode(t), "<i4") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        values = np.concatenate([*ids, np.empty(0, "<i4")]).astype(np.int32)
        back = [with_path.decode(i.tolist()) == t for i, t in zip(ids, texts)]
        return {c: batch.column(c) for c in columns} | {
            "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), "restored": pa.array(back, pa.bool_())}

    chosen = docs.select(*columns, "text")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("text").schema)
    return map_batches(chosen, coded, f"{shape}, ids array<int>, restored boolean")


def decode_documents(coded: DataFrame, columns: list[str], path: str = VOCABULARY) -> DataFrame:
    """``columns`` and ``text`` of rows with ``ids``; null ids give null."""

    def restored(batch: pa.RecordBatch) -> dict:
        texts = [None if ids is None else codec(path).decode(ids) for ids in batch.column("ids").to_pylist()]
        return {c: batch.column(c) for c in columns} | {"text": pa.array(texts, pa.string())}

    chosen = coded.select(*columns, "ids")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("ids").schema)
    return map_batches(chosen, restored, f"{shape}, text string")
