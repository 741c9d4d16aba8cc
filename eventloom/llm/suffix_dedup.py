"""Exact substring dedup: bytes inside any 200-byte string that also starts elsewhere are removed.

A common-prefix-aware distributed merge sort over a sparse set of suffixes.  Every 200-byte window belongs to the 64-byte gram
in it with the smallest hash, its anchor; equal windows have equal anchors at equal distance.  Neighbouring windows share an
anchor, so a text has about one anchor in 70 bytes.  Anchors whose gram occurs once cannot lie in a repeat and are left out.

Of the others, each task sorts the suffixes from the anchor on into a run, front-coded: per suffix the length of the prefix
it shares with the one before, and the rest.  Runs are exchanged by gram and merged with a loser tree that knows the common
prefixes and compares only what lies behind them.  The common prefixes of neighbours in the merged order, and of the
texts to the left of the anchors, tell exactly which windows occur more than once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import cut_lineage, map_batches, texts_of, with_row

LENGTH = 200
GRAM = 64
_GRAMS = LENGTH - GRAM + 1  # grams in a window
_BLOCK = 1 << 20  # bytes looked at together
_RUN_BYTES = 24 << 20  # bytes of suffixes sorted together
_PART_BYTES = 12 << 20  # bytes of suffixes merged together, before front coding
# From this many occurrences on, an anchor's windows are dealt out one by one: no task gets all of a very common passage.
SPREAD_FROM = 20_000
_PLACE = np.uint64(0x7FFFFFFF)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _powers(base: int, count: int) -> np.ndarray:
    made = np.full(count, base, np.uint64)
    made[0] = 1
    return np.multiply.accumulate(made)


_UP = _powers(_BASE, _BLOCK + 2 * LENGTH)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 2 * LENGTH)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each place on."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _UP[:len(data)], out=sums[1:])
    hashes = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[:len(data) - GRAM + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks in both directions."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:count], forward[width - 1:width - 1 + count])


def block_anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(place, first, last, hash)``: anchors, and the first and last start of the windows that belong to each.

    ``valid`` marks the starts of windows that lie in one text.  The smallest hash wins, of equal ones the leftmost; both
    depend on the window alone.
    """
    hashes = gram_hashes(data)
    ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    place = (_sliding_least(ranked, _GRAMS) & _PLACE).astype(np.int64)
    changed = place[1:] != place[:-1]
    first = valid.copy()
    first[1:] &= changed | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= changed | ~valid[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return place[first], first, last, hashes[place[first]]


def _blocks(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """Parts ``(text, from, to)`` of about a block together; parts of a long text overlap by all but one byte of a window."""
    block, size = [], 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, _BLOCK // 2):
            to = min(len(text), at + _BLOCK // 2 + LENGTH - 1)
            if size + to - at > _BLOCK:
                yield block
                block, size = [], 0
            block.append((number, at, to))
            size += to - at
    if block:
        yield block


def batch_anchors(rows: np.ndarray, texts: list[bytes]) -> dict:
    """``_row``, ``key`` and ``spot`` of all anchors: place * 65536 + distance to the first start * 256 + to the last."""
    made = {"_row": [], "key": [], "spot": []}
    for block in _blocks(texts):
        data = np.frombuffer(b"".join(texts[n][a:b] for n, a, b in block), np.uint8).astype(np.uint64)
        sizes = np.array([b - a for _, a, b in block])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        valid = np.zeros(len(data) + 1, np.int8)
        valid[starts] += 1
        valid[ends - LENGTH + 1] -= 1
        valid = np.cumsum(valid[:len(data) - LENGTH + 1], dtype=np.int8).astype(bool)
        place, first, last, hashes = block_anchors(data, valid)
        part = np.searchsorted(ends, first, side="right")
        within = place - starts[part] + np.array([a for _, a, _ in block])[part]
        made["_row"].append(rows[np.array([n for n, _, _ in block])[part]])
        made["key"].append(hashes.view(np.int64))
        made["spot"].append(within << 16 | (place - first) << 8 | (place - last))
    return {name: np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64) for name, parts in made.items()}


def mismatch(a: bytes, b: bytes, at: int) -> int:
    """The first place from ``at`` on where the strings differ, or where the shorter ends."""
    end = min(len(a), len(b))
    differing = int.from_bytes(a[at:end], "big") ^ int.from_bytes(b[at:end], "big")
    return end - (differing.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """``(run, place in run, common prefix with the string before)`` of all strings of sorted runs, in order.

    A loser tree in which every loser keeps the prefix it shares with the string that beat it.  Of two that know their
    common prefix with the last winner, the longer one is smaller; only if they are equal are bytes compared, from there on.
    """
    count = len(runs)
    at, known = [0] * count, [0] * count
    text: list[bytes | None] = [strings[0] if strings else None for strings, _ in runs]

    def beats(a: int, b: int) -> bool:
        one, two = text[a], text[b]
        if one is None or two is None:
            return two is None
        if known[a] != known[b]:
            return known[a] > known[b]
        same = mismatch(one, two, known[a])
        if same == len(one) or (same < len(two) and one[same] < two[same]):
            known[b] = same
            return True
        known[a] = same
        return False

    losers = [-1] * count
    winner = -1
    for leaf in range(count):
        node, current = (leaf + count) // 2, leaf
        while node and losers[node] >= 0:
            other = losers[node]
            if beats(other, current):
                losers[node], current = current, other
            node //= 2
        if node:
            losers[node] = current
        else:
            winner = current
    while winner >= 0 and text[winner] is not None:
        strings, shared = runs[winner]
        place = at[winner]
        yield winner, place, known[winner]
        at[winner] = place = place + 1
        if place < len(strings):
            text[winner], known[winner] = strings[place], shared[place]
        else:
            text[winner] = None
        current, node = winner, (winner + count) // 2
        while node:
            other = losers[node]
            if beats(other, current):
                losers[node], current = current, other
            node //= 2
        winner = current


_RUN_SCHEMA = "part int, strings long, shared binary, sizes binary, tails binary, lefts binary, marks binary, spans binary"


class RunWriter:
    """Collects suffixes of one task and gives them out as front-coded sorted runs, one row for each part."""

    def __init__(self, parts: int):
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.found: dict[tuple[bytes, int], list[int]] = {}
        self.spans: list[int] = []
        self.size = 0

    def add(self, row: int, start: int, text: bytes, left: int, spread: bool) -> None:
        """The windows within ``text``; ``left`` bytes of it lie before the anchor."""
        entry = self.found.get((text, left))
        if entry is None:
            whole = text if spread else text[left:left + GRAM]
            self.found[text, left] = [zlib.crc32(whole) % self.parts, row, start]
            self.size += len(text)
            return
        # Repeated within the run: known at once, whatever the merge says.
        if entry[1] >= 0:
            self.spans += (entry[1], entry[2], entry[2] + len(text))
            entry[1] = -1
        self.spans += (row, start, start + len(text))

    def rows(self) -> pa.RecordBatch:
        by_part: dict[int, list] = {}
        for (text, left), (part, row, start) in self.found.items():
            by_part.setdefault(part, []).append((text[left:], text[:left], row, start))
        made = {name.split()[0]: [] for name in _RUN_SCHEMA.split(", ")}

        def emit(part: int, strings: int, *columns: np.ndarray | bytes) -> None:
            packed = [zlib.compress(c if isinstance(c, bytes) else c.tobytes(), 1) for c in columns]
            for values, value in zip(made.values(), (part, strings, *packed)):
                values.append(value)

        none = np.empty(0, np.int64)
        for part, entries in by_part.items():
            entries.sort(key=lambda e: e[0])
            shared, tails, before = [], [], b""
            for suffix, *_ in entries:
                same = mismatch(before, suffix, 0)
                shared.append(same)
                tails.append(suffix[same:])
                before = suffix
            emit(part, len(entries), np.array(shared, np.uint8), np.array([(len(e[0]), len(e[1])) for e in entries], np.uint8),
                 b"".join(tails), b"".join(e[1] for e in entries), np.array([e[2:] for e in entries], np.int64), none)
        if self.spans:
            empty = np.empty(0, np.uint8)
            emit(self.spans[0] % self.parts, 0, empty, empty, b"", b"", none, np.array(self.spans, np.int64))
        self.clear()
        types = {"part": pa.int32(), "strings": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.binary())) for n, v in made.items()], names=list(made))


def read_run(row: dict) -> tuple[list[bytes], list[int], list[bytes], np.ndarray]:
    """Suffixes, their common prefixes, the texts left of the anchors, and ``(row, start)`` of each."""
    raw = {name: zlib.decompress(row[name]) for name in ("shared", "sizes", "tails", "lefts", "marks")}
    sizes = np.frombuffer(raw["sizes"], np.uint8).reshape(-1, 2).tolist()
    strings, lefts, before, tail_at, left_at = [], [], b"", 0, 0
    for same, (size, left) in zip(raw["shared"], sizes):
        before = before[:same] + raw["tails"][tail_at:tail_at + size - same]
        tail_at += size - same
        strings.append(before)
        lefts.append(raw["lefts"][left_at:left_at + left])
        left_at += left
    return strings, list(raw["shared"]), lefts, np.frombuffer(raw["marks"], np.int64).reshape(-1, 2)


def repeated_windows(rows: list[dict]) -> np.ndarray:
    """``(row, start, end)`` of the repeated windows of one part's runs, neighbouring ones joined."""
    runs = [read_run(r) for r in rows if r["strings"]]
    if not runs:
        return np.empty((0, 3), np.int64)
    order = np.array(list(merge_runs([(r[0], r[1]) for r in runs])), np.int64)
    count = len(order)
    right_shared = order[:, 2]
    right_shared[0] = 0
    right_size = np.array([len(runs[i][0][j]) for i, j, _ in order])
    lefts = [runs[i][2][j][::-1] for i, j, _ in order]
    marks = np.array([runs[i][3][j] for i, j, _ in order])
    left_size = np.array([len(x) for x in lefts])
    by_left = sorted(range(count), key=lefts.__getitem__)
    left_shared = np.array([0, *(mismatch(lefts[a], lefts[b], 0) for a, b in zip(by_left, by_left[1:]))])
    by_left = np.array(by_left)
    repeated = np.zeros((count, _GRAMS + 1), bool)  # by distance of the window's start from the anchor
    group = np.empty(count, np.int64)
    for back in range(_GRAMS):
        some = np.flatnonzero((LENGTH - right_size <= back) & (back <= left_size))
        if len(some) < 2:
            continue
        # Equal windows share what is left of the anchor and what is right of it.
        group[by_left] = np.cumsum(left_shared < back)
        both = np.cumsum(right_shared < LENGTH - back)[some] * (count + 1) + group[some]
        sort = np.argsort(both, kind="stable")
        same = both[sort][1:] == both[sort][:-1]
        twice = np.zeros(len(some), bool)
        twice[sort[1:][same]] = True
        twice[sort[:-1][same]] = True
        repeated[some[twice], back] = True
    repeated[marks[:, 0] < 0] = False
    edges = np.diff(np.concatenate([np.zeros((count, 1), np.int8), repeated.astype(np.int8)], axis=1), axis=1)
    entry, near = np.nonzero(edges == 1)
    far = np.nonzero(edges == -1)[1] - 1
    anchor = marks[entry, 1] + left_size[entry]
    return np.stack([marks[entry, 0], anchor - far, anchor - near + LENGTH], axis=1)


def repeated_spans(docs: DataFrame, spread_from: int = SPREAD_FROM) -> DataFrame:
    """``(_row, start, end)``: spans that cover all repeated windows of ``docs`` (``_row``, ``text``)."""

    def anchored(batch: pa.RecordBatch) -> dict:
        return batch_anchors(batch.column("_row").to_numpy(), texts_of(batch.column("text")))

    anchors = map_batches(docs.select("_row", "text"), anchored, "_row bigint, key bigint, spot bigint")
    # Cut off, so that the join deals both sides anew and can split an anchor that holds many rows.
    repeated = cut_lineage(anchors.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    spots = anchors.join(repeated, "key").select("_row", (F.col("spot") * 2 + (F.col("n") >= spread_from).cast("long")).alias("spot"))
    wanted = cut_lineage(spots.groupBy("_row").agg(F.collect_list("spot").alias("spots")))
    total = wanted.agg(F.sum(F.size("spots"))).first()[0] or 0
    parts = max(8, -(-total * (LENGTH + GRAM) // _PART_BYTES))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = RunWriter(parts)
        for batch in batches:
            for row, text, spots in zip(batch.column("_row").to_pylist(), texts_of(batch.column("text")), batch.column("spots")):
                for spot in spots.values.to_pylist():
                    place, first, last, spread = spot >> 17, spot >> 9 & 255, spot >> 1 & 255, spot & 1
                    if spread:
                        for back in range(last, first + 1):
                            writer.add(row, place - back, text[place - back:place - back + LENGTH], back, True)
                    else:
                        writer.add(row, place - first, text[place - first:place - last + LENGTH], first, False)
                if writer.size > _RUN_BYTES:
                    yield writer.rows()
        yield writer.rows()

    def merged(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        known = [np.frombuffer(zlib.decompress(r["spans"]), np.int64).reshape(-1, 3) for r in rows]
        spans = np.concatenate([repeated_windows(rows), *known])
        return pa.table({name: pa.array(np.ascontiguousarray(spans[:, i])) for i, name in enumerate(("_row", "start", "end"))})

    exchanged = docs.select("_row", "_id", "text").join(wanted.hint("shuffle_hash"), "_row").mapInArrow(runs, _RUN_SCHEMA)
    return exchanged.groupBy("part").applyInArrow(merged, "_row bigint, start bigint, end bigint")


def cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """The text without the spans, the bytes removed, and the number of removed runs."""
    kept, at, removed, number = [], 0, 0, 0
    reached = -1
    for start, end in sorted((s["start"], s["end"]) for s in spans or []):
        if start > reached:
            kept.append(text[at:start])
            number += 1
            reached = start
        if end > reached:
            removed += end - reached
            reached = at = end
    kept.append(text[at:])
    return b"".join(kept), removed, number


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id", spread_from: int = SPREAD_FROM) -> DataFrame:
    """``id_column``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes) of every document.

    Null texts count as empty; texts under 200 bytes have nothing removed.  Matches never cross documents, and are judged on
    the input.  Repeated rows and null ids are documents of their own, so of equal rows all lose their text.  An empty table
    gives an empty result.  ``docs`` is read twice and must number its rows alike, as a stored table does.
    """
    numbered = with_row(docs, F.col(id_column).alias("_id"), "text")
    spans = repeated_spans(numbered, spread_from).groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = numbered.join(spans.hint("shuffle_hash"), "_row", "left")

    def finished(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch.column("text"))
        done = [cut(t, s) for t, s in zip(texts, batch.column("spans").to_pylist())]
        made = {"n_bytes": [len(t) for t in texts], "n_removed": [d[1] for d in done], "n_spans": [d[2] for d in done]}
        return {id_column: batch.column("_id"), "kept": pa.array([d[0] for d in done], pa.binary())} | {
            name: pa.array(values, pa.int64()) for name, values in made.items()}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(joined.select("_id", "text", "spans"), finished,
                       f"`{id_column}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

