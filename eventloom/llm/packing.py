"""Best-fit packing of tokenized documents, improved by swap-based local search.

Documents are tokenized and cut into pieces in parallel; only lengths and checksums move on.  Pieces are dealt into groups
of a bounded expected size; each group is packed best-fit and then improved by moves and exchanges between underfull
sequences that raise the sum of squared fills until sequences are empty.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import cut_lineage, map_batches, texts_of
from eventloom.llm.word_bpe import encoder

CAPACITY = 4096
END_ID = 1
# Pieces a group holds on average; a group is packed by one task.
GROUP_PIECES = 20_000
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, id_column: str = "doc_id", path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: every document with an end id, cut only where it is longer than a sequence."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> dict:
        made = {name: [] for name in (id_column, "piece", "start", "length", "ids_crc32")}
        for key, ids in zip(batch.column(id_column).to_pylist(), encoder(path).encode(texts_of(batch.column("text")))):
            ids += end
            for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                for name, value in zip(made, (key, number, at // 4, len(part) // 4, zlib.crc32(part))):
                    made[name].append(value)
        types = {id_column: batch.schema.field(id_column).type, "piece": pa.int32()}
        return {name: pa.array(values, types.get(name, pa.int64())) for name, values in made.items()}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, "text"), cut,
                       f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with room.

    Bins are kept by room; a bit mask over rooms finds the smallest room that is large enough.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        left = room - size
        by_room[left].append(at)
        rooms |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, donors: int = 32) -> list[list[int]]:
    """Empties underfull bins by exchanges that raise the sum of squared fills.

    Bins are taken as donors from the emptiest on, ``donors`` of them at most without success.  A step moves one item of
    the donor into a fuller bin, exchanges it for one smaller item there or for two that are smaller together.  Every
    step fills a fuller bin at the cost of the donor, so the search ends; it also ends at the bound, the fewest bins
    that could hold all items.
    """
    size = np.array(lengths, np.int64)
    where = np.empty(len(lengths), np.int64)
    for at, items in enumerate(bins):
        where[items] = at
    room = np.array([capacity - sum(lengths[i] for i in items) for items in bins], np.int64)
    bound, used, failed, spent = -(-int(size.sum()) // capacity), len(bins), 0, set()

    def put(item: int, to: int) -> None:
        room[where[item]] += size[item]
        room[to] -= size[item]
        where[item] = to

    def step(donor: int, item: int) -> bool:
        fuller = (room < room[donor]) & (room > 0)
        fuller[donor] = False
        need = int(size[item])
        open_bins = np.flatnonzero(fuller & (room >= need))
        if len(open_bins):
            put(item, int(open_bins[np.argmin(room[open_bins])]))
            return True
        partners = np.flatnonzero(fuller[where] & (size < need) & (size >= need - room[where]))
        if len(partners):
            other = int(partners[np.argmin(size[partners])])
            home = int(where[other])
            put(other, donor)
            put(item, home)
            return True
        # Two for one: per bin, the largest pair below the item that leaves no more room than there is.
        candidates = np.flatnonzero(fuller[where] & (size < need))
        if len(candidates) < 2:
            return False
        by_bin = candidates[np.lexsort((size[candidates], where[candidates]))]
        homes, starts = np.unique(where[by_bin], return_index=True)
        for home, first, last in zip(homes, starts, [*starts[1:], len(by_bin)]):
            items, low, high = by_bin[first:last], 0, last - first - 1
            while low < high:
                pair = int(size[items[low]] + size[items[high]])
                if pair >= need:
                    high -= 1
                elif need - pair > room[home]:
                    low += 1
                else:
                    a, b = int(items[low]), int(items[high])
                    put(a, donor)
                    put(b, donor)
                    put(item, int(home))
                    return True
        return False

    while used > bound and failed < donors:
        open_donors = [b for b in np.argsort(-room) if room[b] < capacity and b not in spent]
        if not open_donors:
            break
        donor = int(open_donors[0])
        moved = True
        while moved and room[donor] < capacity:
            own = sorted(np.flatnonzero(where == donor), key=lambda i: -size[i])
            moved = any(step(donor, int(item)) for item in own)
        if room[donor] == capacity:
            used -= 1
        else:
            spent.add(donor)
            failed += 1
    packed: list[list[int]] = [[] for _ in bins]
    for item, at in enumerate(where):
        insort(packed[at], item)
    return [items for items in packed if items]


def pack_group(group: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """One group of pieces with ``sequence_id`` and ``offset``."""
    lengths = group["length"].tolist()
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    base = int(group["_group"].iloc[0]) << 32
    for number, items in enumerate(bins):
        at = 0
        for item in items:
            sequence[item], offset[item] = base + number, at
            at += lengths[item]
    return group.drop(columns="_group").assign(sequence_id=sequence, offset=offset)


def pack_documents(docs: DataFrame, id_column: str = "doc_id", path: str = VOCABULARY, capacity: int = CAPACITY,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece with its place: ``sequence_id``, ``offset``.

    Null and empty texts are one piece that holds the end id alone.  Repeated rows and null ids are documents of their
    own.  An empty table gives an empty result.  Groups are as many as pieces need, so a group stays the same size
    however large the table; each wastes part of one sequence at most beyond what the search leaves.
    """
    cut = cut_lineage(pieces(docs, id_column, path, capacity))
    groups = max(1, round(cut.count() / group_pieces))
    # Content decides the group, evenly for copies too: the place within the table takes part.
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(id_column, "piece", F.monotonically_increasing_id()),
                                            F.lit(groups)).cast("long"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("_group").applyInPandas(lambda group: pack_group(group, capacity), shape)
