"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q, at least ``MIN_WORDS`` and ``EXPONENT * q`` words long, that no neighbouring
word extends with the same period.  Each of its words occurs ``EXPONENT`` times or more in it, so a word that is rarer than that
within a segment of the text lies in no run there and splits the segment.  Pieces are counted and split again until none changes.

The lag scan then gives each position of a surviving segment its lag, the distance to the next equal block of B words, for
B = 1, 2, 4, ...  Inside a run of period q, with B/2 < q <= B, this lag is q at every position whose next block still lies in
the run, and outside it is not: a run is a stretch of equal lags.  Blocks are numbered by pairs of the numbers of their halves,
so no hash can mislead the scan, and a block that occurs once is not followed further.  The work is n log n for a text of n
words, however long its periods are.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import map_batches, texts_of

MIN_WORDS = 6
EXPONENT = 4
# Splitting only saves the scan work.  Segments that change even after so many rounds are scanned as they are, with the same result.
SPLIT_ROUNDS = 64
RESULTS = ("n_words", "runs", "collapsed")


class Runs(NamedTuple):
    """Runs by their first word, length and period; places count through all texts of a batch."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``values``, equal ones by place, and a number for each sorted value that only equal ones share."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    return order, np.cumsum(np.diff(ranked, prepend=ranked[:1]) != 0)


def split_rare(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments ``[start, end)`` that are left when words too rare to lie in a run have split the given ones."""
    vocabulary = int(words.max()) + 1 if len(words) else 1
    stable: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(SPLIT_ROUNDS):
        long = ends - starts >= MIN_WORDS
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        sizes = ends - starts
        segment = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(segment)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        order, number = _numbers(segment * vocabulary + words[place])
        rare = np.empty(len(place), bool)
        rare[order] = np.bincount(number)[number] < EXPONENT
        cut = np.zeros(len(starts), bool)
        cut[segment[rare]] = True
        stable.append((starts[~cut], ends[~cut]))
        left = ~rare & cut[segment]
        place, segment = place[left], segment[left]
        first = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(segment, prepend=-1) != 0))
        starts, ends = place[first], place[np.append(first[1:], len(place)) - 1] + 1 if len(place) else place
    stable.append((starts, ends))
    starts, ends = (np.concatenate(part) for part in zip(*stable))
    order = np.argsort(starts)
    return starts[order], ends[order]


def scan_lags(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Runs:
    """All runs inside the segments, which are ascending and apart."""
    found: list[Runs] = []
    if len(starts):
        # One row of words, with a word of its own behind every segment, so that no equal blocks reach over a border.
        sizes = ends - starts + 1
        home = np.cumsum(sizes) - sizes
        joined = np.empty(int(sizes.sum()), np.int64)
        shift = np.repeat(starts - home, sizes)
        inside = np.ones(len(joined), bool)
        inside[home + sizes - 1] = False
        joined[inside] = words[(np.arange(len(joined)) + shift)[inside]]
        joined[~inside] = words.max() + 1 + np.arange(len(starts))
        longest, block = int(sizes.max()) - 1, 1
        number, place = joined, np.arange(len(joined))
        # A period of up to a quarter of the segment is found at a block of less than twice that.
        while len(place) and 2 * block < max(longest, 3):
            order, rank = _numbers(number[place])
            sorted_place = place[order]
            same = np.flatnonzero(np.diff(rank) == 0)
            lag = np.zeros(len(joined), np.int64)
            lag[sorted_place[same]] = sorted_place[same + 1] - sorted_place[same]
            lag[(2 * lag <= block) | (lag > block)] = 0
            edge = np.flatnonzero(np.diff(lag, prepend=0, append=0))
            first, last = edge[:-1], edge[1:] - 1
            period = lag[first]
            length = last - first + block + period
            good = (period > 0) & (length >= np.maximum(MIN_WORDS, EXPONENT * period))
            found.append(Runs(first[good] + shift[first[good]], length[good], period[good]))
            # Blocks of twice the size, where both halves occur elsewhere too.
            repeated = np.zeros(len(rank), bool)
            repeated[same] = repeated[same + 1] = True
            number = np.full(len(joined) + block, -1, np.int64)
            number[sorted_place[repeated]] = rank[repeated]
            place = np.sort(sorted_place[repeated])
            place = place[number[place + block] >= 0]
            number[place] = number[place] * (len(joined) + 1) + number[place + block]
            block *= 2
    runs = [np.concatenate(part) for part in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((runs[2], runs[0]))
    return Runs(*(part[order] for part in runs))


def runs_of_texts(texts: list[list[bytes]]) -> tuple[Runs, np.ndarray]:
    """The runs of all texts and the place where each text starts, with the end of the last one."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    borders = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    words = np.fromiter((known[w] for text in texts for w in text), np.int64, int(borders[-1]))
    return scan_lags(words, *split_rare(words, borders[:-1], borders[1:])), borders


def _dropped(runs: Runs, n: int) -> np.ndarray:
    """Which words lie in a run, but not in its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs.start + runs.period, 1)
    np.add.at(depth, runs.start + runs.length, -1)
    return np.cumsum(depth)[:n] > 0


def find_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, ``n_words``, its ``runs`` and the ``collapsed`` text.

    Words are what ASCII white space separates.  ``runs`` holds ``struct(start, length, period)`` in order of start, then period;
    ``collapsed`` is the words joined by one space, without those that a run contains after its first period.  A null or blank
    text has no words, no runs and an empty collapsed text.  Texts are judged whole, whatever their length, and each on its own:
    repeated rows and null or repeated ids give a row each.  An empty table gives an empty result.  Other columns of ``docs`` do
    not matter; kept ones named like a result are left out in its favour.
    """
    keep = [c for c in keep if c not in RESULTS]
    fields = [docs.schema[c] for c in keep]

    def judge(batch: pa.RecordBatch) -> dict:
        texts = [t.split() for t in texts_of(batch.column(len(keep)))]
        runs, borders = runs_of_texts(texts)
        # Runs are ascending, so those of one text stand together.
        bounds = np.searchsorted(runs.start, borders)
        gone = _dropped(runs, int(borders[-1]))
        collapsed = []
        for words, at, first, last in zip(texts, borders, bounds, bounds[1:]):
            if last > first:
                stay = ~gone[at:at + len(words)]
                words = [w for w, s in zip(words, stay.tolist()) if s]
            collapsed.append(b" ".join(words))
        texts_before = borders[np.searchsorted(borders, runs.start, side="right") - 1]
        parts = [pa.array(part) for part in (runs.start - texts_before, runs.length, runs.period)]
        structs = pa.StructArray.from_arrays(parts, ["start", "length", "period"])
        made = {f.name: batch.column(i) for i, f in enumerate(fields)}
        return made | {
            "n_words": pa.array(np.diff(borders)), "runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs),
            "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
        }

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return map_batches(docs.select(*keep, F.col(text).alias("_text")), judge,
                       kept + "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
