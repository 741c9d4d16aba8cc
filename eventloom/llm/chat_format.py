"""Chat formatting in windows of a token budget.

Turns of a conversation are laid out one after the other in a template.  Prefix sums of their tokens choose spans that begin and
end with a turn: a window holds the retained system turn, the latest turns before it up to a limit of history, and as many new
turns as the budget allows.  Every turn is new in one window only; where it is repeated, as system turn or history, it is context
and its loss mask is off.  The mask of a window covers the texts of its new assistant turns.

A turn reads ``<|im_start|>role``, line feed, text, ``<|im_end|>``, line feed.  Texts are escaped so that they hold no control
string, and can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventloom.llm.word_bpe import encoder

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 4096
HISTORY = 1024
MARK_TOKENS = 2
# Turns are dealt to tasks in sections of so many turn numbers, so that a conversation of any length is spread.
SECTION_TURNS = 1024
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_ROLE_ESCAPES = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_LETTERS = {"\\": "\\", "n": "\n", "l": "<"}


class Turn(NamedTuple):
    role: str
    text: str
    tokens: int


class Window(NamedTuple):
    """Turns ``[context, new)`` repeat history, ``[new, end)`` are new; ``system`` says whether the system turn comes before."""

    system: bool
    context: int
    new: int
    end: int


def escape(text: str) -> str:
    """Every ``<`` before a bar gets a backslash more between the two, so no ``<|`` is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n<]", lambda m: _ROLE_ESCAPES[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ROLE_LETTERS[m[1]], role)


def plan_windows(tokens: list[int], system: int | None, first_new: int = 0, retained: int = 0, budget: int = BUDGET,
                 history: int = HISTORY) -> list[Window]:
    """Windows over turns of so many tokens, of which those before ``first_new`` were new in an earlier window.

    ``system`` is the place of the system turn among the turns; ``retained`` holds its tokens where it is not among them.  History
    gives way to the next new turn; a turn that does not fit beside the system turn makes a window over the budget.
    """
    before = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    windows, new = [], first_new
    while new < len(tokens):
        known = system is not None and system < new
        kept = tokens[system] if known else retained
        allowed = min(history, max(budget - kept - tokens[new], 0))
        context = int(np.searchsorted(before, before[new] - allowed))
        leads = known and system < context or retained > 0
        room = budget - kept if leads else budget
        end = max(int(np.searchsorted(before, before[context] + room, side="right")) - 1, new + 1)
        windows.append(Window(leads, context, new, end))
        new = end
    return windows


def lay_out(turns: list[Turn], is_new: list[bool]) -> tuple[str, list[dict]]:
    """The text of a window and its loss mask, spans of code points."""
    parts, mask, at = [], [], 0
    for turn, fresh in zip(turns, is_new):
        head, body = f"{START}{escape_role(turn.role)}\n", escape(turn.text)
        if fresh and turn.role == "assistant":
            mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn of a window, as they were before formatting."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _section_windows(turns: Iterator[tuple[Turn, bool]], budget: int, history: int) -> Iterator[tuple]:
    """``(text, tokens, n_turns, n_context, mask)`` of a section's windows; a turn with a flag is the system turn of before.

    At most ``SECTION_TURNS`` turns are held: after so many, those that may serve as history go on to the next lot.
    """
    held: list[Turn] = []
    first_new, retained = 0, None

    def flush() -> Iterator[tuple]:
        places = [i for i, t in enumerate(held) if t.role == "system"]
        system = places[0] if places and retained is None else None
        for w in plan_windows([t.tokens for t in held], system, first_new, retained.tokens if retained else 0, budget, history):
            lead = [retained or held[system]] if w.system else []
            shown = lead + held[w.context:w.end]
            text, mask = lay_out(shown, [False] * (len(lead) + w.new - w.context) + [True] * (w.end - w.new))
            yield text, sum(t.tokens for t in shown), len(shown), len(lead) + w.new - w.context, mask

    for turn, before in turns:
        if before:
            retained = turn
            continue
        held.append(turn)
        if len(held) - first_new == SECTION_TURNS:
            yield from flush()
            retained = retained or next((t for t in held if t.role == "system"), None)
            after = np.cumsum([t.tokens for t in reversed(held)])
            held = held[len(held) - int(np.searchsorted(after, history, side="right")):]
            first_new = len(held)
    yield from flush()


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", path: str = VOCABULARY,
                         budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``(conv_id, section, window, text, tokens, n_turns, n_context, mask)``: one row per window.

    Sections and windows are in order of the turns; the first ``n_context`` turns of a window repeat earlier ones.  The system turn
    is the first one with that role.  Null roles and texts count as empty; turns without a number come first; equal numbers go by
    role, then text, and repeated rows are turns of their own.  Rows without ``conv_id`` are one conversation.  Whole texts are
    laid out, however long.  An empty table gives no windows, and other columns do not matter.

    Conversations are dealt in sections of ``SECTION_TURNS`` turn numbers.  A later section keeps the system turn, but begins
    without history.  A task holds the turns of one section at a time.
    """
    section = F.coalesce(F.floor(F.col(turn) / SECTION_TURNS), F.lit(-1))
    rows = turns.select(F.col(conv_id).alias("conv_id"), section.cast("long").alias("section"), F.col(turn).alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = rows.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("section", "turn", "text")).alias("first"))
    systems = first.select(F.col("conv_id").alias("_conv"), "first.*").withColumnRenamed("section", "_section")
    # Only long conversations have sections after the one of their system turn.
    sections = rows.select("conv_id", "section").distinct()
    later = sections.join(systems, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("section") > F.col("_section")))
    again = later.select("conv_id", "section", "turn", F.lit("system").alias("role"), "text", F.lit(True).alias("before"))
    dealt = rows.withColumn("before", F.lit(False)).unionByName(again).repartition("conv_id", "section")
    ordered = dealt.sortWithinPartitions("conv_id", "section", F.col("before").desc(), "turn", "role", "text")
    kind = turns.schema[conv_id].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "section", "before", "role", "text")]
            said = [f"{role} {escape(text)}".encode() for role, text in zip(*columns[3:])]
            for row, ids in zip(zip(*columns), encoder(path).encode(said)):
                yield (*row, len(ids) // 4 + MARK_TOKENS)

    def lay_out_sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, number), members in groupby(counted(batches), key=lambda row: row[:2]):
            members = ((Turn(role, text, tokens), before) for _, _, before, role, text, tokens in members)
            for window, made in enumerate(_section_windows(members, budget, history)):
                out.append((conv, number, window, *made))
                if len(out) == 1000:
                    yield _batch(out, shape)
                    out = []
        yield _batch(out, shape)

    shape = pa.schema([("conv_id", _arrow(turns, conv_id)), ("section", pa.int64()), ("window", pa.int64()), ("text", pa.string()),
                       ("tokens", pa.int64()), ("n_turns", pa.int64()), ("n_context", pa.int64()),
                       ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return ordered.select("conv_id", "section", "before", "role", "text").mapInArrow(
        lay_out_sections, f"conv_id {kind}, section bigint, window bigint, text string, tokens bigint, n_turns bigint, "
                          "n_context bigint, mask array<struct<start: bigint, end: bigint>>")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)


def read_back(windows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from formatted windows alone.

    Turns are read from the template, context left out; the loss text is what the masks cover.  A digest takes the turns of a
    conversation in order, so its windows pass through one task, which holds no more than a batch of them.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "section", "window").select(
        "conv_id", "text", "n_context", "mask")
    shape = pa.schema([("conv_id", _arrow(windows, "conv_id")), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                       ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        out: list[tuple] = []
        for conv, members in groupby(rows, key=lambda row: row[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for _, text, n_context, mask in members:
                for role, said in read_turns(text)[n_context:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for span in mask:
                    target = unescape(text[span["start"]:span["end"]])
                    loss.update(target.encode())
                    loss_chars += len(target)
                chars += len(text)
            out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 1000:
                yield _batch(out, shape)
                out = []
        yield _batch(out, shape)

    return ordered.mapInArrow(digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                      "loss_sha256 string, formatted_chars bigint")
