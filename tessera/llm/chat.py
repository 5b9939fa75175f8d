"""Chat formatting: budgeted windows of turn-aligned spans.

A conversation becomes one or more training texts ("windows") of at most
``budget`` tokens. Prefix sums of the turns' token counts say how far a window
reaches: it holds whole turns only. Every window starts with the conversation's
system turn, then repeats a limited stretch of the turns before it as history;
repeated turns are never targets. Each turn is new in exactly one window, and
the text of each new assistant turn is under the loss mask of that window.

Template: ``### role: text</turn>`` and a newline per turn. Inside texts (and
roles) the control strings ``### `` and ``</turn>`` and the backslash itself
get a backslash in front (in roles the colon too), which ``unescape`` undoes
exactly, whatever the text.

Scale: a conversation of more than ``block_turns`` rows is dealt in blocks of
about as many, by the rank of its turns; a window never spans two blocks. The
last rows before a block travel with it as its history, and the system turn to
all blocks. Only they are tokenised twice. Inside a task rows stream in order
and only the open window is held.

Rows: null texts and roles are empty; a null conv_id is a conversation of its
own; null turn numbers come first; turns with equal numbers are ordered by role
and text and stay in one block; repeated rows are turns like any other; very
long texts are tokenised whole; an empty table gives no windows; extra columns
are ignored, whatever their names. History gives way to a window's first new
turn, from the oldest. A turn that exceeds the budget together with the system
turn is a window's only new turn, without history, and is kept whole.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokenizing import encoder

OPEN, CLOSE = "### ", "</turn>"
_ESCAPE = re.compile(r"\\|### |</turn>")
_ESCAPE_ROLE = re.compile(r"\\|### |</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|### |</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|### |</turn>|:))*): ((?:[^\\<]|\\(?:\\|### |</turn>)|<(?!/turn>))*+)</turn>\n")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn and where its escaped text starts in it."""
    head = OPEN + _ESCAPE_ROLE.sub(lambda m: "\\" + m[0], role) + ": "
    return head + escape(text) + CLOSE + "\n", len(head)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@dataclass(frozen=True)
class WindowRules:
    budget: int = 2048
    history_turns: int = 2
    history_tokens: int = 512
    block_turns: int = 1024
    target_role: str = "assistant"


def windows_of(rows: Iterator[dict], rules: WindowRules) -> Iterator[dict]:
    """Windows of one block's rows in order: context rows (kind 0 system, 1 history), then own rows (kind 2)."""
    system = None
    before: deque = deque(maxlen=rules.history_turns)
    repeats: list[dict] = []
    new: list[dict] = []
    upto = [0]  # prefix sums of the tokens of the window's new turns
    room, n = 0, 0

    def open_window(first):
        nonlocal repeats, room
        taken, tokens = [], 0
        for row in reversed(before):
            tokens += row["n_tokens"]
            if tokens > rules.history_tokens:
                break
            taken.append(row)
        start = [system] * (system is not None)
        room = rules.budget - sum(r["n_tokens"] for r in start + taken)
        while taken and first["n_tokens"] > room:  # the oldest repeated turns make way
            room += taken.pop()["n_tokens"]
        repeats = start + taken[::-1]

    def window():
        text, masks, at = [], [], 0
        for k, row in enumerate(repeats + new):
            piece, head = format_turn(row["role"], row["text"])
            if k >= len(repeats) and row["role"] == rules.target_role:
                masks.append({"start": at + head, "end": at + len(piece) - len(CLOSE) - 1})
            text.append(piece)
            at += len(piece)
        return {"window": n, "n_repeated": len(repeats), "n_new": len(new), "formatted": "".join(text),
                "n_tokens": sum(r["n_tokens"] for r in repeats) + upto[-1], "loss_spans": masks}

    for row in rows:
        if row["kind"] == 0:
            system = row
            continue
        if row["kind"] == 1:
            before.append(row)
            continue
        if new and upto[-1] + row["n_tokens"] > room:
            yield window()
            n += 1
            for r in new:
                if r is not system:
                    before.append(r)
            new, upto = [], [0]
        if not new:
            open_window(row)
        new.append(row)
        upto.append(upto[-1] + row["n_tokens"])
        if row["first"] and row["role"] == "system" and system is None:
            system = row
    if new:
        yield window()


def _groups(batches, keys: list[str]):
    """(key values, iterator of row dicts) of rows that arrive sorted by ``keys``."""
    rows = (row for batch in batches for row in batch.to_pylist())
    held = next(rows, None)

    def group(key):
        nonlocal held
        while held is not None and [held[k] for k in keys] == key:
            row, held = held, None
            yield row
            held = next(rows, None)

    while held is not None:
        key = [held[k] for k in keys]
        own = group(key)
        yield key, own
        for _ in own:  # whatever the caller left
            pass


# Rows of a table that every task may get; with more of them the table is joined by a shuffle.
BROADCAST_ROWS = 50_000


def places_of(turns: DataFrame, block_turns: int) -> DataFrame:
    """(conv_id, coarse, block, last) of the conversations with more than ``block_turns`` rows.

    ``coarse`` stretches of turn numbers are put into blocks by the number of
    rows before them; ``last`` is the conversation's last block.
    """
    n = turns.groupBy("conv_id", "coarse").agg(F.count("*").alias("n"))
    conv = Window.partitionBy("conv_id")
    before = F.sum("n").over(conv.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("rows", F.sum("n").over(conv))
    n = n.filter(F.col("rows") > block_turns)
    block = F.dense_rank().over(conv.orderBy(F.floor(F.col("start") / block_turns))) - 1
    n = n.withColumn("block", block.cast("bigint")).withColumn("last", F.max("block").over(conv))
    return C.written(n.select(F.col("conv_id").alias("long_id"), F.col("coarse").alias("at"), "block", "last"), "places")


def format_windows(turns: DataFrame, tokenizer: str, rules: WindowRules = WindowRules()) -> DataFrame:
    """(conv_id, block, window, n_repeated, n_new, n_tokens, formatted, loss_spans) of all conversations."""

    def count(batches):
        for batch in C.slices(batches, "text"):
            roles, texts = (batch.column(c).to_pylist() for c in ("role", "text"))
            formatted = pa.array([format_turn(r, t)[0] for r, t in zip(roles, texts)], pa.string())
            _, bounds = encoder(tokenizer).encode(formatted)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(bounds))], names=[*batch.schema.names, "n_tokens"])

    turn = F.col("turn").cast("bigint")
    coarse = F.coalesce(F.floor(turn / rules.block_turns), F.lit(-(1 << 60))).cast("bigint")
    raw = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn"),
                       F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                       coarse.alias("coarse"))
    places = places_of(raw, rules.block_turns)
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    placed = raw.join(places, F.col("conv_id").eqNullSafe(F.col("long_id")) & (F.col("coarse") == F.col("at")), "left")
    columns = ["conv_id", "turn", "role", "text"]
    own = placed.select(*columns, F.coalesce("block", F.lit(0)).cast("bigint").alias("block"), F.lit(2).alias("kind"))
    # What later blocks are told: the rows before them, and the system turn that opens the conversation.
    long = placed.filter("last > 0")
    latest = Window.partitionBy("conv_id", "block").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    tails = long.withColumn("nth", F.row_number().over(latest)).filter(F.col("nth") <= rules.history_turns)
    tails = tails.withColumn("to", F.explode(F.sequence(F.col("block") + 1, F.col("block") + max(1, rules.history_turns))))
    tails = tails.filter("to <= last").select(*columns, F.col("to").alias("block"), F.lit(1).alias("kind"))
    first = long.filter("block = 0").groupBy("conv_id").agg(
        F.min(F.struct("turn", "role", "text")).alias("s"), F.max("last").alias("last")).filter("s.role = 'system'")
    system = first.select("conv_id", "s.turn", "s.role", "s.text", F.explode(F.sequence(F.lit(1).cast("bigint"), "last")).alias("block"),
                          F.lit(0).alias("kind"))
    schema = "conv_id bigint, turn bigint, role string, text string, block bigint, kind int, n_tokens bigint"
    counted = own.unionByName(tails).unionByName(system).mapInArrow(count, schema)
    dealt = (counted.repartition(C.partitions(turns.sparkSession), "conv_id", "block")
             .sortWithinPartitions("conv_id", "block", "kind", "turn", "role", "text"))

    def make(batches):
        def out():
            for (conv_id, block_id), group in _groups(batches, ["conv_id", "block"]):
                def marked():
                    seen = False
                    for row in group:
                        # The first own row of a block without context rows opens the conversation.
                        yield row | {"first": not seen}
                        seen = True

                for w in windows_of(marked(), rules):
                    yield {"conv_id": conv_id, "block": block_id} | w

        held, size = [], 0
        for row in out():
            held.append(row)
            size += len(row["formatted"])
            if size > C.SLICE_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return dealt.mapInArrow(make, SCHEMA)


SCHEMA = ("conv_id bigint, block bigint, window int, n_repeated int, n_new int, n_tokens bigint, formatted string, "
          "loss_spans array<struct<start:int,end:int>>")
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("n_repeated", pa.int32()),
    ("n_new", pa.int32()), ("n_tokens", pa.int64()), ("formatted", pa.string()),
    ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, parsed from the formatted texts: digests of turns and targets.

    A digest runs over a conversation from its start, so a conversation's
    windows pass through one task, one window at a time.
    """
    import hashlib

    def read(batches):
        held = []
        for (conv_id,), group in _groups(batches, ["conv_id"]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = n_windows = 0
            for w in group:
                formatted = w["formatted"]
                n_windows += 1
                chars += len(formatted)
                for role, text in parse_turns(formatted)[w["n_repeated"]:]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n_turns += 1
                for span in w["loss_spans"]:
                    target = unescape(formatted[span["start"] : span["end"]])
                    loss.update(target.encode())
                    loss_chars += len(target)
            held.append({"conv_id": conv_id, "n_turns": n_turns, "turns_sha256": turns.hexdigest(),
                         "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars,
                         "n_windows": n_windows})
            if len(held) == 2000:
                yield pa.RecordBatch.from_pylist(held, schema=out)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=out)

    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                     ("n_windows", pa.int64())])
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint, n_windows bigint")
    ordered = (windows.repartition(C.partitions(windows.sparkSession), "conv_id")
               .sortWithinPartitions("conv_id", "block", "window"))
    return ordered.mapInArrow(read, schema)
