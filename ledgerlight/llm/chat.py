r"""Chat formatting by token-level assembly.

A turn is the reserved id of its role's opening, the ids of its text and the reserved id of the
end.  Roles without an opening of their own use the general one, followed by the role's name and a
line break.  Text is escaped first: a backslash doubles, and a backslash goes before ``###`` and
``</turn>``, so that the formatted string holds control strings only where the template put them;
reading undoes it.  Segments are encoded separately as plain text and reserved ids spliced
between them, so no text can merge into, or imitate, a control id.

The loss mask covers the text segments of the assistant.  It is kept as ranges, whose places in the
conversation come from prefix sums of the segments' lengths; they never touch, as control ids lie
between them.

Turns are ordered by number (null first), then role and text; every row is a turn, repeated ones too.
Null text and null roles are empty, null ids name a conversation of their own, and other columns are
not read.  An empty table gives none.

Turns are dealt into ranges of (conversation, turn, role, text), so a conversation of any size is
spread over tasks: each range numbers and encodes its own, and what comes before it in its first
conversation follows from the totals of the ranges before, one row each.  Only the digests of a
conversation need its turns one after another; they are decoded before they are brought together,
and then only hashed, turn by turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.llm.common import stored, text_of
from ledgerlight.llm.encoding import Encoder

#: Control strings of the template by role, the opening of other roles, and the end of a turn.
OPENINGS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER, END, BREAK = "### Role: ", "</turn>", "\n"
LEARNED = "assistant"
#: The first id behind the vocabulary; control strings are numbered from there.
RESERVED = 50_257
CONTROLS = [*OPENINGS.values(), OTHER, END]
CONTROL_IDS = {text: RESERVED + n for n, text in enumerate(CONTROLS)}
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    r"""Put a backslash before every backslash and control string."""
    return _CONTROL.sub(lambda found: "\\" + found[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda found: found[1], text)


def segments(role: str, text: str) -> list[tuple[str, bool]]:
    """A turn as (string, whether a control string)."""
    if role in OPENINGS:
        return [(OPENINGS[role], True), (escape(text), False), (END, True)]
    return [(OTHER, True), (escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + BREAK + escape(text), False), (END, True)]


def format_turns(
    rows: DataFrame, tokenizer: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per turn: its ids, its place in the conversation, the range under the loss mask.

    conv_id, position (0, 1, ...), ids, first_id (place of its first id in the conversation),
    loss_start and loss_end (places of the learned ids; equal where there are none), formatted.
    """
    encoder = Encoder(tokenizer, plain=True)
    order = ["conv_id", "turn", "role", "text"]
    turns = rows.select(
        F.col(f"`{conversation}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        text_of(role).alias("role"), text_of(text_column).alias("text"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, number, position, reached = TaskContext.get().partitionId(), object(), -1, 0, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for conv, name, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if conv != last:
                    last, number, position, reached = conv, number + 1, 0, 0
                ids, parts = [], segments(name, text)
                for piece, control in parts:
                    ids += [CONTROL_IDS[piece]] if control else encoder.encode(piece).tolist()
                end = reached + len(ids) - 1 if name == LEARNED else reached + 1
                row = (part, number, position, np.array(ids, np.int32), reached, reached + 1, end, "".join(p for p, _ in parts))
                for column, value in zip(out, row):
                    column.append(value)
                position, reached = position + 1, reached + len(ids)
            kinds = [*[pa.int64()] * 3, pa.list_(pa.int32()), *[pa.int64()] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
                ["conv_id", "part", "number", "position", "ids", "first_id", "loss_start", "loss_end", "formatted"],
            )

    placed = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        place, "conv_id long, part long, number long, position long, ids array<int>, first_id long, "
        "loss_start long, loss_end long, formatted string",
    ))
    end = F.struct("number", "position", (F.col("first_id") + F.size("ids")).alias("ids"), "conv_id")
    totals = placed.groupBy("part").agg(
        F.max(end).alias("last"), F.min(F.struct("number", "position", "conv_id"))["conv_id"].alias("first")
    ).collect()  # one row per range
    before, running = {}, (object(), 0, 0)
    for row in sorted(totals, key=lambda r: r["part"]):
        last, goes_on = row["last"], row["first"] == running[0]
        if goes_on:
            before[row["part"]] = running[1:]
        carried = running[1:] if goes_on and last["number"] == 0 else (0, 0)
        running = (last["conv_id"], last["position"] + 1 + carried[0], last["ids"] + carried[1])
    if before:
        for names, n in ((["position"], 0), (["first_id", "loss_start", "loss_end"], 1)):
            added = F.create_map(*[F.lit(x) for part, carry in before.items() for x in (part, carry[n])])
            more = F.when(F.col("number") == 0, F.coalesce(added[F.col("part")], F.lit(0))).otherwise(F.lit(0))
            placed = placed.withColumns({name: (F.col(name) + more).cast("long") for name in names})
    return placed.drop("part", "number")


def read_turn(ids: np.ndarray, encoder: Encoder) -> tuple[str, str]:
    """Role and text of a formatted turn, from its ids alone."""
    opening, body, end = CONTROLS[ids[0] - RESERVED], encoder.decode(ids[1:-1].tolist()), CONTROLS[ids[-1] - RESERVED]
    if end != END:
        raise ValueError("a turn does not end with the end mark")
    for role, text in OPENINGS.items():
        if text == opening:
            return role, unescape(body)
    role, _, text = body.partition(BREAK)
    role = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))
    return role, unescape(text)


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """What the formatted turns say, read back from their ids and masks: one row per conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.  ``formatted`` is
    as ``format_turns`` gives it, in any order.
    """
    encoder = Encoder(tokenizer, plain=True)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, learned = [], []
            for ids, first, start, end in zip(batch.column(2), *(batch.column(i).to_pylist() for i in (3, 4, 5))):
                ids = ids.values.to_numpy()
                role, text = read_turn(ids, encoder)
                said.append(f"{role}\n{text}\n")
                learned.append(unescape(encoder.decode(ids[start - first:end - first].tolist())) if end > start else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(learned, pa.string()), batch.column(6)],
                ["conv_id", "position", "said", "learned", "size"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None

        def row():
            conv, turns, said, chars, learned, size = current
            return conv, turns, said.hexdigest(), chars, learned.hexdigest(), size

        for batch in batches:
            out = []
            for conv, said, learned, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if current is None or current[0] != conv:
                    if current is not None:
                        out.append(row())
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                current[1] += 1
                current[2].update(said.encode("utf-8", "surrogatepass"))
                current[3] += len(learned)
                current[4].update(learned.encode("utf-8", "surrogatepass"))
                current[5] += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=_schema())
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(row())], schema=_schema())

    def _schema():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.schema(list(zip(names, kinds)))

    columns: list[str | Column] = ["conv_id", "position", "ids", "first_id", "loss_start", "loss_end"]
    turns = formatted.select(*columns, F.length("formatted").cast("long").alias("size")).mapInArrow(
        read, "conv_id long, position long, said string, learned string, size long"
    )
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(
        add, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
