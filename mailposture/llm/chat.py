"""Conversations as training text: turns in a reversible template, assembled as columns of bytes, with the spans that carry loss.

A turn becomes ``<turn ROLE>``, a line end, its text, ``</turn>`` and a line end.  ``<turn`` and ``</turn`` start the control strings; inside of roles and
texts a backslash goes between ``<`` and what follows, before every backslash, and in roles before ``>``.  So no text can open or close a turn, and the
texts come back exactly.  A batch of turns is formatted with array operations alone: the length of every segment gives its offset, and headers, contents and
marks are scattered into one buffer, which is the Arrow column of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailposture.llm.blocks import flat, groups, tidy

#: Bytes of roles and texts that are assembled at a time; a conversation beyond it goes on in a further row.
PART_BYTES = 4 << 20

OPEN, MIDDLE, CLOSE = b"<turn ", b">\n", b"</turn>\n"
_CONTROL = (b"<turn", b"</turn")
_BACKSLASH = ord("\\")


def starts_of(raw: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` starts in ``raw``."""
    at = np.flatnonzero(raw[: max(0, len(raw) - len(mark) + 1)] == mark[0])
    for k, byte in enumerate(mark[1:], 1):
        at = at[raw[at + k] == byte]
    return at


def escaped(raw: np.ndarray, offsets: np.ndarray, role: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the strings (``raw`` cut at ``offsets``) with backslashes put in before the bytes that need one."""
    need = raw == _BACKSLASH
    if role:
        need |= raw == ord(">")
    for mark in _CONTROL:
        at = starts_of(raw, mark)
        # a mark that runs over the end of a string is none
        ends = offsets[np.searchsorted(offsets, at, "right")] if len(at) else at
        need[at[at + len(mark) <= ends] + 1] = True
    before = np.append(0, np.cumsum(need))
    out = np.empty(len(raw) + int(before[-1]), np.uint8)
    places = np.arange(len(raw)) + before[1:]
    out[places[need] - 1] = _BACKSLASH
    out[places] = raw
    return out, offsets + before[offsets]


def _filled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(column)
    return np.frombuffer(data, np.uint8), offsets


def _scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, offsets: np.ndarray) -> None:
    """Copy string k of ``source`` to ``at[k]``."""
    out[np.arange(len(source)) + np.repeat(at - offsets[:-1], np.diff(offsets))] = source


def assemble(roles: pa.Array, texts: pa.Array, loss: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Formatted bytes of turns, the offsets of the strings that start at the turns ``first``, and (start, stop, number by string) of the spans that
    carry loss, in code points of their string."""
    role, role_at = escaped(*_filled(roles), role=True)
    text, text_at = escaped(*_filled(texts), role=False)
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    sizes = len(OPEN) + n_role + len(MIDDLE) + n_text + len(CLOSE)
    ends = np.cumsum(sizes)
    turn_at = ends - sizes
    out = np.empty(int(ends[-1]), np.uint8)
    content = turn_at + len(OPEN) + n_role + len(MIDDLE)
    for mark, at in ((OPEN, turn_at), (MIDDLE, turn_at + len(OPEN) + n_role), (CLOSE, content + n_text)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, turn_at + len(OPEN), role, role_at)
    _scatter(out, content, text, text_at)
    points = np.append(0, np.cumsum((out & 0xC0) != 0x80))
    begin = np.repeat(turn_at[first], np.diff(np.append(first, len(sizes))))
    spans = [points[content[loss]] - points[begin[loss]], points[(content + n_text)[loss]] - points[begin[loss]]]
    return out, np.append(turn_at[first], len(out)), [*spans, np.add.reduceat(loss.astype(np.int64), first)]


def _rows(names: pa.Array, parts: np.ndarray, out: np.ndarray, offsets: np.ndarray, spans: list[np.ndarray]) -> pa.RecordBatch:
    text = pa.LargeStringArray.from_buffers(len(names), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    each = pa.StructArray.from_arrays([pa.array(spans[0], pa.int64()), pa.array(spans[1], pa.int64())], ["start", "stop"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(spans[2])), pa.int32()), each)
    text = text.cast(pa.string()) if len(out) < 1 << 31 else text
    return pa.RecordBatch.from_arrays([names, pa.array(parts, pa.int32()), text, lists], ["conv", "part", "formatted", "loss"])


@tidy
def _format(batches: Iterator[pa.RecordBatch], trained: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Turns (conv, role, text) that come in order; a conversation goes on in the next part where a piece of the input ends inside of it."""
    last, part = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, role_at = flat(batch.column(1))
        _, text_at = flat(batch.column(2))
        for a, b in groups(role_at + text_at, PART_BYTES):
            conv, roles, texts = (batch.column(k).slice(a, b - a) for k in range(3))
            values = conv.dictionary_encode("encode")
            codes = values.indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            names = conv.take(pa.array(first))
            loss = pc.is_in(roles, pa.array(trained, pa.string())).to_numpy(zero_copy_only=False)
            parts = np.zeros(len(first), np.int64)
            if last is not None and names[0] == last:
                parts[0] = part + 1
            last, part = names[len(first) - 1], int(parts[-1])
            yield _rows(names, parts, *assemble(roles, texts, loss, first))


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """(conv_col, part, formatted, loss array<start, stop>): the turns of every conversation in the template, and where the texts of the roles
    ``trained`` stand in ``formatted``, in code points, without the marks around them.

    Turns stand in the order of ``turn_col``, those without a number first, equal numbers by role and text; repeated rows are all kept.  Null roles and texts
    are empty; rows without a conversation form one of their own.  A text of any length is one turn.  Tasks get sorted rows and hold a bounded number of them: a conversation
    whose turns are cut by a batch goes on in parts 1, 2, ..., and its text is that of its parts end to end, so one conversation may hold any share of
    all rows.  Further columns of ``turns`` are not used.
    """
    shown = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), shown[0].alias("role"), shown[1].alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    kind = turns.schema[conv_col].dataType.simpleString()
    out = ordered.mapInArrow(lambda b: _format(b, trained), f"conv {kind}, part int, formatted string, loss array<struct<start: bigint, stop: bigint>>")
    return out.withColumnRenamed("conv", conv_col)


def unescape_mask(raw: np.ndarray) -> np.ndarray:
    """Which backslashes were put in: every second one of a run, from its first."""
    slash = raw == _BACKSLASH
    begin = np.flatnonzero(slash & ~np.append(False, slash[:-1]))
    if not len(begin):
        return slash
    place = np.arange(len(raw))
    run = begin[np.maximum(np.searchsorted(begin, place, "right") - 1, 0)]
    return slash & ((place - run) % 2 == 0)


def read_turns(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of turns, ends of their roles, ends of their texts, mask of put-in backslashes) of formatted bytes."""
    put_in = unescape_mask(raw)
    starts, stops = starts_of(raw, OPEN), starts_of(raw, CLOSE)
    closing = np.flatnonzero((raw == ord(">")) & ~np.append(False, put_in[:-1]))
    role_ends = closing[np.searchsorted(closing, starts + len(OPEN))] if len(starts) else starts
    return starts, role_ends, stops, put_in


def plain(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bytes of formatted text that are left as role, line end, text, line end of every turn, and the starts of the turns."""
    starts, role_ends, stops, put_in = read_turns(raw)
    keep = ~put_in
    keep[starts[:, None] + np.arange(len(OPEN))] = False
    keep[role_ends] = False
    keep[stops[:, None] + np.arange(len(CLOSE) - 1)] = False
    return keep, starts


@tidy
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose parts (conv, part, formatted, loss) come one after the other."""
    name, state = None, None

    def row() -> pa.RecordBatch:
        n, turns, chars, loss, size = state
        values = [pa.array([v]) for v in (n, turns.hexdigest(), chars, loss.hexdigest(), size)]
        return pa.RecordBatch.from_arrays([pa.array([name.as_py()], name.type), *values], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        data, offsets = flat(batch.column(2))
        for k in range(batch.num_rows):
            conv, part = batch.column(0)[k], batch.column(1)[k].as_py()
            if state is None or part == 0:
                if state is not None:
                    yield row()
                name, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            raw = np.frombuffer(data[offsets[k] : offsets[k + 1]], np.uint8)
            keep, starts = plain(raw)
            lead = (raw & 0xC0) != 0x80
            at = np.append(np.flatnonzero(lead), len(raw))
            spans = batch.column(3).slice(k, 1).flatten()
            edges = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edges, at[spans.field(0).to_numpy()], 1)
            np.add.at(edges, at[spans.field(1).to_numpy()], -1)
            scored = keep & (np.cumsum(edges)[:-1] > 0)
            state[0] += len(starts)
            state[1].update(raw[keep].tobytes())
            state[2] += int(np.count_nonzero(scored & lead))
            state[3].update(raw[scored].tobytes())
            state[4] += len(at) - 1
    if state is not None:
        yield row()


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted conversations, parsed from their text.

    ``turns_sha256`` is over role, line end, text, line end of every turn, ``loss_sha256`` over the unescaped texts in the loss spans.  ``formatted`` is the result of
    :func:`format_conversations`, the parts of a conversation in order in one partition, as it leaves them; a stored one is brought there by
    ``repartition(conv).sortWithinPartitions(conv, "part")``.  Parts go through one digest, which cannot be split; memory is that of a batch.
    """
    kind = formatted.schema[conv_col].dataType.simpleString()
    schema = f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    rows = formatted.select(F.col(conv_col).alias("conv"), "part", "formatted", "loss")
    return rows.mapInArrow(_digest, schema).withColumnRenamed("conv", conv_col)
