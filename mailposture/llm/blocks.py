"""Texts of Arrow batches as blocks of bounded size."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that the array code of this package works on at a time.
BLOCK_BYTES = 1 << 20

#: Rows that a mapper is given at a time.
ROWS = 1000

#: A blank between two ASCII letters: every pre-tokenizer of this package starts a token there.
_SAFE_CUT = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


class Block(NamedTuple):
    """Pieces of texts laid end to end: ``offsets`` has one more entry than there are pieces; ``rows`` is the row of each piece."""

    data: bytes
    offsets: np.ndarray
    rows: np.ndarray


def release() -> None:
    """Give freed memory back to the system.  Workers live through many tasks of different operators, and what one of them freed is of no use to
    the next if it stays with the allocator."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(mapper: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A mapper over Arrow batches that gets them in small slices and gives its memory back at the end."""

    @wraps(mapper)
    def run(batches: Iterator[pa.RecordBatch], *args, **how) -> Iterator[pa.RecordBatch]:
        yield from mapper((batch.slice(k, ROWS) for batch in batches for k in range(0, batch.num_rows, ROWS)), *args, **how)
        release()

    return run


def flat(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and offsets of the rows.  Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return memoryview(b""), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    view = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else memoryview(b"")
    return view, offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, after last) of up to ``limit`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def pieces(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks over whole texts.  A text above the limit is cut where a blank stands between letters, so that memory stays bounded."""
    data, offsets = flat(texts)
    for first, last in groups(offsets, limit):
        raw = bytes(data[offsets[first] : offsets[last]])
        if last - first > 1 or len(raw) <= limit:
            yield Block(raw, offsets[first : last + 1] - offsets[first], np.arange(first, last))
            continue
        at = 0
        while at < len(raw):
            cut = _SAFE_CUT.search(raw, at + limit)
            end = cut.start() if cut else len(raw)
            yield Block(raw[at:end], np.array([0, end - at]), np.array([first]))
            at = end


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[s : s + n]`` of every (s, n), end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
