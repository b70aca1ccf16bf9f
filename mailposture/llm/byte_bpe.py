"""Byte-level BPE encoding and decoding by rank files.

Pre-tokens are located without regular expressions.  Every code point becomes a symbol (its class, and the little that its right
neighbours tell), every symbol is a function from the state before it to the state after it, and since functions compose associatively
the states at all positions come out of a scan over arrays: functions are composed inside rows of a matrix, row by row in
parallel, the few rows are chained, and then all rows run from their known first states.  A token starts where the state table says so.

The slices are looked up in a cache; those not met yet are merged together (``merging``).  Byte offsets of tokens are kept, so decoding a
range of ids knows its place in the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailposture.llm.arrays import SliceCache
from mailposture.llm.blocks import flat, groups, pieces, ragged_take, tidy
from mailposture.llm.merging import PairTable, merge_all

LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, BLANK, GAP, SPACES = range(8)
IN_WORD, IN_NUMBER, IN_OTHER, IN_SPACES, AFTER_BLANK, ONE_LEFT, TWO_LEFT, CLOSED = range(8)
N_STATES = 8
#: Added to the symbol of a text's first code point: whatever came before, the state is CLOSED.
FIRST = 8

#: Entries of a worker's cache of slices; it starts anew when full.
CACHE_ENTRIES = 400_000


@lru_cache(1)
def class_table() -> np.ndarray:
    """Letter, number, other or white space for every code point, by Unicode property."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for prop, kind in (("L", LETTER), ("N", NUMBER), ("White_Space", SPACES)):
        for run in regex.finditer(rf"\p{{{prop}}}+", every):
            table[[ord(c) for c in run[0]]] = kind
    return table


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(state after, whether a token starts) for [symbol, state before]."""
    after = np.zeros((2 * FIRST, N_STATES), np.uint8)
    starts = np.ones((2 * FIRST, N_STATES), bool)
    plain = {LETTER: IN_WORD, NUMBER: IN_NUMBER, OTHER: IN_OTHER, QUOTE1: ONE_LEFT, QUOTE2: TWO_LEFT, BLANK: AFTER_BLANK, GAP: CLOSED, SPACES: IN_SPACES}
    for symbol, state in plain.items():
        after[symbol] = state
    joins = [(LETTER, s, IN_WORD) for s in (IN_WORD, AFTER_BLANK)] + [(NUMBER, s, IN_NUMBER) for s in (IN_NUMBER, AFTER_BLANK)]
    joins += [(k, s, IN_OTHER) for k in (OTHER, QUOTE1, QUOTE2) for s in (IN_OTHER, AFTER_BLANK)]
    joins += [(SPACES, IN_SPACES, IN_SPACES), (LETTER, TWO_LEFT, ONE_LEFT), (LETTER, ONE_LEFT, CLOSED)]
    for symbol, state, into in joins:
        after[symbol, state], starts[symbol, state] = into, False
    after[FIRST:], starts[FIRST:] = after[:FIRST, CLOSED, None], starts[:FIRST, CLOSED, None]
    return after, starts


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of every code point; ``first`` has the positions at which texts start."""
    n = len(points)
    kinds = class_table()[points]
    ends = np.zeros(n + 1, bool)
    ends[first[first <= n]] = True
    ends[n] = True
    last = ends[1:]
    next_kind = np.append(kinds[1:], SPACES)
    symbols = kinds.copy()
    before_text = (kinds == SPACES) & (next_kind != SPACES) & ~last
    symbols[before_text] = np.where(points[before_text] == 32, BLANK, GAP)
    quotes = np.flatnonzero((points == 39) & ~last)
    one = points[quotes + 1]
    short = np.isin(one, [ord(c) for c in "stmd"])
    two_at = np.minimum(quotes + 2, n - 1)
    two = np.where(last[quotes + 1] | (quotes + 2 >= n), 0, points[two_at])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    symbols[quotes[short]], symbols[quotes[long]] = QUOTE1, QUOTE2
    symbols[first[first < n]] += FIRST
    return symbols


def scan(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """Whether a token starts at each position."""
    n = len(symbols)
    if not n:
        return np.zeros(0, bool)
    after, starts = transitions()
    rows = -(-n // width)
    grid = np.full(rows * width, FIRST, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T).astype(np.intp) * N_STATES
    flat_after, flat_starts = after.ravel(), starts.ravel()
    function = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for column in grid:
        function = flat_after[column[:, None] + function]
    state, entry = CLOSED, np.empty(rows, np.uint8)
    for k, f in enumerate(function.tolist()):
        entry[k] = state
        state = f[state]
    out = np.empty((width, rows), bool)
    for k, column in enumerate(grid):
        at = column + entry
        out[k], entry = flat_starts[at], flat_after[at]
    return out.T.reshape(-1)[:n]


def token_starts(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pre-tokens start, and the number of pre-tokens of each text."""
    raw = np.frombuffer(data, np.uint8)
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((raw & 0xC0) != 0x80)  # byte offset of each code point
    filled = offsets[:-1][np.diff(offsets) > 0]
    at = place[scan(symbols_of(points, np.searchsorted(place, filled)))]
    return at, np.diff(np.searchsorted(at, offsets))


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.vocabulary = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        pairs = [(a, b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        left, right, merged = map(np.array, zip(*pairs))
        self.table = PairTable(left, right, merged, np.arange(size))
        self.byte_ids = np.array([ranks[bytes([k])] for k in range(256)])
        self.cache = SliceCache(self._learn, CACHE_ENTRIES)

    def _learn(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct slices: one id where the slice has a rank of its own, else the end of all merges."""
        whole = [self.ranks.get(s, -1) for s in slices]
        lengths = np.fromiter(map(len, slices), np.int64, len(slices))
        own = np.array(whole, np.int64)
        rest = own < 0
        counts = np.ones(len(slices), np.int64)
        ids = merged = np.zeros(0, np.int64)
        if rest.any():
            raw = np.frombuffer(b"".join([s for s, w in zip(slices, whole) if w < 0]), np.uint8)
            merged, counts[rest] = merge_all(self.byte_ids[raw], lengths[rest], self.table)
        ids = np.empty(int(counts.sum()), np.int64)
        at = np.repeat(rest, counts)
        ids[at], ids[~at] = merged, own[~rest]
        return ids, counts

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and their number per text."""
        at, counts = token_starts(data, offsets)
        ids, sizes = self.cache.values(data, at)
        bounds = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, end to end, and the number of bytes of each id."""
        lengths = self.lengths[ids]
        return ragged_take(self.vocabulary, self.places[ids], lengths), lengths


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


@tidy
def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = codec(path)
    for batch in batches:
        texts = batch.column(1)
        for first, last in groups(flat(texts)[1]):
            n = last - first
            parts: list[list[np.ndarray]] = [[] for _ in range(n)]
            for block in pieces(texts.slice(first, n)):
                ids, counts = coder.encode(block.data, block.offsets)
                ends = np.cumsum(counts)
                for row, a, b in zip(block.rows.tolist(), (ends - counts).tolist(), ends.tolist()):
                    parts[row].append(ids[a:b])
            ids = [np.concatenate(p).astype(np.int32) if p else np.zeros(0, np.int32) for p in parts]
            byte_ends = [np.cumsum(coder.lengths[i]) for i in ids]
            count = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, n),
                    pa.ListArray.from_arrays(pa.array(count), pa.array(np.concatenate(ids))),
                    pa.ListArray.from_arrays(pa.array(count), pa.array(np.concatenate(byte_ends).astype(np.int64))),
                ],
                ["id", "ids", "ends"],
            )


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, ends array<long>): token ids of every text, and the byte offset at which each token ends.

    Null and empty texts have no tokens.  Rows repeat as they do in the input; other columns are not looked at.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda b: _encoded(b, path), f"id {kind}, ids array<int>, ends array<bigint>")
    return out.withColumnRenamed("id", id_col)


@tidy
def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = codec(path)
    for batch in batches:
        lists = batch.column(1)
        bounds = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        for first, last in groups(bounds, 1 << 18):
            out = [coder.decode(np.asarray(i, np.int64))[0].tobytes() if i else b"" for i in lists.slice(first, last - first).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(out, pa.binary())], ["id", "decoded"])


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the bytes that the ids stand for; null counts as no ids."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda b: _decoded(b, path), f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


@tidy
def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = codec(path)
    for batch in batches:
        n = batch.num_rows
        count, tokens, texts = np.zeros(n, np.int64), [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
        for block in pieces(batch.column(1)):
            ids, counts = coder.encode(block.data, block.offsets)
            raw, lengths = coder.decode(ids)
            ends, sizes = np.cumsum(counts), np.append(0, np.cumsum(lengths))
            id_view, raw_view = memoryview(ids.astype("<u4").tobytes()), memoryview(raw.tobytes())
            for row, a, b, c, d in zip(block.rows.tolist(), (ends - counts).tolist(), ends.tolist(), sizes[ends - counts].tolist(), sizes[ends].tolist()):
                count[row] += b - a
                tokens[row].update(id_view[4 * a : 4 * b])
                texts[row].update(raw_view[c:d])
        columns = [batch.column(0), pa.array(count), pa.array([h.hexdigest() for h in tokens]), pa.array([h.hexdigest() for h in texts])]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes every text and keeps digests only.

    The ids are hashed as little-endian unsigned 32-bit integers.  Null counts as an empty text: no tokens, digests of nothing.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda b: _round_trip(b, path), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
