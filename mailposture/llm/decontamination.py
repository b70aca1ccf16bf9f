"""Benchmark items that stand in documents, also in pieces and in another order: greedy string tiling over shared seeds.

Seeds are all runs of ``min_match`` tokens of the items.  The benchmark goes to the tasks in blocks of a bounded number of seeds, one pass over the documents for each block, so
neither the number of items nor that of documents is limited and nothing is sent to all tasks without a bound.  A document is compared with the items whose seeds cover
enough of the item (tiles consist of seeds, so nothing is lost by that).  Tiling then marks the longest common run of unmarked tokens, again and again,
found by running Karp-Rabin hashes at falling lengths; the share of an item's tokens under tiles is its coverage.  Items too short for a seed are looked up whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mailposture.llm.blocks import tidy
from mailposture.session import store

#: Tokens of the shortest tile, and of the seeds.
MIN_MATCH = 5
#: Coverage from which an item counts as contained.
COVERAGE = 0.5
#: Seeds of a block of the benchmark, about.
BLOCK_SEEDS = 1 << 20

#: Scripts written without blanks: Thai to Lao, Myanmar, Khmer, kana, Han.  Each of their characters is a token.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_SINGLE = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)

_ASCII_WORD = re.compile(r"\w+", re.ASCII)
_WORD = re.compile(rf"[{_SINGLE}]|[^\W{_SINGLE}]+")
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681 % ((1 << 61) - 1)


def tokens(text: str | None) -> list[str]:
    """Words in lower case; single characters of scripts without blanks."""
    text = (text or "").lower()
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def token_bound(text: Column) -> Column:
    """As a column: at least the number of :func:`tokens`."""
    single = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in UNSPACED)
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")) + F.regexp_count(text, F.lit(f"[{single}]"))


def token_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` tokens."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return out ^ (out >> np.uint64(31))


class Tile(NamedTuple):
    item_at: int
    text_at: int
    length: int


def _rolling(words: list[int], length: int, marked: list[bool]) -> Iterator[tuple[int, int]]:
    """(hash, start) of all runs of ``length`` unmarked tokens, by running Karp-Rabin hashes."""
    drop = pow(_BASE, length, _PRIME)
    h = run = 0
    for k, w in enumerate(words):
        if marked[k]:
            h = run = 0
            continue
        h = (h * _BASE + w) % _PRIME
        run += 1
        if run > length:
            h = (h - words[k - length] * drop) % _PRIME
        if run >= length:
            yield h, k - length + 1


def tile(item: list[int], text: list[int], min_match: int = MIN_MATCH) -> list[Tile]:
    """Tiles of two token sequences: longest first, no token in two tiles, none shorter than ``min_match``.

    The search length starts at the length of the item and falls; where a longer match than twice the search length turns up, the search goes on at that length.
    Of equally long matches the first in the item, then in the text, is marked.
    """
    item_marked, text_marked, tiles = [False] * len(item), [False] * len(text), []
    length = max(min_match, min(len(item), len(text)) // 2)
    while True:
        places = defaultdict(list)
        for h, at in _rolling(item, length, item_marked):
            places[h].append(at)
        found, longest = [], 0
        if places:
            for h, at in _rolling(text, length, text_marked):
                for start in places.get(h, ()):
                    n = 0
                    while start + n < len(item) and at + n < len(text) and item[start + n] == text[at + n] and not item_marked[start + n] and not text_marked[at + n]:
                        n += 1
                    if n >= length:
                        found.append((-n, start, at))
                        longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        again = False
        for n, start, at in sorted(found):
            n = -n
            used = next((k for k in range(n) if item_marked[start + k] or text_marked[at + k]), n)
            if used < n:
                again = again or used >= length  # what a longer tile left of it is found anew
                continue
            for k in range(n):
                item_marked[start + k] = text_marked[at + k] = True
            tiles.append(Tile(start, at, n))
        if again:
            continue
        if length <= min_match:
            return tiles
        length = max(min_match, length // 2)


class Items(NamedTuple):
    """A block of the benchmark: ids, token hashes, and the places (item, position) of seeds in the order of their hashes.

    ``short`` holds items without a seed: for each number of tokens the hashes of whole items and the items with each.
    """

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    at: np.ndarray
    short: dict[int, dict[int, list[int]]]


def block_of(rows: list[tuple[object, str]], min_match: int, min_item: int) -> Items:
    words = [token_hashes(tokens(text)) for _, text in rows]
    runs = [run_hashes(w, min_match) for w in words]
    sizes = [len(r) for r in runs]
    seeds = np.concatenate([np.zeros(0, np.uint64), *runs])
    item = np.repeat(np.arange(len(rows)), sizes)
    at = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in sizes]]).astype(np.int64)
    order = np.argsort(seeds, kind="stable")
    short: dict[int, dict[int, list[int]]] = {}
    for k, w in enumerate(words):
        if max(1, min_item) <= len(w) < min_match:
            short.setdefault(len(w), {}).setdefault(int(run_hashes(w, len(w))[0]), []).append(k)
    return Items([i for i, _ in rows], words, seeds[order], item[order], at[order], short)


def whole_items(words: np.ndarray, block: Items) -> Iterator[tuple[int, int, int]]:
    """Like :func:`compare`, for items without a seed: all of their tokens stand in a row."""
    for length, items in block.short.items():
        runs = run_hashes(words, length)
        for at in np.flatnonzero(np.isin(runs, np.fromiter(items, np.uint64, len(items)))).tolist():
            yield from ((i, length, 1) for i in items[int(runs[at])] if np.array_equal(words[at : at + length], block.words[i]))


def compare(text: str | None, block: Items, min_match: int, coverage: float) -> Iterator[tuple[int, int, int]]:
    """(item number, covered tokens, tiles) of the items whose tiles cover enough of them."""
    words = token_hashes(tokens(text))
    if block.short:
        yield from dict.fromkeys(whole_items(words, block))
    runs = run_hashes(words, min_match)
    low = np.searchsorted(block.seeds, runs)
    hit = np.flatnonzero((low < len(block.seeds)) & (block.seeds[np.minimum(low, max(0, len(block.seeds) - 1))] == runs)) if len(block.seeds) else np.zeros(0, np.int64)
    if not len(hit):
        return
    distinct, first = np.unique(runs[hit], return_index=True)
    start, stop = low[hit][first], np.searchsorted(block.seeds, distinct, "right")
    place = np.concatenate([np.arange(a, b) for a, b in zip(start, stop)])
    per_item = defaultdict(set)
    for i, p in zip(block.item[place].tolist(), block.at[place].tolist()):
        per_item[i].update(range(p, p + min_match))
    for i in sorted(per_item):
        item = block.words[i]
        if len(per_item[i]) < coverage * len(item):
            continue
        near = hit[np.isin(runs[hit], run_hashes(item, min_match))]
        inside = np.zeros(len(words), bool)
        for k in range(min_match):
            inside[near + k] = True
        # tokens outside of seeds of this item cannot be in a tile; one stands for each gap of them, so that nothing joins over it
        keep = inside | np.append(False, inside[:-1])
        local = np.where(inside, words % np.uint64(_PRIME - 1) + np.uint64(1), np.uint64(0))[keep].tolist()
        tiles = tile((item % np.uint64(_PRIME - 1) + np.uint64(1)).tolist(), local, min_match)
        covered = sum(t.length for t in tiles)
        if covered >= coverage * len(item):
            yield i, covered, len(tiles)


@tidy
def _compared(batches: Iterator[pa.RecordBatch], block, min_match: int, coverage: float, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    items = block.value
    for batch in batches:
        where, item, covered, tiles = [], [], [], []
        for row, text in enumerate(batch.column(1)):
            for i, c, t in compare(text.as_py(), items, min_match, coverage):
                where.append(row)
                item.append(i)
                covered.append(c)
                tiles.append(t)
        size = [len(items.words[i]) for i in item]
        columns = [batch.column(0).take(pa.array(where, pa.int64())), pa.array([items.ids[i] for i in item], item_type)]
        columns += [pa.array(covered, pa.int64()), pa.array(size, pa.int64()), pa.array(tiles, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "item", "n_covered", "n_tokens", "n_tiles"])


def blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, min_match: int, min_item: int, block_seeds: int) -> Iterator[Broadcast]:
    """The benchmark in blocks of about ``block_seeds`` seeds, each sent to all tasks; items are dealt by a hash.  There is at least one block."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).dropna(subset=["text"])
    words = items.agg(F.sum(token_bound(F.col("text"))).alias("n")).first().n or 0
    count = max(1, -(-words // block_seeds))
    for k in range(count):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield spark.sparkContext.broadcast(block_of([(r.item, r.text) for r in part.collect()], min_match, min_item))


def contained(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_seeds: int = BLOCK_SEEDS, min_item: int = 1
) -> DataFrame:
    """(id, item, n_covered, n_tokens, n_tiles, coverage): items of ``benchmark`` that stand in rows of ``df`` to at least ``coverage``.

    Tokens are words in lower case, and the single characters of scripts without blanks.  Items of fewer than ``min_match`` tokens have no seed: they are contained where all
    of their tokens stand in a row, those of fewer than ``min_item`` nowhere.  Null and empty texts contain nothing.  Repeated rows and items give repeated results.  An item of
    more seeds than a block holds is not cut.  The results of a block, a few rows, are written before the next one is built, so one block is held at a time.
    """
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"id {kind}, item {item_kind.simpleString()}, n_covered bigint, n_tokens bigint, n_tiles bigint"
    arrow = to_arrow_type(item_kind)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for block in blocks(df.sparkSession, benchmark, item_col, item_text_col, min_match, min_item, block_seeds):
        found.append(store(rows.mapInArrow(lambda b, block=block: _compared(b, block, min_match, coverage, arrow), schema)))
        block.destroy()
    out = reduce(DataFrame.unionByName, found)
    return out.withColumn("coverage", F.col("n_covered") / F.col("n_tokens")).withColumnsRenamed({"id": id_col, "item": item_col})


@tidy
def _clean(batches: Iterator[pa.RecordBatch], block: Broadcast, at: int, min_match: int, coverage: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stay = [next(compare(text.as_py(), block.value, min_match, coverage), None) is None for text in batch.column(at)]
        yield batch.filter(pa.array(stay, pa.bool_()))


def clean(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_seeds: int = BLOCK_SEEDS, min_item: int = MIN_MATCH
) -> DataFrame:
    """Rows of ``df`` that contain no item of ``benchmark``, with all columns, filtered where they are read: one pass for each block.

    Shorter items than ``min_item`` tokens remove nothing: a phrase of a few words also stands in clean texts.  :func:`contained` names its documents.
    """
    at, out = df.columns.index(text_col), df
    for block in blocks(df.sparkSession, benchmark, item_col, item_text_col, min_match, min_item, block_seeds):
        out = out.mapInArrow(lambda b, block=block: _clean(b, block, at, min_match, coverage), df.schema)
    return out
