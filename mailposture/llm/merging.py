"""Pair merging of many short symbol sequences at once, in numpy.

All sequences lie end to end in one array.  In every round each sequence applies its own lowest-rank pair, at all places where
that pair stands, so the number of rounds is that of the longest sequence, not of all of them.
"""

from __future__ import annotations

import heapq

import numpy as np

from mailposture.llm.arrays import IntTable

NONE = np.iinfo(np.int64).max

#: Sequences above this length are merged one by one over a heap: they would keep all others' rounds going.
LONG = 256


class PairTable:
    """Which symbol a pair of symbols merges into, and its rank; lower ranks merge first."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank_of: np.ndarray):
        self.rank_of = np.append(rank_of.astype(np.int64), NONE)  # the last stands for "no merge"
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.table = IntTable(len(keys))
        self.table.put(keys, merged.astype(np.int32))
        self.scalar = dict(zip(keys.tolist(), merged.tolist()))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged symbol of each pair, -1 where there is none."""
        return self.table.get((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))


def merge_one(symbols: list[int], table: PairTable) -> list[int]:
    """One sequence: lowest rank first, leftmost on ties, over a heap."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (m := table.scalar.get((symbols[i] << 32) | symbols[j])) is not None:
            heapq.heappush(heap, (int(table.rank_of[m]), i, j, symbols[i], symbols[j], m))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, a, b, m = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or after[i] != j or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], alive[j], after[i] = m, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [s for s, live in zip(symbols, alive) if live]


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end.  Returns the surviving symbols end to end and their number per sequence.

    A round is undone for a sequence, which then goes over the heap, where simultaneous application could differ from one merge after
    the other: when a merge creates a pair of equal or lower rank.
    """
    n = len(lengths)
    starts = np.cumsum(lengths) - lengths
    done: dict[int, np.ndarray] = {}
    alone = lengths > LONG
    for k in np.flatnonzero(alone):
        done[k] = np.array(merge_one(symbols[starts[k] : starts[k] + lengths[k]].tolist(), table), np.int64)
    out_seq, out_sym = [], []
    keep = np.repeat(~alone, lengths)
    sym, seq = symbols.astype(np.int64)[keep], np.repeat(np.arange(n), lengths)[keep]
    merged = np.full(len(sym), -1, np.int32)
    pair = np.flatnonzero(seq[1:] == seq[:-1])
    merged[pair] = table.lookup(sym[pair], sym[pair + 1])
    while len(sym):
        first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        size = np.diff(np.append(first, len(seq)))
        rank = table.rank_of[merged]
        low = np.repeat(np.minimum.reduceat(rank, first), size)
        over = low == NONE
        if over.any():
            out_seq.append(seq[over])
            out_sym.append(sym[over])
            sym, seq, merged, rank, low = sym[~over], seq[~over], merged[~over], rank[~over], low[~over]
            if not len(sym):
                break
        hit = rank == low
        at = np.flatnonzero(hit)
        new_run = np.append(True, np.diff(at) != 1)  # of hits side by side every other one merges
        order = np.arange(len(at))
        at = at[(order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0]
        gone = np.zeros(len(sym), bool)
        gone[at + 1] = True
        beside = at[:-1][(np.diff(at) == 2) & (seq[at[:-1]] == seq[at[1:]])]  # for a moment such a merge stands before a symbol that merges next
        unsure = seq[beside[table.rank_of[table.lookup(merged[beside], sym[beside + 2])] <= low[beside]]]
        sym[at] = merged[at]
        changed = np.zeros(len(sym), bool)
        changed[at] = True
        stay = ~gone
        sym, seq, merged, low, changed = sym[stay], seq[stay], merged[stay], low[stay], changed[stay]
        changed[:-1] |= changed[1:]  # a merge changes the pair it begins and the pair that ends in it
        inside = np.append(seq[1:] == seq[:-1], False)
        merged[changed & ~inside] = -1
        spot = np.flatnonzero(changed & inside)
        merged[spot] = table.lookup(sym[spot], sym[spot + 1])
        unsure = np.append(unsure, seq[spot[table.rank_of[merged[spot]] <= low[spot]]])
        if len(unsure):
            unsure = np.unique(unsure)
            for k in unsure:
                done[k] = np.array(merge_one(symbols[starts[k] : starts[k] + lengths[k]].tolist(), table), np.int64)
            rest = ~np.isin(seq, unsure)
            sym, seq, merged = sym[rest], seq[rest], merged[rest]
    for k, got in done.items():
        out_seq.append(np.full(len(got), k))
        out_sym.append(got)
    if not out_seq:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    seq, sym = np.concatenate(out_seq), np.concatenate(out_sym)
    order = np.argsort(seq, kind="stable")
    return sym[order], np.bincount(seq, minlength=n)
