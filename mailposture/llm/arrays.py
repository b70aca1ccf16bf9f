"""Hash table over numpy arrays, and a cache of byte slices built on it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from mailposture.llm.blocks import ragged_take

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class IntTable:
    """Open addressing from unsigned 64-bit keys (other than the largest) to int32 values, probed for whole arrays together."""

    def __init__(self, room: int):
        bits = max(4, int(room * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, EMPTY, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not in the table."""
        slots, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            at = slots[rest]
            free = self.keys[at] == EMPTY
            self.values[at[free]] = rest[free]  # of several keys for one slot the last one wins
            won = free & (self.values[at] == rest)
            placed = rest[won]
            self.keys[slots[placed]] = keys[placed]
            self.values[slots[placed]] = values[placed]
            rest = rest[~won]
            slots[rest] = (slots[rest] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where it is not in the table."""
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            found = self.keys[slots[todo]]
            same = found == keys[todo]
            out[todo[same]] = self.values[slots[todo[same]]]
            todo = todo[~same & (found != EMPTY)]
        return out


class SliceCache:
    """What a function gives for byte slices, remembered by worker.

    ``learn`` gets distinct slices and returns integers end to end and their number per slice.  Slices are found by a rolling hash
    and compared byte by byte, so an equal hash of different slices cannot give a wrong value.
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], entries: int):
        self.learn, self.entries = learn, entries
        self.power = self.inverse = np.ones(1, np.uint64)
        self._restart()

    def _restart(self) -> None:
        self.table, self.n = IntTable(self.entries), 0
        self.text, self.text_at, self.text_n = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.value, self.value_at, self.value_n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _hashes(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(raw):
            base = np.uint64(0xD6E8FEB86659FD93)
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            self.power = np.cumprod(np.append(np.uint64(1), np.full(len(raw), base)))
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(len(raw), inverse)))
        sums = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)]))
        h = (sums[starts + lengths] - sums[starts]) * self.inverse[starts] + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) >> np.uint64(1)

    def values(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the slices that cut ``data`` at ``starts`` (the first is 0), end to end, and their number per slice."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = np.frombuffer(data, np.uint8)
        lengths = np.diff(np.append(starts, len(raw)))
        keys = self._hashes(raw, starts, lengths)
        entry = self.table.get(keys)
        if (missing := np.flatnonzero(entry < 0)).size:
            first = missing[np.unique(keys[missing], return_index=True)[1]]
            if self.n + len(first) > self.entries:
                self._restart()
                first = np.unique(keys, return_index=True)[1]
                self.entries = max(self.entries, len(first))
            self._add(data, starts[first], lengths[first], keys[first])
            entry = self.table.get(keys)
        wrong = self.text_n[entry] != lengths
        if not wrong.any():
            same = ragged_take(self.text, self.text_at[entry], lengths) == raw
            wrong = ~np.logical_and.reduceat(same, starts)
        if wrong.any():
            return self._apart(data, starts, lengths)
        counts = self.value_n[entry]
        return ragged_take(self.value, self.value_at[entry], counts), counts

    def _add(self, data: bytes, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> None:
        slices = [data[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]
        values, counts = self.learn(slices)
        self.table.put(keys, np.arange(self.n, self.n + len(slices), dtype=np.int32))
        self.n += len(slices)
        for name, flat, sizes in (("text", np.frombuffer(b"".join(slices), np.uint8), lengths), ("value", values, counts)):
            at = len(getattr(self, name)) + np.cumsum(sizes) - sizes
            for part, more in ((name, flat), (f"{name}_at", at), (f"{name}_n", sizes)):
                setattr(self, part, np.concatenate([getattr(self, part), more]))

    def _apart(self, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without the cache, for a block in which two different slices have one hash."""
        slices = [data[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]
        distinct = list(dict.fromkeys(slices))
        values, counts = self.learn(distinct)
        index = {s: k for k, s in enumerate(distinct)}
        entry = np.array([index[s] for s in slices])
        return ragged_take(values, (np.cumsum(counts) - counts)[entry], counts[entry]), counts[entry]
