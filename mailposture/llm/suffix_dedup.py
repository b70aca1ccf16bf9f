"""Repeated passages: removes bytes covered by a string of ``length`` bytes that also starts in a document with a smaller id.

All suffixes of a corpus, cut to ``length`` bytes, are too many to exchange one by one.  Neighbouring suffixes travel together: a suffix belongs to its anchor,
the q-gram in it with the least hash (leftmost on ties).  Equal suffixes have equal anchors, and the suffixes of one anchor are a stretch of text of at most
``2 * length - q`` bytes.  The steps:

1. Documents are packed into runs of bounded size, written once as a table bucketed by run, so that answers reach a run without moving texts.
2. Every run sends the hashes of its anchors to the partitions that own them and gets back one bit each: whether another document has that anchor.
   A stretch without such a bit has no suffix that occurs elsewhere.
3. Every run sorts its remaining distinct stretches and sends each partition its part of them, front-coded (length of the prefix shared with the one before, and the
   rest), with the smallest document id.  The partition merges the sorted runs in a loser tree over common prefix lengths: what a candidate is known to
   share with the last output is not compared again, and equal stretches of many runs fall together as they come out.
4. The suffixes of the distinct stretches of a partition are sorted by a hash and compared with their neighbours, equal ones get their smallest document id, and every run gets one bit for each suffix:
   whether it starts in a smaller document than any of this run's owners of the stretch.
5. Each run marks its suffixes, covers their bytes, and cuts.

A key held by any share of all documents costs one entry for each run that has it.  Nothing is decided by a hash alone: hashes only choose which stretches are
compared.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailposture.llm.blocks import groups, ragged_take, release, tidy
from mailposture.session import small_batches, store

Q = 24
RUN_BYTES = 2 << 20
#: Text of which anchors are computed at a time, so that its arrays stay in a core's cache; positions have to fit ``POSITION`` bits.
SEGMENT, POSITION = 1 << 14, 15
#: Bits of an anchor's hash that are exchanged, besides one for "in several documents of the run".
KEY_BITS = 47

_ODD = [np.uint64(int(x) | 1) for x in np.random.default_rng(20240607).integers(1 << 63, size=64, dtype=np.uint64)]
#: Factor that spreads anchors' hashes, which are small ones, over the whole range; ``mix`` has to follow.
SPREAD = _ODD[-1]


class Stretches(NamedTuple):
    """Maximal stretches of suffix starts with one anchor: positions of the first and last start, hash of the anchor, row of the document."""

    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    row: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number: a view without a copy."""
    return np.ndarray(max(0, len(raw) - 7), np.dtype("<u8"), raw, strides=(1,))


def word_places(length: int) -> list[int]:
    """Where words of eight bytes have to start in order to cover ``length`` bytes; the last two may overlap."""
    return [*range(0, length - 8, 8), length - 8]


def gram_hashes(raw: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at every position, for ``q`` of at least eight."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = mix(words_at(raw).astype(np.uint64))
    h = word[:n].copy()
    for k, odd in zip(word_places(q)[1:], _ODD):
        h += word[k : k + n] * odd
    return mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def stretches(raw: np.ndarray, offsets: np.ndarray, active: np.ndarray, length: int, q: int = Q) -> Stretches:
    """Stretches of all suffixes of at least ``length`` bytes of the documents that are ``active``."""
    parts: list[tuple[np.ndarray, ...]] = []
    ends, width = offsets[1:], length - q + 1
    low = np.uint64((1 << POSITION) - 1)
    step = np.zeros(len(raw) + 1, np.int8)
    long = active & (np.diff(offsets) >= length)
    step[offsets[:-1][long]] = 1
    step[ends[long] - length + 1] = -1
    starts = np.cumsum(step, dtype=np.int8).view(bool)  # where a suffix starts; between two rows there is a place where none does
    numbers = np.arange(SEGMENT + length, dtype=np.uint64)
    for at in range(0, len(raw), SEGMENT):
        window = raw[at : at + SEGMENT + length - 1]
        if len(window) < length:
            break
        packed = gram_hashes(window, q)
        n = len(window) - length + 1
        packed &= ~low
        packed |= numbers[: len(packed)]
        least = sliding_min(packed, width)[:n]
        edge = np.empty(n + 1, bool)  # whether the anchor changes before this place
        edge[0] = edge[n] = True
        np.not_equal(least[1:], least[:-1], out=edge[1:n])
        good = np.zeros(n + 2, bool)
        good[1:-1] = starts[at : at + n]
        begin = np.flatnonzero(good[1:-1] & (edge[:-1] | ~good[:-2]))
        stop = np.flatnonzero(good[1:-1] & (edge[1:] | ~good[2:]))
        parts.append((begin + at, stop + at, least[begin] & ~low))
    if not parts:
        empty = np.zeros(0, np.int64)
        return Stretches(empty, empty, empty.astype(np.uint64), empty)
    first, last, key = map(np.concatenate, zip(*parts))
    return Stretches(first, last, mix(key * SPREAD), np.searchsorted(ends, first, "right"))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Owning partition of an anchor: it grows with the anchor's hash, and only bits that are exchanged count."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Asked(NamedTuple):
    """The distinct anchors of a run in the order of their hashes, hence of partitions: hash, several documents, bounds of the partitions."""

    keys: np.ndarray
    several: np.ndarray
    bounds: np.ndarray
    #: Place of each stretch's anchor among the distinct ones.
    place: np.ndarray


def asked(found: Stretches, ids: np.ndarray, parts: int) -> Asked:
    keys = found.key >> np.uint64(64 - KEY_BITS)
    order = np.argsort(keys)
    k = keys[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    owner = ids[found.row[order]]
    several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start) if len(start) else np.zeros(0, bool)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    part = part_of(k[start] << np.uint64(64 - KEY_BITS), parts)
    return Asked(k[start], several, np.searchsorted(part, np.arange(parts + 1)), place)


def questions_of(run: int, ask: Asked) -> pa.RecordBatch:
    """What a run sends to each partition: six bytes an anchor, the last bit of which says whether several documents of the run have it."""
    both = (ask.keys << np.uint64(1)) | ask.several.astype(np.uint64)
    six = np.ascontiguousarray(both.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    filled = np.flatnonzero(np.diff(ask.bounds))
    blobs = [six[ask.bounds[p] : ask.bounds[p + 1]].tobytes() for p in filled]
    return pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(np.full(len(filled), run)), pa.array(blobs, pa.binary())], ["part", "run", "body"])


# --- runs ------------------------------------------------------------------------------------------------------------------------------------------------


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Run(NamedTuple):
    rows: pa.RecordBatch
    raw: np.ndarray
    data: bytes
    offsets: np.ndarray
    ids: np.ndarray
    active: np.ndarray


def unpack(packed: bytes) -> Run:
    with pa.ipc.open_stream(packed) as reader:
        rows = reader.read_next_batch()
    texts, ids = rows.column(1), rows.column(0)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = body.to_pybytes()[offsets[0] : offsets[-1]] if body is not None else b""
    return Run(rows, np.frombuffer(data, np.uint8), data, offsets - offsets[0], ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))


@tidy
def _pack_runs(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first_run = TaskContext.get().partitionId() << 32
    for serial, rows in enumerate(filled_runs(batches, run_bytes)):
        yield pa.RecordBatch.from_arrays([pa.array([first_run + serial]), pa.array([pack(rows)], pa.binary())], ["run", "packed"])


def filled_runs(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, ...) of batches of any size in runs of up to ``run_bytes`` of text; what does not fill a run waits for the next batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        held.append(pa.RecordBatch.from_arrays([batch.column(0), texts, *batch.columns[2:]], batch.schema.names))
        size += int(offsets_of(texts)[-1] - offsets_of(texts)[0])
        if size < run_bytes:
            continue
        rows = joined(held)
        offsets = offsets_of(rows.column(1))
        *filled, (first, last) = groups(offsets, run_bytes)
        for a, b in filled:
            yield joined([rows.slice(a, b - a)])
        held, size = [joined([rows.slice(first, last - first)])], int(offsets[last] - offsets[first])
    if held and (rows := joined(held)).num_rows:
        yield rows


def offsets_of(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Batches as one, whose buffers hold nothing else."""
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in batches]) for k in range(batches[0].num_columns)], batches[0].schema.names)


@tidy
def _ask(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            texts = unpack(packed.as_py())
            yield questions_of(run, asked(stretches(texts.raw, texts.offsets, texts.active, length), texts.ids, parts))


ASKED = "part int, run bigint, body binary"


def _shared(group: pa.Table) -> pa.Table:
    """For every run one bit for each anchor it asked for: whether several documents have it."""
    bodies = [np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, 6) for b in group.column("body")]
    sizes = [len(b) for b in bodies]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :6] = np.concatenate(bodies)
    both = wide.view("<u8").ravel()
    order = np.argsort(both >> np.uint64(1), kind="stable")
    keys = both[order] >> np.uint64(1)
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(start, len(keys)))
    hit = (count > 1) | (np.maximum.reduceat(both[order] & np.uint64(1), start) > 0)
    bits = np.empty(len(keys), bool)
    bits[order] = np.repeat(hit, count)
    ends = np.cumsum(sizes)
    blobs = [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
    return pa.table([group.column("run").combine_chunks(), group.column("part").combine_chunks(), pa.array(blobs, pa.binary())], ["run", "part", "bits"])


BITS = "run bigint, part int, bits binary"


# --- sorted runs -----------------------------------------------------------------------------------------------------------------------------------------


class Sorted(NamedTuple):
    """Distinct stretches of a run in the order of (partition, bytes)."""

    texts: list[bytes]
    bounds: np.ndarray
    #: Smallest document id among the run's owners.
    least: np.ndarray
    #: The run's stretches that are compared, and the place of each among the distinct ones.
    owners: Stretches
    place: np.ndarray


def sorted_stretches(texts: Run, answers: list[dict], length: int, parts: int) -> Sorted:
    found = stretches(texts.raw, texts.offsets, texts.active, length)
    ask = asked(found, texts.ids, parts)
    bits = np.zeros(len(ask.keys), bool)
    for a in answers or ():
        low, high = ask.bounds[a["part"]], ask.bounds[a["part"] + 1]
        bits[low:high] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=high - low)
    keep = bits[ask.place]
    owners = Stretches(*(x[keep] for x in found))
    data = texts.data
    slices = [data[a:b] for a, b in zip(owners.first.tolist(), (owners.last + length).tolist())]
    part = part_of(owners.key, parts)
    by_part: dict[bytes, int] = dict(zip(slices, part.tolist()))  # equal stretches have equal anchors
    distinct = sorted(by_part)
    distinct.sort(key=by_part.__getitem__)  # stable: by partition, then by bytes
    index = dict(zip(distinct, range(len(distinct))))
    place = np.fromiter(map(index.__getitem__, slices), np.int64, len(slices))
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, place, texts.ids[owners.row])
    bounds = np.searchsorted(np.fromiter(map(by_part.__getitem__, distinct), np.int64, len(distinct)), np.arange(parts + 1))
    return Sorted(distinct, bounds, least, owners, place)


def front_code(texts: list[bytes], least: np.ndarray) -> bytes:
    """Sorted strings as lengths of prefixes shared with the one before, lengths, and what is not shared; then the ids."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(lengths) - lengths
    width = int(lengths.max())
    grid = np.zeros((len(texts), width), np.uint8)
    grid[np.repeat(np.arange(len(texts)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    differ = grid[1:] != grid[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    shared = np.append(0, np.minimum(shared, np.minimum(lengths[1:], lengths[:-1])))
    rest = ragged_take(flat, starts + shared, lengths - shared)
    return b"".join([np.int32(len(texts)).tobytes(), shared.astype("<u2").tobytes(), lengths.astype("<u2").tobytes(), least.astype("<i8").tobytes(), rest.tobytes()])


def front_decode(body: bytes) -> tuple[list[bytes], list[int], np.ndarray]:
    """(strings, shared prefix lengths, ids)"""
    n = int(np.frombuffer(body, "<i4", 1)[0])
    shared = np.frombuffer(body, "<u2", n, 4).tolist()
    lengths = np.frombuffer(body, "<u2", n, 4 + 2 * n).tolist()
    least = np.frombuffer(body, "<i8", n, 4 + 4 * n)
    at, before, texts = 4 + 12 * n, b"", []
    for s, m in zip(shared, lengths):
        before = before[:s] + body[at : at + m - s]
        at += m - s
        texts.append(before)
    return texts, shared, least


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[bool, int, int]]:
    """(new, run, place) of all strings of sorted runs, in order; ``new`` is false for a string equal to the one before.

    A loser tree in which every candidate carries the length of the prefix it shares with the last string put out.  Of two candidates the one that shares more is the
    smaller; only where both share as much are bytes compared, from there on.  The next string of a run enters with the prefix length that
    the front coding has for it.
    """
    count = len(runs)
    size = 1
    while size < count:
        size *= 2
    heads: list[bytes | None] = [None] * size
    shares, places = [-1] * size, [0] * size  # a run at its end shares less than nothing, so it loses to all
    for k, (texts, _) in enumerate(runs):
        if texts:
            heads[k], shares[k] = texts[0], 0
    losers = [0] * size
    as_number = int.from_bytes

    def smaller(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two candidates that share as much; the loser then carries what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x == y:
            shares[b] = len(y)
            return a, b
        n = min(len(x), len(y))
        i = shares[a]
        near = min(n, i + 4)
        while i < near and x[i] == y[i]:
            i += 1
        if i == near < n:  # the bytes from here on as two numbers: their difference has as many leading zero bytes as are shared
            i = n - ((as_number(x[i:n]) ^ as_number(y[i:n])).bit_length() + 7) // 8
        if i == len(x) or (i < n and x[i] < y[i]):
            shares[b] = i
            return a, b
        shares[a] = i
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        one, two = build(2 * node), build(2 * node + 1)
        if shares[one] == shares[two] >= 0:
            one, two = smaller(one, two)
        elif shares[two] > shares[one]:
            one, two = two, one
        losers[node] = two
        return one

    top = build(1)
    last: bytes | None = None
    while (head := heads[top]) is not None:
        yield last is None or shares[top] < len(head) or len(head) != len(last), top, places[top]
        last = head
        texts, prefix = runs[top]
        p = places[top] = places[top] + 1
        if p < len(texts):
            heads[top], share = texts[p], prefix[p]
        else:
            heads[top], share = None, -1
        shares[top] = share
        node = (top + size) >> 1
        while node:
            other = losers[node]
            s = shares[other]
            if s > share:
                losers[node], top, share = top, other, s
            elif s == share and s >= 0:
                top, losers[node] = smaller(top, other)
            node >>= 1


@tidy
def _front_coded(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    from zstandard import ZstdCompressor

    squeeze = ZstdCompressor(3).compress
    for batch in batches:
        for run, packed, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            s = sorted_stretches(unpack(packed.as_py()), answers.as_py(), length, parts)
            filled = np.flatnonzero(np.diff(s.bounds))
            bodies = [squeeze(front_code(s.texts[a:b], s.least[a:b])) for a, b in zip(s.bounds[filled].tolist(), s.bounds[filled + 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(np.full(len(filled), run)), pa.array(bodies, pa.binary())], ["part", "run", "body"])


def least_owner(texts: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id for every suffix of ``length`` bytes of distinct strings, in text order, and the number of suffixes of each string.

    The suffixes are sorted by a hash, and neighbours of one hash are compared; equal ones take the least of their ids.  Where different ones
    have one hash, all are sorted by their bytes instead.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    counts = lengths - length + 1
    starts = np.arange(int(counts.sum())) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts), counts)
    out = np.empty(len(starts), np.int64)
    if not len(starts):
        return out, counts
    word, places = words_at(flat), word_places(length)
    keys = suffix_keys(word, places, starts)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])
    del keys
    here = np.flatnonzero(~new)
    one, two = starts[order[here]], starts[order[here - 1]]
    if any((word[one + k] != word[two + k]).any() for k in places):
        order = np.lexsort([word[starts + k] for k in places])
        new = np.zeros(len(order), bool)
        for k in places:
            sorted_words = word[starts[order] + k]
            new |= np.append(True, sorted_words[1:] != sorted_words[:-1])
    first = np.flatnonzero(new)
    ids = np.repeat(least, counts)[order]
    out[order] = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(order))))
    return out, counts


def suffix_keys(word: np.ndarray, places: list[int], starts: np.ndarray) -> np.ndarray:
    """Hash of the words at ``places`` from every start on."""
    keys = np.zeros(len(starts), np.uint64)
    for k, odd in zip(places, _ODD):
        keys += word[starts + k]
        mix(keys)
        keys *= odd
    return mix(keys)


def _merged(group: pa.Table, length: int) -> pa.Table:
    """For every run one bit for each suffix it sent: whether a document with a smaller id than all of the run's owners has it."""
    from zstandard import ZstdDecompressor

    expand = ZstdDecompressor().decompress
    runs = [front_decode(expand(b.as_buffer())) for b in group.column("body")]
    where = [np.empty(len(r[0]), np.int64) for r in runs]
    distinct: list[bytes] = []
    for new, run, place in merge_runs([r[:2] for r in runs]):
        if new:
            distinct.append(runs[run][0][place])
        where[run][place] = len(distinct) - 1
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    for (_, _, own), at in zip(runs, where):
        least[at] = np.minimum(least[at], own)
    best, counts = least_owner(distinct, least, length)
    begin = np.cumsum(counts) - counts
    blobs = [np.packbits(ragged_take(best, begin[at], counts[at]) < np.repeat(own, counts[at])).tobytes() for (_, _, own), at in zip(runs, where)]
    return pa.table([group.column("run").combine_chunks(), group.column("part").combine_chunks(), pa.array(blobs, pa.binary())], ["run", "part", "bits"])


# --- cutting ---------------------------------------------------------------------------------------------------------------------------------------------


def covered(texts: Run, answers: list[dict], verdicts: list[dict], length: int, parts: int) -> np.ndarray:
    """Whether each byte of the run is removed."""
    s = sorted_stretches(texts, answers, length, parts)
    counts = np.fromiter(map(len, s.texts), np.int64, len(s.texts)) - length + 1
    begin = np.cumsum(counts) - counts
    bits = np.zeros(int(counts.sum()), bool)
    for v in verdicts or ():
        low, high = s.bounds[v["part"]], s.bounds[v["part"] + 1]
        if high > low:
            a, b = begin[low], begin[high - 1] + counts[high - 1]
            bits[a:b] = np.unpackbits(np.frombuffer(v["bits"], np.uint8), count=b - a)
    n = counts[s.place]
    gone = ragged_take(bits, begin[s.place], n) | np.repeat(texts.ids[s.owners.row] > s.least[s.place], n)
    ends = np.cumsum(n)
    mark = np.zeros(len(texts.raw), bool)
    mark[(np.arange(len(gone)) + np.repeat(s.owners.first - (ends - n), n))[gone]] = True
    step = np.zeros(len(texts.raw) + 1, np.int8)
    at = np.flatnonzero(mark)
    if len(at):
        apart = at[1:] - at[:-1] > length
        step[at[np.append(True, apart)]] = 1
        step[at[np.append(apart, True)] + length] = -1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


@tidy
def _cut(batches: Iterator[pa.RecordBatch], length: int, parts: int, form: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed, answers, verdicts in zip(batch.column(0), batch.column(1), batch.column(2)):
            texts = unpack(packed.as_py())
            gone = covered(texts, answers.as_py(), verdicts.as_py(), length, parts)
            kept = texts.raw[~gone].tobytes()
            kept_at = np.append(0, np.cumsum(~gone))[texts.offsets]
            bodies = [kept[a:b] for a, b in zip(kept_at.tolist(), kept_at[1:].tolist())]
            row_start = np.zeros(len(gone), bool)
            row_start[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
            begins = np.flatnonzero(gone & (row_start | ~np.append(False, gone[:-1])))
            stops = np.flatnonzero(gone & np.append(row_start[1:] | ~gone[1:], True)) + 1
            bounds = np.searchsorted(begins, texts.offsets).astype(np.int32)
            base = texts.offsets[np.searchsorted(texts.offsets, begins, "right") - 1]
            spans = pa.StructArray.from_arrays([pa.array(begins - base), pa.array(stops - base)], ["start", "stop"])
            if form == "bytes":
                body = pa.array(bodies, pa.binary())
            else:
                body = pa.array([hashlib.sha256(b).hexdigest() if form == "sha256" else b.decode("utf-8", "ignore") for b in bodies], pa.string())
            columns = [texts.rows.column(0), pa.array(np.diff(texts.offsets)), pa.ListArray.from_arrays(pa.array(bounds), spans), body, *texts.rows.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, carry: tuple[str, ...] = (), form: str = "bytes", run_bytes: int = RUN_BYTES) -> DataFrame:
    """(id, n_bytes, spans array<struct<start, stop>>, kept, carried columns) for every row of ``df``.

    ``spans`` are the maximal runs of removed bytes, ``kept`` the remaining bytes end to end: with ``form`` "bytes" as they are,
    with "sha256" their digest in hex, with "text" as text without characters that were cut through.  A byte is removed if a string of
    ``length`` bytes that covers it also starts in a document with a smaller id; strings are judged on the input and never cross documents.

    Null counts as an empty text.  Rows without an id are neither cut nor a reason to cut.  Rows with one id don't cut each other.  Texts shorter than
    ``length`` stay whole.  An empty table gives no rows.  ``carry`` names further columns to take along; other columns are not looked at.
    """
    spark = df.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = [F.col(id_col).cast("bigint").alias("c0"), F.col(text_col).cast("string").alias("c1"), *[F.col(c).alias(f"c{k + 2}") for k, c in enumerate(carry)]]
    packed = df.select(*inner).mapInArrow(lambda b: _pack_runs(b, run_bytes), "run bigint, packed binary")
    name = f"text_runs_{uuid.uuid4().hex}"
    packed.repartition(parts, "run").write.bucketBy(parts, "run").sortBy("run").saveAsTable(name)
    runs = spark.table(name)
    ask = runs.mapInArrow(lambda b: _ask(b, length, parts), ASKED)
    shared = store(_by_run(ask.groupBy("part").applyInArrow(_tidied(_shared), BITS), "answers"))
    with_answers = runs.join(shared.hint("shuffle_hash"), "run", "left").select("run", "packed", "answers")
    sent = with_answers.mapInArrow(lambda b: _front_coded(b, length, parts), ASKED)
    verdicts = store(_by_run(sent.groupBy("part").applyInArrow(_tidied(_merged, length), BITS), "verdicts"))
    answered = runs.join(shared.join(verdicts, "run", "left").hint("shuffle_hash"), "run", "left").select("packed", "answers", "verdicts")
    kinds = [df.schema[c].dataType.simpleString() for c in carry]
    schema = ", ".join(["c0 bigint", "c1 bigint", "c2 array<struct<start: bigint, stop: bigint>>", f"c3 {'binary' if form == 'bytes' else 'string'}", *[f"c{k + 4} {t}" for k, t in enumerate(kinds)]])
    return answered.mapInArrow(lambda b: _cut(b, length, parts, form), schema).toDF(id_col, "n_bytes", "spans", "kept", *carry)


def _tidied(function, *args):
    """A function of groups that gives its memory back after each."""

    def run(group: pa.Table) -> pa.Table:
        out = function(group, *args)
        release()
        return out

    return run


def _by_run(bits: DataFrame, name: str) -> DataFrame:
    """The answers of all partitions to one run in one row: at most a bit for each byte of the run's text."""
    return bits.groupBy("run").agg(F.collect_list(F.struct("part", "bits")).alias(name))
