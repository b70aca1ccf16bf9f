import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from mailposture.llm import queries, suffix_dedup

LENGTH = 50


def expected(ids, texts, length=LENGTH):
    """By a dictionary of all strings of ``length`` bytes."""
    first = {}
    bodies = [(t or "").encode() for t in texts]
    for i, b in zip(ids, bodies):
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            if i is not None and i < first.get(k, i + 1):
                first[k] = i
    out = []
    for i, b in zip(ids, bodies):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans, at = [], 0
        while (at := gone.find(1, at)) >= 0:
            stop = gone.find(0, at)
            stop = stop if stop >= 0 else len(gone)
            spans.append((at, stop))
            at = stop
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r[0], r[1], [tuple(s) for s in r[2]], bytes(r[3])) for r in frame.collect()), key=str)


def passages(rng):
    words = ["alpha", "beta ", "g ", "der", "é", " ", "\n"]
    base = ["".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(15)]
    texts = []
    for _ in range(100):
        a, b = rng.choice(base), rng.choice(base)
        texts.append(a[rng.randrange(len(a) + 1) :] + rng.choice(["x", "", b[: rng.randrange(len(b) + 1)]]) + "".join(rng.choice("ab") for _ in range(rng.randrange(60))))
    return texts + ["a" * 49, "a" * 50, "a" * 51, "a" * 500, "\0" * 60, "\0" * 70, "abc" * 40] * 2


@pytest.mark.parametrize("run_bytes", [300, 1 << 20])
def test_against_all_strings(docs, odd, run_bytes):
    rng = random.Random(run_bytes)
    texts = odd + passages(rng)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3], ids[20], ids[40], ids[41] = None, None, 7, 7  # without an id, and one id twice
    frame = docs(texts, ids).repartition(3)
    assert got(suffix_dedup.cut_repeats(frame, run_bytes=run_bytes)) == expected(ids, texts)


def test_carried_columns_and_empty_table(docs):
    frame = docs(["x" * 80, "x" * 80, None])
    cut = suffix_dedup.cut_repeats(frame, carry=("lang", "id", "bits"))
    assert cut.columns == ["doc_id", "n_bytes", "spans", "kept", "lang", "id", "bits"]
    assert sorted((r.doc_id, bytes(r.kept), r.lang, r.id, r.bits) for r in cut.collect()) == [(0, b"x" * 80, "en", "x", "y"), (1, b"", "en", "x", "y"), (2, b"", "en", "x", "y")]
    assert suffix_dedup.cut_repeats(frame.limit(0)).count() == 0


def test_long_text_over_several_segments(docs):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    texts = ["q" + long[524_200:524_400] + "q", long, long[700_000:900_000]]
    rows = {r.doc_id: r for r in suffix_dedup.cut_repeats(docs(texts)).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(524_200, 524_400)] and rows[0].spans == []
    assert bytes(rows[2].kept) == b""


def test_merge_of_sorted_runs():
    rng = random.Random(6)
    for count in (1, 2, 3, 5, 8):
        runs = []
        for _ in range(count):
            texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))).encode() for _ in range(rng.randrange(40))})
            shared = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(texts, texts[1:])]
            runs.append((texts, shared))
        out = [(new, runs[run][0][place]) for new, run, place in suffix_dedup.merge_runs(runs)]
        assert [s for _, s in out] == sorted(s for texts, _ in runs for s in texts)
        assert [s for new, s in out if new] == sorted({s for texts, _ in runs for s in texts})


def test_front_coding_round_trip():
    import numpy as np

    texts = sorted({b"abc", b"abcd", b"abd", b"\0\0", b"\0\0\0", b"b"})
    back, shared, least = suffix_dedup.front_decode(suffix_dedup.front_code(texts, np.arange(len(texts))))
    assert back == texts and shared == [0, 2, 0, 3, 2, 0] and least.tolist() == list(range(len(texts)))


def peak_of(job):
    """Bytes that a job holds at most, beyond what is held before."""
    tracemalloc.start()
    try:
        job()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_stretches_of_a_run_need_little_memory():
    raw = np.random.default_rng(1).integers(97, 123, 2 << 20).astype(np.uint8)
    offsets, active = np.arange(0, len(raw) + 1, 1 << 12), np.ones(len(raw) >> 12, bool)
    assert peak_of(lambda: suffix_dedup.stretches(raw, offsets, active, LENGTH)) < 12 * len(raw)


def test_stretches_hold_every_suffix_once():
    rng = random.Random(9)
    sizes = [0, 49, 50, 51, 30_000, 0, 500, 20_000, 3]
    raw = np.frombuffer("".join(rng.choice("ab") for _ in range(sum(sizes))).encode(), np.uint8)
    offsets, active = np.append(0, np.cumsum(sizes)), np.array([True] * 6 + [False] + [True] * 2)
    found = suffix_dedup.stretches(raw, offsets, active, LENGTH)
    starts = [(p, r) for a, b, r in zip(found.first.tolist(), found.last.tolist(), found.row.tolist()) for p in range(a, b + 1)]
    assert starts == [(p, r) for r, n in enumerate(sizes) if active[r] for p in range(offsets[r], offsets[r] + n - LENGTH + 1)]


@pytest.mark.parametrize("same_hash", [False, True])
def test_least_owner_needs_little_memory_and_survives_equal_hashes(monkeypatch, same_hash):
    rng = random.Random(8)
    base = "".join(rng.choice("abc") for _ in range(3000)).encode()
    texts = sorted({base[a : a + rng.randrange(50, 76)] for a in (rng.randrange(2900) for _ in range(4000))} | {b"\0" * 60, b"\0" * 59 + b"a"})
    least = np.array([rng.randrange(1000) for _ in texts])
    if same_hash:
        monkeypatch.setattr(suffix_dedup, "suffix_keys", lambda word, places, starts: np.zeros(len(starts), np.uint64))
    best, counts = suffix_dedup.least_owner(texts, least, LENGTH)
    first = {}
    suffixes = [(t[p : p + LENGTH], own) for t, own in zip(texts, least.tolist()) for p in range(len(t) - LENGTH + 1)]
    for k, own in suffixes:
        first[k] = min(own, first.get(k, own))
    assert counts.tolist() == [len(t) - LENGTH + 1 for t in texts] and best.tolist() == [first[k] for k, _ in suffixes]
    if not same_hash:
        assert peak_of(lambda: suffix_dedup.least_owner(texts, least, LENGTH)) < 100 * len(suffixes)


def test_rows_reach_runs_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from mailposture.session import BATCH_BYTES, small_batches

    small_batches(spark)
    frame = spark.range(0, 20_000, 1, 1).select("id", F.repeat(F.lit("x"), 2000).alias("text"))
    sizes = [r.n for r in frame.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").collect()]
    assert sum(sizes) > 40_000_000 and max(sizes) < 1.5 * BATCH_BYTES


def test_runs_are_filled_from_several_batches():
    import pyarrow as pa

    texts = ["a" * 30, None, "b" * 500, "", "c" * 10, "d" * 60, "e" * 30] * 5
    batches = [pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([t], pa.string())], ["c0", "c1"]) for k, t in enumerate(texts)]
    runs = list(suffix_dedup.filled_runs(iter([batches[0].slice(0, 0), *batches]), 100))
    sizes = [sum(map(len, r.column(1).to_pylist())) for r in runs]
    assert [x for r in runs for x in r.column(0).to_pylist()] == list(range(35)) and [x.decode() for r in runs for x in r.column(1).to_pylist()] == [t or "" for t in texts]
    assert all(n <= 100 or r.num_rows == 1 for n, r in zip(sizes, runs)) and len(runs) < 20
    assert list(suffix_dedup.filled_runs(iter([]), 100)) == []


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in expected([r.doc_id for r in table], [r.text for r in table])]
    result = queries.RUN["op8_suffix_dedup"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, result.collect())) == sorted(want)
