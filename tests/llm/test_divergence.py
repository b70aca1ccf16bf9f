import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from mailposture.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def expected(rows, least, top):
    """Brute force over (lang, source, text)."""
    rows = [(a or "", b or "", t or "") for a, b, t in rows]
    docs, counts = Counter(), Counter()
    for lang, source, text in rows:
        found = terms(text)
        docs.update((lang, t) for t in set(found))
        counts.update((lang, source, t) for t in found)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        sources = sorted({r[1] for r in rows if r[0] == lang})

        def shares(n_of):
            total = sum(map(n_of, kept))
            return {t: 1 + 10**9 * (n_of(t) + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(lambda t, s=s: counts[lang, s, t]) for s in sources}
        q = shares(lambda t: sum(counts[lang, s, t] for s in sources))
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def check(spark, monkeypatch, rows, least, slice_rows):
    monkeypatch.setattr(divergence, "MIN_DOCS", least)
    monkeypatch.setattr(divergence, "TOP", 5)
    monkeypatch.setattr(divergence, "SLICE_ROWS", slice_rows)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n int, term string, docs int")
    assert sorted(tuple(r) for r in divergence.audit(frame).collect()) == expected(rows, least, 5)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["a", "Ab", "aB", "abcdefgh", "abcdefgH", "abcdefghi", "abcdefghij" * 3, "é", "É", "straße", "漢字", "zz", "abcdefghijklmnop", "abcdefghijklmnoq", "don't", "x1y"]
    rows = []
    for _ in range(300):
        source = rng.choice(["s1", "s2", "s2", "s2", None, "sé", "s3"])
        words = rng.choices(vocabulary[: 16 if source == "s2" else 12], k=rng.randrange(12))
        rows.append((rng.choice(["en", "en", "en", "de", None]), source, rng.choice([" ".join(words), "\n".join(words), None])))
    rows += [("fr", "s1", "only one source"), ("it", "s1", None), ("it", "s2", "1 2 3"), ("en", "s1", "long " * 50_000), ("en", "s1", "x" * 100_000)] + rows[:30]
    for least, slice_rows in ((3, 7), (3, 100_000), (10**6, 100)):
        check(spark, monkeypatch, rows, least, slice_rows)


def test_shards_of_any_size_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("en", f"s{rng.randrange(3)}", " ".join(f"w{'x' * rng.randrange(20)}" for _ in range(rng.randrange(300)))) for _ in range(60)]
    monkeypatch.setattr(divergence, "MIN_DOCS", 2)
    want = None
    for size in (1 << 22, 500, 1):
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "source", "text"])
        monkeypatch.setattr(divergence, "SHARD_BYTES", size)
        got = defaultdict(lambda: np.zeros(2, np.int64))
        for part in divergence._counts(iter([batch, batch.slice(0, 0), batch.slice(5, 7)])):
            for r in part.to_pylist():
                got[r["source"], r["term"]] += (r["docs"], r["n"])
        got = {k: tuple(v.tolist()) for k, v in got.items()}
        assert want in (None, got)
        want = got


def test_pointers_are_sorted_as_their_terms():
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"ab\xc3\xff") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40]))) for _ in range(3000)]
    raw = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    lengths = np.array([len(p) for p in pieces])
    order, new = divergence.sort_pointers(raw, np.cumsum(lengths) - lengths, lengths)
    got = [pieces[k] for k in order]
    assert got == sorted(pieces) and order.tolist() == sorted(range(len(pieces)), key=lambda k: (pieces[k], k))
    assert new.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(frame).count() == 0
