import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mailposture.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, width):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]


def expected(rows, target, width=1, buckets=10_000, percent=10, least=20):
    """Brute force: (id, n_features, weight, score, rank) of rows (id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in rows for f in features(text, width)[1])
    t = Counter(bucket(f) for text in target for f in features(text, width)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        words, found = features(text, width)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: percent * len(able) // 100]
    ranks = Counter()
    result = [(*r[:4], k + 1) for k, r in enumerate(drawn)]
    ranks.update(r[:4] for r in drawn)
    for r in out:
        if ranks[r[:4]] > 0:
            ranks[r[:4]] -= 1
        else:
            result.append((*r[:4], None))
    return sorted(result, key=str)


def texts(rng, n):
    vocabulary = [f"w{k}" for k in range(300)] + ["Été", "été", "漢字", "UPPER", "x" * 50, "a1b2"]
    return [rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 25, 60]))) for _ in range(n)]


def check(spark, rows, target, **how):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, score int, _size string")
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, items, **how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, target, **{{"min_words": "least"}.get(k, k): v for k, v in how.items()})


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = list(enumerate([*texts(rng, 400), None, "", "\x00é w1\x7fw2", "w1 " * 40_000]))
    target = [*texts(rng, 30), None, "w1 w2 w3 " * 20]
    check(spark, rows, target)
    check(spark, rows, target, width=3, buckets=50, percent=35, min_words=1)
    check(spark, rows, [])
    check(spark, rows[:5], target)
    check(spark, [], target)


def test_repeated_ids_and_rows_without_one(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 3]), t) for t in texts(rng, 60)]
    for percent in (10, 50, 100):
        check(spark, rows + rows[:20], ["w1 w2"], percent=percent, min_words=3)


def test_bracket_is_widened_until_the_cutoff_is_inside(spark, monkeypatch):
    scores = spark.range(5000).select((F.col("id") % 700).alias("score"))
    monkeypatch.setattr(resampling, "MARGIN", 0.001)
    monkeypatch.setattr(resampling, "SKETCH", 3)
    values = sorted((r.score for r in scores.collect()), reverse=True)
    for k in (1, 500, 5000):
        low, high, above = resampling.bracket(scores, 5000, k)
        assert above < k <= above + sum(low <= v <= high for v in values) and low <= values[k - 1] <= high and above == sum(v > high for v in values)


def test_checksums():
    rng = random.Random(7)
    pieces = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 32, 33, 90]))) for _ in range(500)]
    lengths = np.array([len(p) for p in pieces])
    got = resampling.checksums(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [zlib.crc32(p) for p in pieces]
