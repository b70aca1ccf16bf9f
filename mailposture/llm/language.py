"""Language of texts by error-correcting output codes over character n-grams.

Every language has a codeword of bits.  For every bit a linear classifier over hashed character bigrams and trigrams tells the languages that have the bit from the
others; its weights are log ratios of smoothed n-gram frequencies, summed over the languages of either side.  A text gets the margins of all bits, and
the language whose codeword has the least loss, bits weighted by how well they separate, is predicted.  Where the second codeword is nearly as close, the prediction is
flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailposture.llm.blocks import BLOCK_BYTES, pieces, tidy

#: Buckets of hashed n-grams.
BUCKETS = 1 << 15
UNKNOWN = "und"
#: Least share of the posterior by which the first codeword has to lead the second.
LEAD = 0.2


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Lower-case code point of every letter, a blank for everything else."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def grams(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bigram bucket, trigram bucket, counts?, piece) of all positions of a block; a gram of blanks alone, or over the end of its piece, doesn't count."""
    raw = np.frombuffer(data, np.uint8)
    points = letter_table()[np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)]
    place = np.flatnonzero((raw & 0xC0) != 0x80)
    piece = np.searchsorted(offsets, place, "right") - 1
    padded = np.concatenate([points, np.full(2, 32, np.uint32)]).astype(np.uint64)
    ends = np.append(piece[1:] != piece[:-1], True) if len(piece) else np.zeros(0, bool)
    one, two, three = padded[:-2], padded[1:-1].copy(), padded[2:].copy()
    two[ends], three[ends] = 32, 32
    three[:-1][ends[1:]] = 32
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    pair = (one << np.uint64(21)) | two
    return mix(pair), mix((pair << np.uint64(21)) ^ three ^ np.uint64(1 << 63)), (one != 32) | (two != 32), piece


def codewords(n: int, bits_per_level: int = 10, tries: int = 200) -> np.ndarray:
    """(languages, bits) of -1 and 1.  Up to five languages have all distinct splits; for more, the best of some random codes by least distance."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        rows = [s for s in itertools.product((-1, 1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(rows, np.int8).T
    random, best = np.random.default_rng(n), (-1, None)
    bits = math.ceil(bits_per_level * math.log2(n))
    for _ in range(tries):
        code = random.choice(np.array([-1, 1], np.int8), (n, bits))
        distance = (bits - code.astype(int) @ code.T.astype(int)) // 2
        score = int((distance + np.eye(n, dtype=int) * bits).min())
        if score > best[0] and (np.abs(code.sum(0, dtype=int)) < n).all():
            best = (score, code)
    return best[1]


@dataclass
class LanguageModel:
    """Languages, their codewords, weights per n-gram bucket and bit, and weight of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


@tidy
def _counted(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    number = {lang: k for k, lang in enumerate(languages)}
    total = np.zeros(len(languages) * BUCKETS, np.int64)
    for batch in batches:
        lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
        for block in pieces(batch.column(0)):
            pair, triple, counts, piece = grams(block.data, block.offsets)
            base = (lang[block.rows] * BUCKETS)[piece[counts]]
            for bucket in (pair, triple):
                total += np.bincount(base + bucket[counts], minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from all rows of ``df`` that have a text and a language.

    What reaches the driver is one count for each language and bucket, whatever the number of rows.
    """
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    counted = rows.mapInArrow(lambda b: _counted(b, languages), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(languages) * BUCKETS)
    for r in counted.collect():
        counts[r.cell] = r.n
    counts = counts.reshape(len(languages), BUCKETS)
    share = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BUCKETS)
    code = codewords(len(languages))
    weights, trust = np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1])
    for b in range(code.shape[1]):
        has = code[:, b] > 0
        w = np.log(share[has].mean(0) / share[~has].mean(0))
        margin = (share * w).sum(1) * code[:, b]  # expected margin of each language's own n-grams on its side
        scale = np.abs(margin).mean() or 1.0
        weights[:, b] = w / scale
        trust[b] = max(0.05, margin.min() / scale)
    return LanguageModel(languages, code, weights, trust / trust.mean() if len(trust) else trust)


def decide(margins: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, posterior of it, ambiguous) from the mean margins of each text."""
    loss = np.logaddexp(0, -4 * margins[:, None, :] * model.code[None]) @ model.trust if model.code.shape[1] else np.zeros((len(margins), len(model.languages)))
    likely = np.exp(-(loss - loss.min(1, keepdims=True)))
    likely /= likely.sum(1, keepdims=True)
    ranked = np.sort(likely, 1)
    second = ranked[:, -2] if likely.shape[1] > 1 else np.zeros(len(likely))
    return likely.argmax(1), ranked[:, -1], ranked[:, -1] - second < LEAD


@tidy
def _predicted(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, UNKNOWN], object)
    bits = model.code.shape[1]
    room = max(1 << 14, min(BLOCK_BYTES, (8 << 20) // max(1, bits)))
    for batch in batches:
        sums, n, letters = np.zeros((batch.num_rows, bits)), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for block in pieces(batch.column(1), room):
            pair, triple, counts, piece = grams(block.data, block.offsets)
            pair, triple, piece = pair[counts], triple[counts], piece[counts]
            if not len(piece):
                continue
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            row = block.rows[piece[first]]
            np.add.at(sums, row, np.add.reduceat(model.weights[pair] + model.weights[triple], first, axis=0))
            np.add.at(n, row, np.diff(np.append(first, len(piece))) * 2)
        best = np.full(batch.num_rows, len(names) - 1)
        score, unsure = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
        has = (n > 0) & bool(model.languages)
        if has.any():
            best[has], score[has], unsure[has] = decide(sums[has] / n[has, None], model)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(unsure)], ["id", "lang_pred", "score", "ambiguous"])


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every row; only the text is looked at.

    Null texts, texts without a letter, and all texts if the model has learnt no language, are ``und`` with score 0.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda b: _predicted(b, model), f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)


def bucket_of(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; of an empty text where there is no id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts
