"""Drawing the documents that are most like a target: importance weights over hashed n-grams, and the largest of weight plus Gumbel noise.

Weights are scored on arrays: the words of a block of texts, their checksums and the gains of their buckets are one array each.  The cutoff of the draw is
found without sorting all scores: a quantile sketch brackets it, exact counts outside of the bracket tell whether it is in there, and widen the bracket
where it is not; only the bracket is sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailposture.llm.blocks import flat, groups, ragged_take, tidy
from mailposture.session import store

BUCKETS = 10_000
#: Documents with fewer words are not drawn; of the others this share in hundredths.
MIN_WORDS, PERCENT = 20, 10
SEED = 2024
#: Accuracy of the quantile sketch; the first bracket reaches this many of its errors to both sides.
SKETCH, MARGIN = 10_000, 4
#: Words of more bytes get their checksum one by one.
LONG_WORD = 32

_WORD = np.zeros(256, bool)
for _low, _high in ((b"0", b"9"), (b"A", b"Z"), (b"a", b"z")):
    _WORD[_low[0] : _high[0] + 1] = True
_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def checksums(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices, byte position by byte position over all slices that reach it."""
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    short = np.flatnonzero(lengths <= LONG_WORD)
    short = short[np.argsort(-lengths[short], kind="stable")]
    falling, place = -lengths[short], starts[short]
    state = out[short]
    for k in range(int(-falling[0]) if len(short) else 0):
        n = int(np.searchsorted(falling, -k, "left"))  # slices longer than k
        state[:n] = _CRC[(state[:n] ^ raw[place[:n] + k]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out[short] = state
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[k] = zlib.crc32(raw[starts[k] : starts[k] + lengths[k]])
    return out


def _features(texts: pa.Array, width: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words by row, features by row, buckets of the features in order of the rows) of blocks of texts."""
    data, offsets = flat(texts)
    for a, b in groups(offsets):
        raw = _LOWER[np.frombuffer(data[offsets[a] : offsets[b]], np.uint8)]
        at = offsets[a : b + 1] - offsets[a]
        cut = np.zeros(len(raw) + 1, bool)
        cut[at] = True
        word = _WORD[raw]
        starts = np.flatnonzero(word & (~np.append(False, word[:-1]) | cut[:-1]))
        ends = np.flatnonzero(word & (~np.append(word[1:], False) | cut[1:])) + 1
        row = np.searchsorted(at, starts, "right") - 1
        n_words = np.bincount(row, minlength=b - a)
        n_features, found, of_row = np.zeros(b - a, np.int64), [], []
        joined, joined_at = raw, starts
        if width > 1:  # words end to end with one blank behind each, so that a run of words is one slice
            sizes = ends - starts + 1
            joined = np.full(int(sizes.sum()), ord(" "), np.uint8)
            joined_at = np.cumsum(sizes) - sizes
            within = ragged_take(raw, starts, ends - starts)
            joined[np.arange(len(within)) + np.repeat(np.arange(len(starts)), ends - starts)] = within
        for k in range(1, width + 1):
            n = len(starts) - k + 1
            if n <= 0:
                break
            inside = np.flatnonzero(row[:n] == row[k - 1 :])
            sizes = joined_at[inside + k - 1] + (ends - starts)[inside + k - 1] - joined_at[inside]
            found.append(checksums(joined, joined_at[inside], sizes) % np.uint32(buckets))
            of_row.append(row[inside])
            n_features += np.bincount(row[inside], minlength=b - a)
        bucket = np.concatenate(found) if found else np.zeros(0, np.uint32)
        if len(found) > 1:
            bucket = bucket[np.argsort(np.concatenate(of_row), kind="stable")]
        yield a, n_words, n_features, bucket.astype(np.int64)


@tidy
def _counts(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, _, bucket in _features(batch.column(0), width, buckets):
            counts += np.bincount(bucket, minlength=buckets)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])


@tidy
def _weights(batches: Iterator[pa.RecordBatch], gains: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    gain = gains.value
    for batch in batches:
        n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for a, words, features, bucket in _features(batch.column(1), width, len(gain)):
            b = a + len(words)
            n_words[a:b], n_features[a:b] = words, features
            sums = np.append(0, np.cumsum(gain[bucket]))
            ends = np.cumsum(features)
            weight[a:b] = np.where(features > 0, (sums[ends] - sums[ends - features]) // np.maximum(features, 1), 0)
        columns = [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight"])


def bucket_counts(df: DataFrame, text_col: str, width: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; ``buckets`` numbers come to the driver, whatever the input."""
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    summed = texts.mapInArrow(lambda b: _counts(b, width, buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of every bucket in target and source, in thousandths."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in pairs], np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """Noise of a row in thousandths, a function of its id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def score(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """(id_col, n_words, n_features, weight, score) of every row: mean gain of its features, and that plus noise."""
    gains = gains_of(bucket_counts(df, text_col, width, buckets), bucket_counts(target, text_col, width, buckets))
    shared = df.sparkSession.sparkContext.broadcast(gains)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    weighed = rows.mapInArrow(lambda b: _weights(b, shared, width), f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumn("score", F.col("weight") + gumbel("id", seed)).withColumnRenamed("id", id_col)


def bracket(scores: DataFrame, n: int, k: int) -> tuple[int, int, int]:
    """(low, high, above): the k-th largest of ``n`` scores lies in low..high, and ``above`` scores are larger than high.

    The quantile sketch gives a first guess; the exact counts outside decide, and a side that is too narrow is moved outwards in doubling steps.
    """
    step = MARGIN / SKETCH
    while True:
        ends = [max(0.0, 1 - k / n - step), min(1.0, 1 - (k - 1) / n + step)]
        low, high = scores.agg(F.percentile_approx("score", ends, SKETCH).alias("q")).first().q
        low, high = (low if ends[0] > 0 else -(1 << 62)), (high if ends[1] < 1 else 1 << 62)
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        step *= 2


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` by falling score, then ``order``.

    Scores are whole numbers of a bounded range, and the noise spreads rows over them: rows are numbered inside of each score, and the numbers of rows with larger
    scores are summed over the distinct scores alone.
    """
    sizes = rows.groupBy("score").agg(F.count(F.lit(1)).alias("_size"))
    larger = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("score", F.coalesce(F.sum("_size").over(larger), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("score").orderBy(*(F.col(c).asc_nulls_last() for c in order)))
    numbered = rows.withColumn("_inside", inside).join(before, "score")
    return numbered.withColumn("rank", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 1,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every row of ``df``; ``rank`` is null for those that are not drawn.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and characters beyond ASCII, features all runs of 1 to ``width`` of them.  Of the rows with at least
    ``min_words`` words the floor(``percent`` / 100 of them) with the largest scores are drawn, ties to the smaller id, then to fewer features.

    Null and empty texts have no features, weight 0 and are not drawn.  Rows without an id share one noise and come last among ties; repeated rows are scored and drawn each for
    itself.  An empty ``df`` gives no rows, an empty ``target`` the smoothed shares of nothing.  Further columns are not used.  A text of any length is scored whole; memory is that of one text.
    """
    all_rows = store(score(df, target, id_col, text_col, width, buckets, seed))
    able = all_rows.filter(F.col("n_words") >= min_words)
    n = able.count()
    k = percent * n // 100
    columns = [id_col, "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if k == 0:
        return all_rows.select(*columns, none)
    order = [id_col, "n_features"]
    low, high, above = bracket(able, n, k)
    inside = able.filter(F.col("score").between(low, high)).select(*columns)
    last = ranked(inside, order).filter(F.col("rank") == k - above).first()
    tie = F.col(id_col).eqNullSafe(F.lit(last[id_col]))
    smaller = F.col(id_col).isNotNull() if last[id_col] is None else F.coalesce(F.col(id_col) < F.lit(last[id_col]), F.lit(False))
    first = smaller | (tie & (F.col("n_features") <= last["n_features"]))
    taken = (F.col("n_words") >= min_words) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & first))
    drawn = ranked(all_rows.filter(taken).select(*columns), order)
    # rows equal to the last one in everything may be more than there is room for
    rank = F.when(F.col("rank") <= k, F.col("rank")).cast("bigint").alias("rank")
    return drawn.select(*columns, rank).union(all_rows.filter(~taken).select(*columns, none))
