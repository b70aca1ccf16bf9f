"""Near-duplicates by SimHash: fingerprints of word shingles, linked where few bits differ.

Meet in the middle: two fingerprints at 2 or fewer differing bits have a third one within 1 bit of both.  Every distinct fingerprint is
therefore sent to itself and to its 64 neighbours, and fingerprints that meet are linked.  All that can meet at one point are the point and its
neighbours, so a meeting place is one 64-bit mask: the shuffle carries (place, mask), a bit-or combines it, and no place holds more
than 65 fingerprints, however many documents share them.  Copies of a text have one fingerprint and are joined back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailposture.llm.blocks import flat, tidy
from mailposture.llm.graph import components
from mailposture.session import store

SEED = 42
BITS = 64

#: Eight lanes of eight bits: lane k of entry b is bit k of byte b.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of every run of hashes: the bits that are set in over half of them.

    Bits are added in byte lanes over stretches of at most 255 hashes, then the lanes of the stretches are added up.
    """
    out = np.zeros(len(counts), np.uint64)
    used = np.flatnonzero(counts)
    if not len(used):
        return out
    sizes = counts[used]
    starts = np.cumsum(sizes) - sizes
    stretches = -(-sizes // 255)
    run = np.repeat(np.arange(len(used)), stretches)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    cuts = starts[run] + 255 * inside
    first = np.cumsum(stretches) - stretches
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    fingerprint = np.zeros(len(used), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[by_byte[:, k]], cuts)
        for bit in range(8):
            ones = np.add.reduceat((lanes >> np.uint64(8 * bit)) & np.uint64(255), first)
            fingerprint |= (2 * ones > sizes.astype(np.uint64)).astype(np.uint64) << np.uint64(8 * k + bit)
    out[used] = fingerprint
    return out


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of all shingles of ``width`` words of a text, repeats included; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of UTF-8 bytes: A-Z only, and ASCII white space only
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-width])
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())]


@tidy
def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        bounds = offsets.tolist()
        out = np.zeros(batch.num_rows, np.uint64)
        hashes: list[int] = []
        counts: list[int] = []
        for row, (a, b) in enumerate(zip(bounds, bounds[1:])):
            got = shingle_hashes(bytes(data[a:b]), width)
            hashes += got
            counts.append(len(got))
            if len(hashes) > 1 << 17 or row + 1 == batch.num_rows:
                out[row + 1 - len(counts) : row + 1] = majority(np.array(hashes, np.uint64), np.array(counts))
                hashes, counts = [], []
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "bits"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, bits bigint): 64-bit SimHash of the word shingles of every text.  Without words, as for null, it is 0."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _fingerprints(b, width), f"id {kind}, bits bigint").withColumnRenamed("id", id_col)


def links(distinct_bits: DataFrame) -> DataFrame:
    """(a, b): verified pairs of distinct fingerprints at 2 or fewer differing bits, enough to connect all that are.

    Of the fingerprints that meet at a place the smallest is paired with the others; as all of them are within 2 bits of each other,
    every link is among the pairs or follows from pairs of the same place.
    """
    spark = distinct_bits.sparkSession
    one = F.lit(1).cast("bigint")
    flip = F.call_function("shiftleft", one, F.col("k"))
    # a fixed number of partitions: the few megabytes of fingerprints become 65 times as many rows here
    dealt = distinct_bits.select("bits").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = dealt.select("bits", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("k")).select(
        F.when(F.col("k") < 0, F.col("bits")).otherwise(F.col("bits").bitwiseXOR(flip)).alias("place"),
        F.when(F.col("k") < 0, F.lit(0).cast("bigint")).otherwise(flip).alias("flip"),
        F.when(F.col("k") < 0, 1).otherwise(0).alias("here"),
    )
    met = sent.groupBy("place").agg(F.bit_or("flip").alias("flips"), F.max("here").alias("here"))
    met = met.filter(F.bit_count("flips") + F.col("here") >= 2)
    neighbours = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.col("flips").bitwiseAND(F.call_function("shiftleft", one, k)) != 0),
        lambda k: F.col("place").bitwiseXOR(F.call_function("shiftleft", one, k)),
    )
    members = met.select(F.when(F.col("here") == 1, F.concat(neighbours, F.array("place"))).otherwise(neighbours).alias("members"))
    pairs = members.select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
    pairs = pairs.filter(F.col("a") != F.col("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row: fingerprints are linked at 2 or fewer differing bits.

    ``component_id`` is the smallest id that can be reached over links, the row's own included.  Null and blank texts have fingerprint
    0 and are linked like any other.  Rows without an id get the component of their fingerprint, null where no row in it has an id.
    Repeated rows stay.
    """
    bits = store(fingerprints(df, id_col, text_col, width))
    first = store(bits.groupBy("bits").agg(F.min(id_col).alias("first")))
    groups = components(links(first)).select(F.col("node").alias("bits"), "root")
    grouped = store(first.join(groups, "bits", "left"))
    smallest = grouped.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("smallest"))
    named = store(grouped.join(store(smallest), "root", "left").select("bits", F.coalesce("smallest", "first").alias("component_id")))
    return bits.join(named, "bits").select(id_col, F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest id stays; of several rows with that id one stays.

    Rows without an id cannot be named and stay.
    """
    found = near_duplicates(df, id_col, text_col, width)
    stay = store(found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct())
    named = df.filter(F.col(id_col).isNotNull()).join(stay, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(df.filter(F.col(id_col).isNull()))
