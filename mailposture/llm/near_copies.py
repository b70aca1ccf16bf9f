"""Near copies by SimHash, with what its fingerprints miss found by prefix filtering; every link is verified by Jaccard similarity of word shingles on the texts.

SimHash (``simhash.near_duplicates``) connects texts at 2 or fewer differing bits.  That is tighter than the bound, so the other pairs at or above it are found by a second method, which misses
none.  Shingles have one order for all texts: those that many texts share come last, the others by hash.  Two sets at similarity ``t`` or above share a shingle among the first
n - ceil(t n) + 1 of each, and the first one they share stands early enough in both to leave room for the overlap.  The steps:

1. Shingles are counted over all texts in a fixed number of cells, by hash.  The counts order shingles; they decide how many comparisons there are, never which pairs are found.
2. Sets whose fingerprints SimHash connects are compared with the first of their component; what is linked by that is not compared again.
3. The first shingles of the distinct sets are packed into runs.  A run sends 47 bits of each to the group that owns it, and gets one bit back: whether another set has it.
   Only those that do become rows.
4. Texts that meet at a shingle are compared with one of them, in rounds, as long as that connects much of what is left; only the rest is compared in pairs.  So a large group
   of near copies costs a few comparisons a text, not one a pair.  Pairs that cannot be similar by their sizes, by the place of the shingle or by the parity of
   their sets go before a text is looked at, and where many sets meet a wide parity goes into the join itself, so that pairs below the bound do not become rows.

Stored tables of a step are deleted when the next one no longer reads them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture.llm.blocks import flat, tidy
from mailposture.llm.graph import components
from mailposture.llm.simhash import near_duplicates, shingle_hashes
from mailposture.llm.suffix_dedup import ASKED, BITS, SPREAD, Asked, Stretches, _by_run, _shared, _tidied, asked, mix, pack, questions_of
from mailposture.session import discard, release_shuffles, store
from mailposture.skew import partitions

WIDTH = 5
#: Least similarity, as a fraction of whole numbers so that bounds are exact.
SIMILAR = (4, 5)
#: Two rows of so many cells in which shingles are counted for the order.
CELLS = 1 << 16
#: Bits of the parity by which pairs are looked at before their texts are.
WIDE = 1 << 13
#: Sets at a shingle from which on pairs have to pass a parity of so many bits in the join.
CROWD, CROWD_BITS = 16, 1 << 12
#: Prefix shingles that one group compares, about.
GROUP_SHINGLES = 4 << 20
#: A round of stars is followed by another one if it leaves at most this share of the places.
WORTH = 0.75


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def key_of(shingles: np.ndarray) -> int:
    """64-bit name of a set, the same for all texts with these shingles."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def cells_of(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of shingles in both rows."""
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64), CELLS + ((shingles >> np.uint64(20)) & np.uint64(CELLS - 1)).astype(np.int64)


def prefix(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all texts, by the lesser of their cells' counts and by hash: what a similar set has to share at least one of."""
    a, b = SIMILAR
    n = len(shingles)
    size = n - -(-a * n // b) + 1 if n else 0
    one, two = cells_of(shingles)
    return shingles[np.argsort(np.minimum(counts[one], counts[two]), kind="stable")[:size]]  # by hash already


def parity(shingles: np.ndarray, bits: int = 256) -> np.ndarray:
    """``bits`` bits, each the parity of the number of shingles that fall on it: two sets differ in at least as many shingles as these differ in bits."""
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = flat(column)
    bounds = offsets.tolist()
    for a, b in zip(bounds, bounds[1:]):
        yield bytes(data[a:b])


@tidy
def _cells(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(2 * CELLS, np.int64)
    for batch in batches:
        for text in _texts(batch.column(0)):
            for cells in cells_of(shingle_set(text, width)):
                np.add.at(counts, cells, 1)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["cell", "n"])


@tidy
def _named(batches: Iterator[pa.RecordBatch], order: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, prefixes, parities = [], [], [], []
        for text in _texts(batch.column(2)):
            shingles = shingle_set(text, width)
            keys.append(key_of(shingles))
            sizes.append(len(shingles))
            prefixes.append(prefix(shingles, order.value).view(np.int64))
            parities.append(parity(shingles))
        columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "hash", "key", "n", "prefix", "parity"])


@tidy
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sets, each one row, so that answers find the sets in the order in which they asked."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    for serial, batch in enumerate(b for b in batches if b.num_rows):
        yield pa.RecordBatch.from_arrays([pa.array([first + serial]), pa.array([pack(batch)], pa.binary())], ["run", "packed"])


def _questions(packed: bytes, parts: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, Asked]:
    """(sets, their prefix shingles end to end, set of each, what the run asks).  Prefixes favour small hashes, which are spread before they are dealt out."""
    with pa.ipc.open_stream(packed) as reader:
        sets = reader.read_next_batch()
    lists = sets.column(2)
    shingles = lists.flatten().to_numpy().view(np.uint64)
    owner = np.repeat(np.arange(sets.num_rows), np.diff(lists.offsets.to_numpy()))
    return sets, shingles, owner, asked(Stretches(owner, owner, mix(shingles * SPREAD), owner), np.arange(sets.num_rows), parts)


@tidy
def _ask(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield questions_of(run, _questions(packed.as_py(), parts)[3])


@tidy
def _places(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(shingle, key, n, at, parity) of the prefix shingles that another set has too."""
    for batch in batches:
        for packed, answers in zip(batch.column(0), batch.column(1)):
            sets, shingles, owner, ask = _questions(packed.as_py(), parts)
            bits = np.zeros(len(ask.keys), bool)
            for answer in answers.as_py() or ():
                low, high = ask.bounds[answer["part"]], ask.bounds[answer["part"] + 1]
                bits[low:high] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=high - low)
            at = np.arange(len(owner)) - np.searchsorted(owner, owner)
            keep = np.flatnonzero(bits[ask.place])
            of_set = pa.array(owner[keep])
            columns = [pa.array(shingles[keep].view(np.int64)), *(sets.column(k).take(of_set) for k in (0, 1)), pa.array(at[keep].astype(np.int32)), sets.column(3).take(of_set)]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "key", "n", "at", "parity"])


@tidy
def _wide(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(key, n, odd): parity of the sets of texts on ``WIDE`` bits."""
    for batch in batches:
        sets = [shingle_set(text, width) for text in _texts(batch.column(1))]
        odd = [np.packbits(np.bincount((x % np.uint64(WIDE)).astype(np.int64), minlength=WIDE) & 1 == 1).tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(odd, pa.binary())], ["key", "n", "odd"])


@tidy
def _odds(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(key, odds): parity of the sets of texts on ``CROWD_BITS`` bits."""
    for batch in batches:
        odds = [parity(shingle_set(text, width), CROWD_BITS) for text in _texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odds, pa.list_(pa.int64()))], ["key", "odds"])


@tidy
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sets (n, odd of both) may be at the bound: no more bits differ than shingles may."""
    a, b = SIMILAR
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
            total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((a + b) * np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= (b - a) * total))


@tidy
def _verified(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text, text) at the bound or above.  Pairs of one text come one after the other, so its set is made once."""
    a, b = SIMILAR
    last, one = None, np.zeros(0, np.uint64)
    for batch in batches:
        stay = []
        for key, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if key != last:
                last, one = key, shingle_set(x.as_py().encode(), width)
            two = shingle_set(y.as_py().encode(), width)
            shared = len(np.intersect1d(one, two, assume_unique=True))
            stay.append(b * shared >= a * (len(one) + len(two) - shared))
        yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))


def order_of(texts: DataFrame, width: int) -> np.ndarray:
    """Counts of all texts' shingles in both rows of cells; a fixed number of values comes to the driver."""
    summed = texts.select("text").mapInArrow(lambda b: _cells(b, width), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * CELLS, np.int64)
    counts[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return counts


def named(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, hash, key, n, prefix, parity) of every row of ``texts`` (id, hash, text): name and size of its shingle set, its first shingles, parity."""
    order = texts.sparkSession.sparkContext.broadcast(order_of(texts, width))
    kind = texts.schema["id"].dataType.simpleString()
    return store(texts.mapInArrow(lambda batches: _named(batches, order, width), f"id {kind}, hash bigint, key bigint, n int, prefix array<bigint>, parity array<bigint>"))


def differing(x: str, y: str, words: int) -> Column:
    """Bits by which two parities differ."""
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(words)), F.lit(0))


def fits(x: str, y: str) -> Column:
    """Whether two sets may be similar if this is the first shingle that they share: overlap o of n1 and n2 needs o >= t (n1 + n2 - o), and so few shingles that differ."""
    a, b = SIMILAR
    total = F.col(f"n{x}") + F.col(f"n{y}")
    room = F.least(F.col(f"n{x}") - F.col(f"at{x}"), F.col(f"n{y}") - F.col(f"at{y}"))
    return ((a + b) * room >= a * total) & ((a + b) * differing(f"parity{x}", f"parity{y}", 4) <= (b - a) * total)


def proposed(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): every set of ``sets`` (key, hash) whose text SimHash connects to others, with the first set of that component; a is less than b."""
    groups = near_duplicates(texts, "hash", "text").select("hash", F.col("component_id").alias("group")).distinct()
    grouped = store(sets.select("key", "hash").join(groups, "hash").select("key", "group"))
    first = grouped.groupBy("group").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter(F.col("a") < F.col("z"))
    pairs = store(grouped.join(first, "group").filter(F.col("key") != F.col("a")).select("a", F.col("key").alias("b")))
    discard(grouped)
    release_shuffles(texts.sparkSession)
    return pairs


def rooted(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """``rows`` with the component of their set over ``linked`` (a, b) as ``root``, as a written table."""
    roots = components(linked).select(F.col("node").alias("key"), "root")
    return store(rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))


def meeting_places(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """(shingle, key, n, at, parity, root) at prefix shingles where sets of ``sets`` (key, n, prefix, parity) meet that ``linked`` does not connect."""
    parts = partitions(sets)
    runs = store(sets.mapInArrow(_packed, "run bigint, packed binary"))
    shingles = sets.agg(F.sum(F.size("prefix").cast("bigint"))).first()[0] or 0
    parts = max(parts, -(-shingles // GROUP_SHINGLES))
    ask = runs.mapInArrow(lambda b: _ask(b, parts), ASKED)
    answers = store(_by_run(ask.groupBy("part").applyInArrow(_tidied(_shared), BITS), "answers"))
    answered = runs.join(answers, "run", "left").select("packed", "answers")
    rows = answered.mapInArrow(lambda b: _places(b, parts), "shingle bigint, key bigint, n int, at int, parity array<bigint>")
    found = rooted(rows, linked)
    places = mixed(found)
    discard(runs, answers, found)
    return places


def mixed(rows: DataFrame) -> DataFrame:
    """Rows at shingles where sets of different components meet."""
    met = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") < F.col("high"))
    return store(rows.join(met.select("shingle"), "shingle", "left_semi"))


def by_crowd(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places with few sets, and those with a crowd."""
    crowds = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > CROWD).select("shingle")
    return places.join(crowds, "shingle", "left_anti"), store(places.join(crowds, "shingle", "left_semi"))


def meetings(places: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b) of sets of different components that meet at a place and may be similar; with a column ``odds`` by that wide parity too."""
    a, b = SIMILAR
    one, two = (places.select("shingle", *(F.col(c).alias(f"{c}{k}") for c in columns)) for k in (1, 2))
    meets = (one["shingle"] == two["shingle"]) & (F.col("key1") < F.col("key2")) & (F.col("root1") != F.col("root2")) & fits("1", "2")
    if "odds" in columns:
        meets &= (a + b) * differing("odds1", "odds2", CROWD_BITS // 64) <= (b - a) * (F.col("n1") + F.col("n2"))
    return one.join(two, meets).select(F.col("key1").alias("a"), F.col("key2").alias("b"))


def similar(texts: DataFrame, sets: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b): verified pairs of ``sets`` (key, n, prefix, parity, id, hash: a row of ``texts``), enough to connect all that similar pairs connect."""
    columns = ("key", "n", "at", "root", "parity")

    def texts_of(keys: DataFrame) -> DataFrame:
        wanted = sets.select("key", "id", "hash").join(keys, "key")
        return texts.join(wanted, ["id", "hash"]).select("key", "text").dropDuplicates(["key"])

    def verify(pairs: DataFrame) -> DataFrame:
        chosen = store(texts_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()))
        wide = store(chosen.mapInArrow(lambda batches: _wide(batches, width), "key bigint, n int, odd binary"))
        weighed = pairs.join(wide.withColumnsRenamed({"key": "b", "n": "n2", "odd": "odd2"}), "b").join(wide.withColumnsRenamed({"key": "a", "n": "n1", "odd": "odd1"}), "a")
        near = store(weighed.select("a", "b", "n1", "n2", "odd1", "odd2").mapInArrow(_near, "a bigint, b bigint"))
        discard(wide, pairs)
        both = near.join(chosen.withColumnsRenamed({"key": "b", "text": "two"}), "b").join(chosen.withColumnsRenamed({"key": "a", "text": "one"}), "a")
        ordered = both.select("a", "b", "one", "two").sortWithinPartitions("a")
        found = store(ordered.mapInArrow(lambda batches: _verified(batches, width), "a bigint, b bigint"))
        discard(chosen, near)
        release_shuffles(texts.sparkSession)
        return found

    linked = verify(proposed(texts, sets))
    places = meeting_places(sets, linked)
    left, turn = places.count(), 0
    while left:
        first = F.min_by(F.struct(*columns), F.xxhash64("key", F.lit(turn)))
        centres = store(places.groupBy("shingle").agg(first.alias("c")).select("shingle", *(F.col(f"c.{c}").alias(f"{c}0") for c in columns)))
        near = places.withColumnsRenamed({c: f"{c}1" for c in columns}).join(centres, "shingle").filter((F.col("root0") != F.col("root1")) & fits("0", "1"))
        pairs = store(near.select(F.least("key0", "key1").alias("a"), F.greatest("key0", "key1").alias("b")).distinct())
        discard(centres)
        linked = linked.union(verify(pairs))
        now = rooted(places.drop("root"), linked)
        discard(places)
        places = mixed(now)
        discard(now)
        before, left, turn = left, places.count(), turn + 1
        if left > WORTH * before:
            break
    if not left:
        return linked
    few, crowds = by_crowd(places)
    odds = store(texts_of(crowds.select("key").distinct()).mapInArrow(lambda batches: _odds(batches, width), "key bigint, odds array<bigint>"))
    crowded = store(crowds.join(odds, "key"))
    rest = verify(store(meetings(few, columns).union(meetings(crowded, (*columns, "odds"))).distinct()))
    discard(places, crowds, odds, crowded)
    return linked.union(rest)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``df`` without near copies: of texts connected by pairs at the bound or above, the row with the smallest id stays.

    Rows that share an id but not their shingles are judged each on its own; of equal rows with one id one stays.  Null and blank texts have no shingles and are copies of each other.
    Rows without an id cannot be named and stay.  An empty table stays empty.  Columns of ``df`` may have any names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = df.filter(F.col(id_col).isNotNull())
    texts = known.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    rows = named(texts, width)
    firsts = store(rows.groupBy("key").agg(F.min(F.struct("id", "hash")).alias("first")).select("key", "first.id", "first.hash"))
    sets = store(rows.join(firsts, ["key", "id", "hash"], "left_semi").select("key", "n", "prefix", "parity", "id", "hash").dropDuplicates(["key"]))
    discard(rows)
    groups = components(similar(texts, sets, width)).select(F.col("node").alias("key"), "root")
    rooted = firsts.join(groups, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mark = "_hash"
    while mark in df.columns:
        mark += "_"
    stay = store(rooted.groupBy("root").agg(F.min(F.struct("id", "hash")).alias("first")).select(F.col("first.id").alias(id_col), F.col("first.hash").alias(mark)))
    discard(sets, firsts)
    release_shuffles(df.sparkSession)
    kept = known.withColumn(mark, F.xxhash64(text)).join(stay, [id_col, mark], "left_semi").dropDuplicates([id_col, mark])
    return kept.select(*df.columns).unionByName(df.filter(F.col(id_col).isNull()))
