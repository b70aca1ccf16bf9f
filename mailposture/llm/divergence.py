"""How much the sources of each language differ in their words: token-start pointers sorted in every shard, counts of equal runs added up.

A shard is some megabytes of text as one Arrow buffer.  Its terms stay where they are; what is sorted are pointers to their starts, by multikey quicksort
on eight bytes at a time: pointers with equal words go on to the next eight bytes, all others are in place.  Rows are laid out by (language, source), so equal
runs are cut by source as they stand, and the number of rows in a run is the number of documents.  Only (term, source, documents, occurrences) leave a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailposture.llm.blocks import flat, groups, release
from mailposture.session import store
from mailposture.skew import top_per_group

#: Documents of a language that a term must be in.
MIN_DOCS = 30
#: Pseudo-occurrences of every kept term, parts of one (probabilities are whole numbers), terms reported for each group.
SMOOTH, ONE, TOP = 5, 1_000_000_000, 50
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Counts in a slice of terms whose sources are compared in one call.
SLICE_ROWS = 100_000

_KEPT = np.zeros(256, bool)
_KEPT[ord("A") : ord("Z") + 1] = _KEPT[ord("a") : ord("z") + 1] = _KEPT[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_at(raw: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes from ``at`` as big-endian numbers; bytes behind the ``left`` ones of the term are zero.  ``raw`` has eight bytes to spare."""
    shifts = np.arange(56, -8, -8, dtype=np.uint64)
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        byte = raw[at + k].astype(np.uint64)
        out |= np.where(left > k, byte, np.uint64(0)) << shifts[k]
    return out


def sort_pointers(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, flags): pointers in the order of the terms they point to, equal ones as they stood, and whether a term differs from the one before.

    Terms have no zero byte, so a shorter one is below all that it begins.
    """
    order = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    if not len(starts):
        return order, new
    new[0] = True
    todo, run, depth = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0  # places to sort, and the run of equal terms so far of each
    while len(todo):
        pointers = order[todo]
        word = words_at(raw, np.minimum(starts[pointers] + depth, len(raw) - 8), lengths[pointers] - depth)
        inside = np.argsort(word, kind="stable")
        if depth:
            inside = inside[np.argsort(run[inside], kind="stable")]
        order[todo] = pointers[inside]
        word, run = word[inside], run[inside]
        differs = np.append(True, (word[1:] != word[:-1]) | (run[1:] != run[:-1]))
        new[todo] |= differs
        # runs of more than one term whose eight bytes are all used go on
        run = np.cumsum(differs) - 1
        on = (np.bincount(run)[run] > 1) & ((word & np.uint64(0xFF)) != 0)
        todo, run, depth = todo[on], run[on], depth + 8
    return order, new


def shard_counts(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, groups, documents, occurrences) of the texts ``raw`` cut at ``offsets``, whose groups ``group`` do not fall."""
    raw = _LOWER[raw]
    kept = _KEPT[raw]
    before = np.append(False, kept[:-1])
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(kept & (~before | cut[:-1]))
    ends = np.flatnonzero(kept & (~np.append(kept[1:], False) | cut[1:])) + 1
    order, new = sort_pointers(np.append(raw, np.zeros(8, np.uint8)), starts, ends - starts)
    row = (np.searchsorted(offsets, starts, "right") - 1)[order]
    if not len(row):
        return [], row, row, row
    groups_of = group[row]
    first = np.flatnonzero(new | np.append(True, groups_of[1:] != groups_of[:-1]))
    other_row = np.append(True, row[1:] != row[:-1])
    other_row[first] = True
    texts = raw.tobytes()
    at = order[first]
    terms = [texts[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
    return terms, groups_of[first], np.add.reduceat(other_row.astype(np.int64), first), np.diff(np.append(first, len(row)))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (lang, source, text) gathered to shards."""
    held, size = [], 0
    for batch in batches:
        _, offsets = flat(batch.column(2))
        for a, b in groups(offsets, SHARD_BYTES):
            piece = int(offsets[b] - offsets[a])
            if held and size + piece > SHARD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += piece
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        if not shard.num_rows:
            continue
        by_group = pc.sort_indices(shard, sort_keys=[("lang", "ascending"), ("source", "ascending")])
        shard = shard.take(by_group)
        lang, source, text = shard.columns
        same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(source[1:], source[:-1])).to_numpy(zero_copy_only=False)
        group = np.append(0, np.cumsum(~same.astype(bool)))
        heads = pa.array(np.flatnonzero(np.append(True, np.diff(group) > 0)))
        data, offsets = flat(text)
        terms, at, docs, n = shard_counts(np.frombuffer(data, np.uint8), offsets, group)
        at = heads.take(pa.array(at, pa.int64()))
        columns = [lang.take(at), source.take(at), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "docs", "n"])
    release()


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, docs, n): in how many rows of the group a term stands, and how often."""
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, docs bigint, n bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(ONE * (n + SMOOTH) / (total + SMOOTH * terms)) in whole numbers that cannot overflow."""
    over = f"CAST({n} + {SMOOTH} AS DECIMAL(19, 0)) * CAST({ONE} AS DECIMAL(10, 0))"
    under = f"(CAST({total} AS DECIMAL(19, 0)) + {SMOOTH} * CAST({terms} AS DECIMAL(19, 0)))"
    return F.expr(f"1 + ({over} DIV {under})")


def _distances(key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
    """(lang, source, item, value): sums over the terms of a slice of |p - q|, for all pairs of sources."""
    names = sources.column("source").combine_chunks()
    order = pc.sort_indices(names).to_numpy()
    names = names.take(pa.array(order))
    base = sources.column("base").to_numpy()[order]
    n = len(names)
    total = np.zeros((n, n), np.int64)
    if counts.num_rows:
        term = counts.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        column = pc.index_in(counts.column("source").combine_chunks(), names).to_numpy()
        p = counts.column("p").to_numpy()
        by_term = np.argsort(term, kind="stable")
        term, column, p = term[by_term], column[by_term], p[by_term]
        width = max(1, (1 << 20) // n)
        for low in range(0, int(term[-1]) + 1, width):
            a, b = np.searchsorted(term, [low, low + width])
            table = np.repeat(base[None, :], min(width, int(term[-1]) + 1 - low), axis=0)
            table[term[a:b] - low, column[a:b]] = p[a:b]
            for k in range(n - 1):
                total[k, k + 1 :] += np.abs(table[:, k + 1 :] - table[:, k : k + 1]).sum(axis=0)
    total += total.T
    one, two = np.nonzero(~np.eye(n, dtype=bool))
    lang = pa.array([key[0].as_py()] * len(one), pa.string())
    return pa.table([lang, names.take(pa.array(one)), names.take(pa.array(two)), pa.array(total[one, two])], ["lang", "source", "item", "value"])


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of a language, and the terms that mark a source.

    Terms are runs of ASCII letters (A-Z lower-cased) and other characters beyond ASCII.  A language keeps the terms in at least ``MIN_DOCS`` of its rows.  Each (language, source), and each language, gives every kept
    term a share in whole billionths, smoothed by ``SMOOTH`` occurrences.  Part ``pair``: every other source of the language by the sum of the differences of shares, all ranks.
    Part ``term``: terms that occur in the source with a larger share than in the language, the ``TOP`` largest differences.  Ties by item in byte order.

    Null text, language and source are empty strings.  Every group that occurs is reported, also if it has no term; a language with one source has no pairs.  Rows are
    documents, so repeated rows count.  An empty table gives no rows.  The number of pairs is that of the result: the square of the sources of a language.  Terms
    are compared in slices, so neither a language nor a term that holds a large share of all rows comes into one task.
    """
    counts = term_counts(df, text_col, lang_col, source_col)
    in_lang = Window.partitionBy("lang", "term")
    kept = store(counts.withColumn("in_docs", F.sum("docs").over(in_lang)).withColumn("in_lang", F.sum("n").over(in_lang)).filter(F.col("in_docs") >= MIN_DOCS).drop("docs", "in_docs"))
    named = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    rows_of = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    sources = named.join(rows_of, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "rows", "terms", "lang_total"])
    base = F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(F.lit(0)).cast("bigint")
    slices = F.greatest(F.lit(1), F.ceil(F.sum("rows").over(Window.partitionBy("lang")) / SLICE_ROWS)).cast("int")
    sources = store(sources.withColumn("base", base).withColumn("slices", slices))

    shares = kept.join(sources.select("lang", "source", "total", "terms", "lang_total", "slices"), ["lang", "source"]).select(
        "lang", "source", "term", share("n", "total", "terms").alias("p"), share("in_lang", "lang_total", "terms").alias("q"), "slices"
    )
    sliced = shares.select("lang", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "source", "term", "p")
    lists = sources.select("lang", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "source", "base")
    summed = sliced.groupBy("lang", "slice").cogroup(lists.groupBy("lang", "slice")).applyInArrow(_distances, "lang string, source string, item string, value bigint")
    pairs = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))

    over = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(top_per_group(over, ["lang", "source"], [F.col("value").desc(), F.col("item")], TOP))
