"""Substring signatures as a table: which of many thousand patterns occur in a text, by a join on q-grams.

Every signature is found by one of its q-grams, the one that the fewest signatures have.  The distinct texts are cut into their q-grams, equal q-grams of both sides meet in an
equi join, and what meets is verified by ``contains``.  A signature shorter than ``Q`` has no q-gram; it meets the grams of its own length, which texts are cut into only where a
signature asks for them.  There is no nested loop, and a text that many rows share is looked at once.  What is found is stored once, so the rows that ask for it can be salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailposture.session import store
from mailposture.skew import lookup_join

#: Length of the q-grams.
Q = 6


def signature_table(spark: SparkSession, patterns: dict[str, list[str]]) -> DataFrame:
    """(sig, provider, pattern): a row for each pattern; ``sig`` is the place of the provider, which decides the order of evidence."""
    rows = [(i, provider, word) for i, (provider, words) in enumerate(patterns.items()) for word in words]
    return spark.createDataFrame(rows, "sig int, provider string, pattern string")


def grams(text: Column, size: Column | int) -> Column:
    """Array of the distinct grams of a text, of ``size`` characters each; empty for shorter texts."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, size)))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def seeds(signatures: DataFrame) -> DataFrame:
    """(seed, size, pattern): the gram by which each distinct pattern is found.

    It is the gram that the fewest patterns have, then the least.  No seed is shared by more patterns than it has to be, so a word that a third of all signatures contain does not
    bring them all to every text that contains it, unless a signature has nothing else.
    """
    known = signatures.select(F.lower("pattern").alias("pattern")).filter(F.col("pattern") != "").distinct()
    size = F.least(F.length("pattern"), F.lit(Q))
    cut = known.select("pattern", size.alias("size")).withColumn("seed", F.explode(grams(F.col("pattern"), F.col("size"))))
    owners = cut.groupBy("seed").agg(F.count(F.lit(1)).alias("owners"))
    return cut.join(owners, "seed").groupBy("pattern").agg(F.min(F.struct("owners", "seed", "size")).alias("best")).select("pattern", "best.seed", "best.size")


def matches(texts: DataFrame, text: str, signatures: DataFrame) -> DataFrame:
    """(text, sig, provider): the distinct texts of a column with every provider one of whose patterns occurs in them, letter case aside.

    ``signatures`` (sig, provider, pattern) may have any number of rows; repeated rows, null and empty patterns have no effect.  Null texts match nothing.  A provider with several
    ``sig`` matches with the least of those that are found.
    """
    found = store(seeds(signatures))
    sizes = [r.size for r in found.select("size").distinct().collect()]  # at most Q numbers
    distinct = texts.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct().withColumn("low", F.lower("text"))
    every = F.array_distinct(F.concat(*(grams(F.col("low"), n) for n in sizes))) if sizes else F.array().cast("array<string>")
    cut = distinct.select("text", "low", F.explode(every).alias("seed"))
    met = cut.join(found.select("seed", "pattern"), "seed").filter(F.contains("low", F.col("pattern"))).select("text", "pattern")
    owners = signatures.select(F.lower("pattern").alias("pattern"), "sig", "provider").distinct()
    owned = met.join(owners, "pattern")
    return store(owned.groupBy("text", "provider").agg(F.min("sig").alias("sig")).select("text", "sig", "provider"))


def match_rows(df: DataFrame, text: Column, signatures: DataFrame) -> DataFrame:
    """``df`` with a column ``m`` (sig, provider), one row for each provider whose patterns occur in ``text``, as with patterns that are compiled into an expression."""
    keyed = df.withColumn("_text", text)
    hits = matches(keyed, "_text", signatures).select(F.col("text").alias("_text"), F.struct("sig", "provider").alias("m"))
    return lookup_join(keyed, hits, ["_text"], "inner").drop("_text")


def matched_texts(df: DataFrame, text: Column, signatures: DataFrame, flag: str) -> DataFrame:
    """``df`` with a column ``flag``: whether any of the patterns occurs in ``text``; false for null."""
    keyed = df.withColumn("_text", text)
    hits = matches(keyed, "_text", signatures).select(F.col("text").alias("_text")).distinct().withColumn(flag, F.lit(True))
    return lookup_join(keyed, hits, ["_text"]).withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_text")
