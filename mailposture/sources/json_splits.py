"""Large JSON files as records: one file is read by many tasks.

A JSON file has no line ends to be cut at, so the usual readers put a whole file into one task.  Here the text reader cuts it at closing braces, in parallel over
byte ranges (blocks).  Whether a brace belongs to a string, and how deep it stands, depends on all text before.  So a block is reduced to a function of the state at
its start, "inside of a string or not": the state at its end and the change of depth for either start.  The functions of a file, one small row for each block, are composed
in order; then every fragment knows its state, and a record ends where the depth returns to that of the array or object which holds the records.

Everything is built from DataFrame functions.  No task holds more than a block of one file or the fragments of one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailposture.session import store

ALONG = (["file", "block"], "pos")
BLOCKS = (["file"], "block")


def _balance(text: Column) -> Column:
    """Opening minus closing brackets."""
    return F.length(F.regexp_replace(text, r"[\]}]", "")) - F.length(F.regexp_replace(text, r"[\[{]", ""))


def _parts(text: Column) -> Column:
    """Text between quotation marks, alternately outside and inside of strings.  Escapes become fillers of equal length: they stand in strings only and never end a fragment."""
    return F.split(F.regexp_replace(text, r"(?s)\\.", "__"), '"')


def _running(value: Column, over: tuple[list[str], str]) -> Column:
    """Sum over all rows before."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*over[0]).orderBy(over[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _either(odd: Column, even_value: Column, odd_value: Column) -> Column:
    return F.when(odd % 2 == 0, even_value).otherwise(odd_value)


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, pos, value, quotes, d0, d1): texts before closing braces; change of depth with the brace, for a start outside (d0) and inside (d1) of a string."""
    rows = spark.read.option("lineSep", "}").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    rows = rows.withColumn("parts", _parts(F.col("value"))).withColumn("quotes", (F.size("parts") - 1).cast("bigint"))
    even, odd = F.filter("parts", lambda _, i: i % 2 == 0), F.filter("parts", lambda _, i: i % 2 == 1)
    outside = [_balance(F.array_join(texts, "")) for texts in (even, odd)]
    # The brace that ends the fragment counts where the fragment ends outside of a string.
    d0 = outside[0] - _either(F.col("quotes"), F.lit(1), F.lit(0))
    d1 = outside[1] - _either(F.col("quotes"), F.lit(0), F.lit(1))
    return rows.select("file", "block", "pos", "value", "quotes", d0.cast("bigint").alias("d0"), d1.cast("bigint").alias("d1"))


def located(rows: DataFrame) -> DataFrame:
    """Fragments with ``inside`` (1 where they start in a string), ``depth`` at the start and ``after`` at the end, and ``open`` (whether they end in a string).

    ``rows`` is read twice, so it is a stored table.
    """
    q, quotes = F.col("q"), F.col("quotes")
    rows = rows.withColumn("q", _running(quotes, ALONG) % 2)
    e0, e1 = _either(q, F.col("d0"), F.col("d1")), _either(q, F.col("d1"), F.col("d0"))
    functions = rows.groupBy("file", "block").agg(F.sum("quotes").alias("b"), F.sum(e0).alias("b0"), F.sum(e1).alias("b1"))
    starts = functions.withColumn("start", _running(F.col("b"), BLOCKS) % 2)
    starts = starts.select("file", "block", "start", _running(_either(F.col("start"), F.col("b0"), F.col("b1")), BLOCKS).alias("base"))
    both = rows.withColumns({"s0": _running(e0, ALONG), "s1": _running(e1, ALONG)}).join(starts, ["file", "block"])
    inside = (q + F.col("start")) % 2
    both = both.withColumns({"inside": inside, "depth": F.col("base") + _either(F.col("start"), F.col("s0"), F.col("s1"))})
    change = _either(F.col("inside"), F.col("d0"), F.col("d1"))
    return both.select("file", "block", "pos", "value", "inside", "depth", (F.col("depth") + change).alias("after"), ((F.col("inside") + quotes) % 2 == 1).alias("open"))


def _openings(level: int) -> Column:
    """(key, at) of the arrays and objects that open at depth ``level`` in a fragment; ``at`` is the number of characters up to and with the bracket.

    A value opens behind a key and a colon, the outermost one at the beginning of the file.
    """
    parts = _parts(F.col("value"))
    bracket = r"^\s*:\s*[\[{]" if level else r"^[\s\ufeff]*[\[{]"
    state = F.struct(F.col("depth").alias("depth"), F.lit(0).alias("at"), F.lit("").alias("key"), F.array().cast("array<struct<key:string,at:int>>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        outside, text = part["i"] % 2 == F.col("inside"), part["text"]
        lead = F.length(F.regexp_extract(text, bracket, 0))
        hit = outside & (s["depth"] == level) & (lead > 0)
        more = F.array_append(s["found"], F.struct(s["key"].alias("key"), (s["at"] + lead).alias("at")))
        return F.struct(
            F.when(outside, s["depth"] + _balance(text)).otherwise(s["depth"]).alias("depth"),
            (s["at"] + F.length(text) + 1).alias("at"),
            F.when(outside, F.lit("")).otherwise(text).alias("key"),
            F.when(hit, more).otherwise(s["found"]).alias("found"),
        )

    numbered = F.transform(parts, lambda x, i: F.struct(x.alias("text"), i.cast("bigint").alias("i")))
    return F.aggregate(numbered, state, step)["found"]


def _span(rows: DataFrame, level: int, name: str) -> DataFrame:
    """(file, first, at, last): where the records of a file begin (fragment and character) and the fragment in which the next value of that depth opens, null if none does."""
    # Only fragments that start at the depth, or climb down to it over closing square brackets, can open a value there.
    may = rows.filter((F.col("depth") <= level) | F.contains("value", F.lit("]")))
    opened = store(may.select("file", F.struct("block", "pos").alias("place"), F.explode(_openings(level)).alias("o")))
    named = opened.filter(F.col("o.key") == name)
    first = named.groupBy("file").agg(F.min(F.struct("place", "o.at")).alias("f")).select("file", F.col("f.place").alias("first"), F.col("f.at").alias("at"))
    later = opened.join(first, "file").filter(F.struct("place", "o.at") > F.struct("first", "at"))
    return first.join(later.groupBy("file").agg(F.min("place").alias("last")), "file", "left")


def record_texts(spark: SparkSession, path: str | list[str], field: str | None = None) -> DataFrame:
    """(file, n, text): the records of the outermost array or object, or of the one under ``field``, in file order of ``n``; an object's record has its key before it.

    ``field`` may be a path (``results.bindings``): as many keys deep, the last one is compared; it has no escapes.  Of repeated keys the first one counts.
    """
    names = field.split(".") if field else []
    level = len(names)
    rows = store(located(store(fragments(spark, path))))
    span = _span(rows, level, names[-1] if names else "")
    place = F.struct("block", "pos")
    rows = rows.join(span, "file").filter((place >= F.col("first")) & (F.col("last").isNull() | (place < F.col("last"))))
    ends = (~F.col("open") & (F.col("after") == level + 1)).cast("bigint")
    rows = rows.select("file", "block", "pos", F.when(place == F.col("first"), F.expr("substr(value, at + 1)")).otherwise(F.col("value")).alias("value"), ends.alias("ends"))
    rows = store(rows)
    before = rows.groupBy("file", "block").agg(F.sum("ends").alias("total")).select("file", "block", _running(F.col("total"), BLOCKS).alias("base"))
    numbered = rows.withColumn("n", _running(F.col("ends"), ALONG)).join(before, ["file", "block"]).withColumn("n", F.col("n") + F.col("base"))
    # The fragments of one record; what follows the last record ends none.
    whole = numbered.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("block", "pos", "value"))).alias("cut"), F.max("ends").alias("ends")).filter("ends = 1")
    text = F.concat(F.array_join(F.transform("cut", lambda c: c["value"]), "}"), F.lit("}"))
    return whole.select("file", "n", F.regexp_replace(text, r"^\s*,", "").alias("text"))


def read_array(spark: SparkSession, path: str | list[str], entry: str, field: str | None = None) -> DataFrame:
    """(file, n, e): the objects of a JSON array, the outermost one or that under ``field``; ``entry`` is their type.

    Elements that are no objects are no records.  A file that is empty, or has no such array, gives no rows; missing keys are null, repeated rows stay.
    """
    records = record_texts(spark, path, field)
    # Elements that are no objects end no fragment, so they stand before the next object.
    last = F.element_at(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), -1)
    text = F.when(F.startswith(F.ltrim("text"), F.lit("{")), F.col("text")).otherwise(last)
    return records.select("file", "n", F.from_json(text, entry).alias("e"))


def read_map(spark: SparkSession, path: str | list[str], entry: str, field: str | None = None, key: str = "code") -> DataFrame:
    """(file, n, key, e): the entries of a JSON object, the outermost one or that under ``field``, all of whose values are objects; see :func:`read_array`."""
    records = record_texts(spark, path, field)
    parsed = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{entry}>")
    return records.select("file", "n", F.explode(parsed).alias(key, "e"))
