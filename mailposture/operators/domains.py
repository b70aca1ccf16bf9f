"""Split host names by the list of public suffixes."""

from __future__ import annotations

from functools import lru_cache
from importlib import resources
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailposture.functions.text import registered_label, subdomain

#: The official part of the public suffix list as this package carries it, with its licence in the first lines.
LIST_RESOURCE = "public_suffix_list.dat"
PRIVATE = "===BEGIN PRIVATE DOMAINS==="
#: Session setting with the path of another list, in any store that Spark reads.
LIST_SETTING = "spark.mailposture.suffixList"


@lru_cache(4)
def listed_rules(path: str | None = None) -> tuple[str, ...]:
    """Rules of a list's official part, from a file that the driver can open; by default of the list in this package."""
    source = Path(path) if path else resources.files("mailposture.data").joinpath(LIST_RESOURCE)
    lines = (line.strip() for line in source.read_text(encoding="utf-8").split(PRIVATE)[0].splitlines())
    return tuple(line.split()[0] for line in lines if line and not line.startswith("//"))


def suffix_table(spark: SparkSession, suffixes: list[str] | None = None, path: str | None = None) -> DataFrame:
    """One-column table of rules, ``*.`` and ``!`` included: those given, else those of the list at ``path`` or at the path that the session names, else
    the list of this package.  A list that is named and missing is an error."""
    path = path or spark.conf.get(LIST_SETTING, None)
    if suffixes is None and path:
        text = spark.read.text(path, wholetext=True).select(F.split_part("value", F.lit(PRIVATE), F.lit(1)).alias("text"))
        line = text.select(F.explode(F.split("text", r"\R")).alias("line")).select(F.trim("line").alias("line"))
        return line.filter((F.col("line") != "") & ~F.col("line").startswith("//")).select(F.split("line", r"\s+")[0].alias("suffix"))
    return spark.createDataFrame(pa.table({"suffix": pa.array(listed_rules() if suffixes is None else suffixes, pa.string())}))


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """(tld, plain, wild, exempt, depth): all rules that end in a label, by kind, as arrays of tails, and the most labels of one.

    ``*.ck`` makes any label before ``ck`` part of the suffix, ``!www.ck`` exempts ``www.ck`` from that.
    """
    rule = F.lower(F.trim("suffix"))
    kinds = suffixes.filter(rule != "").select(
        F.regexp_replace(rule, r"^(\*\.|!)", "").alias("tail"), F.startswith(rule, F.lit("*.")).alias("wild"), F.startswith(rule, F.lit("!")).alias("exempt")
    )
    tails = lambda which: F.collect_set(F.when(which, F.col("tail")))
    return kinds.groupBy(F.substring_index("tail", ".", -1).alias("tld")).agg(
        tails(~F.col("wild") & ~F.col("exempt")).alias("plain"),
        tails(F.col("wild")).alias("wild"),
        tails(F.col("exempt")).alias("exempt"),
        F.max(F.size(F.split("tail", r"\."))).alias("depth"),
    )


def split_domain(df: DataFrame, domain: str, suffixes: DataFrame | None = None) -> DataFrame:
    """Add ``suffix`` (longest by the rules, '' when none), ``label`` and ``sub`` of a host name.

    ``suffixes`` is a table of rules as of :func:`suffix_table`, by default the full list.  It is joined once, on the last label, whatever the depth of its rules: a row of
    the other side has all rules under that label, and the tails of a name are looked up in them, the exceptions first, then from the longest tail to the
    shortest.  Spark broadcasts it when its size allows, then nothing of ``df`` is shuffled; a larger table is joined by shuffle with the same result.
    """
    spark = df.sparkSession
    if suffixes is None and not spark.conf.get(LIST_SETTING, None):
        rules, depth = suffix_rules(suffix_table(spark)), max(r.lstrip("*!.").count(".") + 1 for r in listed_rules())
    else:
        rules = suffix_rules(suffix_table(spark) if suffixes is None else suffixes)
        depth = rules.agg(F.max("depth").alias("n")).first().n or 0
    kinds = ("plain", "wild", "exempt")
    # Columns of their own below the join: every rule asks for them, and an expression would run again for each.
    host, size = F.col("_host"), F.col("_labels")
    out = df.withColumn("_host", F.lower(F.col(domain))).withColumn("_labels", F.length("_host") - F.length(F.replace("_host", F.lit("."), F.lit(""))) + 1)
    rules = rules.select(F.col("tld").alias("_tld"), *(F.col(k).alias(f"_{k}") for k in kinds))
    out = out.join(rules, F.substring_index(host, ".", -1) == F.col("_tld"), "left")

    def tail(n: int) -> Column:
        return F.substring_index(host, ".", -n)

    def ruled(kind: str, n: int) -> Column:
        """Whether the last ``n`` labels are a rule; a shorter name has no such tail."""
        return (size >= n) & F.array_contains(f"_{kind}", tail(n))

    options = [F.when(ruled("exempt", n), tail(n - 1)) for n in range(depth, 1, -1)]
    for n in range(depth + 1, 0, -1):
        if n > 1:
            options.append(F.when(ruled("wild", n - 1) & (size >= n), tail(n)))
        if n <= depth:
            options.append(F.when(ruled("plain", n), tail(n)))
    out = out.withColumn("suffix", F.coalesce(*options, F.lit(""))).drop("_tld", "_host", "_labels", *(f"_{k}" for k in kinds))
    return out.withColumn("label", registered_label(F.col(domain), F.col("suffix"))).withColumn("sub", subdomain(F.col(domain), F.col("suffix")))
