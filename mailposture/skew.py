"""Joins and ranks that stay parallel when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailposture.session import INITIAL_PARTITIONS, input_bytes, step


def partitions(df: DataFrame) -> int:
    """Tasks of a shuffle in this session, sized with its data by the cluster or by :func:`mailposture.session.size_tasks`."""
    conf = df.sparkSession.conf
    return max(int(conf.get("spark.sql.shuffle.partitions")), int(conf.get(INITIAL_PARTITIONS, None) or 0))


def hot_keys(df: DataFrame, on: Sequence[str], parts: int | None = None) -> DataFrame:
    """``(on, _n, _salts)`` of the keys that hold more rows than half of an even task, and into how many such portions each is cut.

    With ``parts`` tasks an even task has 1 / parts of all rows.  By counting there can be at most ``2 * parts`` such keys, so the result has a
    proven size bound and may be broadcast whatever the size of ``df``, and the number of portions grows with a key's share and with the number of tasks: no
    key is too small to be left whole in one task beyond its even share, none too large.  The counts are combined before the shuffle.
    """
    parts = parts or partitions(df)
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    portions = F.ceil(F.col("_n") * (2 * parts) / F.col("_total")).cast("int")
    # One row on the right side.
    shares = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * (2 * parts) > F.col("_total"))
    return shares.select(*on, "_n", portions.alias("_salts"))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    weigh: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` (a key may hold any share of its rows) to ``right`` (few rows per key).

    Rows of hot keys are dealt to as many sub-keys as the key has portions (:func:`hot_keys`), rows without a key to as many as there are tasks, by a hash of
    their content; only the right rows of hot keys are repeated.  The hash is a function of the row, so a recomputed task yields the same
    rows.  All other keys join as usual.  In a chain of lookups, pass the frame the chain started from as ``weigh``: the
    keys are then counted there and the joins done so far are not run again for the count.  Where several joins have one key
    distribution, count it once and pass it as ``hot``.
    """
    on = list(on)
    parts = partitions(left)
    if hot is None:
        hot = hot_keys(left if weigh is None else weigh, on, parts)
    hot = F.broadcast(hot.select(*on, "_salts"))
    content = F.xxhash64(*[F.col(c) for c in left.columns])
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    salts = F.when(no_key, F.lit(parts)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted_left = left.join(hot, on, "left").withColumn("_salt", F.pmod(content, salts).cast("int")).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def flag_join(left: DataFrame, stored: DataFrame, on: Sequence[str], weigh: DataFrame | None = None) -> DataFrame:
    """Left join to a written table with one row per key.  Where its files are below Spark's own bound for broadcasts no row of ``left`` moves; else :func:`lookup_join`."""
    spark = left.sparkSession
    bound = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if input_bytes(spark, stored.stored_at) <= bound:
        return left.join(F.broadcast(stored), list(on), "left")
    return lookup_join(left, stored, on, weigh=weigh)


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str], anti: bool = False) -> DataFrame:
    """Rows of ``left`` that have (``anti``: have not) a partner in ``right``; keys of ``left`` may hold any share of its rows.

    ``right`` is made distinct first, so it has one row per key.
    """
    partner = right.select(*on).distinct()
    if not anti:
        return lookup_join(left, partner, on, "inner").select(*left.columns)
    found = lookup_join(left, partner.withColumn("_found", F.lit(True)), on)
    return found.filter(F.col("_found").isNull()).select(*left.columns)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group in ``order``.

    A literal bound on ``row_number`` lets Spark apply the limit in every task before the shuffle, so a hot group
    sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def leading_by_share(counts: DataFrame, key: str, n: str, share: float) -> DataFrame:
    """How many of the largest groups are needed to cover ``share`` of the total, as one row ``n_leading``.

    Counts the prefix sums (starting with 0) of the counts in descending order that are below ``share`` of the total.
    Groups of equal size are handled together: there are at most ``sqrt(2 * total)`` different sizes, so the running
    sum goes over that many rows, not over the groups.
    """
    sizes = counts.groupBy(F.col(n).alias("_size")).agg(F.count(F.lit(1)).alias("_groups"))
    total = counts.agg(F.sum(n).alias("_total"))
    before = Window.orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    running = sizes.crossJoin(F.broadcast(total)).withColumn(
        "_before", F.coalesce(F.sum(F.col("_size") * F.col("_groups")).over(before), F.lit(0))
    )
    room = F.ceil((F.col("_total") * F.lit(share) - F.col("_before")) / F.col("_size"))
    taken = F.greatest(F.lit(0), F.least(F.col("_groups"), room))
    return running.agg(F.coalesce(F.sum(taken), F.lit(0)).cast("bigint").alias("n_leading"))


def rank_in_cells(df: DataFrame, keys: Sequence[str], cell: Sequence[Column], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Exact ``row_number`` per group without a window over the whole group.

    ``cell`` are leading expressions of the order (a tier, a length, a prefix), ``order`` the order inside a cell.  Rows are
    numbered inside their cell and shifted by the sizes of the earlier cells of the group, so a group that holds a large
    share of all rows is sorted by as many tasks as it has cells.
    """
    names = [f"_cell{i}" for i in range(len(cell))]
    keyed = df.withColumns(dict(zip(names, cell)))
    sizes = keyed.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    numbered = keyed.withColumn("_inside", F.row_number().over(inside)).join(offsets, [*keys, *names])
    return numbered.withColumn(rank, (F.col("_offset") + F.col("_inside")).cast("bigint")).drop("_offset", "_inside", *names)


def rank_groups(df: DataFrame, keys: Sequence[str], cell: Sequence[Column], order: Sequence[Column], rank: str = "rank", weigh: DataFrame | None = None) -> DataFrame:
    """Exact ``row_number`` per group in the order of ``cell`` and ``order``.

    A group that holds more than half of an even task's rows (:func:`hot_keys`) is ranked in cells, all others by a window over the group.  Groups are counted in ``weigh``, by
    default in ``df``.
    """
    window = Window.partitionBy(*keys).orderBy(*cell, *order)
    hot = step(hot_keys(df if weigh is None else weigh, keys).select(*keys))
    if hot.isEmpty():
        return df.withColumn(rank, F.row_number().over(window).cast("bigint"))
    hot = F.broadcast(hot)
    rest = df.join(hot, list(keys), "left_anti").withColumn(rank, F.row_number().over(window).cast("bigint"))
    return rest.unionByName(rank_in_cells(df.join(hot, list(keys), "left_semi"), keys, cell, order, rank))


def rank_by_size(counts: DataFrame, key: str, n: str, rank: str = "rank") -> DataFrame:
    """Exact position of every group by descending count, ties in the order of ``md5(key)``.

    Groups are cut into cells of equal size and equal md5 prefix; offsets are summed over the cells (at most a few
    thousand per size, and ``sqrt(2 * total)`` sizes) and the rank inside a cell comes from a window over that cell.
    No window spans all groups, and no window spans all groups of one size.
    """
    keyed = counts.withColumn("_md5", F.md5(F.col(key).cast("binary"))).withColumn("_cell", F.substring("_md5", 1, 3))
    cells = keyed.groupBy(n, "_cell").agg(F.count(F.lit(1)).alias("_in_cell"))
    size_rows = cells.groupBy(n).agg(F.sum("_in_cell").alias("_in_size"))
    larger = Window.orderBy(F.col(n).desc()).rowsBetween(Window.unboundedPreceding, -1)
    size_offset = size_rows.select(n, F.coalesce(F.sum("_in_size").over(larger), F.lit(0)).alias("_size_offset"))
    earlier = Window.partitionBy(n).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_offset = cells.withColumn("_cell_offset", F.coalesce(F.sum("_in_cell").over(earlier), F.lit(0))).drop("_in_cell")
    inside = Window.partitionBy(n, "_cell").orderBy("_md5", key)
    return (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(cell_offset, [n, "_cell"])
        .join(size_offset, n)
        .withColumn(rank, (F.col("_size_offset") + F.col("_cell_offset") + F.col("_inside")).cast("bigint"))
        .select(*counts.columns, rank)
    )
