"""Analyses over evaluated mail-server rows: protocol versions, DANE, operators and their concentration.

Per-domain and per-operator results are two-level aggregates with primitive buffers, combined before the shuffle, so a
domain or operator with a large share of all servers costs one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.text import apex, first_match
from mailposture.operators.reports import n_rows
from mailposture.operators.security import AUTH_FLAGS, valid_mta
from mailposture.session import store
from mailposture.skew import leading_by_share, lookup_join, rank_by_size

MODES = ["max_all", "max_any", "min_all", "min_any"]


def version_name(ordinal: Column) -> Column:
    return first_match(((ordinal == i, F.lit(v)) for i, v in enumerate(dims.TLS_VERSIONS)), F.lit(None).cast("string"))


def tls_valid() -> Column:
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in dims.TLS_FLAGS])


def row_valid() -> Column:
    return tls_valid() & F.col("has_dane").isNotNull()


def tls_bounds(mta: DataFrame) -> DataFrame:
    """Highest and lowest protocol version per server as ordinals; no version at all is NO_STARTTLS (0)."""
    flags = list(enumerate(dims.TLS_FLAGS, start=1))
    high = F.coalesce(*[F.when(F.col(f), i) for i, f in reversed(flags)], F.lit(0))
    low = F.coalesce(*[F.when(F.col(f), i) for i, f in flags], F.lit(0))
    return mta.withColumn("max_tls", high).withColumn("min_tls", low)


def domain_counts(mta: DataFrame) -> DataFrame:
    """Domains in total, without any server, and with servers none of which has an address."""
    per = mta.groupBy("domain").agg(
        F.bool_and(F.col("mx").isNull()).alias("no_mx"), F.bool_and(F.col("mx").isNotNull() & F.col("ip").isNull()).alias("unresolved")
    )
    return per.agg(
        n_rows().alias("total"), F.count_if("no_mx").alias("without_mx"), F.count_if("unresolved").alias("no_resolvable_mx")
    )


def validity_classes(mta: DataFrame) -> DataFrame:
    """Domains with only valid, both kinds of, or no valid test results, among rows with server and address."""
    rows = mta.filter(F.col("mx").isNotNull() & F.col("ip").isNotNull())
    per = rows.groupBy("domain").agg(F.bool_and(row_valid()).alias("every"), F.bool_or(row_valid()).alias("some"))
    return per.agg(
        F.count_if("every").alias("only_valid"),
        F.count_if(F.col("some") & ~F.col("every")).alias("valid_and_invalid"),
        F.count_if(~F.col("some")).alias("no_valid"),
    )


def group_bounds(mta: DataFrame, key: str) -> DataFrame:
    """Four readings of the protocol versions of a group: highest/lowest version on all/at least one server."""
    return tls_bounds(mta).groupBy(key).agg(
        F.min("max_tls").alias("max_all"), F.max("max_tls").alias("max_any"), F.max("min_tls").alias("min_all"), F.min("min_tls").alias("min_any")
    )


def tls_modes(mta: DataFrame) -> DataFrame:
    """Domains per mode and protocol version."""
    long = group_bounds(mta, "domain").unpivot(["domain"], MODES, "mode", "ordinal")
    return long.groupBy("mode", "ordinal").agg(n_rows().alias("n")).select("mode", version_name(F.col("ordinal")).alias("version"), "n")


def mixed_tls(mta: DataFrame) -> DataFrame:
    """Domains whose servers disagree in their highest or lowest version."""
    per = tls_bounds(mta).groupBy("domain").agg(
        (F.min("max_tls") != F.max("max_tls")).alias("mixed_max"), (F.min("min_tls") != F.max("min_tls")).alias("mixed_min")
    )
    return per.filter(F.col("mixed_max") | F.col("mixed_min"))


def dane_support(mta: DataFrame, key: str = "domain") -> DataFrame:
    """DANE on all and on any server of a group; an unknown verdict counts as no."""
    ok = F.coalesce("has_dane", F.lit(False))
    return mta.groupBy(key).agg(F.bool_and(ok).alias("dane_all"), F.bool_or(ok).alias("dane_any"))


def dane_support_mx(mta: DataFrame, dane: DataFrame, key: str = "domain") -> DataFrame:
    """The same from the logs of the MX alone; ``dane`` is the result of ``security.dane_flags``."""
    rows = lookup_join(mta, dane, ["mx", "ip"])
    ok = F.coalesce("mx_dane", F.lit(False))
    return rows.groupBy(key).agg(F.bool_and(ok).alias("dane_all"), F.bool_or(ok).alias("dane_any"))


def secure_domains(mta: DataFrame) -> DataFrame:
    """Domains with DANE on all servers and at least TLS 1.2 as the highest version of all servers: one aggregate."""
    floor = dims.TLS_VERSIONS.index("TLS1_2")
    per = tls_bounds(mta).groupBy("domain").agg(
        F.bool_and(F.coalesce("has_dane", F.lit(False))).alias("dane_all"), F.min("max_tls").alias("max_all")
    )
    return per.filter(F.col("dane_all") & (F.col("max_all") >= floor)).select("domain")


def domain_auth_counts(mta: DataFrame) -> DataFrame:
    """Domains with each authentication record, by the first row of every domain."""
    first = F.min(F.struct("pos", *AUTH_FLAGS)).alias("first")
    per = mta.groupBy("domain").agg(first)
    return per.agg(*[F.count_if(F.col(f"first.{f}")).alias(f) for f in AUTH_FLAGS])


def with_operator(mta: DataFrame) -> DataFrame:
    return mta.withColumn("operator", apex(F.col("mx")))


def operator_domains(mta: DataFrame) -> DataFrame:
    """Distinct domains per operator, largest first."""
    rows = with_operator(mta).filter(F.col("operator").isNotNull())
    return rows.groupBy("operator").agg(F.count_distinct("domain").alias("domains")).orderBy(F.col("domains").desc(), "operator")


def operator_sizes(mta: DataFrame) -> DataFrame:
    rows = with_operator(mta).filter(F.col("operator").isNotNull()).select("operator", "domain").distinct()
    return rows.groupBy("operator").agg(n_rows().alias("domains"))


def concentration(sizes: DataFrame, share: float = 0.5) -> DataFrame:
    """Number of largest operators whose domains reach the share."""
    return leading_by_share(sizes, "operator", "domains", share)


def top_operators(sizes: DataFrame, share: float = 0.5) -> DataFrame:
    """The largest operators that together reach the share; equal sizes in md5 order."""
    leading = concentration(sizes, share)
    ranked = rank_by_size(sizes, "operator", "domains")
    return ranked.crossJoin(F.broadcast(leading)).filter(F.col("rank") <= F.col("n_leading")).select("operator", "domains", "rank")


def top_operator_detail(mta: DataFrame, dane: DataFrame, share: float = 0.5) -> DataFrame:
    """DANE and protocol versions of the largest operators.

    Sizes are read by several jobs and written once.  Rows shrink to one per server of an operator before the logs of the MX are looked up.
    """
    top = top_operators(store(operator_sizes(mta)), share).select("operator")
    rows = tls_bounds(with_operator(mta).filter(F.col("operator").isNotNull()))
    servers = rows.groupBy("operator", "mx", "ip").agg(
        F.min("max_tls").alias("max_all"), F.max("max_tls").alias("max_any"), F.max("min_tls").alias("min_all"), F.min("min_tls").alias("min_any")
    )
    # One row per operator and server, so no server can be hot but by the number of its operators, which is one.
    judged = servers.join(dane, ["mx", "ip"], "left")
    ok = F.coalesce("mx_dane", F.lit(False))
    versions = [F.min("max_all").alias("max_all"), F.max("max_any").alias("max_any"), F.max("min_all").alias("min_all"), F.min("min_any").alias("min_any")]
    per = judged.groupBy("operator").agg(F.bool_and(ok).alias("dane_all"), F.bool_or(ok).alias("dane_any"), *versions)
    return top.join(per, "operator").select("operator", "dane_all", "dane_any", *[version_name(F.col(m)).alias(m) for m in MODES])


def mx_count(mta: DataFrame) -> DataFrame:
    """Distinct servers; a missing server counts as one value."""
    return mta.select("mx").distinct().agg(n_rows().alias("mx_total"))


def domain_profile(mta: DataFrame, dane: DataFrame) -> DataFrame:
    """All per-domain results of a scan run from one pass and one shuffle; valid rows are selected inside the aggregates."""
    rows = tls_bounds(lookup_join(mta, dane, ["mx", "ip"]))
    placed = F.col("mx").isNotNull() & F.col("ip").isNotNull()
    valid = placed & row_valid()

    def among_valid(c: Column) -> Column:
        return F.when(valid, c)

    has_dane, mx_dane = (F.coalesce(F.col(c), F.lit(False)) for c in ("has_dane", "mx_dane"))
    return rows.groupBy("domain").agg(
        F.bool_and(F.col("mx").isNull()).alias("no_mx"),
        F.bool_and(F.col("mx").isNotNull() & F.col("ip").isNull()).alias("unresolved"),
        F.bool_and(F.when(placed, row_valid())).alias("every"),
        F.bool_or(F.when(placed, row_valid())).alias("some"),
        F.bool_or(valid).alias("has_valid"),
        F.min(among_valid(F.col("max_tls"))).alias("max_all"),
        F.max(among_valid(F.col("max_tls"))).alias("max_any"),
        F.max(among_valid(F.col("min_tls"))).alias("min_all"),
        F.min(among_valid(F.col("min_tls"))).alias("min_any"),
        F.bool_and(among_valid(has_dane)).alias("dane_all"),
        F.bool_or(among_valid(has_dane)).alias("dane_any"),
        F.bool_and(among_valid(mx_dane)).alias("dane_all_mx"),
        F.bool_or(among_valid(mx_dane)).alias("dane_any_mx"),
        F.min(F.struct("pos", *AUTH_FLAGS)).alias("first"),
    )


def run_evaluation(mta: DataFrame, dane: DataFrame) -> DataFrame:
    """One row with all counts of a scan run: all rows for totals, valid rows for everything else.

    Three passes over the servers: per domain, per operator, distinct servers.
    """
    floor = dims.TLS_VERSIONS.index("TLS1_2")
    versions = [F.count_if(F.col(m) == i).alias(f"{m}_{v.lower()}") for m in MODES for i, v in enumerate(dims.TLS_VERSIONS)]
    domains = domain_profile(mta, dane).agg(
        n_rows().alias("total"),
        F.count_if("no_mx").alias("without_mx"),
        F.count_if("unresolved").alias("no_resolvable_mx"),
        F.count_if("every").alias("only_valid"),
        F.count_if(F.col("some") & ~F.col("every")).alias("valid_and_invalid"),
        F.count_if(~F.col("some")).alias("no_valid"),
        F.count_if("has_valid").alias("valid_domains"),
        *versions,
        F.count_if(F.col("max_all") != F.col("max_any")).alias("mixed_max"),
        F.count_if(F.col("min_all") != F.col("min_any")).alias("mixed_min"),
        *[F.count_if(c).alias(c) for c in ("dane_all", "dane_any", "dane_all_mx", "dane_any_mx")],
        F.count_if(F.col("dane_all") & (F.col("max_all") >= floor)).alias("secure_domains"),
        *[F.count_if(F.col(f"first.{f}")).alias(f) for f in AUTH_FLAGS],
    )
    sizes = operator_sizes(valid_mta(mta))
    operators = sizes.agg(n_rows().alias("operators"), F.coalesce(F.sum("domains"), F.lit(0)).alias("operator_domains"))
    half = concentration(sizes).withColumnRenamed("n_leading", "operators_half")
    # Every part is an aggregate without keys, hence one row.
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [domains, operators, half, mx_count(mta)])
