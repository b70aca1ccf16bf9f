"""Report tables over the provider, signal and security tables.

Every report combines before the shuffle and returns raw counts plus unrounded percentages (``*_pct``); use
:func:`rounded` for display.  Fixed label sets (providers, buckets, metrics) become conditional counts in one
aggregate that is turned into rows afterwards, so labels without entities appear with 0 and no join is needed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.labels import (
    category,
    chart_group,
    confidence_level,
    effective_category,
    ratio,
    region_abbr,
    region_display,
    region_name,
    security_class,
)
from mailposture.functions.text import classify_host, first_match, mx_operator, spf_delegations
from mailposture.operators.classify import BIT
from mailposture.skew import top_per_group

ENTITY = ["country", "code"]


def n_rows() -> Column:
    return F.count(F.lit(1))


def pct(part: Column | str, whole: Column | str) -> Column:
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return ratio(part, whole) * 100


def rounded(df: DataFrame, digits: int = 1) -> DataFrame:
    """Display form: percentages and averages rounded half-even."""
    return df.withColumns(
        {c: F.bround(c, digits) for c in df.columns if c.endswith(("_pct", "_pp", "avg_conf"))}
    )


def has_gateway() -> Column:
    return F.coalesce("gateway", F.lit("")) != ""


def provider_counts() -> list[Column]:
    return [F.count_if(F.col("provider") == p).alias(p) for p in dims.OUTPUT_PROVIDERS]


def as_rows(df: DataFrame, label: str, value: str, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """One row per column of a one-row (or few-row) aggregate, in the given order."""
    items = [F.struct(F.lit(c).alias(label), F.col(c).alias(value)) for c in columns]
    return df.select(*keep, F.explode(F.array(*items)).alias("_r")).select(*keep, f"_r.{label}", f"_r.{value}")


def us_cloud() -> Column:
    return F.col("microsoft") + F.col("google") + F.col("aws")


def with_totals(base: DataFrame, sums: list[str], grand_region: str) -> DataFrame:
    """(country, region) rows plus a total per country and a grand total, from already grouped rows."""
    rolled = base.rollup("country", "region").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in sums], F.grouping_id().alias("_level")
    )
    return rolled.select(
        F.when(F.col("_level") == 3, "ALL").otherwise(F.upper("country")).alias("country"),
        F.when(F.col("_level") == 3, grand_region).when(F.col("_level") == 1, "Total").otherwise(F.col("region")).alias("region"),
        *sums,
    )


def ordered_regions(df: DataFrame, *inside: Column) -> DataFrame:
    """Countries in report order, regions by ``inside``, totals behind their regions, the grand total last."""
    place = first_match(((F.col("country") == cc.upper(), F.lit(i)) for i, cc in enumerate(dims.COUNTRIES)), F.lit(9))
    return df.orderBy(place, F.col("region").isin("Total"), *inside, "country", "region")


# --- providers ----------------------------------------------------------------------------------------------------


def provider_summary(providers: DataFrame) -> DataFrame:
    """Entities and share per provider, all providers in fixed order."""
    counts = providers.agg(n_rows().alias("total"), *provider_counts())
    rows = as_rows(counts, "provider", "n", dims.OUTPUT_PROVIDERS, ["total"])
    return rows.select("provider", "n", "total", pct("n", "total").alias("n_pct"))


def category_summary(providers: DataFrame) -> DataFrame:
    """Entities and share of US cloud and domestic hosting."""
    cat = category(F.col("provider"), F.col("country"))
    domestic = cat == F.concat(F.col("country"), F.lit("-based"))
    counts = providers.agg(
        n_rows().alias("total"), F.count_if(cat == "us-cloud").alias("us-cloud"), F.count_if(domestic).alias("domestic")
    )
    rows = as_rows(counts.withColumnRenamed("us-cloud", "us_cloud"), "category", "n", ["us_cloud", "domestic"], ["total"])
    return rows.select(F.replace("category", F.lit("_"), F.lit("-")).alias("category"), "n", "total", pct("n", "total").alias("n_pct"))


def distribution(providers: DataFrame) -> DataFrame:
    """Entities per (category, provider)."""
    return providers.groupBy("category", "provider").agg(n_rows().alias("n"))


def regional_providers(providers: DataFrame) -> DataFrame:
    """Providers per region, with the US share and its complement."""
    region = region_abbr(F.col("region"), F.col("country"))
    counts = providers.groupBy("country", region.alias("region")).agg(n_rows().alias("total"), *provider_counts())
    return counts.withColumn("us_pct", pct(us_cloud(), "total")).withColumn("non_us_pct", F.lit(100.0) - F.col("us_pct"))


def confidence_histogram(providers: DataFrame) -> DataFrame:
    """Entities per confidence range; ranges are half-open except for the top one."""
    c = F.col("confidence")
    labels, aggs = [], [n_rows().alias("total")]
    for lo, hi in dims.CONFIDENCE_BUCKETS:
        labels.append(f"{lo}-{hi}%")
        inside = (c >= lo) & ((c <= hi) if hi == 100 else (c < hi))
        aggs.append(F.count_if(inside).alias(labels[-1]))
    rows = as_rows(providers.agg(*aggs), "bucket", "n", labels, ["total"])
    return rows.select("bucket", "n", "total", pct("n", "total").alias("n_pct"))


def confidence_by_provider(providers: DataFrame) -> DataFrame:
    return providers.groupBy("provider").agg(
        n_rows().alias("n"),
        F.avg("confidence").alias("avg_conf"),
        F.min("confidence").alias("min_conf"),
        F.count_if(F.col("confidence") < dims.LOW_CONFIDENCE).alias("low"),
    )


def kind_bit(kind: Column) -> Column:
    return first_match(((kind == k, F.lit(b)) for k, b in BIT.items()), F.lit(0))


def kinds_text(mask: Column) -> Column:
    """Sorted kinds of a mask joined by ``+``; '' for none."""
    return F.concat_ws("+", *[F.when(mask.bitwiseAND(F.lit(BIT[k])) != 0, k) for k in sorted(BIT)])


def entity_kinds(signals: DataFrame) -> DataFrame:
    """Signal kinds per entity as a bit mask: a few bytes per entity, combined before the shuffle."""
    return signals.groupBy(*ENTITY).agg(F.bit_or(kind_bit(F.col("kind"))).alias("kinds"))


def signal_coverage(providers: DataFrame, signals: DataFrame) -> DataFrame:
    """Entities that have each kind, and their share of all entities."""
    total = providers.agg(n_rows().alias("total"))
    counts = entity_kinds(signals).agg(
        *[F.count_if(F.col("kinds").bitwiseAND(F.lit(bit)) != 0).alias(kind) for kind, bit in BIT.items()]
    )
    rows = as_rows(counts, "kind", "n", list(BIT)).filter(F.col("n") > 0)
    return rows.crossJoin(F.broadcast(total)).select("kind", "n", "total", pct("n", "total").alias("n_pct"))


def signal_combos(signals: DataFrame, k: int = 15) -> DataFrame:
    """The most frequent combinations of kinds.  There are at most ``2 ** 11`` combinations."""
    counts = entity_kinds(signals).groupBy("kinds").agg(n_rows().alias("n"))
    return counts.select(kinds_text(F.col("kinds")).alias("combo"), "n").orderBy(F.col("n").desc(), "combo").limit(k)


def sparse_signal_entities(providers: DataFrame, signals: DataFrame) -> DataFrame:
    """Entities with one kind of signal or none."""
    joined = providers.join(entity_kinds(signals), ENTITY, "left")
    kinds = F.coalesce("kinds", F.lit(0))
    return joined.filter(F.bit_count(kinds) <= 1).select(
        *ENTITY, "name", "provider", F.bit_count(kinds).alias("n_kinds"), kinds_text(kinds).alias("kinds")
    )


def gateway_share(providers: DataFrame) -> DataFrame:
    counts = providers.agg(n_rows().alias("total"), F.count_if(has_gateway()).alias("with_gateway"))
    return counts.withColumn("gateway_pct", pct("with_gateway", "total"))


def gateway_counts(providers: DataFrame) -> DataFrame:
    return providers.filter(has_gateway()).groupBy("gateway").agg(n_rows().alias("n"))


def gateway_report(providers: DataFrame) -> DataFrame:
    """Providers of entities with and without a gateway, with shares inside each group."""
    gw = has_gateway()
    aggs = [F.count_if(gw).alias("_w"), F.count_if(~gw).alias("_o")]
    for p in dims.OUTPUT_PROVIDERS:
        aggs += [F.count_if(gw & (F.col("provider") == p)).alias(f"w_{p}"), F.count_if(~gw & (F.col("provider") == p)).alias(f"o_{p}")]
    items = [
        F.struct(F.lit(p).alias("provider"), F.col(f"w_{p}").alias("with_gateway"), F.col(f"o_{p}").alias("without_gateway"))
        for p in dims.OUTPUT_PROVIDERS
    ]
    rows = providers.agg(*aggs).select("_w", "_o", F.explode(F.array(*items)).alias("r")).select("_w", "_o", "r.*")
    return rows.select(
        "provider",
        "with_gateway",
        pct("with_gateway", "_w").alias("with_pct"),
        "without_gateway",
        pct("without_gateway", "_o").alias("without_pct"),
    )


def shared_domains(providers: DataFrame, names: int = 4) -> DataFrame:
    """Domains used by several entities: count, provider of the first, first names, number of further ones.

    A domain may be used by any share of all entities; only its first few rows leave each task.
    """
    rows = providers.filter(F.coalesce("domain", F.lit("")) != "").select("country", "domain", "code", "name", "provider")
    key = ["country", "domain"]
    counts = rows.groupBy(*key).agg(n_rows().alias("n")).filter(F.col("n") > 1)
    first = top_per_group(rows, key, [F.col("code"), F.col("name")], names)
    listed = first.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "name", "provider"))).alias("first")
    )
    return counts.join(listed, key).select(
        *key,
        "n",
        F.get("first", F.lit(0))["provider"].alias("provider"),
        F.array_join(F.transform("first", lambda x: x["name"]), ", ").alias("names"),
        F.greatest(F.col("n") - names, F.lit(0)).alias("more"),
    )


def low_confidence(providers: DataFrame, signals: DataFrame, limit: float = dims.LOW_CONFIDENCE) -> DataFrame:
    """Entities below the limit, lowest first, with their kinds of signals."""
    low = providers.filter(F.col("confidence") < limit)
    joined = low.join(entity_kinds(signals), ENTITY, "left")
    return joined.select(
        *ENTITY,
        "name",
        region_abbr(F.col("region"), F.col("country")).alias("region"),
        "provider",
        "confidence",
        kinds_text(F.coalesce("kinds", F.lit(0))).alias("kinds"),
    ).orderBy("confidence", *ENTITY)


def signal_conflicts(providers: DataFrame, signals: DataFrame) -> DataFrame:
    """Primary signals that point at another provider than the winner, per (entity, other provider)."""
    primary = signals.filter(F.col("kind").isin(dims.PRIMARY_KINDS))
    masks = primary.groupBy(*ENTITY, F.col("provider").alias("other")).agg(F.bit_or(kind_bit(F.col("kind"))).alias("kinds"))
    joined = masks.join(providers.select(*ENTITY, "name", "provider"), ENTITY)
    return joined.filter(F.col("other") != F.col("provider")).select(
        *ENTITY, "name", "provider", "other", F.bit_count("kinds").alias("n_kinds"), kinds_text(F.col("kinds")).alias("kinds")
    )


def top_conflicts(conflicts: DataFrame, k: int = 20) -> DataFrame:
    return conflicts.orderBy(F.col("n_kinds").desc(), *ENTITY, "other").limit(k)


def combined_providers(providers: DataFrame) -> DataFrame:
    """Providers per (country, region) with totals per country and overall."""
    region = region_name(F.col("region"))
    base = providers.groupBy("country", region.alias("region")).agg(n_rows().alias("total"), *provider_counts())
    rows = with_totals(base, ["total", *dims.OUTPUT_PROVIDERS], "Grand Total").withColumn("us_cloud", us_cloud())
    return rows.withColumn("us_pct", pct("us_cloud", "total")).withColumn("dom_pct", pct("domestic", "total"))


def country_label(total: Column) -> Column:
    names = first_match(((F.col("country") == cc, F.lit(n)) for cc, n in dims.COUNTRY_NAMES.items()), F.col("country"))
    return F.when(total, "Total").otherwise(names)


def country_overview(providers: DataFrame) -> DataFrame:
    """Providers, confidence and gateways per country and in total."""
    base = providers.groupBy("country").agg(
        n_rows().alias("total"),
        *provider_counts(),
        F.sum("confidence").alias("conf_sum"),
        F.count_if(F.col("confidence") < dims.LOW_CONFIDENCE).alias("low_conf"),
        F.count_if(has_gateway()).alias("gw"),
    )
    sums = ["total", *dims.OUTPUT_PROVIDERS, "low_conf", "gw"]
    rolled = base.rollup("country").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in sums], F.sum("conf_sum").alias("conf_sum"), F.grouping("country").alias("_all")
    )
    return rolled.select(
        country_label(F.col("_all") == 1).alias("country"),
        "total",
        *dims.OUTPUT_PROVIDERS,
        pct(us_cloud(), "total").alias("us_pct"),
        pct("domestic", "total").alias("dom_pct"),
        ratio(F.col("conf_sum"), F.col("total")).alias("avg_conf"),
        "low_conf",
        pct("gw", "total").alias("gw_pct"),
    )


def level_counts(providers: DataFrame) -> DataFrame:
    """Entities per category and confidence level; entities without a category count as insufficient."""
    cat = effective_category(F.col("category"), F.col("country"))
    level = F.when(cat.isNotNull(), confidence_level(F.coalesce("confidence", F.lit(0.0)))).otherwise("insufficient")
    return providers.groupBy(F.coalesce(cat, F.lit("insufficient")).alias("category"), level.alias("level")).agg(n_rows().alias("n"))


def dedup_signals(signals: DataFrame) -> DataFrame:
    """Repeated (kind, detail) of an entity collapsed into one row with a count."""
    return signals.groupBy(*ENTITY, "kind", "detail").agg(
        F.min_by("provider", "pos").alias("provider"), F.max("weight").alias("weight"), n_rows().alias("n")
    )


def delegation_table(providers: DataFrame, provider_mx: DataFrame) -> DataFrame:
    """Every MX host and SPF delegation of an entity with the vendor behind it."""
    mx = provider_mx.filter(F.col("host").isNotNull()).select(*ENTITY, F.lit("mx").alias("via"), "host")
    spf = providers.select(*ENTITY, F.lit("spf").alias("via"), F.explode(spf_delegations(F.col("spf"))).alias("host"))
    hosts = mx.unionByName(spf)
    vendor = first_match(
        ((F.col("country") == cc, classify_host(F.col("host"), tlds)) for cc, tlds in dims.DOMESTIC_TLDS.items()),
        classify_host(F.col("host"), []),
    )
    return hosts.select(*ENTITY, "via", "host", vendor.alias("v")).select(*ENTITY, "via", "host", "v.vendor", "v.vendor_category")


def latest_generation(meta: DataFrame) -> DataFrame:
    """Newest ``generated`` over several stage files and its commit."""
    last = F.max(F.struct("generated", "commit"))
    return meta.filter(F.coalesce("generated", F.lit("")) != "").agg(last.alias("m")).select("m.generated", "m.commit")


def stage_dates(meta: DataFrame) -> DataFrame:
    """Date of the last run per stage, one column per country."""
    day = F.substring("generated", 1, 10)
    return meta.groupBy("stage").agg(
        *[F.coalesce(F.max(F.when(F.col("country") == cc, day)), F.lit("—")).alias(cc) for cc in dims.COUNTRIES]
    )


# --- security -----------------------------------------------------------------------------------------------------

SUMMARY_METRICS = ["has_spf", "has_good_spf", "has_dmarc", "has_good_dmarc", "dane_supported", "dane_partial"]
SHORT = {"has_spf": "spf", "has_good_spf": "good_spf", "has_dmarc": "dmarc", "has_good_dmarc": "good_dmarc", "dane_supported": "dane"}


def true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def valid_scans(security: DataFrame) -> DataFrame:
    return security.filter(true("scan_valid"))


def metric_counts(names: dict[str, str] | list[str]) -> list[Column]:
    names = names if isinstance(names, dict) else {n: n for n in names}
    return [F.count_if(true(c)).alias(short) for c, short in names.items()]


def security_summary(security: DataFrame) -> DataFrame:
    counts = valid_scans(security).agg(n_rows().alias("total"), *metric_counts(SUMMARY_METRICS))
    rows = as_rows(counts, "metric", "n", SUMMARY_METRICS, ["total"])
    return rows.select("metric", "n", "total", pct("n", "total").alias("n_pct"))


def regional_security(security: DataFrame) -> DataFrame:
    region = region_abbr(F.col("region"), F.col("country"))
    rows = valid_scans(security).groupBy("country", region.alias("region")).agg(n_rows().alias("total"), *metric_counts(SHORT))
    return rows.withColumns({f"{m}_pct": pct(m, "total") for m in SHORT.values()})


def combined_security(security: DataFrame) -> DataFrame:
    """Security metrics per (country, region) with totals."""
    region = region_name(F.col("region"))
    base = valid_scans(security).groupBy("country", region.alias("region")).agg(n_rows().alias("total"), *metric_counts(SHORT))
    rows = with_totals(base, ["total", *SHORT.values()], "Grand Total")
    return rows.withColumns({f"{m}_pct": pct(m, "total") for m in SHORT.values()})


def security_overview(security: DataFrame) -> DataFrame:
    base = valid_scans(security).groupBy("country").agg(n_rows().alias("total"), *metric_counts(SHORT))
    rolled = base.rollup("country").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ["total", *SHORT.values()]], F.grouping("country").alias("_all")
    )
    rows = rolled.select(country_label(F.col("_all") == 1).alias("country"), "total", *SHORT.values())
    return rows.withColumns({f"{m}_pct": pct(m, "total") for m in SHORT.values()})


def merged_regional(providers: DataFrame, security: DataFrame) -> DataFrame:
    """Providers and security side by side per (country, region), with totals; both sides are grouped before the join."""
    region = region_display(F.col("region")).alias("region")
    prov = providers.groupBy("country", region).agg(n_rows().alias("total"), *provider_counts())
    sec = valid_scans(security).groupBy("country", region).agg(n_rows().alias("sec_total"), *metric_counts(SHORT))
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["sec_total", *SHORT.values()]}
    base = prov.join(sec, ["country", "region"], "left").withColumns(zeros)
    rows = with_totals(base, ["total", *dims.OUTPUT_PROVIDERS, "sec_total", *SHORT.values()], "Grand Tot.")
    return (
        rows.withColumn("us_cloud", us_cloud())
        .withColumn("us_pct", pct("us_cloud", "total"))
        .withColumn("dom_pct", pct("domestic", "total"))
        .withColumns({f"{m}_pct": pct(m, "sec_total") for m in SHORT.values()})
    )


def security_class_counts(security: DataFrame) -> DataFrame:
    """Entities per security class, ``no-data`` without a valid scan."""
    has_dss = F.col("has_spf").isNotNull()
    cls = security_class(F.col("scan_valid"), has_dss, F.col("has_good_spf"), F.col("has_good_dmarc"))
    return security.groupBy(F.coalesce(cls, F.lit("no-data")).alias("class")).agg(n_rows().alias("n"))


# --- comparisons over the analysis base (export rows with a valid scan) -------------------------------------------


def metric_profile(df: DataFrame, keys: list, floor: int = 1) -> DataFrame:
    """Size and security percentages per group, groups of at least ``floor`` entities."""
    rows = df.groupBy(*keys).agg(n_rows().alias("n"), *metric_counts(dims.SECURITY_METRICS)).filter(F.col("n") >= floor)
    return rows.withColumns({f"{m}_pct": pct(m, "n") for m in dims.SECURITY_METRICS})


def provider_country_security(base: DataFrame, floor: int = 10) -> DataFrame:
    return metric_profile(base.filter(F.col("provider").isin("microsoft", "domestic")), ["provider", "country"], floor)


def cloud_advantage(base: DataFrame) -> DataFrame:
    """Good-SPF lead of the Microsoft group over the domestic group per country, in percentage points."""
    ms, dom = F.col("provider") == "microsoft", F.col("provider") == "domestic"
    good = true("has_good_spf")
    rows = base.groupBy("country").agg(
        F.count_if(ms).alias("_m"), F.count_if(ms & good).alias("_mg"), F.count_if(dom).alias("_d"), F.count_if(dom & good).alias("_dg")
    )
    return rows.select("country", (pct("_mg", "_m") - pct("_dg", "_d")).alias("advantage_pp"))


def high_dmarc_groups(base: DataFrame, floor: int = 10, above: float = 15.0) -> DataFrame:
    groups = metric_profile(base.filter(F.col("provider").isin("microsoft", "domestic", "foreign", "unknown")), ["provider", "country"], floor)
    return groups.filter(F.bround("has_good_dmarc_pct", 1) > above).select("provider", "country", "n", "has_good_dmarc_pct")


def gateway_prevalence(base: DataFrame) -> DataFrame:
    rows = base.groupBy("country").agg(n_rows().alias("n"), F.count_if(has_gateway()).alias("with_gateway"))
    return rows.withColumn("gateway_pct", pct("with_gateway", "n"))


def gateway_effect(base: DataFrame) -> DataFrame:
    """Security of entities with and without a gateway, per country and overall (country ALL)."""
    per = base.groupBy("country", has_gateway().alias("has_gateway")).agg(n_rows().alias("n"), *metric_counts(dims.SECURITY_METRICS))
    sums = ["n", *dims.SECURITY_METRICS]
    every = per.groupBy(F.lit("ALL").alias("country"), "has_gateway").agg(*[F.sum(c).cast("bigint").alias(c) for c in sums])
    rows = per.unionByName(every)
    return rows.withColumns({f"{m}_pct": pct(m, "n") for m in dims.SECURITY_METRICS})


def gateway_delta(base: DataFrame) -> DataFrame:
    """Difference with minus without a gateway per metric, in percentage points."""
    gw = has_gateway()
    metrics = dims.SECURITY_METRICS[:4]
    aggs = [F.count_if(gw).alias("_w"), F.count_if(~gw).alias("_o")]
    for m in metrics:
        aggs += [F.count_if(gw & true(m)).alias(f"w_{m}"), F.count_if(~gw & true(m)).alias(f"o_{m}")]
    one = base.agg(*aggs).select(*[(pct(f"w_{m}", "_w") - pct(f"o_{m}", "_o")).alias(m) for m in metrics])
    return as_rows(one, "metric", "delta_pp", metrics)


def gateway_profiles(base: DataFrame, floor: int = 20) -> DataFrame:
    return metric_profile(base.filter(F.trim(F.coalesce("gateway", F.lit(""))) != ""), ["gateway"], floor)


def operator_profiles(base: DataFrame, floor: int = 20) -> DataFrame:
    """Security per operator of domestically hosted entities; ``mx`` is the first MX host or the joined list."""
    label = F.coalesce(mx_operator(F.col("mx")), F.lit("other")).alias("operator")
    rows = base.filter(F.col("provider") == "domestic").select("*", label).filter(F.col("operator") != "other")
    return metric_profile(rows, ["operator"], floor)


def regional_rates_long(export: DataFrame, floor: int = 5) -> DataFrame:
    """Security rates per region and provider group, one row per metric."""
    valid = valid_scans(export).withColumn("group", chart_group(F.col("category"))).filter(F.col("group") != "Other")
    rows = valid.groupBy("country", "group", "region").agg(n_rows().alias("n"), *metric_counts(dims.SECURITY_METRICS)).filter(F.col("n") >= floor)
    rates = rows.select("country", "group", "region", *[pct(m, "n").alias(m) for m in dims.SECURITY_METRICS])
    return rates.unpivot(["country", "group", "region"], dims.SECURITY_METRICS, "metric", "value")


def rate_quartiles(rates: DataFrame) -> DataFrame:
    """Box-plot summary per country, group and metric.  Its input has one row per region, so exact quartiles are small."""
    keys = ["country", "group", "metric"]
    rows = rates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("value", F.lit(0.25)).alias("q1"),
        F.percentile("value", F.lit(0.5)).alias("median"),
        F.percentile("value", F.lit(0.75)).alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    fences = rows.withColumn("_lo", F.col("q1") - iqr * 1.5).withColumn("_hi", F.col("q3") + iqr * 1.5)
    inside = F.col("value").between(F.col("_lo"), F.col("_hi"))
    whiskers = rates.join(fences, keys).groupBy(*keys).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high")
    )
    return fences.drop("_lo", "_hi").join(whiskers, keys)
