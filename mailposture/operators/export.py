"""Flat export of provider and security rows, and the statistics over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.operators.reports import n_rows, pct, true

FLAGS = ["scan_valid", "dane_supported", "dane_partial", "has_spf", "has_good_spf", "has_dmarc", "has_good_dmarc"]
CATEGORIES = ["us-cloud", "at-based", "ch-based", "de-based", "foreign", "unknown"]


def flatten_provider(nested: DataFrame) -> DataFrame:
    """Nested provider rows as one flat row each: lists joined by ``; ``, keys of the source map, upper-case country."""

    def text(c: Column) -> Column:
        return F.coalesce(F.array_join(c, "; "), F.lit(""))

    signal = F.transform("classification_signals", lambda s: F.concat(s["kind"], F.lit(": "), s["detail"]))
    return nested.select(
        F.upper("country").alias("country"),
        "code",
        "name",
        "region",
        "domain",
        "provider",
        "category",
        F.col("classification_confidence").alias("confidence"),
        F.coalesce("gateway", F.lit("")).alias("gateway"),
        text(F.col("mx")).alias("mx"),
        F.coalesce("spf", F.lit("")).alias("spf"),
        text(signal).alias("classification_signals"),
        text(F.map_keys("sources_detail")).alias("sources"),
        text(F.col("resolve_flags")).alias("resolve_flags"),
    )


def flatten_security(nested: DataFrame) -> DataFrame:
    """Nested security rows as flat booleans, false where a group is missing."""
    return nested.select(
        F.upper("country").alias("country"),
        "code",
        "domain",
        true("scan_valid").alias("scan_valid"),
        true("dane.supported").alias("dane_supported"),
        true("dane.partial").alias("dane_partial"),
        *[true(f"dss.{m}").alias(m) for m in dims.SECURITY_METRICS[:4]],
    )


def joined_rows(providers: DataFrame, security: DataFrame) -> DataFrame:
    """Provider rows with the security row of the same country, code and domain.  (country, code) is unique."""
    flags = security.select("country", "code", "domain", *FLAGS)
    return providers.join(flags, ["country", "code", "domain"], "left")


def build_export(providers: DataFrame, security: DataFrame) -> DataFrame:
    """Flat table in the fixed column order; inputs are flat rows as from the two ``flatten`` functions."""
    return joined_rows(providers, security).select(*dims.EXPORT_COLUMNS)


def analysis_base(providers: DataFrame, security: DataFrame) -> DataFrame:
    """Joined rows that have a valid scan."""
    return joined_rows(providers, security).filter(true("scan_valid"))


def _per_country(export: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    per = export.groupBy("country").agg(n_rows().alias("total"), *[c.alias(n) for n, c in aggs.items()])
    return per.rollup("country").agg(*[F.sum(c).cast("bigint").alias(c) for c in ["total", *aggs]], F.grouping("country").alias("_all")).withColumn(
        "country", F.when(F.col("_all") == 1, "Total").otherwise(F.col("country"))
    )


def _distribution(export: DataFrame, label: str, tests: dict[str, Column]) -> DataFrame:
    names = {f"v{i}": value for i, value in enumerate(tests)}
    wide = _per_country(export, {f"v{i}": F.count_if(test) for i, test in enumerate(tests.values())})
    items = F.array(*[F.struct(F.lit(value).alias(label), F.col(c).alias("n")) for c, value in names.items()])
    rows = wide.select("country", "total", F.explode(items).alias("r")).select("country", "total", "r.*")
    return rows.withColumn("n_pct", pct("n", "total"))


def provider_distribution(export: DataFrame) -> DataFrame:
    return _distribution(export, "provider", {p: F.col("provider") == p for p in dims.OUTPUT_PROVIDERS})


def category_distribution(export: DataFrame) -> DataFrame:
    return _distribution(export, "category", {c: F.col("category") == c for c in CATEGORIES})


def security_distribution(export: DataFrame) -> DataFrame:
    return _distribution(export, "flag", {f: true(f) for f in FLAGS})


def confidence_statistics(export: DataFrame) -> DataFrame:
    """Mean, exact median, minimum and maximum per country and in total.

    Confidence has one decimal, so it is counted per value first: at most 1001 rows per country reach the median.
    """
    tenths = export.groupBy("country", "confidence").agg(n_rows().alias("n"))
    sets = tenths.rollup("country").agg(
        (F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("confidence", F.lit(0.5), F.col("n")).alias("median"),
        F.min("confidence").alias("min"),
        F.max("confidence").alias("max"),
        F.grouping("country").alias("_all"),
    )
    return sets.select(F.when(F.col("_all") == 1, "Total").otherwise(F.col("country")).alias("country"), "mean", "median", "min", "max")


def export_statistics(export: DataFrame) -> dict[str, DataFrame]:
    return {
        "providers": provider_distribution(export),
        "categories": category_distribution(export),
        "security": security_distribution(export),
        "confidence": confidence_statistics(export),
    }


