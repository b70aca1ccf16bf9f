"""Column functions for providers, categories, regions and security labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.text import lookup


def output_provider(provider: Column) -> Column:
    """Provider name used in outputs."""
    return F.when(provider == "ms365", "microsoft").otherwise(provider)


def category(provider: Column, country: Column) -> Column:
    """``us-cloud``, ``{country}-based``, ``foreign`` or ``unknown``."""
    return (
        F.when(provider.isin(dims.US_CLOUD), "us-cloud")
        .when(provider == "domestic", F.concat(country, F.lit("-based")))
        .when(provider == "foreign", "foreign")
        .otherwise("unknown")
    )


def output_confidence(confidence: Column) -> Column:
    """Confidence in percent with one decimal, half-even."""
    return F.bround(confidence * 100, 1)


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, half-even; 0 for an empty whole."""
    return F.when(whole > 0, F.bround(part / whole * 100, 1)).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """Unrounded share; 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def region_abbr(region: Column, country: Column) -> Column:
    """Upper-case abbreviation of a known region, else its first four characters, else ``??``."""
    known = F.lit(None).cast("string")
    for cc, table in dims.REGION_ABBREVIATIONS.items():
        known = F.when(country == cc, lookup(region, {k: v.upper() for k, v in table.items()})).otherwise(known)
    return F.coalesce(known, F.when(F.coalesce(region, F.lit("")) != "", F.substring(region, 1, 4)), F.lit("??"))


def _region_text(region: Column) -> Column:
    return F.when(F.coalesce(region, F.lit("")) == "", "??").otherwise(region)


def region_name(region: Column) -> Column:
    """Region without the canton prefix, cut to 17 characters and a dot when longer than 18."""
    name = F.regexp_replace(_region_text(region), "^Kanton ", "")
    cut = dims.MAX_REGION_LENGTH
    return F.when(F.length(name) > cut, F.concat(F.substring(name, 1, cut - 1), F.lit("."))).otherwise(name)


def region_display(region: Column) -> Column:
    """Region without the canton prefix, in the short form of the printed tables."""
    name = F.regexp_replace(_region_text(region), "^Kanton ", "")
    return lookup(name, dims.REGION_DISPLAY, name)


def region_by_prefix(code: Column, country: str) -> Column:
    """Region from the leading digits of a code; ``??(prefix)`` when unknown."""
    prefix = F.substring(code, 1, dims.PREFIX_LENGTH[country])
    return lookup(prefix, dims.REGION_BY_PREFIX[country], F.concat(F.lit("??("), prefix, F.lit(")")))


def regional_domain(region: Column, country: Column) -> Column:
    """Mail domain shared by the members of a region; null where there is none."""
    cantons = {name: f"{abbr}.ch" for name, abbr in dims.REGION_ABBREVIATIONS["ch"].items()}
    return F.when(country == "ch", lookup(region, cantons)).when(
        country == "at", lookup(region, dims.AT_REGION_SUFFIX)
    )


def confidence_level(confidence: Column) -> Column:
    return (
        F.when(confidence >= 75, "high").when(confidence >= 50, "medium").when(confidence >= 25, "low")
    ).otherwise("insufficient")


def effective_category(cat: Column, country: Column) -> Column:
    """``domestic``, ``us-cloud`` or ``foreign``; null for everything else."""
    return F.when(cat == F.concat(country, F.lit("-based")), "domestic").when(cat.isin("us-cloud", "foreign"), cat)


def security_class(scan_valid: Column, has_dss: Column, good_spf: Column, good_dmarc: Column) -> Column:
    """``both``, ``spf-only``, ``dmarc-only`` or ``none``; null without a valid scan."""
    spf, dmarc = F.coalesce(good_spf, F.lit(False)), F.coalesce(good_dmarc, F.lit(False))
    value = F.when(spf & dmarc, "both").when(spf, "spf-only").when(dmarc, "dmarc-only").otherwise("none")
    return F.when(F.coalesce(scan_valid, F.lit(False)) & has_dss, value)


def auth_label(good: Column, has: Column, good_text: str) -> Column:
    """Label of one mechanism, SPF or DMARC."""
    return (
        F.when(F.coalesce(good, F.lit(False)), good_text)
        .when(F.coalesce(has, F.lit(False)), "Present (not enforced)")
        .otherwise("Missing")
    )


def chart_group(cat: Column) -> Column:
    """Category as used in the comparisons: Domestic, US Cloud or Other."""
    return lookup(cat, dims.CHART_GROUPS, F.lit("Other"))
