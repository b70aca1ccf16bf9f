"""Provider election and confidence, one shuffle on the domain.

Per domain the evidence shrinks to one fixed-size row, combined before the shuffle: a bit mask of signal kinds and the
first position per provider.  However much evidence a single domain has, every task sends one row for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.labels import category, output_confidence, output_provider
from mailposture.functions.text import first_match
from mailposture.operators.evidence import kind_order
from mailposture.skew import lookup_join

ELECTABLE = ["ms365", "google", "aws", "domestic", "foreign"]
BIT = {kind: 1 << i for i, kind in enumerate(dims.KINDS)}
# Scores are counted in hundredths, so equal scores are equal whatever the order of summation.
CENTS = {kind: round(dims.WEIGHTS[kind] * 100) for kind in dims.PRIMARY_KINDS}
BOOST_CENTS = round(dims.GATEWAY_DKIM_BOOST * 100)


def has_kind(mask: Column, kind: str) -> Column:
    return F.coalesce(mask.bitwiseAND(F.lit(BIT[kind])) != 0, F.lit(False))


def primary_cents(mask: Column) -> Column:
    """Sum of the primary weights present in a mask, in hundredths."""
    parts = [F.when(has_kind(mask, kind), cents).otherwise(0) for kind, cents in CENTS.items()]
    return reduce(lambda a, b: a + b, parts)


def evidence_masks(evidence: DataFrame) -> DataFrame:
    """One row per domain: signal kinds overall, and per provider its kinds and first position.

    Repeated evidence of one kind sets the same bit, which is the deduplication by (provider, kind).
    """
    bit = first_match(((F.col("kind") == k, F.lit(b)) for k, b in BIT.items()), F.lit(0))
    rows = evidence.select(
        "domain", "provider", bit.alias("bit"), F.struct(kind_order(F.col("kind")).alias("k"), "skey", "pos").alias("place")
    )
    aggs = [F.bit_or("bit").alias("kinds")]
    for p in ELECTABLE:
        mine = F.col("provider") == p
        aggs.append(F.bit_or(F.when(mine, F.col("bit"))).alias(f"kinds_{p}"))
        aggs.append(F.min(F.when(mine, F.col("place"))).alias(f"first_{p}"))
    return rows.groupBy("domain").agg(*aggs)


def dedup_evidence(evidence: DataFrame) -> DataFrame:
    """First evidence per (domain, provider, kind), without unknown providers."""
    return (
        evidence.filter(F.col("provider") != "unknown")
        .groupBy("domain", "provider", "kind")
        .agg(F.min("pos").alias("pos"), F.first("weight").alias("weight"))
    )


def primary_scores(evidence: DataFrame) -> DataFrame:
    """Score per (domain, provider) from primary kinds, each kind once; only positive scores."""
    bit = first_match(((F.col("kind") == k, F.lit(b)) for k, b in BIT.items()), F.lit(0))
    masks = (
        evidence.filter(F.col("provider") != "unknown").groupBy("domain", "provider").agg(F.bit_or(bit).alias("kinds"))
    )
    score = primary_cents(F.col("kinds"))
    return masks.select("domain", "provider", (score / 100).alias("score")).filter(score > 0)


def rule_of(kinds: Column, gateway: Column) -> Column:
    """Struct (rule, base, signals) of the first confidence rule that fits a winner."""

    def fits(signals: list[str], needs_gateway: bool) -> Column:
        tests = [has_kind(kinds, s) for s in signals]
        tests.append(gateway.isNotNull() if needs_gateway else F.lit(True))
        return reduce(lambda a, b: a & b, tests)

    return first_match(
        (
            (
                fits(signals, needs_gateway),
                F.struct(F.lit(name).alias("rule"), F.lit(base).alias("base"), F.lit(len(signals)).alias("signals")),
            )
            for name, signals, needs_gateway, base in dims.PROVIDER_RULES
        ),
        F.lit(None),
    )


def country_rule(rules: list[tuple[str, float]], has_mx: Column, has_spf: Column, any_evidence: Column) -> Column:
    """Struct (rule, confidence) of the flat tables for domestic and foreign hosting."""
    both, mx_only, secondary, nothing = [
        F.struct(F.lit(name).alias("rule"), F.lit(base).alias("confidence")) for name, base in rules
    ]
    return F.when(has_mx & has_spf, both).when(has_mx, mx_only).when(any_evidence, secondary).otherwise(nothing)


def classify(domains: DataFrame, evidence: DataFrame, mx: DataFrame, spf: DataFrame) -> DataFrame:
    """One row per domain: provider, confidence, rule, gateway.

    ``domains(domain)`` distinct, ``mx(domain, has_mx, gateway)``, ``spf(domain, spf)``.  All inputs are grouped or
    unique by domain, so the joins reuse one partitioning by domain.
    """
    base = (
        domains.select("domain")
        .join(evidence_masks(evidence), "domain", "left")
        .join(mx.select("domain", "has_mx", "gateway"), "domain", "left")
        .join(spf.select("domain", "spf"), "domain", "left")
    )
    gateway = F.col("gateway")
    mx_seen = F.coalesce("has_mx", F.lit(False))
    any_evidence = F.coalesce(F.col("kinds") != 0, F.lit(False))
    has_mx = mx_seen | has_kind(F.col("kinds"), "mx")
    has_spf = (F.coalesce("spf", F.lit("")) != "") | has_kind(F.col("kinds"), "spf")
    present = {p: F.col(f"kinds_{p}").isNotNull() for p in ELECTABLE}

    scored = F.filter(
        F.array(
            *[
                F.struct(
                    primary_cents(F.col(f"kinds_{p}")).alias("cents"),
                    F.col(f"first_{p}").alias("first"),
                    F.lit(p).alias("provider"),
                    F.col(f"kinds_{p}").alias("kinds"),
                )
                for p in ELECTABLE
            ]
        ),
        lambda s: s["cents"] > 0,
    )
    boosting = gateway.isNotNull() & (F.size("scored") > 1)
    ranked = F.transform(
        "scored",
        lambda s: F.struct(
            (-(s["cents"] + F.when(boosting & has_kind(s["kinds"], "dkim"), BOOST_CENTS).otherwise(0))).alias("order"),
            s["first"].alias("first"),
            s["provider"].alias("provider"),
            s["kinds"].alias("kinds"),
        ),
    )
    elected = base.withColumn("scored", scored).withColumn("winner", F.array_min(ranked))
    rule = rule_of(F.col("winner.kinds"), gateway)
    elected = elected.withColumn("rule_hit", rule)
    extra = F.bit_count("winner.kinds") - F.col("rule_hit.signals")
    confidence = F.least(F.lit(1.0), F.col("rule_hit.base") + extra * F.lit(dims.SIGNAL_BOOST))

    def outcome(provider: Column, result: Column) -> Column:
        return F.struct(provider.alias("provider"), result["confidence"].alias("confidence"), result["rule"].alias("rule"))

    def by_country(p: str) -> Column:
        return outcome(F.lit(p), country_rule(dims.COUNTRY_RULES[p], has_mx, has_spf, any_evidence))

    def fixed(p: str, name: str) -> Column:
        return outcome(F.lit(p), F.struct(F.lit(name).alias("rule"), F.lit(0.0).alias("confidence")))

    authoritative = gateway.isNull() & mx_seen & ~has_kind(F.col("kinds"), "mx")
    winner = outcome(
        F.col("winner.provider"), F.struct(F.col("rule_hit.rule").alias("rule"), confidence.alias("confidence"))
    )
    result = first_match(
        [
            (authoritative & present["domestic"], by_country("domestic")),
            (authoritative & present["foreign"], by_country("foreign")),
            (F.col("winner").isNotNull(), winner),
            (gateway.isNotNull(), fixed("unknown", "gateway_no_primary")),
            (present["domestic"], by_country("domestic")),
            (present["foreign"], by_country("foreign")),
        ],
        fixed("unknown", "no_country_data"),
    )
    return elected.select("domain", result.alias("r"), "gateway", "spf").select(
        "domain", "r.provider", "r.confidence", "r.rule", "gateway", F.coalesce("spf", F.lit("")).alias("spf")
    )


def rule_hits(classified: DataFrame) -> DataFrame:
    """How often each confidence rule fired, including rules that never did."""
    spark = classified.sparkSession
    names = spark.createDataFrame([(n,) for n in dims.RULE_NAMES], "rule string")
    hits = classified.groupBy("rule").agg(F.count(F.lit(1)).alias("hits"))
    return names.join(hits, "rule", "left").select("rule", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


def attach_classification(entity: DataFrame, classified: DataFrame) -> DataFrame:
    """Give every entity the result of its domain; entities without a domain are unknown.

    Many entities may share one domain, so the join spreads hot domains.
    """
    joined = lookup_join(entity.withColumn("domain", F.coalesce("domain", F.lit(""))), classified, ["domain"])
    provider = output_provider(F.coalesce("provider", F.lit("unknown")))
    return joined.select(
        *[c for c in entity.columns],
        F.coalesce("spf", F.lit("")).alias("spf"),
        provider.alias("provider"),
        category(provider, F.col("country")).alias("category"),
        output_confidence(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        "gateway",
    )


def split_overrides(overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): provider, operator and source present, and the provider one of the valid ones."""
    complete = F.col("provider").isNotNull() & F.col("operator").isNotNull() & F.col("source").isNotNull()
    valid = complete & F.col("provider").isin(dims.OVERRIDE_PROVIDERS)
    reason = F.when(~complete, "missing field").otherwise("invalid provider")
    return overrides.filter(valid), overrides.filter(~F.coalesce(valid, F.lit(False))).withColumn("reason", reason)


def apply_provider_overrides(providers: DataFrame, overrides: DataFrame) -> DataFrame:
    """Override unknown classifications only; ``override`` holds operator and source where applied."""
    ov = overrides.select(
        "country", "code", F.col("provider").alias("_p"), F.col("operator").alias("_o"), F.col("source").alias("_s")
    )
    joined = providers.join(ov, ["country", "code"], "left")
    use = F.col("_p").isNotNull() & (F.col("provider") == "unknown")
    return (
        joined.withColumn("override", F.when(use, F.struct(F.col("_o").alias("operator"), F.col("_s").alias("source"))))
        .withColumn("category", F.when(use, category(F.col("_p"), F.col("country"))).otherwise(F.col("category")))
        .withColumn("confidence", F.when(use, F.lit(100.0)).otherwise(F.col("confidence")))
        .withColumn("provider", F.when(use, F.col("_p")).otherwise(F.col("provider")))
        .drop("_p", "_o", "_s")
    )


def override_outcome(providers: DataFrame, overrides: DataFrame) -> DataFrame:
    """Number of overrides applied, not needed, and without an entity."""
    joined = overrides.select("country", "code").join(
        providers.select("country", "code", F.col("provider").alias("_p")), ["country", "code"], "left"
    )
    outcome = (
        F.when(F.col("_p").isNull(), "missing entity").when(F.col("_p") == "unknown", "applied").otherwise("not applied")
    )
    return joined.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def to_provider_rows(providers: DataFrame, evidence: DataFrame, dns_mx: DataFrame) -> DataFrame:
    """Nested output rows: MX list and signals of the domain inside the row of the entity.

    Analyses work on the flat tables; nesting happens only here, for files.
    """
    signals = evidence.groupBy("domain").agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct("kind_ord", "skey", "pos", "kind", output_provider(F.col("provider")).alias("provider"), "weight", "detail")
                )
            ),
            lambda s: F.struct(s["kind"].alias("kind"), s["provider"].alias("provider"), s["weight"].alias("weight"), s["detail"].alias("detail")),
        ).alias("classification_signals")
    )
    hosts = dns_mx.groupBy("domain").agg(F.sort_array(F.collect_set(F.lower(F.regexp_replace("host", r"\.+$", "")))).alias("mx"))
    nested = lookup_join(providers, hosts.join(signals, "domain", "full"), ["domain"])
    empty = F.array().cast("array<struct<kind:string,provider:string,weight:double,detail:string>>")
    return nested.select(
        *[c for c in providers.columns if c != "confidence"],
        F.col("confidence").alias("classification_confidence"),
        F.coalesce("mx", F.array().cast("array<string>")).alias("mx"),
        F.coalesce("classification_signals", empty).alias("classification_signals"),
    )
