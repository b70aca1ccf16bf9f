"""Quality checks, structural validation and regression against a baseline.

Checks return findings ``(severity, category, country, code, name, region, domain, message, details)`` with upper-case
country and ``details map<string,string>``.  Server lists are child tables ``(country, code, host)``; set comparisons
are counts over distinct (entity, host) pairs, so no list is collected per entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.labels import category
from mailposture.functions.text import contains_any, first_match
from mailposture.operators.classify import BIT
from mailposture.operators.evidence import host_name
from mailposture.operators.reports import ENTITY, kind_bit, n_rows, pct, true
from mailposture.operators.signatures import matches
from mailposture.skew import lookup_join, semi_join, top_per_group

FINDING = ["severity", "category", "country", "code", "name", "region", "domain", "message", "details"]
SIGNATURE_NAME = {"microsoft": "ms365", "google": "google", "aws": "aws"}


def text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def finding(df: DataFrame, cat: str, severity: Column | str, message: Column | str, **details: Column | str) -> DataFrame:
    items = [x for k, v in details.items() for x in (F.lit(k), (F.lit(v) if isinstance(v, str) else v).cast("string"))]
    empty = F.create_map().cast("map<string,string>")
    return df.select(
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(cat).alias("category"),
        F.upper("country").alias("country"),
        "code",
        text("name").alias("name"),
        text("region").alias("region"),
        text("domain").alias("domain"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (F.create_map(*items) if items else empty).alias("details"),
    )


# --- provider checks ----------------------------------------------------------------------------------------------


def check_low_confidence(providers: DataFrame) -> DataFrame:
    rows = providers.filter((F.col("provider") != "unknown") & (F.col("confidence") < dims.LOW_CONFIDENCE))
    message = F.format_string("provider=%s confidence=%.0f%%", "provider", F.bround("confidence", 0))
    return finding(rows, "low_confidence", "WARNING", message, provider=F.col("provider"), confidence=F.col("confidence"))


def primary_weights(signals: DataFrame) -> DataFrame:
    """Weight per (entity, provider) from primary kinds, each kind once, as exact hundredths."""
    rows = signals.filter(F.col("kind").isin(dims.PRIMARY_KINDS))
    per_kind = rows.groupBy(*ENTITY, "provider", "kind").agg(F.min(F.struct("pos", "weight")).alias("first"))
    return per_kind.groupBy(*ENTITY, "provider").agg(F.sum(F.round(F.col("first.weight") * 100).cast("bigint")).alias("cents"))


def check_contradictory(providers: DataFrame, signals: DataFrame) -> DataFrame:
    """Primary signals of two providers whose weights are close: the leader has less than 1.5 times the runner-up."""
    entry = F.struct((-F.col("cents")).alias("order"), F.col("provider").alias("p"), F.col("cents").alias("cents"))
    # One row per (entity, provider), so an entity contributes at most as many rows as there are providers.
    best = primary_weights(signals).groupBy(*ENTITY).agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    rows = providers.join(best.filter(F.size("ranked") >= 2), ENTITY)
    top, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    close = (second["cents"] > 0) & (top["cents"] * 2 < second["cents"] * 3)
    severity = F.when(top["cents"] <= second["cents"], "ERROR").otherwise("WARNING")
    message = F.format_string("winner=%s (%s=%.2f vs %s=%.2f)", "provider", top["p"], top["cents"] / 100, second["p"], second["cents"] / 100)
    weights = F.array_join(F.transform("ranked", lambda r: F.concat(r["p"], F.lit("="), F.format_string("%.2f", r["cents"] / 100))), ", ")
    return finding(rows.filter(close), "contradictory_signals", severity, message, winner=F.col("provider"), primary_weights=weights)


def check_unknown(providers: DataFrame, signals: DataFrame) -> DataFrame:
    """Unknown providers with the reason; behind a gateway that is expected and no finding."""
    counts = signals.groupBy(*ENTITY).agg(n_rows().alias("n"))
    rows = providers.filter(F.col("provider") == "unknown").join(counts, ENTITY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    no_domain = text("domain") == ""
    rows = rows.filter(no_domain | (text("gateway") == ""))
    some = F.col("n") > 0
    severity = F.when(~no_domain & some, "WARNING").otherwise("INFO")
    message = (
        F.when(no_domain, "no domain resolved")
        .when(some, F.concat(F.lit("has "), F.col("n"), F.lit(" signal(s) but no clear winner")))
        .otherwise("no signals at all")
    )
    return finding(rows, "unknown_classification", severity, message, gateway=text("gateway"), n_signals=F.col("n"))


def mx_match(provider_mx: DataFrame, providers: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Per cloud entity: number of servers, whether one is a gateway, whether one fits the provider by fixed patterns or by a table of signatures."""
    cloud = providers.filter(F.col("provider").isin(list(SIGNATURE_NAME)))
    every_gateway = [w for words in dims.GATEWAYS.values() for w in words]
    rows = cloud.select(*ENTITY, "provider").join(provider_mx.filter(F.col("host").isNotNull()), ENTITY)
    fits = first_match(
        ((F.col("provider") == out, contains_any(F.col("host"), dims.MX_PATTERNS[sig])) for out, sig in SIGNATURE_NAME.items()),
        F.lit(False),
    )
    if signatures is not None:
        named = first_match(((F.col("provider") == sig, F.lit(out)) for out, sig in SIGNATURE_NAME.items()), F.lit(None))
        hits = matches(provider_mx, "host", signatures).select(F.col("text").alias("host"), named.alias("provider"), F.lit(True).alias("_fits")).distinct()
        rows, fits = lookup_join(rows, hits, ["host", "provider"]), F.coalesce("_fits", F.lit(False))
    return rows.groupBy(*ENTITY).agg(
        n_rows().alias("n_mx"), F.bool_or(contains_any(F.col("host"), every_gateway)).alias("gateway_mx"), F.bool_or(fits).alias("fits")
    )


def check_mx_provider(providers: DataFrame, provider_mx: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Cloud providers without a fitting server, or without any; entities behind a gateway are skipped."""
    cloud = providers.filter(F.col("provider").isin(list(SIGNATURE_NAME)) & (text("gateway") == ""))
    rows = cloud.join(mx_match(provider_mx, cloud, signatures), ENTITY, "left").filter(
        F.col("n_mx").isNull() | (~F.col("gateway_mx") & ~F.col("fits"))
    )
    shown = top_per_group(provider_mx.filter(F.col("host").isNotNull()).join(rows.select(*ENTITY), ENTITY, "left_semi"), ENTITY, [F.col("pos")], 3)
    shown = shown.groupBy(*ENTITY).agg(F.array_sort(F.collect_list(F.struct("rank", "host"))).alias("first"))
    rows = rows.join(shown, ENTITY, "left")
    hosts = F.coalesce(F.array_join(F.transform("first", lambda x: x["host"]), ", "), F.lit(""))
    message = F.concat(
        F.lit("provider="),
        F.col("provider"),
        F.when(F.col("n_mx").isNull(), " but no MX records").otherwise(F.concat(F.lit(" but MX="), hosts)),
    )
    return finding(rows, "mx_provider_mismatch", "ERROR", message, provider=F.col("provider"), mx=hosts)


def check_missing_spf(providers: DataFrame) -> DataFrame:
    rows = providers.filter(~F.col("provider").isin("unknown", "domestic") & (F.trim(text("spf")) == ""))
    message = F.concat(F.lit("provider="), F.col("provider"), F.lit(" but no SPF record"))
    return finding(rows, "missing_spf", "WARNING", message, provider=F.col("provider"))


# --- security checks ----------------------------------------------------------------------------------------------


def check_invalid_scans(security: DataFrame) -> DataFrame:
    """Scans marked invalid; a missing mark counts as valid here."""
    rows = security.filter(~F.coalesce("scan_valid", F.lit(True)))
    return finding(rows, "invalid_scan", "INFO", "scan_valid=False")


def check_logical(security: DataFrame) -> DataFrame:
    """A good record without the record itself."""

    def part(good: str, base: str) -> Column:
        return F.when(true(good) & ~true(base), F.struct(F.lit(good).alias("good"), F.lit(base).alias("base")))

    pairs = F.array(part("has_good_spf", "has_spf"), part("has_good_dmarc", "has_dmarc"))
    rows = security.withColumn("p", F.explode(F.filter(pairs, lambda x: x.isNotNull())))
    message = F.concat(F.col("p.good"), F.lit("=True but "), F.col("p.base"), F.lit("=False"))
    return finding(rows, "logical_contradiction", "ERROR", message, good=F.col("p.good"), base=F.col("p.base"))


def check_dane(security: DataFrame) -> DataFrame:
    rows = security.filter(true("dane_supported") & ~true("dane_partial"))
    return finding(rows, "dane_inconsistency", "ERROR", "dane.supported=True but dane.partial=False", supported="true", partial="false")


def domains_with_spf(dns_txt: DataFrame) -> DataFrame:
    """Domains that have an SPF record in a later observation."""
    return dns_txt.filter(F.contains(F.lower("txt"), F.lit("v=spf1"))).select(F.col("qname").alias("domain")).distinct()


def check_scan_spf(security: DataFrame, dns_txt_now: DataFrame) -> DataFrame:
    """The scan found no SPF, a later observation has it."""
    rows = security.filter(true("scan_valid") & (text("domain") != "") & ~true("has_spf"))
    rows = semi_join(rows, domains_with_spf(dns_txt_now), ["domain"])
    return finding(rows, "scan_spf_mismatch", "ERROR", "scan says no SPF but DNS has SPF record", scan_has_spf="false", dns_has_spf="true")


# --- cross checks -------------------------------------------------------------------------------------------------


def check_domain_mismatch(providers: DataFrame, security: DataFrame) -> DataFrame:
    rows = providers.join(security.select(*ENTITY, F.col("domain").alias("s_domain")), ENTITY)
    rows = rows.filter((text("domain") != "") & (text("s_domain") != "") & (F.col("domain") != F.col("s_domain")))
    message = F.concat(F.lit("providers="), F.col("domain"), F.lit(" vs security="), F.col("s_domain"))
    return finding(rows, "domain_mismatch", "ERROR", message, provider_domain=F.col("domain"), security_domain=F.col("s_domain"))


def mx_overlap(provider_mx: DataFrame, security_mx: DataFrame) -> DataFrame:
    """Per entity: servers known to providers, to security, and to both."""

    def side(df: DataFrame, flag: int) -> DataFrame:
        host = host_name(F.col("host"))
        return df.filter(F.col("host").isNotNull()).select(*ENTITY, host.alias("host"), F.lit(flag).alias("side"))

    pairs = side(provider_mx, 1).unionByName(side(security_mx, 2)).groupBy(*ENTITY, "host").agg(F.bit_or("side").alias("side"))
    return pairs.groupBy(*ENTITY).agg(
        F.count_if(F.col("side") != 2).alias("n_providers"),
        F.count_if(F.col("side") != 1).alias("n_security"),
        F.count_if(F.col("side") == 3).alias("n_both"),
    )


def check_mx_divergence(providers: DataFrame, provider_mx: DataFrame, security: DataFrame, security_mx: DataFrame) -> DataFrame:
    """More than half of all servers are known to one side only; both sides know some, and both have the entity."""
    both = providers.join(security.select(*ENTITY), ENTITY, "left_semi")
    rows = both.join(mx_overlap(provider_mx, security_mx), ENTITY)
    union = F.col("n_providers") + F.col("n_security") - F.col("n_both")
    rows = rows.filter((F.col("n_providers") > 0) & (F.col("n_security") > 0) & ((union - F.col("n_both")) * 2 > union))

    def listed(df: DataFrame, name: str) -> DataFrame:
        # Lists are built for the findings only; a set of MX records fits one DNS answer, which bounds it.
        hosts = df.filter(F.col("host").isNotNull()).join(rows.select(*ENTITY), ENTITY, "left_semi")
        quoted = F.transform(F.sort_array(F.collect_set(host_name(F.col("host")))), lambda h: F.concat(F.lit("'"), h, F.lit("'")))
        return hosts.groupBy(*ENTITY).agg(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias(name))

    rows = rows.join(listed(provider_mx, "_p"), ENTITY).join(listed(security_mx, "_s"), ENTITY)
    message = F.concat(F.lit("providers MX="), F.col("_p"), F.lit(" vs security MX="), F.col("_s"))
    return finding(rows, "mx_divergence", "WARNING", message, provider_mx=F.col("_p"), security_mx=F.col("_s"))


def check_missing(providers: DataFrame, security: DataFrame) -> DataFrame:
    """Entities in one table only: a warning when security lacks them, an error when providers do."""
    only_p = providers.join(security.select(*ENTITY), ENTITY, "left_anti")
    only_s = security.join(providers.select(*ENTITY), ENTITY, "left_anti")
    return finding(
        only_p, "missing_municipality", "WARNING", "in providers but missing from security", present_in="providers"
    ).unionByName(
        finding(only_s, "missing_municipality", "ERROR", "in security but missing from providers", present_in="security")
    )


def check_expected_security(providers: DataFrame, security: DataFrame, dns_txt_now: DataFrame) -> DataFrame:
    """Microsoft entities without SPF in a valid scan, unless a later observation has it."""
    scans = security.filter(true("scan_valid") & ~true("has_spf")).select(*ENTITY)
    rows = providers.filter(F.col("provider") == "microsoft").join(scans, ENTITY, "left_semi")
    rows = semi_join(rows, domains_with_spf(dns_txt_now), ["domain"], anti=True)
    return finding(rows, "expected_security_missing", "WARNING", "provider=microsoft but no SPF (verified with DNS)", provider="microsoft")


# --- all checks ---------------------------------------------------------------------------------------------------


def run_all_checks(
    providers: DataFrame, signals: DataFrame, provider_mx: DataFrame, security: DataFrame, security_mx: DataFrame, dns_txt_now: DataFrame
) -> DataFrame:
    """All findings; use :func:`ordered_findings` for a sorted report."""
    frames = [
        check_low_confidence(providers),
        check_contradictory(providers, signals),
        check_unknown(providers, signals),
        check_mx_provider(providers, provider_mx),
        check_missing_spf(providers),
        check_invalid_scans(security),
        check_logical(security),
        check_dane(security),
        check_scan_spf(security, dns_txt_now),
        check_domain_mismatch(providers, security),
        check_mx_divergence(providers, provider_mx, security, security_mx),
        check_missing(providers, security),
        check_expected_security(providers, security, dns_txt_now),
    ]
    return reduce(DataFrame.unionByName, frames)


def rank_of(c: Column, order: list[str], last: int) -> Column:
    return first_match(((c == v, F.lit(i)) for i, v in enumerate(order)), F.lit(last))


def report_order() -> list[Column]:
    return [
        rank_of(F.col("severity"), dims.SEVERITIES, 9),
        rank_of(F.col("category"), dims.FINDING_CATEGORIES, 99),
        rank_of(F.col("country"), [c.upper() for c in dims.COUNTRIES], 9),
        F.col("code"),
    ]


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*report_order())


def findings_summary(findings: DataFrame) -> DataFrame:
    """Findings per category and severity."""
    return findings.groupBy("category").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in dims.SEVERITIES], n_rows().alias("total")
    )


def top_findings(findings: DataFrame, k: int = 50) -> DataFrame:
    """The first findings of every category in report order, for the printed report."""
    return top_per_group(findings, ["category"], [*report_order(), F.col("message")], k)


def verify_mx(findings: DataFrame, stored_mx: DataFrame, dns_mx_now: DataFrame, k: int = 10) -> DataFrame:
    """Stored against current servers for the first error findings that have a domain: a spot check of ``k`` rows."""
    sample = findings.filter((F.col("severity") == "ERROR") & (F.col("domain") != "")).orderBy(*report_order(), "message").limit(k)
    sample = sample.select("category", F.lower("country").alias("country"), "code", "domain", "message")
    key = ["category", "country", "code", "domain", "message"]

    def listed(df: DataFrame, on: list[str], name: str) -> DataFrame:
        hosts = sample.join(df, on, "left").groupBy(*key)
        return hosts.agg(F.array_join(F.sort_array(F.collect_set(host_name(F.col("host")))), ", ").alias(name))

    rows = listed(stored_mx.select(*ENTITY, "host"), ENTITY, "stored").join(listed(dns_mx_now.select("domain", "host"), ["domain"], "current"), key)
    match = F.when(F.col("stored") == "", "?").when(F.col("stored") == F.col("current"), "yes").otherwise("differs")
    return rows.withColumn("match", match)


# --- structural validation ----------------------------------------------------------------------------------------


def _problem(condition: Column, level: str, message: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(level).alias("level"), message.alias("message")))


def entry_problems(providers: DataFrame) -> DataFrame:
    """Rules for one provider row each; ``override`` is null or (operator, source)."""
    p, conf = F.col("provider"), F.col("confidence")
    expected = category(p, F.col("country"))
    missing = [
        _problem(F.col(c).isNull(), "error", F.lit(f"missing field '{c}'")) for c in ("name", "region", "domain", "spf", "provider", "category", "confidence")
    ]
    valid_categories = F.array(F.lit("us-cloud"), F.concat("country", F.lit("-based")), F.lit("foreign"), F.lit("unknown"))
    rules = missing + [
        _problem(~p.isin(dims.OUTPUT_PROVIDERS), "error", F.concat(F.lit("unknown provider '"), p, F.lit("'"))),
        _problem(~F.array_contains(valid_categories, F.col("category")), "error", F.concat(F.lit("unknown category '"), F.col("category"), F.lit("'"))),
        _problem(F.col("category") != expected, "error", F.concat(F.lit("provider '"), p, F.lit("' should map to '"), expected, F.lit("', got '"), F.col("category"), F.lit("'"))),
        _problem((conf < 0) | (conf > 100), "error", F.lit("confidence out of [0, 100] range")),
        _problem((p == "unknown") & (conf != 0), "error", F.lit("unknown provider with confidence (expected 0)")),
        _problem(F.contains("domain", F.lit("@")), "error", F.concat(F.lit("domain looks like email: "), F.col("domain"))),
        _problem((F.col("domain") == "") & (p != "unknown"), "warning", F.concat(F.lit("empty domain for provider '"), p, F.lit("'"))),
        _problem(F.col("gateway") == "", "warning", F.lit("gateway field present but empty")),
    ]
    if "override" in providers.columns:
        for field in ("operator", "source"):
            rules.append(_problem(F.col("override").isNotNull() & (F.coalesce(F.col(f"override.{field}"), F.lit("")) == ""), "error", F.lit(f"override missing '{field}'")))
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return providers.select(*ENTITY, F.explode(found).alias("p")).select(*ENTITY, "p.level", "p.message")


def signal_problems(providers: DataFrame, signals: DataFrame) -> DataFrame:
    """Rules for one signal each, and signals of unknown providers."""
    kind, weight = F.col("kind"), F.col("weight")
    expected = first_match(((kind == k, F.lit(w)) for k, w in dims.WEIGHTS.items()), F.lit(None).cast("double"))
    in_range = (weight >= 0) & (weight <= 1)
    rules = [
        _problem(F.col(c).isNull(), "error", F.lit(f"signal missing '{c}'")) for c in ("kind", "provider", "weight", "detail")
    ] + [
        _problem(~kind.isin(list(BIT)), "error", F.concat(F.lit("unknown signal kind '"), kind, F.lit("'"))),
        _problem(~F.col("provider").isin(dims.OUTPUT_PROVIDERS), "error", F.concat(F.lit("unknown signal provider '"), F.col("provider"), F.lit("'"))),
        _problem(~in_range, "error", F.lit("signal weight out of [0, 1] range")),
        _problem(in_range & (F.abs(weight - expected) > 0.001), "error", F.concat(F.lit("signal '"), kind, F.lit("' weight differs from the expected one"))),
        _problem(F.col("detail") == "", "warning", F.lit("signal detail empty")),
    ]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    own = signals.select(*ENTITY, F.explode(found).alias("p")).select(*ENTITY, "p.level", "p.message")
    unknown = providers.filter(F.col("provider") == "unknown").join(signals.select(*ENTITY), ENTITY, "left_semi")
    note = F.lit("unknown provider with signals (gateway or confirmation-only)")
    return own.unionByName(unknown.select(*ENTITY, F.lit("warning").alias("level"), note.alias("message")))


def header_problems(providers: DataFrame, header: DataFrame) -> DataFrame:
    """Header of a provider file ``(country, total, provider, n)`` against its rows."""
    actual = providers.groupBy("country", "provider").agg(n_rows().alias("actual"))
    per = header.join(actual, ["country", "provider"], "full")
    counts = per.groupBy("country").agg(
        F.max("total").alias("total"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("sum_n"),
        F.coalesce(F.sum("actual"), F.lit(0)).alias("rows"),
        F.bool_or(F.coalesce("n", F.lit(0)) != F.coalesce("actual", F.lit(0))).alias("differs"),
    )
    rules = [
        _problem(F.coalesce("total", F.lit(0)) <= 0, "error", F.lit("'total' must be positive")),
        _problem(F.col("rows") != F.col("total"), "error", F.lit("total differs from the number of entries")),
        _problem(F.col("sum_n") != F.col("total"), "error", F.lit("counts sum differs from total")),
        _problem(F.col("differs"), "error", F.lit("counts header does not match the distribution")),
    ]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return counts.select("country", F.lit(None).cast("string").alias("code"), F.explode(found).alias("p")).select(*ENTITY, "p.level", "p.message")


def share_problems(providers: DataFrame) -> DataFrame:
    """Shares of confident and of zero-confidence entities per country."""
    shares = providers.groupBy("country").agg(
        n_rows().alias("n"), F.count_if(F.col("confidence") >= 50).alias("high"), F.count_if(F.col("confidence") == 0).alias("zero")
    )
    rules = [
        _problem(F.col("high") / F.col("n") < dims.MIN_HIGH_CONFIDENCE_SHARE, "warning", F.lit("too few entries have confidence >= 50")),
        _problem(F.col("zero") / F.col("n") > dims.MAX_ZERO_CONFIDENCE_SHARE, "warning", F.lit("too many entries have 0 confidence")),
    ]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return shares.select("country", F.lit(None).cast("string").alias("code"), F.explode(found).alias("p")).select(*ENTITY, "p.level", "p.message")


def validate_structure(providers: DataFrame, signals: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """All structural problems ``(country, code, level, message)``; an empty result is a valid table."""
    frames = [entry_problems(providers), signal_problems(providers, signals), share_problems(providers)]
    if header is not None:
        frames.append(header_problems(providers, header))
    return reduce(DataFrame.unionByName, frames)


# --- regression ---------------------------------------------------------------------------------------------------


def regression(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every entity of either side with its state: matched, only_base or only_current, and old and new result."""
    base = baseline.select(*ENTITY, F.col("provider").alias("old"), F.col("confidence").alias("old_conf"), F.lit(True).alias("_b"))
    cur = current.select(*ENTITY, "name", "domain", F.col("provider").alias("new"), F.col("confidence").alias("new_conf"), F.lit(True).alias("_c"))
    rows = cur.join(base, ENTITY, "full")
    state = F.when(F.col("_b").isNull(), "only_current").when(F.col("_c").isNull(), "only_base").otherwise("matched")
    return rows.withColumn("state", state).drop("_b", "_c")


def regression_changes(reg: DataFrame) -> DataFrame:
    """Matched entities whose provider changed."""
    return reg.filter((F.col("state") == "matched") & (F.col("old") != F.col("new"))).drop("state")


def regression_drops(reg: DataFrame, drop: float = dims.CONFIDENCE_DROP) -> DataFrame:
    """Matched entities with the same provider and a large loss of confidence."""
    delta = F.col("new_conf") - F.col("old_conf")
    same = reg.filter((F.col("state") == "matched") & (F.col("old") == F.col("new")))
    return same.withColumn("delta", delta).filter(F.col("delta") < -drop).drop("state")


def regression_summary(reg: DataFrame) -> DataFrame:
    """One row: matched and unmatched entities, changes with their share and verdict, large drops, new unknowns."""
    matched = F.col("state") == "matched"
    changed = matched & (F.col("old") != F.col("new"))
    drop = matched & (F.col("old") == F.col("new")) & (F.col("new_conf") - F.col("old_conf") < -dims.CONFIDENCE_DROP)
    one = reg.agg(
        F.count_if(matched).alias("matched"),
        F.count_if(F.col("state") == "only_base").alias("only_base"),
        F.count_if(F.col("state") == "only_current").alias("only_current"),
        F.count_if(changed).alias("changes"),
        F.count_if(drop).alias("big_drops"),
        F.count_if(changed & (F.col("new") == "unknown")).alias("new_unknowns"),
    )
    share = pct("changes", "matched")
    verdict = (
        F.when(F.col("matched") == 0, "error").when(share > dims.MAX_PROVIDER_CHANGES_PCT, "error").when(F.col("changes") > 0, "warning").otherwise("ok")
    )
    return one.withColumn("change_pct", share).withColumn("verdict", verdict)


def regression_distribution(reg: DataFrame) -> DataFrame:
    """Matched entities per provider before and now."""
    matched = reg.filter(F.col("state") == "matched")
    both = matched.select(F.explode(F.array(F.struct(F.col("old").alias("provider"), F.lit(0).alias("now")), F.struct(F.col("new").alias("provider"), F.lit(1).alias("now")))).alias("x"))
    return both.groupBy("x.provider").agg(F.count_if(F.col("x.now") == 0).alias("base"), F.count_if(F.col("x.now") == 1).alias("current"))


def delta_stats(reg: DataFrame) -> DataFrame:
    """Mean, exact median and sample standard deviation of the confidence change of entities with the same provider.

    Changes are counted per value first (confidence has one decimal), so the median works on few values.
    """
    same = reg.filter((F.col("state") == "matched") & (F.col("old") == F.col("new")))
    delta = F.round(F.col("new_conf") - F.col("old_conf"), 6)
    counts = same.groupBy(delta.alias("delta")).agg(n_rows().alias("n"))
    moments = same.agg(n_rows().alias("n"), F.avg(delta).alias("mean"), F.stddev_samp(delta).alias("stdev"))
    return moments.crossJoin(F.broadcast(counts.agg(F.percentile("delta", F.lit(0.5), F.col("n")).alias("median")))).select("n", "mean", "median", "stdev")


# --- merged table and resolve output ------------------------------------------------------------------------------


def validate_merged(merged: DataFrame) -> DataFrame:
    """Violations ``(rule, country, region)`` in a merged regional table: ranges, nulls, subtotals, grand total."""
    from mailposture.operators.reports import SHORT

    shares = ["us_pct", "dom_pct", *[f"{m}_pct" for m in SHORT.values()]]
    counts = [*dims.OUTPUT_PROVIDERS, *SHORT.values(), "total", "sec_total"]
    is_grand, is_total = F.col("region") == "Grand Tot.", F.col("region") == "Total"
    regions = merged.filter(~is_grand & ~is_total)

    def bad(rows: DataFrame, rule: Column) -> DataFrame:
        return rows.filter(rule.isNotNull()).select(rule.alias("rule"), "country", "region")

    outside = reduce(lambda a, b: a | b, [~F.col(c).between(0, 100) for c in shares])
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in counts])
    over = reduce(lambda a, b: a | b, [F.col(m) > F.col("sec_total") for m in SHORT.values()])
    frames = [
        bad(merged, F.when(outside, "percentage outside [0, 100]")),
        bad(merged, F.when(nulls, "null count")),
        bad(regions, F.when(over, "metric exceeds sec_total")),
    ]

    def sums(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in counts])

    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in counts])
    subtotals = merged.filter(is_total)
    checked = subtotals.join(sums(regions, "country"), "country", "full").withColumn("region", F.coalesce("region", F.lit("Total")))
    frames.append(bad(checked, F.when(differs, "subtotal differs from its regions")))
    # Subtotals are one row per country and the grand total is one row.
    grand = merged.filter(is_grand).crossJoin(F.broadcast(sums(subtotals)))
    frames.append(bad(grand, F.when(differs, "grand total differs from the subtotals")))
    return reduce(DataFrame.unionByName, frames)


def validate_domains(minimal: DataFrame, detailed: DataFrame, review: DataFrame, regions: DataFrame) -> DataFrame:
    """Violations ``(rule, country, code)`` in the resolve output.

    Minimal and detailed agree on shared fields, review is the part of detailed that needs it, codes are unique,
    regions are known.  ``regions`` is ``(country, region)``.
    """
    shared = ["name", "region", "website", "emails"]
    left = minimal.select(*ENTITY, F.struct(*shared).alias("_m"))
    right = detailed.select(*ENTITY, F.struct(*shared).alias("_d"))
    both = left.join(right, ENTITY, "full").filter(~F.col("_m").eqNullSafe(F.col("_d")))
    rule = lambda df, text_: df.select(F.lit(text_).alias("rule"), *ENTITY)
    needs = detailed.filter(F.col("confidence").isin("low", "none") | (F.size("flags") > 0)).select(*ENTITY)
    repeated = detailed.groupBy(*ENTITY).agg(n_rows().alias("n")).filter(F.col("n") > 1)
    return reduce(
        DataFrame.unionByName,
        [
            rule(both, "minimal and detailed differ"),
            rule(review.join(detailed.select(*ENTITY), ENTITY, "left_anti"), "review entry not in detailed"),
            rule(review.join(needs, ENTITY, "left_anti"), "review entry without reason"),
            rule(needs.join(review.select(*ENTITY), ENTITY, "left_anti"), "entry missing from review"),
            rule(repeated, "code not unique"),
            rule(detailed.join(regions.select("country", "region").distinct(), ["country", "region"], "left_anti"), "unknown region"),
        ],
    )
