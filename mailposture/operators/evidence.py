"""Evidence jobs: observation tables matched against provider fingerprints.

Every job returns rows ``(domain, kind, kind_ord, skey, pos, provider, weight, detail, raw)``.  ``kind_ord, skey, pos``
give the order in which evidence of one domain is assembled; it decides ties in the election.  Patterns are few and
fixed, so they are part of the expressions: no join against a pattern table, no shuffle in the pure matching jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.text import asn_country, asn_number, contains_any, first_match, strip
from mailposture.operators.signatures import match_rows, matched_texts
from mailposture.session import store
from mailposture.skew import lookup_join

COLUMNS = ["domain", "kind", "kind_ord", "skey", "pos", "provider", "weight", "detail", "raw"]


def no_text() -> Column:
    return F.lit("")


def kind_order(kind: Column) -> Column:
    return first_match(((kind == k, F.lit(i)) for i, k in enumerate(dims.KINDS)), F.lit(len(dims.KINDS)))


def host_name(c: Column) -> Column:
    """Lower-case name without the trailing dots."""
    return F.lower(F.regexp_replace(c, r"\.+$", ""))


def _matching(text: Column, patterns: dict[str, list[str]]) -> Column:
    """Array of (sig, provider) for the providers whose patterns occur in ``text``."""
    tests = [
        F.when(contains_any(text, words), F.struct(F.lit(i).alias("sig"), F.lit(p).alias("provider")))
        for i, (p, words) in enumerate(patterns.items())
        if words
    ]
    return F.filter(F.array(*tests), lambda m: m.isNotNull())


def _evidence(df: DataFrame, kind: str, provider: Column, detail: Column, raw: Column, skey: Column, *pos: Column) -> DataFrame:
    """``pos`` are order keys from high to low; they are compared one after the other, so none has to leave room for another."""
    return df.select(
        "domain",
        F.lit(kind).alias("kind"),
        F.lit(dims.KINDS.index(kind)).alias("kind_ord"),
        skey.alias("skey"),
        F.array(*[p.cast("bigint") for p in pos]).alias("pos"),
        provider.alias("provider"),
        F.lit(dims.WEIGHTS[kind]).alias("weight"),
        detail.alias("detail"),
        raw.alias("raw"),
    )


def _match_rows(df: DataFrame, text: Column, patterns: dict[str, list[str]], signatures: DataFrame | None = None) -> DataFrame:
    """Rows with ``m`` (sig, provider), one for each provider found: by fixed patterns, or by a table of any number of them (:mod:`signatures`)."""
    if signatures is not None:
        return match_rows(df, text, signatures)
    return df.withColumn("m", F.explode(_matching(text, patterns)))


def mx_rows(dns_mx: DataFrame) -> DataFrame:
    """Distinct (domain, host) with normalised host names; other columns of the answer are kept."""
    return dns_mx.withColumn("host", host_name(F.col("host"))).distinct()


def mx_hosts(dns_mx: DataFrame) -> DataFrame:
    """Sorted MX host list per domain, for output rows."""
    return mx_rows(dns_mx).groupBy("domain").agg(F.sort_array(F.collect_set("host")).alias("mx"))


def ev_mx(dns_mx: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """MX hosts against provider patterns, one row per (host, provider)."""
    rows = _match_rows(mx_rows(dns_mx).select("domain", "host"), F.col("host"), dims.MX_PATTERNS, signatures)
    detail = F.concat(F.lit("MX "), F.col("host"), F.lit(" matches "), F.col("m.provider"))
    return _evidence(rows, "mx", F.col("m.provider"), detail, F.col("host"), F.col("host"), F.col("m.sig"))


def spf_record(dns_txt: DataFrame) -> DataFrame:
    """First SPF record of every name."""
    return (
        dns_txt.filter(F.lower("txt").startswith("v=spf1"))
        .groupBy(F.col("qname").alias("domain"))
        .agg(F.min(F.struct("pos", "txt")).alias("first"))
        .select("domain", F.col("first.txt").alias("spf"))
    )


def spf_tokens(df: DataFrame, text: str) -> DataFrame:
    """One row per white-space separated token of a record, with its position."""
    words = F.split(strip(F.col(text)), r"\s+")
    return df.select("*", F.posexplode(words).alias("token_pos", "token"))


def after_colon(token: Column) -> Column:
    return F.substring(token, F.lit(2) + F.length(F.substring_index(token, ":", 1)), F.length(token))


def ev_spf(spf: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """SPF ``include:`` targets against provider patterns."""
    tokens = spf_tokens(spf, "spf").filter(F.lower("token").startswith("include:"))
    rows = _match_rows(tokens.withColumn("target", after_colon(F.col("token"))), F.col("target"), dims.SPF_INCLUDES, signatures)
    detail = F.concat(F.lit("SPF include:"), F.col("target"), F.lit(" matches "), F.col("m.provider"))
    return _evidence(rows, "spf", F.col("m.provider"), detail, F.col("spf"), no_text(), F.col("token_pos"), F.col("m.sig"))


def ev_dkim(dns_cname: DataFrame) -> DataFrame:
    """DKIM selector aliases that point at the provider the selector belongs to."""
    target = host_name(F.col("target"))
    cases, order = [], 0
    for provider, selectors in dims.DKIM_SELECTORS.items():
        for selector in selectors:
            hit = F.startswith(F.col("qname"), F.lit(f"{selector}._domainkey.")) & contains_any(
                target, dims.DKIM_CNAME_PATTERNS[provider]
            )
            match = F.struct(F.lit(order).alias("sig"), F.lit(provider).alias("provider"))
            cases.append((hit, match))
            order += 1
    rows = (
        dns_cname.withColumn("m", first_match(cases, F.lit(None)))
        .filter(F.col("m").isNotNull())
        .withColumn("domain", F.regexp_replace("qname", r"^[^.]+\._domainkey\.", ""))
        .withColumn("target", target)
    )
    detail = F.concat(F.lit("DKIM "), F.col("qname"), F.lit(" CNAME → "), F.col("target"))
    return _evidence(rows, "dkim", F.col("m.provider"), detail, F.col("target"), no_text(), F.col("m.sig"), F.col("pos"))


def ev_dmarc(dns_txt: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """DMARC records that name a provider."""
    rows = dns_txt.filter(F.startswith("qname", F.lit("_dmarc."))).withColumn("domain", F.substring("qname", 8, 1 << 30))
    rows = _match_rows(rows, F.col("txt"), dims.DMARC_PATTERNS, signatures)
    detail = F.concat(F.lit("DMARC record matches "), F.col("m.provider"))
    return _evidence(rows, "dmarc", F.col("m.provider"), detail, F.col("txt"), no_text(), F.col("pos"), F.col("m.sig"))


def ev_autodiscover(dns_cname: DataFrame, dns_srv: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Autodiscover aliases and service records."""

    def part(records: DataFrame, prefix: str, label: str, order: int) -> DataFrame:
        rows = (
            records.filter(F.startswith("qname", F.lit(prefix)))
            .withColumn("domain", F.substring("qname", len(prefix) + 1, 1 << 30))
            .withColumn("target", host_name(F.col("target")))
        )
        rows = _match_rows(rows, F.col("target"), dims.AUTODISCOVER_PATTERNS, signatures)
        detail = F.concat(F.lit(f"autodiscover {label} → "), F.col("target"))
        return _evidence(rows, "autodiscover", F.col("m.provider"), detail, F.col("target"), no_text(), F.lit(order), F.col("pos"), F.col("m.sig"))

    return part(dns_cname, "autodiscover.", "CNAME", 0).unionByName(
        part(dns_srv, "_autodiscover._tcp.", "SRV", 1)
    )


def alias_jumps(answers: DataFrame, doublings: int) -> list[DataFrame]:
    """Jumps of 1, 2, 4, ... hops as ``(name, to, open)``, each composed of the one before with itself.

    ``answers`` has one row ``(name, to)`` per name.  A jump ends early where its chain ends, and is closed then (``open`` is false); a cycle stays open.  Only open jumps are
    looked up again, and when all are closed the rest of the list repeats the last table.  Each table is written, so a lost executor costs one doubling.
    """
    jumps = [store(answers.select("name", "to", F.lit(True).alias("open")))]
    for _ in range(doublings):
        last = jumps[-1]
        if last.filter("open").isEmpty():
            jumps.append(last)
            continue
        further = last.select(F.col("name").alias("to"), F.col("to").alias("_to"), F.col("open").alias("_open"))
        went = lookup_join(last.filter("open").select("name", "to"), further, ["to"])
        to = F.when(F.col("_open").isNotNull(), F.col("_to")).otherwise(F.col("to"))
        went = went.select("name", to.alias("to"), F.coalesce("_open", F.lit(False)).alias("open"))
        jumps.append(store(went.unionByName(last.filter("NOT open"))))
    return jumps


def cname_ends(hosts: DataFrame, dns_cname: DataFrame, max_hops: int = 10) -> DataFrame:
    """End of the alias chain of every host that has an alias (first answer of each name, at most ``max_hops``, also in a cycle).

    Pointer doubling: ``max_hops`` is a sum of powers of two, so ten hops are a jump of eight and one of two, and the jumps of two, four and eight hops are three joins.
    """
    first = dns_cname.groupBy(F.lower("qname").alias("name")).agg(F.min(F.struct("pos", "target")).alias("first"))
    jumps = alias_jumps(first.select("name", host_name(F.col("first.target")).alias("to")), max_hops.bit_length() - 1)
    walk = hosts.select("host", F.lower("host").alias("name")).distinct()
    how = "inner"
    for power in reversed(range(max_hops.bit_length())):
        if max_hops >> power & 1:
            walk = lookup_join(walk, jumps[power], ["name"], how)
            walk = walk.select("host", F.when(F.col("open").isNotNull(), F.col("to")).otherwise(F.col("name")).alias("name"))
            how = "left"
    return walk.select("host", F.col("name").alias("current"))


def ev_cname_chain(dns_mx: DataFrame, dns_cname: DataFrame, mx_signatures: DataFrame | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """Alias chains of MX hosts that no MX pattern matched, by the end of the chain."""
    every = [p for words in dims.MX_PATTERNS.values() for p in words]
    rows = mx_rows(dns_mx).select("domain", "host")
    if mx_signatures is None:
        rows = rows.filter(~contains_any(F.col("host"), every))
    else:
        rows = matched_texts(rows, F.col("host"), mx_signatures, "_known").filter(~F.col("_known")).drop("_known")
    ends = cname_ends(rows.select("host").distinct(), dns_cname).filter(F.col("current") != F.col("host"))
    hits = _match_rows(ends, F.col("current"), dims.CNAME_PATTERNS, signatures)
    rows = lookup_join(rows, hits, ["host"], "inner")
    detail = F.concat(F.lit("CNAME chain "), F.col("host"), F.lit(" → "), F.col("current"))
    return _evidence(rows, "cname_chain", F.col("m.provider"), detail, F.col("current"), F.col("host"), F.col("m.sig"))


def ev_smtp(dns_mx: DataFrame, smtp_obs: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Greeting of the first MX host."""
    first = mx_rows(dns_mx).groupBy("domain").agg(F.min("host").alias("host"))
    text = F.concat_ws(" ", F.coalesce("banner", no_text()), F.coalesce("ehlo", no_text()))
    hits = _match_rows(smtp_obs.withColumn("host", host_name(F.col("host"))), text, dims.SMTP_PATTERNS, signatures)
    rows = lookup_join(first, hits.select("host", "banner", "m"), ["host"], "inner")
    detail = F.concat(F.lit("SMTP banner matches "), F.col("m.provider"))
    return _evidence(rows, "smtp", F.col("m.provider"), detail, F.col("banner"), no_text(), F.col("m.sig"))


def ev_tenant(tenant_obs: DataFrame) -> DataFrame:
    """Domains with a managed or federated cloud tenant."""
    rows = tenant_obs.filter(F.col("ns_type").isin("Managed", "Federated"))
    detail = F.concat(F.lit("MS365 tenant detected: "), F.col("ns_type"))
    return _evidence(rows, "tenant", F.lit("ms365"), detail, F.col("ns_type"), no_text(), F.lit(0))


def _network_providers(asn: Column, registered: Column, country: Column) -> Column:
    """Array of (sig, provider, suffix): owners of the network, then domestic or foreign by registration."""
    owners = [
        F.when(
            asn.isin(numbers),
            F.struct(F.lit(i).alias("sig"), F.lit(p).alias("provider"), F.lit(f" matches {p}").alias("suffix")),
        )
        for i, (p, numbers) in enumerate(dims.ASNS.items())
    ]
    known = (F.coalesce(country, no_text()) != "") & (F.coalesce(registered, no_text()) != "")
    place = F.when(
        known,
        F.struct(
            F.lit(len(owners)).alias("sig"),
            F.when(registered == country, "domestic").otherwise("foreign").alias("provider"),
            F.concat(
                F.lit(" registered in "),
                F.upper(registered),
                F.when(registered == country, "").otherwise(F.concat(F.lit(" (not "), F.upper(country), F.lit(")"))),
            ).alias("suffix"),
        ),
    )
    return F.filter(F.array(*owners, place), lambda m: m.isNotNull())


def host_networks(hosts: DataFrame, dns_a: DataFrame, asn_obs: DataFrame) -> DataFrame:
    """(host, ip, apos, asn, registered) of every distinct host: each host is resolved once for all its domains."""
    # Hosts are distinct here, so only addresses can be hot; they are counted on the answers, which only need a scan.
    ips = hosts.select("host").distinct().join(dns_a.select("host", "ip", F.col("pos").alias("apos")), "host")
    return lookup_join(ips, _networks(asn_obs), ["ip"], "inner", weigh=dns_a)


def _networks(asn_obs: DataFrame) -> DataFrame:
    rows = asn_obs.select("ip", asn_number(F.col("txt")).alias("asn"), asn_country(F.col("txt")).alias("registered"))
    return rows.distinct().filter(F.col("asn").isNotNull())


def ev_asn(dns_mx: DataFrame, dns_a: DataFrame, asn_obs: DataFrame, country: Column) -> DataFrame:
    """Networks of all addresses of all MX hosts.  ``country`` is a literal or a column of ``dns_mx``."""
    rows = store(mx_rows(dns_mx).withColumn("cc", country))
    networks = store(host_networks(rows, dns_a, asn_obs))
    rows = lookup_join(rows, networks, ["host"], "inner").withColumn(
        "m", F.explode(_network_providers(F.col("asn"), F.col("registered"), F.col("cc")))
    )
    detail = F.concat(F.lit("ASN "), F.col("asn"), F.col("m.suffix"))
    return _evidence(
        rows, "asn", F.col("m.provider"), detail, F.col("asn").cast("string"), F.col("host"), F.col("apos"), F.col("m.sig")
    )


def ev_txt(dns_txt: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Verification strings, and any record under ``_amazonses.``."""
    own = _match_rows(
        dns_txt.filter(~F.startswith("qname", F.lit("_"))).withColumn("domain", F.col("qname")), F.col("txt"), dims.TXT_PATTERNS, signatures
    )
    own = _evidence(
        own,
        "txt_verification",
        F.col("m.provider"),
        F.concat(F.lit("TXT verification matches "), F.col("m.provider")),
        F.col("txt"),
        no_text(),
        F.lit(0),
        F.col("pos"),
        F.col("m.sig"),
    )
    ses = dns_txt.filter(F.startswith("qname", F.lit("_amazonses.")) & (F.col("txt") != "")).withColumn(
        "domain", F.substring("qname", 12, 1 << 30)
    )
    ses = _evidence(
        ses,
        "txt_verification",
        F.lit("aws"),
        F.lit("AWS SES domain verification found"),
        F.col("txt"),
        no_text(),
        F.lit(1),
        F.col("pos"),
    )
    return own.unionByName(ses)


def spf_addresses(dns_txt: DataFrame, dns_a: DataFrame) -> DataFrame:
    """Addresses an SPF record authorises, in record order: ``ip4:`` without mask, and those of ``a:`` hosts."""
    records = dns_txt.filter(F.lower("txt").startswith("v=spf1")).select(F.col("qname").alias("domain"), "pos", "txt")
    tokens = spf_tokens(records, "txt").drop("txt").withColumn("value", after_colon(F.col("token")))
    direct = tokens.filter(F.lower("token").startswith("ip4:")).select(
        "domain", "pos", "token_pos", F.lit(0).alias("apos"), F.substring_index("value", "/", 1).alias("ip")
    )
    named = tokens.filter(F.lower("token").startswith("a:")).select(
        "domain", "pos", "token_pos", F.col("value").alias("host")
    )
    resolved = lookup_join(named, dns_a.select("host", "ip", F.col("pos").alias("apos")), ["host"], "inner").select(
        "domain", "pos", "token_pos", "apos", "ip"
    )
    return direct.unionByName(resolved)


def spf_networks(dns_txt: DataFrame, dns_a: DataFrame, asn_obs: DataFrame) -> DataFrame:
    """Every network once per domain, with the first address in record order that belongs to it."""
    rows = lookup_join(store(spf_addresses(dns_txt, dns_a)), _networks(asn_obs), ["ip"], "inner")
    first = F.min(F.struct("pos", "token_pos", "apos", "ip", "registered")).alias("first")
    return rows.groupBy("domain", "asn").agg(first).select("domain", "asn", "first.*")


def ev_spf_ip(dns_txt: DataFrame, dns_a: DataFrame, asn_obs: DataFrame, country: Column) -> DataFrame:
    """Networks of the addresses in SPF records.  ``country`` is a literal or an expression on ``domain``."""
    rows = spf_networks(dns_txt, dns_a, asn_obs).withColumn(
        "m", F.explode(_network_providers(F.col("asn"), F.col("registered"), country))
    )
    detail = F.concat(F.lit("SPF ip4/a ASN "), F.col("asn"), F.col("m.suffix"))
    raw = F.concat(F.col("ip"), F.lit(":"), F.col("asn"))
    order = [F.col(c) for c in ("pos", "token_pos", "apos", "m.sig")]
    return _evidence(rows, "spf_ip", F.col("m.provider"), detail, raw, no_text(), *order)


def gateway_of(host: Column) -> Column:
    """Gateway product of one host, first product in the fixed order; null when none."""
    return first_match(
        ((contains_any(host, words), F.lit(name)) for name, words in dims.GATEWAYS.items()), F.lit(None).cast("string")
    )


def detect_gateway(dns_mx: DataFrame) -> DataFrame:
    """Gateway of the first host, in sorted order, that belongs to one."""
    rows = dns_mx.select("domain", host_name(F.col("host")).alias("host")).withColumn("gateway", gateway_of(F.col("host")))
    # No filter before the aggregate: it would be pushed below the projection and evaluate the cascade a second time.
    first = F.min(F.when(F.col("gateway").isNotNull(), F.struct("host", "gateway"))).alias("first")
    return rows.groupBy("domain").agg(first).filter(F.col("first").isNotNull()).select("domain", F.col("first.gateway").alias("gateway"))


def mx_profile(dns_mx: DataFrame) -> DataFrame:
    """Per domain: number of distinct MX hosts and the gateway, from one pass over the answers."""
    rows = dns_mx.select("domain", host_name(F.col("host")).alias("host")).withColumn("gateway", gateway_of(F.col("host")))
    first = F.min(F.when(F.col("gateway").isNotNull(), F.struct("host", "gateway")))
    return rows.groupBy("domain").agg(first.alias("first"), F.count(F.lit(1)).alias("mx_answers")).select(
        "domain", (F.col("mx_answers") > 0).alias("has_mx"), F.col("first.gateway").alias("gateway")
    )


def assemble_evidence(*frames: DataFrame) -> DataFrame:
    """All evidence in one table; ``kind_ord, skey, pos`` hold the assembly order."""
    return reduce(DataFrame.unionByName, [f.select(*COLUMNS) for f in frames])
