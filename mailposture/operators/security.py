"""Scan logs to server rows, server rows to domains, domains to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.text import normalize_code, to_bool
from mailposture.operators.reports import n_rows, true
from mailposture.skew import lookup_join, semi_join

AUTH_FLAGS = ["has_spf", "has_good_spf", "has_dmarc", "has_good_dmarc", "has_dkim"]
DANE_FLAGS = ["dane_supported", "dane_partial"]

STARTTLS_SEARCH = '=== we\'ll have to search for "^250[ -]STARTTLS" pattern ===\n'
STARTTLS_MISSING = "=== finished smtp STARTTLS dialog with 3 ===\n\nFatal error: No STARTTLS found in handshake"


# --- addresses ----------------------------------------------------------------------------------------------------


def parse_dig_logs(logs: DataFrame) -> DataFrame:
    """Answers of a DNS query log ``(qname, type, log)`` as ``(qname, type, answers, ad)``.

    An answer is the last word of a line of the queried type behind the answer header, in lower case; for MX its final
    dot is dropped.  ``ad`` is set when the first flags line contains ``ad``.
    """
    lines = F.split("log", "\n", -1)
    start = F.array_position(lines, ";; ANSWER SECTION:")
    tail = F.when(start > 0, F.slice(lines, (start + 1).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    typed = F.filter(tail, lambda line: F.array_contains(F.split(line, "[\t ]", -1), F.col("type")))

    def answer(line: Column) -> Column:
        word = F.lower(F.element_at(F.split(line, "[\t ]", -1), -1))
        return F.when(F.col("type") == "MX", F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)

    flags = F.get(F.filter(lines, lambda line: F.startswith(line, F.lit(";; flags:"))), F.lit(0))
    return logs.select(
        "qname", "type", F.transform(typed, answer).alias("answers"), F.coalesce(F.contains(flags, F.lit("ad")), F.lit(False)).alias("ad")
    )


def domain_mx(domains: DataFrame, mx_obs: DataFrame) -> DataFrame:
    """Every MX answer of every domain ``(domain, mx, ad)``; a domain without answers stays with nulls."""
    answers = semi_join(mx_obs.select("domain", "mx", "ad").distinct(), domains, ["domain"])
    silent = domains.select("domain").distinct().join(answers.select("domain").distinct(), "domain", "left_anti")
    return answers.unionByName(silent, allowMissingColumns=True)


def scan_addresses(domain_mx: DataFrame, a_obs: DataFrame) -> DataFrame:
    """Every address of every MX; each distinct MX is resolved once for all its domains.

    Without an address both ``ip`` and the authenticity flag are null.
    """
    ips = a_obs.select("mx", "ip").distinct()
    joined = lookup_join(domain_mx, ips, ["mx"])
    return joined.select("domain", "mx", "ip", F.when(F.col("ip").isNotNull(), F.col("ad")).alias("ad")).distinct()


def scan_worklists(addresses: DataFrame) -> dict[str, DataFrame]:
    """Work for the scanners: distinct (mx, ip) for TLS, domains for authentication records, MX for DANE."""
    with_mx = addresses.filter(F.col("mx").isNotNull())
    return {
        "tls": with_mx.filter(F.col("ip").isNotNull()).select("mx", "ip").distinct(),
        "domains": addresses.select("domain").distinct(),
        "dane": with_mx.select("mx").distinct(),
    }


def scan_targets(entity_domains: DataFrame) -> DataFrame:
    """Distinct mail domains as ``info@domain``, sorted; ``emails`` holds all domains of an entity."""
    domains = entity_domains.select(F.explode("emails").alias("domain")).filter(F.col("domain") != "").distinct()
    return domains.select(F.concat(F.lit("info@"), F.col("domain")).alias("address")).orderBy("address")


# --- verdicts from logs -------------------------------------------------------------------------------------------


def first_line(log: Column, keyword: str, anywhere: bool = False) -> Column:
    """First line that starts with ``keyword`` (after blanks), or that contains it; null when none."""
    lines = F.split(log, r"\r\n|\n|\r", -1)
    if anywhere:
        return F.get(F.filter(lines, lambda line: F.contains(line, F.lit(keyword))), F.lit(0))
    return F.get(F.filter(lines, lambda line: line.rlike(rf"^\s*{keyword}")), F.lit(0))


def tls_flags(tls_logs: DataFrame) -> DataFrame:
    """Per (host, ip): offered protocol versions; null when the test is invalid, false without STARTTLS."""
    log = F.col("log")
    offered = F.contains(log, F.lit("PROTOS_OFFERED:"))
    after = F.substring(log, F.locate(STARTTLS_SEARCH, log) + F.lit(len(STARTTLS_SEARCH)), F.lit(3))
    no_starttls = (F.locate(STARTTLS_SEARCH, log) > 0) & (after == "S: ") & F.contains(log, F.lit(STARTTLS_MISSING))
    protocols = first_line(log, "PROTOS_OFFERED:", anywhere=True)

    def flag(key: str) -> Column:
        return F.when(offered, F.coalesce(F.contains(protocols, F.lit(f"{key}:yes")), F.lit(False))).when(no_starttls, F.lit(False))

    return tls_logs.select("host", "ip", *position(tls_logs), *[flag(key).alias(name) for name, key in zip(dims.TLS_FLAGS, dims.TLS_LOG_KEYS)])


DANE_HEADER = r"^## Checking (\S+) (\S+) port 25$"


DANE_OK = "Result: DANE OK"


def position(logs: DataFrame) -> list[str]:
    """The column that orders the logs of one target, where there is one."""
    return ["pos"] if "pos" in logs.columns else []


def first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row by ``pos`` of every key; without ``pos`` the least row, so that the choice does not depend on the order of arrival."""
    rest = [c for c in rows.columns if c not in (*keys, "pos")]
    least = F.min(F.struct(*position(rows), *rest)).alias("first")
    return rows.groupBy(*keys).agg(least).select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])


def dane_blocks(dane_logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts in the logs: per (mx, ip) named in a header, and per mx for the lines at the start of its log.

    A log is cut once at its blank lines.  A header is followed by success if such a line comes after it in the same part, so a part is
    read once however many headers it has.  Logs are judged where they lie; only verdicts are shuffled.  ``log`` is the log's position.
    """
    parts = F.split(F.regexp_replace("log", r"(?md)^[ \t\r\f\x0B]*$", "\u0001"), "\u0001")
    at = F.col("pos") if position(dane_logs) else F.lit(0)
    logs = dane_logs.select(F.col("host").alias("mx"), at.cast("bigint").alias("log"), F.posexplode(parts).alias("part", "text"))
    lines = logs.select("mx", "log", "part", F.split("text", "\n", -1).alias("lines"))
    success = F.transform("lines", lambda line, i: F.when(F.startswith(line, F.lit(DANE_OK)), i))
    lines = lines.withColumn("success", F.array_max(success))

    def verdict(line: Column, i: Column) -> Column:
        fields = F.struct(
            i.alias("pos"),
            F.regexp_extract(line, DANE_HEADER, 1).alias("named"),
            F.regexp_extract(line, DANE_HEADER, 2).alias("ip"),
            F.coalesce(F.col("success") > i, F.lit(False)).alias("ok"),
        )
        return F.when(line.rlike(DANE_HEADER), fields)

    found = F.filter(F.transform("lines", verdict), lambda v: v.isNotNull())
    named = lines.select("mx", "log", "part", F.explode(found).alias("v")).filter(F.col("v.named") == F.col("mx"))
    first = named.groupBy("mx", F.col("v.ip").alias("ip")).agg(F.min(F.struct("log", "part", "v.pos", "v.ok")).alias("first"))
    start = lines.filter(F.col("part") == 0).select("mx", "log", F.col("success").isNotNull().alias("start_ok"))
    start = start.groupBy("mx").agg(F.min("log").alias("first_log"), F.max_by("start_ok", F.struct(-F.col("log"), "start_ok")).alias("start_ok"))
    return first.select("mx", "ip", F.col("first.log").alias("log"), F.col("first.ok").alias("named_ok")), start


def dane_flags(addresses: DataFrame, dane_logs: DataFrame) -> DataFrame:
    """Per distinct (mx, ip): whether the first log of the MX shows DANE for it; only pairs whose MX was tested.

    Without a header for the pair, the lines at the start of the log decide.
    """
    pairs = addresses.filter(F.col("mx").isNotNull() & F.col("ip").isNotNull()).select("mx", "ip").distinct()
    named, start = dane_blocks(dane_logs)
    rows = lookup_join(pairs.join(named, ["mx", "ip"], "left"), start, ["mx"], "inner", weigh=pairs)
    in_first = F.when(F.col("log") == F.col("first_log"), F.col("named_ok"))
    return rows.select("mx", "ip", F.coalesce(in_first, "start_ok").alias("mx_dane"))


def dss_flags(dss_logs: DataFrame, strict: bool = False) -> DataFrame:
    """Per domain: authentication records found by the log, and whether they enforce.

    ``strict`` reads the policy tag of DMARC itself; by default any ``p=reject`` counts, also that of ``sp=``.
    """
    spf, dmarc, dkim = (first_line(F.col("log"), f"{k}:") for k in ("spf", "dmarc", "dkim"))
    reject = dmarc.rlike(r"(^|[;\s:])p\s*=\s*reject\b") if strict else F.contains(dmarc, F.lit("p=reject"))
    return dss_logs.select(
        "domain",
        *position(dss_logs),
        dmarc.isNotNull().alias("has_dmarc"),
        F.coalesce(reject, F.lit(False)).alias("has_good_dmarc"),
        spf.isNotNull().alias("has_spf"),
        F.coalesce(F.contains(spf, F.lit("-all")), F.lit(False)).alias("has_good_spf"),
        dkim.isNotNull().alias("has_dkim"),
    )


def build_mta(addresses: DataFrame, tls_logs: DataFrame, dane_logs: DataFrame, dss_logs: DataFrame) -> DataFrame:
    """Evaluated server rows: one per address, verdicts null where a test is missing or invalid.

    Logs are judged where they lie, before anything is joined or made distinct, so the long texts are never shuffled.  Of several logs
    of one target the first by ``pos`` counts.
    """
    tls = first_of(tls_flags(tls_logs), ["host", "ip"]).withColumnRenamed("host", "mx")
    dane = dane_flags(addresses, dane_logs)
    tested = dane_logs.select(F.col("host").alias("mx"), F.lit(True).alias("dane_tested")).distinct()
    dss = first_of(dss_flags(dss_logs), ["domain"])
    rows = lookup_join(addresses, tls.join(dane, ["mx", "ip"], "full"), ["mx", "ip"])
    rows = lookup_join(rows, tested, ["mx"], weigh=addresses)
    rows = lookup_join(rows, dss, ["domain"], weigh=addresses)
    has_dane = F.when(F.col("dane_tested"), F.coalesce("ad", F.lit(False)) & F.coalesce("mx_dane", F.lit(False)))
    return rows.withColumn("has_dane", has_dane).select("domain", "mx", "ip", "has_dane", *dims.TLS_FLAGS, *AUTH_FLAGS)


def valid_mta(mta: DataFrame) -> DataFrame:
    """Rows whose TLS and DANE tests are all valid and that have a server and an address."""
    valid = F.col("mx").isNotNull() & F.col("ip").isNotNull() & F.col("has_dane").isNotNull()
    for flag in dims.TLS_FLAGS:
        valid = valid & F.col(flag).isNotNull()
    return mta.filter(valid)


# --- domains and entities -----------------------------------------------------------------------------------------


def domain_security(mta: DataFrame) -> DataFrame:
    """One row per domain: DANE on all or any server, authentication of the first row that has it.

    Null verdicts do not count; a domain with nulls only is not supported.  ``pos`` gives the row order.
    """
    order = F.struct("pos", *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in AUTH_FLAGS])
    first = F.min(F.when(F.col("has_dmarc").isNotNull() | F.col("has_spf").isNotNull(), order))
    rows = mta.groupBy("domain").agg(
        F.coalesce(F.bool_and("has_dane"), F.lit(False)).alias("dane_supported"),
        F.coalesce(F.bool_or("has_dane"), F.lit(False)).alias("dane_partial"),
        first.alias("first"),
    )
    auth = [F.coalesce(F.col(f"first.{f}"), F.lit(False)).alias(f) for f in AUTH_FLAGS]
    return rows.select("domain", *DANE_FLAGS, *auth, F.lit(True).alias("scan_valid"))


def domain_mx_records(mta: DataFrame) -> DataFrame:
    """Sorted distinct servers per domain, for output rows."""
    return mta.groupBy("domain").agg(F.sort_array(F.collect_set("mx")).alias("mx_records"))


def attach_security(entity: DataFrame, dsec: DataFrame) -> DataFrame:
    """Security of the primary domain for every entity; nulls and an invalid scan where there is none."""
    joined = lookup_join(entity, dsec, ["domain"])
    return joined.withColumn("scan_valid", F.coalesce("scan_valid", F.lit(False)))


def apply_security_overrides(security: DataFrame, overrides: DataFrame) -> DataFrame:
    """Fields of an override replace those of entities that have scan data; the scan then counts as valid.

    ``overrides`` has the same flag columns (null: keep) and ``source``; rows without a source are rejected before.
    """
    flags = DANE_FLAGS + AUTH_FLAGS
    ov = overrides.filter(F.col("source").isNotNull()).select(
        "country", "code", *[F.col(f).alias(f"_{f}") for f in flags], F.col("source").alias("override_source")
    )
    rows = security.join(ov, ["country", "code"], "left")
    has_dane, has_dss = F.col("_had_dane"), F.col("_had_dss")
    rows = rows.withColumn("_had_dane", F.col("dane_supported").isNotNull()).withColumn("_had_dss", F.col("has_spf").isNotNull())
    replaced = {
        f: F.when(has_dane if f in DANE_FLAGS else has_dss, F.coalesce(F.col(f"_{f}"), F.col(f))).otherwise(F.col(f)) for f in flags
    }
    valid = F.when(F.col("override_source").isNotNull(), F.lit(True)).otherwise(F.col("scan_valid"))
    return rows.withColumns(replaced).withColumn("scan_valid", valid).drop("_had_dane", "_had_dss", *[f"_{f}" for f in flags])


def security_counts(security: DataFrame) -> DataFrame:
    names = {"scanned": "scan_valid", "dane_supported": "dane_supported", "spf": "has_spf", "good_spf": "has_good_spf",
             "dmarc": "has_dmarc", "good_dmarc": "has_good_dmarc", "dkim": "has_dkim"}
    return security.agg(n_rows().alias("total"), *[F.count_if(true(c)).alias(n) for n, c in names.items()])


# --- third-party results ------------------------------------------------------------------------------------------

SOURCE_FIELDS = {
    "hasDane": "dane_supported", "hasSpf": "has_spf", "hasGoodSpf": "has_good_spf", "hasDmarc": "has_dmarc",
    "hasGoodDmarc": "has_good_dmarc",
}


def keyed_flat(flat: DataFrame, width: int | None) -> DataFrame:
    """Flat result rows ``(country, code, …)`` with a text code and boolean flags; flags arrive as text.

    A result is that of one country, named in the column ``country``.  Of several rows with one code the last by ``pos`` counts.
    """
    order = F.col("pos").cast("bigint") if position(flat) else F.lit(0).cast("bigint")
    rows = flat.select(
        "country",
        order.alias("pos"),
        normalize_code(F.col("code"), width).alias("code"),
        F.when(~F.col("mxrecordName").isin("", "0"), F.col("mxrecordName")).alias("mx"),
        F.col("emails").alias("flat_domain"),
        *[to_bool(F.col(src)).alias(f"f_{dst}") for src, dst in SOURCE_FIELDS.items()],
    )
    rest = [c for c in rows.columns if c not in ("country", "code", "pos")]
    last = rows.groupBy("country", "code").agg(F.max(F.struct("pos", *rest)).alias("last"))
    return last.select("country", "code", *[F.col(f"last.{c}").alias(c) for c in rest])


def convert_flat_result(entity: DataFrame, flat: DataFrame, width: int | None) -> DataFrame:
    """Security rows from a third-party result; entities without one are not scanned."""
    rows = entity.join(keyed_flat(flat, width).withColumn("_found", F.lit(True)), ["country", "code"], "left")
    found = F.coalesce("_found", F.lit(False))
    any_flag = F.col("f_has_spf") | F.col("f_has_dmarc") | F.col("f_dane_supported")
    domain = F.when(F.coalesce("domain", F.lit("")) == "", F.coalesce("flat_domain", F.lit(""))).otherwise(F.col("domain"))
    return rows.select(
        *[c for c in entity.columns if c != "domain"],
        F.when(found, domain).otherwise(F.coalesce("domain", F.lit(""))).alias("domain"),
        F.when(found & F.col("mx").isNotNull(), F.array("mx")).otherwise(F.array().cast("array<string>")).alias("mx_records"),
        F.when(found, F.col("f_dane_supported")).alias("dane_supported"),
        F.when(found, F.col("f_dane_supported")).alias("dane_partial"),
        *[F.when(found, F.col(f"f_{f}")).alias(f) for f in AUTH_FLAGS if f != "has_dkim"],
        F.when(found, F.lit(False)).alias("has_dkim"),
        (found & (F.col("mx").isNotNull() | any_flag)).alias("scan_valid"),
    )


def merge_dane(security: DataFrame, flat: DataFrame, width: int | None) -> DataFrame:
    """Replace only the DANE flags by those of a third-party result; ``changed`` marks rows with a new value."""
    rows = security.join(keyed_flat(flat, width).select("country", "code", F.col("f_dane_supported").alias("_new")), ["country", "code"], "left")
    old = F.coalesce("dane_supported", F.lit(False))
    return (
        rows.withColumn("changed", F.coalesce(old != F.col("_new"), F.lit(False)))
        .withColumn("dane_supported", F.coalesce("_new", "dane_supported"))
        .withColumn("dane_partial", F.coalesce("_new", "dane_partial"))
        .drop("_new")
    )


def verify_conversion(flat: DataFrame, security: DataFrame, width: int | None) -> DataFrame:
    """Differences between a third-party result and security rows, field by field, and codes without a row."""
    rows = keyed_flat(flat, width).join(security.withColumn("_found", F.lit(True)), ["country", "code"], "left")
    missing = F.struct(F.lit("row").alias("field"), F.lit("missing from output").alias("problem"))
    items = [F.when(F.col("_found").isNull(), missing)]
    for field, column in SOURCE_FIELDS.items():
        want, got = F.col(f"f_{column}"), F.coalesce(F.col(column), F.lit(False))
        text = F.concat(F.lit("source "), want.cast("string"), F.lit(", output "), got.cast("string"))
        items.append(F.when(F.col("_found") & (want != got), F.struct(F.lit(field).alias("field"), text.alias("problem"))))
    problems = F.filter(F.array(*items), lambda x: x.isNotNull())
    return rows.select("country", "code", F.explode(problems).alias("p")).select("country", "code", "p.field", "p.problem")
