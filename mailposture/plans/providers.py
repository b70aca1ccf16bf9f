"""Queries over evidence, classification, provider reports and the export."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions import labels, text
from mailposture.operators import classify as cls
from mailposture.operators import evidence as ev
from mailposture.operators import export as ex
from mailposture.operators import reports as rp
from mailposture.operators import signatures as sg
from mailposture.plans.registry import BODY, query, r6
from mailposture.skew import lookup_join

# --- SQL fragments ------------------------------------------------------------------------------------------------


def sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w.lower()}')" for w in words) + ")" if words else "false"


def sql_matches(column: str, patterns: dict[str, list[str]]) -> str:
    """Rows (provider, sig) whose patterns occur, for a lateral join."""
    return " UNION ALL ".join(
        f"SELECT '{p}' AS provider, {i} AS sig WHERE {sql_any(column, words)}" for i, (p, words) in enumerate(patterns.items()) if words
    )


SQL_GATEWAY = "CASE " + " ".join(f"WHEN {sql_any('host', words)} THEN '{g}'" for g, words in dims.GATEWAYS.items()) + " END"
SQL_KIND_ORD = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(dims.KINDS)) + " END"
SQL_GW = f"""
  gw AS (SELECT domain, arg_min(gateway, host) AS gateway
         FROM (SELECT domain, host, {SQL_GATEWAY} AS gateway FROM v_mx) g WHERE gateway IS NOT NULL GROUP BY domain)"""
SQL_SPF = """
  spf AS (SELECT qname AS domain, arg_min(txt, pos) AS spf FROM v_txt WHERE starts_with(lower(txt), 'v=spf1') GROUP BY qname)"""
SQL_COUNTS = ", ".join(f"CAST(count(*) FILTER (provider = '{p}') AS BIGINT) AS \"{p}\"" for p in dims.OUTPUT_PROVIDERS)
SQL_ABBR = (
    "coalesce(CASE country "
    + " ".join(
        f"WHEN '{cc}' THEN CASE region " + " ".join(f"WHEN '{r}' THEN '{a.upper()}'" for r, a in table.items()) + " END"
        for cc, table in dims.REGION_ABBREVIATIONS.items()
    )
    + " END, CASE WHEN region <> '' THEN substr(region, 1, 4) ELSE '??' END)"
)
SQL_REGION = "(CASE WHEN region = '' THEN '??' ELSE regexp_replace(region, '^Kanton ', '') END)"
SQL_NAME = f"CASE WHEN length({SQL_REGION}) > 18 THEN substr({SQL_REGION}, 1, 17) || '.' ELSE {SQL_REGION} END"
SQL_DISPLAY = f"CASE {SQL_REGION} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dims.REGION_DISPLAY.items()) + f" ELSE {SQL_REGION} END"
SQL_KINDS = "kinds AS (SELECT country, code, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds, count(DISTINCT kind) AS nk FROM v_signal GROUP BY country, code)"


def sql_pct(part: str, whole: str, name: str) -> str:
    return f"round(CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} * 100 ELSE 0 END, 6) AS {name}"


# --- evidence -----------------------------------------------------------------------------------------------------

EVIDENCE = ["domain", "kind", "provider", "weight", "detail", "raw"]


def shown(df):
    return df.select(*EVIDENCE)


@query(
    "evidence_mx",
    f"""SELECT DISTINCT domain, 'mx' AS kind, m.provider, CAST(0.2 AS DOUBLE) AS weight, 'MX ' || host || ' matches ' || m.provider AS detail, host AS raw
    FROM v_mx, LATERAL ({sql_matches('host', dims.MX_PATTERNS)}) m""",
)
def evidence_mx(t):
    return shown(ev.ev_mx(t("v_mx")))


@query(
    "evidence_spf_include",
    f"""WITH {SQL_SPF}, tok AS (SELECT domain, spf, unnest(regexp_split_to_array(trim(spf), '\\s+')) AS token FROM spf),
      inc AS (SELECT domain, spf, substr(token, 9) AS target FROM tok WHERE starts_with(lower(token), 'include:'))
    SELECT domain, 'spf' AS kind, m.provider, CAST(0.2 AS DOUBLE) AS weight, 'SPF include:' || target || ' matches ' || m.provider AS detail, spf AS raw
    FROM inc, LATERAL ({sql_matches('target', dims.SPF_INCLUDES)}) m""",
)
def evidence_spf_include(t):
    return shown(ev.ev_spf(ev.spf_record(t("v_txt"))))


@query("spf_records", f"WITH {SQL_SPF} SELECT * FROM spf")
def spf_records(t):
    return ev.spf_record(t("v_txt"))


@query(
    "evidence_dkim",
    """SELECT regexp_replace(qname, '^[^.]+[.]_domainkey[.]', '') AS domain, 'dkim' AS kind,
      CASE WHEN starts_with(qname, 'selector') THEN 'ms365' ELSE 'google' END AS provider, CAST(0.15 AS DOUBLE) AS weight,
      'DKIM ' || qname || ' CNAME → ' || lower(rtrim(target, '.')) AS detail, lower(rtrim(target, '.')) AS raw
    FROM v_cname
    WHERE ((starts_with(qname, 'selector1._domainkey.') OR starts_with(qname, 'selector2._domainkey.')) AND contains(lower(target), 'onmicrosoft.com'))
       OR (starts_with(qname, 'google._domainkey.') AND contains(lower(target), 'domainkey.google.com'))""",
)
def evidence_dkim(t):
    return shown(ev.ev_dkim(t("v_cname")))


@query(
    "evidence_dmarc",
    """SELECT substr(qname, 8) AS domain, 'dmarc' AS kind, 'ms365' AS provider, CAST(0.02 AS DOUBLE) AS weight,
      'DMARC record matches ms365' AS detail, txt AS raw FROM v_txt WHERE starts_with(qname, '_dmarc.') AND contains(lower(txt), 'rua.agari.com')""",
)
def evidence_dmarc(t):
    return shown(ev.ev_dmarc(t("v_txt")))


@query(
    "evidence_autodiscover",
    f"""WITH a AS (SELECT substr(qname, 14) AS domain, 'CNAME' AS via, lower(rtrim(target, '.')) AS target FROM v_cname WHERE starts_with(qname, 'autodiscover.')
      UNION ALL SELECT substr(qname, 20), 'SRV', lower(rtrim(target, '.')) FROM v_srv WHERE starts_with(qname, '_autodiscover._tcp.'))
    SELECT domain, 'autodiscover' AS kind, m.provider, CAST(0.08 AS DOUBLE) AS weight, 'autodiscover ' || via || ' → ' || target AS detail, target AS raw
    FROM a, LATERAL ({sql_matches('target', dims.AUTODISCOVER_PATTERNS)}) m""",
)
def evidence_autodiscover(t):
    return shown(ev.ev_autodiscover(t("v_cname"), t("v_srv")))


ALL_MX = [w for words in dims.MX_PATTERNS.values() for w in words]


@query(
    "cname_chain",
    f"""WITH RECURSIVE nxt AS (SELECT lower(qname) AS q, lower(rtrim(arg_min(target, (pos, target)), '.')) AS n FROM v_cname GROUP BY lower(qname)),
      hosts AS (SELECT DISTINCT host FROM v_mx WHERE NOT {sql_any('host', ALL_MX)}),
      walk AS (SELECT host, host AS cur, 0 AS hop FROM hosts UNION ALL SELECT host, n, hop + 1 FROM walk JOIN nxt ON cur = q WHERE hop < 10),
      ends AS (SELECT host, arg_max(cur, hop) AS cur FROM walk GROUP BY host),
      hit AS (SELECT host, cur, m.provider FROM ends, LATERAL ({sql_matches('cur', dims.CNAME_PATTERNS)}) m WHERE cur <> host)
    SELECT DISTINCT domain, 'cname_chain' AS kind, provider, CAST(0.03 AS DOUBLE) AS weight, 'CNAME chain ' || host || ' → ' || cur AS detail, cur AS raw
    FROM v_mx JOIN hit USING (host)""",
)
def cname_chain(t):
    return shown(ev.ev_cname_chain(t("v_mx"), t("v_cname")))


@query(
    "evidence_smtp",
    f"""WITH f AS (SELECT domain, min(host) AS host FROM v_mx GROUP BY domain)
    SELECT domain, 'smtp' AS kind, m.provider, CAST(0.04 AS DOUBLE) AS weight, 'SMTP banner matches ' || m.provider AS detail, banner AS raw
    FROM f JOIN (SELECT *, banner || ' ' || ehlo AS greeting FROM v_smtp) s USING (host), LATERAL ({sql_matches('greeting', dims.SMTP_PATTERNS)}) m""",
)
def evidence_smtp(t):
    return shown(ev.ev_smtp(t("v_mx"), t("v_smtp")))


@query(
    "evidence_tenant",
    """SELECT domain, 'tenant' AS kind, 'ms365' AS provider, CAST(0.1 AS DOUBLE) AS weight, 'MS365 tenant detected: ' || ns_type AS detail, ns_type AS raw
    FROM v_tenant WHERE ns_type IN ('Managed', 'Federated')""",
)
def evidence_tenant(t):
    return shown(ev.ev_tenant(t("v_tenant")))


SQL_NET = r"""
  net AS (SELECT DISTINCT ip, CAST(trim(split_part(txt, '|', 1)) AS BIGINT) AS asn, lower(trim(split_part(txt, '|', 3))) AS registered
          FROM v_asn WHERE regexp_matches(trim(split_part(txt, '|', 1)), '^[0-9]+$'))"""
SQL_OWNERS = """(SELECT CASE asn WHEN 8075 THEN 'ms365' WHEN 15169 THEN 'google' WHEN 396982 THEN 'google' WHEN 16509 THEN 'aws' WHEN 14618 THEN 'aws' END AS provider,
      ' matches ' || CASE asn WHEN 8075 THEN 'ms365' WHEN 15169 THEN 'google' WHEN 396982 THEN 'google' ELSE 'aws' END AS suffix
      WHERE asn IN (8075, 15169, 396982, 16509, 14618)
    UNION ALL SELECT CASE WHEN registered = 'ch' THEN 'domestic' ELSE 'foreign' END,
      ' registered in ' || upper(registered) || CASE WHEN registered = 'ch' THEN '' ELSE ' (not CH)' END WHERE registered <> '')"""


@query(
    "evidence_asn",
    f"""WITH {SQL_NET}
    SELECT domain, 'asn' AS kind, m.provider, CAST(0.03 AS DOUBLE) AS weight, 'ASN ' || asn || m.suffix AS detail, CAST(asn AS STRING) AS raw
    FROM (SELECT DISTINCT domain, host FROM v_mx) x JOIN v_a USING (host) JOIN net USING (ip), LATERAL {SQL_OWNERS} m""",
)
def evidence_asn(t):
    return shown(ev.ev_asn(t("v_mx"), t("v_a"), t("v_asn"), F.lit("ch")))


@query(
    "evidence_txt",
    f"""SELECT qname AS domain, 'txt_verification' AS kind, m.provider, CAST(0.07 AS DOUBLE) AS weight, 'TXT verification matches ' || m.provider AS detail, txt AS raw
      FROM v_txt, LATERAL ({sql_matches('txt', dims.TXT_PATTERNS)}) m WHERE NOT starts_with(qname, '_')
    UNION ALL SELECT substr(qname, 12), 'txt_verification', 'aws', CAST(0.07 AS DOUBLE), 'AWS SES domain verification found', txt
      FROM v_txt WHERE starts_with(qname, '_amazonses.') AND txt <> ''""",
)
def evidence_txt(t):
    return shown(ev.ev_txt(t("v_txt")))


SQL_SPF_IP = f"""{SQL_NET},
  rec AS (SELECT qname AS domain, pos, regexp_split_to_array(trim(txt), '\\s+') AS tokens FROM v_txt WHERE starts_with(lower(txt), 'v=spf1')),
  tok AS (SELECT domain, pos, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS token_pos FROM rec),
  addr AS (SELECT domain, pos, token_pos, 0 AS apos, split_part(substr(token, 5), '/', 1) AS ip FROM tok WHERE starts_with(lower(token), 'ip4:')
    UNION ALL SELECT domain, tok.pos, token_pos, v_a.pos, ip FROM tok JOIN v_a ON v_a.host = substr(token, 3) WHERE starts_with(lower(token), 'a:')),
  firsts AS (SELECT domain, asn, arg_min(ip, (pos, token_pos, apos, ip, registered)) AS ip, arg_min(registered, (pos, token_pos, apos, ip, registered)) AS registered
    FROM addr JOIN net USING (ip) GROUP BY domain, asn)"""


# --- the same evidence with signatures as tables ------------------------------------------------------------------


def signed(t, patterns):
    return sg.signature_table(t.spark, patterns)


@query("evidence_mx_by_table", BODY["evidence_mx"])
def evidence_mx_by_table(t):
    return shown(ev.ev_mx(t("v_mx"), signed(t, dims.MX_PATTERNS)))


@query("evidence_spf_by_table", BODY["evidence_spf_include"])
def evidence_spf_by_table(t):
    return shown(ev.ev_spf(ev.spf_record(t("v_txt")), signed(t, dims.SPF_INCLUDES)))


@query("evidence_dmarc_by_table", BODY["evidence_dmarc"])
def evidence_dmarc_by_table(t):
    return shown(ev.ev_dmarc(t("v_txt"), signed(t, dims.DMARC_PATTERNS)))


@query("evidence_autodiscover_by_table", BODY["evidence_autodiscover"])
def evidence_autodiscover_by_table(t):
    return shown(ev.ev_autodiscover(t("v_cname"), t("v_srv"), signed(t, dims.AUTODISCOVER_PATTERNS)))


@query("evidence_smtp_by_table", BODY["evidence_smtp"])
def evidence_smtp_by_table(t):
    return shown(ev.ev_smtp(t("v_mx"), t("v_smtp"), signed(t, dims.SMTP_PATTERNS)))


@query("evidence_txt_by_table", BODY["evidence_txt"])
def evidence_txt_by_table(t):
    return shown(ev.ev_txt(t("v_txt"), signed(t, dims.TXT_PATTERNS)))


@query("cname_chain_by_table", BODY["cname_chain"])
def cname_chain_by_table(t):
    return shown(ev.ev_cname_chain(t("v_mx"), t("v_cname"), signed(t, dims.MX_PATTERNS), signed(t, dims.CNAME_PATTERNS)))


def resolved(t):
    """Hosts, addresses and networks as written tables: each view is built on the one before and read by several probes."""
    for name in ("v_mx", "v_a", "v_asn"):
        t.stored(name)


@query("spf_ip_first_asn", f"WITH {SQL_SPF_IP} SELECT domain, asn, ip, registered FROM firsts")
def spf_ip_first_asn(t):
    resolved(t)
    return ev.spf_networks(t("v_txt"), t("v_a"), t("v_asn")).select("domain", "asn", "ip", "registered")


@query(
    "evidence_spf_ip",
    f"""WITH {SQL_SPF_IP}
    SELECT domain, 'spf_ip' AS kind, m.provider, CAST(0.08 AS DOUBLE) AS weight, 'SPF ip4/a ASN ' || asn || m.suffix AS detail, ip || ':' || asn AS raw
    FROM firsts, LATERAL {SQL_OWNERS} m""",
)
def evidence_spf_ip(t):
    return shown(ev.ev_spf_ip(t("v_txt"), t("v_a"), t("v_asn"), F.lit("ch")))


@query("gateway_detect", f"WITH {SQL_GW} SELECT * FROM gw")
def gateway_detect(t):
    return ev.detect_gateway(t("v_mx"))


@query("mx_hosts", "SELECT domain, count(DISTINCT host) AS n, string_agg(DISTINCT host, ' ' ORDER BY host) AS hosts FROM v_mx GROUP BY domain")
def mx_hosts(t):
    return ev.mx_hosts(t("v_mx")).select("domain", F.size("mx").cast("bigint").alias("n"), F.array_join("mx", " ").alias("hosts"))


#: Evidence of all probes per byte of the tables read: an order becomes several answers, and an answer several rows with their texts.
EVIDENCE_FAN_OUT = 8


def assembled(t):
    """All probes over the observation tables."""
    t.fans_out(EVIDENCE_FAN_OUT)
    resolved(t)
    mx, txt, cname = t("v_mx"), t("v_txt"), t("v_cname")
    return ev.assemble_evidence(
        ev.ev_mx(mx),
        ev.ev_spf(ev.spf_record(txt)),
        ev.ev_dkim(cname),
        ev.ev_dmarc(txt),
        ev.ev_autodiscover(cname, t("v_srv")),
        ev.ev_cname_chain(mx, cname),
        ev.ev_smtp(mx, t("v_smtp")),
        ev.ev_tenant(t("v_tenant")),
        ev.ev_asn(mx, t("v_a"), t("v_asn"), F.lit("ch")),
        ev.ev_txt(txt),
        ev.ev_spf_ip(txt, t("v_a"), t("v_asn"), F.lit("ch")),
    )


PROBES = """
    evidence_mx evidence_spf_include evidence_dkim evidence_dmarc evidence_autodiscover cname_chain evidence_smtp evidence_tenant evidence_asn
    evidence_txt evidence_spf_ip
""".split()


@query("assembled_evidence", "SELECT kind, provider, count(*) AS n FROM (" + " UNION ALL ".join(f"({BODY[name]})" for name in PROBES) + ") e GROUP BY kind, provider")
def assembled_evidence(t):
    return assembled(t).groupBy("kind", "provider").agg(F.count(F.lit(1)).alias("n"))


# --- classification -----------------------------------------------------------------------------------------------


def adapter_evidence(t):
    return t("v_evidence").filter(F.col("domain") != "").withColumn("skey", F.lit(""))


def domains(t):
    return t("v_order").filter(F.col("domain") != "").select("domain").distinct()


def classified(t):
    return cls.classify(domains(t), adapter_evidence(t), ev.mx_profile(t("v_mx")), ev.spf_record(t("v_txt")))


def sql_country(prefix: str, rows: list[tuple[str, float]], what: str) -> str:
    names = [f"'{n}'" for n, _ in rows] if what == "rule" else [f"CAST({b} AS DOUBLE)" for _, b in rows]
    return f"CASE WHEN true AND has_spf THEN {names[0]} ELSE {names[1]} END"


DOM, FOR = dims.COUNTRY_RULES["domestic"], dims.COUNTRY_RULES["foreign"]
SQL_CLASSIFIED = f"""{SQL_GW}, {SQL_SPF},
  dm AS (SELECT DISTINCT domain FROM v_order WHERE domain <> ''),
  ev AS (SELECT domain, provider, kind, {SQL_KIND_ORD} AS ko, pos FROM v_evidence WHERE domain <> ''),
  per AS (SELECT domain, provider, count(DISTINCT kind) AS nk, min(ko * 1000000000000 + pos) AS place,
      bool_or(kind = 'mx') AS mx, bool_or(kind = 'spf') AS spf, bool_or(kind = 'dkim') AS dkim, bool_or(kind = 'autodiscover') AS ad
    FROM ev WHERE provider <> 'unknown' GROUP BY domain, provider),
  score AS (SELECT per.*, gateway, CASE WHEN mx THEN 20 ELSE 0 END + CASE WHEN per.spf THEN 20 ELSE 0 END + CASE WHEN dkim THEN 15 ELSE 0 END + CASE WHEN ad THEN 8 ELSE 0 END AS cents
    FROM per LEFT JOIN gw USING (domain)),
  comp AS (SELECT *, count(*) OVER (PARTITION BY domain) AS rivals FROM score WHERE cents > 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY cents + CASE WHEN gateway IS NOT NULL AND rivals > 1 AND dkim THEN 6 ELSE 0 END DESC, place, provider) AS rn FROM comp),
  win AS (SELECT domain, provider, nk,
      CASE WHEN mx AND spf THEN 'mx_spf' WHEN mx THEN 'mx_only' WHEN spf AND gateway IS NOT NULL THEN 'spf_gw' WHEN dkim AND gateway IS NOT NULL THEN 'dkim_gw'
           WHEN dkim AND spf THEN 'dkim_spf' WHEN spf THEN 'spf_only' ELSE 'fallback' END AS rule FROM ranked WHERE rn = 1),
  winc AS (SELECT *, least(1.0, CASE rule WHEN 'mx_spf' THEN 0.9 + (nk - 2) * 0.02 WHEN 'mx_only' THEN 0.8 + (nk - 1) * 0.02 WHEN 'spf_gw' THEN 0.7 + (nk - 1) * 0.02
      WHEN 'dkim_gw' THEN 0.65 + (nk - 1) * 0.02 WHEN 'dkim_spf' THEN 0.6 + (nk - 2) * 0.02 WHEN 'spf_only' THEN 0.5 + (nk - 1) * 0.02 ELSE 0.4 + nk * 0.02 END) AS confidence FROM win),
  flags AS (SELECT dm.domain, gw.gateway, spf.spf AS spf_text, coalesce(bool_or(ev.kind = 'mx'), false) AS ev_mx,
      coalesce(bool_or(ev.provider = 'domestic'), false) AS dom, coalesce(bool_or(ev.provider = 'foreign'), false) AS frn,
      coalesce(bool_or(ev.kind = 'spf'), false) OR spf.spf IS NOT NULL AS has_spf
    FROM dm LEFT JOIN ev USING (domain) LEFT JOIN gw USING (domain) LEFT JOIN spf USING (domain) GROUP BY dm.domain, gw.gateway, spf.spf),
  res AS (SELECT f.domain, f.gateway, coalesce(spf_text, '') AS spf,
      CASE WHEN f.gateway IS NULL AND NOT ev_mx AND dom THEN 'domestic' WHEN f.gateway IS NULL AND NOT ev_mx AND frn THEN 'foreign'
           WHEN w.provider IS NOT NULL THEN w.provider WHEN f.gateway IS NOT NULL THEN 'unknown' WHEN dom THEN 'domestic' WHEN frn THEN 'foreign' ELSE 'unknown' END AS provider,
      CASE WHEN f.gateway IS NULL AND NOT ev_mx AND dom THEN CASE WHEN has_spf THEN 'dom_mx_spf' ELSE 'dom_mx_only' END
           WHEN f.gateway IS NULL AND NOT ev_mx AND frn THEN CASE WHEN has_spf THEN 'frgn_mx_spf' ELSE 'frgn_mx_only' END
           WHEN w.provider IS NOT NULL THEN w.rule WHEN f.gateway IS NOT NULL THEN 'gateway_no_primary'
           WHEN dom THEN CASE WHEN has_spf THEN 'dom_mx_spf' ELSE 'dom_mx_only' END
           WHEN frn THEN CASE WHEN has_spf THEN 'frgn_mx_spf' ELSE 'frgn_mx_only' END ELSE 'no_country_data' END AS rule,
      CASE WHEN f.gateway IS NULL AND NOT ev_mx AND dom THEN CASE WHEN has_spf THEN 0.8 ELSE 0.7 END
           WHEN f.gateway IS NULL AND NOT ev_mx AND frn THEN CASE WHEN has_spf THEN 0.6 ELSE 0.5 END
           WHEN w.provider IS NOT NULL THEN w.confidence WHEN f.gateway IS NOT NULL THEN 0.0
           WHEN dom THEN CASE WHEN has_spf THEN 0.8 ELSE 0.7 END WHEN frn THEN CASE WHEN has_spf THEN 0.6 ELSE 0.5 END ELSE 0.0 END AS confidence
    FROM flags f LEFT JOIN winc w USING (domain))"""
SQL_ATTACHED = f"""{SQL_CLASSIFIED},
  att AS (SELECT country, code, e.domain, name, region, coalesce(CASE r.provider WHEN 'ms365' THEN 'microsoft' ELSE r.provider END, 'unknown') AS provider,
      coalesce(r.confidence, 0.0) AS confidence, r.gateway, coalesce(r.spf, '') AS spf FROM v_entity e LEFT JOIN res r USING (domain))"""
SQL_CAT = "CASE WHEN provider IN ('microsoft', 'google', 'aws') THEN 'us-cloud' WHEN provider = 'domestic' THEN country || '-based' ELSE provider END"


@query("classify_domains", f"WITH {SQL_CLASSIFIED} SELECT domain, provider, rule, gateway, spf, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM res")
def classify_domains(t):
    return r6(classified(t))


@query(
    "rule_hits",
    f"""WITH {SQL_CLASSIFIED}, names AS (SELECT unnest({dims.RULE_NAMES}) AS rule)
    SELECT rule, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM names LEFT JOIN (SELECT rule, count(*) AS hits FROM res GROUP BY rule) h USING (rule)""",
)
def rule_hits(t):
    return cls.rule_hits(classified(t))


@query(
    "dedup_evidence",
    "SELECT domain, provider, kind, min(pos) AS pos, any_value(weight) AS weight FROM v_evidence WHERE domain <> '' AND provider <> 'unknown' GROUP BY domain, provider, kind",
)
def dedup_evidence(t):
    return cls.dedup_evidence(adapter_evidence(t))


@query(
    "primary_scores",
    """SELECT domain, provider, round(sum(weight), 6) AS score FROM (SELECT DISTINCT domain, provider, kind, weight FROM v_evidence
    WHERE domain <> '' AND provider <> 'unknown' AND kind IN ('mx', 'spf', 'dkim', 'autodiscover')) d GROUP BY domain, provider""",
)
def primary_scores(t):
    return r6(cls.primary_scores(adapter_evidence(t)))


def attached(t):
    entity = t("v_entity").select("country", "code", "name", "region", "domain")
    return cls.attach_classification(entity, classified(t))


@query("attach_classification", f"WITH {SQL_ATTACHED} SELECT country, code, name, region, domain, spf, provider, {SQL_CAT} AS category, round(CAST(confidence * 100 AS DOUBLE), 6) AS confidence, gateway FROM att")
def attach_classification(t):
    return r6(attached(t))


@query(
    "provider_share",
    f"""WITH {SQL_ATTACHED}, names AS (SELECT unnest({dims.OUTPUT_PROVIDERS}) AS provider), tot AS (SELECT count(*) AS total FROM att)
    SELECT provider, CAST(coalesce(n, 0) AS BIGINT) AS n, total, round(coalesce(n, 0) * 100.0 / total, 6) AS n_pct
    FROM names LEFT JOIN (SELECT provider, count(*) AS n FROM att GROUP BY provider) a USING (provider), tot""",
)
def provider_share(t):
    return r6(rp.provider_summary(attached(t)))


def overrides(t):
    """Overrides derived from customers: one per entity code that exists, and as many for codes that do not."""
    key = F.col("c_custkey")
    return t("customer").select(
        F.when(F.col("c_nationkey") % 5 % 3 == 0, "de").when(F.col("c_nationkey") % 5 % 3 == 1, "at").otherwise("ch").alias("country"),
        F.lpad(key.cast("string"), 8, "0").alias("code"),
        F.when(key % 7 == 0, "nobody").when(key % 11 == 0, F.lit(None)).when(key % 3 == 0, "aws").otherwise("domestic").alias("provider"),
        F.when(key % 13 != 0, F.concat(F.lit("op"), key % 5)).alias("operator"),
        F.lit("letter").alias("source"),
    )


SQL_OVERRIDES = """
  ov AS (SELECT CASE c_nationkey % 5 % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'at' ELSE 'ch' END AS country, lpad(CAST(c_custkey AS STRING), 8, '0') AS code,
      CASE WHEN c_custkey % 7 = 0 THEN 'nobody' WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'aws' ELSE 'domestic' END AS provider,
      CASE WHEN c_custkey % 13 <> 0 THEN 'op' || (c_custkey % 5) END AS operator, 'letter' AS source FROM customer),
  good AS (SELECT * FROM ov WHERE provider IN ('microsoft', 'google', 'aws', 'domestic', 'foreign') AND operator IS NOT NULL)"""


@query(
    "override_split",
    f"WITH {SQL_OVERRIDES} SELECT country, code, CASE WHEN provider IS NULL OR operator IS NULL THEN 'missing field' WHEN provider = 'nobody' THEN 'invalid provider' ELSE 'accepted' END AS reason FROM ov",
)
def override_split(t):
    ok, rejected = cls.split_overrides(overrides(t))
    cols = ["country", "code", "reason"]
    return ok.withColumn("reason", F.lit("accepted")).select(*cols).unionByName(rejected.select(*cols))


@query(
    "provider_overrides",
    f"""WITH {SQL_OVERRIDES}, j AS (SELECT p.*, g.provider AS gp, operator, source FROM v_provider p LEFT JOIN good g USING (country, code)),
      u AS (SELECT *, gp IS NOT NULL AND provider = 'unknown' AS hit FROM j)
    SELECT country, code, CASE WHEN hit THEN gp ELSE provider END AS provider,
      CASE WHEN hit THEN CASE gp WHEN 'aws' THEN 'us-cloud' ELSE country || '-based' END ELSE category END AS category,
      CASE WHEN hit THEN 100.0 ELSE confidence END AS confidence, CASE WHEN hit THEN operator END AS operator, CASE WHEN hit THEN source END AS source FROM u""",
)
def provider_overrides(t):
    ok, _ = cls.split_overrides(overrides(t))
    rows = cls.apply_provider_overrides(t("v_provider"), ok)
    return rows.select("country", "code", "provider", "category", "confidence", "override.operator", "override.source")


@query(
    "override_outcome",
    f"""WITH {SQL_OVERRIDES} SELECT CASE WHEN p.provider IS NULL THEN 'missing entity' WHEN p.provider = 'unknown' THEN 'applied' ELSE 'not applied' END AS outcome, count(*) AS n
    FROM good g LEFT JOIN v_provider p USING (country, code) GROUP BY 1""",
)
def override_outcome(t):
    ok, _ = cls.split_overrides(overrides(t))
    return cls.override_outcome(t("v_provider"), ok)


@query("classified_categories")
def classified_categories(t):
    """End to end: every probe, election, fan-out to entities, distribution."""
    mx, txt = t("v_mx"), t("v_txt")
    result = cls.classify(domains(t), assembled(t), ev.mx_profile(mx), ev.spf_record(txt))
    entity = t("v_entity").select("country", "code", "name", "region", "domain")
    return rp.distribution(cls.attach_classification(entity, result))


# --- provider reports ---------------------------------------------------------------------------------------------


@query("category_summary", f"""WITH c AS (SELECT count(*) AS total, count(*) FILTER (category = 'us-cloud') AS us, count(*) FILTER (category = country || '-based') AS dom FROM v_provider)
    SELECT 'us-cloud' AS category, us AS n, total, {sql_pct('us', 'total', 'n_pct')} FROM c UNION ALL SELECT 'domestic', dom, total, {sql_pct('dom', 'total', 'n_pct')} FROM c""")
def category_summary(t):
    return r6(rp.category_summary(t("v_provider")))


@query("distribution", "SELECT category, provider, count(*) AS n FROM v_provider GROUP BY ALL")
def distribution(t):
    return rp.distribution(t("v_provider"))


@query(
    "regional_providers",
    f"""WITH g AS (SELECT country, {SQL_ABBR} AS region, count(*) AS total, {SQL_COUNTS} FROM v_provider GROUP BY 1, 2)
    SELECT *, {sql_pct('(microsoft + google + aws)', 'total', 'us_pct')}, round(100 - CAST(microsoft + google + aws AS DOUBLE) / total * 100, 6) AS non_us_pct FROM g""",
)
def regional_providers(t):
    return r6(rp.regional_providers(t("v_provider")))


@query(
    "confidence_histogram",
    f"""WITH b AS (SELECT CASE WHEN confidence >= 90 THEN '90-100%' WHEN confidence >= 80 THEN '80-90%' WHEN confidence >= 70 THEN '70-80%'
        WHEN confidence >= 60 THEN '60-70%' WHEN confidence >= 50 THEN '50-60%' ELSE '0-50%' END AS bucket FROM v_provider), t AS (SELECT count(*) AS total FROM b)
    SELECT bucket, n, total, {sql_pct('n', 'total', 'n_pct')} FROM (SELECT bucket, count(*) AS n FROM b GROUP BY 1) g, t""",
)
def confidence_histogram(t):
    return r6(rp.confidence_histogram(t("v_provider")))


@query(
    "confidence_by_provider",
    "SELECT provider, count(*) AS n, round(avg(confidence), 6) AS avg_conf, min(confidence) AS min_conf, count(*) FILTER (confidence < 60) AS low FROM v_provider GROUP BY 1",
)
def confidence_by_provider(t):
    return r6(rp.confidence_by_provider(t("v_provider")))


@query(
    "signal_coverage",
    f"""WITH g AS (SELECT kind, count(DISTINCT country || code) AS n FROM v_signal GROUP BY kind), t AS (SELECT count(*) AS total FROM v_provider)
    SELECT kind, n, total, {sql_pct('n', 'total', 'n_pct')} FROM g, t""",
)
def signal_coverage(t):
    return r6(rp.signal_coverage(t("v_provider"), t("v_signal")))


@query("signal_combos", f"WITH {SQL_KINDS} SELECT kinds AS combo, count(*) AS n FROM kinds GROUP BY 1 ORDER BY n DESC, combo LIMIT 15")
def signal_combos(t):
    return rp.signal_combos(t("v_signal"))


@query(
    "sparse_signal_entities",
    f"WITH {SQL_KINDS} SELECT country, code, name, provider, CAST(coalesce(nk, 0) AS INTEGER) AS n_kinds, coalesce(kinds, '') AS kinds FROM v_provider LEFT JOIN kinds USING (country, code) WHERE coalesce(nk, 0) <= 1",
)
def sparse_signal_entities(t):
    return rp.sparse_signal_entities(t("v_provider"), t("v_signal"))


@query("gateway_share", f"WITH g AS (SELECT count(*) AS total, count(*) FILTER (coalesce(gateway, '') <> '') AS with_gateway FROM v_provider) SELECT *, {sql_pct('with_gateway', 'total', 'gateway_pct')} FROM g")
def gateway_share(t):
    return r6(rp.gateway_share(t("v_provider")))


@query("gateway_counts", "SELECT gateway, count(*) AS n FROM v_provider WHERE coalesce(gateway, '') <> '' GROUP BY 1")
def gateway_counts(t):
    return rp.gateway_counts(t("v_provider"))


@query(
    "gateway_report",
    f"""WITH g AS (SELECT provider, count(*) FILTER (gateway IS NOT NULL) AS w, count(*) FILTER (gateway IS NULL) AS o FROM v_provider GROUP BY 1), t AS (SELECT sum(w) AS tw, sum(o) AS tot FROM g)
    SELECT provider, w AS with_gateway, {sql_pct('w', 'tw', 'with_pct')}, o AS without_gateway, {sql_pct('o', 'tot', 'without_pct')} FROM g, t""",
)
def gateway_report(t):
    return r6(rp.gateway_report(t("v_provider")))


@query(
    "shared_domains",
    """WITH r AS (SELECT country, domain, name, provider, row_number() OVER (PARTITION BY country, domain ORDER BY code, name) AS rn, count(*) OVER (PARTITION BY country, domain) AS n
        FROM v_provider WHERE domain <> '')
    SELECT country, domain, n, max(CASE WHEN rn = 1 THEN provider END) AS provider, string_agg(name, ', ' ORDER BY rn) AS names, greatest(n - 4, 0) AS more
    FROM r WHERE n > 1 AND rn <= 4 GROUP BY country, domain, n""",
)
def shared_domains(t):
    return rp.shared_domains(t("v_provider"))


@query(
    "low_confidence",
    f"WITH {SQL_KINDS} SELECT country, code, name, {SQL_ABBR} AS region, provider, confidence, coalesce(kinds, '') AS kinds FROM v_provider LEFT JOIN kinds USING (country, code) WHERE confidence < 60",
)
def low_confidence(t):
    return rp.low_confidence(t("v_provider"), t("v_signal"))


SQL_CONFLICTS = """c AS (SELECT country, code, p.name, p.provider, s.provider AS other, CAST(count(DISTINCT kind) AS INTEGER) AS n_kinds, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds
      FROM v_signal s JOIN v_provider p USING (country, code) WHERE kind IN ('mx', 'spf', 'dkim', 'autodiscover') AND s.provider <> p.provider GROUP BY country, code, p.name, p.provider, s.provider)"""


@query("signal_conflicts", f"WITH {SQL_CONFLICTS} SELECT * FROM c")
def signal_conflicts(t):
    return rp.signal_conflicts(t("v_provider"), t("v_signal"))


@query("top_conflicts", f"WITH {SQL_CONFLICTS} SELECT * FROM c ORDER BY n_kinds DESC, country, code, other LIMIT 20")
def top_conflicts(t):
    return rp.top_conflicts(rp.signal_conflicts(t("v_provider"), t("v_signal")))


def sql_totals(base: str, sums: list[str], grand: str) -> str:
    sums = [f'"{c}"' for c in sums]
    cols = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in sums)
    return (
        f"rolled AS (SELECT upper(country) AS country, region, {', '.join(sums)} FROM {base} UNION ALL SELECT upper(country), 'Total', {cols} FROM {base} GROUP BY country "
        f"UNION ALL SELECT 'ALL', '{grand}', {cols} FROM {base})"
    )


@query(
    "combined_providers",
    f"""WITH g AS (SELECT country, {SQL_NAME} AS region, count(*) AS total, {SQL_COUNTS} FROM v_provider GROUP BY 1, 2), {sql_totals('g', ['total', *dims.OUTPUT_PROVIDERS], 'Grand Total')}
    SELECT *, microsoft + google + aws AS us_cloud, {sql_pct('(microsoft + google + aws)', 'total', 'us_pct')}, {sql_pct('domestic', 'total', 'dom_pct')} FROM rolled""",
)
def combined_providers(t):
    return r6(rp.combined_providers(t("v_provider")))


SQL_CNAME = "CASE country WHEN 'de' THEN 'Germany' WHEN 'at' THEN 'Austria' ELSE 'Switzerland' END"


@query(
    "country_overview",
    f"""WITH p AS (SELECT {SQL_CNAME} AS label, * FROM v_provider UNION ALL SELECT 'Total', * FROM v_provider),
      g AS (SELECT label AS country, count(*) AS total, {SQL_COUNTS}, avg(confidence) AS a, count(*) FILTER (confidence < 60) AS low_conf, count(gateway) AS gw FROM p GROUP BY 1)
    SELECT country, total, microsoft, google, aws, domestic, "foreign", unknown, {sql_pct('(microsoft + google + aws)', 'total', 'us_pct')}, {sql_pct('domestic', 'total', 'dom_pct')},
      round(a, 6) AS avg_conf, low_conf, {sql_pct('gw', 'total', 'gw_pct')} FROM g""",
)
def country_overview(t):
    return r6(rp.country_overview(t("v_provider")))


@query(
    "level_counts",
    """WITH c AS (SELECT CASE WHEN category = country || '-based' THEN 'domestic' WHEN category IN ('us-cloud', 'foreign') THEN category END AS cat, confidence FROM v_provider)
    SELECT coalesce(cat, 'insufficient') AS category, CASE WHEN cat IS NULL THEN 'insufficient' WHEN confidence >= 75 THEN 'high' WHEN confidence >= 50 THEN 'medium'
      WHEN confidence >= 25 THEN 'low' ELSE 'insufficient' END AS level, count(*) AS n FROM c GROUP BY 1, 2""",
)
def level_counts(t):
    return rp.level_counts(t("v_provider"))


@query(
    "dedup_signals",
    "SELECT country, code, kind, detail, arg_min(provider, (pos, provider)) AS provider, max(weight) AS weight, count(*) AS n FROM v_signal GROUP BY country, code, kind, detail",
)
def dedup_signals(t):
    rows = t("v_signal").withColumn("pos", F.struct("pos", "provider"))
    return rp.dedup_signals(rows)


SQL_VENDOR = (
    "CASE "
    + " ".join(f"WHEN {sql_any('host', words.split())} THEN '{{0}}'".replace("{0}", f"{v}|{c}") for v, c, words in dims.VENDORS)
    + f" WHEN {sql_any('host', dims.KNOWN_DOMESTIC_HOSTS)} THEN array_to_string(list_slice(string_split(lower(regexp_replace(host, '^_', '')), '.'), -2, -1), '.') || '|domestic'"
    + " WHEN (country = 'ch' AND (lower(host) LIKE '%.ch' OR lower(host) LIKE '%.swiss')) OR (country = 'de' AND lower(host) LIKE '%.de') OR (country = 'at' AND lower(host) LIKE '%.at')"
    + " THEN array_to_string(list_slice(string_split(regexp_replace(host, '^_', ''), '.'), -2, -1), '.') || '|domestic'"
    + " ELSE array_to_string(list_slice(string_split(regexp_replace(host, '^_', ''), '.'), -2, -1), '.') || '|unknown' END"
)


@query(
    "delegation_table",
    f"""WITH h AS (SELECT country, code, 'mx' AS via, host FROM v_provider_mx WHERE host IS NOT NULL
      UNION ALL SELECT country, code, 'spf', unnest(list_concat(regexp_extract_all(spf, 'include:(\\S+)', 1), regexp_extract_all(spf, 'redirect=(\\S+)', 1))) FROM v_provider),
      v AS (SELECT *, {SQL_VENDOR} AS v FROM h)
    SELECT country, code, via, host, split_part(v, '|', 1) AS vendor, split_part(v, '|', 2) AS vendor_category FROM v""",
)
def delegation_table(t):
    return rp.delegation_table(t("v_provider"), t("v_provider_mx"))


def run_metadata(t):
    """Stage runs derived from events: the time stamps of each event type, by country of the user."""
    return t("events").select(
        F.col("event_type").alias("stage"),
        F.when(F.col("user_id") % 3 == 0, "de").when(F.col("user_id") % 3 == 1, "at").otherwise("ch").alias("country"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated"),
        F.concat(F.lit("c"), F.col("event_id")).alias("commit"),
    )


SQL_META = """meta AS (SELECT event_type AS stage, CASE user_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'at' ELSE 'ch' END AS country,
      strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS generated, 'c' || event_id AS "commit" FROM events)"""


@query("latest_generation", f'WITH {SQL_META} SELECT generated, "commit" FROM meta ORDER BY generated DESC, "commit" DESC LIMIT 1')
def latest_generation(t):
    return rp.latest_generation(run_metadata(t))


@query("stage_dates", f"WITH {SQL_META} SELECT stage, " + ", ".join(f"coalesce(max(CASE WHEN country = '{cc}' THEN generated[1:10] END), '—') AS {cc}" for cc in dims.COUNTRIES) + " FROM meta GROUP BY stage")
def stage_dates(t):
    return rp.stage_dates(run_metadata(t))


@query(
    "condensed_details",
    """SELECT country, code, pos, kind, CASE kind WHEN 'mx' THEN regexp_replace(detail, '^MX (\\S+) matches \\S+$', '\\1') WHEN 'spf' THEN regexp_replace(detail, '^SPF include:(\\S+) matches \\S+$', '\\1')
      WHEN 'asn' THEN regexp_replace(detail, '^ASN (\\d+) registered in \\S+$', 'AS\\1') WHEN 'spf_ip' THEN regexp_replace(detail, '^.*ASN (\\d+) matches (\\S+)$', 'AS\\1') ELSE detail END AS short FROM v_signal""",
)
def condensed_details(t):
    return t("v_signal").select("country", "code", "pos", "kind", text.condense_detail(F.col("kind"), F.col("detail")).alias("short"))


@query("region_labels", f"SELECT country, code, {SQL_ABBR} AS abbr, {SQL_NAME} AS name, {SQL_DISPLAY} AS display FROM v_entity")
def region_labels(t):
    region, country = F.col("region"), F.col("country")
    return t("v_entity").select(
        "country",
        "code",
        labels.region_abbr(region, country).alias("abbr"),
        labels.region_name(region).alias("name"),
        labels.region_display(region).alias("display"),
    )


# --- export -------------------------------------------------------------------------------------------------------

FLAT_SQL = """
  sig AS (SELECT country, code, string_agg(kind || ': ' || detail, '; ' ORDER BY kind, detail, pos) AS classification_signals FROM v_signal GROUP BY country, code),
  mxs AS (SELECT country, code, string_agg(host, '; ' ORDER BY host) AS mx FROM v_provider_mx WHERE host IS NOT NULL GROUP BY country, code),
  sec AS (SELECT upper(country) AS country, code, domain, coalesce(scan_valid, false) AS scan_valid, coalesce(dane_supported, false) AS dane_supported, coalesce(dane_partial, false) AS dane_partial,
      coalesce(has_spf, false) AS has_spf, coalesce(has_good_spf, false) AS has_good_spf, coalesce(has_dmarc, false) AS has_dmarc, coalesce(has_good_dmarc, false) AS has_good_dmarc FROM v_security),
  flat AS (SELECT upper(country) AS country, code, name, region, domain, provider, category, confidence, coalesce(gateway, '') AS gateway, coalesce(mx, '') AS mx, spf,
      coalesce(classification_signals, '') AS classification_signals, '' AS sources, '' AS resolve_flags FROM v_provider LEFT JOIN sig USING (country, code) LEFT JOIN mxs USING (country, code))"""
EXPORT_SQL = FLAT_SQL + """,
  export AS (SELECT flat.*, scan_valid, dane_supported, dane_partial, has_spf, has_good_spf, has_dmarc, has_good_dmarc FROM flat LEFT JOIN sec USING (country, code, domain))"""


def nested_providers(t):
    """Provider rows with their lists, as the output files hold them."""
    signals = t("v_signal").groupBy("country", "code").agg(
        F.array_sort(F.collect_list(F.struct("kind", "detail", "pos"))).alias("classification_signals")
    )
    hosts = t("v_provider_mx").filter(F.col("host").isNotNull()).groupBy("country", "code").agg(F.array_sort(F.collect_list("host")).alias("mx"))
    key = ["country", "code"]
    return (
        t("v_provider").join(signals, key, "left").join(hosts, key, "left")
        .withColumnRenamed("confidence", "classification_confidence")
        .withColumn("sources_detail", F.lit(None).cast("map<string,array<string>>"))
        .withColumn("resolve_flags", F.lit(None).cast("array<string>"))
    )


def nested_security(t):
    s = t("v_security")
    present = F.col("has_spf").isNotNull()
    return s.select(
        "country", "code", "domain", "scan_valid",
        F.when(present, F.struct(F.col("dane_supported").alias("supported"), F.col("dane_partial").alias("partial"))).alias("dane"),
        F.when(present, F.struct("has_spf", "has_good_spf", "has_dmarc", "has_good_dmarc", "has_dkim")).alias("dss"),
    )


def flat_providers(t):
    """Flat rows without the text columns, for statistics."""
    return t("v_provider").withColumn("country", F.upper("country"))


def export_rows(t):
    return ex.joined_rows(flat_providers(t), ex.flatten_security(nested_security(t)))


@query("export_flat", f"WITH {EXPORT_SQL} SELECT {', '.join(dims.EXPORT_COLUMNS)} FROM export")
def export_flat(t):
    return ex.build_export(ex.flatten_provider(nested_providers(t)), ex.flatten_security(nested_security(t)))


STAT_SQL = f"WITH {EXPORT_SQL}, x AS (SELECT * FROM export UNION ALL SELECT * REPLACE ('Total' AS country) FROM export)"


@query(
    "export_provider_statistics",
    f"""{STAT_SQL}, t AS (SELECT country, count(*) AS total FROM x GROUP BY 1), n AS (SELECT country, provider, count(*) AS n FROM x GROUP BY 1, 2), p AS (SELECT unnest({dims.OUTPUT_PROVIDERS}) AS provider)
    SELECT country, total, provider, coalesce(n, 0) AS n, {sql_pct('coalesce(n, 0)', 'total', 'n_pct')} FROM t CROSS JOIN p LEFT JOIN n USING (country, provider)""",
)
def export_provider_statistics(t):
    return r6(ex.provider_distribution(export_rows(t)))


@query(
    "export_category_statistics",
    f"""{STAT_SQL}, t AS (SELECT country, count(*) AS total FROM x GROUP BY 1), n AS (SELECT country, category, count(*) AS n FROM x GROUP BY 1, 2), p AS (SELECT unnest({ex.CATEGORIES}) AS category)
    SELECT country, total, category, coalesce(n, 0) AS n, {sql_pct('coalesce(n, 0)', 'total', 'n_pct')} FROM t CROSS JOIN p LEFT JOIN n USING (country, category)""",
)
def export_category_statistics(t):
    return r6(ex.category_distribution(export_rows(t)))


@query(
    "export_security_statistics",
    f"""{STAT_SQL}, u AS (UNPIVOT (SELECT country, count(*) AS total, {', '.join(f'count(*) FILTER ({f}) AS {f}' for f in ex.FLAGS)} FROM x GROUP BY country) ON {', '.join(ex.FLAGS)} INTO NAME flag VALUE n)
    SELECT country, total, flag, n, {sql_pct('n', 'total', 'n_pct')} FROM u""",
)
def export_security_statistics(t):
    return r6(ex.security_distribution(export_rows(t)))


@query(
    "export_confidence_statistics",
    f"""{STAT_SQL} SELECT country, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median, min(confidence) AS min, max(confidence) AS max FROM x GROUP BY country""",
)
def export_confidence_statistics(t):
    return r6(ex.confidence_statistics(export_rows(t)))


@query("analysis_base", f"WITH {EXPORT_SQL} SELECT country, code, domain, provider, gateway, has_spf, has_good_dmarc FROM export WHERE scan_valid")
def analysis_base(t):
    flat = flat_providers(t).withColumn("gateway", F.coalesce("gateway", F.lit("")))
    rows = ex.analysis_base(flat, ex.flatten_security(nested_security(t)))
    return rows.select("country", "code", "domain", "provider", "gateway", "has_spf", "has_good_dmarc")


# --- comparisons --------------------------------------------------------------------------------------------------

SQL_METRICS = ", ".join(f"count(*) FILTER ({m}) AS {m}" for m in dims.SECURITY_METRICS)
SQL_METRIC_PCT = ", ".join(sql_pct(m, "n", f"{m}_pct") for m in dims.SECURITY_METRICS)
BASE_SQL = EXPORT_SQL + ", base AS (SELECT * FROM export WHERE scan_valid)"


@query(
    "provider_country_security",
    f"WITH {BASE_SQL}, g AS (SELECT provider, country, count(*) AS n, {SQL_METRICS} FROM base WHERE provider IN ('microsoft', 'domestic') GROUP BY 1, 2 HAVING count(*) >= 10) SELECT *, {SQL_METRIC_PCT} FROM g",
)
def provider_country_security(t):
    return r6(rp.provider_country_security(rp.valid_scans(export_rows(t))))


@query(
    "cloud_advantage",
    f"""WITH {BASE_SQL} SELECT country, round(100.0 * count(*) FILTER (provider = 'microsoft' AND has_good_spf) / count(*) FILTER (provider = 'microsoft')
      - 100.0 * count(*) FILTER (provider = 'domestic' AND has_good_spf) / count(*) FILTER (provider = 'domestic'), 6) AS advantage_pp FROM base GROUP BY 1""",
)
def cloud_advantage(t):
    return r6(rp.cloud_advantage(rp.valid_scans(export_rows(t))))


@query(
    "high_dmarc_groups",
    f"""WITH {BASE_SQL}, g AS (SELECT provider, country, count(*) AS n, 100.0 * count(*) FILTER (has_good_dmarc) / count(*) AS p FROM base
      WHERE provider IN ('microsoft', 'domestic', 'foreign', 'unknown') GROUP BY 1, 2 HAVING count(*) >= 10) SELECT provider, country, n, round(p, 6) AS has_good_dmarc_pct FROM g WHERE round_even(p, 1) > 15""",
)
def high_dmarc_groups(t):
    return r6(rp.high_dmarc_groups(rp.valid_scans(export_rows(t))))


@query("gateway_prevalence", f"WITH {BASE_SQL}, g AS (SELECT country, count(*) AS n, count(*) FILTER (gateway <> '') AS with_gateway FROM base GROUP BY 1) SELECT *, {sql_pct('with_gateway', 'n', 'gateway_pct')} FROM g")
def gateway_prevalence(t):
    return r6(rp.gateway_prevalence(rp.valid_scans(export_rows(t))))


@query(
    "gateway_effect",
    f"""WITH {BASE_SQL}, x AS (SELECT * FROM base UNION ALL SELECT * REPLACE ('ALL' AS country) FROM base), g AS (SELECT country, gateway <> '' AS has_gateway, count(*) AS n, {SQL_METRICS} FROM x GROUP BY 1, 2)
    SELECT *, {SQL_METRIC_PCT} FROM g""",
)
def gateway_effect(t):
    return r6(rp.gateway_effect(rp.valid_scans(export_rows(t))))


@query(
    "gateway_delta",
    f"WITH {BASE_SQL} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(100.0 * count(*) FILTER (gateway <> '' AND {m}) / count(*) FILTER (gateway <> '') - 100.0 * count(*) FILTER (gateway = '' AND {m}) / count(*) FILTER (gateway = ''), 6) AS delta_pp FROM base"
        for m in dims.SECURITY_METRICS[:4]
    ),
)
def gateway_delta(t):
    return r6(rp.gateway_delta(rp.valid_scans(export_rows(t))))


@query("gateway_profiles", f"WITH {BASE_SQL}, g AS (SELECT gateway, count(*) AS n, {SQL_METRICS} FROM base WHERE gateway <> '' GROUP BY 1 HAVING count(*) >= 20) SELECT *, {SQL_METRIC_PCT} FROM g")
def gateway_profiles(t):
    return r6(rp.gateway_profiles(rp.valid_scans(export_rows(t))))


SQL_OPERATOR = "CASE " + " ".join(f"WHEN contains(lower(split_part(mx, ';', 1)), '{p}') THEN '{label}'" for p, label in dims.MX_OPERATORS) + " ELSE 'other' END"


@query(
    "operator_profiles",
    f"WITH {BASE_SQL}, g AS (SELECT {SQL_OPERATOR} AS operator, count(*) AS n, {SQL_METRICS} FROM base WHERE provider = 'domestic' GROUP BY 1 HAVING count(*) >= 20) SELECT *, {SQL_METRIC_PCT} FROM g WHERE operator <> 'other'",
)
def operator_profiles(t):
    first = t("v_provider_mx").filter(F.col("host").isNotNull()).groupBy("country", "code").agg(F.min("host").alias("mx"))
    first = first.withColumn("country", F.upper("country"))
    return r6(rp.operator_profiles(rp.valid_scans(export_rows(t)).join(first, ["country", "code"], "left")))


SQL_RATES = BASE_SQL + f""", g AS (SELECT country, CASE WHEN category = 'us-cloud' THEN 'US Cloud' ELSE 'Domestic' END AS "group", region, count(*) AS n, {SQL_METRICS} FROM base
      WHERE category = 'us-cloud' OR category LIKE '%-based' GROUP BY 1, 2, 3 HAVING count(*) >= 5),
  rates AS (""" + " UNION ALL ".join(f"""SELECT country, "group", region, '{m}' AS metric, 100.0 * {m} / n AS value FROM g""" for m in dims.SECURITY_METRICS) + ")"


@query("regional_rates_long", f"""WITH {SQL_RATES} SELECT country, "group", region, metric, round(value, 6) AS value FROM rates""")
def regional_rates_long(t):
    return r6(rp.regional_rates_long(export_rows(t)))


@query(
    "rate_quartiles",
    f"""WITH {SQL_RATES}, q AS (SELECT country, "group", metric, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM rates GROUP BY 1, 2, 3)
    SELECT q.country, q."group", q.metric, q.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(value), 6) AS whisker_low, round(max(value), 6) AS whisker_high
    FROM q JOIN rates r ON q.country = r.country AND q."group" = r."group" AND q.metric = r.metric AND value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""",
)
def rate_quartiles(t):
    return r6(rp.rate_quartiles(rp.regional_rates_long(export_rows(t))))
