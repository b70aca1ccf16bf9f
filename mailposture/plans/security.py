"""Queries over scan logs, server rows, security rows and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions import labels, text
from mailposture.operators import mta as mt
from mailposture.operators import reports as rp
from mailposture.operators import security as sc
from mailposture.plans.providers import SQL_ABBR, SQL_CNAME, SQL_COUNTS, SQL_DISPLAY, SQL_NAME, sql_pct, sql_totals
from mailposture.plans.registry import query, r6

# --- addresses and logs -------------------------------------------------------------------------------------------


@query("domain_mx", "SELECT DISTINCT v_order.domain, mx, ad FROM v_order LEFT JOIN (SELECT domain, mx, length(mx) % 3 <> 0 AS ad FROM v_mta WHERE mx IS NOT NULL) m ON v_order.domain = m.domain")
def domain_mx(t):
    obs = t("v_mta").filter(F.col("mx").isNotNull()).select("domain", "mx", (F.length("mx") % 3 != 0).alias("ad"))
    return sc.domain_mx(t("v_order"), obs)


@query(
    "scan_addresses",
    """WITH d AS (SELECT DISTINCT domain, mx, length(mx) % 3 <> 0 AS ad FROM v_mta), a AS (SELECT DISTINCT mx, ip FROM v_mta WHERE mx IS NOT NULL AND ip IS NOT NULL AND length(mx) % 2 = 0)
    SELECT DISTINCT domain, d.mx, ip, CASE WHEN ip IS NOT NULL THEN ad END AS ad FROM d LEFT JOIN a USING (mx)""",
)
def scan_addresses(t):
    rows = t("v_mta").select("domain", "mx", (F.length("mx") % 3 != 0).alias("ad")).distinct()
    ips = t("v_mta").filter(F.col("mx").isNotNull() & F.col("ip").isNotNull() & (F.length("mx") % 2 == 0))
    return sc.scan_addresses(rows, ips)


@query(
    "scan_worklists",
    """SELECT 'tls' AS list, mx || ' ' || ip AS item FROM v_address WHERE mx IS NOT NULL AND ip IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'domains', domain FROM v_address GROUP BY ALL UNION ALL SELECT 'dane', mx FROM v_address WHERE mx IS NOT NULL GROUP BY ALL""",
)
def scan_worklists(t):
    lists = sc.scan_worklists(t("v_address"))
    tls = lists["tls"].select(F.lit("tls").alias("list"), F.concat_ws(" ", "mx", "ip").alias("item"))
    domains = lists["domains"].select(F.lit("domains").alias("list"), F.col("domain").alias("item"))
    return tls.unionByName(domains).unionByName(lists["dane"].select(F.lit("dane").alias("list"), F.col("mx").alias("item")))


@query("scan_targets", "SELECT DISTINCT 'info@' || domain AS address FROM v_order WHERE domain <> ''")
def scan_targets(t):
    return sc.scan_targets(t("v_order").select(F.array("domain").alias("emails")))


@query(
    "dig_answers",
    """SELECT host AS qname, CASE WHEN length(ip) % 2 = 0 THEN 'a' || lower(host) ELSE '' END || '|' || ip AS answers, ascii(host) % 2 = 0 AS ad FROM v_a""",
)
def dig_answers(t):
    newline = F.lit("\n")
    alias = F.when(F.length("ip") % 2 == 0, F.concat(F.lit("x 300 IN A A"), F.upper("host"), newline)).otherwise("")
    log = F.concat(
        F.lit(";; flags: qr rd ra"), F.when(F.ascii("host") % 2 == 0, " ad").otherwise(""), F.lit("; QUERY: 1\n;; ANSWER SECTION:\n"),
        alias, F.lit("y\t300\tIN\tCNAME\tz.\n"), F.col("host"), F.lit(".\t300\tIN\tA\t"), F.col("ip"), newline,
    )
    # ";; flags: qr rd ra" has no "ad" of its own; "rd ra" joined would not count either.
    logs = t("v_a").select(F.col("host").alias("qname"), F.lit("A").alias("type"), log.alias("log"))
    rows = sc.parse_dig_logs(logs)
    joined = F.array_join("answers", "|")
    return rows.select("qname", F.when(F.contains(joined, F.lit("|")), joined).otherwise(F.concat(F.lit("|"), joined)).alias("answers"), "ad")


@query(
    "tls_verdicts",
    "WITH x AS (SELECT host, ip, (length(host) + ascii(substr(ip, 9, 1))) % 4 AS s FROM v_tls_log) SELECT host, ip, "
    + ", ".join(
        f"CASE s WHEN 3 THEN NULL WHEN 2 THEN false WHEN 0 THEN {a} ELSE {b} END AS {f}"
        for f, a, b in zip(dims.TLS_FLAGS, "false false false false true true".split(), "false false true true true false".split())
    )
    + " FROM x",
)
def tls_verdicts(t):
    return sc.tls_flags(t("v_tls_log"))


SQL_MXDANE = """CASE WHEN ip = '192.0.2.1' THEN length(mx) % 2 = 0 WHEN ip = '192.0.2.2' THEN ascii(substr(mx, 3, 1)) % 2 = 0 WHEN ip = '192.0.2.3' THEN true ELSE length(mx) % 2 = 0 END"""


@query("dane_verdicts", f"SELECT DISTINCT mx, ip, {SQL_MXDANE.replace('ELSE length(mx) % 2 = 0', 'ELSE length(mx) % 2 = 0')} AS mx_dane FROM v_address WHERE mx IS NOT NULL AND ip IS NOT NULL")
def dane_verdicts(t):
    return sc.dane_flags(t("v_address"), t("v_dane_log"))


SQL_DSS = """dss AS (SELECT domain, s IN (0, 1, 2) AS has_dmarc, s IN (0, 1) AS has_good_dmarc, s IN (0, 1) AS has_spf, s = 0 AS has_good_spf, s = 0 AS has_dkim
    FROM (SELECT domain, max(k) % 4 AS s FROM v_order WHERE domain <> '' GROUP BY domain) x)"""


@query("auth_verdicts", f"WITH {SQL_DSS} SELECT * FROM dss")
def auth_verdicts(t):
    return sc.dss_flags(t("v_dss_log"))


@query(
    "build_mta",
    f"""WITH {SQL_DSS}, tls AS (SELECT host AS mx, ip, (length(host) + ascii(substr(ip, 9, 1))) % 4 AS s FROM v_tls_log)
    SELECT a.domain, a.mx, a.ip, CASE WHEN a.mx IS NOT NULL THEN coalesce(ad, false) AND coalesce({SQL_MXDANE.replace('mx)', 'a.mx)').replace('(mx', '(a.mx').replace('ip =', 'a.ip =')}, false) END AS has_dane, """
    + ", ".join(
        f"CASE s WHEN 2 THEN false WHEN 0 THEN {a} WHEN 1 THEN {b} END AS {f}"
        for f, a, b in zip(dims.TLS_FLAGS, "false false false false true true".split(), "false false true true true false".split())
    )
    + ", has_spf, has_good_spf, has_dmarc, has_good_dmarc, has_dkim FROM v_address a LEFT JOIN tls ON a.mx = tls.mx AND a.ip = tls.ip LEFT JOIN dss ON a.domain = dss.domain",
)
def build_mta(t):
    t.stored("v_mta")
    return sc.build_mta(t("v_address"), t("v_tls_log"), t("v_dane_log"), t("v_dss_log"))


# --- domains and entities -----------------------------------------------------------------------------------------

AUTH = ", ".join(f"coalesce({f}, false) AS {f}" for f in sc.AUTH_FLAGS)
SQL_DOMSEC = f"""
  f AS (SELECT domain, {AUTH}, row_number() OVER (PARTITION BY domain ORDER BY pos, {', '.join(f'coalesce({f}, false)' for f in sc.AUTH_FLAGS)}) AS rn FROM v_mta WHERE has_dmarc IS NOT NULL OR has_spf IS NOT NULL),
  g AS (SELECT domain, coalesce(bool_and(has_dane), false) AS dane_supported, coalesce(bool_or(has_dane), false) AS dane_partial FROM v_mta GROUP BY domain),
  dsec AS (SELECT g.*, {', '.join(f'coalesce({f}, false) AS {f}' for f in sc.AUTH_FLAGS)}, true AS scan_valid FROM g LEFT JOIN (SELECT * FROM f WHERE rn = 1) f1 USING (domain))"""
FLAGS = [*sc.DANE_FLAGS, *sc.AUTH_FLAGS]


@query("domain_security", f"WITH {SQL_DOMSEC} SELECT domain, {', '.join(FLAGS)}, scan_valid FROM dsec")
def domain_security(t):
    return sc.domain_security(t("v_mta"))


@query("domain_mx_records", "SELECT domain, coalesce(string_agg(DISTINCT mx, ' ' ORDER BY mx), '') AS mx_records FROM v_mta GROUP BY domain")
def domain_mx_records(t):
    return sc.domain_mx_records(t("v_mta")).select("domain", F.array_join("mx_records", " ").alias("mx_records"))


def entity_security(t):
    return sc.attach_security(t("v_entity").select("country", "code", "name", "region", "domain"), sc.domain_security(t("v_mta")))


SQL_ATTACH = f"{SQL_DOMSEC}, att AS (SELECT country, code, name, region, e.domain, {', '.join(FLAGS)}, coalesce(scan_valid, false) AS scan_valid FROM v_entity e LEFT JOIN dsec USING (domain))"


@query("attach_security", f"WITH {SQL_ATTACH} SELECT * FROM att")
def attach_security(t):
    return entity_security(t)


@query(
    "security_overrides",
    f"""WITH {SQL_ATTACH}, ov AS (SELECT CASE c_nationkey % 5 % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'at' ELSE 'ch' END AS country, lpad(CAST(c_custkey AS STRING), 8, '0') AS code,
        CASE WHEN c_custkey % 3 = 0 THEN true END AS ospf, CASE WHEN c_custkey % 4 = 0 THEN false END AS odane, CASE WHEN c_custkey % 5 <> 0 THEN 'letter' END AS source FROM customer)
    SELECT att.country, att.code, CASE WHEN has_spf IS NOT NULL THEN coalesce(ospf, has_spf) END AS has_spf, has_dmarc, CASE WHEN dane_supported IS NOT NULL THEN coalesce(odane, dane_supported) END AS dane_supported,
      scan_valid OR source IS NOT NULL AS scan_valid, source AS override_source FROM att LEFT JOIN (SELECT * FROM ov WHERE source IS NOT NULL) o ON att.country = o.country AND att.code = o.code""",
)
def security_overrides(t):
    key = F.col("c_custkey")
    nothing = F.lit(None).cast("boolean")
    ov = t("customer").select(
        F.when(F.col("c_nationkey") % 5 % 3 == 0, "de").when(F.col("c_nationkey") % 5 % 3 == 1, "at").otherwise("ch").alias("country"),
        F.lpad(key.cast("string"), 8, "0").alias("code"),
        F.when(key % 3 == 0, F.lit(True)).alias("has_spf"),
        F.when(key % 4 == 0, F.lit(False)).alias("dane_supported"),
        *[nothing.alias(f) for f in FLAGS if f not in ("has_spf", "dane_supported")],
        F.when(key % 5 != 0, "letter").alias("source"),
    )
    rows = sc.apply_security_overrides(entity_security(t), ov)
    return rows.select("country", "code", "has_spf", "has_dmarc", "dane_supported", "scan_valid", "override_source")


@query(
    "security_counts",
    f"""WITH {SQL_ATTACH} SELECT count(*) AS total, count(*) FILTER (scan_valid) AS scanned, count(*) FILTER (dane_supported) AS dane_supported, count(*) FILTER (has_spf) AS spf,
      count(*) FILTER (has_good_spf) AS good_spf, count(*) FILTER (has_dmarc) AS dmarc, count(*) FILTER (has_good_dmarc) AS good_dmarc, count(*) FILTER (has_dkim) AS dkim FROM att""",
)
def security_counts(t):
    return sc.security_counts(entity_security(t))


def flat_result(t):
    """Third-party rows with localised booleans, one per entity: some codes of their own, some sent twice, some also in another country."""
    one = t("v_entity").select("country", "k", "c", (F.col("k") * 2).alias("pos"))
    again = one.filter("k % 13 = 0").select("country", "k", (F.col("c") + 1).alias("c"), (F.col("pos") + 1).alias("pos"))
    abroad = one.filter("k % 17 = 0").select(F.lit("li").alias("country"), "k", (F.col("c") + 2).alias("c"), "pos")
    k, c = F.col("k"), F.col("c")
    return one.unionByName(again).unionByName(abroad).select(
        "country",
        "pos",
        F.when(k % 19 == 0, k + 90000000).otherwise(k).alias("code"),
        F.when(c % 4 == 0, "0").when(c % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("mx"), c)).alias("mxrecordName"),
        F.concat(F.lit("f"), k, F.lit(".de")).alias("emails"),
        F.when(c % 3 == 0, "WAHR").otherwise("FALSCH").alias("hasDane"),
        F.when(k % 5 == 0, "1").when(k % 5 == 1, "None").otherwise("WAHR").alias("hasSpf"),
        F.when(k % 7 == 0, "WAHR").alias("hasGoodSpf"),
        F.when(k % 2 == 0, "0").otherwise("true").alias("hasDmarc"),
        F.lit("FALSCH").alias("hasGoodDmarc"),
    )


SQL_FLAT = """sent AS (SELECT country, k, c, k * 2 AS pos FROM v_entity UNION ALL SELECT country, k, c + 1, k * 2 + 1 FROM v_entity WHERE k % 13 = 0 UNION ALL SELECT 'li', k, c + 2, k * 2 FROM v_entity WHERE k % 17 = 0),
  flat AS (SELECT country, lpad(CAST(CASE WHEN k % 19 = 0 THEN k + 90000000 ELSE k END AS STRING), 8, '0') AS code, CASE WHEN c % 4 > 1 THEN 'mx' || c END AS mx, 'f' || k || '.de' AS fd,
    c % 3 = 0 AS dane, k % 5 <> 1 AS spf, k % 7 = 0 AS gspf, k % 2 <> 0 AS dmarc, false AS gdmarc FROM (SELECT *, row_number() OVER (PARTITION BY country, k ORDER BY pos DESC) AS rn FROM sent) z WHERE rn = 1)"""


@query(
    "convert_flat_result",
    f"""WITH {SQL_FLAT} SELECT e.country, e.code, CASE WHEN f.code IS NOT NULL AND e.domain = '' THEN fd ELSE e.domain END AS domain, coalesce(mx, '') AS mx, dane AS dane_supported, dane AS dane_partial, spf AS has_spf,
      gspf AS has_good_spf, dmarc AS has_dmarc, gdmarc AS has_good_dmarc, CASE WHEN f.code IS NOT NULL THEN false END AS has_dkim, coalesce(mx IS NOT NULL OR spf OR dmarc OR dane, false) AS scan_valid
    FROM v_entity e LEFT JOIN flat f ON e.code = f.code AND e.country = f.country""",
)
def convert_flat_result(t):
    rows = sc.convert_flat_result(t("v_entity").select("country", "code", "domain"), flat_result(t), 8)
    return rows.withColumn("mx", F.array_join("mx_records", " ")).drop("mx_records")


@query(
    "merge_dane",
    f"""WITH {SQL_FLAT} SELECT s.country, s.code, coalesce(dane, dane_supported) AS dane_supported, coalesce(dane, dane_partial) AS dane_partial, coalesce(dane <> coalesce(dane_supported, false), false) AS changed
    FROM v_security s LEFT JOIN flat f ON s.code = f.code AND s.country = f.country""",
)
def merge_dane(t):
    return sc.merge_dane(t("v_security"), flat_result(t), 8).select("country", "code", "dane_supported", "dane_partial", "changed")


def sql_problem(field: str, want: str, got: str) -> str:
    return f"SELECT f.country, f.code, '{field}' AS field, 'source ' || {want} || ', output ' || coalesce({got}, false) AS problem FROM flat f JOIN v_security s ON s.code = f.code AND s.country = f.country WHERE {want} <> coalesce({got}, false)"


@query(
    "verify_conversion",
    f"""WITH {SQL_FLAT} SELECT country, code, 'row' AS field, 'missing from output' AS problem FROM flat WHERE (country || code) NOT IN (SELECT country || code FROM v_security) UNION ALL """
    + " UNION ALL ".join(
        sql_problem(f, w, g)
        for f, w, g in [
            ("hasDane", "dane", "dane_supported"), ("hasSpf", "spf", "has_spf"), ("hasGoodSpf", "gspf", "has_good_spf"),
            ("hasDmarc", "dmarc", "has_dmarc"), ("hasGoodDmarc", "gdmarc", "has_good_dmarc"),
        ]
    ),
)
def verify_conversion(t):
    return sc.verify_conversion(flat_result(t), t("v_security"), 8)


# --- server analyses ----------------------------------------------------------------------------------------------

TLSV = " AND ".join(f"{f} IS NOT NULL" for f in dims.TLS_FLAGS)
HIGH = "CASE WHEN has_tls1_3 THEN 6 WHEN has_tls1_2 THEN 5 WHEN has_tls1_1 THEN 4 WHEN has_tls1 THEN 3 WHEN has_sslv3 THEN 2 WHEN has_sslv2 THEN 1 ELSE 0 END"
LOW = "CASE WHEN has_sslv2 THEN 1 WHEN has_sslv3 THEN 2 WHEN has_tls1 THEN 3 WHEN has_tls1_1 THEN 4 WHEN has_tls1_2 THEN 5 WHEN has_tls1_3 THEN 6 ELSE 0 END"
VALID = f"""valid AS (SELECT *, {HIGH} AS hi, {LOW} AS lo, array_to_string(list_slice(string_split(mx, '.'), -2, -1), '.') AS operator FROM v_mta WHERE mx IS NOT NULL AND ip IS NOT NULL AND has_dane IS NOT NULL AND {TLSV})"""
VER = "CASE {0} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(dims.TLS_VERSIONS)) + " END"
BOUNDS = "min(hi) AS max_all, max(hi) AS max_any, max(lo) AS min_all, min(lo) AS min_any"
MXD = f"mxd AS (SELECT valid.*, {SQL_MXDANE} AS mx_dane FROM valid)"


def valid(t):
    return sc.valid_mta(t("v_mta"))


@query("valid_servers", f"WITH {VALID} SELECT domain, mx, ip, pos, {VER.format('hi')} AS highest, {VER.format('lo')} AS lowest FROM valid")
def valid_servers(t):
    rows = mt.tls_bounds(valid(t))
    return rows.select("domain", "mx", "ip", "pos", mt.version_name(F.col("max_tls")).alias("highest"), mt.version_name(F.col("min_tls")).alias("lowest"))


DOMCOUNT = """(SELECT count(*) AS total, count(*) FILTER (a) AS without_mx, count(*) FILTER (b) AS no_resolvable_mx
    FROM (SELECT domain, bool_and(mx IS NULL) AS a, bool_and(mx IS NOT NULL AND ip IS NULL) AS b FROM v_mta GROUP BY domain) x)"""
CLASSES = f"""(SELECT count(*) FILTER (e) AS only_valid, count(*) FILTER (s AND NOT e) AS valid_and_invalid, count(*) FILTER (NOT s) AS no_valid
    FROM (SELECT domain, bool_and({TLSV} AND has_dane IS NOT NULL) AS e, bool_or({TLSV} AND has_dane IS NOT NULL) AS s FROM v_mta WHERE mx IS NOT NULL AND ip IS NOT NULL GROUP BY domain) y)"""


@query("domain_counts", f"SELECT * FROM {DOMCOUNT}")
def domain_counts(t):
    return mt.domain_counts(t("v_mta"))


@query("validity_classes", f"SELECT * FROM {CLASSES}")
def validity_classes(t):
    return mt.validity_classes(t("v_mta"))


MODES_SQL = f"""b AS (SELECT domain, {BOUNDS} FROM valid GROUP BY domain), modes AS (SELECT mode, {VER.format('o')} AS version, count(*) AS n FROM (UNPIVOT b ON max_all, max_any, min_all, min_any INTO NAME mode VALUE o) u GROUP BY 1, 2)"""


@query("tls_modes", f"WITH {VALID}, {MODES_SQL} SELECT * FROM modes")
def tls_modes(t):
    return mt.tls_modes(valid(t))


@query("mixed_tls", f"WITH {VALID}, m AS (SELECT domain, min(hi) <> max(hi) AS mixed_max, min(lo) <> max(lo) AS mixed_min FROM valid GROUP BY domain) SELECT * FROM m WHERE mixed_max OR mixed_min")
def mixed_tls(t):
    return mt.mixed_tls(valid(t))


@query("dane_support", "SELECT domain, bool_and(coalesce(has_dane, false)) AS dane_all, bool_or(coalesce(has_dane, false)) AS dane_any FROM v_mta GROUP BY domain")
def dane_support(t):
    return mt.dane_support(t("v_mta"))


@query("dane_support_mx", f"WITH {VALID}, {MXD} SELECT domain, bool_and(mx_dane) AS dane_all, bool_or(mx_dane) AS dane_any FROM mxd GROUP BY domain")
def dane_support_mx(t):
    t.stored("v_mta")
    return mt.dane_support_mx(valid(t), sc.dane_flags(t("v_address"), t("v_dane_log")))


@query("secure_domains", f"WITH {VALID} SELECT domain FROM valid GROUP BY domain HAVING bool_and(has_dane) AND min(hi) >= 5")
def secure_domains(t):
    return mt.secure_domains(valid(t))


AUTHC = "SELECT " + ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in sc.AUTH_FLAGS) + f""" FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pos, {', '.join(f'{f} NULLS FIRST' for f in sc.AUTH_FLAGS)}) AS rn FROM v_mta) z WHERE rn = 1"""


@query("domain_auth_counts", AUTHC)
def domain_auth_counts(t):
    return mt.domain_auth_counts(t("v_mta"))


SIZES = "sizes AS (SELECT operator, count(DISTINCT domain) AS domains FROM valid WHERE operator IS NOT NULL GROUP BY operator)"
HALF = """half AS (SELECT count(*) AS n_leading FROM (SELECT coalesce(sum(domains) OVER (ORDER BY domains DESC, md5(operator) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p, (SELECT sum(domains) FROM sizes) AS s FROM sizes) w WHERE p < s * {0})"""
TOP = "top AS (SELECT operator, domains, row_number() OVER (ORDER BY domains DESC, md5(operator)) AS rank FROM sizes)"


@query("operator_domains", f"WITH {VALID}, {SIZES} SELECT * FROM sizes")
def operator_domains(t):
    return mt.operator_domains(valid(t))


@query(
    "operator_concentration",
    f"WITH {VALID}, {SIZES} SELECT 0.25 AS share, n_leading FROM (WITH {HALF.format(0.25)} SELECT * FROM half) a UNION ALL SELECT 0.5, n_leading FROM (WITH {HALF.format(0.5)} SELECT * FROM half) b UNION ALL SELECT 0.9, n_leading FROM (WITH {HALF.format(0.9)} SELECT * FROM half) c".replace("0.25 AS share", "CAST(0.25 AS DOUBLE) AS share"),
)
def operator_concentration(t):
    sizes = mt.operator_sizes(valid(t))
    parts = [mt.concentration(sizes, x).select(F.lit(x).alias("share"), "n_leading") for x in (0.25, 0.5, 0.9)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("top_operators", f"WITH {VALID}, {SIZES}, {HALF.format(0.5)}, {TOP} SELECT operator, domains, rank FROM top, half WHERE rank <= n_leading")
def top_operators(t):
    return mt.top_operators(mt.operator_sizes(valid(t)))


@query(
    "top_operator_detail",
    f"""WITH {VALID}, {MXD}, {SIZES}, {HALF.format(0.5)}, {TOP}, d AS (SELECT operator, bool_and(mx_dane) AS dane_all, bool_or(mx_dane) AS dane_any, {BOUNDS} FROM mxd GROUP BY operator)
    SELECT operator, dane_all, dane_any, {', '.join(f"{VER.format(m)} AS {m}" for m in mt.MODES)} FROM d JOIN top USING (operator), half WHERE rank <= n_leading""",
)
def top_operator_detail(t):
    t.stored("v_mta")
    return mt.top_operator_detail(valid(t), sc.dane_flags(t("v_address"), t("v_dane_log")))


MXTOTAL = "SELECT count(*) AS mx_total FROM (SELECT DISTINCT mx FROM v_mta) q"


@query("mx_count", MXTOTAL)
def mx_count(t):
    return mt.mx_count(t("v_mta"))


@query(
    "run_evaluation",
    f"""WITH {VALID}, {MODES_SQL}, {MXD}, {SIZES}, {HALF.format(0.5)},
      w AS (SELECT {', '.join(f"coalesce(max(CASE WHEN mode = '{m}' AND version = '{v}' THEN n END), 0) AS {m}_{v.lower()}" for m in mt.MODES for v in dims.TLS_VERSIONS)} FROM modes),
      mix AS (SELECT count(*) FILTER (a) AS mixed_max, count(*) FILTER (b) AS mixed_min FROM (SELECT domain, min(hi) <> max(hi) AS a, min(lo) <> max(lo) AS b FROM valid GROUP BY domain) x),
      dn AS (SELECT count(*) FILTER (a) AS dane_all, count(*) FILTER (b) AS dane_any FROM (SELECT domain, bool_and(has_dane) AS a, bool_or(has_dane) AS b FROM valid GROUP BY domain) x),
      dm AS (SELECT count(*) FILTER (a) AS dane_all_mx, count(*) FILTER (b) AS dane_any_mx FROM (SELECT domain, bool_and(mx_dane) AS a, bool_or(mx_dane) AS b FROM mxd GROUP BY domain) x),
      se AS (SELECT count(*) AS secure_domains FROM (SELECT domain FROM valid GROUP BY domain HAVING bool_and(has_dane) AND min(hi) >= 5) x),
      op AS (SELECT count(*) AS operators, CAST(sum(domains) AS BIGINT) AS operator_domains FROM sizes)
    SELECT * FROM {DOMCOUNT} c1, {CLASSES} c2, (SELECT count(DISTINCT domain) AS valid_domains FROM valid) c3, w, mix, dn, dm, se, ({AUTHC}) c4, op, (SELECT n_leading AS operators_half FROM half) c5, ({MXTOTAL}) c6""",
)
def run_evaluation(t):
    t.stored("v_mta")
    return mt.run_evaluation(t("v_mta"), sc.dane_flags(t("v_address"), t("v_dane_log")))


# --- security reports ---------------------------------------------------------------------------------------------

SHORTS = ", ".join(f"count(*) FILTER ({c}) AS {s}" for c, s in rp.SHORT.items())
SHORT_PCT = ", ".join(sql_pct(s, "total", f"{s}_pct") for s in rp.SHORT.values())


@query(
    "security_summary",
    f"""WITH g AS (SELECT count(*) AS total, {', '.join(f'count(*) FILTER ({m}) AS {m}' for m in rp.SUMMARY_METRICS)} FROM v_security WHERE scan_valid),
      u AS (UNPIVOT g ON {', '.join(rp.SUMMARY_METRICS)} INTO NAME metric VALUE n) SELECT metric, n, total, {sql_pct('n', 'total', 'n_pct')} FROM u""",
)
def security_summary(t):
    return r6(rp.security_summary(t("v_security")))


@query("regional_security", f"WITH g AS (SELECT country, {SQL_ABBR} AS region, count(*) AS total, {SHORTS} FROM v_security WHERE scan_valid GROUP BY 1, 2) SELECT *, {SHORT_PCT} FROM g")
def regional_security(t):
    return r6(rp.regional_security(t("v_security")))


@query(
    "combined_security",
    f"WITH g AS (SELECT country, {SQL_NAME} AS region, count(*) AS total, {SHORTS} FROM v_security WHERE scan_valid GROUP BY 1, 2), {sql_totals('g', ['total', *rp.SHORT.values()], 'Grand Total')} SELECT *, {SHORT_PCT} FROM rolled",
)
def combined_security(t):
    return r6(rp.combined_security(t("v_security")))


@query(
    "security_overview",
    f"WITH s AS (SELECT {SQL_CNAME} AS label, * FROM v_security UNION ALL SELECT 'Total', * FROM v_security), g AS (SELECT label AS country, count(*) AS total, {SHORTS} FROM s WHERE scan_valid GROUP BY 1) SELECT *, {SHORT_PCT} FROM g",
)
def security_overview(t):
    return r6(rp.security_overview(t("v_security")))


MERGED = f"""p AS (SELECT country, {SQL_DISPLAY} AS region, count(*) AS total, {SQL_COUNTS} FROM v_provider GROUP BY 1, 2),
  s AS (SELECT country, {SQL_DISPLAY} AS region, count(*) AS sec_total, {SHORTS} FROM v_security WHERE scan_valid GROUP BY 1, 2),
  g AS (SELECT p.*, coalesce(sec_total, 0) AS sec_total, {', '.join(f'coalesce({x}, 0) AS {x}' for x in rp.SHORT.values())} FROM p LEFT JOIN s ON p.country = s.country AND p.region = s.region),
  {sql_totals('g', ['total', *dims.OUTPUT_PROVIDERS, 'sec_total', *rp.SHORT.values()], 'Grand Tot.')}"""


@query(
    "merged_regional",
    f"""WITH {MERGED} SELECT *, microsoft + google + aws AS us_cloud, {sql_pct('(microsoft + google + aws)', 'total', 'us_pct')}, {sql_pct('domestic', 'total', 'dom_pct')}, {', '.join(sql_pct(x, 'sec_total', f'{x}_pct') for x in rp.SHORT.values())} FROM rolled""",
)
def merged_regional(t):
    return r6(rp.merged_regional(t("v_provider"), t("v_security")))


@query(
    "security_class_counts",
    """SELECT CASE WHEN NOT scan_valid OR has_spf IS NULL THEN 'no-data' WHEN has_good_spf AND has_good_dmarc THEN 'both' WHEN has_good_spf THEN 'spf-only' WHEN has_good_dmarc THEN 'dmarc-only' ELSE 'none' END AS class, count(*) AS n
    FROM v_security GROUP BY 1""",
)
def security_class_counts(t):
    return rp.security_class_counts(t("v_security"))


@query(
    "auth_labels",
    """SELECT country, code, CASE WHEN has_good_spf THEN 'Good (hard fail)' WHEN has_spf THEN 'Present (not enforced)' ELSE 'Missing' END AS spf,
      CASE WHEN has_good_dmarc THEN 'Good (p=reject)' WHEN has_dmarc THEN 'Present (not enforced)' ELSE 'Missing' END AS dmarc FROM v_security""",
)
def auth_labels(t):
    return t("v_security").select(
        "country",
        "code",
        labels.auth_label(F.col("has_good_spf"), F.col("has_spf"), "Good (hard fail)").alias("spf"),
        labels.auth_label(F.col("has_good_dmarc"), F.col("has_dmarc"), "Good (p=reject)").alias("dmarc"),
    )


@query(
    "asn_answers",
    r"""SELECT ip, CASE WHEN regexp_matches(trim(split_part(txt, '|', 1)), '^[0-9]+$') THEN CAST(trim(split_part(txt, '|', 1)) AS BIGINT) END AS asn, lower(trim(split_part(txt, '|', 3))) AS registered FROM v_asn""",
)
def asn_answers(t):
    return t("v_asn").select("ip", text.asn_number(F.col("txt")).alias("asn"), text.asn_country(F.col("txt")).alias("registered"))
