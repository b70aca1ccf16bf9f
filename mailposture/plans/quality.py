"""Queries over quality checks, validation, regression and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailposture import dims
from mailposture.operators import quality as qc
from mailposture.operators import reports as rp
from mailposture.operators import stats as st
from mailposture.operators.signatures import signature_table
from mailposture.plans.providers import EXPORT_SQL, export_rows, sql_any, sql_pct
from mailposture.plans.registry import query, r6
from mailposture.plans.security import MERGED
from mailposture.session import store

SHOWN = ["severity", "category", "country", "code", "name", "region", "domain", "message"]
HEAD = "upper(country) AS country, code, name, region, domain"


def shown(df):
    return df.select(*SHOWN)


def check_args(t):
    # Thirteen checks read these views; each is built on the one before.
    for name in ("v_entity", "v_provider", "v_security"):
        t.stored(name)
    return t("v_provider"), t("v_signal"), t("v_provider_mx"), t("v_security"), t("v_security_mx"), t("v_txt")


SQL_LOW = f"""SELECT 'WARNING' AS severity, 'low_confidence' AS category, {HEAD}, 'provider=' || provider || ' confidence=' || CAST(CAST(round_even(confidence, 0) AS INTEGER) AS VARCHAR) || '%' AS message
    FROM v_provider WHERE provider <> 'unknown' AND confidence < 60"""


@query("check_low_confidence", SQL_LOW)
def check_low_confidence(t):
    return shown(qc.check_low_confidence(t("v_provider")))


SQL_CONTRA_CTE = """
  pk AS (SELECT country, code, provider, kind, arg_min(weight, (pos, weight)) AS weight FROM v_signal WHERE kind IN ('mx', 'spf', 'dkim', 'autodiscover') GROUP BY ALL),
  pw AS (SELECT country, code, provider, CAST(sum(round(weight * 100)) AS BIGINT) AS cents FROM pk GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY country, code ORDER BY cents DESC, provider) AS rn FROM pw),
  duel AS (SELECT a.country, a.code, a.provider AS p1, a.cents AS c1, b.provider AS p2, b.cents AS c2 FROM rk a JOIN rk b ON a.country = b.country AND a.code = b.code AND a.rn = 1 AND b.rn = 2)"""
SQL_CONTRA = """SELECT CASE WHEN c1 <= c2 THEN 'ERROR' ELSE 'WARNING' END AS severity, 'contradictory_signals' AS category, upper(p.country) AS country, p.code, name, region, domain,
      format('winner={} ({}={:.2f} vs {}={:.2f})', provider, p1, c1 / 100, p2, c2 / 100) AS message
    FROM v_provider p JOIN duel d ON p.country = d.country AND p.code = d.code WHERE c1 * 2 < c2 * 3"""


@query("contradictory_signals", f"WITH {SQL_CONTRA_CTE} {SQL_CONTRA}")
def contradictory_signals(t):
    return shown(qc.check_contradictory(t("v_provider"), t("v_signal")))


SQL_UNKNOWN = """SELECT CASE WHEN domain <> '' AND n > 0 THEN 'WARNING' ELSE 'INFO' END AS severity, 'unknown_classification' AS category, upper(country) AS country, code, name, region, domain,
      CASE WHEN domain = '' THEN 'no domain resolved' WHEN n > 0 THEN 'has ' || n || ' signal(s) but no clear winner' ELSE 'no signals at all' END AS message
    FROM (SELECT p.*, (SELECT count(*) FROM v_signal s WHERE s.country = p.country AND s.code = p.code) AS n FROM v_provider p WHERE provider = 'unknown') u WHERE domain = '' OR gateway IS NULL"""


@query("check_unknown", SQL_UNKNOWN)
def check_unknown(t):
    return shown(qc.check_unknown(t("v_provider"), t("v_signal")))


GATEWAY_WORDS = [w for words in dims.GATEWAYS.values() for w in words]
SQL_FITS = " WHEN ".join(f"'{out}' THEN {sql_any('host', dims.MX_PATTERNS[sig])}" for out, sig in qc.SIGNATURE_NAME.items())
SQL_MXP = f"""SELECT 'ERROR' AS severity, 'mx_provider_mismatch' AS category, upper(p.country) AS country, p.code, name, region, domain,
      'provider=' || provider || CASE WHEN n IS NULL THEN ' but no MX records' ELSE ' but MX=' || hosts END AS message
    FROM v_provider p LEFT JOIN (SELECT m.country, m.code, count(*) AS n, bool_or({sql_any('host', GATEWAY_WORDS)}) AS gw, bool_or(CASE q.provider WHEN {SQL_FITS} END) AS fits, string_agg(host, ', ' ORDER BY m.pos) AS hosts
      FROM v_provider_mx m JOIN v_provider q ON m.country = q.country AND m.code = q.code WHERE host IS NOT NULL GROUP BY m.country, m.code) x ON p.country = x.country AND p.code = x.code
    WHERE provider IN ('microsoft', 'google', 'aws') AND gateway IS NULL AND (n IS NULL OR (NOT gw AND NOT fits))"""


@query("check_mx_provider", SQL_MXP)
def check_mx_provider(t):
    return shown(qc.check_mx_provider(t("v_provider"), t("v_provider_mx")))


@query("check_mx_provider_by_table", SQL_MXP)
def check_mx_provider_by_table(t):
    return shown(qc.check_mx_provider(t("v_provider"), t("v_provider_mx"), signature_table(t.spark, dims.MX_PATTERNS)))


SQL_NOSPF = f"""SELECT 'WARNING' AS severity, 'missing_spf' AS category, {HEAD}, 'provider=' || provider || ' but no SPF record' AS message FROM v_provider WHERE provider NOT IN ('unknown', 'domestic') AND trim(spf) = ''"""


@query("check_missing_spf", SQL_NOSPF)
def check_missing_spf(t):
    return shown(qc.check_missing_spf(t("v_provider")))


SQL_INVALID = f"SELECT 'INFO' AS severity, 'invalid_scan' AS category, {HEAD}, 'scan_valid=False' AS message FROM v_security WHERE NOT scan_valid"


@query("check_invalid_scans", SQL_INVALID)
def check_invalid_scans(t):
    return shown(qc.check_invalid_scans(t("v_security")))


SQL_LOGICAL = " UNION ALL ".join(
    f"SELECT 'ERROR' AS severity, 'logical_contradiction' AS category, {HEAD}, 'has_good_{x}=True but has_{x}=False' AS message FROM v_security WHERE has_good_{x} AND NOT has_{x}" for x in ("spf", "dmarc")
)


@query("check_logical", SQL_LOGICAL)
def check_logical(t):
    return shown(qc.check_logical(t("v_security")))


SQL_DANE = f"SELECT 'ERROR' AS severity, 'dane_inconsistency' AS category, {HEAD}, 'dane.supported=True but dane.partial=False' AS message FROM v_security WHERE dane_supported AND NOT dane_partial"


@query("check_dane", SQL_DANE)
def check_dane(t):
    return shown(qc.check_dane(t("v_security")))


SQL_NOW = "(SELECT qname FROM v_txt WHERE contains(lower(txt), 'v=spf1'))"
SQL_SCANSPF = f"SELECT 'ERROR' AS severity, 'scan_spf_mismatch' AS category, {HEAD}, 'scan says no SPF but DNS has SPF record' AS message FROM v_security WHERE scan_valid AND domain <> '' AND NOT coalesce(has_spf, false) AND domain IN {SQL_NOW}"


@query("check_scan_spf", SQL_SCANSPF)
def check_scan_spf(t):
    return shown(qc.check_scan_spf(t("v_security"), t("v_txt")))


SQL_MISMATCH = """SELECT 'ERROR' AS severity, 'domain_mismatch' AS category, upper(p.country) AS country, p.code, p.name, p.region, p.domain, 'providers=' || p.domain || ' vs security=' || s.domain AS message
    FROM v_provider p JOIN v_security s ON p.country = s.country AND p.code = s.code WHERE p.domain <> '' AND s.domain <> '' AND p.domain <> s.domain"""


@query("check_domain_mismatch", SQL_MISMATCH)
def check_domain_mismatch(t):
    return shown(qc.check_domain_mismatch(t("v_provider"), t("v_security")))


SQL_DIV_CTE = """
  ph AS (SELECT DISTINCT country, code, rtrim(lower(host), '.') AS host FROM v_provider_mx WHERE host IS NOT NULL),
  sh AS (SELECT DISTINCT country, code, rtrim(lower(host), '.') AS host FROM v_security_mx WHERE host IS NOT NULL),
  ov AS (SELECT coalesce(ph.country, sh.country) AS country, coalesce(ph.code, sh.code) AS code, count(ph.host) AS np, count(sh.host) AS ns, count(*) FILTER (ph.host IS NOT NULL AND sh.host IS NOT NULL) AS nb, count(*) AS nu
    FROM ph FULL JOIN sh ON ph.country = sh.country AND ph.code = sh.code AND ph.host = sh.host GROUP BY 1, 2)"""
SQL_DIV = """SELECT 'WARNING' AS severity, 'mx_divergence' AS category, upper(p.country) AS country, p.code, p.name, p.region, p.domain,
      'providers MX=[' || (SELECT string_agg('''' || host || '''', ', ' ORDER BY host) FROM ph WHERE ph.country = p.country AND ph.code = p.code) || '] vs security MX=[' || (SELECT string_agg('''' || host || '''', ', ' ORDER BY host) FROM sh WHERE sh.country = p.country AND sh.code = p.code) || ']' AS message
    FROM v_provider p JOIN ov ON p.country = ov.country AND p.code = ov.code SEMI JOIN v_security s ON p.country = s.country AND p.code = s.code WHERE np > 0 AND ns > 0 AND (nu - nb) > nu * 0.5"""


@query("mx_divergence", f"WITH {SQL_DIV_CTE} {SQL_DIV}")
def mx_divergence(t):
    p, _, pmx, s, smx, _ = check_args(t)
    return shown(qc.check_mx_divergence(p, pmx, s, smx))


SQL_MISSING = f"""SELECT 'WARNING' AS severity, 'missing_municipality' AS category, {HEAD}, 'in providers but missing from security' AS message FROM v_provider WHERE (country, code) NOT IN (SELECT (country, code) FROM v_security)
    UNION ALL SELECT 'ERROR', 'missing_municipality', {HEAD}, 'in security but missing from providers' FROM v_security WHERE (country, code) NOT IN (SELECT (country, code) FROM v_provider)"""


@query("check_missing", SQL_MISSING)
def check_missing(t):
    return shown(qc.check_missing(t("v_provider"), t("v_security")))


SQL_EXPECTED = f"""SELECT 'WARNING' AS severity, 'expected_security_missing' AS category, {HEAD}, 'provider=microsoft but no SPF (verified with DNS)' AS message FROM v_provider
    WHERE provider = 'microsoft' AND (country, code) IN (SELECT (country, code) FROM v_security WHERE scan_valid AND NOT coalesce(has_spf, false)) AND domain NOT IN {SQL_NOW}"""


@query("check_expected_security", SQL_EXPECTED)
def check_expected_security(t):
    return shown(qc.check_expected_security(t("v_provider"), t("v_security"), t("v_txt")))


ALL = [SQL_LOW, SQL_CONTRA, SQL_UNKNOWN, SQL_MXP, SQL_NOSPF, SQL_INVALID, SQL_LOGICAL, SQL_DANE, SQL_SCANSPF, SQL_MISMATCH, SQL_DIV, SQL_MISSING, SQL_EXPECTED]
SQL_ALL = f"{SQL_CONTRA_CTE}, {SQL_DIV_CTE}, allf AS (" + " UNION ALL ".join(ALL) + ")"


@query("findings", f"WITH {SQL_ALL} SELECT * FROM allf")
def findings(t):
    return shown(qc.run_all_checks(*check_args(t)))


@query(
    "findings_summary",
    f"WITH {SQL_ALL} SELECT category, count(*) FILTER (severity = 'ERROR') AS error, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info, count(*) AS total FROM allf GROUP BY 1",
)
def findings_summary(t):
    return qc.findings_summary(qc.run_all_checks(*check_args(t)))


ORDER = "list_position(['ERROR', 'WARNING', 'INFO'], severity), " + f"list_position({dims.FINDING_CATEGORIES}, category), list_position(['DE', 'AT', 'CH'], country), code, message"


@query("top_findings", f"WITH {SQL_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {ORDER}) AS rank FROM allf) SELECT * FROM r WHERE rank <= 50")
def top_findings(t):
    return qc.top_findings(qc.run_all_checks(*check_args(t)), 50).select(*SHOWN, "rank")


@query(
    "verify_mx",
    f"""WITH {SQL_ALL}, s AS (SELECT category, lower(country) AS country, code, domain, message FROM allf WHERE severity = 'ERROR' AND domain <> '' ORDER BY {ORDER.replace('country)', 'upper(country))')} LIMIT 10),
      x AS (SELECT s.*, coalesce((SELECT string_agg(DISTINCT rtrim(lower(host), '.'), ', ' ORDER BY rtrim(lower(host), '.')) FROM v_provider_mx m WHERE m.country = s.country AND m.code = s.code), '') AS stored,
        coalesce((SELECT string_agg(DISTINCT host, ', ' ORDER BY host) FROM v_mx m WHERE m.domain = s.domain), '') AS current FROM s)
    SELECT *, CASE WHEN stored = '' THEN '?' WHEN stored = current THEN 'yes' ELSE 'differs' END AS match FROM x""",
)
def verify_mx(t):
    return qc.verify_mx(store(qc.run_all_checks(*check_args(t))), t("v_provider_mx"), t("v_mx"), 10)


# --- validation ---------------------------------------------------------------------------------------------------


def damaged(t):
    """Provider rows with faults at a few places, derived from the row itself."""
    k = F.col("k")
    return t("v_provider").select(
        "country",
        "code",
        "name",
        "region",
        F.when(k % 97 == 0, F.concat(F.lit("info@"), F.col("domain"))).otherwise(F.col("domain")).alias("domain"),
        F.when(k % 101 == 0, "azure").otherwise(F.col("provider")).alias("provider"),
        F.when(k % 103 == 0, "us-cloud").otherwise(F.col("category")).alias("category"),
        F.when(k % 107 == 0, F.col("confidence") + 50).otherwise(F.col("confidence")).alias("confidence"),
        F.when(k % 109 == 0, "").otherwise(F.col("gateway")).alias("gateway"),
        F.when(k % 113 == 0, F.lit(None)).otherwise(F.col("spf")).alias("spf"),
    )


SQL_DAMAGED = """dam AS (SELECT country, code, CASE WHEN k % 97 = 0 THEN 'info@' || domain ELSE domain END AS domain, CASE WHEN k % 101 = 0 THEN 'azure' ELSE provider END AS provider,
    CASE WHEN k % 103 = 0 THEN 'us-cloud' ELSE category END AS category, CASE WHEN k % 107 = 0 THEN confidence + 50 ELSE confidence END AS confidence, CASE WHEN k % 109 = 0 THEN '' ELSE gateway END AS gateway,
    CASE WHEN k % 113 = 0 THEN NULL ELSE spf END AS spf FROM v_provider)"""
SQL_EXP = "CASE WHEN provider IN ('microsoft', 'google', 'aws') THEN 'us-cloud' WHEN provider = 'domestic' THEN country || '-based' WHEN provider = 'foreign' THEN 'foreign' ELSE 'unknown' END"


@query(
    "structure_violations",
    f"""WITH {SQL_DAMAGED}
    SELECT country, code, 'error' AS level, 'missing field ''spf''' AS message FROM dam WHERE spf IS NULL
    UNION ALL SELECT country, code, 'error', 'unknown provider ''' || provider || '''' FROM dam WHERE provider = 'azure'
    UNION ALL SELECT country, code, 'error', 'provider ''' || provider || ''' should map to ''' || {SQL_EXP} || ''', got ''' || category || '''' FROM dam WHERE category <> {SQL_EXP}
    UNION ALL SELECT country, code, 'error', 'confidence out of [0, 100] range' FROM dam WHERE confidence > 100
    UNION ALL SELECT country, code, 'error', 'unknown provider with confidence (expected 0)' FROM dam WHERE provider = 'unknown' AND confidence <> 0
    UNION ALL SELECT country, code, 'error', 'domain looks like email: ' || domain FROM dam WHERE contains(domain, '@')
    UNION ALL SELECT country, code, 'warning', 'empty domain for provider ''' || provider || '''' FROM dam WHERE domain = '' AND provider <> 'unknown'
    UNION ALL SELECT country, code, 'warning', 'gateway field present but empty' FROM dam WHERE gateway = ''
    UNION ALL SELECT country, code, 'warning', 'unknown provider with signals (gateway or confirmation-only)' FROM dam WHERE provider = 'unknown' AND (country, code) IN (SELECT (country, code) FROM v_signal)
    UNION ALL SELECT country, NULL, 'warning', 'too few entries have confidence >= 50' FROM dam GROUP BY country HAVING count(*) FILTER (confidence >= 50) < 0.9 * count(*)
    UNION ALL SELECT country, NULL, 'warning', 'too many entries have 0 confidence' FROM dam GROUP BY country HAVING count(*) FILTER (confidence = 0) > 0.05 * count(*)""",
)
def structure_violations(t):
    return qc.validate_structure(damaged(t), t("v_signal")).select("country", "code", "level", "message")


@query(
    "header_violations",
    """WITH a AS (SELECT country, provider, count(*) AS n FROM v_provider GROUP BY 1, 2), h AS (SELECT country, provider, n, sum(n) OVER (PARTITION BY country) AS total FROM (SELECT country, provider, count(*) AS n FROM v_base GROUP BY 1, 2) b),
      g AS (SELECT country, max(total) AS total, sum(coalesce(h.n, 0)) AS sn, sum(coalesce(a.n, 0)) AS rows, bool_or(coalesce(h.n, 0) <> coalesce(a.n, 0)) AS differs FROM a FULL JOIN h USING (country, provider) GROUP BY country)
    SELECT country, 'total differs from the number of entries' AS message FROM g WHERE rows <> total UNION ALL SELECT country, 'counts sum differs from total' FROM g WHERE sn <> total
    UNION ALL SELECT country, 'counts header does not match the distribution' FROM g WHERE differs""",
)
def header_violations(t):
    counts = t("v_base").groupBy("country", "provider").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("country").agg(F.sum("n").alias("total"))
    return qc.header_problems(t("v_provider"), counts.join(totals, "country")).select("country", "message")


@query(
    "merged_violations",
    f"""WITH {MERGED}, bad AS (SELECT * REPLACE (CASE WHEN region IN ('Tirol', 'Meckl.-Vorp.') THEN sec_total + total ELSE spf END AS spf) FROM rolled)
    SELECT 'metric exceeds sec_total' AS rule, country, region FROM bad WHERE region NOT IN ('Total', 'Grand Tot.') AND greatest(spf, good_spf, dmarc, good_dmarc, dane) > sec_total
    UNION ALL SELECT 'subtotal differs from its regions', country, 'Total' FROM (SELECT country, sum(CASE WHEN region = 'Total' THEN -spf ELSE spf END) AS d FROM bad WHERE country <> 'ALL' GROUP BY country) x WHERE d <> 0""",
)
def merged_violations(t):
    merged = rp.merged_regional(t("v_provider"), t("v_security"))
    damaged = F.col("region").isin("Tirol", "Meckl.-Vorp.")
    changed = merged.withColumn("spf", F.when(damaged, F.col("sec_total") + F.col("total")).otherwise(F.col("spf")))
    return qc.validate_merged(store(changed))


# --- regression ---------------------------------------------------------------------------------------------------

SQL_REG = """reg AS (SELECT coalesce(p.country, b.country) AS country, coalesce(p.code, b.code) AS code, p.name, p.domain, p.provider AS new, p.confidence AS new_conf, b.provider AS old, b.confidence AS old_conf,
    CASE WHEN b.code IS NULL THEN 'only_current' WHEN p.code IS NULL THEN 'only_base' ELSE 'matched' END AS state FROM v_provider p FULL JOIN v_base b ON p.country = b.country AND p.code = b.code)"""


def reg(t):
    return qc.regression(t("v_provider"), t("v_base"))


@query("regression", f"WITH {SQL_REG} SELECT * FROM reg")
def regression(t):
    return reg(t)


@query("regression_changes", f"WITH {SQL_REG} SELECT * EXCLUDE (state) FROM reg WHERE state = 'matched' AND old <> new")
def regression_changes(t):
    return qc.regression_changes(reg(t))


@query("regression_drops", f"WITH {SQL_REG} SELECT country, code, round(new_conf - old_conf, 6) AS delta FROM reg WHERE state = 'matched' AND old = new AND new_conf - old_conf < -20")
def regression_drops(t):
    return r6(qc.regression_drops(reg(t)).select("country", "code", "delta"))


@query(
    "regression_summary",
    f"""WITH {SQL_REG}, g AS (SELECT count(*) FILTER (state = 'matched') AS matched, count(*) FILTER (state = 'only_base') AS only_base, count(*) FILTER (state = 'only_current') AS only_current,
      count(*) FILTER (state = 'matched' AND old <> new) AS changes, count(*) FILTER (state = 'matched' AND old = new AND new_conf - old_conf < -20) AS big_drops, count(*) FILTER (state = 'matched' AND old <> new AND new = 'unknown') AS new_unknowns FROM reg)
    SELECT *, {sql_pct('changes', 'matched', 'change_pct')}, CASE WHEN matched = 0 OR 100.0 * changes / matched > 5 THEN 'error' WHEN changes > 0 THEN 'warning' ELSE 'ok' END AS verdict FROM g""",
)
def regression_summary(t):
    return r6(qc.regression_summary(reg(t)))


@query("regression_distribution", f"WITH {SQL_REG}, u AS (SELECT old AS provider, 0 AS now FROM reg WHERE state = 'matched' UNION ALL SELECT new, 1 FROM reg WHERE state = 'matched') SELECT provider, count(*) FILTER (now = 0) AS base, count(*) FILTER (now = 1) AS current FROM u GROUP BY 1")
def regression_distribution(t):
    return qc.regression_distribution(reg(t))


@query("delta_stats", f"WITH {SQL_REG}, d AS (SELECT round(new_conf - old_conf, 6) AS delta FROM reg WHERE state = 'matched' AND old = new) SELECT count(*) AS n, round(avg(delta), 6) AS mean, round(median(delta), 6) AS median, round(stddev_samp(delta), 6) AS stdev FROM d")
def delta_stats(t):
    return r6(qc.delta_stats(reg(t)))


# --- statistics ---------------------------------------------------------------------------------------------------


def sql_chi(rows: str, group: str, metrics: list[str], more: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(n * pow(greatest(abs(a * d - b * c) - n / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 6) AS chi2, CASE WHEN (a + b = 0 OR c + d = 0) AND a + c > 0 AND b + d > 0 THEN 0 ELSE 1 END AS dof, n::BIGINT AS n{more} FROM
        (SELECT count(*)::DOUBLE AS n, count(*) FILTER ({group} AND NOT {m})::DOUBLE AS a, count(*) FILTER ({group} AND {m})::DOUBLE AS b, count(*) FILTER (NOT ({group}) AND NOT {m})::DOUBLE AS c, count(*) FILTER (NOT ({group}) AND {m})::DOUBLE AS d FROM {rows}) x"""
        for m in metrics
    )


@query("chi_square_provider", f"WITH {EXPORT_SQL}, s AS (SELECT * FROM export WHERE scan_valid AND (category = 'us-cloud' OR category LIKE '%-based')) " + sql_chi("s", "category <> 'us-cloud'", dims.SECURITY_METRICS))
def chi_square_provider(t):
    return r6(st.chi_square_provider(export_rows(t)).select("metric", "chi2", "dof", "n"))


DELTA = ", round(CASE WHEN c + d > 0 THEN d / (c + d) * 100 ELSE 0 END - CASE WHEN a + b > 0 THEN b / (a + b) * 100 ELSE 0 END, 6) AS delta_pp"


@query("chi_square_gateway", f"WITH {EXPORT_SQL}, s AS (SELECT * FROM export WHERE scan_valid) " + sql_chi("s", "gateway = ''", dims.SECURITY_METRICS[:4], DELTA))
def chi_square_gateway(t):
    return r6(st.chi_square_gateway(export_rows(t)).select("metric", "chi2", "dof", "n", "delta_pp"))


def truth_pairs(t):
    """Baseline as the truth (some probes without a reply), current result as the prediction."""
    rows = reg(t).filter(F.col("state") != "only_current")
    return rows.select(F.when(F.col("state") == "matched", F.col("old")).alias("truth"), F.coalesce("new", F.lit("unknown")).alias("predicted"))


SQL_PAIRS = SQL_REG + ", pairs AS (SELECT CASE WHEN state = 'matched' THEN old END AS truth, coalesce(new, 'unknown') AS predicted FROM reg WHERE state <> 'only_current'), conf AS (SELECT truth, predicted, count(*) AS n FROM pairs WHERE truth IS NOT NULL GROUP BY 1, 2)"


def sql_classes(matrix: str) -> str:
    return f"""(SELECT label, coalesce(h / NULLIF(p, 0), 0) AS precision, h / s AS recall, CASE WHEN h > 0 THEN 2 * (h / p) * (h / s) / (h / p + h / s) ELSE 0 END AS f1, CAST(s AS BIGINT) AS support FROM
      (SELECT truth AS label, sum(n) AS s, coalesce(sum(n) FILTER (truth = predicted), 0) AS h, (SELECT sum(n) FROM {matrix} z WHERE z.predicted = q.truth) AS p FROM {matrix} q GROUP BY truth) y)"""


@query("confusion_matrix", f"WITH {SQL_PAIRS} SELECT * FROM conf")
def confusion_matrix(t):
    return st.confusion(truth_pairs(t))


@query("class_metrics", f"WITH {SQL_PAIRS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM {sql_classes('conf')}")
def class_metrics(t):
    return r6(st.class_metrics(st.confusion(truth_pairs(t))))


@query(
    "classification_metrics",
    f"""WITH {SQL_PAIRS}, inn AS (SELECT * FROM conf WHERE truth IN ('microsoft', 'google', 'domestic') AND predicted IN ('microsoft', 'google', 'domestic'))
    SELECT sent, replies, round(replies / sent, 6) AS response_rate, round(acc, 6) AS accuracy, round(w, 6) AS weighted_f1 FROM (SELECT count(*) AS sent, count(truth) AS replies FROM pairs) a,
      (SELECT sum(n) FILTER (truth = predicted) / sum(n) AS acc FROM conf) b, (SELECT sum(f1 * support) / sum(support) AS w FROM {sql_classes('inn')}) c""",
)
def classification_metrics(t):
    return r6(st.classification_metrics(truth_pairs(t), ["microsoft", "google", "domestic"]))
