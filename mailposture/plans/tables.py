"""Domain-shaped views over the driver's test tables.

The test tables hold orders, events and pages, not mail data.  Each view states, in SQL that Spark and DuckDB read
alike, how a mail table is derived from them by arithmetic on keys.  Every view reads its whole base tables.
One in five orders carries the same domain (``kommunal.de``), so the hot-key paths are exercised.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailposture.session import discard, input_bytes, size_tasks, store

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

HOSTS = [
    "t#c.mail.protection.outlook.com", "aspmx.l.google.com", "inbound-smtp.eu-west-1.amazonaws.com",
    "mail#g.rzone.de", "mx#g.seppmail.cloud", "mx1.hydra.sophos.com", "mta-gw.infomaniak.ch",
    "mx00.ionos.de", "c#c.hop.net", "mail.kunde#g.at", "d#c.ess.barracudanetworks.com", "mx.microsoft",
    "mx#g.hostpoint.ch", "smtp.google.com", "c#c.hop.net",
]
KINDS = "mx|spf|dkim|dmarc|autodiscover|cname_chain|smtp|tenant|asn|txt_verification|spf_ip"
WEIGHTS = "0.20|0.20|0.15|0.02|0.08|0.03|0.04|0.10|0.03|0.07|0.08"


def _pick(texts: str, selector: str, n: int) -> str:
    """One of ``n`` texts by a key."""
    return f"split_part('{texts}', '|', CAST({selector} % {n} AS INT) + 1)"


def _host(selector: str) -> str:
    """One of the hosts; #c is the customer, #g a group of customers."""
    host = _pick("|".join(HOSTS), selector, len(HOSTS))
    return f"replace(replace({host}, '#c', CAST(c AS STRING)), '#g', CAST(c % 10 AS STRING))"


KIND = _pick(KINDS, "l_partkey", 11)
WEIGHT = f"CAST({_pick(WEIGHTS, 'l_partkey', 11)} AS DOUBLE)"

VIEWS: dict[str, str] = {}

VIEWS["v_order"] = """
SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d,
       CAST(floor(o_totalprice) AS BIGINT) AS price,
       lpad(CAST(o_orderkey AS STRING), 8, '0') AS code,
       CASE WHEN o_orderkey % 29 = 0 THEN ''
            WHEN o_orderpriority = '5-LOW' THEN 'kommunal.de'
            ELSE 'd' || CAST(o_orderkey - o_orderkey % 3 AS STRING)
                 || CASE (o_orderkey - o_orderkey % 3) % 9 WHEN 0 THEN '.de' WHEN 3 THEN '.at' ELSE '.ch' END
       END AS domain
FROM {orders}
"""

VIEWS["v_entity"] = """
SELECT CASE n_regionkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'at' ELSE 'ch' END AS country,
       code,
       CASE k % 7 WHEN 0 THEN 'Markt Größ ' || CAST(k AS STRING)
                  WHEN 1 THEN 'Saint-Étienne ' || CAST(k AS STRING)
                  WHEN 2 THEN 'Neufeld an der Leitha ' || CAST(k AS STRING)
                  WHEN 3 THEN 'Sankt Ort ' || CAST(k AS STRING) || ' (West)'
                  WHEN 4 THEN 'Twann/Tüscherz ' || CAST(k AS STRING)
                  WHEN 5 THEN 'd' || CAST(k - k % 3 AS STRING)
                  ELSE 'Ort ' || CAST(k AS STRING) END AS name,
       CASE n_nationkey % 9 WHEN 0 THEN 'Bayern' WHEN 1 THEN 'Kanton Bern' WHEN 2 THEN 'Tirol'
                            WHEN 3 THEN 'Mecklenburg-Vorpommern' WHEN 4 THEN 'Kanton Appenzell Ausserrhoden'
                            WHEN 5 THEN 'Wien' WHEN 6 THEN '' ELSE n_name END AS region,
       domain, k, c, price
FROM {v_order} JOIN {customer} ON c = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

VIEWS["v_evidence"] = f"""
SELECT v.domain AS domain, {KIND} AS kind,
       CASE l_suppkey % 6 WHEN 0 THEN 'ms365' WHEN 1 THEN 'google' WHEN 2 THEN 'aws' WHEN 3 THEN 'domestic'
                          WHEN 4 THEN 'foreign' ELSE 'unknown' END AS provider,
       {WEIGHT} AS weight,
       l_orderkey * 10 + l_linenumber AS pos
FROM {{lineitem}} JOIN {{v_order}} v ON l_orderkey = v.k
"""

VIEWS["v_mx"] = f"SELECT domain, {_host('k')} AS host FROM {{v_order}} WHERE domain <> ''"

VIEWS["v_txt"] = """
SELECT CASE k % 4 WHEN 3 THEN CASE k % 8 WHEN 3 THEN '_dmarc.' ELSE '_amazonses.' END || domain ELSE domain END AS qname,
       k AS pos,
       CASE c % 9 WHEN 0 THEN 'v=spf1 include:spf.protection.outlook.com ip4:10.' || CAST(c % 20 AS STRING) || '.0.0/16 -all'
                  WHEN 1 THEN 'V=SPF1 include:_spf.google.com include:amazonses.com ~all'
                  WHEN 2 THEN 'v=spf1 a:c' || CAST(c AS STRING) || '.hop.net ip4:10.' || CAST(c % 20 AS STRING) || '.1.2 ip4:10.3.3.3 -all'
                  WHEN 3 THEN 'MS=ms' || CAST(c AS STRING)
                  WHEN 4 THEN 'google-site-verification=' || CAST(c AS STRING)
                  WHEN 5 THEN 'v=DMARC1; p=reject; rua=mailto:x@rua.agari.com'
                  WHEN 6 THEN 'v=spf1 mx redirect=_spf.mailjet.com'
                  WHEN 7 THEN ''
                  ELSE 'amazonSES:' || CAST(c AS STRING) END AS txt
FROM {v_order} WHERE domain <> ''
"""

VIEWS["v_cname"] = """
SELECT 'c' || CAST(c_custkey AS STRING) || '.hop.net' AS qname, c_nationkey AS pos,
       CASE WHEN c_custkey % 5 = 0 THEN 'T' || CAST(c_custkey AS STRING) || '.mail.protection.outlook.com.'
            WHEN c_custkey % 5 = 1 THEN 'alt.googlemail.com'
            WHEN c_custkey < 8 THEN 'end.hop.net.'
            ELSE 'c' || CAST(CAST(floor(c_custkey / 8) AS BIGINT) AS STRING) || '.hop.net.' END AS target
FROM {customer}
UNION ALL
SELECT CASE k % 5 WHEN 0 THEN 'selector1._domainkey.' WHEN 1 THEN 'selector2._domainkey.' WHEN 2 THEN 'google._domainkey.'
                  WHEN 3 THEN 'autodiscover.' ELSE 'www.' END || domain AS qname, k AS pos,
       CASE c % 4 WHEN 0 THEN 'S.x.onmicrosoft.com.' WHEN 1 THEN 'x.domainkey.google.com' WHEN 2 THEN 'autodiscover.outlook.com.'
                  ELSE 'autodiscover.awsapps.com' END AS target
FROM {v_order} WHERE domain <> ''
"""

VIEWS["v_srv"] = """
SELECT '_autodiscover._tcp.' || domain AS qname, k AS pos,
       CASE c % 3 WHEN 0 THEN 'autodiscover.outlook.com.' WHEN 1 THEN 'mail.google.com' ELSE 'x.example' END AS target
FROM {v_order} WHERE domain <> ''
"""

VIEWS["v_a"] = """
SELECT host, 0 AS pos, '10.' || CAST(length(host) % 20 AS STRING) || '.' || CAST(ascii(host) % 4 AS STRING) || '.1' AS ip
FROM (SELECT DISTINCT host FROM {v_mx}) h
UNION ALL
SELECT host, 1 AS pos, '10.' || CAST((length(host) * 7) % 20 AS STRING) || '.9.9' AS ip
FROM (SELECT DISTINCT host FROM {v_mx}) h
"""

VIEWS["v_asn"] = """
SELECT ip,
       substr('  8075 15169 16509  none   641   642   643', length(ip) % 7 * 6 + 1, 6)
       || ' | 10.0.0.0/8 | ' || trim(substr('DECHAT  ', ascii(substr(ip, 4, 1)) % 4 * 2 + 1, 2)) || ' | ripencc | 2020-01-01' AS txt
FROM (SELECT DISTINCT ip FROM {v_a}
      UNION SELECT DISTINCT '10.' || CAST(c % 20 AS STRING) || '.1.2' AS ip FROM {v_order}
      UNION SELECT DISTINCT '10.' || CAST(c % 20 AS STRING) || '.0.0' AS ip FROM {v_order}) i
"""

VIEWS["v_smtp"] = """
SELECT host, CASE length(host) % 4 WHEN 0 THEN '220 Microsoft ESMTP MAIL Service' WHEN 1 THEN '220 mx.google.com ESMTP'
                                   WHEN 2 THEN '220 postfix' ELSE '' END AS banner,
       CASE ascii(host) % 3 WHEN 0 THEN '250 amazonses' ELSE '250 ok' END AS ehlo
FROM (SELECT DISTINCT host FROM {v_mx}) h
"""

VIEWS["v_tenant"] = """
SELECT domain, CASE max(c) % 3 WHEN 0 THEN 'Managed' WHEN 1 THEN 'Federated' ELSE 'Unknown' END AS ns_type
FROM {v_order} WHERE domain <> '' GROUP BY domain
"""

VIEWS["v_provider"] = """
SELECT country, code, name, region, domain, provider,
       CASE WHEN provider IN ('microsoft', 'google', 'aws') THEN 'us-cloud'
            WHEN provider = 'domestic' THEN country || '-based' ELSE provider END AS category,
       CASE WHEN provider = 'unknown' THEN CAST(0 AS DOUBLE)
            ELSE CAST((k * 37 + c * 11) % 1001 AS DOUBLE) / CAST(10 AS DOUBLE) END AS confidence,
       CASE k % 7 WHEN 0 THEN 'seppmail' WHEN 1 THEN 'sophos' WHEN 2 THEN 'barracuda' ELSE NULL END AS gateway,
       CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'v=spf1 include:spf.protection.outlook.com include:sendgrid.net -all'
                  WHEN 2 THEN 'v=spf1 redirect=_spf.mailjet.com' WHEN 3 THEN 'v=spf1 include:cyon.net include:x.kgrz.de ~all'
                  ELSE ' ' END AS spf, k, c
FROM (SELECT e.*, CASE WHEN domain = '' THEN 'unknown' ELSE
             CASE (k * 7 + c) % 10 WHEN 0 THEN 'microsoft' WHEN 1 THEN 'microsoft' WHEN 2 THEN 'microsoft' WHEN 3 THEN 'microsoft'
                  WHEN 4 THEN 'google' WHEN 5 THEN 'aws' WHEN 6 THEN 'domestic' WHEN 7 THEN 'domestic'
                  WHEN 8 THEN 'foreign' ELSE 'unknown' END END AS provider
      FROM {v_entity} e) p
"""

VIEWS["v_provider_mx"] = f"""
SELECT country, code, 0 AS pos, CASE WHEN k % 6 = 0 THEN NULL ELSE {_host('k')} END AS host FROM {{v_provider}}
UNION ALL
SELECT country, code, 1 AS pos, CASE WHEN k % 6 = 0 THEN NULL ELSE {_host('(k + c)')} END AS host FROM {{v_provider}}
"""

VIEWS["v_signal"] = f"""
SELECT e.country AS country, e.code AS code, l_linenumber AS pos, {KIND} AS kind,
       CASE l_suppkey % 6 WHEN 0 THEN 'microsoft' WHEN 1 THEN 'google' WHEN 2 THEN 'aws' WHEN 3 THEN 'domestic'
                          WHEN 4 THEN 'foreign' ELSE 'unknown' END AS provider,
       {WEIGHT} AS weight,
       CASE l_partkey % 11 WHEN 0 THEN 'MX h' || CAST(l_suppkey % 3 AS STRING) || '.example.org matches x'
            WHEN 1 THEN 'SPF include:s' || CAST(l_suppkey % 3 AS STRING) || '.example.org matches x'
            WHEN 8 THEN 'ASN ' || CAST(l_suppkey % 3 AS STRING) || ' registered in CH'
            WHEN 10 THEN 'SPF ip4/a ASN ' || CAST(l_suppkey % 3 AS STRING) || ' matches aws'
            ELSE 'detail ' || CAST(l_suppkey % 3 AS STRING) END AS detail
FROM {{lineitem}} JOIN {{v_entity}} e ON l_orderkey = e.k
"""

VIEWS["v_security"] = """
SELECT country, CASE WHEN k % 53 = 0 THEN 'X' || code ELSE code END AS code, name, region,
       CASE WHEN k % 41 = 0 AND domain <> '' THEN 'www.' || domain ELSE domain END AS domain,
       domain <> '' AND c % 8 <> 0 AS scan_valid,
       CASE WHEN c % 8 = 0 THEN NULL ELSE c % 3 = 0 END AS dane_supported,
       CASE WHEN c % 8 = 0 THEN NULL ELSE c % 3 = 0 AND k % 31 <> 0 END AS dane_partial,
       CASE WHEN c % 8 = 0 THEN NULL ELSE (c + k) % 5 <> 0 END AS has_spf,
       CASE WHEN c % 8 = 0 THEN NULL ELSE (c + k) % 5 > 2 OR k % 37 = 0 END AS has_good_spf,
       CASE WHEN c % 8 = 0 THEN NULL ELSE k % 3 <> 1 END AS has_dmarc,
       CASE WHEN c % 8 = 0 THEN NULL ELSE k % 6 = 2 OR k % 43 = 0 END AS has_good_dmarc,
       CASE WHEN c % 8 = 0 THEN NULL ELSE c % 2 = 0 END AS has_dkim, k, c
FROM {v_entity}
"""

VIEWS["v_security_mx"] = f"""
SELECT country, code, CASE WHEN k % 10 = 0 THEN NULL ELSE upper({_host('(k - k % 2)')}) || '.' END AS host FROM {{v_security}}
"""

VIEWS["v_mta"] = """
SELECT v.domain AS domain,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 'mx' || CAST(l_suppkey % 4 AS STRING) || '.op' || CAST(l_suppkey AS STRING) || '.net' END AS mx,
       CASE WHEN l_partkey % 17 = 0 OR l_partkey % 13 = 0 THEN NULL ELSE '192.0.2.' || CAST(l_linenumber AS STRING) END AS ip,
       CASE WHEN l_quantity > 48 THEN NULL ELSE l_suppkey % 4 = 0 END AS has_dane,
       CASE WHEN l_quantity < 2 THEN NULL ELSE l_partkey % 50 = 1 END AS has_sslv2,
       CASE WHEN l_quantity < 2 THEN NULL ELSE l_partkey % 40 = 1 END AS has_sslv3,
       CASE WHEN l_quantity < 2 THEN NULL ELSE l_partkey % 5 = 1 END AS has_tls1,
       CASE WHEN l_quantity < 2 THEN NULL ELSE l_partkey % 5 IN (1, 2) END AS has_tls1_1,
       CASE WHEN l_quantity < 2 THEN NULL ELSE l_partkey % 7 <> 0 END AS has_tls1_2,
       CASE WHEN l_quantity < 2 THEN NULL ELSE l_partkey % 7 IN (1, 2, 3) END AS has_tls1_3,
       CASE WHEN v.k % 11 = 0 THEN NULL ELSE v.k % 3 <> 0 END AS has_dmarc,
       CASE WHEN v.k % 11 = 0 THEN NULL ELSE v.k % 6 = 1 END AS has_good_dmarc,
       CASE WHEN v.k % 11 = 0 THEN NULL ELSE v.k % 5 <> 0 END AS has_spf,
       CASE WHEN v.k % 11 = 0 THEN NULL ELSE v.k % 5 = 2 END AS has_good_spf,
       CASE WHEN v.k % 11 = 0 THEN NULL ELSE v.k % 2 = 0 END AS has_dkim,
       l_orderkey * 10 + l_linenumber AS pos
FROM {lineitem} JOIN {v_order} v ON l_orderkey = v.k
WHERE v.domain <> ''
"""

VIEWS["v_dane_log"] = """
SELECT mx AS host,
       'start' || chr(10) || '## Checking ' || mx || ' 192.0.2.1 port 25' || chr(10) || CASE WHEN length(mx) % 2 = 0 THEN 'Result: DANE OK' ELSE 'Result: FAILED' END || chr(10) || chr(10)
       || '## Checking ' || mx || ' 192.0.2.2 port 25' || chr(10) || 'x' || chr(10) || CASE WHEN ascii(substr(mx, 3, 1)) % 2 = 0 THEN 'Result: DANE OK for it' ELSE 'Result: none' END || chr(10) || chr(10)
       || '## Checking ' || mx || ' 192.0.2.3 port 25' || chr(10) || 'Result: DANE OK' AS log
FROM (SELECT DISTINCT mx FROM {v_mta} WHERE mx IS NOT NULL) h
"""

VIEWS["v_tls_log"] = """
SELECT mx AS host, ip,
       CASE (length(mx) + ascii(substr(ip, 9, 1))) % 4
         WHEN 0 THEN 'x' || chr(10) || 'PROTOS_OFFERED: tls1_2:yes tls1_3:yes ssl2:no' || chr(10)
         WHEN 1 THEN 'PROTOS_OFFERED: tls1:yes tls1_1:yes tls1_2:yes tls1_3:no'
         WHEN 2 THEN '=== we''ll have to search for "^250[ -]STARTTLS" pattern ===' || chr(10) || 'S: 250 ok' || chr(10)
                     || '=== finished smtp STARTTLS dialog with 3 ===' || chr(10) || chr(10) || 'Fatal error: No STARTTLS found in handshake'
         ELSE 'timeout' END AS log
FROM (SELECT DISTINCT mx, ip FROM {v_mta} WHERE mx IS NOT NULL AND ip IS NOT NULL) h
"""

VIEWS["v_dss_log"] = """
SELECT domain,
       CASE max(k) % 4 WHEN 0 THEN '  spf: v=spf1 -all' || chr(10) || 'dmarc: v=DMARC1; p=reject' || chr(10) || 'dkim: ok'
                       WHEN 1 THEN 'spf: v=spf1 ~all' || chr(10) || 'spf: -all' || chr(10) || 'dmarc: v=DMARC1; p=none; sp=reject'
                       WHEN 2 THEN 'error: none' || chr(10) || ' dmarc: p=quarantine'
                       ELSE '' END AS log
FROM {v_order} WHERE domain <> '' GROUP BY domain
"""

VIEWS["v_address"] = """
SELECT DISTINCT domain, mx, ip, CASE WHEN ip IS NULL THEN NULL ELSE length(mx) % 3 <> 0 END AS ad FROM {v_mta}
"""

VIEWS["v_obs"] = """
SELECT CASE event_type WHEN 'click' THEN 'head' WHEN 'error' THEN 'scrape' WHEN 'signup' THEN 'mx' WHEN 'view' THEN 'dns' ELSE 'content' END AS kind,
       'd' || CAST(user_id AS STRING) || '.ch' AS domain,
       value > 10 AS accessible, props AS payload, ts AS observed_at, event_id
FROM {events}
"""

VIEWS["v_candidate"] = """
SELECT e.country AS country, e.code AS code, l_linenumber * 1000000 + l_suppkey AS pos,
       CASE l_partkey % 6 WHEN 0 THEN CASE WHEN e.domain = '' THEN 'leer.de' ELSE e.domain END
            WHEN 1 THEN 'd' || CAST(e.k % 500 AS STRING) || '.de'
            WHEN 2 THEN 'ort-' || CAST(e.k AS STRING) || CASE l_suppkey % 3 WHEN 0 THEN '.de' WHEN 1 THEN '.at' ELSE '.ch' END
            WHEN 3 THEN 'sankt-ort-' || CAST(e.k AS STRING) || '.gv.at'
            WHEN 4 THEN 'gemeinde-d' || CAST(e.k - e.k % 3 AS STRING) || '.ch'
            ELSE 'host' || CAST(l_suppkey AS STRING) || '.com' END AS domain,
       CASE l_suppkey % 7 WHEN 0 THEN 'wikidata' WHEN 1 THEN 'livenson' WHEN 2 THEN 'b42labs' WHEN 3 THEN 'csv_email'
                          WHEN 4 THEN 'bresu_email' WHEN 5 THEN 'bresu' ELSE 'guess' END AS source,
       l_suppkey % 7 IN (1, 2, 3, 4) AS is_email_domain
FROM {lineitem} JOIN {v_entity} e ON l_orderkey = e.k
"""

VIEWS["v_http"] = """
SELECT domain, min(length(domain)) % 3 <> 0 AS accessible,
       CASE WHEN ascii(substr(domain, length(domain) - 3, 1)) % 5 = 0 THEN 'neu-' || domain ELSE NULL END AS redirect,
       min(length(domain)) % 4 = 0 AS ssl_failed
FROM {v_candidate} GROUP BY domain
"""

VIEWS["v_content"] = """
SELECT domain, CASE min(length(domain)) % 6 WHEN 0 THEN 'parked' WHEN 1 THEN 'no_municipality_keywords' ELSE 'has_municipality_keywords' END AS flag
FROM {v_candidate} GROUP BY domain
"""

VIEWS["v_scraped"] = """
SELECT e.country AS country, e.code AS code, 'www' || CAST(l_suppkey AS STRING) || '.de' AS site,
       CASE l_partkey % 7 WHEN 0 THEN 'agentur' || CAST(l_suppkey AS STRING) || '.com'
            WHEN 1 THEN CASE WHEN e.domain = '' THEN 'web.de' ELSE e.domain END
            WHEN 2 THEN 'gemeinde-ort-' || CAST(e.k AS STRING) || '.ch'
            WHEN 3 THEN 'sankt-ort-' || CAST(e.k AS STRING) || '.gv.at'
            WHEN 4 THEN 'gmail.com' WHEN 5 THEN 'd' || CAST(e.k % 500 AS STRING) || '.de'
            ELSE CASE l_suppkey % 3 WHEN 0 THEN 'be.ch' WHEN 1 THEN 'tirol.gv.at' ELSE 'x' || CAST(l_suppkey AS STRING) || '.xyz' END END AS email_domain
FROM {lineitem} JOIN {v_entity} e ON l_orderkey = e.k
"""

VIEWS["v_mx_valid"] = """
SELECT domain, length(domain) % 4 <> 1 AS has_mx
FROM (SELECT DISTINCT domain FROM {v_candidate} UNION SELECT DISTINCT email_domain FROM {v_scraped}
      UNION SELECT DISTINCT redirect FROM {v_http} WHERE redirect IS NOT NULL
      UNION SELECT DISTINCT domain FROM {v_order} WHERE domain <> '') d
"""

VIEWS["v_base"] = """
SELECT country, CASE WHEN c % 100 = 7 THEN 'B' || code ELSE code END AS code, name, domain,
       CASE WHEN c % 33 = 0 AND provider <> 'google' THEN 'google' WHEN c % 47 = 1 THEN 'aws' ELSE provider END AS provider,
       CASE WHEN c % 10 = 3 THEN CAST(floor(confidence / 2) AS DOUBLE) WHEN c % 10 = 4 AND confidence < 60 THEN confidence + 40 ELSE confidence END AS confidence
FROM {v_provider}
"""

VIEWS["v_resolve"] = """
SELECT country, code, name, region,
       CASE k % 17 WHEN 0 THEN '' WHEN 1 THEN 'd' || CAST(k AS STRING) || '.de' ELSE NULL END AS override_domain,
       CASE WHEN k % 23 = 0 THEN 'Neu ' || name ELSE NULL END AS override_name,
       CASE WHEN c % 3 = 0 THEN 'host' || CAST(c % 100 AS STRING) || '.com' ELSE NULL END AS website_domain, k, c
FROM {v_entity}
"""

VIEWS["v_page"] = """
SELECT page_id, url, html,
       lower(regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '^www[.]', '')) AS site
FROM {pages}
"""

VIEWS["v_contact_page"] = """
SELECT page_id, site,
       html || '<a href="/kontakt/' || CAST(page_id % 7 AS STRING) || '">K</a><a href="https://' || site || '/impressum.pdf">P</a>'
       || '<a class="x" href="http://www.' || site || '/Verwaltung?x=1">V</a><a href="https://other.ch/kontakt">O</a><a href="mailto:a@b.ch">M</a>'
       || '<p>info@' || CASE page_id % 5 WHEN 0 THEN 'stadt' WHEN 1 THEN 'amt' ELSE 'ort' END || CAST(page_id AS STRING) || '.ch</p>'
       || '<a href="mailto:post@amt' || CAST(page_id % 50 AS STRING) || '.de?subject=x">m</a>'
       || '<p>a@gemeinde' || CAST(page_id % 30 AS STRING) || '.be b@stadt.gov.pl c@x' || CAST(page_id % 9 AS STRING) || '.y.ck d@www.ck e@2.wq f@ort.gov</p>'
       || '<b>rat(at)haus' || CAST(page_id % 9 AS STRING) || '.at</b> logo@2x.png' AS html
FROM {v_page}
"""

DEPENDS = {name: re.findall(r"\{(\w+)\}", sql) for name, sql in VIEWS.items()}


class Tables:
    """The test tables and the views over them, as DataFrames of one session."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}
        self._stored: set[str] = set()
        self.shared: dict[str, DataFrame] = {}
        self._read = 0
        self._fan_out = 1
        size_tasks(spark, 0)

    def __call__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE:
                path = f"{self.sf_dir}/{name}.parquet"
                frame = self.spark.read.parquet(path)
                self._read += input_bytes(self.spark, path)
                size_tasks(self.spark, self._read, self._fan_out)
            else:
                frame = self.spark.sql(VIEWS[name], **{dep: self(dep) for dep in set(DEPENDS[name])})
            self._frames[name] = frame
        return self._frames[name]

    def fans_out(self, times: int) -> None:
        """Size the tasks for a job whose shuffles hold up to ``times`` the bytes it reads."""
        self._fan_out = max(times, self._fan_out)
        size_tasks(self.spark, self._read, self._fan_out)

    def stored(self, name: str, write: Callable[[DataFrame], DataFrame] = store) -> DataFrame:
        """The same as a written table, for jobs that read it several times; later views build on the written table."""
        if name not in self._stored:
            self._frames[name] = write(self(name))
            self._stored.add(name)
        return self._frames[name]

    def discard(self, *names: str) -> None:
        """Delete written tables that no frame in use reads any more.  Views that were built on them are built anew when they are asked for."""
        gone = self._stored.intersection(names)
        discard(*(self._frames[name] for name in gone))
        self._stored -= gone
        self._frames = {name: frame for name, frame in self._frames.items() if name in BASE or name in self._stored}


def with_views(sql: str) -> str:
    """DuckDB statement: the views a query mentions, as common table expressions in front of it."""
    needed: list[str] = []

    def need(name: str) -> None:
        for dep in DEPENDS[name]:
            if dep in VIEWS:
                need(dep)
        if name not in needed:
            needed.append(name)

    for word in dict.fromkeys(re.findall(r"\bv_\w+\b", sql)):
        if word in VIEWS:
            need(word)
    if not needed:
        return sql
    plain = {name: name for name in [*BASE, *VIEWS]}
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].format(**plain).strip()})" for name in needed)
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"
