import pytest
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.operators import classify as cls
from mailposture.operators import evidence as ev

EV = "domain string, kind string, provider string, weight double, pos bigint, skey string"


def run(spark, evidence, mx=(), gateway=None, spf=""):
    rows = [("a.ch", k, p, dims.WEIGHTS[k], i, "") for i, (k, p) in enumerate(evidence)]
    frame = spark.createDataFrame(rows, EV)
    mx_frame = spark.createDataFrame([("a.ch", bool(mx), gateway)] if (mx or gateway) else [], "domain string, has_mx boolean, gateway string")
    spf_frame = spark.createDataFrame([("a.ch", spf)] if spf else [], "domain string, spf string")
    domains = spark.createDataFrame([("a.ch",)], "domain string")
    r = cls.classify(domains, frame, mx_frame, spf_frame).first()
    return r.provider, round(r.confidence, 4), r.rule


@pytest.mark.parametrize(
    "evidence, kwargs, expected",
    [
        ([("mx", "ms365"), ("spf", "ms365")], {"mx": "x"}, ("ms365", 0.90, "mx_spf")),
        ([("mx", "ms365"), ("spf", "ms365"), ("tenant", "ms365"), ("asn", "ms365")], {"mx": "x"}, ("ms365", 0.94, "mx_spf")),
        ([("mx", "google")], {"mx": "x"}, ("google", 0.80, "mx_only")),
        ([("spf", "google")], {"gateway": "sophos", "mx": "x"}, ("google", 0.70, "spf_gw")),
        ([("dkim", "google")], {"gateway": "sophos", "mx": "x"}, ("google", 0.65, "dkim_gw")),
        ([("dkim", "ms365"), ("spf", "ms365")], {}, ("ms365", 0.60, "dkim_spf")),
        ([("spf", "aws")], {}, ("aws", 0.50, "spf_only")),
        ([("autodiscover", "ms365")], {}, ("ms365", 0.42, "fallback")),
        # DKIM beats SPF of another provider behind a gateway, not without one.
        ([("spf", "aws"), ("dkim", "ms365")], {"gateway": "x", "mx": "x"}, ("ms365", 0.65, "dkim_gw")),
        ([("spf", "aws"), ("dkim", "ms365")], {}, ("aws", 0.50, "spf_only")),
        # Ties go to the provider seen first; repeated evidence counts once.
        ([("spf", "google"), ("spf", "ms365"), ("spf", "ms365")], {}, ("google", 0.50, "spf_only")),
        ([("spf", "ms365"), ("asn", "domestic")], {"mx": "x"}, ("domestic", 0.80, "dom_mx_spf")),
        ([("asn", "domestic")], {"mx": "x"}, ("domestic", 0.70, "dom_mx_only")),
        ([("asn", "foreign"), ("asn", "domestic")], {"mx": "x"}, ("domestic", 0.70, "dom_mx_only")),
        ([("asn", "foreign")], {"mx": "x", "spf": "v=spf1"}, ("foreign", 0.60, "frgn_mx_spf")),
        ([("spf_ip", "domestic")], {}, ("domestic", 0.20, "dom_secondary")),
        ([("spf_ip", "foreign")], {}, ("foreign", 0.10, "frgn_secondary")),
        ([("asn", "domestic")], {"gateway": "x", "mx": "x"}, ("unknown", 0.0, "gateway_no_primary")),
        ([("mx", "unknown")], {}, ("unknown", 0.0, "no_country_data")),
        ([], {}, ("unknown", 0.0, "no_country_data")),
        # MX evidence of any provider keeps the election open.
        ([("mx", "aws"), ("asn", "domestic")], {"mx": "x"}, ("aws", 0.80, "mx_only")),
    ],
)
def test_rules(spark, evidence, kwargs, expected):
    assert run(spark, evidence, **kwargs) == expected


def test_confidence_is_capped(spark):
    every = [(k, "ms365") for k in dims.KINDS]
    assert run(spark, every, mx="x") == ("ms365", 1.0, "mx_spf")


def test_result_does_not_depend_on_partitioning(spark, rows):
    data = [(f"d{i % 40}.ch", dims.KINDS[i * 7 % 11], [*cls.ELECTABLE, "unknown"][i * 5 % 6], 0.1, i, "") for i in range(2000)]
    frame = spark.createDataFrame(data, EV)
    domains = frame.select("domain").distinct()
    mx = domains.select("domain", F.lit(True).alias("has_mx"), F.lit(None).cast("string").alias("gateway"))
    spf = spark.createDataFrame([], "domain string, spf string")
    results = [rows(cls.classify(domains, frame.repartition(n), mx, spf)) for n in (1, 64)]
    doubled = rows(cls.classify(domains, frame.unionByName(frame), mx, spf))
    assert results[0] == results[1] == doubled


def test_attach_and_overrides(spark, rows):
    entity = spark.createDataFrame([("ch", "1", "A", "", "a.ch"), ("ch", "2", "B", "", ""), ("de", "3", "C", "", "a.ch")], "country string, code string, name string, region string, domain string")
    classified = spark.createDataFrame([("a.ch", "ms365", 0.925, "mx_only", None, "v=spf1")], "domain string, provider string, confidence double, rule string, gateway string, spf string")
    attached = cls.attach_classification(entity, classified)
    assert rows(attached, "code", "provider", "category", "confidence") == [
        ("1", "microsoft", "us-cloud", 92.5), ("2", "unknown", "unknown", 0.0), ("3", "microsoft", "us-cloud", 92.5),
    ]
    ov = spark.createDataFrame(
        [("ch", "1", "aws", "x", "s"), ("ch", "2", "domestic", "x", "s"), ("ch", "9", "aws", "x", "s"), ("ch", "3", "zoho", "x", "s"), ("ch", "4", "aws", None, "s")],
        "country string, code string, provider string, operator string, source string",
    )
    ok, rejected = cls.split_overrides(ov)
    assert rejected.count() == 2
    out = cls.apply_provider_overrides(attached, ok)
    assert rows(out.filter("code = '2'"), "provider", "category", "confidence", "override.operator") == [("domestic", "ch-based", 100.0, "x")]
    assert rows(out.filter("code = '1'"), "provider", "override") == [("microsoft", None)]
    assert dict(rows(cls.override_outcome(attached, ok))) == {"applied": 1, "missing entity": 1, "not applied": 1}


def test_probes(spark, rows):
    mx = spark.createDataFrame([("a.ch", "A.mail.protection.outlook.com."), ("b.ch", "mx.seppmail.cloud"), ("b.ch", "a.hydra.sophos.com")], "domain string, host string")
    assert rows(ev.ev_mx(mx), "domain", "provider", "detail") == [("a.ch", "ms365", "MX a.mail.protection.outlook.com matches ms365")]
    assert rows(ev.detect_gateway(mx)) == [("b.ch", "sophos")]
    txt = spark.createDataFrame([("a.ch", 0, "x"), ("a.ch", 1, "V=spf1 Include:_spf.google.com include:amazonses.com"), ("a.ch", 2, "v=spf1 -all")], "qname string, pos int, txt string")
    assert rows(ev.ev_spf(ev.spf_record(txt)), "provider", "detail") == [
        ("aws", "SPF include:amazonses.com matches aws"), ("google", "SPF include:_spf.google.com matches google"),
    ]
    tenant = spark.createDataFrame([("a.ch", "Managed"), ("b.ch", "Unknown")], "domain string, ns_type string")
    assert rows(ev.ev_tenant(tenant), "domain", "detail") == [("a.ch", "MS365 tenant detected: Managed")]


def test_cname_chain_stops_after_ten_hops(spark, rows):
    links = [(f"h{i}", 0, f"h{i + 1}.") for i in range(15)] + [("loop1", 0, "loop2"), ("loop2", 0, "loop1"), ("x", 1, "late"), ("x", 0, "ghs.google.com.")]
    cname = spark.createDataFrame(links, "qname string, pos int, target string")
    hosts = spark.createDataFrame([("h0",), ("h8",), ("x",), ("none",), ("loop1",)], "host string")
    assert rows(ev.cname_ends(hosts, cname)) == [("h0", "h10"), ("h8", "h15"), ("loop1", "loop1"), ("x", "ghs.google.com")]


def test_alias_jumps_at_every_length(spark, rows):
    links = {f"h{i}": f"h{i + 1}" for i in range(15)} | {"l1": "l2", "l2": "l3", "l3": "l1", "t": "l2", "self": "self", **{f"s{i}": "h9" for i in range(40)}}
    table = [(k, 0, v) for k, v in links.items()] + [("h3", 1, "h0"), ("gone", 0, None)]
    cname = spark.createDataFrame(table, "qname string, pos int, target string")
    hosts = spark.createDataFrame([(h,) for h in [*links, "h15", "gone", "H2", None]], "host string")

    def end(name, hops):
        for _ in range(hops):
            name = links.get(name, name)
        return name

    for hops in (1, 2, 3, 7, 10, 16):
        want = {(h, end(h.lower(), hops)) for h in [*links, "H2"]} | {("gone", None)}
        got = [tuple(r) for r in ev.cname_ends(hosts, cname, hops).collect()]
        assert len(got) == len(want) and set(got) == want, hops
    assert ev.cname_ends(hosts, cname.limit(0)).count() == 0 and ev.cname_ends(hosts.limit(0), cname).count() == 0


def test_spf_networks_keep_the_first_address(spark, rows):
    txt = spark.createDataFrame([("a.ch", 0, "v=spf1 ip4:1.1.1.0/24 a:mx.a.ch ip4:2.2.2.2 -all")], "qname string, pos int, txt string")
    a = spark.createDataFrame([("mx.a.ch", 0, "3.3.3.3")], "host string, pos int, ip string")
    asn = spark.createDataFrame([("1.1.1.0", "7 | x | CH"), ("2.2.2.2", "7 | x | CH"), ("3.3.3.3", "8075 | x | US")], "ip string, txt string")
    got = rows(ev.ev_spf_ip(txt, a, asn, F.lit("ch")), "provider", "raw", "detail")
    assert got == [
        ("domestic", "1.1.1.0:7", "SPF ip4/a ASN 7 registered in CH"),
        ("foreign", "3.3.3.3:8075", "SPF ip4/a ASN 8075 registered in US (not CH)"),
        ("ms365", "3.3.3.3:8075", "SPF ip4/a ASN 8075 matches ms365"),
    ]
