import math

import pytest
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.operators import mta as mt
from mailposture.operators import quality as qc
from mailposture.operators import security as sc
from mailposture.operators import stats as st

NO_STARTTLS = sc.STARTTLS_SEARCH + "S: 250\n" + sc.STARTTLS_MISSING
TLS = "host string, ip string, log string"


def test_tls_verdicts(spark):
    logs = [("a", "1", "x\nPROTOS_OFFERED: tls1_2:yes tls1:no\n"), ("b", "1", NO_STARTTLS), ("c", "1", sc.STARTTLS_SEARCH + "C: x"), ("d", "1", "timeout")]
    got = {r.host: (r.has_tls1, r.has_tls1_2) for r in sc.tls_flags(spark.createDataFrame(logs, TLS)).collect()}
    assert got == {"a": (False, True), "b": (False, False), "c": (None, None), "d": (None, None)}


def test_dane_blocks(spark, rows):
    log = "head\n## Checking m 1.1.1.1 port 25\nx\nResult: FAILED\n\n## Checking m 2.2.2.2 port 25\nResult: DANE OK\n"
    addresses = spark.createDataFrame([("a", "m", "1.1.1.1"), ("a", "m", "2.2.2.2"), ("a", "m", "9.9.9.9"), ("a", "n", "1.1.1.1")], "domain string, mx string, ip string")
    assert rows(sc.dane_flags(addresses, spark.createDataFrame([("m", log)], "host string, log string"))) == [("m", "1.1.1.1", False), ("m", "2.2.2.2", True), ("m", "9.9.9.9", False)]
    first = spark.createDataFrame([("m", "Result: DANE OK\n\n")], "host string, log string")
    assert {r.mx_dane for r in sc.dane_flags(addresses, first).collect()} == {True}


def test_authentication_verdicts(spark):
    logs = spark.createDataFrame([("a", " spf: v -all\ndmarc: v; p=none; sp=reject\n"), ("b", "spf: ~all\nspf: -all"), ("c", "x dmarc: p=reject"), ("d", "dmarc: p=reject\r\n\tdkim: y")], "domain string, log string")
    got = {r.domain: (r.has_spf, r.has_good_spf, r.has_dmarc, r.has_good_dmarc, r.has_dkim) for r in sc.dss_flags(logs).collect()}
    assert got == {"a": (True, True, True, True, False), "b": (True, False, False, False, False), "c": (False,) * 5, "d": (False, False, True, True, True)}
    assert [r.has_good_dmarc for r in sc.dss_flags(logs, strict=True).orderBy("domain").collect()] == [False, False, False, True]


def test_dig_logs(spark):
    log = ";; flags: qr rd ra ad; x\n;; ANSWER SECTION:\na.ch.\t300\tIN\tMX\t10 MX.A.ch.\na.ch. 300 IN CNAME b.\n\n;; Query"
    logs = spark.createDataFrame([("a.ch", "MX", log), ("b.ch", "A", ";; flags: qr rd ra;\nnone")], "qname string, type string, log string")
    got = {r.qname: (r.answers, r.ad) for r in sc.parse_dig_logs(logs).collect()}
    assert got == {"a.ch": (["mx.a.ch"], True), "b.ch": ([], False)}


def test_addresses(spark, rows):
    domains = spark.createDataFrame([("a",), ("b",), ("c",)], "domain string")
    mx = spark.createDataFrame([("a", "m1", True), ("a", "m1", True), ("b", "m1", False), ("b", "m2", True)], "domain string, mx string, ad boolean")
    ips = spark.createDataFrame([("m1", "1"), ("m1", "2")], "mx string, ip string")
    got = rows(sc.scan_addresses(sc.domain_mx(domains, mx), ips))
    assert got == [("a", "m1", "1", True), ("a", "m1", "2", True), ("b", "m1", "1", False), ("b", "m1", "2", False), ("b", "m2", None, None), ("c", None, None, None)]


MTA = "domain string, pos bigint, mx string, ip string, has_dane boolean, " + ", ".join(f"{f} boolean" for f in [*dims.TLS_FLAGS, *sc.AUTH_FLAGS])


def server(domain, pos, mx="m.op.net", ip="1", dane=True, tls=(False, False, False, False, True, True), auth=(None,) * 5):
    return (domain, pos, mx, ip, dane, *tls, *auth)


def test_domain_roll_up(spark, rows):
    data = [
        server("a", 1, "m2", dane=True), server("a", 2, "m1", dane=False, auth=(True, False, None, None, True)), server("a", 3, None, dane=None, auth=(False,) * 5),
        server("b", 1, dane=None), server("c", 1, dane=True), server("c", 2, dane=None, auth=(None, None, True, True, None)),
    ]
    frame = spark.createDataFrame(data, MTA)
    assert rows(sc.domain_security(frame)) == [
        ("a", False, True, True, False, False, False, True, True),
        ("b", False, False, False, False, False, False, False, True),
        ("c", True, True, False, False, True, True, False, True),
    ]
    assert rows(sc.domain_mx_records(frame))[0] == ("a", ["m1", "m2"])


def test_attach_and_override(spark, rows):
    ent = spark.createDataFrame([("ch", "1", "a"), ("ch", "2", "zzz"), ("ch", "3", "")], "country string, code string, domain string")
    dsec = spark.createDataFrame([("a", False, True, False, False, False, False, False, True)], "domain string, dane_supported boolean, dane_partial boolean, " + ", ".join(f"{f} boolean" for f in sc.AUTH_FLAGS) + ", scan_valid boolean")
    sec = sc.attach_security(ent, dsec)
    assert rows(sec, "code", "has_spf", "scan_valid") == [("1", False, True), ("2", None, False), ("3", None, False)]
    ov = spark.createDataFrame(
        [("ch", "1", None, None, True, None, None, None, None, "s"), ("ch", "2", True, None, True, None, None, None, None, "s"), ("ch", "3", None, None, True, None, None, None, None, None)],
        "country string, code string, dane_supported boolean, dane_partial boolean, " + ", ".join(f"{f} boolean" for f in sc.AUTH_FLAGS) + ", source string",
    )
    assert rows(sc.apply_security_overrides(sec, ov), "code", "has_spf", "dane_partial", "scan_valid") == [("1", True, True, True), ("2", None, None, True), ("3", None, None, False)]


def test_server_analyses(spark, rows):
    old, none = (False, False, True, False, False, False), (False,) * 6
    data = [
        server("a", 1, "x.op1.net"), server("a", 2, "y.op1.net", tls=old), server("b", 1, "x.op1.net"), server("c", 1, "x.op2.net", tls=none, dane=False),
        server("d", 1, None, None), server("e", 1, "q.op3.net", None, dane=None), server("f", 1, "x.op2.net", dane=None), server("f", 2, "x.op2.net"),
    ]
    frame = spark.createDataFrame(data, MTA)
    valid = sc.valid_mta(frame)
    assert rows(mt.domain_counts(frame)) == [(6, 1, 1)]
    assert rows(mt.validity_classes(frame)) == [(3, 1, 0)]
    modes = {(r.mode, r.version): r.n for r in mt.tls_modes(valid).collect()}
    assert modes[("max_all", "TLS1")] == 1 and modes[("max_any", "TLS1_3")] == 3 and modes[("min_all", "NO_STARTTLS")] == 1 and modes[("min_any", "TLS1")] == 1
    assert rows(mt.mixed_tls(valid)) == [("a", True, True)]
    assert rows(mt.secure_domains(valid)) == [("b",), ("f",)]
    assert rows(mt.operator_domains(valid)) == [("op1.net", 2), ("op2.net", 2)]
    assert rows(mt.mx_count(frame)) == [(5,)]


@pytest.mark.parametrize("sizes, share", [([5, 3, 2], 0.5), ([1] * 10, 0.5), ([4, 4, 4, 1, 1], 0.5), ([7], 0.9), ([3, 3, 2, 2, 2, 1], 0.7)])
def test_concentration_equals_prefix_sums(spark, sizes, share):
    frame = spark.createDataFrame([(f"o{i}", n) for i, n in enumerate(sizes)], "operator string, domains bigint")
    prefix, total = [0], sum(sizes)
    for n in sorted(sizes, reverse=True):
        prefix.append(prefix[-1] + n)
    want = sum(1 for p in prefix if p < total * share)
    assert mt.concentration(frame, share).first()[0] == want
    top = mt.top_operators(frame, share)
    assert top.count() == want
    ranks = sorted(r["rank"] for r in top.collect())
    assert ranks == list(range(1, want + 1))


def test_chi_square(spark):
    data = [("de-based", False)] * 30 + [("de-based", True)] * 10 + [("us-cloud", False)] * 20 + [("us-cloud", True)] * 40
    frame = spark.createDataFrame([(True, c, f, False, False, False, False) for c, f in data], "scan_valid boolean, category string, has_spf boolean, has_good_spf boolean, has_dmarc boolean, has_good_dmarc boolean, dane_supported boolean")
    got = {r.metric: r for r in st.chi_square_provider(frame).collect()}
    assert math.isclose(got["has_spf"].chi2, 15.0417, rel_tol=1e-4)
    assert math.isclose(got["has_spf"].p, math.erfc(math.sqrt(got["has_spf"].chi2 / 2)), rel_tol=1e-9)
    assert (got["has_good_spf"].chi2, got["has_good_spf"].p, got["has_good_spf"].dof) == (0.0, 1.0, 1)
    xs = [0.0, 0.01, 1.0, 3.9, 7.9, 8.1, 30.0, 200.0]
    values = spark.createDataFrame([(x,) for x in xs], "x double").select(st.p_value(F.col("x"))).collect()
    assert all(math.isclose(v[0], math.erfc(math.sqrt(x / 2)), rel_tol=1e-6) for v, x in zip(values, xs))


def test_accuracy_report(spark):
    counts = {("microsoft", "microsoft"): 83, ("microsoft", "self-hosted"): 4, ("google", "google"): 8, ("google", "self-hosted"): 2}
    pairs = [k for k, n in counts.items() for _ in range(n)] + [(None, "google")] * 3
    r = st.classification_metrics(spark.createDataFrame(pairs, "truth string, predicted string"), ["microsoft", "google", "self-hosted"]).first()
    assert (r.sent, r.replies) == (100, 97) and math.isclose(r.accuracy, 91 / 97)
    classes = {x.label: x for x in st.class_metrics(st.confusion(spark.createDataFrame(pairs, "truth string, predicted string"))).collect()}
    assert math.isclose(classes["microsoft"].recall, 83 / 87) and classes["google"].precision == 1.0


def test_contradictions(spark, rows):
    p = spark.createDataFrame([("ch", str(i), "n", "r", "d.ch", "microsoft") for i in range(4)], "country string, code string, name string, region string, domain string, provider string")
    s = [("0", 0, "mx", "microsoft", 0.2), ("0", 1, "spf", "google", 0.2), ("1", 0, "mx", "microsoft", 0.2), ("1", 1, "dkim", "google", 0.15), ("2", 0, "mx", "microsoft", 0.2),
         ("2", 1, "spf", "microsoft", 0.2), ("2", 2, "spf", "google", 0.2), ("3", 0, "mx", "microsoft", 0.2), ("3", 1, "tenant", "google", 0.1), ("1", 2, "dkim", "google", 0.15)]
    signals = spark.createDataFrame([("ch", *x) for x in s], "country string, code string, pos int, kind string, provider string, weight double")
    assert rows(qc.check_contradictory(p, signals), "code", "severity", "message") == [
        ("0", "ERROR", "winner=microsoft (google=0.20 vs microsoft=0.20)"), ("1", "WARNING", "winner=microsoft (microsoft=0.20 vs google=0.15)"),
    ]


def test_first_log_of_a_target_counts(spark):
    tls = [("m", "1", 1, "PROTOS_OFFERED: tls1_2:yes"), ("m", "1", 0, "PROTOS_OFFERED: tls1_3:yes")]
    dane = [("m", 5, "## Checking m 1 port 25\nResult: DANE OK"), ("m", 2, "x\n\n## Checking m 1 port 25\nResult: none\n\n## Checking m 2 port 25\nResult: DANE OK")]
    dss = [("a.ch", 1, "spf: v=spf1 -all"), ("a.ch", 0, "spf: v=spf1 ~all")]
    addresses = spark.createDataFrame([("a.ch", "m", "1", True), ("a.ch", "m", "2", True), ("a.ch", "m", "3", True)], "domain string, mx string, ip string, ad boolean")
    for turn in (1, -1):  # whatever the order of arrival
        frames = [
            spark.createDataFrame(tls[::turn], "host string, ip string, pos int, log string"), spark.createDataFrame(dane[::turn], "host string, pos int, log string"),
            spark.createDataFrame(dss[::turn], "domain string, pos int, log string"),
        ]
        got = {r.ip: (r.has_dane, r.has_tls1_3, r.has_tls1_2, r.has_good_spf) for r in sc.build_mta(addresses, *frames).collect()}
        assert got == {"1": (False, True, False, False), "2": (True, None, None, False), "3": (False, None, None, False)}


def test_third_party_results_by_country_and_last_row(spark):
    entity = spark.createDataFrame([("ch", "00000001", "a.ch"), ("de", "00000001", "a.de"), ("ch", "00000002", "b.ch")], "country string, code string, domain string")
    columns = "country string, pos int, code string, mxrecordName string, emails string, hasDane string, hasSpf string, hasGoodSpf string, hasDmarc string, hasGoodDmarc string"
    row = lambda cc, pos, code, dane: (cc, pos, code, "mx", "e", dane, "1", "0", "0", "0")
    flat = spark.createDataFrame([row("ch", 1, "1", "0"), row("ch", 0, "1", "1"), row("de", 0, "1", "1")], columns)
    got = sorted((r.country, r.code, r.dane_supported, r.scan_valid) for r in sc.convert_flat_result(entity, flat, 8).collect())
    assert got == [("ch", "00000001", False, True), ("ch", "00000002", None, False), ("de", "00000001", True, True)]


def test_the_largest_operators_read_the_servers_once(spark, rows):
    """Equal to all rows joined one by one; sizes are written, so the plan reads the servers for their versions alone."""
    from mailposture.session import store

    flags = "has_sslv2 boolean, has_sslv3 boolean, has_tls1 boolean, has_tls1_1 boolean, has_tls1_2 boolean, has_tls1_3 boolean"
    mta = [("a", "m1.x.net", "1", False, False, False, False, True, False), ("a", "m1.x.net", "1", False, False, False, False, False, True)]
    mta += [("b", "m2.x.net", "2", False, False, True, False, True, False), ("c", "m1.y.net", "1", False, False, False, False, False, False), ("d", None, None, *[False] * 6)]
    servers = store(spark.createDataFrame(mta, f"domain string, mx string, ip string, {flags}"))
    dane = spark.createDataFrame([("m1.x.net", "1", True), ("m2.x.net", "3", True)], "mx string, ip string, mx_dane boolean")
    found = mt.top_operator_detail(servers, dane, 0.9)
    assert rows(found) == [("x.net", False, True, "TLS1_2", "TLS1_3", "TLS1_3", "TLS1"), ("y.net", False, False, *["NO_STARTTLS"] * 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert len([line for line in plan if "Relation" in line and "has_sslv2" in line]) == 1


def test_server_queries_write_the_server_rows(spark):
    from mailposture.plans import security as plans
    from mailposture.plans.tables import Tables

    for job in (plans.top_operator_detail, plans.run_evaluation, plans.dane_support_mx, plans.build_mta):
        t = Tables(spark, "/root/testdata/sf0.001")
        job(t)
        assert "v_mta" in t._stored
