import pytest
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions import labels, names, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "url, domain",
    [
        ("https://www.Example.ch/path", "example.ch"), ("example.ch", "example.ch"), ("http://user@a.b.de:8080?x", "a.b.de"), ("", None),
        ("//x.ch/y", None), ("https://sub.www.ch", "sub.www.ch"), ("www.a.ch/kontakt", "a.ch"),
    ],
)
def test_url_domain(spark, url, domain):
    assert one(spark, text.url_domain, url) == (domain if domain != "x" else None)


@pytest.mark.parametrize("value, out", [(" www.a.ch ", "a.ch"), ("https://www.a.ch/x", "a.ch"), ("a.ch", "a.ch")])
def test_normalize_domain(spark, value, out):
    assert one(spark, text.normalize_domain, value) == out


@pytest.mark.parametrize(
    "address, ok",
    [
        ("info@a.ch", True), ("logo@2x.png", False), (".a@b.ch", False), ("a..b@c.ch", False), ("a@b", False), ("a@-b.ch", False),
        ("a@b.localhost", False), ("x" * 65 + "@b.ch", False), ("a+b@c-d.co.at", True), ("@b.ch", False), ("a@b.1", False),
    ],
)
def test_valid_email(spark, address, ok):
    assert one(spark, text.is_valid_email, address) is ok


def test_homepage_classes(spark):
    assert one(spark, text.classify_homepage, "This domain is parked") == "parked"
    assert one(spark, text.classify_homepage, "Coming soon: GEMEINDE x") == "has_municipality_keywords"
    assert one(spark, text.classify_homepage, "hello") == "no_municipality_keywords"


def test_asn_answer(spark):
    df = spark.createDataFrame([("8075 | 1.2.0.0/16 | US | arin |",), ("x | y | CH",), ("1 | 2",), (" 64 | p |  De ",)], "t string")
    got = [tuple(r) for r in df.select(text.asn_number(F.col("t")), text.asn_country(F.col("t"))).collect()]
    assert got[0] == (8075, "us") and got[1][0] is None and got[2][0] is None and got[3] == (64, "de")


def test_to_bool(spark):
    df = spark.createDataFrame([("WAHR",), ("FALSCH",), ("0",), (None,), ("None",), ("ja",)], "t string")
    assert [r[0] for r in df.select(text.to_bool(F.col("t"))).collect()] == [True, False, False, False, False, True]


def test_spf_delegations_and_hosts(spark):
    assert one(spark, text.spf_delegations, "v=spf1 include:a.de redirect=b.ch include:c.at") == ["a.de", "c.at", "b.ch"]
    vendor = lambda c: text.classify_host(c, [".ch"])
    assert tuple(one(spark, vendor, "x.mail.protection.outlook.com")) == ("Microsoft", "hyperscaler")
    assert tuple(one(spark, vendor, "mx.Sendgrid.net")) == ("SendGrid", "foreign")
    assert tuple(one(spark, vendor, "_spf.cyon.net")) == ("cyon.net", "domestic")
    assert tuple(one(spark, vendor, "mx.gemeinde.ch")) == ("gemeinde.ch", "domestic")
    assert tuple(one(spark, vendor, "mx.foo.org")) == ("foo.org", "unknown")


@pytest.mark.parametrize(
    "kind, detail, short",
    [
        ("mx", "MX a.b.c matches google", "a.b.c"), ("asn", "ASN 12 registered in CH", "AS12"), ("spf_ip", "SPF ip4/a ASN 7 matches aws", "AS7"),
        ("autodiscover", "autodiscover CNAME → x.y", "→ x.y"), ("autodiscover", "autodiscover SRV → x.y", "SRV → x.y"), ("tenant", "other", "other"),
        ("dkim", "DKIM selector1._domainkey.a.ch CNAME → s1._domainkey.b.onmicrosoft.com", "selector1 → b.onmicrosoft.com"),
    ],
)
def test_condense_detail(spark, kind, detail, short):
    df = spark.createDataFrame([(kind, detail)], "k string, d string")
    assert df.select(text.condense_detail(F.col("k"), F.col("d"))).first()[0] == short


@pytest.mark.parametrize(
    "cc, name, slugs",
    [
        ("de", "Bad Größ (Ort)", {"bad-groess", "bad-gr", "badgroess"}),
        ("ch", "Saint-Étienne", {"saint-tienne", "saint-etienne", "sainttienne", "saintetienne"}),
        ("ch", "Uetikon am See", {"uetikon-am-see", "uetikonamsee"}),
        ("at", "Neufeld an der Leitha", {"neufeld-an-der-leitha", "neufeldanderleitha", "neufeld-leitha", "neufeld"}),
        ("at", "Sankt Pölten", {"sankt-poelten", "sankt-p-lten", "sanktpoelten", "st-poelten", "st-p-lten", "stpoelten"}),
        ("generic", "L'Abbaye", {"labbaye"}),
    ],
)
def test_slugs(spark, cc, name, slugs):
    assert set(one(spark, lambda c: names.slug_set(c, cc), name)) == slugs


def test_name_match_and_mismatch(spark):
    df = spark.createDataFrame(
        [("Baden", "gemeinde-baden.ch", "ch"), ("Baden", "other.ch", "ch"), ("", "x.ch", "ch"), ("Wien", "wien.gv.at", "at")], "n string, d string, c string"
    )
    got = [r[0] for r in df.select(names.domain_matches_name(F.col("n"), F.col("d"), F.col("c"))).collect()]
    assert got == [True, False, False, True]
    pairs = spark.createDataFrame([("Val Müstair", "cdvm.ch"), ("Val Müstair", "val-muestair.ch"), ("Bad Ort", "stadtort.de"), ("Ort", "")], "n string, d string")
    assert [r[0] for r in pairs.select(names.website_mismatch(F.col("n"), F.col("d"))).collect()] == [True, False, True, False]


def test_strict_match(spark):
    df = spark.createDataFrame(
        [("baden", ""), ("gemeindebaden", ""), ("stadt-baden", ""), ("feuerwehr-baden", ""), ("ag", "baden")], "label string, sub string"
    )
    slugs = F.array(F.lit("baden"))
    assert [r[0] for r in df.select(names.strict_match(slugs, F.col("label"), F.col("sub"))).collect()] == [True, True, True, False, True]


def test_normalize_name(spark):
    assert one(spark, names.normalize_name, "  Königs-Wusterhausen (Stadt) ñé ß") == "koenigs wusterhausen stadt ne ss"


def test_labels(spark):
    df = spark.createDataFrame(
        [("Kanton Appenzell Ausserrhoden", "ch"), ("Bayern", "de"), ("Nowhere", "de"), ("", "at"), ("Mecklenburg-Vorpommern", "de")], "r string, c string"
    )
    r, c = F.col("r"), F.col("c")
    got = [tuple(x) for x in df.select(labels.region_abbr(r, c), labels.region_name(r), labels.region_display(r)).collect()]
    assert got[0] == ("AR", "Appenzell Ausserr.", "Appenzell A.")
    assert got[1] == ("BY", "Bayern", "Bayern") and got[2][0] == "Nowh" and got[3][0] == "??" and got[4][2] == "Meckl.-Vorp."
    assert one(spark, lambda v: labels.region_by_prefix(v, "de"), "09123456") == "Bayern"
    assert one(spark, lambda v: labels.region_by_prefix(v, "at"), "01234") == "??(0)"
    levels = spark.createDataFrame([(75.0,), (50.0,), (25.0,), (24.9,)], "x double").select(labels.confidence_level(F.col("x")))
    assert [x[0] for x in levels.collect()] == ["high", "medium", "low", "insufficient"]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(12.25,), (12.35,)], "n_pct double")
    from mailposture.operators.reports import rounded

    assert [r[0] for r in rounded(df).collect()] == [12.2, 12.4]


def test_label_subdomain_and_weights(spark):
    df = spark.createDataFrame([("baden.gv.at", "gv.at"), ("a.b.ch", "ch"), ("x.invalidtld123", ""), ("ch", "ch")], "d string, suffix string")
    suffix = F.col("suffix")
    got = [tuple(r) for r in df.select(text.registered_label(F.col("d"), suffix), text.subdomain(F.col("d"), suffix)).collect()]
    assert got == [("baden", ""), ("b", "a"), ("invalidtld123", "x"), ("", "")]
    assert abs(sum(dims.WEIGHTS.values()) - 1.0) < 1e-9
