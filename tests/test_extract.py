import base64
import json

import pytest
from pyspark.sql import functions as F

from mailposture.operators import domains as dm
from mailposture.operators import extract as xt

INNER = base64.b64encode(b"gemeinde@t-online.de").decode()
FORM = base64.b64encode(json.dumps({"recipient_email": INNER, "from": INNER}).encode()).decode()


def shift(text, by):
    ranges = [(0x2B, 0x3A), (0x40, 0x5A), (0x61, 0x7A)]
    out = []
    for c in text:
        for lo, hi in ranges:
            if lo <= ord(c) <= hi:
                c = chr(lo + (ord(c) - lo + by) % (hi - lo + 1))
                break
        out.append(c)
    return "".join(out)


CASES = [
    ("<p>info[At]example.de</p>", {"example.de"}),
    ('<img srcset="logo@2x.png 2x">', set()),
    ("<p>a@one.ch b@two.ch c@one.ch</p>", {"one.ch", "two.ch"}),
    ('<script>buildMail("buildM_abc", "info", "chalais.ch","", "" , "");</script>', {"chalais.ch"}),
    ('<a href="mailto:&#105;n&#102;&#111;&#64;ard&#111;&#110;&#46;c&#104;">Contact</a>', {"ardon.ch"}),
    ('<a data-email-link="bWFpbHRvJTNBaW5mbyU0MDM3MTUlMkVjaA==" rel="nofollow">Contact</a>', {"3715.ch"}),
    ('<a href="#">info<span class="none" data-nosnippet="" aria-hidden="true">NULL</span>@example.ch</a>', {"example.ch"}),
    ('<a>mail@<span class="d2" style="display: none;">@@null</span>belmont.ch</a>', {"belmont.ch"}),
    ("<a href='#terssr$onibvf.pu' class='email'>greffe</a>", {"bavois.ch"}),
    ("<p>info@yourcompany.example.com admin@test.example.net x@myexample.com</p>", {"myexample.com"}),
    ("<p>user@something.invalidtld123</p>", set()),
    ('<a data-email-link="not-valid-base64!!!">Contact</a>', set()),
    ('<a data-cfemail="7f161119103f191a0d1e0b1a13511e0b">[email&#160;protected]</a>', {"feratel.at"}),
    ('<span data-cfemail="ZZZZ_not_hex"></span>', set()),
    (f'<input name="form_id" value="{FORM}:abc">', {"t-online.de"}),
    ('<input name="form_id" value="not-base64!!!:hmac">', set()),
    ("a(at)b.ch(at)c.de", {"b.ch", "c.de"}),
    (f"javascript:linkTo_UnCryptMailto('{shift('mailto:info@dorf.ch', 3)}')", {"dorf.ch"}),
    (f"linkTo_UnCryptMailto(%27{shift('mailto:info@stadt.at', -7).replace(',', '%2C')}%27)", {"stadt.at"}),
    (None, set()),
]


def test_every_technique(spark):
    pages = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(CASES)], "id int, html string")
    found = {}
    for r in xt.extract_email_domains(pages, ["id"]).collect():
        found.setdefault(r.id, set()).add(r.domain)
    assert {i: found.get(i, set()) for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}


def test_skip_list_and_suffix_table(spark, rows):
    pages = spark.createDataFrame([(1, "a@gmail.com b@dorf.zz c@x.co.zz")], "id int, html string")
    suffixes = dm.suffix_table(spark, ["zz", "co.zz", "com"])
    assert rows(xt.extract_email_domains(pages, ["id"], ["gmail.com"], suffixes=suffixes), "domain") == [("dorf.zz",), ("x.co.zz",)]


def test_contact_links(spark, rows):
    html = """<a href="/kontakt">x</a><a href='/impressum'>no</a><a href="IT/Comune">x</a><a href="https://www.a.ch/Service?x=1#y">x</a>
    <a href="https://b.ch/kontakt">x</a><a href="/kontakt.pdf">x</a><a href="#kontakt">x</a><a href="mailto:kontakt@a.ch">x</a><a href="/news">x</a>
    <a href="/kontakt%20x">x</a><a href="/redirectEmailLink/kontakt">x</a><A class="z" HREF="/verwaltung/a;p">x</A><a href="ftp://a.ch/kontakt">x</a>"""
    pages = spark.createDataFrame([("www.a.ch", html)], "site string, html string")
    assert rows(xt.discover_links(pages), "path") == [("/IT/Comune",), ("/Service",), ("/kontakt",), ("/verwaltung/a",)]


FETCH = "site string, seq int, url string, final_url string, status int, content_type string, html string"


def page(site, seq, domain, status=200, final=None, kind="text/html"):
    return (site, seq, "", final or f"https://www.{site}/", status, kind, f"<p>x@{domain}</p>")


def test_site_rules(spark, rows):
    down = lambda site, seq: (site, seq, "", None, None, None, None)
    data = [
        page("a.ch", 0, "one.ch"), down("a.ch", 1), down("a.ch", 2), down("a.ch", 3), page("a.ch", 4, "late.ch"),
        page("b.ch", 0, "one.ch"), down("b.ch", 1), down("b.ch", 2), page("b.ch", 3, "two.ch"), down("b.ch", 4), page("b.ch", 5, "three.ch"),
        down("c.ch", 0), page("c.ch", 1, "never.ch"),
        page("d.ch", 0, "agency.ch", final="https://immoscout24.ch/x"), page("d.ch", 1, "own.ch", final="https://immoscout24.ch/y"),
        page("e.ch", 0, "gone.ch", status=404, kind="application/json"), page("e.ch", 1, "kept.ch", status=404), page("e.ch", 2, "k2.ch", final="http://new.ch"),
    ]
    frame = spark.createDataFrame(data, FETCH)
    assert rows(xt.site_emails(frame)) == [
        ("a.ch", "one.ch"), ("b.ch", "one.ch"), ("b.ch", "three.ch"), ("b.ch", "two.ch"), ("d.ch", "own.ch"), ("e.ch", "k2.ch"), ("e.ch", "kept.ch"),
    ]
    assert rows(xt.site_status(frame)) == [("a.ch", True, None), ("b.ch", True, None), ("c.ch", False, None), ("d.ch", True, "immoscout24.ch"), ("e.ch", True, "new.ch")]


SPLIT = {
    "a.gemeinde.gv.at": ("gv.at", "gemeinde", "a"), "x.ch": ("ch", "x", ""), "y.nope": ("", "nope", "y"), "2.wq": ("", "wq", "2"), "herisau.gv.at": ("gv.at", "herisau", ""),
    "herisau.ar.ch": ("ch", "ar", "herisau"), "info.gemeinde.be": ("be", "gemeinde", "info"), "a.b.ck": ("b.ck", "a", ""), "b.ck": ("b.ck", "", ""), "x.www.ck": ("ck", "www", "x"),
    "www.ck": ("ck", "www", ""), "a.b.c.kobe.jp": ("c.kobe.jp", "b", "a"), "city.kobe.jp": ("kobe.jp", "city", ""), "x.CO.uk": ("co.uk", "x", ""), "uk": ("uk", "", ""),
}


def test_split_domain(spark):
    df = spark.createDataFrame([(d,) for d in SPLIT], "domain string")
    assert {r.domain: (r.suffix, r.label, r.sub) for r in dm.split_domain(df, "domain").collect()} == SPLIT
    deep = dm.suffix_table(spark, ["a.b.c.d.e.f", "*.q.w"])
    df = spark.createDataFrame([("x.a.b.c.d.e.f",), ("m.n.q.w",), (None,)], "domain string")
    assert {r.domain: r.suffix for r in dm.split_domain(df, "domain", deep).collect()} == {"x.a.b.c.d.e.f": "a.b.c.d.e.f", "m.n.q.w": "n.q.w", None: ""}


def test_a_missing_suffix_list_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        dm.listed_rules(str(tmp_path / "none.txt"))
    (tmp_path / "some.txt").write_text("// c\nch\n*.ck\n===BEGIN PRIVATE DOMAINS===\nx.com\n")
    assert dm.listed_rules(str(tmp_path / "some.txt")) == ("ch", "*.ck")


def test_the_list_comes_with_the_package_and_the_session_may_name_another(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("pyspark.__file__", str(tmp_path / "nowhere" / "__init__.py"))
    dm.listed_rules.cache_clear()
    assert len(dm.listed_rules()) > 7000 and {"ch", "*.ck", "!www.ck", "gv.at"} <= set(dm.listed_rules())
    (tmp_path / "other.dat").write_text("// own list\nzz   what follows is not read\n\nco.zz\n// ===BEGIN PRIVATE DOMAINS===\nch\n")
    frame = spark.createDataFrame([("a.b.co.zz",), ("a.ch",)], "domain string")
    spark.conf.set(dm.LIST_SETTING, str(tmp_path / "other.dat"))
    try:
        assert {r.domain: r.suffix for r in dm.split_domain(frame, "domain").collect()} == {"a.b.co.zz": "co.zz", "a.ch": ""}
        spark.conf.set(dm.LIST_SETTING, str(tmp_path / "none.dat"))
        with pytest.raises(Exception, match="none.dat"):
            dm.split_domain(frame, "domain").collect()
    finally:
        spark.conf.unset(dm.LIST_SETTING)
    assert {r.domain: r.suffix for r in dm.split_domain(frame, "domain").collect()} == {"a.b.co.zz": "", "a.ch": "ch"}


def test_all_rules_are_joined_once(spark):
    frame = spark.range(1).select(F.lit("a.b.ch").alias("domain"))
    plan = dm.split_domain(frame, "domain")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashJoin") + plan.count("SortMergeJoin") == 1
