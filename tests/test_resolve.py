from pyspark.sql import functions as F

from mailposture.operators import candidates as cd
from mailposture.operators import decide as de
from mailposture.session import discard, step
from mailposture.sources import registries as rg

ENTITY = "country string, code string, name string, region string, override_domain string, override_name string, website_domain string"
CAND = "country string, code string, pos bigint, domain string, source string, is_email_domain boolean"
OV = "code string, email_domain string, website string, name string, canton string"


def entity(spark, *data):
    return spark.createDataFrame([(cc, code, name, region, ov, None, None) for cc, code, name, region, ov in data], ENTITY)


def test_collect_ch(spark, rows):
    bfs = spark.createDataFrame([("1", "Zürich", "Kanton Zürich"), ("2", "Bern", ""), ("3", "Ohne", "")], "code string, name string, canton string")
    plz = spark.createDataFrame([("2", "Kanton Bern")], "code string, canton string")
    bindings = spark.createDataFrame(
        [("1", "x", "https://www.Stadt-Zuerich.ch", "l"), ("3", "y", "http://gmail.com", "Kanton Uri"), ("8", "z", "http://z.ch", "l")], "code string, name string, website string, cantonLabel string"
    )
    ov = spark.createDataFrame([("1", "zuerich.ch", "old.ch", None, None), ("2", None, None, "Neu", "Kanton Jura"), ("9", None, None, "Only", None)], OV)
    ent, cand = cd.collect_ch(bfs, plz, bindings, ov)
    assert rows(ent, "code", "name", "region", "override_domain", "override_name", "website_domain") == [
        ("1", "Zürich", "Kanton Zürich", "zuerich.ch", None, "stadt-zuerich.ch"),
        ("2", "Bern", "Kanton Jura", "", "Neu", None),
        ("3", "Ohne", "Kanton Uri", None, None, None),
        ("9", "Only", "", "", None, None),
    ]
    assert rows(cand, "code", "domain", "source") == [("1", "stadt-zuerich.ch", "wikidata")]


def test_mail_list_by_name_and_region(spark, rows):
    ent = entity(spark, ("de", "01", "Flensburg", "Schleswig-Holstein", None), ("de", "02", "Dorf", "Bayern", None), ("de", "03", "Dorf", "Hessen", None))
    mails = spark.createDataFrame(
        [("flensburg", "web.de", "", 0), ("flensburg", "flensburg.de", "", 1), ("dorf", "dorf-he.de", "Hessen", 2), ("dorf", "dorf.de", "", 3), ("dorf", "x.de", "Saarland", 0)],
        "name_key string, domain string, region string, pos bigint",
    )
    assert rows(cd.match_by_name(ent, mails, ["web.de"])) == [("01", "flensburg.de"), ("02", "dorf.de"), ("03", "dorf-he.de")]


def test_guesses(spark, rows):
    ent = entity(
        spark, ("de", "1", "Bad Ort", "x", None), ("ch", "2", "Twann/Tüscherz", "Kanton Bern", None), ("at", "3", "Wien", "Wien", None), ("de", "4", "X", "", "a.de"), ("de", "5", "Y", "", None)
    )
    cand = spark.createDataFrame([("de", "5", 0, "y.de", "wikidata", False), ("at", "3", 0, "wien.gv.at", "guess", False)], CAND)
    made = cd.add_guesses(ent, cand).filter("source = 'guess'")
    per = {}
    for r in made.collect():
        per.setdefault(r.code, set()).add(r.domain)
    assert {"bad-ort.de", "badort.de", "stadt-bad-ort.de", "bad-ort-online.de"} <= per["1"] and len(per["1"]) == 18
    assert {"twann.ch", "tuescherz.ch", "twann-tuescherz.ch", "twann.be.ch", "be-twann.ch", "twannbe.ch", "comune-di-twann.ch"} <= per["2"]
    assert {"wien.at", "wien.gv.at", "wien.wien.gv.at", "marktgemeinde-wien.at"} <= per["3"]
    assert "4" not in per and "5" not in per
    gov = cd.gov_guesses(ent.filter("country = 'at'"), cand)
    assert gov.count() == 0


def test_prefilter_and_status(spark, rows):
    cand = spark.createDataFrame([("de", "1", i, d, "guess", m) for i, (d, m) in enumerate([("a.de", False), ("b.de", False), ("c.de", True), ("d.de", False)])], CAND)
    dns = spark.createDataFrame([("a.de", True), ("b.de", False), ("www.b.de", True), ("d.de", False)], "name string, resolves boolean")
    assert rows(cd.dns_prefilter(cand, dns), "domain") == [("a.de",), ("b.de",), ("c.de",)]
    fetch = spark.createDataFrame(
        [("a.de", 0, 404, "https://www.a.de", True), ("a.de", 1, 200, "https://neu.de/x", False), ("b.de", 0, 200, "https://www.b.de/", True), ("c.de", 0, None, None, False)],
        "domain string, prefix_order int, status int, final_url string, ssl_failed boolean",
    )
    assert rows(cd.http_status(fetch)) == [("a.de", True, "neu.de", False), ("b.de", True, None, True), ("c.de", False, None, False)]


def decide_one(spark, ent, cand=(), scraped=(), redirect=(), mx=(), parked=()):
    e = entity(spark, ent)
    c = spark.createDataFrame([(ent[0], ent[1], i, d, s, m) for i, (d, s, m) in enumerate(cand)], CAND)
    s = spark.createDataFrame([(ent[0], ent[1], "site", d) for d in scraped], "country string, code string, site string, email_domain string")
    h = spark.createDataFrame(list(redirect), "domain string, redirect string")
    m = spark.createDataFrame([(d, True) for d in mx], "domain string, has_mx boolean")
    p = spark.createDataFrame([(d, "parked") for d in parked], "domain string, flag string")
    pools = de.build_pools(e, c, s, h, m, p)
    d = de.decide(e, c, pools, m)
    emails = de.chosen_emails(d, de.rank_emails(pools, e)).orderBy("rank").collect()
    r = d.first()
    return [x.domain for x in emails], r.source, r.confidence, r.flag


def test_decision_cascade(spark):
    ent = ("ch", "1", "Baden", "Kanton Aargau", None)
    ov = lambda d: ("ch", "1", "Baden", "Kanton Aargau", d)
    assert decide_one(spark, ov("x.ch"), mx=["x.ch"]) == (["x.ch"], "override", "high", "")
    assert decide_one(spark, ov("x.ch")) == (["x.ch"], "override", "medium", "no_mx")
    assert decide_one(spark, ov(""), scraped=["baden.ch"], mx=["baden.ch"]) == ([], "override", "none", "")
    assert decide_one(spark, ent, scraped=["baden.ch", "gmail.com", "nomx.ch"], mx=["baden.ch", "gmail.com"]) == (["baden.ch"], "scrape", "high", "")
    static = [("agency.ch", "wikidata", False)]
    assert decide_one(spark, ent, static, ["baden.ch"], mx=["agency.ch", "baden.ch"])[:2] == (["baden.ch"], "scrape")
    assert decide_one(spark, ent, static, mx=["agency.ch"]) == (["agency.ch"], "wikidata", "medium", "unverified")
    assert decide_one(spark, ent, [("gemeinde-baden.ch", "livenson", True)], mx=["gemeinde-baden.ch"]) == (["gemeinde-baden.ch"], "static", "high", "")
    twice = [("agency.ch", "bresu", False), ("agency.ch", "wikidata", False)]
    assert decide_one(spark, ent, twice, mx=["agency.ch"]) == (["agency.ch"], "static", "high", "")
    assert decide_one(spark, ent, [("ag.ch", "wikidata", False)], mx=["ag.ch"]) == (["ag.ch"], "wikidata", "high", "")
    assert decide_one(spark, ent, [("baden.ch", "guess", False)], mx=["baden.ch"]) == (["baden.ch"], "guess", "low", "guess_only")
    assert decide_one(spark, ent, static, mx=["agency.ch"], parked=["agency.ch"]) == ([], "none", "none", "")
    assert decide_one(spark, ent) == ([], "none", "none", "")
    moved = decide_one(spark, ent, static, redirect=[("agency.ch", "stadt-baden.ch")], mx=["stadt-baden.ch"])
    assert moved == (["stadt-baden.ch"], "scrape", "high", "")


def test_order_of_preference(spark):
    ent = ("at", "1", "Wien", "Wien", None)
    names = ["wien.at", "abc.gv.at", "wien.gv.at", "zzz.at", "aaa.at"]
    emails = decide_one(spark, ent, [(n, "bresu", False) for n in names], mx=names)[0]
    assert emails == ["wien.gv.at", "abc.gv.at", "wien.at", "aaa.at", "zzz.at"]
    ent = ("ch", "1", "Baden", "Kanton Aargau", None)
    names = ["ag.ch", "x.long.ch", "zz.ch", "mail.baden.ch", "baden.ch"]
    assert decide_one(spark, ent, [(n, "wikidata", False) for n in names], mx=names)[0] == ["baden.ch", "mail.baden.ch", "zz.ch", "x.long.ch", "ag.ch"]


def test_blocklist_and_layers(spark, rows):
    scraped = [("ch", str(i), "s", "isp.ch") for i in range(6)] + [("ch", "1", "s", "rare.ch"), ("ch", "0", "s", "baden.be"), ("ch", "0", "s", "baden.ch"), ("ch", "1", "s2", "isp.ch")]
    frame = spark.createDataFrame(scraped, "country string, code string, site string, email_domain string")
    block = de.frequency_blocklist(frame)
    assert rows(block) == [("ch", "isp.ch", 6)]
    ent = entity(spark, *[("ch", str(i), "Baden" if i == 0 else "Ort", "Kanton Bern", None) for i in range(6)])
    cand = spark.createDataFrame([("ch", "2", 0, "isp.ch", "wikidata", False)], CAND)
    pool = frame.select("country", "code", F.col("email_domain").alias("domain")).distinct()
    kept = de.filter_pool(de.with_affinity(pool, ent, cand, block))
    assert rows(kept, "code", "domain") == [("0", "baden.ch"), ("2", "isp.ch")]


def test_website(spark, rows):
    ent = spark.createDataFrame([("ch", "1", "A", "", None, None, "a.ch"), ("ch", "2", "B", "", None, None, "dead.ch"), ("ch", "3", "C", "", None, None, None)], ENTITY)
    cand = spark.createDataFrame([("ch", "2", 0, "dead.ch", "x", False), ("ch", "2", 1, "b.ch", "x", False), ("ch", "2", 2, "b2.ch", "x", False)], CAND)
    http = spark.createDataFrame([("a.ch", True, "neu.ch"), ("b.ch", True, None), ("b2.ch", True, None), ("dead.ch", False, None)], "domain string, accessible boolean, redirect string")
    assert rows(de.set_website(ent, cand, http), "code", "website") == [("1", "neu.ch"), ("2", "b.ch"), ("3", None)]


def test_hierarchy(spark, rows):
    units = spark.createDataFrame(
        [(100, 1, 1, None, "Zürich", "ZH"), (200, 11, 2, 100, "Bezirk", "B"), (300, 261, 3, 200, "Zürich", "Z"), (301, 262, 3, 100, "Direkt", "D"), (302, 263, 3, 999, "Lost", "L"), (303, 264, 3, None, "Top", "T")],
        "hist int, bfs int, level int, parent int, name string, short string",
    )
    assert rows(rg.resolve_hierarchy(units)) == [("261", "Zürich", "Kanton Zürich"), ("262", "Direkt", "Kanton Zürich"), ("263", "Lost", ""), ("264", "Top", "")]


def test_a_filter_on_the_flags_does_not_split_names_again(spark):
    frame = spark.createDataFrame([("ch", "1", "s", "baden.ch")], "country string, code string, site string, email_domain string")
    pool = frame.select("country", "code", F.col("email_domain").alias("domain"))
    cand = spark.createDataFrame([("ch", "1", 0, "baden.ch", "wikidata", False)], CAND)
    kept = de.filter_pool(de.with_affinity(pool, entity(spark, ("ch", "1", "Baden", "Kanton Bern", None)), cand, de.frequency_blocklist(frame)))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "substring_index" not in plan
    assert [r.domain for r in kept.collect()] == ["baden.ch"]


def pool_inputs(spark):
    e = entity(spark, ("ch", "1", "Baden", "Kanton Aargau", None), ("ch", "2", "Ort", "Kanton Bern", None))
    c = spark.createDataFrame([("ch", "1", 5, "agency.ch", "wikidata", False), ("ch", "1", 3, "agency.ch", "guess", False), ("ch", "2", 1, "ort.ch", None, False)], CAND)
    s = spark.createDataFrame([("ch", "1", "s", "baden.ch"), ("ch", "1", "t", "baden.ch"), ("ch", "2", "s", None)], "country string, code string, site string, email_domain string")
    h = spark.createDataFrame([("ort.ch", "neu-ort.ch"), ("agency.ch", "gone.ch")], "domain string, redirect string")
    m = spark.createDataFrame([(d, d != "gone.ch") for d in ("agency.ch", "baden.ch", "ort.ch", "neu-ort.ch", "gone.ch")], "domain string, has_mx boolean")
    return e, c, s, h, m, spark.createDataFrame([], "domain string, flag string")


def test_pools_leave_only_the_tables_they_read(spark, rows, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr("mailposture.session.shared_folder", lambda spark: str(tmp_path))
    pools = de.build_pools(*pool_inputs(spark), made=made)
    assert {p.name for p in tmp_path.iterdir()} == {f.stored_at.rsplit("/", 1)[1] for f in made}
    expected = [("ch", "1", "guess", "agency.ch"), ("ch", "1", "scraped", "baden.ch"), ("ch", "1", "static", "agency.ch"), ("ch", "2", "static", "ort.ch")]
    assert rows(pools) == expected
    discard(*made)
    assert not [*tmp_path.iterdir()]


def test_pools_carry_sources_and_keys(spark, rows):
    e, c, *rest = pool_inputs(spark)
    plain = de.build_pools(e, c, *rest)
    carried = step(de.preference(de.build_pools(e, c, *rest, sources=True), e))
    assert rows(de.decide(e, c, carried, rest[2])) == rows(de.decide(e, c, plain, rest[2]))
    keys = ("code", "pool", "domain", "rank")
    assert rows(de.rank_emails(carried, e), *keys) == rows(de.rank_emails(plain, e), *keys)
    # Neither the entities nor the candidates are joined again.
    plan = de.rank_emails(carried, e)._jdf.queryExecution().optimizedPlan().toString()
    assert "override_name" not in plan and "slugs" not in plan
    assert "is_email_domain" not in de.decide(e, c, carried, rest[2])._jdf.queryExecution().optimizedPlan().toString()


def test_a_repeated_row_of_the_pool_stays_and_null_is_no_candidate(spark, rows):
    pool = spark.createDataFrame([("ch", "1", "a.ch"), ("ch", "1", "a.ch"), ("ch", "1", None), ("ch", "1", "b.ch")], "country string, code string, domain string")
    cand = spark.createDataFrame([("ch", "1", 0, "a.ch", "x", False), ("ch", "1", 0, None, "x", False), ("ch", "1", 0, "c.ch", "x", False)], CAND)
    assert rows(de.mark_candidates(pool, cand), "domain", "is_candidate") == [(None, False), ("a.ch", True), ("a.ch", True), ("b.ch", False)]


def test_first_source_of_a_candidate_without_a_position(spark, rows):
    cand = spark.createDataFrame([("ch", "1", 1, "a.ch", "wikidata", False), ("ch", "1", None, "a.ch", "guess", False), ("ch", "1", 2, "a.ch", None, False), ("ch", "1", None, "b.ch", None, False)], CAND)
    assert rows(de.find_source(cand), "domain", "source", "n_sources") == [("a.ch", "guess", 2), ("b.ch", "static", 0)]


def test_sources_detail_skips_null_domains(spark):
    cand = spark.createDataFrame([("ch", "1", 1, "b.ch", "x", False), ("ch", "1", 2, "a.ch", "x", False), ("ch", "1", 3, "a.ch", "x", False), ("ch", "1", 4, None, "y", False)], CAND)
    assert de.sources_detail(cand).first().sources_detail == {"x": ["a.ch", "b.ch"], "y": []}
