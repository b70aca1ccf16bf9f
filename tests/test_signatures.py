import random

from pyspark.sql import functions as F

from mailposture import dims
from mailposture.operators import evidence as ev
from mailposture.operators import signatures as sg


def expected(texts, signatures):
    """Brute force: (text, least sig, provider)."""
    out = {}
    for text in {t for t in texts if t is not None}:
        for sig, provider, pattern in signatures:
            if pattern and pattern.lower() in text.lower():
                out[text, provider] = min(sig, out.get((text, provider), sig))
    return sorted((t, sig, p) for (t, p), sig in out.items())


def frames(spark, texts, signatures):
    return spark.createDataFrame([(t, 1) for t in texts], "host string, n int"), spark.createDataFrame(signatures, "sig int, provider string, pattern string")


def test_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcA.é") for _ in range(n))
    signatures = [(rng.randrange(40), f"p{rng.randrange(30)}", word(rng.choice([1, 2, 3, 5, 6, 7, 9, 14]))) for _ in range(400)] + [(1, "p1", None), (2, "p2", ""), (3, "all", ".")]
    texts = [word(rng.randrange(60)) for _ in range(300)] + [s[2] for s in signatures[:50]] + [None, "", "a" * 20_000, "A"] * 2
    df, table = frames(spark, texts, signatures + signatures[:20])
    assert sorted(tuple(r) for r in sg.matches(df, "host", table).collect()) == expected(texts, signatures)


def test_empty_sides(spark):
    df, table = frames(spark, ["a.b"], [(0, "p", "a")])
    assert sg.matches(df.limit(0), "host", table).count() == 0 and sg.matches(df, "host", table.limit(0)).count() == 0
    assert [r.flag for r in sg.matched_texts(df, F.col("host"), table.limit(0), "flag").collect()] == [False]


def test_ten_thousand_signatures_without_a_nested_loop(spark, monkeypatch):
    signatures = [(k, f"p{k}", f"mail{k}.provider.example") for k in range(10_000)] + [(10_000, "own", "mx.own")]
    texts = [f"mx.mail{k * 37}.provider.example" for k in range(200)] + ["mx.own.example", "mx.other.example"]
    df, table = frames(spark, texts * 3, signatures)
    plans = []
    monkeypatch.setattr(sg, "store", lambda df, keep=sg.store: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    found = sg.match_rows(df, F.col("host"), table)
    assert len(plans) == 2 and not any("Cartesian" in p or "NestedLoop" in p for p in plans)
    got = sorted((r.host, r.m.sig) for r in found.collect())
    want = [(t, sig) for t, sig, _ in expected(texts, signatures)]
    assert got == sorted(want * 3) and len(got) > 600


def test_rarest_gram_is_the_seed(spark):
    _, table = frames(spark, [], [(k, "p", f"common.{chr(97 + k)}{chr(98 + k)}{chr(99 + k)}zzz") for k in range(20)])
    seeds = sg.seeds(table).collect()
    assert len({r.seed for r in seeds}) == 20 and all(r.size == sg.Q for r in seeds)


def test_evidence_by_table_is_that_of_the_compiled_patterns(spark, rows):
    mx = spark.createDataFrame([("a.ch", "X.mail.protection.outlook.com."), ("b.ch", "aspmx.l.google.com"), ("c.ch", "mx.c.ch"), ("c.ch", "in.awsapps.com"), ("d.ch", None)], "domain string, host string")
    table = sg.signature_table(spark, dims.MX_PATTERNS)
    assert rows(ev.ev_mx(mx, table)) == rows(ev.ev_mx(mx)) and ev.ev_mx(mx, table).count() == 3
