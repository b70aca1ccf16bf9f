import hashlib

import duckdb
from pyspark.sql import functions as F

from mailposture.llm import queries, warc_fixity

SF = "/root/testdata/sf0.1"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_finds_changed_missing_and_extra_records(spark):
    one = [(k, f"u{k}", f"body é {k}") for k in range(0, 700, 3)]
    two = [(i, u, b + "!" if i == 300 else b) for i, u, b in one if i != 30] + [(31, "new", None), (699, "u", "x")]
    got = warc_fixity.audit(warc_fixity.leaves(pages(spark, one), slots=64), warc_fixity.leaves(pages(spark, two), slots=64), slots=64, fanout=4).collect()
    assert sorted((r.volume * 64 + r.slot, r.kind) for r in got) == [(30, "missing"), (31, "extra"), (300, "changed"), (699, "changed") if (699, "u699", "body é 699") in one else (699, "extra")]
    row = next(r for r in got if r.kind == "missing")

    def bytes_of(i, u, b):
        body = b.encode()
        return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, u.encode(), len(body), body)

    assert row.offset == sum(len(bytes_of(*r)) for r in one if r[0] < 30) and row.length == len(bytes_of(*next(r for r in one if r[0] == 30)))
    assert row.digest_one == hashlib.sha256(bytes_of(*next(r for r in one if r[0] == 30))).hexdigest()


def test_equal_replicas_repeats_and_nulls(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, None, None), (None, "n", ""), (5, "e", "")]
    leaf = lambda r: warc_fixity.leaves(pages(spark, r).withColumn("slot", F.lit(9)))
    assert warc_fixity.audit(leaf(rows), leaf(rows[::-1])).count() == 0
    assert [(r.slot, r.kind) for r in warc_fixity.audit(leaf(rows), leaf(rows[1:])).collect()] == [(1, "changed")]
    assert warc_fixity.audit(leaf(rows).limit(0), leaf(rows).limit(0)).count() == 0


def test_damage_among_repeated_ids(spark):
    """Pairs that change alike do not cancel, the order of repeats does not matter; a very long body."""
    leaf = lambda bodies: warc_fixity.leaves(pages(spark, [(4, "u", b) for b in bodies] + [(9, "v", "long " * 400_000)]))
    assert [(r.slot, r.kind) for r in warc_fixity.audit(leaf("abbc"), leaf("addc")).collect()] == [(4, "changed")]
    assert [(r.slot, r.kind) for r in warc_fixity.audit(leaf("abbc"), leaf("abc")).collect()] == [(4, "changed")]
    assert warc_fixity.audit(leaf("abbc"), leaf("cbab")).count() == 0


def test_only_branches_that_differ_are_compared(spark):
    levels = warc_fixity.tree(warc_fixity.leaves(pages(spark, [(k, "u", str(k)) for k in range(256)]), slots=256), slots=256, fanout=16)
    assert [level.count() for level in levels] == [256, 16, 1]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    result = con.execute(queries.SQL["op3_warc_fixity"])
    names = [c[0] for c in result.description]
    want = sorted(result.fetchall())
    got = sorted(map(tuple, queries.RUN["op3_warc_fixity"](spark, SF).select(*names).collect()))
    assert got == want and len(got) > 20
