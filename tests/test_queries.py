"""Registered queries against their SQL on the smallest test tables; ``check_oracle.py`` runs all of them at any scale."""

import os

import duckdb
import pytest

from check_oracle import rows_of
from mailposture.plans import catalog
from mailposture.plans.tables import BASE
from mailposture.session import SCAN_BYTES, TASK_BYTES, input_bytes, size_tasks, step
from mailposture.skew import flag_join, hot_keys, lookup_join, partitions, rank_groups, rank_in_cells, semi_join
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CHECKED = """
    provider_share classify_domains rule_hits gateway_detect combined_providers merged_regional shared_domains domain_security
    regression_summary chi_square_provider guess_domains filter_pool page_email_domains contact_links latest_observation
""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = catalog.RUN[name](spark, SF)
    result = duck.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_registry_is_complete():
    assert set(catalog.SQL) <= set(catalog.RUN) and len(catalog.RUN) > 150


def test_lookup_join_with_a_hot_key(spark, rows):
    left = spark.range(3000).select((F.col("id") % 7).alias("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    right = left.select("k").distinct().filter("k is not null").withColumn("v", F.length("k"))
    for how in ("left", "inner"):
        assert rows(lookup_join(left, right, ["k"], how)) == rows(left.join(right, ["k"], how).select("k", "id", "v"))


def test_hot_keys_are_cut_by_their_share_of_a_task(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = F.when(F.col("id") < 40_000, F.lit(-1)).when(F.col("id") < 40_500, F.lit(-2)).otherwise(F.col("id"))
    frame = spark.range(100_000).select(keys.alias("k"), F.col("id").alias("v"))
    for n in (parts, 200):
        hot = {r.k: (r._n, r._salts) for r in hot_keys(frame, ["k"], n).collect()}
        assert len(hot) <= 2 * n and hot[-1][0] == 40_000
        for rows_of_key, salts in hot.values():
            assert rows_of_key / salts <= 100_000 / (2 * n) + 1  # half of an even task
        assert (-2 in hot) == (500 > 100_000 / (2 * n))
    salted = lookup_join(frame, frame.select("k").distinct().withColumn("w", F.lit(1)), ["k"])
    assert salted.count() == 100_000
    assert semi_join(frame, frame.filter("v < 50000 and v % 2 = 0"), ["k"]).count() == 45_250
    assert semi_join(frame, frame.filter("v < 50000 and v % 2 = 0"), ["k"], anti=True).count() == 54_750


def test_rank_in_cells_is_row_number(spark):
    from pyspark.sql import Window

    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 501).cast("string").alias("d"))
    order = [F.length("d"), F.col("d")]
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = rank_in_cells(df, ["g"], [F.length("d"), F.substring("d", 1, 1)], [F.col("d")])
    assert sorted(map(tuple, got.select("g", "d", "rank").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["provider_share", "combined_providers"])
def test_plans_read_only_needed_columns(spark, name):
    plan = catalog.RUN[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    scans = [line for line in plan.splitlines() if "ReadSchema" in line and "orders.parquet" in line]
    assert all("o_orderstatus" not in line.split("ReadSchema")[1] for line in scans)


def test_shuffle_tasks_grow_with_the_input(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1000).write.parquet(path)
    assert 1000 < input_bytes(spark, path) < 1 << 20
    size_tasks(spark, input_bytes(spark, path))
    assert partitions(spark.range(1)) == 4
    try:
        size_tasks(spark, 1 << 30)
        grouped = spark.read.parquet(path).groupBy("id").count()
        assert partitions(grouped) == 128 and "hashpartitioning(id" in (plan := grouped._jdf.queryExecution().executedPlan().toString()) and ", 128)" in plan
        assert grouped.count() == 1000
        hot = spark.range(1000).select(F.when(F.col("id") < 500, 0).otherwise(F.col("id")).alias("k"))
        assert [(r.k, r._salts) for r in hot_keys(hot, ["k"]).filter("_n > 10").collect()] == [(0, 128)]
    finally:
        size_tasks(spark, 0)
    assert partitions(spark.range(1)) == 4


def test_tasks_of_jobs_that_fan_out_hold_no_more(spark):
    own = spark.conf.get(SCAN_BYTES)
    try:
        size_tasks(spark, 1 << 30, fan_out=8)
        assert partitions(spark.range(1)) == 1024 and spark.conf.get(SCAN_BYTES) == str(TASK_BYTES)
        size_tasks(spark, 0)
        assert partitions(spark.range(1)) == 4 and spark.conf.get(SCAN_BYTES) == own
        spark.conf.set(SCAN_BYTES, "1m")
        size_tasks(spark, 1 << 30, fan_out=8)
        assert int(spark.conf.get(SCAN_BYTES)) == 1 << 20
        size_tasks(spark, 0)
        assert spark.conf.get(SCAN_BYTES) == "1m"
    finally:
        size_tasks(spark, 0)
        spark.conf.set(SCAN_BYTES, own)


def test_probes_get_tasks_for_the_rows_they_derive(spark, tmp_path, monkeypatch):
    from mailposture import session
    from mailposture.plans import providers
    from mailposture.plans.tables import Tables

    d, n = str(tmp_path), 300
    key = F.col("id")
    orders = spark.range(n).select(
        key.alias("o_orderkey"), (key % 40).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (key * 1.5).alias("o_totalprice"),
        F.timestamp_seconds(key).alias("o_orderdate"), F.when(key % 5 == 0, "5-LOW").otherwise("1-URGENT").alias("o_orderpriority"),
    )
    customer = spark.range(40).select(key.alias("c_custkey"), F.concat(F.lit("c"), key).alias("c_name"), (key % 25).cast("int").alias("c_nationkey"))
    for name, frame in (("orders", orders), ("customer", customer)):
        frame.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    read = sum(input_bytes(spark, f"{d}/{name}.parquet") for name in ("orders", "customer"))
    want = sorted(map(tuple, providers.assembled(Tables(spark, d)).collect()), key=str)
    try:
        monkeypatch.setattr(session, "TASK_BYTES", read)
        t = Tables(spark, d)
        t("orders"), t("customer")
        assert partitions(spark.range(1)) == 4
        got = providers.assembled(t)
        assert partitions(got) == providers.EVIDENCE_FAN_OUT
        assert want and sorted(map(tuple, got.collect()), key=str) == want
    finally:
        size_tasks(spark, 0)


def test_views_that_many_parts_read_are_written(spark):
    from mailposture.plans import providers, quality
    from mailposture.plans.tables import Tables

    t = Tables(spark, SF)
    providers.spf_ip_first_asn(t)
    assert {"v_mx", "v_a", "v_asn"} <= t._stored
    t = Tables(spark, SF)
    quality.check_args(t)
    assert {"v_entity", "v_provider", "v_security"} <= t._stored


def test_rank_groups_is_row_number_with_and_without_a_hot_group(spark):
    row = F.col("id")
    few = spark.range(400).select((row % 100).alias("g"), F.concat(F.lit("d"), row % 37, F.lit("."), row).alias("d"))
    hot = few.unionByName(spark.range(900).select(F.lit(7).cast("bigint").alias("g"), F.concat(F.lit("x"), row).alias("d")))
    for frame in (few, hot):
        got = rank_groups(frame, ["g"], [F.length("d"), F.substring("d", 1, 1)], [F.col("d")])
        groups = {}
        for r in got.collect():
            groups.setdefault(r.g, []).append((r.rank, len(r.d), r.d))
        assert sum(map(len, groups.values())) == frame.count()
        for ranked in groups.values():
            assert [x[0] for x in sorted(ranked)] == list(range(1, len(ranked) + 1)) and [x[1:] for x in sorted(ranked)] == sorted(x[1:] for x in ranked)


def test_flag_join_broadcasts_a_small_list(spark, rows):
    left = spark.range(100).select((F.col("id") % 5).cast("string").alias("k"), "id")
    listed = step(spark.createDataFrame([("1", True), ("3", True)], "k string, f boolean"))
    for bound in ("10485760", "1"):
        own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        try:
            joined = flag_join(left, listed, ["k"])
            assert rows(joined, "k", "id", "f") == rows(left.join(listed, ["k"], "left"), "k", "id", "f")
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert "Exchange hashpartitioning" not in flag_join(left, listed, ["k"])._jdf.queryExecution().executedPlan().toString()
