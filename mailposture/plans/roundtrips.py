"""Queries that write rows of the test tables through sinks to the shared folder and read them back, and streams over them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mailposture.plans.providers import nested_providers
from mailposture.plans.registry import BODY, query, r6
from mailposture.plans.resolve import NOW, SQL_FRESH
from mailposture.session import shared_folder
from mailposture.sources import observations as ob
from mailposture.sources import json_splits, registries, sinks
from mailposture.sources import stages as sg
from mailposture.streaming import observations as st


def folder(t) -> str:
    return f"{shared_folder(t.spark)}/roundtrip-{uuid.uuid4().hex}"


@query("obs_round_trip", SQL_FRESH)
def obs_round_trip(t):
    path = folder(t)
    ob.write_obs(t("v_obs"), path)
    return ob.fresh(ob.read_obs(t.spark, path), F.to_timestamp(F.lit(NOW))).select("kind", "domain", "event_id")


def observed_stream(t, path: str):
    """The observations as a stream over files."""
    obs = t("v_obs")
    obs.write.parquet(f"{path}/in")
    return t.spark.readStream.schema(obs.schema).parquet(f"{path}/in")


@query("stream_state", BODY["latest_observation"])
def stream_state(t):
    path = folder(t)
    st.upsert_stream(observed_stream(t, path), f"{path}/state", f"{path}/checkpoint", availableNow=True).awaitTermination()
    st.compact(t.spark, f"{path}/compact", f"{path}/state")
    return st.current_state(t.spark, f"{path}/compact").select("kind", "domain", "accessible", "payload", "event_id", "observed_at")


@query("stream_dedup", "SELECT DISTINCT kind, domain FROM v_obs WHERE kind = 'scrape'")
def stream_dedup(t):
    path = folder(t)
    kept = st.fresh_stream(observed_stream(t, path), "scrape").select("kind", "domain")
    kept.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    # One batch: every key once, which fails if the stream lets a repeated row pass.
    return t.spark.read.parquet(f"{path}/out")


@query(
    "domains_round_trip",
    """SELECT country, code, name, domain, CASE WHEN k % 3 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN k % 5 = 0 THEN 'unverified' ELSE '' END AS flags,
      k % 3 = 0 OR k % 5 = 0 AS review FROM v_entity""",
)
def domains_round_trip(t):
    path = folder(t)
    none = F.array().cast("array<string>")
    detailed = t("v_entity").select(
        "country", "code", "name", "region", F.lit("").alias("website"), F.when(F.col("domain") == "", none).otherwise(F.array("domain")).alias("emails"), F.lit("scrape").alias("source"),
        F.when(F.col("k") % 3 == 0, "low").otherwise("high").alias("confidence"), F.create_map(F.lit("scrape"), F.array("domain")).alias("sources_detail"),
        F.when(F.col("k") % 5 == 0, F.array(F.lit("unverified"))).otherwise(none).alias("flags"),
    )
    sinks.write_domains(detailed, path)
    rows = sg.read_entity_domains(t.spark, f"{path}/domains_detailed", envelope=False)
    review = sg.read_rows(t.spark, f"{path}/domains_review", "domains").select("country", "code", F.lit(True).alias("review"))
    joined = rows.join(review, ["country", "code"], "left").withColumn("review", F.coalesce("review", F.lit(False)))
    return joined.select("country", "code", "name", "domain", "confidence", F.array_join("flags", " ").alias("flags"), "review")


@query(
    "providers_round_trip",
    """SELECT p.country, p.code, p.name, p.domain, p.provider, round(p.confidence, 6) AS confidence, coalesce(n, 0) AS n_signals, coalesce(n, 0) AS n_reduced, coalesce(kinds, '') AS kinds, total FROM v_provider p
    JOIN (SELECT country, count(*) AS total FROM v_provider GROUP BY country) h ON p.country = h.country
    LEFT JOIN (SELECT country, code, count(*) AS n, min(kind) || '-' || max(kind) AS kinds FROM v_signal GROUP BY country, code) s ON p.country = s.country AND p.code = s.code""",
)
def providers_round_trip(t):
    path = folder(t)
    sinks.write_providers(nested_providers(t), path)
    tables = sg.provider_tables(sg.read_rows(t.spark, f"{path}/providers", "providers"))
    signals = tables["signals"].groupBy("country", "code").agg(F.count(F.lit(1)).alias("n_signals"))
    header = t.spark.read.schema("country string, provider string, n bigint, total bigint").json(f"{path}/providers_header").select("country", "total").distinct()
    # The reduced table, whose signals are kind and detail only.
    reduced = t.spark.read.schema("country string, code string, classification_signals array<struct<kind:string,detail:string>>").json(f"{path}/providers_min")
    kind = F.col("classification_signals.kind")
    kinds = F.coalesce(F.concat_ws("-", F.array_min(kind), F.array_max(kind)), F.lit(""))
    reduced = reduced.select("country", "code", F.greatest(F.size(kind), F.lit(0)).cast("bigint").alias("n_reduced"), kinds.alias("kinds"))
    # One row for each country.
    rows = tables["providers"].join(signals, ["country", "code"], "left").join(reduced, ["country", "code"]).join(F.broadcast(header), "country")
    counts = [F.coalesce("n_signals", F.lit(0)).alias("n_signals"), "n_reduced", "kinds", "total"]
    return r6(rows.select("country", "code", "name", "domain", "provider", "confidence", *counts))


@query("security_round_trip", "SELECT country, code, domain, scan_valid, dane_supported, has_spf, has_good_spf, has_dmarc, has_good_dmarc FROM v_security")
def security_round_trip(t):
    path = folder(t)
    flat = t("v_security")
    missing = [c for c in ("name", "region", "has_dkim", "dane_partial") if c not in flat.columns]
    sinks.write_security(flat.withColumns({c: F.lit(None).cast("string" if c in ("name", "region") else "boolean") for c in missing}), path)
    rows = sg.security_tables(sg.read_rows(t.spark, f"{path}/security", "security"))["security"]
    return rows.select("country", "code", "domain", "scan_valid", "dane_supported", "has_spf", "has_good_spf", "has_dmarc", "has_good_dmarc")


@query("mta_round_trip", "SELECT domain, mx, ip, has_dane, has_spf FROM v_mta")
def mta_round_trip(t):
    path = folder(t)
    sinks.write_mta(t("v_mta"), path)
    return t.spark.read.parquet(path).select("domain", "mx", "ip", "has_dane", "has_spf")


@query("report_round_trip", "SELECT country, provider, count(*) AS n, 'g' AS generated, (SELECT count(*) FROM v_provider q WHERE q.country = p.country) AS total FROM v_provider p GROUP BY country, provider")
def report_round_trip(t):
    path = folder(t)
    providers = t("v_provider")
    report = providers.groupBy("country", "provider").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_report(report, path, "shares", sinks.report_metadata(providers, "g", None))
    back = t.spark.read.schema("country string, provider string, n bigint").csv(f"{path}/shares", header=True)
    meta = t.spark.read.schema("generated string, commit string, country string, total bigint").csv(f"{path}/shares_meta", header=True)
    return back.join(F.broadcast(meta.select("country", "generated", "total")), "country")


#: Entities of one JSON file, which bounds what is collected to write it.
FILE_ROWS = 2000
#: Text that looks like JSON, so that braces in strings and escapes stand in every record.
NOISE = ' "}], \\ {[:'
SQL_NOISE = "name || ' ' || chr(34) || '}], ' || chr(92) || ' {[:'"


def write_json_files(t, path: str, body) -> None:
    """Files of ``FILE_ROWS`` entities, one JSON value each, without line ends between its records."""
    rows = t("v_entity").withColumn("name", F.concat("name", F.lit(NOISE)))
    files = rows.groupBy("country", F.floor(F.col("k") / FILE_ROWS).alias("part")).agg(body.alias("value"))
    files.repartition("country", "part").write.partitionBy("country", "part").text(path)


@query("registry_array_split", f"SELECT code, {SQL_NOISE} AS name, coalesce(region, '') AS region, coalesce(domain, '') AS domain FROM v_entity WHERE country = 'de'")
def registry_array_split(t):
    """JSON arrays of records, cut at records by many tasks."""
    path = folder(t)
    entry = F.struct(F.concat(F.lit("DE-"), "code").alias("id"), "name", F.coalesce("region", F.lit("")).alias("region"), "domain")
    write_json_files(t, path, F.to_json(F.collect_list(entry)))
    return registries.read_registry_array(t.spark, f"{path}/country=de/*", large=True).select("code", "name", "region", "domain")


@query("registry_map_split", f"SELECT country, code, {SQL_NOISE} AS name, coalesce(domain, '') AS domain FROM v_entity")
def registry_map_split(t):
    """Envelopes with a map of records under one key and other arrays and objects beside it."""
    path = folder(t)
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("code"), F.struct("name", "domain").alias("e"))))
    head, beside = F.lit('{"counts":{"a":{"municipalities":{"x":{}}}},"generated":"\\"municipalities\\": {","municipalities":'), F.lit(',"more":[{"code":"no"},{"name":{}}]}')
    write_json_files(t, path, F.concat(head, F.to_json(entries), beside))
    rows = json_splits.read_map(t.spark, f"{path}/*/*", "struct<name:string,domain:string>", "municipalities")
    country = F.regexp_extract("file", "country=([^/]+)/", 1)
    return rows.select(country.alias("country"), "code", "e.name", F.coalesce("e.domain", F.lit("")).alias("domain"))
