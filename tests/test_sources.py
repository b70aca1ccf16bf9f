import json

import pytest
from pyspark.sql import functions as F

from mailposture.operators import export as ex
from mailposture.sources import observations as ob
from mailposture.sources import registries as rg
from mailposture.sources import sinks
from mailposture.sources import stages as sg
from mailposture.streaming import observations as stream


def put(path, data, bom=False):
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


def test_registries(spark, rows, tmp_path):
    a = put(tmp_path / "a.json", [{"id": "DE-01001000", "name": "Flensburg", "country": "DE", "region": "SH", "domain": "flensburg.de", "osm_relation_id": 27020}, {"id": "DE-02", "name": "Ohne", "region": "HH"}])
    assert rows(rg.read_registry_array(spark, a), "code", "domain") == [("01001000", "flensburg.de"), ("02", "")]
    b = put(tmp_path / "b.json", {"generated": "x", "total": 1, "municipalities": {"01": {"name": "N", "domain": "n.de"}}})
    assert rows(rg.read_registry_map(spark, b)) == [("01", "N", "n.de")]
    csv = put(tmp_path / "m.csv", "Kommune,E-Mail,Bundesland,Einwohner\nFlensburg,info@Flensburg.de ,Schleswig-Holstein,9\n,x@y.de,,\nOhne,none,,\nSkip,a@web.de,,\nGröß,a@b.de,,1\n", bom=True)
    got = rg.read_email_list_csv(spark, csv, ["web.de"]).orderBy("pos").collect()
    assert [(r.name_key, r.domain, r.region) for r in got] == [("flensburg", "flensburg.de", "Schleswig-Holstein"), ("groess", "b.de", "")]
    at = put(tmp_path / "at.json", [{"Gemeindekennziffer": 101, "Gemeindename": "E", "PLZ": 7000, "Website": "http://www.e.gv.at", "Mail": "Rathaus@E.at"}])
    assert rows(rg.read_registry_at(spark, at), "code", "website_domain", "email_domain") == [("00101", "e.gv.at", "e.at")]
    snap = put(tmp_path / "s.csv", "HistoricalCode,BfsCode,ValidFrom,Level,Parent,Name,ShortName\n100,1,x,1,,Zürich,ZH\n200,11,x,2,100,B,B\n300,261,x,3,200,Zürich,Z\n")
    assert rows(rg.read_name_reference(spark, put(tmp_path / "n.json", {"01": {"name": "N"}}))) == [("01", "N")]
    with pytest.raises(Exception):
        rg.read_commune_snapshot(spark, snap).collect()  # another column order is refused, not misread
    good = put(tmp_path / "s2.csv", "HistoricalCode,BfsCode,Level,Parent,Name,ShortName\n100,1,1,,Zürich,ZH\n200,11,2,100,B,B\n300,261,3,200,Zürich,Z\n")
    assert rows(rg.resolve_hierarchy(rg.read_commune_snapshot(spark, good))) == [("261", "Zürich", "Kanton Zürich")]
    bindings = {"results": {"bindings": [{"ags": {"value": "1"}, "itemLabel": {"value": "A"}}, {"ags": {"value": "1"}, "itemLabel": {"value": "B"}, "website": {"value": "http://a.de"}}, {"itemLabel": {"value": "no code"}}]}}
    assert rows(rg.read_bindings(spark, put(tmp_path / "w.json", bindings), "ags"), "code", "name", "website") == [("1", "A", "http://a.de")]


def test_paged_registry(spark, rows, tmp_path):
    put(tmp_path / "p1.json", [{"key": "101", "name": "Old", "district": {"name": "D"}}, {"key": "10102", "name": "B"}])
    put(tmp_path / "p2.json", [{"key": "101", "name": "New", "federalProvince": {"name": "Burgenland"}}])
    assert rows(rg.read_paged_registry(spark, str(tmp_path), "at"), "code", "name", "region") == [("00101", "New", "Burgenland"), ("10102", "B", None)]


def test_overrides(spark, rows, tmp_path):
    path = put(tmp_path / "o.json", {"1": {"email_domain": "a.ch"}, "2": {"email_domain": "", "name": "N"}, "3": {"website": "w.ch"}})
    assert rows(rg.read_overrides(spark, path), "code", "email_domain", "name") == [("1", "a.ch", None), ("2", "", "N"), ("3", None, None)]
    assert rg.read_overrides(spark, str(tmp_path / "none.json")).count() == 0
    sec = put(tmp_path / "s.json", {"1": {"dss": {"has_spf": True}, "source": "x"}, "2": {"dane": {"supported": True}}})
    ok, bad = rg.read_security_overrides(spark, sec, "ch")
    assert rows(ok, "code", "has_spf", "dane_supported") == [("1", True, None)] and rows(bad, "code") == [("2",)]


ENTRY = {
    "code": "10", "name": "Zurich", "region": "ZH", "domain": "zurich.ch", "mx": ["b.ch", "a.ch"], "spf": "v=spf1", "provider": "microsoft", "category": "us-cloud",
    "classification_confidence": 95.0, "classification_signals": [{"kind": "mx", "provider": "microsoft", "weight": 0.2, "detail": "d"}], "gateway": "seppmail",
    "sources_detail": {"wikidata": ["zurich.ch"]}, "resolve_flags": ["f"],
}
BARE = {"code": "2", "name": "B", "region": "", "domain": "", "mx": [], "spf": "", "provider": "unknown", "category": "unknown", "classification_confidence": 0.0, "classification_signals": []}


def test_stage_files_and_export(spark, rows, tmp_path):
    put(tmp_path / "providers_ch.json", {"generated": "2026-01-01", "commit": "c", "total": 2, "counts": {"microsoft": 1, "unknown": 1}, "municipalities": [ENTRY, BARE]})
    sec = {"code": "10", "name": "Zurich", "region": "ZH", "domain": "zurich.ch", "mx_records": [], "dane": {"supported": True, "partial": True}, "dss": None, "scan_valid": True}
    put(tmp_path / "security_ch.json", {"generated": "x", "total": 1, "counts": {}, "municipalities": [sec]})
    nested = sg.read_stage(spark, str(tmp_path), "providers")
    assert rows(nested, "country", "code") == [("ch", "10"), ("ch", "2")]
    with pytest.raises(FileNotFoundError):
        sg.read_stage(spark, str(tmp_path), "providers", missing="error")
    tables = sg.provider_tables(nested)
    assert rows(tables["mx"], "pos", "host") == [(0, "b.ch"), (1, "a.ch")] and tables["header"].count() == 2
    export = ex.build_export(ex.flatten_provider(nested), ex.flatten_security(sg.read_stage(spark, str(tmp_path), "security")))
    assert len(export.columns) == 21
    first = export.filter("code = '10'").first()
    assert (first.mx, first.classification_signals, first.sources, first.resolve_flags, first.dane_supported, first.has_spf) == ("b.ch; a.ch", "mx: d", "wikidata", "f", True, False)
    assert export.filter("code = '2'").first().scan_valid is None
    sinks.write_providers(nested.drop("generated", "commit", "total", "counts"), str(tmp_path / "out"))
    written = spark.read.json(str(tmp_path / "out" / "providers"))
    assert [r.code for r in written.collect()] == ["2", "10"]
    small = spark.read.json(str(tmp_path / "out" / "providers_min"))
    assert small.schema["classification_signals"].dataType.elementType.names == ["detail", "kind"]
    for fmt, name in (({"1": {"bfs": "7", "provider": "aws", "classification_confidence": 1.0}}, "old"), ([{"code": "7", "provider": "aws", "classification_confidence": 1.0}], "new")):
        path = put(tmp_path / f"{name}.json", {"municipalities": fmt})
        assert rows(sg.read_baseline(spark, path, "ch"), "code", "provider") == [("7", "aws")]


def test_scan_files(spark, rows, tmp_path):
    scan = {"scanTime": "2026-01-01T00:00:00Z", "scanData": [{"domain": "a", "mxRecord": "m", "ipAddress": None, "adFlagForMx": True}], "testSSLResult": [{"host": "m", "ip": "1", "exitCode": 0, "consoleLog": "x"}], "daneCheckResult": [], "dssResult": [{"domain": "a", "exitCode": 0, "consoleLog": "spf: x"}]}
    tables = sg.read_scan_result(spark, put(tmp_path / "s.json", scan))
    assert rows(tables["addresses"], "domain", "mx", "ip", "ad") == [("a", "m", None, True)] and tables["dane"].count() == 0
    targets = put(tmp_path / "t.json", {"checked_emails": ["info@A.ch", "x@a.ch", "b.de"]})
    assert rows(sg.read_scan_targets(spark, targets)) == [("a.ch",), ("b.de",)]
    flat = put(tmp_path / "f.json", json.dumps([{"﻿code": 5, "name": "n", "hasSpf": "WAHR", "hasDane": 0}], ensure_ascii=False), bom=True)
    assert rows(sg.read_flat_result(spark, flat), "code", "hasSpf", "hasDane") == [("5", "WAHR", "0")]


OBS = "kind string, domain string, accessible boolean, payload string, observed_at timestamp"


def obs(spark, data):
    return spark.createDataFrame([(k, d, a, p, t) for k, d, a, p, t in data], "kind string, domain string, accessible boolean, payload string, t string").select(
        "kind", "domain", "accessible", "payload", F.to_timestamp("t").alias("observed_at")
    )


DATA = [
    ("head", "a", True, "1", "2024-01-01 00:00:00"), ("head", "a", False, "2", "2024-01-03 00:00:00"), ("head", "a", True, "0", "2023-12-01 00:00:00"),
    ("mx", "a", False, "m", "2024-01-02 12:00:00"), ("scrape", "b", True, "s", "2023-12-28 00:00:00"),
]


def test_observations(spark, rows, tmp_path):
    frame = obs(spark, DATA)
    assert rows(ob.latest(frame), "kind", "domain", "payload") == [("head", "a", "1"), ("mx", "a", "m"), ("scrape", "b", "s")]
    now = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    assert rows(ob.fresh(frame, now), "kind", "payload") == [("head", "2"), ("mx", "m"), ("scrape", "s")]
    ob.write_obs(frame, str(tmp_path / "obs"))
    back = ob.read_obs(spark, str(tmp_path / "obs"))
    assert back.filter("kind = 'head'").count() == 3
    cache = put(tmp_path / "c.json", {"a": {"emails": ["x"], "accessible": True, "timestamp": "2024-01-02T00:00:00+00:00"}, "b": {"timestamp": "2023-01-01T00:00:00+00:00"}, "c": {"timestamp": "??"}, "d": {}})
    assert rows(ob.read_obs_json(spark, cache, 7, now), "domain") == [("a",), ("c",), ("d",)]
    assert ob.read_obs_json(spark, put(tmp_path / "bad.json", "{nope"), 7, now).count() == 0


def test_streams(spark, rows, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "state")
    for i, part in enumerate(([0, 3], [1, 2, 4])):
        obs(spark, [DATA[j] for j in part]).coalesce(1).write.mode("append").parquet(str(source))
        stream_in = spark.readStream.schema(OBS).parquet(str(source))
        stream.upsert_stream(stream_in, target, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert rows(stream.current_state(spark, target), "kind", "domain", "payload") == rows(ob.latest(obs(spark, DATA)), "kind", "domain", "payload")
    stream.compact(spark, str(tmp_path / "compact"), target)
    assert rows(stream.current_state(spark, str(tmp_path / "compact")), "kind", "payload") == [("head", "1"), ("mx", "m"), ("scrape", "s")]
    deduped = stream.dedup_stream(spark.readStream.schema(OBS).parquet(str(source)), "1 day")
    query = deduped.writeStream.format("memory").queryName("deduped").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("deduped").filter("kind = 'mx'").count() == 1


def test_provider_tables_are_computed_once_and_packed(spark, tmp_path):
    signal = F.array(F.struct(F.lit("mx").alias("kind"), F.lit("MX h").alias("detail"), F.lit(0).alias("pos")))
    nested = spark.range(3).select(
        F.lit("ch").alias("country"), F.col("id").cast("string").alias("code"), F.expr("uuid()").alias("name"), F.lit("aws").alias("provider"), signal.alias("classification_signals")
    )
    sinks.write_providers(nested, str(tmp_path))
    full, reduced = (spark.read.json(f"{tmp_path}/{n}") for n in ("providers", "providers_min"))
    assert [r.name for r in full.orderBy("code").collect()] == [r.name for r in reduced.orderBy("code").collect()]
    assert spark.read.json(f"{tmp_path}/providers_header").first().total == 3
    assert list(tmp_path.glob("providers/*.json.gz")) and list(tmp_path.glob("providers_min/*.json.gz"))
