import json
import random

import pytest

from mailposture.sources import json_splits, registries

ENTRY = "struct<id:string,text:string,deep:struct<a:array<struct<b:string>>>>"
NASTY = ['}', '{', '"', '\\', '\\"', '}]', '[{"', 'é', '\n', 'x', ',', ':', '"rows": [', '  ', '\\\\"}']


def records(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randrange(12)))
    return [{"id": str(k), "text": word(), "deep": {"a": [{"b": word()} for _ in range(rng.randrange(4))]}} for k in range(n)]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(tmp_path, name, value, **kw):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value, **kw), encoding="utf-8")
    return str(path)


def back(df):
    return [r.e.asDict(recursive=True) for r in df.orderBy("file", "n").collect()]


@pytest.mark.parametrize("kw", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_array_over_many_splits(spark, tmp_path, small_splits, kw):
    rows = records(120, 3)
    path = write(tmp_path, "a.json", rows, **kw)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 8
    assert back(json_splits.read_array(spark, path, ENTRY)) == rows


def test_field_of_an_envelope_among_others(spark, tmp_path, small_splits):
    rows = records(80, 5)
    other = [{"id": "other", "rows": [{"id": "no"}]}] * 20
    value = {"generated": 'a "rows": [ }', "counts": {"a": {"b": 1}}, "before": other, "rows": rows, "after": other, "n": 3}
    path = write(tmp_path, "e.json", value)
    assert back(json_splits.read_array(spark, path, ENTRY, "rows")) == rows
    nested = write(tmp_path, "n.json", {"head": {"vars": ["x"]}, "results": {"distinct": True, "bindings": rows, "more": other}})
    assert back(json_splits.read_array(spark, nested, ENTRY, "results.bindings")) == rows
    assert json_splits.read_array(spark, path, ENTRY, "absent").count() == 0


def test_map_and_readers(spark, tmp_path, small_splits):
    entries = {f"k{n}\"}}": {"name": r["text"], "domain": None if n % 3 else r["id"]} for n, r in enumerate(records(60, 7))}
    path = write(tmp_path, "m.json", {"municipalities": entries, "z": {}})
    got = {r.code: (r.name, r.domain) for r in json_splits.read_map(spark, path, "struct<name:string,domain:string>", "municipalities").select("code", "e.*").collect()}
    assert got == {k: (e["name"], e["domain"]) for k, e in entries.items()}
    for large in (False, True):
        table = registries.read_registry_map(spark, path, large=large)
        assert {(r.code, r.name, r.domain) for r in table.collect()} == {(k, e["name"], e["domain"] or "") for k, e in entries.items()}
    rows = [{"id": f"DE-{k}", "name": "n}" * k, "region": "r", "osm_relation_id": k} for k in range(50)]
    path = write(tmp_path, "r.json", rows)
    one, many = (sorted(map(tuple, registries.read_registry_array(spark, path, large=large).collect())) for large in (False, True))
    assert one == many and len(one) == 50


def test_edges(spark, tmp_path, small_splits):
    assert back(json_splits.read_array(spark, write(tmp_path, "empty.json", ""), ENTRY)) == []
    assert back(json_splits.read_array(spark, write(tmp_path, "none.json", "[]"), ENTRY)) == []
    assert back(json_splits.read_array(spark, write(tmp_path, "scalars.json", '[1, null, {"id": "a"}, 2]'), "struct<id:string>")) == [{"id": "a"}]
    assert back(json_splits.read_array(spark, write(tmp_path, "bom.json", '﻿ [{"id": "a"}, {"id": "a"}]\n'), "struct<id:string>")) == [{"id": "a"}] * 2
    long = [{"id": "x" * 5000 + "}" * 300, "text": None}]
    assert back(json_splits.read_array(spark, write(tmp_path, "long.json", long), "struct<id:string,text:string>")) == long
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        write(folder, f"{k}.json", records(20, k))
    assert back(json_splits.read_array(spark, str(folder), ENTRY)) == [r for k in range(3) for r in records(20, k)]
