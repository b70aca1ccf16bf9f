"""Readers of registry files and the joins that turn them into one row per entity.

Every reader states its schema, so no file is read twice for inference and missing keys become nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailposture import dims
from mailposture.functions.names import normalize_name
from mailposture.functions.text import lookup, normalize_code, strip, url_domain
from mailposture.skew import lookup_join
from mailposture.sources import json_splits

OVERRIDE_ENTRY = "struct<email_domain:string,website:string,name:string,canton:string>"
SHORT_TO_CANTON = {short: full for full, short in dims.REGION_ABBREVIATIONS["ch"].items()}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system it names, local or distributed."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_json_map(spark: SparkSession, path: str, entry: str, field: str | None = None, key: str = "code", large: bool = False) -> DataFrame:
    """A JSON object ``{key: entry}``, or one under ``field`` of an envelope, as rows of key and entry fields.

    A file is read in one task, a ``large`` one in many (see ``json_splits``; its entries are objects).
    """
    if large:
        return json_splits.read_map(spark, path, entry, field, key).select(key, "e.*")
    text = spark.read.text(path, wholetext=True)
    if field:
        parsed = F.from_json("value", f"struct<{field}:map<string,{entry}>>")[field]
    else:
        parsed = F.from_json("value", f"map<string,{entry}>")
    return text.select(F.explode(parsed).alias(key, "e")).select(key, "e.*")


def read_objects(spark: SparkSession, path: str, schema: str, large: bool) -> DataFrame:
    """The objects of a JSON array with the columns ``schema``; one task reads a file, many a ``large`` one."""
    if not large:
        return spark.read.schema(schema).json(path, multiLine=True)
    return json_splits.read_array(spark, path, StructType.fromDDL(schema).simpleString()).select("e.*")


def read_registry_array(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """Registry with entries ``DE-<code>``."""
    schema = "id string, name string, country string, region string, domain string, osm_relation_id bigint"
    rows = read_objects(spark, path, schema, large)
    code = F.replace("id", F.lit("DE-"), F.lit(""))
    return rows.select(code.alias("code"), "name", "region", F.coalesce("domain", F.lit("")).alias("domain"), "osm_relation_id")


def read_registry_map(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """Registry with a map of entries under ``municipalities``."""
    return read_json_map(spark, path, "struct<name:string,domain:string>", "municipalities", large=large).select(
        "code", "name", F.coalesce("domain", F.lit("")).alias("domain")
    )


def read_email_list_csv(spark: SparkSession, path: str, skip: list[str]) -> DataFrame:
    """Mail list with a header: usable entries keyed by normalised name, ``pos`` in file order.

    A row needs a name and an address; the domain is the part behind ``@`` without unprintable characters.
    """
    schema = "name string, email string, region string, inhabitants string"
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, multiLine=False, encoding="UTF-8")
    # File order: rows of one file are numbered by partition and place, both increasing along the file.
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    return email_list(rows, skip)


def email_list(rows: DataFrame, skip: list[str]) -> DataFrame:
    name, email = strip(F.coalesce("name", F.lit(""))), strip(F.coalesce("email", F.lit("")))
    domain = F.lower(F.regexp_replace(F.get(F.split(email, "@"), F.lit(1)), r"[^\x21-\x7e]", ""))
    kept = rows.filter((name != "") & F.contains(email, F.lit("@")) & ~domain.isin(skip))
    return kept.select(
        normalize_name(name).alias("name_key"), domain.alias("domain"), strip(F.coalesce("region", F.lit(""))).alias("region"), "pos"
    )


def read_name_reference(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    return read_json_map(spark, path, "struct<name:string>", large=large)


def read_registry_at(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    schema = "Gemeindekennziffer bigint, Gemeindename string, PLZ bigint, Website string, Mail string"
    return registry_at(read_objects(spark, path, schema, large))


def registry_at(rows: DataFrame) -> DataFrame:
    """Code padded to 5 digits, website and mail as domains."""
    mail = F.coalesce("Mail", F.lit(""))
    return rows.select(
        normalize_code(F.col("Gemeindekennziffer"), 5).alias("code"),
        F.col("Gemeindename").alias("name"),
        F.col("PLZ").alias("plz"),
        F.col("Website").alias("website"),
        F.col("Mail").alias("mail"),
        F.when(F.coalesce("Website", F.lit("")) != "", url_domain(F.col("Website"))).alias("website_domain"),
        F.when(F.contains(mail, F.lit("@")), F.lower(F.get(F.split(mail, "@"), F.lit(1)))).alias("email_domain"),
    )


def read_commune_snapshot(spark: SparkSession, path: str) -> DataFrame:
    schema = "HistoricalCode int, BfsCode int, Level int, Parent int, Name string, ShortName string"
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return rows.select(
        F.col("HistoricalCode").alias("hist"), F.col("BfsCode").alias("bfs"), F.col("Level").alias("level"),
        F.col("Parent").alias("parent"), F.col("Name").alias("name"), F.col("ShortName").alias("short"),
    )


def top_ancestor(units: DataFrame, leaf_level: int = 3, top_level: int = 1, max_depth: int = 5) -> DataFrame:
    """For every leaf its nearest ancestor of the top level ``(hist, top_short)``; null when there is none.

    The upper units, a small part of the table, find their own top first, by ``max_depth - 1`` joins among themselves.
    The leaves are then looked up once.
    """
    upper = units.filter(F.col("level") < leaf_level)
    up = upper.select(F.col("hist").alias("_at"), F.col("level").alias("_level"), F.col("parent").alias("_next"), F.col("short").alias("_short"))
    is_top = F.col("level") == top_level
    walk = upper.select(F.col("hist").alias("_unit"), F.when(~is_top, F.col("parent")).alias("_at"), F.when(is_top, F.col("short")).alias("top_short"))
    for _ in range(max_depth - 1):
        found = F.coalesce("top_short", F.when(F.col("_level") == top_level, F.col("_short")))
        walk = walk.join(up, "_at", "left").select("_unit", F.when(found.isNull(), F.col("_next")).alias("_at"), found.alias("top_short"))
    leaves = units.filter(F.col("level") == leaf_level).select("hist", F.col("parent").alias("_unit"))
    return lookup_join(leaves, walk.select("_unit", "top_short"), ["_unit"]).select("hist", "top_short")


def resolve_hierarchy(units: DataFrame, max_depth: int = 5) -> DataFrame:
    """Communes with the full name of their canton, '' when the chain leads to none."""
    tops = top_ancestor(units, max_depth=max_depth)
    leaves = units.filter(F.col("level") == 3).join(tops, "hist", "left")
    canton = F.coalesce(lookup(F.lower("top_short"), SHORT_TO_CANTON), F.lit(""))
    return leaves.select(F.col("bfs").cast("string").alias("code"), "name", canton.alias("canton"))


def read_paged_registry(spark: SparkSession, directory: str, country: str) -> DataFrame:
    """Dump of a paged registry, one JSON array per page file; a later page replaces an earlier entry."""
    schema = (
        "key string, name string, status string, postalCode string, district struct<name:string>, "
        "federalProvince struct<name:string>, canton struct<shortName:string>"
    )
    rows = spark.read.schema(schema).json(directory, multiLine=True).withColumn("page", F.col("_metadata.file_path"))
    return paged_registry(rows, country)


def paged_registry(rows: DataFrame, country: str) -> DataFrame:
    """Latest entry per code; pages are ordered by ``page``."""
    if country == "at":
        code = normalize_code(F.col("key"), 5)
        fields = [F.col("district.name").alias("district"), F.col("federalProvince.name").alias("region")]
    else:
        code = F.col("key")
        fields = [F.coalesce(lookup(F.lower("canton.shortName"), SHORT_TO_CANTON), F.lit("")).alias("canton")]
    entry = rows.select(code.alias("code"), "page", F.struct("name", *fields).alias("entry"))
    return entry.groupBy("code").agg(F.max(F.struct("page", "entry")).alias("last")).select("code", "last.entry.*")


def read_bindings(spark: SparkSession, path: str, code_field: str, large: bool = False) -> DataFrame:
    """Result bindings of a knowledge-base query; ``pos`` keeps their order.  Many tasks read a ``large`` file."""
    value = "struct<value:string>"
    entry = f"struct<{code_field}:{value},itemLabel:{value},website:{value},cantonLabel:{value}>"
    schema = f"struct<results:struct<bindings:array<{entry}>>>"
    if large:
        rows = json_splits.read_array(spark, path, entry, "results.bindings").select(F.struct("file", "n").alias("pos"), F.col("e").alias("b"))
    else:
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)["results"]["bindings"]).alias("pos", "b"))
    return merge_bindings(
        rows.select(
            "pos",
            F.col(f"b.{code_field}.value").alias("code"),
            F.col("b.itemLabel.value").alias("name"),
            F.col("b.website.value").alias("website"),
            F.col("b.cantonLabel.value").alias("cantonLabel"),
        )
    )


def merge_bindings(rows: DataFrame) -> DataFrame:
    """One row per code: the first binding, with the first website that is not empty; empty codes dropped."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("name", "website")}
    kept = rows.filter(F.coalesce("code", F.lit("")) != "").withColumns(text)
    first = F.min(F.struct("pos", "name", "cantonLabel")).alias("first")
    site = F.min(F.when(F.col("website") != "", F.struct("pos", "website"))).alias("site")
    return kept.groupBy("code").agg(first, site).select(
        "code", "first.name", F.coalesce("site.website", F.lit("")).alias("website"), "first.cantonLabel"
    )


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Manual overrides by code; a missing file means none.  A missing mail domain is null, an empty one ''."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "code string, email_domain string, website string, name string, canton string")
    return read_json_map(spark, path, OVERRIDE_ENTRY)


def read_provider_overrides(spark: SparkSession, path: str, country: str) -> DataFrame:
    """Provider overrides of a country, unchecked; see ``classify.split_overrides``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "country string, code string, provider string, operator string, source string")
    rows = read_json_map(spark, path, "struct<provider:string,operator:string,source:string>")
    return rows.select(F.lit(country).alias("country"), "code", "provider", "operator", "source")


def read_security_overrides(spark: SparkSession, path: str, country: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) security overrides of a country as flat flags; an override needs a source."""
    dss = "struct<has_spf:boolean,has_good_spf:boolean,has_dmarc:boolean,has_good_dmarc:boolean,has_dkim:boolean>"
    entry = f"struct<dss:{dss},dane:struct<supported:boolean,partial:boolean>,source:string>"
    if path_exists(spark, path):
        rows = read_json_map(spark, path, entry)
    else:
        rows = spark.createDataFrame([], f"code string, dss {dss}, dane struct<supported:boolean,partial:boolean>, source string")
    flat = rows.select(
        F.lit(country).alias("country"), "code", F.col("dane.supported").alias("dane_supported"), F.col("dane.partial").alias("dane_partial"), "dss.*", "source"
    )
    return flat.filter(F.col("source").isNotNull()), flat.filter(F.col("source").isNull())
