"""Readers of stage outputs: resolve, provider and security envelopes, the flat export, third-party results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailposture import dims
from mailposture.sources.registries import path_exists

SIGNAL = "struct<kind:string,provider:string,weight:double,detail:string>"
PROVIDER_ROW = (
    "struct<code:string,name:string,region:string,domain:string,mx:array<string>,spf:string,provider:string,category:string,"
    f"classification_confidence:double,classification_signals:array<{SIGNAL}>,gateway:string,"
    "override:struct<operator:string,source:string>,sources_detail:map<string,array<string>>,resolve_flags:array<string>>"
)
SECURITY_ROW = (
    "struct<code:string,name:string,region:string,domain:string,mx_records:array<string>,dane:struct<supported:boolean,partial:boolean>,"
    "dss:struct<has_spf:boolean,has_good_spf:boolean,has_dmarc:boolean,has_good_dmarc:boolean,has_dkim:boolean>,scan_valid:boolean,"
    "override:struct<source:string>>"
)
DOMAIN_ROW = (
    "struct<code:string,name:string,region:string,website:string,emails:array<string>,source:string,confidence:string,"
    "sources_detail:map<string,array<string>>,flags:array<string>>"
)
ROWS = {"domains": DOMAIN_ROW, "providers": PROVIDER_ROW, "security": SECURITY_ROW}


def country_of(path: Column, stage: str) -> Column:
    """Country code in a file name ``{stage}_xx…``; ``ch`` when there is none."""
    cc = F.regexp_extract(path, rf"{stage}_(\w{{2}})[^/]*$", 1)
    return F.when(cc != "", cc).otherwise("ch")


def with_country_from_path(df: DataFrame, stage: str) -> DataFrame:
    return df.withColumn("country", country_of(F.col("_metadata.file_path"), stage))


def read_envelope(spark: SparkSession, paths: list[str] | str, stage: str) -> DataFrame:
    """Rows of envelopes ``{generated, commit, total, counts, municipalities}`` with the run columns beside them."""
    schema = f"generated string, commit string, total bigint, counts map<string,bigint>, municipalities array<{ROWS[stage]}>"
    files = with_country_from_path(spark.read.schema(schema).json(paths, multiLine=True), stage)
    return files.select("country", "generated", "commit", "total", "counts", F.explode("municipalities").alias("m")).select(
        "country", "generated", "commit", "total", "counts", "m.*"
    )


def read_stage(spark: SparkSession, directory: str, stage: str, countries=tuple(dims.COUNTRIES), missing: str = "skip") -> DataFrame:
    """One stage for many countries in one scan; a missing file is skipped or raises (``missing='error'``)."""
    paths = [f"{directory}/{stage}_{cc}.json" for cc in countries]
    present = [p for p in paths if path_exists(spark, p)]
    if missing == "error" and len(present) < len(paths):
        raise FileNotFoundError(", ".join(sorted(set(paths) - set(present))))
    if not present:
        return spark.createDataFrame([], "country string, generated string, commit string, total bigint, counts map<string,bigint>").select(
            "*", F.lit(None).cast(ROWS[stage]).alias("m")
        ).select("country", "generated", "commit", "total", "counts", "m.*")
    return read_envelope(spark, present, stage)


def read_rows(spark: SparkSession, path: str, stage: str, fmt: str = "json") -> DataFrame:
    """Rows of one stage as its sink writes them: one row per line or Parquet row, split like any table, not one envelope per file."""
    schema = StructType.fromDDL(ROWS[stage].replace("struct<", "struct<country:string,", 1))
    return spark.read.schema(schema).format(fmt).load(path)


def primary_domain(emails: Column) -> Column:
    return F.coalesce(F.get(emails, F.lit(0)), F.lit(""))


def read_entity_domains(spark: SparkSession, path: str, envelope: bool = True) -> DataFrame:
    """Resolve output as entities with their primary domain; '' when they have none.

    ``envelope`` reads files with a header around all rows, otherwise the tables of the resolve sink.
    """
    rows = read_envelope(spark, path, "domains") if envelope else read_rows(spark, path, "domains")
    return rows.withColumn("domain", primary_domain(F.col("emails")))


def run_metadata(stage_rows: DataFrame, stage: str) -> DataFrame:
    """(stage, country, generated, commit) of every file read."""
    return stage_rows.select(F.lit(stage).alias("stage"), "country", "generated", "commit").distinct()


def provider_tables(nested: DataFrame) -> dict[str, DataFrame]:
    """Nested provider rows as flat providers, signals, MX hosts, and the header counts."""
    key = ["country", "code"]
    flat = nested.select(
        *key, "name", F.coalesce("region", F.lit("")).alias("region"), F.coalesce("domain", F.lit("")).alias("domain"),
        F.coalesce("spf", F.lit("")).alias("spf"), "provider", "category", F.col("classification_confidence").alias("confidence"), "gateway", "override",
    )
    signals = nested.select(*key, F.posexplode("classification_signals").alias("pos", "s")).select(*key, "pos", "s.*")
    hosts = nested.select(*key, F.posexplode("mx").alias("pos", "host"))
    tables = {"providers": flat, "signals": signals, "mx": hosts}
    if "counts" in nested.columns:
        header = nested.groupBy("country", "total").agg(F.any_value("counts").alias("counts"))
        tables["header"] = header.select("country", "total", F.explode("counts").alias("provider", "n"))
    return tables


def security_tables(nested: DataFrame) -> dict[str, DataFrame]:
    """Nested security rows as flat flags and MX hosts."""
    key = ["country", "code"]
    flat = nested.select(
        *key, "name", F.coalesce("region", F.lit("")).alias("region"), F.coalesce("domain", F.lit("")).alias("domain"), "scan_valid",
        F.col("dane.supported").alias("dane_supported"), F.col("dane.partial").alias("dane_partial"), "dss.*",
    )
    return {"security": flat, "mx": nested.select(*key, F.explode("mx_records").alias("host"))}


def baseline(nested: DataFrame) -> DataFrame:
    """Baseline rows keyed by ``code``, or by the older ``bfs``."""
    code = F.coalesce("code", "bfs") if "bfs" in nested.columns else F.col("code")
    return nested.select(
        "country", code.alias("code"), "name", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("provider", F.lit("?")).alias("provider"),
        F.coalesce("classification_confidence", F.lit(0.0)).alias("confidence"),
    )


def read_baseline(spark: SparkSession, path: str, country: str) -> DataFrame:
    """Baseline file whose entries are a list, or a map by code in older files."""
    entry = "struct<code:string,bfs:string,name:string,domain:string,provider:string,classification_confidence:double>"
    text = spark.read.text(path, wholetext=True)
    as_list = text.select(F.explode(F.from_json("value", f"struct<municipalities:array<{entry}>>")["municipalities"]).alias("e")).select(F.lit(None).cast("string").alias("key"), "e.*")
    as_map = text.select(F.explode(F.from_json("value", f"struct<municipalities:map<string,{entry}>>")["municipalities"]).alias("key", "e")).select("key", "e.*")
    is_map = text.select(F.get_json_object("value", "$.municipalities").alias("m")).filter(F.startswith(F.ltrim("m"), F.lit("{")))
    # Exactly one of the two parses: an array is no map and the other way round.
    rows = as_list.filter(F.col("provider").isNotNull()).unionByName(as_map.join(is_map.select(F.lit(1)).limit(1), how="left_semi"))
    return baseline(rows.withColumn("country", F.lit(country)).withColumn("code", F.coalesce("code", "bfs", "key")).drop("bfs"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_flat_result(spark: SparkSession, path: str) -> DataFrame:
    """Third-party result: a JSON array whose keys may carry a byte-order mark; all values as text."""
    text = spark.read.text(path, wholetext=True).select(F.replace("value", F.lit("﻿"), F.lit("")).alias("value"))
    entry = "struct<code:string,name:string,emails:string,mxrecordName:string,hasDane:string,hasSpf:string,hasGoodSpf:string,hasDmarc:string,hasGoodDmarc:string>"
    return text.select(F.posexplode(F.from_json("value", f"array<{entry}>")).alias("pos", "e")).select("pos", "e.*")


def read_scan_targets(spark: SparkSession, path: str) -> DataFrame:
    """Scanner input ``{checked_emails: […]}`` as distinct lower-case domains."""
    rows = spark.read.schema("checked_emails array<string>").json(path, multiLine=True)
    address = rows.select(F.explode("checked_emails").alias("address"))
    return address.select(F.lower(F.regexp_replace("address", "^[^@]*@", "")).alias("domain")).distinct()


def read_scan_result(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Scan result files as four tables: addresses, TLS logs, DANE logs, authentication logs."""
    log = "exitCode:int,consoleLog:string"
    schema = (
        "scanTime timestamp, scanData array<struct<domain:string,mxRecord:string,ipAddress:string,adFlagForMx:boolean>>, "
        f"testSSLResult array<struct<host:string,ip:string,{log}>>, daneCheckResult array<struct<host:string,{log}>>, "
        f"dssResult array<struct<domain:string,{log}>>"
    )
    rows = spark.read.schema(schema).json(path, multiLine=True)

    def part(column: str, *fields: Column | str) -> DataFrame:
        return rows.select("scanTime", F.posexplode(column).alias("pos", "x")).select("scanTime", *fields)

    log_column = F.col("x.consoleLog").alias("log")
    host = F.col("x.host")
    return {
        "addresses": part(
            "scanData", F.col("x.domain"), F.col("x.mxRecord").alias("mx"), F.col("x.ipAddress").alias("ip"), F.col("x.adFlagForMx").alias("ad")
        ),
        "tls": part("testSSLResult", "pos", host, F.col("x.ip"), log_column),
        "dane": part("daneCheckResult", "pos", host, log_column),
        "dss": part("dssResult", "pos", F.col("x.domain"), log_column),
    }
