"""Files of JSON arrays, keyed objects and feature collections, written from the given tables and read in splits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siterank.catalog.base import points, query, sql_points, table
from siterank.session import ensure_checkpoint_dir
from siterank.sources import readers

#: Records of a file.
PER_FILE = 5000
#: Signs that a reader must not take for borders, behind every name.
SIGNS, SQL_SIGNS = '}"{[\\', "'}\"{[\\'"


def written(df: DataFrame, key: str, element: Column, begin: str, end: str) -> str:
    """Each file holds one text: ``begin``, the elements and ``end``."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/files-{uuid.uuid4().hex}"
    files = df.count() // PER_FILE + 1
    texts = df.groupBy(F.pmod(F.xxhash64(key), F.lit(files)).alias("file")).agg(F.concat(F.lit(begin), F.array_join(F.collect_list(element), ",\n"), F.lit(end)).alias("value"))
    texts.write.partitionBy("file").text(path)
    return path


def named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.concat("c_name", F.lit(SIGNS)).alias("name"), F.col("c_acctbal").cast("double").alias("balance"))


@query("records_in_arrays", f"select c_custkey::bigint as id, c_name || {SQL_SIGNS} as name, c_acctbal::double as balance from customer")
def records_in_arrays(spark, d):
    path = written(named(spark, d), "id", F.to_json(F.struct("id", "name", "balance")), "[", "]")
    return readers.read_records(spark, path, "id long, name string, balance double")


@query("records_by_key", f"select 'k' || c_custkey::varchar || {SQL_SIGNS} as well_id, c_name || {SQL_SIGNS} as name, c_acctbal::double as balance from customer")
def records_by_key(spark, d):
    keyed = named(spark, d).withColumn("key", F.concat(F.lit("k"), F.col("id").cast("string"), F.lit(SIGNS)))
    # a key in quotes and escapes: that of a record of its own, without braces and name
    quoted = F.regexp_extract(F.to_json(F.struct("key")), r"(?s)^\{\"key\":(.*)\}$", 1)
    path = written(keyed, "id", F.concat(quoted, F.lit(": "), F.to_json(F.struct("name", "balance"))), "{\n", "}")
    return readers.read_keyed(spark, path, "name string, balance double")


@query("points_in_collections", f"with s as ({sql_points('supplier', 's_suppkey')}) select ordinal as key, {SQL_SIGNS} as name, lon, lat from s")
def points_in_collections(spark, d):
    sites = points(spark, d, "supplier", "s_suppkey")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("ordinal").alias("key"), F.lit(SIGNS).alias("name")).alias("properties"), geometry.alias("geometry")))
    begin = '{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}, "features": ['
    path = written(sites, "ordinal", feature, begin, "]}")
    return readers.read_geojson_points(spark, path, "struct<key:long,name:string>").select("key", "name", "lon", "lat")
