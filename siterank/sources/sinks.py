"""Writers for the serving and landing zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from siterank.functions.numeric import nan_to_null, round_exact
from siterank.operators.ordering import keep_first
from siterank.operators.tables import one_row
from siterank.plans.score import SHARD_SIZE, slim, with_shard


def write_partition(df: DataFrame, path: str, column: str) -> None:
    """Replace only the partitions present in ``df`` (state pulls, one provenance of the candidates)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_slim(scored: DataFrame, path: str) -> None:
    """Compact JSON lines; null fields are left out."""
    slim(scored).write.mode("overwrite").json(path)


def shard_rows(scored: DataFrame, size: int = SHARD_SIZE) -> DataFrame:
    """One row per id and shard; of equal ids the last one stays."""
    return keep_first(with_shard(scored, size), ["shard", "well_id"], F.col("rank").desc())


def write_shards(scored: DataFrame, path: str, size: int = SHARD_SIZE, form: str = "parquet") -> dict:
    """Detail records by rank bucket.  Old shards vanish; the total is checked against the ids."""
    rows = nan_to_null(shard_rows(scored, size))
    # ranges of shards, so that a shard is written by one task, or by two at a border
    rows.repartitionByRange("shard").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").format(form).save(path)
    spark = scored.sparkSession
    back = spark.read.format(form).load(path)
    check = back.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("shard").alias("shards")).first()
    ids = scored.select("well_id").distinct().count()
    if check["rows"] != ids:
        raise ValueError(f"shards hold {check['rows']} records for {ids} distinct ids")
    return {"rows": check["rows"], "shards": check["shards"], "ids": ids}


def read_detail(spark: SparkSession, path: str, ids: DataFrame, size: int = SHARD_SIZE) -> DataFrame:
    """Detail records of (well_id, rank) rows; the shard key prunes the partitions that are read."""
    wanted = with_shard(ids, size).select("well_id", "shard")
    return spark.read.parquet(path).join(wanted, ["shard", "well_id"])


def encode_columnar(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Legends plus index arrays, one row per block of a million sites; coordinates to five decimals.

    The legends cover the whole table.  Blocks keep every array bounded; ``block`` orders them.
    """
    def legend(c, out):
        return df.where(F.col(c).isNotNull()).agg(F.array_sort(F.collect_set(c)).alias(out))

    legends = one_row(legend("state", "state_legend"), legend("type_norm", "type_legend"), legend("status_norm", "status_legend"))
    maps = legends.select(
        *[F.col(f"{n}_legend") for n in ("state", "type", "status")], F.lit(1).alias("__k")
    )
    rows = df.withColumn("__k", F.lit(1)).join(F.broadcast(maps), "__k")  # one row of short vocabularies

    def idx(c, lg):
        return F.coalesce(F.array_position(lg, F.col(c)) - 1, F.lit(-1)).cast("int")

    tagged = rows.select(
        F.shiftright(F.col(ordinal).cast("long"), 20).alias("block"),
        F.struct(
            F.col(ordinal).alias("o"), round_exact("lon", 5).alias("lon"), round_exact("lat", 5).alias("lat"),
            idx("state", "state_legend").alias("s"), idx("type_norm", "type_legend").alias("t"),
            idx("status_norm", "status_legend").alias("u"),
        ).alias("r"),
    )
    g = tagged.groupBy("block").agg(
        F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("r")).alias("rs"),
    ).withColumn("__k", F.lit(1)).join(F.broadcast(maps), "__k")
    names = {"lon": "lon", "lat": "lat", "s": "state_idx", "t": "type_idx", "u": "status_idx"}
    return g.select(
        "block", "count", "state_legend", "type_legend", "status_legend",
        *[F.col(f"rs.{k}").alias(n) for k, n in names.items()],
    )


def feature_lines(df: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per line."""
    f = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return df.select(F.to_json(f, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, properties: list[str]) -> None:
    feature_lines(df, properties).write.mode("overwrite").text(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_failures(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_keyed(df: DataFrame, path: str) -> None:
    """Case files, dossiers and featured rows: one table each, keyed by well_id."""
    nan_to_null(df).write.mode("overwrite").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def publish(spark: SparkSession, tables: dict[str, str], target: str, skip: list[str] = ("candidates_scored",)) -> list[str]:
    """Copy tables into the serving zone, replacing what was there; archive tables stay behind."""
    done = []
    for name, path in tables.items():
        if name in skip:
            continue
        spark.read.parquet(path).write.mode("overwrite").parquet(f"{target}/{name}")
        done.append(name)
    return done
