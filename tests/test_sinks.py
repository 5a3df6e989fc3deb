import glob

from pyspark.sql import functions as F

from siterank.sources import sinks


def scored(spark, n: int):
    return spark.range(n).select(
        F.concat(F.lit("w"), F.col("id").cast("string")).alias("well_id"), (F.col("id") + 1).alias("rank"), F.col("id").alias("ordinal"),
        (F.col("id") % 7 / 10.0 + 40).alias("lat"), (-F.col("id") % 5 / 10.0 - 80).alias("lon"),
        F.when(F.col("id") % 3 == 0, "OH").otherwise("PA").alias("state"), F.when(F.col("id") % 4 != 0, "gas").alias("type_norm"), F.lit("idle").alias("status_norm"),
    )


def test_shards_round_trip_and_few_files(spark, tmp_path):
    path = str(tmp_path / "s")
    got = sinks.write_shards(scored(spark, 500).repartition(16), path, size=50)
    assert got == {"rows": 500, "shards": 10, "ids": 500}
    assert len(glob.glob(f"{path}/shard=*/*.parquet")) <= 20
    wanted = scored(spark, 500).where("rank in (1, 50, 51, 500)").select("well_id", "rank")
    assert sorted(r.well_id for r in sinks.read_detail(spark, path, wanted, size=50).collect()) == ["w0", "w49", "w499", "w50"]
    assert sinks.write_shards(scored(spark, 60), path, size=50)["shards"] == 2


def test_columnar_form_decodes(spark):
    row = sinks.encode_columnar(scored(spark, 20)).first()
    assert row["count"] == 20 and row["state_legend"] == ["OH", "PA"] and row["type_legend"] == ["gas"]
    assert [row["state_legend"][i] for i in row["state_idx"]] == ["OH" if i % 3 == 0 else "PA" for i in range(20)]
    assert [i for i, x in enumerate(row["type_idx"]) if x == -1] == [0, 4, 8, 12, 16]
