"""Counts, coverage, discovery profile, budgets and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siterank.functions.models import FUND_USD
from siterank.operators.ordering import prefix_counts
from siterank.operators.tables import one_row

# --- fixed values -----------------------------------------------------------
CITATIONS = {
    "dow": {
        "name": "USGS Documented Unplugged Orphaned Oil and Gas Well Dataset",
        "doi": "10.3133/dr1167", "data_doi": "10.5066/P91PJETI",
    },
    "lbnl": {
        "name": "U-Net detected potential Undocumented Orphaned Wells (UOWs) — CA & OK",
        "doi": "10.1021/acs.est.4c04413", "data_doi": "10.18141/2452768", "regions": "CA, OK",
    },
    "unet_appalachia": {"name": "U-Net detections — Appalachia", "regions": "PA, WV, OH, KY"},
    "state_registries": {"name": "State oil & gas well registries (depth/type/status/operator)"},
}
# ----------------------------------------------------------------------------


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, most frequent first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count"), key)


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """Median from the counts of distinct values: mean of the two middle rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    p = prefix_counts(counts, [], "v", "n")
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    covers = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    return p.agg(((F.max(F.when(covers(lo), F.col("v"))) + F.max(F.when(covers(hi), F.col("v")))) / 2).alias("median"))


def discovery_profile(candidates: DataFrame, distance: str = "nearest_doc_well_m") -> DataFrame:
    d = F.col(distance)
    head = candidates.agg(
        F.count(F.lit(1)).alias("total_candidates"), F.count_if(d > 100).alias("gt_100m"),
        F.count_if(d > 500).alias("gt_500m"), F.count_if(d > 1000).alias("gt_1000m"),
        F.max(d).alias("max_nearest_documented_m"),
    )
    med = exact_median(candidates, distance).select(F.col("median").alias("median_nearest_documented_m"))
    return one_row(head, med)


def discovery_by_source(candidates: DataFrame, distance: str = "nearest_doc_well_m") -> DataFrame:
    return candidates.groupBy("source").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col(distance) > 100).alias("gt_100m")
    )


def citation_counts(candidates: DataFrame, prefix: str = "unet_") -> DataFrame:
    own = F.count_if(F.col("well_id").startswith(prefix))
    return candidates.agg(own.alias("own_detections"), (F.count(F.lit(1)) - own).alias("published"))


def coverage(df: DataFrame, metrics: list[str], approximate: bool = False) -> DataFrame:
    """Per metric: share of rows with a value and number of distinct values."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(m).alias(f"c_{m}") for m in metrics],
        *[distinct(m).alias(f"d_{m}") for m in metrics],
    )
    rows = ", ".join(f"'{m}', c_{m}, d_{m}" for m in metrics)
    return one.select("n", F.expr(f"stack({len(metrics)}, {rows}) as (metric, present, distinct_values)")).select(
        "metric", "present", "distinct_values", (F.col("present") / F.col("n")).alias("share")
    )


def duplicate_ids(df: DataFrame, key: str = "well_id") -> DataFrame:
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids")).withColumn("duplicates", F.col("rows") - F.col("ids"))


def budget(scored: DataFrame, fund: int = FUND_USD) -> DataFrame:
    """Total and mean plugging cost against the fund, and CO2e at both horizons."""
    cost = F.col("plug_cost.point_usd")
    return scored.agg(
        F.count(F.lit(1)).alias("sites"), F.sum(cost).alias("total_usd"), F.avg(cost).alias("mean_usd"),
        F.sum("methane.t_co2e_gwp100_point").alias("t_co2e_gwp100"), F.sum("methane.t_co2e_gwp20_point").alias("t_co2e_gwp20"),
    ).withColumns({"fund_usd": F.lit(fund), "share_of_fund": F.col("total_usd") / F.lit(float(fund))})


def affordable(scored: DataFrame, fund: int = FUND_USD, block: int = 1 << 16, cost: str = "plug_cost.point_usd") -> DataFrame:
    """How many sites the fund covers in rank order: running cost by rank blocks, then inside one block."""
    from pyspark.sql import Window as W

    r = scored.select(F.col("rank"), F.col(cost).cast("long").alias("cost")).withColumn("blk", F.floor(F.col("rank") / block))
    per = r.groupBy("blk").agg(F.sum("cost").alias("c"))
    w = W.orderBy("blk").rowsBetween(W.unboundedPreceding, -1)  # one row per 65 536 sites
    base = per.select("blk", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("base"))
    inner = W.partitionBy("blk").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    run = r.join(base, "blk").withColumn("spent", F.col("base") + F.sum("cost").over(inner))
    return run.agg(F.count_if(F.col("spent") <= fund).alias("sites_funded"), F.max(F.when(F.col("spent") <= fund, F.col("spent"))).alias("spent_usd"))


def known_points(frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all known points, count per source); an empty total is an error, as nothing could be excluded."""
    from siterank.operators.tables import union_all

    points = union_all([f.withColumn("known_source", F.lit(n)) for n, f in frames.items()])
    if not points.take(1):
        raise ValueError("no known sites were loaded")
    return points, points.groupBy("known_source").agg(F.count(F.lit(1)).alias("points"))


def dataset_summary(documented: DataFrame, candidates: DataFrame, consolidated: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One nested row: counts, counts by state and region, citations with their numbers."""
    def table(df, key, out):
        c = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return c.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n"))))).alias(out))

    parts = [
        documented.agg(F.count(F.lit(1)).alias("documented_count")),
        candidates.agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("well_id").startswith("unet_")).alias("__own")),
        consolidated.agg(F.count(F.lit(1)).alias("consolidated_count")),
        table(documented, "state", "documented_by_state"),
        table(candidates, "county_group", "candidate_by_region"),
    ]
    if stats is not None:
        parts.append(stats)
    one = one_row(*parts)
    numbers = {
        "dow": F.col("documented_count"), "lbnl": F.col("candidate_count") - F.col("__own"), "unet_appalachia": F.col("__own"),
        "state_registries": F.col("state_wells") if stats is not None else F.lit(None).cast("long"),
    }
    cites = F.struct(
        *[F.struct(*[F.lit(v).alias(k) for k, v in CITATIONS[c].items()], numbers[c].alias("n")).alias(c) for c in CITATIONS]
    )
    return one.withColumns({"citations": cites, "generated_utc": F.current_timestamp()}).drop("__own")
