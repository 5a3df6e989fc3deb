"""Score sites: context models, percentile metrics, composite, ranks and serving projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siterank.functions import models
from siterank.functions.numeric import nan_to_null, round_exact
from siterank.operators.ordering import global_position, prefix_counts, with_rank_shares
from siterank.session import cut_lineage

# --- fixed values -----------------------------------------------------------
METRICS = {
    "population": "pct",
    "schools": "pct",
    "hospitals": "pct",
    "drinking_water": "pct",
    "svi": "pct",
    "ej": "pct",
}
WEIGHTS = {
    "population": 0.30,
    "schools": 0.15,
    "drinking_water": 0.15,
    "hospitals": 0.10,
    "svi": 0.15,
    "ej": 0.15,
}
GROUPS = {
    "human_exposure": ["population", "schools", "hospitals", "drinking_water"],
    "equity": ["svi", "ej"],
}
SLIM_ENRICHMENT = [
    "population", "population_1mi", "schools_within_1mi", "nearest_school_m", "nearest_school", "county",
]
SHARD_SIZE = 1000
# ----------------------------------------------------------------------------

ENRICHMENT_TYPES = {
    "population": "bigint", "daytime_population": "bigint", "population_1mi": "bigint", "svi": "double",
    "svi_socioeconomic": "double", "svi_minority": "double", "poverty_pct": "double", "minority_pct": "double",
    "ej": "double", "eji_rank": "double", "cejst_disadvantaged": "boolean", "county": "string",
    "tract_geoid": "string", "schools_within_1mi": "bigint", "nearest_school": "string",
    "nearest_school_m": "double", "school_names": "array<string>", "hospitals_within_5mi": "bigint",
    "nearest_hospital_m": "double", "drinking_water_score": "double",
}
EVENT_TYPES = {
    "super_emitter": "boolean", "super_emitter_dist_m": "double", "super_emitter_rate_kg_hr": "double",
}


def _or_null(df: DataFrame, types: dict[str, str]) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]


def build_records(base: DataFrame, enrichment: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Base rows with methane, plug_cost, carbon, enrichment and metrics structs.

    A missing sidecar simply leaves its columns null.
    """
    df = base
    if enrichment is not None:
        e = enrichment.select("well_id", F.struct(*_or_null(enrichment, ENRICHMENT_TYPES)).alias("enrichment"))
        df = df.join(e, "well_id", "left")
    else:
        df = df.withColumn(
            "enrichment", F.struct(*[F.lit(None).cast(t).alias(c) for c, t in ENRICHMENT_TYPES.items()])
        )
    if events is not None:
        df = df.join(events.select("well_id", F.struct(*_or_null(events, EVENT_TYPES)).alias("__ev")), "well_id", "left")
    else:
        df = df.withColumn("__ev", F.struct(*[F.lit(None).cast(t).alias(c) for c, t in EVENT_TYPES.items()]))

    depth = F.col("depth_ft") if "depth_ft" in base.columns else F.lit(None).cast("double")
    df = df.withColumn("__known", models.plugged_state("status_norm", "is_plugged"))
    df = models.with_methane(
        df, "__known", "state_abbr", "type_norm", None,
        F.col("__ev.super_emitter"), F.col("__ev.super_emitter_dist_m"), F.col("__ev.super_emitter_rate_kg_hr"),
    )
    df = models.with_plug_cost(df, "type_norm", depth, None, models.cost_index("state_abbr"))
    flagged = F.coalesce(F.col("methane.super_emitter"), F.lit(False))
    tonnes = F.when(flagged, F.col("methane.t_co2e_gwp100_high")).otherwise(F.col("methane.t_co2e_gwp100_point"))
    df = models.with_carbon(df, tonnes, "plug_cost.point_usd", flagged)
    e = F.col("enrichment")
    return df.withColumn(
        "metrics",
        F.struct(
            F.coalesce(e["population_1mi"], e["population"]).cast("double").alias("population"),
            e["schools_within_1mi"].cast("double").alias("schools"),
            e["hospitals_within_5mi"].cast("double").alias("hospitals"),
            e["drinking_water_score"].alias("drinking_water"),
            e["svi"].alias("svi"),
            F.coalesce(e["eji_rank"], e["ej"]).alias("ej"),
        ),
    ).drop("__ev", "__known")


def _check_weights(weights: dict[str, float], modes: dict[str, str]) -> None:
    unknown = [k for k in weights if k not in modes]
    if unknown:
        raise ValueError(f"unknown metric in weights: {unknown}")


def composite_columns(df: DataFrame, weights: dict[str, float] | None = None, norm_suffix: str = "_norm") -> DataFrame:
    """composite, part_<metric> and group_<group> from the normalised columns; missing metrics drop out."""
    weights = weights or WEIGHTS
    norm = {k: f"`{k}{norm_suffix}`" for k in weights}
    present = " + ".join(f"if({norm[k]} is null, 0.0D, {float(w)!r}D)" for k, w in weights.items())
    weighted = " + ".join(f"coalesce({float(w)!r}D * {norm[k]}, 0.0D)" for k, w in weights.items())
    df = df.selectExpr("*", f"0.0D + {weighted} as __s", f"0.0D + {present} as __w0")
    df = df.selectExpr("*", "if(__w0 = 0, 1.0D, __w0) as __w")
    df = df.selectExpr(
        "*", "__s / __w * 100.0D as __c",
        *[f"{float(w)!r}D * {norm[k]} / __w * 100.0D as __p_{k}" for k, w in weights.items()],
    )
    df = df.withColumns(
        {"composite": round_exact("__c", 1), **{f"part_{k}": round_exact(f"__p_{k}", 2) for k in weights}}
    )
    sums = [
        "0.0D" + "".join(f" + coalesce(part_{k}, 0.0D)" for k in members if k in weights) + f" as __g_{g}"
        for g, members in GROUPS.items()
    ]
    df = df.selectExpr("*", *sums).withColumns({f"group_{g}": round_exact(f"__g_{g}", 2) for g in GROUPS})
    return df.drop("__w", "__w0", "__s", "__c", *[f"__p_{k}" for k in weights], *[f"__g_{g}" for g in GROUPS])


def score_block(weights: dict[str, float]) -> Column:
    keys = list(weights)

    def named(text):
        return ", ".join(f"'{k}', {text(k)}" for k in keys)

    groups = ", ".join(f"'{g}', group_{g}" for g in GROUPS)
    present = ", ".join(f"if({k}_norm is null, null, '{k}')" for k in keys)
    missing = ", ".join(f"if({k}_norm is null, '{k}', null)" for k in keys)
    return F.expr(
        "named_struct('composite', composite, "
        f"'breakdown', map_filter(map({named(lambda k: f'part_{k}')}), (k, v) -> v is not null), "
        f"'group_breakdown', map({groups}), "
        f"'normalized', map({named(lambda k: f'{k}_norm')}), "
        f"'present_metrics', array_compact(array({present})), "
        f"'missing_metrics', array_compact(array({missing})), "
        f"'weights', map({named(lambda k: f'{float(weights[k])!r}D')}))"
    )


def score_metrics(df: DataFrame, weights: dict[str, float] | None = None,
                  modes: dict[str, str] | None = None) -> DataFrame:
    """Normalise the metric columns of ``df`` and add the composite columns."""
    weights, modes = weights or WEIGHTS, modes or METRICS
    _check_weights(weights, modes)
    normed = with_rank_shares(df, {k: (k, modes[k]) for k in weights})
    return composite_columns(normed, weights)


def score_sites(records: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``score``, ``global_rank`` and ``rank`` to records that have ``metrics`` and ``ordinal``.

    All rows share one distribution.  ``rank`` leaves out the featured layer, whose rows keep
    their global rank.
    """
    weights = weights or WEIGHTS
    # only the narrow metric and score columns are written for the several passes over them
    featured = F.coalesce(F.col("layer") == "hero", F.lit(False))
    flat = records.select("ordinal", featured.alias("featured"), "metrics.*")
    groups = [f"group_{g}" for g in GROUPS]
    scored = cut_lineage(
        score_metrics(flat, weights)
        .select("ordinal", "featured", "composite", *[c for k in weights for c in (f"part_{k}", f"{k}_norm")], *groups)
    )
    narrow = scored.select("ordinal", "featured", "composite")
    keys = ["ordinal", "featured"]
    overall = global_position(narrow, "composite", "ordinal", "global_rank", ties=("featured",)).select(*keys, "global_rank")
    listed = global_position(narrow.where("not featured"), "composite", "ordinal", "rank").select(*keys, "rank")
    ranks = (
        # the maps of the score are made from the columns only where they are asked for
        scored.withColumn("score", score_block(weights)).select(*keys, "score").join(overall, keys).join(listed, keys, "left")
        .withColumn("rank", F.coalesce("rank", "global_rank"))
    )
    # both layers may number their rows from 0
    return (
        records.withColumn("__f", featured).join(ranks.withColumnRenamed("featured", "__f"), ["ordinal", "__f"]).drop("__f")
    )


def composite_summary(scored: DataFrame) -> DataFrame:
    """Smallest, middle and largest composite; the middle is element n div 2 of the descending list.  One row for any input."""
    counts = scored.select((-F.col("score.composite")).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    at = F.floor(F.col("total") / 2)
    covers = (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    return prefix_counts(counts, [], "v", "n").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (-F.max("v")).alias("lowest"), (-F.max(F.when(covers, F.col("v")))).alias("middle"), (-F.min("v")).alias("highest")
    )


# --- serving ----------------------------------------------------------------
def slim(scored: DataFrame) -> DataFrame:
    """Small projection for maps and lists; nulls vanish when it is written as JSON."""
    enrichment = F.struct(*[F.col(f"enrichment.{c}").alias(c) for c in SLIM_ENRICHMENT])
    any_value = F.coalesce(*[F.col(f"enrichment.{c}").cast("string") for c in SLIM_ENRICHMENT]).isNotNull()
    cols = [
        "well_id", "rank",
        round_exact("lat", 5).alias("lat"), round_exact("lon", 5).alias("lon"),
        "name", "quad_name", "county_group", "state", "source",
        F.struct(F.col("score.composite").alias("composite")).alias("score"),
        F.when(any_value, enrichment).alias("enrichment"),
    ]
    if "hero" in scored.columns:
        cols.append(F.struct("hero.title", "hero.place", "hero.confirmed").alias("hero"))
    return nan_to_null(scored.select(*cols))


def with_shard(scored: DataFrame, size: int = SHARD_SIZE) -> DataFrame:
    return scored.withColumn("shard", F.floor((F.col("rank") - 1) / size).cast("int"))
