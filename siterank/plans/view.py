"""The ranked list a user filters, searches and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siterank.operators.ordering import global_position

# --- fixed values -----------------------------------------------------------
VIEW_STATES = ["Ohio", "Pennsylvania", "West Virginia", "Kentucky"]
REGION_PATTERN = r"_(PA|OH|WV|KY)$"
SEARCHED = ["quad_name", "state", "enrichment.nearest_school", "enrichment.county"]
SWARM_ROWS = 12
# ----------------------------------------------------------------------------


def sort_value(sort: str):
    """Number to sort descending by."""
    e = F.col("enrichment")
    if sort == "population":
        return F.coalesce(e["population_1mi"], e["population"], F.lit(0)).cast("double")
    if sort == "schools":
        return F.coalesce(e["schools_within_1mi"], F.lit(0)).cast("double")
    return -F.col("rank").cast("double")


def matches(query: str, columns: list[str] = tuple(SEARCHED)):
    """Any of the columns contains the query, ignoring case; a null column never matches."""
    q = query.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False))
    return hit


def ranked_view(candidates: DataFrame, featured: DataFrame, region: str = "all", query: str = "", sort: str = "impact",
                states: list[str] = tuple(VIEW_STATES)) -> DataFrame:
    """Sites of the view with ``section`` (0 featured, 1 list) and 1-based ``position``.

    Featured rows come first, and only when nothing is filtered.  Ties keep the ordinal order.
    """
    rows = candidates.where(F.col("state").isin(list(states))).join(featured.select("well_id"), "well_id", "left_anti")
    if region != "all":
        rows = rows.where(F.col("county_group") == region)
    if query.strip():
        rows = rows.where(matches(query))
    listed = global_position(rows.withColumn("__sort", sort_value(sort)), "__sort", "ordinal", "position").drop("__sort")
    listed = listed.withColumn("section", F.lit(1))
    if region == "all" and not query.strip():
        n = featured.count()
        lead = global_position(featured.withColumn("__sort", F.lit(0.0)), "__sort", "ordinal", "position").drop("__sort")
        lead = lead.select(*[c for c in listed.columns if c not in ("section",)]).withColumn("section", F.lit(0))
        listed = lead.unionByName(listed.withColumn("position", F.col("position") + n).select(*lead.columns))
    return listed


def view_regions(meta_regions: DataFrame, column: str = "county_group") -> DataFrame:
    return meta_regions.where(F.col(column).rlike(REGION_PATTERN))


def replay_rows(candidates: DataFrame, dossiers: DataFrame, n: int = SWARM_ROWS) -> DataFrame:
    """First rows that have a finished record, else simply the first rows."""
    done = dossiers.where(F.coalesce("narrative", F.lit("")) != "").select("well_id")
    finished = candidates.join(done, "well_id", "left_semi").orderBy("rank").limit(n)
    return finished if finished.take(1) else candidates.orderBy("rank").limit(n)
