"""State registries: field maps, coordinate choice, normalisation and the on-mission filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siterank.functions import text as tx
from siterank.operators.tables import project_fields, union_all

# --- fixed values: source columns of each registry --------------------------
CANONICAL = ["api", "lat", "lon", "type", "status", "operator", "depth"]
REGISTRIES = {
    "OH": {
        "mode": "rest",
        "where": ["Orphan", "Plugged", "Idle and Orphan", "Abandoned", "Idle", "Temporarily Abandoned"],
        "fieldmap": {
            "API_WELLNO": "api", "TOTAL_DEPTH": "depth", "WELL_STATUS_DESCRIPTION": "status",
            "WELL_TYPE": "type", "COMPANY_NAME": "operator",
        },
    },
    "WV": {
        "mode": "rest",
        "fieldmap": {
            "API": "api", "WellDepth": "depth", "Status": "status", "WellType": "type", "Operator": "operator",
        },
    },
    "PA": {
        "mode": "rest",
        "fieldmap": {"API": "api", "WELL_STATU": "status", "WELL_TYPE": "type", "OPERATOR": "operator"},
    },
    "NY": {
        "mode": "bulk",
        "format": "json",
        "fieldmap": {
            "api_well_number": "api", "true_vertical_depth": "depth", "well_status": "status", "well_type": "type",
            "company_name": "operator", "surface_latitude": "lat", "surface_longitude": "lon",
        },
    },
    "KY": {
        "mode": "bulk",
        "format": "shp",
        "fieldmap": {
            "API_NUMBER": "api", "TOTAL_DEPT": "depth", "STATUS": "status", "WELL_TYPE": "type", "OPERATOR": "operator",
        },
    },
}
# ----------------------------------------------------------------------------


def source_filter(raw: DataFrame, config: dict) -> DataFrame:
    """Status predicate of the source; on Parquet it is pushed into the scan."""
    wanted = config.get("where")
    if not wanted:
        return raw
    status = next(s for s, d in config["fieldmap"].items() if d == "status")
    return raw.where(F.col(f"`{status}`").isin(wanted))


def normalize_registry(raw: DataFrame, config: dict, abbr: str | None = None) -> DataFrame:
    """Canonical rows of one registry; rows without coordinates or with another status are dropped.

    Mapped coordinate columns are used when the source has both, else the geometry columns
    ``__lat`` and ``__lon``: one choice per source, not per row.
    """
    fm = config["fieldmap"]
    back = {d: s for s, d in fm.items()}
    mapped = all(back.get(c) in raw.columns for c in ("lat", "lon"))
    if not mapped and "__lat" in raw.columns:
        fm = {**{s: d for s, d in fm.items() if d not in ("lat", "lon")}, "__lat": "lat", "__lon": "lon"}
    keep = [c for c in ("ordinal",) if c in raw.columns]
    named = project_fields(raw, fm, CANONICAL, keep)
    out = named.select(
        tx.normalize_api("api").alias("api"),
        tx.to_double("lat").alias("lat"),
        tx.to_double("lon").alias("lon"),
        tx.classify_type("type").alias("type"),
        tx.classify_status("status").alias("status"),
        tx.normalize_operator("operator").alias("operator"),
        tx.normalize_depth("depth").alias("depth"),
        *keep,
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("status").isin(tx.STATUS_KEPT))
    return out.withColumn("state_abbr", F.lit(abbr)) if abbr else out


def build_registries(raw_by_state: dict[str, DataFrame], configs: dict | None = None) -> DataFrame:
    configs = configs or REGISTRIES
    return union_all(
        [normalize_registry(source_filter(df, configs[st]), configs[st], st) for st, df in raw_by_state.items() if st in configs]
    )
