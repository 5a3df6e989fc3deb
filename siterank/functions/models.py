"""Emission, plugging-cost, credit and funding models.

Values that are rounded or used several times become columns first, so that the optimizer does
not repeat long expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siterank.functions.numeric import round_exact, round_hundreds, round_int, round_once, with_rounded

# --- fixed values: emission model -------------------------------------------
HOURS_PER_YEAR = 8760
GWP100 = 30
GWP20 = 84
APPALACHIA_STATES = ["OH", "PA", "WV", "NY", "KY", "TN"]
UNPLUGGED_FRACTION = 0.69
BAND_LOW, BAND_HIGH = 0.10, 3.25
# g CH4 per hour by region, status, type
EMISSION_FACTORS = {
    ("appalachia", "unplugged", "unknown"): 30.57,
    ("appalachia", "plugged", "unknown"): 0.36,
    ("appalachia", "unplugged", "gas"): 75.0,
    ("appalachia", "plugged", "gas"): 47.0,
    ("appalachia", "unplugged", "oil"): 0.30,
    ("appalachia", "plugged", "oil"): 0.30,
    ("rest_us", "unplugged", "unknown"): 10.02,
    ("rest_us", "plugged", "unknown"): 0.002,
    ("rest_us", "unplugged", "gas"): 75.0,
    ("rest_us", "plugged", "gas"): 0.10,
    ("rest_us", "unplugged", "oil"): 0.30,
    ("rest_us", "plugged", "oil"): 0.002,
}
METHANE_LABEL = "modeled estimate (EPA GHGI × Kang 2016 region/status/type); heavy right tail"
METHANE_UNDIFFERENTIATED = " — undifferentiated (type+status unknown)"
METHANE_EVENT = " — EPA super-emitter nearby"
# --- fixed values: plugging cost --------------------------------------------
PLUG_ONLY_USD = 20_000
RECLAMATION_USD = 76_000
SENSITIVITY_USD = 35_000
GAS_FACTOR = 1.09
DEPTH_FACTOR_1000FT = 1.20
ELEVATION_FACTOR_10FT = 1.03
HIGH_FACTOR = 1.6
STATE_COST_INDEX = {"CA": 1.25, "AK": 1.4}
# --- fixed values: credits --------------------------------------------------
CREDIT_YEARS = 10
BUFFER_POOL = 0.15
PRICE_LOW, PRICE_POINT, PRICE_HIGH = 10.0, 15.0, 30.0
CREDIT_LABEL = "ACR orphan-well methodology, GWP-100; nascent two-tier market"
FUND_USD = 4_700_000_000
# --- fixed values: pathway texts --------------------------------------------
PATHWAY_TEXTS = {
    "federal_bil": (
        "Federal BIL / IIJA orphan-well program",
        "State receives Bipartisan Infrastructure Law formula grants from the $4.7B federal orphan-well fund",
        "Months–years (state plugging queue once the well is registered)",
        "state_regulator",
    ),
    "state_program": (
        "State orphan/abandoned-well plugging program",
        "State regulator runs the plugging program and the bid queue.",
        "Months–years",
        "state_regulator",
    ),
    "carbon_credit": (
        "Carbon-credit-funded plugging (ACR methodology)",
        "High modeled methane makes this a candidate for self-funding via carbon credits, like Zefiro's "
        "ACR959 (one well ≈ 92,956 t CO₂e). Requires measured pre-plug flux + additionality.",
        "Quarters (measure → plug → verify → issue credits)",
        "carbon_developer",
    ),
    "charity": (
        "Charity adopt-a-well (Well Done Foundation / Orphan Well Cooperative)",
        "Methane-first, high-exposure site fits adopt-a-well selection.",
        "Months (sponsor-dependent)",
        "charity",
    ),
    "landowner": (
        "Landowner-funded plugging",
        "A named surface owner can plug for access/liability reasons.",
        "Variable",
        "surface_owner",
    ),
}
DISADVANTAGED_SUFFIX = " — Justice40 prioritizes this disadvantaged community."
NEAR_PEOPLE_POPULATION = 1000
# ----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def region_of(region, state) -> Column:
    return (
        F.when(_c(region).isin("appalachia", "rest_us"), _c(region))
        .when(F.upper(_c(state)).isin(APPALACHIA_STATES), "appalachia")
        .otherwise("rest_us")
    )


def type_key(well_type) -> Column:
    t = F.lower(F.regexp_replace(_c(well_type), r"^\s+|\s+$", ""))
    return F.when(t.isin("gas", "oil_gas", "oilgas", "oil_and_gas"), "gas").when(t == "oil", "oil").otherwise("unknown")


def plugged_state(status, plugged) -> Column:
    """True, false, or null when the status says nothing."""
    return F.when(
        _c(status).isNull() | _c(status).isin("undocumented", "unknown"), None
    ).otherwise(F.coalesce(_c(plugged), F.lit(False)))


def emission_factor(region: Column, status: str, kind: Column) -> Column:
    out = None
    for (r, s, k), v in EMISSION_FACTORS.items():
        if s != status:
            continue
        cond = (region == r) & (kind == k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out


def with_methane(df: DataFrame, plugged: Column, state=None, well_type=None, region=None, flag=None,
                 flag_dist=None, flag_rate=None, unplugged_fraction: float = UNPLUGGED_FRACTION,
                 out: str = "methane") -> DataFrame:
    """Add the low / point / high band by region, status and type, with the CO2-equivalents.

    A null ``plugged`` means the status is unknown and blends both cells.
    """
    nul = F.lit(None).cast("string")
    df = df.withColumns(
        {
            "__plugged": _c(plugged),
            "__region": region_of(nul if region is None else region, nul if state is None else state),
            "__kind": type_key(nul if well_type is None else well_type),
            "__flag": F.lit(None).cast("boolean") if flag is None else _c(flag),
            "__dist": F.lit(None).cast("double") if flag_dist is None else _c(flag_dist),
            "__rate": F.lit(None).cast("double") if flag_rate is None else _c(flag_rate),
        }
    )
    region_c, kind, plugged_c = F.col("__region"), F.col("__kind"), F.col("__plugged")
    up, down = emission_factor(region_c, "unplugged", kind), emission_factor(region_c, "plugged", kind)
    df = df.withColumn(
        "__point",
        F.when(plugged_c.isNull(), F.lit(unplugged_fraction) * up + F.lit(1.0 - unplugged_fraction) * down)
        .when(plugged_c, down)
        .otherwise(up),
    )
    point = F.col("__point")
    bands = {"point": point, "low": point * BAND_LOW, "high": point * BAND_HIGH}

    def tonnes(g):
        return g * F.lit(float(HOURS_PER_YEAR)) / F.lit(1e6)

    values = {f"g_per_hr_{b}": (bands[b], 4) for b in ("point", "low", "high")}
    values |= {f"t_ch4_per_yr_{b}": (tonnes(bands[b]), 4) for b in ("point", "low", "high")}
    values |= {f"t_co2e_gwp100_{b}": (tonnes(bands[b]) * GWP100, 3) for b in ("point", "low", "high")}
    values["t_co2e_gwp20_point"] = (tonnes(point) * GWP20, 3)
    values["super_emitter_dist_m"] = (F.col("__dist"), 1)
    df = with_rounded(df, {f"__{n}": v for n, v in values.items()})
    differentiated = ~((kind == "unknown") & plugged_c.isNull())
    label = F.concat(
        F.lit(METHANE_LABEL),
        F.when(differentiated, "").otherwise(METHANE_UNDIFFERENTIATED),
        F.when(F.coalesce(F.col("__flag"), F.lit(False)), METHANE_EVENT).otherwise(""),
    )
    numbers = [n for n in values if n != "super_emitter_dist_m"]
    block = F.struct(
        *[F.col(f"__{n}").alias(n) for n in numbers],
        F.coalesce(plugged_c, F.lit(False)).alias("plugged"),
        region_c.alias("region"),
        kind.alias("well_type"),
        plugged_c.isNotNull().alias("status_known"),
        differentiated.alias("differentiated"),
        F.col("__flag").alias("super_emitter"),
        F.col("__super_emitter_dist_m").alias("super_emitter_dist_m"),
        F.col("__rate").alias("super_emitter_rate_kg_hr"),
        label.alias("label"),
    )
    return df.withColumn(out, block).drop(
        *[f"__{n}" for n in values], "__plugged", "__region", "__kind", "__flag", "__dist", "__rate", "__point"
    )


def cost_index(state) -> Column:
    out = None
    for k, v in STATE_COST_INDEX.items():
        out = F.when(_c(state) == k, F.lit(v)) if out is None else out.when(_c(state) == k, F.lit(v))
    return out.otherwise(F.lit(1.0))


def with_plug_cost(df: DataFrame, well_type, depth_ft=None, elevation_change_ft=None, index=1.0,
                   out: str = "plug_cost") -> DataFrame:
    """Add the plugging cost: base amounts times state index, depth, elevation and gas factors."""
    is_gas = F.coalesce(_c(well_type).isin("gas", "oil_gas"), F.lit(False))
    df = df.withColumns(
        {
            "__depth": F.lit(None).cast("double") if depth_ft is None else _c(depth_ft),
            "__elev": F.lit(None).cast("double") if elevation_change_ft is None else _c(elevation_change_ft),
            "__index": F.lit(float(index)) if isinstance(index, (int, float)) else index,
            "__gas": is_gas,
        }
    )
    depth, elev = F.col("__depth"), F.col("__elev")
    df = df.withColumns(
        {
            "__f_depth": F.when(F.coalesce(depth, F.lit(0.0)) != 0, F.pow(F.lit(DEPTH_FACTOR_1000FT), depth / 1000.0)).otherwise(1.0),
            "__f_elev": F.when(F.coalesce(elev, F.lit(0.0)) != 0, F.pow(F.lit(ELEVATION_FACTOR_10FT), elev / 10.0)).otherwise(1.0),
            "__f_gas": F.when(F.col("__gas"), F.lit(GAS_FACTOR)).otherwise(F.lit(1.0)),
        }
    )
    df = df.withColumn("__mult", F.col("__index") * F.col("__f_depth") * F.col("__f_elev") * F.col("__f_gas"))
    mult = F.col("__mult")
    reclamation = F.lit(float(RECLAMATION_USD)) * mult
    block = F.struct(
        round_hundreds(F.lit(float(PLUG_ONLY_USD)) * mult).alias("plug_only_usd"),
        round_hundreds(reclamation).alias("reclamation_usd"),
        round_hundreds(reclamation).alias("point_usd"),
        round_hundreds(F.lit(float(SENSITIVITY_USD)) * mult).alias("low_usd"),
        round_hundreds(reclamation * HIGH_FACTOR).alias("high_usd"),
        depth.isNotNull().alias("depth_known"),
        F.col("__gas").alias("is_gas"),
        F.struct(
            F.lit(RECLAMATION_USD).cast("long").alias("base_reclamation_usd"),
            round_exact("__index", 3).alias("state_cost_index"),
            round_exact("__f_depth", 3).alias("depth_factor"),
            round_exact("__f_elev", 3).alias("elevation_factor"),
            F.col("__f_gas").alias("gas_factor"),
        ).alias("drivers"),
    )
    return df.withColumn(out, block).drop("__depth", "__elev", "__index", "__gas", "__f_depth", "__f_elev", "__f_gas", "__mult")


def with_carbon(df: DataFrame, t_co2e, cost_usd, flag=None, out: str = "carbon") -> DataFrame:
    """Add the credit value against the plugging cost, and the funding tier."""
    flagged = F.lit(False) if flag is None else F.coalesce(_c(flag), F.lit(False))
    df = df.withColumns(
        {"__t": _c(t_co2e) * CREDIT_YEARS * (1 - BUFFER_POOL), "__cost": _c(cost_usd).cast("double"), "__flagged": flagged}
    )
    tonnes, cost = F.col("__t"), F.col("__cost")
    df = df.withColumns(
        {
            "__ratio": F.when(cost != 0, tonnes * PRICE_POINT / cost).otherwise(F.lit(0.0)),
            "__pencils": tonnes * PRICE_HIGH >= cost,
        }
    )
    df = df.withColumn(
        "__tier",
        F.when(F.col("__ratio") >= 1.0, "self_funding").when(F.col("__pencils"), "partial").otherwise("negligible"),
    )
    block = F.struct(
        round_exact("__t", 2).alias("creditable_tonnes"),
        round_int(tonnes * PRICE_LOW).alias("value_low_usd"),
        round_int(tonnes * PRICE_POINT).alias("value_point_usd"),
        round_int(tonnes * PRICE_HIGH).alias("value_high_usd"),
        round_exact("__ratio", 4).alias("self_funding_ratio_point"),
        F.col("__pencils").alias("pencils_out"),
        F.col("__tier").alias("tier"),
        (F.col("__flagged") | (F.col("__tier") != "negligible")).alias("carbon_viable"),
        F.lit(BUFFER_POOL).alias("buffer_pool"),
        F.lit(CREDIT_YEARS).alias("crediting_period_years"),
        F.lit(CREDIT_LABEL).alias("label"),
    )
    return df.withColumn(out, block).drop("__t", "__cost", "__flagged", "__ratio", "__pencils", "__tier")


def water_score(served) -> Column:
    s = _c(served)
    score = round_once(F.least(F.lit(1.0), F.log10(s + 1) / 6.0), 4)
    return F.when(s.isNull() | (s <= 0) | F.isnan(s), F.lit(0.0)).otherwise(score)


def ej_proxy(poverty, minority) -> Column:
    """Mean of the two shares in 0-1; a -999 sentinel in either gives null."""
    p, m = drop_sentinel(poverty), drop_sentinel(minority)
    return round_once(F.when(p.isNotNull() & m.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p + m) / 200.0))), 4)


def drop_sentinel(c, sentinel: float = -999) -> Column:
    return F.when(_c(c) != sentinel, _c(c))


def program_match(state) -> Column:
    return F.when(F.coalesce(_c(state), F.lit("")) != "", F.lit(1.0)).otherwise(F.lit(0.5))


def near_people(schools, population) -> Column:
    return (F.coalesce(_c(schools), F.lit(0)) > 0) | (F.coalesce(_c(population), F.lit(0)) >= NEAR_PEOPLE_POPULATION)


def pathways(state, disadvantaged, viable, tier, near, owner) -> Column:
    """Funding routes for one site, best first; equal ranks keep the listed order."""
    j40 = F.coalesce(_c(disadvantaged), F.lit(False))

    def entry(key, position, priority, confidence, rationale=None):
        label, text, timeline, actor = PATHWAY_TEXTS[key]
        conf_rank = F.when(confidence == "high", 0).when(confidence == "medium", 1).otherwise(2)
        return F.struct(
            priority.cast("int").alias("priority"),
            conf_rank.cast("int").alias("conf_rank"),
            F.lit(position).alias("position"),
            F.lit(key).alias("key"),
            F.lit(label).alias("label"),
            F.lit(True).alias("eligible"),
            (F.lit(text) if rationale is None else rationale).alias("rationale"),
            F.lit(timeline).alias("timeline"),
            F.lit(actor).alias("actor"),
            confidence.alias("confidence"),
        )

    federal_text = F.concat(
        F.lit(PATHWAY_TEXTS["federal_bil"][1]), F.when(j40, DISADVANTAGED_SUFFIX).otherwise(".")
    )
    high, medium, low = F.lit("high"), F.lit("medium"), F.lit("low")
    items = F.array(
        entry("federal_bil", 0, F.when(j40, 0).otherwise(1), F.when(j40, high).otherwise(medium), federal_text),
        F.when(F.coalesce(_c(state), F.lit("")) != "", entry("state_program", 1, F.lit(1), high)),
        F.when(
            F.coalesce(_c(viable), F.lit(False)),
            entry("carbon_credit", 2, F.lit(0),
                  F.when(F.coalesce(_c(tier) == "self_funding", F.lit(False)), high).otherwise(medium)),
        ),
        F.when(F.coalesce(_c(near), F.lit(False)), entry("charity", 3, F.lit(2), medium)),
        F.when(F.coalesce(_c(owner), F.lit(False)), entry("landowner", 4, F.lit(3), low)),
    )
    ranked = F.array_sort(F.array_compact(items))
    return F.transform(
        ranked,
        lambda p: F.struct(*[p[f].alias(f) for f in (
            "key", "label", "eligible", "rationale", "timeline", "actor", "confidence", "priority")]),
    )
