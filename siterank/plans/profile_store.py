"""Profiles that are kept: counts and sketches per part and metric, into which new rows are merged.

Counts, greatest values and counts beyond thresholds are exact.  Distinct values come from HyperLogLog sketches (a standard error
of about 1.6 % with 2^12 registers), quantiles from KLL sketches (a rank error of about 0.7 % with k = 400, at 99 % confidence).
A sketch has at most some ten kilobytes, whatever it has seen, so the table grows with parts and metrics only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siterank.session import cut_lineage
from siterank.sources.keyed_store import KeyedStore

#: Distances (m) beyond which values are counted.
THRESHOLDS = (100.0, 500.0, 1000.0)
REGISTERS_LOG2, KLL_K = 12, 400
COLUMNS = (
    "part string, metric string, n long, present long, greatest double, beyond array<long>, distinct_sketch binary, quantile_sketch binary"
)


def _added(arrays: Column) -> Column:
    zero = F.array(*[F.lit(0).cast("long") for _ in THRESHOLDS])
    return F.aggregate(arrays, zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))


def sketched(rows: DataFrame, metrics: list[str], part: str) -> DataFrame:
    """One row per part and metric; texts and flags have no quantiles, NaN counts as no value.  A part may be null."""
    numeric = {f.name for f in rows.schema if isinstance(f.dataType, T.NumericType)}

    def long(name: str) -> Column:
        c = F.col(name)
        number = F.nanvl(c.cast("double"), F.lit(None).cast("double")) if name in numeric else F.lit(None).cast("double")
        text = F.when(number.isNotNull(), number.cast("string")) if name in numeric else c.cast("string")
        return F.struct(F.lit(name).alias("metric"), text.alias("text"), number.alias("number"))

    each = rows.select(F.col(part).cast("string").alias("part"), F.explode(F.array(*[long(m) for m in metrics])).alias("m")).select("part", "m.*")
    return each.groupBy("part", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.count("text").alias("present"), F.max("number").alias("greatest"),
        F.array(*[F.count_if(F.col("number") > t) for t in THRESHOLDS]).alias("beyond"),
        F.hll_sketch_agg("text", F.lit(REGISTERS_LOG2)).alias("distinct_sketch"),
        F.kll_sketch_agg_double("number", F.lit(KLL_K)).alias("quantile_sketch"),
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of equal keys as one."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("present").alias("present"), F.max("greatest").alias("greatest"), _added(F.collect_list("beyond")).alias("beyond"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def profile_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path).create(COLUMNS, ["part", "metric"], buckets=8)


def add_to_profile(store: KeyedStore, rows: DataFrame, metrics: list[str], part: str = "state", writer: str | None = None, batch: int | None = None) -> int:
    """Merge new rows into the profile: they are read once, rows of before not at all.  A repeated batch of a writer changes nothing."""
    fresh = cut_lineage(sketched(rows, metrics, part))
    both = merged(store.read().unionByName(fresh), ["part", "metric"])
    changed = both.join(F.broadcast(fresh.select(F.col("part").alias("__p"), F.col("metric").alias("__m"))),  # a row per part and metric
                        F.col("part").eqNullSafe(F.col("__p")) & (F.col("metric") == F.col("__m")), "left_semi")
    return store.merge(changed, "n", writer, batch)


def profile(store: KeyedStore, by_part: bool = False) -> DataFrame:
    """Per metric (and part): rows, values, share, distinct values and quartiles by estimate, greatest, counts beyond the thresholds."""
    keys = ["part", "metric"] if by_part else ["metric"]
    m = store.read() if by_part else merged(store.read(), keys)
    some = F.coalesce(F.kll_sketch_get_n_double("quantile_sketch"), F.lit(0)) > 0

    def quantile(q: float) -> Column:
        return F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q)))

    return m.select(
        *keys, "n", "present", (F.col("present") / F.col("n")).alias("share"), F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"),
        quantile(0.25).alias("lower_quartile"), quantile(0.5).alias("median"), quantile(0.75).alias("upper_quartile"), "greatest",
        *[F.get("beyond", F.lit(i)).alias(f"gt_{t:.0f}") for i, t in enumerate(THRESHOLDS)],
    )
