"""Ranks, positions, sequences and keep-first rules that hold up when one key is very large.

Order always comes from an explicit unique ``ordinal`` column.  Where a running number is
needed inside a key, rows are cut into blocks of consecutive ordinals: block counts give
the offsets, and only one block (never a whole key) is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.functions.numeric import round_exact
from siterank.session import cut_lineage

BLOCK_BITS = 20


def _same(a: str, b: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def keep_first(df: DataFrame, keys: list[str], order, n: int = 1) -> DataFrame:
    """First ``n`` rows of each key.  Spark limits each group before the shuffle."""
    order = order if isinstance(order, (list, tuple)) else [order]
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def running_sequence(df: DataFrame, keys: list[str], ordinal: str, out: str = "seq", start: int = 0,
                     block_bits: int = BLOCK_BITS) -> DataFrame:
    """0, 1, 2 … inside each key by ordinal."""
    b = df.withColumn("__blk", F.shiftright(F.col(ordinal).cast("long"), block_bits))
    counts = b.groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*keys).orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__base", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    joined = b.alias("a").join(offsets.alias("o"), _same("a", "o", [*keys, "__blk"]))
    rows = joined.select("a.*", "o.__base")
    inner = W.partitionBy(*keys, "__blk").orderBy(ordinal)
    return rows.withColumn(
        out, (F.col("__base") + F.row_number().over(inner) - 1 + start).cast("long")
    ).drop("__blk", "__base")


def prefix_counts(counts: DataFrame, by: list[str], value: str | list[str], n: str) -> DataFrame:
    """For distinct values with counts: how many rows lie strictly below each value, and the ``total`` of the group.

    The values are range-partitioned, so that every task sorts its own range and one row per range and group carries the
    counts of the ranges before it.
    """
    order = [value] if isinstance(value, str) else value
    parts = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(counts.repartitionByRange(parts, *by, *order).withColumn("__cut", F.spark_partition_id()))
    group = W.partitionBy(*by)
    per = ranged.groupBy(*by, "__cut").agg(F.sum(n).alias("__m")).withColumns({
        "__base": F.coalesce(F.sum("__m").over(group.orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum("__m").over(group),
    }).drop("__m")
    inner = W.partitionBy(*by, "__cut").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # at most one row per range more than there are groups
    joined = ranged.alias("a").join(F.broadcast(per.alias("o")), _same("a", "o", [*by, "__cut"])).select("a.*", "o.__base", "o.total")
    return joined.withColumn("before", F.col("__base") + F.coalesce(F.sum(n).over(inner), F.lit(0))).drop("__cut", "__base")


def with_rank_shares(df: DataFrame, metrics: dict[str, tuple[str, str]], suffix: str = "_norm") -> DataFrame:
    """Add one 0-1 column per metric.  ``metrics``: name -> (column, mode); modes pct, pct_inv, direct.

    A share is the average rank over the non-null values of the metric, as a part of their number; pct_inv scores low values
    high.  All metrics go through one range partitioning of (metric, value, row), so a value that most rows hold is spread
    over ranges.  Rows are ranked inside their range; counts of ranges, and of the values at their ends, carry the ranks over
    the borders; one grouping by row brings the shares back.  Nothing is joined or shuffled by the value.
    """
    ranked = {m: c for m, (c, mode) in metrics.items() if mode != "direct"}
    bounded = {m + suffix: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c).cast("double"))) for m, (c, mode) in metrics.items() if mode == "direct"}
    if not ranked:
        return df.withColumns(bounded)
    # written once, so that the row numbers stay as they are
    rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
    # 0.0 is added to make -0.0 and 0.0 one value
    pairs = ", ".join(f"'{m}', cast(`{c}` as double) + 0.0D" for m, c in ranked.items())
    long = rows.select("__row", F.expr(f"stack({len(ranked)}, {pairs}) as (metric, value)")).where("value is not null and not isnan(value)")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = long.repartitionByRange(parts, "metric", "value", "__row").withColumn("__cut", F.spark_partition_id())
    inside = W.partitionBy("metric", "__cut")
    # the frame of rank() and of the count are the rows of one value in one range
    placed = cut_lineage(ranged.withColumn("below", F.rank().over(inside.orderBy("value")) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("metric", "__cut", "value"))))

    # one row per metric and range
    upto = W.partitionBy("metric").orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)
    ends = placed.groupBy("metric", "__cut").agg(
        F.count(F.lit(1)).alias("m"), F.min("value").alias("lo"), F.min_by("n", "value").alias("n_lo"), F.max("value").alias("hi"), F.max_by("n", "value").alias("n_hi")
    ).withColumns({"base": F.coalesce(F.sum("m").over(upto), F.lit(0)), "total": F.sum("m").over(W.partitionBy("metric"))})
    first = F.struct(F.col("lo").alias("value"), F.col("base").alias("at"), F.col("n_lo").alias("n"))
    last = F.struct(F.col("hi").alias("value"), (F.col("base") + F.col("m") - F.col("n_hi")).alias("at"), F.col("n_hi").alias("n"))
    borders = (
        ends.select("metric", F.explode(F.when(F.col("lo") == F.col("hi"), F.array(first)).otherwise(F.array(first, last))).alias("e"))
        .groupBy("metric", F.col("e.value").alias("value")).agg(F.min("e.at").alias("at_all"), F.sum("e.n").alias("n_all"))
    )
    # two values a range at most: the broadcasts grow with the number of ranges and metrics, not with the rows
    known = placed.join(F.broadcast(ends.select("metric", "__cut", "base", "total")), ["metric", "__cut"]).join(F.broadcast(borders), ["metric", "value"], "left")
    share = (F.coalesce("at_all", F.col("base") + F.col("below")) + (F.coalesce("n_all", "n") + 1) / 2.0) / F.col("total")
    inverted = [m for m in ranked if metrics[m][1] == "pct_inv"]
    if inverted:
        share = F.when(F.col("metric").isin(*inverted), 1.0 - share).otherwise(share)
    shares = known.withColumn("raw", share).select("__row", "metric", round_exact("raw", 4).alias("share"))
    back = shares.groupBy("__row").agg(*[F.max(F.when(F.col("metric") == m, F.col("share"))).alias(m + suffix) for m in ranked])
    return rows.withColumns(bounded).join(back, "__row", "left").drop("__row")


def global_position(df: DataFrame, value: str, ordinal: str, out: str = "rank", descending: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """1-based position in a stable sort on ``value``; ties keep the ordinal order, then that of ``ties``; null and NaN come last.

    The ordinal is part of the range key, so rows of one value are spread over ranges and no task sorts them all.
    """
    # nulls and NaN as one value after all others
    v = F.col(value).cast("double")
    last = v.isNull() | F.isnan(v)
    keyed = df.withColumns({"__last": last.cast("int"), "__v": F.when(last, 0.0).otherwise(v * (-1.0 if descending else 1.0)) + 0.0})
    return dense_ordinal(keyed, ["__last", "__v", ordinal, *ties], out, start=1).drop("__last", "__v")


def dense_ordinal(df: DataFrame, order: list[str], out: str = "ordinal", start: int = 0) -> DataFrame:
    """Running number over a total order, counted per range partition (no single-task sort).

    The ordered rows are checkpointed once so that the counts and the rows come from the same data.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumns({"__pid": F.spark_partition_id(), "__mid": F.monotonically_increasing_id()})
    )
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    w = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "__pid", (F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__first") + start).alias("__shift")
    )
    # one row per partition, so at most spark.sql.shuffle.partitions rows
    return (
        ranged.join(F.broadcast(offsets), "__pid")
        .withColumn(out, (F.col("__mid") + F.col("__shift")).cast("long"))
        .drop("__pid", "__mid", "__shift")
    )


def share_of_max(df: DataFrame, key: str, value: str, out: str = "share", floor: float = 0.0001) -> DataFrame:
    """Bar length: value over the largest value of its group, never above 1."""
    top = df.groupBy(key).agg(F.max(value).alias("__top"))
    return df.join(top, key).withColumn(
        out, F.least(F.lit(1.0), F.col(value) / F.greatest(F.col("__top"), F.lit(floor)))
    ).drop("__top")


def first_values(df: DataFrame, key: str, value: str, order: str, n: int, out: str) -> DataFrame:
    """Array of the first ``n`` non-null values of each key; never collects more than ``n`` per key."""
    top = keep_first(df.where(F.col(value).isNotNull()), [key], order, n)
    return top.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]
        ).alias(out)
    )
