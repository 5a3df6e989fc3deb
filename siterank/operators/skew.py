"""Equi-joins of a side with hot keys to a side with few rows per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: At most so many keys are called hot (this bounds what is broadcast), and only above so many rows, which one salt then holds.
MOST_HOT, FLOOR = 10_000, 100_000


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", floor: int = FLOOR) -> DataFrame:
    """``many.join(few, keys, how)`` for ``how`` inner or left, with hot keys of ``many`` dealt over several tasks.

    A key beyond ``floor`` rows is split into parts of about ``floor`` rows each, for which the rows of ``few`` are repeated.
    A key that is not among the ``MOST_HOT`` most frequent holds less than one in ``MOST_HOT`` of all rows.
    """
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > floor)
    # a limit after a sort: at most MOST_HOT rows are kept per task and in all
    hot = counts.orderBy(F.desc("__n"), *keys).limit(MOST_HOT).select(*keys, F.ceil(F.col("__n") / floor).cast("int").alias("__parts"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.floor(F.rand(7) * F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    spread = few.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(spread, [*keys, "__salt"], how).drop("__salt")
