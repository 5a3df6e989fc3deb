"""Joins by key, unions, upserts and difference: the table-level operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siterank.operators.ordering import keep_first


# --- column resolution ------------------------------------------------------
def find_alias(df: DataFrame, aliases: list[str]) -> str | None:
    """First alias present, ignoring case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[a.lower()] for a in aliases if a.lower() in have), None)


def alias_column(df: DataFrame, aliases: list[str], dtype: str = "string") -> Column:
    name = find_alias(df, aliases)
    return F.col(f"`{name}`") if name else F.lit(None).cast(dtype)


def project_fields(df: DataFrame, fieldmap: dict[str, str], targets: list[str], keep: list[str] = ()) -> DataFrame:
    """``fieldmap`` source -> target; a target without a present source is null text, ``keep`` stays as it is."""
    sources = {dst: src for src, dst in fieldmap.items()}
    return df.select(
        *[
            (F.col(f"`{sources[t]}`").cast("string") if sources.get(t) in df.columns else F.lit(None).cast("string")).alias(t)
            for t in targets
        ],
        *keep,
    )


# --- key joins --------------------------------------------------------------
def attach_by_key(left: DataFrame, right: DataFrame, key: str, right_ordinal: str, carry: list[str],
                  prefix: str = "r_") -> DataFrame:
    """Each left row meets the first right row of its key; empty keys never match."""
    rkey = F.nullif(F.trim(F.col(key)), F.lit(""))
    first = keep_first(right.withColumn("__k", rkey).where("__k is not null"), ["__k"], right_ordinal).select(
        "__k", *[F.col(c).alias(prefix + c) for c in carry]
    )
    return left.withColumn("__lk", rkey).join(first, F.col("__lk") == F.col("__k"), "left").drop("__k", "__lk")


def composite_lookup(left: DataFrame, lookup: DataFrame, keys: list[str], value: str, default) -> DataFrame:
    """Left join with a default and a status column: exact, ambiguous or default."""
    hit = lookup.select(*keys, F.col(value).alias("__value"), F.col("ambiguous").alias("__amb"))
    return (
        left.join(hit, keys, "left")
        .withColumn(value, F.coalesce("__value", F.lit(default)))
        .withColumn(
            "lookup_status",
            F.when(F.col("__value").isNull(), "default").when(F.col("__amb"), "ambiguous").otherwise("exact"),
        )
        .drop("__value", "__amb")
    )


def resolve_values(df: DataFrame, keys: list[str], value: str, preferred) -> DataFrame:
    """Distinct values of a key reduced to one: the only one, else the preferred, else the smallest."""
    distinct = df.groupBy(*keys, value).agg(F.lit(1).alias("one"))
    return distinct.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) == 1, F.min(value))
        .when(F.max(F.col(value) == preferred), F.lit(preferred))
        .otherwise(F.min(value))
        .alias(value),
        (F.count(F.lit(1)) > 1).alias("ambiguous"),
    )


def merge_columns(left: DataFrame, right: DataFrame, key: str, overwrite: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """Left join where some columns replace and others only fill gaps."""
    have = set(left.columns)
    cols = [*overwrite, *fill]
    r = right.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__r_{c}") for c in cols])
    out = left.join(r, F.col(key) == F.col("__k"), "left")
    new = {}
    for c in cols:
        old, fresh = (F.col(c) if c in have else F.lit(None)), F.col(f"__r_{c}")
        new[c] = F.coalesce(fresh, old) if c in overwrite else F.coalesce(old, fresh)
    return out.withColumns(new).drop("__k", *[f"__r_{c}" for c in cols])


def pending(todo: DataFrame, done: DataFrame, keys: list[str], accepted: list[str] | None = None) -> DataFrame:
    """Rows without a finished counterpart; ``accepted`` limits which statuses count as finished."""
    if accepted is not None:
        done = done.where(F.col("status").isin(accepted))
    return todo.join(done.select(*keys), keys, "left_anti")


def one_row(*frames: DataFrame) -> DataFrame:
    """Single-row frames side by side: a union collapsed by one aggregate, no join."""
    cols = [c for f in frames for c in f.columns]
    return union_all(list(frames)).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


# --- set operations ---------------------------------------------------------
def union_common(*frames: DataFrame) -> DataFrame:
    """Union on the columns all frames share, in the order of the first."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(lambda a, b: a.unionByName(b), [f.select(*common) for f in frames])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def replace_source(existing: DataFrame, fresh: DataFrame, prefix: str, key: str = "well_id") -> DataFrame:
    """Drop the rows of one provenance and append its fresh rows; repeating it changes nothing."""
    kept = existing.where(~F.coalesce(F.col(key).startswith(prefix), F.lit(False)))
    return kept.unionByName(fresh)


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def append_new(existing: DataFrame, fresh: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows of ``fresh`` whose key is not yet stored, first of each key only."""
    return keep_first(fresh.join(existing.select(key), key, "left_anti"), [key], ordinal)


def overlay_by_key(layers: list[DataFrame], key: str) -> DataFrame:
    """Keyed union where a later layer overwrites an earlier one."""
    tagged = [f.withColumn("__prio", F.lit(i)) for i, f in enumerate(layers)]
    return keep_first(union_all(tagged), [key], F.col("__prio").desc()).drop("__prio")


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")


def select_cohort(ranked: DataFrame, featured: DataFrame, n: int, states: list[str], state: str = "state",
                  rank: str = "rank", key: str = "well_id") -> DataFrame:
    """Best ``n`` sites of the chosen states, together with every featured site of those states."""
    scoped = ranked.where(F.col(state).isin(states))
    top = scoped.orderBy(rank, key).limit(n)
    extra = scoped.join(featured.select(key), key, "left_semi").join(top.select(key), key, "left_anti")
    return top.unionByName(extra)


def select_run_cohort(ranked: DataFrame, featured: DataFrame, total: int, states: list[str],
                      state: str = "state_abbr", rank: str = "rank", key: str = "well_id") -> DataFrame:
    """Featured sites first; the rest of ``total`` from the best others."""
    room = max(0, total - featured.count())
    others = ranked.where(F.col(state).isin(states)).join(featured.select(key), key, "left_anti")
    cols = [c for c in featured.columns if c in others.columns]
    best = others.orderBy(F.col(rank).asc_nulls_last(), key).limit(room)
    return (
        featured.select(*cols).withColumn("section", F.lit(0))
        .unionByName(best.select(*cols).withColumn("section", F.lit(1)))
    )


def ordered_unique(frames: list[DataFrame], key: str, position: str) -> DataFrame:
    """Ids in first-seen order over several lists."""
    tagged = [f.select(key, F.struct(F.lit(i).alias("list"), F.col(position).alias("pos")).alias("at"))
              for i, f in enumerate(frames)]
    return union_all(tagged).groupBy(key).agg(F.min("at").alias("at")).select(
        key, F.col("at.list").alias("list_no"), F.col("at.pos").alias("position")
    )
