"""Rounding and null handling that give the same bits as the published results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two halves
_TINY = 5e-324  # smallest positive double
_WHOLE = 4503599627370496.0  # 2**52
_ABOVE_HALF = 0.5000000000000001  # next double after one half


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_exact(c, digits: int, ties: str = "even") -> Column:
    """Round on the exact binary value of a double: half-even as Python's ``round(x, n)``,
    or with ``ties="up"`` as a browser's ``toFixed``.

    ``x * 10**n`` is formed together with its rounding error, so a product that only
    looks like a tie is still decided the right way.  Built-in arithmetic only.  The
    formula names its input many times, so pass a plain column; see :func:`round_once`.
    """
    if isinstance(c, str):
        return F.expr(_round_text(c, digits, ties))
    x = _col(c).cast("double")
    m = float(10**digits)
    p = x * F.lit(m)
    k = F.floor(p)
    frac = p - k
    hi = x * F.lit(_SPLIT) - (x * F.lit(_SPLIT) - x)
    err = (hi * F.lit(m) - p) + (x - hi) * F.lit(m)
    tie_goes_up = F.lit(True) if ties == "up" else k % 2 != 0
    up_at_half = err >= F.when(tie_goes_up, F.lit(0.0)).otherwise(F.lit(_TINY))
    up = frac >= F.when(up_at_half, F.lit(0.5)).otherwise(F.lit(_ABOVE_HALF))
    # from 2**52 on a product has no fraction; neither have NaN and infinities
    return F.when(F.abs(p) < F.lit(_WHOLE), (k + up.cast("int")) / F.lit(m)).otherwise(x)


def _round_text(name: str, digits: int, ties: str) -> str:
    """The same formula as text: one call instead of a tree built node by node."""
    x = "cast(" + ".".join(f"`{part}`" for part in name.split(".")) + " as double)"
    m, split = f"{float(10**digits)!r}D", f"{_SPLIT!r}D"
    p = f"({x} * {m})"
    k = f"floor({p})"
    hi = f"({x} * {split} - ({x} * {split} - {x}))"
    err = f"(({hi} * {m} - {p}) + ({x} - {hi}) * {m})"
    goes_up = "true" if ties == "up" else f"{k} % 2 <> 0"
    limit = f"if({err} >= if({goes_up}, 0.0D, {_TINY!r}D), 0.5D, {_ABOVE_HALF!r}D)"
    return f"if(abs({p}) < {_WHOLE!r}D, ({k} + cast({p} - {k} >= {limit} as int)) / {m}, {x})"


def round_once(c, digits: int, ties: str = "even") -> Column:
    """:func:`round_exact` for a compound expression, which is evaluated only once."""
    return F.get(F.transform(F.array(_col(c).cast("double")), lambda v: round_exact(v, digits, ties)), F.lit(0))


def with_rounded(df: DataFrame, columns: dict[str, tuple[Column, int]]) -> DataFrame:
    """Add rounded columns: the values first, then their rounding, so no expression is repeated."""
    raw = df.withColumns({f"__raw_{n}": c for n, (c, _) in columns.items()})
    out = raw.withColumns({n: round_exact(f"__raw_{n}", d) for n, (_, d) in columns.items()})
    return out.drop(*[f"__raw_{n}" for n in columns])


def sql_round_exact(expr: str, digits: int) -> str:
    """The same rule as SQL text for an oracle query."""
    m = f"1e{digits}"
    x = f"({expr})"
    s = "134217729.0::double"
    p = f"({x} * {m})"
    k = f"floor({p})"
    hi = f"({x} * {s} - ({x} * {s} - {x}))"
    err = f"(({hi} * {m} - {p}) + ({x} - {hi}) * {m})"
    up = (
        f"(case when {p} - {k} > 0.5 then 1 when {p} - {k} = 0.5 and ({err} > 0 or "
        f"({err} = 0 and {k}::bigint % 2 <> 0)) then 1 else 0 end)"
    )
    return f"(({k} + {up}) / {m})"


def round_int(c) -> Column:
    """Whole number, half-even."""
    return F.bround(_col(c), 0).cast("long")


def round_hundreds(c) -> Column:
    """Nearest hundred, half-even."""
    return F.bround(_col(c), -2).cast("long")


def finite_or_null(c) -> Column:
    x = _col(c)
    inf = F.lit(float("inf"))
    return F.when(F.isnan(x) | (F.abs(x) == inf), None).otherwise(x)


def _scrub(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return finite_or_null(c)
    if isinstance(dt, T.ArrayType) and _has_float(dt.elementType):
        return F.transform(c, lambda v: _scrub(v, dt.elementType))
    if isinstance(dt, T.MapType) and _has_float(dt.valueType):
        return F.transform_values(c, lambda _, v: _scrub(v, dt.valueType))
    if isinstance(dt, T.StructType) and _has_float(dt):
        fields = [_scrub(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def _has_float(dt: T.DataType) -> bool:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(dt, T.ArrayType):
        return _has_float(dt.elementType)
    if isinstance(dt, T.MapType):
        return _has_float(dt.valueType)
    return isinstance(dt, T.StructType) and any(_has_float(f.dataType) for f in dt.fields)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become null at every depth of the schema."""
    return df.select(*[_scrub(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
