"""Design columns and column-wise figures of numeric frames.

A matrix is a DataFrame of double columns; figures over it are one aggregate whose single row reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import DimensionMismatch, InvalidParameter, NumericalError, VariableNotFound, VariableTypeMismatch
from statloom.operators.table import Table


def float_column(table: Table, name: str) -> Column:
    """A float, int or bool column as double."""
    if not table.has_column(name):
        raise VariableNotFound(name, table.column_names)
    if not table.is_numeric(name):
        raise VariableTypeMismatch(name, "numeric", table.dtype(name))
    return table.to_float(name)


def column_matrix(table: Table, name: str) -> DataFrame:
    return table.df.select(float_column(table, name).alias(name))


def dummies(table: Table, name: str, drop_first: bool = False) -> list[tuple[str, Column]]:
    """(name[level], 0/1 column) for each frozen level; null where the value is null or no level."""
    if not table.is_categorical(name):
        raise VariableTypeMismatch(name, "categorical", table.dtype(name))
    levels = table.levels[name][1:] if drop_first else table.levels[name]
    if not levels:
        raise NumericalError("dummy variables", f"{name!r} has no level left")
    c = F.col(f"`{name}`")
    return [(f"{name}[{v}]", F.when(c == v, 1.0).when(c.isin(table.levels[name]), 0.0)) for v in levels]


def polynomial(column: Column, degree: int) -> list[Column]:
    """Raw powers 1 to degree, by repeated multiplication."""
    if degree < 1:
        raise InvalidParameter("the degree must be at least 1")
    out = [column]
    while len(out) < degree:
        out.append(out[-1] * column)
    return out


def _moments(df: DataFrame, column: Column) -> tuple[float, float]:
    m, s = df.agg(F.avg(column), F.stddev_samp(column)).first()
    return math.nan if m is None else m, math.nan if s is None else s


def center_vector(df: DataFrame, column: Column) -> Column:
    return column - F.lit(_moments(df, column)[0])


def scale_vector(df: DataFrame, column: Column) -> Column:
    """Divides by the standard deviation without centring, unlike the formula function."""
    s = _moments(df, column)[1]
    if s == 0:
        raise NumericalError("scale", "the column is constant")
    return column / F.lit(s)


def standardize_vector(df: DataFrame, column: Column) -> Column:
    m, s = _moments(df, column)
    if s == 0:
        raise NumericalError("standardize", "the column is constant")
    return (column - F.lit(m)) / F.lit(s)


def interaction_term(a: Column, b: Column) -> Column:
    return a * b


def hstack(*blocks: list[tuple[str, Column]]) -> list[tuple[str, Column]]:
    """Columns side by side: expressions over the same rows need no join."""
    return [c for block in blocks for c in block]


def vstack(*frames: DataFrame) -> DataFrame:
    if not frames:
        raise InvalidParameter("nothing to stack")
    out = frames[0]
    for f in frames[1:]:
        if len(f.columns) != len(out.columns):
            raise DimensionMismatch(len(out.columns), len(f.columns))
        out = out.union(f)
    return out


def concatenate(axis: int, blocks: Iterable):
    """Axis 0 stacks frames, axis 1 lists of columns."""
    if axis not in (0, 1):
        raise InvalidParameter(f"axis {axis}")
    return vstack(*blocks) if axis == 0 else hstack(*blocks)


def _each(df: DataFrame, figure) -> list[float]:
    if not df.columns:
        return []
    row = df.agg(*(figure(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    return [math.nan if v is None else float(v) for v in row]


def column_means(df: DataFrame) -> list[float]:
    return _each(df, F.avg)


def column_stds(df: DataFrame, ddof: int = 1) -> list[float]:
    from statloom.operators.stats import variance

    return _each(df, lambda c: F.sqrt(variance(c, ddof)))


def column_sums(df: DataFrame) -> list[float]:
    return _each(df, lambda c: F.coalesce(F.sum(c), F.lit(0.0)))


def column_mins(df: DataFrame) -> list[float]:
    return _each(df, lambda c: F.min(F.when(~F.isnan(c), c)))


def column_maxs(df: DataFrame) -> list[float]:
    return _each(df, lambda c: F.max(F.when(~F.isnan(c), c)))


def ensure_shape(df: DataFrame, rows: int, cols: int | None = None) -> None:
    if cols is not None and len(df.columns) != cols:
        raise DimensionMismatch(cols, len(df.columns))
    if (n := df.count()) != rows:
        raise DimensionMismatch(rows, n)


def ensure_2d(df: DataFrame) -> None:
    if not df.columns or df.isEmpty():
        raise DimensionMismatch("rows and columns", "an empty matrix")


def check_finite(df: DataFrame) -> None:
    """NaN and infinities are an error."""
    bad = _each(df, lambda c: F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))))
    if any(bad):
        raise NumericalError("check_finite", f"column {df.columns[next(i for i, b in enumerate(bad) if b)]!r} holds NaN or infinity")


def check_constant_columns(df: DataFrame, tolerance: float, key: str | None = None) -> list[int]:
    """Positions of columns whose values all lie within tolerance of the first one: first by the key, or as rows come.

    NaN differs from nothing; null doesn't count; without rows no column is constant.
    """
    names = [c for c in df.columns if c != key]
    if key is None:
        first = df.first()
    else:
        first = df.orderBy(F.col(f"`{key}`")).select(*(F.col(f"`{c}`") for c in names)).first()
    if first is None or not names:
        return []
    apart = [F.abs(F.col(f"`{c}`") - F.lit(v)) for c, v in zip(names, first, strict=True)]
    far = df.agg(*(F.count_if(~F.isnan(a) & (a > tolerance)).alias(f"c{i}") for i, a in enumerate(apart))).first()
    return [i for i, n in enumerate(far) if not n]


def check_equal_lengths(*lengths: int) -> None:
    for n in lengths[1:]:
        if n != lengths[0]:
            raise DimensionMismatch(lengths[0], n)


def value_to_string(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def string_to_value(text: str) -> float | bool | str:
    """A number if it reads as one, else a truth word, else the text."""
    try:
        return float(text)
    except ValueError:
        word = text.lower()
        return True if word in ("true", "t", "yes", "y") else False if word in ("false", "f", "no", "n") else text
