"""Descriptive statistics: each call is one aggregate over all columns it needs.

NULL and, in describe, NaN count as missing. Quantiles are exact, with linear interpolation between order statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import InvalidParameter, NonNumericData, TypeMismatch
from statloom.operators.table import Table
from statloom.schema import ColumnType, SeriesStats

#: Rows up to which one aggregate finds exact quantiles; beyond it ranks are narrowed by passes over the data.
ONE_PASS_ROWS = 100_000
#: Values left around a rank that the last aggregate sorts.
RANK_ROWS = 50_000
QUARTILES = [0.25, 0.5, 0.75]


def _number(table: Table, name: str) -> Column:
    """The column as double without NaN."""
    v = table.to_float(name)
    return F.when(~F.isnan(v), v)


def mean(table: Table, name: str) -> float:
    found = table.df.agg(F.avg(table.to_float(name))).first()[0]
    return math.nan if found is None else found


def total(table: Table, name: str) -> float:
    return table.df.agg(F.coalesce(F.sum(table.to_float(name)), F.lit(0.0))).first()[0]


def std(table: Table, name: str, ddof: int = 1) -> float:
    v = table.to_float(name)
    n, var = table.df.agg(F.count(v), F.var_pop(v)).first()
    return math.nan if n <= ddof else math.sqrt(var * n / (n - ddof))


def variance(column: Column, ddof: int) -> Column:
    """Variance with any ddof; null where there are too few rows."""
    if ddof in (0, 1):
        return F.var_pop(column) if ddof == 0 else F.var_samp(column)
    n = F.count(column)
    return F.when(n > ddof, F.var_pop(column) * n / (n - ddof))


def exact_quantiles(df: DataFrame, value: Column, qs: list[float], rows: int | None = None) -> list[float | None]:
    """Exact quantiles of any number of rows, see `all_quantiles`."""
    return all_quantiles(df, [value], qs, None if rows is None else [rows])[0]


class _Rank:
    """Where the value of a 0-based rank lies: among `inside` values from a to b, after `below` smaller ones."""

    def __init__(self, column: int, rank: int, n: int):
        self.column, self.rank = column, rank
        self.a, self.b, self.below, self.inside = -math.inf, math.inf, 0, n

    def between(self, v: Column) -> Column:
        return F.when((v >= self.a) & (v <= self.b), v)

    def narrow(self, low: float, high: float, counts: tuple[int, int, int, int]) -> None:
        """By two values and how many values are under low, up to low, under high and up to high."""
        under_low, to_low, under_high, to_high = counts
        if self.rank < under_low:
            self.b, self.inside = math.nextafter(low, -math.inf), under_low - self.below
        elif self.rank < to_low:
            self.a = self.b = low
        elif self.rank < under_high:
            self.a, self.b, self.below, self.inside = math.nextafter(low, math.inf), math.nextafter(high, -math.inf), to_low, under_high - to_low
        elif self.rank < to_high:
            self.a = self.b = high
        else:
            self.a, self.below, self.inside = math.nextafter(high, math.inf), to_high, self.below + self.inside - to_high


def all_quantiles(df: DataFrame, values: list[Column], qs: list[float], rows: list[int] | None = None, one_pass: int = ONE_PASS_ROWS, sorted_rows: int = RANK_ROWS) -> list[list[float | None]]:
    """Exact quantiles of several columns (NaN left out by the caller), by passes that all columns share.

    Up to `one_pass` rows one aggregate does. Beyond, each round asks for approximate quantiles a little to either side
    of every wanted rank (one pass) and counts what lies below and between them (another), until what is left around a rank
    (`sorted_rows`) can be sorted in the last pass: three passes up to some 10^7 rows, five up to some 10^10.
    """
    data = df.select(*(v.cast("double").alias(f"v{i}") for i, v in enumerate(values)))
    v = [F.col(f"v{i}") for i in range(len(values))]
    if rows is None:
        rows = list(data.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(v))).first()) if v else []
    out: list[list[float | None]] = [[None] * len(qs) for _ in v]
    small = [i for i, n in enumerate(rows) if 0 < n <= one_pass]
    if small:
        found = data.agg(*(F.percentile(v[i], F.array(*map(F.lit, qs))).alias(f"p{i}") for i in small)).first()
        for i, p in zip(small, found, strict=True):
            out[i] = list(p)
    wanted = {(i, k): (n - 1) * q for i, n in enumerate(rows) if n > one_pass for k, q in enumerate(qs)}
    ranks = {(i, r): _Rank(i, r, rows[i]) for (i, _), at in wanted.items() for r in (math.floor(at), math.ceil(at))}
    while wide := [r for r in ranks.values() if r.a < r.b and r.inside > sorted_rows]:
        same: dict[tuple[int, float, float], list[_Rank]] = {}
        for r in wide:
            same.setdefault((r.column, r.a, r.b), []).append(r)
        asked = []
        for (i, *_), group in same.items():
            shares = [s for r in group for at in [(r.rank - r.below) / r.inside] for s in (max(0.0, at - 5e-4), min(1.0, at + 5e-4))]
            asked.append(F.percentile_approx(group[0].between(v[i]), shares, 5000))
        brackets = [b for row in data.agg(*(c.alias(f"b{j}") for j, c in enumerate(asked))).first() for b in zip(row[::2], row[1::2], strict=True)]
        wide = [r for group in same.values() for r in group]
        counts = [F.count_if(f) for r, (a, b) in zip(wide, brackets, strict=True) for x in [v[r.column]] for f in (x < a, x <= a, x < b, x <= b)]
        found = data.agg(*(c.alias(f"c{j}") for j, c in enumerate(counts))).first()
        for j, (r, (a, b)) in enumerate(zip(wide, brackets, strict=True)):
            r.narrow(a, b, tuple(found[4 * j : 4 * j + 4]))
    left = [r for r in ranks.values() if r.a < r.b]
    if left:
        picked = [F.element_at(F.sort_array(F.collect_list(r.between(v[r.column]))), r.rank - r.below + 1) for r in left]
        for r, value in zip(left, data.agg(*(c.alias(f"p{j}") for j, c in enumerate(picked))).first(), strict=True):
            r.a = r.b = value
    for (i, k), at in wanted.items():
        low, high = ranks[i, math.floor(at)].a, ranks[i, math.ceil(at)].a
        out[i][k] = low + (at - math.floor(at)) * (high - low) if low != high else low
    return out


def series_stats(table: Table, name: str, floats_only: bool = False) -> SeriesStats:
    """Statistics of one column; strings have count and distinct values only."""
    kind = table.column_type(name)
    if floats_only and kind is not ColumnType.FLOAT:
        raise NonNumericData(f"column {name!r} is {kind}")
    if not kind.is_numeric() and not kind.is_categorical():
        c = F.col(f"`{name}`")
        n, unique = table.df.agg(F.count(c), F.count_distinct(c)).first()
        return SeriesStats(count=n, unique_count=unique)
    v = _number(table, name)
    n, m, s, low, high = table.df.agg(F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v)).first()
    if not n:
        return SeriesStats.empty()
    q = exact_quantiles(table.df, v, QUARTILES, n)
    return SeriesStats(n, m, math.nan if s is None else s, low, *q, high)


def describe(table: Table, names: Iterable[str] | None = None) -> DataFrame:
    """column, count, mean, std, min, 25%, 50%, 75%, max, unique: one row a column, in the table's order."""
    names = table.column_names if names is None else list(names)
    numeric = [c for c in names if table.is_numeric(c) or table.is_categorical(c)]
    others = [c for c in names if c not in numeric]
    counts = table.df.agg(F.count("*")).first()[0]
    one_pass = counts <= ONE_PASS_ROWS
    aggs = []
    for i, c in enumerate(names):
        if c in others:
            col = F.col(f"`{c}`")
            aggs += [F.count(col).alias(f"n{i}"), F.count_distinct(col).alias(f"u{i}")]
            continue
        v = _number(table, c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}")]
        if one_pass:
            aggs.append(F.percentile(v, F.array(*map(F.lit, QUARTILES))).alias(f"q{i}"))
    nothing = F.lit(None).cast("double")
    found = {} if one_pass else dict(zip(numeric, all_quantiles(table.df, [_number(table, c) for c in numeric], QUARTILES), strict=True))
    rows = []
    for i, c in enumerate(names):
        if c in others:
            figures = [nothing] * 7
        else:
            q = [F.col(f"q{i}")[k] for k in range(3)] if one_pass else [F.lit(x).cast("double") for x in found[c]]
            figures = [F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"a{i}"), *q, F.col(f"z{i}")]
        unique = F.col(f"u{i}") if c in others else F.lit(None).cast("long")
        heads = ["mean", "std", "min", "25%", "50%", "75%", "max"]
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), *(f.cast("double").alias(h) for f, h in zip(figures, heads, strict=True)), unique.alias("unique")))
    if not rows:
        raise InvalidParameter("no columns to describe")
    return table.df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _pairs(table: Table) -> list[str]:
    return table.numeric_columns()


def _matrix(frame: DataFrame, names: list[str], cell) -> DataFrame:
    """Long form (row, col, value) of one aggregated row."""
    cells = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), cell(min(i, j), max(i, j)).alias("value")) for i, a in enumerate(names) for j, b in enumerate(names)]
    if not cells:
        return frame.sparkSession.createDataFrame([], "row string, col string, value double")
    return frame.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def corr(table: Table) -> DataFrame:
    """(row, col, value): Pearson correlations; NaN where a column is constant; no rows for a table of at most one row."""
    names = _pairs(table)
    x = [table.to_float(c) for c in names]
    aggs = [F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    one = table.df.agg(F.count("*").alias("n"), *aggs).where(F.col("n") > 1)

    def cell(i: int, j: int) -> Column:
        return F.coalesce(F.try_divide(F.col(f"c{i}_{j}"), F.sqrt(F.col(f"c{i}_{i}")) * F.sqrt(F.col(f"c{j}_{j}"))), F.lit(math.nan))

    return _matrix(one, names, cell)


def cov(table: Table, ddof: int = 1) -> DataFrame:
    """(row, col, value): covariances; no rows for a table of at most ddof rows."""
    names = _pairs(table)
    x = [table.to_float(c) for c in names]
    aggs = [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    one = table.df.agg(F.count("*").alias("n"), *aggs).where(F.col("n") > ddof)
    return _matrix(one, names, lambda i, j: F.col(f"c{i}_{j}") * F.col("n") / (F.col("n") - ddof))


def unique_values(table: Table, name: str) -> DataFrame:
    """(value): levels of a categorical, unused ones too; sorted distinct values of a string column."""
    kind = table.column_type(name)
    if kind.is_categorical():
        return table.df.sparkSession.createDataFrame([(v,) for v in table.levels[name]], "value string")
    if not kind.is_string():
        raise TypeMismatch(name, "string or categorical", str(kind))
    return table.df.select(F.col(f"`{name}`").alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def distinct_values(table: Table, name: str) -> DataFrame:
    """(value): sorted distinct values of any column."""
    return table.df.select(F.col(f"`{name}`").alias("value")).distinct().orderBy("value")


def mode(table: Table, name: str):
    """The most frequent value, the smallest of equally frequent ones; None without values."""
    found = table.df.where(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").alias("v")).count().orderBy(F.desc("count"), "v").first()
    return found[0] if found else None
