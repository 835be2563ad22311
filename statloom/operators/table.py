"""Table: a lazy DataFrame with an order key and frozen categorical levels, and the verbs on it.

Every verb returns a new Table over a DataFrame expression, so Catalyst prunes and pushes down across verbs. Positions
exist only through the order key, a unique column; verbs that need one say so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from statloom import schema
from statloom.errors import ColumnNotFound, DimensionMismatch, DuplicateColumn, IndexOutOfBounds, InvalidParameter, NonNumericData, TypeMismatch
from statloom.functions.ordering import with_position
from statloom.schema import ColumnType, Shape

POSITION = "__position"


class Table:
    """hidden_key: the key isn't one of the table's columns, it only orders the rows."""

    def __init__(self, df: DataFrame, key: str | None = None, levels: dict[str, list[str]] | None = None, hidden_key: bool = False, index=None):
        if key is not None and key not in df.columns:
            raise ColumnNotFound(key)
        self.df, self.key, self.hidden_key, self.index = df, key, hidden_key and key is not None, index
        declared = {f.name: f.metadata[schema.LEVELS] for f in df.schema if f.metadata and schema.LEVELS in f.metadata}
        self.levels = {c: list(v) for c, v in (declared | (levels or {})).items() if c in df.columns}

    # --- metadata -------------------------------------------------------------------------------------------------

    def _with(self, df: DataFrame, levels: dict[str, list[str]] | None = None) -> Table:
        return Table(df, self.key if self.key in df.columns else None, self.levels if levels is None else levels, self.hidden_key)

    def _keyed(self, names: Iterable[str]) -> list[str]:
        """The names, and the key where it has to travel with them."""
        names = list(names)
        return [self.key, *names] if self.hidden_key and self.key not in names else names

    @property
    def column_names(self) -> list[str]:
        return [c for c in self.df.columns if not (self.hidden_key and c == self.key)]

    @property
    def ncols(self) -> int:
        return len(self.column_names)

    def nrows(self) -> int:
        return self.df.count() if self.column_names else 0

    def shape(self) -> Shape:
        return Shape(self.nrows(), self.ncols)

    def has_column(self, name: str) -> bool:
        return name in self.column_names

    def _need(self, name: str) -> None:
        if not self.has_column(name):
            raise ColumnNotFound(name)

    def get_column(self, name: str) -> Column | None:
        return F.col(f"`{name}`") if self.has_column(name) else None

    def column_type(self, name: str) -> ColumnType:
        self._need(name)
        return schema.column_type(self.df.schema[name].dataType, self.levels.get(name))

    def dtype(self, name: str) -> str:
        return str(self.column_type(name))

    def is_categorical(self, name: str) -> bool:
        return self.has_column(name) and self.column_type(name).is_categorical()

    def is_numeric(self, name: str) -> bool:
        return self.has_column(name) and self.column_type(name).is_numeric()

    def __repr__(self) -> str:
        return f"DataFrame({self.nrows()} rows × {self.ncols} cols)"

    def visible(self) -> DataFrame:
        """The DataFrame without a hidden key."""
        return self.df.select(*(F.col(f"`{c}`") for c in self.column_names))

    # --- columns --------------------------------------------------------------------------------------------------

    def select(self, names: Iterable[str]) -> Table:
        names = list(names)
        for i, c in enumerate(names):
            self._need(c)
            if c in names[:i]:
                raise DuplicateColumn(c)
        return self._with(self.df.select(*(F.col(f"`{c}`") for c in self._keyed(names))))

    def select_by_index(self, indices: Iterable[int]) -> Table:
        """Positions outside the table are skipped."""
        names = self.column_names
        return self.select([names[i] for i in indices if 0 <= i < len(names)])

    def with_column(self, name: str, column: Column) -> Table:
        if self.has_column(name):
            raise DuplicateColumn(name)
        return self._with(self.df.withColumn(name, column))

    def mutate(self, name: str, change: Callable[[Column], Column]) -> Table:
        """Replace an existing column by change(column)."""
        self._need(name)
        levels = {c: v for c, v in self.levels.items() if c != name}
        return self._with(self.df.withColumn(name, change(F.col(f"`{name}`"))), levels)

    def rename(self, pairs: Iterable[tuple[str, str]]) -> Table:
        """One after the other; a renamed column moves to the end."""
        out = self
        for old, new in pairs:
            out._need(old)
            if new != old and out.has_column(new):
                raise DuplicateColumn(new)
            rest = [F.col(f"`{c}`") for c in out._keyed(c for c in out.column_names if c != old)]
            levels = {(new if c == old else c): v for c, v in out.levels.items()}
            key = new if out.key == old else out.key
            out = Table(out.df.select(*rest, F.col(f"`{old}`").alias(new)), key, levels, out.hidden_key)
        return out

    def drop(self, names: Iterable[str]) -> Table:
        names = list(names)
        for c in names:
            self._need(c)
        return self._with(self.df.select(*(F.col(f"`{c}`") for c in self._keyed(c for c in self.column_names if c not in names))))

    def as_categorical(self, name: str, levels: Iterable[str] | None = None, most: int = 100_000) -> Table:
        """Freeze the sorted distinct values, or the given levels. More than `most` distinct values are an error."""
        self._need(name)
        if levels is None:
            levels = [r[0] for r in self.df.select(F.col(f"`{name}`").cast("string")).where(F.col(f"`{name}`").isNotNull()).distinct().limit(most + 1).collect()]
            if len(levels) > most:
                raise InvalidParameter(f"{name!r} has more than {most} distinct values; give its levels")
        return self._with(self.df.withColumn(name, F.col(f"`{name}`").cast("string")), self.levels | {name: sorted(levels)})

    def codes(self, name: str) -> Column:
        """0-based positions of a categorical column's values in its levels."""
        self._need(name)
        if name not in self.levels:
            raise TypeMismatch(name, "categorical", self.dtype(name))
        found = F.array_position(F.array(*map(F.lit, self.levels[name])), F.col(f"`{name}`")) - 1
        return F.when(found >= 0, found).cast("long")

    def to_float(self, name: str) -> Column:
        """Numbers and booleans as double, categoricals as their codes."""
        kind = self.column_type(name)
        if kind.is_categorical():
            return self.codes(name).cast("double")
        if not kind.is_numeric():
            raise NonNumericData(f"column {name!r} is {kind}")
        return F.col(f"`{name}`").cast("double")

    def numeric_columns(self, only: Iterable[ColumnType] | None = None) -> list[str]:
        kinds = set(only) if only is not None else {ColumnType.FLOAT, ColumnType.INT, ColumnType.BOOL}
        return [c for c in self.column_names if self.column_type(c) in kinds]

    def numeric_matrix(self) -> DataFrame:
        """Float, int and bool columns as doubles, in order, after the order key if there is one."""
        return self.df.select(*([F.col(f"`{self.key}`")] if self.hidden_key else []), *(self.to_float(c).alias(c) for c in self.numeric_columns()))

    # --- rows -----------------------------------------------------------------------------------------------------

    def filter(self, mask: Column) -> Table:
        """Rows where the Boolean column holds; levels stay."""
        return self._with(self.df.where(mask))

    filter_with = filter

    def filter_mask(self, mask: list[bool] | DataFrame) -> Table:
        """An external list, one value a row in key order; or, for tables of any size, a frame (position, keep)."""
        if isinstance(mask, DataFrame):
            at, keep = mask.columns
            kept = mask.where(F.col(keep)).select(F.col(at).alias("__at"))
            return self._with(self.positions().join(kept, F.col(POSITION) == F.col("__at"), "left_semi").drop(POSITION))
        n = self.nrows()
        if len(mask) != n:
            raise DimensionMismatch(n, len(mask))
        kept = self.df.sparkSession.createDataFrame([(i,) for i, m in enumerate(mask) if m], "__at long")
        found = self.positions().join(kept, F.col(POSITION) == F.col("__at"), "left_semi")
        return self._with(found.drop(POSITION))

    def _order(self) -> str:
        if self.key is None:
            raise InvalidParameter("positions need an order key: Table(df, key=...)")
        return self.key

    def positions(self) -> DataFrame:
        """The DataFrame with POSITION, 0-based in key order."""
        return with_position(self.df, self._order(), POSITION)

    def slice(self, start: int, end: int) -> Table:
        """Rows of positions start to end - 1."""
        if not 0 <= start <= end:
            raise InvalidParameter(f"slice {start}:{end}")
        if end > (n := self.nrows()):
            raise IndexOutOfBounds(end, n)
        at = F.col(POSITION)
        out = self._with(self.positions().where((at >= start) & (at < end)).drop(POSITION))
        out.index = self.index.slice(start, end) if self.index is not None else None
        return out

    def slice_view(self, start: int, end: int) -> Table | None:
        """Like slice, but None where the range doesn't fit."""
        n = self.nrows()
        return None if start >= n or end > n or start > end else self.slice(start, end)

    def reorder_rows(self, indices: list[int]) -> DataFrame:
        """Rows at the given positions, in that order and repeated as given, with `position` in the result."""
        n = self.nrows()
        for i in indices:
            if not 0 <= i < n:
                raise IndexOutOfBounds(i, n)
        wanted = self.df.sparkSession.createDataFrame(list(enumerate(indices)), "position long, __at long")
        found = self.positions().join(wanted, F.col(POSITION) == F.col("__at"))
        return found.select("position", *(F.col(f"`{c}`") for c in self.column_names)).orderBy("position")

    def reorder_column(self, name: str, indices: list[int]) -> DataFrame:
        """(position, value): values of one column at the given positions; outside the table NaN, 0, false, "" or the first level."""
        kind = self.column_type(name)
        missing = {ColumnType.FLOAT: float("nan"), ColumnType.INT: 0, ColumnType.BOOL: False, ColumnType.CATEGORICAL: (self.levels.get(name) or [""])[0]}.get(kind, "")
        wanted = self.df.sparkSession.createDataFrame(list(enumerate(indices)), "position long, __at long")
        found = wanted.join(self.positions().select(POSITION, F.col(f"`{name}`").alias("value")), F.col(POSITION) == F.col("__at"), "left")
        return found.select("position", F.when(F.col(POSITION).isNull(), F.lit(missing)).otherwise(F.col("value")).alias("value")).orderBy("position")

    def arrange(self, by: list[tuple[str, bool]]) -> Table:
        """Stable sort by (column, ascending); unknown columns are ignored, NaN comes last ascending."""
        keys = [F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in by if self.has_column(c)]
        if not keys:
            return self
        return self._with(self.df.orderBy(*keys, *([F.col(f"`{self.key}`")] if self.key else [])))

    def ranked(self, by: list[tuple[str, bool]], name: str) -> DataFrame:
        """The rows with their 0-based position in the order that arrange(by) gives."""
        keys = [(c, up) for c, up in by if self.has_column(c)] + ([(self.key, True)] if self.key else [])
        return with_position(self.df, keys, name)

    def sample(self, n: int, replace: bool = False, seed: int = 0) -> Table:
        """n rows by the order of md5(seed-key): the same rows on every run, returned in key order.

        With replacement, n positions are drawn from 60 bits of md5(seed-draw), so rows can repeat.
        """
        key = F.col(f"`{self._order()}`")
        if replace:
            total = self.nrows()
            if not total:
                raise InvalidParameter("nothing to draw from")
            draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long") % total
            drawn = self.df.sparkSession.range(n).select(draw.alias("__at"))
            return self._with(self.positions().join(drawn, F.col(POSITION) == F.col("__at")).drop(POSITION, "__at").orderBy(key))
        mark = F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))
        chosen = self.df.orderBy(mark, key).limit(n)
        if n > (total := self.nrows()):
            raise InvalidParameter(f"{n} of {total} rows")
        return self._with(chosen.orderBy(key))

    def get_row(self, i: int) -> Row:
        found = self.positions().where(F.col(POSITION) == i).select(*(F.col(f"`{c}`") for c in self.column_names)).first() if i >= 0 else None
        if found is None:
            raise IndexOutOfBounds(i, self.nrows())
        return found

    def get(self, name: str, i: int):
        """One cell, or None outside the table; categoricals give their label."""
        self._need(name)
        found = self.positions().where(F.col(POSITION) == i).select(F.col(f"`{name}`")).first()
        return found[0] if found else None

    def set(self, name: str, i: int, value) -> Table:
        """A table with one cell changed; the value has to be of the column's type, or one of its levels."""
        kind = self.column_type(name)
        fits = {ColumnType.FLOAT: float, ColumnType.INT: int, ColumnType.BOOL: bool, ColumnType.STRING: str, ColumnType.CATEGORICAL: str}.get(kind)
        if fits is None or not isinstance(value, fits) or (fits is int and isinstance(value, bool)):
            raise TypeMismatch(name, str(kind), type(value).__name__)
        if kind.is_categorical() and value not in self.levels[name]:
            raise InvalidParameter(f"{value!r} is no level of {name!r}")
        if not 0 <= i < (n := self.nrows()):
            raise IndexOutOfBounds(i, n)
        changed = self.positions().withColumn(name, F.when(F.col(POSITION) == i, F.lit(value)).otherwise(F.col(f"`{name}`")))
        return self._with(changed.drop(POSITION))

    def rows(self) -> Iterator[Row]:
        """All rows in key order, streamed partition by partition to the driver."""
        ordered = self.df.orderBy(F.col(f"`{self.key}`")) if self.key else self.df
        return ordered.select(*(F.col(f"`{c}`") for c in self.column_names)).toLocalIterator()

    def view(self) -> Table:
        """A lazy DataFrame already is a view."""
        return self


def get_float(row: Row, name: str) -> float | None:
    v = row[name] if name in row else None
    return float(v) if isinstance(v, int | float) else None


def get_int(row: Row, name: str) -> int | None:
    """Floats lose their fraction, NaN is 0, and values beyond 64 bits go to the nearest end."""
    v = row[name] if name in row else None
    if isinstance(v, float):
        return 0 if v != v else int(max(-(2**63), min(2**63 - 1, v)))
    return int(v) if isinstance(v, int) else None


def get_bool(row: Row, name: str) -> bool | None:
    v = row[name] if name in row else None
    return v != 0 if isinstance(v, int | float) else None


def get_string(row: Row, name: str) -> str | None:
    v = row[name] if name in row else None
    return v if isinstance(v, str) else None
