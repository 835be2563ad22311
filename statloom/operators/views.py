"""Views: a column of a table, a filtered table, a row. They hold plans, not data; every figure is an action."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from statloom.operators import stats
from statloom.operators.table import POSITION, Table, get_bool, get_float, get_int, get_string
from statloom.schema import ColumnType, SeriesStats, Shape


class ColumnView:
    """One column of a table in key order."""

    def __init__(self, table: Table, name: str):
        table._need(name)
        self.table, self.name = table, name

    @property
    def dtype(self) -> str:
        return self.table.dtype(self.name)

    @property
    def kind(self) -> ColumnType:
        return self.table.column_type(self.name)

    def __len__(self) -> int:
        return self.table.df.count()

    def is_empty(self) -> bool:
        return self.table.df.isEmpty()

    def get(self, i: int):
        return self.table.get(self.name, i)

    def slice(self, start: int, end: int) -> ColumnView | None:
        part = self.table.slice_view(start, end)
        return None if part is None else ColumnView(part, self.name)

    def filter(self, mask: Column) -> ColumnView:
        return ColumnView(self.table.filter(mask), self.name)

    def to_float(self) -> DataFrame:
        return self.table.df.select(self.table.to_float(self.name).alias(self.name))

    def _only(self, kind: ColumnType) -> DataFrame | None:
        """The column if it has exactly this type."""
        return self.table.df.select(F.col(f"`{self.name}`")) if self.kind is kind else None

    def as_float(self) -> DataFrame | None:
        return self._only(ColumnType.FLOAT)

    def as_int(self) -> DataFrame | None:
        return self._only(ColumnType.INT)

    def as_bool(self) -> DataFrame | None:
        return self._only(ColumnType.BOOL)

    def stats(self) -> SeriesStats:
        """For float columns only."""
        return stats.series_stats(self.table, self.name, floats_only=True)

    def describe(self) -> SeriesStats:
        return stats.series_stats(self.table, self.name)

    def mean(self) -> float:
        return stats.mean(self.table, self.name)

    def std(self, ddof: int = 1) -> float:
        return stats.std(self.table, self.name, ddof)

    def sum(self) -> float:
        return stats.total(self.table, self.name)

    def reorder(self, indices: list[int]) -> DataFrame:
        return self.table.reorder_column(self.name, indices)

    def set(self, i: int, value) -> ColumnView:
        """A view of a table with this cell changed."""
        return ColumnView(self.table.set(self.name, i, value), self.name)

    def __iter__(self) -> Iterator:
        return (r[self.name] for r in self.table.select([self.name]).rows())


class FilteredView:
    """A table behind a Boolean mask."""

    def __init__(self, table: Table, mask: Column):
        self.table = table.filter(mask)

    def shape(self) -> Shape:
        return self.table.shape()

    def rows(self) -> Iterator[Row]:
        return self.table.rows()


class RowView:
    """One row with its position; getters convert between numbers and truth values, or give None."""

    def __init__(self, row: Row, index: int):
        self.row, self.index = row, index

    def get(self, name: str):
        return self.row[name] if name in self.row else None

    def get_float(self, name: str) -> float | None:
        return get_float(self.row, name)

    def get_int(self, name: str) -> int | None:
        return get_int(self.row, name)

    def get_bool(self, name: str) -> bool | None:
        return get_bool(self.row, name)

    def get_string(self, name: str) -> str | None:
        return get_string(self.row, name)

    def to_list(self) -> list:
        return list(self.row)


def columns(table: Table) -> Iterator[ColumnView]:
    return (ColumnView(table, c) for c in table.column_names)


def row_views(table: Table) -> Iterator[RowView]:
    """Rows in key order with their positions."""
    placed = table.positions().orderBy(POSITION)
    names = [F.col(f"`{c}`") for c in table.column_names]
    return (RowView(Row(*table.column_names)(*tuple(r)[1:]), r[0]) for r in placed.select(POSITION, *names).toLocalIterator())


def float_matrix(table: Table) -> DataFrame:
    """Float columns only, as doubles."""
    return table.df.select(*(table.to_float(c).alias(c) for c in table.numeric_columns([ColumnType.FLOAT])))
