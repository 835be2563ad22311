"""Fluent verbs over Table: Filter, Select, Mutate, Arrange. Nothing runs before an action on the result."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.table import Table


class Filter:
    """Predicates are joined by AND."""

    def __init__(self, table: Table):
        self.table, self.mask = table, F.lit(True)

    def by_column(self, name: str, predicate: Callable[[Column], Column]) -> Filter:
        """predicate gets the column, or a null literal if there is none of that name."""
        column = self.table.get_column(name)
        self.mask = self.mask & F.coalesce(predicate(F.lit(None) if column is None else column), F.lit(False))
        return self

    def by_row(self, predicate: Callable[[Table], Column]) -> Filter:
        """predicate gets the table and returns a Boolean column over any of its columns."""
        self.mask = self.mask & F.coalesce(predicate(self.table), F.lit(False))
        return self

    def execute(self) -> Table:
        return self.table.filter(self.mask)


class Select:
    def __init__(self, table: Table):
        self.table, self.names = table, []

    def columns(self, names: Iterable[str]) -> Select:
        self.names += list(names)
        return self

    def column(self, name: str) -> Select:
        self.names.append(name)
        return self

    def execute(self) -> Table:
        return self.table.select(self.names)


class Mutate:
    """Changes apply one after the other."""

    def __init__(self, table: Table):
        self.table, self.changes = table, []

    def mutate(self, name: str, change: Callable[[Column], Column]) -> Mutate:
        self.changes.append((name, change))
        return self

    def execute(self) -> Table:
        out = self.table
        for name, change in self.changes:
            out = out.mutate(name, change)
        return out


class Arrange:
    def __init__(self, table: Table):
        self.table, self.keys = table, []

    def by(self, name: str, ascending: bool = True) -> Arrange:
        self.keys.append((name, ascending))
        return self

    def execute(self) -> Table:
        return self.table.arrange(self.keys)

    def ranked(self, name: str) -> DataFrame:
        """The rows in any order with their 0-based position in the one that execute() gives."""
        return self.table.ranked(self.keys, name)
