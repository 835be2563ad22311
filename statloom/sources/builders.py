"""Building tables from values, ranges and Parquet files, and writing them."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.errors import DimensionMismatch, DuplicateColumn, InvalidParameter
from statloom.operators.table import Table

#: Order key of tables that are built from values.
ROW = "row_id"

TYPES = {"float": T.DoubleType(), "int": T.LongType(), "bool": T.BooleanType(), "string": T.StringType(), "categorical": T.StringType()}


class Column:
    """A typed list of values that a table is built from."""

    def __init__(self, kind: str, values: Iterable, name: str | None = None):
        self.kind, self.name = kind, name
        convert = {"float": float, "int": int, "bool": bool}.get(kind, str)
        self.values = [None if v is None else convert(v) for v in values]
        self.levels = sorted({v for v in self.values if v is not None}) if kind == "categorical" else None

    @classmethod
    def floats(cls, values: Iterable) -> Column:
        return cls("float", values)

    @classmethod
    def ints(cls, values: Iterable) -> Column:
        return cls("int", values)

    @classmethod
    def bools(cls, values: Iterable) -> Column:
        return cls("bool", values)

    @classmethod
    def strings(cls, values: Iterable) -> Column:
        return cls("string", values)

    @classmethod
    def categorical(cls, values: Iterable) -> Column:
        return cls("categorical", values)

    def __len__(self) -> int:
        return len(self.values)


class ColumnBuilder:
    """Fluent form: ColumnBuilder().floats([...]).name("x").build()."""

    def __init__(self) -> None:
        self._kind: str | None = None
        self._values: list = []
        self._name: str | None = None

    def _set(self, kind: str, values: Iterable) -> ColumnBuilder:
        self._kind, self._values = kind, list(values)
        return self

    def floats(self, values: Iterable) -> ColumnBuilder:
        return self._set("float", values)

    def ints(self, values: Iterable) -> ColumnBuilder:
        return self._set("int", values)

    def bools(self, values: Iterable) -> ColumnBuilder:
        return self._set("bool", values)

    def strings(self, values: Iterable) -> ColumnBuilder:
        return self._set("string", values)

    def categorical(self, values: Iterable) -> ColumnBuilder:
        return self._set("categorical", values)

    def name(self, name: str) -> ColumnBuilder:
        self._name = name
        return self

    def build(self) -> Column:
        if self._kind is None:
            raise InvalidParameter("a column needs data")
        return Column(self._kind, self._values, self._name)


class TableBuilder:
    """Columns of equal length and distinct names, with an optional index as the order key."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.columns, self.index = spark, {}, None

    def with_column(self, name: str, column: Column) -> TableBuilder:
        if name in self.columns:
            raise DuplicateColumn(name)
        for other in self.columns.values():
            if len(other) != len(column):
                raise DimensionMismatch(len(other), len(column))
        self.columns[name] = column
        return self

    def with_index(self, index: Index) -> TableBuilder:
        """Kept only if its length fits, as soon as the table is built."""
        self.index = index
        return self

    def build(self) -> Table:
        n = len(next(iter(self.columns.values()))) if self.columns else 0
        schema = T.StructType([T.StructField(ROW, T.LongType(), False), *(T.StructField(c, TYPES[v.kind]) for c, v in self.columns.items())])
        rows = [(i, *(v.values[i] for v in self.columns.values())) for i in range(n)]
        levels = {c: v.levels for c, v in self.columns.items() if v.levels is not None}
        index = self.index if self.index is not None and len(self.index) == n else None
        return Table(self.spark.createDataFrame(rows, schema), key=ROW, hidden_key=True, levels=levels, index=index)


def empty(spark: SparkSession) -> Table:
    return TableBuilder(spark).build()


def from_columns(spark: SparkSession, columns: Iterable[tuple[str, Column]]) -> Table:
    builder = TableBuilder(spark)
    for name, column in columns:
        builder.with_column(name, column)
    return builder.build()


class Index:
    """Row labels: a range, or any list of integers, strings or floats. A table carries it; only slices read it."""

    def __init__(self, values: range | list):
        self.values = values

    @classmethod
    def range(cls, start: int, end: int, step: int = 1) -> Index:
        if step < 1:
            raise InvalidParameter("the step must be positive")
        return cls(range(start, end, step))

    @classmethod
    def from_len(cls, n: int) -> Index:
        return cls(range(n))

    @classmethod
    def generic(cls, values: Iterable) -> Index:
        return cls(list(values))

    def __len__(self) -> int:
        return len(self.values)

    def is_empty(self) -> bool:
        return not len(self.values)

    def get(self, i: int):
        return self.values[i] if 0 <= i < len(self.values) else None

    def slice(self, start: int, end: int) -> Index:
        return Index(self.values[start:end])

    def frame(self, spark: SparkSession) -> DataFrame:
        """(row_id, label) for joins; a range is generated by the executors."""
        if isinstance(self.values, range):
            r = self.values
            return spark.range(len(r)).select(F.col("id").alias(ROW), (F.col("id") * r.step + r.start).alias("label"))
        kind = T.StringType() if any(isinstance(v, str) for v in self.values) else T.DoubleType() if any(isinstance(v, float) and not math.isnan(v) for v in self.values) else T.LongType()
        return spark.createDataFrame(list(enumerate(self.values)), T.StructType([T.StructField(ROW, T.LongType()), T.StructField("label", kind)]))


def read_parquet(spark: SparkSession, path: str, key: str | None = None, categorical: Iterable[str] = ()) -> Table:
    """A table over Parquet files. 32-bit integers widen to 64 bits; categoricals are declared, never inferred."""
    df = spark.read.parquet(path)
    wide = [F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType) else F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.FloatType) else F.col(f.name) for f in df.schema]
    table = Table(df.select(*wide), key=key)
    for c in categorical:
        table = table.as_categorical(c)
    return table


def write_parquet(table: Table, path: str, mode: str = "errorifexists") -> None:
    table.df.write.mode(mode).parquet(path)
