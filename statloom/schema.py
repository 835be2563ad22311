"""Column types, frozen levels and small metadata records."""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Key of a field's metadata that holds the frozen, sorted levels of a categorical column.
LEVELS = "statloom.levels"


class ColumnType(enum.Enum):
    FLOAT = "float64"
    INT = "int64"
    BOOL = "bool"
    STRING = "string"
    CATEGORICAL = "categorical"
    UNKNOWN = "unknown"

    def is_numeric(self) -> bool:
        return self in (ColumnType.FLOAT, ColumnType.INT, ColumnType.BOOL)

    def is_categorical(self) -> bool:
        return self is ColumnType.CATEGORICAL

    def is_string(self) -> bool:
        return self is ColumnType.STRING

    def __str__(self) -> str:
        return self.value


def column_type(data_type: T.DataType, levels: list[str] | None = None) -> ColumnType:
    """Types beyond the five are UNKNOWN: they pass through and count as non-numeric."""
    if levels is not None:
        return ColumnType.CATEGORICAL
    if isinstance(data_type, T.DoubleType | T.FloatType):
        return ColumnType.FLOAT
    if isinstance(data_type, T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        return ColumnType.INT
    if isinstance(data_type, T.BooleanType):
        return ColumnType.BOOL
    return ColumnType.STRING if isinstance(data_type, T.StringType) else ColumnType.UNKNOWN


@dataclass(frozen=True)
class Shape:
    rows: int
    cols: int

    def is_empty(self) -> bool:
        return self.rows == 0 or self.cols == 0


@dataclass(frozen=True)
class Dimensions:
    shape: tuple[int, ...]

    def size(self) -> int:
        return math.prod(self.shape)


@dataclass(frozen=True)
class SeriesStats:
    """Summary of one column; figures that don't apply are NaN."""

    count: int = 0
    mean: float = math.nan
    std: float = math.nan
    min: float = math.nan
    q25: float = math.nan
    q50: float = math.nan
    q75: float = math.nan
    max: float = math.nan
    unique_count: int | None = field(default=None)

    @classmethod
    def empty(cls) -> SeriesStats:
        return cls()
