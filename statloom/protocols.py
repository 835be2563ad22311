"""What tables, columns and models offer, as structural types."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame

from statloom.plans.linmod.summary import Coefficient, ModelStatistics, ModelSummary
from statloom.schema import SeriesStats, Shape


@runtime_checkable
class DataView(Protocol):
    @property
    def column_names(self) -> list[str]: ...

    def shape(self) -> Shape: ...

    def has_column(self, name: str) -> bool: ...


@runtime_checkable
class ColumnLike(Protocol):
    @property
    def dtype(self) -> str: ...

    def __len__(self) -> int: ...

    def get(self, i: int): ...

    def stats(self) -> SeriesStats: ...


@runtime_checkable
class AsMatrix(Protocol):
    def numeric_matrix(self) -> DataFrame: ...


@runtime_checkable
class StatisticalModel(Protocol):
    def fit(self) -> StatisticalModel: ...

    def predict(self, table) -> DataFrame: ...

    def summary(self) -> ModelSummary: ...


@runtime_checkable
class ModelResult(Protocol):
    @property
    def n_obs(self) -> int: ...

    @property
    def df_residual(self) -> int: ...

    def to_coefficients(self) -> list[Coefficient]: ...

    def statistics(self) -> ModelStatistics: ...

    def cov_matrix(self) -> np.ndarray: ...
