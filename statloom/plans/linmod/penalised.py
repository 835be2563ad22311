"""Weighted, ridge, lasso, elastic-net and robust linear models on the same cross products.

Objective of the penalised models, with an unpenalised intercept: lasso and elastic net minimise
RSS / (2 n) + strength * (ratio * |b|_1 + (1 - ratio) / 2 * |b|_2^2), ridge minimises RSS + strength * |b|_2^2. One
aggregate gives the centred cross products; coordinate descent then runs on a p x p matrix of the driver.
Robust models repeat weighted fits; each round is one aggregate for the scale and one for the cross products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import InvalidConfig, MissingDataError, MissingResponse, NotConverged
from statloom.operators.stats import exact_quantiles
from statloom.operators.table import Table
from statloom.plans.formula.compile import Design, check_new_data, compile_formula
from statloom.plans.linmod.gram import cross_products
from statloom.plans.linmod.ols import INTERCEPT


@dataclass
class PlainFit:
    """Coefficients and predictions of a model without inference."""

    design: Design
    table: Table
    beta: np.ndarray
    iterations: int = 0

    @property
    def names(self) -> list[str]:
        return self.design.names

    def frame(self) -> DataFrame:
        rows = [(n, float(b)) for n, b in zip(self.names, self.beta, strict=True)]
        return self.table.df.sparkSession.createDataFrame(rows, "term string, estimate double")

    def expression(self) -> Column:
        out = F.lit(0.0)
        for b, (_, c) in zip(self.beta, self.design.columns, strict=True):
            out = out + F.lit(float(b)) * c
        return out

    def predict(self, table: Table) -> DataFrame:
        check_new_data(self.design, table)
        key = [F.col(f"`{table.key}`")] if table.key else []
        return table.df.select(*key, self.expression().alias("prediction"))


def _bind(formula: str, table: Table) -> Design:
    design = compile_formula(formula, table)
    if design.response is None:
        raise MissingResponse("the formula has no response")
    checked = [*design.columns, (design.formula.response, design.response)]
    # A null or unlisted category makes its dummies null.
    bad = table.df.agg(*(F.count_if(c.isNull() | F.isnan(c)).alias(f"c{i}") for i, (_, c) in enumerate(checked))).first()
    for (label, _), n in zip(checked, bad, strict=True):
        if n:
            raise MissingDataError(f"{label} has {n} missing values")
    return design


def _centred(design: Design, table: Table, weight: Column | None = None) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, list[int]]:
    """(sum of weights, means of x, mean of y, X'X, X'y, positions without the intercept), centred if there is one."""
    has = bool(design.columns) and design.columns[0][0] == INTERCEPT
    free = list(range(1 if has else 0, len(design.columns)))
    x, y = [design.columns[j][1] for j in free], design.response
    w = F.lit(1.0) if weight is None else weight
    row = [0.0 if v is None else v for v in table.df.agg(*(c.alias(f"m{i}") for i, c in enumerate([F.sum(w), *(F.sum(w * c) for c in [*x, y])]))).first()]
    total = row[0] or 1.0
    means = np.array(row[1:-1]) / total if has else np.zeros(len(free))
    my = row[-1] / total if has else 0.0
    gram = cross_products(table.df, [*(c - F.lit(float(m)) for c, m in zip(x, means, strict=True)), y - F.lit(float(my))], weight)
    return total, means, my, gram[:-1, :-1], gram[:-1, -1], free


def _whole(design: Design, free: list[int], gamma: np.ndarray, means: np.ndarray, my: float) -> np.ndarray:
    beta = np.zeros(len(design.columns))
    beta[free] = gamma
    if len(free) < len(beta):
        beta[0] = my - gamma @ means
    return beta


def weighted(formula: str, table: Table, weight: Column) -> PlainFit:
    """Weighted least squares with non-negative weights."""
    design = _bind(formula, table)
    _, means, my, a, b, free = _centred(design, table, weight)
    return PlainFit(design, table, _whole(design, free, np.linalg.lstsq(a, b, rcond=None)[0], means, my))


def ridge(formula: str, table: Table, strength: float) -> PlainFit:
    if strength < 0:
        raise InvalidConfig("the penalty can't be negative")
    design = _bind(formula, table)
    _, means, my, a, b, free = _centred(design, table)
    gamma = np.linalg.lstsq(a + strength * np.eye(len(b)), b, rcond=None)[0]
    return PlainFit(design, table, _whole(design, free, gamma, means, my))


def elastic_net(formula: str, table: Table, strength: float, ratio: float = 0.5, rounds: int = 10_000, tolerance: float = 1e-12) -> PlainFit:
    if strength < 0 or not 0 <= ratio <= 1:
        raise InvalidConfig("strength must be 0 or more and ratio between 0 and 1")
    design = _bind(formula, table)
    n, means, my, a, b, free = _centred(design, table)
    a, b = a / n, b / n
    gamma = np.zeros(len(b))
    for step in range(1, rounds + 1):
        moved = 0.0
        for j in range(len(b)):
            rest = b[j] - a[j] @ gamma + a[j, j] * gamma[j]
            below = a[j, j] + strength * (1 - ratio)
            new = np.sign(rest) * max(abs(rest) - strength * ratio, 0.0) / below if below > 0 else 0.0
            moved = max(moved, abs(new - gamma[j]) * np.sqrt(a[j, j]))
            gamma[j] = new
        if moved <= tolerance * (1 + np.abs(b).max(initial=0)):
            return PlainFit(design, table, _whole(design, free, gamma, means, my), step)
    raise NotConverged(f"no convergence in {rounds} rounds")


def lasso(formula: str, table: Table, strength: float) -> PlainFit:
    return elastic_net(formula, table, strength, 1.0)


def _huber(u: Column, k: float = 1.345) -> Column:
    return F.when(u <= k, 1.0).otherwise(F.try_divide(F.lit(k), u))


def _bisquare(u: Column, k: float = 4.685) -> Column:
    return F.when(u < k, F.pow(1 - F.pow(u / k, 2), 2)).otherwise(0.0)


def _hampel(u: Column, a: float = 2.0, b: float = 4.0, c: float = 8.0) -> Column:
    return F.when(u <= a, 1.0).when(u <= b, F.try_divide(F.lit(a), u)).when(u < c, F.try_divide(a * (c - u) / (c - b), u)).otherwise(0.0)


WEIGHTS = {"huber": _huber, "bisquare": _bisquare, "hampel": _hampel}


def robust(formula: str, table: Table, method: str = "huber", rounds: int = 50, tolerance: float = 1e-8) -> PlainFit:
    """Iteratively reweighted least squares; the scale is the median absolute residual over 0.6745."""
    if method not in WEIGHTS:
        raise InvalidConfig(f"method must be one of {', '.join(WEIGHTS)}")
    fit = weighted(formula, table, F.lit(1.0))
    for step in range(1, rounds + 1):
        size = F.abs(fit.design.response - fit.expression())
        scale = (exact_quantiles(table.df, size, [0.5])[0] or 0.0) / 0.6745
        if scale <= 1e-12:
            return PlainFit(fit.design, table, fit.beta, step)
        new = weighted(formula, table, WEIGHTS[method](size / F.lit(scale)))
        if np.abs(new.beta - fit.beta).max() <= tolerance * (1 + np.abs(fit.beta).max()):
            return PlainFit(new.design, table, new.beta, step)
        fit = new
    raise NotConverged(f"no convergence in {rounds} rounds")
