"""Diagnostics of a fitted linear model."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.errors import InvalidParameter
from statloom.plans.linmod import dist
from statloom.plans.linmod.gram import cross_products
from statloom.plans.linmod.ols import INTERCEPT, LinearModel

#: Rows up to which the Shapiro-Wilk approximation is defined.
SHAPIRO_ROWS = 5000


@dataclass(frozen=True)
class Vif:
    variable: str
    vif: float
    tolerance: float


@dataclass(frozen=True)
class DurbinWatson:
    statistic: float
    p_value: float | None
    autocorrelation: float


@dataclass(frozen=True)
class BreuschPagan:
    statistic: float
    p_value: float
    df: int


@dataclass(frozen=True)
class ShapiroWilk:
    statistic: float
    p_value: float


@dataclass(frozen=True)
class Diagnosis:
    vif: list[Vif]
    durbin_watson: DurbinWatson | None
    breusch_pagan: BreuschPagan
    shapiro_wilk: ShapiroWilk | None
    cooks_outliers: DataFrame
    high_leverage: DataFrame
    influence_points: DataFrame


def vif(model: LinearModel) -> list[Vif]:
    """Diagonal of the inverse correlation matrix of the design columns, without the intercept."""
    out = []
    if not model.free:
        return out
    has = len(model.free) < model.p
    if has:
        # inner_inv is the inverse of the centred cross products, so its diagonal times theirs is the inflation.
        d = [model.design.columns[j][1] - F.lit(float(model.centre[j])) for j in model.free]
        own = np.diag(cross_products(model.table.df, d))
        values = np.diag(model.inner_inv) * own
    else:
        x = [model.design.columns[j][1] for j in model.free]
        means = [0.0 if v is None else v for v in model.table.df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x))).first()]
        gram = cross_products(model.table.df, [c - F.lit(m) for c, m in zip(x, means, strict=True)])
        size = np.sqrt(np.diag(gram))
        with np.errstate(invalid="ignore", divide="ignore"):
            values = np.diag(np.linalg.pinv(gram / np.outer(size, size)))
    for j, v in zip(model.free, values, strict=True):
        out.append(Vif(model.names[j], float(v), 1 / float(v) if v else math.inf))
    return out


def durbin_watson(model: LinearModel) -> DurbinWatson:
    d = model.durbin_watson()
    return DurbinWatson(d, None, 1 - d / 2)


def breusch_pagan(model: LinearModel) -> BreuschPagan:
    """n R^2 of the squared residuals on the design, chi-square with p - 1 degrees of freedom."""
    df = model.p - 1
    if df < 1 or INTERCEPT not in model.names:
        raise InvalidParameter("the test needs an intercept and a predictor")
    e = model.residual_expr()
    mean = model.rss / model.n
    g = e * e - F.lit(mean)
    d = [model.design.columns[j][1] - F.lit(float(model.centre[j])) for j in model.free]
    gram = cross_products(model.table.df, [*d, g])
    cross = gram[:-1, -1]
    explained = cross @ model.inner_inv @ cross
    statistic = model.n * explained / gram[-1, -1] if gram[-1, -1] else 0.0
    return BreuschPagan(float(statistic), dist.chi2_upper(statistic, df), df)


def shapiro_wilk(model: LinearModel) -> ShapiroWilk:
    """Royston's 1995 approximation, for 3 to SHAPIRO_ROWS residuals, which the driver sorts."""
    n = model.n
    if not 3 <= n <= SHAPIRO_ROWS:
        raise InvalidParameter(f"the test is defined for 3 to {SHAPIRO_ROWS} rows, not {n}")
    e = np.sort([r[0] for r in model.table.df.select(model.residual_expr()).collect()])
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, ss = 1 / math.sqrt(n), float(m @ m)
    a = np.zeros(n)
    if n == 3:
        a[[0, 2]] = -math.sqrt(0.5), math.sqrt(0.5)
    else:
        # Polynomial corrections of the outer weights (fixed values).
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(ss)], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ss)], u)
            rest = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(rest)
            a[1], a[-2] = -second, second
        else:
            rest = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(rest)
        a[0], a[-1] = -last, last
    spread = float(((e - e.mean()) ** 2).sum())
    w = min(1.0, float(a @ e) ** 2 / spread) if spread else 1.0
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return ShapiroWilk(w, min(1.0, p))
    if w >= 1:
        return ShapiroWilk(w, 1.0)
    if n <= 11:
        # Fixed values for small samples.
        g = -2.273 + 0.459 * n
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        shown = g - math.log1p(-w)
        if shown <= 0:
            return ShapiroWilk(w, 0.0)
        z = (-math.log(shown) - mu) / sigma
    else:
        # Fixed values for larger samples.
        k = math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
        z = (math.log1p(-w) - mu) / sigma
    return ShapiroWilk(w, 1 - NormalDist().cdf(z))


def cooks_outliers(model: LinearModel) -> DataFrame:
    return model.influential_points().withColumn("threshold", F.lit(4 / model.n))


def high_leverage(model: LinearModel) -> DataFrame:
    return model.high_leverage_points().withColumn("threshold", F.lit(2 * model.p / model.n))


def influence_points(model: LinearModel) -> DataFrame:
    """Rows whose |DFFITS| exceeds 2 sqrt(p / n), with their DFBETAS."""
    return model.influence(dfbetas=True).where(F.abs("dffits") > 2 * math.sqrt(model.p / model.n))


def run_all(model: LinearModel) -> Diagnosis:
    has = INTERCEPT in model.names and model.p > 1
    return Diagnosis(
        vif(model),
        durbin_watson(model) if model.table.key else None,
        breusch_pagan(model) if has else BreuschPagan(math.nan, math.nan, 0),
        shapiro_wilk(model) if 3 <= model.n <= SHAPIRO_ROWS else None,
        cooks_outliers(model),
        high_leverage(model),
        influence_points(model),
    )
