"""Ordinary least squares: three aggregate jobs and p x p algebra on the driver.

Job A binds the formula (domain checks, scaling constants) and counts missing values, means and scales of the design
columns. Job B sums the cross products of the centred columns. Job C sums squared residuals, and for robust errors the
middle of the sandwich. The design matrix is never stored: fitted values, residuals and influence are lazy expressions
over the table, with coefficients and (X'X)^-1 as literals.
"""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import InsufficientData, InvalidConfig, MissingDataError, MissingResponse, NotFitted, SingularMatrixError, VariableTypeMismatch
from statloom.functions.ordering import squared_steps
from statloom.operators.stats import QUARTILES, exact_quantiles
from statloom.operators.table import Table
from statloom.plans.formula.ast import Formula
from statloom.plans.formula.compile import Design, check_new_data, compile_formula, unlisted
from statloom.plans.formula.parser import parse
from statloom.plans.linmod import dist
from statloom.plans.linmod.gram import SUM_COLUMNS, cross_products, r_factor
from statloom.plans.linmod.summary import Coefficient, ModelStatistics, ModelSummary, ResidualStatistics

INTERCEPT = "(Intercept)"
#: Above this condition number of the scaled cross products the fit goes through a QR factorisation.
ILL_CONDITIONED = 1e12
FLOOR = 1e-10


class StandardErrors(enum.Enum):
    STANDARD = "standard"
    HC0 = "hc0"
    HC1 = "hc1"
    HC2 = "hc2"
    HC3 = "hc3"
    HAC = "hac"


@dataclass(frozen=True)
class LinearConfig:
    intercept: bool = True
    standard_errors: StandardErrors = StandardErrors.STANDARD
    confidence: float = 0.95
    center: bool = False
    scale: bool = False


@dataclass
class LinearRegression:
    """Builder: LinearRegression("y ~ x").data(table).robust(StandardErrors.HC1).fit()."""

    formula: Formula
    table: Table | None = None
    settings: LinearConfig = field(default_factory=LinearConfig)
    model: LinearModel | None = None

    def __init__(self, formula: str | Formula, table: Table | None = None, settings: LinearConfig | None = None):
        self.formula = parse(formula) if isinstance(formula, str) else formula
        self.table, self.settings, self.model = table, settings or LinearConfig(), None

    def data(self, table: Table) -> LinearRegression:
        return LinearRegression(self.formula, table, self.settings)

    def config(self, settings: LinearConfig) -> LinearRegression:
        return LinearRegression(self.formula, self.table, settings)

    def no_intercept(self) -> LinearRegression:
        return self.config(replace(self.settings, intercept=False))

    def robust(self, kind: StandardErrors) -> LinearRegression:
        return self.config(replace(self.settings, standard_errors=kind))

    def fit(self) -> LinearRegression:
        out = LinearRegression(self.formula, self.table, self.settings)
        out.model = fit(self.formula, self.table, self.settings)
        return out

    def _fitted(self) -> LinearModel:
        if self.model is None:
            raise NotFitted("call fit() first")
        return self.model

    def predict(self, table: Table) -> DataFrame:
        return self._fitted().predict(table)

    def summary(self) -> ModelSummary:
        return self._fitted().summary()

    def coefficients(self) -> np.ndarray:
        return self._fitted().beta

    def standard_errors(self) -> np.ndarray:
        return self._fitted().std_errors

    def fitted_values(self) -> DataFrame:
        return self._fitted().fitted()

    def residuals(self) -> DataFrame:
        return self._fitted().fitted()


def lm(formula: str | Formula, table: Table, settings: LinearConfig | None = None) -> LinearModel:
    return fit(parse(formula) if isinstance(formula, str) else formula, table, settings or LinearConfig())


def _aliased(x: np.ndarray, names: list[str], rank_tol: float) -> list[str]:
    """Columns that depend on earlier ones, by Gram-Schmidt on a factor of the cross products."""
    basis, out = np.zeros((x.shape[0], 0)), []
    for j, n in enumerate(names):
        v = x[:, j] - basis @ (basis.T @ x[:, j])
        size = np.linalg.norm(v)
        if size <= rank_tol * max(np.linalg.norm(x[:, j]), 1e-300):
            out.append(n)
        else:
            basis = np.column_stack([basis, v / size])
    return out


def fit(formula: Formula, table: Table | None, settings: LinearConfig) -> LinearModel:
    if table is None:
        raise InvalidConfig("no data provided")
    if formula.response is None:
        raise MissingResponse("the formula has no response")
    if settings.standard_errors is StandardErrors.HAC:
        raise InvalidConfig("HAC standard errors are not supported")
    if not settings.intercept:
        formula = formula.without_intercept()
    design = compile_formula(formula, table)
    x, y, names = [c for _, c in design.columns], design.response, design.names
    p = len(x)

    # Job A: rows, missing values, means and spreads.
    free = [j for j in range(p) if names[j] != INTERCEPT]
    factors = list(design.levels)
    checks = [F.count("*")] + [F.count_if(c.isNull() | F.isnan(c)) for c in [*(x[j] for j in free), y]]
    checks += [f(F.col(f"`{v}`"), design.levels[v]) for v in factors for f in (lambda c, _: F.count_if(c.isNull()), unlisted)]
    moments = [f(c) for c in [*(x[j] for j in free), y] for f in (F.avg, F.stddev_samp)]
    row = list(table.df.agg(*(c.alias(f"a{i}") for i, c in enumerate(checks + moments))).first())
    n = row[0]
    if n <= p:
        raise InsufficientData(n, p)
    held, row = row[len(free) + 2 : len(checks)], row[: len(free) + 2] + row[len(checks) :]
    for v, missing, other in zip(factors, held[::2], held[1::2], strict=True):
        if missing:
            raise MissingDataError(f"{v} has {missing} missing values")
        if other:
            raise VariableTypeMismatch(v, f"one of {', '.join(design.levels[v])}", f"{other} other values")
    for label, bad in zip([*(names[j] for j in free), formula.response], row[1 : len(free) + 2], strict=True):
        if bad:
            raise MissingDataError(f"{label} has {bad} missing values")
    figures = np.array([0.0 if v is None else v for v in row[len(free) + 2 :]], float).reshape(-1, 2)
    means, sds, y_mean = figures[:-1, 0], figures[:-1, 1], figures[-1, 0]
    if settings.center or settings.scale:
        spread = np.where((sds > FLOOR) & settings.scale, sds, 1.0)
        shift = means if settings.center else np.zeros(len(free))
        for k, j in enumerate(free):
            x[j] = (x[j] - F.lit(float(shift[k]))) / F.lit(float(spread[k]))
        means, sds = (means - shift) / spread, sds / spread
        design = replace(design, columns=list(zip(names, x, strict=True)))
    if not p:
        raise InvalidConfig("the formula has no terms")

    # Job B: cross products of centred and scaled columns; shift and unit are undone below.
    has_intercept = formula.intercept
    unit = np.array([s if s > 0 else 1.0 for s in sds])
    shift = means if has_intercept else np.zeros(len(free))
    y0 = y_mean if has_intercept else 0.0
    z = [(x[j] - F.lit(float(shift[k]))) / F.lit(float(unit[k])) for k, j in enumerate(free)]
    yz = y - F.lit(float(y0))
    q = len(free)
    if q:
        gram = cross_products(table.df, [*z, yz])
        a = gram[:q, :q]
        size = np.sqrt(np.maximum(np.diag(a), 1e-300))
        scaled = a / np.outer(size, size)
        values = np.linalg.eigvalsh(scaled)
        if values[0] <= values[-1] / ILL_CONDITIONED:
            r = r_factor(table.df, [*z, yz])
            rx = r[:q, :q] / size
            sing = np.linalg.svd(rx, compute_uv=False)
            if len(sing) < q or sing[-1] <= sing[0] * max(n, q) * np.finfo(float).eps:
                raise SingularMatrixError(_aliased(rx, [names[j] for j in free], 1e-10) or [names[free[-1]]])
            gamma = np.linalg.lstsq(rx, r[:q, q], rcond=None)[0] / size
            inner = np.linalg.inv(rx)
            inverse = (inner @ inner.T) / np.outer(size, size)
        else:
            gamma = np.linalg.solve(scaled, gram[:q, q] / size) / size
            inverse = np.linalg.inv(scaled) / np.outer(size, size)
        gamma, inverse = gamma / unit, inverse / np.outer(unit, unit)
    else:
        gamma, inverse = np.zeros(0), np.zeros((0, 0))
    beta, xtx_inv = np.zeros(p), np.zeros((p, p))
    beta[free] = gamma
    xtx_inv[np.ix_(free, free)] = inverse
    if has_intercept:
        beta[0] = y0 - gamma @ shift
        cross = -inverse @ shift
        xtx_inv[0, free] = xtx_inv[free, 0] = cross
        xtx_inv[0, 0] = 1 / n + shift @ inverse @ shift
    centre = np.zeros(p)
    centre[free] = shift

    model = LinearModel(formula, table, settings, design, beta, xtx_inv, n, y_mean, centre, inverse, free)
    model._job_c()
    return model


@dataclass
class LinearModel:
    """A fitted model. Frames carry the table's order key where it has one."""

    formula: Formula
    table: Table
    settings: LinearConfig
    design: Design
    beta: np.ndarray
    xtx_inv: np.ndarray
    n: int
    y_mean: float
    centre: np.ndarray
    inner_inv: np.ndarray
    free: list[int]
    rss: float = math.nan
    tss: float = math.nan
    std_errors: np.ndarray = field(default_factory=lambda: np.zeros(0))
    _residual_row: tuple = ()

    # --- expressions ----------------------------------------------------------------------------------------------

    @property
    def names(self) -> list[str]:
        return self.design.names

    @property
    def p(self) -> int:
        return len(self.beta)

    def fitted_expr(self) -> Column:
        """Around the column means, which keeps digits where means are large."""
        out = F.lit(float(self.beta @ np.where(np.isin(np.arange(self.p), self.free), self.centre, 1.0)))
        for j in self.free:
            out = out + F.lit(float(self.beta[j])) * (self.design.columns[j][1] - F.lit(float(self.centre[j])))
        return out

    def residual_expr(self) -> Column:
        return self.design.response - self.fitted_expr()

    def leverage_expr(self) -> Column:
        """x (X'X)^-1 x', from the centred columns."""
        has = len(self.free) < self.p
        d = [self.design.columns[j][1] - F.lit(float(self.centre[j])) for j in self.free]
        out = F.lit(1 / self.n if has else 0.0)
        if len(d) > SUM_COLUMNS:  # as many products as pairs would outgrow generated code
            inverse = self.inner_inv

            @F.arrow_udf("double")
            def quadratic(x: pa.Array) -> pa.Array:
                m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                return pa.array(((m @ inverse) * m).sum(axis=1))

            return out + quadratic(F.array(*d))
        for i in range(len(d)):
            for j in range(i, len(d)):
                out = out + F.lit(float(self.inner_inv[i, j] * (1 if i == j else 2))) * d[i] * d[j]
        return out

    # --- job C ----------------------------------------------------------------------------------------------------

    def _job_c(self) -> None:
        e, y = self.residual_expr(), self.design.response
        frame = self.table.df.select(e.alias("e"), y.alias("y"))
        c = F.col("e")
        aggs = [F.sum(c * c), F.sum((F.col("y") - F.lit(self.y_mean)) * (F.col("y") - F.lit(self.y_mean))), F.min(c), F.max(c), F.avg(c), F.stddev_samp(c), F.skewness(c), F.kurtosis(c)]
        row = frame.agg(*(a.alias(f"a{i}") for i, a in enumerate(aggs))).first()
        self.rss, self.tss = row[0], row[1]
        self._residual_row = tuple(row[2:])
        self.std_errors = np.sqrt(np.maximum(np.diag(self.cov_matrix()), FLOOR**2))

    def cov_matrix(self) -> np.ndarray:
        """Covariance of the coefficients: s^2 (X'X)^-1, or the sandwich of the chosen kind."""
        kind = self.settings.standard_errors
        if kind is StandardErrors.STANDARD:
            return self.rss / self.df_residual * self.xtx_inv
        if not hasattr(self, "_sandwich"):
            e = self.residual_expr()
            w = e * e
            if kind in (StandardErrors.HC2, StandardErrors.HC3):
                left = F.lit(1.0) - self.leverage_expr()
                w = w / (left if kind is StandardErrors.HC2 else left * left)
            # Centred columns keep the sums small; the shift is undone on the driver.
            has = len(self.free) < self.p
            d = [self.design.columns[j][1] - F.lit(float(self.centre[j])) for j in self.free]
            meat = cross_products(self.table.df, ([F.lit(1.0)] if has else []) + d, w)
            bread = np.zeros((self.p, self.p))
            bread[np.ix_(self.free, self.free)] = self.inner_inv
            if has:
                bread[0, 0] = 1 / self.n
            inner = bread @ meat @ bread
            back = np.eye(self.p)
            if has:
                back[0, self.free] = -self.centre[self.free]
            self._sandwich = back @ inner @ back.T * (self.n / self.df_residual if kind is StandardErrors.HC1 else 1.0)
        return self._sandwich

    # --- figures --------------------------------------------------------------------------------------------------

    @property
    def n_obs(self) -> int:
        return self.n

    @property
    def n_predictors(self) -> int:
        return self.p

    @property
    def df_residual(self) -> int:
        return self.n - self.p

    @property
    def ess(self) -> float:
        return self.tss - self.rss

    @property
    def r_squared(self) -> float:
        return 1 - self.rss / self.tss if self.tss else math.nan

    @property
    def adj_r_squared(self) -> float:
        return 1 - (1 - self.r_squared) * (self.n - 1) / self.df_residual

    @property
    def residual_std_error(self) -> float:
        return math.sqrt(self.rss / self.df_residual)

    @property
    def f_statistic(self) -> float | None:
        """None for a single coefficient."""
        if self.p == 1:
            return None
        return self.ess / (self.p - 1) / (self.rss / self.df_residual) if self.rss else math.inf

    @property
    def f_p_value(self) -> float | None:
        return None if self.f_statistic is None else dist.f_upper(self.f_statistic, self.p - 1, self.df_residual)

    @property
    def log_likelihood(self) -> float:
        if not self.rss:
            return math.inf
        return -self.n / 2 * (math.log(2 * math.pi * self.rss / self.n) + 1)

    @property
    def aic(self) -> float:
        return 2 * self.p - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.p * math.log(self.n) - 2 * self.log_likelihood

    @property
    def t_statistics(self) -> np.ndarray:
        return self.beta / self.std_errors

    @property
    def p_values(self) -> np.ndarray:
        return np.array([dist.t_two_sided(t, self.df_residual) for t in self.t_statistics])

    def confidence_intervals(self, level: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        half = dist.t_quantile(1 - (1 - (level or self.settings.confidence)) / 2, self.df_residual) * self.std_errors
        return self.beta - half, self.beta + half

    def to_coefficients(self) -> list[Coefficient]:
        low, high = self.confidence_intervals()
        rows = zip(self.names, self.beta, self.std_errors, self.t_statistics, self.p_values, low, high, strict=True)
        return [Coefficient(n, *map(float, v), is_intercept=n == INTERCEPT) for n, *v in rows]

    def coefficient_frame(self) -> DataFrame:
        """One row a coefficient."""
        rows = [(c.name, c.estimate, c.std_error, c.t_stat, c.p_value, c.ci_lower, c.ci_upper, c.is_intercept) for c in self.to_coefficients()]
        return self.table.df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t_stat double, p_value double, ci_lower double, ci_upper double, is_intercept boolean")

    def statistics(self) -> ModelStatistics:
        return ModelStatistics(
            r_squared=self.r_squared,
            adj_r_squared=self.adj_r_squared,
            f_statistic=self.f_statistic,
            f_p_value=self.f_p_value,
            log_likelihood=self.log_likelihood,
            aic=self.aic,
            bic=self.bic,
            residual_std_error=self.residual_std_error,
            df_residual=self.df_residual,
            df_model=self.p - 1,
            n_obs=self.n,
        )

    def statistics_frame(self) -> DataFrame:
        """One row: the figures of statistics() that a linear model has."""
        found = {k: v for k, v in vars(self.statistics()).items() if v is not None}
        schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in found.items())
        return self.table.df.sparkSession.createDataFrame([tuple(found.values())], schema)

    def residual_statistics(self) -> ResidualStatistics:
        low, high, mean, sd, skew, kurt = self._residual_row
        q = exact_quantiles(self.table.df, self.residual_expr(), QUARTILES, self.n)
        n = self.n
        flat = not sd or sd < FLOOR
        # Spark divides by the population deviation, these figures by the sample one.
        skewness = 0.0 if n < 3 or flat or skew is None else skew * ((n - 1) / n) ** 1.5
        kurtosis = 0.0 if n < 4 or flat or kurt is None else (kurt + 3) * ((n - 1) / n) ** 2 - 3
        return ResidualStatistics(low, *q, high, mean, 0.0 if sd is None else sd, skewness, kurtosis, self.durbin_watson() if self.table.key else None)

    def residual_frame(self) -> DataFrame:
        """One row: the figures of residual_statistics()."""
        found = vars(self.residual_statistics())
        return self.table.df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))

    def durbin_watson(self) -> float:
        """Sum of squared steps in key order over the sum of squares; 0 for fewer than two rows or no residual."""
        key = self.table._order()
        row = squared_steps(self.table.df.select(F.col(f"`{key}`").alias("k"), self.residual_expr().alias("e")), "k", "e").first()
        return row.sd / row.ss if row.n >= 2 and row.ss >= FLOOR else 0.0

    def summary(self) -> ModelSummary:
        return ModelSummary(str(self.formula), self.n, self.p, self.to_coefficients(), self.statistics(), self.residual_statistics())

    def __str__(self) -> str:
        return str(self.summary())

    # --- frames ---------------------------------------------------------------------------------------------------

    def _key(self) -> list[Column]:
        return [F.col(f"`{self.table.key}`")] if self.table.key else []

    def fitted(self) -> DataFrame:
        """(key, fitted, residual)."""
        return self.table.df.select(*self._key(), self.fitted_expr().alias("fitted"), self.residual_expr().alias("residual"))

    def influence(self, dfbetas: bool = False) -> DataFrame:
        """(key, fitted, residual, leverage, standardized, studentized, cooks_distance, dffits[, dfbetas])."""
        s, p = F.lit(self.residual_std_error), F.lit(float(self.p))
        base = self.table.df.select(
            *self._key(),
            self.fitted_expr().alias("fitted"),
            self.residual_expr().alias("residual"),
            self.leverage_expr().alias("leverage"),
            *(c.alias(f"__x{j}") for j, (_, c) in enumerate(self.design.columns) if dfbetas),
        )
        e, h = F.col("residual"), F.col("leverage")
        left = F.lit(1.0) - h
        student = F.try_divide(e, s * F.sqrt(left))
        out = base.select(
            "*",
            F.try_divide(e, s).alias("standardized"),
            student.alias("studentized"),
            F.try_divide(e * e * h, p * s * s * left * left).alias("cooks_distance"),
            (student * F.sqrt(F.try_divide(h, left))).alias("dffits"),
        )
        if dfbetas:
            x = [F.col(f"__x{j}") for j in range(self.p)]
            # s without the row: ((n - p) s^2 - e^2 / (1 - h)) / (n - p - 1)
            own = F.sqrt((F.lit(self.rss) - e * e / left) / F.lit(float(max(1, self.df_residual - 1))))
            moved = [F.try_divide(sum((F.lit(float(self.xtx_inv[j, k])) * x[k] for k in range(self.p)), F.lit(0.0)) * e / left, own * F.lit(math.sqrt(self.xtx_inv[j, j]))) for j in range(self.p)]
            out = out.withColumn("dfbetas", F.array(*moved)).drop(*(f"__x{j}" for j in range(self.p)))
        return out

    def influential_points(self, threshold: float | None = None) -> DataFrame:
        """Rows with a Cook's distance above threshold (4 / n)."""
        return self.influence().where(F.col("cooks_distance") > (4 / self.n if threshold is None else threshold))

    def high_leverage_points(self) -> DataFrame:
        """Rows with a leverage above 2 p / n."""
        return self.influence().where(F.col("leverage") > 2 * self.p / self.n)

    # --- prediction -----------------------------------------------------------------------------------------------

    def _on(self, table: Table) -> LinearModel:
        """The expressions name columns, so the frozen design applies to any table that has them."""
        check_new_data(self.design, table)
        return self

    def predict(self, table: Table) -> DataFrame:
        """(key, prediction); the response isn't needed."""
        self._on(table)
        key = [F.col(f"`{table.key}`")] if table.key else []
        return table.df.select(*key, self.fitted_expr().alias("prediction"))

    def _interval(self, table: Table, level: float, more: float) -> DataFrame:
        self._on(table)
        t = dist.t_quantile(1 - (1 - level) / 2, self.df_residual)
        key = [F.col(f"`{table.key}`")] if table.key else []
        half = F.lit(t * self.residual_std_error) * F.sqrt(F.lit(more) + self.leverage_expr())
        fitted = self.fitted_expr()
        return table.df.select(*key, fitted.alias("prediction"), (fitted - half).alias("lower"), (fitted + half).alias("upper"))

    def predict_ci(self, table: Table, level: float = 0.95) -> DataFrame:
        """Interval of the mean: half width t s sqrt(h)."""
        return self._interval(table, level, 0.0)

    def predict_pi(self, table: Table, level: float = 0.95) -> DataFrame:
        """Interval of a new observation: half width t s sqrt(1 + h)."""
        return self._interval(table, level, 1.0)
