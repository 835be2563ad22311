"""Result records of models and their text form."""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass, replace


class ModelType(enum.Enum):
    """Labels as they appear in reports (fixed values)."""

    LINEAR = "Linear Regression"
    LOGISTIC = "Logistic Regression"
    POISSON = "Poisson Regression"
    LINEAR_MIXED = "Linear Mixed Model"
    GENERALIZED_LINEAR_MIXED = "GLMM"
    ARIMA = "ARIMA"
    COX = "Cox PH"
    ANOVA = "ANOVA"
    OTHER = "Other"


@dataclass(frozen=True)
class Coefficient:
    name: str
    estimate: float
    std_error: float | None = None
    t_stat: float | None = None
    p_value: float | None = None
    ci_lower: float | None = None
    ci_upper: float | None = None
    is_intercept: bool = False

    def with_std_error(self, v: float) -> Coefficient:
        return replace(self, std_error=v)

    def with_t_stat(self, v: float) -> Coefficient:
        return replace(self, t_stat=v)

    def with_p_value(self, v: float) -> Coefficient:
        return replace(self, p_value=v)

    def with_ci(self, lower: float, upper: float) -> Coefficient:
        return replace(self, ci_lower=lower, ci_upper=upper)

    def as_intercept(self) -> Coefficient:
        return replace(self, is_intercept=True)


@dataclass(frozen=True)
class ModelStatistics:
    """Figures that a model doesn't have are None; those of generalised models are here for other model types."""

    r_squared: float | None = None
    adj_r_squared: float | None = None
    f_statistic: float | None = None
    f_p_value: float | None = None
    log_likelihood: float | None = None
    aic: float | None = None
    bic: float | None = None
    residual_std_error: float | None = None
    df_residual: int | None = None
    df_model: int | None = None
    deviance: float | None = None
    null_deviance: float | None = None
    dispersion: float | None = None
    pearson_chi2: float | None = None
    iterations: int | None = None
    converged: bool | None = None
    n_obs: int | None = None
    scale: float | None = None


@dataclass(frozen=True)
class ResidualStatistics:
    min: float
    q1: float
    median: float
    q3: float
    max: float
    mean: float
    std: float
    skewness: float
    kurtosis: float
    durbin_watson: float | None


#: Lines of the statistics block: label, field, format (fixed values).
LINES = [
    ("R-squared", "r_squared", ".4f"),
    ("Adjusted R-squared", "adj_r_squared", ".4f"),
    ("F-statistic", "f_statistic", ".4f"),
    ("Log-likelihood", "log_likelihood", ".4f"),
    ("AIC", "aic", ".4f"),
    ("BIC", "bic", ".4f"),
    ("Residual Std. Error", "residual_std_error", ".4f"),
    ("Residual DF", "df_residual", "d"),
    ("Model DF", "df_model", "d"),
]


@dataclass(frozen=True)
class ModelSummary:
    formula: str
    n_obs: int
    n_predictors: int
    coefficients: list[Coefficient]
    statistics: ModelStatistics
    residuals: ResidualStatistics
    model_type: ModelType = ModelType.LINEAR

    def __str__(self) -> str:
        head = ["Model Summary", "=" * 13, f"Model Type: {self.model_type.value}", f"Formula: {self.formula}", f"Observations: {self.n_obs}", f"Predictors: {self.n_predictors}", ""]
        widths = (20, 12, 12, 12, 12)
        table = ["Coefficients:", " ".join([f"{'Term':<20}", *(f"{h:>12}" for h in ("Estimate", "Std Error", "t-value", "p-value"))]), " ".join("-" * w for w in widths)]
        for c in self.coefficients:
            figures = (math.nan if v is None else v for v in (c.estimate, c.std_error, c.t_stat, c.p_value))
            table.append(" ".join([f"{c.name:<20}", *(f"{v:>12.6f}" for v in figures)]))
        found = [(label, getattr(self.statistics, name), form) for label, name, form in LINES]
        return "\n".join([*head, *table, "", "Model Statistics:", *(f"  {label}: {v:{form}}" for label, v, form in found if v is not None)]) + "\n"
