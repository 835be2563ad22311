"""Ordinary least squares on Spark aggregates."""

from statloom.plans.linmod.ols import LinearConfig, LinearModel, LinearRegression, StandardErrors, lm

__all__ = ["LinearConfig", "LinearModel", "LinearRegression", "StandardErrors", "lm"]
