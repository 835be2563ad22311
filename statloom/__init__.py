"""Spark-native statistical analytics: table verbs, formulas, linear models."""
