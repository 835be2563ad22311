"""Formula language: parse on the driver, compile to Spark column expressions."""

from statloom.plans.formula.ast import Formula, Function, Group, Interaction, Variable
from statloom.plans.formula.compile import Design, compile_formula, design_matrix
from statloom.plans.formula.parser import parse

__all__ = ["Design", "Formula", "Function", "Group", "Interaction", "Variable", "compile_formula", "design_matrix", "parse"]
