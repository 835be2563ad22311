"""Formulas to design columns.

Compilation makes at most one aggregate pass: minima for domain checks, means and standard deviations for scaling, and
counts of missing values. Its results are frozen in the Design as literals, so the same expressions apply to new data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import FunctionError, InteractionError, NumericalError, VariableNotFound, VariableTypeMismatch
from statloom.functions.matrix import dummies, float_column, polynomial
from statloom.operators.table import Table
from statloom.plans.formula.ast import Formula, Function, Group, Interaction, Term, Variable
from statloom.plans.formula.parser import parse

#: Functions of one argument, applied to each of its columns.
UNARY: dict[str, Callable[[Column], Column]] = {"log": F.ln, "log10": F.log10, "log2": F.log2, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "i": lambda c: c}
#: Smallest argument: log needs more than 0, sqrt at least 0.
DOMAIN = {"log": (0.0, False), "log10": (0.0, False), "log2": (0.0, False), "sqrt": (0.0, True)}
SCALING = ("scale", "standardize", "center")

Named = tuple[str, Column]


@dataclass
class Design:
    """Design columns with the frozen statistics and levels of the table they were compiled on."""

    formula: Formula
    columns: list[Named]
    response: Column | None
    levels: dict[str, list[str]]
    needed: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    def frame(self, table: Table, response: bool = True) -> DataFrame:
        """(order key, x0.., y) of a table; x columns are named by their design names."""
        keep = [F.col(f"`{table.key}`")] if table.key else []
        y = [self.response.alias("y")] if response and self.response is not None else []
        return table.df.select(*keep, *(c.alias(n) for n, c in self.columns), *y)


class _Compiler:
    """Two runs over the terms: the first collects wanted statistics, the second builds expressions from them."""

    def __init__(self, table: Table):
        self.table = table
        self.wanted: dict[str, Column] = {}
        self.known: dict[str, float] | None = None

    def figure(self, name: str, aggregate: Column) -> float:
        if self.known is None:
            self.wanted.setdefault(name, aggregate)
            return 1.0
        v = self.known[name]
        return math.nan if v is None else v

    def variable(self, name: str) -> list[Named]:
        if not self.table.has_column(name):
            raise VariableNotFound(name, self.table.column_names)
        if self.table.is_categorical(name):
            return dummies(self.table, name)
        return [(name, float_column(self.table, name))]

    def term(self, term: Term) -> list[Named]:
        if isinstance(term, Variable):
            return self.variable(term.name)
        if isinstance(term, Group):
            return [c for t in term.terms for c in self.term(t)]
        if isinstance(term, Interaction):
            out = self.variable(term.parts[0])
            if len(term.parts) < 2:
                raise InteractionError("an interaction needs two variables")
            for part in term.parts[1:]:
                out = [(f"{a}:{b}", x * y) for a, x in out for b, y in self.variable(part)]
            return out
        return self.function(term)

    def function(self, term: Function) -> list[Named]:
        name = term.name.lower()
        if name == "poly":
            return self.poly(term)
        if name not in UNARY and name not in SCALING:
            raise FunctionError(term.name, "not supported")
        if len(term.args) != 1:
            raise FunctionError(term.name, f"takes one argument, not {len(term.args)}")
        out = []
        for label, x in self.term(term.args[0]):
            shown = f"{term.name}({label})"
            if name in DOMAIN:
                least, reached = DOMAIN[name]
                low = self.figure(f"min {label}", F.min(F.when(~F.isnan(x), x)))
                if low < least or (low == least and not reached):
                    raise NumericalError(term.name, f"{label} has values {'below' if reached else 'at or below'} 0")
            if name in UNARY:
                out.append((shown, UNARY[name](x)))
                continue
            mean = self.figure(f"mean {label}", F.avg(x))
            if name == "center":
                out.append((shown, x - F.lit(mean)))
                continue
            sd = self.figure(f"sd {label}", F.stddev_samp(x))
            if sd == 0:
                raise NumericalError(term.name, f"{label} is constant")
            out.append((shown, (x - F.lit(mean)) / F.lit(sd)))
        return out

    def poly(self, term: Function) -> list[Named]:
        if len(term.args) != 2:
            raise FunctionError(term.name, "takes a variable and a degree")
        degree = str(term.args[1])
        if not degree.isdigit() or int(degree) < 1:
            raise FunctionError(term.name, "the degree must be a positive whole number", degree)
        columns = self.term(term.args[0])
        if len(columns) != 1:
            raise FunctionError(term.name, "needs a single column", str(term.args[0]))
        label, x = columns[0]
        return [(f"{term.name}({label}, {degree})[{k}]", c) for k, c in enumerate(polynomial(x, int(degree)), 1)]

    def build(self, terms: tuple[Term, ...]) -> list[Named]:
        out = [c for t in terms for c in self.term(t)]
        if self.wanted:
            row = self.table.df.agg(*(a.alias(f"f{i}") for i, a in enumerate(self.wanted.values()))).first()
            self.known = dict(zip(self.wanted, row, strict=True))
            out = [c for t in terms for c in self.term(t)]
        return out


def compile_formula(formula: Formula | str, table: Table, need_response: bool = True) -> Design:
    """Bind a formula to a table. Intercept first, then the terms in order; categoricals give all their levels."""
    formula = parse(formula) if isinstance(formula, str) else formula
    response = None
    if formula.response is not None and need_response:
        response = float_column(table, formula.response)
    compiler = _Compiler(table)
    columns = compiler.build(formula.terms)
    if formula.intercept:
        columns.insert(0, ("(Intercept)", F.lit(1.0)))
    needed = [v for t in formula.terms for v in t.variables()]
    return Design(formula, columns, response, {v: table.levels[v] for v in needed if v in table.levels}, list(dict.fromkeys(needed)))


def design_matrix(formula: Formula | str, table: Table) -> DataFrame:
    return compile_formula(formula, table).frame(table)


def unlisted(column: Column, levels: list[str]) -> Column:
    """Counts values that are no level."""
    return F.count_if(column.isNotNull() & ~column.cast("string").isin(levels))


def check_new_data(design: Design, table: Table) -> None:
    """Prediction data need the formula's variables; values outside the frozen levels are an error."""
    for v in design.needed:
        if not table.has_column(v):
            raise VariableNotFound(v, table.column_names)
    checks = [(v, unlisted(F.col(f"`{v}`"), levels)) for v, levels in design.levels.items()]
    if checks:
        for (v, _), bad in zip(checks, table.df.agg(*(c.alias(f"c{i}") for i, (_, c) in enumerate(checks))).first(), strict=True):
            if bad:
                raise VariableTypeMismatch(v, f"one of {', '.join(design.levels[v])}", f"{bad} other values")
