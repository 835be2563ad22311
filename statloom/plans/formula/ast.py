"""Syntax tree of formulas. Nodes are immutable; every rewrite returns new ones."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

from statloom.errors import FunctionError


class Term:
    """A term of the right-hand side."""

    def variables(self) -> list[str]:
        """Names of data columns in order, without digits and repeats."""
        return list(dict.fromkeys(v for v in self._names() if not v.isdigit()))

    def _names(self) -> list[str]:
        raise NotImplementedError

    def flat(self) -> list[Term]:
        """The term without parentheses around sums."""
        return [self]

    def expand_categorical(self, levels: dict[str, list[str]]) -> list[Term]:
        """One term for each design column; categoricals become name[level]."""
        raise NotImplementedError


@dataclass(frozen=True)
class Variable(Term):
    name: str

    def __str__(self) -> str:
        return self.name

    def _names(self) -> list[str]:
        return [self.name]

    def expand_categorical(self, levels: dict[str, list[str]]) -> list[Term]:
        return [Variable(f"{self.name}[{v}]") for v in levels[self.name]] if self.name in levels else [self]


@dataclass(frozen=True)
class Interaction(Term):
    parts: tuple[str, ...]

    def __str__(self) -> str:
        return ":".join(self.parts)

    @property
    def order(self) -> int:
        return len(self.parts)

    def is_two_way(self) -> bool:
        return self.order == 2

    def is_higher_order(self) -> bool:
        return self.order > 2

    def _names(self) -> list[str]:
        return list(self.parts)

    def expand_categorical(self, levels: dict[str, list[str]]) -> list[Term]:
        each = [[str(t) for t in Variable(p).expand_categorical(levels)] for p in self.parts]
        return [Interaction(combined) for combined in product(*each)]


@dataclass(frozen=True)
class Function(Term):
    name: str
    args: tuple[Term, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"

    def _names(self) -> list[str]:
        return [v for a in self.args for v in a._names()]

    def expand_categorical(self, levels: dict[str, list[str]]) -> list[Term]:
        each = [a.expand_categorical(levels) for a in self.args]
        if self.name.lower() == "poly" and len(each[0]) > 1:
            raise FunctionError(self.name, "a categorical has no powers", str(self.args[0]))
        return [Function(self.name, combined) for combined in product(*each)]


@dataclass(frozen=True)
class Group(Term):
    """A sum in parentheses."""

    terms: tuple[Term, ...]

    def __str__(self) -> str:
        return f"({' + '.join(map(str, self.terms))})"

    def _names(self) -> list[str]:
        return [v for t in self.terms for v in t._names()]

    def flat(self) -> list[Term]:
        return [f for t in self.terms for f in t.flat()]

    def expand_categorical(self, levels: dict[str, list[str]]) -> list[Term]:
        return [Group(tuple(e for t in self.terms for e in t.expand_categorical(levels)))]


def interact(left: list[Term], right: list[Term]) -> list[Term]:
    """All products of variables and interactions, left outer and right inner."""
    return [Interaction(tuple(a._names()) + tuple(b._names())) for a in left for b in right]


@dataclass(frozen=True)
class Formula:
    response: str | None
    terms: tuple[Term, ...]
    intercept: bool = True
    text: str = ""

    @classmethod
    def parse(cls, text: str) -> Formula:
        from statloom.plans.formula.parser import parse

        return parse(text)

    @classmethod
    def with_response(cls, response: str, terms: list[Term]) -> Formula:
        return cls(response, tuple(terms))

    @classmethod
    def without_response(cls, terms: list[Term]) -> Formula:
        return cls(None, tuple(terms))

    def without_intercept(self) -> Formula:
        return replace(self, intercept=False)

    def has_response(self) -> bool:
        return self.response is not None

    def variables(self) -> set[str]:
        """All data columns, the response included."""
        return {v for t in self.terms for v in t.variables()} | ({self.response} if self.response else set())

    def contains(self, name: str) -> bool:
        return name in self.variables()

    def count(self, kind: type[Term]) -> int:
        return sum(isinstance(t, kind) for t in self.terms)

    def expand(self) -> Formula:
        """Sums in parentheses spliced in, and each repeated term once."""
        return replace(self, terms=tuple(dict.fromkeys(f for t in self.terms for f in t.flat())))

    def __str__(self) -> str:
        right = [str(t) for t in self.terms]
        if not self.intercept:
            right.insert(0, "0")
        return f"{self.response + ' ' if self.response else ''}~ {' + '.join(right) or '1'}"

    def expanded_string(self) -> str:
        return str(self.expand())
