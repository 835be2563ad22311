"""Recursive-descent parser of formulas: a regex lexer and one method for each rule.

    formula := [ident] '~' rhs            rhs    := [ '0' | '1' ] ['+' terms] | terms
    terms   := term ('+' term)*           term   := factor (':' factor)*
    factor  := '(' rhs ')' | ident | ident '(' factor (',' factor)* [','] ')' | digits

Beyond this grammar a product of sums is distributed: (a + b):c is a:c + b:c.
"""

from __future__ import annotations

import re

from statloom.errors import FormulaSyntaxError
from statloom.plans.formula.ast import Formula, Function, Group, Interaction, Term, Variable, interact

LEXER = re.compile(r"\s*(?:(?P<name>[^\W\d_][\w.]*)|(?P<digits>\d+)|(?P<mark>[~+:(),]))")


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.tokens: list[tuple[str, str, int]] = []
        end = len(text.rstrip())
        while self.at < end:
            m = LEXER.match(text, self.at)
            if not m:
                where = self.at + len(text[self.at :]) - len(text[self.at :].lstrip())
                raise FormulaSyntaxError(where, "unexpected character", text[where : where + 10])
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            self.at = m.end()
        for (kind, _, start), (then, _, next_) in zip(self.tokens, self.tokens[1:], strict=False):
            if kind == "digits" and then == "name" and len(self._word(start)) == next_ - start:
                raise FormulaSyntaxError(start, "a name can't begin with a digit", text[start : start + 10])
        self.i = 0

    def _word(self, start: int) -> str:
        return re.match(r"\d+", self.text[start:])[0]

    def peek(self) -> str | None:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else None

    def kind(self) -> str | None:
        return self.tokens[self.i][0] if self.i < len(self.tokens) else None

    def fail(self, message: str) -> FormulaSyntaxError:
        at = self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)
        return FormulaSyntaxError(at, message, self.text[at : at + 10])

    def take(self, mark: str) -> None:
        if self.peek() != mark:
            raise self.fail(f"expected {mark!r}")
        self.i += 1

    def formula(self) -> Formula:
        if not self.tokens:
            raise FormulaSyntaxError(0, "empty formula")
        response = None
        if self.kind() == "name":
            response, self.i = self.peek(), self.i + 1
        self.take("~")
        terms, intercept = self.rhs()
        if self.peek() is not None:
            raise self.fail("unexpected text after the formula")
        return Formula(response, tuple(terms), intercept, self.text)

    def rhs(self) -> tuple[list[Term], bool]:
        if self.peek() in (None, ")"):
            return [], True
        intercept = True
        if self.peek() in ("0", "1"):
            intercept = self.peek() == "1"
            self.i += 1
            if self.peek() in (None, ")"):
                return [], intercept
            self.take("+")
            if self.peek() is None:  # a plus that nothing follows is accepted right after 0 or 1
                return [], intercept
        terms = self.term()
        while self.peek() == "+":
            self.i += 1
            terms += self.term()
        return terms, intercept

    def term(self) -> list[Term]:
        factors = [self.factor()]
        while self.peek() == ":":
            self.i += 1
            factors.append(self.factor())
        if len(factors) == 1:
            return factors
        out: list[Term] | None = None
        for f in factors:
            flat = f.flat()
            if any(not isinstance(t, Variable | Interaction) for t in flat):
                raise self.fail("interaction terms must be variables")
            out = flat if out is None else interact(out, flat)
        return out

    def factor(self) -> Term:
        kind, text = self.kind(), self.peek()
        if text == "(":
            self.i += 1
            terms, _ = self.rhs()
            self.take(")")
            return terms[0] if len(terms) == 1 else Group(tuple(terms))
        if kind == "digits":
            self.i += 1
            return Variable(text)
        if kind != "name":
            raise self.fail("expected a term")
        self.i += 1
        if self.peek() != "(":
            return Variable(text)
        self.i += 1
        args = [self.factor()]
        while self.peek() == ",":
            self.i += 1
            if self.peek() == ")":
                break
            args.append(self.factor())
        self.take(")")
        return Function(text, tuple(args))


def parse(text: str) -> Formula:
    return Parser(text).formula()
