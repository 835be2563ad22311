"""Formula language: parser corpora, printing, compilation to design columns."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.errors import FormulaError, FormulaSyntaxError, FunctionError, NumericalError, VariableNotFound, VariableTypeMismatch
from statloom.plans.formula import Formula, Function, Group, Interaction, Variable, compile_formula, parse
from statloom.sources.builders import Column, from_columns

#: Rules of the grammar in the parser's docstring, as generators of texts that it derives.
word = st.from_regex(r"[a-z][a-z0-9_.]{0,5}", fullmatch=True)
number = st.integers(0, 99).map(str)
plain = st.lists(word, min_size=1, max_size=3).map(":".join)
argument = st.recursive(
    word | number,
    lambda inner: st.tuples(word, st.lists(inner, min_size=1, max_size=3)).map(lambda x: f"{x[0]}({', '.join(x[1])})") | st.lists(inner | plain, min_size=2, max_size=3).map(lambda x: f"({' + '.join(x)})"),
    max_leaves=6,
)
factor = plain | argument
head = st.sampled_from(["", "0 + ", "1 + "])
formula = st.tuples(st.sampled_from(["", "resp "]), head, st.lists(factor.filter(lambda t: t not in ("0", "1")), min_size=1, max_size=4)).map(lambda x: f"{x[0]}~ {x[1]}{' + '.join(x[2])}")


@settings(max_examples=150, deadline=None)
@given(formula)
def test_accepts_what_the_grammar_derives(text):
    f = parse(text)
    assert str(parse(str(f))) == str(f) and parse(text.replace(" ", "")).terms == f.terms


@settings(max_examples=150, deadline=None)
@given(formula, st.data())
def test_rejects_broken_derivations(text, data):
    """One mark too many, a bracket too few, or a character outside the language."""
    at = data.draw(st.integers(text.index("~") + 1, len(text)))
    broken = data.draw(st.sampled_from([text + " +", text + ":", text + ")", text[:at] + "$" + text[at:], text + " again", text.replace("~", "", 1), text.replace("~", "~ ~", 1)] + [text.replace(")", "", 1)] * (")" in text)))
    # After 0 or 1 alone a plus may end the formula.
    if broken.rstrip().endswith(("~ 0 +", "~ 1 +")):
        return
    with pytest.raises(FormulaSyntaxError):
        parse(broken)


@pytest.mark.parametrize("text", ["", " ", "cost", "~ width +", "~ 7up", "cost ~ (width", "cost ~ f()", "cost ~ f(,)", "cost ~ width:f(depth)", "f(cost) ~ width", "~ -width"])
def test_rejects(text):
    with pytest.raises(FormulaSyntaxError):
        parse(text)


@pytest.mark.parametrize(("text", "shown"), [("cost ~", "cost ~ 1"), ("cost ~ 0", "cost ~ 0"), ("cost ~ 1 +", "cost ~ 1"), ("cost ~ f(width,)", "cost ~ f(width)")])
def test_corners_of_the_grammar(text, shown):
    assert str(parse(text)) == shown


def test_tree():
    f = parse("y ~ a + b:c + log(d) + (e + f)")
    assert f.terms == (Variable("a"), Interaction(("b", "c")), Function("log", (Variable("d"),)), Group((Variable("e"), Variable("f"))))
    assert f.variables() == set("yabcdef") and f.has_response() and f.count(Interaction) == 1 and f.contains("e")
    assert f.expanded_string() == "y ~ a + b:c + log(d) + e + f"
    assert parse("y ~ poly(x, 3)").variables() == {"x", "y"}
    assert parse("~ a:b:c").terms[0].is_higher_order() and parse("~ a:b").terms[0].is_two_way()
    assert str(Formula.with_response("y", [Variable("x")]).without_intercept()) == "y ~ 0 + x"
    assert str(Formula.without_response([])) == "~ 1"


def test_distribution():
    assert str(parse("y ~ (a + b):c")) == "y ~ a:c + b:c"
    assert str(parse("y ~ a:(b + c):d")) == "y ~ a:b:d + a:c:d"


def test_categorical_expansion():
    levels = {"g": ["A", "B"], "h": ["u", "v"]}
    assert [str(t) for t in parse("~ g:h").terms[0].expand_categorical(levels)] == ["g[A]:h[u]", "g[A]:h[v]", "g[B]:h[u]", "g[B]:h[v]"]
    with pytest.raises(FunctionError):
        parse("~ poly(g, 2)").terms[0].expand_categorical(levels)


names = st.text(alphabet="abcxyz", min_size=1, max_size=4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(names, min_size=1, max_size=3), min_size=1, max_size=4), st.booleans())
def test_round_trip(parts, intercept):
    text = "y ~ " + ("" if intercept else "0 + ") + " + ".join(":".join(p) for p in parts)
    assert str(parse(text)) == text


@pytest.fixture(scope="module")
def table(spark):
    return from_columns(
        spark,
        [("y", Column.floats([1, 2, 3, 4])), ("x", Column.floats([1, 2, 3, 4])), ("i", Column.ints([4, 5, 6, 7])), ("b", Column.bools([True, False, True, True])), ("g", Column.categorical(["A", "B", "A", "C"])), ("s", Column.strings(list("abcd"))), ("neg", Column.floats([-1, 0, 1, 2])), ("k", Column.floats([1, 1, 1, 1]))],
    )


def matrix(table, formula):
    d = compile_formula(formula, table)
    rows = d.frame(table, response=False).orderBy(table.key).drop(table.key).collect()
    return d.names, [tuple(r) for r in rows]


def test_columns(table):
    assert matrix(table, "y ~ x + i + b")[0] == ["(Intercept)", "x", "i", "b"]
    assert matrix(table, "y ~ x + i + b")[1][1] == (1.0, 2.0, 5.0, 0.0)
    names, rows = matrix(table, "~ 0 + g")
    assert names == ["g[A]", "g[B]", "g[C]"] and rows == [(1, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1)]
    assert [r[1] for r in matrix(table, "~ x:i")[1]] == [4, 10, 18, 28]
    assert matrix(table, "~ x:g")[0] == ["(Intercept)", "x:g[A]", "x:g[B]", "x:g[C]"]
    assert matrix(table, "~ 0")[0] == []
    assert len(matrix(table, "y ~ g:g:x")[0]) == 10


def test_functions(table):
    rows = matrix(table, "~ 0 + log(x) + sqrt(x) + exp(k) + abs(neg) + I(x) + LOG2(x)")[1]
    assert rows[1] == pytest.approx((math.log(2), math.sqrt(2), math.e, 0.0, 2.0, 1.0))
    names, rows = matrix(table, "~ poly(x, 3)")
    assert names == ["(Intercept)", "poly(x, 3)[1]", "poly(x, 3)[2]", "poly(x, 3)[3]"] and rows[2] == (1, 3, 9, 27)
    z = [r[0] for r in matrix(table, "~ 0 + scale(x)")[1]]
    assert sum(z) == pytest.approx(0) and sum(v * v for v in z) == pytest.approx(3)
    assert [r[0] for r in matrix(table, "~ 0 + center(x)")[1]] == [-1.5, -0.5, 0.5, 1.5]


@pytest.mark.parametrize(
    ("formula", "error"),
    [
        ("y ~ z", VariableNotFound),
        ("z ~ x", VariableNotFound),
        ("s ~ x", VariableTypeMismatch),
        ("g ~ x", VariableTypeMismatch),
        ("y ~ s", VariableTypeMismatch),
        ("y ~ 2 + x", VariableNotFound),
        ("y ~ log(neg)", NumericalError),
        ("y ~ sqrt(neg)", NumericalError),
        ("y ~ scale(k)", NumericalError),
        ("y ~ sin(x)", FunctionError),
        ("y ~ log(x, i)", FunctionError),
        ("y ~ poly(x)", FunctionError),
        ("y ~ poly(x, 0)", FunctionError),
        ("y ~ poly(g, 2)", FunctionError),
    ],
)
def test_errors(table, formula, error):
    with pytest.raises(error) as e:
        compile_formula(formula, table)
    assert isinstance(e.value, FormulaError)
