"""Registered queries of builders, views, helpers, the formula language and model accessors, each with its DuckDB SQL.

Where an operator yields a number, a text or an error instead of rows, the query returns it as rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from statloom import protocols
from statloom.errors import StatError
from statloom.functions import matrix
from statloom.operators import stats, views
from statloom.operators.verbs import Arrange
from statloom.plans.formula import Formula, Function, Group, Interaction, Variable, compile_formula, parse
from statloom.plans.linmod import LinearConfig, StandardErrors, diagnostics, lm, penalised
from statloom.plans.linmod.ols import LinearRegression
from statloom.plans.linmod.summary import Coefficient, ModelType
from statloom.queries import BASE, INFLUENCE, SANDWICH, XY, _events_model, events, lineitem, orders, query, rounded
from statloom.schema import ColumnType, Dimensions, SeriesStats
from statloom.sources.builders import Column, ColumnBuilder, Index, TableBuilder, empty, from_columns, read_parquet


def outcome(f) -> str:
    """The name of the error that f raises, or "ok"."""
    try:
        f()
    except StatError as e:
        return type(e).__name__
    return "ok"


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v({columns})"


def region(spark, d):
    return read_parquet(spark, f"{d}/region.parquet", key="r_regionkey").with_column("size", F.length("r_name").cast("double")).with_column("odd", F.pow(F.col("r_regionkey").cast("double"), 2.0))


def nation(spark, d):
    return read_parquet(spark, f"{d}/nation.parquet", key="n_nationkey")


# --- builders and metadata ------------------------------------------------------------------------------------------


@query("SELECT 0::BIGINT AS nrows, 0::BIGINT AS ncols, true AS empty")
def a01_empty_frame(spark, d):
    s = empty(spark).shape()
    return spark.createDataFrame([(s.rows, s.cols, s.is_empty())], "nrows long, ncols long, empty boolean")


@query(_values("f, i, b, s, g", "(1.5::DOUBLE, 7::BIGINT, true, 'u', 'low')", "(NULL, -2, false, NULL, 'high')", "(0.25, NULL, NULL, 'w', 'low')"))
def a02_from_columns(spark, d):
    made = [("f", Column.floats([1.5, None, 0.25])), ("i", Column.ints([7, -2, None])), ("b", Column.bools([True, False, None])), ("s", Column.strings(["u", None, "w"])), ("g", Column.categorical(["low", "high", "low"]))]
    return from_columns(spark, made).visible()


@query(_values("label, length, weight", "('north', 3.5::DOUBLE, 10::BIGINT)", "('east', 1.25, 20)", "('west', 2.0, 40)"))
def a03_table_builder(spark, d):
    """Columns from column builders, and the index that the table carries."""
    b = TableBuilder(spark).with_column("length", ColumnBuilder().floats([3.5, 1.25, 2.0]).name("length").build())
    t = b.with_column("weight", ColumnBuilder().ints([10, 20, 40]).build()).with_index(Index.generic(["north", "east", "west"])).build()
    return t.df.join(t.index.frame(spark), "row_id").select("label", "length", "weight")


@query("SELECT 'DataFrame(' || count(*) || ' rows × 6 cols)' AS shown FROM orders")
def a04_display(spark, d):
    return spark.createDataFrame([(repr(orders(spark, d)),)], "shown string")


@query("SELECT count(*) AS nrows, 6::BIGINT AS ncols, false AS empty, count(*) * 6 AS cells, true AS has_key, false AS has_other FROM orders")
def a05_shape(spark, d):
    t = orders(spark, d)
    s = t.shape()
    row = (s.rows, s.cols, s.is_empty(), Dimensions((s.rows, s.cols)).size(), t.has_column("o_orderkey"), t.has_column("o_comment"))
    return spark.createDataFrame([row], "nrows long, ncols long, empty boolean, cells long, has_key boolean, has_other boolean")


@query(_values("name, kind, numeric, categorical, text", "('event_id', 'int64', true, false, false)", "('user_id', 'int64', true, false, false)", "('event_type', 'categorical', false, true, false)", "('value', 'float64', true, false, false)", "('props', 'string', false, false, true)", "('late', 'bool', true, false, false)"))
def a06_column_types(spark, d):
    t = events(spark, d).drop(["ts"]).as_categorical("event_type").with_column("late", F.col("value") > 1)
    kinds = [(c, t.column_type(c)) for c in t.column_names]
    return spark.createDataFrame([(c, str(k), t.is_numeric(c) and k.is_numeric(), t.is_categorical(c) and k.is_categorical(), k.is_string()) for c, k in kinds], "name string, kind string, numeric boolean, categorical boolean, text boolean")


@query("SELECT i AS row_id, ['b', 'a', 'c'][i + 1] AS label FROM range(3) t(i)")
def a07_generic_index(spark, d):
    return Index.generic(["b", "a", "c"]).frame(spark)


@query(_values("name, satisfied", "('DataView', true)", "('ColumnLike', true)", "('AsMatrix', true)", "('StatisticalModel', true)", "('ModelResult', true)", "('not a model', false)"))
def a08_protocols(spark, d):
    """Which structural types tables, columns and models satisfy."""
    t = region(spark, d)
    model = LinearRegression("size ~ r_regionkey", t)
    found = [("DataView", t, protocols.DataView), ("ColumnLike", views.ColumnView(t, "size"), protocols.ColumnLike), ("AsMatrix", t, protocols.AsMatrix)]
    found += [("StatisticalModel", model, protocols.StatisticalModel), ("ModelResult", model.fit().model, protocols.ModelResult), ("not a model", t, protocols.StatisticalModel)]
    return spark.createDataFrame([(n, isinstance(x, kind)) for n, x, kind in found], "name string, satisfied boolean")


# --- rows, cells and views ------------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 1")
def a10_filter_by_list(spark, d):
    """An external mask, one truth value a row."""
    t = nation(spark, d)
    return t.filter_mask([i % 3 != 1 for i in range(t.nrows())]).select(["n_nationkey", "n_name"]).df


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 7 < 2")
def a10_filter_by_frame(spark, d):
    """An external mask of any size: positions and truth values."""
    t = orders(spark, d)
    mask = spark.range(t.nrows()).select("id", (F.col("id") % 7 < 2).alias("keep"))
    return t.filter_mask(mask).select(["o_orderkey", "o_totalprice"]).df


@query("SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def a11_filter_column(spark, d):
    return views.ColumnView(orders(spark, d), "o_totalprice").filter(F.col("o_orderstatus") == "F").to_float()


@query("SELECT o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 10")
def a12_slice_column_view(spark, d):
    """A slice of a column view; a slice that doesn't fit is none."""
    v = views.ColumnView(orders(spark, d), "o_totalprice")
    return v.slice(10, 60).as_float() if v.slice(0, 10**9) is None else spark.range(0)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 5")
def a13_slice_table_view(spark, d):
    t = orders(spark, d).view()
    return t.slice_view(5, 35).select(["o_orderkey", "o_orderstatus"]).df if t.slice_view(10**9, 10**9 + 1) is None else spark.range(0)


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)
SELECT 0::BIGINT AS at, (SELECT o_totalprice FROM o WHERE r = 0) AS price, (SELECT o_orderstatus FROM o WHERE r = 0) AS status
UNION ALL SELECT 41, (SELECT o_totalprice FROM o WHERE r = 41), (SELECT o_orderstatus FROM o WHERE r = 41) UNION ALL SELECT 999999999, NULL, NULL""")
def a14_get_cells(spark, d):
    t = orders(spark, d)
    return spark.createDataFrame([(i, t.get("o_totalprice", i), views.ColumnView(t, "o_orderstatus").get(i)) for i in (0, 41, 999_999_999)], "at long, price double, status string")


@query("""WITH r AS (SELECT event_id, value, event_type, value > 1 AS late FROM events ORDER BY event_id LIMIT 1 OFFSET 4)
SELECT 'event_id' AS name, event_id::DOUBLE AS as_float, event_id AS as_int, event_id <> 0 AS as_bool, NULL AS as_text FROM r
UNION ALL SELECT 'value', value, trunc(value)::BIGINT, value <> 0, NULL FROM r
UNION ALL SELECT 'late', late::INTEGER::DOUBLE, late::BIGINT, late, NULL FROM r
UNION ALL SELECT 'event_type', NULL, NULL, NULL, event_type FROM r UNION ALL SELECT 'nothing', NULL, NULL, NULL, NULL FROM r""")
def a15_row_getters(spark, d):
    t = events(spark, d).with_column("late", F.col("value") > 1).select(["event_id", "value", "late", "event_type"])
    r = views.RowView(t.get_row(4), 4)
    names = [*t.column_names, "nothing"]
    return spark.createDataFrame([(n, r.get_float(n), r.get_int(n), r.get_bool(n), r.get_string(n)) for n in names], "name string, as_float double, as_int long, as_bool boolean, as_text string")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS at, n_name AS name, 2::BIGINT AS width FROM nation")
def a16_row_views(spark, d):
    """All rows in order, streamed to the driver with their positions."""
    found = views.row_views(nation(spark, d).select(["n_nationkey", "n_name"]))
    return spark.createDataFrame([(r.index, r.get("n_name"), len(r.to_list())) for r in found], "at long, name string, width long")


@query("SELECT count(*) AS nrows, 3::BIGINT AS ncols, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation WHERE n_regionkey = 1")
def a17_filtered_view(spark, d):
    t = nation(spark, d).select(["n_nationkey", "n_name", "n_regionkey"])
    v = views.FilteredView(t, F.col("n_regionkey") == 1)
    s = v.shape()
    return spark.createDataFrame([(s.rows, s.cols, ",".join(r.n_name for r in v.rows()))], "nrows long, ncols long, names string")


@query("""SELECT 'event_id' AS name, count(*) AS length, false AS empty, 'int64' AS kind, false AS as_float, true AS as_int, false AS as_bool FROM events
UNION ALL SELECT 'value', count(*), false, 'float64', true, false, false FROM events UNION ALL SELECT 'late', count(*), false, 'bool', false, false, true FROM events""")
def a18_column_views(spark, d):
    t = events(spark, d).with_column("late", F.col("value") > 1).select(["event_id", "value", "late"])
    rows = [(v.name, len(v), v.is_empty(), v.dtype, v.as_float() is not None, v.as_int() is not None, v.as_bool() is not None) for v in views.columns(t)]
    return spark.createDataFrame(rows, "name string, length long, empty boolean, kind string, as_float boolean, as_int boolean, as_bool boolean")


@query("SELECT r_name AS value, row_number() OVER (ORDER BY r_regionkey) AS nth FROM region")
def a19_column_iterator(spark, d):
    return spark.createDataFrame([(v, i) for i, v in enumerate(views.ColumnView(region(spark, d), "r_name"), 1)], "value string, nth long")


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def a20_view_matrix(spark, d):
    """A view's matrix holds float columns only."""
    return views.float_matrix(lineitem(spark, d).view())


@query("SELECT user_id, row_number() OVER (ORDER BY broken, event_id) - 1 AS up, row_number() OVER (ORDER BY broken DESC, event_id) - 1 AS down FROM (SELECT *, CASE WHEN user_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END AS broken FROM events)")
def a21_arrange_with_nan(spark, d):
    """NaN is the largest value: last ascending, first descending."""
    t = events(spark, d).select(["event_id", "user_id", "value"]).mutate("value", lambda c: F.when(F.col("user_id") % 5 == 0, F.lit(math.nan)).otherwise(c))
    up = t.ranked([("value", True)], "up").select("event_id", "user_id", "up")
    return up.join(t.ranked([("value", False)], "down").select("event_id", "down"), "event_id").select("user_id", "up", "down")


@query("SELECT DISTINCT event_type AS value FROM events")
def a22_distinct_values(spark, d):
    return stats.distinct_values(events(spark, d), "event_type")


@query("SELECT 0::BIGINT AS count, true AS no_mean, true AS no_std, true AS no_median, NULL::BIGINT AS distinct_values")
def a23_empty_stats(spark, d):
    s = SeriesStats.empty()
    return spark.createDataFrame([(s.count, math.isnan(s.mean), math.isnan(s.std), math.isnan(s.q50), s.unique_count)], "count long, no_mean boolean, no_std boolean, no_median boolean, distinct_values long")


@query("SELECT " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}" for c, n, q in [("l_extendedprice", "p1", 0.01), ("l_extendedprice", "p50", 0.5), ("l_extendedprice", "p999", 0.999), ("l_quantity", "q1", 0.01), ("l_quantity", "q50", 0.5), ("l_quantity", "q999", 0.999)]) + " FROM lineitem")
def a24_quantiles_by_narrowing(spark, d):
    """The path that large tables take, at any size."""
    t, qs = lineitem(spark, d), [0.01, 0.5, 0.999]
    found = stats.all_quantiles(t.df, [t.to_float("l_extendedprice"), t.to_float("l_quantity")], qs, one_pass=500, sorted_rows=200)
    return rounded(spark.createDataFrame([tuple(found[0] + found[1])], "p1 double, p50 double, p999 double, q1 double, q50 double, q999 double"))


# --- matrices -------------------------------------------------------------------------------------------------------


@query("SELECT o_totalprice FROM orders")
def a30_column_matrix(spark, d):
    return matrix.column_matrix(orders(spark, d), "o_totalprice")


@query("SELECT event_id, value AS a, user_id::DOUBLE AS b, value * user_id AS c FROM events")
def a31_hstack(spark, d):
    t = events(spark, d)
    a, b = matrix.float_column(t, "value"), matrix.float_column(t, "user_id")
    stacked = matrix.concatenate(1, [matrix.hstack([("a", a)], [("b", b)]), [("c", matrix.interaction_term(a, b))]])
    return t.df.select("event_id", *(c.alias(n) for n, c in stacked))


@query("SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def a32_concatenate_rows(spark, d):
    return matrix.concatenate(0, [spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS k", "s_acctbal AS v"), spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS k", "c_acctbal AS v")])


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (), 4) AS centred, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 4) AS standardised FROM orders")
def a33_center_and_standardize(spark, d):
    t, x = orders(spark, d), F.col("o_totalprice")
    return t.df.select("o_orderkey", F.round(matrix.center_vector(t.df, x), 4).alias("centred"), F.round(matrix.standardize_vector(t.df, x), 4).alias("standardised"))


@query(_values("what, result", "('shape', 'ok')", "('wrong rows', 'DimensionMismatch')", "('wrong columns', 'DimensionMismatch')", "('two dimensions', 'ok')", "('no row', 'DimensionMismatch')", "('finite', 'ok')", "('NaN', 'NumericalError')", "('infinite', 'NumericalError')", "('equal lengths', 'ok')", "('other lengths', 'DimensionMismatch')", "('text as numbers', 'NonNumericData')"))
def a34_checks(spark, d):
    m = region(spark, d).df.select("size", "odd")
    bad = lambda v: m.withColumn("odd", F.when(F.col("odd") == 4, F.lit(v)).otherwise(F.col("odd")))
    found = [
        ("shape", lambda: matrix.ensure_shape(m, 5, 2)),
        ("wrong rows", lambda: matrix.ensure_shape(m, 6)),
        ("wrong columns", lambda: matrix.ensure_shape(m, 5, 3)),
        ("two dimensions", lambda: matrix.ensure_2d(m)),
        ("no row", lambda: matrix.ensure_2d(m.where("size < 0"))),
        ("finite", lambda: matrix.check_finite(m)),
        ("NaN", lambda: matrix.check_finite(bad(math.nan))),
        ("infinite", lambda: matrix.check_finite(bad(math.inf))),
        ("equal lengths", lambda: matrix.check_equal_lengths(3, 3, 3)),
        ("other lengths", lambda: matrix.check_equal_lengths(3, 3, 4)),
        ("text as numbers", lambda: region(spark, d).to_float("r_name")),
    ]
    return spark.createDataFrame([(n, outcome(f)) for n, f in found], "what string, result string")


@query(_values("col", "(0::BIGINT)", "(2)", "(3)"))
def q49_constant_columns(spark, d):
    """Columns whose values lie within 1 of the first one; NaN differs from nothing."""
    t = from_columns(spark, [("a", Column.floats([0, -1, 1])), ("b", Column.floats([0, 0.5, 1.5])), ("c", Column.floats([7, 7, 7])), ("e", Column.floats([2, math.nan, 2]))])
    return spark.createDataFrame([(i,) for i in matrix.check_constant_columns(t.numeric_matrix(), 1.0, "row_id")], "col long")


@query(_values("given, shown, kind", "('2.5', '2.5', 'float')", "('-3', '-3.0', 'float')", "('Yes', 'true', 'bool')", "('f', 'false', 'bool')", "('maybe', 'maybe', 'str')"))
def a35_value_texts(spark, d):
    rows = []
    for text in ("2.5", "-3", "Yes", "f", "maybe"):
        v = matrix.string_to_value(text)
        rows.append((text, matrix.value_to_string(v), type(v).__name__))
    return spark.createDataFrame(rows, "given string, shown string, kind string")


# --- formula language -----------------------------------------------------------------------------------------------

FORMULAS = ["price ~ size + age", "price ~ 0 + log(size)", "~ (a + b):c + d", "rate ~ (u + (v + u)) + w:v", "z ~ poly(t, 2) + 1", "q ~"]


@query(_values(
    "formula, shown, expanded, variables, response, intercept",
    "('price ~ size + age', 'price ~ size + age', 'price ~ size + age', 'age,price,size', true, true)",
    "('price ~ 0 + log(size)', 'price ~ 0 + log(size)', 'price ~ 0 + log(size)', 'price,size', true, false)",
    "('~ (a + b):c + d', '~ a:c + b:c + d', '~ a:c + b:c + d', 'a,b,c,d', false, true)",
    "('rate ~ (u + (v + u)) + w:v', 'rate ~ (u + (v + u)) + w:v', 'rate ~ u + v + w:v', 'rate,u,v,w', true, true)",
    "('z ~ poly(t, 2) + 1', 'z ~ poly(t, 2) + 1', 'z ~ poly(t, 2) + 1', 't,z', true, true)",
    "('q ~', 'q ~ 1', 'q ~ 1', 'q', true, true)",
))
def a40_formula_texts(spark, d):
    rows = [(text, str(f), f.expanded_string(), ",".join(sorted(f.variables())), f.has_response(), f.intercept) for text in FORMULAS for f in [Formula.parse(text)]]
    return spark.createDataFrame(rows, "formula string, shown string, expanded string, variables string, response boolean, intercept boolean")


@query(_values("term, kind, variables, higher", "('x', 'Variable', 'x', false)", "('x:y', 'Interaction', 'x,y', false)", "('x:y:z', 'Interaction', 'x,y,z', true)", "('log(x)', 'Function', 'x', false)", "('(x + y:z)', 'Group', 'x,y,z', false)"))
def a41_terms(spark, d):
    terms = [Variable("x"), Interaction(("x", "y")), Interaction(("x", "y", "z")), Function("log", (Variable("x"),)), Group((Variable("x"), Interaction(("y", "z"))))]
    return spark.createDataFrame([(str(t), type(t).__name__, ",".join(t.variables()), isinstance(t, Interaction) and t.is_higher_order()) for t in terms], "term string, kind string, variables string, higher boolean")


@query(_values("formula, variables, interactions, functions", "('y ~ 0 + a + b:c + log(d) + b:d', 4::BIGINT, 2::BIGINT, 1::BIGINT)", "('~ a', 1, 0, 0)"))
def a42_formula_constructors(spark, d):
    terms = [Variable("a"), Interaction(("b", "c")), Function("log", (Variable("d"),)), Interaction(("b", "d"))]
    made = [Formula.with_response("y", terms).without_intercept(), Formula.without_response([Variable("a")])]
    rows = [(str(f), sum(f.contains(v) for v in "abcd"), f.count(Interaction), f.count(Function)) for f in made]
    return spark.createDataFrame(rows, "formula string, variables long, interactions long, functions long")


@query("SELECT 'o_orderstatus:o_totalprice' AS term, 'o_orderstatus[' || s || ']:o_totalprice' AS expanded FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) UNION ALL SELECT 'log(o_totalprice)', 'log(o_totalprice)' UNION ALL SELECT 'o_orderstatus', 'o_orderstatus[' || s || ']' FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)")
def a43_expand_categorical(spark, d):
    levels = orders(spark, d).as_categorical("o_orderstatus").levels
    terms = [parse(f"~ {x}").terms[0] for x in ("o_orderstatus:o_totalprice", "log(o_totalprice)", "o_orderstatus")]
    return spark.createDataFrame([(str(t), str(e)) for t in terms for e in t.expand_categorical(levels)], "term string, expanded string")


ERRORS = {
    "size ~ odd": "ok",
    "size ~ log(odd, size)": "FunctionError",
    "size ~ tan(odd)": "FunctionError",
    "size ~ poly(odd, 0)": "FunctionError",
    "size ~ missing": "VariableNotFound",
    "size ~ r_name": "VariableTypeMismatch",
    "r_name ~ size": "VariableTypeMismatch",
    "size ~ log(odd)": "NumericalError",
    "size ~ odd +": "FormulaSyntaxError",
    "size odd": "FormulaSyntaxError",
    "size ~ (odd": "FormulaSyntaxError",
    "size ~ odd::odd": "FormulaSyntaxError",
}


@query(_values("formula, result", *(f"('{f}', '{e}')" for f, e in ERRORS.items())))
def a44_formula_errors(spark, d):
    t = region(spark, d)
    return spark.createDataFrame([(f, outcome(lambda f=f: compile_formula(f, t))) for f in ERRORS], "formula string, result string")


# --- linear models --------------------------------------------------------------------------------------------------


def _scaled(sql: str) -> str:
    return BASE + ", k AS (SELECT stddev_samp(l_quantity) AS sd, avg(l_quantity) AS mq, avg(l_extendedprice) AS mp FROM lineitem) " + sql


def _two(model):
    return model.coefficient_frame().select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))


@query(_scaled("SELECT '(Intercept)' AS term, round(b0, 4) AS estimate, round(sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)), 4) AS std_error FROM s, k UNION ALL SELECT 'l_quantity', round(b1 * sd, 4), round(sqrt(rss / (n - 2) / sxx) * sd, 4) FROM s, k"))
def q48_scale_only(spark, d):
    return _two(lm(XY, lineitem(spark, d), LinearConfig(scale=True)))


@query(_scaled("SELECT '(Intercept)' AS term, round(mp, 4) AS estimate, round(sqrt(rss / (n - 2) / n), 4) AS std_error FROM s, k UNION ALL SELECT 'l_quantity', round(b1, 4), round(sqrt(rss / (n - 2) / sxx), 4) FROM s, k"))
def q48_center_only(spark, d):
    return _two(lm(XY, lineitem(spark, d), LinearConfig(center=True)))


@query(_scaled("SELECT '(Intercept)' AS term, round(mp, 4) AS estimate, round(sqrt(rss / (n - 2) / n), 4) AS std_error FROM s, k UNION ALL SELECT 'l_quantity', round(b1 * sd, 4), round(sqrt(rss / (n - 2) / sxx) * sd, 4) FROM s, k"))
def q48_center_and_scale(spark, d):
    return _two(lm(XY, lineitem(spark, d), LinearConfig(center=True, scale=True)))


@query("""WITH b AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS b FROM lineitem)
SELECT 'l_quantity' AS term, round(any_value(b), 4) AS estimate, round(sqrt(sum(pow(l_extendedprice - b * l_quantity, 2)) / (count(*) - 1) / sum(l_quantity * l_quantity)), 4) AS std_error FROM lineitem, b""")
def q48_no_intercept(spark, d):
    return _two(lm(XY, lineitem(spark, d), LinearConfig(intercept=False)))


#: Five rows leave few degrees of freedom, where the t and F distributions have closed forms.
SMALL = """
WITH t AS (SELECT r_regionkey::DOUBLE AS x, length(r_name)::DOUBLE AS y FROM region),
m AS (SELECT avg(x) AS mx, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM t),
f AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(syy) AS syy, sum(pow(y - b0 - b1 * x, 2)) AS rss,
  sqrt(sum(pow(y - b0 - b1 * x, 2)) / 3 * (0.2 + any_value(mx * mx / sxx))) AS se0, sqrt(sum(pow(y - b0 - b1 * x, 2)) / 3 / any_value(sxx)) AS se1 FROM t, m),
c AS (SELECT '(Intercept)' AS term, b0 AS b, se0 AS se FROM f UNION ALL SELECT 'r_regionkey', b1, se1 FROM f),
p AS (SELECT *, b / se AS t, 1 - 2 / pi() * (atan(abs(b / se) / sqrt(3)) + sqrt(3) * abs(b / se) / (3 + b / se * b / se)) AS p FROM c)
"""


@query(SMALL + "SELECT term, round(t, 8) AS t_stat, round(p, 8) AS p_value FROM p")
def q50_p_values(spark, d):
    return rounded(lm("size ~ r_regionkey", region(spark, d)).coefficient_frame().select("term", "t_stat", "p_value"), 8)


#: With two degrees of freedom the quantile of t at 0.5 + a / 2 is a sqrt(2 / (1 - a^2)).
@query("""WITH t AS (SELECT r_regionkey::DOUBLE AS x, length(r_name)::DOUBLE AS y, r_regionkey::DOUBLE * r_regionkey AS z FROM region),
c AS (SELECT covar_samp(x, x) AS a, covar_samp(x, z) AS b, covar_samp(z, z) AS c, covar_samp(x, y) AS u, covar_samp(z, y) AS v, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM t),
f AS (SELECT *, (c * u - b * v) / (a * c - b * b) AS b1, (a * v - b * u) / (a * c - b * b) AS b2 FROM c),
s AS (SELECT sum(pow(y - my - b1 * (x - mx) - b2 * (z - mz), 2)) / 2 AS s2, any_value(b1) AS b1, any_value(b2) AS b2, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c FROM t, f),
e AS (SELECT 'r_regionkey' AS term, b1 AS est, sqrt(s2 * c / (4 * (a * c - b * b))) AS se FROM s UNION ALL SELECT 'odd', b2, sqrt(s2 * a / (4 * (a * c - b * b))) FROM s)
SELECT term, round(est - 0.9 * sqrt(2 / (1 - 0.81)) * se, 8) AS ci_lower, round(est + 0.9 * sqrt(2 / (1 - 0.81)) * se, 8) AS ci_upper FROM e""")
def q50_confidence_intervals(spark, d):
    frame = lm("size ~ r_regionkey + odd", region(spark, d), LinearConfig(confidence=0.9)).coefficient_frame()
    return rounded(frame.where("NOT is_intercept").select("term", "ci_lower", "ci_upper"), 8)


#: With two numerator degrees of freedom, P(F > f) = (1 + 2 f / d) ^ (-d / 2).
@query("""WITH t AS (SELECT n_regionkey::DOUBLE AS x, n_nationkey::DOUBLE AS z, length(n_name)::DOUBLE AS y FROM nation),
c AS (SELECT covar_samp(x, x) AS a, covar_samp(x, z) AS b, covar_samp(z, z) AS c, covar_samp(x, y) AS u, covar_samp(z, y) AS v, var_samp(y) AS w FROM t),
r AS (SELECT (c * u * u - 2 * b * u * v + a * v * v) / (a * c - b * b) / w AS r2 FROM c)
SELECT round(r2 / 2 / ((1 - r2) / 22), 8) AS f_statistic, round(pow(1 + 2 * (r2 / 2 / ((1 - r2) / 22)) / 22, -11), 8) AS f_p_value FROM r""")
def q50_f_p_value(spark, d):
    t = nation(spark, d).with_column("size", F.length("n_name").cast("double"))
    return rounded(lm("size ~ n_regionkey + n_nationkey", t).statistics_frame().select("f_statistic", "f_p_value"), 8)


@query(BASE + """, v AS (SELECT *, rss / (n - 2) AS s2 FROM s)
SELECT '(Intercept)' AS a, '(Intercept)' AS b, round(s2 * (1 / n + mx * mx / sxx), 4) AS value FROM v UNION ALL SELECT '(Intercept)', 'l_quantity', round(-s2 * mx / sxx, 4) FROM v
UNION ALL SELECT 'l_quantity', '(Intercept)', round(-s2 * mx / sxx, 4) FROM v UNION ALL SELECT 'l_quantity', 'l_quantity', round(s2 / sxx, 4) FROM v""")
def q51_covariance(spark, d):
    m = lm(XY, lineitem(spark, d))
    c = m.cov_matrix()
    return rounded(spark.createDataFrame([(a, b, float(c[i, j])) for i, a in enumerate(m.names) for j, b in enumerate(m.names)], "a string, b string, value double"), 4)


def _outlying(spark, d):
    """A line with every tenth order far off it."""
    return orders(spark, d).with_column("x", (F.col("o_orderkey") % 97).cast("double")).with_column("y", 2.5 * F.col("x") - 4 + F.when(F.col("o_orderkey") % 10 == 0, 300.0).otherwise(0.0))


LINE = _values("term, estimate", "('(Intercept)', -4.0::DOUBLE)", "('x', 2.5)")


@query(LINE)
def q52_huber(spark, d):
    return rounded(penalised.robust("y ~ x", _outlying(spark, d), "huber").frame(), 3)


@query(LINE)
def q52_bisquare(spark, d):
    return rounded(penalised.robust("y ~ x", _outlying(spark, d), "bisquare").frame(), 3)


@query(LINE)
def q52_hampel(spark, d):
    return rounded(penalised.robust("y ~ x", _outlying(spark, d), "hampel").frame(), 3)


_M = [NormalDist().inv_cdf((i - 0.375) / 5.25) for i in range(1, 6)]
_SS = sum(m * m for m in _M)


@query(SMALL + f""", e AS (SELECT y - b0 - b1 * x AS e, row_number() OVER (ORDER BY y - b0 - b1 * x) AS i FROM t, m),
w AS (SELECT {_M[4] / math.sqrt(_SS)!r} + 0.221157 * u - 0.147981 * u * u - 2.071190 * pow(u, 3) + 4.434685 * pow(u, 4) - 2.706056 * pow(u, 5) AS last FROM (SELECT 1 / sqrt(5.0) AS u)),
a AS (SELECT e, CASE i WHEN 1 THEN -last WHEN 5 THEN last WHEN 2 THEN {_M[1]!r} / sqrt(({_SS!r} - 2 * {_M[4] ** 2!r}) / (1 - 2 * last * last)) WHEN 4 THEN {_M[3]!r} / sqrt(({_SS!r} - 2 * {_M[4] ** 2!r}) / (1 - 2 * last * last)) ELSE 0 END AS a FROM e, w)
SELECT round(pow(sum(a * e), 2) / (sum(e * e) - sum(e) * sum(e) / 5), 8) AS statistic FROM a""")
def q53_shapiro_wilk(spark, d):
    w = diagnostics.shapiro_wilk(lm("size ~ r_regionkey", region(spark, d)))
    return rounded(spark.createDataFrame([(w.statistic,)], "statistic double"), 8)


@query("""WITH c AS (SELECT covar_samp(l_quantity, l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, covar_samp(l_discount, l_discount) AS c, covar_samp(l_quantity, l_extendedprice) AS u,
  covar_samp(l_discount, l_extendedprice) AS v, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem),
f AS (SELECT *, (c * u - b * v) / (a * c - b * b) AS b1, (a * v - b * u) / (a * c - b * b) AS b2 FROM c),
g AS (SELECT l_quantity AS x, l_discount AS z, pow(l_extendedprice - my - b1 * (l_quantity - m1) - b2 * (l_discount - m2), 2) AS g FROM lineitem, f),
h AS (SELECT count(*) AS n, covar_samp(x, x) AS a, covar_samp(x, z) AS b, covar_samp(z, z) AS c, covar_samp(x, g) AS u, covar_samp(z, g) AS v, var_samp(g) AS w FROM g),
s AS (SELECT n * (c * u * u - 2 * b * u * v + a * v * v) / (a * c - b * b) / w AS s FROM h)
SELECT round(s, 4) AS statistic, round(exp(-s / 2), 6) AS p_value, 2::BIGINT AS df FROM s""")
def q54_breusch_pagan_p(spark, d):
    b = diagnostics.breusch_pagan(lm("l_extendedprice ~ l_quantity + l_discount", lineitem(spark, d)))
    return spark.createDataFrame([(float(b.statistic), float(b.p_value), b.df)], "statistic double, p_value double, df long").select(F.round("statistic", 4).alias("statistic"), F.round("p_value", 6).alias("p_value"), "df")


@query(INFLUENCE + """, l AS (SELECT e, lag(e) OVER (ORDER BY event_id) AS p FROM r)
SELECT 1.0::DOUBLE AS vif, (SELECT round(sum((e - p) * (e - p)) / sum(e * e), 6) FROM l) AS durbin_watson, (SELECT round(any_value(n) * regr_r2(e * e, dx), 4) FROM r) AS breusch_pagan,
  (SELECT count(*) FROM r, s WHERE e * e * h / (2 * s2 * (1 - h) * (1 - h)) > 4 / n) AS outliers, (SELECT count(*) FROM r WHERE h > 4 / n) AS high,
  (SELECT count(*) FROM r, s WHERE abs(e / sqrt(s2 * (1 - h)) * sqrt(h / (1 - h))) > 2 * sqrt(2 / n)) AS influential""")
def q55_run_all(spark, d):
    a = diagnostics.run_all(_events_model(spark, d))
    row = (round(a.vif[0].vif, 9), round(a.durbin_watson.statistic, 6), round(a.breusch_pagan.statistic, 4), a.cooks_outliers.count(), a.high_leverage.count(), a.influence_points.count())
    return spark.createDataFrame([row], "vif double, durbin_watson double, breusch_pagan double, outliers long, high long, influential long")


@query(SMALL + """, g AS (SELECT *, 1 - rss / syy AS r2, rss / 3 AS s2, -2.5 * (ln(2 * pi() * rss / 5) + 1) AS ll FROM f)
SELECT 1::BIGINT AS nr, 'Model Summary' AS line UNION ALL SELECT 2, repeat('=', 13) UNION ALL SELECT 3, 'Model Type: Linear Regression' UNION ALL SELECT 4, 'Formula: size ~ r_regionkey'
UNION ALL SELECT 5, 'Observations: 5' UNION ALL SELECT 6, 'Predictors: 2' UNION ALL SELECT 7, '' UNION ALL SELECT 8, 'Coefficients:'
UNION ALL SELECT 9, format('{:<20} {:>12} {:>12} {:>12} {:>12}', 'Term', 'Estimate', 'Std Error', 't-value', 'p-value') UNION ALL SELECT 10, repeat('-', 20) || repeat(' ' || repeat('-', 12), 4)
UNION ALL SELECT 11, format('{:<20} {:>12.6f} {:>12.6f} {:>12.6f} {:>12.6f}', term, b, se, t, p) FROM p WHERE term = '(Intercept)'
UNION ALL SELECT 12, format('{:<20} {:>12.6f} {:>12.6f} {:>12.6f} {:>12.6f}', term, b, se, t, p) FROM p WHERE term <> '(Intercept)'""")
def q56_summary_text(spark, d):
    """The head and the coefficients of a model's text, line by line; its figures are in q33 and q34."""
    lines = str(lm("size ~ r_regionkey", region(spark, d))).split("\n")
    return spark.createDataFrame(list(enumerate(lines[:12], 1)), "nr long, line string")


@query(BASE + "SELECT n::BIGINT AS n_obs, 2::BIGINT AS n_predictors, round(rss / 1e6, 3) AS rss, round(syy / 1e6, 3) AS tss, round((syy - rss) / 1e6, 3) AS ess, round(b1, 6) AS slope, true AS named FROM s")
def q57_accessors(spark, d):
    m = lm(XY, lineitem(spark, d))
    named = m.names == ["(Intercept)", "l_quantity"] and [c.is_intercept for c in m.to_coefficients()] == [True, False] and m.statistics().df_model == 1
    row = (m.n_obs, m.n_predictors, round(m.rss / 1e6, 3), round(m.tss / 1e6, 3), round(m.ess / 1e6, 3), round(float(m.beta[1]), 6), named)
    return spark.createDataFrame([row], "n_obs long, n_predictors long, rss double, tss double, ess double, slope double, named boolean")


@query(SANDWICH.format(f="* n / (n - 2)"))
def q58_builder(spark, d):
    m = LinearRegression(XY).data(lineitem(spark, d)).config(LinearConfig(confidence=0.9)).robust(StandardErrors.HC1).fit()
    rows = [(n, float(s)) for n, s in zip(m.model.names, m.standard_errors(), strict=True)]
    return rounded(spark.createDataFrame(rows, "term string, std_error double"), 4)


@query(INFLUENCE + "SELECT event_id, round(f, 6) AS fitted, round(e, 6) AS residual FROM r")
def q58_builder_frames(spark, d):
    m = LinearRegression("value ~ user_id", events(spark, d)).fit()
    return rounded(m.fitted_values().select("event_id", "fitted").join(m.residuals().select("event_id", "residual"), "event_id"))


@query(_values("setting, value", "('intercept', 'True')", "('standard_errors', 'standard')", "('confidence', '0.95')", "('center', 'False')", "('scale', 'False')"))
def q59_defaults(spark, d):
    c = LinearConfig()
    return spark.createDataFrame([(k, str(getattr(v, "value", v))) for k, v in vars(c).items()], "setting string, value string")


@query(_values("what, result", "('no data', 'InvalidConfig')", "('no response', 'MissingResponse')", "('not fitted', 'NotFitted')", "('few rows', 'InsufficientData')", "('singular', 'SingularMatrixError')", "('missing category', 'MissingDataError')", "('unlisted category', 'VariableTypeMismatch')", "('missing number', 'MissingDataError')", "('HAC', 'InvalidConfig')", "('missing in ridge', 'MissingDataError')", "('bad method', 'InvalidConfig')"))
def q59_errors(spark, d):
    t = nation(spark, d).with_column("y", F.length("n_name").cast("double")).with_column("g", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey").cast("string")))
    gone = t.with_column("h", F.when(F.col("n_nationkey") != 3, F.col("y")))
    found = [
        ("no data", lambda: LinearRegression("y ~ n_regionkey").fit()),
        ("no response", lambda: lm("~ n_regionkey", t)),
        ("not fitted", lambda: LinearRegression("y ~ n_regionkey", t).summary()),
        ("few rows", lambda: lm("y ~ n_regionkey", t.filter(F.col("n_nationkey") < 2))),
        ("singular", lambda: lm("y ~ n_regionkey + I(n_regionkey)", t)),
        ("missing category", lambda: lm("y ~ 0 + g", t.as_categorical("g"))),
        ("unlisted category", lambda: lm("y ~ 0 + g", t.filter(F.col("g").isNotNull()).as_categorical("g", ["0", "1", "3"]))),
        ("missing number", lambda: lm("y ~ h", gone)),
        ("HAC", lambda: lm("y ~ n_regionkey", t, LinearConfig(standard_errors=StandardErrors.HAC))),
        ("missing in ridge", lambda: penalised.ridge("y ~ h", gone, 1.0)),
        ("bad method", lambda: penalised.robust("y ~ n_regionkey", t, "median")),
    ]
    return spark.createDataFrame([(n, outcome(f)) for n, f in found], "what string, result string")


@query(_values("name, shown", "('LINEAR', 'Linear Regression')", "('LOGISTIC', 'Logistic Regression')", "('POISSON', 'Poisson Regression')", "('LINEAR_MIXED', 'Linear Mixed Model')", "('GENERALIZED_LINEAR_MIXED', 'GLMM')", "('ARIMA', 'ARIMA')", "('COX', 'Cox PH')", "('ANOVA', 'ANOVA')", "('OTHER', 'Other')"))
def q59_model_types(spark, d):
    return spark.createDataFrame([(t.name, t.value) for t in ModelType], "name string, shown string")


@query("SELECT 'x' AS name, 2.0::DOUBLE AS estimate, 0.5::DOUBLE AS std_error, 4.0::DOUBLE AS t_stat, 0.01::DOUBLE AS p_value, 1.0::DOUBLE AS ci_lower, 3.0::DOUBLE AS ci_upper, true AS is_intercept")
def q59_coefficient_record(spark, d):
    c = Coefficient("x", 2.0).with_std_error(0.5).with_t_stat(4.0).with_p_value(0.01).with_ci(1.0, 3.0).as_intercept()
    return spark.createDataFrame([tuple(vars(c).values())], "name string, estimate double, std_error double, t_stat double, p_value double, ci_lower double, ci_upper double, is_intercept boolean")


@query("""WITH c AS (SELECT covar_samp(l_quantity, l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, covar_samp(l_discount, l_discount) AS c, covar_samp(l_quantity, l_extendedprice) AS u,
  covar_samp(l_discount, l_extendedprice) AS v, var_samp(l_extendedprice) AS w, count(*) AS n FROM lineitem)
SELECT n AS n_obs, round((c * u * u - 2 * b * u * v + a * v * v) / (a * c - b * b) / w, 6) AS r_squared FROM c""")
def q60_ill_conditioned(spark, d):
    """Nearly collinear columns: the fit goes through the QR factorisation and spans the same plane."""
    t = lineitem(spark, d).with_column("near", F.col("l_quantity") + F.col("l_discount") * 1e-5)
    return lm("l_extendedprice ~ l_quantity + near", t).statistics_frame().select("n_obs", F.round("r_squared", 6).alias("r_squared"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) - 1 AS place FROM orders")
def a50_arrange_dates(spark, d):
    """Positions in the order of a timestamp and a text."""
    return Arrange(orders(spark, d)).by("o_orderdate", False).by("o_orderpriority").ranked("place").select("o_orderkey", "place")
