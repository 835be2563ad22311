"""Registered queries of the statistical engine, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import matrix
from statloom.functions.ordering import squared_steps
from statloom.operators import stats
from statloom.operators.table import Table
from statloom.operators.verbs import Arrange, Filter, Mutate, Select
from statloom.plans.formula.compile import compile_formula
from statloom.plans.linmod import LinearConfig, StandardErrors, diagnostics, lm
from statloom.plans.linmod import penalised
from statloom.sources.builders import Index, read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def orders(spark: SparkSession, d: str) -> Table:
    return read_parquet(spark, f"{d}/orders.parquet", key="o_orderkey")


def events(spark: SparkSession, d: str) -> Table:
    return read_parquet(spark, f"{d}/events.parquet", key="event_id")


def lineitem(spark: SparkSession, d: str, *categorical: str) -> Table:
    return read_parquet(spark, f"{d}/lineitem.parquet", categorical=categorical)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


# --- column verbs ---------------------------------------------------------------------------------------------------


@query("SELECT o_totalprice, o_orderkey FROM orders")
def q01_select(spark, d):
    return Select(orders(spark, d)).columns(["o_totalprice"]).column("o_orderkey").execute().df


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def q02_select_by_index(spark, d):
    return orders(spark, d).select_by_index([0, 2, 99]).df


@query("SELECT *, round(o_totalprice * 0.1, 6) AS tax FROM (SELECT o_orderkey, o_totalprice FROM orders)")
def q03_with_column(spark, d):
    return orders(spark, d).select(["o_orderkey", "o_totalprice"]).with_column("tax", F.round(F.col("o_totalprice") * 0.1, 6)).df


@query("SELECT o_orderkey, upper(o_orderstatus) || '!' AS o_orderstatus, round(o_totalprice * 2, 4) AS o_totalprice FROM orders")
def q04_mutate(spark, d):
    t = orders(spark, d).select(["o_orderkey", "o_orderstatus", "o_totalprice"])
    return Mutate(t).mutate("o_orderstatus", lambda c: F.concat(F.upper(c), F.lit("!"))).mutate("o_totalprice", lambda c: F.round(c * 2, 4)).execute().df


@query("SELECT p_name, p_retailprice, p_partkey AS id, p_brand AS brand FROM part")
def q05_rename(spark, d):
    t = read_parquet(spark, f"{d}/part.parquet", key="p_partkey").select(["p_partkey", "p_name", "p_brand", "p_retailprice"])
    return t.rename([("p_partkey", "id"), ("p_brand", "brand")]).df


@query("SELECT p_partkey, p_name, p_type, CAST(p_size AS BIGINT) AS p_size FROM part")
def q06_drop(spark, d):
    return read_parquet(spark, f"{d}/part.parquet").drop(["p_brand", "p_retailprice"]).df


@query("SELECT event_id, CAST(user_id AS DOUBLE) AS as_float, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS code FROM events")
def q06_to_float(spark, d):
    t = events(spark, d).as_categorical("event_type")
    return t.df.select("event_id", t.to_float("user_id").alias("as_float"), t.to_float("event_type").alias("code"))


# --- filters --------------------------------------------------------------------------------------------------------


@query("SELECT event_id, value FROM events WHERE value > 50")
def q07_filter_mask(spark, d):
    return events(spark, d).filter(F.col("value") > 50).select(["event_id", "value"]).df


@query("SELECT event_id, event_type, value FROM events WHERE value > 20 AND event_type = 'click'")
def q08_filter_by_column(spark, d):
    t = Filter(events(spark, d)).by_column("value", lambda c: c > 20).by_column("event_type", lambda c: c == "click").execute()
    return t.select(["event_id", "event_type", "value"]).df


@query("SELECT event_id, user_id FROM events WHERE user_id % 3 = 0 AND value < 40")
def q09_filter_by_row(spark, d):
    t = Filter(events(spark, d)).by_row(lambda r: (r.get_column("user_id") % 3 == 0) & (r.get_column("value") < 40)).execute()
    return t.select(["event_id", "user_id"]).df


# --- order, slices, samples -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def q10_arrange(spark, d):
    return orders(spark, d).ranked([("o_orderpriority", True), ("o_totalprice", False)], "place").select("o_orderkey", "place")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def q10_arrange_verb(spark, d):
    """The verb's whole result with the places of its rows."""
    t = Arrange(orders(spark, d).select(["o_orderkey", "o_totalprice"])).by("o_totalprice", False)
    placed = t.execute().df.join(t.ranked("place").select("o_orderkey", "place"), "o_orderkey")
    return placed.select("o_orderkey", "o_totalprice", "place")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 100 AND r < 250")
def q11_slice(spark, d):
    return orders(spark, d).slice(100, 250).select(["o_orderkey", "o_totalprice"]).df


@query("""
SELECT w.position, o.o_orderkey, o.o_totalprice FROM (VALUES (0::BIGINT, 7), (1, 3), (2, 7), (3, 0), (4, 41)) w(position, r)
JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) o USING (r)""")
def q12_reorder_rows(spark, d):
    return orders(spark, d).select(["o_orderkey", "o_totalprice"]).reorder_rows([7, 3, 7, 0, 41])


@query("""
SELECT w.position, coalesce(o.o_totalprice, 'NaN'::DOUBLE) AS value FROM (VALUES (0::BIGINT, 2), (1, 999999999), (2, 2)) w(position, r)
LEFT JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) o USING (r)""")
def q12_reorder_column(spark, d):
    return orders(spark, d).reorder_column("o_totalprice", [2, 999_999_999, 2])


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, md5('7-' || o_orderkey) AS m FROM orders ORDER BY m, o_orderkey LIMIT 50)")
def q13_sample(spark, d):
    return orders(spark, d).sample(50, seed=7).select(["o_orderkey", "o_totalprice"]).df


@query("""
WITH drawn AS (SELECT CAST('0x' || substr(md5('7-' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM orders) AS r FROM range(200) t(i))
SELECT o_orderkey, o_totalprice FROM drawn JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) USING (r)""")
def q13_sample_replace(spark, d):
    return orders(spark, d).sample(200, replace=True, seed=7).select(["o_orderkey", "o_totalprice"]).df


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r = 17")
def q13_get_row(spark, d):
    r = orders(spark, d).select(["o_orderkey", "o_totalprice"]).get_row(17)
    return spark.createDataFrame([tuple(r)], "o_orderkey long, o_totalprice double")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) = 6 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders")
def q13_set_cell(spark, d):
    return orders(spark, d).select(["o_orderkey", "o_totalprice"]).set("o_totalprice", 5, 1.5).df


@query("SELECT i AS row_id, 10 + 3 * i AS label FROM range(100) t(i)")
def q13_range_index(spark, d):
    return Index.range(10, 310, 3).frame(spark)


# --- statistics -----------------------------------------------------------------------------------------------------

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min,
  round(quantile_cont({c}, 0.25), 6) AS "25%", round(quantile_cont({c}, 0.5), 6) AS "50%", round(quantile_cont({c}, 0.75), 6) AS "75%",
  max({c}) AS max, CAST(NULL AS BIGINT) AS "unique" FROM lineitem"""
    for c in NUMERIC
)


@query(DESCRIBE)
def q14_describe(spark, d):
    return rounded(stats.describe(lineitem(spark, d), NUMERIC))


STRINGS = ["o_orderstatus", "o_orderpriority"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min,
  CAST(NULL AS DOUBLE) AS "25%", CAST(NULL AS DOUBLE) AS "50%", CAST(NULL AS DOUBLE) AS "75%", CAST(NULL AS DOUBLE) AS max,
  count(DISTINCT {c}) AS "unique" FROM orders"""
    for c in STRINGS
))
def q15_describe_strings(spark, d):
    return stats.describe(orders(spark, d), STRINGS)


@query("""SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events""")
def q15_series_stats(spark, d):
    s = stats.series_stats(events(spark, d), "value", floats_only=True)
    row = (s.count, s.mean, s.std, s.min, s.q25, s.q50, s.q75, s.max)
    return rounded(spark.createDataFrame([row], "count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"))


@query("SELECT round(avg(l_quantity), 6) AS mean, round(sqrt(var_pop(l_quantity) * count(*) / (count(*) - 2)), 6) AS std2, round(stddev_pop(l_quantity), 6) AS std0, round(sum(l_quantity), 2) AS total FROM lineitem")
def q15_mean_std_sum(spark, d):
    t = lineitem(spark, d)
    row = (stats.mean(t, "l_quantity"), stats.std(t, "l_quantity", 2), stats.std(t, "l_quantity", 0), stats.total(t, "l_quantity"))
    return spark.createDataFrame([row], "mean double, std2 double, std0 double, total double").select(F.round("mean", 6).alias("mean"), F.round("std2", 6).alias("std2"), F.round("std0", 6).alias("std0"), F.round("total", 2).alias("total"))


def _pairs(cell: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS col, {cell.format(a=a, b=b)} AS value FROM lineitem" for a in NUMERIC for b in NUMERIC)


@query(_pairs("round(corr({a}, {b}), 6)"))
def q16_corr(spark, d):
    return rounded(stats.corr(lineitem(spark, d).select(NUMERIC)))


@query(_pairs("round(covar_samp({a}, {b}), 3)"))
def q17_cov(spark, d):
    return rounded(stats.cov(lineitem(spark, d).select(NUMERIC)), 3)


@query(_pairs("round(covar_pop({a}, {b}) * count(*) / (count(*) - 3), 3)"))
def q17_cov_ddof3(spark, d):
    return rounded(stats.cov(lineitem(spark, d).select(NUMERIC), ddof=3), 3)


@query("SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def q18_categorical_codes(spark, d):
    t = events(spark, d).as_categorical("event_type")
    return t.df.select("event_id", "event_type", t.codes("event_type").alias("code"))


@query("SELECT DISTINCT o_orderpriority AS value FROM orders")
def q19_unique_values(spark, d):
    return stats.unique_values(orders(spark, d), "o_orderpriority")


@query("SELECT event_type AS value FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1")
def q20_mode(spark, d):
    return spark.createDataFrame([(stats.mode(events(spark, d), "event_type"),)], "value string")


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS key_value, o_totalprice, CAST(o_totalprice > 100000 AS DOUBLE) AS large FROM orders")
def q21_numeric_matrix(spark, d):
    t = orders(spark, d).select(["o_orderkey", "o_totalprice"]).with_column("key_value", F.col("o_orderkey")).with_column("large", F.col("o_totalprice") > 100000)
    return t.numeric_matrix().select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "key_value", "o_totalprice", "large")


def _column_sql(figure: str, digits: int) -> str:
    return "SELECT " + ", ".join(f"round({figure.format(c=c)}, {digits}) AS {c}" for c in NUMERIC) + " FROM lineitem"


@query(" UNION ALL ".join(f"SELECT '{n}' AS figure, * FROM ({_column_sql(f, 3)})" for n, f in [("mean", "avg({c})"), ("std", "stddev_pop({c})"), ("sum", "sum({c})"), ("min", "min({c})"), ("max", "max({c})")]))
def q21_column_figures(spark, d):
    m = lineitem(spark, d).select(NUMERIC).numeric_matrix()
    found = [("mean", matrix.column_means(m)), ("std", matrix.column_stds(m, 0)), ("sum", matrix.column_sums(m)), ("min", matrix.column_mins(m)), ("max", matrix.column_maxs(m))]
    return rounded(spark.createDataFrame([(n, *v) for n, v in found], "figure string, " + ", ".join(f"{c} double" for c in NUMERIC)), 3)


@query("SELECT o_orderkey FROM orders UNION ALL SELECT c_custkey FROM customer")
def q21_vstack(spark, d):
    return matrix.vstack(orders(spark, d).select(["o_orderkey"]).df, spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"))


# --- formulas -------------------------------------------------------------------------------------------------------

FLAGS = ["A", "N", "R"]


@query("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{s}' AS INTEGER)::DOUBLE AS {s.lower()}" for s in "FOP") + " FROM orders")
def q22_dummies(spark, d):
    t = orders(spark, d).as_categorical("o_orderstatus", "FOP")
    return t.df.select("o_orderkey", *(c.alias(n[-2].lower()) for n, c in matrix.dummies(t, "o_orderstatus")))


@query("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{s}' AS INTEGER)::DOUBLE AS {s.lower()}" for s in "OP") + " FROM orders")
def q22_dummies_drop_first(spark, d):
    t = orders(spark, d).as_categorical("o_orderstatus", "FOP")
    return t.df.select("o_orderkey", *(c.alias(n[-2].lower()) for n, c in matrix.dummies(t, "o_orderstatus", drop_first=True)))


def _design(table: Table, formula: str, names: list[str], digits: int = 6) -> DataFrame:
    design = compile_formula(formula, table, need_response=False)
    keep = [F.col(table.key)] if table.key else []
    return table.df.select(*keep, *(F.round(c, digits).alias(n) for n, (_, c) in zip(names, design.columns, strict=True)))


@query("""SELECT l_linenumber::BIGINT AS l_linenumber, round(ln(l_quantity), 6) AS a, round(log10(l_quantity), 6) AS b, round(log2(l_quantity), 6) AS c,
  round(exp(l_tax), 6) AS e, round(sqrt(l_discount), 6) AS f, round(abs(l_tax), 6) AS g, round(l_quantity, 6) AS h FROM lineitem""")
def q23_functions(spark, d):
    t = lineitem(spark, d)
    return _design(Table(t.df, "l_linenumber"), "~ 0 + log(l_quantity) + log10(l_quantity) + log2(l_quantity) + exp(l_tax) + sqrt(l_discount) + abs(l_tax) + I(l_quantity)", list("abcefgh"))


@query("SELECT o_orderkey, 1.0::DOUBLE AS one, round(o_totalprice, 2) AS x1, round(o_totalprice * o_totalprice, 2) AS x2 FROM orders")
def q24_poly(spark, d):
    return _design(orders(spark, d), "~ poly(o_totalprice, 2)", ["one", "x1", "x2"], 2)


@query("""SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (), 4) AS c,
  round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 4) AS s,
  round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 4) AS z FROM orders""")
def q25_scaling(spark, d):
    return _design(orders(spark, d), "~ 0 + center(o_totalprice) + scale(o_totalprice) + standardize(o_totalprice)", ["c", "s", "z"], 4)


@query("SELECT o_orderkey, round(o_totalprice / stddev_samp(o_totalprice) OVER (), 4) AS s FROM orders")
def q25_scale_vector(spark, d):
    t = orders(spark, d)
    return t.df.select("o_orderkey", F.round(matrix.scale_vector(t.df, F.col("o_totalprice")), 4).alias("s"))


@query("SELECT event_id, round(value * user_id, 4) AS xy FROM events")
def q26_interaction_numeric(spark, d):
    return _design(events(spark, d), "~ 0 + value:user_id", ["xy"], 4)


@query("SELECT o_orderkey, " + ", ".join(f"round(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice ELSE 0 END, 4) AS {s.lower()}" for s in "FOP") + " FROM orders")
def q27_interaction_categorical(spark, d):
    return _design(orders(spark, d).as_categorical("o_orderstatus", "FOP"), "~ 0 + o_totalprice:o_orderstatus", ["f", "o", "p"], 4)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderkey, " + ", ".join(f"round(CASE WHEN o_orderstatus = '{s}' AND o_orderpriority = '{p}' THEN o_totalprice ELSE 0 END, 4) AS {s.lower()}{i}" for s in "FOP" for i, p in enumerate(PRIORITIES)) + " FROM orders")
def q28_interaction_three_way(spark, d):
    t = orders(spark, d).as_categorical("o_orderstatus", "FOP").as_categorical("o_orderpriority", PRIORITIES)
    return _design(t, "~ 0 + o_orderstatus:o_orderpriority:o_totalprice", [f"{s}{i}" for s in "fop" for i in range(5)], 4)


@query("SELECT event_id, round(value, 4) AS a, round(user_id::DOUBLE, 4) AS b, round(value * user_id, 4) AS c FROM events")
def q28_distributed_sum(spark, d):
    return _design(events(spark, d), "~ 0 + (value + user_id) + (value):user_id", ["a", "b", "c"], 4)


# --- linear models --------------------------------------------------------------------------------------------------

XY = "l_extendedprice ~ l_quantity"
#: Sufficient statistics of XY in SQL.
BASE = """
WITH m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_slope(l_extendedprice, l_quantity) AS b1,
    regr_intercept(l_extendedprice, l_quantity) AS b0, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem),
r AS (SELECT l_extendedprice - b0 - b1 * l_quantity AS e, l_quantity - mx AS dx, m.* FROM lineitem, m),
s AS (SELECT any_value(n) AS n, any_value(mx) AS mx, any_value(b0) AS b0, any_value(b1) AS b1, any_value(sxx) AS sxx, any_value(syy) AS syy, sum(e * e) AS rss,
    sum(e * e * dx * dx) AS m11, sum(e * e * dx) AS m01 FROM r)
"""


def _estimates(model, digits: int = 4) -> DataFrame:
    return model.coefficient_frame().select("term", F.round("estimate", digits).alias("estimate"))


@query(BASE + "SELECT '(Intercept)' AS term, round(b0, 4) AS estimate FROM s UNION ALL SELECT 'l_quantity', round(b1, 4) FROM s")
def q29_ols_simple(spark, d):
    return _estimates(lm(XY, lineitem(spark, d)))


@query("""
WITH c AS (SELECT covar_samp(l_quantity, l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, covar_samp(l_discount, l_discount) AS c,
  covar_samp(l_quantity, l_extendedprice) AS u, covar_samp(l_discount, l_extendedprice) AS v, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem),
f AS (SELECT *, (c * u - b * v) / (a * c - b * b) AS b1, (a * v - b * u) / (a * c - b * b) AS b2 FROM c)
SELECT '(Intercept)' AS term, round(my - b1 * m1 - b2 * m2, 4) AS estimate FROM f UNION ALL SELECT 'l_quantity', round(b1, 4) FROM f UNION ALL SELECT 'l_discount', round(b2, 4) FROM f""")
def q30_ols_two(spark, d):
    return _estimates(lm("l_extendedprice ~ l_quantity + l_discount", lineitem(spark, d)))


@query("SELECT 'o_orderpriority[' || o_orderpriority || ']' AS term, round(avg(o_totalprice), 4) AS estimate FROM orders GROUP BY o_orderpriority")
def q31_ols_groups(spark, d):
    return _estimates(lm("o_totalprice ~ 0 + o_orderpriority", orders(spark, d).as_categorical("o_orderpriority")))


@query("""
WITH g AS (SELECT l_returnflag AS f, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
s AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / sum((l_quantity - mx) * (l_quantity - mx)) AS b FROM lineitem JOIN g ON l_returnflag = f)
SELECT 'l_returnflag[' || f || ']' AS term, round(my - b * mx, 4) AS estimate FROM g, s UNION ALL SELECT 'l_quantity', round(b, 4) FROM s""")
def q32_ols_within(spark, d):
    return _estimates(lm("l_extendedprice ~ 0 + l_returnflag + l_quantity", lineitem(spark, d, "l_returnflag")))


@query(BASE + """SELECT '(Intercept)' AS term, round(sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)), 4) AS std_error, round(b0 / sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)), 4) AS t_stat FROM s
UNION ALL SELECT 'l_quantity', round(sqrt(rss / (n - 2) / sxx), 4), round(b1 / sqrt(rss / (n - 2) / sxx), 4) FROM s""")
def q33_inference(spark, d):
    return rounded(lm(XY, lineitem(spark, d)).coefficient_frame().select("term", "std_error", "t_stat"), 4)


@query(BASE + """SELECT round(1 - rss / syy, 6) AS r_squared, round(1 - (rss / syy) * (n - 1) / (n - 2), 6) AS adj_r_squared, round(sqrt(rss / (n - 2)), 4) AS residual_std_error,
  round((syy - rss) / (rss / (n - 2)), 3) AS f_statistic, CAST(n - 2 AS BIGINT) AS df_residual FROM s""")
def q33_fit_statistics(spark, d):
    f = lm(XY, lineitem(spark, d)).statistics_frame()
    return f.select(F.round("r_squared", 6).alias("r_squared"), F.round("adj_r_squared", 6).alias("adj_r_squared"), F.round("residual_std_error", 4).alias("residual_std_error"), F.round("f_statistic", 3).alias("f_statistic"), "df_residual")


@query(BASE + """, l AS (SELECT -n / 2 * ln(2 * pi() * rss / n) - n / 2 AS ll, n FROM s)
SELECT round(ll, 3) AS log_likelihood, round(4 - 2 * ll, 3) AS aic, round(2 * ln(n) - 2 * ll, 3) AS bic FROM l""")
def q34_likelihood(spark, d):
    return rounded(lm(XY, lineitem(spark, d)).statistics_frame().select("log_likelihood", "aic", "bic"), 3)


SANDWICH = BASE + """, v AS (SELECT *, m11 / (sxx * sxx) AS v1, rss / (n * n) - 2 * mx * m01 / (n * sxx) + mx * mx * m11 / (sxx * sxx) AS v0 FROM s)
SELECT '(Intercept)' AS term, round(sqrt(v0 {f}), 4) AS std_error FROM v UNION ALL SELECT 'l_quantity', round(sqrt(v1 {f}), 4) FROM v"""


@query(SANDWICH.format(f=""))
def q35_hc0(spark, d):
    return rounded(lm(XY, lineitem(spark, d), LinearConfig(standard_errors=StandardErrors.HC0)).coefficient_frame().select("term", "std_error"), 4)


@query(SANDWICH.format(f="* n / (n - 2)"))
def q35_hc1(spark, d):
    return rounded(lm(XY, lineitem(spark, d), LinearConfig(standard_errors=StandardErrors.HC1)).coefficient_frame().select("term", "std_error"), 4)


HC_H = BASE + """, w AS (SELECT r.*, e * e / pow(1 - (1 / n + dx * dx / sxx), {k}) AS u FROM r)
SELECT '(Intercept)' AS term, round(sqrt(sum(u * pow(1 / n - mx * dx / sxx, 2))), 4) AS std_error FROM w UNION ALL SELECT 'l_quantity', round(sqrt(sum(u * dx * dx / (sxx * sxx))), 4) FROM w"""


@query(HC_H.format(k=1))
def q35_hc2(spark, d):
    return rounded(lm(XY, lineitem(spark, d), LinearConfig(standard_errors=StandardErrors.HC2)).coefficient_frame().select("term", "std_error"), 4)


@query(HC_H.format(k=2))
def q35_hc3(spark, d):
    return rounded(lm(XY, lineitem(spark, d), LinearConfig(standard_errors=StandardErrors.HC3)).coefficient_frame().select("term", "std_error"), 4)


#: Influence of `value ~ user_id` over events in SQL.
INFLUENCE = """
WITH m AS (SELECT count(*)::DOUBLE AS n, avg(user_id) AS mx, regr_slope(value, user_id) AS b1, regr_intercept(value, user_id) AS b0, regr_sxx(value, user_id) AS sxx FROM events),
r AS (SELECT event_id, value - b0 - b1 * user_id AS e, 1 / n + (user_id - mx) * (user_id - mx) / sxx AS h, n, b0 + b1 * user_id AS f, user_id - mx AS dx, sxx, mx FROM events, m),
s AS (SELECT sum(e * e) / (any_value(n) - 2) AS s2, sum(e * e) AS rss FROM r)
"""


def _events_model(spark, d):
    return lm("value ~ user_id", events(spark, d))


@query(INFLUENCE + "SELECT event_id, round(h, 8) AS leverage, round(e * e * h / (2 * s2 * (1 - h) * (1 - h)), 8) AS cooks_distance FROM r, s")
def q36_influence(spark, d):
    return rounded(_events_model(spark, d).influence().select("event_id", "leverage", "cooks_distance"), 8)


@query(INFLUENCE + "SELECT event_id, round(e / sqrt(s2), 6) AS standardized, round(e / sqrt(s2 * (1 - h)), 6) AS studentized, round(e / sqrt(s2 * (1 - h)) * sqrt(h / (1 - h)), 6) AS dffits FROM r, s")
def q37_residuals(spark, d):
    return rounded(_events_model(spark, d).influence().select("event_id", "standardized", "studentized", "dffits"))


@query(INFLUENCE + "SELECT event_id, round(dx * e / (sxx * (1 - h)) / sqrt((rss - e * e / (1 - h)) / (n - 3) / sxx), 6) AS dfbeta FROM r, s")
def q37_dfbetas(spark, d):
    return _events_model(spark, d).influence(dfbetas=True).select("event_id", F.round(F.col("dfbetas")[1], 6).alias("dfbeta"))


@query(INFLUENCE + """, k AS (SELECT avg(e) AS me, stddev_samp(e) AS sd, any_value(n) AS n FROM r)
SELECT round(min(e), 6) AS min, round(quantile_cont(e, 0.25), 6) AS q1, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.75), 6) AS q3, round(max(e), 6) AS max, round(any_value(sd), 6) AS std,
  round(sum(pow(e - me, 3)) / any_value(k.n) / pow(any_value(sd), 3), 6) AS skewness, round(sum(pow(e - me, 4)) / any_value(k.n) / pow(any_value(sd), 4) - 3, 6) AS kurtosis FROM r, k""")
def q38_residual_summary(spark, d):
    return rounded(_events_model(spark, d).residual_frame().select("min", "q1", "median", "q3", "max", "std", "skewness", "kurtosis"))


@query(INFLUENCE + ", l AS (SELECT e, lag(e) OVER (ORDER BY event_id) AS p FROM r) SELECT round(sum((e - p) * (e - p)) / sum(e * e), 6) AS durbin_watson, round(1 - sum((e - p) * (e - p)) / sum(e * e) / 2, 6) AS autocorrelation FROM l")
def q39_durbin_watson(spark, d):
    w = diagnostics.durbin_watson(_events_model(spark, d))
    return rounded(spark.createDataFrame([(w.statistic, w.autocorrelation)], "durbin_watson double, autocorrelation double"))


@query("SELECT round(sum((value - p) * (value - p)), 3) AS sd, round(sum(value * value), 3) AS ss, count(*) AS n FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS p FROM events)")
def q39_squared_steps(spark, d):
    return rounded(squared_steps(events(spark, d).df, "event_id", "value").select("sd", "ss", "n"), 3)


@query(INFLUENCE + "SELECT event_id, round(f, 6) AS prediction FROM r")
def q40_predict(spark, d):
    return rounded(_events_model(spark, d).predict(events(spark, d).select(["event_id", "user_id"])))


@query(INFLUENCE + "SELECT event_id, round(sqrt(s2 * h), 6) AS mean_se, round(sqrt(s2 * (1 + h)), 6) AS new_se FROM r, s")
def q40_intervals(spark, d):
    from statloom.plans.linmod.dist import t_quantile

    m = _events_model(spark, d)
    t, new = t_quantile(0.975, m.df_residual), events(spark, d)
    a = m.predict_ci(new).select("event_id", F.round((F.col("upper") - F.col("lower")) / (2 * t), 6).alias("mean_se"))
    b = m.predict_pi(new).select("event_id", F.round((F.col("upper") - F.col("lower")) / (2 * t), 6).alias("new_se"))
    return a.join(b, "event_id")


@query(INFLUENCE + "SELECT event_id FROM r, s WHERE e * e * h / (2 * s2 * (1 - h) * (1 - h)) > 4 / n")
def q40_influential(spark, d):
    return diagnostics.cooks_outliers(_events_model(spark, d)).select("event_id")


@query("""WITH m AS (SELECT count(*)::DOUBLE AS n, avg(value) AS mx, regr_sxx(user_id, value) AS sxx FROM events)
SELECT event_id, round(1 / n + (value - mx) * (value - mx) / sxx, 8) AS leverage FROM events, m WHERE 1 / n + (value - mx) * (value - mx) / sxx > 4 / n""")
def q40_high_leverage(spark, d):
    return rounded(diagnostics.high_leverage(lm("user_id ~ value", events(spark, d))).select("event_id", "leverage"), 8)


@query(INFLUENCE + "SELECT event_id FROM r, s WHERE abs(e / sqrt(s2 * (1 - h)) * sqrt(h / (1 - h))) > 2 * sqrt(2 / n)")
def q41_influence_points(spark, d):
    return diagnostics.influence_points(_events_model(spark, d)).select("event_id")


@query("""WITH c AS (SELECT corr(l_quantity, l_discount) AS r FROM lineitem)
SELECT 'l_quantity' AS variable, round(1 / (1 - r * r), 6) AS vif, round(1 - r * r, 6) AS tolerance FROM c UNION ALL SELECT 'l_discount', round(1 / (1 - r * r), 6), round(1 - r * r, 6) FROM c""")
def q42_vif(spark, d):
    found = diagnostics.vif(lm("l_extendedprice ~ l_quantity + l_discount", lineitem(spark, d)))
    return rounded(spark.createDataFrame([(v.variable, v.vif, v.tolerance) for v in found], "variable string, vif double, tolerance double"))


@query(BASE + "SELECT round(any_value(n) * regr_r2(e * e, dx), 4) AS statistic, 1::BIGINT AS df FROM r")
def q43_breusch_pagan(spark, d):
    b = diagnostics.breusch_pagan(lm(XY, lineitem(spark, d)))
    return rounded(spark.createDataFrame([(b.statistic, b.df)], "statistic double, df long"), 4)


@query("""WITH w AS (SELECT sum(l_tax + 1) AS sw, sum((l_tax + 1) * l_quantity) AS sx, sum((l_tax + 1) * l_extendedprice) AS sy, sum((l_tax + 1) * l_quantity * l_quantity) AS sxx, sum((l_tax + 1) * l_quantity * l_extendedprice) AS sxy FROM lineitem),
f AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b FROM w)
SELECT '(Intercept)' AS term, round((sy - b * sx) / sw, 3) AS estimate FROM f UNION ALL SELECT 'l_quantity', round(b, 3) FROM f""")
def q44_weighted(spark, d):
    return rounded(penalised.weighted(XY, lineitem(spark, d), F.col("l_tax") + 1).frame(), 3)


@query("""WITH c AS (SELECT regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
f AS (SELECT *, sxy / (sxx + 1000) AS b FROM c)
SELECT '(Intercept)' AS term, round(my - b * mx, 3) AS estimate FROM f UNION ALL SELECT 'l_quantity', round(b, 3) FROM f""")
def q45_ridge(spark, d):
    return rounded(penalised.ridge(XY, lineitem(spark, d), 1000.0).frame(), 3)


@query("""WITH c AS (SELECT count(*)::DOUBLE AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
f AS (SELECT *, sign(sxy) * greatest(abs(sxy / n) - 500, 0) / (sxx / n) AS b FROM c)
SELECT '(Intercept)' AS term, round(my - b * mx, 3) AS estimate FROM f UNION ALL SELECT 'l_quantity', round(b, 3) FROM f""")
def q46_lasso(spark, d):
    return rounded(penalised.lasso(XY, lineitem(spark, d), 500.0).frame(), 3)


@query("""WITH c AS (SELECT count(*)::DOUBLE AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
f AS (SELECT *, sign(sxy) * greatest(abs(sxy / n) - 250, 0) / (sxx / n + 250) AS b FROM c)
SELECT '(Intercept)' AS term, round(my - b * mx, 3) AS estimate FROM f UNION ALL SELECT 'l_quantity', round(b, 3) FROM f""")
def q47_elastic_net(spark, d):
    return rounded(penalised.elastic_net(XY, lineitem(spark, d), 500.0, 0.5).frame(), 3)
