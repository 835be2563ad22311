"""Paths that only large tables take, and awkward values on them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.errors import InvalidParameter, MissingDataError, VariableTypeMismatch
from statloom.functions import matrix
from statloom.functions.ordering import BUCKET, bucketed, with_position
from statloom.operators import stats
from statloom.plans.linmod import LinearConfig, lm
from statloom.sources.builders import Column, from_columns
from statloom.streaming.moments import StreamingMoments


@pytest.mark.parametrize("shape", ["spread", "tied", "two", "heavy ends"])
def test_quantiles_by_narrowing(spark, shape):
    r = random.Random(3)
    n = 4001
    values = {
        "spread": [r.gauss(0, 1e6) for _ in range(n)],
        "tied": [float(r.randrange(5)) for _ in range(n)],
        "two": [0.0] * 2000 + [1.0] * 2000,
        "heavy ends": [-1.0] * 1990 + [r.random() for _ in range(21)] + [2.0] * 1990 + [math.inf, -math.inf],
    }[shape]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double").repartition(3)
    qs = [0.0, 0.001, 0.25, 0.4999, 0.5, 0.75, 1.0]
    got = stats.all_quantiles(df, [F.col("v"), F.when(F.col("v").isNotNull(), 1.0)], qs, one_pass=100, sorted_rows=10)
    ordered = sorted(values)
    for q, g in zip(qs, got[0], strict=True):
        at = (len(ordered) - 1) * q
        a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert g == (a if a == b else pytest.approx(a + (at - math.floor(at)) * (b - a)))
    assert got[1] == [1.0] * len(qs)
    assert stats.all_quantiles(df.limit(0), [F.col("v")], [0.5]) == [[None]]


def test_positions_of_any_key(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([1.5, math.nan, None, -2.0]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "s string, x double, i long").repartition(5)
    for keys in ([("s", True), ("x", False), ("i", True)], [("x", True), ("i", False)], [("s", False), ("i", True)]):
        got = with_position(df, keys, "at", 7).orderBy("at").collect()
        want = df.orderBy(*(F.col(c).asc() if up else F.col(c).desc() for c, up in keys)).collect()
        assert [x["at"] for x in got] == list(range(600)) and [x.i for x in got] == [x.i for x in want]
    sizes = [x["count"] for x in bucketed(df, [("s", True), ("i", True)], 8).groupBy(BUCKET).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 300  # ties of the first key don't gather
    assert with_position(df.limit(0), "i", "at").count() == 0


def test_no_range_of_all_rows_in_one_task(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"))
    plan = with_position(df, "k", "at", 4)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_scaling_flags(spark):
    t = from_columns(spark, [("x", Column.floats([1, 2, 4, 7])), ("y", Column.floats([3, 5, 9, 16]))])
    plain, sd = lm("y ~ x", t), float(np.std([1, 2, 4, 7], ddof=1))
    scaled, centred = lm("y ~ x", t, LinearConfig(scale=True)), lm("y ~ x", t, LinearConfig(center=True))
    assert scaled.beta == pytest.approx([plain.beta[0], plain.beta[1] * sd])
    assert centred.beta == pytest.approx([33 / 4, plain.beta[1]])


def test_missing_and_unlisted_categories(spark):
    made = lambda g: from_columns(spark, [("y", Column.floats([1, 2, 3, 4, 5, 7])), ("g", Column.strings(g))])
    with pytest.raises(MissingDataError):
        lm("y ~ 0 + g", made(["a", "b", None, "a", "b", "a"]).as_categorical("g"))
    with pytest.raises(VariableTypeMismatch):
        lm("y ~ 0 + g", made(list("abcabc")).as_categorical("g", ["a", "b"]))
    t = made(["a", None, "c", "a", "b", "b"]).as_categorical("g", ["a", "b"])
    shown = [tuple(r) for r in t.df.orderBy("row_id").select(*(c for _, c in matrix.dummies(t, "g"))).collect()]
    assert shown == [(1, 0), (None, None), (None, None), (1, 0), (0, 1), (0, 1)]


def test_too_many_levels(spark):
    t = from_columns(spark, [("g", Column.strings(list("abcab")))])
    assert t.as_categorical("g", most=3).levels["g"] == ["a", "b", "c"]
    with pytest.raises(InvalidParameter):
        t.as_categorical("g", most=2)


def test_constant_columns(spark):
    t = from_columns(spark, [("a", Column.floats([0, -1, 1])), ("b", Column.floats([1, math.nan, 1])), ("c", Column.floats([1, 2, 1]))])
    assert matrix.check_constant_columns(t.numeric_matrix(), 1.0, "row_id") == [0, 1, 2]
    assert matrix.check_constant_columns(t.numeric_matrix(), 0.5, "row_id") == [1]
    assert matrix.check_constant_columns(t.numeric_matrix().limit(0), 1.0, "row_id") == []


def test_moments_of_large_means(spark, tmp_path):
    m = StreamingMoments(["a", "b"], str(tmp_path / "log"))
    rows = [(1e9 + i, 2e9 - i * 3.0) for i in range(20)]
    for k in range(4):
        m.add(spark.createDataFrame(rows[k * 5 : k * 5 + 5] + [(None, 1.0)], "a double, b double"), k)
    n, means, cov = m.read(spark)
    want = np.cov(np.array(rows).T)
    assert n == 20 and means == pytest.approx(np.array(rows).mean(axis=0)) and cov == pytest.approx(want, rel=1e-9)
