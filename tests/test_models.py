"""Linear models: closed forms, inference, influence, errors, penalised and robust fits, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.errors import InsufficientData, InvalidConfig, MissingDataError, MissingResponse, NotFitted, SingularMatrixError, VariableNotFound, VariableTypeMismatch
from statloom.functions import matrix
from statloom.plans.linmod import LinearConfig, LinearRegression, StandardErrors, diagnostics, dist, gram, lm, penalised
from statloom.sources.builders import Column, from_columns
from statloom.streaming.moments import StreamingMoments


def make(spark, **columns):
    return from_columns(spark, [(n, v if isinstance(v, Column) else Column.floats(v)) for n, v in columns.items()])


@pytest.fixture(scope="module")
def simple(spark):
    return make(spark, x=[1, 2, 3, 4, 5], y=[3, 5, 7, 9, 11])


@pytest.fixture(scope="module")
def noisy(spark):
    r = np.random.default_rng(0)
    n = 120
    x1, x2 = r.normal(50, 2, n), np.sin(np.arange(n))
    g = r.choice(["a", "b", "c"], n)
    y = 1 + 2 * x1 + 3 * x2 + (g == "b") * 4 + r.normal(0, 0.5, n)
    return make(spark, x1=x1, x2=x2, g=Column.categorical(g), y=y), x1, x2, g, y


def test_exact_line(simple, spark):
    m = lm("y ~ x", simple)
    assert m.beta == pytest.approx([1, 2], abs=1e-10) and m.r_squared == pytest.approx(1)
    new = make(spark, x=[6, 7])
    assert [r.prediction for r in m.predict(new).orderBy("row_id").collect()] == pytest.approx([13, 15])
    assert lm("y ~ 0 + x", make(spark, x=[1, 2, 3], y=[2, 4, 6])).f_statistic is None
    big = make(spark, x=range(1000), y=[1 + 2 * i for i in range(1000)])
    assert lm("y ~ x", big).beta == pytest.approx([1, 2], abs=1e-10)


def test_intercept_only_and_builder(simple):
    assert lm("y ~ 1", simple).beta == pytest.approx([7])
    b = LinearRegression("y ~ x").data(simple).no_intercept().robust(StandardErrors.HC0)
    with pytest.raises(NotFitted):
        b.summary()
    assert len(b.fit().coefficients()) == 1
    with pytest.raises(InvalidConfig):
        LinearRegression("y ~ x").fit()
    with pytest.raises(InvalidConfig):
        LinearRegression("y ~ x").data(simple).robust(StandardErrors.HAC).fit()
    with pytest.raises(MissingResponse):
        lm("~ x", simple)


@pytest.mark.parametrize("kind", [k for k in StandardErrors if k is not StandardErrors.HAC])
@pytest.mark.parametrize("formula", ["y ~ x1 + x2", "y ~ 0 + g + x1:x2"])
def test_against_numpy(noisy, kind, formula):
    t, x1, x2, g, y = noisy
    n = len(y)
    x = np.column_stack([np.ones(n), x1, x2]) if "0" not in formula else np.column_stack([g == "a", g == "b", g == "c", x1 * x2]).astype(float)
    m = lm(formula, t, LinearConfig(standard_errors=kind))
    b, p = np.linalg.lstsq(x, y, rcond=None)[0], x.shape[1]
    e, inv = y - x @ b, np.linalg.inv(x.T @ x)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    w = {"standard": None, "hc0": e**2, "hc1": e**2 * n / (n - p), "hc2": e**2 / (1 - h), "hc3": e**2 / (1 - h) ** 2}[kind.value]
    v = e @ e / (n - p) * inv if w is None else inv @ (x.T * w) @ x @ inv
    assert m.beta == pytest.approx(b, rel=1e-8) and m.std_errors == pytest.approx(np.sqrt(np.diag(v)), rel=1e-7)


def test_influence(noisy):
    t, x1, x2, _, y = noisy
    n, x = len(y), np.column_stack([np.ones(len(y)), x1, x2])
    m = lm("y ~ x1 + x2", t)
    e, inv = y - x @ m.beta, np.linalg.inv(x.T @ x)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    rows = m.influence(dfbetas=True).orderBy("row_id").collect()
    s2 = e @ e / (n - 3)
    assert [r.leverage for r in rows] == pytest.approx(h) and sum(h) == pytest.approx(3)
    assert [r.cooks_distance for r in rows] == pytest.approx(e**2 * h / (3 * s2 * (1 - h) ** 2))
    assert [r.dffits for r in rows] == pytest.approx(e / np.sqrt(s2 * (1 - h)) * np.sqrt(h / (1 - h)))
    keep = np.arange(n) != 5
    b = np.linalg.lstsq(x[keep], y[keep], rcond=None)[0]
    left = y[keep] - x[keep] @ b
    assert rows[5].dfbetas == pytest.approx((m.beta - b) / (np.sqrt(left @ left / (n - 4)) * np.sqrt(np.diag(inv))))
    assert sum(r.residual for r in rows) == pytest.approx(0, abs=1e-8)
    assert m.durbin_watson() == pytest.approx((np.diff(e) ** 2).sum() / (e @ e))
    assert m.influential_points().count() == int((e**2 * h / (3 * s2 * (1 - h) ** 2) > 4 / n).sum())
    assert m.high_leverage_points().count() == int((h > 6 / n).sum())


def test_scaling_and_prediction_freeze(noisy, spark):
    t, x1, *_ = noisy
    plain, scaled = lm("y ~ x1 + x2", t), lm("y ~ x1 + x2", t, LinearConfig(center=True, scale=True))
    new = make(spark, x1=[51.0], x2=[0.2])
    assert scaled.predict(new).first().prediction == pytest.approx(plain.predict(new).first().prediction)
    assert lm("y ~ scale(x1) + x2", t).predict(new).first().prediction == pytest.approx(plain.predict(new).first().prediction)
    assert scaled.beta[1] == pytest.approx(plain.beta[1] * np.std(x1, ddof=1))
    with pytest.raises(VariableNotFound):
        plain.predict(new.drop(["x2"]))
    with pytest.raises(VariableTypeMismatch):
        lm("y ~ 0 + g", t).predict(make(spark, g=Column.strings(["z"])))
    ci, pi = plain.predict_ci(new).first(), plain.predict_pi(new).first()
    assert pi.lower < ci.lower < ci.prediction < ci.upper < pi.upper


def test_errors(spark):
    with pytest.raises(InsufficientData):
        lm("y ~ x1 + x2 + x3", make(spark, y=[1, 2], x1=[1, 2], x2=[3, 4], x3=[5, 6]))
    with pytest.raises(SingularMatrixError) as e:
        lm("y ~ x1 + x2", make(spark, y=[3, 6, 9, 12, 15], x1=[1, 2, 3, 4, 5], x2=[2, 4, 6, 8, 10]))
    assert e.value.aliased == ["x2"]
    with pytest.raises(SingularMatrixError):
        lm("y ~ g", make(spark, y=[2, 4, 6, 8, 10, 12], g=Column.categorical(list("AABBCC"))))
    with pytest.raises(MissingDataError):
        lm("y ~ x", make(spark, y=[1, 2, 3, None], x=[1, 2, 4, 4]))
    with pytest.raises(MissingDataError):
        lm("y ~ x", make(spark, y=[1, 2, 3, 4], x=[1, 2, math.nan, 4]))


def test_ill_conditioned(spark):
    r = np.random.default_rng(1)
    x1 = r.normal(0, 1, 400)
    x2 = x1 + 1e-7 * r.normal(0, 1, 400)
    y = 1 + x1 + x2 + 1e-9 * r.normal(0, 1, 400)
    m = lm("y ~ x1 + x2", make(spark, x1=x1, x2=x2, y=y))
    assert m.beta == pytest.approx([1, 1, 1], abs=1e-2)


def test_wide_gram(spark, monkeypatch):
    r = np.random.default_rng(2)
    a = r.normal(0, 1, (50, 4))
    df = spark.createDataFrame(a.tolist(), "a double, b double, c double, d double").repartition(3)
    want = (a.T * np.arange(1, 51)).T.T @ a
    df = spark.createDataFrame(np.column_stack([a, np.arange(1, 51)]).tolist(), "a double, b double, c double, d double, w double").repartition(3)
    cols = [F.col(c) for c in "abcd"]
    assert gram.cross_products(df, cols, F.col("w")) == pytest.approx(want)
    monkeypatch.setattr(gram, "SUM_COLUMNS", 2)
    assert gram.cross_products(df, cols, F.col("w")) == pytest.approx(want)
    rf = gram.r_factor(df, cols)
    assert rf.T @ rf == pytest.approx(a.T @ a)


def test_wide_model(spark):
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (300, 44))
    y = x @ np.arange(44) + r.normal(0, 1, 300)
    t = make(spark, y=y, **{f"x{i}": x[:, i] for i in range(44)})
    m = lm("y ~ " + " + ".join(f"x{i}" for i in range(44)), t)
    full = np.column_stack([np.ones(300), x])
    h = np.einsum("ij,jk,ik->i", full, np.linalg.inv(full.T @ full), full)
    assert m.beta == pytest.approx(np.linalg.lstsq(full, y, rcond=None)[0], rel=1e-8, abs=1e-8)
    assert [v.leverage for v in m.influence().orderBy("row_id").collect()] == pytest.approx(h)


def test_summary_and_spark_ml(noisy):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression as SparkRegression

    t = noisy[0]
    m = lm("y ~ x1 + x2", t)
    other = SparkRegression(solver="normal", labelCol="y").fit(VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(t.df))
    assert m.beta[1:] == pytest.approx(other.coefficients.toArray(), rel=1e-6)
    assert m.p_values[1:] == pytest.approx(other.summary.pValues[:2], abs=1e-8)
    assert m.std_errors[1:] == pytest.approx(other.summary.coefficientStandardErrors[:2], rel=1e-6)
    text = str(m)
    assert text.startswith("Model Summary\n=====") and "R-squared:" in text and "(Intercept)" in text
    assert m.to_coefficients()[0].is_intercept and m.statistics_frame().count() == 1
    e = np.array([r.residual for r in m.fitted().collect()])
    s = m.residual_statistics()
    sd = e.std(ddof=1)
    assert s.skewness == pytest.approx((e**3).mean() / sd**3) and s.kurtosis == pytest.approx((e**4).mean() / sd**4 - 3)
    assert s.median == pytest.approx(np.median(e))


def test_distributions(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for df in (1.0, 2.5, 8.0, 40.0, 1000.0):
        t = jvm.TDistribution(df)
        for x in (-3.0, -0.1, 0.0, 0.7, 2.0, 9.0):
            assert dist.t_cdf(x, df) == pytest.approx(t.cumulativeProbability(x), abs=1e-10)
        for p in (0.025, 0.5, 0.9, 0.995):
            assert dist.t_quantile(p, df) == pytest.approx(t.inverseCumulativeProbability(p), rel=1e-6, abs=1e-7)
        f, c = jvm.FDistribution(df, 7.0), jvm.ChiSquaredDistribution(df)
        for x in (0.1, 1.0, 3.0, 20.0):
            assert 1 - dist.f_upper(x, df, 7.0) == pytest.approx(f.cumulativeProbability(x), abs=1e-9)
            assert 1 - dist.chi2_upper(x, df) == pytest.approx(c.cumulativeProbability(x), abs=1e-9)


def test_diagnostics(noisy):
    t, x1, x2, _, _ = noisy
    m = lm("y ~ x1 + x2", t)
    r = np.corrcoef(x1, x2)[0, 1]
    assert diagnostics.vif(m)[0].vif == pytest.approx(1 / (1 - r * r))
    all_ = diagnostics.run_all(m)
    assert 0 <= all_.breusch_pagan.p_value <= 1 and 0 < all_.shapiro_wilk.statistic <= 1 and all_.durbin_watson.p_value is None
    assert all_.influence_points.count() >= 0


def test_shapiro_on_normal_scores(spark):
    from statistics import NormalDist

    e = [NormalDist().inv_cdf((i - 0.5) / 40) for i in range(1, 41)]
    m = lm("y ~ 1", make(spark, y=e))
    assert diagnostics.shapiro_wilk(m).p_value > 0.9
    m = lm("y ~ 1", make(spark, y=[math.exp(2 * v) for v in e]))
    assert diagnostics.shapiro_wilk(m).p_value < 1e-4


def test_penalised(noisy):
    t, x1, x2, _, y = noisy
    ols = lm("y ~ x1 + x2", t).beta
    assert penalised.weighted("y ~ x1 + x2", t, F.lit(2.0)).beta == pytest.approx(ols, rel=1e-6)
    assert penalised.ridge("y ~ x1 + x2", t, 0.0).beta == pytest.approx(ols, rel=1e-6)
    assert penalised.elastic_net("y ~ x1 + x2", t, 0.0).beta == pytest.approx(ols, rel=1e-6)
    xc = np.column_stack([x1 - x1.mean(), x2 - x2.mean()])
    want = np.linalg.solve(xc.T @ xc + 5 * np.eye(2), xc.T @ (y - y.mean()))
    assert penalised.ridge("y ~ x1 + x2", t, 5.0).beta[1:] == pytest.approx(want)
    assert penalised.lasso("y ~ x1 + x2", t, 1e6).beta[1:] == pytest.approx([0, 0])
    with pytest.raises(InvalidConfig):
        penalised.ridge("y ~ x1", t, -1.0)


@pytest.mark.parametrize("method", ["huber", "bisquare", "hampel"])
def test_robust(spark, method):
    x = np.arange(60.0)
    y = 1 + 2 * x + np.sin(np.arange(60) * 7)
    y[5] += 500
    fit = penalised.robust("y ~ x", make(spark, x=x, y=y), method)
    assert fit.beta == pytest.approx([1, 2], abs=0.5) and abs(fit.beta[1] - 2) < 0.02
    with pytest.raises(InvalidConfig):
        penalised.robust("y ~ x", make(spark, x=x, y=y), "none")


def test_matrix_helpers(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, math.nan), (1.0, 4.0)], "a double, b double")
    assert matrix.column_maxs(df) == [1.0, 4.0] and matrix.check_constant_columns(df.select("a"), 0) == [0]
    with pytest.raises(Exception, match="NaN"):
        matrix.check_finite(df)
    matrix.ensure_shape(df, 3, 2)
    matrix.ensure_2d(df)
    assert [matrix.string_to_value(s) for s in ("1.5", "yes", "F", "x")] == [1.5, True, False, "x"]
    assert matrix.concatenate(0, [df, df]).count() == 6


def test_stream(spark, tmp_path):
    r = np.random.default_rng(4)
    a = r.normal(3, 2, (90, 2))
    for i in range(3):
        spark.createDataFrame(a[i * 30 : i * 30 + 30].tolist(), "x double, y double").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    moments = StreamingMoments(["x", "y"], str(tmp_path / "log"))
    moments.start(stream, str(tmp_path / "check"), once="yes").awaitTermination(60)
    n, means, cov = moments.read(spark)
    assert n == 90 and means == pytest.approx(a.mean(axis=0)) and cov == pytest.approx(np.cov(a.T))
