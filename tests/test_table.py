"""Tables: constructors, column verbs, filters, order, slices, samples."""

import math

import pytest
from pyspark.sql import functions as F

from statloom.errors import ColumnNotFound, DimensionMismatch, DuplicateColumn, IndexOutOfBounds, InvalidParameter, NonNumericData, TypeMismatch
from statloom.operators import stats
from statloom.operators.table import Table, get_bool, get_float, get_int, get_string
from statloom.operators.verbs import Arrange, Filter, Mutate, Select
from statloom.schema import ColumnType, Dimensions, SeriesStats, Shape
from statloom.sources.builders import Column, ColumnBuilder, Index, TableBuilder, empty, from_columns


@pytest.fixture(scope="module")
def abc(spark):
    return from_columns(spark, [("a", Column.floats([2.5, -1, 8])), ("b", Column.ints([40, 7, 12])), ("c", Column.bools([True, True, False]))])


@pytest.fixture(scope="module")
def five(spark):
    return from_columns(spark, [("x", Column.floats([0.5, 2, 3.5, 8, 9])), ("y", Column.ints([7, 14, 21, 28, 35])), ("g", Column.categorical(["M", "K", "M", "P", "K"])), ("s", Column.strings(list("vwxyz")))])


def values(table, name):
    return [r[name] for r in table.rows()]


def test_shape_and_names(abc, spark):
    assert abc.shape() == Shape(3, 3) and abc.column_names == ["a", "b", "c"] and not abc.shape().is_empty()
    assert empty(spark).shape() == Shape(0, 0)
    assert repr(abc) == "DataFrame(3 rows × 3 cols)"
    assert Dimensions((2, 3, 4)).size() == 24


def test_builder_checks(spark):
    b = TableBuilder(spark).with_column("x", Column.floats([1, 2]))
    with pytest.raises(DuplicateColumn):
        b.with_column("x", Column.floats([1, 2]))
    with pytest.raises(DimensionMismatch):
        b.with_column("y", Column.floats([1]))
    assert b.with_index(Index.from_len(5)).build().index is None
    assert b.with_index(Index.from_len(2)).build().index is not None
    with pytest.raises(InvalidParameter):
        ColumnBuilder().build()
    assert ColumnBuilder().categorical(["b", "a"]).name("g").build().levels == ["a", "b"]


def test_index(spark):
    r = Index.range(2, 10, 3)
    assert len(r) == 3 and r.get(1) == 5 and r.get(9) is None and list(r.slice(1, 3).values) == [5, 8]
    assert [x.label for x in r.frame(spark).orderBy("row_id").collect()] == [2, 5, 8]
    assert Index.generic(["u", "v"]).frame(spark).count() == 2 and Index.generic([]).is_empty()


def test_column_types(five):
    assert [five.column_type(c) for c in five.column_names] == [ColumnType.FLOAT, ColumnType.INT, ColumnType.CATEGORICAL, ColumnType.STRING]
    assert five.is_numeric("x") and five.is_categorical("g") and not five.is_numeric("missing")
    assert str(ColumnType.FLOAT) == "float64"


def test_select(abc):
    assert abc.select(["c", "a"]).column_names == ["c", "a"]
    assert Select(abc).columns(["a"]).column("b").execute().column_names == ["a", "b"]
    with pytest.raises(ColumnNotFound):
        abc.select(["z"])
    with pytest.raises(DuplicateColumn):
        abc.select(["a", "a"])
    assert abc.select_by_index([2, 7, 0]).column_names == ["c", "a"]


def test_with_column_mutate_rename_drop(abc):
    assert values(abc.with_column("d", F.col("a") * 2), "d") == [5, -2, 16]
    with pytest.raises(DuplicateColumn):
        abc.with_column("a", F.lit(1))
    assert values(abc.mutate("a", lambda c: c + 1), "a") == [3.5, 0, 9]
    with pytest.raises(ColumnNotFound):
        abc.mutate("z", lambda c: c)
    assert abc.rename([("a", "z")]).column_names == ["b", "c", "z"]
    with pytest.raises(DuplicateColumn):
        abc.rename([("a", "b")])
    assert abc.drop(["b"]).column_names == ["a", "c"]
    with pytest.raises(ColumnNotFound):
        abc.drop(["z"])
    assert abc.drop(["a", "b", "c"]).nrows() == 0
    out = Mutate(abc).mutate("a", lambda c: c + 1).mutate("a", lambda c: c * 10).execute()
    assert values(out, "a") == [35, 0, 90]


def test_filters(five):
    assert values(five.filter_mask([False, True, True, False, True]), "x") == [2, 3.5, 9]
    with pytest.raises(DimensionMismatch):
        five.filter_mask([True])
    kept = Filter(five).by_column("x", lambda c: c > 1).by_row(lambda t: t.get_column("y") < 30).execute()
    assert values(kept, "x") == [2, 3.5, 8] and kept.levels["g"] == ["K", "M", "P"]
    assert Filter(five).by_column("nothing", lambda c: c.isNull()).execute().nrows() == 5


def test_levels_survive_filter(five):
    few = five.filter(F.col("g") == "M")
    assert [r.value for r in stats.unique_values(few, "g").collect()] == ["K", "M", "P"]
    assert [r[0] for r in five.df.orderBy("row_id").select(five.codes("g")).collect()] == [1, 0, 1, 2, 0]


def test_arrange(spark):
    t = from_columns(spark, [("x", Column.floats([3, 1, 2, 1])), ("y", Column.ints([1, 2, 3, 4]))])
    assert [r.y for r in Arrange(t).by("x").by("nothing").execute().df.collect()] == [2, 4, 3, 1]
    assert [r.y for r in t.arrange([("x", False)]).df.collect()] == [1, 3, 2, 4]
    assert t.arrange([]) is t
    assert [r.y for r in t.ranked([("x", True)], "n").orderBy("n").collect()] == [2, 4, 3, 1]


def test_positions_match_global_order(spark):
    df = spark.range(500).selectExpr("id * 37 % 501 AS k", "cast(id % 7 AS string) AS s")
    t = Table(df, key="k")
    for by in ([("k", True)], [("k", False)], [("s", True)], [("s", False)]):
        got = [r.k for r in t.ranked(by, "n").orderBy("n").collect()]
        rows = sorted(df.collect(), key=lambda r: r.k)
        for c, up in reversed(by):
            rows.sort(key=lambda r, c=c: r[c], reverse=not up)
        assert got == [r.k for r in rows]


def test_slices(five):
    assert values(five.slice(1, 4), "x") == [2, 3.5, 8]
    with pytest.raises(IndexOutOfBounds):
        five.slice(0, 6)
    assert five.slice_view(0, 9) is None and five.slice_view(2, 3).nrows() == 1


def test_reorder(five):
    assert [r.x for r in five.reorder_rows([4, 0, 4]).collect()] == [9, 0.5, 9]
    with pytest.raises(IndexOutOfBounds):
        five.reorder_rows([5])
    assert math.isnan(five.reorder_column("x", [0, 9]).collect()[1].value)
    assert [r.value for r in five.reorder_column("g", [0, 9]).collect()] == ["M", "K"]


def test_sample(five):
    one, two = five.sample(3, seed=1), five.sample(3, seed=1)
    assert values(one, "x") == values(two, "x") and one.nrows() == 3 and values(one, "x") == sorted(values(one, "x"))
    with pytest.raises(InvalidParameter):
        five.sample(6)
    assert five.sample(40, replace=True, seed=3).nrows() == 40


def test_cells(five):
    assert five.get("g", 3) == "P" and five.get("x", 9) is None
    assert five.get_row(1).y == 14
    with pytest.raises(IndexOutOfBounds):
        five.get_row(5)
    assert values(five.set("x", 0, 9.5), "x")[0] == 9.5
    for bad in (1, "x"):
        with pytest.raises(TypeMismatch):
            five.set("x", 0, bad)
    with pytest.raises(InvalidParameter):
        five.set("g", 0, "Z")


def test_row_getters(abc):
    r = abc.get_row(0)
    assert (get_float(r, "b"), get_int(r, "a"), get_bool(r, "b"), get_string(r, "a")) == (40.0, 2, True, None)
    assert get_float(r, "nothing") is None


def test_numeric_matrix(abc, five):
    assert [tuple(r)[1:] for r in abc.numeric_matrix().orderBy("row_id").collect()][0] == (2.5, 40.0, 1.0)
    assert five.numeric_columns() == ["x", "y"] and five.numeric_columns([ColumnType.FLOAT]) == ["x"]
    with pytest.raises(NonNumericData):
        five.to_float("s")


def test_position_needs_key(spark):
    with pytest.raises(InvalidParameter):
        Table(spark.range(3)).slice(0, 1)


def test_series_statistics(spark, five):
    s = stats.series_stats(five, "x")
    assert (s.count, s.mean, s.min, s.q25, s.q50, s.max) == (5, 4.6, 0.5, 2.0, 3.5, 9.0) and s.std == pytest.approx(math.sqrt(13.925))
    assert stats.total(five, "x") == 23 and stats.std(five, "x", 0) == pytest.approx(math.sqrt(11.14))
    text = stats.series_stats(five, "s")
    assert (text.count, text.unique_count) == (5, 5) and math.isnan(text.mean) and SeriesStats.empty().count == 0
    with pytest.raises(NonNumericData):
        stats.series_stats(five, "y", floats_only=True)
    nan = from_columns(spark, [("x", Column.floats([float("nan"), 1, 2]))])
    assert stats.series_stats(nan, "x").max == 2
    none = from_columns(spark, [("x", Column.floats([]))])
    assert math.isnan(stats.mean(none, "x")) and stats.total(none, "x") == 0 and math.isnan(stats.std(none, "x"))


def test_describe_and_mode(five):
    rows = {r.column: r for r in stats.describe(five).collect()}
    assert list(rows) == ["x", "y", "g", "s"] and rows["s"].unique == 5 and rows["g"].max == 2.0
    assert stats.mode(five, "g") == "K"


def test_corr_and_cov(spark):
    t = from_columns(spark, [("x", Column.floats([1, 4, 6, 9])), ("y", Column.floats([5, 14, 20, 29])), ("k", Column.floats([7] * 4))])
    c = {(r.row, r.col): r.value for r in stats.corr(t).collect()}
    assert c["x", "y"] == pytest.approx(1.0) and math.isnan(c["k", "k"])
    v = {(r.row, r.col): r.value for r in stats.cov(t, 0).collect()}
    assert v["x", "x"] == pytest.approx(8.5) and v["x", "y"] == pytest.approx(25.5)
    assert stats.corr(t.slice(0, 1)).count() == 0
