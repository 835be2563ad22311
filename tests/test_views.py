"""Views and structural types."""

import pytest
from pyspark.sql import functions as F

from statloom.errors import NonNumericData
from statloom.operators.views import ColumnView, FilteredView, columns, float_matrix, row_views
from statloom.plans.linmod import LinearRegression, lm
from statloom.protocols import AsMatrix, ColumnLike, DataView, ModelResult, StatisticalModel
from statloom.sources.builders import Column, from_columns


@pytest.fixture(scope="module")
def table(spark):
    return from_columns(spark, [("x", Column.floats([1, 2, 3, 4, 5])), ("y", Column.ints([3, 5, 7, 9, 12])), ("g", Column.categorical(list("ABACB")))])


def test_column_view(table):
    v = ColumnView(table, "x")
    assert len(v) == 5 and not v.is_empty() and v.dtype == "float64" and v.get(1) == 2.0 and v.get(5) is None
    part = v.slice(1, 4)
    assert len(part) == 3 and list(part) == [2, 3, 4] and v.slice(5, 6) is None
    assert v.as_float().count() == 5 and v.as_int() is None and v.as_bool() is None
    assert v.stats().mean == 3 and v.mean() == 3 and v.sum() == 15 and v.std() == pytest.approx(1.58113883)
    assert list(v.set(0, 9.0)) == [9, 2, 3, 4, 5] and len(v.filter(F.col("x") > 2)) == 3
    assert list(ColumnView(table, "g")) == list("ABACB")
    with pytest.raises(NonNumericData):
        ColumnView(table, "g").stats()
    assert [c.name for c in columns(table)] == ["x", "y", "g"]


def test_filtered_and_rows(table):
    f = FilteredView(table, F.col("x") > 3)
    assert f.shape().rows == 2 and [r.x for r in f.rows()] == [4, 5]
    rows = list(row_views(table))
    assert [r.index for r in rows] == [0, 1, 2, 3, 4] and rows[3].get_string("g") == "C" and rows[0].to_list() == [1.0, 3, "A"]
    assert float_matrix(table).columns == ["x"]


def test_structural_types(table):
    model = lm("y ~ x", table)
    assert isinstance(table, DataView) and isinstance(table, AsMatrix) and isinstance(ColumnView(table, "x"), ColumnLike)
    assert isinstance(LinearRegression("y ~ x"), StatisticalModel) and isinstance(model, ModelResult)
