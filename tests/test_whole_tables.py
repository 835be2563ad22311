"""Queries that return every row of their table."""

import os

import pytest

from statloom import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data here")


def test_predictions_for_every_event(spark):
    want = {r.event_id for r in spark.read.parquet(f"{DIR}/events.parquet").select("event_id").collect()}
    got = [r.event_id for r in queries.QUERIES["q40_predict"](spark, DIR).collect()]
    assert len(got) == len(want) and set(got) == want


def test_places_of_every_order(spark):
    rows = queries.QUERIES["q10_arrange_verb"](spark, DIR).collect()
    assert len(rows) == spark.read.parquet(f"{DIR}/orders.parquet").count()
    assert [(r.o_orderkey, r.place) for r in sorted(rows, key=lambda r: (-r.o_totalprice, r.o_orderkey))] == [(r.o_orderkey, r.place) for r in sorted(rows, key=lambda r: r.place)]
