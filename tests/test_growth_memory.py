"""Operators that sort once and aggregate nothing, and tasks whose rows do not grow with the table."""

import re

from segline import catalog
from segline.operators import ranges
from segline.plans import projections
from segline.schema import TRACK

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_and_gaps_hold_one_sort(spark):
    s = projections.rows(spark, SF, "seg").select(*TRACK, "seg_no")
    text = plan(ranges.gaps(ranges.ranges_of(s)))
    assert "Aggregate" not in text and text.count("Exchange") == 1 and text.count("Sort [") == 1
    assert "Aggregate" not in plan(ranges.difference(ranges.ranges_of(s), ranges.ranges_of(s.where("seg_no > 3"))))


def test_gaps_between_ranges_that_overlap_or_are_empty(spark):
    held = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("a", 12, 12), ("a", 11, 5), ("b", 4, 4), ("b", 4, 2)], "c string, lo bigint, hi bigint")
    assert [tuple(r) for r in ranges.gaps(held, ["c"]).collect()] == [("a", 10, 11, 2)]


def test_more_rows_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(projections, "ROWS_A_TASK", 100)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    assert n > 8
    text = plan(catalog.QUERIES["t9_gaps_by_ranges"](spark, SF))
    assert re.findall(r"hashpartitioning\(.*, (\d+)\)", text) == [str(n)]


def tasks_of(spark, monkeypatch, name):
    monkeypatch.setattr(projections, "ROWS_A_TASK", 100)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    text = plan(catalog.QUERIES[name](spark, SF))
    return text, n, [int(x) for x in re.findall(r"hashpartitioning\(.*, (\d+)\)", text)]


def test_run_lengths_are_one_exchange_of_bounded_tasks(spark, monkeypatch):
    text, n, exchanges = tasks_of(spark, monkeypatch, "t13_rle_timeline")
    assert exchanges == [n] and "Aggregate" not in text


def test_newest_numbers_are_one_exchange_of_bounded_tasks(spark, monkeypatch):
    text, n, exchanges = tasks_of(spark, monkeypatch, "l1_keep_newest")
    assert exchanges == [n] and text.count("Sort [") == 2


def test_rollup_sorts_in_bounded_tasks(spark, monkeypatch):
    _, n, exchanges = tasks_of(spark, monkeypatch, "a1_status_rollup")
    assert n in exchanges


def test_clocks_are_one_exchange_of_bounded_tasks(spark, monkeypatch):
    text, n, exchanges = tasks_of(spark, monkeypatch, "t4_accumulate_pts")
    assert exchanges == [n] and "Aggregate" not in text and text.count("Sort [") == 3


def test_what_to_fetch_reads_expected_numbers_once(spark):
    text = plan(catalog.QUERIES["d7_fetch_ranges"](spark, SF))
    assert text.count("FileScan") == 4
