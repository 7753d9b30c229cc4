"""Edges of windows, retries, timelines, runs and streaming state, on literal rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from segline.operators import discovery, manifest, metrics, timeline, window
from segline.schema import TRACK

KEY = "channel_id string, period_id string, as_id string, rep_id string"
T0 = datetime(2024, 1, 1)


def ten(spark):
    """Ten segments of ten seconds."""
    return spark.createDataFrame([("c", "p", "0", "v", n, n * 10, n * 10 + 10, 1, "published") for n in range(10)], KEY + ", seg_no bigint, start_pts bigint, end_pts bigint, timescale int, status string")


def numbers(df, where="true"):
    return sorted(r["seg_no"] for r in df.where(where).collect())


def test_live_window_without_depth_or_safe(spark):
    s = ten(spark)
    assert numbers(window.project_live_window(s, 0, 20)) == list(range(8))
    assert numbers(window.project_live_window(s, -5, 20)) == list(range(8))
    assert numbers(window.project_live_window(s, 30, -20)) == [7, 8, 9]
    assert numbers(window.project_live_window(s, 30, 20)) == [5, 6, 7]
    assert numbers(window.project_live_window(s, 30, 100)) == list(range(10))


def test_nothing_expires_without_depth(spark):
    s = ten(spark)
    assert numbers(window.expire(s, 0, 20), "expires") == numbers(window.expire(s, -1, 0), "expires") == []
    assert numbers(window.expire(s, 30, 20), "expires") == [0, 1, 2, 3]


def test_a_deadline_drops_only_once_it_has_passed(spark):
    rows = [("c", 1, i, T0 + timedelta(seconds=10 * i), "error", 500, T0 + timedelta(seconds=11)) for i in range(3)]
    df = spark.createDataFrame(rows, "channel_id string, seg_no bigint, event_id bigint, attempt_at timestamp, outcome string, http_status int, due timestamp")
    got = metrics.retry_schedule(df, keys=("channel_id", "seg_no"), deadline="due").orderBy("event_id").collect()
    assert [r["dropped"] for r in got] == [False, False, True]  # the second one's next try is late, the attempt is not


def test_a_dead_entry_ends_a_timeline(spark):
    def listed(*entries):
        df = spark.createDataFrame([("c", "p", "0", "v", 1, 10, None, 0.0, 0.0, list(entries))], KEY + ", start_number bigint, timescale bigint, ast bigint, period_start_s double, depth_s double, timeline array<struct<t:bigint,d:bigint,r:bigint>>")
        return numbers(discovery.enumerate_by_timeline(df, 100.0))

    assert listed((0, 10, 1), (0, 0, -1), (0, 10, 0)) == [1, 2]
    assert listed((0, 0, -1), (0, 10, 3)) == []
    assert listed((0, 10, 1), (0, 0, 0), (0, 10, 0)) == [1, 2, 3, 4]


def test_repeated_numbers_break_no_run(spark):
    rows = [("c", "p", "0", "v", n, k) for k, n in enumerate([0, 1, 2, 3, 8, 8, 9, 8])]
    df = spark.createDataFrame(rows, KEY + ", seg_no bigint, commit_ord bigint")
    assert sorted((r["seg_no"], r["commit_ord"]) for r in timeline.contiguous_run(df).collect()) == [(8, 7), (9, 6)]
    assert numbers(timeline.contiguous_run(df, anchor="vod")) == [0, 1, 2, 3]
    assert numbers(timeline.contiguous_run(df.drop("commit_ord"))) == [8, 9]


def test_a_start_number_of_zero(spark):
    body = '<MPD><Period id="p"><AdaptationSet>{}<Representation id="v"><SegmentTemplate startNumber="0" media="m"/></Representation></AdaptationSet></Period></MPD>'
    docs = spark.createDataFrame([("none", body.format("")), ("zero", body.format('<SegmentTemplate startNumber="0"/>')), ("nine", body.format('<SegmentTemplate startNumber="9"/>')), ("absent", body.format("<SegmentTemplate/>"))], "channel_id string, body string")
    got = {r["channel_id"]: r["start_number"] for r in manifest.effective_addressing(manifest.explode_manifest(docs)).collect()}
    assert got == {"none": 0, "zero": 0, "nine": 9, "absent": 1}


def test_last_write_wins_in_one_sort(spark):
    df = spark.createDataFrame([("c", "p", "0", "v", 1, k, k * 2) for k in (3, 9, 5)] + [("c", "p", "0", "v", 2, 1, 0)], KEY + ", seg_no bigint, commit_ord bigint, x bigint")
    out = timeline.dedup_last(df)
    assert sorted((r["seg_no"], r["commit_ord"], r["x"], r["replaced"]) for r in out.collect()) == [(1, 9, 18, True), (2, 1, 0, False)]
    text = timeline.dedup_last(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Sort [") == 1 and "Aggregate" not in text and set(TRACK) <= set(out.columns)
    assert out.select(F.count("x")).first()[0] == 2
