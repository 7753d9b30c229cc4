"""Overlap joins and the barrier: passes over the segments, sorts and joins do not pile up."""

import random

import pytest

from segline import catalog, catalog_render  # noqa: F401  (registers the queries)
from segline.operators import publish

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_levels_take_one_pass_without_last_writes(spark, monkeypatch):
    seen, levels = [], publish.levels
    monkeypatch.setattr(publish, "levels", lambda df, *more: seen.append(plan(df)) or levels(df, *more))
    catalog.QUERIES["j1_mixed_lengths"](spark, SF)
    assert len(seen) == 1 and "Window" not in seen[0] and "Exchange" not in seen[0]


def test_barrier_joins_segments_once(spark):
    text = plan(catalog.QUERIES["j2_av_barrier"](spark, SF))
    assert text.count("Join") == 1 and text.count("FileScan") == 2 and text.count("Exchange hashpartitioning") <= 5


@pytest.mark.parametrize("match", ["first", "all"])
def test_barrier_equals_its_rule(spark, match):
    rng = random.Random(5)
    segs = set()
    for p in "abcdef":
        for kind, as_ids in (("video", "v" if p != "e" else ""), ("audio", "xy" if p not in "df" else "")):
            for as_id in as_ids:
                for n in range(25):
                    s = 10 * n + rng.randrange(-6, 7)
                    segs |= {("c", p, as_id, f"{as_id}{r}", kind, n, s, s + rng.choice([0, 4, 10, 45])) for r in range(2) if rng.random() < 0.8}
    sets = [("c", "a", "z", "audio"), ("c", "b", "x", "audio"), ("c", "f", "q", "audio")]
    got = spark.createDataFrame(sorted(segs), "channel_id string, period_id string, as_id string, rep_id string, media_type string, seg_no bigint, start_pts bigint, end_pts bigint").selectExpr("*", "1 as timescale")
    told = spark.createDataFrame(sets, "channel_id string, period_id string, as_id string, media_type string")
    for declared in (None, told):
        want = set()
        for p in "abcdef":
            rows = [x for x in segs if x[1] == p]
            audio = {x[2] for x in rows if x[4] == "audio"} | {x[2] for x in sets if declared is not None and x[1] == p}
            if not audio or not any(x[4] == "video" for x in rows):
                want |= {(p, x[2], x[5]) for x in rows}
                continue
            for v in {(x[2], x[5]) for x in rows if x[4] == "video"}:
                hits = {}
                for x in (x for x in rows if x[4] == "video" and (x[2], x[5]) == v):
                    for a in (a for a in rows if a[4] == "audio"):
                        short = min(x[7] - x[6], a[7] - a[6])
                        if short > 0 and min(x[7], a[7]) - max(x[6], a[6]) >= 0.5 * short:
                            hits.setdefault(a[2], set()).add(a[5])
                if set(hits) == audio:
                    want |= {(p, *v)} | {(p, k, n) for k, ns in hits.items() for n in ([min(ns)] if match == "first" else ns)}
        rule = sorted(x[1:4] + x[5:6] for x in segs if (x[1], x[2], x[5]) in want)
        for bucket in (None, 30.0):
            out = publish.publish_av_barrier(got, declared, match, bucket).select("period_id", "as_id", "rep_id", "seg_no")
            assert sorted(map(tuple, out.collect())) == rule
