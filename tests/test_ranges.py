"""Sets of numbers as ranges against sets, and against the forms on rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from segline.operators import discovery, ranges

KEY = ["c", "r"]
SCHEMA = "c string, r string, lo bigint, hi bigint"


def sets(rows):
    out = {}
    for c, r, lo, hi in rows:
        out.setdefault((c, r), set()).update(range(lo, hi + 1))
    return {k: v for k, v in out.items() if v}


def drawn(rng, n):
    return [(rng.choice("ab"), rng.choice("vw"), lo, lo + rng.randrange(-2, 9)) for lo in (rng.randrange(80) for _ in range(n))]


def as_rows(df):
    return [tuple(r) for r in df.select(*KEY, "lo", "hi").collect()]


@pytest.mark.parametrize("n", [0, 1, 40])
def test_set_algebra(spark, n):
    rng = random.Random(n)
    a, b = drawn(rng, n), drawn(rng, n)
    x, y = (spark.createDataFrame(z, SCHEMA) for z in (a, b))
    p, q = sets(a), sets(b)
    every = {k for k in p.keys() | q.keys()}
    for op, rule in ((ranges.union, set.union), (ranges.intersection, set.intersection), (ranges.difference, set.difference)):
        got = as_rows(op(x, y, keys=KEY))
        assert sets(got) == {k: s for k in every if (s := rule(p.get(k, set()), q.get(k, set())))}
        for c, r, lo, hi in got:  # as few ranges as can be
            assert lo <= hi and not any((c, r) == g[:2] and g[3] + 1 == lo for g in got)
    assert sets(as_rows(ranges.ranges_of(ranges.numbers_of(x), KEY))) == p


def test_gaps_and_fetching_equal_the_forms_on_rows(spark):
    rng = random.Random(4)
    expected = spark.createDataFrame([(c, r, 1, 60, "static" if r == "w" else "dynamic") for c in "abc" for r in "vw"], SCHEMA + ", presentation string")
    high = spark.createDataFrame([("a", "v", 30, 45), ("b", "v", 50, 20), ("b", "w", 9, 9)], "c string, r string, last_scheduled bigint, max_stored bigint")
    stored = spark.createDataFrame(drawn(rng, 60), SCHEMA)
    row = lambda df: ranges.numbers_of(df)
    want = discovery.to_fetch(row(expected), high, row(stored), keys=KEY)
    got = row(ranges.to_fetch_ranges(expected, high, stored, KEY))
    assert sorted(map(tuple, got.select(*KEY, "seg_no").collect())) == sorted(map(tuple, want.select(*KEY, "seg_no").collect()))
    held = spark.createDataFrame([("a", "v", 1, 3), ("a", "v", 3, 4), ("a", "v", 7, 7), ("a", "v", 9, 12)], SCHEMA)
    assert sorted(tuple(r)[2:] for r in ranges.gaps(held, KEY).collect()) == [(5, 6, 2), (8, 8, 1)]


def test_two_days_of_numbers_move_as_a_few_events(spark):
    n, reps = 86_400, 40
    expected = spark.range(reps).select(F.lit("c").alias("c"), F.col("id").cast("string").alias("r"), F.lit(1).cast("bigint").alias("lo"), F.lit(n).cast("bigint").alias("hi"))
    stored = expected.select("c", "r", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("c", "r", (F.col("k") * 8000 + 1).cast("bigint").alias("lo"), (F.col("k") * 8000 + 7990).cast("bigint").alias("hi"))
    missing = ranges.missing_ranges(expected, stored, KEY)
    assert missing.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] == reps * (n - 10 * 7990)
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "explode" in plan.lower()
    assert 2 * (expected.count() + stored.count()) * 100 < reps * n


def test_timelines_without_a_window(spark):
    rng = random.Random(5)
    entries = lambda: [(rng.choice([0, 0, None, 500]), rng.choice([5, 7]), rng.choice([0, 2, None, 3, -1])) for _ in range(rng.randrange(1, 6))]
    data = [(str(k), "static", 1000, 3, 0, 0.0, 60.0, entries()) for k in range(60)]
    reps = spark.createDataFrame(data, "rep_id string, presentation string, timescale bigint, start_number bigint, ast bigint, period_start_s double, depth_s double, timeline array<struct<t:bigint,d:bigint,r:bigint>>")
    for cap in (100_000, 4):
        want = discovery.enumerate_by_timeline(reps, 0.03, keys=("rep_id",), cap=cap)
        wide = ranges.ranges_by_timeline(reps, 0.03, cap)
        got = wide.withColumn("seg_no", F.explode(F.sequence("lo", "hi"))).withColumn("seg_time", F.col("seg_time") + (F.col("seg_no") - F.col("lo")) * F.col("seg_dur"))
        cols = ["rep_id", "truncated", "seg_no", "seg_time", "seg_dur"]
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
        assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()


def test_spans_of_mixed_lengths_meet_once(spark):
    from segline.operators import publish

    rng = random.Random(11)
    span = lambda: (s := rng.uniform(-50, 4000), s + rng.choice([0.0, 0.1, 0.5, 2.0, 2.0, 2.0, 30.0, 3600.0, 10.0**9]) * rng.uniform(0.5, 1.0))
    left, right = ([("c", rng.choice("pq"), k, *span()) for k in range(300)] for _ in "ab")
    a = spark.createDataFrame(left, "channel_id string, period_id string, x bigint, start_s double, end_s double")
    b = spark.createDataFrame(right, "channel_id string, period_id string, y bigint, r_start_s double, r_end_s double")
    want = sorted((x, y) for _, p, x, s, e in left for _, q, y, c, d in right if p == q and e > s and d > c and min(e, d) - max(s, c) >= 0.5 * min(e - s, d - c))
    for bucket in (None, 30.0):
        one, two = (a, b) if bucket is None else (a.where("end_s < 1e6"), b.where("r_end_s < 1e6"))
        got = sorted(map(tuple, publish.overlap_join(one, two, bucket=bucket).select("x", "y").collect()))
        wide = {k for _, _, k, _, e in left if e >= 1e6}, {k for _, _, k, _, e in right if e >= 1e6}
        assert got == (want if bucket is None else [(x, y) for x, y in want if x not in wide[0] and y not in wide[1]])
