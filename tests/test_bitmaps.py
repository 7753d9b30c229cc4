"""Counts by words of 64 numbers against sets of numbers."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from segline.operators import bitmaps, metrics

ROWS = "channel_id string, period_id string, as_id string, rep_id string, seg_no bigint, outcome string, attempt_at timestamp"


def attempts(n, numbers, seed=1):
    rng = random.Random(seed)
    return [("c", rng.choice("12"), rng.choice(["v", None]), rng.choice("xyz"), rng.choice([None, *numbers]), rng.choice(["ok", "ok", "gone", "error", None]), None) for _ in range(n)]


@pytest.mark.parametrize("numbers", [range(5), range(-130, 130), [-(2**62), -65, -64, -1, 0, 63, 64, 2**40, 2**62]])
def test_levels_are_counts_of_sets(spark, numbers):
    rows = attempts(800, numbers)
    stored, failed, dropped = defaultdict(set), defaultdict(int), defaultdict(int)
    for *track, n, outcome, _ in rows:
        for k in range(5):
            key = (*track[:k], *[None] * (4 - k), 2 ** (4 - k) - 1)
            stored[key] |= {(*track, n)} if outcome == "ok" and n is not None else set()
            failed[key] += outcome not in ("ok", None)
            dropped[key] += outcome == "gone"
    got = metrics.progress_levels(spark.createDataFrame(rows, ROWS)).collect()
    assert {(*r[:4], r["level_no"]): (r["stored"], r["failed"], r["dropped"]) for r in got} == {k: (len(stored[k]), failed[k], dropped[k]) for k in stored}
    assert len(got) == len(stored)


def test_shared_numbers(spark):
    rows = attempts(500, range(-70, 200), 2)
    held = defaultdict(lambda: defaultdict(set))
    for c, p, a, r, n, outcome, _ in rows:
        if outcome == "ok" and n is not None:
            held[c, p, a][r].add(n)
    words = bitmaps.number_words(spark.createDataFrame(rows, ROWS), {"held": F.col("outcome") == "ok"})
    got = {tuple(r)[:3]: tuple(r)[3:] for r in bitmaps.shared_numbers(words, "held").collect()}
    assert got == {k: (len(m), len(set.union(*m.values())), len(set.intersection(*m.values()))) for k, m in held.items()}


def test_no_rows(spark):
    none = spark.createDataFrame([], ROWS)
    words = bitmaps.number_words(none, {"held": None})
    assert words.count() == 0 and bitmaps.shared_numbers(words, "held").count() == 0
    assert metrics.progress_levels(none).where("level_no < 15").count() == 0


def test_few_rows_are_shuffled_and_none_is_sorted(spark):
    many = spark.range(0, 400_000, 1, 8).selectExpr("'c' as channel_id", "'1' as period_id", "'0' as as_id", "cast(id % 2 as string) as rep_id", "cast(id / 4 as bigint) as seg_no", "'ok' as outcome", "current_timestamp() as attempt_at")
    words = bitmaps.number_words(many, {"stored": F.col("outcome") == "ok"})
    assert "SortAggregate" not in words._jdf.queryExecution().executedPlan().toString()
    assert words.count() * 50 < many.select("rep_id", "seg_no").distinct().count() == 200_000
    assert [r["stored"] for r in metrics.progress_levels(many).where("level_no = 7").collect()] == [200_000]
