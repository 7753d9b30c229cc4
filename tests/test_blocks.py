"""Folds in blocks against plain folds, with channels that hold most rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from segline.operators import blocks, timeline
from segline.streaming import operators as X

T0 = datetime(2024, 1, 1)
REWINDS = "channel_id string, rep_id string, poll_at timestamp, event_id int"
EVENTS = "channel_id string, at timestamp, transition string, stored bigint"


def shared(rows):
    at, latest, out = {}, {}, {}
    for c, r, _, i in rows:
        if at.get((c, r), 0) == latest.get(c, 0):
            latest[c] = latest.get(c, 0) + 1
        at[c, r] = out[i] = latest[c]
    return out


@pytest.mark.parametrize(("n", "channels", "reps", "parts"), [(0, "a", "v", 3), (1, "a", "v", 3), (400, "a", "v", 7), (400, "aaaaab", "vw", 9), (600, "a", "vwxyz", 11), (500, "abcdefgh", "vwx", 4), (60, "ab", "vwxyzABCDEFGH", 30)])
def test_shared_periods(spark, n, channels, reps, parts):
    rng = random.Random(n + parts)
    rows = [(None if rng.random() < 0.05 else rng.choice(channels), rng.choice(reps), T0 + timedelta(seconds=i), i) for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, n), REWINDS)
    got = timeline.assign_shared_period(df, parts=parts).collect()
    assert {r["event_id"]: r["period_no"] for r in got} == shared(rows) and len(got) == n


def test_summaries_compose_from_any_state():
    rng = random.Random(2)
    for _ in range(2000):
        reps = "vwxyz"[: rng.randrange(1, 6)]
        first, second = ([("c", rng.choice(reps)) for _ in range(rng.randrange(9))] for _ in "ab")
        state, step = (0, None), blocks.shared_period_fold((0, None))
        for stretch in (first, second):
            held = blocks.SharedPeriods()
            for row in stretch:
                held.feed(row)
            state = held.apply(state)
            want = [step(row)[-1] for row in stretch]
            if want:
                assert state[0] == want[-1]


def test_lifecycle_in_blocks(spark):
    rng = random.Random(3)
    kinds = ["begin", "begin_suppressed", *X.TRANSITIONS, "promote_static", "claim_auto", "claim_auto", "none"]
    for begins in (True, False):
        rows = [(rng.choice("aaaab"), T0 + timedelta(seconds=i), rng.choice(kinds if begins else kinds[2:]), rng.choice([None, *range(9)])) for i in range(500)]
        if not begins:
            rows[0] = ("a", T0, "begin_suppressed", 6)
        state, want = {"a": {}, "b": {}}, {}
        for c, at, what, n in rows:
            (want[at],) = ((x["mode"], x["accepted"]) for x in X.lifecycle_step(state[c], [{"at": at, "transition": what, "stored": n}]))
        got = X.lifecycle_fold(spark.createDataFrame(rng.sample(rows, 500), EVENTS), parts=12).collect()
        assert {r["at"]: (r["mode"], r["accepted"]) for r in got} == want and len(got) == 500
    assert X.lifecycle_fold(spark.createDataFrame([], EVENTS)).count() == 0


def restarts(rows):
    """The rule of T8, one manifest after the other."""
    held, last, n, out = {}, {}, {}, {}
    for c, at, dynamic, ast, tops in rows:
        have, before = held.setdefault(c, {}), last.get(c)
        if dynamic and have and ((before is not None and ast != before) or any(v < have.get(k, v) for k, v in tops.items())):
            n[c], have = n.get(c, 0) + 1, {}
        held[c] = have | {k: max(v, have.get(k, v)) for k, v in tops.items()}
        last[c], out[at] = ast, n.get(c, 0)
    return out


def manifests(rng, n, channels, reps, moves):
    at, out = dict.fromkeys(reps, 0), []
    for i in range(n):
        for k in reps:
            at[k] = rng.randrange(4) if rng.random() < moves else at[k] + rng.randrange(3)
        ast = None if rng.random() < 0.1 else 1 + (rng.random() < moves)
        out.append((rng.choice(channels), T0 + timedelta(seconds=i), rng.choice([True, True, True, False, None]), ast, {k: at[k] for k in reps if rng.random() < 0.6}))
    return out


@pytest.mark.parametrize(("n", "channels", "reps", "moves", "parts"), [(0, "a", "v", 0.1, 3), (1, "a", "v", 0, 3), (400, "a", "vw", 0.02, 9), (400, "aaaab", "vwx", 0.01, 12), (300, "a", "vwxyz", 0, 20), (300, "abcdef", "vw", 0.2, 5), (60, "ab", "vwxyz", 0.1, 30)])
def test_manifest_restarts(spark, n, channels, reps, moves, parts):
    rng = random.Random(n + parts)
    want = manifests(rng, n, channels, reps, moves)
    want = [(None if c == "b" else c, *rest) for c, *rest in want]
    rows = [(c, "p", at, d, ast, k, v) for c, at, d, ast, tops in want for k, v in (tops.items() or [("v", None)])]
    rows += [(c, p, at, None, None, k, None if v is None else v - 1) for c, p, at, _, _, k, v in rows[::3]]  # of rows that differ the largest counts
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "channel_id string, period_id string, fetched_at timestamp, dynamic boolean, ast bigint, rep_id string, highest bigint")
    got = timeline.detect_manifest_restarts(df, parts=parts).collect()
    assert {r["fetched_at"]: r["generation"] for r in got} == restarts(want) and len(got) == n


def test_restart_summaries_compose_from_any_state():
    rng = random.Random(5)
    for _ in range(3000):
        rows = manifests(rng, rng.randrange(1, 24), "a", "vwxyz"[: rng.randrange(1, 6)], rng.choice([0, 0.05, 0.3]))
        feed = [(c, "p", at, d, ast, [{"k": k, "v": v} for k, v in tops.items()]) for c, at, d, ast, tops in rows]
        cuts, state, want = sorted(rng.randrange(len(rows) + 1) for _ in range(3)), (0, {}, None), restarts(rows)
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            held, fold = blocks.ManifestRestarts(), blocks.manifest_restart_fold(state)
            for row in feed[lo:hi]:
                held.feed(row)
                assert fold(row)[-1] == want[row[2]]
            state = held.apply(state)
        assert state[0] == list(want.values())[-1]


def test_a_hot_channel_is_many_blocks(spark):
    rows = [("hot" if i % 3 == 0 else f"c{i % 50}", "v", T0 + timedelta(seconds=i), i) for i in range(6000)]
    made = blocks.ordered_blocks(spark.createDataFrame(rows, REWINDS), ["channel_id"], ["poll_at"], 24)
    sizes = sorted(r["count"] for r in made.groupBy("_part").count().collect())
    assert len(sizes) >= 20 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert made.where("channel_id = 'hot'").select("_part").distinct().count() >= 5
