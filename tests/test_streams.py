"""Streams in several micro-batches: typed state, timers, saved state; the processors' rules on a plain state store."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from segline.operators import publish, timeline
from segline.streaming import operators as X
from segline.streaming import stateful

T0 = datetime(2024, 1, 1)
EVENT = "channel_id string, period_id string, as_id string, rep_id string, media_type string, seg_no bigint, start_s double, end_s double, commit_ord bigint"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def stream(spark, path, batches, schema, f, start=True):
    """f's rows over batches (lists of rows), one after another, and the query."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/in/k={k}")
        time.sleep(0.01)
    sdf = spark.readStream.schema(schema + ", k int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = f(sdf.drop("k"))
    q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive
    return spark.read.schema(out.schema).parquet(f"{path}/out"), q


# --- the rules, on a state store of dictionaries


class Fake:
    """A handle for one key."""

    def __init__(self):
        self.values, self.maps, self.timers = {}, {}, set()

    def getValueState(self, name, schema, ttlDurationMs=None):
        v = self.values
        return SimpleNamespace(exists=lambda: name in v, get=lambda: v.get(name), update=lambda x: v.__setitem__(name, x), clear=lambda: v.pop(name, None))

    def getMapState(self, name, key, value, ttlDurationMs=None):
        m = self.maps.setdefault(name, {})
        return SimpleNamespace(getValue=m.get, containsKey=m.__contains__, updateValue=m.__setitem__, removeKey=lambda k: m.pop(k, None), keys=lambda: iter(list(m)), iterator=lambda: iter(list(m.items())), clear=m.clear, exists=lambda: bool(m))

    def registerTimer(self, at):
        self.timers.add(at)

    def entries(self):
        return sum(len(x) for m in self.maps.values() for v in m.values() for x in v if isinstance(x, list)) + sum(map(len, self.maps.values()))


def av(n, kind="video", as_id="0", shift=0.0, order=0):
    return Row(media_type=kind, as_id=as_id, rep_id="r", seg_no=n, start_s=2.0 * n + shift, end_s=2.0 * n + 2 + shift, commit_ord=order)


def barrier(horizon_s=600.0, declared=()):
    p, h = stateful.Barrier(horizon_s, None), Fake()
    p.init(h)
    for as_id in declared:
        p.handleInitialState(("c", "p"), Row(as_id=as_id), None)
    return h, lambda batch: [tuple(r)[2:] for r in p.handleInputRows(("c", "p"), iter(batch), None)]


def test_barrier_state_stays_small_and_gives_each_number_once():
    h, feed = barrier(60.0)
    out, most = [], 0
    for n in range(1500):
        out += feed([av(n), av(n, "audio", "1"), av(n)] if n % 7 else [av(n, "audio", "1")])  # each seventh has no video
        most = max(most, h.entries())
    assert len(out) == len(set(out)) == 2 * sum(1 for n in range(1500) if n % 7)
    assert most < 500
    h, feed = barrier(60.0)
    for n in range(1500):  # an audio set that stops: its period's video waits, for a minute and a stretch at most
        feed([av(n), *([av(n, "audio", "1")] if n < 5 else [])])
    assert len(h.maps["video"]) <= 36 and not h.maps["audio"] and set(h.maps["sets"]) == {("1",)}


def test_barrier_waits_for_late_audio_and_declared_sets():
    h, feed = barrier()
    assert feed([av(0, "audio", "1"), av(0, "audio", "2"), av(1), av(2), av(0)]) == [("video", "0", 0), ("audio", "1", 0), ("audio", "2", 0)]
    assert [r[2] for r in feed([av(2, "audio", "2"), av(2, "audio", "1")])] == [2, 2, 2]
    assert sorted(r[2] for r in feed([av(1, "audio", "1"), av(1, "audio", "2")])) == [1, 1, 1]
    h, feed = barrier(declared=("1", "2"))
    assert feed([av(0), av(0, "audio", "1")]) == [] and len(feed([av(0, "audio", "2")])) == 3


def test_barrier_drops_a_restarted_period():
    h, feed = barrier(declared=("1",))
    restart = Row(media_type="restart", as_id=None, rep_id=None, seg_no=None, start_s=None, end_s=None, commit_ord=5)
    assert feed([av(0), av(1)]) == []
    assert feed([av(1, "audio", "1", order=4), av(2, order=4), restart, av(0, "audio", "1", order=6), av(2, "audio", "1", order=6), av(3, order=7)]) == [("video", "0", 1), ("audio", "1", 1)]
    assert set(h.maps["video"]) == {("0", 3)} and set(h.maps["sets"]) == {("1",)}
    assert feed([av(1), av(1, "audio", "1")]) == [("video", "0", 1), ("audio", "1", 1)]  # what was published is forgotten too


def test_expiry_holds_the_live_window_only():
    p, h, gone = stateful.Expiry(20, 4), Fake(), []
    p.init(h)
    for n in range(500):
        gone += [tuple(r)[4] for r in p.handleInputRows(("c", "p"), iter([av(n)]), None)]
    assert gone == list(range(487)) and sum(len(v[0]) for v in h.maps["held"].values()) == 13
    assert [tuple(r)[4] for r in p.handleInputRows(("c", "p"), iter([av(3)]), None)] == [3]  # late, and behind the edge
    off = stateful.Expiry(0, 4)
    off.init(Fake())
    assert list(off.handleInputRows(("c", "p"), iter([av(n) for n in range(50)]), None)) == []


def test_ring_lets_an_evicted_number_in_again():
    p, h = stateful.Ring(3), Fake()
    p.init(h)
    key, row = ("c", "p", "0", "v"), lambda n, k: Row(seg_no=n, commit_ord=k)
    (a,) = p.handleInputRows(key, iter([row(1, 0), row(2, 1), row(2, 2), row(3, 3)]), None)
    (b,) = p.handleInputRows(key, iter([row(5, 5), row(4, 4), row(1, 6)]), None)
    assert tuple(a)[4:] == ([1, 2, 3], 1, 3, 4) and tuple(b)[4:] == ([4, 5, 1], 1, 5, 7)
    assert len(h.maps["slots"]) == len(h.maps["places"]) == 3


def poll(at, rep, first, durations, kind="poll", no=None, end=None, period=0):
    return Row(rep_id=rep, poll_at=T0 + timedelta(seconds=at), kind=kind, media_sequence=first, durations=durations, period_no=period, seg_no=no, end_pts=end)


def periods(saved=()):
    p, h = stateful.Periods(), Fake()
    p.init(h)
    for s in saved:
        p.handleInitialState(("c",), Row(**({"version": 1, "latest": 0, "rep_id": "v", "period_no": 0, "media_sequence": None, "pts": 0, "top": None, "resumed": False, "flight": None, "known": None} | s)), None)
    return h, lambda *batch: [tuple(r)[1:] for r in p.handleInputRows(("c",), iter(batch), None)]


def test_a_hole_is_asked_for_again_where_it_belongs():
    _, feed = periods()
    assert [r[2:4] for r in feed(poll(0, "v", 1, [2.0, 2.0, 2.0]))] == [(1, 0), (2, 180_000), (3, 360_000)]
    assert feed(poll(1, "v", 1, [2.0, 2.0, 2.0])) == []  # all in flight
    assert feed(poll(2, "v", None, None, "gone", 2), poll(3, "v", 1, [2.0, 2.0, 2.0])) == []  # where 1 ends is not known
    got = feed(poll(4, "v", None, None, "ok", 1, 185_000), poll(5, "v", 1, [2.0, 2.0, 2.0, 1.0]), poll(6, "v", 1, [2.0, 2.0, 2.0, 1.0]))
    assert got == [("v", 0, 2, 185_000, 365_000, True), ("v", 0, 4, 540_000, 630_000, False)]
    _, feed = periods()
    feed(poll(0, "v", 5, [1.0, 1.0]))
    assert feed(poll(1, "v", None, None, "gone", 5), poll(2, "v", None, None, "ok", 6, 9), poll(3, "v", 9, [1.0])) == [("v", 0, 9, 180_000, 270_000, False)]  # skipped numbers add no time


def test_restarts_are_shared_and_found_after_a_resume():
    _, feed = periods([{"top": 40, "resumed": True, "latest": 3, "period_no": 3, "pts": 99}])
    assert feed(poll(0, "v", 20, [])) == [] and feed(poll(1, "v", 20, [1.0])) == [("v", 4, 20, 0, 90_000, False)]
    _, feed = periods([{"top": 40, "resumed": True, "latest": 3, "period_no": 3, "pts": 99}])
    assert feed(poll(1, "v", 40, [1.0, 1.0])) == [("v", 3, 41, 99, 90_099, False)]  # cannot be told from a playlist that went on
    _, feed = periods([{"version": 0, "top": 40, "resumed": True, "latest": 3}])
    assert feed(poll(1, "v", 5, [1.0])) == [("v", 0, 5, 0, 90_000, False)]  # state of another version is not taken over
    _, feed = periods()
    feed(poll(0, "v", 9, [1.0]), poll(0, "w", 9, [1.0]))
    assert [r[:3] for r in feed(poll(1, "v", 1, [1.0]), poll(2, "w", 2, [1.0]), poll(3, "v", 0, [1.0]))] == [("v", 1, 1), ("w", 1, 2), ("v", 2, 0)]


# --- streams


def segment_events():
    return [("c", "p", "0", "v", "video", n, 2.0 * n, 2.0 * n + 2, n) for n in range(12)] + [("c", "p", "1", "a", "audio", n, 2.048 * n, 2.048 * n + 2.048, n) for n in range(12)]


def dealt(data, n, seed=1):
    data = random.Random(seed).sample(data, len(data))
    return [data[k::n] for k in range(n)]


def test_streaming_barrier_equals_batch_and_its_state_can_be_read(spark, tmp_path):
    out, q = stream(spark, str(tmp_path), dealt(segment_events(), 6), EVENT, X.stream_barrier)
    ev = spark.createDataFrame(segment_events(), EVENT)
    batch = ev.withColumns({"start_pts": (F.col("start_s") * 1000).cast("bigint"), "end_pts": (F.col("end_s") * 1000).cast("bigint"), "timescale": F.lit(1000)})
    want = set(rows(publish.publish_av_barrier(batch), "as_id", "seg_no"))
    assert {x for x in rows(out, "as_id", "seg_no") if x[0] == "0"} == {x for x in want if x[0] == "0"}
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 6
    sets = spark.read.format("statestore").option("stateVarName", "sets").load(f"{tmp_path}/ck")
    assert rows(sets, "key.channel_id", "user_map_key.as_id", "user_map_value.declared") == [("c", "1", False)]


def test_streaming_expiry_and_ring(spark, tmp_path):
    data = [(*e, "published") for e in segment_events()[:12]] + [("c", "p", "0", "v", "video", 99, 90.0, 900.0, 99, "committed")]
    gone, _ = stream(spark, str(tmp_path / "e"), dealt(data, 5), EVENT + ", status string", lambda s: X.stream_expire(s, 8, 2))
    assert sorted(rows(gone, "seg_no")) == [(n,) for n in range(6)]
    ring, _ = stream(spark, str(tmp_path / "r"), [data[k : k + 3] for k in range(0, 12, 3)], EVENT + ", status string", lambda s: X.stream_ring(s, 4))
    assert sorted(rows(ring, "seen", "ring", "first_no", "last_no")) == [(3, [0, 1, 2], 0, 2), (6, [2, 3, 4, 5], 0, 5), (9, [5, 6, 7, 8], 0, 8), (12, [8, 9, 10, 11], 0, 11)]


POLLS = "channel_id string, rep_id string, poll_at timestamp, media_sequence bigint, durations array<double>"


def test_a_stopped_stream_goes_on_from_its_saved_state(spark, tmp_path):
    rng, batches, at = random.Random(6), [], 0
    for _ in range(6):
        batch = []
        for _ in range(40):
            at += 1
            batch.append((rng.choice("cd"), rng.choice("vwx"), T0 + timedelta(seconds=at), rng.choice([at // 3, at // 3, 2]), [1.0, 2.5, 1.0][: rng.randrange(4)]))
        batches.append(batch)
    cols = ["channel_id", "rep_id", "period_no", "seg_no", "start_pts", "end_pts", "backfill"]
    whole = rows(stream(spark, str(tmp_path / "w"), batches, POLLS, X.stream_periods)[0], *cols)
    first = rows(stream(spark, str(tmp_path / "a"), batches[:3], POLLS, X.stream_periods)[0], *cols)
    saved = X.saved_periods(spark, f"{tmp_path}/a/ck")
    assert {r["version"] for r in saved.collect()} == {stateful.PERIODS_VERSION}
    second = rows(stream(spark, str(tmp_path / "b"), batches[3:], POLLS, lambda s: X.stream_periods(s, saved=saved))[0], *cols)
    assert sorted(first + second) == sorted(whole) and len({r[2] for r in whole}) > 2


def test_generations_online_equal_the_batch_rule(spark, tmp_path):
    rng, schema = random.Random(9), "channel_id string, period_id string, fetched_at timestamp, dynamic boolean, ast bigint, rep_id string, highest bigint"
    data = []
    for k in range(60):
        dynamic, ast = rng.random() < 0.9, rng.choice([1, 1, 1, 1, 2])
        data.append([("c", "p", T0 + timedelta(seconds=k), dynamic, ast, rep, rng.choice([k, k, k, k + 3, None])) for rep in "vw"])
    out, _ = stream(spark, str(tmp_path), [sum(data[k : k + 10], []) for k in range(0, 60, 10)], schema, X.stream_generations)
    batch = timeline.detect_manifest_restarts(spark.createDataFrame(sum(data, []), schema))
    want = {r["fetched_at"]: (r["generation"], r["gateway_period_id"]) for r in batch.collect()}
    assert {r["fetched_at"]: (r["generation"], r["gateway_period_id"]) for r in out.collect()} == want and max(want.values())[0] > 3


ATTEMPTS = "channel_id string, attempt_at timestamp, outcome string, bytes bigint"


def test_windows_end_in_order_though_a_channel_sends_nothing(spark, tmp_path):
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    data = [[("c", zero + timedelta(seconds=10 * i + 1), "ok" if i < 6 else "error", 100) for i in range(k, k + 5)] for k in range(0, 40, 5)]
    known = spark.createDataFrame([("c", zero), ("silent", zero + timedelta(seconds=61))], "channel_id string, since timestamp")
    out, q = stream(spark, str(tmp_path), data, ATTEMPTS, lambda s: X.stream_throughput(s, 30, 10, delay="10 seconds", channels=known))
    got = sorted(rows(out, "channel_id", F.unix_timestamp("to_at") - int(zero.timestamp()), "stored", "bytes", "stalled"))
    c = [(t, sum(1 for i in range(6) if t - 30 <= 10 * i + 1 < t)) for t in range(10, 382, 10)]
    want = [("c", t, n, 100 * n, n == 0) for t, n in c] + [("silent", t, 0, 0, True) for t in range(70, 382, 10)]
    assert got == sorted(want)


def test_the_wall_clock_ends_windows_without_any_rows(spark, tmp_path):
    spark.createDataFrame([("c", T0, "ok", 7)], ATTEMPTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    sdf = spark.readStream.schema(ATTEMPTS).parquet(f"{tmp_path}/in")
    out = X.stream_throughput(sdf, 2, 1, processing=True)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        got = []
        while time.time() < end and [r[1] for r in got][-2:] != [True, True]:
            time.sleep(1)
            assert q.exception() is None
            try:
                got = sorted(rows(spark.read.schema(out.schema).parquet(f"{tmp_path}/out"), "to_at", "stalled", "stored"))
            except Exception:  # noqa: BLE001  nothing is written yet
                got = []
    finally:
        q.stop()
    assert [r[2] for r in got[:2]] == [1, 1] and got[-1][1] and len({r[0] for r in got}) == len(got)


def test_unmatched_video_is_given_up_and_state_shrinks(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    video = [("c", "p", "video", n, 2.0 * n, 2.0 * n + 2, at(2.0 * n)) for n in range(60)]
    audio = [("c", "p", "audio", n, 2.0 * n, 2.0 * n + 2, at(2.0 * n)) for n in range(60) if n not in (3, 40)]
    held = [a for a in audio if a[3] in (20, 21)]  # 20 comes within the delay, 21 behind the watermark
    audio = [a for a in audio if a not in held]
    batches = [[x for x in video + audio if k <= x[3] < k + 10] for k in range(0, 60, 10)]
    batches[2 + 1].append(held[0])  # the watermark is 59 - 20 s then
    batches[5].append(held[1])
    batches += [[("end", "p", m, 0, 9000.0, 9002.0, at(9000))] for m in ("video", "audio")] + [[("end", "p", "video", 1, 9100.0, 9102.0, at(9100)), ("end", "p", "audio", 1, 9100.0, 9102.0, at(9100))]]
    schema = "channel_id string, period_id string, media_type string, seg_no bigint, start_s double, end_s double, start_at timestamp"
    out, q = stream(spark, str(tmp_path), batches, schema, lambda s: X.stream_overlap_outer(s.where("media_type = 'video'"), s.where("media_type = 'audio'"), "20 seconds", "4 seconds"))
    got = sorted(rows(out.where("channel_id = 'c'"), "v_no", "a_no"), key=str)
    assert got == sorted([(n, None if n in (3, 40, 21) else n) for n in range(60)], key=str)
    sizes = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress]
    assert sizes[-1] < max(sizes) / 4


def test_inner_overlap_and_dedup(spark, tmp_path):
    data = [(*e, datetime(2024, 1, 1) + timedelta(seconds=e[6])) for e in segment_events()]
    schema = EVENT + ", start_at timestamp"
    dedup, _ = stream(spark, str(tmp_path / "d"), dealt(data + data, 5), schema, lambda s: X.stream_dedup(s, at="start_at"))
    assert dedup.count() == len(data)
    pairs, _ = stream(spark, str(tmp_path / "o"), dealt(data, 5), schema, lambda s: X.stream_overlap(s.where("media_type = 'video'"), s.where("media_type = 'audio'")))
    assert {r[0] for r in rows(pairs, "v_no")} == set(range(12))


def test_lifecycle_in_batches_and_as_a_stream(spark, tmp_path):
    steps = [("begin_suppressed", 5), ("complete", 5), ("promote_static", 5), ("claim_auto", 5), ("claim_auto", 6), ("fail", 6), ("claim_manual", 6), ("complete", 6)]
    schema = "channel_id string, at timestamp, transition string, stored bigint"
    data = [("c", T0 + timedelta(seconds=i), s, n) for i, (s, n) in enumerate(steps)]
    want = [True, False, True, False, True, True, True, True]
    assert [r[0] for r in rows(X.lifecycle_fold(spark.createDataFrame(data, schema)).orderBy("at"), "accepted")] == want
    out, _ = stream(spark, str(tmp_path), [[d] for d in data], schema, X.lifecycle_fold)
    assert [r[0] for r in rows(out.orderBy("at"), "accepted")] == want


def test_late_rows_are_split(spark):
    df = spark.createDataFrame([("c", T0 + timedelta(seconds=10 * i), T0 + timedelta(seconds=45)) for i in range(40)], "channel_id string, attempt_at timestamp, deadline timestamp")
    seen = {}
    X.late_splitter(lambda b, i: seen.__setitem__("ok", b.count()), lambda b, i: seen.__setitem__("late", b.count()))(df, 0)
    assert seen == {"ok": 5, "late": 35}


@pytest.mark.parametrize("name", ["Barrier", "Expiry", "Ring", "Periods", "Generations", "Throughput", "Lifecycle"])
def test_no_processor_holds_a_document(name):
    assert "json" not in vars(stateful) and hasattr(getattr(stateful, name), "handleInputRows")
