"""Timeline construction: last writes, ends, clocks, periods, gaps, islands, numbering, run lengths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from segline.operators import blocks
from segline.schema import PERIOD, TRACK

UP_TO_BEFORE = (Window.unboundedPreceding, -1)


def _others(df: DataFrame, keys) -> list[str]:
    return [c for c in df.columns if c not in keys]


def dedup_last(df: DataFrame, keys=(*TRACK, "seg_no"), order=("commit_ord",), hashed: bool = False) -> DataFrame:
    """The last written row for each key, and whether it replaced an earlier one.

    One exchange and one sort: a row is last if none follows it in its key's order. Writes of one key are few, so
    an aggregation of whole rows before the shuffle would only sort them twice (strings in it rule out hashing). hashed: the sort goes by a hash of the key first, which
    compares faster than strings, where no window over a part of the key follows.
    """
    w = Window.partitionBy(*(["_k"] if hashed else []), *keys).orderBy(*order)
    rows = (df.withColumn("_k", F.xxhash64(*keys)) if hashed else df).withColumn("_next", F.lead(F.lit(1)).over(w)).withColumn("replaced", F.row_number().over(w) > 1).where("_next is null")
    return rows.select(*keys, *_others(df, keys), "replaced")


def derive_ends(df: DataFrame, keys=tuple(TRACK), seq="seg_no", start="start_pts", out="end_pts") -> DataFrame:
    """The next start where numbers adjoin, else the last adjacent duration seen before, else the start."""
    w = Window.partitionBy(*keys).orderBy(seq)
    step = F.when(F.lead(seq).over(w) == F.col(seq) + 1, F.lead(start).over(w) - F.col(start))
    carried = F.last("_step", ignorenulls=True).over(w.rowsBetween(*UP_TO_BEFORE))
    return df.withColumn("_step", step).withColumn(out, F.col(start) + F.coalesce("_step", carried, F.lit(0))).drop("_step")


def declared_ends(df: DataFrame, start="start_pts", duration="duration", task_timescale="task_timescale", init_timescale="init_timescale", out="end_pts") -> DataFrame:
    """Start + trunc(duration / task timescale * track timescale); the init's timescale beats the task's; 0 if any is missing."""
    track = F.coalesce(F.when(F.col(init_timescale) > 0, F.col(init_timescale)), F.col(task_timescale))
    known = (F.col(duration) > 0) & (F.col(task_timescale) > 0) & (track > 0)
    ticks = (F.col(duration).cast("double") / F.col(task_timescale) * track).cast("bigint")
    return df.withColumn(out, F.when(known, F.col(start) + ticks).otherwise(F.lit(0).cast("bigint")))


def accumulate_pts(segs: DataFrame, keys=tuple(PERIOD) + ("rep_id",), seq="seg_no", duration="duration_s", seen="poll_at", clock=90_000) -> DataFrame:
    """T4: start and end on the playlist's clock.

    The first sight of a number counts. A number above all seen before is on the line: it starts at the sum
    of rounded durations of those before it, skipped numbers adding nothing. A late one (backfill) starts
    where number - 1 ended, and waits (null) if that is unknown.
    """
    sights = Window.partitionBy(*keys, seq).orderBy(seen)
    rows = segs.withColumn("_sight", F.row_number().over(sights)).where("_sight = 1").drop("_sight")
    ticks = F.round(F.col(duration) * clock).cast("bigint")
    by_time = Window.partitionBy(*keys).orderBy(seen, seq)
    ahead = F.col(seq) > F.coalesce(F.max(seq).over(by_time.rowsBetween(*UP_TO_BEFORE)), F.lit(-1))
    rows = rows.withColumn("_ticks", ticks).withColumn("_line", ahead)
    by_seq = Window.partitionBy(*keys).orderBy(seq)
    on_line = F.coalesce(F.sum(F.when(F.col("_line"), F.col("_ticks"))).over(by_seq.rowsBetween(*UP_TO_BEFORE)), F.lit(0))
    rows = rows.withColumn("_at", F.when(F.col("_line"), on_line))
    # backfilled numbers in a row hang on the line row just before them
    late = F.coalesce(F.sum(F.when(~F.col("_line"), F.col("_ticks"))).over(by_seq.rowsBetween(*UP_TO_BEFORE)), F.lit(0))
    rows = rows.withColumn("_late", late).withColumn("_nth", F.row_number().over(by_seq))
    here = F.struct((F.col("_at") + F.col("_ticks")).alias("end"), F.col(seq).alias("no"), "_late", "_nth")
    rows = rows.withColumn("_anchor", F.last(F.when(F.col("_line"), here), ignorenulls=True).over(by_seq))
    since = F.col("_late") - F.col("_anchor._late")
    unbroken = F.col(seq) - F.col("_anchor.no") == F.col("_nth") - F.col("_anchor._nth")
    start = F.when(F.col("_line"), F.col("_at")).when(unbroken, F.col("_anchor.end") + since)
    return rows.withColumn("start_pts", start).withColumn("end_pts", F.col("start_pts") + F.col("_ticks")).drop("_ticks", "_line", "_at", "_anchor", "_late", "_nth")


_RESTART = r"^(.+)\.r([1-9][0-9]{0,17})$"


def origin_period(period) -> Column:
    """The period id without a restart mark .rN (N a positive canonical integer)."""
    p = F.col(period) if isinstance(period, str) else period
    return F.when(p.rlike(_RESTART), F.regexp_extract(p, _RESTART, 1)).otherwise(p)


def restart_number(period) -> Column:
    p = F.col(period) if isinstance(period, str) else period
    return F.when(p.rlike(_RESTART), F.regexp_extract(p, _RESTART, 2).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def restart_period_id(origin, generation) -> Column:
    return F.when(generation == 0, origin).otherwise(F.concat(origin, F.lit(".r"), generation.cast("string")))


def order_periods(periods: DataFrame, doc_order: DataFrame | None = None, channel="channel_id", period="period_id") -> DataFrame:
    """T5: period_ord from 0 for each channel.

    doc_order: channel, period, pos of the document. Unlisted periods go before listed ones, listed by
    position; a restart X.rN follows X by N; otherwise decimal names by number, then names as strings.
    """
    rows = periods.select(channel, period).distinct().withColumn("_base", origin_period(period)).withColumn("_gen", restart_number(period))
    if doc_order is not None:
        listed = doc_order.select(F.col(channel), F.col(period).alias("_base"), F.col("pos").alias("_pos"))
        rows = rows.join(listed, [channel, "_base"], "left")
    else:
        rows = rows.withColumn("_pos", F.lit(None).cast("int"))
    number = F.when(F.col("_base").rlike("^[0-9]{1,18}$"), F.col("_base").cast("bigint"))
    order = Window.partitionBy(channel).orderBy(F.col("_pos").isNotNull(), "_pos", number.isNull(), number, "_base", "_gen")
    return rows.select(channel, period, (F.row_number().over(order) - 1).alias("period_ord"))


def detect_rewinds(polls: DataFrame, keys=("channel_id", "rep_id"), order=("poll_at",), sequence="media_sequence", last="last_seq", resumed: str | None = None, held: str | None = None) -> DataFrame:
    """Rewind, and period_no counting them from 0.

    A poll rewinds if its media sequence is below the previous one, or, as the first after a resume, if its
    last number is below the highest held.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    back = F.coalesce(F.col(sequence) < F.lag(sequence).over(w), F.lit(False))
    if resumed and held:
        back = F.when(F.col(resumed), F.coalesce(F.col(last) < F.col(held), F.lit(False))).otherwise(back)
    return polls.withColumn("rewind", back).withColumn("period_no", F.sum(F.col("rewind").cast("bigint")).over(w))


def assign_shared_period(rewinds: DataFrame, channel="channel_id", rep="rep_id", order=("poll_at", "event_id"), parts: int | None = None) -> DataFrame:
    """The channel's period number after each rewind, shared by its renditions.

    A rendition that is on the latest period opens the next one; one that lags joins the latest. Rewinds are blocks of
    the order of channel and time (`parts` of them, else as many as shuffles have), so a channel with most of them is
    many tasks; a block's summary has one outcome for each rendition in it. It is made when this is called.
    """
    cols = [channel, rep, *order]
    rows = rewinds.select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", period_no bigint"
    arrow = pa.schema([*to_arrow_schema(rows.schema), pa.field("period_no", pa.int64())])
    made = blocks.ordered_blocks(rows, [channel], [*order, rep], parts)
    at = blocks.entered(made, [channel], [*order, rep], blocks.SharedPeriods, (0, None))
    return blocks.run_blocks(made, [channel], [*order, rep], blocks.shared_period_fold, at, (0, None), schema, arrow)


def detect_manifest_restarts(listed: DataFrame, channel="channel_id", period="period_id", rep="rep_id", parts: int | None = None) -> DataFrame:
    """Generation and gateway period id of each manifest's period.

    listed: channel, period, rep, fetched_at, dynamic, ast, highest (largest number listed; null if none). Rows of one
    fetched_at are one manifest; of rows that differ, the largest dynamic, ast and highest of a representation count.
    A dynamic manifest restarts a period that holds segments if its availability start changed, or if a
    representation lists less than it held. Manifests are blocks of the order of channel, period and time (`parts` of
    them, else as many as shuffles have), so a period with most of them is many tasks. It is made when this is called.
    """
    tops = F.collect_list(F.when(F.col("highest").isNotNull(), F.struct(F.col(rep).alias("k"), F.col("highest").alias("v"))))
    rows = listed.groupBy(channel, period, "fetched_at").agg(F.max("dynamic").alias("dynamic"), F.max("ast").alias("ast"), tops.alias("tops"))
    keys, order, fresh = [channel, period], ["fetched_at"], (0, {}, None)
    head = rows.select(*keys, *order).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head) + ", generation bigint"
    arrow = pa.schema([*to_arrow_schema(head), pa.field("generation", pa.int64())])
    made = blocks.ordered_blocks(rows, keys, order, parts)
    at = blocks.entered(made, keys, order, blocks.ManifestRestarts, fresh)
    found = blocks.run_blocks(made, keys, order, blocks.manifest_restart_fold, at, fresh, schema, arrow)
    return found.withColumn("gateway_period_id", restart_period_id(F.col(period), F.col("generation")))


def find_gaps(df: DataFrame, keys=tuple(TRACK), seq="seg_no") -> DataFrame:
    """One row for each run of missing numbers: gap_start, gap_end, missing."""
    after = F.lead(seq).over(Window.partitionBy(*keys).orderBy(seq))
    return df.select(*keys, seq).distinct().withColumn("_next", after).where(F.col("_next") - F.col(seq) > 1).select(*keys, (F.col(seq) + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end"), (F.col("_next") - F.col(seq) - 1).alias("missing"))


def missed_at_edge(listed: DataFrame, high_water: DataFrame, keys=("channel_id", "rep_id")) -> DataFrame:
    """T9 at the live edge: numbers between the highest held and the first one a poll lists."""
    return listed.join(high_water, list(keys)).withColumn("missed", F.greatest(F.lit(0), F.col("media_sequence") - F.col("highest") - 1))


def islands(df: DataFrame, keys=tuple(TRACK), seq="seg_no", out="island") -> DataFrame:
    """Rows with the number of consecutive runs before theirs; rows must be unique by keys and seq."""
    w = Window.partitionBy(*keys).orderBy(seq)
    return df.withColumn(out, F.col(seq) - F.row_number().over(w))


def contiguous_run(df: DataFrame, keys=tuple(TRACK), seq="seg_no", anchor="live", later=("commit_ord",)) -> DataFrame:
    """The newest island (live) or the oldest (vod) of each key.

    A repeated number breaks no run: its later row stays, by those columns of `later` that df has.
    """
    w = Window.partitionBy(*keys).orderBy(seq, *(c for c in later if c in df.columns))
    df = df.withColumn("_next", F.lead(seq).over(w)).where(f"not (_next <=> {seq})").drop("_next")
    pick = F.max if anchor == "live" else F.min
    return islands(df, keys, seq, "_i").withColumn("_pick", pick("_i").over(Window.partitionBy(*keys))).where("_i = _pick").drop("_i", "_pick")


def number_across_periods(timeline: DataFrame, segs: DataFrame, keys=("channel_id", "rep_id"), period="period_id", order="period_ord", first="first_no", last="last_no", seq="seg_no") -> DataFrame:
    """msn = seg_no + offset; offsets put each period right after the one before it.

    timeline: keys, period, period_ord and the lifetime first and last number of each period.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    start = F.first(first).over(w) + F.coalesce(F.sum(F.col(last) - F.col(first) + 1).over(w.rowsBetween(*UP_TO_BEFORE)), F.lit(0))
    offsets = timeline.select(*keys, period, order, (start - F.col(first)).alias("_offset"))
    return segs.join(offsets, [*keys, period]).withColumn("msn", F.col(seq) + F.col("_offset")).drop("_offset")


def discontinuity_sequence(timeline: DataFrame, head: DataFrame, keys=("channel_id", "rep_id"), order="period_ord", first="first_no", marks="discontinuities", seq="seg_no") -> DataFrame:
    """Of a window's head: the periods before its own, and the marks of its period up to it, the
    period's first segment not counted. timeline holds the lifetime marks, so expiry changes nothing.
    head: keys, period_ord, seg_no of the window's first segment."""
    at = head.select(*keys, F.col(order).alias("_ho"), F.col(seq).alias("_hs"))
    inner = F.when(F.col(order) == F.col("_ho"), F.size(F.filter(marks, lambda n: (n > F.col(first)) & (n <= F.col("_hs")))))
    earlier = F.when(F.col(order) < F.col("_ho"), 1)
    # marks inside earlier periods count as well
    earlier_marks = F.when(F.col(order) < F.col("_ho"), F.size(F.filter(marks, lambda n: n > F.col(first))))
    return timeline.join(at, list(keys)).groupBy(*keys).agg((F.coalesce(F.sum(earlier), F.lit(0)) + F.coalesce(F.sum(earlier_marks), F.lit(0)) + F.coalesce(F.sum(inner), F.lit(0))).alias("discontinuity_sequence"))


def rle_timeline(df: DataFrame, keys=tuple(TRACK), seq="seg_no", start="start_pts", end="end_pts") -> DataFrame:
    """Entries t, d, r of consecutive rows of equal duration that abut; ord numbers them from 0."""
    w = Window.partitionBy(*keys).orderBy(seq)
    rows = df.select(*keys, seq, F.col(start).alias("t"), (F.col(end) - F.col(start)).alias("d"), F.col(end).alias("_end"))
    broken = F.coalesce((F.lag("d").over(w) != F.col("d")) | (F.lag("_end").over(w) != F.col("t")), F.lit(True))
    # one sort, no aggregation: of a run only its first and last row are kept, and the first looks at the next one kept
    closes = F.coalesce(F.lead("_b").over(w), F.lit(True))
    runs = rows.withColumn("_b", broken).withColumn("_c", closes).withColumn("_at", F.row_number().over(w)).withColumn("ord", F.sum(F.col("_b").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    ends = runs.where("_b or _c").withColumn("r", F.when(F.col("_c"), 0).otherwise(F.lead("_at").over(w) - F.col("_at")).cast("bigint"))
    return ends.where("_b").select(*keys, "ord", "t", "d", "r")


def layout_periods(periods: DataFrame, channel="channel_id", order="period_ord", origin="origin_start", span="span") -> DataFrame:
    """Start and end of each period on one line, none overlapping: with C the spans before,
    start = max(0, C + max over periods so far of (origin - C)). Null for channels of one period."""
    w = Window.partitionBy(channel).orderBy(order)
    rows = periods.withColumn("_c", F.coalesce(F.sum(span).over(w.rowsBetween(*UP_TO_BEFORE)), F.lit(0)))
    start = F.greatest(F.lit(0), F.col("_c") + F.max(F.col(origin) - F.col("_c")).over(w))
    many = F.count(F.lit(1)).over(Window.partitionBy(channel)) > 1
    return rows.withColumn("start", F.when(many, start)).withColumn("end", F.col("start") + F.col(span)).drop("_c")


def rebase_period(segs: DataFrame, offsets: DataFrame, keys=tuple(PERIOD)) -> DataFrame:
    """For each representation its exported presentation time offset; begin and end of its period.

    segs: keys, as_id, rep_id, start_pts, end_pts, timescale. offsets: keys, as_id, rep_id, source_offset_s.
    An offset below -0.5 ticks, no timescale or an end before its start is an error row.
    """
    rep = [*keys, "as_id", "rep_id"]
    rows = segs.join(offsets, rep, "left").withColumn("_o", F.coalesce("source_offset_s", F.lit(0.0)))
    ts = F.nullif(F.col("timescale"), F.lit(0))
    by_rep = rows.groupBy(*rep).agg(F.min(F.col("start_pts") / ts - F.col("_o")).alias("_b"), F.max(F.col("end_pts") / ts - F.col("_o")).alias("_e"), F.min("timescale").alias("timescale"), F.first("_o").alias("_o"), F.max((F.col("end_pts") < F.col("start_pts")) | (F.col("timescale") <= 0)).alias("_bad"))
    w = Window.partitionBy(*keys)
    pto = (F.col("_o") + F.col("begin_s")) * F.col("timescale")
    return (
        by_rep.withColumn("begin_s", F.min("_b").over(w)).withColumn("end_s", F.max("_e").over(w))
        .withColumn("error", F.when(F.col("_bad"), "invalid timing").when(pto < -0.5, "negative presentation time offset"))
        .withColumn("pto", F.when(F.col("error").isNull(), F.round(pto).cast("bigint"))).select(*rep, "begin_s", "end_s", "pto", "error")
    )


def compact_meta(meta: DataFrame, stored: DataFrame, keys=tuple(TRACK), seq="seg_no", order=("commit_ord",)) -> DataFrame:
    """The last record of each number that is still stored."""
    return dedup_last(meta, (*keys, seq), order).drop("replaced").join(stored.select(*keys, seq).distinct(), [*keys, seq], "left_semi")


def repair_meta(meta: DataFrame, index: DataFrame, files: DataFrame, keys=tuple(TRACK), seq="seg_no", fields=("start_pts", "end_pts")) -> tuple[DataFrame, DataFrame]:
    """(records, reports). An index record beats a sidecar record for each stored file; TS and VTT files
    with neither are reported once a directory (count, first number), fragmented MP4 never."""
    own, by_index = ([*keys, seq], index.select(*keys, seq, F.struct(*fields).alias("_i")))
    rows = files.join(by_index, own, "left").join(meta.select(*keys, seq, F.struct(*fields).alias("_m")), own, "left").withColumn("_r", F.coalesce("_i", "_m"))
    found = rows.where("_r is not null").select(*own, *(F.col("_r")[f].alias(f) for f in fields), F.when(F.col("_i").isNotNull(), "index").otherwise("sidecar").alias("origin"))
    lost = rows.where(F.col("_r").isNull() & F.lower("ext").isin("ts", "vtt")).groupBy(*keys).agg(F.count(F.lit(1)).alias("unknown"), F.min(seq).alias("first_no"))
    return found, lost


def rebuild_segments(files: DataFrame, boxes: DataFrame, meta: DataFrame, keys=tuple(TRACK), seq="seg_no") -> DataFrame:
    """The full history of stored files.

    files: keys, seq, ext, path. boxes: keys, seq, start_pts, timescale (of the representation's init).
    meta: keys, seq, start_pts, end_pts, timescale, discontinuity, key_uri. TS and VTT need a record;
    MP4 needs an init timescale, takes its start from its boxes and its end from the next start (T2), and
    its discontinuity and key from the sidecar. Files that fail are dropped.
    """
    own = [*keys, seq]
    m = dedup_last(meta, own, ("end_pts",)).drop("replaced") if "commit_ord" not in meta.columns else dedup_last(meta, own).drop("replaced", "commit_ord")
    flat = F.lower("ext").isin("ts", "vtt")
    by_record = files.where(flat).join(m, own).select(*own, "path", "start_pts", "end_pts", "timescale", "discontinuity", "key_uri")
    timed = files.where(~flat).join(boxes.where("timescale > 0").select(*own, "start_pts", "timescale"), own)
    by_boxes = derive_ends(timed, keys, seq).join(m.select(*own, "discontinuity", "key_uri"), own, "left")
    return by_record.unionByName(by_boxes.select(*own, "path", "start_pts", "end_pts", "timescale", F.coalesce("discontinuity", F.lit(False)).alias("discontinuity"), "key_uri"))
