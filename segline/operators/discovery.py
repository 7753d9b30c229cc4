"""Which segments should exist: enumeration by duration, timeline, list and index, and what of it to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segline.functions.scalars import byte_range_dash, expand_template, join_base
from segline.schema import SET, TRACK

#: Most segments of a representation in one pass, and the live window where none is given.
CAP, DEFAULT_DEPTH_S = 100_000, 30.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def live_count(d, timescale, ast, start_s, depth_s, as_of) -> Column:
    """Segments that a live window can list at as_of: at least 1, at most ceil(depth / d); 0 if d is 0.

    ast: availability start in epoch seconds (null: the period starts at 0); timescale 0 or null counts as 1.
    """
    ts = F.when(_c(timescale) > 0, _c(timescale)).otherwise(F.lit(1))
    seg = _c(d).cast("double") / ts
    begin = F.when(_c(ast).isNull(), F.lit(0.0)).otherwise(_c(ast).cast("double") + F.coalesce(_c(start_s), F.lit(0.0)))
    count = F.floor((_c(as_of) - begin) / seg).cast("bigint") + 1
    depth = F.when(_c(depth_s) > 0, _c(depth_s)).otherwise(F.lit(DEFAULT_DEPTH_S))
    bounded = F.least(count, F.ceil(depth / seg).cast("bigint"))
    return F.when(_c(d) > 0, F.when(_c(as_of) <= begin, F.lit(1).cast("bigint")).otherwise(bounded)).otherwise(F.lit(0).cast("bigint"))


def static_count(duration_s, d, timescale) -> Column:
    """ceil(floor(duration * timescale) / d); 0 where a part is missing."""
    known = (_c(duration_s) > 0) & (_c(d) > 0) & (_c(timescale) > 0)
    return F.when(known, F.ceil(F.floor(_c(duration_s) * _c(timescale)) / _c(d)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def enumerate_by_duration(reps: DataFrame, as_of: float | Column, cap: int = CAP) -> DataFrame:
    """seg_no of each representation, and truncated. Columns: presentation, period_duration_s, d,
    timescale, start_number, ast, period_start_s, depth_s. Bounds are clamped before rows are made."""
    now = F.lit(float(as_of)) if not isinstance(as_of, Column) else as_of
    n = F.when(F.col("presentation") == "dynamic", live_count("d", "timescale", "ast", "period_start_s", "depth_s", now)).otherwise(static_count("period_duration_s", "d", "timescale"))
    rows = reps.withColumn("_n", n).where("_n > 0").withColumn("truncated", F.col("_n") > cap)
    last = F.col("start_number") + F.least("_n", F.lit(cap)) - 1
    return rows.withColumn("seg_no", F.explode(F.sequence("start_number", last))).drop("_n")


def enumerate_by_timeline(reps: DataFrame, as_of: float | Column, keys=tuple(TRACK), cap: int = CAP) -> DataFrame:
    """seg_no, seg_time, seg_dur of run-length entries. timeline: array<struct<t,d,r>>.

    t anchors the first entry and where it is not 0; a negative r is the live count, and one without a count or
    duration ends the timeline. Numbers and times are running sums over a representation's entries, by windows
    that share one exchange on keys (made if the input lacks it); entries past the cap are cut.
    """
    now = F.lit(float(as_of)) if not isinstance(as_of, Column) else as_of
    e = lambda x: F.when(x["r"] < 0, live_count(x["d"], F.col("timescale"), F.col("ast"), F.col("period_start_s"), F.col("depth_s"), now)).otherwise(F.coalesce(x["r"], F.lit(0)).cast("bigint") + 1)
    entries = reps.select("*", F.posexplode("timeline").alias("_i", "_s")).drop("timeline")
    w = Window.partitionBy(*keys).orderBy("_i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = entries.withColumn("_n", e(F.col("_s")))
    dead = (F.col("_s.r") < 0) & ((F.col("_n") <= 0) | (F.coalesce("_s.d", F.lit(0)) <= 0))
    counted = counted.withColumn("_dead", F.max(F.coalesce(dead, F.lit(False))).over(w)).where("not _dead").drop("_dead")
    rows = counted.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = rows.withColumn("_set", ((F.col("_i") == 0) | (F.coalesce("_s.t", F.lit(0)) != 0)).cast("int")).withColumn("_a", F.sum("_set").over(w))
    a = Window.partitionBy(*keys, "_a").orderBy("_i")
    rows = rows.withColumn("_t", F.coalesce(F.first("_s.t").over(a), F.lit(0)) + F.coalesce(F.sum(F.col("_s.d") * F.col("_n")).over(a.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("truncated", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > cap).where(F.col("_first") < cap)
    many = F.least("_n", F.lit(cap) - F.col("_first"))
    out = rows.where(many > 0).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1)))
    return out.select(*(c for c in reps.columns if c != "timeline"), "truncated", (F.col("start_number") + F.col("_first") + F.col("_k")).alias("seg_no"), (F.col("_t") + F.col("_k") * F.col("_s.d")).alias("seg_time"), F.col("_s.d").alias("seg_dur"))


def enumerate_by_list(reps: DataFrame) -> DataFrame:
    """D3: seg_no = start number (default 1) + ordinal, with each entry's media and range.
    segment_urls: array<struct<media,media_range>>."""
    rows = reps.select("*", F.posexplode("segment_urls").alias("_i", "_u")).drop("segment_urls")
    start = F.when(F.col("start_number") > 0, F.col("start_number")).otherwise(F.lit(1).cast("bigint"))
    return rows.withColumn("seg_no", start + F.col("_i")).withColumn("media", F.col("_u.media")).withColumn("media_range", byte_range_dash("_u.media_range")).drop("_i", "_u")


def cap_enumeration(df: DataFrame, cap: int = CAP, keys=tuple(TRACK), seq="seg_no") -> DataFrame:
    """D5 on rows: at most cap numbers of each representation, and whether any were cut."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_n", F.row_number().over(w.orderBy(seq))).withColumn("truncated", F.count(F.lit(1)).over(w) > cap).where(F.col("_n") <= cap).drop("_n")


def enumerate_by_index(reps: DataFrame, sidx: DataFrame, keys=tuple(TRACK)) -> tuple[DataFrame, DataFrame]:
    """(segments numbered from 1, warnings). sidx: keys, ref_no, offset, size, duration. A representation
    without an index range is a warning."""
    has = F.col("index_range").isNotNull()
    w = Window.partitionBy(*keys).orderBy("ref_no")
    rows = reps.where(has).join(sidx, list(keys)).withColumn("seg_no", F.row_number().over(w).cast("bigint"))
    return rows, reps.where(~has).select(*keys, F.lit("no index range").alias("warning"))


def to_fetch(expected: DataFrame, high_water: DataFrame, stored: DataFrame, keys=tuple(TRACK), seq="seg_no") -> DataFrame:
    """Of a dynamic presentation, numbers above the last scheduled, stored or not, and holes: numbers up to the highest
    stored that are not stored. A static presentation lists everything. high_water: keys, last_scheduled, max_stored
    (null: none; a representation may be missing). Without a presentation column all are dynamic."""
    static = F.coalesce(F.col("presentation") == "static", F.lit(False)) if "presentation" in expected.columns else F.lit(False)
    rows = expected.join(high_water.select(*keys, F.coalesce("last_scheduled", F.lit(-1)).alias("_last"), F.coalesce("max_stored", F.lit(-1)).alias("_max")), list(keys), "left")
    wanted = rows.where(static | (F.col(seq) > F.coalesce("_last", F.lit(-1)))).drop("_last", "_max")
    low = rows.where(~static & (F.col(seq) <= F.coalesce("_last", F.lit(-1))) & (F.col(seq) <= F.coalesce("_max", F.lit(-1)))).drop("_last", "_max")
    held = stored.select(*keys, seq).distinct()
    return wanted.unionByName(low.join(held, [*keys, seq], "left_anti"))


def rank_tasks(df: DataFrame, channel="channel_id", seq="seg_no", poll_at="poll_at", depth="depth_s", dynamic="dynamic") -> DataFrame:
    """priority = number - least number of the channel; deadline = poll time + depth, none if static."""
    depth_s = F.when(F.col(depth) > 0, F.col(depth)).otherwise(F.lit(DEFAULT_DEPTH_S))
    due = F.timestamp_micros(F.unix_micros(F.col(poll_at).cast("timestamp")) + (depth_s * 1_000_000).cast("bigint"))
    lowest = df.groupBy(channel).agg(F.min(seq).alias("_lowest"))  # joined back: a channel may hold a third of all rows
    return df.join(lowest, channel).select(*df.columns, (F.col(seq) - F.col("_lowest")).alias("priority"), F.when(F.col(dynamic), due).alias("deadline"))


def segment_urls(df: DataFrame, bases=("mpd_base", "period_base", "as_base", "rep_base"), media="media", rep="rep_id", seq="seg_no", time="seg_time") -> DataFrame:
    """Url through the chain of bases, and fallbacks from the representation's alternates, else the set's."""
    chain = F.lit("")
    for b in bases[:-1]:
        chain = join_base(chain, b)
    path = expand_template(media, seq, time, rep)
    own = join_base(join_base(chain, bases[-1]), path)
    rep_alts, as_alts = F.coalesce("rep_alts", F.array().cast("array<string>")), F.coalesce("as_alts", F.array().cast("array<string>"))
    above = F.lit("")
    for b in bases[:2]:
        above = join_base(above, b)
    alts = F.when(F.size(rep_alts) > 0, F.transform(rep_alts, lambda a: join_base(join_base(chain, a), path))).otherwise(F.transform(as_alts, lambda a: join_base(join_base(above, a), path)))
    return df.withColumn("url", own).withColumn("fallbacks", alts)


def as_inits(reps: DataFrame, keys=tuple(SET)) -> DataFrame:
    """Every representation's init location of a set in document order; the first scheme that has one wins."""
    place = F.coalesce("template_init", "list_init", "base_init")
    return reps.withColumn("_p", place).where("_p is not null").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_pos", "rep_id", F.col("_p").alias("init")))), lambda x: F.struct(x["rep_id"].alias("rep_id"), x["init"].alias("init"))).alias("inits"))
