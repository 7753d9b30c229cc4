"""Publish rules and joins: interval overlap, the audio/video barrier, decoration, lookups, period descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segline.functions.scalars import pts_seconds
from segline.operators.timeline import origin_period
from segline.schema import PERIOD, SET


#: Lengths of a level are at most LEAST_S * STEP^level seconds.
LEAST_S, STEP, LEVELS = 1.0, 4, 12


def _level(start: Column, end: Column) -> Column:
    """The least level whose cells are as long as the span; the last one has no bound."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(end - start <= LEAST_S * STEP**k, F.lit(k)).otherwise(out)
    return out


def levels(df: DataFrame, span: tuple[str, str], side: Column | None = None) -> dict:
    """The levels that occur, LEVELS + 1 numbers at most, for each value of side."""
    out: dict = {}
    side = F.lit(0) if side is None else side
    for k, level in df.where(F.col(span[1]) > F.col(span[0])).select(side, _level(F.col(span[0]), F.col(span[1]))).distinct().collect():
        out.setdefault(k, []).append(level)
    return out


def overlap_join(left: DataFrame, right: DataFrame, on=tuple(PERIOD), tol: float = 0.5, bucket: float | None = None, left_span=("start_s", "end_s"), right_span=("r_start_s", "r_end_s"), known: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """Pairs whose overlap is at least tol of the shorter one; zero-length intervals match nothing.

    An equi-join on the keys and a cell of time, so a long period is many small keys; a pair is kept in the first cell
    that both touch, which makes a later distinct needless. With `bucket` (seconds) all cells are so long: for spans of
    about one length. Without, lengths may be mixed: a span lies in cells of its own level, which are as long as it is,
    and visits those of the higher levels that occur on the other side; a pair meets at the level of the longer one. So
    no span has more than two copies a level, however long others are. That the levels are known takes one pass more of
    either side, but with `known`: the levels of left and of right, or more than these, which costs copies only.
    """
    (a, b), (c, d) = left_span, right_span
    shorter = F.least(F.col(b) - F.col(a), F.col(d) - F.col(c))
    match = (shorter > 0) & (F.least(b, d) - F.greatest(a, c) >= tol * shorter) & (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    if bucket is not None:
        cut = lambda x: F.floor(F.col(x) / bucket).cast("bigint")
        one = left.where(F.col(b) > F.col(a)).withColumn("_b", F.explode(F.sequence(cut(a), cut(b))))
        two = right.where(F.col(d) > F.col(c)).withColumn("_b", F.explode(F.sequence(cut(c), cut(d))))
        return one.join(two, [*on, "_b"]).where((F.col("_b") == F.greatest(cut(a), cut(c))) & match).drop("_b")

    ours, theirs = known or (levels(df, span).get(0, []) for df, span in ((left, left_span), (right, right_span)))
    wide = F.element_at(F.array(*(F.lit(LEAST_S * STEP**k) for k in range(LEVELS)), F.lit(LEAST_S * STEP ** (LEVELS + 8))), F.col("_m") + 1)

    def dealt(df: DataFrame, span: tuple[str, str], own: str, cell: str, others: list[int]) -> DataFrame:
        s, e = map(F.col, span)
        every = F.explode(F.array(*(F.lit(k) for k in sorted({*ours, *theirs}))).cast("array<int>"))
        rows = df.where(e > s).withColumn(own, _level(s, e)).withColumn("_m", every)
        rows = rows.where((F.col("_m") == F.col(own)) | ((F.col("_m") > F.col(own)) & F.col("_m").isin(others)))
        return rows.withColumn(cell, F.floor(s / wide).cast("bigint")).withColumn("_b", F.explode(F.sequence(F.col(cell), F.floor(e / wide).cast("bigint"))))

    one, two = dealt(left, left_span, "_lo", "_lc", theirs), dealt(right, right_span, "_ro", "_rc", ours)
    met = one.join(two, [*on, "_m", "_b"]).where((F.col("_m") == F.greatest("_lo", "_ro")) & (F.col("_b") == F.greatest("_lc", "_rc")) & match)
    return met.drop("_m", "_b", "_lo", "_lc", "_ro", "_rc")


def publish_av_barrier(segs: DataFrame, sets: DataFrame | None = None, match: str = "first", bucket: float | None = 30.0) -> DataFrame:
    """The rows of segs that publish.

    A video number publishes when every audio set of its period has an overlapping segment; with it go, of
    each audio set, the lowest matching number (match="all": every one), in all representations. A period
    with one track type publishes all of it; text and unknown types never publish here. sets (channel,
    period, as_id, media_type) declares sets that gate even while empty.

    Spans meet in cells of a period and `bucket` seconds (None: one cell a period), each small enough for an
    array; a pair counts in the first cell that both touch. Windows over one sort give a cell's audio and a period's
    sets alike, and numbers of periods with one track type go with those that match, so segs is read twice: for the
    cells, and for the rows that publish. Sorts and joins go by a hash first, which compares faster than strings.
    """
    rows = segs.where(F.col("media_type").isin("video", "audio"))
    cut = (lambda x: F.floor(x / bucket).cast("bigint")) if bucket else (lambda x: F.lit(0).cast("bigint"))
    spans = rows.select(*PERIOD, "media_type", "as_id", "seg_no", pts_seconds("start_pts", "timescale").alias("s"), pts_seconds("end_pts", "timescale").alias("e"))
    spans = spans.withColumn("_p", F.xxhash64(*PERIOD)).withColumn("cell", F.explode_outer(F.sequence(cut(F.col("s")), F.greatest(cut(F.col("s")), cut(F.col("e"))))))
    if sets is not None:
        told = sets.groupBy(*PERIOD).agg(*(F.collect_set(F.when(F.col("media_type") == k, F.struct("as_id"))).alias(f"_told_{k}") for k in ("video", "audio")))
        spans = spans.join(told, PERIOD, "left")

    of_period, of_cell = Window.partitionBy("_p", *PERIOD), Window.partitionBy("_p", *PERIOD, "cell")
    none = F.array().cast("array<struct<as_id:string>>")
    own = lambda kind: F.collect_set(F.when(F.col("media_type") == kind, F.struct("as_id"))).over(of_period)
    count = lambda kind: F.size(F.array_union(own(kind), F.coalesce(f"_told_{kind}", none)) if sets is not None else own(kind))
    audio = F.collect_set(F.when(F.col("media_type") == "audio", F.struct("as_id", "seg_no", "s", "e")))
    cells = spans.withColumn("audio", audio.over(of_cell)).withColumns({"n_audio": count("audio"), "n_video": count("video")})

    def hits(a):
        shorter = F.least(F.col("e") - F.col("s"), a["e"] - a["s"])
        return (shorter > 0) & (F.least(F.col("e"), a["e"]) - F.greatest(F.col("s"), a["s"]) >= 0.5 * shorter) & (F.col("cell") == F.greatest(cut(F.col("s")), cut(a["s"])))

    # a number of a period with one track type stands for itself: it has no audio to find
    alone = (F.col("n_audio") == 0) | (F.col("n_video") == 0)
    met = cells.select(*PERIOD, "as_id", "seg_no", "n_audio", alone.alias("alone"), F.explode_outer(F.when(~alone & (F.col("media_type") == "video"), F.filter("audio", hits))).alias("a")).where("alone or a is not null")
    met = met.select(*PERIOD, "as_id", "seg_no", "n_audio", "alone", F.col("a.as_id").alias("a_as"), F.col("a.seg_no").alias("a_no"))
    met = met.groupBy(*PERIOD, "as_id", "seg_no", "n_audio", "alone", "a_as").agg(F.min("a_no").alias("a_no")) if match == "first" else met.distinct()
    matched = F.size(F.collect_set(F.struct("a_as")).over(Window.partitionBy(*PERIOD, "as_id", "seg_no")))
    full = met.withColumn("matched", matched).where("alone or matched = n_audio")
    both = F.array(F.struct("as_id", "seg_no"), F.when(~F.col("alone"), F.struct(F.col("a_as").alias("as_id"), F.col("a_no").alias("seg_no"))))
    key = lambda df: df.withColumn("_k", F.xxhash64(*SET, "seg_no"))
    numbers = key(full.select(*PERIOD, F.explode(both).alias("n")).where("n is not null").select(*PERIOD, "n.as_id", "n.seg_no").distinct())
    return key(rows).join(numbers, ["_k", *SET, "seg_no"], "left_semi").select(*segs.columns)


def publish_immediately(segs: DataFrame) -> DataFrame:
    """Independent tracks publish as they are stored."""
    return segs.withColumn("status", F.lit("published"))


def publish_policy(source_type) -> Column:
    """The policy that a channel's source type asks for."""
    s = F.col(source_type) if isinstance(source_type, str) else source_type
    return F.when(s == "hls", "immediate").otherwise("av_barrier")


def decorate_tracks(tracks: DataFrame, manifest_rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Index tracks with what the manifest (by channel, period, set, rep) or the playlist (by channel, rep;
    variant before rendition before subtitle) says; tracks they lack stay. bandwidth falls back to average."""
    about = ["bandwidth", "codecs", "lang", "width", "height"]
    m = manifest_rows.groupBy(*SET, "rep_id").agg(*(F.first(c, ignorenulls=True).alias(f"_m_{c}") for c in about))
    rank = F.when(F.col("kind") == "variant", 0).when(F.col("kind") == "rendition", 1).otherwise(2)
    v = variants.withColumn("bandwidth", F.coalesce(F.when(F.col("bandwidth") > 0, F.col("bandwidth")), F.col("average_bandwidth"))).groupBy("channel_id", "rep_id").agg(F.min_by(F.struct("kind", *about), rank).alias("_v"))
    out = tracks.join(m, [*SET, "rep_id"], "left").join(v, ["channel_id", "rep_id"], "left")
    return out.select(*tracks.columns, F.col("_v.kind").alias("kind"), *(F.coalesce(f"_m_{c}", f"_v.{c}").alias(c) for c in about))


def tracks_from_manifest(rows: DataFrame, channel="channel_id", rep="rep_id", pos="doc_pos") -> DataFrame:
    """Each representation once, as first listed: video as variants, audio as renditions of group `audio`,
    the first one default, named by language else id. A channel with a protected set has no tracks."""
    rest = [c for c in rows.columns if c not in (channel, rep)]
    once = rows.groupBy(channel, rep).agg(F.min_by(F.struct(*rest), F.struct(pos)).alias("_r"))
    once = once.select(channel, rep, *(F.col("_r")[c].alias(c) for c in rest))
    shut = rows.groupBy(channel).agg(F.bool_or("protected").alias("_p")).where("_p").select(channel)
    kept = once.where(F.col("media_type").isin("video", "audio")).join(shut, channel, "left_anti")
    w = Window.partitionBy(channel, "media_type").orderBy(pos)
    audio = F.col("media_type") == "audio"
    return kept.select(channel, rep, "media_type", pos, "codecs", "bandwidth", F.when(audio, "audio").alias("group_id"), F.when(audio, F.coalesce(F.when(F.col("lang") != "", F.col("lang")), F.col(rep))).alias("name"), (audio & (F.row_number().over(w) == 1)).alias("is_default"))


def lookup_segments(requests: DataFrame, segs: DataFrame) -> DataFrame:
    """(channel, period, rep, number) to the path of a published segment; null where there is none."""
    found = segs.where("status = 'published'").groupBy("channel_id", "period_id", "rep_id", "seg_no").agg(F.min_by("path", "as_id").alias("path"))
    return requests.join(found, ["channel_id", "period_id", "rep_id", "seg_no"], "left")


def lookup_inits(segs: DataFrame) -> DataFrame:
    """A representation's init: that of a published segment (lowest number), else of a committed one (highest)."""
    found = segs.groupBy("channel_id", "period_id", "rep_id").agg(
        F.min_by("init_path", F.when(F.col("status") == "published", F.col("seg_no"))).alias("_p"), F.max_by("init_path", F.when(F.col("status") == "committed", F.col("seg_no"))).alias("_c")
    )
    return found.select("channel_id", "period_id", "rep_id", F.coalesce("_p", "_c").alias("init_path"))


def describe_all_periods(final: DataFrame, saved: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(descriptions, warnings) of the final manifest's periods and of stored ones it lacks.

    final, saved: channel, period, body. A stored period is described by its own saved snapshot, else by the
    final period of the same origin id; else it is a warning.
    """
    lacking = stored.select(*PERIOD).distinct().join(final.select(*PERIOD), PERIOD, "left_anti")
    own = saved.select(*PERIOD, F.col("body").alias("_s"))
    kin = final.withColumn("_o", origin_period("period_id")).groupBy("channel_id", "_o").agg(F.min_by("body", "period_id").alias("_f"))
    rows = lacking.join(own, PERIOD, "left").withColumn("_o", origin_period("period_id")).join(kin, ["channel_id", "_o"], "left")
    known = rows.where("coalesce(_s, _f) is not null").select(*PERIOD, F.coalesce("_s", "_f").alias("body"), F.when(F.col("_s").isNotNull(), "saved").otherwise("same origin").alias("origin"))
    lost = rows.where("coalesce(_s, _f) is null").select(*PERIOD, F.lit("stored period is not described").alias("warning"))
    return final.select(*PERIOD, "body", F.lit("final").alias("origin")).unionByName(known), lost


def changed_period_snapshots(rows: DataFrame, keys=tuple(PERIOD), at="fetched_at", member=("as_id", "rep_id")) -> DataFrame:
    """The snapshots of a period whose list of sets and representations differs from the one saved before."""
    prints = rows.groupBy(*keys, at).agg(F.sort_array(F.collect_set(F.concat_ws("/", *member))).alias("contents"))
    before = F.lag("contents").over(Window.partitionBy(*keys).orderBy(at))
    return prints.withColumn("_b", before).where("_b is null or _b <> contents").drop("_b")


def export_scope(tracks: DataFrame, segs: DataFrame, keys=("channel_id", "rep_id")) -> DataFrame:
    """Known tracks with published segments; a variant's group that no exported track is in is cleared;
    bandwidth at least 1; files numbered by sorted rep id within channel and type."""
    kept = tracks.join(segs.where("status = 'published'").select(*keys).distinct(), list(keys), "left_semi")
    groups = kept.where("media_type = 'audio'").select("channel_id", F.col("group_id").alias("audio_group")).distinct().withColumn("_has", F.lit(True))
    w = Window.partitionBy("channel_id", "media_type").orderBy("rep_id")
    out = kept.join(groups, ["channel_id", "audio_group"], "left")
    return out.select(*(c for c in tracks.columns if c not in ("audio_group", "bandwidth")), F.when(F.col("_has"), F.col("audio_group")).alias("audio_group"), F.greatest(F.lit(1).cast("bigint"), F.coalesce("bandwidth", F.lit(0))).alias("bandwidth"), (F.row_number().over(w) - 1).alias("file_no"))
