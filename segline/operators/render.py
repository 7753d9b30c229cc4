"""Playlists and manifests as ordered string aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segline.functions.scalars import init_template, init_url, key_id, playlist_url, relative_path, segment_seconds, segment_template, segment_url
from segline.operators.timeline import rle_timeline
from segline.schema import TRACK


def _quoted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}="'), value, F.lit('"'))


def key_line(uri: Column, iv_hex: Column) -> Column:
    return F.concat(F.lit("#EXT-X-KEY:METHOD=AES-128,"), _quoted("URI", uri), F.lit(",IV=0x"), iv_hex)


def playlist_lines(run: DataFrame, keys=("channel_id", "rep_id"), order=("period_ord", "seg_no"), period="period_ord", seq="seg_no", disc="discontinuity", init="init_uri", key="key_line", duration="duration_s", uri="uri", digits: int = 6) -> DataFrame:
    """The lines of each segment, in order: keys, order columns, line_pos, line.

    A break before a segment at a period change, a skipped number or an origin mark, never before the
    first. The map at the first segment, a period change or a new init; it resets the key. The key when it
    changes, NONE when it stops. init and key lines may be null or empty. One window, one sort.
    """
    rows = segment_lines(run, keys, order, period, seq, disc, init, key, duration, uri, digits)
    return rows.select(*keys, *order, F.posexplode("lines").alias("line_pos", "line"))


def segment_lines(run: DataFrame, keys=("channel_id", "rep_id"), order=("period_ord", "seg_no"), period="period_ord", seq="seg_no", disc="discontinuity", init="init_uri", key="key_line", duration="duration_s", uri="uri", digits: int = 6) -> DataFrame:
    """The rows of run with `lines`, the array of each segment's lines, see playlist_lines."""
    w = Window.partitionBy(*keys).orderBy(*order)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = run.withColumn("_first", F.row_number().over(w) == 1).withColumn("_init", text(init)).withColumn("_key", text(key))
    boundary = ~F.col("_first") & (F.lag(period).over(w) != F.col(period))
    broken = ~F.col("_first") & (boundary | (F.lag(seq).over(w) + 1 != F.col(seq)) | F.coalesce(F.col(disc), F.lit(False)))
    # the init in force: an empty one never equals a later one
    mapped = (F.col("_init") != "") & (F.col("_first") | boundary | (F.lag("_init").over(w) != F.col("_init")))
    rows = rows.withColumn("_broken", broken).withColumn("_mapped", mapped).withColumn("_held", F.coalesce(F.lag("_key").over(w), F.lit("")))
    rows = rows.withColumn("_reset", F.col("_mapped") & (F.col("_held") != "")).withColumn("_held", F.when(F.col("_reset"), "").otherwise(F.col("_held")))
    stop = F.lit("#EXT-X-KEY:METHOD=NONE")
    lines = F.array_compact(F.array(
        F.when(F.col("_broken"), F.lit("#EXT-X-DISCONTINUITY")), F.when(F.col("_reset"), stop), F.when(F.col("_mapped"), F.concat(F.lit("#EXT-X-MAP:"), _quoted("URI", F.col("_init")))),
        F.when(F.col("_key") != F.col("_held"), F.when(F.col("_key") == "", stop).otherwise(F.col("_key"))), F.concat(F.lit("#EXTINF:"), F.format_string(f"%.{digits}f", F.col(duration)), F.lit(",")), F.col(uri),
    ))
    return rows.withColumn("lines", lines).drop("_first", "_init", "_key", "_broken", "_mapped", "_held", "_reset")


def ordered_text(lines: DataFrame, keys, order, line="line") -> DataFrame:
    """keys and body: lines joined in order. A document is bounded by its channel's window, not by the corpus."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: x[line]), "\n")
    return lines.groupBy(*keys).agg(body.alias("body"))


def _text_of(order) -> Column:
    """The lines of a group's segments in order, as an aggregate beside others, so that a playlist is made in one pass."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.when(F.size("lines") > 0, F.array_join("lines", "\n")).alias("_text")))), lambda x: x["_text"]), "\n").alias("body")


def render_media_playlists(run: DataFrame, heads: DataFrame | None, base: str = "", vod: bool = False, keys=("channel_id", "rep_id")) -> DataFrame:
    """R2: one playlist for each channel and representation: keys, body.

    run: as number_across_periods and a window leave it, with period_id, period_ord, path, init_path, key_uri,
    iv and media sequence msn. heads: keys, discontinuity_sequence, and optionally target (sticky); None: no sequence is told.
    """
    b = F.lit(base)
    ext = F.when(F.col("path").endswith(".ts"), ".ts").when(F.col("path").endswith(".vtt"), ".vtt").otherwise(".m4s")
    key = F.when(F.coalesce("key_uri", F.lit("")) != "", key_line(F.concat(F.rtrim(b, F.lit("/")), F.lit("/v1/channels/"), F.col("channel_id"), F.lit("/key/"), key_id("key_uri")), F.lower(F.hex("iv"))))
    rows = run.withColumn("duration_s", segment_seconds("start_pts", "end_pts", "timescale")).withColumn("uri", segment_url(b, "channel_id", "period_id", "rep_id", "seg_no", ext)).withColumn("key_line", key)
    rows = rows.withColumn("init_uri", F.when(F.coalesce("init_path", F.lit("")) != "", init_url(b, "channel_id", "period_id", "rep_id")))
    rows = segment_lines(rows, keys).select(*keys, "period_ord", "seg_no", "msn", "duration_s", F.col("init_uri").isNotNull().alias("_mp4"), "lines")
    facts = rows.groupBy(*keys).agg(F.max(F.when(F.col("_mp4"), 6).otherwise(3)).alias("_version"), F.ceil(F.max("duration_s")).cast("int").alias("_target"), F.min("msn").alias("_first"), _text_of(("period_ord", "seg_no")))
    facts = facts.join(heads, list(keys), "left") if heads is not None else facts.withColumn("discontinuity_sequence", F.lit(0))
    target = F.coalesce(F.col("target"), F.col("_target")) if heads is not None and "target" in heads.columns else F.col("_target")
    head = F.array_compact(F.array(
        F.lit("#EXTM3U"), F.concat(F.lit("#EXT-X-VERSION:"), F.col("_version").cast("string")), F.concat(F.lit("#EXT-X-TARGETDURATION:"), target.cast("string")), F.concat(F.lit("#EXT-X-MEDIA-SEQUENCE:"), F.col("_first").cast("string")),
        F.when(F.coalesce("discontinuity_sequence", F.lit(0)) > 0, F.concat(F.lit("#EXT-X-DISCONTINUITY-SEQUENCE:"), F.col("discontinuity_sequence").cast("string"))), F.lit("#EXT-X-PLAYLIST-TYPE:VOD") if vod else F.lit(None).cast("string"),
    ))
    return facts.select(*keys, F.concat(F.array_join(head, "\n"), F.lit("\n"), "body", F.lit("\n#EXT-X-ENDLIST\n" if vod else "\n")).alias("body"))


def render_master(tracks: DataFrame, base: str = "") -> DataFrame:
    """The master playlist of each channel: renditions, subtitles, then variants, each in document order."""
    b = F.lit(base)
    uri = playlist_url(b, "channel_id", "rep_id")
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    yes = F.coalesce("is_default", F.lit(False))
    media = lambda kind: F.concat(F.lit(f"#EXT-X-MEDIA:TYPE={kind},"), F.array_join(F.array_compact(F.array(_quoted("GROUP-ID", F.col("group_id")), _quoted("NAME", F.col("name")), F.when(has("lang"), _quoted("LANGUAGE", F.col("lang"))), F.when(yes, F.lit("DEFAULT=YES,AUTOSELECT=YES")), _quoted("URI", uri))), ","))
    attrs = F.array_join(F.array_compact(F.array(
        F.concat(F.lit("BANDWIDTH="), F.col("bandwidth").cast("string")), F.when(F.col("average_bandwidth") > 0, F.concat(F.lit("AVERAGE-BANDWIDTH="), F.col("average_bandwidth").cast("string"))), F.when((F.col("width") > 0) & (F.col("height") > 0), F.format_string("RESOLUTION=%dx%d", F.col("width"), F.col("height"))),
        F.when(F.col("frame_rate") > 0, F.format_string("FRAME-RATE=%.3f", F.col("frame_rate"))), F.when(has("codecs"), _quoted("CODECS", F.col("codecs"))), F.when(has("audio_group"), _quoted("AUDIO", F.col("audio_group"))), F.when(has("subtitle_group"), _quoted("SUBTITLES", F.col("subtitle_group"))),
    )), ",")
    kind = F.col("kind")
    line = F.when(kind == "audio", media("AUDIO")).when(kind == "subtitle", media("SUBTITLES")).otherwise(F.concat(F.lit("#EXT-X-STREAM-INF:"), attrs, F.lit("\n"), uri))
    rows = tracks.select("channel_id", F.when(kind == "audio", 0).when(kind == "subtitle", 1).otherwise(2).alias("_k"), "doc_pos", line.alias("line"))
    out = ordered_text(rows, ["channel_id"], ("_k", "doc_pos"))
    return out.select("channel_id", F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n"), "body", F.lit("\n")).alias("body"))


def manifest_timing(rows: DataFrame, segs: DataFrame) -> DataFrame:
    """Timing of each representation with published segments: template paths, start number, offset (first
    start) and run-length timeline. A set without any such representation thereby has no row. Without a status all
    segments count as published."""
    segs = segs.where("status = 'published'") if "status" in segs.columns else segs
    facts = segs.groupBy(*TRACK).agg(F.min("seg_no").alias("start_number"), F.min_by("start_pts", "seg_no").alias("pto"), F.min_by("timescale", "seg_no").alias("timescale"))
    runs = rle_timeline(segs).groupBy(*TRACK).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t", "d", "r"))), lambda x: F.struct(x["t"].alias("t"), x["d"].alias("d"), x["r"].alias("r"))).alias("timeline"))
    out = rows.drop("timescale", "start_number", "pto", "timeline").join(facts, TRACK).join(runs, TRACK)
    return out.withColumn("media", segment_template("channel_id", "period_id", "rep_id")).withColumn("init", init_template("channel_id", "period_id", "rep_id"))


def update_period(origin_s: Column, fallback_s: Column) -> Column:
    """The origin's update period, else the fallback, else 2 s."""
    return F.when(origin_s > 0, origin_s).when(fallback_s > 0, fallback_s).otherwise(F.lit(2.0))


def iso_text(seconds: Column) -> Column:
    """PTnS with at most 6 decimals, trailing zeros dropped."""
    s = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", seconds.cast("double")), "0+$", ""), r"\.$", "")
    return F.concat(F.lit("PT"), s, F.lit("S"))


def render_manifests(timing: DataFrame, periods: DataFrame, channels: DataFrame) -> DataFrame:
    """One manifest for each channel. timing: from manifest_timing with media_type, lang, bandwidth, codecs;
    periods: channel_id, period_id, period_ord, start_s; channels: channel_id, presentation, update_s, depth_s,
    duration_s, static_ingesting. A static channel that still ingests shows as dynamic with a day's depth."""
    live = (F.col("presentation") == "dynamic") | F.coalesce("static_ingesting", F.lit(False))
    entry = F.transform(F.col("timeline"), lambda x: F.struct(x["t"].alias("_t"), x["d"].alias("_d"), F.when(x["r"] > 0, x["r"]).alias("_r")))
    template = F.struct(F.col("timescale").alias("_timescale"), F.col("start_number").alias("_startNumber"), F.col("pto").alias("_presentationTimeOffset"), F.col("media").alias("_media"), F.col("init").alias("_initialization"), F.struct(entry.alias("S")).alias("SegmentTimeline"))
    reps = timing.select("channel_id", "period_id", "as_id", "media_type", "lang", F.struct(F.col("rep_id").alias("_id"), F.col("bandwidth").alias("_bandwidth"), F.col("codecs").alias("_codecs"), template.alias("SegmentTemplate")).alias("rep"))
    sets = reps.groupBy("channel_id", "period_id", "as_id").agg(F.first("media_type").alias("mt"), F.first("lang").alias("lang"), F.array_sort(F.collect_list("rep")).alias("reps"))
    one_set = F.struct(F.col("as_id").alias("_id"), F.col("mt").alias("_contentType"), F.when(F.col("lang") != "", F.col("lang")).alias("_lang"), F.col("reps").alias("Representation"))
    by_period = sets.groupBy("channel_id", "period_id").agg(F.array_sort(F.collect_list(F.struct(F.col("as_id").alias("o"), one_set.alias("x")))).alias("sets"))
    ps = by_period.join(periods, ["channel_id", "period_id"]).select("channel_id", "period_ord", F.struct(F.col("period_id").alias("_id"), F.when(F.col("start_s").isNotNull(), iso_text(F.col("start_s"))).alias("_start"), F.transform("sets", lambda x: x["x"]).alias("AdaptationSet")).alias("p"))
    docs = ps.groupBy("channel_id").agg(F.array_sort(F.collect_list(F.struct("period_ord", "p"))).alias("ps")).join(channels, "channel_id")
    mpd = F.struct(
        F.when(live, "dynamic").otherwise("static").alias("_type"), F.when(live, iso_text(update_period(F.col("update_s"), F.lit(0.0)))).alias("_minimumUpdatePeriod"), F.when(live, iso_text(F.when(F.coalesce("static_ingesting", F.lit(False)), F.lit(86400.0)).otherwise(F.col("depth_s")))).alias("_timeShiftBufferDepth"),
        F.when(~live, iso_text(F.col("duration_s"))).alias("_mediaPresentationDuration"), F.transform("ps", lambda x: x["p"]).alias("Period"),
    )
    return docs.select("channel_id", F.to_xml(mpd, {"rowTag": "MPD"}).alias("body"))


def render_local(segs: DataFrame, root: str | Column, key_files: DataFrame | None = None, keys=("channel_id", "rep_id")) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): file-relative playlists of all published segments, holes kept, 3 decimals.
    key_files: key_uri, file. A missing key file, an IV that is not 16 bytes or a path outside root is an
    error row, and its playlist is not written. Without a status all segments count as published."""
    segs = segs.where("status = 'published'") if "status" in segs.columns else segs
    root = F.lit(root) if isinstance(root, str) else root
    rows = segs if key_files is None else segs.join(key_files, "key_uri", "left")
    file = F.col("file") if key_files is not None else F.lit(None).cast("string")
    encrypted = F.coalesce("key_uri", F.lit("")) != ""
    rows = rows.withColumn("uri", relative_path("path", root)).withColumn("init_uri", F.when(F.coalesce("init_path", F.lit("")) != "", relative_path("init_path", root)))
    rows = rows.withColumn("key_line", F.when(encrypted, key_line(file, F.lower(F.hex("iv"))))).withColumn("duration_s", segment_seconds("start_pts", "end_pts", "timescale"))
    bad = F.when(F.col("uri").isNull(), "path outside the channel").when(encrypted & (file.isNull() | (F.octet_length("iv") != 16)), "missing key or invalid IV")
    rows = rows.withColumn("error", bad)
    errors = rows.where("error is not null").select(*keys, "period_ord", "seg_no", "error")
    good = rows.join(errors.select(*keys).distinct(), list(keys), "left_anti")
    rows = segment_lines(good, keys, digits=3).select(*keys, "period_ord", "seg_no", "duration_s", F.col("init_uri").isNotNull().alias("_mp4"), "lines")
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:"), F.max(F.when(F.col("_mp4"), 6).otherwise(3)).cast("string"), F.lit("\n#EXT-X-TARGETDURATION:"), F.ceil(F.max("duration_s")).cast("string"), F.lit("\n#EXT-X-PLAYLIST-TYPE:VOD\n#EXT-X-MEDIA-SEQUENCE:"), F.min_by("seg_no", F.struct("period_ord", "seg_no")).cast("string"), F.lit("\n"))
    made = rows.groupBy(*keys).agg(head.alias("_head"), _text_of(("period_ord", "seg_no")))
    return made.select(*keys, F.concat("_head", "body", F.lit("\n#EXT-X-ENDLIST\n")).alias("body")), errors
