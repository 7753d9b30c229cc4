"""Playlists as rows: lines, segments with carried state, headers, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segline.functions.scalars import attributes, byte_range_at, resolve_uri

#: Fixed value: the bandwidth of the one variant that a bare media playlist stands for.
BARE_BANDWIDTH = 1_000_000


def is_master(body: Column) -> Column:
    """A real stream-inf tag at the start of a line."""
    return body.rlike(r"(?m)^\s*#EXT-X-STREAM-INF:")


def explode_playlist_lines(df: DataFrame, doc="doc_id", body="body") -> tuple[DataFrame, DataFrame]:
    """P5: (lines, rejects). lines: doc, line_no from 0, line; trimmed, blank ones dropped. A document whose
    first line is not #EXTM3U goes to rejects. No shuffle, no UDF."""
    text = F.regexp_replace(F.regexp_replace(F.col(body), "\r\n?", "\n"), "^\\uFEFF", "")
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "\t", " "))), lambda x: x != "")
    docs = df.withColumn("_lines", kept)
    ok = F.coalesce(F.startswith(F.get("_lines", F.lit(0)), F.lit("#EXTM3U")), F.lit(False))
    lines = docs.where(ok).select(*(c for c in df.columns if c != body), F.posexplode("_lines").alias("line_no", "line"))
    return lines, docs.where(~ok).select(*df.columns, F.lit("no #EXTM3U header").alias("reason"))


def _tag(line: Column, name: str) -> Column:
    """The text after a tag's colon; null on other lines."""
    return F.when(line.startswith(f"#{name}:"), F.substring(line, F.lit(len(name) + 3), F.length(line)))


def parse_media_playlist(lines: DataFrame, doc="doc_id", url: str | None = "url") -> DataFrame:
    """One row for each accepted URI line: seq, uri, duration_s, title, key, map, one-shot tags, byte range.

    A URI counts if an EXTINF lies after the URI line before it. KEY and MAP hold until overridden
    (METHOD=NONE clears); discontinuity, program time and byte range belong to the next accepted URI only.
    A range without offset goes on from the one before it of the same URI; an explicit @0 counts as
    absent. Without IV, an encrypted segment's is its sequence number. All windows share one sort.
    """
    line = F.col("line")
    w = Window.partitionBy(doc).orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("_uri", ~line.startswith("#")).withColumn("_inf", _tag(line, "EXTINF"))
    rows = rows.withColumn("_last_uri", F.max(F.when(F.col("_uri"), F.col("line_no"))).over(before)).withColumn("_last_inf", F.max(F.when(F.col("_inf").isNotNull(), F.col("line_no"))).over(before))
    rows = rows.withColumn("_ok", F.col("_uri") & F.coalesce(F.col("_last_inf") > F.coalesce("_last_uri", F.lit(-1)), F.lit(False)))
    rows = rows.withColumn("_group", F.coalesce(F.sum(F.col("_ok").cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("_attrs", attributes(F.coalesce(_tag(line, "EXT-X-KEY"), _tag(line, "EXT-X-MAP"))))
    key, found_map = F.struct(F.col("_attrs")["METHOD"].alias("method"), F.col("_attrs")["URI"].alias("uri"), F.col("_attrs")["IV"].alias("iv")), F.struct(F.col("_attrs")["URI"].alias("uri"), F.col("_attrs")["BYTERANGE"].alias("range"))
    rows = rows.withColumn("_key", F.last(F.when(line.startswith("#EXT-X-KEY:"), key), ignorenulls=True).over(w))
    rows = rows.withColumn("_map", F.last(F.when(line.startswith("#EXT-X-MAP:"), found_map), ignorenulls=True).over(w))
    # what counts for one URI lies behind the accepted URI before it: a comparison of lines, not a window of its own
    rows = rows.withColumn("_since", F.coalesce(F.max(F.when(F.col("_ok"), F.col("line_no"))).over(before), F.lit(-1)))
    place = lambda x: F.last(F.when(x.isNotNull(), F.struct(F.col("line_no").alias("no"), x.alias("x"))), ignorenulls=True).over(w)
    one = lambda c: F.when(F.col(f"{c}.no") > F.col("_since"), F.col(f"{c}.x"))
    rows = (
        rows.withColumn("_inf", F.last("_inf", ignorenulls=True).over(w)).withColumn("_disc", F.max(F.when(line == "#EXT-X-DISCONTINUITY", F.col("line_no"))).over(w)).withColumn("_pdt", place(_tag(line, "EXT-X-PROGRAM-DATE-TIME")))
        .withColumn("_range", place(_tag(line, "EXT-X-BYTERANGE"))).withColumn("_seq0", F.first(_tag(line, "EXT-X-MEDIA-SEQUENCE").try_cast("bigint"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    rows = rows.where("_ok").withColumn("_disc", F.coalesce(F.col("_disc") > F.col("_since"), F.lit(False))).withColumn("_pdt", one("_pdt")).withColumn("_range", one("_range"))
    base = F.col(url) if url else F.lit(None).cast("string")
    segs = rows.where("_ok").select(
        doc, "line_no", (F.coalesce("_seq0", F.lit(0)) + F.col("_group")).alias("seq"), line.alias("uri"), base.alias("_base"),
        F.substring_index("_inf", ",", 1).try_cast("double").alias("duration_s"), F.when(F.instr("_inf", F.lit(",")) > 0, F.expr("substring(_inf, instr(_inf, ',') + 1)")).otherwise("").alias("title"),
        F.col("_disc").alias("discontinuity"), F.col("_pdt").try_cast("timestamp").alias("program_at"),
        F.when(F.col("_key.method") != "NONE", F.col("_key")).alias("_key"), F.col("_map"), byte_range_at("_range").alias("_range"),
    )
    order = Window.partitionBy(doc, "uri").orderBy("seq")
    # lengths before, less those before the latest explicit offset
    segs = segs.withColumn("_sum", F.coalesce(F.sum("_range.length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    segs = segs.withColumn("_anchor", F.last(F.when(F.col("_range.offset") > 0, F.struct(F.col("_range.offset").alias("at"), F.col("_sum").alias("sum"))), ignorenulls=True).over(order))
    offset = F.coalesce("_anchor.at", F.lit(0)) + F.col("_sum") - F.coalesce("_anchor.sum", F.lit(0))
    iv = F.coalesce(F.lower(F.regexp_replace("_key.iv", "^0[xX]", "")), F.lpad(F.lower(F.hex("seq")), 32, "0"))
    full = (lambda c: resolve_uri(F.col("_base"), c)) if url else (lambda c: c)
    return segs.withColumn("byte_offset", F.when(F.col("_range").isNotNull(), offset)).select(
        doc, "line_no", "seq", full(F.col("uri")).alias("uri"), "duration_s", "title", "discontinuity", "program_at",
        F.col("_key.method").alias("key_method"), full(F.col("_key.uri")).alias("key_uri"), F.when(F.col("_key").isNotNull(), iv).alias("iv"),
        full(F.col("_map.uri")).alias("map_uri"), F.col("_map.range").alias("map_range"), F.col("_range.length").alias("byte_length"), "byte_offset",
    )


def carry_tags(lines: DataFrame, doc="doc_id", order="line_no") -> DataFrame:
    """P6's rule on already tagged lines (KEY, INF, URI): accepted URIs, ordinal, the KEY and INF text in force."""
    w = Window.partitionBy(doc).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda t: F.max(F.when(F.col("tag") == t, F.col(order))).over(before)
    rows = lines.withColumn("_u", at("URI")).withColumn("_i", at("INF")).withColumn("key_text", F.last(F.when(F.col("tag") == "KEY", F.col("text")), ignorenulls=True).over(w))
    rows = rows.withColumn("inf_text", F.last(F.when(F.col("tag") == "INF", F.col("text")), ignorenulls=True).over(w))
    kept = rows.where("tag = 'URI' and _i > coalesce(_u, -1)")
    return kept.withColumn("seq", F.row_number().over(w) - 1).select(doc, order, "seq", "text", "key_text", "inf_text")


def summarize_playlist(segs: DataFrame, lines: DataFrame, doc="doc_id") -> DataFrame:
    """Target duration, media sequence, end mark, number of segments, last sequence and summed duration."""
    line = F.col("line")
    head = lines.groupBy(doc).agg(
        F.max(_tag(line, "EXT-X-TARGETDURATION").try_cast("double")).alias("target_s"), F.coalesce(F.max(_tag(line, "EXT-X-MEDIA-SEQUENCE").try_cast("bigint")), F.lit(0)).alias("media_sequence"), F.bool_or(line.startswith("#EXT-X-ENDLIST")).alias("end_list")
    )
    body = segs.groupBy(doc).agg(F.count(F.lit(1)).alias("n_segments"), F.max("seq").alias("last_seq"), F.sum("duration_s").alias("duration_s"))
    return head.join(body, doc, "left").na.fill({"n_segments": 0, "duration_s": 0.0})


def poll_deadline(at: Column, duration_s: Column) -> Column:
    """D8 for playlists: poll time plus all advertised durations."""
    return F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + (duration_s * 1_000_000).cast("bigint"))


def parse_master_playlist(lines: DataFrame, doc="doc_id", url: str | None = "url") -> tuple[DataFrame, DataFrame]:
    """(tracks, rejects). tracks: rep_id v0.., a0.., s0.. by kind in document order.

    A URI line completes the stream-inf before it; renditions without URI are skipped; a master without
    variants is a reject; a bare media playlist is one variant v0.
    """
    line = F.col("line")
    w = Window.partitionBy(doc).orderBy("line_no")
    base = F.col(url) if url else F.lit(None).cast("string")
    rows = lines.withColumn("_inf", attributes(_tag(line, "EXT-X-STREAM-INF"))).withColumn("_media", attributes(_tag(line, "EXT-X-MEDIA")))
    rows = rows.withColumn("_uri", ~line.startswith("#"))
    # the stream-inf in force at a URI: the latest since the URI before
    rows = rows.withColumn("_g", F.coalesce(F.sum(F.col("_uri").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pending = F.last("_inf", ignorenulls=True).over(Window.partitionBy(doc, "_g").orderBy("line_no"))
    rows = rows.withColumn("_pending", pending)
    size = lambda m, i: F.nullif(F.regexp_extract(m["RESOLUTION"], r"^(\d+)x(\d+)$", i), F.lit("")).try_cast("int")
    a = F.col("_pending")
    variants = rows.where(F.col("_uri") & a.isNotNull()).select(
        doc, "line_no", F.lit("variant").alias("kind"), base.alias("_base"), line.alias("uri"), F.coalesce(a["BANDWIDTH"].try_cast("bigint"), F.lit(0)).alias("bandwidth"), a["AVERAGE-BANDWIDTH"].try_cast("bigint").alias("average_bandwidth"),
        a["CODECS"].alias("codecs"), size(a, 1).alias("width"), size(a, 2).alias("height"), a["FRAME-RATE"].try_cast("double").alias("frame_rate"), a["AUDIO"].alias("audio_group"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("lang"), F.lit(False).alias("is_default"),
    )
    m = F.col("_media")
    renditions = rows.where(m["URI"].isNotNull() & m["TYPE"].isin("AUDIO", "SUBTITLES")).select(
        doc, "line_no", F.when(m["TYPE"] == "AUDIO", "audio").otherwise("subtitle").alias("kind"), base.alias("_base"), m["URI"].alias("uri"), F.lit(0).cast("bigint").alias("bandwidth"), F.lit(None).cast("bigint").alias("average_bandwidth"),
        F.lit(None).cast("string").alias("codecs"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("frame_rate"), m["GROUP-ID"].alias("audio_group"), m["NAME"].alias("name"), m["LANGUAGE"].alias("lang"), (m["DEFAULT"] == "YES").alias("is_default"),
    )
    kinds = lines.groupBy(doc).agg(F.bool_or(line.startswith("#EXT-X-STREAM-INF:")).alias("_master"), F.first(base).alias("_base"))
    bare = kinds.where("not _master").select(
        doc, F.lit(0).alias("line_no"), F.lit("variant").alias("kind"), "_base", F.coalesce("_base", F.lit("")).alias("uri"), F.lit(BARE_BANDWIDTH).cast("bigint").alias("bandwidth"), F.lit(None).cast("bigint").alias("average_bandwidth"),
        F.lit(None).cast("string").alias("codecs"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("frame_rate"), F.lit(None).cast("string").alias("audio_group"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("lang"), F.lit(False).alias("is_default"),
    )
    full = (lambda c: resolve_uri(F.col("_base"), c)) if url else (lambda c: c)
    tracks = variants.unionByName(renditions).unionByName(bare)
    mark = F.when(F.col("kind") == "variant", "v").when(F.col("kind") == "audio", "a").otherwise("s")
    nth = F.row_number().over(Window.partitionBy(doc, "kind").orderBy("line_no")) - 1
    tracks = tracks.withColumn("rep_id", F.concat(mark, nth.cast("string"))).withColumn("uri", full(F.col("uri"))).drop("_base")
    rejects = kinds.where("_master").join(variants.select(doc).distinct(), doc, "left_anti").select(doc, F.lit("no variants").alias("reason"))
    return tracks, rejects
