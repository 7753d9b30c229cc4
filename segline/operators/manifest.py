"""Manifests as rows: representations, effective addressing, protection, synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segline.functions.scalars import drm_system, iso_duration, media_type, split_codecs
from segline.schema import TRACK

_S = "array<struct<_t:bigint,_d:bigint,_r:bigint>>"
_TEMPLATE = f"struct<_timescale:bigint,_duration:bigint,_startNumber:bigint,_presentationTimeOffset:bigint,_media:string,_initialization:string,SegmentTimeline:struct<S:{_S}>>"
_INIT = "struct<_sourceURL:string,_range:string>"
_LIST = f"struct<_timescale:bigint,_duration:bigint,_startNumber:bigint,_presentationTimeOffset:bigint,Initialization:{_INIT},SegmentURL:array<struct<_media:string,_mediaRange:string>>>"
_BASE = f"struct<_timescale:bigint,_presentationTimeOffset:bigint,_indexRange:string,Initialization:{_INIT}>"
_PROTECTION = "array<struct<_schemeIdUri:string,_value:string,`_cenc:default_KID`:string,_default_KID:string,`cenc:pssh`:array<string>,pssh:array<string>,`mspr:pro`:array<string>,pro:array<string>>>"
_ADDRESS = f"BaseURL:array<string>,SegmentTemplate:{_TEMPLATE},SegmentList:{_LIST},SegmentBase:{_BASE}"
_REP = f"struct<_id:string,_bandwidth:bigint,_width:int,_height:int,_codecs:string,_frameRate:string,_audioSamplingRate:string,{_ADDRESS}>"
_SET = f"struct<_id:string,_contentType:string,_mimeType:string,_lang:string,ContentProtection:{_PROTECTION},{_ADDRESS},Representation:array<{_REP}>>"
MANIFEST = f"_type string, _availabilityStartTime string, _minimumUpdatePeriod string, _timeShiftBufferDepth string, _mediaPresentationDuration string, BaseURL array<string>, Period array<struct<_id:string,_start:string,_duration:string,BaseURL:array<string>,AdaptationSet:array<{_SET}>>>"


#: What is read of sets alone. A set's Representation is the last one: a list of them, which from_xml copies for each it adds, is not needed.
SETS = f"Period array<struct<_id:string,AdaptationSet:array<struct<ContentProtection:{_PROTECTION},Representation:struct<_id:string,_bandwidth:string>>>>>"


def parse_manifests(df: DataFrame, body="body") -> DataFrame:
    """The document as a nested struct `mpd`; malformed XML gives null. A built-in parser, no UDF."""
    return df.withColumn("mpd", F.from_xml(F.col(body), MANIFEST))


def explode_manifest(df: DataFrame, body="body") -> DataFrame:
    """One row for each period x adaptation set x representation, in document order (doc_pos per manifest).

    as_id is the set's position in its period; a presentation is dynamic only if it says so; the first
    BaseURL is primary and the others alternates; the mime type is the set's.
    """
    seconds = lambda c: iso_duration(c) / 1_000_000
    first, rest = (lambda a: F.get(a, F.lit(0))), (lambda a: F.when(F.size(a) > 1, F.slice(a, 2, 1 << 20)).otherwise(F.array().cast("array<string>")))
    rows = parse_manifests(df, body).where("mpd.Period is not null")
    rows = rows.select(*(c for c in df.columns if c != body), "mpd", F.posexplode("mpd.Period").alias("period_pos", "p"))
    rows = rows.select("*", F.posexplode("p.AdaptationSet").alias("as_pos", "a")).select("*", F.posexplode("a.Representation").alias("rep_pos", "r"))
    return rows.select(
        *(c for c in df.columns if c != body),
        F.when(F.col("mpd._type") == "dynamic", "dynamic").otherwise("static").alias("presentation"),
        F.unix_seconds(F.col("mpd._availabilityStartTime").try_cast("timestamp")).alias("ast"), seconds("mpd._minimumUpdatePeriod").alias("update_s"), seconds("mpd._timeShiftBufferDepth").alias("depth_s"), seconds("mpd._mediaPresentationDuration").alias("duration_s"),
        F.coalesce("p._id", F.lit("")).alias("period_id"), "period_pos", seconds("p._start").alias("period_start_s"), seconds("p._duration").alias("period_duration_s"),
        F.col("as_pos").cast("string").alias("as_id"), "as_pos", media_type("a._mimeType", "a._contentType").alias("media_type"), F.coalesce("a._lang", F.lit("")).alias("lang"), F.col("a._mimeType").alias("mime_type"),
        (F.coalesce(F.size("a.ContentProtection"), F.lit(0)) > 0).alias("protected"), F.col("a.ContentProtection").alias("protection"),
        F.coalesce("r._id", F.lit("")).alias("rep_id"), "rep_pos", (F.col("period_pos") * 1_000_000 + F.col("as_pos") * 1_000 + F.col("rep_pos")).cast("bigint").alias("doc_pos"),
        F.coalesce("r._bandwidth", F.lit(0)).alias("bandwidth"), F.col("r._width").alias("width"), F.col("r._height").alias("height"), F.col("r._codecs").alias("codecs"), F.col("r._frameRate").alias("frame_rate"),
        first(F.col("mpd.BaseURL")).alias("mpd_base"), first(F.col("p.BaseURL")).alias("period_base"), first(F.col("a.BaseURL")).alias("as_base"), first(F.col("r.BaseURL")).alias("rep_base"), rest(F.col("a.BaseURL")).alias("as_alts"), rest(F.col("r.BaseURL")).alias("rep_alts"),
        *(F.col(f"{x}.{n}").alias(f"{x}_{m}") for x in ("a", "r") for n, m in (("SegmentTemplate", "template"), ("SegmentList", "list"), ("SegmentBase", "base"))),
    )


def _absent_zero(*cols):
    """The first that is neither null, 0 nor empty."""
    return F.coalesce(*(F.when((c.cast("string") != "0") & (c.cast("string") != ""), c) for c in cols))


def effective_addressing(rows: DataFrame) -> DataFrame:
    """Scheme, timescale, d, start_number, pto, media, init, timeline, segment_urls, index_range of each row.

    A representation's value wins, zero or absent falls back to the set's; the offset falls back only when
    it is absent. An absent startNumber of a template is 1 at its own level, so it never falls back; one of 0 stays
    where the set has no template.
    """
    out = rows
    for kind in ("template", "list", "base"):
        r, a = F.col(f"r_{kind}"), F.col(f"a_{kind}")
        out = out.withColumn(f"_{kind}", F.when(r.isNotNull() | a.isNotNull(), F.lit(True)))
    g = lambda kind, f: (F.col(f"r_{kind}._{f}"), F.col(f"a_{kind}._{f}"))
    both = lambda kind, f: _absent_zero(*g(kind, f))
    own, sets = (F.coalesce(x, F.lit(1)) for x in g("template", "startNumber"))
    start = F.when(F.col("r_template").isNotNull(), F.when((own == 0) & F.col("a_template").isNotNull(), sets).otherwise(own)).when(F.col("a_template").isNotNull(), sets)
    entries = F.coalesce(*(F.when(F.size(F.col(f"{x}_template.SegmentTimeline.S")) > 0, F.col(f"{x}_template.SegmentTimeline.S")) for x in "ra"))
    urls = F.coalesce("r_list.SegmentURL", "a_list.SegmentURL")
    pick = lambda t, l, b: F.when(F.col("_template"), t).when(F.col("_list"), l).when(F.col("_base"), b)
    pto = lambda kind: F.coalesce(*g(kind, "presentationTimeOffset"), F.lit(0))
    return out.select(
        *rows.columns,
        pick(F.lit("template"), F.lit("list"), F.lit("base")).alias("scheme"),
        pick(both("template", "timescale"), both("list", "timescale"), both("base", "timescale")).alias("timescale"),
        pick(both("template", "duration"), F.coalesce(*g("list", "duration")), F.lit(None).cast("bigint")).alias("d"),
        pick(start, F.coalesce(*g("list", "startNumber"), F.lit(1)), F.lit(1).cast("bigint")).cast("bigint").alias("start_number"),
        pick(pto("template"), pto("list"), pto("base")).alias("pto"),
        both("template", "media").alias("media"), both("template", "initialization").alias("template_init"),
        F.coalesce("r_list.Initialization._sourceURL", "a_list.Initialization._sourceURL").alias("list_init"), F.coalesce("r_base.Initialization._sourceURL", "a_base.Initialization._sourceURL").alias("base_init"),
        F.transform(entries, lambda s: F.struct(F.coalesce(s["_t"], F.lit(0)).alias("t"), F.coalesce(s["_d"], F.lit(0)).alias("d"), F.coalesce(s["_r"], F.lit(0)).alias("r"))).alias("timeline"),
        F.transform(urls, lambda u: F.struct(u["_media"].alias("media"), u["_mediaRange"].alias("media_range"))).alias("segment_urls"),
        F.coalesce("r_base._indexRange", "a_base._indexRange").alias("index_range"),
    ).drop("_template", "_list", "_base")


def explode_sets(df: DataFrame, body="body") -> DataFrame:
    """P1 by sets: period_id, as_id, protected and protection of each adaptation set that has representations. A set is
    one row however many representations it has, so manifests of any size cost what their text costs."""
    rest = [c for c in df.columns if c != body]
    rows = df.select(*rest, F.posexplode(F.from_xml(F.col(body), SETS)["Period"]).alias("period_pos", "p"))
    rows = rows.select(*rest, "period_pos", F.coalesce("p._id", F.lit("")).alias("period_id"), F.posexplode("p.AdaptationSet").alias("as_pos", "a")).where("a.Representation is not null")
    return rows.select(*rest, "period_pos", "period_id", "as_pos", F.col("as_pos").cast("string").alias("as_id"), (F.coalesce(F.size("a.ContentProtection"), F.lit(0)) > 0).alias("protected"), F.col("a.ContentProtection").alias("protection"))


def explode_protection(rows: DataFrame, keys=("channel_id", "period_id", "as_id")) -> DataFrame:
    """One row for each ContentProtection of a set: system, scheme, value, default KID (32 hex), pssh, headers.
    rows: from explode_sets, or from explode_manifest, whose representations repeat their set's."""
    once = rows.where("protected").select(*keys, "protection").dropDuplicates(list(keys))
    x = F.col("cp")
    kid = F.lower(F.regexp_replace(F.coalesce(x["_cenc:default_KID"], x["_default_KID"]), "-", ""))
    none = F.array().cast("array<string>")
    return once.select(*keys, F.posexplode("protection").alias("cp_no", "cp")).select(
        *keys, "cp_no", drm_system(x["_schemeIdUri"]).alias("system"), x["_schemeIdUri"].alias("scheme_uri"), x["_value"].alias("value"), kid.alias("default_kid"),
        F.coalesce(x["cenc:pssh"], x["pssh"], none).alias("pssh"), F.coalesce(x["mspr:pro"], x["pro"], none).alias("headers"),
    )


def filter_protection(df: DataFrame, playready: bool | str = True, widevine: bool | str = True) -> DataFrame:
    """PlayReady and Widevine by flag (a value or a column), the common scheme while either is on, unknown always."""
    p, w = (F.lit(f) if isinstance(f, bool) else F.col(f) for f in (playready, widevine))
    s = F.col("system")
    return df.where(F.when(s == "playready", p).when(s == "widevine", w).when(s == "cenc", p | w).otherwise(F.lit(True)))


def synthesize_manifest_rows(variants: DataFrame, audio: DataFrame, segments: DataFrame) -> DataFrame:
    """Representation rows of a manifest that a playlist channel lacks: video set 0, audio set 1.

    variants, audio: channel_id, rep_id, codecs, bandwidth. A representation is in a period only with a
    timescale above 0 (that of its lowest number there). With audio of its own, codecs are split.
    """
    times = segments.groupBy("channel_id", "period_id", "rep_id").agg(F.min_by("timescale", "seg_no").alias("timescale")).where("timescale > 0")
    demuxed = audio.select("channel_id").distinct().withColumn("_demuxed", F.lit(True))
    found = variants.where("codecs is not null").groupBy("channel_id").agg(F.min_by(split_codecs("codecs", False), "rep_id").alias("_audio"))
    v = variants.join(demuxed, "channel_id", "left").select("channel_id", "rep_id", F.lit("0").alias("as_id"), F.lit("video").alias("media_type"), F.when(F.col("_demuxed"), split_codecs("codecs", True)).otherwise(F.col("codecs")).alias("codecs"), "bandwidth")
    a = audio.join(found, "channel_id", "left").select("channel_id", "rep_id", F.lit("1").alias("as_id"), F.lit("audio").alias("media_type"), F.coalesce("codecs", "_audio", F.lit("mp4a.40.2")).alias("codecs"), "bandwidth")
    return v.unionByName(a).join(times, ["channel_id", "rep_id"]).select(*TRACK, "media_type", "codecs", "bandwidth", "timescale")
