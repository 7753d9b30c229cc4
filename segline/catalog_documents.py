"""Registered queries whose input is documents, files or streams: bodies are made from the driver's tables in Spark,
and the SQL says from the same rows what must come out, without ever seeing a body."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segline.catalog import T, _reps, query, segs
from segline.functions import scalars as S
from segline.operators import discovery, manifest, playlist, render, timeline
from segline.plans.projections import rows
from segline.schema import TRACK
from segline.session import shared_folder as scratch
from segline.sources import segment_store, store


def text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def joined(df: DataFrame, keys: list[str], order: str, line: Column, head: str = "", sep: str = "\n") -> DataFrame:
    """keys and body: the lines of each key in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("_l")))), lambda x: x["_l"]), sep)
    return df.groupBy(*keys).agg(F.concat(F.lit(head), body).alias("body"))


# --- playlists --------------------------------------------------------------------------------------------


@query("p5_playlist_lines", """select doc_id, cast(2 * row_number() over (partition by doc_id order by line_no) - 1 as int) as line_no, 'a ' || cast(line_no as varchar) || '  b' as line from lin where doc_id % 5 <> 0 union all
select doc_id, cast(2 * row_number() over (partition by doc_id order by line_no) as int), '#X-' || tag from lin where doc_id % 5 <> 0 union all
select distinct doc_id, 0, '#EXTM3U' from lin where doc_id % 5 <> 0""", "lin")
def _(spark, sf):
    lines = joined(rows(spark, sf, "lin"), ["doc_id"], "line_no", text("\ta ", F.col("line_no"), "\t\tb  \r\n \r#X-", F.col("tag")))
    head = F.when(F.col("doc_id") % 5 != 0, "﻿#EXTM3U\r\n\r\n").otherwise("#EXTINF\n")
    return playlist.explode_playlist_lines(lines.withColumn("body", F.concat(head, "body")))[0]


@query("p5_rejected_documents", "select distinct doc_id, 'no #EXTM3U header' as reason from lin where doc_id % 5 = 0", "lin")
def _(spark, sf):
    lines = joined(rows(spark, sf, "lin"), ["doc_id"], "line_no", F.col("tag"))
    head = F.when(F.col("doc_id") % 5 != 0, "#EXTM3U\n").otherwise("x\n#EXTM3U\n")
    return playlist.explode_playlist_lines(lines.withColumn("body", F.concat(head, "body")))[1].select("doc_id", "reason")


def _media_bodies(spark, sf) -> DataFrame:
    """A playlist for each track: a key line at its first number and at each third, ranges on some numbers."""
    says = (F.row_number().over(Window.partitionBy(*TRACK).orderBy("seg_no")) == 1) | (F.col("seg_no") % 3 == 0)
    key = F.when(F.col("key_uri").isNull(), "#EXT-X-KEY:METHOD=NONE\n").otherwise(text('#EXT-X-KEY:METHOD=AES-128,URI="', F.col("key_uri"), '"', F.when(F.col("seg_no") % 2 == 0, text(",IV=0XAB", F.lpad(F.col("seg_no").cast("string"), 30, "0"))).otherwise(""), "\n"))
    span = F.when(F.col("seg_no") % 4 == 1, "#EXT-X-BYTERANGE:100\n").when(F.col("seg_no") % 4 == 2, text("#EXT-X-BYTERANGE:50@", F.col("seg_no") * 10, "\n")).otherwise("")
    line = F.concat(
        F.when(F.col("discontinuity"), "#EXT-X-DISCONTINUITY\n").otherwise(""), F.when(says, key).otherwise(""), span,
        text("#EXTINF:", F.format_string("%.2f", (F.col("end_pts") - F.col("start_pts")) / F.lit(90000.0)), ",n,", F.col("seg_no"), "\n../f", F.floor(F.col("seg_no") / 5), ".ts?x=", F.col("rep_id")),
    )
    d = segs(spark, sf, TRACK).withColumn("_line", line).withColumn("_first", F.min("seg_no").over(Window.partitionBy(*TRACK)))
    out = joined(d, [*TRACK, "_first"], "seg_no", F.col("_line"))
    doc = F.concat_ws("|", *TRACK)
    return out.select(doc.alias("doc_id"), text("https://o.example/live/", F.col("channel_id"), "/m.m3u8").alias("url"), text("#EXTM3U\n#EXT-X-TARGETDURATION:13\n#EXT-X-MEDIA-SEQUENCE:", F.col("_first"), "\n", F.col("body"), "\n#EXT-X-ENDLIST\n").alias("body"))


@query("p6_media_playlist", f"""--cte
o as (select *, concat_ws('|', {T}) as doc_id, row_number() over w as nth, min(seg_no) over (partition by {T}) as first_no, seg_no // 5 as f, case when seg_no % 4 = 1 then 100 when seg_no % 4 = 2 then 50 end as len, case when seg_no % 4 = 2 then seg_no * 10 end as off from d window w as (partition by {T} order by seg_no)),
 k as (select *, max(case when nth = 1 or seg_no % 3 = 0 then seg_no end) over (partition by doc_id order by seg_no rows between unbounded preceding and current row) as ks, count(off) over (partition by doc_id, f order by seg_no rows between unbounded preceding and current row) as anchor from o),
 b as (select *, coalesce(first_value(off) over v, 0) + coalesce(sum(len) over (partition by doc_id, f, anchor order by seg_no rows between unbounded preceding and 1 preceding), 0) as at from k window v as (partition by doc_id, f, anchor order by seg_no))
select b.doc_id, b.first_no + b.nth - 1 as seq, 'https://o.example/live/f' || cast(b.f as varchar) || '.ts?x=' || b.rep_id as uri, cast(printf('%.2f', (b.end_pts - b.start_pts) / 90000.0::double) as double) as duration_s, 'n,' || cast(b.seg_no as varchar) as title, b.discontinuity,
 x.key_uri as key_uri, case when x.key_uri is not null then case when x.seg_no % 2 = 0 then 'ab' || lpad(cast(x.seg_no as varchar), 30, '0') else lpad(lower(hex(b.first_no + b.nth - 1)), 32, '0') end end as iv, cast(b.len as bigint) as byte_length, case when b.len is not null then cast(b.at as bigint) end as byte_offset
from b join b x on x.doc_id = b.doc_id and x.seg_no = b.ks""", dedup=True)
def _(spark, sf):
    found = playlist.parse_media_playlist(playlist.explode_playlist_lines(_media_bodies(spark, sf))[0])
    return found.select("doc_id", "seq", "uri", "duration_s", "title", "discontinuity", "key_uri", "iv", "byte_length", "byte_offset")


@query("p7_playlist_header", f"select concat_ws('|', {T}) as doc_id, 13.0::double as target_s, min(seg_no) as media_sequence, true as end_list, count(*) as n_segments, min(seg_no) + count(*) - 1 as last_seq from d group by {T}", dedup=True)
def _(spark, sf):
    lines = playlist.explode_playlist_lines(_media_bodies(spark, sf))[0]
    return playlist.summarize_playlist(playlist.parse_media_playlist(lines), lines).select("doc_id", "target_s", "media_sequence", "end_list", "n_segments", "last_seq")


def _master_bodies(spark, sf) -> DataFrame:
    """A master for each brand: variants, audio with and without URI, subtitles; some without variants, some bare."""
    n = F.col("rep_id").cast("bigint")
    media = lambda kind: text('#EXT-X-MEDIA:TYPE=', kind, ',GROUP-ID="g', n % 3, '",NAME="a, b ', n, '",LANGUAGE="en",DEFAULT=', F.when(n % 2 == 0, "YES").otherwise("NO"))
    variant = text('#EXT-X-STREAM-INF:BANDWIDTH=', F.col("bandwidth"), ',CODECS="', F.col("codecs"), '",RESOLUTION=', n, "x", n + 1, ",FRAME-RATE=25.5\n# a comment\nv/", n, ".m3u8")
    line = F.when(n % 5 == 0, text(media("AUDIO"), ',URI="/a/', n, '.m3u8"')).when(n % 5 == 1, media("AUDIO")).when(n % 5 == 2, text(media("SUBTITLES"), ',URI="s', n, '"'))
    t = rows(spark, sf, "trk").withColumn("n", n).withColumn("line", line.otherwise(F.when(F.col("lang").endswith("2"), "#none").otherwise(variant)))
    t = t.withColumn("line", F.when(F.col("lang").endswith("1"), text("#EXTINF:1,\n", n)).otherwise(F.when(F.col("lang").endswith("2"), text("#EXT-X-STREAM-INF:BANDWIDTH=1\n", F.col("line"))).otherwise(F.col("line"))))
    return joined(t, ["lang"], "n", F.col("line"), "#EXTM3U\n").select(F.col("lang").alias("doc_id"), F.lit("https://o.example/x/m.m3u8").alias("url"), "body")


@query("p8_master_playlist", """--cte
t as (select *, cast(rep_id as bigint) as n, cast(rep_id as bigint) % 5 as k from trk where lang not like '%1'),
 a as (select lang, n, case when k > 2 then 'variant' when k = 0 then 'audio' else 'subtitle' end as kind, case when k > 2 then 'https://o.example/x/v/' || rep_id || '.m3u8' when k = 0 then 'https://o.example/a/' || rep_id || '.m3u8' else 'https://o.example/x/s' || rep_id end as uri,
  case when k > 2 then bandwidth else 0 end as bandwidth, case when k > 2 then codecs end as codecs, case when k > 2 then n end as width, case when k > 2 then 25.5::double end as frame_rate, case when k in (0, 2) then 'a, b ' || rep_id end as name, k in (0, 2) and n % 2 = 0 as is_default from t where k <> 1 and not (k > 2 and lang like '%2')
  union all select distinct lang, 0, 'variant', 'https://o.example/x/m.m3u8', 1000000, null, null, null::double, null, false from trk where lang like '%1')
select lang as doc_id, kind, left(kind, 1) || cast(row_number() over (partition by lang, kind order by n) - 1 as varchar) as rep_id, uri, bandwidth, codecs, cast(width as int) as width, frame_rate, name, is_default from a""", "trk")
def _(spark, sf):
    tracks, _none = playlist.parse_master_playlist(playlist.explode_playlist_lines(_master_bodies(spark, sf))[0])
    return tracks.select("doc_id", "kind", "rep_id", "uri", "bandwidth", "codecs", "width", "frame_rate", "name", "is_default")


@query("p8_rejected_masters", "select distinct lang as doc_id, 'no variants' as reason from trk where lang like '%2'", "trk")
def _(spark, sf):
    return playlist.parse_master_playlist(playlist.explode_playlist_lines(_master_bodies(spark, sf))[0])[1]


# --- manifests --------------------------------------------------------------------------------------------


def _manifest_bodies(spark, sf) -> DataFrame:
    """One manifest for each brand: a period, a set for each kind, its representations; set 1 is protected."""
    n = F.col("rep_id").cast("bigint")
    rep = text('<Representation id="', n, '" bandwidth="', F.col("bandwidth"), '" codecs="', F.col("codecs"), '"', F.when(n % 2 == 0, text("><SegmentTemplate", F.coalesce(text(' timescale="', F.col("rep_timescale"), '"'), F.lit("")), ' duration="', n % 7, '"/></Representation>')).otherwise("/>"))
    t = rows(spark, sf, "trk").withColumn("n", n).withColumn("k", n % 3)
    one = joined(t, ["lang", "k"], "n", rep, sep="")
    shield = text('<ContentProtection schemeIdUri="urn:mpeg:dash:mp4protection:2011" value="cenc" cenc:default_KID="', F.lpad(F.col("k").cast("string"), 8, "A"), '-0000-1111-2222-333344445555"/><ContentProtection schemeIdUri="urn:uuid:EDEF8BA9-79D6-4ACE-A3C8-27DCD51D21ED"/><ContentProtection schemeIdUri="urn:other"/>')
    whole = text('<AdaptationSet mimeType="', F.when(F.col("k") == 0, "video/mp4").when(F.col("k") == 1, "audio/mp4").otherwise("application/x"), '" lang="l', F.col("k"), '">', F.when(F.col("k") == 1, shield).otherwise(""), '<SegmentTemplate timescale="900" startNumber="4" media="$Number$.m4s"/>', F.col("body"), "</AdaptationSet>")
    head = text('<MPD xmlns:cenc="urn:mpeg:cenc:2013" type="', F.when(F.col("lang").endswith("1"), "dynamic").otherwise("static"), '" availabilityStartTime="2024-01-01T00:00:30Z" timeShiftBufferDepth="PT1M0.5S"><BaseURL>https://o.example/</BaseURL><Period id="p" start="PT10S">')
    return joined(one, ["lang"], "k", whole, sep="").select(F.col("lang").alias("channel_id"), F.concat(head, "body", F.lit("</Period></MPD>")).alias("body"))


_SETS = "r as (select *, cast(rep_id as bigint) as n, cast(rep_id as bigint) % 3 as k, lang as channel_id from trk), s as (select channel_id, k, cast(row_number() over (partition by channel_id order by k) - 1 as varchar) as as_id from (select distinct channel_id, k from r))"


@query("p1_manifest_rows", f"--cte\n{_SETS}" + """
select channel_id, 'p' as period_id, as_id, rep_id, case when channel_id like '%1' then 'dynamic' else 'static' end as presentation, 1704067230::bigint as ast, 60.5::double as depth_s, 10.0::double as period_start_s, case k when 0 then 'video' when 1 then 'audio' else 'unknown' end as media_type, 'l' || cast(k as varchar) as lang, k = 1 as protected, bandwidth, codecs, 'https://o.example/' as mpd_base,
 cast(row_number() over (partition by channel_id, as_id order by n) - 1 as int) as rep_pos from r join s using (channel_id, k)""", "trk")
def _(spark, sf):
    return manifest.explode_manifest(_manifest_bodies(spark, sf)).select(*TRACK, "presentation", "ast", "depth_s", "period_start_s", "media_type", "lang", "protected", "bandwidth", "codecs", "mpd_base", "rep_pos")


@query("p2_effective_addressing", f"--cte\n{_SETS}" + """
select channel_id, rep_id, 'template' as scheme, case when n % 2 = 0 and coalesce(rep_timescale, 0) <> 0 then rep_timescale::bigint else 900 end as timescale, case when n % 2 = 0 and n % 7 <> 0 then n % 7 end as d, case when n % 2 = 0 then 1 else 4 end::bigint as start_number, '$Number$.m4s' as media from r""", "trk")
def _(spark, sf):
    return manifest.effective_addressing(manifest.explode_manifest(_manifest_bodies(spark, sf))).select("channel_id", "rep_id", "scheme", "timescale", "d", "start_number", "media")


@query("p3_protection_rows", f"--cte\n{_SETS}" + """
select channel_id, as_id, cast(i as int) as cp_no, case i when 0 then 'cenc' when 1 then 'widevine' else 'unknown' end as system, case when i = 0 then 'aaaaaaa1000011112222333344445555' end as default_kid, case when i = 0 then 'cenc' end as value from s, range(3) g(i) where k = 1""", "trk")
def _(spark, sf):
    return manifest.explode_protection(manifest.explode_sets(_manifest_bodies(spark, sf))).select("channel_id", "as_id", "cp_no", "system", "default_kid", "value")


@query("p4_filtered_protection", f"--cte\n{_SETS}" + "\nselect channel_id, as_id, 2 as cp_no from s where k = 1 union all select channel_id, as_id, cast(i as int) from s, range(2) g(i) where k = 1 and channel_id like '%1'", "trk")
def _(spark, sf):
    found = manifest.explode_protection(manifest.explode_sets(_manifest_bodies(spark, sf)))
    return manifest.filter_protection(found.withColumn("wide", F.col("channel_id").endswith("1")), playready=False, widevine="wide").select("channel_id", "as_id", "cp_no")


@query("r5_manifests", f"""select {T}, 'static' as presentation, min(seg_no) as start_number, arg_min(start_pts, seg_no) as pto, 90000::bigint as timescale, count(*) as segments, cast(sum(end_pts - start_pts) as bigint) as ticks from d where status = 'published' group by {T}""", dedup=True)
def _(spark, sf):
    """Manifests are rendered from segments, parsed again and their timelines counted."""
    d = segs(spark, sf)
    base = d.select(*TRACK, "media_type").distinct().withColumns({"lang": F.lit(""), "bandwidth": F.lit(5).cast("bigint"), "codecs": F.lit("c"), "timescale": F.lit(0), "start_number": F.lit(0), "pto": F.lit(0), "timeline": F.lit(None).cast("string")})
    periods = timeline.order_periods(d).withColumn("start_s", F.col("period_ord").cast("double"))
    channels = d.select("channel_id").distinct().withColumns({"presentation": F.lit("static"), "update_s": F.lit(0.0), "depth_s": F.lit(0.0), "duration_s": F.lit(30.0), "static_ingesting": F.lit(False)})
    docs = render.render_manifests(render.manifest_timing(base, d), periods, channels)
    back = manifest.effective_addressing(manifest.explode_manifest(docs).withColumn("as_pos", F.col("as_id")))
    runs = back.select("channel_id", "period_id", "rep_id", "presentation", "start_number", "pto", "timescale", F.aggregate("timeline", F.lit(0).cast("bigint"), lambda a, x: a + x["r"] + 1).alias("segments"), F.aggregate("timeline", F.lit(0).cast("bigint"), lambda a, x: a + (x["r"] + 1) * x["d"]).alias("ticks"))
    return runs.join(base.select(*TRACK), ["channel_id", "period_id", "rep_id"]).select(*TRACK, "presentation", "start_number", "pto", "timescale", "segments", "ticks")


@query("r6_local_playlists", """--cte
c0 as (select * replace (case when key_uri like '%7' and cast(channel_id as bigint) % 3 <> 0 then null else key_uri end as key_uri), cast(period_id as bigint) as po from d where status = 'published'),
 c as (select * from c0 where channel_id not in (select channel_id from c0 where key_uri like '%7')),
 g as (select *, row_number() over w = 1 as head, coalesce(lag(period_id) over w <> period_id, false) as edge, lag(seg_no) over w + 1 <> seg_no as hole, coalesce(key_uri, '') as k, coalesce(lag(key_uri) over w, '') as lk from c window w as (partition by channel_id, rep_id order by po, seg_no)),
 l as (select *, concat_ws(chr(10), case when not head and (edge or hole or discontinuity) then '#EXT-X-DISCONTINUITY' end, case when k <> lk then case when k = '' then '#EXT-X-KEY:METHOD=NONE' else '#EXT-X-KEY:METHOD=AES-128,URI="keys/' || right(k, 1) || '.key",IV=0x' || repeat('41', 16) end end, '#EXTINF:' || printf('%.3f', (end_pts - start_pts) / 90000.0::double) || ',', period_id || '/' || cast(seg_no as varchar) || '.ts') as line from g)
select channel_id, rep_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || cast(cast(ceil(max((end_pts - start_pts) / 90000.0::double)) as bigint) as varchar) || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || cast(arg_min(seg_no, (po, seg_no)) as varchar) || chr(10) || string_agg(line, chr(10) order by po, seg_no) || chr(10) || '#EXT-X-ENDLIST' || chr(10) as body from l group by channel_id, rep_id""", dedup=True)
def _(spark, sf):
    lost = F.col("key_uri").endswith("7") & (F.col("channel_id").cast("bigint") % 3 != 0)
    d = segs(spark, sf).withColumn("key_uri", F.when(~F.coalesce(lost, F.lit(False)), F.col("key_uri")))
    d = d.withColumns({"period_ord": F.col("period_id").cast("bigint"), "path": text("/d/", F.col("period_id"), "/", F.col("seg_no"), ".ts"), "init_path": F.lit(None).cast("string"), "iv": F.lit(bytearray(b"A" * 16))})
    files = d.select("key_uri").where("key_uri is not null").distinct().withColumn("file", F.when(F.substring("key_uri", -1, 1) != "7", text("keys/", F.substring("key_uri", -1, 1), ".key")))
    good, bad = render.render_local(d, "/d", files)
    return good.join(bad.select("channel_id").distinct(), "channel_id", "left_anti")


@query("r6_local_errors", "select channel_id, rep_id, period_id, seg_no, 'missing key or invalid IV' as error from d where key_uri like '%7' and status = 'published'", dedup=True)
def _(spark, sf):
    d = segs(spark, sf).withColumns({"period_ord": F.col("period_id"), "path": F.lit("/d/1.ts"), "init_path": F.lit(None).cast("string"), "iv": F.lit(bytearray(b"A" * 16))})
    files = d.select("key_uri").where("key_uri is not null and key_uri not like '%7'").distinct().withColumn("file", F.lit("k"))
    return render.render_local(d, "/d", files)[1].withColumnRenamed("period_ord", "period_id")


# --- discovery, restarts, rebuilding ----------------------------------------------------------------------


@query("d3_by_list", """--cte
r as (select lang as channel_id, rep_id, cast(rep_id as bigint) as n from trk)
select channel_id, rep_id, case when n % 3 = 0 then 1 else n % 3 end + i as seg_no, 'm' || cast(i as varchar) as media, case when i % 2 = 0 then i * 100 end as first_byte, case when i % 2 = 0 then i * 100 + 99 end as last_byte from r, range(6) g(i) where i <= n % 6""", "trk")
def _(spark, sf):
    n = F.col("rep_id").cast("bigint")
    entry = lambda i: F.struct(text("m", i).alias("media"), F.when(i % 2 == 0, text(i * 100, "-", i * 100 + 99)).otherwise("x-y").alias("media_range"))
    t = _reps(spark, sf).withColumn("start_number", n % 3).withColumn("segment_urls", F.transform(F.sequence(F.lit(0).cast("bigint"), n % 6), entry))
    return discovery.enumerate_by_list(t).select("channel_id", "rep_id", "seg_no", "media", F.col("media_range.first").alias("first_byte"), F.col("media_range.last").alias("last_byte"))


def _sidx(spark, sf) -> DataFrame:
    """A whole index box for each track: version by its number, references of n bytes each, each third nested."""
    n = F.col("rep_id").cast("bigint")
    u = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    refs = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n % 4), lambda i: F.concat(F.when(i % 3 == 2, u(n + i + (1 << 31), 8)).otherwise(u(n + i, 8)), u(i * 10 + 5, 8), F.lit("90000000"))), "")
    body = F.concat(F.lit("73696478"), F.when(n % 2 == 0, "00000000").otherwise("01000000"), F.lit("00000001"), u(n + 7, 8), F.when(n % 2 == 0, text("00000000", u(n % 9, 8))).otherwise(text("0" * 16, u(n % 9, 16))), F.lit("0000"), u(n % 4 + 1, 4), refs)
    return _reps(spark, sf).select(*TRACK, F.unhex(F.concat(u(F.length(body) / 2 + 4, 8), body)).alias("sidx"), (n + 100).alias("index_end"))


_SIDX = "x as (select lang as channel_id, rep_id, cast(rep_id as bigint) as n, i from trk, range(4) g(i) where i <= cast(rep_id as bigint) % 4), o as (select *, n + 100 + n % 9 + coalesce(sum(n + i) over (partition by rep_id order by i rows between unbounded preceding and 1 preceding), 0) as place from x)"


@query("s6_index_references", "--cte\n" + _SIDX + """
select channel_id, rep_id, i as ref_no, cast(place as bigint) as "offset", n + i as size, i * 10 + 5 as duration, n + 7 as timescale from o where i % 3 <> 2""", "trk")
def _(spark, sf):
    return store.explode_sidx(_sidx(spark, sf)).select("channel_id", "rep_id", "ref_no", "offset", "size", "duration", "timescale")


@query("d6_by_index", "--cte\n" + _SIDX + """
select channel_id, rep_id, row_number() over (partition by rep_id order by i) as seg_no, cast(place as bigint) as "offset" from o where i % 3 <> 2 and n % 5 <> 0""", "trk")
def _(spark, sf):
    t = _reps(spark, sf).select(*TRACK, F.when(F.col("n") % 5 != 0, "0-99").alias("index_range"))
    return discovery.enumerate_by_index(t, store.explode_sidx(_sidx(spark, sf)))[0].select("channel_id", "rep_id", "seg_no", "offset")


@query("d6_without_index", "select lang as channel_id, rep_id, 'no index range' as warning from trk where cast(rep_id as bigint) % 5 = 0", "trk")
def _(spark, sf):
    t = _reps(spark, sf).select(*TRACK, F.when(F.col("n") % 5 != 0, "0-99").alias("index_range"))
    return discovery.enumerate_by_index(t, store.explode_sidx(_sidx(spark, sf)))[1].select("channel_id", "rep_id", "warning")


@query("t8_manifest_restarts", """--cte recursive
l as (select channel_id, poll_at, max(rep_id) as rep, max(last_seq) as top, min(event_id) % 13 <> 0 as dyn, min(event_id) // 900 as ast, row_number() over (partition by channel_id order by poll_at) as i from pol group by channel_id, poll_at),
 r as (select channel_id, poll_at, i, 0::bigint as generation, ast, map([rep], [top]) as held from l where i = 1
  union all select l.channel_id, l.poll_at, l.i, r.generation + n.hit, l.ast, case when n.hit = 1 then map([l.rep], [l.top]) else map_concat(r.held, map([l.rep], [greatest(l.top, coalesce(r.held[l.rep], l.top))])) end
   from r join l on l.channel_id = r.channel_id and l.i = r.i + 1, lateral (select case when l.dyn and (l.ast <> r.ast or l.top < coalesce(r.held[l.rep], l.top)) then 1 else 0 end as hit) n)
select channel_id, poll_at as fetched_at, generation, case when generation = 0 then 'p' else 'p.r' || cast(generation as varchar) end as gateway_period_id from r""", "pol")
def _(spark, sf):
    p = rows(spark, sf, "pol").groupBy("channel_id", "poll_at").agg(F.max("rep_id").alias("rep_id"), F.max("last_seq").alias("highest"), F.min("event_id").alias("e"))
    listed = p.select("channel_id", F.lit("p").alias("period_id"), "rep_id", F.col("poll_at").alias("fetched_at"), (F.col("e") % 13 != 0).alias("dynamic"), F.floor(F.col("e") / 900).alias("ast"), "highest")
    return timeline.detect_manifest_restarts(listed).select("channel_id", "fetched_at", "generation", "gateway_period_id")


@query("t18_rebuild_segments", f"""--cte
m as (select * from d where seg_no % 2 = 0),
 v as (select *, case when lead(seg_no) over w = seg_no + 1 then lead(start_pts) over w - start_pts end as step from d where media_type = 'video' window w as (partition by {T} order by seg_no)),
 g as (select *, last_value(step ignore nulls) over (partition by {T} order by seg_no rows between unbounded preceding and 1 preceding) as held from v)
select {T}, seg_no, start_pts, end_pts, discontinuity, key_uri from m where media_type = 'audio' union all
select {T}, g.seg_no, g.start_pts, g.start_pts + coalesce(g.step, g.held, 0), coalesce(m.discontinuity, false), m.key_uri from g left join m using ({T}, seg_no)""", dedup=True)
def _(spark, sf):
    d = segs(spark, sf)
    files = d.select(*TRACK, "seg_no", F.when(F.col("media_type") == "video", "m4s").otherwise("TS").alias("ext"), F.lit("x").alias("path"))
    meta = d.where("seg_no % 2 = 0").select(*TRACK, "seg_no", "start_pts", "end_pts", "timescale", "discontinuity", "key_uri", "commit_ord")
    out = timeline.rebuild_segments(files, d.select(*TRACK, "seg_no", "start_pts", "timescale"), meta)
    return out.select(*TRACK, "seg_no", "start_pts", "end_pts", "discontinuity", "key_uri")


# --- scalars ----------------------------------------------------------------------------------------------


@query("f2_iso_durations", """select page_id, case when page_id % 7 = 0 then 0 else case when page_id % 5 = 0 then -1 else 1 end * ((page_id % 3) * 86400000000 + (number % 24) * 3600000000 + page_id * 1500000 + 250000) end::bigint as micros from url""", "url")
def _(spark, sf):
    u = rows(spark, sf, "url")
    p, n = F.col("page_id"), F.col("number")
    seconds = text(F.floor(p * 3 / 2 + F.lit(0.25)).cast("bigint"), F.when(p % 2 == 0, ".25").otherwise(".75"))
    body = F.when(p % 7 == 0, text("P", p, "X")).otherwise(text(F.when(p % 5 == 0, "-").otherwise(""), "P", p % 3, "DT", n % 24, "H", seconds, "S"))
    return u.select("page_id", S.iso_duration(body).alias("micros"))


@query("f3_media_types", """select rep_id, case cast(rep_id as bigint) % 6 when 0 then 'text' when 1 then 'video' when 2 then 'audio' when 3 then 'text' else 'unknown' end as kind from trk""", "trk")
def _(spark, sf):
    n = F.col("rep_id").cast("bigint") % 6
    mime = F.when(n == 0, "video/mp4").when(n == 1, "video/mp4").when(n == 2, "audio/mp4").when(n == 3, "text/vtt").when(n == 4, "application/mp4")
    return rows(spark, sf, "trk").select("rep_id", S.media_type(mime, F.when(n == 0, "text").when(n == 2, "other")).alias("kind"))


@query("f6_attribute_lists", """select rep_id, cast(bandwidth as varchar) as bandwidth, codecs, 'x=' || rep_id || ', y' as name, rep_id as last, 4::int as n from trk""", "trk")
def _(spark, sf):
    line = text("#EXT-X-STREAM-INF:BANDWIDTH=", F.col("bandwidth"), ',CODECS="', F.col("codecs"), '",A=1, NAME="x=', F.col("rep_id"), ', y",A=', F.col("rep_id"))
    t = rows(spark, sf, "trk").select("rep_id", S.attributes(line).alias("m"))
    return t.select("rep_id", F.col("m.BANDWIDTH").alias("bandwidth"), F.col("m.CODECS").alias("codecs"), F.col("m.NAME").alias("name"), F.col("m.A").alias("last"), F.size("m").alias("n"))


@query("f7_byte_ranges", """select page_id, case when page_id % 3 <> 0 then number end as first_byte, case when page_id % 3 <> 0 then number + 9 end as last_byte, case when page_id % 4 <> 0 then number end as length, case when page_id % 4 = 2 then page_id end as start from url""", "url")
def _(spark, sf):
    p, n = F.col("page_id"), F.col("number")
    a = S.byte_range_dash(F.when(p % 3 == 0, text(n, "-")).otherwise(text(n, "-", n + 9)))
    b = S.byte_range_at(F.when(p % 4 == 0, text("@", n)).when(p % 4 == 2, text('"', n, "@", p, '"')).otherwise(text(n)))
    return rows(spark, sf, "url").select("page_id", a["first"].alias("first_byte"), a["last"].alias("last_byte"), b["length"].alias("length"), b["offset"].alias("start"))


@query("f8_resolved_uris", """select page_id, case page_id % 4 when 0 then 'https://h.example/a/k' || number || '?q' when 1 then 'https://h.example/k' || number when 2 then 'http://z.example/k' || number else 'https://h.example/a/b/c' || number || '/k' end as uri from url""", "url")
def _(spark, sf):
    p, n = F.col("page_id"), F.col("number")
    ref = F.when(p % 4 == 0, text("../k", n, "?q")).when(p % 4 == 1, text("/k", n)).when(p % 4 == 2, text("http://z.example/k", n)).otherwise(text("./c", n, "/x/../k"))
    return rows(spark, sf, "url").select("page_id", S.resolve_uri(F.lit("https://h.example/a/b/list.m3u8?t=1"), ref).alias("uri"))


@query("f9_drm_systems", "select page_id, case page_id % 5 when 0 then 'playready' when 1 then 'widevine' when 2 then 'cenc' when 3 then 'playready' else 'unknown' end as system from url", "url")
def _(spark, sf):
    p = F.col("page_id") % 5
    uri = F.when(p == 0, "urn:uuid:9A04F079-9840-4286-AB92-E65BE0885F95").when(p == 1, "URN:UUID:edef8ba9-79d6-4ace-a3c8-27dcd51d21ed").when(p == 2, "urn:mpeg:dash:mp4protection:2011").when(p == 3, "urn:microsoft:PlayReady").otherwise(F.col("url"))
    return rows(spark, sf, "url").select("page_id", S.drm_system(uri).alias("system"))


@query("f10_license_urls", "select page_id, case when page_id % 3 = 0 then '<W><NO>' || url || '</NO></W>' else '<W><LA_URL>https://l.example/' || number || '</LA_URL><LA_URL>' || url || '</LA_URL></W>' end as header from url", "url")
def _(spark, sf):
    body = F.when(F.col("page_id") % 3 == 0, text("<W><NO>", F.col("url"), "</NO></W>")).otherwise(text("<W><LA_URL>", F.col("url"), "?a=é</LA_URL><LA_URL>", F.col("url"), "</LA_URL></W>"))
    out = S.rewrite_license_url(F.base64(F.encode(body, "UTF-16LE")), text("https://l.example/", F.col("number")))
    return rows(spark, sf, "url").select("page_id", F.decode(F.unbase64(out), "UTF-16LE").alias("header"))


@query("f17_validated_content", """select page_id, page_id % 4 <> 0 and page_id % 6 <> 5 as ts, page_id % 4 <> 0 as vtt, page_id % 16 = 0 and page_id > 0 as encrypted from url""", "url")
def _(spark, sf):
    p = F.col("page_id")
    packet = F.repeat(F.lit("00"), 187)
    ts = F.unhex(F.concat(F.repeat(F.concat(F.lit("47"), packet), (p % 5 + 3).cast("int")), F.when(p % 4 == 0, "47").otherwise("")))
    ts = F.when(p % 6 == 5, F.unhex(F.concat(F.lit("47"), packet, F.lit("48"), packet))).otherwise(ts)
    vtt = F.concat(F.when(p % 4 == 1, "﻿").otherwise(""), F.when(p % 4 == 0, " WEBVTT").otherwise("WEBVTT x")).cast("binary")
    return rows(spark, sf, "url").select("page_id", S.valid_ts(ts).alias("ts"), S.valid_vtt(vtt).alias("vtt"), S.valid_encrypted(F.repeat(F.lit("x"), p.cast("int")).cast("binary")).alias("encrypted"))


@query("f18_decrypted_segments", """select doc_id, line_no, case when line_no % 3 = 1 then null else text end as plain, case when line_no % 3 = 1 then 'key is not 16 bytes' end as reason from lin""", "lin")
def _(spark, sf):
    key, iv = text("k", F.lpad(F.col("line_no").cast("string"), 15, "0")).cast("binary"), F.unhex(F.lpad(F.hex(F.col("doc_id")), 32, "0"))
    sealed = F.aes_encrypt(F.col("text").cast("binary"), key, F.lit("CBC"), F.lit("DEFAULT"), iv)
    body = F.substring(sealed, F.lit(17), F.octet_length(sealed))
    out = S.decrypt_segment(body, F.when(F.col("line_no") % 3 == 1, F.lit(bytearray(15))).otherwise(key), iv)
    return rows(spark, sf, "lin").select("doc_id", "line_no", out["plain"].cast("string").alias("plain"), out["reason"].alias("reason"))


@query("f19_config_errors", """--cte
c as (select rep_id, cast(rep_id as bigint) as n from trk)
select rep_id, array_to_string(list_sort([x for x in [case when n % 7 = 1 then 'unknown source type' end, case when n % 11 = 2 then 'unknown key mode' end, case when n % 5 = 0 then 'source URL is not http or https' end, case when n % 5 = 1 then 'source URL has no host' end, case when n % 3 = 1 then 'content key is not 32 hex digits : 32 hex digits' end, case when n % 3 = 2 then 'key id is given twice' end,
 case when n % 3 <> 0 and not (n % 7 <> 1 and n % 2 = 0 and n % 11 <> 2) then 'content keys need dash in decrypt mode' end, case when n % 3 = 0 and n % 7 <> 1 and n % 2 = 0 and n % 11 <> 2 then 'decrypt mode needs a content key' end] if x is not null]), '; ') as errors from c""", "trk")
def _(spark, sf):
    n = F.col("rep_id").cast("bigint")
    pair = lambda a: F.concat(F.repeat(F.lit(a), 32), F.lit(":"), F.repeat(F.lit("0"), 32))
    t = rows(spark, sf, "trk").withColumns({
        "source_type": F.when(n % 7 == 1, "ftp").when(n % 7 == 2, "").otherwise("DASH"), "key_mode": F.when(n % 11 == 2, "x").when(n % 2 == 0, "Decrypt"), "url": F.when(n % 5 == 0, "ftp://x").when(n % 5 == 1, "https:///x").otherwise("HTTP://h"),
        "content_keys": F.when(n % 3 == 1, F.array(F.lit("ab"))).when(n % 3 == 2, F.array(pair("a"), pair("A"))),
    })
    return t.select("rep_id", F.array_join(S.config_errors(), "; ").alias("errors"))


@query("f20_relative_paths", "select page_id, case page_id % 4 when 0 then rep_id || '/' || number when 1 then null when 2 then null else number end as path from (select page_id, rep_id, cast(number as varchar) as number from url)", "url")
def _(spark, sf):
    p = F.col("page_id") % 4
    path = F.when(p == 2, text("/srv/../", F.col("number"))).otherwise(text("/srv/", F.col("rep_id"), "/", F.col("number")))
    return rows(spark, sf, "url").select("page_id", S.relative_path(path, F.when(p == 1, "/sr").when(p == 3, text("/srv/", F.col("rep_id"), "//")).otherwise("/srv/")).alias("path"))


# --- sources and sinks ------------------------------------------------------------------------------------


@query("s1_landed_logs", "select channel_id, rep_id, event_id as n, media_sequence, ok from (select *, row_number() over (order by event_id) as i from pol)", "pol")
def _(spark, sf):
    """Poll logs land as JSON lines, a torn one among every ten, and are read back."""
    p = rows(spark, sf, "pol").select("channel_id", "rep_id", "media_sequence", F.col("event_id").alias("last_seq"), "ok")
    whole = F.to_json(F.struct(*p.columns))
    path = scratch(spark, "polls")
    p.select(F.explode(F.when(F.col("last_seq") % 10 == 0, F.array(whole, F.substring(whole, 1, 12))).otherwise(F.array(whole))).alias("value")).write.text(path)
    return store.read_snapshots(spark, path, "polls").select("channel_id", "rep_id", F.col("last_seq").alias("n"), "media_sequence", "ok")


#: Files of a store, and stores that are gone through at the same time. A small store is removed before its files have
#: reached the disk, which was seen to take a fifth to a tenth of the time that removing older ones does.
STORED, STORES = 5_000, 3


#: Options of a scan: a representation has a file or two, so a group of periods is one task and is listed once.
ONE_TASK = {"groups": 16, "parts": 1}


def _through_store(spark, sf, scan) -> DataFrame:
    """What scan gives of a store with a file for each track, numbered by its segments: boxes of headers in front of 500 bytes
    a segment, every sixth without mdat and every fifth cut off; and an init file for each video representation.

    A file and its folders take some 18 KB of disk, many times the rows that it is made of, so channels go through the
    store in turns of about STORED files, STORES turns at a time: they are written, scanned, what was found is kept, and the files are removed."""
    made, dealt, found = (scratch(spark, k) for k in ("tracks", "turns", "found"))
    segs(spark, sf).groupBy(*TRACK, "media_type").agg(F.count(F.lit(1)).alias("n"), F.min("start_pts").alias("s")).write.parquet(made)
    tracks = spark.read.parquet(made)
    turns = max(1, math.ceil(tracks.count() / STORED))
    # a turn's tracks are files of their own, as many as shuffles have tasks
    tracks.withColumn("turn", F.pmod(F.xxhash64("channel_id"), F.lit(turns))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "channel_id").write.partitionBy("turn").parquet(dealt)

    def turn(k: int) -> str:
        root = scratch(spark, "store")
        mine = spark.read.schema(tracks.schema).parquet(dealt + f"/turn={k}")
        segment_store.write_segment_store(_files(mine), root)
        scan(root).write.parquet(out := f"{found}-{k}")
        segment_store.drop_channels(spark, root)
        return out

    held = [r["turn"] for r in spark.read.parquet(dealt).select("turn").distinct().collect()]
    with ThreadPoolExecutor(STORES) as pool:
        return spark.read.parquet(*pool.map(turn, sorted(held)))


def _files(t: DataFrame) -> DataFrame:
    """The store's files of tracks, their segments counted as n and the first starting at s."""
    u = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    n, long = F.col("n"), F.col("n") % 2 == 0
    tfdt = F.when(long, F.concat(F.lit("000000147466647401000000"), u(F.col("s"), 16))).otherwise(F.concat(F.lit("000000107466647400000000"), u(F.col("s"), 8)))
    moof = F.concat(F.when(long, "00000024").otherwise("00000020"), F.lit("6d6f6f66"), F.when(long, "0000001c").otherwise("00000018"), F.lit("74726166"), tfdt)
    mdat = F.when(n % 6 != 3, F.concat(F.when(n % 3 == 0, F.concat(F.lit("000000016d646174"), u(n * 500 + 16, 16))).otherwise(F.concat(u(n * 500 + 8, 8), F.lit("6d646174"))), F.repeat(F.lit("00"), (n * 500 - F.when(n % 5 == 4, 100).otherwise(0)).cast("int"))))
    moov = F.lit("00000034" + "6d6f6f76" + "0000002c" + "7472616b" + "00000024" + "6d646961" + "0000001c" + "6d646864" + "00" * 12 + "0001d4c0" + "00" * 4)
    media = t.select(*TRACK, "media_type", n.alias("seg_no"), F.when(long, "m4s").otherwise("mp4").alias("ext"), F.unhex(F.concat(F.lit("0000000866726565"), moof, F.coalesce(mdat, F.lit("")))).alias("content"))
    inits = t.where("media_type = 'video'").select(*TRACK, "media_type", F.lit(None).cast("bigint").alias("seg_no"), F.lit("mp4").alias("ext"), F.unhex(F.concat(F.lit("0000000866747970"), moov)).alias("content"))
    return media.unionByName(inits).withColumn("period_id", text("p/", F.col("period_id")))


_FILES = f"f as (select {T}, media_type, count(*) as n, min(start_pts) as s, count(*) * 500 as m from d group by all), z as (select *, 8 + case when n % 2 = 0 then 36 else 32 end + case when n % 6 = 3 then 0 else m + case when n % 3 = 0 then 16 else 8 end - case when n % 5 = 4 then 100 else 0 end end as size, n % 5 = 4 and n % 6 <> 3 as cut from f)"


@query("s2_stored_files", f"--cte\n{_FILES}\nselect channel_id, 'p/' || period_id as period_id, as_id, rep_id, media_type, n as seg_no, case when n % 2 = 0 then 'm4s' else 'mp4' end as ext, cast(size as bigint) as length from z", dedup=True)
def _(spark, sf):
    """Files are written to a store and its directories listed; nothing is opened."""
    return _through_store(spark, sf, lambda root: segment_store.scan_segment_store(spark, root, **ONE_TASK).select(*TRACK, "media_type", "seg_no", "ext", "length"))


@query("s2_chosen_files", f"--cte\n{_FILES}\nselect channel_id, 'p/' || period_id as period_id, as_id, rep_id, n as seg_no from z where period_id = '1995' and n >= 10", dedup=True)
def _(spark, sf):
    """Only the chosen period's directories are listed, and only the chosen numbers' files opened."""
    return _through_store(spark, sf, lambda root: segment_store.scan_segment_store(spark, root, **ONE_TASK, facts=True, periods=["p/1995"], numbers=(10, 1 << 62)).select(*TRACK, "seg_no"))


@query("s2_init_files", f"--cte\n{_FILES}\nselect channel_id, 'p/' || period_id as period_id, as_id, rep_id, true as has_moov, 120000::bigint as timescale, null::varchar as error from z where media_type = 'video'", dedup=True)
def _(spark, sf):
    return _through_store(spark, sf, lambda root: segment_store.scan_segment_store(spark, root, **ONE_TASK, facts=True, inits=True).select(*TRACK, "has_moov", "timescale", "error"))


@query("s5_stored_boxes", f"""--cte
{_FILES}
select channel_id, 'p/' || period_id as period_id, as_id, rep_id, n as seg_no, s as start_pts, case when cut then 'box mdat is cut off' when n % 6 = 3 then 'missing mdat box' end as error, n % 6 <> 3 and not cut as has_mdat, cast(least(size, 4096) as bigint) as bytes_read from z""", dedup=True)
def _(spark, sf):
    """Headers of stored files: one read of at most 4096 bytes, however much media follows."""
    return _through_store(spark, sf, lambda root: segment_store.scan_segment_store(spark, root, **ONE_TASK, facts=True).select(*TRACK, "seg_no", "start_pts", "error", "has_mdat", "bytes_read"))


@query("s2_stored_paths", f"select {T}, media_type, seg_no, case when seg_no % 2 = 0 then 'm4s' else 'ts' end as ext from d where seg_no % 5 <> 0", dedup=True)
def _(spark, sf):
    """The layout's columns from paths that are known already; files that are no segments are skipped."""
    d = segs(spark, sf)
    path = text("file:/x/data/", F.col("channel_id"), "/periods/", S.encode_id("period_id"), "/", F.col("media_type"), "_", F.col("as_id"), "/", S.encode_id("rep_id"), "/", F.col("seg_no"), F.when(F.col("seg_no") % 5 == 0, ".tmp").when(F.col("seg_no") % 2 == 0, ".m4s").otherwise(".ts"))
    return d.select(path.alias("path")).where(F.col("path").rlike(store._FILE)).select(*store.layout_columns(F.col("path"))).select(*TRACK, "media_type", "seg_no", "ext")


@query("s3_sidecars", "select seg_no as n, start_pts as s, end_pts as e, timescale as t, case when discontinuity then true end as dc, key_uri as k from d", dedup=True)
def _(spark, sf):
    d = segs(spark, sf)
    line = F.to_json(F.struct(F.col("seg_no").alias("n"), F.col("start_pts").alias("s"), F.col("end_pts").alias("e"), F.col("timescale").alias("t"), F.when(F.col("discontinuity"), True).alias("dc"), F.col("key_uri").alias("k")))
    path = scratch(spark, "sidecars")
    d.select(F.explode(F.array(line, F.lit('{"s":1}'), F.substring(line, 1, 9))).alias("value")).write.text(path)
    return store.read_sidecar(spark, path).select("n", "s", "e", "t", "dc", "k")


@query("s4_channel_table", """--cte
c as (select rep_id as channel_id, cast(rep_id as bigint) as n from trk)
select channel_id, case when n % 2 = 0 then 'hls' else 'dash' end as source_type, case when n % 3 = 0 then 'decrypt' when n % 5 = 0 then 'passthrough' else 'passthrough' end as key_mode, n % 4 <> 1 as keep_all, n % 4 = 2 as enabled, case when n % 3 = 0 and n % 5 = 0 then 'key_mode and hls_key_mode differ' end as error from c""", "trk")
def _(spark, sf):
    n = F.col("rep_id").cast("bigint")
    none, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    t = rows(spark, sf, "trk").select(
        F.col("rep_id").alias("channel_id"), F.when(n % 2 == 0, "hls").otherwise("").alias("source_type"), F.when(n % 3 == 0, "decrypt").alias("key_mode"), F.when(n % 5 == 0, "passthrough").alias("hls_key_mode"), none.alias("url"),
        F.when(n % 4 == 1, False).alias("keep_all"), F.when(n % 4 == 2, True).alias("enabled"), flag.alias("is_vod"), flag.alias("playready"), flag.alias("widevine"), F.lit(None).cast("array<string>").alias("content_keys"),
    )
    path = scratch(spark, "channels")
    t.write.json(path)
    return store.read_channels(spark, path).select("channel_id", "source_type", "key_mode", "keep_all", "enabled", "error")


@query("s5_box_facts", f"select {T}, seg_no, case when seg_no % 6 <> 4 then start_pts end as start_pts, case seg_no % 6 when 3 then 'missing mdat box' when 4 then 'missing moof box' end as error from d", dedup=True)
def _(spark, sf):
    """A small file for each segment, made of boxes; some lack one."""
    u = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    long = F.col("seg_no") % 2 == 0
    tfdt = F.when(long, F.concat(F.lit("000000147466647401000000"), u(F.col("start_pts"), 16))).otherwise(F.concat(F.lit("000000107466647400000000"), u(F.col("start_pts"), 8)))
    traf = F.concat(F.when(long, "0000001c").otherwise("00000018"), F.lit("74726166"), tfdt)
    moof = F.concat(F.when(long, "00000024").otherwise("00000020"), F.lit("6d6f6f66"), traf)
    data = F.concat(F.lit("0000000866726565"), F.when(F.col("seg_no") % 6 != 4, moof).otherwise(""), F.when(F.col("seg_no") % 6 != 3, "000000096d64617441").otherwise(""))
    return store.scan_boxes(segs(spark, sf).select(*TRACK, "seg_no", F.unhex(data).alias("content"))).select(*TRACK, "seg_no", "start_pts", "error")


@query("s7_written_segments", f"select {T}, seg_no, case when cast(period_id as bigint) % 2 = 0 then commit_ord else 0 end as commit_ord from d", dedup=True)
def _(spark, sf):
    """Written, then half of the periods written again: only their directories are replaced."""
    d, path = segs(spark, sf).select(*TRACK, "seg_no", "commit_ord"), scratch(spark, "segments")
    store.write_segments(d.withColumn("commit_ord", F.lit(0).cast("bigint")), path)
    store.write_segments(d.where("cast(period_id as bigint) % 2 = 0"), path)
    return spark.read.schema(d.schema).parquet(path).select(*d.columns)


@query("s8_written_documents", "select lang as channel_id, string_agg(rep_id, '/' order by cast(rep_id as bigint)) as body from trk group by lang", "trk")
def _(spark, sf):
    t, path = rows(spark, sf, "trk").withColumn("n", F.col("rep_id").cast("bigint")), scratch(spark, "documents")
    store.write_documents(joined(t, ["lang"], "n", F.col("rep_id"), sep="/").select(F.col("lang").alias("channel_id"), F.lit("m").alias("rep_id"), "body"), path)
    return spark.read.text(path).select("channel_id", F.col("value").alias("body"))
