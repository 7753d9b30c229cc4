"""Registered queries over whole documents: playlists, masters, health, warnings and offerings with all that they can hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from segline.catalog import LIFE, PAIRS, T, _ever, _timeline, query, segs
from segline.functions import scalars as S
from segline.operators import keys, metrics, playlist, publish, render, timeline
from segline.plans.projections import rows
from segline.schema import PERIOD, TRACK

#: Windows across periods: media sequence numbers, break and key lines, heads. The window is w; {} are its rows and its end.
_PLAYLIST = LIFE + """,
 w as (select * from msn where status = 'published' {window}),
 i as (select *, case when media_type = 'video' then 'http://g/v1/channels/' || channel_id || '/init/' || period_id || '/' || rep_id || '.mp4' else '' end as init,
  case when key_uri is null then '' else '#EXT-X-KEY:METHOD=AES-128,URI="http://g/v1/channels/' || channel_id || '/key/' || sha256(key_uri) || '",IV=0x' || repeat('41', 16) end as k from w),
 o as (select *, row_number() over v = 1 as head, coalesce(lag(period_ord) over v <> period_ord, false) as edge, coalesce(lag(seg_no) over v + 1 <> seg_no, false) as hole, coalesce(lag(init) over v, '') as li, coalesce(lag(k) over v, '') as lk from i window v as (partition by channel_id, rep_id order by period_ord, seg_no)),
 m as (select *, init <> '' and (head or edge or li <> init) as mapped from o),
 l as (select *, concat_ws(chr(10), case when not head and (edge or hole or discontinuity) then '#EXT-X-DISCONTINUITY' end, case when mapped and lk <> '' then '#EXT-X-KEY:METHOD=NONE' end, case when mapped then '#EXT-X-MAP:URI="' || init || '"' end,
  case when k <> case when mapped then '' else lk end then case when k = '' then '#EXT-X-KEY:METHOD=NONE' else k end end, '#EXTINF:' || printf('%.6f', (end_pts - start_pts) / 90000.0::double) || ',', 'http://g/v1/channels/' || channel_id || '/segments/' || period_id || '/' || rep_id || '/' || cast(seg_no as varchar) || case when media_type = 'video' then '.m4s' else '.ts' end) as line from m),
 hd as (select channel_id, rep_id, min(period_ord * 1000 + seg_no) as h from w group by all),
 ds as (select channel_id, rep_id, (select count(distinct m.period_ord) from msn m where m.channel_id = hd.channel_id and m.rep_id = hd.rep_id and m.period_ord < hd.h // 1000)
   + (select count(distinct m.period_ord * 1000 + m.seg_no) from msn m where m.channel_id = hd.channel_id and m.rep_id = hd.rep_id and m.discontinuity and m.seg_no <> m.first_no and m.period_ord * 1000 + m.seg_no <= hd.h) as n from hd)
select channel_id, rep_id, concat_ws(chr(10), '#EXTM3U', '#EXT-X-VERSION:' || case when max(init) <> '' then '6' else '3' end, '#EXT-X-TARGETDURATION:' || cast(cast(ceil(max((end_pts - start_pts) / 90000.0::double)) as bigint) as varchar), '#EXT-X-MEDIA-SEQUENCE:' || cast(min(msn) as varchar), case when max(n) > 0 and {live} then '#EXT-X-DISCONTINUITY-SEQUENCE:' || cast(max(n) as varchar) end, case when not {live} then '#EXT-X-PLAYLIST-TYPE:VOD' end)
 || chr(10) || string_agg(line, chr(10) order by period_ord, seg_no) || {end} as body from l join ds using (channel_id, rep_id) group by channel_id, rep_id"""


def _playlists(spark, sf, newest: int | None):
    d = _ever(spark, sf)
    life = _timeline(spark, sf)
    run = timeline.number_across_periods(life, d).where("status = 'published'")
    if newest:
        back = timeline.Window.partitionBy("channel_id", "rep_id").orderBy(F.desc("period_ord"), F.desc("seg_no"))
        run = run.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= newest).drop("_n")
    heads = None
    if newest:
        head = run.groupBy("channel_id", "rep_id").agg(F.min(F.struct("period_ord", "seg_no")).alias("h")).select("channel_id", "rep_id", "h.period_ord", "h.seg_no")
        heads = timeline.discontinuity_sequence(life, head)
    video = F.col("media_type") == "video"
    run = run.withColumns({"path": F.when(video, "x.m4s").otherwise("x.ts"), "init_path": F.when(video, "init.mp4"), "iv": F.lit(bytearray(b"A" * 16))})
    return render.render_media_playlists(run, heads, "http://g/", vod=newest is None)


@query("r2_live_playlists", "--cte\n" + _PLAYLIST.format(window="qualify row_number() over (partition by channel_id, rep_id order by period_ord desc, seg_no desc) <= 6", live="true", end="chr(10)"), dedup=True)
def _(spark, sf):
    """Whole playlists of the newest six segments: header, sequence numbers, maps, keys, breaks."""
    return _playlists(spark, sf, 6)


@query("r2_vod_playlists", "--cte\n" + _PLAYLIST.format(window="", live="false", end="chr(10) || '#EXT-X-ENDLIST' || chr(10)"), dedup=True)
def _(spark, sf):
    return _playlists(spark, sf, None)


@query("r3_whole_masters", """--cte
t as (select *, cast(rep_id as bigint) as n, cast(rep_id as bigint) % 6 as k, 'http://g/v1/channels/' || lang || '/media/' || rep_id || '.m3u8' as uri from trk),
 l as (select lang, n, case when k = 0 then 0 when k = 1 then 1 else 2 end as o, case when k < 2 then '#EXT-X-MEDIA:TYPE=' || case k when 0 then 'AUDIO' else 'SUBTITLES' end || ',GROUP-ID="g' || cast(n % 2 as varchar) || '",NAME="n' || rep_id || '"' || case when n % 4 <> 0 then ',LANGUAGE="l' || cast(n % 4 as varchar) || '"' else '' end || case when n % 5 = 0 then ',DEFAULT=YES,AUTOSELECT=YES' else '' end || ',URI="' || uri || '"'
  else '#EXT-X-STREAM-INF:BANDWIDTH=' || cast(bandwidth as varchar) || case when n % 3 = 0 then ',AVERAGE-BANDWIDTH=' || cast(n + 5 as varchar) else '' end || case when n % 4 <> 0 then ',RESOLUTION=' || cast(n as varchar) || 'x' || cast(n % 4 as varchar) else '' end || case when n % 7 > 0 then ',FRAME-RATE=' || printf('%.3f', (n % 7)::double / 2) else '' end || case when n % 9 > 0 then ',CODECS="' || codecs || '"' else '' end || case when n % 2 = 0 then ',AUDIO="g0"' else '' end || case when n % 5 = 2 then ',SUBTITLES="g1"' else '' end || chr(10) || uri end as line from t)
select lang as channel_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || string_agg(line, chr(10) order by o, n) || chr(10) as body from l group by lang""", "trk")
def _(spark, sf):
    """Audio and subtitle renditions, defaults, and variants with and without each attribute."""
    t = rows(spark, sf, "trk")
    n, k = F.col("rep_id").cast("bigint"), F.col("rep_id").cast("bigint") % 6
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    t = t.select(
        "rep_id", "bandwidth", F.col("lang").alias("channel_id"), n.alias("doc_pos"), F.when(k == 0, "audio").when(k == 1, "subtitle").otherwise("variant").alias("kind"), text("g", n % 2).alias("group_id"), text("n", F.col("rep_id")).alias("name"), F.when(n % 4 != 0, text("l", n % 4)).alias("lang"), (n % 5 == 0).alias("is_default"),
        F.when(n % 3 == 0, n + 5).otherwise(0).alias("average_bandwidth"), n.alias("width"), (n % 4).alias("height"), ((n % 7) / F.lit(2.0)).alias("frame_rate"), F.when(n % 9 > 0, F.col("codecs")).alias("codecs"), F.when(n % 2 == 0, "g0").alias("audio_group"), F.when(n % 5 == 2, "g1").otherwise("").alias("subtitle_group"),
    )
    return render.render_master(t, "http://g")


@query("a2_health_document", f"select {T}, count(*) filter (status = 'committed') as committed, count(*) filter (status = 'published') as published, count(*) filter (status = 'expired') as expired, count(*) as total from d group by {T}", dedup=True)
def _(spark, sf):
    """The document of each channel, taken apart again down to its counts."""
    h = metrics.health_struct(metrics.status_counts(segs(spark, sf)))
    h = h.select("channel_id", F.explode("periods").alias("period_id", "sets")).select(*PERIOD, F.explode("sets").alias("as_id", "reps")).select(*PERIOD, "as_id", F.explode("reps").alias("rep_id", "c"))
    return h.select(*TRACK, *(F.col(f"c.{k}").alias(k) for k in ("committed", "published", "expired", "total")))


@query("k6_all_warnings", """--cte
h as (select k.as_id, k.kid, cast(k.as_id as int) as n, (k.as_id, k.kid) in (select as_id, kid from keyheld) as held from keyreq k),
 q as (select as_id, n, case n % 5 when 3 then null when 2 then 'malformed' when 1 then 'unsupported_scheme' else case when bool_or(not held) then 'missing_key' end end as kind, string_agg(kid, ',' order by kid) filter (not held) as missing from h group by as_id, n)
select as_id as channel_id, kind, as_id, concat_ws(',', case when kind = 'missing_key' then missing end, case when n % 4 < 2 then 'r' end) as detail from q where kind is not null union all
select as_id, 'key_unmatched', null, string_agg(kid, ',' order by kid) from keyheld where as_id in (select as_id from keyreq) and (as_id, kid) not in (select as_id, kid from keyreq) group by as_id union all
select as_id, 'conversion_failed', as_id, '' from q where n % 3 = 0 union all select as_id, 'hls_closed', null, '' from q where n % 7 = 0""", "keyreq", "keyheld")
def _(spark, sf):
    """Malformed, of an unknown scheme, without keys, with keys to spare, failed and closed; refused and withheld representations."""
    p = rows(spark, sf, "keyreq").groupBy("as_id").agg(F.array_sort(F.collect_set("kid")).alias("kids"))
    n = F.col("as_id").cast("int")
    p = p.select(F.col("as_id").alias("channel_id"), F.lit("p").alias("period_id"), "as_id", F.lit("r").alias("rep_id"), F.when(n % 5 == 1, "ctr0").otherwise("cbcs").alias("scheme"), "kids", F.when(n % 5 == 3, 0).when(n % 5 == 2, 2).otherwise(1).alias("n_tracks"))
    held = rows(spark, sf, "keyheld").select(F.col("as_id").alias("channel_id"), "kid")
    state = p.select(*TRACK, (n % 4 == 0).alias("refused"), (n % 4 == 1).alias("withheld"))
    out = keys.decrypt_warnings(p, held, state, p.where("cast(as_id as int) % 3 = 0"), p.where("cast(as_id as int) % 7 = 0"))
    return out.select("channel_id", "kind", "as_id", F.array_join("detail", ",").alias("detail"))


@query("k8_all_offerings", """--cte
t as (select lang as channel_id, bool_and(cast(rep_id as bigint) % 97 <> 0) as fmp4, bool_and(cast(rep_id as bigint) % 89 <> 1) as clear from trk group by lang),
 c as (select distinct lang as channel_id, case when lang like '%1' then 'hls' when lang like '%2' then 'hls' else 'dash' end as source from trk union select distinct 'x' || cast(as_timescale as varchar), case when as_timescale % 200 = 0 then 'hls' else 'dash' end from trk)
select channel_id, case source when 'hls' then 'hls' else 'dash' end as native, case when source = 'hls' and coalesce(fmp4, false) then 'dash' when source <> 'hls' and coalesce(clear, false) then 'hls' end as alternate, coalesce(fmp4, false) as fmp4, coalesce(clear, false) as clear, t.channel_id is not null as tracks_ready from c left join t using (channel_id)""", "trk")
def _(spark, sf):
    """Channels of both kinds with packed, plain, protected and no tracks."""
    t = rows(spark, sf, "trk")
    n = F.col("rep_id").cast("bigint")
    channels = t.select(F.col("lang").alias("channel_id"), F.when(F.col("lang").endswith("1") | F.col("lang").endswith("2"), "hls").otherwise("dash").alias("source_type"))
    bare = t.select(F.concat(F.lit("x"), F.col("as_timescale").cast("string")).alias("channel_id"), F.when(F.col("as_timescale") % 200 == 0, "hls").otherwise("dash").alias("source_type"))
    tracks = t.select(F.col("lang").alias("channel_id"), F.lit("video").alias("media_type"), F.when(n % 97 == 0, F.when(n % 2 == 0, "ts").otherwise("vtt")).otherwise("m4s").alias("ext"), (n % 89 == 1).alias("protected"))
    return keys.offerings(channels.unionByName(bare).distinct(), tracks)


@query("j1_mixed_lengths", """--cte
x as (select distinct channel_id, period_id, media_type, as_id, rep_id, seg_no, start_pts / 90000.0::double as s, (end_pts - start_pts) / 90000.0::double as len from d),
 v as (select *, s + len * case seg_no % 5 when 0 then 0.02::double when 4 then 450.0::double else 1.0::double end as e from x where media_type = 'video'), a as (select *, s + len * case seg_no % 7 when 0 then 0.02::double when 6 then 90.0::double else 1.0::double end as e from x where media_type = 'audio')
select v.channel_id, v.period_id, v.rep_id as v_rep, v.seg_no as v_no, a.rep_id as a_rep, a.seg_no as a_no from v join a on v.channel_id = a.channel_id and v.period_id = a.period_id and v.e > v.s and a.e > a.s and least(v.e, a.e) - greatest(v.s, a.s) >= 0.5 * least(v.e - v.s, a.e - a.s)""", dedup=True)
def _(spark, sf):
    """Spans of a fiftieth of a second to over an hour on both sides. Their levels are those of all writes, so the last ones are found once."""
    n, s, video = F.col("seg_no"), S.pts_seconds("start_pts", "timescale"), F.col("media_type") == "video"
    long = F.when(video, F.when(n % 5 == 0, 0.02).when(n % 5 == 4, 450.0).otherwise(1.0)).otherwise(F.when(n % 7 == 0, 0.02).when(n % 7 == 6, 90.0).otherwise(1.0))
    spans = lambda d: d.select(*PERIOD, "rep_id", "seg_no", "media_type", s.alias("s"), (s + ((F.col("end_pts") - F.col("start_pts")) / F.lit(90000.0)) * long).alias("e"))
    found, d = publish.levels(spans(rows(spark, sf, "seg")), ("s", "e"), F.col("media_type")), spans(segs(spark, sf, TRACK, hashed=True))
    v = d.where(video).select(*PERIOD, F.col("rep_id").alias("v_rep"), n.alias("v_no"), F.col("s").alias("start_s"), F.col("e").alias("end_s"))
    a = d.where("media_type = 'audio'").select(*PERIOD, F.col("rep_id").alias("a_rep"), n.alias("a_no"), F.col("s").alias("r_start_s"), F.col("e").alias("r_end_s"))
    return publish.overlap_join(v, a, known=(found.get("video", []), found.get("audio", []))).select(*PERIOD, "v_rep", "v_no", "a_rep", "a_no")


# --- small rules ------------------------------------------------------------------------------------------


@query("a6_final_totals", """--cte
g as (select channel_id, cast(count(*) as bigint) as stored, bool_or(end_list) as completed, cast(channel_id as bigint) % 3 = 0 as known, 50::bigint as told from pol group by channel_id)
select channel_id, case when completed and not known then stored when known then told end as expected, known or completed as known from g""", "pol")
def _(spark, sf):
    """A completed channel of unknown total takes what it stored."""
    known = F.col("channel_id").cast("bigint") % 3 == 0
    p = rows(spark, sf, "pol").groupBy("channel_id").agg(F.count(F.lit(1)).alias("stored"), F.bool_or("end_list").alias("completed"))
    p = p.withColumn("known", known).withColumn("expected", F.when(F.col("known"), F.lit(50).cast("bigint")))
    return metrics.final_total(p).select("channel_id", "expected", "known")


@query("a7_upstream_types", "select channel_id, arg_max(case when event_id % 3 = 0 then 'static' else 'dynamic' end, poll_at) as upstream_type from pol group by channel_id", "pol")
def _(spark, sf):
    p = rows(spark, sf, "pol").select("channel_id", F.when(F.col("event_id") % 3 == 0, "static").otherwise("dynamic").alias("type"), F.col("poll_at").alias("fetched_at"))
    return metrics.upstream_type(p)


@query("f15_last_messages", "select doc_id, arg_max(case when length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 200 then left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) || '…' else trim(regexp_replace(text, '\\s+', ' ', 'g')) end, line_no) as message from lin group by doc_id", "lin")
def _(spark, sf):
    return metrics.last_messages(rows(spark, sf, "lin"), "doc_id", "line_no", "text")


@query("p5_masters_told_apart", "select lang, lang like '%1' as master from trk group by lang", "trk")
def _(spark, sf):
    t = rows(spark, sf, "trk").groupBy("lang").agg(F.max("rep_id").alias("r"))
    body = F.concat(F.lit("#EXTM3U\n"), F.when(F.col("lang").endswith("1"), "#EXT-X-STREAM-INF:BANDWIDTH=1\nv.m3u8").otherwise(F.concat(F.lit("#EXTINF:1,\n"), F.col("r"), F.lit(".ts"))))
    return t.select("lang", playlist.is_master(body).alias("master"))


@query("d8_poll_deadlines", """select event_id, case when event_id % 4 <> 0 then epoch_us(poll_at) + (event_id % 4) * 1500000 end as deadline_us from pol""", "pol")
def _(spark, sf):
    p = rows(spark, sf, "pol").withColumn("at", F.col("poll_at").cast("timestamp"))
    seconds = F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 4) * F.lit(1.5))
    return p.select("event_id", F.unix_micros(playlist.poll_deadline(F.col("at"), seconds)).alias("deadline_us"))


@query("j3_publish_by_policy", "--cte\n" + PAIRS + f""",
 k as (select channel_id, period_id, count(distinct case when media_type = 'audio' then as_id end) as na, count(distinct case when media_type = 'video' then as_id end) as nv from d group by all),
 m as (select channel_id, period_id, v_as, v_no, a_as, min(a_no) as a_no from pr group by all),
 fl as (select channel_id, period_id, v_as, v_no from m join k using (channel_id, period_id) group by channel_id, period_id, v_as, v_no, na having count(*) = na),
 n as (select channel_id, period_id, v_as as as_id, v_no as seg_no from fl union select m.channel_id, m.period_id, m.a_as, m.a_no from m join fl using (channel_id, period_id, v_as, v_no))
select {T}, seg_no from d where cast(channel_id as bigint) % 2 = 0 or (channel_id, period_id, as_id, seg_no) in (select channel_id, period_id, as_id, seg_no from n) or (channel_id, period_id) in (select channel_id, period_id from k where na = 0 or nv = 0)""", dedup=True)
def _(spark, sf):
    """Channels of playlists publish at once, those of manifests behind the barrier."""
    d = segs(spark, sf, PERIOD, hashed=True).withColumn("policy", publish.publish_policy(F.when(F.col("channel_id").cast("bigint") % 2 == 0, "hls").otherwise("dash")))
    at_once = publish.publish_immediately(d.where("policy = 'immediate'")).select(*TRACK, "seg_no")
    return at_once.unionByName(publish.publish_av_barrier(d.where("policy = 'av_barrier'")).select(*TRACK, "seg_no"))
