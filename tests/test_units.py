"""Operators on literal rows: parsing, discovery, restarts, rendering, sources, scalars."""

from __future__ import annotations

import base64
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from segline import schema
from segline.functions import scalars as S
from segline.operators import discovery, manifest, metrics, playlist, publish, render, timeline
from segline.sources import segment_store, store


T = datetime(2024, 1, 1)


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


# --- scalars


def test_durations_types_and_systems(spark):
    r = one(spark, a=S.iso_duration(F.lit("PT30.029S")), b=S.iso_duration(F.lit("P1DT2H3M")), c=S.iso_duration(F.lit("soon")), d=S.iso_duration(F.lit(None).cast("string")), e=S.media_type(F.lit("audio/mp4"), F.lit(None)), f=S.media_type(F.lit("x"), F.lit("text")), g=S.media_type(F.lit(""), F.lit("")), h=S.drm_system(F.lit("urn:uuid:EDEF8BA9-79D6-4ACE-A3C8-27DCD51D21ED")))
    assert tuple(r) == (30_029_000, 93_780_000_000, 0, 0, "audio", "text", "unknown", "widevine")


def test_templates_bases_ranges(spark):
    lit = F.lit
    r = one(
        spark, a=S.expand_template(lit("$RepresentationID$/$Number%05d$_$Time$_$Number$"), lit(7), lit(900), lit("v/1")), b=S.join_base(lit("http://a/b/"), lit("/c/")), c=S.join_base(lit("x"), lit("https://z")),
        d=S.resolve_base(lit("http://a/b/"), lit("")), e=S.dir_url(lit("https://edge.example/show/s.mpd")), f=S.byte_range_dash(lit("10-99")), g=S.byte_range_dash(lit("10-x")), h=S.byte_range_at(lit("500@7")), i=S.byte_range_at(lit("500")), j=S.resolve_uri(lit("http://h/a/b/p.m3u8"), lit("../k.bin")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.j) == ("v/1/00007_900_$Number$", "http://a/b/c/", "https://z", "http://a/b", "https://edge.example/show", "http://h/a/k.bin")
    assert (tuple(r.f), r.g, tuple(r.h), tuple(r.i)) == ((10, 99), None, (500, 7), (500, None))


def test_attributes_keep_quoted_commas(spark):
    r = one(spark, a=S.attributes(F.lit('#EXT-X-STREAM-INF:BANDWIDTH=1,CODECS="avc1,mp4a",NAME="a=b"')), b=S.attributes(F.lit(None).cast("string")))
    assert (r.a, r.b) == ({"BANDWIDTH": "1", "CODECS": "avc1,mp4a", "NAME": "a=b"}, None)


def test_ids_round_trip(spark):
    ids = ["a.b-c_1", "", ".", "..", "v/1", "~x", "é", "track=57"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = rows(df.select("id", S.encode_id("id").alias("e"), S.encode_rep_id("id").alias("r")).select("id", "e", "r", S.decode_id("e"), S.decode_rep_id("r")))
    assert all(r[0] == r[3] == r[4] for r in got)
    assert {r[0]: r[2] for r in got}["track=57"] == "track=57" and {r[0]: r[1] for r in got}["track=57"].startswith("~")
    assert one(spark, a=S.decode_id(F.lit("~YQ")), b=S.decode_id(F.lit("a b"))) == (None, None)


def test_license_url_is_replaced(spark):
    enc = base64.b64encode("<W><LA_URL>old</LA_URL></W>".encode("utf-16-le")).decode()
    r = one(spark, a=S.rewrite_license_url(F.lit(enc), F.lit("http://new")))
    assert base64.b64decode(r.a.replace("\n", "").replace("\r", "")).decode("utf-16-le") == "<W><LA_URL>http://new</LA_URL></W>"


def test_media_checks_and_decryption(spark):
    aes_encrypt = F.aes_encrypt
    b = lambda x: F.lit(bytearray(x))
    r = one(spark, a=S.valid_ts(b((b"\x47" + bytes(187)) * 3)), c=S.valid_ts(b(bytes(188))), d=S.valid_ts(b(b"\x47")), e=S.valid_encrypted(b(bytes(32))), f=S.valid_encrypted(b(bytes(31))), g=S.valid_vtt(b(b"\xef\xbb\xbfWEBVTT\n")), h=S.valid_vtt(b(b"x")))
    assert tuple(r) == (True, False, False, True, False, True, False)
    key, iv = b(bytes(range(16))), b(bytes(16))
    whole = aes_encrypt(b(b"hello"), key, F.lit("CBC"), F.lit("DEFAULT"), iv)
    r = one(spark, a=S.decrypt_segment(F.substring(whole, 17, 64), key, iv), c=S.decrypt_segment(b(bytes(16)), key, iv), d=S.decrypt_segment(b(b"x"), key, iv))
    assert (bytes(r.a.plain), r.a.reason, r.c.reason, r.d.reason) == (b"hello", None, "bad padding", "not whole blocks")


def test_config_errors_never_show_keys(spark):
    k = "0" * 32 + ":" + "ab" * 16
    df = spark.createDataFrame([("dash", "decrypt", "https://h/x", [k]), ("x", "", "ftp://h", []), ("dash", "decrypt", "http://", [k, k, "ab:cd"]), ("hls", None, "http://h", [k])], "source_type string, key_mode string, url string, content_keys array<string>")
    got = [r[0] for r in rows(df.select(S.config_errors()))]
    assert got[0] == [] and len(got[1]) == 2 and len(got[2]) == 3 and got[3] == ["content keys need dash in decrypt mode"]
    assert not any("ab" * 8 in e for g in got for e in g)


def test_relative_paths_and_outcomes(spark):
    r = one(spark, a=S.relative_path(F.lit("/d/c/x/1.ts"), F.lit("/d/c/")), b=S.relative_path(F.lit("/d/cc/1.ts"), F.lit("/d/c")), c=S.relative_path(F.lit("/d/c/../1.ts"), F.lit("/d/c")), d=S.classify_outcome(F.lit(425), F.lit("fetch")), e=S.classify_outcome(F.lit(200), F.lit("validate")))
    assert (r.a, r.b, r.c) == ("x/1.ts", None, None)
    assert (tuple(r.d), tuple(r.e)) == (("retry", 0.5, False), ("drop", None, False))


# --- manifests and discovery

MPD = """<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" xmlns:cenc="urn:mpeg:cenc:2013" type="dynamic" availabilityStartTime="2024-01-01T00:00:00Z" timeShiftBufferDepth="PT1M" minimumUpdatePeriod="PT2S">
<BaseURL>http://cdn/a/</BaseURL><Period id="p0" start="PT0S" duration="PT20S">
<AdaptationSet id="77" mimeType="video/mp4"><ContentProtection schemeIdUri="urn:mpeg:dash:mp4protection:2011" value="cenc" cenc:default_KID="00112233-4455-6677-8899-AABBCCDDEEFF"/><ContentProtection schemeIdUri="urn:uuid:9a04f079-9840-4286-ab92-e65be0885f95"/>
<SegmentTemplate timescale="1000" duration="2000" startNumber="5" presentationTimeOffset="9" media="$RepresentationID$/$Number$.m4s" initialization="$RepresentationID$/init.mp4"/>
<Representation id="v/1" bandwidth="100" width="640" height="360" codecs="avc1"><BaseURL>one/</BaseURL><BaseURL>http://alt/</BaseURL></Representation>
<Representation id="v2" bandwidth="200"><SegmentTemplate presentationTimeOffset="0"><SegmentTimeline><S t="7" d="5040" r="3"/><S d="10"/></SegmentTimeline></SegmentTemplate></Representation></AdaptationSet>
<AdaptationSet contentType="audio" lang="de"><SegmentList timescale="10" duration="20"><Initialization sourceURL="i.mp4"/><SegmentURL media="a1.mp4" mediaRange="0-9"/><SegmentURL media="a2.mp4"/></SegmentList><Representation id="a1"/></AdaptationSet>
</Period></MPD>"""


@pytest.fixture(scope="module")
def mpd(spark):
    docs = spark.createDataFrame([("c1", MPD), ("c2", "<MPD"), ("c3", "not xml")], "channel_id string, body string")
    return manifest.effective_addressing(manifest.explode_manifest(docs))


def test_manifest_rows_and_addressing(mpd):
    got = {r["rep_id"]: r for r in mpd.collect()}
    assert set(got) == {"v/1", "v2", "a1"}
    v, w, a = got["v/1"], got["v2"], got["a1"]
    assert (v.as_id, v.media_type, v.presentation, v.period_duration_s, v.depth_s, v.protected, v.mpd_base, v.rep_base, v.rep_alts) == ("0", "video", "dynamic", 20.0, 60.0, True, "http://cdn/a/", "one/", ["http://alt/"])
    assert (v.scheme, v.timescale, v.d, v.start_number, v.pto) == ("template", 1000, 2000, 5, 9)
    assert (w.timescale, w.start_number, w.pto, w.media) == (1000, 1, 0, "$RepresentationID$/$Number$.m4s")
    assert (a.as_id, a.media_type, a.lang, a.scheme, a.timescale, len(a.segment_urls), a.list_init) == ("1", "audio", "de", "list", 10, 2, "i.mp4")


def test_protection_rows(mpd):
    p = manifest.explode_protection(mpd)
    assert sorted(rows(p, "system", "default_kid")) == [("cenc", "00112233445566778899aabbccddeeff"), ("playready", None)]
    assert rows(manifest.filter_protection(p, False, False), "system") == [] and len(rows(manifest.filter_protection(p, False, True))) == 1


def test_enumeration_of_a_manifest(mpd):
    now = datetime(2024, 1, 1).timestamp() - datetime(1970, 1, 1).timestamp() + 9
    by_d = discovery.enumerate_by_duration(mpd.where("rep_id = 'v/1'"), now)
    assert sorted(r[0] for r in rows(by_d, "seg_no")) == [5, 6, 7, 8, 9]
    by_t = discovery.enumerate_by_timeline(mpd.where("rep_id = 'v2'"), now)
    assert sorted(rows(by_t, "seg_no", "seg_time")) == [(1, 7), (2, 5047), (3, 10087), (4, 15127), (5, 20167)]
    by_l = discovery.enumerate_by_list(mpd.where("rep_id = 'a1'"))
    assert sorted(rows(by_l, "seg_no", "media", "media_range")) == [(1, "a1.mp4", (0, 9)), (2, "a2.mp4", None)]
    urls = discovery.segment_urls(by_d.where("seg_no = 5").withColumn("seg_time", F.lit(0)))
    assert rows(urls, "url", "fallbacks") == [("http://cdn/a/one/v/1/5.m4s", ["http://alt/v/1/5.m4s"])]


def test_enumeration_is_capped_before_rows_are_made(spark):
    cols = "channel_id string, period_id string, as_id string, rep_id string, presentation string, period_duration_s double, d bigint, timescale bigint, start_number bigint, ast bigint, period_start_s double, depth_s double"
    df = spark.createDataFrame([("c", "p", "0", "long", "static", 3.6e9, 1, 1, 1, None, 0.0, 0.0), ("c", "p", "0", "tiny", "static", 1e-6, 1, 1, 0, None, 0.0, 0.0), ("c", "p", "0", "live", "dynamic", 0.0, 1, 1, 1, 1000, 0.0, 1e12)], cols)
    got = {r[0]: (r[1], r[2]) for r in rows(discovery.enumerate_by_duration(df, 1100).groupBy("rep_id").agg(F.count(F.lit(1)), F.bool_or("truncated")))}
    assert got == {"long": (100_000, True), "live": (101, False)}
    t = df.where("rep_id = 'live'").withColumn("timeline", F.array(F.struct(F.lit(0).alias("t"), F.lit(1).alias("d"), F.lit(10**9).alias("r"))))
    out = discovery.enumerate_by_timeline(t, 1100)
    assert out.agg(F.count(F.lit(1)), F.max("seg_no"), F.bool_and("truncated")).first() == (100_000, 100_000, True)


def test_index_box_addressing(spark):
    refs = [(100, 9), (1 << 31 | 50, 1), (70, 8)]
    box = struct.pack(">I4sIII", 32 + 12 * len(refs), b"sidx", 0, 1, 1000) + struct.pack(">IIHH", 0, 10, 0, len(refs)) + b"".join(struct.pack(">III", s, d, 0) for s, d in refs)
    df = spark.createDataFrame([("c", "p", "0", "r", bytearray(box), 200)], "channel_id string, period_id string, as_id string, rep_id string, sidx binary, index_end bigint")
    found = store.explode_sidx(df)
    assert rows(found, "ref_no", "offset", "size", "duration", "timescale") == [(0, 210, 100, 9, 1000), (2, 360, 70, 8, 1000)]
    reps = df.select(*schema.TRACK, F.lit("0-9").alias("index_range")).unionByName(df.select("channel_id", "period_id", "as_id", F.lit("q").alias("rep_id"), F.lit(None).cast("string").alias("index_range")))
    segments, warnings = discovery.enumerate_by_index(reps, found)
    assert sorted(rows(segments, "seg_no", "offset")) == [(1, 210), (2, 360)] and rows(warnings, "rep_id") == [("q",)]


# --- playlists

MEDIA = """#EXTM3U\r
#EXT-X-TARGETDURATION:4
#EXT-X-MEDIA-SEQUENCE:258

#EXTINF:4.0,first
a.ts
#EXT-X-KEY:METHOD=AES-128,URI="../keys/k1.bin"
#EXT-X-MAP:URI="i.mp4",BYTERANGE="10@0"
#EXTINF:4,
#EXT-X-BYTERANGE:100@50
b.mp4
stray.ts
#EXT-X-DISCONTINUITY
#EXT-X-PROGRAM-DATE-TIME:2024-01-01T00:00:00Z
#EXTINF:2.5,x,y
#EXT-X-BYTERANGE:30
b.mp4
#EXT-X-KEY:METHOD=NONE
#EXTINF:1,
c.ts
#EXT-X-ENDLIST
"""
MASTER = """#EXTM3U
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud",NAME="Deutsch",LANGUAGE="de",DEFAULT=YES,URI="a/de.m3u8"
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud",NAME="muxed"
#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="sub",NAME="S",URI="s.m3u8"
#EXT-X-STREAM-INF:BANDWIDTH=1000,RESOLUTION=640x360,CODECS="avc1.4d,mp4a.40.2",AUDIO="aud"
lo/p.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=2000,AVERAGE-BANDWIDTH=1500
hi/p.m3u8
"""


def test_media_playlist_rows(spark):
    docs = spark.createDataFrame([("d", "http://h/v/p.m3u8", MEDIA), ("bad", "http://h/x", "hello\n#EXTM3U")], "doc_id string, url string, body string")
    lines, rejects = playlist.explode_playlist_lines(docs)
    assert rows(rejects, "doc_id") == [("bad",)]
    got = playlist.parse_media_playlist(lines).orderBy("seq").collect()
    assert [(r.seq, r.uri, r.duration_s, r.title) for r in got] == [(258, "http://h/v/a.ts", 4.0, "first"), (259, "http://h/v/b.mp4", 4.0, ""), (260, "http://h/v/b.mp4", 2.5, "x,y"), (261, "http://h/v/c.ts", 1.0, "")]
    assert [r.key_uri for r in got] == [None, "http://h/keys/k1.bin", "http://h/keys/k1.bin", None] and got[1].iv.endswith("0103")
    assert [r.discontinuity for r in got] == [False, False, True, False] and [r.program_at is not None for r in got] == [False, False, True, False]
    assert [(r.byte_length, r.byte_offset) for r in got] == [(None, None), (100, 50), (30, 150), (None, None)]
    assert [r.map_uri for r in got] == [None, *["http://h/v/i.mp4"] * 3]
    s = playlist.summarize_playlist(playlist.parse_media_playlist(lines), lines).first()
    assert (s.target_s, s.media_sequence, s.end_list, s.n_segments, s.last_seq, s.duration_s) == (4.0, 258, True, 4, 261, 11.5)


def test_master_playlist_rows(spark):
    docs = spark.createDataFrame([("m", "http://h/m.m3u8", MASTER), ("bare", "http://h/p.m3u8", MEDIA), ("none", "http://h/n", "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\n")], "doc_id string, url string, body string")
    tracks, rejects = playlist.parse_master_playlist(playlist.explode_playlist_lines(docs)[0])
    got = {(r.doc_id, r.rep_id): r for r in tracks.collect()}
    assert set(got) == {("m", "v0"), ("m", "v1"), ("m", "a0"), ("m", "s0"), ("bare", "v0")}
    v = got["m", "v0"]
    assert (v.uri, v.bandwidth, v.width, v.height, v.codecs, v.audio_group) == ("http://h/lo/p.m3u8", 1000, 640, 360, "avc1.4d,mp4a.40.2", "aud")
    assert got["m", "a0"].is_default and got["m", "a0"].uri == "http://h/a/de.m3u8" and got["bare", "v0"].bandwidth == 1_000_000
    assert rows(rejects, "doc_id") == [("none",)]


def test_rendered_playlist_parses_back(spark):
    cols = "channel_id string, rep_id string, period_id string, period_ord int, seg_no bigint, msn bigint, start_pts bigint, end_pts bigint, timescale int, path string, init_path string, key_uri string, iv binary, discontinuity boolean"
    iv = bytearray(range(16))
    data = [("c", "v", "p0", 0, n, 100 + n, n * 4000, n * 4000 + 4000, 1000, f"/x/{n}.m4s", "/x/init.mp4", "k" if n == 2 else None, iv if n == 2 else None, n == 3) for n in (1, 2, 3)] + [("c", "v", "p1", 1, 0, 104, 0, 2500, 1000, "/x/0.m4s", "/x/init.mp4", None, None, False)]
    run = spark.createDataFrame(data, cols)
    heads = spark.createDataFrame([("c", "v", 2)], "channel_id string, rep_id string, discontinuity_sequence int")
    text = render.render_media_playlists(run, heads, "http://g", vod=True).first().body
    assert text.startswith("#EXTM3U\n#EXT-X-VERSION:6\n#EXT-X-TARGETDURATION:4\n#EXT-X-MEDIA-SEQUENCE:101\n#EXT-X-DISCONTINUITY-SEQUENCE:2\n#EXT-X-PLAYLIST-TYPE:VOD\n#EXT-X-MAP")
    docs = spark.createDataFrame([("d", "http://g/p", text)], "doc_id string, url string, body string")
    back = playlist.parse_media_playlist(playlist.explode_playlist_lines(docs)[0]).orderBy("seq").collect()
    assert [(r.seq, r.duration_s, r.discontinuity, r.key_method) for r in back] == [(101, 4.0, False, None), (102, 4.0, False, "AES-128"), (103, 4.0, True, None), (104, 2.5, True, None)]
    assert back[1].iv == iv.hex() and back[3].uri == "http://g/v1/channels/c/segments/p1/v/0.m4s"


def test_key_resets_at_a_new_map(spark):
    data = [(1, 0, "i0", "K"), (2, 0, "i0", "K"), (3, 1, "i1", "K"), (4, 1, "i1", "")]
    run = spark.createDataFrame([("c", "r", n, p, i, k, False, 1.0, str(n)) for n, p, i, k in data], "channel_id string, rep_id string, seg_no bigint, period_ord int, init_uri string, key_line string, discontinuity boolean, duration_s double, uri string")
    lines = [r[0] for r in rows(render.playlist_lines(run).orderBy("period_ord", "seg_no", "line_pos"), "line") if not r[0].startswith("#EXTINF") and len(r[0]) > 1 or r[0] == "K"]
    none = "#EXT-X-KEY:METHOD=NONE"
    assert lines == ['#EXT-X-MAP:URI="i0"', "K", "#EXT-X-DISCONTINUITY", none, '#EXT-X-MAP:URI="i1"', "K", none]


def test_local_export_and_its_errors(spark):
    cols = "channel_id string, rep_id string, period_ord int, seg_no bigint, start_pts bigint, end_pts bigint, timescale int, path string, init_path string, key_uri string, iv binary, discontinuity boolean"
    segs = spark.createDataFrame([("c", "v", 0, 5, 0, 1500, 1000, "/d/c/5.ts", None, None, None, False), ("c", "v", 0, 7, 1500, 3000, 1000, "/d/c/7.ts", None, "k", bytearray(16), False), ("c", "w", 0, 1, 0, 1, 1, "/elsewhere/1.ts", None, None, None, False)], cols)
    docs, errors = render.render_local(segs, "/d/c", spark.createDataFrame([("k", "keys/1.key")], "key_uri string, file string"))
    (r,) = docs.collect()
    assert "#EXT-X-MEDIA-SEQUENCE:5\n#EXTINF:1.500,\n5.ts\n#EXT-X-DISCONTINUITY\n#EXT-X-KEY:METHOD=AES-128,URI=\"keys/1.key\",IV=0x" in r.body and r.body.endswith("7.ts\n#EXT-X-ENDLIST\n")
    assert rows(errors, "rep_id", "error") == [("w", "path outside the channel")]


def test_rendered_manifest_parses_back(spark):
    segs = spark.createDataFrame([("c", "p", "0", "v", n, n * 100, n * 100 + 100, 10) for n in (3, 4, 5)], "channel_id string, period_id string, as_id string, rep_id string, seg_no bigint, start_pts bigint, end_pts bigint, timescale int")
    base = segs.select(*schema.TRACK).distinct().withColumns({"media_type": F.lit("video"), "lang": F.lit(""), "bandwidth": F.lit(5).cast("bigint"), "codecs": F.lit("avc1"), "timescale": F.lit(0), "start_number": F.lit(0), "pto": F.lit(0), "timeline": F.lit(0)})
    periods = spark.createDataFrame([("c", "p", 0, 0.0)], "channel_id string, period_id string, period_ord int, start_s double")
    channels = spark.createDataFrame([("c", "static", 0.0, 0.0, 30.0, False)], "channel_id string, presentation string, update_s double, depth_s double, duration_s double, static_ingesting boolean")
    doc = render.render_manifests(render.manifest_timing(base, segs), periods, channels)
    (r,) = manifest.effective_addressing(manifest.explode_manifest(doc)).collect()
    assert (r.presentation, r.duration_s, r.rep_id, r.start_number, r.pto, r.timescale, [tuple(x) for x in r.timeline]) == ("static", 30.0, "v", 3, 300, 10, [(300, 100, 2)])


# --- timeline and publish


def test_ends_do_not_stretch_over_a_hole(spark):
    df = spark.createDataFrame([("c", "p", "0", "r", n, s) for n, s in ((1, 0), (2, 96256), (3, 192512), (1535, 50_000_000))], "channel_id string, period_id string, as_id string, rep_id string, seg_no bigint, start_pts bigint")
    assert [r[0] for r in rows(timeline.derive_ends(df).orderBy("seg_no").select(F.col("end_pts") - F.col("start_pts")))] == [96256] * 4


def test_period_order(spark):
    order = lambda ids, doc=None: [r[0] for r in rows(timeline.order_periods(spark.createDataFrame([("c", i) for i in ids], "channel_id string, period_id string"), doc and spark.createDataFrame([("c", p, i) for i, p in enumerate(doc)], "channel_id string, period_id string, pos int")).orderBy("period_ord"), "period_id")]
    assert order(["late", "10", "early", "2", "orphan"], ["early", "late"]) == ["2", "10", "orphan", "early", "late"]
    assert order(["b", "a.r2", "a", "a.r1", "old.r1", "old", "a.r10"], ["a", "b"]) == ["old", "old.r1", "a", "a.r1", "a.r2", "a.r10", "b"]
    assert order(["a.r", "a.r0", "a.r01", "a.rx", "a"]) == ["a", "a.r", "a.r0", "a.r01", "a.rx"]


def test_layout_without_a_fold(spark):
    df = spark.createDataFrame([("c", i, o, s) for i, (o, s) in enumerate(zip((0, 0, 40, 41), (10, 5, 7, 1), strict=True))] + [("solo", 0, 3, 4)], "channel_id string, period_ord int, origin_start bigint, span bigint")
    assert [r[0] for r in rows(timeline.layout_periods(df).orderBy("channel_id", "period_ord"), "start")] == [0, 10, 40, 47, None]


def barrier(spark, video, audio, sets=None):
    cols = "channel_id string, period_id string, as_id string, rep_id string, media_type string, seg_no bigint, start_pts bigint, end_pts bigint, timescale int"
    data = [("c", "p", "0", "v", "video", n, a, b, 1000) for n, (a, b) in enumerate(video)]
    for k, segs in enumerate(audio, 1):
        data += [("c", "p", str(k), f"a{k}", "audio", n, a, b, 1000) for n, (a, b) in enumerate(segs)]
    s = sets and spark.createDataFrame([("c", "p", a, m) for a, m in sets], "channel_id string, period_id string, as_id string, media_type string")
    return [publish.publish_av_barrier(spark.createDataFrame(data, cols), s, bucket=b).count() for b in (None, 1.0)]


def test_barrier(spark):
    assert barrier(spark, [(0, 2000), (2000, 4000)], [[(0, 2048), (2048, 4096)]]) == [4, 4]
    assert barrier(spark, [(0, 1000)], [[(5000, 6000)]]) == [0, 0]
    assert barrier(spark, [(0, 2000)], [[(0, 2000)], [(0, 2000)]]) == [3, 3]
    assert barrier(spark, [(0, 2000)], [[(0, 2000)]], [("1", "audio"), ("2", "audio"), ("0", "video")]) == [0, 0]
    assert barrier(spark, [(0, 2000), (2000, 4000)], [[(0, 2000)]]) == [2, 2]
    assert barrier(spark, [(0, 2000), (2000, 4000)], []) == [2, 2]


def test_shared_restart_numbers(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("c", r, t + timedelta(seconds=s), i) for i, (r, s) in enumerate((("v", 1), ("a", 2), ("v", 3), ("v", 4), ("a", 5)))], "channel_id string, rep_id string, poll_at timestamp, event_id int")
    got = rows(timeline.assign_shared_period(df).orderBy("event_id"), "rep_id", "period_no")
    assert got == [("v", 1), ("a", 1), ("v", 2), ("v", 3), ("a", 3)]


def test_manifest_restarts(spark):
    t = datetime(2024, 1, 1)
    data = [(t, True, 100, "v", 5), (t + timedelta(1), True, 100, "v", 6), (t + timedelta(2), True, 100, "v", 2), (t + timedelta(3), True, 200, "v", 9), (t + timedelta(4), False, 300, "v", 1)]
    df = spark.createDataFrame([("c", "p", at, d, ast, r, n) for at, d, ast, r, n in data], "channel_id string, period_id string, fetched_at timestamp, dynamic boolean, ast bigint, rep_id string, highest bigint")
    assert [r[0] for r in rows(timeline.detect_manifest_restarts(df).orderBy("fetched_at"), "gateway_period_id")] == ["p", "p", "p.r1", "p.r2", "p.r2"]


def test_clock_with_a_late_segment(spark):
    t = datetime(2024, 1, 1)
    data = [(10, 2.0, 0), (11, 2.0, 0), (14, 2.0, 1), (12, 1.0, 2), (20, 1.0, 3), (18, 1.0, 4)]
    df = spark.createDataFrame([("c", "p", "r", n, d, t + timedelta(seconds=s)) for n, d, s in data], "channel_id string, period_id string, rep_id string, seg_no bigint, duration_s double, poll_at timestamp")
    assert rows(timeline.accumulate_pts(df).orderBy("seg_no"), "seg_no", "start_pts") == [(10, 0), (11, 180000), (12, 360000), (14, 360000), (18, None), (20, 540000)]


def test_rebuild_keeps_what_it_can_time(spark):
    key = ("c", "p", "0")
    files = spark.createDataFrame([(*key, "t", 1, "ts", "1.ts"), (*key, "t", 2, "ts", "2.ts"), (*key, "m", 1, "m4s", "1.m4s"), (*key, "m", 2, "m4s", "2.m4s"), (*key, "n", 1, "m4s", "x")], "channel_id string, period_id string, as_id string, rep_id string, seg_no bigint, ext string, path string")
    boxes = spark.createDataFrame([(*key, "m", 1, 0, 100), (*key, "m", 2, 50, 100), (*key, "n", 1, 0, 0)], "channel_id string, period_id string, as_id string, rep_id string, seg_no bigint, start_pts bigint, timescale int")
    meta = spark.createDataFrame([(*key, "t", 1, 5, 9, 10, True, "k"), (*key, "m", 2, 0, 0, 0, True, "q")], "channel_id string, period_id string, as_id string, rep_id string, seg_no bigint, start_pts bigint, end_pts bigint, timescale int, discontinuity boolean, key_uri string")
    got = sorted(rows(timeline.rebuild_segments(files, boxes, meta), "rep_id", "seg_no", "start_pts", "end_pts", "discontinuity", "key_uri"))
    assert got == [("m", 1, 0, 50, False, None), ("m", 2, 50, 100, True, "q"), ("t", 1, 5, 9, True, "k")]


def test_throughput_window_and_eta(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("c", t + timedelta(seconds=s), b) for s, b in ((0, 100), (10, 50), (20, 50), (45, 10))], "channel_id string, attempt_at timestamp, bytes bigint")
    assert [r[0] for r in rows(metrics.throughput(df).orderBy("attempt_at"), "bytes_per_s")] == [0.0, 5.0, 5.0, 0.4]
    p = spark.createDataFrame([(50, 100, True, False, 5.0), (50, 100, True, True, 5.0), (100, 100, True, False, 5.0), (50, 100, True, False, 0.0), (50, 0, False, False, 5.0)], "stored bigint, expected bigint, known boolean, capped boolean, rate double")
    assert [r[0] for r in rows(metrics.eta(p), "eta_s")] == [10.0, None, None, None, None]


# --- sources and sinks


def mp4(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_box_facts(spark):
    tfdt = mp4(b"tfdt", bytes([1, 0, 0, 0]), struct.pack(">Q", 1 << 33))
    seg = mp4(b"moof", mp4(b"traf", tfdt)) + mp4(b"mdat", b"xx")
    kid = bytes(range(16))
    sinf = mp4(b"sinf", mp4(b"frma", b"avc1"), mp4(b"schm", bytes(4), b"cbcs", bytes(4)), mp4(b"schi", mp4(b"tenc", bytes(4), bytes([0, 0, 1, 8]), kid)))
    stsd = mp4(b"stsd", bytes(8), mp4(b"encv", bytes(78), sinf))
    mdhd = lambda ts: mp4(b"mdhd", bytes(12), struct.pack(">II", ts, 0), bytes(4))
    init = lambda ts: mp4(b"moov", mp4(b"trak", mp4(b"mdia", mdhd(ts), mp4(b"minf", mp4(b"stbl", stsd)))))
    df = spark.createDataFrame([("seg", bytearray(seg)), ("init", bytearray(init(48000))), ("zero", bytearray(init(0))), ("nomdat", bytearray(seg[:-10])), ("cut", bytearray(seg[:-1])), ("none", None)], "path string, content binary")
    got = {r["path"]: r for r in store.scan_boxes(df).collect()}
    assert (got["seg"].start_pts, got["seg"].error) == (1 << 33, None)
    assert (got["init"].timescale, got["init"].scheme, got["init"].kids, got["init"].n_tracks, got["init"].error) == (48000, "cbcs", [kid.hex()], 1, None)
    assert got["zero"].error == "no timescale" and got["nomdat"].error == "missing mdat box" and "cut off" in got["cut"].error and got["none"].error


def test_store_scan_sidecars_and_sinks(spark, tmp_path):
    base = tmp_path / "data/ch/periods/p0/video_0/~di8x"
    base.mkdir(parents=True)
    for n in ("1.m4s", "2.ts", "x.m4s", "3.txt", "init.mp4"):
        (base / n).write_bytes(b"abc")
    got = sorted(rows(segment_store.scan_segment_store(spark, str(tmp_path / "data")), "channel_id", "period_id", "media_type", "as_id", "rep_id", "seg_no", "ext", "length"))
    assert got == [("ch", "p0", "video", "0", "v/1", 1, "m4s", 3), ("ch", "p0", "video", "0", "v/1", 2, "ts", 3)]
    (tmp_path / "side.jsonl").write_text('{"n":1,"s":0,"e":5,"t":10}\n{"n":2,"s":5,"e":9,"t":10,"dc":true}\n{"n":3,"s":')
    assert sorted(rows(store.read_sidecar(spark, str(tmp_path / "side.jsonl")), "n", "e", "dc")) == [(1, 5, None), (2, 9, True)]
    (tmp_path / "channels.json").write_text('{"channel_id":"a","hls_key_mode":"decrypt"}\n{"channel_id":"b","key_mode":"passthrough","hls_key_mode":"decrypt","keep_all":false}')
    assert sorted(rows(store.read_channels(spark, str(tmp_path / "channels.json")), "channel_id", "source_type", "key_mode", "keep_all", "error")) == [("a", "dash", "decrypt", True, None), ("b", "dash", "passthrough", False, "key_mode and hls_key_mode differ")]
    segs = spark.createDataFrame([("c", "p", 1), ("c", "q", 2)], "channel_id string, period_id string, seg_no bigint")
    for _ in range(2):
        store.write_segments(segs, str(tmp_path / "out"))
    store.write_segments(segs.where("period_id = 'q'").withColumn("seg_no", F.lit(9).cast("bigint")), str(tmp_path / "out"))
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")), "period_id", "seg_no")) == [("p", 1), ("q", 9)]
    store.write_documents(spark.createDataFrame([("c", "v", "x\ny")], "channel_id string, rep_id string, body string"), str(tmp_path / "docs"))
    assert "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "docs/channel_id=c/name=v")).collect()) == "x\ny\n"
    (tmp_path / "polls").mkdir()
    (tmp_path / "polls/1.json").write_text('{"channel_id":"c","rep_id":"v","media_sequence":4}\n{"chan')
    assert rows(store.read_snapshots(spark, str(tmp_path / "polls"), "polls"), "channel_id", "media_sequence") == [("c", 4)]


def test_what_to_fetch(spark):
    key = "channel_id string, period_id string, as_id string, rep_id string"
    rep = lambda r: ("c", "p", "0", r)
    expected = spark.createDataFrame([(*rep(r), n, kind) for r, kind in (("live", "dynamic"), ("vod", "static"), ("new", "dynamic")) for n in range(1, 11)], key + ", seg_no bigint, presentation string")
    high = spark.createDataFrame([(*rep("live"), 6, 8), (*rep("vod"), 10, 5)], key + ", last_scheduled bigint, max_stored bigint")
    stored = spark.createDataFrame([(*rep("live"), n) for n in (1, 2, 4, 8)] + [(*rep("vod"), n) for n in range(1, 6)] * 2, key + ", seg_no bigint")
    got = {}
    for r, n in rows(discovery.to_fetch(expected, high, stored), "rep_id", "seg_no"):
        got.setdefault(r, []).append(n)
    assert {r: sorted(x) for r, x in got.items()} == {"live": [3, 5, 6, 7, 8, 9, 10], "vod": list(range(1, 11)), "new": list(range(1, 11))}


def test_a_number_counts_once_for_each_representation(spark):
    attempts = [("c", "p", a, r, n, T, "ok", 100, i) for i, (a, r, n) in enumerate((a, r, n) for a, r in (("0", "v"), ("1", "a")) for n in range(5))]
    attempts += [("c", "p", "0", "v", 0, T + timedelta(1), "ok", 999, 20), ("c", "p", "0", "v", 7, T, "gone", None, 21), ("c", "p", "0", "v", 7, T, "error", None, 22)]
    df = spark.createDataFrame(attempts, "channel_id string, period_id string, as_id string, rep_id string, seg_no bigint, attempt_at timestamp, outcome string, bytes bigint, event_id bigint")
    assert rows(metrics.progress_counters(df), "channel_id", "stored", "failed", "dropped", "bytes") == [("c", 10, 2, 1, 1000)]


def test_lifetime_is_of_what_was_published(spark):
    df = spark.createDataFrame([("c", "p", "1", "v", n, s, n == 2) for n, s in ((1, "expired"), (2, "published"), (9, "committed"), (12, "pending"))], "channel_id string, period_id string, as_id string, rep_id string, seg_no bigint, status string, discontinuity boolean")
    assert rows(metrics.lifetime_ranges(df), "first_no", "last_no", "discontinuities") == [(1, 2, [2])]
    assert rows(metrics.lifetime_ranges(df.drop("status")), "first_no", "last_no") == [(1, 12)]
