"""Playlists are rendered and parsed with few passes and sorts."""

from segline import catalog
from segline.operators import playlist

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_playlists_of_a_window_are_one_pass_over_it(spark):
    assert plan(spark, "r2_vod_playlists").count("FileScan") == 3
    assert plan(spark, "r2_live_playlists").count("FileScan") <= 8
    assert plan(spark, "r6_local_playlists").count("FileScan") <= 7


def test_a_playlist_is_parsed_by_two_sorts(spark):
    lines = playlist.explode_playlist_lines(spark.createDataFrame([("d", "https://o/x", "#EXTM3U")], "doc_id string, url string, body string"))[0]
    text = playlist.parse_media_playlist(lines)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Sort [") == 2


def test_one_shot_tags_and_ranges(spark):
    body = "\n".join(["#EXTM3U", "#EXT-X-DISCONTINUITY", "#EXTINF:1,", "#EXT-X-BYTERANGE:10@5", "a", "#EXT-X-BYTERANGE:3", "b", "#EXTINF:2,", "#EXT-X-BYTERANGE:7", "a", "#EXTINF:3,", "#EXT-X-PROGRAM-DATE-TIME:2024-01-01T00:00:00Z", "c", "#EXT-X-DISCONTINUITY", "#EXTINF:4,", "#EXT-X-BYTERANGE:2@0", "a"])
    lines = playlist.explode_playlist_lines(spark.createDataFrame([("d", body)], "doc_id string, body string"))[0]
    got = playlist.parse_media_playlist(lines, url=None).orderBy("seq").collect()
    assert [(r.seq, r.uri, r.duration_s, r.discontinuity, r.program_at is not None, r.byte_length, r.byte_offset) for r in got] == [
        (0, "a", 1.0, True, False, 10, 5), (1, "a", 2.0, False, False, 7, 15), (2, "c", 3.0, False, True, None, None), (3, "a", 4.0, True, False, 2, 22),
    ]
